"""Links of line classes, counted where their sets meet, so that no pair is a row.

Two sets of Jaccard 0.8 share their first common word within the prefixes of both, and their
second within prefixes longer by one.

1. A class is posted under each word of its prefix, with its size, a parity bitmap and short
   hashes of the later words. Postings travel in blocks of bytes to the bucket of their word
   (``dealt``).
2. In its bucket a word's postings meet once more by their later words, and few of them are
   compared by size and bitmap. What is still tied becomes a list of classes (``lists_of``). A
   list that several words name counts once, so classes that share all their rare words share one.
3. Only sets on a list are read again. They travel to their lists, long lists in pairs of
   blocks, and there all pairs are verified and counted: of short lists by sorted words, of
   long ones by products of matrices. A pair on several lists counts on that of the least name.

Every row of this is a line, a list, or a class on a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mnemograph.llm import line_dedup as ld
from mnemograph.llm.common import arrow_map, free_shuffles, stage, text_slices, unstage

HOT_WORD = 200_000        # words at least so common are posted in pairs
WIDE = 96                 # words of a line whose parity bitmap has 128 bits, not 64
LONG = 1000               # words; longer lines are posted without later words
SLICE_BYTES = 2 << 20     # of text that a task holds at a time
BUCKET_BYTES = 8 << 20    # of postings that a task holds at a time, about
FLUSH_BYTES = 8 << 20     # of postings that a task gathers before it deals them out
CHUNK_BYTES = 8 << 20     # of sets that a task holds at a time, or one list
SHORT = 32                # classes of a list whose pairs are spelled out
BLOCK = 2048              # classes of a block of a longer list
ENTRIES = 1 << 21         # words of pairs that are sorted together
COMMON = 16               # rows of a word that makes it a column of a matrix
FEW = 16                  # postings tied by the same words that are compared each with each
MOST_CELLS = 1 << 27      # of the bit map of lines that are read again: 16 MB at most

U = np.uint64
PLACE = ld.PLACE
#: Of a posting: the low half of its key, its set by s1, a parity bitmap, words up to 65,535, and
#: how many hashes it has.
POSTED = {"key": np.uint32, "id": np.int64, "bits": np.uint64, "size": np.uint16, "n": np.uint8}
FOUND = (f"{ld.ROW_TYPE}, line int, s1 bigint, s2 bigint, g bigint, members array<bigint>")
COUNTED = ("s1 bigint, s2 bigint, to_doc bigint, to_line int, to_t1 bigint, to_t2 bigint, n bigint")


def ragged(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, number within its owner) of so many items of each owner."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


def postings(sets: ld.LineSets, lines: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, which of the lines, number of later words, 16-bit hashes of all later words)."""
    size, start = sets.size[lines], sets.start[lines]
    length = np.where(size > 0, ld.prefix_length(size), 0)
    # Sets of so few words are similar only if equal, and equal sets are one class.
    length[ld.PARTS[1] * size < ld.PARTS[0] * (size + 1)] = 0
    extended = np.minimum(length + 1, size)
    hot = sets.seen >= HOT_WORD
    # A line of any length has few later words: those of long lines are left out, and lines
    # that may be similar to a long one are posted both ways.
    long, near = size > LONG, ld.PARTS[1] * size >= ld.PARTS[0] * LONG
    paired = (length > 0) & ~long
    if len(lines):
        paired &= hot[sets.word[start + np.maximum(length, 1) - 1]]
    plain = length.copy()
    for i in np.flatnonzero(paired):
        plain[i] = np.argmax(hot[sets.word[start[i]:start[i] + length[i]]])
    owner, pos = ragged(plain)
    at = start[owner] + pos
    later = np.where(long[owner], 0, extended[owner] - pos - 1)
    n = later + near[owner]
    of, nth = ragged(n)
    short = (ld.mixed(sets.hash, 11) >> U(48)).astype(np.uint16)
    inside = nth < later[of]
    hashes = np.zeros(len(of), np.uint16)
    hashes[inside] = short[sets.word[at[of[inside]] + 1 + nth[inside]]]
    parts = [(sets.hash[sets.word[at]].view(U), owner, n, hashes)]
    for i in np.flatnonzero(paired):
        own = sets.hash[sets.word[start[i]:start[i] + extended[i]]]
        keys = [ld.mixed(own[j + 1:] ^ own[j:j + 1], 4) for j in range(plain[i], length[i])]
        if near[i]:
            keys.append(own[plain[i]:length[i]].view(U))
        keys = np.concatenate(keys)
        parts.append((keys, np.full(len(keys), i), np.ones(len(keys), np.int64),
                      np.zeros(len(keys), np.uint16)))
    return tuple(np.concatenate(x) for x in zip(*parts))


def packed(posted: dict[str, np.ndarray], high: np.ndarray, hashes: np.ndarray) -> bytes:
    return b"".join([np.array([len(posted["key"]), len(hashes)], np.int64).tobytes(),
                     *(posted[c].tobytes() for c in POSTED),
                     high[posted["size"] >= WIDE].tobytes(), hashes.tobytes()])


def unpacked(blob: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    n, m = np.frombuffer(blob, np.int64, 2).tolist()
    out, at = {}, 16
    for c, kind in POSTED.items():
        out[c] = np.frombuffer(blob, kind, n, at)
        at += out[c].nbytes
    wide = out["size"] >= WIDE
    out["high"] = np.zeros(n, U)
    out["high"][wide] = np.frombuffer(blob, U, int(wide.sum()), at)
    return out, np.frombuffer(blob, np.uint16, m, at + 8 * int(wide.sum()))


def dealt(docs: DataFrame, counts: np.ndarray, buckets: int) -> DataFrame:
    """Blocks of lines and of postings, each posting in the block of its key's bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in text_slices(batches, "text", SLICE_BYTES):
            sets = ld.LineSets(part.column("text").fill_null(""), counts)
            full, h, at = sets.full, sets.hash[sets.word].view(U), sets.start[sets.full]
            if not len(full):
                continue
            s1, s2 = (np.add.reduceat(ld.mixed(h, k), at).view(np.int64) for k in (1, 2))
            place = ld.mixed(h, 3)
            bit, low = U(1) << (place & U(63)), place >> U(63) == 0
            high = np.bitwise_xor.reduceat(np.where(low, U(0), bit), at)
            words = np.minimum(sets.size[full], 65_535)
            # The halves of a wide map, which give a narrow one laid upon each other.
            bits = np.bitwise_xor.reduceat(np.where(low, bit, U(0)), at)
            bits = np.where(words >= WIDE, bits, bits ^ high)
            rows = np.rec.fromarrays(
                [*(part.column(c).to_numpy()[sets.row[full]] for c in ld.ROW),
                 sets.line[full].astype(np.int32), s1, s2], dtype=LINES)
            first = np.unique(s1, return_index=True)[1]
            key, of, n, hashes = postings(sets, full[first])
            of = first[of]
            held.append((key, s1[of], bits[of], words[of], n, high[of], hashes))
            size += 23 * len(key) + 2 * len(hashes)
            yield block([int(s1[0]) % buckets], [rows.tobytes()], [None])
            if size >= FLUSH_BYTES:
                yield from flushed(held, buckets)
                held, size = [], 0
        yield from flushed(held, buckets)

    return arrow_map(docs, run, "bucket int, lines binary, postings binary")


LINES = np.dtype([*((c, "<i8") for c in ld.ROW), ("line", "<i4"), ("s1", "<i8"), ("s2", "<i8")])


def block(bucket: list, lines: list, posted: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket, pa.int32()), pa.array(lines, pa.binary()), pa.array(posted, pa.binary())],
        ["bucket", "lines", "postings"])


def flushed(held: list, buckets: int) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    key, *rest, high, hashes = (np.concatenate(x) for x in zip(*held))
    posted = {c: x.astype(kind) for (c, kind), x in zip(
        POSTED.items(), (key & U((1 << 32) - 1), *rest))}
    n = rest[-1]
    bucket = ((key >> U(32)) * U(buckets) >> U(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    begin = np.cumsum(n) - n
    for b in np.flatnonzero(np.diff(cuts)):
        some = order[cuts[b]:cuts[b + 1]]
        of, nth = ragged(n[some])
        yield block([b], [None], [packed({c: x[some] for c, x in posted.items()}, high[some],
                                         hashes[begin[some][of] + nth])])


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of n nodes, with edges between a and b."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def apart(size: np.ndarray, bits: np.ndarray, high: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many bits differ of the maps of x and y: of wide ones, or of narrow ones if one is narrow."""
    wide = np.minimum(size[x], size[y]) >= WIDE
    lows, highs = bits[x] ^ bits[y], high[x] ^ high[y]
    narrow = lows ^ np.where(size[x] >= WIDE, high[x], U(0)) ^ np.where(size[y] >= WIDE, high[y], U(0))
    return np.where(wide, np.bitwise_count(lows).astype(np.int64) + np.bitwise_count(highs),
                    np.bitwise_count(narrow))


def ties(group: np.ndarray, of: np.ndarray, size: np.ndarray, bits: np.ndarray, high: np.ndarray
         ) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of postings ``of`` that connect those of one group; groups are sorted.

    In a group of a few only those that may be similar, in a larger one all, each to the next.
    """
    cut = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    n = np.diff(np.append(cut, len(group)))
    a, b = [], []
    for step in range(1, FEW):
        here = cut[(n > step) & (n <= FEW)]
        if not len(here):
            break
        owner, nth = ragged(n[(n > step) & (n <= FEW)] - step)
        x, y = of[here[owner] + nth], of[here[owner] + nth + step]
        sx, sy = size[x], size[y]
        ok = ld.PARTS[1] * np.minimum(sx, sy) >= ld.PARTS[0] * np.maximum(sx, sy)
        ok &= apart(size, bits, high, x, y) <= sx + sy - 2 * ld.least_overlap(sx, sy)
        a.append(x[ok])
        b.append(y[ok])
    owner, nth = ragged(np.where(n > FEW, n - 1, 0))
    return (np.concatenate([*a, of[cut[owner] + nth]]), np.concatenate([*b, of[cut[owner] + nth + 1]]))


def lists_of(posted: dict[str, np.ndarray], hashes: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, size, members of all) of the lists of a bucket: of two classes and more."""
    key, ids, n = posted["key"], posted["id"], posted["n"].astype(np.int64)
    begin = np.cumsum(n) - n
    order = np.lexsort((ids, key))
    key, ids = key[order], ids[order]
    same = key[1:] == key[:-1]
    once = np.concatenate(([True], ~(same & (ids[1:] == ids[:-1]))))     # from several slices
    order, key, ids = order[once], key[once], ids[once]
    same = key[1:] == key[:-1]
    met = np.append(same, False) | np.append(False, same)
    order, key, ids = order[met], key[met], ids[met]
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    word = np.cumsum(np.append(True, key[1:] != key[:-1])) - 1
    of, nth = ragged(n[order])
    tie = word[of] << 16 | hashes[begin[order][of] + nth].astype(np.int64)
    bits = len(order).bit_length()
    if (int(word[-1]).bit_length() + 16 + bits) < 64:
        both = np.sort(tie << bits | of)
        tie, of = both >> bits, both & ((1 << bits) - 1)
    else:
        by = np.argsort(tie, kind="stable")
        tie, of = tie[by], of[by]
    same = tie[1:] == tie[:-1]
    met = np.append(same, False) | np.append(False, same)
    a, b = ties(tie[met], of[met], posted["size"][order].astype(np.int64), posted["bits"][order],
                posted["high"][order])
    label = components(len(order), a, b)
    by = np.argsort(label, kind="stable")                  # members stay in the order of ids
    label, ids = label[by], ids[by]
    cut = np.flatnonzero(np.append(True, label[1:] != label[:-1]))
    size = np.diff(np.append(cut, len(label)))
    name = np.add.reduceat(ld.mixed(ids, 12), cut)
    some = np.flatnonzero(size > 1)
    some = some[np.unique(name[some], return_index=True)[1]]
    of, nth = ragged(size[some])
    return name[some].view(np.int64), size[some], ids[cut[some][of] + nth]


def found(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row for each line with words (PLACE, s1, s2), and rows (g, members): lists of sets by s1.

    Any two similar sets that are not equal are together on a list.
    """
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A line of n words has about n / 5 postings of 23 bytes and 2 for each of n / 10 later words.
    buckets = max(2 * shuffles, int(counts.sum()) * 6 // BUCKET_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for bucket, lines, posted in zip(*(batch.column(c) for c in ("bucket", "lines", "postings"))):
                if lines.is_valid:
                    rows = np.frombuffer(lines.as_py(), LINES)
                    none = pa.nulls(len(rows), pa.int64())
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(np.ascontiguousarray(rows[c])) for c in (*ld.ROW, "line", "s1", "s2")),
                         none, pa.nulls(len(rows), pa.list_(pa.int64()))], NAMES)
                    continue
                if bucket.as_py() != now:
                    yield from listed(held)
                    now, held = bucket.as_py(), []
                held.append(unpacked(posted.as_py()))
        yield from listed(held)

    blocks = dealt(docs, counts, buckets)
    return arrow_map(blocks.repartition("bucket").sortWithinPartitions("bucket"), run, FOUND)


NAMES = [*ld.ROW, "line", "s1", "s2", "g", "members"]


def listed(held: list) -> Iterator[pa.RecordBatch]:
    if not held:
        return
    name, size, members = lists_of(
        {c: np.concatenate([x[c] for x, _ in held]) for c in held[0][0]},
        np.concatenate([x for _, x in held]))
    n = len(name)
    lists = pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(members))
    for at in range(0, n, 10_000):
        some = min(10_000, n - at)
        none = pa.nulls(some, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [none, none, none, pa.nulls(some, pa.int32()), none, none, pa.array(name[at:at + some]),
             lists.slice(at, some)], NAMES)


def sets_of(docs: DataFrame, live: DataFrame) -> DataFrame:
    """(PLACE, words) of lines in the cells of some places; words as the bytes of their hashes."""
    cells = min(MOST_CELLS, max(ld.FILTER_CELLS, 1 << (16 * live.count()).bit_length()))
    m = F.lit(cells)
    wanted = np.packbits(ld.marked_cells(
        live, F.pmod(F.pmod("doc", m) * 1009 + F.col("line") * 31, m), cells))
    none = np.zeros(ld.CELLS, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            split = pc.split_pattern(part.column("text").fill_null(""), "\n")
            owner, number = ragged(np.diff(split.offsets.to_numpy().astype(np.int64)))
            cell = (part.column("doc").to_numpy()[owner] % cells * 1009 + number * 31) % cells
            near = np.flatnonzero(wanted[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1)
            sets = ld.LineSets(split.flatten().take(pa.array(near)), none, whole=False)
            full = sets.full
            cuts = (8 * np.append(sets.start[full], len(sets.word))).astype(np.int32)
            words = pa.Array.from_buffers(pa.binary(), len(full), [
                None, pa.py_buffer(cuts), pa.py_buffer(sets.hash[sets.word])])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(owner[near][full])) for c in ld.ROW),
                 pa.array(number[near][full].astype(np.int32)), words], [*ld.ROW, "line", "words"])

    return arrow_map(docs, run, f"{ld.ROW_TYPE}, line int, words binary")


def overlaps(i: np.ndarray, j: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray
             ) -> np.ndarray:
    """How many numbers rows i and j share; a row's are distinct and small."""
    out = np.zeros(len(i), np.int64)
    ends = np.cumsum(size[i] + size[j])
    at = 0
    while at < len(i):
        done = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, done + ENTRIES, side="right")))
        rows = np.concatenate((i[at:stop], j[at:stop]))
        of, nth = ragged(size[rows])
        both = np.sort(of % (stop - at) << 32 | flat[start[rows][of] + nth])
        out[at:stop] = np.bincount(both[1:][both[1:] == both[:-1]] >> 32, minlength=stop - at)
        at = stop
    return out


def overlap_table(a: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray, flat: np.ndarray
                  ) -> np.ndarray:
    """How many numbers each of rows a shares with each of rows b."""
    same = a is b
    rows = a if same else np.concatenate((a, b))
    of, nth = ragged(size[rows])
    number = flat[start[rows][of] + nth]
    by = np.argsort(number, kind="stable")
    number, of = number[by], of[by]
    column = np.cumsum(np.append(True, number[1:] != number[:-1])) - 1 if len(number) else number
    seen = np.bincount(column)
    out = np.zeros((len(a), len(b)), np.float32)
    shift = 0 if same else len(a)

    few = seen[column] < COMMON if len(column) else np.zeros(0, bool)
    col, row = column[few], of[few]
    for d in range(1, COMMON):
        pair = np.flatnonzero(col[d:] == col[:-d])
        if not len(pair):
            break
        x, y = row[pair], row[pair + d]
        if same:
            np.add.at(out, (x, y), 1)
            np.add.at(out, (y, x), 1)
        else:
            x, y = np.minimum(x, y), np.maximum(x, y)
            cross = (x < shift) & (y >= shift)
            np.add.at(out, (x[cross], y[cross] - shift), 1)
    col, row = column[~few], of[~few]
    if len(col):
        col = np.cumsum(np.append(False, col[1:] != col[:-1]))
        for low in range(0, int(col[-1]) + 1, 2048):
            here = slice(*np.searchsorted(col, [low, low + 2048]))
            table = np.zeros((len(rows), min(2048, int(col[-1]) + 1 - low)), np.float32)
            table[row[here], col[here] - low] = 1
            out += table[:len(a)] @ table[shift:].T
    return out


def similar(shared: np.ndarray, total: np.ndarray) -> np.ndarray:
    return sum(ld.PARTS) * shared >= ld.PARTS[0] * total


def counted(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Links of each row of some whole lists, and its first earlier one."""
    names = [rows.column(c).to_numpy() for c in ("g", "bi", "bj")]
    place = [rows.column(c).to_numpy() for c in PLACE]
    again = np.logical_and.reduce([x[1:] == x[:-1] for x in names + place])
    if again.any():                                        # equal texts that share an id
        return counted(rows.filter(pa.array(np.append(True, ~again))))
    n = rows.num_rows
    cut = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in names])))
    group = np.diff(np.append(cut, n))
    order = np.lexsort(place[::-1])
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    ends = np.frombuffer(rows.column("words").buffers()[1], np.int32)[
        rows.column("words").offset:][:n + 1].astype(np.int64)
    hashes = np.frombuffer(rows.column("words").buffers()[2], np.int64, (ends[-1] - ends[0]) // 8, ends[0])
    size, start = np.diff(ends) // 8, (ends[:-1] - ends[0]) // 8
    words = np.unique(hashes, return_inverse=True)[1].astype(np.int64)
    bits = np.bitwise_xor.reduceat(U(1) << (ld.mixed(hashes, 3) & U(63)), start)
    lower = rows.column("lower")
    lower_n = pc.list_value_length(lower).to_numpy().astype(np.int64)
    lower_at = np.cumsum(lower_n) - lower_n
    lists = np.unique(lower.flatten().to_numpy(), return_inverse=True)[1].astype(np.int64)
    links, to = np.zeros(n, np.int64), np.full(n, n)

    whole = names[1][cut] == names[2][cut]
    few = np.flatnonzero(whole & (group <= SHORT))
    of, nth = ragged(group[few])
    row = cut[few][of] + nth
    at, back = ragged(nth)
    i, j = row[at], row[at] - 1 - back
    fit = ld.PARTS[1] * np.minimum(size[i], size[j]) >= ld.PARTS[0] * np.maximum(size[i], size[j])
    total = size[i] + size[j]
    fit &= np.bitwise_count(bits[i] ^ bits[j]) <= total - 2 * ld.least_overlap(size[i], size[j])
    i, j = i[fit], j[fit]
    fit = similar(overlaps(i, j, start, size, words), size[i] + size[j])
    i, j = i[fit], j[fit]
    fit = overlaps(i, j, lower_at, lower_n, lists) == 0
    i, j = i[fit], j[fit]
    np.add.at(links, i, 1)
    np.add.at(links, j, 1)
    np.minimum.at(to, i, rank[j])
    np.minimum.at(to, j, rank[i])

    mine = rows.column("b").to_numpy()
    for k in np.flatnonzero(~(whole & (group <= SHORT))):
        here = np.arange(cut[k], cut[k] + group[k])
        a = here if whole[k] else here[mine[here] == names[1][cut[k]]]
        b = here if whole[k] else here[mine[here] == names[2][cut[k]]]
        if not len(a) or not len(b):
            continue
        ok = similar(overlap_table(a, b, start, size, words).astype(np.int64), size[a][:, None] + size[b])
        ok &= overlap_table(a, b, lower_at, lower_n, lists) == 0
        if whole[k]:
            np.fill_diagonal(ok, False)
        for x, y, table in ((a, b, ok),) if whole[k] else ((a, b, ok), (b, a, ok.T)):
            links[x] += table.sum(1)
            to[x] = np.minimum(to[x], np.where(table, rank[y], n).min(1))

    some = np.flatnonzero(links)
    first = pa.array(order[np.minimum(to[some], n - 1)], mask=to[some] >= rank[some])
    return pa.RecordBatch.from_arrays(
        [rows.column("s1").take(pa.array(some)), rows.column("s2").take(pa.array(some)),
         *(rows.column(c).take(first) for c in PLACE), pa.array(links[some])],
        ["s1", "s2", *ld.TO, "n"])


def whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches that end where a list ends, of at least CHUNK_BYTES but the last."""
    held, size = [], 0
    for batch in ld._with_end(batches):
        if batch is not None:
            held.append(batch)
            size += batch.nbytes
            if size < CHUNK_BYTES:
                continue
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0] if sum(
            x.num_rows for x in held) else None
        if rows is None or batch is None:
            if rows is not None:
                yield rows
            return
        names = [rows.column(c).to_numpy() for c in ("g", "bi", "bj")]
        last = np.flatnonzero(np.append(True, np.logical_or.reduce([x[1:] != x[:-1] for x in names])))[-1]
        if last:
            yield rows.slice(0, last)
        rows = pa.Table.from_batches([rows.slice(last)]).combine_chunks().to_batches()[0]
        held, size = [rows], 0


def links_of(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(s1, s2, to, n_links) of each class with links: its first earlier one, and how many.

    ``rows`` is the table of ``found``, ``classes`` (PLACE, s1, s2) has the first line of each set.
    """
    lists = rows.where("g IS NOT NULL").groupBy("g").agg(F.first("members").alias("members"))
    on = lists.select("g", F.size("members").alias("n"), F.posexplode("members").alias("at", "s1")) \
        .select("s1", F.struct("g", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"),
                               F.floor(F.col("at") / BLOCK).cast("int").alias("b")).alias("on"))
    live = stage(classes.join(on.groupBy("s1").agg(F.collect_list("on").alias("lists")), "s1"),
                 "line-live")
    free_shuffles(pairs.sparkSession)
    met = sets_of(pairs, live).join(live, PLACE)
    met = met.withColumn("on", F.explode("lists")).withColumn("other", F.explode(
        F.expr("sequence(0, on.blocks - 1)"))).select(
        "on.g", F.least("on.b", "other").alias("bi"), F.greatest("on.b", "other").alias("bj"), "on.b",
        *PLACE, "s1", "s2", "words",
        F.expr("transform(filter(lists, x -> x.g < on.g), x -> x.g)").alias("lower"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in whole_lists(batches):
            yield counted(part)

    met = met.repartition("g", "bi", "bj").sortWithinPartitions("g", "bi", "bj", *PLACE)
    links = stage(arrow_map(met, run, COUNTED).groupBy("s1", "s2").agg(
        F.min(F.when(F.col("to_doc").isNotNull(), F.struct(*ld.TO))).alias("to"),
        F.sum("n").alias("n_links")), "line-links")
    unstage(live)
    free_shuffles(pairs.sparkSession)
    return links
