"""Line dedup: an exact set-similarity join of lines, which removes later matches.

A line is the set of its words. It goes if an earlier line, by document id and position,
has a Jaccard similarity of ``SIMILARITY`` or more with it, whether that one stays or not.

1. Words are counted into a sketch of fixed size, which gives every word its place in one
   order by rarity (count of its cell, then hash).
2. Lines with equal sets form a class, the first of them represents it. From here on
   classes are compared.
3. Each class is posted under its prefix: so many of its rarest words that two similar
   sets must share one. Within a word's postings length, positional and bitmap filters
   leave a class with few earlier candidates. A word that is so common that its postings
   could fill a task is posted together with each later word of a prefix longer by one, as
   two similar sets then share two.
4. Jaccard is verified on the sets themselves, read again for candidates only.

A class in a group of many similar ones needs one match, not all: a posting names the
earliest candidate and the nearest ones before it. Only if these fail and others were
left out, all candidates of the class are tried. So no group emits all its pairs, and no
decision is lost. This is the way of the removal; with ``links`` the links of each class are
counted, all of them, by ``line_links``.

Defined results: words are runs of characters outside ASCII white space; words are compared
by 64-bit and sets by 128-bit hashes. A line without words always stays and is no row
of the result. Null and empty texts have no lines. Rows that share an id, or have none,
count as one text if equal, and else as texts of their own, told apart by 127 bits of the
text's hash (``t1``, ``t2``; 0 for an id with one text): lines come in the order of id, line
number, and hash. A null id sorts as the smallest number. Other columns pass through ``without_lines`` whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from mnemograph.llm.common import (
    arrow_map, free_shuffles, stage, text_slices, unstage)

SLICE_BYTES = 2 << 20       # of text that a task holds at a time
CELLS = 1 << 18           # of the sketch of word counts: 2 MB, whatever the corpus
PARTS = 8, 10             # similarity of two sets: 8 / 10
HOT = 20_000              # words at least so common are posted in pairs
CHUNK_ROWS = 100_000      # postings that are compared together
WINDOW = 4096             # postings of a key, besides its first, that one is compared with
NAMED = 5                 # candidates that one posting names
MARK = 1 << 20            # bits apart of no real candidate
FILTER_CELLS = 1 << 22    # of the bit map of lines that are read again: 512 KB
NULL_ID = -(1 << 63)
ROW = ["doc", "t1", "t2"]
PLACE = ["doc", "line", "t1", "t2"]     # of a line, in the order of lines
TO = [f"to_{c}" for c in PLACE]

U = np.uint64
ROW_TYPE = "doc bigint, t1 bigint, t2 bigint"
LINE = (f"{ROW_TYPE}, line int, s1 bigint, s2 bigint, size int, bits bigint, bits2 bigint, "
        "keys array<bigint>")


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(U) + U((0x9E3779B97F4A7C15 * (seed + 1)) & ((1 << 64) - 1))
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct numbers; on long arrays a sort is faster than np.unique's hashing."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def prefix_length(size: np.ndarray) -> np.ndarray:
    """Two sets of similarity 8/10 share one of so many first words."""
    return size - -(-PARTS[0] * size // PARTS[1]) + 1


def least_overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -(-PARTS[0] * (a + b) // (PARTS[0] + PARTS[1]))


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hashes of words, the same in every process: sums over places and bytes, mixed."""
    if not len(words):
        return np.zeros(0, np.int64)
    words = words.cast(pa.large_binary())
    ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    size = np.diff(ends)
    if ends[-1] == ends[0]:
        return mixed(mixed(size, 6), 7).view(np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0]:ends[-1]]
    place = np.arange(len(data)) - np.repeat(ends[:-1] - ends[0], size)
    sums = np.concatenate((np.zeros(1, U), np.cumsum(mixed(place << 8 | data, 5))))
    return mixed((sums[ends[1:] - ends[0]] - sums[ends[:-1] - ends[0]]) ^ mixed(size, 6), 7).view(np.int64)


def cells_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(U) >> U(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def shared_cells(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """Marks the cells of ids that stand for several texts."""
    h1, h2 = text_hashes(text_col)
    ids = docs.select(F.col(id_col).cast("bigint").alias("doc"), h1.alias("h1"), h2.alias("h2"))
    ids = ids.where("doc IS NOT NULL").groupBy("doc").agg(
        F.min("h1").alias("a1"), F.max("h1").alias("b1"), F.min("h2").alias("a2"),
        F.max("h2").alias("b2"))
    return marked_cells(ids.where("a1 <> b1 OR a2 <> b2"), F.pmod("doc", F.lit(FILTER_CELLS)))


def text_hashes(text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def row_of(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """The columns ROW. Only rows without an id of their own carry hashes, others zeros."""
    doc = F.col(id_col).cast("bigint")
    cells = shared_cells(docs, id_col, text_col)
    tied = doc.isNull()
    if cells.any():
        packed = np.packbits(cells)

        @F.pandas_udf("boolean")
        def shared(ids: pd.Series) -> pd.Series:
            cell = ids.to_numpy(np.int64) % FILTER_CELLS
            return pd.Series((packed[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool))

        tied = tied | shared(F.coalesce(doc, F.lit(NULL_ID)))
    h1, h2 = text_hashes(text_col)
    # The sign tells a null id from the number that stands for it.
    t1 = F.when(doc.isNull(), h1.bitwiseOR(F.lit(NULL_ID))).otherwise(h1.bitwiseAND(F.lit(~NULL_ID)))
    return [F.coalesce(doc, F.lit(NULL_ID)).alias("doc"),
            F.when(tied, t1).otherwise(F.lit(0).cast("bigint")).alias("t1"),
            F.when(tied, h2).otherwise(F.lit(0).cast("bigint")).alias("t2")]


def _pairs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(*row_of(docs, id_col, text_col), F.col(text_col).alias("text"))


def rarity(docs: DataFrame) -> np.ndarray:
    """Counts of all words in the cells of the sketch; CELLS numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS, np.int64)
        for part in text_slices(batches, "text", SLICE_BYTES):
            words = pc.ascii_split_whitespace(part.column("text").fill_null("")).flatten() \
                .dictionary_encode()
            counts = np.bincount(words.indices.to_numpy(), minlength=len(words.dictionary))
            np.add.at(total, cells_of(word_hashes(words.dictionary)), counts)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["cell", "n"])

    rows = arrow_map(docs.select("text"), run, "cell bigint, n bigint") \
        .groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CELLS, np.int64)
    counts[rows["cell"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


class LineSets:
    """The lines of a slice as sets of words in order of rarity."""

    def __init__(self, texts: pa.Array, counts: np.ndarray, whole: bool = True):
        """``texts`` are whole texts, or already lines; ``row`` is the text of each line."""
        if whole:
            split = pc.split_pattern(texts, "\n")
            per_text, lines = np.diff(split.offsets.to_numpy().astype(np.int64)), split.flatten()
        else:
            per_text, lines = np.ones(len(texts), np.int64), texts
        self.row = np.repeat(np.arange(len(texts)), per_text)
        self.line = np.arange(len(lines)) - np.repeat(np.cumsum(per_text) - per_text, per_text)
        words = pc.ascii_split_whitespace(lines)
        coded = words.flatten().dictionary_encode()
        empty = pc.equal(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        hashes = word_hashes(coded.dictionary)
        seen = counts[cells_of(hashes)]
        rank = np.empty(len(hashes), np.int64)
        self.order = np.lexsort((hashes, seen))
        rank[self.order] = np.arange(len(hashes))
        owner = np.repeat(np.arange(len(lines)), np.diff(words.offsets.to_numpy()))
        code = coded.indices.to_numpy()
        real = ~empty[code] if len(code) else np.zeros(0, bool)
        width = max(len(hashes), 1)
        key = distinct(owner[real] * width + rank[code[real]])
        self.of, self.word = key // width, key % width
        self.hash, self.seen = hashes[self.order], seen[self.order]
        self.size = np.bincount(self.of, minlength=len(lines))
        self.full = np.flatnonzero(self.size)
        self.start = np.cumsum(self.size) - self.size

    def signatures(self) -> list[np.ndarray]:
        """Two hashes and two words of a parity bitmap of each line with words, from unordered sums."""
        h, at = self.hash[self.word].view(U), self.start[self.full]
        if not len(at):
            return [np.zeros(0, np.int64)] * 4
        place = mixed(h, 3)
        bit = U(1) << (place & U(63))
        low = place >> U(63) == 0
        return [np.add.reduceat(mixed(h, 1), at).view(np.int64),
                np.add.reduceat(mixed(h, 2), at).view(np.int64),
                np.bitwise_xor.reduceat(np.where(low, bit, U(0)), at).view(np.int64),
                np.bitwise_xor.reduceat(np.where(low, U(0), bit), at).view(np.int64)]

    def keys(self, lines: np.ndarray) -> pa.Array:
        """The keys that each of some lines is posted under, by position."""
        size = self.size[lines]
        length = np.where(size > 0, prefix_length(size), 0)
        # Sets of so few words are similar only if equal, and equal sets are one class.
        length[PARTS[1] * size < PARTS[0] * (size + 1)] = 0
        start = self.start[lines]
        hot = self.seen >= HOT
        # The last word of a prefix is the most common one: only there pairs can begin.
        paired = (length > 0) & hot[self.word[start + np.maximum(length, 1) - 1]] \
            if len(lines) else np.zeros(0, bool)
        plain = np.where(paired, 0, length)
        ends = np.cumsum(plain)
        flat = self.hash[self.word[np.repeat(start - (ends - plain), plain) + np.arange(plain.sum())]]
        if not paired.any():
            return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(flat))
        parts = np.split(flat, ends[:-1])
        for i in np.flatnonzero(paired).tolist():
            word = self.word[start[i]:start[i] + min(length[i] + 1, size[i])]
            own, first = self.hash[word], int(np.argmax(hot[word]))
            parts[i] = np.concatenate([own[:first], *(
                mixed(own[j + 1:] ^ own[j:j + 1], 4).view(np.int64)
                for j in range(first, length[i]))])
        ends = np.cumsum([len(x) for x in parts])
        return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()),
                                        pa.array(np.concatenate(parts)))


def line_sets(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row for each line with words; the first of equal sets in a slice has the keys."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            sets = LineSets(part.column("text").fill_null(""), counts)
            s1, s2, bits, bits2 = sets.signatures()
            full = sets.full
            order = np.lexsort((np.arange(len(full)), s2, s1))
            first = np.ones(len(full), bool)
            first[order[1:]] = (s1[order[1:]] != s1[order[:-1]]) | (s2[order[1:]] != s2[order[:-1]])
            keys = sets.keys(full[first])
            at = np.where(first, np.cumsum(first) - 1, -1)
            keys = keys.take(pa.array(at, mask=~first))
            of = pa.array(sets.row[full])
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(of) for c in ROW), pa.array(sets.line[full].astype(np.int32)), pa.array(s1),
                 pa.array(s2), pa.array(sets.size[full].astype(np.int32)), pa.array(bits),
                 pa.array(bits2), keys],
                [*ROW, "line", "s1", "s2", "size", "bits", "bits2", "keys"])

    return arrow_map(docs, run, LINE)


def classes_of(lines: DataFrame) -> DataFrame:
    """One row for each set: its first line, and what it is posted under."""
    return lines.groupBy("s1", "s2").agg(
        F.min(F.struct(*PLACE)).alias("first"), F.max("size").alias("size"),
        F.max("bits").alias("bits"), F.max("bits2").alias("bits2"), F.max("keys").alias("keys")) \
        .select("s1", "s2", "first.*", "size", "bits", "bits2", "keys")


POSTING = ["key", *PLACE, "size", "pos", "bits", "bits2"]


def postings_of(classes: DataFrame) -> DataFrame:
    # With pairs a key's place in the list is no position; 0 claims nothing.
    pos = F.when(F.size("keys") <= F.floor(F.col("size") * 2 / 10) + 1, F.col("pos")).otherwise(0)
    return classes.select(*PLACE, "size", "bits", "bits2", "keys",
                          F.posexplode("keys").alias("pos", "key")) \
        .select("key", *PLACE, "size", pos.cast("int").alias("pos"), "bits", "bits2")


def may_match(a: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether rows i and j pass the filters, and how many bits of their maps differ."""
    sa, sb = a["size"][i], a["size"][j]
    need = least_overlap(sa, sb)
    apart = sum(np.bitwise_count((a[c][i] ^ a[c][j]).view(U)).astype(np.int64)
                for c in ("bits", "bits2"))
    most = np.minimum(sa - a["pos"][i], sb - a["pos"][j])
    ok = (PARTS[1] * np.minimum(sa, sb) >= PARTS[0] * np.maximum(sa, sb)) \
        & (most >= need) & (apart <= sa + sb - 2 * need)
    # A key may hold a class twice.
    return ok & np.logical_or.reduce([a[c][i] != a[c][j] for c in PLACE]), apart


def named(a: dict[str, np.ndarray], old: int, few: int, window: int
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(target, source, bits apart, whether others may be left) of postings sorted by key.

    Each is compared with the first of its key and up to ``window`` rows before it, until
    ``few`` are found. The first ``old`` rows are no targets, and ``nth`` numbers the rows
    of a key. A target that others are left for comes with the source -1 as well.
    """
    n = len(a["key"])
    fresh = np.concatenate(([True], a["key"][1:] != a["key"][:-1]))
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    count, out = np.zeros(n, np.int64), []
    i = np.flatnonzero(~fresh)
    i = i[i >= old]
    ok, apart = may_match(a, i, head[i])
    out.append((i[ok], head[i][ok], apart[ok]))
    count[i[ok]] += 1
    d = 1
    i = i[i - d > head[i]]
    while len(i) and d <= window:
        ok, apart = may_match(a, i, i - d)
        out.append((i[ok], i[ok] - d, apart[ok]))
        count[i[ok]] += 1
        d += 1
        more = i - d > head[i]
        i = i[more & (count[i] < few)]
    cut = np.flatnonzero((a["nth"] > window + 1) & (count < few))
    cut = cut[cut >= old]
    out.append((cut, np.full(len(cut), -1), np.full(len(cut), MARK)))
    target, source, apart = (np.concatenate(x) for x in zip(*out))
    return target, source, apart, (count[target] >= few) | (source < 0)


PAIR = ("doc bigint, line int, t1 bigint, t2 bigint, to_doc bigint, to_line int, to_t1 bigint, "
        "to_t2 bigint")
CANDIDATE = f"{PAIR}, apart int, more boolean"


def candidates(postings: DataFrame) -> DataFrame:
    """Earlier classes that a class may match, a few for each of its postings.

    A task holds a chunk of postings and, of a key that began before it, the first and
    the last WINDOW. A posting that found too few among these has a row without a
    candidate, so that what it may match elsewhere is looked up.
    """
    dealt = postings.repartition("key").sortWithinPartitions("key", *PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of a key that goes on: its first row and the last ones, all numbered within it.
        kept: dict[str, np.ndarray] | None = None
        held: list[pa.RecordBatch] = []
        for batch in _with_end(batches):
            if batch is not None:
                held.append(batch)
                if sum(x.num_rows for x in held) < CHUNK_ROWS:
                    continue
            if not held:
                return
            new = {c: np.concatenate([x.column(c).to_numpy() for x in held]).astype(np.int64)
                   for c in POSTING}
            held, old = [], 0
            fresh = np.concatenate(([True], new["key"][1:] != new["key"][:-1]))
            place = np.arange(len(fresh))
            new["nth"] = place - np.maximum.accumulate(np.where(fresh, place, 0))
            if kept is not None and kept["key"][-1] == new["key"][0]:
                new["nth"][new["key"] == new["key"][0]] += kept["nth"][-1] + 1
                old = len(kept["key"])
                new = {c: np.concatenate((kept[c], v)) for c, v in new.items()}
            t, s, apart, more = named(new, old, NAMED, WINDOW)
            first = int(np.searchsorted(new["key"][old:], new["key"][-1])) + old
            if first == old and old:
                first = 0
            last = np.arange(max(first + 1, len(new["key"]) - WINDOW), len(new["key"]))
            kept = {c: v[np.append(first, last)] for c, v in new.items()}
            none = s < 0
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(new[c][t].astype(np.int32 if c == "line" else np.int64)) for c in PLACE),
                 *(pa.array(new[c][s].astype(np.int32 if c == "line" else np.int64), mask=none)
                   for c in PLACE), pa.array(apart.astype(np.int32)), pa.array(more)],
                [*PLACE, *TO, "apart", "more"])

    return arrow_map(dealt, run, CANDIDATE)


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def postings_near(classes: DataFrame, keys: DataFrame) -> DataFrame:
    """Postings whose key is, or shares a cell with, one of some keys."""
    cells = marked_cells(keys, F.pmod("key", F.lit(FILTER_CELLS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            lists = part.column("keys")
            starts = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(part.num_rows), np.diff(starts))
            pos = np.arange(len(flat)) - (starts[:-1] - starts[0])[owner]
            near = np.flatnonzero(cells[flat % FILTER_CELLS])
            owner, size = owner[near], part.column("size").to_numpy().astype(np.int64)
            length = np.diff(starts)
            # With pairs a key's place in the list is no position; 0 claims nothing.
            pos = np.where(length[owner] <= size[owner] * 2 // 10 + 1, pos[near], 0)
            rows = part.take(pa.array(owner))
            yield pa.RecordBatch.from_arrays(
                [pa.array(flat[near]), *(rows.column(c) for c in PLACE), rows.column("size"),
                 pa.array(pos.astype(np.int32)), rows.column("bits"), rows.column("bits2")], POSTING)

    return arrow_map(
        classes.select(*PLACE, "size", "bits", "bits2", "keys").where("keys IS NOT NULL"),
        run, "key bigint, doc bigint, line int, t1 bigint, t2 bigint, size int, pos int, bits bigint, "
        "bits2 bigint")


def all_candidates(classes: DataFrame, targets: DataFrame) -> DataFrame:
    """Every earlier class that each of some targets, a stored table, may match."""
    place = [c for c in PLACE if c in targets.columns]
    own = classes.join(targets.select(place), place, "left_semi")
    mine = stage(postings_of(own), "line-targets")
    # Only postings that can meet the targets' are shuffled.
    return _met(mine, postings_near(classes, mine.select("key")))


def _met(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Pairs of postings of one key that pass the filters; AQE splits a hot key into blocks."""
    # New names on both sides: where both are the same postings, they are shuffled once.
    mine = mine.select(*[F.col(c).alias(f"my_{c}") for c in POSTING])
    other = other.select(*[F.col(c).alias(f"to_{c}") for c in POSTING])
    a, b = F.col("my_size"), F.col("to_size")
    need = F.ceil((a + b) * PARTS[0] / (PARTS[0] + PARTS[1]))
    earlier = F.struct(*TO) < F.struct(*(F.col(f"my_{c}").alias(t) for c, t in zip(PLACE, TO)))
    return mine.join(other, (F.col("my_key") == F.col("to_key")) & earlier
                     & (F.least(a, b) * PARTS[1] >= F.greatest(a, b) * PARTS[0])
                     & (F.least(a - F.col("my_pos"), b - F.col("to_pos")) >= need)
                     & (F.bit_count(F.col("my_bits").bitwiseXOR(F.col("to_bits")))
                        + F.bit_count(F.col("my_bits2").bitwiseXOR(F.col("to_bits2")))
                        <= a + b - 2 * need)) \
        .select(*(F.col(f"my_{c}").alias(c) for c in PLACE), *TO).distinct()


def line_cell(doc, line):
    """Cell of a line in the filter of wanted lines, for columns as for arrays."""
    return (doc % FILTER_CELLS * 1009 + line * 31) % FILTER_CELLS


def marked_cells(rows: DataFrame, cell: Column, n: int = FILTER_CELLS) -> np.ndarray:
    """Marks the cells of some rows: ``n`` bits reach the driver, however many rows."""
    cell = cell + 1
    rows = rows.groupBy(F.bitmap_bucket_number(cell).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(cell)).alias("bits")).collect()
    marks = np.zeros(n + 1, bool)
    for bucket, bits in rows:
        part = np.unpackbits(np.frombuffer(bytes(bits), np.uint8), bitorder="little")
        at = (bucket - 1) * len(part)
        part = part[:max(0, min(len(part), n - at))]
        marks[at:at + len(part)] = part
    return marks[:-1]


def wanted_cells(lines: DataFrame) -> np.ndarray:
    m = F.lit(FILTER_CELLS)
    return marked_cells(lines, F.pmod(F.pmod("doc", m) * 1009 + F.col("line") * 31, m))


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The places in ``pairs``, a stored table, that are similar.

    The texts are read again. Only lines in a wanted cell are kept, so little more than
    the wanted sets is shuffled: to the pairs they belong to, where two meet.
    """
    pair = F.struct(*PLACE, *TO).alias("pair")
    ends = pairs.select(*PLACE, F.lit(False).alias("target"), pair).unionByName(
        pairs.select(*(F.col(t).alias(c) for c, t in zip(PLACE, TO)), F.lit(True).alias("target"), pair))
    cells = wanted_cells(ends)
    none = np.zeros(CELLS, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            texts = part.column("text").fill_null("")
            split = pc.split_pattern(texts, "\n")
            sizes = np.diff(split.offsets.to_numpy().astype(np.int64))
            owner = np.repeat(np.arange(len(texts)), sizes)
            doc = part.column("doc").to_numpy()[owner]
            number = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            near = np.flatnonzero(cells[line_cell(doc, number)])
            sets = LineSets(split.flatten().take(pa.array(near)), none, whole=False)
            full = sets.full
            cuts = np.append(sets.start[full], len(sets.word)).astype(np.int32)
            words = pa.ListArray.from_arrays(pa.array(cuts), pa.array(sets.hash[sets.word]))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c).take(pa.array(owner[near][full])) for c in ROW),
                 pa.array(number[near][full].astype(np.int32)), pa.array(sets.signatures()[0]), words],
                [*ROW, "line", "s1", "words"])

    sets = arrow_map(docs, run, f"{ROW_TYPE}, line int, s1 bigint, words array<bigint>")
    met = sets.join(ends, PLACE).groupBy("pair").agg(
        F.max(F.when(~F.col("target"), F.struct("s1", "words"))).alias("a"),
        F.max(F.when(F.col("target"), F.struct("s1", "words"))).alias("b"))
    both = F.size(F.array_intersect("a.words", "b.words"))
    union = F.size("a.words") + F.size("b.words") - both
    return met.where(both * PARTS[1] >= union * PARTS[0]).select("pair.*")


def earlier_links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(doc, line, t1, t2, to) of each class that has an earlier link, and one of them."""
    found = stage(candidates(postings_of(classes)).groupBy(*PLACE, *TO).agg(
        F.min("apart").alias("apart"), F.max("more").alias("more")), "line-candidates")
    free_shuffles(pairs.sparkSession)
    # The candidate whose bits differ least is tried first, the others where it fails.
    best = stage(found.groupBy(*PLACE).agg(
        F.min(F.struct("apart", *TO)).alias("b"), F.max("more").alias("more"),
        F.count("to_doc").alias("n")).select(*PLACE, *(f"b.{c}" for c in TO), "more", "n"),
        "line-best")
    links = stage(verified(pairs, best.where("n > 0").select(*PLACE, *TO)), "line-links")
    free_shuffles(pairs.sparkSession)
    failed = best.join(links.select(PLACE), PLACE, "left_anti")
    rest = stage(found.where("to_doc IS NOT NULL")
                 .join(failed.where("n > 1").select(PLACE), PLACE, "left_semi")
                 .select(*PLACE, *TO), "line-rest")
    parts = [links]
    if not rest.isEmpty():
        parts.append(stage(verified(pairs, rest), "line-links"))
    still = failed.where("more").select(PLACE)
    for part in parts[1:]:
        still = still.join(part.select(PLACE), PLACE, "left_anti")
    still = stage(still, "line-open")
    if not still.isEmpty():
        left = stage(all_candidates(classes, still), "line-all")
        parts.append(stage(verified(pairs, left), "line-links"))
        unstage(left)
    unstage(found, best, rest, still)
    linked = parts[0]
    for part in parts[1:]:
        linked = linked.unionByName(part)
    return linked.groupBy(*PLACE).agg(F.min(F.struct(*TO)).alias("to"))


def matched_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  links: bool = False) -> DataFrame:
    """A row for each line with words.

    (doc, line, class_doc, class_line, to_doc, to_line, kept), and t1, t2 beside each doc: the first line with the same
    set of words, an earlier line of another set that this class is similar to (null if
    there is none), and whether the line stays. A null id is ``NULL_ID`` here. ``links`` adds
    n_links: how many other classes, earlier and later, the class is similar to.
    """
    pairs = _pairs(docs, id_col, text_col)
    of = [f"class_{c}" for c in PLACE]
    if links:
        from mnemograph.llm import line_links   # which imports this module

        found = stage(line_links.found(pairs, rarity(pairs)), "line-rows")
        free_shuffles(docs.sparkSession)
        lines = found.where("g IS NULL").select(*PLACE, "s1", "s2")
        classes = stage(lines.groupBy("s1", "s2").agg(F.min(F.struct(*PLACE)).alias("c"))
                        .select("s1", "s2", "c.*"), "line-classes")
        names = classes.select("s1", "s2", *(F.col(c).alias(n) for c, n in zip(PLACE, of)))
        linked = line_links.links_of(pairs, found, classes)
        key = ["s1", "s2"]
    else:
        lines = stage(line_sets(pairs, rarity(pairs)), "line-rows")
        names = lines.groupBy("s1", "s2").agg(F.min(F.struct(*PLACE)).alias("c")) \
            .select("s1", "s2", *(F.col(f"c.{c}").alias(n) for c, n in zip(PLACE, of)))
        linked = earlier_links(pairs, classes_of(lines)).select(
            *(F.col(c).alias(n) for c, n in zip(PLACE, of)), "to")
        key = of
    linked = linked.select(*key, "to.*", *["n_links"] * links)
    verdict = names.join(linked, key, "left")
    first = F.struct(*PLACE) == F.struct(*(F.col(n).alias(c) for c, n in zip(PLACE, of)))
    return lines.select(*PLACE, "s1", "s2").join(verdict, ["s1", "s2"]).select(
        *PLACE, *of, *TO, *[F.coalesce("n_links", F.lit(0)).alias("n_links")] * links, (first & F.col("to_doc").isNull()).alias("kept"))


def without_lines(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``docs`` without the removed (doc, line); other columns and rows stay as they are.

    With t1 and t2 beside them, as ``matched_lines`` gives them, rows that share an id lose
    their own lines only.
    """
    gone = "_ld_gone"
    row = [c for c in ROW if c in removed.columns]
    lists = removed.groupBy(*(F.col(c).alias(f"_ld_{c}") for c in row)).agg(
        F.collect_set("line").alias(gone))     # lines of one document, no more than it has
    if len(row) > 1:
        mine = row_of(docs, id_col, text_col)
    else:
        mine = [F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc")]
    mine = docs.select("*", *(x.alias(f"_ld_my_{c}") for c, x in zip(row, mine)))
    same = [F.col(f"_ld_my_{c}") == F.col(f"_ld_{c}") for c in row]
    joined = mine.join(lists, same, "left").select(*docs.columns, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, SLICE_BYTES):
            at = part.schema.get_field_index(text_col)
            texts = part.column(at).to_pylist()
            for i, lines in enumerate(part.column(part.num_columns - 1).to_pylist()):
                if lines and texts[i] is not None:
                    lost = set(lines)
                    texts[i] = "\n".join(x for n, x in enumerate(texts[i].split("\n"))
                                         if n not in lost)
            cols = list(part.columns)[:-1]
            cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, part.schema.names[:-1])

    return arrow_map(joined, run, docs.schema)
