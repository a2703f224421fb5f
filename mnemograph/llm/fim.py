"""Fill-in-middle: cut texts into prefix, middle and suffix and put the middle last.

A task lays the UTF-8 bytes of a slice of texts end to end in blocks of a fixed size and
keeps two counts per block, of units and of code points, in a Fenwick tree. A cut is
given as a number of units. Descending the tree by binary lifting finds the block that
holds the cut and the code points before that block; only this block's bytes are then
looked at for the boundary. All cuts of a slice descend together.

Units are code points, or the matches of a pattern, found left to right over the code
points of a text: a cut after 0 units lies at the start, after k of n units where unit
k + 1 begins, after n units at the end.

Defined results: a null text counts as empty. An empty text, and one that holds a
sentinel, stays plain, so every output can be undone (:func:`restored`). A null id is
hashed as an empty string. Rows are independent: repeated rows give repeated results,
an empty table an empty one, a text of any length is cut whole, and columns besides
id and text are neither read nor returned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from mnemograph.llm.common import arrow_map, text_slices

SLICE_BYTES = 12 << 20      # of text that a task holds at a time
BLOCK_BYTES = 256           # of a block of the tree
CUTS = 1 << 14              # cuts whose blocks are looked at together
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 90, 20     # per cent of texts that are cut, and of these in suffix-first form

RESULT = ("n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")


class Fenwick:
    """Marks on the bytes of a slice, counted by fixed blocks; cuts descend by the first kind."""

    def __init__(self, *marks: np.ndarray):
        self.blocks = max(1, -(-len(marks[0]) // BLOCK_BYTES))
        self.tree = np.zeros((self.blocks + 1, len(marks)), np.int64)
        self.marks = []
        for i, mark in enumerate(marks):
            padded = np.zeros((self.blocks + 1) * BLOCK_BYTES, np.uint8)
            padded[:len(mark)] = mark
            self.marks.append(padded.reshape(self.blocks + 1, -1))
            self.tree[1:, i] = self.marks[i][:-1].sum(1, dtype=np.int64)
        node, width = np.arange(self.blocks + 1), 1
        while width <= self.blocks:             # children give their sums to their parents
            child = node[(node & (2 * width - 1)) == width]
            child = child[child + width <= self.blocks]
            self.tree[child + width] += self.tree[child]
            width *= 2

    def counts(self, at: np.ndarray) -> np.ndarray:
        """The marks of each kind before given bytes."""
        block, offset = np.divmod(at, BLOCK_BYTES)
        out, node = np.zeros((len(at), len(self.marks)), np.int64), block.copy()
        while node.any():
            out += self.tree[node]
            node &= node - 1
        for i in range(0, len(at), CUTS):
            part = slice(i, i + CUTS)
            ahead = np.arange(BLOCK_BYTES) < offset[part, None]
            for kind, mark in enumerate(self.marks):
                out[part, kind] += (mark[block[part]] * ahead).sum(1, dtype=np.int64)
        return out

    def places(self, order: np.ndarray) -> np.ndarray:
        """The byte of each mark of the first kind, counted from 1."""
        block = np.zeros(len(order), np.int64)
        left = order.astype(np.int64)
        step = 1 << (self.blocks.bit_length() - 1)
        while step:
            to = block + step
            inside = self.tree[np.minimum(to, self.blocks), 0]
            go = (to <= self.blocks) & (inside < left)
            block, left = np.where(go, to, block), np.where(go, left - inside, left)
            step >>= 1
        offset = np.empty(len(order), np.int64)
        for i in range(0, len(order), CUTS):
            part = slice(i, i + CUTS)
            upto = np.cumsum(self.marks[0][block[part]], axis=1, dtype=np.int32)
            offset[part] = (upto < left[part, None]).sum(1)
        return block * BLOCK_BYTES + offset


def unit_marks(texts: pa.Array, data: np.ndarray, bounds: np.ndarray, pattern: str | None
               ) -> tuple[np.ndarray, np.ndarray]:
    """1 where a unit begins, 1 where a code point begins, over all bytes of a slice."""
    points = ((data & 0xC0) != 0x80).view(np.uint8)
    if pattern is None:
        return points, points
    units, found = np.zeros(len(data), np.uint8), re.compile(pattern)
    for i, text in enumerate(texts.to_pylist()):
        begins = [m.start() for m in found.finditer(text) if m.end() > m.start()]
        if begins:
            here = np.flatnonzero(points[bounds[i]:bounds[i + 1]])
            units[bounds[i] + here[begins]] = 1
    return units, points


def cut_slice(texts: pa.Array, h: list[np.ndarray], pattern: str | None, rate: int, spm_rate: int
              ) -> list[pa.Array]:
    """The columns of RESULT for texts without nulls and four numbers of each."""
    n_rows = len(texts)
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n_rows + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[bounds[0]:bounds[-1]] if raw else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    tree = Fenwick(*unit_marks(texts, data, bounds, pattern))
    before = tree.counts(bounds)
    n = np.diff(before[:, 0])
    plain = (np.diff(bounds) == 0) | (h[2] % 100 >= rate)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
    spm = ~plain & (h[3] % 100 < spm_rate)
    cut = np.flatnonzero(~plain)
    starts, ends = bounds[cut], bounds[cut + 1]

    def place(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The byte of each text's cut, and the code points of the text before it."""
        at = np.where(k == 0, starts, ends)
        inner = (k > 0) & (k < n[cut])
        at[inner] = tree.places(before[cut[inner], 0] + k[inner] + 1)
        return at, tree.counts(at)[:, 1] - before[cut, 1]

    ones = h[0][cut] % (n[cut] + 1), h[1][cut] % (n[cut] + 1)
    (a, a_chars), (b, b_chars) = place(np.minimum(*ones)), place(np.maximum(*ones))

    view = data.tobytes()
    out: list[str | bytes | None] = [None] * n_rows
    for i in np.flatnonzero(plain).tolist():
        out[i] = view[bounds[i]:bounds[i + 1]]
    p_mark, s_mark, m_mark = PREFIX.encode(), SUFFIX.encode(), MIDDLE.encode()
    for i, s, x, y, e in zip(cut.tolist(), starts.tolist(), a.tolist(), b.tolist(), ends.tolist()):
        prefix, middle, suffix = view[s:x], view[x:y], view[y:e]
        out[i] = b"".join((s_mark, suffix, p_mark, prefix, m_mark, middle) if spm[i]
                          else (p_mark, prefix, s_mark, suffix, m_mark, middle))
    form = np.where(plain, "plain", np.where(spm, "spm", "psm"))
    chars = np.zeros((2, n_rows), np.int64)
    chars[0, cut], chars[1, cut] = a_chars, b_chars - a_chars
    return [pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()),
            pa.array(chars[0], pa.int64(), mask=plain), pa.array(chars[1], pa.int64(), mask=plain),
            pa.array(out, pa.binary()).cast(pa.string())]


def id_numbers(id_col: Column, salt: str) -> list[Column]:
    """The first four groups of eight hex digits of the hash of an id, as numbers."""
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(id_col.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   pattern: str | None = None, rate: int = RATE, spm_rate: int = SPM_RATE,
                   salt: str = "1:") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output) of every row.

    ``pattern`` gives the units; without one they are code points. ``rate`` per cent of
    the texts are cut, ``spm_rate`` per cent of these have their suffix first.
    """
    numbers = [c.alias(f"h{i}") for i, c in enumerate(id_numbers(F.col(id_col), salt))]
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            texts = part.column("text").fill_null("").cast(pa.large_string())
            h = [part.column(f"h{i}").to_numpy() for i in range(4)]
            columns = cut_slice(texts, h, pattern, rate, spm_rate)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *columns],
                ["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["id"].dataType.simpleString()
    return arrow_map(rows, run, f"id {kind}, {RESULT}").withColumnRenamed("id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of.

    The text of a cut document holds no sentinel, and none can arise where a part meets
    a sentinel, because each begins with the only ``<`` it has.
    """
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output) \
        .when(form == "psm", F.concat(parts[1], parts[3], parts[2])) \
        .otherwise(F.concat(parts[2], parts[3], parts[1]))


def digests(cut: DataFrame) -> DataFrame:
    """Hashes of the outputs and of the texts rebuilt from them, in place of the outputs."""
    def sha(col: Column) -> Column:
        return F.sha2(F.encode(col, "utf-8"), 256)

    return cut.withColumn("output_sha256", sha(F.col("output"))) \
        .withColumn("restored_sha256", sha(restored(F.col("output"), F.col("form")))) \
        .drop("output")
