"""Quality rules: isolation forests on rule statistics, calibrated from labelled rows.

Every text gets a few counts (words, their characters, symbols, repeated lines, words in
repeated five-word windows). Two plain rules come first. For the rest, isolation
forests measure how few random splits tell a document from a sample: one forest for
each statistic and one for all of them. A forest's threshold is calibrated from
labelled rows; a forest that does not tell good from bad there rejects nothing. So
without labels only the plain rules reject.

The forests are fitted on at most ``SAMPLE`` labelled rows, chosen by a hash of the id.
Statistics, calibration and verdicts cover every row.

Defined results: a null or empty text has no words and fails the plain rules. Rows are
independent: repeated rows get the same verdict, null ids are judged but have no label,
an id with several labels counts as bad if one of them is. Labels with a null id or
quality are left out. Other columns pass through ``kept_documents`` whatever their
names. An empty table gives an empty result. Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from mnemograph.llm.common import arrow_map, stage, text_slices

SLICE_BYTES = 2 << 20       # of text that a task holds at a time
LEAST_WORDS = 10
REPEATED_PERCENT = 20
WINDOW = 5
SYMBOLS = r"[#*$%&|<>]"

SAMPLE = 16_384          # labelled rows, at most, that the forests are fitted on
TREES, TREE_ROWS = 32, 256
GRID = 2000              # steps of a score in the calibration
FALSE_COST = 10.0        # a good document lost weighs as much as so many bad ones kept

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in the text."""
    n, texts = len(codes), len(bounds) - 1
    out = np.zeros(texts, np.int64)
    if n < WINDOW:
        return out
    owner = np.repeat(np.arange(texts), np.diff(bounds))
    key = mixed(owner[:n - WINDOW + 1].astype(np.uint64) + np.uint64(1))
    for i in range(WINDOW):
        key = mixed(key + codes[i:n - WINDOW + 1 + i].astype(np.uint64)
                    + np.uint64(0x9E3779B97F4A7C15))
    starts = np.flatnonzero(owner[:n - WINDOW + 1] == owner[WINDOW - 1:])
    key = key[starts]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = starts[order[twice]]
    edge = np.zeros(n + WINDOW, np.int64)
    np.add.at(edge, found, 1)
    np.add.at(edge, found + WINDOW, -1)
    inside = np.cumsum(edge)[:n] > 0
    return np.bincount(owner[inside], minlength=texts).astype(np.int64)


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """The counts of every text of a slice without nulls."""
    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    flat = split.flatten().dictionary_encode()
    bounds = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    codes = flat.indices.to_numpy()
    sizes = pc.utf8_length(flat.dictionary).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(texts)), np.diff(bounds))
    real = sizes[codes] > 0 if len(codes) else np.zeros(0, bool)
    words = np.bincount(owner[real], minlength=len(texts))
    chars = np.bincount(owner, sizes[codes] if len(codes) else None, len(texts))
    lines = pc.split_pattern(texts, "\n")
    coded = lines.flatten().dictionary_encode()
    full = pc.binary_length(pc.ascii_trim_whitespace(coded.dictionary)).to_numpy(
        zero_copy_only=False) > 0
    line_of = np.repeat(np.arange(len(texts)), np.diff(lines.offsets.to_numpy()))
    code = coded.indices.to_numpy()
    line_of, code = line_of[full[code]], code[full[code]].astype(np.int64)
    key = np.sort(line_of * (len(coded.dictionary) + 1) + code)
    key = key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key
    n_lines = np.bincount(line_of, minlength=len(texts))
    kinds = np.bincount(key // (len(coded.dictionary) + 1), minlength=len(texts))
    symbols = pc.count_substring_regex(texts, SYMBOLS).to_numpy(zero_copy_only=False)
    return {"n_words": words.astype(np.int64), "word_chars": chars.astype(np.int64),
            "n_symbols": symbols.astype(np.int64),
            "n_dup_lines": (n_lines - kinds).astype(np.int64),
            "n_repeat_words": repeated_words(codes, bounds)}


def base_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < LEAST_WORDS) | (
        100 * s["n_repeat_words"] > REPEATED_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    """What the forests see: the counts per word, which do not grow with a text."""
    words = np.maximum(s["n_words"], 1).astype(np.float64)
    return np.column_stack([s["word_chars"] / words, s["n_symbols"] / words,
                            s["n_dup_lines"] / words, s["n_repeat_words"] / words])


FEATURES = 4
FORESTS = [[i] for i in range(FEATURES)] + [list(range(FEATURES))]


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean path of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, np.float64)
    big = 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1)
    return np.where(n > 2, big, np.where(n == 2, 1.0, 0.0))


@dataclass
class Tree:
    """Nodes as arrays; a leaf is its own child and holds the path to it."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    right: np.ndarray
    path: np.ndarray
    depth: int

    @classmethod
    def grown(cls, rows: np.ndarray, rng: np.random.Generator) -> "Tree":
        limit = math.ceil(math.log2(max(len(rows), 2)))
        nodes: list[list[float]] = []

        def grow(part: np.ndarray, depth: int) -> int:
            me = len(nodes)
            nodes.append([0, np.inf, me, me, depth + float(expected_path(len(part)))])
            low, high = part.min(axis=0), part.max(axis=0)
            wide = np.flatnonzero(high > low)
            if depth < limit and len(part) > 1 and len(wide):
                f = int(rng.choice(wide))
                at = rng.uniform(low[f], high[f])
                below = part[:, f] <= at
                if below.all():
                    at, below = low[f], part[:, f] <= low[f]
                left, right = grow(part[below], depth + 1), grow(part[~below], depth + 1)
                nodes[me] = [f, at, left, right, 0]
            return me

        grow(rows, 0)
        a = np.array(nodes)
        return cls(a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int),
                   a[:, 4], limit)

    def paths(self, x: np.ndarray) -> np.ndarray:
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        for _ in range(self.depth + 1):
            at = np.where(x[rows, self.feature[at]] <= self.split[at], self.left[at],
                          self.right[at])
        return self.path[at]


@dataclass
class Forest:
    columns: list[int]
    trees: list[Tree]
    rows: int

    @classmethod
    def fitted(cls, x: np.ndarray, columns: list[int], seed: int) -> "Forest":
        rng = np.random.default_rng(seed)
        size = min(TREE_ROWS, len(x))
        return cls(columns, [Tree.grown(x[rng.choice(len(x), size, replace=False)][:, columns], rng)
                             for _ in range(TREES)], size)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1; the shorter the paths, the higher."""
        mean = sum(t.paths(x[:, self.columns]) for t in self.trees) / len(self.trees)
        return 2.0 ** (-mean / max(float(expected_path(self.rows)), 1e-9))


@dataclass
class Model:
    forests: list[Forest]
    thresholds: list[float]

    def scores(self, s: dict[str, np.ndarray]) -> np.ndarray:
        x = features(s)
        return np.column_stack([f.scores(x) for f in self.forests]) if self.forests \
            else np.zeros((len(x), 0))

    def kept(self, s: dict[str, np.ndarray], scores: np.ndarray) -> np.ndarray:
        return ~base_failed(s) & (scores < np.array(self.thresholds)).all(axis=1)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, counts) of every row."""
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, "text", SLICE_BYTES):
            found = statistics(part.column("text").fill_null(""))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *[pa.array(found[c]) for c in COUNTS]], ["id", *COUNTS])

    kind = pairs.schema["id"].dataType.simpleString()
    return arrow_map(pairs, run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)) \
        .withColumnRenamed("id", id_col)


def _counts(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {c: batch.column(c).to_numpy(zero_copy_only=False) for c in COUNTS}


def fit(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id",
        quality_col: str = "quality") -> Model:
    """Forests and thresholds from the statistics of labelled rows (``stats`` is stored)."""
    marks = labels.where(F.col(id_col).isNotNull() & F.col(quality_col).isNotNull()) \
        .groupBy(F.col(id_col).alias("label_id")).agg(F.min(quality_col).alias("good"))
    known = stats.join(marks, F.col(id_col) == F.col("label_id")) \
        .select(F.col("label_id"), F.col("good").cast("bigint").alias("good"), *COUNTS) \
        .where((F.col("n_words") >= LEAST_WORDS) & (
            100 * F.col("n_repeat_words") <= REPEATED_PERCENT * F.col("n_words"))).distinct()
    known = stage(known, "labelled-statistics")
    n = known.count()
    if not n:
        return Model([], [])
    share = min(1.0, 0.9 * SAMPLE / n)
    chosen = known.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1) \
        .orderBy(F.xxhash64("label_id"), *COUNTS).limit(SAMPLE).select(*COUNTS).toPandas()
    sample = features({c: chosen[c].to_numpy() for c in COUNTS})
    if len(sample) < 2:
        return Model([], [])
    forests = [Forest.fitted(sample, columns, seed) for seed, columns in enumerate(FORESTS)]
    model = Model(forests, [2.0] * len(forests))
    # The forest that pays most first; the next ones see only what is still kept.
    open_forests = set(range(len(forests)))
    while open_forests:
        table = _score_table(known, model)
        found = {i: calibrated([r for r in table if r[0] == i]) for i in open_forests}
        best = max(found, key=lambda i: found[i][1])
        if found[best][1] <= 0:
            break
        model.thresholds[best] = found[best][0]
        open_forests.remove(best)
    return model


def _score_table(known: DataFrame, model: Model) -> list:
    """(forest, step, good, rows) of the labelled rows kept so far: forests x GRID x 2 at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            s = _counts(part)
            scores = model.scores(s)
            still = model.kept(s, scores)
            steps = np.floor(scores[still] * GRID).astype(np.int64)
            good = part.column("good").filter(pa.array(still))
            for i in range(steps.shape[1]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(steps), i)), pa.array(steps[:, i]), good],
                    ["forest", "step", "good"])

    return arrow_map(known, run, "forest bigint, step bigint, good bigint") \
        .groupBy("forest", "step", (F.col("good") > 0).alias("good")).count().collect()


def calibrated(rows: list) -> tuple[float, float]:
    """The score from which on a forest had best reject, and what that gains."""
    good, bad = np.zeros(GRID + 2), np.zeros(GRID + 2)
    for _, step, is_good, n in rows:
        (good if is_good else bad)[min(max(step, 0), GRID + 1)] += n
    if not bad.sum():
        return 2.0, 0.0
    caught, lost = bad[::-1].cumsum()[::-1], good[::-1].cumsum()[::-1]
    gain = caught - FALSE_COST * lost
    best = int(np.argmax(gain))
    # The middle of the gap down to the next good rows, so that bad rows like the
    # labelled ones fall on the right side.
    below = best
    while below > 0 and not good[below - 1] and not bad[below - 1]:
        below -= 1
    return (best + below) / 2 / GRID, float(gain[best])


def judged(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """``stats`` with base_failed, kept and the score of the forest of all statistics."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            s = _counts(part)
            scores = model.scores(s)
            last = scores[:, -1] if scores.shape[1] else np.zeros(len(scores))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(base_failed(s)), pa.array(model.kept(s, scores)),
                 pa.array(last)], [*part.schema.names, "base_failed", "kept", "anomaly"])

    plain = stats.select(id_col, *COUNTS)
    kind = plain.schema[id_col].dataType.simpleString()
    return arrow_map(plain, run, f"`{id_col}` {kind}, " + ", ".join(f"{c} bigint" for c in COUNTS)
                     + ", base_failed boolean, kept boolean, anomaly double")


def kept_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, text_col, SLICE_BYTES):
            s = statistics(part.column(text_col).fill_null(""))
            yield part.filter(pa.array(model.kept(s, model.scores(s))))

    return arrow_map(docs, run, docs.schema)


def fitted(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """Stored statistics of ``docs`` and the model calibrated on them."""
    stats = stage(rule_statistics(docs), "rule-statistics")
    return stats, fit(stats, labels)
