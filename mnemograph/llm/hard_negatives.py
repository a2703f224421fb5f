"""Hard negatives: rows of other labels that score within a window below a positive.

Components are fixed to integers and a score is an inner product, so every result is
exact. Each row is stored with its norm and its angles to a few orthonormal reference
directions (of the mean rows of labels) and to the space that these span. For two rows
the angular triangle inequality in that space gives an interval of their cosine,
``sum cos a_i cos b_i -+ sin a sin b``; with one direction it is ``cos(a + b)`` to
``cos(a - b)``. Multiplied by the norms and widened by more than any rounding error it
bounds the score, and only pairs whose bounds overlap a window that is still open are
scored in integers. Directions change how much is scored, never a result.

Two passes meet anchors and rows in blocks. A task holds one part of the anchors and
reads one span of the rows as a sorted stream, so what it learns in one batch narrows
the windows for the next; its memory is bounded by the part. The first pass looks for
positives and only meets equal labels, the second for negatives. A label or a vector
that many rows share is spread over all spans.

Defined results: a row with a null label or vector, or with a null or non-finite
component, takes no part. A null id is no anchor and comes after other ids in ties.
Only vectors with as many components meet. Rows that repeat an id are rows of their own:
each is an anchor, and each may be the other's positive. Vectors whose scores could pass
2^57 end in an error. An anchor without a positive, and a positive without a row in its
window, give no rows; an empty table gives none. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from mnemograph.llm.common import arrow_map, stage, unstage

DIRECTIONS = 16             # reference directions of a vector length
LENGTHS = 16                # vector lengths that get directions; others do with trivial bounds
PART_ROWS = 1 << 16         # anchors that a task holds
SPAN_ROWS = 1 << 20         # rows of a span, at most
SPANS = 64                  # spans to aim at, as long as they have SPAN_LEAST rows
SPAN_LEAST = 2048
TILE = (512, 1024)          # anchors and rows that are bounded together
DENSE = 0.1                 # share of open pairs from which a tile is one product
SLACK = 1e-6                # of a cosine; rounding errors stay below 1e-7
NONE = -(1 << 63)

ROW = ("id bigint, label bigint, dims int, q array<int>, norm double, angles array<double>, "
       "apart double")


def fixed_rows(vectors: DataFrame, label: Column, id_col: str = "vec_id",
               vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, q) of the rows that take part; q is floor(scale * x), x as double."""
    double = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    valid = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fixed = F.transform("v", lambda x: F.floor(
        F.when(F.abs(x * scale) < 1 << 30, x * scale).otherwise(
            F.raise_error(F.lit("a component is too large for exact scores")).cast("double")))
        .cast("int"))
    return vectors.select(F.col(id_col).cast("bigint").alias("id"),
                          label.cast("bigint").alias("label"), double.alias("v")) \
        .where(F.col("label").isNotNull() & F.col("v").isNotNull() & valid) \
        .select("id", "label", F.size("v").alias("dims"), fixed.alias("q"))


def matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else \
        np.zeros((0, 0))


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims).tolist():
        yield d, batch.filter(pa.array(dims == d))


def directions(rows: DataFrame) -> dict[int, np.ndarray]:
    """Orthonormal directions (columns) of the most frequent vector lengths."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, part in by_length(batch):
                q = matrix(part.column("q"), part.num_rows).astype(np.float64)
                bucket = part.column("label").to_numpy() % DIRECTIONS
                for b in np.unique(bucket).tolist():
                    mine = q[bucket == b]
                    total[d, b] = total.get((d, b), 0) + np.append(mine.sum(0), len(mine))
        if total:
            yield pa.RecordBatch.from_pylist(
                [{"dims": d, "bucket": b, "total": t.tolist()} for (d, b), t in total.items()],
                pa.schema([("dims", pa.int32()), ("bucket", pa.int64()),
                           ("total", pa.list_(pa.float64()))]))

    parts = arrow_map(rows.select("dims", "label", "q"), sums,
                      "dims int, bucket bigint, total array<double>")
    whole = stage(parts.select("dims", "bucket", F.posexplode("total").alias("at", "x"))
                  .groupBy("dims", "bucket", "at").agg(F.sum("x").alias("x")), "direction-sums")
    often = whole.where(F.col("at") == F.col("dims")).groupBy("dims").agg(F.sum("x").alias("n")) \
        .orderBy(F.desc("n"), "dims").limit(LENGTHS)
    found = whole.where(F.col("at") < F.col("dims")).join(F.broadcast(often), "dims") \
        .groupBy("dims", "bucket").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("v"))
    means: dict[int, list] = {}
    for r in found.orderBy("dims", "bucket").collect():      # LENGTHS x DIRECTIONS rows
        means.setdefault(r.dims, []).append([p.x for p in r.v])
    unstage(whole)
    return {d: np.linalg.qr(np.array(m).T)[0] for d, m in means.items() if d}


def angled(rows: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """Adds the norm, the angles to the directions and the angle to their space."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part in by_length(batch):
                q = matrix(part.column("q"), part.num_rows).astype(np.float64)
                norm = np.sqrt((q * q).sum(1))
                cos = np.clip(q / np.maximum(norm, 1)[:, None] @ axes.get(d, np.zeros((d, 0))), -1, 1)
                apart = np.arccos(np.sqrt(np.minimum((cos * cos).sum(1), 1)))
                angles = pa.ListArray.from_arrays(
                    np.arange(part.num_rows + 1, dtype=np.int32) * cos.shape[1],
                    np.arccos(cos).ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in ("id", "label", "dims", "q")),
                     pa.array(norm), angles, pa.array(apart)],
                    ["id", "label", "dims", "q", "norm", "angles", "apart"])
    return arrow_map(rows, run, ROW)


class Side:
    """Rows of one group in a task, with what bounds and scores need."""

    def __init__(self, batch: pa.RecordBatch):
        n = batch.num_rows
        self.n, self.row = n, batch.column("row").to_numpy()
        ids = batch.column("id")
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = ids.fill_null(0).to_numpy()
        self.label, self.norm = batch.column("label").to_numpy(), batch.column("norm").to_numpy()
        self.q = matrix(batch.column("q"), n).astype(np.float64)
        self.cos = np.cos(matrix(batch.column("angles"), n))
        self.sin = np.sin(batch.column("apart").to_numpy())

    def bounds(self, other: "Side", mine: slice, theirs: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and greatest score of each pair of a tile."""
        middle = self.cos[mine] @ other.cos[theirs].T
        slack = np.outer(self.sin[mine], other.sin[theirs]) + SLACK
        norms = np.outer(self.norm[mine], other.norm[theirs])
        return np.ceil(norms * (middle - slack)), np.floor(norms * (middle + slack))

    def scores(self, other: "Side", mine: slice, theirs: slice, open_: np.ndarray
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and exact scores of the open pairs of a tile.

        By Cauchy and Schwarz no partial sum passes the product of the norms, so doubles
        are exact below 2^53; beyond, 64-bit integers are.
        """
        i, j = np.nonzero(open_)
        a, b = self.q[mine], other.q[theirs]
        most = self.norm[mine].max(initial=0) * other.norm[theirs].max(initial=0)
        if most > 1 << 57:
            raise ValueError("vectors are too large for exact scores")
        if most >= 1 << 53:
            found = np.einsum("ij,ij->i", a[i].astype(np.int64), b[j].astype(np.int64))
        elif len(i) > DENSE * open_.size:
            found = (a @ b.T)[i, j]
        else:
            found = np.einsum("ij,ij->i", a[i], b[j])
        return i, j, found.astype(np.int64)


class Best:
    """The k highest scores of each key so far; ties to smaller ids, null ids last."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.score = np.full((keys, k), NONE, np.int64)
        self.id = np.zeros((keys, k), np.int64)
        self.no_id = np.ones((keys, k), bool)

    @property
    def least(self) -> np.ndarray:
        """What a new score must reach."""
        return self.score[:, -1]

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, no_id: np.ndarray) -> None:
        good = score >= self.least[key]
        if not good.any():
            return
        key, score, ids, no_id = key[good], score[good], ids[good], no_id[good]
        touched = np.unique(key)
        key = np.concatenate([np.repeat(touched, self.k), key])
        score = np.concatenate([self.score[touched].ravel(), score])
        ids = np.concatenate([self.id[touched].ravel(), ids])
        no_id = np.concatenate([self.no_id[touched].ravel(), no_id])
        order = np.lexsort((ids, no_id, -score, key))      # -NONE wraps and is no score's
        order = order[np.argsort(score[order] == NONE, kind="stable")]
        order = order[np.argsort(key[order], kind="stable")]
        heads = np.flatnonzero(np.diff(key[order], prepend=touched[0] - 1))
        take = order[(heads[:, None] + np.arange(self.k)).ravel()].reshape(-1, self.k)
        self.score[touched], self.id[touched], self.no_id[touched] = \
            score[take], ids[take], no_id[take]


class Positives:
    """Pass one of a task: the best other rows of the same label."""

    def __init__(self, anchors: pa.RecordBatch, k: int):
        self.anchors = Side(anchors)
        self.best = Best(self.anchors.n, k)

    def meet(self, rows: Side) -> None:
        for mine, theirs in tiles(self.anchors.n, rows.n):
            _, high = self.anchors.bounds(rows, mine, theirs)
            open_ = (high >= self.best.least[mine, None]) \
                & (self.anchors.row[mine, None] != rows.row[theirs])
            i, j, score = self.anchors.scores(rows, mine, theirs, open_)
            self.best.add(i + mine.start, score, rows.id[theirs][j], rows.no_id[theirs][j])

    def found(self) -> pa.RecordBatch:
        key, at = np.nonzero(self.best.score != NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.row[key]),
             pa.array(self.best.id[key, at], mask=self.best.no_id[key, at]),
             pa.array(self.best.score[key, at])], ["row", "other_id", "score"])


class Negatives:
    """Pass two of a task: the best rows of other labels within each positive's window."""

    def __init__(self, anchors: pa.RecordBatch, k: int):
        self.anchors = Side(anchors)
        scores = anchors.column("scores")
        sizes = np.diff(scores.offsets.to_numpy())
        self.width = int(sizes.max(initial=1))
        self.low = np.ones((self.anchors.n, self.width), np.int64)
        self.high = np.zeros_like(self.low)
        i = np.repeat(np.arange(len(sizes)), sizes)
        w = np.arange(len(i)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        score = scores.flatten().to_numpy()
        self.low[i, w], self.high[i, w] = -(-score // 2), 19 * score // 20
        self.best = Best(self.low.size, k)

    def meet(self, rows: Side) -> None:
        for mine, theirs in tiles(self.anchors.n, rows.n):
            low, high = self.anchors.bounds(rows, mine, theirs)
            other = self.anchors.label[mine, None] != rows.label[theirs]
            least = self.best.least.reshape(-1, self.width)[mine]
            open_ = np.zeros_like(other)
            for w in range(self.width):
                first, last = self.low[mine, w, None], self.high[mine, w, None]
                open_ |= (first <= last) & (low <= last) & \
                    (high >= np.maximum(first, least[:, w, None]))
            i, j, score = self.anchors.scores(rows, mine, theirs, open_ & other)
            i += mine.start
            for w in range(self.width):
                inside = (score >= self.low[i, w]) & (score <= self.high[i, w])
                self.best.add(i[inside] * self.width + w, score[inside],
                              rows.id[theirs][j[inside]], rows.no_id[theirs][j[inside]])

    def found(self) -> pa.RecordBatch:
        key, at = np.nonzero(self.best.score != NONE)
        return pa.RecordBatch.from_arrays(
            [pa.array(self.anchors.row[key // self.width]),
             pa.array((key % self.width).astype(np.int32)),
             pa.array(self.best.id[key, at], mask=self.best.no_id[key, at]),
             pa.array(self.best.score[key, at])], ["row", "at", "other_id", "score"])


def tiles(anchors: int, rows: int) -> Iterator[tuple[slice, slice]]:
    for j in range(0, rows, TILE[1]):
        for i in range(0, anchors, TILE[0]):
            yield slice(i, min(i + TILE[0], anchors)), slice(j, min(j + TILE[1], rows))


def meeting(anchors: DataFrame, rows: DataFrame, keys: list[str], parts: int, spans: int,
            kind: type, k: int, schema: str) -> DataFrame:
    """Every part of the anchors meets every span of the rows that has equal ``keys``."""
    def numbers(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    extra = [c for c in anchors.columns if c not in rows.columns]
    left = anchors.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")) \
        .withColumn("span", numbers(spans)).withColumn("role", F.lit(0))
    right = rows.withColumn("span", F.pmod(F.xxhash64("row"), F.lit(spans)).cast("int")) \
        .withColumn("part", numbers(parts)).withColumn("role", F.lit(1))
    both = left.unionByName(right, allowMissingColumns=True) \
        .withColumn("group", F.concat_ws(" ", *keys, "part", "span"))
    stream = both.repartition("group").sortWithinPartitions("group", "role") \
        .select("group", "role", "row", "id", "label", "q", "norm", "angles", "apart", *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held, task = None, [], None
        for batch in batches:
            names = batch.column("group").to_pylist()
            roles = batch.column("role").to_numpy()
            cuts = [i for i in range(1, len(names))
                    if names[i] != names[i - 1] or roles[i] != roles[i - 1]]
            for a, b in zip([0, *cuts], [*cuts, len(names)]):
                if a == b:
                    continue
                if names[a] != group:
                    if task is not None:
                        yield task.found()
                    group, held, task = names[a], [], None
                if roles[a] == 0:
                    held.append(batch.slice(a, b - a))
                elif held or task is not None:
                    if task is None:
                        task, held = kind(pa.concat_batches(held), k), []
                    task.meet(Side(batch.slice(a, b - a)))
        if task is not None:
            yield task.found()

    return arrow_map(stream, run, schema)


def mined(rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` as :func:`fixed_rows` gives them.

    Columns: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    # Written once: the row numbers must not change when a task runs again.
    fixed = stage(rows, "negatives-fixed")
    table = stage(angled(fixed, directions(fixed)).withColumn("row", F.monotonically_increasing_id()),
                  "negatives-rows")
    unstage(fixed)
    asking = table.where(anchor)
    n, n_asking = table.count(), asking.count()
    parts = max(1, -(-n_asking // PART_ROWS))
    spans = max(1, -(-n // SPAN_ROWS), min(SPANS, -(-n // SPAN_LEAST)))

    near = meeting(asking, table, ["dims", "label"], parts, spans, Positives, positives,
                   "row bigint, other_id bigint, score bigint")
    at = F.row_number().over(Window.partitionBy("row").orderBy(
        F.desc("score"), F.asc_nulls_last("other_id")))
    near = stage(near.withColumn("at", at - 1).where(F.col("at") < positives), "positives")
    windows = near.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "score"))).alias("p")) \
        .select("row", F.col("p.score").alias("scores"))

    hard = meeting(asking.join(windows, "row"), table, ["dims"], parts, spans, Negatives, negatives,
                   "row bigint, at int, other_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("row", "at").orderBy(
        F.desc("score"), F.asc_nulls_last("other_id")))
    hard = hard.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return hard.select("row", "at", "rank", F.col("other_id").alias("negative_id"),
                       F.col("score").alias("negative_score")) \
        .join(near.select("row", "at", F.col("other_id").alias("positive_id"),
                          F.col("score").alias("positive_score")), ["row", "at"]) \
        .join(asking.select("row", F.col("id").alias("anchor_id")), "row") \
        .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
