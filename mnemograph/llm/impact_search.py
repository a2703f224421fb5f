"""Exact top-k inner products over an impact-ordered index, score at a time.

Vectors are cut into blocks by a hash. Within a block each component's values are
quantised to impacts, and the members of one impact of one component form a posting
segment. A query visits the segments of a block in descending order of what they can
add to a score, whatever their component. After each batch of segments every member has
a lower and an upper bound; the query stops only when the k-th best lower bound proves
that few members can still be in the result, and scores these exactly. So no result
depends on where it stopped.

Queries come in blocks as well, and each pair of blocks is one task's work; results of
blocks are merged by a window that prunes before its shuffle.

Defined results: vectors that are null or hold a null or non-finite component take no
part, as query or candidate. Only vectors with as many components meet. Components
saturate at 2^40. Rows that repeat an id are rows of their own: each
is a query, with its own ranks, and a candidate for the others. An empty table gives no rows. Columns with other names are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from mnemograph.llm.common import stage

BLOCK_ROWS = 2048       # vectors of a block of the index
QUERY_ROWS = 8192       # queries of a block
STEP = 16               # width of a quantised impact
STOPS = (0.5, 0.7, 0.8, 0.88, 0.94, 1.0)   # shares of a block's postings after which to try a proof
FEW = 0.05              # share of members that is worth scoring exactly
MOST = float(1 << 40)

INDEX = ("dims int, block bigint, dim int, impacts array<bigint>, ends array<int>, "
         "members binary, vec_ids array<bigint>, rows array<bigint>, exact binary")


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
              scale: int = 1024) -> DataFrame:
    """(id, q): floor(scale * x) of each component x of every valid vector."""
    double = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    valid = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    fixed = F.transform("v", lambda x: F.floor(
        F.least(F.greatest(x * scale, F.lit(-MOST)), F.lit(MOST))))
    return vectors.select(F.col(id_col).alias("id"), double.alias("v")) \
        .where(F.col("v").isNotNull() & F.col("id").isNotNull() & valid) \
        .select("id", fixed.alias("q"))


def numbered(vectors: DataFrame) -> DataFrame:
    """Vectors with a ``row`` of their own, written once so that it never changes."""
    return stage(vectors.withColumn("row", F.monotonically_increasing_id()), "vectors")


def blocks_of(rows: int, size: int) -> int:
    return max(1, -(-rows // size))


def build_index(vectors: DataFrame) -> DataFrame:
    """Rows of a block: one with its exact vectors, and one for each component."""
    n = blocks_of(vectors.count(), BLOCK_ROWS)
    keyed = vectors.withColumn("dims", F.size("q")).withColumn(
        "block", F.pmod(F.xxhash64("row"), F.lit(n)))
    return keyed.groupBy("dims", "block").applyInPandas(index_block, INDEX)


def index_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    dims, block = key
    rows = rows.sort_values("id", kind="stable")
    exact = np.array(rows["q"].tolist(), dtype=np.int64).reshape(len(rows), dims)
    out = [(dims, block, -1, None, None, None, rows["id"].tolist(), rows["row"].tolist(),
            exact.tobytes())]
    for d in range(dims):
        impact = exact[:, d] // STEP
        members = np.argsort(-impact, kind="stable").astype(np.int32)
        impact = impact[members]
        cuts = np.flatnonzero(impact[1:] != impact[:-1]) + 1
        firsts = np.concatenate(([0], cuts))
        out.append((dims, block, d, impact[firsts].tolist(),
                    np.append(cuts, len(impact)).tolist(), members.tobytes(), None, None, None))
    return pd.DataFrame(out, columns=["dims", "block", "dim", "impacts", "ends", "members",
                                      "vec_ids", "rows", "exact"])


class Block:
    """One block of the index in a task."""

    def __init__(self, rows: pd.DataFrame):
        head = rows[rows["dim"] == -1].iloc[0]
        self.ids = np.array(head["vec_ids"], dtype=np.int64)
        self.rows = np.array(head["rows"], dtype=np.int64)
        self.exact = np.frombuffer(head["exact"], dtype=np.int64).reshape(len(self.ids), -1)
        self.n, self.dims = self.exact.shape
        dim, impact, sizes, slots = [], [], [], []
        for _, row in rows[rows["dim"] >= 0].sort_values("dim").iterrows():
            ends = np.array(row["ends"], dtype=np.int64)
            dim.append(np.full(len(ends), row["dim"]))
            impact.append(np.array(row["impacts"], dtype=np.int64))
            sizes.append(np.diff(ends, prepend=0))
            slots.append(np.frombuffer(row["members"], np.int32).astype(np.int64) * self.dims
                         + row["dim"])
        none = np.zeros(0, np.int64)
        self.dim, self.impact, self.sizes, self.slots = (
            np.concatenate(x) if x else none for x in (dim, impact, sizes, slots))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.top = int(np.abs(self.exact).max()) if self.exact.size else 0

    def scores(self, query: np.ndarray, members: np.ndarray) -> np.ndarray:
        return self.exact[members] @ query

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the k best members besides the row ``own``."""
        others = self.rows != own
        safe = self.top * int(np.abs(query).max(initial=0)) * max(1, self.dims) < 1 << 53
        may = self.possible(query, others, k) if safe else others
        members = np.flatnonzero(may)
        if safe:
            score = self.scores(query, members)
        else:       # products beyond 64 bits: Python's numbers, saturated
            big = self.exact[members].astype(object) @ query.astype(object)
            score = np.array([max(min(int(s), (1 << 63) - 1), -(1 << 63)) for s in big], np.int64)
        best = np.lexsort((self.ids[members], -score.astype(object) if not safe else -score))[:k]
        return self.ids[members[best]], score[best]

    def possible(self, query: np.ndarray, others: np.ndarray, k: int) -> np.ndarray:
        """Members that can be among the k best, as far as the visited segments prove."""
        if not self.dims or self.n <= k + 1:
            return others
        weight = query[self.dim].astype(np.float64)
        low, high = weight * (self.impact * STEP), weight * (self.impact * STEP + STEP - 1)
        low, high = np.minimum(low, high), np.maximum(low, high)
        # What a member has at least from a component, before its segment is visited.
        heads = np.concatenate(([0], np.flatnonzero(self.dim[1:] != self.dim[:-1]) + 1))
        floor = np.minimum.reduceat(low, heads)
        order = np.argsort(floor[self.dim] - high, kind="stable")
        done = np.cumsum(self.sizes[order])
        sure = np.full(self.n, floor.sum())
        seen = np.zeros(self.n * self.dims, dtype=bool)
        gain, slack = (low - floor[self.dim])[order], (high - low)[order]
        loose = np.zeros(self.n)
        start = 0
        for share in STOPS:
            stop = int(np.searchsorted(done, share * done[-1])) + 1
            part = order[start:stop]
            sizes = self.sizes[part]
            shift = self.starts[part] - (np.cumsum(sizes) - sizes)
            slots = self.slots[np.repeat(shift, sizes) + np.arange(sizes.sum())]
            seen[slots] = True
            members = slots // self.dims
            sure += np.bincount(members, np.repeat(gain[start:stop], sizes), self.n)
            loose += np.bincount(members, np.repeat(slack[start:stop], sizes), self.n)
            start = stop
            # Of each component, the most that an unvisited segment can add.
            rest = np.zeros(self.dims)
            left = order[start:]
            np.maximum.at(rest, self.dim[left], high[left] - floor[self.dim[left]])
            bound = sure + loose + (~seen.reshape(self.n, self.dims)) @ rest
            proven = np.partition(sure[others], -k)[-k] if others.sum() > k else -np.inf
            may = others & (bound >= proven)
            if may.sum() <= max(2 * k, FEW * self.n):
                return may
        return may


def search(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of every query over all blocks of the index."""
    nq = blocks_of(queries.count(), QUERY_ROWS)
    heads = index.where("dim = -1").select(F.col("dims").alias("to_dims"), F.col("block").alias("to_block"))
    asked = queries.select(F.col("id").alias("query_id"), "row", "q", F.size("q").alias("to_dims")) \
        .withColumn("to_part", F.pmod(F.xxhash64("row"), F.lit(nq)))
    # Every block of queries meets every block of vectors once.
    left = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(nq - 1)).cast("array<bigint>")))
    right = asked.join(heads, "to_dims")

    def meet(key: tuple, block: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(block) and len(asking):
            own = Block(block)
            for qid, row, q in zip(asking["query_id"], asking["row"], asking["q"]):
                ids, scores = own.search(np.array(q, dtype=np.int64), row, k)
                out += [(qid, row, i, s) for i, s in zip(ids.tolist(), scores.tolist())]
        return pd.DataFrame(out, columns=["query_id", "row", "vec_id", "score"]).astype("int64")

    found = left.groupBy("dims", "block", "part").cogroup(
        right.groupBy("to_dims", "to_block", "to_part")).applyInPandas(
        meet, "query_id bigint, row bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(
        Window.partitionBy("row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
