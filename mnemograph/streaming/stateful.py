"""Views of a growing log that keep state per key, on ``transformWithStateInPandas`` or plain aggregations.

State lies in RocksDB under the checkpoint, so a restarted or moved task finds it
there, and a batch reads and writes the keys it touches only. The newest rows of a session,
which no plain aggregation keeps, lie in a table beside the checkpoint. Rows may come in any
order of their positions: every result is that of the whole log so far.

Rows are narrowed, and where possible combined, before the shuffle. What is left of a
key passes its task as Arrow batches; no batch is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions import text as X
from mnemograph.functions.scoring import truthy
from mnemograph.operators import log_ops
from mnemograph.streaming.incremental import batch_sink, newest, run

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

# Executions a score is computed from. What lies before them weighs .75^200 < 1e-24.
RECENT = 200
# Executions before their procedure is first learned wait in blocks of this many positions.
EARLY_BITS = 16
# Every so many batches, the table of newest rows holds every session again.
WHOLE = 8
HORIZON_MS = int(P.DORMANT_DAYS * 86_400_000)


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started here keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, before)


def run_stateful(rows: DataFrame, key: str, processor: StatefulProcessor, ddl: str, out: str,
                 checkpoint: str, time_mode: str = "none") -> None:
    """Run a processor on what has arrived; each batch writes the keys it touched."""
    with rocksdb(rows.sparkSession):
        touched = rows.groupBy(key).transformWithStateInPandas(processor, ddl, "update", time_mode)
        run(touched, checkpoint, batch_sink(out), "update")


# -- procedures ---------------------------------------------------------------------

_HEAD = {
    "first": "bigint", "mark": "bigint", "retired": "boolean", "learned": "bigint",
    "score": "double", "score_at": "bigint", "promised": "double", "promised_at": "bigint",
    "seed_t": "string", "seed_t_at": "bigint", "run_t": "string", "run_t_at": "bigint",
    "total": "bigint", "uses": "bigint", "first_use": "bigint",
    "recent": "array<bigint>", "targets": "array<double>",
}
_BLANK = {**dict.fromkeys(_HEAD), "retired": False, "learned": 0, "total": 0, "uses": 0,
          "recent": [], "targets": []}


def _extreme(head: dict, name: str, frame: pd.DataFrame, column: str, last: bool = True) -> None:
    """Keep the value of ``column`` at the highest (or lowest) position seen so far."""
    filled = frame[frame[column].notna()]
    if filled.empty:
        return
    row = filled.loc[filled["seq"].idxmax() if last else filled["seq"].idxmin()]
    seq, held = int(row["seq"]), head[f"{name}_at"]
    if held is None or (seq > held if last else seq < held):
        value = row[column]
        head[name], head[f"{name}_at"] = (value if isinstance(value, str) else float(value)), seq


class ProcedureScores(StatefulProcessor):
    """The procedure fold: first learning, newest explicit score, executions since.

    A score is folded from the newest executions alone, so late ones find their place
    among them and older ones change nothing but the count. Executions that precede
    the first learning wait as positions, because a learning that comes late, from
    before them, makes them count.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", ", ".join(f"`{n}` {k}" for n, k in _HEAD.items()))
        self.early = handle.getMapState("early", "block bigint", "seqs array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.head.get()
        head = dict(zip(_HEAD, held)) if held is not None else dict(_BLANK)
        for frame in rows:
            self._marks(head, frame[frame["what"] != "run"])
            self._runs(head, frame[frame["what"] == "run"])
        self.head.update(tuple(head.values()))
        yield self._row(key[0], head)

    def _marks(self, head: dict, marks: pd.DataFrame) -> None:
        if marks.empty:
            return
        last = marks.loc[marks["seq"].idxmax()]
        if head["mark"] is None or last["seq"] > head["mark"]:
            head["mark"], head["retired"] = int(last["seq"]), last["what"] == "retired"
        seeds = marks[marks["what"] != "retired"]
        if seeds.empty:
            return
        head["learned"] += int(seeds["learned"].sum())
        _extreme(head, "score", seeds, "score")
        _extreme(head, "promised", seeds, "promised", last=False)
        _extreme(head, "seed_t", seeds, "t")
        first = int(seeds["seq"].min())
        if head["first"] is None or first < head["first"]:
            head["first"] = first
            for (block,) in [k for k in self.early.keys() if k[0] >= first >> EARLY_BITS]:
                seqs = np.array(self.early.getValue((block,))[0], dtype=np.int64)
                self._count(head, seqs[seqs > first])
                if (seqs > first).all():
                    self.early.removeKey((block,))
                else:
                    self.early.updateValue((block,), (seqs[seqs < first].tolist(),))

    def _runs(self, head: dict, runs: pd.DataFrame) -> None:
        if runs.empty:
            return
        seqs = runs["seq"].to_numpy(np.int64)
        head["total"] += len(seqs)
        _extreme(head, "run_t", runs, "t")
        recent = np.concatenate([np.array(head["recent"], dtype=np.int64), seqs])
        targets = np.concatenate([np.array(head["targets"], dtype=float),
                                  runs["target"].to_numpy(float)])
        order = np.argsort(recent, kind="stable")[-RECENT:]
        head["recent"], head["targets"] = recent[order].tolist(), targets[order].tolist()
        first = head["first"]
        waiting = seqs if first is None else seqs[seqs < first]
        for block in np.unique(waiting >> EARLY_BITS).tolist():
            held = self.early.getValue((block,)) if self.early.containsKey((block,)) else ([],)
            more = waiting[waiting >> EARLY_BITS == block].tolist()
            self.early.updateValue((block,), (list(held[0]) + more,))
        if first is not None:
            self._count(head, seqs[seqs > first])

    @staticmethod
    def _count(head: dict, seqs: np.ndarray) -> None:
        if len(seqs):
            head["uses"] += len(seqs)
            low = int(seqs.min())
            head["first_use"] = low if head["first_use"] is None else min(low, head["first_use"])

    @staticmethod
    def _row(key: str, head: dict) -> pd.DataFrame:
        rate = P.PROC_LEARN_RATE
        plain = 0.5
        for target in head["targets"]:
            plain += rate * (target - plain)
        start = head["score"]
        if start is None and head["promised_at"] is not None and (
                head["first_use"] is None or head["promised_at"] < head["first_use"]):
            start = head["promised"]
        score = start
        if head["first"] is not None:
            since = max(head["first"], head["score_at"] or 0)
            counted = [t for s, t in zip(head["recent"], head["targets"]) if s > since]
            if counted:
                # With more executions than are kept, the start weighs nothing any more.
                score = 0.5 if start is None or len(counted) == RECENT else start
            for i, target in enumerate(counted):
                score += rate * (target - score)
                score = min(1.0, max(0.0, score)) if i == 0 else score
        run_last = head["run_t_at"] is not None and head["first"] is not None and (
            head["run_t_at"] > max(head["first"], head["seed_t_at"] or 0))
        return pd.DataFrame({
            "procedure_id": [key], "live": [head["first"] is not None and not head["retired"]],
            "score": pd.array([score], dtype="Float64"),
            "uses": [head["learned"] + head["uses"]],
            "last_used_t": [head["run_t"] if run_last else head["seed_t"]],
            "run_score": [plain], "runs": [head["total"]]})


def learn_procedures(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Scores and uses of procedures, brought up to date by every batch."""
    ty = F.col("type")
    seed = ty.isin("procedure_learned", "pattern_promoted")
    rows = stream.filter(seed | ty.isin("proc_executed", "procedure_retired")).select(
        F.coalesce(truthy(F.col("procedure_id")), truthy(F.col("id"))).alias("procedure_id"),
        "seq",
        F.when(seed, "seed").when(ty == "proc_executed", "run").otherwise("retired").alias("what"),
        ((ty == "procedure_learned") & (F.coalesce("part", F.lit(0)) == 0)).cast("int")
        .alias("learned"),
        F.col("outcome_score").alias("score"),
        F.when(ty == "pattern_promoted", F.col("confidence")).alias("promised"),
        F.when(F.lower(F.coalesce("outcome", F.lit("success"))).isin(P.FAILED_OUTCOMES), 0.0)
        .otherwise(1.0).alias("target"),
        truthy(F.col("t")).alias("t")).filter(F.col("procedure_id").isNotNull())
    run_stateful(rows, "procedure_id", ProcedureScores(),
                 "procedure_id string, live boolean, score double, uses bigint, "
                 "last_used_t string, run_score double, runs bigint", out, checkpoint)


def learned_procedures(spark: SparkSession, out: str) -> DataFrame:
    """What ``folds.procedures`` says of the same log: live procedures, score, uses, last use."""
    fallback = S.rounded(F.least(F.lit(0.9), 0.5 + 0.1 * (F.col("uses") - 1)))
    return newest(spark, out, "procedure_id").filter("live").select(
        "procedure_id", F.coalesce("score", fallback).alias("outcome_score"), "uses",
        "last_used_t")


def learned_scores(spark: SparkSession, out: str) -> DataFrame:
    """Score and number of all executions of a procedure, whether it was learned or not."""
    return newest(spark, out, "procedure_id").filter(F.col("runs") > 0).select(
        "procedure_id", F.col("run_score").alias("score"), F.col("runs").alias("uses"))


# -- threads ------------------------------------------------------------------------

def _marked(out: str, parts: str):
    """Writes a batch: the threads it touched, and untouched ones whose time is up now.

    The row without a thread holds the clock, the newest event time so far.
    """
    def each(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{parts}/batch={batch}")    # leaves the state once
        rows = spark.read.parquet(f"{parts}/batch={batch}")
        clock = rows.where(F.col("thread_id").isNull()).agg(F.max("last_ms")).scalar()
        late = F.coalesce(F.col("last_ms") + F.lit(HORIZON_MS + 1) <= clock, F.lit(False))
        touched = rows.where(F.col("thread_id").isNotNull()).select(
            "thread_id", "n_events", "last_ms", F.when(late, "dormant").otherwise("active").alias("status"))
        done = [b for b in _batches(spark, out) if b < batch]
        if done:
            known = newest(spark, out, "thread_id", done)
            expired = known.where((F.col("status") == "active") & late).join(
                touched.select("thread_id"), "thread_id", "left_anti")
            touched = touched.unionByName(expired.withColumn("status", F.lit("dormant")))
        touched.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    return each


def _batches(spark: SparkSession, out: str) -> list[int]:
    """Numbers of the batches written so far."""
    home = spark._jvm.org.apache.hadoop.fs.Path(out)
    fs = home.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(home)] if fs.exists(home) else []
    return [int(n.split("=")[1]) for n in names if n.startswith("batch=")]


def watch_threads(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Members and status of threads by the log's own clock, in whole milliseconds.

    Counts and last times are a plain aggregation, combined before the shuffle, so that no
    thread costs a call of Python. The clock is the newest event time so far: it marks
    threads dormant when their time is up. Late events are counted; one that is newer than
    its thread's last wakes the thread.
    """
    ids = F.array_compact(F.array_distinct(F.coalesce("thread_ids", F.array().cast("array<string>"))))
    # Every event also counts for the row without a thread, which is the clock.
    rows = stream.select(F.unix_millis("ts").alias("last_ms"), F.explode(
        F.concat(F.array(F.lit(None).cast("string")), ids)).alias("thread_id"))
    counts = rows.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_events"), F.max("last_ms").alias("last_ms"))
    with rocksdb(stream.sparkSession):
        run(counts, checkpoint, _marked(out, f"{checkpoint}-touched"), "update")


# -- drift --------------------------------------------------------------------------

def _held(df: DataFrame, kept: str, batch: int, most: int) -> DataFrame:
    """The newest rows of the sessions a batch touched, brought up to date in a table of versions.

    A version holds all rows a session needs, so the last one counts. Every ``WHOLE``
    batches the table holds all sessions, and no older version is read again.
    """
    spark = df.sparkSession
    session = Window.partitionBy("session")
    place = F.row_number().over(session.orderBy(F.desc("seq")))
    arrived = f"{kept}-new/batch={batch}"       # tokenized once; Spark cuts at the rank before the shuffle
    df.withColumn("place", place).filter(F.col("place") <= most).drop("place").write.mode("overwrite").parquet(arrived)
    rows = spark.read.parquet(arrived).withColumn("batch", F.lit(batch))
    done = [b for b in _batches(spark, kept) if b < batch]
    whole = max([b for b in done if b % WHOLE == WHOLE - 1], default=0)
    done = [b for b in done if b >= whole]
    if done:
        known = spark.read.option("basePath", kept).parquet(*[f"{kept}/batch={b}" for b in done])
        if batch % WHOLE != WHOLE - 1:
            known = known.join(rows.select("session").distinct(), "session", "left_semi")
        rows = known.select(*rows.columns).unionByName(rows)
    is_new = F.col("batch") == batch
    last = F.max(F.when(~is_new, F.col("batch"))).over(session)
    (rows.withColumn("last", last).withColumn("touched", F.max(is_new).over(session))
     .filter(is_new | (F.col("batch") == F.col("last")))
     .withColumn("place", place).filter(F.col("place") <= most)
     .select("session", "seq", "tokens", "place", "touched")
     .write.mode("overwrite").parquet(f"{kept}/batch={batch}"))
    return spark.read.parquet(f"{kept}/batch={batch}").filter("touched")


def watch_drift(stream: DataFrame, out: str, checkpoint: str,
                window: int = P.DRIFT_WINDOW) -> None:
    """Topic drift at the end of every session, from the last rows it has so far.

    The newest rows are found by ranks and the bags compared by aggregations, so that no
    session and no partition of a state costs a call of Python.
    """
    def each(df: DataFrame, batch: int) -> None:
        held = _held(df, f"{checkpoint}-held", batch, 3 * window)
        longer = held.filter(F.col("place") == window + 1).select("session")
        # The outer form: a session whose rows have no tokens any more says so.
        bags = held.join(longer, "session", "left_semi").select(
            "session", (F.col("place") <= window).alias("is_recent"), F.explode_outer("tokens").alias("token"))
        given = F.col("token").isNotNull()
        per_token = bags.groupBy("session", "token").agg(
            F.count_if(F.col("is_recent") & given).alias("a"), F.count_if(~F.col("is_recent") & given).alias("b"))
        per_token.groupBy("session").agg(
            F.sum(F.col("a") * F.col("b")).alias("dot"), F.sum(F.col("a") * F.col("a")).alias("recent"),
            F.sum(F.col("b") * F.col("b")).alias("base")).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    rows = stream.filter(F.col("session").isNotNull() & ~F.col("type").isin(P.DRIFT_SKIP_TYPES)).select(
        "session", "seq", X.tokenize(log_ops.search_body()).alias("tokens"))
    run(rows, checkpoint, each)


def session_drift(spark: SparkSession, out: str) -> DataFrame:
    """What ``retrieval.drift_per_session`` says of the same log."""
    norm = F.sqrt("recent") * F.sqrt("base")
    cos = F.when(norm > 0, F.col("dot") / norm).otherwise(0.0)
    return (newest(spark, out, "session").filter(F.col("recent") + F.col("base") > 0)
            .select("session", S.rounded(1.0 - cos).alias("drift"))
            .withColumn("drifted", (F.col("drift") >= P.DRIFT_THRESHOLD).cast("int")))
