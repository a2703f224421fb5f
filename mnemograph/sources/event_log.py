"""The event log as columns: batches of Parquet and a short tail of lines.

A batch holds the positions of its events counted from one. Where it begins in the log is
said by the state that lists the batches (:mod:`versions`), so writers prepare batches
side by side and only the commit orders them: a writer that loses the race changes one
number, not its files. Event ids that nobody gave follow from the position when the log
is read. Single events are lines in the state itself; a full tail becomes a batch, and
batches of similar size are merged, so their number stays logarithmic.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.functions.scoring import truthy
from mnemograph.sources import jsonl, schema, sinks
from mnemograph.sources.versions import Versions

TAIL_LINES, TAIL_CHARS = 100, 1 << 17   # of the tail, before it becomes a batch
MERGE_FROM = 8                          # batches from which the newest are merged
KEPT_MERGES = 3                         # merges whose input files stay for readers

STORED = {"pos": "bigint", **{n: k for n, k in schema.COLUMNS.items() if n != "seq"}}


def stored(events: DataFrame, pos: Column) -> DataFrame:
    return events.select(pos.cast("bigint").alias("pos"), *[
        F.col(n).cast(k).alias(n) for n, k in STORED.items() if n != "pos"])


def parsed(lines: DataFrame, value: str = "value", **extra: Column) -> DataFrame:
    """Canonical columns of JSON lines; ids stay null unless given."""
    v = lines.withColumn("v", F.try_parse_json(value))
    cols = jsonl.fields(F.col("v"))
    cols["event_id"] = truthy(cols["event_id"])
    return schema.conform(v, **{**cols, **extra})


class EventLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.versions = Versions(spark, f"{self.path}/versions")

    def state(self) -> dict | None:
        return self.versions.newest()

    def count(self) -> int:
        """Positions taken so far; costs one listing and one small file."""
        state = self.state()
        return state["count"] if state else 0

    # -- reading --------------------------------------------------------------------

    def _home(self, batch: str) -> str:
        return f"{self.path}/data/batch={batch}"

    def _scan(self, batches: list[dict]) -> DataFrame:
        """Events of some batches with their positions in the log."""
        ddl = ", ".join(f"`{n}` {k}" for n, k in {**STORED, "batch": "string"}.items())
        rows = self.spark.read.schema(ddl).option("basePath", f"{self.path}/data").parquet(
            *[self._home(b["home"]) for b in batches])
        firsts = F.create_map(*[F.lit(x) for b in batches for x in (b["home"], b["first"] - 1)])
        return rows.withColumn("seq", F.col("pos") + F.element_at(firsts, F.col("batch")))

    def _tail(self, tail: list[dict]) -> DataFrame:
        lines = self.spark.createDataFrame([(t["seq"], t["line"]) for t in tail],
                                           "seq bigint, value string")
        return parsed(lines, seq=F.col("seq"))

    def read(self, after: int = 0, state: dict | None = None) -> DataFrame:
        """Events behind a position; batches before it are not opened."""
        state = state or self.state() or {"batches": [], "tail": []}
        batches = [b for b in state["batches"] if b["first"] + b["count"] - 1 > after]
        tail = [t for t in state["tail"] if t["seq"] > after]
        parts = []
        if batches:
            own = F.coalesce("event_id", F.concat(F.lit("evt_"), "seq"))
            parts.append(self._scan(batches).where(F.col("seq") > after)
                         .withColumn("event_id", own).select(*schema.COLUMNS))
        if tail or not batches:
            parts.append(self._tail(tail).withColumn(
                "event_id", F.coalesce("event_id", F.concat(F.lit("evt_"), "seq"))))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    # -- writing --------------------------------------------------------------------

    def append_lines(self, *lines: str) -> int:
        """Append events given as JSON objects; returns the position of the first."""
        took = 0

        def change(old: dict | None) -> dict:
            nonlocal took
            state = old or {"count": 0, "batches": [], "tail": [], "gone": [], "malformed": 0}
            took = state["count"] + 1
            tail = [{"seq": took + i, "line": x} for i, x in enumerate(lines)]
            return {**state, "count": state["count"] + len(lines), "tail": state["tail"] + tail}

        state = self.versions.update(change)
        if len(state["tail"]) >= TAIL_LINES or sum(len(t["line"]) for t in state["tail"]) >= TAIL_CHARS:
            self.fold_tail()
        return took

    def append_batch(self, events: DataFrame, malformed: int = 0) -> int:
        """Append events with ``pos`` from one on; returns the position of the first."""
        home = uuid.uuid4().hex
        # The bounds of the ranges are sampled in a pass of their own, so the lines are parsed first.
        draft = f"{self.path}/draft-{home}"
        stored(events, F.col("pos")).write.parquet(draft)
        self.spark.read.parquet(draft).repartitionByRange("pos").sortWithinPartitions("pos") \
            .write.parquet(self._home(home))
        sinks.remove(self.spark, draft)
        n = self.spark.read.parquet(self._home(home)).count()
        took = 0

        def change(old: dict | None) -> dict:
            nonlocal took
            state = old or {"count": 0, "batches": [], "tail": [], "gone": [], "malformed": 0}
            took = state["count"] + 1
            batch = {"home": home, "first": took, "count": n}
            return {**state, "count": state["count"] + n, "malformed": state["malformed"] + malformed,
                    "batches": state["batches"] + ([batch] if n else [])}

        state = self.versions.update(change)
        if len(state["batches"]) > MERGE_FROM:
            self.merge()
        return took

    def ingest(self, *paths: str) -> int:
        """Append JSON-lines files in the order of their names; returns the events taken."""
        before = jsonl.placed_events(self.spark, *paths)
        bad = jsonl.malformed_lines(self.spark, *paths).count()
        first = self.append_batch(before.withColumnRenamed("seq", "pos"), bad)
        return self.count() - first + 1

    def fold_tail(self) -> None:
        """Turn the lines of the tail into a batch."""
        state = self.state()
        tail = state["tail"]
        if not tail:
            return
        home = uuid.uuid4().hex
        # The lines may lie between batches: each run of positions becomes one.
        runs, made = [], []
        for t in tail:
            if runs and t["seq"] == runs[-1][-1]["seq"] + 1:
                runs[-1].append(t)
            else:
                runs.append([t])
        for i, run in enumerate(runs):
            rows = self._tail(run)
            stored(rows, F.col("seq") - F.lit(run[0]["seq"] - 1)).coalesce(1) \
                .write.parquet(self._home(f"{home}-{i}"))
            made.append({"home": f"{home}-{i}", "first": run[0]["seq"], "count": len(run)})
        folded = {t["seq"] for t in tail}

        def change(old: dict | None) -> dict | None:
            left = [t for t in old["tail"] if t["seq"] not in folded]
            if len(left) != len(old["tail"]) - len(folded):
                return None                         # someone else folded them
            return {**old, "tail": left,
                    "batches": sorted(old["batches"] + made, key=lambda b: b["first"])}

        state = self.versions.update(change)
        if state is None:
            for b in made:
                sinks.remove(self.spark, self._home(b["home"]))
        elif len(state["batches"]) > MERGE_FROM:
            self.merge()

    def merge(self) -> None:
        """Merge the newest batches, as far back as none is larger than twice the later ones."""
        state = self.state()
        batches, start, later = state["batches"], len(state["batches"]) - 1, 0
        while start > 0 and batches[start - 1]["count"] <= 2 * (later + batches[start]["count"]):
            later += batches[start]["count"]
            start -= 1
        # Lines of the tail may lie between two batches; a batch has no gaps.
        picked = batches[start:]
        while picked and any(a["first"] + a["count"] != b["first"] for a, b in zip(picked, picked[1:])):
            picked = picked[1:]
        if len(picked) < 2:
            return
        home, first = uuid.uuid4().hex, picked[0]["first"]
        stored(self._scan(picked), F.col("seq") - F.lit(first - 1)) \
            .repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(self._home(home))
        names = [b["home"] for b in picked]
        whole = {"home": home, "first": first, "count": sum(b["count"] for b in picked)}

        def change(old: dict | None) -> dict | None:
            if not set(names) <= {b["home"] for b in old["batches"]}:
                return None                         # someone else merged them
            left = [b for b in old["batches"] if b["home"] not in names]
            return {**old, "batches": sorted([*left, whole], key=lambda b: b["first"]),
                    "gone": (old["gone"] + [names])[-KEPT_MERGES:]}

        done = self.versions.update(change)
        if done is None:
            sinks.remove(self.spark, self._home(home))
            return
        for stale in (state["gone"] + [names])[:-KEPT_MERGES]:
            for name in stale:
                sinks.remove(self.spark, self._home(name))
