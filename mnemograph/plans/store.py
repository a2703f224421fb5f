"""A memory store: one log folder and the tables derived from it.

Everything but the log can be deleted and rebuilt. ``as_of`` replaces the
wall clock in every computation and defaults to the time of the call.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions.scoring import truthy
from mnemograph.operators import attention as A
from mnemograph.operators import digest, increments, lens, log_ops, mining, retrieval
from mnemograph.operators import graph as G
from mnemograph.operators import relational as R
from mnemograph.plans.text_index import FULL_TEXT, WORDS, TextIndex
from mnemograph.session import stage
from mnemograph.sources import schema, sinks
from mnemograph.sources.event_log import EventLog, parsed

SCHEMA_VERSION = 2
KEPT_VERSIONS = 3      # of a branch's graph, the newest included


class Store:
    def __init__(self, spark: SparkSession, root: str, as_of: str | None = None):
        self.spark, self.root, self._as_of = spark, root.rstrip("/"), as_of
        self.events = EventLog(spark, f"{self.root}/log")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    # -- log --------------------------------------------------------------------

    def now(self) -> str:
        return self._as_of or datetime.now(timezone.utc).isoformat(timespec="seconds")

    def exists(self) -> bool:
        return self.events.state() is not None

    def log(self) -> DataFrame:
        """The whole log; an absent one is empty and nothing is created."""
        return self.events.read()

    def line_count(self) -> int:
        """Events and malformed lines taken so far."""
        state = self.events.state()
        return state["count"] + state["malformed"] if state else 0

    def ingest(self, *paths: str) -> int:
        """Append JSON-lines files; returns how many events they held."""
        return self.events.ingest(*paths)

    def append_frame(self, events: DataFrame) -> DataFrame:
        """Append a batch in the order of ``ord``; returns what its events are flagged for."""
        batch = sinks.placed(events.filter(truthy(F.col("type")).isNotNull()), 1)
        lines = sinks.to_lines(batch.withColumn("pos", F.col("seq")).withColumn(
            "seq", F.lit(None).cast("bigint")), self.now(), "pos")
        self.events.append_batch(parsed(lines, seq=F.col("pos")).withColumnRenamed("seq", "pos"))
        return sinks.notes(events)

    def append(self, type_: str, **fields) -> dict:
        """Append one event; lists may be given as comma-separated strings."""
        if not type_ or not isinstance(type_, str):
            raise ValueError("an event needs a type")
        row, kinds = {"seq": None, "type": type_}, {"seq": "bigint", "type": "string"}
        rest = {}
        for name, value in fields.items():
            name = "base" if name == "from" else name
            kind = schema.COLUMNS.get(name)
            if value is None or value == "":
                continue
            if kind is None or name == "rest":
                rest[name] = value
                continue
            if kind == "array<string>" and isinstance(value, str):
                value = [value] if name == "steps" else [
                    s.strip() for s in value.split(",") if s.strip()]
            try:
                row[name] = {"bigint": int, "double": float}.get(kind, lambda v: v)(value)
                kinds[name] = kind
            except ValueError:      # stored as it came; readers take it for null
                rest[name] = value
        if rest:
            row["rest"], kinds["rest"] = json.dumps(rest, ensure_ascii=False, default=str), "string"
        frame = self.spark.createDataFrame(
            [tuple(row.values())], ", ".join(f"`{n}` {k}" for n, k in kinds.items()))
        line = sinks.to_lines(frame, self.now()).collect()[0]["value"]  # the one event just made
        first = self.events.append_lines(line)
        out = json.loads(line)
        head = {k: out.pop(k) for k in ("t", "type")}
        return {**head, "event_id": out.pop("event_id", None) or f"evt_{first}", **out}

    def notes(self, event: dict) -> list[str]:
        """What an appended event is flagged for."""
        row = self.spark.createDataFrame([(event["type"], event.get("agent"))], "type string, agent string")
        return [r["note"] for r in sinks.notes(row).collect()]

    # -- relational state ---------------------------------------------------------

    def state(self) -> DataFrame:
        return R.state_fold(self.log())

    def tail(self, n: int = 10) -> DataFrame:
        return log_ops.tail(self.log(), n).orderBy("seq")

    def replay(self) -> dict[str, DataFrame]:
        log = self.log()
        return {"sessions": R.sessions(log), "decisions": R.decisions(log),
                "artifacts": R.artifacts(log), "loops": R.loops(log)}

    def write_replay(self) -> None:
        for name, df in self.replay().items():
            sinks.write_table(df, f"{self.root}/state/{name}")

    def query(self, name: str, n: int = 10) -> DataFrame:
        order = {"sessions": "started", "loops": "opened_t"}.get(name, "t")
        key = {"sessions": "session", "loops": "id"}.get(name, "seq")
        return R.newest(self.replay()[name], order, n, key)

    def verify(self) -> bool:
        """Replay twice and compare content digests of every projection."""
        def digests() -> list[tuple]:
            out = []
            for df in self.replay().values():
                h = F.xxhash64(*[F.col(c) for c in df.columns])
                out.append(tuple(df.agg(F.count(F.lit(1)), F.bit_xor(h)).collect()[0]))
            return out + [tuple(log_ops.content_digest(self.log()).collect()[0])]
        return digests() == digests()

    def ranked_loops(self) -> DataFrame:
        log = self.log()
        scores = R.loops_ranked(log, self.now(), retrieval.linked_degree(log)).groupBy("id").agg(
            F.max("salience").alias("salience"))
        open_loops = R.state_loops(log).filter(F.col("resolved") == 0)
        return open_loops.join(scores, "id", "left").select(
            "id", "msg", "t", F.coalesce("salience", F.lit(0.0)).alias("salience"))

    def restore(self) -> str | None:
        """Fold the log, write the state projections and return the working context."""
        if not self.exists():
            return None
        log = self.log()
        state = R.state_fold(log)
        loops = stage(self.ranked_loops(), "ranked-loops")
        top = loops.orderBy(F.desc("salience"), "id").limit(lens.LOOP_LINES).collect()

        def last(df: DataFrame):
            rows = df.orderBy(F.desc("seq")).limit(1).collect()
            return rows[0] if rows else None

        now, row = self.now(), state.collect()[0]
        text = lens.working_context(row, top, last(R.decisions(log)), last(R.artifacts(log)), now)
        sinks.write_json(state.select("project", "branch", "session", "status", "objective",
                                      F.lit(now).alias("regenerated")),
                         f"{self.root}/runtime/active_context")
        sinks.write_json(
            state.select("session", "status", "last_event_t", "event_count", "checkpoints",
                         loops.agg(F.count(F.lit(1))).scalar().alias("open_loop_count")),
            f"{self.root}/runtime/session_state")
        sinks.write_json(loops, f"{self.root}/runtime/open_loops")
        sinks.write_text(self.spark, text, f"{self.root}/runtime/working_context")
        return text

    def session_start(self, session: str | None = None, **fields) -> dict:
        session = session or self.now()[:16].replace("T", "_").replace(":", "-")
        event = self.append("session_start", session=session, **fields)
        self.restore()
        return event

    def checkpoint(self, reason: str = "manual", end_status: str = "paused",
                   keep_open: bool = False) -> str | None:
        if not self.exists():
            return None
        session = self.state().collect()[0]["session"]
        self.append("checkpoint", reason=reason, session=session)
        if session and not keep_open:
            self.append("session_end", session=session, status=end_status)
        return self.restore()

    # -- graph --------------------------------------------------------------------

    def _marks(self, branch: str) -> list[dict]:
        """Marks of the branch's versions, newest first; a build keeps only the last few."""
        try:
            rows = self.spark.read.option("recursiveFileLookup", True).json(
                f"{self.root}/graph/{branch}/marks").collect()
        except AnalysisException:
            return []
        return sorted((r.asDict() for r in rows), key=lambda m: m["built"], reverse=True)

    def _watermark(self, branch: str) -> dict | None:
        return next(iter(self._marks(branch)), None)

    def build(self, branch: str = P.MAIN, force: bool = False) -> bool:
        """Bring a branch's graph up to date; False when it already was.

        A graph is fresh when it was built from as many events, at the same
        ``as_of`` when one is fixed, under this schema.
        """
        state = self.events.state()
        mark = {"events": state["count"] if state else 0, "schema": SCHEMA_VERSION, "as_of": self._as_of or ""}
        old = self._watermark(branch)
        if not force and old and {k: old[k] for k in mark} == mark:
            return False
        # A new folder per build. Its own mark publishes it, so there is always a newest one.
        name = uuid.uuid4().hex
        mark |= {"home": f"{self.root}/graph/{branch}/v-{name}", "built": time.time_ns(),
                 "mark": f"{self.root}/graph/{branch}/marks/{name}"}
        tables = self._new_base(branch, None if force else old, state)
        sinks.write_tables(vars(tables), f"{mark['home']}/base")
        graph = increments.graph(self._base_at(mark["home"]), self.now())
        sinks.write_tables(vars(graph), mark["home"])
        bodies = self.spark.read.parquet(f"{mark['home']}/nodes").select("event_id", "body")
        index = TextIndex(self.spark, f"{mark['home']}/bodies", "event_id", (WORDS,))
        index.add(bodies, "body")
        index.vectors()
        sinks.write_json(
            self.spark.createDataFrame([tuple(mark.values())],
                                       "events bigint, schema bigint, as_of string, home string, "
                                       "built bigint, mark string"), mark["mark"])
        # Readers of the versions before may still be at work; older ones go.
        for old in self._marks(branch)[KEPT_VERSIONS:]:
            sinks.remove(self.spark, old["mark"])
            sinks.remove(self.spark, old["home"])
        if branch == P.MAIN:
            sinks.export_threads(graph.threads, f"{self.root}/runtime/threads")
        return True

    def _base_at(self, home: str) -> increments.Base:
        return increments.Base(**{f.name: self.spark.read.parquet(f"{home}/base/{f.name}")
                                  for f in dataclasses.fields(increments.Base)})

    def _new_base(self, branch: str, old: dict | None, state: dict | None) -> increments.Base:
        """The tables behind the graph: those of the last build, with what came since.

        A merge of branches lets older events in; then, and without an earlier build of
        this schema, the whole log is read.
        """
        if old and old["schema"] == SCHEMA_VERSION and state:
            new = self.events.read(old["events"], state)
            if new.filter(F.col("type") == "branch_merge").isEmpty():
                log = self.events.read(0, state)
                part = stage(log_ops.for_branch(new, branch, log_ops.merged_branches(log)), "new-events")
                return increments.merged(self._base_at(old["home"]), increments.base(part))
        log = self.events.read(0, state) if state else self.log()
        return increments.base(stage(log_ops.for_branch(log, branch), "branch-log"))

    def graph(self, branch: str = P.MAIN) -> G.Graph:
        self.build(branch)
        return self._graph_at(self._watermark(branch)["home"])

    def _graph_at(self, home: str) -> G.Graph:
        return G.Graph(**{f.name: self.spark.read.parquet(f"{home}/{f.name}")
                          for f in dataclasses.fields(G.Graph)})

    def reconstruct(self, branch: str) -> DataFrame:
        """Summary of a branch next to the mainline; stored tables stay untouched."""
        log = self.log()
        out = None
        for name in dict.fromkeys([branch, P.MAIN]):
            row = G.build(log_ops.for_branch(log, name), self.now()).summary().withColumn(
                "branch", F.lit(name))
            out = row if out is None else out.unionByName(row)
        return out

    def branches(self) -> DataFrame:
        return log_ops.branch_listing(self.log()).orderBy("branch")

    def audit(self) -> DataFrame:
        return log_ops.arbitration_audit(self.log())

    def threads(self) -> DataFrame:
        return self.graph().threads.orderBy(F.desc("last_activity_t"), "thread_id")

    def patterns(self) -> DataFrame:
        return self.graph().patterns.orderBy(F.desc("confidence"), F.desc("frequency"),
                                             "pattern_id")

    # -- attention ----------------------------------------------------------------

    def _stored(self, name: str, agent: str | None = None) -> DataFrame | None:
        try:
            df = self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException:
            return None
        return df if agent is None else df.filter(F.col("agent") == (agent or "-")).drop("agent")

    def attend(self, query: str = "", agent: str = "", threads: list[str] | None = None,
               rotate: bool = False, persist: bool = True) -> A.Attention:
        self.build()
        home = self._watermark(P.MAIN)["home"]
        att = A.attend(self._graph_at(home), self.now(), query, agent, threads,
                       previous=self._stored("activation", agent) if persist else None,
                       incubation=self._stored("incubation"), rotate=rotate, log=self.log(),
                       body_index=TextIndex(self.spark, f"{home}/bodies", "event_id", (WORDS,)),
                       log_index=self.index() if query else None)
        att = A.Attention(stage(att.nodes, "act"), stage(att.threads, "thread-act"),
                          stage(att.contradictions, "tensions"))
        key = F.lit(agent or "-").alias("agent")  # partition names cannot be empty
        sinks.write_table(att.nodes.select("*", key), f"{self.root}/activation", "agent")
        sinks.write_table(att.threads.select("*", key), f"{self.root}/thread_activation", "agent")
        return att

    def lane(self, agent: str) -> list[str]:
        """The agent's own top threads, else active ones; at most four."""
        g, own = self.graph(), self._stored("thread_activation", agent)
        if own is None:
            own = g.threads.select("thread_id", F.lit(0.0).alias("activation")).limit(0)
        return [r["thread_id"] for r in A.agent_lane(own, g.threads).collect()]

    def subgraph(self, query: str = "", top_n: int = 8, agent: str = "",
                 threads: list[str] | None = None, rotate: bool = False) -> DataFrame:
        att = self.attend(query, agent, threads, rotate)
        return A.active_subgraph(self.graph(), att.nodes, top_n).orderBy(F.desc("activation"))

    def working_memory(self, query: str = "", top_n: int = 8, agent: str = "",
                       threads: list[str] | None = None) -> lens.Workspace:
        att = self.attend(query, agent, threads)
        return lens.Workspace.of(self.graph(), att, query, top_n)

    def for_agent(self, agent: str, query: str = "") -> lens.Workspace:
        return self.working_memory(query, agent=agent,
                                   threads=self.lane(agent) if agent else None)

    def workspace(self, query: str = "", top_n: int = 8, reinforce: bool = False,
                  agent: str = "", threads: list[str] | None = None) -> str:
        memory = self.working_memory(query, top_n, agent, threads)
        if reinforce:
            for node in memory.focus(P.REINFORCE_TOP):
                self.append("attended", target=node["event_id"], agent=agent or None)
        return memory.render(self.now())

    def incubate(self) -> DataFrame:
        lift = stage(A.incubate(self.graph()), "incubation")
        sinks.write_table(lift, f"{self.root}/incubation")
        return lift

    # -- retrieval ----------------------------------------------------------------

    def index(self) -> TextIndex | None:
        """The stored index of the log, with the events appended since it was last used."""
        state = self.events.state()
        if state is None:
            return None
        index = TextIndex(self.spark, f"{self.root}/index/events", "seq", (FULL_TEXT,))
        while (after := index.upto()) < state["count"]:
            new = self.events.read(after, state).withColumn("text", log_ops.search_body())
            index.add(new, "text", state["count"], after)
        return index

    def search(self, query: str, k: int = P.SEARCH_K, rerank=None) -> DataFrame:
        log = self.log()
        return retrieval.search(log, query, self.now(), k, linked=retrieval.linked_degree(log),
                                rerank=rerank, index=self.index())

    def drift(self, window: int = P.DRIFT_WINDOW, emit: bool = False) -> dict:
        log = self.log()
        row = retrieval.drift(log, window).collect()[0].asDict()
        if emit and row["drifted"]:
            session = R.state_fold(log).collect()[0]["session"]
            self.append("topic_shift", session=session, drift=row["drift"],
                        reason="drift detection found a topic turn")
        return row

    def write_link_graph(self) -> None:
        log = self.log()
        sinks.write_json(retrieval.artifact_sessions(log), f"{self.root}/index/artifact_graph")
        sinks.write_json(retrieval.topic_cooccurrence(log), f"{self.root}/index/topic_graph")

    def index_stats(self) -> DataFrame:
        log = self.log()
        return log.agg(F.count(F.lit(1)).alias("events")).select(
            "events", R.unresolved_opens(log).agg(F.count(F.lit(1))).scalar().alias("open_loops"),
            retrieval.links(log).agg(F.count(F.lit(1))).scalar().alias("links"))

    def refresh(self) -> dict:
        """On topic drift: mark it, checkpoint, and return a fresh workspace."""
        if not self.exists():
            return {"drifted": 0}
        self.build()
        row = self.drift(emit=True)
        if row["drifted"]:
            self.checkpoint(reason="auto: topic drift", keep_open=True)
            row["workspace"] = self.workspace()
        return row

    # -- consolidation ------------------------------------------------------------

    def _emit(self, type_: str, proposals: DataFrame, evidence: DataFrame | None = None,
              key: str = "", ref: str = "event_id") -> DataFrame:
        """Append proposals as curator events, long citation lists in parts."""
        rows = proposals.withColumns({"type": F.lit(type_), "agent": F.lit(P.CURATOR)})
        if evidence is not None:
            parts = sinks.chunked_refs(evidence, key, ref).withColumnRenamed("refs", "evidence")
            rows = rows.join(parts, key, "left")
        else:
            rows = rows.withColumn("part", F.lit(0).cast("bigint"))
        known = [c for c in rows.columns if c in schema.COLUMNS]
        rows = stage(rows.select(F.struct(*[c for c in (key, "part") if c]).alias("ord"), *known)
                     if key else rows.select(F.struct(*proposals.columns).alias("ord"), *known),
                     "proposals")
        self.append_frame(rows)
        return rows

    def abstract(self, apply: bool = False) -> DataFrame:
        proposals, evidence = mining.abstract_graph(self.graph())
        if apply:
            self._emit("concept_formed", proposals.drop("term", "score"), evidence, "concept_id")
        return proposals

    def learn(self, apply: bool = False) -> DataFrame:
        proposals, evidence = mining.learn(self.graph())
        if apply:
            self._emit("procedure_learned", proposals, evidence, "procedure_id")
        return proposals

    def mine(self, apply: bool = False) -> DataFrame:
        proposals, evidence = mining.mine(self.graph())
        if apply:
            self._emit("pattern_detected", proposals, evidence, "pattern_id", "ref_id")
        return proposals

    def promote(self, apply: bool = False) -> DataFrame:
        proposals, evidence = mining.promote(self.graph(), self.log())
        if apply:
            self._emit("pattern_promoted", proposals, evidence, "pattern_id", "ref_id")
        return proposals

    def prune(self, apply: bool = False) -> DataFrame:
        proposals = mining.prune(self.graph())
        if apply:
            self._emit("concept_retired", stage(proposals, "pruned"))
        return proposals

    def retire_procedures(self, apply: bool = False) -> DataFrame:
        proposals = mining.retire_procedures(self.graph().procedures)
        if apply:
            self._emit("procedure_retired", stage(proposals, "retired"))
        return proposals

    def resolve(self, apply: bool = False) -> DataFrame:
        """Verdicts of the curator's own window."""
        att = self.attend(agent=P.CURATOR)
        verdicts = stage(A.resolve(self.graph(), att, self.log()), "verdicts")
        if apply:
            events = verdicts.filter(F.col("type") != "undecided").select(
                "type", "id", "msg", F.lit(P.CURATOR).alias("agent"),
                F.when(F.col("type") == "assumption_invalidated", F.col("loser")).alias("target"),
                F.array("winner").alias("causes"), F.struct("loser", "winner").alias("ord"))
            self.append_frame(events)
        return verdicts

    def snapshot(self, apply: bool = False) -> dict:
        """Cover the log so far; later builds compact cold events behind it."""
        g, seq = self.graph(), self.log().count()
        counts = g.summary().collect()[0].asDict()
        if apply:
            home = f"{self.root}/snapshots/snap_{seq}"
            for name, cols in (
                    ("concepts", ["concept_id", "summary", "salience", "support"]),
                    ("procedures", ["procedure_id", "label", "trigger", "outcome_score"]),
                    ("patterns", ["pattern_id", "kind", "label", "confidence", "frequency"]),
                    ("threads", ["thread_id", "title", "status", "n_events"])):
                sinks.write_json(getattr(g, name).select(*cols), f"{home}/{name}")
            self.append("snapshot", agent=P.CURATOR, snapshot_seq=seq)
        return {"snapshot_seq": seq, "counts": counts, "applied": apply}

    def introspect(self, apply: bool = False, agent: str = "") -> DataFrame:
        g, stored = self.graph(), self._stored("activation", agent)
        if stored is None:
            stored = g.nodes.select("event_id", F.lit(0.0).alias("base"),
                                    F.lit(0.0).alias("activation")).limit(0)
        row = stage(mining.introspect(g, self.log(), stored), "assessment")
        if apply:
            metrics = ["retrieval_effectiveness", "procedural_success", "cognitive_drift",
                       "context_pollution", "attention_instability"]
            pairs = [x for m in metrics for x in (F.lit(m), F.col(m))]
            self.append_frame(row.select(
                F.lit(0).alias("ord"), F.lit("meta_assessment").alias("type"),
                F.lit(P.CURATOR).alias("agent"), "confidence", "nudges",
                F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()).alias("metrics")))
        return row

    def reflect(self) -> dict:
        """Count threads, loops and tensions, and log the findings as a reflection."""
        g, now = self.graph(), self.now()
        c = R.reflection_counts(g, now).collect()[0].asDict()
        stale = R.stale_threads(g.threads, now)
        bits = [f"{c['threads']} threads ({c['active']} active, {c['dormant']} dormant)",
                f"{c['open_loops']} open loops"]
        if c["aging_loops"]:
            bits.append(f"{c['aging_loops']} aging (>{P.LOOP_AGING_DAYS:.0f}d)")
        if c["stale"]:
            bits.append(f"{c['stale']} stale branches")
        if c["tensions"]:
            bits.append(f"{c['tensions']} unresolved tension(s)")
        message = "Reflection: " + " | ".join(bits)
        # One reflection event, then more with further stale threads if there are many.
        parts = sinks.chunked_refs(stale.withColumn("k", F.lit(0)), "k", "thread_id")
        one = self.spark.range(1).select(F.lit(0).alias("k"))
        self.append_frame(stage(one.join(parts, "k", "left").select(
            F.coalesce("part", F.lit(0)).alias("ord"), F.lit("reflection").alias("type"),
            F.lit(message).alias("msg"), F.col("refs").alias("stale_threads")), "reflection"))
        return {"summary": message, "counts": c}

    def compress(self) -> DataFrame:
        """Write every digest; returns the threads whose digest stands in for them."""
        digest.write_digests(self.graph(), f"{self.root}/threads")
        return digest.stand_ins(self.graph())

    def digest(self, thread_id: str) -> DataFrame:
        return digest.digest_text(self.graph(), thread_id)

    def consolidate(self, apply: bool = False) -> dict:
        """The offline cycle; each stage sees what the one before appended."""
        out = {
            "abstract": self.abstract(apply), "learn": self.learn(apply),
            "mine": self.mine(apply), "promote": self.promote(apply),
            "prune": self.prune(apply), "retire_procedures": self.retire_procedures(apply),
            "snapshot": self.snapshot(apply)}
        if apply:
            out["incubate"] = self.incubate()
        out["introspect"] = self.introspect(apply)
        return out
