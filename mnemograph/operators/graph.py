"""The typed, weighted memory graph projected from a log."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions.scoring import truthy
from mnemograph.operators import folds, log_ops
from mnemograph.operators import relational as R
from mnemograph.session import stage, stage_all


def event_nodes(log: DataFrame) -> DataFrame:
    """One node per event id (the last event of an id wins), with loop and use marks."""
    ty = F.col("type")
    shape = [log_ops.event_key().alias("event_id"), "seq", "t", "ts", "type",
             S.layer(ty, F.col("layer")).alias("layer"), log_ops.body().alias("body"),
             S.importance(ty).alias("importance")]

    def marked(df: DataFrame, unresolved: int) -> DataFrame:
        return df.select(*shape, F.lit(unresolved).alias("unresolved"))

    rows = (marked(log.filter((ty != "open_loop") | ty.isNull()), 0)
            .unionByName(marked(R.unresolved_opens(log), 1))
            .unionByName(marked(R.resolved_opens(log), 0)))
    fields = [c for c in rows.columns if c != "event_id"]
    last = (rows.groupBy("event_id")
            .agg(F.max_by(F.struct(*fields), "seq").alias("n"))
            .select("event_id", *[F.col(f"n.{f}") for f in fields]))
    return last.join(reinforcement(log), "event_id", "left").withColumn(
        "reinforced", F.coalesce("reinforced", F.lit(0)).cast("int"))


def reinforcement(log: DataFrame) -> DataFrame:
    """How often each event was attended to."""
    return (log.filter((F.col("type") == "attended") & truthy(F.col("target")).isNotNull())
            .groupBy(F.col("target").alias("event_id"))
            .agg(F.count(F.lit(1)).alias("reinforced")))


def membership(log: DataFrame) -> DataFrame:
    return log.select(log_ops.event_key().alias("event_id"),
                      F.explode(F.array_distinct("thread_ids")).alias("thread_id"))


def thread_pairs(log: DataFrame) -> DataFrame:
    """Threads sharing events, counted; pairs form inside a row, without a join."""
    ids = log.select(F.array_sort(F.array_distinct("thread_ids")).alias("ids")).filter(
        F.size("ids") > 1)
    firsts = ids.select("ids", F.posexplode("ids").alias("i", "a"))
    rest = F.slice("ids", F.col("i") + 2, F.size("ids"))
    return (firsts.select("a", F.explode(rest).alias("b"))
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")))


def causal_edges(log: DataFrame) -> DataFrame:
    return log.select(F.explode("causes").alias("src"), log_ops.event_key().alias("dst"))


def contradictions(log: DataFrame) -> DataFrame:
    """Rival pairs: the first two of ``between``, else of ``causes``."""
    pair = F.when(F.size(F.coalesce("between", F.array().cast("array<string>"))) > 0,
                  F.col("between")).otherwise(F.col("causes"))
    rows = log.filter(F.col("type") == "contradiction").select(pair.alias("p"))
    return rows.filter(F.size("p") >= 2).select(F.get("p", F.lit(0)).alias("src"),
                                                F.get("p", F.lit(1)).alias("dst"))


def thread_lifecycle_edges(log: DataFrame) -> DataFrame:
    other = F.when(F.col("type") == "thread_merge", F.col("into")).otherwise(F.col("spawn"))
    return (log.filter(F.col("type").isin("thread_merge", "thread_split"))
            .select(F.col("thread_id").alias("src"), truthy(other).alias("dst"))
            .filter(F.col("dst").isNotNull()))


def thread_state(log: DataFrame) -> DataFrame:
    """What each thread's rollup needs, in one aggregation; states of two logs combine."""
    tid = F.coalesce(truthy(F.col("thread_id")), truthy(F.col("id")))

    def part(df: DataFrame, kind: str, key: Column) -> DataFrame:
        return df.select(key.alias("thread_id"), F.lit(kind).alias("part"), "seq", "t", "ts",
                         truthy(F.col("title")).alias("title"), "into")

    ty = F.col("type")
    rows = (
        part(log.filter(ty == "thread_open"), "open", tid)
        .unionByName(part(log.filter(ty == "thread_merge"), "merge", truthy(F.col("thread_id"))))
        .unionByName(part(log.filter(ty == "thread_split"), "split", truthy(F.col("spawn"))))
        .unionByName(part(log.select("*", F.explode(F.array_distinct("thread_ids")).alias("m")),
                          "member", F.col("m")))
        .filter(F.col("thread_id").isNotNull()))

    def newest(kind: str, *fields: str, given: str | None = None) -> Column:
        is_kind = F.col("part") == kind
        return F.max(F.when(is_kind & F.col(given).isNotNull() if given else is_kind,
                            F.struct(*fields)))

    return rows.groupBy("thread_id").agg(
        newest("open", "seq", "title", given="title").alias("titled"),
        newest("open", "seq", "t").alias("opened"),
        newest("member", "ts", "seq", "t", given="ts").alias("last"),
        F.count_if(F.col("part") == "merge").alias("merges"),
        newest("merge", "seq", "into").alias("merged"),
        F.count_if(F.col("part") == "member").alias("n_events"))


def thread_rows(state: DataFrame, as_of) -> DataFrame:
    """Thread rollup and status out of the states."""
    status = (F.when(F.col("merges") > 0, "merged")
              .when(S.is_dormant(F.col("last.ts"), as_of), "dormant").otherwise("active"))
    return state.select(
        "thread_id", F.coalesce("titled.title", "thread_id").alias("title"),
        F.col("opened.t").alias("opened_t"), F.col("last.t").alias("last_activity_t"),
        F.col("last.ts").alias("last_ts"), status.alias("status"),
        F.col("merged.into").alias("merged_into"), "n_events")


def threads(log: DataFrame, as_of) -> DataFrame:
    """Thread rollup and status."""
    return thread_rows(thread_state(log), as_of)


def snapshot_horizon(log: DataFrame) -> DataFrame:
    return log.filter(F.col("type") == "snapshot").agg(
        F.coalesce(F.max("snapshot_seq"), F.lit(0)).alias("snapshot_seq"))


def compacted(nodes: DataFrame, members: DataFrame, thread_rows: DataFrame,
              horizon: DataFrame) -> DataFrame:
    """Adds ``cold``: resolved events behind the snapshot, outside active threads."""
    active = thread_rows.filter(F.col("status") == "active").select("thread_id")
    hot = (members.join(active, "thread_id", "left_semi")
           .select("event_id", F.lit(1).alias("hot")).distinct())
    behind = F.coalesce(F.col("seq") <= F.col("_snap"), F.lit(False))
    return (
        nodes.withColumn("_snap", horizon.scalar())
        .join(hot, "event_id", "left")
        .withColumn("cold", F.when(behind & (F.col("_snap") > 0) & (F.col("unresolved") == 0)
                                   & F.col("hot").isNull(), 1).otherwise(0))
        .drop("_snap", "hot"))


def resonance(evidence: DataFrame, members: DataFrame, hub: int = P.RESONANCE_HUB) -> DataFrame:
    """The strongest concept pairs whose evidence shares at least two threads.

    A thread of more than ``hub`` concepts forms no pairs. Concepts with the same hubs
    are one class, and what two concepts share in hubs depends on their classes
    alone. So of the pairs that meet only in hubs, a concept needs no more than the
    last few concepts of the classes it shares most with: the cut at
    ``RESONANCE_MAX_PER`` partners takes larger counts first and then later ids. Pairs
    that meet in another thread are joined, and get what their classes add.
    """
    keep = P.RESONANCE_MAX_PER
    sets = stage(evidence.join(members, "event_id").select("concept_id", "thread_id").distinct(),
                 "concept-threads")
    width = sets.groupBy("thread_id").agg(F.count(F.lit(1)).alias("df"))
    marked = sets.join(width, "thread_id")
    hubs = marked.filter(F.col("df") > hub).groupBy("concept_id").agg(
        F.array_sort(F.collect_set("thread_id")).alias("hubs"))
    classed = stage(sets.select("concept_id").distinct().join(hubs, "concept_id", "left").select(
        "concept_id", F.coalesce("hubs", F.array().cast("array<string>")).alias("hubs")),
        "concept-hubs")
    rare = marked.filter(F.col("df") <= hub)
    met = (
        rare.select(F.col("concept_id").alias("a"), "thread_id")
        .join(rare.select(F.col("concept_id").alias("b"), "thread_id"), "thread_id")
        .filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")))
    side = [classed.select(F.col("concept_id").alias(c), F.col("hubs").alias(f"h{c}")) for c in "ab"]
    met = met.join(side[0], "a").join(side[1], "b").select(
        "a", "b", (F.col("n") + F.size(F.array_intersect("ha", "hb"))).alias("shared"))
    # Classes, the last concepts of each, and for every class its best partners.
    last = Window.partitionBy("hubs").orderBy(F.desc("concept_id"))
    ends = classed.filter(F.size("hubs") > 1).withColumn("place", F.row_number().over(last)) \
        .filter(F.col("place") <= keep + 1).select(F.col("hubs").alias("to"),
                                                   F.col("concept_id").alias("other"))
    kinds = classed.filter(F.size("hubs") > 1).select("hubs").distinct()
    spread = kinds.select("hubs", F.explode("hubs").alias("thread"))
    common = spread.join(spread.select(F.col("hubs").alias("to"), "thread"), "thread") \
        .groupBy("hubs", "to").agg(F.count(F.lit(1)).alias("shared")) \
        .filter(F.col("shared") >= P.RESONANCE_MIN_SHARED)
    first = Window.partitionBy("hubs").orderBy(F.desc("shared"), F.desc("other"))
    partners = common.join(ends, "to").withColumn("place", F.row_number().over(first)) \
        .filter(F.col("place") <= keep + 1).select("hubs", "other", "shared")
    in_hubs = classed.join(partners, "hubs").filter(F.col("concept_id") != F.col("other")).select(
        F.least("concept_id", "other").alias("a"), F.greatest("concept_id", "other").alias("b"),
        "shared")
    strong = stage(met.unionByName(in_hubs).groupBy("a", "b").agg(F.max("shared").alias("shared"))
                   .filter(F.col("shared") >= P.RESONANCE_MIN_SHARED), "concept-pairs")
    ways = strong.select(F.col("a").alias("c"), F.col("b").alias("other"), "shared", "a", "b"
                         ).unionByName(strong.select(F.col("b").alias("c"),
                                                     F.col("a").alias("other"), "shared", "a", "b"))
    best = Window.partitionBy("c").orderBy(F.desc("shared"), F.desc("other"))
    weight = P.EDGE_WEIGHT["resonance"] * F.least(F.lit(1.0), F.col("shared") / P.RESONANCE_NORM)
    return (
        ways.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= keep)
        .select("a", "b", "shared").distinct()
        .select(F.col("a").alias("src"), F.col("b").alias("dst"), "shared",
                S.rounded(weight).alias("weight")))


@dataclass
class Graph:
    nodes: DataFrame            # events, concepts, procedures and patterns
    membership: DataFrame
    edges: DataFrame            # every kind but contradiction
    contradictions: DataFrame
    threads: DataFrame
    concepts: DataFrame
    concept_evidence: DataFrame
    procedures: DataFrame
    procedure_evidence: DataFrame
    patterns: DataFrame
    pattern_evidence: DataFrame

    @property
    def causal(self) -> DataFrame:
        return self.edges.filter(F.col("kind") == "causal")

    def summary(self) -> DataFrame:
        """Row counts of the projection, one row."""
        def n(df: DataFrame) -> Column:
            return df.agg(F.count(F.lit(1))).scalar()
        return self.nodes.agg(
            F.count(F.lit(1)).alias("nodes"), F.sum("cold").cast("bigint").alias("cold")
        ).select("nodes", "cold", n(self.threads).alias("threads"),
                 (n(self.edges) + n(self.contradictions)).alias("edges"),
                 n(self.concepts).alias("concepts"), n(self.procedures).alias("procedures"),
                 n(self.patterns).alias("patterns"))


def stated_edges(log: DataFrame) -> DataFrame:
    """Edges that single events state: causes, and merges and splits of threads."""
    def kind(df: DataFrame, name: str, weight: Column | None = None) -> DataFrame:
        w = F.lit(P.EDGE_WEIGHT[name]) if weight is None else weight
        return df.select("src", "dst", F.lit(name).alias("kind"), w.alias("weight"))

    return kind(causal_edges(log), "causal").unionByName(
        kind(thread_lifecycle_edges(log), "thread_rel", F.lit(1.0)))


def edge_rows(log: DataFrame) -> DataFrame:
    """Edges that follow from the log alone, contradictions apart."""
    return derived_edges(membership(log), thread_pairs(log), stated_edges(log))


def derived_edges(members: DataFrame, pairs: DataFrame, stated: DataFrame) -> DataFrame:
    """Edges that events state, with those of membership and shared threads."""
    return stated.unionByName(members.select(
        F.col("event_id").alias("src"), F.col("thread_id").alias("dst"),
        F.lit("membership").alias("kind"), F.lit(P.EDGE_WEIGHT["membership"]).alias("weight"))) \
        .unionByName(pairs.select(
            F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("thread_rel").alias("kind"),
            (P.EDGE_WEIGHT["thread_rel"] * F.col("shared")).alias("weight")))


def _memory_nodes(df: DataFrame, key: str, type_: str, layer: str, body: str, t: str,
                  importance: str) -> DataFrame:
    return df.select(
        F.col(key).alias("event_id"), F.lit(None).cast("bigint").alias("seq"),
        F.col(t).alias("t"), F.try_to_timestamp(F.col(t)).alias("ts"), F.lit(type_).alias("type"),
        F.lit(layer).alias("layer"), F.col(body).alias("body"),
        F.col(importance).alias("importance"), F.lit(0).alias("unresolved"),
        F.lit(0).alias("reinforced"))


def build(log: DataFrame, as_of, block: int | None = None) -> Graph:
    """Project a branch-filtered log; what several outputs share is staged once."""
    return projection(log, as_of, block).whole()


def projection(log: DataFrame, as_of, block: int | None = None) -> Projection:
    """The same tables, each staged only when it is read."""
    return Projection(event_nodes(log), membership(log), threads(log, as_of), contradictions(log),
                      edge_rows(log), log, as_of, block)


def assembled(events: DataFrame, members: DataFrame, thread_rows: DataFrame, rivals: DataFrame,
              log_edges: DataFrame, log: DataFrame, as_of, block: int | None = None) -> Graph:
    """A graph of tables that follow from the log, and of a log with all memory events."""
    return Projection(events, members, thread_rows, rivals, log_edges, log, as_of, block).whole()


class Projection:
    """The tables of a ``Graph``, each staged when it is first read, with what it follows from."""

    FIRST = ("events", "membership", "threads", "concept_evidence", "procedures", "patterns",
             "contradictions")
    NEEDS = {
        "concepts": ("events", "concept_evidence"),
        "procedure_evidence": ("procedures",),
        "nodes": ("events", "membership", "threads", "concepts", "procedures", "patterns"),
        "edges": ("membership", "concept_evidence", "procedure_evidence", "pattern_evidence")}

    def __init__(self, events: DataFrame, members: DataFrame, thread_rows: DataFrame,
                 rivals: DataFrame, log_edges: DataFrame, log: DataFrame, as_of,
                 block: int | None = None):
        self._made: dict[str, DataFrame] = {}
        self._plans = {
            "events": lambda: events, "membership": lambda: members, "threads": lambda: thread_rows,
            "contradictions": lambda: rivals,
            "concept_evidence": lambda: folds.concept_evidence(log),
            "procedures": lambda: folds.procedures(log, block),
            "patterns": lambda: folds.patterns(log),
            "concepts": lambda: folds.concepts(log, self.events, self.concept_evidence, as_of, block),
            "procedure_evidence": lambda: folds.procedure_evidence(log, self.procedures),
            "pattern_evidence": lambda: folds.pattern_evidence(log),
            "nodes": lambda: self._nodes(snapshot_horizon(log)),
            "edges": lambda: self._edges(log_edges)}
        self._log_edges = log_edges

    def read(self, *names: str) -> list[DataFrame]:
        """Some tables; those that are missing are staged at the same time."""
        needed = [n for m in names if m not in self._made for n in self.NEEDS.get(m, ())]
        if needed:
            self.read(*dict.fromkeys(needed))
        missing = [n for n in names if n not in self._made]     # without those that others needed
        if missing:
            self._made.update(zip(missing, stage_all(**{n: self._plans[n]() for n in missing})))
        return [self._made[n] for n in names]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._plans:
            raise AttributeError(name)
        return self.read(name)[0]

    @property
    def causal(self) -> DataFrame:
        """Causal edges; they follow from the log alone."""
        return self._log_edges.filter(F.col("kind") == "causal")

    def whole(self) -> Graph:
        self.read(*self.FIRST)
        self.read("concepts", "procedure_evidence", "pattern_evidence")
        self.read("nodes", "edges")
        return Graph(**{f.name: self._made[f.name] for f in fields(Graph)})

    def summary(self) -> DataFrame:
        return self.whole().summary()

    def _nodes(self, horizon: DataFrame) -> DataFrame:
        made = (
            _memory_nodes(self.concepts, "concept_id", "concept", "semantic", "summary", "formed_t",
                          "salience")
            .unionByName(_memory_nodes(self.procedures, "procedure_id", "procedure", "procedural",
                                       "label", "last_used_t", "outcome_score"))
            .unionByName(_memory_nodes(self.patterns, "pattern_id", "pattern", "pattern", "label",
                                       "last_seen_t", "confidence")))
        # A memory id equal to an event id replaces that node.
        nodes = self.events.join(made.select("event_id"), "event_id", "left_anti").unionByName(made)
        return compacted(nodes, self.membership, self.threads, horizon)

    def _edges(self, log_edges: DataFrame) -> DataFrame:
        def edge(df: DataFrame, src: str, dst: str, kind: str) -> DataFrame:
            return df.select(F.col(src).alias("src"), F.col(dst).alias("dst"),
                             F.lit(kind).alias("kind"), F.lit(P.EDGE_WEIGHT[kind]).alias("weight"))

        bonds = resonance(self.concept_evidence, self.membership)
        return (
            log_edges
            .unionByName(edge(self.concept_evidence, "concept_id", "event_id", "concept"))
            .unionByName(edge(self.procedure_evidence, "procedure_id", "event_id", "procedure"))
            .unionByName(edge(self.pattern_evidence, "pattern_id", "ref_id", "pattern"))
            .unionByName(bonds.select("src", "dst", F.lit("resonance").alias("kind"), "weight")))
