"""Registered queries over the driver tables, one per operator."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions import text as X
from mnemograph.operators import attention as A
from mnemograph.operators import digest, folds, increments, log_ops, mining, retrieval
from mnemograph.operators import graph as G
from mnemograph.operators import relational as R
from mnemograph.plans.text_index import FULL_TEXT, KINDS, WORDS, TextIndex
from mnemograph.session import stage, stage_folder
from mnemograph.sources import jsonl, sinks
from mnemograph.sources.event_log import EventLog, parsed
from mnemograph.sources import tables as T
from mnemograph.sources.schema import conform
from mnemograph.streaming import incremental as inc
from mnemograph.streaming import stateful

AS_OF = T.AS_OF
QUERY = "deploy cache"
TEXT_QUERY = "hation tionen enheit hation"
LANE = ["thr_k1", "thr_k2"]
APPENDS = 1000      # single appends of ``jsonl_ingest``

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
_shared: dict[tuple, object] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _once(name: str, spark: SparkSession, sf_dir: str, make):
    """Tables several queries share, derived once per application and folder."""
    key = (name, spark.sparkContext.applicationId, sf_dir)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


def log_of(spark, sf_dir) -> DataFrame:
    return T.event_log(spark, sf_dir)


def main_log(spark, sf_dir) -> DataFrame:
    """The mainline as a filter of the log; only the names of merged branches are staged."""
    def make():
        log = log_of(spark, sf_dir)
        return log_ops.on_branches(log, stage(log_ops.shown_branches(log), "shown-branches"))
    return _once("main", spark, sf_dir, make)


def graph_of(spark, sf_dir) -> G.Projection:
    """The graph; a query stages only what it reads of it, and what earlier ones have not."""
    return _once("graph", spark, sf_dir, lambda: G.projection(main_log(spark, sf_dir), AS_OF))


def links_of(spark, sf_dir) -> DataFrame:
    def make():
        _, edges = graph_of(spark, sf_dir).read("nodes", "edges")   # side by side: both are needed
        return stage(A.links(edges), "links")
    return _once("links", spark, sf_dir, make)


class _Window:
    """The outputs of an attention pass, each staged when it is first read."""

    def __init__(self, plan: A.Attention):
        self._plan = plan

    @cached_property
    def nodes(self) -> DataFrame:
        return stage(self._plan.nodes, "act")

    @cached_property
    def threads(self) -> DataFrame:
        return stage(self._plan.threads, "thread-act")

    @cached_property
    def contradictions(self) -> DataFrame:
        return stage(self._plan.contradictions, "tensions")


def attention_of(spark, sf_dir) -> _Window:
    return _once("attention", spark, sf_dir, lambda: _Window(A.attend(
        graph_of(spark, sf_dir), AS_OF, linked=links_of(spark, sf_dir))))


def _indexed(spark, docs: DataFrame, key: str, text: str, steps: int = 1,
             kinds: tuple[str, ...] = tuple(KINDS)) -> TextIndex:
    """A stored index of documents, added in so many steps."""
    index = TextIndex(spark, f"{stage_folder(spark)}/index-{uuid.uuid4().hex}", key, kinds)
    for i in range(steps):
        part = docs if steps == 1 else docs.where(F.pmod(F.xxhash64(key), F.lit(steps)) == i)
        index.add(part, text)
    return index


def document_index(spark, sf_dir) -> TextIndex:
    return _once("document-index", spark, sf_dir,
                 lambda: _indexed(spark, documents(spark, sf_dir), "doc_id", "text"))


def event_index(spark, sf_dir) -> TextIndex:
    return _once("event-index", spark, sf_dir, lambda: _indexed(
        spark, log_of(spark, sf_dir).withColumn("text", log_ops.search_body()), "seq", "text",
        kinds=(FULL_TEXT,)))      # events are searched by BM25 alone


def body_index(spark, sf_dir) -> TextIndex:
    return _once("body-index", spark, sf_dir, lambda: _indexed(
        spark, graph_of(spark, sf_dir).nodes.select("event_id", "body"), "event_id", "body",
        kinds=(WORDS,)))          # and bodies by TF-IDF


def documents(spark, sf_dir) -> DataFrame:
    return T.table(spark, sf_dir, "documents").select("doc_id", "text")


def _flag(col: str):
    return F.col(col).cast("int").alias(col)


# -- log ------------------------------------------------------------------------

@query
def log_layer_importance(spark, sf):
    return (log_ops.layered(log_of(spark, sf)).groupBy("type", "layer", "importance")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def log_bodies(spark, sf):
    return log_of(spark, sf).select(
        "seq", log_ops.body().alias("body"), log_ops.search_body().alias("search_body"),
        log_ops.title().alias("title"))


@query
def log_state_fold(spark, sf):
    return R.state_fold(log_of(spark, sf))


@query
def log_tail(spark, sf):
    return log_ops.tail(log_of(spark, sf)).select("seq", "t", "type", "event_id", "msg")


@query
def jsonl_round_trip(spark, sf):
    """The events written as JSON lines, as appends write them, and read back."""
    path = f"{stage_folder(spark)}/jsonl-{uuid.uuid4().hex}"
    sinks.append(sinks.to_lines(log_of(spark, sf), AS_OF), path, 1)
    log = jsonl.read_log(spark, path)
    lists = ["thread_ids", "causes", "evidence", "steps", "topics"]
    return log.select(
        "seq", "t", "type", "event_id", "session", "branch", "id", "msg", "path", "support",
        "frequency", "confidence", *[F.array_join(c, ",").alias(c) for c in lists])


@query
def jsonl_ingest(spark, sf):
    """The log arriving in a columnar store: a thousand appends of one event, then the rest at once."""
    events = EventLog(spark, f"{stage_folder(spark)}/log-{uuid.uuid4().hex}")
    lines = stage(sinks.to_lines(log_of(spark, sf), AS_OF), "lines")
    for r in lines.where(F.col("seq") <= APPENDS).orderBy("seq").collect():     # APPENDS rows
        events.append_lines(r["value"])
    rest = lines.where(F.col("seq") > APPENDS).withColumn("pos", F.col("seq") - APPENDS)
    events.append_batch(parsed(rest, seq=F.col("pos")).withColumnRenamed("seq", "pos"))
    return events.read().select(
        "seq", "t", "type", "event_id", "session", "branch", "id", "msg", "path", "support",
        "frequency", "confidence", *[F.array_join(c, ",").alias(c) for c in
                                     ("thread_ids", "causes", "evidence", "steps", "topics")])


@query
def log_content_digest(spark, sf):
    return log_ops.content_digest(log_of(spark, sf))


@query
def session_carry_forward(spark, sf):
    return R.with_session(log_of(spark, sf).select("seq", "type", "session")).select(
        "seq", "current_session", "in_session")


@query
def session_rollup(spark, sf):
    return R.sessions(log_of(spark, sf))


@query
def decisions_projection(spark, sf):
    return R.decisions(log_of(spark, sf))


@query
def artifacts_newest(spark, sf):
    return R.newest(R.artifacts(log_of(spark, sf)), "t", 10, "seq")


@query
def loops_fold_order(spark, sf):
    return R.loops(log_of(spark, sf))


@query
def loops_state_fold(spark, sf):
    return R.state_loops(log_of(spark, sf))


@query
def loops_set_semantics(spark, sf):
    return R.unresolved_opens(log_of(spark, sf)).select("seq", "event_id", "id")


@query
def loops_ranked(spark, sf):
    log = log_of(spark, sf)
    return R.loops_ranked(log, AS_OF, retrieval.linked_degree(log))


@query
def loops_by_recency(spark, sf):
    loops = R.state_loops(log_of(spark, sf)).filter(F.col("resolved") == 0)
    return R.loops_by_recency(loops, 10)


@query
def table_counts(spark, sf):
    return R.table_counts(log_of(spark, sf))


@query
def branch_listing(spark, sf):
    return log_ops.branch_listing(log_of(spark, sf))


@query
def branch_projection_counts(spark, sf):
    return main_log(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query
def branch_diff(spark, sf):
    """Events a what-if branch adds to the mainline, by type."""
    log = log_of(spark, sf)
    what_if = log_ops.for_branch(log, "exp2").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    main = log_ops.for_branch(log).groupBy("type").agg(F.count(F.lit(1)).alias("m"))
    return what_if.join(main, "type", "left").select(
        "type", F.col("n").alias("events"),
        (F.col("n") - F.coalesce("m", F.lit(0))).alias("added"))


@query
def arbitration_audit(spark, sf):
    return log_ops.arbitration_audit(log_of(spark, sf))


@query
def topic_shift_churn(spark, sf):
    return log_ops.topic_shift_churn(log_of(spark, sf))


# -- graph ----------------------------------------------------------------------

@query
def event_nodes(spark, sf):
    return G.event_nodes(main_log(spark, sf)).select(
        "event_id", "seq", "type", "layer", "body", "importance", "unresolved", "reinforced")


@query
def membership_edges(spark, sf):
    return G.membership(main_log(spark, sf))


@query
def causal_edges(spark, sf):
    return G.causal_edges(main_log(spark, sf))


@query
def causal_out_degree(spark, sf):
    return (G.causal_edges(main_log(spark, sf)).groupBy("src")
            .agg(F.count(F.lit(1)).alias("dependents")))


@query
def contradiction_edges(spark, sf):
    return G.contradictions(main_log(spark, sf))


@query
def thread_lifecycle_edges(spark, sf):
    return G.thread_lifecycle_edges(main_log(spark, sf))


@query
def thread_rollup_status(spark, sf):
    return G.threads(main_log(spark, sf), AS_OF).drop("last_ts")


@query
def thread_cooccurrence(spark, sf):
    return G.thread_pairs(main_log(spark, sf))


@query
def reinforcement_counts(spark, sf):
    return G.reinforcement(main_log(spark, sf))


@query
def compaction_cold(spark, sf):
    main = main_log(spark, sf)
    cold = G.compacted(G.event_nodes(main), G.membership(main), G.threads(main, AS_OF),
                       G.snapshot_horizon(main))
    return cold.filter(F.col("cold") == 1).select("event_id", "seq")


@query
def concept_fold(spark, sf):
    main = main_log(spark, sf)
    return folds.concepts(main, G.event_nodes(main), folds.concept_evidence(main), AS_OF)


@query
def concept_evidence(spark, sf):
    return folds.concept_evidence(main_log(spark, sf))


@query
def procedure_fold(spark, sf):
    return folds.procedures(main_log(spark, sf)).select(
        "procedure_id", "label", F.array_join("steps", "\n").alias("steps"),
        F.array_join("trigger", ",").alias("trigger"),
        S.rounded(F.col("outcome_score")).alias("outcome_score"), "uses", "last_used_t")


@query
def outcome_ema_labels(spark, sf):
    """The procedure fold over a table of judged outcomes."""
    t = T.table(spark, sf, "labels")
    pid = F.concat(F.lit("prc_"), F.col("doc_id") % 20)
    runs = conform(t, seq=F.col("doc_id") + 1, type=F.lit("proc_executed"), procedure_id=pid,
                   outcome=F.when(F.col("quality") == 1, "success").otherwise("failure"))
    keys = t.select(pid.alias("p")).distinct()
    learned = conform(keys, seq=F.lit(-1), type=F.lit("procedure_learned"),
                      procedure_id=F.col("p"))
    return folds.procedures(learned.unionByName(runs)).select(
        "procedure_id", S.rounded(F.col("outcome_score")).alias("outcome_score"), "uses")


@query
def pattern_fold(spark, sf):
    return folds.patterns(main_log(spark, sf)).select(
        "pattern_id", "kind", "label", S.rounded(F.col("confidence")).alias("confidence"),
        "frequency", F.array_join("recommended", ",").alias("recommended"), "last_seen_t")


@query
def pattern_evidence(spark, sf):
    return folds.pattern_evidence(main_log(spark, sf)).select(
        "pattern_id", "ref_kind", "ref_id", F.col("place.seq").alias("first_seq"))


@query
def resonance_edges(spark, sf):
    main = main_log(spark, sf)
    return G.resonance(folds.concept_evidence(main), G.membership(main))


@query
def graph_summary(spark, sf):
    return graph_of(spark, sf).summary()


@query
def graph_build(spark, sf):
    """Build the whole graph anew and count its edges by kind."""
    g = G.build(main_log(spark, sf), AS_OF)
    return g.edges.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), S.rounded(F.sum("weight")).alias("weight"))


@query
def incremental_graph_build(spark, sf):
    """The graph brought up to date as the log arrives in four parts; nodes and edges by kind."""
    log, tables = main_log(spark, sf), None
    top = log.agg(F.max("seq")).collect()[0][0] or 0  # one number
    for i in range(SLICES):
        low, high = top * i // SLICES, top * (i + 1) // SLICES
        new = increments.base(log.filter((F.col("seq") > low) & (F.col("seq") <= high)))
        tables = increments.advanced(tables, new)
    g = increments.graph(tables, AS_OF)
    edges = g.edges.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n"), S.rounded(F.sum("weight")).alias("weight"))
    nodes = g.nodes.agg(
        F.lit("nodes").alias("kind"), F.count(F.lit(1)).alias("n"),
        F.sum(F.col("cold") + 2 * F.col("unresolved") + 4 * F.col("reinforced")).cast("double").alias("weight"))
    threads = g.threads.groupBy(F.concat(F.lit("threads "), "status").alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_events").cast("double").alias("weight"))
    return edges.unionByName(nodes).unionByName(threads)


@query
def pattern_list(spark, sf):
    return graph_of(spark, sf).patterns.orderBy(
        F.desc("confidence"), F.desc("frequency"), "pattern_id").limit(10).select(
        "pattern_id", "kind", S.rounded(F.col("confidence")).alias("confidence"), "frequency")


@query
def node_degree(spark, sf):
    e = graph_of(spark, sf).edges
    ends = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id")))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


# -- attention ------------------------------------------------------------------

@query
def base_activation(spark, sf):
    return A.base(graph_of(spark, sf).nodes, AS_OF)


@query
def seed_vector(spark, sf):
    return A.seeds(graph_of(spark, sf), AS_OF).select(
        "event_id", "base", S.rounded(F.col("seed")).alias("seed"))


@query
def seed_vector_role(spark, sf):
    g = graph_of(spark, sf)
    return A.seeds(g, AS_OF, agent="coder", threads=LANE,
                   incubation=A.incubate(g, links_of(spark, sf))).select(
        "event_id", S.rounded(F.col("seed")).alias("seed"))


@query
def seed_query_hits(spark, sf):
    return A.query_hits(graph_of(spark, sf), QUERY, AS_OF, body_index=body_index(spark, sf)).select(
        "event_id", S.rounded(F.col("q")).alias("q"))


@query
def query_hits_bm25(spark, sf):
    return A.bm25_hits(graph_of(spark, sf), QUERY, AS_OF, log_of(spark, sf), event_index(spark, sf)).select(
        "event_id", S.rounded(F.col("q")).alias("q"))


@query
def query_hits_substring(spark, sf):
    return A.body_hits(graph_of(spark, sf).nodes, "Deploy").select("event_id", "q")


@query
def triggered_procedures(spark, sf):
    return A.triggered_procedures(graph_of(spark, sf)).select(
        "procedure_id", S.rounded(F.col("outcome_score")).alias("outcome_score"))


def _spread(spark, sf, hops):
    g = graph_of(spark, sf)
    nodes = stage(A.seeds(g, AS_OF), "seeds")
    act = A.spread(nodes, links_of(spark, sf).select("v", "u", "w"), hops)
    return act.select("event_id", S.rounded(F.col("activation")).alias("activation"))


@query
def spread_1hop(spark, sf):
    return _spread(spark, sf, 1)


@query
def spread_2hop(spark, sf):
    return _spread(spark, sf, 2)


@query
def inhibition_4rounds(spark, sf):
    g = graph_of(spark, sf)
    act = A.base(g.nodes, AS_OF).withColumnRenamed("base", "activation")
    return A.inhibit(act, g.contradictions).select(
        "event_id", S.rounded(F.col("activation")).alias("activation"))


@query
def contradiction_scores(spark, sf):
    return attention_of(spark, sf).contradictions


@query
def attend_nodes(spark, sf):
    return A.attend(graph_of(spark, sf), AS_OF, linked=links_of(spark, sf)).nodes


@query
def thread_activation_resurfaced(spark, sf):
    return A.attend(graph_of(spark, sf), AS_OF, linked=links_of(spark, sf)).threads


@query
def persistence_blend(spark, sf):
    """Blend a fresh base state with the stored activation."""
    g = graph_of(spark, sf)
    act = A.base(g.nodes, AS_OF).withColumnRenamed("base", "activation")
    return A.blend(act, attention_of(spark, sf).nodes).select(
        "event_id", S.rounded(F.col("activation")).alias("activation"))


@query
def oscillation(spark, sf):
    g = graph_of(spark, sf)
    return A.oscillate(attention_of(spark, sf).nodes, g.membership).select(
        "event_id", S.rounded(F.col("activation")).alias("activation"))


@query
def top_active_nodes(spark, sf):
    return A.top_nodes(graph_of(spark, sf), attention_of(spark, sf).nodes, 8).select(
        "event_id", "type", "activation")


@query
def active_subgraph_2hop(spark, sf):
    return A.active_subgraph(graph_of(spark, sf), attention_of(spark, sf).nodes).select(
        "event_id", "type", "layer", "activation")


@query
def incubation(spark, sf):
    return A.incubate(graph_of(spark, sf), links_of(spark, sf))


@query
def agent_lane(spark, sf):
    return A.agent_lane(attention_of(spark, sf).threads, graph_of(spark, sf).threads)


@query
def resolve_contradictions(spark, sf):
    return A.resolve(graph_of(spark, sf), attention_of(spark, sf), main_log(spark, sf))


@query
def attend_agent_window(spark, sf):
    """A query-driven, rotated window of one role, blended with earlier state."""
    g, a = graph_of(spark, sf), attention_of(spark, sf)
    return A.attend(g, AS_OF, query=QUERY, agent="coder", threads=LANE, previous=a.nodes,
                    incubation=A.incubate(g, links_of(spark, sf)), rotate=True,
                    linked=links_of(spark, sf)).nodes


# -- text and retrieval -----------------------------------------------------------

@query
def fts_tokens(spark, sf):
    words = documents(spark, sf).select("doc_id", F.explode(
        X.fts_tokens(F.col("text"))).alias("token"))
    return words.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query
def tokenize_bag(spark, sf):
    return retrieval.token_bag(documents(spark, sf), F.col("text"))


@query
def df_terms(spark, sf):
    return (documents(spark, sf).select(F.explode(X.terms(F.col("text"))).alias("term"))
            .groupBy("term").agg(F.count(F.lit(1)).alias("df")))


@query
def lead_terms(spark, sf):
    return documents(spark, sf).select(
        "doc_id", X.lead_term(F.col("text")).alias("lead"),
        X.slug(X.lead_term(F.col("text"))).alias("slug"))


@query
def tfidf_vectors(spark, sf):
    v = retrieval.tfidf_vectors(documents(spark, sf), "doc_id", F.col("text"))
    return v.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("terms"), S.rounded(F.sum("weight"), 3).alias("weight_sum"),
        S.rounded(F.max("weight"), 5).alias("weight_max"))


@query
def tfidf_search(spark, sf):
    return document_index(spark, sf).tfidf_top(TEXT_QUERY)


@query
def fact_tfidf_search(spark, sf):
    return document_index(spark, sf).fact_top(TEXT_QUERY)


@query
def bm25_search(spark, sf):
    return document_index(spark, sf).bm25_top(TEXT_QUERY, 25)


@query
def bm25_scan(spark, sf):
    """The same search without an index."""
    return retrieval.bm25_top(documents(spark, sf), "doc_id", F.col("text"), TEXT_QUERY, 25)


@query
def index_in_steps(spark, sf):
    """All three searches over an index that grew in four steps."""
    index = _indexed(spark, documents(spark, sf), "doc_id", "text", SLICES)
    parts = {"bm25": index.bm25_top(TEXT_QUERY, 25).select("doc_id", F.col("rank").alias("score")),
             "fact": index.fact_top(TEXT_QUERY), "tfidf": index.tfidf_top(TEXT_QUERY)}
    out = [df.select(F.lit(name).alias("search"), "doc_id", F.col(df.columns[1]).alias("score"))
           for name, df in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def event_search(spark, sf):
    log = log_of(spark, sf)
    return retrieval.search(log, QUERY, AS_OF, linked=retrieval.linked_degree(log),
                            index=event_index(spark, sf))


@query
def dense_topk(spark, sf):
    e = T.table(spark, sf, "embeddings")
    probe = e.filter(F.col("vec_id") == 0).select("embedding").scalar()
    with_probe = e.withColumn("probe", probe)
    return retrieval.dense_top(with_probe, "vec_id", "embedding", F.col("probe"), 10)


@query
def drift_global(spark, sf):
    return retrieval.drift(log_of(spark, sf))


@query
def drift_per_session(spark, sf):
    return retrieval.drift_per_session(T.turn_log(spark, sf))


@query
def recency_salience(spark, sf):
    log = log_of(spark, sf)
    linked = retrieval.linked_degree(log)
    opened = R.unresolved_opens(log).select("seq", F.lit(1).alias("unresolved"))
    rows = log.select("seq", "type", "ts").join(linked, "seq", "left").join(opened, "seq", "left")
    return rows.select("seq", S.salience(
        S.importance(F.col("type")), F.col("ts"), F.coalesce("unresolved", F.lit(0)),
        F.coalesce("linked", F.lit(0)), AS_OF).alias("salience"))


@query
def artifact_sessions(spark, sf):
    return retrieval.artifact_sessions(log_of(spark, sf))


@query
def link_rows(spark, sf):
    return (retrieval.links(log_of(spark, sf)).groupBy("src", "dst", "kind")
            .agg(F.count(F.lit(1)).alias("n")))


@query
def topic_cooccurrence(spark, sf):
    return retrieval.topic_cooccurrence(log_of(spark, sf))


@query
def linked_degree(spark, sf):
    return retrieval.linked_degree(log_of(spark, sf))


# -- consolidation ----------------------------------------------------------------

@query
def abstract_concepts(spark, sf):
    return mining.abstract(documents(spark, sf), "doc_id", F.col("text"))[0]


@query
def abstract_evidence(spark, sf):
    ev = mining.abstract(documents(spark, sf), "doc_id", F.col("text"))[1]
    return ev.select("concept_id", F.col("event_id").alias("doc_id"))


@query
def abstract_episodes(spark, sf):
    return mining.abstract_graph(graph_of(spark, sf))[0]


@query
def learn_procedures(spark, sf):
    return mining.learn(graph_of(spark, sf))[0].select(
        "procedure_id", "label", F.array_join("trigger", ",").alias("trigger"),
        F.array_join("steps", "\n").alias("steps"), "support")


@query
def reasoning_motifs(spark, sf):
    rows = mining.member_events(graph_of(spark, sf))
    return (mining.reasoning_motifs(rows).groupBy(F.array_join("gram", " → ").alias("gram"))
            .agg(F.count(F.lit(1)).alias("support"))
            .filter(F.col("support") >= P.PATTERN_MIN_SUPPORT))


@query
def failure_modes(spark, sf):
    fails = mining.failure_terms(mining.member_events(graph_of(spark, sf)))
    return fails.groupBy("term").agg(
        F.count_distinct("thread_id").alias("support"),
        F.count_distinct("event_id").alias("events")).filter(
        F.col("support") >= P.PATTERN_MIN_SUPPORT)


@query
def success_paths(spark, sf):
    rows = mining.member_events(graph_of(spark, sf))
    paths, _ = mining.recurring_paths(rows, P.PATTERN_MIN_SUPPORT)
    return paths.select(F.array_join("terms", " → ").alias("path"), "support", "thread_id")


@query
def bottlenecks(spark, sf):
    g = graph_of(spark, sf)
    return mining.bottlenecks(mining.member_events(g), g.causal)


@query
def mine_patterns(spark, sf):
    return mining.mine(graph_of(spark, sf))[0].select(
        "pattern_id", "kind", "label", "confidence", "frequency",
        F.array_join("recommended", ",").alias("recommended"))


@query
def promote_patterns(spark, sf):
    return mining.promote(graph_of(spark, sf), main_log(spark, sf))[0].select(
        "pattern_id", "procedure_id", "label", F.array_join("steps", ",").alias("steps"),
        F.array_join("trigger", ",").alias("trigger"), "confidence")


@query
def prune_concepts(spark, sf):
    return mining.prune(graph_of(spark, sf))


@query
def retire_candidates(spark, sf):
    return mining.retire_procedures(graph_of(spark, sf).procedures).select("procedure_id")


@query
def introspect_metrics(spark, sf):
    return mining.introspect(
        graph_of(spark, sf), main_log(spark, sf), attention_of(spark, sf).nodes
    ).withColumn("nudges", F.array_join("nudges", ","))


@query
def reflect_counts(spark, sf):
    return R.reflection_counts(graph_of(spark, sf), AS_OF)


@query
def thread_digest_lines(spark, sf):
    return digest.digest_lines(graph_of(spark, sf)).select(
        "thread_id", "section", "place", "line")


# -- streaming ----------------------------------------------------------------------

SLICES = 4


def _streamed(spark, sf, job, name: str, log: DataFrame | None = None) -> str:
    """Let the log arrive in four parts and resume the stream after each one."""
    home = f"{stage_folder(spark)}/{name}-{uuid.uuid4().hex}"
    log = log_of(spark, sf) if log is None else log
    top = log.agg(F.max("seq")).collect()[0][0]  # one number
    for i in range(SLICES):
        low, high = top * i // SLICES, top * (i + 1) // SLICES
        log.filter((F.col("seq") > low) & (F.col("seq") <= high)).write.mode("append").parquet(
            f"{home}/log")
        job(inc.log_stream(spark, f"{home}/log"), f"{home}/data", f"{home}/checkpoint")
    return f"{home}/data"


@query
def streaming_incremental_index(spark, sf):
    out = _streamed(spark, sf, inc.index_postings, "postings")
    return (spark.read.parquet(out).groupBy("term")
            .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf")))


@query
def streaming_late_close(spark, sf):
    out = _streamed(spark, sf, inc.track_loops, "loops")
    return (inc.newest(spark, out, "id")
            .filter((F.col("opens") > 0) & (F.col("closes") == 0)).select("id", "last_open"))


@query
def streaming_thread_activity(spark, sf):
    out = _streamed(spark, sf, inc.track_threads, "threads")
    return inc.newest(spark, out, "thread_id").select(
        "thread_id", "n_events",
        F.when(S.is_dormant(F.col("last_ts"), AS_OF), "dormant").otherwise("active")
        .alias("status"))


@query
def streaming_ema(spark, sf):
    out = _streamed(spark, sf, stateful.learn_procedures, "scores")
    return stateful.learned_scores(spark, out).select(
        "procedure_id", S.rounded(F.col("score")).alias("score"), "uses")


@query
def streaming_procedures(spark, sf):
    """The whole procedure fold: learnings, promotions, retirements and executions."""
    out = _streamed(spark, sf, stateful.learn_procedures, "procedures", main_log(spark, sf))
    return stateful.learned_procedures(spark, out).withColumn(
        "outcome_score", S.rounded(F.col("outcome_score")))


@query
def streaming_dormancy(spark, sf):
    """Threads dormant by the log's own clock, marked by timers."""
    out = _streamed(spark, sf, stateful.watch_threads, "dormancy")
    return inc.newest(spark, out, "thread_id").select("thread_id", "n_events", "status")


@query
def streaming_drift(spark, sf):
    out = _streamed(spark, sf, stateful.watch_drift, "drift", stage(T.turn_log(spark, sf), "turns"))
    return stateful.session_drift(spark, out)
