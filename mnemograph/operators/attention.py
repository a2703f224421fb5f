"""Attention over the memory graph: seeds, spreading, inhibition, resurfacing."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.operators import log_ops, retrieval
from mnemograph.operators.graph import Graph
from mnemograph.session import stage, stage_all

THREAD_KINDS = ["membership", "thread_rel"]  # one end is a thread, which holds no activation


@dataclass
class Attention:
    nodes: DataFrame            # event_id, base, seed, activation
    threads: DataFrame          # thread_id, status, activation, resurfaced
    contradictions: DataFrame   # src, dst, src_score, dst_score


def base(nodes: DataFrame, as_of) -> DataFrame:
    return nodes.select("event_id", S.base_activation(
        F.col("importance"), F.col("ts"), F.col("unresolved"), F.col("reinforced"), as_of
    ).alias("base"))


def triggered_procedures(graph: Graph, query: str = "") -> DataFrame:
    """Procedures with a trigger term inside the query or an unresolved loop's text."""
    spark = graph.nodes.sparkSession
    terms = (graph.procedures.select("procedure_id", F.explode("trigger").alias("term"))
             .select("procedure_id", F.lower(F.trim("term")).alias("needle"))
             .filter(F.col("needle") != ""))
    situation = graph.nodes.filter(F.col("unresolved") == 1).select(
        F.lower("body").alias("hay"))
    if query:
        situation = situation.unionByName(
            spark.createDataFrame([(query.lower(),)], "hay string"))
    found = retrieval.substring_hits(terms, situation)
    return (terms.join(found, "needle", "left_semi").select("procedure_id").distinct()
            .join(graph.procedures.select("procedure_id", "outcome_score"), "procedure_id"))


def vector_hits(bodies: DataFrame, query: str, index=None) -> DataFrame:
    """Nodes by TF-IDF, out of a stored index of their bodies if there is one."""
    found = index.tfidf_top(query) if index else retrieval.tfidf_search(
        bodies, "event_id", F.col("body"), query)
    return found.select("event_id", (P.QUERY_FLOOR + P.QUERY_GAIN * F.col("similarity")).alias("q"))


def bm25_hits(graph: Graph, query: str, as_of, log: DataFrame, index=None) -> DataFrame:
    """Nodes of the events that a search of the log ranks first."""
    found = retrieval.search(log, query, as_of, k=8, index=index)
    weight = P.QUERY_FLOOR + P.QUERY_GAIN * F.col("relevance")
    return (found.select("seq", weight.alias("q"))
            .join(graph.nodes.select("seq", "event_id"), "seq").select("event_id", "q"))


def body_hits(bodies: DataFrame, query: str) -> DataFrame:
    """Nodes whose text contains the query."""
    return (bodies.filter(F.lower("body").contains(query.lower()))
            .select("event_id", F.lit(P.SUBSTRING_SEED).alias("q")))


def query_hits(graph: Graph, query: str, as_of, log: DataFrame | None = None,
               body_index=None, log_index=None) -> DataFrame:
    """Node hits of a query: TF-IDF vectors, else BM25, else substring.

    Each tier yields at most eight rows but the last, so asking whether one is
    empty is cheap.
    """
    bodies = graph.nodes.select("event_id", "body")
    hits = stage(vector_hits(bodies, query, body_index), "query-hits")
    if hits.isEmpty() and log is not None:
        hits = stage(bm25_hits(graph, query, as_of, log, log_index), "query-hits")
    return body_hits(bodies, query) if hits.isEmpty() else hits


def seeds(graph: Graph, as_of, query: str = "", agent: str = "",
          threads: list[str] | None = None, incubation: DataFrame | None = None,
          log: DataFrame | None = None, body_index=None, log_index=None) -> DataFrame:
    """Every node with its base and seed activation.

    Floors combine by maximum, role and lane boosts add on top, query hits raise
    the result, cold nodes lose it, and incubation may lift them again. All
    sources meet in one aggregation per event.
    """
    active = graph.threads.filter(F.col("status") == "active").select("thread_id")
    live = (graph.membership.join(active, "thread_id", "left_semi")
            .select("event_id", F.lit(P.ACTIVE_SEED).alias("floor")))
    due = triggered_procedures(graph, query).select(
        F.col("procedure_id").alias("event_id"),
        (P.PROCEDURE_SEED * F.col("outcome_score")).alias("floor"))
    parts = live.unionByName(due)
    if threads:
        lane = graph.membership.filter(F.col("thread_id").isin(threads))
        parts = parts.unionByName(
            lane.select("event_id", F.lit(P.ASSIGNED_SEED).alias("boost")), allowMissingColumns=True)
    if query:
        parts = parts.unionByName(
            query_hits(graph, query, as_of, log, body_index, log_index), allowMissingColumns=True)
    if incubation is not None:
        parts = parts.unionByName(
            incubation.select("event_id", (P.INCUBATION_WEIGHT * F.col("lift")).alias("lift")),
            allowMissingColumns=True)
    for name in ("floor", "boost", "q", "lift"):
        if name not in parts.columns:
            parts = parts.withColumn(name, F.lit(None).cast("double"))
    summed = parts.groupBy("event_id").agg(
        F.max("floor").alias("floor"), F.sum("boost").alias("boost"),
        F.max("q").alias("q"), F.max("lift").alias("lift"))

    ty, memory = F.col("type"), F.col("seq").isNull()
    own = (F.when(memory & (ty == "concept"), P.CONCEPT_SEED * F.col("importance"))
           .when(memory & (ty == "pattern"), P.PATTERN_SEED * F.col("importance")))
    floor = F.greatest("floor", own, F.when(F.col("unresolved") == 1, P.UNRESOLVED_SEED))
    focus = P.ROLE_TYPES.get((agent or "").lower(), [])
    role = F.when(ty.isin(focus), P.ROLE_SEED) if focus else F.lit(None).cast("double")
    boosts = F.coalesce(role + F.col("boost"), role, F.col("boost"))
    raised = F.coalesce(floor + boosts, floor, boosts)
    warm = F.when(F.col("cold") == 0, F.greatest(raised, F.col("q")))
    seed = F.coalesce(F.greatest(warm, F.col("lift")), F.lit(0.0))
    return (graph.nodes.join(summed, "event_id", "left")
            .select("event_id", S.base_activation(
                F.col("importance"), F.col("ts"), F.col("unresolved"), F.col("reinforced"),
                as_of).alias("base"), seed.alias("seed")))


def adjacency(edges: DataFrame, causal_back: float = P.CAUSAL_BACK) -> DataFrame:
    """(v, u, w): what v receives from u. Parallel edges add up.

    An effect gives its cause full weight; the way back is weaker.
    """
    return links(edges, causal_back).select("v", "u", "w")


def links(edges: DataFrame, causal_back: float = P.CAUSAL_BACK) -> DataFrame:
    """(v, u, w, even): ``adjacency``, and beside it the weight with ways back as strong.

    Windows over one graph read one such table, staged once.
    """
    e = edges.filter(~F.col("kind").isin(THREAD_KINDS))
    w = F.col("weight")
    back = F.when(F.col("kind") == "causal", w * causal_back).otherwise(w)
    return (e.select(F.col("src").alias("v"), F.col("dst").alias("u"), w.alias("w"), w.alias("even"))
            .unionByName(e.select(F.col("dst").alias("v"), F.col("src").alias("u"),
                                  back.alias("w"), w.alias("even")))
            .groupBy("v", "u").agg(F.sum("w").alias("w"), F.sum("even").alias("even")))


def received(adj: DataFrame, act: DataFrame) -> DataFrame:
    """Weighted neighbour activation per node."""
    flow = adj.join(act.select(F.col("event_id").alias("u"), "activation"), "u")
    return flow.groupBy(F.col("v").alias("event_id")).agg(
        F.sum(F.col("w") * F.col("activation")).alias("flow"))


def spread(nodes: DataFrame, adj: DataFrame, hops: int = P.HOPS) -> DataFrame:
    """Bounded spreading activation; ``nodes`` holds event_id, base and seed."""
    act = nodes.withColumn("activation", F.col("base") + F.col("seed"))
    for _ in range(hops):
        flow = F.coalesce("flow", F.lit(0.0))
        act = nodes.join(received(adj, act), "event_id", "left").select(
            "event_id", "base", "seed",
            (P.BETA * F.col("base") + P.GAMMA * P.HOP_DECAY * flow + F.col("seed"))
            .alias("activation"))
    return act


def inhibit(act: DataFrame, rivals: DataFrame, rounds: int = P.INHIBITION_ROUNDS) -> DataFrame:
    """Lateral inhibition of rival pairs, all updates of a round simultaneous.

    Only contested nodes take part. A node's own score and its rivals' scores
    arrive over one join per round, through a self link of weight one.
    """
    ends = rivals.select("src", "dst").join(
        act.select(F.col("event_id").alias("src")), "src", "left_semi").join(
        act.select(F.col("event_id").alias("dst")), "dst", "left_semi")
    ends = stage(ends, "rivals")
    both = ends.unionByName(ends.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    pull = (both.select(F.col("src").alias("v"), F.col("dst").alias("u"),
                        F.lit(-P.INHIBITION).alias("w"))
            .groupBy("v", "u").agg(F.sum("w").alias("w")))
    contested = both.select(F.col("src").alias("v")).distinct()
    links = pull.unionByName(contested.select("v", F.col("v").alias("u"), F.lit(1.0).alias("w")))
    links = stage(links, "rival-links")
    now = act.select("event_id", "activation").join(
        contested.select(F.col("v").alias("event_id")), "event_id", "left_semi")
    for _ in range(rounds):
        now = received(links, now).select(
            "event_id", F.greatest(F.lit(0.0), F.col("flow")).alias("activation"))
    settled = now.withColumnRenamed("activation", "settled")
    return act.join(settled, "event_id", "left").withColumn(
        "activation", F.coalesce("settled", "activation")).drop("settled")


def contradiction_scores(act: DataFrame, rivals: DataFrame) -> DataFrame:
    def side(name: str) -> DataFrame:
        return act.select(F.col("event_id").alias(name),
                          S.rounded(F.col("activation")).alias(f"{name}_score"))
    return rivals.join(side("src"), "src").join(side("dst"), "dst").select(
        "src", "dst", "src_score", "dst_score")


def blend(act: DataFrame, previous: DataFrame) -> DataFrame:
    """Attention persistence, when the agent has a previous state."""
    any_rows = previous.agg(F.count(F.lit(1))).scalar()
    prev = previous.select("event_id", F.col("activation").alias("prev"))
    mixed = (P.ALPHA * F.col("activation")
             + (1 - P.ALPHA) * F.coalesce("prev", F.lit(0.0)))
    return act.join(prev, "event_id", "left").withColumn(
        "activation", F.when(any_rows > 0, mixed).otherwise(F.col("activation"))).drop("prev")


def thread_peaks(act: DataFrame, members: DataFrame) -> DataFrame:
    return (members.join(act.select("event_id", "activation"), "event_id")
            .groupBy("thread_id").agg(F.max("activation").alias("peak")))


def oscillate(act: DataFrame, members: DataFrame) -> DataFrame:
    """Dampen the leading thread's members and lift the runner-up's."""
    order = Window.orderBy(F.desc("peak"), "thread_id")
    top = (thread_peaks(act, members).filter(F.col("peak") > 0)
           .orderBy(F.desc("peak"), "thread_id").limit(2)
           .select("thread_id", "peak", F.row_number().over(order).alias("place")))
    top = stage(top, "oscillation")  # two rows
    pair = _n(top) == 2
    lift = P.OSC_LIFT * top.agg(F.max("peak")).scalar()
    places = (members.join(top, "thread_id").groupBy("event_id")
              .agg(F.max((F.col("place") == 1).cast("int")).alias("win"),
                   F.max((F.col("place") == 2).cast("int")).alias("run")))
    damped = F.when(F.col("win") == 1, F.col("activation") * (1 - P.OSC_INHIBIT)
                    ).otherwise(F.col("activation"))
    turned = damped + F.when(F.col("run") == 1, lift).otherwise(0.0)
    return act.join(places, "event_id", "left").withColumn(
        "activation", F.when(pair, turned).otherwise(F.col("activation"))).drop("win", "run")


def _n(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


def resurface(act: DataFrame, members: DataFrame, threads: DataFrame):
    """(threads, act): dormant threads reached by attention rise with their events.

    Scores come from the state before any lift, so thread order is irrelevant.
    """
    score = F.coalesce("peak", F.lit(0.0))
    woken = (F.col("status") == "dormant") & (score > P.RESURFACE_FLOOR)
    scored = threads.join(thread_peaks(act, members), "thread_id", "left").select(
        "thread_id", "status", woken.cast("int").alias("resurfaced"),
        S.rounded(score + F.when(woken, P.RESURFACE_BONUS).otherwise(0.0)).alias("activation"))
    lifts = (members.join(scored.filter(F.col("resurfaced") == 1), "thread_id", "left_semi")
             .groupBy("event_id").agg((F.count(F.lit(1)) * (P.RESURFACE_BONUS * 0.5)).alias("up")))
    lifted = act.join(lifts, "event_id", "left").withColumn(
        "activation", F.col("activation") + F.coalesce("up", F.lit(0.0))).drop("up")
    return scored, lifted


def attend(graph: Graph, as_of, query: str = "", agent: str = "",
           threads: list[str] | None = None, previous: DataFrame | None = None,
           incubation: DataFrame | None = None, rotate: bool = False,
           log: DataFrame | None = None, body_index=None, log_index=None,
           linked: DataFrame | None = None) -> Attention:
    """The full attention pass of one agent window; ``linked`` are staged ``links`` of the graph."""
    first = seeds(graph, as_of, query, agent, threads, incubation, log, body_index, log_index)
    if linked is None:
        nodes, linked = stage_all(seeds=first, links=adjacency(graph.edges))
    else:
        nodes = stage(first, "seeds")
    adj = linked.select("v", "u", "w")
    act = stage(spread(nodes, adj), "spread")
    act = stage(inhibit(act, graph.contradictions), "inhibited")
    tensions = contradiction_scores(act, graph.contradictions)
    if previous is not None:
        act = blend(act, previous)
    if rotate:
        act = stage(act, "blended")
        act = oscillate(act, graph.membership)
    if previous is not None or rotate:
        act = stage(act, "settled")
    scored, act = resurface(act, graph.membership, graph.threads)
    out = act.select("event_id", "base", S.rounded(F.col("seed")).alias("seed"),
                     S.rounded(F.col("activation")).alias("activation"))
    return Attention(out, scored, tensions)


def top_nodes(graph: Graph, act: DataFrame, n: int) -> DataFrame:
    rows = act.join(graph.nodes.select("event_id", "seq", "type", "layer", "body", "t"), "event_id")
    return rows.orderBy(F.desc("activation"), F.asc_nulls_last("seq"), "event_id").limit(n)


def active_subgraph(graph: Graph, act: DataFrame, top_n: int = 8) -> DataFrame:
    """The most active nodes and everything within two hops, through threads too."""
    core = stage(top_nodes(graph, act, top_n).select(F.col("event_id").alias("id")), "core")
    ends = graph.edges.select("src", "dst")

    def step(front: DataFrame) -> DataFrame:
        out = ends.join(front.select(F.col("id").alias("src")), "src", "left_semi").select(
            F.col("dst").alias("id"))
        into = ends.join(front.select(F.col("id").alias("dst")), "dst", "left_semi").select(
            F.col("src").alias("id"))
        return out.unionByName(into).distinct()

    near = stage(step(core), "hop-1")
    reached = core.unionByName(near).unionByName(step(near)).distinct()
    rows = graph.nodes.join(reached.withColumnRenamed("id", "event_id"), "event_id", "left_semi")
    return rows.join(act.select("event_id", "activation"), "event_id").select(
        "event_id", "seq", "type", "layer", "body", "t", "activation")


def incubate(graph: Graph, linked: DataFrame | None = None) -> DataFrame:
    """Query-less low-gain diffusion from well-connected members of dormant threads.

    ``linked`` are staged ``links`` of the graph.
    """
    ends = graph.edges.select(F.col("src").alias("event_id")).unionByName(
        graph.edges.select(F.col("dst").alias("event_id")))
    degree = ends.groupBy("event_id").agg(F.count(F.lit(1)).alias("degree"))
    asleep = graph.threads.filter(F.col("status") == "dormant").select("thread_id")
    dormant = (graph.membership.join(asleep, "thread_id", "left_semi")
               .select("event_id").distinct())
    pull = P.INCUBATE_SEED * (1.0 - F.exp(-F.coalesce("degree", F.lit(0)) / F.lit(5.0)))
    seed = dormant.join(degree, "event_id", "left").select("event_id", pull.alias("activation"))
    if linked is None:
        seed, linked = stage_all(incubation_seed=seed, incubation_links=links(graph.edges))
    else:
        seed = stage(seed, "incubation_seed")
    adj = linked.select("v", "u", F.col("even").alias("w"))
    act = seed
    for _ in range(P.INCUBATE_ROUNDS):
        inflow = received(adj, act).select(
            "event_id", (P.INCUBATE_GAMMA * F.col("flow")).alias("activation"))
        act = (inflow.unionByName(seed).groupBy("event_id")
               .agg(F.sum("activation").alias("activation"))
               .join(graph.nodes.select("event_id"), "event_id", "left_semi"))
    return act.filter(F.col("activation") > P.INCUBATE_FLOOR).select(
        "event_id", S.rounded(F.col("activation")).alias("lift"))


def resolve(graph: Graph, attention: Attention, log: DataFrame) -> DataFrame:
    """Verdicts on contradictions whose rivals are clearly apart."""
    a, b = F.col("src_score"), F.col("dst_score")
    wins = a >= b
    rows = attention.contradictions.withColumn("decided", F.abs(a - b) >= P.RESOLVE_MARGIN)
    rows = rows.select(
        "decided", "src_score", "dst_score",
        F.when(wins, F.col("src")).otherwise(F.col("dst")).alias("winner"),
        F.when(wins, F.col("dst")).otherwise(F.col("src")).alias("loser"))
    meta = graph.nodes.select("event_id", "type", "body")
    # A node is the last event of its id, so the last loop names it: one row for each id.
    loop_ids = log.filter(F.col("type") == "open_loop").groupBy(
        log_ops.event_key().alias("loser")).agg(F.max_by("id", "seq").alias("id"))
    rows = (
        rows.join(meta.select(F.col("event_id").alias("loser"), F.col("type").alias("l_type")),
                  "loser", "left")
        .join(meta.select(F.col("event_id").alias("winner"), F.col("body").alias("w_body")),
              "winner", "left")
        .join(loop_ids, "loser", "left"))
    closes = F.col("l_type") == "open_loop"
    kind = F.when(~F.col("decided"), "undecided").when(closes, "loop_closed").otherwise(
        "assumption_invalidated")
    reason = F.concat(F.when(closes, "superseded by ").otherwise("resolved in favor of "),
                      "winner", F.lit(": "),
                      F.substring(F.coalesce("w_body", "winner"), 1, 80))
    return rows.select(
        kind.alias("type"), "winner", "loser", "src_score", "dst_score",
        F.when(closes & F.col("decided"), F.coalesce("id", "loser")).alias("id"),
        F.when(F.col("decided"), reason).alias("msg"))


def agent_lane(thread_act: DataFrame, threads: DataFrame, limit: int = 4) -> DataFrame:
    """An agent's top threads, else active ones while it has no attention state."""
    own = thread_act.orderBy(F.desc("activation"), "thread_id").limit(limit).select("thread_id")
    cold = (threads.filter(F.col("status") == "active").orderBy("thread_id").limit(limit)
            .select("thread_id"))
    has_own = _n(own) > 0
    return (own.withColumn("use", has_own).unionByName(cold.withColumn("use", ~has_own))
            .filter("use").select("thread_id"))
