"""Consolidation passes: concepts, procedures, patterns, promotion, retirement.

Each pass returns proposals as a DataFrame and, where a proposal cites events,
the citations as a second, long DataFrame, since a citation list may be large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions import text as X
from mnemograph.functions.scoring import truthy
from mnemograph.operators import log_ops, retrieval
from mnemograph.operators.graph import Graph
from mnemograph.operators.ordered import lags, running_sums
from mnemograph.session import stage


def _n(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1))).scalar()


# -- concepts -------------------------------------------------------------------

def recurring_terms(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """Terms by document support, generic ones dropped once the corpus is large."""
    found = docs.select(key, F.explode(X.terms(text)).alias("term"))
    support = found.groupBy("term").agg(F.count(F.lit(1)).alias("support")).filter(
        F.col("support") >= P.ABSTRACT_MIN_SUPPORT)
    n = F.col("n")
    large = n >= P.ABSTRACT_IDF_MIN_DOCS
    return (
        support.withColumn("n", _n(docs))
        .filter(~large | (F.col("support") / n <= P.ABSTRACT_MAX_DF_RATIO))
        .select("term", "support", S.rounded(
            F.when(large, F.col("support") * F.ln(n / F.col("support")))
            .otherwise(F.col("support").cast("double"))).alias("score")))


def abstract(docs: DataFrame, key: str, text: Column, existing: DataFrame | None = None,
             cap: int = P.ABSTRACT_MAX_NEW):
    """(proposals, evidence) of new concepts from recurring terms."""
    cands = recurring_terms(docs, key, text).withColumn(
        "concept_id", F.concat(F.lit("cpt_"), X.slug(F.col("term"))))
    if existing is not None:
        cands = cands.join(existing.select("concept_id"), "concept_id", "left_anti")
    top = stage(cands.orderBy(F.desc("score"), "term").limit(cap), "concept-proposals")
    found = docs.select(F.col(key).alias("event_id"), F.explode(X.terms(text)).alias("term"))
    evidence = found.join(top.select("term", "concept_id"), "term").select(
        "concept_id", "event_id")
    proposals = top.select(
        "concept_id", "term", "support", "score",
        F.concat("term", F.lit(" — recurring concept across "), "support",
                 F.lit(" episodes")).alias("summary"))
    return proposals, evidence


def abstract_graph(graph: Graph):
    episodes = graph.nodes.filter(F.col("type").isin(P.ABSTRACT_TYPES)
                                  & F.col("seq").isNotNull())
    return abstract(episodes, "event_id", F.col("body"), graph.concepts)


# -- step signatures ------------------------------------------------------------

def member_events(graph: Graph) -> DataFrame:
    """Graph events with their threads; distilled memory has no seq and is out."""
    return graph.nodes.filter(F.col("seq").isNotNull()).select(
        "event_id", "seq", "type", "body", "unresolved").join(graph.membership, "event_id")


def success_threads(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("type") == "loop_closed").select("thread_id").distinct()


def thread_signatures(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(thread_id, steps, sig1, sig2): two hashes of each success thread's step sequence.

    A hash over (place, leading term) sums up a sequence without gathering it,
    so a thread with any number of steps is compared by one row.
    """
    steps = (
        rows.filter(F.col("type").isin(P.PROC_STEP_TYPES))
        .join(success_threads(rows), "thread_id", "left_semi")
        .select("thread_id", "seq", X.lead_term(F.col("body")).alias("term")))
    placed = running_sums(steps, "seq", {"place": F.lit(1)}, ("thread_id",), block)
    return (
        placed.groupBy("thread_id")
        .agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.col("term") == "").alias("blank"),
             F.bit_xor(F.xxhash64("place", "term")).alias("sig1"),
             F.bit_xor(F.xxhash64("term", "place", F.lit(7))).alias("sig2"))
        .filter((F.col("steps") >= P.PROC_MIN_STEPS) & (F.col("blank") == 0)).drop("blank"))


SIGNATURE = ["steps", "sig1", "sig2"]


def recurring_paths(rows: DataFrame, min_threads: int, block: int | None = None):
    """(paths, path_threads): signatures shared by threads, with their terms.

    Only a recurring signature gets its terms spelled out, from one thread; the step
    texts are read for the paths that are proposed (``step_texts``).
    """
    signed = stage(thread_signatures(rows, block), "signatures")
    groups = (signed.groupBy(*SIGNATURE)
              .agg(F.count(F.lit(1)).alias("support"), F.min("thread_id").alias("thread_id"))
              .filter(F.col("support") >= min_threads))
    spelled = (
        rows.filter(F.col("type").isin(P.PROC_STEP_TYPES))
        .join(groups, "thread_id")
        .groupBy(*SIGNATURE, "support", "thread_id")
        .agg(F.array_sort(F.collect_list(F.struct(
            "seq", X.lead_term(F.col("body")).alias("term")))).alias("s")))
    paths = stage(spelled.select(
        *SIGNATURE, "support", "thread_id", F.col("s.term").alias("terms")), "paths")
    threads = signed.join(paths.select(*SIGNATURE), SIGNATURE, "left_semi")
    return paths, threads


def step_texts(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """(thread_id, step_texts) of the threads in ``chosen``, a list already cut."""
    return (
        rows.filter(F.col("type").isin(P.PROC_STEP_TYPES))
        .join(chosen.select("thread_id").distinct(), "thread_id", "left_semi")
        .groupBy("thread_id")
        .agg(F.array_sort(F.collect_list(F.struct("seq", F.concat(
            "type", F.lit(": "), F.substring("body", 1, 80)).alias("step")))).alias("s"))
        .select("thread_id", F.col("s.step").alias("step_texts")))


def _path(terms: Column) -> Column:
    return F.array_join(terms, " → ")


def learn(graph: Graph, cap: int = P.PROC_MAX_NEW, block: int | None = None):
    """(proposals, evidence) of procedures from successful recurring workflows."""
    rows = member_events(graph)
    paths, threads = recurring_paths(rows, P.PROC_MIN_SUPPORT, block)
    named = paths.withColumn(
        "procedure_id", F.concat(F.lit("prc_"), X.slug(F.array_join("terms", "-"))))
    fresh = named.join(graph.procedures.select("procedure_id"), "procedure_id", "left_anti")
    top = stage(fresh.orderBy(F.desc("support"), _path(F.col("terms"))).limit(cap), "learned")
    chosen = threads.join(top.select(*SIGNATURE, "procedure_id"), SIGNATURE).select(
        "thread_id", "procedure_id")
    in_paths = rows.join(chosen, "thread_id")
    cues = (
        in_paths.filter(F.col("type").isin(P.PROC_TRIGGER_TYPES))
        .select("procedure_id", F.explode(X.terms(F.col("body"))).alias("term")).distinct()
        .groupBy("procedure_id").agg(F.array_sort(F.collect_list("term")).alias("cues")))
    steps = step_texts(rows, top)
    proposals = top.join(steps, "thread_id").join(cues, "procedure_id", "left").select(
        "procedure_id", F.concat(F.lit("workflow: "), _path(F.col("terms"))).alias("label"),
        F.coalesce("cues", F.slice("terms", 1, 1)).alias("trigger"),
        F.col("step_texts").alias("steps"), "support")
    evidence = in_paths.filter(F.col("type").isin(P.PROC_STEP_TYPES)).select(
        "procedure_id", "event_id").distinct()
    return proposals, evidence


# -- patterns -------------------------------------------------------------------

def reasoning_motifs(rows: DataFrame, block: int | None = None) -> DataFrame:
    """(gram, thread_id) of runs of three reasoning types within a thread."""
    kept = rows.filter(F.col("type").isin(P.REASON_TYPES)).select("thread_id", "seq", "type")
    laid = lags(kept, "seq", "type", P.MOTIF_LEN - 1, ("thread_id",), block)
    return (laid.filter(F.col("lag_2").isNotNull())
            .select(F.array("lag_2", "lag_1", "type").alias("gram"), "thread_id").distinct())


def failure_terms(rows: DataFrame) -> DataFrame:
    """(term, thread_id, event_id) of failed or unresolved work."""
    failed = F.col("type").isin(P.FAILURE_TYPES) | (
        (F.col("type") == "open_loop") & (F.col("unresolved") == 1))
    return (rows.filter(failed)
            .select(X.lead_term(F.col("body")).alias("term"), "thread_id", "event_id")
            .filter(F.col("term") != ""))


def bottlenecks(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Events many others depend on, inside a thread with unresolved work."""
    deps = (edges.filter(F.col("kind") == "causal").groupBy(F.col("src").alias("event_id"))
            .agg(F.count(F.lit(1)).alias("deps"))
            .filter(F.col("deps") >= P.BOTTLENECK_MIN_DEPS))
    stuck = rows.filter(F.col("unresolved") == 1).select("thread_id").distinct()
    return (rows.join(deps, "event_id").join(stuck, "thread_id", "left_semi")
            .groupBy("event_id", "seq", "body", "deps")
            .agg(F.min("thread_id").alias("thread_id")))


def confidence(support: Column) -> Column:
    return S.rounded(F.least(F.lit(0.95), 0.5 + 0.1 * (support - 1)))


def mine(graph: Graph, cap: int = P.PATTERN_MAX_NEW, block: int | None = None):
    """(proposals, evidence) of recurring reasoning, failure, success and bottleneck patterns."""
    rows = stage(member_events(graph), "member-events")
    motifs = stage(reasoning_motifs(rows, block), "motifs")
    fails = failure_terms(rows)
    paths, path_threads = recurring_paths(rows, P.PATTERN_MIN_SUPPORT, block)
    stops = stage(bottlenecks(rows, graph.causal), "bottlenecks")

    def proposal(df: DataFrame, place: int, kind: str, tail: Column, label: Column,
                 order: Column, order2: Column, key: Column, advice: Column) -> DataFrame:
        return df.select(
            F.concat(F.lit(f"pat_{tail_name[kind]}_"), X.slug(tail)).alias("pattern_id"),
            F.lit(kind).alias("kind"), label.alias("label"), F.col("support"),
            F.lit(place).alias("place"), order.cast("string").alias("o1"),
            order2.alias("o2"), key.alias("key"), advice.alias("advice"))

    tail_name = {"reasoning": "reason", "failure": "fail", "success": "success",
                 "bottleneck": "bottleneck"}
    blank, down = F.lit(""), F.lpad((F.lit(10**15) - F.col("support")).cast("string"), 16, "0")
    gram = F.array_join("gram", " → ")
    reason = motifs.groupBy("gram").agg(F.count(F.lit(1)).alias("support"))
    failure = fails.groupBy("term").agg(F.count_distinct("thread_id").alias("support"))
    cands = (
        proposal(reason, 1, "reasoning", F.array_join("gram", "-"),
                 F.concat(F.lit("reasoning structure: "), gram), down, gram, gram,
                 F.concat(F.lit("recurring reasoning path "), gram,
                          F.lit(" — reuse or examine it")))
        .unionByName(proposal(
            failure, 2, "failure", F.col("term"),
            F.concat(F.lit("recurring failure mode: '"), "term", F.lit("'")), down,
            F.col("term"), F.col("term"),
            F.concat(F.lit("'"), "term", F.lit("' recurs as a failure — add a guard / check "
                                               "earlier"))))
        .unionByName(proposal(
            paths, 3, "success", F.array_join("terms", "-"),
            F.concat(F.lit("successful path: "), _path(F.col("terms"))), down,
            _path(F.col("terms")), F.col("thread_id"),
            F.lit("recurring successful execution path — promote to a procedure")))
        .filter(F.col("support") >= P.PATTERN_MIN_SUPPORT)
        .unionByName(proposal(
            stops.withColumn("support", F.col("deps")), 4, "bottleneck", F.col("event_id"),
            F.concat(F.lit("bottleneck: "),
                     F.substring(F.coalesce(truthy(F.col("body")), "event_id"), 1, 60)),
            F.col("thread_id"), F.lpad(F.col("seq").cast("string"), 20, "0"), F.col("event_id"),
            F.concat("support", F.lit(" causal dependents and the thread is unresolved — "
                                      "unblock first"))))
        .join(graph.patterns.select("pattern_id"), "pattern_id", "left_anti"))
    once = Window.partitionBy("pattern_id").orderBy("place", "o1", "o2")
    top = stage(cands.withColumn("dup", F.row_number().over(once)).filter(F.col("dup") == 1)
                .orderBy("place", "o1", "o2").limit(cap), "pattern-proposals")
    proposals = top.select(
        "pattern_id", "kind", "label",
        confidence(F.col("support")).alias("confidence"), F.col("support").alias("frequency"),
        F.array("advice").alias("recommended"))

    def of(kind: str) -> DataFrame:
        return top.filter(F.col("kind") == kind).select("pattern_id", "key")

    rep = paths.select(F.col("thread_id").alias("key"), *SIGNATURE).join(of("success"), "key")
    thread_refs = path_threads.join(rep.select("pattern_id", *SIGNATURE), SIGNATURE).select(
        "pattern_id", "thread_id")
    step_refs = rows.filter(F.col("type").isin(P.PROC_STEP_TYPES)).join(
        thread_refs, "thread_id").select("pattern_id", F.col("event_id").alias("ref_id"))
    evidence = (
        motifs.select(F.array_join("gram", " → ").alias("key"), F.col("thread_id").alias("ref_id"))
        .join(of("reasoning"), "key").select("pattern_id", "ref_id")
        .unionByName(fails.select(F.col("term").alias("key"), F.col("event_id").alias("ref_id"))
                     .join(of("failure"), "key").select("pattern_id", "ref_id"))
        .unionByName(step_refs)
        .unionByName(thread_refs.select("pattern_id", F.col("thread_id").alias("ref_id")))
        .unionByName(of("bottleneck").select("pattern_id", F.col("key").alias("ref_id")))
        .distinct())
    return proposals, evidence


# -- promotion and retirement ---------------------------------------------------

def promote(graph: Graph, log: DataFrame, cap: int = P.PROMOTE_MAX_NEW):
    """(proposals, evidence) of procedures seeded from confident success patterns.

    A pattern promoted once is never promoted again, so a retirement sticks.
    """
    done = (log.filter(F.col("type") == "pattern_promoted").select("pattern_id")
            .filter(F.col("pattern_id").isNotNull()).distinct())
    top = stage(
        graph.patterns.filter((F.col("kind") == "success")
                              & (F.col("confidence") >= P.PROMOTE_CONF_FLOOR))
        .join(done, "pattern_id", "left_anti")
        .orderBy(F.desc("confidence"), "pattern_id").limit(cap), "promotions")
    refs = graph.pattern_evidence.join(top.select("pattern_id"), "pattern_id", "left_semi")
    lanes = refs.filter(F.col("ref_kind") == "thread").select(
        "pattern_id", F.col("ref_id").alias("thread_id"))
    cues = (
        member_events(graph).filter(F.col("type").isin(P.PROC_TRIGGER_TYPES))
        .join(lanes, "thread_id")
        .select("pattern_id", F.explode(X.terms(F.col("body"))).alias("term")).distinct()
        .groupBy("pattern_id").agg(F.array_sort(F.collect_list("term")).alias("cues")))
    name = F.regexp_replace("pattern_id", "^pat_success_", "")
    after = F.when(F.instr("label", ":") > 0,
                   F.regexp_replace("label", "^[^:]*:", "")).otherwise(F.col("label"))
    steps = F.filter(F.transform(F.split(after, "→"), lambda s: F.trim(s)), lambda s: s != "")
    label = F.when(F.col("label").startswith("successful path:"),
                   F.regexp_replace("label", "^successful path:", "promoted workflow:")
                   ).otherwise(F.col("label"))
    proposals = top.join(cues, "pattern_id", "left").select(
        "pattern_id", F.concat(F.lit("prc_"), X.slug(name)).alias("procedure_id"),
        label.alias("label"), steps.alias("steps"),
        F.coalesce("cues", F.slice(steps, 1, 1)).alias("trigger"),
        S.rounded(F.col("confidence")).alias("confidence"))
    evidence = (refs.filter(F.col("ref_kind").isin("event", "thread"))
                .select("pattern_id", "ref_id")
                .unionByName(top.select("pattern_id", F.col("pattern_id").alias("ref_id"))))
    return proposals, evidence


def prune(graph: Graph, cap: int = P.PRUNE_MAX) -> DataFrame:
    """Concepts whose evidence is all cold and uncited by an active thread."""
    active = graph.threads.filter(F.col("status") == "active").select("thread_id")
    cited = (graph.membership.join(active, "thread_id", "left_semi")
             .select("event_id", F.lit(1).alias("cited")).distinct())
    rows = (graph.concept_evidence.join(graph.nodes.select("event_id", "cold"), "event_id", "left")
            .join(cited, "event_id", "left"))
    stale = (
        rows.groupBy("concept_id")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.coalesce("cold", F.lit(0))).alias("all_cold"),
             F.max(F.coalesce("cited", F.lit(0))).alias("any_cited"))
        .filter((F.col("all_cold") == 1) & (F.col("any_cited") == 0)))
    reason = F.concat(F.lit("stale: all "), "n",
                      F.lit(" evidence episodes cold, no active citation"))
    return stale.orderBy("concept_id").limit(cap).select("concept_id", reason.alias("reason"))


def retire_procedures(procedures: DataFrame, cap: int = P.PROC_RETIRE_MAX) -> DataFrame:
    failing = (F.col("uses") >= P.PROC_RETIRE_MIN_USES) & (
        F.coalesce("outcome_score", F.lit(0.5)) < P.PROC_RETIRE_SCORE)
    reason = F.concat(F.lit("chronic failure: outcome_score "),
                      S.rounded(F.col("outcome_score"), 3).cast("string"), F.lit(" after "),
                      "uses", F.lit(" executions"))
    return procedures.filter(failing).orderBy("procedure_id").limit(cap).select(
        "procedure_id", reason.alias("reason"))


# -- self-assessment --------------------------------------------------------------

def introspect(graph: Graph, log: DataFrame, activation: DataFrame) -> DataFrame:
    """Five health metrics, their mean as confidence, and the nudges they call for.

    ``activation`` holds the stored base and activation of one agent; metrics
    without a signal are null and left out of the mean.
    """
    rows = activation.select("event_id", "base", "activation").join(
        graph.nodes.select("event_id", "reinforced", "cold"), "event_id")
    primed, active = F.col("base") > 0, F.col("activation") > 0
    noisy = active & ((F.col("cold") == 1) | (F.col("activation") <= P.META_POLLUTION_FLOOR))

    def ratio(part: Column, whole: Column) -> Column:
        return F.when(F.count_if(whole) > 0, S.rounded(F.count_if(part) / F.count_if(whole)))

    use = rows.agg(ratio(primed & (F.col("reinforced") > 0), primed).alias("eff"),
                   ratio(noisy, active).alias("pol"))
    proc = graph.procedures.filter(F.col("uses") >= 1).agg(
        S.rounded(F.avg("outcome_score")).alias("p"))
    one = use.select(
        F.col("eff").alias("retrieval_effectiveness"),
        proc.scalar().alias("procedural_success"),
        retrieval.drift(log).select("drift").scalar().alias("cognitive_drift"),
        F.col("pol").alias("context_pollution"),
        log_ops.topic_shift_churn(log).select("instability").scalar()
        .alias("attention_instability"))
    return assessed(one)


def assessed(metrics: DataFrame) -> DataFrame:
    """Adds ``confidence`` and ``nudges`` to a row of the five metrics."""
    eff, proc, drift, pol, inst = (F.col(c) for c in (
        "retrieval_effectiveness", "procedural_success", "cognitive_drift",
        "context_pollution", "attention_instability"))
    steady = F.when(drift.isNotNull(), 1.0 - F.least(F.lit(1.0), drift))
    health = F.array_compact(F.array(eff, proc, steady, 1.0 - pol, 1.0 - inst))
    total = F.aggregate(health, F.lit(0.0), lambda s, x: s + x)
    nudges = F.array_compact(F.array(
        F.when(eff < P.META_RECALL_FLOOR, "widen_retrieval"),
        F.when(proc < P.META_PROC_FLOOR, "review_procedures"),
        F.when(drift >= P.DRIFT_THRESHOLD, "rerun_retrieval"),
        F.when(pol >= P.META_POLLUTION_CEIL, "trigger_compaction"),
        F.when(inst >= P.META_INSTABILITY_CEIL, "enable_incubation")))
    return metrics.select(
        "*", F.when(F.size(health) > 0, S.rounded(total / F.size(health))).alias("confidence"),
        nudges.alias("nudges"))
