"""Order-sensitive memory folds written as plain aggregations.

The state after the last event of a key depends on its history only through
last values, counts since the last explicit reset, and geometric sums. Those
aggregate partially before the shuffle, so a key holding a third of the log is
never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions.scoring import nonzero, truthy
from mnemograph.operators.ordered import running_sums


def _keyed(log: DataFrame, field: str, types: list[str]) -> DataFrame:
    key = F.coalesce(truthy(F.col(field)), truthy(F.col("id")))
    return (log.filter(F.col("type").isin(types))
            .withColumn("key", key).filter(F.col("key").isNotNull()))


def _newest(value: Column, cond: Column) -> Column:
    """Newest non-null value among rows that satisfy ``cond``."""
    return F.max_by(value, F.when(cond & value.isNotNull(), F.col("seq")))


def _text(*fields: str) -> Column:
    return F.coalesce(*[truthy(F.col(f)) for f in fields])


def _filled(field: str) -> Column:
    return F.when(F.size(F.coalesce(F.col(field), F.array().cast("array<string>"))) > 0,
                  F.col(field))


def _first_refs(log: DataFrame) -> DataFrame:
    """(key, event_id, seq) of each reference's first citation by a concept."""
    rows = _keyed(log, "concept_id", ["concept_formed"])
    return (rows.select("key", "seq", F.explode("evidence").alias("event_id"))
            .groupBy("key", "event_id").agg(F.min("seq").alias("seq")))


def concept_evidence(log: DataFrame) -> DataFrame:
    """Evidence of concepts not retired since they were last formed."""
    rows = _keyed(log, "concept_id", ["concept_formed", "concept_retired"])
    live = (rows.groupBy("key").agg(F.max_by("type", "seq").alias("last_type"))
            .filter(F.col("last_type") == "concept_formed"))
    return _first_refs(log).join(live, "key", "left_semi").select(
        F.col("key").alias("concept_id"), "event_id")


def concepts(log: DataFrame, nodes: DataFrame, evidence: DataFrame, as_of,
             block: int | None = None) -> DataFrame:
    """Concepts from formed and retired events.

    Support obeys s = explicit, else max(distinct evidence so far, s + 1). With
    e(j) the distinct evidence after formation j of n and r the last explicit
    one, the final value is max(s(r) + n - r, max over j > r of e(j) + n - j).
    """
    rows = _keyed(log, "concept_id", ["concept_formed", "concept_retired"])
    formed = F.col("type") == "concept_formed"
    head = rows.groupBy("key").agg(
        _newest(_text("summary", "msg"), formed).alias("summary"),
        _newest(F.col("salience"), formed).alias("explicit_salience"),
        F.min_by("t", F.when(formed, F.col("seq"))).alias("formed_t"),
        F.max_by("type", "seq").alias("last_type"),
        _newest(F.col("support"), formed).alias("support_r"),
        F.max(F.when(formed & F.col("support").isNotNull(), F.col("seq"))).alias("seq_r"))
    live = head.filter(F.col("last_type") == "concept_formed")

    new_refs = _first_refs(log).groupBy("key", "seq").agg(F.count(F.lit(1)).alias("fresh"))
    steps = rows.filter(formed).select("key", "seq").join(new_refs, ["key", "seq"], "left")
    steps = running_sums(steps, "seq", {"j": F.lit(1), "e": F.col("fresh")}, ("key",), block)
    late = F.col("seq_r").isNull() | (F.col("seq") > F.col("seq_r"))
    growth = (
        steps.join(live.select("key", "seq_r"), "key")
        .groupBy("key")
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.when(late, F.col("e") - F.col("j"))).alias("g"),
             F.max(F.when(F.col("seq") == F.col("seq_r"), F.col("j"))).alias("r")))
    base = F.coalesce(F.col("support_r"), F.lit(0)) + F.col("n") - F.coalesce("r", F.lit(0))
    support = F.greatest(base, F.col("g") + F.col("n"))  # a null g is ignored

    freshest = (
        evidence.join(nodes.select("event_id", "ts"), "event_id")
        .groupBy(F.col("concept_id").alias("key")).agg(F.max("ts").alias("ev_ts")))
    out = live.join(growth, "key").join(freshest, "key", "left").withColumn("support", support)
    derived = S.rounded(F.least(F.lit(0.9), 0.4 + 0.1 * F.col("support"))
                        * (0.5 + 0.5 * S.recency(F.col("ev_ts"), as_of)))
    return out.select(
        F.col("key").alias("concept_id"), F.coalesce("summary", "key").alias("summary"),
        F.coalesce(nonzero(F.col("explicit_salience")), derived).alias("salience"),
        "support", "formed_t")


def procedures(log: DataFrame, block: int | None = None) -> DataFrame:
    """Procedures with the outcome score learned from executions.

    Each execution moves the score a quarter of the way to 1 or 0. From the
    last explicit score s over n later executions with targets t(i), the result
    is .75^n s + sum of .25 * .75^(n-i) t(i). Only the first step can clamp.
    """
    types = ["procedure_learned", "pattern_promoted", "proc_executed", "procedure_retired"]
    rows = _keyed(log, "procedure_id", types)
    ty, seq = F.col("type"), F.col("seq")
    seeds = ty.isin("procedure_learned", "pattern_promoted")
    run = ty == "proc_executed"
    head = rows.groupBy("key").agg(
        F.min(F.when(seeds, seq)).alias("first_seq"),
        F.max_by("type", F.when(~run, seq)).alias("last_mark"),
        _newest(_text("label", "summary", "msg"), seeds).alias("label"),
        _newest(_filled("trigger"), seeds).alias("trigger"),
        _newest(_filled("steps"), seeds).alias("steps"),
        F.count_if((ty == "procedure_learned") & (F.coalesce("part", F.lit(0)) == 0))
        .alias("learned"),
        _newest(F.col("outcome_score"), seeds).alias("score_r"),
        F.max(F.when(seeds & F.col("outcome_score").isNotNull(), seq)).alias("seq_r"),
        F.min_by("confidence", F.when((ty == "pattern_promoted")
                                      & F.col("confidence").isNotNull(), seq)).alias("conf_p"),
        F.min(F.when((ty == "pattern_promoted") & F.col("confidence").isNotNull(), seq))
        .alias("seq_p"),
        _newest(truthy(F.col("t")), seeds).alias("seed_t"),
        F.max(F.when(seeds & truthy(F.col("t")).isNotNull(), seq)).alias("seed_t_seq"),
    ).filter(F.col("first_seq").isNotNull() & (F.col("last_mark") != "procedure_retired"))

    target = F.when(F.lower(F.coalesce("outcome", F.lit("success"))).isin(P.FAILED_OUTCOMES), 0.0
                    ).otherwise(1.0)
    runs = (
        rows.filter(run).select("key", "seq", "t", target.alias("target"))
        .join(head.select("key", "first_seq", "seq_r"), "key")
        .filter(seq > F.col("first_seq"))
        .withColumn("counted", F.col("seq_r").isNull() | (seq > F.col("seq_r"))))
    placed = running_sums(runs, "seq", {"i": F.col("counted").cast("int")}, ("key",),
                          block)
    sizes = runs.groupBy("key").agg(F.sum(F.col("counted").cast("bigint")).alias("n"))
    keep = F.lit(1.0 - P.PROC_LEARN_RATE)
    gain = F.lit(P.PROC_LEARN_RATE) * F.pow(keep, F.col("n") - F.col("i")) * F.col("target")
    tallies = (
        placed.join(sizes, "key").groupBy("key")
        .agg(F.count(F.lit(1)).alias("uses_run"), F.max("n").alias("n"), F.min("seq").alias("run1"),
             F.sum(F.when(F.col("counted"), gain)).alias("gained"),
             F.min_by("target", F.when(F.col("counted"), seq)).alias("t1"),
             F.max_by("t", F.when(truthy(F.col("t")).isNotNull(), seq)).alias("run_t"),
             F.max(F.when(truthy(F.col("t")).isNotNull(), seq)).alias("run_t_seq")))
    x = head.join(tallies, "key", "left")
    # A promotion confidence counts only while no score exists yet.
    promoted = F.when(F.col("seq_p").isNotNull()
                      & (F.col("run1").isNull() | (F.col("seq_p") < F.col("run1")))
                      & F.col("seq_r").isNull(), F.col("conf_p"))
    start = F.coalesce("score_r", promoted)
    n = F.coalesce("n", F.lit(0))
    s0 = F.coalesce(start, F.lit(0.5))
    raw1 = keep * s0 + F.lit(P.PROC_LEARN_RATE) * F.col("t1")
    learned = F.pow(keep, n) * s0 + F.col("gained") + F.pow(keep, n - 1) * (S.clamp01(raw1) - raw1)
    uses = F.col("learned") + F.coalesce("uses_run", F.lit(0))
    fallback = S.rounded(F.least(F.lit(0.9), 0.5 + 0.1 * (uses - 1)))
    score = F.when(n > 0, learned).otherwise(F.coalesce(start, fallback))
    later_run = F.col("run_t_seq").isNotNull() & (
        F.col("seed_t_seq").isNull() | (F.col("run_t_seq") > F.col("seed_t_seq")))
    empty = F.array().cast("array<string>")
    return x.select(
        F.col("key").alias("procedure_id"), F.coalesce("label", "key").alias("label"),
        F.coalesce("steps", empty).alias("steps"), F.coalesce("trigger", empty).alias("trigger"),
        score.alias("outcome_score"), uses.alias("uses"),
        F.when(later_run, F.col("run_t")).otherwise(F.col("seed_t")).alias("last_used_t"))


def procedure_evidence(log: DataFrame, table: DataFrame) -> DataFrame:
    rows = _keyed(log, "procedure_id", ["procedure_learned", "pattern_promoted"])
    return (rows.select(F.col("key").alias("procedure_id"), F.explode("evidence").alias("event_id"))
            .distinct().join(table, "procedure_id", "left_semi"))


def ref_kind(ref: Column) -> Column:
    return (F.when(ref.startswith("thr_"), "thread").when(ref.startswith("cpt_"), "concept")
            .when(ref.startswith("prc_"), "procedure").otherwise("event"))


def patterns(log: DataFrame) -> DataFrame:
    rows = _keyed(log, "pattern_id", ["pattern_detected"])
    every = F.lit(True)
    head = rows.groupBy("key").agg(
        _newest(truthy(F.col("kind")), every).alias("kind"),
        _newest(_text("label", "summary", "msg"), every).alias("label"),
        _newest(F.col("confidence"), every).alias("confidence"),
        _newest(F.col("frequency"), every).alias("freq_r"),
        F.max(F.when(F.col("frequency").isNotNull(), F.col("seq"))).alias("seq_r"),
        _newest(_filled("recommended"), every).alias("recommended"),
        _newest(truthy(F.col("t")), every).alias("last_seen_t"))
    since = (
        rows.select("key", "seq").join(head.select("key", "seq_r"), "key")
        .filter(F.col("seq_r").isNull() | (F.col("seq") > F.col("seq_r")))
        .groupBy("key").agg(F.count(F.lit(1)).alias("since")))
    freq = F.coalesce("freq_r", F.lit(0)) + F.coalesce("since", F.lit(0))
    x = head.join(since, "key", "left").withColumn("frequency", freq)
    derived = S.rounded(F.least(F.lit(0.95), 0.5 + 0.1 * (F.col("frequency") - 1)))
    return x.select(
        F.col("key").alias("pattern_id"), F.coalesce("kind", F.lit("reasoning")).alias("kind"),
        F.coalesce("label", "key").alias("label"),
        F.coalesce(nonzero(F.col("confidence")), derived).alias("confidence"), "frequency",
        F.coalesce("recommended", F.array().cast("array<string>")).alias("recommended"),
        "last_seen_t")


def pattern_evidence(log: DataFrame) -> DataFrame:
    """References of each pattern with the place of their first citation."""
    rows = _keyed(log, "pattern_id", ["pattern_detected"])
    return (
        rows.select("key", "seq", F.posexplode("evidence").alias("pos", "ref_id"))
        .groupBy("key", "ref_id").agg(F.min(F.struct("seq", "pos")).alias("place"))
        .select(F.col("key").alias("pattern_id"), ref_kind(F.col("ref_id")).alias("ref_kind"),
                "ref_id", "place"))
