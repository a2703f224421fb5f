"""Parquet tables, and the canonical log derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.session import stage
from mnemograph.sources.schema import conform

AS_OF = "2024-01-31 00:00:00"
VERBS = ["run", "patch", "deploy", "review", "test", "merge", "profile", "index"]
NOUNS = ["cache", "parser", "schema", "queue", "token", "shard", "router", "ledger", "planner"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(words: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(w) for w in words]), index.cast("int"))


def _evt(seq: Column) -> Column:
    return F.when(seq >= 1, F.concat(F.lit("evt_"), seq.cast("string")))


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


# Fixed value: the log type of an events row by kind and the upper bound of k.
TYPE_BANDS = {
    "signup": [(12, "session_start"), (18, "session_end"), (22, "thread_open"),
               (24, "thread_merge"), (26, "thread_split"), (30, "branch_open"),
               (32, "branch_merge"), (100, "open_loop")],
    "purchase": [(20, "proc_executed"), (24, "procedure_learned"), (25, "procedure_retired"),
                 (26, "pattern_promoted"), (100, "loop_closed")],
    "view": [(40, "observation"), (55, "hypothesis"), (70, "artifact"), (85, "concept_formed"),
             (88, "concept_retired"), (100, "attended")],
    "click": [(45, "decision"), (65, "command"), (75, "objective"), (80, "topic_shift"),
              (85, "checkpoint"), (93, "api_call"), (100, "assumption")],
    "error": [(55, "error"), (75, "contradiction"), (85, "assumption_invalidated"),
              (95, "pattern_detected"), (97, "snapshot"), (100, "reflection")],
}


def type_table(spark: SparkSession) -> DataFrame:
    """(ev, k) to log type: five kinds by a hundred values, whatever the data."""
    rows = []
    for ev, bands in TYPE_BANDS.items():
        low = 0
        for high, name in bands:
            rows += [(ev, k, name) for k in range(low, high)]
            low = high
    return spark.createDataFrame(rows, "ev string, k bigint, type string")


_ingested: dict[tuple[str, str], DataFrame] = {}


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical log of ``events``, written once per application as Parquet.

    Readers then prune columns and push type filters into the scan.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingested:
        _ingested[key] = stage(normalized_events(spark, sf_dir), "log")
    return _ingested[key]


def normalized_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``events`` as a canonical log event; a pure projection."""
    raw = table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("seq"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"),
        F.col("user_id").alias("u"), F.col("event_type").alias("ev"),
        F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    # Joining the fixed 500-row table keeps the type a column; as an expression
    # it would be repeated in every field below.
    # A row of another kind, or with another k, keeps its own type.
    known = raw.join(F.broadcast(type_table(spark)), ["ev", "k"], "left").withColumn(
        "type", F.coalesce("type", "ev"))
    e = known.withColumn(
        "week", F.floor((F.unix_micros("ts") - F.lit(1704067200000000)) / F.lit(604800000000)))
    seq, k, u, ty = F.col("seq"), F.col("k"), F.col("u"), F.col("type")

    def of(*types: str) -> Column:
        return ty.isin(*types)

    verb, noun = _pick(VERBS, k % 8), _pick(NOUNS, u % 9)
    user_session = F.concat(F.lit("s"), u, F.lit("_"), F.col("week"))
    user_thread = F.concat(F.lit("thr_u"), u, F.lit("_w"), F.col("week"))
    k_thread = F.concat(F.lit("thr_k"), k % 10)
    lifecycle = of("thread_open", "thread_merge", "thread_split")
    return conform(
        e,
        seq=seq, ts=F.col("ts"), type=ty, event_id=_evt(seq),
        t=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        session=F.when(of("session_start"), user_session)
        .when(of("session_end") & (k % 2 == 0), None)
        .when(k % 11 == 0, user_session),
        project=F.when(of("session_start") & (k % 2 == 0), F.concat(F.lit("proj"), u % 5)),
        status=F.when(of("session_end") & (k % 3 == 0), F.lit("done")),
        branch=F.when(of("branch_merge"), F.when(k == 30, "exp1").otherwise("exp3"))
        .when(of("branch_open"), F.concat(F.lit("exp"), k % 4))
        .when((k % 5 == 0) & ~of("session_start"), F.concat(F.lit("exp"), k % 4)),
        base=F.when(of("branch_open") & (k % 2 == 0), F.lit("exp1")),
        agent=F.get(F.array(*[F.lit(a) for a in (
            None, "memory", "coder", "planner", "researcher")]), (k % 5).cast("int")),
        id=F.when(of("open_loop", "loop_closed") & (k % 29 != 0),
                  F.concat(u.cast("string"), F.lit(":"), k % 7)),
        msg=F.when(~of("session_start", "session_end", "artifact", "attended", "checkpoint")
                   & ~lifecycle, F.concat_ws(" ", verb, noun, F.concat(F.lit("k"), k))),
        title=F.when(of("thread_open"), F.concat(noun, F.lit(" work"))),
        path=F.when(of("artifact"), F.concat(F.lit("src/"), noun, F.lit("_"), u % 30,
                                             F.lit(".py"))),
        action=F.when(of("artifact") & (k % 2 == 0), F.lit("edited")),
        reason=F.when(of("checkpoint"), F.lit("idle")),
        resolution=F.when(of("loop_closed") & (k % 3 == 0), F.lit("done")),
        outcome=F.when(of("proc_executed") & (k % 3 == 0), F.lit("Failure"))
        .when(of("proc_executed") & (k % 3 == 1), F.lit("success")),
        thread_id=F.when(lifecycle, user_thread),
        into=F.when(of("thread_merge"), k_thread),
        spawn=F.when(of("thread_split"), k_thread),
        target=F.when(of("attended"), _evt(seq - 1 - k % 5)),
        thread_ids=F.when(
            ~of("session_start", "session_end", "attended", "snapshot", "checkpoint"),
            _list(user_thread, F.when(k % 3 == 0, k_thread))),
        causes=F.when(~of("attended"), _list(
            _evt(seq - 1 - k % 3), F.when(k % 4 == 1, _evt(seq - 1 - (seq - 1) % 16)))),
        between=F.when(of("contradiction") & (k % 2 == 0), _list(_evt(seq - 1), _evt(seq - 2))),
        concept_id=F.when(of("concept_formed", "concept_retired"),
                          F.concat(F.lit("cpt_"), u % 97)),
        procedure_id=F.when(
            of("proc_executed", "procedure_learned", "procedure_retired", "pattern_promoted"),
            F.concat(F.lit("prc_"), u % 20)),
        pattern_id=F.when(of("pattern_detected"), F.concat(F.lit("pat_success_"), u % 15))
        .when(of("pattern_promoted"), F.concat(F.lit("pat_success_"), u % 2)),
        kind=F.when(of("pattern_detected"),
                    F.when(k % 3 == 0, "failure").when(k % 3 == 1, "success")),
        label=F.when(of("pattern_detected"), F.concat(
            F.lit("successful path: "), noun, F.lit(" → "), verb)),
        evidence=F.when(of("concept_formed", "procedure_learned", "pattern_detected"), _list(
            _evt(seq - 1), _evt(seq - 1 - k % 7), _evt(seq - 10 - k),
            F.when(of("pattern_detected"), user_thread))),
        trigger=F.when(of("procedure_learned") & (k % 2 == 0), _list(verb, noun)),
        steps=F.when(of("procedure_learned"), _list(
            F.concat(F.lit("first "), verb), F.concat(F.lit("then "), noun))),
        recommended=F.when(of("pattern_detected") & (k % 2 == 0),
                           _list(F.concat(F.lit("guard "), noun))),
        support=F.when(of("concept_formed") & (k % 7 == 0), k % 5 + 1),
        salience=F.when(of("concept_formed") & (k % 6 == 0), (k % 12) / F.lit(20.0)),
        confidence=F.when(of("pattern_detected") & (k % 2 == 0), (k % 30) / F.lit(40.0) + 0.25)
        .when(of("pattern_promoted"), F.lit(0.8)),
        frequency=F.when(of("pattern_detected") & (k % 5 == 0), k % 4 + 1),
        outcome_score=F.when(of("procedure_learned") & (k == 21), F.lit(0.4)),
        snapshot_seq=F.when(of("snapshot"), seq - 1),
        topics=F.when(of("observation", "decision"), _list(noun, _pick(NOUNS, k % 9))),
        links=F.when(of("decision") & (k % 4 == 0), _list(F.concat(F.lit("artifact:"), noun))),
    )


def turn_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversations`` as a log: a conversation is a session and a thread.

    Positions are (conversation, turn) packed in one number: ordered, not dense.
    """
    t = table(spark, sf_dir, "conversations")
    key = F.concat(F.lit("thr_c"), F.col("conv_id"))
    seq = F.col("conv_id") * 1_000_000 + F.col("turn") + 1
    return conform(
        t, seq=seq, event_id=F.concat(F.lit("evt_"), seq.cast("string")),
        type=F.when(F.col("role") == "user", "objective").otherwise("observation"),
        session=F.concat(F.lit("c"), F.col("conv_id")), agent=F.col("role"),
        msg=F.col("text"), thread_ids=F.array(key))
