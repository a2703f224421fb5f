"""Event-sourced relational projections: state, sessions, loops, decisions, artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions.scoring import truthy
from mnemograph.operators.ordered import carry_forward, running_sums


def _latest(value: Column, cond: Column) -> Column:
    """Value of the newest row that satisfies ``cond``."""
    return F.max_by(value, F.when(cond, F.col("seq")))


def state_fold(log: DataFrame) -> DataFrame:
    """Latest project, branch, session, status and objective, with counts."""
    ty = F.col("type")
    start, marker = ty == "session_start", ty.isin("session_start", "session_end")
    status = F.when(start, "active").otherwise(F.coalesce("status", F.lit("paused")))
    return log.agg(
        _latest(F.col("project"), start & truthy(F.col("project")).isNotNull()).alias("project"),
        _latest(F.col("branch"), start & truthy(F.col("branch")).isNotNull()).alias("branch"),
        _latest(F.col("session"), start).alias("session"),
        F.coalesce(_latest(status, marker), F.lit("unknown")).alias("status"),
        _latest(F.col("msg"), ty == "objective").alias("objective"),
        F.count_if(ty == "decision").alias("decisions"),
        F.count_if(ty == "artifact").alias("artifacts"),
        F.count_if(ty == "checkpoint").alias("checkpoints"),
        F.count(F.lit(1)).alias("event_count"),
        F.max_by("t", "seq").alias("last_event_t"))


def with_session(log: DataFrame, block: int | None = None) -> DataFrame:
    """Adds ``current_session`` (latest start marker) and ``in_session``."""
    marked = carry_forward(
        log, "seq", F.when(F.col("type") == "session_start", F.col("session")),
        "current_session", block=block)
    return marked.withColumn(
        "in_session", F.coalesce(truthy(F.col("session")), F.col("current_session")))


def sessions(log: DataFrame, block: int | None = None) -> DataFrame:
    """One row per started session; events before the first start do not count."""
    rows = with_session(log.select("seq", "t", "type", "session", "project", "branch",
                                   "status"), block)
    starts = (
        log.filter((F.col("type") == "session_start") & F.col("session").isNotNull())
        .groupBy(F.col("session").alias("in_session"))
        .agg(F.min("seq").alias("first_seq"), F.min_by("project", "seq").alias("s_project"),
             F.min_by("branch", "seq").alias("s_branch"), F.min_by("t", "seq").alias("started")))
    ended = F.when(F.col("type") == "session_end", F.col("seq"))
    return (
        rows.join(starts, "in_session").filter(F.col("seq") >= F.col("first_seq"))
        .groupBy(F.col("in_session").alias("session"))
        .agg(F.any_value("s_project").alias("project"), F.any_value("s_branch").alias("branch"),
             F.any_value("started").alias("started"),
             F.max_by("t", ended).alias("ended"),
             F.when(F.max(ended).isNull(), "active").otherwise(
                 F.coalesce(F.max_by("status", ended), F.lit("paused"))).alias("status"),
             F.count(F.lit(1)).alias("n_events")))


def decisions(log: DataFrame, block: int | None = None) -> DataFrame:
    rows = with_session(log.select("seq", "t", "type", "session", "msg", "links"), block)
    return rows.filter(F.col("type") == "decision").select(
        "seq", "t", F.col("in_session").alias("session"), "msg",
        F.coalesce(F.array_join("links", ","), F.lit("")).alias("links"))


def artifacts(log: DataFrame, block: int | None = None) -> DataFrame:
    rows = with_session(log.select("seq", "t", "type", "session", "path", "action"), block)
    return rows.filter(F.col("type") == "artifact").select(
        "seq", "t", F.col("in_session").alias("session"), "path",
        F.coalesce("action", F.lit("touched")).alias("action"))


def loops(log: DataFrame, block: int | None = None) -> DataFrame:
    """Loops in fold order: re-opening resets, closing before opening is void."""
    rows = with_session(log.select("seq", "t", "type", "session", "id", "msg", "resolution"),
                        block)
    made_up = F.concat(F.lit("loop-"), F.col("seq"))
    return _loop_fold(
        rows.filter(F.col("type").isin("open_loop", "loop_closed")).withColumn(
            "id", F.when(F.col("type") == "open_loop", F.coalesce(truthy(F.col("id")), made_up))
            .otherwise(F.col("id"))))


def _loop_fold(rows: DataFrame) -> DataFrame:
    is_open = F.col("type") == "open_loop"
    opened, closed = F.when(is_open, F.col("seq")), F.when(~is_open, F.col("seq"))
    done = F.coalesce(F.col("close_seq") > F.col("open_seq"), F.lit(False))
    return (
        rows.filter(F.col("id").isNotNull())
        .groupBy("id")
        .agg(F.max(opened).alias("open_seq"), F.max(closed).alias("close_seq"),
             F.max_by("t", opened).alias("opened_t"),
             F.max_by("in_session", opened).alias("session"),
             F.max_by("msg", opened).alias("msg"),
             F.max_by("t", closed).alias("close_t"),
             F.max_by("resolution", closed).alias("close_resolution"))
        .filter(F.col("open_seq").isNotNull())
        .select("id", "opened_t", "session", "msg", done.cast("int").alias("resolved"),
                F.when(done, F.col("close_t")).alias("resolved_t"),
                F.when(done, F.col("close_resolution")).alias("resolution")))


def state_loops(log: DataFrame, block: int | None = None) -> DataFrame:
    """Loops of the state fold, where an id-less loop takes the next free number."""
    opens = log.filter(F.col("type") == "open_loop").select("seq", "t", "id", "msg")
    firsts = (opens.filter(truthy(F.col("id")).isNotNull()).groupBy("id")
              .agg(F.min("seq").alias("first_seq")))
    marked = opens.join(firsts, "id", "left").withColumn(
        "fresh", F.col("id").isNull() | (F.col("id") == "") | (F.col("seq") == F.col("first_seq")))
    numbered = running_sums(marked, "seq", {"n": F.col("fresh")}, block=block)
    named = numbered.select(
        "seq", "t", "msg", F.lit("open_loop").alias("type"),
        F.coalesce(truthy(F.col("id")), F.concat(F.lit("loop-"), F.col("n"))).alias("id"),
        F.lit(None).cast("string").alias("resolution"))
    closes = log.filter(F.col("type") == "loop_closed").select(
        "seq", "t", "msg", "type", "id", "resolution")
    both = named.unionByName(closes).withColumn("in_session", F.lit(None).cast("string"))
    return _loop_fold(both).select("id", "msg", F.col("opened_t").alias("t"), "resolved",
                                   "resolution")


def unresolved_opens(log: DataFrame) -> DataFrame:
    """Open loops whose id no ``loop_closed`` carries, in any order; null meets null."""
    closed = (log.filter(F.col("type") == "loop_closed")
              .select(F.col("id").alias("closed_id")).distinct())
    opens = log.filter(F.col("type") == "open_loop")
    return opens.join(closed, opens["id"].eqNullSafe(closed["closed_id"]), "left_anti")


def resolved_opens(log: DataFrame) -> DataFrame:
    closed = (log.filter(F.col("type") == "loop_closed")
              .select(F.col("id").alias("closed_id")).distinct())
    opens = log.filter(F.col("type") == "open_loop")
    return opens.join(closed, opens["id"].eqNullSafe(closed["closed_id"]), "left_semi")


def loops_ranked(log: DataFrame, as_of, linked: DataFrame | None = None) -> DataFrame:
    """Unresolved loops by intent-free salience."""
    rows = unresolved_opens(log)
    if linked is not None:
        rows = rows.join(linked, "seq", "left")
    else:
        rows = rows.withColumn("linked", F.lit(0).cast("bigint"))
    score = S.salience(S.importance(F.col("type")), F.col("ts"), F.lit(1),
                       F.coalesce("linked", F.lit(0)), as_of)
    title = F.coalesce(*[truthy(F.col(c)) for c in ("msg", "path", "reason", "type")])
    return rows.select("seq", "id", title.alias("msg"), "t", score.alias("salience"))


def loops_by_recency(open_loops: DataFrame, n: int) -> DataFrame:
    """The n newest loops with the positional fallback salience."""
    total = open_loops.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = open_loops.orderBy(F.desc("t"), "id").limit(n)
    rank = F.row_number().over(Window.orderBy(F.desc("t"), "id")) - 1  # at most n rows
    return top.select("id", "msg", "t", rank.alias("i"), total.alias("total")).select(
        "id", "msg", "t", S.rounded(1.0 - F.col("i") / (F.col("total") + 1), 2).alias("salience"))


def table_counts(log: DataFrame, block: int | None = None) -> DataFrame:
    loop_rows = loops(log, block)
    base = log.agg(F.count_if(F.col("type") == "decision").alias("decisions"),
                   F.count_if(F.col("type") == "artifact").alias("artifacts"),
                   F.count_distinct(F.when(F.col("type") == "session_start", F.col("session")))
                   .alias("sessions"))
    counts = loop_rows.agg(F.count(F.lit(1)).alias("loops"),
                           F.count_if(F.col("resolved") == 0).alias("open_loops"))
    return base.select("*", counts.select("loops").scalar().alias("loops"),
                       counts.select("open_loops").scalar().alias("open_loops"))


def newest(rows: DataFrame, order: str, n: int, key: str) -> DataFrame:
    return rows.orderBy(F.desc(order), F.desc(key)).limit(n)


def reflection_counts(graph, as_of) -> DataFrame:
    """Threads by status, stale threads, open and aging loops, live tensions."""
    age = S.age_days(F.col("last_ts"), as_of)
    stale = (F.col("status") != "merged") & F.coalesce(age > P.STALE_DAYS, F.lit(False))
    threads = graph.threads.agg(
        F.count(F.lit(1)).alias("threads"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "dormant").alias("dormant"),
        F.count_if(stale).alias("stale"))
    loop = (F.col("type") == "open_loop") & (F.col("unresolved") == 1)
    aging = loop & F.coalesce(S.age_days(F.col("ts"), as_of) > P.LOOP_AGING_DAYS, F.lit(False))
    open_loops = graph.nodes.agg(F.count_if(loop).alias("open_loops"),
                                 F.count_if(aging).alias("aging_loops"))
    tensions = graph.contradictions.agg(F.count(F.lit(1)).alias("n"))
    return threads.select(
        "*", open_loops.select("open_loops").scalar().alias("open_loops"),
        open_loops.select("aging_loops").scalar().alias("aging_loops"),
        tensions.scalar().alias("tensions"))


def stale_threads(threads: DataFrame, as_of) -> DataFrame:
    age = S.age_days(F.col("last_ts"), as_of)
    return threads.filter((F.col("status") != "merged") & (age > P.STALE_DAYS)).select("thread_id")
