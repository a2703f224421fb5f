"""Log-level projections, filters and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions.scoring import truthy
from mnemograph.sources import schema


def body(df_type: str = "type") -> Column:
    """Display text: msg, title, path, reason and resolution, else the type."""
    text = F.concat_ws(" ", *[truthy(F.col(c)) for c in
                              ("msg", "title", "path", "reason", "resolution")])
    return F.coalesce(truthy(text), F.col(df_type), F.lit(""))


def search_body() -> Column:
    """Searchable text: the type, nine text fields, topics and links."""
    fields = [truthy(F.col(c)) for c in ("msg", "path", "reason", "resolution", "objective",
                                         "branch", "project", "session", "id")]
    lists = [truthy(F.array_join(c, " ")) for c in ("topics", "links")]
    return F.concat_ws(" ", F.coalesce(F.col("type"), F.lit("")), *fields, *lists)


def title() -> Column:
    return F.coalesce(*[truthy(F.col(c)) for c in ("msg", "path", "reason", "type")])


def layered(log: DataFrame) -> DataFrame:
    return log.select(
        "seq", "event_id", "type",
        S.layer(F.col("type"), F.col("layer")).alias("layer"),
        S.importance(F.col("type")).alias("importance"))


def tail(log: DataFrame, n: int = 10) -> DataFrame:
    return log.orderBy(F.desc("seq")).limit(n)


def branch_of() -> Column:
    return F.coalesce(truthy(F.col("branch")), F.lit(P.MAIN))


def merged_branches(log: DataFrame) -> DataFrame:
    name = F.coalesce(truthy(F.col("branch")), truthy(F.col("base")))
    return (log.filter(F.col("type") == "branch_merge")
            .select(name.alias("branch"))
            .filter(F.col("branch") != P.MAIN).distinct())


def for_branch(log: DataFrame, branch: str = P.MAIN, merged: DataFrame | None = None) -> DataFrame:
    """Mainline, merged branches and the requested one.

    ``merged`` names the merged branches where ``log`` is only a part of the log.

    Mainline rows, most of the log, pass without a join; only labelled rows
    meet the merged names.
    """
    main_row = branch_of() == P.MAIN
    labelled = log.filter(~main_row)
    names = merged_branches(log) if merged is None else merged
    kept = labelled.join(names, "branch", "left_semi").select(*log.columns)
    if branch and branch != P.MAIN:
        mine = F.col("branch") == branch
        kept = kept.filter(~mine).unionByName(labelled.filter(mine))
    return log.filter(main_row).unionByName(kept)


def shown_branches(log: DataFrame) -> DataFrame:
    """Names of the mainline and of the branches merged into it."""
    main = log.sparkSession.range(1).select(F.lit(P.MAIN).alias("branch"))
    return merged_branches(log).unionByName(main)


def on_branches(log: DataFrame, names: DataFrame) -> DataFrame:
    """``for_branch`` in one pass, for names that lie in a small table.

    Spark knows the size of a staged table and broadcasts it, so a reader takes the columns
    it needs out of the log and no copy of the mainline is written.
    """
    return log.join(names.select(F.col("branch").alias("_shown")), branch_of() == F.col("_shown"), "left_semi")


def branch_listing(log: DataFrame) -> DataFrame:
    """Every branch with its status, event count and base."""
    merged = merged_branches(log).select("branch", F.lit(1).alias("m"))
    counts = log.groupBy(branch_of().alias("branch")).agg(F.count(F.lit(1)).alias("n"))
    opened = (
        log.filter(F.col("type") == "branch_open")
        .select(F.coalesce(truthy(F.col("branch")), truthy(F.col("name"))).alias("branch"),
                "seq", F.coalesce(truthy(F.col("base")), F.lit(P.MAIN)).alias("b"))
        .filter(F.col("branch").isNotNull())
        .groupBy("branch").agg(F.max_by("b", "seq").alias("b")))
    spark = log.sparkSession
    main = spark.range(1).select(F.lit(P.MAIN).alias("branch"), F.lit(0).cast("bigint").alias("n"))
    names = (
        counts.unionByName(main, allowMissingColumns=True)
        .unionByName(merged, allowMissingColumns=True)
        .unionByName(opened, allowMissingColumns=True)
        .groupBy("branch").agg(F.sum("n").alias("n"), F.max("m").alias("m"),
                               F.max("b").alias("b")))
    return names.select(
        "branch",
        F.when(F.col("branch") == P.MAIN, "main")
        .when(F.col("m") == 1, "merged").otherwise("open").alias("status"),
        F.coalesce("n", F.lit(0)).alias("events"),
        F.coalesce("b", F.lit(P.MAIN)).alias("base"))


def arbitration_audit(log: DataFrame) -> DataFrame:
    """Curator-owned events emitted by a named agent other than the curator."""
    bad = S.arbitration_violation(F.col("type"), F.col("agent"))
    return log.filter(bad).select(event_key().alias("event_id"), "type", "agent")


def event_key() -> Column:
    return F.coalesce(truthy(F.col("event_id")), F.concat(F.lit("evt_"), F.col("seq")))


def topic_shift_churn(log: DataFrame, window: int = P.META_CHURN_WINDOW) -> DataFrame:
    """Share of topic shifts in the last events; no row for an empty log."""
    recent = log.select("seq", "type").orderBy(F.desc("seq")).limit(window)
    shifts = F.count_if(F.col("type") == "topic_shift")
    size = F.count(F.lit(1))
    ratio = F.least(F.lit(1.0), shifts / F.greatest(F.lit(1.0), size / F.lit(10.0)))
    return (recent.agg(shifts.alias("shifts"), size.alias("events"),
                       S.rounded(ratio).alias("instability"))
            .filter(F.col("events") > 0))


def event_text(log: DataFrame) -> Column:
    """One event as text: every field in a fixed order, nulls as empty.

    Real numbers are taken to a millionth, so that any engine writes them alike.
    """
    def whole(x: Column) -> Column:
        return F.round(x * 1_000_000).cast("bigint").cast("string")

    parts = []
    for name, kind in schema.COLUMNS.items():
        col = F.col(name)
        if kind == "timestamp":
            col = F.unix_micros(col).cast("string")
        elif kind == "array<string>":
            col = F.array_join(col, ",")
        elif kind == "double":
            col = whole(col)
        elif kind.startswith("map"):
            entries = F.transform(F.array_sort(F.map_entries(col)),
                                  lambda e: F.concat(e["key"], F.lit("="), whole(e["value"])))
            col = F.array_join(entries, ",")
        parts.append(F.coalesce(col.cast("string"), F.lit("")))
    return F.concat_ws("|", *parts)


def content_digest(log: DataFrame) -> DataFrame:
    """Order-free digest of the log: the sum of its events' digests.

    A sum sees repeated events, combines before the shuffle and collects nothing.
    """
    number = F.conv(F.substring(F.md5(event_text(log)), 1, 15), 16, 10).cast("decimal(38,0)")
    return log.agg(F.count(F.lit(1)).alias("events"),
                   F.coalesce(F.sum(number), F.lit(0)).cast("string").alias("digest"))
