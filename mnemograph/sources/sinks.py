"""Appends to the log and exports of derived tables."""

from __future__ import annotations

import re
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.functions.scoring import truthy
from mnemograph.operators.ordered import ordinals
from mnemograph.session import stage
from mnemograph.sources import schema

# Column order of an appended line; absent fields are left out of the JSON.
LINE_ORDER = ["t", "type", *[f for f in schema.TEXT_FIELDS if f not in ("t", "type")],
              *schema.LIST_FIELDS, *schema.INT_FIELDS, *schema.REAL_FIELDS, "metrics"]


# Columns that only order a batch and are no fields of its events.
OWN_COLUMNS = ["ord", "split", "local", "pos"]

# Fixed value: an appended folder is named by its first position.
FOLDER = re.compile(r"/part-(\d{20})-")


def placed(events: DataFrame, first_seq: int) -> DataFrame:
    """Give a batch positions from ``first_seq`` on, in the order of ``ord``.

    The sorted batch is written once, so its order is fixed before it is counted.
    """
    splits = stage(
        events.repartitionByRange("ord").sortWithinPartitions("ord")
        .withColumn("split", F.spark_partition_id())
        .withColumn("local", F.monotonically_increasing_id()), "batch")
    return ordinals(splits, ("split",), "local", "pos").withColumn(
        "seq", F.col("pos") + F.lit(first_seq - 1))


def to_lines(events: DataFrame, now: str, key: str = "seq") -> DataFrame:
    """(key, value): one JSON line per event; an event without ``seq`` gets no id."""
    have = set(events.columns)
    rows = events.filter(truthy(F.col("type")).isNotNull())
    given = {c: F.col(c) for c in LINE_ORDER if c in have}
    given["t"] = F.coalesce(given.get("t", F.lit(None).cast("string")), F.lit(now))
    given["event_id"] = F.coalesce(
        truthy(given.get("event_id", F.lit(None).cast("string"))), F.concat(F.lit("evt_"), "seq"))
    given["layer"] = S.layer(F.col("type"), given.get("layer", F.lit(None).cast("string")))
    if "branch" in given:
        branch = given["branch"]
        given["branch"] = F.when(~branch.isin("", P.MAIN), branch)
    fields = [given[c].alias("from" if c == "base" else c) for c in LINE_ORDER if c in given]
    line = F.to_json(F.struct(*fields))
    # Fields without a column of their own follow: other columns of the batch, and the
    # JSON object in ``rest``.
    other = [c for c in events.columns if c not in (*schema.COLUMNS, *OWN_COLUMNS)]
    more = [F.to_json(F.struct(*other))] if other else []
    more += [F.col("rest")] if "rest" in have else []
    for extra in more:
        inner = F.substring(F.trim(extra), F.lit(2), F.length(F.trim(extra)) - 2)
        line = F.when(F.trim(inner) != "", F.concat(
            F.substring(line, F.lit(1), F.length(line) - 1), F.lit(","), inner, F.lit("}"))) \
            .otherwise(line)
    return rows.select(key, line.alias("value"))


def append(lines: DataFrame, log_path: str, first_seq: int) -> None:
    """Write lines as new files of the log folder, named to sort after all others.

    The batch lands in an own sub-folder whose name starts with its first
    position, so file order equals log order.
    """
    folder = f"{log_path}/part-{first_seq:020d}-{uuid.uuid4().hex[:8]}"
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("value").write.text(folder)


def notes(events: DataFrame) -> DataFrame:
    """What an append should warn about: unknown types and arbitration."""
    ty = F.col("type")
    unknown = F.when(~ty.isin(P.KNOWN_TYPES), F.lit("unknown type, stored but not modelled"))
    agent = F.col("agent") if "agent" in events.columns else F.lit(None).cast("string")
    owned = F.when(S.arbitration_violation(ty, agent),
                   F.lit("curator-owned type from another agent, flagged for audit"))
    return events.select("type", F.coalesce(unknown, owned).alias("note")).filter(
        F.col("note").isNotNull())


def chunked_refs(evidence: DataFrame, key: str, ref: str, size: int = P.EVIDENCE_CHUNK) -> DataFrame:
    """(key, part, refs): references in sorted order, at most about ``size`` per row.

    References hash into as many parts as the list needs, so the whole list is
    kept and no row gathers more than its part.
    """
    sizes = evidence.groupBy(key).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("bigint").alias("parts"))
    placed = evidence.join(sizes, key).withColumn(
        "part", F.pmod(F.xxhash64(ref), F.col("parts")))
    return placed.groupBy(key, "part").agg(F.array_sort(F.collect_set(ref)).alias("refs"))


def write_table(df: DataFrame, path: str, partition_by: str | None = None) -> None:
    """Replace a derived table, or only its touched partitions."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(partition_by)
    writer.parquet(path)


def write_tables(tables: dict[str, DataFrame], home: str) -> None:
    """Write independent tables at the same time, so their jobs share the cluster."""
    with ThreadPoolExecutor(max_workers=len(tables)) as pool:
        list(pool.map(lambda t: write_table(t[1], f"{home}/{t[0]}"), tables.items()))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    """One short report, such as a lens within its character budget."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a derived folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def export_threads(threads: DataFrame, path: str) -> None:
    """Thread state, newest activity first."""
    write_json(threads.drop("last_ts").orderBy(F.desc("last_activity_t"), "thread_id"), path)


def parse_pairs(args: list[str]) -> dict[str, str]:
    """``key=value`` arguments; tokens without ``=`` are dropped."""
    pairs = (a.split("=", 1) for a in args if "=" in a)
    return {k.strip(): v.strip() for k, v in pairs}


def csv_list(value: str) -> Column:
    return F.array(*[F.lit(s.strip()) for s in value.split(",") if s.strip()])
