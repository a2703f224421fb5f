"""Thread digests: the durable summary of a thread, as lines and as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mnemograph.operators.graph import Graph

# Digest sections in order, with their headings.
SECTIONS = [
    (1, "Objective", ["objective"]),
    (2, "Key decisions", ["decision"]),
    (3, "Hypotheses / tensions", ["hypothesis", "contradiction"]),
    (4, "Loops", ["open_loop", "loop_closed"]),
    (5, "Artifacts", ["artifact"]),
    (6, "Reflections", ["reflection"]),
]
REFLECTIONS_KEPT, REFLECTION_CHARS = 3, 160
FOOTER = "_Digest: a projection of this thread's events; the log is the truth_"


def digest_lines(graph: Graph) -> DataFrame:
    """(thread_id, section, place, line): one row per line, however long a thread is.

    Only the last three reflections of a thread belong to its digest.
    """
    rows = graph.membership.join(
        graph.nodes.filter(F.col("seq").isNotNull())
        .select("event_id", "seq", "type", "body", "unresolved"), "event_id")
    ty, body = F.col("type"), F.col("body")
    section = F.lit(None).cast("int")
    for number, _, types in SECTIONS:
        section = F.when(ty.isin(types), number).otherwise(section)
    open_loop = ty == "open_loop"
    line = (
        F.when(ty == "decision", F.concat(F.lit("- ("), "event_id", F.lit(") "), body))
        .when(ty.isin("hypothesis", "contradiction"),
              F.concat(F.lit("- ["), ty, F.lit("] "), body))
        .when(open_loop, F.concat(F.lit("- [open] "), body))
        .when(ty == "loop_closed", F.concat(F.lit("- [closed] "), body))
        .when(ty == "reflection", F.concat(F.lit("- "), F.substring(body, 1, REFLECTION_CHARS)))
        .otherwise(F.concat(F.lit("- "), body)))
    kept = rows.filter(~open_loop | (F.col("unresolved") == 1)).select(
        "thread_id", "seq", section.alias("section"), line.alias("line"),
        (ty == "loop_closed").cast("int").alias("late")).filter(F.col("section").isNotNull())
    newest = Window.partitionBy("thread_id").orderBy(F.desc("seq"))
    last = (kept.filter(F.col("section") == 6).withColumn("r", F.row_number().over(newest))
            .filter(F.col("r") <= REFLECTIONS_KEPT).drop("r"))
    # Open loops come before closed ones; otherwise log order.
    place = F.col("late") * F.lit(1 << 50) + F.col("seq")
    return kept.filter(F.col("section") != 6).unionByName(last).select(
        "thread_id", "section", place.alias("place"), "line")


def digest_headers(graph: Graph) -> DataFrame:
    """Front matter and headings as digest lines."""
    sizes = graph.membership.groupBy("thread_id").agg(F.count(F.lit(1)).alias("members"))
    t = graph.threads.join(sizes, "thread_id", "left")
    text = F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("thread_id: "), "thread_id"),
        F.concat(F.lit("title: "), "title"), F.concat(F.lit("status: "), "status"),
        F.concat(F.lit("n_events: "), F.coalesce("members", F.lit(0))),
        F.concat(F.lit("last_activity: "), F.coalesce("last_activity_t", F.lit(""))),
        F.lit("---"), F.concat(F.lit("# Thread: "), "title"))
    return t.select("thread_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("place"),
                    text.alias("line"))


def write_digests(graph: Graph, path: str) -> None:
    """All digests as one table of ordered lines.

    A range partitioning over (thread, section, place) keeps a thread's lines
    together, yet spreads a long thread over several files. Reading one thread
    skips the files outside its range.
    """
    lines = digest_headers(graph).unionByName(digest_lines(graph))
    headings = (digest_lines(graph).select("thread_id", "section").distinct()
                .withColumn("place", F.lit(-1).cast("bigint")))
    label = F.lit("")
    for number, name, _ in SECTIONS:
        label = F.when(F.col("section") == number, f"\n## {name}").otherwise(label)
    lines = lines.unionByName(headings.withColumn("line", label))
    feet = graph.threads.select(
        "thread_id", F.lit(9).alias("section"), F.lit(0).cast("bigint").alias("place"),
        F.lit("\n" + FOOTER).alias("line"))
    order = ["thread_id", "section", "place"]
    (lines.unionByName(feet).repartitionByRange(*order).sortWithinPartitions(*order)
     .write.mode("overwrite").parquet(path))


def stand_ins(graph: Graph) -> DataFrame:
    """Cold threads, whose digest stands in for their events."""
    return graph.threads.filter(F.col("status").isin("dormant", "merged")).select("thread_id")


def digest_text(graph: Graph, thread_id: str) -> DataFrame:
    """Ordered lines of one thread's digest."""
    only = digest_headers(graph).unionByName(digest_lines(graph)).filter(
        F.col("thread_id") == thread_id)
    return only.orderBy("section", "place").select("line")
