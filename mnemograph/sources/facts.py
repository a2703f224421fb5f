"""Markdown facts: front matter, body and statement parsed with column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.operators import retrieval

# The layout of a fact file.
FACT_GLOB = "FACT-*.md"
FACT_TEMPLATE = """---
id: {id}
concept: "{concept}"
confidence: {confidence}
created: {date}
updated: {date}
tags: [{tags}]
source: "{source}"
related_facts: []
embedding: null
---

# {id}: {concept}

## Statement

{statement}
"""


def _unquote(x: Column) -> Column:
    return F.regexp_replace(F.trim(x), "^['\"]+|['\"]+$", "")


def parse(raw: DataFrame) -> DataFrame:
    """Facts from rows of (path, raw)."""
    closing = F.expr("locate('\n---', raw, 4)")
    has_front = F.col("raw").startswith("---") & (closing > 0)
    front = F.when(has_front, F.expr("substring(raw, 4, locate('\n---', raw, 4) - 4)"))
    body = F.when(has_front, F.trim(F.regexp_replace(
        F.expr("substring(raw, locate('\n---', raw, 4) + 4)"), r"^\s+|\s+$", ""))
    ).otherwise(F.col("raw"))
    pairs = F.filter(F.split(F.coalesce(front, F.lit("")), "\n"), lambda s: s.contains(":"))
    meta = F.map_from_entries(F.transform(
        # The last of two equal keys wins.
        F.filter(pairs, lambda s, i: ~F.exists(
            F.slice(pairs, i + 2, F.size(pairs)),
            lambda later: F.split_part(later, F.lit(":"), F.lit(1))
            == F.split_part(s, F.lit(":"), F.lit(1)))),
        lambda s: F.struct(F.trim(F.split_part(s, F.lit(":"), F.lit(1))),
                           F.trim(F.regexp_replace(s, "^[^:]*:", "")))))
    rows = raw.select("path", "raw", body.alias("body"), meta.alias("meta"))
    # Everything between the statement heading and the next heading.
    section = F.regexp_extract("body", r"(?ms)^## Statement[^\n]*$(.*?)(?=^##|\z)", 1)
    lines = F.filter(F.transform(F.split(section, "\n"), lambda s: F.trim(s)), lambda s: s != "")
    tag_text = F.col("meta")["tags"]
    tags = F.when(
        tag_text.startswith("[") & tag_text.endswith("]"),
        F.filter(F.transform(F.split(F.regexp_replace(tag_text, r"^\[|\]$", ""), ","), _unquote),
                 lambda s: s != "")).otherwise(F.array().cast("array<string>"))

    def text(name: str) -> Column:
        value = F.col("meta")[name]
        quoted = value.startswith('"') & value.endswith('"')
        return F.when(quoted, F.expr(f"substring(meta['{name}'], 2, length(meta['{name}']) - 2)")
                      ).otherwise(value)

    return rows.select(
        F.coalesce(text("id"), "path").alias("id"), "path", "raw", text("concept").alias("concept"),
        text("confidence").alias("confidence"), tags.alias("tags"), "body",
        F.array_join(F.slice(lines, 1, 3), " ").alias("statement"))


def read_facts(spark: SparkSession, folder: str) -> DataFrame:
    raw = (spark.read.option("pathGlobFilter", FACT_GLOB).text(folder, wholetext=True)
           .select(F.regexp_extract("_metadata.file_path", "[^/]+$", 0).alias("path"),
                   F.col("value").alias("raw")))
    return parse(raw)


def filtered(facts: DataFrame, tags: list[str] | None = None,
             confidence: str | None = None) -> DataFrame:
    """Facts with all given tags, upper and lower case alike, and one confidence."""
    lowered = F.transform("tags", lambda t: F.lower(t))
    for tag in tags or []:
        facts = facts.filter(F.array_contains(lowered, tag.lower()))
    if confidence:
        facts = facts.filter(F.lower("confidence") == confidence.lower())
    return facts


def index_text() -> Column:
    """Concept, statement, tags and the whole body."""
    return F.concat_ws(" ", "concept", "statement", F.array_join("tags", " "), "body")


def search(facts: DataFrame, query: str, top_n: int = 5) -> DataFrame:
    hits = retrieval.fact_search(facts, "id", index_text(), query, top_n)
    return (hits.join(facts, "id").select("id", "score", "concept", "confidence", "tags",
                                          "statement", "path")
            .orderBy(F.desc("score"), "id"))


def build_embeddings(facts: DataFrame, encoder, path: str) -> None:
    """Encode "concept. statement" with a pandas UDF and store vectors as Parquet."""
    text = F.concat(F.coalesce("concept", F.lit("")), F.lit(". "), "statement")
    facts.select("id", "concept", encoder(text).alias("embedding")).write.mode(
        "overwrite").parquet(path)


def dense_search(spark: SparkSession, path: str, facts: DataFrame, query: str, encoder,
                 top_n: int = 5) -> DataFrame:
    """Facts by cosine to the encoded query, over stored vectors."""
    stored = spark.read.parquet(path)
    probe = spark.createDataFrame([(query,)], "q string").select(encoder(F.col("q"))).scalar()
    v = F.col("embedding")
    rows = stored.withColumn("probe", probe)
    cos = retrieval.dot(v, F.col("probe")) / (
        (F.sqrt(retrieval.dot(v, v)) + 1e-9)
        * (F.sqrt(retrieval.dot(F.col("probe"), F.col("probe"))) + 1e-9))
    top = rows.select("id", cos.alias("score")).orderBy(F.desc("score"), "id").limit(top_n)
    return top.join(facts, "id").orderBy(F.desc("score"), "id")


def fact_text(number: int, concept: str, statement: str, tags: list[str], confidence: str,
              source: str, date: str) -> tuple[str, str]:
    """(file name, text) of a new fact."""
    name = f"FACT-{number:03d}"
    tail = re.sub(r"[^a-z0-9]+", "-", concept.lower())[:40]
    return f"{name}_{tail}.md", FACT_TEMPLATE.format(
        id=name, concept=concept, confidence=confidence or "medium", date=date,
        tags=", ".join(tags), source=source, statement=statement)
