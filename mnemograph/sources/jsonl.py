"""The JSON-lines event log as a source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemograph.functions.scoring import truthy
from mnemograph.operators.ordered import ordinals
from mnemograph.sources import schema

# Where a canonical field has another name in the log.
JSON_NAMES = {"base": "from"}


def _path(name: str) -> str:
    return f"$.{JSON_NAMES.get(name, name)}"


def _kind(v: Column, path: str) -> Column:
    """SQL type of one field, null when absent."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _strings(v: Column, path: str) -> Column:
    """Non-empty strings of a JSON list, null for anything else."""
    return F.filter(F.try_variant_get(v, path, "array<string>"), lambda x: x != "")


def list_or_csv(v: Column, path: str) -> Column:
    """A JSON list, or a comma-separated string; anything else is null."""
    csv = F.filter(F.transform(F.split(F.try_variant_get(v, path, "string"), ","),
                               lambda s: F.trim(s)), lambda s: s != "")
    kind = _kind(v, path)
    return F.when(kind.startswith("ARRAY"), _strings(v, path)).when(kind == "STRING", csv)


def steps(v: Column, path: str) -> Column:
    """A JSON list, or one step given as a string, commas and all."""
    text = truthy(F.try_variant_get(v, path, "string"))
    kind = _kind(v, path)
    return F.when(kind.startswith("ARRAY"), _strings(v, path)).when(
        kind == "STRING", F.when(text.isNotNull(), F.array(text)))


def _number(v: Column, path: str, kind: str) -> Column:
    """A number, or a numeric string as command lines leave it; garbage is null."""
    return F.coalesce(F.try_variant_get(v, path, kind),
                      F.try_variant_get(v, path, "string").try_cast(kind))


# Text the reader shows must be a string in the log; ids may also be numbers.
STRICT_TEXT = ["msg", "title", "path", "reason", "resolution", "objective", "summary", "label"]


def fields(v: Column) -> dict[str, Column]:
    """Canonical columns out of one parsed event."""
    out: dict[str, Column] = {}
    for name in schema.TEXT_FIELDS:
        text = F.try_variant_get(v, _path(name), "string")
        if name in STRICT_TEXT:
            text = F.when(_kind(v, _path(name)) == "STRING", text)
        out[name] = text
    for name in schema.LIST_FIELDS:
        out[name] = (steps if name == "steps" else list_or_csv)(v, _path(name))
    for name in schema.INT_FIELDS:
        out[name] = _number(v, _path(name), "bigint")
    for name in schema.REAL_FIELDS:
        out[name] = _number(v, _path(name), "double")
    # A snapshot may give its horizon as plain ``seq``.
    out["snapshot_seq"] = F.coalesce(out["snapshot_seq"], F.when(
        out["type"] == "snapshot", _number(v, "$.seq", "bigint")))
    out["metrics"] = F.try_variant_get(v, "$.metrics", "map<string,double>")
    out["ts"] = F.try_to_timestamp(out["t"])
    known = [JSON_NAMES.get(n, n) for n in schema.COLUMNS if n not in ("ts", "rest")]
    rest = F.map_filter(F.try_variant_get(v, "$", "map<string,variant>"),
                        lambda k, _: ~k.isin(known))
    out["rest"] = F.when(F.size(rest) > 0, F.to_json(rest))
    return out


def raw_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """Non-blank lines with their split and a number growing by one inside it."""
    return (
        spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
        .text(list(paths))
        .select("value", F.col("_metadata.file_path").alias("file"),
                F.col("_metadata.file_block_start").alias("start"))
        .filter(F.trim("value") != ""))


def placed_events(spark: SparkSession, *paths: str) -> DataFrame:
    """Well-formed events with a dense ``seq``; ids stay null unless given."""
    parsed = raw_lines(spark, *paths).withColumn("v", F.try_parse_json("value"))
    good = parsed.filter(F.schema_of_variant("v").startswith("OBJECT")).withColumn(
        "local", F.monotonically_increasing_id())
    placed = ordinals(good, ("file", "start"), "local", "seq")
    cols = fields(F.col("v"))
    cols["event_id"] = truthy(cols["event_id"])
    return schema.conform(placed, seq=F.col("seq"), **cols)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed events in log order with a dense ``seq``.

    Files sort by name, so a log that grows by files needs growing names.
    Malformed lines carry no position; ``malformed_lines`` shows them.
    """
    return placed_events(spark, path).withColumn(
        "event_id", F.coalesce("event_id", F.concat(F.lit("evt_"), "seq")))


def malformed_lines(spark: SparkSession, *paths: str) -> DataFrame:
    v = F.try_parse_json("value")
    return raw_lines(spark, *paths).filter(
        ~F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))).select("value")


def line_count(spark: SparkSession, *paths: str) -> int:
    """Non-blank lines, malformed ones included: the base of event id allocation."""
    return raw_lines(spark, *paths).count()
