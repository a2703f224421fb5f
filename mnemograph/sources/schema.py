"""The canonical log: one wide row per event, absent fields null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT_FIELDS = [
    "t", "type", "event_id", "layer", "session", "project", "branch", "base", "name",
    "agent", "id", "status", "action", "msg", "title", "path", "reason", "resolution",
    "objective", "summary", "label", "kind", "outcome", "thread_id", "into", "spawn",
    "target", "concept_id", "procedure_id", "pattern_id",
]
LIST_FIELDS = ["thread_ids", "causes", "between", "evidence", "trigger", "steps",
               "recommended", "links", "topics", "nudges", "stale_threads"]
INT_FIELDS = ["support", "frequency", "snapshot_seq", "part"]
REAL_FIELDS = ["salience", "confidence", "outcome_score", "drift"]

COLUMNS: dict[str, str] = {
    "seq": "bigint", "ts": "timestamp",
    **{f: "string" for f in TEXT_FIELDS},
    **{f: "array<string>" for f in LIST_FIELDS},
    **{f: "bigint" for f in INT_FIELDS},
    **{f: "double" for f in REAL_FIELDS},
    "metrics": "map<string,double>",
    # JSON object of all fields that have no column of their own.
    "rest": "string",
}


def conform(df: DataFrame, **fields: Column) -> DataFrame:
    """Select the canonical columns, taking ``fields`` and nulls for the rest."""
    return df.select(*[
        fields.get(name, F.lit(None)).cast(kind).alias(name)
        for name, kind in COLUMNS.items()
    ])
