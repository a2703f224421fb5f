"""The tables a graph follows from, kept beside it and brought up to date by new events.

Every table either takes rows on (membership, stated edges, rivals, memory events) or
combines by key: counts add up, and the newest of two values is the newer one. So the
tables of a log are those of its beginning merged with those of its end. Only keys that
the end touches are aggregated again; events, the widest table, move through a shuffle
only where their id recurs, and all other rows are copied, or stay where they are.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemograph.functions import scoring as S
from mnemograph.operators import graph as G
from mnemograph.operators import log_ops
from mnemograph.session import stage, stage_all

#: Events that concepts, procedures, patterns and the snapshot horizon follow from.
MEMORY_TYPES = ["concept_formed", "concept_retired", "procedure_learned", "procedure_retired",
                "proc_executed", "pattern_detected", "pattern_promoted", "snapshot"]


#: Tables that only take rows on.
APPENDED = ("members", "stated", "rivals", "memory")


@dataclass
class Base:
    events: DataFrame       # the last event of each id, with the loop it opens
    closed: DataFrame       # ids of closed loops, null among them if one was
    uses: DataFrame         # event_id, reinforced
    members: DataFrame      # event_id, thread_id
    stated: DataFrame       # src, dst, kind, weight
    pairs: DataFrame        # a, b, shared
    rivals: DataFrame       # src, dst
    threads: DataFrame      # states of threads
    memory: DataFrame       # memory events


def base(log: DataFrame) -> Base:
    """The tables of a branch-filtered log, or of a part of one."""
    ty = F.col("type")
    events = log.select(
        log_ops.event_key().alias("event_id"), "seq", "t", "ts", "type",
        S.layer(ty, F.col("layer")).alias("layer"), log_ops.body().alias("body"),
        S.importance(ty).alias("importance"), F.when(ty == "open_loop", F.col("id")).alias("loop"))
    return Base(
        _last(events), log.filter(ty == "loop_closed").select("id").distinct(), G.reinforcement(log),
        G.membership(log), G.stated_edges(log), G.thread_pairs(log), G.contradictions(log),
        G.thread_state(log), log.filter(ty.isin(MEMORY_TYPES)))


def _last(events: DataFrame) -> DataFrame:
    fields = [c for c in events.columns if c != "event_id"]
    return events.groupBy("event_id").agg(F.max_by(F.struct(*fields), "seq").alias("n")).select(
        "event_id", *[F.col(f"n.{f}") for f in fields])


def _merged(old: DataFrame, new: DataFrame, keys: list[str], **sums: Column) -> DataFrame:
    """Rows of both; those with keys of ``new`` are aggregated again."""
    touched = new.select(*keys).distinct()
    again = old.join(touched, keys, "left_semi").unionByName(new).groupBy(*keys).agg(
        *[c.alias(n) for n, c in sums.items()])
    return old.join(touched, keys, "left_anti").unionByName(again.select(*old.columns))


def _recurring(old: Base, new: Base) -> DataFrame:
    """Ids of events that both hold, staged: Spark then knows how few they are."""
    return stage(new.events.select("event_id").join(old.events.select("event_id"), "event_id", "left_semi"),
                 "recurring-ids")


def merged(old: Base, new: Base, recurring: DataFrame | None = None) -> Base:
    """The tables of a log, of those of its beginning and its end."""
    again = _recurring(old, new) if recurring is None else recurring
    rest, both = [[df.join(again, "event_id", how) for df in (old.events, new.events)]
                  for how in ("left_anti", "left_semi")]
    events = rest[0].unionByName(rest[1]).unionByName(_last(both[0].unionByName(both[1])))
    known = old.closed.select(F.col("id").alias("known"))
    fresh = new.closed.join(known, F.col("id").eqNullSafe(F.col("known")), "left_anti")
    newest = {c: F.max(c) for c in ("titled", "opened", "last", "merged")}
    return Base(
        events, old.closed.unionByName(fresh),
        _merged(old.uses, new.uses, ["event_id"], reinforced=F.sum("reinforced")),
        old.members.unionByName(new.members), old.stated.unionByName(new.stated),
        _merged(old.pairs, new.pairs, ["a", "b"], shared=F.sum("shared")),
        old.rivals.unionByName(new.rivals),
        _merged(old.threads, new.threads, ["thread_id"], **newest, merges=F.sum("merges"),
                n_events=F.sum("n_events")),
        old.memory.unionByName(new.memory))


def advanced(old: Base | None, new: Base) -> Base:
    """``merged`` and staged. Rows that nothing replaces stay in the files they lie in."""
    if old is None:
        return Base(**dict(zip(vars(new), stage_all(**vars(new)))))
    first = ("events", *APPENDED)
    new = replace(new, **dict(zip(first, stage_all(**{n: getattr(new, n) for n in first}))))
    again = _recurring(old, new)
    whole = vars(merged(old, new, again))
    kept = first if again.isEmpty() else APPENDED
    made = {n: getattr(old, n).unionByName(getattr(new, n)) for n in kept}
    left = {n: df for n, df in whole.items() if n not in made}
    return Base(**made, **dict(zip(left, stage_all(**left))))


def graph(b: Base, as_of, block: int | None = None) -> G.Graph:
    """The graph at a time; what depends on the time is derived here."""
    closed = b.closed.select(F.col("id").alias("closed_id"), F.lit(1).alias("is_closed"))
    is_open = F.col("type") == "open_loop"
    nodes = b.events.join(closed, is_open & F.col("loop").eqNullSafe(F.col("closed_id")), "left") \
        .withColumn("unresolved", F.when(is_open & F.col("is_closed").isNull(), 1).otherwise(0)) \
        .join(b.uses, "event_id", "left")
    events = nodes.select(
        "event_id", "seq", "t", "ts", "type", "layer", "body", "importance", "unresolved",
        F.coalesce("reinforced", F.lit(0)).cast("int").alias("reinforced"))
    return G.assembled(events, b.members, G.thread_rows(b.threads, as_of), b.rivals,
                       G.derived_edges(b.members, b.pairs, b.stated), b.memory, as_of, block)
