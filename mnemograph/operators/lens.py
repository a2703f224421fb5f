"""Text lenses over derived state: the working context and the workspace.

A lens is short by design. Spark ranks and limits; only the few rows a lens can
show reach the driver. Tensions, which have no limit, come as a stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from mnemograph import params as P
from mnemograph.functions import scoring as S
from mnemograph.operators import attention as A
from mnemograph.operators.graph import Graph
from mnemograph.session import stage

# How many rows each section shows, and how many characters of each.
SHOWN = {"threads": 5, "focus": 5, "concepts": 5, "procedures": 3, "steps": 5}
# Each loop line takes over 20 characters, so this many lines pass any budget.
LOOP_LINES = P.LENS_BUDGET_CHARS // 20
TENSION = "## Live tension (competing hypotheses)"
TRUNCATED = "\n_[truncated to budget]_\n"


def working_context(state: Row, loops: list[Row], decision: Row | None, artifact: Row | None,
                    now: str) -> str:
    """The restore lens from folded state and ranked open loops."""
    stopped = []
    if decision:
        stopped.append(f"Last decision: {decision['msg']} ({decision['t']})")
    if artifact:
        stopped.append(f"Last artifact: {artifact['path']} ({artifact['action']})")
    blocks = [
        [f"# Working Context - regenerated {now}"],
        ["## You are continuing",
         f"Project: {state['project'] or 'unknown'} | Branch: {state['branch'] or '-'} | "
         f"Last status: {state['status']}"],
        ["## Where work stopped", *(stopped or ["(no decisions or artifacts recorded yet)"])],
        ["## Objective", state["objective"] or "(no objective recorded)"],
        ["## Open loops (do these)",
         *([f"{i}. [{r['salience']:.2f}] {r['msg']} - unresolved" for i, r in enumerate(loops, 1)]
           or ["(none open)"])],
        ["## Next concrete action",
         loops[0]["msg"] if loops else "(no open loops — define next objective)"],
        [f"_Derived from {state['event_count']} events; {state['checkpoints']} checkpoints. "
         "The log is the truth_"],
    ]
    text = "\n\n".join("\n".join(b) for b in blocks) + "\n"
    if len(text) > P.LENS_BUDGET_CHARS:
        text = text[:P.LENS_BUDGET_CHARS] + TRUNCATED
    return text


NODE = ["event_id", "type", "layer", "body", "activation", "seq", "born"]
LAST = (1 << 63) - 1


def _place() -> list[Column]:
    """What nodes are ordered by, all ascending: folded events follow equal graph nodes."""
    return [-F.col("activation"), F.col("born"), F.coalesce("seq", F.lit(LAST)), F.col("event_id")]


@dataclass(frozen=True)
class Workspace:
    """A view of an active subgraph; ``nodes`` and ``threads`` stay tables of any size.

    ``limit`` is how many of the first nodes count, all if it is None.
    """

    nodes: DataFrame
    threads: DataFrame
    concepts: DataFrame
    procedures: DataFrame
    tensions: DataFrame
    limit: int | None = None

    @classmethod
    def of(cls, graph: Graph, att: A.Attention, query: str = "", top_n: int = 8) -> "Workspace":
        sub = stage(A.active_subgraph(graph, att.nodes, top_n), "workspace-nodes")

        def active(layer: str, name: str) -> DataFrame:
            return sub.filter(F.col("layer") == layer).select(
                F.col("event_id").alias(name), "activation")
        due = A.triggered_procedures(graph, query).select("procedure_id")
        return cls(
            nodes=sub.withColumn("born", F.lit(0)).select(*NODE),
            threads=att.threads.select("thread_id", "status", "activation", "resurfaced").join(
                graph.threads.select("thread_id", "title"), "thread_id"),
            concepts=graph.concepts.join(active("semantic", "concept_id"), "concept_id"),
            procedures=graph.procedures.join(due, "procedure_id", "left_semi")
            .join(active("procedural", "procedure_id"), "procedure_id"),
            tensions=att.contradictions)

    def folded(self, events: list[dict]) -> "Workspace":
        """The workspace after new events, each at the peak of what was active before."""
        new = {e["event_id"]: e for e in events if e.get("event_id")}
        if not new:
            return self
        spark = self.nodes.sparkSession
        top = self.nodes.agg(F.max("activation")).collect()[0][0] or 0.0
        peak = max(1.0, float(top))
        given = spark.createDataFrame(
            [(i, *(e.get(k) for k in ("event_id", "type", "layer", "msg", "title", "path", "reason",
                                      "resolution")), list(e.get("thread_ids") or []))
             for i, e in enumerate(new.values(), 1)],
            "born int, event_id string, type string, layer string, msg string, title string, "
            "path string, reason string, resolution string, thread_ids array<string>")
        kind = F.coalesce("type", F.lit(""))
        said = F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c))
                                  for c in ("msg", "title", "path", "reason", "resolution")])
        rows = given.select(
            "event_id", kind.alias("type"), S.layer(kind, F.col("layer")).alias("layer"),
            F.when(said != "", said).otherwise(kind).alias("body"),
            F.lit(peak).alias("activation"), F.lit(None).cast("bigint").alias("seq"), "born")
        touched = given.select(F.explode("thread_ids").alias("thread_id")).distinct().select(
            "thread_id", F.lit(peak).alias("bump"))
        threads = self.threads.join(touched, "thread_id", "full").select(
            "thread_id", "status",
            F.greatest(F.coalesce("activation", F.lit(0.0)), F.coalesce("bump", F.lit(0.0)))
            .alias("activation"), F.coalesce("resurfaced", F.lit(0)).alias("resurfaced"),
            F.coalesce("title", "thread_id").alias("title"))
        kept = self.nodes.join(rows.select("event_id"), "event_id", "left_anti")
        return replace(self, nodes=kept.select(*NODE).unionByName(rows), threads=threads)

    def focus(self, n: int) -> list[Row]:
        """The first cognitive nodes."""
        return self.nodes.filter("layer = 'cognitive'").orderBy(*_place()).limit(n).collect()

    def view(self) -> "View":
        """What the text needs of the tables: a few rows, and where they stand in the order."""
        shown = self.focus(SHOWN["focus"])
        loops = self.nodes.filter("layer = 'cognitive' AND type = 'open_loop'").orderBy(
            *_place()).limit(1).collect()
        before = [F.count_if(F.struct(*_place()) < F.struct(
            F.lit(-r["activation"]), F.lit(r["born"]),
            F.lit(LAST if r["seq"] is None else r["seq"]).cast("bigint"), F.lit(r["event_id"])))
            for r in [*shown, *loops]]
        sizes = self.nodes.agg(F.count(F.lit(1)), *before).collect()[0]
        top = [F.desc("activation")]
        live = self.threads.filter(F.col("activation") > 0)
        text = F.concat_ws("", F.lit("- "), "src", F.lit(" vs "), "dst", F.lit(" - leaning "),
                           F.when(F.col("src_score") >= F.col("dst_score"), F.col("src"))
                           .otherwise(F.col("dst")), F.lit(" ("), F.format_string("%.2f", "src_score"),
                           F.lit(" vs "), F.format_string("%.2f", "dst_score"), F.lit(")"))
        lines = self.tensions.toDF("src", "dst", "src_score", "dst_score").select(
            "src", "dst", text.alias("line"))
        return View(
            total=sizes[0], limit=self.limit, focus=shown, loop=loops[0] if loops else None,
            ranks=[n + 1 for n in sizes[1:]], live=live.count(),
            threads=live.orderBy(*top, "thread_id").limit(SHOWN["threads"]).collect(),
            concepts=self.concepts.orderBy(*top, "concept_id").limit(SHOWN["concepts"]).collect(),
            procedures=self.procedures.orderBy(*top, "procedure_id").limit(SHOWN["procedures"])
            .collect(),
            tensions=lines, tension_chars=lines.agg(
                F.coalesce(F.sum(F.length("line") + 1), F.lit(0))).collect()[0][0])

    def within(self, budget: int, now: str) -> "Workspace":
        """Only as many of the first nodes as a text of ``budget`` characters allows."""
        return replace(self, limit=self.view().longest(budget, now))

    def render(self, now: str) -> str:
        return "".join(self.view().lines(now))


@dataclass(frozen=True)
class View:
    """The rows a workspace shows. ``ranks`` are those of the focus rows and of the loop."""

    total: int
    limit: int | None
    focus: list[Row]
    loop: Row | None
    ranks: list[int]
    live: int
    threads: list[Row]
    concepts: list[Row]
    procedures: list[Row]
    tensions: DataFrame
    tension_chars: int

    def sections(self, now: str, size: int) -> list[tuple[str, list[str]]]:
        """(title, lines) of each section for ``size`` nodes, with tensions left out.

        Fixed values: the texts of titles and lines.
        """
        focus = [r for r, at in zip(self.focus, self.ranks) if at <= size]
        loop = self.loop if self.loop and self.ranks[-1] <= size else None
        out = [(f"# Workspace @ {now} (active subgraph: {size} nodes / {self.live} threads)", [])]
        out.append(("## Active threads", [
            f"{i}. [{t['activation']:.2f}] {t['thread_id']} - {t['title']}"
            + (f" [{t['status']}]" if t["status"] else "")
            + (" ^resurfaced" if t["resurfaced"] else "")
            for i, t in enumerate(self.threads, 1)] or ["(no threads yet - events are unthreaded)"]))
        out.append(("## Focus (highest activation)", [
            f"- {n['type']} {n['event_id']}: {n['body'][:110]} [{n['activation']:.2f}]"
            for n in focus] or ["(no cognitive nodes active)"]))
        out.append(("## Concepts in scope (semantic memory)", [
            f"- {c['concept_id']}: {c['summary'][:90]} (support {c['support']}, "
            f"salience {c['salience']:.2f})" for c in self.concepts]))
        out.append(("## Procedures (applicable how-to)", [
            line for p in self.procedures for line in (
                f"- {p['procedure_id']}: {p['label'][:90]} "
                f"(outcome {p['outcome_score']:.2f}, uses {p['uses']})",
                *(f"    • {x[:100]}" for x in p["steps"][:SHOWN["steps"]]))]))
        out.append((TENSION, []))
        out.append(("## Next concrete action", [
            loop["body"][:140] if loop else "(no open loops - define next objective)"]))
        out.append(("_Projection of the active subgraph; the log is the truth_", []))
        bare = {out[0][0], out[-1][0], *([TENSION] if self.tension_chars else [])}
        return [(title, lines) for title, lines in out if lines or title in bare]

    def chars(self, now: str, size: int) -> int:
        """Length of the text, without making it."""
        parts = self.sections(now, size)
        return (sum(len(t) + sum(len(x) + 1 for x in lines) for t, lines in parts)
                + self.tension_chars + 2 * (len(parts) - 1) + 1)

    def longest(self, budget: int, now: str) -> int:
        """The most nodes whose text fits; it changes only where a shown row or a digit comes in."""
        most = self.total if self.limit is None else min(self.limit, self.total)
        steps = {r - 1 for r in self.ranks} | {10 ** d - 1 for d in range(1, 19)} | {most}
        return max([n for n in steps if n <= most and self.chars(now, n) <= budget], default=0)

    def lines(self, now: str) -> Iterator[str]:
        """Pieces of the text in order; tensions come partition by partition."""
        size = self.total if self.limit is None else min(self.limit, self.total)
        for i, (title, rows) in enumerate(self.sections(now, size)):
            yield ("\n\n" if i else "") + title + "".join(f"\n{x}" for x in rows)
            if title == TENSION:
                for row in self.tensions.orderBy("src", "dst").toLocalIterator():
                    yield "\n" + row["line"]
        yield "\n"
