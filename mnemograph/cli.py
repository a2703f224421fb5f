"""Command line over a memory store: ``python -m mnemograph.cli <verb> ...``."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession, functions as F

from mnemograph import params as P
from mnemograph.plans.store import Store
from mnemograph.session import clear_stages, get_spark
from mnemograph.sources import facts, sinks


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="mnemograph")
    p.add_argument("--root", default=os.environ.get("MNEMOGRAPH_HOME", ".mnemograph"))
    p.add_argument("--master")
    p.add_argument("--as-of")
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *flags: str, args: str | None = None):
        v = sub.add_parser(name)
        for f in flags:
            v.add_argument(f"--{f}", action="store_true")
        if args:
            v.add_argument("args", nargs="*" if args.endswith("*") else "?")
        return v

    verb("append", args="type pairs*")
    verb("ingest", args="paths*")
    verb("restore")
    verb("checkpoint", "keep-open").add_argument("--reason", default="manual")
    verb("session-start", args="pairs*")
    verb("state"), verb("home")
    verb("tail", args="n")
    verb("build", "force").add_argument("--branch", default=P.MAIN)
    for name in ("branches", "patterns", "audit", "roles", "incubate", "threads", "refresh",
                 "reindex", "loops", "stats", "rebuild", "verify", "reflect", "compress"):
        verb(name)
    verb("reconstruct", args="branch"), verb("digest", args="thread")
    for name in ("snapshot", "resolve", "abstract", "learn", "mine", "promote", "prune",
                 "retire-procedures", "introspect", "consolidate"):
        verb(name, "apply")
    for name in ("attend", "context", "subgraph"):
        v = verb(name, "oscillate", "reinforce", "write", args="query*")
        v.add_argument("-n", type=int, default=8)
        v.add_argument("--agent", default="")
        v.add_argument("--threads")
    verb("search", args="query*").add_argument("-k", type=int, default=P.SEARCH_K)
    d = verb("drift", "emit")
    d.add_argument("--window", type=int, default=P.DRIFT_WINDOW)
    q = verb("query", args="table")
    q.add_argument("-n", type=int, default=10)
    f = verb("facts", "list", args="query*")
    f.add_argument("--folder", required=True)
    f.add_argument("--tag", action="append", default=[])
    f.add_argument("--confidence")
    f.add_argument("--show")
    f.add_argument("--top", type=int, default=5)
    return p


def show(df, n: int | None = None) -> None:
    """Print rows as JSON lines, all of them unless ``n`` is asked for.

    Rows come one partition at a time, so the driver never holds them all.
    """
    lines = (df if n is None else df.limit(n)).select(F.to_json(F.struct("*")).alias("line"))
    for row in lines.toLocalIterator():
        print(row["line"])


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    try:
        return run(a)
    finally:
        spark = SparkSession.getActiveSession()
        if spark is not None:
            clear_stages(spark)


def run(a: argparse.Namespace) -> int:
    if a.verb == "home":
        print(a.root)
        return 0
    if a.verb == "roles":
        for role, types in P.ROLE_TYPES.items():
            print(f"{role}: {', '.join(sorted(types))}")
        return 0
    spark = get_spark(a.master)
    s = Store(spark, a.root, a.as_of)
    words = " ".join(getattr(a, "args", None) or []) if isinstance(
        getattr(a, "args", None), list) else (getattr(a, "args", None) or "")
    lane = [t for t in (getattr(a, "threads", None) or "").split(",") if t] or None

    if a.verb == "append":
        if not a.args:
            print("append needs a type", file=sys.stderr)
            return 2
        event = s.append(a.args[0], **sinks.parse_pairs(a.args[1:]))
        for note in s.notes(event):
            print(f"note: {note}", file=sys.stderr)
        print(json.dumps(event, ensure_ascii=False))
    elif a.verb == "ingest":
        print(s.ingest(*a.args) if a.args else 0)
    elif a.verb == "session-start":
        print(json.dumps(s.session_start(**sinks.parse_pairs(a.args)), ensure_ascii=False))
    elif a.verb == "restore":
        print(s.restore() or "no data yet")
    elif a.verb == "checkpoint":
        print(s.checkpoint(a.reason, keep_open=a.keep_open) or "no data yet")
    elif a.verb == "build":
        print("built" if s.build(a.branch, a.force) else "up to date")
    elif a.verb == "tail":
        show(s.tail(int(a.args or 10)))
    elif a.verb == "attend":
        att = s.attend(words, a.agent, lane, a.oscillate)
        show(att.nodes.orderBy("activation", ascending=False), a.n)
    elif a.verb == "context":
        text = s.workspace(words, a.n, a.reinforce, a.agent, lane)
        print(text)
        if a.write:
            sinks.write_text(spark, text, f"{s.root}/runtime/working_context")
    elif a.verb == "subgraph":
        show(s.subgraph(words, a.n, a.agent, lane, a.oscillate))
    elif a.verb == "search":
        show(s.search(words, a.k), a.k)
    elif a.verb == "drift":
        print(json.dumps(s.drift(a.window, a.emit)))
    elif a.verb == "query":
        show(s.query(a.args, a.n), a.n)
    elif a.verb == "verify":
        ok = s.verify()
        print("replay determinism:", "PASS" if ok else "FAIL")
        return 0 if ok else 1
    elif a.verb == "rebuild":
        s.write_replay()
    elif a.verb == "reindex":
        s.write_link_graph()
        show(s.index_stats())
    elif a.verb == "stats":
        show(s.index_stats())
    elif a.verb == "loops":
        show(s.ranked_loops().orderBy("salience", ascending=False))
    elif a.verb == "refresh":
        print(json.dumps(s.refresh(), ensure_ascii=False))
    elif a.verb == "reflect":
        print(s.reflect()["summary"])
    elif a.verb == "compress":
        show(s.compress())
    elif a.verb == "digest":
        for row in s.digest(a.args).toLocalIterator():
            print(row["line"])
    elif a.verb == "reconstruct":
        show(s.reconstruct(a.args))
    elif a.verb == "incubate":
        print(f"lifted {s.incubate().count()} dormant node(s)")
    elif a.verb == "snapshot":
        print(json.dumps(s.snapshot(a.apply)))
    elif a.verb == "consolidate":
        for stage, result in s.consolidate(a.apply).items():
            print(f"[{stage}]")
            print(json.dumps(result)) if isinstance(result, dict) else show(result)
    elif a.verb == "facts":
        rows = facts.filtered(facts.read_facts(spark, a.folder), a.tag, a.confidence)
        if a.show:
            for row in rows.filter(rows["id"] == a.show).limit(1).collect():
                print(row["raw"])
        elif a.list or not words:
            show(rows.select("id", "confidence", "tags", "concept").orderBy("path"))
        else:
            show(facts.search(rows, words, a.top), a.top)
    else:
        name = a.verb.replace("-", "_")
        method = getattr(s, name)
        show(method(a.apply) if hasattr(a, "apply") else method())
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
