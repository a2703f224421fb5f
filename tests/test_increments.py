"""Graphs of a log that arrives in parts, against the graph of the whole log."""

import random

from mnemograph.operators import graph as G
from mnemograph.operators import increments
from mnemograph.plans.store import Store
from tests.conftest import AS_OF, rows

NOW = "2024-06-15T12:00:00+00:00"


def random_log(n, seed):
    rng = random.Random(seed)
    types = ["decision", "open_loop", "loop_closed", "attended", "contradiction", "thread_open",
             "thread_merge", "thread_split", "concept_formed", "concept_retired", "procedure_learned",
             "proc_executed", "pattern_detected", "pattern_promoted", "snapshot", "procedure_retired"]
    out = []
    for i in range(1, n + 1):
        ty = rng.choice(types)
        e = {"type": ty, "t": f"2024-06-{1 + i // 30:02d}T{i % 24:02d}:{i % 60:02d}:{rng.randrange(60):02d}+00:00",
             "msg": f"text {rng.randrange(20)}", "thread_ids": rng.sample(["a", "b", "c", "d"], rng.randrange(3)),
             "causes": [f"evt_{rng.randrange(1, n)}" for _ in range(rng.randrange(3))]}
        if ty in ("open_loop", "loop_closed"):
            e["id"] = rng.choice([None, "l1", "l2", "l3", "l4", "l5"])
        if ty == "attended":
            e["target"] = f"evt_{rng.randrange(1, n)}"
        if ty.startswith("thread_"):
            e |= {"thread_id": rng.choice("abcd"), "into": "a", "spawn": "d", "title": rng.choice([None, "T1", "T2"])}
        if ty.startswith(("concept", "proc", "pattern")):
            key = {"c": "concept_id", "p": "procedure_id"}[ty[0]] if not ty.startswith("pattern") else "pattern_id"
            e |= {key: f"{key[0]}{rng.randrange(3)}", "procedure_id": e.get("procedure_id", f"p{rng.randrange(3)}"),
                  "evidence": [f"evt_{rng.randrange(1, n)}" for _ in range(3)],
                  "outcome": rng.choice(["success", "failure"]), "summary": f"s{i}", "label": f"l{i}"}
        if ty == "snapshot":
            e["snapshot_seq"] = i
        if rng.random() < 0.05:
            e["event_id"] = "again"         # a later event of an id replaces the earlier one
        out.append(e)
    return out


def content(graph):
    def cell(v):
        return round(v, 4) if isinstance(v, float) else str(v)
    return {name: sorted(tuple(cell(v) for v in r) for r in df.select(*sorted(df.columns)).collect())
            for name, df in vars(graph).items()}


def test_merged_parts_give_the_graph_of_the_whole(spark, make_log):
    log = make_log(random_log(160, 5))
    whole = content(G.build(log, AS_OF))
    tables = increments.base(log.where("seq <= 40"))
    for low, high in ((40, 41), (41, 110), (110, 110), (110, 160)):
        parts = vars(increments.merged(tables, increments.base(log.where(f"seq > {low} AND seq <= {high}"))))
        from mnemograph.session import stage_all
        tables = increments.Base(**dict(zip(parts, stage_all(**parts))))
    got = content(increments.graph(tables, AS_OF))
    for name in whole:
        assert got[name] == whole[name], name


def test_store_builds_read_only_what_is_new(spark, tmp_path, monkeypatch):
    s = Store(spark, str(tmp_path / "home"), NOW)
    frame = "ord int, type string, msg string, id string, thread_ids array<string>, branch string"

    def add(*events):
        s.append_frame(spark.createDataFrame([(i, *e) for i, e in enumerate(events)], frame))
    add(("open_loop", "one", "L", ["t"], None), ("decision", "two", None, ["t"], None),
        ("decision", "aside", None, ["t"], "b"))
    assert s.build() and rows(s.graph().nodes, "event_id", "unresolved") == [("evt_1", 1), ("evt_2", 0)]
    asked = []
    real = s.events.read
    monkeypatch.setattr(s.events, "read", lambda after=0, state=None: asked.append(after) or real(after, state))
    add(("loop_closed", None, "L", None, None), ("decision", "three", None, ["t", "u"], None))
    assert s.build() and 3 in asked
    g = s.graph()
    assert rows(g.nodes, "event_id", "unresolved") == [
        ("evt_1", 0), ("evt_2", 0), ("evt_4", 0), ("evt_5", 0)]
    assert rows(g.threads, "thread_id", "n_events") == [("t", 3), ("u", 1)]
    # A merge lets the branch's older events in: the whole log is read again.
    s.append("branch_merge", **{"from": "b"})
    assert s.build() and ("evt_3",) in rows(s.graph().nodes, "event_id")


def test_advanced_tables_give_the_graph_and_leave_rows_where_they_are(spark, make_log, monkeypatch):
    log = make_log(random_log(160, 6))
    whole, tables = content(G.build(log, AS_OF)), None
    for low, high in ((0, 40), (40, 110), (110, 110), (110, 160)):
        tables = increments.advanced(tables, increments.base(log.where(f"seq > {low} AND seq <= {high}")))
    got = content(increments.graph(tables, AS_OF))
    for name in whole:
        assert got[name] == whole[name], name
    # No id recurs: the events, and tables that only take rows on, are not written again.
    plain = make_log([{"type": "decision", "msg": str(i), "thread_ids": ["t"]} for i in range(6)])
    first = increments.advanced(None, increments.base(plain.where("seq <= 3")))
    then = increments.advanced(first, increments.base(plain.where("seq > 3")))
    for name in ("events", "members", "stated", "rivals", "memory"):
        assert set(getattr(first, name).inputFiles()) <= set(getattr(then, name).inputFiles()), name
    assert rows(then.events, "seq") == [(i,) for i in range(1, 7)]
    # Of ids that do not recur, no event passes a shuffle when tables are merged.
    small = "Exchange hashpartitioning(event_id"
    both = increments.merged(first, increments.advanced(None, increments.base(plain.where("seq > 3"))))
    both.events.collect()
    assert small not in both.events._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
