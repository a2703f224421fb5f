import pytest
import itertools
import random

from pyspark.sql import functions as F

from mnemograph.operators import attention as A
from mnemograph.operators import digest, log_ops
from mnemograph.operators import graph as G
from mnemograph.operators import relational as R
from tests.conftest import AS_OF, rows


def test_thread_rollup_lifecycle(make_log):
    log = make_log([
        {"type": "thread_open", "thread_id": "t1", "title": "First"},
        {"type": "decision", "thread_ids": ["t1", "t2", "t1"]},
        {"type": "decision", "thread_ids": ["t2"], "t": "2020-01-01T00:00:00+00:00"},
        {"type": "thread_merge", "thread_id": "t2", "into": "t9"},
        {"type": "thread_split", "thread_id": "t1", "spawn": "t3"},
        {"type": "decision", "thread_ids": ["old"], "t": "2020-01-01T00:00:00+00:00"},
        {"type": "decision", "thread_ids": ["broken"], "t": "not a time"}])
    got = {r.thread_id: r for r in G.threads(log, AS_OF).collect()}
    assert set(got) == {"t1", "t2", "t3", "old", "broken"}  # a merge target alone has no row
    assert (got["t1"].title, got["t1"].status, got["t1"].n_events) == ("First", "active", 1)
    assert (got["t2"].status, got["t2"].merged_into, got["t2"].n_events) == ("merged", "t9", 2)
    assert got["t3"].status == got["old"].status == got["broken"].status == "dormant"
    assert rows(G.thread_lifecycle_edges(log), "src", "dst") == [("t1", "t3"), ("t2", "t9")]
    assert rows(G.thread_pairs(log), "a", "b", "shared") == [("t1", "t2", 1)]


def test_last_event_of_an_id_wins(make_log):
    log = make_log([{"type": "decision", "event_id": "d", "msg": "old"},
                    {"type": "observation", "event_id": "d", "msg": "new"},
                    {"type": "attended", "target": "d"}, {"type": "attended", "target": "d"}])
    node = G.event_nodes(log).filter("event_id = 'd'").collect()
    assert [(n.type, n.body, n.reinforced, n.seq) for n in node] == [("observation", "new", 2, 2)]


def test_loops_without_id_meet_each_other(make_log):
    log = make_log([{"type": "loop_closed", "id": "early"}, {"type": "open_loop", "id": "early"},
                    {"type": "open_loop", "id": "kept"}, {"type": "open_loop"},
                    {"type": "loop_closed"}])
    assert rows(R.unresolved_opens(log), "id") == [("kept",)]
    fold = {r.id: r.resolved for r in R.loops(log).collect()}
    assert fold == {"early": 0, "kept": 0, "loop-4": 0}  # a close before its open is void
    state = {r.id for r in R.state_loops(log).collect()}
    assert state == {"early", "kept", "loop-3"}


def test_reopened_loop_resets(make_log):
    log = make_log([{"type": "open_loop", "id": "L", "msg": "a"},
                    {"type": "loop_closed", "id": "L", "resolution": "r1"},
                    {"type": "open_loop", "id": "L", "msg": "b"}])
    r = R.loops(log).collect()[0]
    assert (r.msg, r.resolved, r.resolution) == ("b", 0, None)
    log = make_log([{"type": "open_loop", "id": "L"},
                    {"type": "loop_closed", "id": "L", "resolution": "r1"},
                    {"type": "loop_closed", "id": "L", "resolution": "r2"}])
    r = R.loops(log).collect()[0]
    assert (r.resolved, r.resolution) == (1, "r2")


def test_sessions_count_from_their_start(make_log):
    log = make_log([{"type": "decision", "session": "s1"},
                    {"type": "session_start", "session": "s1", "project": "p"},
                    {"type": "decision"}, {"type": "session_end", "status": "done"},
                    {"type": "session_start", "session": "s2"}, {"type": "decision"},
                    {"type": "decision", "session": "s1"}])
    got = {r.session: r for r in R.sessions(log, block=2).collect()}
    assert (got["s1"].n_events, got["s1"].status, got["s1"].project) == (4, "done", "p")
    assert (got["s2"].n_events, got["s2"].status) == (2, "active")


def test_compaction_keeps_active_and_open_work_hot(make_log):
    base = [{"type": "session_start", "session": "s"},
            {"type": "decision", "event_id": "d1", "msg": "threadless"},
            {"type": "objective", "thread_ids": ["t-live"]},
            {"type": "open_loop", "event_id": "ol1", "id": "L"}]
    before = G.build(make_log(base), AS_OF)
    assert before.nodes.filter("cold = 1").count() == 0
    after = G.build(make_log([*base, {"type": "snapshot", "snapshot_seq": 4}]), AS_OF)
    assert rows(after.nodes.filter("cold = 1"), "event_id") == [("d1",), ("evt_1",)]


def test_resonance_needs_two_shared_threads(make_log):
    events = []
    for t in ("t1", "t2"):
        events += [{"type": "objective", "thread_ids": [t]},
                   {"type": "decision", "event_id": f"a-{t}", "thread_ids": [t]},
                   {"type": "decision", "event_id": f"b-{t}", "thread_ids": [t]}]
    events.append({"type": "decision", "event_id": "g", "thread_ids": ["t3"]})
    for cid, ev in (("cpt_alpha", ["a-t1", "a-t2"]), ("cpt_beta", ["b-t1", "b-t2"]),
                    ("cpt_gamma", ["g", "a-t1"])):
        events.append({"type": "concept_formed", "concept_id": cid, "evidence": ev})
    g = G.build(make_log(events), AS_OF)
    got = rows(g.edges.filter("kind = 'resonance'"), "src", "dst", "weight")
    assert got == [("cpt_alpha", "cpt_beta", 0.25)]


def test_resonance_matches_all_pairs_counting(spark):
    """Exact counts although the commonest thread of a concept forms no candidates."""
    rnd = random.Random(7)
    sets = {f"c{i:02d}": {"hot"} | {f"t{rnd.randrange(12)}" for _ in range(rnd.randrange(5))}
            for i in range(30)}
    sets["c99"] = {"t1", "t2"}
    ev = spark.createDataFrame([(c, f"{c}|{t}") for c, ts in sets.items() for t in ts],
                               "concept_id string, event_id string")
    mem = spark.createDataFrame([(f"{c}|{t}", t) for c, ts in sets.items() for t in ts],
                                "event_id string, thread_id string")
    shared = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2)
              if len(sets[a] & sets[b]) >= 2}
    keep = set()
    for c in sets:
        mine = sorted(((w, b if a == c else a) for (a, b), w in shared.items() if c in (a, b)),
                      reverse=True)[:6]
        keep |= {tuple(sorted((c, o))) for _, o in mine}
    got = rows(G.resonance(ev, mem), "src", "dst", "shared", "weight")
    assert got == sorted((a, b, shared[a, b], min(1.0, shared[a, b] / 4) * 0.5) for a, b in keep)


def test_branches_exclude_include_and_merge(make_log):
    events = [{"type": "session_start", "session": "s"}, {"type": "decision", "msg": "redis"},
              {"type": "branch_open", "branch": "pg-exp", "base": "main"},
              {"type": "decision", "branch": "pg-exp", "msg": "postgres"},
              {"type": "objective", "branch": "pg-exp"}]
    log = make_log(events)
    assert log_ops.for_branch(log).count() == 2
    assert log_ops.for_branch(log, "pg-exp").count() == 5
    listing = {r.branch: (r.status, r.events, r.base)
               for r in log_ops.branch_listing(log).collect()}
    assert listing == {"main": ("main", 2, "main"), "pg-exp": ("open", 3, "main")}
    merged = make_log([*events, {"type": "branch_merge", "branch": "pg-exp"}])
    assert log_ops.for_branch(merged).count() == 6
    assert {r.status for r in log_ops.branch_listing(merged).collect()} == {"main", "merged"}


def test_audit_flags_only_named_outsiders(make_log):
    log = make_log([{"type": "concept_formed", "agent": a} for a in ("coder", "memory", None, "")])
    assert rows(log_ops.arbitration_audit(log), "event_id", "agent") == [("evt_1", "coder")]


def test_build_does_not_depend_on_partitioning(spark, make_log):
    rnd = random.Random(3)
    events = [{"type": rnd.choice(["decision", "error", "open_loop", "loop_closed",
                                   "concept_formed", "snapshot", "contradiction"]),
               "thread_ids": [f"t{rnd.randrange(4)}"], "causes": [f"evt_{rnd.randrange(1, 60)}"],
               "between": ["evt_3", "evt_4"], "concept_id": f"cpt_{rnd.randrange(3)}",
               "evidence": [f"evt_{rnd.randrange(1, 60)}"], "id": f"L{rnd.randrange(5)}",
               "snapshot_seq": 20, "msg": "m"} for _ in range(80)]
    log = make_log(events)
    seen = []
    for parts in ("2", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        g = G.build(log.repartition(int(parts)), AS_OF, block=int(parts) * 5)
        a = A.attend(g, AS_OF)
        seen.append((rows(g.nodes, "event_id", "cold", "importance"),
                     rows(g.edges, "src", "dst", "kind", "weight"),
                     rows(a.nodes, "event_id", "activation")))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert seen[0] == seen[1]


def test_digest_lists_sections_in_order(make_log):
    log = make_log([
        {"type": "objective", "msg": "ship", "thread_ids": ["t"]},
        {"type": "loop_closed", "id": "x", "msg": "closed one", "thread_ids": ["t"]},
        {"type": "open_loop", "id": "y", "msg": "open one", "thread_ids": ["t"]},
        *[{"type": "reflection", "msg": f"r{i}", "thread_ids": ["t"]} for i in range(5)]])
    g = G.build(log, AS_OF)
    lines = [r.line for r in digest.digest_text(g, "t").collect()]
    assert lines[1:] == ["- ship", "- [open] open one", "- [closed] closed one",
                         "- r2", "- r3", "- r4"]
    assert "status: active" in lines[0] and "n_events: 8" in lines[0]


@pytest.mark.parametrize("hub", [2, 64])
def test_resonance_with_three_hubs_over_all_concepts(spark, hub):
    import itertools
    import random
    rng = random.Random(7)
    sets = {f"c{i:02}": {"h1", "h2", "h3"} - ({rng.choice(["h1", "h2", "h3"])} if i % 4 == 0 else set())
            | {f"t{rng.randrange(12)}" for _ in range(rng.randrange(4))} for i in range(40)}
    ev = spark.createDataFrame([(c, f"e-{t}") for c, ts in sets.items() for t in ts],
                               "concept_id string, event_id string")
    mem = spark.createDataFrame(sorted({(f"e-{t}", t) for ts in sets.values() for t in ts}),
                                "event_id string, thread_id string")
    shared = {(a, b): len(sets[a] & sets[b]) for a, b in itertools.combinations(sorted(sets), 2)}
    want = set()
    for c in sets:
        mine = [(n, a if b == c else b, (a, b)) for (a, b), n in shared.items() if c in (a, b) and n >= 2]
        want |= {(p[0], p[1], n) for n, _, p in sorted(mine, reverse=True)[:6]}
    got = rows(G.resonance(ev, mem, hub=hub), "src", "dst", "shared")
    assert got == sorted(want)


def test_a_projection_stages_only_what_is_read(make_log):
    log = make_log([
        {"type": "decision", "thread_ids": ["a"], "msg": "x"},
        {"type": "observation", "thread_ids": ["a", "b"], "causes": ["evt_1"], "msg": "y"},
        {"type": "pattern_detected", "pattern_id": "pat_1", "evidence": ["evt_1"], "msg": "p"}])
    parts, whole = G.projection(log, AS_OF), G.build(log, AS_OF)
    assert rows(parts.patterns, "pattern_id") == rows(whole.patterns, "pattern_id") == [("pat_1",)]
    assert list(parts._made) == ["patterns"]
    assert rows(parts.causal, "src", "dst", "weight") == rows(whole.causal, "src", "dst", "weight")
    assert list(parts._made) == ["patterns"]
    assert rows(parts.nodes, "event_id", "cold") == rows(whole.nodes, "event_id", "cold")
    assert "edges" not in parts._made and "procedure_evidence" not in parts._made
    assert rows(parts.edges, "src", "dst", "kind") == rows(whole.edges, "src", "dst", "kind")


def test_a_projection_stages_no_table_twice(make_log, monkeypatch):
    log = make_log([{"type": "pattern_detected", "pattern_id": "pat_1", "evidence": ["evt_1"], "thread_ids": ["a"]}])
    staged, real = [], G.stage_all
    monkeypatch.setattr(G, "stage_all", lambda **frames: staged.extend(frames) or real(**frames))
    G.projection(log, AS_OF).read("nodes", "edges")
    assert sorted(staged) == sorted(set(staged)) and {"events", "procedures"} < set(staged)


def test_the_mainline_is_read_out_of_the_log(spark, make_log, monkeypatch):
    from mnemograph.plans import queries
    from mnemograph.session import stage
    log = make_log([{"type": "decision", "branch": b} for b in (None, "", "main", "x", "y", "z")] + [
        {"type": "branch_merge", "branch": "x"}, {"type": "branch_merge", "branch": "", "base": "y"},
        {"type": "branch_merge", "branch": "main"}])
    monkeypatch.setattr(queries, "log_of", lambda spark, sf: log)
    staged = []
    monkeypatch.setattr(queries, "stage", lambda df, name: staged.append(name) or stage(df, name))
    main = queries.main_log(spark, "mainline-test")
    assert staged == ["shown-branches"]     # names alone, no copy of the events
    assert main.columns == log.columns
    assert rows(main, "seq") == rows(log_ops.for_branch(log), "seq") == [(i,) for i in (1, 2, 3, 4, 5, 7, 8, 9)]
