import random

import pytest
from pyspark.sql import functions as F

from mnemograph.operators import attention as A
from mnemograph.operators import graph as G
from mnemograph.operators import mining
from mnemograph.session import stage
from tests.conftest import AS_OF, rows


@pytest.fixture
def debate(make_log):
    """Two threads, rival hypotheses, and a decision that backs the first."""
    return make_log([
        {"type": "session_start", "session": "s"},
        {"type": "objective", "msg": "harden auth", "thread_ids": ["auth"]},
        {"type": "artifact", "path": "auth.py", "thread_ids": ["auth"]},
        {"type": "error", "msg": "token expired", "thread_ids": ["auth"]},
        {"type": "hypothesis", "msg": "use redis", "thread_ids": ["infra"]},
        {"type": "hypothesis", "msg": "use postgres", "thread_ids": ["infra"]},
        {"type": "contradiction", "msg": "redis or postgres", "between": ["evt_5", "evt_6"],
         "thread_ids": ["infra"]},
        {"type": "open_loop", "id": "L", "msg": "pick a store", "thread_ids": ["infra"]},
        {"type": "decision", "msg": "redis it is", "causes": ["evt_5"], "thread_ids": ["infra"]},
        {"type": "artifact", "path": "redis.conf", "causes": ["evt_9"], "thread_ids": ["infra"]}])


def act(a):
    return {r.event_id: r.activation for r in a.nodes.collect()}


def test_evidence_decides_the_contradiction(debate):
    g = G.build(debate, AS_OF)
    a = A.attend(g, AS_OF, agent="memory")
    r = A.resolve(g, a, debate).collect()
    assert [(x.type, x.winner, x.loser) for x in r] == [
        ("assumption_invalidated", "evt_5", "evt_6")]
    assert r[0].msg == "resolved in favor of evt_5: use redis"


def test_equal_rivals_stay_undecided(make_log):
    log = make_log([{"type": "hypothesis", "msg": "a"}, {"type": "hypothesis", "msg": "b"},
                    {"type": "contradiction", "between": ["evt_1", "evt_2"]}])
    g = G.build(log, AS_OF)
    a = A.attend(g, AS_OF)
    assert A.resolve(g, a, log).collect()[0].type == "undecided"
    assert act(a)["evt_1"] == act(a)["evt_2"]


def test_role_windows_flip_an_ordering(debate):
    g = G.build(debate, AS_OF)
    planner, coder = (act(A.attend(g, AS_OF, agent=r)) for r in ("planner", "coder"))
    assert planner["evt_2"] > planner["evt_3"] and coder["evt_3"] > coder["evt_2"]
    lane = act(A.attend(g, AS_OF, agent="coder", threads=["auth"]))
    assert lane["evt_4"] == pytest.approx(coder["evt_4"] + 0.65, abs=1e-3)


def test_query_lifts_matching_events(debate):
    g = G.build(debate, AS_OF)
    hits = {r.event_id: r.q for r in A.query_hits(g, "postgres", AS_OF).collect()}
    assert "evt_6" in hits and 0.6 < hits["evt_6"] <= 1.0 and "evt_3" not in hits
    # No shared word: BM25 prefixes, then plain substrings.
    assert set(r.event_id for r in A.query_hits(g, "postg", AS_OF, debate).collect()) == {
        "evt_6", "evt_7"}
    assert {r.event_id for r in A.query_hits(g, "edis", AS_OF, debate).collect()} >= {"evt_5"}


def test_spread_matches_a_loop(spark):
    rnd = random.Random(5)
    ids = [f"n{i}" for i in range(25)]
    edges = [(rnd.choice(ids), rnd.choice(ids + ["ghost"]), rnd.choice(["causal", "concept"]),
              rnd.choice([0.5, 1.0])) for _ in range(70)]
    node = {i: (round(rnd.random(), 3), rnd.choice([0.0, 0.5])) for i in ids}
    inbox = {}
    for s, d, kind, w in edges:
        inbox.setdefault(s, []).append((d, w))
        inbox.setdefault(d, []).append((s, w * 0.6 if kind == "causal" else w))
    want = {i: b + s for i, (b, s) in node.items()}
    for _ in range(2):
        want = {i: 0.6 * b + s + 0.3 * sum(w * want[u] for u, w in inbox.get(i, []) if u in want)
                for i, (b, s) in node.items()}
    nodes = spark.createDataFrame([(i, *v) for i, v in node.items()],
                                  "event_id string, base double, seed double")
    e = spark.createDataFrame(edges, "src string, dst string, kind string, weight double")
    got = {r.event_id: r.activation for r in A.spread(nodes, A.adjacency(e)).collect()}
    assert got == pytest.approx(want)


def test_inhibition_matches_a_loop(spark):
    rnd = random.Random(6)
    ids = [f"n{i}" for i in range(8)]
    pairs = [(rnd.choice(ids), rnd.choice(ids + ["ghost"])) for _ in range(9)] + [("n1", "n1")]
    want = {i: round(rnd.random() * 3, 3) for i in ids}
    start = dict(want)
    for _ in range(4):
        old = dict(want)
        for a, b in pairs:
            if a in old and b in old:
                want[a] = max(0.0, want[a] - 0.35 * old[b])
                want[b] = max(0.0, want[b] - 0.35 * old[a])
    nodes = spark.createDataFrame(list(start.items()), "event_id string, activation double")
    rivals = spark.createDataFrame(pairs, "src string, dst string")
    got = {r.event_id: r.activation for r in A.inhibit(nodes, rivals).collect()}
    assert got == pytest.approx(want)


def test_persistence_blends_only_with_a_past(spark):
    now = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "event_id string, activation double")
    empty = now.limit(0)
    assert rows(A.blend(now, empty), "event_id", "activation") == [("a", 1.0), ("b", 2.0)]
    past = spark.createDataFrame([("a", 3.0)], "event_id string, activation double")
    got = dict(rows(A.blend(now, past), "event_id", "activation"))
    assert got == pytest.approx({"a": 1.6, "b": 1.4})


def test_oscillation_dampens_the_winner(spark):
    now = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("c", 0.5)],
                                "event_id string, activation double")
    mem = spark.createDataFrame([("a", "w"), ("b", "r"), ("c", "x")],
                                "event_id string, thread_id string")
    got = dict(rows(A.oscillate(now, mem), "event_id", "activation"))
    assert got == pytest.approx({"a": 1.5, "b": 1.4, "c": 0.5})
    alone = dict(rows(A.oscillate(now, mem.filter("thread_id = 'w'")), "event_id", "activation"))
    assert alone == {"a": 2.0, "b": 1.0, "c": 0.5}


def test_dormant_members_return_through_incubation(make_log):
    old = "2020-01-01T00:00:00+00:00"
    log = make_log([{"type": "objective", "event_id": "o", "thread_ids": ["t-old"], "t": old},
                    {"type": "decision", "event_id": "d", "thread_ids": ["t-old"],
                     "causes": ["o"], "t": old}])
    g = G.build(log, AS_OF)
    seeds = {r.event_id: r.seed for r in A.seeds(g, AS_OF).collect()}
    assert seeds["d"] == 0.0
    lift = A.incubate(g)
    lifted = {r.event_id: r.lift for r in lift.collect()}
    assert lifted["d"] > 0.01
    seeds = {r.event_id: r.seed for r in A.seeds(g, AS_OF, incubation=lift).collect()}
    assert seeds["d"] == pytest.approx(0.5 * lifted["d"])


def test_resurfaced_thread_lifts_its_members(spark):
    now = spark.createDataFrame([("a", 0.5), ("b", 0.1)], "event_id string, activation double")
    mem = spark.createDataFrame([("a", "d1"), ("b", "d1"), ("b", "d2")],
                                "event_id string, thread_id string")
    thr = spark.createDataFrame([("d1", "dormant"), ("d2", "dormant"), ("e", "active")],
                                "thread_id string, status string")
    t, n = A.resurface(now, mem, thr)
    assert rows(t, "thread_id", "activation", "resurfaced") == [
        ("d1", 0.75, 1), ("d2", 0.1, 0), ("e", 0.0, 0)]
    assert dict(rows(n, "event_id", "activation")) == pytest.approx({"a": 0.625, "b": 0.225})


def test_procedures_wait_for_their_trigger(make_log):
    events = [{"type": "procedure_learned", "procedure_id": "prc_x", "trigger": ["Deploy now"],
               "outcome_score": 0.8},
              {"type": "open_loop", "id": "L", "msg": "write docs"}]
    g = G.build(make_log(events), AS_OF)
    assert A.triggered_procedures(g).count() == 0
    assert A.triggered_procedures(g, "please deploy now!").count() == 1
    g = G.build(make_log([*events, {"type": "open_loop", "id": "M", "msg": "we deploy now"}]),
                AS_OF)
    assert rows(A.triggered_procedures(g), "procedure_id") == [("prc_x",)]


def test_subgraph_walks_through_threads(make_log):
    log = make_log([{"type": "open_loop", "id": "L", "msg": "hot", "thread_ids": ["t"]},
                    {"type": "output", "event_id": "near", "thread_ids": ["t"]},
                    {"type": "output", "event_id": "far", "causes": ["near"],
                     "t": "2020-01-01T00:00:00+00:00"}])
    g = G.build(log, AS_OF)
    a = A.attend(g, AS_OF)
    assert rows(A.active_subgraph(g, a.nodes, 1), "event_id") == [("evt_1",), ("near",)]


def test_self_assessment_nudges_follow_thresholds(spark):
    cols = ("retrieval_effectiveness double, procedural_success double, cognitive_drift double, "
            "context_pollution double, attention_instability double")
    data = [(0.1, 0.2, 0.9, 0.7, 0.5), (0.5, 0.5, 0.1, 0.1, 0.0), (None, 0.6, None, None, None),
            (None,) * 5]
    got = mining.assessed(spark.createDataFrame(data, cols)).collect()
    assert list(got[0].nudges) == ["widen_retrieval", "review_procedures", "rerun_retrieval",
                                   "trigger_compaction", "enable_incubation"]
    assert list(got[1].nudges) == [] and got[1].confidence == pytest.approx(0.76)
    assert got[2].confidence == 0.6 and got[3].confidence is None


def test_a_loop_id_that_recurs_gives_one_verdict(make_log):
    """Events that repeat an id count by their last; a losing loop is named once."""
    loop = {"type": "open_loop", "event_id": "evt_loop", "msg": "pick"}
    log = make_log([{**loop, "id": "A"}, {**loop, "id": "B"}, {**loop, "id": "C"},
                    {"type": "decision", "event_id": "evt_d", "msg": "done"},
                    {"type": "contradiction", "between": ["evt_d", "evt_loop"]}])
    g = G.build(log, AS_OF)
    score = A.attend(g, AS_OF).contradictions.withColumn("src_score", F.lit(1.0)).withColumn(
        "dst_score", F.lit(0.0))
    found = A.resolve(g, A.Attention(None, None, score), log).collect()
    assert [(r.type, r.loser, r.id) for r in found] == [("loop_closed", "evt_loop", "C")]


def test_windows_share_the_links_of_a_graph(spark):
    """One table gives both adjacencies: with weaker ways back, and with equal ones."""
    e = spark.createDataFrame([("a", "b", "causal", 1.0), ("b", "a", "causal", 0.5),
                               ("a", "c", "concept", 0.7), ("a", "t", "membership", 1.0)],
                              "src string, dst string, kind string, weight double")
    both = {(r.v, r.u): (r.w, r.even) for r in A.links(e).collect()}
    for at, back in enumerate((0.6, 1.0)):
        one = {(r.v, r.u): r.w for r in A.adjacency(e, back).collect()}
        assert {k: w[at] for k, w in both.items()} == pytest.approx(one)
    assert both[("a", "b")] == pytest.approx((1.0 + 0.5 * 0.6, 1.5)) and len(both) == 4


def test_a_window_over_given_links_is_the_same(debate):
    g = G.build(debate, AS_OF)
    linked = stage(A.links(g.edges), "links")
    assert act(A.attend(g, AS_OF, agent="coder", linked=linked)) == pytest.approx(
        act(A.attend(g, AS_OF, agent="coder")))
    assert rows(A.incubate(g, linked), "event_id", "lift") == rows(A.incubate(g), "event_id", "lift")
