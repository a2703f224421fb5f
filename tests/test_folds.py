"""The aggregations of the memory folds against event-by-event loops."""

import random

import pytest

from mnemograph.operators import folds
from mnemograph.operators import graph as G
from tests.conftest import AS_OF, rows


def concept_loop(events):
    acc = {}
    for i, e in enumerate(events, 1):
        c = acc.get(e["concept_id"])
        if e["type"] == "concept_retired":
            if c:
                c["live"] = False
            continue
        if c is None:
            c = acc[e["concept_id"]] = {"seen": set(), "support": 0, "msg": None, "sal": None}
        c["live"] = True
        c["seen"] |= set(e.get("evidence") or [])
        grown = max(len(c["seen"]), c["support"] + 1)
        c["support"] = grown if e.get("support") is None else e["support"]
        c["msg"] = e.get("msg") or c["msg"]
        c["sal"] = c["sal"] if e.get("salience") is None else e["salience"]
    return acc


@pytest.mark.parametrize("seed", [1, 2])
def test_concepts_match_a_loop(make_log, seed):
    rnd = random.Random(seed)
    events = []
    for _ in range(120):
        cid = rnd.choice(["cpt_a", "cpt_a", "cpt_a", "cpt_b", "cpt_c"])
        if rnd.random() < 0.15:
            events.append({"type": "concept_retired", "concept_id": cid})
        else:
            events.append({
                "type": "concept_formed", "concept_id": cid,
                "evidence": [f"evt_{rnd.randrange(1, 40)}" for _ in range(rnd.randrange(4))],
                "support": rnd.choice([None] * 5 + [2, 30]),
                "salience": rnd.choice([None, None, None, 0.0, 0.7]),
                "msg": rnd.choice([None, "", f"m{rnd.randrange(9)}"])})
    log = make_log(events)
    want = {k: v for k, v in concept_loop(events).items() if v["live"]}
    table = folds.concepts(log, G.event_nodes(log), folds.concept_evidence(log), AS_OF, block=8)
    got = {r.concept_id: r for r in table.collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k].support == v["support"]
        assert got[k].summary == (v["msg"] or k)
        if v["sal"]:
            assert got[k].salience == v["sal"]
    ev = rows(folds.concept_evidence(log), "concept_id", "event_id")
    assert ev == sorted((k, e) for k, v in want.items() for e in v["seen"])


def procedure_loop(events):
    acc, out = {}, set()
    for e in events:
        pid, kind = e["procedure_id"], e["type"]
        if kind == "procedure_retired":
            out.add(pid)
        elif kind == "proc_executed":
            if pid in acc:
                p = acc[pid]
                old = 0.5 if p["score"] is None else p["score"]
                goal = 0.0 if (e.get("outcome") or "success").lower() == "failure" else 1.0
                p["score"] = min(1.0, max(0.0, old + 0.25 * (goal - old)))
                p["uses"] += 1
        else:
            out.discard(pid)
            p = acc.setdefault(pid, {"score": None, "uses": 0, "trigger": []})
            p["trigger"] = e.get("trigger") or p["trigger"]
            p["uses"] += kind == "procedure_learned"
            if e.get("outcome_score") is not None:
                p["score"] = e["outcome_score"]
            elif kind == "pattern_promoted" and p["score"] is None:
                p["score"] = e.get("confidence")
    return {k: v for k, v in acc.items() if k not in out}


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_procedures_match_a_loop(make_log, seed):
    rnd = random.Random(seed)
    kinds = ["proc_executed"] * 8 + ["procedure_learned", "pattern_promoted", "procedure_retired"]
    events = []
    for _ in range(150):
        kind = rnd.choice(kinds)
        seeds = kind in ("procedure_learned", "pattern_promoted")
        events.append({
            "type": kind, "procedure_id": rnd.choice(["prc_a", "prc_a", "prc_b", "prc_c"]),
            "outcome": rnd.choice([None, "success", "FAILURE"]) if not seeds else None,
            # Scores outside [0, 1] clamp at the first execution.
            "outcome_score": rnd.choice([None] * 4 + [0.3, 1.8, -2.0]) if seeds else None,
            "confidence": rnd.choice([None, 0.9]) if kind == "pattern_promoted" else None,
            "trigger": rnd.choice([None, [], ["x"], ["y", "z"]]) if seeds else None})
    want = procedure_loop(events)
    got = {r.procedure_id: r for r in folds.procedures(make_log(events), block=16).collect()}
    assert set(got) == set(want)
    for k, v in want.items():
        score = v["score"] if v["score"] is not None else round(
            min(0.9, 0.5 + 0.1 * (v["uses"] - 1)), 4)
        assert got[k].outcome_score == pytest.approx(score, abs=1e-9)
        assert got[k].uses == v["uses"]
        assert list(got[k].trigger) == v["trigger"]


def test_reinforcement_moves_the_score_both_ways(make_log):
    def score(*outcomes):
        log = make_log([{"type": "procedure_learned", "procedure_id": "prc_deploy",
                         "steps": ["build", "ship"]}] + [
            {"type": "proc_executed", "procedure_id": "prc_deploy", "outcome": o}
            for o in outcomes])
        r = folds.procedures(log).collect()[0]
        return r.outcome_score, r.uses
    fresh = score()
    assert fresh == (0.5, 1)
    assert score("success")[0] > fresh[0] > score("failure")[0]
    assert score(*["failure"] * 6)[0] < 0.25 and score(*["failure"] * 6)[1] == 7
    assert score("success", "failure")[0] == pytest.approx(0.46875)


def test_patterns_keep_first_citation_order_and_count_on(make_log):
    log = make_log([
        {"type": "pattern_detected", "pattern_id": "pat_x", "evidence": ["thr_1", "evt_9"]},
        {"type": "pattern_detected", "pattern_id": "pat_x", "frequency": 7, "confidence": 0.0,
         "evidence": ["cpt_1", "thr_1"], "label": "L", "kind": "success"},
        {"type": "pattern_detected", "pattern_id": "pat_x", "recommended": ["act"]}])
    p = folds.patterns(log).collect()[0]
    assert (p.kind, p.label, p.frequency, list(p.recommended)) == ("success", "L", 8, ["act"])
    assert p.confidence == 0.95  # an explicit zero counts as absent
    ev = folds.pattern_evidence(log).orderBy("place").collect()
    assert [(r.ref_id, r.ref_kind) for r in ev] == [
        ("thr_1", "thread"), ("evt_9", "event"), ("cpt_1", "concept")]


def test_salience_fades_with_old_evidence(make_log):
    log = make_log([
        {"type": "decision", "event_id": "e-old", "t": "2000-01-01T00:00:00+00:00"},
        {"type": "decision", "event_id": "e-new", "t": "2024-06-15T12:00:00+00:00"},
        {"type": "concept_formed", "concept_id": "cpt_old", "evidence": ["e-old"], "support": 3},
        {"type": "concept_formed", "concept_id": "cpt_new", "evidence": ["e-new"], "support": 3},
        {"type": "concept_formed", "concept_id": "cpt_set", "evidence": ["e-old"],
         "salience": 0.99}])
    s = {r.concept_id: r.salience for r in folds.concepts(
        log, G.event_nodes(log), folds.concept_evidence(log), AS_OF).collect()}
    assert s["cpt_new"] == 0.7 and s["cpt_old"] == 0.35 and s["cpt_set"] == 0.99
