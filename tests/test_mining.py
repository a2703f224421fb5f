import pytest

from mnemograph.operators import folds, mining
from mnemograph.operators import graph as G
from mnemograph.operators import retrieval
from tests.conftest import AS_OF, rows


def run(tid, closed=True):
    events = [{"type": "objective", "msg": "release the service", "thread_ids": [tid]},
              {"type": "command", "msg": "run tests", "thread_ids": [tid]},
              {"type": "command", "msg": "execute build", "thread_ids": [tid]},
              {"type": "artifact", "path": "deploy.log", "thread_ids": [tid]}]
    return events + ([{"type": "loop_closed", "thread_ids": [tid]}] if closed else [])


def test_recurring_term_becomes_a_concept(make_log):
    log = make_log([{"type": "decision", "msg": "sqlite store"}] * 4
                   + [{"type": "observation", "msg": "sqlite works"}])
    g = G.build(log, AS_OF)
    proposals, evidence = mining.abstract_graph(g)
    got = {r.concept_id: r.support for r in proposals.collect()}
    assert got == {"cpt_sqlite": 5, "cpt_store": 4}
    assert evidence.filter("concept_id = 'cpt_sqlite'").count() == 5


def test_generic_terms_drop_out_of_a_large_corpus(spark):
    texts = ["update file sqlite"] * 3 + ["update file cache"] * 3 + ["update file token"] * 3
    docs = spark.createDataFrame(list(enumerate([*texts, "update file"])), "id int, text string")
    got = {r.term for r in mining.abstract(docs, "id", docs.text)[0].collect()}
    assert got == {"sqlite", "cache", "token"}


def test_workflow_is_learned_from_successful_threads_only(make_log):
    g = G.build(make_log(run("thr_a") + run("thr_b") + run("thr_c", closed=False)), AS_OF)
    proposals, evidence = mining.learn(g, block=3)
    p = proposals.collect()
    assert [(r.procedure_id, r.support) for r in p] == [("prc_run-execute-deploy", 2)]
    assert p[0].label == "workflow: run → execute → deploy"
    assert list(p[0].steps) == ["command: run tests", "command: execute build",
                                "artifact: deploy.log"]
    assert list(p[0].trigger) == ["release", "service"]
    assert evidence.count() == 6
    alone = G.build(make_log(run("thr_a") + run("thr_c", closed=False)), AS_OF)
    assert mining.learn(alone)[0].count() == 0


def test_step_order_matters_for_a_signature(make_log):
    swapped = run("thr_b")
    swapped[1], swapped[2] = swapped[2], swapped[1]
    g = G.build(make_log(run("thr_a") + swapped), AS_OF)
    assert mining.learn(g)[0].count() == 0


def test_four_kinds_of_patterns_and_idempotency(make_log):
    events = run("thr_a") + run("thr_b")
    for t in ("thr_c", "thr_d"):
        events += [{"type": "error", "msg": "timeout again", "thread_ids": [t]}]
    events += [{"type": "hypothesis", "msg": "h", "thread_ids": [t]} for t in ("thr_e", "thr_f")]
    for t in ("thr_e", "thr_f"):
        events += [{"type": "observation", "thread_ids": [t]}, {"type": "decision",
                                                                "thread_ids": [t]}]
    events += [{"type": "open_loop", "id": "L", "msg": "stuck", "event_id": "hub",
                "thread_ids": ["thr_g"]}]
    events += [{"type": "output", "causes": ["hub"]}] * 3
    g = G.build(make_log(events), AS_OF)
    proposals, evidence = mining.mine(g, block=4)
    got = {r.pattern_id: (r.kind, r.frequency, r.confidence) for r in proposals.collect()}
    assert got == {
        "pat_reason_hypothesis-observation-decision": ("reasoning", 2, 0.6),
        "pat_fail_timeout": ("failure", 2, 0.6),
        "pat_success_run-execute-deploy": ("success", 2, 0.6),
        "pat_bottleneck_hub": ("bottleneck", 3, 0.7)}
    refs = {r[0] for r in rows(evidence.filter("pattern_id LIKE 'pat_success%'"), "ref_id")}
    assert {"thr_a", "thr_b"} < refs and len(refs) == 8
    seen = [{"type": "pattern_detected", "pattern_id": p} for p in got]
    again = G.build(make_log(events + seen), AS_OF)
    assert mining.mine(again)[0].count() == 0


def test_promotion_carries_confidence_and_is_sticky(make_log):
    events = [
        {"type": "objective", "msg": "fix flaky tests", "thread_ids": ["thr_1"]},
        {"type": "pattern_detected", "pattern_id": "pat_success_run-tests-then-patch",
         "kind": "success", "confidence": 0.85, "label": "successful path: run → tests → patch",
         "evidence": ["thr_1", "evt_2"]},
        {"type": "pattern_detected", "pattern_id": "pat_success_weak", "kind": "success",
         "confidence": 0.6},
        {"type": "pattern_detected", "pattern_id": "pat_fail_x", "kind": "failure",
         "confidence": 0.9}]
    log = make_log(events)
    proposals, evidence = mining.promote(G.build(log, AS_OF), log)
    p = proposals.collect()
    assert len(p) == 1 and p[0].procedure_id == "prc_run-tests-then-patch"
    assert list(p[0].steps) == ["run", "tests", "patch"] and p[0].confidence == 0.85
    assert list(p[0].trigger) == ["fix", "flaky", "tests"]
    assert p[0].label == "promoted workflow: run → tests → patch"
    assert [r[0] for r in rows(evidence, "ref_id")] == [
        "evt_2", "pat_success_run-tests-then-patch", "thr_1"]
    done = {"type": "pattern_promoted", "pattern_id": p[0].pattern_id,
            "procedure_id": p[0].procedure_id, "confidence": 0.85}
    used = {"type": "proc_executed", "procedure_id": p[0].procedure_id}
    log = make_log([*events, done, used])
    r = folds.procedures(log).collect()[0]
    assert r.uses == 1 and r.outcome_score == pytest.approx(0.8875)
    assert mining.promote(G.build(log, AS_OF), log)[0].count() == 0


def test_cold_uncited_concepts_are_pruned(make_log):
    events = [{"type": "decision", "event_id": "d1"},
              {"type": "decision", "event_id": "d2", "thread_ids": ["t-live"]},
              {"type": "concept_formed", "concept_id": "cpt_cold", "evidence": ["d1"]},
              {"type": "concept_formed", "concept_id": "cpt_cited", "evidence": ["d1", "d2"]},
              {"type": "concept_formed", "concept_id": "cpt_bare"}]
    assert mining.prune(G.build(make_log(events), AS_OF)).count() == 0
    g = G.build(make_log([*events, {"type": "snapshot", "snapshot_seq": 5}]), AS_OF)
    assert rows(mining.prune(g), "concept_id", "reason") == [
        ("cpt_cold", "stale: all 1 evidence episodes cold, no active citation")]


def test_failing_procedures_are_retired(spark):
    df = spark.createDataFrame([("a", 0.2, 3), ("b", 0.2, 2), ("c", 0.25, 9)],
                               "procedure_id string, outcome_score double, uses bigint")
    assert rows(mining.retire_procedures(df), "procedure_id", "reason") == [
        ("a", "chronic failure: outcome_score 0.2 after 3 executions")]


def test_vector_search_finds_shared_words_only(spark):
    docs = spark.createDataFrame([("d-pool", "session pool keeps connections"),
                                  ("d-auth", "auth tokens and session expiry"),
                                  ("d-ui", "button colors")], "id string, body string")
    hits = [r.id for r in retrieval.tfidf_search(docs, "id", docs.body,
                                                 "connections pool session").collect()]
    assert hits == ["d-pool", "d-auth"]
    assert retrieval.tfidf_search(docs, "id", docs.body, "").count() == 0
    assert retrieval.tfidf_search(docs, "id", docs.body, "zebra").count() == 0


def test_bm25_prefixes_ignore_accents_and_case(spark):
    docs = spark.createDataFrame([(1, "Café society"), (2, "cafeteria"), (3, "tea"), (4, "x")],
                                 "id int, body string")
    got = [r.id for r in retrieval.bm25_scores(docs, "id", docs.body, "CAFÉ!").collect()]
    assert sorted(got) == [1, 2]
    assert retrieval.bm25_scores(docs, "id", docs.body, "!?").count() == 0


def test_rerank_rescores_the_head(make_log):
    from pyspark.sql import functions as F
    log = make_log([{"type": "decision", "msg": f"cache note {i}"} for i in range(4)])
    plain = [r.seq for r in retrieval.search(log, "cache", AS_OF).collect()]
    assert plain == [1, 2, 3, 4]
    flipped = retrieval.search(
        log, "cache", AS_OF,
        rerank=lambda df: df.withColumn("relevance", F.col("seq") / 4.0))
    assert [r.seq for r in flipped.collect()] == [4, 3, 2, 1]


def test_substring_hits_need_no_word_boundary(spark):
    needles = spark.createDataFrame([("ploy",), ("zz",), ("a",), ("now we",)], "needle string")
    hay = spark.createDataFrame([("deploy now",), ("we wait",)], "hay string")
    assert rows(retrieval.substring_hits(needles, hay), "needle") == [("a",), ("ploy",)]
    empty = hay.limit(0)
    assert retrieval.substring_hits(needles, empty).count() == 0


def test_drift_spikes_on_a_turn_only(make_log):
    same = [{"type": "decision", "msg": "tune sqlite cache"}] * 16
    turn = same[:11] + [{"type": "decision", "msg": "paint garden fence",
                         "id": "other", "reason": "spring weekend plans outside"}] * 5
    assert retrieval.drift(make_log(same)).collect()[0].drift == 0.0
    r = retrieval.drift(make_log(turn)).collect()[0]
    assert 0.5 < r.drift < 1.0
    assert retrieval.drift(make_log(same[:5])).collect()[0].drift == 0.0


def test_substring_hits_in_a_long_text(spark):
    words = " ".join(f"wordy{i % 977}x" for i in range(12_000))
    needles = spark.createDataFrame([("wordy976x wordy0x",), ("dy5x w",), ("absent words",), ("wordy977",)],
                                    "needle string")
    hay = spark.createDataFrame([(words,)], "hay string")
    assert rows(retrieval.substring_hits(needles, hay), "needle") == [
        ("dy5x w",), ("wordy976x wordy0x",)]
