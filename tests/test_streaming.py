"""Streams in small steps against the batch fold of the same log."""

import random
import uuid

import pytest
from pyspark.sql import functions as F

from mnemograph.operators import folds, retrieval
from mnemograph.session import stage_folder
from mnemograph.sources.schema import COLUMNS
from mnemograph.streaming import incremental as inc
from mnemograph.streaming import stateful

from .conftest import rows


@pytest.fixture
def arrive(spark):
    """Feed slices of a log to a job, each in its own run of the stream."""
    def go(job, log, slices, after=lambda out: None):
        home = f"{stage_folder(spark)}/arrive-{uuid.uuid4().hex}"
        for cond in slices:
            log.filter(cond).select(*COLUMNS).write.mode("append").parquet(f"{home}/log")
            job(inc.log_stream(spark, f"{home}/log"), f"{home}/data", f"{home}/checkpoint")
            after(f"{home}/data")
        return f"{home}/data"
    return go


def _procedure_events(rng, n):
    out = []
    for _ in range(n):
        kind = rng.choices(["proc_executed", "procedure_learned", "pattern_promoted",
                            "procedure_retired", "observation"], [12, 2, 1, 1, 1])[0]
        e = {"type": kind, "procedure_id": f"prc_{rng.randrange(4)}"}
        if kind == "proc_executed":
            e["outcome"] = rng.choice(["success", "Failure", "error", None])
            e["t"] = rng.choice(["", f"2024-06-{rng.randrange(10, 28)}T00:00:00+00:00"])
        elif kind != "procedure_retired" and rng.random() < 0.3:
            e["outcome_score"] = rng.choice([0.0, 0.4, 1.7])
        if kind == "pattern_promoted":
            e["confidence"] = rng.choice([0.8, None])
        if kind == "procedure_learned":
            e["part"] = rng.choice([None, 0, 1])
        out.append(e)
    return out


def _fold(df):
    return [(r[0], round(r[1], 9), r[2], r[3]) for r in rows(
        df, "procedure_id", "outcome_score", "uses", "last_used_t")]


@pytest.mark.parametrize("seed", [1, 2])
def test_procedures_equal_the_fold_in_any_order_of_arrival(spark, make_log, arrive, seed):
    log = make_log(_procedure_events(random.Random(seed), 120))
    # Later thirds first: every key sees late learnings, scores and executions.
    slices = [F.col("seq") % 3 == k for k in (2, 0, 1)] if seed == 1 else [
        F.col("seq") > 80, F.col("seq") <= 40, (F.col("seq") > 40) & (F.col("seq") <= 80)]
    out = arrive(stateful.learn_procedures, log, slices)
    assert _fold(stateful.learned_procedures(spark, out)) == _fold(folds.procedures(log))


def test_late_learning_counts_executions_that_waited(spark, make_log, arrive):
    events = [{"type": "proc_executed", "procedure_id": "p", "outcome": "fail"}] * 5
    events += [{"type": "procedure_learned", "procedure_id": "p"}]
    events += [{"type": "proc_executed", "procedure_id": "p"}] * 300
    log = make_log(events)
    out = arrive(stateful.learn_procedures, log, [F.col("seq") > 6, F.col("seq") <= 6])
    got = stateful.learned_procedures(spark, out).collect()
    assert [(r.procedure_id, r.uses) for r in got] == [("p", 301)]
    assert abs(got[0].outcome_score - 1.0) < 1e-12
    assert rows(stateful.learned_scores(spark, out), "procedure_id", "uses") == [("p", 305)]


def test_unlearned_and_retired_procedures_are_not_live(spark, make_log, arrive):
    log = make_log([{"type": "proc_executed", "procedure_id": "only_run"},
                    {"type": "procedure_learned", "procedure_id": "gone"},
                    {"type": "procedure_retired", "procedure_id": "gone"},
                    {"type": "procedure_learned", "procedure_id": None}])
    out = arrive(stateful.learn_procedures, log, [F.lit(True)])
    assert stateful.learned_procedures(spark, out).count() == 0


def test_timers_mark_and_late_events_wake(spark, make_log, arrive):
    def at(day, *threads):
        return {"type": "observation", "t": f"2024-05-{day:02d}T00:00:00+00:00",
                "thread_ids": list(threads)}
    log = make_log([at(1, "a", "b", "a"), at(20, "c"), at(10, "a"), at(2, "b"), at(23, "c"),
                    {"type": "observation", "t": "", "thread_ids": ["no_time"]}])
    # 14 days after May 1 pass with the second event; both are late, one wakes its thread.
    steps = [[1], [2], [3, 4], [5, 6]]
    seen = []
    out = arrive(stateful.watch_threads, log, [F.col("seq").isin(s) for s in steps],
                 lambda out: seen.append(dict(rows(inc.newest(spark, out, "thread_id"),
                                                   "thread_id", "status"))))
    assert seen[0] == {"a": "active", "b": "active"}
    assert seen[1] == {"a": "dormant", "b": "dormant", "c": "active"}
    assert seen[2] == {"a": "active", "b": "dormant", "c": "active"}
    assert seen[3] == {"a": "active", "b": "dormant", "c": "active", "no_time": "active"}
    counts = dict(rows(inc.newest(spark, out, "thread_id"), "thread_id", "n_events"))
    assert counts == {"a": 2, "b": 2, "c": 2, "no_time": 1}


def test_thread_status_is_a_plain_aggregation(spark, make_log, arrive, monkeypatch):
    """No thread costs a call of Python; a batch without times and an event without threads count."""
    monkeypatch.setattr(stateful, "run_stateful", None)
    events = [{"type": "observation", "t": "", "thread_ids": ["x", None]},
              {"type": "observation", "t": "2024-05-01T00:00:00+00:00", "thread_ids": ["y", "x"]},
              {"type": "observation", "t": "2024-05-15T00:00:00+00:00"},
              {"type": "observation", "t": "2024-05-15T00:00:01+00:00"}]
    seen = []
    arrive(stateful.watch_threads, make_log(events), [F.col("seq") == i for i in (1, 2, 3, 4)],
           lambda out: seen.append(rows(inc.newest(spark, out, "thread_id"), "thread_id", "n_events", "status")))
    assert seen[0] == [("x", 1, "active")]
    assert seen[1] == seen[2] == [("x", 2, "active"), ("y", 1, "active")]
    assert seen[3] == [("x", 2, "dormant"), ("y", 1, "dormant")]


def test_drift_equals_the_batch_in_any_order_of_arrival(spark, make_log, arrive):
    rng = random.Random(5)
    words = ["parser", "cache", "deploy", "token", "graph", "", "the"]
    log = make_log([{"type": rng.choice(["observation", "decision"]),
                     "session": rng.choice(["s1", "s2", "s3", None]),
                     "msg": " ".join(rng.choices(words, k=3))} for _ in range(60)]
                   + [{"type": "observation", "session": "short", "msg": "cache"}] * 5)
    out = arrive(stateful.watch_drift, log, [F.col("seq") > 40, F.col("seq") <= 20,
                                             F.col("seq").between(21, 40)])
    cols = ("session", "drift", "drifted")
    assert rows(stateful.session_drift(spark, out), *cols) == rows(
        retrieval.drift_per_session(log), *cols)


def test_drift_calls_no_python_and_forgets_what_is_gone(spark, make_log, arrive, monkeypatch):
    """Newest rows are found by ranks; a late batch, an untouched session and a whole table count."""
    monkeypatch.setattr(stateful, "run_stateful", None)
    monkeypatch.setattr(stateful, "WHOLE", 2)
    log = make_log([{"type": "observation", "session": s, "msg": m} for s, m in (
        [("a", "cache parser")] * 12 + [("b", "cache")] * 3 + [("a", "the")] * 4
        + [("b", "token"), ("b", "deploy cache"), ("b", "graph")] + [("c", "parser")] * 16
        + [("a", "")] * 20)])
    cols = ("session", "drift", "drifted")
    seq = F.col("seq")
    steps, seen = [seq.between(5, 15), seq <= 4, seq.between(16, 22), seq.between(23, 38), seq > 38], []

    def after(out):
        upto = F.lit(False)
        for s in steps[:len(seen) + 1]:
            upto = upto | s
        assert rows(stateful.session_drift(spark, out), *cols) == rows(
            retrieval.drift_per_session(log.filter(upto)), *cols)
        seen.append(inc.newest(spark, out, "session").count())
    arrive(stateful.watch_drift, log, steps, after)
    assert seen[0] == 1 and seen[-1] == 3       # a, then b with six rows and c
