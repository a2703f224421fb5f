"""The columnar log: positions, parallel writers, folding, merging and readers behind."""

import json
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F

from mnemograph.plans.store import Store
from mnemograph.sources import event_log
from mnemograph.sources.event_log import EventLog
from mnemograph.sources.schema import conform
from mnemograph.sources.versions import Versions
from tests.conftest import rows

NOW = "2024-06-15T12:00:00+00:00"


def frame(spark, texts, **more):
    return spark.createDataFrame([(i, "decision", t) for i, t in enumerate(texts)],
                                 "ord int, type string, msg string")


def test_parallel_writers_take_distinct_positions(spark, tmp_path):
    def work(n):
        s = Store(spark, str(tmp_path / "home"), NOW)
        mine = [s.append("decision", msg=f"w{n}-{i}")["event_id"] for i in range(6)]
        s.append_frame(frame(spark, [f"b{n}-{i}" for i in range(5)]))
        return mine

    with ThreadPoolExecutor(4) as pool:
        given = [e for ids in pool.map(work, range(4)) for e in ids]
    log = {r.msg: r for r in Store(spark, str(tmp_path / "home")).log().collect()}
    assert sorted(r.seq for r in log.values()) == list(range(1, 45))
    assert len({r.event_id for r in log.values()}) == 44 and set(given) <= {
        r.event_id for r in log.values()}
    for n in range(4):      # each writer's events are in its own order, a batch without gaps
        single = [log[f"w{n}-{i}"].seq for i in range(6)]
        batch = [log[f"b{n}-{i}"].seq for i in range(5)]
        assert single == sorted(single) and batch == list(range(batch[0], batch[0] + 5))


def test_tail_folds_and_batches_merge_without_changing_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(event_log, "TAIL_LINES", 5)
    monkeypatch.setattr(event_log, "MERGE_FROM", 3)
    s = Store(spark, str(tmp_path / "home"), NOW)
    want = []
    for i in range(23):
        if i % 7 == 3:
            s.append_frame(frame(spark, [f"f{i}-{k}" for k in range(3)]))
            want += [f"f{i}-{k}" for k in range(3)]
        else:
            s.append("decision", msg=f"m{i}", causes="evt_1", odd={"deep": [i]})
            want.append(f"m{i}")
    log = s.log()
    got = sorted((r.seq, r.msg, r.event_id) for r in log.collect())
    assert got == [(i, m, f"evt_{i}") for i, m in enumerate(want, 1)]
    assert json.loads(log.where("msg = 'm0'").collect()[0].rest) == {"odd": {"deep": [0]}}
    state = s.events.state()
    assert len(state["batches"]) <= 6 and len(state["tail"]) < 5 and len(state["gone"]) >= 1
    # A reader that knows a position opens only what lies behind it.
    last = state["batches"][-1]
    new = s.events.read(after=last["first"] - 1)
    assert rows(new, "seq") == [(i,) for i in range(last["first"], len(want) + 1)]
    assert all(last["home"] in f for f in new.inputFiles())
    s.events.fold_tail()
    assert rows(s.log(), "seq", "msg") == [(i, m) for i, m in enumerate(want, 1)]


def test_log_plan_neither_parses_json_nor_reads_other_columns(spark, tmp_path):
    s = Store(spark, str(tmp_path / "home"), NOW)
    s.append_frame(frame(spark, ["a", "b"]))
    plan = s.log().select("seq", "type")._jdf.queryExecution().executedPlan().toString()
    assert "parse_json" not in plan and "pos:bigint,type:string" in plan.replace("`", "")
    assert "Window" not in plan and "msg" not in plan.split("ReadSchema")[1]


def test_ingest_keeps_positions_ids_and_counts_malformed_lines(spark, tmp_path):
    a, b = tmp_path / "in" / "a.jsonl", tmp_path / "in" / "b.jsonl"
    a.parent.mkdir()
    a.write_text('{"type":"decision","msg":"x"}\n{broken\n\n{"type":"error","event_id":"own"}\n')
    b.write_text('{"type":"decision","msg":"y"}\n')
    s = Store(spark, str(tmp_path / "home"), NOW)
    s.append("objective", msg="first")
    assert s.ingest(str(a), str(b)) == 3 and s.line_count() == 5
    assert rows(s.log(), "seq", "event_id", "type") == [
        (1, "evt_1", "objective"), (2, "evt_2", "decision"), (3, "own", "error"), (4, "evt_4", "decision")]


def test_a_late_writer_cannot_take_a_removed_number(spark, tmp_path, monkeypatch):
    from mnemograph.sources import versions
    monkeypatch.setattr(versions, "KEPT", 3)
    v = Versions(spark, str(tmp_path / "v"))
    for i in range(6):
        v.update(lambda old: {"n": (old or {"n": 0})["n"] + 1})
    assert v.numbers() == [4, 5, 6]
    slept = iter([{"n": 1, "number": 1, "commits": []}])
    real = Versions.newest
    monkeypatch.setattr(Versions, "newest", lambda self: next(slept, None) or real(self))
    assert v.update(lambda old: {"n": old["n"] + 1})["number"] == 7
    assert v.newest()["n"] == 7 and 2 not in v.numbers()
    assert not v._publish(7, {"n": 0})


def test_empty_batch_and_absent_log(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    assert log.read().count() == 0 and log.count() == 0 and not (tmp_path / "log").exists()
    s = Store(spark, str(tmp_path / "home"), NOW)
    s.append_frame(frame(spark, []))
    assert s.log().count() == 0
    s.append("decision", msg="one")
    assert rows(s.log(), "seq", "event_id") == [(1, "evt_1")]


def test_a_batch_is_parsed_once(spark, tmp_path):
    """Ranges are sampled; that pass must not parse every event again."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def heard(msg):
        seen.add(1)
        return msg
    events = conform(spark.range(1, 41), seq=F.col("id"), type=F.lit("decision"),
                     msg=heard(F.col("id").cast("string"))).withColumn("pos", F.col("seq"))
    log = EventLog(spark, str(tmp_path / "log"))
    log.append_batch(events)
    assert seen.value == 40
    assert [(r.seq, r.msg) for r in log.read().orderBy("seq").collect()] == [(i, str(i)) for i in range(1, 41)]
