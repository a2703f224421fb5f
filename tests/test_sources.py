import json

import pytest

from mnemograph.plans.store import Store
from mnemograph.sources import facts, jsonl, sinks
from tests.conftest import rows


@pytest.fixture
def log_file(tmp_path):
    lines = [
        '{"t":"2024-06-01T10:00:00+02:00","type":"session_start","session":"s1","branch":"b"}',
        "", "   ", "{broken", "[1, 2]",
        '{"t":"2024-06-01T10:05:00+02:00","type":"decision","msg":"line separator",'
        '"thread_ids":"a, b,,c","support":"7","salience":"0.5"}',
        '{"t":"nonsense","type":"error","thread_ids":["x",""],"support":"many","id":3}',
        '{"type":"procedure_learned","steps":"one, still one","trigger":["p","q"],"from":"main"}',
    ]
    path = tmp_path / "events.jsonl"
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_scan_skips_blank_and_malformed_lines(spark, log_file):
    log = jsonl.read_log(spark, log_file)
    got = {r.seq: r for r in log.collect()}
    assert sorted(got) == [1, 2, 3, 4]
    assert [got[i].type for i in (1, 2, 3, 4)] == [
        "session_start", "decision", "error", "procedure_learned"]
    assert got[2].event_id == "evt_2"
    assert jsonl.malformed_lines(spark, log_file).count() == 2
    assert jsonl.line_count(spark, log_file) == 6


def test_field_coercions(spark, log_file):
    got = {r.seq: r for r in jsonl.read_log(spark, log_file).collect()}
    assert got[2].thread_ids == ["a", "b", "c"]
    assert got[2].msg == "line separator"
    assert (got[2].support, got[2].salience) == (7, 0.5)
    assert got[3].thread_ids == ["x"] and got[3].support is None and got[3].ts is None
    assert got[3].id == "3"
    assert got[4].steps == ["one, still one"] and got[4].trigger == ["p", "q"]
    assert got[4].base == "main"


def test_seq_follows_many_splits(spark, tmp_path):
    path = tmp_path / "big.jsonl"
    with path.open("w") as fh:
        for i in range(4000):
            fh.write(json.dumps({"type": "decision", "msg": f"m{i + 1}"}) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        log = jsonl.read_log(spark, str(path))
        got = log.select("seq", "msg").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 4000 and all(r.msg == f"m{r.seq}" for r in got)


def test_append_allocates_ids_and_round_trips(spark, tmp_path):
    s = Store(spark, str(tmp_path / "home"), as_of="2024-06-15T12:00:00+00:00")
    assert s.log().count() == 0 and not (tmp_path / "home").exists()
    first = s.append("objective", msg="go", branch="main")
    assert first["event_id"] == "evt_1" and first["layer"] == "cognitive"
    assert "branch" not in first and first["t"] == "2024-06-15T12:00:00+00:00"
    s.append("decision", msg="use sqlite", thread_ids="t1, t2", causes="evt_1")
    third = s.append("artifact", path="a.py")
    assert third["event_id"] == "evt_3" and third["layer"] == "execution"
    got = {r.seq: r for r in s.log().collect()}
    assert got[2].thread_ids == ["t1", "t2"] and got[2].causes == ["evt_1"]
    with pytest.raises(ValueError):
        s.append("")


def test_notes_flag_unknown_types_and_foreign_conclusions(make_log):
    log = make_log([{"type": "mystery"}, {"type": "concept_formed", "agent": "coder"},
                    {"type": "concept_formed", "agent": "memory"}, {"type": "concept_formed"}])
    assert [r[0] for r in rows(sinks.notes(log), "type")] == ["concept_formed", "mystery"]


def test_key_value_arguments():
    assert sinks.parse_pairs(["a=1", "junk", "b = x=y "]) == {"a": "1", "b": "x=y"}


def test_facts_parse_filter_and_search(spark, tmp_path):
    for i, (concept, tags, text) in enumerate([
            ("Session pooling", ["python", "Async"], "Pools keep sessions warm."),
            ("Auth tokens", ["security"], "Tokens expire hourly."),
            ("Token cache", ["python"], "The cache keeps tokens close.")], 1):
        name, body = facts.fact_text(i, concept, text, tags, "high" if i < 3 else "", "here",
                                     "2024-01-01")
        (tmp_path / name).write_text(body)
    (tmp_path / "FACT-009_plain.md").write_text("no front matter, just tokens")
    (tmp_path / "notes.md").write_text("ignored")
    df = facts.read_facts(spark, str(tmp_path)).cache()
    got = {r.id: r for r in df.collect()}
    assert set(got) == {"FACT-001", "FACT-002", "FACT-003", "FACT-009_plain.md"}
    one = got["FACT-001"]
    assert (one.concept, one.confidence, one.tags) == (
        "Session pooling", "high", ["python", "Async"])
    assert one.statement == "Pools keep sessions warm."
    assert got["FACT-003"].confidence == "medium"
    assert rows(facts.filtered(df, ["PYTHON"]), "id") == [("FACT-001",), ("FACT-003",)]
    assert rows(facts.filtered(df, ["python", "async"], "high"), "id") == [("FACT-001",)]
    hits = [r.id for r in facts.search(df, "tokens expire").collect()]
    assert hits[0] == "FACT-002" and "FACT-001" not in hits


def test_long_citation_lists_split_without_loss(spark):
    ev = spark.range(2500).selectExpr("'k' AS key", "concat('evt_', id) AS ref")
    parts = sinks.chunked_refs(ev, "key", "ref", 1000).collect()
    assert {p.part for p in parts} == {0, 1, 2}
    assert sum(len(p.refs) for p in parts) == 2500
