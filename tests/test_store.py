import dataclasses
import os

from mnemograph.operators import lens
from mnemograph.plans.store import Store

NOW = "2024-06-15T12:00:00+00:00"


def log_bytes(home):
    out = {}
    for folder, _, names in os.walk(home / "log"):
        for n in names:
            out[n] = open(os.path.join(folder, n), "rb").read()
    return out


def test_empty_store_stays_untouched(spark, tmp_path):
    home = tmp_path / "none"
    s = Store(spark, str(home), NOW)
    assert s.restore() is None and s.checkpoint() is None and s.refresh() == {"drifted": 0}
    assert not home.exists()


def test_restore_checkpoint_and_projections(spark, tmp_path):
    s = Store(spark, str(tmp_path / "home"), NOW)
    s.append_frame(spark.createDataFrame([
        (1, "session_start", None, None, "s1", "demo", None),
        (2, "objective", "stand up the store", None, None, None, None),
        (3, "decision", "log is the truth", None, None, None, ["artifact:x"]),
        (4, "open_loop", "wire hooks", "loop-1", None, None, None),
        (5, "open_loop", "pick an index", "loop-2", None, None, None),
        (6, "loop_closed", None, "loop-2", None, None, None)],
        "ord int, type string, msg string, id string, session string, project string, "
        "links array<string>"))
    text = s.restore()
    assert "Project: demo" in text and "Last decision: log is the truth" in text
    assert "wire hooks - unresolved" in text and "pick an index" not in text
    text = s.checkpoint(reason="done for today")
    assert "Last status: paused" in text and "1 checkpoints" in text
    tail = [r.type for r in s.tail(2).collect()]
    assert tail == ["checkpoint", "session_end"]
    state = spark.read.json(str(tmp_path / "home/runtime/session_state")).collect()[0]
    assert (state.event_count, state.open_loop_count) == (8, 1)
    assert s.query("loops", 1).count() == 1 and s.verify()


def test_build_skips_when_fresh_and_lens_agrees(spark, tmp_path):
    s = Store(spark, str(tmp_path / "home"), NOW)
    s.append_frame(spark.createDataFrame([
        (1, "objective", "ship memory", None, ["t-core"]),
        (2, "open_loop", "finish the lens", "L", ["t-core"]),
        (3, "decision", "render once", None, ["t-core"])],
        "ord int, type string, msg string, id string, thread_ids array<string>"))
    assert s.build() is True and s.build() is False
    memory = s.working_memory()
    text = memory.render(NOW)
    assert "## Active threads" in text and "t-core" in text and "finish the lens" in text
    # A fresh event enters on top without a rebuild, and the budget trims from below.
    memory = memory.folded([{"event_id": "evt_9", "type": "decision", "msg": "brand new",
                             "thread_ids": ["t-new"]}])
    peak = memory.nodes.agg({"activation": "max"}).collect()[0][0]
    assert {r.event_id: r.activation for r in memory.nodes.collect()}["evt_9"] == peak
    assert "brand new" in memory.render(NOW) and "t-new" in memory.render(NOW)
    full = memory.folded([{"event_id": f"x{i}", "type": "decision", "msg": "filler " * 20}
                          for i in range(40)])
    text = full.render(NOW)
    assert full.view().chars(NOW, full.view().total) == len(text)
    small = full.within(700, NOW)
    assert len(small.render(NOW)) <= 700 and small.limit < full.view().total
    # Every tension is shown.
    pairs = spark.createDataFrame([(f"a{i}", f"b{i}", 0.5, 0.25) for i in range(400)],
                                  "src string, dst string, src_score double, dst_score double")
    tense = dataclasses.replace(memory, tensions=pairs)
    text = tense.render(NOW)
    assert text.count(" - leaning a") == 400
    assert tense.view().chars(NOW, tense.view().total) == len(text)
    s.append("decision", msg="log grew")
    assert s.build() is True


def test_dry_run_writes_nothing_and_apply_converges(spark, tmp_path):
    home = tmp_path / "home"
    s = Store(spark, str(home), NOW)
    rows = [(0, "session_start", None, None)]
    for t in ("thr_a", "thr_b"):
        rows += [(len(rows), "objective", "release service", [t]),
                 (len(rows) + 1, "command", "run tests", [t]),
                 (len(rows) + 2, "decision", "execute build", [t]),
                 (len(rows) + 3, "loop_closed", None, [t])]
    s.append_frame(spark.createDataFrame(
        rows, "ord int, type string, msg string, thread_ids array<string>"))
    before = log_bytes(home)
    dry = s.learn()
    assert [r.procedure_id for r in dry.collect()] == ["prc_run-execute"]
    s.mine(), s.snapshot(), s.introspect()
    assert log_bytes(home) == before
    s.learn(apply=True)
    assert s.learn().count() == 0
    made = s.graph().procedures.collect()
    assert made[0].uses == 1 and s.graph().procedure_evidence.count() == 4
    s.snapshot(apply=True)
    s.introspect(apply=True)
    types = [r.type for r in s.tail(3).collect()]
    assert types == ["procedure_learned", "snapshot", "meta_assessment"]
    assert s.audit().count() == 0


def test_working_context_respects_its_budget():
    state = {"project": None, "branch": None, "status": "active", "objective": None,
             "event_count": 1, "checkpoints": 0}
    loops = [{"salience": 0.5, "msg": "x" * 60}] * lens.LOOP_LINES
    text = lens.working_context(state, loops, None, None, NOW)
    assert len(text) == 6000 + len(lens.TRUNCATED) and "(no objective recorded)" in text


def test_command_line_round_trip(spark, tmp_path, capsys):
    from mnemograph import cli

    def run(*args):
        code = cli.run(cli.parser().parse_args(
            ["--root", str(tmp_path / "home"), "--as-of", NOW, *args]))
        return code, capsys.readouterr().out
    code, out = run("append", "decision", "msg=use sqlite", "thread_ids=t1,t2", "junk")
    assert code == 0 and '"event_id":"evt_1"' in out.replace(" ", "")
    code = cli.run(cli.parser().parse_args(["--root", str(tmp_path / "home"), "--as-of", NOW, "append",
                                            "concept_formed", "concept_id=cpt_x", "agent=coder", "evidence=evt_1"]))
    assert code == 0 and "curator-owned" in capsys.readouterr().err
    assert '"evt_2"' in run("audit")[1]
    assert "built" in run("build")[1] and "up to date" in run("build")[1]
    assert '"thread_id":"t1"' in run("threads")[1]
    assert "use sqlite" in run("search", "sqlite")[1]
    assert run("home")[1].strip() == str(tmp_path / "home")
    assert "coder" in run("roles")[1]
    assert run("append")[0] == 2
    more = tmp_path / "more.jsonl"
    more.write_text('{"type":"decision","msg":"from a file"}\n')
    assert run("ingest", str(more))[1].strip() == "1" and "from a file" in run("tail", "1")[1]
