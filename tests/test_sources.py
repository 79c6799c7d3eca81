"""Sources and sinks: rooted reads, git history, gold and review files, upserts, versions, carried claims."""

import json
import os
import subprocess

import pytest

from tessella.api import Index, IndexReplaced, RepoMismatch
from tessella.plans.merge import VersionedFolder, deleted, insert_missing, upsert
from tessella.sources import records
from tessella.sources.files import ReadRefused, commits, read_rooted


def refused(root, path, limit=100):
    with pytest.raises(ReadRefused) as e:
        read_rooted(str(root), path, limit)
    return str(e.value)


def test_reads_stay_below_the_root(tmp_path):
    root = tmp_path / "r"
    (root / "d").mkdir(parents=True)
    (root / "d" / "a.py").write_bytes(b"x = 1\n")
    (root / "big.py").write_bytes(b"x" * 101)
    (tmp_path / "secret").write_bytes(b"s")
    os.symlink(tmp_path / "secret", root / "link")
    os.symlink(root / "d", root / "dirlink")
    os.mkfifo(root / "pipe")
    assert read_rooted(str(root), "d/./a.py", 100) == b"x = 1\n"
    assert [refused(root, p) for p in ("../secret", "/etc/passwd", "", "a\0b", "link", "dirlink/a.py")] == ["path_escapes_repo"] * 6
    assert [refused(root, p) for p in ("no.py", "d", "pipe", "big.py")] == ["file_missing", "file_not_regular", "file_not_regular", "file_too_large"]


def test_git_history(spark, tmp_path):
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    (tmp_path / "a.py").write_text("a = 1\n")
    git("add", "."), git("commit", "-qm", "First subject\n\nBody line.\n")
    (tmp_path / "b.py").write_text("b = 1\n")
    git("add", "."), git("commit", "-qm", "Second")
    rows = {r.subject: r for r in commits(spark, str(tmp_path)).collect()}
    assert rows["First subject"].body == "Body line." and rows["First subject"].files == ["a.py"] and rows["Second"].files == ["b.py"]
    assert commits(spark, str(tmp_path / "none")).count() == 0


def test_gold_files_go_round_and_faults_raise(spark, rows, tmp_path):
    schema = "query_id string, query string, relevant array<string>, source string, repo string, notes string"
    gold = rows(schema, ("q2", "what é", ["a", "b"], "s", "r", None), ("q1", "how", ["c"], "s", "r", "n"))
    path = str(tmp_path / "g.json")
    records.write_gold(gold, path)
    assert sorted(map(tuple, records.read_gold(spark, [path]).collect())) == sorted(map(tuple, gold.collect()))
    for bad in ({"query_id": "", "relevant": ["a"]}, {"query_id": "x", "relevant": []}, {"query_id": "x", "relevant": ["a", "a"]}):
        (tmp_path / "bad.json").write_text(json.dumps({"queries": [bad]}))
        with pytest.raises(ValueError):
            records.read_gold(spark, [str(tmp_path / "bad.json")])


def test_runs_and_transcripts(spark, rows, tmp_path):
    for i, ok in enumerate((True, False)):
        (tmp_path / f"{i}.json").write_text(json.dumps({"run_id": str(i), "ok": ok, "tool_call_counts": {"a": 2}}))
    assert [r.run_id for r in records.read_runs(spark, str(tmp_path)).collect()] == ["0"] and records.read_runs(spark, str(tmp_path), True).count() == 2
    lines = rows(
        "run_id string, value string",
        ("r", json.dumps({"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "x"}, {"type": "text"}], "usage": {"input_tokens": 3, "output_tokens": 4}}})),
        ("r", json.dumps({"type": "user"})), ("r", "{broken"), ("r", None),
    )
    r = records.fold_transcript(lines).first()
    assert (r.answers, r.tool_calls, r.input_tokens, r.output_tokens) == (1, 1, 3, 4)


def test_blind_review(rows):
    judged = rows("assertion_id long, subject string, claim string, citations string, evidence string, label string", *((i, "s", f"c{i}", "x", "e", ("supported", "supported", "not supported")[i % 3]) for i in range(30)))
    sheet, key = records.review_sample(judged, 12)
    assert "label" not in sheet.columns and sheet.count() == 12 and {r.label for r in key.collect()} == {"supported", "not supported"}
    filled = key.selectExpr("assertion_id", "CASE WHEN assertion_id = (SELECT 1) THEN 'x' ELSE label END AS human").drop("label")
    score = records.review_scores(key.selectExpr("assertion_id", "label AS human"), key).first()
    assert score.agreement == 1.0 and score.kappa == 1.0 and score.unanswered == 0 and filled.count() == 12
    assert records.review_scores(key.selectExpr("assertion_id", "'' AS human"), key).first().unanswered == 12


def test_upserts_and_deletes(rows):
    s = "k string, v int, at int"
    old = rows(s, ("a", 1, 1), ("b", 2, 1), (None, 3, 1))
    new = rows(s, ("b", 5, 2), ("b", 4, 3), (None, 6, 1), ("c", 7, 1))
    get = lambda d: sorted(map(tuple, d.collect()), key=repr)
    assert get(upsert(old, new, ["k"], "at")) == get(rows(s, ("a", 1, 1), ("b", 4, 3), (None, 6, 1), ("c", 7, 1)))
    assert get(insert_missing(old, new, ["k"])) == get(rows(s, ("a", 1, 1), ("b", 2, 1), (None, 3, 1), ("c", 7, 1)))
    assert get(deleted(old, new, ["k"])) == [("a", 1, 1)]
    assert upsert(old.limit(0), new.limit(0), ["k"]).count() == 0


def test_versions_appear_whole_and_claims_are_carried(spark, rows, tmp_path):
    tree = tmp_path / "t"
    tree.mkdir()
    (tree / "m.py").write_text("def free(x):\n    return help_me(x)\n\n\ndef help_me(x):\n    return x\n")
    folder = str(tmp_path / "index")
    first = Index.build(spark, folder, {"r": str(tree)})
    claims = rows("assertion_id long, subject_qualname string, subject_symbol_id long, status string", (1, "m.free", None, "active"), (2, "m.gone", 5, "active"))
    first.store_claims(assertions=claims)
    first.check_identity()
    with pytest.raises(RepoMismatch):
        Index(spark, folder, {"r": "/elsewhere"})
    # a build that fails leaves the version before
    with pytest.raises(Exception):
        Index.build(spark, folder, {"r": str(tmp_path / "missing")})
    assert VersionedFolder(spark, folder).current() == first.identity
    (tree / "n.py").write_text("import m\n\n\ndef top():\n    m.free(1)\n")
    second = Index.build(spark, folder, {"r": str(tree)})
    assert second.identity != first.identity and first.table("symbols").count() < second.table("symbols").count()
    with pytest.raises(IndexReplaced):
        first.check_identity()
    ids = {r.qualname: r.symbol_id for r in second.table("symbols").collect()}
    assert {r.assertion_id: r.subject_symbol_id for r in second.table("assertions").collect()} == {1: ids["m.free"], 2: None}
    with pytest.raises(ValueError):
        second.store_claims(other=claims)
    path = second.reading_path({7: "help"}).collect()
    assert [r.stop for r in sorted(path, key=lambda r: r.stop)] == list(range(1, len(path) + 1)) and ids["m.help_me"] in {r.symbol_id for r in path}
    found = second.get_symbol("r", "m.help_me", most=0)
    assert found["callers"] == [] and found["more"] == ["callers"] and second.get_symbol("r", "m.help_me")["callers"] == ["m.free"]
