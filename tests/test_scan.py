"""Scans: folders out of scope, resumption after stops and kills, leases, the gate and the progress of the stream."""

import io
import json
import os
import signal
import subprocess
import sys
import threading
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_runs import BODY, DAY, make_tree, reader

from docrecon import api
from docrecon.settings import Settings
from docrecon.sources import folders, lease, pages, runs
from docrecon.streaming import control, ingest


def two_years(tmp_path):
    """A tree with files of two years and two banks, hidden names, other files and a link to nowhere."""
    root, folder = make_tree(tmp_path, 2)
    for name in ("_draft.PDF", ".hid.pdf", "notes.txt"):
        (folder / name).write_text("of 22-23")
    (folder / "lost.pdf").symlink_to(tmp_path / "nowhere")
    for other in ("FY 21-22/Payments/Kotak/Sep-2021/24-Sep-2021/Apex", "deep/fy21-22", "FY 22-23/Payments/Axis/Sep-2022/24-Sep-2022/Apex"):
        (tmp_path / "tree" / other).mkdir(parents=True)
        (tmp_path / "tree" / other / "old.pdf").write_text("of another year or bank")
    return root, folder


def noting(folder):
    """A provider and a page counter that leave a file for each content they see."""

    def note(content):
        Path(folder, f"{hash(bytes(content))}-{os.getpid()}").write_bytes(content)

    def count(content):
        note(content)
        return pages.count_pages(content)

    return (lambda content, page: (note(content), (content.decode(), "text"))[1]), count


def test_other_years_and_banks_are_never_opened(spark, tmp_path, monkeypatch):
    root, _ = two_years(tmp_path)
    run, seen = runs.new_run(str(tmp_path / "out"), root, "FY 22-23"), tmp_path / "seen"
    seen.mkdir()
    provider, counter = noting(seen)
    assert ingest.scan(spark, run, root, provider, Settings(root=root, fy_scope="fy 22-23"), counter=counter)
    assert {r["filename"] for r in api.load(spark, run).collect()} == {"Invoice_INV-0.pdf", "Invoice_INV-1.pdf", "_draft.PDF", ".hid.pdf"}
    opened = [p.read_text() for p in seen.iterdir()]
    assert opened and not any("another" in x for x in opened)
    monkeypatch.setattr(folders, "DUTY", 1)  # every folder is on a list
    state = folders.TreeReader({"root": root, "state": str(tmp_path / "state"), "base": root, "fy": "FY 22-23", "bank": "Kotak"})
    now = state.initialOffset()
    while (end := state.latestOffset()) != now:
        assert all(True for part in state.partitions(now, end) for _ in state.read(part))
        now = end
    listed = "".join(p.read_text() for p in (tmp_path / "state").rglob("round-*/*.json"))
    assert "22-23" in listed and "21-22" not in listed and "Axis" not in listed
    assert ingest.scan(spark, runs.new_run(str(tmp_path / "out"), str(tmp_path / "none")), str(tmp_path / "none"), provider)


def test_folders_in_scope():
    held = lambda path, fy=None, bank="Kotak": folders.may_hold(path.split("/"), fy, bank)
    assert held("a/Payments") and held("Payments/kotak/x") and held("Kotak/x") and held("x/FY 21-22")
    assert not held("Payments/Axis") and not held("PAYMENTS/x/Payments/Kotak") and held("payments/Axis", bank=None)
    assert not held("x/FY 21-22", "FY 22-23") and held("x/fy22 - 23", "FY 22-23") and held("x/years", "FY 22-23")
    assert folders.below("/r/a/b", "/r") == ["a", "b"] and folders.below("/s/a", "/r") == ["s", "a"]


def test_the_source_resumes_by_its_offset(tmp_path, monkeypatch):
    monkeypatch.setattr(folders, "DUTY", 20)
    root, _ = make_tree(tmp_path, 1)
    for k in range(150):
        (tmp_path / "tree/x" / f"{k:03d}").mkdir(parents=True)
        (tmp_path / "tree/x" / f"{k:03d}" / "a.pdf").write_text("x")
    options = {"root": root, "state": str(tmp_path / "state"), "lists": "2"}
    one = folders.TreeReader(options)
    now, files, steps = one.initialOffset(), [], []
    while (end := folders.TreeReader(options).latestOffset()) != now:  # a new reader each time, as after a crash
        again = [[row for part in folders.TreeReader(options).partitions(now, end) for row in one.read(part)] for _ in range(2)]
        assert again[0] == again[1]
        files += again[0]
        steps.append(end)
        now = end
    assert len(files) == len(set(files)) == 151 and folders.exhausted(options["state"])
    assert steps[:3] == [{"round": 0, "at": 1}, {"round": 1, "at": 2}, {"round": 1, "at": 4}]
    gate = control.Gate(str(tmp_path / "gate"))
    gate.pause()
    fresh = folders.TreeReader({**options, "state": str(tmp_path / "state2"), "gate": gate.path})
    assert fresh.initialOffset() == fresh.latestOffset()


def test_gate(tmp_path):
    gate, other = control.Gate(str(tmp_path / "gate")), control.Gate(str(tmp_path / "gate"))
    assert gate.state == "open" and gate.shut_seconds() == 0
    gate.pause()
    waited = []
    thread = threading.Thread(target=lambda: (other.wait(), waited.append(True)))
    thread.start()
    time.sleep(0.4)
    assert other.state == "paused" and not waited
    other.resume()
    thread.join(5)
    assert waited and 0.3 < gate.shut_seconds() < 5
    gate.stop()
    gate.resume()
    with pytest.raises(control.Stopped):
        other.wait()
    gate.reopen()
    assert other.state == "open"


def test_progress(tmp_path):
    seen, out = [], io.StringIO()
    progress = control.Progress(str(tmp_path / "s.json"), None, (seen.append, control.terminal(out)))
    progress.publish()
    assert seen[-1]["pct"] == 0.0 and seen[-1]["eta_s"] is None and seen[-1]["discovering"]
    progress.begin("q", 10, 4)
    for _ in range(2):  # the second report of a batch takes the place of the first
        progress.batch(0, {"finished": {"docs": 3, "pdfs": 3}, "stage_parse": {"docs": 3, "errors": 1}}, 10.0)
    progress.noted(0, [{"doc_id": "a"}])
    progress.batch(1, {}, 5.0)
    progress.publish()
    now = json.loads((tmp_path / "s.json").read_text())
    assert now["pct"] == 70.0 and now["rate"] == 0.3 and now["eta_s"] == 10 and now["recent"] == [{"doc_id": "a"}] and now["counts"] == {"pdfs": 3}
    assert now["stages"] == [{"stage": "parse", "ms_per_doc": 10000 / 3, "docs": 3, "errors": 1}]
    progress.publish("done")
    assert seen[-1]["state"] == "done" and seen[-1]["pct"] == 100.0 and "done" in out.getvalue()


def test_a_stopped_scan_is_not_complete_and_metrics_are_the_streams(spark, tmp_path):
    root, folder = make_tree(tmp_path)
    (folder / "bad.pdf").write_bytes(b"\xff")
    run, settings = runs.new_run(str(tmp_path / "out"), root), Settings(root=root)
    gate = control.Gate(run + "/gate")
    gate.stop()
    assert not ingest.scan(spark, run, root, reader(), settings, gate=gate)
    assert not runs.read_meta(run)["complete"] and runs.read_meta(run)["lease"] is None
    gate.reopen()
    progress = control.Progress(run + "/status.json", gate)
    assert ingest.scan(spark, run, root, reader(), settings, gate=gate, part=1, parts=1, progress=progress) and runs.read_meta(run)["complete"]
    last, docs = json.loads(Path(run, "status.json").read_text()), api.load(spark, run)
    assert last["state"] == "done" and last["counts"] == {"pdfs": 4, "invoices": 3, "approvals": 0, "ocr": 0, "flagged": 1, "errors": 1} and len(last["recent"]) == 4
    assert [(s["stage"], s["docs"], s["errors"]) for s in last["stages"]] == [(n, 4, 1 if n == "extract" else 0) for n in ("extract", "classify", "parse", "reconcile", "validate")] or last["stages"][0]["errors"] == 1
    assert len(progress.batches) == 4 and docs.count() == 4 and docs.filter("error IS NOT NULL").count() == 1


def test_a_later_pass_opens_only_what_is_new(spark, tmp_path):
    root, folder = make_tree(tmp_path)
    run, settings, seen = runs.new_run(str(tmp_path / "out"), root), Settings(root=root), tmp_path / "seen"
    assert ingest.scan(spark, run, root, reader(), settings)
    (folder / "Invoice_INV-9.pdf").write_text(BODY.format(n=9))
    seen.mkdir()
    provider, counter = noting(seen)
    progress = control.Progress(run + "/status.json")
    assert ingest.scan(spark, run, root, provider, settings, counter=counter, progress=progress)
    assert {p.read_text() for p in seen.iterdir()} == {BODY.format(n=9)} and api.load(spark, run).count() == 4
    assert (progress.before, progress.total) == (3, 4) and ingest.ledger(spark, run).groupBy("path").count().filter("count > 1").isEmpty()


def test_a_vanished_file_is_a_document_with_an_error(spark, tmp_path):
    root, folder = make_tree(tmp_path)
    run, settings = runs.new_run(str(tmp_path / "out"), root), Settings(root=root)
    with lease.Lease(run, "scan"):
        assert ingest.discover(spark, run, 1, root, settings)
    runs.write_meta(run, **{"pass": 1})
    (folder / "Invoice_INV-1.pdf").unlink()
    assert ingest.scan(spark, run, root, reader(), settings)
    assert {r["filename"]: r["error"] is None for r in api.load(spark, run).collect()} == {f"Invoice_INV-{k}.pdf": k != 1 for k in range(3)}


def test_a_lost_lease_writes_nothing(spark, tmp_path):
    run = runs.new_run(str(tmp_path), "/tree")
    late, docs = lease.Lease(run, "scan", ttl=0.5), spark.range(3).withColumn("source_key", F.lit("a"))
    with late:
        late._over.set()  # its thread is dead
        with pytest.raises(lease.Busy), lease.Lease(run, "export"):
            pass
        time.sleep(0.7)
        with lease.Lease(run, "export") as now:
            assert now.number == late.number + 1
            for write in (lambda: runs.write_meta(run, late, complete=True), lambda: runs.save_table(spark, run, "snapshot", docs, late), lambda: ingest.append_ledger(run, 1, late)(docs, 0)):
                with pytest.raises(lease.LeaseLost):
                    write()
            with pytest.raises(lease.Busy):
                api.decide(spark, run, "approve", "a")
            runs.save_table(spark, run, "snapshot", docs, now)
    assert api.load(spark, run).count() == 3 and not runs.read_meta(run)["complete"] and runs.read_meta(run)["lease"] is None
    assert api.decide(spark, run, "approve", "a") == []


def test_a_renewed_lease_is_kept(tmp_path):
    run = runs.new_run(str(tmp_path), "/tree")
    with lease.Lease(run, "scan", ttl=0.4):
        time.sleep(1.2)
        with pytest.raises(lease.Busy), lease.Lease(run, "export"):
            pass


KILLED = """
import sys, time
from pyspark.sql import SparkSession
from docrecon.settings import Settings
from docrecon.streaming import ingest
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
run, root = sys.argv[1:]
slow = lambda content, page: (time.sleep(0.5), (content.decode(), "text"))[1]
ingest.scan(spark, run, root, slow, Settings(root=root), part=1, parts=1, ttl=3.0)
"""


def test_a_killed_scan_goes_on(spark, tmp_path):
    root, _ = make_tree(tmp_path, 6)
    run, settings = runs.new_run(str(tmp_path / "out"), root), Settings(root=root)
    env = os.environ | {"PYTHONPATH": str(Path(__file__).resolve().parent.parent)}
    dead = subprocess.Popen([sys.executable, "-c", KILLED, run, root], env=env, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL, start_new_session=True)
    until = time.monotonic() + 120
    while len(list(Path(run).glob("ledger/pass=1/batch=*"))) < 2 and dead.poll() is None and time.monotonic() < until:
        time.sleep(0.05)
    os.killpg(dead.pid, signal.SIGKILL)  # the group that was made for it alone
    dead.wait()
    done = ingest.ledger(spark, run).select("path").distinct().count()
    assert 2 <= done < 6 and runs.read_meta(run)["lease"]
    with pytest.raises(lease.Busy):
        ingest.scan(spark, run, root, reader(), settings)
    time.sleep(3.2)
    assert ingest.scan(spark, run, root, reader(), settings) and runs.read_meta(run)["pass"] == 1
    whole = runs.new_run(str(tmp_path / "out"), root)
    assert ingest.scan(spark, whole, root, reader(), settings)
    rows = lambda r: sorted(map(str, ingest.ledger(spark, r).drop("pass", "batch", "seq").collect()))
    assert rows(run) == rows(whole)
