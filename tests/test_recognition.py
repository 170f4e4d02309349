"""Recognition by pages against reading each document in one call."""

import os
import random

import pytest
from pyspark.sql import functions as F

from docrecon.settings import Settings
from docrecon.sources import runs
from docrecon.sources.recognition import Layers, recognised
from docrecon.sources.text import with_text
from docrecon.streaming import ingest

KEYS = "path string, page_index int, size long"


def readers():
    # Functions of a function travel to the workers by value.
    def native(content):
        if content == b"broken":
            raise ValueError("no file of  mine")
        return [p if p != "null" else None for p in content.decode().split("|")] if content else []

    def cheap(content, page):
        text = content.decode().split("|")[page]
        if "fail" in text:
            raise RuntimeError(f"page {page}")
        return f"  cheap {text} ", 40.0 if "hard" in text else 80.0

    def careful(content, page):
        text = content.decode().split("|")[page]
        return f"careful {text}", 20.0 if "harder" in text else 50.0 if "hard1" in text else 90.0

    return native, cheap, careful


native, cheap, careful = readers()


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    root, rng, rows = tmp_path_factory.mktemp("scans"), random.Random(5), []
    kinds = ["a native page of more than twenty characters", "thin", "", "null", "hard", "hard1", "harder", "  \n thin ", "fail", "hard fail"]
    for i in range(60):
        path = root / f"{i}.pdf"
        pages = rng.choices(kinds[: 8 if i % 3 else 10], k=rng.randint(1, 20))
        path.write_bytes([b"broken", b""][i] if i < 2 else "|".join(pages).encode())
        rows += [(str(path), None, i), (str(path), rng.randint(0, 20), i)]
    rows += [(str(root / "none.pdf"), None, 0), (str(root / "none.pdf"), 3, 0), rows[10], rows[10], (None, None, 7)]
    return spark.createDataFrame(rows, KEYS).repartition(3)


def rows_of(df):
    return sorted(tuple(map(str, r)) for r in df.select("path", "page_index", "size", "text", "source", "error", "text_notes").collect())


@pytest.mark.parametrize("layers", [Layers(native, cheap, careful), Layers(native, cheap), Layers(native)])
def test_equals_one_call_a_document(files, layers):
    assert rows_of(recognised(files, layers)) == rows_of(with_text(files, layers.provider(Settings())))


def test_empty_and_clashing_columns(spark, files):
    layers = Layers(native, cheap, careful)
    assert recognised(files.limit(0), layers).count() == 0
    more = files.withColumns({"page": F.lit("x"), "used": F.lit(1), "note": F.lit("n"), "text": F.lit("old"), "content": F.lit(None).cast("binary")})
    got = recognised(more, layers)
    assert rows_of(got) == rows_of(recognised(files, layers)) and {"page", "used", "note"} <= set(got.columns) and "content" not in got.columns


def test_one_long_file_uses_all_tasks(spark, tmp_path):
    path, calls = tmp_path / "long.pdf", tmp_path / "calls"
    calls.mkdir()
    path.write_text("|".join("hard" if i % 10 == 0 else "thin" for i in range(500)))

    def seen(name, run):
        def call(content, page):
            from pyspark import TaskContext

            with open(calls / f"{name}-{page}-{TaskContext.get().partitionId()}", "w"):
                return run(content, page)

        return call

    files = spark.createDataFrame([(str(path), None, 1)], KEYS)
    layers = Layers(native, seen("cheap", cheap), seen("careful", careful))
    got = recognised(files, layers).first()
    assert got["text"].count("cheap") == 450 and got["text"].count("careful") == 50
    made = [name.split("-") for name in os.listdir(calls)]
    parts = lambda kind: {p for k, _, p in made if k == kind}
    assert len(parts("cheap")) == len(parts("careful")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert sorted(int(n) for k, n, _ in made if k == "careful") == list(range(0, 500, 10))


def test_stream_of_pages(spark, files, tmp_path):
    layers = Layers(native, cheap, careful)
    files.write.parquet(str(tmp_path / "in"))
    stream = recognised(spark.readStream.schema(files.schema).parquet(str(tmp_path / "in")), layers)
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination(120)
    assert rows_of(spark.read.parquet(str(tmp_path / "out"))) == rows_of(recognised(files, layers))


def test_a_scan_reads_by_pages_and_keeps_events(spark, tmp_path):
    folder = tmp_path / "tree/FY 22-23/Payments/Kotak/Sep-2022/24-Sep-2022/Apex"
    folder.mkdir(parents=True)
    long = "a native page of more than twenty characters"
    for name, content in (("three.pdf", f"{long}|thin|hard"), ("bad.pdf", "broken"), ("fails.pdf", f"{long}|fail")):
        (folder / name).write_text(content)
    root, run = str(tmp_path / "tree"), runs.new_run(str(tmp_path / "out"), str(tmp_path / "tree"))
    count = (lambda: lambda content: len(content.decode().split("|")))()
    assert ingest.scan(spark, run, root, Layers(native, cheap, careful), Settings(root=root), counter=count)
    got = {(r["filename"], r["page_index"]): r for r in ingest.ledger(spark, run).collect()}
    assert {k: (r["text"], r["source"]) for k, r in got.items()} == {
        ("three.pdf", 0): (long, "text"), ("three.pdf", 1): ("cheap thin", "ocr"), ("three.pdf", 2): ("careful hard", "ocr"),
        ("bad.pdf", None): ("", "none"), ("fails.pdf", 0): (long, "text"), ("fails.pdf", 1): ("", "none"),
    }
    events = {k: [(e["stage"], e["action"], e["severity"]) for e in r["events"]] for k, r in got.items()}
    assert events["bad.pdf", None] == events["fails.pdf", 1] == [("extract", "error", "error"), ("classify", "classified", "info")]
    assert events["three.pdf", 2] == [("extract", "extracted", "info"), ("classify", "classified", "info")]
