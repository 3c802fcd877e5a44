"""The scan sink when batches are repeated and steps fail, and the folder source with broken files, pushed filters and offsets."""

from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from exposark.plans import sink, store
from exposark.sources import folder


@pytest.fixture
def uploads(tmp_path):
    top = tmp_path / "uploads"
    top.mkdir()
    (top / "a.txt").write_text("mail a.b@example.org and card 4532015112830366")
    (top / "b.txt").write_bytes(b"\xff\xfe broken")
    (top / "c.txt").write_text("")
    (top / "d.xyz").write_text("password: hunter22")
    (top / "e.csv").write_text("x" * 5000)
    os.utime(top / "a.txt", (1000, 1000))
    for name in "bcde":
        path = next(top.glob(f"{name}.*"))
        os.utime(path, (2000, 2000))
    return top


def read(spark, path, **options):
    folder.register(spark)
    return spark.read.format("scan_folder").options(**options).load(str(path))


def test_every_file_has_a_row(spark, uploads):
    rows = {r["name"]: r for r in read(spark, uploads).collect()}
    assert sorted(rows) == ["a.txt", "b.txt", "c.txt", "d.xyz", "e.csv"]
    assert rows["a.txt"]["error"] is None and rows["a.txt"]["text"].startswith("mail")
    assert (rows["b.txt"]["text"], rows["b.txt"]["error"]) == (None, "no UTF-8 text: byte 0") and rows["c.txt"]["error"] == "empty file"
    assert {r["name"]: r["error"] for r in read(spark, uploads, largest="100").collect()}["e.csv"] == "file of 5000 bytes, 100 at most"


def test_filters_are_decided_on_the_list(spark, uploads):
    wanted = read(spark, uploads).where("extension = '.txt' AND length > 3 AND text LIKE '%card%'")
    assert [r["name"] for r in wanted.collect()] == ["a.txt"]
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    left = plan.split("Filter")[1].split("\n")[0]
    assert "extension" not in left and "length" not in left and "card" in left
    reader = folder.FolderReader(folder._Options({"path": str(uploads)}))
    left = list(reader.pushFilters([folder.EqualTo(("extension",), ".txt"), folder.LessThan(("length",), 9), folder.EqualTo(("text",), "x"), folder.EqualTo(("a", "b"), 1)]))
    assert len(left) == 2 and sorted(f[1] for p in reader.partitions() for f in p.files) == ["c.txt"]


def test_partitions_follow_sizes():
    files = [(f"f{i}", "", "", size, 0) for i, size in enumerate([10, 200 << 20, 31 << 20, 31 << 20, 1, 1])]
    parts = folder.dealt(files, 64 << 20)
    assert [[f[0] for f in p.files] for p in parts] == [["f1"], ["f2", "f3"], ["f0", "f4", "f5"]]


def test_stream_reads_each_file_once_and_waits_for_settled_ones(spark, uploads, tmp_path):
    folder.register(spark)

    def run():
        stream = spark.readStream.format("scan_folder").option("settle_ms", "60000").load(str(uploads))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r["name"] for r in spark.read.schema(folder.SCHEMA).parquet(str(tmp_path / "out")).collect())

    (uploads / "new.txt").write_text("still being written")
    assert run() == ["a.txt", "b.txt", "c.txt", "d.xyz", "e.csv"]
    settled = time.time() - 120
    os.utime(uploads / "new.txt", (settled, settled))
    assert run() == ["a.txt", "b.txt", "c.txt", "d.xyz", "e.csv", "new.txt"]


def test_a_batch_written_again_replaces_itself(spark, uploads, tmp_path):
    tables = sink.ScanSink(str(tmp_path / "tables"))
    scans = sink.file_scans(read(spark, uploads), reader="agent")
    tables.write(scans, 0)
    once = sorted(map(repr, tables.scans(spark).drop("at").collect())), sorted(map(repr, tables.findings(spark).collect()))
    tables.write(scans, 0)
    assert (sorted(map(repr, tables.scans(spark).drop("at").collect())), sorted(map(repr, tables.findings(spark).collect()))) == once
    assert tables.scans(spark).count() == 5 and {r["type"] for r in tables.findings(spark).collect()} == {"email", "credit_card"}
    assert {r["filename"]: r["error"] for r in sink.errors(tables.scans(spark)).collect()} == {"b.txt": "no UTF-8 text: byte 0", "c.txt": "empty file", "d.xyz": "unsupported format", "e.csv": "unsupported format"}


def test_a_batch_that_failed_between_the_tables_is_not_seen(spark, uploads, tmp_path, monkeypatch):
    tables = sink.ScanSink(str(tmp_path / "tables"))
    scans = sink.file_scans(read(spark, uploads))
    tables.write(scans, 0)
    before = tables.scans(spark).count(), tables.findings(spark).count()

    def fails(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "stored_findings", fails)
        with pytest.raises(RuntimeError):
            tables.write(scans.withColumn("scan_id", F.col("scan_id") + 1), 1)
    assert (tables.scans(spark).count(), tables.findings(spark).count()) == before
    tables.write(scans.withColumn("scan_id", F.col("scan_id") + 1), 1)
    assert (tables.scans(spark).count(), tables.findings(spark).count()) == (2 * before[0], 2 * before[1])
    assert [tuple(r) for r in tables.commits(spark).select("batch", "n_scans", "n_findings").orderBy("batch").collect()] == [(0, *before), (1, *before)]


def test_a_stream_goes_on_after_a_failure_without_duplicates(spark, uploads, tmp_path, monkeypatch):
    folder.register(spark)
    tables = sink.ScanSink(str(tmp_path / "tables"))

    def run():
        files = spark.readStream.format("scan_folder").option("settle_ms", "0").load(str(uploads))
        query = tables.start(sink.file_scans(files), str(tmp_path / "check"))
        query.awaitTermination(120)
        return query

    real = store.stored_findings
    calls = []

    def once(*args):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(*args)

    monkeypatch.setattr(store, "stored_findings", once)
    with pytest.raises(Exception, match="lost"):
        run()
    run()
    (uploads / "f.txt").write_text("card 4111111111111111")
    run()
    assert sorted(r["filename"] for r in tables.scans(spark).collect()) == ["a.txt", "b.txt", "c.txt", "d.xyz", "e.csv", "f.txt"]
    assert tables.findings(spark).where("type = 'credit_card'").count() == 2
