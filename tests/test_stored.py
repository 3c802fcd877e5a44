"""Tables that are written, deletions, files as they are, and watched folders."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from exposark.operators import detect, score
from exposark.plans import sink, store
from exposark.sources import corpus as C
from exposark.streaming import monitor


def test_scans_and_findings_are_stored(spark, tmp_path):
    rows = [(1, "batch", "x" * 3000, [("email", "e" * 600)] * 70), (2, "file", "y" * 3000, []), (3, "url", None, [("otp", "1234")])]
    scans = spark.createDataFrame(rows, "scan_id long, source string, extracted_text string, findings array<struct<type:string,value:string>>")
    tables = sink.ScanSink(str(tmp_path))
    tables.write(scans, 0)
    tables.write(scans.where("scan_id = 3"), 1)
    kept = {r["scan_id"]: len(r["extracted_text"] or "") for r in tables.scans(spark).collect()}
    assert kept == {1: 2000, 2: 3000, 3: 0}
    found = tables.findings(spark)
    assert found.where("scan_id = 1").count() == 60 and found.where("scan_id = 3").count() == 2
    assert found.agg(F.max(F.length("value"))).first()[0] == 500


def test_deletion_takes_children_along(spark):
    scans = spark.createDataFrame([(1, "social_x", 80.0), (2, "social_x", 10.0), (3, "socialyx", 90.0), (4, None, 99.0), (5, "social_x", None)], "scan_id long, source string, score double")
    findings = spark.createDataFrame([(i, "email") for i in (1, 1, 2, 3, 4, 5)], "scan_id long, type string")
    left, children = store.purged(scans, findings, "social_%")
    assert sorted(r["scan_id"] for r in left.collect()) == [2, 4, 5]  # _ stands for any character
    assert sorted(r["scan_id"] for r in children.collect()) == [2, 4, 5]
    assert store.delete(scans.limit(0), findings.limit(0), F.lit(True))[0].collect() == []


def test_office_files_from_a_folder(spark, tmp_path):
    def packed(parts: dict) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(name, text)
        return out.getvalue()

    (tmp_path / "a.docx").write_bytes(packed({"docProps/core.xml": "<c><dc:creator>Ann Lee</dc:creator></c>", "word/settings.xml": "<w:trackRevisions/>"}))
    (tmp_path / "b.xlsx").write_bytes(packed({"docProps/app.xml": "<p><Company>Acme</Company><Sheets>3</Sheets></p>"}))
    (tmp_path / "c.docx").write_bytes(b"no zip at all")
    fields = C.office_fields(C.office_parts(C.files(spark, str(tmp_path))))
    got = {(r["path"].rsplit("/", 1)[1], r["field"], r["value"]) for r in fields.collect()}
    assert got == {("a.docx", "author", "Ann Lee"), ("a.docx", "tracked_changes", "ACTIVE (Privacy Risk: Edit history is visible)"), ("b.xlsx", "company", "Acme"), ("b.xlsx", "sheet_count", "3")}
    scores = {r["path"].rsplit("/", 1)[1]: (r["score"], r["risk"]) for r in score.metadata_scores(fields, "path").collect()}
    assert scores == {"a.docx": (35.0, "MEDIUM"), "b.xlsx": (10.0, "LOW")}


def test_watched_folder_goes_on_where_it_was(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    watch = monitor.Watch(spark, str(folder), str(tmp_path / "log"), str(tmp_path / "checkpoint"))
    (folder / "a.txt").write_text("card 4532015112830366 and 4111111111111111")
    (folder / "b.xyz").write_text("password: hunter22")
    watch.start().awaitTermination(120)
    (folder / "c.txt").write_text("nothing here")
    watch.start().awaitTermination(120)
    watch.stop()
    log = {r["name"]: (r["score"], r["risk"], r["types"], r["alert"]) for r in monitor.event_log(spark, str(tmp_path / "log")).collect()}
    assert log == {"a.txt": (68.0, "HIGH", ["credit_card"], True), "c.txt": (0.0, "LOW", [], False)}
    counts = monitor.event_counts(spark, str(tmp_path / "log")).first()
    assert (counts["total_scanned"], counts["total_alerts"]) == (2, 1)


def test_findings_are_found_once_a_row(spark):
    """No shuffle in what is asked of a document, and the patterns are not run twice."""
    docs = spark.createDataFrame([(1, "a.b@example.org")], "doc_id long, text string")
    rows = detect.exploded(docs, detect.document_findings(F.col("text")))
    plan = score.with_row_score(docs.select("doc_id", detect.document_findings(F.col("text")).alias("findings")), "findings")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert [tuple(r) for r in rows.collect()] == [(1, "email", "a.b@example.org")]


def test_stored_by_time_reads_little(spark, tmp_path):
    rows = spark.range(200_000).select(F.col("id").alias("scan_id"), (F.xxhash64("id") % 500).alias("owner_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") % (20 * 86400)).alias("upload_date"), F.rand(1).alias("score"))
    path = str(tmp_path / "scans")
    store.write_by_time(rows, path, rows_per_group=1000)
    plain = rows.withColumn("day", F.to_date("upload_date"))

    def scanned(frame):
        frame.collect()
        plan = frame._jdf.queryExecution().executedPlan()
        plan = plan.executedPlan() if hasattr(plan, "executedPlan") and "Adaptive" in plan.nodeName() else plan
        while not plan.nodeName().startswith("Scan parquet"):
            plan = plan.children().head()
        return plan.metrics().apply("numOutputRows").value(), frame._jdf.queryExecution().executedPlan().toString()

    mine = store.of_owner(spark, path, 7, "2024-01-03", "2024-01-04")
    assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, plain.where("owner_id = 7 AND day BETWEEN '2024-01-03' AND '2024-01-04'").select(mine.columns).collect()))
    read, plan = scanned(mine)
    assert "PartitionFilters: [isnotnull(day" in plan and "EqualTo(owner_id,7)" in plan and read < 8_000
    (owner,) = rows.where("scan_id = 1234").select("owner_id").first()
    one = store.by_ids(spark, path, [(1234, owner), (99, -1)])
    assert [r["scan_id"] for r in one.collect()] == [1234]
    read, plan = scanned(one)
    assert "In(scan_id, [1234,99])" in plan and read < 20_000
