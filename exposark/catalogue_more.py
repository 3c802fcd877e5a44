"""Further queries: types and final scores of files, stored tables, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposark.catalogue import CREDIT_SQL, FINDINGS_SQL, SCANS_SQL, SCORES_SQL, found, in_rows
from exposark.doctype_sql import ACADEMIC_SQL, TYPE_SQL
from exposark.functions import tables
from exposark.operators import advice, classify, detect, doctype, keywords, score
from exposark.plans import history, reports, sessions, store
from exposark.registry import ORACLES, query
from exposark.sources import corpus as C

# --- types of documents, final scores --------------------------------------------------------------------------------------


@query(f"WITH {FINDINGS_SQL}, {TYPE_SQL} SELECT doc_id, doc_type, boost, confidence FROM typed")
def doc_type_inference(spark, sf_dir):
    rows = C.corpus(spark, sf_dir).select("doc_id", "text", keywords.found(F.col("text")).alias("found"))
    calm = classify.is_academic(F.col("found"), classify.keyword_class_of(F.col("found"))["doc_type"])
    rows = rows.withColumn("types", doctype.types_of(detect.document_findings(F.col("text"), calm)))
    return doctype.with_inferred(rows, found=F.col("found")).select("doc_id", "inferred.*")


@query(ACADEMIC_SQL)
def doc_academic(spark, sf_dir):
    rows = C.corpus(spark, sf_dir).select("doc_id", keywords.found(F.col("text")).alias("found"))
    return rows.select("doc_id", classify.is_academic(F.col("found"), F.lit("generic")).alias("academic"))


@query(f"""WITH keyword AS ({ORACLES["doc_keyword_class"]}), {SCORES_SQL}, {TYPE_SQL},
own(doc_type, boost) AS (VALUES ('passport', 15), ('bank_statement', 12), ('payslip', 15), ('medical', 15), ('resume', 10), ('aadhaar_card', 5), ('pan_card_doc', 5), ('marks_card', 5), ('invoice', 5), ('screenshot_credential', 25)),
resolved AS (SELECT t.doc_id, t.types, k.confidence >= 0.6 AND CASE k.doc_type WHEN 'aadhaar_card' THEN list_contains(types, 'aadhaar') WHEN 'pan_card_doc' THEN list_contains(types, 'pan_card') WHEN 'screenshot_credential' THEN list_has_any(types, ['password', 'otp'])
    WHEN 'passport' THEN list_has_any(types, ['id_number', 'dob', 'person_name']) WHEN 'marks_card' THEN list_has_any(types, ['id_number', 'dob', 'person_name']) ELSE true END AS by_keyword,
    k.doc_type AS keyword_type, t.doc_type AS inferred_type, t.boost AS inferred_boost FROM typed t JOIN keyword k USING (doc_id)),
finals AS (SELECT r.doc_id, CASE WHEN by_keyword THEN keyword_type ELSE inferred_type END AS doc_type, CASE WHEN by_keyword THEN coalesce(o.boost, 0) ELSE inferred_boost END AS boost, types, score AS base, hard
  FROM resolved r JOIN scores USING (doc_id) LEFT JOIN own o ON o.doc_type = r.keyword_type),
damped AS (SELECT *, round(CASE WHEN doc_type IN ('project_synopsis', 'ml_notebook') AND NOT hard THEN least(least(base + boost, 100.0) * 0.1, 12.0) ELSE least(base + boost, 100.0) END, 2) AS score FROM finals)
SELECT doc_id, doc_type, score, CASE WHEN score >= 80 AND hard THEN 'CRITICAL' WHEN score >= 35 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' WHEN score > 0 OR len(types) > 0 THEN 'LOW' ELSE 'SAFE' END AS risk FROM damped""")
def doc_final_score(spark, sf_dir):
    """The upload scan as far as text goes: type, score with its boost, and level of each document."""
    return doctype.with_final(C.corpus(spark, sf_dir).select("doc_id", "text")).select("doc_id", "doc_type", "score", "risk")


@query("SELECT doc_id, regexp_matches(lower(coalesce(text, '')), 'password|login|account|bank|otp|email|phone|upi|card|username|security') AS mentions FROM documents")
def doc_sensitive_words(spark, sf_dir):
    return C.corpus(spark, sf_dir).select("doc_id", detect.mentions_secrets(F.col("text")).alias("mentions"))


@query("SELECT doc_id, md5(substr(text, 1, 2000)) AS batch, md5(substr(text, 1, 5000)) AS social, md5(substr(text, 1, 10000)) AS url, md5(text) AS file FROM documents")
def doc_stored_text(spark, sf_dir):
    kept = lambda source: F.md5(store.kept_text(F.col("text"), F.lit(source))).alias(source)
    return C.corpus(spark, sf_dir).select("doc_id", kept("batch"), kept("social"), kept("url"), kept("file"))


@query(f"""WITH {FINDINGS_SQL}, kinds AS (SELECT doc_id, list_sort(list(DISTINCT type)) AS types FROM findings GROUP BY doc_id),
named AS (SELECT doc_id, types, list_transform(types[1:3], lambda t: CASE t WHEN 'email' THEN 'Email Address' WHEN 'credit_card' THEN 'Credit Card' WHEN 'password' THEN 'Password' WHEN 'aadhaar' THEN 'Aadhaar Number' ELSE 'PAN Card' END) AS names FROM kinds)
SELECT doc_id, array_to_string(types, ',') AS types, array_to_string(names, ', ') || CASE WHEN len(types) > 3 THEN ' +' || (len(types) - 3) || ' more' ELSE '' END AS label FROM named""")
def doc_friendly_types(spark, sf_dir):
    rows = in_rows(spark, sf_dir).select("doc_id", F.array_sort(doctype.types_of(F.col("findings"))).alias("types")).where(F.size("types") > 0)
    return rows.select("doc_id", F.array_join("types", ",").alias("types"), reports.friendly_types(F.col("types")).alias("label"))


@query(f"""WITH {FINDINGS_SQL}, attacks(type, attack, severity) AS (VALUES ('email', 'Phishing / Credential Stuffing', 'HIGH'), ('phone', 'SIM Swap / Vishing', 'HIGH'), ('password', 'Direct Account Takeover', 'CRITICAL'), ('aadhaar', 'Identity Fraud / KYC Bypass', 'CRITICAL'),
  ('pan_card', 'Tax / Financial Fraud', 'CRITICAL'), ('credit_card', 'Financial Theft', 'CRITICAL')) SELECT DISTINCT doc_id, type, attack, severity FROM findings JOIN attacks USING (type)""")
def doc_type_attacks(spark, sf_dir):
    rows = in_rows(spark, sf_dir).select("doc_id", F.explode_outer(advice.attacks(doctype.types_of(F.col("findings")))).alias("a")).where(F.col("a").isNotNull())
    return rows.select("doc_id", "a.*")


@query(f"""WITH {FINDINGS_SQL}, placed AS (SELECT type, value, row_number() OVER (PARTITION BY type ORDER BY value) AS k FROM findings)
SELECT type, count(*) AS n, string_agg(value, ' | ' ORDER BY k) FILTER (WHERE k <= 10) AS first_values, greatest(count(*) - 10, 0) AS n_more FROM placed GROUP BY type""")
def findings_summary(spark, sf_dir):
    return reports.sensitive_summary(found(spark, sf_dir))


@query(f"""WITH {FINDINGS_SQL}, counts AS (SELECT doc_id // 10 AS job_id, type, count(*) AS n, CASE type WHEN 'aadhaar' THEN 50 WHEN 'pan_card' THEN 45 WHEN 'email' THEN 18 ELSE 40 END::DOUBLE AS w FROM findings GROUP BY 1, 2),
sums AS (SELECT job_id, sum(CASE WHEN n = 1 THEN w WHEN n = 2 THEN w * 1.7 ELSE w * 1.7 + w * 0.5 * (n - 2) END) AS points, bool_or(type <> 'email') AS hard FROM counts GROUP BY 1),
scored AS (SELECT job_id, hard, CASE WHEN hard THEN greatest(least(round(points, 1), 100.0), 40.0) ELSE least(round(points, 1), 100.0) END AS combined_score FROM sums)
SELECT job_id, combined_score, CASE WHEN combined_score >= 80 AND hard THEN 'CRITICAL' WHEN combined_score >= 35 THEN 'HIGH' WHEN combined_score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM scored""")
def batch_combined_score(spark, sf_dir):
    """Findings of ten documents at a time, scored as those of one."""
    pooled = found(spark, sf_dir).select(F.floor(F.col("doc_id") / 10).alias("job_id"), "type")
    return reports.pooled_scores(pooled, "job_id")


@query(f"""WITH {SCORES_SQL}, owners AS (SELECT source, max(score) AS base FROM scores JOIN documents USING (doc_id) GROUP BY source), present AS (SELECT DISTINCT source, type FROM findings JOIN documents USING (doc_id)),
kinds AS (SELECT source, list(type) AS types FROM present GROUP BY source),
rules(severity, needed) AS (VALUES ('HIGH', ['email']), ('CRITICAL', ['email', 'password']), ('CRITICAL', ['aadhaar']), ('CRITICAL', ['pan_card']), ('CRITICAL', ['credit_card']), ('CRITICAL', ['aadhaar', 'pan_card'])),
points AS (SELECT source, sum(CASE severity WHEN 'CRITICAL' THEN 15 ELSE 8 END) AS p, count(*) AS n FROM kinds, rules WHERE list_has_all(types, needed) GROUP BY source)
SELECT source, coalesce(n, 0) AS n_scenarios, round(CASE WHEN p IS NULL THEN base * 0.5 ELSE least(base + p, 100.0) END, 1) AS threat FROM owners LEFT JOIN points USING (source)""")
def owner_threat(spark, sf_dir):
    """Everything that a source's documents expose, taken together: their types in one row, and the highest score."""
    rows = C.corpus(spark, sf_dir).select("source", detect.document_findings(F.col("text")).alias("findings"))
    rows = score.with_row_score(rows, "findings").select("source", "score", doctype.types_of(F.col("findings")).alias("types"))
    kinds = F.array_sort(F.array_distinct(F.flatten(F.collect_set("types"))))  # sets of a dozen types are few
    owners = rows.groupBy("source").agg(F.max("score").alias("base"), kinds.alias("types")).withColumn("fired", advice.fired(F.col("types")))
    return owners.select("source", F.size("fired").cast("long").alias("n_scenarios"), advice.threat(F.col("base"), F.col("fired")).alias("threat"))


# --- reports and look-ups over the history ----------------------------------------------------------------------------------


@query(f"WITH {SCANS_SQL} SELECT count(*) AS n, round(avg(score), 1) AS avg_score, max(score) AS max_score, min(score) AS min_score, count(*) FILTER (WHERE risk = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE risk = 'HIGH') AS n_high FROM scans")
def hist_score_report(spark, sf_dir):
    return reports.score_history(C.scans(spark, sf_dir))


@query(f"""WITH {SCANS_SQL} SELECT scan_id // 10 AS job_id, count(*) AS n_files, sum(n_findings)::BIGINT AS n_findings, round(avg(score), 1) AS avg_score, count(*) FILTER (WHERE risk = 'CRITICAL') AS n_critical, count(*) FILTER (WHERE risk = 'HIGH') AS n_high,
  count(*) FILTER (WHERE risk = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE risk = 'LOW') AS n_low FROM scans GROUP BY 1""")
def batch_report(spark, sf_dir):
    return reports.batch_report(C.scans(spark, sf_dir).withColumn("job_id", F.floor(F.col("scan_id") / 10)))


@query(f"""WITH {SCANS_SQL} SELECT scan_id, CASE WHEN source IN ('file', 'url', 'social', 'cloud', 'screen', 'custom') THEN upper(source) ELSE source END AS label, CASE source WHEN 'file' THEN '#60a5fa' ELSE '#94a3b8' END AS colour,
  strftime(upload_date, '%d %b %Y, %H:%M') AS shown FROM scans""")
def hist_source_labels(spark, sf_dir):
    scans = C.scans(spark, sf_dir)
    return scans.select("scan_id", reports.source_label(F.col("source")).alias("label"), reports.source_colour(F.col("source")).alias("colour"), F.date_format("upload_date", "dd MMM yyyy, HH:mm").alias("shown"))


@query("SELECT event_id AS scan_id, event_type IN ('click', 'purchase') AS listed, event_type LIKE 'p_rchase%' AS alike, event_type = 'view' OR event_type IS NULL AS open FROM events")
def hist_source_tests(spark, sf_dir):
    kind = F.col("event_type")
    return C.table(spark, sf_dir, "events").select(F.col("event_id").alias("scan_id"), kind.isin("click", "purchase").alias("listed"), kind.like("p_rchase%").alias("alike"), ((kind == "view") | kind.isNull()).alias("open"))


WANTED = ((1, 1), (2, 7), (5, 7), (11, 3), (40, 12), (77, 5))


@query(f"WITH {SCANS_SQL} SELECT scan_id, owner_id, score FROM scans WHERE (scan_id, owner_id) IN ({', '.join(map(str, WANTED))}) OR scan_id IN (SELECT min(scan_id) FROM scans GROUP BY owner_id)")
def scan_lookup(spark, sf_dir):
    """Single scans by id, each for its own owner: those written above, and every owner's first."""
    scans = C.scans(spark, sf_dir)
    firsts = scans.groupBy("owner_id").agg(F.min("scan_id").alias("scan_id")).select("scan_id", "owner_id")
    wanted = spark.createDataFrame(list(WANTED), "scan_id long, owner_id long").unionByName(firsts)
    return store.looked_up(scans, wanted).select("scan_id", "owner_id", "score")


@query(f"WITH {SCANS_SQL}, {FINDINGS_SQL} SELECT doc_id, type, value FROM findings WHERE doc_id NOT IN (SELECT scan_id FROM scans WHERE score >= 35)")
def delete_cascade(spark, sf_dir):
    """Findings that are left when scans of a high score are deleted; a document's id is its scan's."""
    children = found(spark, sf_dir).withColumn("scan_id", F.col("doc_id"))
    return store.delete(C.scans(spark, sf_dir), children, F.col("score") >= 35)[1].select("doc_id", "type", "value")


@query(f"WITH {SCANS_SQL} SELECT scan_id FROM scans WHERE NOT coalesce(source LIKE 'cl_ck%' AND score >= 30, false)")
def purge_by_pattern(spark, sf_dir):
    scans = C.scans(spark, sf_dir)
    return store.purged(scans, scans.select("scan_id"), "cl_ck%", 30)[0].select("scan_id")


@query(f"""WITH {SCANS_SQL}, mine AS (SELECT DISTINCT owner_id AS session_id FROM scans), alerts AS (SELECT owner_id AS session_id, score, upload_date FROM scans WHERE score >= 90)
SELECT session_id, count(score) AS n_alerts, max(score) AS max_score, strftime(max(upload_date), '%Y-%m-%d %H:%M:%S') AS last_alert FROM mine LEFT JOIN alerts USING (session_id) GROUP BY session_id""")
def sessions_left_alerts(spark, sf_dir):
    frames = sessions.frames(C.scans(spark, sf_dir))
    out = store.sessions_with_alerts(frames.select("session_id").distinct(), frames.where(F.col("score") >= 90))
    return out.withColumn("last_alert", F.date_format("last_alert", "yyyy-MM-dd HH:mm:ss"))


@query(f"WITH {SCANS_SQL} SELECT owner_id, arg_min(scan_id, (upload_date, scan_id)) AS first_scan, arg_max(scan_id, (upload_date, scan_id)) AS latest_scan, arg_max(score, (upload_date, scan_id)) AS latest_score FROM scans GROUP BY owner_id")
def hist_first_latest(spark, sf_dir):
    return reports.first_and_latest(C.scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL}, ends AS (SELECT min(score) AS low, max(score) AS high FROM scans) SELECT scan_id, round(CASE WHEN high = low THEN 0.5 ELSE (score - low) / (high - low) END, 6) AS height FROM scans, ends")
def hist_normalised(spark, sf_dir):
    return reports.normalised(C.scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL}, numbered AS (SELECT owner_id, scan_id, row_number() OVER (PARTITION BY owner_id ORDER BY score DESC, scan_id) AS number FROM scans) SELECT * FROM numbered WHERE number <= 30")
def hist_numbered(spark, sf_dir):
    """The first rows of each owner's report, numbered."""
    w = Window.partitionBy("owner_id").orderBy(F.desc("score"), "scan_id")
    return C.scans(spark, sf_dir).select("owner_id", "scan_id", F.row_number().over(w).alias("number")).where(F.col("number") <= 30)


@query(f"WITH {SCANS_SQL} SELECT risk, count(*) AS n FROM scans WHERE risk NOT IN ('LOW', 'SAFE') GROUP BY risk")
def alerts_worth_telling(spark, sf_dir):
    return C.scans(spark, sf_dir).where(advice.worth_an_alert(F.col("risk"))).groupBy("risk").agg(F.count("*").alias("n"))


@query(f"""WITH {SCANS_SQL} SELECT scan_id, to_json({{'scan_id': scan_id, 'owner_id': owner_id, 'score': score, 'risk': risk, 'findings': n_findings}})::VARCHAR AS body FROM scans""")
def scan_json(spark, sf_dir):
    return C.scans(spark, sf_dir).select("scan_id", F.to_json(F.struct("scan_id", "owner_id", "score", "risk", F.col("n_findings").alias("findings"))).alias("body"))


@query(CREDIT_SQL)
def advice_ranked(spark, sf_dir):
    """Every document's advice and the general one of its level, in order of severity."""
    rows = score.with_row_score(in_rows(spark, sf_dir), "findings")
    counts = F.transform(doctype.types_of(F.col("findings")), lambda t: F.struct(t.alias("type"), F.size(F.filter("findings", lambda f: f["type"] == t)).alias("n")))
    own = F.filter(F.transform(counts, lambda c: F.struct(advice.severity(c["type"], c["n"]).alias("severity"), c["type"].alias("type"))), lambda a: a["severity"].isNotNull())
    every = F.concat(own, F.array(F.struct(advice.general_advice(F.col("risk")).alias("severity"), F.lit("general").alias("type"))))
    order = lambda s: F.when(s == "HIGH", 0).when(s == "MEDIUM", 1).otherwise(2)
    ranked = F.array_sort(F.transform(every, lambda a: F.struct(order(a["severity"]).alias("k"), a["type"].alias("type"), a["severity"].alias("severity"))))
    out = rows.select("doc_id", F.posexplode(ranked).alias("place", "a"))
    return out.select("doc_id", (F.col("place") + 1).cast("long").alias("place"), "a.type", "a.severity")
