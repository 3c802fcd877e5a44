"""All queries of the exposure engine by name, and the SQL that says the same to DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from exposark.functions import tables
from exposark.functions import text as T
from exposark.operators import advice, classify, detect, doctype, score
from exposark.plans import history, sessions, store
from exposark.registry import ORACLES, QUERIES, query
from exposark.pages_sql import PAGES_SQL, URL_FINDINGS_SQL, URL_SCORES_SQL
from exposark.sources import corpus as C
from exposark.sources import pages

# --- SQL that several queries share ---------------------------------------------------------------------------------------


def _case(key: str, table: dict, default: str) -> str:
    quoted = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {quoted(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _in(values: tuple) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


CREDENTIALS_SQL = rf"""list_distinct(list_filter(list_transform(regexp_extract_all(text, '{T.CREDENTIAL.replace("'", "''")}', 1), lambda v: regexp_replace(regexp_replace(v, '^["'']+', ''), '["''.,;:!?]+$', '')),
  lambda v: length(v) >= 4 AND len(list_filter(list_distinct(regexp_extract_all(text, '{T.EMAIL}')), lambda e: contains(e, v) OR contains(v, e))) = 0))"""
CARDS_SQL = rf"list_distinct(list_transform(regexp_extract_all(text, '{T.CARD}'), lambda v: regexp_replace(v, '[ -]+$', '')))"
FINDINGS_SQL = rf"""texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
findings AS (
  SELECT doc_id, 'email' AS type, unnest(list_distinct(regexp_extract_all(text, '{T.EMAIL}'))) AS value FROM texts
  UNION ALL SELECT doc_id, 'credit_card', unnest({CARDS_SQL}) FROM texts
  UNION ALL SELECT doc_id, 'password', unnest({CREDENTIALS_SQL}) FROM texts
  UNION ALL SELECT doc_id, 'aadhaar', unnest(list_distinct(regexp_extract_all(text, '{T.AADHAAR}'))) FROM texts
  UNION ALL SELECT doc_id, 'pan_card', unnest(list_distinct(regexp_extract_all(text, '{T.PAN}'))) FROM texts)"""
POINTS = "CASE WHEN n = 1 THEN w * 1.0 WHEN n = 2 THEN w * 1.7 ELSE w * 1.7 + w * 0.5 * (n - 2) END"
SCORES_SQL = f"""{FINDINGS_SQL},
counts AS (SELECT doc_id, type, count(*) AS n, {_case("type", tables.DOCUMENT_WEIGHTS, "10")}::DOUBLE AS w FROM findings GROUP BY doc_id, type),
sums AS (SELECT doc_id, sum(CASE WHEN type IN {_in(tables.SOFT_TYPES)} THEN {POINTS} ELSE 0 END) AS soft, sum(CASE WHEN type NOT IN {_in(tables.SOFT_TYPES)} THEN {POINTS} ELSE 0 END) AS firm,
  bool_or(type IN {_in(tables.HARD_TYPES)}) AS hard FROM counts GROUP BY doc_id),
raw AS (SELECT doc_id, hard, least(round(least(soft, 15.0) + firm, 1), 100.0) AS r FROM sums),
scores AS (SELECT d.doc_id, coalesce(CASE WHEN hard THEN greatest(r, 40.0) ELSE r END, 0.0)::DOUBLE AS score, coalesce(hard, false) AS hard FROM documents d LEFT JOIN raw USING (doc_id)),
leveled AS (SELECT doc_id, score, CASE WHEN score >= 80 AND hard THEN 'CRITICAL' WHEN score >= 35 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END AS risk FROM scores)"""
LEVEL_SQL = "CASE WHEN score >= 75 THEN 'CRITICAL' WHEN score >= 35 THEN 'HIGH' WHEN score >= 15 THEN 'MEDIUM' ELSE 'LOW' END"
SCANS_SQL = f"""scans AS (SELECT *, {LEVEL_SQL} AS risk FROM (SELECT event_id AS scan_id, user_id AS owner_id, ts AS upload_date, round(least(coalesce(value, 0.0), 100.0), 1) AS score, coalesce(event_type, 'file') AS source,
  coalesce(CAST(json_extract_string(props, '$.k') AS BIGINT), 0) AS n_findings FROM events))"""


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, type, value) of every type of the document profile. FINDINGS_SQL has five of the types, so it says the same where no others occur."""
    return detect.exploded(C.corpus(spark, sf_dir), detect.document_findings(F.col("text")))


def in_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and findings of each document, an array in the row, so that what is asked of a document needs no shuffle."""
    return C.corpus(spark, sf_dir).select("doc_id", detect.document_findings(F.col("text")).alias("findings"))


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.type_counts(found(spark, sf_dir))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.with_row_score(in_rows(spark, sf_dir), "findings").select("doc_id", "score", "risk")


# --- documents ------------------------------------------------------------------------------------------------------------


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, value FROM findings WHERE type = 'email'")
def doc_email_findings(spark, sf_dir):
    return detect.exploded(C.corpus(spark, sf_dir), detect.typed("email", detect.emails(F.col("text")))).select("doc_id", "value")


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, value FROM findings WHERE type = 'credit_card'")
def doc_card_findings(spark, sf_dir):
    return C.corpus(spark, sf_dir).select("doc_id", F.explode(detect.cards(F.col("text"))).alias("value"))


@query(rf"""WITH {FINDINGS_SQL}, cards AS (SELECT doc_id, value, string_split(reverse(regexp_replace(value, '[^0-9]', '', 'g')), '') AS ds FROM findings WHERE type = 'credit_card')
SELECT doc_id, value, list_sum(list_transform(range(1, len(ds) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(ds[i] AS INT) ELSE CAST(ds[i] AS INT) * 2 - CASE WHEN CAST(ds[i] AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0 AS luhn FROM cards""")
def doc_card_luhn(spark, sf_dir):
    return doc_card_findings(spark, sf_dir).select("doc_id", "value", T.luhn(F.col("value")).alias("luhn"))


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, value FROM findings WHERE type = 'password'")
def doc_credential_findings(spark, sf_dir):
    return C.corpus(spark, sf_dir).select("doc_id", F.explode(detect.credentials(F.col("text"))).alias("value"))


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, type, count(*) AS n FROM findings GROUP BY doc_id, type")
def doc_finding_counts(spark, sf_dir):
    return counted(spark, sf_dir)


@query(f"WITH {SCORES_SQL} SELECT doc_id, score, risk FROM leveled")
def doc_exposure_score(spark, sf_dir):
    return scored(spark, sf_dir)


@query(f"WITH {SCORES_SQL} SELECT risk, count(*) AS n FROM leveled GROUP BY risk")
def doc_risk_distribution(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("risk").agg(F.count("*").alias("n"))


@query(f"WITH {FINDINGS_SQL} SELECT doc_id, type, value FROM findings")
def doc_all_findings(spark, sf_dir):
    """Every type of the document profile."""
    return detect.exploded(C.corpus(spark, sf_dir), detect.document_findings(F.col("text")))


@query()
def doc_screen_findings(spark, sf_dir):
    return detect.exploded(C.corpus(spark, sf_dir), detect.screen_findings(F.col("text")))


@query(r"""WITH lines AS (SELECT doc_id, ls, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), (SELECT unnest(range(1, (SELECT max(len(string_split(coalesce(text, ''), chr(10)))) + 1 FROM documents))) AS i) WHERE i <= len(ls)),
good AS (SELECT doc_id, i, line FROM lines WHERE length(line) >= 3 AND length(regexp_replace(line, '[^\p{L}\p{N}]', '', 'g'))::DOUBLE / length(line) >= 0.35),
first AS (SELECT doc_id, min(i) AS i FROM good GROUP BY doc_id, lower(line)),
kept AS (SELECT g.doc_id, string_agg(line, chr(10) ORDER BY g.i) AS t FROM good g JOIN first f ON g.doc_id = f.doc_id AND g.i = f.i GROUP BY g.doc_id)
SELECT d.doc_id, md5(coalesce(t, '')) AS cleaned FROM documents d LEFT JOIN kept USING (doc_id)""")
def doc_clean_lines(spark, sf_dir):
    return C.corpus(spark, sf_dir).select("doc_id", F.md5(T.clean_lines(F.col("text"))).alias("cleaned"))


def _class_sql() -> str:
    parts = []
    for i, (name, least, words) in enumerate(tables.KEYWORD_RULES):
        hits = " + ".join(rf"CAST(regexp_matches(low, '\b{w.replace('-', '[-]')}\b') AS INT)" for w in words)
        parts.append(f"SELECT doc_id, '{name}' AS doc_type, {i} AS k, round(least(0.55 + least(({hits}), 3) / 3.0 * 0.35, 0.89), 4) AS confidence FROM low WHERE ({hits}) >= {least}")
    return f"""WITH low AS (SELECT doc_id, lower(coalesce(text, '')) AS low FROM documents), fits AS ({" UNION ALL ".join(parts)}),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence DESC, k) AS r FROM fits)
SELECT d.doc_id, coalesce(doc_type, 'generic') AS doc_type, coalesce(confidence, 0.0)::DOUBLE AS confidence FROM documents d LEFT JOIN (SELECT * FROM best WHERE r = 1) USING (doc_id)"""


@query(_class_sql())
def doc_keyword_class(spark, sf_dir):
    c = classify.keyword_class(F.col("text"))
    return C.corpus(spark, sf_dir).select("doc_id", c.alias("c")).select("doc_id", "c.doc_type", "c.confidence")


@query(rf"""WITH {FINDINGS_SQL}, chars AS (SELECT doc_id, value, length(value) AS len, unnest(string_split(value, '')) AS c FROM findings WHERE type = 'password'),
shares AS (SELECT doc_id, value, c, count(*)::DOUBLE / any_value(len) AS p FROM chars GROUP BY doc_id, value, c)
SELECT doc_id, value, round(-sum(p * log2(p)), 4) AS entropy FROM shares GROUP BY doc_id, value""")
def doc_password_entropy(spark, sf_dir):
    return doc_credential_findings(spark, sf_dir).select("doc_id", "value", F.round(T.entropy(F.col("value")), 4).alias("entropy"))


@query(rf"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '{T.EMAIL}', '[EMAIL]', 'g'), '{T.WHOLE_CARD}', '[CARD]', 'g'),
 '(?i)((?:password|passwd|pwd|secret|token|apikey|api_key)\s*[=:]\s*)\S+', '\1[SECRET]', 'g')) AS masked FROM documents""")
def doc_masked_text(spark, sf_dir):
    return C.corpus(spark, sf_dir).select("doc_id", F.md5(T.masked(F.col("text"))).alias("masked"))


@query(f"""WITH {FINDINGS_SQL} SELECT doc_id, count(*) FILTER (WHERE type = 'email') AS email, count(*) FILTER (WHERE type = 'credit_card') AS credit_card, count(*) FILTER (WHERE type = 'password') AS password FROM findings GROUP BY doc_id""")
def doc_type_pivot(spark, sf_dir):
    n = lambda t: F.size(F.filter("findings", lambda f: f["type"] == t)).cast("long").alias(t)
    rows = in_rows(spark, sf_dir).select("doc_id", n("email"), n("credit_card"), n("password"), F.size("findings").alias("n"))
    return rows.where("n > 0").drop("n")


@query(f"""WITH {SCORES_SQL}, ranked AS (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS rank FROM leveled JOIN documents USING (doc_id)) SELECT * FROM ranked WHERE rank <= 3""")
def doc_top_exposed_per_source(spark, sf_dir):
    w = Window.partitionBy("source").orderBy(F.desc("score"), "doc_id")
    rows = C.corpus(spark, sf_dir).select("source", "doc_id", detect.document_findings(F.col("text")).alias("findings"))
    rows = score.with_row_score(rows, "findings").select("source", "doc_id", "score")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3).select("source", "doc_id", "score", "rank")


@query(f"WITH {FINDINGS_SQL} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM findings)")
def doc_without_findings(spark, sf_dir):
    return in_rows(spark, sf_dir).where(F.size("findings") == 0).select("doc_id")


@query(f"WITH {FINDINGS_SQL} SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM findings)")
def doc_with_findings(spark, sf_dir):
    return in_rows(spark, sf_dir).where(F.size("findings") > 0).select("doc_id")


@query(f"WITH {FINDINGS_SQL} SELECT d.doc_id, count(f.value) AS n FROM documents d LEFT JOIN findings f USING (doc_id) GROUP BY d.doc_id")
def docs_left_finding_counts(spark, sf_dir):
    return in_rows(spark, sf_dir).select("doc_id", F.size("findings").cast("long").alias("n"))


def _with_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and how many addresses and cards a document has: one scan, and no other type is looked for."""
    text = F.col("text")
    return C.corpus(spark, sf_dir).select("doc_id", F.size(detect.emails(text)).alias("mails"), F.size(detect.cards(text)).alias("cards"))


@query(f"WITH {FINDINGS_SQL} SELECT DISTINCT value FROM (SELECT value FROM findings WHERE type = 'email' UNION ALL SELECT value FROM findings WHERE type = 'credit_card')")
def findings_union_distinct(spark, sf_dir):
    """Values of either type once; only these two are looked for, both from the row."""
    text = F.col("text")
    return C.corpus(spark, sf_dir).select(F.explode(F.array_union(detect.emails(text), detect.cards(text))).alias("value")).distinct()


@query(f"WITH {FINDINGS_SQL} SELECT doc_id FROM findings WHERE type = 'email' EXCEPT SELECT doc_id FROM findings WHERE type = 'credit_card'")
def findings_except(spark, sf_dir):
    return _with_types(spark, sf_dir).where("mails > 0 AND cards = 0").select("doc_id").distinct()


@query(f"WITH {FINDINGS_SQL} SELECT doc_id FROM findings WHERE type = 'email' INTERSECT SELECT doc_id FROM findings WHERE type = 'credit_card'")
def findings_intersect(spark, sf_dir):
    return _with_types(spark, sf_dir).where("mails > 0 AND cards > 0").select("doc_id").distinct()


# --- advice and scenarios -------------------------------------------------------------------------------------------------

COUNTS_SQL = f"{FINDINGS_SQL}, counts AS (SELECT doc_id, type, count(*) AS n FROM findings GROUP BY doc_id, type)"


@query(f"""WITH {COUNTS_SQL}, advice(type, up_to, low, high) AS (VALUES {", ".join(map(str, tables.ADVICE))})
SELECT doc_id, type, n, CASE WHEN n > up_to THEN high ELSE low END AS severity FROM counts JOIN advice USING (type)""")
def advice_join(spark, sf_dir):
    return advice.recommendations(counted(spark, sf_dir))


@query(f"WITH {COUNTS_SQL} SELECT doc_id, type, n, {_case('type', tables.URGENCY, repr(tables.URGENCY_DEFAULT))} AS urgency FROM counts")
def remediation_left_default(spark, sf_dir):
    return advice.remediation(counted(spark, sf_dir))


@query(f"WITH {COUNTS_SQL} SELECT doc_id, count(*) AS n_types, count(*) FILTER (WHERE {_case('type', tables.URGENCY, repr(tables.URGENCY_DEFAULT))} = 'IMMEDIATE') AS n_immediate FROM counts GROUP BY doc_id")
def remediation_totals(spark, sf_dir):
    return advice.remediation_summary(advice.remediation(counted(spark, sf_dir)))


def _scenario_sql() -> str:
    rows = [(s, sev, list(need), list(need) + list(opt), []) for s, sev, need, opt in tables.SCENARIOS] + [(s, sev, list(need), list(need), list(absent)) for s, sev, need, absent in tables.COMBINED_SCENARIOS]
    lists = lambda x: "CAST([" + ", ".join(f"'{v}'" for v in x) + "] AS VARCHAR[])"
    values = ", ".join(f"('{s}', '{sev}', {lists(n)}, {lists(a)}, {lists(b)})" for s, sev, n, a, b in rows)
    return f"""{COUNTS_SQL}, present AS (SELECT doc_id, list(type) AS types FROM counts GROUP BY doc_id), rules(scenario, severity, needed, every, absent) AS (VALUES {values}),
fired AS (SELECT doc_id, scenario, severity, len(list_intersect(every, types))::DOUBLE / len(every) AS share FROM present, rules WHERE list_has_all(types, needed) AND NOT list_has_any(types, absent))"""


@query(f"WITH {_scenario_sql()} SELECT doc_id, scenario, severity, CASE WHEN share >= 0.8 THEN 'Very High' WHEN share >= 0.5 THEN 'High' WHEN share >= 0.3 THEN 'Medium' ELSE 'Low' END AS likelihood FROM fired")
def scenario_division(spark, sf_dir):
    types = in_rows(spark, sf_dir).select("doc_id", doctype.types_of(F.col("findings")).alias("types"))
    rows = types.select("doc_id", F.explode_outer(advice.fired(F.col("types"))).alias("s")).where(F.col("s").isNotNull())
    return rows.select("doc_id", "s.*")


@query(f"""WITH {_scenario_sql().replace(COUNTS_SQL, SCORES_SQL.replace("counts AS", "typed AS").replace("FROM counts", "FROM typed") + ", counts AS (SELECT doc_id, type, count(*) AS n FROM findings GROUP BY doc_id, type)")},
points AS (SELECT doc_id, sum({_case("severity", tables.SEVERITY_POINTS, "0")}) AS p FROM fired GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN p IS NULL THEN score * 0.5 ELSE least(score + p, 100.0) END, 1) AS threat FROM scores LEFT JOIN points USING (doc_id)""")
def threat_score(spark, sf_dir):
    rows = score.with_row_score(in_rows(spark, sf_dir), "findings").withColumn("fired", advice.fired(doctype.types_of(F.col("findings"))))
    return rows.select("doc_id", advice.threat(F.col("score"), F.col("fired")).alias("threat"))


CONFIDENCE_SQL = rf"""{FINDINGS_SQL}, letters AS (SELECT doc_id, value, length(value) AS len, unnest(string_split(value, '')) AS c FROM findings WHERE type = 'password'),
parts AS (SELECT doc_id, value, c, count(*)::DOUBLE / any_value(len) AS p FROM letters GROUP BY doc_id, value, c), bits AS (SELECT doc_id, value, -sum(p * log2(p)) AS h FROM parts GROUP BY doc_id, value),
sure AS (SELECT doc_id, type, round(CASE type WHEN 'email' THEN CASE WHEN regexp_full_match(value, '[^@]+@[^@]+\.[A-Za-z]{{2,}}') THEN 0.85 + 0.10 ELSE 0.85 - 0.15 END WHEN 'credit_card' THEN 0.78
    WHEN 'aadhaar' THEN CASE WHEN regexp_full_match(regexp_replace(value, '[^0-9]', '', 'g'), '[2-9][0-9]{{11}}') THEN 1.0 ELSE 0.75 END WHEN 'pan_card' THEN CASE WHEN regexp_full_match(value, '[A-Z]{{5}}[0-9]{{4}}[A-Z]') THEN 1.0 ELSE 0.75 END
    ELSE 0.55 + 0.15 * least(h / 4, 1.0) END::DOUBLE, 3) AS confidence FROM findings LEFT JOIN bits USING (doc_id, value))"""


@query(f"WITH {CONFIDENCE_SQL} SELECT doc_id, type, confidence, CASE WHEN confidence >= 0.75 THEN 'HIGH' WHEN confidence >= 0.45 THEN 'MEDIUM' ELSE 'LOW' END AS label FROM sure")
def regex_confidence_labels(spark, sf_dir):
    f = found(spark, sf_dir).withColumn("confidence", score.confidence(F.col("type"), F.col("value")))
    return f.select("doc_id", "type", "confidence", score.confidence_label(F.col("confidence")).alias("label"))


@query(f"WITH {CONFIDENCE_SQL} SELECT type, round(avg(confidence), 4) AS avg_confidence FROM sure GROUP BY type")
def avg_confidence_by_type(spark, sf_dir):
    return regex_confidence_labels(spark, sf_dir).groupBy("type").agg(F.round(F.avg("confidence"), 4).alias("avg_confidence"))


# --- history --------------------------------------------------------------------------------------------------------------


@query(f"WITH {SCANS_SQL} SELECT scan_id, strftime(upload_date, '%Y-%m-%d') AS day, score, risk, n_findings FROM scans WHERE owner_id = 7")
def hist_timeline(spark, sf_dir):
    return history.timeline(C.scans(spark, sf_dir), 7)


@query(f"WITH {SCANS_SQL} SELECT owner_id, scan_id, strftime(upload_date, '%Y-%m-%d') AS day, score, risk, n_findings FROM scans")
def hist_timelines(spark, sf_dir):
    return history.timelines(C.scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL} SELECT owner_id, count(*) AS n_scans, round(avg(score), 1) AS avg_score, max(score) AS max_score, min(score) AS min_score, sum(n_findings)::BIGINT AS n_findings FROM scans GROUP BY owner_id")
def hist_summary(spark, sf_dir):
    return history.summary(C.scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL} SELECT risk, count(*) AS n FROM scans GROUP BY risk")
def hist_risk_distribution(spark, sf_dir):
    return history.risk_distribution(C.scans(spark, sf_dir))


@query(f"""WITH {SCANS_SQL}, c AS (SELECT owner_id, risk, count(*) AS n, min((upload_date, scan_id)) AS first FROM scans GROUP BY owner_id, risk), r AS (SELECT *, row_number() OVER (PARTITION BY owner_id ORDER BY n DESC, first) AS k FROM c) SELECT owner_id, risk, n FROM r WHERE k = 1""")
def hist_risk_mode(spark, sf_dir):
    return history.most_common_risk(C.scans(spark, sf_dir))


@query(f"""WITH {SCANS_SQL}, k AS (SELECT owner_id, score, row_number() OVER (PARTITION BY owner_id ORDER BY upload_date, scan_id) AS k, count(*) OVER (PARTITION BY owner_id) AS n FROM scans),
h AS (SELECT owner_id, max(n) AS n, avg(score) FILTER (WHERE k <= greatest(n // 2, 1)) AS early, avg(score) FILTER (WHERE k > n - greatest(n // 2, 1)) AS late FROM k GROUP BY owner_id)
SELECT owner_id, CASE WHEN n < 2 THEN 0.0 ELSE round(late - early, 1) END AS change, CASE WHEN n < 2 THEN 'neutral' WHEN late - early > 5 THEN 'worsening' WHEN late - early < -5 THEN 'improving' ELSE 'stable' END AS trend FROM h""")
def hist_trend_half_split(spark, sf_dir):
    return history.trend(C.scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL} SELECT CASE WHEN starts_with(source, 'metadata') THEN 'metadata' ELSE source END AS source, count(*) AS n, round(avg(score), 1) AS avg_score, max(score) AS max_score, min(score) AS min_score FROM scans GROUP BY 1")
def hist_by_source(spark, sf_dir):
    return history.by_source(C.scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL} SELECT scan_id, owner_id, score, risk, source FROM scans ORDER BY upload_date DESC, scan_id DESC LIMIT 20")
def hist_recent_topk(spark, sf_dir):
    return history.recent(C.scans(spark, sf_dir), 20)


@query(f"""WITH {SCANS_SQL}, days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day), m AS (SELECT CAST(upload_date AS DATE) AS day, round(avg(score), 1) AS avg_score, count(*) AS n FROM scans GROUP BY 1)
SELECT strftime(days.day, '%Y-%m-%d') AS day, avg_score, coalesce(n, 0) AS n FROM days LEFT JOIN m USING (day)""")
def hist_daily_avg_filled(spark, sf_dir):
    return history.daily_average(C.scans(spark, sf_dir), C.AS_OF, 30)


@query(f"WITH {SCANS_SQL} SELECT count(*) AS n, count(*) FILTER (WHERE risk IN ('CRITICAL', 'HIGH')) AS n_high, count(*) FILTER (WHERE risk = 'MEDIUM') AS n_medium, count(*) FILTER (WHERE risk IN ('LOW', 'SAFE')) AS n_low, round(avg(score), 0) AS avg_score FROM scans")
def hist_dashboard_kpis(spark, sf_dir):
    return history.dashboard(C.scans(spark, sf_dir))


@query(f"WITH {SCANS_SQL}, r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY score DESC, scan_id) AS rank, scan_id, score FROM scans) SELECT * FROM r WHERE rank <= 3")
def hist_top_per_source(spark, sf_dir):
    return history.top_per_source(C.scans(spark, sf_dir))


JOBS_SQL = f"""{SCANS_SQL}, jobs AS (SELECT scan_id // 10 AS job_id, count(*) AS n_files, count(*) FILTER (WHERE score >= 75) AS n_alerts, max(score) AS max_score, round(avg(score), 1) AS avg_score,
  arg_max(risk, {_case("risk", tables.RISK_RANK, "0")}) AS highest_risk FROM scans GROUP BY 1)"""


@query(f"WITH {JOBS_SQL} SELECT * FROM jobs")
def batch_job_aggregate(spark, sf_dir):
    return history.batch_jobs(C.scans(spark, sf_dir))


@query(f"WITH {JOBS_SQL} SELECT count(*) AS n_jobs, sum(n_files)::BIGINT AS n_files, sum(n_alerts)::BIGINT AS n_alerts, round(avg(avg_score), 1) AS avg_score, max(max_score) AS max_score FROM jobs")
def cross_job_aggregate(spark, sf_dir):
    return history.across_jobs(history.batch_jobs(C.scans(spark, sf_dir)))


@query(f"WITH {SCANS_SQL} SELECT scan_id FROM scans WHERE NOT (source = 'click' AND score >= 75)")
def purge_legacy_antijoin(spark, sf_dir):
    scans = C.scans(spark, sf_dir)
    return store.delete(scans, scans, (F.col("source") == "click") & (F.col("score") >= 75))[0].select("scan_id")


# --- sessions -------------------------------------------------------------------------------------------------------------


@query(f"WITH {SCANS_SQL} SELECT owner_id AS session_id, count(*) AS n_frames, count(*) FILTER (WHERE score >= 20) AS n_alerts FROM scans GROUP BY owner_id")
def session_alert_counts(spark, sf_dir):
    return sessions.counters(sessions.frames(C.scans(spark, sf_dir)))


@query(f"WITH {SCANS_SQL} SELECT owner_id AS session_id, scan_id AS frame_id, score FROM scans WHERE score >= 20 AND owner_id IN (SELECT owner_id FROM scans WHERE source = 'purchase')")
def alerts_semi_sessions(spark, sf_dir):
    scans = C.scans(spark, sf_dir)
    mine = scans.where(F.col("source") == "purchase").select(F.col("owner_id").alias("session_id"))
    return sessions.alerts_of(sessions.alerts(sessions.frames(scans)), mine).select("session_id", "frame_id", "score")


@query(f"WITH {SCANS_SQL} SELECT scan_id AS frame_id, score FROM scans WHERE score >= 20 ORDER BY upload_date DESC, scan_id DESC LIMIT 100")
def alert_recent_100(spark, sf_dir):
    return sessions.alerts(sessions.frames(C.scans(spark, sf_dir))).orderBy(F.desc("ts"), F.desc("frame_id")).limit(100).select("frame_id", "score")


@query(f"""WITH RECURSIVE {SCANS_SQL}, alerts AS (SELECT owner_id AS session_id, scan_id AS frame_id, epoch(upload_date) AS t, row_number() OVER (PARTITION BY owner_id ORDER BY upload_date, scan_id) AS k FROM scans WHERE score >= 20 AND upload_date IS NOT NULL),
walked AS (SELECT session_id, frame_id, k, t AS last, true AS passed FROM alerts WHERE k = 1
  UNION ALL SELECT a.session_id, a.frame_id, a.k, CASE WHEN a.t - w.last >= 30 THEN a.t ELSE w.last END, a.t - w.last >= 30 FROM walked w JOIN alerts a ON a.session_id = w.session_id AND a.k = w.k + 1)
SELECT session_id, frame_id FROM walked WHERE passed""")
def alert_cooldown(spark, sf_dir):
    return sessions.with_cooldown(sessions.alerts(sessions.frames(C.scans(spark, sf_dir))))


# --- web pages ------------------------------------------------------------------------------------------------------------

HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"


@query(rf"""SELECT page_id, regexp_matches(url, '^https?://') AND {HOST_SQL} <> '' AND {HOST_SQL} NOT IN {_in(tables.BLOCKED_HOSTS)}
 AND NOT regexp_matches({HOST_SQL}, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.)') AS allowed FROM pages""")
def url_guard(spark, sf_dir):
    return C.table(spark, sf_dir, "pages").select("page_id", C.is_allowed(F.col("url")).alias("allowed"))


@query(f"SELECT page_id, CASE {' '.join(f"WHEN {HOST_SQL} = '{s}' OR ends_with({HOST_SQL}, '.{s}') THEN '{n}'" for s, n in tables.PLATFORMS)} ELSE 'unsupported' END AS platform FROM pages")
def url_platform_dispatch(spark, sf_dir):
    return C.table(spark, sf_dir, "pages").select("page_id", C.platform(F.col("url")).alias("platform"))


@query("SELECT page_id, url FROM pages WHERE starts_with(lower(url), 'http://')")
def url_http_only(spark, sf_dir):
    return C.table(spark, sf_dir, "pages").where(F.startswith(F.lower("url"), F.lit("http://"))).select("page_id", "url")


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, page (what one pass over the page found) and text (its lines)."""
    rows = C.table(spark, sf_dir, "pages").select("page_id", "url", pages.page(F.col("html")).alias("page"))
    return rows.withColumn("text", pages.lines(F.col("page.text")))


@query(f"WITH {PAGES_SQL} SELECT page_id, title, text FROM page_texts")
def page_texts(spark, sf_dir):
    return read_pages(spark, sf_dir).select("page_id", pages.title(F.col("page")).alias("title"), "text")


@query(f"WITH {URL_FINDINGS_SQL} SELECT page_id, type, value FROM url_found")
def url_findings(spark, sf_dir):
    return detect.exploded(detect.with_url_findings(read_pages(spark, sf_dir)), F.col("findings"), "page_id")


@query(f"WITH {URL_SCORES_SQL} SELECT page_id, score, risk FROM url_scored")
def url_score(spark, sf_dir):
    return score.with_url_score(detect.with_url_findings(read_pages(spark, sf_dir))).select("page_id", "score", "risk")


@query()
def conversation_findings(spark, sf_dir):
    """The profile-page patterns over the turns of each conversation."""
    texts = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", detect.social_findings(F.array(F.coalesce("text", F.lit("")))).alias("f"))
    return texts.select("conv_id", "turn", F.explode("f").alias("f")).select("conv_id", "turn", "f.type", "f.value")


ADVICE_ORDER = "CASE severity WHEN 'HIGH' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END"
CREDIT_SQL = f"""WITH {SCORES_SQL}, advice(type, up_to, low, high) AS (VALUES ('email', 2, 'MEDIUM', 'HIGH'), ('password', 0, 'HIGH', 'HIGH'), ('aadhaar', 0, 'HIGH', 'HIGH'), ('pan_card', 0, 'HIGH', 'HIGH'), ('credit_card', 0, 'HIGH', 'HIGH')),
own AS (SELECT doc_id, type, CASE WHEN n > up_to THEN high ELSE low END AS severity FROM counts JOIN advice USING (type)
  UNION ALL SELECT doc_id, 'general', CASE WHEN risk IN ('CRITICAL', 'HIGH') THEN 'HIGH' WHEN risk = 'MEDIUM' THEN 'MEDIUM' ELSE 'LOW' END FROM leveled)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {ADVICE_ORDER}, type) AS place, type, severity FROM own"""

from exposark import catalogue_jobs, catalogue_more, catalogue_time, catalogue_web  # noqa: E402  register further queries

__all__ = ["ORACLES", "QUERIES", "catalogue_jobs", "catalogue_more", "catalogue_time", "catalogue_web"]
