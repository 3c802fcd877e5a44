"""Queries over time and rules: moving averages, visits, rules as a join, maps of types by day and owner."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposark.catalogue import SCANS_SQL, in_rows
from exposark.operators import doctype, rules
from exposark.plans import history, sessions
from exposark.registry import ORACLES, query
from exposark.sources import corpus as C

VISIT_GAP = 12 * 3600


@query(f"""WITH {SCANS_SQL}, days AS (SELECT owner_id, CAST(upload_date AS DATE) AS day, sum(CAST(score AS DECIMAL(18, 1))) AS total, count(score) AS n FROM scans WHERE upload_date IS NOT NULL GROUP BY ALL),
calendar AS (SELECT owner_id, CAST(unnest(generate_series(low, high, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT owner_id, min(day) AS low, max(day) AS high FROM days GROUP BY owner_id)),
filled AS (SELECT c.owner_id, c.day, coalesce(total, 0) AS total, coalesce(n, 0) AS n FROM calendar c LEFT JOIN days d ON c.owner_id IS NOT DISTINCT FROM d.owner_id AND c.day = d.day)
SELECT owner_id, strftime(day, '%Y-%m-%d') AS day, n, total::DOUBLE / nullif(n, 0) AS avg_score,
  (sum(total) OVER seven)::DOUBLE / nullif(sum(n) OVER seven, 0) AS avg_7, (sum(total) OVER thirty)::DOUBLE / nullif(sum(n) OVER thirty, 0) AS avg_30 FROM filled
WINDOW seven AS (PARTITION BY owner_id ORDER BY day RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW), thirty AS (PARTITION BY owner_id ORDER BY day RANGE BETWEEN INTERVAL 29 DAYS PRECEDING AND CURRENT ROW)""")
def hist_moving_averages(spark, sf_dir):
    return history.moving_averages(C.scans(spark, sf_dir))


@query(f"""WITH {SCANS_SQL}, stepped AS (SELECT owner_id, scan_id, upload_date, score, coalesce(epoch(upload_date) - epoch(lag(upload_date) OVER w) >= {VISIT_GAP}, true) AS far FROM scans WHERE upload_date IS NOT NULL WINDOW w AS (PARTITION BY owner_id ORDER BY upload_date, scan_id)),
parted AS (SELECT *, sum(far::INT) OVER (PARTITION BY owner_id ORDER BY upload_date, scan_id) AS visit FROM stepped)
SELECT owner_id AS session_id, strftime(min(upload_date), '%Y-%m-%d %H:%M:%S') AS began, strftime(max(upload_date), '%Y-%m-%d %H:%M:%S') AS ended, count(*) AS n_frames, count(*) FILTER (WHERE score >= 20) AS n_alerts, max(score) AS max_score FROM parted GROUP BY owner_id, visit""")
def session_visits(spark, sf_dir):
    """Visits of each owner, parted by half a day without a scan."""
    rows = sessions.visits(sessions.frames(C.scans(spark, sf_dir)), VISIT_GAP)
    return rows.select("session_id", *(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("began", "ended")), "n_frames", "n_alerts", "max_score")


@query(ORACLES["scenario_division"])
def scenario_rule_join(spark, sf_dir):
    """The scenarios fired by each document's types, with the rules as a table."""
    types = in_rows(spark, sf_dir).select("doc_id", doctype.types_of(F.col("findings")).alias("types"))
    return rules.fired(types, rules.scenario_rules(spark))
