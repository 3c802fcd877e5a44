"""Queries over pages and conversations: who a page shows, what that exposes, and what turns of talk hold."""

from __future__ import annotations

from pyspark.sql import functions as F

from exposark.catalogue import HOST_SQL, read_pages
from exposark.functions import text as T
from exposark.operators import classify, detect, entities, score
from exposark.pages_sql import PAGES_SQL
from exposark.registry import ORACLES, query
from exposark.sources import corpus as C
from exposark.sources import pages


def shown(spark, sf_dir):
    """read_pages with platform, username, what the page's payloads say of its owner, and these as a map."""
    rows = read_pages(spark, sf_dir).withColumn("platform", C.platform(F.col("url"))).withColumn("username", pages.username(F.col("url"))).withColumn("own", pages.profile_fields(F.col("page")))
    names = ("display_name", "bio", "website", "location")
    every = F.map_from_arrays(F.array(F.lit("username"), *map(F.lit, names)), F.array(F.coalesce("username", F.lit("")), *(F.coalesce(f"own.{n}", F.lit("")) for n in names)))
    return rows.withColumn("fields", every)


# The forms of metas and of JSON-LD, addresses of profiles, patterns of profile pages.
PROFILES_SQL = rf"""{PAGES_SQL},
payloads AS (SELECT page_id, url, nullif(regexp_extract(url, '^[a-zA-Z]+://[^/?#]+/(?:u/|user/|in/|company/)?([^/?#]+)', 1), '') AS username,
  CASE WHEN json_valid(regexp_extract(coalesce(html, ''), '(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script', 1)) THEN regexp_extract(coalesce(html, ''), '(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script', 1) END AS graph,
  nullif(regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*(?:property|name)="og:title"[^>]*content="([^"]*)"', 1), '') AS og_title,
  nullif(regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*(?:property|name)="og:description"[^>]*content="([^"]*)"', 1), '') AS og_description,
  nullif(regexp_extract(coalesce(html, ''), '(?is)<meta\b[^>]*(?:property|name)="og:image"[^>]*content="([^"]*)"', 1), '') AS og_image FROM decoded),
profiles AS (SELECT page_id, url, username, coalesce(nullif(json_extract_string(graph, '$.name'), ''), og_title) AS display_name, coalesce(nullif(left(json_extract_string(graph, '$.description'), 300), ''), og_description) AS bio,
  nullif(json_extract_string(graph, '$.url'), '') AS website, nullif(json_extract_string(graph, '$.address.addressLocality'), '') AS location, coalesce(nullif(json_extract_string(graph, '$.logo'), ''), og_image) AS avatar FROM payloads)"""


@query(f"WITH {PROFILES_SQL} SELECT p.page_id, title, username, display_name, bio, website, location, avatar FROM profiles p JOIN page_texts USING (page_id)")
def page_profiles(spark, sf_dir):
    """Title, name in the address, and JSON-LD and Open Graph fields of every page."""
    return shown(spark, sf_dir).select("page_id", pages.title(F.col("page")).alias("title"), "username", "own.*")


@query(f"""WITH {PROFILES_SQL} SELECT page_id, 'username' AS type, username AS value FROM profiles WHERE username <> 'unknown'
UNION ALL SELECT page_id, 'display_name', left(display_name, 100) FROM profiles WHERE lower(trim(display_name)) <> lower(trim(coalesce(username, '')))
UNION ALL SELECT page_id, 'location', left(location, 100) FROM profiles WHERE length(location) > 2
UNION ALL SELECT page_id, 'website', left(website, 200) FROM profiles WHERE website IS NOT NULL
UNION ALL SELECT page_id, 'bio', left(bio, 150) FROM profiles WHERE length(trim(bio)) > 10""")
def page_profile_findings(spark, sf_dir):
    """What the fields of the pages' profiles expose."""
    rows = shown(spark, sf_dir).withColumn("findings", detect.profile_findings(F.col("fields"), F.lit(False)))
    return detect.exploded(rows, F.col("findings"), "page_id")


EXPOSURE_SQL = rf"""{PROFILES_SQL}, contacts AS (SELECT page_id, regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b') AS mails,
    list_filter(regexp_extract_all(text, '(?:[+]?\d[\d -]*\d)'), lambda v: regexp_full_match(v, '[6-9]\d{{9}}|[+]?\d{{1,3}}[ -]\d{{3}}[ -]\d{{3}}[ -]\d{{4}}')) AS calls FROM page_texts),
facts AS (SELECT p.page_id, lower(coalesce(username, '')) AS u, lower(coalesce(display_name, '')) AS d, lower(coalesce(bio, '')) AS b, lower(coalesce(location, '')) AS l, mails, calls, {HOST_SQL} = 'linkedin.com' OR ends_with({HOST_SQL}, '.linkedin.com') AS linkedin FROM profiles p JOIN contacts USING (page_id)),
classed AS (SELECT page_id, CASE WHEN linkedin OR regexp_matches(b, 'company|ceo|founder|official|business|corp|inc|director') THEN 'public_business'
  WHEN len(list_filter(mails[1:3], lambda m: regexp_matches(lower(m), 'gmail\.com|yahoo\.com|hotmail\.com|outlook\.com|protonmail\.com'))) > 0 AND len(calls) > 0 AND length(l) > 2 THEN 'personal_exposure'
  WHEN (d = '' OR d = u) AND length(trim(b)) < 5 AND len(mails) = 0 AND len(calls) = 0 AND (regexp_matches(u, 'bot|anon|user|guest|temp') OR length(u) < 3) THEN 'anonymous' ELSE 'professional_public' END AS exposure FROM facts)"""


@query(f"WITH {EXPOSURE_SQL} SELECT page_id, exposure FROM classed")
def page_exposure_class(spark, sf_dir):
    """How each page exposes its owner."""
    rows = shown(spark, sf_dir).withColumn("contacts", detect.social_findings(F.array("text")))
    return rows.select("page_id", classify.exposure_class(F.col("platform"), F.col("fields"), F.col("contacts")).alias("exposure"))


@query(rf"""WITH {EXPOSURE_SQL}, told AS (SELECT page_id, least(25 * len(list_distinct(mails)[1:3]) + 28 * len(list_distinct(calls)[1:3]) + 8 * len(list_distinct(list_filter(regexp_extract_all(text, 'https?://[^\s"''<>]+'),
    lambda v: NOT regexp_matches(v, '(?i)//([a-z0-9-]+\.)*(twitter|x|linkedin|reddit|instagram|github|facebook|youtube)\.com')))[1:3]), 100) AS said,
    12.5 * len(list_distinct(mails)[1:3]) + 14 * len(list_distinct(calls)[1:3]) AS halves FROM contacts JOIN page_texts USING (page_id)),
summed AS (SELECT p.page_id, exposure, halves, said + CASE WHEN coalesce(username, 'unknown') <> 'unknown' THEN 5 ELSE 0 END + CASE WHEN lower(trim(display_name)) <> lower(trim(coalesce(username, ''))) THEN 6 ELSE 0 END + CASE WHEN length(location) > 2 THEN 10 ELSE 0 END
    + CASE WHEN website IS NOT NULL THEN 8 ELSE 0 END + CASE WHEN length(trim(bio)) > 10 THEN 7 ELSE 0 END AS total FROM profiles p JOIN told USING (page_id) JOIN classed USING (page_id)),
moved AS (SELECT page_id, exposure, greatest(0.0, least(100.0, round(CASE exposure WHEN 'public_business' THEN total - halves WHEN 'personal_exposure' THEN total + 10 WHEN 'anonymous' THEN least(total, 11) ELSE total END, 1)))::DOUBLE AS score FROM summed)
SELECT page_id, exposure, score, CASE WHEN score >= 45 THEN 'CRITICAL' WHEN score >= 25 THEN 'HIGH' WHEN score >= 12 THEN 'MEDIUM' WHEN score >= 5 THEN 'LOW' ELSE 'SAFE' END AS risk FROM moved""")
def page_social_score(spark, sf_dir):
    """Class, score and level of each page as somebody's profile."""
    rows = shown(spark, sf_dir).withColumn("contacts", detect.social_findings(F.array("text")))
    website = F.exists("contacts", lambda f: f["type"] == "website")
    rows = rows.withColumn("findings", detect.profile_findings(F.col("fields"), website)).withColumn("exposure", classify.exposure_class(F.col("platform"), F.col("fields"), F.col("contacts")))
    rows = rows.withColumn("score", score.social_score(F.col("contacts"), F.col("findings"), F.col("exposure")))
    return rows.select("page_id", "exposure", "score", score.risk(F.col("score"), "social").alias("risk"))


@query(rf"""WITH {PAGES_SQL}, ls AS (SELECT page_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM page_texts)
SELECT p.page_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE length(line) >= 4 AND NOT regexp_matches(line,
  '(?i)\b(?:log\s*in|sign\s*in|sign\s*up|create\s*account|register)\b|\b(?:forgot\s*password|reset\s*password|change\s*password)\b|\b(?:cookie|privacy\s*policy|terms\s*of\s*service|terms\s*of\s*use)\b|\b(?:help\s*center|support\s*center|report\s*abuse|contact\s*us)\b')), '') AS text
FROM page_texts p JOIN ls USING (page_id) GROUP BY p.page_id""")
def page_profile_text(spark, sf_dir):
    """The lines of each page that are no boilerplate of a platform."""
    return read_pages(spark, sf_dir).select("page_id", detect.profile_text(F.col("text")).alias("text"))


@query(r"""WITH found AS (SELECT DISTINCT conv_id, turn, unnest(regexp_extract_all(coalesce(text, ''), '(?:^|[ \n])([A-Z][a-z]+(?: [A-Z][a-z]+)*)(?:$|[ \n.,!?])', 1)) AS value FROM conversations),
said AS (SELECT *, list_filter(string_split_regex(value, '\s+'), lambda w: length(w) >= 2) AS ws FROM found)
SELECT conv_id, turn, value, round(CASE WHEN length(value) < 3 OR (NOT contains(value, ' ') AND length(value) < 5) OR lower(value) IN ('the', 'this', 'that', 'hello', 'thanks') THEN 0.0
  ELSE least(least(length(value) / 22.0::DOUBLE, 0.8) + CASE WHEN len(ws) >= 2 THEN 0.3::DOUBLE ELSE 0.0 END, 1.0) END, 2)::DOUBLE AS confidence FROM said""")
def conversation_entities(spark, sf_dir):
    """Capitalised names in each turn with the confidence that they would have as persons."""
    rows = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(T.matches(F.col("text"), r"(?:^|[ \n])([A-Z][a-z]+(?: [A-Z][a-z]+)*)(?:$|[ \n.,!?])", 1)).alias("value"))
    return rows.select("conv_id", "turn", "value", detect.entity_confidence(F.col("value"), F.lit("PERSON"), ("the", "this", "that", "hello", "thanks")).alias("confidence")).distinct()


@query("""SELECT doc_id, CASE WHEN starts_with(s, 'author') THEN 'author' ELSE s END AS field, v AS value, w AS weight FROM (SELECT doc_id, unnest(['author', 'keywords', 'revision']) AS s, unnest([source, lang, CAST(n_chars AS VARCHAR)]) AS v, unnest([15, 2, 0]) AS w FROM documents)
WHERE trim(coalesce(v, '')) <> '' AND lower(trim(v)) NOT IN ('none', 'null', 'unknown', 'undefined', 'n/a', 'na')""")
def doc_metadata_fields(spark, sf_dir):
    """What the documents' own columns say as metadata: source as author, lang as keywords, length as revision."""
    pairs = F.array(*(F.struct(F.lit(k).alias("field"), F.col(c).cast("string").alias("value")) for k, c in (("author", "source"), ("keywords", "lang"), ("revision", "n_chars"))))
    fields = C.table(spark, sf_dir, "documents").select("doc_id", F.explode(pairs).alias("f")).select("doc_id", "f.*")
    return score.metadata_fields(fields, "doc_id").select("doc_id", "field", "value", "weight")


@query(rf"""WITH sure AS ({ORACLES["conversation_entities"]}) SELECT conv_id, turn, value, confidence FROM sure WHERE confidence >= 0.7""")
def conversation_sure_entities(spark, sf_dir):
    """Entities of each turn that pass the confidence filter: findings of a model need 0.7, those of patterns none."""
    rows = conversation_entities(spark, sf_dir).withColumn("f", F.array(F.struct(F.lit("person_name").alias("type"), "value", F.lit("ai").alias("method"), "confidence")))
    kept = rows.select("conv_id", "turn", F.explode(detect.confident(F.col("f"))).alias("f"))
    return kept.select("conv_id", "turn", "f.value", "f.confidence")


@query(rf"""WITH found AS ({ORACLES["conversation_entities"]}) SELECT conv_id, turn, value,
  NOT (regexp_matches(value, '[a-z][A-Z]') OR len(list_filter(string_split(lower(value), ' '), lambda w: NOT (length(w) < 3 OR w IN ('the', 'this', 'that', 'hello', 'thanks')))) = 0
    OR lower(value) IN ('the', 'this', 'that', 'hello', 'thanks') OR (NOT contains(value, ' ') AND length(value) < 4) OR regexp_matches(lower(value), '(^| )(python|java|sql|data|model|code)( |$)')) AS stands FROM found""")
def conversation_valid_persons(spark, sf_dir):
    """Whether the capitalised names of each turn would stand as persons."""
    words = entities.Words(noise=("the", "this", "that", "hello", "thanks"), technical=("python", "java", "sql", "data", "model", "code"))
    rows = conversation_entities(spark, sf_dir)
    return rows.select("conv_id", "turn", "value", entities.stands(F.col("value"), F.lit("PERSON"), words=words).alias("stands"))
