"""The registered queries of the training-data operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.llm import bpe, importance, lines, mixture, pagetext, phrases, pii, quality, secrets, simhash, textcnn, tokenfiles, webp
from exposark.llm.common import documents


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = quality.judge(docs, quality.fit(docs, labels(spark, sf_dir)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(documents(spark, sf_dir))


def op5_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return webp.media_features(documents(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return textcnn.score(docs, textcnn.fit(docs, labels(spark, sf_dir)))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.write_and_check(documents(spark, sf_dir))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix(documents(spark, sf_dir)).withColumn("chance", F.round("chance", 9))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op11_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("n_words")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_bpe, op3_quality, op4_pii, op5_webp, op6_toxicity, op7_token_files, op8_line_dedup, op9_mixture, op10_simhash, op11_main_text, op12_importance, op13_phrases)}

ORACLES = {
    "op8_line_dedup": """
WITH cut AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM cut, (SELECT unnest(range(1, (SELECT max(len(ls)) + 1 FROM cut))) AS i) WHERE i <= len(ls)),
owners AS (SELECT key, min(doc_id) AS owner FROM lines WHERE length(key) >= 10 GROUP BY key),
marked AS (SELECT l.doc_id, i, line, coalesce(owner < l.doc_id, false) AS dropped FROM lines l LEFT JOIN owners USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""",
    "op9_mixture": r"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':mix:' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5) / 4503599627370496.0 AS u FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighted AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight, CAST(source_size * 2 AS DOUBLE) AS most FROM sources),
leveled AS (SELECT *, (sum(source_size) OVER () * 1.5 - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted WINDOW w AS (ORDER BY most / weight, source IS NULL, source)),
final AS (SELECT *, max(level) FILTER (WHERE level <= most / weight) OVER () AS final FROM leveled),
targets AS (SELECT source, source_size, least(most, coalesce(weight * final, most)) AS target FROM final),
parts AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets),
rests AS (SELECT *, target - whole * source_size AS rest FROM parts),
classes AS (SELECT source, length(bin(size)) AS bits, sum(size) AS words FROM sized WHERE size > 0 GROUP BY ALL),
levels AS (SELECT k.source, bits, (rest - coalesce(sum(words) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(words / bits) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS c
  FROM classes k JOIN rests r ON k.source IS NOT DISTINCT FROM r.source WINDOW w AS (PARTITION BY k.source ORDER BY bits)),
chances AS (SELECT source, arg_min(c, bits) AS c FROM levels WHERE c / bits <= 1 GROUP BY source),
chanced AS (SELECT s.*, source_size, target, whole, rest, CASE WHEN size > 0 AND rest > 0 THEN least(coalesce(c, 0.0) / length(bin(size)), 1.0) ELSE 0.0 END AS chance
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source LEFT JOIN chances x ON s.source IS NOT DISTINCT FROM x.source),
run AS (SELECT *, sum(size) OVER (PARTITION BY source, chance > 0 ORDER BY (u / (1 - u)) * ((1 - chance) / chance) RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM chanced),
copied AS (SELECT *, whole + CASE WHEN chance > 0 AND until - size / 2 <= rest THEN 1 ELSE 0 END AS copies FROM run)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, CAST(copies AS BIGINT) AS copies, round(chance, 9) AS chance FROM copied""",
    "op12_importance": r"""
WITH texts AS (SELECT doc_id AS id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
cut AS (SELECT row_number() OVER () AS row, id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
placed AS (SELECT row, unnest(ws) AS a, unnest(range(len(ws))) AS i FROM cut),
runs AS (SELECT row, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c FROM placed WINDOW w AS (PARTITION BY row ORDER BY i)),
features AS (SELECT row, a AS feature FROM runs UNION ALL SELECT row, a || ' ' || b FROM runs WHERE b IS NOT NULL UNION ALL SELECT row, a || ' ' || b || ' ' || c FROM runs WHERE c IS NOT NULL),
crc_table AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS x FROM range(256) r(i))),
hexed AS (SELECT feature, hex(encode(feature)) AS h FROM (SELECT DISTINCT feature FROM features)),
hashed AS (SELECT feature, xor(list_reduce([4294967295] || list_transform(range(1, len(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc_table),
counted AS (SELECT row, bucket, count(*) AS n FROM features JOIN hashed USING (feature) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE own), 0) AS s, coalesce(sum(n) FILTER (WHERE NOT own), 0) AS t FROM counted JOIN cut USING (row) GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0) AS all_s, coalesce(sum(t), 0) AS all_t FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM totals, sums),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM counted JOIN gains USING (bucket) GROUP BY row),
scored AS (SELECT id AS doc_id, len(ws) AS n_words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
  (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM cut LEFT JOIN weights USING (row) WHERE own),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n_words >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= 5 * n // 100 THEN place END::BIGINT AS rank FROM ranked""",
    "op13_phrases": r"""
WITH pieces AS (SELECT row_number() OVER () AS id, lang, piece FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
placed AS (SELECT id, lang, unnest(ws) AS w1, unnest(range(len(ws))) AS i FROM (SELECT id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces)),
runs AS (SELECT lang, w1, lead(w1, 1) OVER w AS w2, lead(w1, 2) OVER w AS w3 FROM placed WINDOW w AS (PARTITION BY id ORDER BY i)),
n AS (SELECT lang, count(*) AS n FROM placed GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
inside AS (SELECT lang, w1, w2, max(f) AS longer FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
two AS (SELECT b.lang, b.w1 || ' ' || b.w2 AS phrase, b.f AS a, l.f AS l, r.f AS r, 1 AS k FROM f2 b JOIN f1 l ON b.lang = l.lang AND b.w1 = l.w1 JOIN f1 r ON b.lang = r.lang AND b.w2 = r.w1
  LEFT JOIN inside x ON b.lang = x.lang AND b.w1 = x.w1 AND b.w2 = x.w2 WHERE b.f >= 10 AND NOT coalesce(100 * longer >= 50 * b.f, false)),
three AS (SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3 AS phrase, t.f AS a, l.f AS l, r.f AS r, 1 AS k FROM f3 t JOIN f1 l ON t.lang = l.lang AND t.w1 = l.w1 JOIN f2 r ON t.lang = r.lang AND t.w2 = r.w1 AND t.w3 = r.w2
  UNION ALL SELECT t.lang, t.w1 || ' ' || t.w2 || ' ' || t.w3, t.f, l.f, r.f, 2 FROM f3 t JOIN f2 l ON t.lang = l.lang AND t.w1 = l.w1 AND t.w2 = l.w2 JOIN f1 r ON t.lang = r.lang AND t.w3 = r.w1),
cuts AS (SELECT *, (1000000 * a::HUGEINT * a::HUGEINT // (l::HUGEINT * r::HUGEINT))::BIGINT AS score FROM (SELECT * FROM two UNION ALL SELECT * FROM three)),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM lowest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000""",
}
