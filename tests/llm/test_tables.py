"""The operators as Spark jobs: against SQL or brute force, and on awkward and empty tables."""

from __future__ import annotations

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

import corpus_pipeline
from exposark.llm import bpe, lines, mixture, pii, quality, queries, secrets, simhash, textcnn, tokenfiles, webp

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    ours, theirs = queries.QUERIES[name](spark, SF), con.sql(queries.ORACLES[name])
    columns = sorted(theirs.columns)
    assert sorted(ours.columns) == columns
    # rows and not frames: a null among whole numbers stays a null
    place = [theirs.columns.index(c) for c in columns]
    assert sorted(repr([r[c] for c in columns]) for r in ours.collect()) == sorted(repr([r[k] for k in place]) for r in theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_one_row_a_document(spark, name):
    out = queries.QUERIES[name](spark, SF)
    of = "pages" if name == "op11_main_text" else "documents"
    assert out.count() == spark.read.parquet(f"{SF}/{of}.parquet").count()


LABELS = "doc_id long, quality int, toxic int"


def jobs(spark):
    none = spark.createDataFrame([], LABELS)
    field = pii.fit(20, 1)
    return {
        "secrets": secrets.scan_secrets,
        "masked secrets": secrets.mask_secrets,
        "bpe": bpe.encode,
        "bpe digests": bpe.encode_digests,
        "quality": lambda d: quality.judge(d, quality.fit(d, none)),
        "pii": lambda d: pii.scan_pii(d, field),
        "masked pii": lambda d: pii.mask_pii(d, field),
        "media": webp.media_features,
        "pixels": lambda d: webp.pixel_columns(webp.media_column(d)),
        "toxicity": lambda d: textcnn.score(d, textcnn.fit(d, none)),
        "token files": tokenfiles.write_and_check,
        "lines": lines.dedup_lines,
        "mixture": mixture.mix,
        "simhash": simhash.near_duplicates,
    }


def test_awkward_and_empty_tables(spark, docs, empty):
    for name, job in jobs(spark).items():
        assert len(job(docs).collect()) == docs.count(), name
        assert job(empty).collect() == [], name
    assert simhash.keep_one(empty).collect() == [] and mixture.mixed(empty).collect() == []
    assert simhash.keep_one(docs).columns == docs.columns and mixture.mixed(docs).columns == docs.columns


def test_lines_plainly(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    strip = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans(lines.UPPER, lines.LOWER))
    owner: dict[str, int] = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for x in (t or "").split("\n"):
            if len(strip(x)) >= 10:
                owner.setdefault(strip(x), i)
    want = Counter()
    for i, t in rows:
        kept = [x for x in (t or "").split("\n") if i is None or len(strip(x)) < 10 or owner[strip(x)] == i]
        want[i, "\n".join(kept)] += 1
    for batches in (1, 3, 5):
        assert Counter((r["doc_id"], r["text"] or "") for r in lines.dedup_lines(docs, batches).collect()) == want


def near_plainly(rows: list[tuple[int, int]], radius: int = 4) -> dict[int, int]:
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in rows}


def fingerprint_plainly(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_plainly(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r["doc_id"], fingerprint_plainly(r["text"])) for r in table.select("doc_id", "text").collect())
    want = near_plainly(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(table).collect()}
    assert got == {i: (f"{f:016x}", want[i]) for i, f in rows}


def test_every_pair_within_the_radius_meets():
    masks = simhash.covering_masks()
    assert len(masks) == 31
    rng = random.Random(4)
    for _ in range(3000):
        x = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        assert any(m & (1 << 64) - 1 & x == 0 for m in masks)


@pytest.mark.parametrize("largest", [4096, 3])
def test_large_buckets_link_as_small_ones(spark, largest):
    """With buckets of over 3 taken as large, nearly all go through shared neighbours; chains and dense groups alike."""
    rng = random.Random(8)
    values = [rng.getrandbits(64) for _ in range(20)]
    for base in values[:3]:
        for _ in range(25):
            values.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))))
    x = values[5]
    for b in range(0, 40, 4):  # a chain of steps of 4 bits
        x ^= 0b1111 << b
        values.append(x)
    values = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    nodes = spark.createDataFrame([(v,) for v in values], "fp long")
    edges = simhash.links(nodes, largest=largest)
    found = [(r["a"], r["b"]) for r in edges.collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in found)
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert {v: roots.get(v, v) for v in values} == near_plainly([(v, v) for v in sorted(values)])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    assert {r["node"]: r["root"] for r in simhash.components(edges).collect()} == {**{i: 0 for i in range(1, 301)}, 1001: 1000}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100, None: 50}, {"a": 1000, "b": 10, "c": 10}, {"a": 5}, {"a": 0, "b": 7}])
def test_targets_plainly(spark, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(sizes.values())
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * sizes[s] + 1e-9}
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else share[s]
        left -= sum(target[s] for s in over)
        open_ -= over or open_
    got = {r["source"]: r["target"] for r in mixture.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(target)


def test_mixture_takes_what_it_should(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(0, 9)), f"s{min(rng.randint(0, 8), 3)}") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixture.mix(table).collect()
    source = {i: s for i, _, s in rows}
    for s in set(source.values()):
        mine = [r for r in out if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 9
    assert all(r["taken"] in (0, r["size"], 2 * r["size"]) for r in out)
    assert Counter(r["doc_id"] for r in mixture.mixed(table).collect()) == Counter({r["doc_id"]: r["copies"] for r in out if r["copies"] and r["size"]})


def test_chunks_are_no_larger_than_a_piece(spark, tmp_path):
    """A chunk of a little more than a piece would be coded as that piece and a second one of a few blocks."""
    texts = ["one two " * (tokenfiles.CHUNK // 5)] * 3
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        tokenfiles.write_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), str(tmp_path / "ids"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = spark.read.parquet(str(tmp_path / "ids")).collect()
    assert sum(len(r["counts"]) for r in rows) == 3
    assert all(r["n_ids"] <= tokenfiles.CHUNK and r["n_ids"] == sum(r["counts"]) for r in rows)


def test_token_files_plainly(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    library = tokenfiles.load(tokenfiles.default_path()).library
    start, want = 0, {}
    for r in sorted(table.select("doc_id", "text").collect()):
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want[r["doc_id"]] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in tokenfiles.write_and_check(table).collect()}
    assert got == want


def test_toxicity_on_held_out(spark):
    rows = {r["doc_id"]: r for r in queries.op6_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    held = [(rows[i]["score"], t) for i, t in labels.items() if rows[i]["held_out"]]
    assert all(rows[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in list(rows)[:500])
    bad, good = [s for s, t in held if t == 1], [s for s, t in held if t == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in bad for b in good]) > 0.94


def test_pipeline_plainly(spark):
    """The stages one after another, each against a plain version of it on the same input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = corpus_pipeline.good_documents(spark, docs, SF)
    rules = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.judge(docs, rules).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == kept and all(len((rows[i] or "").split()) >= 50 for i in kept)
    single = corpus_pipeline.without_repeated_lines(spark, good, SF)
    texts = {r["doc_id"]: r["text"] for r in single.collect()}
    assert set(texts) == kept and single.columns == docs.columns
    groups = near_plainly(sorted((i, fingerprint_plainly(t)) for i, t in texts.items()))
    one = corpus_pipeline.one_of_each_group(spark, single, SF)
    assert {r["doc_id"] for r in one.collect()} == {i for i, r in groups.items() if i == r} and one.columns == docs.columns
    mixed = corpus_pipeline.mixed_sources(spark, one, SF)
    assert mixed.columns == docs.columns
    library = bpe.load(bpe.default_path())
    want = Counter((r["doc_id"], hashlib.sha256(" ".join(map(str, library.encode(r["text"]))).encode()).hexdigest()) for r in mixed.collect())
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, SF).collect()) == want


CLASHING = ("own", "row", "id", "__doc", "__row", "__n", "n_lines", "n_dropped", "dropped", "size", "copies", "kept", "rule", "u", "bin")


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_clashing_names(spark, docs, stage):
    """Extra columns of the names that the operators use themselves stay as they are and change nothing else."""
    extra = docs.selectExpr("*", *(f"'{c}' AS `{c}`" for c in CLASHING))
    plain, more = stage(spark, docs, SF), stage(spark, extra, SF)
    shared = [c for c in plain.columns if c not in CLASHING]
    key = lambda f: sorted(map(repr, f.select(*shared).collect()))
    assert key(more) == key(plain)
    if "text" in more.columns:
        assert more.columns == extra.columns
        assert all(r[c] == c for r in more.collect() for c in CLASHING)


def test_quality_judges_rows_of_one_id_apart(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = spark.createDataFrame([(None, good), (None, "short"), (1, good), (1, "short"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, quality.kept_rows(rows, []).collect()), key=repr) == sorted([(1, good), (None, good)], key=repr)


def test_quality_rules_on_rows_they_were_not_learned_from(spark):
    """Rules learned from four fifths of the labelled rows, judged on the last fifth: how many rejected rows are bad, and how many good ones are kept."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet").where("quality IS NOT NULL")
    rules = quality.fit(docs, labels.where("crc32(cast(doc_id AS string)) % 5 <> 0"))
    judged = quality.judge(docs, rules).join(labels.where("crc32(cast(doc_id AS string)) % 5 = 0"), "doc_id").select("quality", "kept", "base_failed").collect()
    good, bad = [r for r in judged if r["quality"] == 1], [r for r in judged if r["quality"] == 0]
    assert len(good) > 100 and len(bad) > 20
    assert sum(r["kept"] for r in good) / len(good) > 0.93
    assert sum(not r["kept"] for r in bad) / len(bad) > 0.8


def test_inclusion_frequencies_are_the_stated_ones(spark):
    """Over many salts, documents of each size are taken beyond their whole copies as often as their chance says, and the words meet the targets each time."""
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.choice([1, 2, 3, 6, 12, 25, 50, 100])), f"s{i % 3}") for i in range(1500)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()
    taken: Counter = Counter()
    stated: Counter = Counter()
    turns = 5
    for turn in range(turns):
        out = mixture.mix(table, salt=f"turn {turn}").collect()
        for r in out:
            key = (round(r["target"], 6), r["size"].bit_length())
            extra = r["copies"] - int(r["target"] // r["source_size"])
            taken[key] += extra
            stated[key] += r["chance"]
        for target in {r["target"] for r in out}:
            assert abs(sum(r["taken"] for r in out if r["target"] == target) - target) <= 100
    chances = {}
    for r in out:
        chances[round(r["target"], 6), r["size"].bit_length()] = r["chance"]
    assert len({round(c, 6) for c in chances.values() if 0 < c < 1}) > 5  # not one for a whole source
    for key, want in stated.items():
        n = want / max(chances[key], 1e-9) if chances[key] else 0
        error = 4 * (n * chances[key] * (1 - chances[key])) ** 0.5 + 0.02 * n
        assert abs(taken[key] - want) <= error + 1e-6, (key, taken[key], want)
    table.unpersist()


def test_places_of_sources_plainly(spark):
    names = [f"s{i:05d}" for i in range(3000)] + [None, "", "é", "Z"]
    random.Random(1).shuffle(names)
    got = {r["source"]: r["place"] for r in mixture.placed(spark.createDataFrame([(n, 1) for n in names], "source string, source_size long").repartition(7)).collect()}
    assert got == {n: i for i, n in enumerate(sorted(names, key=lambda n: (n is None, n or "")))}


def test_dots_and_twins_in_names_of_columns(spark, docs):
    """Columns of dotted names and of names that differ in case alone, for all operators and stages."""
    case = "spark.sql.caseSensitive"
    extra = docs.selectExpr("*", "1 AS `a.b`", "2 AS `text.x`", "3 AS `Text`", "4 AS `DOC_ID`", "5 AS `c0`")
    for name, job in jobs(spark).items():
        assert len(job(extra).collect()) == docs.count(), name
    for stage in (lambda d: quality.kept_rows(d, []), lines.without_dropped_lines, simhash.keep_one, mixture.mixed):
        assert stage(extra).columns == extra.columns
        assert stage(extra).count() == stage(docs).count()
    assert spark.conf.get(case) == "false"


def test_very_long_texts_go_through_every_operator(spark):
    """A text of over a megabyte with lines, one without any space, and a short one."""
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrst", k=rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(w + ("\n" if i % 40 == 39 else "") for i, w in enumerate(rng.choices(words, k=190_000)))
    blob = "".join(rng.choices("abcdefghijklmnop0123456789", k=1_100_000))
    table = spark.createDataFrame([(1, long, "en", "a"), (2, blob, "en", "a"), (3, "short", "en", "b")], "doc_id long, text string, lang string, source string")
    for name, job in jobs(spark).items():
        assert len(job(table).collect()) == 3, name


def test_operators_leave_the_session_alone(spark, docs):
    rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    built = [job(docs) for job in (secrets.scan_secrets, simhash.near_duplicates, tokenfiles.write_and_check)]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == rows
    assert all(len(b.collect()) == docs.count() for b in built)


def test_a_cluster_without_a_shared_folder_is_an_error(spark, monkeypatch):
    from exposark.llm import common

    class Context:
        master, applicationId = "spark://somewhere:7077", "app"

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session(), "x")
    assert spark.conf.get("spark.checkpoint.dir")
