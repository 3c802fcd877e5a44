"""HTML extraction, importance resampling and phrase mining: against brute force, written-out results and awkward tables."""

from __future__ import annotations

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from exposark.llm import importance, pagetext, phrases

LOWER = str.maketrans(importance.UPPER, importance.LOWER)


@pytest.fixture(scope="module")
def weights():
    return pagetext.default_weights()


CASES = {
    "long comments after the article, its own header and footer": (
        '<body><nav>m</nav><article><header><h1>Big title</h1><p class="byline">by X</p></header><p>Some text &eacute;t&eacute; here&nbsp;and <a href=x>a link</a> more.<p>Second <b>par</b>a.<div class="ad">Buy</div><p>Third one is here.<footer>tags</footer></article>'
        '<section id="comments"><h2>Comments</h2><article class="comment"><p>' + "I do not agree at all. " * 40 + "</p></article></section>",
        "Big title\nSome text été here and a link more.\nSecond para.\nThird one is here.",
    ),
    "capitals, no quotes, no end tags": (
        "<HTML><BODY><DIV ID=sidebar>side text goes here with words</DIV><DIV CLASS=content><H1>Title</H1><P>Real text of the page, long enough.</P><BLOCKQUOTE>A quote</BLOCKQUOTE><UL><LI>one item<LI>two items</UL></DIV><DIV id=footer>foot</DIV>",
        "Title\nReal text of the page, long enough.\nA quote\none item\ntwo items",
    ),
    "a layout class that names a sidebar": ('<div class="page with-sidebar"><div id="main"><h1>T one</h1><p>Alpha beta gamma delta.</p></div><div class="sidebar"><p>x y z</p></div></div>', "T one\nAlpha beta gamma delta."),
    "notice, form and related links around and in the text": (
        '<body><header><h1>Site</h1></header><div class="cookie-banner"><p>We use cookies.</p><button>Accept</button></div><main><h2>Story</h2><p>Line one<br>line two.</p><form><input>Subscribe</form><p>End of story.</p><h3>Related articles</h3><ul><li><a>Other</a></li></ul></main><footer>© 2024</footer>',
        "Story\nLine one line two.\nEnd of story.",
    ),
    "a menu and nothing else": ("<nav><ul><li><a href=/>Home</a></ul></nav><footer>c</footer>", ""),
    "a form around all": ('<form id="aspnetForm"><div><article><h1>Form page</h1><p>Text within a form wrapper.</p></article></div></form>', "Form page\nText within a form wrapper."),
    "no layout at all": ("<p>Just a plain page with a paragraph.</p>", "Just a plain page with a paragraph."),
    "no tags": ("just words", "just words"),
    "one word": ("<article><p>w</p></article>", "w"),
    "not shown": ('<p hidden>secret words here now</p><article><p style="display: none">no</p><p>Shown text.</p><noscript>enable js</noscript></article>', "Shown text."),
    "a menu that never ends": ("<nav>menu one two <article><h1>Unclosed nav</h1><p>Article after an unclosed nav.</p></article>", "Unclosed nav\nArticle after an unclosed nav."),
    "references": ("<article>a &lt;b&gt; &amp;amp; c &#x41;&#66; &copy &unknown; 3 < 4 text</article>", "a <b> &amp; c AB © &unknown; 3 < 4 text"),
    "signs in values, comments and scripts": ("<article><p title=\"a>b\">x one</p><!-- c > d --><script>var t='</p>';if (a<b) {}</script><p data-x='>'>y two</p></article>", "x one\ny two"),
    "no body": ("<head><title>t</title><p>No body or head end, text goes on.</p>", "No body or head end, text goes on."),
    "all rights inside and outside": ("<article><h1>On law</h1><p>All rights reserved.</p></article><p>© A. All rights reserved.</p>", "On law\nAll rights reserved."),
    "a long aside between the halves": ("<article><p>First half of it.</p><aside>" + "<p>quite another matter</p>" * 60 + "</aside><p>Second half of it.</p></article>", "First half of it.\nSecond half of it."),
}


@pytest.mark.parametrize("name", CASES)
def test_pages_written_out(weights, name):
    page, text = CASES[name]
    assert pagetext.extract(page, weights) == text


def test_layouts_that_no_weight_was_learned_from(weights):
    missed = added = wanted = exact = 0
    pages = list(pagetext.labelled_pages(300, seed=99))
    for page, text in pages:
        got, want = Counter(pagetext.extract(page, weights).split()), Counter(text.split())
        missed, added, wanted, exact = missed + (want - got).total(), added + (got - want).total(), wanted + want.total(), exact + (got == want)
    assert missed < 0.002 * wanted and added < 0.005 * wanted and exact > 0.88 * len(pages)


def test_weights_have_the_signs_of_the_method(weights):
    assert min(weights[: pagetext.N_WORDS]) >= 0 and max(weights[pagetext.N_WORDS :]) <= 0


@given(st.lists(st.integers(-5, 5).map(float), max_size=12))
@settings(max_examples=200, deadline=None)
def test_best_run_plainly(scores):
    first, last = pagetext.best_run(scores)
    runs = [(sum(scores[a:b]), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)]
    best = max([r[0] for r in runs], default=0)
    assert (first, last) == (0, 0) if best <= 0 else sum(scores[first:last]) == best


@pytest.mark.parametrize("unit", ["<script>", "<b>", "<div>", "<p>a", "</x>", "<div><p>", '<a b="', "<", "<!--", "<nav>", "<a><li>", "<span class=ad>", "<article><header>", "<h2>Comments</h2><p>x"])
def test_awkward_pages_take_time_in_proportion(weights, unit):
    def took(n):
        began = time.process_time()
        pagetext.extract(unit * n + "x", weights)
        return time.process_time() - began

    took(20_000)
    assert took(80_000) < 8 * took(20_000) + 0.5


def test_attributes_take_time_in_proportion(weights):
    for unit in ("a ", "a= ", "a='\""):
        began = time.process_time()
        pagetext.extract("<p " + unit * 200_000 + ">x", weights)
        assert time.process_time() - began < 5


def test_pages_as_a_job(spark, weights):
    rows = [(1, "u", CASES["references"][0], "x"), (1, "u", CASES["references"][0], "x"), (2, None, None, None), (None, "v", "", "y"), (3, "w", "<article><p>" + "long " * 300_000 + "</p></article>", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = pagetext.main_text(pages.toDF("page_id", "url", "html", "a.text")).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", r["n_chars"]) for r in out) == sorted([(1, "u", 39), (1, "u", 39), (2, "", 0), (0, "v", 0), (3, "w", 1_499_999)])
    assert pagetext.main_text(pages.limit(0)).collect() == []


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_resample(docs, target):
    s, t = Counter(b for _, x in docs for b in plain_features(x)[1]), Counter(b for x in target for b in plain_features(x)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    rows = []
    for i, x in docs:
        words, found = plain_features(x)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append((len(words) >= 20, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), -math.inf if i is None else i, len(found), weight))
    drawn = sorted((r for r in rows if r[0]), key=lambda r: (-r[1], r[2], r[3], r[4]))
    return rows, drawn[: 5 * len(drawn) // 100]


def test_resampling_plainly(spark, docs, empty):
    rng = np.random.default_rng(3)
    made = [(i, " ".join(rng.choice(["alpha", "Beta", "gamma9", "日本", "delta's"], 25))) for i in range(200)]
    made += [(i, "the same text of twenty words that many rows have " * 2) for i in range(200, 300)] + [made[5], (7, "another text of one id " * 5)] + [(r["doc_id"], r["text"]) for r in docs.collect()]
    target = ["beta gamma9 beta", None, "日本 the same text"]
    corpus = spark.createDataFrame(made, "doc_id long, text string").withColumn("n_features", F.lit("x")).withColumn("a.b", F.lit(1))
    out = importance.resample(corpus, spark.createDataFrame([(x,) for x in target], "text string")).collect()
    rows, drawn = plain_resample(made, target)
    place = lambda i: -math.inf if i is None else i
    assert Counter((r["n_words"] >= 20, r["score"], place(r["doc_id"]), r["n_features"], r["weight"]) for r in out) == Counter(rows)
    ranked = sorted((r["rank"], r["score"], place(r["doc_id"])) for r in out if r["rank"] is not None)
    assert ranked == [(k, r[1], r[2]) for k, r in enumerate(drawn, 1)] and len(drawn) == 15
    assert importance.resample(empty, empty).collect() == []
    assert {r["weight"] for r in importance.resample(docs.where("doc_id = 1"), empty).collect()} == {0}


def plain_phrases(rows):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    for (lang, *words), a in f.items():
        if len(words) < 2 or a < 10 or any(len(p) == 4 and c >= 10 and p[0] == lang and 100 * c >= 50 * a and list(p[1:]) != words and (list(p[1:3]) == words or list(p[2:4]) == words) for p, c in (f.items() if len(words) == 2 else ())):
            continue
        score, k = min((1000000 * a * a // (f[lang, *words[:k]] * f[lang, *words[k:]]), k) for k in range(1, len(words)))
        out.append((lang, -score, -a, " ".join(words).encode(), f[lang, *words[:k]], f[lang, *words[k:]]))
    out.sort()
    ranks = Counter()
    return [(lang, ranks.update([lang]) or ranks[lang], phrase.decode(), -a, l, r, n[lang], -score) for lang, score, a, phrase, l, r in out]


@pytest.fixture(scope="module")
def talk(spark):
    rng = np.random.default_rng(5)
    words = [*"the of a New YORK city = ß 日本 x\x0by it's".split(" "), "\x85", "a\xa0b"]
    rows = [(("en", "de", None, "und")[i % 4], "".join(w + s for w, s in zip(rng.choice(words, 60), rng.choice([" ", "  ", "\t", ", ", ".", "\n", "\r\n", " \t "], 60), strict=True))) for i in range(300)]
    rows += [("en", None), (None, ""), ("fr", "New York New York New York. " * 20), ("fr", "New York New York New York. " * 20), ("en", "long " * 50_000)]
    return rows, spark.createDataFrame(rows, "lang string, text string").repartition(7)


@pytest.mark.parametrize("cells", [None, 1 << 16])
def test_phrases_plainly(talk, cells):
    rows, table = talk
    out = phrases.collocations(table.withColumn("phrase", F.lit(1)).withColumn("a.b", F.lit(2)), cells=cells)
    assert sorted(tuple(r) for r in out.collect()) == plain_phrases(rows)


def test_first_phrases_only_and_empty_tables(talk):
    rows, table = talk
    assert sorted(tuple(r) for r in phrases.collocations(table, top=3).collect()) == [r for r in plain_phrases(rows) if r[1] <= 3]
    assert phrases.collocations(table.limit(0)).collect() == []


def test_a_full_sketch_lets_all_pass_and_loses_nothing(talk, monkeypatch):
    """With as many cells as the sketch has blocks times eight, nearly every cell is full: only the exact count is left to sort out."""
    rows, table = talk
    out = phrases.collocations(table, cells=phrases.BLOCKS * 8)
    assert sorted(tuple(r) for r in out.collect()) == plain_phrases(rows)


@given(st.lists(st.integers(0, 2**28 - 1), max_size=50, unique=True).map(sorted))
@settings(max_examples=100, deadline=None)
def test_cells_pack_and_unpack(offsets):
    counts = np.array([1 + k % 10 for k in range(len(offsets))], np.uint8)
    back, n = phrases._unpacked(phrases._packed(np.array(offsets, np.uint32), counts))
    assert back.tolist() == offsets and n.tolist() == counts.tolist()


def test_many_small_partial_sketches_add_up(talk, monkeypatch):
    rows, table = talk
    monkeypatch.setattr(phrases, "PENDING", 100)
    monkeypatch.setattr(phrases, "PIECE_BYTES", 500)
    assert sorted(tuple(r) for r in phrases.collocations(table).collect()) == plain_phrases(rows)


@given(st.lists(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10)), max_size=20), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_cells_are_added_up(parts):
    want = Counter()
    for part in parts:
        for cell, n in part:
            want[cell] += n
    made = phrases._added([np.array([c * 16 + n for c, n in part], np.uint32) for part in parts])
    assert [(int(x) >> 4, int(x) & 15) for x in made] == sorted((c, min(n, 10)) for c, n in want.items())


def test_counts_are_exact_beyond_64_bits(spark):
    counts = spark.createDataFrame([("en", "a", 1, 9 * 10**15), ("en", "b", 1, 8 * 10**15), ("en", "a b", 2, 7 * 10**15)], "lang string, phrase string, words int, f long")
    row = phrases.scored(phrases.unsubsumed(counts), counts).first()
    assert row["score"] == 1000000 * (7 * 10**15) ** 2 // (9 * 10**15 * 8 * 10**15)


def test_adding_up_takes_little_beside_what_is_held(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(phrases, "map_batches", lambda rows, run, schema: run)
    deal = np.random.default_rng(5)
    texts = ["".join(f"{w:x} " for w in deal.integers(0, 1 << 20, 20_000).tolist()) for _ in range(30)]
    batches = [pa.RecordBatch.from_pydict({"lang": pa.array(["en"]), "text": pa.array([t])}) for t in texts]
    tracemalloc.start()
    made = sum(b.num_rows for b in phrases.sketched(None, 1 << 24)(iter(batches)))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == 2 * phrases.BLOCKS
    assert most < 40e6  # two rows of 1.8 million cells are 14 MB
