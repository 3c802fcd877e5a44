"""The operators that see one text at a time, against plain versions of their definitions."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from exposark.llm import bpe, pii, quality, secrets, textcnn, tokenfiles, webp
from exposark.llm.common import span_text

from .conftest import TEXTS

texts = st.text(st.one_of(st.sampled_from("aeiou nrst.,\n\t@+-0123456789AKIA=:\"'éßΣ<|>"), st.characters(codec="utf-8")), max_size=120)


# secrets and personal data


def base_spans_plainly(text: str, patterns) -> str:
    out = [(m.start(), k, m.end(), kind) for k, (kind, p, good) in enumerate(patterns) for m in re.finditer(p, text) if good(m)]
    return span_text(out)


SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
    ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
)
PERSONAL = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m[0].split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[^0-9]", "", m[0])) <= 19 and pii.luhn(re.sub("[^0-9]", "", m[0]))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15),
)
PIECES = st.lists(st.sampled_from(["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "4532015112830366", "4532 0151 1283 0366", "+1 (523) 555-7040", "+", "-", ".", " ", "7", "é", "token = ", "secret:'", "abcd1234", "AKIA", "ABCDEF0123456789", "0b96a8c8d79c4a5085c919698889f59b72ab7bb6", "PassWord", "=", "api_key"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES)
def test_base_spans(text):
    encoding = secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert span_text([s for s in secrets.find_secrets(text, encoding) if s[1] < 3]) == base_spans_plainly(text, SECRETS)
    assert span_text(pii.base_spans(text)) == base_spans_plainly(text, PERSONAL)


def test_random_keys_are_found_and_identifiers_are_not():
    encoding = secrets.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert secrets.looks_random("x9Kq2vLp7Zt4Rw8Bn3Yc6Hd1", encoding)
    for known in ("d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "some_long_function_name_v2", "1234567890123456789012345"):
        assert not secrets.looks_random(known, encoding)


@pytest.fixture(scope="module")
def field():
    return pii.fit()


def test_random_field_on_held_out_sentences(field):
    import random

    rng = random.Random(99)
    right = wrong = there = 0
    for _ in range(150):
        text, tokens, gold = pii.example(rng)
        want = {(*pii.trimmed(text, tokens[a][0], tokens[b - 1][1]), k) for a, b, k in gold if k}
        got = set(field.decode(text, 0, len(text)))
        right, wrong, there = right + len(want & got), wrong + len(got - want), there + len(want)
    assert right / there > 0.6
    assert right / max(1, right + wrong) > 0.95


def test_random_field_likelihood_is_a_probability(field):
    text, tokens = "to 4532015112830366 now", [(0, 2), (3, 19), (20, 23)]
    cells = field.segments(text, tokens)
    total = pii._log_sum(field.forward(cells, best=False)[0][-1])
    assert abs(total - field.backward(cells)[0][0]) < 1e-6


# byte pairs


@pytest.fixture(scope="module")
def word_bpe():
    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    return library, bpe.load(bpe.default_path())


@given(st.lists(st.text("abc", min_size=1, max_size=5), min_size=1, max_size=12, unique=True), st.text("abcd", max_size=30))
@settings(max_examples=200, deadline=None)
def test_automaton_lists_the_tokens_at_each_place(tokens, text):
    automaton = bpe.SuffixAutomaton({t: i for i, t in enumerate(tokens)})
    plainly = [[t for t in sorted(tokens, key=len, reverse=True) if text[: k + 1].endswith(t)] for k in range(len(text))]
    assert [[tokens[x[0]] for x in found] for _, found in automaton.matches(text)] == plainly


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("aeioublethn'sredmvl .,-!?0123é<|endoftext|>ßΣ\n"), max_size=80))
def test_bpe_is_the_library(text):
    library, own = Tokenizer.from_file(bpe.default_path()), bpe.load(bpe.default_path())
    ids = library.encode(text, add_special_tokens=False).ids
    assert own.encode(text) == ids
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [t or "" for t in TEXTS] + ["x" * 3000])
def test_bpe_on_awkward_texts(word_bpe, text):
    library, own = word_bpe
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


# quality


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n#\t"), max_size=60))
def test_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    repeated = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if x in lines[:i] and re.search(r"[^\x20\x09-\x0D]", x))
    got = dict(zip(quality.STATS, quality.text_stats(text), strict=True))
    assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"]) == (len(words), sum(map(len, words)), text.count("#"), dup, len(repeated))


def test_rules_are_found_and_are_precise():
    rng = np.random.default_rng(3)
    table = {"a": rng.random(2000), "b": rng.random(2000)}
    bad = (table["a"] > 0.8) & (table["b"] <= 0.5) | (table["a"] < 0.05)
    rules = quality.learn(table, bad, np.arange(2000) % 3 != 0)
    covered = np.zeros(2000, bool)
    for rule in rules:
        covered |= quality.covers(rule, table, 2000)
    assert (covered & bad).sum() > 0.9 * bad.sum()
    assert (covered & ~bad).sum() < 0.02 * (~bad).sum()
    assert quality.learn(table, np.zeros(2000, bool), np.arange(2000) % 3 != 0) == []


# lossless WebP


@settings(max_examples=100, deadline=None)
@given(texts)
def test_media_round_trip(text):
    n, data, back = webp.media(text)
    raw = text.encode("utf-8", "surrogatepass")
    assert back[:n] == raw and not any(back[n:]) and len(back) % 64 == 0 and len(back) >= 64 and len(back) - n <= 64


def general_file(pixels: np.ndarray, transforms: list[str], cache_bits: int = 0, repeats: bool = False) -> bytes:
    """A writer for the tests that uses the parts of the format that the production writer does not need."""
    height, width = pixels.shape
    out = webp.Writer()
    webp.header(out, width, height)
    flat, wide = pixels.reshape(-1).astype(np.uint32), width
    todo = []
    for name in transforms:
        out.write(1, 1)
        if name == "green":
            out.write(webp.SUBTRACT_GREEN, 2)
            flat = webp.green_shift(flat, -1)
        elif name == "cross":
            sub = webp._subsampled(wide, 2) * webp._subsampled(height, 2)
            elements = (np.arange(sub, dtype=np.uint32) * 0x1F3B5 & 0xFFFFFF) | np.uint32(0xFF000000)
            out.write(webp.CROSS, 2)
            out.write(0, 3)
            image(out, elements, webp._subsampled(wide, 2), False)
            flat = webp.cross_colour(flat, wide, elements, 2, -1)
        elif name.startswith("predict"):
            mode = int(name[7:])
            sub = webp._subsampled(wide, 2) * webp._subsampled(height, 2)
            modes = np.full(sub, 0xFF000000 | mode << 8, np.uint32)
            out.write(webp.PREDICT, 2)
            out.write(0, 3)
            image(out, modes, webp._subsampled(wide, 2), False)
            p = flat.tolist()
            guess = []
            for at in range(len(p)):
                x, y = at % wide, at // wide
                guess.append(0xFF000000 if at == 0 else p[at - 1] if y == 0 else p[at - wide] if x == 0 else webp.predicted(mode, p[at - 1], p[at - wide], p[at - wide + 1], p[at - wide - 1]))
            minus = lambda a, b: sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))
            flat = np.array([minus(a, b) for a, b in zip(p, guess, strict=True)], np.uint32)
        elif name == "palette":
            colours = np.unique(flat)
            out.write(webp.PALETTE, 2)
            out.write(len(colours) - 1, 8)
            minus = lambda a, b: sum(((a >> s & 255) - (b >> s & 255) & 255) << s for s in (0, 8, 16, 24))
            image(out, np.array([minus(int(c), int(colours[i - 1]) if i else 0) for i, c in enumerate(colours)], np.uint32), len(colours), False)
            index = np.searchsorted(colours, flat).reshape(height, wide)
            bits = webp._packing(len(colours))
            wide = webp._subsampled(wide, bits)
            packed = np.zeros((height, wide), np.uint32)
            for x in range(index.shape[1]):
                packed[:, x >> bits] |= index[:, x].astype(np.uint32) << np.uint32((x & (1 << bits) - 1) * (8 >> bits))
            flat = packed.reshape(-1) << np.uint32(8) | np.uint32(0xFF000000)
        todo.append(name)
    out.write(0, 1)
    image(out, flat, wide, True, cache_bits, repeats)
    return webp.container(out.bytes())


def image(out: webp.Writer, pixels: np.ndarray, width: int, main: bool, cache_bits: int = 0, repeats: bool = False) -> None:
    out.write(int(cache_bits > 0), 1)
    if cache_bits:
        out.write(cache_bits, 4)
    if main:
        out.write(0, 1)
    p = pixels.tolist()
    symbols: list[tuple[int, int, int]] = []  # (channel, symbol, extra with its bits after it)
    cache: dict[int, int] = {}
    key = lambda x: (0x1E35A7BD * x & 0xFFFFFFFF) >> (32 - cache_bits)
    at = 0
    while at < len(p):
        run = 0
        if repeats and at:
            while at + run < len(p) and run < 4 and p[at + run] == p[at + run - 1]:
                run += 1
        if run >= 2:
            symbols += [(0, 256 + run - 1, -1), (4, 1, -1)]  # distance code 2: the pixel to the left
            step = run
        elif cache_bits and cache.get(key(p[at])) == p[at]:
            symbols.append((0, 280 + key(p[at]), -1))
            step = 1
        else:
            x = p[at]
            symbols += [(0, x >> 8 & 255, -1), (1, x >> 16 & 255, -1), (2, x & 255, -1), (3, x >> 24, -1)]
            step = 1
        if cache_bits:
            for x in p[at : at + step]:
                cache[key(x)] = x
        at += step
    sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
    tables = []
    for c in range(5):
        counts: dict[int, int] = {}
        for k, s, _ in symbols:
            if k == c:
                counts[s] = counts.get(s, 0) + 1
        if len(counts) > 1:
            lengths = webp.code_lengths(counts)
            full = [lengths.get(s, 0) for s in range(sizes[c])]
        else:
            full = [int(s in counts or not counts and s == 0) for s in range(sizes[c])]
        if sum(x > 0 for x in full) == 1 and full.index(1) > 255:  # a lone large symbol takes a normal code of two
            full[0] = 1
        out.parts.append(webp.code_text(full))
        tables.append((full, webp.code_words(full), sum(x > 0 for x in full)))
    for c, s, _ in symbols:
        full, words, n = tables[c]
        if n > 1:
            out.write(words[s], full[s])


@pytest.mark.parametrize("transforms", [[], ["green"], ["cross"], *[[f"predict{m}"] for m in range(14)], ["palette"], ["predict11", "cross", "green"]])
@pytest.mark.parametrize(("cache_bits", "repeats"), [(0, False), (3, True)])
def test_reader_inverts_everything(transforms, cache_bits, repeats):
    rng = np.random.default_rng(5)
    few = rng.integers(0, 1 << 32, 3, dtype=np.uint32)
    pixels = few[rng.integers(0, 3, (7, 9))] if "palette" in transforms else rng.integers(0, 1 << 32, (7, 9), dtype=np.uint32)
    pixels[2:4] = pixels[2, 0]
    assert (webp.decode(general_file(pixels, transforms, cache_bits, repeats)) == pixels).all()


def test_damaged_files_are_refused():
    with pytest.raises(ValueError):
        webp.decode(b"RIFF")
    with pytest.raises(ValueError):
        webp.read_payload(webp.store(b"abc" * 64)[:-8])  # a file of this payload has under 60 bytes
    with pytest.raises(ValueError):
        webp.read_payload(webp.store(bytes(range(64)) * 3)[:60])


# token files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 131071), st.integers(0, 5)), max_size=300), st.integers(1, 70))
def test_ids_round_trip(ids, block):
    assert tokenfiles.decode_ids(tokenfiles.encode_ids(np.array(ids, np.int64), block)).tolist() == ids


def test_blocks_are_checked_and_smaller_than_plain():
    ids = np.tile(np.arange(50, dtype=np.int64), 400)
    data = tokenfiles.encode_ids(ids)
    assert len(data) < len(ids)
    damaged = bytearray(data)
    damaged[40] ^= 1
    with pytest.raises(ValueError):
        tokenfiles.decode_ids(bytes(damaged))


def test_blocks_are_smaller_than_by_deflate():
    import pyarrow.parquet as pq

    tokens = tokenfiles.load(tokenfiles.default_path())
    documents = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    ids = np.frombuffer(b"".join(tokens.encode(t or "") for t in documents), "<u4")
    plain = sum(len(zlib.compress(ids[i : i + tokenfiles.BLOCK].astype("<u2").tobytes(), 9)) for i in range(0, len(ids), tokenfiles.BLOCK))
    data = tokenfiles.encode_ids(ids)
    assert (tokenfiles.decode_ids(data) == ids).all()
    assert len(data) < 0.7 * plain
    assert len(data) < 0.9 * len(ids)


def test_each_block_is_coded_for_itself():
    """A block's bytes depend on its own ids and the distribution alone, and one damaged block does not hide behind another."""
    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(0, 40, 64) for _ in range(3))
    one, two = tokenfiles.encode_ids(np.concatenate((a, b, c, a, b)), 64), tokenfiles.encode_ids(np.concatenate((a, b, c, a, b)), 64)
    assert one == two
    for at in range(0, len(one), 7):
        damaged = bytearray(one)
        damaged[at] ^= 0x5A
        with pytest.raises((ValueError, zlib.error)):
            tokenfiles.decode_ids(bytes(damaged))
    for cut in (1, 5, len(one) // 2, len(one) - 1):
        with pytest.raises(ValueError):
            tokenfiles.decode_ids(one[:cut])


@pytest.mark.parametrize("text", [" ", "  ", "a", " a", "a ", "a  b", "a b ", "a b  ", "\na b", "a\nb c\n", "a \nb", "a\n b", "a\tb c", "it's we'll 'd x", "é à ß ñ, ü", "a\u00a0 b", "中 文", "a,b c.d (e) f", "<|endoftext|> a b", "x" * 300 + " y"])
def test_words_are_the_library(text):
    tokens = tokenfiles.load(tokenfiles.default_path())
    for _ in range(2):
        assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokens.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab '.,1\n\té<|"), max_size=40))
def test_parted_texts_are_the_library(text):
    tokens = tokenfiles.load(tokenfiles.default_path())
    assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokens.library.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(texts)
def test_pieces_are_the_library(text):
    tokens = tokenfiles.load(tokenfiles.default_path())
    assert np.frombuffer(tokens.encode(text), "<u4").tolist() == tokens.library.encode(text, add_special_tokens=False).ids


def test_letters_of_a_word_go_to_the_library_once():
    tokens = tokenfiles.Tokens(tokenfiles.default_path())
    text, asked, ask = "x zqwordlet zqwordlet, zqwordlet$$$ zqwordlet.%%% zqwordlet'll zqwordlet7", [], tokens.tokenize

    def counted(symbols):
        asked.append(symbols)
        return ask(symbols)

    tokens.tokenize = counted
    ids = np.frombuffer(tokens.encode(text), "<u4").tolist()
    assert ids == tokens.library.encode(text, add_special_tokens=False).ids
    assert sum("zqwordlet" in symbols for symbols in asked) == 1


def test_texts_of_a_batch_are_the_library_each():
    tokens = tokenfiles.load(tokenfiles.default_path())
    some = ["", "a b", "a", " a b", "über größe, ab", "<|endoftext|> a", "中 文", "b a$$$ b.,!", "a\nb c\n", "a\n\nb.\n\nc", "a b ", "x" * 300 + " y", "a b"]
    for texts in (some, some[::-1], [""], []):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokens.encode_all(texts)] == [tokens.library.encode(t, add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("kinds", [300, (1 << 14) - 1, 1 << 14, 70_000])
def test_ids_of_few_and_many_kinds_round_trip(kinds):
    """What the models have seen is kept in 16 bits up to some number of different ids, pairs of ids in 32."""
    ids = np.random.default_rng(kinds).permutation(np.arange(2 * kinds) % kinds)
    assert (tokenfiles.decode_ids(tokenfiles.encode_ids(ids, 256)) == ids).all()


# toxicity


def test_classifier_learns_words_and_prefixes():
    rng = np.random.default_rng(2)
    known = textcnn.Buckets()
    words = ["plain", "words", "of", "no", "harm", "at", "all", "here"]
    made, labels = [], []
    for i in range(500):
        t = rng.choice(words, 30).tolist()
        if i % 5 == 0:
            t[int(rng.integers(30))] = ["nasty", f"vilex{chr(97 + i % 26)}"][i % 2]
        made.append(textcnn.word_buckets(" ".join(t), known))
        labels.append(float(i % 5 == 0))
    model = textcnn.train(made[:400], np.array(labels[:400], np.float32))
    got = model.scores(made[400:])
    assert ((got >= 0.5) == (np.array(labels[400:]) == 1)).mean() > 0.95
    assert 0 <= float(model.scores([textcnn.word_buckets("", known)])[0]) < 0.5
    assert (textcnn.train([], np.zeros(0, np.float32)).scores([textcnn.word_buckets("x", known)]) < 0.5).all()


def test_thresholds():
    assert 0.2 < textcnn.calibrated(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) < 0.8
    assert textcnn.calibrated(np.array([0.1]), np.array([0])) == 0.5
    assert zlib.crc32(b"1") % 5 == 3 and hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_pooling_plainly(monkeypatch):
    """Each filter's largest response by loops over all places, for texts that are laid end to end and for one that is read in pieces."""
    rng = np.random.default_rng(7)
    model = textcnn.TextCnn.fresh(3)
    made = [rng.integers(0, textcnn.BUCKETS, (n, 2)).astype(np.int32) for n in (0, 1, 2, 5, 40)]

    def plainly(text):
        vectors = [model.table[a] + model.table[b] for a, b in text] + [np.zeros(textcnn.DIMENSIONS, np.float32)] * max(textcnn.WIDTHS)
        out = []
        for kernel, bias in zip(model.kernels, model.biases, strict=True):
            places = [sum(vectors[i + k] @ kernel[k] for k in range(len(kernel)) if i + k < len(vectors)) + bias for i in range(len(vectors))]
            out.append(np.maximum(np.max(places, axis=0), 0))
        return np.concatenate(out)

    pools = model.pooled(*textcnn.laid_out(made))[0]
    for text, pool in zip(made, pools, strict=True):
        assert np.allclose(pool, plainly(text), atol=1e-5)
    whole = model.scores(made)
    for piece in (1, 3, 7, 39):
        monkeypatch.setattr(textcnn, "PIECE", piece)
        assert np.allclose(model.scores(made), whole, atol=1e-6)


def test_thresholds_are_set_on_rows_that_trained_nothing():
    apart = [i for i in range(6000) if textcnn.is_calibration(i)]
    assert 800 < len(apart) < 1200
