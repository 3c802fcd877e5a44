"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a word exactly one token can be the last of its encoding. A suffix automaton of the vocabulary lists the tokens
that end at a prefix, the longest first; a token is the last one if it starts the word, or if it may follow the last token of the prefix before
it. Two tokens may stand beside each other if undoing their merges along the seam meets no merge that would have come first.
The last tokens are back-pointers: followed from the whole word, they give the ids that applying the merges in order gives.

Defined results: a null or empty text has no ids, and the digests of the empty string; repeated rows each get their own result.
Words of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import regex
from pyspark.sql import DataFrame

from exposark.llm.common import map_texts, sha256

END = "</w>"
#: Stands for END within this module, so that a symbol is one character.
MARK = ""
#: Words that a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Longer words are not remembered.
LONGEST_REMEMBERED = 64
LATIN = 0x180

# Letters and numbers that Unicode has from version 17 on. The regex library knows them, the tokenizers library does not yet.
NEW_LETTERS = "\\u0558\\u058b-\\u058c\\u088f\\u0c5c\\u0cdc\\u208f\\u209d-\\u209f\\ua7ce-\\ua7cf\\ua7d2\\ua7d4\\ua7dd\\ua7e2\\ua7f1\\uab6c-\\uab6d\\U000107bb-\\U000107bf\\U00010940-\\U00010959\\U00010ec5-\\U00010ec7\\U00010ed9-\\U00010eee\\U00011b0a\\U00011db0-\\U00011ddb\\U00011df1\\U00016ea0-\\U00016eb8\\U00016ebb-\\U00016ed3\\U00016ff2-\\U00016ff3\\U000187f8-\\U000187ff\\U00018cd6-\\U00018cda\\U00018d09-\\U00018d20\\U00018d80-\\U00018df2\\U00018e00-\\U00019191\\U000191a0-\\U000191d2\\U0001b123-\\U0001b128\\U0001b168\\U0001d6a6\\U0001df1f-\\U0001df24\\U0001df2b-\\U0001df81\\U0001df90-\\U0001df96\\U0001dfcd-\\U0001dfff\\U0001e6c0-\\U0001e6de\\U0001e6e0-\\U0001e6e2\\U0001e6e4-\\U0001e6e5\\U0001e6e7-\\U0001e6ed\\U0001e6f0-\\U0001e6f4\\U0001e6fe-\\U0001e6ff\\U0002b73a-\\U0002b73f\\U0002b81e\\U0002cea2-\\U0002cead\\U000323b0-\\U00033479\\U0003d000-\\U0003fc3f"
NEW_NUMBERS = "\\U00011de0-\\U00011de9\\U0001246f\\U00012475-\\U0001247f\\U00012550-\\U00012686\\U00016ff4-\\U00016ff6"
# Lower case of letters newer than Python's Unicode tables.
NEW_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
NEW_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def byte_symbols() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class SuffixAutomaton:
    """All substrings of a set of tokens; walked along a text, it lists the tokens that end at each place.

    A state stands for the substrings that end at the same places within the tokens. Its longest one has length[state] characters, and its
    link leads to the state of the longest suffix that ends at other places too. A token starts at a token's start, so nothing in its state
    is longer, and the tokens that are suffixes of it are its state's ancestors.
    """

    def __init__(self, tokens: dict[str, int]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        state = {"": 0}
        # by length, so that what a state stands for grows by one character at a time
        prefixes = sorted({t[:k] for t in tokens for k in range(1, len(t) + 1)}, key=lambda p: (len(p), p))
        for prefix in prefixes:
            state[prefix] = self._extended(state[prefix[:-1]], prefix[-1])
        own: list[tuple[int, int, bool] | None] = [None] * len(self.link)
        for token, value in tokens.items():
            own[state[token]] = (value, len(token) - token.endswith(MARK), token.endswith(MARK))
        #: By state: the tokens among its longest string's suffixes, the longest first; and those among shorter suffixes only.
        self.ending: list[tuple] = [()] * len(self.link)
        for v in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            above = self.ending[self.link[v]]
            self.ending[v] = above if own[v] is None else (own[v], *above)

    def _extended(self, last: int, symbol: str) -> int:
        """The state of the string of state last with one more symbol."""
        new = len(self.link)
        self.next.append({})
        self.length.append(self.length[last] + 1)
        self.link.append(0)
        at = last
        while at >= 0 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at >= 0:
            found = self.next[at][symbol]
            if self.length[found] > self.length[at] + 1:  # only its shorter strings end here as well: they get a state of their own
                whole, found = found, len(self.link)
                self.next.append(dict(self.next[whole]))
                self.length.append(self.length[at] + 1)
                self.link.append(self.link[whole])
                self.link[whole] = found
                while at >= 0 and self.next[at].get(symbol) == whole:
                    self.next[at][symbol] = found
                    at = self.link[at]
            self.link[new] = found
        return new

    def matches(self, text: str) -> Iterator[tuple[int, tuple]]:
        """For each place of a text, the tokens that end there, the longest first: (value, length without MARK, whether it has MARK)."""
        v, n = 0, 0
        for place, symbol in enumerate(text):
            while v and symbol not in self.next[v]:
                v = self.link[v]
                n = self.length[v]
            if symbol in self.next[v]:
                v, n = self.next[v][symbol], n + 1
            yield place, self.ending[v if n == self.length[v] else self.link[v]] if v else ()


class WordBpe:
    """The encoder and decoder of a vocabulary file whose words end with END, as the tokenizers library reads it."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != END or spec["decoder"] is not None:
            raise ValueError(f"{path}: a BPE vocabulary with {END} and no decoder is needed")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in [*self.ids.items(), *self.special.items()]}
        self.special_split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern).findall
        newest = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s[\p{{L}}--[{NEW_LETTERS}]][\p{{N}}--[{NEW_NUMBERS}]]]")
        newest = newest.replace(r"[\p{L}]", rf"[\p{{L}}--[{NEW_LETTERS}]]").replace(r"[\p{N}]", rf"[\p{{N}}--[{NEW_NUMBERS}]]")
        self.newest_words = regex.compile(newest, regex.V1).findall
        self.has_newest = regex.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}{''.join(map(chr, NEW_LOWER))}]").search
        letters = re.escape("".join(c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == "L"))
        digits = re.escape("".join(c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == "N"))
        # the same pattern for texts within Latin script, in the faster of the two libraries
        latin = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{digits}]").replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{digits}]")
        self.latin_words = self.words if r"\p" in latin else re.compile(latin).findall
        self.beyond_latin = re.compile(f"[^\x00-{chr(LATIN - 1)}\x1c-\x1f]|[\x1c-\x1f\x85]").search
        self.bytes = {chr(b): s for b, s in byte_symbols().items()}

        own = lambda token: token[: -len(END)] + MARK if token.endswith(END) and len(token) > len(END) else token
        #: By token (with MARK): its id, its rank (the order of its merge; symbols come first) and its halves.
        self.id_of = {own(t): i for t, i in self.ids.items()}
        self.rank = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        made = {own(a + b) if not b.endswith(END) else own(a) + own(b) for a, b in merges}
        symbols = [t for t in self.id_of if t not in made]
        self.rank = {t: k for k, t in enumerate(symbols)}
        for k, (a, b) in enumerate(merges, len(symbols)):
            self.rank.setdefault(own(a) + own(b), k)
            r = self.rank[own(a) + own(b)]
            self.halves.setdefault(r, (self.rank[own(a)], self.rank[own(b)]))
            self.merged.setdefault((self.rank[own(a)], self.rank[own(b)]), r)
        self.id_by_rank = {r: self.id_of[t] for t, r in self.rank.items()}
        self.automaton = SuffixAutomaton(self.rank)
        self.compatible: dict[int, bool] = {}
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def pair_holds(self, left: int, right: int) -> bool:
        """Whether no merge across the seam of two tokens (by rank) comes before the merges that made them."""
        a, b, limit, holds = left, right, float("inf"), None
        while holds is None:
            made = self.merged.get((a, b))
            if made is not None and made < limit:
                holds = False
            elif a > b:  # the later merge is undone first; a symbol has nothing to undo
                if a in self.halves:
                    limit, a = a, self.halves[a][1]
                elif b in self.halves:
                    limit, b = b + 1, self.halves[b][0]
                else:
                    holds = True
            elif b in self.halves:
                limit, b = b + 1, self.halves[b][0]
            elif a in self.halves:
                limit, a = a, self.halves[a][1]
            else:
                holds = True
        return holds

    def encode_word(self, word: str) -> list[int]:
        """The ids of one word, which has no white space."""
        symbols = word if word.isascii() and word.isprintable() else "".join(map(self.bytes.__getitem__, word.encode("utf-8", "surrogatepass").decode("latin-1")))
        n = len(symbols)
        last = [-1] * (n + 1)
        before = [0] * (n + 1)
        compatible = self.compatible
        if len(compatible) > 1_000_000:
            compatible.clear()
        for end, tokens in self.automaton.matches(symbols + MARK):
            for r, length, marked in tokens:
                at = end if marked else end + 1
                if at == n and not marked:  # the last symbol of a word is always one with MARK
                    continue
                start = at - length
                if start:
                    if last[start] < 0:
                        continue
                    pair = last[start] << 20 | r
                    holds = compatible.get(pair)
                    if holds is None:
                        holds = compatible[pair] = self.pair_holds(last[start], r)
                    if not holds:
                        continue
                last[at], before[at] = r, start
                break
        if n and last[n] < 0:
            raise ValueError("a symbol of the text is no token of the vocabulary")
        out = []
        while n > 0:
            out.append(self.id_by_rank[last[n]])
            n = before[n]
        return out[::-1]

    def split(self, text: str) -> list[str]:
        """The words of a text without special tokens, as normaliser and pre-tokeniser give them."""
        if not text.isascii() and not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        if "Σ" in text:
            text = text.replace("Σ", "σ")  # no final form: each character is lower-cased by itself
        if not self.beyond_latin(text):
            return self.latin_words(text.lower())
        if self.has_newest(text):
            return self.newest_words(text.translate(NEW_LOWER).lower())
        return self.words(text.lower())

    def pieces(self, text: str) -> list[tuple[str, str]]:
        """(ids, tokens) of each word as text, each joined by spaces."""
        out = []
        parts = self.special_split.split(text) if self.special_split is not None and any(x in text for x in self.special) else [text]
        for part in parts:
            if part in self.special:
                out.append((str(self.special[part]), part))
                continue
            words = self.split(part)
            found = list(map(self.young.get, words))
            if None in found:
                found = [self.remember(w) if f is None else f for w, f in zip(words, found, strict=True)]
            out += found
        return out

    def remember(self, word: str) -> tuple[str, str]:
        """(ids, tokens) of a word that the younger generation lacks; when that is full, it becomes the older one."""
        found = self.young.get(word) or self.old.get(word)
        if found is None:
            ids = self.encode_word(word)
            found = (" ".join(map(str, ids)), self.decode(ids))
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = found
        return found

    def encode(self, text: str) -> list[int]:
        return [int(x) for ids, _ in self.pieces(text) for x in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, as a vocabulary without a decoder reads; special tokens stay."""
        return " ".join(self.names[i] for i in ids)


_loaded: dict[str, WordBpe] = {}


def load(path: str) -> WordBpe:
    """The vocabulary of a file, loaded once in a worker."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, the ids joined by spaces and the decoded text, of each whole text."""
    path = vocabulary_path or default_path()

    def start() -> Callable[[str], tuple]:
        bpe = load(path)

        def one(text: str) -> tuple:
            pieces = bpe.pieces(text)
            ids = " ".join([p[0] for p in pieces])
            return (ids.count(" ") + 1 if ids else 0, ids, " ".join([p[1] for p in pieces]))

        return one

    return map_texts(docs, start, "n_tokens long, ids string, decoded string")


def encode_digests(docs: DataFrame, vocabulary_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, without moving either out of the worker."""
    path = vocabulary_path or default_path()

    def start() -> Callable[[str], tuple]:
        bpe = load(path)

        def one(text: str) -> tuple:
            pieces = bpe.pieces(text)
            ids = " ".join([p[0] for p in pieces])
            return (ids.count(" ") + 1 if ids else 0, sha256(ids), sha256(" ".join([p[1] for p in pieces])))

        return one

    return map_texts(docs, start, "n_tokens long, ids_sha256 string, decoded_sha256 string")
