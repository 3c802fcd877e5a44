"""Secret scan: patterns for labelled credentials, access keys and hex digests, and a token-efficiency test for the rest.

A random string costs a byte-pair vocabulary far more tokens a character than words do. So each long run of key characters
that the patterns have not taken is encoded with a public vocabulary; a run with few characters a token, which is no known
digest, UUID, plain number or name of joined pieces, is a secret. Where words joined to a key hide it, neighbouring segments between
the characters / _ - = are judged for themselves.

Defined results: a null or empty text has no spans; repeated rows each get their own; matches of one kind never overlap.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from exposark.llm.common import map_texts, sha256, span_text

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "random")

#: What the token-efficiency test looks at: long runs of the characters that keys are written in.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Lengths of hex digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512); those and UUIDs are identifiers, not secrets.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"(?<![0-9a-fA-F])[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}(?![0-9a-fA-F])")
SEGMENT = re.compile(r"[A-Za-z0-9+]+")
LETTER = re.compile(r"[A-Za-z]")
#: A name of at least two pieces of under 20 letters, each of one case or capitalised, with a number of up to 4 digits.
NAME = re.compile(r"(?:(?:[A-Z]?[a-z]{0,18}|[A-Z]{1,19})[0-9]{0,4}[_/=-]+)+(?:[A-Z]?[a-z]{0,18}|[A-Z]{1,19})[0-9]{0,4}")
HEX_ANY = re.compile(r"[0-9a-fA-F]+")
MAX_CHARS_PER_TOKEN = 1.9
LONGEST = 4096
SHORTEST = 20

_vocabularies: dict = {}


def vocabulary(path: str):
    """The tiktoken encoding of a file of ranks, loaded once in a worker."""
    if path not in _vocabularies:
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _vocabularies[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _vocabularies[path]


def _tokens(run: str, encoding) -> int:
    # A very long run (an inlined file, say) is judged piece by piece, so that no encoding of it is quadratic; all pieces count.
    return sum(len(encoding.encode_ordinary(run[i : i + LONGEST])) for i in range(0, len(run), LONGEST))


def _is_digest(run: str) -> bool:
    return len(run) in DIGEST_LENGTHS and HEX_ANY.fullmatch(run) is not None


def _costly(run: str, encoding, most: float) -> bool:
    return LETTER.search(run) is not None and not NAME.fullmatch(run) and len(run) < most * _tokens(run, encoding)


def _windows(scores: list[float]) -> list[tuple[int, int]]:
    """All maximal windows of the highest sum, in linear time: disjoint, none can be lengthened or joined to the next for a higher sum."""
    found: list[tuple[int, int, float, float]] = []  # first, last + 1, sum before, sum at the end
    total = 0.0
    for k, x in enumerate(scores):
        if x > 0:
            first, before, after = k, total, total + x
            while found and (found[-1][2] >= before or found[-1][3] < after):
                if found[-1][2] >= before:
                    # an earlier window that starts no lower can never be joined; those below it may
                    j = len(found) - 1
                    while j >= 0 and found[j][2] >= before:
                        j -= 1
                    if j < 0 or found[j][3] >= after:
                        break
                    del found[j + 1 :]
                first, _, before, _ = found.pop()
            found.append((first, k + 1, before, after))
        total += x
    return [(a, b) for a, b, _, _ in found]


def random_spans(run: str, encoding, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int]]:
    """Where a run is random: all of it, or else neighbouring segments; UUIDs and digests never are."""
    if len(run) < SHORTEST or _is_digest(run):
        return []
    known = [m.span() for m in UUID.finditer(run)]
    pieces = list(SEGMENT.finditer(run))
    known += [m.span() for m in pieces if _is_digest(m.group())]
    if known:  # what is around them is judged for itself
        return [(a + i, a + j) for a, b in uncovered(0, len(run), sorted(known)) for i, j in random_spans(run[a:b], encoding, max_chars_per_token)]
    if _costly(run, encoding, max_chars_per_token):
        return [(0, len(run))]
    if len(pieces) < 2:
        return []
    scores = [max_chars_per_token * _tokens(m.group(), encoding) - len(m.group()) for m in pieces]
    scores = [x if LETTER.search(m.group()) else min(x, 0.0) for x, m in zip(scores, pieces, strict=True)]
    spans = [(pieces[a].start(), pieces[b - 1].end()) for a, b in _windows(scores)]
    return [(a, b) for a, b in spans if b - a >= SHORTEST and not NAME.fullmatch(run[a:b])]


def uncovered(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The parts of a span outside sorted spans."""
    out = []
    for a, b in taken:
        if a > start:
            out.append((start, min(a, end)))
        start = max(start, b)
    return [x for x in [*out, (start, end)] if x[0] < x[1]]


def looks_random(run: str, encoding, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> bool:
    """Whether a run, or a part of it, is no known digest, identifier or number and costs many tokens for its length."""
    return bool(random_spans(run, encoding, max_chars_per_token))


def find_secrets(text: str, encoding, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> list[tuple[int, int, int, str]]:
    """(start, rank of the kind, end, kind) of each secret in the whole text."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end(), "access") for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end(), "hex") for m in HEX.finditer(text)]
    base = sorted((a, b) for a, _, b, _ in spans)
    i = 0
    taken: list[tuple[int, int]] = []
    for m in RUN.finditer(text):
        taken = [x for x in taken if x[1] > m.start()]
        while i < len(base) and base[i][0] < m.end():
            if base[i][1] > m.start():
                taken.append(base[i])
            i += 1
        for start, end in uncovered(m.start(), m.end(), taken):
            spans += [(start + a, 3, start + b, "random") for a, b in random_spans(text[start:end], encoding, max_chars_per_token)]
    return spans


def scan_secrets(docs: DataFrame, vocabulary_path: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id, the count of each kind, a digest of the base spans, and all spans."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def start() -> Callable[[str], tuple]:
        encoding = vocabulary(vocabulary_path)

        def one(text: str) -> tuple:
            spans = find_secrets(text, encoding, max_chars_per_token)
            kinds = [s[3] for s in spans]
            return (*(kinds.count(k) for k in KINDS), sha256(span_text([s for s in spans if s[1] < 3])), span_text(spans))

        return one

    return map_texts(docs, start, "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def mask(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with each span replaced by its kind; spans that overlap are masked as one."""
    out, at = [], 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def mask_secrets(docs: DataFrame, vocabulary_path: str | None = None, max_chars_per_token: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """doc_id and the whole text with its secrets masked."""
    if vocabulary_path is None:
        import public_tokenizers

        vocabulary_path = public_tokenizers.path("byte_bpe_50k.tiktoken")

    def start() -> Callable[[str], tuple]:
        encoding = vocabulary(vocabulary_path)
        return lambda text: (mask(text, find_secrets(text, encoding, max_chars_per_token)),)

    return map_texts(docs, start, "text string")
