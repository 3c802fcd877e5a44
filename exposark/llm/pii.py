"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The patterns find e-mail addresses, dotted IPv4 addresses, payment cards (Luhn) and international phone numbers. The random field
reads the tokens around digits, @ signs and the words that announce names and numbers, scores whole candidate segments of up to MAX_TOKENS tokens
by features of the span (digit count, checksums, shape, the words before), and picks boundaries and types together by dynamic programming. Beside
the kinds of the patterns it knows account numbers (IBAN), national numbers, birth dates and names. It is fitted by conditional likelihood on
sentences generated from a fixed seed, so it depends on no corpus and is the same everywhere.

Defined results: a null or empty text has no spans; repeated rows each get their own; a span of the model never overlaps a span of the
patterns or another of its own. What stands further than REACH characters from any digit, @ sign or announcing word is not read by the field, and a token of over
LONGEST_TOKEN characters is in none of its spans: a blob without spaces costs time in proportion to its length. Both hold for texts of any length.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from exposark.llm.common import map_texts, sha256, span_text

KINDS = ("email", "ip", "card", "phone")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+$")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where its digits do; saying so keeps long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """Whether the last digit is the Luhn check digit of the others."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost, non-overlapping addresses: for each @, the longest local part that no earlier match has taken, and its domain."""
    out = []
    taken = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            taken = m.end()
        at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of each match of the fixed patterns."""
    spans = [(a, 0, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(int(p.lstrip("0")[:4] or 0) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = NOT_DIGITS.sub("", m.group())
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGITS.sub("", m.group())) <= 15:
                spans.append((m.start(), 3, m.end(), "phone"))
    return spans


# --- the random field -------------------------------------------------------------------------------------------------

LABELS = ("other", *KINDS, "iban", "national_id", "birth_date", "name")
MAX_TOKENS = 6
LONGEST_TOKEN = 128
#: Characters of text around a seed that the model reads.
REACH = 48
TOKEN = re.compile(r"\S+")
#: Words that announce a kind.
CUES = {
    "call": "phone", "phone": "phone", "tel": "phone", "telephone": "phone", "mobile": "phone", "fax": "phone", "cell": "phone", "dial": "phone", "text": "phone", "whatsapp": "phone",
    "mail": "email", "email": "email", "e-mail": "email", "contact": "email", "write": "email", "reach": "email",
    "card": "card", "visa": "card", "credit": "card", "mastercard": "card", "amex": "card", "debit": "card",
    "ip": "ip", "host": "ip", "address": "ip", "server": "ip", "ping": "ip", "ipv6": "ip", "gateway": "ip",
    "iban": "iban", "account": "iban", "bank": "iban", "transfer": "iban", "konto": "iban",
    "ssn": "national_id", "social": "national_id", "security": "national_id", "insurance": "national_id", "passport": "national_id", "national": "national_id", "tax": "national_id", "licence": "national_id", "license": "national_id", "id": "national_id",
    "born": "birth_date", "birth": "birth_date", "dob": "birth_date", "birthday": "birth_date", "birthdate": "birth_date",
    "name": "name", "mr": "name", "mrs": "name", "ms": "name", "dr": "name", "prof": "name", "professor": "name", "sincerely": "name", "regards": "name", "signed": "name", "patient": "name", "employee": "name", "customer": "name", "attn": "name",
}
NAME_CUES = tuple(c for c, k in CUES.items() if k == "name")
SEED = re.compile(r"[0-9@]+|[(\[]at[)\]]|\b(?:" + "|".join(NAME_CUES) + r")\b", re.IGNORECASE)
SIZES = ((0, "0"), (6, "1-6"), (8, "7-8"), (11, "9-11"), (15, "12-15"), (16, "16"), (19, "17-19"), (10**9, "more"))
EDGES = ".,;:!?\"'<>)]}"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
MONTH = "(?:" + "|".join(MONTHS) + ")[a-z]*"
SHAPES = tuple((name, re.compile(p, flags)) for name, p, flags in (
    ("grouped", r"\(?0?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}", 0),
    ("fours", r"[0-9]{4}([ -][0-9]{4}){2,3}", 0),
    ("plain", r"[0-9]+", 0),
    ("threetwofour", r"[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}", 0),
    ("letterdigits", r"[A-Z]{1,3} ?[0-9]{6,9} ?[A-Z]?", 0),
    ("date", rf"[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-](?:[0-9]{{2}}|[0-9]{{4}})|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}(?:st|nd|rd|th)?(?: of)? {MONTH},? [0-9]{{4}}|{MONTH} [0-9]{{1,2}}(?:st|nd|rd|th)?,? [0-9]{{4}}", re.IGNORECASE),
    ("capitals", r"(?:(?:[A-Z][a-z]+|[A-Z]\.)[ -]){0,2}[A-Z][a-z]+", 0),
    ("colons", r"(?:[0-9a-fA-F]{0,4}:){3,7}[0-9a-fA-F]{0,4}", 0),
))
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?")


def iban_holds(segment: str) -> bool:
    """Whether the remainder by 97 is that of an account number."""
    compact = segment.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in compact[4:] + compact[:4])) % 97 == 1


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the punctuation around it."""
    while end > start and text[end - 1] in EDGES:
        end -= 1
    while start < end and text[start] in "\"'<[{,;:":
        start += 1
    return start, end


def features(segment: str, tokens: int, before: tuple[str, ...]) -> list[str]:
    """What the model sees of a whole segment. before: the words before it, the nearest first."""
    digits = NOT_DIGITS.sub("", segment)
    letters = sum(c.isalpha() for c in segment)
    low = segment.lower()
    size = "digits=" + next(name for most, name in SIZES if len(digits) <= most)
    out = ["bias", f"tokens={tokens}", size, f"letters={'no' if not letters else 'few' if letters < 4 else 'many'}"]
    if 12 <= len(digits) <= 19 and not letters:
        out.append(f"luhn={luhn(digits)}")
    if "@" in segment:
        out.append(f"at={bool(re.fullmatch(r'[^@ ]+@[^@ ]+[.][A-Za-z]{2,}', segment))}")
    if re.search(r"\S ?([\[(]at[\])]) ?\S", low):
        out.append(f"spelled={bool(re.fullmatch(r'[a-z0-9._%+-]+ ?[(]at[)] ?[a-z0-9.-]+ ?([.]|[(]dot[)]) ?[a-z]{2,}|[a-z0-9._%+-]+ ?\[at\] ?[a-z0-9.-]+ ?([.]|\[dot\]) ?[a-z]{2,}', low))}")
    if "." in segment and digits:
        parts = segment.split(".")
        out.append(f"quad={len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}")
    if segment.startswith("+"):
        out.append("plus")
    shapes = [name for name, p in SHAPES if p.fullmatch(segment)]
    if len(digits) > 4 and IBAN.fullmatch(segment):
        shapes.append(f"iban={iban_holds(segment)}")
    out += shapes
    for far, word in enumerate(before):
        cue = CUES.get(word.lower().strip(".,:;()#"))
        if cue:
            out += [f"cue={cue}", f"cue={cue}/{far}", f"cue={cue}+{size}", *(f"cue={cue}+{x}" for x in shapes)]
            break
    if segment and CUES.get(segment.split(" ")[0].lower().strip(".,:;()#")):
        out.append("begins with a cue")
    return out


class SemiCrf:
    """Weights by feature and label, and by pair of labels."""

    def __init__(self) -> None:
        self.weights: dict[str, list[float]] = {}
        self.steps = [[0.0] * len(LABELS) for _ in LABELS]

    def scores(self, found: list[str]) -> list[float]:
        rows = [self.weights[f] for f in found if f in self.weights]
        return [sum(r[k] for r in rows) for k in range(len(LABELS))] if rows else [0.0] * len(LABELS)

    def segments(self, text: str, tokens: list[tuple[int, int]]) -> list[list[tuple[int, list[str]]]]:
        """By end (exclusive, in tokens): (start, features) of each segment that may end there."""
        out: list[list[tuple[int, list[str]]]] = [[]]
        for end in range(1, len(tokens) + 1):
            out.append([])
            for start in range(end - 1, max(-1, end - 1 - MAX_TOKENS), -1):
                a, b = trimmed(text, tokens[start][0], tokens[end - 1][1])
                before = tuple(text[slice(*t)] for t in reversed(tokens[max(0, start - 2) : start]))
                out[end].append((start, features(text[a:b], end - start, before)))
        return out

    def scored(self, cells: list) -> list[list[tuple[int, np.ndarray]]]:
        """By end: (start, scores by label) of each segment; what is no entity goes by single tokens."""
        out = []
        for end, segments in enumerate(cells):
            row = []
            for start, found in segments:
                x = np.array(self.scores(found))
                if end - start > 1:
                    x[0] = -np.inf
                row.append((start, x))
            out.append(row)
        return out

    def forward(self, cells: list, best: bool) -> tuple[list, list]:
        """By end and label: the log sum, or the best, of the scores of all ways to get there; for the best also the way back."""
        return self._forward(self.scored(cells), best)

    def _forward(self, scored: list, best: bool) -> tuple[list, list]:
        n = len(LABELS)
        steps = np.array(self.steps)
        start = np.full(n, -np.inf)
        start[0] = 0.0
        table, back = [start], [None]
        for end in range(1, len(scored)):
            ways = np.stack([table[begin][:, None] + steps + x for begin, x in scored[end]])  # segment, label before, label
            flat = ways.reshape(-1, n)
            top = flat.max(axis=0)
            if best:
                table.append(top)
                back.append([(scored[end][k // n][0], k % n) for k in flat.argmax(axis=0).tolist()])
            else:
                table.append(top + np.log(np.exp(flat - top).sum(axis=0)))
        return table, back

    def backward(self, cells: list) -> list:
        return self._backward(self.scored(cells))

    def _backward(self, scored: list) -> list:
        n = len(LABELS)
        steps = np.array(self.steps)
        ways: list[list[np.ndarray]] = [[] for _ in scored]
        table = [np.zeros(n)] * len(scored)
        for end in range(len(scored) - 1, 0, -1):
            if end < len(scored) - 1:
                flat = np.concatenate(ways[end], axis=1)
                top = flat.max(axis=1, keepdims=True)
                table[end] = (top + np.log(np.exp(flat - top).sum(axis=1, keepdims=True)))[:, 0]
            for start, x in scored[end]:
                ways[start].append(steps + x + table[end])
        flat = np.concatenate(ways[0], axis=1) if ways[0] else np.zeros((n, 1))
        top = flat.max(axis=1, keepdims=True)
        table[0] = (top + np.log(np.exp(flat - top).sum(axis=1, keepdims=True)))[:, 0]
        return table

    def learn(self, cells: list, gold: list[tuple[int, int, int]], rate: float) -> float:
        """One step along the gradient of the conditional log-likelihood, which is returned. gold: (start, end, label) covering all tokens."""
        scored = self.scored(cells)
        ahead, behind = self._forward(scored, best=False)[0], self._backward(scored)
        total = _log_sum(ahead[-1].tolist())
        n = len(LABELS)
        change: dict[str, np.ndarray] = {}
        old = np.array(self.steps)
        steps = np.zeros((n, n))
        for end in range(1, len(cells)):
            for (start, found), (_, x) in zip(cells[end], scored[end], strict=True):
                p = np.exp(ahead[start][:, None] + old + x + behind[end] - total)
                steps -= p
                mass = p.sum(axis=0)
                if mass[0] + mass[1:].max() > 1e-6:
                    for f in found:
                        change[f] = change[f] - mass if f in change else -mass
        score, before = 0.0, 0
        for start, end, k in gold:
            found = cells[end][end - 1 - start][1]
            score += self.scores(found)[k] + old[before, k]
            steps[before, k] += 1
            for f in found:
                d = change.setdefault(f, np.zeros(n))
                d[k] += 1
            before = k
        for f, d in change.items():
            w = self.weights.setdefault(f, [0.0] * n)
            for k, x in enumerate(d.tolist()):
                w[k] += rate * (x - 0.002 * w[k])
        self.steps = (old + rate * steps).tolist()
        return score - total

    def decode(self, text: str, start: int, end: int) -> list[tuple[int, int, int]]:
        """(start, end, label) in characters of the entities of the best segmentation of text[start:end]."""
        parts: list[list[tuple[int, int]]] = [[]]
        for m in TOKEN.finditer(text, start, end):
            if m.end() - m.start() > LONGEST_TOKEN:  # nothing goes over it
                parts.append([])
            else:
                parts[-1].append(m.span())
        return [x for tokens in parts if tokens for x in self._best(text, tokens)]

    def _best(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        cells = self.segments(text, tokens)
        table, back = self.forward(cells, best=True)
        at, k = len(tokens), max(range(len(LABELS)), key=lambda i: table[-1][i])
        out = []
        while at > 0:
            begin, j = back[at][k]
            if k:
                out.append((*trimmed(text, tokens[begin][0], tokens[at - 1][1]), k))
            at, k = begin, j
        return out[::-1]


def _log_sum(values: list[float]) -> float:
    top = max(values, default=-math.inf)
    return top + math.log(sum(math.exp(v - top) for v in values)) if top > -math.inf else top


def example(rng: random.Random) -> tuple[str, list[tuple[int, int]], list[tuple[int, int, int]]]:
    """A generated sentence, its tokens, and its segments."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnoprstuvw") for _ in range(rng.randint(2, 9)))

    def card(valid: bool) -> str:
        body = digits(15)
        check = next(c for c in "0123456789" if luhn(body + c))
        return body + (check if valid else str((int(check) + rng.randint(1, 9)) % 10))

    capital = lambda: rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ")

    def iban(valid: bool) -> str:
        body = capital() + capital() + digits(rng.randint(12, 18))
        number = "".join(str(int(c, 36)) for c in body + "DE00")
        check = 98 - int(number) % 97
        x = f"DE{check if valid else (check + rng.randint(1, 90)) % 97:02d}{body}"
        return rng.choice([x, " ".join(x[i : i + 4] for i in range(0, len(x), 4))])

    def date() -> str:
        day, month, year = rng.randint(1, 28), rng.randint(1, 12), rng.randint(1930, 2010)
        return rng.choice([f"{day}/{month}/{year}", f"{day:02d}.{month:02d}.{year}", f"{year}-{month:02d}-{day:02d}", f"{day} {MONTHS[month - 1].title()} {year}", f"{MONTHS[month - 1].title()} {day}, {year}"])

    def person() -> str:
        return " ".join(word().title() for _ in range(rng.randint(1, 3)))

    def fours(x: str) -> str:
        return rng.choice([" ", "-"]).join(x[i : i + 4] for i in range(0, 16, 4))

    made = {
        1: lambda: rng.choice([f"{word()}.{digits(2)}@{word()}.com", f"{word()}@{word()}.{word()}.org", f"{word()} (at) {word()} (dot) com", f"{word()}[at]{word()}.org", f"{word()} [at] {word()} [dot] net"]),
        2: lambda: rng.choice([".".join(str(rng.randint(0, 255)) for _ in range(4)), ":".join(f"{rng.getrandbits(16):x}" for _ in range(8))]),
        3: lambda: rng.choice([card(True), fours(card(True))]),
        4: lambda: rng.choice([f"+{digits(1)} ({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(3)}", f"{digits(3)}.{digits(3)}.{digits(4)}"]),
        5: lambda: iban(True),
        6: lambda: rng.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"{capital()}{capital()}{digits(6)}{capital()}", f"{capital()}{digits(8)}"]),
        7: date,
        8: person,
        0: lambda: rng.choice([date(), person(), iban(False), f"{capital()}{digits(3)}", f"{digits(2)}:{digits(2)}:{digits(2)}"]) if rng.random() < 0.2 else rng.choice([digits(rng.choice([1, 2, 3, 4, 5, 6, 8, 10])), card(False), f"{digits(2)}:{digits(2)}", f"{digits(1)}.{digits(2)}", f"20{digits(2)}-0{rng.randint(1, 9)}-1{digits(1)}", f"v{digits(1)}.{digits(1)}.{digits(1)}", f"@{word()}", f"{rng.randint(256, 999)}.{digits(2)}.{digits(2)}.{digits(1)}", f"{word()}{digits(2)}", digits(rng.randint(20, 40)), "%032x" % rng.getrandbits(128), f"{digits(3)} {digits(3)}", f"{digits(4)} {digits(4)}"]),
    }
    pieces: list[tuple[str, int]] = []
    for _ in range(rng.randint(1, 3)):
        pieces += [(word() + rng.choice(["", "", ".", ","]), 0) for _ in range(rng.randint(1, 3))]
        k = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7, 8])
        if k > 5 or k and rng.random() < 0.3:  # numbers, dates and names are personal data where a word says so
            cue = rng.choice([c for c, v in CUES.items() if v == LABELS[k]])
            pieces.append((rng.choice([cue, cue.title(), cue + ":", cue.title() + ":"]), 0))
            if rng.random() < 0.3:
                pieces.append((rng.choice(["is", "on", "of", "no.", "number", "number:", "to", "date:"]), 0))
        pieces.append((made[k]() + rng.choice(["", "", ".", ","]), k))
    pieces.append((word(), 0))
    text, tokens, gold = "", [], []
    for piece, k in pieces:
        offset = len(text)
        spans = [(offset + m.start(), offset + m.end()) for m in TOKEN.finditer(piece)]
        at = len(tokens)
        tokens += spans
        gold += [(at, len(tokens), k)] if k else [(i, i + 1, 0) for i in range(at, len(tokens))]
        text += piece + " "
    return text, tokens, gold


def fit(examples: int = 600, rounds: int = 3, seed: int = 7) -> SemiCrf:
    """The model of generated sentences; the same arguments give the same weights."""
    rng = random.Random(seed)
    model = SemiCrf()
    data = [(model.segments(text, tokens), gold) for text, tokens, gold in (example(rng) for _ in range(examples))]
    for i in range(rounds):
        rng.shuffle(data)
        for cells, gold in data:
            model.learn(cells, gold, rate=0.2 / (1 + i))
    return model


def model_spans(text: str, model: SemiCrf, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """(start, rank, end, kind) of the model's entities that overlap no base span, over all stretches around digits and @ signs."""
    taken = sorted((s, e) for s, _, e, _ in base)
    stretches: list[list[int]] = []
    i = 0
    for m in SEED.finditer(text):
        while i < len(taken) and taken[i][1] <= m.start():
            i += 1
        if i < len(taken) and taken[i][0] < m.end():
            continue  # the patterns have it
        until = stretches[-1][1] if stretches else 0
        a, b = max(until, m.start() - REACH), min(len(text), m.end() + REACH)
        while a > until and not text[a - 1].isspace():  # each character is passed once
            a -= 1
        b = max(b, until)
        while b < len(text) and not text[b].isspace():
            b += 1
        if stretches and a == until:
            stretches[-1][1] = b
        else:
            stretches.append([a, b])
    out = []
    i = 0
    for a, b in stretches:
        for start, end, k in model.decode(text, a, b):
            while i < len(taken) and taken[i][1] <= start:
                i += 1
            if start < end and not (i < len(taken) and taken[i][0] < end):
                out.append((start, len(KINDS) - 1 + k, end, f"model_{LABELS[k]}"))
    return out


def find_pii(text: str, model: SemiCrf) -> list[tuple[int, int, int, str]]:
    base = base_spans(text)
    return base + model_spans(text, model, base)


def scan_pii(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """doc_id, the count of each base kind and of the model's spans, a digest of the base spans, and all spans."""
    fitted = model or fit()

    def start() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            base = base_spans(text)
            more = model_spans(text, fitted, base)
            kinds = [s[3] for s in base]
            return (*(kinds.count(k) for k in KINDS), len(more), len(base) + len(more), sha256(span_text(base)), span_text(base + more))

        return one

    return map_texts(docs, start, "n_email long, n_ip long, n_card long, n_phone long, n_model long, n_spans long, base_sha256 string, spans string")


def mask_pii(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """doc_id and the whole text with each span replaced by its kind in brackets; spans that overlap are masked as one."""
    fitted = model or fit()

    def start() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            out, at = [], 0
            for a, _, b, kind in sorted(find_pii(text, fitted)):
                if a >= at:
                    out += [text[at:a], f"[{kind.removeprefix('model_')}]"]
                at = max(at, b)
            return ("".join(out) + text[at:],)

        return one

    return map_texts(docs, start, "text string")
