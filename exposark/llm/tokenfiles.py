"""Token ids in compact files: an adaptive context-mixing range coder over independently reset, checksummed blocks.

A block holds BLOCK ids. Three predictions of each id are mixed. Order 0: how the chunk's ids are distributed, kept apart for CLASSES
classes of the id before; the classes gather ids that are followed by like ids. Order 1 and order 2: the id that the block itself saw last after
the id before, and after the two ids before, each with a confidence. The more certain of orders 2 and 1 gets the share of the range that
guesses of its confidences have earned in the block so far; the distribution has the rest. So each id is one narrowing of the range, whole, and
nothing is written beside the coder. The block's guesses, confidences and shares are learned anew in each block, after every GROUP ids; what
a chunk's blocks have in common, the distribution, stands once before them and is checksummed as the blocks are.

Ranges are whole numbers below 2^53 in double precision and only added, multiplied, divided and rounded down, which is exact, so reader
and writer agree everywhere. All blocks of a piece are coded in step, one lane each.

A file is a Parquet file of chunks; a chunk is a row with its documents, their token counts, and its blocks.

Defined results: a null or empty text has only the end id; rows with a null doc_id come first; repeated rows are documents of their
own, in the order of a hash of their texts. A damaged block is an error when read.
"""

from __future__ import annotations

import itertools
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from exposark.llm.bpe import LATIN, NEW_LETTERS, NEW_NUMBERS, byte_symbols
from exposark.llm.common import map_batches, needed, shared_dir

#: Ids of a block, at most 2^14, and of a chunk: it ends with the first document that brings it to so many.
BLOCK = 1024
CHUNK = 2 << 20
#: Blocks of a piece, which are coded in step, and the ids after which the models learn.
LANES = 2048
GROUP = 32
#: Places for guesses of each order in a block.
SLOTS = 1 << 8
#: Classes of ids by what follows them, and how often each id may change its class.
CLASSES = 16
ROUNDS = 3
#: Shares of a class's distribution add up to two to this, or more if it has very many ids.
SHARE_BITS = 15
#: Parts of a range, the least range, and what a digit of the stream counts.
TOTAL = float(1 << 24)
LEAST, DIGIT = float(1 << 32), float(1 << 16)
TRUSTS = 4
#: By the confidence of order 2 and that of order 1 (0: no guess): how often the guess is right, as far as a new block knows, which counts as EVIDENCE guesses.
FORESEEN = np.array([0.0, 0.3, 0.5, 0.7, 0.35, 0.5, 0.6, 0.8, 0.6, 0.7, 0.8, 0.9, 0.85, 0.9, 0.92, 0.95])
EVIDENCE = 4.0
MOST_FORESEEN = 0.98
HEAD = struct.Struct("<HHI")
PIECE = struct.Struct("<III")
REMEMBERED = 500_000


# --- the models ---------------------------------------------------------------------------------------------------------


class Prior:
    """Order 0: the distribution of a piece's ids by class of the id before. Ids are numbered; number len(ids) stands for the start of a block."""

    def __init__(self, ids: np.ndarray, classes: np.ndarray, places: np.ndarray, shares: np.ndarray) -> None:
        self.ids, self.classes, self.places, self.shares = ids, classes, places, shares  # places: class * ids + number, ascending
        n = len(ids)
        ends = np.cumsum(shares)
        self.bits = int(ends[np.searchsorted(places, n) - 1]).bit_length() - 1
        before = places // n << self.bits
        self.below, self.above = (ends - shares - before).astype(float), (ends - before).astype(float)

    @classmethod
    def of(cls, ids: np.ndarray, block: int) -> tuple[Prior, np.ndarray]:
        """The distribution of ids that are parted into blocks, and their numbers."""
        counts = np.bincount(ids)
        known = np.flatnonzero(counts)
        n = len(known)
        kind = np.uint32 if (n + 1) * n < 1 << 32 else np.int64
        number = np.zeros(len(counts), kind)
        number[known] = np.arange(n)
        numbers = number.take(ids, mode="clip")
        pairs = np.empty(len(ids), kind)
        pairs[1:] = numbers[:-1]
        pairs[::block] = n
        pairs *= n
        pairs += numbers
        pairs.sort()
        edges = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1])))
        times = np.diff(np.append(edges, len(pairs)))
        first, second = np.divmod(pairs[edges].astype(np.int64), n)
        starts = np.flatnonzero(np.concatenate(([True], first[1:] != first[:-1])))
        rows = first[starts]
        classes = np.zeros(n + 1, np.int64)
        classes[rows[np.argsort(-np.add.reduceat(times, starts), kind="stable")]] = np.arange(len(rows)) % CLASSES
        smooth = np.bincount(second, times, n) * (2 * CLASSES / len(pairs))
        weights = times.astype(np.float32)
        for _ in range(ROUNDS):  # each id joins the class that foresees best what follows it
            joint = np.bincount(classes.take(first) * n + second, times, CLASSES * n).reshape(CLASSES, n) + smooth
            worth = np.log2(joint / joint.sum(axis=1, keepdims=True)).astype(np.float32)
            classes[rows] = np.stack([np.add.reduceat(weights * w.take(second), starts) for w in worth]).argmax(axis=0)
        joint = np.bincount(classes.take(first) * n + second, times, CLASSES * n).astype(np.int64).reshape(CLASSES, n)
        joint[:, 0] += joint.sum(axis=1) == 0
        used = (joint > 0).sum(axis=1, keepdims=True)
        whole = 1 << max(SHARE_BITS, int(used.max()).bit_length() + 1)
        shares = np.where(joint > 0, 1 + joint * (whole - used) // joint.sum(axis=1, keepdims=True), 0)
        shares[np.arange(CLASSES), shares.argmax(axis=1)] += whole - shares.sum(axis=1)
        places = np.flatnonzero(shares)
        return cls(known, classes, places, shares.reshape(-1)[places]), numbers

    def packed(self) -> bytes:
        values = np.concatenate(([len(self.ids), len(self.places)], np.diff(self.ids, prepend=0), self.classes, np.diff(self.places, prepend=0), self.shares)).astype("<u4")
        return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, 4).T).tobytes(), 6)

    @classmethod
    def unpacked(cls, data: bytes) -> Prior:
        raw = np.frombuffer(zlib.decompress(data), np.uint8)
        values = np.ascontiguousarray(raw.reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)
        n, m = int(values[0]), int(values[1])
        ids, classes, gaps, shares = np.split(values[2:], np.cumsum([n, n + 1, m]))
        return cls(np.cumsum(ids), classes, np.cumsum(gaps), shares)


class Models:
    """Orders 1 and 2 of so many blocks that are coded in step. They change after each group of GROUP ids, and are the same within one."""

    def __init__(self, lanes: int, ids: int) -> None:
        kind = np.uint16 if 4 * ids < 1 << 16 else np.int32  # what is seen has few bits where it can, as it is looked up all over the place
        self.lanes, self.lane = lanes, np.arange(lanes)
        self.base = np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        self.seen = np.zeros(2 * lanes * SLOTS, kind)  # both orders: four times the number, plus the confidence
        self.right, self.tried = np.repeat(FORESEEN * EVIDENCE, lanes), np.full(TRUSTS * TRUSTS * lanes, EVIDENCE)
        self.slots = np.zeros((2, GROUP, lanes), np.int64)
        self.found = np.zeros((2, GROUP, lanes), kind)
        self.row = np.zeros((GROUP, lanes), np.int64)

    def mix(self) -> None:
        """The part of TOTAL that the guess gets in the group to come, by both confidences and lane; none where there is no guess."""
        self.part = np.floor(self.right / self.tried * (TOTAL * MOST_FORESEEN)) + 1
        self.part[: self.lanes] = 0

    def foresee(self, k: int, until: int, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the ids k to until of the group, after the id before and the one before that: the guess, and its part."""
        slots, found, row = self.slots[:, k:until], self.found[:, k:until], self.row[k:until]
        mixed = one * np.int32(0x9E37)
        for j, key in enumerate((mixed >> 6, mixed + two * np.int32(0x5BD1) >> 5)):
            key &= np.int32(SLOTS - 1)
            np.add(self.base[j], key, out=slots[j])
            self.seen.take(slots[j], out=found[j], mode="clip")
        first, second = found
        trust = second & 3
        trust <<= 2
        trust |= first & 3
        np.multiply(trust, self.lanes, out=row)
        row += self.lane
        return np.where(second > 0, second, first) >> 2, self.part.take(row, mode="clip")

    def learn(self, numbers: np.ndarray, right: np.ndarray) -> None:
        """Learn the group: what followed, and where the guess was right."""
        n = len(numbers)
        same = numbers.astype(self.seen.dtype) << 2
        fresh = same + 1
        for slot, x in zip(self.slots[:, :n], self.found[:, :n], strict=True):
            sure = x | 3
            after = np.where(x == sure, x - 1, fresh)
            np.copyto(after, np.minimum(x + 1, sure), where=sure - same == 3)
            self.seen[slot.reshape(-1)] = after.reshape(-1)  # of several at one slot, the last stays
        row, size = self.row[:n], len(self.tried)
        self.right += np.bincount(row[right], minlength=size)
        self.tried += np.bincount(row.reshape(-1), minlength=size)


# --- the coder ----------------------------------------------------------------------------------------------------------


def encode_piece(ids: np.ndarray, block: int) -> bytes:
    """Up to LANES blocks of ids, behind their distribution. A last block that is shorter takes whole ranges beyond its end."""
    prior, numbers = Prior.of(ids.astype(np.int64), block)
    n = len(prior.ids)
    lanes, width = -(-len(ids) // block), min(block, len(ids))
    lengths = np.full(lanes, width)
    lengths[-1] = len(ids) - block * (lanes - 1)
    columns = np.full((width + 2, lanes), n, np.int32)
    rows = np.zeros(lanes * width, np.int32)
    rows[: len(ids)] = numbers
    columns[2:] = rows.reshape(lanes, width).T
    pair = np.zeros(CLASSES * n, np.int64)
    pair[prior.places] = np.arange(len(prior.places))
    before = prior.classes * n
    models = Models(lanes, n)
    low, wide = np.zeros(lanes), np.full(lanes, LEAST * DIGIT)
    room = 2 * width + 8
    at, out = np.arange(lanes) * room, np.zeros(lanes * room, np.int32)
    for t in range(0, width, GROUP):
        until = min(t + GROUP, width)
        one, now = columns[t + 1 : until + 1], columns[t + 2 : until + 2]
        models.mix()
        guess, part = models.foresee(0, until - t, one, columns[t:until])
        right = (now == guess) & (part > 0)
        rest = (TOTAL - part) * 2.0**-prior.bits
        place = before.take(one, mode="clip")
        place += now
        place = pair.take(place, mode="clip")
        start = part + np.floor(prior.below.take(place, mode="clip") * rest)
        share = part + np.floor(prior.above.take(place, mode="clip") * rest)
        np.copyto(start, 0.0, where=right)
        np.copyto(share, part, where=right)
        share -= start
        if until > lengths[-1]:
            beyond = max(0, int(lengths[-1]) - t)
            start[beyond:, -1], share[beyond:, -1] = 0.0, TOTAL
        for k in range(until - t):
            unit = np.floor(wide * (1 / TOTAL))
            low += start[k] * unit
            wide = share[k] * unit
            due = wide < LEAST
            while due.any():
                digit = np.floor(low * (1 / LEAST))  # may be over a digit: what is carried is settled below
                ready = np.flatnonzero(due)
                out[at.take(ready)] = digit.take(ready)
                at += due
                low -= digit * (due * LEAST)
                up = np.where(due, DIGIT, 1.0)
                low *= up
                wide *= up
                due = wide < LEAST
        models.learn(now, right)
    out[at] = np.ceil(low * (1 / LEAST))
    at += 1 - np.arange(lanes) * room
    digits = out.reshape(lanes, room)[:, : at.max()].copy()
    while (digits > 0xFFFF).any():
        carry = digits >> 16
        digits &= 0xFFFF
        digits[:, :-1] += carry[:, 1:]
    digits = digits.astype("<u2")
    whole = np.ascontiguousarray(ids, "<u4")
    coded = [digits[k, : at[k]].tobytes() for k in range(lanes)]
    heads = [HEAD.pack(int(lengths[k]), at[k], zlib.crc32(whole[k * block : (k + 1) * block])) for k in range(lanes)]
    packed = prior.packed()
    return b"".join((PIECE.pack(len(packed), lanes, zlib.crc32(packed)), packed, *heads, *coded))


def encode_ids(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Ids below 2^17 as pieces end to end."""
    return b"".join(encode_piece(ids[i : i + block * LANES], block) for i in range(0, len(ids), block * LANES))


def decode_piece(prior: Prior, heads: list[tuple[int, int, int]], coded: list[bytes]) -> list[np.ndarray]:
    """The ids of blocks. A block shorter than the longest is read on over its end, and what that gives is left out."""
    lanes, width = len(heads), max(h[0] for h in heads)
    n = len(prior.ids)
    models = Models(lanes, n)
    room = max(map(len, coded)) // 2 + 8
    stream = np.zeros((lanes, room), "<u2")
    for k, x in enumerate(coded):
        stream[k, : len(x) // 2] = np.frombuffer(x, "<u2")
    stream = stream.reshape(-1)
    at, ahead = np.arange(lanes) * room, np.zeros(lanes)  # ahead: the stream's number less the lower end of the range
    for _ in range(3):
        ahead = ahead * DIGIT + stream.take(at)
        at += 1
    wide = np.full(lanes, LEAST * DIGIT)
    columns = np.full((width + 2, lanes), n, np.int32)
    # by place in a class's distribution: number, share and what lies below, in one number of 17, 23 and 23 bits
    below = prior.below.astype(np.int64)
    pair = np.repeat((prior.places % n) << 46 | prior.shares << 23 | below, prior.shares)
    first = (prior.classes << prior.bits) - 1
    right = np.zeros((GROUP, lanes), bool)
    for t in range(0, width, GROUP):
        until = min(t + GROUP, width)
        models.mix()
        for k in range(t, until):
            one = columns[k + 1]
            guess, part = (x[0] for x in models.foresee(k - t, k - t + 1, one, columns[k]))
            rest = (TOTAL - part) * 2.0**-prior.bits
            unit = np.floor(wide * (1 / TOTAL))
            value = np.floor(ahead / unit)
            np.minimum(value, TOTAL - 1, out=value)
            foreseen = np.less(value, part, out=right[k - t])
            value -= part
            value += 1
            value /= rest
            place = np.ceil(value, out=value).astype(np.int64)
            place += first.take(one, mode="clip")
            found = pair.take(place, mode="clip")
            start = found & 0x7FFFFF
            found >>= 23
            share = found & 0x7FFFFF
            share += start
            found >>= 23
            start, share = start * rest, share * rest
            np.floor(start, out=start)
            np.floor(share, out=share)
            start += part
            share += part
            np.copyto(start, 0.0, where=foreseen)
            np.copyto(share, part, where=foreseen)
            np.copyto(found, guess, where=foreseen)
            columns[k + 2] = found
            share -= start
            start *= unit
            ahead -= start
            wide = share * unit
            due = wide < LEAST
            while due.any():
                up = np.where(due, DIGIT, 1.0)
                wide *= up
                ahead *= up
                ahead += stream.take(at, mode="clip") * due
                at += due
                due = wide < LEAST
        models.learn(columns[t + 2 : until + 2], right[: until - t])
    matrix = prior.ids.astype("<u4").take(columns[2:].T, mode="clip")
    out = []
    for row, (length, _, crc) in zip(matrix, heads, strict=True):
        if zlib.crc32(row[:length]) != crc:
            raise ValueError("a block of token ids is damaged")
        out.append(row[:length])
    return out


def decode_ids(data: bytes) -> np.ndarray:
    """The ids of pieces end to end. Raises ValueError where a checksum does not hold."""
    at, out = 0, []
    try:
        while at < len(data):
            size, lanes, crc = PIECE.unpack_from(data, at)
            at += PIECE.size
            packed = data[at : at + size]
            if zlib.crc32(packed) != crc:
                raise ValueError("the distribution of a piece of token ids is damaged")
            at += size
            heads = [HEAD.unpack_from(data, at + k * HEAD.size) for k in range(lanes)]
            at += lanes * HEAD.size
            ends = at + 2 * np.cumsum([h[1] for h in heads])
            if ends[-1] > len(data):
                raise ValueError("a block of token ids is cut off")
            coded = [data[b - 2 * h[1] : b] for h, b in zip(heads, ends.tolist(), strict=True)]
            at = int(ends[-1])
            with np.errstate(over="ignore"):  # numbers of damaged streams may grow without bound; their checksums tell
                out += decode_piece(Prior.unpacked(packed), heads, coded)
    except (struct.error, IndexError) as e:
        raise ValueError("a piece of token ids is cut off") from e
    return np.concatenate(out) if out else np.zeros(0, "<u4")


# --- tokens -------------------------------------------------------------------------------------------------------------


#: Bytes of texts whose words can be encoded apart: ASCII without rare white space, and letters up to U+017F.
PLAIN = bytes(sorted((set(range(128)) - {*range(9, 10), *range(11, 14), *range(0x1C, 0x20)}) | set(range(0x80, 0xC6)) - {0xC0, 0xC1}))
#: White space beside a space, and white space beyond ASCII: such texts are not parted at spaces.
APART = ("  ", " \n", "\n ", "\x85", "\xa0")
#: Longer words are not remembered.
LONGEST_REMEMBERED = 64
#: Pieces of up to so many characters are remembered for themselves.
SHORT = 2
#: What stands behind the letters of a word is remembered for itself up to so many characters.
SIGNS = 4
LAST_LATIN = chr(LATIN)


class Tokens:
    """Ids of texts by the tokenizers library. Its byte-level pre-tokeniser parts a text into pieces that are encoded apart, so words are encoded once and remembered."""

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.split = regex.compile(self.PATTERN).findall
        letters = re.escape("".join(c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == "L"))
        digits = re.escape("".join(c for c in map(chr, range(LATIN)) if unicodedata.category(c)[0] == "N"))
        latin = self.PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{letters}{digits}]").replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{digits}]")
        self.split_latin = re.compile(latin).findall
        self.letters = re.compile(f"[{letters}]*").match
        self.beyond_latin = re.compile(f"[^\x00-{chr(LATIN - 1)}]|[\x1c-\x1f\x85]").search
        self.newest = regex.compile(f"[{NEW_LETTERS}{NEW_NUMBERS}]").search
        self.tokenize = self.library.model.tokenize
        self.bytes = {chr(b): symbol for b, symbol in byte_symbols().items()}
        self.symbols = {k: "".join(self.bytes[c] for c in chr(k).encode().decode("latin-1")) for k in range(LATIN)}
        self.space = self.symbols[ord(" ")]
        self.short: dict[str, bytes] = {}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit numbers."""
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text. Texts that can be parted at spaces have their different words looked up once for all of them."""
        out = [b""] * len(texts)
        plain: list[int] = []
        for k, text in enumerate(texts):
            special = any(s in text for s in self.special)
            if not text:
                continue
            if not special and not text.encode("utf-8", "surrogatepass").translate(None, PLAIN) and not any(x in text for x in APART):
                plain.append(k)
                continue
            beyond = self.beyond_latin(text)
            if special or beyond and self.newest(text):
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                out[k] = b"".join(map(self.modelled, (self.split if beyond else self.split_latin)(text)))
        if plain:
            for k, ids in zip(plain, self.parted([texts[k] for k in plain]), strict=True):
                out[k] = ids
        return out

    def parted(self, texts: list[str]) -> list[bytes]:
        """The ids of each of some texts, none of them empty, that can be parted at spaces."""
        # a piece takes a single space as its first character or not at all, and a lone line end is a piece of its own:
        # words are encoded apart, each with the space or line end before it
        words = pc.split_pattern(pa.array([t if "\n\n" in t else t.replace("\n", " \n") for t in texts], pa.large_string()), " ")
        edges = words.offsets.to_numpy().astype(np.int64)
        encoded = words.flatten().dictionary_encode()
        different = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()
        which = encoded.indices.to_numpy().astype(np.int64)
        found = list(map(self.young.get, different))
        missing = [k for k, f in enumerate(found) if f is None]
        for k, f in zip(missing, self.remember([different[k] for k in missing]), strict=True):
            found[k] = f
        # no space stands before the first word of a text
        firsts = [different[k] for k in which.take(edges[:-1]).tolist()]
        which[edges[:-1]] = len(found) + np.arange(len(firsts))
        found += [b"".join(map(self.modelled, self.split_latin(w))) for w in firsts]
        known = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        starts = sizes.cumsum() - sizes
        n = sizes.take(which)
        ends = np.append(0, n.cumsum())
        place = (starts.take(which) - ends[:-1]).repeat(n)
        place += np.arange(len(place))
        ids = known.take(place, mode="clip") if len(place) else known[:0]
        bounds = ends.take(edges).tolist()
        return [ids[a:b].tobytes() for a, b in itertools.pairwise(bounds)]

    def modelled(self, piece: str) -> bytes:
        """What the library's byte-level pre-tokeniser hands to its model, by that model."""
        found = self.short.get(piece)
        if found is None:
            symbols = piece.translate(self.symbols) if len(piece) <= LONGEST_REMEMBERED and max(piece) < LAST_LATIN else "".join(map(self.bytes.__getitem__, piece.encode().decode("latin-1")))
            found = array("I", [t.id for t in self.tokenize(symbols)]).tobytes()
            if len(piece) <= SHORT and len(self.short) < REMEMBERED:
                self.short[piece] = found
        return found

    def remember(self, words: list[str]) -> list[bytes]:
        """The ids of words after a space, or of such that begin with a line end, that the younger generation lacks; when that is full, it becomes the older one."""
        out = []
        space, symbols, tokenize, letters = self.space, self.symbols, self.tokenize, self.letters
        for word in words:
            found = self.old.get(word)
            if found is None:
                # letters, and pieces behind them that do not depend on the letters
                head = word if word.isalpha() else letters(word)[0]
                if len(head) > SHORT:
                    found = self.young.get(head) or self.old.get(head)
                    if found is None:
                        found = array("I", [t.id for t in tokenize(space + (head if head.isascii() else head.translate(symbols)))]).tobytes()
                        if head is not word:
                            self.keep(head, found)
                    if head is not word:
                        found += self.behind(word[len(head) :])
                else:
                    found = b"".join(map(self.modelled, self.split_latin(word if word[:1] == "\n" else " " + word)))
            self.keep(word, found)
            out.append(found)
        return out

    def behind(self, rest: str) -> bytes:
        """The ids of what stands behind the letters of a word, up to the next space. Signs are few, so they are remembered for themselves."""
        found = self.short.get(rest)
        if found is None:
            found = b"".join(map(self.modelled, self.split_latin(rest)))
            if len(rest) <= SIGNS and len(self.short) < REMEMBERED:
                self.short[rest] = found
        return found

    def keep(self, word: str, found: bytes) -> None:
        if len(word) <= LONGEST_REMEMBERED:
            if len(self.young) >= REMEMBERED:
                self.old, self.young = self.young, {}
            self.young[word] = found


_loaded: dict[str, Tokens] = {}


def load(path: str) -> Tokens:
    """The vocabulary of a file, loaded once in a worker; what it remembers serves all tasks of the worker."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


# --- files --------------------------------------------------------------------------------------------------------------

CHUNK_SCHEMA = "part int, chunk int, first long, n_ids long, doc_ids array<long>, counts array<long>, blocks binary"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_ids(docs: DataFrame, path: str, vocabulary_path: str | None = None, end_id: int = 0) -> None:
    """Write the ids of all documents, each followed by end_id, in ascending doc_id order, to files under path."""
    vocabulary = vocabulary_path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = load(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        first, chunk = 0, 0
        doc_ids: list[int | None] = []
        counts: list[int] = []
        parts: list[bytes] = []
        total = 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[part], [chunk], [first], [len(ids)], [doc_ids], [counts], [encode_ids(ids)]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "chunk", "first", "n_ids", "doc_ids", "counts", "blocks"])

        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), tokens.encode_all([x or "" for x in batch.column(1).to_pylist()]), strict=True):
                ids += end
                n = len(ids) // 4
                if doc_ids and total + n > CHUNK:  # a chunk of a piece and a few ids more would take nearly as many steps for those
                    yield close()
                    first, chunk, total, doc_ids, counts, parts = first + total, chunk + 1, 0, [], [], []
                doc_ids.append(doc_id)
                counts.append(n)
                parts.append(ids)
                total += n
        if doc_ids:
            yield close()

    rows = needed(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = (F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))))  # the hash parts the rows of one id, or of none
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    map_batches(ordered, run, CHUNK_SCHEMA).write.parquet(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, and the ids, of each document in the files under path."""
    return _read(spark, path, True)


def read_checksums(spark: SparkSession, path: str) -> DataFrame:
    """As read_ids, with the CRC-32 of the ids (little-endian unsigned 32-bit numbers) in place of the ids."""
    return _read(spark, path, False)


def _read(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    chunks = spark.read.schema(CHUNK_SCHEMA).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_ids(row["blocks"])
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                if len(ids) != row["n_ids"] or len(ends) and ends[-1] != len(ids):
                    raise ValueError("a chunk of token ids is damaged")
                if whole:
                    last = pa.array([ids[a:b].astype(np.int64) for a, b in zip(starts, ends, strict=True)], pa.list_(pa.int64()))
                else:
                    last = pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64())
                n = len(ends)
                yield pa.RecordBatch.from_arrays([pa.array([row["part"]] * n, pa.int32()), pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["first"], pa.int64()), pa.array(row["counts"], pa.int64()), last], ["part", "doc_id", "first", "n_tokens", name])

    name, kind = ("ids", "array<long>") if whole else ("ids_crc32", "long")
    documents = map_batches(chunks, run, f"part int, doc_id long, first long, n_tokens long, {name} {kind}")
    # a row for each partition that was written, so their sums fit the driver whatever the input
    sums = sorted((r["part"], r["n"]) for r in chunks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())
    before, offsets = 0, []
    for part, n in sums:
        offsets.append((part, before))
        before += n
    table = spark.createDataFrame(offsets, "part int, before long")
    return documents.join(F.broadcast(table), "part").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", name)


def write_and_check(docs: DataFrame, vocabulary_path: str | None = None, end_id: int = 0) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files that its ids were written to."""
    path = shared_dir(docs.sparkSession, "token-ids")
    write_ids(docs, path, vocabulary_path, end_id)
    return read_checksums(docs.sparkSession, path)
