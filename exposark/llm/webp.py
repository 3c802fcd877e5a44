"""Lossless WebP as a media column: a writer, and a reader that turns files back into pixel arrays.

The reader handles all of the lossless bitstream: simple and normal prefix codes, code-length codes, meta prefix images, back-references
with the two-dimensional distance map, the colour cache, and the predictor, cross-colour, subtract-green and palette
transforms. Pixels are unsigned 32-bit numbers 0xAARRGGBB.

A payload of bytes is stored as a picture of a byte a pixel, row by row. Repetitions are back-references, prefix codes are fitted to them and to what
is left, and where up to 16 different bytes occur they are a palette, which packs two to eight pixels in one. Text has no use for the predictor,
cross-colour and cache: neighbouring letters do not foretell each other by sums, and a byte's code is as short as that of a place in a cache. So the
writer leaves those out, and the reader has them for other files. Images without a cache are read a stretch of bit positions at once, those with
one, and small ones, pixel by pixel.

Defined results: a null or empty text is a payload of 64 zero bytes. Texts of any length are stored whole, whatever their length in the same way. Where no
width divides the payload evenly, the last row has pixels of zero bytes beyond it and a chunk of the file holds the payload's length; a payload of over
2^28 bytes is stored as several files one behind the other.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposark.llm.common import map_batches, map_texts, needed, sha256

SIGNATURE = 0x2F
LARGEST_SIDE = 1 << 14
PREDICT, CROSS, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
LENGTH_SYMBOLS, DISTANCE_SYMBOLS = 24, 40
LONGEST_CODE = 15

# The order in which the format writes the lengths of the code-length code.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)

# The format's (x, y) for the distance codes 1 to 120.
DISTANCE_MAP = (
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3),
    (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0),
    (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2), (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5), (8, 0), (4, 7), (-4, 7), (7, 4),
    (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
)


# --- bits and prefix codes ----------------------------------------------------------------------------------------------


class Bits:
    """Bits of a file, least significant first."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def read(self, n: int) -> int:
        at = self.at
        self.at += n
        first, last = at >> 3, (at + n + 7) >> 3
        if last > len(self.data) + 8:
            raise ValueError("the file ends too early")
        return int.from_bytes(self.data[first:last], "little") >> (at & 7) & ((1 << n) - 1)


#: 15-bit numbers with their bits in reverse.
REVERSED = [int(f"{k:015b}"[::-1], 2) for k in range(1 << LONGEST_CODE)]


def code_words(lengths: list[int]) -> dict[int, int]:
    """The canonical code word of each symbol that has one, bits in the order in which the file has them (first bit lowest)."""
    used = sorted((n, s) for s, n in enumerate(lengths) if n)
    out, code, last = {}, 0, used[0][0] if used else 0
    for n, s in used:
        code <<= n - last
        last = n
        out[s] = REVERSED[code] >> LONGEST_CODE - n
        code += 1
    return out


@functools.lru_cache(LONGEST_CODE + 1)
def mirrored(width: int) -> np.ndarray:
    """Numbers of so many bits with their bits in reverse."""
    return np.array(REVERSED[: 1 << width]) >> LONGEST_CODE - width


class Prefix:
    """A prefix code as a table by the next `width` bits: 16 times the symbol, plus the bits that it takes."""

    def __init__(self, lengths: list[int]) -> None:
        self.lengths = tuple(lengths)
        used = sorted([n << 16 | s for s, n in enumerate(lengths) if n])
        if len(used) < 2:  # a single symbol takes no bits
            self.width, self.only = 0, used[0] & 0xFFFF if used else 0
            self.looked_up = np.array([self.only << 4], np.int32)
            return
        coded = np.array(used)
        sizes = coded >> 16
        if int((1 << LONGEST_CODE - sizes).sum()) != 1 << LONGEST_CODE:
            raise ValueError("a prefix code is not complete")
        self.only = -1
        self.width = used[-1] >> 16
        # canonical words ascend in this order, so with the first bit highest each has the places behind the one before
        each = ((coded & 0xFFFF) << 4 | sizes).astype(np.int32)
        self.looked_up = each.repeat(1 << self.width - sizes).take(mirrored(self.width), mode="clip")

    @functools.cached_property
    def entries(self) -> list[int]:
        return self.looked_up.tolist()

    def read(self, bits: Bits) -> int:
        if not self.width:
            return self.only
        peek = bits.read(self.width)
        entry = int(self.looked_up[peek])
        bits.at += (entry & 15) - self.width
        return entry >> 4


@functools.lru_cache(64)
def prefix(lengths: tuple[int, ...]) -> Prefix:
    return Prefix(list(lengths))


#: By alphabet, the codes read last: bits they take in the file, those bits as a number, and the code.
_recent: dict[int, list[tuple[int, int, Prefix]]] = {}


def read_code(bits: Bits, alphabet: int) -> Prefix:
    """The next code of a file. Files often repeat a code, so one whose bits were read just before is not read again."""
    known = _recent.setdefault(alphabet, [])
    at = bits.at
    for n, value, code in known:
        if bits.at + n <= 8 * len(bits.data) and bits.read(n) == value:
            return code
        bits.at = at
    code = _read_code(bits, alphabet)
    n, bits.at = bits.at - at, at
    known.insert(0, (n, bits.read(n), code))
    del known[3:]
    return code


def _read_code(bits: Bits, alphabet: int) -> Prefix:
    lengths = [0] * alphabet
    if bits.read(1):  # simple: one or two symbols
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.read(8)] = 1
        return prefix(tuple(lengths))
    own = [0] * 19
    for k in range(4 + bits.read(4)):
        own[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = prefix(tuple(own))
    most = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    # the lengths take few bits: they are read off one number
    first = bits.at >> 3
    ahead, moved = int.from_bytes(bits.data[first : first + 2 * alphabet + 8], "little") >> (bits.at & 7), 0
    entries, mask = code.entries, (1 << code.width) - 1
    at, previous = 0, 8
    while at < alphabet and most:
        most -= 1
        x = entries[ahead & mask]
        size = x & 15
        x >>= 4
        ahead >>= size
        moved += size
        if x < 16:
            lengths[at] = x
            at += 1
            previous = x or previous
            continue
        extra = (2, 3, 7)[x - 16]
        n = (3, 3, 11)[x - 16] + (ahead & (1 << extra) - 1)
        ahead >>= extra
        moved += extra
        if at + n > alphabet:
            raise ValueError("too many code lengths")
        if x == 16:
            lengths[at : at + n] = [previous] * n
        at += n
    bits.at += moved
    if bits.at > 8 * len(bits.data) + 64:
        raise ValueError("the file ends too early")
    return prefix(tuple(lengths))


def code_lengths(counts: dict[int, int], longest: int = LONGEST_CODE) -> dict[int, int]:
    """Lengths of a Huffman code of at least two symbols; counts are levelled until no length is over the longest."""
    least = 1
    symbols = sorted(counts)
    while True:
        heap = [max(counts[s], least) << 16 | i for i, s in enumerate(symbols)]  # a count and a node in one number
        heapq.heapify(heap)
        above = [0] * (2 * len(symbols) - 1)  # the node over each node; leaves come first, the root last
        for node in range(len(symbols), len(above)):
            n = heapq.heappop(heap)
            m = heap[0]
            above[n & 0xFFFF] = above[m & 0xFFFF] = node
            heapq.heapreplace(heap, (n >> 16) + (m >> 16) << 16 | node)
        depth = [0] * len(above)
        for node in range(len(above) - 2, -1, -1):
            depth[node] = depth[above[node]] + 1
        lengths = dict(zip(symbols, depth, strict=False))
        if max(lengths.values()) <= longest:
            return lengths
        least = max(2 * least, max(counts.values()) >> longest)


# --- reader -------------------------------------------------------------------------------------------------------------


def _subsampled(n: int, bits: int) -> int:
    return (n + (1 << bits) - 1) >> bits


def _extra(bits: Bits, symbol: int) -> int:
    """The number that a length or distance prefix and its extra bits stand for."""
    if symbol < 4:
        return symbol + 1
    n = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << n) + bits.read(n) + 1


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """One entropy-coded image as uint32 pixels in a row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    meta, meta_bits, groups = None, 0, 1
    if main and bits.read(1):
        meta_bits = bits.read(3) + 2
        meta = (read_image(bits, _subsampled(width, meta_bits), _subsampled(height, meta_bits), main=False) >> 8 & 0xFFFF).tolist()
        groups = max(meta) + 1
    alphabets = (256 + LENGTH_SYMBOLS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCE_SYMBOLS)
    codes = [[read_code(bits, n) for n in alphabets] for _ in range(groups)]
    total = width * height
    if meta is None and not cache_bits and codes[0][0].width and total > FEW_PIXELS:
        return _without_cache(bits, codes[0], width, total)
    out = np.zeros(total, np.uint32)
    cache = [0] * (1 << cache_bits) if cache_bits else []
    cached = at = 0
    per_row = _subsampled(width, meta_bits) if meta else 0
    while at < total:
        green, red, blue, alpha, distance = codes[meta[(at // width >> meta_bits) * per_row + (at % width >> meta_bits)] if meta else 0]
        s = green.read(bits)
        if s < 256:
            r = red.read(bits)
            b = blue.read(bits)
            out[at] = alpha.read(bits) << 24 | r << 16 | s << 8 | b
            at += 1
        elif s < 256 + LENGTH_SYMBOLS:
            n = _extra(bits, s - 256)
            d = _extra(bits, distance.read(bits))
            if d > len(DISTANCE_MAP):
                d -= len(DISTANCE_MAP)
            else:
                x, y = DISTANCE_MAP[d - 1]
                d = max(1, x + y * width)
            if d > at or at + n > total:
                raise ValueError("a back-reference leaves the image")
            for k in range(at, at + n):  # source and target may overlap
                out[k] = out[k - d]
            at += n
        else:
            while cached < at:
                x = int(out[cached])
                cache[(0x1E35A7BD * x & 0xFFFFFFFF) >> (32 - cache_bits)] = x
                cached += 1
            out[at] = cache[s - 256 - LENGTH_SYMBOLS]
            at += 1
        # the cache takes every pixel in order, the copied ones too; it is filled up when it is read
    return out


#: Images of up to so many pixels, palettes above all, are read pixel by pixel.
FEW_PIXELS = 256
#: Bytes of a file whose bit positions are looked up at once.
STRETCH = 1 << 16
#: By length or distance prefix: the least number that it stands for, and its extra bits.
PREFIXES = np.array([k + 1 if k < 4 else ((2 + (k & 1)) << (k - 2 >> 1)) + 1 for k in range(DISTANCE_SYMBOLS)])
PREFIX_BITS = np.array([0 if k < 4 else k - 2 >> 1 for k in range(DISTANCE_SYMBOLS)])


def followed(steps: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """The places that one comes to from a start by the steps from each place on, and where one is when they end. Eight steps at once are
    followed one after the other, and what lies between is looked up for all of them together."""
    n = len(steps)
    one = np.arange(n + 1)  # place n is all that lies beyond; taking from "clip" saves numpy a check, all places being inside
    one[:n] += steps
    np.minimum(one, n, out=one)
    two = one.take(one, mode="clip")
    four = two.take(two, mode="clip")
    eight = memoryview(four.take(four, mode="clip"))
    at, starts = start, []
    while at < n:
        starts.append(at)
        at = eight[at]
    places = np.empty((len(starts), 8), np.int64)
    places[:, 0] = starts
    places[:, 4] = four.take(places[:, 0])
    places[:, 2::4] = two.take(places[:, ::4])
    places[:, 1::2] = one.take(places[:, ::2])
    places = places.reshape(-1)
    places = places[: int(np.searchsorted(places, n))]
    return places, int(places[-1] + steps[places[-1]]) if len(places) else start


def _without_cache(bits: Bits, codes: list[Prefix], width: int, total: int) -> np.ndarray:
    """Pixels of an image of one group of codes and no cache. What each bit position would begin is looked up for a stretch of them at
    once, the positions that do begin something are followed in order, and the copies are resolved together at the end."""
    green, red, blue, alpha, distance = codes
    near = near_distances(width)
    lengths: list[np.ndarray] = []
    back: list[np.ndarray] = []
    literals: list[np.ndarray] = []
    done = 0
    while done < total:
        first = bits.at >> 3
        if first >= len(bits.data):
            raise ValueError("the file ends too early")
        data = bits.data[first : first + STRETCH + 16]
        # the 57 bits or more from each bit on
        peek = np.ndarray((len(data) + 16,), "<i8", data + b"\0" * 24, strides=(1,)).repeat(8)
        peek.reshape(-1, 8)[:] >>= np.arange(8)
        end = 8 * min(STRETCH, len(data))

        def look(code: Prefix, at: np.ndarray, peek: np.ndarray = peek) -> np.ndarray:
            return code.looked_up.take(peek.take(at) & (1 << code.width) - 1, mode="clip")

        entry = green.looked_up.take(peek[:end] & (1 << green.width) - 1, mode="clip")
        step = entry & 15
        for code in (red, blue, alpha):
            if code.width:
                step += np.where(entry < 256 << 4, look(code, np.arange(end) + step) & 15, 0)
        copies = np.flatnonzero(entry >= 256 << 4)
        away = step.take(copies) + PREFIX_BITS.take((entry.take(copies) >> 4) - 256)
        far = look(distance, copies + away)
        step[copies] = away + (far & 15) + PREFIX_BITS.take(far >> 4)
        begun, position = followed(step, bits.at & 7)
        entry = entry.take(begun)
        symbol = entry >> 4
        at = begun + (entry & 15)
        copied = np.flatnonzero(symbol >= 256)
        length = np.ones(len(begun), np.int64)
        distances = np.zeros(len(begun), np.int64)
        kind = symbol.take(copied) - 256
        place = at.take(copied)
        n = PREFIX_BITS.take(kind)
        length[copied] = PREFIXES.take(kind) + (peek.take(place) & (1 << n) - 1)
        place += n
        far = look(distance, place)
        place += far & 15
        far >>= 4
        d = PREFIXES.take(far) + (peek.take(place) & (1 << PREFIX_BITS.take(far)) - 1)
        distances[copied] = np.where(d > len(near), d - len(near), near.take(d - 1, mode="clip"))
        value = symbol.astype(np.uint32) << np.uint32(8)
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if code.width:
                s = look(code, at)
                at = at + (s & 15)
                value |= (s >> 4).astype(np.uint32) << np.uint32(shift)
            else:
                value |= np.uint32(code.only << shift)
        until = length.cumsum()
        last = int(np.searchsorted(until, total - done)) + 1
        if last <= len(begun):
            bits.at = 8 * first + (int(begun[last]) if last < len(begun) else position)
        else:
            bits.at = 8 * first + position
        lengths.append(length[:last])
        back.append(distances[:last])
        literals.append(value[:last])
        done += int(until[min(last, len(until)) - 1])
    if done > total or bits.at > 8 * len(bits.data):
        raise ValueError("the pixels leave the image or the file")
    length, distances, value = (np.concatenate(x) if len(x) > 1 else x[0] for x in (lengths, back, literals))
    small = np.int64 if total <= STRETCH else np.int32  # numpy takes from places of 64 bits fastest
    out = value.repeat(length)
    away = distances.astype(small).repeat(length)
    open_ = np.flatnonzero(away).astype(small)
    source = open_ - away.take(open_, mode="clip")
    if len(source) and source.min() < 0:
        raise ValueError("a back-reference leaves the image")
    target = np.arange(total, dtype=small)
    target[open_] = source
    while True:  # each turn doubles the way that a pixel has gone back, until all end at literals
        following = target.take(source, mode="clip")
        if np.array_equal(following, source):
            break
        target[open_] = source = following
    out[open_] = out.take(source, mode="clip")
    return out


def _add(a: int, b: int) -> int:
    """Channel by channel, modulo 256."""
    return ((a & 0xFF00FF00) + (b & 0xFF00FF00) & 0xFF00FF00) | ((a & 0x00FF00FF) + (b & 0x00FF00FF) & 0x00FF00FF)


def _channels(x: int) -> tuple[int, int, int, int]:
    return x >> 24, x >> 16 & 255, x >> 8 & 255, x & 255


def _average(a: int, b: int) -> int:
    return sum(((p + q) // 2) << s for p, q, s in zip(_channels(a), _channels(b), (24, 16, 8, 0), strict=True))


def _clamped(values: list[int]) -> int:
    return sum(min(255, max(0, v)) << s for v, s in zip(values, (24, 16, 8, 0), strict=True))


def predicted(mode: int, left: int, top: int, top_right: int, top_left: int) -> int:
    """What the predictor of a mode says of a pixel inside the image."""
    if mode == 0:
        return 0xFF000000
    if mode == 1:
        return left
    if mode == 2:
        return top
    if mode == 3:
        return top_right
    if mode == 4:
        return top_left
    if mode == 5:
        return _average(_average(left, top_right), top)
    if mode == 6:
        return _average(left, top_left)
    if mode == 7:
        return _average(left, top)
    if mode == 8:
        return _average(top_left, top)
    if mode == 9:
        return _average(top, top_right)
    if mode == 10:
        return _average(_average(left, top_left), _average(top, top_right))
    triples = list(zip(_channels(left), _channels(top), _channels(top_left), strict=True))
    if mode == 11:  # whichever of left and top is nearer to left + top - top-left
        near_left = sum(abs(t - c) for _, t, c in triples)
        near_top = sum(abs(x - c) for x, _, c in triples)
        return left if near_left < near_top else top
    if mode == 12:
        return _clamped([x + t - c for x, t, c in triples])
    if mode == 13:
        halves = [((x + t) // 2, c) for x, t, c in triples]
        return _clamped([a + int((a - c) / 2) for a, c in halves])
    return 0xFF000000


def invert_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, bits: int) -> np.ndarray:
    out = pixels.tolist()
    wide = _subsampled(width, bits)
    for at in range(len(out)):
        x, y = at % width, at // width
        if at == 0:
            p = 0xFF000000
        elif y == 0:
            p = out[at - 1]
        elif x == 0:
            p = out[at - width]
        else:  # the top-right of the last column is the first pixel of this row
            p = predicted(int(modes[(y >> bits) * wide + (x >> bits)]) >> 8 & 15, out[at - 1], out[at - width], out[at - width + 1], out[at - width - 1])
        out[at] = _add(out[at], p)
    return np.array(out, np.uint32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 255).astype(np.uint8).view(np.int8).astype(np.int32)


def cross_colour(pixels: np.ndarray, width: int, elements: np.ndarray, bits: int, sign: int) -> np.ndarray:
    """Add (sign 1, to read) or take away (sign -1, to write) what green and red say of the other channels."""
    at = np.arange(len(pixels))
    e = elements[(at // width >> bits) * _subsampled(width, bits) + (at % width >> bits)]
    red_to_blue, green_to_blue, green_to_red = _signed(e >> 16), _signed(e >> 8), _signed(e)
    green, red, blue = _signed(pixels >> 8), (pixels >> 16 & 255).astype(np.int32), (pixels & 255).astype(np.int32)
    other = red + sign * (green_to_red * green >> 5) & 255
    true_red = other if sign > 0 else red  # always the red of the picture itself
    blue = blue + sign * ((green_to_blue * green >> 5) + (red_to_blue * _signed(true_red.astype(np.uint32)) >> 5)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | other.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def green_shift(pixels: np.ndarray, sign: int) -> np.ndarray:
    green = (pixels >> 8 & 255).astype(np.int64)
    red = (pixels >> 16 & 255).astype(np.int64) + sign * green & 255
    blue = (pixels & 255).astype(np.int64) + sign * green & 255
    return (pixels & np.uint32(0xFF00FF00)) | red.astype(np.uint32) << np.uint32(16) | blue.astype(np.uint32)


def _packing(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def invert_palette(pixels: np.ndarray, width: int, height: int, palette: np.ndarray) -> np.ndarray:
    bits = _packing(len(palette))
    index = (pixels >> 8 & 255).reshape(height, -1)
    if bits:
        each = 8 >> bits
        index = (index[:, :, None] >> (np.arange(1 << bits, dtype=np.uint32) * each)[None, None, :] & ((1 << each) - 1)).reshape(height, -1)[:, :width]
    table = np.zeros(256, np.uint32)
    table[: len(palette)] = palette
    return table[index.reshape(-1)]


def decode(data: bytes) -> np.ndarray:
    """The pixels of a lossless WebP file, as uint32 of height by width."""
    if data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L" or data[20:21] != bytes([SIGNATURE]):
        raise ValueError("not a lossless WebP file")
    if len(data) < 8 + int.from_bytes(data[4:8], "little"):
        raise ValueError("the file ends too early")
    bits = Bits(data[21 : 20 + int.from_bytes(data[16:20], "little")])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo: list[Callable[[np.ndarray], np.ndarray]] = []
    wide = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in (PREDICT, CROSS):
            b = bits.read(3) + 2
            sub = read_image(bits, _subsampled(wide, b), _subsampled(height, b), main=False)
            undo.append((lambda p, w=wide, s=sub, b=b: invert_predictor(p, w, s, b)) if kind == PREDICT else (lambda p, w=wide, s=sub, b=b: cross_colour(p, w, s, b, 1)))
        elif kind == SUBTRACT_GREEN:
            undo.append(lambda p: green_shift(p, 1))
        else:
            n = bits.read(8) + 1
            palette = read_image(bits, n, 1, main=False).tolist()
            for k in range(1, n):
                palette[k] = _add(palette[k], palette[k - 1])
            undo.append(lambda p, w=wide, c=np.array(palette, np.uint32): invert_palette(p, w, height, c))
            wide = _subsampled(wide, _packing(n))
    pixels = read_image(bits, wide, height, main=True)
    for f in reversed(undo):
        pixels = f(pixels)
    return pixels.reshape(height, width)


# --- writer -------------------------------------------------------------------------------------------------------------


#: By how many bits and the number: its bits as text, lowest first. There are none of 0 bits.
SPELLED = [[""], *([f"{value:0{n}b}"[::-1] for value in range(1 << n)] for n in range(1, 9))]


class Writer:
    """Bits as text of 0 and 1 in file order, and behind them numbers."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.last: tuple[np.ndarray, np.ndarray] | None = None

    def write(self, value: int, n: int) -> None:
        self.parts.append(SPELLED[n][value] if n < len(SPELLED) else f"{value:0{n}b}"[::-1])

    def end(self, values: np.ndarray, sizes: np.ndarray) -> None:
        """What comes last: numbers of up to 63 bits, each lowest bit first."""
        self.last = values, sizes

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        packed = np.packbits(np.frombuffer(text.encode(), np.uint8) & 1, bitorder="little").tobytes()
        if self.last is None:
            return packed
        values, sizes = self.last[0].astype(np.uint64), self.last[1]
        until = sizes.cumsum()
        until += len(text)
        total = int(until[-1])
        words = np.zeros((total >> 6) + 2, "<u8")
        words.view(np.uint8)[: len(packed)] = np.frombuffer(packed, np.uint8)
        begins = until - sizes
        word, shift = begins >> 6, begins & 63
        first = np.flatnonzero(word[1:] != word[:-1])
        first += 1
        first = np.append(0, first)
        words[word.take(first)] |= np.bitwise_or.reduceat(values << shift.astype(np.uint64), first)
        over = np.flatnonzero(shift + sizes > 64)  # at most one at each word's end
        words[word.take(over) + 1] |= values.take(over) >> (64 - shift.take(over)).astype(np.uint64)
        return words.tobytes()[: total + 7 >> 3]


def code_text(lengths: list[int]) -> str:
    """A prefix code as bits. Codes of one or two small symbols are simple; others write runs of lengths."""
    out = Writer()
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) <= 2 and all(s < 256 for s in used):
        out.write(1, 1)
        out.write(int(len(used) == 2), 1)
        first = used[0] if used else 0
        out.write(int(first > 1), 1)
        out.write(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.write(used[1], 8)
        return "".join(out.parts)
    runs = [run for x, same in itertools.groupby(lengths) for run in runs_of(x, len(list(same)))]
    counts = dict(Counter([run[0] for run in runs]))
    if len(counts) == 1:
        counts[0 if 0 not in counts else 1] = 0
    own = code_lengths(counts, 7)
    full = [own.get(s, 0) for s in range(19)]
    last = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if full[s])
    out.write(0, 1)
    out.write(max(0, last - 3), 4)
    for k in range(max(4, last + 1)):
        out.write(full[CODE_LENGTH_ORDER[k]], 3)
    out.write(0, 1)
    words = code_words(full)
    spelled = {s: f"{w:0{full[s]}b}"[::-1] for s, w in words.items()}
    out.parts += [spelled[s] + SPELLED[n][extra] for s, extra, n in runs]
    return "".join(out.parts)


@functools.lru_cache(8192)
def runs_of(x: int, n: int) -> list[tuple[int, int, int]]:
    """How n equal lengths of a code are written: symbols, each with an extra number and the bits of that."""
    runs: list[tuple[int, int, int]] = []
    if x:
        runs.append((x, 0, 0))
        n -= 1
    while n:
        if x and n >= 3:
            k = min(n, 6)
            runs.append((16, k - 3, 2))
        elif not x and n >= 11:
            k = min(n, 138)
            runs.append((18, k - 11, 7))
        elif not x and n >= 3:
            k = min(n, 10)
            runs.append((17, k - 3, 3))
        else:
            k = 1
            runs.append((x, 0, 0))
        n -= k
    return runs


def container(stream: bytes, length: int | None = None) -> bytes:
    """A RIFF file of one VP8L chunk, and a chunk with the payload's length where one is given; other readers pass over that."""
    chunk = b"VP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    if length is not None:
        chunk += LENGTH_CHUNK + (8).to_bytes(4, "little") + length.to_bytes(8, "little")
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def header(out: Writer, width: int, height: int) -> None:
    out.write(SIGNATURE, 8)
    out.write(width - 1, 14)
    out.write(height - 1, 14)
    out.write(1, 1)  # alpha is used
    out.write(0, 3)


#: Bytes that the pixels of one file hold at most, a byte a pixel.
MOST_BYTES = LARGEST_SIDE * LARGEST_SIDE
LENGTH_CHUNK = b"SIZE"
#: Copies reach back within a segment of so many pixels, and have so many pixels at most.
SEGMENT = 1 << 18
LONGEST_COPY = 4096
NEAR = 256


def shape(n_bytes: int) -> tuple[int, int]:
    """Width and height in pixels for a payload of a positive multiple of 64 bytes: the smallest width that divides it, else the smallest that holds it."""
    rows = n_bytes // 64
    least = -(-rows // LARGEST_SIDE)
    widest = LARGEST_SIDE // 64
    if least > widest:
        raise ValueError("the payload is too large for one file")
    wide = next((w for w in range(least, widest + 1) if rows % w == 0), least)
    return 64 * wide, -(-rows // wide)


def payload_of(text: str) -> bytes:
    """A text as UTF-8 with zero bytes up to a positive multiple of 64."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\0" * (-len(raw) % 64 if raw else 64)


def store(payload: bytes, most: int = MOST_BYTES) -> bytes:
    """A payload as a file, or as files of so many bytes each one behind the other."""
    if len(payload) <= most:
        return _store(payload)
    return b"".join(_store(payload[at : at + most]) for at in range(0, len(payload), most))


def _store(payload: bytes) -> bytes:
    """A payload as one file: a picture of a byte a pixel, green. Up to 16 different bytes are a palette, so that several pixels are packed in one.
    What was there before is copied, the rest are literals, under prefix codes fitted to both."""
    if not payload or len(payload) % 64:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    width, height = shape(len(payload))
    beyond = width * height - len(payload)
    pixels = np.frombuffer(payload + b"\0" * beyond, np.uint8)
    out = Writer()
    header(out, width, height)
    colours = np.flatnonzero(np.bincount(pixels, minlength=256))
    packing = _packing(len(colours))
    if packing:
        out.write(1, 1)
        out.write(PALETTE, 2)
        out.write(len(colours) - 1, 8)
        write_image(out, np.diff(colours, prepend=0).astype(np.uint8), len(colours), main=False)
        each, wide = 8 >> packing, _subsampled(width, packing)
        rows = np.zeros((height, wide << packing), np.uint8)
        rows[:, :width] = np.searchsorted(colours, pixels).reshape(height, width)
        pixels = (rows.reshape(height, wide, -1) << (np.arange(1 << packing, dtype=np.uint8) * np.uint8(each))).sum(axis=2, dtype=np.uint8).reshape(-1)
        width = wide
    out.write(0, 1)
    write_image(out, pixels, width, main=True)
    return container(out.bytes(), len(payload) if beyond else None)


def copies_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where a greedy parse of pixels begins something, and its length and distance there (1 and 0 for a literal)."""
    n = len(x)
    length, distance = np.ones(n, np.int64), np.zeros(n, np.int64)
    if n >= 8:
        # four bytes and their place in one number, so that places of equal bytes are in order
        ordered = np.ndarray((n - 3,), "<u4", x.tobytes(), strides=(1,)).astype(np.uint64)
        ordered <<= np.uint64(32)
        ordered |= np.arange(n - 3, dtype=np.uint64)
        ordered.sort()
        same = np.flatnonzero((ordered[1:] ^ ordered[:-1]) < np.uint64(1 << 32))
        order = (ordered & np.uint64(0xFFFFFFFF)).view(np.int64)
        later = order.take(same + 1)
        away = np.zeros(n, np.int64)
        away[later] = later - order.take(same)
        # where neighbours have the same distance, what is copied goes on
        place = np.arange(n - 3)
        found = np.full(n - 3, n - 4)
        np.copyto(found[:-1], place[:-1], where=away[1 : n - 3] != away[: n - 4])
        found = np.minimum.accumulate(found[::-1])[::-1]
        found -= place - 4
        np.minimum(found, LONGEST_COPY, out=found)
        # a copy takes about as many bits as three literals, and more from far away
        worth = found > np.where(away[: n - 3] < NEAR, 4, 5)
        worth &= away[: n - 3] > 0
        np.copyto(length[: n - 3], found, where=worth)
        distance = away
    begun, _ = followed(length, 0)
    length = length.take(begun)
    return begun, length, np.where(length > 1, distance.take(begun), 0)


def literals_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.arange(len(x)), np.ones(len(x), np.int64), np.zeros(len(x), np.int64)


def prefixed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The prefix symbol of each number from 1 on, its extra bits, and how many they are."""
    symbol = np.searchsorted(PREFIXES, values, "right") - 1
    return symbol, values - PREFIXES.take(symbol), PREFIX_BITS.take(symbol)


def _fitted(counts: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    """The lengths of a prefix code for symbols of these counts, and each symbol's word and length as written."""
    known = np.flatnonzero(counts)
    used = dict(zip(known.tolist(), counts.take(known).tolist(), strict=True))
    if not used:
        used = {0: 1}
    if len(used) == 1:
        only = next(iter(used))
        if only < 256:  # a simple code of one symbol takes no bits
            return [int(s == only) for s in range(len(counts))], np.zeros(len(counts), np.int64), np.zeros(len(counts), np.int64)
        used[0] = 0
    fitted = code_lengths(used)
    lengths = [0] * len(counts)
    for s, k in fitted.items():
        lengths[s] = k
    words = np.zeros(len(lengths), np.int64)
    coded = code_words(lengths)
    words[list(coded)] = list(coded.values())
    return lengths, words, np.array(lengths)


def write_image(out: Writer, pixels: np.ndarray, width: int, main: bool) -> None:
    """An image whose pixels differ in green alone; the other channels are 0."""
    parts = [copies_of(pixels[i : i + SEGMENT]) for i in range(0, len(pixels), SEGMENT)] if main else [literals_of(pixels)]
    begun, length, distance = parts[0]
    if len(parts) > 1:
        begun = np.concatenate([p[0] + i * SEGMENT for i, p in enumerate(parts)])
        length, distance = (np.concatenate([p[k] for p in parts]) for k in (1, 2))
    copied = np.flatnonzero(distance)
    green = pixels.take(begun).astype(np.int64)
    symbol, extra, n_extra = prefixed(length.take(copied))
    green[copied] = 256 + symbol
    near = near_codes(width)
    d = distance.take(copied)
    far, far_extra, n_far = prefixed(np.where(d < len(near), near.take(d, mode="clip"), d + len(DISTANCE_MAP)))
    green_code, green_words, green_sizes = _fitted(np.bincount(green, minlength=256 + LENGTH_SYMBOLS))
    far_code, far_words, far_sizes = _fitted(np.bincount(far, minlength=DISTANCE_SYMBOLS))
    out.write(0, 1)  # no colour cache
    if main:
        out.write(0, 1)  # no meta prefix image
    out.parts.append(code_text(green_code) + 3 * NO_CHANNEL + code_text(far_code))
    value, size = green_words.take(green), green_sizes.take(green)
    at = size.take(copied)
    more = extra << at
    at = at + n_extra
    more |= far_words.take(far) << at
    at = at + far_sizes.take(far)
    value[copied] |= more | far_extra << at
    size[copied] = at + n_far
    if main:
        out.end(value, size)
    else:
        out.parts.append(_bit_text(value, size))


@functools.lru_cache(256)
def near_codes(width: int) -> np.ndarray:
    """By distance, as far as the map goes in an image of this width, its code; the first one of several."""
    ways = [max(1, x + y * width) for x, y in DISTANCE_MAP]
    out = np.arange(max(ways) + 1) + len(DISTANCE_MAP)
    for k in range(len(ways), 0, -1):
        out[ways[k - 1]] = k
    return out


@functools.lru_cache(256)
def near_distances(width: int) -> np.ndarray:
    return np.array([max(1, x + y * width) for x, y in DISTANCE_MAP])


#: A channel that is 0 everywhere.
NO_CHANNEL = code_text([1] + [0] * 255)
#: Numbers whose bits are laid out at once.
NUMBERS = 1 << 15


def _bit_text(values: np.ndarray, sizes: np.ndarray) -> str:
    """Numbers of up to 63 bits as text of 0 and 1, each lowest bit first."""
    parts = []
    for i in range(0, len(values), NUMBERS):
        v, n = values[i : i + NUMBERS], sizes[i : i + NUMBERS]
        begins = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begins, n)
        parts.append((np.repeat(v, n) >> place & 1).astype(np.uint8) + 48)
    return np.concatenate(parts).astype(np.uint8).tobytes().decode("ascii") if parts else ""


def files_of(data: bytes) -> list[bytes]:
    """The files that stand one behind the other; what follows the last one stays with it."""
    out, at = [], 0
    while True:
        end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if data[end : end + 4] != b"RIFF":
            return [*out, data[at:]]
        out.append(data[at:end])
        at = end


def read_payload(data: bytes) -> bytes:
    return b"".join(map(_read_payload, files_of(data)))


def _read_payload(data: bytes) -> bytes:
    samples = (decode(data).reshape(-1) >> np.uint32(8)).astype(np.uint8)
    n = int.from_bytes(data[16:20], "little")
    own = data[20 + n + (n & 1) :]
    return samples.tobytes()[: int.from_bytes(own[8:16], "little") if own[:4] == LENGTH_CHUNK else None]


def media(text: str) -> tuple[int, bytes, bytes]:
    """Bytes of the text, the stored file, and the payload read back from it."""
    payload = payload_of(text)
    data = store(payload)
    return len(text.encode("utf-8", "surrogatepass")), data, read_payload(data)


def feature_text(payload: bytes) -> str:
    """Mean and spread of the samples, and the most frequent one, of the payload read back."""
    samples = np.frombuffer(payload, np.uint8)
    n = len(samples)
    counts = np.bincount(samples, minlength=256)
    values = np.arange(256)
    total, squares = int((counts * values).sum()), int((counts * values * values).sum())
    return f"mean={total / n:.4f};variance={squares / n - (total / n) ** 2:.4f};mode={int(counts.argmax())};distinct={int((counts > 0).sum())}"


def media_features(docs: DataFrame) -> DataFrame:
    """doc_id and what is known of each text's file: sizes, digests, the checksum of its last 64 payload bytes, and a feature string."""

    def start() -> Callable[[str], tuple]:
        def one(text: str) -> tuple:
            n, data, back = media(text)
            return (n, len(back), sha256(back), zlib.crc32(back[-64:]), len(data), sha256(data), feature_text(back))

        return one

    return map_texts(docs, start, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id and the file of each whole text, as a binary column."""
    return map_texts(docs, lambda: lambda text: (store(payload_of(text)),), "media binary")


def pixel_columns(media: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, width, height and the pixels as bytes (green, red, blue, alpha) of each file, a row for each of several; null where a file is null or no lossless WebP."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    pictures = [decode(x) for x in files_of(data)] if data is not None else []
                except (ValueError, IndexError):
                    pictures = []
                rows = [(p.shape[1], p.shape[0], np.stack([p.reshape(-1) >> s & 255 for s in (8, 16, 0, 24)], 1).astype(np.uint8).tobytes()) for p in pictures] or [(None, None, None)]
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True))], ["doc_id", "width", "height", "pixels"])

    rows = needed(media, "doc_id", column).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("binary").alias("media"))
    return map_batches(rows, run, "doc_id long, width int, height int, pixels binary")
