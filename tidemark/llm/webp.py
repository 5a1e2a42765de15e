"""Lossless WebP columns: a decoder of the whole format, and an encoder of byte payloads.

``decode`` reads prefix codes, back-references, colour cache, meta prefix codes and the predictor, cross-colour,
subtract-green and palette transforms, and gives an array of pixels (height, width, RGBA). An image with one group of
codes is decoded in blocks of the stream: the bits that a pixel would take are looked up for every bit position at once,
one pass follows the chain of pixels, and literals, cache hits and copies are then resolved by runs.

``encode`` writes what it reads: copies of earlier pixels, cache hits, and the transforms asked for, with prefix codes
fixed by rule, so equal payloads give equal files. ``store`` cuts a payload into files of at most ``ROWS`` rows. A file
of at most 256 colours has a palette; the others take turns, by a checksum of their bytes, at the transforms of
``TURNS``, so that stored files use the whole format.
"""

from __future__ import annotations

import heapq
import zlib
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Order of the code-length code, alphabet sizes, neighbours of short distance codes by rule, limits.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
NEIGHBOURS = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda n: (n[0] ** 2 + n[1] ** 2, -n[1], -n[0]))
HASH, DEEPEST, LARGEST, LONGEST = 0x1E35A7BD, 15, 1 << 14, 4096
#: A payload is padded to rows of 192 pixels of three bytes, and a file has so many of them at most.
ROW, UNIT, ROWS = 192, 576, 1024
#: Bytes by how common they are in UTF-8 text, most common first, for the encoder's fixed prefix code.
COMMON = (b" e", b"ntaoirhs", b"dlucmgpbfvw\n.", b"y,kzqjx\xc3\xa9\xff", b"ETAOINSRHDLUCMGPFBVWYKZQJX", b"0123456789'\"-:;!?()$%&*#|@/_=+", bytes(range(0x80, 0xC0)), bytes(range(256)))
#: Bits of the encoder's colour cache, pixels of its shortest copy, bytes of a stream that are looked up together.
CACHE, SHORTEST, BLOCK = 8, 16, 1 << 16
#: Transforms that stored files take turns at, none more often, which makes the smallest files of text; a predictor's mode and the factors come from the checksum. Modes whose
#: pixels hang on the pixel to the left in other ways than by a sum are for images of at least ``TALL`` rows, where a
#: diagonal has many pixels.
TURNS = ((), (), (), ("green",), ("predictor",), ("cross",), ("cross", "green"), ("predictor", "cross", "green"))
BY_ROWS, TALL = (0, 1, 2, 3, 4, 8, 9), 64


class Bits:
    """Reads little-endian bits of a byte string; beyond the end there are zeros."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        return value


class Code:
    """A canonical prefix code from the lengths of its symbols; ``table`` has (symbol << 4 | length) by peeked bits."""

    def __init__(self, lengths: list[int]):
        self.lengths = tuple(lengths)
        used = [s for s, n in enumerate(lengths) if n]
        self.single = used[0] if len(used) == 1 else None
        self.deep = 0 if self.single is not None else max((lengths[s] for s in used), default=0)
        if not used:
            self.single, used = 0, []
        table, code = np.zeros(1 << self.deep, np.int32), 0
        if self.single is not None:
            table[:] = self.single << 4
        else:
            for n in range(1, self.deep + 1):
                for s in (s for s in used if lengths[s] == n):
                    if code >> n:
                        raise ValueError("prefix code has too many symbols")
                    table[int(f"{code:0{n}b}"[::-1], 2) :: 1 << n] = s << 4 | n
                    code += 1
                code <<= 1
            if code != 2 << self.deep:
                raise ValueError("prefix code is not complete")
        self.array, self.table, self.sizes, self.symbols = table, table.tolist(), (table & 15).astype(np.uint8), (table >> 4).astype(np.uint16)

    def next(self, bits: Bits) -> int:
        entry = self.table[bits.peek(self.deep)]
        bits.at += entry & 15
        return entry >> 4


def _read_code(bits: Bits, size: int) -> Code:
    lengths = [0] * size
    if bits.read(1):
        symbols = 1 + bits.read(1)
        lengths[bits.read(8 if bits.read(1) else 1)] = 1
        if symbols == 2:
            lengths[bits.read(8)] = 1
        return Code(lengths)
    inner = [0] * 19
    for i in range(4 + bits.read(4)):
        inner[LENGTH_ORDER[i]] = bits.read(3)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    code, at, last = Code(inner), 0, 8
    while at < size and left:
        left -= 1
        s = code.next(bits)
        if s < 16:
            lengths[at] = s
            last, at = s or last, at + 1
        else:
            n, value = (3 + bits.read(2), last) if s == 16 else (3 + bits.read(3), 0) if s == 17 else (11 + bits.read(7), 0)
            if at + n > size:
                raise ValueError("code lengths go beyond the alphabet")
            lengths[at : at + n] = [value] * n
            at += n
    return Code(lengths)


def _group(bits: Bits, cache: int) -> list[Code]:
    return [_read_code(bits, n) for n in (LITERALS + LENGTHS + (1 << cache if cache else 0), LITERALS, LITERALS, LITERALS, DISTANCES)]


def _extra(bits: Bits, prefix: int) -> int:
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


_parsed: dict[int, list[tuple[int, int, list[Code]]]] = {}


def _known_group(bits: Bits, cache: int) -> list[Code]:
    """As ``_group``; the codes of a header seen before are not built again."""
    def upto(n: int) -> int:
        return (int.from_bytes(bits.data[bits.at >> 3 : (bits.at + n + 7 >> 3) + 1], "little") >> (bits.at & 7)) & ((1 << n) - 1)

    held = _parsed.setdefault(upto(96) << 4 | cache, [])
    for n, value, codes in held:
        if upto(n) == value:
            bits.at += n
            return codes
    begin, codes = bits.at, _group(bits, cache)
    n, bits.at = bits.at - begin, begin
    value, bits.at = upto(n), begin + n
    if len(_parsed) > 256 or len(held) > 16:
        _parsed.clear()
    else:
        held.append((n, value, codes))
    return codes


def _copy(bits: Bits, symbol: int, distance: Code, width: int) -> tuple[int, int]:
    """(length, pixels back) of a copy whose length symbol was read."""
    length = _extra(bits, symbol - LITERALS)
    code = _extra(bits, distance.next(bits))
    if code > len(NEIGHBOURS):
        return length, code - len(NEIGHBOURS)
    dx, dy = NEIGHBOURS[code - 1]
    return length, max(1, dx + dy * width)


def _slots(pixels: np.ndarray, cache: int) -> np.ndarray:
    return ((pixels * np.uint32(HASH)) >> np.uint32(32 - cache)).astype(np.int64)


def _read_blocks(bits: Bits, codes: list[Code], total: int, width: int):
    """Green symbols, literal pixels and copies (symbols before, length, pixels back) of a stream, block by block."""
    green, red, blue, alpha, distance = codes
    symbols, literals, copies, n, seen = [], [], [], 0, 0
    place = lambda code, window: window & np.uint32((1 << code.deep) - 1)
    steps = green.sizes.copy()  # bits of a green symbol, plus 64 for a literal; 0 stands for a copy
    steps[green.symbols < LITERALS] += 64
    steps[(green.symbols >= LITERALS) & (green.symbols < LITERALS + LENGTHS)] = 0
    while n < total:
        origin = bits.at >> 3
        if origin > len(bits.data):
            raise ValueError("the stream ends too early")
        raw = np.frombuffer(bits.data[origin : origin + BLOCK + 16] + bytes(24), np.uint8).astype(np.uint32)
        window = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16 | raw[3:] << 24
        flat = (window[:, None] >> np.arange(8, dtype=np.uint32)).reshape(-1)  # 25 bits from each bit position
        limit = min(len(flat) - 128, 8 * BLOCK)
        size = steps.take(place(green, flat))
        plain = np.flatnonzero(size >= 64).astype(np.int32)
        at = plain + (size[plain] - 64)
        for code in (red, blue, alpha):
            if code.single is None:
                at += code.sizes.take(place(code, flat.take(at, mode="clip")))
        size[plain] = at - plain
        size = size.tobytes()
        p, starts = bits.at & 7, []
        hold = starts.append
        while n < total and p < limit:
            hold(p)
            if step := size[p]:
                p += step
                n += 1
            else:
                bits.at = (origin << 3) + p
                length, back = _copy(bits, green.next(bits), distance, width)
                if back > n or n + length > total:
                    raise ValueError("back-reference leaves the image")
                copies.append((seen + len(starts) - 1, length, back))
                p, n = bits.at - (origin << 3), n + length
        seen += len(starts)
        begun = np.array(starts, np.int64)
        index = place(green, flat[begun])
        own = green.symbols[index].astype(np.int64)
        symbols.append(own)
        open_ = own < LITERALS
        begun, pixel = begun[open_] + green.sizes[index[open_]], own[open_].astype(np.uint32) << 8
        for code, shift in ((red, 16), (blue, 0), (alpha, 24)):
            if code.single is not None:
                pixel |= np.uint32(code.single << shift)
            else:
                index = place(code, flat[begun])
                pixel, begun = pixel | code.symbols[index].astype(np.uint32) << shift, begun + code.sizes[index]
        literals.append(pixel)
        bits.at = (origin << 3) + p
    return np.concatenate(symbols), np.concatenate(literals), copies


def _resolved(symbols: np.ndarray, literals: np.ndarray, copies: list[tuple[int, int, int]], total: int, cache: int) -> np.ndarray:
    """Pixels from what ``_read_blocks`` gives: runs of literals and cache hits, and the copies between them."""
    out, n, taken, held = np.zeros(total, np.uint32), 0, 0, np.zeros(1 << cache if cache else 0, np.uint32)

    def run(part: np.ndarray) -> None:
        nonlocal n, taken
        plain = part < LITERALS
        count, own = int(plain.sum()), out[n : n + len(part)]
        values = literals[taken : taken + count]
        own[plain] = values
        if cache and count < len(part):
            hits, at = np.flatnonzero(~plain), np.flatnonzero(plain)
            slot, wide = part[hits] - LITERALS - LENGTHS, len(part) + 1
            keys = np.sort(_slots(values, cache) * wide + at) if count else np.zeros(0, np.int64)
            found = np.searchsorted(keys, slot * wide + hits) - 1
            last = keys[np.maximum(found, 0)] if count else np.full(len(hits), -1)
            near = (found >= 0) & (last // wide == slot)
            own[hits] = np.where(near, own[np.where(near, last % wide, 0)], held[slot])
        n, taken = n + len(part), taken + count

    begin, inserted = 0, 0
    for at, length, back in copies:
        run(symbols[begin:at])
        source = out[n - back : min(n, n - back + length)]
        out[n : n + length] = source if back >= length else np.resize(source, length)
        n, begin = n + length, at + 1
        if cache:
            held[_slots(out[inserted:n], cache)] = out[inserted:n]  # of equal slots the last pixel stays
            inserted = n
    run(symbols[begin:])
    return out


def _image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Pixels (height, width) as ARGB words of an entropy-coded image."""
    cache = bits.read(4) if bits.read(1) else 0
    if cache > 11:
        raise ValueError("a colour cache has at most 11 bits")
    total = width * height
    if not (main and bits.read(1)):
        codes = _known_group(bits, cache)
        if all(c.single is not None for c in codes[:4]) and codes[0].single < LITERALS:
            green, red, blue, alpha, _ = (c.single for c in codes)
            return np.full((height, width), alpha << 24 | red << 16 | green << 8 | blue, np.uint32)
        if codes[0].single is None or codes[0].single < LITERALS:
            return _resolved(*_read_blocks(bits, codes, total, width), total, cache).reshape(height, width)
        block, at_group, groups = 0, None, [codes]
    else:
        block = bits.read(3) + 2
        at_group = _image(bits, (width + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False) >> 8 & 0xFFFF
        groups = [_group(bits, cache) for _ in range(int(at_group.max()) + 1)]
    out, n, slots = [0] * total, 0, [0] * (1 << cache) if cache else []
    kept, shift = 0, 32 - cache
    green, red, blue, alpha, distance = groups[0]
    while n < total:
        if at_group is not None:
            y, x = divmod(n, width)
            green, red, blue, alpha, distance = groups[int(at_group[y >> block, x >> block])]
        s = green.next(bits)
        if s < LITERALS:
            r = red.next(bits)
            b = blue.next(bits)
            out[n] = alpha.next(bits) << 24 | r << 16 | s << 8 | b
            n += 1
        elif s < LITERALS + LENGTHS:
            length, back = _copy(bits, s, distance, width)
            if back > n or n + length > total:
                raise ValueError("back-reference leaves the image")
            for _ in range(length):
                out[n] = out[n - back]
                n += 1
        else:
            for kept in range(kept, n):
                slots[(HASH * out[kept] & 0xFFFFFFFF) >> shift] = out[kept]
            kept = n
            out[n] = slots[s - LITERALS - LENGTHS]
            n += 1
    return np.array(out, np.uint32).reshape(height, width)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(…, 4) bytes A, R, G, B as int64."""
    return np.stack([argb >> s & 0xFF for s in (24, 16, 8, 0)], axis=-1).astype(np.int64)


def _packed(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = (channels[..., i].astype(np.uint32) for i in range(4))
    return a << 24 | r << 16 | g << 8 | b


def predicted(mode, left, top, right_top, left_top):
    """The predictor ``mode`` of one pixel (or arrays of pixels) from its neighbours' channels."""
    half = lambda a, b: (a + b) // 2
    if mode == 11:
        near_left = np.abs(top - left_top).sum(axis=-1, keepdims=True) < np.abs(left - left_top).sum(axis=-1, keepdims=True)
        return np.where(near_left, left, top)
    if mode in (12, 13):
        if mode == 12:
            return np.clip(left + top - left_top, 0, 255)
        middle = half(left, top)
        delta = middle - left_top
        return np.clip(middle + np.where(delta < 0, -(-delta // 2), delta // 2), 0, 255)
    if mode < 5 or mode > 13:
        black = np.broadcast_to(np.array([255, 0, 0, 0]), np.shape(top))
        return {1: left, 2: top, 3: right_top, 4: left_top}.get(mode, black)
    if mode == 10:
        return half(half(left, left_top), half(top, right_top))
    if mode == 5:
        return half(half(left, right_top), top)
    return half(*{6: (left, left_top), 7: (left, top), 8: (left_top, top), 9: (top, right_top)}[mode])


def _unpredict(argb: np.ndarray, modes: np.ndarray, block: int) -> np.ndarray:
    """Add the predictions back: by sums or rows where one mode allows it, else along diagonals.

    A pixel at (y, x) hangs on pixels of smaller x + 2 y only, so all pixels of one such diagonal are done together.
    """
    height, width = argb.shape
    out = _channels(argb)
    out[0, 0, 0] += 255
    out[0] = np.cumsum(out[0], axis=0) & 0xFF
    out[:, 0] = np.cumsum(out[:, 0], axis=0) & 0xFF
    mode = int(modes.flat[0])
    if height == 1 or width == 1:
        return _packed(out)
    if not (modes == mode).all() or mode not in (*BY_ROWS, 14, 15):
        per = np.repeat(np.repeat(modes, 1 << block, axis=0), 1 << block, axis=1)[:height, :width].astype(np.int64)
        single = mode if (modes == mode).all() else None
        for t in range(3, width + 2 * height - 2):
            y = np.arange(max(1, (t - width + 2) // 2), min(height - 1, (t - 1) // 2) + 1)
            x = t - 2 * y
            left, top, left_top = out[y, x - 1], out[y - 1, x], out[y - 1, x - 1]
            corner = np.where((x + 1 < width)[:, None], out[y - 1, np.minimum(x + 1, width - 1)], out[y, 0])
            if single is not None:
                guess = predicted(single, left, top, corner, left_top)
            else:
                own, guess = per[y, x], np.zeros_like(left)
                for m in set(own.tolist()):
                    at = own == m
                    guess[at] = predicted(m, left[at], top[at], corner[at], left_top[at])
            out[y, x] = (out[y, x] + guess) & 0xFF
    elif mode in (0, 14, 15):
        out[1:, 1:, 0] += 255
    elif mode == 1:
        out[1:] = np.cumsum(out[1:], axis=1)
    elif mode == 2:
        out[:, 1:] = np.cumsum(out[:, 1:], axis=0)
    else:
        for y in range(1, height):
            corner = np.concatenate([out[y - 1, 2:], out[y, :1]])
            out[y, 1:] = (out[y, 1:] + predicted(mode, None, out[y - 1, 1:], corner, out[y - 1, :-1])) & 0xFF
    return _packed(out & 0xFF)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.int64) & 0xFF ^ 0x80) - 0x80


def _cross(argb: np.ndarray, factors: np.ndarray, block: int, sign: int) -> np.ndarray:
    """Add (``sign`` 1, decoding) or take away the parts of red and blue that green and red explain."""
    a, r, g, b = (c.squeeze(-1) for c in np.split(_channels(argb), 4, axis=-1))
    y, x = np.indices(argb.shape)
    f = _channels(factors)[y >> block, x >> block]
    part = lambda t, c: _signed(t) * _signed(c) >> 5
    red = r + sign * part(f[..., 3], g) & 0xFF
    blue = b + sign * (part(f[..., 2], g) + part(f[..., 1], red if sign > 0 else r)) & 0xFF
    return _packed(np.stack([a, red, g, blue], axis=-1))


def _unpalette(argb: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
    index = (argb >> 8 & 0xFF).astype(np.int64)
    if pack:
        each, bits = 1 << pack, 8 >> pack
        index = np.stack([index >> bits * i & (1 << bits) - 1 for i in range(each)], axis=-1).reshape(len(argb), -1)[:, :width]
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


def decode(data: bytes) -> np.ndarray:
    """Pixels (height, width, 4) as RGBA bytes of one lossless WebP file. Other or broken files raise ValueError."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at, end = 12, min(len(data), 8 + int.from_bytes(data[4:8], "little"))
    while at + 8 <= end and data[at : at + 4] != b"VP8L":
        at += 8 + (int.from_bytes(data[at + 4 : at + 8], "little") + 1 & ~1)
    if at + 13 > end or data[at + 8] != 0x2F:
        raise ValueError("no lossless image")
    bits = Bits(data[at + 8 : at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")], 8)
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("unknown version")
    undo, wide, seen = [], width, set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise ValueError("a transform stands twice")
        seen.add(kind)
        if kind < 2:
            block = bits.read(3) + 2
            undo.append((kind, block, _image(bits, (wide + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False), wide))
        elif kind == 2:
            undo.append((kind, 0, None, wide))
        else:
            n = bits.read(8) + 1
            steps = _channels(_image(bits, n, 1, False)[0])
            undo.append((kind, 0, _packed(np.cumsum(steps, axis=0) & 0xFF), wide))
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            wide = (wide + (1 << pack) - 1) >> pack
    argb = _image(bits, wide, height, True)
    for kind, block, extra, wide in reversed(undo):
        if kind == 0:
            argb = _unpredict(argb, extra >> 8 & 0xF, block)
        elif kind == 1:
            argb = _cross(argb, extra, block, 1)
        elif kind == 2:
            green = argb >> 8 & 0xFF
            argb = argb & 0xFF00FF00 | ((argb >> 16) + green & 0xFF) << 16 | (argb + green & 0xFF)
        else:
            argb = _unpalette(argb, extra, wide)
    return argb.astype("<u4").view(np.uint8).reshape(height, width, 4)[..., [2, 1, 0, 3]]


class Writer:
    """Writes little-endian bits."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def code_lengths(weights: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of symbols by weight, at most 15 bits (weights are levelled until they fit)."""
    while True:
        heap = [(w, s, (s,)) for s, w in weights.items()]
        heapq.heapify(heap)
        depth = dict.fromkeys(weights, 0)
        while len(heap) > 1:
            (w1, k, a), (w2, _, b) = heapq.heappop(heap), heapq.heappop(heap)
            for s in (*a, *b):
                depth[s] += 1
            heapq.heappush(heap, (w1 + w2, k, a + b))
        if max(depth.values(), default=0) <= DEEPEST:
            return depth
        weights = {s: (w + 1) // 2 for s, w in weights.items()}


def _fixed_lengths() -> list[int]:
    weights: dict[int, int] = {}
    for rank, some in enumerate(COMMON):
        for b in some:
            weights.setdefault(b, 3 ** (len(COMMON) - rank))
    depth = code_lengths(weights)
    return [depth[b] for b in range(256)]


def _put_code(out: Writer, lengths: list[int]) -> None:
    """A prefix code: simple for at most two symbols below 256, else its lengths, each as a 4-bit code."""
    used = [s for s, n in enumerate(lengths) if n]
    if len(used) == 2 and used[1] < 256:
        out.put(0b111 | used[0] << 3 | used[1] << 11, 19)
        return
    if len(used) <= 1:
        symbol = used[0] if used else 0
        out.put(1, 1)
        out.put(0, 1)
        out.put(int(symbol > 1), 1)
        out.put(symbol, 8 if symbol > 1 else 1)
        return
    tokens, at = [], 0  # (symbol, extra bits, their number)
    while at < len(lengths):
        run = next((k for k, n in enumerate(lengths[at:]) if n != lengths[at]), len(lengths) - at)
        if lengths[at] == 0 and run >= 3:
            run = min(run, 138)
            tokens.append((18, run - 11, 7) if run > 10 else (17, run - 3, 3))
        elif at and lengths[at] == lengths[at - 1] and run >= 3:
            run = min(run, 6)
            tokens.append((16, run - 3, 2))
        else:
            run = 1
            tokens.append((lengths[at], 0, 0))
        at += run
    counts: dict[int, int] = {}
    for s, *_ in tokens:
        counts[s] = counts.get(s, 0) + 1
    while max((inner := code_lengths(counts)).values()) > 7:
        counts = {s: (n + 1) // 2 for s, n in counts.items()}
    out.put(0, 1)
    out.put(15, 4)
    for s in LENGTH_ORDER:
        out.put(inner.get(s, 0), 3)
    out.put(0, 1)
    codes = Code([inner.get(s, 0) for s in range(19)])
    for s, extra, n in tokens:
        out.put(codes.table.index(s << 4 | inner[s]), inner[s])
        out.put(extra, n)


def _spelled(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(bits, number of bits) of each symbol of a code; a code of one symbol takes no bits."""
    code, sizes, words = Code(lengths), np.array(lengths, np.int64), np.zeros(len(lengths), np.uint64)
    if code.single is not None:
        return words, np.zeros(len(lengths), np.int64)
    for peeked in range(len(code.table) - 1, -1, -1):
        words[code.table[peeked] >> 4] = peeked & (1 << (code.table[peeked] & 15)) - 1
    return words, sizes


class Alphabet:
    """The codes of one image as the encoder needs them: header and, for each symbol, its bits."""

    def __init__(self, green: list[int], other: tuple[list[int], list[int], list[int]], distance: list[int], cache: int):
        head = Writer()
        head.put(int(cache > 0), 1)
        if cache:
            head.put(cache, 4)
        self.before, self.cache = _words(head), cache
        head = Writer()
        for lengths in (green, *other, distance):
            _put_code(head, lengths)
        self.head = _words(head)
        self.green, (self.red, self.blue, self.alpha), self.distance = _spelled(green), map(_spelled, other), _spelled(distance)


def _only(symbol: int, size: int = 256) -> list[int]:
    return [int(s == symbol) for s in range(size)]


def _weighed(weights: dict[int, int], size: int) -> list[int]:
    depth = code_lengths(weights)
    return [depth.get(s, 0) for s in range(size)]


@lru_cache(maxsize=16)
def fixed_alphabet(kind: str, alphas: tuple[int, ...] = (255,)) -> Alphabet:
    """``text`` for bytes of text, ``flat`` for differences, ``index`` for palette indices, ``plain`` without a cache.

    At most two values of alpha.
    """
    common: dict[int, int] = {}
    for rank, some in enumerate(COMMON):
        for b in some:
            common.setdefault(b, 3 ** (len(COMMON) - rank))
    literals = common if kind == "text" else dict.fromkeys(range(256), 64)
    cache = CACHE if kind in ("text", "flat") else 0
    green = dict(literals)
    if kind != "plain":
        green |= {LITERALS + k: max(1, sum(literals.values()) >> 12) for k in range(LENGTHS)}
    green |= {LITERALS + LENGTHS + k: max(1, sum(literals.values()) >> CACHE) for k in range(1 << cache if cache else 0)}
    color = _only(0) if kind == "index" else _weighed(literals, 256)
    distance = _only(0, DISTANCES) if kind == "plain" else _weighed(dict.fromkeys(range(DISTANCES), 1), DISTANCES)
    return Alphabet(_weighed(green, LITERALS + LENGTHS + (1 << cache if cache else 0)), (color, color, [int(s in alphas) for s in range(256)]), distance, cache)


@lru_cache(maxsize=256)
def constant_alphabet(pixel: int) -> Alphabet:
    """For an image of one colour, whose pixels take no bits."""
    return Alphabet(_only(pixel >> 8 & 0xFF, LITERALS + LENGTHS), (_only(pixel >> 16 & 0xFF), _only(pixel & 0xFF), _only(pixel >> 24)), _only(0, DISTANCES), 0)


def _words(w: Writer) -> tuple[np.ndarray, np.ndarray]:
    """A writer's bits as (words, bits in each), at most 32 in a word."""
    at = range(0, w.n, 32)
    return np.array([w.value >> i & 0xFFFFFFFF for i in at], np.uint64), np.array([min(32, w.n - i) for i in at], np.int64)


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    odd = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.cumprod(np.concatenate(([np.uint64(1)], np.full(ROW * LARGEST // 8, np.uint64(x))))) for x in (odd, pow(odd, -1, 1 << 64)))


def _matches(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """Copies (start, length, pixels back) that don't overlap: at each first place whose next ``SHORTEST`` pixels stood
    before, as many as agree with the first time they stood there."""
    n = len(flat) - SHORTEST + 1
    up, down = _powers()
    if n < 2 or len(flat) >= len(up):
        return []
    with np.errstate(over="ignore"):
        sums = np.concatenate(([np.uint64(0)], np.cumsum(flat.astype(np.uint64) * up[: len(flat)])))
        rolled = (sums[SHORTEST:] - sums[:-SHORTEST]) * down[:n]
    order = np.argsort(rolled)
    ranked = rolled[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    if new.all():
        return []
    groups, first = np.flatnonzero(new), np.empty(n, np.int64)
    first[order] = np.repeat(np.minimum.reduceat(order, groups), np.diff(np.append(groups, n)))
    again, out, done = np.flatnonzero(first < np.arange(n)), [], 0
    while (k := int(np.searchsorted(again, done))) < len(again):
        at = int(again[k])
        source, length, reach = int(first[at]), 0, 64
        while length < len(flat) - at:  # compare ever longer stretches
            upto = min(len(flat) - at, length + reach)
            differs = np.flatnonzero(flat[source + length : source + upto] != flat[at + length : at + upto])
            if len(differs):
                length += int(differs[0])
                break
            length, reach = upto, reach * 4
        if length < SHORTEST:  # another stretch with the same hash
            done = at + 1
            continue
        for k in range(0, length, LONGEST):
            out.append((at + k, min(LONGEST, length - k), at - source))
        done = at + length
    return out


def _prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits, their number) of lengths or distance codes from 1."""
    v = value - 1
    bits = np.where(v > 3, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64) - 1, 0)
    symbol = np.where(v > 3, 2 * bits + 2 + (v >> bits & 1), v)
    return symbol, np.where(v > 3, v & (1 << bits) - 1, 0).astype(np.uint64), bits


def _put_image(out: list, argb: np.ndarray, kind: str, main: bool) -> None:
    """An entropy-coded image without meta codes: (words, sizes) go to ``out``."""
    flat, width = argb.reshape(-1), argb.shape[1]
    one = (flat == flat[0]).all()
    alphabet = constant_alphabet(int(flat[0])) if one else fixed_alphabet(kind, tuple(np.unique(flat >> 24).tolist()))
    out.append(alphabet.before)
    if main:
        out.append((np.zeros(1, np.uint64), np.ones(1, np.int64)))
    out.append(alphabet.head)
    if one:
        return
    copies = np.array(_matches(flat) if main else [], np.int64).reshape(-1, 3)
    open_ = np.ones(len(flat), bool)
    for start, length, _ in copies.tolist():
        open_[start : start + length] = False
    hit = np.zeros(len(flat), bool)
    if alphabet.cache:
        slot = _slots(flat, alphabet.cache)
        order = np.argsort(slot.astype(np.uint16), kind="stable")
        same = (slot[order[1:]] == slot[order[:-1]]) & (flat[order[1:]] == flat[order[:-1]])
        hit[order[1:][same]] = True
    hit &= open_
    plain = open_ & ~hit
    units = np.where(plain, 4, hit.astype(np.int64))
    units[copies[:, 0]] = 4
    at = np.cumsum(units) - units
    words, sizes = np.zeros(int(units.sum()), np.uint64), np.zeros(int(units.sum()), np.int64)

    def put(places: np.ndarray, spelled: tuple[np.ndarray, np.ndarray], symbols: np.ndarray) -> None:
        words[places], sizes[places] = spelled[0][symbols], spelled[1][symbols]

    here, pixels = at[plain], flat[plain]
    put(here, alphabet.green, pixels >> 8 & 0xFF)
    put(here + 1, alphabet.red, pixels >> 16 & 0xFF)
    put(here + 2, alphabet.blue, pixels & 0xFF)
    put(here + 3, alphabet.alpha, pixels >> 24)
    if hit.any():
        put(at[hit], alphabet.green, slot[hit] + LITERALS + LENGTHS)
    if len(copies):
        here, back = at[copies[:, 0]], copies[:, 2]
        symbol, words[here + 1], sizes[here + 1] = _prefix(copies[:, 1])
        put(here, alphabet.green, symbol + LITERALS)
        symbol, words[here + 3], sizes[here + 3] = _prefix(np.where(back == width, 1, np.where(back == 1, 2, back + len(NEIGHBOURS))))
        put(here + 2, alphabet.distance, symbol)
    out.append((words, sizes))


def _packed_bits(parts: list[tuple[np.ndarray, np.ndarray]]) -> bytes:
    """Words of up to 32 bits one after the other."""
    words, sizes = (np.concatenate(x) for x in zip(*parts, strict=True))
    words, sizes = words[sizes > 0], sizes[sizes > 0]
    ends = np.cumsum(sizes)
    begins, total = ends - sizes, int(ends[-1])
    word, shift = begins >> 6, (begins & 63).astype(np.uint64)
    out = np.zeros((total >> 6) + 2, np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    out[word[heads]] = np.bitwise_or.reduceat(words << shift, heads)
    over = np.flatnonzero((begins & 63) + sizes > 64)  # at most one for each word
    out[word[over] + 1] |= words[over] >> (np.uint64(64) - shift[over])
    return out.astype("<u8").tobytes()[: total + 7 >> 3]


def _file(body: bytes, width: int, height: int) -> bytes:
    data = b"\x2f" + ((width - 1) | (height - 1) << 14).to_bytes(4, "little") + body
    padded = data + b"\0" * (len(data) & 1)
    return b"RIFF" + (len(padded) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + padded


def encode(pixels: np.ndarray, transforms: tuple[tuple, ...] = (), kind: str = "flat") -> bytes:
    """A lossless WebP file of opaque RGB pixels, with the codes of ``fixed_alphabet(kind)``.

    ``transforms``, in the order written: ("predictor", mode), ("cross", green_to_red, green_to_blue, red_to_blue),
    ("green",), ("palette",); each with one mode or set of factors for the whole image.
    """
    height, width = pixels.shape[:2]
    if not (1 <= width <= LARGEST and 1 <= height <= LARGEST):
        raise ValueError("an image has 1 to 16384 rows and columns")
    p = pixels.astype(np.uint32)
    argb, out, wide = np.uint32(0xFF000000) | p[..., 0] << 16 | p[..., 1] << 8 | p[..., 2], [], width
    for name, *about in transforms:
        head = Writer()
        head.put(1, 1)
        head.put(("predictor", "cross", "green", "palette").index(name), 2)
        extra, blocks = None, ((height + 511) >> 9, (wide + 511) >> 9)
        if name in ("predictor", "cross"):
            head.put(7, 3)
        if name == "predictor":
            extra = np.full(blocks, 255 << 24 | about[0] << 8, np.uint32)
            c = _channels(argb)
            guess = np.zeros_like(c)
            guess[0, 0] = (255, 0, 0, 0)
            guess[0, 1:], guess[1:, 0] = c[0, :-1], c[:-1, 0]
            if height > 1 and wide > 1:
                corner = np.concatenate([c[:-1, 2:], c[1:, :1]], axis=1)
                guess[1:, 1:] = predicted(about[0], c[1:, :-1], c[:-1, 1:], corner, c[:-1, :-1])
            argb = _packed((c - guess) & 0xFF)
        elif name == "cross":
            red, blue, both = (x & 0xFF for x in about)
            extra = np.full(blocks, 255 << 24 | both << 16 | blue << 8 | red, np.uint32)
            argb = _cross(argb, extra, 9, -1)
        elif name == "green":
            green = argb >> 8 & 0xFF
            argb = argb & 0xFF00FF00 | ((argb >> 16) - green & 0xFF) << 16 | (argb - green & 0xFF)
        else:
            palette, index = np.unique(argb, return_inverse=True)
            if len(palette) > 256:
                raise ValueError("a palette has at most 256 colours")
            head.put(len(palette) - 1, 8)
            extra = _packed(np.diff(_channels(palette), axis=0, prepend=0) & 0xFF).reshape(1, -1)
            pack = 3 if len(palette) <= 2 else 2 if len(palette) <= 4 else 1 if len(palette) <= 16 else 0
            each, bits = 1 << pack, 8 >> pack
            index = np.pad(index.reshape(height, wide), ((0, 0), (0, -wide % each))).reshape(height, -1, each)
            wide, kind = index.shape[1], "index"
            argb = (255 << 24 | (index << bits * np.arange(each)).sum(axis=-1) << 8).astype(np.uint32)
        out.append(_words(head))
        if extra is not None:
            _put_image(out, extra, "plain", False)
    out.append((np.zeros(1, np.uint64), np.ones(1, np.int64)))
    _put_image(out, argb, kind, True)
    return _file(_packed_bits(out), width, height)


def turn(rows: np.ndarray, data: bytes) -> tuple[tuple[tuple, ...], str]:
    """(transforms, kind of codes) of a file of ``rows`` with the bytes ``data``."""
    p = rows.reshape(-1, 3).astype(np.uint32)
    if len(np.unique(p[:, 0] << 16 | p[:, 1] << 8 | p[:, 2])) <= 256:
        return (("palette",),), "index"
    check = zlib.crc32(data)
    names, rest = TURNS[check % len(TURNS)], check // len(TURNS)
    modes = BY_ROWS if len(rows) < TALL else range(14)
    about = {"predictor": (modes[rest % len(modes)],), "cross": (rest % 5 - 2, rest % 7 - 3, rest % 3 - 1), "green": ()}
    return tuple((n, *about[n]) for n in names), "flat" if names else "text"


def store(payload: bytes) -> bytes:
    """A payload of a positive multiple of 576 bytes as files of at most ``ROWS`` rows, one after the other."""
    out = []
    for at in range(0, len(payload), UNIT * ROWS):
        data = payload[at : at + UNIT * ROWS]
        rows = np.frombuffer(data, np.uint8).reshape(-1, ROW, 3)
        out.append(encode(rows, *turn(rows, data)))
    return b"".join(out)


def load(media: bytes):
    """The images of files one after the other, each decoded when it is asked for."""
    at = 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        yield decode(media[at : at + size])
        at += size


def payload_of(images) -> bytes:
    return b"".join(np.ascontiguousarray(i[..., :3]).tobytes() for i in images)


class Features:
    """Mean and deviation of each colour channel, and the share of equal neighbours across, over images in order."""

    def __init__(self):
        self.n, self.same, self.last = 0, 0, None
        self.total, self.square = np.zeros(3, np.int64), np.zeros(3, np.int64)

    def add(self, image: np.ndarray) -> None:
        flat = image[..., :3].reshape(-1, 3)
        counts = [np.bincount(flat[:, c], minlength=256) for c in range(3)]
        self.total += [int(c @ np.arange(256)) for c in counts]
        self.square += [int(c @ np.arange(256) ** 2) for c in counts]
        self.same += np.count_nonzero(flat[1:] == flat[:-1]) + (0 if self.last is None else int((flat[0] == self.last).sum()))
        self.n, self.last = self.n + len(flat), flat[-1]

    def __str__(self) -> str:
        mean = self.total / self.n
        spread = np.sqrt(np.maximum(0, self.square / self.n - mean * mean))
        return " ".join(f"{x:.4f}" for x in (*mean, *spread, self.same / max(1, 3 * (self.n - 1))))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, payload_bytes, media): each row's UTF-8 text, padded with bytes 255, as lossless WebP.

    Null texts are empty; repeated rows and null ids are kept.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, out = batch.slice(at, 256), []
                for text in part.column(1):
                    data = text.as_py().encode("utf-8")
                    payload = data + b"\xff" * (-len(data) % UNIT or UNIT * (not data))
                    out.append((len(data), len(payload), store(payload)))
                n, p, media = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(p, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "payload_bytes", "media"])

    return map_arrow(rows, run, "id long, n_bytes long, payload_bytes long, media binary")


def _row(doc: int | None, height: int | None, width: int | None, pixels: bytes | None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([height], pa.int32()), pa.array([width], pa.int32()), pa.array([pixels], pa.binary())], ["id", "height", "width", "pixels"])


def decode_column(table: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, height, width, pixels): the images of each row's files; a row for each image.

    ``pixels`` has RGBA bytes by rows. Null and empty values give one row with nulls; a broken file gives one after
    the images before it. Repeated rows and null ids are kept.
    """
    rows = table.select(table[id_col].cast("long").alias("id"), table[media_col].cast("binary").alias("media"))

    def run(batches):
        for batch in batches:
            for doc, media in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = 0
                try:
                    for image in load(media.as_py() or b""):
                        found += 1
                        yield _row(doc, *image.shape[:2], image.tobytes())
                except (ValueError, IndexError):
                    found = -1
                if found < 1:
                    yield _row(doc, None, None, None)

    return map_arrow(rows, run, "id long, height int, width int, pixels binary")


def digests(stored: DataFrame) -> DataFrame:
    """What is read back from the rows of ``store_texts``: digests of payload and file, and features of the pixels.

    Every file goes through ``decode``, one image at a time. Repeated rows and null ids are kept; an empty table gives
    an empty one.
    """

    def read_back(media: bytes) -> tuple:
        payload, tail, features = sha256(), b"", Features()
        for image in load(media):
            part = np.ascontiguousarray(image[..., :3]).tobytes()
            payload.update(part)
            tail = (tail + part)[-32:]
            features.add(image)
        return payload.hexdigest(), zlib.crc32(tail), len(media), sha256(media).hexdigest(), str(features)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = zip(*(read_back(media.as_py()) for media in part.column(3)), strict=True)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return map_arrow(stored, run, "id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
