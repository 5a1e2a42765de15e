import base64
import hashlib
import zlib

import numpy as np
import pytest

from tidemark.llm import webp

#: A one-pixel transparent lossless file, as widely published.
PIXEL = base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")


def image(*shape, colours=256, seed=0):
    return np.random.default_rng(seed).integers(0, colours, (*shape, 3)).astype(np.uint8)


def test_a_published_file():
    assert webp.decode(PIXEL).tolist() == [[[0, 0, 0, 0]]]


@pytest.mark.parametrize("steps", [(), (("green",),), (("cross", 3, -5, 7),), *((("predictor", m),) for m in range(14)), (("predictor", 11), ("cross", 1, 2, 3), ("green",))])
def test_transforms_are_inverted(steps):
    for shape in ((13, 17), (1, 9), (9, 1), (1, 1)):
        pixels = image(*shape)
        back = webp.decode(webp.encode(pixels, steps))
        assert (back[..., :3] == pixels).all() and (back[..., 3] == 255).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    pixels = image(1, colours, seed=colours)[0][np.random.default_rng(1).integers(0, colours, (9, 11))]
    assert (webp.decode(webp.encode(pixels, (("palette",),)))[..., :3] == pixels).all()


def file_of(writer, width, height):
    return webp._file(writer.value.to_bytes(writer.n + 7 >> 3, "little"), width, height)


def put_simple(w, *symbols):
    w.put(1, 1)
    w.put(len(symbols) - 1, 1)
    w.put(1, 1)
    for s in symbols:
        w.put(s, 8)


def put_pair(w, size, pair):
    """A code of two symbols of any alphabet: all lengths zero but these two."""
    lengths = [int(s in pair) for s in range(size)]
    webp._put_code(w, lengths) if max(pair) > 255 else put_simple(w, *pair)


def test_back_references():
    """Four pixels by hand: literal, then a copy of length 3 from one pixel back."""
    w = webp.Writer()
    w.put(0, 3)
    put_pair(w, 280, (7, 258))  # green 7, or length code 2: 3 pixels
    for value in (10, 20, 255):
        put_simple(w, value)
    put_simple(w, 1)  # distance code 1 stands for value 2, the pixel before
    w.put(0, 1)
    w.put(1, 1)
    assert webp.decode(file_of(w, 4, 1)).tolist() == [[[10, 7, 20, 255]] * 4]


def test_colour_cache():
    """A cache of one bit: a literal, then twice the slot that it fell in."""
    w = webp.Writer()
    w.put(0, 1)
    w.put(1, 1)
    w.put(1, 4)
    w.put(0, 1)
    argb = 255 << 24 | 10 << 16 | 7 << 8 | 20
    slot = (webp.HASH * argb & 0xFFFFFFFF) >> 31
    put_pair(w, 282, (7, 280 + slot))
    for value in (10, 20, 255, 0):
        put_simple(w, value)
    for bit in (0, 1, 1):
        w.put(bit, 1)
    assert webp.decode(file_of(w, 3, 1)).tolist() == [[[10, 7, 20, 255]] * 3]


def test_meta_prefix_codes():
    """Two blocks of columns, each with a group of codes of its own."""
    w = webp.Writer()
    w.put(0, 2)
    w.put(1, 1)
    w.put(0, 3)  # blocks of 4 pixels
    w.put(0, 1)
    for pair in ((0, 1), (0,), (0,), (255,), (0,)):
        put_simple(w, *pair)
    w.put(0, 1)
    w.put(1, 1)
    for g in (5, 9):
        for value in (g, g + 1, g + 2, 255, 0):
            put_simple(w, value)
    assert webp.decode(file_of(w, 6, 1)).tolist() == [[[6, 5, 7, 255]] * 4 + [[10, 9, 11, 255]] * 2]


def test_neighbours_by_rule():
    assert len(webp.NEIGHBOURS) == 120 and webp.NEIGHBOURS[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)]


@pytest.mark.parametrize("bad", [b"", b"RIFF", PIXEL[:24], b"RIFF\x04\0\0\0WEBP", PIXEL[:20] + b"\x2e" + PIXEL[21:]])
def test_broken_files(bad):
    with pytest.raises((ValueError, IndexError)):
        webp.decode(bad)


def plain_pixels(data):
    """An independent decoder of one file, pixel by pixel: (pixels as RGB rows, features seen)."""
    class Stream:
        def __init__(self):
            self.bits, self.at = int.from_bytes(data[20:], "little"), 8

        def read(self, n):
            value = self.bits >> self.at & (1 << n) - 1
            self.at += n
            return value

    s, seen = Stream(), set()

    def tree(lengths):
        used = [i for i, n in enumerate(lengths) if n]
        if len(used) == 1:
            return {(0, 0): used[0]}
        out, code = {}, 0
        for n in range(1, 16):
            for i in used:
                if lengths[i] == n:
                    out[n, code] = i
                    code += 1
            code <<= 1
        return out

    def symbol(t):
        n = code = 0
        while (n, code) not in t:
            code, n = code << 1 | s.read(1), n + 1
        return t[n, code]

    def read_tree(size):
        lengths = [0] * size
        if s.read(1):
            two = s.read(1)
            lengths[s.read(8 if s.read(1) else 1)] = 1
            if two:
                lengths[s.read(8)] = 1
            return tree(lengths)
        inner = [0] * 19
        for i in range(4 + s.read(4)):
            inner[webp.LENGTH_ORDER[i]] = s.read(3)
        t, left, at, last = tree(inner), 2 + s.read(2 + 2 * s.read(3)) if s.read(1) else size, 0, 8
        while at < size and left:
            left, c = left - 1, symbol(t)
            if c < 16:
                lengths[at], at, last = c, at + 1, c or last
            else:
                n, value = {16: (2, last), 17: (3, 0), 18: (7, 0)}[c]
                n = s.read(n) + (11 if c == 18 else 3)
                lengths[at : at + n], at = [value] * n, at + n
        return tree(lengths)

    def number():
        c = yield
        n = (c - 2) // 2
        yield c + 1 if c < 4 else ((2 + c % 2) << n) + s.read(n) + 1

    def value(c):
        g = number()
        next(g)
        return g.send(c)

    def image(w, h, main):
        bits = s.read(4) if s.read(1) else 0
        if main:
            assert not s.read(1)
        green, *colors, far = [read_tree(n) for n in (280 + (1 << bits if bits else 0), 256, 256, 256, 40)]
        out, cache = [], [0] * (1 << bits)

        def put(p):
            out.append(p)
            cache[(webp.HASH * p & 0xFFFFFFFF) >> 32 - bits if bits else 0] = p

        while len(out) < w * h:
            g = symbol(green)
            if g < 256:
                r, b, a = map(symbol, colors)
                put(a << 24 | r << 16 | g << 8 | b)
            elif g < 280:
                seen.add("copy")
                n, d = value(g - 256), value(symbol(far))
                d = max(1, webp.NEIGHBOURS[d - 1][0] + webp.NEIGHBOURS[d - 1][1] * w) if d <= 120 else d - 120
                for _ in range(n):
                    put(out[-d])
            else:
                seen.add("cache")
                put(cache[g - 280])
        return [out[y * w : y * w + w] for y in range(h)]

    def split(p):
        return [p >> k & 255 for k in (24, 16, 8, 0)]

    def join(c):
        return c[0] << 24 | c[1] << 16 | c[2] << 8 | c[3]

    def low(x):
        return (x & 255 ^ 128) - 128

    width, height, steps = s.read(14) + 1, s.read(14) + 1, []
    s.read(4)
    wide = width
    while s.read(1):
        kind = ("predictor", "cross", "green", "palette")[s.read(2)]
        seen.add(kind)
        block, extra = 0, None
        if kind in ("predictor", "cross"):
            block = s.read(3) + 2
            extra = image((wide + (1 << block) - 1) >> block, (height + (1 << block) - 1) >> block, False)
        elif kind == "palette":
            n = s.read(8) + 1
            row, total = image(n, 1, False)[0], [0] * 4
            extra = [join(total := [(a + b) & 255 for a, b in zip(total, split(p), strict=True)]) for p in row]
        steps.append((kind, block, extra, wide))
        if kind == "palette":
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            wide = (wide + (1 << pack) - 1) >> pack
    rows = image(wide, height, True)
    for kind, block, extra, wide in reversed(steps):
        if kind == "green":
            rows = [[join([a, r + g & 255, g, b + g & 255]) for a, r, g, b in map(split, row)] for row in rows]
        elif kind == "cross":
            for y, row in enumerate(rows):
                for x, p in enumerate(row):
                    (a, r, g, b), (_, both, to_blue, to_red) = split(p), split(extra[y >> block][x >> block])
                    r = r + (low(to_red) * low(g) >> 5) & 255
                    row[x] = join([a, r, g, b + (low(to_blue) * low(g) >> 5) + (low(both) * low(r) >> 5) & 255])
        elif kind == "palette":
            pack = 3 if len(extra) <= 2 else 2 if len(extra) <= 4 else 1 if len(extra) <= 16 else 0
            rows = [[extra[row[x >> pack] >> 8 + (8 >> pack) * (x % (1 << pack)) & (1 << (8 >> pack)) - 1] for x in range(wide)] for row in rows]
        else:
            for y, row in enumerate(rows):
                for x, p in enumerate(row):
                    up = rows[y - 1]
                    if y and x:
                        l, t, tl, tr = (split(q) for q in (row[x - 1], up[x], up[x - 1], up[x + 1] if x + 1 < wide else row[0]))
                        mean = lambda a, b: [(i + j) // 2 for i, j in zip(a, b, strict=True)]
                        mode = extra[y >> block][x >> block] >> 8 & 15
                        near = sum(abs(i - j) for i, j in zip(t, tl, strict=True)) < sum(abs(i - j) for i, j in zip(l, tl, strict=True))
                        clip = lambda c: [min(255, max(0, v)) for v in c]
                        m = mean(l, t)
                        guess = [[255, 0, 0, 0], l, t, tr, tl, mean(mean(l, tr), t), mean(l, tl), m, mean(tl, t), mean(t, tr), mean(mean(l, tl), mean(t, tr)), l if near else t, clip([i + j - k for i, j, k in zip(l, t, tl, strict=True)]), clip([i + int((i - k) / 2) for i, k in zip(m, tl, strict=True)])][mode]
                    else:
                        guess = split(row[x - 1]) if x else split(up[0]) if y else [255, 0, 0, 0]
                    row[x] = join([(i + j) & 255 for i, j in zip(split(p), guess, strict=True)])
    return bytes(c for row in rows for p in row for c in split(p)[1:]), seen


def payloads(n=40):
    """Texts, repeated lines, noise and constants of several lengths."""
    import random

    from conftest import prose

    rng, draw = random.Random(1), np.random.default_rng(3)
    texts = [prose(rng, rng.choice((20, 200, 900))).encode() for _ in range(n)]
    texts += [b"the same line of words again\n" * 300, b"", b"ab" * 2000, draw.integers(0, 256, 5000).astype(np.uint8).tobytes(), prose(rng, 9000).encode()]
    return [t + b"\xff" * (-len(t) % 576 or 576 * (not t)) for t in texts]


def test_stored_files_against_an_independent_decoder():
    every = set()
    for payload in payloads():
        media = webp.store(payload)
        assert media == webp.store(payload) and webp.payload_of(webp.load(media)) == payload
        again, seen = plain_pixels(media)
        assert again == payload
        every |= seen
    assert every == {"copy", "cache", "predictor", "cross", "green", "palette"}


@pytest.mark.parametrize("block", [300, 1 << 16])
@pytest.mark.parametrize("mode", range(14))
def test_every_mode_and_block_size(mode, block, monkeypatch):
    monkeypatch.setattr(webp, "BLOCK", block)
    rows = np.frombuffer(payloads(1)[-1][: 576 * 70], np.uint8).reshape(-1, 192, 3)
    media = webp.encode(rows, (("predictor", mode), ("cross", 1, -3, 2), ("green",)))
    assert (webp.decode(media)[..., :3] == rows).all()


def test_several_files_for_long_payloads(monkeypatch):
    monkeypatch.setattr(webp, "ROWS", 2)
    payload = bytes(range(256)) * 9
    assert len(list(webp.load(webp.store(payload)))) == 2 and webp.payload_of(webp.load(webp.store(payload))) == payload


def test_memory_of_a_long_text():
    import tracemalloc

    payload = payloads(1)[-1][: 576 * 100] * 200  # 11 MB
    tracemalloc.start()
    media = webp.store(payload)
    assert sum(len(i) for i in webp.load(media)) == len(payload) // 576
    assert tracemalloc.get_traced_memory()[1] < 250e6
    tracemalloc.stop()


def test_features_over_images():
    import itertools

    pixels = image(6, 192)
    whole, parts = webp.Features(), webp.Features()
    whole.add(pixels)
    for row in pixels:
        parts.add(row[None])
    flat = pixels.reshape(-1, 3).tolist()
    same = sum(a == b for p, q in itertools.pairwise(flat) for a, b in zip(p, q, strict=True))
    want = [*np.mean(flat, axis=0), *np.std(flat, axis=0), same / 3 / (len(flat) - 1)]
    assert str(whole) == str(parts) and np.allclose([float(x) for x in str(whole).split()], want, atol=1e-4)


def test_frames(spark, docs, corpus, no_docs, clashing):
    rows = {r.id: r for r in webp.digests(webp.store_texts(docs)).collect()}
    for i, text, *_ in corpus:
        data = (text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or 576 * (not data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert rows[3].feature == rows[100].feature and rows[3].media_sha256 == rows[100].media_sha256
    assert webp.digests(webp.store_texts(no_docs)).count() == 0
    assert sorted(webp.digests(webp.store_texts(clashing)).collect(), key=str) == sorted(webp.digests(webp.store_texts(docs)).collect(), key=str)


def test_decode_column(spark):
    pixels = image(3, 5)
    rows = spark.createDataFrame([(1, webp.encode(pixels)), (2, None), (3, b"junk"), (4, b"")], "doc_id long, media binary")
    got = {r.id: r for r in webp.decode_column(rows, "doc_id", "media").collect()}
    assert (got[1].height, got[1].width) == (3, 5) and np.frombuffer(got[1].pixels, np.uint8).reshape(3, 5, 4)[..., :3].tolist() == pixels.tolist()
    assert got[2].pixels is None and got[3].pixels is None and got[4].pixels is None
