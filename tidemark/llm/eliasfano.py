"""Elias-Fano sequences in memory-mapped files, searched in numpy without decoding them."""

from __future__ import annotations

import atexit
import hashlib
import json
import os
import shutil
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

#: Files whose arrays a process keeps open, values encoded at a time.
OPEN, PART = 4096, 1 << 18
#: Position of the k-th one (0 to 7) in each byte, by rule.
_ONE_OF_BYTE = np.array([[([i for i in range(8) if byte >> i & 1] + [8] * 8)[k] for k in range(8)] for byte in range(256)], np.int64)


def encode(values: np.ndarray) -> dict[str, np.ndarray]:
    """A monotone sequence of non-negative int64, less its first value: low bits packed, high bits in unary, and how
    many ones and zeros stand before each word of these. Works on ``PART`` values at a time."""
    n, base = len(values), int(values[0]) if len(values) else 0
    top = int(values[-1]) - base + 1 if n else 1
    width = max(0, (top // max(1, n)).bit_length() - 2)
    upper = np.zeros(((top - 1 >> width) + n if n else 0) // 64 + 2, np.uint64)
    low = np.zeros((n * width + 63) // 64 + 1, np.uint64)
    for start in range(0, n, PART):
        part = values[start : start + PART] - base
        place = np.arange(start, start + len(part), dtype=np.int64)
        ones = (part >> width) + place
        np.bitwise_or.at(upper, ones >> 6, np.uint64(1) << (ones & 63).astype(np.uint64))
        if width:
            part = (part & ((1 << width) - 1)).astype(np.uint64)
            at = place * width
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            np.bitwise_or.at(low, word, part << shift)
            over = (shift.astype(np.int64) + width) > 64
            np.bitwise_or.at(low, word[over] + 1, part[over] >> (np.uint64(64) - shift[over]))
    before = np.concatenate(([0], np.cumsum(np.bitwise_count(upper), dtype=np.int64)[:-1]))
    zeros = np.arange(len(before), dtype=np.int64) * 64 - before
    return {"upper": upper, "low": low, "before": before.astype(np.uint32), "zeros": zeros.astype(np.uint32), "about": np.array([n, width, base], np.int64)}


def _kth_one(words: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Place of the k-th one (from 0) of each 64-bit word."""
    place = np.zeros(len(words), np.int64)
    for half in (32, 16, 8):
        lower = words & np.uint64((1 << half) - 1)
        count = np.bitwise_count(lower).astype(np.int64)
        beyond = k >= count
        k = k - count * beyond
        place += half * beyond
        words = np.where(beyond, words >> np.uint64(half), lower)
    return place + _ONE_OF_BYTE[(words & np.uint64(255)).astype(np.int64), np.minimum(k, 7)]


class Sequence:
    """Reads what ``encode`` made, many positions or keys at a time; no step depends on how far apart they are, and nothing
    as long as the sequence is held beside it."""

    def __init__(self, parts: dict[str, np.ndarray]):
        self.upper, self.low, self.before, self.zeros = (parts[name] for name in ("upper", "low", "before", "zeros"))
        self.n, self.width, self.base = (int(x) for x in parts["about"])

    def _lows(self, at: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(at), np.int64)
        bit = at * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        two = self.low[word] >> shift | self.low[np.minimum(word + 1, len(self.low) - 1)] << np.uint64(1) << (np.uint64(63) - shift)
        return (two & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        """The values at sorted positions."""
        word = np.searchsorted(self.before, at.astype(np.uint32), "right") - 1
        place = (word << 6) + _kth_one(self.upper[word], at - self.before[word])
        return ((place - at << self.width) | self._lows(at)) + self.base

    def _after_zero(self, zero: np.ndarray) -> np.ndarray:
        """The bit after each of the zeros numbered in order."""
        word = np.searchsorted(self.zeros, zero.astype(np.uint32), "right") - 1  # of one type, else a search copies the whole array
        return (word << 6) + _kth_one(~self.upper[word], zero - self.zeros[word]) + 1

    def _run(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first position, position after the last) of the values with each of the sorted high parts."""
        at, later = np.zeros(len(high), np.int64), int(np.searchsorted(high, 0, "right"))
        at[later:] = self._after_zero(high[later:] - 1)
        shift = (at & 63).astype(np.uint64)
        bits = self.upper[at >> 6] >> shift
        ones = np.bitwise_count(bits & ~(bits + np.uint64(1))).astype(np.int64)
        first = at - high
        last = first + ones
        whole = np.flatnonzero(ones + shift.astype(np.int64) == 64)  # the run goes on in the next word
        last[whole] = self._after_zero(high[whole]) - 1 - high[whole]
        return first, last

    def lower_bound(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position of the successor, whether it equals the key) for sorted keys; the position is n beyond the end."""
        if not self.n:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        keys = keys - self.base
        high, low = keys >> self.width, keys & ((1 << self.width) - 1)
        top = int(self.zeros[-1]) + 64 - int(np.bitwise_count(self.upper[-1]))  # zeros in all, so more than any high part
        place, end = np.full(len(keys), self.n, np.int64), np.full(len(keys), self.n, np.int64)
        inside = slice(*np.searchsorted(high, [0, top]).tolist())
        place[: inside.start] = end[: inside.start] = 0
        place[inside], end[inside] = self._run(high[inside])
        np.minimum(place, self.n, out=place)
        np.minimum(end, self.n, out=end)
        size, same = end - place, np.zeros(len(keys), bool)
        alone = np.flatnonzero(size == 1)
        held, wanted = self._lows(place[alone]), low[alone]
        same[alone] = held == wanted
        place[alone] += held < wanted
        many = going = np.flatnonzero(size > 1)
        a, b, goal = place[many], end[many], low[many]
        while len(going):
            middle = (a + b) >> 1
            less = self._lows(middle) < goal
            a, b = np.where(less, middle + 1, a), np.where(less, b, middle)
            more = a < b
            place[going[~more]] = a[~more]
            going, a, b, goal = going[more], a[more], b[more], goal[more]
        found = many[place[many] < end[many]]
        same[found] = self._lows(place[found]) == low[found]
        return place, same


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write arrays to one file, under another name first, so that a task that runs twice does no harm."""
    system, at = _place(path)
    system.create_dir(os.path.dirname(at), recursive=True)
    offset, about = 0, {}
    for name, array in arrays.items():
        about[name] = (array.dtype.str, offset, len(array))
        offset += -(-array.nbytes // 8) * 8
    head = json.dumps(about).encode()
    head += b" " * (-(len(head) + 8) % 8)
    with system.open_output_stream(part := f"{at}.{uuid.uuid4().hex}") as out:
        out.write(len(head).to_bytes(8, "little") + head)
        for array in arrays.values():
            out.write(array.tobytes() + b"\0" * (-array.nbytes % 8))
    system.move(part, at)


def _copied(system: fs.FileSystem, at: str, path: str) -> str:
    """A copy of a file in the executor's own folder, which Spark deletes with the executor; its workers share it."""
    spark = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
    own = os.path.join(spark or tempfile.gettempdir(), f"tidemark-{hashlib.sha256(path.encode()).hexdigest()}")
    if not os.path.exists(own):
        with system.open_input_stream(at) as source, open(part := f"{own}.{uuid.uuid4().hex}", "wb") as out:
            shutil.copyfileobj(source, out, 1 << 20)
        os.replace(part, own)
        if not spark:
            atexit.register(lambda: os.path.exists(own) and os.remove(own))
    return own


@lru_cache(maxsize=OPEN)
def open_file(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, memory-mapped, so that they take no memory that the system can't have back; where the shared
    folder isn't mounted, they are those of a copy."""
    system, at = _place(path)
    raw = np.memmap(at if isinstance(system, fs.LocalFileSystem) else _copied(system, at, path), np.uint8, "r").view(np.ndarray)
    head = 8 + int.from_bytes(raw[:8].tobytes(), "little")
    about = json.loads(raw[8:head].tobytes())
    return {name: raw[head + offset : head + offset + n * np.dtype(kind).itemsize].view(kind) for name, (kind, offset, n) in about.items()}


@lru_cache(maxsize=4 * OPEN)
def sequence(path: str, name: str) -> Sequence:
    """A named sequence of a file, opened once."""
    return Sequence({k.split(".", 1)[1]: v for k, v in open_file(path).items() if k.startswith(f"{name}.")})


def named(name: str, parts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {f"{name}.{k}": v for k, v in parts.items()}
