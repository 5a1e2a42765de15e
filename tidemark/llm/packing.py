"""Packing token sequences into windows by best-fit decreasing."""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian 32-bit words")
#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a text may be cut without a change of its byte-level BPE ids: before a lone space between two other characters.
LONE_SPACE = re.compile(r"(?<=\S) (?=\S)")
ODD_SPACE = re.compile(r"\s | \s|\A | \Z")
#: Words whose ids one worker keeps, and pieces packed together.
CACHE, TOGETHER = 1 << 16, 1 << 16


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The vocabulary of a ``tokenizers`` file of byte-level BPE, whose ids are also its merge ranks, for tiktoken, and
    the ids of its added tokens."""
    import tiktoken

    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if any(t.get(flag) for t in spec.get("added_tokens", ()) for flag in ("single_word", "lstrip", "rstrip")):
        raise ValueError("added tokens that take in what is beside them aren't known")
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    ranks = {bytes(letters[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={}), special


class Encoder(dict):
    """Ids of a byte-level BPE vocabulary as little-endian 32-bit bytes, word by word with a bounded cache.

    A pre-token of this vocabulary's pattern never reaches over a lone space, it starts with it; so the words'
    ids one after the other are the text's ids. Added tokens that stand in a text have their own ids, and what is
    between them is encoded by itself.
    """

    def __init__(self, path: str):
        super().__init__()
        encoding, special = _encoding(path)
        self._plain, self._special = encoding.encode_ordinary, {t: array("I", [i]).tobytes() for t, i in special.items()}
        self._cut = re.compile(f"({'|'.join(map(re.escape, sorted(special, key=len, reverse=True)))})") if special else None

    def __missing__(self, word: str) -> bytes:
        self[word] = ids = array("I", self._plain(" " + word)).tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if self._cut and any(t in text for t in self._special):
            return b"".join(self._special[part] if i % 2 else self._between(part) for i, part in enumerate(self._cut.split(text)))
        return self._between(text)

    def _between(self, text: str) -> bytes:
        if not text:
            return b""
        if len(self) > CACHE:
            self.clear()
        parts = LONE_SPACE.split(text) if ODD_SPACE.search(text) else text.split(" ")
        return array("I", self._plain(parts[0])).tobytes() + b"".join(map(self.__getitem__, parts[1:]))


class Windows:
    """Open windows by remaining room in a segment tree whose leaves are the rooms 0 to ``size``.

    A leaf holds a stack of windows with that much room, an inner node tells whether any below it is held.
    """

    def __init__(self, size: int):
        self.size, self.base = size, 1 << size.bit_length()
        self.any = bytearray(2 * self.base)
        self.at: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, window: int, room: int) -> None:
        self.at[room].append(window)
        node = room + self.base
        while node and not self.any[node]:
            self.any[node] = 1
            node >>= 1

    def tightest(self, length: int) -> tuple[int, int] | None:
        """Take out a window with the least room that is at least ``length``: (window, room), or None."""
        node = length + self.base
        if not self.any[node]:
            while node > 1 and (node & 1 or not self.any[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.base:
                node = 2 * node + (not self.any[2 * node])
        room = node - self.base
        window = self.at[room].pop()
        if not self.at[room]:
            while node and not (node < self.base and (self.any[2 * node] or self.any[2 * node + 1])):
                self.any[node] = 0
                node >>= 1
        return window, room


def best_fit(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """(window, offset) of each piece, longest pieces first, each into the tightest window that has room."""
    window, offset, open_windows, opened = [0] * len(lengths), [0] * len(lengths), Windows(size), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        if found := open_windows.tightest(n) if n else None:
            at, room = found
        else:
            at, room, opened = opened, size, opened + 1
        window[i], offset[i] = at, size - room
        if room > n:
            open_windows.add(at, room - n)
    return window, offset


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = 1024, end: int = 0) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens): each row's ids and one ``end`` id, cut into full windows and a rest.

    Null texts are empty; every row has at least its end id. Repeated rows and null ids are rows like any other.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    tail = np.array([end], "<u4").tobytes()

    def run(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py()) + tail
                for start in range(0, len(ids), 4 * size):
                    cut = ids[start : start + 4 * size]
                    for column, value in zip(out, (doc, start // 4, len(cut) // 4, zlib.crc32(cut), len(ids) // 4), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    return map_arrow(rows, run, "id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(cut: DataFrame, size: int = 1024) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``: windows of at most ``size`` ids, gapless from offset 0.

    Pieces are dealt evenly by a hash of all their columns and packed in runs of at most ``TOGETHER`` (so memory is
    bounded and only the last windows of each run stay partly empty); what is left over of a run begins the next one.
    Sequence ids are unique, not dense. Equal pieces are pieces like any other, of windows with equal room any may be
    taken, columns besides the named are not read, and an empty table gives an empty one. Lengths and ids come from
    ``pieces``, so only ``id`` may be null.
    """
    columns = ["id", "start", "length", "ids_crc32", "doc_tokens"]
    dealt = cut.repartition(F.xxhash64(*columns)).sortWithinPartitions(*columns)

    def run(batches):
        base = TaskContext.get().partitionId() << 40
        held: list[pa.RecordBatch] = []

        def flush(last: bool):
            nonlocal base, held
            table = pa.Table.from_batches(held)
            whole = table.num_rows if last else table.num_rows // TOGETHER * TOGETHER
            held = table.slice(whole).combine_chunks().to_batches()
            for at in range(0, whole, TOGETHER):
                part = table.slice(at, min(TOGETHER, whole - at))
                window, offset = best_fit(part.column("length").to_pylist(), size)
                yield from part.append_column("sequence_id", pa.array(np.array(window, np.int64) + base)).append_column("offset", pa.array(offset, pa.int64())).combine_chunks().to_batches()
                base += part.num_rows

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TOGETHER:
                yield from flush(False)
        if held:
            yield from flush(True)

    return map_arrow(dealt, run, ", ".join(f"{c} long" for c in [*columns, "sequence_id", "offset"]))
