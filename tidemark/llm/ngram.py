"""Language-model scoring with an Elias-Fano n-gram trie.

Counting, building and scoring are Spark jobs; the trie lies in the shared folder as memory-mapped shards. Level 1 is
the vocabulary: 63-bit XXH64 of each word, with exact counts. A node of level k > 1 is (parent, child): the parent is
the node of the words before the last, and the child is the last word's place among the successors of the parent's
context without its first word (for level 2 its place in the vocabulary). Such keys rise monotonically, shard after
shard; beside them stand the parents that have children and monotone pointers to each one's first child. Counts are
kept as a monotone sequence of sums, smoothed probabilities and back-off masses as 16-bit steps of their logarithm.

Smoothing is interpolated absolute discounting: P(w | c) = max(n(c w) - D, 0) / n(c) + b(c) P(w | c without its first
word), b(c) being what the discounts leave. The unigrams leave the share of words seen once to one unknown word. All
n-grams are kept, those seen once too (``LEAST`` is 1).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, scratch_path, slices
from .eliasfano import encode, named, open_file, save, sequence

ORDER, LEAST, DISCOUNT = 3, 1, 0.6
#: Characters tokenised together, keys held before a task passes them on, steps of a quantised log10, rows of a batch
#: (distinct n-grams are looked up once for each batch), tokens whose n-grams make up a shard (a task builds one at a time).
TOGETHER, HELD, STEP, ROWS, SHARD = 4_000_000, 2_000_000, 4096, 3_000, 2_000_000
END = 0  #: the key of the end of a text in the vocabulary


@dataclass
class Shard:
    path: str
    start: int  # index of its first node
    n: int
    first: int  # its first key
    total: int  # sum of its counts


@dataclass
class Trie:
    """What tasks need to find the trie: a few numbers for each shard."""

    order: int
    discount: float
    tokens: int = 0
    distinct: int = 0
    once: int = 0
    texts: int = 0
    levels: list[list[Shard]] = field(default_factory=list)
    split: list[dict[int, float]] = field(default_factory=list)  # by level: discounted sums of parents that span shards
    widths: list[int] = field(default_factory=list)  # bits of the child in a key


def quantised(p: np.ndarray) -> np.ndarray:
    """Steps of -log10; 65535 stands for zero."""
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 65534), 65535).astype(np.uint16)


def restored(q: np.ndarray) -> np.ndarray:
    return np.where(q == 65535, 0.0, 10.0 ** (-q.astype(np.float64) / STEP))


class Level:
    """One level's shards as one sequence of nodes."""

    def __init__(self, shards: list[Shard]):
        self.shards = [s for s in shards if s.n]
        self.starts = np.array([s.start for s in self.shards], np.int64)
        self.keys = np.array([s.first for s in self.shards], np.int64)

    def _each(self, bounds: np.ndarray, sorted_values: np.ndarray):
        if not len(sorted_values) or not len(bounds):
            return
        of = np.maximum(np.searchsorted(bounds, sorted_values, "right") - 1, 0)
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield self.shards[of[a]], slice(a, b)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Node of each of the sorted keys, -1 where it has none."""
        out = np.full(len(keys), -1, np.int64)
        for shard, part in self._each(self.keys, keys):
            place, same = sequence(shard.path, "keys").lower_bound(keys[part])
            out[part] = np.where(same, place + shard.start, -1)
        return out

    def place(self, keys: np.ndarray) -> np.ndarray:
        """How many nodes have a smaller key than each of the sorted keys."""
        out = np.zeros(len(keys), np.int64)
        for shard, part in self._each(self.keys, keys):
            out[part] = sequence(shard.path, "keys").lower_bound(keys[part])[0] + shard.start
        return out

    def read(self, nodes: np.ndarray, what: str) -> np.ndarray:
        """``keys``, ``counts`` or ``alpha`` of sorted nodes."""
        out = np.zeros(len(nodes), np.int64)
        for shard, part in self._each(self.starts, nodes):
            at = nodes[part] - shard.start
            if what == "counts":
                sums = sequence(shard.path, "sums")
                out[part] = sums.get(at + 1) - sums.get(at)
            elif what == "keys":
                out[part] = sequence(shard.path, "keys").get(at)
            else:
                out[part] = open_file(shard.path)[what][at]
        return out

    def contexts(self, parents: np.ndarray, width: int, pointers: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """(node of the first child, quantised back-off mass) of sorted parents; -1 and 0 (mass one) without children.

        Without ``pointers`` the first child's place is left at 0.
        Only shards that hold children of some parent are looked at.
        """
        first, mass = np.full(len(parents), -1, np.int64), np.zeros(len(parents), np.uint16)
        begins = np.searchsorted(parents, self.keys >> width, "left")
        ends = np.searchsorted(parents, np.append(self.keys[1:] >> width, 1 << 62), "right")
        for i in np.flatnonzero(begins < ends).tolist():
            shard, a = self.shards[i], int(begins[i])
            part = slice(a, int(ends[i]))
            place, same = sequence(shard.path, "parents").lower_bound(parents[part])
            new = same & (first[part] < 0)
            at = place[new]
            if len(at):
                target = np.flatnonzero(new) + a
                first[target] = sequence(shard.path, "pointers").get(at) + shard.start if pointers else 0
                mass[target] = open_file(shard.path)["backoff"][at]
        return first, mass


class Reader:
    """Turns texts into nodes of the levels built so far."""

    def __init__(self, trie: Trie):
        self.trie, self.levels = trie, [Level(s) for s in trie.levels]

    def words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct vocabulary nodes in order, each token's place among them or -1, tokens of each text).

        The end of a text is its last token.
        """
        lengths, index, keys = tokens(texts)
        keys = np.append(keys, END)
        order, node = np.argsort(keys), np.empty(len(keys), np.int64)
        node[order] = self.levels[0].find(keys[order])
        distinct, place = np.unique(node, return_inverse=True)
        if distinct[0] < 0:
            distinct, place = distinct[1:], place - 1
        n = lengths + 1
        out = np.full(int(n.sum()), place[-1], np.int64)
        inner = np.ones(len(out), bool)
        inner[np.cumsum(n) - 1] = False
        out[inner] = place[index]
        return distinct, out, n

    def grams(self, distinct: np.ndarray, place: np.ndarray, lengths: np.ndarray, upto: int, scores: bool = True):
        """For each level from 2 to ``upto``: (keys of its n-grams, in no order), or with ``scores``, by token,
        (back-off mass of the words before, discounted probability of the token after them).

        Lookups are made once for each distinct n-gram, in order. Before a text stands one start symbol, the parent
        numbered as the vocabulary is large; longer contexts begin inside the text.
        """
        begins = np.cumsum(lengths) - lengths
        parents, at = np.append(distinct, self.trie.distinct), place
        child, known = distinct[place], place >= 0
        for k in range(2, upto + 1):
            level, width = self.levels[k - 1] if k - 1 < len(self.levels) else None, self.trie.widths[k - 2]
            before = np.empty(len(at), np.int64)
            before[1:], before[:1] = at[:-1], -1
            before[begins] = len(parents) - 1 if k == 2 else -1
            if k == 3:  # the pair before a text's second token has the start symbol
                before[begins[lengths > 1] + 1] = -1
            valid = (before >= 0) & known
            key = parents[before[valid]] << width | child[valid]
            if level is None:
                yield key
                return
            keys, back = np.unique(key, return_inverse=True)
            nodes = level.find(keys)
            last = scores and k == upto  # nothing is looked up below
            first, mass = level.contexts(parents, width, not last)
            if scores:
                share = np.zeros(len(keys))
                held = nodes >= 0
                share[held] = restored(level.read(nodes[held], "alpha").astype(np.uint16))
                mass = restored(mass)
                for parent, sum_held in self.trie.split[k - 1].items():
                    i = int(np.searchsorted(parents, parent))
                    if i < len(parents) and parents[i] == parent:
                        mass[i] = max(0.0, 1 - sum_held)
                p, b = np.zeros(len(at)), np.ones(len(at))
                p[valid], b[before >= 0] = share[back], mass[before[before >= 0]]
                yield b, p
            if last:
                return
            held = nodes >= 0
            rank = np.where(held, np.cumsum(held) - 1, -1)
            start = np.full(len(at), -1, np.int64)
            start[valid] = first[before[valid]]
            at = np.full(len(at), -1, np.int64)
            at[valid] = rank[back]
            parents, known = nodes[held], at >= 0
            child = np.zeros(len(at), np.int64)
            child[known] = parents[at[known]] - start[known]


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, index of each word among the distinct ones, key of each distinct word)."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = parts.flatten()
    full = pc.greater(pc.binary_length(flat), 0)
    owner = pc.list_parent_indices(parts).to_numpy(zero_copy_only=False)[full.to_numpy(zero_copy_only=False)]
    coded = flat.filter(full).dictionary_encode()
    digest = xxhash.xxh64_intdigest
    keys = np.array([digest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()], np.uint64)
    return np.bincount(owner, minlength=len(texts)).astype(np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), (keys >> np.uint64(1)).astype(np.int64)


def _suffixes(trie: Trie, level: int, nodes: np.ndarray) -> np.ndarray:
    """The nodes of a level's n-grams without their first words."""
    nodes, back = np.unique(nodes, return_inverse=True)
    keys, width = Level(trie.levels[level - 1]).read(nodes, "keys"), trie.widths[level - 2]
    child = keys & ((1 << width) - 1)
    if level > 2:
        heads, to = np.unique(_suffixes(trie, level - 1, keys >> width), return_inverse=True)
        child += Level(trie.levels[level - 2]).place(heads << trie.widths[level - 3])[to]
    return child[back]


def _fans(trie: Trie, level: int, parents: np.ndarray) -> np.ndarray:
    """How many children nodes of the level below can have: the vocabulary, or the children of their last words' node."""
    if level == 2:
        return np.full(len(parents), trie.distinct, np.int64)
    below, width = Level(trie.levels[level - 2]), trie.widths[level - 3]
    ends, back = np.unique(_suffixes(trie, level - 1, parents), return_inverse=True)
    return (below.place(ends + 1 << width) - below.place(ends << width))[back]


def _blob(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and counts: differences by byte planes, so that Spark's shuffle compression finds the zeros."""
    steps = np.diff(keys, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T
    return len(keys).to_bytes(8, "little") + steps.tobytes() + counts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _unblob(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(data[:8], "little")
    steps = np.frombuffer(data, np.uint8, 8 * n, 8).reshape(8, n).T.copy().view("<i8").reshape(-1)
    return np.cumsum(steps), np.frombuffer(data, np.uint8, 4 * n, 8 + 8 * n).reshape(4, n).T.copy().view("<u4").reshape(-1).astype(np.int64)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def _merged(blobs: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of all blobs in order, and the sums of their counts."""
    sizes = [int.from_bytes(b.as_buffer()[:8].to_pybytes(), "little") for b in blobs]
    keys, counts, at = np.empty(sum(sizes), np.int64), np.empty(sum(sizes), np.int64), 0
    for blob, n in zip(blobs, sizes, strict=True):
        keys[at : at + n], counts[at : at + n] = _unblob(blob.as_buffer())
        at += n
    return _summed(keys, counts)


def _counting(texts: DataFrame, make, bounds: np.ndarray) -> DataFrame:
    """(shard, blob): n-gram keys that ``make`` finds in a slice of texts, counted and cut at ``bounds``."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            if held:
                keys, counts = (np.concatenate(x) for x in zip(*held, strict=True))
                held.clear()
                keys, counts = _summed(keys, counts)
                cuts = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
                rows = [(s, _blob(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], ["shard", "blob"])

        for batch in batches:
            column = batch.column(0)
            for a, b in slices(column, TOGETHER):
                held.append(make(column.slice(a, b - a)))
                if sum(len(k) for k, _ in held) > HELD:
                    yield from flush()
        yield from flush()

    return map_arrow(texts, run, "shard int, blob binary", ROWS)


def _build(counted: DataFrame, folder: str, level: int, trie: Trie) -> list[dict]:
    """Write one file for each shard; the driver gets a few numbers of each."""
    width = trie.widths[level - 2] if level > 1 else 0

    def shard(key, table):
        s = key[0].as_py()
        keys, counts = _merged(table.column("blob"))
        if level > 1:
            enough = counts >= LEAST
            keys, counts = keys[enough], counts[enough]
        arrays = named("keys", encode(keys)) | named("sums", encode(np.concatenate(([0], np.cumsum(counts)))))
        ends = [(-1, 0.0), (-1, 0.0)]
        fan = 0
        if level > 1 and len(keys):
            parents = keys >> width
            begins = np.flatnonzero(np.concatenate(([True], parents[1:] != parents[:-1])))
            heads = parents[begins]
            if level == 2:
                known = heads < trie.distinct
                whole = np.full(len(heads), trie.texts, np.int64)
                whole[known] = Level(trie.levels[0]).read(heads[known], "counts")
            else:
                whole = Level(trie.levels[level - 2]).read(heads, "counts")
            sizes = np.diff(np.append(begins, len(keys)))
            alpha = (counts - trie.discount) / np.repeat(whole, sizes)
            held = np.add.reduceat(alpha, begins)
            arrays |= named("parents", encode(heads)) | named("pointers", encode(begins))
            arrays |= {"alpha": quantised(alpha), "backoff": quantised(np.maximum(0, 1 - held))}
            ends = [(int(heads[0]), float(held[0])), (int(heads[-1]), float(held[-1]))]
            fan = int(sizes.max())
        path = f"{folder}/level{level}-{s:05d}.trie"
        save(path, arrays)
        row = {"shard": s, "path": path, "n": len(keys), "first": int(keys[0]) if len(keys) else -1, "last": int(keys[-1]) if len(keys) else -1, "total": int(counts.sum()), "once": int((counts == 1).sum()), "fan": fan, "head": ends[0][0], "head_sum": ends[0][1], "tail": ends[1][0], "tail_sum": ends[1][1]}
        return pa.Table.from_pylist([row], schema=pa.schema([("shard", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("n", "first", "last", "total", "once", "fan", "head")), ("head_sum", pa.float64()), ("tail", pa.int64()), ("tail_sum", pa.float64())]))

    schema = "shard int, path string, n long, first long, last long, total long, once long, fan long, head long, head_sum double, tail long, tail_sum double"
    return [r.asDict() for r in counted.groupBy("shard").applyInArrow(shard, schema).orderBy("shard").collect()]


def _bounds(trie: Trie, spark, level: int, shards: int) -> np.ndarray:
    """Keys that cut the next level into ``shards`` parts or more of about equal count, at most some ``SHARD``: parents
    weigh their own counts, and one with more than a part is cut among the children that it can have. Computed shard by
    shard; the driver gets one number a part."""
    below, width = trie.levels[level - 2], trie.widths[level - 2]
    weight = sum(s.total for s in below) or 1
    step, rows, done = max(1, min(SHARD, weight // shards)), [], 0
    for s in below:
        rows.append((s.path, s.start, s.n, s.total, done))
        done += s.total

    def run(batches):
        for batch in batches:
            for path, start, n, total, before in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not n:
                    continue
                goals = np.arange(-(-(before + 1) // step), (before + total) // step + 1, dtype=np.int64) * step - before
                goals = goals[(goals > 0) & (goals <= total)]
                if len(goals):
                    sums = sequence(path, "sums")
                    at = np.minimum(sums.lower_bound(goals)[0], n) - 1
                    low, high = sums.get(at), sums.get(at + 1)
                    share = (goals - low) / np.maximum(1, high - low)
                    keys = (at + start << width) | np.minimum((share * _fans(trie, level, at + start)).astype(np.int64), (1 << width) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], ["key"])

    held = map_arrow(spark.createDataFrame(rows, "path string, start long, n long, total long, before long"), run, "key long").distinct().orderBy("key").collect()
    first = (trie.distinct << width) + np.arange(0, trie.texts, step) * trie.distinct // trie.texts if level == 2 else []  # of the start symbol
    return np.concatenate((np.array([r[0] for r in held], np.int64), np.array(first, np.int64)))


def train(docs: DataFrame, text_col: str = "text", order: int = ORDER, discount: float = DISCOUNT) -> Trie:
    """Build the trie of all rows of ``docs`` in the shared folder. Null texts count as empty texts, with an end only."""
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    folder, shards = scratch_path(spark, "trie"), max(4, texts.rdd.getNumPartitions())
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    trie = Trie(order, discount)

    def words(column):
        lengths, index, keys = tokens(column)
        sums = np.bincount(index, minlength=len(keys))
        return np.append(keys, END), np.append(sums, len(lengths))

    parts = max(shards, -(-size // (4 * SHARD)))  # a flush holds no word twice, so few of its words are shorter than three bytes
    cuts = (np.arange(1, parts, dtype=np.float64) / parts * float(1 << 63)).astype(np.int64)
    built = _build(_counting(texts, words, cuts), folder, 1, trie)
    trie.levels.append(_placed(built))
    trie.tokens, trie.distinct, trie.once = sum(r["total"] for r in built), sum(r["n"] for r in built), sum(r["once"] for r in built)
    trie.texts = int(Level(trie.levels[0]).read(np.zeros(1, np.int64), "counts")[0]) if trie.distinct else 0
    trie.split.append({})
    fan = trie.distinct
    for k in range(2, order + 1):
        width = max(1, int(fan).bit_length())
        parents = sum(s.n for s in trie.levels[-1]) + 1
        if not trie.distinct:
            break
        if width + parents.bit_length() > 62:
            raise ValueError(f"level {k} needs keys of more than 62 bits")
        trie.widths.append(width)
        cuts = _bounds(trie, spark, k, shards)

        def grams(column, trie=trie, k=k):
            reader = Reader(trie)
            *_, key = reader.grams(*reader.words(column), k, scores=False)
            return np.unique(key, return_counts=True)

        built = _build(_counting(texts, grams, cuts), folder, k, trie)
        trie.levels.append(_placed(built))
        sums: dict[int, list[float]] = {}
        for r in built:
            for node, part in {(r["head"], r["head_sum"]), (r["tail"], r["tail_sum"])}:
                sums.setdefault(node, []).append(part)
        trie.split.append({node: sum(parts) for node, parts in sums.items() if node >= 0 and len(parts) > 1})
        fan = max([1, *(r["fan"] for r in built)]) * max([1, *map(len, sums.values())])
        if not any(r["n"] for r in built):
            break
    return trie


def _placed(built: list[dict]) -> list[Shard]:
    out, start = [], 0
    for r in built:
        out.append(Shard(r["path"], start, r["n"], r["first"], r["total"]))
        start += r["n"]
    return out


def score_batch(trie: Trie, reader: Reader, texts: pa.Array) -> tuple[np.ndarray, ...]:
    """(tokens, known tokens, base score, score) of each text."""
    if trie.distinct:
        distinct, place, lengths = reader.words(texts)
    else:
        lengths = tokens(texts)[0] + 1
        distinct, place = np.zeros(0, np.int64), np.full(int(lengths.sum()), -1, np.int64)
    owner, known = np.repeat(np.arange(len(lengths)), lengths), place >= 0
    counts = np.append(reader.levels[0].read(distinct, "counts") if len(distinct) else distinct, 0)  # the last: unknown
    base = np.log10((counts + 0.1) / (trie.tokens + 0.1 * (trie.distinct + 1)))[place]
    unknown = (trie.once + 0.5) / (trie.tokens + 1)
    p = np.append(counts[:-1] / max(1, trie.tokens) * (1 - unknown), unknown)[place]
    for mass, share in reader.grams(distinct, place, lengths, len(trie.levels)) if len(trie.levels) > 1 else ():
        p = p * mass + share
    logs = np.log10(np.maximum(p, 1e-300))
    add = lambda x: np.bincount(owner, weights=x, minlength=len(lengths))
    return lengths, add(known).astype(np.int64), add(base), add(logs)


def score(docs: DataFrame, trie: Trie, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, base_score, score): log10 probabilities of each row's whole text and its end.

    Null texts are empty: their end is their only token. Repeated rows and null ids are kept. A trie without words
    knows none, and its unknown word has probability 1/2 to 1.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def run(batches):
        reader = Reader(trie)
        for batch in batches:
            for a, b in slices(batch.column(1), TOGETHER):
                n, known, base, own = score_batch(trie, reader, batch.column(1).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(own, pa.float64())], ["id", "n_tokens", "n_known", "base_score", "score"])

    return map_arrow(rows, run, "id long, n_tokens long, n_known long, base_score double, score double", ROWS)
