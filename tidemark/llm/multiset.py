"""Document fingerprints by a homomorphic multiset hash, in DataFrame functions only.

A text is the multiset of its paragraphs (lines) and of the blocks of up to eight words that each paragraph is cut
into. Every element is hashed to a wide vector of ``LANES`` bits; the fingerprint is the lane-wise sum of these vectors
modulo 2**30, with the number of elements as one lane more. Sums don't depend on order, and elements can be added or
taken away (``combine``) without the rest of the text. Read as signs, the lanes are random projections, so two
fingerprints also tell how much their multisets have in common (``likeness``).

Two lanes of 30 bits, each under a guard bit, lie in one long; the guard bits are cleared after each addition. No text
that a string can hold has the 2^29 elements from which on a lane's sign would be lost.
"""

from __future__ import annotations

from collections import Counter
from math import isqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Shape of the fingerprint: slots of 31 bits (30 used) in a long, rounds of 62 hash bits.
SLOT, SLOTS, ROUNDS = 31, 2, 2
LANES = SLOT * SLOTS * ROUNDS
ONES = sum(1 << SLOT * i for i in range(SLOTS))
LOW = (1 << SLOT - 1) - 1
MASK = LOW * ONES
#: Up to eight words of one line with the white space behind them.
BLOCK = r"(?:[^\x20\x09-\x0D]++[\x20\x09\x0B-\x0D]*+){1,8}+"


def element_hashes(text: Column) -> Column:
    """Hashes of all elements of a text, repeats included. The empty text has one element, its empty paragraph."""
    blocks = F.transform(F.regexp_extract_all(text, F.lit(BLOCK), F.lit(0)), lambda b: F.xxhash64(b, F.lit("b")))
    return F.concat(F.transform(F.split(text, "\n", -1), lambda p: F.xxhash64(p, F.lit("p"))), blocks)


def summed(hashes: Column) -> Column:
    """The fingerprint of an array of element hashes: the count, then the packed lanes."""

    def rehashed(r: int) -> Column:
        return F.transform(hashes, lambda h: F.xxhash64(h, F.lit(r))) if r else hashes

    def lanes(own: Column) -> Column:
        added = lambda k: lambda acc, h: (acc + F.call_function("shiftright", h, k).bitwiseAND(F.lit(ONES))).bitwiseAND(F.lit(MASK))
        return F.transform(F.sequence(F.lit(0), F.lit(SLOT - 1)), lambda k: F.aggregate(own, F.lit(0).cast("long"), added(k)))

    return F.concat(F.array(F.size(hashes).cast("long").bitwiseAND(F.lit(LOW))), *(lanes(rehashed(r)) for r in range(ROUNDS)))


def combine(left: Column, right: Column, sign: int = 1) -> Column:
    """The fingerprint of the union of two multisets, or with ``sign=-1`` of ``left`` after ``right`` is taken away."""
    other = right if sign > 0 else F.transform(right, lambda w: (F.lit(MASK + ONES) - w).bitwiseAND(F.lit(MASK)))
    added = F.zip_with(left, other, lambda a, b: (a + b).bitwiseAND(F.lit(MASK)))
    return F.transform(added, lambda w, i: F.when(i == 0, w.bitwiseAND(F.lit(LOW))).otherwise(w))


def as_hex(packed: Column) -> Column:
    """16 hex digits for each long of a fingerprint."""
    return F.array_join(F.transform(packed, lambda w: F.lpad(F.lower(F.hex(w)), 16, "0")), "")


def signed_lanes(packed: Column) -> Column:
    """Lanes as sums of signs, 2 * lane - count, in the signed range modulo 2**30."""
    half = (LOW + 1) // 2
    words = F.slice(packed, 2, SLOT * ROUNDS)
    value = lambda w, i: F.pmod(F.call_function("shiftright", w, F.lit(SLOT * i)).bitwiseAND(F.lit(LOW)) * 2 - packed[0] + half, F.lit(LOW + 1)) - half
    return F.flatten(F.transform(words, lambda w: F.array(*(value(w, i) for i in range(SLOTS)))))


def likeness(a: Column, b: Column) -> Column:
    """From two arrays of signed lanes: twice the product over the sum of squares, 0 to 1, and 1 for equal ones."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p * q).cast("double")), F.lit(0.0), lambda s, p: s + p)
    return F.when(a == b, 1.0).otherwise(F.greatest(F.lit(0.0), F.coalesce(F.try_divide(2 * dot(a, b), dot(a, a) + dot(b, b)), F.lit(0.0))))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, packed): each row's id and fingerprint; a null text counts as empty. No shuffle, no Python."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].alias("id"), element_hashes(text).alias("hashes")).select("id", summed(F.col("hashes")).alias("packed"))


def place_of(row_id: Column, text: Column) -> Column:
    """A row's place as 33 characters in the order of ids, nulls last, then of the texts' hashes."""
    ordered = lambda value: F.lpad(F.hex(value.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.when(row_id.isNull(), "1").otherwise("0"), ordered(F.coalesce(row_id, F.lit(0).cast("long"))), ordered(F.xxhash64(text)))


def _cuts(rows: DataFrame) -> list[str]:
    """Places that cut the rows into some sqrt(n) ranges of about sqrt(n) rows: quantiles of the ids, and for an id (or
    the null id) that fills whole ranges by itself, equal shares of the hashes of its texts."""
    n, nulls = rows.agg(F.count(F.lit(1)), F.count_if(F.col("id").isNull())).first()
    ranges = max(1, isqrt(n))
    shares = lambda k: [f"{(1 << 64) * i // k:016X}" for i in range(k)]
    found = {""} | {f"1{1 << 63:016X}{h}" for h in shares(1 + nulls // ranges)}
    if ranges > 1 and n > nulls:
        ids = Counter(rows.agg(F.percentile_approx("id", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0])
        for held, times in ids.items():
            found |= {f"0{held + (1 << 63):016X}{h}" for h in shares(times)}
            if times > 1 and held < (1 << 63) - 1:
                found.add(f"0{held + 1 + (1 << 63):016X}")
    return sorted(found)


def _ranges(cuts: list[str], place: Column) -> Column:
    """How many of the cuts, in ascending order, are at or before a place; searched in two steps."""
    step = isqrt(len(cuts)) + 1
    whole, coarse = (F.split(F.lit(",".join(c)), ",") for c in (cuts, cuts[::step]))  # folded to one literal each
    upto = lambda array: F.size(F.filter(array, lambda c: c <= place))
    before = (upto(coarse) - 1) * step
    return before + upto(F.slice(whole, before + 1, step))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, packed, next_text, next_packed): each row with the row that follows in ascending order of ids.

    The last row is followed by the first, a single row by itself. Equal ids are ordered by their texts' hashes and then
    texts, null ids come after all others, null texts are empty. Rows are dealt out by some sqrt(n) ranges of the order,
    whose first places, as many short strings, are on the driver; the first row of each range is also given to the range
    before it. So no task gets the whole order, and neither ranges nor the driver's list grow as fast as the table.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    placed = rows.withColumn("place", place_of(F.col("id"), F.col("text")))
    cuts = _cuts(rows)
    firsts = sorted(r["first"] for r in placed.select(_ranges(cuts, F.col("place")).alias("range"), "place").groupBy("range").agg(F.min("place").alias("first")).collect()) or [""]
    at = (_ranges(firsts, F.col("place")) - 1).cast("int")
    first = F.col("place") == F.element_at(F.split(F.lit(",".join(firsts)), ","), F.col("range") + 1)
    before = F.pmod(F.col("range") - 1, F.lit(len(firsts)))
    copies = F.array(F.struct(F.col("range").alias("at"), F.lit(0).alias("guest")), F.when(first, F.struct(before.alias("at"), F.lit(1).alias("guest"))))
    dealt = placed.withColumn("range", at).withColumn("copy", F.explode(F.filter(copies, lambda c: c.isNotNull())))
    dealt = dealt.select("id", "text", "place", F.col("copy.at").alias("at"), F.col("copy.guest").alias("guest")).repartition("at")
    dealt = dealt.withColumn("hashes", element_hashes(F.col("text"))).withColumn("packed", summed(F.col("hashes"))).drop("hashes")
    order = Window.partitionBy("at").orderBy("guest", "place", "text")
    led = dealt.withColumn("next", F.lead(F.struct("text", "packed")).over(order)).where("guest = 0")
    return led.select("id", "text", "packed", F.col("next.text").alias("next_text"), F.col("next.packed").alias("next_packed"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next document.

    Columns: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. The edited text has
    the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document's.
    """
    half = (F.char_length("text") / 2).cast("int")
    led = with_next(docs, id_col, text_col).withColumn("n_chars", F.char_length("text"))
    led = led.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars") - half), F.substring("next_text", F.lit(1), half)))
    led = led.withColumn("hashes", element_hashes(F.col("edited"))).withColumn("edited_packed", summed(F.col("hashes")))
    lanes = {f"{c}_lanes": signed_lanes(F.col(c)) for c in ("packed", "next_packed", "edited_packed")}
    led = led.select("id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "packed", "edited_packed", "next_packed").withColumns(lanes)
    return led.select(
        "id", "n_chars", "edited_sha256", as_hex(F.col("packed")).alias("fingerprint"), as_hex(F.col("edited_packed")).alias("edited_fingerprint"),
        likeness(F.col("packed_lanes"), F.col("edited_packed_lanes")).alias("near_edited"), likeness(F.col("packed_lanes"), F.col("next_packed_lanes")).alias("near_next"),
    )
