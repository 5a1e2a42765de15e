import hashlib

from pyspark.sql import functions as F

from tidemark.llm import multiset


def prints(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r.packed for r in multiset.fingerprints(rows).orderBy("id").collect()]


def test_order_and_increments(spark):
    a, b = "first paragraph of it\nand one more", "third one"
    ab, ba, only_a, only_b, other = prints(spark, f"{a}\n{b}", f"{b}\n{a}", a, b, f"{a}\nthird One")
    assert ab == ba != other
    frame = spark.createDataFrame([(ab, only_a, only_b)], "ab array<long>, a array<long>, b array<long>")
    row = frame.select(multiset.combine(F.col("a"), F.col("b")).alias("sum"), multiset.combine(F.col("ab"), F.col("b"), -1).alias("rest")).first()
    assert row["sum"] == ab and row.rest == only_a


def test_lanes_are_sums_of_hash_bits(spark):
    frame = spark.createDataFrame([([5, -3, 2**62 + 7, 5],)], "h array<long>")
    packed = frame.select(multiset.summed(F.col("h")).alias("p")).first().p
    held = [packed[1 + k] >> 31 * i & (1 << 30) - 1 for i in range(2) for k in range(31)]
    want = [sum(h >> 31 * i + k & 1 for h in (5, -3, 2**62 + 7, 5)) for i in range(2) for k in range(31)]
    assert packed[0] == 4 and held == want


def test_edited_against_brute_force(docs, corpus):
    order = sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0))
    rows = {r.id: r for r in multiset.edited(docs).collect()}
    assert multiset.edited(docs).count() == len(corpus)
    for at, (i, text, *_) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        if i == 1 or order[(at + 1) % len(order)][0] == 1:
            continue  # a repeated row: its twin may come first
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        assert rows[i].n_chars == len(text) and rows[i].edited_sha256 == hashlib.sha256(edit.encode()).hexdigest(), i
        assert 0 <= rows[i].near_edited <= 1 and 0 <= rows[i].near_next <= 1
        if edit == text:
            assert rows[i].fingerprint == rows[i].edited_fingerprint and rows[i].near_edited == 1
    assert len({rows[i].fingerprint for i in (3, 100, 101)}) == 1 and rows[100].near_next == 1
    assert rows[205].near_edited > rows[205].near_next


def test_likeness_of_many_repeated_lines(spark):
    rows = [(1, "one and the same line\n" * 600_000), (2, "one and the same line\n" * 2000), (3, "quite another line here\n" * 2000)]
    found = {r.id: r for r in multiset.edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # 600,000 lines become 302,000 of the same: twice the product over the sum of squares
    assert abs(found[1].near_edited - 2 * 302 * 600 / (302**2 + 600**2)) < 0.001 and found[2].near_next < 0.3


def test_hot_ids_are_split_and_wide_ids_kept(spark):
    big = 2**62
    rows = [(None, f"no id {i}") for i in range(150)] + [(7, f"seven {i % 140}") for i in range(150)]
    rows += [(i, f"text {i}") for i in (-3, 0, big, big + 1, big + 2, 2**63 - 1, -(2**63))]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cuts = multiset._cuts(frame.select(F.col("doc_id").alias("id"), "text"))
    assert sum(c.startswith("1") for c in cuts) > 5 and sum(c.startswith(f"0{7 + (1 << 63):016X}") for c in cuts) > 5
    hashed = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).distinct().collect()}
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashed[r[1]], r[1]))
    want = sorted((str(i), text, order[(at + 1) % len(order)][1]) for at, (i, text) in enumerate(order))
    found = multiset.with_next(frame).select("id", "text", "next_text").collect()
    assert sorted((str(r.id), r.text, r.next_text) for r in found) == want


def test_empty_single_and_clashing(docs, no_docs, clashing):
    assert multiset.edited(no_docs).count() == 0
    one = docs.where("doc_id = 5")
    assert multiset.edited(one).first().near_next == 1
    assert multiset.edited(docs.where("doc_id is null")).count() == 1
    assert sorted(multiset.edited(clashing).collect(), key=str) == sorted(multiset.edited(docs).collect(), key=str)
