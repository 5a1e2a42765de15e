from collections import Counter

import corpus_pipeline
import pyarrow as pa
import pytest
from test_mixing import brute_copies
from test_packing import check
from test_simhash import brute_components, brute_print

from tidemark.llm import langid, pii
from tidemark.llm.common import crc_remainder
from tidemark.llm.queries import byte_bpe


@pytest.fixture(scope="module")
def sf_dir(docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sf")
    docs.write.parquet(f"file://{folder}/documents.parquet")
    return f"file://{folder}"


def brute(spark, sf_dir):
    """The rows (id, text, source) before packing, stage by stage in plain Python."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where(crc_remainder(F.col("doc_id"), 4) != 2))
    rows = []
    for r in docs.collect():
        (lang,), (score,), _ = langid.predict_batch(model, pa.array([r.text], pa.string()))
        if lang != "und" and score >= corpus_pipeline.LEAST_SHARE:
            rows.append((r.doc_id, r.text, r.source))
    prints = {i: brute_print(t) for i, t, _ in rows if i is not None}
    root = brute_components([(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2], list(prints))
    rows = [r for r in rows if r[0] is None or root[r[0]] == r[0]]
    rows = [(i, pii.masked(t, pii.find_batch(pii.default_field(), [t])[0][1]), s) for i, t, s in rows]
    out = []
    for (i, t, s), (_, _, n) in zip(rows, brute_copies(rows), strict=True):
        out += [(i, t, None, s, None)] * n
    return out


def test_run_against_brute_force(spark, sf_dir):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(byte_bpe())
    want = brute(spark, sf_dir)
    rows = corpus_pipeline.run(spark, sf_dir).withColumnRenamed("doc_id", "id").collect()
    assert Counter(r.id for r in rows if r.start == 0) == Counter(r[0] for r in want)
    check(rows, list({r[0]: r for r in want}.values()), tokenizer)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_entry_registers_all(spark):
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
