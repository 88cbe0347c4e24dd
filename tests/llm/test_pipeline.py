import hashlib
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(21)
    where = tmp_path_factory.mktemp("sf")
    items = [(k, prose(r, 25)) for k in range(3)]
    good = [prose(r, r.randint(40, 120)) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in prose(r, 50).split()) for _ in range(60)]
    copies = [good[0], good[0] + " ", good[1]]
    near = [good[2] + " extra", "more " + good[2]]
    leaks = [f"{prose(r, 30)} {t} {prose(r, 30)}" for _, t in items]
    texts = [*good, *bad, *copies, *near, *leaks]
    docs = [(i, t, "en", f"src{i % 3}", len(t), "extra") for i, t in enumerate(texts)]
    spark.createDataFrame([*docs, docs[5], (900, None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{where}/documents.parquet")
    labels = [(i, 0 if 120 <= i < 180 else 1, 0) for i in range(len(texts)) if i % 2]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where), texts


def test_run_equals_the_stages_by_hand(spark, folder):
    where, texts = folder
    got = {r.doc_id: r for r in P.run(spark, where).collect()}
    kept = {i: t for i, t in enumerate(texts) if not 120 <= i < 180}
    kept = {i: t for i, t in kept.items() if brute.exact(list(kept.items()))[i][2]}
    groups = brute.near(list(kept.items()))
    kept = {i: t for i, t in kept.items() if groups[i][2] and i < len(texts) - 3}
    assert set(got) - {900} == set(kept)
    assert all(got[i].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest() for i, t in kept.items())


def test_stages_keep_the_columns(spark, folder):
    where, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, docs, where).columns == docs.columns
    assert [n for n, _ in P.STAGES] == ["quality classifier", "exact dedup", "MinHash near-dedup", "benchmark decontamination", "byte-level BPE"]


def test_rows_that_repeat_become_one(spark, folder):
    where, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    assert docs.where("doc_id = 5").count() == 2 and P.exact_stage(spark, docs, where).where("doc_id = 5").count() == 1


def test_an_empty_table(spark, folder, tmp_path):
    where, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs_ = stage(spark, docs, where)
        assert docs_.count() == 0


def test_clashing_names_and_two_texts_under_one_id(spark, folder):
    where, _ = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    one, other = docs.where("doc_id = 5").limit(1), docs.where("doc_id = 6").withColumn("doc_id", F.lit(5).cast("long"))
    wide = docs.unionByName(one).unionByName(other).withColumns({n: F.lit(n) for n in ("_sha", "gone_id", "gone_sha", "dropped_id", "GONE_ID_", "shingles", "block", "component", "bands")})
    kept = None
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, wide, where)
        assert kept.columns == wide.columns and kept.schema == wide.schema
    exact = P.exact_stage(spark, wide, where)
    assert sorted(r.text for r in exact.where("doc_id = 5").collect()) == sorted({r.text for r in one.unionByName(other).collect()})
    assert exact.where("doc_id = 6").count() == 0  # the same text under a smaller id
    assert P.token_stage(spark, exact, where).count() == exact.count()
