"""The corpus pipeline: quality, exact duplicates, near duplicates, benchmark passages, tokens.

Every stage works on all that the one before has kept, and its decisions take effect. A stage takes
(spark, docs, sf_dir); all but the last return the columns of docs. run() writes each stage's result as
Parquet in the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.bpe import byte_bpe
from quarry.llm.common import ASCII_SPACE, small, text_or_empty, written
from quarry.llm.decontaminate import decontaminate
from quarry.llm.exact_dedup import exact_dedup
from quarry.llm.near_dedup import near_dedup
from quarry.llm.quality import quality_filter


def _private(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case."""
    taken = {c.casefold() for c in docs.columns}
    while name.casefold() in taken:
        name += "_"
    return name


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows of these ids; rows without an id stay."""
    gone = small(written(ids.where("doc_id is not null").distinct(), "dropped")).toDF(_private(docs, "dropped_id"))
    return docs.join(gone, docs["doc_id"] == gone[gone.columns[0]], "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Null text is scored as empty; rows are judged each, whatever their id; no rows give no rows."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for white space one stays; of rows that repeat an id and its text, too.

    Null text is empty text. Rows without an id stay; texts that share an id are judged each. No rows give no rows.
    """
    decided = written(exact_dedup(docs), "exact")
    names = [_private(docs, n) for n in ("gone_id", "gone_sha")]
    gone = small(written(decided.where("not kept and doc_id is not null").select("doc_id", "text_sha256").distinct(), "dropped")).toDF(*names)
    sha = F.sha2(F.translate(text_or_empty(), ASCII_SPACE, "").cast("binary"), 256)
    kept = docs.join(gone, (docs["doc_id"] == gone[names[0]]) & (sha == gone[names[1]]), "left_anti")
    again = written(decided.where("kept and doc_id is not null").groupBy("doc_id", "text_sha256").count().where("count > 1").select("doc_id").distinct(), "repeated")
    if again.isEmpty():
        return kept
    again = small(again).toDF(names[0])
    same = kept["doc_id"] == again[names[0]]
    once = kept.join(again, same, "left_semi").withColumn(names[1], sha).dropDuplicates(["doc_id", names[1]]).drop(names[1])
    return kept.join(again, same, "left_anti").unionByName(once)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the smallest id stays.

    Decided by id: of rows that share an id all stay or go. Texts without words, null ones among them, and rows without an id stay. No rows give no rows.
    """
    return _without(docs, near_dedup(docs).where("not kept").select("doc_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Decided by id: of rows that share an id all go if one of them holds an item. Null and empty texts hold none; rows without an id stay. No rows give no rows.
    """
    return _without(docs, decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated").select("doc_id"))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, ids. Null text has no tokens; every row is encoded, without an id too; no rows give no rows."""
    return byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("MinHash near-dedup", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("byte-level BPE", token_stage),
]

#: SQL has no form for these stages; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
