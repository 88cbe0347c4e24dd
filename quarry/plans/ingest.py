"""The ingestion job: raw documents to staged versions and chunks, as one plan for each source.

Order of the rules: status of the item, size, empty text, unchanged content, no or too many chunks.
Unchanged documents leave by an anti-join before chunking, the only costly step in Python.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.errors import IngestionError, RightsError
from quarry.functions import access as A
from quarry.functions import text as T
from quarry.functions import vectors as V
from quarry.functions.normalize import NORMALIZER_VERSION, normalize_text
from quarry.operators import chunk as C
from quarry.plans.store import IndexStore

MAX_BYTES, MAX_CHUNKS = 10_000_000, 2_000
COUNTERS = ("discovered", "fetched", "rejected", "quarantined", "skipped_unchanged", "tombstoned", "documents_indexed", "chunks_indexed")


@dataclass
class Run:
    source_id: str
    index_run_id: str | None
    status: str = "running"
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(COUNTERS, 0))


def status_route(status: Column) -> Column:
    """What becomes of an item by its status alone: deleted ones are tombstones, unsupported ones rejected, other failures quarantined."""
    return F.when(status == "available", "available").when(status == "deleted", "tombstone").when(status == "unsupported", "rejected").otherwise("quarantined")


def validate(docs: DataFrame, text: str = "text", normalized: str = "normalized", max_bytes: int = MAX_BYTES) -> DataFrame:
    """docs with `reason`: too_large, empty or null."""
    size = F.octet_length(F.col(text).cast("binary"))
    blank = F.coalesce(F.col(normalized), F.lit("")).rlike(r"^(?U)\s*$")
    return docs.withColumn("reason", F.when(size > max_bytes, "too_large").when(blank, "empty"))


def changed(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose (document_id, content_hash) is not active yet."""
    return docs.join(known.select("document_id", "content_hash"), ["document_id", "content_hash"], "left_anti")


def missing(known: DataFrame, seen: DataFrame, failed: DataFrame) -> DataFrame:
    """Known documents that a full snapshot has neither seen nor failed to read: document_id."""
    return known.select("document_id").join(seen.select("document_id").unionByName(failed.select("document_id")), "document_id", "left_anti")


def build_versions(docs: DataFrame, descriptor: dict) -> DataFrame:
    """Version rows of raw documents with a column normalized."""
    labels = A.acl_labels(F.lit(descriptor["source_id"]), F.lit(descriptor["owner"]), F.lit(descriptor["visibility"]))
    return docs.select(
        F.concat_ws(":", "source_id", "item_id").alias("document_id"),
        T.content_hash(F.col("normalized")).alias("content_hash"),
        "source_id", "item_id", "source_uri", "title", "media_type",
        F.coalesce("language", T.detect_language(F.col("normalized"))).alias("language"),
        "source_revision", "fetched_at", "published_at", "parser_version",
        F.lit(NORMALIZER_VERSION).alias("normalizer_version"),
        F.lit(descriptor["visibility"]).alias("visibility"), F.lit(descriptor["rights_policy"]).alias("rights_policy"),
        F.lit("active").alias("status"), labels.alias("acl_labels"), "metadata_json", "normalized",
    )


def build_chunks(versions: DataFrame, dimensions: int = V.DIMENSIONS, embed=V.hash_embed) -> DataFrame:
    """Chunk rows, enriched and embedded, of versions with their normalized text. embed: Column to Column."""
    parts = C.chunk_documents(versions, "document_id", "normalized")
    keep = versions.select("document_id", F.col("content_hash").alias("document_version_hash"), "source_id", "source_uri", "language", "acl_labels", "metadata_json")
    rows = parts.join(keep, "document_id")
    is_url = F.contains(F.col("source_uri"), F.lit("://"))
    metadata = lambda path: F.get_json_object("metadata_json", path)
    spans = "array<struct<page:int,name:string,line_start:int,line_end:int>>"
    page, fragment = C.locate(F.col("line_start"), F.col("line_end"), F.from_json(metadata("$.pages"), spans), F.from_json(metadata("$.chapters"), spans), T.fragment(F.col("heading_path")))
    locator = F.struct(
        F.when(~is_url, F.col("source_uri")).alias("path"), F.when(is_url, F.col("source_uri")).alias("url"), metadata("$.commit").alias("commit"), page.alias("page"),
        F.lit(None).cast("int").alias("paragraph"), "line_start", "line_end", fragment.alias("fragment"),
    )
    context = T.contextual_text(F.col("heading_path"), F.col("text"))
    return rows.select(
        T.chunk_id(F.col("document_id"), F.col("document_version_hash"), F.col("ordinal")).alias("chunk_id"),
        "document_id", "document_version_hash", "source_id", "ordinal", "text", "token_count", "language",
        F.lit(C.CHUNKER_VERSION).alias("chunker_version"), "heading_path", locator.alias("locator"), "acl_labels",
        T.lexical_terms(context).alias("lexical_terms"), embed(context, dimensions).alias("dense_embedding"),
        F.lit(V.MODEL).alias("embedding_model"), F.lit(dimensions).alias("embedding_dimensions"),
    )


def run(spark: SparkSession, store: IndexStore, descriptor: dict, raw: DataFrame, *, changed_only: bool = True, delete_missing: bool = False, dry_run: bool = False, force: bool = False) -> Run:
    """Stage one source's raw documents (schemas.RAW_DOCUMENTS) in a candidate run; the active corpus is not touched."""
    if delete_missing and changed_only:
        raise ValueError("delete_missing needs a full snapshot: set changed_only to False")
    if descriptor["rights_policy"] not in A.APPROVING:
        raise RightsError(f"{descriptor['rights_policy']} does not allow source {descriptor['source_id']} to be stored")
    source = descriptor["source_id"]
    known = store.active_documents(source)
    out = Run(source, None if dry_run else store.open_run(source))
    try:
        _stage(spark, store, descriptor, raw, known, out, delete_missing, force)
    except Exception as why:
        out.status = "failed"
        if out.index_run_id:
            store.discard(out.index_run_id)
        raise IngestionError(f"ingestion of {source} failed: {why}") from why
    out.status = "staged"
    return out


def _stage(spark, store, descriptor, raw, known, out: Run, delete_missing: bool, force: bool) -> None:
    folder = f"{store.root}/work/{out.index_run_id or 'dry-' + descriptor['source_id']}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    items = raw.withColumn("document_id", F.concat_ws(":", "source_id", "item_id")).withColumn("route", status_route(F.col("status")))
    fetched = items.where("route = 'available'").withColumn("normalized", normalize_text(F.col("text")))
    checked = kept(validate(fetched), "checked")
    versions = build_versions(checked.where("reason is null"), descriptor)
    fresh = kept(versions if force else changed(versions, known), "fresh")
    chunks = kept(build_chunks(fresh), "chunks")
    sizes = fresh.select("document_id").join(chunks.groupBy("document_id").count(), "document_id", "left").select("document_id", F.coalesce("count", F.lit(0)).alias("n"))
    bad = sizes.where((F.col("n") == 0) | (F.col("n") > MAX_CHUNKS)).select("document_id")
    good = fresh.join(bad, "document_id", "left_anti")
    gone = items.where("route = 'tombstone'").select("document_id")
    failed = items.where("route in ('rejected', 'quarantined')").select("document_id").unionByName(checked.where("reason is not null").select("document_id")).unionByName(bad)
    if delete_missing:
        gone = gone.unionByName(missing(known, items, failed)).distinct()
    staged_chunks = chunks.join(bad, "document_id", "left_anti")
    routes = {r["route"]: r["count"] for r in items.groupBy("route").count().collect()}  # four rows at most
    c = out.counters
    c["discovered"] = sum(routes.values())
    c["fetched"] = routes.get("available", 0)
    c["quarantined"] = routes.get("quarantined", 0)
    c["rejected"] = routes.get("rejected", 0) + checked.where("reason is not null").count() + bad.count()
    c["tombstoned"] = gone.count()
    c["documents_indexed"], c["chunks_indexed"] = good.count(), staged_chunks.count()
    c["skipped_unchanged"] = checked.where("reason is null").count() - fresh.count()
    if out.index_run_id:
        store.stage(out.index_run_id, good.drop("normalized"), staged_chunks, gone)


def default_gate(run_: Run) -> bool:
    return run_.status == "staged" and bool(run_.counters["documents_indexed"] or run_.counters["tombstoned"])


def activate(store: IndexStore, run_: Run, gate: Callable[[Run], bool] = default_gate) -> Run:
    """Activate the run if the gate lets it pass, else discard it."""
    if not run_.index_run_id:
        raise IngestionError("the run staged nothing")
    if gate(run_):
        store.activate(run_.index_run_id)
        run_.status = "succeeded"
    else:
        store.discard(run_.index_run_id)
        run_.status = "quarantined"
    return run_


def empty_raw(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], schemas.RAW_DOCUMENTS)
