import json

import pytest
from pyspark.sql import functions as F

from quarry import schemas
from quarry.errors import IngestionError, RightsError
from quarry.operators import retrieve as R
from quarry.plans import ingest as I
from quarry.plans.store import IndexStore
from quarry.sources.descriptor import as_row, descriptor, load_descriptor

OWN = descriptor({"source_id": "notes", "source_type": "filesystem", "display_name": "Notes", "owner": "me", "rights_policy": "owner_approved", "root": "/x"})


def raw(spark, rows, status="available"):
    """rows: item, text, or item, text, status."""
    data = [("notes", r[0], r[0], "text/markdown", r[2] if len(r) > 2 else status, r[0], len(r[1] or ""), "rev", r[1], "p/1", None, None, None, json.dumps({"commit": "abcdef1234"})) for r in rows]
    return spark.createDataFrame(data, schemas.RAW_DOCUMENTS)


@pytest.fixture
def store(spark, tmp_path):
    return IndexStore(spark, f"file://{tmp_path}/store")


def go(spark, store, rows, **options):
    run = I.run(spark, store, OWN, raw(spark, rows), **options)
    return I.activate(store, run) if run.index_run_id and I.default_gate(run) else run


def active(store):
    return {r.item_id for r in store.active_documents("notes").collect()}


def test_candidates_are_not_visible_until_they_are_activated(spark, store):
    run = I.run(spark, store, OWN, raw(spark, [("a", "# A\n\ntext about apples")]))
    assert run.status == "staged" and active(store) == set()
    I.activate(store, run)
    assert active(store) == {"a"} and store.active_run() == run.index_run_id
    chunk = store.chunks().first()
    assert chunk.chunk_id.startswith("notes:a@") and chunk.locator.commit == "abcdef1234" and chunk.heading_path == ["A"] and "apples" in chunk.lexical_terms


def test_a_second_run_skips_what_is_unchanged(spark, store):
    go(spark, store, [("a", "one"), ("b", "two")])
    run = go(spark, store, [("a", "one\r\n"), ("b", "two changed")])
    assert (run.counters["skipped_unchanged"], run.counters["documents_indexed"]) == (1, 1)
    assert active(store) == {"a", "b"}
    assert go(spark, store, [("a", "one")], force=True).counters["documents_indexed"] == 1


def test_rollback_undoes_activation(spark, store):
    first = go(spark, store, [("a", "one")])
    before = store.active().collect()
    go(spark, store, [("a", "other"), ("b", "two")])
    assert active(store) == {"a", "b"}
    assert store.rollback() == first.index_run_id
    assert store.active().collect() == before
    assert store.rollback() is None
    with pytest.raises(IngestionError):
        store.rollback()


def test_missing_documents_go_but_unreadable_ones_stay(spark, store):
    go(spark, store, [("a", "one"), ("b", "two"), ("c", "three")])
    run = go(spark, store, [("a", "one"), ("b", None, "unreadable")], changed_only=False, delete_missing=True)
    assert (run.counters["tombstoned"], run.counters["quarantined"]) == (1, 1) and active(store) == {"a", "b"}
    with pytest.raises(ValueError):
        I.run(spark, store, OWN, raw(spark, []), delete_missing=True)


def test_deleted_items_and_rejections(spark, store):
    go(spark, store, [("a", "one"), ("b", "two")])
    run = go(spark, store, [("a", None, "deleted"), ("b", "   "), ("c", "x", "unsupported"), ("d", "four")])
    c = run.counters
    assert (c["discovered"], c["fetched"], c["tombstoned"], c["rejected"], c["documents_indexed"]) == (4, 2, 1, 2, 1)
    assert active(store) == {"b", "d"}


def test_dry_run_writes_no_run(spark, store):
    run = I.run(spark, store, OWN, raw(spark, [("a", "one")]), dry_run=True)
    assert run.counters["documents_indexed"] == 1 and store.events().count() == 0
    with pytest.raises(IngestionError):
        I.activate(store, run)


def test_a_failed_run_is_discarded(spark, store, monkeypatch):
    go(spark, store, [("a", "one")])
    monkeypatch.setattr(I, "build_chunks", lambda *a: 1 / 0)
    with pytest.raises(IngestionError):
        I.run(spark, store, OWN, raw(spark, [("b", "two")]))
    assert active(store) == {"a"} and store.events().where("status = 'discarded'").count() == 1


def test_a_gate_may_refuse(spark, store):
    run = I.run(spark, store, OWN, raw(spark, [("a", "one")]))
    assert I.activate(store, run, gate=lambda r: False).status == "quarantined" and active(store) == set()
    with pytest.raises(IngestionError):
        store.activate(run.index_run_id)


def test_restricted_sources_are_refused(spark, store):
    with pytest.raises(RightsError):
        I.run(spark, store, {**OWN, "rights_policy": "restricted"}, raw(spark, []))


def test_of_two_writers_one_fails(spark, store):
    store.open_run("notes")
    with pytest.raises(IngestionError):
        store._commit({"run_id": "x", "source_id": "notes", "status": "candidate"}, 0)


def test_of_many_writers_one_wins(store):
    from concurrent.futures import ThreadPoolExecutor

    def commit(k):
        try:
            store._commit({"run_id": f"r{k}", "source_id": "notes", "status": "candidate"}, 0)
            return 1
        except IngestionError:
            return 0

    with ThreadPoolExecutor(8) as pool:
        assert sum(pool.map(commit, range(8))) == 1 and len(store._log()) == 1


def test_rows_that_break_a_rule_are_refused_before_any_write(spark, store):
    first = go(spark, store, [("a", "one"), ("b", "two")])
    versions, chunks = (store.table(n).where(F.col("index_run_id") == first.index_run_id) for n in ("versions", "chunks"))
    versions, chunks = (spark.createDataFrame(df.collect(), df.schema) for df in (versions, chunks))
    run = store.open_run("notes")
    bad = {
        "embedding_width": (versions, chunks.withColumn("dense_embedding", F.slice("dense_embedding", 1, 9))),
        "chunk_id_unique": (versions, chunks.unionByName(chunks)),
        "version_unique": (versions.unionByName(versions), chunks),
        "chunk_has_version": (versions.where("document_id = 'notes:a'"), chunks),
    }
    for rule, (v, c) in bad.items():
        with pytest.raises(IngestionError, match=rule):
            store.stage(run, v, c)
        assert store.table("chunks").where(F.col("index_run_id") == run).count() == 0
    store.stage(run, versions, chunks)
    assert store.table("chunks").where(F.col("index_run_id") == run).count() == 2


def test_snapshots_of_the_log(spark, store, monkeypatch):
    from quarry.plans import store as S

    monkeypatch.setattr(S, "SNAPSHOT", 3)
    for _ in range(4):
        store.discard(store.open_run("notes"))
    assert [n for n, _ in store._named("snapshots")] == [3, 6] and len(store._log()) == 8
    read = []
    monkeypatch.setattr(store, "_read", lambda path, f=store._read: (read.append(path.getName()), f(path))[1])
    assert [e["event_seq"] for e in store._log()] == list(range(8)) and len(read) == 3


def test_migrations_are_applied_once_and_in_order(spark, tmp_path, monkeypatch):
    from quarry.plans import store as S

    root = f"file://{tmp_path}/old"
    monkeypatch.setattr(schemas, "SCHEMA_VERSION", 1)
    IndexStore(spark, root).open_run("notes")
    done = []
    monkeypatch.setattr(S, "MIGRATIONS", ((2, lambda s: done.append(2)), (3, lambda s: done.append(3)), (4, lambda s: done.append(4))))
    monkeypatch.setattr(schemas, "SCHEMA_VERSION", 3)
    store = IndexStore(spark, root)
    assert done == [2, 3] and store.applied() == [1, 2, 3] and store.migrate() == []
    assert IndexStore(spark, root).applied() == [1, 2, 3] and done == [2, 3] and store.events().count() == 1
    monkeypatch.setattr(schemas, "SCHEMA_VERSION", 2)
    with pytest.raises(IngestionError):
        IndexStore(spark, root)


def test_registering_again_replaces(spark, store):
    store.register_source(as_row(spark, OWN))
    store.register_source(as_row(spark, {**OWN, "display_name": "Renamed"}))
    assert [r.display_name for r in store.sources().collect()] == ["Renamed"]


def test_search_over_the_store(spark, store):
    go(spark, store, [("a", "# Fruit\n\napples and pears"), ("b", "# Cars\n\nengines")])
    asked = spark.createDataFrame([("r", "apples", ["owner:me"], [], 8, None), ("s", "apples", ["owner:you"], [], 8, None)], "request_id string, query string, grants array<string>, source_ids array<string>, top_k int, vector array<double>")
    chunks = store.chunks().withColumn("embedding", F.col("dense_embedding"))
    assert [(r.request_id, r.chunk_id[:7]) for r in R.hybrid(asked, chunks).collect()] == [("r", "notes:a")]


def test_descriptors(tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps({"source_id": "n", "source_type": "web", "display_name": "N", "owner": "o", "rights_policy": "public_domain", "url": "https://x.example"}))
    assert load_descriptor(str(path))["configuration"] == {"url": "https://x.example"}
    for bad in ({"source_id": "bad id"}, {"visibility": "secret"}, {"owner": ""}):
        with pytest.raises(ValueError):
            descriptor({**OWN, **bad})


def test_no_local_scratch_folder_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace

    from quarry.errors import EngineError
    from quarry.plans.shared import checkpoint_dir

    none = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none)))
    with pytest.raises(EngineError):
        checkpoint_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=context))
    assert checkpoint_dir(spark)
