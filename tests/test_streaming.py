import json

from quarry import schemas
from quarry.plans.store import IndexStore
from quarry.sources.descriptor import descriptor
from quarry.streaming import ingest as L
from tests.oracle import DATA

OWN = descriptor({"source_id": "s", "source_type": "web", "display_name": "S", "owner": "me", "rights_policy": "public_domain"})


def test_a_stream_fills_the_index_as_a_batch_does(spark, tmp_path):
    def drop(n, *texts):
        rows = [("s", k, k, "text/plain", "available", k, 1, "r", t, "p", None, None, None, json.dumps({})) for k, t in texts]
        spark.createDataFrame(rows, schemas.RAW_DOCUMENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    store = IndexStore(spark, f"file://{tmp_path}/store")

    def run():
        L.index_stream(L.raw_documents(spark, f"{tmp_path}/in"), store, OWN, f"{tmp_path}/check").awaitTermination()

    drop(1, ("a", "one"), ("b", "two"))
    run()
    drop(2, ("b", "two changed"))
    run()
    run()
    assert {r.item_id for r in store.active_documents().collect()} == {"a", "b"}
    assert store.events().where("status = 'activated'").count() == 2
    assert sorted(r.text for r in store.chunks().collect()) == ["one", "two changed"]


def test_windows_of_a_stream_equal_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = L.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in"), delay="365 days")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    got = {(r.window_start, r.event_type, r.n) for r in spark.table("windows").collect()}
    assert got == {(r.window_start, r.event_type, r.n) for r in L.windowed(events).collect()}
