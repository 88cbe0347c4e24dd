"""Index state as a fold over an append-only log, on any Hadoop file system.

A store is a folder: data/<table>/index_run_id=R/ holds what a run has staged, log/ one JSON file for
each event, numbered. An event is committed by creating its file exclusively, so of two writers one
fails and reads again; file systems that only look before they write are refused. Nothing is ever changed:
activation, discard and rollback are events, and the active corpus is the newest activated staging of each
document that is not a tombstone. Every SNAPSHOT events their list is written beside the log, so a look at it
reads one file and the few events after it.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry import schemas
from quarry.errors import IngestionError
from quarry.functions.vectors import DIMENSIONS

# ---- folds ----


def run_states(events: DataFrame) -> DataFrame:
    """(run_id, status, activation_seq) by each run's last event."""
    return events.groupBy("run_id").agg(F.max_by("status", "event_seq").alias("status"), F.max("activation_seq").alias("activation_seq"))


def activated(events: DataFrame) -> DataFrame:
    return run_states(events).where("status = 'activated'").select("run_id", "activation_seq")


def active_versions(stagings: DataFrame, events: DataFrame) -> DataFrame:
    """(document_id, content_hash, index_run_id): of each document the newest activated staging, without tombstones."""
    rows = stagings.join(activated(events).withColumnRenamed("run_id", "index_run_id"), "index_run_id")
    newest = rows.groupBy("document_id").agg(F.max_by(F.struct("is_tombstone", "content_hash", "index_run_id"), "activation_seq").alias("last"))
    return newest.where("not last.is_tombstone").select("document_id", "last.content_hash", "last.index_run_id")


def active_chunks(chunks: DataFrame, active: DataFrame) -> DataFrame:
    keys = active.select("document_id", F.col("content_hash").alias("document_version_hash"), "index_run_id")
    return chunks.join(keys, ["document_id", "document_version_hash", "index_run_id"], "left_semi")


def violations(chunks: DataFrame, versions: DataFrame, dimensions: int) -> DataFrame:
    """(rule, n): rows that break a rule of the store; all have to be zero before a commit."""
    orphans = chunks.join(versions.select("document_id", F.col("content_hash").alias("document_version_hash")), ["document_id", "document_version_hash"], "left_anti")
    counts = [
        chunks.agg(F.count_if(F.coalesce(F.size("dense_embedding") != dimensions, F.lit(False))).alias("n")).select(F.lit("embedding_width").alias("rule"), "n"),
        chunks.groupBy("chunk_id").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("chunk_id_unique").alias("rule"), "n"),
        versions.groupBy("document_id", "content_hash").count().where("count > 1").agg(F.count("*").alias("n")).select(F.lit("version_unique").alias("rule"), "n"),
        orphans.agg(F.count("*").alias("n")).select(F.lit("chunk_has_version").alias("rule"), "n"),
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


# ---- the store ----

#: Events between two snapshots of the log.
SNAPSHOT = 100
#: File systems whose exclusive creation is not atomic.
NOT_EXCLUSIVE = ("s3", "s3a", "s3n", "oss", "cosn", "swift", "obs")
#: Changes of a store's layout, in order: (version, what is done to a store of the version before).
MIGRATIONS: tuple[tuple[int, Callable[[IndexStore], None]], ...] = ((2, lambda store: store.snapshot()),)

_TABLES = {"versions": schemas.VERSIONS, "chunks": schemas.CHUNKS, "stagings": schemas.STAGINGS, "sources": schemas.SOURCES}


class IndexStore:
    def __init__(self, spark: SparkSession, root: str, dimensions: int = DIMENSIONS):
        self.spark, self.root, self.dimensions = spark, root.rstrip("/"), dimensions
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        if self._fs.getScheme() in NOT_EXCLUSIVE:
            raise IngestionError(f"commits need files that are created exclusively; {self._fs.getScheme()} cannot do that")
        if not self._fs.exists(self._path(f"{self.root}/schema.json")):
            self._exclusively(f"{self.root}/schema.json", {"schema_version": schemas.SCHEMA_VERSION}, "the store has been made meanwhile")
        self.migrate()

    # layout

    def applied(self) -> list[int]:
        """The version that the store was made with, and those it has been brought to since."""
        folder = self._path(f"{self.root}/migrations")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted({json.loads(self._read(self._path(f"{self.root}/schema.json")))["schema_version"], *(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))})

    def migrate(self) -> list[int]:
        """Apply what is missing, in order; each change is recorded when it is done, so a second call does nothing. The versions applied."""
        now = self.applied()[-1]
        if now > schemas.SCHEMA_VERSION:
            raise IngestionError("the store has a later schema version")
        todo = [(v, change) for v, change in MIGRATIONS if now < v <= schemas.SCHEMA_VERSION]
        for version, change in todo:
            change(self)
            self._exclusively(f"{self.root}/migrations/{version:06d}.json", {"schema_version": version, "at": datetime.now(UTC).isoformat()}, "another writer has changed the layout")
        return [v for v, _ in todo]

    # files

    def _create(self, path, value: dict) -> None:
        """The file, or an error if there is one already."""
        data = json.dumps(value).encode()
        if self._fs.getScheme() == "file":  # Hadoop looks before it writes here; a link is made or not
            name = path.toUri().getPath()
            os.makedirs(os.path.dirname(name), exist_ok=True)
            with tempfile.NamedTemporaryFile(dir=os.path.dirname(name), suffix=".tmp") as temp:
                temp.write(data)
                temp.flush()
                try:
                    os.link(temp.name, name)
                except FileExistsError as other:
                    raise FileExistsError(f"{name} already exists") from other
            return
        out = self._fs.create(path, False)  # fails if the file exists
        try:
            out.write(bytearray(data))
        finally:
            out.close()

    def _read(self, path) -> str:
        stream = self._fs.open(path)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _exclusively(self, path: str, value: dict, taken: str) -> None:
        try:
            self._create(self._path(path), value)
        except Exception as other:
            if "already exists" in str(other):
                raise IngestionError(taken) from other
            raise

    def _named(self, folder: str) -> list[tuple[int, object]]:
        where = self._path(f"{self.root}/{folder}")
        found = [s.getPath() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []
        return sorted((int(p.getName().removesuffix(".json")), p) for p in found if p.getName().endswith(".json"))

    def _log(self) -> list[dict]:
        """All events in order: those of the last snapshot, and the files after it. The log has an event for each step of a run, not for each document."""
        snapshots = self._named("snapshots")
        held = json.loads(self._read(snapshots[-1][1]))["events"] if snapshots else []
        return held + [json.loads(self._read(p)) for n, p in self._named("log") if n >= len(held)]

    def snapshot(self) -> None:
        """Write the events so far as one file; it appears by rename when it is complete. Of two writers of one snapshot either's will do."""
        events = self._log()
        path, temp = self._path(f"{self.root}/snapshots/{len(events):020d}.json"), self._path(f"{self.root}/snapshots/{uuid.uuid4().hex}.tmp")
        if events and not self._fs.exists(path):
            self._create(temp, {"events": events})
            if not self._fs.rename(temp, path):
                self._fs.delete(temp, False)

    def _commit(self, event: dict, seen: int) -> None:
        self._exclusively(f"{self.root}/log/{seen:020d}.json", {**event, "event_seq": seen, "at": datetime.now(UTC).isoformat()}, "another writer has committed; read the log again")
        if (seen + 1) % SNAPSHOT == 0:
            self.snapshot()

    # reading

    def events(self) -> DataFrame:
        rows = [(e["event_seq"], e["run_id"], e["source_id"], e["status"], e.get("activation_seq")) for e in self._log()]
        return self.spark.createDataFrame(rows, schemas.RUN_EVENTS)

    def table(self, name: str) -> DataFrame:
        path = f"{self.root}/data/{name}"
        if not self._fs.exists(self._path(path)):
            return self.spark.createDataFrame([], _TABLES[name])
        return self.spark.read.schema(_TABLES[name]).parquet(path)

    def active(self) -> DataFrame:
        return active_versions(self.table("stagings"), self.events())

    def active_documents(self, source_id: str | None = None) -> DataFrame:
        """Version rows of the active corpus."""
        rows = self.table("versions").join(self.active().drop("index_run_id"), ["document_id", "content_hash"], "left_semi")
        return rows if source_id is None else rows.where(F.col("source_id") == source_id)

    def chunks(self) -> DataFrame:
        return active_chunks(self.table("chunks"), self.active())

    def active_run(self) -> str | None:
        done = [e for e in self._states().values() if e["status"] == "activated"]
        return max(done, key=lambda e: e["activation_seq"])["run_id"] if done else None

    def _states(self) -> dict[str, dict]:
        states: dict[str, dict] = {}
        for e in self._log():
            states[e["run_id"]] = {**states.get(e["run_id"], {}), **{k: v for k, v in e.items() if v is not None}}
        return states

    # writing

    def open_run(self, source_id: str) -> str:
        run = f"index-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid.uuid4().hex[:8]}"
        self._commit({"run_id": run, "source_id": source_id, "status": "candidate"}, len(self._log()))
        return run

    def _candidate(self, run: str) -> dict:
        state = self._states().get(run)
        if not state or state["status"] != "candidate":
            raise IngestionError(f"{run} is not a candidate run")
        return state

    def stage(self, run: str, versions: DataFrame, chunks: DataFrame, tombstones: DataFrame | None = None) -> None:
        """Write a run's documents; staging a run again replaces what it had staged. tombstones: document_id.

        Rows that break a rule of the store (see violations) are refused before anything is written.
        """
        self._candidate(run)
        broken = [f"{r.rule}: {r.n} rows" for r in violations(chunks, versions, self.dimensions).where("n > 0").collect()]  # a row for each rule at most
        if broken:
            raise IngestionError("nothing is staged: " + ", ".join(broken))
        staged = versions.select(F.lit(run).alias("index_run_id"), "document_id", "content_hash", F.lit(False).alias("is_tombstone"))
        if tombstones is not None:
            gone = tombstones.select(F.lit(run).alias("index_run_id"), "document_id", F.lit(None).cast("string").alias("content_hash"), F.lit(True).alias("is_tombstone"))
            staged = staged.join(gone.select("document_id"), "document_id", "left_anti").select(gone.columns).unionByName(gone)
        for name, rows in (("versions", versions.withColumn("index_run_id", F.lit(run))), ("chunks", chunks.drop("index_run_id").withColumn("index_run_id", F.lit(run))), ("stagings", staged)):
            rows.drop("index_run_id").write.mode("overwrite").parquet(f"{self.root}/data/{name}/index_run_id={run}")

    def activate(self, run: str) -> None:
        """One event; readers see the corpus before or after it."""
        state, log = self._candidate(run), self._log()
        last = max([e["activation_seq"] for e in log if e.get("activation_seq") is not None], default=0)
        self._commit({"run_id": run, "source_id": state["source_id"], "status": "activated", "activation_seq": last + 1}, len(log))

    def discard(self, run: str) -> None:
        """The run's rows stay as evidence. An unknown run is left alone."""
        state = self._states().get(run)
        if state and state["status"] == "candidate":
            self._commit({"run_id": run, "source_id": state["source_id"], "status": "discarded"}, len(self._log()))

    def rollback(self) -> str | None:
        """Retire the newest activated run; the run that is active then, or None."""
        run = self.active_run()
        if run is None:
            raise IngestionError("there is no activated run to roll back")
        self._commit({"run_id": run, "source_id": self._states()[run]["source_id"], "status": "rolled_back"}, len(self._log()))
        return self.active_run()

    def register_source(self, descriptor: DataFrame) -> None:
        """Upsert: later rows of a source win (see sources())."""
        descriptor.withColumn("registered_at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/data/source_rows")

    def sources(self) -> DataFrame:
        rows = self.spark.read.parquet(f"{self.root}/data/source_rows")
        names = [c for c in rows.columns if c not in ("source_id", "registered_at")]
        return rows.groupBy("source_id").agg(F.max_by(F.struct(*names), "registered_at").alias("r")).select("source_id", "r.*")
