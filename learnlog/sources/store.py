"""The history table on storage: Parquet folders by generation, kind and hash bucket of the id.

A write makes a new generation (``data/g=<n>``) and then a commit, a small file that names the
folders which are the table from now on. Readers take the newest commit, so they see a write as a whole or
not at all, and a crash leaves the table as it was. An append adds folders; an edit writes anew only
the (kind, bucket) folders that hold one of its ids. Every commit also leaves a change log: one signed
row per record added or removed, for streams (``streaming.counts``) and maintained summaries.

One writer at a time: it holds a lock file, created atomically beside the table, from reading
its base to its commit. The folder must be shared by the driver and all executors, and its
file system must create and rename files atomically.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
import uuid
from contextlib import contextmanager
from typing import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from learnlog.functions import json as J
from learnlog.session import checkpoint_dir, written
from learnlog.sources import fixtures as FX
from learnlog.sources.tables import table_path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _read_text(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        reader = spark.sparkContext._jvm.java.io.BufferedReader(
            spark.sparkContext._jvm.java.io.InputStreamReader(stream, "UTF-8"))
        lines = []
        line = reader.readLine()
        while line is not None:
            lines.append(line)
            line = reader.readLine()
        return "\n".join(lines)
    finally:
        stream.close()


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory())


# One wide nullable schema for all six record kinds (fields a kind lacks are null).
# ``n_vocabulary`` counts an analysis' vocabulary when it is stored, so that summaries need not
# parse the body.
HISTORY_DDL = ("id string, ts timestamp_ntz, mode string, language string, input_text string, "
               "output_text string, explanation string, analysis_data string, n_vocabulary int, "
               "exercise_data string, voice string, has_audio boolean, audio_data string, chat_text string, "
               "message_count int, context string, tips_text string, tips_count int")

_BUILD_LOCK = threading.RLock()


#: The change log: what a commit added (sign 1) and removed (sign -1).
CHANGES_DDL = "version long, sign int, id string, ts timestamp_ntz, mode string, language string"

#: Hash buckets of the id per kind in a new table: an edit of one id rewrites one of them.
BUCKETS = 8


class HistoryStore:
    """``<root>/data/g=<generation>/mode=<kind>/bucket=<b>/part-*.parquet``, ``<root>/commits/<n>.json``,
    ``<root>/changes/version=<n>/part-*.parquet``, ``<root>/schema.json``, ``<root>/lock``."""

    def __init__(self, spark: SparkSession, root: str, lock_seconds: float = 600, buckets: int = BUCKETS):
        """``buckets`` counts for a table that is made by this store; a table keeps its number."""
        self.spark = spark
        self.root = root.rstrip("/")
        self.path = f"{self.root}/data"
        self.changes_path = f"{self.root}/changes"
        self.lock_seconds = lock_seconds
        self.new_buckets = buckets

    @contextmanager
    def locked(self):
        """Hold the table's lock. A writer waits up to ``lock_seconds`` for another to finish; a
        lock left by a writer that died is removed with ``unlock``."""
        fs, p = _fs(self.spark, f"{self.root}/lock")
        until, absent = time.monotonic() + self.lock_seconds, 0
        while True:
            try:
                fs.create(p, False).close()  # fails if the file exists
                break
            except Exception as e:
                # it may have been released meanwhile; where it can't be made, it is absent every time
                absent = 0 if fs.exists(p) else absent + 1
                if absent > 5 or time.monotonic() > until:
                    raise RuntimeError(f"the history table {self.root} is locked, or cannot be") from e
                time.sleep(0.2)
        try:
            self._publish_changes()  # those of a writer that died after its commit
            yield
        finally:
            fs.delete(p, False)

    def unlock(self) -> None:
        fs, p = _fs(self.spark, f"{self.root}/lock")
        fs.delete(p, False)

    # ------------------------------------------------------------------- description

    def exists(self) -> bool:
        return path_exists(self.spark, f"{self.root}/schema.json")

    def _description(self) -> dict:
        if not self.exists():
            raise FileNotFoundError(f"no history table under {self.root}")
        return json.loads(_read_text(self.spark, f"{self.root}/schema.json"))

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(self._description()["schema"])

    def create_if_missing(self, schema_df: DataFrame | None = None) -> None:
        """Create an empty table (the wide history schema unless another is given)."""
        if not self.exists():
            fields = (schema_df or self.spark.createDataFrame([], HISTORY_DDL)).schema.fields
            for folder in (self.path, f"{self.root}/commits", self.changes_path, f"{self.root}/pending"):
                fs, p = _fs(self.spark, folder)
                fs.mkdirs(p)
            schema = T.StructType([f for f in fields if f.name != "mode"] + [f for f in fields if f.name == "mode"])
            _write_text(self.spark, f"{self.root}/schema.json", json.dumps(
                {"schema": json.loads(schema.json()), "buckets": self.new_buckets}))

    # ----------------------------------------------------------------------- commits

    def version(self) -> int:
        """Number of the newest commit; 0 before the first."""
        fs, p = _fs(self.spark, f"{self.root}/commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return max([int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith(".")], default=0)

    def folders(self, version: int | None = None) -> list[str]:
        """The folders (below ``data``) that are the table as of a commit."""
        n = self.version() if version is None else version
        return json.loads(_read_text(self.spark, f"{self.root}/commits/{n:012d}.json"))["folders"] if n else []

    def _commit(self, folders: list[str], changes: DataFrame) -> None:
        n = self.version() + 1
        pending = f"{self.root}/pending/version={n}"
        changes.select("sign", "id", "ts", "mode", "language").write.mode("overwrite").parquet(pending)
        made, target = f"{self.root}/commits/.{uuid.uuid4().hex}", f"{self.root}/commits/{n:012d}.json"
        _write_text(self.spark, made, json.dumps({"folders": sorted(folders)}))
        fs, p = _fs(self.spark, made)
        if path_exists(self.spark, target) or not fs.rename(p, _fs(self.spark, target)[1]):
            raise RuntimeError(f"another writer committed version {n} of {self.root}")
        self._publish_changes()

    def _publish_changes(self) -> None:
        """Move the change rows of commits into the log; drop those that were never committed."""
        n = self.version()
        for name in list_dirs(self.spark, f"{self.root}/pending"):
            fs, p = _fs(self.spark, f"{self.root}/pending/{name}")
            if int(name.split("=")[1]) <= n:
                fs.rename(p, _fs(self.spark, f"{self.changes_path}/{name}")[1])
            else:
                fs.delete(p, True)

    def _write(self, df: DataFrame, finish: Callable[[DataFrame], DataFrame] = lambda dealt: dealt) -> list[str]:
        """Write ``df`` as the next generation; its folders. Rows are dealt by (kind, bucket), large
        groups split from their measured size, so that a bucket gets few files; ``finish`` puts to
        the dealt rows what need not be shuffled."""
        name = f"g={self.version() + 1}-{uuid.uuid4().hex[:8]}"
        dealt = finish(df.withColumn("bucket", self._bucket("id")).hint("rebalance", "mode", "bucket"))
        dealt.sortWithinPartitions("mode", "bucket", "ts").write.partitionBy("mode", "bucket").parquet(f"{self.path}/{name}")
        return [f"{name}/{m}/{b}" for m in list_dirs(self.spark, f"{self.path}/{name}")
                for b in list_dirs(self.spark, f"{self.path}/{name}/{m}")]

    def _bucket(self, key: str) -> Column:
        return F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(self._description()["buckets"])).cast("int")

    # ------------------------------------------------------------------------- reads

    def _read(self, folders: list[str]) -> DataFrame:
        """The rows of some folders, with their ``bucket``."""
        schema = self.schema()
        if not folders:
            return self.spark.createDataFrame([], schema).withColumn("bucket", F.lit(0))
        rows = self.spark.read.schema(schema).option("basePath", self.path).parquet(*[f"{self.path}/{f}" for f in folders])
        return rows.select(*schema.names, "bucket")

    def read(self, version: int | None = None) -> DataFrame:
        """The table as of a commit, the newest by default."""
        return self.rows_of(self.folders(version))

    def rows_of(self, folders: list[str]) -> DataFrame:
        """The rows of some folders of ``data``."""
        return self._read(folders).drop("bucket")

    def changes(self) -> DataFrame:
        """The change log of all commits."""
        return self.spark.read.schema(CHANGES_DDL).parquet(self.changes_path)

    def fingerprint(self) -> str:
        """Identifies the table's present contents: every write makes folders of new names."""
        return hashlib.sha1("|".join(self.folders()).encode()).hexdigest()[:16]

    # ------------------------------------------------------------------------ writes

    def _conform(self, records: DataFrame) -> DataFrame:
        """Records in the stored column order and types; missing fields null; a translation's
        ``target_language`` becomes the unified ``language``."""
        if "target_language" in records.columns and "language" not in records.columns:
            records = records.withColumnRenamed("target_language", "language")
        if "analysis_data" in records.columns and "n_vocabulary" not in records.columns:
            records = records.withColumn("n_vocabulary", J.vocabulary_size("analysis_data"))
        return records.select(*[
            (F.col(f.name) if f.name in records.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in self.schema().fields])

    def append(self, records: DataFrame, finish: Callable[[DataFrame], DataFrame] | None = None) -> None:
        """Add records (no existing file is rewritten). ``finish``, a step per row, completes records that
        are still short, after they have been shuffled."""
        self.create_if_missing()
        with self.locked():
            if finish is None:
                made = self._write(self._conform(records))
            else:
                made = self._write(records, lambda dealt: self._conform(finish(dealt)).withColumn("bucket", self._bucket("id")))
            self._commit([*self.folders(), *made], self._read(made).withColumn("sign", F.lit(1)))

    def _replace(self, keys: DataFrame, key: str, incoming: DataFrame | None) -> None:
        """Take the records whose key is in ``keys`` out, put ``incoming`` in; only the (kind, bucket)
        folders that lose records are written anew, those that only gain some get a folder more."""
        keys = written(keys.select(key).where(F.col(key).isNotNull()).distinct(), "edit-keys")
        now = self.folders()
        parts = lambda f: tuple(x.split("=", 1)[1] for x in f.split("/")[1:])  # noqa: E731  (kind, bucket)
        near = now
        if key == "id":  # the buckets are made of it: at most their number of rows
            buckets = {str(r["b"]) for r in keys.select(self._bucket(key).alias("b")).distinct().collect()}
            near = [f for f in now if parts(f)[1] in buckets]
        gone = self._read(near).select("id", "ts", "mode", "language", "bucket", *({key} - set(_LOGGED))).join(
            keys, key, "left_semi")
        gone = written(gone, "edit-removed")
        hit = {(r["mode"] or NO_KIND, str(r["bucket"])) for r in gone.select("mode", "bucket").distinct().collect()}
        old = [f for f in near if (unquote(parts(f)[0]), parts(f)[1]) in hit]
        new = self._read(old).drop("bucket").join(keys, key, "left_anti").select(*self.schema().names)
        if incoming is not None:
            new = new.unionByName(incoming)
        made = self._write(new) if old or incoming is not None else []
        changed = gone.withColumn("sign", F.lit(-1)).select("sign", *_LOGGED)
        if incoming is not None:
            changed = changed.unionByName(incoming.withColumn("sign", F.lit(1)).select("sign", *_LOGGED))
        self._commit([f for f in now if f not in set(old)] + made, changed)

    def upsert(self, records: DataFrame, key: str = "id") -> None:
        """The given records replace stored ones of the same id, whatever their times. Of records
        given twice the one with the latest ``ts`` counts."""
        self.create_if_missing()
        with self.locked():
            cols = self.schema().names
            incoming = self._conform(records)
            best = F.max(F.struct("ts", *[c for c in cols if c not in (key, "ts")])).alias("b")
            incoming = written(incoming.groupBy(key).agg(best).select(key, "b.*").select(*cols), "upsert")
            self._replace(incoming.select(key), key, incoming)

    def delete(self, ids: DataFrame, key: str = "id") -> None:
        """Remove the records whose ``key`` is in ``ids``."""
        with self.locked():
            self._replace(ids.select(F.col(key).cast(self.schema()[key].dataType)), key, None)

    def clear_all(self) -> None:
        """Remove every record; the empty table stays."""
        with self.locked():
            self._commit([], self._read(self.folders()).withColumn("sign", F.lit(-1)))

    def compact(self, most: int = 4) -> None:
        """Write the (kind, bucket) pairs that are spread over more than ``most`` folders into one each."""
        with self.locked():
            now, of = self.folders(), {}
            for f in now:
                of.setdefault(f.split("/", 1)[1], []).append(f)
            old = [f for fs in of.values() if len(fs) > most for f in fs]
            if old:
                made = self._write(self._read(old).drop("bucket"))
                self._commit([f for f in now if f not in set(old)] + made, self._read([]).withColumn("sign", F.lit(1)))

    def vacuum(self, keep: int = 2) -> None:
        """Delete what none of the newest ``keep`` commits names: readers of older ones must be done."""
        with self.locked():
            n = self.version()
            used = {f for v in range(max(1, n - keep + 1), n + 1) for f in self.folders(v)}
            for g in list_dirs(self.spark, self.path):
                for m in list_dirs(self.spark, f"{self.path}/{g}"):
                    for b in list_dirs(self.spark, f"{self.path}/{g}/{m}"):
                        if f"{g}/{m}/{b}" not in used:
                            fs, p = _fs(self.spark, f"{self.path}/{g}/{m}/{b}")
                            fs.delete(p, True)


_LOGGED = ("id", "ts", "mode", "language")
#: The folder of records without a kind.
NO_KIND = "__HIVE_DEFAULT_PARTITION__"

# Bump when the derivation in ``fixtures.stored_records`` changes, so a table written by an
# older derivation is never reused.
FIXTURE_VERSION = "8"
# Bump when the logic behind a derived table (e.g. ``analysis.summary_text``) changes.
DERIVED_VERSION = "3"


def derived_table(spark: SparkSession, store: HistoryStore, name: str, build) -> DataFrame:
    """A table derived from the store's present contents (e.g. the per-language summary),
    written once under ``<root>/derived`` and reused until the contents change."""
    target = f"{store.root}/derived/{name}-{DERIVED_VERSION}-{store.fingerprint()}"
    with _BUILD_LOCK:
        if not path_exists(spark, f"{target}/_SUCCESS"):
            build(store.read()).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target)


def _fixture_key(spark: SparkSession, sf_dir: str) -> str:
    """Identifies the input files by their Hadoop status (path, size, time of every part)."""
    parts = [FIXTURE_VERSION]
    for name in ("events", "documents", "benchmark", "conversations"):
        fs, p = _fs(spark, table_path(sf_dir, name))
        parts += sorted(f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in fs.listStatus(p))
    return hashlib.sha1("|".join(parts).encode()).hexdigest()[:16]


def history_store(spark: SparkSession, sf_dir: str) -> HistoryStore:
    return HistoryStore(spark, f"{checkpoint_dir(spark)}/learnlog-history/{_fixture_key(spark, sf_dir)}")


def build_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ingest job: derive every history record from the driver tables (the append path
    of all kinds) and write the table partitioned by ``mode``, source texts by reference."""
    store = history_store(spark, sf_dir)
    complete = lambda rows: FX.with_passages(rows, spark, sf_dir)
    records = FX.referring_records(spark, sf_dir)
    store.create_if_missing(complete(records))
    store.clear_all()
    store.append(records, complete)
    _write_text(spark, f"{store.root}/built", "")
    return store.read()


def history_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored records for ``sf_dir``, texts by reference; the table is built on first use (once
    per process even when queries are started from several threads)."""
    store = history_store(spark, sf_dir)
    with _BUILD_LOCK:
        if not path_exists(spark, f"{store.root}/built"):
            return build_history(spark, sf_dir)
    return store.read()


def history_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored history for ``sf_dir`` with texts and JSON bodies."""
    return FX.with_texts(history_rows(spark, sf_dir), spark, sf_dir)


def history_bodies(spark: SparkSession, sf_dir: str):
    """Puts texts and bodies to a bounded number of ``history_rows`` (``bodies`` of ``analysis.vocabulary_top``).
    What the rows are is found first, and the few whole records are written, so that a later step
    may take them in one task. They are analyses, which have no ``chat_text``."""
    return lambda rows: written(
        FX.with_texts(written(rows, "newest-rows"), spark, sf_dir, few=True).drop("chat_text"), "newest-records")
