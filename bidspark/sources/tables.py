"""Tables as folders of Parquet files: idempotent partial writes, and intermediate tables in the shared folder.

A table's rows are dealt to buckets by a hash of its keys. A write touches only the buckets of the keys it is about: it reads them,
writes their new rows to `v=<version>/b=<bucket>`, and commits by renaming a small manifest into place, which says for each bucket
the version that counts and for each writer the last batch it wrote. So a reader sees all of a write or nothing, a killed write leaves
files that no manifest names, and a batch that comes again finds itself in the manifest and is left out. One writer at a time writes a
table. Only Spark and the Hadoop file system of the path are used, so any store with renames will do.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidspark.operators.relational import VERSION, replace_by_document, upsert

MANIFEST = "_manifest-"
KEEP = 2  # manifests whose files stay, for readers that still hold the one before


def shared(spark: SparkSession) -> str:
    """A fresh path in the folder that the cluster shares (spark.checkpoint.dir); in local mode a temporary one stands in."""
    conf = spark.sparkContext.getConf()
    base = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not base:
        if not conf.get("spark.master", "local").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"{tempfile.gettempdir()}/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def passing(spark: SparkSession) -> str:
    """A fresh path in the shared folder whose files go with the session."""
    path = shared(spark)
    _fs(spark, path).deleteOnExit(_path(spark, path))
    return path


def staged(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: several later steps read it, and lost executors cost a reread. It goes
    with the session."""
    path = passing(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Table:
    """A table in the folder `path`, whose rows are dealt by `keys`; a null key is a key too. A table that nothing was written to
    is empty. The number of buckets is fixed by the first write."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ("document_id",), buckets: int = 64):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), tuple(keys), buckets
        self.empty = spark.createDataFrame([], schema)
        self.fs = _fs(spark, self.path)

    def _at(self, name: str):
        return _path(self.spark, f"{self.path}/{name}")

    def _names(self) -> list[str]:
        root = _path(self.spark, self.path)
        return [s.getPath().getName() for s in self.fs.listStatus(root)] if self.fs.exists(root) else []

    def _manifests(self) -> list[int]:
        return sorted(int(n[len(MANIFEST) :]) for n in self._names() if n.startswith(MANIFEST))

    def _load(self, version: int) -> dict:
        stream = self.fs.open(self._at(f"{MANIFEST}{version}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def manifest(self) -> dict:
        """version; buckets: bucket -> version; writers: writer -> last batch; count: number of buckets."""
        found = self._manifests()
        return self._load(found[-1]) if found else {"version": -1, "buckets": {}, "writers": {}, "count": self.buckets}

    def written(self, writer: str) -> int:
        """The last batch of `writer`; -1 if there is none."""
        return self.manifest()["writers"].get(writer, -1)

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        live = {int(b): v for b, v in manifest["buckets"].items() if buckets is None or int(b) in set(buckets)}
        paths = [f"{self.path}/v={v}/b={b}" for b, v in sorted(live.items())]
        return self.spark.read.schema(self.empty.schema).parquet(*paths) if paths else self.empty

    def read(self) -> DataFrame:
        return self._rows(self.manifest())

    def change(self, touched: DataFrame, f: Callable[[DataFrame], DataFrame], writer: str, batch: int, at: Callable[[str], None] = lambda _: None) -> bool:
        """Replace the rows of the buckets of `touched` keys by f(those rows), once for each batch of a writer; batches rise. False,
        and nothing done, if the batch was written before. at: told each step, so that tests can end a write there."""
        old = self.manifest()
        if batch <= old["writers"].get(writer, -1):
            return False
        version, count = old["version"] + 1, old["count"]
        place = F.pmod(F.xxhash64(*self.keys), F.lit(count)).cast("int").alias("b")
        hit = [r.b for r in touched.select(place).distinct().collect()]  # one row a bucket at most
        at("stage")
        rows = f(self._rows(old, hit)).select(*self.empty.columns)
        stage = f"_stage-{version}-{uuid.uuid4().hex}"
        rows.withColumn("b", place).repartition(max(1, len(hit)), "b").write.partitionBy("b").parquet(f"{self.path}/{stage}")
        at("rename")
        final = self._at(f"v={version}")
        self.fs.delete(final, True)  # of a write that ended before its manifest
        if not self.fs.rename(self._at(stage), final):
            raise OSError(f"could not rename {stage}")
        names = {s.getPath().getName() for s in self.fs.listStatus(final)}
        live = {b: v for b, v in old["buckets"].items() if int(b) not in hit} | {str(b): version for b in hit if f"b={b}" in names}
        at("manifest")
        new = {"version": version, "buckets": live, "writers": old["writers"] | {writer: batch}, "count": count}
        draft = self._at(f"_draft-{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        if not self.fs.rename(draft, self._at(f"{MANIFEST}{version}")):
            raise OSError(f"could not commit version {version}")
        at("clean")
        self._clean()
        return True

    def _clean(self) -> None:
        """Delete what the last manifests don't name."""
        found = self._manifests()
        kept = [self._load(v) for v in found[-KEEP:]]
        used = {(v, int(b)) for m in kept for b, v in m["buckets"].items()}
        for n in self._names():
            if n.startswith(("_stage-", "_draft-")) or n.startswith(MANIFEST) and int(n[len(MANIFEST) :]) not in found[-KEEP:]:
                self.fs.delete(self._at(n), True)
            elif n.startswith("v="):
                v, live = int(n[2:]), 0
                for s in self.fs.listStatus(self._at(n)):
                    b = s.getPath().getName()
                    if b.startswith("b="):
                        live += (v, int(b[2:])) in used
                        if (v, int(b[2:])) not in used:
                            self.fs.delete(s.getPath(), True)
                if not live:
                    self.fs.delete(self._at(n), True)


def upsert_into(table: Table, updates: DataFrame, writer: str, batch: int, keys: Sequence[str] = ("document_id", "provider"), **more) -> bool:
    """IO4 as a write: updates replace rows of the same key, `created_at` stays."""
    rows = updates.select(*table.empty.columns)
    return table.change(rows, lambda old: upsert(old, rows, keys), writer, batch, **more)


def replace_in(table: Table, fresh: DataFrame, writer: str, batch: int, touched: DataFrame | None = None, keys: Sequence[str] = ("document_id",), **more) -> bool:
    """IO5 as a write: all rows of touched documents give way to the fresh ones."""
    rows, gone = fresh.select(*table.empty.columns), fresh if touched is None else touched
    return table.change(gone.select(*table.keys), lambda old: replace_by_document(old, rows, keys, gone), writer, batch, **more)


def refresh_in(table: Table, fresh: DataFrame, writer: str, batch: int, touched: DataFrame | None = None, **more) -> bool:
    """CH6 as a write: all points of re-indexed files give way to the fresh ones; of equal point ids one stays."""
    once = fresh.dropDuplicates(["point_id"])
    return replace_in(table, once, writer, batch, touched, VERSION, **more)
