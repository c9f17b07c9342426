"""Sets of tables that change as one: hash-bucketed folders, and a manifest for each version of the set.

A commit writes new folders for the buckets it touches and leaves all others where they are. Its last
act gives the manifest its final name, which exists once; readers take the manifest with the greatest
number, so they see a commit whole or not at all, and one that is killed leaves the version before it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit has taken the version's number."""


@dataclass(frozen=True)
class Snapshots:
    """Tables under a path, each with key columns whose hash gives a row's bucket.

    The number of buckets is that of the first commit and kept in the manifests. A bucket is rewritten
    as a whole and is a task's work, so it should be a few hundred MB: 10 TB want some 50,000.
    """

    spark: SparkSession
    path: str
    keys: dict[str, list[str]]
    buckets: int = 64

    def versions(self) -> list[int]:
        folder, files = self._files("versions")
        if not files.exists(folder):
            return []
        names = (s.getPath().getName() for s in files.listStatus(folder))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict | None:
        """What a version consists of, the newest if none is named; None where there is no version."""
        if version is None:
            version = max(self.versions(), default=None)
            if version is None:
                return None
        target, files = self._files(f"versions/{version}.json")
        stream = files.open(target)
        try:
            return json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, table: str, version: int | None = None) -> DataFrame | None:
        """The rows of a table in a version; None where there is none."""
        found = self.manifest(version)
        return None if found is None else self._rows(found, table)

    def merge(self, fresh: dict[str, DataFrame], clear: bool = False) -> dict[str, int]:
        """Puts the fresh rows, unique by key, in place of those with the same keys, or of all with ``clear``.

        Returns the rows of each table in the new version. Null keys are keys like any other. Only
        buckets with fresh rows are read and written.
        """
        before = self.manifest()
        number = 0 if before is None else before["version"] + 1
        old = None if clear else before
        buckets = self.buckets if before is None else before["buckets"]
        tables = {}
        for table, rows in fresh.items():
            keys, held = self.keys[table], {} if old is None else dict(old["tables"][table]["folders"])
            folder = f"data/{table}/{uuid.uuid4().hex}"
            coming = rows.withColumn("bucket", self._bucket(keys, buckets))
            if held:
                from graphloom.storage import shared_table

                coming = shared_table(coming, "fresh")  # asked for its buckets, then written
                touched = [str(r["bucket"]) for r in coming.select("bucket").distinct().collect()]  # at most a number a bucket
                if met := [b for b in touched if b in held]:
                    kept = self._rows(old, table, met).withColumn("bucket", self._bucket(keys, buckets)).alias("kept")
                    same = [F.col(f"kept.{k}").eqNullSafe(F.col(f"new.{k}")) for k in ["bucket", *keys]]
                    coming = kept.join(coming.select("bucket", *keys).alias("new"), same, "left_anti").unionByName(coming)
            coming.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
            written = self.spark.read.schema(coming.schema).parquet(f"{self.path}/{folder}")
            for r in written.groupBy("bucket").count().collect():  # a number a bucket
                held[str(r["bucket"])] = [folder, r["count"]]
            tables[table] = {"schema": rows.schema.json(), "folders": held}
        self._commit({"version": number, "buckets": buckets, "time": time.time(), "tables": tables})
        return {t: sum(n for _, n in x["folders"].values()) for t, x in tables.items()}

    def vacuum(self, keep: int = 1, hours: float = 24) -> int:
        """Removes all versions but the last ``keep``, and bucket folders that none of those names.

        Folders younger than ``hours`` stay: a commit under way may have written them. Returns the
        number of folders removed.
        """
        numbers = self.versions()
        kept = [self.manifest(v) for v in numbers[-keep:]] if keep > 0 else []
        if not kept:
            raise ValueError("at least one version must stay")
        named = {f"{folder}/bucket={b}" for m in kept for t in m["tables"].values() for b, (folder, _) in t["folders"].items()}
        for v in numbers[:-keep]:
            target, files = self._files(f"versions/{v}.json")
            files.delete(target, False)
        removed, limit = 0, (time.time() - hours * 3600) * 1000
        for table in self.keys:
            for commit in self._list(f"data/{table}"):
                base = f"data/{table}/{commit.getPath().getName()}"
                if commit.getModificationTime() > limit:
                    continue
                parts = [p for p in self._list(base) if p.isDirectory()]
                gone = [p for p in parts if f"{base}/{p.getPath().getName()}" not in named]
                for p in gone if len(gone) < len(parts) else [commit]:
                    self._files("")[1].delete(p.getPath(), True)
                removed += len(gone)
        return removed

    def _rows(self, manifest: dict, table: str, only: Iterable[str] | None = None) -> DataFrame:
        described = manifest["tables"][table]
        folders = described["folders"]
        schema = StructType.fromJson(json.loads(described["schema"]))
        paths = [f"{self.path}/{folders[b][0]}/bucket={b}" for b in (folders if only is None else only)]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    @staticmethod
    def _bucket(keys: list[str], buckets: int):
        return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def _commit(self, manifest: dict) -> None:
        jvm = self.spark.sparkContext._jvm
        final, files = self._files(f"versions/{manifest['version']}.json")
        draft, _ = self._files(f"versions/.{uuid.uuid4().hex}.draft")
        out = files.create(draft, False)
        try:
            out.write(json.dumps(manifest).encode())
        finally:
            out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(draft, final, none)  # fails where the number is taken
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                raise Conflict(f"version {manifest['version']} of {self.path} has been written meanwhile") from e
            raise

    def _files(self, name: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list:
        folder, files = self._files(name)
        return list(files.listStatus(folder)) if files.exists(folder) else []
