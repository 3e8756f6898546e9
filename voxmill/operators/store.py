"""A keyed store on disk: buckets of Parquet files, of which a change rewrites only those that it touches, and a list of the current files that is put in place in one step."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxmill.operators.catalogue import changed_store


@dataclass(frozen=True)
class Store:
    """``(key string, value string)`` below ``path``, keys dealt to ``buckets`` by their hash.

    A version is a small JSON file that names a folder of data for each bucket. Writers write their folders first and then the next version, which exists as a whole or not at all; a writer
    that is killed before leaves the store as it was, and of two writers at once the slower one gets an error. Readers see one version.
    """

    spark: SparkSession
    path: str
    buckets: int = 64

    def _fs(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return jvm, folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def versions(self) -> list[int]:
        """The numbers of the versions there are."""
        _, store, folder = self._fs()
        return sorted(int(s.getPath().getName().removesuffix(".json")) for s in store.listStatus(folder) if s.getPath().getName().endswith(".json")) if store.exists(folder) else []

    def _folders(self, version: int | None = None) -> tuple[int, dict[int, str]]:
        known = self.versions()
        if not known:
            return 0, {}
        version = known[-1] if version is None else version
        text = "".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{version}.json").collect())
        found = json.loads(text)
        if found["buckets"] != self.buckets:
            raise ValueError(f"the store has {found['buckets']} buckets")
        return version, {int(k): v for k, v in found["folders"].items()}

    def _commit(self, version: int, folders: dict[int, str]) -> None:
        jvm, store, folder = self._fs()
        name = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
        out = store.create(name, False)
        out.write(bytearray(json.dumps({"buckets": self.buckets, "folders": folders}).encode()))
        out.close()
        final = jvm.org.apache.hadoop.fs.Path(folder, f"{version}.json")
        if store.exists(final) or not store.rename(name, final):
            store.delete(name, False)
            raise RuntimeError(f"another writer has made version {version}")

    def _read(self, folders: list[str]) -> DataFrame:
        kind = T.StructType.fromDDL("key string, value string")
        return self.spark.read.schema(kind).parquet(*[f"{self.path}/{f}" for f in folders]) if folders else self.spark.createDataFrame([], kind)

    def read(self, version: int | None = None) -> DataFrame:
        """All keys and values of the current version, or of an earlier one."""
        return self._read(sorted(set(self._folders(version)[1].values())))

    def get(self, keys: DataFrame) -> DataFrame:
        """``keys(key)`` with their values, null where there is none; only the buckets of these keys are read."""
        folders = self._folders()[1]
        wanted = {r[0] for r in keys.select(self._bucket().alias("b")).distinct().collect()}
        return keys.join(self._read(sorted({folders[b] for b in wanted if b in folders})), "key", "left")

    def _bucket(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.buckets)).cast("int")

    def upsert(self, changes: DataFrame) -> int:
        """The number of the version with ``changes(key, value, ord, deleted)`` applied: of a key the last one holds, and deleted keys go. Null keys are left out."""
        changes = changes.filter("key IS NOT NULL")
        version, folders = self._folders()
        touched = sorted(r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect())  # at most all buckets
        before = self._read(sorted({folders[b] for b in touched if b in folders}))
        return self._replace(version, folders, touched, changed_store(before, changes))

    def compact(self) -> int:
        """The number of a version with the same rows, one file for each bucket."""
        version, folders = self._folders()
        return self._replace(version, folders, sorted(folders), self.read())

    def _replace(self, version: int, folders: dict[int, str], touched: list[int], rows: DataFrame) -> int:
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn("bucket", self._bucket()).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        jvm, store, _ = self._fs()
        made = {b for b in touched if store.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}/bucket={b}"))}
        self._commit(version + 1, {b: f for b, f in folders.items() if b not in touched} | {b: f"{name}/bucket={b}" for b in made})
        return version + 1

    def vacuum(self, keep: int = 1) -> list[int]:
        """The last ``keep`` versions, after all others are removed together with what only they, or no version at all, name. Not for while others write."""
        jvm, store, folder = self._fs()
        kept = self.versions()[-keep:]
        live = {f for v in kept for f in self._folders(v)[1].values()}
        for v in set(self.versions()) - set(kept):
            store.delete(jvm.org.apache.hadoop.fs.Path(folder, f"{v}.json"), False)
        data = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        for s in store.listStatus(data) if store.exists(data) else []:
            name = s.getPath().getName()
            for b in store.listStatus(s.getPath()):
                if b.isDirectory() and f"data/{name}/{b.getPath().getName()}" not in live:
                    store.delete(b.getPath(), True)
            if not any(f.startswith(f"data/{name}/") for f in live):
                store.delete(s.getPath(), True)
        return kept
