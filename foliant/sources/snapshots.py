"""A chapter cache as a table of versions: readers see one whole version, whatever is being written.

A version is a manifest in `log/`, which names the data folders that it is made of, in order; where several have a chapter the last one counts. A write puts its rows into a new
folder, and then its manifest under the next number. The manifest is written under another name and renamed, which fails if the number is taken: then another
writer was first, and the write is tried again on top of that version, without writing the rows again. The greatest number is the current version, so a write that ends
half way leaves a folder that no version names and changes nothing; `vacuum` removes such folders and those of old versions.

A row without a text deletes its chapter. A write may carry the number of a stream's batch, which its version keeps, so that a batch that comes again can be told.

Each write adds small files; `compact` rewrites a version as one folder, sorted by site and key, as a new version with the same rows.

Manifests are read and written by the driver through Hadoop's file systems, so a table may lie wherever Spark reads and writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["site", "cache_key", "number"]
SCHEMA = "site string, cache_key string, number int, text string"
BROADCAST_ROWS = 1_000_000
FILE_BYTES = 128 << 20
TRIES = 20


class Snapshots:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark.sparkContext._jvm
        self.fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return [s.getPath().getName() for s in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._names("log") if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """What a version, by default the current one, is made of."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "folders": []}
        version = known[-1] if version is None else version
        if version not in known:
            raise LookupError(f"no version {version}")
        stream = self.fs.open(self._path(f"log/{version:012d}.json"))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Makes the manifest a version, unless its number is taken."""
        staged, target = self._path(f"log/_{uuid.uuid4().hex}"), self._path(f"log/{manifest['version']:012d}.json")
        stream = self.fs.create(staged, False)
        stream.write(json.dumps(manifest).encode())
        stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        if not self.fs.exists(target):
            try:
                context.rename(staged, target, none)
                return True
            except Exception as e:  # a taken number comes as the file system's own error
                if not self.fs.exists(target):
                    raise e
        self.fs.delete(staged, False)
        return False

    def _folder(self, rows: DataFrame) -> dict:
        """Rows in a new data folder."""
        name = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.path}/{name}")
        return {"path": name, "rows": self.spark.read.parquet(f"{self.path}/{name}").count(), "bytes": self.fs.getContentSummary(self._path(name)).getLength()}

    def batch(self) -> int:
        """The number of the last batch that was written, or -1."""
        return self.manifest().get("batch", -1)

    def write(self, rows: DataFrame, batch: int | None = None) -> int:
        """Adds chapters (site, cache_key, number, text), in place of those with the same number; gives the version. Of rows that repeat a chapter the greatest text counts, and one without a
        text deletes."""
        one = rows.groupBy(*(F.col(k).cast(t).alias(k) for k, t in zip(KEYS, ("string", "string", "int"), strict=True))).agg(F.max("text").alias("text"))
        folder = self._folder(one)
        for _ in range(TRIES):
            last = self.manifest()
            if self._commit({"version": last["version"] + 1, "folders": [*last["folders"], folder], "batch": last.get("batch", -1) if batch is None else batch}):
                return last["version"] + 1
        raise RuntimeError("other writers were first every time")

    def _rows(self, manifest: dict) -> DataFrame:
        load = lambda f: self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{f['path']}")
        out, newer, n_newer = None, None, 0
        for folder in reversed(manifest["folders"]):
            rows = load(folder)
            if out is None:
                out, newer = rows, rows.select(*KEYS)
            else:
                keys = F.broadcast(newer) if n_newer <= BROADCAST_ROWS else newer  # counted when they were written
                same = [rows[k].eqNullSafe(F.col(f"_{k}")) for k in KEYS]
                named = keys.toDF(*(f"_{k}" for k in KEYS))
                out = out.unionByName(rows.join(named, same[0] & same[1] & same[2], "left_anti"))
                newer = newer.unionByName(rows.select(*KEYS))
            n_newer += folder["rows"]
        return self.spark.createDataFrame([], SCHEMA) if out is None else out.where("text IS NOT NULL")

    def read(self, version: int | None = None) -> DataFrame:
        """The chapters of a version, by default the current one."""
        return self._rows(self.manifest(version))

    def compact(self, most: int = 1) -> int:
        """A version with the same chapters in one folder, if the current one has more than `most`; gives the version."""
        last = self.manifest()
        if len(last["folders"]) <= most:
            return last["version"]
        files = max(1, sum(f["bytes"] for f in last["folders"]) // FILE_BYTES)
        folder = self._folder(self._rows(last).repartitionByRange(files, *KEYS).sortWithinPartitions(*KEYS))
        for _ in range(TRIES):
            now = self.manifest()
            done = {f["path"] for f in last["folders"]}
            later = [f for f in now["folders"] if f["path"] not in done]
            if len(later) != len(now["folders"]) - len(done):
                return now["version"]  # compacted by another writer
            if self._commit({"version": now["version"] + 1, "folders": [folder, *later], "batch": now.get("batch", -1)}):
                return now["version"] + 1
        raise RuntimeError("other writers were first every time")

    def vacuum(self, versions: int = 1) -> list[str]:
        """Forgets all but the last versions, and removes data folders that these do not name; a write that is under way must not be running. Gives the removed folders."""
        known = self.versions()
        used = {f["path"] for v in known[-versions:] for f in self.manifest(v)["folders"]}
        for v in known[:-versions]:
            self.fs.delete(self._path(f"log/{v:012d}.json"), False)
        gone = sorted(f"data/{n}" for n in self._names("data") if f"data/{n}" not in used)
        for name in gone:
            self.fs.delete(self._path(name), True)
        return gone
