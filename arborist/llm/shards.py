"""Immutable shards under a versioned manifest, with size-tiered compaction; DataFrame operations only.

append() writes what arrives as small files, without a shuffle: each write task makes its own.
compact() puts the live shards into tiers by size (a factor of TIER each) and merges every tier of RUN
or more shards into files of about `target` bytes, again without a shuffle: shards of one tier have
similar sizes, so equal numbers of them make files of equal size. Larger files are left alone, and a
row is rewritten only when its shard moves up a tier.

A version is a manifest folder that appears by one rename, after its number was claimed by an
exclusive create; readers see a version whole or not at all. Files are never changed in place. A claim
that no version followed within CLAIM_S is void: the next writer takes the number, and the first one,
should it still live, finds the name taken and starts again. What dead writers left behind no version
names; vacuum() removes it once nothing has changed there for ABANDONED_S. Like any scan's, the list of a version's files is held by the driver.
"""

from __future__ import annotations

import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 32 << 20
SHARD_ROWS = 2048
TIER, RUN, FLOOR = 4, 4, 64 << 10
CLAIM_S = 600.0
ABANDONED_S = 86_400.0
MANIFEST = "path string, bytes long, n_rows long, tier int"


class ShardStore:
    """The shards below `root`, a path that Spark and Hadoop's file systems understand."""

    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, shard_rows: int = SHARD_ROWS, claim_s: float = CLAIM_S):
        self.claim_s = claim_s
        self.spark, self.root, self.target, self.shard_rows = spark, root.rstrip("/"), target, shard_rows
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        at = self._path(f"{self.root}/manifest")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n[1:]) for n in names if n[0] == "v" and n[1:].isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """(path, bytes, n_rows, tier) of a version's shards; without any version, no rows."""
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"no version {version}")
        if not known:
            return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in map(str.split, MANIFEST.split(", "))])
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/manifest/v{version or known[-1]:08d}")

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version (the last one); at least one append must have been made."""
        known = self.versions()
        if not known:
            raise ValueError("nothing has been appended yet")
        paths = [r.path for r in self.manifest(version or known[-1]).select("path").collect()]
        schema = self.spark.read.parquet(f"{self.root}/schema").schema
        return self.spark.read.schema(schema).parquet(*(paths or [f"{self.root}/schema"]))  # the schema's folder has no rows

    def append(self, rows: DataFrame) -> int:
        """Adds rows (any columns and nulls; repeated rows stay) as small shards; gives the new version. All appends need one schema."""
        kept = self._path(f"{self.root}/schema")
        if not self._fs.exists(kept):
            rows.limit(0).write.mode("ignore").parquet(f"{self.root}/schema")
        elif [f.simpleString() for f in self.spark.read.parquet(f"{self.root}/schema").schema] != [f.simpleString() for f in rows.schema]:
            raise ValueError("the rows have another schema than the store")
        made = self._write(rows.write.option("maxRecordsPerFile", self.shard_rows))
        return self._commit(lambda old: old.unionByName(made))

    def compact(self) -> int | None:
        """Merges every tier that has a run of shards; the new version, or None when there was nothing to merge."""
        version = None
        while True:
            base = self.manifest()
            live = base.where(F.col("bytes") < self.target // 2)
            runs = live.groupBy("tier").agg(F.count("*").alias("k"), F.sum("bytes").alias("b")).where(F.col("k") >= RUN).orderBy("tier").collect()
            merged = False
            for run in runs:
                files = max(1, round(run.b / self.target))
                if files >= run.k:
                    continue
                tier = live.where(F.col("tier") == run.tier)
                paths = [r.path for r in tier.orderBy("bytes", "path").select("path").collect()]
                schema = self.spark.read.parquet(f"{self.root}/schema").schema
                new = self._write(self.spark.read.schema(schema).parquet(*paths).coalesce(files).write)

                def swap(old: DataFrame, gone: DataFrame = tier.select("path"), new: DataFrame = new, k: int = run.k) -> DataFrame:
                    if old.join(gone, "path", "left_semi").count() != k:
                        raise RuntimeError("another writer has merged these shards")
                    return old.join(gone, "path", "left_anti").unionByName(new)

                version = self._commit(swap)
                merged = True
            if not merged:
                return version

    def vacuum(self, keep: int = 1, older_s: float = ABANDONED_S) -> int:
        """Removes what none of the last `keep` versions names: shards and manifests of older versions, and what writers left that died; the number of shards removed.

        A folder that no version names may be that of a writer still at work: it goes only if nothing in
        it is younger than older_s. What is there is listed before the versions are, so that a
        writer who commits meanwhile is seen. Readers of the versions that go must be done.
        """
        found = [(p, self._youngest(p)) for at in ("data", "manifest") for p in self._children(at)]
        known = self.versions()
        old, live = known[:-keep], known[-keep:]
        names = lambda some: [self.manifest(v).select("path") for v in some]
        union = lambda dfs: dfs[0] if len(dfs) == 1 else dfs[0].unionByName(union(dfs[1:]))
        count = 0
        if old:
            for r in union(names(old)).distinct().join(union(names(live)), "path", "left_anti").toLocalIterator():
                count += bool(self._fs.delete(self._path(r.path), False))
            for v in old:
                self._fs.delete(self._path(f"{self.root}/manifest/v{v:08d}"), True)
        folder = F.regexp_extract("path", "/data/([0-9a-f]{32})/", 1)
        used = {r[0] for r in union(names(live)).select(folder).distinct().toLocalIterator()} if live else set()
        before = (time.time() - older_s) * 1000
        for path, changed in found:
            name = path.getName()
            loose = name.startswith(".pending-") if path.getParent().getName() == "manifest" else name not in used
            if loose and changed <= before:
                self._fs.delete(path, True)
        return count

    def _children(self, at: str) -> list:
        where = self._path(f"{self.root}/{at}")
        return [s.getPath() for s in self._fs.listStatus(where)] if self._fs.exists(where) else []

    def _youngest(self, path) -> float:
        """When the last file or folder below a path was changed, in milliseconds; now where it changes as it is read."""
        try:
            own = self._fs.getFileStatus(path)
            below = [self._youngest(s.getPath()) for s in self._fs.listStatus(path)] if own.isDirectory() else []
            return max([float(own.getModificationTime()), *below])
        except Exception as why:
            if "FileNotFound" not in str(why):
                raise
            return time.time() * 1000

    def _write(self, writer) -> DataFrame:
        at = f"{self.root}/data/{uuid.uuid4().hex}"
        writer.option("compression", "zstd").parquet(at)
        meta = self.spark.read.parquet(at).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"))
        tier = F.floor(F.log(F.greatest("bytes", F.lit(FLOOR)) / FLOOR) / math.log(TIER)).cast("int")
        return meta.groupBy("path", "bytes").agg(F.count("*").alias("n_rows")).select("path", "bytes", "n_rows", tier.alias("tier"))

    def _commit(self, change) -> int:
        """Writes change(manifest) aside, claims the next number and renames; waits and starts again when another writer was faster."""
        self._fs.mkdirs(self._path(f"{self.root}/manifest"))
        while True:
            now = (self.versions() or [0])[-1] + 1
            aside = f"{self.root}/manifest/.pending-{uuid.uuid4().hex}"
            change(self.manifest()).coalesce(1).write.parquet(aside)
            claim = self._path(f"{self.root}/manifest/claim-{now:08d}")
            try:
                self._fs.create(claim, False).close()
            except Exception as why:
                if "AlreadyExists" not in str(why):
                    raise
                self._fs.delete(self._path(aside), True)
                self._wait(now, claim)
                continue
            if self._appear(aside, f"{self.root}/manifest/v{now:08d}"):
                return now
            self._fs.delete(self._path(aside), True)

    def _wait(self, number: int, claim) -> None:
        """Until the version is there, or its claim is gone or void (then it is removed)."""
        pause = 0.05
        while number not in self.versions():
            try:
                made = self._fs.getFileStatus(claim).getModificationTime() / 1000
            except Exception as why:
                if "FileNotFound" in str(why):
                    return
                raise
            if time.time() - made > self.claim_s:
                self._fs.delete(claim, False)
                return
            time.sleep(pause)
            pause = min(2.0, 2 * pause)

    def _appear(self, aside: str, name: str) -> bool:
        """Renames a folder unless the name is taken."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(name).toUri(), sc._jsc.hadoopConfiguration())
        try:
            context.rename(context.makeQualified(self._path(aside)), context.makeQualified(self._path(name)), sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Exception as why:
            if "AlreadyExists" in str(why):
                return False
            raise
        return True


def shard_and_compact(docs: DataFrame, root: str, target: int = TARGET, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """docs appended as shards, compacted, and read back from the committed version: the same rows and columns.

    Nulls, empty and long texts, repeated rows and any further columns are kept as they are; an empty
    table gives a version without rows.
    """
    store = ShardStore(docs.sparkSession, root, target, shard_rows)
    store.append(docs)
    store.compact()
    return store.read()
