"""A table of candidates in hash buckets of Parquet files, with a numbered manifest for each version.

A save reads, folds and rewrites only the buckets that its profiles fall into, then puts the next manifest in place under
a name that must not exist yet. Of two savers at a time one gets the number; the other finds it taken, reads the newer
version and folds anew, so no update is lost. Readers see one version or the next, never a half. The manifest also holds
the last batch number of each stream, so a batch that is delivered again changes nothing.

Each bucket also has sketches of what it holds, made anew by the save that writes it, so the whole store's statistics are told
without reading profiles. A bucket without any (of an older table) is sketched when they are asked for.

Profiles without e-mail and name share an id though they are strangers: they are stored as they come, never folded, and
dealt over all buckets.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from amalgam.operators.fold import NOBODY, fold_pairs
from amalgam.operators.scratch import deleted, materialised
from amalgam.operators.sketches import QUANTILES, SCHEMA, bucket_sketches, estimates

BUCKETS, ATTEMPTS = 64, 20


class CandidateStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        """``buckets`` holds for a new table; an existing one keeps its own number."""
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def init(self) -> CandidateStore:
        """Make the store's folder where there is none; nothing happens where there is one."""
        folder = self._path("manifests")
        folder.getFileSystem(self._conf).mkdirs(folder)
        return self

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _manifest(self) -> dict:
        """The latest version: number, buckets, schema, the folder of each bucket, and the last batch of each stream."""
        folder = self._path("manifests")
        files = folder.getFileSystem(self._conf)
        found = sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []
        found = [f for f in found if f.endswith(".json") and not f.startswith((".", "_"))]
        if not found:
            return {"number": 0, "buckets": self.buckets, "schema": None, "folders": {}, "batches": {}}
        stream = files.open(self._path(f"manifests/{found[-1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> bool:
        """Put the manifest in place; false if another saver has taken its number."""
        draft, target = self._path(f"manifests/_{uuid.uuid4().hex}"), self._path(f"manifests/{manifest['number']:012d}.json")
        files = target.getFileSystem(self._conf)
        out = files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(manifest).encode()))
        finally:
            out.close()
        options = self.spark.sparkContext._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf).rename(draft, target, options)
        except Py4JJavaError as e:
            files.delete(draft, False)
            if "AlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def _read(self, manifest: dict, buckets: set[int] | None = None) -> DataFrame | None:
        """The stored rows of these buckets (null: of all); null before the first save."""
        if manifest["schema"] is None:
            return None
        folders = [f"{self.path}/{v}" for b, v in manifest["folders"].items() if buckets is None or int(b) in buckets]
        schema = T.StructType.fromJson(json.loads(manifest["schema"]))
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame | None:
        """The stored table, or null before the first save."""
        return self._read(self._manifest())

    def save(self, profiles: DataFrame, created_at: str, as_of: str, batch: tuple[str, int] | None = None) -> DataFrame:
        """Insert profiles, folding those of a candidate into one another and into the stored one. ``created_at``: of new rows.

        ``batch``: a stream's name and the number of its batch; one that was saved before is left out. The profiles are evaluated once,
        however often the version has to be made anew.
        """
        if batch and self._manifest()["batches"].get(batch[0], -1) >= batch[1]:
            return self.current()
        profiles, path = materialised(profiles, "incoming")
        for _ in range(ATTEMPTS):
            base = self._manifest()
            if batch and base["batches"].get(batch[0], -1) >= batch[1]:
                break
            if self._commit(self._written(base, profiles, created_at, as_of, batch)):
                break
        else:
            raise RuntimeError(f"other savers took every one of {ATTEMPTS} versions")
        deleted(self.spark, path)
        return self.current()

    def _written(self, base: dict, profiles: DataFrame, created_at: str, as_of: str, batch: tuple[str, int] | None) -> dict:
        """Write the touched buckets anew; the manifest of the version that this makes."""
        at = F.to_timestamp(F.lit(created_at))
        new = profiles.select(*[c for c in profiles.columns if c not in ("run_id", "created_at")]).withColumn("created_at", at)
        where = bucket_of(base["buckets"], new.columns)
        touched = {r[0] for r in new.select(where).distinct().collect()}  # at most as many as there are buckets
        stored = self._read(base, touched)
        merged = fold_pairs(new.limit(0) if stored is None else stored.select(*new.columns), new, as_of, keep_first=("created_at",))
        version = f"v-{uuid.uuid4().hex}"
        dealt = merged.withColumn("bucket", bucket_of(base["buckets"], new.columns)) if stored is None else merged.withColumn("bucket", bucket_of(base["buckets"], new.columns, touched))
        dealt.repartition("bucket").sortWithinPartitions("bucket", "candidate_id").write.partitionBy("bucket").parquet(f"{self.path}/{version}")
        sketched = f"s-{uuid.uuid4().hex}"
        written = self.spark.read.schema(T.StructType([*merged.schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{version}")
        bucket_sketches(written).write.partitionBy("bucket").parquet(f"{self.path}/{sketched}")
        others = lambda known: {b: v for b, v in known.items() if int(b) not in touched}
        folders, sketches = others(base["folders"]) | self._dealt(version), others(base.get("sketches", {})) | self._dealt(sketched)
        batches = base["batches"] | ({batch[0]: batch[1]} if batch else {})
        return base | {"number": base["number"] + 1, "schema": base["schema"] or merged.schema.json(), "folders": folders, "sketches": sketches, "batches": batches}

    def _dealt(self, version: str) -> dict[str, str]:
        """The folder of each bucket in a folder that was written by buckets."""
        found = self._path(version).getFileSystem(self._conf).listStatus(self._path(version))
        names = [f.getPath().getName() for f in found if f.isDirectory()]
        return {n.split("=")[1]: f"{version}/{n}" for n in names}

    def statistics(self, quantiles: Sequence[float] = QUANTILES) -> DataFrame:
        """(statistic, n, estimate) of all profiles, from the buckets' sketches."""
        manifest = self._manifest()
        folders = manifest.get("sketches", {})
        paths = [f"{self.path}/{v}" for v in folders.values()]
        parts = self.spark.read.schema(SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMA)
        missing = {int(b) for b in manifest["folders"].keys() - folders.keys()}
        if missing:
            parts = parts.unionByName(bucket_sketches(self._read(manifest, missing).withColumn("bucket", F.lit(0))).drop("bucket"))
        return estimates(parts, quantiles)

    def vacuum(self) -> None:
        """Delete folders and manifests that the current version does not use. Not while others read older versions or save."""
        now = self._manifest()
        folder = self._path("manifests")
        for f in folder.getFileSystem(self._conf).listStatus(folder) if now["number"] else []:
            if f.getPath().getName() < f"{now['number']:012d}.json":
                folder.getFileSystem(self._conf).delete(f.getPath(), False)
        used = {v.split("/")[0] for v in [*now["folders"].values(), *now.get("sketches", {}).values()]}
        files = self._path().getFileSystem(self._conf)
        for f in files.listStatus(self._path()):
            name = f.getPath().getName()
            if name.startswith(("v-", "s-")) and name not in used:
                files.delete(f.getPath(), True)

    def get(self, candidate_id: str) -> DataFrame:
        """The candidate's most recent row, if any; reads its bucket alone."""
        manifest = self._manifest()
        own = None if candidate_id == NOBODY else {zlib.crc32(candidate_id.encode()) % manifest["buckets"]}
        return get_candidate(self._read(manifest, own), candidate_id)

    def list(self) -> DataFrame:
        """All candidates, the most recent first."""
        return list_candidates(self.current())


def bucket_of(buckets: int, columns: list[str], among: set[int] | None = None) -> Column:
    """A candidate's bucket; strangers' by a hash of what is known of them, among the given ones."""
    known = F.crc32(F.col("candidate_id")) % buckets
    names = sorted(among) if among else list(range(buckets))
    any_ = F.get(F.array(*map(F.lit, names)), F.pmod(F.xxhash64(*columns), F.lit(len(names))).cast("int"))
    return F.when(F.col("candidate_id").isNull() | (F.col("candidate_id") == NOBODY), any_).otherwise(known).cast("int")


def get_candidate(stored: DataFrame, candidate_id: str) -> DataFrame:
    return stored.filter(F.col("candidate_id") == candidate_id).orderBy(F.desc("created_at")).limit(1)


def list_candidates(stored: DataFrame) -> DataFrame:
    return stored.orderBy(F.desc("created_at"))
