"""Sharding by size-tiered compaction.

Arrivals are appended as small immutable files. A run is what one append or one merge wrote; runs of
about one size are merged into files of the target size. What readers see is one manifest, a JSON
file per version, put in place by one step that fails if the version exists (a rename where the file
system's is atomic, a conditional put in object stores): a reader sees all of an append or a merge,
or nothing of it.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hadoop_fs, quoted, spare, without


@dataclass
class Shard:
    path: str  # below the store's root
    bytes: int


@dataclass
class Run:
    id: int
    tier: int
    batches: list[str]
    shards: list[Shard]

    @property
    def bytes(self) -> int:
        return sum(s.bytes for s in self.shards)

    @property
    def folders(self) -> list[str]:
        return sorted({s.path.rsplit("/", 1)[0] for s in self.shards})


@dataclass
class Manifest:
    version: int = 0
    next_run: int = 0
    schema: str | None = None
    runs: list[Run] = field(default_factory=list)

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(raw["version"], raw["next_run"], raw["schema"], [Run(r["id"], r["tier"], r["batches"], [Shard(**s) for s in r["shards"]]) for r in raw["runs"]])


@dataclass(frozen=True)
class Policy:
    target_bytes: int = 128 << 20  #: size of a merged file
    least_bytes: int = 1 << 20  #: runs below this are one tier
    fan: int = 4  #: sizes in a tier differ by less than this factor, and so many runs of a tier are merged

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.least_bytes, self.fan)) + 1) if size >= self.least_bytes else 0


class Conflict(RuntimeError):
    """Another writer has committed the version first."""


#: Stores whose renames copy, but which can refuse to write over an object.
OBJECT_STORES = frozenset({"s3a", "s3", "s3n", "gs", "abfs", "abfss", "wasb", "wasbs", "oss", "cosn"})


class ShardStore:
    """A versioned table of shards below `root`.

    conditional_put says how a manifest is committed: by creating its file only if there is none, or
    (in file systems, the default there) by an atomic rename. A store that offers neither can't hold one.
    """

    def __init__(self, spark: SparkSession, root: str, policy: Policy = Policy(), conditional_put: bool | None = None):
        self.spark, self.root, self.policy = spark, root.rstrip("/"), policy
        scheme = self.root.split("://")[0] if "://" in self.root else ""
        self.conditional_put = scheme in OBJECT_STORES if conditional_put is None else conditional_put
        self.fs, _ = hadoop_fs(spark, self.root)
        self.jvm = spark.sparkContext._jvm
        self._pending: set[str] = set()  # folders written by this store and not yet committed

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    # ------------------------------------------------------------ manifests

    def versions(self) -> list[int]:
        folder = self._path("_manifest")
        if not self.fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName()[1:-5]) for s in self.fs.listStatus(folder) if s.getPath().getName().startswith("v") and s.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        have = self.versions()
        if version is None and not have:
            return Manifest()
        stream = self.fs.open(self._path(f"_manifest/v{have[-1] if version is None else version:012d}.json"))
        try:
            return Manifest.from_json(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _commit(self, manifest: Manifest) -> Manifest:
        """Atomic: the version's name exists with all of its content, or doesn't; Conflict if it exists already."""
        manifest.version += 1
        final = self._path(f"_manifest/v{manifest.version:012d}.json")
        try:
            (self._put if self.conditional_put else self._rename)(manifest, final)
        except Exception as failed:
            if "AlreadyExists" in str(failed):
                raise Conflict(f"version {manifest.version} exists") from failed
            raise
        return manifest

    def _write_to(self, out, manifest: Manifest) -> None:
        out.write(bytearray(manifest.to_json().encode()))
        out.close()

    def _put(self, manifest: Manifest, final) -> None:
        builder = self.fs.createFile(final).overwrite(False).recursive()
        self._write_to(builder.opt("fs.option.create.conditional.overwrite", "true").build(), manifest)

    def _rename(self, manifest: Manifest, final) -> None:
        draft = self._path(f"_manifest/.{uuid.uuid4().hex}")
        self._write_to(self.fs.create(draft, False), manifest)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri() if final.toUri().getScheme() else self.fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.spark.sparkContext._gateway.new_array(rename, 1)
        how[0] = getattr(rename, "NONE")
        try:
            context.rename(draft, final, how)
        except Exception:
            self.fs.delete(draft, False)
            raise

    # ------------------------------------------------------------ writing

    def _files(self, folder: str) -> list[Shard]:
        """The shards in a folder below the root; none where there is no such folder."""
        path = self._path(folder)
        files = [s for s in self.fs.listStatus(path) if s.getPath().getName().startswith("part-")] if self.fs.exists(path) else []
        return sorted((Shard(f"{folder}/{s.getPath().getName()}", s.getLen()) for s in files), key=lambda s: s.path)

    def _write(self, rows: DataFrame) -> list[Shard]:
        """Files of a new run; its folder's name is its own, so a failed attempt never mixes with another."""
        name = f"run-{uuid.uuid4().hex}"
        rows.write.option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self._files(name)

    def _add(self, shards: list[Shard], batch: str, schema: str) -> Manifest:
        """Commit written shards as a run; on a conflict only the commit is tried again. Shards of a batch that is there by then are deleted."""
        while True:
            manifest = self.manifest()
            if any(batch in r.batches for r in manifest.runs):
                for folder in Run(0, 0, [], shards).folders:
                    self.fs.delete(self._path(folder), True)
                return manifest
            run = Run(manifest.next_run, 0, [batch], shards)
            run.tier = self.policy.tier(run.bytes)
            manifest.runs.append(run)
            manifest.next_run += 1
            manifest.schema = manifest.schema or schema
            try:
                return self._commit(manifest)
            except Conflict:
                continue

    def append(self, rows: DataFrame, batch: str) -> Manifest:
        """Add an arrival as a run of small files. A batch that the store has already is not added again, so a retry after a crash is safe."""
        manifest = self.manifest()
        if any(batch in r.batches for r in manifest.runs):
            return manifest
        return self._add(self._write(rows), batch, rows.schema.json())

    def append_each(self, rows: DataFrame, number: Column, batches: list[str], then: Callable[[], object] = lambda: None) -> None:
        """Add several arrivals, one after another, from one pass over rows: batches[k] are those whose `number` is k.

        `then` runs after each. Batches that the store has already are not added again.
        """
        column, name = spare(rows, "arrival"), f"run-{uuid.uuid4().hex}"
        rows.withColumn(column, number.cast("int")).write.option("compression", "zstd").partitionBy(column).parquet(f"{self.root}/{name}")
        folders = [f"{name}/{column}={k}" for k in range(len(batches))]
        self._pending.update(folders)
        for folder, batch in zip(folders, batches, strict=True):
            self._add(self._files(folder), batch, rows.schema.json())
            self._pending.discard(folder)
            then()

    def compact(self) -> Manifest:
        """Merge the runs of any tier that holds `fan` of them, until none does; rows are moved, never changed.

        A merge reads its runs' files and writes as many as the target size asks for, without a
        shuffle. Small runs that fall short of the fan wait for more arrivals.
        """
        while True:
            manifest = self.manifest()
            tiers: dict[int, list[Run]] = {}
            for run in manifest.runs:
                tiers.setdefault(run.tier, []).append(run)
            full = min((t for t, runs in tiers.items() if len(runs) >= self.policy.fan), default=None)
            if full is None:
                return manifest
            merged = tiers[full]
            size = sum(r.bytes for r in merged)
            rows = self._read(manifest, merged).coalesce(max(1, math.ceil(size / self.policy.target_bytes)))
            shards, gone = self._write(rows), {r.id for r in merged}
            while True:  # on a conflict the merged files are still right, as long as nobody else merged these runs
                run = Run(manifest.next_run, 0, sorted(b for r in merged for b in r.batches), shards)
                run.tier = max(self.policy.tier(run.bytes), full + 1)
                manifest.next_run += 1
                manifest.runs = [r for r in manifest.runs if r.id not in gone] + [run]
                try:
                    self._commit(manifest)
                    break
                except Conflict:
                    manifest = self.manifest()
                    if not gone <= {r.id for r in manifest.runs}:
                        for folder in run.folders:
                            self.fs.delete(self._path(folder), True)
                        break

    def vacuum(self, keep: int = 2) -> int:
        """Delete files that none of the last `keep` versions names, and older versions; returns how many folders went. Not for use while a writer is at work."""
        have = self.versions()
        named = self._pending | {f for v in have[-keep:] for r in self.manifest(v).runs for f in r.folders}
        gone = 0
        for status in self.fs.listStatus(self._path("")) if have else []:
            name = status.getPath().getName()
            if not name.startswith("run-") or name in named:
                continue
            inner = [f"{name}/{s.getPath().getName()}" for s in self.fs.listStatus(status.getPath()) if s.isDirectory()]
            for folder in [f for f in inner if f not in named] if any(f in named for f in inner) else [name]:
                self.fs.delete(self._path(folder), True)
                gone += 1
        for v in have[:-keep]:
            self.fs.delete(self._path(f"_manifest/v{v:012d}.json"), False)
        return gone

    # ------------------------------------------------------------ reading

    def _read(self, manifest: Manifest, runs: list[Run]) -> DataFrame:
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest.schema))
        paths = [f"{self.root}/{s.path}" for r in runs for s in r.shards]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version. An empty store has no schema, and so cannot be read."""
        manifest = self.manifest(version)
        if manifest.schema is None:
            raise ValueError("nothing was ever appended")
        return self._read(manifest, manifest.runs)

    def placed(self) -> DataFrame:
        """read() with three more columns: run, shard and version; columns of these names are replaced."""
        manifest = self.manifest()
        at = F.col("_metadata.file_path")
        rows = self.read()
        folder = F.regexp_extract(at, r"(run-[0-9a-f]+(?:/[^/]+=\d+)?)/part-", 1)
        run_of = F.create_map(*(F.lit(x) for r in manifest.runs for f in r.folders for x in (f, r.id))) if manifest.runs else None  # a few runs in each tier
        run = (F.try_element_at(run_of, folder) if run_of is not None else F.lit(None)).cast("long")
        others = without(rows, "run", "shard", "version")
        return rows.select(*(quoted(c) for c in others), run.alias("run"), F.regexp_extract(at, r"part-(\d+)-", 1).cast("long").alias("shard"), F.lit(manifest.version).cast("long").alias("version"))


def store_in_arrivals(docs: DataFrame, root: str, arrivals: int = 8, policy: Policy = Policy()) -> ShardStore:
    """Append docs in arrivals of neighbouring doc_ids, of about as many rows each, compacting after each.

    Rows of one doc_id arrive together, those with a null doc_id with the last. An empty table gives
    a store of empty arrivals. docs is read once for its ids and once to be written.
    """
    store = ShardStore(docs.sparkSession, root, policy)
    doc_id = quoted("doc_id").cast("long")
    cuts = docs.select(doc_id.cast("double").alias("doc_id")).approxQuantile("doc_id", [k / arrivals for k in range(1, arrivals)], 0.001)
    number = F.lit(0)
    for cut in cuts:
        number = number + F.when(doc_id > F.lit(cut), 1).otherwise(0)

    def settle() -> None:
        store.compact()
        store.vacuum()

    store.append_each(docs, F.when(doc_id.isNull(), arrivals - 1).otherwise(number), [f"arrival-{k}" for k in range(arrivals)], settle)
    return store
