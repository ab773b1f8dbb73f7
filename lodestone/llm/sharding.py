"""Sharding by size-tiered compaction with a versioned manifest (DataFrame functions only).

append() writes arrivals as small immutable shards, one or more Parquet files for
each input partition, without a shuffle. compact() puts the manifest's shards into
tiers of similar size and merges the runs of a tier into files of about the target
size; shards that already have it are left alone. Each step ends with one new
manifest version: a table with a row for each shard, published by creating a small
pointer file version-<n>.json, which fails if another writer took that number.
Readers see the newest version whose pointer is whole; a job that dies leaves files
that no version names, and vacuum() removes those and the ones that compaction replaced.
A compaction takes at most `batch` runs, so the files that one job opens are bounded;
each run of a job is merged by a task of its own.

Defined results: nulls in any column are stored as they are; a row without text
counts as a few bytes; repeated rows and ties are kept; an empty table commits an
empty manifest; extra columns are stored too; columns named like the store's own
(`_lodestone_bytes`, `_lodestone_file`, `_lodestone_run`) raise ValueError.
"""

from __future__ import annotations

import functools
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remove, saved, tidy

#: Columns that the store adds to its files.
BYTES, FILE, RUN = "_lodestone_bytes", "_lodestone_file", "_lodestone_run"
OWN = {BYTES, FILE, RUN}
MANIFEST = "shard string, rows long, bytes long, tier int, born int"


def _shard_of_row() -> Column:
    """The manifest's name of the file that a row is read from: a merged shard has its run's folder in it."""
    parts = F.split("_metadata.file_path", "/")
    tail = F.when(F.url_decode(F.element_at(parts, -2)).startswith(f"{RUN}="), F.slice(parts, -3, 3)).otherwise(F.slice(parts, -2, 2))
    return F.url_decode(F.concat_ws("/", tail))


class ShardStore:
    """A folder of shards with its manifests.

    target_bytes: uncompressed bytes that merged files aim at; least_bytes: edge
    of the lowest tier; fanout: ratio between tiers; runs: shards of one tier
    that are needed before it is merged; rows_per_shard: most rows of an arrival; batch:
    most runs of one compaction; wide: most shards whose table is broadcast."""

    def __init__(self, spark: SparkSession, path: str, target_bytes: int = 128 << 20, least_bytes: int = 1 << 20, fanout: int = 4, runs: int = 2, rows_per_shard: int = 1_000_000, codec: str = "zstd", batch: int = 1024, wide: int = 1_000_000):
        if not 0 < least_bytes <= target_bytes or fanout < 2 or runs < 2:
            raise ValueError("need 0 < least_bytes <= target_bytes, fanout >= 2, runs >= 2")
        self.spark, self.path, self.codec = spark, path.rstrip("/"), codec
        self.target, self.least, self.fanout, self.runs, self.rows = target_bytes, least_bytes, fanout, runs, rows_per_shard
        self.batch, self.wide = batch, wide

    # -- versions -----------------------------------------------------------
    def _jpath(self, name: str = ""):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _fs(self):
        root = self._jpath()
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(root)
        return fs

    def _names(self) -> list[str]:
        return [x.getPath().getName() for x in self._fs().listStatus(self._jpath())]

    def _numbers(self) -> list[int]:
        return sorted((int(n[8:-5]) for n in self._names() if n.startswith("version-") and n.endswith(".json")), reverse=True)

    def version(self) -> int:
        return next((v for v in self._numbers() if self._pointer(v)), 0)

    def _pointer(self, version: int) -> dict | None:
        """The pointer's content; None while its writer is at it, or if that one died."""
        rows = self.spark.read.text(f"{self.path}/version-{version:08d}.json", wholetext=True).head(1)
        try:
            return json.loads(rows[0][0])
        except (IndexError, ValueError):
            return None

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row per shard: shard (path inside the store), rows, bytes, tier, born."""
        v = self.version() if version is None else version
        if not v:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/{self._pointer(v)['manifest']}")

    def _commit(self, entries: DataFrame, base: int, schema: str) -> int:
        fs, v = self._fs(), base + 1
        name = f"manifest-{v:08d}-{uuid.uuid4().hex}"
        with tidy(self.spark):
            entries.coalesce(1).write.parquet(f"{self.path}/{name}")
        try:
            out = fs.create(self._jpath(f"version-{v:08d}.json"), False)
        except Exception as error:
            fs.delete(self._jpath(name), True)
            raise RuntimeError(f"version {v} exists: another writer committed first") from error
        out.write(bytearray(json.dumps({"version": v, "manifest": name, "schema": schema}).encode()))
        out.close()
        return v

    # -- shards ---------------------------------------------------------------
    @staticmethod
    def _row_bytes(df: DataFrame) -> Column:
        total = F.lit(8 * max(1, len(df.columns)))
        for f in df.schema.fields:
            if isinstance(f.dataType, (T.StringType, T.BinaryType)):
                total = total + F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0))
        return total.cast("long")

    def _tier(self, size: Column) -> Column:
        steps = F.log(float(self.fanout), F.greatest(size.cast("double"), F.lit(1.0)) / self.least)
        return F.when(2 * size >= self.target, F.lit(1000)).otherwise(F.greatest(F.floor(steps), F.lit(-1)) + 1).cast("int")

    def _measured(self, folder: str, born: int) -> DataFrame:
        """Manifest rows for the files of a folder, read from one narrow column."""
        df = self.spark.read.schema(f"{BYTES} long").parquet(f"{self.path}/{folder}")
        name = F.concat(F.lit(f"{folder}/"), F.element_at(F.split("_metadata.file_path", "/"), -1))
        out = df.groupBy(name.alias("shard")).agg(F.count("*").alias("rows"), F.sum(BYTES).alias("bytes"))
        return out.select("shard", "rows", "bytes", self._tier(F.col("bytes")).alias("tier"), F.lit(born).alias("born"))

    def append(self, df: DataFrame) -> int:
        """Store arrivals as small shards; the new version."""
        if OWN & set(df.columns):
            raise ValueError(f"{sorted(OWN)} are names of the store")
        base = self.version()
        folder = f"arrived-{uuid.uuid4().hex}"
        sized = df.withColumn(BYTES, self._row_bytes(df))
        with tidy(self.spark):
            sized.write.option("maxRecordsPerFile", self.rows).option("compression", self.codec).parquet(f"{self.path}/{folder}")
        return self._commit(self.manifest(base).unionByName(self._measured(folder, base + 1)), base, df.schema.json())

    def plan(self, version: int | None = None) -> DataFrame:
        """shard -> run: what one compaction merges. Inside a tier, shards in order
        of arrival fill runs up to the target; a run of one shard is not rewritten."""
        todo = self.manifest(version).where("tier < 1000 and rows > 0")
        order = Window.partitionBy("tier").orderBy("born", "shard")
        run = F.floor((F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("bytes")) / self.target)
        runs = todo.select("shard", "tier", "bytes", run.alias("k"))
        full = runs.groupBy("tier", "k").agg(F.count("*").alias("n")).where(F.col("n") >= self.runs)
        return runs.join(full, ["tier", "k"]).select("shard", F.concat_ws("-", "tier", "k").alias(RUN))

    def compact(self) -> int:
        """Merge similar shards once; the new version, or the present one if no
        tier has enough runs."""
        base = self.version()
        if not base:
            return 0
        # the runs of one job: the names of the files that it opens, a bounded number
        plan = whole = saved(self.plan(base), "shard-plan")
        names = [r[0] for r in plan.select(RUN).distinct().orderBy(RUN).limit(self.batch).collect()]
        if not names:
            remove(plan)
            return base
        numbers = self.spark.createDataFrame(list(enumerate(names)), f"_n int, {RUN} string")
        todo = plan.join(F.broadcast(numbers), RUN).select(F.col("shard").alias(FILE), RUN, "_n")
        files = [r[0] for r in todo.select(FILE).collect()]
        pointer, folder = self._pointer(base), f"merged-{uuid.uuid4().hex}"
        schema = T.StructType.fromJson(json.loads(pointer["schema"])).add(BYTES, T.LongType())
        rows = self.spark.read.schema(schema).parquet(*[f"{self.path}/{x}" for x in sorted(files)])
        rows = rows.withColumn(FILE, _shard_of_row())
        rows = rows.join(F.broadcast(todo) if len(files) <= self.wide else todo, FILE).drop(FILE).repartitionById(len(names), F.col("_n")).drop("_n")
        with tidy(self.spark):
            rows.write.partitionBy(RUN).option("compression", self.codec).parquet(f"{self.path}/{folder}")
        plan = todo
        entries = self.manifest(base)
        merged = self._measured_runs(folder, base + 1)
        count = lambda df: df.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        want, got = count(entries.join(plan, F.col("shard") == F.col(FILE), "left_semi")), count(merged)
        if want != got:
            self._fs().delete(self._jpath(folder), True)
            raise RuntimeError(f"merged {got} rows of shards that hold {want}")
        keep = entries.join(plan, F.col("shard") == F.col(FILE), "left_anti")
        done = self._commit(keep.unionByName(merged), base, pointer["schema"])
        remove(whole)
        return done

    def _measured_runs(self, folder: str, born: int) -> DataFrame:
        df = self.spark.read.schema(f"{BYTES} long, {RUN} string").parquet(f"{self.path}/{folder}")
        out = df.groupBy(_shard_of_row().alias("shard")).agg(F.count("*").alias("rows"), F.sum(BYTES).alias("bytes"))
        return out.select("shard", "rows", "bytes", self._tier(F.col("bytes")).alias("tier"), F.lit(born).alias("born"))

    def compact_all(self) -> int:
        """Compact until no tier has enough runs left; each step leaves fewer shards."""
        while True:
            before = self.version()
            if self.compact() == before:
                return before

    def read(self, version: int | None = None, with_shard: bool = False) -> DataFrame:
        """The rows of a version; with_shard adds the column FILE."""
        v = self.version() if version is None else version
        if not v:
            raise ValueError("the store is empty")
        schema = T.StructType.fromJson(json.loads(self._pointer(v)["schema"]))
        entries = self.manifest(v)
        # folders, one for each arrival or merge; files that the version does not name drop out by the join
        folders = sorted(r[0] for r in entries.select(F.element_at(F.split("shard", "/"), 1)).distinct().collect())
        if not folders:
            return self.spark.createDataFrame([], schema if not with_shard else T.StructType([*schema.fields, T.StructField(FILE, T.StringType())]))
        parts = [self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{x}").withColumn(FILE, _shard_of_row()) for x in folders]
        df = functools.reduce(DataFrame.unionByName, parts)
        named = entries.select(F.col("shard").alias("_named"))
        few = entries.count() <= self.wide
        df = df.join(F.broadcast(named) if few else named, F.col(FILE) == F.col("_named"), "left_semi")
        return df if with_shard else df.drop(FILE)

    def vacuum(self) -> int:
        """Delete files and manifests that the newest version does not use; how many folders went."""
        fs, v = self._fs(), self.version()
        if not v:
            return 0
        pointer = self._pointer(v)
        used = {r["d"] for r in self.manifest(v).select(F.element_at(F.split("shard", "/"), 1).alias("d")).distinct().collect()}
        gone = 0
        for n in self._names():
            old = n.startswith("version-") and n < f"version-{v:08d}.json"
            if old or (n.startswith(("arrived-", "merged-")) and n not in used) or (n.startswith("manifest-") and n != pointer["manifest"]):
                fs.delete(self._jpath(n), True)
                gone += 1
        return gone


def shard(docs: DataFrame, path: str, **options) -> DataFrame:
    """Append docs to the store at path, compact, and return its rows, read back
    from the committed files, with shard, shard_rows, shard_bytes and version."""
    store = ShardStore(docs.sparkSession, path, **options)
    store.append(docs)
    v = store.compact_all()
    store.vacuum()
    entries = store.manifest(v).select(F.col("shard"), F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    # names of the result win over columns of docs that have them
    rows = store.read(v, with_shard=True).drop(*entries.columns, "version")
    few = entries.count() <= store.wide
    return rows.join(F.broadcast(entries) if few else entries, F.col(FILE) == F.col("shard")).drop(FILE).withColumn("version", F.lit(v))
