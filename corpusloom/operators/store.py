"""Keyed tables: upserts, cache lookups, alignment and the Parquet collection.

A collection is a folder of Parquet tables.  An append writes only new rows, an
upsert only the buckets that hold them; the pointer moves when all is written, so
a reader or a lost executor never sees half a change.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.session import cut_lineage


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One whole row per key, the first in ``order``; pre-aggregated before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def insert_or_ignore(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """The rows of ``new`` that an idempotent insert would add."""
    order = order or (F.xxhash64(*new.columns),)
    return first_per_key(new.join(old.select(key), key, "left_anti"), [key], *order).select(*new.columns)


def insert_or_replace(old: DataFrame, new: DataFrame, key: str, *order: Column) -> DataFrame:
    """The table after a replace: a row of ``new`` wins over the old one.

    Among several new rows of a key the last in ``order`` wins, so pass the
    sequence columns in descending order.
    """
    order = order or (F.xxhash64(*new.columns),)
    latest = first_per_key(new, [key], *order)
    kept = old.join(latest.select(key), key, "left_anti")
    return kept.select(*new.columns).unionByName(latest.select(*new.columns))


def without(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Anti-join: rows whose key is not in ``done`` (files already processed)."""
    return df.join(done.select(key), key, "left_anti")


def having(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Semi-join: rows whose key occurs in ``other`` (nodes that have a vector)."""
    return df.join(other.select(key), key, "left_semi")


def missing_ids(nodes: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Ids in ``nodes`` that have no row in ``vectors``."""
    return nodes.select(key).subtract(vectors.select(key))


def align(nodes: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Nodes with their vectors, inner on the key."""
    return nodes.join(vectors, key)


def cached_vectors(
    nodes: DataFrame, cache: DataFrame, embed: Callable[[Column], Column], model: str,
    key: str = "id", text: str = "text",
) -> DataFrame:
    """``id, embedding, cached`` for every node: cache hits as stored, misses computed."""
    known = cache.where(F.col("model") == model).select(key, "embedding")
    hits = nodes.select(key).join(known, key).withColumn("cached", F.lit(True))
    misses = nodes.select(key, text).join(known.select(key), key, "left_anti")
    fresh = misses.select(key, embed(F.col(text)).alias("embedding"), F.lit(False).alias("cached"))
    return hits.unionByName(fresh)


def sanitize_map(m: Column) -> Column:
    """Drop NULL values of a metadata map and keep the rest as strings."""
    kept = F.map_filter(m, lambda k, v: v.isNotNull())
    return F.transform_values(kept, lambda k, v: v.cast("string"))


def settings_mismatch(have: DataFrame, want: DataFrame) -> DataFrame:
    """Settings present on both sides with different values: ``key, have, want``."""
    a = have.select(F.explode("properties").alias("key", "have"))
    b = want.select(F.explode("properties").alias("key", "want"))
    return a.join(b, "key").where((F.col("have") != "") & (F.col("have") != F.col("want")))


def vectors_or_rejects(df: DataFrame, result: str = "result") -> tuple[DataFrame, DataFrame]:
    """Split rows of ``struct<vec, error>`` into accepted rows and rejects.

    Only length refusals of a model ("cannot exceed") are rejects; another
    error fails the job when its row is read.
    """
    error = F.col(result)["error"]
    refused = F.lower(error).contains("cannot exceed")
    checked = df.withColumn(
        result, F.when(error.isNull() | refused, F.col(result)).otherwise(F.raise_error(error))
    )
    good = checked.where(F.col(result)["error"].isNull())
    bad = checked.where(F.col(result)["error"].isNotNull())
    return (
        good.withColumn("embedding", F.col(result)["vec"]).drop(result),
        bad.withColumn("error", F.col(result)["error"]).drop(result),
    )


class Collection:
    """Named Parquet tables in one folder, opened or created on first use.

    A table begins as one folder that appends add to.  The first upsert deals it
    out to buckets by a hash of the id; from then on a manifest names the folders
    of every bucket, an upsert rewrites only the buckets that it touches, and a
    reader sees the state of one manifest.  Folders that only manifests older
    than the last ``keep`` name are deleted.
    """

    def __init__(self, spark: SparkSession, root: str, name: str = "default", buckets: int = 32, keep: int = 2):
        self.spark, self.root, self.buckets, self.keep = spark, f"{root.rstrip('/')}/{name}", buckets, max(1, keep)

    def _fs(self, path: str):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    # Tables that have only been appended to or replaced as a whole.

    def _versions(self, table: str) -> list[int]:
        done = []
        for n in self._names(f"{self.root}/{table}"):
            if n.startswith("v="):
                marker = self._fs(f"{self.root}/{table}/{n}/_SUCCESS")
                if marker[0].exists(marker[1]):
                    done.append(int(n[2:]))
        return sorted(done)

    # Tables in buckets.

    def _manifests(self, table: str) -> list[int]:
        names = self._names(f"{self.root}/{table}/manifest")
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, table: str, number: int | None = None) -> dict | None:
        """``buckets``, ``key`` and ``parts`` (bucket -> folders) of a table in buckets, the latest by default."""
        numbers = self._manifests(table)
        if not numbers:
            return None
        fs, p = self._fs(f"{self.root}/{table}/manifest/{numbers[-1] if number is None else number}.json")
        stream = fs.open(p)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _publish(self, table: str, manifest: dict) -> None:
        """Make a manifest the current one, by a rename, and drop what no kept manifest names."""
        folder = f"{self.root}/{table}/manifest"
        numbers = self._manifests(table)
        number = numbers[-1] + 1 if numbers else 0
        fs, hidden = self._fs(f"{folder}/.{number}-{uuid.uuid4().hex}")
        out = fs.create(hidden)
        out.writeBytes(json.dumps(manifest))
        out.close()
        _, target = self._fs(f"{folder}/{number}.json")
        if fs.exists(target) or not fs.rename(hidden, target):
            raise RuntimeError(f"{self.root}/{table}: another writer has published manifest {number}")
        kept = [*numbers, number][-self.keep:]
        named = {d for k in kept for dirs in self.manifest(table, k)["parts"].values() for d in dirs}
        for k in [n for n in numbers if n not in kept]:
            for d in {d for dirs in self.manifest(table, k)["parts"].values() for d in dirs} - named:
                where, p = self._fs(f"{self.root}/{table}/{d}")
                where.delete(p, True)
            fs.delete(self._fs(f"{folder}/{k}.json")[1], False)

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def _write_buckets(self, table: str, rows: DataFrame, key: str, buckets: int, touched: int) -> dict[str, str]:
        """Write rows by bucket: the new folder of each bucket that has any."""
        new = f"g-{uuid.uuid4().hex}"
        dealt = rows.withColumn("_bucket", self._bucket(key, buckets)).repartition(max(1, touched), "_bucket")
        dealt.write.partitionBy("_bucket").parquet(f"{self.root}/{table}/{new}")
        return {n.removeprefix("_bucket="): f"{new}/{n}" for n in self._names(f"{self.root}/{table}/{new}") if n.startswith("_bucket=")}

    def _folders(self, table: str, manifest: dict, only: list[str] | None = None) -> list[str]:
        return [f"{self.root}/{table}/{d}" for b, dirs in sorted(manifest["parts"].items()) if only is None or b in only for d in dirs]

    def exists(self, table: str) -> bool:
        return bool(self._manifests(table) or self._versions(table))

    def path(self, table: str) -> str | None:
        """Folder of a table that is not in buckets."""
        v = self._versions(table)
        return f"{self.root}/{table}/v={v[-1]}" if v else None

    def read(self, table: str, schema: T.StructType) -> DataFrame:
        """The current state, or an empty table of that schema."""
        manifest = self.manifest(table)
        folders = self._folders(table, manifest) if manifest else [p for p in [self.path(table)] if p]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*folders)

    def append(self, table: str, rows: DataFrame) -> None:
        manifest = self.manifest(table)
        if manifest is None:
            rows.write.mode("append").parquet(self.path(table) or f"{self.root}/{table}/v=0")
            return
        parts = {b: list(dirs) for b, dirs in manifest["parts"].items()}
        for b, d in self._write_buckets(table, rows, manifest["key"], manifest["buckets"], manifest["buckets"]).items():
            parts.setdefault(b, []).append(d)
        self._publish(table, {**manifest, "parts": parts})

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write the whole table anew; readers switch when it is complete."""
        manifest = self.manifest(table)
        if manifest is not None:
            parts = self._write_buckets(table, rows, manifest["key"], manifest["buckets"], manifest["buckets"])
            self._publish(table, {**manifest, "parts": {b: [d] for b, d in parts.items()}})
            return
        v = self._versions(table)
        rows.write.mode("overwrite").parquet(f"{self.root}/{table}/v={v[-1] + 1 if v else 0}")

    def require_rows(self, table: str, schema: T.StructType) -> DataFrame:
        df = self.read(table, schema)
        if df.isEmpty():
            raise RuntimeError(f"collection {self.root}: table {table} is empty; run the ingest first")
        return df

    def insert_new(self, table: str, rows: DataFrame, schema: T.StructType, key: str = "id") -> None:
        """Idempotent insert: rows with a known key are skipped, a missing key is an error."""
        checked = rows.withColumn(
            key, F.coalesce(F.col(key), F.raise_error(F.lit(f"{table}: missing {key}")).cast(schema[key].dataType))
        )
        self.append(table, insert_or_ignore(self.read(table, schema), checked, key))

    def upsert(self, table: str, rows: DataFrame, schema: T.StructType, key: str = "id", *order: Column) -> None:
        """Replace rows with the same key, keep the others; only buckets with new rows are read and written.

        Among several new rows of a key the last in ``order`` wins, see
        ``insert_or_replace``.
        """
        manifest = self.manifest(table)
        if manifest is None:
            old = self.read(table, schema)
            first = self._write_buckets(table, old, key, self.buckets, self.buckets)
            manifest = {"buckets": self.buckets, "key": key, "parts": {b: [d] for b, d in first.items()}}
            self._publish(table, manifest)
        if manifest["key"] != key:
            raise ValueError(f"table {table} is in buckets by {manifest['key']}")
        latest = cut_lineage(first_per_key(rows, [key], *(order or (F.xxhash64(*rows.columns),))).select(*schema.names))
        touched = [str(r["b"]) for r in latest.select(self._bucket(key, manifest["buckets"]).alias("b")).distinct().collect()]  # at most the buckets
        if not touched:
            return
        folders = self._folders(table, manifest, touched)
        merged = latest
        if folders:
            old = self.spark.read.schema(schema).parquet(*folders)
            merged = old.join(latest.select(key), key, "left_anti").select(*schema.names).unionByName(latest)
        written = self._write_buckets(table, merged, key, manifest["buckets"], len(touched))
        self._publish(table, {**manifest, "parts": {**manifest["parts"], **{b: [d] for b, d in written.items()}}})
