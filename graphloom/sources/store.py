"""Merges, deletions and relabelling: each takes the table and gives the new one, and ``Store`` swaps it in."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import tables


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The rows whose key the table lacks, one of each key (least ``order``): what has to be appended."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    fresh = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    return fresh.join(table.select(*keys), keys, "left_anti")


def upsert(table: DataFrame, rows: DataFrame, keys: list[str], overwrite_nulls: bool = False) -> DataFrame:
    """The table after a merge: new values win, and nulls too if asked for. ``rows`` has one row of each key."""
    new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in table.columns if c not in keys], F.lit(True).alias("_hit"))
    both = table.join(new, keys, "full_outer")
    pick = lambda c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) if overwrite_nulls else F.coalesce(f"_new_{c}", c)
    return both.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in table.columns])


def merged_keywords(old: Column, new: Column) -> Column:
    """Union in order of appearance, without regard to case; the first spelling stays."""
    whole = F.filter(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(new, F.array().cast("array<string>"))), lambda k: F.trim(k) != "")
    keys = F.transform(whole, lambda k: F.lower(F.trim(k)))
    return F.filter(whole, lambda k, i: F.array_position(keys, F.lower(F.trim(k))) == i + 1)


def upsert_edges(edges: DataFrame, rows: DataFrame) -> DataFrame:
    """Merge by (src, dst, rel_type): the new weight wins, keywords are united."""
    keys = ["src", "dst", "rel_type"]
    new = rows.groupBy(*keys).agg(F.max("rel_id").alias("_rel_id"), F.max("weight").alias("_weight"), F.flatten(F.sort_array(F.collect_list("keywords"))).alias("_keywords"))
    both = edges.join(new, keys, "full_outer")
    return both.select(F.coalesce("rel_id", "_rel_id").alias("rel_id"), *keys, F.coalesce("_weight", "weight").alias("weight"), merged_keywords(F.col("keywords"), F.col("_keywords")).alias("keywords"))


def missing_ends(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of edge ends without an entity: what a merge has to create."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    return ends.join(entities.select("id"), "id", "left_anti")


def relabel(edges: DataFrame, old: str, new: str) -> DataFrame:
    """Edges of a type under another, united with those that have it already; weights add up to 100 at most.

    Spread by their ends into tasks of a fixed size before they are united.
    """
    moved = edges.withColumn("rel_type", F.when(F.col("rel_type") == old, new).otherwise(F.col("rel_type")))
    united = moved.repartition(tables.slices(edges), "src", "dst").groupBy("src", "dst", "rel_type").agg(F.least(F.sum("weight"), F.lit(100)).cast("int").alias("weight"))
    return united.withColumn("rel_id", F.concat_ws(":", "rel_type", "src", "dst"))


def delete_where(table: DataFrame, condition: Column) -> DataFrame:
    """What stays; rows whose condition is null stay."""
    return table.where(~F.coalesce(condition, F.lit(False)))


def delete_nodes(entities: DataFrame, edges: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Entities and edges without some nodes."""
    dead = entities.where(gone).select(F.col("id").alias("_dead"))
    left = edges.join(dead, edges["src"] == dead["_dead"], "left_anti").join(dead, edges["dst"] == dead["_dead"], "left_anti")
    return delete_where(entities, gone), left


class Store:
    """Tables as Parquet folders; a change is written aside and swapped in by a rename, so readers never see half of it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def exists(self, name: str) -> bool:
        return self._fs().exists(self._path(name))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def create(self, name: str, schema: str) -> None:
        if not self.exists(name):
            self.spark.createDataFrame([], schema).write.parquet(f"{self.folder}/{name}")

    def append(self, name: str, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(f"{self.folder}/{name}")

    def insert_absent(self, name: str, rows: DataFrame, keys: list[str], order: str) -> None:
        self.append(name, insert_absent(self.read(name), rows, keys, order) if self.exists(name) else insert_absent(rows.limit(0), rows, keys, order))

    def replace(self, name: str, rows: DataFrame) -> None:
        aside = f"_{name}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{aside}")
        self.drop(name)
        self._fs().rename(self._path(aside), self._path(name))
        self.spark.catalog.refreshByPath(f"{self.folder}/{name}")

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        self.replace(name, upsert(self.read(name), rows, keys) if self.exists(name) else rows)

    def delete(self, name: str, condition: Column) -> int:
        """Rows deleted."""
        table = self.read(name)
        gone = table.where(condition).count()
        if gone:
            self.replace(name, delete_where(table, condition))
        return gone

    def drop(self, name: str) -> bool:
        return self._fs().delete(self._path(name), True)

    def rename(self, name: str, other: str) -> bool:
        """False if there is no such table."""
        if not self.exists(name):
            return False
        self.drop(other)
        return self._fs().rename(self._path(name), self._path(other))
