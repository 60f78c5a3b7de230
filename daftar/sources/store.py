"""Tables in folders that several steps share, and tables by key whose changes write only the buckets they touch."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str = "table") -> str:
    """A new path below spark.checkpoint.dir. Where that is unset, a local session makes a folder of its own; on a cluster it must be set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = tempfile.mkdtemp(prefix="daftar-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def last_of_each(rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Of the rows of a key the one that comes last in `order`; columns of any type, maps too."""
    fields = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    return rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys))).agg(F.max_by(fields, order).alias("_last")).select("_last.*")


class KeyedStore:
    """A Parquet table dealt by a hash of its keys into buckets, each a folder. Reads by key open one bucket; upserts and deletes rewrite the buckets of their keys and leave all other files as they are.

    A change is first written beside the table and then replaces its buckets, so that it reads nothing it overwrites; run again, it gives the same. One writer at a time. Rows with a null key are kept like others; null equals null.
    """

    BUCKET = "_bucket"

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = 64) -> None:
        self.spark, self.path, self.keys, self.buckets = spark, path, list(keys), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(self.BUCKET, self._bucket())

    def _write(self, rows: DataFrame, mode: str) -> None:
        dealt = self._dealt(rows)
        # One task a bucket at most: a bucket is one file, whatever the number of tasks before.
        dealt.repartition(F.col(self.BUCKET)).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(self.BUCKET).parquet(self.path)

    def create(self, rows: DataFrame, order: Column | None = None) -> KeyedStore:
        """Writes the table new; with an order only the last row of each key."""
        self._write(rows if order is None else last_of_each(rows, self.keys, order), "errorifexists")
        self._dealt(rows).limit(0).write.parquet(f"{self.path}/_schema")  # for stores without rows; readers of the folder pass over it
        return self

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(self.spark.read.parquet(f"{self.path}/_schema").schema).parquet(self.path)

    def rows(self) -> DataFrame:
        return self._stored().drop(self.BUCKET)

    def count(self) -> int:
        return self.rows().count()

    def peek(self, n: int = 10) -> DataFrame:
        """Some rows: those of the first buckets, read until there are n."""
        return self.rows().limit(n)

    def get(self, *wanted: tuple) -> DataFrame:
        """The rows of some keys; only their buckets are read."""
        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.rows().select(*self.keys).schema.fields)
        asked = self.spark.createDataFrame([w if isinstance(w, tuple) else (w,) for w in wanted], types)
        return self._of(asked)

    def _of(self, keys: DataFrame) -> DataFrame:
        """Rows whose keys are among some that the driver can hold the buckets of: at most `buckets` numbers."""
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        held = self._stored().where(F.col(self.BUCKET).isin(*touched)).drop(self.BUCKET)
        return held.alias("s").join(keys.select(*self.keys).distinct().alias("k"), self._same("s", "k"), "left_semi")

    def _same(self, a: str, b: str) -> Column:
        condition = F.lit(True)
        for k in self.keys:
            condition = condition & F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`"))
        return condition

    def _replace(self, changed: DataFrame, added: DataFrame | None) -> list[int]:
        """Rewrites the buckets of the changed keys without their rows, and with the added ones; the buckets' numbers."""
        touched = sorted(r[0] for r in changed.select(self._bucket()).distinct().collect())
        if not touched:
            return touched
        held = self._stored().where(F.col(self.BUCKET).isin(*touched)).drop(self.BUCKET)
        kept = held.alias("s").join(changed.select(*self.keys).distinct().alias("k"), self._same("s", "k"), "left_anti")
        staged = shared_path(self.spark, "staged")
        (kept if added is None else kept.unionByName(added.select(*held.columns))).write.parquet(staged)
        new = self.spark.read.schema(held.schema).parquet(staged)
        self._write(new, "overwrite")
        left = {r[0] for r in new.select(self._bucket()).distinct().collect()}
        for b in set(touched) - left:  # dynamic overwrite doesn't empty a bucket
            self._delete(f"{self.path}/{self.BUCKET}={b}")
        self._delete(staged)
        return touched

    def _delete(self, path: str) -> None:
        context = self.spark.sparkContext
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)

    def upsert(self, new: DataFrame, order: Column) -> list[int]:
        """New rows replace those with their keys and join the others; of several new rows with one key the last in `order` counts. The numbers of the buckets written."""
        last = last_of_each(new, self.keys, order)
        return self._replace(last, last)

    def patch(self, changes: DataFrame, order: Column) -> list[int]:
        """Values of changes that are not null replace those of the row with their keys; keys that are not stored are left out. Columns that changes doesn't have stay."""
        last = last_of_each(changes, self.keys, order)
        old = self._of(last).alias("s")
        fields = [c for c in last.columns if c not in self.keys]
        merged = old.join(last.alias("k"), self._same("s", "k")).select(*(F.coalesce(F.col(f"k.`{c}`"), F.col(f"s.`{c}`")).alias(c) if c in fields else F.col(f"s.`{c}`").alias(c) for c in old.columns))
        return self._replace(merged, merged)

    def delete(self, keys: DataFrame) -> list[int]:
        """Deletes the rows of some keys; the numbers of the buckets written."""
        return self._replace(keys, None)
