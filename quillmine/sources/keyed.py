"""Keyed tables: rows in buckets by the hash of their key, changed bucket by bucket, versions swapped by a manifest.

    path/data/<change>/bucket=<b>/...   rows of the buckets that a change has rewritten
    path/manifest/version=<n>/...       one small file: where each bucket's rows are, and which batch made the version

A change writes the touched buckets to a folder of its own and then the manifest of the next version. Readers take the highest
version, so they see the table before or after a change, never between. A change that dies leaves a folder that no manifest names; one
that is repeated with the same batch name finds its batch in a manifest and does nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "bucket int, folder string, batch string, version long"


class ConflictError(RuntimeError):
    """Another change has made the version that this one was about to make."""


@dataclass
class KeyedTable:
    """A table of rows with a key (columns `keys`); one writer at a time, any number of readers."""

    spark: SparkSession
    path: str
    schema: StructType
    keys: list[str]
    buckets: int = 64

    def _versions(self) -> DataFrame:
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def version(self) -> int:
        """Number of changes so far."""
        return self._versions().agg(F.max("version")).first()[0] or 0

    def _folders(self, version: int) -> dict[int, str]:
        """Folder of each bucket that has rows: `buckets` entries at most."""
        rows = self._versions().where((F.col("version") == version) & (F.col("bucket") >= 0)).collect()
        return {r["bucket"]: r["folder"] for r in rows}

    def _read(self, folders: dict[int, str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(folders.items())])

    def bucket(self):
        """A row's bucket. Null keys have one too."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def rows(self, version: int | None = None) -> DataFrame:
        """All rows as of a version, by default the last."""
        return self._read(self._folders(self.version() if version is None else version))

    def get(self, *key) -> DataFrame:
        """Rows of one key; only its bucket is read."""
        types = {f.name: f.dataType for f in self.schema}
        lit = [F.lit(v).cast(types[k]) for k, v in zip(self.keys, key, strict=True)]
        b = self.spark.range(1).select(F.pmod(F.xxhash64(*lit), F.lit(self.buckets)).cast("int")).first()[0]
        here = self.bucketed([b])
        for k, v in zip(self.keys, lit, strict=True):
            here = here.where(F.col(k).eqNullSafe(v))
        return here

    def _change(self, batch: str, touched: list[int], made: Callable[[DataFrame], DataFrame]) -> int:
        """Rewrites the touched buckets as made(their rows); the number of the version that holds the change."""
        done = self._versions().where(F.col("batch") == batch).agg(F.min("version")).first()[0]
        if done is not None:
            return done
        now = self.version()
        folders = self._folders(now)
        folder = f"{now + 1}-{uuid.uuid4().hex}"
        new = self._typed(made(self._read({b: f for b, f in folders.items() if b in set(touched)})), self.schema.names)
        out = f"{self.path}/data/{folder}"
        # A bucket may be large: its rows are dealt to as many files as it takes, each sorted by key.
        spread = new.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").sortWithinPartitions("bucket", *self.keys)
        spread.write.option("compression", "zstd").partitionBy("bucket").parquet(out)
        full = [r["bucket"] for r in self.spark.read.schema("bucket int").parquet(out).select("bucket").distinct().collect()] if touched else []
        folders = {b: f for b, f in folders.items() if b not in set(touched)} | {b: folder for b in full}
        if self.version() != now:
            raise ConflictError(f"version {now + 1} of {self.path} was made by another change")
        # The first row names the batch, so that an empty table has a version too. One file appears at once.
        entries = [(-1, "", batch), *[(b, f, batch) for b, f in folders.items()]]
        self.spark.createDataFrame(entries, "bucket int, folder string, batch string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={now + 1}")
        return now + 1

    def _typed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """Columns as the table has them, as a hash depends on the type."""
        types = {f.name: f.dataType for f in self.schema}
        return rows.select(*[F.col(c).cast(types[c]).alias(c) for c in columns])

    def touched(self, rows: DataFrame) -> list[int]:
        """Buckets of the rows' keys: `buckets` numbers at most."""
        return [r["b"] for r in self._typed(rows, self.keys).select(self.bucket().alias("b")).distinct().collect()]

    def bucketed(self, buckets: list[int]) -> DataFrame:
        """All rows of some buckets."""
        return self._read({b: f for b, f in self._folders(self.version()).items() if b in set(buckets)})

    def upsert(self, rows: DataFrame, batch: str, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> int:
        """Puts rows in place of those of the same keys, or what merge(old rows of the touched buckets, rows) makes of them."""

        def made(old: DataFrame) -> DataFrame:
            if merge is not None:
                return merge(old, rows)
            same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            return old.alias("o").join(rows.select(*self.keys).distinct().alias("n"), same, "left_anti").unionByName(self._typed(rows, self.schema.names))

        return self._change(batch, self.touched(rows), made)

    def delete(self, keys: DataFrame, batch: str) -> int:
        """Takes out the rows of the keys that a table of keys names."""
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
        return self._change(batch, self.touched(keys), lambda old: old.alias("o").join(keys.select(*self.keys).distinct().alias("n"), same, "left_anti"))

    def delete_where(self, condition: str, batch: str) -> int:
        """Takes out rows by a condition; only buckets that hold such rows are rewritten. A condition that is null keeps a row."""
        hit = self.rows().where(condition)
        return self._change(batch, self.touched(hit), lambda old: old.where(f"not coalesce({condition}, false)"))
