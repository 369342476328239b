"""Aggregates kept up to date by signed changes: counts and sums are merged, least and greatest values repaired, in touched groups alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmine.sources.keyed import KeyedTable
from quillmine.sources.shelf import kept, new_path


@dataclass
class Maintained:
    """Number, sum, least and greatest value per group of a table of rows (groups, value) that are put in and taken out.

    base has how often each row is there, so equal rows are many; both tables are in buckets by group, so a change reads and
    rewrites the buckets of its groups. Null values count as rows and are neither summed nor compared.
    """

    base: KeyedTable
    totals: KeyedTable
    groups: list[str]
    value: str

    @classmethod
    def empty(cls, spark: SparkSession, path: str, groups: dict[str, str], value: str, buckets: int = 64) -> Maintained:
        """groups: name and type of each column; values are whole numbers."""
        columns = ", ".join(f"{k} {v}" for k, v in groups.items())
        base = spark.createDataFrame([], f"{columns}, {value} long, qm_times long").schema
        totals = spark.createDataFrame([], f"{columns}, n long, total long, low long, high long").schema
        names = list(groups)
        return cls(KeyedTable(spark, f"{path}/base", base, names, buckets), KeyedTable(spark, f"{path}/totals", totals, names, buckets), names, value)

    def rows(self) -> DataFrame:
        """groups, n, total, low, high of every group that has rows."""
        return self.totals.rows()

    def _same(self, a: str, b: str) -> list[Column]:
        return [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in self.groups]

    def apply(self, changes: DataFrame, batch: str) -> None:
        """Takes changes (groups, value, sign): 1 for a row put in, -1 for one taken out; more may be taken out than are there only by error.

        Changes of equal rows are added up first. A least or greatest value is read from base only for groups from which a
        row with that very value went. A batch that comes again, whole or after it broke off half-way, counts once.
        """
        spark, value = self.base.spark, F.col(self.value)
        net = changes.groupBy(*self.groups, self.value).agg(F.sum("sign").cast("long").alias("d")).where("d <> 0")
        net = kept(net, new_path(spark, "net"))  # read by both tables

        def together(old: DataFrame, _: DataFrame) -> DataFrame:
            both = old.unionByName(net.withColumnRenamed("d", "qm_times")).groupBy(*self.groups, self.value).agg(F.sum("qm_times").alias("qm_times"))
            wrong = F.raise_error(F.lit("a row was taken out that is not there")).cast("long")
            return both.withColumn("qm_times", F.when(F.col("qm_times") < 0, wrong).otherwise(F.col("qm_times"))).where("qm_times > 0")

        self.base.upsert(net.select(*self.groups), batch, together)
        delta = net.groupBy(*self.groups).agg(
            F.sum("d").alias("dn"),
            F.coalesce(F.sum(value * F.col("d")), F.lit(0)).alias("dt"),
            *[f(F.when(F.col("d") > 0, value)).alias(f"{c}_in") for c, f in (("low", F.min), ("high", F.max))],
            *[f(F.when(F.col("d") < 0, value)).alias(f"{c}_out") for c, f in (("low", F.min), ("high", F.max))],
        )

        def merged(old: DataFrame, _: DataFrame) -> DataFrame:
            beside = old.alias("o").join(delta.alias("d"), self._same("o", "d"), "full")
            names = [F.coalesce(f"o.{k}", f"d.{k}").alias(k) for k in self.groups]
            gone = (F.col("low_out") <= F.col("low")) | (F.col("high_out") >= F.col("high"))
            one = beside.select(
                *names,
                (F.coalesce("n", F.lit(0)) + F.coalesce("dn", F.lit(0))).alias("n"),
                (F.coalesce("total", F.lit(0)) + F.coalesce("dt", F.lit(0))).alias("total"),
                F.least("low", "low_in").alias("low"),
                F.greatest("high", "high_in").alias("high"),
                F.coalesce(gone, F.lit(False)).alias("repair"),
            ).where("n > 0")
            broken = one.where("repair").select(*self.groups)
            here = self.base.bucketed(self.base.touched(net))
            again = here.alias("b").join(broken.alias("r"), self._same("b", "r"), "left_semi").groupBy(*self.groups).agg(F.min(value).alias("low2"), F.max(value).alias("high2"))
            right = one.alias("o").join(again.alias("a"), self._same("o", "a"), "left")
            fixed = [F.when(F.col("repair"), F.col(f"{c}2")).otherwise(F.col(c)).alias(c) for c in ("low", "high")]
            return right.select(*[F.col(f"o.{k}").alias(k) for k in self.groups], "n", "total", *fixed)

        self.totals.upsert(net.select(*self.groups), batch, merged)
