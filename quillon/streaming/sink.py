"""A sink that micro-batches are committed to: what a stream has kept so far is in the sink, not in the state of a query.

A batch's rows are written to a folder of its number, then a commit of one row with its totals. A batch that is run again after a failure writes the same folders anew, so each batch counts once,
and a folder without a commit does not count. Where keys are looked up, rows lie in ``BUCKETS`` folders by a hash of the key, and a batch reads those that it has keys of only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import exists

BUCKETS = 64
_COMMIT = "batch long, rows long, amount double"


@dataclass(frozen=True)
class CommittedSink:
    """Tables under ``path``: rows/batch=../bucket=.. and commits/batch=... ``schema`` is that of the rows."""

    path: str
    schema: str

    def commits(self, spark: SparkSession) -> DataFrame:
        """(batch, rows, amount) of each committed batch."""
        where = f"{self.path}/commits"
        return spark.read.schema(_COMMIT).parquet(where).select("batch", "rows", "amount") if exists(spark, where) else spark.createDataFrame([], _COMMIT)

    def spent(self, spark: SparkSession, before: int) -> tuple[int, float]:
        """(rows, amount) of the batches before this one."""
        r = self.commits(spark).where(F.col("batch") < before).agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount")).first()
        return r["rows"], r["amount"]

    def rows(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The rows of all committed batches, or of those before one, with ``bucket``."""
        where = f"{self.path}/rows"
        if not exists(spark, where):
            return spark.createDataFrame([], f"{self.schema}, bucket int")
        every = spark.read.schema(f"{self.schema}, batch long, bucket int").parquet(where)
        done = self.commits(spark) if before is None else self.commits(spark).where(F.col("batch") < before)
        return every.join(F.broadcast(done.select("batch")), "batch", "left_semi").drop("batch")  # a row a batch

    def write(self, rows: DataFrame, batch: int, bucket: Column | None = None, amount: str | None = None) -> tuple[int, float]:
        """Writes and commits a batch; gives its (rows, amount)."""
        spark, where = rows.sparkSession, f"{self.path}/rows/batch={batch}"
        rows.withColumn("bucket", F.lit(0) if bucket is None else bucket).write.mode("overwrite").partitionBy("bucket").parquet(where)
        done = spark.read.schema(f"{self.schema}, bucket int").parquet(where) if exists(spark, where) else spark.createDataFrame([], self.schema)
        total = done.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.col(amount)) if amount else F.lit(0.0), F.lit(0.0)).cast("double").alias("amount")).first()
        spark.createDataFrame([(batch, total["rows"], total["amount"])], _COMMIT).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/of={batch}")
        return total["rows"], total["amount"]


def bucket_of(*keys: str, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
