"""A table with one row per key that micro-batches merge into, each exactly once, whatever fails in between."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET = "bucket_"


@dataclass(frozen=True)
class KeyedTable:
    """Rows by key under path, of which the one with the greatest version stays; equally new ones replace each other.

    Keys are dealt to buckets. A merge rewrites the buckets it touches into a generation of its own, data/gen=N, and then
    writes one small file that names the generation of every bucket, which makes them current at once. A merge that
    failed half-way leaves files that nothing names, and its repetition replaces them; a repetition of one that is
    current changes nothing.
    """

    path: str
    keys: tuple[str, ...]
    version: str
    schema: T.StructType
    buckets: int = 64

    def generations(self, spark: SparkSession) -> dict[int, dict[int, int]]:
        """{generation: {bucket: the generation that holds it}} of the merges whose data are kept."""
        try:
            rows = spark.read.schema("bucket int, holds long").parquet(f"{self.path}/current").select("gen", "bucket", "holds").collect()  # a row per bucket and kept merge
        except Exception as error:  # nothing has been merged yet
            if "PATH_NOT_FOUND" not in str(error) and "gen" not in str(error):
                raise
            return {}
        out: dict[int, dict[int, int]] = {}
        for gen, bucket, holds in rows:
            out.setdefault(int(gen), {})[bucket] = holds
        return out

    def read(self, spark: SparkSession, of: set[int] | None = None) -> DataFrame:
        """The current rows, of some buckets or of all."""
        known = self.generations(spark)
        holding = known[max(known)] if known else {}
        paths = [f"{self.path}/data/gen={holds}/{BUCKET}={bucket}" for bucket, holds in sorted(holding.items()) if of is None or bucket in of]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame, number: int) -> None:
        """Merge micro-batch number, as foreachBatch passes it; null keys are keys like others."""
        spark = batch.sparkSession
        known = self.generations(spark)
        if known and number <= max(known):
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        new = batch.select(*self.schema.names).withColumn("new_", F.lit(True))
        touched = {r[0] for r in new.select(bucket).distinct().collect()}  # at most one row per bucket
        both = new.unionByName(self.read(spark, touched).withColumn("new_", F.lit(False)))
        row = F.struct(*self.schema.names)
        newest = both.groupBy(*[F.col(k).alias(f"key{i}_") for i, k in enumerate(self.keys)]).agg(F.max_by(row, F.struct(F.col(self.version), F.col("new_"), F.to_json(row))).alias("row_")).select("row_.*")
        newest.withColumn(BUCKET, bucket).write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/data/gen={number}")
        holding = (known[max(known)] if known else {}) | dict.fromkeys(touched, number)
        current = spark.createDataFrame(sorted(holding.items()), "bucket int, holds long")
        current.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/current/gen={number}")

    def vacuum(self, spark: SparkSession, keep: int = 2) -> None:
        """Delete what the last keep merges do not name; readers that began before these lose their files."""
        known = self.generations(spark)
        kept = sorted(known)[-keep:]
        named = {(holds, bucket) for g in kept for bucket, holds in known[g].items()}
        base = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = base.getFileSystem(spark._jsc.hadoopConfiguration())

        def children(path: object) -> list:
            return [s.getPath() for s in files.listStatus(path)] if files.exists(path) else []

        for gen in children(spark._jvm.org.apache.hadoop.fs.Path(base, "data")):
            for part in children(gen):
                if BUCKET in part.getName() and (int(gen.getName().split("=")[1]), int(part.getName().split("=")[1])) not in named:
                    files.delete(part, True)
        for gen in children(spark._jvm.org.apache.hadoop.fs.Path(base, "current")):
            if int(gen.getName().split("=")[1]) not in kept:
                files.delete(gen, True)
