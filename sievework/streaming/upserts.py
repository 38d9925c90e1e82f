"""Insert or update into a stored table, batch after batch, so that a batch that comes again changes nothing.

The table is Parquet below a folder, in buckets of its key's hash. A batch reads and rewrites only the buckets that it has
keys of: merged rows are written to the shared folder first, then put in place by one dynamic partition overwrite, which
replaces each bucket by a rename. Every row has the number of the batch that last wrote it; a batch leaves rows alone that
it or a later one has written. So after a crash between two buckets, or a replay of the whole stream, the same rows result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sievework.operators.history import first_by
from sievework.operators.ordinals import ordinals
from sievework.sources.shared import materialise, release

BUCKET, BATCH = "bucket_", "batch_"


class StoredTable:
    """A table with a key at `path`; the columns are those of schema, and rows are in `buckets` buckets.

    Keys must not be null. `once` are columns that an update doesn't change. With update=False rows whose key is there are left as they are.
    Rows that agree in `together` (the key, if not said) are in one bucket, and so are put in place at once. A single writer at a
    time is assumed, as a streaming query is one.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], once: tuple[str, ...] = (), update: bool = True, buckets: int = 64, together: list[str] | None = None):
        self.spark, self.path, self.keys, self.once, self.update, self.buckets = spark, path, keys, once, update, buckets
        self.together = together or keys
        self.columns = schema.fieldNames()
        self.schema = StructType([*schema.fields, StructField(BATCH, LongType()), StructField(BUCKET, LongType())])

    def _stored(self) -> DataFrame:
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self.path)

    def read(self) -> DataFrame:
        return self._stored().select(self.columns)

    def merge(self, batch: DataFrame, batch_id: int, *order: str) -> None:
        """Each key's last row of the batch, in this order, is inserted, or updates the stored one; order must tell a key's rows apart."""
        bucket = F.pmod(F.xxhash64(*self.together), F.lit(self.buckets))
        last = first_by(batch, self.keys, *(F.desc(c) for c in order)).select(self.columns).withColumns({BATCH: F.lit(batch_id).cast("long"), BUCKET: bucket})
        new = materialise(last, "batch")
        touched = [r[BUCKET] for r in new.select(BUCKET).distinct().collect()]  # `buckets` at most
        if not touched:
            return
        old = self._stored().where(F.col(BUCKET).isin(touched))
        both = old.alias("o").join(new.alias("n"), self.keys, "full_outer")
        fresh = F.col(f"o.{BATCH}").isNull()
        takes = F.col(f"n.{BATCH}").isNotNull() & (F.col(f"o.{BATCH}") < F.col(f"n.{BATCH}")) & F.lit(self.update)
        value = lambda c: F.when(fresh | (F.lit(False) if c in self.once else takes), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
        merged = materialise(both.select(*(F.col(c) if c in self.keys else value(c).alias(c) for c in self.columns), value(BATCH).alias(BATCH), F.coalesce(f"o.{BUCKET}", f"n.{BUCKET}").alias(BUCKET)), "merged")
        merged.repartition(BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(BUCKET).parquet(self.path)
        release(new)
        release(merged)

    def import_versions(self, batch: DataFrame, batch_id: int, label: str, version: str, *order: str) -> None:
        """Insert the rows whose key is new, numbered on from the label's last version in this order; content that is there keeps its version.

        The table must keep labels together and not update, so that a label's versions are put in place at once and a batch that
        comes again finds either none or all of them. A label's new rows are numbered range by range, whatever their share.
        """
        if self.together != [label] or self.update:
            raise ValueError("a table of versions keeps labels together and isn't updated")
        old = self.read().select(*self.keys, version)
        fresh = first_by(batch, self.keys, *(F.asc(c) for c in order)).join(old.select(self.keys), self.keys, "left_anti")
        last = old.groupBy(label).agg(F.max(version).alias("last_"))
        numbered = ordinals(fresh.drop(version), [label], list(order), "nth_").join(last, label, "left")
        self.merge(numbered.withColumn(version, (F.coalesce("last_", F.lit(0)) + F.col("nth_")).cast(self.schema[version].dataType)), batch_id, *order)

    def drain(self, stream: DataFrame, checkpoint: str, *order: str) -> None:
        """Merge all that has come of a stream; started again, it goes on after the last whole batch, and repeats a broken one."""
        writer = stream.writeStream.foreachBatch(lambda batch, number: self.merge(batch, number, *order))
        writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
