"""The latest state of a cluster's objects, kept by a stream of changes as a table of versions.

Every micro-batch writes a new version from the one before it and its own changes: the last change of each object
(one aggregate on its key), and of each kind the list that it was sent last in full. An object goes when it is
deleted, or when a whole list of its kind began after it was last applied: mark and sweep, kind by kind. A batch
that is tried again writes the same version, and readers see a version once its files are all there.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = ("init", "init_done")


class ChangeTable:
    """For foreachBatch. Changes have uid, kind, event and ts_ns, and further columns that are kept as they are.

    place orders changes of one ts_ns. Versions lie under path, which all executors share; the latest is the one
    with the greatest batch id; the two newest are kept by whoever cleans up, as a batch reads the one before it.
    """

    def __init__(self, path: str, place: str = "ts_ns"):
        self.path, self.place = path.rstrip("/"), place

    def _versions(self, spark: SparkSession) -> list[int]:
        """Batch ids of whole versions."""
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        found = [f.getPath() for f in files.listStatus(folder)]
        return sorted(int(p.getName().partition("=")[2]) for p in found if "=" in p.getName() and files.exists(hadoop.Path(p, "_SUCCESS")))

    def _read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        versions = [v for v in self._versions(spark) if before is None or v < before]
        return spark.read.parquet(f"{self.path}/version={versions[-1]}") if versions else None

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        known = self._read(spark, batch_id)
        rows = batch.filter(F.col("event").isin("apply", "delete", *MARKS))
        rows = rows if known is None else known.unionByName(rows)
        columns = [c for c in batch.columns if c not in ("uid", "kind")]
        order = F.struct("ts_ns", self.place)
        last = F.max_by(F.struct(*columns), order).alias("x")
        # A mark is a row of its kind without a uid: the last init, the last init_done, and the init of the latter.
        objects = rows.filter(~F.col("event").isin(*MARKS)).groupBy("kind", "uid").agg(last).select("kind", "uid", "x.*")
        marks = rows.filter(F.col("event").isin(*MARKS)).select("kind", "event", "ts_ns", self.place, *[c for c in columns if c not in ("event", "ts_ns", self.place)])
        swept = _last_lists(marks.select("kind", "event", "ts_ns"))
        kept = objects.join(swept, "kind", "left").filter("init_ns IS NULL OR ts_ns >= init_ns").drop("init_ns")
        # Of marks those stay that the next batch may need: each kind's last list, and what began after it.
        needed = marks.join(swept, "kind", "left").filter("init_ns IS NULL OR ts_ns >= init_ns").drop("init_ns").withColumn("uid", F.lit(None).cast(batch.schema["uid"].dataType))
        version = kept.unionByName(needed.select(kept.columns))
        version.write.mode("overwrite").parquet(f"{self.path}/version={batch_id}")

    def read(self, spark: SparkSession) -> DataFrame:
        """The objects that are there."""
        return self._read(spark).filter("event = 'apply'").drop("event")


def _last_lists(marks: DataFrame) -> DataFrame:
    """(kind, init_ns): where the last whole list of each kind began. Marks are few: two a list, kept for one list."""
    done = marks.filter("event = 'init_done'").groupBy("kind").agg(F.max("ts_ns").alias("done_ns"))
    began = marks.filter("event = 'init'").join(done, "kind").filter("ts_ns <= done_ns").groupBy("kind").agg(F.max("ts_ns").alias("init_ns"))
    return done.join(began, "kind", "left").select("kind", F.coalesce("init_ns", "done_ns").alias("init_ns"))
