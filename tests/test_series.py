"""Series that expire on a stream, against the batch twin."""

import random
import tempfile

import pytest
from pyspark.sql import functions as F

from flowtide.operators import metrics
from flowtide.operators.flows import SECOND
from flowtide.sources.packets import BOOT_NS
from flowtide.streaming import series

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EVENT = "key string, series string, event string, ts_ns long"


@pytest.mark.parametrize("ttl", [300, 0])
def test_expired_series(spark, ttl):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    r, rows = random.Random(ttl), []
    for t in range(0, 2000, 5):
        key = f"if{r.randrange(6)}"
        rows.append((key, f"{key}-{r.choice(['in', 'out'])}", "active", t * SECOND))
    # Two are deleted for good, one comes back in part, one is deleted too late to expire by the end.
    rows = [x for x in rows if not (x[0] in ("if0", "if1") and x[3] > 800 * SECOND) and not (x[1] == "if2-in" and x[3] > 900 * SECOND)]
    rows += [("if0", None, "deleted", 801 * SECOND), ("if1", None, "deleted", 805 * SECOND), ("if2", None, "deleted", 901 * SECOND)]
    events = spark.createDataFrame(rows, EVENT)
    source = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for low in range(0, 2000, 500):
        events.filter((F.col("ts_ns") >= low * SECOND) & (F.col("ts_ns") < (low + 500) * SECOND)).coalesce(1).write.mode("append").parquet(f"{source}/in")
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    query = series.expired_series(stream, ttl * SECOND, BOOT_NS).writeStream.format("parquet").option("path", f"{source}/out").option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start()
    query.awaitTermination(150)
    assert query.exception() is None
    gone = {x.series for x in spark.read.schema(series.EXPIRED).parquet(f"{source}/out").collect()}
    active = events.filter("event = 'active'").groupBy("key", "series").agg(F.max("ts_ns").alias("last_active"))
    deletions = events.filter("event = 'deleted'").select("key", F.col("ts_ns").alias("deleted_at"))
    live = {x.series for x in metrics.expire_series(active, deletions, "key", 1990 * SECOND, ttl * SECOND).collect()}
    if ttl:
        assert gone == {x.series for x in active.collect()} - live == {"if0-in", "if0-out", "if1-in", "if1-out", "if2-in"}
    else:  # at once: what had been seen of the key when its deletion came and wasn't active after it
        assert {"if0-in", "if0-out", "if1-in", "if1-out"} <= gone and not gone & {x for x in live if x.startswith(("if3", "if4", "if5"))}
