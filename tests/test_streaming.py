"""The stream tracker against its batch twin."""

import tempfile

from pyspark.sql import functions as F

from flowtide.operators import flows
from flowtide.sources.packets import BOOT_NS, EVENTS
from flowtide.streaming import tracker

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def test_tracker_is_batch_twin(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    packets = EVENTS.read(spark, SF).filter("packet_id < 600")
    source = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    columns = packets.columns
    for low in range(0, 600, 200):  # three micro-batches
        packets.filter(f"packet_id >= {low} AND packet_id < {low + 200}").coalesce(1).write.mode("append").parquet(f"{source}/in")
    end = packets.orderBy(F.desc("ts_ns")).limit(1)
    for hours in (1, 2):  # rows that move the watermark past every timeout
        flush = end.withColumns({"ts_ns": F.col("ts_ns") + hours * 3600 * flows.SECOND, "packet_id": F.lit(10_000 + hours).cast("long")}).select(columns)
        flush.coalesce(1).write.mode("append").parquet(f"{source}/in")
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    query = tracker.track(stream, BOOT_NS, "packet_id").writeStream.format("memory").queryName("records").option("checkpointLocation", f"{source}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(240)
    assert query.exception() is None
    last = packets.agg(F.max("ts_ns")).first()[0]
    got = spark.table("records").filter(F.col("start_ns") <= last).drop("flow").collect()
    folded = flows.session_fold(packets, EVENTS.order)
    twin = flows.interval_records(folded).collect()
    fields = ["start_ns", "interval", "record_start_ns", "record_end_ns", "fwd_packets_delta", "rev_packets_delta", "fwd_bytes_total", "rev_bytes_total", "tcp_flags", "state", "jitter_ns", "end_reason"]
    pick = lambda rows: sorted(tuple(r[f] for f in fields) for r in rows)
    assert pick(got) == pick(twin) and len(twin) > 30


def test_late_packets(spark):
    packets = EVENTS.read(spark, SF).limit(50)
    on_time, behind = tracker.late(packets, 2 * flows.SECOND)
    assert on_time.count() + behind.count() == 50
    assert behind.filter("ts_ns >= 2000000000").count() == 0
