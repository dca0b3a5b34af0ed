"""The tracker's end of input and restart with changed state, against its batch twin; span files."""

import json
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from flowtide.operators import flows
from flowtide.sources.packets import BOOT_NS, EVENTS
from flowtide.sources.spanfiles import SpanSink, SpanWriter, read_spans
from flowtide.streaming import tracker

SF = "/root/testdata/sf0.001"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ["start_ns", "interval", "record_start_ns", "record_end_ns", "fwd_packets_delta", "rev_packets_delta", "fwd_bytes_delta", "fwd_bytes_total", "rev_bytes_total", "tcp_flags", "state", "jitter_ns", "end_reason"]


def picked(rows):
    return sorted(tuple(r[f] for f in FIELDS) for r in rows)


def run(spark, source, schema, state):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    query = tracker.track(stream, BOOT_NS, "packet_id", state=state).writeStream.format("parquet").option("path", f"{source}/out").option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None


def test_flush_and_restart(spark):
    """A query with the first version of the state stops between batches and goes on with the present one; what it
    wrote and what is still open at the end are the records of the batch twin, without a row that is made up."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.encodingFormat", "avro")
    packets = EVENTS.read(spark, SF).filter("packet_id < 400").cache()
    source = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    try:
        for low, state in ((0, tracker.FIRST_STATE), (200, tracker.STATE)):
            packets.filter(f"packet_id >= {low} AND packet_id < {low + 200}").coalesce(1).write.mode("append").parquet(f"{source}/in")
            run(spark, source, packets.schema, state)
        written = spark.read.schema(tracker.RECORD).parquet(f"{source}/out").collect()
        open_ = tracker.open_flows(spark, f"{source}/state").collect()
        twin = flows.interval_records(flows.packet_fold(packets, EVENTS.order)).collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.encodingFormat")
    assert picked(written + open_) == picked(twin) and len(open_) > 5 and len(written) > 5


def test_shuffled_input(spark):
    """Packets that come in any order within the delay, over micro-batches, give the batch twin's records."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    packets = EVENTS.read(spark, SF).filter("packet_id < 240").cache()
    source = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    # A packet comes up to 15 s (60 packets) late, so in the batch after its own or in its own, in no order.
    late = packets.withColumn("batch", F.expr("(packet_id + pmod(hash(packet_id), 60)) DIV 60")).orderBy(F.xxhash64("packet_id"))
    for i in range(5):
        late.filter(F.col("batch") == i).drop("batch").coalesce(1).write.mode("append").parquet(f"{source}/in")
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    query = tracker.track(stream, BOOT_NS, "packet_id", delay="40 seconds").writeStream.format("parquet").option("path", f"{source}/out").option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start()
    query.awaitTermination(200)
    assert query.exception() is None
    written = spark.read.schema(tracker.RECORD).parquet(f"{source}/out").collect()
    twin = flows.interval_records(flows.packet_fold(packets, EVENTS.order)).collect()
    assert picked(written + tracker.open_flows(spark, f"{source}/state").collect()) == picked(twin)


SPAN = "name string, start_ns long, attributes map<string,string>"


def spans(spark, low, high):
    return spark.range(low, high).select(F.concat(F.lit("flow_"), "id").alias("name"), F.col("id").alias("start_ns"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("attributes"))


def test_span_files(spark):
    spark.dataSource.register(SpanSink)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    assert read_spans(spark, folder, SPAN).collect() == []
    for low, high in ((0, 50), (50, 80), (80, 80)):
        spans(spark, low, high).repartition(3).write.format("spans").mode("append").option("path", folder).save()
    key = lambda df: sorted((r.name, r.start_ns, r.attributes["k"]) for r in df.collect())
    assert key(read_spans(spark, folder, SPAN)) == key(spans(spark, 0, 80))


def test_new_flows_on_a_stream(spark):
    """One packet of every flow, as in the batch twin, though flows go on in later micro-batches."""
    packets = EVENTS.read(spark, SF).filter("packet_id < 300").cache()
    source = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for low in (0, 150):
        packets.filter(f"packet_id >= {low} AND packet_id < {low + 150}").coalesce(1).write.mode("append").parquet(f"{source}/in")
    stream = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/in")
    query = tracker.new_flows(stream, BOOT_NS, "1 hour").writeStream.format("memory").queryName("first_packets").option("checkpointLocation", f"{source}/state").trigger(availableNow=True).start()
    query.awaitTermination(100)
    assert query.exception() is None
    key = lambda df: sorted((r.host, bytes(r.a_ip), r.a_port, bytes(r.b_ip), r.b_port, r.proto) for r in df.collect())
    assert key(spark.table("first_packets")) == key(flows.new_flows(packets, EVENTS.order))


class Row:
    def __init__(self, n):
        self.n = n

    def asDict(self, recursive):  # noqa: N802
        return {"name": str(self.n), "start_ns": self.n, "attributes": {}}


def test_failed_attempts_leave_no_duplicate(spark):
    """Of a task that is tried again the manifest names one attempt; an aborted write names none."""
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    writer = SpanWriter(folder)

    def broken():
        yield Row(1)
        raise OSError("lost")

    with pytest.raises(OSError):
        writer.write(broken())
    writer.write([Row(1), Row(2)])  # an attempt whose message never comes back
    writer.commit([writer.write([Row(1), Row(2)]), None, writer.write([Row(3)]), writer.write([])])
    assert sorted(r.start_ns for r in read_spans(spark, folder, SPAN).collect()) == [1, 2, 3]
    lost = [writer.write([Row(4)]), None]
    writer.abort(lost)
    assert sorted(r.start_ns for r in read_spans(spark, folder, SPAN).collect()) == [1, 2, 3]
    assert not os.path.exists(f"{folder}/{lost[0].files[0]}")


def test_stream_of_spans(spark):
    """Micro-batches have a manifest each, under their number."""
    spark.dataSource.register(SpanSink)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for low in (0, 20):
        spans(spark, low, low + 20).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(SPAN).parquet(f"{folder}/in")
        query = stream.writeStream.format("spans").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(100)
        assert query.exception() is None
    assert sorted(r.start_ns for r in read_spans(spark, f"{folder}/out", SPAN).collect()) == list(range(40))
    names = sorted(os.listdir(f"{folder}/out/manifests"))
    assert names == [f"stream-{i:020d}.json" for i in range(2)]
    with open(f"{folder}/out/manifests/{names[0]}") as f:
        assert json.load(f)["rows"] == 20
