"""The fold of long runs in chunks, against the fold of whole runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowtide.functions import tcp
from flowtide.operators import flows, scan
from flowtide.operators.flows import SECOND
from flowtide.sources.packets import EVENTS, LINES

from .test_flows import packet_frame

SF = "/root/testdata/sf0.001"
COLUMNS = ["ts_ns", "session", "start_ns", "seen", "state", "jitter_ns", "wait_sum_ns", "waits", "first_a_to_b", "place"]


def rows(df, *more):
    return sorted(map(tuple, df.select(*COLUMNS, *more).collect()))


def conversation(seed, n, pauses):
    """One flow; most packets come close together, some after pauses that end a session after FIN or RST, or always."""
    r = np.random.default_rng(seed)
    ts, out = 0, []
    for _ in range(n):
        ts += int(r.choice(pauses)) * SECOND + int(r.integers(1, SECOND))
        out.append((ts, bool(r.integers(2)), int(r.choice([16, 16, 24, 24, 24, 2, 18, 17, 4], p=[0.2, 0.2, 0.15, 0.15, 0.15, 0.05, 0.05, 0.03, 0.02])), bool(r.integers(2)), int(r.integers(60, 1500))))
    return out


@pytest.mark.parametrize("pauses", [[0, 0, 0, 0, 3, 8], [0], [12], [0, 19, 7]])
@pytest.mark.parametrize("chunk", [7, 40])
def test_one_flow_in_chunks(spark, pauses, chunk):
    packets = packet_frame(spark, conversation(len(pauses), 600, pauses)).withColumn("place_", F.col("ts_ns"))
    whole = rows(flows.session_fold(packets, ["ts_ns"]))
    assert rows(flows.session_fold(packets, ["ts_ns"], chunk=chunk)) == whole and len(whole) == 600


@pytest.mark.parametrize("table", [EVENTS, LINES])
def test_tables_in_chunks(spark, table):
    packets = table.read(spark, SF)
    packets = packets if "host" in packets.columns else packets.withColumn("host", F.lit(0))
    assert rows(flows.session_fold(packets, table.ranked, chunk=2), "a_port", "b_port") == rows(flows.session_fold(packets, table.ranked), "a_port", "b_port")


def test_one_flow_is_folded_in_many_tasks(spark):
    """All packets in one flow without a pause: chunks lie in several partitions, and each is folded there."""
    packets = packet_frame(spark, [(i * SECOND // 2, i % 3 > 0, 24, True, 100) for i in range(4000)])
    folded = flows.packet_fold(packets, ["ts_ns"], chunk=100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)  # they would be, as they are small
    parts = folded.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and max(r["count"] for r in parts) < 2500


def test_jitter_steps():
    """A chunk's step function gives what its waits give one by one, from any jitter before."""
    r = np.random.default_rng(4)
    for waits in ([], [5], r.integers(0, 2**33, 50).tolist(), r.integers(0, 10**9, 900).tolist(), [100] * 1200, [0] * 700):
        f = scan.Jitter()
        for i in range(0, len(waits), 70):
            f.add(waits[i : i + 70])
        assert len(f.waits) < 500
        for before in [0, 1, 99, 100, 131, 2**32 - 1, *r.integers(0, 2**32, 20).tolist()]:
            want = before
            for w in waits:
                want = scan.jitter_after(want, w)
            assert f(before) == want


def test_functions_compose():
    """States after chunks, from summaries alone, are those that the fold has there."""
    packets = conversation(9, 400, [0, 0, 4, 21])
    ts, along, flags, payload = (np.array([p[k] for p in packets]) for k in (0, 1, 2, 3))
    values = (np.full(400, 6), ts, flags, along, along, payload)
    timeouts = flows.Timeouts()
    whole, state = flows.Fold(timeouts), scan.fresh(int(ts[0]), bool(along[0]))
    for i in range(0, 400, 25):
        made = scan.Summarizer(lambda last: flows.Fold(timeouts, last), tcp.next_states())
        for k in (i, i + 10):
            made.batch(*[v[k : k + (10 if k == i else 15)] for v in values])
        new = np.zeros(25, bool)
        new[0] = i == 0
        whole.batch(new, *[v[i : i + 25] for v in values])
        state = scan.loads(made.summary()).apply(state, whole.idle_after(6, state["seen"]))
        assert {k: state[k] for k in whole.last} == whole.last
