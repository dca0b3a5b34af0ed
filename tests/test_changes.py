"""Changes of a cluster: validity kind by kind, as-of joins, and the table that a stream keeps, against plain Python."""

import random
import tempfile

import pytest

from flowtide.operators import filters
from flowtide.operators.asof import as_of
from flowtide.sources import inventory
from flowtide.streaming.changes import ChangeTable

CHANGE = "uid string, kind string, event string, ts_ns long, ips array<string>"


def test_a_list_ends_only_its_kind(spark):
    """A Node applied at 1 isn't touched by a Pod list that is sent again from 10 to 12; a Pod that it lacks is."""
    rows = [("node", "Node", "apply", 1, ["a"]), ("pod", "Pod", "apply", 2, ["b"]), (None, "Pod", "init", 10, None), (None, "Node", "init", 11, None), (None, "Pod", "init_done", 12, None)]
    got = {r.uid: r.valid_to for r in inventory.validity(spark.createDataFrame(rows, CHANGE)).collect()}
    assert got == {"node": inventory.FOREVER, "pod": 12}
    rows.append((None, "Node", "init_done", 20, None))
    got = {r.uid: r.valid_to for r in inventory.validity(spark.createDataFrame(rows, CHANGE)).collect()}
    assert got == {"node": 20, "pod": 12}


def stream_of_changes(seed, n=400):
    """Objects of three kinds that come, change and go; lists of the kinds overlap in time; some events are errors."""
    r, out, sending = random.Random(seed), [], {}
    for ts in range(1, n):
        kind = r.choice(["Pod", "Node", "Service"])
        x = r.random()
        if x < 0.06 and kind not in sending:
            sending[kind] = ts
            out.append((None, kind, "init", ts, None))
        elif x < 0.2 and kind in sending:
            del sending[kind]
            out.append((None, kind, "init_done", ts, None))
        elif x < 0.25:
            out.append((f"{kind}{r.randrange(12)}", kind, "error", ts, None))
        else:
            event = "delete" if r.random() < 0.2 else "apply"
            out.append((f"{kind}{r.randrange(12)}", kind, event, ts, [f"10.0.0.{r.randrange(3)}"] if event == "apply" else None))
    return out


def intervals(rows):
    """What each applied state's end is, told event by event."""
    open_, out, began = {}, {}, {}
    for uid, kind, event, ts, _ in rows:
        if event == "init":
            began[kind] = ts
        elif event == "init_done":
            for u, (k, since) in list(open_.items()):
                if k == kind and since < began.get(kind, ts):
                    out[u, since] = ts
                    del open_[u]
        elif event in ("apply", "delete"):
            if uid in open_:
                out[uid, open_.pop(uid)[1]] = ts
            if event == "apply":
                open_[uid] = (kind, ts)
    return out | {(u, since): inventory.FOREVER for u, (_, since) in open_.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_validity(spark, seed):
    rows = stream_of_changes(seed)
    got = {(r.uid, r.valid_from): r.valid_to for r in inventory.validity(spark.createDataFrame(rows, CHANGE)).collect()}
    assert got == intervals(rows)


def test_table_kept_by_a_stream(spark):
    """In micro-batches that cut lists anywhere the table holds after each batch what its batch twin says."""
    rows = stream_of_changes(3, 240)
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    table, changes = ChangeTable(f"file://{folder}/objects"), spark.createDataFrame(rows, CHANGE)
    key = lambda df: sorted((r.uid, r.kind, r.ts_ns, tuple(r.ips or ())) for r in df.collect())
    for low in range(0, 240, 80):
        changes.filter(f"ts_ns >= {low} AND ts_ns < {low + 80}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        query = stream.writeStream.foreachBatch(table).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        assert key(table.read(spark)) == key(inventory.latest(changes.filter(f"ts_ns < {low + 80}")))
    # A batch that is tried again writes the same version.
    before = key(table.read(spark))
    table(changes.filter("ts_ns >= 160"), 2)
    assert key(table.read(spark)) == before and before


@pytest.mark.parametrize("following", [False, True])
@pytest.mark.parametrize("bucket", [1, 7, 10**6])
def test_as_of(spark, following, bucket):
    r = random.Random(bucket)
    facts = [(r.choice("ab"), r.randrange(-20, 100), f"v{i}") for i in range(30)]
    rows = [(r.choice("abc"), t) for t in range(-30, 110, 3)]
    got = as_of(spark.createDataFrame(rows, "k string, t long"), spark.createDataFrame(facts, "k string, since long, v string"), ["k"], "t", "since", ["v"], following, bucket).collect()

    def want(k, t):
        own = [(s, v) for key, s, v in facts if key == k and (s > t if following else s <= t)]
        moment = min(own)[0] if own and following else max(own)[0] if own else None
        return max((v for s, v in own if s == moment), default=None)

    assert sorted((x.k, x.t, x.v) for x in got) == sorted((k, t, want(k, t)) for k, t in rows)
    assert as_of(spark.createDataFrame([], "k string, t long"), spark.createDataFrame(facts, "k string, since long, v string"), ["k"], "t", "since", ["v"], following, bucket).collect() == []


def test_interfaces_over_time(spark):
    changes = spark.createDataFrame([(1, 10, "add", "eth0"), (1, 20, "add", "wan0"), (1, 30, "remove", None), (1, 40, "add", "eth0")], "ifindex int, ts_ns long, event string, interface_name string")
    rows = spark.createDataFrame([(1, t) for t in (5, 10, 19, 20, 30, 39, 40, 99)] + [(2, 50)], "ifindex int, ts_ns long")
    got = {(r.ifindex, r.ts_ns): r.interface_name for r in filters.interface_at(rows, changes).collect()}
    assert got == {(1, 5): "unknown", (1, 10): "eth0", (1, 19): "eth0", (1, 20): "wan0", (1, 30): "unknown", (1, 39): "unknown", (1, 40): "eth0", (1, 99): "eth0", (2, 50): "unknown"}
    bare = filters.interface_at(rows.filter("ts_ns = 5"), changes, missing=None).first()
    assert bare.interface_name is None
