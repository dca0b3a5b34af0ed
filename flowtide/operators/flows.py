"""Packets into flows: bidirectional aggregates, sessions, ordered folds and interval records.

Everything decomposable is one partial-and-final aggregate on the flow key. What needs packet order (jitter,
TCP state, timeouts that depend on flags) is one pass over packets sorted inside partitions, with a state of
a few numbers, so a flow of any length needs no more memory than a short one.
"""

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from . import scan
from ..functions import tcp
from ..functions.addresses import KEY, UDP, ICMP, ICMPV6, TCP, key_id, with_key
from ..functions.names import END_REASONS, STATES, lookup

SECOND = 1_000_000_000


@dataclass(frozen=True)
class Timeouts:
    """Seconds without packets after which a flow ends, and seconds after which a running one is recorded."""

    icmp: int = 10
    tcp: int = 20
    tcp_fin: int = 5
    tcp_rst: int = 5
    udp: int = 60
    other: int = 30
    record: int = 60

    def idle_ns(self, proto: Column, flags: Column | None = None) -> Column:
        """Without flags: the longest that the protocol allows."""
        out = F.when(proto.isin(ICMP, ICMPV6), self.icmp).when(proto == UDP, self.udp)
        if flags is not None:
            out = out.when((proto == TCP) & tcp.has(flags, tcp.RST), self.tcp_rst).when((proto == TCP) & tcp.has(flags, tcp.FIN), self.tcp_fin)
        return out.when(proto == TCP, self.tcp).otherwise(self.other).cast("long") * SECOND

    def idle_ns_sql(self, proto: str, flags: str) -> str:
        return f"CASE WHEN {proto} IN (1, 58) THEN {self.icmp} WHEN {proto} = 17 THEN {self.udp} WHEN {proto} = 6 AND ({flags} & 4) = 4 THEN {self.tcp_rst} WHEN {proto} = 6 AND ({flags} & 1) = 1 THEN {self.tcp_fin} WHEN {proto} = 6 THEN {self.tcp} ELSE {self.other} END * CAST({SECOND} AS BIGINT)"


def _oriented(prefix: str = "") -> dict[str, Column]:
    """Source and destination from the creating packet's direction, a_to_b of which is `first_a_to_b`."""
    one = F.col("first_a_to_b")
    pick = lambda a, b: F.when(one, F.col(a)).otherwise(F.col(b))
    return {"src_ip": pick("a_ip", "b_ip"), "src_port": pick("a_port", "b_port"), "dst_ip": pick("b_ip", "a_ip"), "dst_port": pick("b_port", "a_port")}


#: A place among packets of one ts_ns is less than this.
PLACES = 10**18


def _rank(packets: DataFrame, order: list[str]) -> Column:
    """What orders packets: a number of fixed width where two longs say it, so that hash aggregates can keep it."""
    if len(order) == 1:
        return F.col(order[0])
    if len(order) == 2 and all(packets.schema[c].dataType.typeName() == "long" for c in order):
        return F.col(order[0]).cast("decimal(19,0)") * F.lit(PLACES).cast("decimal(19,0)") + F.col(order[1])
    return F.struct(*order)


def flow_aggregate(packets: DataFrame, order: list[str], by: tuple[str, ...] = ("host",), first: tuple[str, ...] = ()) -> DataFrame:
    """One row a flow: oriented endpoints, packets and bytes each way, first and last time, flags each way.

    Columns named in first are kept as of the packet that created the flow. With an order of ts_ns and a place
    (a long from 0 to under 10**18) and no text among first, all is one hash aggregate.
    """
    keyed = with_key(packets)
    groups = [*[c for c in by if c in packets.columns], *KEY]
    along = F.col("a_to_b")
    place = _rank(packets, order)
    aggs = [F.min_by("a_to_b", place).alias("first_a_to_b"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.bit_or("tcp_flags").alias("tcp_flags")]
    aggs += [F.min_by(c, place).alias(c) for c in first]
    for name, side in (("ab", along), ("ba", ~along)):
        aggs += [F.count_if(side).alias(f"packets_{name}"), F.sum(F.when(side, F.col("len")).otherwise(0)).alias(f"bytes_{name}")]
        aggs += [F.coalesce(F.bit_or(F.when(side, F.col("tcp_flags"))), F.lit(0)).alias(f"flags_{name}"), F.min_by("tcp_flags", F.when(side, place)).alias(f"first_flags_{name}")]
    flows = keyed.groupBy(*groups).agg(*aggs)
    one = F.col("first_a_to_b")
    columns = {"community_id": key_id(), **_oriented()}
    for name in ("packets", "bytes", "flags", "first_flags"):
        columns |= {f"fwd_{name}": F.when(one, F.col(f"{name}_ab")).otherwise(F.col(f"{name}_ba")), f"rev_{name}": F.when(one, F.col(f"{name}_ba")).otherwise(F.col(f"{name}_ab"))}
    dropped = [f"{n}_{d}" for n in ("packets", "bytes", "flags", "first_flags") for d in ("ab", "ba")]
    return flows.withColumns(columns).drop("a_ip", "a_port", "b_ip", "b_port", *dropped)


def new_flows(packets: DataFrame, order: list[str]) -> DataFrame:
    """The first packet of every flow key: an aggregate, combined before it is shuffled."""
    keyed = with_key(packets)
    others = [c for c in keyed.columns if c not in ("host", *KEY)]
    first = F.min_by(F.struct(*others), _rank(keyed, order)).alias("__first")
    found = keyed.groupBy("host", *KEY).agg(first).select("host", *KEY, "__first.*")
    return found.select(*keyed.columns, key_id().alias("community_id"))


def tcp_timing(packets: DataFrame, order: list[str]) -> DataFrame:
    """Handshake latency, and sum, count and mean of transactions: payload answered by payload of the peer.

    A transaction ends at a payload packet whose flow's previous payload packet ran the other way; a repeated
    SYN or SYN+ACK counts as of its last time.
    """
    keyed = with_key(packets.filter(F.col("proto") == TCP)).select("host", *KEY, *[c for c in order if c != "ts_ns"], "ts_ns", "a_to_b", "has_payload", "tcp_flags")
    syn = F.when(tcp.has(F.col("tcp_flags"), tcp.SYN) & ~tcp.has(F.col("tcp_flags"), tcp.ACK), F.col("ts_ns"))
    syn_ack = F.when(tcp.has(F.col("tcp_flags"), tcp.SYN | tcp.ACK), F.col("ts_ns"))
    # The payload packet before: one window on the flow key, whose shuffle the aggregate below uses again.
    earlier = Window.partitionBy("host", *KEY).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(F.col("has_payload"), F.struct("ts_ns", "a_to_b")), ignorenulls=True).over(earlier)
    turned = F.col("has_payload") & (F.col("before.a_to_b") != F.col("a_to_b"))
    waits = keyed.withColumn("before", before).withColumn("wait", F.when(turned, F.col("ts_ns") - F.col("before.ts_ns")))
    out = waits.groupBy("host", *KEY).agg(F.max(syn).alias("syn_ns"), F.max(syn_ack).alias("syn_ack_ns"), F.coalesce(F.sum("wait"), F.lit(0)).alias("latency_sum_ns"), F.count("wait").alias("transactions"))
    handshake = F.when(F.col("syn_ns").isNotNull() & F.col("syn_ack_ns").isNotNull(), F.greatest(F.col("syn_ack_ns") - F.col("syn_ns"), F.lit(0)))
    mean = F.when(F.col("transactions") > 0, F.expr("latency_sum_ns DIV transactions"))
    return out.select(key_id().alias("community_id"), "host", handshake.alias("handshake_ns"), "latency_sum_ns", "transactions", mean.alias("latency_mean_ns"))


FOLDED = "start_ns long, seen int, state int, jitter_ns long, wait_sum_ns long, waits int, first_a_to_b boolean, place long"


def observed_key(df: DataFrame) -> list[str]:
    """A flow is one host's view of a conversation, where packets say whose."""
    return [*[c for c in ("host",) if c in df.columns], *KEY]


#: Packets of a chunk of a run; a chunk has one slice of time at least.
CHUNK = 1 << 18


def with_runs(keyed: DataFrame, key: list[str], timeouts: Timeouts, chunk: int = CHUNK) -> DataFrame:
    """Adds run, and chunk and chunks of the run: a run is a flow's packets between pauses over the longest timeout.

    Pauses are found on first and last times of fixed slices of time, so that a flow with very many packets
    is spread over tasks from the start. A run of over `chunk` packets is cut into chunks of about as many, at the
    edges of slices. Flows stand for themselves by a hash; should two share one, their runs end where both
    pause, which is a pause of each.
    """
    t, flow = timeouts, ["flow_hash", "proto"]
    keyed = keyed.withColumns({"slot": F.expr(f"ts_ns DIV {max(t.icmp, t.tcp, t.udp, t.other) * SECOND}"), "flow_hash": F.xxhash64(*key)})
    by_time = Window.partitionBy(*flow).orderBy("slot")
    slices = keyed.groupBy(*flow, "slot").agg(F.min("ts_ns").alias("first"), F.max("ts_ns").alias("last"), F.count("*").alias("n"))
    pause = F.col("first") - F.lag("last").over(by_time) > timeouts.idle_ns(F.col("proto"))
    runs = slices.withColumn("pause", pause).withColumn("run", F.coalesce(F.sum(F.col("pause").cast("long")).over(by_time), F.lit(0)))
    in_run = Window.partitionBy(*flow, "run").orderBy("slot")
    runs = runs.withColumn("before", F.sum("n").over(in_run) - F.col("n")).withColumn("chunk", F.expr(f"before DIV {chunk}"))
    runs = runs.withColumn("chunks", F.max("chunk").over(in_run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) + 1)
    known = runs.filter("run > 0 OR chunks > 1").select(*flow, "slot", "run", "chunk", "chunks")
    joined = keyed.join(known, [*flow, "slot"], "left").drop("slot", "flow_hash")
    return joined.withColumns({c: F.coalesce(c, F.lit(n).cast("long")) for c, n in (("run", 0), ("chunk", 0), ("chunks", 1))})


class Fold:
    """Sessions, states and waits of packets in the order of their runs, a batch at a time."""

    def __init__(self, timeouts: Timeouts, last: dict | None = None):
        t = self.timeouts = timeouts
        self.idle = np.full(256, t.other, np.int64) * SECOND
        self.idle[[TCP, UDP, ICMP, ICMPV6]] = np.array([t.tcp, t.udp, t.icmp, t.icmp]) * SECOND
        self.shortest = min(t.tcp, t.tcp_fin, t.tcp_rst) * SECOND
        self.next = tcp.next_states()
        self.last = last

    def idle_after(self, proto: int, seen: int) -> int:
        t = self.timeouts
        return (t.tcp_rst if seen & tcp.RST else t.tcp_fin if seen & tcp.FIN else t.tcp) * SECOND if proto == TCP else int(self.idle[proto])

    def _cuts(self, new, proto, ts, before, flags) -> np.ndarray:
        """Where a session begins inside a run. Only pauses that some timeout allows are looked at one by one."""
        is_tcp, pause = proto == TCP, ts - before
        cut = ~new & (pause > self.idle[proto])
        counts = {bit: np.cumsum((flags & bit) != 0) for bit in (tcp.FIN, tcp.RST)}
        unsure = np.flatnonzero(~new & ~cut & is_tcp & (pause > self.shortest))
        starts = np.maximum.accumulate(np.where(new | cut, np.arange(len(ts)), -1))
        begun = -1  # the last session that begins at an unsure place
        for i in unsure.tolist():
            start = max(int(starts[i]), begun)
            seen = {bit: int(c[i - 1] - (c[start - 1] if start > 0 else 0)) if i else 0 for bit, c in counts.items()}
            carried = self.last["seen"] if start < 0 else 0
            t = self.timeouts
            idle = t.tcp_rst if seen[tcp.RST] or carried & tcp.RST else t.tcp_fin if seen[tcp.FIN] or carried & tcp.FIN else t.tcp
            if pause[i] > idle * SECOND:
                cut[i], begun = True, i
        return cut

    def batch(self, new, proto, ts, flags, egress, along, payload) -> dict[str, np.ndarray]:
        n, last, row = len(ts), self.last or dict.fromkeys(("ts", "start", "seen", "state", "jitter", "sum", "waits", "first", "payload", "payload_along", "place"), 0), np.arange(len(ts))
        cut = self._cuts(new, proto, ts, np.concatenate([[last["ts"]], ts[:-1]]), flags)
        begins = new | cut
        start = np.maximum.accumulate(np.where(begins, row, -1))
        carried, at = start < 0, np.maximum(start, 0)
        out = {"start_ns": np.where(carried, last["start"], ts[at]), "first_a_to_b": np.where(carried, last["first"], along[at]).astype(bool)}
        seen = np.where(carried, last["seen"], 0)
        for bit in (1 << k for k in range(8)):
            seen |= np.where(np.maximum.accumulate(np.where(flags & bit, row, -1)) >= at, bit, 0)
        out["seen"] = seen
        run = np.maximum.accumulate(np.where(new, row, -1))
        out["place"] = np.where(run < 0, last["place"] + 1 + row, row - run)
        # Waits: from the payload packet before, of the same session, to one that runs the other way.
        speaks = payload & (proto == TCP)
        spoke = np.concatenate([[-1], np.maximum.accumulate(np.where(speaks, row, -1))[:-1]])
        known = spoke >= at
        held = carried & (spoke < 0) & (last["payload"] is not None)
        when = np.where(known, ts[np.maximum(spoke, 0)], last["payload"] or 0)
        way = np.where(known, along[np.maximum(spoke, 0)], bool(last["payload_along"]))
        turned = speaks & (known | held) & (way != along)
        wait = np.where(turned, ts - when, 0)
        sums, turns = np.cumsum(wait), np.cumsum(turned)
        out["wait_sum_ns"] = sums - np.where(carried, -last["sum"], sums[at] - wait[at])
        out["waits"] = turns - np.where(carried, -last["waits"], turns[at] - turned[at])
        jitters, jitter, owner = np.zeros(n, np.int64), last["jitter"], -1
        places = np.flatnonzero(turned)
        for i, own, value in zip(places.tolist(), start[places].tolist(), np.minimum(wait[places], 0xFFFFFFFF).tolist()):
            if own != owner:
                jitter, owner = 0, own
            off = value - jitter
            jitter += off // 16 if off >= 0 else -(-off // 16)
            jitters[i] = jitter
        latest = np.maximum.accumulate(np.where(turned, row, -1))
        out["jitter_ns"] = np.where(latest >= at, jitters[np.maximum(latest, 0)], np.where(carried, np.where(latest >= 0, jitters[np.maximum(latest, 0)], last["jitter"]), 0))
        # States: packets that can't change any state are passed over.
        states, state, table = np.zeros(n, np.int64), last["state"], self.next
        codes = np.where(proto == TCP, 2 * (flags & 255) + egress, 0)
        moving = np.flatnonzero(begins | ((proto == TCP) & (table != np.arange(table.shape[1])).any(axis=1)[codes]))
        steps = table.tolist()
        for i, opens, code, live in zip(moving.tolist(), begins[moving].tolist(), codes[moving].tolist(), (proto[moving] == TCP).tolist()):
            state = 0 if opens else state
            state = steps[code][state] if live else 0
            states[i] = state
        moved = np.maximum.accumulate(np.where(np.isin(row, moving), row, -1))
        out["state"] = np.where(moved < 0, last["state"], states[np.maximum(moved, 0)])
        final = np.flatnonzero(speaks & (row >= at[-1])) if not carried[-1] else np.flatnonzero(speaks)
        spoken = (int(ts[final[-1]]), bool(along[final[-1]])) if len(final) else (last["payload"], last["payload_along"]) if carried[-1] else (None, None)
        self.last = {"ts": int(ts[-1]), "payload": spoken[0], "payload_along": spoken[1]} | {k: out[c][-1].item() for k, c in (("start", "start_ns"), ("seen", "seen"), ("state", "state"), ("jitter", "jitter_ns"), ("sum", "wait_sum_ns"), ("waits", "waits"), ("first", "first_a_to_b"), ("place", "place"))}
        return out


def _marks(batch: pa.RecordBatch, whole: list[str], last_key: tuple | None) -> tuple[np.ndarray, tuple]:
    """Where a row's key isn't that of the row before, and the key of the last row."""
    n = batch.num_rows
    new = np.ones(n, bool)
    same = [pc.equal(batch.column(c).slice(1), batch.column(c).slice(0, n - 1)).to_numpy(zero_copy_only=False) for c in whole]
    new[1:] = ~np.logical_and.reduce(same)
    new[0] = tuple(batch.column(c)[0].as_py() for c in whole) != last_key
    return new, tuple(batch.column(c)[-1].as_py() for c in whole)


def _values(batch: pa.RecordBatch) -> list[np.ndarray]:
    values = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("proto", "ts_ns", "tcp_flags", "egress", "a_to_b", "has_payload")]
    return [v.astype(bool) if v.dtype == object else v for v in values]


_KINDS = {name: {"boolean": pa.bool_(), "long": pa.int64(), "int": pa.int32()}[kind] for name, kind in (c.split() for c in FOLDED.split(", "))}


def _folded(placed: DataFrame, whole: list[str], timeouts: Timeouts) -> DataFrame:
    """Rows of sorted chunks with what the fold says; start is the state before a chunk of a run that has several."""
    dropped = ("run", "chunk", "start")
    kept = [f for f in placed.schema.fields if f.name not in dropped]
    schema = StructType([*kept, *StructType.fromDDL(FOLDED).fields])

    def task(batches):
        fold, last_key = Fold(timeouts), None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last_key = _marks(batch, whole, last_key)
            start = batch.column("start")
            goes_on = np.flatnonzero(new & pc.is_valid(start).to_numpy(zero_copy_only=False)).tolist()
            cuts = sorted({0, *goes_on, batch.num_rows})
            for i, j in zip(cuts, cuts[1:]):
                part, opens = batch.slice(i, j - i), new[i:j].copy()
                if i in goes_on:
                    fold.last, opens[0] = pickle.loads(start[i].as_py()), False
                out = fold.batch(opens, *_values(part))
                yield pa.RecordBatch.from_arrays([*[part.column(f.name) for f in kept], *(pa.array(out[c]).cast(kind) for c, kind in _KINDS.items())], names=schema.names)

    return placed.mapInArrow(task, schema)


def _summaries(placed: DataFrame, whole: list[str], timeouts: Timeouts) -> DataFrame:
    """One row a chunk of sorted chunks: whole and its function (binary)."""
    schema = StructType([*[placed.schema[c] for c in whole], *StructType.fromDDL("summary binary").fields])

    def task(batches):
        made, last_key = None, None
        out = lambda: pa.RecordBatch.from_pylist([dict(zip(whole, last_key)) | {"summary": made.summary()}], schema=arrow)
        arrow = None
        for batch in batches:
            if not batch.num_rows:
                continue
            arrow = pa.schema([*[batch.schema.field(c) for c in whole], pa.field("summary", pa.binary())])
            new, key = _marks(batch, whole, last_key)
            cuts = [0, *(np.flatnonzero(new[1:]) + 1).tolist(), batch.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                part = batch.slice(i, j - i)
                if new[i]:
                    if made is not None:
                        yield out()
                    made = scan.Summarizer(lambda last: Fold(timeouts, last), tcp.next_states())
                last_key = tuple(part.column(c)[0].as_py() for c in whole)
                made.batch(*_values(part))
        if made is not None:
            yield out()

    return placed.mapInArrow(task, schema)


def _starts(summaries: DataFrame, key: list[str], timeouts: Timeouts) -> DataFrame:
    """The state before each chunk: functions of a run's chunks, applied one after the other; a few numbers are held."""
    schema = StructType([*[f for f in summaries.schema.fields if f.name != "summary"], *StructType.fromDDL("start binary").fields])
    run = [*key, "run"]

    def task(batches):
        fold, last_key, state = Fold(timeouts), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last_key = _marks(batch, run, last_key)
            starts = []
            for i, (proto, made) in enumerate(zip(batch.column("proto").to_pylist(), batch.column("summary").to_pylist())):
                summary = scan.loads(made)
                state = scan.fresh(summary.first_ts, summary.first_along) if new[i] else state
                starts.append(pickle.dumps(state))
                state = summary.apply(state, fold.idle_after(proto, state["seen"]))
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in schema.fields[:-1]], pa.array(starts, pa.binary())], names=schema.names)

    ordered = summaries.repartition(*run).sortWithinPartitions(*run, "chunk")
    return ordered.mapInArrow(task, schema)


def packet_fold(packets: DataFrame, order: list[str], timeouts: Timeouts = Timeouts(), keep: tuple[str, ...] = (), chunk: int | None = None) -> DataFrame:
    """One row a packet: its flow key, its session (start_ns), and the session's state and jitter as of the packet.

    Flows are those of one host, where packets have a host. A session ends when no packet comes for the
    timeout, which depends on the flags that the session has seen. Jitter is J += (|D| - J) / 16 in whole
    numbers over the waits D of transactions. What is dealt to tasks is a run of a flow without a pause over its
    longest timeout; a run of over `chunk` packets (CHUNK) is dealt in chunks: each is summed up as a function of
    the state before it (`scan`), the functions give every chunk its state, and the chunks are folded side by side.
    """
    key = observed_key(packets)
    columns = ["ts_ns", "len", "tcp_flags", "direction", "has_payload", *keep]
    tail = [c for c in order if c not in columns]
    keyed = with_key(packets).withColumn("egress", F.col("direction") == "egress").select(*key, *columns, *tail, "a_to_b", "egress")
    cut, whole = with_runs(keyed, key, timeouts, *([] if chunk is None else [chunk])), [*key, "run", "chunk"]
    if "chunk" not in cut.columns:
        cut = cut.withColumns({"chunk": F.lit(0).cast("long"), "chunks": F.lit(1).cast("long")})
    several = cut.filter("chunks > 1").select(*whole, *dict.fromkeys(["ts_ns", *order, "tcp_flags", "egress", "a_to_b", "has_payload"]))
    starts = _starts(_summaries(several.repartition(*whole).sortWithinPartitions(*whole, *order), whole, timeouts), key, timeouts)
    placed = cut.drop("chunks").repartition(*whole).join(starts.hint("shuffle_hash"), whole, "left").sortWithinPartitions(*whole, *order).drop(*tail)
    return _folded(placed, whole, timeouts)


def session_fold(packets: DataFrame, order: list[str], timeouts: Timeouts = Timeouts(), keep: tuple[str, ...] = (), chunk: int | None = None) -> DataFrame:
    """packet_fold with session: the number of a packet's session in its flow, from 0."""
    return numbered(packet_fold(packets, order, timeouts, keep, chunk))


def numbered(folded: DataFrame) -> DataFrame:
    """Packets of packet_fold with session: the number of their session in its flow, from 0.

    Sessions are numbered by their times, once each, and joined back, so no flow's packets have to meet in one task.
    """
    key = observed_key(folded)
    own = folded.groupBy(*key, "start_ns").agg(F.count("*").alias("__n"))
    place = own.withColumn("session", F.row_number().over(Window.partitionBy(*key).orderBy("start_ns")) - 1).drop("__n")
    return folded.join(place, [*key, "start_ns"])


def sessions(folded: DataFrame) -> DataFrame:
    """One row a session: times, counters each way of its first packet, flags, state, jitter and end reason."""
    key = observed_key(folded)
    forward = F.col("a_to_b") == F.col("first_a_to_b")
    grouped = folded.groupBy(*key, "start_ns").agg(
        F.max("ts_ns").alias("end_ns"),
        F.any_value("first_a_to_b").alias("first_a_to_b"),
        F.count_if(forward).alias("fwd_packets"),
        F.count_if(~forward).alias("rev_packets"),
        F.sum(F.when(forward, F.col("len")).otherwise(0)).alias("fwd_bytes"),
        F.sum(F.when(~forward, F.col("len")).otherwise(0)).alias("rev_bytes"),
        F.bit_or("tcp_flags").alias("tcp_flags"),
        *_as_of_end(),
    )
    columns = {"community_id": key_id(), **_oriented(), "state": lookup(F.col("state"), STATES), "end_reason": end_reason(F.col("tcp_flags"), F.lit(True))}
    numbered = grouped.withColumn("session", F.row_number().over(Window.partitionBy(*key).orderBy("start_ns")) - 1)
    return numbered.withColumns(columns).drop("a_ip", "a_port", "b_ip", "b_port", "first_a_to_b")


def _as_of_end() -> list[Column]:
    """What the fold says at the last packet."""
    at_end = F.max_by(F.struct("state", "jitter_ns", "wait_sum_ns", "waits"), "place")
    return [at_end.getField(c).alias(c) for c in ("state", "jitter_ns", "wait_sum_ns", "waits")]


def end_reason(flags: Column, last: Column) -> Column:
    """FIN or RST seen: end of flow; else the flow idled out, or is recorded while it runs."""
    number = F.when(last & (flags.bitwiseAND(F.lit(tcp.FIN | tcp.RST)) != 0), 3).when(last, 1).otherwise(2)
    return lookup(number, END_REASONS)


def interval_records(folded: DataFrame, metadata: tuple[str, ...] = (), timeouts: Timeouts = Timeouts()) -> DataFrame:
    """Flow records: one for each record interval of a session that has packets, with deltas and totals.

    metadata columns are those of the first packet of the interval in each direction.
    """
    forward = F.col("a_to_b") == F.col("first_a_to_b")
    step = timeouts.record * SECOND
    numbered = folded.withColumn("interval", F.expr(f"(ts_ns - start_ns) DIV {step}"))
    side = {"fwd": forward, "rev": ~forward}
    aggs = [F.min("ts_ns").alias("record_start_ns"), F.max("ts_ns").alias("record_end_ns"), F.any_value("first_a_to_b").alias("first_a_to_b"), F.max("seen").alias("tcp_flags")]
    for name, mine in side.items():
        aggs += [F.count_if(mine).alias(f"{name}_packets_delta"), F.sum(F.when(mine, F.col("len")).otherwise(0)).alias(f"{name}_bytes_delta")]
        aggs += [F.min_by(m, F.when(mine, F.col("place"))).alias(f"{name}_{m}") for m in metadata]
    key = observed_key(folded)
    records = numbered.groupBy(*key, "start_ns", "interval").agg(*aggs, *_as_of_end())
    so_far = Window.partitionBy(*key, "start_ns").orderBy("interval").rowsBetween(Window.unboundedPreceding, 0)
    totals = {f"{n}_{what}_total": F.sum(f"{n}_{what}_delta").over(so_far) for n in side for what in ("packets", "bytes")}
    ordered = Window.partitionBy(*key, "start_ns").orderBy("interval")
    last = F.lead("interval").over(ordered).isNull()
    seen = F.bit_or("tcp_flags").over(so_far)
    number = F.dense_rank().over(Window.partitionBy(*key).orderBy("start_ns")) - 1  # of records, not of packets
    records = records.withColumns({**totals, "tcp_flags": seen, "end_reason": end_reason(seen, last), "session": number})
    return records.withColumns({"community_id": key_id(), **_oriented(), "state": lookup(F.col("state"), STATES)}).drop("a_ip", "a_port", "b_ip", "b_port", "first_a_to_b")


def snapshot_deltas(snapshots: DataFrame, flow: list[str], at: str, counters: list[str]) -> DataFrame:
    """Cumulative counters into deltas, never under 0, with totals; snapshots without new packets go."""
    before = Window.partitionBy(*flow).orderBy(at)
    deltas = {f"{c}_delta": F.greatest(F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0)), F.lit(0)) for c in counters}
    packets = [f"{c}_delta" for c in counters if "packets" in c]
    return snapshots.withColumns(deltas).filter(" OR ".join(f"{p} > 0" for p in packets))


def one_observer(records: DataFrame, start: str, end: str, packets: str, interface: str) -> DataFrame:
    """Of records of one conversation that overlap in time on several interfaces, the one with most packets.

    Overlapping records are chained into a window; each window keeps its best interface's records.
    """
    by_id = Window.partitionBy("community_id").orderBy(start, end, interface)
    reach = F.max(end).over(by_id.rowsBetween(Window.unboundedPreceding, -1))
    opened = F.sum((F.coalesce(F.col(start) > reach, F.lit(False))).cast("int")).over(by_id)
    best = Window.partitionBy("community_id", "window").orderBy(F.desc(packets), interface, start)
    return records.withColumn("window", opened).withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")
