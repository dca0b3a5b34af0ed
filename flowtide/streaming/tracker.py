"""The flow tracker on Structured Streaming: one state of a few numbers a flow, timers in event time.

Packets wait in the state until the watermark has passed them, so they may come in any order within the delay.
They are then taken in their order and update the flow's state; a record is emitted when a record interval is over, when the flow has
idled out (an event-time timer), or when a later packet shows that it had. A session is known by its flow
and its start_ns, so nothing has to be kept of sessions that are over. The batch twin is
flows.interval_records over flows.session_fold, which gives the same records once every flow is closed.

Packets later than the watermark are dropped by Spark before they reach the tracker; `late` splits them
off beforehand where they should be kept. A query restarted from its checkpoint goes on with the counters
it had. At the end of input, open_flows reads the flows that are still open from the checkpoint.
"""

import bisect
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import tcp
from ..functions.addresses import with_key
from ..functions.names import END_REASONS, STATES
from ..operators.flows import SECOND, Timeouts, observed_key

STATE = "start_ns long, last_ns long, seen int, state int, jitter_ns long, wait_sum_ns long, waits int, first_along boolean, payload_ns long, payload_along boolean, record long, record_start_ns long, fwd_packets_delta long, rev_packets_delta long, fwd_bytes_delta long, rev_bytes_delta long, fwd_packets_total long, rev_packets_total long, fwd_bytes_total long, rev_bytes_total long, version int"
#: State of an earlier version has no version. New fields go behind: with Avro as state encoding Spark reads them as null.
FIRST_STATE, VERSION = STATE.removesuffix(", version int"), 2
FIELDS = [f.split()[0] for f in STATE.split(", ")]
#: A packet as it waits, in the order that packets are taken in.
PENDING = "ts_ns long, place long, len long, tcp_flags int, egress boolean, a_to_b boolean, has_payload boolean"
PENDING_FIELDS = [f.split()[0] for f in PENDING.split(", ")]
RECORD = "flow string, start_ns long, interval long, record_start_ns long, record_end_ns long, fwd_packets_delta long, rev_packets_delta long, fwd_bytes_delta long, rev_bytes_delta long, fwd_packets_total long, rev_packets_total long, fwd_bytes_total long, rev_bytes_total long, tcp_flags int, state string, jitter_ns long, end_reason string"
COUNTERS = [f"{way}_{what}" for way in ("fwd", "rev") for what in ("packets", "bytes")]
MS = 1_000_000


def idle_ns(t: Timeouts, proto: int, seen: int) -> int:
    """The timeout after what a flow has shown."""
    if proto == 6:
        return (t.tcp_rst if seen & tcp.RST else t.tcp_fin if seen & tcp.FIN else t.tcp) * SECOND
    return {1: t.icmp, 58: t.icmp, 17: t.udp}.get(proto, t.other) * SECOND


class Tracked:
    """One flow's state between packets."""

    def __init__(self, values: tuple | None, proto: int, timeouts: Timeouts, fields: list[str] = FIELDS):
        self.proto, self.timeouts, self.fields = proto, timeouts, fields
        self.v = dict(zip(fields, values)) | {"version": VERSION} if values else None

    def values(self) -> tuple:
        return tuple(self.v[f] for f in self.fields)

    def deadline(self) -> int:
        return self.v["last_ns"] + idle_ns(self.timeouts, self.proto, self.v["seen"])

    def _open(self, ts: int, along: bool) -> None:
        self.v = dict.fromkeys(FIELDS, 0) | {"version": VERSION, "start_ns": ts, "first_along": along, "payload_ns": None, "payload_along": None, "record_start_ns": None}

    def record(self, flow: str, last: bool) -> dict:
        """The record that ends now; deltas begin anew."""
        v = self.v
        reason = 2 if not last else 3 if v["seen"] & (tcp.FIN | tcp.RST) else 1
        out = {"flow": flow, "start_ns": v["start_ns"], "interval": v["record"], "record_start_ns": v["record_start_ns"], "record_end_ns": v["last_ns"]}
        out |= {f"{c}_delta": v[f"{c}_delta"] for c in COUNTERS} | {f"{c}_total": v[f"{c}_total"] for c in COUNTERS}
        out |= {"tcp_flags": v["seen"], "state": STATES[v["state"]], "jitter_ns": v["jitter_ns"], "end_reason": END_REASONS[reason]}
        v.update({f"{c}_delta": 0 for c in COUNTERS}, record_start_ns=None)
        return out

    def packet(self, flow: str, ts: int, size: int, flags: int, egress: bool, along: bool, payload: bool) -> Iterator[dict]:
        if self.v is None:
            self._open(ts, along)
        elif ts > self.deadline():
            yield self.record(flow, True)
            self._open(ts, along)
        v = self.v
        number = (ts - v["start_ns"]) // (self.timeouts.record * SECOND)
        if v["record_start_ns"] is not None and number != v["record"]:
            yield self.record(flow, False)
        v["record"] = number
        v["record_start_ns"] = ts if v["record_start_ns"] is None else v["record_start_ns"]
        way = "fwd" if along == v["first_along"] else "rev"
        for scope in ("delta", "total"):
            v[f"{way}_packets_{scope}"] += 1
            v[f"{way}_bytes_{scope}"] += size
        v["seen"] |= flags
        if self.proto == 6:
            v["state"] = tcp.next_state_number(v["state"], flags, egress)
            if payload:
                if v["payload_ns"] is not None and v["payload_along"] != along:
                    wait = ts - v["payload_ns"]
                    v["wait_sum_ns"], v["waits"] = v["wait_sum_ns"] + wait, v["waits"] + 1
                    off = min(wait, 0xFFFFFFFF) - v["jitter_ns"]
                    v["jitter_ns"] += off // 16 if off >= 0 else -(-off // 16)
                v["payload_ns"], v["payload_along"] = ts, along
        v["last_ns"] = max(v["last_ns"], ts)


class FlowTracker(StatefulProcessor):
    """Keyed by flow (text, host included) and proto. State outlives a restart, and ends with the session."""

    def __init__(self, timeouts: Timeouts = Timeouts(), boot_ns: int = 0, state: str = STATE):
        self.timeouts, self.boot_ns, self.state = timeouts, boot_ns, state
        self.fields = [f.split()[0] for f in state.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", self.state)
        self.pending = handle.getListState("pending", PENDING)

    def _advance(self, key, rows: list[tuple], timer_values) -> pd.DataFrame:
        """Take the packets behind the watermark in their order; the others wait for it, and a timer for the next of either."""
        tracked = Tracked(self.flow.get(), key[1], self.timeouts, self.fields)
        limit = timer_values.getCurrentWatermarkInMs() * MS - self.boot_ns
        rows = sorted(rows)
        ready = bisect.bisect_left(rows, (limit,))
        out, waiting = [], rows[ready:]
        for ts, _, *packet in rows[:ready]:
            out += tracked.packet(key[0], ts, *packet)
        if tracked.v is not None and tracked.deadline() < limit:
            out.append(tracked.record(key[0], True))
            tracked.v = None
        moments = [waiting[0][0]] if waiting else []
        if tracked.v is None:
            self.flow.clear()
        else:
            self.flow.update(tracked.values())
            moments.append(tracked.deadline())
        if waiting:
            self.pending.put(waiting)
        else:
            self.pending.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if moments:
            self.handle.registerTimer((self.boot_ns + min(moments)) // MS + 1)
        return _table(out)

    def _waiting(self) -> list[tuple]:
        return [tuple(r) for r in self.pending.get()]

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        new = []
        for part in rows:
            columns = [part[c].tolist() for c in PENDING_FIELDS]
            new += zip(*columns)
        yield self._advance(key, self._waiting() + new, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield self._advance(key, self._waiting(), timerValues)

    def close(self) -> None:
        pass


def _table(records: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(records, columns=[f.split()[0] for f in RECORD.split(", ")])


def track(packets: DataFrame, boot_ns: int, place: str, delay: str = "10 seconds", timeouts: Timeouts = Timeouts(), state: str = STATE) -> DataFrame:
    """Flow records of a stream of packets; place orders packets of one ts_ns; boot_ns is wall time of ts_ns 0."""
    event = F.timestamp_micros(F.expr(f"(ts_ns + {boot_ns}) DIV 1000"))
    keyed_columns = with_key(packets)
    keyed = keyed_columns.withColumns({"event_time": event, "flow": F.concat_ws("|", *[F.hex(c) if c.endswith("ip") else F.col(c).cast("string") for c in observed_key(keyed_columns)]), "egress": F.col("direction") == "egress", "place": F.col(place).cast("long")})
    rows = keyed.withWatermark("event_time", delay).select("flow", "proto", "event_time", "ts_ns", "place", "len", "tcp_flags", "egress", "a_to_b", "has_payload")
    return rows.groupBy("flow", "proto").transformWithStateInPandas(FlowTracker(timeouts, boot_ns, state), outputStructType=RECORD, outputMode="append", timeMode="EventTime")


def new_flows(packets: DataFrame, boot_ns: int, delay: str = "10 seconds") -> DataFrame:
    """The first packet of every flow on a stream, host by host."""
    event = F.timestamp_micros(F.expr(f"(ts_ns + {boot_ns}) DIV 1000"))
    keyed = with_key(packets)
    return keyed.withColumn("event_time", event).withWatermark("event_time", delay).dropDuplicatesWithinWatermark(observed_key(keyed))


def late(packets: DataFrame, watermark_ns: int) -> tuple[DataFrame, DataFrame]:
    """Packets in time and packets behind a watermark, as a side table."""
    behind = F.col("ts_ns") < watermark_ns
    return packets.filter(~behind), packets.filter(behind)


def open_flows(spark: SparkSession, checkpoint: str, timeouts: Timeouts = Timeouts()) -> DataFrame:
    """The records of all flows that a stopped query still holds, from the state in its checkpoint: the final flush.

    Packets that wait for the watermark are taken first. With what the stream has written these are the records of the
    batch twin over the same packets.
    """
    read = lambda name: spark.read.format("statestore").option("stateVarName", name)
    key = ["key.flow", "key.proto"]
    held = read("flow").load(checkpoint).select(*key, "value.*")
    waiting = read("pending").option("flattenCollectionTypes", True).load(checkpoint).select(*key, "list_element.*")
    fields = [c for c in held.columns if c not in ("flow", "proto")]

    def finish(key: tuple, states: pd.DataFrame, packets: pd.DataFrame) -> pd.DataFrame:
        values = [None if pd.isna(v) else v for v in states.astype(object).iloc[0][fields]] if len(states) else None
        tracked, out = Tracked(values, int(key[1]), timeouts, fields), []
        for ts, _, *packet in sorted(zip(*[packets[c].tolist() for c in PENDING_FIELDS])):
            out += tracked.packet(key[0], ts, *packet)
        return _table([*out, tracked.record(key[0], True)])

    by = ("flow", "proto")
    return held.groupBy(*by).cogroup(waiting.groupBy(*by)).applyInPandas(finish, RECORD)
