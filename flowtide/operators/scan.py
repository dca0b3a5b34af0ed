"""The fold of a flow that never pauses, as an associative scan over chunks of it.

A chunk of packets is a function of the state before it. What packets do to that state comes down to little:
sessions are cut at pauses that depend on which of FIN and RST the session has shown (three cases); TCP states are
a map of eleven states to eleven; flags, sums and counts add up; waits need the payload packet before; jitter is
a step function of the jitter before. A chunk's function is found without its state, functions are applied one
after the other to give every chunk its state, and then all chunks are folded side by side.
"""

import pickle
from dataclasses import dataclass

import numpy as np

from ..functions import tcp
from ..functions.addresses import TCP

#: Values that jitter may still take when its steps are kept as a table.
STEPS = 64
MOST_JITTER = 0xFFFFFFFF


def jitter_after(jitter: int, wait: int) -> int:
    off = min(wait, MOST_JITTER) - jitter
    return jitter + (off // 16 if off >= 0 else -(-off // 16))


class Jitter:
    """What waits do to the jitter before them.

    Each wait moves jitter a sixteenth of the way, so whatever it was, after some four hundred waits it is one of few
    numbers: those waits are kept, and behind them a table of what becomes of each number.
    """

    def __init__(self):
        self.waits, self.low, self.high, self.table = [], 0, MOST_JITTER, None

    def add(self, waits: list[int]) -> None:
        for wait in waits:
            if self.table is None:
                self.waits.append(wait)
                self.low, self.high = jitter_after(self.low, wait), jitter_after(self.high, wait)
                if self.high - self.low < STEPS:
                    self.table = np.arange(self.low, self.high + 1)
            elif self.table[0] == self.table[-1]:  # steps never cross, so all between are equal too
                self.table[:] = jitter_after(int(self.table[0]), wait)
            else:
                off = min(wait, MOST_JITTER) - self.table
                self.table += np.where(off >= 0, off // 16, -(-off // 16))

    def __call__(self, jitter: int) -> int:
        for wait in self.waits:
            jitter = jitter_after(jitter, wait)
        return jitter if self.table is None else int(self.table[jitter - self.low])


@dataclass
class Summary:
    """A chunk as a function of the state before it."""

    first_ts: int
    first_along: bool
    packets: int
    last_ts: int
    #: By the class of flags seen before (0: neither, FIN, RST): the state after, where the chunk cuts a session inside.
    after: dict[int, dict | None]
    #: Where it doesn't: flags seen, map of states, first and last payload packet, sum and number of waits inside, jitter.
    flags: int
    states: tuple[int, ...]
    payload: tuple[tuple[int, bool], tuple[int, bool]] | None
    wait_sum: int
    waits: int
    jitter: Jitter

    def apply(self, before: dict, idle: int) -> dict:
        """The state after the chunk; idle is the pause that ends the session before it."""
        if self.first_ts - before["ts"] > idle:
            before = fresh(self.first_ts, self.first_along, before["place"])
        place = before["place"] + self.packets
        after = self.after[flag_class(before["seen"])]
        if after is not None:
            return after | {"place": place}
        out = before | {"ts": self.last_ts, "place": place, "seen": before["seen"] | self.flags, "state": self.states[before["state"]]}
        if self.payload is not None:
            (ts, along), last = self.payload
            jitter, total, n = before["jitter"], before["sum"], before["waits"]
            if before["payload"] is not None and bool(before["payload_along"]) != along:
                wait = ts - before["payload"]
                jitter, total, n = jitter_after(jitter, wait), total + wait, n + 1
            out |= {"jitter": self.jitter(jitter), "sum": total + self.wait_sum, "waits": n + self.waits, "payload": last[0], "payload_along": last[1]}
        return out


def fresh(ts: int, along: bool, place: int = -1) -> dict:
    """The state of a session that opens with a packet at ts, before that packet; places count from 0 in a run."""
    return {"ts": ts, "start": ts, "seen": 0, "state": 0, "jitter": 0, "sum": 0, "waits": 0, "first": along, "payload": None, "payload_along": None, "place": place}


def flag_class(seen: int) -> int:
    return tcp.RST if seen & tcp.RST else tcp.FIN if seen & tcp.FIN else 0


class Summarizer:
    """Makes a chunk's summary of its batches, which come in order.

    fold() makes a new fold with the state it is given; one runs for each class of flags, as long as they differ.
    """

    def __init__(self, fold, table: np.ndarray):
        self.fold, self.table, self.folds, self.cut, self.n = fold, table, {}, {}, 0
        self.flags, self.states = 0, list(range(table.shape[1]))
        self.payload, self.wait_sum, self.waits, self.jitter = None, 0, 0, Jitter()

    def batch(self, proto, ts, flags, egress, along, payload) -> None:
        if not self.n:
            self.first = (int(ts[0]), bool(along[0]))
            self.proto = int(proto[0])
            classes = (0, tcp.FIN, tcp.RST) if self.proto == TCP else (0,)
            self.folds = {c: self.fold(fresh(*self.first) | {"seen": c}) for c in classes}
            self.cut = dict.fromkeys(classes, False)
        for c, fold in self.folds.items():
            start = fold.last["start"]
            fold.batch(np.zeros(len(ts), bool), proto, ts, flags, egress, along, payload)
            self.cut[c] |= fold.last["start"] != start
        self.n += len(ts)
        self.last_ts = int(ts[-1])
        self.flags |= int(np.bitwise_or.reduce(flags)) & 255
        if self.proto != TCP:
            return
        codes = 2 * (flags & 255) + egress
        moving = codes[(self.table != np.arange(self.table.shape[1])).any(axis=1)[codes]]
        for code in moving.tolist():
            step = self.table[code]
            self.states = [int(step[s]) for s in self.states]
        spoke = np.flatnonzero(payload)
        if len(spoke):
            when, way = ts[spoke], along[spoke].astype(bool)
            if self.payload is not None:
                when, way = np.append(self.payload[1][0], when), np.append(self.payload[1][1], way)
            turned = way[1:] != way[:-1]
            waits = np.diff(when)[turned]
            self.wait_sum, self.waits = self.wait_sum + int(waits.sum()), self.waits + len(waits)
            self.jitter.add(waits.tolist())
            first = self.payload[0] if self.payload is not None else (int(when[0]), bool(way[0]))
            self.payload = (first, (int(when[-1]), bool(way[-1])))

    def summary(self) -> bytes:
        after = {c: dict(fold.last) if self.cut[c] else None for c, fold in self.folds.items()}
        after |= {c: after[0] for c in (tcp.FIN, tcp.RST) if c not in after}
        return pickle.dumps(Summary(*self.first, self.n, self.last_ts, after, self.flags, tuple(self.states), self.payload, self.wait_sum, self.waits, self.jitter))


def loads(summary: bytes) -> Summary:
    return pickle.loads(summary)
