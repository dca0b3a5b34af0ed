"""TCP flags and the connection state machine as expressions."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import STATES

FIN, SYN, RST, PSH, ACK = 1, 2, 4, 8, 16
_NUMBER = {name: number for number, name in STATES.items()}

#: What opens a connection: (flags that are set, flags that are not, direction or None, next state), first fit wins.
OPENING = [
    (RST, 0, None, "closed"),
    (FIN, 0, "egress", "fin_wait_1"),
    (FIN, 0, "ingress", "close_wait"),
    (SYN, ACK, "egress", "syn_sent"),
    (SYN, ACK, "ingress", "syn_received"),
    (SYN | ACK, 0, "egress", "syn_received"),
    (SYN | ACK, 0, "ingress", "established"),
    (ACK, SYN, None, "established"),
]
#: What closes one: state before, then as above.
CLOSING = [
    ("established", FIN, 0, "egress", "fin_wait_1"),
    ("established", FIN, 0, "ingress", "close_wait"),
    ("fin_wait_1", FIN | ACK, 0, "ingress", "time_wait"),
    ("fin_wait_1", FIN, ACK, "ingress", "closing"),
    ("fin_wait_1", ACK, FIN, "ingress", "fin_wait_2"),
    ("fin_wait_2", FIN, 0, "ingress", "time_wait"),
    ("closing", ACK, 0, "ingress", "time_wait"),
    ("close_wait", FIN, 0, "egress", "last_ack"),
    ("last_ack", ACK, 0, "ingress", "closed"),
]
EARLY = ("closed", "syn_sent", "syn_received")


def has(flags: Column, bits: int) -> Column:
    return flags.bitwiseAND(F.lit(bits)) == bits


def next_state(state: Column, flags: Column, egress: Column) -> Column:
    """The state's number after a packet; egress is whether the observing host sent it."""

    def fits(on: int, off: int, direction: str | None) -> Column:
        one = flags.bitwiseAND(F.lit(on | off)) == on
        return one if direction is None else one & (egress if direction == "egress" else ~egress)

    early = state.isin(*[_NUMBER[s] for s in EARLY])
    out = F.when(early & fits(*OPENING[0][:3]), _NUMBER[OPENING[0][3]])
    for on, off, direction, after in OPENING[1:]:
        out = out.when(early & fits(on, off, direction), _NUMBER[after])
    out = out.when(~early & (state != _NUMBER["listen"]) & fits(RST, 0, None), _NUMBER["closed"])
    for before, on, off, direction, after in CLOSING:
        out = out.when((state == _NUMBER[before]) & fits(on, off, direction), _NUMBER[after])
    return out.otherwise(state)


def next_state_sql(state: str, flags: str, egress: str) -> str:
    def fits(on: int, off: int, direction: str | None) -> str:
        one = f"({flags} & {on | off}) = {on}"
        return one if direction is None else f"{one} AND {'' if direction == 'egress' else 'NOT '}{egress}"

    early = f"{state} IN ({', '.join(str(_NUMBER[s]) for s in EARLY)})"
    cases = [f"WHEN {early} AND {fits(on, off, d)} THEN {_NUMBER[after]}" for on, off, d, after in OPENING]
    cases.append(f"WHEN NOT {early} AND {state} <> {_NUMBER['listen']} AND {fits(RST, 0, None)} THEN {_NUMBER['closed']}")
    cases += [f"WHEN {state} = {_NUMBER[before]} AND {fits(on, off, d)} THEN {_NUMBER[after]}" for before, on, off, d, after in CLOSING]
    return "CASE " + " ".join(cases) + f" ELSE {state} END"


def next_state_number(state: int, flags: int, egress: bool) -> int:
    """The same step for one packet, for state kept in Python."""
    direction = "egress" if egress else "ingress"
    name = STATES[state]
    rules = [(None, *r) for r in OPENING] if name in EARLY else [] if name == "listen" else [(None, RST, 0, None, "closed"), *CLOSING]
    for before, on, off, needs, after in rules:
        if before in (None, name) and flags & (on | off) == on and needs in (None, direction):
            return _NUMBER[after]
    return state


def next_states() -> np.ndarray:
    """The same step for all packets: a row for each 2 * flags + egress, a column for each state."""
    return np.array([[next_state_number(state, flags, bool(egress)) for state in range(len(STATES))] for flags in range(256) for egress in (0, 1)])
