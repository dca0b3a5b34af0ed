"""Flow filters: rules of items to match and not to match, compiled to one boolean column.

keep = no item of not_match fits, and one of match does unless match is empty. Scopes and fields are
conjoined; a filter that can't be evaluated (null) keeps the flow. Items that aren't valid for their field
are skipped. Static fields can filter packets early, where predicates reach the scan.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .asof import as_of
from ..functions import names
from ..functions.addresses import ICMP, ICMPV6, TCP, in_networks


@dataclass(frozen=True)
class Rule:
    match: list[str] = field(default_factory=list)
    not_match: list[str] = field(default_factory=list)

    def keep(self, fits) -> Column:
        """fits(items) is whether any of the items fits the row."""
        out = ~fits(self.not_match) if self.not_match else F.lit(True)
        return out & fits(self.match) if self.match else out


def glob_regex(pattern: str) -> str:
    """A glob (*, ?, [a-z], [!a], {a,b}) as an anchored regular expression; a broken one stands for itself."""
    out, depth, i = "", 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]"
            i = end
        elif c == "{" and "}" in pattern[i:]:
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += {"*": ".*", "?": "."}.get(c) or re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def globs(text: Column, items: list[str]) -> Column:
    found = F.lit(False)
    for item in items:
        found = found | F.lower(text).rlike(glob_regex(item.lower()))
    return found


def numbers(value: Column, items: list[str]) -> Column:
    """Numbers and inclusive ranges a-b."""
    found = F.lit(False)
    for item in items:
        if m := re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", item):
            low, high = int(m[1]), int(m[2] or m[1])
            if low <= high:
                found = found | value.between(low, high)
    return found


def tags(present: Column, items: list[str]) -> Column:
    return F.arrays_overlap(present, F.array(*[F.lit(i.lower()) for i in items]))


#: Fields that filters may name: the kind of test, the column, and a guard by protocol or version.
FIELDS = {
    "source_address": (in_networks, lambda: F.col("src_ip"), None),
    "destination_address": (in_networks, lambda: F.col("dst_ip"), None),
    "source_port": (numbers, lambda: F.col("src_port"), None),
    "destination_port": (numbers, lambda: F.col("dst_port"), None),
    "network_transport": (globs, lambda: names.protocol_name(F.col("proto")), None),
    "network_type": (globs, lambda: F.when(F.octet_length("src_ip") == 4, "ipv4").when(F.octet_length("src_ip") == 16, "ipv6"), None),
    "network_interface_index": (numbers, lambda: F.col("ifindex"), None),
    "network_interface_name": (globs, lambda: F.col("interface_name"), None),
    "network_interface_mac": (globs, lambda: F.col("src_mac"), None),
    "flow_ip_dscp_name": (globs, lambda: names.dscp_name(F.col("dscp"), on_span=False), None),
    "flow_ip_ecn_name": (globs, lambda: names.ecn_name(F.col("ecn"), on_span=False), None),
    "flow_ip_ttl": (numbers, lambda: F.col("ttl"), None),
    "flow_ip_flow_label": (numbers, lambda: F.col("flow_label"), lambda: F.octet_length("src_ip") == 16),
    "flow_icmp_type_name": (globs, lambda: F.col("icmp_type_name"), lambda: F.col("proto").isin(ICMP, ICMPV6)),
    "flow_icmp_code_name": (globs, lambda: F.col("icmp_code_name"), lambda: F.col("proto").isin(ICMP, ICMPV6)),
    "flow_tcp_flags_tags": (tags, lambda: names.flag_tags(F.col("tcp_flags")), lambda: F.col("proto") == TCP),
    "flow_connection_state": (globs, lambda: F.col("state"), lambda: F.col("proto") == TCP),
}
#: Fields for which a row without a value is dropped.
NEEDED = ("network_type", "network_interface_name")


def condition(rules: dict[str, Rule]) -> Column:
    keep = F.lit(True)
    for name, rule in rules.items():
        test, column, guard = FIELDS[name]
        one = rule.keep(lambda items: test(column(), items))  # noqa: B023
        one = F.coalesce(one, F.lit(name not in NEEDED))
        keep = keep & (one if guard is None else ~guard() | one)
    return keep


def filter_flows(rows: DataFrame, rules: dict[str, Rule]) -> DataFrame:
    return rows.filter(condition(rules))


def with_interface(rows: DataFrame, interfaces: DataFrame, missing: str | None = None) -> DataFrame:
    """Adds interface_name by ifindex; `missing` (say, unknown) where there is none."""
    named = rows.join(interfaces.select("ifindex", "interface_name"), "ifindex", "left")
    return named if missing is None else named.fillna(missing, ["interface_name"])


def interface_at(rows: DataFrame, changes: DataFrame, by: tuple[str, ...] = ("ifindex",), at: str = "ts_ns", missing: str | None = "unknown") -> DataFrame:
    """Adds interface_name as it was at a row's moment: changes have by, ts_ns, event (add or remove) and interface_name.

    Before its first add, and after a remove, an interface is `missing`.
    """
    named = changes.select(*by, F.col("ts_ns").alias("__since"), F.when(F.col("event") == "add", F.col("interface_name")).alias("interface_name"))
    known = as_of(rows, named, list(by), at, "__since", ["interface_name"])
    return known if missing is None else known.fillna(missing, ["interface_name"])


def interfaces_matching(interfaces: DataFrame, patterns: list[str]) -> DataFrame:
    """Distinct interface names that fit a glob; patterns over 256 characters are refused."""
    return interfaces.filter(globs(F.col("interface_name"), [p for p in patterns if len(p) <= 256])).select("interface_name").distinct()
