"""Attribution of flows to objects of a cluster: by address and time, owners, containers, processes, policies.

The history of an address is cut into intervals in which the same objects are on it (`timeline`), each with those
of the best kind. A flow takes one join on its address and finds its interval there by binary search. Where
addresses have histories of very many owners, they can be dealt into pages of ``PAGE`` intervals, at the cost of another
join. A hot address is split by AQE like any skewed key. Spark broadcasts the index where its measured size allows.
"""

import heapq
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import selectors
from ..functions import networks
from ..functions.tables import written

#: Order of preference among objects of one address.
PREFERENCE = {"Pod": 0, "Service": 1, "Node": 2, "EndpointSlice": 3}
FOREVER = (1 << 63) - 1


def ip_index(*objects: DataFrame) -> DataFrame:
    """One row an address and object: ip, kind, namespace, name, uid, host_network, valid_from, valid_to, ports."""
    wanted = {"namespace": "string", "uid": "string", "host_network": "boolean", "valid_from": "long", "valid_to": "long", "ports": "array<struct<protocol: string, port: int>>"}
    parts = []
    for df in objects:
        if df.schema["ips"].dataType.elementType.typeName() != "binary":
            raise TypeError("addresses must be binary, as flows have them: see inventory.objects for addresses as text")
        if "deleting" in df.columns:
            df = df.filter(~F.col("deleting"))
        df = df.withColumns({c: F.lit(None).cast(t) for c, t in wanted.items() if c not in df.columns})
        parts.append(df.select(F.explode("ips").alias("ip"), "kind", "name", *wanted))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    out = out.withColumns({"valid_from": F.coalesce("valid_from", F.lit(0)), "valid_to": F.coalesce("valid_to", F.lit(FOREVER)), "host_network": F.coalesce("host_network", F.lit(False))})
    return out.dropDuplicates(["ip", "kind", "namespace", "name", "uid", "valid_from"])


#: Intervals of a page.
PAGE = 1024
_BEST = "namespace: string, name: string, kind: string, uid: string, ports: array<struct<protocol: string, port: int>>"
FIELDS = ("namespace", "name", "kind", "uid", "ports")
_INTERVAL = f"start: bigint, end: bigint, best: array<struct<{_BEST}>>"


class Sweep:
    """The objects on one address as time goes on; who is over leaves, and what is best is said for every interval."""

    def __init__(self):
        self.ends, self.on, self.at, self.held, self.number = [], {}, 0, None, 0

    def _best(self) -> list[dict]:
        objects = self.on.values()
        if any(o["kind"] == "Node" for o in objects):  # a node's address: host-network pods and nodes count
            objects = [o for o in objects if o["kind"] == "Node" or o["kind"] == "Pod" and o["host_network"]]
        rank = min((o["rank"] for o in objects), default=None)
        first = lambda o: (o["namespace"] or "", o["name"] or "", o["kind"], o["uid"] or "")
        out, taken = [], set()
        for o in sorted((o for o in objects if o["rank"] == rank), key=first):
            own = {((p["protocol"] or "TCP").upper(), p["port"]) for p in o["ports"] or () if p}
            if not out or own - taken:  # others are behind these for every port
                out.append({f: o[f] for f in FIELDS})
                taken |= own
        return out

    def _until(self, end: int):
        """What was from the last moment to this one; equal neighbours become one interval."""
        if end > self.at and self.on:
            best = self._best()
            if self.held and self.held["end"] == self.at and self.held["best"] == best:
                self.held["end"] = end
            else:
                yield from self._out()
                self.held = {"start": self.at, "end": end, "best": best}
        self.at = end

    def _out(self):
        if self.held:
            yield self.held
            self.held = None

    def _leave(self, moment: int):
        while self.ends and self.ends[0][0] <= moment:
            yield from self._until(self.ends[0][0])
            self.on.pop(heapq.heappop(self.ends)[1])

    def enter(self, row: dict):
        yield from self._leave(row["valid_from"])
        yield from self._until(row["valid_from"])
        if row["valid_to"] > row["valid_from"]:
            self.number += 1
            self.on[self.number] = row
            heapq.heappush(self.ends, (row["valid_to"], self.number))

    def close(self):
        yield from self._leave(FOREVER)
        yield from self._out()


def _alone(rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Intervals of objects that are the only ones of their addresses."""
    rows = rows.filter(pc.greater(rows.column("valid_to"), rows.column("valid_from")))
    kind = schema.field("best").type.value_type
    fields = [rows.column(f.name).cast(f.type) for f in kind]
    best = pa.ListArray.from_arrays(pa.array(np.arange(rows.num_rows + 1, dtype=np.int32)), pa.StructArray.from_arrays(fields, fields=list(kind)))
    columns = [rows.column("ip"), pa.array(np.zeros(rows.num_rows, np.int64)), rows.column("valid_from"), rows.column("valid_to"), best]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def timeline(index: DataFrame) -> DataFrame:
    """(ip, number, start, end, best): disjoint intervals of each address with their objects of the best kind, by name.

    Of those the first, and the first of each port: so many host-network pods of a node's address are a few in its
    intervals, which each flow of the address gets. A sweep over objects sorted by address and time; what is held is
    what is on an address at one moment. Whether an address is a node's is asked for each interval. Most addresses
    have one object, which is its own interval, and take no sweep.
    """
    rank = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in PREFERENCE.items()], F.lit(9))
    rows = index.filter("ip IS NOT NULL").select("ip", "valid_from", "valid_to", rank.alias("rank"), "namespace", "name", "kind", "uid", "host_network", "ports")
    rows = rows.repartition("ip").sortWithinPartitions("ip", "valid_from")

    def task(batches):
        sweep, ip, number, before = Sweep(), None, 0, None

        def numbered(intervals):
            nonlocal number
            for x in intervals:
                yield {"ip": ip, "number": number, **x}
                number += 1

        for batch in batches:
            if not batch.num_rows:
                continue
            address = batch.column("ip")
            new = np.append(True, pc.not_equal(address[1:], address[:-1]).to_numpy(zero_copy_only=False))
            # The first and the last row may have others of their address in the batches beside.
            alone = new & np.append(new[1:], False)
            alone[0] &= before is None or address[0].as_py() != before
            before = address[-1].as_py()
            yield _alone(batch.filter(pa.array(alone)), arrow)
            out = []
            for row in batch.filter(pa.array(~alone)).to_pylist():
                if row["ip"] != ip:
                    out += numbered(sweep.close())
                    sweep, ip, number = Sweep(), row["ip"], 0
                out += numbered(sweep.enter(row))
            yield pa.RecordBatch.from_pylist(out, schema=arrow)
        yield pa.RecordBatch.from_pylist([*numbered(sweep.close())], schema=arrow)

    port = pa.list_(pa.struct([("protocol", pa.string()), ("port", pa.int32())]))
    best = pa.list_(pa.struct([*[(c, pa.string()) for c in ("namespace", "name", "kind", "uid")], ("ports", port)]))
    arrow = pa.schema([("ip", pa.binary()), ("number", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("best", best)])
    return rows.mapInArrow(task, f"ip binary, number bigint, {_INTERVAL.replace(': bigint', ' bigint').replace('best: ', 'best ')}")


def histories(intervals: DataFrame) -> DataFrame:
    """(ip, items): all intervals of an address in their order."""
    return intervals.groupBy("ip").agg(F.array_sort(F.collect_list(F.struct("start", "end", "best"))).alias("items"))


def pages(intervals: DataFrame, page: int = PAGE) -> tuple[DataFrame, DataFrame]:
    """(ip, items, starts): an address's first page of intervals and where its other pages start; (ip, page, items)."""
    item = F.struct("start", "end", "best")
    first = F.array_sort(F.collect_list(F.when(F.col("number") < page, item)))
    starts = F.array_sort(F.collect_list(F.when((F.col("number") % page == 0), F.col("start"))))
    roots = intervals.groupBy("ip").agg(first.alias("items"), starts.alias("starts"))
    numbered = intervals.filter(F.col("number") >= page).withColumn("page", F.expr(f"number DIV {page}"))
    return roots, numbered.groupBy("ip", "page").agg(F.array_sort(F.collect_list(item)).alias("items"))


def last_start(starts: Column, at: Column, most: int) -> Column:
    """Place (from 0) of the last start that isn't after at, in a sorted array of at most `most`; -1 if there is none."""
    steps = [1 << k for k in range(max(1, most).bit_length() - 1, -1, -1)]
    later = lambda place, step: F.when(F.coalesce(F.get(starts, place + step) <= at, F.lit(False)), place + step).otherwise(place)
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(-1), later)


def attribute(flows: DataFrame, known: DataFrame | tuple[DataFrame, DataFrame], side: str, at: str, page: int = PAGE) -> DataFrame:
    """Adds <side>_kind, _namespace, _name and _uid of the object on the side's address at the time; null if none.

    known is what histories or pages made. The address and the order of kinds decide; among objects of the best kind, one that has the flow's port
    and protocol goes first, where objects have ports.
    """
    moment, most = F.col(at), 1 << 24
    if isinstance(known, tuple):
        roots, others = known
        roots, most = roots.select(F.col("ip").alias(f"{side}_ip"), F.col("items").alias("__i"), F.col("starts").alias("__s")), page
        number = F.when(F.size("__s") > 1, last_start(F.col("__s"), moment, 1 << 20))
        joined = flows.join(roots, f"{side}_ip", "left").withColumn("__page", number).drop("__s")
        others = others.select(F.col("ip").alias(f"{side}_ip"), F.col("page").alias("__page"), F.col("items").alias("__j"))
        joined = joined.join(others, [f"{side}_ip", "__page"], "left").withColumn("__i", F.coalesce("__j", "__i")).drop("__page", "__j")
    else:
        joined = flows.join(known.select(F.col("ip").alias(f"{side}_ip"), F.col("items").alias("__i")), f"{side}_ip", "left")
    alone = F.when(F.size("__i") == 1, 0).otherwise(last_start(F.col("__i.start"), moment, most))
    joined = joined.withColumn("__x", F.get("__i", alone))
    there = F.when((F.col("__x.start") <= moment) & (moment < F.col("__x.end")), F.col("__x.best"))
    joined = joined.withColumn("__c", there)
    best = F.get("__c", F.lit(0))
    if {"proto", f"{side}_port"} <= set(flows.columns):
        protocol = F.when(F.col("proto") == 6, "TCP").when(F.col("proto") == 17, "UDP").when(F.col("proto") == 132, "SCTP")
        own = lambda p: (F.upper(F.coalesce(p["protocol"], F.lit("TCP"))) == protocol) & (p["port"] == F.col(f"{side}_port"))
        fits = F.filter("__c", lambda x: F.coalesce(F.exists(x["ports"], own), F.lit(False)))
        best = F.when(F.size("__c") == 1, best).otherwise(F.coalesce(F.get(fits, F.lit(0)), best))
    added = {f"{side}_{c}": F.col(f"__b.{c}") for c in ("kind", "namespace", "name", "uid")}
    return joined.withColumn("__b", best).withColumns(added).drop("__b", "__c", "__i", "__x")


def decorate(flows: DataFrame, index: DataFrame, at: str, paged: bool = False) -> DataFrame:
    """Both sides, and decorator_status: no flow is dropped for want of an object.

    A history is one row an address, or with paged one a page of it. Intervals are written once, as both sides read them.
    """
    intervals = written(timeline(index), "intervals")
    known = pages(intervals) if paged else histories(intervals)
    both = attribute(attribute(flows, known, "src", at), known, "dst", at)
    found = F.col("src_kind").isNotNull().cast("int") + F.col("dst_kind").isNotNull().cast("int")
    return both.withColumn("decorator_status", F.when(found == 2, "ok").when(found == 1, "partial").otherwise("undecorated"))


def _owned(df: DataFrame, *columns: str) -> DataFrame:
    """columns, owner_kind and owner_name: a row for each owner of each object, from owner_refs or one pair of columns."""
    if "owner_refs" in df.columns:
        made = df.select(*columns, F.explode(F.array_distinct("owner_refs")).alias("owner"))
        return made.select(*[c for c in made.columns if c != "owner"], F.col("owner.kind").alias("owner_kind"), F.col("owner.name").alias("owner_name"))
    return df.select(*columns, "owner_kind", "owner_name").filter("owner_kind IS NOT NULL")


def owner_chain(pods: DataFrame, objects: DataFrame, include=(), exclude=(), depth: int = 5, most: int = 32) -> DataFrame:
    """(namespace, pod, depth, kind, name) of owners up the chain; exclusion wins, kinds compare without case.

    Objects have owner_refs (several owners) or owner_kind and owner_name (one). A pod has `most` owners at
    most, the nearest first.
    """
    step = _owned(pods, "namespace", F.col("name").alias("pod")).select("namespace", "pod", F.lit(1).alias("depth"), F.col("owner_kind").alias("kind"), F.col("owner_name").alias("name"))
    parents = _owned(objects, "namespace", "kind", "name")
    several = "owner_refs" in pods.columns or "owner_refs" in objects.columns
    levels = []
    for level in range(1, depth + 1):
        levels.append(step)
        up = step.join(parents, ["namespace", "kind", "name"])
        up = up.dropDuplicates(["namespace", "pod", "owner_kind", "owner_name"]) if several else up
        step = up.select("namespace", "pod", F.lit(level + 1).alias("depth"), F.col("owner_kind").alias("kind"), F.col("owner_name").alias("name"))
    out = levels[0]
    for one in levels[1:]:
        out = out.unionAll(one)
    lower = [F.lower("kind").isin([k.lower() for k in kinds]) for kinds in (include, exclude)]
    keep = (lower[0] if include else F.lit(True)) & (~lower[1] if exclude else F.lit(True))
    out = out.filter(keep)
    if not several:  # one owner a level, so depth bounds the number as well
        return out.filter(F.col("depth") <= most)
    nearest = Window.partitionBy("namespace", "pod").orderBy("depth", "kind", "name")
    return out.withColumn("place", F.row_number().over(nearest)).filter(F.col("place") <= most).drop("place")


def container_at(pods: DataFrame, flows: DataFrame, side: str) -> DataFrame:
    """Adds <side>_container and _image: the pod's first container with the side's port and an image."""
    found = pods.select(F.col("namespace").alias(f"{side}_namespace"), F.col("name").alias(f"{side}_name"), F.lit("Pod").alias(f"{side}_kind"), F.col("containers").alias("__c"))
    joined = flows.join(found, [f"{side}_kind", f"{side}_namespace", f"{side}_name"], "left")
    first = F.try_element_at(F.filter("__c", lambda c: (c["port"] == F.col(f"{side}_port")) & c["image"].isNotNull()), F.lit(1))
    return joined.withColumns({f"{side}_container": first["name"], f"{side}_image": first["image"]}).drop("__c")


def with_process(flows: DataFrame, events: DataFrame, key: list[str]) -> DataFrame:
    """Adds pid and comm of the first process event of the flow's key inside its lifetime; pid 0 is unknown."""
    known = flows.select(*key, "first_ns", "last_ns").join(events.filter("pid <> 0"), key).filter("event_ns BETWEEN first_ns AND last_ns")
    first = known.groupBy(*key, "first_ns").agg(F.min_by(F.struct("pid", "comm"), F.struct("event_ns", "pid", "comm")).alias("__p"))
    return flows.join(first, [*key, "first_ns"], "left").withColumns({"pid": F.col("__p.pid"), "comm": F.col("__p.comm")}).drop("__p")


def orphans(snapshots: DataFrame, tracked: DataFrame, key: list[str], now: Column | int, record_ns: int) -> DataFrame:
    """Keys with counters older than four record intervals that nothing tracks; now may be a scalar subquery."""
    return snapshots.filter(F.col("last_ns") < now - 4 * record_ns).join(tracked.select(*key).distinct(), key, "left_anti")


def utilisation(keys: DataFrame, capacity: int, alert: float = 80.0) -> DataFrame:
    percent = F.count("*") * 100.0 / capacity
    return keys.agg(F.count("*").alias("used"), percent.alias("percent"), (percent >= alert).alias("alert"))


def extract(df: DataFrame, rules: list[str], fields: dict[str, str]) -> DataFrame:
    """Only the metadata that rules name: a field kind.metadata.name stays for that rule or [*].metadata.name."""
    kept = []
    for path, column in fields.items():
        if path in rules or "[*]." + path.partition(".")[2] in rules:
            kept.append(column)
    return df.drop(*[c for c in fields.values() if c not in kept])


def _block_key(p: Column) -> Column:
    """A block with its exceptions as text."""
    outside = F.coalesce(F.transform(p["excepted"], lambda x: F.concat(F.hex(x["low"]), F.lit("-"), F.hex(x["high"]))), F.array().cast("array<string>"))
    return F.concat(F.hex(p["low"]), F.lit("-"), F.hex(p["high"]), F.lit("!"), F.array_join(F.array_sort(outside), ","))


def _port_key(p: Column) -> Column:
    return F.concat_ws(":", F.lower(F.coalesce(p["protocol"], F.lit("TCP"))), p["port"], F.coalesce(p["end_port"], p["port"]))


def _permits(ports: Column, protocol: Column, classes: Column, names: Column) -> Column:
    """classes: the keys of ports that the flow's port and protocol fit; names: those of the target's port."""

    def one(p: Column) -> Column:
        own = F.lower(F.coalesce(p["protocol"], F.lit("TCP"))) == protocol
        number = F.when(p["port_name"].isNotNull(), own & F.array_contains(names, p["port_name"])).when(p["port"].isNull(), own)
        return F.coalesce(number.otherwise(F.array_contains(classes, _port_key(p))), F.lit(False))

    return (F.size(ports) == 0) | F.exists(ports, one)


def _peer(peers: Column, blocks: Column, labels: Column, namespace: Column, namespace_labels: Column, own_namespace: Column) -> Column:
    """blocks: the keys of blocks that hold the peer's address."""

    def one(p: Column) -> Column:
        pod = p["pod_selector"].isNull() | (labels.isNotNull() & selectors.matches(labels, p["pod_selector"]))
        space = F.when(p["namespace_selector"].isNull(), namespace == own_namespace).otherwise(namespace_labels.isNotNull() & selectors.matches(namespace_labels, p["namespace_selector"]))
        return F.coalesce(F.when(p["low"].isNotNull(), F.array_contains(blocks, _block_key(p))).otherwise(pod & space), F.lit(False))

    return (F.size(peers) == 0) | F.exists(peers, one)


#: Blocks, and numbered ports, of policies that are tested in the row; more of them are found by joins.
MOST_INLINE = 64


def _blocks(rules: DataFrame) -> DataFrame:
    """(key, low, high, excepted) of the blocks of rules' peers."""
    peers = rules.select(F.explode("peers").alias("p")).filter("p.low IS NOT NULL AND octet_length(p.low) > 0")
    return peers.select(_block_key(F.col("p")).alias("key"), "p.low", "p.high", "p.excepted").dropDuplicates(["key"])


def _ports(rules: DataFrame) -> DataFrame:
    """(key, protocol, port, end) of the numbered ports of rules."""
    ports = rules.select(F.explode("ports").alias("p")).filter("p.port IS NOT NULL AND p.port_name IS NULL")
    end = F.least(F.coalesce("p.end_port", "p.port"), F.lit(65535)).alias("end")
    return ports.select(_port_key(F.col("p")).alias("key"), F.lower(F.coalesce("p.protocol", F.lit("TCP"))).alias("protocol"), "p.port", end).dropDuplicates(["key"])


def _keys_that(tests: list[tuple[str, Column]]) -> Column:
    """Sorted keys whose tests hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(test, key) for key, test in tests]))) if tests else F.array().cast("array<string>")


def _with_blocks(flows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds __src_blocks and __dst_blocks: keys of the blocks that hold either address.

    A few blocks are tested in the row; many are CIDR blocks that addresses meet by their prefixes.
    """
    few = blocks.limit(MOST_INLINE + 1).collect()
    inside = lambda ip, x: (F.octet_length(ip) == len(x["low"])) & ip.between(F.lit(x["low"]), F.lit(x["high"]))
    if len(few) <= MOST_INLINE:
        holds = lambda ip, x: reduce(lambda a, e: a & ~inside(ip, e), x["excepted"] or [], inside(ip, x))
        return flows.withColumns({f"__{side}_blocks": _keys_that([(x["key"], holds(F.col(f"{side}_ip"), x)) for x in few]) for side in ("src", "dst")})
    same = F.length(F.regexp_extract(F.concat(networks.bits(F.col("low")), F.lit("/"), networks.bits(F.col("high"))), "^([01]*)[01]*/\\1[01]*$", 1))
    table = blocks.withColumns({"version": F.when(F.octet_length("low") == 4, 4).otherwise(6), "length": same}).withColumn("prefix", F.substring(networks.bits(F.col("low")), F.lit(1), F.col("length")))
    met = networks.matches(flows.select(F.explode(F.array("src_ip", "dst_ip")).alias("ip")).filter("ip IS NOT NULL").distinct(), table)
    holds = F.col("ip").between(F.col("low"), F.col("high")) & ~F.exists(F.coalesce("excepted", F.array().cast("array<struct<low: binary, high: binary>>")), lambda x: F.col("ip").between(x["low"], x["high"]))
    held = met.filter(holds).groupBy("ip").agg(F.sort_array(F.collect_set("key")).alias("blocks"))
    for side in ("src", "dst"):
        flows = flows.join(held.select(F.col("ip").alias(f"{side}_ip"), F.col("blocks").alias(f"__{side}_blocks")), f"{side}_ip", "left")
    return flows


def _with_ports(flows: DataFrame, ports: DataFrame) -> DataFrame:
    """Adds __ports: keys of the numbered ports that a flow's protocol and destination port fit; by a join of at most 65,536 rows a protocol where there are many."""
    few = ports.limit(MOST_INLINE + 1).collect()
    if len(few) <= MOST_INLINE:
        return flows.withColumn("__ports", _keys_that([(x["key"], (F.col("__protocol") == x["protocol"]) & F.col("dst_port").between(x["port"], x["end"])) for x in few]))
    each = ports.filter("port <= end").select(F.col("protocol").alias("__protocol"), "key", F.explode(F.sequence("port", "end")).alias("dst_port"))
    return flows.join(each.groupBy("__protocol", "dst_port").agg(F.sort_array(F.collect_set("key")).alias("__ports")), ["__protocol", "dst_port"], "left")


def permitting_rules(flows: DataFrame, pods: DataFrame, namespaces: DataFrame, policies: DataFrame, what: Column) -> DataFrame:
    """Adds egress and ingress: arrays of `what`, one value for each set of like policies with a rule that permits the flow.

    Egress is judged on the source pod, ingress on the destination pod. Policies of one namespace that have
    one selector and the same rules are judged once; `what` aggregates them (columns namespace and policy).
    Which of them select a pod comes from an index of what selectors ask, once for each set of labels. Flows are
    judged once for each case: label sets and namespaces of both sides, the policies' blocks that hold either address
    (CIDR blocks, found by their prefixes), the policies' ports that the flow's port fits, and its name. Flows with
    their label sets are written once, as their addresses, their cases and they themselves are read from them.
    """
    spaces = namespaces.select(F.col("name").alias("namespace"), F.col("labels").alias("namespace_labels"))
    marked, _ = selectors.with_selector_id(policies.select("namespace", F.col("name").alias("policy"), "pod_selector", "rules"), F.col("pod_selector"))
    like = marked.withColumn("like", F.to_json("rules")).groupBy("namespace", "selector_id", "like").agg(F.any_value("rules").alias("rules"), F.any_value("pod_selector").alias("selector"), what.alias("what"))
    like = written(like, "like")  # policies may be text that is parsed, and are asked for four times
    chosen = like.groupBy("namespace", "selector_id").agg(F.any_value("selector").alias("selector"))
    info, sets = selectors.label_sets(pods.select("namespace", "name", "labels", "containers"))
    for side in ("src", "dst"):
        columns = [F.col("label_set").alias(f"{side}_set"), *([F.col("containers").alias("__containers")] if side == "dst" else [])]
        mine = info.select(*columns, F.lit("Pod").alias(f"{side}_kind"), F.col("namespace").alias(f"{side}_namespace"), F.col("name").alias(f"{side}_name"))
        flows = flows.join(mine, [f"{side}_kind", f"{side}_namespace", f"{side}_name"], "left")
    named = F.filter("__containers", lambda c: (c["port"] == F.col("dst_port")) & c["port_name"].isNotNull())
    none = F.array().cast("array<string>")
    protocol = F.when(F.col("proto") == 6, "tcp").when(F.col("proto") == 17, "udp").when(F.col("proto") == 132, "sctp")
    flows = flows.withColumns({"__protocol": protocol, "__names": F.coalesce(F.array_sort(F.transform(named, lambda c: c["port_name"])), none)}).drop("__containers")
    flows = written(flows, "flows")
    per_set = written(selectors.select_sets(sets, chosen).join(like, ["namespace", "selector_id"]).select("namespace", "label_set", "rules", "what"), "policies")
    rules = like.select(F.explode("rules").alias("r")).select("r.peers", "r.ports")
    flows = _with_ports(_with_blocks(flows, _blocks(rules)), _ports(rules))
    case = ["src_namespace", "src_set", "__src_blocks", "dst_namespace", "dst_set", "__dst_blocks", "__protocol", "__ports", "__names"]
    cases, judged = flows.select(case).distinct(), []
    for way, own, peer in (("egress", "src", "dst"), ("ingress", "dst", "src")):
        mine = per_set.select(F.col("namespace").alias(f"{own}_namespace"), F.col("label_set").alias(f"{own}_set"), "rules", "what")
        theirs = sets.join(spaces, "namespace", "left").select(F.col("namespace").alias(f"{peer}_namespace"), F.col("label_set").alias(f"{peer}_set"), F.col("labels").alias("__labels"), "namespace_labels")
        asked = cases.join(theirs, [f"{peer}_namespace", f"{peer}_set"], "left").join(mine, [f"{own}_namespace", f"{own}_set"])

        def permits(r: Column) -> Column:
            met = _peer(r["peers"], F.coalesce(f"__{peer}_blocks", none), F.col("__labels"), F.col(f"{peer}_namespace"), F.col("namespace_labels"), F.col(f"{own}_namespace"))  # noqa: B023
            return (r["way"] == way) & met & F.coalesce(_permits(r["ports"], F.col("__protocol"), F.coalesce("__ports", none), F.col("__names")), F.lit(False))  # noqa: B023

        judged.append(asked.filter(F.exists("rules", permits)).select(*case, F.lit(way).alias("__way"), "what"))
    of = lambda way: F.collect_list(F.when(F.col("__way") == way, F.col("what"))).alias(way)
    found = judged[0].unionAll(judged[1]).groupBy(case).agg(of("egress"), of("ingress"))
    other = found.select(*[F.col(c).alias(f"{c}__") for c in case], "egress", "ingress")
    same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"{c}__")), case, F.lit(True))
    flows = flows.join(other, same, "left").drop(*[f"{c}__" for c in case])
    flows = flows.withColumns({way: F.coalesce(way, F.array().cast(found.schema[way].dataType)) for way in ("egress", "ingress")})
    return flows.drop("src_set", "dst_set", *[c for c in case if c.startswith("__")])


def permitting_policies(flows: DataFrame, pods: DataFrame, namespaces: DataFrame, policies: DataFrame, key: list[str]) -> DataFrame:
    """Adds ingress_policies and egress_policies: sorted `namespace/name` of policies with a rule that permits the flow."""
    names = F.collect_list(F.concat("namespace", F.lit("/"), "policy"))
    made = permitting_rules(flows, pods, namespaces, policies, names)
    return made.withColumns({f"{way}_policies": F.sort_array(F.flatten(way)) for way in ("egress", "ingress")}).drop("egress", "ingress")
