"""Kubernetes inventory: objects as typed tables, from given tables, JSON dumps or change streams.

An object row has kind, namespace, name, uid, labels, and what its kind needs: ips (array<binary>),
host_network, owner_kind and owner_name, containers, selector; and when it is valid (nanoseconds).
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import networks
from ..functions.addresses import from_number
from ..operators.asof import as_of

FOREVER = (1 << 63) - 1


def _named(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def node_ip(nation: Column) -> Column:
    return from_number(F.lit(10 * 16777216 + 255 * 65536) + nation)


def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/region.parquet")
    env = F.when(F.col("r_regionkey") % 2 == 0, "prod").otherwise("dev")
    return r.select(F.lit("Namespace").alias("kind"), _named("ns-", F.col("r_regionkey")).alias("name"), F.create_map(F.lit("env"), env).alias("labels"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return n.select(F.lit("Node").alias("kind"), F.lit("").alias("namespace"), _named("node-", F.col("n_nationkey")).alias("name"), F.array(node_ip(F.col("n_nationkey"))).alias("ips"))


def pods(spark: SparkSession, sf_dir: str, timed: bool = True) -> DataFrame:
    """A third of the way through packet time, one pod in seven is replaced by a successor on its address.

    Without times nothing but customer is read, for those who ask what pods there are, not when.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    host = key % 50 == 0
    port = F.element_at(F.array(*map(F.lit, (443, 80, 53, 8080))), (key % 4 + 1).cast("int"))
    containers = F.array(
        F.struct(F.lit("main").alias("name"), _named("img-", key % 7).alias("image"), port.alias("port"), F.lit("web").alias("port_name")),
        F.struct(F.lit("proxy").alias("name"), F.lit("proxy").alias("image"), F.lit(15001).alias("port"), F.lit("mesh").alias("port_name")),
    )
    if timed:
        c = c.crossJoin(F.broadcast(spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg(F.expr("max(l_orderkey) * 1000000000 DIV 3").alias("swap_ns"))))
    base = c.select(
        F.lit("Pod").alias("kind"),
        _named("ns-", nation % 5).alias("namespace"),
        _named("pod-", key).alias("name"),
        _named("node-", nation).alias("node"),
        F.array(F.when(host, node_ip(nation)).otherwise(from_number(F.lit(10 * 16777216 + 65536) + key))).alias("ips"),
        host.alias("host_network"),
        F.create_map(F.lit("app"), F.lower("c_mktsegment"), F.lit("tier"), _named("t", key % 3)).alias("labels"),
        F.lit("ReplicaSet").alias("owner_kind"),
        _named("rs-", key % 40).alias("owner_name"),
        containers.alias("containers"),
        (key % 7 == 0).alias("replaced"),
        *(["swap_ns"] if timed else []),
    )
    if not timed:
        both = base.withColumn("name", F.explode(F.when(F.col("replaced"), F.array("name", F.concat("name", F.lit("-b")))).otherwise(F.array("name"))))
        return both.drop("replaced").withColumn("uid", F.concat(F.lit("uid-"), "name"))
    old = base.withColumns({"valid_from": F.lit(0).cast("long"), "valid_to": F.when(F.col("replaced"), F.col("swap_ns")).otherwise(F.lit(FOREVER))})
    new = base.filter("replaced").withColumns({"name": F.concat("name", F.lit("-b")), "valid_from": F.col("swap_ns"), "valid_to": F.lit(FOREVER)})
    return old.unionByName(new).drop("replaced", "swap_ns").withColumn("uid", F.concat(F.lit("uid-"), "name"))


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    app = F.element_at(F.array(*map(F.lit, SEGMENTS)), (key % 5 + 1).cast("int"))
    empty = F.lit(None).cast("map<string,string>")
    selector = F.when(key % 11 != 0, F.create_map(F.lit("app"), app)).otherwise(empty)
    return s.select(F.lit("Service").alias("kind"), _named("ns-", F.col("s_nationkey") % 5).alias("namespace"), _named("svc-", key).alias("name"), F.array(from_number(F.lit(10 * 16777216 + 2 * 65536) + key)).alias("ips"), selector.alias("match_labels"))


#: The market segments that pods' app labels are made of.
SEGMENTS = ("automobile", "building", "furniture", "machinery", "household")


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 ReplicaSets and 10 Deployments in each namespace: (namespace, kind, name, owner_kind, owner_name)."""
    spaces = namespaces(spark, sf_dir).select(F.col("name").alias("namespace"))
    number = spaces.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39))))
    sets = number.select("namespace", F.lit("ReplicaSet").alias("kind"), _named("rs-", F.col("i")).alias("name"), F.lit("Deployment").alias("owner_kind"), _named("dep-", F.col("i") % 10).alias("owner_name"))
    tops = number.filter("i < 10").select("namespace", F.lit("Deployment").alias("kind"), _named("dep-", F.col("i")).alias("name"), F.lit(None).cast("string").alias("owner_kind"), F.lit(None).cast("string").alias("owner_name"))
    return sets.unionByName(tops)


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A network policy a part: (namespace, name, pod_selector, rules); each has one egress and one ingress rule."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    key = F.col("p_partkey")
    labels, tests = "map<string,string>", "array<struct<key: string, operator: string, values: array<string>>>"
    none, no_tests = F.lit(None).cast(labels), F.lit(None).cast(tests)
    test = lambda op, k, *v: F.array(F.struct(F.lit(k).alias("key"), F.lit(op).alias("operator"), F.array(*map(F.lit, v)).alias("values")))
    selector = lambda pairs, exprs: F.struct(pairs.alias("match_labels"), exprs.alias("match_expressions"))
    pod = selector(F.when(key % 4 == 1, F.create_map(F.lit("tier"), F.lit("t1"))).otherwise(none), F.when(key % 4 == 2, test("In", "app", "building", "machinery")).when(key % 4 == 3, test("NotIn", "tier", "t0")).otherwise(no_tests))
    kind = key % 5
    tier, prod = selector(F.create_map(F.lit("tier"), F.lit("t2")), no_tests), selector(F.create_map(F.lit("env"), F.lit("prod")), no_tests)
    peer = F.struct(
        F.when(kind == 1, F.unhex(F.lit("0A020000"))).alias("low"),
        F.when(kind == 1, F.unhex(F.lit("0A02FFFF"))).alias("high"),
        F.lit(None).cast("array<struct<low: binary, high: binary>>").alias("excepted"),
        F.when(kind.isin(2, 4), tier).alias("pod_selector"),
        F.when(kind.isin(3, 4), prod).alias("namespace_selector"),
    )
    ports = F.struct(F.lit("TCP").alias("protocol"), F.when(F.col("p_size") % 4 == 1, 443).when(F.col("p_size") % 4 == 2, 8000).cast("int").alias("port"), F.when(F.col("p_size") % 4 == 2, 9000).cast("int").alias("end_port"), F.when(F.col("p_size") % 4 == 3, "web").alias("port_name"))
    rule = lambda way: F.struct(F.lit(way).alias("way"), F.when(kind == 0, F.array()).otherwise(F.array(peer)).alias("peers"), F.when(F.col("p_size") % 4 == 0, F.array()).otherwise(F.array(ports)).alias("ports"))
    return p.select(_named("ns-", key % 5).alias("namespace"), _named("np-", key).alias("name"), pod.alias("pod_selector"), F.array(rule("egress"), rule("ingress")).alias("rules"))


def from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Objects of JSON text, one a row: identity, labels, owner, addresses by kind, and the body as a variant."""
    body = F.try_parse_json(F.col(column))
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    rows = lines.select(body.alias("body"))
    text_ips = F.array_compact(
        F.concat(
            F.coalesce(F.transform(get("$.status.podIPs", "array<struct<ip: string>>"), lambda x: x["ip"]), F.array(get("$.status.podIP", "string"))),
            F.coalesce(get("$.spec.clusterIPs", "array<string>"), F.array(get("$.spec.clusterIP", "string"))),
            F.coalesce(get("$.spec.externalIPs", "array<string>"), F.array().cast("array<string>")),
            F.coalesce(F.flatten(F.transform(get("$.endpoints", "array<struct<addresses: array<string>>>"), lambda x: x["addresses"])), F.array().cast("array<string>")),
            F.coalesce(F.transform(get("$.status.loadBalancer.ingress", "array<struct<ip: string>>"), lambda x: x["ip"]), F.array().cast("array<string>")),
            F.coalesce(F.transform(F.filter(get("$.status.addresses", "array<struct<type: string, address: string>>"), lambda x: x["type"].isin("InternalIP", "ExternalIP")), lambda x: x["address"]), F.array().cast("array<string>")),
        )
    )
    # A host-network pod without pod addresses has its host's.
    host = F.coalesce(get("$.spec.hostNetwork", "boolean"), F.lit(False))
    host_ips = F.coalesce(F.transform(get("$.status.hostIPs", "array<struct<ip: string>>"), lambda x: x["ip"]), F.array_compact(F.array(get("$.status.hostIP", "string"))))
    known = F.filter(F.array_distinct(text_ips), lambda x: x != "None")
    return rows.select(
        get("$.kind", "string").alias("kind"),
        F.coalesce(get("$.metadata.namespace", "string"), F.lit("")).alias("namespace"),
        get("$.metadata.name", "string").alias("name"),
        get("$.metadata.uid", "string").alias("uid"),
        get("$.metadata.labels", "map<string,string>").alias("labels"),
        get("$.metadata.ownerReferences", "array<struct<kind: string, name: string>>").alias("owner_refs"),
        get("$.metadata.deletionTimestamp", "string").isNotNull().alias("deleting"),
        host.alias("host_network"),
        F.when((F.size(known) == 0) & host, host_ips).otherwise(known).alias("ips"),
        "body",
    )


_LABELS = "map<string,string>"
_TESTS = "array<struct<key: string, operator: string, values: array<string>>>"
_SELECTOR_JSON = f"struct<matchLabels: {_LABELS}, matchExpressions: {_TESTS}>"
_PEER_JSON = f"struct<ipBlock: struct<cidr: string, `except`: array<string>>, podSelector: {_SELECTOR_JSON}, namespaceSelector: {_SELECTOR_JSON}>"
_PORTS_JSON = "array<struct<protocol: string, port: string, endPort: int>>"


def objects(lines: DataFrame, column: str = "value") -> DataFrame:
    """from_json with what attribution and policies take: binary ips, ports, containers, node and selector.

    Addresses that are none are skipped. ports are those of containers, services and endpoint slices; containers
    have a row for each of their ports, in their order, and one without a port if they have none. match_labels and
    match_expressions are the selector of the object's kind: of a Service its labels alone.
    """
    rows = from_json(lines, column)
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    of = lambda *kinds: F.col("kind").isin(*kinds)
    specs = get("$.spec.containers", "array<struct<name: string, image: string, ports: array<struct<containerPort: int, name: string, protocol: string>>>>")

    def each_port(c: Column) -> Column:
        row = lambda port, name, protocol: F.struct(c["name"].alias("name"), c["image"].alias("image"), port.cast("int").alias("port"), name.cast("string").alias("port_name"), protocol.cast("string").alias("protocol"))
        return F.when(F.coalesce(F.size(c["ports"]), F.lit(0)) > 0, F.transform(c["ports"], lambda p: row(p["containerPort"], p["name"], p["protocol"]))).otherwise(F.array(row(F.lit(None), F.lit(None), F.lit(None))))

    rows = rows.withColumn("containers", F.when(of("Pod"), F.flatten(F.transform(specs, each_port))))
    own = F.transform(F.filter("containers", lambda c: c["port"].isNotNull()), lambda c: F.struct(c["protocol"], c["port"]))
    served = F.transform(F.coalesce(get("$.spec.ports", "array<struct<protocol: string, port: int>>"), get("$.ports", "array<struct<protocol: string, port: int>>")), lambda p: F.struct(p["protocol"], p["port"]))
    pod_labels = F.when(of("NetworkPolicy"), get("$.spec.podSelector.matchLabels", _LABELS)).when(of("Service"), get("$.spec.selector", _LABELS)).when(of("CronJob"), get("$.spec.jobTemplate.spec.selector.matchLabels", _LABELS)).otherwise(get("$.spec.selector.matchLabels", _LABELS))
    pod_tests = F.when(of("NetworkPolicy"), get("$.spec.podSelector.matchExpressions", _TESTS)).when(of("CronJob"), get("$.spec.jobTemplate.spec.selector.matchExpressions", _TESTS)).when(~of("Service"), get("$.spec.selector.matchExpressions", _TESTS))
    return rows.withColumns(
        {
            "ips": F.array_compact(F.transform("ips", networks.from_text)),
            "ports": F.when(of("Pod"), own).when(of("Service", "EndpointSlice"), served),
            "node": get("$.spec.nodeName", "string"),
            "match_labels": pod_labels,
            "match_expressions": pod_tests,
        }
    )


def network_policies(rows: DataFrame) -> DataFrame:
    """(namespace, name, pod_selector, rules) of the NetworkPolicies among objects with a body.

    A rule has its way, its peers (none: everybody) and its ports (none: all). A block whose address is none holds
    nobody. A way without a section has no rule, so nothing is permitted that way.
    """
    get = lambda path, kind: F.try_variant_get("body", path, kind)
    nobody = F.lit(bytearray())
    selector = lambda x: F.when(x.isNotNull(), F.struct(x["matchLabels"].alias("match_labels"), x["matchExpressions"].alias("match_expressions")))

    def peer(p: Column) -> Column:
        block = F.transform(F.array(p["ipBlock"]["cidr"]), networks.bounds)
        edge = lambda name: F.when(p["ipBlock"].isNotNull(), F.coalesce(F.get(block, F.lit(0))[name], nobody)).alias(name)
        outside = F.array_compact(F.transform(p["ipBlock"]["except"], networks.bounds)).alias("excepted")
        return F.struct(edge("low"), edge("high"), outside, selector(p["podSelector"]).alias("pod_selector"), selector(p["namespaceSelector"]).alias("namespace_selector"))

    def port(p: Column) -> Column:
        number = p["port"].rlike("^[0-9]{1,5}$")
        return F.struct(p["protocol"].alias("protocol"), F.when(number, p["port"].cast("int")).alias("port"), p["endPort"].alias("end_port"), F.when(~number, p["port"]).alias("port_name"))

    def section(way: str, side: str) -> Column:
        rules = get(f"$.spec.{way}", f"array<struct<`{side}`: array<{_PEER_JSON}>, ports: {_PORTS_JSON}>>")
        none = F.array()
        made = F.transform(rules, lambda r: F.struct(F.lit(way).alias("way"), F.coalesce(F.transform(r[side], peer), none).alias("peers"), F.coalesce(F.transform(r["ports"], port), none).alias("ports")))
        return F.coalesce(made, none)

    pod = F.struct("match_labels", "match_expressions").alias("pod_selector")
    chosen = rows.filter("kind = 'NetworkPolicy'")
    return chosen.select("namespace", "name", pod, F.concat(section("egress", "to"), section("ingress", "from")).alias("rules"))


def selector_at(objects: DataFrame, path: str) -> DataFrame:
    """Adds match_labels and match_expressions found at a dotted path of the body, on any kind."""
    at = "$." + path.removesuffix(".matchLabels")
    return objects.withColumns({"match_labels": F.try_variant_get("body", f"{at}.matchLabels", "map<string,string>"), "match_expressions": F.try_variant_get("body", f"{at}.matchExpressions", "array<struct<key: string, operator: string, values: array<string>>>")})


def lists_sent(changes: DataFrame, by: list[str]) -> DataFrame:
    """(by, init_ns, done_ns) of lists that were sent again: each init_done with the last init of its kind before it."""
    marks = changes.filter(F.col("event").isin("init", "init_done")).select(*by, "event", F.col("ts_ns").alias("done_ns"))
    last = Window.partitionBy(*by).orderBy("done_ns", "event").rowsBetween(Window.unboundedPreceding, -1)
    began = F.last(F.when(F.col("event") == "init", F.col("done_ns")), ignorenulls=True).over(last)
    return marks.withColumn("init_ns", began).filter("event = 'init_done'").select(*by, F.coalesce("init_ns", "done_ns").alias("init_ns"), "done_ns")


def validity(changes: DataFrame) -> DataFrame:
    """Changes (uid, event, ts_ns, ips, ...) as intervals: each applied state until the next change of its uid.

    Deletions end an interval and open none; ips_changed tells whether addresses differ from the state before. A list
    that is sent again stands between the events init and init_done (of no uid), each kind's of its own, where
    changes have a kind, and each cluster's: what it doesn't hold is over at init_done. A state meets the first list
    of its kind that begins after it by an as-of join. Other events, such as error, change nothing.
    """
    by = [c for c in ("cluster", "kind") if c in changes.columns]
    keyed = changes if by else changes.withColumn("__kind", F.lit(""))
    own = by or ["__kind"]
    lists = lists_sent(keyed, own).groupBy(*own, "init_ns").agg(F.min("done_ns").alias("done_ns"))
    by_uid = Window.partitionBy(*[c for c in ("cluster",) if c in by], "uid").orderBy("ts_ns")
    none = F.array().cast(changes.schema["ips"].dataType)
    before = F.coalesce(F.sort_array(F.lag("ips").over(by_uid)), none)
    known = keyed.filter(F.col("event").isin("apply", "delete"))
    marked = known.withColumns({"valid_from": F.col("ts_ns"), "valid_to": F.coalesce(F.lead("ts_ns").over(by_uid), F.lit(FOREVER)), "ips_changed": ~before.eqNullSafe(F.coalesce(F.sort_array("ips"), none))})
    met = as_of(marked.filter(F.col("event") == "apply"), lists, own, "valid_from", "init_ns", ["done_ns"], following=True)
    ended = F.when(F.col("done_ns") < F.col("valid_to"), F.col("done_ns")).otherwise(F.col("valid_to"))
    return met.withColumn("valid_to", ended).drop("done_ns", "__kind")


def latest(changes: DataFrame) -> DataFrame:
    """The objects that are there after all changes: the batch twin of the table that ChangeTable keeps."""
    return validity(changes).filter(F.col("valid_to") == FOREVER).drop("valid_from", "valid_to", "ips_changed")
