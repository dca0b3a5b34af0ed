"""Registered queries over tables of networks, interfaces over time, and inventory that comes as JSON."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import networks
from ..functions.tables import written
from ..operators import enrich, filters, metrics, selectors
from ..sources import inventory
from ..sources.packets import LINES
from . import inventory_queries as I

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def network_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(scope, keep, network): of each supplier a source network in IPv4, of every second one in IPv6, and hosts to drop."""
    k = F.col("s_suppkey")
    rule = lambda scope, keep, network: F.struct(F.lit(scope).alias("scope"), keep.alias("keep"), network.alias("network"))
    v4 = F.concat(F.lit("10.1."), k % 256, F.lit(".0/"), F.lit(24) + k % 5)
    v6 = F.when(k % 2 == 0, F.concat(F.lit("fd00::a01:"), F.lower(F.hex((k % 256) * 256)), F.lit("/"), F.lit(120) + k % 5)).otherwise("no network")
    hosts = [F.when(k % 5 == 0, F.concat(F.lit(head), k % 7)) for head in ("10.2.0.", "fd00::a02:")]
    rules = F.array(rule("source", k % 3 != 0, v4), rule("source", k % 3 != 0, v6), *[rule("destination", F.lit(False), h) for h in hosts])
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.inline(rules))


@query(
    f"""WITH {LINES.cte()}, r AS (SELECT s_suppkey AS k FROM supplier),
nets AS (SELECT k, 10*16777216 + 65536 + (k % 256) * 256 AS low, 10*16777216 + 65536 + (k % 256) * 256 + (1 << CAST(8 - k % 5 AS INT)) - 1 AS high FROM r),
src AS (SELECT DISTINCT src_ip AS ip, conn % 2 AS odd FROM packets),
judged AS (SELECT ip, odd, bool_or(k % 3 <> 0) AS keep, bool_or(k % 3 = 0) AS goes FROM src JOIN nets ON ip BETWEEN low AND high AND (odd = 0 OR k % 2 = 0) GROUP BY ip, odd)
SELECT conn, count(*) AS packets FROM packets JOIN judged ON judged.ip = src_ip AND odd = conn % 2
WHERE keep AND NOT goes AND dst_ip NOT IN (SELECT 10*16777216 + 2*65536 + k % 7 FROM r WHERE k % 5 = 0) GROUP BY conn"""
)
def network_filtered(spark, sf_dir):
    """Packets that a table of many networks keeps, IPv4 and IPv6; every second conversation runs over IPv6."""
    packets = LINES.read(spark, sf_dir)
    six = lambda c: F.when(F.col("conn") % 2 == 1, F.concat(F.unhex(F.lit("FD" + "00" * 11)), c)).otherwise(F.col(c))
    packets = packets.withColumns({c: six(c) for c in ("src_ip", "dst_ip")})
    kept = networks.filter_networks(packets, network_rules(spark, sf_dir), {"source": "src_ip", "destination": "dst_ip"})
    return kept.groupBy("conn").agg(F.count("*").alias("packets"))


@query(
    f"""WITH {LINES.cte()}, t AS (SELECT max(ts_ns) // 4 AS q FROM packets),
named AS (SELECT ifindex, CASE ifindex WHEN 1 THEN CASE WHEN ts_ns >= 2*q THEN 'wan0' WHEN ts_ns >= q THEN 'eth0' END WHEN 2 THEN CASE WHEN ts_ns < 3*q THEN 'lo' END
  WHEN 3 THEN CASE WHEN ts_ns >= 3*q THEN 'veth9' WHEN ts_ns >= 2*q THEN NULL WHEN ts_ns >= q THEN 'veth1' END END AS name FROM packets, t)
SELECT ifindex, coalesce(name, 'unknown') AS interface_name, count(*) AS packets FROM named GROUP BY ALL"""
)
def interface_history(spark, sf_dir):
    """Packets by the name that their interface had then: one is renamed half-way, one goes, one comes back."""
    packets = LINES.read(spark, sf_dir)
    change = lambda i, quarter, event, name: F.struct(F.lit(i).alias("ifindex"), (F.col("q") * quarter).alias("ts_ns"), F.lit(event).alias("event"), F.lit(name).alias("interface_name"))
    events = [(1, 1, "add", "eth0"), (1, 2, "add", "wan0"), (2, 0, "add", "lo"), (2, 3, "remove", None), (3, 1, "add", "veth1"), (3, 2, "remove", None), (3, 3, "add", "veth9")]
    changes = packets.agg(F.expr("max(ts_ns) DIV 4").alias("q")).select(F.inline(F.array(*[change(*e) for e in events])))
    return filters.interface_at(packets, changes).groupBy("ifindex", "interface_name").agg(F.count("*").alias("packets"))


def _text(address: str) -> str:
    """SQL for the dotted quad of a number."""
    return f"concat_ws('.', {address} DIV 16777216 % 256, {address} DIV 65536 % 256, {address} DIV 256 % 256, {address} % 256)"


def _lines(table: DataFrame, *parts: str) -> DataFrame:
    """Objects of a table as JSON text, from SQL of their parts."""
    return table.select(F.to_json(F.struct(*[F.expr(p) for p in parts])).alias("value"))


def json_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pods, nodes, services, endpoint slices and network policies as JSON text, one object a row.

    Services whose number is divisible by 3 have no address of their own; an endpoint slice has it.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # rows are short and files few, but the text takes long to parse
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").repartition(1 if n == "nation" else tasks) for n in ("customer", "nation", "supplier", "part")}
    meta = lambda space, name, *more: f"named_struct('name', {name}, 'namespace', {space}{''.join(', ' + m for m in more)}) AS metadata"
    pod_ip = _text("(CAST(167772160 AS BIGINT) + 65536 + c_custkey)")
    node_ip = lambda k: _text(f"(CAST(167772160 AS BIGINT) + 255 * 65536 + {k})")
    port = "element_at(array(443, 80, 53, 8080), CAST(c_custkey % 4 + 1 AS INT))"
    containers = f"array(named_struct('name', 'main', 'image', concat('img-', c_custkey % 7), 'ports', array(named_struct('containerPort', {port}, 'name', 'web'))), named_struct('name', 'proxy', 'image', 'proxy', 'ports', array(named_struct('containerPort', 15001, 'name', 'mesh'))))"
    host = "c_custkey % 50 = 0"
    pods = _lines(
        t["customer"],
        "'Pod' AS kind",
        meta("concat('ns-', c_nationkey % 5)", "concat('pod-', c_custkey)", "'uid', concat('uid-pod-', c_custkey)", "'labels', map('app', lower(c_mktsegment), 'tier', concat('t', c_custkey % 3))"),
        f"named_struct('hostNetwork', {host}, 'nodeName', concat('node-', c_nationkey), 'containers', {containers}) AS spec",
        f"named_struct('podIPs', CASE WHEN {host} THEN NULL ELSE array(named_struct('ip', {pod_ip}), named_struct('ip', concat('fd00::', lower(hex(c_custkey + 1))))) END, 'hostIPs', array(named_struct('ip', {node_ip('c_nationkey')}))) AS status",
    )
    nodes = _lines(t["nation"], "'Node' AS kind", "named_struct('name', concat('node-', n_nationkey)) AS metadata", f"named_struct('addresses', array(named_struct('type', 'Hostname', 'address', 'x'), named_struct('type', 'InternalIP', 'address', {node_ip('n_nationkey')}))) AS status")
    address = _text("(CAST(167772160 AS BIGINT) + 2 * 65536 + s_suppkey)")
    services = _lines(t["supplier"], "'Service' AS kind", meta("concat('ns-', s_nationkey % 5)", "concat('svc-', s_suppkey)"), f"named_struct('clusterIPs', array('None', CASE WHEN s_suppkey % 3 <> 0 THEN {address} END), 'ports', array(named_struct('port', 443))) AS spec")
    slices = _lines(t["supplier"].filter("s_suppkey % 3 = 0"), "'EndpointSlice' AS kind", meta("concat('ns-', s_nationkey % 5)", "concat('slice-', s_suppkey)"), f"array(named_struct('addresses', array({address}))) AS endpoints")
    test = lambda op, key, *values: f"array(named_struct('key', '{key}', 'operator', '{op}', 'values', array({', '.join(repr(v) for v in values)})))"
    selector = lambda labels, tests: f"named_struct('matchLabels', {labels}, 'matchExpressions', {tests})"
    pod = selector("CASE WHEN p_partkey % 4 = 1 THEN map('tier', 't1') END", f"CASE p_partkey % 4 WHEN 2 THEN {test('In', 'app', 'building', 'machinery')} WHEN 3 THEN {test('NotIn', 'tier', 't0')} END")
    tier, prod = selector("map('tier', 't2')", "CAST(NULL AS ARRAY<STRING>)"), selector("map('env', 'prod')", "CAST(NULL AS ARRAY<STRING>)")
    peers = f"CASE WHEN p_partkey % 5 <> 0 THEN array(named_struct('ipBlock', CASE WHEN p_partkey % 5 = 1 THEN named_struct('cidr', '10.2.0.0/16', 'except', array('10.2.0.8/31', 'bad')) END, 'podSelector', CASE WHEN p_partkey % 5 IN (2, 4) THEN {tier} END, 'namespaceSelector', CASE WHEN p_partkey % 5 IN (3, 4) THEN {prod} END)) END"
    ports = "CASE p_size % 4 WHEN 1 THEN array(named_struct('protocol', 'TCP', 'port', '443', 'endPort', NULL)) WHEN 2 THEN array(named_struct('protocol', NULL, 'port', '8000', 'endPort', 9000)) WHEN 3 THEN array(named_struct('protocol', 'TCP', 'port', 'web', 'endPort', NULL)) END"
    rules = lambda side: f"array(named_struct('{side}', {peers}, 'ports', {ports}))"
    policies = _lines(t["part"], "'NetworkPolicy' AS kind", meta("concat('ns-', p_partkey % 5)", "concat('np-', p_partkey)"), f"named_struct('podSelector', {pod}, 'egress', {rules('to')}, 'ingress', {rules('from')}) AS spec")
    out = pods
    for part in (nodes, services, slices, policies):
        out = out.unionAll(part)
    return out


def json_decorated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Flows attributed to the objects of json_dump, and those objects, which are parsed once and written."""
    lines = json_dump(spark, sf_dir).coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))
    objects = written(inventory.objects(lines), "objects")
    return enrich.decorate(I.cluster_flows(spark, sf_dir), enrich.ip_index(objects.drop("containers", "body", "labels")), "last_ns"), objects


_POD = I.INVENTORY.index("pod AS (SELECT *, CAST(0")
_SVC = I.INVENTORY.index("svc AS (SELECT")
JSON_INVENTORY = (
    (I.INVENTORY[:_POD] + "pod AS (SELECT *, 0 AS valid_from, 9223372036854775807 AS valid_to FROM pod0),\n" + I.INVENTORY[_SVC:])
    .replace("SELECT ip, 1, namespace, name, 'Service', NULL,", "SELECT ip, CASE WHEN k % 3 = 0 THEN 3 ELSE 1 END, namespace, CASE WHEN k % 3 = 0 THEN 'slice-' || k ELSE name END, CASE WHEN k % 3 = 0 THEN 'EndpointSlice' ELSE 'Service' END, NULL,")
)
JSON_DECORATED = I.DECORATED.replace(I.INVENTORY, JSON_INVENTORY)


@query(f"WITH {JSON_DECORATED} SELECT community_id, host, proto, {', '.join(I.SIDES)}, decorator_status FROM decorated")
def json_enriched_flows(spark, sf_dir):
    """Flows attributed to an inventory that comes as JSON text, endpoint slices included."""
    return json_decorated(spark, sf_dir)[0].select("community_id", "host", "proto", *I.SIDES, "decorator_status")


@query(I.SQL["permitting_policies"].replace(I.INVENTORY, JSON_INVENTORY).replace("WHEN 1 THEN peer_ip BETWEEN 10*16777216 + 2*65536 AND 10*16777216 + 2*65536 + 65535 WHEN", "WHEN 1 THEN peer_ip BETWEEN 10*16777216 + 2*65536 AND 10*16777216 + 2*65536 + 65535 AND peer_ip NOT BETWEEN 10*16777216 + 2*65536 + 8 AND 10*16777216 + 2*65536 + 9 WHEN"))
def json_permitting_policies(spark, sf_dir):
    """As permitting_policies, with pods, containers and policies of JSON text; blocks have exceptions."""
    flows, objects = json_decorated(spark, sf_dir)
    return I.permitted(spark, sf_dir, flows, objects.filter("kind = 'Pod'"), inventory.network_policies(objects))


@query(
    f"""WITH {I.INVENTORY}, {I._SELECTED}, sets AS (SELECT DISTINCT namespace, app, tier FROM pod),
forms AS (SELECT DISTINCT p_partkey % 4 AS form, 'ns-' || p_partkey % 5 AS namespace FROM part)
SELECT namespace, app, tier, form FROM sets JOIN forms USING (namespace) WHERE CASE form WHEN 0 THEN true WHEN 1 THEN tier = 't1' WHEN 2 THEN app IN ('building', 'machinery') ELSE tier <> 't0' END"""
)
def selected_label_sets(spark, sf_dir):
    """Which policies' selectors fit which label sets: what policy_candidates says, without a row for each pair of pod and policy."""
    pods = inventory.pods(spark, sf_dir, timed=False)
    fits, _, policies = selectors.selected_sets(pods, inventory.policies(spark, sf_dir))
    form = (F.regexp_extract("policy", r"(\d+)$", 1).cast("long") % 4).alias("form")
    forms = policies.groupBy("namespace", "selector_id").agg(F.min(F.col("policy")).alias("policy")).select("namespace", "selector_id", form)
    label = lambda key: F.regexp_extract("label_set", f'"key":"{key}","value":"([^"]*)"', 1).alias(key)
    return fits.join(forms, ["namespace", "selector_id"]).select("namespace", label("app"), label("tier"), "form")


#: Kinds that changes of orders belong to, by customer; what the n-th kind's lists begin and end at, in tenths of time.
_KINDS = ("Pod", "Service", "Node")


def cluster_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of objects of three kinds, one an order, and two lists of each kind that are sent again, interleaved."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").filter("o_orderkey IS NOT NULL")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("o_custkey") % 3 + 1).cast("int"))
    event = F.when(F.col("o_orderkey") % 5 == 0, "delete").when(F.col("o_orderkey") % 11 == 3, "error").otherwise("apply")
    ips = F.when(event == "apply", F.array(F.concat(F.lit("10.0.0."), F.col("o_orderkey") % 3)))
    changes = o.select(F.concat(F.lit("u"), "o_custkey").alias("uid"), kind.alias("kind"), event.alias("event"), F.col("o_orderkey").alias("ts_ns"), ips.alias("ips"))
    mark = lambda k, event, tenth: F.struct(F.lit(None).cast("string").alias("uid"), F.lit(k).alias("kind"), F.lit(event).alias("event"), F.expr(f"m * {tenth} DIV 10").alias("ts_ns"), F.lit(None).cast("array<string>").alias("ips"))
    marks = [mark(k, e, i + t) for i, k in enumerate(_KINDS) for e, t in (("init", 2), ("init_done", 4), ("init", 6), ("init_done", 7))]
    return changes.unionByName(o.agg(F.max("o_orderkey").alias("m")).select(F.inline(F.array(*marks))))


_CHANGES = "c AS (SELECT 'u' || o_custkey AS uid, o_custkey % 3 AS k, CASE WHEN o_orderkey % 5 = 0 THEN 'delete' WHEN o_orderkey % 11 = 3 THEN 'error' ELSE 'apply' END AS event, o_orderkey AS ts FROM orders)"
_KIND_SQL = "CASE k " + " ".join(f"WHEN {i} THEN '{name}'" for i, name in enumerate(_KINDS)) + " END"


@query(
    f"""WITH {_CHANGES}, m AS (SELECT max(o_orderkey) AS m FROM orders), k AS (SELECT unnest([0, 1, 2]) AS k),
lists AS (SELECT k, m * (k + 2) // 10 AS init, m * (k + 4) // 10 AS done FROM k, m UNION ALL SELECT k, m * (k + 6) // 10, m * (k + 7) // 10 FROM k, m),
w AS (SELECT *, lead(ts) OVER (PARTITION BY uid ORDER BY ts) AS next FROM c WHERE event <> 'error')
SELECT uid, {_KIND_SQL} AS kind, ts AS valid_from, least(coalesce(next, 9223372036854775807), coalesce((SELECT min(done) FROM lists WHERE lists.k = w.k AND init > ts), 9223372036854775807)) AS valid_to FROM w WHERE event = 'apply'"""
)
def object_validity_by_kind(spark, sf_dir):
    """Intervals of states, where a list that is sent again ends what it lacks of its own kind alone."""
    return inventory.validity(cluster_changes(spark, sf_dir)).select("uid", "kind", "valid_from", "valid_to")


@query(f"WITH {_CHANGES}, e AS (SELECT k, event FROM c UNION ALL SELECT k, unnest(['init', 'init', 'init_done', 'init_done']) FROM (SELECT unnest([0, 1, 2]) AS k) t) SELECT {_KIND_SQL} AS kind, event, count(*) AS n FROM e GROUP BY ALL")
def inventory_event_counts(spark, sf_dir):
    """Events of the inventory by kind."""
    return metrics.count_by(cluster_changes(spark, sf_dir), "kind", "event")


@query(f"WITH {I.DECORATED}, b AS (SELECT host, decorator_status, row_number() OVER (PARTITION BY host ORDER BY community_id) AS i FROM decorated) SELECT 'otlp' AS exporter, CASE decorator_status WHEN 'undecorated' THEN 'error' ELSE 'ok' END AS status, count(*) AS n FROM b GROUP BY ALL")
def export_counts(spark, sf_dir):
    """Exports by exporter and status; spans without any object on either side stand for failed ones."""
    made = I.decorated(spark, sf_dir).select(F.lit("otlp").alias("exporter"), F.when(F.col("decorator_status") == "undecorated", "error").otherwise("ok").alias("status"))
    return metrics.count_by(made, "exporter", "status")
