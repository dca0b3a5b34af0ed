"""Flow records as trace spans: names, ids, dotted attributes, and batches in OTLP's shape."""

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import protocol_name

DAY_NS = 86_400_000_000_000


def span_name(network_type: Column, proto: Column) -> Column:
    transport = protocol_name(proto)
    return F.when(network_type == "arp", "flow_arp").otherwise(F.concat_ws("_", F.lit("flow"), network_type, transport))


def in_order(start: Column, end: Column) -> tuple[Column, Column]:
    return F.least(start, end), F.greatest(start, end)


def trace_ids(records: DataFrame, at: str, timeout_ns: int = DAY_NS) -> DataFrame:
    """Adds trace_id: one for each conversation and timeout span counted from its first record."""
    first = F.min(at).over(Window.partitionBy("community_id"))
    window = F.expr(f"({at} - __first) DIV {timeout_ns}") * timeout_ns + F.col("__first")
    known = records.withColumn("__first", first)
    digest = F.sha2(F.concat_ws("|", "community_id", window.cast("string")), 256)
    return known.withColumn("trace_id", F.substring(digest, 1, 32)).drop("__first")


def attributes(fields: dict[str, str], maps: dict[str, str] | None = None, lists: dict[str, str] | None = None) -> Column:
    """Dotted attribute names to text values without nulls.

    fields: attribute to column; maps: prefix to map column, flattened to prefix.key; lists: attribute to
    array column, joined by commas.
    """
    plain = [(F.lit(k), F.col(c).cast("string")) for k, c in fields.items()] + [(F.lit(k), F.array_join(c, ",")) for k, c in (lists or {}).items()]
    out = F.map_filter(F.create_map(*chain.from_iterable(plain)), lambda k, v: v.isNotNull())
    for prefix, column in (maps or {}).items():
        flat = F.transform_keys(F.coalesce(F.col(column), F.create_map().cast("map<string,string>")), lambda k, v: F.concat(F.lit(prefix + "."), k))  # noqa: B023
        out = F.map_concat(out, flat)
    return out


def otlp(spans: DataFrame, resource: list[str], scope: str, batch_rows: int = 1024) -> DataFrame:
    """One row a batch of at most batch_rows spans of one resource: nested resourceSpans, scopeSpans, spans.

    Batches are cut inside partitions by row number, so making them moves each span once, to its resource. Rows are
    sorted before, so a task that is tried again cuts the same batches.
    """
    spans = spans.sortWithinPartitions(*[f.name for f in spans.schema.fields if f.dataType.typeName() not in ("map", "variant")])
    number = F.monotonically_increasing_id()
    batch = F.struct(F.shiftright(number, 33).alias("part"), F.floor(number.bitwiseAND(F.lit((1 << 33) - 1)) / batch_rows).alias("cut"))
    rows = spans.withColumn("__batch", batch)
    body = [c for c in spans.columns if c not in resource]
    grouped = rows.groupBy("__batch", *resource).agg(F.collect_list(F.struct(*body)).alias("spans"))
    pairs = F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in resource])
    scoped = F.array(F.struct(F.struct(F.lit(scope).alias("name")).alias("scope"), F.col("spans").alias("spans")))
    return grouped.select(F.array(F.struct(F.struct(pairs.alias("attributes")).alias("resource"), scoped.alias("scopeSpans"))).alias("resourceSpans"))
