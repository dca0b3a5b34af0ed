"""Traffic, lifecycle and latency metrics as aggregates over flows and records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Default upper bounds of histograms, in seconds and in spans, and what a flow's life is counted by.
PIPELINE_SECONDS = (0.00001, 0.00005, 0.0001, 0.0005, 0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0)
EXPORT_SPANS = (1.0, 10.0, 50.0, 100.0, 250.0, 500.0, 1000.0)
INDEX_UPDATE_SECONDS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0)
SHUTDOWN_SECONDS = (0.1, 0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 120.0)
STATUSES = ("created", "recorded", "idled", "dropped")


def traffic_counters(flows: DataFrame, by: str = "ifindex") -> DataFrame:
    """Packets and bytes by interface and direction; what runs back counts under the opposite direction."""
    opposite = F.when(F.col("direction") == "egress", "ingress").otherwise("egress")
    both = F.array(
        F.struct(F.col("direction").alias("direction"), F.col("fwd_packets").alias("packets"), F.col("fwd_bytes").alias("bytes")),
        F.struct(opposite.alias("direction"), F.col("rev_packets").alias("packets"), F.col("rev_bytes").alias("bytes")),
    )
    sides = flows.select(by, F.inline(both)).filter("packets > 0")
    return sides.groupBy(by, "direction").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"))


def count_by(rows: DataFrame, *columns: str) -> DataFrame:
    """Rows of each combination: results of a stage, exports by status, inventory events by kind and event."""
    return rows.groupBy(*columns).agg(F.count("*").alias("n"))


def lifecycle(records: DataFrame, *by: str) -> DataFrame:
    """Flows created, records made and flows ended by idleness or detected end."""
    first, running = F.col("record_start_ns") == F.col("start_ns"), F.col("end_reason") == "active timeout"
    return records.groupBy(*by).agg(F.count_if(first).alias("created"), F.count("*").alias("recorded"), F.count_if(~running).alias("closed"))


def lifecycle_statuses(records: DataFrame, dropped: DataFrame, *by: str) -> DataFrame:
    """(by, status, n): flows created, records made, flows that idled out, and flows that filters dropped.

    A flow whose end was seen (FIN or RST) didn't idle out. dropped has one row a flow. A status that a group doesn't
    have is counted 0.
    """
    first = F.col("record_start_ns") == F.col("start_ns")
    made = records.groupBy(*by).agg(F.count_if(first).alias("created"), F.count("*").alias("recorded"), F.count_if(F.col("end_reason") == "idle timeout").alias("idled"))
    lost = dropped.groupBy(*by).agg(F.count("*").alias("dropped"))
    both = made.join(lost, list(by), "full").fillna(0, list(STATUSES))
    return both.select(*by, F.inline(F.array(*[F.struct(F.lit(s).alias("status"), F.col(s).alias("n")) for s in STATUSES])))


def active_flows(sessions: DataFrame, step_ns: int) -> DataFrame:
    """Flows that are open at the end of every time step with a change: created minus closed so far."""
    changes = sessions.select(F.inline(F.array(F.struct(F.col("start_ns").alias("at"), F.lit(1).alias("change")), F.struct(F.col("end_ns").alias("at"), F.lit(-1).alias("change")))))
    steps = changes.groupBy((F.col("at") - F.col("at") % step_ns).alias("step_ns")).agg(F.sum("change").alias("change"))
    so_far = Window.orderBy("step_ns").rowsBetween(Window.unboundedPreceding, 0)  # one row a step of time, not one a flow
    return steps.select("step_ns", F.sum("change").over(so_far).alias("active"))


def bounds_or(bounds, default) -> list[float]:
    """Bounds if they are finite, positive and ascending; else the default."""
    good = bool(bounds) and all(isinstance(b, int | float) and 0 < b < float("inf") for b in bounds) and all(a < b for a, b in zip(bounds, bounds[1:]))
    return [float(b) for b in (bounds if good else default)]


def histogram(rows: DataFrame, value: str, by: list[str], bounds=None, default=PIPELINE_SECONDS) -> DataFrame:
    """Cumulative counts under each upper bound; the count under infinity has a null bound."""
    limits = bounds_or(bounds, default)
    counts = rows.groupBy(*by).agg(*[F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(limits)], F.count(value).alias("le_all"))
    cells = [F.struct(F.lit(b).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(limits)] + [F.struct(F.lit(None).cast("double").alias("le"), F.col("le_all").alias("n"))]
    return counts.select(*by, F.inline(F.array(*cells)))


def histogram_sums(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """What goes with a histogram's counts: the sum and the number of values."""
    return rows.groupBy(*by).agg(F.sum(value).alias("sum"), F.count(value).alias("n"))


def expire_series(series: DataFrame, deletions: DataFrame, key: str, now: Column | int, ttl: int) -> DataFrame:
    """Series but those of keys that were deleted at least ttl ago with no activity since; now may be a scalar subquery."""
    gone = deletions.groupBy(key).agg(F.max("deleted_at").alias("deleted_at"))
    gone = gone.filter(F.col("deleted_at") + ttl <= now)
    late = series.join(gone, key, "left")
    return late.filter(F.col("deleted_at").isNull() | (F.col("last_active") > F.col("deleted_at"))).drop("deleted_at")
