"""Sharding: a two-pass external shuffle into shards of equal row counts.

Pass 1 scatters rows uniformly into memory-sized buckets by a seeded hash of the record. Pass 2 orders each
bucket by that hash, runs a Fisher-Yates shuffle over it (Spark's ``shuffle``) and writes it. The
concatenated buckets are one random order of all rows; shard s is its s-th equal run, so row counts of
shards differ by one at most (the ``rows`` law). Only DataFrame functions run, and where a row goes depends
on the rows and the seed alone, not on how the input is cut into files and tasks.

Rows alike in every column have one hash. Where such copies make up over an eighth of a bucket's bytes,
they travel as one row with their number, are dealt in pieces of a bounded number of copies, and become
rows again in their buckets; so a record that a third of the table repeats fills no bucket. Records that
hot are at most 8 * bytes / ``BUCKET_BYTES``; only their hashes are broadcast.

Defined results: a null text counts as empty; a very long text is one row of one bucket; an empty table
gives no rows; all input columns are kept, except that the operator's own columns (``law``, ``shard``,
``slot``, ``grown_shard``) replace input columns of those names. Columns of map type can't be hashed.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .storage import materialize, shared_folder

#: Bytes of text that a bucket aims at; a bucket is held in one task's memory.
BUCKET_BYTES = 32 << 20
#: Shuffle partitions at most; beyond as many buckets, a task takes several, one after the other.
MOST_PARTITIONS = 50_000
ROW_BYTES = 16
#: Rows of 12 bytes, one a bucket, that may be broadcast; with more, the manifest is joined by a shuffle.
MOST_BROADCAST = 1_000_000
SEED = 20240601


def text_bytes(text: str = "text"):
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def _records(rows: DataFrame, bucket_bytes: int, text: str, seed: int) -> DataFrame:
    """(row, hash, copies): every record, those of hot copies in pieces."""
    packed = rows.select(F.struct(*rows.columns).alias("row"), F.xxhash64(F.lit(seed), *rows.columns).alias("hash"), (text_bytes(text) + ROW_BYTES).alias("size"))
    hot = packed.groupBy("hash").agg(F.count("*").alias("n"), F.max("size").alias("size")).filter((F.col("n") > 1) & (F.col("n") * F.col("size") > bucket_bytes / 8))
    hot = materialize(hot.select("hash", "n", F.greatest(F.lit(1), F.floor(bucket_bytes / 8 / F.col("size"))).cast("long").alias("piece")), "hot")
    if hot.isEmpty():
        return packed.select("row", "hash", F.lit(1).cast("long").alias("copies"))
    single = packed.join(F.broadcast(hot.select("hash")), "hash", "left_anti").select("row", "hash", F.lit(1).cast("long").alias("copies"))
    one = packed.join(F.broadcast(hot), "hash").groupBy("hash", "n", "piece").agg(F.any_value("row").alias("row"))
    at = F.explode(F.sequence(F.lit(0), F.expr("(n - 1) DIV piece"))).alias("at")
    pieces = one.select("row", "hash", "n", "piece", at)
    copies = F.least("piece", F.col("n") - F.col("at") * F.col("piece"))
    return single.unionAll(pieces.select("row", F.xxhash64("hash", "at").alias("hash"), copies.alias("copies")))


def shuffle_into_shards(rows: DataFrame, n_shards: int, text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """All rows with ``law``, ``shard``, ``slot`` and ``grown_shard``, read from the written buckets."""
    rows = rows.drop("law", "shard", "slot", "grown_shard")
    total = rows.select(F.sum(text_bytes(text) + ROW_BYTES)).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_bytes))
    n_partitions = min(n_buckets, MOST_PARTITIONS)
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "hash"), F.lit(n_buckets)).cast("int")
    scattered = _records(rows, bucket_bytes, text, seed).withColumn("bucket", bucket).withColumn("part", F.pmod("bucket", F.lit(n_partitions)))
    scattered = scattered.repartitionById(n_partitions, F.col("part"))  # which the groups below need no shuffle beyond
    # Copies lie side by side in a bucket before it is shuffled; equal hashes otherwise mean equal rows.
    by_hash = F.array_sort(F.collect_list(F.struct("hash", "copies", "row")), lambda a, b: F.when(a["hash"] < b["hash"], -1).when(a["hash"] > b["hash"], 1).otherwise(0))
    whole = F.flatten(F.transform(by_hash, lambda x: F.array_repeat(x["row"], x["copies"].cast("int"))))
    shuffled = scattered.groupBy("part", "bucket").agg(whole.alias("all")).select("bucket", F.posexplode(F.shuffle("all", seed)).alias("at", "row"))
    path = shared_folder(rows.sparkSession, "shards")
    shuffled.write.parquet(path)
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("at", T.IntegerType()), T.StructField("row", rows.schema)])
    written = rows.sparkSession.read.schema(schema).parquet(path)
    # One row per bucket from here on: a manifest that says where each bucket begins in the order.
    order = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = written.groupBy("bucket").agg(F.count("*").alias("n"))
    manifest = sizes.select("bucket", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before"))
    n_rows = sizes.agg(F.sum("n")).first()[0] or 0
    small, larger = divmod(n_rows, n_shards)  # the first `larger` shards hold one row more
    edge = larger * (small + 1)
    place = F.col("before") + F.col("at")
    low = place < edge
    shard = F.when(low, F.floor(place / (small + 1))).otherwise(larger + F.floor((place - edge) / max(small, 1)))
    slot = F.when(low, place % (small + 1)).otherwise((place - edge) % max(small, 1))
    manifest = F.broadcast(manifest) if n_buckets <= MOST_BROADCAST else manifest
    return written.join(manifest, "bucket").select("row.*", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
