"""A set of 64-bit hashes as a bitmap of fixed size: made by Spark, broadcast, asked in tasks.

It has no false negatives. False positives grow with the load, so it may only save work, never decide.
Its size is a parameter and does not depend on the data, which makes it safe to broadcast.
"""

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from .text import released

#: Bits of one row of Spark's bitmap functions.
ROW_BITS = 8 * 4096


class Bitmap:
    def __init__(self, bits: int, rows: list[tuple[int, bytes]]):
        self.bits = bits
        self.bytes = np.zeros((1 << bits) // 8, np.uint8)
        for number, row in rows:
            self.bytes[(number - 1) * 4096 : number * 4096] = np.frombuffer(row, np.uint8)

    def __getstate__(self) -> dict:
        """It travels compressed: a bitmap that is far from full is mostly zeros."""
        return {"bits": self.bits, "packed": zstandard.ZstdCompressor(level=1).compress(self.bytes.tobytes())}

    def __setstate__(self, state: dict) -> None:
        self.bits = state["bits"]
        self.bytes = np.frombuffer(zstandard.ZstdDecompressor().decompress(state["packed"]), np.uint8)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        return (self.bytes[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def bitmap(hashes: DataFrame, column: str, bits: int) -> Bitmap:
    """The bitmap of one long column; the rows that come to the driver hold 2**bits bits at most."""
    low = F.col(column).bitwiseAND(F.lit((1 << bits) - 1)) + 1
    rows = hashes.select(F.bitmap_bucket_number(low).alias("number"), F.bitmap_bit_position(low).alias("position")).groupBy("number").agg(F.bitmap_construct_agg("position").alias("row")).collect()
    return Bitmap(bits, [(r["number"], bytes(r["row"])) for r in rows])


def flagged(rows: DataFrame, marks: DataFrame, column: str, bits: int) -> DataFrame:
    """rows with __flag: whether the bitmap of marks' long column holds theirs; no row is shuffled for it."""
    held = rows.sparkSession.sparkContext.broadcast(bitmap(marks, column, bits))
    schema = StructType([*rows.schema.fields, StructField("__flag", BooleanType())])

    @released
    def task(batches):
        for batch in batches:
            flags = held.value.holds(batch.column(column).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(flags)], names=schema.names)

    return rows.mapInArrow(task, schema)
