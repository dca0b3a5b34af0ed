"""Token-ID output: independent zstandard frames, one a document, with a trailing seek table.

A file is a valid zstandard stream: the documents' frames, a skippable frame with their ids, and the seek
table of the seekable format in a skippable frame at the end (compressed size, size and checksum of each
frame, then the number of frames). A reader reads the table and decompresses only what is asked for; each
frame's checksum (low 32 bits of XXH64) is verified. Token ids are little-endian, two bytes wide where
the vocabulary allows.

Documents stand in ascending doc_id order over all files (null first, ties by text hash, rows alike in
both in any order, so that they spread over files). Files are cut by bytes of text. A task writes under a name of its own; only files named in the manifest,
which Spark writes from finished tasks, count, so lost and repeated tasks do no harm.

Defined results: null counts as an empty text, which has the end id alone; repeated rows are written
each; an empty table makes no file; a very long text is one frame; only doc_id and text are read.
"""

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .pretokens import piece_encoder
from .storage import materialize, shared_folder
from .text import slices, utf8

#: Bytes of text to a file.
FILE_BYTES = 64 << 20
LEVEL = 3
ROW_BYTES = 16

# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_TABLE, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
HAS_CHECKSUMS = 0x80
ENTRY = np.dtype([("compressed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])
FOOTER = struct.Struct("<IBI")

MANIFEST = "part int, file int, path string, n_docs long, n_tokens long"


class TokenWriter:
    def __init__(self, path: str, width: int):
        self.path, self.stream, self.width, self.n_bytes = path, open_file(path, write=True), width, 0
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.entries: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.compress(ids)
        self.stream.write(frame)
        self.entries.append((len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)

    def finish(self) -> tuple[str, int, int]:
        """Close the file; its path, documents and tokens."""
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        numbers = np.array([d or 0 for d in self.doc_ids], "<i8")
        index = self.compress(bytes([self.width]) + known.tobytes() + numbers.tobytes())
        table = np.array(self.entries, ENTRY).tobytes() + FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        for magic, body in ((SKIPPABLE_INDEX, index), (SKIPPABLE_TABLE, table)):
            self.stream.write(struct.pack("<II", magic, len(body)) + body)
        self.stream.close()
        return self.path, len(self.entries), sum(size for _, size, _ in self.entries) // self.width


class TokenReader:
    """Random access to the documents of one file; only the frames asked for are read and decompressed."""

    def __init__(self, file):
        self.file = file
        size = file.size()
        n, _, magic = FOOTER.unpack(self._read(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        begin = size - FOOTER.size - n * ENTRY.itemsize
        self.table = np.frombuffer(self._read(begin, n * ENTRY.itemsize), ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.table["compressed"].astype(np.int64))])
        self.decompress = zstandard.ZstdDecompressor().decompress
        at = int(self.offsets[-1])
        magic, length = struct.unpack("<II", self._read(at, 8))
        index = self.decompress(self._read(at + 8, length))
        self.dtype = np.dtype(f"<u{index[0]}")
        self.known = np.frombuffer(index, np.uint8, n, 1).astype(bool)
        self.doc_ids = np.frombuffer(index, "<i8", n, 1 + n)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return len(self.table)

    def ids(self, first: int, end: int | None = None) -> Iterator[np.ndarray]:
        """Token ids of the documents from the first on, to before the end: of one if no end is given."""
        end = first + 1 if end is None else end
        block = self._read(int(self.offsets[first]), int(self.offsets[end] - self.offsets[first]))
        for k in range(first, end):
            at = int(self.offsets[k] - self.offsets[first])
            data = self.decompress(block[at : at + int(self.table["compressed"][k])], max_output_size=int(self.table["size"][k]))
            if xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != self.table["checksum"][k]:
                raise ValueError(f"checksum of document {k}")
            yield np.frombuffer(data, self.dtype)

    def blocks(self, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + most_bytes, "right")) - 1)
            yield i, j
            i = j


def file_system(path: str):
    """Arrow's file system of a path; what Hadoop calls s3a is its s3."""
    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def open_file(path: str, write: bool = False):
    system, at = file_system(path)
    return system.open_output_stream(at, compression=None) if write else system.open_input_file(at)


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all documents; the manifest: part, file, path, n_docs, n_tokens and start (tokens of all files before)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "tokens")
    total = docs.select(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    n_files = max(1, -(-total // file_bytes))
    # The order of rows alike in doc_id and text is free, so a number of their own may spread them over files.
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"), F.monotonically_increasing_id().alias("tie"))
    ordered = keyed.repartitionByRange(n_files, "doc_id", "hash", "tie").sortWithinPartitions("doc_id", "hash", "tie").select("doc_id", "text")

    def task(batches):
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        part, encoder, writer, rows = TaskContext.get().partitionId(), piece_encoder(tokenizer), None, []
        width = 2 if max(encoder.n_ids, end_id + 1) <= 1 << 16 else 4
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            for i, j in slices(offsets):
                if writer is None or writer.n_bytes >= file_bytes:  # files are cut by bytes, whatever the partition holds
                    if writer is not None:
                        rows.append(writer.finish())
                    writer = TokenWriter(f"{folder}/part-{part:06d}-{len(rows):04d}-{uuid.uuid4().hex}.zst", width)
                ids, counts = encoder.encode(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                whole = np.insert(ids, np.cumsum(counts), end_id).astype(f"<u{width}")
                bounds = np.concatenate([[0], np.cumsum(counts + 1)])
                writer.n_bytes += int(offsets[j] - offsets[i]) + ROW_BYTES * (j - i)
                whole = whole.tobytes()
                for k, (a, b) in enumerate(zip((bounds[:-1] * width).tolist(), (bounds[1:] * width).tolist())):
                    writer.add(doc_ids[i + k], whole[a:b])
        if writer is not None:
            rows.append(writer.finish())
            path, n_docs, n_tokens = zip(*rows)
            columns = [pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(path), pa.array(n_docs), pa.array(n_tokens)]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "file", "path", "n_docs", "n_tokens"])

    manifest = materialize(ordered.mapInArrow(task, MANIFEST), "manifest")
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start and ids (little-endian unsigned 32-bit integers) of every document of the files."""
    n_files = max(1, manifest.count())
    spread = manifest.repartition(n_files, "path")

    def task(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with open_file(path) as file:
                    reader = TokenReader(file)
                    for i, j in reader.blocks():
                        ids = [x.astype("<u4") for x in reader.ids(i, j)]
                        counts = np.array([len(x) for x in ids], np.int64)
                        starts = start + np.cumsum(counts) - counts
                        start += int(counts.sum())
                        columns = {"doc_id": pa.array(reader.doc_ids[i:j], mask=~reader.known[i:j]), "start": pa.array(starts), "ids": pa.array([x.tobytes() for x in ids], pa.binary())}
                        yield pa.RecordBatch.from_pydict(columns)

    return spread.mapInArrow(task, "doc_id long, start long, ids binary")
