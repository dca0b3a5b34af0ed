"""Source divergence audit: how far the term proportions of each source lie from those of its peers.

Within a lang, kept are terms in at least `min_docs` of its documents. A group (lang, source), and a lang as a
whole, gives each kept term the smoothed proportion p = 1 + floor(scale * (count + smoothing) / (N + smoothing * V)).

Pairs of groups are found by Gustavson's row accumulation. The term-major index of a lang is dealt into blocks
of terms; in a block each group (a row) scatters its terms through the index into a dense accumulator with one
cell a peer, so that no pair of postings is ever emitted. Terms that a group lacks have its zero proportion z:

    sum |p - q| = V |z - z'| + sum over the row's terms (|p - z'| - |z - z'|), the same for the peer's terms,
                  + sum over common terms (|p - q| - |p - z'| - |q - z| + |z - z'|)

The first sums need no index: a row's proportions are sorted once, and prefix sums give them for every peer. What
leaves a block is one sum a pair. A block has at least as many postings as a lang has pairs of groups, so what is
shuffled stays under the size of the index; where the accumulators of all groups would be over ``CELLS``, rows are
dealt into chunks, and each chunk reads the block. All arithmetic is in whole numbers.

Defined results: null text, lang and source count as ''; a group without terms has its pairs (and no terms of its
own); repeated rows count as further documents; ties of values go by item; a lang without kept terms has value 0
for all pairs; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .terms import term_counts
from .text import gather

MIN_DOCS, SMOOTHING, SCALE, TOP_TERMS = 30, 5, 1_000_000_000, 50
#: Postings of a block, at least; accumulator cells of a chunk of rows, at most; postings scattered at a time.
BLOCK, CELLS, SLICE = 1 << 15, 1 << 22, 1 << 18


def proportion(count: str, total: str, kept: str, smoothing: int, scale: int) -> Column:
    """Exact for counts of any size: products are decimals."""
    return F.expr(f"1L + cast({scale} AS DECIMAL(12, 0)) * cast({count} + {smoothing} AS DECIMAL(20, 0)) DIV cast({total} + {smoothing} * {kept} AS DECIMAL(20, 0))")


def kept_terms(docs: DataFrame, min_docs: int) -> DataFrame:
    """(lang, source, term, n, total, lead): counts of kept terms by group and in the lang; lead marks one row a term."""
    term = Window.partitionBy("lang", "term")
    counts = term_counts(docs).withColumns({"in_docs": F.sum("docs").over(term), "total": F.sum("n").over(term), "lead": F.min("source").over(term) == F.col("source")})
    return counts.filter(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "total", "lead")


def group_table(docs: DataFrame, kept: DataFrame, smoothing: int, scale: int) -> DataFrame:
    """One row a group: its code among the sources of its lang, sums, zero proportion z, blocks and chunks."""
    groups = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    langs = kept.groupBy("lang").agg(F.count_if("lead").alias("v"), F.sum(F.when(F.col("lead"), F.col("total"))).alias("lang_n"), F.count("*").alias("postings"))
    lang = Window.partitionBy("lang")
    out = groups.join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["n", "v", "lang_n", "postings"])
    out = out.withColumns({"code": F.row_number().over(lang.orderBy("source")) - 1, "peers": F.count("*").over(lang)})
    zero = F.when(F.col("v") > 0, proportion("0", "n", "v", smoothing, scale)).otherwise(F.lit(0))
    blocks = F.greatest(F.lit(1), F.expr(f"(postings + greatest({BLOCK}, peers * peers) - 1) DIV greatest({BLOCK}, peers * peers)"))
    rows = F.greatest(F.lit(1), F.expr(f"{CELLS} DIV peers"))
    return out.withColumns({"z": zero, "blocks": blocks, "rows": rows}).withColumn("chunks", F.expr("(peers + rows - 1) DIV rows"))


class Unit:
    """The accumulators of one chunk of rows over one block of a lang's index."""

    def __init__(self, lang: str, block: int, chunk: int):
        self.lang, self.block, self.chunk = lang, block, chunk
        self.codes, self.zeros, self.kept, self.rows = [], [], 0, 1
        self.held, self.size, self.sums = [], 0, None

    def header(self, codes: np.ndarray, zeros: np.ndarray, kept: int, rows: int) -> None:
        self.codes.append(codes)
        self.zeros.append(zeros)
        self.kept, self.rows = kept, rows

    def begin(self) -> None:
        if self.sums is None:
            codes, zeros = np.concatenate(self.codes), np.concatenate(self.zeros)
            self.z = zeros[np.argsort(codes)]
            self.low = self.chunk * self.rows
            self.high = min(len(self.z), self.low + self.rows)
            self.sums = np.zeros((self.high - self.low, len(self.z)), np.int64)

    def add(self, term: pa.Array, code: np.ndarray, p: np.ndarray) -> None:
        self.begin()
        self.held.append((term, code, p))
        self.size += len(code)
        if self.size >= SLICE:
            self.scatter(False)

    def scatter(self, last: bool) -> None:
        """Scatter what is held, but for the last term, which may go on."""
        if not self.size:
            return
        term, (code, p) = pa.concat_arrays([t for t, _, _ in self.held]), (np.concatenate([h[k] for h in self.held]) for k in (1, 2))
        new = np.ones(len(code), bool)
        new[1:] = pc.not_equal(term.slice(1), term.slice(0, len(term) - 1)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        cut = len(code) if last else int(starts[-1])
        self.held, self.size = ([], 0) if cut == len(code) else ([(term.slice(cut), code[cut:], p[cut:])], len(code) - cut)
        if not cut:
            return
        code, p, new = code[:cut], p[:cut], new[:cut]
        ends = np.append(starts[starts < cut], cut)[np.cumsum(new)]
        order = np.argsort(code, kind="stable")
        bounds = np.searchsorted(code[order], np.arange(self.low, self.high + 1))
        z = self.z
        for row in range(self.low, self.high):
            own = order[bounds[row - self.low] : bounds[row - self.low + 1]]
            if not len(own):
                continue
            mine, zero, sums = p[own], z[row], self.sums[row - self.low]
            behind = ends[own] - own - 1
            at = gather(own + 1, behind)
            peer, theirs = code[at], p[at]
            here, nought = np.repeat(mine, behind), z[peer]
            np.add.at(sums, peer, np.abs(here - theirs) - np.abs(here - nought) - np.abs(theirs - zero) + np.abs(nought - zero))
            mine = np.sort(mine)
            total = np.concatenate([[0], np.cumsum(mine)])
            k = np.searchsorted(mine, z)
            sums += (2 * k - len(mine)) * z - 2 * total[k] + total[-1] - len(mine) * np.abs(z - zero)

    def finish(self) -> Iterator[pa.RecordBatch]:
        self.begin()
        self.scatter(True)
        n = len(self.z)
        step = max(1, (1 << 16) // max(1, n))
        for a in range(0, self.high - self.low, step):
            row = np.repeat(np.arange(a, min(a + step, self.high - self.low)), n)
            peer, value = np.tile(np.arange(n), len(row) // n), self.sums[a : a + step].ravel()
            row += self.low
            if self.block == 0:
                value = value + np.where(row < peer, self.kept * np.abs(self.z[row] - self.z[peer]), 0)
            own = row != peer
            columns = {"low": np.minimum(row, peer)[own], "high": np.maximum(row, peer)[own], "value": value[own]}
            yield pa.RecordBatch.from_pydict({"lang": pa.array([self.lang] * int(own.sum()), pa.string())} | {c: pa.array(v) for c, v in columns.items()})


def accumulated(units: DataFrame) -> DataFrame:
    """(lang, low, high, value): a part of each pair's sum from every unit; low and high are codes."""

    def task(batches):
        unit = None
        for batch in batches:
            lang, term = batch.column("lang"), batch.column("term")
            numbers = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "chunk", "code", "p")}
            n = batch.num_rows
            if not n:
                continue
            new = pc.not_equal(lang.slice(1), lang.slice(0, n - 1)).to_numpy(zero_copy_only=False)
            for c in ("block", "chunk"):
                new = new | (numbers[c][1:] != numbers[c][:-1])
            cuts = [0, *(np.flatnonzero(new) + 1).tolist(), n]
            head = pc.is_null(term).to_numpy(zero_copy_only=False)
            for i, j in zip(cuts, cuts[1:]):
                name = (lang[i].as_py(), int(numbers["block"][i]), int(numbers["chunk"][i]))
                if unit is None or name != (unit.lang, unit.block, unit.chunk):
                    if unit is not None:
                        yield from unit.finish()
                    unit = Unit(*name)
                k = i + int(head[i:j].sum())
                if k > i:
                    unit.header(numbers["code"][i:k], numbers["p"][i:k], batch.column("v")[i].as_py(), batch.column("rows")[i].as_py())
                if j > k:
                    unit.add(term.slice(k, j - k), numbers["code"][k:j], numbers["p"][k:j])
        if unit is not None:
            yield from unit.finish()

    return units.mapInArrow(task, "lang string, low long, high long, value long")


def pair_values(kept: DataFrame, groups: DataFrame, smoothing: int, scale: int) -> DataFrame:
    """(lang, source, item, value) for every group and every other source of its lang."""
    number = lambda c: F.col(c).cast("long").alias(c)
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    joined = kept.join(groups.select("lang", "source", "code", F.col("n").alias("group_n"), "v", "blocks", "chunks"), ["lang", "source"])
    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    postings = joined.select("lang", block.alias("block"), each("chunks").alias("chunk"), "term", number("code"), proportion("n", "group_n", "v", smoothing, scale).alias("p"), F.lit(None).cast("long").alias("v"), F.lit(None).cast("long").alias("rows"))
    heads = groups.select("*", each("blocks").alias("block")).select("*", each("chunks").alias("chunk"))
    heads = heads.select("lang", "block", "chunk", F.lit(None).cast("string").alias("term"), number("code"), F.col("z").alias("p"), "v", "rows")
    unit = ["lang", "block", "chunk"]
    units = postings.unionByName(heads).repartition(*unit).sortWithinPartitions(*unit, F.asc_nulls_first("term"), "code")
    pairs = accumulated(units).groupBy("lang", "low", "high").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("low").alias("a"), F.col("high").alias("b")), F.struct(F.col("high").alias("a"), F.col("low").alias("b"))))
    ways = pairs.select("lang", ways.alias("way"), "value").select("lang", "way.*", "value")
    names = groups.select("lang", F.col("code").cast("long").alias("code"), "source")
    one = names.select("lang", F.col("code").alias("a"), "source")
    other = names.select("lang", F.col("code").alias("b"), F.col("source").alias("item"))
    return ways.join(one, ["lang", "a"]).join(other, ["lang", "b"]).select("lang", "source", "item", "value")


def term_values(kept: DataFrame, groups: DataFrame, smoothing: int, scale: int) -> DataFrame:
    """(lang, source, item, value) for every term that a group uses more than its lang does."""
    joined = kept.join(groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n"), ["lang", "source"])
    p, q = proportion("n", "group_n", "v", smoothing, scale), proportion("total", "lang_n", "v", smoothing, scale)
    return joined.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top_terms: int = TOP_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` holds all peers, part `term` the top_terms terms."""
    kept = materialize(kept_terms(docs, min_docs), "kept-terms")
    groups = materialize(group_table(docs, kept, smoothing, scale), "groups")
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pair_values(kept, groups, smoothing, scale).withColumn("rank", place)
    terms = term_values(kept, groups, smoothing, scale).withColumn("rank", place).filter(F.col("rank") <= top_terms)
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.withColumn("part", F.lit("pair")).select(*columns).unionAll(terms.withColumn("part", F.lit("term")).select(*columns))
