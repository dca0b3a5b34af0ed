"""Approximate nearest neighbours by cosine: forests of random-projection trees, exact reranking.

All trees share their top: a routing tree, fitted on a bounded sample (``SAMPLE`` distinct vectors, lowest
hashes first), which deals every row into a cell of about ``CELL_ROWS`` vectors. Below, each cell grows
``TREES`` trees of its own down to leaves of ``LEAF`` vectors. A level splits along the difference of two
random vectors, each node at the median. A query walks all trees of a cell through one priority queue,
always on at the node least far off (by the root of the sum of squared margins on the way), and ranks the members of the leaves it comes to by exact
cosines. It stops when the leaves held ``LEAST`` + ``MEET`` * n ** ``GROWTH`` of a cell's n vectors, or earlier, where all
that is left is farther off than ``REACH`` standard deviations of what a neighbour nearer than the k found
so far differs along a random direction. First it does so in the cell it falls in; then, with what it has found, in
the next cells of the routing tree within that same reach, ``ROUTES`` * cells ** ``GROWTH`` at most.

So work and traffic grow slower than the rows: a query sends its vector to some cells, vectors move twice
(once a phase), and what is met in a cell grows as n ** ``GROWTH``. The exact way is ``exact=True``, which
visits every leaf of every cell.

Equal vectors are indexed once, with their k + 1 least ids, which is all that k neighbours can need; so a
vector that a third of the rows share costs one row. Cells that get over twice ``CELL_ROWS`` vectors are
dealt in chunks, each with a forest of its own, and their queries to every chunk.

Defined results: rows with a null id, null or zero vectors, null or non-finite components, or another
number of components than most take no part; rows alike in id and vector count once; with fewer than k
other vectors a query returns what there is; other columns are ignored.
"""

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize
from .training import train

K = 5
TREES, LEAF = 64, 8
SAMPLE, CELL_ROWS = 32_768, 32_768
LEAST, MEET, GROWTH, REACH, ROUTES = 300, 3.2, 0.75, 1.0, 1.5
#: Leaves whose members are ranked together, before the search asks whether to go on.
ROUND = 48


class Forest:
    """Complete trees over unit vectors: a direction for each level of a tree, a threshold for each node."""

    def __init__(self, unit: np.ndarray, trees: int, depth: int, seed: int = 5):
        n, size = unit.shape
        self.depth, draw = depth, np.random.default_rng(seed)
        directions = draw.standard_normal((trees, depth, size)).astype(np.float32)
        if n > 1:
            apart = unit[draw.integers(n, size=(trees, depth))] - unit[draw.integers(n, size=(trees, depth))]
            directions = np.where((np.abs(apart).sum(2) > 1e-3)[:, :, None], apart, directions)
        self.directions = directions / np.linalg.norm(directions, axis=2, keepdims=True)
        self.thresholds = np.zeros((trees, 1 << depth), np.float32)
        for tree in range(trees):
            node = np.ones(n, np.int64)
            for along in (unit @ self.directions[tree].T).T:
                order = np.lexsort((along, node))
                nodes, begins, sizes = np.unique(node[order], return_index=True, return_counts=True)
                self.thresholds[tree, nodes] = along[order[begins + (sizes - 1) // 2]]
                node = 2 * node + (along > self.thresholds[tree, node])

    def leaves(self, unit: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.empty((len(self.thresholds), len(unit)), np.int64)
        for tree, thresholds in enumerate(self.thresholds):
            node = np.ones(len(unit), np.int64)
            for along in (unit @ self.directions[tree].T).T:
                node = 2 * node + (along > thresholds[node])
            out[tree] = node - (1 << self.depth)
        return out

    def walk(self, unit: np.ndarray) -> Iterator[tuple[float, int, int]]:
        """(how far off, tree, leaf) of one query, nearest first: all trees share the queue."""
        along, thresholds, inner = (self.directions @ unit).tolist(), self.thresholds, 1 << self.depth
        queue = [(0.0, tree, 1) for tree in range(len(thresholds))]
        while queue:
            square, tree, node = heapq.heappop(queue)
            level = node.bit_length() - 1
            while node < inner:
                margin = along[tree][level] - float(thresholds[tree, node])
                right = margin > 0
                heapq.heappush(queue, (square + margin * margin, tree, 2 * node + (not right)))
                node, level = 2 * node + right, level + 1
            yield square**0.5, tree, node - inner


class Cell:
    """The vectors of one cell with their forest."""

    def __init__(self, uid: np.ndarray, vectors: np.ndarray):
        self.uid, self.vectors = uid, vectors
        self.length = np.sqrt((vectors * vectors).sum(1))
        self.unit = units(vectors)
        n = len(uid)
        self.forest = Forest(self.unit, TREES, max(0, int(np.ceil(np.log2(max(1, n / LEAF))))))
        leaves = self.forest.leaves(self.unit)
        self.members = np.argsort(leaves, axis=1, kind="stable").astype(np.int32)
        counts = [np.bincount(x, minlength=1 << self.forest.depth) for x in leaves]
        self.begins = np.concatenate([np.zeros((TREES, 1), np.int64), np.cumsum(counts, axis=1)], axis=1)
        self.met = np.zeros(n, bool)
        #: Cosines computed so far.
        self.n_cosines = 0

    def nearest(self, query: np.ndarray, keep: int, reach: float | None, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """uids and cosines of the nearest found; a neighbour farther than limit (of unit vectors) is no use."""
        unit = units(query[None])[0]
        most = LEAST + MEET * len(self.uid) ** GROWTH if reach is not None else np.inf
        walk, found, near, n_met = self.forest.walk(unit), [], np.zeros(0, np.float32), 0
        while n_met < most:
            parts, bound = [], None
            for bound, tree, leaf in walk:
                parts.append(self.members[tree, self.begins[tree, leaf] : self.begins[tree, leaf + 1]])
                if len(parts) == ROUND:
                    break
            if not parts:
                break
            some = np.concatenate(parts)
            n_met += len(some)
            some = np.unique(some[~self.met[some]])
            self.met[some] = True
            found.append(some)
            self.n_cosines += len(some)
            close = self.unit[some] @ unit
            near = np.concatenate([near, close])
            if len(near) > keep:
                near = near[np.argpartition(-near, keep - 1)[:keep]]
            if reach is not None:
                if len(near) == keep:
                    limit = min(limit, float(np.sqrt(max(0.0, 2 - 2 * near.min()))))
                if bound > reach * limit / np.sqrt(len(unit)):
                    break
        some = np.concatenate(found)
        self.met[some] = False
        close = self.unit[some] @ unit
        if len(some) > keep:  # what single precision may confuse with the last one stays in
            some = some[close >= np.partition(close, len(close) - keep)[len(close) - keep] - 1e-5]
        a, b = query, self.vectors[some]
        cosine = (b * a).sum(1) / (np.sqrt((a * a).sum()) * self.length[some])
        best = np.lexsort((self.uid[some], -cosine))[:keep]
        return self.uid[some[best]], cosine[best]


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def units(vectors: np.ndarray) -> np.ndarray:
    return (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)


def valid(rows: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    v = F.col(vector_column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.filter(F.col(id_column).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)).select(F.col(id_column).alias("id"), v.alias("vector"))
    size = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").first()
    return rows.filter(F.size("vector") == (size["size"] if size else 0))


def route(distinct: DataFrame, cell_rows: int) -> bytes:
    """The routing tree over all distinct vectors, fitted on a bounded sample of them."""
    n = distinct.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / cell_rows)))))
    depth = min(depth, int(np.log2(SAMPLE / 32)))

    def fit(batches) -> bytes:
        parts = [units(matrix(b.column("vector"))) for b in batches if b.num_rows]
        return pickle.dumps(Forest(np.concatenate(parts), 1, depth) if parts else None)

    return train(distinct.orderBy("hash", "uid").limit(SAMPLE).select("vector"), fit)


def _in_cells(members: DataFrame, visits: DataFrame, cell_rows: int, keep: int, exact: bool) -> DataFrame:
    """(quid, uid, score) of what queries (quid, cell, cut: a cosine that results must reach) find in cells."""
    # As many cells as the routing tree has at most: a bound that parameters set.
    large = members.groupBy("cell").count().filter(F.col("count") > 2 * cell_rows).select("cell", F.ceil(F.col("count") / cell_rows).cast("int").alias("chunks"))
    large = F.broadcast(materialize(large, "cells"))
    n_chunks = F.coalesce("chunks", F.lit(1))
    members = members.join(large, "cell", "left").select("cell", F.pmod(F.xxhash64("uid"), n_chunks).cast("int").alias("chunk"), F.lit(0).alias("query"), "uid", "vector", F.lit(0.0).alias("cut"))
    visits = visits.join(large, "cell", "left").select("cell", F.explode(F.sequence(F.lit(0), n_chunks - 1)).alias("chunk"), F.lit(1).alias("query"), F.col("quid").alias("uid"), "vector", "cut")
    groups = members.unionAll(visits).repartition("cell", "chunk").sortWithinPartitions("cell", "chunk", "query")

    def task(batches):
        group, held_ids, held, cell = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            number, chunk, query = (batch.column(c).to_numpy() for c in ("cell", "chunk", "query"))
            uid, cut, vectors = batch.column("uid").to_numpy(), batch.column("cut").to_numpy(), matrix(batch.column("vector"))
            new = np.flatnonzero((number[1:] != number[:-1]) | (chunk[1:] != chunk[:-1]) | (query[1:] != query[:-1])) + 1
            out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
            for i, j in zip([0, *new], [*new, batch.num_rows]):
                if (number[i], chunk[i]) != group:
                    group, held_ids, held, cell = (number[i], chunk[i]), [], [], None
                if not query[i]:
                    held_ids.append(uid[i:j]), held.append(vectors[i:j])
                elif held:
                    cell = cell or Cell(np.concatenate(held_ids), np.concatenate(held))
                    for k in range(i, j):
                        ids, score = cell.nearest(vectors[k], keep, None if exact else REACH, float(np.sqrt(max(0.0, 2 - 2 * cut[k]))))
                        for part, values in zip(out, (np.full(len(ids), uid[k]), ids, score)):
                            part.append(values)
            yield pa.RecordBatch.from_pydict({name: pa.array(np.concatenate(part)) for name, part in zip(("quid", "uid", "score"), out)})

    return groups.mapInArrow(task, "quid long, uid long, score double")


def search(rows: DataFrame, is_query, id_column: str = "vec_id", vector_column: str = "embedding", k: int = K, cell_rows: int = CELL_ROWS, exact: bool = False) -> DataFrame:
    """query_id, rank (from 1), id and score of the k nearest found; is_query is a condition on the column id."""
    rows = valid(rows, id_column, vector_column)
    by_vector = Window.partitionBy("vector").orderBy("id")
    ids = rows.withColumn("rank", F.dense_rank().over(by_vector)).filter(F.col("rank") <= k + 1)
    distinct = ids.groupBy("vector").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    distinct = materialize(distinct.select(F.col("ids")[0].alias("uid"), F.xxhash64("vector").alias("hash"), "vector", "ids"), "vectors")
    asked = materialize(rows.filter(is_query).withColumn("hash", F.xxhash64("vector")).join(distinct, ["hash", "vector"]).select(F.col("id").alias("query_id"), "uid").distinct(), "queries")
    model = route(distinct, cell_rows)
    keep, kind = k + 1, distinct.schema["vector"].dataType.simpleString()
    tree = pickle.loads(model)
    n_cells = 1 << tree.depth if tree else 1
    n_routes = n_cells if exact else min(n_cells, int(np.ceil(ROUTES * n_cells**GROWTH)))

    def deal(batches):
        tree = pickle.loads(model)
        for batch in batches:
            if batch.num_rows:
                cells = tree.leaves(units(matrix(batch.column("vector"))))[0]
                yield pa.RecordBatch.from_pydict({"cell": pa.array(cells), "uid": batch.column("uid"), "vector": batch.column("vector")})

    def others(batches):
        tree = pickle.loads(model)
        for batch in batches:
            if batch.num_rows:
                vectors, cuts = units(matrix(batch.column("vector"))), batch.column("cut").to_numpy()
                chosen = []
                for unit, cut in zip(vectors, cuts):
                    limit = np.inf if exact else REACH * np.sqrt(max(0.0, 2 - 2 * cut) / len(unit))
                    cells = [leaf for _, (bound, _, leaf) in zip(range(n_routes), tree.walk(unit)) if bound <= limit]
                    chosen.append(cells[1:])  # the first is its own
                row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in chosen]))
                yield pa.RecordBatch.from_pydict({"cell": pa.array([c for x in chosen for c in x], pa.int64())} | {c: batch.column(c).take(row) for c in ("quid", "vector", "cut")})

    members = distinct.select("uid", "vector").mapInArrow(deal, f"cell long, uid long, vector {kind}")
    queries = members.join(asked.select("uid").distinct(), "uid").select(F.col("uid").alias("quid"), "cell", "vector")
    found = _in_cells(members, queries.withColumn("cut", F.lit(-1.0)), cell_rows, keep, exact)
    if n_routes > 1:
        found = materialize(found, "found")
        # The k-th other vector's cosine, if there are so many (the query's own vector is among keep = k + 1).
        kth = found.groupBy("quid").agg(F.when(F.count("*") == keep, F.min("score")).otherwise(-1.0).alias("cut"))
        routed = queries.join(kth, "quid").select("quid", "vector", "cut").repartition("quid").mapInArrow(others, f"cell long, quid long, vector {kind}, cut double")
        found = found.unionAll(_in_cells(members, routed, cell_rows, keep, exact))
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "uid")
    pairs = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)
    listed = pairs.join(distinct.select("uid", "ids"), "uid").select("quid", "score", F.explode("ids").alias("id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    answers = listed.join(asked.withColumnRenamed("uid", "quid"), "quid").filter("id <> query_id")
    return answers.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")
