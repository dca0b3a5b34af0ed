"""Phrase collocations: for each lang the phrases whose words come together more often than apart.

Phrases of 1 to `longest` words are counted in three passes, of which each leaves out what can't be frequent: words;
pairs of frequent words; longer phrases of frequent pairs. What is frequent is broadcast as a bitmap of fixed
size; its false positives are counted in vain and change nothing. In a task phrases are counted in a
HAT-trie of word ids for each lang (`hattrie`); where it holds too much, whole subtrees leave as sorted runs.
Runs are merged per prefix partition: a row goes where the first ``PREFIX`` words of its phrase belong,
so that runs of one prefix meet, and a frequent word or pair of words is spread over its continuations.

A candidate is a phrase of 2 words or more with a = f(phrase) >= min_count. Cutting it after its first k words
gives l = f(first part), r = f(rest) and a score of floor(scale * a / (l + r)); the lowest score counts, the
smallest k among equal ones. A candidate inside a longer one, kept or not, with 100 * f(longer) >= 80 * a goes.

Defined results: texts are split at ``BREAKS`` into pieces, pieces at space and tab into words, A to Z in lower
case; a null text is empty; a null lang is `und`; repeated rows count as further documents; a text of any length
is read whole; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bitmap import bitmap
from .hattrie import WORD_BITS, HatTrie, word_at
from .storage import materialize
from .text import LOWER, U, Words, binary, gather, grams, mix, slices, span_hashes, utf8, _table

MIN_COUNT, LONGEST, SCALE, COVERED, TOP = 30, 4, 2_000_000, 80, 2000
FILTER_BITS, PREFIX, PREFIXES = 26, 3, 1 << 20
#: Phrases that a task's tries hold, and distinct words it numbers, before they leave.
MOST_PHRASES, MOST_WORDS = 3 << 19, 1 << 20
#: Bytes of words that a task numbers, and of phrases that leave together.
MOST_BYTES = 1 << 26
BREAKS = _table(b".,;:!?\n\x0b\x0c\r")
BETWEEN = BREAKS | _table(b" \t")
ROWS = 1 << 16


def text_hashes(column: pa.Array) -> np.ndarray:
    """A hash of each string of an Arrow column."""
    data, offsets = utf8(column)
    return span_hashes(data, offsets[:-1], offsets[1:]) if len(column) else np.zeros(0, np.uint64)


class Vocabulary:
    """Ids from 1 on of a task's words, and phrases of ids as text."""

    def __init__(self):
        self.ids, self.words, self.size = {}, [], 0

    def number(self, words: pa.Array) -> np.ndarray:
        coded = words.dictionary_encode()
        distinct, known = coded.dictionary.to_pylist(), self.ids
        ids = [*map(known.get, distinct)]
        if None in ids:
            for i, own in enumerate(ids):
                if own is None:
                    ids[i] = known[distinct[i]] = len(known) + 1
                    self.words.append(distinct[i])
                    self.size += len(distinct[i])
        return np.array(ids, np.uint64)[coded.indices.to_numpy()]

    def spaced(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All words with a space behind each, and where they begin and how long they are there, by id."""
        lengths = np.concatenate([[0], np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1])
        return np.frombuffer(b" ".join(self.words) + b" ", np.uint8), np.cumsum(lengths) - lengths, lengths


def phrases(keys: np.ndarray, spaced: tuple[np.ndarray, np.ndarray, np.ndarray], longest: int) -> pa.Array:
    data, starts, lengths = spaced
    ids = np.stack([word_at(keys, depth).astype(np.int64) for depth in range(longest)], axis=1)
    own, size = lengths[ids], (ids > 0).sum(axis=1)
    own[np.arange(len(ids)), size - 1] -= 1  # no space behind the last word
    offsets = np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32)
    text = data[gather(starts[ids.ravel()], own.ravel())]
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(offsets), pa.py_buffer(text)])


class Counter:
    """What a task counts: a trie for each lang over one vocabulary, and words by lang."""

    def __init__(self, sizes: tuple[int, ...]):
        self.sizes, self.tries, self.totals, self.vocabulary = sizes, {}, {}, Vocabulary()

    def _rows(self, lang: str, runs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        spaced = None
        for keys, counts in runs:
            spaced = spaced or self.vocabulary.spaced()
            longest = spaced[2][word_at(keys, 0).astype(np.int64)]
            for depth in range(1, max(self.sizes)):
                longest = longest + spaced[2][word_at(keys, depth).astype(np.int64)]
            step = int(max(1, min(ROWS, MOST_BYTES // longest.max())))
            for i in range(0, len(keys), step):
                part = keys[i : i + step]
                columns = {"lang": pa.array([lang] * len(part), pa.string()), "phrase": phrases(part, spaced, max(self.sizes)), "n": pa.array(counts[i : i + step])}
                yield pa.RecordBatch.from_pydict(columns)

    def add(self, lang: str, ids: np.ndarray, joins: np.ndarray, frequent: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Count phrases of one lang's consecutive words.

        joins says whether a word goes on with the next one in its piece, frequent whether the word (where words
        are counted or paired) or the word with the next one (where longer phrases are) may be.
        """
        trie = self.tries.setdefault(lang, HatTrie(MOST_PHRASES))
        self.totals[lang] = self.totals.get(lang, 0) + len(ids)
        padded = np.concatenate([ids, np.zeros(4, np.uint64)])
        for size in self.sizes:
            good, n = frequent.copy(), len(ids)
            if size == 2:
                good &= joins & np.append(frequent[1:], False)
            for k in range(1, size - 1) if size > 2 else ():
                good[: n - k] &= frequent[k:]
                good[max(0, n - k) :] = False
            at = np.flatnonzero(good)
            keys = np.zeros((len(at), 2), np.uint64)
            for k in range(size):
                keys[:, k // 2] |= padded[at + k] << (WORD_BITS if k % 2 == 0 else U(0))
            trie.add(keys)
        yield from self._rows(lang, trie.spill())

    def relieve(self) -> Iterator[pa.RecordBatch]:
        """What the tries of all langs hold together stays bounded, and so does the vocabulary."""
        if len(self.vocabulary.ids) > MOST_WORDS or self.vocabulary.size > MOST_BYTES or sum(t.root.size() for t in self.tries.values()) > 2 * MOST_PHRASES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for lang, trie in self.tries.items():
            yield from self._rows(lang, trie.flush())
        self.tries, self.vocabulary = {}, Vocabulary()


def counted(docs: DataFrame, sizes: tuple[int, ...], frequent: Broadcast | None) -> DataFrame:
    """(lang, phrase, n) of phrases of these sizes; where words are counted, also their sum under an empty phrase."""

    def task(batches):
        counter, single = Counter(sizes), sizes == (1,)
        for batch in batches:
            data, offsets = utf8(batch.column("text"))
            langs = batch.column("lang").dictionary_encode()
            names, code = langs.dictionary.to_pylist(), langs.indices.to_numpy()
            salt = text_hashes(langs.dictionary)
            for i, j in slices(offsets):
                words = Words(LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i], BETWEEN)
                if not len(words):
                    continue
                own = code[i:j][words.document()]
                piece = np.cumsum(BREAKS[words.data])[words.starts]
                joins = np.zeros(len(words), bool)
                joins[:-1] = (piece[1:] == piece[:-1]) & (words.left()[:-1] > 1)
                good = np.ones(len(words), bool)
                if frequent is not None:
                    hashes = mix(words.hashes() ^ salt[own])
                    if sizes == (2,):
                        good = frequent.value.holds(hashes)
                    else:
                        good = joins.copy()
                        good[:-1] &= frequent.value.holds(grams(hashes, 2))
                # Only words of phrases that are counted get a number.
                used = good if max(sizes) < 3 else good | np.append(False, good[:-1])
                used = np.flatnonzero(used)
                ids = np.zeros(len(words), np.uint64)
                ids[used] = counter.vocabulary.number(binary(words.data, words.starts[used], (words.ends - words.starts)[used]))
                for c in np.unique(own).tolist():
                    mine = np.flatnonzero(own == c)
                    yield from counter.add(names[c], ids[mine], joins[mine], good[mine])
                yield from counter.relieve()
        yield from counter.flush()
        if single:
            totals = counter.totals
            yield pa.RecordBatch.from_pydict({"lang": pa.array(list(totals), pa.string()), "phrase": pa.array([b""] * len(totals), pa.binary()), "n": pa.array(list(totals.values()), pa.int64())})

    rows = docs.select("text", "lang").mapInArrow(task, "lang string, phrase binary, n long")
    rows = rows.withColumn("phrase", F.col("phrase").cast("string"))
    prefix = F.pmod(F.xxhash64("lang", F.substring_index("phrase", " ", PREFIX)), F.lit(PREFIXES)).cast("int")
    return rows.withColumn("prefix", prefix).repartition("prefix").groupBy("prefix", "lang", "phrase").agg(F.sum("n").alias("n")).drop("prefix")


def marked(spark, frequent: DataFrame, size: int) -> Broadcast:
    """The bitmap of these phrases of one size, by the hashes that tasks compute."""

    def task(batches):
        for batch in batches:
            words = Words(*utf8(batch.column("phrase")), _table(b" "))
            hashes = mix(words.hashes() ^ text_hashes(batch.column("lang"))[words.document()])
            hashes = hashes if size == 1 else grams(hashes, 2)[::2]
            yield pa.RecordBatch.from_pydict({"hash": pa.array(hashes.view(np.int64))})

    return spark.sparkContext.broadcast(bitmap(frequent.select("lang", "phrase").mapInArrow(task, "hash long"), "hash", FILTER_BITS))


def frequent_phrases(docs: DataFrame, min_count: int, longest: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f) of all frequent phrases up to the longest, and (lang, n) with the words of each lang."""
    texts = docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    spark = docs.sparkSession
    words = materialize(counted(texts, (1,), None).filter((F.col("n") >= min_count) | (F.col("phrase") == "")), "words")
    totals, words = words.filter("phrase = ''").select("lang", "n"), words.filter("phrase <> ''")
    pairs = materialize(counted(texts, (2,), marked(spark, words, 1)).filter(F.col("n") >= min_count), "pairs")
    out = words.unionAll(pairs)
    if longest > 2:
        sizes = tuple(range(3, longest + 1))
        out = out.unionAll(materialize(counted(texts, sizes, marked(spark, pairs, 2)).filter(F.col("n") >= min_count), "longer"))
    return out.withColumnRenamed("n", "f"), totals


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each lang's first `top` candidates; longest is at most 4 words."""
    frequent, totals = frequent_phrases(docs, min_count, longest)
    words = F.split("phrase", " ")
    candidates = frequent.withColumn("words", words).filter(F.size("words") > 1).withColumn("size", F.size("words"))
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cuts = candidates.select("lang", "phrase", "words", "size", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(frequent.select("lang", F.col("phrase").alias(side), F.col("f").alias(name)), ["lang", side])
    score = F.expr(f"cast({SCALE} AS DECIMAL(12, 0)) * cast(a AS DECIMAL(20, 0)) DIV cast(l + r AS DECIMAL(20, 0))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(lowest.alias("cut")).select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    # What lies inside a longer candidate, with the count of the most frequent such one.
    spans = F.expr("flatten(transform(sequence(2, size - 1), n -> transform(sequence(1, size - n + 1), i -> array_join(slice(words, i, n), ' '))))")
    inside = candidates.filter("size > 2").select("lang", F.explode(spans).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR longer * CAST(100 AS DECIMAL(3, 0)) < a * CAST({COVERED} AS DECIMAL(3, 0))"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
