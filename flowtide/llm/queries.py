"""The operators as registered queries over the given tables: thin, with production parameters."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SHARDS = 40
BATCH_ROWS, BATCH_BYTES = 2000, 1 << 20


def bound_batches(spark: SparkSession) -> None:
    """Rows and bytes of whole texts that Spark hands to a Python worker at a time (by default 10,000 and 64 MB).

    An executor holds each batch outside of its heap, on its way out and, with more columns, on its way back.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    rows = sharding.shuffle_into_shards(documents(spark, sf_dir), N_SHARDS)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    return rows.select("doc_id", (sharding.text_bytes() + sharding.ROW_BYTES).alias("size"), crc.alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality, training

    docs = documents(spark, sf_dir)
    scored = quality.score_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(training.fold("doc_id", quality.FOLDS) == 0, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contaminated documents with the items found in them."""
    from . import decontaminate

    return decontaminate.contaminated(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")).drop("text_hash")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import urlfilter

    return urlfilter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "block_score")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import toxicity, training

    docs = documents(spark, sf_dir)
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(training.fold("doc_id", toxicity.FOLDS) == toxicity.HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_token_files(spark: SparkSession, sf_dir: str, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2) -> DataFrame:
    import public_tokenizers

    from . import tokenfiles

    manifest = tokenfiles.write_token_files(documents(spark, sf_dir), public_tokenizers.path(tokenizer), end_id)
    read = tokenfiles.read_token_files(manifest)
    return read.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def op6_nearest(spark: SparkSession, sf_dir: str, every: int = 50) -> DataFrame:
    from . import ann

    found = ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % every == 0)
    return found.withColumnRenamed("id", "vec_id")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import substring

    return substring.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    return simhash.near_duplicates(documents(spark, sf_dir))


def _digests(docs: DataFrame, ranks: str) -> DataFrame:
    import public_tokenizers

    from . import bpe

    coded = bpe.encode(docs.select("doc_id", "text"), public_tokenizers.path(ranks), public_tokenizers.PATTERN, decoded=True)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    return _digests(documents(spark, sf_dir), ranks)


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import divergence

    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import phrases

    return phrases.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


def op13_byte_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import bytededup

    return bytededup.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def packed(docs: DataFrame, operator, *more: str) -> DataFrame:
    """An operator's rows with the columns of docs, of which those besides doc_id and text travel in one struct.

    So a caller's columns survive that are named like the operator's own.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    narrow = docs.select("doc_id", "text", F.struct(F.lit(0).alias("__"), *others).alias("__row"))
    columns = [c if c in ("doc_id", "text") else F.col("__row")[c].alias(c) for c in docs.columns]
    return operator(narrow).select(*columns, *more)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    from . import quality

    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return packed(docs, lambda d: quality.score_quality(d, model).filter("predicted = 1"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-copies: five-word shingles, similarity 0.8 or more."""
    from . import nearcopies

    bound_batches(spark)
    return nearcopies.keep_one(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with words of repeated windows cut from their texts and n_chars as it is then."""
    from . import substring

    bound_batches(spark)
    kept = packed(docs, lambda d: substring.remove_repeats(d).withColumn("__cut", F.col("n_removed") > 0), "__cut")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("__cut"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return kept.select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    from . import decontaminate

    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of every document that is left."""
    bound_batches(spark)
    return _digests(docs, "byte_bpe_multi_50k.tiktoken")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substring_dedup", substring_stage),
    ("decontamination", decontamination_stage),
    ("encoding", encoding_stage),
]

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality": op2_quality,
    "op3_decontaminate": op3_decontaminate,
    "op4_url_filter": op4_url_filter,
    "op5_token_files": op5_token_files,
    "op6_nearest": op6_nearest,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_divergence": op11_divergence,
    "op12_collocations": op12_collocations,
    "op13_byte_dedup": op13_byte_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op7_substring_dedup": r"""
WITH lists AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM lists),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM starts),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, i + k AS pos FROM windows JOIN repeated USING (s), (SELECT unnest(range(0, 35)) AS k) AS offsets),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM lists),
kept AS (
  SELECT words.doc_id, count(*) AS n_words, count(covered.pos) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY words.pos) FILTER (covered.pos IS NULL), '') AS text
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id AND covered.pos = words.pos GROUP BY words.doc_id
)
SELECT lists.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM lists LEFT JOIN kept ON kept.doc_id = lists.doc_id
""",
    # All groups of a lang by all its kept terms, zeros included.
    "op11_divergence": r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(w)) AS term FROM d) GROUP BY lang, term HAVING count(*) >= 30),
counts AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(w) AS term FROM d) JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, CAST(count(*) AS HUGEINT) AS v FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
sums AS (SELECT lang, source, coalesce(sum(n), 0) AS total FROM groups LEFT JOIN counts USING (lang, source) GROUP BY lang, source),
p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(n, 0) + 5)) // (total + 5 * v) AS p
  FROM sums JOIN sizes USING (lang) JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)
),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM counts JOIN sizes USING (lang) GROUP BY lang, term),
distances AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0) AS value FROM groups AS a JOIN groups AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN distances AS x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs UNION ALL SELECT lang, source, 'term', item, value FROM terms),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op12_collocations": r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
grams AS (SELECT lang, w, i, unnest(range(1, least(4, len(w) - i + 1) + 1)) AS k FROM starts),
counts AS MATERIALIZED (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, count(*) AS f FROM grams GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE k = 1 GROUP BY lang),
frequent AS MATERIALIZED (SELECT lang, phrase, k, CAST(f AS HUGEINT) AS f, string_split(phrase, ' ') AS w FROM counts WHERE f >= 30),
cuts AS (SELECT lang, phrase, f, w, k, unnest(range(1, k)) AS cut FROM frequent WHERE k > 1),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, c.cut, x.f AS l, y.f AS r, (2000000 * c.f) // (x.f + y.f) AS score
  FROM cuts AS c JOIN frequent AS x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN frequent AS y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:c.k], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
lengths AS (SELECT lang, w, k, f, unnest(range(2, k)) AS n FROM frequent WHERE k > 2),
places AS (SELECT lang, w, f, n, unnest(range(1, k - n + 2)) AS i FROM lengths),
inside AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(f) AS longer FROM places GROUP BY ALL),
kept AS (SELECT s.* FROM lowest AS s LEFT JOIN inside AS o ON o.lang = s.lang AND o.phrase = s.phrase WHERE longer IS NULL OR 100 * longer < 80 * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
""",
    # Bytes are two hexadecimal digits each; pieces lie between the maximal runs that windows cover.
    "op13_byte_dedup": r"""
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 399, 200)) AS base FROM texts),
parts AS MATERIALIZED (SELECT doc_id, base, substr(h, 2 * base + 1, 1198) AS p FROM blocks),
starts AS (SELECT doc_id, base, p, unnest(range(0, length(p) // 2 - 399)) AS k FROM parts),
windows AS (SELECT doc_id, base + k AS i, md5(substr(p, 2 * k + 1, 800)) AS s FROM starts),
repeated AS (SELECT s FROM windows GROUP BY s HAVING count(*) > 1),
found AS (SELECT doc_id, i FROM windows SEMI JOIN repeated USING (s)),
opened AS (SELECT doc_id, i, i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400, -1) AS opens FROM found),
numbered AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM opened),
runs AS (SELECT doc_id, min(i) AS low, max(i) + 400 AS high FROM numbered GROUP BY doc_id, run),
edges AS (SELECT doc_id, 0 AS low, 0 AS high FROM texts UNION ALL SELECT doc_id, low, high FROM runs),
kept AS (SELECT doc_id, high AS a, lead(low) OVER (PARTITION BY doc_id ORDER BY high) AS b FROM edges),
pieces AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, 2 * (coalesce(b, length(h) // 2) - a)), '' ORDER BY a) AS rest FROM kept JOIN texts USING (doc_id) GROUP BY doc_id),
spans AS (SELECT doc_id, sum(high - low) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(rest)) AS kept_sha256
FROM texts JOIN pieces USING (doc_id) LEFT JOIN spans USING (doc_id)
""",
}
