"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: The words of a text that are compared without case (A-Z) and punctuation.
_WORDS = r"""list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2f\x3a-\x60\x7b-\x7f]+'), lambda x: x <> '')"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE of every whole document: ids, and the decoded bytes, as digests."""
    import public_tokenizers

    from lakeloom.llm import bpe

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


@query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of every whole document and the groups they form within two bits."""
    from lakeloom.llm import simhash

    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of every whole document by a sparse rule ensemble learnt from the labels."""
    from lakeloom.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item, with the item and its similarity."""
    from lakeloom.llm import decontam

    return decontam.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document: base spans, and those that context patterns discover."""
    from lakeloom.llm import pii

    return pii.report(table(spark, sf_dir, "documents"))


@query
def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every whole document, over a public vocabulary's pieces and scores."""
    import public_tokenizers

    from lakeloom.llm import unigram

    return unigram.count(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every twentieth vector among all vectors."""
    from lakeloom.llm import ann

    return ann.neighbours(table(spark, sf_dir, "embeddings"))


@query
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every whole page."""
    from lakeloom.llm import html_text

    return html_text.main_text(table(spark, sf_dir, "pages"))


@query
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every whole document by a class-based bigram model, and by word frequencies."""
    from lakeloom.llm import class_lm

    return class_lm.score(table(spark, sf_dir, "documents"))


@query
def op1_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every whole document without the passages that an earlier place has."""
    from lakeloom.llm import repeats

    return repeats.remove(table(spark, sf_dir, "documents"), with_text=False)


# Every window of 100 bytes, as hex: those that also start earlier, the runs that they cover, and the bytes in between.
ORACLE_SQL["op1_repeats"] = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d)),
r AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id * 4294967296 + p) OVER (PARTITION BY s) AS first FROM w) WHERE doc_id * 4294967296 + p <> first),
i AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM
  (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM r)),
runs AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM i GROUP BY doc_id, run),
ends AS (SELECT doc_id, a, b FROM runs UNION ALL SELECT doc_id, length(h) // 2, length(h) // 2 FROM d),
kept AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a, b), 0) AS since FROM ends)
SELECT k.doc_id, CAST(max(length(h)) // 2 AS BIGINT) AS n_bytes, CAST(sum(b - a) AS BIGINT) AS n_removed, CAST(count(*) - 1 AS BIGINT) AS n_spans,
sha256(unhex(string_agg(substr(h, CAST(2 * since + 1 AS BIGINT), CAST(2 * (a - since) AS BIGINT)), '' ORDER BY a, b))) AS kept_sha256 FROM kept k JOIN d USING (doc_id) GROUP BY k.doc_id"""

# Windows of an item's size that share a shingle with it, and their weighted-shingle similarity.
ORACLE_SQL["op2_decontamination"] = f"""WITH iw AS (SELECT item_id, w, len(w) AS n, least(5, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
dw AS (SELECT doc_id, w, len(w) AS len FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
ds AS (SELECT doc_id, len, k, p, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT *, unnest(range(0, len - k + 1)) AS p FROM dw, (SELECT DISTINCT k FROM iw))),
s AS (SELECT item_id, n, k, g, count(*) AS c FROM (SELECT item_id, n, k, array_to_string(w[p + 1:p + k], ' ') AS g FROM (SELECT *, unnest(range(0, n - k + 1)) AS p FROM iw)) GROUP BY ALL),
hits AS (SELECT doc_id, item_id, n, k, len, p, least(n, len) AS size FROM ds JOIN s USING (k, g)),
win AS (SELECT DISTINCT doc_id, item_id, n, k, size, unnest(range(greatest(p + k - size, 0), least(p, len - size) + 1)) AS a FROM hits),
met AS (SELECT win.doc_id, win.item_id, win.n, win.k, win.size, a, least(count(*), any_value(c)) AS common FROM win
  JOIN hits h ON h.doc_id = win.doc_id AND h.item_id = win.item_id AND h.p BETWEEN a AND a + win.size - win.k JOIN ds ON ds.doc_id = h.doc_id AND ds.k = h.k AND ds.p = h.p
  JOIN s ON s.item_id = win.item_id AND s.g = ds.g GROUP BY win.doc_id, win.item_id, win.n, win.k, win.size, a, ds.g),
sim AS (SELECT doc_id, item_id, size, a, CAST(sum(common) AS DOUBLE) / ((size - k + 1) + (n - k + 1) - sum(common)) AS similarity FROM met GROUP BY doc_id, item_id, n, k, size, a),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, a) AS place FROM sim WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, CAST(a AS BIGINT) AS start_word, CAST(size AS BIGINT) AS n_words FROM best WHERE place = 1"""
