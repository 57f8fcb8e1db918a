"""Text quality by a sparse rule ensemble over text statistics.

1. `statistics` measures every whole text: shares of character classes, word shape, repetition.
2. `fit` grows small regression trees on the logistic gradient of a bounded sample of labelled rows, takes
   every path from a root as a rule (a conjunction of thresholds), and fits one weight a rule by logistic
   regression with an L1 penalty (proximal gradient), which leaves a sparse ensemble.
3. `score_column` compiles the ensemble into one Spark column over the statistics.

Labels, language, source and id are never inputs of a score. Defined results: a null text is an empty text;
without usable labels every text scores 0.5; with labels of one kind only, that kind's smoothed share.
Several labels of one id count as their mean, rounded at one half; null labels count nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lakeloom.llm._durable import written
from lakeloom.llm._text import U64, shingle_hashes, slices, span_hashes, word_spans

#: At most so many labelled rows are brought to the driver to fit on, those of least hash of their id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

_CLASSES = {"lower": b"abcdefghijklmnopqrstuvwxyz", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".", "comma": b",", "bang": b"!?", "bar": b"|", "hash": b"#", "dollar": b"$", "percent": b"%", "amp": b"&", "star": b"*", "quote": b"\"'", "bracket": b"()[]{}<>", "line": b"\n", "blank": b" \t", "other": b"-_=+/\\~^`@:;"}
_WORD = ("log_bytes", "log_words", "word_bytes", "same_as_last", "distinct", "twice_3", "symbol_end", "all_upper", "long_words", "short_words", "lines_again", "one_word_lines")
FEATURES = (*(f"c_{k}" for k in _CLASSES), "c_wide", *(f"w_{k}" for k in _WORD))
_TABLE = np.zeros((256, len(_CLASSES) + 1))
for _k, _set in enumerate(_CLASSES.values()):
    _TABLE[list(_set), _k] = 1
_TABLE[128:, -1] = 1
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*|!~^=@")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[list(_CLASSES["upper"])] = True


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct_by(hashes: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    seen = np.unique((doc.astype(U64) << U64(40)) | (hashes >> U64(24)))
    return np.bincount((seen >> U64(40)).astype(np.int64), minlength=docs).astype(np.float64)


def measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text between successive offsets."""
    docs = len(offs) - 1
    size = np.diff(offs)
    doc_of = np.repeat(np.arange(docs), size)
    seen = np.bincount(doc_of * 256 + data, minlength=256 * docs).reshape(docs, 256)
    chars = (seen @ _TABLE) / np.maximum(size, 1)[:, None]
    low, starts, ends, first = word_spans(data, offs)
    words = np.diff(first).astype(np.float64)
    some = np.maximum(words, 1)
    length = ends - starts
    h = span_hashes(low, starts, ends)
    doc = np.repeat(np.arange(docs), np.diff(first))
    again = np.zeros(len(h), dtype=bool)
    again[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    three = shingle_hashes(h, 3)
    inside = doc[: len(three)] == doc[2:] if len(three) else np.zeros(0, bool)
    grams = np.bincount(doc[: len(three)][inside], minlength=docs).astype(np.float64)
    upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
    shout = (upper[ends] - upper[starts]) * 2 > length
    lines = np.concatenate([[0], np.cumsum(low == 10)])
    line_of = lines[starts] + np.arange(0, docs)[doc]  # a new text begins a new line
    begin = np.flatnonzero(np.concatenate([[True], np.diff(line_of) != 0])) if len(starts) else np.zeros(0, np.int64)
    stop = np.concatenate([begin[1:], [len(starts)]]) if len(begin) else begin
    line_hash = span_hashes(low, starts[begin], ends[stop - 1]) if len(begin) else np.zeros(0, U64)
    line_doc = doc[begin]
    n_lines = np.bincount(line_doc, minlength=docs).astype(np.float64)
    lonely = np.bincount(line_doc, weights=(stop - begin == 1), minlength=docs)
    out = [
        np.log1p(size), np.log1p(words), _sum_by(length, first) / some, _sum_by(again, first) / some,
        _distinct_by(h, doc, docs) / some, 1 - _distinct_by(three[inside], doc[: len(three)][inside], docs) / np.maximum(grams, 1) * (grams > 0) - (grams == 0),
        _sum_by(_SYMBOL[low[ends - 1]], first) / some, _sum_by(shout & (length > 1), first) / some,
        _sum_by(length > 20, first) / some, _sum_by(length < 3, first) / some,
        1 - _distinct_by(line_hash, line_doc, docs) / np.maximum(n_lines, 1), lonely / np.maximum(n_lines, 1),
    ]
    return np.hstack([chars, np.stack(out, axis=1)])


def _measured(rows: DataFrame) -> DataFrame:
    """(kept, FEATURES...) of rows (kept, text); rows are independent and nothing is shuffled."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure(data, offs) for _, _, data, offs in slices(batch.column(1))]
            if parts:
                found = np.vstack(parts)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, k]) for k in range(len(FEATURES)))], ["kept", *FEATURES])

    schema = StructType([rows.schema["kept"], *(StructField(f, DoubleType()) for f in FEATURES)])
    return rows.mapInArrow(run, schema)


def statistics(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, FEATURES...) of each row."""
    return _measured(docs.select(docs[key].alias("kept"), docs[text].alias("text"))).withColumnRenamed("kept", "key")


Rule = tuple[tuple[int, bool, float], ...]  # (feature, is it above, threshold), all of which must hold


@dataclass
class Ensemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            z += weight * holds(rule, x)
        return z


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), dtype=bool)
    for k, above, t in rule:
        ok &= (x[:, k] > t) == above
    return ok


def _grow(bins: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, rows: np.ndarray, depth: int, least: int, path: Rule, out: list[Rule], step: np.ndarray) -> None:
    """A regression tree on the gradient by binned splits; every node but the root becomes a rule."""
    best, total, n = (1e-9, -1, -1), grad[rows].sum(), len(rows)
    if depth and n >= 2 * least:
        for k, edge in enumerate(edges):
            if not len(edge):
                continue
            b = bins[rows, k]
            below = np.cumsum(np.bincount(b, minlength=len(edge) + 1))[:-1]
            s = np.cumsum(np.bincount(b, weights=grad[rows], minlength=len(edge) + 1))[:-1]
            ok = (below >= least) & (n - below >= least)
            if ok.any():
                gain = np.where(ok, s**2 / np.maximum(below, 1) + (total - s) ** 2 / np.maximum(n - below, 1) - total**2 / n, 0)
                j = int(gain.argmax())
                if gain[j] > best[0]:
                    best = (float(gain[j]), k, j)
    if best[1] < 0:
        step[rows] = grad[rows].mean() if n else 0
        return
    _, k, j = best
    side = bins[rows, k] > j
    for above in (False, True):
        rule = (*path, (k, above, float(edges[k][j])))
        out.append(rule)
        _grow(bins, edges, grad, rows[side == above], depth - 1, least, rule, out, step)


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 3e-4, steps: int = 400) -> Ensemble:
    """Rules from boosted trees, and their lasso logistic weights."""
    n = len(y)
    if n == 0:
        return Ensemble()
    share = (y.sum() + 1) / (n + 2)
    start = float(np.log(share / (1 - share)))
    if y.min() == y.max():
        return Ensemble(start if n else 0.0)
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0.01, 0.99, 64))) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)
    z, rules = np.full(n, start), []
    for _ in range(trees):
        step = np.zeros(n)
        _grow(bins, edges, y - 1 / (1 + np.exp(-z)), np.arange(n), depth, max(5, n // 2000), (), rules, step)
        z += rate * 4 * step
    rules = list(dict.fromkeys(tuple(sorted(r)) for r in rules))
    if not rules:  # no statistic tells the labels apart
        return Ensemble(start)
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    mean, scale = a.mean(0), a.std(0) + 1e-9
    a = (a - mean) / scale
    w, bias = np.zeros(a.shape[1]), start
    v, vb, t = w.copy(), bias, 1.0
    lipschitz = 0.25 * (np.linalg.norm(a.T @ (a @ (u := np.ones(a.shape[1]) / np.sqrt(a.shape[1])))) + 1) / n
    for _ in range(20):  # power iteration for the largest curvature
        u = a.T @ (a @ u)
        lipschitz = max(lipschitz, 0.25 * (size := np.linalg.norm(u)) / n)
        u /= size + 1e-12
    lipschitz += 0.25
    for _ in range(steps):  # accelerated proximal gradient
        r = 1 / (1 + np.exp(-(a @ v + vb))) - y
        new = v - (a.T @ r / n) / lipschitz
        new = np.sign(new) * np.maximum(np.abs(new) - penalty / lipschitz, 0)
        new_bias = vb - r.mean() / lipschitz
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_bias + (t - 1) / t2 * (new_bias - bias)
        w, bias, t = new, new_bias, t2
    kept = [(r, float(c / s)) for r, c, s in zip(rules, w, scale) if c]
    return Ensemble(float(bias - (w * mean / scale).sum()), kept)


def score_column(model: Ensemble) -> Column:
    """The probability of label 1 as one expression over the statistics' columns."""
    z = F.lit(model.bias)
    for rule, weight in model.rules:
        test = None
        for k, above, t in rule:
            one = F.col(FEATURES[k]) > F.lit(t)
            one = one if above else ~one
            test = one if test is None else test & one
        z = z + F.when(test, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-z))


def labelled_sample(stats: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Statistics and labels of at most `rows` rows outside the held-out fifth, those of least hash of their id."""
    marks = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("mark"))
    marks = marks.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).select(F.col("doc_id").alias("key"), "mark")
    marked = stats.join(marks, "key")
    # a share of the hash space that holds about half again as many rows as wanted, so that only these are sorted and sent
    share = min(1.0, 1.5 * rows / max(1, marks.count()))
    near = marked.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    found = near.orderBy(F.pmod(F.xxhash64("key"), F.lit(1 << 30)), "key").limit(rows).select("mark", *FEATURES).toPandas().to_numpy(dtype=np.float64)
    return found[:, 1:], found[:, 0]


def classify(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) of every row of docs. Rows with a null key are not held out (they have no label either)."""
    stats = written(statistics(docs, key=key, text=text))
    model = fit(*labelled_sample(stats, labels, label, rows))
    out = stats.select(F.col("key").alias(key), F.coalesce(F.crc32(F.col("key").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), score_column(model).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score the threshold or more, all columns as they were.

    Statistics are taken twice, once to fit and once to decide: cheaper than to shuffle the texts to their scores.
    """
    stats = written(statistics(docs, key=key, text=text))
    model = fit(*labelled_sample(stats, labels, label, rows))
    measured = _measured(docs.select(F.struct("*").alias("kept"), docs[text].alias("text")))
    return measured.where(score_column(model) >= threshold).select("kept.*")
