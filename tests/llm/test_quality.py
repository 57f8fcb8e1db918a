import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import quality
from lakeloom.llm._text import slices

SF = "/root/testdata/sf0.01"


def measured(texts, limit=1 << 20):
    return np.vstack([quality.measure(d, o) for _, _, d, o in slices(pa.array(texts, pa.string()), limit)])


def test_statistics_of_known_texts():
    x = measured([None, "", "AB cd cd\ncd cd\nAB cd cd", "a### b$$$ ccc", "é" * 30, "\n\n \t"])
    f = {name: x[:, k] for k, name in enumerate(quality.FEATURES)}
    assert np.isfinite(x).all() and (x[0] == x[1]).all() and f["w_log_words"][0] == 0
    assert f["w_log_words"][2] == np.log1p(8) and f["w_same_as_last"][2] == pytest.approx(4 / 8) and f["w_distinct"][2] == pytest.approx(2 / 8)
    assert f["w_lines_again"][2] == pytest.approx(1 / 3) and f["w_all_upper"][2] == pytest.approx(2 / 8)
    assert f["w_symbol_end"][3] == pytest.approx(2 / 3) and f["c_hash"][3] == pytest.approx(3 / 13)
    assert f["c_wide"][4] == 1 and f["w_long_words"][4] == 1
    texts = ["x y z " * k for k in range(1, 40)] + ["Q w\n" * 9, None]
    assert np.allclose(measured(texts, 60), measured(texts))  # batches don't matter


def test_fit_is_sparse_and_compiles_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality.FEATURES)))
    y = (((x[:, 3] > 0.6) & (x[:, 5] < 0.5)) | (x[:, 7] > 0.9)).astype(float)
    model = quality.fit(x, y)
    score = 1 / (1 + np.exp(-model.log_odds(x)))
    assert ((score > 0.5) == y).mean() > 0.98 and 0 < len(model.rules) < 120
    df = spark.createDataFrame(pa.table({f: x[:300, k] for k, f in enumerate(quality.FEATURES)}).to_pandas())
    got = [r[0] for r in df.select(quality.score_column(model)).collect()]
    assert np.allclose(sorted(got), sorted(score[:300]))


def test_degenerate_labels():
    x = np.zeros((10, len(quality.FEATURES)))
    assert quality.fit(x[:0], np.zeros(0)).log_odds(x).tolist() == [0.0] * 10
    assert (quality.fit(x, np.ones(10)).log_odds(x) > 0).all() and (quality.fit(x, np.zeros(10)).log_odds(x) < 0).all()
    assert np.isfinite(quality.fit(x, np.arange(10) % 2.0).log_odds(x)).all()


def test_held_out_accuracy_and_odd_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in out) / len(out) > 0.9
    odd = spark.createDataFrame([(1, None, "k"), (1, "", "k"), (None, "text", "k")], "doc_id bigint, text string, kept string").selectExpr("*", "'x' key", "0 score", "1 predicted")
    marks = spark.createDataFrame([(1, None), (2, 1), (None, 0), (2, 0), (2, 1)], "doc_id bigint, quality int")
    assert [(r.score, r.held_out) for r in quality.classify(odd, marks).orderBy(F.col("doc_id").isNull()).collect()] == [(0.5, zlib.crc32(b"1") % 5 == 0)] * 2 + [(0.5, False)]
    long = spark.createDataFrame([(1, "many words in a line. " * 60_000), (2, "x" * 1_500_000), (3, "short")], "doc_id bigint, text string")
    assert sorted(r.doc_id for r in quality.classify(long, labels).collect()) == [1, 2, 3]
    assert quality.keep(odd, marks).columns == odd.columns and quality.keep(odd, marks).count() == 3
    assert quality.classify(odd.where("doc_id > 5"), marks).count() == 0
