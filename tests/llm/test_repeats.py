import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import repeats


def brute(rows, length=100):
    """Rows in order of precedence: (key, text)."""
    seen, out = set(), {}
    for key, text in rows:
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(data) else 0
        out[key] = (len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    base = [" ".join(word() for _ in range(rng.randint(5, 120))) for _ in range(12)]
    texts = [None, "", "x" * 99, "x" * 100, "x" * 350, "ab" * 400, " " * 700, "é" * 120]
    for _ in range(60):
        parts = [rng.choice(base) if rng.random() < 0.6 else " ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 4))]
        t = " ".join(parts)
        if rng.random() < 0.5:
            k = rng.randrange(len(t))
            t = t[:k] + "#" + t[k + 1 :]
        texts.append(t[rng.randint(0, 40) :])
    texts += texts[:20] + ["#".join(base)[:5000]]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize(("seed", "hot"), [(0, repeats.HOT), (1, repeats.HOT), (2, 1)])
def test_equals_brute_force(spark, seed, hot):
    rows = list(enumerate(corpus(seed)))
    df = spark.createDataFrame(rows[::-1], "doc_id bigint, text string").selectExpr("*", "'x' doc", "1 sub", "2 pos").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in repeats.remove(df, hot=hot, bucket_bytes=20_000).collect()}
    want = brute(rows)
    assert got == want and sum(w[1] for w in want.values()) > 1000


def test_repeated_rows_null_ids_and_empty_tables(spark):
    a, b = "The first text. " * 3 + "q" * 80 + "w" * 60, "e" * 50 + "r" * 70 + "t" * 40
    rows = [(5, a), (5, a), (7, a), (9, b), (9, b + "!"), (None, b), (None, b)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id or 99, r.n_removed, r.n_bytes) for r in repeats.remove(df, with_text=False).collect())
    assert got[:3] == [(5, 0, len(a)), (5, 0, len(a)), (7, len(a), len(a))]
    assert sorted(g[1] for g in got[3:5]) in ([0, len(b)], [0, len(b)])
    assert got[5:] == [(99, len(b), len(b))] * 2
    assert repeats.remove(df.where("doc_id > 99")).count() == 0


def test_a_common_line_before_unique_text_goes_to_no_bucket(spark, monkeypatch):
    rng = random.Random(3)
    line = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, line + "".join(rng.choice("abcdefgh ") for _ in range(300))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    met = []
    monkeypatch.setattr(repeats, "later_places", lambda w, real=repeats.later_places: met.append(w) or real(w))
    got = {r.doc_id: r.n_removed for r in repeats.remove(df, hot=50, with_text=False).collect()}
    assert got == {k: v[1] for k, v in brute(rows).items()}
    (windows,) = met
    copies = windows.groupBy("data").count().agg({"count": "max"}).first()[0]
    part = windows.selectExpr("data", f"pmod(xxhash64(doc), {repeats.SALTS}) s").groupBy("data", "s").count().agg({"count": "max"}).first()[0]
    assert copies > 300 and part < 25  # what one task may get of a window that all documents have


def test_many_null_ids_and_many_copies_of_a_row(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(250)) for _ in range(40)]
    rows = [(None, t) for t in texts] + [(5, texts[0])] * 50 + [(None, None), (6, "")]
    got = repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=False).collect()
    assert sorted((r.doc_id or 0, r.n_removed) for r in got) == sorted([(0, 0)] * 40 + [(0, 250)] + [(5, 0)] * 50 + [(6, 0)])


@settings(max_examples=150, deadline=None)
@given(st.permutations(range(12)))
def test_nearest_smaller_positions(order):
    before, after = repeats.nearest_earlier(np.array(order))
    for i, p in enumerate(order):
        assert before[i] == max((j for j in range(i) if order[j] < p), default=-1)
        assert after[i] == min((j for j in range(i + 1, 12) if order[j] < p), default=-1)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab", max_size=60))
def test_factors_by_nearest_earlier_positions(text):
    data = text.encode()
    want = [max([k for q in range(p) for k in range(len(data) - p + 1) if data[q : q + k] == data[p : p + k]], default=0) for p in range(len(data))]
    assert repeats.longest_previous_factors(data).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab", min_size=10, max_size=150), st.integers(8, 40))
def test_windows_agree_with_factors(text, length):
    data = np.frombuffer(text.encode(), np.uint8)
    at = np.arange(max(0, len(data) - length + 1))
    if len(at):
        lpf = repeats.longest_previous_factors(text.encode())
        assert repeats.repeated_windows(data, at, length).tolist() == (lpf[at] >= length).tolist()


def test_long_texts_are_cut_into_overlapping_parts(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefgh ") for _ in range(1_300_000))
    rows = [(1, long), (2, "zz" + long[600_000:600_400]), (3, long[-150:] + long[:150])]
    got = {r.doc_id: r.n_removed for r in repeats.remove(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=False).collect()}
    assert got == {1: 0, 2: 400, 3: 300}
