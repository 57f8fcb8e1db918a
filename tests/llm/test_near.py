import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import near, simhash

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def brute_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_components(rows):
    sets = [brute_set(t) for _, t in rows]
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if (both >= 0.8 * either) and of[i] != of[j]:
                old, new = of[i], of[j]
                of = [new if c == old else c for c in of]
    return of


def planted():
    rng = random.Random(11)
    rows, line = [], " ".join(f"common{i}" for i in range(30))
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([3, 5, 30, 90, 200]))]
        for _ in range(rng.randint(1, 6)):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
            rows.append(" ".join(text).upper() if rng.random() < 0.2 else "  ".join(text) + (f"\n{line}" if g % 2 else ""))
    rows += ["", None, "one", "ONE", "a b c d e", "a b c d f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_one_row_of_each_group_of_similar_texts_stays(spark):
    rows = planted()
    of = brute_components(rows)
    want = sorted(min(i for i, _ in rows if of[i] == c) for c in set(of))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' sid", "doc_id mark")
    got = corpus_pipeline.drop_near_duplicates(spark, df, "")
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == want
    wide = {r.component_id for r in simhash.near_duplicates(df).select("component_id").collect()}
    assert len(want) < len(wide)  # two bits of the fingerprints leave near copies


def test_fingerprints_link_the_similar_texts_of_the_stage(spark, monkeypatch):
    rows = planted()
    sets = [brute_set(t) for _, t in rows]
    known = {}
    for s in sets:
        known.setdefault(frozenset(s), len(known))
    texts = [(i, next(t for (_, t), x in zip(rows, sets) if x == s)) for s, i in known.items() if s]
    prints = []
    for i, t in texts:
        h, at = near.shingle_sets(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
        prints.append((i, simhash.wide_prints(h, np.zeros(len(h), np.int64), np.diff(at))[0].tobytes()))
    bits = {i: int.from_bytes(p, "little") for i, p in prints}

    def joined(links):
        of = {i: i for i in bits}
        for a, b in links:
            old, new = of[a], of[b]
            of = {i: new if c == old else c for i, c in of.items()}
        return {frozenset(i for i in of if of[i] == c) for c in set(of.values())}

    ball = lambda x: any(((x >> s) & 0xFFFF).bit_count() <= 1 for s in range(0, 256, 16))
    close = [(a, b) for a in bits for b in bits if a < b and (bits[a] ^ bits[b]).bit_count() <= simhash.RADIUS and ball(bits[a] ^ bits[b])]
    similar = [(known[x], known[y]) for x in known for y in known if known[x] < known[y] and x and y and len(x & y) >= 0.8 * len(x | y)]
    assert similar and set(similar) <= set(close)
    df = spark.createDataFrame(prints, "sid bigint, fp binary")
    for group in (1 << 20, 20, 3):  # all in a group, or dealt out by the highest bits
        assert joined((r.a, r.b) for r in simhash.wide_links(df, group=group).collect()) == joined(close)
    found, search = [], simhash.wide_links
    monkeypatch.setattr(simhash, "wide_links", lambda prints: found.append(search(prints).count()) or search(prints))
    corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "")
    assert len(found) == 1 and found[0] > 0


@pytest.mark.parametrize("block", [4, 256])
def test_buckets_lose_no_link(spark, monkeypatch, block):
    rng = random.Random(12)
    rows = [t for _, t in planted()]
    base = [f"h{i}" for i in range(120)]
    for k in range(40):  # a crowd around one text, some far from it but near each other, and a chain away from it
        text = list(base)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(120)] = f"y{rng.randrange(10**6)}"
        rows.append(" ".join(text))
    for k in range(1, 12):
        rows.append(" ".join([f"z{i}" for i in range(3 * k)] + base[3 * k :]))
    rows = list(enumerate(rows))
    monkeypatch.setattr(near, "OUT_BLOCK", block)
    monkeypatch.setattr(near, "BLOCK", block)
    of = brute_components(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("mark", F.xxhash64("text"))
    got = [r.key for r in near.firsts(df, key="doc_id", mark="mark", text="text").collect()]
    assert sorted(got) == sorted(min(i for i, _ in rows if of[i] == c) for c in set(of))


def test_equal_rows_and_rows_of_one_id(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a, "x")] * 3 + [(1, b, "x"), (1, b, "y"), (2, a, "x"), (None, a, "x"), (None, a, "x"), (3, None, "x"), (4, "", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    for bound in (corpus_pipeline.BROADCAST_ROWS, 0):
        got = [tuple(r) for r in corpus_pipeline.drop_near_duplicates(spark, df, "", broadcast_rows=bound).collect()]
        assert sorted((r[:2] for r in got if r[0]), key=str) == [(1, a), (1, b), (3, None)] and len(got) == 5
