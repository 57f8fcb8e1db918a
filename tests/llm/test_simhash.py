import re

import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import simhash
from lakeloom.llm._text import slices


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    parent = {k: k for k, _ in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, fa in prints:
        for b, fb in prints:
            if a < b and bin((fa ^ fb) & (2**64 - 1)).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: root(k) for k, _ in prints}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aBé \n\tZ漢😀.", max_size=60), max_size=8))
def test_fingerprints_match_brute_force(texts):
    texts = [*texts, None, "", "one", "One two", "x" * 5000 + " y z w"]
    got = [int(x) for _, _, d, o in slices(pa.array(texts, pa.string()), 100) for x in simhash.fingerprints_of(d, o)]
    assert got == [brute_fingerprint(t) for t in texts]


@pytest.mark.parametrize("hot", [1000, 0, 3])
def test_groups_match_brute_force(spark, hot):
    import random

    rng = random.Random(7)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = []
    for i in range(160):
        x = rng.choice(seeds)
        for _ in range(rng.randint(0, 4)):
            x ^= 1 << rng.randrange(64)
        prints.append((i * 3 % 163, x - (1 << 64) if x >> 63 else x))
    df = spark.createDataFrame(prints, "doc_id bigint, fp bigint")
    got = {r.doc_id: r.component for r in simhash.groups(df, hot=hot).collect()}
    assert got == brute_groups(prints)


def test_nulls_empties_ties_and_extra_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a b c d", None), (4, "A  B c D", "k"), (5, "  ", "fp")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").withColumnRenamed("fp", "component")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert got[1] == got[2] == got[5] == ("0" * 16, 1)
    assert got[3] == got[4] and got[3][1] == 3
    assert simhash.near_duplicates(df.where("doc_id > 9")).count() == 0


def test_rows_of_one_id_are_told_apart_and_null_ids_have_no_group(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(5, a), (5, b), (7, a), (8, b), (9, b), (None, a), (None, b), (2, "c"), (2, "c")]
    got = sorted((r.doc_id or 0, r.component_id or 0) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(0, 0), (0, 0), (2, 2), (2, 2), (5, 5), (5, 5), (7, 5), (8, 5), (9, 5)]
    # 3 is a copy of 1, and 1 is also the id of another text, which 2 copies: neither group joins the other
    rows = [(1, a), (3, a), (2, b), (4, b), (4, "z")]
    out = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert out == {(1, 1), (3, 1), (2, 2), (4, 2), (4, 4)}
