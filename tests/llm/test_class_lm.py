import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from lakeloom.llm import class_lm


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def corpus(n=150):
    rng = random.Random(2)
    det, noun, verb = ["the", "A", "this"], [f"n{i}e" for i in range(12)], [f"v{i}" for i in range(8)]
    rows = []
    for i in range(n):
        said = []
        for _ in range(rng.randint(0, 12)):
            said += [rng.choice(det), rng.choice(noun), rng.choice(verb)]
            if rng.random() < 0.1:
                said.append(f"rare{rng.randint(0, 300)}é")
        rows.append((i, "  ".join(said) + "\n"))
    return rows + [(900, None), (901, ""), (902, "x" * 3000 + " zz"), (3, "the rep")]


def test_base_scores_equal_brute_force_at_any_memory(spark):
    rows = corpus()
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for i, t in rows if not held_out(i) for w in words(t))
    n, v = sum(count.values()), len(count)
    want = sorted((i, held_out(i), len(words(t)), sum(w in count for w in words(t)), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6)) for i, t in rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' row", "1 key", "2 h")
    scores = []
    for held in (None, class_lm.HELD, 40):
        got = class_lm.score(df, held=held, min_count=1 if held == 40 else 10, classes=6, seeds=20).collect()
        assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        scores.append(sorted((r.doc_id, round(r.score, 6)) for r in got))
    assert scores[0] == scores[1]  # a bound that holds all words changes nothing
    out = [r for r in got if r.held_out and r.n_tokens > 1]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)  # classes help on text they weren't learnt from
    assert class_lm.score(df.where("doc_id > 9999")).count() == 0


def test_exchange_never_loses_likelihood_and_finds_the_classes():
    rng = np.random.default_rng(0)
    kind = np.array([0, 1, 2] * 6)
    pairs = np.zeros((18, 18))
    at = 0
    for _ in range(4000):
        to = rng.choice(np.flatnonzero(kind == (kind[at] + 1) % 3))
        pairs[at, to] += 1
        at = to
    of = np.arange(18) // 6 + 1
    last = -np.inf
    for _ in range(6):
        one = np.eye(4)[of]
        m = one.T @ pairs @ one
        assert class_lm.likelihood(m) >= last - 1e-6
        last = class_lm.likelihood(m)
        of = class_lm.exchange_pass(m, pairs @ one, (one.T @ pairs).T, np.diag(pairs), of, 1)
    assert len({(a, b) for a, b in zip(kind, of)}) == 3


def shape(w):
    raw = w.encode()
    last = raw[-1:].decode("latin1")
    kind = 0 if last in "aeiou" else 1 if last.isascii() and last.isalpha() else 2 if last.isdigit() and last.isascii() else 4 if raw[-1] > 127 else 3
    return sum(len(raw) >= x for x in (3, 7, 12)) * 5 + kind


def test_scores_equal_brute_force_by_the_classes_learnt(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    training = dict(classes=6, seeds=8, min_count=3)
    held_out = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    train = [words(t) for i, t in rows if not held_out(i)]
    model, counts = class_lm._train(df.where("crc32(cast(doc_id as string)) % 5 <> 1").selectExpr("coalesce(text, '') text"), **training)
    count = Counter(w for t in train for w in t)
    assert model.words.counts.sum() == sum(c for w, c in count.items() if c >= 3 and w)
    data = lambda w: (np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]))
    of = {}
    for w in {w for _, t in rows for w in words(t) if w}:
        h, s, _ = class_lm._tokens(*data(w))
        assert s[0] == shape(w)
        of[w] = int(model.symbol_class[model.words.symbols_of(h, s)[0]])
    assert all((of[w] >= class_lm.FIXED) == (count[w] >= 3) for w in of)
    of[None] = class_lm.END
    total = class_lm.FIXED + 6
    size = Counter(of[w] for t in train for w in t)
    kinds = Counter(of[w] for w in count)
    pair = Counter((a, b) for t in train for a, b in zip([class_lm.END, *[of[w] for w in t]], [of[w] for w in t]))
    left = Counter(a for a, _ in pair.elements())
    n = sum(size.values())
    want = {}
    for i, t in rows:
        at, s = class_lm.END, 0.0
        for w in words(t):
            c = of[w]
            prior = (size[c] + 0.5) / (n + 0.5 * total)
            s += math.log10((pair[at, c] + class_lm.SMOOTH * prior) / (left[at] + class_lm.SMOOTH))
            if w is not None:  # the end is its class's only word
                s += math.log10((count[w] + 0.5) / (size[c] + 0.5 * (kinds[c] + 1)))
            at = c
        want[i, t] = s
    got = class_lm.score(df, **training).collect()
    assert sorted(round(r.score, 6) for r in got) == sorted(round(x, 6) for x in want.values())


def test_words_beyond_those_held_are_clustered_like_any(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    got = []
    for held in (None, 20):
        out = class_lm.score(df, held=held, min_count=2, classes=6, seeds=8).collect()
        got.append(sorted((r.doc_id, r.n_known, round(r.base_score, 9), round(r.score, 9)) for r in out))
    assert got[0] == got[1]
    train = df.selectExpr("coalesce(text, '') text")
    model, others = class_lm._train(train, held=20, min_count=2, classes=6, seeds=8)
    count = Counter(w for _, t in corpus() for w in words(t) if w)
    rest = others.collect()
    assert len(model.words.counts) == 20 and len(rest) == len(count) - 20
    assert all((r["class"] is None) == (r.n < 2) for r in rest) and any((r["class"] or 0) >= class_lm.FIXED for r in rest)


def test_words_beyond_those_held_are_clustered_like_any_next_to_each_other(spark):
    rng = random.Random(5)
    some = [f"w{i}{'aeé7-'[i % 5]}" for i in range(60)]
    rows = [(" ".join(rng.choice(some if i % 3 else some[:6]) for _ in range(rng.randint(0, 40))),) for i in range(120)]
    df = spark.createDataFrame([*rows, ("w7é w7é w7é",), ("once twice",), ("",), ("w9- twice w9- w9-",)], "text string")
    training = dict(min_count=2, classes=5, seeds=4)
    whole, _ = class_lm._train(df, held=None, **training)
    less, others = class_lm._train(df, held=4, **training)  # most words next to words that aren't held either
    assert len(less.words.counts) == 4 and others.where("class is not null").count() == len(whole.words.counts) - 4
    assert np.array_equal(whole.transition, less.transition) and np.allclose(whole.spread, less.spread)
    of = {h: int(whole.symbol_class[s]) for h, s in zip(whole.words.hashes.view(np.int64).tolist(), whole.words.symbols)}
    assert all(of[r.h] == r["class"] for r in others.collect() if r["class"] is not None)


def shuffled(spark, f):
    """Bytes that f shuffles."""
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in (found.apply(i) for i in range(found.size()))}

    before = stages()
    f()
    return sum(n for k, n in stages().items() if k not in before)


def test_texts_stay_where_they_are_when_some_words_are_not_held(spark):
    rng = random.Random(6)
    often = [f"o{i}" for i in range(1500)]
    rows = [(" ".join(rng.choices(often, k=1500) + [f"rare{i // 2}"]),) for i in range(80)]
    df = spark.createDataFrame(rows, "text string").coalesce(2)
    training = dict(min_count=2, classes=4, seeds=10, passes=1, rounds=0)
    every, less = (shuffled(spark, lambda: class_lm._train(df, held=held, **training)) for held in (None, 1500))
    assert less - every < 80_000  # the ranks of 1,540 words and 80 places; the symbols of 120,000 tokens are more


def test_rounds_in_spark_raise_the_likelihood_and_find_the_classes(spark):
    rng = random.Random(3)
    groups = [[f"{g}{i}" for i in range(30)] for g in "abc"]
    rows = [(i, " ".join(rng.choice(groups[k % 3]) for k in range(9))) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("text")
    model, _ = class_lm._train(df, classes=6, seeds=45, min_count=1)
    of = {}
    for g in groups:
        for w in g:
            h, s, _ = class_lm._tokens(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))
            of.setdefault(int(model.symbol_class[model.words.symbols_of(h, s)[0]]), set()).add(w[0])
    assert all(len(x) == 1 for x in of.values())


def test_without_training_text_every_word_is_unknown(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    df = spark.createDataFrame([(i, "one two") for i in ids], "doc_id bigint, text string")
    got = class_lm.score(df).collect()
    assert len(got) == 4 and all(r.held_out and r.n_known == 0 and r.train_tokens == 0 and math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    model, counts = class_lm._train(df.selectExpr("coalesce(text, '') text"), min_count=2, classes=6, seeds=30)
    assert np.allclose((10**model.transition).sum(1), 1, atol=1e-6)
