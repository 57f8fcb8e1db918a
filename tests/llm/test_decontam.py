import random
from collections import Counter

from lakeloom.llm import decontam


def words_of(text):
    out, word = [], ""
    for ch in (text or "") + " ":
        if ch.isascii() and not ch.isalnum():
            if word:
                out.append(word)
            word = ""
        else:
            word += ch.lower() if ch.isascii() else ch
    return out


def brute(docs, items):
    found = {}
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            n = len(v)
            if not n:
                continue
            k = min(5, n)
            b = Counter(tuple(v[j : j + k]) for j in range(n - k + 1))
            for s in range(len(w) - n + 1):
                a = Counter(tuple(w[s + j : s + j + k]) for j in range(n - k + 1))
                x = decontam.similarity(a, b)
                if x >= 0.8 and x > found.get((d, i), (0, 0))[0]:
                    found[d, i] = (x, s)
    return found


def test_finds_exactly_what_brute_force_finds(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "Ab", "cañon", "straße", "x1", "zeta", "omega", "pi", "rho", "tau", "nu"]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([14, 20, 33, 50, 60, 3, 5, 1, 0])] + [(9, None)]
    items.append((10, items[3][1]))
    docs = [(100, None), (101, ""), (102, " ".join(say(800)))]
    for j in range(60):
        body = items[rng.randrange(5)][1].split()
        for _ in range(rng.randint(0, 3)):
            body[rng.randrange(len(body))] = "other"
        if rng.random() < 0.3:
            body.insert(rng.randrange(len(body)), "extra")
        docs.append((j, ", ".join([" ".join(say(rng.randint(0, 40))), " ".join(body).upper().replace("Ñ", "ñ").replace("SS", "ß"), "!" + " ".join(say(30))])))
    want = brute(docs, items)
    df = spark.createDataFrame(docs + docs[:5], "doc_id bigint, text string").selectExpr("*", "'x' item_id", "1 similarity")
    its = spark.createDataFrame(items, "item_id bigint, text string")
    for size in (decontam.BLOCK_BYTES, 200):
        got = {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in decontam.find(df, its, block_bytes=size).collect()}
        assert got == want
    assert len(want) > 30
    left = {r.doc_id for r in decontam.clean(df, its).collect()}
    assert left == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.find(df, its.where("item_id > 99")).count() == 0


def test_documents_shorter_than_the_item_are_one_window(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{rng.randrange(500)}" for _ in range(n))) for i, n in enumerate([59, 40, 25, 12, 5, 4])]
    docs = [(j, " ".join(item.split()[cut // 2 : len(item.split()) - (cut + 1) // 2])) for j, (item, cut) in enumerate((t, c) for _, t in items for c in range(14) if c < len(t.split()))]
    want = brute(docs, items)
    for d, text in docs:
        w = words_of(text)
        for i, item in items:
            v = words_of(item)
            k = min(5, len(v))
            if k <= len(w) < len(v):
                a, b = (Counter(tuple(x[j : j + k]) for j in range(len(x) - k + 1)) for x in (w, v))
                s = decontam.similarity(a, b)
                if s >= 0.8:
                    want[d, i] = (s, 0)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    its = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontam.find(df, its).collect()
    assert {(r.doc_id, r.item_id): (r.similarity, r.start_word) for r in found} == want and len(want) > len(items)
    assert all(r.n_words == min(len(words_of(docs[r.doc_id][1])), len(words_of(items[r.item_id][1]))) for r in found)
    assert {r.doc_id for r in decontam.clean(df, its).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_null_ids_long_texts_and_empty_tables(spark):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    item = " ".join(rng.choice(vocab) for _ in range(40))
    long = " ".join(rng.choice(vocab) for _ in range(200_000))
    docs = [(None, "x " + item), (None, item + " y z"), (None, "clean text"), (1, long[:600_000] + " " + item + " " + long[600_000:]), (2, long)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    its = spark.createDataFrame([(7, item), (None, item)], "item_id bigint, text string")
    got = sorted((r.doc_id or 0, r.item_id, r.similarity) for r in decontam.find(df, its).collect())
    assert got == [(0, 7, 1.0), (1, 7, 1.0)]
    assert sorted((r.doc_id or 0, len(r.text)) for r in decontam.clean(df, its).collect()) == [(0, 10), (2, len(long))]
    assert decontam.find(df.where("doc_id > 9"), its).count() == 0 and decontam.clean(df.where("doc_id > 9"), its).count() == 0
    assert decontam.find(df, its.where("item_id > 9")).count() == 0 and decontam.clean(df, its.where("item_id > 9")).count() == 5
