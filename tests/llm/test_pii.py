import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def valid(kind, v):
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        return all(int(p) <= 255 for p in v.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and luhn(d)
    return kind == "email" or 9 <= len(d) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "'x' row", "1 base", "2 key")
    got = {r.doc_id: r for r in pii.report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert got[i].base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest(), (t, want, got[i])
        assert [got[i][f"n_{k}"] for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert set(want) <= {(a, int(b), int(c)) for a, b, c in (s.split(":") for s in got[i].spans.split(",") if s)}


CASES = [
    None, "", " ", "a@b.c_d@e.f", "x..@a.b-c.d.e@f.g", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.0004", "漢😀 +1 (017) 555-7713, é 4539 1488 0343 6467 9",
    "4539148803436467", "4539148803436467!!4539148803436467", "9" * 5000, "1 " * 4000, "a" * 50000 + "@b.c", "+1" + " " * 3000, "+" * 100, "0." * 2000, "a@b." * 900, "+1.2.3.4 555 1234",
]


def test_base_cases(spark):
    check(spark, CASES)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="a.@-+ 0123456789()_é😀", max_size=60), min_size=30, max_size=60))
def test_base_spans_match_brute_force(spark, texts):
    check(spark, texts)


def test_context_patterns_discover_unseen_identifiers(spark):
    good = ["4539148803436467", "4556737586899855", "4916592289993918", "4024007103939509"]
    texts = [f"he paid by kreditkarte: {c} today" for c in good] * 2
    texts += ["also kreditkarte: 4539148803436468 again", "number 4539148803436468 alone", "the 17 of may", *(f"the {c} one" for c in good)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.doc_id: r for r in pii.report(df).collect()}
    assert rows[8].spans == "card:18:34" and rows[8].n_added == 1 and rows[8].n_card == 0
    assert sum(r.n_added for r in rows.values()) == 1
    out = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert out[0] == "he paid by kreditkarte: <card> today" and out[8] == "also kreditkarte: <card> again" and out[9] == texts[9]


def test_empty_table(spark):
    assert pii.report(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def kind_like(v):
    d = re.sub("[^0-9]", "", v)
    if re.fullmatch(pii._MAIL_LIKE, v, re.A):
        return 0
    if re.fullmatch(pii._IP_LIKE, v, re.A):
        return 1
    if re.match(f"^{pii._CARD_LIKE}$", v, re.A) and 12 <= len(d) <= 19:
        return 2
    return 3 if re.match(f"^{pii._PHONE_LIKE}$", v, re.A) and 7 <= len(d) <= 15 else -1


def spans_of(text):
    """(base, others): (kind, start, stop, value, context) as the operator defines them."""

    def placed(pattern, kind):
        out, last = [], 0
        for m in re.finditer(pattern, text, re.A):
            found = re.search(r"(\S+)\s*\Z", text[last : m.start()][-pii.CONTEXT_CHARS :], re.A)
            out.append((kind(m[0]), m.start(), m.end(), m[0], re.sub("[0-9]", "9", found[1].lower()) if found else ""))
            last = m.end()
        return out

    base = [s for i, (k, p) in enumerate(PATTERNS.items()) for s in placed(p, lambda v, i=i: i) if valid(k, s[3])]
    return base, [s for s in placed(pii.LIKE, kind_like) if not any(b[1] < s[2] and s[1] < b[2] for b in base)]


def bootstrapped(texts):
    found = [spans_of(t) for t in texts]
    known = {}
    for flag, which in ((1.0, 0), (0.0, 1)):
        for spans in found:
            for kind, _, _, value, context in spans[which]:
                if context:
                    known[kind, context, value] = max(flag, known.get((kind, context, value), 0.0))
    score = dict(known)
    for step in range(pii.ROUNDS):
        trust = {}
        for kind, context in {e[:2] for e in known if e[0] >= 0}:
            mine = [score[e] for e in known if e[:2] == (kind, context)]
            if sum(s >= pii.CONFIDENCE for s in mine) >= pii.SUPPORT:
                trust[kind, context] = min(sum(mine) / sum(e[1] == context for e in known), 0.999999)
        for kind, _, value in known:
            miss = 1.0
            for e in known:
                if e[0] == kind and e[2] == value:
                    miss *= 1 - trust.get(e[:2], 0.0)
            for e in known:
                if e[0] == kind and e[2] == value:
                    score[e] = max(known[e], 1 - miss)
    good = {p for p, c in trust.items() if c >= pii.CONFIDENCE}
    return [(b, sorted(s for s in o if (s[0], s[4]) in good)) for b, o in found]


def planted():
    import random

    rng = random.Random(4)
    cards = [c for c in (f"45{rng.randrange(10**14):014d}" for _ in range(400)) if luhn(c)]
    bad = [c[:-1] + str((int(c[-1]) + 1) % 10) for c in cards[:4]]
    texts = ["pay by card " + c for c in cards] + [f"card {c} or nr {c}" for c in bad] + ["phone +1 (017) 555-77%02d" % i for i in range(20)] + ["phone 017 5557713", "card 017 5557713"]
    texts += [f"nr {c}" for c in cards[:12]] + ["nr 4539 1488 0343 6468"]
    lead = ["phone", "at", "mail", "the", ""]
    tail = cards[:5] + bad + ["+1 (017) 555-7713", "(017) 555-7713", "a@b", "x.y@mail.example.com", "10.2.3.4", "10.2.3.999", "17", "b52", "::1:2:3:4"]
    return texts + [" ".join(f"{rng.choice(lead)} {rng.choice(tail)}" if rng.random() < 0.5 else "word" for _ in range(rng.randint(0, 5))) for _ in range(30)] + ["", "card"]


def test_bootstrap_equals_brute_force_with_patterns_as_literals_or_joined(spark):
    texts = planted()
    want = bootstrapped(texts)
    assert sum(len(added) for _, added in want) > 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for literals in (pii.LITERALS, 0):
        for r in pii.detect(df, literals=literals).collect():
            got = [sorted((s.kind, s.start, s.stop, s.value, s.context) for s in spans) for spans in (r.base, r.added)]
            assert got == [sorted(want[r.key][0]), want[r.key][1]], texts[r.key]
    for r in pii.redact(df).collect():
        base, added = want[r.doc_id]
        out, at = "", 0
        for _, start, stop, kind in sorted((0, a, b, k) for k, a, b, _, _ in base + added):
            if stop > at:
                out += texts[r.doc_id][at : max(start, at)] + f"<{pii.KINDS[kind]}>"
                at = stop
        assert r.text == out + texts[r.doc_id][at:]


def test_null_and_repeated_ids_and_many_spans_over_piece_ends(spark):
    long = "é word 4539148803436467 and x@y.example.com, " * 1500
    df = spark.createDataFrame([(None, "a@b.cd"), (None, "a@b.cd"), (1, "10.0.0.1"), (1, long)], "doc_id bigint, text string")
    got = pii.report(df).collect()
    assert sorted((r.n_email, r.n_ip, r.n_card) for r in got) == [(0, 1, 0), (1, 0, 0), (1, 0, 0), (1500, 0, 1500)]
    texts = sorted(r.text for r in pii.redact(df).collect())
    assert texts == sorted(["<email>", "<email>", "<ip>", "é word <card> and <email>, " * 1500])


def test_a_text_of_many_digit_words_takes_seconds(spark):
    import time

    df = spark.createDataFrame([(1, "9x " * 40_000 + "a@b.cd " * 2_000)], "doc_id bigint, text string")
    pii.report(df.where("doc_id = 2")).count()
    began = time.perf_counter()
    (r,) = pii.report(df).collect()
    assert r.n_email == 2000 and time.perf_counter() - began < 30
