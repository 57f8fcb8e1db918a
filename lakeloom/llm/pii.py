"""Personal data in texts: fixed base patterns, and identifiers discovered by bootstrapped context patterns.

Native throughout: DataFrame and SQL functions only.

Base spans are the leftmost non-overlapping matches of four kinds on the whole text (email, ip, card, phone), less
those that fail the kind's test. They seed the bootstrap: a lexical pattern is a kind and the word that stands
before an identifier; an instance is a kind and an identifier's text. Patterns and instances form a bipartite graph
that is scored in rounds: a pattern's confidence is the score of its instances over all identifier-like strings that
follow its word, known or not; an instance outside the seeds scores by the noisy-or of its patterns. Patterns that
keep high confidence with enough distinct instances then mark the identifiers after their word that the base patterns
miss (a card number with a wrong check digit, a national phone number, a mail address without a dot, ...).
Confidence counts distinct strings, so copies of one document don't make a pattern.

Defined results: a null text is an empty text; positions are code points, end exclusive; base spans of different
kinds may overlap each other, added spans overlap no base span. Rows are kept apart, repeated or null ids included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm._durable import cut, written

KINDS = ("email", "ip", "card", "phone")
# Base patterns, written so that the engine never backtracks over a run: possessive repeats, and starts only where a
# match can start first (at the end of the last match, or where no earlier character of the run could be the start).
_MAIL = r"A-Za-z0-9._%+-"
BASE = {
    "email": rf"(?:\G|(?<![{_MAIL}]))[{_MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Where a text lacks this, the kind's pattern isn't tried.
_HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
_CARD_LIKE = r"[0-9](?:[\x20-]?[0-9]){11,18}(?![0-9])"
_PHONE_LIKE = r"[(]?[0-9][0-9().\x20-]{5,18}[0-9](?![0-9])"
_IP_LIKE = r"[0-9]{1,4}(?:\.[0-9]{1,4}){3}(?![0-9.])|(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){3,7}"
_MAIL_LIKE = r"(?<![^\s<(\[,;:\"'])[^\s@<>()\[\],;:\"']{1,64}@[^\s@<>()\[\],;:\"']{1,255}"
_OTHER = r"(?<!\S)[^\s0-9]*+[0-9]\S*+"
#: Identifier-like strings: those of each kind's loose form, else any word with a digit, which counts against patterns.
LIKE = f"{_MAIL_LIKE}|(?<![0-9.]){_CARD_LIKE}|(?<![0-9.])(?:{_IP_LIKE})|(?<![0-9]){_PHONE_LIKE}|{_OTHER}"

CONFIDENCE = 0.8
#: Distinct instances that a pattern must have extracted before it may discover others.
SUPPORT = 3
ROUNDS = 3
CONTEXT_CHARS = 64
#: Trusted patterns up to which rows are decided where they lie; beyond that, by joins.
LITERALS = 5_000
#: Characters of the pieces that texts are cut into before spans are replaced.
CUT = 8192
_SPAN = "struct<kind:int,start:bigint,stop:bigint,value:string,context:string>"


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'" if "'" not in pattern else '"' + pattern.replace("\\", "\\\\").replace('"', '\\"') + '"'


def _running(values: str, step: str, backwards: bool = False) -> str:
    """SQL of an array's running values: `step` combines v and w. Rounds of doubling reach, so n log n whatever the array."""
    beside = "i + shiftleft(1, k)" if backwards else "i - shiftleft(1, k)"
    inside = "i + shiftleft(1, k) < size(acc)" if backwards else "i >= shiftleft(1, k)"
    one = step.format(v="v", w=f"get(acc, {beside})")
    return f"""aggregate(array({values}), cast(null as array<bigint>), (none, all_) -> if(size(all_) < 2, all_,
        aggregate(sequence(0, int(ceil(log2(size(all_)))) - 1), all_, (acc, k) -> transform(acc, (v, i) -> if({inside}, {one}, v)))))"""


def _placed(gaps: str, hits: str, kind: str) -> str:
    """SQL of an array of spans, from the pieces between matches and the matches, both in text order."""
    context = f"regexp_replace(lower(regexp_extract(right(x.g, {CONTEXT_CHARS}), r'(\\S+)\\s*$', 1)), '[0-9]', '9')"
    pieces = f"zip_with(slice({gaps}, 1, size({hits})), {hits}, (g, h) -> named_struct('g', g, 'h', h, 'n', bigint(length(h))))"
    ends = _running(f"zip_with(slice({gaps}, 1, size({hits})), {hits}, (g, h) -> bigint(length(g) + length(h)))", "{v} + {w}")
    return f"""if(size({hits}) = 0, cast(array() as array<{_SPAN}>), zip_with({pieces}, {ends}, (x, e) -> named_struct('kind', {kind}, 'start', e - x.n, 'stop', e, 'value', x.h, 'context', {context})))"""


_DIGITS = "regexp_replace({v}, '[^0-9]', '')"
_LUHN = """aggregate(sequence(1, length({d})), 0, (s, i) -> s + if(i % 2 = 1, int(substr({d}, length({d}) - i + 1, 1)),
    int(substr('0246813579', int(substr({d}, length({d}) - i + 1, 1)) + 1, 1)))) % 10 = 0"""


def _valid(kind: str, value: str) -> str:
    d = _DIGITS.format(v=value)
    if kind == "ip":
        return rf"{value} rlike r'^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?)(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9]?))+$'"
    if kind == "card":
        return f"if(length({d}) between 13 and 19, {_LUHN.format(d=d)}, false)"
    if kind == "phone":
        return f"length({d}) between 9 and 15"
    return "true"


def _kind_like(value: str) -> str:
    """SQL of the kind (or -1) of an identifier-like string."""
    d = _DIGITS.format(v=value)
    return f"""case when {value} rlike {_quoted('^(?:' + _MAIL_LIKE + ')$')} then 0
        when {value} rlike {_quoted('^(?:' + _IP_LIKE + ')$')} then 1
        when {value} rlike {_quoted('^' + _CARD_LIKE + '$')} and length({d}) between 12 and 19 then 2
        when {value} rlike {_quoted('^' + _PHONE_LIKE + '$')} and length({d}) between 7 and 15 then 3 else -1 end"""


def _apart(spans: str, base: str) -> str:
    """SQL of the spans that overlap none of base: in order of starts, no base span before one ends in it, and none after starts in it."""
    item = "named_struct('start', y.start, 'stop', y.stop, 'fixed', {fixed}, 's', y)"
    both = f"array_sort(concat(transform({spans}, y -> {item.format(fixed='false')}), transform({base}, y -> {item.format(fixed='true')})))"
    reach = _running("transform(z, y -> if(y.fixed, y.stop, -1L))", "greatest({v}, {w})")
    next_ = _running("transform(z, y -> if(y.fixed, y.start, 9223372036854775807L))", "least({v}, {w})", backwards=True)
    around = f"zip_with(zip_with(z, {reach}, (y, r) -> named_struct('y', y, 'r', r)), {next_}, (x, n) -> named_struct('y', x.y, 'r', x.r, 'n', n))"
    kept = f"transform(filter({around}, x -> not x.y.fixed and x.r <= x.y.start and x.n >= x.y.stop), x -> x.y.s)"
    return f"aggregate(array({both}), cast(array() as array<{_SPAN}>), (none, z) -> {kept})"


def extract(docs: DataFrame, *, key: str | None = "doc_id", text: str = "text") -> DataFrame:
    """(key, base, others): with key None the whole row, as a struct; arrays of spans (kind, start, stop, value, context) of each row.

    base: valid base spans by kind, then start. others: identifier-like strings that overlap no base span, kind -1
    where they have no kind's form. Work grows with n log n in the matches of a text.
    """
    rows = docs.select((docs[key] if key else F.struct("*")).alias("key"), F.coalesce(docs[text], F.lit("")).alias("t"))
    pieces = ["key", "t"]
    none = "cast(array() as array<string>)"
    for kind, pattern in BASE.items():
        has = f"t rlike {_quoted(_HINT[kind])}"
        pieces += [f"if({has}, split(t, {_quoted(pattern)}, -1), {none}) g_{kind}", f"if({has}, regexp_extract_all(t, {_quoted(pattern)}, 0), {none}) h_{kind}"]
    has = "t rlike '[0-9@]'"
    pieces += [f"if({has}, split(t, {_quoted(LIKE)}, -1), {none}) g_like", f"if({has}, regexp_extract_all(t, {_quoted(LIKE)}, 0), {none}) h_like"]
    parts = [f"filter({_placed(f'g_{k}', f'h_{k}', str(i))}, y -> {_valid(k, 'y.value')})" for i, k in enumerate(KINDS)]
    like = _placed("g_like", "h_like", _kind_like("x.h"))
    placed = rows.selectExpr(*pieces).selectExpr("key", f"concat({', '.join(parts)}) base", f"{like} likes")
    return placed.selectExpr("key", "base", f"if(size(base) = 0 or size(likes) = 0, likes, {_apart('likes', 'base')}) others")


def patterns(found: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(kind, context, confidence) of the patterns to trust, from the spans of all rows (columns base and others).

    Edges of the graph are distinct (kind, context, value): partial aggregation meets copies and frequent words first.
    """
    seeds = found.selectExpr("explode(base) s").selectExpr("s.kind kind", "s.context context", "s.value value", "1.0D known")
    others = found.selectExpr("explode(others) s").selectExpr("s.kind kind", "s.context context", "s.value value", "0.0D known")
    edges = cut(seeds.union(others).where("context <> ''").groupBy("kind", "context", "value").agg(F.max("known").alias("known")))
    all_after = edges.groupBy("context").agg(F.count("*").alias("n"))
    scored = edges.withColumn("score", F.col("known"))
    for step in range(rounds):
        backed = scored.where("kind >= 0").groupBy("kind", "context").agg(F.sum("score").alias("s"), F.count(F.when(F.col("score") >= confidence, 1)).alias("k"))
        trust = backed.where(F.col("k") >= support).join(all_after, "context").selectExpr("kind", "context", "least(s / n, 0.999999D) confidence")
        trust = cut(trust)
        if step < rounds - 1:
            belief = edges.join(trust, ["kind", "context"]).groupBy("kind", "value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("belief"))
            scored = edges.join(belief, ["kind", "value"], "left").select("kind", "context", "value", F.greatest("known", F.coalesce("belief", F.lit(0.0))).alias("score"))
    return trust.where(F.col("confidence") >= confidence)


def detect(docs: DataFrame, *, key: str | None = "doc_id", text: str = "text", literals: int = LITERALS) -> DataFrame:
    """(key, base, added): base spans and discovered spans of each row, each an array by kind, then start.

    Up to `literals` trusted patterns are part of the plan, so that rows are decided where they lie; beyond that, spans are
    joined to the patterns and back to their rows.
    """
    found = written(extract(docs, key=key, text=text).withColumn("row", F.monotonically_increasing_id()))
    trust = patterns(found).select("kind", "context")
    few = trust.limit(literals + 1).collect()
    if len(few) <= literals:
        known = [f"{r.kind} {r.context}" for r in few]
        hits = F.filter("others", lambda s: F.concat(s["kind"].cast("string"), F.lit(" "), s["context"]).isin(known)) if known else F.expr(f"cast(array() as array<{_SPAN}>)")
        return found.select("key", "base", F.array_sort(hits).alias("added"))
    likes = found.selectExpr("row", "explode(others) s").where("s.kind >= 0").selectExpr("row", "s.kind kind", "s.context context", "s")
    added = likes.join(trust, ["kind", "context"]).groupBy("row").agg(F.array_sort(F.collect_list("s")).alias("added"))
    none = F.expr(f"cast(array() as array<{_SPAN}>)")
    return found.join(added, "row", "left").select("key", "base", F.coalesce("added", none).alias("added"))


def _joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.stop)), ',')"


def report(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_email, n_ip, n_card, n_phone: counts of base spans; base_sha256; spans; n_added) of each row."""
    found = detect(docs, key=key, text=text).selectExpr("key", "base", "array_sort(concat(base, added)) spans_")
    counts = [f"cast(size(filter(base, s -> s.kind = {i})) as bigint) n_{k}" for i, k in enumerate(KINDS)]
    return found.selectExpr(f"key `{key}`", *counts, f"sha2({_joined('base')}, 256) base_sha256", f"{_joined('spans_')} spans", "cast(size(spans_) - size(base) as bigint) n_added")


def _between(a: str, b: str) -> str:
    """SQL of the characters from a to b of a text that is cut into pieces w.c of CUT characters: no search from its beginning."""
    first, last = f"int({a} div {CUT})", f"int({b} div {CUT})"
    return f"""if({first} = {last}, substring(get(w.c, {first}), int({a} % {CUT}) + 1, int({b} - {a})), concat(substring(get(w.c, {first}), int({a} % {CUT}) + 1),
        array_join(slice(w.c, {first} + 2, {last} - {first} - 1), ''), substring(get(w.c, {last}), 1, int({b} % {CUT}))))"""


def redact(docs: DataFrame, *, text: str = "text", literals: int = LITERALS) -> DataFrame:
    """docs with every span's characters replaced by its kind in angle brackets (of spans that overlap, the first keeps what they
    share); other columns and clean texts as they were."""
    names = ", ".join(f"'<{k}>'" for k in KINDS)
    found = detect(docs, key=None, text=text, literals=literals).withColumn("t", F.col(f"key.`{text}`"))
    found = found.selectExpr("key", "t", "array_sort(transform(concat(base, added), s -> named_struct('start', s.start, 'stop', s.stop, 'kind', s.kind))) spans")
    reach = _running("transform(spans, x -> x.stop)", "greatest({v}, {w})")
    shifted = f"aggregate(array({reach}), cast(null as array<bigint>), (none, r) -> transform(r, (v, i) -> if(i = 0, 0L, get(r, i - 1))))"
    pieces = f"transform(sequence(0, int(length(t) div {CUT})), i -> substring(t, i * {CUT} + 1, {CUT}))"
    state = f"named_struct('c', {pieces}, 'z', zip_with(spans, {shifted}, (x, p) -> named_struct('x', x, 'p', p)), 'n', bigint(length(t)), 'end', array_max(transform(spans, x -> x.stop)))"
    replaced = f"concat({_between('y.p', 'greatest(y.x.start, y.p)')}, element_at(array({names}), y.x.kind + 1))"
    cutting = f"""if(size(spans) = 0, t, get(transform(array({state}), w -> concat(array_join(transform(filter(w.z, y -> y.x.stop > y.p), y -> {replaced}), ''),
        {_between('w.end', 'w.n')})), 0))"""
    return found.select(*[F.expr(cutting).alias(c) if c == text else F.col(f"key.`{c}`") for c in docs.columns])
