from hypothesis import given, settings
from hypothesis import strategies as st

from lakeloom.llm import html_text


def longest(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            best[i + 1][j + 1] = best[i][j] + 1 if a[i] == b[j] else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=14), st.lists(st.integers(0, 4), max_size=14))
def test_common_lines_are_a_longest_common_subsequence(a, b):
    for cells in (html_text.CELLS, 6):
        got = html_text.common_lines(a, b, cells)
        assert got == sorted(set(got)) and len(got) == longest(a, b)
        rest = iter(b)
        assert all(a[i] in rest for i in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>";</script></head><body><nav><ul><li>Home</li></ul></nav>
<div class="ad-box ad">Buy!</div><article><header><h1>The &amp;  title</h1></header><p><b>One<br>two &lt;x&gt; &am<p>Three
 four&nbsp;five</p><aside>Side</aside><div id="comments"><p>Nice</p></div><form>Send</form></article><footer>&copy; me"""


def test_marked_article():
    article, _, _ = html_text.lines_of(PAGE)
    assert article == ["The & title", "One two <x> &am", "Three four five"]
    assert html_text.lines_of(None) == html_text.lines_of("") == ([], [], [])
    assert html_text.lines_of("<main><p>a < b</p></main><p>c")[1:] == (["a < b"], [("a < b", False), ("c", False)])
    assert html_text.lines_of('<nav>x</nav><p>a <b class="ad">buy</b>b</p>')[2] == [("x", True), ("a b", False), ("buy", True)]
    assert html_text.lines_of("<" * 2000 + "<p" * 500)[2]


def test_pages_differ_from_their_nearest_url(spark):
    frame = lambda body: f"<div>Site name</div><div>Home | About</div>{body}<div>All rights reserved</div>"
    rows = [
        (1, "http://a.example/x/1", frame("<p>First story about rivers</p><p>Second line of it</p>")),
        (2, "http://a.example/x/2.html?q=1", frame("<p>Another tale of mountains</p><p>and more</p>")),
        (3, "http://a.example/y/9", frame("<p>Far away</p>")),
        (4, "http://b.example/x/1", frame("<p>Alone on its host</p>")),
        (5, "http://c.example/1", "<p>Same page</p><p>whole copy</p>"),
        (6, "http://c.example/2", "<p>Same page</p><p>whole copy</p>"),
        (7, "http://d.example/x/3", PAGE), (8, None, "<p>no url</p>"), (9, "http://a.example/x/4", None), (10, "not a url", ""), (None, "http://a.example/x/5", "<p>no id</p>"),
    ]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "'z' id", "1 text")
    got = {r.page_id: r for r in html_text.main_text(df).collect()}
    text = {k: r.text for k, r in got.items()}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got.values())
    assert text[1] == "First story about rivers\n\nSecond line of it" and text[2] == "Another tale of mountains\n\nand more"
    assert text[3] == "Far away"
    assert text[4] == "Site name\n\nHome | About\n\nAlone on its host\n\nAll rights reserved"
    assert text[5] == text[6] == "Same page\n\nwhole copy"
    assert text[7] == "The & title\n\nOne two <x> &am\n\nThree four five"
    assert (text[8], text[9], text[10], text[None]) == ("no url", "", "", "no id")
    assert html_text.main_text(df.where("page_id > 99")).count() == 0


def test_partners_are_neighbours_by_path_whatever_the_partitions(spark):
    rows = [(i, f"http://h{i % 3}.example/p/{i * 37 % 100:03d}") for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, url string")
    got = {r.id: r.other_id for r in html_text.partners(df).collect()}
    by_host = {}
    for i, u in rows:
        by_host.setdefault(u[:18], []).append((u, i))
    for members in by_host.values():
        members.sort()
        for k, (u, i) in enumerate(members):
            near = [members[j] for j in (k - 1, k + 1) if 0 <= j < len(members)]
            common = lambda v: next((n for n, (x, y) in enumerate(zip(u, v)) if x != y), min(len(u), len(v)))  # noqa: E731,B023
            best = max(common(v) for v, _ in near)
            assert got[i] in [j for v, j in near if common(v) == best]


def brute(rows):
    """Texts by plain rules: partners by sorted path, alignment by a table, guards, marks."""
    lines = {i: html_text.lines_of(p) for i, _, p in rows}
    split = {i: (u.split("/")[2].lower(), "/" + u.split("/", 3)[3]) for i, u, _ in rows if lines[i][2]}
    common = lambda a, b: next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    out = {}
    for i, (article, main, every) in lines.items():
        own, gone = article or main, set()
        order = sorted((*split[j], j) for j in split)
        if i in split:
            k = order.index((*split[i], i))
            near = [order[j] for j in (k - 1, k + 1) if 0 <= j < len(order) and order[j][0] == split[i][0]]
            if near:
                other = max(near, key=lambda x: (common(x[1], split[i][1]), -x[2]))[2]
                gone = set(html_text.common_lines([x for x, _ in every], [x for x, _ in lines[other][2]]))
        text = sum(len(x) for x, f in every if not f)
        copied = text and sum(len(every[n][0]) for n in gone if not every[n][1]) > html_text.COPY_SHARE * text
        out[i] = "\n\n".join(own or [x for n, (x, f) in enumerate(every) if not f and (n not in gone or copied)])
    return out


def test_whole_result_equals_brute_force(spark):
    import random

    rng = random.Random(8)
    frame = ["<div>Site</div>", "<nav>Menu</nav>", "<p>Read more</p>", "<footer>Legal</footer>"]
    rows = []
    for i in range(120):
        body = [f"<p>{rng.choice(['one', 'two', 'three', 'four'])} {rng.randint(0, 3)}</p>" for _ in range(rng.randint(0, 6))]
        if rng.random() < 0.3:
            body = ["<article>", *body, "</article>"]
        page = frame[: rng.randint(0, 2)] + body + frame[rng.randint(2, 4) :]
        rows.append((i, f"https://h{i % 4}.example/{rng.choice('ab')}/{i:03d}", "".join(page)))
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    want = brute(rows)
    assert {i: r.text for i, r in got.items()} == want
    assert sum(r.n_shared > 0 for r in got.values()) > 40


def test_long_pages_and_repeated_ids(spark):
    import time

    line = lambda k: f"<p>line {k}</p>"
    rows = [(1, "http://a.example/1", "".join(map(line, range(30_000)))), (2, "http://a.example/2", "".join(line(k) if k % 2 else line(-k) for k in range(30_000)))]
    rows += [(3, "http://b.example/3", "<p>x</p>")] * 2
    began = time.perf_counter()
    got = html_text.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert sorted((r.page_id, r.text.count("line")) for r in got) == [(1, 14_999), (2, 14_999), (3, 0), (3, 0)]
    assert time.perf_counter() - began < 60
