"""Main text of web pages: what a page doesn't share with its nearest page by URL, with the page's own marks as a guard.

A page is cut into lines, one for each block element. Pages are paired by URL: within a host, sorted by path, a page's
partner is the neighbour with the longer common path. The lines of both pages, furniture included, are aligned by a longest
common subsequence and the shared ones are deleted. Two guards hold back what pages have in common but is content: lines of a marked
article (article, else main) stay, since articles share quotes and copies; and a page that shares nearly all of its
text is a copy of its partner and not a template around other content. Of the lines that are left, those that the markup
shows to be furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) and,
if the page marks its article, those outside it, go too. n_shared says how many lines differencing has deleted.

Pages are parsed twice: for the hashes of their lines, which are all that pairing needs, and for their text, which is shuffled
once, to the partner's hashes.
Defined results: null html is empty, and gives an empty text; repeated page ids pair alike (a repeated id is one page of several
forms: its partners compare with the least of them); pages without lines are no partners, and pages with null id or
url have no partner and keep all lines.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from lakeloom.llm._durable import written

#: A page whose partner shares more than this part of its characters is a copy: nothing is deleted.
COPY_SHARE = 0.9

_PIECE = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|noscript|textarea|title|iframe|svg)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([A-Za-z][A-Za-z0-9-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)/?(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S | re.I)
_ATTR = re.compile(r"([A-Za-z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_FURNITURE_TAGS = frozenset("nav footer aside form head button select dialog menu object canvas audio video map".split())
_BLOCK_TAGS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
_FURNITURE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar side aside cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments discussion disqus reply replies respond pagination pager toolbar widget".split()
)
_FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
_CLOSED_BY = {"p": _BLOCK_TAGS, "li": frozenset(["li"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option"])}


def _is_furniture(tag: str, attrs: str, inside: bool) -> bool:
    if tag in _FURNITURE_TAGS or tag == "header" and not inside:
        return True
    if not attrs.strip() or tag in ("html", "body"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if name == "role" and value in _FURNITURE_ROLES:
            return True
        if name in ("class", "id") and not _FURNITURE_WORDS.isdisjoint(re.split(r"[^a-z]+", value)):
            return True
    return False


def lines_of(page: str | None) -> tuple[list[str], list[str], list[tuple[str, bool]]]:
    """(lines of the article element, lines of the main element, all lines with a flag for furniture), in page order.

    Lines of the first two aren't furniture.
    """
    article: list[str] = []
    main: list[str] = []
    every: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool, bool]] = []  # tag, furniture, in article, in main
    text: list[str] = []
    around: list[str] = []  # text of furniture
    furniture = in_article = in_main = False

    def end_line() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            every.append((line, False))
            if in_article:
                article.append(line)
            if in_main:
                main.append(line)
        if around and (line := " ".join("".join(around).split())):
            every.append((line, True))
        around.clear()

    def leave(k: int) -> None:
        nonlocal furniture, in_article, in_main
        del stack[k:]
        _, furniture, in_article, in_main = stack[-1] if stack else ("", False, False, False)

    for m in _PIECE.finditer(page or ""):
        tag = m[3]
        if tag is None:
            if m[1] is None and not m[0].startswith(("<!", "<?", "</")):
                (around if furniture else text).append(html.unescape(m[0]))
            continue
        tag = tag.lower()
        if m[2]:
            if tag in _BLOCK_TAGS:
                end_line()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    leave(k)
                    break
            continue
        if tag == "br":
            (around if furniture else text).append(" ")
            continue
        if tag in _BLOCK_TAGS:
            end_line()
        if tag in _VOID_TAGS:
            continue
        for k in range(len(stack) - 1, -1, -1):
            if tag in _CLOSED_BY.get(stack[k][0], ()):
                leave(k)
                break
            if stack[k][0] in _BLOCK_TAGS:
                break
        if tag in _BLOCK_TAGS or tag in _FURNITURE_TAGS or m[4].strip():
            furniture = furniture or _is_furniture(tag, m[4], in_article or in_main)
            in_article = in_article or tag == "article" and not furniture
            in_main = in_main or (tag == "main" or 'role="main"' in m[4]) and not furniture
            stack.append((tag, furniture, in_article, in_main))
    end_line()
    return article, main, every


#: Cells (lines of a page times lines of its partner) that an alignment may hold as bits at once.
CELLS = 1 << 26


def _reach(a: list[int], b: list[int]) -> np.ndarray:
    """The length of the longest common subsequence of a and the first j of b, for each j."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    v = full = (1 << len(b)) - 1
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(b)]
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common_lines(a: list[int], b: list[int], cells: int = CELLS) -> list[int]:
    """Positions in a of one longest common subsequence with b.

    Rows of bits, one word operation for many cells; pages with more than `cells` cells are halved where the best
    alignments of both halves meet, so that memory grows with the lines and not with their square.
    """
    if not a or not b:
        return []
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    if same:
        return [*range(same), *(same + i for i in common_lines(a[same:], b[same:], cells))]
    if len(a) * len(b) > cells and len(a) > 1:
        mid = len(a) // 2
        j = int((_reach(a[:mid], b) + _reach(a[mid:][::-1], b[::-1])[::-1]).argmax())
        return common_lines(a[:mid], b[:j], cells) + [mid + i for i in common_lines(a[mid:], b[j:], cells)]
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    rows, v = [], full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    out, j = [], len(b)
    for i in range(len(a) - 1, -1, -1):
        # row bits are 0 where the length grows; go left past columns that don't add to row i
        before = rows[i - 1] if i else full
        while j and rows[i] >> (j - 1) & 1:
            j -= 1
        if j and before >> (j - 1) & 1 or j and (full & ~before & ((1 << j) - 1)).bit_count() < (full & ~rows[i] & ((1 << j) - 1)).bit_count():
            if a[i] == b[j - 1]:
                out.append(i)
                j -= 1
    return out[::-1]


def _parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page: the text if its article is marked, else its lines; and hashes of all lines, with sizes, below 0 for furniture
    and 0 for lines of a marked article."""
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            marked, texts, lines, hashes, sizes = [], [], [], [], []
            for page in part.column(2).to_pylist():
                article, main, every = lines_of(page)
                own = article or main
                marked.append(bool(own))
                texts.append("\n\n".join(own) if own else None)
                lines.append(None if own else [x for x, _ in every])
                hashes.append([xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x, _ in every])
                left = Counter(own)
                sizes.append([])
                for x, furniture in every:
                    guarded = not furniture and left[x] > 0
                    left[x] -= guarded
                    sizes[-1].append(-len(x) if furniture else 0 if guarded else len(x))
            columns = [pa.array(marked), pa.array(texts, pa.string()), pa.array(lines, pa.list_(pa.string())), pa.array(hashes, pa.list_(pa.int64())), pa.array(sizes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], ["id", "url", "marked", "text", "lines", "hashes", "sizes"])


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, host, path, other_id, shared) of neighbours in a sorted partition; its first and last row have other_id null."""
    last = None
    out: list[tuple] = []

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 5
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["id", "host", "path", "other_id", "shared"])
        out.clear()
        return made

    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if last is None:
                out.append((*row, None, None))
            elif last[1] == row[1]:
                shared = _shared_path(last[2], row[2])
                out += [(*row, last[0], shared), (*last, row[0], shared)]
            last = row
        yield flush()
    if last is not None:
        out.append((*last, None, None))
        yield flush()


def _shared_path(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def partners(pages: DataFrame) -> DataFrame:
    """(id, other_id) of pages (id bigint, url): the neighbour by path within the host with the longer common path.

    Only keys are sorted, in ranges of about equal size whatever the hosts' sizes; the ends of ranges, one pair for
    each range, are joined up on the driver.
    """
    spark = pages.sparkSession
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"(?:/|\.html?)$", "")
    keys = pages.where("id is not null and url is not null").groupBy("id").agg(F.min("url").alias("url")).select("id", host.alias("host"), path.alias("path"))
    sorted_ = keys.repartitionByRange("host", "path", "id").sortWithinPartitions("host", "path", "id")
    kinds = StructType([StructField("id", LongType()), StructField("host", StringType()), StructField("path", StringType()), StructField("other_id", LongType()), StructField("shared", LongType())])
    found = written(sorted_.mapInArrow(_neighbours, kinds))
    ends = sorted((r.host, r.path, r.id) for r in found.where("other_id is null").distinct().collect())
    across = [(b[2], a[2], _shared_path(a[1], b[1])) for a, b in zip(ends, ends[1:]) if a[0] == b[0]]
    across += [(b, a, n) for a, b, n in across]
    both = found.where("other_id is not null").select("id", "other_id", "shared").union(spark.createDataFrame(across, "id bigint, other_id bigint, shared bigint"))
    return both.groupBy("id").agg(F.max_by("other_id", F.struct("shared", -F.col("other_id"))).alias("other_id"))


def _deleted(mine: pd.Series, theirs: pd.Series, sizes: pd.Series) -> pd.Series:
    """For each line, whether the page shares it with its partner; not those of a marked article, and no text if it is a copy."""
    out = []
    for a, b, n in zip(mine, theirs, sizes):
        shared = common_lines(list(a), list(b)) if a is not None and b is not None else []
        shared = [i for i in shared if n[i]]
        text = sum(int(x) for x in n if x > 0)
        copy = text and sum(int(n[i]) for i in shared if n[i] > 0) > COPY_SHARE * text and all(n)
        gone = np.zeros(len(n), dtype=bool)
        gone[[i for i in shared if n[i] < 0] if copy else shared] = True
        out.append(gone)
    return pd.Series(out)


def main_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text, n_chars, n_shared) of every row of pages; the lines of a text are joined by an empty line."""
    schema = "id bigint, url string, marked boolean, text string, lines array<string>, hashes array<bigint>, sizes array<bigint>"
    rows = pages.select(pages[key].cast("bigint").alias("id"), pages[url].alias("url"), pages[page].alias("html"))
    known = rows.where("id is not null")
    hashes = written(known.mapInArrow(_parse, schema).select("id", "url", "hashes"))
    theirs = hashes.groupBy(F.col("id").alias("other_id")).agg(F.min("hashes").alias("theirs"))
    drop = partners(hashes.where("size(hashes) > 0").select("id", "url")).join(theirs, "other_id").select("id", "theirs")
    alone = rows.where("id is null").mapInArrow(_parse, schema).withColumn("theirs", F.lit(None).cast("array<bigint>"))
    met = known.mapInArrow(_parse, schema).join(drop, "id", "left").unionByName(alone).withColumn("gone", F.pandas_udf(_deleted, ArrayType(BooleanType()))("hashes", "theirs", "sizes"))
    left = "array_join(filter(lines, (x, i) -> sizes[i] > 0 and not gone[i]), '\\n\\n')"
    out = met.select("id", "url", F.expr(f"if(marked, text, {left})").alias("text"), F.expr("bigint(size(filter(gone, g -> g)))").alias("n_shared"))
    return out.select(F.col("id").alias(key), F.col("url").alias(url), "text", F.length("text").cast("bigint").alias("n_chars"), "n_shared")
