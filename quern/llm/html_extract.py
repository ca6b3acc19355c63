"""HTML extraction by differencing a page with the pages of the nearest URLs.

A page becomes text lines, one for each block. Within each host, pages are ordered by URL path, and each is held against
up to `NEAR` pages on either side. Lines are aligned by longest common subsequence, and the lines that two pages share
are deleted: a site's menus, notices and footers. Structure breaks ties only:

* A shared line inside an article element stays, as articles repeat licence lines and copies of an article share all.
* A neighbour that shares over nine tenths of a page's text outside articles is a copy and deletes nothing.
* Sites vary their frames from page to page, so unshared lines may be frame too: those within elements that can't be main
  text (menus, page headers and footers, sidebars, forms, scripts, styles, adverts, notices, reader comments) go.
* Of what is left, an article that holds the greater part of the text stands with the unshared lines of its main
  element; else (an article is but a teaser card) all unshared lines stay.

Nothing gathers a host: pages are dealt by ranges of (host, path, row), so that a host of many pages spans many ranges,
and a range's first and last pages are handed to the ranges beside it. Null and empty pages have empty texts; an empty
table gives no rows. Pages without a host pair by path under an empty host. Repeated rows are one page, never paired with
themselves, and come out as often as they stand. Very long pages are read whole. Columns other than page_id, url and html,
whatever their names, are left out.
"""

from __future__ import annotations

import html as entities
import re
from urllib.parse import urlsplit

import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, saved, table, texts

# Fixed values of HTML: elements that start a block, that have no end, whose content is raw, and whose content is no text of the page.
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
FRAME = frozenset("nav footer aside form button select menu dialog head object canvas audio video label".split())
#: Words in class, id or role that mark no main text.
MARKS = frozenset("ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter notice overlay popup promo promoted related respond search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split())
#: Words that may stand beside a mark in one class name.
NEUTRAL = frozenset("area bar block bottom box container inner left list main outer page primary right secondary section site top wrap wrapper".split())
ATTRIBUTES = r"""(?:[\s/]++|[^\s/>=][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))?+|=)*+"""
TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({ATTRIBUTES})(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>=][^\s/>=]*+)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)|[^\s/>=]++""")
WORDS = re.compile(r"[A-Za-z]+")
#: How many pages on either side a page is held against.
NEAR = 2
#: A page that shares more than this part of the characters outside articles is a copy.
COPY = 0.9


def _marked(attributes: str) -> bool:
    """Whether a whole name in class, id or role is made of marks, with neutral words at most ("has-sidebar" is none)."""
    for key, value in ATTRIBUTE.findall(attributes):
        if key.lower() not in ("class", "id", "role"):
            continue
        for name in value.strip("\"'").split():
            words = {w.lower() for w in WORDS.findall(name)}
            if words & MARKS and words <= MARKS | NEUTRAL:
                return True
    return False


def lines(page: str) -> list[tuple[str, int]]:
    """The text lines of a page in order; with each 0 if it's frame, 1 if plain, 2 if in main, 3 if in an article.

    Where the only article or main element is itself marked or stands inside frame, and holds more than all plain lines, it counts.
    """
    found = _lines(page, False)
    if all(s < 2 for _, s in found) and re.search("<article|<main|role", page, re.I):
        again = _lines(page, True)
        if sum(len(x) for x, s in again if s > 1) > sum(len(x) for x, s in found if s == 1):
            return again
    return found


def _lines(page: str, freed: bool) -> list[tuple[str, int]]:
    """The lines; `freed` lets an outermost article or main element stand above marks and frame."""
    out: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, int]] = []  # open elements and the state of what stands in them
    state, at, end = 1, 0, len(page)

    def flush() -> None:
        line = " ".join(entities.unescape("".join(parts)).split())
        if line:
            out.append((line, state))
        parts.clear()

    while at < end:
        m = TAG.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        parts.append(page[at : m.start()])
        at = m.end()
        closing, name, attributes = m[1], (m[2] or "").lower(), m[3] or ""
        if not name:
            continue
        if name in BLOCKS:
            flush()
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    if any(s != state for s in (stack[k][1],)) or name in BLOCKS:
                        flush()
                    del stack[k:]
                    break
            new = stack[-1][1] if stack else 1
            if new != state:
                flush()
                state = new
            continue
        if name in RAW:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if name in VOID:
            continue
        if name in BLOCKS:  # what a new block ends
            for implied, until in (("p", "div article section main table td li body"), ("li", "ul ol menu"), ("dd", "dl"), ("dt", "dl"), ("td", "tr table"), ("th", "tr table"), ("tr", "table")):
                if implied == "p" or implied == name or (implied, name) in (("dd", "dt"), ("dt", "dd"), ("td", "th"), ("th", "td")):
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] == implied:
                            del stack[k:]
                            break
                        if stack[k][0] in until.split():
                            break
            state = stack[-1][1] if stack else 1
        below = state
        whole = name == "article" or name == "main" or bool(re.search(r"\brole\s*=\s*[\"']?main\b", attributes))
        if freed and whole and all(s < 2 for _, s in stack):
            new = 3 if name == "article" else 2
        elif below and (name in FRAME or (name == "header" and below < 2) or (name != "body" and name != "html" and _marked(attributes))):
            new = 0
        elif below and name == "article":
            new = 3
        elif below and whole:
            new = max(below, 2)
        else:
            new = below
        if new != state:
            flush()
            state = new
        if not attributes.rstrip().endswith("/") or name in BLOCKS:
            stack.append((name, new))
    flush()
    return out


def common_lines(a: list[int], b: list[int]) -> set[int]:
    """The places in a of a longest common subsequence of a and b; bit vectors hold one row of the table each."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    i, j, out = len(a), len(b), set()
    while i and j:
        if rows[i - 1] >> (j - 1) & 1:
            j -= 1
            continue
        i -= 1
        if i == 0 or rows[i - 1] >> (j - 1) & 1:
            j -= 1
            out.add(i)
    return out


def outside(found: list[tuple[str, int]]) -> list[int]:
    """The places of the lines that differencing may delete: all but those in an article."""
    return [k for k, (_, s) in enumerate(found) if s < 3]


def line_hashes(found: list[tuple[str, int]]) -> list[int]:
    """What those lines are compared by."""
    return [xxhash.xxh3_64_intdigest(found[k][0]) - (1 << 63) for k in outside(found)]


def shared_lines(found: list[tuple[str, int]], others: list[list[int]]) -> set[int]:
    """The places of the lines that the page shares with any near page that isn't a copy of it."""
    at, own = outside(found), line_hashes(found)
    text = {k: len(found[k][0]) for k in at if found[k][1]}
    out: set[int] = set()
    for other in others:
        same = {at[i] for i in common_lines(own, other)}
        if sum(text.get(k, 0) for k in same) <= COPY * sum(text.values()):
            out |= same
        else:  # a copy, which tells frame from text no better than structure does
            out |= {k for k in same if not found[k][1]}
    return out


def main_text(page: str, others: list[list[int]]) -> tuple[str, int]:
    """The main text of a page, given the lines' hashes of the pages that it's held against; and the number of lines that they delete."""
    found = lines(page)
    shared = shared_lines(found, others)
    left = [(x, s) for k, (x, s) in enumerate(found) if s and k not in shared]
    best = max((s for _, s in left), default=0)
    if best == 3 and 2 * sum(len(x) for x, s in left if s == 3) >= sum(len(x) for x, _ in left):
        left = [(x, s) for x, s in left if s > 1]
    elif best == 2:
        left = [(x, s) for x, s in left if s == 2]
    return " ".join(x for x, _ in left), len(shared)


def place(url: str | None) -> tuple[str, str]:
    """Host and path of a URL, empty where it has none."""
    try:
        parts = urlsplit(url or "")
        return (parts.hostname or ""), parts.path
    except ValueError:
        return "", url or ""


def neighbours(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """page_id, row and the line hashes of the nearest pages, for every distinct row of pages (page_id, url, html)."""

    def each(part: dict) -> dict:
        at = [place(u) for u in part["url"].to_pylist()]
        return {"page_id": part["page_id"], "row": part["row"], "host": [h for h, _ in at], "path": [p for _, p in at], "hashes": [line_hashes(lines(x)) for x in texts(part["html"])]}

    keys = arrow_map(pages.select("page_id", "row", "url", "html"), each, "page_id long,row long,host string,path string,hashes array<bigint>").dropDuplicates(["page_id", "row"])
    order = ["host", "path", "row", "page_id"]
    dealt = saved(keys.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("range", F.spark_partition_id()), spark, "html-keys")
    within = W.partitionBy("range").orderBy(*order)
    page = F.struct("host", "hashes")
    # At most NEAR rows from each end of a range are handed on, so this table has a few rows a range.
    marked = dealt.withColumn("up", F.row_number().over(within)).withColumn("down", F.count("*").over(W.partitionBy("range")) - F.col("up") + 1)
    ends = marked.filter((F.col("up") <= NEAR) | (F.col("down") <= NEAR)).groupBy("range").agg(
        F.array_sort(F.collect_list(F.when(F.col("up") <= NEAR, F.struct("up", page.alias("page"))))).alias("low"),
        F.array_sort(F.collect_list(F.when(F.col("down") <= NEAR, F.struct("down", page.alias("page"))))).alias("high"),
    )
    whole = W.orderBy("range")
    ends = ends.withColumn("handed", F.lag("high").over(whole)).withColumn("next", F.lead("low").over(whole)).select("range", "handed", "next")
    sides = []
    for k in range(1, NEAR + 1):
        before = F.coalesce(F.lag(page, k).over(within), F.get(F.col("handed.page"), (k - F.col("up")).cast("int")))
        after = F.coalesce(F.lead(page, k).over(within), F.get(F.col("next.page"), (k - F.col("down")).cast("int")))
        sides += [before, after]
    met = marked.join(F.broadcast(ends), "range").select("page_id", "row", "host", F.array(*sides).alias("sides"))
    others = F.transform(F.filter("sides", lambda x: x["host"] == F.col("host")), lambda x: x["hashes"])
    return met.select("page_id", "row", others.alias("others"))


def extract(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """page_id, url, text, n_chars and n_shared (lines deleted as shared) for every row of pages (page_id, url, html)."""
    pages = pages.select("page_id", "url", "html", F.xxhash64("page_id", "url", "html").alias("row"))
    near = neighbours(pages, spark).withColumnsRenamed({"page_id": "_page", "row": "_row"})
    whole = pages.join(near, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("row") == F.col("_row")), "left")

    def each(part: dict) -> dict:
        found = [main_text(x, others or []) for x, others in zip(texts(part["html"]), part["others"].to_pylist(), strict=True)]
        return {"page_id": part["page_id"], "url": part["url"], "text": [x for x, _ in found], "n_chars": [len(x) for x, _ in found], "n_shared": [n for _, n in found]}

    return arrow_map(whole.select("page_id", "url", "html", "others"), each, "page_id long,url string,text string,n_chars long,n_shared long")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"), spark)
