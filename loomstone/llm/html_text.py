"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of the page. A line weighs what its text holds outside of links; lines of
page furniture (by element, role, or a word of class or id) weigh nothing. Where the page names its article, and the article is not a mere
teaser beside more text, a line inside it weighs all its text and MOST besides, a line outside it nothing. The weights are summed over sliding windows of lines.
Text begins where the sums surge above a level and ends where they dive back; between the two points every line counts, short ones too. The level follows the
page's median window and has a bound, so that no block of text, however long, hides others.
"""

from __future__ import annotations

import html
import re
import statistics

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import slices

WINDOW = 3
#: Share of the median window above which text surges, where no article is named, and the most characters that are asked of a window.
SURGE = 0.12
MOST = 80
#: A named article that holds less than this share of the page's text outside furniture is a teaser.
TEASER = 0.25

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<raw>script|style|textarea|title|xmp|noembed|noframes|iframe)(?=[\s/>]).*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)"
    r"|</?(?:[a-z][^>]*)?\Z",
    re.IGNORECASE | re.DOTALL,
)
ATTR = re.compile(r"(class|id|role|aria-label|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
FURNITURE = frozenset("nav footer aside form menu button select noscript template svg math object canvas audio video dialog head map datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar form toolbar status".split())
#: Words of class or id that name furniture.
NAMES = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead topbar toolbar footer bottombar colophon sidebar aside rail ad ads adv advert adverts"
    " advertisement adsense banner promo promotion promoted sponsor sponsored sponsorship cookie cookies consent gdpr notice notices alert notification popup modal overlay"
    " lightbox comment comments commentlist disqus discussion reply replies respond reactions share sharing social related recommended recirculation newsletter subscribe"
    " subscription signup login signin search searchform form pagination pager widget widgets copyright legal disclaimer skip".split()
)
CLOSES_ITSELF = frozenset("p li dt dd option tr".split())


def _furniture(tag: str, attrs: str, in_article: bool) -> bool:
    if tag in FURNITURE or tag == "header" and not in_article:
        return True
    if not attrs or tag in ("html", "body", "main", "article") and "comment" not in attrs.lower():
        return False
    for name, *values in ATTR.findall(attrs):
        name, value = name.lower(), "".join(values).lower()
        if name == "role":
            if value.strip() in ROLES:
                return True
        elif name == "hidden":
            if value != "until-found":
                return True
        elif name in ("class", "id") and (words := set(re.split(r"[^a-z0-9]+", value))) & NAMES:
            if not (in_article and words & NAMES <= {"header"}):
                return True
    return False


def lines(page: str) -> tuple[list[tuple[str, int, bool]], bool]:
    """(text, text outside links, in an article) for each block in page order, where furniture leaves an empty line; whether an article is named."""
    out: list[tuple[str, int, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, furniture, article
    opened: dict[str, int] = {}  # how often a tag is in the stack
    text: list[str] = []
    linked = article = links = dropped = 0
    named = False

    def flush() -> None:
        nonlocal linked
        if text:
            s = " ".join("".join(text).split())
            if s:
                out.append((s, max(0, len(s) - linked), article > 0))
            text.clear()
        linked = 0

    def gap() -> None:
        if out and out[-1][0]:
            out.append(("", 0, False))

    def pop() -> None:
        nonlocal dropped, article, links
        tag, bad, main = stack.pop()
        opened[tag] -= 1
        dropped -= bad
        article -= main
        links -= tag == "a"

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at and not dropped:
            s = html.unescape(page[at : m.start()])
            text.append(s)
            if links:
                linked += len(s)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in BLOCKS:
            flush()
        elif tag in ("br", "td", "th"):
            text.append(" ")
        if m["end"]:
            if opened.get(tag):
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_ITSELF and stack and stack[-1][0] == tag:
            pop()
        attrs = m["attrs"] or ""
        if tag == "main" and dropped:
            while dropped:
                pop()
        bad = _furniture(tag, attrs, article > 0)
        main = not bad and not dropped and (tag in ("article", "main") or "articlebody" in attrs.lower())
        if bad and not dropped:
            flush()
            gap()
        if bad or main or tag in BLOCKS or tag == "a":
            stack.append((tag, bad, main))
            opened[tag] = opened.get(tag, 0) + 1
            dropped += bad
            article += main
            links += tag == "a"
            named |= main
    if at < len(page) and not dropped:
        text.append(html.unescape(page[at:]))
    flush()
    return out, named


def stretches(weights: list[int], level: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """The half-open stretches of lines between surge and dive points of the window sums."""
    n = len(weights)
    sums = [sum(weights[i : i + window]) for i in range(n)]
    found, i = [], 0
    while i < n:
        if sums[i] <= level:
            i += 1
            continue
        dive = i
        while dive < n and sums[dive] > level:
            dive += 1
        a, b = i, min(n, dive + window - 1)
        while a < b and not weights[a]:
            a += 1
        while b > a and not weights[b - 1]:
            b -= 1
        if a < b:
            if found and a <= found[-1][1]:
                found[-1] = found[-1][0], max(b, found[-1][1])
            else:
                found.append((a, b))
        i = dive
    return found


def main_text(page: str | None) -> str:
    if not page:
        return ""
    rows, named = lines(page)
    inside, outside = (sum(w for _, w, main in rows if main is side) for side in (True, False))
    named = named and any(main and t for t, _, main in rows) and inside >= TEASER * (inside + outside)
    weights = [(len(t) + MOST if t and main else 0) if named else w for t, w, main in rows]
    if not any(weights):
        return ""
    sums = [s for i in range(len(weights)) if (s := sum(weights[i : i + WINDOW]))]
    return "\n".join(t for a, b in stretches(weights, min(MOST, SURGE * statistics.median(sums))) for t, _, _ in rows[a:b] if t)


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars. Null or empty pages have the empty text; repeated rows come back as often; other columns are not read."""
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches):
        for part in slices(batches, 2):
            texts = [main_text(x) for x in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return pages.select(id_col, url_col, html_col).mapInArrow(run, schema)
