"""Main text of HTML pages by two-pass block rules.

Pass one cuts the page into blocks at block-level tags and judges each by link density, length and stop-word density:
main text, boilerplate, or ambiguous where it is too short to tell. Pass two gives ambiguous blocks the label of their
nearest decided neighbours: main where both sides are main, else that of the nearer side. Elements that are boilerplate
by their meaning (menus, page headers and footers, sidebars, forms, scripts, and what class, id or role name as
adverts, notices or comments) are left out before; where a page marks its article or main part, only blocks in it are
judged, stop words don't count against them (an article may have few), and short ones without decided neighbours stay.

Defined results: null or empty html gives an empty text; unclosed tags end with their page; an unclosed comment or
script hides the rest; nothing is cut off. Every row gives one row, repeated ones too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ready

STOP_WORDS = frozenset(
    """
    a about after all also an and are as at be been but by can could did do for from had has have he her his how if in into is it its more no not of on one or our
    she so some than that the their them then there these they this to up was we were what when which who will with would you your
    aber als am auf aus bei das dass dem den der des die du ein eine einem einen einer es für hat ich im ist mit nach nicht noch nur oder sein sich sie sind so und
    von war wie wird wir zu zum zur
    au aux avec ce ces cette dans de du elle en est et il ils je la le les leur mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous
    al como con del el ella ellos era es está esta este fue ha hay la las lo los más me muy o para pero por se según ser si sin sobre su sus también una uno y ya
    """.split()
)
#: Characters, shares: a block is short below SHORT, long from LONG; stop words are few below LOW, many from HIGH; links rule from LINKS.
SHORT, LONG, LOW, HIGH, LINKS = 70, 200, 0.15, 0.25, 0.3

_RAW = "script|style|noscript|template|title|textarea|svg|iframe|object|select|button"
_TOKEN = re.compile(rf"""<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})\b(?:[^>"']|"[^"]*"|'[^']*')*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<tag>[a-z][^\s/>]*)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*)>|<[!?/][^>]*(?:>|\Z)|<[a-z][^>]*(?:>|\Z)""", re.S | re.I)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""\bhidden\b(?!\s*=)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_DROPPED = frozenset("nav footer aside form menu dialog head fieldset".split())
_ADVERT = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies footer gdpr login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets".split()
)
_COMMENT = frozenset("comment comments commentlist disqus respond replies reply".split())


def _hints(attrs: str) -> set[str]:
    return {w for m in _HINT.finditer(attrs) for w in re.split(r"[^a-z0-9]+", (m[1] or m[2] or m[3] or "").lower())}


class _Block:
    __slots__ = ("heading", "inside", "linked", "parts")

    def __init__(self, inside: bool):
        self.parts: list[str] = []
        self.linked = 0
        self.heading = False
        self.inside = inside


def blocks(page: str) -> tuple[list[tuple[str, float, bool, bool]], bool]:
    """(text, share of linked characters, whether inside the article, whether a heading) of each block kept, and whether the page marks an article."""
    out: list[tuple[str, float, bool, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, in the article
    dropped = inside = marked = False
    links = breaks = at = 0
    block = _Block(False)

    def flush() -> None:
        nonlocal block, breaks
        text = " ".join("".join(block.parts).split())
        if text:
            out.append((text, min(1.0, block.linked / len(text)), block.inside, block.heading))
        block, breaks = _Block(inside), 0

    def add(raw: str) -> None:
        nonlocal breaks
        if raw and not dropped:
            text = html.unescape(raw) if "&" in raw else raw
            block.parts.append(text)
            if not text.isspace():
                breaks = 0
                if links:
                    block.linked += len(" ".join(text.split()))

    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m["raw"]:
                block.parts.append(" ")
            continue
        tag, closing = tag.lower(), bool(m["end"])
        if tag == "br":
            breaks += 1
            block.parts.append(" ")
            if breaks > 1:
                flush()
            continue
        if tag == "a":
            links = 0 if closing else 1
            continue
        if tag in _BLOCKS:
            flush()
            block.heading = not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if closing:
            if any(x[0] == tag for x in stack):
                while stack.pop()[0] != tag:
                    pass
                dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                block.inside = inside
            continue
        if tag in _VOID or (tag not in _BLOCKS and tag != "span"):
            continue
        if tag in _BLOCKS and stack and stack[-1][0] == "p":
            stack.pop()
            dropped, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        attrs = m["attrs"]
        now_dropped = dropped or tag in _DROPPED or (tag == "header" and not inside)
        if attrs and not now_dropped and tag not in ("html", "body", "main"):
            hints = _hints(attrs)
            now_dropped = bool(hints & _COMMENT) or (tag != "article" and bool(hints & _ADVERT)) or ("header" in hints and not inside and tag != "article") or bool(_HIDDEN.search(attrs))
        if tag in ("article", "main") and not now_dropped:
            marked = inside = True
        if not attrs.rstrip().endswith("/") or tag in _BLOCKS:
            stack.append((tag, now_dropped, inside))
            dropped = now_dropped
            block.inside = inside
    add(page[at:])
    flush()
    return out, marked


def judged(text: str, linked: float, article: bool) -> str:
    """main, boilerplate or ambiguous, by the block alone."""
    if linked >= LINKS:
        return "boilerplate"
    if len(text) < SHORT:
        return "boilerplate" if linked > 0 and not article else "ambiguous"
    if article:
        return "main"
    words = [w for w in re.findall(r"[^\W\d_]+", text.lower())]
    stop = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if stop >= HIGH:
        return "main" if len(text) >= LONG or stop >= HIGH * 1.2 else "ambiguous"
    if stop >= LOW:
        return "ambiguous"
    return "boilerplate"


def main_text(page: str | None) -> str:
    """The main text of one page."""
    if not page:
        return ""
    found, marked = blocks(page)
    if marked:
        found = [b for b in found if b[2]]
    labels = [judged(text, linked, marked) for text, linked, _, _ in found]
    n = len(labels)
    before, after = [-1] * n, [n] * n
    for k in range(n):
        before[k] = k if labels[k] != "ambiguous" else (before[k - 1] if k else -1)
    for k in range(n - 1, -1, -1):
        after[k] = k if labels[k] != "ambiguous" else (after[k + 1] if k + 1 < n else n)
    kept = []
    for k, (text, _, _, heading) in enumerate(found):
        a, b = before[k], after[k]
        left, right = labels[a] if a >= 0 else None, labels[b] if b < n else None
        if left is None and right is None:
            label = "main" if marked else "boilerplate"
        elif marked and (left is None or right is None):
            label = "main" if "main" in (left, right) or n <= 2 else right or left
        elif left == right or right is None:
            label = left
        elif left is None:
            label = right
        else:
            label = left if k - a < b - k + (not heading) else right  # a heading goes with what follows
        if label == "main":
            kept.append(text)
    return "\n".join(kept)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(h) for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for pages (page_id, url, html)."""
    ready(pages.sparkSession)
    cast = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return cast.mapInArrow(_texts, "page_id long, url string, text string, n_chars long")
