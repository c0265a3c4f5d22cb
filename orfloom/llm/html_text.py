"""Main text of HTML pages, by structure.

The article's blocks are found by elements and roles: what lies in navigation,
headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader
comments is left out, and where a page marks its main part (article, main) only
that part counts, unless it is a bare teaser beside paragraphs.  Removing what a host's pages repeat is not used to decide:
copies of an article on one host are long repeats too and must stay, and menus
that differ from page to page are not repeats at all (see the README).

Each page is worked on by itself, so a host with a third of all pages is
nothing special.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orfloom.llm import scratch

# HTML's element names by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noframes xmp".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that hold no main text.
SKIP = frozenset("head script style nav footer aside form noscript template iframe svg math button select textarea dialog menu object canvas audio video title noframes xmp".split())
MAIN = frozenset(("article", "main"))
#: Elements that running text and its headings are set in.
STORY = ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li", "dd", "td", "figcaption")
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar note".split())
#: Names of classes and ids that mark, outside the main part, what is not main text, as a word of a name (as in ``top-ad``).
AWAY = r"ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|comments?|respond|replies|reply|share|sharing|social|related|newsletter|subscribe|signup|login|popup|modal|overlay|widget"
#: More such names: as a word of a name outside the main part, as a whole name anywhere; in an article, ``section-header`` is text.
FRAME = r"banner|notice|alert|sidebar|menu|nav|navbar|navigation|breadcrumbs?|topbar|masthead|header|footer"
#: In an article, words of a name that mark adverts, and whole names of notices, adverts, comments and forms; ``share-price`` or ``related`` is text.
ADVERT, APART = r"ads?|advert\w*|sponsored", r"promo|cookies?|consent|gdpr|comments?|newsletter|subscribe|signup|login|popup|modal|overlay"
SKIP_INSIDE = re.compile(rf"(?:^|[\s_-])(?:{ADVERT})(?:$|[\s_-])|(?:^|\s)(?:{APART}|{FRAME})(?:$|\s)", re.IGNORECASE)
SKIP_OUTSIDE = re.compile(rf"(?:^|[\s_-])(?:{AWAY}|{FRAME})(?:$|[\s_-])", re.IGNORECASE)

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=\"'/>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([^\s=\"'/>]+)")


def _unseen(name: str, attrs: str, inside: bool) -> bool:
    """Whether an element is not shown at all."""
    return name in ("head", "script", "style", "noscript", "template", "title", "textarea", "noframes", "xmp")


def _skips(name: str, attrs: str, inside: bool) -> bool:
    if name in SKIP or (name == "header" and not inside):
        return True
    if not attrs.strip(" /"):
        return False
    for m in _ATTR.finditer(attrs):
        key = (m[1] or m[5] or "").lower()
        value = html.unescape(m[2] or m[3] or m[4] or "")
        if key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE)):
            return True
        if key == "role" and value.strip().lower() in SKIP_ROLES:
            return True
        if key in ("class", "id") and name not in ("html", "body") and name not in MAIN and (SKIP_INSIDE if inside else SKIP_OUTSIDE).search(value):
            return True
        if key == "class" and name == "article" and re.search(r"(?:^|[\s_-])(?:comments?|reply|ads?|related|promo)(?:$|[\s_-])", value, re.IGNORECASE):
            return True
    return False


def main_text(page: str) -> str:
    """The main text of a page: its blocks joined by newlines, white space within a block as one space.

    A marked main part counts alone, however short, unless it is a bare teaser:
    without any of STORY's elements, on a page that has some outside of it.
    """
    blocks = page_blocks(page, _skips)
    kinds = {kind for kind, _ in blocks}
    marked = 3 in kinds or (1 in kinds and 2 not in kinds)
    return "\n".join(t for kind, t in blocks if kind & 1 or not marked)


def page_blocks(page: str, skips=_unseen) -> list[tuple[int, str]]:
    """(kind, text) of each block outside the elements that skips names: 1 if it is in the page's marked main part, and 2 more in one of STORY's elements."""
    stack: list[tuple[str, bool, bool]] = []  # (element, in a skipped one, in a main one)
    is_open: Counter[str] = Counter()
    blocks: list[tuple[int, str]] = []
    own: list[str] = []
    skip = main = False
    at = 0

    def close_block():
        if own:
            text = " ".join(html.unescape("".join(own)).split())
            own.clear()
            if text:
                blocks.append((main + 2 * any(is_open[x] for x in STORY), text))

    def pop_to(k):
        nonlocal skip, main
        close_block()
        is_open.subtract(name for name, _, _ in stack[k:])
        del stack[k:]
        skip, main = (stack[-1][1], stack[-1][2]) if stack else (False, False)

    while True:
        m = _TAG.search(page, at)
        if not skip:
            own.append(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name == "br":
                own.append(" " if not skip else "")
                continue
            if not is_open[name]:
                if name in BLOCK and not skip:
                    close_block()
                continue
            k = next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name)
            if name in BLOCK or stack[k][1]:
                pop_to(k)
            else:
                is_open[name] -= 1
                del stack[k]
            continue
        if name in VOID:
            if not skip:
                if name == "hr":
                    close_block()
                else:
                    own.append(" " if name == "br" else "")
            continue
        if name in BLOCK:
            if not skip:
                close_block()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    pop_to(k)
                    break
                if stack[k][0] in BLOCK:
                    break
        if name in RAW:
            end = re.compile(rf"</{name}[^>]*>", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
            continue
        hide = skip or skips(name, m[3] or "", main)
        if hide and not skip:
            close_block()
        role_main = not hide and re.search(r"\brole\s*=\s*[\"']?main\b", m[3] or "", re.IGNORECASE)
        now_main = main or (not hide and (name in MAIN or bool(role_main)))
        if (m[3] or "").rstrip().endswith("/") and name not in BLOCK:
            continue
        stack.append((name, hide, now_main))
        is_open[name] += 1
        skip, main = hide, now_main
    close_block()
    return blocks


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: id_col, url_col, text (empty if none), n_chars.

    Null html is empty; null ids and urls pass through; repeated rows repeat; an
    empty table gives an empty result; further columns are not read.  Broken
    markup (elements left open, stray ends) is read as browsers do, roughly.
    """
    scratch.small_batches(pages.sparkSession)
    fields = {f.name: f.dataType.simpleString() for f in pages.schema.fields}

    def rows(batches):
        for batch in batches:
            text = pa.array([main_text(x or "") for x in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), text], ["id", "url", "text"])

    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    out = src.mapInArrow(rows, f"id {fields[id_col]}, url {fields[url_col]}, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
