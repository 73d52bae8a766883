"""Main text of web pages as the maximum-scoring run of their words and tags.

A page is a sequence of words and tags. A word scores the share of words like it that lie in the content of labelled
pages, a tag minus the share of tags like it that lie outside, and one linear scan finds the contiguous run of the
greatest sum: the content region. Like means: the same block element, in a link or not, and the same zone. Labelled
pages are those whose own markup names its article. Each is counted twice, once with these marks (zone inside or outside)
and once without (no zone), so that the weights serve pages with and without them.

Elements that are never content (scripts, menus, forms, notices, adverts, comments, ...) are known by name, role, class
or id; such an element scores like one tag, and what is inside it is no part of a region, also where it stands in one.
A form, or an element known by class or id alone, stays if the page's main text can only lie in it: see _dropped()."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetledger.llm.common import text_slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/)?(?P<name>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|([^\s=/>\"']+)")
_RAW = frozenset({"script", "style", "title", "textarea", "noscript", "iframe", "xmp", "noembed"})
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the first kind ends an open element of the second.
_ENDS = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "body": {"head"},
} | {b: {"p"} for b in _BLOCK - {"br", "li", "dt", "dd", "tr", "td", "th", "option", "body", "html", "head"}}

_NEVER = frozenset(
    "head script style title noscript template nav header footer aside form button select option textarea input label "
    "iframe svg math canvas video audio object embed map dialog menu menuitem fieldset xmp noembed".split()
)
_NEVER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
_NEVER_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent "
    "gdpr notice notices notification alert popup modal overlay sidebar sidebars aside rail widget widgets menu menus nav "
    "navbar navigation breadcrumb breadcrumbs comment comments disqus replies respond discussion share sharing social "
    "related recommended recommendations newsletter subscribe subscription signup login search pagination pager toolbar "
    "masthead copyright skip".split()
)
_FRAME_NAMES = frozenset({"header", "footer"})
_CONTENT_NAMES = frozenset("article post entry content main story".split())
_NEVER_BY_NAME_KEPT = frozenset({"html", "body", "main"})
_COMMENT_NAMES = frozenset("comment comments disqus replies respond discussion".split())
#: Names of lists of other texts, which are no content however long they are.
_LIST_NAMES = _COMMENT_NAMES | {"related", "recommended", "recommendations"}
#: In a class or id, what follows the first kind or stands before the second tells of a page's layout or state.
_LAYOUT_WORDS = frozenset("has have no not with without".split())
_STATE_WORDS = frozenset("open opened closed on off enabled disabled".split())
#: An element with at least this share of a page's words is not dropped for its class, its id or being a form.
BULK = 0.8


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for name, a, b, c, alone in _ATTRIBUTE.findall(text):
        found.setdefault((name or alone).lower(), unescape(a or b or c))
    return found


def _names(attributes: dict[str, str]) -> list[set[str]]:
    """The parts of each class and of the id that name the element itself."""
    found = []
    for raw in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        parts = [x for x in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", raw).lower()) if x]
        layout = next((i for i, x in enumerate(parts) if x in _LAYOUT_WORDS), len(parts))
        parts = parts[:layout]
        if parts and parts[-1] not in _STATE_WORDS:
            found.append(set(parts))
    return found


KEPT, BY_NAME, LISTED, FORM, NEVER = range(5)


def never_content(name: str, attributes: dict[str, str]) -> int:
    """NEVER if the element is never content, KEPT if it may be; LISTED, FORM and BY_NAME leave it to _dropped()."""
    if name in _NEVER and name != "form" or attributes.get("role", "").lower() in _NEVER_ROLES - {"form"}:
        return NEVER
    if "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return KEPT if name in _NEVER_BY_NAME_KEPT else NEVER
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return KEPT if name in _NEVER_BY_NAME_KEPT else NEVER
    if name == "form" or attributes.get("role", "").lower() == "form":
        return FORM
    if name in _NEVER_BY_NAME_KEPT or not ("class" in attributes or "id" in attributes):
        return KEPT
    names = _names(attributes)
    never = _COMMENT_NAMES if name == "article" else _NEVER_NAMES
    # a name that only tells of content speaks for the element; one like post-comments does not
    if any(n & _CONTENT_NAMES and not n & _NEVER_NAMES for n in names):
        return KEPT
    parts = set().union(*names)
    if parts & never & _LIST_NAMES:
        return LISTED
    return BY_NAME if parts & never or name != "article" and parts & _FRAME_NAMES else KEPT


@dataclass
class _Doubtful:
    """An element that is dropped unless _dropped() keeps it: what kind, the one around it, its words, and whether it
    holds a marked article or a main element."""

    kind: int
    parent: int
    words: int = 0
    article: bool = False
    main: bool = False


def _dropped(doubtful: list[_Doubtful], total: int) -> list[bool]:
    """Which of the elements are dropped; the first stands for the page. Kept are those that hold BULK of the page's
    words, lists of other texts not counted, or a main element, and forms that hold a marked article."""
    for d in reversed(doubtful[1:]):
        if d.kind == LISTED:
            total -= d.words
        else:
            up = doubtful[d.parent]
            up.words, up.article, up.main = up.words + d.words, up.article or d.article, up.main or d.main
    out = [False]
    for d in doubtful[1:]:
        whole = d.kind != LISTED and (d.main or d.kind == FORM and d.article or d.words and d.words >= BULK * total)
        out.append(out[d.parent] or not whole)
    return out


def _names_content(name: str, attributes: dict[str, str]) -> bool:
    return name in ("article", "main") or attributes.get("role") == "main" or attributes.get("itemprop") == "articleBody"


Item = tuple[str, str, int, int, bool]


def items(html: str) -> tuple[list[Item], bool]:
    """The page as (kind, text, words, block, named): kind is the tag's name, or block element and link mark of a run of
    words; block numbers rise at every block boundary; named: inside a marked article. Words of elements that are never
    content are left out. Second, whether anything is marked."""
    out: list[Item] = []
    owners: list[int] = []  # of each item the innermost doubtful element
    doubtful = [_Doubtful(KEPT, 0)]
    stack: list[tuple[str, bool, bool, int]] = []  # name, never content, marks content, owner outside
    never = marked = links = block = owner = 0
    marks: list[int] = []
    blocks = ["body"]
    at, size = 0, len(html)

    def pop() -> None:
        nonlocal never, marked, links, owner
        name, was_never, was_marked, owner = stack.pop()
        never -= was_never
        marked -= was_marked
        links -= name == "a"
        if name in _BLOCK and len(blocks) > 1:
            blocks.pop()

    def put(item: Item) -> None:
        out.append(item)
        owners.append(owner)

    def words(text: str) -> None:
        if not never and text:
            text = unescape(text)
            n = len(text.split())
            doubtful[owner].words += n
            if n or text:
                put((f"{blocks[-1]}{'+a' if links else ''}", text, n, block, marked > 0))

    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            words(html[at:])
            break
        words(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if name in _BLOCK:
            block += 1
        if m["end"]:
            if any(s[0] == name for s in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
            if not never:
                put((f"/{name}", "", 0, block, marked > 0))
            continue
        attributes = _attributes(m["attrs"]) if m["attrs"].strip(" /\n\t") else {}
        ends = _ENDS.get(name)
        if ends:
            # not beyond the nearest container
            depth = next((i for i, s in enumerate(reversed(stack)) if s[0] in ends), None)
            between = [s[0] for s in stack[len(stack) - depth :]] if depth else []
            if depth is not None and not any(b in _BLOCK and b not in ends for b in between):
                for _ in range(depth + 1):
                    pop()
        if not never:
            put((name, "", 0, block, marked > 0))
        if name in _RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(html, at)
            at = close.end() if close else size
            continue
        if name in _VOID or m["attrs"].endswith("/") and name not in _BLOCK:
            continue
        kind = never_content(name, attributes)
        is_never, is_marked = kind == NEVER, _names_content(name, attributes) and not never and kind == KEPT
        stack.append((name, is_never, is_marked, owner))
        if kind in (BY_NAME, LISTED, FORM) and not never:
            doubtful.append(_Doubtful(kind, owner))
            owner = len(doubtful) - 1
        if is_marked:
            marks.append(owner)
            doubtful[owner].article = True
            doubtful[owner].main |= name != "article"
        never += is_never
        marked += is_marked
        links += name == "a"
        if name in _BLOCK:
            blocks.append(name)
    if len(doubtful) > 1:
        gone = _dropped(doubtful, sum(d.words for d in doubtful))
        out = [item for item, at in zip(out, owners, strict=True) if not gone[at]]
        marks = [at for at in marks if not gone[at]]
    return out, bool(marks)


def _feature(item: Item, zoned: bool) -> str:
    kind, _, n, _, named = item
    zone = ("inside" if named else "outside") if zoned else "plain"
    base = kind.lstrip("/").removesuffix("+a")
    known = kind if base in _BLOCK or base in _NEVER or base in _VOID or base in ("a", "b", "i", "em", "strong", "span") else "other"
    return f"{zone}:{'w' if n else 't'}:{known}"


def weights(pages: DataFrame, html_column: str = "html") -> dict[str, float]:
    """The score of each kind of word and tag, from all pages that name their article. The kinds are few: a zone, a known
    element, a link mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, html_column):
            seen: Counter[tuple[str, bool]] = Counter()
            for html in batch.column(html_column).to_pylist():
                found, any_mark = items(html or "")
                if any_mark:
                    for item in found:
                        if item[2] or not item[1]:
                            for zoned in (False, True):
                                seen[_feature(item, zoned), item[4]] += item[2] or 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for (k, _) in seen]), pa.array([i for (_, i) in seen]), pa.array(list(seen.values()))]
                if seen
                else [pa.array([], pa.string()), pa.array([], pa.bool_()), pa.array([], pa.int64())],
                names=["feature", "inside", "n"],
            )

    counts = pages.select(html_column).mapInArrow(run, "feature string, inside boolean, n long").groupBy("feature")
    within = F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0))
    out = {}
    for feature, inside, n in counts.agg(within, F.sum("n")).collect():
        share = (inside + 0.5) / (n + 1)
        out[feature] = share if ":w:" in feature else share - 1
    return out


def main_text(html: str, weight: dict[str, float]) -> str:
    """The blocks of the best region: white space as one space, trimmed, empty ones left out, joined by newlines."""
    found, zoned = items(html)
    a, b = best_run(scores(found, zoned, weight))
    blocks: dict[int, list[str]] = {}
    for _, text, _, block, _ in found[a:b]:
        if text:
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def scores(found: list[Item], zoned: bool, weight: dict[str, float]) -> list[float]:
    """Of each item; white space between tags scores nothing."""
    return [
        n * weight.get(_feature(item, zoned), 0.5) if (n := item[2])
        else 0.0 if item[1]
        else weight.get(_feature(item, zoned), -0.5)
        for item in found
    ]


def best_run(score: list[float]) -> tuple[int, int]:
    """Start and end of the run of the greatest positive sum, (0, 0) if there is none."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, value in enumerate(score):
        total += value
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, region = total, (start, i + 1)
    return region


def extract(pages: DataFrame, html_column: str = "html", id_columns: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Main text of pages. Returns per row the id columns, text, n_chars (code points). Other columns of pages play no
    part. A null or empty page has an empty text. Character references are decoded, unknown ones stay. Tags that never
    end run to the end of the element around them. Rows are taken one by one, repeated ones alike. Without any page that
    names its article, words count one half and tags minus one half."""
    weight = weights(pages, html_column)
    kept = pages.select(*id_columns, F.col(html_column).cast("string").alias("html"))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema if f.name != "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, "html"):
            texts = [main_text(html or "", weight) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in id_columns), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=[*id_columns, "text", "n_chars"],
            )

    return kept.mapInArrow(run, f"{types}, text string, n_chars long")
