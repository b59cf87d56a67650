"""Main text of web pages by tree scoring (operator 4).

A page is read into a tree of block elements. Every paragraph passes points for its length and its commas
to its container (whole) and to the ancestors above (a half, a third, ...); a container's score is
discounted by the share of its text that stands in links. The best container (or the article that encloses
it) is kept with those siblings that score well beside it and what stands between them. Menus, headers, footers, sidebars, notices,
adverts, forms, scripts, styles and reader comments are cut by element, role and class before scoring.

A name alone does not decide: a form, or an element cut for its class or id, that holds nearly all paragraph
points of the page is no clutter but the frame of the page, and is opened (``_opened``). What is hidden stays
cut. Inline elements are cut if they are hidden or named as adverts.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import slices

_RAW = "script|style|template|noscript|textarea|title|iframe|svg|object|select|button|annotation|annotation-xml"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{_RAW})(?=[\s/>])[^>]*(?:(?<=/)>|>.*?(?:</(?P=raw)\s*>|\Z))|<[!?][^>]*>"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:\s(?:\"[^\"<]*\"|'[^'<]*'|[^>\"'])*+|/?)>|[^>]*>)",
    re.S | re.I,
)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
# Element and class names of HTML pages.
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var"
    " math menclose mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CUT = frozenset("nav footer aside form dialog menu head audio video canvas".split())
_CUT_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar".split())
_CUT_NAME = frozenset(
    "ad ads advert adverts advertisement advertising adbox adslot banner breadcrumb breadcrumbs comment comments commentlist disqus cookie cookies consent gdpr footer masthead menu menubar modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related recommended share sharing sidebar sidenav signup skyscraper social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Words that may stand beside one of the above in a class or id without changing what it names.
_BESIDE = frozenset(
    "a app area article bar blog block body bottom box button buttons center col column container content cta desktop entry feed float global grid group head header holder icons inner inline item items js layout left leaderboard link links list local lower main media mid middle mobile network networks off on outer page panel post posts primary region right row secondary section side site slot small sticky stories story tertiary the thread tools top unit upper user users view wide wrap wrapper".split()
)
_LISTS = frozenset("ul ol dl table tr td th tbody thead div section".split())
_CLOSED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_DEEPEST = 250  # elements below that are children of the one at this depth, as browsers do at some depth
_FENCE = frozenset("ul ol dl table body html article section div".split())


_ADVERT = frozenset("ad ads advert adverts advertisement advertising adbox adslot promo promoted promotion sponsor sponsored".split())
_SURE, _LIKELY = 2, 1  # an element is cut for good, or unless it frames the page


class _Node:
    __slots__ = ("cut", "links", "parent", "points", "size", "tag")

    def __init__(self, tag: str, parent: _Node | None, cut: int):
        self.tag, self.parent, self.cut, self.points, self.size, self.links = tag, parent, cut, 0.0, 0, 0

    def up(self) -> Iterator[_Node]:
        node = self
        while node is not None:
            yield node
            node = node.parent

    def score(self) -> float:
        return self.points * (1 - self.links / self.size) if self.size else 0.0


def _names_clutter(names: str, words_of: frozenset[str] = _CUT_NAME) -> bool:
    """Whether one of the names in a class or id says that the element is no content: not ``market-share``, but ``share-bar``."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", name) if w and not re.fullmatch(r"[0-9x]+", w)]
        if not words_of.isdisjoint(words) and all(w in words_of or w in _BESIDE for w in words):
            return True
    return False


def _is_cut(tag: str, attrs: str, stack: list[_Node]) -> int:
    if tag in _CUT or tag == "header" and not any(n.tag in ("article", "main") for n in stack):
        return _LIKELY if tag == "form" else _SURE
    if tag in ("html", "body", "article", "main") or "=" not in attrs and "hidden" not in attrs:
        return 0
    found = 0
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "role" and value in _CUT_ROLE or _hides(name, value):
            return _SURE
        if name in ("class", "id") and _names_clutter(value):
            found = _LIKELY
    return found


def _hides(name: str, value: str) -> bool:
    return name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and bool(re.search(r"display\s*:\s*none", value))


def _is_cut_inline(attrs: str) -> bool:
    """Whether an inline element is hidden, or named as an advert."""
    for name, value in _ATTR.findall(attrs):
        name, value = name.lower(), value.strip("\"'").lower()
        if _hides(name, value) or name in ("class", "id") and _names_clutter(value, _ADVERT):
            return True
    return False


def _opened(blocks: list[tuple[_Node, str, int]]) -> list[tuple[_Node, str, int]]:
    """The blocks that are not cut, after opening elements that frame the page.

    From the outside in: an element that is likely clutter is opened where at least three points lie in it, and
    a tenth of its points and of its text is more than what is not cut outside it has.
    """
    while True:
        free, held = [0.0, 0], {}
        for node, text, linked in blocks:
            cut = [n for n in node.up() if n.cut]
            sums = held.setdefault(id(cut[-1]), [0.0, 0, cut[-1]]) if cut else free  # by the outermost one
            sums[0] += _points(text, linked)
            sums[1] += len(text)
        frame = next((n for points, size, n in held.values() if points >= 3 and free[0] < 0.1 * points and free[1] < 0.1 * size), None)
        if frame is None:
            return [b for b in blocks if not any(n.cut for n in b[0].up())]
        frame.cut = 0


def _points(text: str, linked: int) -> float:
    return ((len(text) >= 25) + min(len(text) / 100, 3) + text.count(",")) * (1 - linked / len(text))


def _blocks(page: str) -> list[tuple[_Node, str, int]]:
    """The text blocks of a page in order: owning element, text, and how much of it stands in links."""
    root = _Node("#root", None, 0)
    stack, seen, out, words, linked, link_at, at = [root], set(), [], [], 0, 0, 0
    skip, deep = "", 0  # the inline element that is being left out, and how many of its tag are open in it

    def flush() -> None:
        nonlocal words, linked
        if words:
            text = " ".join(html.unescape("".join(words)).split())
            if text:
                out.append((stack[-1], text, min(linked, len(text))))
            words, linked = [], 0

    def pop(to: int) -> None:
        nonlocal link_at
        flush()
        del stack[to:]
        if link_at > len(stack):
            link_at = 0

    stop = page.rfind(">") + 1  # no tag ends later, so no search for its end runs on
    for m in _TOKEN.finditer(page, 0, stop):
        if m.start() > at and stack[-1].cut != _SURE and not skip:
            words.append(page[at : m.start()])
            linked += bool(link_at) * (m.start() - at)
        at = m.end()
        tag = m["tag"]
        if not tag:
            if at == stop and (m["raw"] or m[0].startswith("<!--")) and not re.search(r"(?:--|/[\w\s]*)>\Z", m[0][-40:]):
                at = len(page)  # never closed: all that follows belongs to it
            continue
        tag = tag.lower()
        if tag in _INLINE:
            attrs = m["attrs"] or ""
            if skip:
                deep += (-1 if m["end"] else 1) if tag == skip else 0
                skip = skip if deep else ""
            elif not m["end"] and ("=" in attrs or "hidden" in attrs) and not attrs.endswith("/>") and _is_cut_inline(attrs):
                skip, deep = tag, 1
            if tag == "a":
                link_at = 0 if m["end"] else len(stack)
            continue
        if tag not in _VOID:
            skip = ""  # an inline element ends with its block at the latest
        if tag in _VOID:
            words.append(" ") if tag == "br" else flush() if tag == "hr" else None
            continue
        if m["end"]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag), 0) if tag in seen else 0
            pop(k) if k else flush()
            continue
        flush()
        if (k := next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == "p" or stack[k].tag in _FENCE), 0)) and stack[k].tag == "p":
            pop(k)
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in _CLOSED_BY.get(tag, ()):
                pop(k)
            elif stack[k].tag in _FENCE:
                break
        seen.add(tag)
        stack.append(_Node(tag, stack[min(len(stack) - 1, _DEEPEST)], _SURE if stack[-1].cut == _SURE else _is_cut(tag, m["attrs"] or "", stack)))
    if stack[-1].cut != _SURE and not skip:
        words.append(page[at:])
    flush()
    return _opened(out)


def main_text(page: str | None) -> str:
    """The main text of a page: its blocks in page order, joined by a space; empty if there is none."""
    blocks = _blocks(page or "")
    for node, text, linked in blocks:
        for n in node.up():
            n.size += len(text)
            n.links += linked
        points = _points(text, linked)
        holder = node if node.tag in _LISTS or node.parent is None else node.parent
        for depth, n in enumerate(holder.up(), 1):
            n.points += points / depth
    nodes = {id(n): n for node, _, _ in blocks for n in node.up()}
    inner = [n for n in nodes.values() if n.tag not in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "#root")]
    best = max(inner or nodes.values(), key=_Node.score, default=None)
    if best is None:
        return ""
    best = next((n for n in best.up() if n.tag == "article"), best)
    least = max(10.0, 0.2 * best.score())
    kept = {id(best)}
    for n in nodes.values():
        if n.parent is best.parent and n is not best and n.size:
            share = n.links / n.size
            if n.score() >= least or n.tag == "p" and share < 0.25 and n.size >= 80 or n.tag == "h1" and not share or n.tag == "article" and share < 0.5:
                kept.add(id(n))
    # below the best container's parent: the path down to each block, from the sibling that holds it
    paths = []
    for node, _, _ in blocks:
        path = list(node.up())
        at = next((k for k, n in enumerate(path) if n is best.parent), None) if best.parent else len(path)
        paths.append(None if at is None else path[:at][::-1])
    sure = [bool(p) and id(p[0]) in kept for p in paths]
    first, last = sure.index(True), len(sure) - 1 - sure[::-1].index(True)
    out = []
    for i, ((_, text, _), path) in enumerate(zip(blocks, paths, strict=True)):
        # what stands between kept siblings is kept unless it is mostly links
        between = path is not None and first < i < last and (not path or path[0].links <= 0.5 * path[0].size)
        menu = best.tag != "article" and any(n.tag in _LISTS and n.links > 0.5 * n.size for n in (path or [])[1:])
        if (sure[i] or between) and not menu:
            out.append(text)
    return " ".join(out)


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The ``keep`` columns with ``text`` (main text; empty if there is none) and ``n_chars`` (its code points).

    One row per input row, repeated rows included: a map without a shuffle. Null and empty pages give empty
    text; nulls in the kept columns stay. Pages are read whole; unclosed elements end where HTML lets them
    end, and text after a broken tag is read on as text. Other columns, whatever their names, are not read.
    """
    picked = pages.select(*keep, F.col(html_col).alias("__html"))
    schema = picked.drop("__html").schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(h) for h in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keep, "text", "n_chars"])

    return picked.mapInArrow(run, schema)
