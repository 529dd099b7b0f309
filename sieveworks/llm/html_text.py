"""Main text of HTML pages by wrapper induction.

1. Pages of one host share a template. Every page's DOM tree is aligned, element by element, with the
   trees of several pages of its host by simple tree matching.
2. What varies in an aligned slot from page to page tells what it is. A slot whose text stays the same
   on pages that say different things is template. A slot that holds mostly links, or whose text begins
   or ends with the same words on all pages, is part of the frame. The content is the innermost element
   that holds most of the varying text of the host's pages: from the body down, the child that does, as
   long as no heading, paragraph or list with text of its own stands beside it.
3. That wrapper, a tree with its content slot and its template slots, decides on every page of the host.

What HTML says by itself (menus, footers, forms, adverts, by tag, role or class) is never content. A
host with too few differing pages has no wrapper; there, and where a page has an article or main element
elsewhere, the page's own landmarks decide.

Every page is aligned on its own, whatever the size of its host, and only votes by host and node are
added up; a host's pages never meet in one task. A page that is a near copy of the reference (what
differs is worded alike) has no vote on it, and pages that are near copies of each other share one, so
that neither copies nor edited versions of an article turn it into template.
"""

from __future__ import annotations

import bisect
import html as htmllib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import join_checked, materialize, released, small_batches
from .shingles import coordinates, distinct, minhash, mix

#: A node is template if more votes than this saw it (inside an article or main element, than the second),
#: and its text was equal for this share of them.
SEEN, SEEN_INSIDE, EQUAL = 3, 10, 0.95
#: Pages of a host that all its pages are aligned with.
REFERENCES = 3
#: A page is a near copy of another if what differs has this Jaccard similarity, by pairs of words.
ALIKE = 0.3
#: Bands, of two MinHash coordinates each, by which near copies share their vote.
BANDS = 8
#: A slot is part of the frame if this share of the words in it is linked.
LINKED = 0.5
#: The content slot holds this share of the varying text of what it stands in.
MOST = 0.6
#: Larger tables of two lists of children are divided, so that memory grows with their lengths only.
CELLS = 1 << 12

# What tags, roles and parts of class names and ids say about an element.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = "script|style|textarea|title|noscript|template|iframe|noembed|xmp"
NEVER = set("script style textarea title noscript template iframe noembed head nav footer aside form button select option input svg canvas object video audio map menu dialog".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
ROLES = set("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog toolbar".split())
WORDS = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login comment comments "
    "commentlist discussion disqus respond replies share sharing social related recommended recommendations pagination pager widget toolbar skip".split()
)
UNITS = {"ul", "ol", "dl", "table"}
PARTS = UNITS | set("li dt dd caption thead tbody tfoot tr td th".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What stands before the text that it names.
NAMES = HEADINGS | {"dt", "th", "caption", "legend"}
#: Elements of text, which are never the element that holds the content; and those that belong to text.
TEXTS = HEADINGS | set("p ul ol dl li dt dd blockquote pre figure figcaption caption address".split())
INLINE = set("a abbr b cite code em font i label mark q s small span strong sub sup time u".split())
SKIPPED = set("script style textarea title noscript template iframe noembed head button select option input svg canvas object video audio map".split())
HEADER_WORDS = {"header", "topbar", "topnav"}
CLOSES_P = BLOCKS - {"caption", "dd", "dt", "li", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "summary", "figcaption"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}

#: Text and the tag after it, or the end. Possessive throughout: what follows a repeated part never begins
#: like it. The last form is a "<" that begins no whole tag, so that it is noticed the first time.
_TAG = re.compile(
    r"((?:[^<]++|<(?![!?]|/?[a-zA-Z]))*+)"
    r"(?:<!--.*?(?:-->|\Z)|<!(\[CDATA\[.*?)\]\]>|<[!?][^>]*+>|<(" + RAW + r")\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\3\s*+>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(<)|\Z)",
    re.S | re.I,
)
_CDATA = re.compile(r"<!\[CDATA\[", re.I)
#: One attribute after the other: its whole name, and its value, quoted or not.
_ATTR = re.compile(r"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_TOLD = re.compile(r"class|\bid|role|hidden", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+")


class Node:
    """An element: its tag, what its attributes say, and its children, elements or strings."""

    __slots__ = ("children", "cls", "holds", "role", "tag")

    def __init__(self, tag: str, cls: str = "", role: str = ""):
        self.tag, self.cls, self.role = tag, cls, role
        #: Whether it is a block or has one below it; other inline elements belong to their parent's text.
        self.holds = False
        self.children: list[Node | str] = []

    @property
    def key(self) -> str:
        return f"{self.tag}.{self.cls}" if self.cls else self.tag


def whole_tags(page: str) -> tuple[str, str]:
    """The page with a mark, a character that it does not have, in place of each "<" that begins no whole tag,
    and the mark. One pass from the end over quotes and ends of tags tells where a tag from any place on
    ends, whatever the number of tags that are cut off."""
    stops = [(m.start(), m[0]) for m in re.finditer("[\"'>]", page)]
    # ends[k]: whether a tag that reaches stop k outside quotes has an end; after[c]: the next stop c.
    ends, after = [False] * (len(stops) + 1), {'"': len(stops), "'": len(stops)}
    for k in range(len(stops) - 1, -1, -1):
        c = stops[k][1]
        if c == ">":
            ends[k] = True
        else:
            ends[k] = after[c] < len(stops) and ends[after[c] + 1]
            after[c] = k
    at = [i for i, _ in stops]
    last, cdata = page.rfind(">"), page.rfind("]]>")
    name_ends = [m.start() for m in re.finditer(r"[\s/>]", page)]
    mark = next(c for c in map(chr, range(0xFDD0, 0x110000)) if c not in page)
    cut = []
    for m in re.finditer(r"<(?:[!?]|(/?)[a-zA-Z])", page):
        i = m.start()
        if m[1] is None:
            if not page.startswith("<!--", i) and (i > last or i > cdata and _CDATA.match(page, i)):
                cut.append(i if i > last else i + 2)
        else:
            k = bisect.bisect_left(name_ends, m.end())
            if k == len(name_ends) or not ends[bisect.bisect_left(at, name_ends[k])]:
                cut.append(i)
    parts = [page[i + 1 : j] for i, j in zip([-1, *cut], [*cut, len(page)], strict=True)]
    return mark.join(parts), mark


def _unescaped(text: str, mark: str) -> str:
    try:
        text = htmllib.unescape(text)
    except ValueError:
        # A number of thousands of digits is no character.
        text = htmllib.unescape(re.sub(r"&#\d{8,};?", "\ufffd", text))
    return text.replace(mark, "<") if mark else text


#: Elements whose places among the open ones are kept: 1, blocks and buttons, which a paragraph does not
#: reach beyond; 2, parts of lists and tables, which close each other.
_PLACED = dict.fromkeys(BLOCKS | {"button"}, 1)
_PLACED |= {t: _PLACED.get(t, 0) | 2 for t in set().union(*CLOSES.values(), *SCOPES.values())}


#: Longer names and attributes are not kept in mind.
_SHORT = 256


@lru_cache(maxsize=1 << 12)
def _kind(name: str) -> tuple[str, bool, set[str] | None, set[str] | None, bool, bool, int]:
    """A tag's name in small letters, whether it closes paragraphs, what else it closes and how far out, whether
    it is a block or void, and which of its places are kept."""
    tag = name.lower()
    return tag, tag in CLOSES_P, CLOSES.get(tag), SCOPES.get(tag), tag in BLOCKS, tag in VOID, _PLACED.get(tag, 0)


@lru_cache(maxsize=1 << 13)
def _told(said: str) -> tuple[str, str]:
    """The classes and ids, and the role, that attributes give."""
    cls = role = ""
    if _TOLD.search(said):
        for a in _ATTR.finditer(said):
            value = a[2] or a[3] or a[4] or ""
            name = a[1].lower()
            if name == "role":
                role = value.strip().lower()
            elif name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                role = role or "hidden"
            elif name in ("class", "id"):
                cls = f"{cls} {value.lower()}".strip()
    return cls, role


def parse(page: str, mark: str = "") -> Node:
    """A tree of the page. Elements left open are closed as browsers close them; a "<" that begins no whole
    tag is text. Linear in the page, also where nothing is closed."""
    if not mark and page.rfind("<!") > (end := page.rfind("]]>")) and _CDATA.search(page, max(end, 0)):
        return parse(*whole_tags(page))
    root = Node("html")
    root.holds = True
    # The open elements, outermost first; how many there are of a tag; where the blocks are, and where the
    # parts of lists and tables are by their tags.
    stack, opened, blocks, places = [root], {}, [], {}
    before = ""

    def cut(i: int) -> None:
        """Close the i-th open element and all in it."""
        for n in stack[i:]:
            opened[n.tag] -= 1
            if (placed := _PLACED.get(n.tag, 0)) & 2:
                places[n.tag].pop()
            if placed & 1:
                blocks.pop()
        del stack[i:]

    def innermost(tags: set[str]) -> int:
        best = 0
        for t in tags:
            if (p := places.get(t)) and p[-1] > best:
                best = p[-1]
        return best

    for m in _TAG.finditer(page):
        text, cdata, _, slash, name, said, alone = m.groups()
        if alone:
            if not mark:
                return parse(*whole_tags(page))
            before += text + alone
            continue
        if before:
            text, before = before + text, ""
        if text:
            stack[-1].children.append(_unescaped(text, mark) if "&" in text or mark else text)
        if name is None:
            if cdata and cdata.startswith("[CDATA["):
                stack[-1].children.append(cdata[7:].replace(mark, "<") if mark else cdata[7:])
            continue
        tag, closes_p, closes, scopes, block, void, placed = _kind(name) if len(name) < _SHORT else _kind.__wrapped__(name)
        if slash:
            if len(stack) > 1 and stack[-1].tag == tag:
                # Most tags close the innermost element.
                stack.pop()
                opened[tag] -= 1
                if placed & 2:
                    places[tag].pop()
                if placed & 1:
                    blocks.pop()
            elif opened.get(tag):
                i = len(stack) - 1
                while stack[i].tag != tag:
                    i -= 1
                # The root is never closed.
                if i:
                    cut(i)
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack[:3]):
            continue
        if closes_p:
            if blocks and stack[blocks[-1]].tag == "p":
                cut(blocks[-1])
        elif closes:
            while (i := innermost(closes)) > innermost(scopes):
                cut(i)
                if tag not in ("tr", "td", "th", "tbody", "tfoot"):
                    break
        if tag == "body":
            cut(1)
        cls = role = ""
        if said:
            cls, role = _told(said) if len(said) < _SHORT else _told.__wrapped__(said)
        node = Node(tag, cls, role)
        stack[-1].children.append(node)
        if block:
            node.holds = True
            if not stack[-1].holds:
                for n in reversed(stack):
                    if n.holds:
                        break
                    n.holds = True
        if not void and not (said and said[-1] == "/" and not block):
            opened[tag] = opened.get(tag, 0) + 1
            if placed:
                if placed & 1:
                    blocks.append(len(stack))
                if placed & 2:
                    places.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def boilerplate(n: Node, in_article: bool) -> bool:
    """Whether HTML itself says that an element is no main content."""
    if n.tag in NEVER or n.role in ROLES or n.role == "hidden":
        return True
    if n.tag == "header" and not in_article:
        return True
    if n.cls and n.tag not in ("html", "body", "main", "article"):
        anywhere, outside = _class_says(n.cls)
        return anywhere or outside and not in_article
    return False


@lru_cache(maxsize=1 << 14)
def _class_says(cls: str) -> tuple[bool, bool]:
    """Whether words of a class or id say that an element is no main content, anywhere or outside articles."""
    said = set(_SPLIT.split(cls))
    return bool(said & WORDS), bool(said & HEADER_WORDS)


def _unit(n: Node) -> bool:
    """Whether an element is a list or a table of nothing but items, cells and further such lists. It is
    one text: an item that recurs says nothing by itself. Tables that lay out a page are none."""
    if n.tag not in UNITS:
        return False
    todo = [n]
    while todo:
        for c in todo.pop().children:
            if isinstance(c, Node):
                if c.tag in BLOCKS and c.tag not in PARTS:
                    return False
                todo.append(c)
    return True


def _is_article(n: Node) -> bool:
    return n.tag in ("article", "main") or n.role in ("main", "article")


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


_NO_TEXT = _digest("")


class Tree:
    """A page's body as it is aligned: its elements in preorder, with parallel lists of their keys, own texts
    (without that of elements below) with digests, numbers of words and of linked words, ends of their
    subtrees, children, and digests of their subtrees: shape is that of the keys alone, whole of all."""

    LISTS = ("keys", "texts", "digests", "words", "links", "ends", "inside", "said")

    def __init__(self) -> None:
        self.nodes: list[Node] = []
        for k in self.LISTS:
            setattr(self, k, [])

    @classmethod
    def of(cls, body: Node) -> Tree:
        t, parents = cls(), []
        rows: list[tuple] = []
        todo = [(body, -1, False, False)]
        while todo:
            n, parent, inside, said = todo.pop()
            said = said or boilerplate(n, inside)
            inside = inside or _is_article(n)
            at, children, kids = len(parents), n.children, []
            if len(children) == 1 and isinstance(children[0], str):
                # As the other ways give it.
                words = children[0].split()
                text, n_words = " ".join(words), len(words)
                links = n_words if n.tag == "a" else 0
            else:
                text, links, n_words = "", 0, 0
                nodes = [c for c in children if isinstance(c, Node)]
                if n.tag not in UNITS or not _unit(n):
                    kids = [c for c in nodes if c.holds and c.tag not in SKIPPED]
                if kids or n.tag in UNITS:
                    # Most elements with blocks have nothing but white space beside them.
                    if len(kids) < len(nodes) or any([c.strip() for c in children if isinstance(c, str)]):
                        text = "\n".join(blocks([n], inside, {id(c) for c in kids}))
                        links = linked_words(n, kids) if text else 0
                elif children:
                    text, links = inline_text(n, inside)
                if text:
                    n_words = len(text.split())
            parents.append(parent)
            rows.append((n, n.key, text, _digest(text) if text else _NO_TEXT, n_words, links, inside, said))
            todo += [(c, at, inside, said) for c in reversed(kids)]
        t.nodes, t.keys, t.texts, t.digests, t.words, t.links, t.inside, t.said = map(list, zip(*rows, strict=True))
        t.ends = [i + 1 for i in range(len(parents))]
        for i in range(len(parents) - 1, 0, -1):
            t.ends[parents[i]] = max(t.ends[parents[i]], t.ends[i])
        return t.linked()

    def linked(self) -> Tree:
        """With the children, shapes and digests that follow from the lists."""
        keys, ends, words, digests, n = self.keys, self.ends, self.words, self.digests, len(self.keys)
        self.kids = kids = [[] for _ in range(n)]
        self.shapes, self.wholes = shapes, wholes = [0] * n, [0] * n
        #: Texts that could be matched: equal ones under the same keys from the body down; 0 without words.
        self.spots = spots = [0] * n
        path: list[tuple[int, int]] = []
        for i in range(n):
            while path and path[-1][0] <= i:
                path.pop()
            here = hash((path[-1][1] if path else 0, keys[i]))
            path.append((ends[i], here))
            if words[i]:
                spots[i] = hash((here, digests[i])) or 1
        #: The elements with words that HTML does not call boilerplate.
        self.spoken = [i for i in range(n) if words[i] and not self.said[i]]
        #: shape -> (key, shapes of the children, number of elements)
        self.shaped: dict[int, tuple[str, tuple[int, ...], int]] = {}
        for i in range(n - 1, -1, -1):
            j, end, mine = i + 1, ends[i], kids[i]
            while j < end:
                mine.append(j)
                j = ends[j]
            below = tuple([shapes[k] for k in mine])
            # Digests of this process only.
            shapes[i] = shape = hash((keys[i], below))
            self.shaped[shape] = (keys[i], below, end - i)
            wholes[i] = hash((keys[i], digests[i], *[wholes[k] for k in mine]))
        return self

    def dump(self) -> str:
        return json.dumps([getattr(self, k) for k in self.LISTS])

    @classmethod
    def load(cls, raw: str) -> Tree:
        t = cls()
        for k, v in zip(cls.LISTS, json.loads(raw), strict=True):
            setattr(t, k, v)
        return t.linked()

    def tag(self, i: int) -> str:
        return self.keys[i].partition(".")[0]

    @cached_property
    def edges(self) -> list[tuple[str, str] | None]:
        """The first and last words of the texts; None without words."""
        return [(w[0], w[-1]) if n and (w := t.split()) else None for n, t in zip(self.words, self.texts, strict=True)]

    @cached_property
    def counted(self) -> Counter:
        """How many elements there are of each key."""
        return Counter(self.keys)

    def shared(self, other: Tree) -> int:
        """How many elements of the two trees can be paired by their keys."""
        there = other.counted
        return sum([min(n, there[k]) for k, n in self.counted.items() if k in there])


def inline_text(n: Node, inside: bool) -> tuple[str, int]:
    """The text of an element without blocks below it, as blocks() gives it, and how many of its words are linked."""
    if len(n.children) == 1 and isinstance(n.children[0], str):
        words = n.children[0].split()
        return " ".join(words), len(words) * (n.tag == "a")
    parts: list[str] = []
    linked, todo = 0, [(c, n.tag == "a") for c in reversed(n.children)]
    while todo:
        c, link = todo.pop()
        if isinstance(c, str):
            parts.append(c)
            if link:
                linked += len(c.split())
        elif c.tag == "br":
            parts.append(" ")
        elif not boilerplate(c, inside):
            link = link or c.tag == "a"
            todo += [(x, link) for x in reversed(c.children)]
    return " ".join("".join(parts).split()), linked


def linked_words(n: Node, without: list[Node]) -> int:
    """The number of words in links of an element, not counting those below the elements in `without`."""
    left, total, todo = {id(c) for c in without}, 0, [(n, n.tag == "a")]
    while todo:
        x, link = todo.pop()
        for c in x.children:
            if isinstance(c, str):
                total += link and len(c.split())
            elif id(c) not in left:
                todo.append((c, link or c.tag == "a"))
    return total


def blocks(nodes: list[Node], in_article: bool, without: set[int] = frozenset(), muted: dict[int, bool] | None = None) -> list[str]:
    """The texts of the blocks under these elements, in page order, without boilerplate and without
    the elements in `without`. muted tells of elements, and of what is in them down to the next such
    element, whether their text is left out."""
    out: list[str] = []
    text: list[str] = []

    def flush() -> None:
        if text and (t := " ".join("".join(text).split())):
            out.append(t)
        text.clear()

    muted = muted or {}
    todo: list = [(n, in_article, True, False) for n in reversed(nodes)]
    while todo:
        n, inside, first, mute = todo.pop()
        if n is None:
            flush()
            continue
        if isinstance(n, str):
            if not mute:
                text.append(n)
            continue
        if n.tag == "br":
            text.append(" ")
            continue
        if id(n) in without or not first and boilerplate(n, inside):
            if n.tag in BLOCKS:
                flush()
            continue
        inside = inside or _is_article(n)
        if n.tag in BLOCKS:
            flush()
            todo.append((None, inside, False, False))
        mute = muted.get(id(n), mute)
        todo += [(c, inside, False, mute) for c in reversed(n.children)]
    flush()
    return out


#: Equal texts come before matched elements.
_EQUAL_TEXT = 1 << 32


#: (shape, shape) -> the most elements that can be matched between such subtrees, for those met lately.
_SIZES: dict[tuple[int, int], int] = {}


@lru_cache(maxsize=1 << 12)
def _runs(keys: tuple[str, ...], others: tuple[str, ...]) -> list[tuple[int, int, int, int]] | None:
    """The begin and length of each run of equal keys in both lists, if they are made of the same runs, each key
    in one run."""
    both = []
    for members in (keys, others):
        runs = [(k, len(list(same))) for k, same in groupby(members)]
        if len({k for k, _ in runs}) < len(runs):
            return None
        both.append(runs)
    if [k for k, _ in both[0]] != [k for k, _ in both[1]]:
        return None
    out, i, j = [], 0, 0
    for (_, n), (_, m) in zip(*both, strict=True):
        out.append((i, n, j, m))
        i, j = i + n, j + m
    return out


class Aligner:
    """Simple tree matching of one tree with another. Of all matchings of two lists of children, in order
    and key with key, one with the most equal texts below, and of those one with the most matched elements,
    is chosen; the matched children's own children then follow."""

    def __init__(self, a: Tree, b: Tree):
        self.a, self.b = a, b
        if len(_SIZES) > 1 << 17:
            _SIZES.clear()
        common = set(a.spots).intersection(b.spots) - {0}
        self.texts = [[i for i, d in enumerate(t.spots) if d in common] for t in (a, b)] if common else [[], []]

    def matched(self) -> dict[int, int]:
        """Elements of the first tree with the elements of the second that they are matched with."""
        a, b, seen = self.a, self.b, {}
        todo = [(0, 0)] if a.keys[0] == b.keys[0] else []
        while todo:
            x, y = todo.pop()
            if a.wholes[x] == b.wholes[y]:
                # Equal throughout: element by element.
                seen.update(zip(range(x, a.ends[x]), range(y, b.ends[y]), strict=True))
                continue
            seen[x] = y
            if a.kids[x] and b.kids[y]:
                todo += self.paired(a.kids[x], b.kids[y])
        return seen

    def paired(self, xs: list[int], ys: list[int]) -> list[tuple[int, int]]:
        a, b = self.a, self.b
        lo, n, m = 0, len(xs), len(ys)
        while lo < min(n, m) and a.wholes[xs[lo]] == b.wholes[ys[lo]]:
            lo += 1
        while n > lo and m > lo and a.wholes[xs[n - 1]] == b.wholes[ys[m - 1]]:
            n, m = n - 1, m - 1
        ends = [*zip(xs[:lo], ys[:lo], strict=True), *zip(xs[n:], ys[m:], strict=True)]
        xs, ys = xs[lo:n], ys[lo:m]
        if not xs or not ys:
            return ends
        held, places = self.below(0, xs), {}
        if (direct := self.by_runs(xs, ys, any(held))) is not None:
            return ends + direct
        for j, ds in enumerate(self.below(1, ys)):
            for d in ds:
                places.setdefault(d, []).append(j)
        shapes = [b.shapes[y] for y in ys]
        rows: dict[int, list[int]] = {}

        def row(i: int) -> list[int]:
            p = a.shapes[xs[i]]
            if p not in rows:
                rows[p] = [self.size(p, q) for q in shapes]
            w = rows[p]
            if held[i]:
                w = list(w)
                for d in held[i]:
                    for j in places.get(d, ()):
                        if w[j]:
                            w[j] += _EQUAL_TEXT
            return w

        return ends + [(xs[i], ys[j]) for i, j in heaviest(len(xs), len(ys), row)]

    def by_runs(self, xs: list[int], ys: list[int], common: bool) -> list[tuple[int, int]] | None:
        """The matching of two lists that are made of the same runs of keys, each key in one run: member by
        member from the ends of the runs. None where that might not be a heaviest one, as members of a
        longer run then differ in weight."""
        a, b = self.a, self.b
        keys, others = tuple([a.keys[i] for i in xs]), tuple([b.keys[j] for j in ys])
        runs = _runs(keys, others) if len(keys) + len(others) < _SHORT else _runs.__wrapped__(keys, others)
        if runs is None:
            return None
        out = []
        for i, n, j, m in runs:
            p, q = xs[i : i + n], ys[j : j + m]
            if n + m > 2 and (common or any([a.kids[i] for i in p]) and any([b.kids[j] for j in q])):
                return None
            k = min(n, m)
            out += zip(p[-k:], q[-k:], strict=True)
        return out

    def below(self, side: int, roots: list[int]) -> list[set[int]]:
        """For each of these siblings the texts in its subtree that both trees have in such a place."""
        t, marks = (self.a, self.b)[side], self.texts[side]
        out: list[set[int]] = []
        at = bisect.bisect_left(marks, roots[0])
        for r in roots:
            ds = set()
            while at < len(marks) and marks[at] < t.ends[r]:
                ds.add(t.spots[marks[at]])
                at += 1
            out.append(ds)
        return out

    def size(self, p: int, q: int) -> int:
        """The most elements that can be matched between subtrees of these shapes."""
        sizes = _SIZES
        if (v := sizes.get((p, q))) is not None:
            return v
        of, to, todo = self.a.shaped, self.b.shaped, [(p, q)]
        while todo:
            x, y = todo[-1]
            (key, ps, n), (other, qs, _) = of[x], to[y]
            if key != other or x == y or not ps or not qs:
                sizes[x, y] = 0 if key != other else n if x == y else 1
                todo.pop()
            elif new := [(u, v) for u in dict.fromkeys(ps) for v in dict.fromkeys(qs) if (u, v) not in sizes]:
                todo += new
            else:
                rows = {u: [sizes[u, v] for v in qs] for u in dict.fromkeys(ps)}
                best = np.zeros(len(qs) + 1, np.int64) if len(ps) * len(qs) > CELLS else [0] * (len(qs) + 1)
                for u in ps:
                    best = _next(best, rows[u])
                sizes[x, y] = 1 + int(best[-1])
                todo.pop()
        return sizes[p, q]


def _next(best: np.ndarray | list[int], w: list[int]) -> np.ndarray | list[int]:
    """The next row of the table of heaviest matchings, from the one before and the weights of its pairs."""
    if isinstance(best, list):
        out = [0]
        for j, v in enumerate(w):
            out.append(max(out[j], best[j + 1], best[j] + v))
        return out
    out = best.copy()
    np.maximum(out[1:], best[:-1] + np.array(w, np.int64), out=out[1:])
    return np.maximum.accumulate(out)


def heaviest(n: int, m: int, row: Callable[[int], list[int]]) -> list[tuple[int, int]]:
    """A heaviest matching in order of two lists of n and m members: pairs of places. row(i) gives the
    weights of the i-th member with all others, 0 for none. Large tables are halved at the place where
    the best matchings of the halves together weigh most (Hirschberg's method)."""
    out, todo = [], [(0, n, 0, m)]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if i0 == i1 or j0 == j1:
            continue
        if (i1 - i0) * (j1 - j0) <= CELLS or i1 - i0 == 1:
            out += _tabled(i0, i1, j0, j1, row)
            continue
        mid = (i0 + i1) // 2
        before = after = np.zeros(j1 - j0 + 1, np.int64)
        for i in range(i0, mid):
            before = _next(before, row(i)[j0:j1])
        for i in range(i1 - 1, mid - 1, -1):
            after = _next(after, row(i)[j0:j1][::-1])
        at = j0 + int((before + after[::-1]).argmax())
        todo += [(i0, mid, j0, at), (mid, i1, at, j1)]
    return out


def _tabled(i0: int, i1: int, j0: int, j1: int, row: Callable[[int], list[int]]) -> list[tuple[int, int]]:
    weights = [row(i)[j0:j1] for i in range(i0, i1)]
    table = [[0] * (j1 - j0 + 1)]
    for w in weights:
        table.append(_next(table[-1], w))
    out, i, j = [], i1 - i0, j1 - j0
    while i and j:
        w = weights[i - 1][j - 1]
        if w and table[i][j] == table[i - 1][j - 1] + w:
            out.append((i0 + i - 1, j0 + j - 1))
            i, j = i - 1, j - 1
        elif table[i][j] == table[i - 1][j]:
            i -= 1
        else:
            j -= 1
    return out


def body_of(root: Node) -> Node:
    return next((c for c in root.children if isinstance(c, Node) and c.tag == "body"), root)


def top(holder: Node) -> list[Node]:
    """The articles in an element, or else its main elements, or else the element."""
    todo, articles, mains = [holder], [], []
    while todo:
        n = todo.pop()
        if n.tag == "article" or n.role == "article":
            articles.append(n)
        elif _is_article(n):
            mains.append(n)
            todo += [c for c in reversed(n.children) if isinstance(c, Node) and not boilerplate(c, True)]
        elif n is holder or not boilerplate(n, False):
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]
    return articles or mains or [holder]


def tree_of(page: str) -> Tree:
    return Tree.of(body_of(parse(page)))


def _listings(body: Node) -> set[int]:
    """The ids of the groups below an element most of whose text is links, as in lists of links outside an
    article. Characters are summed from the leaves up, each element once."""
    order, todo = [], [(body, -1)]
    while todo:
        n, parent = todo.pop()
        k = sum(len(c.strip()) for c in n.children if isinstance(c, str))
        # Characters outside and inside links; links that begin above the element do not count for it.
        order.append([n, parent, 0 if n.tag == "a" else k, k if n.tag == "a" else 0])
        at = len(order) - 1
        todo += [(c, at) for c in n.children if isinstance(c, Node)]
    out = set()
    for n, parent, free, linked in reversed(order):
        if linked > 0.6 * (free + linked) and n.tag in ("ul", "ol", "div", "section", "table", "dl") and n is not body:
            out.add(id(n))
        if parent >= 0:
            up = order[parent]
            if up[0].tag == "a":
                up[3] += free + linked
            else:
                up[2] += free
                up[3] += linked
    return out


#: What the pages of a host say about a node: their votes, those of equal text and of text in a frame of
#: equal words, and the words and linked words in it.
Votes = tuple[float, float, float, float, float]


def _naming(tree: Tree, fixed: set[int]) -> set[int]:
    """The fixed headings inside articles whose next text, up to the next heading, is not fixed."""
    out, waiting = set(), []
    for i in range(len(tree.keys)):
        if not tree.words[i] or not tree.inside[i]:
            if not tree.inside[i]:
                waiting = []
        elif tree.tag(i) in NAMES:
            waiting = [*waiting, i] if i in fixed else []
        elif i not in fixed:
            if not tree.said[i]:
                out.update(waiting)
            waiting = []
        else:
            waiting = []
    return out


def frame(tree: Tree, votes: dict[int, Votes]) -> tuple[int, list[int], list[int]]:
    """The wrapper of a reference tree: the node of its content (-1 if there are too few votes to tell),
    the nodes under it that belong to the frame, and the template nodes."""
    n = len(tree.keys)
    template = [i for i, (seen, equal, *_) in votes.items() if seen > (SEEN_INSIDE if tree.inside[i] else SEEN) + 1e-9 and equal >= EQUAL * seen - 1e-9 and tree.words[i]]
    fixed = set(template)
    # A recurring heading inside an article stays if text that varies follows it, up to the next heading.
    named = _naming(tree, fixed)
    template, fixed = [i for i in template if i not in named], fixed - named
    framed = {i for i, (seen, _, held, *_) in votes.items() if seen > SEEN + 1e-9 and held >= EQUAL * seen - 1e-9}
    group = [tree.tag(i) not in TEXTS | INLINE and not (tree.tag(i) == "table" and not tree.kids[i]) for i in range(n)]
    mass, own = [0.0] * (n + 1), [0.0] * n
    linked, total = [0.0] * n, [0.0] * n
    for i in range(n):
        _, _, _, words, links = votes.get(i, (0.0, 0.0, 0.0, 0.0, 0.0))
        linked[i], total[i] = links, words
        if not (tree.said[i] or i in fixed or i in framed and group[i]):
            own[i] = max(words - links, 0.0)
    for t in (linked, total):
        for i in range(n - 1, -1, -1):
            t[i] += sum(t[k] for k in tree.kids[i])
    for i in range(n - 1, -1, -1):
        mass[i] = own[i] + sum(mass[k] for k in tree.kids[i])
        if linked[i] > LINKED * total[i]:
            mass[i] = 0.0
    if not votes or max(v[0] for v in votes.values()) <= SEEN + 1e-9 or not mass[0]:
        return -1, [], template

    def speaks(i: int) -> bool:
        """Whether text that varies stands in an element of text, or a heading anywhere below."""
        if tree.tag(i) in TEXTS or not group[i]:
            return mass[i] > 0
        return any(tree.tag(k) in HEADINGS and own[k] > 0 for k in range(i, tree.ends[i]))

    at = 0
    while True:
        kids = tree.kids[at]
        best = max((k for k in kids if group[k]), key=lambda k: mass[k], default=None)
        # An article or main element that the page marks as such is not left for a part of it.
        if best is None or mass[best] < MOST * mass[at] or tree.inside[at] or any(speaks(k) for k in kids if k != best):
            break
        at = best
    edge = [k for k in tree.kids[at] if group[k] and (k in framed or total[k] and linked[k] > LINKED * total[k])] if at == 0 else []
    return at, edge, template


def extract(page: str | None, wrappers: list[tuple[Tree, int, list[int], list[int]]]) -> str:
    """The main text of a page: what stands in its content slot and is neither boilerplate nor matches a
    node of the frame or the template of the wrapper whose tree it matches best."""
    if not page:
        return ""
    body = body_of(parse(page))
    held, inside = top(body), False
    without: set[int] = set()
    muted: dict[int, bool] = {}
    if wrappers:
        tree = Tree.of(body)
        texts = {d for d, n in zip(tree.digests, tree.words, strict=True) if n}
        # The tree that shares most elements tells the content; others, what template the page has.
        nearest = max((n for n, w in enumerate(wrappers) if w[1] >= 0), key=lambda n: tree.shared(wrappers[n][0]), default=-1)
        found: list[dict[int, int]] = []
        for n, (ref, _, _, template) in enumerate(wrappers):
            seen = Aligner(ref, tree).matched() if n == nearest or any(ref.digests[i] in texts for i in template) else {}
            found.append(seen)
            for i in template:
                j = seen.get(i)
                if j is not None and tree.digests[j] == ref.digests[i]:
                    muted |= {id(tree.nodes[k]): False for k in tree.kids[j] if id(tree.nodes[k]) not in muted}
                    muted[id(tree.nodes[j])] = True
        if nearest >= 0 and wrappers[nearest][1] in found[nearest]:
            seen, (_, at, edge, _) = found[nearest], wrappers[nearest]
            slot = seen[at]
            under = {id(x) for x in tree.nodes[slot : tree.ends[slot]]}
            # Landmarks elsewhere on the page speak against the slot.
            if held == [body] or any(id(h) in under for h in held):
                inside = tree.inside[slot]
                held = [tree.nodes[slot]] if inside else top(tree.nodes[slot])
                without = {id(tree.nodes[seen[i]]) for i in edge if i in seen}
    if held == [body]:
        without |= _listings(body)
    return "\n\n".join(blocks(held, inside, without, muted))


def host_of(url: Column) -> Column:
    """Lower-cased host of a URL; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1)), F.lit(""))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        trees = [tree_of(h.as_py()).dump() for h in b.column("html")]
        yield pa.RecordBatch.from_arrays([b.column("host"), b.column("content"), pa.array(trees, pa.string())], names=["host", "content", "tree"])


class _Hosts(dict):
    """host -> what is made of the column that all rows of the host carry alike, for hosts met lately."""

    limit = 256 // REFERENCES

    def of(self, host: str, carried: pa.Scalar, made: Callable[[list], list]) -> list:
        if (v := self.get(host)) is None:
            if len(self) >= self.limit:
                self.clear()
            v = self[host] = made(carried.as_py() or [])
        return v


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two texts are worded alike, from their sets of pairs of words."""
    s = np.sort(np.concatenate([a, b]))
    both = int((s[1:] == s[:-1]).sum())
    return both >= ALIKE * (len(a) + len(b) - both)


#: A random number for each byte at each place of a word (of places beyond 64, by their remainder).
_BYTE_AT = np.random.default_rng(10).integers(0, 2**63, 64 << 8, dtype=np.uint64)


def word_pairs(text: str) -> np.ndarray:
    """The sorted distinct digests of a text's pairs of neighbouring words, or of its only word."""
    b = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    word = b > 32
    start = word.copy()
    start[1:] &= ~word[:-1]
    at = np.flatnonzero(start)
    if not len(at):
        return np.empty(0, np.uint64)
    begin = np.zeros(len(b), np.int64)
    begin[at] = at
    place = np.arange(len(b)) - np.maximum.accumulate(begin)
    w = mix(np.add.reduceat(_BYTE_AT[(place & 63) << 8 | b] * word, at))
    return distinct(mix(w[:-1] + w[1:] * np.uint64(0x9E3779B97F4A7C15))) if len(w) > 1 else w


class _Pairs(dict):
    """text -> its set of pairs of words, for those used lately."""

    limit = 256

    def __missing__(self, text: str) -> np.ndarray:
        if len(self) >= self.limit:
            self.clear()
        v = self[text] = word_pairs(text)
        return v


#: What a page says about a node of a reference tree that it was matched with.
FOUND = "array<struct<node:int,equal:boolean,framed:boolean,words:int,links:int>>"
_FOUND = pa.list_(pa.struct([("node", pa.int32()), ("equal", pa.bool_()), ("framed", pa.bool_()), ("words", pa.int32()), ("links", pa.int32())]))


def _framed(a: tuple[str, str] | None, b: tuple[str, str] | None) -> bool:
    """Whether two texts begin or end with the same word."""
    return a is not None and b is not None and (a[0] == b[0] or a[1] == b[1])


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (host, content, ref, own, bands, found) for each page and reference tree: whether the page is
    a near copy of the reference, the bands of what differs, and what it says about the nodes with words
    that it was matched with."""
    hosts, pairs, (mult, add) = _Hosts(), _Pairs(), coordinates(2 * BANDS)
    load = lambda raws: [Tree.load(raw) for raw in raws]
    for b in batches:
        rows: list[tuple] = []
        for host, content, raws, page in zip(b.column("host").to_pylist(), b.column("content").to_pylist(), b.column("trees"), b.column("html"), strict=True):
            t = tree_of(page.as_py())
            known: dict[frozenset, list[int]] = {}
            for ref, r in enumerate(hosts.of(host, raws, load)):
                seen = Aligner(r, t).matched()
                there, here = r.digests, t.digests
                alike_at = {i: j for i, j in seen.items() if there[i] == here[j]}
                equal = set(alike_at.values())
                at, words, links, first, then = r.words, t.words, t.links, r.edges, t.edges
                found = [(i, same := i in alike_at, same or _framed(first[i], then[j]), words[j], links[j]) for i, j in seen.items() if at[i] or words[j]]
                rest = "\n".join([r.texts[i] for i in r.spoken if i not in alike_at])
                other = "\n".join([t.texts[j] for j in t.spoken if j not in equal])
                own = alike(pairs[other], pairs[rest])
                key = frozenset(equal)
                if key not in known:
                    m = minhash(pairs[other], mult, add).astype(np.uint64)
                    known[key] = mix((m[::2] << np.uint64(32) | m[1::2]) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64).tolist()
                rows.append((host, content, ref, own, known[key], found))
        types = (pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64()))
        cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        flat = list(zip(*(x for r in rows for x in r[5]), strict=True)) or [()] * 5
        fields = [pa.array(v, _FOUND.value_type.field(i).type) for i, v in enumerate(flat)]
        ends = np.cumsum([0, *(len(r[5]) for r in rows)]).astype(np.int32)
        cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=[f.name for f in _FOUND.value_type])))
        yield pa.RecordBatch.from_arrays(cols, names=["host", "content", "ref", "own", "bands", "found"])


WRAPPER = "tree string, content int, edge array<int>, template array<int>"


def _wrappers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for host, raw, votes in zip(b.column("host").to_pylist(), b.column("tree").to_pylist(), b.column("votes").to_pylist(), strict=True):
            t = Tree.load(raw)
            # The reference and its near copies have one vote together; it is for every node.
            said = {v["node"]: (v["seen"] + 1, v["equal"] + 1, v["framed"] + 1, v["words"] + t.words[v["node"]], v["links"] + t.links[v["node"]]) for v in votes}
            rows.append((host, raw, *frame(t, said)))
        types = (pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["host", "tree", "content", "edge", "template"])


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hosts = _Hosts()
    load = lambda wrappers: [(Tree.load(w["tree"]), w["content"], w["edge"], w["template"]) for w in wrappers]
    for b in batches:
        texts = []
        for host, page, wrappers in zip(b.column("host").to_pylist(), b.column("html"), b.column("wrappers"), strict=True):
            texts.append(extract(page.as_py(), hosts.of(host, wrappers, load)))
        cols = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "text", "n_chars"])


def induce(pages: DataFrame) -> DataFrame:
    """A row (host, wrappers) for each host of pages(host, html) whose pages tell what is content or
    template: an array of (tree, content, edge, template), a reference page's tree as JSON and the numbers of
    its content node (or -1), of the frame's nodes under it, and of the template nodes.

    A page has one vote on a reference, shared with the pages that differ from it in like words: one
    over the mean number of pages with the same band, which counts a page of similarity s as s * s."""
    some = pages.where("html is not null and html <> ''").withColumn("content", F.xxhash64("html"))
    picks = [F.min_by("content", F.xxhash64(F.lit(i), "content")) for i in range(REFERENCES)]
    picked = some.groupBy("host").agg(F.array_distinct(F.array(*picks)).alias("content")).select("host", F.explode("content").alias("content"))
    picked = join_checked(some, picked, ["host", "content"], "inner", 64).mapInArrow(released(_trees), "host string, content long, tree string")
    picked = picked.groupBy("host", "content").agg(F.min("tree").alias("tree"))
    trees = materialize(picked.groupBy("host").agg(F.sort_array(F.collect_set("tree")).alias("trees")))
    size = F.aggregate("trees", F.lit(64).cast("long"), lambda n, t: n + F.octet_length(t))
    found = join_checked(some.select("host", "content", "html"), trees, "host", "inner", size).select("host", "content", "trees", "html")
    found = materialize(found.mapInArrow(released(_alignments), f"host string, content long, ref int, own boolean, bands array<long>, found {FOUND}"))
    banded = found.where("not own").select("host", "content", "ref", F.explode("bands").alias("band"))
    often = banded.groupBy("host", "ref", "band").agg(F.count("*").alias("n")).where("n > 1")
    share = join_checked(banded, often, ["host", "ref", "band"], "left", 48).groupBy("host", "content", "ref").agg((1 / F.avg(F.coalesce("n", F.lit(1)))).alias("vote"))
    votes = join_checked(found.where("not own").select("host", "content", "ref", "found"), share, ["host", "content", "ref"], "inner", 48)
    votes = votes.select("host", "ref", "vote", F.inline("found")).groupBy("host", "ref", "node").agg(
        F.sum("vote").alias("seen"),
        *[F.sum(F.when(F.col(c), F.col("vote")).otherwise(0)).alias(c) for c in ("equal", "framed")],
        *[F.sum(F.col("vote") * F.col(c)).alias(c) for c in ("words", "links")],
    )
    votes = votes.groupBy("host", "ref").agg(F.sort_array(F.collect_list(F.struct("node", "seen", "equal", "framed", "words", "links"))).alias("votes"))
    told = votes.join(trees.select("host", F.posexplode("trees").alias("ref", "tree")), ["host", "ref"]).select("host", "tree", "votes")
    told = told.mapInArrow(_wrappers, f"host string, {WRAPPER}").where("content >= 0 or size(template) > 0")
    return told.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("tree", "content", "edge", "template"))).alias("wrappers"))


def main_text(pages: DataFrame) -> DataFrame:
    """A row (page_id, url, text, n_chars) for each row of pages(page_id, url, html, ...): the main text
    of the whole html, blocks parted by an empty line, and its number of code points. Null, empty and
    text-free html gives the empty text. Pages whose url is null or has no host share one host. Repeated
    rows give repeated results, further columns are ignored, an empty table gives no rows. Markup that is
    cut off or nested wrongly is read leniently and never fails."""
    # Every row carries its host's trees to Python.
    small_batches(pages.sparkSession)
    read = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    read = read.withColumn("host", host_of(F.col("url")))
    size = F.aggregate("wrappers", F.lit(64).cast("long"), lambda n, w: n + F.octet_length(w["tree"]) + 4 * F.size(w["template"]))
    wrapped = join_checked(read, induce(read.select("host", "html")), "host", "left", size)
    return wrapped.select("page_id", "url", "host", "html", "wrappers").mapInArrow(released(_extracted), "page_id long, url string, text string, n_chars long")
