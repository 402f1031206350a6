"""Main text of web pages by union-free regular expressions that are inferred for each host.

A page is a stream of tags and texts whose tags are made to balance. Its expression has an item for each element and each
text; what stands next to an item of its kind becomes a repeated group, and paragraphs, headings, lists and tables in any order are
one repeated group of optional items. Expressions of a host's pages are aligned one after another, all pages and whole
pages: equal tags stay, an item that one side lacks becomes optional, and a text that differs becomes a slot. Of a
repeated group the texts that every page has in it are kept as fixed, the others are slots. Tasks align the
pages they read, and the partial expressions of a host are aligned with each other in two levels, so no task
meets a host's pages.

A wrapper is the expression and the order in which its containers may hold the article: by the text in their
slots, that is without what the host's pages have in common; article and main tags come first. A page is matched against
its host's expression, item by item; the first of these containers in which the page has text is the article, and
texts there that are fixed in at least FIXED_PAGES different pages are left out (unless they would be over a
fifth of it: the host's pages are then copies of one another). Tags, roles and class names tell what is no
article (menus, forms, comments and so on) and is no part of the expression. Where a host has a single page,
all of its texts are slots.

Results for unusual input: null or empty html: empty text; broken markup: open elements end with their
parents, a `<` that starts no tag is text; no host in the url (or null): such pages share one wrapper; equal pages
of a host: count as one when fixed texts are looked for; very long or deeply nested pages: whole; repeated
rows and null ids: each row is returned; an empty table gives an empty result; other columns of the input, whatever
their names, are ignored.
"""

from __future__ import annotations

import html as html_lib
import pickle
import re
import sys
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofeat.llm._common import chunks, release, small_batches, store

#: Different pages that must share a text before it is left out of articles.
FIXED_PAGES = 3
#: Bytes of wrappers up to which they are sent to all executors; beyond that, pages and wrappers are joined by host.
BROADCAST_BYTES = 64_000_000

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>?|<\?[^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)[^>]*>?", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW = {x: re.compile(rf"</{x}\s*>?", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "object")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold no article whatever they hold; and those that may be wrapped around a page's article.
_NEVER = frozenset("nav script style textarea title noscript template iframe svg math object button select option menu head canvas audio video".split())
_SELDOM = frozenset("aside footer form dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
_CHROME = frozenset(
    "ad ads adv advert advertisement advertising sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login social share sharing related recommended comments comment commentlist disqus replies reply respond popup modal overlay widget pagination pager masthead topbar toolbar skip search".split()
)
#: Beside one of these, a name of the list above says something about an element that is none.
_MODIFIERS = frozenset("has no not non with without free hide hidden show is off on enabled disabled open closed before after".split())
_SITE_HEAD = frozenset("header masthead".split())
_OF_ARTICLE = frozenset("article post entry story content".split())
#: What authors write in any order.
_FLOW = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure address details hgroup".split())
_LISTS = frozenset("ul ol dl".split())
#: Elements that repeat whatever is in them; all but table cells are no containers of articles.
_REPEATING = _FLOW | frozenset("li dt dd tr td th tbody thead tfoot caption figcaption".split())


def tokens(page: str) -> list[tuple[str, str, str]]:
    """(kind, name, rest): kinds open, close and text; rest is the attributes or the decoded text."""
    out, at = [], 0
    for m in iter(lambda: _TOKEN.search(page, at), None):
        if m.start() > at:
            out.append(("text", "", html_lib.unescape(page[at : m.start()])))
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        if m[1] or m[4]:
            out.append(("close", name, ""))
            continue
        out.append(("open", name, m[3] or ""))
        if name in _RAW and not (m[3] or "").rstrip().endswith("/"):
            end = _RAW[name].search(page, at)
            if end:
                out.append(("close", name, ""))
                at = end.end()
            elif name in ("script", "style"):
                at = len(page)
    if at < len(page):
        out.append(("text", "", html_lib.unescape(page[at:])))
    return out


@lru_cache(4096)
def _named(names: str) -> tuple[str, bool, bool, bool, bool]:
    """Of class and id names: the first one without its numbers; whether one is a name of what is no article, or made with
    such a name; whether one is a site's head; and whether one is an article's."""
    strong = weak = head = own = False
    every = names.split()
    for name in every:
        parts = [x.lower() for x in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", name)]
        if not parts or _MODIFIERS.intersection(parts):
            continue
        strong |= "".join(parts) in _CHROME
        weak |= parts[0] in _CHROME or parts[-1] in _CHROME
        head |= bool(_SITE_HEAD.intersection(parts)) and not _OF_ARTICLE.intersection(parts)
        own |= bool(_OF_ARTICLE.intersection(parts))
    return (re.sub(r"\d+", "#", every[0].lower()) if every else ""), strong, weak, head, own


class Node:
    __slots__ = ("name", "attributes", "items", "parent", "dropped", "size", "article", "names")

    def __init__(self, name: str, attributes: str, parent: Node | None) -> None:
        self.name, self.parent, self.items, self.dropped, self.size, self.article = name, parent, [], False, 0, 0
        self.attributes = {a.lower(): (x or y or z or "") for a, x, y, z in _ATTRIBUTE.findall(attributes)} if attributes.strip() else {}
        a = self.attributes
        self.names = _named(f"{a.get('class', '')} {a.get('id', '')}".strip()) if a else ("", False, False, False, False)

    def key(self) -> str:
        main = "@main" if self.name == "main" or self.attributes.get("role") == "main" else "@body" if self.name == "article" or "articlebody" in self.attributes.get("itemprop", "").lower() else ""
        return f"{self.name}.{self.names[0]}{main}"

    def is_chrome(self, page: int, inside: bool) -> bool:
        """Whether this is no part of an article; page: the page's size in characters; inside: within an article."""
        a, (_, strong, weak, head, own) = self.attributes, self.names
        if self.name in _NEVER or "hidden" in a or a.get("aria-hidden") == "true":
            return True
        if a and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
            return True
        if self.name in ("html", "body", "article", "main"):
            return strong and self.name == "article"
        if 2 * self.article > page:  # the page's article lies in it
            return False
        if a.get("role", "").lower() in _ROLES or self.name in _SELDOM or strong:
            return True
        if (self.name == "header" or head) and not inside and not own:
            return 2 * self.size <= page
        return weak and not (own and self.name == "header") and 2 * self.size <= page


def tree(page: str) -> Node:
    """The page's elements. Elements end at their end tag, or with a parent that ends; p and li end at the next one."""
    root = at = Node("root", "", None)
    opened: dict[str, int] = {}
    order: list[Node] = []

    def close(to: Node) -> Node:
        """Ends the elements from the current one up to `to`; its parent is the new current one."""
        n = at
        while True:
            opened[n.name] -= 1
            if n is to:
                return n.parent
            n = n.parent

    for kind, name, rest in tokens(page):
        if kind == "text":
            at.items.append(rest)
            at.size += len(rest)
        elif kind == "open":
            if name not in _INLINE and (name not in _VOID or name == "hr"):
                up = at
                while up.parent and up.name in _INLINE:
                    up = up.parent
                if up.name == "p":
                    at = close(up)  # a block ends an open paragraph
                elif name in ("li", "dt", "dd", "tr", "td", "th", "option") and (up.name == name or {up.name, name} in ({"dt", "dd"}, {"td", "th"})):
                    at = close(up)
            node = Node(name, rest, at)
            at.items.append(node)
            order.append(node)
            if name not in _VOID and not rest.rstrip().endswith("/"):
                at = node
                opened[name] = opened.get(name, 0) + 1
        elif opened.get(name):
            up = at
            while up.name != name:
                up = up.parent
            at = close(up)
    for n in reversed(order):  # children before their parents
        if n.name in _NEVER:
            n.size = 0
        if n.name in ("article", "main") or "@" in n.key():
            n.article = max(n.article, n.size)
        n.parent.size += n.size
        n.parent.article = max(n.parent.article, n.article)
    within: dict[int, bool] = {id(root): False}
    for n in order:
        inside = within[id(n)] = within[id(n.parent)] or n.parent.name in ("article", "main")
        n.dropped = n.parent.dropped or n.is_chrome(root.size, inside)
    return root


class Item:
    """An item of an expression: an element, a text ("#text") or a group of what authors write ("#flow").

    pages: how many pages have it; several: whether a page has it more than once; kids: the items within, in order;
    of a text, common: the texts (digest: length) that all of these pages have here; chars, linked: characters in all
    of them, and those within links; nodes: where it was found, on a page.
    """

    __slots__ = ("key", "pages", "several", "kids", "common", "chars", "linked", "nodes")

    def __init__(self, key: str, pages: int = 1, several: bool = False, kids: list | None = None, common: dict | None = None, chars: int = 0, linked: int = 0, nodes: list | None = None) -> None:
        self.key, self.pages, self.several, self.kids, self.common, self.chars, self.linked, self.nodes = key, pages, several, kids or [], common or {}, chars, linked, nodes or []

    def slot_chars(self) -> int:
        """Characters in slots: in texts that are not the same on all pages."""
        return self.chars - (self.pages * sum(self.common.values()) if self.pages > 1 else 0)


def digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))


def _segments(n: Node) -> list:
    """An element's own texts, white space made one blank, as (text, characters in links), and the blocks between them."""
    out: list = []
    text: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        if line:
            out.append((line, min(linked, len(line))))
        text.clear()
        linked = 0

    def walk(x: Node, link: bool) -> None:
        nonlocal linked
        for y in x.items:
            if isinstance(y, str):
                text.append(y)
                if link:
                    linked += len(y.strip())
            elif y.dropped:
                if y.name not in _INLINE and y.name not in _RAW:
                    end()
            elif y.name in _INLINE:
                walk(y, link or y.name == "a")
            else:
                end()
                if y.name not in _VOID:
                    out.append(y)

    walk(n, False)
    end()
    return out


def shape(x: Item) -> tuple:
    """An item's kind and the kinds of what is right within it."""
    return (x.key, *sorted(k.key if k.key != "#flow" else f"#flow {sorted(y.key for y in k.kids)}" for k in x.kids))


def expression(n: Node, keep: bool = False) -> Item:
    """The expression of one page's element; keep: items hold their elements."""
    out, flow = Item(n.key(), nodes=[n] if keep else None), None
    if n.name in _LISTS:
        flow = out  # entries of one kind, wherever they stand, are one repeated item
    for x in _segments(n):
        if isinstance(x, tuple):
            kid = Item("#text", common={digest(x[0]): len(x[0])}, chars=len(x[0]), linked=x[1])
        else:
            kid = expression(x, keep)
        if n.name in _LISTS or kid.key == "#text" or x.name in _FLOW:
            if flow is None:
                flow = Item("#flow")
                out.kids.append(flow)
            same = next((k for k in flow.kids if k.key == kid.key), None)
            if same is None:
                flow.kids.append(kid)
            else:
                combine(same, kid, True)
            continue
        flow = None
        last = out.kids[-1] if out.kids else None
        if last is not None and last.key == kid.key and (x.name in _REPEATING or shape(last) == shape(kid)):
            combine(last, kid, True)
        else:
            out.kids.append(kid)
    return out


def align(a: list[Item], b: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """Both lists in order, with what belongs together side by side: items of one key, rather with than without an equal shape."""
    if [x.key for x in a] == [y.key for y in b] and len({x.key for x in a}) == len(a):
        return list(zip(a, b))
    if len(a) * len(b) > 40_000:  # long lists of unlike items: by key, in order
        left: dict[str, list[Item]] = {}
        for y in reversed(b):
            left.setdefault(y.key, []).append(y)
        pairs = [(x, left[x.key].pop() if left.get(x.key) else None) for x in a]
        paired = {id(y) for _, y in pairs if y is not None}
        return pairs + [(None, y) for y in b if id(y) not in paired]
    sa, sb = [shape(x) for x in a], [shape(y) for y in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            gain = 0 if a[i].key != b[j].key else 3 if sa[i] == sb[j] else 2
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + gain if gain else 0)
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        gain = 0 if a[i].key != b[j].key else 3 if sa[i] == sb[j] else 2
        if gain and best[i][j] == best[i + 1][j + 1] + gain:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif best[i][j] == best[i + 1][j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out + [(x, None) for x in a[i:]] + [(None, y) for y in b[j:]]


def combine(a: Item, b: Item, repeats: bool = False) -> None:
    """Makes a the expression of both; repeats: b follows a on the same page, else it is of other pages."""
    if repeats:
        a.several = True
        a.nodes += b.nodes
        a.common.update(b.common)
    else:
        a.pages += b.pages
        a.several |= b.several
        a.common = {k: v for k, v in a.common.items() if k in b.common}
    a.chars += b.chars
    a.linked += b.linked
    if a.key == "#flow" or a.key.split(".")[0] in _LISTS:
        of = {k.key: k for k in a.kids}
        for y in b.kids:
            if y.key in of:
                combine(of[y.key], y, repeats)
            else:
                a.kids.append(y)
                of[y.key] = y
        return
    kids = []
    for x, y in align(a.kids, b.kids):
        if x is not None and y is not None:
            combine(x, y, repeats)
        kids.append(x if x is not None else y)
    a.kids = kids


def flatten(x: Item) -> list[tuple]:
    """The items in order, each before the items within it, without nesting: the form in which expressions are stored."""
    out: list[tuple] = []

    def walk(y: Item) -> None:
        out.append((y.key, y.pages, y.several, len(y.kids), y.common, y.chars, y.linked))
        for k in y.kids:
            walk(k)

    walk(x)
    return out


def unflatten(rows: list[tuple]) -> Item:
    rest = iter(rows)

    def read() -> Item:
        key, pages, several, kids, common, chars, linked = next(rest)
        x = Item(key, pages, several, None, common, chars, linked)
        x.kids = [read() for _ in range(kids)]
        return x

    return read()


def pattern(x: Item) -> str:
    """The expression in words, for people: `?` for optional, `+` for repeated, `_` for a slot, `=` for a fixed text."""

    def walk(y: Item, of: int) -> str:
        mark = ("+" if y.several else "") + ("?" if y.pages < of else "")
        if y.key == "#text":
            return ("=" if y.common and y.pages > 1 else "_") + mark
        inner = " ".join(walk(k, y.pages) for k in y.kids)
        return f"({inner}){mark}" if y.key == "#flow" else f"<{y.key.split('.')[0]}>{inner}</>{mark}"

    return walk(x, x.pages)


def rank(root: Item) -> list[int]:
    """The numbers (in order of appearance) of the containers that may hold the article, best first, by text in slots."""
    number: dict[int, int] = {}
    inner: dict[int, tuple[int, int]] = {}
    density: dict[int, float] = {}
    containers: list[Item] = []

    def walk(x: Item, above: list[Item]) -> tuple[int, int]:
        number[id(x)] = len(number)
        holds = x.key[0] != "#" and ((name := x.key.split(".")[0]) == "td" or name not in _REPEATING)
        if holds:
            containers.append(x)
            above = [*above[-4:], x]
        slots, chars = 0, x.chars
        if x.key == "#text":
            slots = x.slot_chars()
            share, plain = 1.0, max(0, slots - 2 * x.linked)
            for c in reversed(above):
                density[id(c)] = density.get(id(c), 0.0) + plain * share
                share *= 0.5
        for k in x.kids:
            a, b = walk(k, above)
            slots, chars = slots + a, chars + b
        inner[id(x)] = slots, chars
        return slots, chars

    walk(root, [])
    size = lambda x: inner[id(x)]
    bodies = sorted((x for x in containers if x.key.endswith("@body") and size(x)[1]), key=size, reverse=True)
    mains = sorted((x for x in containers if x.key.endswith("@main") and size(x)[1]), key=size, reverse=True)
    first = mains + bodies if mains and (not bodies or 2 * size(bodies[0])[0] < size(mains[0])[0]) else bodies + mains
    rest = sorted((x for x in containers if density.get(id(x), 0) > 0), key=lambda x: -density[id(x)])
    return list(dict.fromkeys(number[id(x)] for x in [*first, *rest, root]))


class Wrapper:
    """A host's expression, its containers in the order to try them, and whether enough pages differ to tell fixed texts."""

    def __init__(self, root: Item, different: int) -> None:
        if different < 2:  # copies of one page: nothing tells fixed texts from others
            _forget(root)
        self.root, self.order, self.tells = root, rank(root), different >= FIXED_PAGES


def _forget(x: Item) -> None:
    x.common = {}
    for k in x.kids:
        _forget(k)


def _matched(page: Item, wrapper: Item) -> dict[int, tuple[list[Node], Item]]:
    """Of the wrapper's items, by number, that the page has: the page's elements there."""
    out: dict[int, tuple[list[Node], Item]] = {}
    at = 0

    def walk(w: Item, x: Item | None) -> None:
        nonlocal at
        if x is not None:
            out[at] = (x.nodes, w)
        at += 1
        if x is None:
            to = {}
        elif w.key == "#flow" or w.key.split(".")[0] in _LISTS:
            of = {k.key: k for k in x.kids}
            to = {id(k): of.get(k.key) for k in w.kids}
        else:
            to = {id(a): b for a, b in align(w.kids, x.kids) if a is not None}
        for k in w.kids:
            walk(k, to.get(id(k)))

    walk(wrapper, page)
    return out


def _lines(n: Node) -> list[str]:
    """The texts of an element in page order."""
    out: list[str] = []

    def walk(x: Node) -> None:
        for y in _segments(x):
            if isinstance(y, tuple):
                out.append(y[0])
            else:
                walk(y)

    walk(n)
    return out


def _fixed(x: Item, tells: bool) -> set[int]:
    """Digests of the texts within an item that are the same on all of its pages."""
    out: set[int] = set()

    def walk(y: Item) -> None:
        if y.key == "#text" and y.pages >= FIXED_PAGES:
            out.update(y.common)
        for k in y.kids:
            walk(k)

    if tells:
        walk(x)
    return out


def extract(page: str | None, wrapper: Wrapper | None = None) -> str:
    """The page's main text by a wrapper, or by its own expression."""
    if not page:
        return ""
    own = expression(tree(page), True)
    wrapper = wrapper or Wrapper(own, 1)
    found = _matched(own, wrapper.root)
    for number in wrapper.order:
        nodes, item = found.get(number, ((), None))
        lines = max((_lines(n) for n in nodes), key=lambda x: sum(map(len, x)), default=[])
        if not lines:
            continue
        fixed = _fixed(item, wrapper.tells)
        kept = [x for x in lines if digest(x) not in fixed] if fixed else lines
        total = sum(map(len, lines))
        if 5 * sum(map(len, kept)) >= 4 * total:
            return " ".join(kept)
        return " ".join(lines)
    return ""


def _deep() -> None:
    """Nested pages are walked by calls of calls, which take no room on the C stack."""
    if sys.getrecursionlimit() < 10_000_000:
        sys.setrecursionlimit(10_000_000)


def _packed(root: Item, different: set[int]) -> bytes:
    return pickle.dumps((flatten(root), sorted(different)[:FIXED_PAGES]), protocol=5)


def _joined(parts: list[bytes]) -> tuple[Item, set[int]]:
    """Partial expressions of a host, aligned one after another."""
    root, different = None, set()
    for p in sorted(parts):
        rows, some = pickle.loads(p)
        different.update(some)
        if root is None:
            root = unflatten(rows)
        else:
            combine(root, unflatten(rows))
    return root, set(sorted(different)[:FIXED_PAGES])


def learn(pages: list[str]) -> Wrapper:
    """The wrapper of some pages of a host."""
    _deep()
    root, different = None, set()
    for p in pages:
        x = expression(tree(p))
        different.add(digest(p))
        if root is None:
            root = x
        else:
            combine(root, x)
    return Wrapper(root or Item("root."), len(different))


#: Items that a task holds expressions of before it hands them on.
HELD = 200_000


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, expression) of the pages that a task reads, aligned as far as it holds them."""
    _deep()
    held: dict[str, tuple[Item, set[int]]] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        rows = [(h, _packed(*v)) for h, v in held.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.binary())], ["host", "part"])

    for batch in chunks(batches, text="html"):
        for host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = expression(tree(page))
            if host in held:
                combine(held[host][0], x)
                held[host][1].add(digest(page))
                if len(held[host][1]) > 100:
                    held[host] = (held[host][0], set(sorted(held[host][1])[:FIXED_PAGES]))
            else:
                held[host] = (x, {digest(page)})
                size += len(flatten(x))
            if size > HELD:
                yield flush()
                held, size = {}, 0
    if held:
        yield flush()


def _align_parts(t: pa.Table) -> pa.Table:
    _deep()
    return pa.table({"host": [t["host"][0].as_py()], "part": pa.array([_packed(*_joined(t["part"].to_pylist()))], pa.binary())})


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host)
    parts = store(rows.where("html is not null and html <> ''").select("host", "html").mapInArrow(_partial, "host string, part binary").withColumn("task", F.spark_partition_id()), "parts")
    tasks = parts.agg(F.max("task")).first()[0]
    # two levels: neither meets more than about the square root of the number of tasks
    level = F.pmod(F.hash("task"), F.lit(max(1, int((tasks or 0) ** 0.5))))
    first = parts.groupBy("host", level.alias("level")).applyInArrow(_align_parts, "host string, part binary")
    wrappers = store(first.groupBy("host").applyInArrow(_align_parts, "host string, part binary"), "wrappers")
    release(parts)
    total = wrappers.agg(F.sum(F.octet_length("part") + 64)).first()[0] or 0
    narrow = F.broadcast(wrappers) if total <= BROADCAST_BYTES else wrappers  # else a hot host's pages are split by adaptive execution

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _deep()
        known: dict[bytes, Wrapper] = {}
        for batch in chunks(batches, text="html"):
            out = []
            for page, w in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if w is not None and w not in known:
                    if len(known) > 1000:
                        known.clear()
                    root, different = _joined([w])
                    known[w] = Wrapper(root, len(different))
                out.append(extract(page, known.get(w)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return rows.join(narrow, "host", "left").select("page_id", "url", "html", "part").mapInArrow(run, "page_id long, url string, text string, n_chars long")
