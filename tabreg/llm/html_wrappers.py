"""Main text of web pages by wrappers inferred for each host.

A page's token stream becomes a tree of tags and texts. Aligning the streams of a host's pages gives a wrapper, a regular expression
without unions: along each level the tags of all pages are brought into one sequence; a tag that some pages lack is optional; a
tag that occurs again, or in another order, makes everything between its occurrences one repeated group; texts that agree stay
constants, texts that differ become slots. Two wrappers align like two pages, so each task folds its pages into one wrapper per host
and the partial wrappers are folded in two more steps, salted by task: no task ever holds a host's pages, only wrappers, whose
size follows the variety of a site's markup.

The article is every outermost article or main element of a page; on pages without one, the lowest level of the wrapper that holds
all slots. From there blocks of text are taken in page order. Navigation, page headers and footers, asides, forms, scripts, styles and
elements whose class, id or role is the name of a menu, advert, notice, comments and the like are left out, unless they hold the
article; an element whose names only contain such a word goes if the host says so too: the same text on different pages, or half
of it links. Outside an article also constants of the host and lists of links are left out. A constant is the same on at least
``DIFFERENT`` pages whose texts differ; copies of a page tell nothing.

Rows: NULL html or a page without text gives the empty text. A NULL url belongs to the host "". Repeated rows give repeated results.
Only page_id, url and html are read.
"""

from __future__ import annotations

import html as entities
import json
import re
import sys
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabreg.llm.common import SALTS, cut_lineage, narrow, pieces_of_batches

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][A-Za-z0-9:-]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
BLANK = re.compile(r"\s+")
HELD_HOSTS = 2_000
BROADCAST_BYTES = 32 << 20

# fixed values: HTML elements by their part in a page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp".split())
BLOCK = frozenset("html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer "
                  "form frameset h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol optgroup option p pre section summary table "
                  "tbody td tfoot th thead tr ul".split())
LEFT_OUT = frozenset("head script style noscript template iframe object svg canvas math nav footer aside form button select textarea input "
                     "label dialog menu".split())
CLOSES_P = BLOCK - frozenset("html head body option optgroup td th tr tbody thead tfoot".split())
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "option": ({"option"}, {"select"})}
SAID_LEFT_OUT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs byline captcha comment comments "
    "disqus consent cookie cookies copyright footer gdpr hidden login masthead menu modal nav navbar navigation navi newsletter notice "
    "notices notification overlay paywall pager pagination popup promo promoted related recommended reply replies respond search "
    "share sharing sidebar signup skip social sponsor sponsored subscribe subscription tagcloud teaser toolbar widget widgets".split())
SAID_HEADER = frozenset(("header", "topbar", "sitehead"))
SAID_CONTENT = frozenset("article articlebody content entry main post story text".split())
ALWAYS_OUT = frozenset("comment comments disqus reply replies respond ad ads advert adverts advertisement".split())
# a name like comments-area or post-comments says a part; no-sidebar, ad-free or cookie-recipe only holds such a word
SAID_TRAILING = SAID_CONTENT | frozenset(
    "area articles bar block body bottom box button buttons col column container form group head heading icon icons inner item items label "
    "left link links list news outer panel posts right row section site slot small space stories title top unit wrap wrapper zone".split())
SAID_STATE = frozenset("a after an and are as at before by for from has have hide how in is no not of off on or out show the to was "
                       "what when why with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SLUGGED = HEADINGS | frozenset("p li dt dd td th tr blockquote pre figure figcaption span a b i em strong".split())  # ids are anchors
ROLES_OUT = frozenset("navigation banner contentinfo complementary search form dialog alertdialog menu menubar alert".split())


def _said(tokens: list[str]) -> int:
    """2: a class or id is the name of a part that is left out; 1: some word of one could be; 0: neither."""
    names = [[w.lower() for w in WORD.findall(t)] for t in tokens]
    words = {w for n in names for w in n}
    content = bool(words & SAID_CONTENT)
    if not words & (ALWAYS_OUT if content else SAID_LEFT_OUT):
        return 0
    if any(n and SAID_CONTENT.issuperset(n) for n in names):
        return 1
    for n in names:
        if len(n) > 4 or SAID_STATE.intersection(n):
            continue
        while len(n) > 1 and n[-1] in SAID_TRAILING:
            n = n[:-1]
        if n and n[-1] in (ALWAYS_OUT if content else SAID_LEFT_OUT):
            return 2
    return 1


# kinds of elements
PLAIN, OUT, ARTICLE, HEADER, NAMED_OUT, DOUBTFUL, NAMED_ARTICLE = range(7)  # HEADER: left out unless in an article; NAMED_: see settle()


@lru_cache(maxsize=50_000)
def _kind(name: str, rest: str) -> tuple[str, int]:
    """Signature of an element without its kind, and its kind."""
    found = {a.lower(): entities.unescape(b or c or d or "") for a, b, c, d in ATTRIBUTE.findall(rest)}
    words = {w.lower() for a in ("class", "id") for w in WORD.findall(found.get(a, ""))}
    role = found.get("role", "").lower()
    signature = name + "".join(f".{w}" for w in sorted(words | ({role} if role else set())))
    if name in ("html", "body"):
        return name, PLAIN
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "")
    if name in LEFT_OUT or hidden or role in ROLES_OUT:
        return signature, OUT
    if name in ("article", "main") or role in ("main", "article") or found.get("itemprop", "").lower() == "articlebody":
        return signature, NAMED_ARTICLE if _said(found.get("class", "").split()) == 2 else ARTICLE
    said = _said(found.get("class", "").split() + ([] if name in SLUGGED else found.get("id", "").split()))
    if said == 2:
        return signature, NAMED_OUT
    if name == "header" or (words & SAID_HEADER and not words & SAID_CONTENT):
        return signature, HEADER
    return signature, DOUBTFUL if said and name not in HEADINGS else PLAIN


def _kind_of(signature: str) -> int:
    return int(signature[-1]) if signature[-2:-1] == "~" else PLAIN


class Element:
    __slots__ = ("children", "kind", "name", "signature")

    def __init__(self, name: str, signature: str, kind: int):
        self.name, self.kind, self.children = name, kind, []
        self.signature = f"{signature}~{kind}" if kind else signature


def parse(source: str) -> Element:
    """The tree of a page, however broken its markup; children are elements and plain strings (character references decoded)."""
    root = Element("#page", "#page", 0)
    stack, at = [root], 0
    opened: dict[str, int] = {}  # names of the elements on the stack

    def text(a: int, b: int) -> None:
        if b > a:
            stack[-1].children.append(entities.unescape(source[a:b]))

    def close(names: set[str] | frozenset[str], within: set[str] | frozenset[str]) -> None:
        if not any(opened.get(n) for n in names):
            return
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in names:
                for e in stack[k:]:
                    opened[e.name] -= 1
                del stack[k:]
                return
            if stack[k].name in within:
                return

    while (m := TAG.search(source, at)) is not None:
        text(at, m.start())
        at = m.end()
        if m["name"] is None:
            if m["data"]:
                stack[-1].children.append(m["data"])
            continue
        name = m["name"].lower()
        if m["end"]:
            if name == "br":
                stack[-1].children.append(" ")
            elif name not in VOID:
                close({name}, {"article", "main", "table"} - {name} if name not in BLOCK else frozenset())
            continue
        if name in CLOSES_P:
            close({"p"}, {"article", "section", "div", "td", "th", "li", "blockquote", "main", "body", "button", "table"})
        if name in SIBLINGS:
            close(*SIBLINGS[name])
        if name in VOID:
            if name in ("br", "hr", "wbr"):
                stack[-1].children.append(Element("hr", "hr", 0) if name == "hr" else " " if name == "br" else "")
            continue
        signature, kind = _kind(name, m["rest"])
        element = Element(name, signature, kind)
        stack[-1].children.append(element)
        if name in RAW:
            end = re.compile(rf"</{name}\b", re.I).search(source, at)
            at = end.start() if end else len(source)
            continue
        if not m["rest"].endswith("/>") or name in BLOCK:
            stack.append(element)
            opened[name] = opened.get(name, 0) + 1
    text(at, len(source))
    settle(root)
    return root


def settle(page: Element) -> None:
    """Parts left out by their names, unless they hold the article: all text, or most of the text (of the page, or of its article elements
    if there are any) with the first heading or the only article elements. Article elements stay, but for comments within an article."""
    named: list[tuple] = []  # element, in an article element, text in those, text, whether it has a first heading, articles not of comments
    free = {False: False, True: False}  # whether an article element is outside these parts; the same of one within another

    def measure(e: Element, within: bool, post: bool, link: bool, out: bool) -> tuple[int, int, bool, bool]:
        link, out = link or e.name == "a", out or e.kind == NAMED_OUT
        if e.kind == NAMED_ARTICLE:
            e.kind = NAMED_OUT if post else ARTICLE
            e.signature = f"{e.signature[:-1]}{e.kind}"
            if post:
                return 0, 0, False, False
        some = e.kind == ARTICLE
        if some and not out:
            free[within] = True
        inside = chars = 0
        first, article = e.name == "h1", within or some
        for child in e.children:
            if isinstance(child, str):
                size = 0 if link else len(child.strip())
                inside, chars = inside + size * article, chars + size
            elif child.kind != OUT:
                got = measure(child, article, post or e.name == "article", link, out)
                inside, chars, first, some = inside + got[0], chars + got[1], first | got[2], some | got[3]
        if e.kind in (NAMED_OUT, DOUBTFUL):
            named.append((e, within, inside, chars, first, some and not post))
        return inside, chars, first, some

    all_inside, all_chars, heading, _ = measure(page, False, False, False, False)
    for e, within, inside, chars, first, has in named:
        part, total = (inside, all_inside) if within or free[False] else (chars, all_chars)
        if part and (part == total or (2 * part > total and (first or (has and not free[within] and not heading)))):
            e.kind, e.signature = PLAIN, e.signature[:-2]


# ---- wrappers -------------------------------------------------------------------------------------------------------------
# A node is [seen, chars, link chars, constant, children, groups, pages, whole]: occurrences, text below, text in links below, hash of
# its own text if all occurrences agree (-1: a slot, 0: none), children by signature in order, signatures that belong to a repeated
# group, hashes of up to ``DIFFERENT`` pages of different text that hold it, and the hash of all text below if all occurrences agree.
DIFFERENT = 3


def any_depth() -> None:
    """Let functions call themselves as deep as a page nests. Calls from Python to Python take no room on the thread's stack, so only
    memory bounds them; whatever runs in C by depth (JSON among it) is given flat lists."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), 1 << 30))


def packed(wrapper: list) -> str:
    """A wrapper as JSON: its nodes in order, children as names with the place of each."""
    nodes, stack = [], [(wrapper, -1, "")]
    while stack:
        node, parent, name = stack.pop()
        at = len(nodes)
        nodes.append([parent, name, *node[:4], *node[5:]])
        stack += [(child, at, s) for s, child in reversed(node[4].items())]
    return json.dumps(nodes)


def unpacked(text: str) -> list:
    nodes = []
    for parent, name, *rest in json.loads(text):
        nodes.append([*rest[:4], {}, *rest[4:]])
        if parent >= 0:
            nodes[parent][4][name] = nodes[-1]
    return nodes[0]


def _hash(parts: list[str]) -> int:
    return zlib.crc32(" ".join(parts).encode("utf-8", "replace")) | 1 << 32


def wrapper_of(element: Element, in_link: bool = False) -> list:
    node = _node(element, in_link)
    _sign(node, [node[7]])
    return node


def _sign(node: list, page: list[int]) -> None:
    node[6] = page
    for child in node[4].values():
        _sign(child, page)


def _node(element: Element, in_link: bool) -> list:
    own, children, repeated, order, last = 0, {}, set(), [], None
    chars = links = 0
    words, whole = [], []
    link = in_link or element.name == "a"
    for child in element.children:
        if isinstance(child, str):
            s = child.strip()
            if s:
                words.append(s)
                whole.append(s)
                chars += len(s)
                links += len(s) * link
            continue
        got = _node(child, link)
        chars += got[1]
        links += got[2]
        if got[7]:
            whole.append(str(got[7]))
        have = children.get(child.signature)
        if have is None:
            children[child.signature] = got
            order.append(child.signature)
        else:
            children[child.signature] = _fold(have, got)
            repeated.update(order[order.index(child.signature):order.index(last) + 1] if last in order else ())
            repeated.add(child.signature)
        last = child.signature
    if words:
        own = _hash(words)
    return [1, chars, links, own, children, sorted(repeated), [], _hash(whole) if whole else 0]


def _agreed(a: int, b: int) -> int:
    return a if a == b else b if not a else a if not b else -1


def _fold(a: list, b: list) -> list:
    """Alignment of two wrappers of the same element."""
    ka, kb = list(a[4]), list(b[4])
    repeated = {*a[5], *b[5]}
    if ka == kb:
        order = ka
    else:
        place = {s: k for k, s in enumerate(kb)}
        order, used, far = [], 0, -1
        for s in ka:
            if s in place:
                if place[s] < far:  # another order: one repeated group
                    repeated.update(t for t in ka if t in place and place[s] <= place[t] <= far)
                    order.append(s)
                    continue
                far = place[s]
                order += [t for t in kb[used:place[s]] if t not in a[4]]
                used = max(used, place[s] + 1)
            order.append(s)
        order += [t for t in kb[used:] if t not in a[4]]
    children = {}
    for s in order:
        x, y = a[4].get(s), b[4].get(s)
        children[s] = x if y is None else y if x is None else _fold(x, y)
    pages = a[6] if a[6] == b[6] else sorted({*a[6], *b[6]})[:DIFFERENT]
    return [a[0] + b[0], a[1] + b[1], a[2] + b[2], _agreed(a[3], b[3]), children, sorted(repeated), pages, _agreed(a[7], b[7])]


def _constant(node: list) -> bool:
    """Whether all text below is the same on different pages."""
    return node[7] > 0 and len(node[6]) >= DIFFERENT


def expression(node: list, signature: str = "#page", optional: bool = False) -> str:
    """The wrapper as a regular expression, for people."""
    inside, open_group = [], False
    for s, child in node[4].items():
        if (s in node[5]) != open_group:
            inside.append("(" if s in node[5] else ")+")
            open_group = s in node[5]
        inside.append(expression(child, s, child[0] < node[0]))
    if open_group:
        inside.append(")+")
    text = "" if not node[3] else "#SLOT" if node[3] < 0 else "#TEXT"
    return f"<{signature}>{text}{''.join(inside)}</>" + "?" * optional


def article_paths(wrapper: list) -> list[tuple[str, ...]]:
    """Where the text is on pages without article elements: the lowest level that holds all text that is not constant."""
    path: tuple[str, ...] = ()
    node = wrapper
    while node[3] >= 0 and (not node[3] or len(node[6]) >= DIFFERENT):  # no text of its own, or a constant
        varied = [s for s, c in node[4].items() if _kind_of(s) not in (OUT, HEADER, NAMED_OUT) and c[1] and not _constant(c)]
        if len(varied) != 1 or varied[0].split("~")[0].split(".")[0] in SLUGGED | {"ul", "ol", "table", "tbody"}:
            break
        node, path = node[4][varied[0]], (*path, varied[0])
    return [path]


def page_text(page: Element, wrapper: list, paths: list[tuple[str, ...]], pages: int) -> str:
    """Blocks of the article, one per line."""
    blocks: list[str] = []
    held: list[str] = []
    guarded = len(wrapper[6]) >= DIFFERENT  # host evidence means something

    def flush() -> None:
        line = BLANK.sub(" ", "".join(held)).strip()
        held.clear()
        if line:
            blocks.append(line)

    def dropped(child: Element, below: list | None, free: bool) -> bool:
        if child.kind in (OUT, NAMED_OUT) or (child.kind == HEADER and free):
            return True
        if below and child.kind == DOUBTFUL and (_constant(below) or below[2] * 2 >= below[1] > 0):
            return True
        return bool(free and guarded and below and child.name in BLOCK and (
            _constant(below) or below[2] * 5 >= below[1] * 4 > 0 and child.name in ("ul", "ol", "div")))

    def take(e: Element, node: list | None, free: bool) -> None:
        block = e.name in BLOCK
        if block:
            flush()
        for child in e.children:
            if isinstance(child, str):
                held.append(child)
                continue
            below = node[4].get(child.signature) if node else None
            if not dropped(child, below, free):
                take(child, below, free)
        if block:
            flush()

    def descend(e: Element, node: list | None, path: tuple[str, ...]) -> None:
        if not path:
            take(e, node, True)
            flush()
            return
        for child in e.children:
            if not isinstance(child, str) and child.signature == path[0]:
                descend(child, node[4].get(path[0]) if node else None, path[1:])

    def articles(e: Element, node: list | None) -> bool:
        hit = False
        for child in e.children:
            if isinstance(child, str) or child.kind in (OUT, NAMED_OUT):
                continue
            below = node[4].get(child.signature) if node else None
            if child.kind == ARTICLE:
                take(child, below, False)
                flush()
                hit = True
            else:
                hit |= articles(child, below)
        return hit

    if not articles(page, wrapper):
        for p in paths:
            descend(page, wrapper, p)
    if not blocks:  # no article, or an empty one: what the page alone says
        guarded = False
        take(page, wrapper_of(page), True)
        flush()
    return "\n".join(blocks)


# ---- jobs -----------------------------------------------------------------------------------------------------------------

def _with_host(pages: DataFrame) -> DataFrame:
    rows = narrow(pages, page_id="page_id:long", url="url:string", html="html:string")
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#:]+)", 1))
    return rows.select("page_id", "url", "html", host.alias("host"))


def host_wrappers(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of every host, from all its pages."""

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_depth()
        task = TaskContext.get().partitionId() % SALTS
        held: dict[str, list] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array([task] * len(held), pa.int32()),
                                               pa.array([packed(w) for w in held.values()], pa.string())], ["host", "salt", "wrapper"])

        for batch in pieces_of_batches(batches, "html"):
            for host, source in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = wrapper_of(parse(source or ""))
                held[host] = _fold(held[host], own) if host in held else own
            if len(held) > HELD_HOSTS:
                yield out()
                held = {}
        yield out()

    def merge(group: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_depth()
        whole, host = None, None
        for batch in group:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):  # noqa: B020
                part = unpacked(text)
                whole = part if whole is None else _fold(whole, part)
        yield pa.RecordBatch.from_arrays([pa.array([host]), pa.array([packed(whole)])], ["host", "wrapper"])

    parts = _with_host(pages).select("host", "html").mapInArrow(partial, "host string, salt int, wrapper string")
    salted = parts.groupBy("host", "salt").applyInArrow(lambda g: _table(merge, g), "host string, wrapper string")
    return salted.groupBy("host").applyInArrow(lambda g: _table(merge, g), "host string, wrapper string")


def _table(merge, group: pa.Table) -> pa.Table:
    return pa.Table.from_batches(list(merge(group.to_batches())))


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    wrappers = cut_lineage(host_wrappers(pages).withColumnRenamed("host", "__host"))
    rows = _with_host(pages)
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("__host"))).collect()[0][0] or 0
    if size <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(wrappers), F.col("host") == F.col("__host"))
    else:  # a host's pages in SALTS groups
        salted = rows.withColumn("__salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        copies = wrappers.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, (F.col("host") == F.col("__host")) & (F.col("__salt") == F.col("__copy")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        any_depth()
        known: dict[str, tuple] = {}
        for batch in pieces_of_batches(batches, "html"):
            texts = []
            for source, host, text in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                if host not in known:
                    if len(known) >= HELD_HOSTS:
                        known.clear()
                    wrapper = unpacked(text)
                    known[host] = (wrapper, article_paths(wrapper), wrapper[0])
                texts.append(page_text(parse(source or ""), *known[host]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.select("page_id", "url", "html", "host", "wrapper").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
