"""Main text of web pages by equivalence-class template deduction (after EXALG; Arasu and Garcia-Molina, 2003).

Method.  A page is read as a sequence of tokens, told apart by their context: an
element by the names and classes on the way to it, a text block by its place and
words.  For each host, the occurrence vector of a token says how often it stands on
each page; tokens with the same vector form an equivalence class.  Vectors are
compared by a fingerprint, the sum over pages of a random number per page times the
count, which adds up in any order.  A class is valid if it stands on at least half of
the host's pages; the valid classes of elements, nested by their contexts, are the
host's template, and what varies inside an element of the template is a slot.  The
tokens that stand once on a page come in one order, or the page does not
follow the template and is read by its own markup.

Slots.  The article's is the element of the template that HTML names so, on most
pages, or else the innermost one with nine tenths of the text.  Slots of other
elements of the template that HTML, or any of their classes, names as menu, advert,
comments and so on are not extracted, wherever they stand.  Text blocks in the class
of the article's slot itself, over at least ``LEAST_ARTICLES`` different articles (the
method's support), are template text.  What else stands in the slot is the text.
An element that is no part of the template is judged by HTML's own names and, outside
an article, by its classes if all of them name such a thing; inside, classes
of the page's own say nothing.

Scale.  Token counts are aggregated before the shuffle; a host with a third of all
pages is many tokens, not one group.  A host's template is made from the
tokens on at least half its pages, a number bounded by two pages' tokens.
Templates are broadcast while they are few and small, else joined by host.  Contexts
are hashes, so that depth costs nothing.

Cases.  Null html counts as empty, and an empty page has empty text.  Pages
without a url or of a host with one page are read by their own markup.
Cut off pages are read to where they end; an unfinished tag is dropped.
Repeated rows give repeated rows.  Empty tables give empty results.  Only
``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import durable, pieces

#: Templates that are broadcast at most, and the hashes in all of them.
BROADCAST_HOSTS = 50_000
BROADCAST_HASHES = 1_000_000
#: Different articles over which a text block must stand to count as template text.
LEAST_ARTICLES = 5

# Names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("aside audio button canvas footer form head iframe input label map math menu nav noscript object script select style svg template textarea title video".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation note search tablist toolbar".split())
HINTS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disclaimer disqus footer form header masthead menu modal nav navbar navigation newsletter notice notices notification pagination popup promo promoted promotion recommended related respond share sharing sidebar social sponsor sponsored subscribe toc toolbar widget widgets".split()
)
NEUTRAL = frozenset("area block bottom box button container content global inner item left list main outer page panel primary right secondary section site sub top wrap wrapper".split())
ARTICLES = frozenset(["article", "main"])
_CLOSED_BY = {  # open elements that a start tag ends
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
    "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"},
}
_LIMITS = frozenset(["ul", "ol", "table", "dl", "select", "body", "html"])

_pieces = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(>|\Z)", re.DOTALL
)
_attribute = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_RAW = {n: re.compile(rf"</{n}(?=[\s/>]|\Z)", re.IGNORECASE) for n in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}


class Node:
    """An open element: name, the hash of its context, what it is, and what its reader keeps of it."""

    __slots__ = ("name", "path", "article", "state", "chars")

    def __init__(self, name: str, path: int, article: bool, state):
        self.name, self.path, self.article, self.state, self.chars = name, path, article, state, 0


def _names_other(word: str) -> bool:
    """Whether a class or id names something that is not the article."""
    parts = [p for p in re.split(r"[_-]+", word) if p and not p.isdigit()]
    return any(p in HINTS for p in parts) and all(p in HINTS or p in NEUTRAL for p in parts)


def _label(name: str, attrs: str, parent: Node) -> tuple[str, int, bool]:
    """Name with classes; what it is: 0 any, 1 all classes name something else, 2 one does, 3 HTML does; whether it is an article."""
    article = name in ARTICLES
    other = 3 if name in DROPPED or (name == "header" and not parent.article) else 0
    if not attrs or attrs.isspace():
        return name, other, article
    found = {a.lower(): entities.unescape(v.strip("\"'")) if v else "" for a, v in _attribute.findall(attrs)}
    role = found.get("role", "").lower()
    article |= role in ("main", "article") or found.get("itemprop") == "articleBody"
    words = f"{found.get('class', '')} {found.get('id', '')}".lower().split()
    if other or role in ROLES or "hidden" in found or found.get("aria-hidden") == "true":
        other = 3
    elif not article and name not in ("html", "body") and any(named := [_names_other(w) for w in words]):
        other = 1 if all(named) else 2
    return name + "".join(f".{w}" for w in sorted(found.get("class", "").split())), other, article


def read(page: str, enter, leave, block) -> None:
    """Read a page: ``enter(parent, path, other, article)`` gives an element's state, ``leave(node)`` ends it, ``block(node, text)`` is a text block in order."""
    root = Node("", 0, False, None)
    stack, parts, at, n = [root], [], 0, len(page)

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                stack[-1].chars += len(text)
                block(stack[-1], text)

    def close(k: int) -> None:
        while len(stack) > k:
            node = stack.pop()
            stack[-1].chars += node.chars
            leave(node)

    while at < n:
        m = _pieces.search(page, at)
        if m is None:
            parts.append(entities.unescape(page[at:]))
            break
        if m.start() > at:
            parts.append(entities.unescape(page[at : m.start()]))
        at = max(m.end(), at + 1)
        name = m[2] or m[6]
        if not name:
            if m[0].startswith("<![CDATA["):
                parts.append(m[0][9:].removesuffix("]]>"))
            continue
        if (m[4] if m[2] else m[8]) != ">":
            break  # the page ends inside a tag
        name, closing, attrs = name.lower(), m[1] or m[5], m[3] or m[7] or ""
        if name == "br":
            parts.append(" ")
            continue
        if closing:
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if k:
                if any(x.name in BLOCKS or x.path != stack[k - 1].path for x in stack[k:]):
                    flush()
                close(k)
            continue
        opens = name in BLOCKS
        ends = _CLOSED_BY.get(name, {"p"} if opens else set())
        if ends:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].name in ends or (opens and stack[i].name == "p"):
                    flush()
                    close(i)
                    if name in ("li", "p", "option"):
                        break
                elif stack[i].name in _LIMITS or (opens and name not in _CLOSED_BY and stack[i].name in BLOCKS):
                    break
        top = stack[-1]
        label, other, article = _label(name, attrs, top)
        apart = opens or other or article or top is root
        if opens or other or article:
            flush()
        if name in VOID or attrs.rstrip().endswith("/") and name not in BLOCKS and name not in _RAW:
            continue
        if name in _RAW:
            end = _RAW[name].search(page, at)
            done = page.find(">", end.end()) if end else -1
            at = done + 1 if done >= 0 else n
            continue
        path = _hash(f"{top.path}/{label}") if apart else top.path
        node = Node(name, path, top.article or article, top.state)
        if apart:
            node.state = enter(top, path, other, article)
        stack.append(node)
    flush()
    close(1)


def tokens_of(page: str) -> tuple[dict[int, list[int]], dict[tuple[int, int], int]]:
    """Of a page: for each element its times, characters of text, what it is, depth and place; and the times of each text block."""
    elements: dict[int, list[int]] = {}
    blocks: dict[tuple[int, int], int] = {}

    def enter(parent: Node, path: int, other: int, article: bool) -> tuple[int, bool]:
        depth, lost = parent.state or (0, False)
        lost = lost or other == 3 or (other > 0 and not parent.article)
        own = elements.setdefault(path, [0, 0, 0, depth + 1, len(elements)])
        own[0] += 1
        own[2] |= (1 if article else 0) | (2 if other else 0)
        return depth + 1, lost

    def leave(node: Node) -> None:
        if node.state and node.path in elements:
            elements[node.path][1] = max(elements[node.path][1], node.chars)

    def block(node: Node, text: str) -> None:
        if node.state and node.state[1]:
            node.chars -= len(text)
        key = (node.path, _hash(f"{node.path}\0{text}"))
        blocks[key] = blocks.get(key, 0) + 1

    read(page, enter, leave, block)
    return elements, blocks


def article_of(page: str, template: dict | None) -> str:
    """What stands in the template's slot, or in the page's own article where it does not follow the template."""
    slot, others, held, order = (template["slot"], frozenset(template["others"]), frozenset(template["held"]), template["once"]) if template else (None, (), (), [])
    wanted, met = frozenset(order), []
    found: list[tuple[bool, bool, str, bool]] = []  # whether slot's own text, whether in an article, text, whether in the slot

    def enter(parent: Node, path: int, other: int, article: bool) -> tuple[bool, bool]:
        inside, lost = parent.state or (False, False)
        if path in wanted:
            met.append(path)
        return inside or path == slot, lost or other == 3 or path in others or (other == 1 and not parent.article)

    def block(node: Node, text: str) -> None:
        inside, lost = node.state or (False, False)
        if not lost:
            found.append((inside and _hash(f"{node.path}\0{text}") not in held, node.article, text, inside))

    read(page, enter, lambda node: None, block)
    places = {p: i for i, p in enumerate(order)}
    follows = slot is not None and all(places[a] < places[b] for a, b in zip(met, met[1:], strict=False)) and any(x[3] for x in found)
    if follows:
        return "\n".join([x[2] for x in found if x[0]])
    named = any(x[1] for x in found)
    return "\n".join([x[2] for x in found if x[1] or not named])


def _hash(x: str) -> int:
    return xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63)


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.col("url"), r"^\s*[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).alias("html"), F.when(host != "", host).alias("host"))


def host_tokens(pages: DataFrame) -> DataFrame:
    """Per host and token: fingerprint of the occurrence vector, pages, times, characters, what it is, depth, place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, list[int]] = {}

            def add(key: tuple, number: int, times: int = 1, chars: int = 0, kind: int = 0, depth: int = 0, place: int = 0) -> None:
                r = rows.setdefault(key, [0, 0, 0, 0, 0, depth, 0])
                r[0] = (r[0] + number * times) & 0xFFFFFFFFFFFFFFFF
                r[1] += 1
                r[2] += times
                r[3] += chars
                r[4] |= kind
                r[6] += place

            for page_id, host, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                number = _hash(f"{page_id}\0{page}") & 0xFFFFFFFFFFFFFFFF
                elements, blocks = tokens_of(page)
                add((host, "page", 0, 0), number)
                add((host, "body", 0, _hash(",".join(str(t) for _, t in blocks))), number)
                for p, (times, chars, kind, depth, place) in elements.items():
                    add((host, "element", p, 0), number, times, chars, kind, depth, place)
                for (p, t), k in blocks.items():
                    add((host, "text", p, t), number, k)
            host, kind, token, h = zip(*rows, strict=True) if rows else ((), (), (), ())
            values = [list(c) for c in zip(*rows.values(), strict=True)] if rows else [[]] * 7
            values[0] = [v - (1 << 64) if v >> 63 else v for v in values[0]]
            cols = [pa.array(host, pa.string()), pa.array(kind, pa.string()), pa.array(token, pa.int64()), pa.array(h, pa.int64()), *[pa.array(v, pa.int64()) for v in values]]
            yield pa.RecordBatch.from_arrays(cols, names=["host", "kind", "token", "h", "vector", "pages", "times", "chars", "what", "depth", "place"])

    counted = _hosted(pages).filter("host is not null").select("page_id", "host", "html")
    counted = counted.mapInArrow(run, "host string, kind string, token long, h long, vector long, pages long, times long, chars long, what long, depth long, place long")
    # vectors add up modulo 2^64: halves are summed apart, as sums of longs may not overflow
    low, high = F.sum(F.col("vector").bitwiseAND(F.lit(0xFFFFFFFF))), F.sum(F.shiftrightunsigned("vector", 32))
    return counted.groupBy("host", "kind", "token", "h").agg(
        (F.shiftleft((F.shiftrightunsigned(low, 32) + high).bitwiseAND(F.lit(0xFFFFFFFF)), 32)).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF))).alias("vector"),
        *[F.sum(c).alias(c) for c in ("pages", "times", "chars", "place")],
        F.bit_or("what").alias("what"),
        F.min("depth").alias("depth"),
    )


_TEMPLATE = "host string, slot long, others array<long>, held array<long>, once array<long>"


def templates(pages: DataFrame) -> DataFrame:
    """Each host's template: the article's ``slot``, the ``others`` that hold none, the ``held`` text, and the elements that stand ``once``, in order."""
    tokens = durable(host_tokens(pages))
    totals = tokens.groupBy("host").agg(F.sum(F.when(F.col("kind") == "page", F.col("pages"))).alias("total"), F.count_if(F.col("kind") == "body").alias("bodies")).filter("total > 1")
    common = tokens.filter("kind not in ('page', 'body')").join(totals, "host").filter(F.col("pages") * 2 >= F.col("total"))

    def deduce(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(valid=rows.groupby("vector")["token"].transform("size"))  # the class of a token, by its vector
        elements = rows[rows["kind"] == "element"].sort_values(["depth", "token"])
        others = elements[(elements["what"] & 2) > 0]
        held, once, slot = [], [], None
        texts = elements[((elements["what"] & 2) == 0) & (elements["chars"] > 0)]
        if len(texts):
            named = texts[(texts["what"] & 1) > 0]
            if len(named):  # on most pages, then with most text, the outermost
                best = named.sort_values(["pages", "chars", "depth", "token"], ascending=[False, False, True, True]).iloc[0]
            else:  # the innermost with nine tenths of the text
                best = texts[texts["chars"] * 10 >= texts["chars"].max() * 9].sort_values(["depth", "token"], ascending=[False, True]).iloc[0]
            slot = int(best["token"])
            own = rows[(rows["vector"] == best["vector"]) & (rows["times"] == rows["pages"])]  # the slot's class
            if rows["bodies"].iloc[0] >= LEAST_ARTICLES:
                held = sorted(rows.loc[(rows["kind"] == "text") & (rows["vector"] == best["vector"]), "h"].tolist())
            whole = own[(own["kind"] == "element") & (own["valid"] > 1)]
            once = whole.sort_values(["place", "depth", "token"])["token"].tolist()
        return pd.DataFrame({"host": [rows["host"].iloc[0]], "slot": pd.array([slot], dtype="Int64"), "others": [sorted(others["token"].tolist())], "held": [held], "once": [once]})

    return common.groupBy("host").applyInPandas(deduce, _TEMPLATE)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url`` and ``text`` of every page."""
    made = durable(templates(pages).filter("slot is not null"))
    n, hashes = made.agg(F.count(F.lit(1)), F.sum(F.size("others") + F.size("held") + F.size("once"))).first()
    few = n <= BROADCAST_HOSTS and (hashes or 0) <= BROADCAST_HASHES
    template = F.struct("slot", "others", "held", "once").alias("template")
    made = made.select("host", template)
    joined = _hosted(pages).join(F.broadcast(made) if few else made, "host", "left").select("page_id", "url", "html", "template")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            text = [article_of(p, t) for p, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return joined.mapInArrow(run, "page_id long, url string, text string")
