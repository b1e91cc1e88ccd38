"""Main text of web pages by wrappers that are inferred for each host.

A page is a token stream of tags and texts. Its wrapper is a union-free regular
expression over elements in page order. One page of each host, that of the
least hash, is the pattern: its elements are the slots of the first wrapper.
The host's pages are aligned with it one after the other. Where the labels of
an element's children (name and words of class, id and role) are those of the
slots, they match one to one; at a mismatch, children whose whole text is that
of a slot anchor the streams, and between anchors labels match in order. A slot
that some pages lack is optional; what has no slot becomes an optional group of
its gap, and a repeated one if it comes again there. Texts that differ make a
text slot, a text that all pages share stays template. All pages are aligned
with the same pattern, so what they add up to is commutative and associative:
neither the order of pages nor their partitioning matters.

Wrappers are folded within each task and then, host by host, over salted
partial wrappers, so a host with very many pages meets in no single task. The
host's wrapper decides once what is main: the deepest element that holds most
of what the slots have in no link, an article or main element if one does.
Menus, headers, footers, sidebars, notices, adverts, forms and comments, told
by their names and words, hold nothing, unless they hold the main part itself:
an article or main element with half of the slots' text, or nearly all of it.
Each page is then aligned with its host's wrapper. In a main part that is named
as such nothing but asides goes. Elsewhere a page's text is template if the
whole of it is what the host's pages have there, four fifths of them and two at
least, and where such texts are most of the main part, the pages are copies of
one article and keep them.

Null or empty html gives an empty text, a null URL is a host of its own,
unclosed and misnested tags and cut-off pages are read as far as they go, and
what is in elements nested deeper than DEPTH belongs to the one at that depth. Rows stay
one to one, repeated ids and pages too; further columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import html
import json
import re
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wirespan.llm.common import materialised, read
from wirespan.llm.memo import slices
from wirespan.llm.near_dedup import SALTS, salted
from wirespan.llm.url_filter import split_url

DEPTH = 60
#: A text of a host's wrapper counts as template if this share of its pages, two at least, have it and no page another one there.
TEMPLATE_SHARE = 4, 5
#: Wrappers of all hosts that are larger than this are joined by a shuffle, not sent to every executor.
MAX_BROADCAST_BYTES = 16 << 20
#: Hosts whose wrappers a task holds at a time.
HOSTS = 2000

# Element names of HTML by their part in a page, and words in class, id or role that tell the same.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rb rt rp s samp small span strike strong sub sup time tt u var".split())
FLOW = set("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption hr center".split())
NO_TEXT = set("script style template noscript head title iframe object svg math canvas audio video select textarea button option datalist".split())
ASIDE = set("nav footer aside form dialog menu".split())
ASIDE_WORDS = set(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup login comment comments commentlist respond replies disqus share sharing social related "
    "recommended recommendations widget pagination pager toolbar search searchform complementary contentinfo".split()
)
#: Words that turn a class around or tell of something beside the element, as in no-sidebar, has-comments, ad-free.
TURNING_WORDS = set("no not non without has with free".split())
MAIN_WORDS = set("article articlebody main content post entry story".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")


class Element:
    """A part of a page: its label, its items (texts, children and block ends) in order, and whether it is an inline one's text."""

    __slots__ = ("items", "label", "name", "own", "whole", "words")

    def __init__(self, name: str, words: frozenset = frozenset()):
        self.name, self.words, self.items = name, words, []
        self.own = self.whole = None  # hashes, once they are asked for
        self.label = "flow" if name in FLOW and not words & ASIDE_WORDS else " ".join([name, *sorted(words)])


def parse(page: str) -> Element:
    """The page's elements; inline ones are their parent's text. A text item is (text, is in a link), a block's end None."""
    root = Element("html")
    stack, links, at, skip = [root], 0, 0, None
    held = Counter()  # how many elements of each name are on the stack

    def leave(i: int) -> None:
        for e in stack[i:]:
            held[e.name] -= 1
        if i >= DEPTH:
            stack[i].items.append(None)
        del stack[i:]

    for m in TOKEN.finditer(page):
        if skip is None and m.start() > at:
            stack[-1].items.append((page[at : m.start()], links > 0))
        at = m.end()
        closing, name, rest = m.group(1, 2, 3) if m.group(2) else m.group(4, 5, 6)
        if not name:
            continue
        name = name.lower()
        if skip is not None:
            if closing and name == skip:
                skip = None
            continue
        if name in ("script", "style", "textarea", "title", "noscript", "template") and not closing:
            if not rest.endswith("/"):
                skip = name
            continue
        if name == "br":
            stack[-1].items.append((" ", False))
        elif name in ("html", "body", "head") or name in VOID:
            if name == "hr":
                stack[-1].items.append(None)
        elif name in INLINE:
            if name == "a":
                links = max(0, links - 1) if closing else 1
        elif closing:
            if held[name] > 0:
                leave(next(i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name))
                links = 0
        else:
            links = 0
            if name == "p" or (name in FLOW and stack[-1].name == "p") or name in ("div", "section", "article", "footer", "nav", "aside", "form", "header", "main"):
                while stack[-1].name in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                    leave(len(stack) - 1)
            if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
                same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}[name]
                while stack[-1].name in (*same, "p"):
                    leave(len(stack) - 1)
            found = set()
            for a in ATTRIBUTE.finditer(rest):
                key = a[1].lower()
                value = (a[2] or a[3] or a[4] or "").lower()
                if key == "hidden" or (key == "aria-hidden" and value == "true"):
                    found.add("hidden")
                else:
                    for token in value.split():
                        words = set(WORDS.findall(token))
                        found |= words - ASIDE_WORDS if words & TURNING_WORDS else words
            new = Element(name, frozenset(found))
            if len(stack) < DEPTH:
                stack[-1].items.append(new)
            else:  # it has its own end, and its texts are those of the element at DEPTH
                stack[-1].items.append(None)
                new.items = stack[-1].items
            if not rest.endswith("/"):
                stack.append(new)
                held[name] += 1
    if skip is None and at < len(page):
        stack[-1].items.append((page[at:], links > 0))
    return root


def hashed(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=12).hexdigest() if text else ""


def text_hash(e: Element) -> str:
    """A hash of the element's own whole text; empty where it has none."""
    if e.own is None:
        e.own = hashed(" ".join("".join([i[0] for i in e.items if type(i) is tuple]).split()))
    return e.own


def children_of(e: Element) -> list[Element]:
    return [i for i in e.items if type(i) is Element]


def whole_hash(e: Element) -> str:
    """A hash of all texts in the element; empty where it has none."""
    if e.whole is None:
        e.whole = hashed(" ".join(filter(None, [text_hash(e), *map(whole_hash, children_of(e))])))
    return e.whole


def in_order(first: list, second: list) -> list[tuple[int, int]]:
    """The longest rising chain of pairs (place in first, place in second) of keys that are the same one's same occurrence."""
    seen: Counter = Counter()
    places = {}
    for j, key in enumerate(second):
        seen[key] += 1
        places[key, seen[key]] = j
    seen.clear()
    tails: list[int] = []  # the least last place of chains of each length
    ends: list[tuple] = []  # and such a chain, as (pair, chain before it)
    for i, key in enumerate(first):
        seen[key] += 1
        j = places.get((key, seen[key])) if key is not None else None
        if j is not None:
            at = bisect.bisect_left(tails, j)
            chain = ((i, j), ends[at - 1] if at else None)
            tails[at : at + 1], ends[at : at + 1] = [j], [chain]
    out = []
    chain = ends[-1] if ends else None
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out[::-1]


def align(children: list[Element], slots: list[dict]) -> list[tuple[int, bool]]:
    """For each child its slot, or the gap (before the slot of that number) that it falls in, and whether it has the slot."""
    labels, wanted = [c.label for c in children], [s["l"] for s in slots]
    if labels == wanted:
        return [(i, True) for i in range(len(children))]
    if not slots:
        return [(0, False)] * len(children)
    found: dict[int, int] = {}

    def gaps(i: int, j: int, pairs: list[tuple[int, int]], a: int, b: int) -> list[tuple[int, int, int, int]]:
        """What lies between the pairs in children from i to a and slots from j to b, where that is something in both."""
        out = []
        for x, y in [*pairs, (a, b)]:
            if i < x and j < y:
                out.append((i, j, x, y))
            i, j = x + 1, y + 1
        return out

    strong = in_order([(c.label, whole_hash(c)) if whole_hash(c) else None for c in children], [(s["l"], s["d"]) if s["d"] else None for s in slots])
    found.update(strong)
    rest = gaps(0, 0, strong, len(children), len(slots))
    while rest:
        i, j, a, b = rest.pop()
        pairs = [(i + x, j + y) for x, y in in_order(labels[i:a], wanted[j:b])]
        found.update(pairs)
        if pairs:
            rest += gaps(i, j, pairs, a, b)
    out, gap = [], 0
    for i in range(len(children)):
        if i in found:
            gap = found[i] + 1
        out.append((found[i], True) if i in found else (gap, False))
    return out


def pattern_of(e: Element) -> dict:
    """The wrapper whose slots s are the page's elements, that no page has been aligned with yet; d is the hash of all texts in a slot."""
    return {"l": e.label, "n": 0, "q": "", "c": 0, "k": 0, "t": None, "d": whole_hash(e), "s": [pattern_of(c) for c in children_of(e)], "g": {}}


def characters(e: Element) -> list[int]:
    """The element's own characters outside and inside of links."""
    n = [0, 0]
    for i in e.items:
        if type(i) is tuple:
            n[i[1]] += len(i[0].strip())
    return n


def absorb(w: dict, e: Element) -> None:
    """Align one more page with the wrapper, which takes it up."""
    own = text_hash(e)
    free, linked = characters(e)
    w["n"] += 1
    w["c"] += free
    w["k"] += linked
    w["t"] = own if w["t"] in (None, own) else ""
    children = children_of(e)
    if not children:
        return
    groups: dict[str, dict] = {}
    for child, (at, has_slot) in zip(children, align(children, w["s"]), strict=True):
        if has_slot:
            absorb(w["s"][at], child)
        else:
            key, group = group_key(w, at, child.label), wrapper_of(child)
            groups[key] = merged(groups[key], group, max) | {"q": "+"} if key in groups else group
    for key, group in groups.items():
        w["g"][key] = merged(w["g"][key], group) if key in w["g"] else group


def group_key(w: dict, gap: int, label: str) -> str:
    """Groups are told apart by their gap and label; within a group, which has no slots, by label."""
    return f"{gap} {label}" if w["s"] else label


def wrapper_of(e: Element) -> dict:
    """The element as a group: label l, pages n, repeated or not q, characters c outside and k inside links, template text's hash t, no slots s, groups g by label."""
    free, linked = characters(e)
    w = {"l": e.label, "n": 1, "q": "", "c": free, "k": linked, "t": text_hash(e), "s": [], "g": {}}
    for child in children_of(e):
        own = wrapper_of(child)
        w["g"][child.label] = merged(w["g"][child.label], own, max) | {"q": "+"} if child.label in w["g"] else own
    return w


def merged(a: dict, b: dict, pages=sum) -> dict:
    """The wrapper of what either fits, both of one pattern; ``pages`` is max for two groups of one page. Groups that only one has are optional."""
    groups = dict(a["g"])
    for label, g in b["g"].items():
        groups[label] = merged(groups[label], g, pages) if label in groups else g
    text = a["t"] if b["t"] in (None, a["t"]) else b["t"] if a["t"] is None else ""
    slots = [merged(x, y, pages) for x, y in zip(a["s"], b["s"], strict=True)]
    return a | {"n": pages((a["n"], b["n"])), "q": max(a["q"], b["q"]), "c": a["c"] + b["c"], "k": a["k"] + b["k"], "t": text, "s": slots, "g": groups}


def parts(w: dict) -> list[dict]:
    return [*w["s"], *w["g"].values()]


def is_aside(label: str) -> bool:
    name, *words = label.split(" ")
    if name in ("article", "main", "body", "html") and not set(words) & {"comment", "comments", "ad", "ads", "advert", "sponsored", "promo", "related"}:
        return "hidden" in words
    return name in ASIDE or name in NO_TEXT or name == "header" or bool(set(words) & ASIDE_WORDS) or "hidden" in words


def is_soft(label: str) -> bool:
    """Asides that are told by their words alone, or by a name that may also stand around a page's main part."""
    name, *words = label.split(" ")
    return is_aside(label) and name not in NO_TEXT and name not in ASIDE - {"form"} and "hidden" not in words


def holders(wrapper: dict) -> frozenset:
    """Labels of asides that hold the host's main part, so that they are none: an article or main element and half of the
    text, or nearly all text."""
    soft: list[tuple] = []

    def visit(w: dict) -> tuple[int, bool]:
        if is_aside(w["l"]) and not is_soft(w["l"]):
            return 0, False
        inside = [visit(g) for g in parts(w)]
        chars = w["c"] + sum(c for c, _ in inside)
        main = any(m for _, m in inside)
        if is_soft(w["l"]):
            soft.append((w["l"], chars, main))
        return chars, main or (w["l"].split(" ")[0] in ("article", "main") and not is_aside(w["l"]))

    total, _ = visit(wrapper)
    return frozenset(label for label, chars, main in soft if total and (chars * 2 >= total and main or chars * 10 >= 9 * total))


def is_named(label: str) -> bool:
    name, *words = label.split(" ")
    return name in ("article", "main") or bool(set(words) & MAIN_WORDS)


def main_label(wrapper: dict, holding: frozenset = frozenset()) -> str:
    """The label of the wrapper's main part: what holds most of the slots' free text; named as an article or else the deepest."""

    def choose(free) -> str:
        sums: dict[str, int] = {}
        depths: dict[str, int] = {}

        def visit(w: dict, depth: int) -> int:
            if is_aside(w["l"]) and w["l"] not in holding:
                return 0
            held = free(w) + sum(visit(g, depth + 1) for g in parts(w))
            if w["l"] != "flow":
                sums[w["l"]] = sums.get(w["l"], 0) + held
                depths[w["l"]] = max(depth, depths.get(w["l"], 0))
            return held

        total = visit(wrapper, 0)
        if not total:
            return ""
        named = [lambda x: x.split(" ")[0] == "article", lambda x: x.split(" ")[0] == "main", lambda x: bool(set(x.split(" ")[1:]) & MAIN_WORDS)]
        with_share = lambda tenths: [x for x in sums if sums[x] * 10 >= tenths * total]
        for tenths in (8, 1):
            for test in named:
                if found := [x for x in with_share(tenths) if test(x)]:
                    return max(found, key=lambda x: (sums[x], x))
        return max(with_share(8), key=lambda x: (depths[x], sums[x], x), default=wrapper["l"])

    return choose(lambda w: 0 if w["template"] else w["c"]) or choose(lambda w: w["c"]) or wrapper["l"]


def settle(w: dict, pages: int, beside: bool = False) -> None:
    """Note in all parts of a host's wrapper whether they are template: the text is the same wherever the element is, on enough
    of the host's pages. A paragraph or item ``beside`` others is prose, and what all articles say in one is theirs."""
    part, whole = TEMPLATE_SHARE
    same = bool(w["t"]) and w["q"] != "+" and not parts(w)
    w["template"] = same and w["n"] >= 2 and w["n"] * whole >= part * pages and not (beside and w["l"] == "flow")
    flow = [p for p in parts(w) if p["l"] == "flow"]
    for p in parts(w):
        settle(p, pages, len(flow) > 1 or any(f["q"] for f in flow))


def copies(wrapper: dict, label: str, holding: frozenset = frozenset()) -> bool:
    """Whether texts that all pages have are most of the main part's: then they are its article."""
    same = other = 0

    def visit(w: dict, within: bool) -> None:
        nonlocal same, other
        if is_aside(w["l"]) and w["l"] not in holding:
            return
        within = within or w["l"] == label
        if within and w["template"]:
            same += w["c"]
        elif within:
            other += w["c"]
        for g in parts(w):
            visit(g, within)

    visit(wrapper, False)
    return same > other


def main_text(page: Element, wrapper: dict) -> str:
    """The page's main text by its host's wrapper."""
    if "main" not in wrapper:  # decided once for a wrapper
        settle(wrapper, wrapper["n"])
        holding = holders(wrapper)
        label = main_label(wrapper, holding)
        wrapper["main"] = holding, label, copies(wrapper, label, holding)
    holding, label, whole = wrapper["main"]
    for root in (label, page.label):
        blocks: list[tuple[str, bool]] = []
        current: list[str] = []
        template = [False]

        def close() -> None:
            text = " ".join(html.unescape("".join(current)).split())
            if text:
                blocks.append((text, template[0]))
            current.clear()

        def take(e: Element, w: dict | None, within: bool) -> None:
            if is_aside(e.label) and e.label not in holding and not (within and e.name == "header" and not e.words & ASIDE_WORDS - {"header"}):
                return  # a header within the main part has its title
            within = within or e.label == root
            children = children_of(e)
            fixed = not whole and bool(w) and not children and w["template"] and text_hash(e) == w["t"]
            fits = iter([w["s"][at] if has_slot else w["g"].get(group_key(w, at, c.label)) for c, (at, has_slot) in zip(children, align(children, w["s"]), strict=True)] if w else [None] * len(children))
            for item in e.items:
                if isinstance(item, Element):
                    close()
                    take(item, next(fits), within)
                    close()
                elif within and item is None:
                    close()
                elif within:
                    template[0] = fixed
                    current.append(item[0])

        take(page, wrapper, False)
        close()
        if blocks:
            break
    # What is named as the main part is whole; only what is taken for it without a name may have menus or imprints in it.
    free = [t for t, fixed in blocks if not fixed or (root == label and is_named(label))]
    return "\n".join(free or [t for t, _ in blocks])


def with_host(pages: DataFrame, table: DataFrame, deal_by: list[str]) -> DataFrame:
    """pages joined with a written table of one row for each host: broadcast if that is small, else over salts."""
    size = table.agg(F.coalesce(F.sum(sum(F.octet_length(c) for c in table.columns)), F.lit(0))).first()[0]
    if size <= MAX_BROADCAST_BYTES:
        return pages.join(F.broadcast(table), "host")
    return pages.withColumn("salt", F.pmod(F.xxhash64(*deal_by), F.lit(SALTS))).join(salted(table), ["host", "salt"])


def patterns(pages: DataFrame) -> DataFrame:
    """(host, pattern as JSON): of each host's pages that have any text the one of the least hash."""
    keyed = pages.where(F.length("html") > 0).select("host", "html", F.xxhash64("html").alias("code"))
    least = materialised(keyed.groupBy("host").agg(F.min("code").cast("string").alias("least")))
    # Copies of that page are one row of each task before they are shuffled.
    chosen = with_host(keyed, least, ["code"]).where(F.col("code").cast("string") == F.col("least")).groupBy("host").agg(F.min("html").alias("html"))

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch.column(1)):
                out = [json.dumps(pattern_of(parse(text))) for text in texts]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, len(texts)), pa.array(out, pa.string())], ["host", "pattern"])

    return materialised(chosen.select("host", "html").mapInArrow(run, "host string, pattern string"))


def infer(pages: DataFrame) -> DataFrame:
    """(host, wrapper as JSON) of pages with columns host and html, for hosts that have any text."""

    def fold(batches):
        held: dict[str, dict] = {}
        emit = lambda: pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([json.dumps(w, sort_keys=True) for w in held.values()])], ["host", "wrapper"])
        for batch in batches:
            for part, texts in slices(batch.column(1)):
                rows = batch.slice(part.start, len(texts))
                for host, text, pattern in zip(rows.column(0).to_pylist(), texts, rows.column(2), strict=True):
                    if host not in held:
                        held[host] = json.loads(pattern.as_py())
                    absorb(held[host], parse(text))
                if len(held) > HOSTS:
                    yield emit()
                    held.clear()
        if held:
            yield emit()

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        out = None
        for text in frame.wrapper:
            w = json.loads(text)
            out = w if out is None else merged(out, w)
        return pd.DataFrame({"host": [frame.host.iloc[0]], "wrapper": [json.dumps(out, sort_keys=True)]})

    partial = with_host(pages.select("host", "html"), patterns(pages), ["html"]).select("host", "html", "pattern").mapInArrow(fold, "host string, wrapper string")
    salt = F.pmod(F.xxhash64("wrapper"), F.lit(SALTS))
    some = partial.withColumn("salt", salt).groupBy("host", "salt").applyInPandas(merge, "host string, wrapper string")
    return some.groupBy("host").applyInPandas(merge, "host string, wrapper string")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url and text of every page."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), split_url(F.col(url_col))[0].alias("host"))
    full = F.length("html") > 0
    both = with_host(source.where(full), materialised(infer(source.where(full))), ["page_id", "url"])

    def run(batches):
        cache: dict[str, dict] = {}
        for batch in batches:
            for part, texts in slices(batch.column(2)):
                out = []
                rows = batch.slice(part.start, len(texts))
                for text, host, wrapper in zip(texts, rows.column(3).to_pylist(), rows.column(4), strict=True):
                    if host not in cache:
                        if len(cache) >= HOSTS:
                            cache.clear()
                        cache[host] = json.loads(wrapper.as_py())
                    out.append(main_text(parse(text), cache[host]))
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])

    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    texts = both.select("page_id", "url", "html", "host", "wrapper").mapInArrow(run, f"page_id {types['page_id']}, url {types['url']}, text string")
    return texts.unionByName(source.where(~full).select("page_id", "url", F.lit("").alias("text")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
