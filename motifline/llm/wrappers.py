"""Main text of web pages by wrappers: union-free regular expressions over tags.

Each page becomes a tree of block tags. Runs of like siblings become one repeated
group, so few different trees remain per host; these are counted, and then aligned
pairwise: a tag that one tree lacks becomes optional, tags in differing order
become a repeated group of optional tags, text becomes a slot. The wrapper of a
host says which slots are its main text; its pages are read by it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifline.plans.blocks import stage

# Elements of HTML by their role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
RAW = "script style textarea title xmp iframe noembed noframes"
SKIPPED = set(
    "head script style noscript template nav header footer aside form button select option textarea input iframe object embed svg canvas audio video map menu dialog title xmp noembed noframes".split()
)
CLOSES_P = set(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
# Words in class, id and role that name what isn't main text, and what is.
ASIDE = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs sidebar aside widget footer header masthead share sharing social comments comment commentlist discussion replies reply responses disqus related recommended recommendations newsletter subscribe subscription signup login paywall toolbar pagination pager skip complementary contentinfo search tags author-box copyright disclaimer".split()
)
MAIN = set("content main post entry story article-body post-body entry-content post-content main-content article-content body-text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + RAW.replace(" ", "|") + r""")\b(?:"[^"]*"|'[^']*'|[^'">])*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>|<[!?/][^>]*>""",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"\bhidden(?=[\s/=>]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)


def label(tag: str, attributes: str) -> str:
    """A tag with the words of its class, id and role; words with digits are particular to a page and left out."""
    if not attributes or "=" not in attributes:
        return f"{tag}.hidden" if attributes and HIDDEN.search(attributes) else tag
    words = {w for m in NAMED.finditer(attributes) for w in (m[2] or m[3] or m[4] or "").lower().split() if not re.search(r"\d", w)}
    if HIDDEN.search(attributes):
        words.add("hidden")
    return ".".join([tag, *sorted(words)])


def skipped(name: str) -> bool:
    """Does a label name something beside the main text?"""
    tag, *words = name.split(".")
    if tag in SKIPPED or "hidden" in words:
        return True
    if tag in ("html", "body", "main", "article"):
        return False
    return any(w in ASIDE or ASIDE.intersection(re.split(r"[-_]+", w)) and w not in MAIN for w in words)


def events(html: str) -> Iterator[tuple[str, str]]:
    """("open", label), ("close", ""), ("text", raw text) of a page, well nested.

    End tags that authors may leave out are put in; an end tag without a start is
    dropped. Inline tags are left out; a line break is white space.
    """
    stack: list[tuple[str, bool]] = []
    at = 0

    def close_to(depth: int) -> Iterator[tuple[str, str]]:
        while len(stack) > depth:
            if stack.pop()[1]:
                yield "close", ""

    def last(tags, until=()) -> int:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                return i
            if stack[i][0] in until:
                return -1
        return -1

    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield "text", html[at : m.start()]
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag in VOID:
                continue
            i = last((tag,), () if tag not in INLINE else CLOSES_P | set(SIBLINGS))
            if i >= 0:
                yield from close_to(i)
            continue
        if tag == "br":
            yield "text", "\n"
        if tag in CLOSES_P and (i := last(("p",), ("table", "td", "th", "li", "div", "article", "section", "body"))) >= 0:
            yield from close_to(i)
        if tag in SIBLINGS and (i := last(SIBLINGS[tag][0].split(), SIBLINGS[tag][1].split())) >= 0:
            yield from close_to(i)
        if tag in INLINE or tag in VOID and tag != "hr":
            aside = tag in INLINE and m[4] and skipped(name := label(tag, m[4]))
            if tag in INLINE and not m[4].endswith("/"):
                stack.append((tag, bool(aside)))
                if aside:
                    yield "open", name
            continue
        yield "open", label(tag, m[4])
        if tag == "hr":
            yield "close", ""
        else:
            stack.append((tag, True))
    if at < len(html):
        yield "text", html[at:]
    yield from close_to(0)


# A node is [label, optional, repeated, text length, groups]; a group is [repeated, nodes] and no label comes twice among the nodes of all groups.


def _squash(nodes: list) -> list:
    """Groups of a list of child nodes in page order: from the first to the last node of one label, all are one repeated group."""
    groups: list = []
    for n in nodes:
        hit = next((i for i, g in enumerate(groups) if any(x[0] == n[0] for x in g[1])), None)
        if hit is None:
            groups.append([False, [n]])
            continue
        inside = [x for g in groups[hit:] for x in g[1]]
        if hit == len(groups) - 1 and len(inside) == 1:
            inside[0] = join(inside[0], n)
            inside[0][2] = True
            groups[hit:] = [[False, inside]]
        else:
            inside = [join(x, n) if x[0] == n[0] else x for x in inside]
            for x in inside:
                x[1] = True
            groups[hit:] = [[True, inside]]
    return groups


def join(a: list, b: list) -> list:
    """The least wrapper node that covers two nodes of one label."""
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], align(a[4], b[4])]


def align(a: list, b: list) -> list:
    """Align two lists of groups: what both have is joined, what one lacks is optional."""
    places = {n[0]: (i, n) for i, g in enumerate(b) for n in g[1]}
    out, done, at = [], set(), 0
    for g in a:
        met = [places[n[0]][0] for n in g[1] if n[0] in places]
        if met and min(met) < at:
            return _mixed(a, b)
        for i in range(at, min(met, default=at)):
            out.append([b[i][0], [_optional(n) for n in b[i][1]]])
        wide = range(min(met), max(met) + 1) if met else ()
        inside = {n[0]: (join(n, places[n[0]][1]) if n[0] in places and places[n[0]][0] in wide else _optional(n)) for n in g[1]}
        for i in wide:
            for n in b[i][1]:
                inside.setdefault(n[0], _optional(n))
        at = max(met) + 1 if met else at
        repeated = g[0] or any(b[i][0] for i in wide) or len(wide) > 1
        if len(inside) > len(g[1]) and not repeated:
            repeated = True
        out.append([repeated, list(inside.values())])
        if len(done | set(inside)) < len(done) + len(inside):
            return _mixed(a, b)
        done |= set(inside)
    for i in range(at, len(b)):
        out.append([b[i][0], [_optional(n) for n in b[i][1]]])
    labels = [n[0] for g in out for n in g[1]]
    return out if len(labels) == len(set(labels)) else _mixed(a, b)


def _optional(n: list) -> list:
    return [n[0], True, *n[2:]]


def _mixed(a: list, b: list) -> list:
    """Orders differ: one repeated group of optional nodes."""
    nodes: dict[str, list] = {}
    for g in [*a, *b]:
        for n in g[1]:
            nodes[n[0]] = _optional(join(nodes[n[0]], n) if n[0] in nodes else n)
    return [[True, list(nodes.values())]]


def page_tree(html: str) -> list:
    """The wrapper of a single page."""
    root: list = ["", False, False, 0, []]
    stack = [(root, [])]
    for kind, value in events(html):
        if kind == "open":
            stack.append(([value, False, False, 0, []], []))
        elif kind == "close":
            node, children = stack.pop()
            node[4] = _squash(children)
            stack[-1][1].append(node)
        elif value.strip():
            stack[-1][0][3] += len(value)
    root[4] = _squash(stack[0][1])
    return root


def expression(node: list) -> str:
    """A wrapper as text: ? optional, + repeated, # a text slot."""
    inner = ("#" if node[3] else "") + "".join(
        f"({''.join(map(expression, g[1]))})+" if g[0] else "".join(map(expression, g[1])) for g in node[4]
    )
    return f"<{node[0]}>{inner}</>" + ("+" if node[2] else "") + ("?" if node[1] else "")


def _mass(node: list) -> int:
    return 0 if skipped(node[0]) else node[3] + sum(_mass(n) for g in node[4] for n in g[1])


def main_paths(wrapper: list) -> list[str]:
    """Paths of the nodes whose slots are main text: article, else main, else a node named
    so by its class, else the body; of several the one with most text, and its like-named siblings."""
    found: dict[int, list[tuple[int, str]]] = {}

    def walk(node: list, path: str) -> None:
        tag, *words = node[0].split(".")
        rank = 0 if tag == "article" else 1 if tag == "main" or "main" in words else 2 if MAIN.intersection(words) else 3 if tag == "body" else 4
        if mass := _mass(node):
            found.setdefault(rank, []).append((mass, path))
        for g in node[4]:
            for n in g[1]:
                if not skipped(n[0]):
                    walk(n, f"{path}/{n[0]}")

    walk(wrapper, "")
    for rank in sorted(found):
        best = max(found[rank], key=lambda x: (x[0], -len(x[1])))[1]
        tag = best.rpartition("/")[2].split(".")[0]
        parent = best.rpartition("/")[0]
        return [best] + [p for _, p in found[rank] if p != best and p.rpartition("/")[0] == parent and p.rpartition("/")[2].split(".")[0] == tag]
    return []


def read_by(html: str, paths: set[str]) -> str | None:
    """Blocks of text under one of `paths`; None if the page has none of them."""
    path, inside, out = [""], 0, []
    block: list[str] = []
    beside = 0
    met = "" in paths
    depth: list[tuple[bool, bool]] = [(met, False)]
    inside += met

    def end() -> None:
        if block:
            text = " ".join(unescape("".join(block)).split())
            if text:
                out.append(text)
            block.clear()

    for kind, value in events(html):
        if kind == "text":
            if inside and not beside:
                block.append(value)
            continue
        if kind == "open":
            inline = value.split(".")[0] in INLINE
            if not inline:
                end()
            path.append(f"{path[-1]}/{value}")
            main = path[-1] in paths and not beside
            aside = skipped(value)
            met |= main
            inside += main
            beside += aside
            depth.append((main, aside))
        else:
            if path[-1].rpartition("/")[2].split(".")[0] not in INLINE:
                end()
            path.pop()
            main, aside = depth.pop()
            inside -= main
            beside -= aside
    end()
    return "\n".join(out) if met else None


HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)"


def host_of(url) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def wrappers(pages: DataFrame, salts: int = 64) -> DataFrame:
    """One row per host: its wrapper as JSON, its main paths, the number of pages.

    Pages are reduced to trees and equal trees counted before the shuffle. A host's
    trees are joined in `salts` groups first, so no task sees a whole host.
    """

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: dict[tuple[str, str], int] = {}
            for host, html in zip(*[c.to_pylist() for c in b.columns], strict=True):
                tree = page_tree(html or "")
                _coarse(tree)
                key = host, json.dumps(tree)
                made[key] = made.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in made], pa.string()), pa.array([k[1] for k in made], pa.string()), pa.array(list(made.values()), pa.int64())],
                names=["host", "tree", "pages"],
            )

    def merged(frame: pd.DataFrame) -> pd.DataFrame:
        whole, seen = None, set()
        for tree in sorted(frame["tree"]):
            if tree not in seen:
                seen.add(tree)
                whole = json.loads(tree) if whole is None else join(whole, json.loads(tree))
        _coarse(whole)
        return pd.DataFrame({"host": frame["host"].iloc[:1], "tree": json.dumps(whole), "pages": frame["pages"].sum()})

    schema = "host string, tree string, pages long"
    counted = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(trees, schema).groupBy("host", "tree").agg(F.sum("pages").alias("pages"))
    part = counted.withColumn("_salt", F.pmod(F.xxhash64("tree"), F.lit(salts)))
    partial = part.groupBy("host", "_salt").applyInPandas(lambda key, f: merged(f), schema)
    return partial.groupBy("host").applyInPandas(merged, schema)


def _coarse(node: list) -> None:
    """Text lengths to powers of two, so that like pages give equal trees."""
    node[3] = 1 << node[3].bit_length() if node[3] else 0
    for g in node[4]:
        for n in g[1]:
            _coarse(n)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: main text of every page, read by its host's wrapper.

    A page on which the wrapper finds none of its nodes is read by a wrapper of its
    own. Null or empty html gives an empty text, a null url belongs to the host ''.
    Repeated rows are read alike; other columns don't matter.
    """
    found = stage(wrappers(pages).select("host", "tree"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, set[str]] = {}
        for b in batches:
            texts = []
            for html, tree in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if len(known) > 10_000:
                    known.clear()
                if tree not in known:
                    known[tree] = set(main_paths(json.loads(tree)))
                text = read_by(html or "", known[tree])
                texts.append(read_by(html or "", set(main_paths(page_tree(html or "")))) or "" if text is None else text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    rows = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    with_wrapper = rows.join(found, "host").select("page_id", "url", "html", "tree")
    return with_wrapper.mapInArrow(task, "page_id long, url string, text string, n_chars long")
