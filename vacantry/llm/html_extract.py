"""Main text of web pages by union-free wrapper inference.

A page's stream of block tags and texts becomes a skeleton, in which neighbours
that begin alike are a repeated group and texts are slots. The distinct skeletons
of a host are aligned one after the other into the host's wrapper: what differs
becomes optional or joins a repeated group. Counts of texts by place tell which
texts never change.

The wrapper chooses where a host's article stands: in its ``article`` element (else
``main``; of several, the one that is no repeated group and holds most text, so that
teasers stay out), and on pages with neither in the innermost part that holds most of
the changing text. That part is no repeated group, or a group of which one element
holds nearly all: then the largest of a page's elements is its article. There, texts
that never change and places of links are left out. Menus, notices and other parts
that are marked as such by their tag, role, class or id are left out everywhere; these
words are a fixed list, and a name such as ``share-price`` or ``commentary`` is none.

Skeletons are counted by Spark and merged in a tree whose groups follow from their
content, so the result does not depend on how rows are dealt to tasks.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|template|iframe|noembed|noframes|xmp|svg|math|textarea|title)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<",
    re.S | re.I,
)
TAG = re.compile(r"</?([a-zA-Z][a-zA-Z0-9:-]*)")
#: A name begins where none goes on, so that a long run of other characters is read once.
ATTRIBUTE = re.compile(r"(?<![^\s\"'/=])([^\s\"'>/=]++)(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that run within a line of text; all others begin a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An opening tag ends these when they are open with nothing but their own content since.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "body": {"head"}}
SCOPES = frozenset("ul ol dl table div article section main body".split())
ASIDE_TAGS = frozenset("head nav footer aside form button select noscript menu dialog".split())
ASIDE_ROLES = frozenset("navigation banner complementary contentinfo search alert alertdialog dialog form menu menubar toolbar".split())
#: Words in class or id that mark what is not the article.
ASIDE_WORDS = re.compile(
    r"ads?|nav|menus?|side|foot|header|masthead|banner|notices?|alerts?|popup|modal|overlay|signup|login|search|pager|widgets?|toolbar|copyright|disclaimer|disqus|repl(?:y|ies)|respond"
    r"|advert\w*|comments?|sidebars?|footers?|navig\w*|navbar\w*|breadcrumbs?|cookies?|consent|promo(?:s|ted|tions?|tional)?|sponsor(?:s|ed|ship)?|newsletters?|subscri\w*|social|shar(?:e|es|ing|er)"
    r"|related|recommend(?:ed|ations?)?|paginat(?:ion|or)"
)
#: Words that may stand beside those in one name and don't change what it marks.
PLAIN_WORDS = frozenset("area author bar block body bottom box btn button buttons column container content count form group icons inner item items left link links list panel popup right row section slot text thread top unit wrap wrapper".split())
#: Elements of an article's text, which are no part of a layout.
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd blockquote pre figure figcaption table caption thead tbody tfoot tr td th details summary address hgroup".split())
#: A wrapper of more nodes than this forgets their order; no text or place is lost by it.
LARGE = 1500
#: Of a repeated group one element is the article if it holds this share of the group's text over all pages.
LEADS = 0.8
#: Groups in which a host's skeletons meet before its wrapper is made of them.
SALTS = 256
#: Rows and rules that a task holds at once; hosts of a broadcast rule table in bytes; salts of the rows that meet a larger one.
HELD, BROADCAST_BYTES, RULE_SALTS = 20_000, 4 << 20, 16
#: Tags up to this length have their signature cached; all are read whole.
KNOWN_CHARS = 400


def signature(tag_text: str) -> tuple[str, str]:
    """Tag name and signature ``name.words``; ``!`` marks what is not the article. Only short tags are remembered."""
    return known_signature(tag_text) if len(tag_text) <= KNOWN_CHARS else read_signature(tag_text)


def read_signature(tag_text: str) -> tuple[str, str]:
    name = TAG.match(tag_text)[1].lower()
    words, marked, aside = [], False, name in ASIDE_TAGS
    for m in ATTRIBUTE.finditer(tag_text[TAG.match(tag_text).end() :]):
        key, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if key in ("class", "id") and name not in ("html", "body"):  # those tell the page, not the layout
            words += [w for w in re.split(r"[^a-z]+", value) if w]
            marked |= any(marks(token) for token in value.split())
        elif key == "role":
            aside |= value in ASIDE_ROLES
        elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
            aside = True
    if name not in ("article", "main") or "comment" in words or "comments" in words:
        aside |= marked
    return name, name + "".join("." + w for w in sorted(set(words))) + "!" * aside


def marks(name: str) -> bool:
    """Whether a class or id marks what is not the article: each of its words does so, or changes nothing."""
    words = [w for w in re.split(r"[^a-z]+", name) if w]
    found = [bool(ASIDE_WORDS.fullmatch(w)) for w in words]
    return any(found) and all(f or w in PLAIN_WORDS for f, w in zip(found, words))


known_signature = lru_cache(maxsize=4096)(read_signature)


def stream(page: str) -> Iterator[tuple[str, object]]:
    """Balanced events: ("open", signature), ("close", None), ("text", (string, characters in links))."""
    stack: list[tuple[str, str]] = []  # open blocks
    run: list[str] = []
    links, in_link = 0, 0
    skipping, inside = "", defaultdict(int)  # a marked inline element, and what opened within it

    def flush():
        nonlocal run, links
        text = " ".join(entities.unescape("".join(run)).split())
        run, found, links = [], links, 0
        return [("text", (text, min(found, len(text))))] if text else []

    for m in TOKEN.finditer(page):
        token = m[0]
        if token[0] != "<" or token == "<":
            if skipping:
                continue
            run.append(token)
            links += len(token.strip()) if in_link else 0
            continue
        if m[1] or token[1] in "!?":
            continue
        name, sig = signature(token)
        closing = token[1] == "/"
        if skipping:  # up to its end, or that of a block around it
            if not closing:
                inside[name] += name not in VOID
                continue
            if inside[name]:
                inside[name] -= 1
                continue
            if name != skipping and not any(n == name for n, _ in stack):
                continue
            ended, skipping = name == skipping, ""
            inside.clear()
            if ended:
                continue
        if name in INLINE:
            if name == "a":
                in_link = not closing
            elif name == "br":
                run.append(" ")
            if sig[-1] == "!" and not closing and name not in VOID:
                skipping, in_link = name, 0
                run.append(" ")
            continue
        if name in VOID:
            yield from flush()
            continue
        if closing:
            yield from flush()
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if name == "p" and at is not None and any(n in SCOPES for n, _ in stack[at + 1 :]):
                at = None
            if at is not None:
                in_link = 0
                for _ in range(len(stack) - at):
                    stack.pop()
                    yield "close", None
            continue
        yield from flush()
        if stack and stack[-1][0] == "p":  # a block ends an open paragraph
            stack.pop()
            yield "close", None
        ends = ENDS.get(name, ())
        while stack and stack[-1][0] in ends:
            stack.pop()
            yield "close", None
        in_link = 0
        stack.append((name, sig))
        yield "open", sig
    yield from flush()
    for _ in stack:
        yield "close", None


# A wrapper is a list of [node, optional]. A node is a string, or a list (the wrapper of a
# repeated group). Strings: "<sig" opens, ">" closes, "#" is the slot of a text.


def key(node) -> str:
    """What alignment compares: groups are alike if they begin alike."""
    return "+" + key(node[0][0]) if isinstance(node, list) else node


def merged_node(a, b):
    return merged(a, b) if isinstance(a, list) else a


def grouped(nodes: list, units: set[str]) -> list:
    """Write what a group of the other side repeats as a group here, though it stands once."""
    out, k = [], 0
    while k < len(nodes):
        node = nodes[k][0]
        if isinstance(node, str) and node[0] == "<" and node in units:
            depth, end = 0, k
            while end < len(nodes):
                n = nodes[end][0]
                depth += 0 if isinstance(n, list) else (n[0] == "<") - (n == ">")
                end += 1
                if depth == 0:
                    break
            out.append([[[n, o and i > 0] for i, (n, o) in enumerate(nodes[k:end])], nodes[k][1]])
            k = end
        else:
            out.append(nodes[k])
            k += 1
    return out


def heads(nodes: list) -> set[str]:
    return {n[0][0] for n, _ in nodes if isinstance(n, list) and isinstance(n[0][0], str)}


def merged(a: list, b: list) -> list:
    """The wrapper of both: aligned nodes stay, all others become optional."""
    if a == b:
        return a
    units = heads(a) | heads(b)
    if units:
        a, b = grouped(a, units), grouped(b, units)
    out = []
    for op, a1, a2, b1, b2 in SequenceMatcher(None, [key(n) for n, _ in a], [key(n) for n, _ in b], autojunk=False).get_opcodes():
        if op == "equal":
            out += [[merged_node(x, y), p or q] for (x, p), (y, q) in zip(a[a1:a2], b[b1:b2])]
        else:
            out += [[n, True] for n, _ in a[a1:a2] + b[b1:b2]]
    out = folded(out)
    return generalised(out) if len(out) > LARGE else out


def folded(nodes: list) -> list:
    """Neighbouring groups that begin alike become one."""
    out: list = []
    for node, optional in nodes:
        if out and isinstance(node, list) and isinstance(out[-1][0], list) and key(node) == key(out[-1][0]):
            out[-1] = [merged(out[-1][0], node), out[-1][1] and optional]
        else:
            out.append([node, optional])
    return out


def elements(nodes: list) -> Iterator[list]:
    """The balanced parts of a wrapper, one after the other; what was forgotten before falls apart again."""
    own, depth = [], 0
    for node, optional in nodes:
        if not own and isinstance(node, list) and node[0][0] == "*":
            yield from elements(node[1:])
            continue
        own.append([node, optional])
        depth += 0 if isinstance(node, list) else (node[0] == "<") - (node == ">")
        if depth <= 0:
            yield own
            own, depth = [], 0
    if own:
        yield own


def generalised(nodes: list) -> list:
    """A group (marked ``*``) of the distinct elements, each optional, which any order of them matches; what is nested stays nested."""
    alike: dict[str, list[list]] = {}
    for part in elements(nodes):
        alike.setdefault(key(part[0][0]), []).append(part)
    out = [["*", False]]
    for k, parts in alike.items():
        if k[0] == "<":
            inner = [n for part in parts for n in part[1:-1]]
            out += [[k, True], *(generalised(inner) if len(parts) > 1 or len(inner) > LARGE else inner), [">", True]]
        else:
            node = parts[0][0][0]
            for part in parts[1:]:
                node = merged_node(node, part[0][0])
            out.append([node, True])
    return [[out, False]]


def skeleton(events: list[tuple[str, object]]) -> list:
    """A page's own wrapper: neighbouring elements that begin alike are one group."""
    root: list = []
    levels = [root]
    for kind, what in events:
        if kind == "text":
            levels[-1].append(["#", False])
        elif kind == "open":
            levels.append([["<" + what, False]])
        else:
            own = levels.pop()
            own.append([">", False])
            above = levels[-1]
            if above and isinstance(above[-1][0], list) and key(above[-1][0]) == "+" + own[0][0]:
                above[-1] = [merged(above[-1][0], own), False]
                continue
            start, depth = len(above), 0
            while start > 0:  # does the element before this one begin alike?
                n = above[start - 1][0]
                if isinstance(n, list):
                    break
                depth += (n == ">") - (n[0] == "<")
                start -= 1
                if depth <= 0:
                    break
            before = above[start:] if above and above[-1][0] == ">" else []
            if before and before[0][0] == own[0][0]:
                above[start:] = [[merged(before, own), False]]
            else:
                above.extend(own)
    return root


def page_wrapper(page: str) -> list:
    return skeleton(list(stream(page)))


def repeated(nodes: list, path: tuple[str, ...] = ()) -> Iterator[str]:
    """The paths of the elements that a wrapper repeats."""
    stack = list(path)
    for node, _ in nodes:
        if isinstance(node, list):
            if isinstance(node[0][0], str) and node[0][0][0] == "<":
                yield " ".join([*stack, node[0][0][1:]])
            yield from repeated(node[1:] if node[0][0] == "*" else node, tuple(stack))
        elif node[0] == "<":
            stack.append(node[1:])
        elif node == ">":
            stack.pop()


def tag(sig: str) -> str:
    return sig.rstrip("!").split(".")[0]


class Found(NamedTuple):
    """A text that no mark leaves out: the path of its block, the outermost ``article`` (else ``main``) element around it
    and that element's path, the text, how many of its characters are links, and the block's place among its siblings on each level."""

    path: str
    within: str
    holder: str
    text: str
    links: int
    spot: tuple[int, ...]


def places(events: list[tuple[str, object]]) -> Iterator[Found]:
    """The texts of a page. A header within an article is part of it."""
    stack: list[tuple[str, bool, str, str, tuple[int, ...]]] = [("", False, "", "", ())]
    children = [0]
    for kind, what in events:
        if kind == "text":
            path, out, within, holder, spot = stack[-1]
            if not out:
                yield Found(path, within, holder, *what, spot)
        elif kind == "open":
            path, out, within, holder, spot = stack[-1]
            name, own = tag(what), f"{path} {what}" if path else what
            out = out or what[-1] == "!" or name == "header" and not within
            if name == "article" and within != "article" or name == "main" and not within:
                within, holder = name, own
            stack.append((own, out, within, holder, (*spot, children[-1])))
            children[-1] += 1
            children.append(0)
        else:
            stack.pop()
            children.pop()


def instances(found: list[Found]) -> dict[str, dict[tuple[int, ...], int]]:
    """Characters outside links of each element of a layout, by path and place."""
    out: dict[str, dict[tuple[int, ...], int]] = defaultdict(lambda: defaultdict(int))
    for f in found:
        steps = f.path.split()
        for k in range(1, len(steps) + 1):
            if tag(steps[k - 1]) in TEXT_TAGS:
                break
            out[" ".join(steps[:k])][f.spot[:k]] += len(f.text) - f.links
    return out


def text_key(path: str, text: str) -> str:
    return xxhash.xxh3_128_hexdigest(f"{path}\n{text}".encode("utf-8", "surrogatepass"))


def chosen_articles(chars: dict[str, int], groups: set[str]) -> list[str]:
    """Of the paths of ``article`` elements those that hold articles: what is repeated, or holds less than half of the most, is a teaser beside a story."""
    single = {p: n for p, n in chars.items() if p not in groups}
    most = max(single.values(), default=0)
    if any(n > most for n in chars.values()):  # a page of many articles
        return sorted(p for p, n in chars.items() if 2 * n >= max(chars.values()))
    return sorted(p for p, n in single.items() if 2 * n >= most)


def rules(wrapper: list, chars: dict[str, int], links: dict[str, int], fixed: dict[str, tuple[str, int]], pages: int, parts: dict[str, tuple[int, int]] | None = None, articles: dict[str, int] | None = None) -> dict:
    """What extraction needs of a host.

    ``articles`` counts characters by path of ``article`` elements. The rest is of pages
    without one (nor ``main``): ``chars`` and ``links`` count characters by place, ``fixed``
    gives place and characters of the texts that all these pages have, ``parts`` by
    path the characters of each page's largest element there, and of all. Gives
    ``articles`` (their paths), ``root`` (the part that holds the article), ``single``
    (paths on the way there of which a page's largest element counts), ``drop`` (places of
    links) and ``same`` (fixed texts).
    """
    groups, parts = set(repeated(wrapper)), parts or {}
    drop = {p for p, n in links.items() if 2 * n > chars[p]}
    weight = dict(chars)
    for place, n in fixed.values():
        weight[place] -= n * pages
    if 2 * sum(n for p, n in weight.items() if p not in drop) < sum(n for p, n in chars.items() if p not in drop):
        weight, fixed = dict(chars), {}  # one page, or copies of one: what they share is no template
    under: dict[str, int] = defaultdict(int)
    for place, n in weight.items():
        steps = place.split() if place not in drop else []
        for k in range(1, len(steps) + 1):
            under[" ".join(steps[:k])] += n
    root, single, whole = "", [], sum(n for p, n in weight.items() if p not in drop)
    rule = {"articles": chosen_articles(articles or {}, groups), "drop": sorted(drop), "same": sorted(fixed)}

    def leads(p: str) -> bool:
        most, all_ = parts.get(p, (0, 0))
        return p not in groups or 0 < all_ * LEADS <= most

    while True:
        inner = [p for p in under if p.rpartition(" ")[0] == root and tag(p.rpartition(" ")[2]) not in TEXT_TAGS and leads(p) and 2 * under[p] > whole]
        if not inner:
            return rule | {"root": root, "single": single}
        root = inner[0]
        single += [root] * (root in groups)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.col(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


FOUND = "host string, kind string, key string, place string, a long, b long, n long"


def observed(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """Counts by host, of all its pages: ``w`` skeletons, ``r`` characters by path of ``article`` elements; and of pages without an
    element that holds the article: ``p`` pages, ``e`` characters by place (``a``, of them ``b`` in links), ``t`` texts by place
    (``a`` characters each), ``i`` characters by path of the largest element (``a``) and of all (``b``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, str, str], list[int]] = {}

        def add(h: str, kind: str, key: str, place: str, a: int, b: int) -> None:
            own = held.setdefault((h, kind, key, place), [0, 0, 0])
            own[0] += a
            own[1] += b
            own[2] += 1

        def out() -> pa.RecordBatch:
            names, sums = list(zip(*held)) or [()] * 4, list(zip(*held.values())) or [()] * 3
            columns = [pa.array(x, pa.string()) for x in names] + [pa.array(x, pa.int64()) for x in sums]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names=["host", "kind", "key", "place", "a", "b", "n"])

        for batch in batches:
            for h, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                events = list(stream(page.as_py() or ""))
                add(h, "w", json.dumps(skeleton(events)), "", 0, 0)
                found = list(places(events))
                for f in found:
                    if f.within == "article":
                        add(h, "r", "", f.holder, len(f.text), 0)
                if not any(f.within for f in found):
                    add(h, "p", "", "", 0, 0)
                    for f in found:
                        add(h, "e", "", f.path, len(f.text), f.links)
                    for path, text in {(f.path, f.text) for f in found}:
                        add(h, "t", text_key(path, text), path, len(text), 0)
                    for path, sizes in instances(found).items():
                        add(h, "i", "", path, max(sizes.values()), sum(sizes.values()))
                if len(held) > HELD:
                    yield out()
        yield out()

    found = pages.select(host(url_col).alias("host"), html_col).mapInArrow(run, FOUND)
    return found.groupBy("host", "kind", "key", "place").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("n").alias("n"))


def merge_skeletons(frame: pd.DataFrame) -> pd.DataFrame:
    total = None
    for text in sorted(frame["key"]):
        total = json.loads(text) if total is None else merged(total, json.loads(text))
    return pd.DataFrame({"host": [frame["host"].iloc[0]], "key": [json.dumps(total)]})


def infer_wrappers(counts: DataFrame) -> DataFrame:
    """``host, key``: one wrapper for each host, from its distinct skeletons; ``counts`` is what ``observed`` gives."""
    own = counts.where("kind = 'w'").select("host", "key")
    some = own.groupBy("host", F.pmod(F.xxhash64("key"), F.lit(SALTS)).alias("salt")).applyInPandas(merge_skeletons, "host string, key string")
    return some.groupBy("host").applyInPandas(merge_skeletons, "host string, key string")


def host_rules(counts: DataFrame) -> DataFrame:
    """``host, rule`` for each host."""
    bare = counts.where("kind IN ('p', 'w')").groupBy("host").agg(F.coalesce(F.sum(F.when(F.col("kind") == "p", F.col("n"))), F.lit(0)).alias("bare"))
    # a text stands on all pages if it is counted as often as they are; the others need not be gathered
    kept = counts.where("kind IN ('e', 't', 'i', 'r')").join(bare, "host").where("kind IN ('e', 'i', 'r') OR n = bare").select("host", "kind", "key", "place", "a", "b", "bare")

    def make(w: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        e, t, i, r = (c[c["kind"] == kind] for kind in "etir")
        chars, links = dict(zip(e["place"], e["a"].astype(int))), dict(zip(e["place"], e["b"].astype(int)))
        pages = int(c["bare"].iloc[0]) if len(c) else 0
        # a text's characters were added up over the pages that have it
        fixed = {k: (p, int(n) // pages) for k, p, n in zip(t["key"], t["place"], t["a"])}
        parts = dict(zip(i["place"], zip(i["a"].astype(int).tolist(), i["b"].astype(int).tolist())))
        rule = rules(json.loads(w["key"].iloc[0]), chars, links, fixed, pages, parts, dict(zip(r["place"], r["a"].astype(int).tolist())))
        return pd.DataFrame({"host": [w["host"].iloc[0]], "rule": [json.dumps(rule)]})

    return infer_wrappers(counts).groupBy("host").cogroup(kept.groupBy("host")).applyInPandas(make, "host string, rule string")


def main_text(page: str, rule: dict) -> str:
    """The article's blocks, each with its white space made single, joined by line breaks."""
    found = list(places(stream(page)))
    for element in ("article", "main"):
        own = [f for f in found if f.within == element]
        if own:
            known = frozenset(rule.get("articles", ()))
            story = [f for f in own if f.holder in known]
            return "\n".join(f.text for f in story or own)  # else this page is laid out in another way
    root, drop, same = rule["root"], frozenset(rule["drop"]), frozenset(rule["same"])
    if any(f"{f.path} ".startswith(root + " ") for f in found):
        found = [f for f in found if not root or f"{f.path} ".startswith(root + " ")]
        for path in rule.get("single", ()):
            sizes = instances([f for f in found if f.path not in drop])[path]
            if sizes:
                k, spot = len(path.split()), max(sizes, key=lambda x: (sizes[x], -x[-1]))
                found = [f for f in found if f.spot[:k] == spot]
    return "\n".join(f.text for f in found if f.path not in drop and (not same or text_key(f.path, f.text) not in same))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, url_col, text`` for each page: the main text by its host's wrapper.

    A null or empty page has an empty text. Pages without a host (null or odd
    addresses) share one wrapper. Repeated rows are all returned; other columns are
    ignored. Character references are decoded once. Everything in an article (or
    main) element that no mark leaves out is kept, however often it stands elsewhere.
    """

    counts = written(observed(pages, url_col, html_col), "page-counts")
    by_host = written(host_rules(counts), "wrapper-rules")
    size = by_host.agg(F.sum(F.length("rule") + F.length("host"))).first()[0] or 0
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("html"), host(url_col).alias("host"))
    if size <= BROADCAST_BYTES:
        ruled = rows.join(F.broadcast(by_host), "host")
    else:  # a hot host's pages are dealt to several tasks
        salt = F.pmod(F.xxhash64("html"), F.lit(RULE_SALTS)).alias("salt")
        ruled = rows.select("*", salt).join(by_host.select("*", F.explode(F.sequence(F.lit(0), F.lit(RULE_SALTS - 1)).cast("array<long>")).alias("salt")), ["host", "salt"])
    ruled = ruled.select(id_col, url_col, "html", "rule")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column(2), batch.column(3).to_pylist()):
                if rule not in parsed:
                    parsed.clear() if len(parsed) > HELD else None
                    parsed[rule] = json.loads(rule)
                texts.append(main_text(page.as_py() or "", parsed[rule]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=[id_col, url_col, "text"])

    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType), T.StructField("text", T.StringType())])
    return ruled.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
