"""Main-text extraction by template deduction over the pages of a host.

A page is a sequence of tokens in their roles: an element at its path, or a text block at its path. Over the pages of a host each token has
an occurrence vector (how often it is in each page), kept as a fingerprint that sums, so that the vectors of a host with any number of pages
are combined map-side and never lie in one place. Tokens with equal vectors form an equivalence class. A class is valid if it is in
half of the host's pages and has two tokens or more that are ordered and nested: on LEAST_AGREEING of the pages such a token has one and the
same rank in the order of its class, which may repeat within a page, and lies in one and the same slot of the class that encloses it. The
valid classes, nested, are the host's template. What lies between its tokens are slots, and the template decides about them for all pages of the host: texts of valid
classes are constant (menus, notices and headers that repeat); the main node is the deepest one, once a page, whose slots hold most of
the varying text; below it, slots that are mostly links and lists of records (classes of RECORD elements or more that repeat within a
page: comments, teasers) are left out. Elements that can hold no article (scripts, forms) never count, and an element's name (nav, footer, a
class such as comments) labels the slots below it, since no count can tell a reader's comment from a paragraph. Pages of
hosts below LEAST_PAGES, and pages without the template's main node, are cut by their own elements alone.

Three passes read the pages (vectors; order and nesting; extraction), and what is shipped between them is the template's tokens.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.storage import materialize
from quillstone.llm.url_filter import split_url
from quillstone.llm.words import mix

LEAST_PAGES, LEAST_SHARE, LEAST_CLASS = 3, 0.5, 2
#: The share of a class's pages that must agree on a token's rank and slot.
LEAST_AGREEING = 0.9
#: The main node is the deepest one, once a page, that holds this share of a host's varying text.
MAIN_SHARE = 0.7
#: Elements of a class that repeats within a page, from which on it is a list of records; and the share of linked text that makes a slot a menu.
RECORD, LINKED = 3, 0.5
#: Template tokens of all hosts together that are broadcast, 16 bytes each; more are joined to the pages by host and salt.
BROADCAST_TOKENS, SALTS = 2_000_000, 64

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""(?:^|[\s"'])(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_SPACE = re.compile(r"\s+")
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
_ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
_SIBLING = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "thead": {"table"}, "tbody": {"table"}}
_LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol pre blockquote table thead tbody tfoot tr td th dl dt dd figure figcaption".split())
_DROP_TAGS = frozenset("nav aside footer form script style noscript template iframe svg button select textarea input dialog menu head object canvas audio video".split())
_DROP_NAMES = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead topbar footer sidebar aside ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo "
    "promotion banner notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login comment comments disqus respond replies reply "
    "share sharing social related recommended recommendations widget widgets toolbar search pagination pager skip tags teaser teasers byline-links outbrain taboola paywall".split()
)
_DROP_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words that may stand beside such a name in a compound one. Any other word (social-history, ad-hoc) says that the name is about something else.
_LAYOUT = frozenset(
    "area bar block body bottom box button buttons column container content copyright custom desktop first form global google group icon icons img image images inner item items js label last latest layout left "
    "legal link links list local main meta middle mobile module more news outer page panel pane placeholder popular post posts primary region right row secondary section side site slot sticky sub tag text "
    "thread title top unit user view wrap wrapper zone".split()
)
#: Names of an article's own element; beside one of these, those of frames (a post that is a widget area too) say nothing.
_ARTICLE = frozenset("article post entry story".split())
_FRAMES = frozenset("sidebar aside widget widgets header banner notice tags search social share sharing menu".split())


def _boilerplate(tag: str, attributes: dict[str, str], within_article: bool) -> bool:
    if tag in _DROP_TAGS or tag == "header" and not within_article:
        return True
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or attributes.get("role") in _DROP_ROLES:
        return True
    if tag in ("html", "body", "main"):
        return False
    names = f"{attributes.get('class', '')} {attributes.get('id', '')}".split()
    own = any(n.lower() in _ARTICLE for n in names)
    for name in names:
        parts = [p.lower() for p in re.split(r"[-_]+|(?<=[a-z])(?=[A-Z])", name) if p and not p.isdigit()]
        if tag in _LEAF and tag not in ("ul", "ol", "table", "dl", "figure") and len(parts) > 1:
            continue
        said = [p for p in parts if p in _DROP_NAMES and not (own and p in _FRAMES)]
        if said and all(p in _DROP_NAMES or p in _LAYOUT for p in parts):
            return not (tag == "header" and within_article)
    return False


_KEPT_NODES = 100_000
#: Elements without attributes that frame a page's columns, told apart by their place, down to this depth and up to this number; deeper ones may be records of a list, which have one path.
_FRAME_TAGS, FRAME_DEPTH, MOST_FRAMES = frozenset(("div", "section", "td")), 4, 9
_HEADINGS, _LISTS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset(("ul", "ol"))


class Node:
    """An element's place: what its path, names and ancestors say. One object for all elements that open alike at one place."""

    __slots__ = ("article", "chain", "children", "dropped", "open", "path", "tag", "token")

    def __init__(self, tag: str = "", path: str = "", dropped: bool = False, article: bool = False, opens: bool = True, above: tuple[int, ...] = ()) -> None:
        self.tag, self.path, self.dropped, self.article, self.open = tag, path, dropped, article, opens
        self.token = _token(path)
        self.chain = (*above, self.token) if path else above
        self.children: dict[tuple[str, int], Node] = {}

    def child(self, tag: str, raw: str, place: int = 0) -> Node:
        """place: the element's number among its parent's frames without names, 0 for all others."""
        found = self.children.get((raw, place))
        if found is None:
            attributes = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(raw[1 + len(tag) : -1])}
            name = "".join([tag, *(f".{c}" for c in attributes.get("class", "").split()[:3] if sum(ch.isdigit() for ch in c) < 3), f":{place}" if place else ""])
            dropped = self.dropped or _boilerplate(tag, attributes, self.article)
            article = self.article or (tag in ("article", "main") or attributes.get("role") == "main") and not dropped
            found = Node(tag, f"{self.path}/{name}", dropped, article, tag not in _VOID and tag not in _RAW and not raw[:-1].rstrip().endswith("/"), self.chain)
            if len(self.children) < 1000:
                self.children[raw, place] = found
                _kept.append(found)
        return found


class Block:
    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node, text: str, linked: float) -> None:
        self.node, self.text, self.linked = node, text, linked

    @property
    def token(self) -> int:
        return _token(self.node.path, self.text)


_kept: list[Node] = []
_root = [None]


def _start() -> Node:
    """The root of all places that this process has met; forgotten when there are too many."""
    if _root[0] is None or len(_kept) > _KEPT_NODES:
        _kept.clear()
        _root[0] = Node()
    return _root[0]


def _token(*parts: str) -> int:
    return xxhash.xxh64_intdigest("\x00".join(parts)) >> 1


def parse(page: str) -> list[Node | Block]:
    """The elements that open and the text blocks of a page, in order. Lenient: what is not closed ends with its parent."""
    out: list[Node | Block] = []
    stack = [_start()]
    frames = [0]  # by element of the stack: its frames without names so far
    held: list[str] = []
    link_depth = 0
    linked = 0
    pos = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = _SPACE.sub(" ", "".join(held)).strip()
            if text:
                out.append(Block(stack[-1], text, linked / len(text)))
            held.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            held.append(text)
            if link_depth:
                linked += len(text.strip())

    while True:
        m = _TAG.search(page, pos)
        if not m:
            add(page[pos:])
            break
        add(page[pos : m.start()])
        pos = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), bool(m[1] or m[4])
        if tag in _INLINE:
            if tag == "br":
                held.append(" ")
            elif tag == "a":
                link_depth = 0 if closing else 1
            continue
        flush()
        link_depth = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in _ENDS_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in ("td", "th", "table", "div", "article", "section", "body"):
                    break
        if tag in _SIBLING:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in _SCOPE[tag]:
                    break
                if stack[i].tag in _SIBLING[tag]:
                    del stack[i:]
        if tag == "body":
            del stack[next((i for i, x in enumerate(stack) if x.tag == "head"), len(stack)) :]
        del frames[len(stack) :]
        place = 0
        if tag in _FRAME_TAGS and len(stack) <= FRAME_DEPTH and not (m[3] or m[6] or "").strip(" /"):
            frames[-1] += 1
            place = min(frames[-1], MOST_FRAMES)
        node = stack[-1].child(tag, m[0], place)
        out.append(node)
        if tag in _RAW:
            end = _RAW[tag].search(page, pos)
            pos = end.end() if end else len(page)
        elif node.open:
            stack.append(node)
            frames.append(0)
    flush()
    return out


PAGES, TAG, TEXT = 0, 1, 2
_STATS = "host long, kind byte, token long, pages long, f1 long, f2 long, n long, chars long, linked long, path string"


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per host: its pages, and each token with the fingerprint of its occurrence vector here; elements also with the characters of the texts below them, and of those that are links."""
    sums: dict[tuple[int, int, int], list[int]] = {}
    names: dict[tuple[int, int, int], str] = {}
    for b in batches:
        for host, page_id, page in zip(b["host"].to_pylist(), b["page_id"].to_pylist(), b["html"], strict=True):
            here = _token(host)
            mark = _token("page", str(page_id))
            m1, m2 = mark & 0x3FFFFFFF, (mark >> 31) & 0x3FFFFFFF
            counts: dict[tuple[int, int, int], list[int]] = {}
            for x in parse(page.as_py()):
                if isinstance(x, Node):
                    k = here, TAG, x.token
                    names[k] = x.path
                    counts.setdefault(k, [0, 0, 0])[0] += 1
                    continue
                counts.setdefault((here, TEXT, x.token), [0, 0, 0])[0] += 1
                if not x.node.dropped:
                    for token in x.node.chain:
                        c = counts[here, TAG, token]
                        c[1] += len(x.text)
                        c[2] += len(x.text) * (x.linked >= LINKED)
            sums.setdefault((here, PAGES, 0), [0] * 6)[0] += 1
            for k, (n, chars, links) in counts.items():
                s = sums.setdefault(k, [0] * 6)
                s[0] += 1
                s[1] += m1 * n
                s[2] += m2 * n
                s[3] += n
                s[4] += chars
                s[5] += links
        if len(sums) > 400_000:
            yield _stats_batch(sums, names)
            sums, names = {}, {}
    if sums:
        yield _stats_batch(sums, names)


def _stats_batch(sums: dict, names: dict) -> pa.RecordBatch:
    keys, values = np.array(list(sums), np.int64), np.array(list(sums.values()), np.int64)
    arrays = [pa.array(keys[:, 0]), pa.array(keys[:, 1].astype(np.int8)), pa.array(keys[:, 2]), *(pa.array(values[:, i]) for i in range(6)), pa.array([names.get(k) for k in sums], pa.string())]
    return pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in _STATS.split(", ")])


class Tokens:
    """Values of (host, token) pairs as two sorted arrays."""

    def __init__(self, hosts: np.ndarray, tokens: np.ndarray, values: np.ndarray) -> None:
        keys = self.key(hosts, tokens)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    @staticmethod
    def key(host: np.ndarray | int, tokens: np.ndarray) -> np.ndarray:
        return mix(tokens.astype(np.uint64) ^ mix(np.atleast_1d(np.asarray(host, np.int64)).astype(np.uint64)))

    def of(self, host: int, tokens: np.ndarray) -> np.ndarray:
        """The value of each token of the host, 0 where there is none."""
        if not len(self.keys) or not len(tokens):
            return np.zeros(len(tokens), np.int64)
        wanted = self.key(host, tokens)
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.values[at], 0)


def _tokens_of(events: list[Node | Block]) -> np.ndarray:
    return np.fromiter((x.token for x in events), np.int64, len(events))


_PLACES = "host long, token long, place long, pages long"


def page_places(events: list[Node | Block], classes: np.ndarray) -> dict[int, int]:
    """For each token of a class: its place in the page, a number that stands for its rank in the class's order and for the slot (the enclosing class, and how many of
    its tokens went before) in which it lies. 0 if it is not the same wherever the class repeats within the page."""
    of_token = {x.token: c for x, c in zip(events, classes.tolist(), strict=True) if c}
    size: dict[int, int] = defaultdict(int)
    for c in of_token.values():
        size[c] += 1
    seen: dict[int, int] = defaultdict(int)
    out: dict[int, tuple | None] = {}
    for x, c in zip(events, classes.tolist(), strict=True):
        if c:
            above = x.chain[:-1] if isinstance(x, Node) else x.node.chain
            parent = next((p for t in reversed(above) if (p := of_token.get(t, 0)) not in (0, c)), 0)
            place = (seen[c] % size[c], parent, seen[parent] % size[parent] if parent else 0)
            seen[c] += 1
            out[x.token] = place if out.setdefault(x.token, place) == place else None
    return {t: _token(repr(p)) | 1 if p else 0 for t, p in out.items()}


def _places(batches: Iterator[pa.RecordBatch], classes_of) -> Iterator[pa.RecordBatch]:
    counts: dict[tuple[int, int, int], int] = defaultdict(int)

    def rows() -> pa.RecordBatch:
        columns = [*zip(*counts, strict=True), list(counts.values())]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [x.split()[0] for x in _PLACES.split(", ")])

    for b in batches:
        look_up = classes_of(b)
        for i, (host, page) in enumerate(zip(b["host"].to_pylist(), b["html"], strict=True)):
            events, here = parse(page.as_py()), _token(host)
            for token, place in page_places(events, look_up(i, here, _tokens_of(events))).items():
                counts[here, token, place] += 1
        if len(counts) > 100_000:
            yield rows()
            counts.clear()
    if counts:
        yield rows()


_TEMPLATE = "host long, main long, tokens array<long>, roles array<long>"
CONSTANT, LEFT_OUT, MAIN = 1, 2, 3


def choose_slots(tags: list[tuple[int, int, int, int, int, int, str]]) -> tuple[int, list[int]]:
    """(main node or 0, nodes below it that are left out) from a template's elements: (token, class, pages, n, chars, linked, path)."""
    repeated: dict[int, list] = defaultdict(list)
    for t in tags:
        if t[3] > t[2]:
            repeated[t[1]].append(t)
    heads = []
    for group in repeated.values():
        head = min(group, key=lambda t: len(t[6]))
        if len(group) >= RECORD and all(t is head or t[6].startswith(head[6] + "/") for t in group):
            heads.append(head)
    heads = [h for h in heads if not any(h[6].startswith(o[6] + "/") for o in heads)]
    every = max((t[4] for t in tags), default=0)
    if 2 * sum(h[4] for h in heads) >= every:
        heads = []  # the host's articles are made of records
    below = lambda t, path: t[6].startswith(path + "/")
    varying = {t[0]: t[4] - t[5] - sum(h[4] - h[5] for h in heads if below(h, t[6])) for t in tags}
    most = max(varying.values(), default=0)
    able = [t for t in tags if t[2] == t[3] and most > 0 and varying[t[0]] >= MAIN_SHARE * most]
    if not able:
        return 0, []
    main = max(able, key=lambda t: (t[6].count("/"), varying[t[0]], t[6]))
    out = [h[0] for h in heads if below(h, main[6])]
    out += [t[0] for t in tags if below(t, main[6]) and t[4] and t[5] >= LINKED * t[4]]
    return main[0], sorted(set(out))


def _template(rows: pd.DataFrame) -> pd.DataFrame:
    """The template of one host: as many rows as it has tokens, which are no more than one page has."""
    tags = rows[rows.kind == TAG]
    main, left = choose_slots(list(zip(tags.token, tags["class"], tags.pages, tags.n, tags.chars, tags.linked, tags.path, strict=True)))
    constant = sorted(rows.token[rows.kind == TEXT])
    tokens = [*constant, *left, *([main] if main else [])]
    roles = [CONSTANT] * len(constant) + [LEFT_OUT] * len(left) + [MAIN] * bool(main)
    return pd.DataFrame({"host": [rows.host.iloc[0]], "main": [main], "tokens": [[int(t) for t in tokens]], "roles": [roles]})


def _with_values(pages: DataFrame, found: DataFrame, value: str, run, schema: str) -> DataFrame:
    """``run`` over the pages with the values of their host's tokens: by broadcast while these are few, else joined by host and salt. found: host, token, and the value."""
    if found.count() <= BROADCAST_TOKENS:
        rows = found.select("host", "token", value).toArrow()  # at most BROADCAST_TOKENS rows
        known = pages.sparkSession.sparkContext.broadcast(Tokens(*(rows[c].to_numpy() for c in ("host", "token", value))))
        return pages.mapInArrow(lambda batches: run(batches, lambda _: lambda i, host, tokens: known.value.of(host, tokens)), schema)

    @F.arrow_udf("long")
    def key(hosts: pa.Array) -> pa.Array:
        return pa.array([_token(h) for h in hosts.to_pylist()], pa.int64())

    def joined(b: pa.RecordBatch):
        tokens, values = b["tokens"].to_pylist(), b["values"].to_pylist()

        def look_up(i: int, host: int, wanted: np.ndarray) -> np.ndarray:
            known = dict(zip(tokens[i] or (), values[i] or (), strict=True))
            return np.array([known.get(t, 0) for t in wanted.tolist()], np.int64)

        return look_up

    by_host = found.groupBy("host").agg(F.collect_list("token").alias("tokens"), F.collect_list(value).alias("values"))  # a template's tokens are no more than a page's
    salted = by_host.withColumnRenamed("host", "key").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = pages.withColumn("key", key("host")).withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    dealt = dealt.join(salted, ["key", "salt"], "left").select(*pages.columns, "tokens", "values")
    return dealt.mapInArrow(lambda batches: run(batches, joined), schema)


def templates(pages: DataFrame) -> DataFrame:
    """(host, token, role) of the hosts' templates: constant texts, elements that are left out, and the main node."""
    total = lambda *names: [F.sum(n).alias(n) for n in names]
    stats = pages.mapInArrow(_statistics, _STATS).groupBy("host", "kind", "token").agg(*total("pages", "f1", "f2", "n", "chars", "linked"), F.first("path", True).alias("path"))
    stats = materialize(stats, "template-tokens")
    hosts = stats.where((F.col("kind") == PAGES) & (F.col("pages") >= LEAST_PAGES)).select("host", F.col("pages").alias("all"))
    tokens = stats.where((F.col("kind") != PAGES) & (F.col("pages") >= LEAST_PAGES)).join(hosts, "host").where(F.col("pages") >= LEAST_SHARE * F.col("all"))
    tokens = tokens.withColumn("class", F.xxhash64("pages", "f1", "f2").bitwiseOR(F.lit(1)))
    sizes = tokens.groupBy("host", "class").agg(F.count("*").alias("size"), F.first("pages").alias("in_pages"))
    tokens = materialize(tokens.join(sizes.where(F.col("size") >= LEAST_CLASS), ["host", "class"]), "template-classes")
    places = _with_values(pages, tokens, "class", _places, _PLACES).where("place <> 0").groupBy("host", "token", "place").agg(F.sum("pages").alias("agree"))
    agreed = places.groupBy("host", "token").agg(F.max("agree").alias("agree"))
    ordered = materialize(tokens.join(agreed, ["host", "token"]).where(F.col("agree") >= LEAST_AGREEING * F.col("in_pages")).drop("size"), "template-ordered")
    valid = ordered.join(ordered.groupBy("host", "class").agg(F.count("*").alias("size")).where(F.col("size") >= LEAST_CLASS), ["host", "class"])
    chosen = valid.select("host", "kind", "token", "class", "pages", "n", "chars", "linked", "path").groupBy("host").applyInPandas(_template, _TEMPLATE)
    return chosen.select("host", F.explode(F.arrays_zip("tokens", "roles")).alias("t")).select("host", F.col("t.tokens").alias("token"), F.col("t.roles").alias("role"))


def own_text(events: list[Node | Block]) -> str:
    """The article of a page by its own elements alone: what lies in an article or main element where that is half of the text, else all unlinked text."""
    blocks = [x for x in events if isinstance(x, Block) and not x.node.dropped]
    article = [x for x in blocks if x.node.article]
    unlinked = [x for x in blocks if x.linked < LINKED]
    held = lambda some: sum(len(x.text) for x in some)
    return "\n\n".join(x.text for x in (article if article and 2 * held(article) >= held(unlinked) else unlinked))


def main_text(page: str, roles_of=None) -> str:
    """The article of one page: the slots below the template's main node, in order. roles_of gives the roles of tokens."""
    events = parse(page)
    roles = roles_of(_tokens_of(events)) if roles_of else np.zeros(len(events), np.int64)
    main = {x.token for x, r in zip(events, roles, strict=True) if r == MAIN}
    if not main:
        return own_text(events)
    left = {x.token for x, r in zip(events, roles, strict=True) if r == LEFT_OUT}
    kept, told, seen = [], set(), {}
    for x, r in zip(events, roles.tolist(), strict=True):
        if isinstance(x, Node):
            seen[x.token] = x
            continue
        if x.node.dropped or not main.intersection(x.node.chain):
            continue
        out = next((i for i, t in enumerate(x.node.chain) if t in left), -1)
        # a list of links after text of the same parent is the article's own, one before it a menu
        if out < 0 or seen[x.node.chain[out]].tag in _LISTS and out and x.node.chain[out - 1] in told:
            kept.append((x, r))
            if r != CONSTANT and x.linked < LINKED:
                told.update(x.node.chain[:-1])
    varying, follows = [], set()
    for x, r in reversed(kept):  # a heading that all pages have stays where text of its parent follows
        if r != CONSTANT or x.node.tag in _HEADINGS and len(x.node.chain) > 1 and x.node.chain[-2] in follows:
            varying.append(x)
            follows.update(x.node.chain[:-1])
    varying.reverse()
    # a class that holds nearly all the text is a copied page, not a template
    if sum(len(x.text) for x in varying) < 0.2 * sum(len(x.text) for x, _ in kept):
        varying = [x for x, _ in kept]
    return "\n\n".join(x.text for x in varying)


RESULT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch], roles_of) -> Iterator[pa.RecordBatch]:
    for b in batches:
        look_up, texts = roles_of(b), []
        for i, (host, page) in enumerate(zip(b["host"].to_pylist(), b["html"], strict=True)):
            texts.append(main_text(page.as_py(), lambda tokens: look_up(i, _token(host), tokens)))  # noqa: B023
        yield pa.RecordBatch.from_arrays([b["page_id"], b["url"], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """One row per page: page_id, url, text (blocks joined by an empty line; empty if none), n_chars.

    Null html is empty, a null url belongs to the host "". A host with fewer than LEAST_PAGES pages has no template: its pages are cut by their own elements.
    Repeated rows have equal results (and count as pages of their own in the vectors); rows that repeat a page_id with other html each have their text.
    Columns other than page_id, url and html are not read.
    """
    host, _ = split_url(F.col("url"))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    found = materialize(templates(p.select("page_id", "html", "host")), "templates")
    return _with_values(p, found, "role", _extract, RESULT)
