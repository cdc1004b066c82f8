"""Main text of web pages through wrappers: union-free patterns inferred from the pages of a host."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html import unescape
from zlib import crc32

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .hosts import host_and_path
from .shared import saved

#: Elements that stay inside a line, have no content, or never hold the article's text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ASIDE = frozenset("applet aside audio button canvas datalist dialog fieldset footer form frame frameset head iframe map menu nav noframes noscript object optgroup option progress script select style svg template textarea title video".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments consent cookie cookies dialog"
    " disclaimer disqus footer login menu modal nav navbar navigation newsletter notice notices notification pagination popup promo"
    " promoted related replies respond search share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
ASIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
MAIN_WORDS = frozenset("article main".split())
#: Elements that no class or id sets aside, words that say an element lacks or has a part beside it, and
#: words that may stand beside "related" where it names a list of links.
WHOLE = frozenset("html body main article".split())
BESIDE = frozenset("no not has have with without hide hides show shows is".split())
LINKS = frozenset("area articles block box content container group item items link links list more news pages panel posts products reading section stories story topics videos widget wrapper".split())
#: Levels of elements that are kept apart; what is nested deeper counts as part of the last of them.
DEEPEST = 100
IMPLIED_END = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)\b[^<>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>|<(/?)([a-z][^\s/<>]*)((?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+)>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Pages that must agree on a text outside the article's element before it counts as the host's template.
TEMPLATE_PAGES = 5
SALTS, LONGEST_PERIOD, TABLE_CELLS = 64, 3, 1_000_000


def _stands_aside(names: str) -> bool:
    """Whether a class or an id names a part beside the article: ``sidebar`` or ``site-footer``, not ``has-sidebar`` or ``related-work``."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z]+", name) if w]
        hit = ASIDE_WORDS.intersection(words)
        if hit and words[0] not in BESIDE and (hit != {"related"} or LINKS.issuperset(w for w in words if w != "related")):
            return True
    return False


class Element:
    """An element of a page: signature, whether it stands aside (by its own kind or only by its names) or is the main part, children or texts."""

    __slots__ = ("sig", "name", "aside", "named", "main", "kids")

    def __init__(self, name: str, attributes: str = "") -> None:
        found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
        self.name = name
        # Numbers in a class tell one page's element from another's, not one part of a page from another.
        self.sig = name + "".join(f".{c}" for c in sorted({re.sub(r"[0-9]+", "0", c) for c in found.get("class", "").split()}))
        self.named = name not in WHOLE and _stands_aside(f"{found.get('class', '')} {found.get('id', '')}")
        self.aside = name in ASIDE or self.named or found.get("role") in ASIDE_ROLES
        self.main = name in MAIN_WORDS or found.get("role") == "main" or found.get("itemprop") == "articlebody"
        self.kids: list[Element | str] = []


def parse(html: str | None) -> Element:
    """The page as a tree of block elements; inline markup dissolves into the text around it.

    An element that holds an article or main element stands aside by its names only if that is itself
    inside an aside element. Below ``DEEPEST`` levels elements add to the one they are in.
    """
    root = Element("#page")
    stack, text = [root], []
    opened: dict[str, int] = {}  # open elements by name, so that a stray end tag costs nothing

    def flush() -> None:
        words = " ".join(unescape("".join(text)).split())
        text.clear()
        if words:
            stack[-1].kids.append(words)

    at, html = 0, html or ""
    for m in TOKEN.finditer(html):
        text.append(html[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name or name in INLINE:
            continue
        if name in EMPTY:
            text.append(" ")
            continue
        flush()
        if m[2]:
            while opened.get(name):
                last = stack.pop().name
                opened[last] -= 1
                if last == name:
                    break
            continue
        while len(stack) > 1 and (stack[-1].name in IMPLIED_END.get(name, ()) or stack[-1].name == "p"):
            opened[stack.pop().name] -= 1
        child = Element(name, m[4])
        if child.main:
            for holder in stack:
                if holder.named and holder.name not in ASIDE:
                    holder.aside = False
        if len(stack) < DEEPEST:
            stack[-1].kids.append(child)
        elif not child.aside:
            child.kids = stack[-1].kids
        if not m[4].endswith("/") or name not in ("path", "circle", "rect", "line", "use"):
            stack.append(child)
            opened[name] = opened.get(name, 0) + 1
    text.append(html[at:])
    flush()
    return root


# A pattern is [key, optional, repeated, parts, text, asides]: the key is an element's signature, "#" for a text slot or
# "+" for a group; text is the digest that all texts of the slot share, or None once they differ.
SLOT, GROUP = "#", "+"


def pattern_of(node: Element | str) -> list:
    """A page's own pattern: neighbouring repeats are folded into repeated elements or groups."""
    if isinstance(node, str):
        return [SLOT, False, False, [], crc32(node.encode()), 0]
    kind = 1 if node.aside else 2 if node.main else 0
    return [node.sig, False, False, [] if node.aside else folded([pattern_of(k) for k in node.kids]), None, kind]


def folded(parts: list[list]) -> list[list]:
    """Fold tandem repeats, shortest period first: ``p p p`` is ``(p)+`` and ``dt dd dt dd`` is ``(dt dd)+``."""
    for period in range(1, LONGEST_PERIOD + 1):
        out: list[list] = []
        keys: list[tuple | str] = []
        for part in parts:
            out.append(part)
            keys.append(part[0])
            while len(out) >= 2 * period and keys[-period:] == keys[-2 * period : -period] and (period > 1 or keys[-1] != GROUP):
                for a, b in zip(range(-2 * period, -period), range(-period, 0)):
                    out[a] = merged(out[a], out[b])
                if period == 1:
                    out[-2][2] = True
                del out[-period:], keys[-period:]
                if period > 1:
                    out[-period:] = [[GROUP, False, True, out[-period:], None, 0]]
                    keys[-period:] = [GROUP]
            if period > 1 and len(out) > period and keys[-period - 1] == GROUP and [k[0] for k in out[-period - 1][3]] == keys[-period:]:
                out[-period - 1][3] = [merged(a, b) for a, b in zip(out[-period - 1][3], out[-period:])]
                del out[-period:], keys[-period:]
        parts = out
    return parts


def merged(a: list, b: list) -> list:
    """The pattern that fits what either of two patterns with one key fits."""
    return [a[0], a[1] or b[1], a[2] or b[2], aligned(a[3], b[3]), a[4] if a[4] == b[4] else None, a[5] or b[5]]


def matching(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Longest common subsequence of two key lists, as index pairs; equal ends are matched first."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    out = [(i, i) for i in range(head)]
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    if x and y and len(x) * len(y) <= TABLE_CELLS:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) and j < len(y):
            if x[i] == y[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    elif x and y:  # very long lists: the next equal key
        after: dict[str, list[int]] = {}
        for j in range(len(y) - 1, -1, -1):
            after.setdefault(y[j], []).append(j)
        low = 0
        for i, key in enumerate(x):
            places = after.get(key, [])
            while places and places[-1] < low:
                places.pop()
            if places:
                low = places.pop() + 1
                out.append((head + i, head + low - 1))
    return out + [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]


def aligned(a: list[list], b: list[list]) -> list[list]:
    """Align two pattern lists: what only one of them has becomes optional, neighbours of one key repeat."""
    out: list[list] = []
    i = j = 0
    for p, q in [*matching([k[0] for k in a], [k[0] for k in b]), (len(a), len(b))]:
        for part in a[i:p] + b[j:q]:
            out.append([part[0], True, *part[2:]])
        if p < len(a):
            out.append(merged(a[p], b[q]))
        i, j = p + 1, q + 1
    joined: list[list] = []
    for part in out:
        if joined and joined[-1][0] == part[0] != GROUP:
            both = merged(joined[-1], part)
            both[1], both[2] = joined[-1][1] and part[1], True
            joined[-1] = both
        else:
            joined.append(part)
    return joined


def _fold(group: pd.DataFrame) -> tuple[list, int]:
    whole, pages = None, 0
    for text, n in sorted(zip(group["pattern"], group["pages"])):
        pattern = json.loads(text)
        whole, pages = pattern if whole is None else merged(whole, pattern), pages + int(n)
    return whole, pages


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``(host, pattern, pages)`` from ``(host, html)``: one wrapper per host, aligned over all its pages.

    Tasks first align the pages they hold, then salted parts of each host, then the parts: a host
    with a third of all pages is no single group. Alignment does not depend on which pages meet
    first as to what counts here: the keys seen, and which slots ever differed.
    """

    def local(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = TaskContext.get().partitionId()
        for batch in batches:
            salt += 1
            held: dict[str, list] = {}
            for host, html in zip(batch["host"], batch["html"]):
                pattern = pattern_of(parse(html))
                entry = held.setdefault(host, [None, 0])
                entry[0] = pattern if entry[0] is None else merged(entry[0], pattern)
                entry[1] += 1
            rows = [(h, salt % SALTS, json.dumps(p), n) for h, (p, n) in held.items()]
            yield pd.DataFrame(rows, columns=["host", "salt", "pattern", "pages"])

    def join(group: pd.DataFrame) -> pd.DataFrame:
        pattern, pages = _fold(group)
        return pd.DataFrame({"host": [group["host"].iat[0]], "pattern": [json.dumps(pattern)], "pages": [pages]})

    parts = pages.mapInPandas(local, "host string, salt int, pattern string, pages bigint")
    parts = parts.groupBy("host", "salt").applyInPandas(join, "host string, pattern string, pages bigint")
    return parts.groupBy("host").applyInPandas(join, "host string, pattern string, pages bigint")


def _has_main(p: list) -> bool:
    return p[5] == 2 or (p[5] != 1 and any(_has_main(k) for k in p[3]))


def main_text(page: Element, wrapper: list, pages: int) -> str:
    """Texts of a page in the wrapper's main part, in page order.

    A host whose wrapper has a main element keeps the slots inside it. On a host without one, every
    slot outside parts that stand aside is kept unless all its pages agree on the slot's text.
    """
    inside = _has_main(wrapper)
    out: list[str] = []

    def flat(parts: list[list]) -> list[list]:
        return [x for p in parts for x in (flat(p[3]) if p[0] == GROUP else [p])]

    def walk(node: Element, parts: list[list], main: bool) -> None:
        known = {}
        for p in flat(parts):
            known[p[0]] = p if p[0] not in known else merged(known[p[0]], p)
        for kid in node.kids:
            if isinstance(kid, str):
                slot = known.get(SLOT)
                template = slot is not None and slot[4] is not None and pages >= TEMPLATE_PAGES
                if main or not (inside or template):
                    out.append(kid)
            elif not (kid.aside or (kid.name == "header" and not main)):
                walk(kid, known[kid.sig][3] if kid.sig in known else [], main or kid.main)

    walk(page, wrapper[3], False)
    if not out and inside:  # this page lacks the host's main element
        inside = False
        walk(page, wrapper[3], False)
    return " ".join(out)


def extract_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)``: the article of each page; empty if there is none or html is null.

    Pages with a null or unparsable url share the wrapper of the empty host. Unclosed and stray tags
    are repaired, references decoded, inline markup dissolved; pages of any length and depth are read
    whole. Which of several equal slots a text fills does not matter. Repeated pages stay repeated rows;
    extra columns are ignored; an empty table gives an empty result.
    """
    host, _ = host_and_path(F.col("url").cast("string"))
    rows = pages.select("page_id", "url", host.alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    wrappers = saved(infer_wrappers(rows.select("host", "html")), "wrappers")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loaded: dict[str, list] = {}
        for batch in batches:
            texts = []
            for html, pattern, n in zip(batch["html"], batch["pattern"], batch["pages"]):
                if pattern not in loaded:
                    if len(loaded) > 200:
                        loaded.clear()
                    loaded[pattern] = json.loads(pattern)
                texts.append(main_text(parse(html), loaded[pattern], int(n)))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    joined = rows.join(wrappers, "host").select("page_id", "url", "html", "pattern", "pages")
    kind = dict(pages.dtypes)
    return joined.mapInPandas(run, f"page_id {kind['page_id']}, url {kind['url']}, text string, n_chars bigint")
