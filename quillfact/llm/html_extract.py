"""Main text of web pages by template deduction over the pages of a host.

Pages of a host are grouped (large hosts in salted groups of about GROUP pages). In a group, every token (a tag or a word,
together with the path of containers around it) has an occurrence vector: how often each page has it. Tokens with equal
vectors form an equivalence class; of a class those count that come in one order in every page that has them, if something
between them differs from page to page. Valid classes are nested into the template, larger ones first: all of a class must
lie in one slot of each class that is there, the same in every page, or all of that one in one slot of it; a class that
crosses another is none. Pages with equal candidate text are copies and count once, so that a text is not
taken for template because it is repeated. Words of a nested
class that stand in a run of LEAST_CLASS fixed tokens wherever they stand are the template's own, in articles too; what
is left are slots. Names of tags and classes choose among the slots: none in containers for menus, headers, footers, side
bars, notices, adverts, forms and comments; those inside article or main elements, unless the others hold more than
TEASER times their words (a page without article, or with a mere teaser in it), then all.

Defined results: null html is empty, and an empty page has an empty text; pages without a host form one; repeated rows get
a row each; white space inside a block becomes one blank; a page's url and other columns do not change its text; a very long
page is taken whole; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfact.llm.common import arrow_batches, sized

GROUP = 64
#: Pages that must share a class, and the share of the group's pages.
SUPPORT, SHARE = 3, 0.6
#: Tokens of a template that make a class.
LEAST_CLASS = 3
#: So many times the slot words of the article elements must stand elsewhere for those to be a teaser.
TEASER = 2
# Fixed names of elements and of class, id and role words.
RAW = frozenset("script style textarea title template iframe noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ASIDE = frozenset("nav header footer aside form button select dialog menu fieldset head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOXES = frozenset("article aside body dialog div dl fieldset figure footer form header main menu nav ol section table ul button select label head td th".split())
ASIDE_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert menu nav navbar navigation breadcrumb breadcrumbs sidebar side rail footer foot header masthead topbar toolbar comment comments commentlist disqus reply replies respond related recommended share sharing social subscribe subscription newsletter signup login popup modal overlay widget pagination pager complementary contentinfo search skip toc".split())
# Fixed words that a class name of such a container may hold besides.
PLAIN_WORDS = frozenset("site page main global left right top bottom box block wrapper wrap container area section list links link posts stories articles items item content inner outer bar buttons button form js col row primary secondary fixed sticky mobile desktop".split())
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*)>""", re.S)
MARKS = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
WORD = re.compile(r"[^a-z0-9]+")


def _named_aside(attributes: str) -> bool:
    if not attributes or attributes.isspace():
        return False
    if HIDDEN.search(attributes):
        return True
    for m in MARKS.findall(attributes):
        for name in "".join(m).lower().split():
            words = {w for w in WORD.split(name) if w}
            if words & ASIDE_WORDS and words <= ASIDE_WORDS | PLAIN_WORDS:  # so related-posts, but not related-work
                return True
    return False


def parse(page: str) -> list[tuple[str, str, bool, bool, bool]]:
    """Events of a page: (path, token, is_text, inside an article, inside a side container); block tags are tokens too."""
    out, at, stack, article, aside, path = [], 0, [], 0, 0, ""

    def text(chunk: str) -> None:
        if chunk:
            out.append((path, chunk, True, article > 0, aside > 0))

    def drop(to: int) -> None:
        nonlocal article, aside, path
        while len(stack) > to:
            _, was_article, was_aside, path_ = stack.pop()
            article -= was_article
            aside -= was_aside
            path = path_

    while True:
        m = TAG.search(page, at)
        if m is None:
            text(page[at:])
            return out
        text(page[at : m.start()])
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:
            if name in BOXES:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        drop(i)
                        break
            if name in BLOCKS:
                out.append((path, f"</{name}>", False, article > 0, aside > 0))
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCKS:
            out.append((path, f"<{name}>", False, article > 0, aside > 0))
        elif name == "br":
            text(" ")
        if name in BOXES and name not in VOID and not m[3].endswith("/"):
            is_aside = name in ASIDE or _named_aside(m[3])
            is_article = name in ("article", "main") and not is_aside
            if is_article and not article:  # an open side container that nobody closed ends here
                for i, held in enumerate(stack):
                    if held[2] and held[0] != "dialog":
                        drop(i)
                        break
            if name == "body":
                drop(0)
            stack.append((name, is_article, is_aside, path))
            article += is_article
            aside += is_aside
            path = f"{path}/{name}"


Token = tuple[str, str]
Events = list[tuple[str, str, bool, bool, bool]]


def stream(events: Events) -> list[Token]:
    """The tokens of a page in order: (path, tag) and (path, word)."""
    return [(path, w) for path, token, is_text, *_ in events for w in (token.split() if is_text else (token,))]


def _common(orders: list[list[Token]]) -> list[Token]:
    """Tokens of the first order that all others have in the same order (a longest run of each with those before it)."""
    held = orders[0]
    for order in orders[1:]:
        if order == held:
            continue
        place = {t: i for i, t in enumerate(order)}
        tails, at, before = [], [], {}
        for t in (t for t in held if t in place):
            k = bisect_left(tails, place[t])
            before[t] = at[k - 1] if k else None
            tails[k : k + 1], at[k : k + 1] = [place[t]], [t]
        held, t = [], at[-1] if at else None
        while t is not None:
            held.append(t)
            t = before[t]
        held.reverse()
    return held


def candidate(events: Events) -> tuple[str, ...]:
    """The words of a page by which it is a copy of another: of its article elements, else outside of side containers;
    or only its longest block of text, if that has half of them."""
    inside = any(in_article and is_text and not in_aside and not token.isspace() for _, token, is_text, in_article, in_aside in events)
    blocks: list[list[str]] = [[]]
    for _, token, is_text, in_article, in_aside in events:
        if not is_text:
            blocks.append([])
        elif not in_aside and (in_article or not inside):
            blocks[-1] += token.split()
    longest = max(blocks, key=len)
    return tuple(longest) if 2 * len(longest) >= sum(map(len, blocks)) else tuple(w for b in blocks for w in b)


Places = tuple[dict[int, list[int]], int]


def within(one: Places, two: Places) -> bool:
    """Whether every instance of a class lies in one slot of another, the same in all pages; a class is the places of its tokens
    by page, and the tokens of an instance. What is before the first and after the last token is one slot."""
    slots = set()
    for page, places in one[0].items():
        if others := two[0].get(page):
            found = [bisect_left(others, p) for p in places]
            if any(found[k] != found[k + one[1] - 1] for k in range(0, len(found), one[1])):
                return False
            slots.update(f % two[1] for f in found[:: one[1]])
    return len(slots) <= 1


class Template:
    """The template of a group of pages: own: its words, with how often a page has them at most."""

    def __init__(self, streams: list[list[Token]]):
        self.own: dict[Token, int] = {}
        #: What comes before and after a token in all places (None where that differs).
        self.before: dict[Token, Token | None] = {}
        self.after: dict[Token, Token | None] = {}
        if len(streams) < SUPPORT:
            return
        vectors: dict[Token, list[int]] = defaultdict(lambda: [0] * len(streams))
        for i, tokens in enumerate(streams):
            for token, n in Counter(tokens).items():
                vectors[token][i] = n
        least = max(SUPPORT, SHARE * len(streams))
        often = {token for token, vector in vectors.items() if len(streams) - vector.count(0) >= least}
        for tokens in streams:
            for one, two in pairwise([None, *tokens, None]):
                if one in often and self.after.setdefault(one, two) != two:
                    self.after[one] = None
                if two in often and self.before.setdefault(two, one) != one:
                    self.before[two] = None
        classes: dict[tuple[int, ...], set[Token]] = defaultdict(set)
        for token in often:
            classes[tuple(vectors[token])].add(token)
        #: The nested classes.
        self.nested: list[Places] = []
        # larger classes first: of more pages, then of more tokens (ties: in the order of the first page that has one)
        for vector, held in sorted(classes.items(), key=lambda c: (c[0].count(0), -len(c[1]))):
            if len(held) >= LEAST_CLASS:
                self._add(held, [(i, tokens, n) for i, (tokens, n) in enumerate(zip(streams, vector, strict=True)) if n])

    def _add(self, held: set[Token], some: list[tuple[int, list[Token], int]]) -> None:
        pages = [(tokens, n) for _, tokens, n in some]
        orders = [[t for t in tokens if t in held] for tokens, _ in pages]
        if all(n == 1 for _, n in pages):
            order = _common(orders)
        else:
            order = orders[0][: len(held)]
            if any(o != order * n for o, (_, n) in zip(orders, pages, strict=True)):
                return
        if len(order) < LEAST_CLASS:
            return
        held = set(order)
        spans = []
        for tokens, _ in pages:
            places = [i for i, t in enumerate(tokens) if t in held]
            spans.append(tokens[places[0] : places[-1] + 1])
        if all(x == spans[0] for x in spans):  # nothing is filled in: a passage that pages share, not their template
            return
        places = {i: [k for k, t in enumerate(tokens) if t in held] for i, tokens, _ in some}, len(order)
        if not all(within(places, other) or within(other, places) for other in self.nested):
            return
        self.nested.append(places)
        most = max(n for _, n in pages)
        self.own.update((t, most) for t in order if not t[1].startswith(("<", "</")) and self._run(t) >= LEAST_CLASS)

    def _run(self, token: Token) -> int:
        """Tokens (as far as they count) that stand together with a word wherever it stands; a tag ends them."""
        n = 1
        for one, other in ((self.before, self.after), (self.after, self.before)):
            t = token
            while n < LEAST_CLASS and (u := one.get(t)) is not None:
                n += 1
                if u[1].startswith("<") or other.get(u) != t:
                    break
                t = u
        return n

    def slots(self, tokens: list[Token]) -> list[bool]:
        """Which tokens of a page are not the template's (a word that always stands between two of its words is)."""
        counts = Counter(t for t in tokens if t in self.own)
        out = [not 0 < counts[t] <= self.own.get(t, 0) for t in tokens]
        for i in range(1, len(tokens) - 1):
            if out[i] and not out[i - 1] and not out[i + 1] and self.after.get(tokens[i - 1]) == tokens[i] == self.before.get(tokens[i + 1]):
                out[i] = False
        return out


def main_text(events: Events, free: list[bool]) -> str:
    """The chosen slots of a page, block by block; free: which of its tokens are in slots."""
    parts, at, inside, outside = [], 0, 0, 0
    for _, token, is_text, in_article, in_aside in events:
        words = token.split() if is_text else [token]
        kept = free[at : at + len(words)]
        at += len(words)
        if is_text and not in_aside:
            inside += in_article * sum(kept)
            outside += (not in_article) * sum(kept)
        if is_text and not all(kept):
            token = " " * token[:1].isspace() + " ".join(w for w, k in zip(words, kept, strict=True) if k) + " " * token[-1:].isspace()
        parts.append((token, is_text, in_article, in_aside))
    whole = outside > TEASER * inside
    blocks, block = [], []
    for token, is_text, in_article, in_aside in [*parts, ("<p>", False, False, False)]:
        if not is_text:
            if joined := " ".join(html.unescape("".join(block)).split()):
                blocks.append(joined)
            block = []
        elif not in_aside and (in_article or whole):
            block.append(token)
    return "\n\n".join(blocks)


def _extract(table: pa.Table) -> pa.Table:
    pages = [parse(x or "") for x in table.column("html").to_pylist()]
    streams = [stream(p) for p in pages]
    found = Template(list({candidate(p): s for p, s in zip(reversed(pages), reversed(streams), strict=True)}.values()))
    texts = [main_text(p, found.slots(s)) for p, s in zip(pages, streams, strict=True)]
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})


def html_extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    arrow_batches(pages.sparkSession)
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1))
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))
    groups = sized(source.groupBy("host").agg(F.ceil(F.count("*") / group).alias("groups")))
    salted = source.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.col("groups")))
    return salted.select("page_id", "url", "html", "host", "salt").groupBy("host", "salt").applyInArrow(_extract, "page_id long, url string, text string, n_chars long")
