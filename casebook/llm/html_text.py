"""Main text of web pages by composite text density.

The markup becomes a tree (implied end tags as in HTML). Subtrees that name
themselves as something else than the article (navigation, page header and footer,
aside, form, script, advert, notice, comments ...) go first. For every node left,
with C characters, LC of them in links, T tags and LT of them links,

    density = C / T * log_b(C / LC * T / LT),  b = ln(C / (C - LC) * LC + LC_body / C_body * C + e) + e - 1

(zero divisors count as one; e - 1 keeps the base from 1), so long text in few tags and few links is dense. The
node with the largest sum of its children's densities is the core of the article.
The least density on the way from the body down to it is the threshold: what hangs
off that way belongs to the article if it is at least as dense. `article` and
`main` elements only say where the text around the core ends: a core within one is
widened to it, and a core (or main) of which articles hold most is narrowed to all of
them (see `_parts`). What is chosen so is kept whole but for its named furniture.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from casebook.llm.batches import slices

TAG = re.compile(r"""</?([A-Za-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
LOOSE_TAG = re.compile(r"</?([A-Za-z][^\s/>]*+)([^>]*+)>")
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe noembed noframes xmp".split())
#: Elements of svg and math whose content is HTML again.
INTEGRATION = frozenset("foreignobject annotation-xml desc title mi mo mn ms mtext".split())
#: A start tag of these ends an open svg or math element.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing main article section "
    "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var nav aside header footer".split()
)
#: Elements of svg and math that are not shown.
UNSEEN = frozenset("desc metadata defs annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table "
    "tbody td tfoot th thead title tr ul caption".split()
)
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - frozenset("body br head html option select title tbody td tfoot th thead tr caption legend".split())
#: A start tag ends an open element of these, as far up as the second set.
#: Stands for all of them among the open elements.
ANY_BLOCK = "#block"
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
}
OTHER_TAGS = frozenset(
    "head nav header footer aside form script style noscript template iframe button select textarea input canvas "
    "object embed audio video dialog menu datalist title".split()
)
#: Words in class, id or role that mark something else than the article.
OTHER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored promo promotion banner sidebar "
    "nav navbar navigation menu breadcrumb breadcrumbs masthead header footer comment comments commentlist disqus respond "
    "reply replies share sharing social related recommended recommendations newsletter subscribe subscription signup login "
    "cookie cookies consent gdpr notice notices alert popup modal overlay widget pager pagination toolbar complementary "
    "contentinfo search dialog copyright skip feedback".split()
)
#: The same within an article, whose own header is called so too.
INNER_WORDS = OTHER_WORDS - {"header"}
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Page:
    """Nodes in document order (parents first), and the pieces of text with the node that holds them."""

    def __init__(self, markup: str):
        self.tag, self.parent, self.words = ["#root"], [-1], [frozenset()]
        self.foreign = [False]  # svg, math and what they hold
        self.pieces: list[tuple[int, str]] = []
        self.open: dict[str, list[tuple[int, int]]] = {}  # by name: places in the stack of its open elements
        self._read(markup)

    def _add(self, tag: str, parent: int, rest: str) -> int:
        words: frozenset[str] = frozenset()
        if rest and ("=" in rest):
            named = NAMES.findall(rest)
            if named:
                words = frozenset(w.lower() for x in named for w in WORD.findall(x[1] or x[2] or x[3]))
        self.tag.append(tag)
        self.parent.append(parent)
        self.words.append(words)
        self.foreign.append(tag in ("svg", "math") or self._in_foreign(parent))
        return len(self.tag) - 1

    def _in_foreign(self, node: int) -> bool:
        return self.foreign[node] and self.tag[node] not in INTEGRATION

    def _text(self, node: int, text: str) -> None:
        if text:
            self.pieces.append((node, html.unescape(text) if "&" in text else text))

    def _read(self, markup: str) -> None:
        stack, at, n = [0], 0, len(markup)
        while at < n:
            lt = markup.find("<", at)
            if lt < 0:
                self._text(stack[-1], markup[at:])
                return
            self._text(stack[-1], markup[at:lt])
            following = markup[lt + 1 : lt + 2]
            if following in ("!", "?"):
                if markup.startswith("<!--", lt):
                    end = markup.find("-->", lt + 4)
                    at = n if end < 0 else end + 3
                else:
                    end = markup.find(">", lt)
                    at = n if end < 0 else end + 1
                continue
            found = None
            if following.isalpha() or following == "/":
                found = TAG.match(markup, lt) or LOOSE_TAG.match(markup, lt)
                if not found and markup.find(">", lt) < 0:  # no tag ends any more
                    self._text(stack[-1], markup[lt:])
                    return
            if not found:
                self._text(stack[-1], "<")
                at = lt + 1
                continue
            at = found.end()
            tag = found[1].lower()
            if following == "/":
                self._close(stack, tag)
                continue
            self._open(stack, tag, found[2])
            if tag in RAW and not found[2].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(markup, at)
                stack.pop()
                if not end:
                    return
                close = markup.find(">", end.end())
                at = n if close < 0 else close + 1

    def _open(self, stack: list[int], tag: str, rest: str) -> None:
        if tag in ("html", "body") and any(self.tag[i] == tag for i in stack):
            return
        if tag == "body":
            self._up_to(stack, "head")
        if tag in BREAKOUT:
            while self._in_foreign(stack[-1]):
                stack.pop()
        if tag in ENDS_P:
            k = self._last(stack, "p")
            if k and k >= self._last(stack, ANY_BLOCK):
                self._break(stack[k])
                del stack[k:]
        if tag in SIBLINGS:
            ended, limit = SIBLINGS[tag]
            low = max(self._last(stack, name) for name in limit)
            for name in ended:
                while (k := self._last(stack, name)) > low:
                    del stack[k:]
        node = self._add(tag, stack[-1], rest)
        if tag in BLOCK or (tag == "text" and self.foreign[node]):
            self._break(node)
        # Only in svg and math a slash closes an element. Raw text is taken off the stack by the caller.
        if tag not in VOID and not (self.foreign[node] and rest.endswith("/") and tag not in RAW):
            for name in (tag, ANY_BLOCK) if tag in BLOCK else (tag,):
                self._last(stack, name)
                self.open.setdefault(name, []).append((len(stack), node))
            stack.append(node)

    def _last(self, stack: list[int], name: str) -> int:
        """Place in the stack of the innermost open element of a name; 0 without one.

        Elements that were closed since are forgotten when they are met, so this costs no walk.
        """
        places = self.open.get(name, [])
        while places and (places[-1][0] >= len(stack) or stack[places[-1][0]] != places[-1][1]):
            places.pop()
        return places[-1][0] if places else 0

    def _close(self, stack: list[int], tag: str) -> None:
        if tag == "br":
            self._break(stack[-1])
        k = self._last(stack, tag)
        # An end tag without its element does nothing, and an inline one does not end blocks.
        if k and (tag in BLOCK or k >= self._last(stack, ANY_BLOCK)):
            if tag in BLOCK or (tag == "text" and self.foreign[stack[k]]):
                self._break(stack[k])
            del stack[k:]

    def _up_to(self, stack: list[int], tag: str) -> None:
        """Close the outermost open element of a name."""
        if self._last(stack, tag):
            del stack[self.open[tag][0][0] :]

    def _break(self, node: int) -> None:
        self.pieces.append((node, "\n"))

    def main_text(self) -> str:
        """The article's blocks in page order, white space turned into single spaces."""
        tag, parent, n = self.tag, self.parent, len(self.tag)
        size = [0] * n
        for node, text in self.pieces:
            size[node] += len(text) - text.count(" ") - text.count("\n")
        whole = size[:]
        for i in range(n - 1, 0, -1):
            whole[parent[i]] += whole[i]
        mark, inside, best = self._marks(whole)
        keep = [False] * n  # the largest marks and what holds them are no furniture
        for i in best:
            while i >= 0 and not keep[i]:
                keep[i] = True
                i = parent[i]
        gone = [False] * n
        remark = [bool(w & COMMENT_WORDS) for w in self.words]
        for i in range(1, n):
            remark[i] = remark[i] or remark[parent[i]]
        half = sum(s for s, r in zip(size, remark, strict=True) if not r) / 2
        unmarked = not best or whole[best[0]] < half / 5
        for i in range(1, n):
            gone[i] = gone[parent[i]] or (not keep[i] and self._other(i, inside[i], unmarked and whole[i] > half))
        self._trim_headers(gone, inside)
        body = next((i for i in range(n) if tag[i] == "body"), 0)
        chars = [0 if g else s for g, s in zip(gone, size, strict=True)]
        tags, links, link_chars, in_link = [0] * n, [0] * n, [0] * n, [False] * n
        for i in range(1, n):
            in_link[i] = tag[i] == "a" or in_link[parent[i]]
            if in_link[i]:
                link_chars[i] = chars[i]
        for i in range(n - 1, 0, -1):
            if not gone[i]:
                p = parent[i]
                chars[p] += chars[i]
                link_chars[p] += link_chars[i]
                tags[p] += tags[i] + (not self.foreign[i])
                links[p] += links[i] + (tag[i] == "a")
        if not chars[body]:
            return ""
        share = link_chars[body] / chars[body]
        outside = [g or f for g, f in zip(gone, self.foreign, strict=True)]
        density = [0.0 if o else composite(*x, share) for o, *x in zip(outside, chars, link_chars, tags, links, strict=True)]
        total = [0.0] * n
        for i in range(1, n):
            total[parent[i]] += density[i]
        below = [False] * n
        for i in range(n):
            below[i] = i == body or (i > 0 and below[parent[i]])
        core = max((i for i in range(n) if below[i] and not outside[i]), key=lambda i: (total[i], -i))
        parts = self._parts(core, [m and b and not g for m, b, g in zip(mark, below, gone, strict=True)], chars)
        i = max(parts, key=lambda i: (chars[i], -i))
        threshold = density[i]
        while i != body:
            i = parent[i]
            threshold = min(threshold, density[i])
        on_way, whole_parts = set(), set(parts)
        for i in parts:
            while i != body and parent[i] not in on_way:
                i = parent[i]
                on_way.add(i)
        taken = [False] * n
        for i in range(n):
            if gone[i] or not below[i]:
                continue
            if i in on_way or i in whole_parts:
                taken[i] = True
            elif parent[i] in on_way:
                taken[i] = density[i] >= threshold
            else:
                taken[i] = taken[parent[i]]
        out = "".join([text for node, text in self.pieces if taken[node]])
        return " ".join(out.split())

    def _marks(self, whole: list[int]) -> tuple[list[bool], list[bool], list[int]]:
        """Article and main elements that are not comments and not in page furniture, and what lies in them.

        The last list has the largest of them and the largest article within it.
        """
        n = len(self.tag)
        mark, inside, outer = [False] * n, [False] * n, [False] * n
        for i in range(1, n):
            p = self.parent[i]
            outer[i] = outer[p] or self.tag[i] in ("nav", "aside", "footer", "head") or bool(self.words[i] & COMMENT_WORDS)
            mark[i] = self.tag[i] in ("article", "main") and not outer[i] and whole[i] > 0
            inside[i] = mark[i] or inside[p]
        best = max((i for i in range(n) if mark[i]), key=lambda i: (whole[i], -i), default=-1)
        if best < 0:
            return mark, inside, []
        within = [False] * n
        for i in range(best + 1, n):
            within[i] = self.parent[i] == best or within[self.parent[i]]
        inner = max((i for i in range(n) if within[i] and mark[i] and self.tag[i] == "article"), key=lambda i: (whole[i], -i), default=best)
        return mark, inside, [best, inner]

    def _parts(self, core: int, mark: list[bool], chars: list[int]) -> list[int]:
        """The subtrees that the core stands for.

        The outermost article or main around the core, else the core itself; but where
        articles (or mains) below that hold most of its text, and the core if it lies
        below, all of those. An article's sibling articles are parts like it.
        """
        parent, n = self.parent, len(self.tag)
        top, i = core, core
        while i >= 0:
            if mark[i]:
                top = i
            i = parent[i]
        outermost: list[list[int]] = [[] for _ in range(n)] if top != core or any(mark[core + 1 :]) else []
        holder = [0] * n  # the nearest article, main or `top` around a node
        if outermost:
            for i in range(1, n):
                p = parent[i]
                holder[i] = p if mark[p] or p == top else holder[p]
                if mark[i]:
                    outermost[holder[i]].append(i)
        around = set()
        i = core
        while i >= 0:
            around.add(i)
            i = parent[i]
        parts, left = [], [top]
        while left:
            i = left.pop()
            inner = outermost[i] if outermost and self.tag[i] != "article" else []
            lost = core != i and i in around and not any(x in around for x in inner)
            if not inner or lost or 2 * sum(chars[x] for x in inner) <= chars[i]:
                parts.append(i)
            else:
                left += inner
        beside = {parent[i] for i in parts if self.tag[i] == "article"}
        return sorted({*parts, *(i for i in range(1, n) if mark[i] and self.tag[i] == "article" and parent[i] in beside)})

    def _other(self, i: int, in_article: bool, is_most: bool) -> bool:
        """Whether the node is something else than article text.

        `is_most`: the page has no marked article, or only a small one, and this node holds most of its
        text. Then a class like has-sidebar, or a form around everything, says little.
        """
        tag, words = self.tag[i], self.words[i]
        if self.foreign[i] and tag in UNSEEN:
            return True
        if tag == "header" and in_article:
            return False  # its headings stay
        if tag in ("html", "body"):
            return False
        if is_most and not words & COMMENT_WORDS:
            return tag in OTHER_TAGS and tag != "form"
        return tag in OTHER_TAGS or bool(words & (INNER_WORDS if in_article else OTHER_WORDS))

    def _trim_headers(self, gone: list[bool], inside: list[bool]) -> None:
        """Of an article's own header only the headings stay."""
        n, header, in_heading, holds = len(self.tag), [0] * len(self.tag), [False] * len(self.tag), [False] * len(self.tag)
        for i in range(1, n):
            p = self.parent[i]
            header[i] = i if self.tag[i] == "header" and inside[i] else header[p]
            in_heading[i] = self.tag[i] in HEADINGS or in_heading[p]
        if not any(header):
            return
        for i in range(n - 1, 0, -1):
            holds[i] = holds[i] or self.tag[i] in HEADINGS
            if holds[i]:
                holds[self.parent[i]] = True
        for i in range(1, n):
            gone[i] = gone[i] or gone[self.parent[i]] or bool(header[i] and not holds[i] and not in_heading[i])


def composite(chars: int, link_chars: int, tags: int, links: int, share: float) -> float:
    if not chars:
        return 0.0
    tags = tags or 1
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e) + math.e - 1
    ratio = chars / max(link_chars, 1) * tags / max(links, 1)
    return chars / tags * math.log(max(ratio, 1.0)) / math.log(base)


def main_text(markup: str) -> str:
    return Page(markup).main_text() if markup else ""


def main_texts(pages: DataFrame) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): the main text and its length in code points.

    Null or empty markup, and a page without an article, give the empty text. Null
    ids and urls and repeated rows pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html", 4 << 20):
                texts = [main_text(x) for x in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                    names=["page_id", "url", "text", "n_chars"],
                )

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
