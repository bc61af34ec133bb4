"""Main text of web pages by two passes of block rules.

The markup is cut into blocks (paragraphs, headings, list items, cells). Scripts, styles,
controls and hidden parts give no blocks. Parts that the markup names as something else than
the article (menus, footers, side bars, notices, adverts, forms, reader comments) are left
out, unless they hold most of the page's long text dense in stop words, or its articles. Any such
word in a name counts, but for names that tell whether the page has such a part, or its topic.
The first pass looks at each block alone: much of it in links is bad, long text dense in stop
words is good, the rest is undecided. In the second pass undecided blocks take the label of
the nearest decided block; those in an article stay, as only links are bad there. Blocks outside
the articles of a page that marks some need good blocks of their own.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import map_rows

# Frequent function words of the four languages in the tables.
STOP_WORDS = frozenset(
    """a an and are as at be but by for from had has have he her his i if in is it its not of on or she so that the their
    them they this to was we were which will with you
    au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas pour qu que qui
    sa se ses son sont sur un une vous
    aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich ihr im ist
    mit nach nicht noch nur oder sich sie sind so über um und uns vom von vor war werden wie wir zu zum zur
    al como con cuando del desde donde el ella ellos entre era esta este fue ha hasta hay las lo los más me mi muy no nos o
    para pero por porque quien ser si sin sobre su sus también tiene todo una uno y ya""".split()
)

# Elements that begin and end a block.
BLOCK_TAGS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
    form frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table
    tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Elements whose content is never article text.
DROP_TAGS = frozenset(
    """button canvas datalist embed frameset head iframe input label menu noframes noscript object option
    script select style svg template textarea title""".split()
)
# Elements whose content is article text only where most of the page's text is in them.
DOUBTED_TAGS = frozenset("aside dialog footer form nav".split())
ARTICLE_TAGS = frozenset("article main".split())
# Words of class and id that name parts outside the article.
DROP_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent
    cookie cookies disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter newsletters notice notices
    notification outbrain pager pagination paywall popup promo promoted promotion recommended related replies reply respond share
    sharing sidebar signup skip social sponsor sponsored subscribe subscription taboola toolbar widget widgets""".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
# Those that also count at an end of a longer word: usercomments, cookiebar.
JOINED_WORDS = ("advertisement", "breadcrumb", "breadcrumbs", "comments", "commentlist", "cookie", "cookies", "disqus", "navbar", "newsletter", "sidebar")
# Words before one of those, or last after it, that tell of the page instead: no-sidebar, category-social, comments-open.
OTHERWISE_BEFORE = frozenset("can category disable disabled enable enabled has have hide is no non not show supports tag topic type with without".split())
OTHERWISE_LAST = frozenset("allowed closed disabled enabled free layout less off open opened".split())
# Elements whose names must speak of nothing else: a paragraph or a heading may be about adverts.
TEXT_TAGS = frozenset("a abbr b blockquote cite code em figcaption h1 h2 h3 h4 h5 h6 i mark p pre q small span strong sub sup time u".split())
# Words that say nothing beside one of those, in names of such elements: comment-item, related-link.
LAYOUT_WORDS = frozenset(
    """area article articles bar block bottom box column container entry form global inline inner item items left link links list
    main outer page panel post posts primary right secondary section site slot top unit wrap wrapper zone""".split()
)
DROP_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search".split())
ARTICLE_WORDS = frozenset("articlebody content entry post story".split())
_WORD = re.compile(r"[^\W\d_]+")
_NAME = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

#: Characters from which a block is long; share of stop words; share of characters in links, outside and inside an article.
LONG, DENSE, LINKED, LINKED_INSIDE = 70, 0.2, 0.33, 0.95
#: Good blocks from which a part is more than a notice.
BODY = 3


#: Not dropped, container 0, not in a link, in no doubted part.
START = (False, 0, False, -1)


def _drop_words(of: list[str], alone: bool) -> set[str]:
    """The words of a name that say it is no article's: user-comments, comments-v2, cookie-policy-bar; none in no-sidebar or comments-open.

    With `alone`, only if the whole name speaks of such a part.
    """
    found = set()
    for i, word in enumerate(of):
        if word not in DROP_WORDS:
            joined = next((w for w in JOINED_WORDS if word.startswith(w) or word.endswith(w)), None)
            if joined is None or word.removesuffix(joined) in OTHERWISE_BEFORE:
                continue
            word = joined
        if not OTHERWISE_BEFORE.intersection(of[:i]) and of[-1] not in OTHERWISE_LAST:
            found.add(word)
    return found if found and not (alone and not DROP_WORDS | LAYOUT_WORDS >= set(of)) else set()


class _Blocks(HTMLParser):
    """Blocks of a page: [text, characters in links, container]; container 0 is outside any article.

    doubted: the parts that the markup names as something else, [part around it, or -1; articles in it;
    whether it is named as comments]; inside: the innermost such part of each block, or -1.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[list] = []
        self.inside: list[int] = []
        self.stack: list[tuple[str, bool, int, bool, int]] = []  # tag, dropped, container, in a link, part
        self.state = START
        self.doubted: list[list] = []
        self.parts: list[str] = []
        self.linked = 0
        self.containers = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.blocks.append([text, self.linked, self.state[1]])
            self.inside.append(self.state[3])
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in BLOCK_TAGS:
            self._implied_end(tag)
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID_TAGS:
            return
        dropped, container, link, part = self.state
        if not dropped:
            dropped = self._dropped(tag, dict(attrs))
        if not dropped:
            doubt = self._doubted(tag, dict(attrs), container)
            if doubt:
                self.doubted.append([part, 0, doubt == "comments"])
                part = len(self.doubted) - 1
        if tag in ARTICLE_TAGS and not dropped and not container and not self._in_comments(part):
            self.containers += 1
            container = self.containers
            if part >= 0:
                self.doubted[part][1] += 1
        self.stack.append((tag, dropped, container, link or tag == "a", part))
        self.state = self.stack[-1][1:]

    handle_startendtag = handle_starttag

    def _in_comments(self, part: int) -> bool:
        """Whether the part, or one around it, is named as comments: articles in there are readers'."""
        while part >= 0:
            part, _, comments = self.doubted[part]
            if comments:
                return True
        return False

    def _implied_end(self, tag: str) -> None:
        """A block ends an open paragraph; an item, row or cell ends an open one of its kind."""
        ends = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
        fence = ("ul", "ol", "dl", "table", "article", "main", "section", "div", "body", "select")
        for i in range(len(self.stack) - 1, -1, -1):
            name = self.stack[i][0]
            if name == "p" or name in ends:
                self._close(i)
                return
            if name in fence:
                return

    def _close(self, i: int) -> None:
        del self.stack[i:]
        self.flush()
        self.state = self.stack[-1][1:] if self.stack else START

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in BLOCK_TAGS or any(t in BLOCK_TAGS for t, *_ in self.stack[i:]):
                    self._close(i)
                else:
                    del self.stack[i:]
                    self.state = self.stack[-1][1:] if self.stack else START
                return
        if tag in BLOCK_TAGS:
            self.flush()

    def handle_data(self, data):
        dropped, _, link, _ = self.state
        if not dropped:
            self.parts.append(data)
            if link:
                self.linked += len("".join(data.split()))

    @staticmethod
    def _dropped(tag: str, attrs: dict) -> bool:
        if tag in DROP_TAGS:
            return True
        if tag in ("html", "body") or tag in ARTICLE_TAGS:
            return False
        style = (attrs.get("style") or "").replace(" ", "").lower()
        return "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or "display:none" in style or "visibility:hidden" in style

    @staticmethod
    def _doubted(tag: str, attrs: dict, container: int) -> str:
        """Whether the markup names the part as something else than the article: "comments", "other" or ""."""
        if tag in ("html", "body", "main"):
            return ""
        tokens = _CAMEL.sub("-", f"{attrs.get('class') or ''} {attrs.get('id') or ''}").lower().split()
        named = [_NAME.findall(t) for t in tokens]
        words = set().union(*(_drop_words(of, tag in TEXT_TAGS) for of in named))
        if words & COMMENT_WORDS:
            return "comments"
        if tag in ARTICLE_TAGS:
            return ""
        if tag in DOUBTED_TAGS or (tag == "header" and not container) or (attrs.get("role") or "").lower() in DROP_ROLES or words:
            return "other"
        header = any("header" in of and set(of) <= LAYOUT_WORDS | {"header"} for of in named)
        return "other" if header and not container and not ARTICLE_WORDS.intersection(sum(named, [])) else ""

    def kept(self) -> list[list]:
        """The blocks outside doubted parts, and inside those that hold most of the good text, or all articles and half of it.

        Beside an article, a doubted part also needs BODY good blocks: one is a notice or an imprint.
        """
        n, sizes, articles = len(self.doubted), [], [d[1] for d in self.doubted]
        for text, linked, container in self.blocks:
            sizes.append(len(text) if _label(text, linked, container) else 0)
        total, held, blocks = sum(sizes), [0] * n, [0] * n
        for size, part in zip(sizes, self.inside):
            if part >= 0 and size:
                held[part] += size
                blocks[part] += 1
        good = [True] * n
        for i in range(n - 1, -1, -1):  # a part comes after the one around it
            around = self.doubted[i][0]
            if around >= 0:
                held[around] += held[i]
                blocks[around] += blocks[i]
                articles[around] += articles[i]
        for i, (around, _, comments) in enumerate(self.doubted):
            most = held[i] == total > 0 if comments else 2 * held[i] > total
            most = most and (articles[i] == self.containers or blocks[i] >= BODY)
            alone = self.containers and articles[i] == self.containers and 2 * held[i] >= total
            good[i] = bool(most or alone) and (around < 0 or good[around])
        return [b for b, part in zip(self.blocks, self.inside) if part < 0 or good[part]]


def _label(text: str, linked: int, container: int) -> bool | None:
    """First pass: good, bad or undecided, from the block alone.

    Links make a block bad, in an article only where nothing else is in it and it does not read
    as running text. Long text dense in stop words is good. Other text, as figures, names or
    a language without stop words here, is undecided, however long.
    """
    size, words = max(1, len(text.replace(" ", ""))), _WORD.findall(text.lower())
    running = len(text) >= LONG and sum(w in STOP_WORDS for w in words) >= DENSE * max(1, len(words))
    if linked / size > (LINKED_INSIDE if container else LINKED):
        return True if container and running else False
    return True if running else False if linked and not container and len(text) < LONG else None


def main_text(markup: str) -> str:
    """The blocks of the article, joined by two line ends."""
    page = _Blocks()
    page.feed(markup)
    page.close()
    page.flush()
    blocks = page.kept()
    marked = any(c for *_, c in blocks)  # the page marks its article
    labels = [_label(*b) for b in blocks]
    if not marked and not any(labels):  # no text known as such: the long blocks are it
        labels = [True if x is None and len(b[0]) >= LONG else x for x, b in zip(labels, blocks)]
    decided = [i for i, x in enumerate(labels) if x is not None]
    final, k = [], 0
    for i, x in enumerate(labels):
        if x is None:
            while k < len(decided) and decided[k] < i:
                k += 1
            near = [j for j in (*decided[max(0, k - 1) : k], *decided[k : k + 1]) if blocks[j][2] == blocks[i][2]]
            best = min((abs(j - i) for j in near), default=0)
            # in an article, a link beside a block says nothing about it
            x = bool(blocks[i][2]) or (any(labels[j] for j in near if abs(j - i) == best) if near else not (decided or marked))
        final.append(x)
    return "\n\n".join(b[0] for b, x in zip(blocks, final) if x)


def html_text(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text, n_chars: one row per row of pages.

    Null or empty markup gives the empty text, as does a page without article blocks;
    null ids and urls pass through, and plain text without markup is one block. Repeated rows
    are rows, an empty table gives no rows, pages of any length are read whole, and other
    columns of pages, whatever their names, play no part.
    """

    def make():
        def work(page_id, url, html):
            texts = [main_text(h) for h in html]
            return {"page_id": page_id, "url": url, "text": texts, "n_chars": [len(t) for t in texts]}

        return work

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    return map_rows(rows, make, "page_id long, url string, text string, n_chars long")
