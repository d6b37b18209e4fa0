"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block-level tags (and
their classes) from the root to it. Length and punctuation are summed up by
path and divided by the number of blocks, each path's ratios are smoothed with
those of the paths beside it, and the two are fused into a score. Paths above
a threshold are content, and so is the title. The innermost path that holds
them all, or the article or main element around it, is the article. All its
blocks are taken but those under tags or names that mark menus, notices,
adverts, comments and the like. A name does so if all of it is known
(``comment-list``); one with a known word in it (``social-impact``) only if what
is under it has the ratios of a menu: mostly links, or no punctuation at all. Names of
headings, paragraphs and quotes say nothing.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from logweir.llm import arrow_text
from logweir.llm.common import map_arrow

# Kinds of HTML elements.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q s samp small span strike"
    " strong sub sup time tt u var wbr meta link".split()
)
SILENT = set("script style title noscript template iframe object textarea select button head canvas audio video".split())
#: Silent elements whose inside is no markup.
RAW = set("script style title textarea iframe noscript".split())
#: What formulas and drawings say besides what they show.
UNSEEN = set("annotation annotation-xml desc metadata".split())
#: Parts of formulas and drawings: like inline elements, but words don't run on through them.
DRAWN = set(
    "math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle"
    " msub msubsup msup mtable mtd mtext mtr munder munderover none semantics svg circle clippath defs ellipse filter foreignobject g image"
    " line lineargradient marker mask path pattern polygon polyline radialgradient rect stop switch symbol text textpath tspan use view"
    " animate animatemotion animatetransform mpath set".split()
)
ALONE = set("br hr img input meta link area base col embed param source track wbr".split())
#: What an opening tag ends if it is open.
ENDS = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
#: Parts of an article, never an article themselves.
PARTS = set("p h1 h2 h3 h4 h5 h6 li ul ol dl dd dt blockquote pre table tbody thead tfoot tr td th figure figcaption hgroup header".split())
MARGINAL = set("nav footer aside form menu dialog fieldset".split())
ARTICLE = set("article main".split())
MARGINAL_WORDS = set(
    "ad ads adv advert advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice"
    " alert popup modal overlay newsletter subscribe subscription signup login menu nav navbar navigation breadcrumb breadcrumbs"
    " masthead topbar footer foot sidebar side widget related recommended recommendations share sharing social comment comments"
    " disqus reply replies respond pagination pager toolbar skip copyright legal complementary contentinfo search form".split()
)
#: Words that make no other thing of a marginal one.
PLAIN_WORDS = set(
    "list lists post posts box boxes area section wrap wrapper container block blocks button buttons link links item items bar panel slot unit"
    " inner outer row col column group site page main global left right top bottom primary secondary article story entry content body icons text".split()
)
#: Parts whose names are never evidence.
PROSE = set("p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption hgroup tr td th tbody".split())
#: Marginal at the top of a page, but not inside an article.
TOP_WORDS = set("header head banner".split())
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？]")
#: A path is content from this share of the best score on.
THRESHOLD = 0.1

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)


def _is_known(name: str, inside: bool) -> bool:
    """Whether all of a class name or id stands for something marginal."""
    words = [word for word in re.split(r"[^a-z]+", name) if word]
    marks = [word for word in words if word in MARGINAL_WORDS or not inside and word in TOP_WORDS]
    return bool(marks) and all(word in marks or word in PLAIN_WORDS for word in words)


class _Page:
    """Blocks of one page, with paths as numbers; a path knows the one above it."""

    def __init__(self):
        self.numbers: dict[tuple[int, str], int] = {}
        self.above = [-1]
        self.marginal = [False]
        self.suspect: list[int] = []
        self.article = [False]
        self.holds = [False]
        self.tags = [""]
        self.blocks: list[tuple[int, str, int]] = []  # path, text, characters in links
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]  # tag, path, silent
        self.names: Counter[str] = Counter()
        self.parts: list[str] = []
        self.heads = 0
        self.link_begin, self.link_size = -1, 0
        self.size = 0

    def text(self, raw: str) -> None:
        if raw and not self.open[-1][2]:
            self.parts.append(raw)
            self.size += len(raw)

    def link(self, begins: bool) -> None:
        if self.link_begin >= 0:
            self.link_size += self.size - self.link_begin
        self.link_begin = self.size if begins else -1

    def flush(self) -> None:
        self.link(False)
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.blocks.append((self.open[-1][1], text, min(self.link_size, len(text))))
        self.parts, self.size, self.link_size = [], 0, 0

    def begin(self, tag: str, attributes: str) -> None:
        for name in ENDS.get(tag, {"p"}):
            if self.names[name] and self._near(name):
                self.end(name)
        names: set[str] = set()
        hidden = False
        if attributes:
            for name, value in _ATTRIBUTE.findall(attributes):
                value = value.strip("\"'").lower()
                hidden |= name.lower() == "hidden" and value != "until-found" or name.lower() == "aria-hidden" and value == "true"
                names.update(value.split() if name.lower() in ("class", "id", "role") else ())
        _, path, silent = self.open[-1]
        key = path, f"{tag}.{'.'.join(sorted(names))}"
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.above)
            inside = self.article[path]
            is_article = tag in ARTICLE or "main" in names
            evidence = set() if tag in PROSE else names
            marginal = tag in MARGINAL or not inside and tag == "header" or any(_is_known(name, inside) for name in evidence)
            if not marginal and MARGINAL_WORDS & {word for name in evidence for word in re.split(r"[^a-z]+", name)}:
                self.suspect.append(number)
            self.above.append(path)
            self.tags.append(tag)
            self.marginal.append(self.marginal[path] or marginal and tag not in ("html", "body"))
            self.article.append(inside or is_article)
            self.holds.append(is_article)
        self.open.append((tag, number, silent or hidden or tag in SILENT))
        self.heads += tag == "h1" and not self.marginal[number]
        self.names[tag] += 1

    def _near(self, name: str) -> bool:
        """Whether ``name`` is open with no table or list around what lies between."""
        for tag, _, _ in reversed(self.open):
            if tag == name:
                return True
            if tag in ("table", "ul", "ol", "dl", "article", "section", "body"):
                return False
        return False

    def end(self, tag: str) -> None:
        if self.names[tag]:
            while True:
                closed = self.open.pop()[0]
                self.names[closed] -= 1
                if closed == tag:
                    break


def _judge_suspects(page: _Page) -> None:
    """Mark what is under a doubtful name as marginal if it has the ratios of a menu."""
    if not page.suspect:
        return
    n = len(page.above)
    size, linked, marked = [0] * n, [0] * n, [False] * n
    for path, text, in_links in page.blocks:
        size[path] += len(text)
        linked[path] += in_links
        marked[path] = marked[path] or bool(PUNCTUATION.search(text))
    # Paths are numbered from the root down.
    for path in range(n - 1, 0, -1):
        above = page.above[path]
        size[above] += size[path]
        linked[above] += linked[path]
        marked[above] = marked[above] or marked[path]
    for path in page.suspect:
        page.marginal[path] |= 2 * linked[path] > size[path] or not marked[path]
    for path in range(1, n):
        page.marginal[path] |= page.marginal[page.above[path]]


def _hides(attributes: str) -> bool:
    found = [(name.lower(), value.strip("\"'").lower()) for name, value in _ATTRIBUTE.findall(attributes)]
    return any(name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" for name, value in found)


def _read(content: str) -> _Page:
    page, at = _Page(), 0
    unended: set[str] = set()

    def end_of(tag: str, at: int) -> int | None:
        """Where the next closing tag ends; that there is none is found out once."""
        found = None if tag in unended else re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(content, at)
        if found is None:
            unended.add(tag)
        return found and found.end()

    while found := _TOKEN.search(content, at):
        page.text(content[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if tag in RAW and not closing:
            at = end_of(tag, at) or len(content)
        elif tag in UNSEEN or tag == "svg" and _hides(attributes):
            if not closing and not attributes.endswith("/"):
                at = end_of(tag, at) or at
        elif tag in DRAWN:
            page.text(" ")
        elif tag == "a":
            page.link(not closing)
        elif tag == "br":
            page.text(" ")
        elif tag in INLINE:
            continue
        elif tag in ALONE:
            page.flush()
        else:
            page.flush()
            page.end(tag) if closing else page.begin(tag, attributes)
    page.text(content[at:])
    page.flush()
    _judge_suspects(page)
    return page


def _scores(page: _Page) -> dict[int, float]:
    """The fused score of each path that has text of its own."""
    length: Counter[int] = Counter()
    marks: Counter[int] = Counter()
    nodes: Counter[int] = Counter()
    for path, text, linked in page.blocks:
        length[path] += len(text) - linked
        marks[path] += len(PUNCTUATION.findall(text))
        nodes[path] += 1
    own = {path: (length[path] / n, marks[path] / n) for path, n in nodes.items()}
    beside: dict[int, list[int]] = {}
    for path in own:
        beside.setdefault(page.above[path], []).append(path)
    scores = {}
    for path, (text, mark) in own.items():
        others = beside[page.above[path]]
        text = (text + sum(own[p][0] for p in others) / len(others)) / 2
        mark = (mark + sum(own[p][1] for p in others) / len(others)) / 2
        prior = 0.0 if page.marginal[path] else 2.0 if page.article[path] else 1.0
        scores[path] = prior * text * (1.0 + mark)
    return scores


def main_text(html_text: str) -> str:
    """The article of a page: its blocks in page order, one per line; empty if there is none."""
    page = _read(html_text)
    scores = _scores(page)
    least = THRESHOLD * max(scores.values(), default=0.0)
    content = {path for path, score in scores.items() if score > 0 and score >= least}
    if not content:
        return ""
    # The only h1 of a page is its title, as is each one inside an article.
    titles = {path for path, _, _ in page.blocks if page.tags[path] == "h1" and not page.marginal[path]}
    content |= {path for path in titles if page.article[path] or page.heads == 1}
    article = content.pop()
    for path in content:
        # Paths are numbered from the root down, so the later one of two is not above the other.
        while path != article:
            path, article = min(path, article), page.above[max(path, article)]
    while page.tags[article] in PARTS:
        article = page.above[article]
    around = article
    while around >= 0 and not page.holds[around]:
        around = page.above[around]
    article = article if around < 0 else around
    kept = [False] * len(page.above)
    for path in range(len(kept)):
        kept[path] = path == article or page.above[path] >= 0 and kept[page.above[path]]
    return "\n".join(text for path, text, _ in page.blocks if kept[path] and not page.marginal[path])


def extract_main_text(pages: DataFrame, content: str = "html") -> DataFrame:
    """``pages`` without the column ``content``, with ``text`` and ``n_chars`` (code points).

    The whole page is read; null counts as empty, which gives empty text. Other
    columns are kept; ones named like the new columns are replaced.
    """
    kept = [name for name in pages.columns if name not in (content, "text", "n_chars")]
    rows = pages.select(*kept, F.col(content).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrow_text.slices(batch, "html"):
                texts = [main_text(page) for page in arrow_text.texts(part.column("html"))]
                new = [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
                yield pa.RecordBatch.from_arrays([*part.select(kept).columns, *new], [*kept, "text", "n_chars"])

    return map_arrow(rows, run, StructType([*rows.select(*kept).schema.fields, StructField("text", StringType()), StructField("n_chars", LongType())]))
