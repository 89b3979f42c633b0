"""Main text of HTML pages: parser events, text-to-tag ratios per line, Gaussian smoothing and threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ROW, packed, unpacked

OUTPUTS = ["text", "n_lines", "n_content_lines"]

# HTML element names and common class names by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset(
    "script style noscript template svg math head title select datalist button textarea iframe object audio video canvas".split())
ASIDES = frozenset("nav aside footer dialog menu".split())
SECTIONS = frozenset("html body article main section div header table tbody thead tfoot tr td th ul ol dl blockquote figure details center".split())
OPENED = SECTIONS | DROPPED | ASIDES | {"form"}
#: Parts of a text rather than of a page: they belong to the section around them unless they are mostly link. Cells do so inside an article
#: only, as tables outside may lay out the page.
FLOW = frozenset("ul ol dl blockquote figure details".split())
CELLS = frozenset("table tbody thead tfoot tr td th header".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
CLUTTER = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar side aside widget menu nav navbar "
    "navigation breadcrumb breadcrumbs pagination pager tabs toolbar footer foot copyright cookie cookies consent gdpr notice notices alert popup modal "
    "overlay newsletter subscribe signup login comment comments commentlist respond disqus replies reply related recommended share sharing social "
    "masthead topbar skip search form".split())
#: Of these, what readers, advertisers or lawyers wrote: however long, it is no main text beside any other text.
FOREIGN = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr comment comments commentlist respond disqus "
    "replies reply".split())
#: Fewest words of a line that is text rather than a label.
RUNNING = 3
#: First words of names that tell what an element has or lacks, not what it is (has-sidebar, no-comments).
STATES = frozenset("has have no not non with without show hide hides".split())
#: Text under a flag counts as one part in so many, text in an article or main element so many times, when flags are judged.
WHOLE_NAME, PART_OF_NAME, OTHER_FLAG, IN_ARTICLE = 8.0, 4.0, 4.0, 4.0
_WORD = re.compile(r"[A-Za-z0-9]+")
_SPACE = re.compile(r"\s+")


@dataclass
class Line:
    """A block's text, its tags, its characters inside links (none for a first heading), and the section it stands in."""

    text: str
    tags: int
    linked: int
    section: int
    in_article: bool


@dataclass
class Flag:
    """An element that its name, role, class or id marks as no main text: its lines, the flag around it (-1: none), how much less its text
    counts, whether it is a hint only (class, id, form), whether its name says that others wrote its text, whether it holds an article or
    main element."""

    first: int
    around: int
    cost: float
    hint: bool
    foreign: bool
    holds: bool
    last: int = -1


class LineParser(HTMLParser):
    """Turns parser events into lines. Elements that show no text are skipped with all they hold, others are flagged; unclosed ones end
    with the section around them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, bool, int, bool, int, int]] = []  # name, skipped, section, in an article, innermost flag, number of the article or -1
        self.names: Counter[str] = Counter()  # of open elements
        self.flags: list[Flag] = []
        self.articles: list[list[int]] = []  # first line, end
        self.parents = [0]  # of each section, the section that it may belong to, or itself
        self.words: list[str] = []
        self.tags = self.linked = self.links = 0
        self.headline = self.code = False

    def top(self) -> tuple[bool, int, bool, int]:
        return self.open[-1][1:5] if self.open else (False, 0, False, -1)

    def close(self) -> None:
        super().close()
        self.end_line()
        while self.open:
            self.pop()

    def pop(self) -> str:
        name, _, _, _, flag, article = self.open.pop()
        self.names[name] -= 1
        if flag >= 0 and flag != self.top()[3]:
            self.flags[flag].last = len(self.lines)
        if article >= 0:
            self.articles[article][1] = len(self.lines)
        return name

    def end_line(self) -> None:
        text = _SPACE.sub(" ", "".join(self.words)).strip()
        if text:
            _, section, inside, _ = self.top()
            self.lines.append(Line(text, self.tags, 0 if self.headline else self.linked, section, inside))
        self.words, self.tags, self.linked = [], 0, 0

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in INLINE:
            self.tags += not self.code
            self.links += tag == "a"
            return
        skipped, section, inside, flag = self.top()
        self.end_line()
        self.tags += 1
        if tag not in VOID:
            self.headline, self.code = tag == "h1", tag == "pre"
        if tag == "p" or tag == "li":
            self.links = 0
        if tag in VOID or tag not in OPENED:
            return
        self.links = 0
        article = -1
        if tag not in ("html", "body"):
            skipped = skipped or tag in DROPPED or hidden(attrs)
            is_article = tag in ("article", "main") and not skipped
            cost, hint, foreign = flagged(tag, attrs, inside)
            if cost > 1 and not skipped:
                self.flags.append(Flag(len(self.lines), flag, cost, hint, foreign, is_article))
                flag = len(self.flags) - 1
            if is_article:
                article = len(self.articles)
                self.articles.append([len(self.lines), -1])
                above = flag
                while above >= 0 and (not self.flags[above].holds or above == flag):
                    self.flags[above].holds = True
                    above = self.flags[above].around
            if tag != "form":
                self.parents.append(section if tag in FLOW or (inside and tag in CELLS) else len(self.parents))
                section = len(self.parents) - 1
            inside = inside or tag in ("article", "main")
        self.names[tag] += 1
        self.open.append((tag, skipped, section, inside, flag, article))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag in INLINE:
            self.tags += not self.code
        else:
            self.end_line()

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.tags += not self.code
            self.links = max(0, self.links - (tag == "a"))
            return
        self.end_line()
        self.headline, self.code = self.headline and tag != "h1", self.code and tag != "pre"
        if tag in OPENED and self.names[tag]:
            while self.pop() != tag:
                pass

    def handle_data(self, data: str) -> None:
        if self.top()[0]:
            return
        self.words.append(data)
        if self.links:
            self.linked += len(data.strip())

    def unknown_decl(self, data: str) -> None:
        pass


def hidden(attrs) -> bool:
    """True for an element that isn't shown."""
    return any(
        name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value or "", re.I))
        for name, value in attrs)


def flagged(tag: str, attrs, inside: bool) -> tuple[float, bool, bool]:
    """How much less an element's text counts by its name, role, class and id, whether class, id or form alone say so, and whether a class
    or id names it as foreign."""
    hint, foreign = OTHER_FLAG if tag == "form" else 1.0, False
    of_element = tag in ASIDES or (tag == "header" and not inside)
    for name, value in attrs:
        if name == "role" and value and value.lower() in ROLES:
            of_element = True
        if name in ("class", "id"):
            for words in (_WORD.findall(x.lower()) for x in (value or "").split()):
                known = [w in CLUTTER for w in words if not w.isdigit()]
                if any(known) and words[0] not in STATES:
                    hint = max(hint, WHOLE_NAME if all(known) else PART_OF_NAME)
                    foreign = foreign or not FOREIGN.isdisjoint(words)
    return (OTHER_FLAG, False, foreign) if of_element else (hint, True, foreign)


def covered(flags: list[Flag], n: int) -> np.ndarray:
    """Which of `n` lines stand in one of the flagged elements."""
    under = np.zeros(n + 1)
    for f in flags:
        under[f.first] += 1
        under[f.last] -= 1
    return np.cumsum(under)[:-1] > 0


def unflagged_lines(lines: list[Line], flags: list[Flag], articles: list[list[int]]) -> list[Line]:
    """The lines outside flagged elements, once each flag was judged by what its element holds.

    Lines weigh their characters outside links, more in an article, less under flags. From the outside in, a flag is lifted if its element
    holds at least half of the page's weight; a class, an id or a form also if it holds the heaviest article of the page. The element
    names and roles that never mean main text are lifted only around an article. If what stands under flags still outweighs all other text
    four times, or there is no other, classes, ids and forms tell nothing on this page and are all lifted.

    No weight lifts the flag of a foreign element (comments, consent, adverts) while text is left outside: lines that aren't mostly link, of
    `RUNNING` words or more, outside all foreign and all element flags, or outside all flags if the element holds an article.
    """
    if not flags or not lines:
        return lines
    size = np.array([max(0, len(x.text) - x.linked) * (IN_ARTICLE if x.in_article else 1.0) for x in lines])
    cost = np.zeros(len(lines) + 1)
    for f in flags:
        cost[f.first] += np.log(f.cost)
        cost[f.last] -= np.log(f.cost)
    weight = size * np.exp(-np.cumsum(cost)[:-1])
    main = max(articles, key=lambda a: weight[a[0] : a[1]].sum(), default=[0, 0])
    has_main = weight[main[0] : main[1]].sum() > 0
    text = np.array([2 * x.linked <= len(x.text) and len(x.text.split()) >= RUNNING for x in lines])
    outside = bool((text & ~covered([f for f in flags if f.foreign or not f.hint], len(lines))).any())
    outside_all = bool((text & ~covered(flags, len(lines))).any())
    firm = [f.foreign and (outside_all if f.holds else outside) for f in flags]
    stands = [True] * len(flags)
    for i, f in enumerate(flags):
        if firm[i] or (f.around >= 0 and stands[f.around]):
            continue
        held = weight[f.first : f.last].sum()
        around_main = has_main and f.holds and f.first <= main[0] and main[1] <= f.last
        if (f.hint and around_main) or ((f.hint or f.holds) and held > 0 and 2 * held >= weight.sum()):
            stands[i] = False
            weight[f.first : f.last] *= f.cost

    def out(hints: bool) -> np.ndarray:
        return covered([f for f, s, w in zip(flags, stands, firm) if s and (hints or w or not f.hint)], len(lines))

    under = out(True)
    if 4 * weight[~under].sum() <= weight[under & ~out(False)].sum():
        under = out(False)
    return [x for x, u in zip(lines, under) if not u]


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing, with weights renewed at both ends."""
    reach = int(np.ceil(3 * sigma))
    weights = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(np.ones(len(values)), weights)[reach : reach + len(values)]
    return np.convolve(values, weights)[reach : reach + len(values)] / total


def two_means(values: np.ndarray) -> float:
    """The threshold between the two clusters of numbers that 2-means finds from the extremes."""
    low, high = float(values.min()), float(values.max())
    cut = (low + high) / 2
    for _ in range(50):
        upper = values > cut
        if upper.all() or not upper.any():
            break
        low, high = float(values[~upper].mean()), float(values[upper].mean())
        if (low + high) / 2 == cut:
            break
        cut = (low + high) / 2
    return cut


def regions_of(lines: list[Line], parents: list[int]) -> list[int]:
    """The region of each line: its section, or for parts of a text that aren't mostly link the section around them."""
    size, linked = np.zeros(len(parents)), np.zeros(len(parents))
    for x in lines:
        size[x.section] += len(x.text)
        linked[x.section] += x.linked
    for s in range(len(parents) - 1, 0, -1):  # a section comes after the one around it
        if parents[s] != s:
            size[parents[s]] += size[s]
            linked[parents[s]] += linked[s]
    found = list(range(len(parents)))
    for s, p in enumerate(parents):
        if 2 * linked[s] <= size[s]:
            found[s] = found[p] if p != s else s
    return [found[x.section] for x in lines]


def content_lines(lines: list[Line], parents: list[int], sigma: float = 1.0, apart: float = 3.0, article: float = 1.5) -> list[bool]:
    """Which lines are main text.

    A line's ratio is its characters outside links per tag, times `article` inside an article or main element. Ratios (as logarithms) are
    smoothed over neighbouring lines and clustered into low and high. A region whose best line is in the high cluster stays whole, unless
    it is mostly link, or only its neighbours lift it and it is mostly markup (inline tags on its lines, under five characters for a tag).
    Where the clusters are less than a factor `apart` from one another, the page has one kind of text and all regions stay that aren't
    mostly link. Lines that stand in no element but the body are no region that was chosen: there, low lines that are mostly link go.
    """
    if not lines:
        return []
    own = np.log1p([max(0, len(x.text) - x.linked) / max(1, x.tags) * (article if x.in_article else 1.0) for x in lines])
    ratio = smoothed(own, sigma)
    cut = two_means(ratio)
    above = ratio > cut
    if above.all() or not above.any() or ratio[above].mean() - ratio[~above].mean() < np.log(apart):
        above[:], cut = True, 0.0
    region = regions_of(lines, parents)
    high: set[int] = set()
    sums = np.zeros((len(parents), 4))  # by region: lines, characters, those inside links, tags
    best = np.zeros(len(parents))
    for x, r, a, o in zip(lines, region, above, own):
        if a:
            high.add(r)
        sums[r] += 1, len(x.text), x.linked, x.tags
        best[r] = max(best[r], o)
    count, size, linked, tags = sums.T
    markup = (best <= cut) & (tags > 2 * count) & (size - linked < 5 * tags)
    chosen = {r for r in high if 2 * linked[r] <= size[r] and not markup[r]}
    return [r in chosen if r else r in high and (2 * x.linked <= len(x.text) or bool(a and cut)) for x, r, a in zip(lines, region, above)]


def main_text(html: str | None) -> tuple[str, int, int]:
    """The main text of a page, its blocks joined by line feeds, and the numbers of lines found (outside flagged elements) and kept."""
    if not html:
        return "", 0, 0
    parser = LineParser()
    parser.feed(html)
    parser.close()
    lines = unflagged_lines(parser.lines, parser.flags, parser.articles)
    keep = content_lines(lines, parser.parents)
    kept = [x.text for x, k in zip(lines, keep) if k]
    return "\n".join(kept), len(keep), len(kept)


def extract_text(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """Adds `text` (empty if there is none), `n_lines` and `n_content_lines`; character references are decoded, white space inside a
    block is one space. Null and empty pages have an empty text. Markup may be cut off or unclosed. Rows are independent of each other,
    repeated ones give the same text; a carried column with the name of an output is replaced."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([main_text(t) for t in texts], columns=OUTPUTS)

    found = F.pandas_udf(run, "text string, n_lines int, n_content_lines int")(F.col(f"`{html}`"))
    return unpacked(pages.select(packed(pages, carry), found.alias("__f")).select(ROW, "__f.*"), OUTPUTS)
