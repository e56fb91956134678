"""Main text of web pages from flat blocks, by a decision tree.

A page becomes a flat list of text blocks. Each block has shallow features: its
words and link density, those of both neighbours, whether it is a heading, where
it stands to the page's story element (within an article; within main beside
the articles; the page has none; outside), and one hint: whether an element
around it says by tag, class or role that it is page furniture. A decision tree
(Gini splits), trained on the small labelled table below, says which blocks are
main text.

A hint is firm (navigation, forms, advertisements, reader comments, what is
hidden) or soft (words that a story's own parts may have as well, such as
``notice`` or ``related``): statistics overrule a soft one. Class words count
whole: a word such as ``cookie-banner`` made of such words and fillers is a
hint, ``reply-brief`` and ``has-sidebar`` are none, and ids, which are often made
from headings, never are. A hint never counts on html, body, main or the page's
first article, nor on an element that has one of them or the first h1 in it: such
a wrapper is no furniture, whatever its class and however many words it holds.
An article within an article is a reader's comment; an article whose heading is
all link, beside one whose heading is none, is a teaser. Both are firm hints. A
header inside the story is the story's own. On a page without article and main,
what comes before the h1 stands outside. A page that stands in hinted elements
as a whole is judged without hints, and a page of which the tree takes nothing
but headings keeps every block without a firm hint that isn't mostly links.

Scripts, styles, titles, form fields and comments in markup are no text.
Character references are decoded, white space inside a block becomes one space,
blocks are joined by a line feed.

What stands in a script, style, noscript, title, textarea or iframe is not read
as markup: such an element ends at its own end tag. Without one a script or
style goes on to the page's end, a title ends at the next tag, and the others
end as all elements without text do: with the element that surrounds them. An svg or math element also ends
where HTML begins in it or by ``/>``. The head holds nothing by itself, so text
after a head without an end tag counts.

Defined results: null and empty html and pages without main text give an empty
text; unclosed elements end with what surrounds them; a null url passes
through; repeated rows give equal results; a page of any length is read whole;
an empty table gives no rows; of splits that are equally good the first feature's
lowest is taken; an input column named as a result is kept under a name with a
leading underscore.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import aside, load, small_batches

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "place", "hint")
#: Where a block stands: outside the page's story element, on a page without one, in main beside the articles, within the story.
OUTSIDE, NOWHERE, BESIDE, WITHIN = range(4)
#: How sure a hint is.
NONE, SOFT, FIRM = range(3)

# Elements and words that mark page furniture, elements that hold no text, and elements that end a block.
FURNITURE_TAGS = frozenset("nav aside footer form dialog menu".split())
FIRM_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation "
    "newsletter pager pagination popup replies respond sidebar signup sponsored subscribe toolbar topbar widget widgets".split()
)
SOFT_WORDS = frozenset("banner copyright discussion header notice notices promo promoted recommended related reply search share sharing skip social sponsor subscription teaser".split())
# Words that say nothing of their own in a compound class word.
FILLERS = frozenset(
    "area bar block body bottom box container desktop form global group holder inner item items left link links list main mobile outer page panel post posts primary "
    "right row secondary site sticky strip thread top wrap wrapper zone".split()
)
FURNITURE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu menubar navigation search".split())
NO_TEXT = frozenset("script style noscript template svg math iframe object canvas textarea select button title audio video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BLOCK_TAGS = frozenset(
    "address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OPTIONAL_END = frozenset("p li dt dd tr td th option tbody thead tfoot caption".split())
# Elements whose content isn't markup, with their end tags; of these, the ones that go on to the page's end without one.
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|$)[^>]*>?", re.I) for t in "script style noscript title textarea iframe".split()}
TO_THE_END = frozenset(["script", "style"])
# Elements in another language, the HTML elements that end them, and the places in them where HTML may stand.
FOREIGN = frozenset(["svg", "math"])
ENDS_FOREIGN = BLOCK_TAGS - {"title"} | frozenset("b big code em embed i img listing meta nobr ruby s small span strong strike sub sup tt u var".split())
HTML_IN_FOREIGN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
# Elements that end a sibling of the same group, and those that begin a new list or table.
SIBLINGS = {"li": "list", "dt": "terms", "dd": "terms"} | dict.fromkeys("td th tr tbody thead tfoot caption".split(), "table")
HOLDERS = frozenset("ul ol menu dl table template".split())

# Labelled blocks of small pages: words, words in links, heading, place, hint (1 soft, 2 firm), is main text. Neighbours are the lines beside; a blank line ends a page.
LABELLED = """
1 1 0 0 2 0
1 1 0 0 2 0
2 2 0 0 2 0
9 0 0 0 2 0
7 0 1 3 0 1
140 0 0 3 0 1
60 3 0 3 0 1
2 0 0 3 0 1
35 0 0 3 0 1
8 0 0 0 2 0

1 1 0 0 0 0
1 1 0 0 0 0
1 1 0 0 0 0
10 0 0 0 0 0
12 0 1 3 0 1
55 0 0 3 0 1
1 0 0 3 0 1
90 0 0 3 0 1
4 0 0 3 0 1
25 2 0 3 0 1
9 1 0 0 0 0

3 0 1 3 0 1
18 0 0 3 0 1
4 4 0 3 0 1
70 2 0 3 0 1
6 0 1 3 0 1
45 0 0 3 0 1
5 5 0 3 0 0
6 6 0 3 0 0
4 4 0 3 0 0
7 7 0 3 0 0
30 0 0 0 0 0
12 0 0 0 2 0

5 0 1 3 0 1
80 0 0 3 0 1
7 7 0 3 0 1
65 0 0 3 0 1
3 3 0 3 2 0
2 2 0 3 2 0
3 3 0 3 2 0
50 1 0 3 0 1
14 0 0 3 2 0
9 0 0 3 2 0
2 0 0 0 2 0

11 0 1 3 0 1
2 2 0 3 0 0
3 3 0 3 0 0
2 2 0 3 0 0
120 0 0 3 0 1
30 12 0 3 0 1
40 0 0 3 2 0
22 0 0 3 2 0
10 0 0 3 0 1
75 4 0 3 0 1
20 20 0 3 0 0
16 16 0 3 0 0
18 18 0 3 0 0

2 2 0 1 0 0
3 3 0 1 0 0
2 2 0 1 0 0
6 0 1 1 0 1
80 0 0 1 0 1
95 3 0 1 0 1
16 0 0 1 0 1
40 0 0 1 0 1
5 0 1 1 0 1
60 2 0 1 0 1
8 0 0 1 2 0
4 1 0 1 0 0

1 1 0 1 2 0
4 0 0 1 0 0
30 0 0 1 0 1
55 5 0 1 0 1
12 12 0 1 0 0
10 9 0 1 0 0
13 12 0 1 0 0
25 24 0 1 0 0
20 20 0 1 0 0
3 0 1 1 0 0
2 2 0 1 0 0
2 2 0 1 0 0
7 2 0 1 0 0

5 5 0 2 0 0
3 3 0 2 0 0
8 0 1 2 0 1
6 0 1 3 0 1
100 0 0 3 0 1
50 1 0 3 0 1
4 0 0 2 0 0
9 8 0 2 0 0
8 8 0 2 0 0
15 0 0 2 2 0

20 0 0 0 0 0
45 2 0 0 0 0
3 0 1 0 0 0
4 4 0 0 0 0
1 0 1 3 0 1
2 0 0 3 0 1
1 0 0 3 0 1
3 0 0 3 0 1
6 0 0 0 0 0
60 0 0 0 2 0
33 0 0 0 2 0
70 0 0 0 0 0

14 0 0 3 0 1
2 1 0 3 0 1
85 0 0 3 0 1
1 0 0 3 0 1
6 2 0 3 0 1
12 0 0 3 0 1
300 8 0 3 0 1
26 0 0 3 2 0
15 3 0 3 2 0
60 0 0 3 2 0
35 2 0 3 2 0
1 1 0 0 0 0
1 1 0 0 0 0

3 3 0 1 2 0
24 0 0 1 0 1
33 1 0 1 0 1
28 0 0 1 0 1
9 0 0 1 0 1
47 0 0 1 0 1
2 0 0 1 0 0
2 2 0 1 2 0
30 0 0 1 2 0
44 1 0 1 2 0
6 0 0 1 0 0

5 0 0 3 0 1

1 0 0 3 0 1
2 0 0 3 0 1

3 0 1 3 0 1
9 0 0 3 0 1

60 0 0 3 0 1
26 0 0 3 0 1
6 6 0 3 0 1
19 0 0 3 0 1
44 0 0 3 0 1
8 8 0 3 0 1
12 0 0 3 0 1

6 6 1 3 0 1
24 0 0 3 0 1
110 2 0 3 0 1
3 3 0 3 0 1
21 1 0 3 0 1
1 1 0 3 0 0
1 1 0 3 0 0
2 2 0 3 0 0
1 1 0 3 0 0

30 0 0 3 0 1
4 4 0 3 0 0
5 5 0 3 0 0
3 3 0 3 0 0
16 0 0 3 0 1
15 0 0 3 0 1
7 0 0 3 2 0
5 0 0 3 2 0
2 0 0 3 0 1

4 0 0 3 0 1
3 1 0 3 0 1
2 0 0 3 0 1
8 3 0 3 0 1
12 7 0 3 0 1
5 2 0 3 0 1
15 1 0 3 0 1
28 9 0 3 0 1
6 0 0 3 0 1

33 4 0 1 0 1
50 16 0 1 0 1
27 5 0 1 0 1
41 20 0 1 0 1

2 2 0 1 0 0
2 2 0 1 0 0
3 0 1 1 0 1
29 0 0 1 0 1
2 0 0 1 0 1
29 0 0 1 0 1
2 2 0 1 0 0
2 2 0 1 0 0

1 1 0 1 0 0
3 3 0 1 0 0
6 0 0 1 0 0
5 0 1 1 0 1
24 1 0 1 0 1
4 0 0 1 0 1
36 0 0 1 0 1
7 0 1 1 0 1
31 0 0 1 0 1
12 0 0 1 0 1
26 2 0 1 0 1
5 0 0 1 0 0
4 4 0 1 0 0

1 1 0 1 0 0
1 1 0 1 0 0
28 0 0 1 0 1
28 0 0 1 0 1
13 0 0 1 2 0

1 1 0 1 0 0
37 0 0 1 0 1
25 0 0 1 0 1
1 1 0 1 0 0

1 1 0 0 0 0
50 0 0 3 0 1
2 2 0 3 0 0
2 2 0 3 0 0
3 3 0 3 0 0
43 0 0 3 0 1
8 8 0 3 0 1
61 0 0 3 0 1
1 1 0 0 0 0

9 0 0 1 0 0
7 0 1 1 0 1
48 0 0 1 0 1
3 0 0 1 0 1
33 0 0 1 0 1
6 0 0 1 0 0

6 0 1 3 0 1
40 3 0 3 0 1
5 5 0 3 0 1
33 0 0 3 0 1
9 9 0 3 0 0
9 9 0 3 0 0
8 8 0 3 0 0
10 10 0 3 0 0
52 1 0 3 0 1

22 0 0 1 0 1

38 0 0 1 0 1
17 0 0 1 0 1

2 2 0 1 0 0
2 2 0 1 0 0
10 0 0 1 0 0
9 0 1 1 0 1
64 1 0 1 0 1
3 0 0 1 0 1
51 0 0 1 0 1
7 0 0 1 0 1
29 0 0 1 0 1
11 1 0 1 0 0
2 2 0 1 0 0
3 3 0 1 0 0

4 4 0 1 0 0
13 0 0 1 0 0
5 5 0 1 0 0
8 0 0 1 0 0
3 3 0 1 0 0
6 1 0 1 0 0

3 0 0 1 0 0
6 0 0 1 0 0

5 0 1 3 0 1
46 0 0 3 0 1
38 1 0 3 1 1
27 0 0 3 1 1
3 0 0 3 1 0
6 5 0 3 1 0
52 0 0 3 0 1
4 4 0 3 1 0
8 8 0 3 1 0

4 0 1 1 0 1
36 0 0 1 0 1
24 0 0 1 1 1
5 0 0 1 1 0
9 8 0 1 1 0
61 2 0 1 0 1
33 0 0 1 1 1
2 2 0 1 1 0

9 0 0 0 1 0
30 0 0 0 1 0
4 0 1 3 0 1
20 0 0 3 1 1
44 0 0 3 0 1
7 0 0 3 1 0
48 3 0 3 1 1
6 6 0 0 1 0

4 0 1 3 0 1
34 0 0 3 0 1
4 4 1 3 2 0
16 0 0 3 2 0
5 5 1 3 2 0
21 1 0 3 2 0

1 0 1 3 0 1
30 0 0 3 0 1
31 0 0 3 0 1
5 5 1 3 2 0
14 0 0 3 2 0

6 0 1 3 0 1
55 2 0 3 0 1
7 7 1 3 2 0
7 7 1 3 2 0
3 0 1 3 2 0
28 0 0 3 2 0
"""


def neighbours(words: np.ndarray, links: np.ndarray) -> list[np.ndarray]:
    """Words and link density of each block, of the one before and of the one after (0 where there is none)."""
    density = np.minimum(1.0, links / np.maximum(words, 1))
    pad = lambda v: np.concatenate([[0.0], v, [0.0]])
    w, d = pad(words), pad(density)
    return [words, density, w[:-2], d[:-2], w[2:], d[2:]]


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features of the labelled blocks, and which of them are main text."""
    x, y = [], []
    for page in LABELLED.strip().split("\n\n"):
        rows = np.array([[float(v) for v in line.split()] for line in page.splitlines()])
        x.append(np.column_stack([*neighbours(rows[:, 0], rows[:, 1]), rows[:, 2:5]]))
        y.append(rows[:, 5].astype(int))
    return np.concatenate(x), np.concatenate(y)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> dict:
    """A decision tree: at each node the split with the least weighted Gini impurity; ties go to the first feature."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return {"main": share >= 0.5}
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            left = x[:, f] <= cut
            n = int(left.sum())
            if min(n, len(y) - n) < least:
                continue
            p, q = y[left].mean(), y[~left].mean()
            impurity = n * p * (1 - p) + (len(y) - n) * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(cut))
    if best is None:
        return {"main": share >= 0.5}
    _, f, cut = best
    left = x[:, f] <= cut
    return {"feature": f, "cut": cut, "low": grow(x[left], y[left], depth - 1, least), "high": grow(x[~left], y[~left], depth - 1, least)}


def decide(tree: dict, x: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` are main text."""
    if "main" in tree:
        return np.full(len(x), tree["main"])
    low = x[:, tree["feature"]] <= tree["cut"]
    out = np.empty(len(x), bool)
    out[low], out[~low] = decide(tree["low"], x[low]), decide(tree["high"], x[~low])
    return out


@lru_cache(maxsize=1)
def trained() -> dict:
    return grow(*labelled(), depth=8, least=2)


TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)/?>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|$)", re.S)
HINT = re.compile(r"(?<![\w:.-])(class|role|hidden|aria-hidden|style)(?![\w:.-])\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
PARTS = re.compile(r"[^a-z0-9]+")
#: Elements that are never furniture.
NEVER = frozenset("html body main".split())


def said(word: str) -> int:
    """What a class word says: the surest of its parts, if all of them are furniture or fillers."""
    parts = [x for x in PARTS.split(word) if x]
    sure = [FIRM if x in FIRM_WORDS else SOFT if x in SOFT_WORDS else NONE for x in parts]
    return max(sure, default=NONE) if all(k or x in FILLERS for k, x in zip(sure, parts, strict=True)) else NONE


def hints(tag: str, attributes: str, story: bool = False) -> int:
    """How surely an element says of itself that it is page furniture or hidden; ``story``: it stands within the story."""
    if tag in NEVER:
        return NONE
    if tag in FURNITURE_TAGS or (tag == "header" and not story):
        return FIRM
    if not attributes:
        return NONE
    most = NONE
    for name, *values in HINT.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "class":
            most = max([most, *map(said, value.split())])
        elif (
            (name == "role" and value in FURNITURE_ROLES) or name == "hidden" or (name == "aria-hidden" and value == "true")
            or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value))
        ):
            return FIRM
    return most


@dataclass
class Block:
    """A text block of a page, with its words, the words of it in links, and where it stands."""

    text: str
    words: int
    linked: int
    heading: bool
    article: int  # the number of the article it stands in, 0 for none
    main: bool
    hint: int = NONE
    untold: bool = False  # before the page's first h1


@dataclass
class Open:
    """An open element: for a hinted one, the number of blocks before it and whether it has the first h1, main or the first article."""

    tag: str
    hint: int
    begin: int
    story: bool = False


def blocks(page: str) -> list[Block]:
    """Flat blocks in page order."""
    out: list[Block] = []
    stack: list[Open] = []
    hinted: list[tuple[int, int, int]] = []  # blocks of hinted elements: from, to before, how sure
    articles = 0
    held: list[tuple[str, bool]] = []
    link = 0
    within: Counter[str] = Counter()  # open articles, mains and headings
    skip = ""
    titled = False
    at = 0
    opened: list[str] = []  # within the element that is skipped
    inside: Counter[str] = Counter()  # of these, by tag
    inline: Counter[str] = Counter()  # open elements that aren't on the stack
    endless: set[str] = set()  # tags without an end tag from here on

    def close() -> None:
        if held:
            # references may be split over no element, so each run decodes alone
            text = " ".join("".join(t for t, _ in held).split())
            if text:
                out.append(Block(text, len(text.split(" ")), sum(len(t.split()) for t, linked in held if linked), within["heading"] > 0, articles if within["article"] else 0, within["main"] > 0, untold=not titled))
            held.clear()

    def pop() -> None:
        last = stack.pop()
        within["heading" if last.tag in HEADINGS else last.tag] -= 1
        if last.hint and not last.story and last.begin < len(out):
            hinted.append((last.begin, len(out), last.hint))

    def ends_skip(tag: str, ends: bool, whole: bool) -> bool:
        """Take a tag inside an element without text; whether that element ends before it."""
        if skip == "title":  # without its end tag
            return True
        foreign = skip in FOREIGN or any(inside[t] for t in FOREIGN)
        if ends:
            if not inside[tag]:
                return tag == skip or inline[tag] > 0 or any(o.tag == tag for o in stack)
            while True:
                last = opened.pop()
                inside[last] -= 1
                if last == tag:
                    return False
        if skip in FOREIGN and tag in ENDS_FOREIGN and not any(inside[t] for t in HTML_IN_FOREIGN):
            return True
        if tag in SIBLINGS and skip != "template" and not any(inside[t] for t in HOLDERS):
            around = next((o.tag for o in reversed(stack) if o.tag != "p"), "")
            if SIBLINGS.get(around) == SIBLINGS[tag]:
                return True
        # buttons and selects can't hold their like
        if tag not in VOID and not (whole and (foreign or tag in FOREIGN)) and not (tag == skip and tag in ("button", "select")):
            opened.append(tag)
            inside[tag] += 1
        return False

    while m := TOKEN.search(page, at):
        if m.start() > at and not skip:
            held.append((entities.unescape(page[at : m.start()]), link > 0))
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        ends, whole = (m[1] or m[4]) == "/", m[0].endswith("/>")
        if tag in RAW_END and not ends and tag not in endless and not (whole and (skip in FOREIGN or any(inside[t] for t in FOREIGN))):
            end = RAW_END[tag].search(page, at)
            if end or tag in TO_THE_END:
                if tag in BLOCK_TAGS and not skip:
                    close()
                at = end.end() if end else len(page)
                continue
            endless.add(tag)
        if skip:
            if not ends_skip(tag, ends, whole):
                continue
            own = ends and tag == skip
            skip = ""
            opened.clear()
            inside.clear()
            if own:
                continue
        if tag in NO_TEXT and not ends:
            if tag in BLOCK_TAGS:
                close()
            if not (tag in FOREIGN and whole):
                skip = tag
            continue
        if tag == "head":
            close()
            continue
        if tag not in BLOCK_TAGS and tag not in VOID:
            inline[tag] = max(0, inline[tag] + (-1 if ends else 1))
        if tag == "a":
            link = 0 if ends else 1
            continue
        if tag in BLOCK_TAGS:
            close()
        elif tag not in ("section", "span"):
            continue
        if tag in VOID:
            continue
        if ends:
            if any(o.tag == tag for o in stack):
                close()
                while stack[-1].tag != tag:
                    pop()
                pop()
            continue
        if tag != "span":
            close()
            link = 0
            # an element whose end may be left out ends where a block begins that it can't hold
            while stack and stack[-1].tag in OPTIONAL_END and stack[-1].tag in (tag, "p"):
                pop()
        hint = hints(tag, m[3] or m[6] or "", within["article"] + within["main"] > 0)
        if tag == "article":
            # one within another is a comment
            hint = FIRM if within["article"] else NONE if not articles else hint
        if tag == "span" and not hint:
            continue
        if tag == "span":
            close()
        if tag == "main" or (tag == "article" and not articles) or (tag == "h1" and not titled):
            titled = titled or tag == "h1"
            for o in stack:
                o.story = True
        articles += tag == "article" and not within["article"]
        stack.append(Open(tag, hint, len(out)))
        within["heading" if tag in HEADINGS else tag] += 1
    if not skip and at < len(page):
        held.append((entities.unescape(page[at:]), link > 0))
    close()
    while stack:
        pop()
    for begin, end, sure in hinted:
        for b in out[begin:end]:
            b.hint = max(b.hint, sure)
    if all(b.hint for b in out):  # so the hints say nothing
        for b in out:
            b.hint = NONE
    teased = teasers(out)
    for b in out:
        b.untold &= titled
        if b.article in teased:
            b.hint = FIRM
    return out


def teasers(flat: list[Block]) -> set[int]:
    """Articles whose first heading is all link, if another article's is not."""
    first: dict[int, bool] = {}
    for b in flat:
        if b.article and b.heading:
            first.setdefault(b.article, b.linked == b.words)
    return {a for a, linked in first.items() if linked} if not all(first.values()) else set()


def features_of(flat: list[Block]) -> np.ndarray:
    articles, mains = any(b.article for b in flat), any(b.main for b in flat)

    def place(b: Block) -> int:
        if not articles and not mains:
            return OUTSIDE if b.untold else NOWHERE
        if b.article if articles else b.main:
            return WITHIN
        return BESIDE if b.main else OUTSIDE

    around = neighbours(np.array([b.words for b in flat], float), np.array([b.linked for b in flat], float))
    return np.column_stack([*around, [b.heading for b in flat], [place(b) for b in flat], [b.hint for b in flat]]).astype(float)


def main_text(page: str | None) -> str:
    flat = blocks(page or "")
    if not flat:
        return ""
    taken = [b for b, main in zip(flat, decide(trained(), features_of(flat)), strict=True) if main]
    if all(b.heading for b in taken):
        taken = [b for b in flat if b.hint < FIRM and 2 * b.linked <= b.words]
    return "\n".join(b.text for b in taken)


def extract(df: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text`` and ``n_chars`` to pages."""
    small_batches(df.sparkSession)
    df, now_named = aside(df, "text", "n_chars")

    @F.pandas_udf("string")
    def udf(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in pages:
            yield pd.Series([main_text(p) for p in x], dtype=object)

    return df.withColumn("text", udf(now_named(html))).withColumn("n_chars", F.length("text").cast("long"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(load(spark, sf_dir, "pages").select("page_id", "url", "html")).drop("html")
