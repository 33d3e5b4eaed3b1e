"""HTML extraction from flat text blocks.

A page becomes a flat list of text blocks. Each has a word count, a link density, those of its two neighbours, and three
hints of the markup around it. A decision tree trained on the small labelled table below tells content from
the rest; content blocks are joined in page order. Where the markup says nothing the sizes and links decide; where it does they
yield to it, as an advert or a reader's comment may read like prose.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from furrow.llm.common import as_text

_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
#: What may end a tag or hide its end.
_STOP = re.compile(r"""[<>"']""")
#: Elements that flow inside a block of text; all others end one.
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements skipped with all in them, up to their end tag. One that closes itself, or has no end tag, is skipped alone.
_SKIPPED = {t: re.compile(rf"</{t}\s*>", re.I) for t in "noscript template svg iframe textarea select title".split()}
#: Elements of no text at all; without an end tag they go on to the end of the page.
_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style")}
#: What a head may hold; anything else ends it, as its end tag may be left out.
_HEAD_TAGS = frozenset("head title meta link base basefont bgsound noframes noscript template".split())
_VOID = frozenset("area base basefont bgsound br col embed hr input link meta param source track".split())
#: Elements that aren't blocks: classes of a whole page don't tell furniture.
_PAGE = frozenset("html body head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start tag ends an open p.
_END_P = _HEADINGS | frozenset("address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: Elements whose start tag ends open ones (the first set), as far up as an element of the second.
_IMPLIED = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    **dict.fromkeys(("dt", "dd"), (frozenset("dt dd".split()), frozenset("dl table td th".split()))),
    **dict.fromkeys(("td", "th"), (frozenset("td th".split()), frozenset("tr table".split()))),
    "tr": (frozenset("tr td th caption".split()), frozenset("table".split())),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"]))),
    **dict.fromkeys(_HEADINGS, (_HEADINGS, frozenset("article aside blockquote body dd div dl fieldset figure footer form header li main nav ol section table td th ul".split()))),
}
_P_BOUNDS = frozenset("button caption table td th".split())
#: As far up as an end tag of an element that is no holder looks for its start tag.
_END_BOUNDS = {"p": _P_BOUNDS, "li": _IMPLIED["li"][1], "dt": _IMPLIED["dt"][1], "dd": _IMPLIED["dd"][1]}
#: Elements kept on the stack for what they say of the text in them, besides all other blocks.
_HOLDERS = frozenset("article main nav header footer aside form section div ul ol dl table menu dialog figure button fieldset".split())
_BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset".split())
#: Words of class, id and role that name page furniture.
_BOILER_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies discussion footer form header login masthead menu modal nav navbar "
    "navigation newsletter notice notices popup promo promotion related reply replies respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
_NAMES = re.compile(r"""(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "inside", "outside", "boiler")

#: Neighbours of blocks in the labelled table: (words, link density) of the block before and of the one after; zeros where there is none.
_NOTHING, _LONG, _PLAIN, _SHORT, _LINKS, _LINKED = (0, 0.0), (90, 0.02), (35, 0.0), (4, 0.0), (2, 1.0), (30, 0.8)
_AROUND_TEXT = ((_NOTHING, _NOTHING), (_NOTHING, _LONG), (_LONG, _NOTHING), (_LONG, _PLAIN), (_PLAIN, _PLAIN), (_SHORT, _LONG), (_PLAIN, _SHORT), (_SHORT, _SHORT), (_LINKS, _PLAIN), (_LONG, _LINKS), (_LINKS, _LINKS), (_SHORT, _NOTHING), (_LINKED, _SHORT))
_AROUND_BIT = ((_LONG, _LONG), (_PLAIN, _PLAIN), (_LONG, _SHORT), (_SHORT, _LONG), (_NOTHING, _PLAIN), (_LONG, _NOTHING), (_PLAIN, _LINKS), (_LINKS, _PLAIN), (_LINKS, _LONG))
_AROUND_CRUMB = ((_LINKS, _LINKS), (_NOTHING, _LINKS), (_LINKS, _NOTHING), (_SHORT, _LINKS), (_LINKS, _SHORT), (_LINKED, _LINKS), (_SHORT, _SHORT))
_ANYWHERE = (_AROUND_TEXT[1], _AROUND_TEXT[3], _AROUND_BIT[2], _AROUND_BIT[7], _AROUND_CRUMB[0], _AROUND_CRUMB[6])
_ANY_SIZE = ((1, 0.0), (9, 0.0), (13, 0.05), (60, 0.05), (7, 1.0), (40, 0.7))
#: The labelled table: blocks of pages, without a word of markup around them and with, as (words and link densities, neighbours, hints as
#: in FEATURES, 1 for content). inside: in an article or main element; outside: elsewhere on a page that has one; boiler: an element or name
#: around the block marks page furniture.
_CASES = (
    (((15, 0.0), (25, 0.1), (60, 0.0), (150, 0.05), (200, 0.25)), _AROUND_TEXT, (0, 0, 0), 1),  # prose wherever it stands
    (((1, 0.0), (6, 0.0), (11, 0.05), (14, 0.0)), _AROUND_BIT, (0, 0, 0), 1),  # headings and short lines beside prose
    (((1, 0.0), (5, 0.0), (9, 0.0), (13, 0.0)), _AROUND_CRUMB, (0, 0, 0), 0),  # crumbs among links and crumbs
    (((1, 1.0), (4, 0.8), (12, 0.6), (30, 0.9), (80, 0.7)), _ANYWHERE, (0, 0, 0), 0),  # lists of links
    (_ANY_SIZE, _ANYWHERE, (1, 0, 0), 1),  # all of an article
    (_ANY_SIZE, _ANYWHERE, (0, 1, 0), 0),  # what stands beside one
    (_ANY_SIZE[::2], _ANYWHERE, (0, 0, 1), 0),  # furniture by name
    (_ANY_SIZE[1::2], _ANYWHERE, (1, 0, 1), 0),
    (_ANY_SIZE[::3], _ANYWHERE, (0, 1, 1), 0),
)
LABELLED = tuple((*own, *before, *after, *hints, label) for sizes, around, hints, label in _CASES for own in sizes for before, after in around)


def train_tree(rows, most_depth: int = 10):
    """A decision tree by Gini impurity: (feature, bound, tree below or at it, tree above) or the share of content."""
    data = np.asarray(rows, float)
    x, y = data[:, :-1], data[:, -1]

    def grow(at: np.ndarray, depth: int):
        share = float(y[at].mean())
        if depth == 0 or share in (0.0, 1.0):
            return share
        best = None
        for f in range(x.shape[1]):
            values = np.unique(x[at, f])
            for bound in (values[1:] + values[:-1]) / 2:
                low = x[at, f] <= bound
                impurity = sum(part.sum() * y[at][part].mean() * (1 - y[at][part].mean()) for part in (low, ~low))
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, float(bound), low)
        if best is None:
            return share
        return best[1], best[2], grow(at[best[3]], depth - 1), grow(at[~best[3]], depth - 1)

    return grow(np.arange(len(y)), most_depth)


def classify(tree, features) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def _names_boiler(attributes: str, allowed: frozenset = frozenset()) -> bool:
    """Whether class, id or role name page furniture, by other words than those allowed."""
    if "=" not in attributes:
        return False
    for found in _NAMES.findall(attributes):
        value = re.sub(r"([a-z])([A-Z])", r"\1 \2", "".join(found))
        if not (_BOILER_NAMES - allowed).isdisjoint(re.split(r"[^a-z0-9]+", value.lower())):
            return True
    return False


def _tag_end(page: str, at: int) -> tuple[int, int]:
    """Where the attributes that start at `at` end, and where to go on: after a >, or at a < that comes first. Quotes hide both where
    they follow a =."""
    while True:
        m = _STOP.search(page, at)
        if not m:
            return len(page), len(page)
        i = m.start()
        if m[0] == ">":
            return i, i + 1
        if m[0] == "<":
            return i, i
        at = i + 1
        if page[max(0, i - 64) : i].rstrip()[-1:] == "=":
            close = page.find(m[0], at)
            at = close + 1 if close >= 0 else at


def _tokens(page: str):
    """(text, tag, closing, attributes, end) of each piece of a page: text, or a tag with what follows it at end. Comments, declarations,
    scripts and styles are left out; what follows a sent position goes on there. One pass."""
    at, n = 0, len(page)
    while at < n:
        if page[at] != "<":
            to = page.find("<", at)
            to = n if to < 0 else to
            yield page[at:to], None, False, "", to
            at = to
            continue
        closing = page.startswith("/", at + 1)
        m = _NAME.match(page, at + 1 + closing)
        if m:
            tag = m[0].lower()
            last, to = _tag_end(page, m.end())
            if tag in _RAW and not closing:
                found = _RAW[tag].search(page, to)
                yield "", tag, False, "", to
                at = found.end() if found else n
                continue
            moved = yield "", tag, closing, page[m.end() : last], to
            at = to if moved is None else moved
        elif page.startswith("<!--", at):
            to = page.find("-->", at + 4)
            at = n if to < 0 else to + 3
        elif page[at + 1 : at + 2] in ("!", "?", "/"):
            to = page.find(">", at)
            at = n if to < 0 else to + 1
        else:
            yield "<", None, False, "", at + 1
            at += 1


def blocks(page: str) -> list[tuple[str, int, int, bool, bool]]:
    """(text, words, words in links, inside, boiler) of each text block, in page order."""
    out, held, linked, anchor = [], [], 0, 0
    stack: list[tuple[str, bool, bool]] = []  # tag, boiler, inside; the last two hold for all below
    open_tags: Counter = Counter()

    def flush():
        nonlocal held, linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                _, boiler, inside = stack[-1] if stack else ("", False, False)
                words = text.count(" ") + 1
                out.append((text, words, min(linked, words), inside, boiler))
        held, linked = [], 0

    def cut(i: int):
        open_tags.subtract(t for t, _, _ in stack[i:])
        del stack[i:]

    def end(tags: frozenset, bounds: frozenset):
        """Takes the outermost open one of tags within the nearest of bounds, and all in it, from the stack."""
        if not any(open_tags[t] for t in tags):
            return
        last = None
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in bounds:
                break
            if stack[i][0] in tags:
                last = i
        if last is not None:
            cut(last)

    in_head, title_open, without_end, moved = False, False, set(), None
    tokens = _tokens(page)
    while True:
        try:
            text, tag, closing, attributes, to = tokens.send(moved)
        except StopIteration:
            break
        moved = None
        if tag is None:
            if in_head and (title_open or not text.strip()):
                continue
            in_head = False
            held.append(text)
            if anchor:
                linked += len(text.split())
            continue
        if tag in _RAW:
            flush()
            continue
        title_open = False
        if tag == "head":
            in_head = not closing
        elif tag not in _HEAD_TAGS:
            in_head = False
        if tag in _SKIPPED and not closing:
            flush()
            if not attributes.endswith("/") and tag not in without_end:
                found = _SKIPPED[tag].search(page, to)
                if found:
                    moved = found.end()
                    continue
                without_end.add(tag)
            title_open = tag == "title" and in_head
            continue
        if tag in _INLINE:
            if tag == "a":
                anchor = 0 if closing else 1
            continue
        flush()
        if tag in _PAGE or tag in _SKIPPED:
            continue
        holder = tag in _HOLDERS
        if closing:
            bounds = _END_BOUNDS.get(tag, frozenset())
            if open_tags[tag] or (tag in _HEADINGS and any(open_tags[t] for t in _HEADINGS)):
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag or (tag in _HEADINGS and stack[i][0] in _HEADINGS):
                        cut(i)
                        break
                    if stack[i][0] in bounds or (not holder and stack[i][0] == "table" and tag != "table"):
                        break
            if holder:
                anchor = 0
            continue
        if tag in _END_P:
            end(frozenset(["p"]), _P_BOUNDS)
        if tag in _IMPLIED:
            end(*_IMPLIED[tag])
        if tag in _VOID or attributes.endswith("/"):
            continue
        _, boiler, inside = stack[-1] if stack else ("", False, False)
        inside = inside or tag in ("article", "main")
        # A header of a table or a heading is no page furniture.
        named = _names_boiler(attributes) if holder else _names_boiler(attributes, frozenset(["header"]))
        boiler = boiler or tag in _BOILER_TAGS or (tag == "header" and not inside) or named
        stack.append((tag, boiler, inside))
        open_tags[tag] += 1
    flush()
    return out


def main_text(page: str, tree) -> str:
    found = blocks(page)
    has_main = any(b[3] for b in found)
    size = [(b[1], b[2] / b[1]) for b in found]
    out = []
    for i, (text, words, _, inside, boiler) in enumerate(found):
        before = size[i - 1] if i else (0, 0.0)
        after = size[i + 1] if i + 1 < len(found) else (0, 0.0)
        if classify(tree, (words, size[i][1], *before, *after, inside, has_main and not inside, boiler)):
            out.append(text)
    return " ".join(out)


def extract_main_text(pages: DataFrame, labelled=LABELLED) -> DataFrame:
    """One row per row of pages: page_id, url, text, n_chars.

    pages needs page_id, url and html; other columns are ignored. A null html, or one without content, gives an empty text. Character
    references are decoded, white space in a block becomes one space, blocks are joined by one. Whole pages are read, each in
    its own row's task, without a shuffle; repeated rows are each returned. No rows give no rows.
    """
    tree = train_tree(labelled)

    def run(batches):
        for batch in batches:
            source = as_text(batch.column("html"))
            texts = [main_text(source[i].as_py(), tree) for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    slim = pages.selectExpr("cast(page_id as long) as page_id", "cast(url as string) as url", "cast(html as string) as html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
