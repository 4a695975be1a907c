"""Main text of web pages by line-block distribution.

Markup is stripped to lines: every block element's text is a line, what cannot be content (scripts,
navigation, notices, forms, comments and the like) leaves a line without length. The text lengths of
``WINDOW`` following lines are summed. Where the sums surge from nothing text begins, where they dive
to nothing it ends. Stretches of one element that only stripped parts cut are joined again; those whose
sums peak high enough are kept, whole. Article and main elements are a weight on the peaks, not a rule.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import query, table

WINDOW = 3
#: A stretch is kept if its highest window sum is at least this share of the page's highest.
PEAK = 0.15
#: How many times the peaks count of stretches in article or main elements, when the leading stretch is
#: looked for, and then of all stretches that are inside or outside such elements as the leading one is.
WEIGHT = 3
#: A stretch is a link list if more than this share of its characters are link text.
LINKS = 0.6
#: Names cannot take more of a page's text than what leaves this share.
LEAST = 0.1

# Fixed values of HTML: elements that begin a new line, that hold no text, and that hold no content.
BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol
    optgroup option p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_CONTENT = frozenset(
    """head nav footer aside form menu dialog template noscript button select datalist svg math canvas
    audio video object map search""".split()
)
#: A header inside the article holds its title; one outside belongs to the site.
CONTENT = frozenset(("article", "main"))
#: Elements that hold lines together, and those that stand between the parts of a page.
BOXES = CONTENT | frozenset("blockquote center dd details div dl fieldset figure li ol section table td th ul".split())
#: Elements whose end tag may be left out, with the start tags that end them and, where those do not count,
#: the elements that may stand between. Any of them also ends with the element around it.
ROWS = ("tbody", "tfoot", "thead")
ENDED_BY = {
    "p": (BLOCKS - {"option", "optgroup"}, ()), "li": (("li",), ("ul", "ol", "menu")), "head": (BLOCKS - {"head"}, ()),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "caption": (("tr", *ROWS), ("table",)),
    "td": (("td", "th", "tr", *ROWS), ("table",)), "th": (("td", "th", "tr", *ROWS), ("table",)),
    "tr": (("tr", *ROWS), ("table",)), **{x: (ROWS, ("table",)) for x in ROWS},
}
FURNITURE = frozenset("nav header footer aside menu search".split())
#: Words in class, id or role that name other parts of a page, and words that only go with them. A name counts
#: if all its words are of these and one is of the first.
PART = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alerts?|popup|modal|"
    r"overlay|newsletter|subscribe|signup|login|menu|nav|navbar|navigation|breadcrumbs?|sidebar|rail|widget\w*|"
    r"comments?|respond|replies|disqus|footer|masthead|topbar|toolbar|share|sharing|social|related|recommended|"
    r"pagination|pager|contentinfo|complementary|skiplink|siteheader|pageheader|copyright|hidden)",
    re.I,
)
BESIDE = re.compile(
    r"(?:\d+|area|articles?|bar|block|body|bottom|box|btn|button|buttons|card|col|column|container|content|fixed|"
    r"form|group|header|heading|icons?|inner|item|items|js|left|links?|list|main|mobile|module|outer|page|panel|"
    r"policy|posts?|primary|right|row|secondary|section|site|skip|slot|small|stories|sticky|template|text|the|thread|"
    r"title|top|unit|wrap|wrapper|zone)",
    re.I,
)
WORDS = re.compile(r"[^\W_]+")
#: Elements that are text themselves: an id on them is a place to link to, not a part of the page.
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th".split())
TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=$|[\s/=])|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}


def _names_part(name: str) -> bool:
    words = WORDS.findall(CAMEL.sub("-", name))
    if "".join(words[:2]).lower() in ("skiplink", "siteheader", "pageheader"):
        return True
    part = [bool(PART.fullmatch(w)) for w in words]
    return any(part) and all(p or BESIDE.fullmatch(w) for p, w in zip(part, words))


def _other_part(name: str, attrs: str, by_name: bool) -> bool:
    """Whether an element is hidden, or (``by_name``) named as another part of the page."""
    if by_name and "=" in attrs:
        for m in NAMED.finditer(attrs):
            if m[1].lower() == "id" and name in TEXTS:
                continue
            if any(_names_part(x) for x in (m[2] or m[3] or m[4] or "").split()):
                return True
    return bool(HIDDEN.search(attrs)) if attrs.strip() else False


INSERT, PARTING, EDGE = range(3)


class Line(NamedTuple):
    text: str
    #: Characters of link text.
    linked: int
    #: Inside an article or main element.
    own: bool
    #: The innermost element that holds it; for a line without text the one that held the stripped part.
    box: int
    #: Kind of the stripped part: an insert, furniture of the page, or the edge of an article or main element.
    kind: int = INSERT


class Box(NamedTuple):
    """Lines begin..end-1 are in the element."""

    begin: int
    end: int

    def holds(self, a: int, b: int) -> bool:
        return self.begin <= a and b < self.end


def lines(page: str, by_name: bool = True) -> tuple[list[Line], list[Box]]:
    """The page's lines, where ``WINDOW`` lines without text stand for a stripped part, and its elements
    by number; the first is the page. ``by_name``: class, id and role tell parts, never of article and main."""
    out: list[Line] = []
    text: list[str] = []
    linked = depth_a = 0
    skip: list[str] = []
    begins, ends, inside = [0], [len(page) + 1 << 3], [("", 0)]
    opened: Counter = Counter()
    at, n = 0, len(page)

    def content() -> bool:
        return opened["article"] + opened["main"] > 0

    def end_line(gap: bool = False, kind: int = INSERT) -> None:
        nonlocal linked
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            out.append(Line(joined, linked, content(), inside[-1][1]))
        if gap:
            out.extend([Line("", 0, content(), inside[-1][1], kind)] * WINDOW)
        linked = 0

    def ends_skipped(name: str) -> bool:
        by, between = ENDED_BY.get(skip[0], ((), ()))
        return name in by and not any(x in between for x in skip)

    def enter(name: str) -> None:
        opened[name] += 1
        if name in BOXES:
            inside.append((name, len(begins)))
            begins.append(len(out))
            ends.append(ends[0])

    def leave(name: str) -> None:
        if not opened[name]:
            return
        opened[name] -= 1
        if name in BOXES:
            while True:
                last, box = inside.pop()
                ends[box] = len(out)
                if last == name:
                    break
                opened[last] -= 1

    while at < n:
        m = TOKEN.search(page, at)
        begin = m.start() if m else n
        if begin > at and not skip:
            piece = entities.unescape(page[at:begin])
            text.append(piece)
            if depth_a:
                linked += len(piece.strip())
        if m is None:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attrs = bool(m[1] or m[4]), m[3] or m[6] or ""
        if skip:
            if closing and name in skip:
                while skip.pop() != name:
                    pass
                if not skip:
                    end_line(True, PARTING if name in FURNITURE else INSERT)
                continue
            # The article ends what was left open before it.
            if not closing and name in CONTENT and not content() and not _other_part(name, attrs, False):
                skip.clear()
                end_line(True, EDGE)
            elif closing and opened[name] and name != "p" or not closing and ends_skipped(name):
                kind = PARTING if skip[0] in FURNITURE else INSERT
                skip.clear()
                end_line(True, kind)
            else:
                if not closing and name in RAW:
                    found = RAW_END[name].search(page, at)
                    at = found.start() if found else n
                elif not closing and (name == skip[0] or name in BLOCKS and name not in VOID and (name != skip[-1] or name not in ENDED_BY)):
                    skip.append(name)
                continue
        if closing:
            if name in CONTENT:
                end_line(True, EDGE)
            elif name in BLOCKS:
                end_line()
            if name in BLOCKS:
                leave(name)
            elif name == "a":
                depth_a = max(0, depth_a - 1)
            continue
        if name in RAW:
            found = RAW_END[name].search(page, at)
            at = found.start() if found else n
            end = TOKEN.match(page, at)
            at = end.end() if end else n
            continue
        own = attrs.rstrip().endswith("/") or name in VOID
        other = name in NOT_CONTENT or name == "header" and not content() or name not in ("body", "html") and _other_part(name, attrs, by_name and name not in CONTENT)
        if other and not own:
            end_line(name in BLOCKS or name == "head", PARTING if name in FURNITURE else INSERT)
            skip.append(name)
            continue
        if name in CONTENT:
            end_line(True, EDGE)
        elif name in BLOCKS:
            end_line()
        if name in BLOCKS:
            if name not in VOID:
                enter(name)
        elif name == "br":
            text.append(" ")
        elif name == "a" and not own:
            depth_a += 1
    end_line()
    return out, [Box(*x) for x in zip(begins, ends)]


def stretches(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int, int]]:
    """(surge, dive, peak): lines surge..dive-1 hold text; the window sums rise from nothing at the
    surge, fall back to nothing at the dive, and reach the peak between."""
    out, n = [], len(lengths)
    total = sum(lengths[:window])
    surge, peak = None, 0
    for i in range(n):
        if surge is None and total > 0 and lengths[i] > 0:
            surge, peak = i, 0
        if surge is not None:
            if total == 0:
                out.append((surge, i, peak))
                surge = None
            else:
                peak = max(peak, total)
        total += (lengths[i + window] if i + window < n else 0) - lengths[i]
    if surge is not None:
        out.append((surge, n, peak))
    return out


def _is_links(found: list[Line]) -> bool:
    return sum(x.linked for x in found) > LINKS * sum(len(x.text) for x in found)


def _hangs(found: list[Line], boxes: list[Box], a: int, b: int, by: int) -> bool:
    """Whether lines a..b-1 are in the element that holds line ``by``."""
    return 0 <= by < len(found) and boxes[found[by].box].holds(a, b - 1)


def _joins(found: list[Line], boxes: list[Box], before: tuple[int, int, int], after: tuple[int, int, int]) -> bool:
    """Whether two stretches with nothing but stripped parts between them belong together: one element below
    the page holds their ends and the parts, or the page holds all directly or parts that are no furniture. A
    link list belongs to the other only if it is in the same element."""
    a, b = before[1] - 1, after[0]
    if before[1] == b:
        return False
    for gap in found[a + 1 : b]:
        direct = found[a].box == found[b].box == gap.box
        if gap.kind == EDGE or not boxes[gap.box].holds(a, b) or not gap.box and gap.kind == PARTING and not direct:
            return False
    lists = [_is_links(found[x:y]) for x, y, _ in (before, after)]
    if lists[0] == lists[1]:
        return True
    return _hangs(found, boxes, *before[:2], b) if lists[0] else _hangs(found, boxes, *after[:2], a)


def _apart(found: list[Line], boxes: list[Box], parts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Stretches with the link lists beside the text, ``WINDOW`` lines or more in an element of their own,
    as stretches of their own. Links within the element of the text before or after are part of it."""
    out = []
    for a, b, peak in parts:
        cuts, i = [a], a
        while i < b:
            j = i
            while j < b and found[j].linked > LINKS * len(found[j].text):
                j += 1
            if j - i >= WINDOW and (i > a or j < b):
                sides = [by for by in (i - 1, j) if a <= by < b]
                if not any(_hangs(found, boxes, i, j, by) for by in sides):
                    cuts += [i, j]
            i = max(j, i + 1)
        cuts = sorted({*cuts, b})
        if len(cuts) == 2:
            out.append((a, b, peak))
        else:
            out += [(x, y, stretches([len(z.text) for z in found[x:y]])[0][2]) for x, y in zip(cuts, cuts[1:])]
    return out


def _groups(found: list[Line], boxes: list[Box], parts: list[tuple[int, int, int]]) -> list[int]:
    """Number of the joined stretch that each stretch belongs to."""
    up = list(range(len(parts)))

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    first: dict[int, int] = {}
    for i, (a, b, _) in enumerate(parts):
        if i and _joins(found, boxes, parts[i - 1], parts[i]):
            up[root(i)] = root(i - 1)
        if i > 1 and parts[i - 2][1] == parts[i - 1][0] and parts[i - 1][1] == a:  # a link list was taken out between
            up[root(i)] = root(i - 2)
        for line in found[a:b]:
            if line.box:
                up[root(i)] = root(first.setdefault(line.box, i))
    return [root(i) for i in range(len(parts))]


def main_text(page: str | None) -> str:
    """The kept blocks joined by line feeds; empty if there are none. Names of parts that would leave less than
    ``LEAST`` of the text that the page has without them do not count."""
    page = page or ""
    found, boxes = lines(page)
    size = sum(len(x.text) for x in found)
    if size < LEAST * len(page):  # a page is longer than its text
        plain = lines(page, False)
        if size < LEAST * sum(len(x.text) for x in plain[0]):
            found, boxes = plain
    parts = _apart(found, boxes, stretches([len(x.text) for x in found]))
    group = _groups(found, boxes, parts)
    size, linked = Counter(), Counter()
    for g, (a, b, _) in zip(group, parts):
        size[g] += sum(len(x.text) for x in found[a:b])
        linked[g] += sum(x.linked for x in found[a:b])
    peak: dict[int, int] = {}
    for g, (_, _, p) in zip(group, parts):
        if linked[g] <= LINKS * size[g]:
            peak[g] = max(peak.get(g, 0), p)
    own = {g: found[a].own for g, (a, _, _) in zip(group, parts) if g in peak}
    lead = max(peak, key=lambda g: (peak[g] * (WEIGHT if own[g] else 1), own[g]), default=None)
    strength = {g: p * (WEIGHT if own[g] == own[lead] else 1) for g, p in peak.items()}
    least = PEAK * max(strength.values(), default=0)
    kept = [part for g, part in zip(group, parts) if strength.get(g, -1) >= least]
    return "\n".join(x.text for a, b, _ in kept for x in found[a:b] if x.text)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Null and empty html give an empty text, html without markup is one line and kept. Damaged markup
    is read as far as it goes. Repeated rows give repeated results; other columns are not looked at.
    """
    kind = pages.schema[id_col].dataType

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({
                "page_id": batch["page_id"], "url": batch["url"], "text": [main_text(h) for h in batch["html"]],
            })

    own = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html")
    )
    return own.mapInPandas(read, "page_id string, url string, text string").select(
        F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars")
    )


@query("op4_html_extraction")
def op4_html_extraction(spark, sf_dir):
    return extract(table(spark, sf_dir, "pages"))
