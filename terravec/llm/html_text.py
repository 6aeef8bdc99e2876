"""HTML extraction: the contiguous region of a page whose score is highest, words counting for it and tags against it.

A page is a row of tokens, words and tags. A tag costs what labelled pages say: the log odds that a tag of its kind stands
outside the main text against inside. A word earns what its surroundings say (the innermost telling element, the names of the
elements around it, or a link): the log odds of words there to be inside. A linear scan finds the maximum-scoring run of blocks.
Labelled pages are those whose markup says what is main (an article or main element, as far as it isn't in an aside, a comment
list and so on); on such a page, being outside that element is a surrounding of its own. Names of classes, ids and roles weigh
what labelled pages say, with a list of usual names as the prior. Elements that never hold main text (scripts, styles, menus) are
no part of the row; asides and what their names make worse than nothing are left out of the region.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terravec.llm.common import table

#: Bound of the labelled sample: pages, by a hash of the id.
SAMPLE_PAGES = 300
SAMPLE_CHARS = 200_000
#: Elements without main text, whose content is passed over.
SKIPPED = {"script", "style", "noscript", "template", "svg", "iframe", "canvas", "head", "title", "nav", "button", "select", "textarea", "dialog", "menu"}
#: Of these, the content is raw: nothing ends it but its own end tag.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Elements that stand within a line of text; all others end a block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Formulas stand within a line too; their annotations aren't shown.
MATH = {"math", "semantics", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "menclose", "mfenced", "merror", "mmultiscripts", "mprescripts", "none"}
INLINE |= MATH
UNSHOWN = {"annotation", "annotation-xml"}
#: Blocks that a new block of their kind ends.
SELF_CLOSING = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
MAIN = {"article", "main"}
ASIDES = {"aside", "header", "footer", "nav"}
#: Names of classes, ids and roles that mark text which is not the article: those that hardly ever mean anything else, and others.
NOISE = re.compile(r"advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|newsletter|subscribe|signup|share|sharing|social|sidebar|breadcrumbs?|pagination|comments?|commentlist|respond|disqus|ads?", re.I)
DOUBTFUL = re.compile(r"banner|notice|alert|overlay|related|recommend\w*|widget|menu|nav\w*|pager|toolbar|header|masthead|footer|copyright|reply|replies|discussion|login|search|skip|form", re.I)
#: A part after one of these says what the page has, not what the element is.
_HAVING = re.compile(r"has|have|no|not|with|without|is|hide|show", re.I)
#: What a name weighs before any page is seen: a whole name, and a doubtful one that is a part of a name or stands on a line of text.
WHOLE, PART = -4.0, -1.5
#: Words of a line of prose, at least.
PROSE_WORDS = 8
#: What a linked word in a main element still earns: a list of links there is text, if nothing else speaks against it.
LINKED = 0.1
#: Words that the prior of a name counts as.
PRIOR_WORDS = 200
#: Elements whose content is a line of text.
LINES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td", "th", "dd", "dt", "pre", "blockquote", "figcaption", "caption"}
MAIN_NAME = re.compile(r"(?:^|[\s_-])(?:article|main|content|post|entry|story|body|text)(?:$|[\s_-])", re.I)
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
#: Up to the first text or heading after a tag.
_LEAD = re.compile(r"(?:\s+|<!--.*?(?:-->|$)|<(?![hH][1-6][\s/>])[/a-zA-Z][^>]*(?:>|$))*+", re.S)
_HEADING = re.compile(r"<h[1-6][\s/>]", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s=/]|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_SPACE = re.compile(r"\s+")


@dataclass
class Block:
    """Text between two tags that end blocks: its words, those in links, the tags before it, and its surroundings.

    noise: it is in an aside or hidden. names: those of the elements around it that tell something. wrap: where the outermost
    element of such a name begins, or -1; inner: a main element is between. node: the innermost such element outside main ones.
    """

    text: str
    words: int
    link_words: int
    tags: list[str]
    around: str
    main: bool
    noise: bool
    wrap: int = -1
    inner: bool = False
    names: tuple[str, ...] = ()
    node: int = -1

    @property
    def prose(self) -> bool:
        return self.words >= PROSE_WORDS and 2 * self.link_words < self.words


@dataclass
class Weights:
    """tag: cost of each tag (key: its name, with a slash before an end tag's). word: what a word earns by surroundings; name: and
    by the names around it (a name that isn't there weighs its prior)."""

    tag: dict[str, float] = field(default_factory=dict)
    word: dict[str, float] = field(default_factory=dict)
    name: dict[str, float] = field(default_factory=dict)
    other_tag: float = 0.5
    link: float = -1.0


#: Without any labelled page.
DEFAULT = Weights({"p": 0.2, "/p": 0.2}, {"outside": -3.0, "aside": -3.0, "main": 2.0, "plain": 0.6, "named": 0.8})


def telling(names: list[str], line: bool) -> tuple[str, ...]:
    """The names that weigh something: whole ones as they are, doubtful ones that weigh less with a tilde before them."""
    out = []
    for name in names:
        parts = [x for x in re.split(r"[-_]+", name) if x]
        for k, part in enumerate(parts):
            if k and _HAVING.fullmatch(parts[k - 1]):
                continue
            if NOISE.fullmatch(part) or DOUBTFUL.fullmatch(part):
                weak = line or (len(parts) > 1 and (DOUBTFUL.fullmatch(part) or part.lower() in ("ad", "ads")))
                out.append(("~" if weak else "") + part.lower())
    return tuple(out)


def prior(name: str) -> float:
    return PART if name[0] == "~" else WHOLE


def blocks(page: str) -> tuple[list[Block], list[str]]:
    """The blocks of a page in order, and the tags after the last one.

    The name of the page's wrapper tells nothing; what is in a wrapper is judged by itself, wrappers in it too.
    """
    spared: set[int] = set()
    while True:
        found, rest, whole, elements = _blocks(page, spared)
        wrappers = _wrappers(found, whole, elements)
        if not wrappers:
            return found, rest
        spared.update(wrappers)


def _wrappers(found: list[Block], whole: set[int], elements: list[tuple[int, int]]) -> list[int]:
    """Where elements begin that are noise by their names but hold most words of the page: one, and those in it that are so too.

    It has to hold a main element with most of its words, and more than main elements elsewhere; or no element elsewhere is main
    and its name only has a telling part (header-fixed; whole names are in whole), or all words are in it. An element in it that
    holds most words, and all of its words that are in main elements, is one for the same reason. elements: (the one around it, where
    it begins) of named elements that are in no main one.
    """
    if all(b.wrap < 0 for b in found):
        return []
    shown = [b for b in found if not b.noise or b.wrap >= 0]
    total, outer = sum(b.words for b in shown), sum(b.words for b in shown if b.main)
    n, inner = Counter(), Counter()
    for b in shown:
        if b.wrap >= 0:
            n[b.wrap] += b.words
            inner[b.wrap] += b.words * b.inner
    for wrap in n:
        by_main = 2 * inner[wrap] > n[wrap] and inner[wrap] > outer
        if 2 * n[wrap] <= total or not (by_main or outer == 0 and (n[wrap] == total or wrap not in whole)):
            continue
        held, main = [0] * len(elements), [0] * len(elements)
        for b in shown:
            if b.node >= 0:
                held[b.node] += b.words
                main[b.node] += b.words * b.inner
        for k in range(len(elements) - 1, -1, -1):
            if (up := elements[k][0]) >= 0:
                held[up], main[up] = held[up] + held[k], main[up] + main[k]
        large = {up: k for k, (up, _) in enumerate(elements) if 2 * held[k] > total}  # at most one in each
        at, out = next(k for k, (_, start) in enumerate(elements) if start == wrap), [wrap]
        while (k := large.get(at)) is not None and main[k] == main[at] and (by_main or held[k] == total or elements[k][1] not in whole):
            out.append(elements[k][1])
            at = k
        return out
    return []


def _blocks(page: str, spared: set[int]) -> tuple[list[Block], list[str], set[int], list[tuple[int, int]]]:
    """The blocks and the tags after the last one, where elements begin that a whole word names as noise, and the named elements;
    names of the elements that begin at spared don't count."""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int, bool, tuple[str, ...], int]] = []  # name, surroundings, noise, wrap, inner, names, node
    elements: list[tuple[int, int]] = []
    ends: dict[str, dict[int, int] | list[int]] = {}
    headed = (-1, -1, False)  # from where to where no heading was looked for in vain, or one was found
    loud_names: tuple[str, ...] = ()
    whole: set[int] = set()
    text: list[str] = []
    links = loud = quiet = 0  # words in links, in inline elements named as noise, and where the last of these ends
    tags: list[str] = []
    pos, end = 0, len(page)
    in_link = 0

    def flush() -> None:
        nonlocal text, links, tags, loud, loud_names
        joined = _SPACE.sub(" ", html.unescape("".join(text))).strip()
        text = []
        if joined:
            _, around, noise, wrap, inner, names, node = stack[-1] if stack else ("", "plain", False, -1, False, (), -1)
            words = joined.count(" ") + 1
            if loud >= words:  # nothing else is in the line
                names += tuple(x for x in loud_names if x not in names)
            out.append(Block(joined, words, links, tags, around, around == "main", noise, wrap, inner, names, node))
            tags = []
        links = loud = 0
        loud_names = ()

    while pos < end:
        at = page.find("<", pos)
        if at < 0:
            at = end
        if at > pos:
            text.append(page[pos:at])
            if in_link or pos < quiet:
                n = len(page[pos:at].split())
                links, loud = links + in_link * n, loud + (pos < quiet) * n
        if at >= end:
            break
        m = _TOKEN.match(page, at)
        if not m:  # a bare "<" is text
            text.append("<")
            pos = at + 1
            continue
        pos = m.end()
        if not m[2]:
            if m[0].startswith("<![CDATA["):
                text.append(html.escape(m[0][9:].removesuffix("]]>")))
            continue
        name, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if name in SKIPPED and not closing and not attributes.rstrip().endswith("/"):
            flush()
            tags.append(name)
            pos = _skip(page, pos, name, ends)
            tags.append("/" + name)
            continue
        if name in UNSHOWN and not closing and not attributes.rstrip().endswith("/"):
            pos = _skip(page, pos, name, ends)
            continue
        if name in INLINE or name in UNSHOWN:
            if name == "br":
                text.append(" ")
            if name == "a":
                in_link = 0 if closing else 1
            if not closing and name not in VOID:
                if _HIDDEN.search(attributes):
                    pos = _skip(page, pos, name, ends)
                elif found := telling(_named(attributes), False):
                    quiet = max(quiet, _skip(page, pos, name, ends))
                    loud_names += tuple(x for x in found if x not in loud_names)
            continue
        flush()
        tags.append(("/" if closing else "") + name)
        in_link = 0
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
        elif name not in VOID:
            if name in SELF_CLOSING and stack and stack[-1][0] == name:
                stack.pop()
            _, around, noise, wrap, inner, names, node = stack[-1] if stack else ("", "plain", False, -1, False, (), -1)
            own = _named(attributes)
            told = () if at in spared or name in ("html", "body", *MAIN) else telling(own, name in LINES)
            if name == "form" and at not in spared and _skip(page, pos, name, ends) > pos:
                told += ("<form>",)
            if told:
                names += tuple(x for x in told if x not in names)
                if around != "main" and not inner:
                    elements.append((node, at))
                    node = len(elements) - 1
                if wrap < 0:
                    wrap = at
                    if any(NOISE.fullmatch(x) or DOUBTFUL.fullmatch(x) for x in own):
                        whole.add(at)
            if _HIDDEN.search(attributes):
                around, noise, wrap = "aside", True, -1
            elif name in ASIDES:
                # a header within the article that holds its heading is a part of it; a page's header isn't
                heads = False
                if name == "header" and around == "main":
                    if not headed[0] <= pos <= headed[1]:
                        m = _LEAD.match(page, pos)
                        headed = (pos, m.end(), _HEADING.match(page, m.end()) is not None)
                    heads = headed[2]
                if not heads:
                    around, noise, wrap = "aside", True, -1
            elif wrap < 0 and not noise and (name in MAIN or "main" in own and "role" in attributes.lower()):
                around = "main"
            elif around == "plain" and name == "div" and MAIN_NAME.search(" ".join(own)):
                around = "named"
            stack.append((name, around, noise, wrap, inner or wrap >= 0 and name in MAIN, names, node))
    flush()
    return out, tags, whole, elements


def _named(attributes: str) -> list[str]:
    return [x for a, b, c in _NAMES.findall(attributes) for x in (a or b or c).split()]


def _skip(page: str, pos: int, name: str, ends: dict[str, dict[int, int] | list[int]]) -> int:
    """Where the element ends whose start tag ends at pos; nested ones of its name are its own, unless its content is raw.

    ends holds what is known of the page: by name, the end of each element by that of its start tag, found in one pass.
    """
    if name in RAW:
        if name not in ends:
            closing = [m.span() for m in re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|$)", re.I).finditer(page)]
            ends[name], ends["/" + name] = [a for a, _ in closing], [b for _, b in closing]
        k = bisect_left(ends[name], pos)
        return ends["/" + name][k] if k < len(ends[name]) else len(page)
    if name not in ends:
        known, open_ = {}, []
        for m in re.compile(rf"<(/?){re.escape(name)}(?=[\s/>])[^>]*(?:>|$)", re.I).finditer(page):
            if m[1]:
                if open_:
                    known[open_.pop()] = m.end()
            elif not m[0].endswith("/>"):
                open_.append(m.end())
        ends[name] = known
    if pos in ends[name]:
        return ends[name][pos]
    if name in ("nav", "form", "annotation", "annotation-xml", "menu", "head", "button", "select", "dialog") or name in INLINE:
        return pos  # never closed: its text is judged with the rest
    return len(page)


def _inside(b: Block) -> bool:
    """The label: in the main element, and in nothing there that is surely something else."""
    return b.main and not b.noise and all(_doubtful(x) or prior(x) > WHOLE for x in b.names)


def _doubtful(name: str) -> bool:
    return DOUBTFUL.fullmatch(name.lstrip("~")) is not None and not NOISE.fullmatch(name.lstrip("~"))


def fit(pages: list[str]) -> Weights:
    """Weights from pages that have a main element; the default ones if none has."""
    inside, outside, words_in, words_out = Counter(), Counter(), Counter(), Counter()
    names_in, names_out = Counter(), Counter()
    links_in = links_out = 1
    for page in pages:
        found, rest = blocks(page or "")
        if not any(b.main for b in found):
            continue
        before = False
        for b in found:
            label = _inside(b)
            (inside if label and before else outside).update(b.tags)
            (words_in if label else words_out)[_around(b, True)] += b.words
            for x in set(b.names):
                (names_in if label else names_out)[x] += b.words
            links_in, links_out = links_in + label * b.link_words, links_out + (not label) * b.link_words
            before = label
        outside.update(rest)
    if not words_in:
        return DEFAULT
    total_in, total_out = sum(inside.values()) + 1, sum(outside.values()) + 1
    w = Weights()
    for tag in inside.keys() | outside.keys():
        odds = math.log((outside[tag] + 0.5) / total_out) - math.log((inside[tag] + 0.5) / total_in)
        w.tag[tag] = min(4.0, max(0.05, 0.5 + odds))
    n_in, n_out = sum(words_in.values()), sum(words_out.values()) + 1
    for around in ("main", "outside", "aside"):
        a, b = words_in[around], words_out[around]
        w.word[around] = max(-4.0, min(2.0, math.log((a + 0.5) / n_in) - math.log((b + 0.5) / n_out))) if a + b else DEFAULT.word[around]
    # where no element is main, text in none that tells anything counts by what else is known: its tags, links and names
    w.word["plain"], w.word["named"] = DEFAULT.word["plain"], DEFAULT.word["named"]
    for x in names_in.keys() | names_out.keys():
        odds = math.log((names_in[x] + 0.5) / n_in) - math.log((names_out[x] + 0.5) / n_out)
        seen = names_in[x] + names_out[x]
        w.name[x] = max(-6.0, min(0.0, (seen * odds + PRIOR_WORDS * prior(x)) / (seen + PRIOR_WORDS)))
    w.link = min(-0.5, math.log(links_in / n_in) - math.log(links_out / n_out))
    return w


def _around(b: Block, has_main: bool) -> str:
    """On a page with a main element, all text of other surroundings is outside it."""
    return "outside" if has_main and b.around in ("plain", "named") else b.around


def _gains(found: list[Block], w: Weights) -> list[float | None]:
    """What the words of each block earn; None: it is left out of the text, so it stands in no region's way.

    In a main element doubtful names weigh nothing on blocks among which is prose, and elsewhere no name weighs more than its prior
    there; where none does, linked words earn something too.
    """
    has_main, out = any(b.main for b in found), []
    for (names, main), run in groupby(found, key=lambda b: (b.names, b.main)):
        together = list(run)
        prose = main and any(b.prose for b in together)
        weights = (prior(x) if main else w.name.get(x, prior(x)) for x in set(names) if not (prose and _doubtful(x)))
        name = max(-6.0, sum(weights))
        for b in together:
            each = w.word.get(_around(b, has_main), 0.6) + name
            link = max(w.link, LINKED - each) if main and name >= 0 else w.link
            gain = b.words * each + b.link_words * link
            out.append(None if b.noise and each <= 0 or name < 0 and gain <= 0 else gain)
    return out


def region(found: list[Block], w: Weights, gains: list[float | None] | None = None) -> tuple[int, int]:
    """The blocks [a, b) of the highest score; the first of equals, and (0, 0) if none is above zero."""
    best, span, run, start, within = 0.0, (0, 0), 0.0, 0, False
    for k, (b, gain) in enumerate(zip(found, gains or _gains(found, w), strict=True)):
        if gain is None:
            continue
        cost = sum(w.tag.get(t, w.other_tag) for t in b.tags)
        if b.main and within:  # tags within a main element don't part its text, however short
            cost = min(cost, max(gain, 0.0) / 2)
        within = b.main
        if run - cost <= 0:
            run, start = gain, k  # the tags before the first block are outside
        else:
            run += gain - cost
        if run > best:
            best, span = run, (start, k + 1)
        if run < 0:
            run = 0.0
    return span


def main_text(page: str | None, w: Weights = DEFAULT) -> str:
    """The article's blocks, joined by two line ends. Where nothing is above zero and the page has a main element, that is the text."""
    found, _ = blocks(page or "")
    gains = _gains(found, w)
    a, b = region(found, w, gains)
    if a < b:
        return "\n\n".join(x.text for x, gain in zip(found[a:b], gains[a:b], strict=True) if gain is not None)
    return "\n\n".join(x.text for x in found if _inside(x))


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> Weights:
    """Weights of up to ``sample`` pages of at most SAMPLE_CHARS characters each, by a hash of the id; of a repeated id, the page
    that sorts first."""
    usable = pages.filter(F.char_length(html_col) <= SAMPLE_CHARS)
    ids = F.broadcast(usable.select(id_col).orderBy(F.xxhash64(id_col, F.lit(42)), id_col).limit(sample).distinct())
    rows = usable.join(ids, id_col).groupBy(id_col).agg(F.min(html_col).alias("html")).collect()
    return fit([r["html"] for r in sorted(rows, key=lambda r: str(r[0]))])


def extracted(pages: DataFrame, w: Weights, html_col: str = "html") -> DataFrame:
    """pages with text and n_chars (code points) in place of columns of those names.

    Empty text for null, empty or textless pages; of equally good regions the first. Pages of any length are read whole, in time
    proportional to it. Rows stay as many as they are, repeated ones with equal texts; other columns pass through, whatever
    their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py(), w) for x in batch.column(html_col)]
            yield batch.append_column("text", pa.array(texts, pa.string())).append_column("n_chars", pa.array([len(t) for t in texts], pa.int64()))

    own = pages.drop("text", "n_chars")
    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extracted(pages, train(pages)).select("page_id", "url", "text", "n_chars")
