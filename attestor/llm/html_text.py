"""Main-text extraction from HTML by two-pass block rules."""

from __future__ import annotations

import bisect
import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestor.llm.common import read_table

#: Function words of some languages; their share of a block's words is its stop-word density.
STOP_WORDS = frozenset(
    """the of and to in a is that it for on with as was be by are this from or an at not
    de la le les des et en un une que qui est pour dans par sur pas au avec du ne se il elle
    der die das und den von zu mit sich auf für ist im dem nicht ein eine als auch es an bei aus
    el los las y del se por con una su para al lo como más o pero sus
    il che di per non sono della con gli dei alla nel os um uma não em ao dos
    het een van dat niet te zijn met op voor""".split()
)
BLOCK_TAGS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
    figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option
    p pre section select summary table tbody td tfoot th thead title tr ul""".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style textarea title noscript iframe svg math template object canvas xmp noembed noframes".split())
#: What stands in these elements is never main text.
CHROME_TAGS = frozenset("nav footer aside form select button menu dialog head".split())
MAIN_TAGS = frozenset("article main".split())
CHROME_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
    cookies copyright disclaimer footer header legal login masthead menu modal nav navbar navigation newsletter notice
    notices pagination pager popup promo promotion related reply replies respond search share sharing sidebar signup
    social sponsor sponsored subscribe subscription toolbar widget widgets""".split()
)
#: Parts of a class name that speak for content.
CONTENT_NAMES = frozenset("article body content entry main post story text".split())
#: Thresholds: characters of a short and of a long block; stop-word densities; share of characters in links. A sign of
#: a script written without spaces counts as so many.
SHORT, LONG, LOW, HIGH, LINKS, WIDE = 70, 200, 0.30, 0.32, 0.20, 3

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)|(?P<text>[^<]++|<)""",
    re.S,
)
NAMES = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
PARTS = re.compile(r"[a-z]+")
WORDS = re.compile(r"[^\W\d_]+")
#: Letters beyond the Latin ones, whose languages the stop words leave out; signs of scripts without spaces.
OTHER = re.compile("[^\\W\\d_\u0000-\u024f\u1e00-\u1eff]")
NO_SPACES = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u9fff\uf900-\ufaff]")
ENDS = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.I) for t in RAW_TAGS}


@dataclass
class Block:
    text: str
    words: int
    stops: int
    linked: int
    size: int
    foreign: bool
    chrome: bool
    weak: bool
    main: int
    heading: bool
    label: str = ""


NONE, WEAK, CHROME = 0, 1, 2


def _kind(tag: str, attrs: str, in_main: bool) -> int:
    """What an element says of its text: CHROME by its tag, or by a class, id or role whose last part (or first, unless
    the last speaks for content) is such a name; WEAK where names speak for both: then the text's own rules decide."""
    if tag in CHROME_TAGS or (tag == "header" and not in_main):
        return CHROME
    if "=" not in attrs or tag in ("html", "body") or tag in MAIN_TAGS:
        return NONE
    found, content = NONE, False
    for value in NAMES.findall(attrs):
        for token in value.lower().strip("\"'").split():
            parts = PARTS.findall(token)
            if not parts or (in_main and "header" in parts):
                continue
            content |= len(parts) == 1 and parts[0] in CONTENT_NAMES
            if parts[-1] in CHROME_NAMES or (parts[0] in CHROME_NAMES and parts[-1] not in CONTENT_NAMES):
                found = CHROME
            elif found == NONE and not CHROME_NAMES.isdisjoint(parts):
                found = WEAK
    return WEAK if found and content else found


def blocks_of(page: str) -> list[Block]:
    """Blocks in page order: runs of text between block-level tags, with what is needed to judge them. Character
    references are decoded once; comments, scripts and other raw elements go; open ends run to the end."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # tag, kind, opens a main part
    depth: Counter[str] = Counter()  # open elements by tag
    chrome = weak = main = anchors = headings = 0
    region = -1  # the main part that is open, by number
    regions = 0
    held: list[tuple[str, bool]] = []

    def flush() -> None:
        nonlocal held
        if held:
            text = " ".join(entities.unescape("".join(t for t, _ in held)).split())
            if text:
                words = [w.lower() for w in WORDS.findall(text)]
                linked = sum(len(" ".join(t.split())) for t, a in held if a)
                size, foreign = len(text), False
                if not text.isascii():
                    foreign = 2 * len(OTHER.findall(text)) > sum(map(len, words))
                    size += (WIDE - 1) * len(NO_SPACES.findall(text))
                out.append(Block(text, len(words), sum(w in STOP_WORDS for w in words), linked, size, foreign, chrome > 0, weak > 0, region if main else -1, headings > 0))
            held = []

    def pop(tag: str) -> None:
        nonlocal chrome, weak, main, anchors, headings
        if not depth[tag]:
            return
        name = ""
        while name != tag:  # each element is taken off once, so no markup takes more than its length
            name, c, m = stack.pop()
            depth[name] -= 1
            chrome -= c == CHROME
            weak -= c == WEAK
            main -= m
            anchors -= name == "a"
            headings -= name in ("h1", "h2", "h3", "h4", "h5", "h6")

    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        if (t := m["text"] if m["text"] is not None else m["cdata"]) is not None:
            held.append((t, anchors > 0))
            continue
        tag = m["tag"] or m["tag2"]
        if not tag:
            continue
        tag, attrs, closing = tag.lower(), m["attrs"] or m["attrs2"] or "", (m["close"] or m["close2"]) == "/"
        if tag in RAW_TAGS:
            if not closing and not attrs.rstrip().endswith("/"):
                done = ENDS[tag].search(page, at)
                at = done.start() if done else end
            continue
        if tag == "br":
            held.append((" ", anchors > 0))
            continue
        if tag in BLOCK_TAGS:
            flush()
        if tag in VOID_TAGS:
            continue
        if closing:
            pop(tag)
            continue
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd", "option") and stack and stack[-1][0] == tag:
            pop(tag)
        elif tag in BLOCK_TAGS and "p" in (names := [s[0] for s in stack[-4:]]):  # a block ends an open paragraph
            if not any(x in BLOCK_TAGS and x != "p" for x in names[names.index("p") + 1 :]):
                pop("p")
        if tag == "a" and anchors:
            pop("a")
        c, opens = _kind(tag, attrs, main > 0), tag in MAIN_TAGS or "role=\"main\"" in attrs
        if opens and not main:
            regions += 1
            region = regions
        chrome += c == CHROME
        weak += c == WEAK
        depth[tag] += 1
        main += opens
        anchors += tag == "a"
        headings += tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        stack.append((tag, c, opens))
    flush()
    return out


def judge(blocks: list[Block]) -> None:
    """Pass 1 decides by place, link density, length and stop-word density; short and middling blocks stay open, headings
    too. Blocks of scripts that the stop words leave out are judged by length and links alone; blocks under names that
    speak for and against content must be good by themselves.

    Pass 2 gives each open block the label of its nearest decided neighbour (the earlier of two as near), a middling one
    that of the better of its neighbours, a heading that of what follows it. Where a page has main parts, text outside
    them is boilerplate, the bar inside is lower, and open blocks look for neighbours of their part; a main part in which
    no block can be decided is text, as nothing but its tag speaks for either."""
    has_main = any(b.main >= 0 for b in blocks)
    for b in blocks:
        share, inside = b.linked / len(b.text), b.main >= 0
        density = HIGH if b.foreign else b.stops / max(1, b.words)
        if b.chrome or (has_main and not inside):
            b.label = "bad"
        elif share > (0.5 if inside else LINKS):
            b.label = "bad"
        elif b.size < SHORT or b.heading:
            b.label = "bad" if share and not inside else "short"
        elif density >= HIGH:
            b.label = "good" if b.size > LONG or inside else "near"
        else:
            b.label = "near" if density >= LOW or inside else "bad"
        if b.weak and b.label != "good":
            b.label = "bad"
    first = [b.label for b in blocks]
    # what stands in menus and the like inside a main part says nothing of the text around it
    decided = [i for i, b in enumerate(blocks) if first[i] in ("good", "bad") and not (has_main and b.chrome)]
    for i, b in enumerate(blocks):
        if first[i] in ("good", "bad"):
            continue
        at = bisect.bisect(decided, i)
        near = [j for j in decided[max(0, at - 1) : at + 1] if blocks[j].main == b.main]
        if b.heading and (later := [j for j in near if j > i]):
            near = later
        if not near:
            b.label = "good" if b.main >= 0 or (first[i] == "near" and not decided) else "bad"
        elif first[i] == "near" and any(first[j] == "good" for j in near):
            b.label = "good"
        else:
            b.label = first[min(near, key=lambda j: (abs(j - i), j))]


def main_text(page: str | None) -> str:
    """The blocks judged to be main text, joined by one space. Null and empty pages give an empty text."""
    if not page:
        return ""
    blocks = blocks_of(page)
    judge(blocks)
    return " ".join(b.text for b in blocks if b.label == "good")


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds text and n_chars (its code points) to each page, from its whole html; columns of these names are replaced.

    One scan without a shuffle; every row is on its own, so repeated rows and empty tables need no care."""
    names = [c for c in pages.columns if c not in ("text", "n_chars") or c == html]
    types, at = dict(pages.dtypes), names.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p) for p in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"]
            )

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), "text string", "n_chars long"])
    return pages.select(*(F.col(f"`{c}`") for c in names)).mapInArrow(run, schema)


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
