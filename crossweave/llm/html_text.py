"""Main text of HTML pages by block rules in two passes."""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from crossweave.llm.shared import pieces

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """the of and to in a is that it for was on are as with his they at be this from have or by one had not but what all were when
    we there can an your which their said if do will each about how up out them then she many some so these would other into has
    more her two like him see time could no make than first been its who now people my made over did down only way find use may
    le la les de des du un une et est en que qui dans pour pas sur au aux avec ce ces il elle ils elles on nous vous je se sa son
    ses par plus ne ou mais comme tout fait leur leurs lui y sont été être avoir cette
    der die das und ist in den von zu mit sich auf für nicht ein eine einer eines einem einen dem des im auch als an es er sie wir
    ihr ich war wird werden sind hat haben aus bei nach wie über oder aber so zum zur man noch nur vor bis durch mehr kann
    el los las y en un una por con para como es del se al lo más pero sus le ya o este sí porque esta entre cuando muy sin sobre
    también me hasta hay donde quien desde todo nos durante todos uno les ni contra otros ese eso había ante ellos esto mí antes""".split()
)

#: Elements by their part in a page.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
NOT_TEXT = frozenset("script style noscript template iframe object svg math canvas audio video textarea select button option datalist head title".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
APART = frozenset("nav footer aside form menu dialog fieldset header".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
#: Words in class, id or role that mark parts beside the article.
APART_WORDS = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promos promotion banner banners cookie cookies
    consent notice notices alert gdpr privacy disclaimer nav navbar navigation menu menus submenu breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets
    related recommended recommendations share sharing social comment comments commentlist disqus replies reply respond footer foot header masthead topbar subscribe
    subscription newsletter signup login modal popup overlay toolbar pagination pager skip skiplink copyright complementary contentinfo search form forms dialog""".split()
)
#: Words with which a part of the article itself may be called a header.
OWN_WORDS = frozenset("article post entry content story main".split())
#: Elements and words of parts that are beside the article even when they hold much of the text.
BESIDE = frozenset("nav footer aside menu dialog".split())
BESIDE_WORDS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: Words that set apart an element inside a line.
INLINE_APART_WORDS = frozenset("ad ads advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promos promotion share sharing social".split())
#: First words of names that tell of the page's state rather than of a part.
STATE_WORDS = frozenset("has with without no not is".split())
_NAME_WORDS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


def set_apart(marks: str, apart_words: frozenset[str] = APART_WORDS) -> bool:
    """Whether a class, id or role names a part beside the article."""
    for name in marks.split():
        words = [w.lower() for w in _NAME_WORDS.findall(name)]
        if not words or words[0] in STATE_WORDS:
            continue
        hits = apart_words.intersection(words)
        if hits and not (hits == {"header"} and OWN_WORDS.intersection(words)):
            return True
    return False


#: Bounds of the first pass: stop-word density, length in characters, link density.
STOP_LOW, STOP_HIGH, LENGTH_LOW, LENGTH_HIGH, LINKS_MOST = 0.15, 0.25, 70, 200, 0.33

_TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^<>]*+>|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)>", re.S)
#: A tag ends before the next < outside quotes, so that each place is looked at once whatever a page leaves open.
_MARKS = re.compile(r"(?i)\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_HIDDEN = re.compile(r"(?i)(?:^|\s)hidden(?:$|[\s=/])")
_NOT_SHOWN = re.compile(r"(?i)\bstyle\s*=\s*(?:\"[^\"]*?display\s*:\s*none|'[^']*?display\s*:\s*none|[^\s\"'>]*?display:none)")
_ARIA_HIDDEN = re.compile(r"(?i)\baria-hidden\s*=\s*[\"']?true")
#: An open line or cell ends with the next one unless one of these is between.
BOUNDS = frozenset(("ul", "ol", "dl", "table", "div", "article", "section", "main", "blockquote"))
#: A part holds most of the page's text where it has so many times the text outside.
MOST = 4


@dataclass(slots=True)
class Block:
    text: str
    linked: int
    heading: bool
    apart: bool
    main: bool

    def weight(self) -> int:
        """Characters outside links; none where links make the block a menu."""
        n = len("".join(self.text.split()))
        return n - self.linked if self.linked <= LINKS_MOST * n else 0


@dataclass(slots=True)
class Part:
    """An element that its name or its class, id or role sets apart, within another one or none (-1)."""

    within: int
    rank: int
    text: int = 0
    article: int = 0
    wraps: bool = False


def rank_of(name: str, marks: str) -> int:
    """How likely a part set apart is a wrapper of the page: 0 likely, 1 perhaps, 2 hardly."""
    words = {w.lower() for w in _NAME_WORDS.findall(marks)}
    if name in BESIDE or BESIDE_WORDS & words:
        return 2
    return 0 if name in ("form", "fieldset") or OWN_WORDS & words else 1


def find_wrappers(parts: list[Part], outside: int) -> None:
    """Marks parts that hold most of the page's text or its article; text in them is not set apart by them.

    outside is the text in no part; parts come with their own text, which is summed over what they hold."""
    own = [p.text for p in parts]
    inside: list[list[int]] = [[] for _ in parts]
    for k in range(len(parts) - 1, -1, -1):
        p = parts[k]
        if p.within >= 0:
            parts[p.within].text += p.text
            parts[p.within].article += p.article
            inside[p.within].append(k)
    shown = [False] * len(parts)  # wrappers that nothing but wrappers is around
    under = [0] * len(parts)  # text that is shown in a part if the part is: that of its wrappers, and of theirs
    known = outside  # text in no part but shown ones

    def beside(k: int) -> int:
        """Text that is in no part but wrappers and those around k."""
        total, at, before = known, parts[k].within, None
        while at >= 0 and not shown[at]:
            total += own[at] + under[at]
            if before is not None and parts[before].wraps:
                total -= own[before] + under[before]
            before, at = at, parts[at].within
        return total

    def wrap(k: int) -> None:
        nonlocal known
        parts[k].wraps = True
        at = k
        while parts[at].wraps and parts[at].within >= 0 and not shown[at]:
            under[parts[at].within] += own[k] + under[k]
            at = parts[at].within
        if parts[k].within < 0 or shown[parts[k].within]:
            todo = [k]
            while todo:
                i = todo.pop()
                shown[i] = True
                known += own[i]
                todo += [c for c in inside[i] if parts[c].wraps]

    for k in sorted(range(len(parts)), key=lambda k: (parts[k].rank, -parts[k].text, k)):
        p = parts[k]
        if p.text and p.rank < 2 and (p.text >= MOST * known or p.article >= max(1, known)):
            rest = beside(k)
            if p.text >= MOST * rest or p.article >= max(1, rest):
                wrap(k)
        elif p.text and p.rank == 2 and not known and not beside(k):
            wrap(k)


def marks_of(attributes: str) -> str:
    return " ".join(a or b or c for a, b, c in _MARKS.findall(attributes)) if attributes else ""


def not_shown(attributes: str) -> bool:
    return bool(_HIDDEN.search(_QUOTED.sub("''", attributes)) or _NOT_SHOWN.search(attributes))


def not_in_line(attributes: str) -> bool:
    """Whether an element inside a line is hidden, or an advert or the like."""
    return not_shown(attributes) or bool(_ARIA_HIDDEN.search(attributes)) or set_apart(marks_of(attributes), INLINE_APART_WORDS)


def blocks_of(page: str) -> list[Block]:
    """The page's text blocks in order, with white space turned into single spaces."""
    found: list[Block] = []
    parts: list[str] = []
    link_at: list[tuple[int, int]] = []
    open_tags: list[tuple[str, bool, bool, bool]] = []  # name, apart, hidden, main
    apart: list[Part] = []
    places: list[tuple[int, bool]] = []  # of each block: its innermost part, whether hidden
    part = article_in = -1  # the innermost open part; the one around the open article
    depth_hidden = depth_main = depth_article = links = linked = 0
    heading = False
    skipped: list[str] = []  # open elements inside a line whose text is left out
    skipped_names: Counter[str] = Counter()
    opened: defaultdict[str, list[int]] = defaultdict(list)  # places of each name among the open elements
    bounds: list[int] = []  # places of those that an open line or cell does not reach beyond
    unclosed: set[str] = set()  # names without an end tag in the rest of the page

    around: list[int] = []  # the parts around open ones

    def close_block() -> None:
        nonlocal linked
        skipped.clear()
        skipped_names.clear()
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                found.append(block := Block(text, linked, heading, depth_hidden > 0, depth_main > 0))
                places.append((part, depth_hidden > 0))
                if not depth_hidden:
                    if part >= 0:
                        apart[part].text += block.weight()
                    if depth_main and article_in >= 0:
                        apart[article_in].article += block.weight()
            parts.clear()
        linked = 0

    def pop(k: int) -> None:
        nonlocal part, depth_hidden, depth_main, depth_article
        for name, was_apart, was_hidden, was_main in open_tags[k:]:
            opened[name].pop()
            if name in BOUNDS:
                bounds.pop()
            depth_article -= name == "article"
            if was_apart:
                part = around.pop()
            depth_hidden -= was_hidden
            depth_main -= was_main
        del open_tags[k:]

    at, end = 0, len(page)
    while at < end:
        tag = _TAG.search(page, at)
        piece = page[at : tag.start()] if tag else page[at:]
        if piece and not skipped:
            parts.append(piece)
            if links:
                linked += len("".join(piece.split()))
        if not tag:
            break
        at = tag.end()
        name = tag[2]
        if not name:
            continue
        name = name.lower()
        if tag[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in INLINE:
                while skipped_names[name]:  # the last one of this name and all in it end
                    ended = skipped.pop()
                    skipped_names[ended] -= 1
                    if ended == name:
                        break
                continue
            close_block()
            if name in HEADINGS:
                heading = False
            if opened[name]:
                pop(opened[name][-1])
            continue
        if name in NOT_TEXT and not (name == "head" or name in VOID):
            if name in RAW or name in ("object", "canvas", "audio", "video", "select", "button", "datalist", "option"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}\s*+>", re.I).search(page, at)
                if close is None:
                    unclosed.add(name)
                at = close.end() if close else (end if name in RAW else at)
                if name not in ("button", "select", "option"):
                    close_block()
            continue
        if name == "a":
            links += 1
        if name == "br":
            parts.append(" ")
        if name in INLINE:
            if name not in VOID and (skipped or tag[3] and not_in_line(tag[3])):
                skipped.append(name)
                skipped_names[name] += 1
            continue
        close_block()
        heading = name in HEADINGS
        if name in VOID or tag[3].endswith("/"):
            continue
        if name in ("p", "li", "td", "th", "tr", "dt", "dd", *HEADINGS):  # an open element of this kind ends here
            if opened[name] and opened[name][-1] > (bounds[-1] if bounds else -1):
                pop(opened[name][-1])
        marks = marks_of(tag[3])
        is_main = name in MAIN
        is_apart = name in APART and not (name == "header" and depth_main > 0)
        if marks and is_main:  # an article in an article, or one that is called a comment, is judged by its name
            is_apart = set_apart(marks, APART_WORDS if depth_article else BESIDE_WORDS)
        elif marks and name not in ("body", "html") and set_apart(marks):
            is_apart = True
        is_hidden = bool(tag[3] and not_shown(tag[3]))
        if tag[3] and _ARIA_HIDDEN.search(tag[3]):
            is_apart = True
        opened[name].append(len(open_tags))
        if name in BOUNDS:
            bounds.append(len(open_tags))
        open_tags.append((name, is_apart, is_hidden, is_main))
        if is_apart:
            apart.append(Part(part, rank_of(name, marks)))
            around.append(part)
            part = len(apart) - 1
        if is_main and not depth_main:
            article_in = part
        depth_hidden += is_hidden
        depth_main += is_main
        depth_article += name == "article"
    close_block()
    if apart:
        find_wrappers(apart, sum(b.weight() for b, (k, hidden) in zip(found, places, strict=True) if k < 0 and not hidden))
        beside: list[bool] = []
        for p in apart:
            beside.append(not p.wraps or (p.within >= 0 and beside[p.within]))
        for block, (k, hidden) in zip(found, places, strict=True):
            block.apart = hidden or (k >= 0 and beside[k])
    return found


def stop_density(text: str) -> float:
    words = text.lower().split()
    return sum(w.strip(".,;:!?()\"'*#$%&") in STOP_WORDS for w in words) / len(words) if words else 0.0


def classify(block: Block) -> str:
    """First pass: good, bad, near (good unless what is around it is bad) or short (undecided: few characters, or
    more with few stop words and no link, as in a language that the list does not have)."""
    if block.apart:
        return "bad"
    length = len(block.text)
    link_density = block.linked / max(1, len("".join(block.text.split())))
    if link_density > LINKS_MOST:
        return "bad"
    if length < LENGTH_LOW:
        return "bad" if link_density > 0 and not block.main else "short"
    density = stop_density(block.text)
    if density >= STOP_HIGH:
        return "good" if length > LENGTH_HIGH else "near"
    if density >= STOP_LOW:
        return "near"
    return "short" if block.main or not link_density else "bad"


def _nearest(labels: list[str], decided: tuple[str, ...], step: int) -> list[str | None]:
    """For each block the label of the nearest decided one on one side (step -1: before it)."""
    out: list[str | None] = [None] * len(labels)
    last = None
    order = range(len(labels)) if step < 0 else range(len(labels) - 1, -1, -1)
    for i in order:
        out[i] = last
        if labels[i] in decided:
            last = labels[i]
    return out


def _inherited(first: list[str], blocks: list[Block], trusted: list[bool]) -> list[str]:
    """Second pass over the blocks of one flow: undecided ones take the label of the nearest decided ones.

    Between a good and a bad one a short block is bad, unless a near one or, for a heading, text
    follows on the bad side; in a trusted place (the page's article) only bad ones on both sides make it bad."""
    labels = list(first)
    back, ahead = (_nearest(first, ("good", "bad"), s) for s in (-1, 1))
    any_back, any_ahead = (_nearest(first, ("good", "near", "bad"), s) for s in (-1, 1))
    for i, label in enumerate(first):
        if label != "short":
            continue
        sides = {back[i], ahead[i]} - {None}
        if trusted[i]:
            good = not (back[i] == ahead[i] == "bad" and "near" not in (any_back[i], any_ahead[i]))
        elif len(sides) == 2:
            good = (any_back[i] == "near" and back[i] == "bad") or (any_ahead[i] == "near" and ahead[i] == "bad") or (blocks[i].heading and any_ahead[i] in ("good", "near"))
        else:
            good = sides == {"good"} or "near" in (any_back[i], any_ahead[i])
        labels[i] = "good" if good else "bad"
    second = list(labels)
    back, ahead = (_nearest(second, ("good", "bad"), s) for s in (-1, 1))
    for i, label in enumerate(second):
        if label == "near":
            labels[i] = "bad" if {back[i], ahead[i]} - {None} == {"bad"} and not trusted[i] else "good"
    return labels


def _largest_run(first: list[str], blocks: list[Block]) -> list[str]:
    """Where nothing is good or near: the run of undecided blocks with most text, if that is more than a few words or a
    heading with a text under it."""
    best, most, k = range(0), 0, 0
    while k < len(first):
        to = k
        while to < len(first) and first[to] == "short":
            to += 1
        weight = sum(b.weight() for b in blocks[k:to])
        under = any(a.heading and not b.heading for a, b in zip(blocks[k:to], blocks[k + 1 : to], strict=False))
        if weight > most and (weight >= LENGTH_LOW or under):
            best, most = range(k, to), weight
        k = max(to, k + 1)
    return ["good" if i in best else "bad" for i in range(len(first))]


def main_text(page: str | None) -> str:
    """Good blocks joined by newlines; the second pass lets undecided blocks inherit from the nearest decided ones.

    Blocks set apart by their element or its name are bad and stand in no one's neighbourhood. Where
    the page marks its article (article or main) and that has most of the text, its undecided blocks
    are trusted, and undecided ones outside it are bad; elsewhere the passes alone decide."""
    if not page:
        return ""
    blocks = [b for b in blocks_of(page) if not b.apart]
    first = [classify(b) for b in blocks]
    inside = sum(b.weight() for b in blocks if b.main)
    prose = sum(b.weight() for b, x in zip(blocks, first, strict=True) if not b.main and x in ("good", "near"))
    trusted = [b.main and inside >= prose for b in blocks]
    if any(trusted):
        first = ["bad" if not t and x in ("near", "short") else x for t, x in zip(trusted, first, strict=True)]
    if any(trusted) or any(x in ("good", "near") for x in first):
        labels = _inherited(first, blocks, trusted)
    else:
        labels = _largest_run(first, blocks)
    for i, block in enumerate(blocks):  # a heading right before good text belongs to it, a linked one before a text that is good by itself
        if block.heading and labels[i] == "bad" and i + 1 < len(blocks) and labels[i + 1] == "good" and (first[i] != "bad" or (block.linked and first[i + 1] != "short")):
            labels[i] = "good"
    return "\n".join(b.text for b, x in zip(blocks, labels, strict=True) if x == "good")


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page, from the whole html.

    Null or empty html, and pages without article text, give the empty text. Each row is judged by
    itself: repeated rows give repeated results, and other columns are not read. Nothing is dropped
    or capped inside a good block. A map without a shuffle; memory is bounded by a piece of pages
    or one very long page."""
    rows = pages.select(page_id, url, page).toDF("page_id", "url", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
