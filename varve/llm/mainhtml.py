"""Main text of web pages: the contiguous region of greatest score.

A page is a sequence of words and tags.  Words score 1; a tag costs more the less its kind is at
home in articles, which is learned from labelled pages: those whose author marked the article
(``<article>`` or ``<main>``).  One linear scan finds the contiguous stretch of greatest sum.
Elements whose learned weight says "not content" (and kinds that hardly are: scripts, styles,
forms, menus ...) make no part of the region's text, but ``html``, ``body``, ``main``, ``article`` and
elements that hold most of what the author marked (most of the page's words, if nothing is marked)
are never taken out.
Elements named as reader comments, adverts, sidebars, notices and the like (all parts of a class, id or role
are such words or words of layout) are taken out in the same way, inside marked content, too.  Comments and
adverts only stay where they hold nine tenths of it; learned weights overrule the other names, but for sidebars,
as what always stands inside ``<article>`` need not be its text.
Names that only hold such a word ("related-work") make an element's tag dear, outside of marked content and
as far as no learned weight of the name says otherwise; its words count as any others.

Blocks are cut at block-level tags; white space inside a block becomes one blank; blocks are
joined by an empty line.

Results: null and empty pages, and pages without words, give the empty text.  Text between the
region's ends is never dropped, whatever its length.  Pages marked by no one teach nothing;
without any marked page the fixed kinds and a neutral cost remain.  A tag the page's end cuts off is
no text.
"""

from __future__ import annotations

import functools
import html
import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varve.llm.common import kept, slices, texts_of

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta source track wbr".split())
INLINE = set(
    "a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr".split()
)
RAW = "script style noscript template svg iframe textarea object".split()
NEVER = set(RAW) | set("head title nav header footer aside form button select option dialog menu".split())
MARKED = ("article", "main")
KEPT = {"html", "body", *MARKED}
CONTROLS = set("head title select option button".split())
# Names of classes, ids and roles that often mark what is not content.
NAMED = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|hidden|menu|"
    r"nav|navbar|navigation|newsletter|notices?|popup|promo\w*|recommend\w*|related|share|sharing|sidebar|social|"
    r"sponsor\w*|subscribe|toolbar|widget)(?:$|[-_ ])",
    re.I,
)

# Parts of the names of elements to be taken out, and parts that say nothing beside them.
COMMENTS = set("comment comments commentary respond replies disqus discussion".split())
ADVERTS = set("ad ads advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored cookie cookies consent gdpr".split())
SIDES = set("sidebar sidebars complementary".split())
OTHERS = set(
    "banner breadcrumb breadcrumbs contentinfo footer header hidden menu menus nav navbar navigation newsletter notice notices popup "
    "promo promos promotion promotions recommend recommended recommendations related search share sharing social subscribe subscription "
    "toolbar widget widgets".split()
)
LAYOUT = set(
    "area bar block body bottom box buttons column container content group holder icons inner item items left links list main modal outer "
    "overlay page panel primary right secondary section signup site slot space thread top unit wrap wrapper".split()
)
STORY = set("article entry post story".split())
PLAIN_NAMES = set("article body content entry main page post story text".split())

# Share of the marked words (the page's, if nothing is marked) that an element to be taken out must hold to stay.
MOST, NEARLY_ALL = 0.5, 0.9

# Log odds of tags no labelled page holds (a cost of about a seventh of a word), and the odds
# of names below which an element is not content.
UNSEEN, NOT_CONTENT = 1.8, -2.0
# Words that begin and end of an element each cost whose name is among those above and that no labelled page holds.
NAME_COST = 20.0

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[A-Za-z][A-Za-z0-9:-]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)


def keys_of(tag: str, attrs: str) -> tuple[tuple[str, ...], bool]:
    """The tag, tag with each of its names, and whether a name marks it as not content."""
    found = [a or b or c for a, b, c in _NAMES.findall(attrs)] if attrs else []
    names = [n for value in found for n in value.lower().split()]
    return (tag, *(f"{tag}.{n}" for n in names)), any(NAMED.search(n) for n in names)


@functools.lru_cache(maxsize=100_000)
def kind_of(name: str) -> str:
    """Which of the fixed lists a class, id or role belongs to: "foreign" (comments, adverts), "side", "other" or ""."""
    parts = {x for x in re.split(r"[-_:]+|\d+", name) if x}
    rest = parts - COMMENTS - ADVERTS - SIDES - OTHERS
    if len(rest) == len(parts) or rest - LAYOUT - (set() if "header" in parts else STORY):
        return ""
    return "foreign" if parts & (COMMENTS | ADVERTS) else "side" if parts & SIDES else "other"


def taken_out(keys: tuple[str, ...], weights: dict[str, float]) -> float:
    """Share of the content that the element must hold to stay; 0 if it stays anyway."""
    share = MOST if _never(keys) or any(weights.get(k, 0.0) < NOT_CONTENT for k in keys[1:]) else 0.0
    names = [k[len(keys[0]) + 1 :] for k in keys[1:]]
    if not any(n in PLAIN_NAMES for n in names):
        for key, name in zip(keys[1:], names):
            kind = kind_of(name)
            # In program text a span of class "comment" is the text's own.
            if kind == "foreign" and not (keys[0] in INLINE and COMMENTS & set(re.split(r"[-_]", name))):
                share = NEARLY_ALL
            elif kind == "side" or (kind == "other" and weights.get(key, 0.0) <= 0):
                share = max(share, MOST)
    return share


class Open(NamedTuple):
    """An open element; all but tag and keys also hold for what stands in it.

    ``hidden`` is the number of the innermost element to be taken out (0: none), ``marked`` whether
    it is marked content, ``link`` whether it is a link.
    """

    tag: str
    keys: tuple[str, ...]
    hidden: int
    marked: bool
    link: bool = False
    named: bool = False


_PAGE = Open("", (), 0, False)


class Hidden:
    """Elements to be taken out, unless they hold so much of what the author marked (or of the page, if nothing is marked)."""

    def __init__(self) -> None:
        # By number: the element around, words outside links, marked words, whether a control, share to stay.
        self.parent, self.words, self.inner, self.control, self.share = [0], [0], [0], [False], [0.0]

    def add(self, tag: str, parent: int, share: float) -> int:
        self.parent.append(parent)
        self.share.append(share)
        self.words.append(0)
        self.inner.append(0)
        self.control.append(tag in CONTROLS or self.control[parent])
        return len(self.parent) - 1

    def count(self, top: Open, n: int) -> None:
        if self.control[top.hidden]:
            return
        if not top.link:
            self.words[top.hidden] += n
        if top.marked:
            self.inner[top.hidden] += n

    def shown(self) -> list[bool]:
        """By number, whether what stands directly in the element stays."""
        words, inner = list(self.words), list(self.inner)
        for c in range(len(words) - 1, 0, -1):
            words[self.parent[c]] += words[c]
            inner[self.parent[c]] += inner[c]
        out = [True]
        for c in range(1, len(words)):
            most = inner[c] > self.share[c] * inner[0] or (not inner[0] and words[c] > self.share[c] * words[0])
            out.append(most and not self.control[c] and out[self.parent[c]])
        return out


def tokens(page: str, hides: Callable[[tuple[str, ...]], float], hidden: Hidden) -> Iterator[tuple[str, tuple[str, ...], str, list[Open]]]:
    """(kind, keys, text, open elements) of a page; kind is "text", "open", "close";
    begin and end of an element with a name of NAMED are "open named" and "close named".

    The last is the live stack, the page itself first; unclosed elements end with their parents.
    """
    stack, count = [_PAGE], Counter()
    for m in _TOKEN.finditer(page):
        text = m["text"]
        if text is not None:
            yield "text", (), text, stack
            continue
        tag = (m["tag"] or m["raw"] or "").lower()
        if not tag:
            continue
        if m["raw"]:
            yield "open", (tag,), "", stack
        elif m["close"]:
            if not count[tag]:
                continue
            while stack[-1].tag != tag:
                count[stack.pop().tag] -= 1
            yield "close named" if stack[-1].named else "close", stack[-1].keys, "", stack
            count[stack.pop().tag] -= 1
        else:
            keys, named = keys_of(tag, m["attrs"])
            if tag not in INLINE and stack[-1].tag == "p":
                count[stack.pop().tag] -= 1
            yield "open named" if named else "open", keys, "", stack
            if tag not in VOID and not m["attrs"].endswith("/"):
                above = stack[-1]
                share = 0.0 if tag in KEPT else hides(keys)
                number = hidden.add(tag, above.hidden, share) if share else above.hidden
                stack.append(Open(tag, keys, number, above.marked or tag in MARKED, above.link or tag == "a", named))
                count[tag] += 1


def _never(keys: tuple[str, ...]) -> float:
    return MOST if keys[0] in NEVER else 0.0


def _counts(page: str) -> Counter:
    """Words by (name of an element around them, whether in marked content), and tags."""
    seen: Counter = Counter()
    lowered = page.lower()
    if not any(f"<{m}" in lowered for m in MARKED):
        return seen
    hidden, tags = Hidden(), Counter()
    for kind, keys, text, stack in tokens(page, _never, hidden):
        top = stack[-1]
        if kind == "text":
            if n := len(text.split()):
                hidden.count(top, n)
                for key in {k for element in stack for k in element.keys[1:]}:
                    seen[key, top.marked] += n
        elif kind.startswith("open") and keys[0] not in MARKED:
            for key in keys:
                tags[f"<{key}>", top.marked, top.hidden] += 1
    # What is taken out anyway must not make the tags in it look dear elsewhere.
    shown = hidden.shown()
    for (key, marked, number), n in tags.items():
        if shown[number]:
            seen[key, marked] += n
    return seen


def learn(pages: DataFrame, sample: int = 4_000) -> dict[str, float]:
    """Log odds, by element key, of standing in marked content; tags as ``<key>``.

    From at most ``sample`` pages, those of smallest hash of their page_id; pages longer than a
    million characters teach nothing.
    """
    chosen = pages.select("page_id").where("page_id IS NOT NULL").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for page in texts_of(batch, "html"):
                seen.update(_counts(page))
        rows = [(key, inside, n) for (key, inside), n in seen.items()]
        yield pa.RecordBatch.from_pylist(
            [{"key": k, "inside": i, "n": n} for k, i, n in rows],
            schema=pa.schema([("key", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())]),
        )

    counted = (
        pages.select("page_id", "html")
        .where(F.length("html").between(1, 1_000_000))
        .join(F.broadcast(chosen), "page_id")
        .select("html")
        .mapInArrow(run, "key string, inside boolean, n bigint")
        .groupBy("key")
        .agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("in"), F.sum(F.when(~F.col("inside"), F.col("n")).otherwise(0)).alias("out"))
    ).collect()  # one row an element key of the sample
    return {r["key"]: math.log((r["in"] + 1) / (r["out"] + 1)) for r in counted}


def _against(odds: float) -> float:
    """Probability of not being content."""
    return 1 / (1 + math.exp(min(30.0, max(-30.0, odds))))


def extract_one(page: str, weights: dict[str, float]) -> str:
    """The main text of one page."""
    scores: list[float] = []
    events: list[str | None] = []  # text, or None for a block border
    numbers: list[int] = []
    hidden = Hidden()

    def hides(keys: tuple[str, ...]) -> float:
        return taken_out(keys, weights)

    for kind, keys, text, stack in tokens(page, hides, hidden):
        top = stack[-1]
        numbers.append(top.hidden)
        if kind == "text":
            words = len(text.split())
            if words:
                hidden.count(top, words)
            scores.append(float(words))
            events.append(text)
        else:
            odds = max((weights.get(f"<{k}>", UNSEEN) for k in keys), key=abs)
            scores.append(-_against(odds) - 0.01)
            if kind.endswith("named") and not top.marked and keys[0] not in KEPT and keys[0] not in INLINE and not hides(keys):
                known = [weights[k] for k in keys[1:] if k in weights]
                scores[-1] -= NAME_COST * (_against(max(known, key=abs)) if known else 1.0)
            events.append(None if keys[0] not in INLINE else " " if keys[0] == "br" else "")
    if len(hidden.parent) > 1:
        shown = hidden.shown()
        stay = [i for i, number in enumerate(numbers) if shown[number]]
        scores, events = [scores[i] for i in stay], [events[i] for i in stay]
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, score in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += score
        if total > best:
            best, begin, end = total, start, i + 1
    blocks: list[str] = []
    current: list[str] = []
    for event in [*events[begin:end], None]:
        if event is None:
            block = " ".join("".join(current).split())
            if block:
                blocks.append(block)
            current = []
        else:
            current.append(html.unescape(event) if event.strip() else event)
    return "\n\n".join(blocks)


def extract(pages: DataFrame, weights: dict[str, float], source: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of ``source``."""
    pages = pages.drop(out)
    schema = T.StructType([*pages.schema.fields, T.StructField(out, T.StringType())])
    sent = json.dumps(weights, sort_keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("html", sent), lambda: json.loads(sent))
        for batch in batches:
            for part in slices(batch, source):
                made = pa.array([extract_one(p, known) for p in texts_of(part, source)], type=pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, made], [*part.schema.names, out])

    return pages.mapInArrow(run, schema)


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    found = extract(pages.select("page_id", "url", "html"), learn(pages))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
