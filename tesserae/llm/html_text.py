"""Main text of web pages: the contiguous region whose tokens score highest, words positive and tags negative.

A page is a sequence of text runs and tags. A tag costs something; a word earns something where it stands as plain text
and costs something inside links, menus, adverts and the like. One pass finds the contiguous stretch with the largest
sum. The weights are learned from labelled pages: those that mark their main text with an <article> or <main> element.
What stands in a menu, header, footer, sidebar, notice, advert, form or comment section inside the region is left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import table

#: Labelled pages that weights are learned from, about.
SAMPLE = 2000
#: Elements that are passed over whole, up to their closing tag or the end of the page.
SKIPPED = set("script style noscript template svg math iframe object textarea select title".split())
_CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I | re.A) for name in SKIPPED}
_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*")
#: Most tags: names and well-quoted values. What isn't like that is read piece by piece.
_PLAIN = re.compile(r"(/?[a-zA-Z][^\s/>]*+)((?:\s++[a-zA-Z-]++(?:=\"[^\"<>]*+\")?+)*+\s*+)>")
_TO_VALUE = re.compile(r"[^>=]*")
_VALUE = re.compile(r"=\s*")
_UNQUOTED = re.compile(r"[^\s>]*")
_ATTR = re.compile(r"""(?<![^\s"'])(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Elements inside a line of text; all others end a block. (Fixed values of HTML.)
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements, roles and words of class or id that make what they hold no part of the article. (Fixed values, as all lists below.)
OUT_TAGS = set("nav header footer aside form head button menu dialog audio video canvas map fieldset".split())
OUT_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
OUT_WORDS = set(
    "ad ads adv advert adverts advertisement advertising adsbygoogle sponsor sponsored sponsors promo promotion banner cookie cookies consent gdpr notice notices alert"
    " newsletter subscribe subscription signup popup modal overlay nav navigation navbar menu menus breadcrumb breadcrumbs header masthead footer sidebar aside related recommended"
    " widget widgets share sharing social comment comments commentlist disqus reply replies respond form login search toolbar pagination pager complementary contentinfo".split()
)
#: Of them, those that only markup uses, so that they count at either end of a name whatever else stands in it.
MARKUP_WORDS = set("ad ads adv advert adverts advertisement adsbygoogle cookie cookies gdpr newsletter popup modal nav navbar breadcrumb breadcrumbs masthead footer sidebar commentlist disqus pager".split())
#: What else a name may hold: where something stands and what it is made of.
COMPANIONS = set(
    "site page blog post entry global top bottom left right first second primary secondary sub mini mobile desktop sticky fixed floating inline user users reader readers visitor"
    " list lists item items box boxes bar block blocks section area region wrap wrapper container inner outer holder panel group row col column columns slot unit zone card button buttons btn"
    " icon icons link links posts articles stories story products title heading label text body content main article thread count meta author image logo message messages policy sign up letter field input".split()
)
#: Names that hold one of these say how a page is laid out or what it has, not what an element is.
STATES = set("no non not without has have with is enabled disabled free layout template off on open opened closed active hide show visible loaded".split())
#: These hold the article whatever they are called; an element that isn't one of them, if it holds all of them, isn't left out.
NEVER_OUT = set("html body article main".split())
#: Elements that a new one of the group ends.
ENDS = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
DEFAULT = {"w:plain": 1.0, "w:link": -0.5, "w:out": -0.5, "t": -0.3}
#: The most that an inset (an advert, a form) may cost in all, so that it doesn't split an article; and a tag.
MOST_COST, TAG_COST, LEAST_COST = 6.0, 1.5, 0.05


class _Finder:
    """page.find() that remembers what doesn't come any more, so that a page of openings without an end is read once."""

    def __init__(self, page: str):
        self.page, self.missing = page, set()

    def find(self, what: str, at: int) -> int:
        if what in self.missing:
            return -1
        found = self.page.find(what, at)
        if found < 0:
            self.missing.add(what)
        return found

    def find_closing(self, name: str, at: int) -> int:
        """Where </name stands, in any case of letters, ended by white space, a slash or >."""
        if name in self.missing:
            return -1
        m = _CLOSING[name].search(self.page, at)
        if m is None:
            self.missing.add(name)
            return -1
        return m.start()


def markup(page: str):
    """Yield (start, end, name, closing, attributes) of tags, and of comments and the like with an empty name.

    A quote has a meaning only where an attribute's value begins; elsewhere it is a letter like any other. A quote, comment
    or element passed over that never ends: the quote is a letter, the others reach to the end of the page.
    """
    finder, at, n = _Finder(page), 0, len(page)

    def past(what: str, start: int) -> int:
        found = finder.find(what, start)
        return n if found < 0 else found + len(what)

    while True:
        start = page.find("<", at)
        if start < 0:
            return
        m = _PLAIN.match(page, start + 1)
        plain = m is not None
        if not plain:
            m = _NAME.match(page, start + 1)
        if m is None:
            at = start + 1
            if page.startswith("<!--", start):
                at = start + 5 if page.startswith("<!-->", start) else past("-->", start + 4)
            elif page.startswith("<![CDATA[", start):
                at = past("]]>", start + 9)
            elif page[at : at + 1] in ("!", "?", "/") and at < n:
                at = past(">", start + 2)
            else:
                continue  # a lone < is text
            yield start, at, "", False, ""
            continue
        name = m[1].lower() if plain else m[0].lower()
        inside = m.end(1) if plain else m.end()
        at = m.end() - 1 if plain else inside
        while not plain:
            at = _TO_VALUE.match(page, at).end()
            if at >= n or page[at] == ">":
                break
            at = _VALUE.match(page, at).end()
            quote = page[at : at + 1]
            end = finder.find(quote, at + 1) if quote in ("'", '"') and quote else -1
            at = end + 1 if end >= 0 else _UNQUOTED.match(page, at).end()
        attributes, at = page[inside:at], min(n, at + 1)
        closing = name[0] == "/"
        name = name.lstrip("/")
        if name in SKIPPED and not closing:
            end = finder.find_closing(name, at)
            at = n if end < 0 else past(">", end)
            yield start, at, name, False, ""
            continue
        yield start, at, name, closing, attributes


@lru_cache(1 << 14)
def _named_out(name: str) -> bool:
    """Whether a class or an id names a part that is left out: one of OUT_WORDS, alone or with words that only place it."""
    parts = [x.lower() for x in _PART.findall(name)]
    if not parts or OUT_WORDS.isdisjoint(parts) or not STATES.isdisjoint(parts):
        return False
    if len(parts) > 1 and parts[-1] in ("main", "article"):
        return False
    if parts[-1] in MARKUP_WORDS or parts[0] in MARKUP_WORDS:
        return True
    # content-header is a header, content-sidebar-wrap isn't a sidebar
    if parts[0] in ("main", "article", "content") and parts[-1] not in OUT_WORDS:
        return False
    return all(x in OUT_WORDS or x in COMPANIONS for x in parts)


def _called_out(name: str, attrs: str, in_code: bool) -> bool:
    """Whether an element's class, id or role says that it is no part of the article; ids of headings name what follows."""
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'")
        if key == "role" and value.strip().lower() in OUT_ROLES:
            return True
        if (key == "class" and not in_code or key == "id" and name not in HEADINGS) and any(map(_named_out, value.split())):
            return True
    return False


def _hidden(attrs: str) -> bool:
    for key, value in _ATTR.findall(attrs) if "hidden" in attrs.lower() or "style" in attrs.lower() else ():
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _UNSEEN.search(value):
            return True
    return False


def parse(page: str) -> list[tuple[str, str, str, int]]:
    """(kind, name, text, inside) of the page: kind "t" for tags, "w" for text runs; name is the tag's, or plain, link or out.

    A tag's text is "out" where it belongs to something that is left out. inside: 2 where an <article> is open, 1 where
    only a <main> is, else 0. Stray closing tags count as tags; what is cut off ends open. What a class, id or role
    names is left out unless it holds every <article> and <main> of the page, and so is a <form>.
    """
    stack: list[tuple[str, int]] = []
    # places in the stack: of each name, and of what isn't inline; so that no tag has to look through the stack
    places: dict[str, list[int]] = {}
    blocks: list[int] = []
    # what may be left out: the one around it, whether it is left out if it holds the article, and the marks it holds
    around, sure, marks = [-1], [False], [0]
    current = links = main = article = at = 0
    tokens: list[tuple[str, str, str, int, int]] = []

    def close(k: int) -> None:
        nonlocal current, links, main, article
        while len(stack) > k:
            name, before = stack.pop()
            places[name].pop()
            if name not in INLINE:
                blocks.pop()
            while current != before:
                marks[around[current]] += marks[current]
                current = around[current]
            links -= name == "a"
            main -= name == "main"
            article -= name == "article"

    for start, end, name, closing, attributes in markup(page):
        inside = 2 if article else 1 if main else 0
        if start > at:
            tokens.append(("w", "link" if links else "plain", page[at:start], inside, current))
        at = end
        if not name:
            continue
        if name in SKIPPED:
            tokens.append(("t", name, "", inside, current))
            continue
        if closing:
            tokens.append(("t", name, "", inside, current))
            if places.get(name) and (name not in INLINE or not blocks or blocks[-1] < places[name][-1]):
                close(places[name][-1])
            continue
        if name not in INLINE and stack:
            # a block ends open inline elements (an unclosed <b> says nothing about what follows) and some like it
            while stack and (stack[-1][0] in INLINE or stack[-1][0] in ENDS.get(name, ())) and not (stack[-1][0] == "a"):
                close(len(stack) - 1)
        if name not in VOID and not attributes.rstrip().endswith("/"):
            before = current
            called = "=" in attributes and _called_out(name, attributes, bool(places.get("pre") or places.get("code")))
            hidden = bool(attributes) and name not in NEVER_OUT and _hidden(attributes)
            if name in ("article", "main"):
                marks[current] += not called
            elif name not in NEVER_OUT and (called or hidden or name in OUT_TAGS):
                around.append(current)
                sure.append(hidden or name in OUT_TAGS and name != "form")
                marks.append(0)
                current = len(around) - 1
            places.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                blocks.append(len(stack))
            stack.append((name, before))
            links += name == "a"
            main += name == "main"
            article += name == "article"
        tokens.append(("t", name, "", 2 if article else 1 if main else 0, current))
    if at < len(page):
        tokens.append(("w", "link" if links else "plain", page[at:], 2 if article else 1 if main else 0, current))
    close(0)
    out = [False]
    for k in range(1, len(around)):
        out.append(out[around[k]] or sure[k] or marks[k] == 0 or marks[k] < marks[0])
    return [(kind, "out" if out[k] and kind == "w" else name, "out" if out[k] and kind == "t" else text, inside) for kind, name, text, inside, k in tokens]


def count_types(page: str) -> Counter:
    """(type, inside) counts over a page that marks its article; nothing for others."""
    counts: Counter = Counter()
    for kind, name, text, inside in parse(page):
        counts[("w:" + name if kind == "w" else "t:" + name, inside > 0)] += len(text.split()) if kind == "w" else 1
    return counts if any(inside for _, inside in counts) else Counter()


def weights_from(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds of standing inside against outside, kept positive for plain words and negative for tags."""
    if not counts:
        return dict(DEFAULT)
    total = {b: sum(n for (_, inside), n in counts.items() if inside == b) + 10 for b in (True, False)}
    out = dict(DEFAULT)
    for kind in {k for k, _ in counts}:
        odds = math.log((counts.get((kind, True), 0) + 0.5) / total[True]) - math.log((counts.get((kind, False), 0) + 0.5) / total[False])
        if kind == "w:plain":
            out[kind] = min(2.0, max(0.6, odds))
        elif kind[0] == "w":
            out[kind] = min(-0.05, max(-1.0, odds))
        else:
            out[kind] = -LEAST_COST if odds > 0 else max(-TAG_COST, odds - 0.05)
    return out


def values(tokens: list, weights: dict[str, float]) -> list[float]:
    """What each token is worth: words what they are many of, tags what their kind costs; an inset at most MOST_COST in all.

    Inside an <article> a link's words are words like any other, and no tag costs more than those that articles are made of.
    """
    out, spent = [], 0.0
    for kind, name, text, inside in tokens:
        if kind == "w":
            value = len(text.split()) * weights["w:plain" if name == "link" and inside == 2 else "w:" + name]
        else:
            value = weights.get("t:" + name, weights["t"])
            value = max(value, -LEAST_COST) if inside == 2 else value
        if (name if kind == "w" else text) == "out":
            # what is left out of a marked article anyway must not part it from its ends
            value = 0.0 if inside else max(value, spent - MOST_COST)
            spent -= value
        else:
            spent = 0.0
        out.append(value)
    return out


def best_region(worth: list[float]) -> tuple[int, int]:
    """The contiguous stretch with the largest sum, the first of equal ones; empty if none is above 0."""
    best = total = 0.0
    start, region = 0, (0, 0)
    for i, value in enumerate(worth):
        if total <= 0:
            total, start = 0.0, i
        total += value
        if total > best:
            best, region = total, (start, i + 1)
    return region


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the best region, each with single spaces, joined by a space. No words that earn: empty."""
    tokens = parse(page or "")
    region = best_region(values(tokens, weights))
    blocks, line = [], []
    for kind, name, text, _ in tokens[region[0] : region[1]]:
        if kind == "w":
            if name != "out":
                line.append(text)
        elif name not in INLINE or name == "wbr":
            if line and name != "wbr":
                blocks.append("".join(line))
                line = []
    blocks.append("".join(line))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def learn(df: DataFrame, page: str = "html", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from a sample of the pages that mark their article, `sample` of them, about; the default weights if none does.

    Null and empty pages mark nothing. Equal pages are in the sample together or not at all.
    """
    marked = df.where(F.col(page).rlike("(?i)<(article|main)[\\s>]"))
    n = marked.count()
    some = marked.where(F.pmod(F.xxhash64(page), F.lit(max(n, 1))) < sample).select(page)

    def run(batches):
        counts: Counter = Counter()
        for batch in batches:
            for x in batch.column(0):
                counts.update(count_types(x.as_py() or ""))
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({"kind": pa.array([k for k, _ in keys], pa.string()), "inside": pa.array([b for _, b in keys], pa.bool_()), "n": pa.array([counts[k] for k in keys], pa.int64())})

    sums = some.mapInArrow(run, "kind string, inside boolean, n bigint").groupBy("kind", "inside").agg(F.sum("n").alias("n"))
    # of a bounded sample: a row for each kind of tag in it; rare ones keep the default
    rows = sums.where("n >= 5").orderBy("kind", "inside").collect()
    return weights_from({(r.kind, r.inside): r.n for r in rows})


def extract(df: DataFrame, page: str = "html", out: str = "main_text", weights: dict[str, float] | None = None) -> DataFrame:
    """Replace the column `page` by `out`, the main text; all rows and other columns stay.

    Null, empty and wordless pages give an empty text. Pages are independent of each other, so repeated ones give the
    same; of regions that score alike the first is taken. A column of `df` named like `out` is replaced. The work is in
    proportion to a page's length, however broken its markup. No rows: no rows.
    """
    weights = learn(df, page) if weights is None else weights
    rest = [c for c in df.columns if c not in (page, out)]

    def run(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column(batch.schema.get_field_index(page))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest), pa.array(texts, pa.string())], names=[*rest, out])

    return df.mapInArrow(run, T.StructType([*(df.schema[c] for c in rest), T.StructField(out, T.StringType())]))


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("bigint").alias("n_chars"))
