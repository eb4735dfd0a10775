"""Main text of HTML pages by the maximum-scoring contiguous subsequence.

A page is a sequence of words and tags.  Words score positive or negative by where they stand, tags
negative; the weights are learned from labelled pages, those that mark their main text with one
``article`` element.  One linear scan finds the contiguous region of the largest sum.

*Word weights.*  A word's features are the names of the elements around it and the words of their
classes, ids and roles.  Its weight is the log-odds of standing inside the main text: a logistic model
over these features, fitted to the labelled pages (each counts the same), with a normal prior around
``PRIOR``, which says what a name tells before any page.  The label's own element (``article``) is not
learned.  Features that the others explain stay near their prior, so the items of a menu don't count
against lists in the text.  The classes of an element around an ``article`` or ``main`` element tell nothing.

*Tag weights.*  A tag costs more the more often it stands outside the main text than inside, by smoothed
log-odds of its rate.

*Region.*  The scan adds words and tags in page order.  The region that it finds is widened to whole
blocks; in it, a block whose own words sum up to nothing or less is not main text (an advert, reader
comments), and what no element may show (scripts, styles, forms' fields) is no text at all.  Block elements end
a block; inside a block white space becomes one space; blocks join by one newline; character references
are decoded.

The weights come from at most ``max_train`` labelled pages (smallest hashes of their urls); without
any, the prior holds.  Pages are read in time linear in their length.

Defined cases: null or empty html, or a page without words, gives the empty text; unclosed and
crossing tags end with the element around them; a quote that never ends is an ordinary character; of equal
regions the first and longest counts; repeated rows are extracted alike; extra columns are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_TRAIN = 2_000
#: Labelled pages of more characters, or nested deeper, are not used for the fit.
MAX_PAGE = 200_000
MAX_DEPTH = 200
#: What one word can add and take at most (an advert in the text must not cut it), and what it adds
#: without any feature.
MOST, LEAST = 3.0, -0.5
START = 0.1
#: Spread of the weights around their prior, and the words that a labelled page's two sides count as, each.
SPREAD = 1.5
PAGE_WORDS = 10.0
#: Tags take this much at least and at most, and as much if no labelled page has them.
TAG_COSTS = (0.05, 2.0)
OTHER_TAG = 0.5

NAME = re.compile(r"/?[a-zA-Z][a-zA-Z0-9:-]*")
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=\"'][^\s/>=]*)?\s*(=)?\s*")
VALUE = re.compile(r"[^\s>]*")
WORDS = re.compile(r"[a-z]+")
#: Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup "
    "hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
RAW = frozenset("script style textarea title xmp".split())
UNSHOWN = frozenset("head template noscript svg math iframe object select audio video canvas datalist button label".split())
#: Blocks that a start tag closes if they are the nearest block around it.
CLOSES = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that say nothing by their name.
PLAIN = frozenset("html body div span section center font article main b i em strong u small sub sup mark time abbr".split())

#: What names tell before any page is seen, as log-odds.
PRIOR = {
    **dict.fromkeys("<article> <main> role=main role=article".split(), 2.0),
    **dict.fromkeys("article articlebody post entry story content main text body".split(), 1.0),
    **dict.fromkeys("<p> <h1> <h2> <h3> <blockquote> <pre>".split(), 1.0),
    **dict.fromkeys("<a>".split(), -1.5),
    **dict.fromkeys("<nav> <footer> <aside> <form> <menu> <dialog> <fieldset>".split(), -12.0),
    **dict.fromkeys("<header>".split(), -3.0),
    **dict.fromkeys(
        "role=navigation role=banner role=contentinfo role=complementary role=search role=form role=menu role=menubar role=toolbar role=dialog role=alert role=alertdialog role=status "
        "role=tablist hidden".split(),
        -12.0,
    ),
    **dict.fromkeys(
        "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert newsletter subscribe subscription signup login "
        "share sharing social related recommended recommendations sidebar menu nav navbar navigation breadcrumb breadcrumbs comment comments disqus replies reply respond footer masthead popup "
        "modal overlay pagination pager toolbar widget toc copyright disclaimer paywall".split(),
        -12.0,
    ),
    **dict.fromkeys("header".split(), -3.0),
}
#: First words of a class that tells of a part elsewhere (has-sidebar).
ELSEWHERE = frozenset("has have with without no is not".split())


_NOTHING: frozenset[str] = frozenset()


@dataclass
class Weights:
    """What a word adds for each feature around it, and what each tag adds."""

    features: dict[str, float] = field(default_factory=lambda: dict(PRIOR))
    start: float = START
    tags: dict[str, float] = field(default_factory=dict)
    other_tag: float = -OTHER_TAG

    def tag(self, name: str) -> float:
        return self.tags.get(name, self.other_tag)

    def of(self, features: frozenset[str]) -> float:
        return max(LEAST, min(MOST, self.start + sum(self.features.get(f, 0.0) for f in features)))


@dataclass(slots=True, eq=False)
class Node:
    name: str
    up: Node | None
    unshown: bool
    inside: bool  # in the article element
    block: int  # index in the stack of the nearest block element, itself included
    depth: int
    named: frozenset[str]  # what its name and role tell
    classed: frozenset[str]  # what its classes and id tell
    holds: bool = False  # an article or main element
    features: frozenset[str] | None = None
    weight: float | None = None

    def all_features(self, known=None) -> frozenset[str]:
        """Its own and its ancestors' features, those in ``known`` if given; to be asked for when the
        page has been read."""
        path, x = [], self
        while x is not None and x.features is None:
            path.append(x)
            x = x.up
        for y in reversed(path):
            above = y.up.features if y.up is not None else _NOTHING
            own = y.named if y.holds or not y.classed else y.named | y.classed
            if known is not None:
                own = frozenset(f for f in own if f in known)
            y.features = above if own <= above else above | own
        return self.features


def _tag(source: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """(attributes that matter, end) of a tag whose name ends at ``at``.

    ``last``: place of each kind of quote's last occurrence, so that a quote that never ends is found at once.
    """
    found: dict[str, str] = {}
    n = len(source)
    while at < n and source[at] != ">":
        m = ATTRIBUTE.match(source, at)
        key, value, at = m.group(1), "", m.end()
        if m.group(2):
            if at < n and source[at] in "\"'" and last[source[at]] > at:
                end = source.index(source[at], at + 1)
                value, at = source[at + 1 : end], end + 1
            else:
                value = VALUE.match(source, at).group()
                at += len(value)
        elif at < n and source[at] in "\"'":
            at += 1
        if key and (key := key.lower()) in ("class", "id", "role", "hidden", "aria-hidden", "itemprop") and key not in found:
            found[key] = value
    return found, min(n, at + 1)


def _own(name: str, attributes: dict[str, str]) -> tuple[frozenset[str], frozenset[str]]:
    """What an element's name and role, and what its classes and id tell."""
    named, classed = set() if name in PLAIN and f"<{name}>" not in PRIOR else {f"<{name}>"}, set()
    if not attributes:
        return frozenset(named), _NOTHING
    for key in ("class", "id", "itemprop"):
        for token in attributes.get(key, "").lower().split():
            words = WORDS.findall(token)
            if words and words[0] not in ELSEWHERE:
                classed.update(words)
    if role := attributes.get("role", "").strip().lower():
        named.add(f"role={role}")
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true":
        named.add("hidden")
    return frozenset(named), frozenset(classed)


def tokens(source: str) -> Iterator[tuple[str, str, Node]]:
    """(kind, value, element around) in page order.

    kind: ``tag`` (start tag's name), ``text`` (decoded) or ``block`` (a block's edge).
    """
    stack = [Node("", None, False, False, -1, 0, _NOTHING, _NOTHING)]
    open_names: Counter[str] = Counter()
    last = {q: source.rfind(q) for q in "\"'"}
    at, n = 0, len(source)

    def pop(to: int) -> None:
        for x in stack[to:]:
            open_names[x.name] -= 1
        del stack[to:]

    def text(piece: str) -> Iterator[tuple[str, str, Node]]:
        if piece:
            yield "text", html.unescape(piece), stack[-1]

    while at < n:
        lt = source.find("<", at)
        if lt < 0:
            yield from text(source[at:])
            return
        if lt > at:
            yield from text(source[at:lt])
        at = lt
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            at = n if end < 0 else end + 3
            continue
        if source.startswith("<![CDATA[", at):
            end = source.find("]]>", at)
            yield "text", source[at + 9 : n if end < 0 else end], stack[-1]
            at = n if end < 0 else end + 3
            continue
        if source[at + 1 : at + 2] in ("!", "?"):
            end = source.find(">", at)
            at = n if end < 0 else end + 1
            continue
        m = NAME.match(source, at + 1)
        if not m:
            yield "text", "<", stack[-1]
            at += 1
            continue
        name = m.group().lower()
        attributes, at = _tag(source, m.end(), last)
        if name[0] == "/":
            name = name[1:]
            if name in BLOCK:
                yield "block", name, stack[-1]
            if open_names[name]:
                i = len(stack) - 1
                while stack[i].name != name:
                    i -= 1
                pop(i)
            continue
        nearest = stack[-1].block
        if nearest > 0 and stack[nearest].name in CLOSES.get(name, ()):
            pop(nearest)
        elif name in BLOCK and nearest > 0 and stack[nearest].name == "p" and name not in ("p",):
            pop(nearest)
        up = stack[-1]
        node = Node(name, up, up.unshown or name in UNSHOWN, up.inside or name == "article", len(stack) if name in BLOCK else up.block, len(stack), *_own(name, attributes))
        if name in ("article", "main"):
            x = up
            while x is not None and not x.holds:
                x.holds, x = True, x.up
        if name in BLOCK:
            yield "block", name, node
        yield "tag", name, node
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(source, at)
            at = n if close is None else close.end()
        elif name not in VOID and source[at - 2] != "/":
            stack.append(node)
            open_names[name] += 1


def extract(source: str | None, weights: Weights) -> str:
    """The main text of a page."""
    if not source:
        return ""
    texts: list[str | None] = []  # None: an edge of a block
    words: list[float] = []  # what each text's words add
    sums: list[float] = []  # the same with the tags before it
    tags = 0.0
    for kind, value, node in list(tokens(source)):
        if kind == "tag":
            tags += 0.0 if node.unshown else weights.tag(value)
            if value != "br":
                continue
            value = " "
        elif kind == "text" and node.unshown:
            continue
        own = 0.0
        if kind == "text":
            if node.weight is None:
                node.weight = weights.of(node.all_features(weights.features))
            own = node.weight * len(value.split())
        texts.append(None if kind == "block" else value)
        words.append(own)
        sums.append(own + tags)
        tags = 0.0
    first, past = best_region(sums)
    if first == past:
        return ""
    while first > 0 and texts[first - 1] is not None:
        first -= 1
    while past < len(texts) and texts[past] is not None:
        past += 1
    blocks, current, total = [], [], 0.0
    for text, own in zip([*texts[first:past], None], [*words[first:past], 0.0], strict=True):
        if text is not None:
            current.append(text)
            total += own
            continue
        if total > 0 and (block := " ".join("".join(current).split())):
            blocks.append(block)
        current, total = [], 0.0
    return "\n".join(blocks)


def best_region(sums: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous part with the largest positive sum; the first, the longest if tied."""
    best, at = 0.0, (0, 0)
    total, start = 0.0, 0
    for i, s in enumerate(sums):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best or (total == best and at[0] == start and best > 0):
            best, at = total, (start, i + 1)
    return at


def _counts(batches):
    """Pages to (feature set or tag, inside, words or tags) of labelled pages, each side of a page counting ``PAGE_WORDS``."""
    prior = Weights()
    for batch in batches:
        counts: Counter = Counter()
        for page in batch.column("html").to_pylist():
            of_page: Counter = Counter()
            total = [0, 0]
            read = list(tokens(page or ""))
            if max((node.depth for *_, node in read), default=0) > MAX_DEPTH:
                continue
            for kind, value, node in read:
                if kind == "block" or node.unshown:
                    continue
                n = 1 if kind == "tag" else len(value.split())
                features = node.all_features()
                # an advert in the article element is not main text, whatever the label says
                if not n or node.inside and prior.of(features) < 0 or kind == "tag" and value in ("article", "main"):
                    continue
                name = f"tag {value}" if kind == "tag" else "in " + " ".join(sorted(features - {"<article>"}))
                of_page[name, node.inside] += n
                if kind == "text":
                    total[node.inside] += n
            for (name, inside), n in of_page.items():
                counts[name, inside] += n * PAGE_WORDS / max(1, total[inside])
        yield pa.RecordBatch.from_pydict({"name": pa.array([k for k, _ in counts], pa.string()), "inside": pa.array([i for _, i in counts], pa.bool_()), "n": pa.array(list(counts.values()), pa.float64())})


def _logistic(sets: list[frozenset[str]], y: np.ndarray, times: np.ndarray, prior: dict[str, float], start: float) -> dict[str, float]:
    """Weights of the features: maximum a posteriori, by Newton steps whose systems conjugate gradients solve."""
    names = sorted(set().union(*sets))
    number = {f: i for i, f in enumerate(names)}
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    cols = np.array([number[f] for s in sets for f in s], np.int64)
    mean = np.array([prior.get(f, 0.0) for f in names])
    w, k = mean.copy(), 1 / SPREAD**2

    def times_x(v: np.ndarray) -> np.ndarray:
        return np.bincount(rows, v[cols], len(sets))

    def loss(w: np.ndarray) -> float:
        z = start + times_x(w)
        return float((times * (np.logaddexp(0, z) - y * z)).sum() + k / 2 * ((w - mean) ** 2).sum())

    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(start + times_x(w), -40, 40)))
        gradient = np.bincount(cols, (times * (p - y))[rows], len(names)) + k * (w - mean)
        curve = times * p * (1 - p)
        step, r = np.zeros(len(names)), -gradient
        d, rr = r.copy(), float(r @ r)
        for _ in range(100):
            if rr < 1e-14:
                break
            hd = np.bincount(cols, (curve * times_x(d))[rows], len(names)) + k * d
            a = rr / float(d @ hd)
            step += a * d
            r = r - a * hd
            rr, before = float(r @ r), rr
            d = r + rr / before * d
        now, size = loss(w), 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(step).max(initial=0) * size < 1e-6:
            break
    return dict(zip(names, w.tolist(), strict=True))


def fit(pages: DataFrame, max_train: int = MAX_TRAIN, prior: dict[str, float] | None = None, start: float = START) -> Weights:
    """Weights from pages with exactly one ``article`` element, at most ``max_train`` of them.

    ``prior`` (``PRIOR`` if None): what names tell before any page; with an empty one, all is learned.
    """
    prior = PRIOR if prior is None else prior
    labelled = pages.select("page_id", "url", "html").where((F.regexp_count("html", F.lit("(?i)<article[\\s>]")) == 1) & (F.length("html") <= MAX_PAGE))
    chosen = labelled.select(F.xxhash64("page_id", "url", "html").alias("h")).distinct().orderBy("h").limit(max_train)
    sample = labelled.join(F.broadcast(chosen), F.xxhash64("page_id", "url", "html") == F.col("h")).dropDuplicates(["h"])
    got = sample.mapInArrow(_counts, "name string, inside boolean, n double").groupBy("name", "inside").agg(F.sum("n").alias("n")).orderBy("name", "inside").collect()
    n = {(r["name"], r["inside"]): r["n"] for r in got}
    words = [k for k in n if k[0].startswith("in ")]
    if len({inside for _, inside in words}) < 2:
        return Weights(features=dict(prior), start=start)
    learned = _logistic([frozenset(name.split()[1:]) for name, _ in words], np.array([float(i) for _, i in words]), np.array([n[k] for k in words]), prior, start)
    tags = {}
    for name in {name[4:] for name, _ in n if name.startswith("tag ")}:
        a, b = n.get((f"tag {name}", True), 0.0), n.get((f"tag {name}", False), 0.0)
        tags[name] = -max(TAG_COSTS[0], min(TAG_COSTS[1], math.log((b + 1) / (a + 1))))
    return Weights(features={**prior, **learned}, start=start, tags=tags)


def extracted(pages: DataFrame, weights: Weights) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages`` (page_id, url, html)."""

    def run(batches):
        for batch in batches:
            texts = [extract(t, weights) for t in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return extracted(pages, fit(pages))
