"""Main text of web pages by site style trees.

The element trees of a host's pages are merged: elements with the same path of tags, classes and ids are one branch of the
host's tree. Over the host's pages (those with the same main text count once) a branch's content matters as little as its
texts repeat (one minus the mean entropy of its texts), its presentation as much as the sequences of its children, or
of its siblings where it has none, vary; its measured importance is both. What HTML says of a branch (its tag, role, class
and what it stands in) is no more than a prior: the log-odds in ``PRIOR``. The measure is added to them, weighed by the
number of pages that show it: text that repeats speaks against a branch, whatever its tag; for a branch speaks the share of
the host's varying text that stands in it. A text which nearly all pages of a host show is a branch of its own, so a notice
among the paragraphs of every article is found. Branches that end below even odds are cut from every page of the host.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable

#: What HTML says of a branch: reader comments; landmarks that hold no text; names of noise; nothing, but the page marks its
#: main part elsewhere; nothing; main text. With the log-odds that it is main text before measuring.
COMMENTS, LANDMARK, NAMED, BESIDE, OPEN, SURE = range(6)
PRIOR = (-4.0, -3.0, -2.0, -1.5, 0.5, 2.5)
#: Log-odds against a branch whose text repeats on all pages (falling to none where half of it varies), and for one that
#: holds all varying text of its host.
REPEATED, MASS = 4.0, 4.0
#: So many pages weigh half of all pages there could be.
HALF_SURE = 8
#: How much more a branch's content than its presentation counts.
CONTENT = 0.9
#: A text on so many of a host's pages, of at least so many, is a branch of its own.
NEARLY_ALL, LEAST_PAGES = 0.9, 8
#: Lists of branches up to so many bytes are broadcast; longer ones are joined, every host in so many parts.
BROADCAST_BYTES, SALTS = 16 << 20, 64

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*))(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[a-z]+")
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe svg canvas select object math audio video xmp noframes".split())
_TO_THE_END = frozenset("script style textarea title xmp".split())  # of these browsers read on to the end of the page, if they aren't closed
_NOISE_TAGS = frozenset("nav aside footer form dialog button menu label input head".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
_NOISE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs consent cookie cookies copyright"
    " disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice overlay pager"
    " pagination popup promo promoted promotion recommended related share sharing sidebar signup skip social"
    " sponsor sponsored subscribe subscription toolbar topbar widget".split()
)
_COMMENT_NAMES = frozenset("comment comments disqus replies reply respond".split())
_MAIN = frozenset(("article", "main"))
_TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li ul ol blockquote pre table tbody thead tfoot tr td th dl dt dd figure figcaption caption header".split())
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_FENCES = frozenset("ul ol table article section main body div td th blockquote".split())
_NEAR = 64  # open elements that are searched for one which a new one closes


def feature(text: str, under: int = 0) -> int:
    """64-bit id of a text or name, below another id."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8, salt=(under & (1 << 64) - 1).to_bytes(8, "big")).digest(), "big", signed=True)


def _verdict(tag: str, attributes: str, above: int, in_article: bool) -> tuple[int, str]:
    """What HTML says of an element under ``above``, and its name in the tree (digits in names don't count)."""
    name, found, own = tag, {}, OPEN
    if attributes and ("=" in attributes or "hidden" in attributes):
        found = {k.lower(): a or b or c for k, a, b, c in _ATTRIBUTE.findall(attributes)}
        classes = sorted({re.sub(r"\d+", "", x) for x in found.get("class", "").lower().split()})
        name = tag + "".join(f".{x}" for x in classes if x) + (f"#{x}" if (x := re.sub(r"\d+", "", found.get("id", "").lower())) else "")
    if found:
        role, style = found.get("role", "").lower(), found.get("style", "").replace(" ", "").lower()
        names = _WORDS.findall(f"{found.get('class', '')} {found.get('id', '')}".lower()) if tag not in ("body", "html", "main") else ()
        if role in _NOISE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style:
            own = LANDMARK
        elif _COMMENT_NAMES.intersection(names):
            own = COMMENTS
        elif _NOISE_NAMES.intersection(names):
            own = NAMED
        elif role in ("main", "article"):
            own = SURE
    if tag in _NOISE_TAGS or (tag == "header" and not in_article):
        own = min(own, LANDMARK)
    if own < OPEN or above < OPEN:
        return min(own, above), name
    if own == SURE or tag in _MAIN or (above == SURE and tag in _TEXT and "." not in name and "#" not in name):
        return SURE, name
    return OPEN, name


class Page:
    """The text blocks of a page in order, each with its branch and what HTML says of it, and the branches' child sequences."""

    def __init__(self, source: str) -> None:
        self.blocks: list[tuple[int, int, int, int, bool, str]] = []  # node, its parent, node where the verdict began, verdict, inside main or article, text
        self.children: dict[int, list[str]] = {0: []}
        self._stack: list[tuple[str, int, int, int, bool]] = [("", 0, 0, OPEN, False)]  # tag, node, node where the verdict began, verdict, inside
        self._count: Counter = Counter()
        self._parts: list[str] = []
        at, end, unclosed = 0, len(source), set()  # raw tags that nothing closes from here on
        while at < end:
            m = _TOKEN.search(source, at)
            if m is None:
                self._parts.append(source[at:])
                break
            if m.start() > at:
                self._parts.append(source[at : m.start()])
            at = max(m.end(), m.start() + 1)
            if not (tag := (m.group(2) or "").lower()):
                continue
            if tag in _RAW:
                if not m.group(1) and not m.group(3).endswith("/"):
                    if tag not in unclosed and (close := re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|$)", re.I).search(source, at)):
                        at = close.end()
                    elif tag in _TO_THE_END:
                        at = end
                    else:
                        unclosed.add(tag)
                self._parts.append(" ")
            elif tag in _BLOCKS or tag in _NOISE_TAGS:
                self._block()
                if m.group(1):
                    self._close(tag)
                elif tag not in _VOID:
                    self._open(tag, m.group(3))
            elif tag == "br":
                self._parts.append(" ")
        self._block()
        if any(inside and verdict >= OPEN for *_, verdict, inside, _ in self.blocks):
            self.blocks = [(n, p, r, BESIDE if v == OPEN and not inside else v, inside, text) for n, p, r, v, inside, text in self.blocks]

    def _block(self) -> None:
        if self._parts:
            text = "".join(self._parts)
            self._parts = []
            if text := " ".join((html.unescape(text) if "&" in text else text).split()):
                _, node, root, verdict, inside = self._stack[-1]
                self.blocks.append((node, self._stack[-2][1] if len(self._stack) > 1 else 0, root, verdict, inside, text))

    def _cut(self, at: int) -> None:
        for tag, *_ in self._stack[at:]:
            self._count[tag] -= 1
        del self._stack[at:]

    def _open(self, tag: str, attributes: str) -> None:
        stack = self._stack
        if tag in _CLOSES:
            if any(self._count[t] for t in _CLOSES[tag]):
                for i in range(len(stack) - 1, max(0, len(stack) - _NEAR), -1):
                    if stack[i][0] in _CLOSES[tag]:
                        self._cut(i)
                        break
                    if stack[i][0] in _FENCES:
                        break
        elif stack[-1][0] == "p" or (tag[0] == "h" and len(tag) == 2 and stack[-1][0] == tag):
            self._cut(len(stack) - 1)
        _, node, root, above, inside = stack[-1]
        verdict, name = _verdict(tag, attributes, above, inside)
        self.children.setdefault(node, []).append(name)
        self._count[tag] += 1
        own = feature(name, node)
        stack.append((tag, own, root if verdict == above else own, verdict, inside or (verdict == SURE and tag not in _TEXT)))

    def _close(self, tag: str) -> None:
        if self._count[tag]:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == tag:
                    self._cut(i)
                    return


def branch(node: int, verdict: int) -> int:
    """A node is another branch under each verdict."""
    return node ^ (verdict + 1) * 0x1F3D5B79


def page_features(source: str) -> tuple[int, set[tuple[int, int, int, int, int, int]]]:
    """Id of a page's main text, and (branch, root, verdict, kind, feature, length) of all that it shows: kind 0 a branch,
    1 a block's text, 2 a sequence of children (of the branch, else of its parent), 3 (branch 0) the page itself."""
    page, out = Page(source), set()
    best = max((v for *_, v, _, _ in page.blocks), default=OPEN)
    main = feature("\n".join(text for *_, verdict, _, text in page.blocks if verdict == best))
    out.add((0, 0, OPEN, 3, 0, 0))
    sequences: dict[int, int] = {}
    for node, parent, root, verdict, _, text in page.blocks:
        key = (branch(node, verdict), branch(root, verdict), verdict)
        of = node if node in page.children else parent
        if of not in sequences:
            names = page.children.get(of, [])
            sequences[of] = feature(" ".join([n for i, n in enumerate(names) if i == 0 or n != names[i - 1]] + [str(len(names))]))
        out |= {(*key, 0, 0, 0), (*key, 1, feature(text), len(text)), (*key, 2, sequences[of], 0)}
    return main, out


def main_text(source: str, turned: frozenset[int]) -> str:
    """The text of a page's blocks: what HTML and the host's tree, where it has ``turned`` a branch or a text, make of it."""
    out = []
    for node, _, _, verdict, _, text in Page(source).blocks:
        own = branch(node, verdict)
        if (PRIOR[verdict] > 0) != (own in turned) and not (turned and own ^ feature(text) in turned):
            out.append(text)
    return "\n\n".join(out)


def branch_importance(pages: DataFrame) -> DataFrame:
    """host, branch, verdict, pages, measured, mass, importance of every branch that holds text, and of every text that
    nearly all pages of a host show (``text``, else null); ``pages`` has host and html."""

    def features(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["host", "page", "branch", "root", "verdict", "kind", "feature", "length"]
        for part in parts:
            rows = []
            for host, source in zip(part.host, part.html, strict=True):
                main, found = page_features(source or "")
                rows += [(host, main, *f) for f in found]
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({n: "int32" if n in ("verdict", "kind", "length") else "int64" for n in names[1:]})

    each = pages.select("host", "html").mapInPandas(features, "host string, page long, branch long, root long, verdict int, kind int, feature long, length int")
    of = ["host", "branch", "root", "verdict"]
    found = durable(each.groupBy(*of, "kind", "feature").agg(F.countDistinct("page").cast("double").alias("k"), F.max("length").alias("length")))
    host_pages = found.filter("kind = 3").select(F.col("host").alias("host_"), F.col("k").alias("all_pages"))
    some = lambda kind, value: F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))
    weighed = F.col("k") * F.log("k")
    nodes = found.filter("kind < 3").groupBy(*of).agg(
        some(0, F.col("k")).alias("pages"),
        (some(1, weighed) / some(1, F.col("k"))).alias("texts"),
        (some(2, weighed) / some(2, F.col("k"))).alias("sequences"),
        some(1, F.col("length")).alias("varying"),
    )
    roots = nodes.groupBy("host", "root").agg(F.sum("varying").alias("inside"))
    total = nodes.groupBy("host").agg(F.sum("varying").alias("total"))
    common = found.filter("kind = 1").join(host_pages, F.col("host") == F.col("host_")).filter((F.col("all_pages") >= LEAST_PAGES) & (F.col("k") >= NEARLY_ALL * F.col("all_pages")))
    log_m = F.log("pages")
    content, style = 1 - F.col("texts") / log_m, 1 - F.col("sequences") / log_m
    measured = F.when(F.col("pages") > 1, CONTENT * content + (1 - CONTENT) * style).otherwise(0.5)
    branches = nodes.join(roots, ["host", "root"]).join(total, "host").select(
        "host", "branch", F.lit(None).cast("long").alias("text"), "verdict", "pages", measured.alias("measured"), (F.col("inside") / F.greatest("total", F.lit(1))).alias("mass")
    )
    texts = common.select("host", "branch", F.col("feature").alias("text"), "verdict", F.col("all_pages").alias("pages"), (1 - F.log("k") / F.log("all_pages")).alias("measured"), F.lit(0.0).alias("mass"))
    sure = F.when(F.col("pages") > 1, F.col("pages") / (F.col("pages") + HALF_SURE)).otherwise(0.0)
    prior = F.element_at(F.array(*[F.lit(x) for x in PRIOR]), F.col("verdict") + 1)
    odds = prior + sure * (MASS * F.col("mass") * F.col("measured") - 2 * REPEATED * F.greatest(F.lit(0.0), 0.5 - F.col("measured")))
    return branches.unionByName(texts).withColumns({"prior": prior, "importance": 1 / (1 + F.exp(-odds))})


def turned_branches(pages: DataFrame) -> DataFrame:
    """host, turned: the branches for which the host's pages overrule what HTML says, and the texts to take from the others."""
    found = branch_importance(pages)
    low, kept = F.col("importance") < 0.5, F.col("prior") > 0
    turned = found.filter(F.when(F.col("text").isNull(), low == kept).otherwise(low & kept))
    own = F.when(F.col("text").isNull(), F.col("branch")).otherwise(F.col("branch").bitwiseXOR(F.coalesce("text", F.lit(0))))
    return turned.groupBy("host").agg(F.collect_set(own).alias("turned"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text of every page: its main text, blocks joined by two line feeds, empty if there is none.

    Null or empty html gives empty text; a null url is a host of its own; repeated rows each give a row, and count once when
    the tree is measured; an element that isn't closed holds what follows (a script, style, textarea or title to the end of
    the page); pages of any length and depth are read whole, in memory that grows with their length; an empty table gives
    none; other columns are ignored.
    """
    host = F.coalesce(F.regexp_replace(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", ""), F.lit(""))
    named = pages.select("page_id", "url", "html", host.alias("host"))
    turned = durable(turned_branches(named))
    size = turned.agg(F.sum(F.size("turned") * 8 + F.octet_length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:  # sent to each task once, not into each page's row
        sent = pages.sparkSession.sparkContext.broadcast({r.host: frozenset(r.turned) for r in turned.collect()})
        joined = named.withColumn("turned", F.lit(None).cast("array<bigint>"))
    else:
        salted = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = salted.join(turned.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["host", "salt"], "left")
        sent = None

    def texts(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = frozenset()
        of = (lambda host, _: sent.value.get(host, none)) if sent is not None else (lambda _, own: none if own is None else frozenset(own))
        for part in parts:
            text = [main_text(h or "", of(host, t)) for h, host, t in zip(part.html, part.host, part.turned, strict=True)]
            yield pd.DataFrame({"page_id": part.page_id, "url": part.url, "text": text})

    return joined.select("page_id", "url", "html", "host", "turned").mapInPandas(texts, "page_id long, url string, text string")
