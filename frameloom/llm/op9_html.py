"""HTML main text with host suffix arrays.

A page is cut into blocks. What an element means decides their kind: blocks inside article or main are *text*; blocks inside
navigation, headers, footers, asides, forms, hidden elements and containers whose class is precisely that of an advert or of
reader comments are *boilerplate*; all others are *open*. Inside article and main neither ids nor parts of class names drop
anything; a header there belongs to the article, and an article inside an article that has begun is a reader's comment.

The host arrays decide the open blocks. The token streams of all open and boilerplate blocks of every page are concatenated by
host, and ``repeats`` finds every run of ``window`` tokens that stands on two pages of distinct content of one host. A token's
symbol carries its host, so hosts never match each other. A host is not one array in one task: its streams are cut at
anchors, and the passages under one anchor have a suffix array of their own (``suffixes``), so that a hot host is spread over
tasks. Covered tokens are cut from the open blocks, and their unique runs are kept, joined by a space.

A page's text is its text blocks, together with what is left of its open blocks if that is more than the text blocks hold (no
article, or only a teaser of one). Text blocks are never put into the arrays: an article that a host shows twice is still
the article.

Defined results: null, empty and text-free html gives an empty text; a null url is a host of its own. Pages of one host with
equal blocks are one page to the arrays, whatever their ids and urls, so repeated rows and ties give equal texts. Very long
pages are parsed whole, one at a time. Markup that ends early is read as far as it goes. Extra columns of any name are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import slices, staged, work_dir
from frameloom.llm.repeats import Spec, covered, marks, mix

WINDOW, GRAM = 8, 3

# Names from the HTML standard, and class names that say advert or reader's comment.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr"
    " html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
DROPPED = frozenset("nav header footer aside form search button select option dialog menu object canvas audio video head fieldset annotation annotation-xml".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
CONTAINERS = frozenset("div section ul ol li ins span".split())
MARKED = frozenset("ad ads advert advertisement comment comments".split())
MAIN = frozenset(("article", "main"))
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|<[!?][^>]*>|<(?=/?[a-zA-Z!?])[^<]*$", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is boilerplate by what it means; inside: in an article or main element."""
    if tag in DROPPED:
        return not (tag == "header" and inside)
    if not attributes or tag in ("html", "body"):
        return False
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "").lower() for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
        return True
    if tag in MAIN:
        return False
    named = {*found.get("class", "").split(), *({"comments"} & {found.get("id", "")})}
    return found.get("role") in ROLES or tag in CONTAINERS and bool(named & MARKED)


class _Blocks:
    """Reads a page's blocks in order."""

    def __init__(self) -> None:
        self.out: list[tuple[str, str]] = []
        self.held: list[str] = []
        self.stack: list[tuple[str, int, bool]] = []  # tag, depth of article and main, boilerplate; of inline elements only boilerplate
        self.begun = False  # whether the outermost article has text

    @property
    def main(self) -> int:
        return self.stack[-1][1] if self.stack else 0

    @property
    def dropped(self) -> bool:
        return bool(self.stack) and self.stack[-1][2]

    @property
    def skipping(self) -> bool:
        """Inside an inline element that is boilerplate: its text goes, the block around it goes on."""
        return bool(self.stack) and self.stack[-1][0] not in BLOCK

    def text(self, raw: str) -> None:
        if raw and not self.skipping:
            self.held.append(raw)

    def flush(self) -> None:
        if self.held:
            text = " ".join(entities.unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                while_dropped = next((d for t, _, d in reversed(self.stack) if t in BLOCK), False)
                self.out.append(("boilerplate" if while_dropped else "text" if self.main else "open", text))
                self.begun |= self.out[-1][0] == "text"

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
            if tag not in BLOCK and self.stack[i][0] in BLOCK:
                break  # an inline element does not close the block that it stands in
        self.begun &= self.main > 0

    def open(self, tag: str, attributes: str) -> None:
        alone = attributes.rstrip().endswith("/")
        if tag not in BLOCK:
            if (self.skipping or _boilerplate(tag, attributes, self.main > 0)) and not alone:
                self.stack.append((tag, self.main, True))
            return
        self.flush()
        if self.stack and (self.stack[-1][0] == "p" or self.stack[-1][0] in CLOSES.get(tag, ())):
            self.stack.pop()
        comment = tag == "article" and self.begun and any(t == "article" for t, _, _ in self.stack)
        bad = self.dropped or comment or _boilerplate(tag, attributes, self.main > 0)
        if not alone:
            self.stack.append((tag, self.main + (tag in MAIN), bad))


def blocks(page: str) -> list[tuple[str, str]]:
    """(kind, text) of every block in order; kind: text, open or boilerplate."""
    found, at, end = _Blocks(), 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            found.text(page[at:])
            break
        found.text(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if tag == "br":
            found.text(" ")
        elif tag == "hr":
            found.flush()
        elif tag and m[1]:
            found.close(tag)
        elif tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = close.end() if close else end
        elif tag and tag not in VOID:
            found.open(tag, m[3])
    found.flush()
    return found.out


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


def _content(found: list[tuple[str, str]], url: str | None) -> tuple[int, int]:
    """Signed hashes of a page's blocks and of its host."""
    both = np.array([xxhash.xxh3_64_intdigest("\0".join(f"{kind} {text}" for kind, text in found).encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(host_of(url))], np.uint64)
    return tuple(both.view(np.int64).tolist())


PARSED = "page_id long, url string, doc_id long, th long, text string, kinds array<string>, blocks array<string>, ids binary"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as their text blocks, with the tokens outside them as symbols of their host; doc_id and th name a content and its
    host. Where open blocks could be more than the text, all blocks follow with their kinds, else these are null."""
    for batch in slices(batches):
        rows = []
        for url, page in zip(batch["url"].to_pylist(), batch["html"].to_pylist(), strict=True):
            found = blocks(page or "")
            content, host = _content(found, url)
            size = {k: sum(len(text.split()) for kind, text in found if kind == k) for k in ("text", "open")}
            undecided = size["open"] > size["text"]
            tokens = [t for kind, text in found if kind != "text" for t in text.encode("utf-8", "surrogatepass").split()]
            ids = mix(np.array([xxhash.xxh3_64_intdigest(t) for t in tokens], np.uint64) ^ np.int64(host).view(np.uint64)).tobytes()
            known = "\n\n".join(text for kind, text in found if kind == "text")
            rows.append((content, host, known, *(zip(*found) if undecided else (None, None)), ids))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary())
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"].cast(pa.string()), *columns], ["page_id", "url", "doc_id", "th", "text", "kinds", "blocks", "ids"])


def _left(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of pages whose open blocks may count: these lose the covered tokens."""
    for batch in slices(batches):
        texts = []
        for kinds, found, known, runs in zip(*(batch[c].to_pylist() for c in ("kinds", "blocks", "text", "runs")), strict=True):
            cut = covered(sum(len(text.split()) for kind, text in zip(kinds, found) if kind != "text"), runs, spec)
            parts, at, size = [], 0, 0
            for kind, text in zip(kinds, found):
                if kind == "text":
                    parts.append(text)
                    continue
                words = text.split()
                own = [w for w, x in zip(words, cut[at : at + len(words)].tolist(), strict=True) if not x]
                at += len(words)
                if kind == "open" and own:
                    parts.append(" ".join(own))
                    size += len(own)
            texts.append("\n\n".join(parts) if size > len(known.split()) else known)
        yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def main_text(spark: SparkSession, pages: DataFrame, window: int = WINDOW, gram: int = GRAM, group_limit: int = 4096) -> DataFrame:
    """page_id, url, text, one row a row of pages (page_id, url, html). Every page is parsed once."""
    spec, work = Spec(window, gram, "ids", distinct=True, group_limit=group_limit), work_dir(spark, "hosts")
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    parsed = staged(own.mapInArrow(_parsed, PARSED), f"{work}/parsed")
    streams = staged(parsed.groupBy("doc_id", "th").agg(F.first("ids").alias("text")), f"{work}/streams")
    found = staged(marks(spark, streams, spec, work), f"{work}/marks")
    open_ = parsed.where("kinds is not null").drop("ids").join(found.hint("merge"), ["doc_id", "th"], "left")
    judged = open_.select("page_id", "url", "kinds", "blocks", "text", "runs").mapInArrow(partial(_left, spec), "page_id long, url string, text string")
    return parsed.where("kinds is null").select("page_id", "url", "text").unionByName(judged)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = main_text(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
