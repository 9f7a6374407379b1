"""Exact repeated windows of a corpus, found from sampled positions instead of every position.

Every document is a sequence of symbols (bytes, words or ready 64-bit ids). For windows of ``window`` symbols, the
``gram``-symbol string of least hash inside a window (the leftmost on ties) is the window's anchor. Equal windows have
equal anchors at the same place, so only windows whose anchor occurs twice can repeat. Consecutive windows of a document
with one anchor form an *entry*; its passage is all the symbols those windows span. One entry stands for about half of
(window - gram) windows, which keeps what is shuffled at a small share of the text.

1. ``entries``         one row an entry: anchor key, passage hash, place; staged once and read by all later steps.
2. repeated anchors    counted with partial aggregation; a hot anchor is one row a task. An index may have found them already.
3. ``passages``        distinct passages under repeated anchors. An anchor with one distinct passage is settled by its count.
4. contested anchors   several passages share the anchor: a suffix array of the passages shows which windows are equal, or
                       the passages are parsed against it (``Spec.parse``), for groups up to ``group_limit`` passages;
                       larger groups take a distributed count of window hashes. No pairs are made.
5. ``marks``           per document, the entries with a bit mask of the windows that occur elsewhere.

Hashes decide the equality of passages (two independent ones of 64 bits) and of the windows of the larger groups (64 bits
within one anchor and offset); elsewhere the symbols do.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import kept_by_worker, parallel, release, remove, slices, staged
from frameloom.llm.suffixes import Suffixes, across, factored, twice

BASE_1, BASE_2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
ENTRY = "doc_id long, th long, pack long, ah long, ph long"
POS_BITS = 24
SEGMENT = 1 << 20
BLOCK = 1 << 18


@dataclass(frozen=True)
class Spec:
    """kind: 'bytes' and 'words' take strings, 'ids' takes binary 64-bit symbols. distinct: repeats count only across documents.
    parse: settle contested passages by relative Lempel-Ziv parsing."""

    window: int
    gram: int
    kind: str = "words"
    distinct: bool = False
    group_limit: int = 4096
    parse: bool = False

    @property
    def span(self) -> int:
        return self.window - self.gram + 1


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h


@lru_cache(1)
def _byte_codes() -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64)


def symbols(text: str | bytes | None, kind: str) -> np.ndarray:
    if text is None:
        return np.empty(0, np.uint64)
    if kind == "ids":
        return np.frombuffer(text, np.uint64)
    data = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    if kind == "bytes":
        return _byte_codes()[np.frombuffer(data, np.uint8)]
    words = data.split()
    return np.fromiter(map(kept_by_worker("words", _Words).__getitem__, words), np.uint64, len(words))


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers, or more, of an odd base and of its inverse; the longest arrays so far are kept."""
    if base not in _POWERS or len(_POWERS[base][0]) < n:
        _POWERS.pop(base, None)
        with np.errstate(over="ignore"):
            up, down = np.full(n, base, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            _POWERS[base] = np.cumprod(up, out=up), np.cumprod(down, out=down)
    return _POWERS[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _prefix(s: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, max(BLOCK * 2, len(s) + 1))
    q = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(s * up[: len(s)], out=q[1:])
    return q, down


def window_hashes(s: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n symbols."""
    if len(s) < n:
        return np.empty(0, np.uint64)
    q, down = _prefix(s, BASE_1)
    return mix((q[n:] - q[:-n]) * down[: len(s) - n + 1])


def anchors(s: np.ndarray, ends: np.ndarray, spec: Spec) -> tuple[np.ndarray, ...]:
    """For documents that lie one after another in s (ends: where each ends): document number, first window, number of
    windows, anchor's place after the first window, anchor hash and passage hash of every entry; places count from s's start."""
    w, k, span = spec.window, spec.gram, spec.span
    none = tuple(np.empty(0, np.int64) for _ in range(4)) + tuple(np.empty(0, np.uint64) for _ in range(2))
    if len(s) < w:
        return none
    g = window_hashes(s, k)
    low = np.uint64((1 << POS_BITS) - 1)
    v = (g & ~low) | np.arange(len(g), dtype=np.uint64)
    step = 1
    while step * 2 <= span:
        v = np.minimum(v[:-step], v[step:])
        step *= 2
    if span > step:
        v = np.minimum(v[: len(v) - (span - step)], v[span - step :])
    at = (v & low).astype(np.int64)  # the anchor of each window
    starts = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(at) + 1, np.int32)
    has = ends - starts >= w
    np.add.at(inside, starts[has], 1)
    np.add.at(inside, np.minimum(ends[has] - w + 1, len(at)), -1)
    inside = np.cumsum(inside[:-1]) > 0
    new = np.ones(len(at), bool)
    new[1:] = at[1:] != at[:-1]
    new[starts[has]] = True
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    keep = inside[first]
    first, last = first[keep], last[keep]
    if not len(first):
        return none
    a = at[first]
    q, down = _prefix(s, BASE_2)
    ph = mix((q[last + w] - q[first]) * down[first] + (last - first + 1).astype(np.uint64) * np.uint64(BASE_1) + (a - first).astype(np.uint64))
    return np.searchsorted(ends, first, "right"), first, last - first + 1, a - first, g[a], ph


def alphabetical(h: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Signed keys in the order of the four bytes from each place on, then of a hash of more of them."""
    head = np.zeros(len(at), np.uint64)
    for i in range(4):
        here = at + i
        head = head << np.uint64(8) | np.where(here < len(data), data[np.minimum(here, len(data) - 1)], 0).astype(np.uint64)
    return ((head << np.uint64(32) | h >> np.uint64(32)) ^ np.uint64(1 << 63)).view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch], spec: Spec) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Documents in blocks of about BLOCK symbols: [(doc_id, th, offset)] and their symbols, bytes as they are. Documents over
    SEGMENT symbols come in overlapping parts, so that each window lies in one part; a block may hold some of them only, as its
    places must fit POS_BITS."""
    rows, parts, size = [], [], 0
    for batch in slices(batches):
        for doc, th, text in zip(batch["doc_id"].to_pylist(), batch["th"].to_pylist(), batch["text"], strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            s = np.frombuffer(data, np.uint8) if spec.kind == "bytes" else symbols(data, spec.kind)
            for at in range(0, max(1, len(s)), SEGMENT):
                rows.append((doc, th, at))
                parts.append(s[at : at + SEGMENT + spec.window - 1])
                size += len(parts[-1])
                if size >= BLOCK:
                    yield rows, parts
                    rows, parts, size = [], [], 0
    if rows:
        yield rows, parts


def _entries(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, parts in _blocks(batches, spec):
        s, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
        doc, first, wins, off, ah, ph = anchors(_byte_codes()[s] if spec.kind == "bytes" else s, ends, spec)
        ah = alphabetical(ah, s, first + off) if spec.kind == "bytes" and len(ah) else ah.view(np.int64)
        starts = np.concatenate(([0], ends[:-1]))
        ids = pa.array([r[0] for r in rows], pa.int64())
        ths = np.array([r[1] for r in rows], np.int64)
        base = np.array([r[2] for r in rows], np.int64)
        pack = ((first - starts[doc] + base[doc]) << 24) | (wins << 12) | off
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(ths[doc]), pa.array(pack), pa.array(ah), pa.array(ph.view(np.int64))], ["doc_id", "th", "pack", "ah", "ph"])


def entries(docs: DataFrame, spec: Spec) -> DataFrame:
    if not 1 <= spec.gram <= spec.window or spec.span >= 1 << 12:
        raise ValueError("gram must lie in 1..window and window - gram under 4095")
    if spec.parse and spec.distinct:
        raise ValueError("parsing counts repeats within a document too")
    return docs.select("doc_id", "th", "text").mapInArrow(partial(_entries, spec), ENTRY)


def _doc():
    """doc_id, where null stands for one document more."""
    return F.coalesce("doc_id", F.lit(-(1 << 62)))


def repeated_anchors(found: DataFrame, spec: Spec) -> DataFrame:
    if spec.distinct:
        return found.groupBy("ah").agg(F.min(_doc()).alias("lo"), F.max(_doc()).alias("hi")).where("lo < hi").select("ah")
    return found.groupBy("ah").agg(F.count("*").alias("n")).where("n > 1").select("ah")


def _passages_of(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols of the wanted passages of each document."""
    for batch in slices(batches):
        rows: dict[str, list] = {k: [] for k in ("ah", "ph", "n", "lo", "hi", "nph", "wins", "off", "sym")}
        for text, wanted in zip(batch["text"], batch["want"].to_pylist(), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else None
            s = np.frombuffer(data or b"", np.uint8) if spec.kind == "bytes" else symbols(data, spec.kind)
            for x in wanted:
                start, wins, off = x["pack"] >> 24, x["pack"] >> 12 & 4095, x["pack"] & 4095
                for k in ("ah", "ph", "n", "lo", "hi", "nph"):
                    rows[k].append(x[k])
                rows["wins"].append(wins)
                rows["off"].append(off)
                rows["sym"].append(s[start : start + wins - 1 + spec.window].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if k == "sym" else pa.int32() if k in ("wins", "off") else pa.int64()) for k, v in rows.items()], list(rows))


PASSAGE = "ah long, ph long, n long, lo long, hi long, nph long, wins int, off int, sym binary"


def _spread(rows: dict[str, np.ndarray], syms: list[bytes], spec: Spec) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the windows of some passages: the passage's number, the window's number, its hash."""
    s = np.concatenate([np.frombuffer(x, np.uint8 if spec.kind == "bytes" else np.uint64) for x in syms])
    s = _byte_codes()[s] if spec.kind == "bytes" else s
    wins = rows["wins"].astype(np.int64)
    base = np.concatenate(([0], np.cumsum(wins - 1 + spec.window)[:-1]))
    which = np.repeat(np.arange(len(wins)), wins)
    number = np.arange(len(which)) - np.repeat(np.cumsum(wins) - wins, wins)
    return which, number, window_hashes(s, spec.window)[base[which] + number]


def _masks(flags: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in np.packbits(flags, axis=1)]


def _settled(rows: dict[str, np.ndarray], syms: list[bytes], spec: Spec) -> pa.RecordBatch:
    """Which windows of whole groups of passages occur elsewhere."""
    _, keep = np.unique(np.stack([rows["ah"], rows["ph"]]), axis=1, return_index=True)  # repeated rows of a document
    rows, syms = {k: v[keep] for k, v in rows.items()}, [syms[i] for i in keep]
    flags = np.zeros((len(syms), spec.span), bool)
    lengths = rows["wins"].astype(np.int64) - 1 + spec.window
    s = np.concatenate([np.frombuffer(x, np.uint8 if spec.kind == "bytes" else np.uint64) for x in syms])
    index = Suffixes(s, lengths, None if spec.kind == "bytes" else rows["ah"])  # equal windows lie under one anchor anyway
    if spec.distinct:
        found = across(index, rows["lo"], rows["hi"], spec.window)
    elif spec.parse:
        found = factored(index, rows["n"] > 1, spec.window)
    else:
        found = twice(index, rows["n"], spec.window)
    hit = np.flatnonzero(found)
    flags[index.passage[hit], hit - index.base[index.passage[hit]]] = True
    return _flagged(rows, flags)


def _flagged(rows: dict[str, np.ndarray], flags: np.ndarray) -> pa.RecordBatch:
    some = flags.any(axis=1)
    return pa.RecordBatch.from_arrays([pa.array(rows["ah"][some]), pa.array(rows["ph"][some]), pa.array(_masks(flags[some]), pa.binary())], ["ah", "ph", "mask"])


def _settle(spec: Spec, batches: Iterator[pa.RecordBatch], symbols_at_once: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Groups arrive sorted by anchor; whole groups are settled together, some passages at a time."""
    at_once = max(1, symbols_at_once // (spec.window + spec.span // 2))
    held: list[pa.RecordBatch] = []
    names = ("ah", "ph", "n", "lo", "hi", "wins", "off")

    def flush(table: pa.Table) -> pa.RecordBatch:
        return _settled({k: table[k].to_numpy() for k in names}, table["sym"].to_pylist(), spec)

    for batch in batches:
        for at in range(0, batch.num_rows, at_once):
            held.append(batch.slice(at, at_once))
            if sum(b.num_rows for b in held) >= at_once:
                table = pa.Table.from_batches(held)
                ah = table["ah"].to_numpy()
                cut = int(np.searchsorted(ah, ah[-1]))
                if cut:
                    yield flush(table.slice(0, cut))
                held = table.slice(cut).to_batches()
    if held and sum(b.num_rows for b in held):
        yield flush(pa.Table.from_batches(held))


def _spread_rows(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            rows = {k: part[k].to_numpy() for k in ("ah", "ph", "n", "lo", "hi", "wins", "off")}
            which, number, h = _spread(rows, part["sym"].to_pylist(), spec)
            place = number - rows["off"][which]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rows["ah"][which], place.astype(np.int32), h.view(np.int64), rows["ph"][which], rows["n"][which], rows["lo"][which], rows["hi"][which], number.astype(np.int32))], ["ah", "place", "wh", "ph", "n", "lo", "hi", "number"])


def _to_masks(spec: Spec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        flags = np.zeros((batch.num_rows, spec.span), bool)
        for i, numbers in enumerate(batch["numbers"].to_pylist()):
            flags[i, numbers] = True
        yield pa.RecordBatch.from_arrays([batch["ah"], batch["ph"], pa.array(_masks(flags), pa.binary())], ["ah", "ph", "mask"])


def marks(spark: SparkSession, docs: DataFrame, spec: Spec, work: str, found: DataFrame | None = None, repeated: DataFrame | None = None) -> DataFrame:
    """doc_id, th and runs (array of pack, mask) of every document that holds a repeated window.

    docs: doc_id, th, text. mask null: every window of the entry repeats. found, repeated: the entries of docs, staged, and their
    repeated anchors, if an index has them already. Joins run on shuffled staged tables, so that skewed anchors are split at
    run time.
    """
    if found is None:
        found = staged(entries(docs, spec), f"{work}/entries")
        release(spark)
    if repeated is None:
        repeated = staged(repeated_anchors(found, spec), f"{work}/anchors")
        release(spark)
    # grouped by a struct, which the join's partitions by anchor do not serve: rows are counted where they were joined, and
    # a hot anchor's passages then go to many tasks
    key = F.struct("ah", "ph").alias("key")
    grouped = found.join(repeated.hint("merge"), "ah").groupBy(key).agg(F.count("*").alias("n"), F.min(_doc()).alias("lo"), F.max(_doc()).alias("hi"), F.min(F.struct("doc_id", "th", "pack")).alias("rep"))
    passages = staged(grouped.select("key.*", "n", "lo", "hi", "rep"), f"{work}/passages")
    release(spark)
    contested = staged(passages.groupBy("ah").agg(F.count("*").alias("nph")).where("nph > 1"), f"{work}/contested")
    sure = passages.join(contested.hint("merge"), "ah", "left_anti").where("lo < hi" if spec.distinct else "n > 1")
    sure = sure.select("ah", "ph", F.lit(None).cast("binary").alias("mask"))
    wanted = (
        passages.join(contested.hint("merge"), "ah")
        .select(F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), F.struct(F.col("rep.pack").alias("pack"), "ah", "ph", "n", "lo", "hi", "nph").alias("x"))
        .groupBy("doc_id", "th")
        .agg(F.collect_list("x").alias("want"))
    )
    texts = docs.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.th") == F.col("w.th"))).select("text", "want")
    held = staged(texts.mapInArrow(partial(_passages_of, spec), PASSAGE), f"{work}/texts")
    release(spark)
    small = held.where(F.col("nph") <= spec.group_limit).repartition(parallel(held), "ah").sortWithinPartitions("ah")
    settled = small.mapInArrow(partial(_settle, spec), "ah long, ph long, mask binary")
    if contested.where(F.col("nph") > spec.group_limit).limit(1).count():
        spread = staged(held.where(F.col("nph") > spec.group_limit).mapInArrow(partial(_spread_rows, spec), "ah long, place int, wh long, ph long, n long, lo long, hi long, number int"), f"{work}/spread")
        many = F.min("lo") < F.max("hi") if spec.distinct else (F.min("ph") != F.max("ph")) | (F.max("n") > 1)
        twice = staged(spread.groupBy("ah", "place", "wh").agg(many.alias("many")).where("many").drop("many"), f"{work}/twice")
        large = spread.join(twice.hint("merge"), ["ah", "place", "wh"]).groupBy("ah", "ph").agg(F.collect_set("number").alias("numbers"))
        settled = settled.unionByName(large.mapInArrow(partial(_to_masks, spec), "ah long, ph long, mask binary"))
    flagged = staged(sure.unionByName(settled), f"{work}/flagged")
    for name in ("anchors", "passages", "contested", "texts", "spread", "twice"):
        remove(spark, f"{work}/{name}")
    release(spark)
    hit = found.join(flagged.hint("merge"), ["ah", "ph"])
    return hit.groupBy("doc_id", "th").agg(F.collect_list(F.struct("pack", "mask")).alias("runs"))


def covered(n: int, runs: list[dict] | None, spec: Spec) -> np.ndarray:
    """Which of a document's n symbols lie in a repeated window."""
    edge = np.zeros(n + 1, np.int64)
    for x in runs or ():
        start, wins = x["pack"] >> 24, x["pack"] >> 12 & 4095
        if x["mask"] is None:
            edge[start] += 1
            edge[start + wins - 1 + spec.window] -= 1
        else:
            on = start + np.flatnonzero(np.unpackbits(np.frombuffer(x["mask"], np.uint8))[:wins])
            edge[on] += 1
            edge[on + spec.window] -= 1
    return np.cumsum(edge[:-1]) > 0


def with_marks(docs: DataFrame, marked: DataFrame) -> DataFrame:
    """Every row of docs (doc_id, th, text) with its runs, null if it has none."""
    on = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.th") == F.col("m.th"))
    return docs.alias("d").join(marked.alias("m"), on, "left").select("d.doc_id", "d.th", "d.text", "m.runs")
