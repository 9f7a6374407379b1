"""The training-data operators against brute force, round trips and odd inputs."""

import hashlib
import html
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

import __spark_entry__ as entry
from frameloom.llm import op1_simhash as op1
from frameloom.llm import op2_substring as op2
from frameloom.llm import op3_language as op3
from frameloom.llm import op4_mixing as op4
from frameloom.llm import op5_chat as op5
from frameloom.llm import op6_decontaminate as op6
from frameloom.llm import op7_media as op7
from frameloom.llm import op8_suffix_index as op8
from frameloom.llm import op9_html as op9
from frameloom.llm import op10_tokens as op10
from frameloom.llm import registry, repeats
from frameloom.llm.suffixes import Suffixes, across, factored, twice

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th long, fp string, size string, copies string, target string, n string"


def made(seed: int = 0, n: int = 60) -> list[tuple]:
    """Documents with exact and near copies, shared passages, periodic and long texts, nulls, repeated rows."""
    rng = np.random.default_rng(seed)
    words = ["alpha", "Beta", "gamma", "delta,", "épsilon", "zêta", "x", "the", "of", "日本", "ß"]

    def text(k: int) -> str:
        return " ".join(rng.choice(words, k)) + " " + " ".join(f"w{v}" for v in rng.integers(0, 5000, k))

    passage, texts = text(60), []
    for i in range(n):
        t = text(int(rng.integers(1, 60)))
        if i % 3 == 0:
            t = t + "\n" + passage + "  " + text(3)
        if i % 10 == 7:
            t = texts[-1] or ""
        if i % 10 == 9:
            t = (texts[0] or "") + " more"
        texts.append(t)
    texts += [None, "", " \t\n ", "a", "a b", "é", "ab" * 600, "z " * 900, passage, passage, text(4000), "🙂" * 80]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s1", "s2", "s3"][i % 4] if i % 2 else "hot", len(t or ""), 1, "a", "b", "c", "d", "e") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[-3], rows[-3], (None, "nobody " * 40, None, None, 0, 1, "a", "b", "c", "d", "e")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(made(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_sql(spark, db, name):
    got = entry.queries()[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, db.execute(f"select {columns} from ({registry.ORACLES[name]})").fetchall()))


def brute_cover(units: list, window: int) -> list[list[bool]]:
    count = Counter(tuple(u[p : p + window]) for u in units for p in range(len(u) - window + 1))
    out = []
    for u in units:
        hit = [False] * len(u)
        for p in range(len(u) - window + 1):
            if count[tuple(u[p : p + window])] > 1:
                hit[p : p + window] = [True] * window
        out.append(hit)
    return out


@pytest.mark.parametrize(("window", "gram", "limit"), [(35, 9, 4096), (8, 3, 1), (5, 5, 2), (3, 1, 4096)])
def test_substring_dedup(spark, docs, window, gram, limit):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    units = [(t or "").encode().split() for _, t in rows]
    want = sorted(str((i, len(u), sum(h), b" ".join(w for w, x in zip(u, h) if not x).decode())) for (i, _), u, h in zip(rows, units, brute_cover(units, window)))
    assert sorted(str(tuple(r)) for r in op2.substring_dedup(spark, docs, window, gram, limit).collect()) == want


def test_spans_of_substring_dedup(spark, docs):
    rows = [(str(r.doc_id), r.text, r.n_words, [(x.start, x.length) for x in r.spans]) for r in op2.parsed(spark, docs, 8, 3).collect()]
    units = [(t or "").encode().split() for _, t, _, _ in rows]
    for (_, _, n, spans), u, hit in zip(rows, units, brute_cover(units, 8)):
        assert n == len(u) and spans == op2.joined(np.array(hit, bool)) and sum(k for _, k in spans) == sum(hit)


def longest(u: list, v: list) -> list[int]:
    """For every place of u, its longest match anywhere in v."""
    out = []
    for a in range(len(u)):
        sizes = [0]
        for b in range(len(v)):
            n = 0
            while a + n < len(u) and b + n < len(v) and u[a + n] == v[b + n]:
                n += 1
            sizes.append(n)
        out.append(max(sizes))
    return out


def test_parse_against_blocks():
    for seed in range(300):
        r = random.Random(seed)
        window = r.randint(1, 6)
        parts = [[r.randint(0, r.choice((1, 2, 4))) for _ in range(r.randint(window, 14))] for _ in range(r.randint(1, 7))]
        block, whole = [r.randint(0, 1) for _ in parts], [r.random() < 0.2 for _ in parts]
        index = Suffixes(np.array(sum(parts, []), np.uint64), np.array([len(p) for p in parts]), np.array(block))
        size, hit = [], []
        for i, p in enumerate(parts):
            others = [longest(p, q) for j, q in enumerate(parts) if j != i and block[j] == block[i]]
            best = [max(x) for x in zip([0] * len(p), *others)]
            size += best
            hit += [k + window <= len(p) and (whole[i] or n >= window) for k, n in enumerate(best)]
        assert index.longest_at(np.arange(len(size))).tolist() == size
        assert factored(index, np.array(whole), window).tolist() == hit
        lo = [r.randint(0, 2) for _ in parts]
        hi = [x + r.randint(0, 1) for x in lo]
        homes = {}
        for p, b, x, y in zip(parts, block, lo, hi):
            for k in range(len(p) - window + 1):
                homes.setdefault((b, *p[k : k + window]), set()).update((x, y))
        want = [k + window <= len(p) and len(homes[b, *p[k : k + window]]) > 1 for p, b in zip(parts, block) for k in range(len(p))]
        assert across(index, np.array(lo), np.array(hi), window).tolist() == want
        data, times = np.array(sum(parts, []), np.uint8) + np.uint8(1), np.array([r.randint(1, 2) for _ in parts])
        count = Counter()
        for p, t in zip(parts, times.tolist()):
            for k in range(len(p) - window + 1):
                count[tuple(p[k : k + window])] += t
        want = [k + window <= len(p) and count[tuple(p[k : k + window])] > 1 for p in parts for k in range(len(p))]
        index = Suffixes(data, np.array([len(p) for p in parts]))
        assert twice(index, times, window).tolist() == want
        tails = [p[k:] for p in parts for k in range(len(p))]
        assert [tails[x] for x in index.order] == sorted(tails)


@pytest.mark.parametrize(("window", "gram", "limit", "batches"), [(200, 50, 4096, 4), (40, 10, 1, 3), (20, 20, 2, 1)])
def test_suffix_dedup(spark, docs, window, gram, limit, batches):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = []
    for (i, u), h in zip(rows, brute_cover([u for _, u in rows], window)):
        spans = sum(x and not y for x, y in zip(h, [False, *h]))
        want.append((i, len(u), sum(h), spans, bytes(b for b, x in zip(u, h) if not x)))
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in op8.suffix_dedup(spark, docs, window, gram, batches, limit).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_index_family_takes_batches(spark, docs, tmp_path, monkeypatch):
    """Batches into a family that is opened again between them: shared keys, levels, and the result over all batches."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(op8, "PIECE", 5)
    spec, folder = repeats.Spec(40, 10, "bytes"), "file://" + str(tmp_path / "family")
    own = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    parts = [own.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == b) for b in range(5)]
    seen = Counter()
    for b, part in enumerate(parts):
        new = Counter(r.ah for r in repeats.entries(part, spec).collect())
        got = [r.ah for r in op8.IndexFamily(spark, folder, spec).add(part).collect()]
        assert sorted(got) == sorted(k for k, n in new.items() if n > 1 or k in seen), b
        seen.update(new)
    family = op8.IndexFamily(spark, folder, spec)
    assert sorted(family.levels) == [0, 2] and family.state["batches"] == 5
    rows = [row for level in family.levels.values() for uri in level.values() for piece in op8._pieces(uri) for row in zip(*(piece[c].tolist() for c in ("ah", "ph", "n")))]
    count = Counter()
    for ah, _, n in rows:
        count[ah] += n
    assert count == seen
    for level in family.levels.values():
        for uri in level.values():
            keys = [row for piece in op8._pieces(uri) for row in zip(piece["ah"].tolist(), piece["ph"].tolist())]
            assert keys == sorted(set(keys))
    found = op8.spans_of(family, docs, str(tmp_path / "work")).collect()
    want = brute_cover([(r.text or "").encode() for r in found], 40)
    for r, hit in zip(found, want):
        assert sum(x.length for x in r.spans) == sum(hit) and all(all(hit[x.start : x.start + x.length]) for x in r.spans)
    with pytest.raises(ValueError):
        op8.IndexFamily(spark, folder, repeats.Spec(41, 10, "bytes"))
    assert op8.IndexFamily(spark, folder + "-none", spec).add(own.limit(0)).count() == 0


def test_sorted_files_merge_in_pieces():
    rng = random.Random(2)
    for _ in range(60):
        lists = [sorted({(rng.randint(-9, 9), rng.randint(0, 3)): rng.randint(1, 3) for _ in range(rng.randint(0, 25))}.items()) for _ in range(rng.randint(1, 4))]

        def pieces(rows: list):
            while rows:
                n = rng.randint(1, 6)
                part, rows = rows[:n], rows[n:]
                yield {"ah": np.array([k[0] for k, _ in part]), "ph": np.array([k[1] for k, _ in part]), "n": np.array([n for _, n in part])}

        got, count = [], Counter()
        for rows, source in op8.merged([pieces(x) for x in lists]):
            keys = list(zip(rows["ah"].tolist(), rows["ph"].tolist()))
            assert not got or got[-1] < keys[0]  # equal keys are never in two pieces
            got += keys
            assert len(source) == len(keys)
            for k, n in zip(keys, rows["n"].tolist()):
                count[k] += n
        want = Counter()
        for x in lists:
            for k, n in x:
                want[k] += n
        assert got == sorted(k for x in lists for k, _ in x) and count == want


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_places_of_long_texts(monkeypatch, kind):
    monkeypatch.setattr(repeats, "SEGMENT", 64)
    monkeypatch.setattr(repeats, "BLOCK", 32)
    monkeypatch.setattr(repeats, "POS_BITS", 8)
    rng = np.random.default_rng(3)
    text = " ".join(f"w{v}" for v in rng.integers(0, 9, 700))
    spec = repeats.Spec(12, 4, kind)
    s = repeats.symbols(text, kind)
    grams, seen = repeats.window_hashes(s, 4), []
    rows = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["doc_id", "th", "text"])
    for batch in repeats._entries(spec, iter([rows])):
        for x in batch.to_pylist():
            start, wins, off = x["pack"] >> 24, x["pack"] >> 12 & 4095, x["pack"] & 4095
            if kind == "bytes":  # first four bytes, then the hash
                data = np.frombuffer(text.encode(), np.uint8)
                assert repeats.alphabetical(grams[[start + off]], data, np.array([start + off])).tolist() == [x["ah"]]
                assert x["ah"] + (1 << 63) >> 32 == int.from_bytes(text.encode()[start + off : start + off + 4])
            else:
                assert grams.view(np.int64)[start + off] == x["ah"]
            seen += range(start, start + wins)
    assert seen == list(range(len(s) - 11))


def brute_simhash(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints: list[tuple], radius: int) -> list:
    label = [i for i, _ in prints]
    low = [10**9 if i is None else i for i, _ in prints]
    changed = True
    while changed:
        changed = False
        for a in range(len(prints)):
            for b in range(len(prints)):
                if (prints[a][1] ^ prints[b][1]).bit_count() <= radius and low[b] > low[a]:
                    low[b], changed = low[a], True
    return [None if x == 10**9 else x for x in low], label


@pytest.mark.parametrize(("radius", "limit"), [(2, 512), (2, 1), (1, 512), (1, 1)])
def test_simhash(spark, docs, radius, limit):
    rows = [(r.doc_id, brute_simhash(r.text)) for r in docs.collect()]
    low, ids = brute_components(rows, radius)
    want = sorted(str((i, f, c)) for i, (_, f), c in zip(ids, rows, low))
    assert sorted(str((r.doc_id, r.fp % (1 << 64), r.component_id)) for r in op1.near_duplicates(spark, docs, radius=radius, bucket_limit=limit).collect()) == want
    assert op1.deduplicated(spark, docs).columns == docs.columns
    assert op1.deduplicated(spark, docs).count() == len({str(c) for c in brute_components(rows, 2)[0]})


def test_one_row_a_component(spark):
    texts = [" ".join(f"{a}{k}" for k in range(40)) for a in "pqrst"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (7, texts[3]), (None, texts[4]), (9, texts[4])]
    got = [tuple(r) for r in op1.deduplicated(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (9, texts[4])]))


def test_near_copies_go(spark):
    import corpus_pipeline

    rng, texts = np.random.default_rng(8), [None, "", "one two", "One  two", "one three"]
    for k, changes in [(100, 1), (100, 2), (300, 3), (300, 5), (300, 7), (300, 30), (1000, 10), (60, 1), (60, 3)] * 3:
        words = [f"w{v}" for v in rng.integers(0, 3000, k)]
        texts.append(" ".join(words))
        for _ in range(4):
            copy = list(words)
            for place in rng.choice(k, changes, replace=False):
                copy[place] = f"x{rng.integers(0, 3000)}"
            texts.append(" ".join(copy))
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))})
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    low, changed = list(range(len(sets))), True
    while changed:
        changed = False
        for a, b in near:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.near_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low))


def test_near_dedup_links_fingerprints_and_shingles(spark):
    """Components of both kinds of links, and of chains that change kind."""
    import corpus_pipeline

    def words(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    texts = [words("plain", 50)]
    for c in "abc":  # the second has the first's fingerprint, the third the second's shingles
        line = words(f"{c}line", 31) + " "
        texts += [line * 200 + words(f"{c}one", 40), line * 200 + words(f"{c}two", 40), line * 2 + words(f"{c}two", 40)]
    texts += [words("one", 60), words("one", 60) + " more", "two words", None, " ", "other words"]
    sets = []
    for t in texts:
        w = (t or "").split()
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))})
    fps = [brute_simhash(t) for t in texts]
    n = len(texts)
    bits = {(a, b) for a in range(n) for b in range(a) if (fps[a] ^ fps[b]).bit_count() <= 2}
    alike = {(a, b) for a in range(n) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert {(2, 1), (5, 4), (8, 7)} <= bits - alike and {(3, 2), (6, 5), (9, 8)} <= alike - bits
    low = list(range(n))
    for _ in range(n):
        for a, b in bits | alike:
            low[a] = low[b] = min(low[a], low[b])
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, rows, SF).collect()) == sorted(set(low))


@pytest.mark.parametrize("limit", [512, 1])
def test_near_fingerprints_link(spark, tmp_path, limit):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 62, 12)]
    values = {x ^ (1 << int(a)) ^ (1 << int(b)) for x in base for a, b in rng.integers(0, 63, (9, 2))} | set(base)
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    from frameloom.llm.components import components

    got = {r.node: r.root for r in components(spark, op1.links(fps, str(tmp_path / "l"), 2, limit), str(tmp_path / "c")).collect()}
    prints = sorted((v, v) for v in values)
    low = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a, _ in prints:
            for b, _ in prints:
                if (a ^ b).bit_count() <= 2 and low[b] > low[a]:
                    low[b], changed = low[a], True
    assert {v: got.get(v, v) for v in values} == low


def test_masks_cover_every_pair():
    found = [m % (1 << 64) for m in op1.masks()]
    assert len(found) == 7
    for a in range(64):
        for b in range(64):
            assert any(not (m >> a & 1 or m >> b & 1) for m in found)


def test_language(spark, docs):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    by = {r.doc_id: r for r in real.collect()}
    got = entry.queries()["op3_language_id"](spark, SF).collect()
    assert len(got) == len(by) and all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r.lang_pred == by[r.doc_id].lang for r in got if r.held_out]
    assert sum(held) / len(held) > 0.97
    odd = {r.doc_id: r for r in op3.identified(spark, docs).collect()}
    assert all((odd[r.doc_id].lang_pred == "und") == (not any(c.isalpha() for c in r.text or "")) for r in docs.collect())
    nothing = op3.identified(spark, docs.withColumn("lang", docs.lang.substr(5, 1)).where("lang is null")).collect()
    assert {r.lang_pred for r in nothing} == {"und"} and {r.score for r in nothing} == {0.0}
    model = op3.learned(real)
    kept = op3.accepted(spark, docs, model)
    assert kept.columns == docs.columns and kept.where("text is null or text = ''").count() == 0


def cuts(word: str, pieces: dict[str, int]) -> list[list[str]]:
    """All segmentations; a letter that is no piece may stand alone, as a piece outside the vocabulary."""
    if not word:
        return [[]]
    heads = [word[:n] for n in range(1, len(word) + 1) if word[:n] in pieces or n == 1]
    return [[h, *rest] for h in heads for rest in cuts(word[len(h) :], pieces)]


def brute_word(word: str, pieces: dict[str, int], prob: list[float]) -> float:
    return sum(np.prod([prob[pieces[p]] if p in pieces else op3.UNKNOWN for p in c]) for c in cuts(op3.MARK + word, pieces))


def test_forward_sums_all_segmentations():
    table = {"▁": 0.1, "▁a": 0.2, "a": 0.3, "b": 0.4, "ab": 0.05, "▁ab": 0.01}
    index = {p: i for i, p in enumerate(table)}
    model = op3.Model(["l"], index, np.array([list(table.values())]))
    want = 0.1 * 0.3 * 0.4 + 0.1 * 0.05 + 0.2 * 0.4 + 0.01
    assert np.exp(model.forward(["ab", "ac", "ab"]))[:, 0] == pytest.approx([want, (0.1 * 0.3 + 0.2) * op3.UNKNOWN, want])
    none = op3.Model(["l"], {}, np.zeros((1, 0)))
    assert np.exp(none.forward(["ab"]))[0, 0] == pytest.approx(op3.UNKNOWN**3)


def test_training_counts_all_segmentations():
    rng = random.Random(4)
    index = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba", "▁ab", "aba", "c"])}
    counts = [(lang, "".join(rng.choice("abcd") for _ in range(rng.randint(1, 6))), rng.randint(1, 5)) for lang in ("x", "y") for _ in range(12)]
    counts = [(*k, n) for k, n in Counter({(a, w): n for a, w, n in counts}).items()]
    prob = [[1 / len(index)] * len(index) for _ in "xy"]
    for _ in range(3):
        got = np.zeros((2, len(index)))
        for lang, word, n in counts:
            k = "xy".index(lang)
            for c in cuts(op3.MARK + word, index):
                share = np.prod([prob[k][index[p]] if p in index else op3.UNKNOWN for p in c]) / brute_word(word, index, prob[k])
                for p in c:
                    if p in index:
                        got[k, index[p]] += n * share
        shared = got.sum(0) + 1
        prob = (got + op3.BACK * shared / shared.sum()) / (got.sum(1, keepdims=True) + op3.BACK)
    for at_once in (50_000, 5):
        assert op3.trained(counts, index, at_once=at_once).prob == pytest.approx(np.array(prob))


def test_words_are_of_letters():
    assert op3.words("½ ② Ⅷ 12 a1b") == ["a", "b"]
    assert op3.words("नमस्ते สวัสดี É ́x") == ["नमस्ते", "สวัสดี", "é", "x"]


def test_language_against_brute_force(spark):
    """The whole query on a small table: fold, training, scores."""
    texts = {"en": ["the hat, the that", "at THE 3 ½ hats", "he is that"], "de": ["die das der", "das ist die", "der Hut ist das"]}
    rows = [(i, texts[lang][i % 3] + " " + extra, lang) for i in range(40) for lang, extra in [(("en", "de")[i % 2], "ein " * (i % 3))]]
    rows += [(100, None, "en"), (101, "½ ② 12", "en"), (102, "x" * 130 + " das", None), (103, "", "de"), (None, "die das", "fr"), rows[0], rows[0]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    index = op3.pieces(op3.default_vocabulary())
    seen, counts = set(), Counter()
    for i, text, lang in rows:
        if lang and text is not None and i is not None and zlib.crc32(str(i).encode()) % 4 != 2 and (i, text) not in seen:
            seen.add((i, text))
            counts.update((lang, w) for w in op3.words(text))
    model = op3.trained([(*k, n) for k, n in counts.items()], index)
    assert model.names == ["de", "en"]
    got = Counter((r.doc_id, r.th, r.lang_pred, round(r.score, 9)) for r in op3.identified(spark, docs).collect())
    th = {r.text: r.th for r in docs.selectExpr("text", "xxhash64(text) as th").collect()}
    want = Counter()
    for i, text, _ in rows:
        found = [p for w in op3.words(text or "") for p in op3.parts(w)]
        if not found:
            want[i, th[text], "und", 0.0] += 1
            continue
        logs = np.array([sum(np.log(max(brute_word(w, index, p), 1e-300)) if len(w) < 12 else model.forward([w])[0, k] for w in found) for k, p in enumerate(model.prob)])
        best = int(logs.argmax())
        want[i, th[text], model.names[best], round(float(1 / np.exp(np.maximum(logs - logs[best], -700)).sum()), 9)] += 1
    assert got == want


def test_sample_is_bounded(spark):
    from frameloom.llm.common import sampled

    rows = spark.range(3000).selectExpr("id % 700 as doc_id", "concat('t', id % 700) as text", "if(id % 10 = 0, 'x', 'y') as by")
    got = Counter((r.by, r.text) for r in sampled(rows, 50).collect())
    by = Counter(by for by, _ in got)
    assert set(got.values()) == {1} and 5 <= by["x"] <= 50 and 5 <= by["y"] <= 50
    assert got == Counter((r.by, r.text) for r in sampled(rows.repartition(7), 50).collect())
    assert sampled(rows.limit(0), 50).count() == 0 and sampled(rows.where("doc_id < 20"), 50).where("by = 'y'").count() == 18


def test_mixing(spark, docs):
    rows = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in docs.collect()]
    size = Counter()
    for _, s, n in rows:
        size[s] += n
    names = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, target = set(), {}
    while True:
        free = [s for s in names if s not in capped]
        left = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3.0 * size[s] if s in capped else left * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    got = op4.copies(spark, docs).collect()
    assert sorted(map(str, ((r.doc_id, r.source, r["size"]) for r in got))) == sorted(map(str, rows))
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source]) and 0 <= r.copies <= 3
    assert sorted(map(str, got)) == sorted(map(str, op4.copies(spark, docs.repartition(7)).collect()))
    drawn = op4.mixed(spark, docs)
    assert drawn.columns == docs.columns and drawn.count() == sum(r.copies for r in got)
    taken, count = Counter((r.doc_id, r.text) for r in drawn.collect()), Counter()
    for r in got:
        count[r.doc_id] += r.copies
    ids = Counter()
    for (i, _), n in taken.items():
        ids[i] += n
    assert ids == +count


def test_chat_round_trip(spark):
    texts = ["", "plain", "<|im_end|>", "<\\|im_end|>", "a<|im_start|>b\n<|im_end|>\n", "<<|im_end|>", "<|im_end|<|im_end|>", "\\<|im_end|>|>", "é\n\n日本"]
    for role in ("user", "", "a\nb", "x\\n", "<|im_end|>"):
        for text in texts:
            out = op5.render_turn(role, text)
            assert [t[:2] for t in op5.parse(out)] == [(role, text)]
            assert text in out or "im_" in text
    assert op5.parse("<|im_start|>user\nhi") is None
    rows = spark.createDataFrame([(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 1, None, None), (2, None, "assistant", "<|im_end|>")], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in op5.read_back(op5.formatted_turns(rows)).collect()}
    assert got[1].n_turns == 4 and got[1].loss_chars == 2 and got[1].loss_sha256 == hashlib.sha256(b"bb").hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256(b"user\na\n\n\nassistant\nb\nassistant\nb\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"<|im_end|>").hexdigest()
    assert op5.read_back(op5.formatted_turns(rows.limit(0))).count() == 0


@pytest.mark.parametrize("block", [100_000, 20])
def test_decontamination(spark, docs, block):
    text = {r.doc_id: r.text for r in docs.collect()}
    items = [(1, text[0]), (2, "a"), (3, None), (4, "!!"), (5, "Alpha, beta"), (5, text[60 + 8]), (None, "日本")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def words(t):
        return re.findall(rb"[0-9a-z\x80-\xff]+", (t or "").encode().lower())

    for r in op6.judged(op6.contamination(spark, docs, bench, block_words=block)).collect():
        w, hit, names = words(text.get(r.doc_id)), set(), set()
        if r.doc_id is None:
            continue
        for name, t in items:
            item = words(t)
            n = min(13, len(item))
            grams = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
            for p in range(len(w) - n + 1 if n else 0):
                if tuple(w[p : p + n]) in grams:
                    hit |= set(range(p, p + n))
                    names.add("" if name is None else str(name))
        assert (r.n_words, r.n_hit, r["items"]) == (len(w), len(hit), sorted(names))
        assert r.contaminated == (len(hit) > 0 and 20 * len(hit) >= len(w))
    kept = op6.clean(spark, docs, bench, block_words=block)
    assert kept.columns == docs.columns
    assert op6.contamination(spark, docs, bench.limit(0)).where("size(items) > 0").count() == 0


def test_media(spark, docs, tmp_path):
    rows, media = op7.stored(spark, docs, "file://" + str(tmp_path / "m"))
    column = op7.media_column(rows, media).collect()
    assert len(column) == docs.count() and all(r.width * r.height % 64 == 0 and r.depth == 8 for r in column)
    read = {bytes(r.digest): r for r in op7.features(media).collect()}
    assert sorted(b.hex() for b in read) == sorted({hashlib.sha256(op7.payload_of((r.text or "").encode())).hexdigest() for r in docs.collect()})
    assert all(r.payload_sha256 == d.hex() for d, r in read.items())
    for size in (64, 128, 6400, (1 << 20) + 64):
        payload = os.urandom(size)
        assert op7.from_png(op7.to_png(payload)) == payload


def test_html(spark):
    page = "<html><head><title>t</title></head><body><nav>menu</nav><div class='cookie-notice'>ok?</div><article><header><h1>Head&amp;line</h1></header><p>One <b>two</b><br>three<p>four &lt;x&gt;<div class=ad>buy</div><script>var a='</p>'</script><ul><li>five<li>six</ul><form>f</form><section id=comments><p>nice!</p></section></article><aside>side</aside><footer>&copy;</footer>"
    foot = "<div>all rights reserved by this host since the first day of its life</div>"
    rows = [(1, "http://h.org/1", page), (2, "http://h.org/2", f"<p>unique text of page two</p>{foot}"), (3, "http://h.org/3", f"<p>another unique text</p>{foot}"), (4, "http://other.org/", foot), (5, None, None), (6, "x", ""), (2, "http://h.org/2", f"<p>unique text of page two</p>{foot}")]
    got = sorted((r.page_id, r.text) for r in op9.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect())
    line = "all rights reserved by this host since the first day of its life"
    assert got == [(1, "Head&line\n\nOne two three\n\nfour <x>\n\nfive\n\nsix"), (2, "unique text of page two"), (2, "unique text of page two"), (3, "another unique text"), (4, line), (5, ""), (6, "")]


def test_html_cuts_only_repeats(spark):
    notice = "this notice stands on each page of the host since its start"
    own = "twelve words of one page alone that no other page of it says"
    some = "a page crawled twice under two ids is still one page of its host"
    rows = [(1, "http://h.org/1", f"<p>{own} {notice}</p>"), (2, "http://h.org/2", f"<p>{notice}</p><p>more</p>"), (3, "http://h.org/3", f"<p>ahead {notice} behind</p>"), (4, "http://h.org/4", f"<p>{some}</p>"), (5, "http://h.org/5", f"<p>{some}</p>"), (6, "http://i.org/", f"<p>{some}</p>"), (None, "http://h.org/4", f"<p>{some}</p>")]
    got = {r.page_id: r.text for r in op9.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: own, 2: "more", 3: "ahead behind", 4: some, 5: some, 6: some, None: some}


def test_elements_decide():
    def kept(page: str) -> list[str]:
        return [text for kind, text in op9.blocks(page) if kind == "text"]

    page = '<article><p>One <a class="share">tell <a>your</a> friends</a> two.<p>Three <span hidden>x <span>y</span> z</span>four <b hidden>b<div>in</div></b><p>five</article>'
    assert kept(page) == ["One tell your friends two.", "Three four", "five"]
    page = '<article><h2 id="search-results">A</h2><p id="notice">B</p><section id="related-work"><p>C</section><div class="share-price">D</div><p class="footer-note">E</p><div id="menu-of-the-day">F</div>'
    assert kept(page) == list("ABCDEF")
    assert kept("<main><p>so <math><mi>y</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> holds</main>") == ["so y=2 holds"]
    page = '<main><article><header>H</header><p>x<button>go</button>y</p><article><p>a comment</article><section class="comments"><p>more</section><div id=comments>z</div><aside>s</aside><footer>f</footer></article></main>'
    assert kept(page) == ["H", "xy"]
    assert kept('<article><article><p>first</article><div class="ad">buy</div><div class="ad-hoc">stays</div>') == ["first", "stays"]


def test_host_arrays_against_brute_force(spark):
    rng = random.Random(6)
    rows, window = [], 8
    standing = [[f"s{i}-{k}" for k in range(rng.randint(6, 14))] for i in range(4)]
    for i in range(60):
        host, made_ = f"h{i % 3}.org", []
        for _ in range(rng.randint(0, 5)):
            words = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(0, 9))]
            if rng.random() < 0.6:
                words += rng.choice(standing)[rng.randint(0, 2) :] + [f"u{rng.randint(0, 90)}" for _ in range(rng.randint(0, 4))]
            made_.append((rng.choice(["p", "div", "nav", "footer"]), words))
        main = [f"m{i}"] * rng.choice([0, 0, 0, 3, 500])
        page = "".join(f"<{tag}>{' '.join(words)}</{tag}>" for tag, words in made_) + f"<article><p>{' '.join(main)}</p></article>"
        rows.append((i, f"https://{host}/{i}", page))
    rows += [(60, "https://h0.org/again", rows[0][2]), rows[1], (61, "https://h1.org/other", rows[0][2])]
    found = {page: op9.blocks(page) for _, _, page in rows}

    def stream(page: str) -> list[str]:
        return [t for kind, text in found[page] if kind != "text" for t in text.split()]

    homes = {}
    for _, url, page in rows:
        words = stream(page)
        for a in range(len(words) - window + 1):
            homes.setdefault((op9.host_of(url), *words[a : a + window]), set()).add(page)
    want, cuts = [], 0
    for i, url, page in rows:
        words = stream(page)
        cut = [False] * len(words)
        for a in range(len(words) - window + 1):
            if len(homes[(op9.host_of(url), *words[a : a + window])]) > 1:
                cut[a : a + window] = [True] * window
        cuts += sum(cut)
        parts, at = [], 0
        for kind, text in found[page]:
            if kind == "text":
                parts.append((kind, text.split()))
                continue
            n = len(text.split())
            own = [w for w, x in zip(text.split(), cut[at : at + n]) if not x]
            at += n
            if kind == "open" and own:
                parts.append((kind, own))
        size = Counter()
        for kind, own in parts:
            size[kind] += len(own)
        want.append((i, "\n\n".join(" ".join(own) for kind, own in parts if kind == "text" or size["open"] > size["text"])))
    for limit in (4096, 1):
        got = [(r.page_id, r.text) for r in op9.main_text(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3), group_limit=limit).collect()]
        assert sorted(got) == sorted(want)
    assert cuts > 50  # there is something to cut


def test_html_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in entry.queries()["op9_html_text"](spark, SF).collect():
        body = pages[r.page_id].partition("<article>")[2].partition("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_tokens(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op10.default_vocabulary())
    want, at = [], 0
    rows = sorted(((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: x[0])
    got = sorted(op10.documents_of(*op10.written(spark, docs, "file://" + str(tmp_path / "t"))).collect(), key=lambda r: r.start)
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    assert [-1 if r.doc_id is None else r.doc_id for r in got] == [i for i, _ in rows]
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_pieces_equal_the_library():
    from tokenizers import Tokenizer

    path, rng = op10.default_vocabulary(), np.random.default_rng(2)
    t = Tokenizer.from_file(path)
    parts = ["a", " ", "\n", "\t", "é", "1", "!", "'s", "Foo", "\x1c", "  ", ".", "<|endoftext|>", "\r", "日", " ", ",", "##"]
    for _ in range(3000):
        text = "".join(rng.choice(parts, int(rng.integers(0, 10))))
        assert np.frombuffer(op10.serialized(text, path), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids, text


NAMES = ["__id", "__nth", "__rows", "__copies", "__th", "a.b", "row", "th", "n", "i", "by", "h", "root", "c0", "m`x", "runs", "fp"]


@pytest.mark.parametrize("how", ["rows", "empty"])
def test_clashing_columns(spark, how, tmp_path):
    """Every operator and stage over nulls, repeats and columns whose names the operators might use themselves."""
    import corpus_pipeline

    rows = [(*r[:5], *(f"{name}-{r[0]}" for name in NAMES)) for r in made(3, 30)] if how == "rows" else []
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` string" for n in NAMES))
    bench = spark.createDataFrame([(1, "alpha gamma", "x")], "item_id long, text string, `a.b` string")
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    docs, plain = docs.coalesce(1), plain.coalesce(1)
    for f in (lambda d: op1.near_duplicates(spark, d), lambda d: op2.substring_dedup(spark, d), lambda d: op3.identified(spark, d), lambda d: op4.copies(spark, d), lambda d: op6.contamination(spark, d, bench), lambda d: op8.suffix_dedup(spark, d)):
        got = Counter(map(repr, f(docs).collect()))
        assert got.total() == len(rows) and (how == "empty" or got == Counter(map(repr, f(plain).collect())))
    rest, media = op7.stored(spark, docs, "file://" + str(tmp_path / "m"))
    assert op7.media_column(rest, media).count() == len(rows) and op7.features(media).count() == media.count()
    assert op10.documents_of(*op10.written(spark, docs, "file://" + str(tmp_path / "t"))).count() == len(rows)
    for name, stage in [*corpus_pipeline.STAGES[:-1], ("simhash", lambda s, d, _: op1.deduplicated(s, d))]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        got = Counter(map(repr, map(tuple, out.collect())))
        assert set(got) <= set(map(repr, map(tuple, docs.collect()))), name
        assert (len(got) > 5) == (how == "rows"), name
    assert corpus_pipeline.tokens(spark, docs, SF).count() == len(rows)


def test_shared_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace as Space

    from frameloom.llm.common import shared_root

    conf = Space(get=lambda *_: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Space(conf=conf, sparkContext=Space(getConf=lambda: conf, master="spark://host:7077")))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_root(Space(conf=conf, sparkContext=Space(getConf=lambda: conf, master="local-cluster[2,1,1024]")))


def test_copies_never_exceed_the_cap(spark):
    rows = spark.range(4).selectExpr("explode(array(0, 699049, 699050, 4294967295, 4294967296, 20000000001)) as n").distinct()
    from pyspark.sql import functions as F

    for each in (3 << 32, 0, 1, (1 << 32) - 1, 123456789012):
        for u in (0, 1, (1 << 32) - 1):
            for r in rows.select("n", op4.crossings(F.col("n"), F.lit(each), F.lit(u)).alias("k")).collect():
                assert r.k == ((r.n + 1) * each + u >> 32) - (r.n * each + u >> 32)


def test_repeats_share_copies_over_tasks(spark):
    rows = spark.range(900).selectExpr("1L as doc_id", "'a b c' as text", "'s' as source", "id as other").unionByName(spark.range(50).selectExpr("id + 2 as doc_id", "concat('x ', id) as text", "if(id < 25, 's', 't') as source", "0L as other"))
    drawn = op4.mixed(spark, rows.repartition(5))
    assert drawn.count() == op4.copies(spark, rows).selectExpr("sum(copies)").first()[0]
    times = Counter(Counter(r.other for r in drawn.where("doc_id = 1").collect()).values())
    assert len(times) <= 2


def test_chat_streams_cross_pieces():
    turns = [("user", "a"), ("assistant", "<|im_end|>\n"), ("", ""), ("x\ny", "<|im_start|>user\nb<|im_end|>")]
    whole, rng = "".join(op5.render_turn(*t) for t in turns), random.Random(1)
    for _ in range(50):
        stream, got, at = op5.Stream(), [], 0
        while at < len(whole):
            n = rng.randint(1, 30)
            got += stream.feed(whole[at : at + n])
            at += n
        stream.close()
        assert [t[:2] for t in got] == turns and all(op5._unescape(whole[a:b]) == text for _, text, a, b in got)
    stream = op5.Stream()
    stream.feed("<|im_start|>user\nhi")
    with pytest.raises(ValueError):
        stream.close()


def test_shards_roll(spark, docs, tmp_path):
    rows, media = op7.stored(spark, docs, "file://" + str(tmp_path / "m"), 4096, 7)
    want = sorted((str(r.doc_id), hashlib.sha256(op7.payload_of((r.text or "").encode())).hexdigest(), len((r.text or "").encode())) for r in docs.collect())
    assert sorted((str(r.doc_id), bytes(r.digest).hex(), r.n_bytes) for r in rows.collect()) == want
    shards = {r.shard for r in media.collect()}
    assert len(shards) > 6 and media.count() == len({w[1] for w in want})
    for r in op7.features(media).collect():
        texts = {op7.payload_of((d.text or "").encode()) for d in docs.collect()}
        payload = next(p for p in texts if hashlib.sha256(p).digest() == bytes(r.digest))
        x = np.frombuffer(payload, np.uint8)
        assert (r.payload_bytes, r.tail_crc32, r.width * r.height) == (len(payload), zlib.crc32(payload[-64:]), len(payload))
        assert r.feature == f"{len(x)} samples min={x.min()} max={x.max()} sum={x.sum(dtype=np.int64)}"


def test_small_samples_make_a_dictionary(spark):
    path = op10.default_vocabulary()
    docs = spark.createDataFrame([(1, "one two three"), (1, "one two three"), (2, "four")], "doc_id long, text string")
    small = op10.trained_dictionary(docs, path)
    assert small and small == op10.trained_dictionary(docs.repartition(3), path)
    assert op10.trained_dictionary(docs.limit(0), path) == b""


def test_empty_tables(spark, empty, tmp_path):
    bench = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert op1.near_duplicates(spark, empty).count() == 0 and op1.deduplicated(spark, empty).count() == 0
    assert op2.substring_dedup(spark, empty).count() == 0
    assert op3.identified(spark, empty).count() == 0
    assert op4.copies(spark, empty).count() == 0 and op4.mixed(spark, empty).count() == 0
    assert op6.contamination(spark, empty, bench).count() == 0
    assert op7.stored(spark, empty, "file://" + str(tmp_path / "m"))[1].count() == 0
    assert op8.suffix_dedup(spark, empty).count() == 0
    assert op9.main_text(spark, spark.createDataFrame([], "page_id long, url string, html string, `a.b` string, kinds int")).count() == 0
    assert op10.documents_of(*op10.written(spark, empty, "file://" + str(tmp_path / "t"))).count() == 0


def simple_score(found: list[str], model) -> tuple[str, float]:
    """Language and score of a text's words, letter by letter."""
    logs = []
    for prob in model.prob.tolist():
        total = 0.0
        for word in (p for w in found for p in op3.parts(w)):
            text, ways = op3.MARK + word, [1.0] + [0.0] * (len(word) + 1)
            for b in range(1, len(text) + 1):
                for a in range(max(0, b - 40), b):
                    piece = text[a:b]
                    ways[b] += ways[a] * (prob[model.index[piece]] if piece in model.index else op3.UNKNOWN if b == a + 1 else 0.0)
            total += np.log(max(ways[-1], 1e-300))
        logs.append(total)
    best = int(np.argmax(logs))
    return model.names[best], float(1 / np.exp(np.maximum(np.array(logs) - logs[best], -700)).sum())


def test_pipeline_against_brute_force(spark):
    """Every row of the pipeline from the tables alone; only the language model's numbers are the operator's."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = op3.learned(table)
    docs = [r for r in table.collect() if (w := op3.words(r.text or "")) and simple_score(w, model)[1] >= 0.5]
    assert {r.doc_id for r in docs} == {r.doc_id for r in op3.accepted(spark, table, model).collect()}
    sets = []
    for r in docs:
        w = (r.text or "").encode().lower().split()
        sets.append({tuple(w[p : p + 5]) for p in range(max(1, len(w) - 4))})
    low, changed = [r.doc_id for r in docs], True
    near = [(a, b) for a in range(len(sets)) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in near:
            if low[a] != low[b]:
                low[a] = low[b] = min(low[a], low[b])
                changed = True
    docs = [r for r, least in zip(docs, low) if r.doc_id == least]

    def normal(text: str | None) -> list[bytes]:
        return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().lower())

    items = [normal(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(i[a : a + min(13, len(i))]) for i in items if i for a in range(max(1, len(i) - 12))}
    clean = []
    for r in docs:
        w, hit = normal(r.text), set()
        for n in {len(x) for x in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a : a + n]) in windows:
                    hit |= set(range(a, a + n))
        if not hit or 20 * len(hit) < len(w):
            clean.append(r)
    size = {r.doc_id: len((r.text or "").encode().split()) for r in clean}
    total = Counter()
    for r in clean:
        total[r.source] += size[r.doc_id]
    names = sorted(s for s in total if s is not None) + [None] * (None in total)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped = set()
    while True:
        level = (sum(total.values()) - sum(3 * total[s] for s in capped)) / max(1, sum(weight[s] for s in names if s not in capped))
        over = {s for s in names if s not in capped and level * weight[s] > 3 * total[s]}
        if not over:
            break
        capped |= over
    mixed = []
    for s in names:
        target = 3.0 * total[s] if s in capped else min(level * weight[s], 3.0 * total[s])
        each = int(target / total[s] * 2**32) if total[s] else 0
        offset = int(hashlib.md5(("mix" + ("-" if s is None else "+" + s)).encode()).hexdigest()[:8], 16)
        for n, r in enumerate(sorted((r for r in clean if r.source == s), key=lambda r: (size[r.doc_id], r.doc_id))):
            mixed += [r] * (((n + 1) * each + offset >> 32) - (n * each + offset >> 32))
    t, at, want = Tokenizer.from_file(op10.default_vocabulary()), 0, []
    for r in sorted(mixed, key=lambda r: r.doc_id):
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((r.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want
