"""Language identification by segmentation-marginalised unigrams.

Text is lower-cased and read as words of letters, each led by the word mark of a fixed public vocabulary. A language gives
each vocabulary piece a probability; a word's probability is the sum over all ways to cut it into pieces of the product of
their probabilities, found by the forward algorithm. Pieces do not cross words, so a text's log probability is the sum over
its words, and a worker keeps the vectors of words it has met (at most ``CACHE``). The prediction is the language with the
largest log probability; its score is that language's share of the sum of probabilities under equal priors.

Training is expectation maximisation over all words of a bounded sample: at most ``sample_docs`` documents a language, those
of the least hash of id and text; no other bound holds, and every prediction reads the whole text. Only text and label of
documents whose crc32(doc_id) mod 4 is not 2 are learned from. The driver holds the sample's distinct words with their counts.

A word is a letter (Unicode category L) with the letters and marks (category M) after it; numerals such as fractions, Roman
numerals or circled digits are no letters. Words of over ``LONGEST`` characters are read in parts of that length, in training
and in prediction.

Defined results: null texts, empty texts and texts without a letter are ``und`` with score 0, as is everything if there is
nothing to learn from. Very long texts are read whole. Letters outside the vocabulary weigh the same in every language. Ties go
to the first language by name. Documents with a null id fall in no fold: they are not held out and nothing is learned from
them. Repeated rows are judged alike and enter the sample once. Extra columns of any name are ignored, and kept by
``accepted``; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frameloom.llm.common import filtered, kept_by_worker, sampled, slices
from frameloom.llm.repeats import mix

SAMPLE_DOCS, ROUNDS, CACHE, LONGEST, UNKNOWN, BACK, LEAST = 400, 3, 300_000, 48, 1e-7, 50.0, 0.5
MARK, FOLDS, HELD = "▁", 4, 2
_PIECE = regex.compile(r"[\p{L}\p{M}]+")
_WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@lru_cache(2)
def pieces(path: str) -> dict[str, int]:
    """The lower-case pieces of letters and marks, with or without the word mark."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    found = sorted({model.id_to_piece(i) for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))})
    return {p: i for i, p in enumerate(p for p in found if p.lower() == p and (p == MARK or _PIECE.fullmatch(p.removeprefix(MARK))))}


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def parts(word: str) -> list[str]:
    return [word[a : a + LONGEST] for a in range(0, len(word), LONGEST)]


class Vocabulary:
    """Finds the pieces that begin at every place of many words at once, by 64-bit hashes of growing prefixes."""

    def __init__(self, index: dict[str, int]) -> None:
        self.size, self.longest = len(index), max(map(len, index), default=1)
        whole = self._hashed(list(index))
        order = np.argsort(whole)
        self.whole, self.ids = whole[order], np.array(list(index.values()), np.int32)[order]
        self.starts = np.unique(self._hashed(sorted({p[:i] for p in index for i in range(1, len(p))})))

    @staticmethod
    def step(h: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The hash of a prefix with one letter more."""
        return mix(h ^ (letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))

    def _hashed(self, strings: list[str]) -> np.ndarray:
        letters, ends = _letters(strings)
        length = np.diff(ends, prepend=0)
        h = np.zeros(len(strings), np.uint64)
        for i in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > i)
            h[on] = self.step(h[on], letters[ends[on] - length[on] + i])
        return h

    @staticmethod
    def place(sorted_: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Where each hash stands, -1 if nowhere."""
        if not len(sorted_):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(sorted_, h), len(sorted_) - 1)
        return np.where(sorted_[at] == h, at, -1)


def _letters(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the strings one after another, and where each ends."""
    data = "".join(strings).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, "<u4").astype(np.uint64), np.cumsum(np.fromiter(map(len, strings), np.int64, len(strings)))


class Lattice:
    """All ways to cut some words into pieces, as arcs between places; sums over segmentations run over all words at once,
    one place after another. A letter that begins no piece of its own has an arc of probability UNKNOWN (piece ``size``)."""

    def __init__(self, found: list[str], vocabulary: Vocabulary) -> None:
        letters, ends = _letters([MARK + w for w in found])
        count = np.diff(ends, prepend=0)
        at = np.arange(len(letters))
        left = np.repeat(ends, count) - at  # letters to the word's end
        depth = np.repeat(count, count) - left
        node = at + np.repeat(np.arange(len(found)), count)  # a word has one place more than letters
        self.first, self.last, self.size = ends - count + np.arange(len(found)), ends + np.arange(len(found)), len(letters) + len(found)
        arcs, live, h = [], at, np.zeros(len(at), np.uint64)
        for n in range(1, vocabulary.longest + 1):
            on = np.flatnonzero(left[live] >= n)
            live = live[on]
            h = vocabulary.step(h[on], letters[live + n - 1])
            piece = vocabulary.place(vocabulary.whole, h)
            hit = piece >= 0
            ids = np.where(hit, vocabulary.ids[piece], vocabulary.size) if vocabulary.size else np.zeros(len(piece), np.int32)
            use = hit | (n == 1)
            arcs.append((depth[live[use]], node[live[use]], node[live[use]] + n, ids[use]))
            on = np.flatnonzero(vocabulary.place(vocabulary.starts, h) >= 0)
            live, h = live[on], h[on]
        step, *ends_ = (np.concatenate(x).astype(np.int32) for x in zip(*arcs, strict=True))
        order = np.argsort(step, kind="stable")
        cuts = np.flatnonzero(np.diff(step[order])) + 1
        self.steps = [tuple(x[part] for x in ends_) for part in np.split(order, cuts) if len(part)]

    def ahead(self, known: np.ndarray) -> np.ndarray:
        """For every place, by language, the sum over all ways from the word's start; known: by language and piece."""
        out = np.zeros((len(known), self.size))
        out[:, self.first] = 1.0
        for a, b, p in self.steps:
            for k, row in enumerate(out):
                np.add.at(row, b, row[a] * known[k, p])
        return out

    def expected(self, weight: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, by language; weight: counts of the words, by language."""
        ahead, got = self.ahead(known), np.zeros_like(known)
        for k, row in enumerate(ahead):
            behind, flows = np.zeros(self.size), np.zeros(self.size)
            behind[self.last] = 1.0
            flows[self.first] = weight[k] / np.maximum(row[self.last], 1e-300)
            scale = np.repeat(flows[self.first], self.last + 1 - self.first)
            for a, b, p in reversed(self.steps):
                flow = known[k, p] * behind[b]
                np.add.at(behind, a, flow)
                got[k] += np.bincount(p, row[a] * flow * scale[a], known.shape[1])
        return got


class Model:
    """Piece probabilities by language (prob: by language and piece), and the forward algorithm over them."""

    def __init__(self, names: list[str], index: dict[str, int], prob: np.ndarray) -> None:
        self.names, self.index, self.prob = names, index, prob
        self._vocabulary: Vocabulary | None = None

    def __getstate__(self):
        return self.__dict__ | {"_vocabulary": None}

    def forward(self, found: list[str]) -> np.ndarray:
        """log probability of words of at most LONGEST letters, by word and language."""
        self._vocabulary = self._vocabulary or Vocabulary(self.index)
        lattice = Lattice(found, self._vocabulary)
        return np.log(np.maximum(lattice.ahead(_known(self.prob))[:, lattice.last], 1e-300)).T


def _known(prob: np.ndarray) -> np.ndarray:
    """With the probability of a letter outside the vocabulary as the last piece."""
    return np.hstack([prob, np.full((len(prob), 1), UNKNOWN)])


def trained(counts: list[tuple[str, str, int]], index: dict[str, int], rounds: int = ROUNDS, at_once: int = 50_000) -> Model:
    """counts: (language, word, count)."""
    names = sorted({c[0] for c in counts})
    place, by_part = {name: i for i, name in enumerate(names)}, {}
    for name, word, n in sorted(counts):
        for part in parts(word):
            by_part.setdefault(part, [0.0] * len(names))[place[name]] += n
    found, weight, vocabulary = list(by_part), np.array(list(by_part.values())).reshape(len(by_part), len(names)).T, Vocabulary(index)
    prob = np.full((len(names), len(index)), 1.0 / max(1, len(index)))
    for _ in range(rounds if names else 0):
        got = sum(Lattice(found[a : a + at_once], vocabulary).expected(weight[:, a : a + at_once], _known(prob)) for a in range(0, len(found), at_once))[:, :-1]
        shared = got.sum(0) + 1.0
        prob = (got + BACK * shared / shared.sum()) / (got.sum(1, keepdims=True) + BACK)
    return Model(names, index, prob)


def fold():
    """crc32 of doc_id as text, mod FOLDS; null ids fall in none."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 16):
        langs, found = [], []
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            here = words(text or "")
            langs += [lang] * len(here)
            found += here
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.string())], ["lang", "word"])


def learned(docs: DataFrame, path: str | None = None, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model from the labelled documents outside the held-out fold."""
    own = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold() != HELD))
    some = sampled(own.select("doc_id", "text", F.col("lang").alias("by")), sample_docs).withColumnRenamed("by", "lang")
    rows = some.mapInArrow(_counted, "lang string, word string").groupBy("lang", "word").count().collect()
    return trained([tuple(r) for r in rows], pieces(path or default_vocabulary()))


class _Kept:
    """Vectors of the parts of words met so far."""

    def __init__(self, model: Model) -> None:
        self.model, self.rows, self.used = model, {}, 0
        self.vectors = np.zeros((1024, len(model.names)))

    def learn(self, found: list[str]) -> np.ndarray:
        """Keep the vectors of new parts, while there is room; returns all of them."""
        vectors = self.model.forward(found)
        room = max(0, min(len(found), CACHE - self.used))
        while self.used + room > len(self.vectors):
            self.vectors = np.concatenate([self.vectors, np.zeros_like(self.vectors)])
        self.vectors[self.used : self.used + room] = vectors[:room]
        self.rows.update(zip(found[:room], range(self.used, self.used + room)))
        self.used += room
        return vectors

    def totals(self, texts: list[list[str]]) -> np.ndarray:
        """For every text, given as its words, the log probability in each language."""
        texts = [[p for w in found for p in parts(w)] if any(len(w) > LONGEST for w in found) else found for found in texts]
        get = self.rows.get
        new = sorted({p for found in texts for p in found if p not in self.rows})
        fresh = {}
        if new:
            room, vectors = CACHE - self.used, self.learn(new)
            fresh = {p: i for i, p in enumerate(new) if i >= room}
        out = np.zeros((len(texts), len(self.model.names)))
        for i, found in enumerate(texts):
            rows = np.fromiter((get(p, -1) for p in found), np.int64, len(found))
            out[i] = self.vectors[rows[rows >= 0]].sum(0)
            if fresh:
                out[i] += vectors[[fresh[p] for p in found if p in fresh]].sum(0)
        return out


def _judge(kept: _Kept, texts: list[str | None]) -> tuple[list[str], list[float]]:
    names, scores = ["und"] * len(texts), [0.0] * len(texts)
    if kept.model.names:
        found = [words(text) if text else [] for text in texts]
        for i, total in enumerate(kept.totals(found)):
            if found[i]:
                best = int(total.argmax())
                names[i] = kept.model.names[best]
                scores[i] = float(1.0 / np.exp(np.maximum(total - total[best], -700)).sum())
    return names, scores


def predicted(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, th, lang_pred, score, one row a row of docs."""
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = kept_by_worker(key, lambda: _Kept(sent.value))
        for batch in slices(batches):
            names, scores = _judge(kept, batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "th", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(predict, "doc_id long, th long, lang_pred string, score double")


def accepted(spark: SparkSession, docs: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """The rows of docs with a predicted language whose score is at least ``least``; columns as in docs, no shuffle."""
    sent, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex

    def judge(texts: pa.ChunkedArray) -> list[bool]:
        names, scores = _judge(kept_by_worker(key, lambda: _Kept(sent.value)), texts.to_pylist())
        return [n != "und" and s >= least for n, s in zip(names, scores, strict=True)]

    return filtered(docs, judge)


def identified(spark: SparkSession, docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    return predicted(spark, docs, learned(docs, sample_docs=sample_docs))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.coalesce(fold() == HELD, F.lit(False)).alias("held_out"), "lang_pred", "score")
