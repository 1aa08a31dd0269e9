"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs (problem 10).

A sentence is the mean of its words' vectors, a word the mean of the vectors of itself and of its character n-grams, which
are hashed into a table of fixed size. Each area has its own logistic output. The labelled texts are parsed once into word
numbers and stand in shards, each cut into slices. Every training step is synchronous: all shards compute the gradient of
one slice at the same weights, the gradients are summed, and one update makes the next weights. Scoring reads every
sentence of every document.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallygrove.session import Stash

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?。！？]+(?=[\s\"')\]_]|$)|[\r\n]+")


@dataclass(frozen=True)
class Settings:
    """`labelled` bounds the documents that the model is fitted on: with more labels, those whose id hash falls into that share
    of the hash's range, so about that many; `shards` is the number of partitions that compute gradients side by side, so what
    a step sends to the driver is at most `shards` times the size of the weights. A sentence of fewer than `short` words counts
    as one of `short`, so that a stray word decides little. `share` is the part of a document's subject sentences that an area needs."""

    buckets: int = 1 << 16
    width: int = 16
    ngrams: tuple[int, ...] = (4, 5)
    labelled: int = 20_000
    shards: int = 6
    slices: int = 4
    steps: int = 44
    untangle: int = 14
    pace: float = 0.1
    short: int = 4
    certain: float = 0.5
    share: float = 0.19
    seed: int = 7


def sentences(text: str | None) -> list[list[str]]:
    """The words (letters only, lower case) of every sentence that has any."""
    if not text:
        return []
    parts = (_WORD.findall(s.lower()) for s in _SENTENCE.split(text))
    return [p for p in parts if p]


def word_features(word: str, s: Settings) -> list[int]:
    """Buckets of a word and its character n-grams."""
    marked = f"<{word}>"
    grams = {marked} | {marked[i : i + n] for n in s.ngrams for i in range(len(marked) - n + 1)}
    return [zlib.crc32(g.encode()) % s.buckets for g in sorted(grams)]


@dataclass
class Weights:
    rows: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    areas: list[str] = field(default_factory=list)

    @classmethod
    def fresh(cls, s: Settings, areas: list[str]) -> Weights:
        rng = np.random.default_rng(s.seed)
        rows = ((rng.random((s.buckets, s.width)) - 0.5) / s.width).astype(np.float32)
        return cls(rows, np.zeros((s.width, len(areas)), np.float32), np.full(len(areas), -2.0, np.float32), areas)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _sums(values: np.ndarray, index: np.ndarray, size: int) -> np.ndarray:
    """Sums of the rows of each index, of 0 to size - 1."""
    return np.stack([np.bincount(index, weights=values[:, j], minlength=size) for j in range(values.shape[1])], axis=1)


class Lexicon:
    """Numbers of words and the feature buckets of each."""

    def __init__(self, s: Settings):
        self.s, self.number, self.features = s, {}, []

    def of(self, word: str) -> int:
        got = self.number.get(word)
        if got is None:
            got = self.number[word] = len(self.features)
            self.features.append(word_features(word, self.s))
        return got

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.array([len(f) for f in self.features], dtype=np.int64)
        return np.concatenate([np.asarray(f, dtype=np.int64) for f in self.features]), np.r_[0, np.cumsum(sizes)]


@dataclass
class Slice:
    """Sentences as numbers: words of each sentence, buckets of each word, and the areas (document's labels) of each sentence."""

    sizes: np.ndarray
    words: np.ndarray
    counts: np.ndarray
    buckets: np.ndarray
    marks: np.ndarray
    areas: np.ndarray

    @classmethod
    def of(cls, docs: list[tuple[list[list[str]], list[int]]], s: Settings) -> Slice:
        lexicon = Lexicon(s)
        words, sizes, marks, areas = [], [], [], []
        for parts, own in docs:
            for p in parts:
                words += [lexicon.of(x) for x in p]
                sizes.append(len(p))
                marks.append(len(own))
                areas += own
        full = lambda x: np.asarray(x, dtype=np.int32)
        return cls(full(sizes), full(words), full([len(f) for f in lexicon.features]), full([b for f in lexicon.features for b in f]), full(marks), full(areas))

    def pack(self) -> list[bytes]:
        return [a.tobytes() for a in (self.sizes, self.words, self.counts, self.buckets, self.marks, self.areas)]

    @classmethod
    def unpack(cls, parts: list[bytes]) -> Slice:
        return cls(*[np.frombuffer(p, np.int32) for p in parts])

    def gradient(self, w: Weights, s: Settings, untangled: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Touched rows, their gradients, and those of outputs and biases, summed over the sentences."""
        target = np.zeros((len(self.sizes), len(w.areas)), np.float32)
        target[np.repeat(np.arange(len(self.sizes)), self.marks), self.areas] = 1.0
        starts = lambda n: np.cumsum(n) - n
        vec = np.add.reduceat(w.rows[self.buckets], starts(self.counts), axis=0) / self.counts[:, None]
        full = np.maximum(self.sizes, s.short).astype(np.float32)[:, None]
        hidden = np.add.reduceat(vec[self.words], starts(self.sizes), axis=0) / full
        p = _sigmoid(hidden @ w.out + w.bias)
        if untangled:
            # of a document with several areas, a sentence keeps those that it itself speaks for
            best = (p * target).max(axis=1, keepdims=True)
            target = np.where((target.sum(axis=1) > 1)[:, None] & (p < 0.5 * best), 0.0, target)
        gap = (p - target).astype(np.float32)
        per_word = _sums(np.repeat(gap @ w.out.T / full, self.sizes, axis=0), self.words, len(self.counts)) / self.counts[:, None]
        at, place = np.unique(self.buckets, return_inverse=True)
        rows = _sums(np.repeat(per_word, self.counts, axis=0), place, len(at))
        return at.astype(np.int32), rows.astype(np.float32), hidden.T @ gap, gap.sum(axis=0)


class Descent:
    """Weights moved by summed gradients, with running moments of each weight (adaptive moment estimation)."""

    def __init__(self, w: Weights, s: Settings):
        self.w, self.s, self.step = w, s, 0
        self.first, self.second = [[np.zeros_like(x) for x in (w.rows, w.out, w.bias)] for _ in range(2)]

    def move(self, gradients: list[tuple[np.ndarray, ...]], sentences_: int) -> None:
        self.step += 1
        rows = np.zeros_like(self.w.rows)
        for at, own, _, _ in gradients:
            rows[at] += own
        sums = [rows, sum(g[2] for g in gradients), sum(g[3] for g in gradients)]
        pace = self.s.pace * (1 - 0.8 * self.step / (self.s.steps + 1))
        moved = []
        for x, g, m, v in zip((self.w.rows, self.w.out, self.w.bias), sums, self.first, self.second, strict=True):
            g = g / np.float32(sentences_)
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            moved.append((x - pace * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.98**self.step)) + 1e-8)).astype(np.float32))
        self.w = Weights(*moved, self.w.areas)


class Scorer:
    """Area counts of documents."""

    def __init__(self, w: Weights, s: Settings):
        self.w, self.s, self.lexicon, self.vectors = w, s, Lexicon(s), np.zeros((0, len(w.areas)), np.float32)

    def _learn(self) -> None:
        have = len(self.vectors)
        fresh = self.lexicon.features[have:]
        if fresh:
            sizes = np.array([len(f) for f in fresh])
            flat = np.concatenate([np.asarray(f, dtype=np.int64) for f in fresh])
            mean = np.add.reduceat(self.w.rows[flat], np.r_[0, np.cumsum(sizes)[:-1]], axis=0) / sizes[:, None]
            # the output is linear in the words: keep each word's part of every area's score
            self.vectors = np.concatenate([self.vectors, (mean @ self.w.out).astype(np.float32)])

    def probabilities(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(document number, area probabilities) of every sentence."""
        if len(self.lexicon.features) > 300_000:
            self.lexicon, self.vectors = Lexicon(self.s), self.vectors[:0]
        words, sizes, owner = [], [], []
        of = self.lexicon.of
        for i, text in enumerate(texts):
            for p in sentences(text):
                words += [of(x) for x in p]
                sizes.append(len(p))
                owner.append(i)
        if not sizes:
            return np.zeros(0, np.int64), np.zeros((0, len(self.w.areas)))
        self._learn()
        n = np.array(sizes)
        score = np.add.reduceat(self.vectors[np.array(words)], np.r_[0, np.cumsum(n)[:-1]], axis=0) / np.maximum(n, self.s.short)[:, None] + self.w.bias
        return np.array(owner), _sigmoid(score)

    def areas(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """(document number, area number, its sentences, all subject sentences) of every area that a document treats."""
        owner, p = self.probabilities(texts)
        sure = p >= self.s.certain
        per = np.zeros((len(texts), p.shape[1]), np.int64)
        np.add.at(per, owner, sure.astype(np.int64))
        subject = np.bincount(owner, weights=sure.any(axis=1), minlength=len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
        with np.errstate(divide="ignore", invalid="ignore"):
            keep = (per > 0) & (per >= self.s.share * subject[:, None])
        return [(int(i), int(k), int(per[i, k]), int(subject[i])) for i, k in np.argwhere(keep)]


def fit_areas(docs: DataFrame, labels: DataFrame, areas: list[str], s: Settings = Settings(), key: str = "doc_id", text: str = "text", area: str = "area", held_out: int | None = None) -> Weights:
    """Weights fitted on labelled documents, about `s.labelled` of them at most; any number of areas.

    `held_out` leaves documents out whose id hash, modulo 10, is that number, for measuring. Labels of unknown areas, and
    labels of documents that do not exist, are ignored; without any label no area is ever given.
    """
    spark = docs.sparkSession
    stash = Stash(spark)
    numbered = spark.createDataFrame(pa.table({"a": pa.array(areas, pa.string()), "number": pa.array(range(len(areas)), pa.int32())}))
    marks = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{area}`").alias("a")).join(numbered, "a").groupBy("k").agg(F.sort_array(F.collect_set("number")).alias("marks"))
    if held_out is not None:
        marks = marks.where(F.pmod(F.xxhash64(F.lit("held"), "k"), F.lit(10)) != held_out)
    marks = stash.keep(marks, "marks")
    bound = min(1.0, s.labelled / max(marks.count(), 1))
    chosen = marks.where(F.pmod(F.xxhash64(F.lit("fit"), "k"), F.lit(1 << 30)) < F.lit(bound * (1 << 30)))
    texts = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(chosen, "k").where(F.col("t").isNotNull())
    piece = F.pmod(F.xxhash64(F.lit("shard"), "k"), F.lit(s.shards * s.slices)).cast("int")
    fields = ("sizes", "words", "counts", "buckets", "marks", "areas")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for n, k, t, m in zip(*[b.column(i).to_pylist() for i in range(4)], strict=True):
                held.setdefault(n, []).append((k, sentences(t), m))
        for n, rows in sorted(held.items()):
            made = Slice.of([(p, m) for _, p, m in sorted(rows, key=lambda r: r[0])], s)
            if len(made.sizes):
                yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), *[pa.array([x], pa.binary()) for x in made.pack()]], names=["piece", *fields])

    parsed = texts.select(piece.alias("piece"), "k", "t", "marks").repartition(s.shards * s.slices, "piece").mapInArrow(parse, "piece int, " + ", ".join(f"{f} binary" for f in fields))
    parsed = stash.keep(parsed, "parsed")
    # a slice is a table of its own with a file for each shard: steps read it without an exchange
    slices = [stash.keep(parsed.where(F.pmod("piece", F.lit(s.slices)) == k).repartition(s.shards, F.floor(F.col("piece") / s.slices)), "slice") for k in range(s.slices)]
    stash.drop(parsed, marks)
    descent = Descent(Weights.fresh(s, areas), s)
    for step in range(s.steps):
        shared, untangled = spark.sparkContext.broadcast(descent.w), step >= s.untangle

        def gradients(batches: Iterator[pa.RecordBatch], shared=shared, untangled=untangled) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for n, *parts in zip(*[b.column(i).to_pylist() for i in range(1 + len(fields))], strict=True):
                    own = Slice.unpack(parts)
                    got = own.gradient(shared.value, s, untangled)
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([len(own.sizes)], pa.int64()), *[pa.array([x.astype(np.int32 if i == 0 else np.float32).tobytes()], pa.binary()) for i, x in enumerate(got)]], names=["piece", "n", "at", "rows", "out", "bias"])

        told = sorted(slices[step % s.slices].mapInArrow(gradients, "piece int, n long, at binary, rows binary, out binary, bias binary").collect(), key=lambda r: r["piece"])  # one row for each shard
        f32 = lambda raw: np.frombuffer(raw, np.float32)
        if told:
            descent.move([(np.frombuffer(r["at"], np.int32), f32(r["rows"]).reshape(-1, s.width), f32(r["out"]).reshape(s.width, -1), f32(r["bias"])) for r in told], sum(r["n"] for r in told))
        shared.destroy()
    stash.drop(*slices)
    return descent.w


def document_areas(docs: DataFrame, w: Weights, s: Settings = Settings(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, area, sentences, subject_sentences): the areas that at least `s.share` of a document's subject sentences treat.

    A sentence treats every area whose output is at least `s.certain`; a subject sentence treats any. Null, empty, blank
    and subject-free texts have no rows. Whole texts of all rows are read; repeated rows repeat their result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(w)
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("t")).where(F.col("t").isNotNull())
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value, s)
        names = shared.value.areas
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                got = scorer.areas([t.decode("utf-8", "replace") for t in part.column(1).to_pylist()])
                take = pa.array([g[0] for g in got], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(take), pa.array([names[g[1]] for g in got], pa.string()), pa.array([g[2] for g in got], pa.int64()), pa.array([g[3] for g in got], pa.int64())],
                    names=[key, "area", "sentences", "subject_sentences"],
                )

    return narrow.mapInArrow(run, f"`{key}` {kind}, area string, sentences bigint, subject_sentences bigint")
