"""Encoding of a corpus with a public byte-level BPE tokenizer by corpus-level merge replay (problem 8).

Texts fall into words once. Slices of texts keep numbers in place of words, and a list of the words behind the numbers. The
distinct words of all slices make up the corpus table, in which each word stands once. An inverted index holds, for every
pair of neighbouring tokens that has a merge, the positions where it stands in the words. Merges are applied in rank
order, each at all of its positions, and only the two neighbours of a merged place are looked at again. A merge can only
make pairs of later rank, because its token exists in no earlier merge, so one pass in rank order gives every word its
final tokens. These are joined back to the slices' word lists, and each slice's numbers are then exchanged for tokens.

What is shuffled is a slice's distinct words, not every occurrence, and the numbers. The merge table, read once on the
driver from the vocabulary file, is of fixed size and broadcast.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.session import Stash

#: How text falls into words before the merges (fixed value, part of the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Text bytes of a slice (a longer text is a slice of its own), words that share one index in a task, numbers decoded at once.
SLICE_BYTES, INDEX_WORDS, PIECE = 16_000_000, 200_000, 2_000_000
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def byte_signs() -> dict[str, int]:
    """The printable sign that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for themselves,
    the others, in order, for the code points from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def load_merges(path: str) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """Token id of every byte, and for every pair (left * 2**20 + right) the rank and id of its merge."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    vocab, signs = model["vocab"], byte_signs()
    of_byte = [0] * 256
    for sign, byte in signs.items():
        of_byte[byte] = vocab[sign]
    merges = {}
    for rank, pair in enumerate(model["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merges[vocab[left] << 20 | vocab[right]] = (rank, vocab[left + right])
    return of_byte, merges


def replay(words: list[bytes], of_byte: list[int], merges: dict[int, tuple[int, int]]) -> list[list[int]]:
    """The tokens of each word."""
    token: list[int] = []
    after: list[int] = []
    before: list[int] = []
    starts: list[int] = []
    for word in words:
        first = len(token)
        starts.append(first)
        token += [of_byte[b] for b in word]
        end = len(token)
        after += range(first + 1, end + 1)
        before += range(first - 1, end - 1)
        if end > first:
            after[-1] = before[first] = -1
    index: dict[int, list[int]] = {}
    for i, j in enumerate(after):
        if j >= 0:
            pair = token[i] << 20 | token[j]
            if pair in index:
                index[pair].append(i)
            elif pair in merges:
                index[pair] = [i]
    queue = [(merges[p][0], p) for p in index]
    heapq.heapify(queue)
    while queue:
        _, pair = heapq.heappop(queue)
        left, right, made = pair >> 20, pair & 0xFFFFF, merges[pair][1]
        places = index.pop(pair)
        places.sort()
        for i in places:
            if token[i] != left:
                continue
            j = after[i]
            if j < 0 or token[j] != right:
                continue
            k, h = after[j], before[i]
            token[i], token[j] = made, -1
            after[i] = k
            if k >= 0:
                before[k] = i
                new = made << 20 | token[k]
                if new in index:
                    index[new].append(i)
                elif new in merges:
                    index[new] = [i]
                    heapq.heappush(queue, (merges[new][0], new))
            if h >= 0:
                new = token[h] << 20 | made
                if new in index:
                    index[new].append(h)
                elif new in merges:
                    index[new] = [h]
                    heapq.heappush(queue, (merges[new][0], new))
    out = []
    for first, word in zip(starts, words, strict=True):
        ids, i = [], first if word else -1
        while i >= 0:
            ids.append(token[i])
            i = after[i]
        out.append(ids)
    return out


def _coded(docs: DataFrame, kind: str) -> DataFrame:
    """(slice, k, codes, code, word): a row with the word numbers of each document (k, t), and one for each word of a slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(PATTERN).findall
        number: dict[str, int] = {}
        size, slice_no = 0, TaskContext.get().partitionId() << 32

        def rows(count: int, own: int, keys, codes, places, words) -> pa.RecordBatch:
            blank = lambda t: pa.nulls(count, t)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(count, own)), blank(key_type) if keys is None else keys, blank(pa.binary()) if codes is None else codes, blank(pa.int32()) if places is None else places, blank(pa.binary()) if words is None else words],
                names=["slice", "k", "codes", "code", "word"],
            )

        def listed(own: int) -> Iterator[pa.RecordBatch]:
            words = [w.encode("utf-8", "replace") for w in number]
            for a in range(0, len(words), 50_000):
                part = words[a : a + 50_000]
                yield rows(len(part), own, None, None, pa.array(np.arange(a, a + len(part), dtype=np.int32)), pa.array(part, pa.binary()))

        key_type = None
        for batch in batches:
            key_type = batch.schema.field("k").type
            held, first, pending = [], 0, 0
            for i, raw in enumerate(batch.column(1)):
                raw = raw.as_py() or b""
                closes = size and size + len(raw) > SLICE_BYTES
                if held and (closes or pending > SLICE_BYTES):
                    yield rows(len(held), slice_no, batch.column(0).slice(first, len(held)), pa.array(held, pa.binary()), None, None)
                    held, first, pending = [], i, 0
                if closes:
                    yield from listed(slice_no)
                    number, size, slice_no = {}, 0, slice_no + 1
                held.append(np.array([number.setdefault(w, len(number)) for w in split(raw.decode("utf-8", "replace"))], dtype="<i4").tobytes())
                size += len(raw)
                pending += len(raw)
            if held:
                yield rows(len(held), slice_no, batch.column(0).slice(first, len(held)), pa.array(held, pa.binary()), None, None)
        if number:
            yield from listed(slice_no)

    return docs.mapInArrow(run, f"slice bigint, k {kind}, codes binary, code int, word binary")


def _replayed(words: DataFrame, vocabulary: str) -> DataFrame:
    """(word, ids): the tokens of distinct words, as bytes of 32-bit numbers."""
    shared = words.sparkSession.sparkContext.broadcast(load_merges(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def out() -> pa.RecordBatch:
            ids = [np.array(x, dtype="<i4").tobytes() for x in replay(held, *shared.value)]
            return pa.RecordBatch.from_arrays([pa.array(held, pa.binary()), pa.array(ids, pa.binary())], names=["word", "ids"])

        for batch in batches:
            held += batch.column(0).to_pylist()
            if len(held) >= INDEX_WORDS:
                yield out()
                held.clear()
        if held:
            yield out()

    return words.mapInArrow(run, "word binary, ids binary")


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 32-bit numbers of a column of bytes, and where each row's begin and end."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1] // 4
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[: len(data) // 4 * 4].view("<i4") if data else np.zeros(0, np.int32)), offsets


def _exchanged(rows: DataFrame, kind: str, key: str, out: str, counting: bool) -> DataFrame:
    """Documents' word numbers exchanged for tokens; rows are in the order of slices, each slice's words first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: int | None = None
        parts: list[bytes] = []
        sizes = starts = flat = np.zeros(0, np.int64)
        for batch in batches:
            slices = batch.column(0).to_numpy()
            is_word = batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in _runs(slices * 2 + is_word):
                if is_word[a]:
                    if at != slices[a]:
                        at, parts = slices[a], []
                    parts += batch.column(4).slice(a, b - a).to_pylist()
                    sizes = np.zeros(0, np.int64)
                    continue
                if at != slices[a]:
                    at, parts, sizes = slices[a], [], np.zeros(0, np.int64)
                if len(sizes) != len(parts):
                    sizes = np.array([len(x) // 4 for x in parts], np.int64)
                    starts, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(parts), "<i4")
                numbers, offsets = _numbers(batch.column(3).slice(a, b - a))
                lo = 0
                while lo < b - a:
                    hi = max(int(np.searchsorted(offsets, offsets[lo] + PIECE, "right")) - 1, lo + 1)
                    own = numbers[offsets[lo] : offsets[hi]]
                    upto = np.r_[0, np.cumsum(sizes[own])]
                    ends = upto[offsets[lo : hi + 1] - offsets[lo]]
                    if counting:
                        got = pa.array(np.diff(ends))
                    else:
                        place = np.repeat(starts[own] - upto[:-1], sizes[own]) + np.arange(upto[-1])
                        got = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat[place].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([batch.column(1).slice(a + lo, hi - lo), got], names=[key, out])
                    lo = hi

    return rows.mapInArrow(run, f"`{key}` {kind}, `{out}` {'bigint' if counting else 'array<int>'}")


def _runs(values: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.r_[True, values[1:] != values[:-1], True]) if len(values) else np.zeros(1, np.int64)
    yield from zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)


def _mapped(docs: DataFrame, key: str, text: str, vocabulary: str, out: str, counting: bool) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("binary").alias("t"))
    coded = Stash(spark).keep(_coded(narrow, kind), "coded")
    listed = coded.where(F.col("word").isNotNull()).select("slice", "code", "word")
    words = listed.join(_replayed(listed.select("word").distinct(), vocabulary), "word")
    rows = words.select("slice", F.lit(None).cast(kind).alias("k"), F.lit(True).alias("is_word"), F.lit(None).cast("binary").alias("codes"), "ids", "code")
    rows = rows.unionByName(coded.where(F.col("word").isNull()).select("slice", "k", F.lit(False).alias("is_word"), "codes", F.lit(None).cast("binary").alias("ids"), F.lit(0).alias("code")))
    ordered = rows.repartition("slice").sortWithinPartitions("slice", F.desc("is_word"), "code")
    return _exchanged(ordered.select("slice", "k", "is_word", "codes", "ids"), kind, key, out, counting)


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids array<int>): the whole text of every row as token ids, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts have the empty list, blank texts the
    ids of their blanks. Bytes that are no UTF-8 count as U+FFFD. Repeated rows are encoded alike; other columns may have
    any name; an empty table gives no rows.
    """
    return _mapped(docs, key, text, vocabulary, "ids", False)


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, n_tokens): the number of ids that `encode_corpus` gives; 0 for null and empty texts."""
    return _mapped(docs, key, text, vocabulary, "n_tokens", True)
