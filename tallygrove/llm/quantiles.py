"""Percentiles of very large numeric columns by relative-rank compactors (problem 7).

A sketch is a stack of levels. An item of level l stands for 2**l values. When a level overflows, its protected end (the
low values, for percentiles up to the median) stays, and of the rest every second item moves up. So the protected tail is
exact, and the rank error at rank r is a small fraction of r itself: the published relative-error guarantee. A pair of
sketches, one for either end, serves all percentiles. Sketches of partitions, plates or days merge level by level.

With sections of `K` items the rank error of an answer stays below `ERROR` times its distance in ranks from the nearer
end (tests measure it); groups of up to LEVEL0 values are exact.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 32
SECTIONS = 16
ERROR = 0.02
#: Values that a level may hold before it is compacted; half of them are protected.
LEVEL0 = 2 * K * SECTIONS
#: Neighbouring parts that are merged in one task before the last step.
FAN = 256


class Compactor:
    """A mergeable relative-error sketch that protects low values (`low=True`) or high ones."""

    __slots__ = ("low", "levels", "states", "n")

    def __init__(self, low: bool = True):
        self.low, self.levels, self.states, self.n = low, [np.empty(0)], [0], 0

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        self.levels[0] = np.concatenate([self.levels[0], values])
        self._settle()

    def merge(self, other: Compactor) -> None:
        while len(self.levels) < len(other.levels):
            self.levels.append(np.empty(0))
            self.states.append(0)
        for i, level in enumerate(other.levels):
            self.levels[i] = np.concatenate([self.levels[i], level])
            self.states[i] |= other.states[i]
        self.n += other.n
        self._settle()

    def _settle(self) -> None:
        i = 0
        while i < len(self.levels):
            level = self.levels[i]
            if len(level) > LEVEL0:
                level = np.sort(level)
                if not self.low:
                    level = level[::-1]
                # the more trailing ones the state has, the more sections go, but never the protected half
                state = self.states[i]
                ones = (~state & (state + 1)).bit_length() - 1
                away = min(LEVEL0 // 2, (ones + 1) * K)
                keep = max(LEVEL0 // 2, LEVEL0 - away)
                if (len(level) - keep) % 2:
                    keep += 1
                rest = level[keep:]
                # which half moves up: a fixed, balanced bit of level, state and count
                odd = ((self.n * 0x9E3779B97F4A7C15 + state * 0xD1B54A32D192ED03 + i * 0x8CB92BA72F3D8DD7) >> 40) & 1
                if i + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[i + 1] = np.concatenate([self.levels[i + 1], rest[odd::2]])
                self.levels[i], self.states[i] = level[:keep], state + 1
            i += 1

    def quantiles(self, probs: Sequence[float]) -> list[float]:
        """Values at rank ceil(p * n), at least 1: the smallest value whose rank reaches it."""
        items = np.concatenate(self.levels)
        weights = np.concatenate([np.full(len(x), 1 << i, dtype=np.int64) for i, x in enumerate(self.levels)])
        order = np.argsort(items, kind="stable")
        ranks = np.cumsum(weights[order])
        if not len(items):
            return [float("nan")] * len(probs)
        at = np.searchsorted(ranks, [max(1, int(np.ceil(p * self.n - 1e-9))) for p in probs])
        return [float(items[order[min(k, len(items) - 1)]]) for k in at]

    def pack(self) -> bytes:
        head = struct.pack("<?qI", self.low, self.n, len(self.levels))
        return head + b"".join(struct.pack("<qI", s, len(x)) for s, x in zip(self.states, self.levels, strict=True)) + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def unpack(cls, raw: bytes) -> Compactor:
        out = cls()
        out.low, out.n, count = struct.unpack_from("<?qI", raw)
        at, sizes, out.states, out.levels = struct.calcsize("<?qI"), [], [], []
        for _ in range(count):
            s, size = struct.unpack_from("<qI", raw, at)
            at += struct.calcsize("<qI")
            out.states.append(s)
            sizes.append(size)
        items = np.frombuffer(raw, "<f8", offset=at)
        for size in sizes:
            out.levels.append(items[:size].copy())
            items = items[size:]
        return out


class Both:
    """A low and a high sketch. Up to LEVEL0 values, the low one holds all of them and serves both ends."""

    __slots__ = ("lo", "hi")

    def __init__(self, lo: Compactor | None = None, hi: Compactor | None = None):
        self.lo, self.hi = lo or Compactor(), hi

    def _split(self) -> Compactor:
        if self.hi is None:
            self.hi = Compactor(False)
            self.hi.add(self.lo.levels[0])
        return self.hi

    def add(self, values: np.ndarray) -> None:
        if self.hi is not None or self.lo.n + len(values) > LEVEL0:
            self._split().add(values)
        self.lo.add(values)

    def merge(self, other: Both) -> None:
        if self.hi is not None or other.hi is not None or self.lo.n + other.lo.n > LEVEL0:
            self._split().merge(other._split())
        self.lo.merge(other.lo)

    def quantiles(self, probs: Sequence[float]) -> list[float]:
        low = self.lo.quantiles(probs)
        high = low if self.hi is None else self.hi.quantiles(probs)
        return [a if p <= 0.5 else b for p, a, b in zip(probs, low, high, strict=True)]

    def pack(self) -> bytes:
        lo = self.lo.pack()
        return struct.pack("<I", len(lo)) + lo + (self.hi.pack() if self.hi is not None else b"")

    @classmethod
    def unpack(cls, raw: bytes) -> Both:
        (size,) = struct.unpack_from("<I", raw)
        rest = raw[4 + size :]
        return cls(Compactor.unpack(raw[4 : 4 + size]), Compactor.unpack(rest) if rest else None)


def _groups(keys: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, rows) of every group of equal key codes."""
    order = np.lexsort(keys[::-1])
    change = np.zeros(len(order), dtype=bool)
    change[:1] = True
    for k in keys:
        s = k[order]
        change[1:] |= s[1:] != s[:-1]
    starts = np.flatnonzero(change)
    for a, b in zip(starts, np.r_[starts[1:], len(order)], strict=True):
        rows = order[a:b]
        yield rows[0], rows


def scan_tasks(df: DataFrame) -> int:
    """Tasks that read a frame without exchanges; no job runs."""
    return df._jdf.queryExecution().toRdd().getNumPartitions()  # noqa: SLF001


def sketch_levels(df: DataFrame, measures: dict[str, Column], levels: dict[str, Sequence[Column]]) -> DataFrame:
    """(level, key array<string>, measure, part, seq, sketch binary): partial sketches per map task of every level's groups.

    `levels` names sets of grouping columns; the table is read once for all of them. Null and NaN values are left out;
    a null key is a group of its own. Nothing is shuffled: a hot group leaves each task as one bounded sketch. `part` is the
    task's number and `seq` counts its sketches: the order in which they are merged.
    """
    names, level_names = list(measures), list(levels)
    flat = df.select(
        *[measures[m].cast("double").alias(f"m{i}") for i, m in enumerate(names)],
        *[c.cast("string").alias(f"k{i}_{j}") for i, lv in enumerate(level_names) for j, c in enumerate(levels[lv])],
    )
    widths = [len(levels[lv]) for lv in level_names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Both] = {}
        pending: list[pa.RecordBatch] = []
        task, seq = TaskContext.get().partitionId(), 0

        def flush(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal pending, seq
            if pending:
                full = pa.Table.from_batches(pending).combine_chunks()
                pending = []
                values = [full.column(f"m{i}").to_numpy() for i in range(len(names))]
                for i, width in enumerate(widths):
                    coded = [full.column(f"k{i}_{j}").combine_chunks() for j in range(width)]
                    coded = [(c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).dictionary_encode(null_encoding="encode") for c in coded]
                    codes, words = [c.indices.to_numpy() for c in coded], [c.dictionary.to_pylist() for c in coded]
                    for first, rows in _groups(codes):
                        key = tuple(w[c[first]] for w, c in zip(words, codes, strict=True))
                        for m, v in enumerate(values):
                            own = v[rows]
                            own = own[~np.isnan(own)]
                            if len(own):
                                held.setdefault((i, key, m), Both()).add(own)
            # many small groups leave early, so that a task holds a bounded number of them
            if final or len(held) > 50_000:
                out = list(held.items())
                held.clear()
                for a in range(0, len(out), 2000):
                    part = out[a : a + 2000]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([level_names[k[0]] for k, _ in part]),
                            pa.array([list(k[1]) for k, _ in part], pa.list_(pa.string())),
                            pa.array([names[k[2]] for k, _ in part]),
                            pa.array([task] * len(part), pa.int64()),
                            pa.array([seq] * len(part), pa.int64()),
                            pa.array([s.pack() for _, s in part], pa.binary()),
                        ],
                        names=["level", "key", "measure", "part", "seq", "sketch"],
                    )
                seq += 1

        size = 0
        for batch in batches:
            pending.append(batch)
            size += len(batch)
            if size >= 200_000:
                yield from flush(False)
                size = 0
        yield from flush(True)

    return flat.mapInArrow(run, "level string, key array<string>, measure string, part long, seq long, sketch binary")


def _merged(sketches: DataFrame, names: list[str], order: list[str], probs: list[float]) -> DataFrame:
    """Sketches of equal `names` merged one by one in the stated order: one row each, with its percentiles."""
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sketches.select(*names).schema)
    types = sketches.select(*names).schema
    arrow = {"string": pa.string(), "bigint": pa.int64(), "array<string>": pa.list_(pa.string())}
    spread = sketches.select(*names, *order, "sketch").repartition(*names).sortWithinPartitions(*names, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None

        def out(done: list) -> pa.RecordBatch:
            keys = [pa.array([k[i] for k, _ in done], arrow[f.dataType.simpleString()]) for i, f in enumerate(types)]
            return pa.RecordBatch.from_arrays(
                [
                    *keys,
                    pa.array([s.lo.n for _, s in done], pa.int64()),
                    pa.array([s.quantiles(probs) for _, s in done], pa.list_(pa.float64())),
                    pa.array([s.pack() for _, s in done], pa.binary()),
                ],
                names=[*names, "n", "q", "sketch"],
            )

        for batch in batches:
            done = []
            cols = [batch.column(i).to_pylist() for i in range(len(names))]
            for *key, raw in zip(*cols, batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                name = tuple(tuple(k) if isinstance(k, list) else k for k in key)
                if name != at:
                    if held is not None:
                        done.append((at, held))
                    at, held = name, Both.unpack(raw)
                else:
                    held.merge(Both.unpack(raw))
            if done:
                yield out(done)
        if held is not None:
            yield out([(at, held)])

    return spread.mapInArrow(run, f"{kinds}, n long, q array<double>, sketch binary")


def merged_quantiles(sketches: DataFrame, probs: Sequence[float], tasks: int | None = None) -> DataFrame:
    """(level, key, measure, n, q array<double>, sketch): the sketches of each group combined, and its percentiles.

    Sketches may come from any number of partitions, plates or days; `part` and `seq` order them, so the result does not
    depend on the order of arrival. First FAN neighbouring parts of a group are merged, each such span in its own task,
    then the spans, so that no task reads all sketches of a hot group. With `tasks` parts, numbered from 0, of at most
    FAN there is one span, and merging it alone changes nothing: that step is left out.
    """
    probs = [float(p) for p in probs]
    group = ["level", "key", "measure"]
    if tasks is not None and tasks <= FAN:
        return _merged(sketches, group, ["part", "seq"], probs)
    spans = _merged(sketches.withColumn("span", F.floor(F.col("part") / F.lit(FAN)).cast("long")), [*group, "span"], ["part", "seq"], [])
    return _merged(spans, group, ["span"], probs)
