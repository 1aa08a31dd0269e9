"""Readers of binary genotype files with their variant and sample tables (PGEN, PVAR, PSAM, and BED as a special case).

Hard calls only: 0, 1 or 2 alternative alleles, null for missing. A file falls into blocks of 65,536 variants that can be
read on their own, as no record refers back across a block's start; each block is one task, which opens the file where it
runs, so the path must be readable by all executors.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: First bytes of the format (fixed value), and variants of one block of the index.
MAGIC, BLOCK = b"\x6c\x1b", 1 << 16
#: What the two-bit codes of a BED record stand for (fixed values; -1 is missing).
BED_CALLS = np.array([2, -1, 1, 0], dtype=np.int8)
CALLS = np.array([0, 1, 2, -1], dtype=np.int8)


def read_pvar(spark: SparkSession, path: str) -> DataFrame:
    """(variant_no, chrom, pos, id, ref, alt) in file order; header lines start with ##, the column line with #CHROM."""
    lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id()).where(~F.col("value").startswith("##"))
    head = lines.where(F.col("value").startswith("#CHROM")).select("value").first()
    names = head[0].lstrip("#").split("\t") if head else ["CHROM", "ID", "CM", "POS", "ALT", "REF"]
    rows = lines.where(~F.col("value").startswith("#"))
    # the number within a partition plus the rows of the partitions before it
    part = F.shiftright("n", 33)
    sizes = rows.groupBy(part.alias("p")).agg(F.count("*").alias("c"), F.min("n").alias("first")).orderBy("p").collect()  # one row for each partition
    offsets, at = [], 0
    for r in sizes:
        offsets.append((r["p"], at - r["first"]))
        at += r["c"]
    shift = F.lit(0)
    for p, o in offsets:
        shift = F.when(part == p, F.lit(o)).otherwise(shift)
    f = F.split("value", "\t")
    col = lambda n: f[names.index(n)]
    return rows.select((F.col("n") + shift).alias("variant_no"), col("CHROM").alias("chrom"), col("POS").cast("bigint").alias("pos"), col("ID").alias("id"), col("REF").alias("ref"), col("ALT").alias("alt"))


def read_psam(path: str) -> list[str]:
    """Sample ids in file order; a repeated id is an error."""
    with open(path, encoding="utf-8") as file:
        lines = [x.rstrip("\n") for x in file if x.strip() and not x.startswith("##")]
    head = lines[0].lstrip("#").split("\t") if lines and lines[0].startswith("#") else ["FID", "IID"]
    rows = lines[1:] if lines and lines[0].startswith("#") else lines
    ids = [r.split("\t")[head.index("IID")] for r in rows]
    if len(set(ids)) < len(ids):
        raise ValueError(f"{path} repeats a sample id")
    return ids


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value, shift = 0, 0
    while True:
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _pairs(raw: bytes, n: int) -> np.ndarray:
    """n two-bit codes, low bits first."""
    b = np.frombuffer(raw, np.uint8)
    return ((b[:, None] >> np.array([0, 2, 4, 6])) & 3).reshape(-1)[:n].astype(np.uint8)


def _exceptions(raw: bytes, at: int, samples: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Samples of a difference list, their codes, and where it ends."""
    length, at = _varint(raw, at)
    if not length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint8), at
    width = max(1, ((samples - 1).bit_length() + 7) // 8)
    sets = -(-length // 64)
    firsts = [int.from_bytes(raw[at + i * width : at + (i + 1) * width], "little") for i in range(sets)]
    at += sets * width + sets - 1
    codes = _pairs(raw[at : at + -(-length // 4)], length)
    at += -(-length // 4)
    ids = np.zeros(length, np.int64)
    for s in range(sets):
        own = firsts[s]
        for i in range(s * 64, min(s * 64 + 64, length)):
            if i % 64:
                step, at = _varint(raw, at)
                own += step
            ids[i] = own
    return ids, codes, at


def _record(kind: int, raw: bytes, samples: int, base: np.ndarray | None) -> np.ndarray:
    """Two-bit codes of one record of a variable-width file; `base` is the last record that refers to none."""
    way = kind & 7
    if way == 0:
        return _pairs(raw[: -(-samples // 4)], samples)
    if way == 1:
        low, step = raw[0] >> 2, raw[0] & 3
        size = -(-samples // 8)
        bits = np.unpackbits(np.frombuffer(raw[1 : 1 + size], np.uint8), bitorder="little")[:samples]
        codes, at = (low + step * bits).astype(np.uint8), 1 + size
    elif way in (2, 3):
        codes, at = base.copy(), 0
    elif way in (4, 6, 7):
        codes, at = np.full(samples, way & 3, np.uint8), 0
    else:
        raise ValueError("unknown kind of record")
    ids, others, _ = _exceptions(raw, at, samples)
    codes[ids] = others
    if way == 3:
        codes = np.array([2, 1, 0, 3], np.uint8)[codes]
    return codes


def _read(file, n: int) -> bytes:
    raw = file.read(n)
    if len(raw) < n:
        raise ValueError("the genotype file is cut off")
    return raw


def pgen_shape(path: str, samples: int) -> tuple[int, int]:
    """(storage mode, variants) of a file; the number of samples must be the sample table's."""
    with open(path, "rb") as file:
        if _read(file, 2) != MAGIC:
            raise ValueError(f"{path} is no genotype file")
        mode = _read(file, 1)[0]
        if mode == 1:
            file.seek(0, 2)
            return mode, (file.tell() - 3) // -(-samples // 4)
        variants, own = struct.unpack("<II", _read(file, 8))
    if own != samples:
        raise ValueError(f"{path} has {own} samples, its sample table {samples}")
    if mode not in (0x02, 0x10):
        raise ValueError(f"storage mode {mode} of {path} is not read")
    return mode, variants


def block_calls(path: str, samples: int, mode: int, variants: int, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(variant number, calls) of the variants of one block."""
    first, last = block * BLOCK, min((block + 1) * BLOCK, variants)
    size = -(-samples // 4)
    with open(path, "rb") as file:
        if mode in (0x01, 0x02):
            file.seek((3 if mode == 1 else 12) + first * size)
            for v in range(first, last):
                yield v, (BED_CALLS if mode == 1 else CALLS)[_pairs(_read(file, size), samples)]
            return
        file.seek(11)
        form = _read(file, 1)[0]
        wide, length_bytes = (form & 15) >= 4, (form & 3) + 1
        allele_bytes, flags = (form >> 4) & 3, form >> 6
        blocks = -(-variants // BLOCK)
        start = struct.unpack(f"<{blocks}Q", _read(file, 8 * blocks))[block]
        for b in range(block + 1):
            n = min(BLOCK, variants - b * BLOCK)
            kinds = _read(file, n if wide else -(-n // 2))
            lengths = _read(file, n * length_bytes)
            file.seek(n * allele_bytes + (-(-n // 8) if flags == 3 else 0), 1)
        n = last - first
        kind = list(kinds) if wide else [(kinds[i // 2] >> (4 * (i % 2))) & 15 for i in range(n)]
        file.seek(start)
        base = None
        for i in range(n):
            raw = _read(file, int.from_bytes(lengths[i * length_bytes : (i + 1) * length_bytes], "little"))
            codes = _record(kind[i], raw, samples, base)
            if kind[i] & 7 not in (2, 3):
                base = codes
            yield first + i, CALLS[codes]


def read_genotypes(spark: SparkSession, prefix: str, suffix: str = ".pgen") -> DataFrame:
    """(variant_no, iid, dosage) of `prefix`.pgen (or .bed) and `prefix`.psam: one row for each variant and sample, null where
    there is no call. Tasks are blocks of 65,536 variants."""
    path, ids = f"{prefix}{suffix}", read_psam(f"{prefix}.psam")
    samples = len(ids)
    mode, variants = pgen_shape(path, samples)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = np.array(ids, dtype=object)
        for pdf in batches:
            for block in pdf["id"]:
                held: list[tuple[int, np.ndarray]] = []
                for item in block_calls(path, samples, mode, variants, int(block)):
                    held.append(item)
                    if len(held) * samples >= 200_000:
                        yield flat(held, names)
                        held = []
                if held:
                    yield flat(held, names)

    def flat(held: list[tuple[int, np.ndarray]], names: np.ndarray) -> pd.DataFrame:
        calls = np.concatenate([c for _, c in held])
        dosage = pd.Series(calls.astype("int32")).where(calls >= 0).astype("Int32")
        return pd.DataFrame({"variant_no": np.repeat([v for v, _ in held], samples), "iid": np.tile(names, len(held)), "dosage": dosage})

    blocks = -(-variants // BLOCK)
    return spark.range(0, blocks, 1, max(1, blocks)).mapInPandas(run, "variant_no long, iid string, dosage int")
