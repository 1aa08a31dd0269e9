"""Binary genotype files written by an independent encoder and read back."""

import struct

import numpy as np
import pytest

from tallygrove.plans import stages
from tallygrove.sources import genotypes as GT


def pack2(codes):
    c = np.r_[codes, np.zeros(-len(codes) % 4, int)].reshape(-1, 4)
    return bytes((c * [1, 4, 16, 64]).sum(axis=1).astype(np.uint8).tolist())


def varint(n):
    out = []
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def difference_list(ids, codes, samples):
    if not len(ids):
        return varint(0)
    width = max(1, ((samples - 1).bit_length() + 7) // 8)
    sets = [ids[i : i + 64] for i in range(0, len(ids), 64)]
    deltas = [b"".join(varint(int(b - a)) for a, b in zip(s, s[1:], strict=False)) for s in sets]
    return varint(len(ids)) + b"".join(int(s[0]).to_bytes(width, "little") for s in sets) + bytes(max(len(d) - 63, 0) for d in deltas[:-1]) + pack2(np.array(codes)) + b"".join(deltas)


def record(way, codes, base, samples):
    if way == 0:
        return pack2(codes)
    if way == 1:
        low, high = sorted(np.bincount(codes, minlength=4).argsort()[::-1][:2])
        bits = np.packbits(codes == high, bitorder="little").tobytes()
        odd = np.flatnonzero((codes != low) & (codes != high))
        return bytes([low << 2 | (high - low)]) + bits + difference_list(odd, codes[odd], samples)
    target = codes if way != 3 else np.array([2, 1, 0, 3])[codes]
    start = base if way in (2, 3) else np.full(samples, way & 3)
    odd = np.flatnonzero(target != start)
    return difference_list(odd, target[odd], samples)


def write(folder, codes, ways, wide):
    n, samples = codes.shape
    records, base = [], None
    for c, w in zip(codes, ways, strict=True):
        records.append(record(w, c, base, samples))
        if w not in (2, 3):
            base = c
    kinds = bytes(ways) if wide else bytes((a | b << 4) for a, b in zip(ways[::2], [*ways[1::2], 0][: len(ways[::2])], strict=True))
    head = GT.MAGIC + bytes([0x10]) + struct.pack("<II", n, samples) + bytes([(5 if wide else 1) | 3 << 6])
    index = kinds + b"".join(len(r).to_bytes(2, "little") for r in records) + bytes(-(-n // 8))
    (folder / "g.pgen").write_bytes(head + struct.pack("<Q", len(head) + 8 + len(index)) + index + b"".join(records))
    (folder / "g.psam").write_text("#IID\tSEX\n" + "".join(f"s{i}\t1\n" for i in range(samples)))


@pytest.mark.parametrize("wide", [False, True])
def test_variable_width_files(spark, tmp_path, wide):
    rng = np.random.default_rng(0)
    samples = 300
    ways = [0, 1, 4, 6, 7, 2, 3, 0, 2, 3, 1, 3, 4]
    codes = np.array([rng.choice(4, samples, p={4: [0.95, 0.02, 0.02, 0.01], 6: [0.02, 0.02, 0.95, 0.01], 7: [0.01, 0.02, 0.02, 0.95]}.get(w, [0.5, 0.4, 0.08, 0.02])) for w in ways])
    codes[5] = np.where(rng.random(samples) < 0.3, codes[5], codes[4])
    write(tmp_path, codes, ways, wide)
    got = GT.read_genotypes(spark, str(tmp_path / "g")).toPandas()
    assert len(got) == codes.size and got.iid.nunique() == samples
    table = got.pivot(index="variant_no", columns="iid", values="dosage").reindex(columns=[f"s{i}" for i in range(samples)]).to_numpy(dtype=float, na_value=np.nan)
    assert np.array_equal(table, np.where(codes == 3, np.nan, codes), equal_nan=True)


def test_fixed_width_bed_and_errors(spark, tmp_path):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 4, (5, 7))
    (tmp_path / "g.psam").write_text("#FID\tIID\n" + "".join(f"f\ts{i}\n" for i in range(7)))
    (tmp_path / "g.pgen").write_bytes(GT.MAGIC + bytes([2]) + struct.pack("<II", 5, 7) + b"\0" + b"".join(pack2(c) for c in codes))
    bed = {0: 3, 1: 2, 2: 0, 3: 1}
    (tmp_path / "g.bed").write_bytes(GT.MAGIC + b"\1" + b"".join(pack2(np.array([bed[x] for x in c])) for c in codes))
    want = {(v, f"s{i}"): None if c == 3 else int(c) for v, row in enumerate(codes) for i, c in enumerate(row)}
    for suffix in (".pgen", ".bed"):
        assert {(r.variant_no, r.iid): r.dosage for r in GT.read_genotypes(spark, str(tmp_path / "g"), suffix).collect()} == want
    (tmp_path / "g.pvar").write_text("##x\n#CHROM\tPOS\tID\tREF\tALT\n" + "".join(f"1\t{100 + i}\trs{i}\tA\tG\n" for i in range(5)))
    pvar = GT.read_pvar(spark, str(tmp_path / "g.pvar")).orderBy("variant_no").collect()
    assert [tuple(r) for r in pvar][:2] == [(0, "1", 100, "rs0", "A", "G"), (1, "1", 101, "rs1", "A", "G")] and len(pvar) == 5
    with pytest.raises(ValueError, match="has 7 samples"):
        GT.pgen_shape(str(tmp_path / "g.pgen"), 8)
    (tmp_path / "d.psam").write_text("#IID\na\na\n")
    with pytest.raises(ValueError, match="repeats"):
        GT.read_psam(str(tmp_path / "d.psam"))


def test_code_fingerprint_and_import_closure(tmp_path):
    same = stages.code_fingerprint('"""a"""\nx = 1  # c\ndef f():\n    "doc"\n    return x\n')
    assert same == stages.code_fingerprint("x=1\ndef f():\n\n    return x") != stages.code_fingerprint("x = 2\ndef f():\n    return x")
    (tmp_path / "pkg").mkdir()
    for name, text in {"pkg/__init__.py": "", "pkg/a.py": "from pkg import b\nimport json\n", "pkg/b.py": "def f():\n    from .c import g\n", "pkg/c.py": "", "pkg/d.py": ""}.items():
        (tmp_path / name).write_text(text)
    got = [p[len(str(tmp_path)) + 1 :] for p in stages.import_closure(str(tmp_path / "pkg/a.py"), str(tmp_path))]
    assert got == ["pkg/__init__.py", "pkg/a.py", "pkg/b.py", "pkg/c.py"]


def test_finished_visits_are_not_fitted_again(spark, tmp_path):
    df = spark.createDataFrame([(8, 1.0), (20, 2.0), (20, 3.0)], "visit int, v double")
    calls = []

    def fit(rows):
        calls.append(rows.count())
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return rows.groupBy("visit").sum("v")

    with pytest.raises(RuntimeError, match="stopped"):
        stages.by_visit(df, "visit", (8, 20), fit, str(tmp_path / "out"))
    got = {r.visit: r["sum(v)"] for r in stages.by_visit(df, "visit", (8, 20), fit, str(tmp_path / "out")).collect()}
    assert got == {8: 1.0, 20: 5.0} and calls == [1, 2, 2]
