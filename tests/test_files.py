import os

import pytest
from pyspark.sql import functions as F

from tallygrove.plans.stages import Runner, Stage, expand, fingerprint
from tallygrove.sources import files as S
from tallygrove.streaming.plates import plate_windows, stream_readings


def test_scan_text_and_ids(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text("SampleID,n,x,s\n0012,1,1.5,a\n0013,,2,\n0014,3,,b\n")
    df = S.scan_file(spark, str(p))
    assert df.dtypes == [("SampleID", "string"), ("n", "bigint"), ("x", "double"), ("s", "string")]
    assert [tuple(r) for r in df.orderBy("SampleID").collect()] == [("0012", 1, 1.5, "a"), ("0013", None, 2.0, None), ("0014", 3, None, "b")]
    with pytest.raises(ValueError):
        S.scan_file(spark, str(tmp_path / "a.doc"))
    assert S.single_match(str(tmp_path), "*.csv") == str(p)
    with pytest.raises(FileNotFoundError):
        S.single_match(str(tmp_path), "*.tsv")


def test_header_table(spark, tmp_path):
    p = tmp_path / "key.csv"
    p.write_text("Vendor key\n\nmade,2024\nTube,Subject,Date\nT1,S1,2024-01-01\n,,\nT2, S2 ,\n")
    assert [tuple(r) for r in S.header_table(spark, str(p), "Tube").orderBy("Tube").collect()] == [("T1", "S1", "2024-01-01"), ("T2", "S2", None)]


ADAT = "!Checksum\tx\n!ProcessSteps\tRaw RFU, Hyb Normalization, anmlQC\n^COL_DATA\n^TABLE_BEGIN\n\t\tSeqId\t10000-28\t10001-7\n\t\tTarget\tA\tB\nSampleId\tPlateId\t\t\t\n0001\tP1\t\t1.5\t2.5\n0002\tP1\t\tNA\t4.0\n"


def test_adat(spark, tmp_path):
    p = tmp_path / "x.adat"
    p.write_text(ADAT)
    got = S.read_adat(spark, str(p))
    assert got["steps"] == ["Raw RFU", "Hyb Normalization", "anmlQC"]
    assert [tuple(r) for r in got["samples"].orderBy("_sample_idx").collect()] == [(0, "0001", "P1"), (1, "0002", "P1")]
    assert [tuple(r) for r in got["analytes"].orderBy("SeqId").collect()] == [("10000-28", "A"), ("10001-7", "B")]
    assert {(r._sample_idx, r.SeqId): r.RFU for r in got["long"].collect()} == {(0, "10000-28"): 1.5, (0, "10001-7"): 2.5, (1, "10000-28"): None, (1, "10001-7"): 4.0}
    with pytest.raises(ValueError):
        S.require_steps(got["steps"], ["hyb"], ["anml"])
    S.require_steps(got["steps"], ["hyb"], ["plate scale"])


def test_vcf_and_gene_sets(spark, tmp_path):
    p = tmp_path / "x.vcf"
    p.write_text("##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tA\tB\n1\t100\trs1\tG\tC\t.\t.\t.\tGT:DP\t0/1:3\t./.:0\n2\t7\trs2\tA\tT\t.\t.\t.\tGT\t1|1\t0|0\n")
    got = {(r.id, r["sample"]): (r.gt, r.dosage) for r in S.read_vcf(spark, str(p)).collect()}
    assert got == {("rs1", "A"): ("0/1", 1), ("rs1", "B"): ("./.", None), ("rs2", "A"): ("1|1", 2), ("rs2", "B"): ("0|0", 0)}
    j = tmp_path / "sets.json"
    j.write_text('{"t1": ["G1", "G2", "G1"], "t2": []}')
    sets = S.read_gene_sets(spark, str(j), "lib")
    assert [tuple(r) for r in sets.orderBy("pos").collect()] == [("lib", "t1", "G1", 0), ("lib", "t1", "G2", 1)]
    fix = spark.createDataFrame([("lib", "t1", "G1", "H1"), ("lib", "t1", "G2", None)], "library string, term string, from_symbol string, to_symbol string")
    assert [r.gene for r in S.corrected_gene_sets(sets, fix).collect()] == ["H1"]


def test_workbook_round_trip_and_bytes(spark, tmp_path):
    df = spark.createDataFrame([("0012", 1, 1.5, "a<b"), ("0013", None, 2.0, None)], "SampleID string, n int, x double, s string")
    a, b = str(tmp_path / "a.xlsx"), str(tmp_path / "b.xlsx")
    S.write_workbook({"One": df.orderBy("SampleID"), "Two": df.limit(0)}, a)
    S.write_workbook({"One": df.orderBy("SampleID"), "Two": df.limit(0)}, b)
    assert S.sha256_of(a) == S.sha256_of(b)
    back = S.read_sheet(spark, a, "One")
    assert [tuple(r) for r in back.orderBy("SampleID").collect()] == [("0012", 1, 1.5, "a<b"), ("0013", None, 2.0, None)]
    with pytest.raises(ValueError):
        S.read_sheet(spark, a, "Three")
    with pytest.raises(ValueError):
        S.verify_sha256(a, "0" * 64)


def test_delimited_and_publication(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "i int, s string")
    S.write_delimited(df, str(tmp_path / "t.tsv"), ["i"])
    assert (tmp_path / "t.tsv").read_text() == "i\ts\n1\ta\n2\tb\n"
    target = str(tmp_path / "out")
    with S.Publication(target) as stage:
        open(os.path.join(stage, "x"), "w").write("1")
    with pytest.raises(RuntimeError), S.Publication(target) as stage:
        open(os.path.join(stage, "x"), "w").write("2")
        raise RuntimeError
    assert open(os.path.join(target, "x")).read() == "1" and len(os.listdir(tmp_path)) == 2


def test_stages_skip_and_follow(tmp_path):
    (tmp_path / "in.txt").write_text("1")
    log = []

    def first(v):
        log.append("first")
        (tmp_path / "mid.txt").write_text((tmp_path / "in.txt").read_text() + "m")

    def second(v):
        log.append("second")
        (tmp_path / "out.txt").write_text((tmp_path / "mid.txt").read_text() + "o")

    make = lambda **kw: Runner([Stage("first", first, ["{root}/in.txt"], ["{root}/mid.txt"], kw), Stage("second", second, ["{root}/mid.txt"], ["{root}/out.txt"])], {"root": str(tmp_path)}, str(tmp_path / "record.json"))
    assert make().run() == ["first", "second"] and make().run() == []
    (tmp_path / "in.txt").write_text("2")
    assert [n for n, _ in make().plan()] == ["first", "second"] and make().run() == ["first", "second"]
    (tmp_path / "out.txt").write_text("?")
    assert make().plan() == [("second", "outputs changed")]
    assert make(k=1).plan()[0] == ("first", "code or settings changed")
    with pytest.raises(ValueError):
        Runner([Stage("a", first, ["y"], ["x"]), Stage("b", second, [], ["y"])], {}, "r")
    assert expand("{root}/{a,b}.txt", {"root": "r"}) == ["r/a.txt", "r/b.txt"]
    assert fingerprint(str(tmp_path / "none")) == "missing"


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2024-01-0{1 + i % 3} 0{i % 9}:00:00", "P1" if i % 2 else "P2", float(i) if i % 5 else float("nan"), 10.0) for i in range(60)]
    df = spark.createDataFrame(rows, "t string, plate string, v double, lod double").withColumn("t", F.to_timestamp("t"))
    src = str(tmp_path / "in")
    df.repartition(4).write.parquet(src)
    stream = plate_windows(stream_readings(spark, src, df.schema, 1), "t", "plate", "v", "lod", late="30 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("plates_out").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    order = ["day", "plate"]
    assert spark.table("plates_out").orderBy(order).collect() == plate_windows(df, "t", "plate", "v", "lod").orderBy(order).collect()


def test_large_files_are_hashed_whole(tmp_path, monkeypatch):
    from tallygrove.plans import stages

    monkeypatch.setattr(stages, "WHOLE", 1000, raising=False)  # where there is a size for the ends alone, it is passed
    monkeypatch.setattr(stages, "END", 100, raising=False)
    big = tmp_path / "big"
    big.write_bytes(b"a" * 5000)
    stage = Stage("copy", lambda v: (tmp_path / "out").write_bytes(big.read_bytes()), ["{root}/big"], ["{root}/out"])
    make = lambda: Runner([stage], {"root": str(tmp_path)}, str(tmp_path / "record.json"))
    assert make().run() == ["copy"] and make().plan() == []
    big.write_bytes(b"a" * 2500 + b"b" + b"a" * 2499)
    assert make().plan() == [("copy", "inputs changed")]
    assert make().run() == ["copy"] and (tmp_path / "out").read_bytes() == big.read_bytes()
