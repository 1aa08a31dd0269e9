"""Readers for the file kinds of measurement studies, and writers for their results."""

from __future__ import annotations

import fnmatch
import gzip
import hashlib
import io
import json
import os
import re
import uuid
import zipfile
from collections.abc import Iterator, Mapping, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns that hold identifiers are text whatever they look like, so that leading zeros stay.
ID_COLUMNS = ("SampleID", "SampleId", "USUBJID", "SUBJID", "PlateID", "PlateId", "AccessionNumber", "LBREFID", "sampleid", "usubjid", "plateid", "accessionnumber")


def scan_file(spark: SparkSession, path: str, schema: T.StructType | None = None, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """A table by extension: parquet, orc, json lines, csv, tsv, txt (tabs), each also gzipped.

    Delimited files are read as text first, so identifiers keep their zeros; the other columns get a type that all rows
    fit, found in one aggregation over the file (long, double, else string). With `schema` nothing is inferred.
    """
    name = re.sub(r"\.gz$", "", path.rstrip("/").lower())
    if name.endswith(".parquet") or os.path.isdir(path):
        return spark.read.parquet(path)
    if name.endswith(".orc"):
        return spark.read.orc(path)
    if name.endswith((".json", ".jsonl")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    sep = "\t" if name.endswith((".tsv", ".txt")) else ","
    if not name.endswith((".csv", ".tsv", ".txt")):
        raise ValueError(f"no reader for {path}")
    if schema is not None:
        return spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue="")
    return typed_text(spark.read.csv(path, header=True, sep=sep, nullValue=""), ids)


def typed_text(text: DataFrame, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """Text columns as the narrowest of long, double and string that every row fits; identifiers stay text."""
    own = [c for c in text.columns if c not in ids]
    if not own:
        return text
    quoted = {c: F.trim(F.col(f"`{c}`")) for c in own}
    fits = text.agg(
        *[F.bool_and(quoted[c].try_cast("bigint").isNotNull() | quoted[c].isNull()).alias(f"l{i}") for i, c in enumerate(own)],
        *[F.bool_and(quoted[c].try_cast("double").isNotNull() | quoted[c].isNull()).alias(f"d{i}") for i, c in enumerate(own)],
        *[F.count(quoted[c]).alias(f"n{i}") for i, c in enumerate(own)],
    ).first()
    kind = {c: "bigint" if fits[f"l{i}"] and fits[f"n{i}"] else "double" if fits[f"d{i}"] and fits[f"n{i}"] else "string" for i, c in enumerate(own)}
    return text.select(*[(quoted[c].cast(kind[c]) if kind.get(c, "string") != "string" else F.col(f"`{c}`")).alias(c) for c in text.columns])


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path (local, or by its URI) and the path on it."""
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def single_match(folder: str, pattern: str) -> str:
    """The only file of a folder that fits the pattern."""
    files, root = filesystem(folder)
    held = files.get_file_info(fs.FileSelector(root, allow_not_found=True))
    found = sorted(i.base_name for i in held if fnmatch.fnmatch(i.base_name, pattern))
    if len(found) != 1:
        raise FileNotFoundError(f"{pattern} fits {len(found)} files in {folder}, not one")
    return f"{folder.rstrip('/')}/{found[0]}"


def header_table(spark: SparkSession, path: str, cell: str, sep: str = ",") -> DataFrame:
    """A delimited table that starts below free text: its header is the first line that has the cell. All columns are text."""
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("i"))
    parts = lines.select("i", F.split("value", re.escape(sep)).alias("p"))
    head = parts.where(F.exists("p", lambda x: F.trim(x) == cell)).orderBy("i").limit(1).collect()
    if not head:
        raise ValueError(f"no line of {path} has the cell {cell}")
    names = [n.strip() or f"column_{k}" for k, n in enumerate(head[0]["p"])]
    rows = parts.where((F.col("i") > head[0]["i"]) & F.exists("p", lambda x: F.trim(x) != ""))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    return rows.select(*[blank(F.try_element_at("p", F.lit(k + 1))).alias(n) for k, n in enumerate(names)])


# --- matrices of readings with sample and analyte annotation ----------------------------------------------------------
def read_adat(spark: SparkSession, path: str) -> dict:
    """A tab-separated reading matrix with header lines, analyte rows on top and sample columns at left.

    Gives `steps` (process steps of the header), `samples`, `analytes` and `long` (_sample_idx, SeqId, RFU). The file is
    one vendor batch (a few plates), so it is parsed on the driver and spread over tasks as rows of arrays.
    """
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt", encoding="utf-8") as f:
        lines = [line.rstrip("\r\n") for line in f]
    at = next(i for i, line in enumerate(lines) if line.startswith("^TABLE_BEGIN"))
    header = dict(line[1:].split("\t", 1) if "\t" in line else (line[1:], "") for line in lines[:at] if line.startswith("!"))
    grid = [line.split("\t") for line in lines[at + 1 :]]
    top = next(i for i, row in enumerate(grid) if row and row[0] != "")
    left = max(next(k for k, c in enumerate(row) if c != "") for row in grid[:top])
    names = [c for c in grid[top][:left] if c]
    analytes = {row[left]: row[left + 1 :] for row in grid[:top]}
    n = len(next(iter(analytes.values())))
    samples = [(i, *row[: len(names)]) for i, row in enumerate(grid[top + 1 :])]
    values = [(i, [float(v) if v not in ("", "NA") else None for v in row[left + 1 : left + 1 + n]]) for i, row in enumerate(grid[top + 1 :])]
    text = lambda cols: T.StructType([T.StructField(c, T.StringType()) for c in cols])
    sample_frame = spark.createDataFrame(samples, T.StructType([T.StructField("_sample_idx", T.LongType()), *text(names).fields]))
    analyte_frame = spark.createDataFrame([tuple(analytes[k][j] for k in analytes) for j in range(n)], text(list(analytes)))
    rows = spark.createDataFrame(values, "_sample_idx long, v array<double>")
    seq = F.array(*[F.lit(s) for s in analytes["SeqId"]])
    long = rows.select("_sample_idx", F.explode(F.arrays_zip(seq.alias("SeqId"), F.col("v").alias("RFU"))).alias("z")).select("_sample_idx", "z.SeqId", "z.RFU")
    return {"steps": [s.strip() for s in header.get("ProcessSteps", "").split(",") if s.strip()], "samples": sample_frame, "analytes": analyte_frame, "long": long}


def require_steps(steps: Sequence[str], wanted: Sequence[str] = (), forbidden: Sequence[str] = ()) -> None:
    """The header's process steps must have all of the first and none of the second list (part of a step's name is enough)."""
    has = lambda s: any(s.lower() in x.lower() for x in steps)
    missing, extra = [s for s in wanted if not has(s)], [s for s in forbidden if has(s)]
    if missing or extra:
        raise ValueError(f"process steps {list(steps)}: missing {missing}, not allowed {extra}")


def unpivot_matrix(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str = "assay", value: str = "value") -> DataFrame:
    """Long rows of a wide matrix."""
    return df.unpivot(list(ids), list(values), name, value)


def scaled_log(df: DataFrame, assay: str, value: str, study: Column, out: str = "scaled") -> DataFrame:
    """log10 of the value, standardised per assay by mean and sample sd of the study rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(assay)
    x = F.when(F.col(value) > 0, F.log10(F.col(value)))
    own = F.when(study, x)
    sd = F.stddev_samp(own).over(w)
    return df.withColumn(out, F.when(sd > 0, (x - F.avg(own).over(w)) / sd))


def write_bundle(frames: Mapping[str, DataFrame], folder: str) -> None:
    """Several tables as one folder of parquet tables."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def read_bundle(spark: SparkSession, folder: str, names: Sequence[str], unique: Mapping[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    from tallygrove.operators.relational import assert_unique

    out = {n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names}
    return {n: assert_unique(df, list(unique[n]), n) if unique and n in unique else df for n, df in out.items()}


# --- genotypes and gene sets ------------------------------------------------------------------------------------------
def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, pos, id, ref, alt, sample, gt, dosage): the calls of a VCF; dosage counts non-reference alleles, null if any
    allele is missing. Each line becomes rows in place; the sample names are one line of the header."""
    lines = spark.read.text(path)
    head = lines.where(F.col("value").startswith("#CHROM")).first()["value"].split("\t")
    parts = lines.where(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p"))
    names = F.array(*[F.lit(s) for s in head[9:]])
    calls = parts.select(
        F.col("p")[0].alias("chrom"), F.col("p")[1].cast("bigint").alias("pos"), F.col("p")[2].alias("id"), F.col("p")[3].alias("ref"), F.col("p")[4].alias("alt"),
        F.explode(F.arrays_zip(names.alias("sample"), F.slice("p", F.lit(10), F.greatest(F.size("p") - 9, F.lit(0))).alias("call"))).alias("z"),
    )
    gt = F.split(F.col("z.call"), ":")[0]
    alleles = F.split(gt, r"[/|]")
    dosage = F.when(~F.exists(alleles, lambda a: a == "."), F.size(F.filter(alleles, lambda a: a != "0")))
    return calls.select("chrom", "pos", "id", "ref", "alt", F.col("z.sample").alias("sample"), gt.alias("gt"), dosage.alias("dosage"))


def read_gene_sets(spark: SparkSession, path: str, library: str) -> DataFrame:
    """(library, term, gene, pos) of a JSON object {term: [genes]}; a term's first mention of a gene counts."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    rows = raw.select(F.explode("m").alias("term", "genes")).select("term", F.posexplode(F.array_distinct("genes")).alias("pos", "gene"))
    return rows.select(F.lit(library).alias("library"), "term", "gene", "pos")


def corrected_gene_sets(sets: DataFrame, corrections: DataFrame) -> DataFrame:
    """Symbols replaced where a correction (library, term, from_symbol, to_symbol) names them; a null target drops the member."""
    c = corrections.select("library", "term", F.col("from_symbol").alias("gene"), "to_symbol", F.lit(True).alias("hit"))
    return sets.join(c, ["library", "term", "gene"], "left").where("hit is null or to_symbol is not null").select("library", "term", F.coalesce("to_symbol", "gene").alias("gene"), "pos")


# --- checks and sinks -------------------------------------------------------------------------------------------------
def sha256_of(path: str, block: int = 1 << 20) -> str:
    files, own = filesystem(path)
    digest = hashlib.sha256()
    with files.open_input_stream(own) as f:
        while part := f.read(block):
            digest.update(part)
    return digest.hexdigest()


def verify_sha256(path: str, want: str) -> None:
    if (got := sha256_of(path)) != want:
        raise ValueError(f"{path} has SHA-256 {got}, not {want}")


def file_digests(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, sha256) of files of any size: listed by Spark, hashed in pieces by the tasks that open them."""
    listed = spark.read.format("binaryFile").load(pattern).select("path", "length")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(sha256=[sha256_of(p) for p in pdf.path])

    return listed.mapInPandas(run, "path string, length long, sha256 string")


def write_delimited(df: DataFrame, path: str, order: Sequence[str], sep: str = "\t") -> None:
    """One sorted text file with a header, for tables that people read. Large tables go to parquet instead."""
    folder = f"{path}.parts"
    df.orderBy(*[F.asc_nulls_last(c) for c in order]).coalesce(1).write.mode("overwrite").csv(folder, header=True, sep=sep)
    files, own = filesystem(folder)
    if files.get_file_info(filesystem(path)[1]).type != fs.FileType.NotFound:
        files.delete_file(filesystem(path)[1])
    files.move(filesystem(single_match(folder, "part-*.csv"))[1], filesystem(path)[1])
    files.delete_dir(own)


def write_partitioned(df: DataFrame, folder: str, by: Sequence[str]) -> None:
    """One folder per combination of labels, written in one pass; rows are first brought together by label."""
    df.repartition(*by).write.mode("overwrite").partitionBy(*by).parquet(folder)


def long_results(values: DataFrame, samples: DataFrame, assays: DataFrame, sample: str, assay: str) -> DataFrame:
    """Values with the verdict of their sample and assay and one combined status."""
    from tallygrove.operators.relational import checked_join

    s = samples.select(sample, F.col("status").alias("sample_status"))
    a = assays.select(assay, F.col("status").alias("assay_status"))
    out = checked_join(checked_join(values, s, [sample]), a, [assay])
    bad = lambda v: (F.col("sample_status") == v) | (F.col("assay_status") == v)
    return out.withColumn("status", F.when(F.coalesce(bad("FAIL"), F.lit(False)), "FAIL").when(F.coalesce(bad("WARN"), F.lit(False)), "WARN").otherwise("PASS"))


class Publication:
    """A folder that appears complete or not at all: written beside its place, then renamed."""

    def __init__(self, target: str):
        self.target = target.rstrip("/")

    def __enter__(self) -> str:
        head, _, name = self.target.rpartition("/")
        self.stage = f"{head}{'/' if head else ''}.{name}-{uuid.uuid4().hex[:8]}"
        self.files, self.own = filesystem(self.stage)
        self.files.create_dir(self.own)
        return self.stage

    def __exit__(self, kind, *_) -> None:
        if kind is not None:
            self.files.delete_dir(self.own)
            return
        place, old = filesystem(self.target)[1], None
        if self.files.get_file_info(place).type != fs.FileType.NotFound:
            old = f"{self.own}-old"
            self.files.move(place, old)
        self.files.move(self.own, place)
        if old:
            self.files.delete_dir(old)


# --- workbooks --------------------------------------------------------------------------------------------------------
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}  #: fixed value of the format
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(row: ElementTree.Element, shared: Sequence[str]) -> Iterator[tuple[int, str | None]]:
    for c in row.findall("m:c", _NS):
        letters = re.match("[A-Z]+", c.get("r", "A1"))[0]
        at = 0
        for ch in letters:
            at = at * 26 + ord(ch) - 64
        kind, v = c.get("t"), c.find("m:v", _NS)
        if kind == "inlineStr":
            yield at - 1, "".join(t.text or "" for t in c.iter(f"{{{_NS['m']}}}t"))
        elif v is not None:
            yield at - 1, shared[int(v.text)] if kind == "s" else v.text


def read_sheet(spark: SparkSession, path: str, sheet: str, header_row: int = 1, ids: Sequence[str] = ID_COLUMNS) -> DataFrame:
    """A worksheet of a workbook as a table. Workbooks hold at most about a million rows and are parsed on the driver."""
    with zipfile.ZipFile(path) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        target = next((rels[s.get(_REL)] for s in book.find("m:sheets", _NS) if s.get("name") == sheet), None)
        if target is None:
            raise ValueError(f"{path} has no sheet {sheet}")
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        data = ElementTree.fromstring(z.read("xl/" + target.lstrip("/").removeprefix("xl/")))
    rows = [dict(_cells(r, shared)) for r in data.iter(f"{{{_NS['m']}}}row")]
    head = rows[header_row - 1]
    width = max(head) + 1
    names = [head.get(i) or f"column_{i}" for i in range(width)]
    body = [tuple(r.get(i) for i in range(width)) for r in rows[header_row:] if r]
    return typed_text(spark.createDataFrame(body, T.StructType([T.StructField(n, T.StringType()) for n in names])), ids)


def write_workbook(tables: Mapping[str, DataFrame], path: str, limit: int = 1_000_000) -> None:
    """Report tables as sheets of a workbook, the same bytes for the same content. A table beyond `limit` rows is refused."""
    esc = lambda s: str(s).replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")

    def column(i: int) -> str:
        out = ""
        i += 1
        while i:
            i, r = divmod(i - 1, 26)
            out = chr(65 + r) + out
        return out

    def cell(r: int, c: int, v) -> str:
        if v is None:
            return ""
        if isinstance(v, (int, float)) and not isinstance(v, bool) and v == v and abs(v) != float("inf"):
            return f'<c r="{column(c)}{r}"><v>{v!r}</v></c>'
        return f'<c r="{column(c)}{r}" t="inlineStr"><is><t xml:space="preserve">{esc(v)}</t></is></c>'

    parts: dict[str, str] = {}
    kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    for k, (_, df) in enumerate(tables.items(), 1):
        rows = df.limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError("too many rows for a sheet")
        lines = [df.columns, *[tuple(r) for r in rows]]
        body = "".join(f'<row r="{i}">' + "".join(cell(i, j, v) for j, v in enumerate(line)) + "</row>" for i, line in enumerate(lines, 1))
        parts[f"xl/worksheets/sheet{k}.xml"] = f'<worksheet xmlns="{_NS["m"]}"><sheetData>{body}</sheetData></worksheet>'
    n = range(1, len(tables) + 1)
    doc = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    parts["xl/workbook.xml"] = f'<workbook xmlns="{_NS["m"]}" xmlns:r="{doc}"><sheets>' + "".join(f'<sheet name="{esc(t)}" sheetId="{i}" r:id="rId{i}"/>' for i, t in zip(n, tables, strict=True)) + "</sheets></workbook>"
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{doc}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + "</Relationships>"
    parts["_rels/.rels"] = f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{doc}/officeDocument" Target="xl/workbook.xml"/></Relationships>'
    parts["[Content_Types].xml"] = (
        f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{kinds}.sheet.main+xml"/>' + "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kinds}.worksheet+xml"/>' for i in n) + "</Types>"
    )
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts):
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + parts[name])
    with open(path, "wb") as f:
        f.write(buffer.getvalue())


def report_json(path: str, content: Mapping) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(content, f, indent=1, sort_keys=True, default=str)
