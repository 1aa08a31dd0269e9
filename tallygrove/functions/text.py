"""Text and date helpers as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def arm_name(raw: Column) -> Column:
    """Arm label as a safe name: slashes become underscores, a blank before a number a hyphen, other blanks underscores."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(raw), r"\s*/\s*", "_"), r"\s+(?=[0-9])", "-"), r"\s+", "_")


def group_key(columns: Sequence[Column], sep: str = "|") -> Column:
    """Parts joined by a separator; null if any part is."""
    parts: list[Column] = []
    for c in columns:
        parts += [c.cast("string"), F.lit(sep)]
    return F.concat(*parts[:-1])


def term_label(raw: Column) -> Column:
    """Gene-set term as a label: without collection prefix and trailing database id, underscores as blanks; all-capitals in sentence case."""
    text = F.regexp_replace(F.regexp_replace(raw, r"^(HALLMARK|KEGG|REACTOME|GOBP|WP)_", ""), r"\s*\((GO:|R-HSA-|WP)[^)]*\)\s*$", "")
    text = F.trim(F.regexp_replace(text, "_+", " "))
    return F.when(F.upper(text) == text, F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))).otherwise(text)


def p_text(p: Column, digits: int = 3) -> Column:
    """P value for print: `<0.001` below the last digit, else fixed decimals; null and NaN as a dash."""
    least = 10.0**-digits
    return F.when(p.isNull() | F.isnan(p), F.lit("-")).when(p < least, F.lit(f"<{least:.{digits}f}")).otherwise(F.format_string(f"%.{digits}f", p))


def mean_sd(mean: Column, sd: Column, digits: int = 1) -> Column:
    return F.when(mean.isNotNull(), F.concat(F.format_string(f"%.{digits}f", mean), F.lit(" ("), F.when(sd.isNotNull(), F.format_string(f"%.{digits}f", sd)).otherwise("-"), F.lit(")")))


def count_share(n: Column, total: Column, digits: int = 1) -> Column:
    return F.format_string(f"%d (%.{digits}f%%)", n, F.coalesce(F.try_divide(n * 100.0, total), F.lit(0.0)))


def seq_id(raw: Column) -> Column:
    """`10000-28` for spellings such as `seq.10000.28`, `SeqId_10000_28` or `10000-28_3`; null if there is none."""
    number, part = F.regexp_extract(raw, r"([0-9]{4,6})[._-]([0-9]{1,4})", 1), F.regexp_extract(raw, r"([0-9]{4,6})[._-]([0-9]{1,4})", 2)
    return F.when(number != "", F.concat_ws("-", number, part))


def any_date(raw: Column, formats: Sequence[str] = ("yyyy-MM-dd", "ddMMMyyyy", "dd/MM/yyyy", "yyyyMMdd")) -> Column:
    """The first format that reads the text; null if none does. Two-digit years are no year."""
    tidy = F.initcap(F.lower(F.trim(raw)))
    tries = [F.to_date(F.try_to_timestamp(F.regexp_replace(tidy, r"^([0-9]{2})([A-Za-z]{3})([0-9]{4})$", "$1$2$3") if "MMM" in f else F.trim(raw), F.lit(f))) for f in formats]
    return F.coalesce(*tries)


def digit_changes(a: Column, b: Column) -> Column:
    """In how many of the eight digits yyyyMMdd two dates differ; null if either is."""
    x, y = F.date_format(a, "yyyyMMdd"), F.date_format(b, "yyyyMMdd")
    return F.when(a.isNotNull() & b.isNotNull(), sum((F.substring(x, i, 1) != F.substring(y, i, 1)).cast("int") for i in range(1, 9)))


def chromosome(raw: Column) -> Column:
    """`1` to `22`, `X`, `Y`, `MT` for spellings such as `chr1`, `01`, `23`, `chrM`."""
    text = F.regexp_replace(F.upper(F.trim(raw)), "^CHR(OM(OSOME)?)?_?", "")
    text = F.regexp_replace(text, "^0+(?=[0-9])", "")
    return F.when(text.isin("23"), F.lit("X")).when(text.isin("24"), F.lit("Y")).when(text.isin("M", "25", "26", "MT"), F.lit("MT")).otherwise(text)


def digest(raw: Column) -> Column:
    """SHA-256 of an id, so that corrections can name it without holding it."""
    return F.sha2(F.trim(raw), 256)
