"""Standard spellings of subject and tube identifiers, as JVM-side column expressions.

Ids that differ only in case, blanks, kind or absence of separators, dropped leading zeros or the tube prefix get the
same standard spelling: upper case, hyphens, no blanks, ten digits in a tube id and seven in a subject number. Null,
blank and placeholder texts give null. Anything else keeps its letters and digits, upper-cased, with one hyphen
between its parts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Texts that stand for "no id" (fixed values, compared after trimming and upper-casing).
PLACEHOLDERS = ("", "NA", "N/A", "#N/A", "UNKNOWN")

_SEPARATORS = r"[\s\p{Z}\p{Pd}−_/\\.:]+"
_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def _once(value: Column, build) -> Column:
    """`build` over a value that is computed once, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), build), 1)


def _parts(raw: Column) -> Column:
    """Upper-cased letters and digits with one hyphen between their runs of separators; null for placeholders."""
    text = F.upper(F.regexp_replace(raw.cast("string"), _EDGES, ""))
    joined = F.regexp_replace(F.regexp_replace(text, _SEPARATORS, "-"), "^-+|-+$", "")
    return F.when(~text.isin(*PLACEHOLDERS) & (joined != ""), joined)


def standard_tube(raw: Column, digits: int = 10, prefix: str = "TB") -> Column:
    """`TB-` and ten digits for every spelling of a tube id; other ids (pools, controls) keep their parts."""

    def build(parts: Column) -> Column:
        number = F.regexp_replace(F.regexp_replace(F.regexp_extract(parts, f"^(?:{prefix})?([0-9-]+)$", 1), "-", ""), "^0+(?=.)", "")
        return F.when(F.length(number).between(1, digits), F.concat(F.lit(f"{prefix}-"), F.lpad(number, digits, "0"))).otherwise(parts)

    return F.when(raw.rlike(f"^{prefix}-[0-9]{{{digits}}}$"), raw).otherwise(_once(_parts(raw), build))


def standard_subject(raw: Column, site_digits: int = 3, number_digits: int = 7) -> Column:
    """`STUDY-site-number` for every spelling of a subject id; other ids keep their parts."""
    spaced = f"^([A-Z]+)-?([0-9]{{1,{site_digits}}})-([0-9]{{1,{number_digits}}})$"
    packed = f"^([A-Z]+)-?([0-9]{{{site_digits}}})([0-9]{{1,{number_digits}}})$"
    named = "^([A-Z]+?)-?(BRIDGE)-?([0-9]+)$"

    def piece(parts: Column, pattern: str, widths: tuple[int, int, int]) -> Column:
        found = [F.regexp_extract(parts, pattern, i + 1) for i in range(3)]
        return F.concat_ws("-", *[F.lpad(x, w, "0") if w else x for x, w in zip(found, widths, strict=True)])

    def build(parts: Column) -> Column:
        return (
            F.when(parts.rlike(spaced), piece(parts, spaced, (0, site_digits, number_digits)))
            .when(parts.rlike(packed), piece(parts, packed, (0, site_digits, number_digits)))
            .when(parts.rlike(named), piece(parts, named, (0, 0, 4)))
            .otherwise(parts)
        )

    return F.when(raw.rlike(f"^[A-Z]+-[0-9]{{{site_digits}}}-[0-9]{{{number_digits}}}$"), raw).otherwise(_once(_parts(raw), build))


#: The same rules in DuckDB's dialect, for oracles. `{x}` is the column.
SQL_TUBE = (
    "(case when upper(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) in ('', 'NA', 'N/A', '#N/A', 'UNKNOWN') then null "
    "when regexp_full_match(upper(regexp_replace({x}, '[\\s\\p{{Z}}\\p{{Pd}}_/.:]+', '', 'g')), '(TB)?[0-9]+') "
    "then 'TB-' || lpad(ltrim(regexp_replace({x}, '[^0-9]', '', 'g'), '0'), 10, '0') "
    "else trim(regexp_replace(upper(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s\\p{{Z}}\\p{{Pd}}_/.:]+', '-', 'g'), '-') end)"
)
SQL_SUBJECT = (
    "(case when upper(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) in ('', 'NA', 'N/A', '#N/A', 'UNKNOWN') then null "
    "else trim(regexp_replace(upper(regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), '[\\s\\p{{Z}}\\p{{Pd}}_/.:]+', '-', 'g'), '-') end)"
)
