"""Tables with their ids in standard spelling, and the same for oracle SQL: what links rows must not depend on how an id is written."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallygrove.functions.ids import SQL_SUBJECT, SQL_TUBE, standard_subject, standard_tube
from tallygrove.sources import tables

_SUBJECT, _TUBE = (standard_subject, SQL_SUBJECT), (standard_tube, SQL_TUBE)

#: Id columns of the tables that hold ids.
IDS = {
    "adsl": {"usubjid": _SUBJECT},
    "manifest": {"usubjid": _SUBJECT, "sampleid": _TUBE},
    "visit_records": {"usubjid": _SUBJECT},
    "model_frame": {"group_key": _SUBJECT, "sample_ids": _TUBE},
    "king_pairs": {"usubjid_1": _SUBJECT, "usubjid_2": _SUBJECT},
    "genomes": {"geno_usubjid": _SUBJECT},
    "soma_long": {"sampleid": _TUBE},
    "olink_long": {"sampleid": _TUBE},
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table with its id columns in standard spelling (null where there is no id)."""
    return tables.table(spark, folder, name).withColumns({c: standard(F.col(c)) for c, (standard, _) in IDS.get(name, {}).items()})


def sql(text: str) -> str:
    """Oracle SQL in which every such table is read with its ids in standard spelling."""

    def swap(m: re.Match) -> str:
        ids = ", ".join(f"{rule.format(x=c)} as {c}" for c, (_, rule) in IDS[m[2]].items())
        return f"{m[1]} (select * replace ({ids}) from {m[2]})"

    return re.sub(rf"\b(from|join) ({'|'.join(IDS)})\b", swap, text)
