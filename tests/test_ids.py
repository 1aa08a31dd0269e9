import pytest
from pyspark.sql import functions as F

from tallygrove.functions.ids import standard_subject, standard_tube

TUBES = {
    "TB-0012345678": "TB-0012345678",
    " tb-0012345678\t": "TB-0012345678",
    "TB0012345678": "TB-0012345678",
    "TB_0012345678": "TB-0012345678",
    "TB–0012345678": "TB-0012345678",
    "TB-00123 45678": "TB-0012345678",
    "0012345678": "TB-0012345678",
    "12345678": "TB-0012345678",
    "TB-12345678": "TB-0012345678",
    "POOL-CAL-01": "POOL-CAL-01",
    "pool cal_01": "POOL-CAL-01",
    "TB-123456789012": "TB-123456789012",
    "": None,
    "  ": None,
    "NA": None,
    "n/a": None,
    "#N/A": None,
    "Unknown": None,
    "--": None,
    None: None,
}
SUBJECTS = {
    "GLX-101-0000123": "GLX-101-0000123",
    "glx-101-0000123": "GLX-101-0000123",
    "GLX/101/0000123": "GLX-101-0000123",
    "GLX 101 0000123 ": "GLX-101-0000123",
    "GLX–101–0000123": "GLX-101-0000123",
    "GLX1010000123": "GLX-101-0000123",
    "GLX-101-123": "GLX-101-0000123",
    "GLX-1-123": "GLX-001-0000123",
    "GLX-BRIDGE-0001": "GLX-BRIDGE-0001",
    "glx_bridge_0001": "GLX-BRIDGE-0001",
    "GLXBRIDGE1": "GLX-BRIDGE-0001",
    "unknown": None,
    "": None,
    None: None,
}


@pytest.mark.parametrize("rule,cases", [(standard_tube, TUBES), (standard_subject, SUBJECTS)])
def test_spellings(spark, rule, cases):
    rows = spark.createDataFrame([(k,) for k in cases], "x string").select("x", rule(F.col("x")).alias("y")).collect()
    assert {r.x: r.y for r in rows} == cases
