import json
import os
import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from tallygrove.session import Stash, is_local, shared_dir

ROOT = str(Path(__file__).resolve().parents[1])
PROBE = """
import json
from tallygrove.session import get_spark, Stash
spark = get_spark(2)
kept = Stash(spark)
kept.keep(spark.range(3))
names = ("spark.sql.shuffle.partitions", "spark.master", "spark.sql.adaptive.enabled", "spark.driver.memory", "spark.sql.session.timeZone")
print(json.dumps({n: spark.conf.get(n, None) for n in names} | {"root": kept.root}))
spark.stop()
"""


def probe(submitted: str) -> dict:
    env = {**os.environ, "PYSPARK_SUBMIT_ARGS": f"{submitted} pyspark-shell", "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", PROBE], env=env, capture_output=True, text=True, timeout=180, check=True)
    return json.loads(done.stdout.strip().splitlines()[-1])


def test_submitted_settings_win():
    got = probe("--conf spark.sql.shuffle.partitions=2000 --conf spark.sql.adaptive.enabled=false --driver-memory 1g")
    assert (got["spark.sql.shuffle.partitions"], got["spark.sql.adaptive.enabled"], got["spark.driver.memory"]) == ("2000", "false", "1g")
    assert got["spark.master"] == "local[2]" and got["spark.sql.session.timeZone"] == "UTC"
    assert not os.path.exists(got["root"])  # stashes go with the application


def test_cluster_keeps_its_partition_count():
    got = probe("--master local-cluster[1,1,900] --conf spark.executor.memory=900m --conf spark.checkpoint.dir=/tmp/tallygrove-probe")
    assert got["spark.master"] == "local-cluster[1,1,900]" and got["spark.sql.shuffle.partitions"] in (None, "200")


def test_shared_folder_must_be_named_on_a_cluster():
    assert is_local("local") and is_local("local[4]") and not is_local("yarn") and not is_local("local-cluster[2,1,1024]")
    bare = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(bare)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        Stash(bare)
    assert shared_dir(SimpleNamespace(conf={"spark.checkpoint.dir": "/shared/x/"}, sparkContext=bare.sparkContext)) == "/shared/x"
