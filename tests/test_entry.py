"""The driver's contract where the subpackage or what it needs is absent, and the session's shared folder."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys, warnings
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in {names}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Absent())
warnings.simplefilter("always")
import __spark_entry__ as entry
print(len(entry.queries()), any(n.startswith("p2_") for n in entry.queries()))
"""


def run(names):
    return subprocess.run([sys.executable, "-c", BLOCK.format(names=names)], cwd=ROOT, capture_output=True, text=True)


@pytest.mark.parametrize("names", [{"minegrove.llm", "minegrove.llm.queries"}, {"ahocorasick"}, {"regex"}])
def test_the_rest_stays_without_the_subpackage(names):
    done = run(names)
    count, has = done.stdout.split()
    assert int(count) > 40 and has == "False"
    assert ("left out" in done.stderr) == (not any(n.startswith("minegrove") for n in names))


def test_what_the_core_needs_is_not_skipped():
    done = run({"minegrove.functions.ids"})
    assert done.returncode and "minegrove.functions.ids" in done.stderr


CLEAR = """
import os
from minegrove import session
spark = session.local_session(cpus=1, partitions=1, memory="1g")
kept = session.cut_lineage(spark.range(10).toDF("id"))
folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
assert [name for name in os.listdir(folder) if name.startswith("rdd-")], os.listdir(folder)
session.clear_checkpoints(spark)
assert os.listdir(folder) == [], os.listdir(folder)
assert session.cut_lineage(spark.range(3).toDF("id")).count() == 3
"""


def test_checkpoints_are_cleared():
    """In an application of its own, as the tests' other results must stay."""
    subprocess.run([sys.executable, "-c", CLEAR], cwd=ROOT, check=True)
