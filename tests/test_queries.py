"""Every core query against its SQL; those without SQL must run and keep their invariants elsewhere."""

from importlib import import_module

import __spark_entry__ as entry
import pytest

from .compare import assert_same

MODULES = [import_module(f"minegrove.plans.{name}") for name in entry.CORE]
QUERIES = {name: q for m in MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in MODULES for name, s in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, duck, data):
    assert_same(QUERIES[name](spark, data), duck.sql(SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_import_the_subpackage():
    import subprocess
    import sys

    code = "import sys\n" + "".join(f"import minegrove.plans.{n}\n" for n in entry.CORE) + "import minegrove.sinks, minegrove.streaming.live\n"
    code += "assert not any(m.startswith('minegrove.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True)
