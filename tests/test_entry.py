import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_stands_alone():
    code = "import sys; sys.modules['braidlake.llm'] = None; import __spark_entry__ as e; assert e.llm is None and e.queries(); import braidlake.plans.ask, braidlake.streaming.ingest"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the small test data")
def test_flagship(spark):
    assert entry.entry(spark).limit(1).count() == 1
