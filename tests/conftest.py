import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SMALL):
        pytest.skip("no test tables")
    c = duckdb.connect()
    for p in sorted(Path(SMALL).glob("*.parquet")):
        c.sql(f"create view {p.stem} as select * from '{p}'")
    return c


def _plain(v):
    return 0.0 if isinstance(v, float) and v == 0 else v


def same(df, relation) -> None:
    """Equal columns and rows, whatever their order."""
    names = sorted(df.columns)
    assert names == sorted(relation.columns)
    at = [relation.columns.index(n) for n in names]
    got = sorted(repr([_plain(r[n]) for n in names]) for r in df.collect())
    want = sorted(repr([_plain(r[i]) for i in at]) for r in relation.fetchall())
    assert len(got) == len(want)
    assert got == want


@pytest.fixture(scope="session")
def compare():
    return same
