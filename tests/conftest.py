import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from siftwell.session import get_session

    warehouse = tempfile.mkdtemp(prefix="siftwell-test-")
    session = get_session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": warehouse, "spark.ui.showConsoleProgress": "false"})
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_SMALL


@pytest.fixture
def same_as_duckdb(spark, sf_dir):
    """Run a registered query and its SQL; compare the rows as multisets."""
    import duckdb

    def compare(query, sql, d=sf_dir):
        con = duckdb.connect()
        con.execute("SET TimeZone='UTC'")
        for p in Path(d).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        want_rel = con.sql(sql)
        got = query(spark, d)
        cols = sorted(got.columns)
        assert cols == sorted(want_rel.columns)
        norm = lambda v: round(v, 6) if isinstance(v, float) else v.isoformat() if hasattr(v, "isoformat") else v if isinstance(v, (int, str, bool, type(None))) else str(v)
        rows = sorted((tuple(norm(r[c]) for c in cols) for r in got.collect()), key=str)
        at = {c: i for i, c in enumerate(want_rel.columns)}
        want = sorted((tuple(norm(r[at[c]]) for c in cols) for r in want_rel.fetchall()), key=str)
        assert len(rows) == len(want)
        assert rows == want
        return rows

    return compare
