import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from kinegrid.session import local_session, ship

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    ship(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same_rows(got, want):
    """Equal as bags of rows, columns by name, doubles to nine places."""
    import pandas as pd

    assert sorted(got.columns) == sorted(want.columns)
    names = sorted(got.columns)

    def rows(frame):
        out = []
        for row in frame[names].astype(object).itertuples(index=False):
            out.append(tuple("null" if pd.isna(v) else f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in row))
        return sorted(out)

    assert rows(got) == rows(want)
