from __future__ import annotations

import os
import tempfile

import duckdb
import pytest

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    from sessionweave.session import get_spark

    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    scratch = tempfile.mkdtemp(prefix="spark-test-")
    session = get_spark("tests", "local[4]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false", spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__sql__warehouse__dir=f"{scratch}/warehouse", spark__checkpoint__dir=f"file://{scratch}/shared")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def oracle(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")

    def run(sql: str) -> tuple[list[str], list[tuple]]:
        result = con.execute(sql)
        return [c[0] for c in result.description], result.fetchall()

    return run


def plain(value: object) -> str:
    if isinstance(value, (list, tuple)):
        return str([plain(v) for v in value])
    return repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same_rows(oracle):
    """Compares a DataFrame with SQL, columns by name and rows in any order."""

    def compare(df, sql: str) -> None:
        names, rows = oracle(sql)
        assert sorted(df.columns) == sorted(names)
        order = sorted(names)
        found = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
        wanted = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
        assert found == wanted

    return compare
