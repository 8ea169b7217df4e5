import math
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

from sightline.session import session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", spark__sql__shuffle__partitions="4", spark__ui__showConsoleProgress="false", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def canonical(v):
    """Values as text, so that rows of two engines can be compared: floats at five places."""
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else f"{float(v):.5f}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(canonical, v)) + "]"
    return str(v)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(name, query, sql):
        df = query(spark, SF)
        columns = sorted(df.columns)
        got = sorted(tuple(map(canonical, r)) for r in df.select(*columns).collect())
        found = duck.execute(sql)
        names = [c[0] for c in found.description]
        assert sorted(names) == columns, name
        places = [names.index(c) for c in columns]
        want = sorted(tuple(canonical(r[i]) for i in places) for r in found.fetchall())
        assert got == want, name

    return check
