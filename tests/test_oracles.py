"""Every query with an oracle, against DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

from marginalia.plans import catalog

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v: object) -> object:
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def ducks() -> dict[str, duckdb.DuckDBPyConnection]:
    cons = {sf: duckdb.connect() for sf in (SF, LARGER)}
    for sf, con in cons.items():
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return cons


@pytest.mark.parametrize(("name", "sf"), [*((n, SF) for n in sorted(catalog.QUERIES)), *((n, LARGER) for n in sorted(catalog.QUERIES) if n.startswith("search_"))])
def test_query(name, sf, spark, ducks):
    duck, df = ducks[sf], catalog.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    own = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    assert own, "an empty result proves nothing"
    if name in catalog.ORACLES:
        run = duck.execute(catalog.ORACLES[name])
        places = [[d[0] for d in run.description].index(c) for c in columns]
        assert own == sorted((tuple(plain(r[i]) for i in places) for r in run.fetchall()), key=repr)
