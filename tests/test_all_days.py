"""Queries over every day of their table, against their SQL."""

from pathlib import Path

import duckdb
import pytest

from logweir.functions import features as ft
from logweir.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["bipartite_clustering", "pagerank_fixed_iter"])
def test_every_day(spark, name):
    found = catalog.queries()[name](spark, DIR)
    con = duckdb.connect()
    sql = catalog.oracle_sql()[name]
    for t in ("events", "orders", "lineitem", "customer", "labels", "documents", "supplier", "nation", "region", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet{'/*.parquet' if Path(DIR, f'{t}.parquet').is_dir() else ''}')")
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM ({sql})").fetchall()
    key = lambda r: tuple(str(x) for x in r if not isinstance(x, float))
    got = sorted((tuple(r) for r in found.collect()), key=key)
    want.sort(key=key)
    assert len(got) == len(want) and len({r[found.columns.index("day")] for r in got}) > 5
    for g, w in zip(got, want):
        assert all(a == (pytest.approx(b, abs=2e-9, rel=1e-9) if isinstance(b, float) else b) for a, b in zip(g, w))


def test_communities_join_users_and_their_machines(spark):
    rows = [(day, f"{g}{i}", f"{g}{j}", 3) for day in (0, 20) for g in "abc" for i in range(4) for j in range(3)] + [(0, "a0", "b0", 1), (0, "b0", "c0", 1), (20, "solo", "own", 2)]
    edges = spark.createDataFrame(rows, "day int, user string, machine string, weight long")
    found = {(x["day"], x["node"]): x["community"] for x in ft.communities(edges).collect()}
    assert found == {(day, f"{side}:{n}"): "m:own" if n in ("solo", "own") else f"m:{n[0]}0" for day, user, machine, _ in rows for side, n in (("u", user), ("m", machine))}


def test_communities_of_every_day(spark):
    days = lambda name: {x["day"] for x in catalog.queries()[name](spark, DIR).select("day").distinct().collect()}
    assert days("communities") == days("trailing_degree_7d")
