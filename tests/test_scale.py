"""Work that grows with the input, not with the square of a group."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions import features as ft
from logweir.functions import scorers as sc
from logweir.functions import walks
from logweir.operators import causal


def test_entropy_without_pairs(spark, monkeypatch):
    r = np.random.default_rng(1)
    pick = lambda xs: xs[int(r.integers(len(xs)))]
    rows = [(i, int(r.integers(0, 400)) if i % 3 else 200, pick(["A", "B", None]), pick(["u", "v", "w", "x", None]), pick(["K", "N", None])) for i in range(600)]
    df = spark.createDataFrame(rows, "event_id long, time int, dst_computer string, src_user string, auth_type string")

    def refuse(*a, **k):
        raise AssertionError("one row a pair of events")

    monkeypatch.setattr(causal, "prior_events", refuse)
    got = {x["event_id"]: (x["entropy"], x["n_auth_types"]) for x in causal.distribution_stats(df, "dst_computer", "src_user", 60).collect()}
    assert len(got) == len(rows)
    for i, t, host, _, _ in rows:
        past = [x for x in rows if host is not None and x[2] == host and t - 60 <= x[1] < t]
        h = -sum(n / len(past) * math.log(n / len(past)) for n in Counter(x[3] for x in past).values())
        assert got[i] == (pytest.approx(max(h, 0), abs=2e-9), len({x[4] for x in past}))


@pytest.mark.parametrize("cost", [0, 50])
def test_clustering_by_blocks_and_by_join(spark, monkeypatch, cost):
    r = np.random.default_rng(2)
    sets = {(day, f"u{i}"): set(r.choice(9, int(r.integers(1, 6)), replace=False).tolist()) for day in (1, 2) for i in range(40)}
    sets[1, "lone"], sets[1, None], sets[1, "unknown"] = {77}, {1, 2}, {None}
    sets[2, "part"] = {None, 3}
    edges = spark.createDataFrame([(d, u, None if m is None else f"m{m}") for (d, u), ms in sets.items() for m in ms], "day int, user string, machine string")
    monkeypatch.setattr(ft, "ROW_COST", cost)
    monkeypatch.setattr(ft, "BLOCK", 16)
    monkeypatch.setattr(ft, "TILE", 5)
    real, dense = ft._overlap_blocks, []
    monkeypatch.setattr(ft, "_overlap_blocks", lambda c, b: (dense.append(b), real(c, b))[1])
    got = {(x["day"], x["user"]): x["clustering"] for x in ft.bipartite_clustering(edges).collect()}
    assert got.keys() == sets.keys() and bool(dense) == bool(cost)
    for (day, user), own in sets.items():
        known = own - {None}
        near = [s for (d, u), s in sets.items() if d == day and u not in (None, user) and known & (s - {None})] if user else []
        j = [len(known & s) / (len(own) + len(s) - len(known & s)) for s in near]
        assert got[day, user] == pytest.approx(sum(j) / len(j) if j else 0, abs=2e-9), (day, user)


def test_graph_features_make_each_part_once(spark, monkeypatch):
    runs = spark.sparkContext.accumulator(0)

    def counted(links):
        runs.add(1)
        return louvain(links)

    louvain = ft.louvain
    monkeypatch.setattr(ft, "louvain", counted)
    rows = [(i, d, f"u{i % 5}", f"m{i % 3}") for i, d in enumerate([0, 1, 2] * 20)]
    found = ft.attach_graph_features(spark.createDataFrame(rows, "event_id long, day int, src_user string, dst_computer string")).collect()
    assert len(found) == len(rows) and {x["user_graph_degree"] for x in found if x["day"] == 0} == {0}
    assert runs.value == 2  # days 1 and 2 have a graph before them


def test_attached_pagerank_is_settled(spark):
    r = np.random.default_rng(6)
    rows = [(i, i % 3, None if i % 41 == 0 else f"u{int(r.integers(0, 20) ** 2 / 20)}", None if i % 29 == 0 else f"m{int(r.integers(0, 7) ** 2 / 7)}") for i in range(400)]
    rows += [(1000 + i, 0, "alone", f"own{i}") for i in range(30)]
    found = ft.attach_graph_features(spark.createDataFrame(rows, "event_id long, day int, src_user string, dst_computer string")).collect()
    ranks = {}
    for day in (1, 2):
        edges = [("u:" + str(u), "m:" + str(m)) for _, d, u, m in rows if d < day]
        nodes = sorted({n for e in edges for n in e})
        w = np.zeros((len(nodes), len(nodes)))
        for e in edges:
            a, b = map(nodes.index, e)
            w[a, b] += 1
            w[b, a] += 1
        share = w / w.sum(axis=1, keepdims=True)
        ranks[day] = dict(zip(nodes, np.linalg.solve(np.eye(len(nodes)) - 0.85 * share.T, np.full(len(nodes), 0.15 / len(nodes)))))
    assert len(found) == len(rows)
    for x in found:
        of_day = ranks.get(x["day"], {})
        for side, name in (("user", "src_user"), ("host", "dst_computer")):
            want = of_day.get(f"{side[0].replace('h', 'm')}:{x[name]}", 0) if x[name] is not None else 0
            assert x[f"{side}_graph_pagerank"] == pytest.approx(want, abs=2e-9)


def test_ecod_counts_all_rows_of_columns_with_many_values(spark, monkeypatch):
    r = np.random.default_rng(8)
    x = np.stack([r.normal(size=700), -r.exponential(size=700), r.integers(0, 3, 700)], axis=1).round(2)
    x[::50, 0] = np.nan
    rows = [(i, None if i == 50 else float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)]
    df = spark.createDataFrame(rows, "event_id long, a double, b double, c double").repartition(3)
    whole = {q["event_id"]: q["score"] for q in sc.Ecod(["a", "b", "c"]).fit(df).score(df).collect()}
    monkeypatch.setattr(sc, "GATHERED", 20)
    model = sc.Ecod(["a", "b", "c"]).fit(df)
    assert model.wide == [0, 1] and [len(v) for v, _ in model.levels] == [0, 0, 3]
    found = model.score(df.filter("event_id % 3 <> 1"))
    assert found.columns == ["event_id", "a", "b", "c", "score"]
    got = {q["event_id"]: q["score"] for q in found.collect()}
    assert got.keys() == {i for i in range(700) if i % 3 != 1} and all(whole[i] == v for i, v in got.items())


def test_models_of_the_store_are_fitted_on_all_rows(spark, monkeypatch):
    def refuse(*a, **k):
        raise AssertionError("fitted on a sample")

    monkeypatch.setattr(sc, "sample_for_fit", refuse)
    monkeypatch.setattr(sc, "PART_ROWS", 100, raising=False)
    r = np.random.default_rng(9)
    data = r.normal(size=(1000, 2)).round(3)
    data[:, 1] = np.arange(1000)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(data)], "event_id long, a double, b double").repartition(3)
    sc.Ecod(["a", "b"]).fit(df)
    forest = sc.IsolationForest(["a", "b"], trees=40, rows=64)
    drawn = forest.drawn(df, 1000)
    assert len(drawn) == 40 and all(len(set(x[:, 1])) == 64 for x in drawn)
    share = len({v for x in drawn for v in x[:, 1]}) / 1000
    assert abs(share - (1 - (1 - 0.064) ** 40)) < 0.04  # as many as trees that draw from all rows independently meet
    assert all((x == y).all() for x, y in zip(drawn, forest.drawn(df.repartition(5), 1000)))
    assert sorted(forest.drawn(df.limit(9), 9)[3][:, 0]) == sorted(x["a"] for x in df.limit(9).collect())
    rows = sc.Shuffled(df, ["a", "b"], 0)
    mean, scale = rows.moments()
    assert np.allclose(mean, data.mean(axis=0)) and np.allclose(scale, data.std(axis=0))
    turns = []
    for turn in (0, 1):
        batches = list(rows.batches(turn, 64))
        assert [len(b) for b in batches] == [64] * 15 + [40]
        turns.append(np.concatenate(batches)[:, 1].tolist())
        assert sorted(turns[-1]) == list(range(1000)) and turns[-1] != sorted(turns[-1])
    assert turns[0] != turns[1]
    assert np.concatenate(list(sc.Shuffled(df.repartition(7), ["a", "b"], 0).batches(0, 64)))[:, 1].tolist() == turns[0]
    model = sc.Autoencoder(["a", "b"], (4, 1, 4), epochs=2).fit(df)
    assert np.allclose(model.mean, data.mean(axis=0))


def test_steps_of_walks_read_few_arcs(spark):
    rows = [(f"u{i}", f"m{m}", 1 + (i * m) % 5 + 1000 * (i == 7)) for i in range(300) for m in range(1 + i % 3)]
    edges = spark.createDataFrame(rows, "user string, machine string, weight long")
    lists, _ = walks.dealt_arcs(edges)
    mean = lists.groupBy("a").agg(F.avg(F.size("near")).alias("mean"))
    assert mean.filter("mean > 4.01").count() == 0
    links = {}
    for u, m, w in rows:
        links.setdefault(f"u:{u}", {})[f"m:{m}"] = w
        links.setdefault(f"m:{m}", {})[f"u:{u}"] = w
    found = walks.random_walks(edges, 4, 2, 3)
    draws = [F.pmod(F.xxhash64("walk", F.lit(i), F.lit(3)), F.lit(1_000_000)).alias(f"d{i}") for i in range(3)]
    found = found.select("nodes", *draws).collect()
    assert len(found) == 2 * len(links)
    for x in found:
        for i in range(3):
            near = links[x["nodes"][i]]
            draw, run = x[f"d{i}"] / 1_000_000 * sum(near.values()), 0
            for b in sorted(near):
                run += near[b]
                if run > draw:
                    break
            assert x["nodes"][i + 1] == b
