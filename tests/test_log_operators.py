import gzip
import itertools
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir.functions import features as ft
from logweir.functions import scorers as sc
from logweir.operators import causal, clean, label, split
from logweir.operators import evaluate as ev
from logweir.operators import resample as rs
from logweir.schema import RAW_AUTH
from logweir.sources import raw as src
from logweir.sources.shared import written
from logweir.streaming import daily


def events(spark, seed=0, n=300, users=5, hosts=6, span=3 * 86_400, step=60):
    r = random.Random(seed)
    rows = [
        (i, t := r.randrange(0, span, step), t // 86_400, f"u{r.randrange(users)}", f"c{r.randrange(hosts)}", r.choice([None, *(f"h{k}" for k in range(hosts))]), r.choice([None, "k", "n"]), r.random() < 0.8)
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "event_id long, time int, day int, src_user string, src_computer string, dst_computer string, auth_type string, success boolean")


@pytest.mark.parametrize("seed", range(3))
def test_sweep_equals_brute_force(spark, seed):
    df = events(spark, seed)
    rows = df.collect()
    got = {r["event_id"]: (r["d"], r["s"]) for r in causal.sweep_sum(causal.distinct_count(df, "src_user", "dst_computer", 3600, "d"), "src_user", 3600, F.lit(1), "s").collect()}
    for a in rows:
        past = [b for b in rows if b["src_user"] == a["src_user"] and a["time"] - 3600 <= b["time"] < a["time"]]
        assert got[a["event_id"]] == (len({b["dst_computer"] for b in past}), len(past))


def test_window_edges(spark):
    df = spark.createDataFrame([(0, 0, "u"), (1, 3600, "u"), (2, 3601, "u"), (3, 3601, "u")], "event_id long, time int, src_user string")
    got = {r[0]: r[1] for r in causal.rolling_count(df, "src_user", 3600, "n").select("event_id", "n").collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1}  # exactly W before counts, W + 1 does not, the same second does not


def test_future_does_not_matter(spark):
    df = events(spark, 3)
    early = df.filter("time < 150000")
    cols = ["event_id", "pair_global_rarity", "user_auth_rarity", "user_new_host_count_24h", "hour_deviation_from_profile", "src_user_1h_n_events", "src_user_1h_n_distinct_dst"]
    whole = ft.temporal_features(ft.novelty_features(ft.history_features(df), base=df)).filter("time < 150000").select(*cols).orderBy("event_id").collect()
    part = ft.temporal_features(ft.novelty_features(ft.history_features(early), base=early)).select(*cols).orderBy("event_id").collect()
    assert whole == part


def test_fold_and_stream_equal_the_whole(spark, tmp_path):
    """Three ways to all features: the whole log at once, some days at a time, and a stream that is stopped and taken up again."""
    df = written(events(spark, 4).withColumns({"src_domain": F.lit("d"), "dst_domain": F.lit("d"), "dst_user": F.col("src_user")}), "events")
    names = ["pair_is_new", "pair_global_rarity", "user_src_rarity", "src_dst_rarity", "user_auth_rarity", "user_new_host_count_24h", "host_new_user_count_24h", "src_user_1h_n_distinct_dst", "src_user_1d_n_events", "dst_computer_1d_n_failures",
             "hour_deviation_from_profile", "hours_since_prev_event_same_user", "days_since_pair_last_seen", "prev_dst_is_src"]
    values = lambda x: {r["event_id"]: tuple(pytest.approx(v, abs=1e-7) if isinstance(v, float) else v for v in r[1:]) for r in x.select("event_id", *names).collect()}
    whole = ft.temporal_features(ft.novelty_features(ft.history_features(df), base=df))
    expected = {r["event_id"]: tuple(r[1:]) for r in whole.select("event_id", *names).collect()}
    assert values(daily.fold_days(df, step=1)) == expected
    days = sorted(r[0] for r in df.select("day").distinct().collect())
    assert len(days) > 2
    for part, some in (("a", days[:1]), ("b", days[1:])):
        df.filter(F.col("day").isin(some)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        daily.DailyStream(str(tmp_path / "out")).run(stream, str(tmp_path / "cp"))
    assert values(spark.read.parquet(str(tmp_path / "out/features"))) == expected
    again = daily.DailyStream(str(tmp_path / "out"), late="drop")
    again.batch(df, 99)
    assert again.late_rows(spark) == df.count() and values(spark.read.parquet(str(tmp_path / "out/features"))) == expected
    with pytest.raises(ValueError):
        daily.DailyStream(str(tmp_path / "out")).batch(df, 100)


def test_stream_windows(spark, tmp_path):
    rows = [(datetime(2024, 1, 1, h), "u" if h < 12 else "v", h % 3 > 0) for h in range(24)]
    spark.createDataFrame(rows, "ts timestamp, src_user string, success boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("ts timestamp, src_user string, success boolean").parquet(str(tmp_path / "in"))
    for name, query in (("tumbling", daily.windowed_counts(read(), "6 hours")), ("sliding", daily.windowed_counts(read(), "6 hours", slide="3 hours")), ("sessions", daily.sessions(read(), "2 hours"))):
        query.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(tuple(r) for r in spark.sql("select events, failures from tumbling").collect()) == [(6, 2)] * 4
    assert spark.sql("select sum(events) from sliding").first()[0] == 48
    assert sorted(tuple(r) for r in spark.sql("select src_user, n_events from sessions").collect()) == [("u", 12), ("v", 12)]


def test_clean_edges(spark):
    raw = [
        (0, "100", "alice@DOM", "alice@DOM", "C1", "C2", "?", "Network", "LogOn", "Success"),
        (1, "x", "alice@DOM", "bob@DOM", "C1", "C2", "k", None, "LogOn", "Fail"),
        (2, "7", "nodomain", "bob@DOM", "C1", "C2", "k", "?", "LogOn", "Fail"),
        (3, "86401", "PC$@D@E", "bob@D", "C1", "C2", None, "?", "?", "Fail"),
    ]
    df = spark.createDataFrame(raw, "event_id long, " + ", ".join(f"{c} string" for c in RAW_AUTH))
    assert tuple(clean.drop_counts(df).first()) == (4, 1, 1, 2)
    a, b = clean.clean_auth(df, dense=True, offset=10).orderBy("event_id").collect()
    assert (a["event_id"], b["event_id"]) == (10, 11)
    assert (b["src_user"], b["src_domain"], b["src_user_is_machine"], b["day"], b["auth_type_is_null"], b["auth_orientation"]) == ("PC$", "D", True, 1, True, None)
    assert a["auth_type"] is None and a["auth_type_is_null"] and not a["logon_type_is_null"]
    assert clean.clean_auth(df.limit(0)).count() == 0


def test_raw_files(spark, tmp_path):
    lines = "1,a@D,b@D,C1,C2,K,N,LogOn,Success\n2,a@D,b@D,C1,C2,K,N,LogOn,Success,extra,more\n3,a@D,b@D,C1\nx,a@D,b@D,C1,C2,K,N,LogOn,Fail\n"
    (tmp_path / "plain.csv").write_text(lines)
    (tmp_path / "zipped.txt").write_bytes(gzip.compress(lines.encode()))
    plain = src.read_raw(spark, str(tmp_path / "plain.csv"))
    assert plain.count() == 4
    same = src.read_any_compression(spark, str(tmp_path / "zipped.txt"))
    key = lambda r: tuple(x or "" for x in r)
    assert sorted(map(tuple, same.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    numbered = plain.withColumn("event_id", F.monotonically_increasing_id())
    report = src.write_by_day(numbered, str(tmp_path / "out"), "event_id")
    assert (report.rows_in, report.rows_out, report.dropped) == (4, 3, 1)
    src.verify_row_count(report, 4)
    with pytest.raises(src.ExistingOutputError):
        src.write_by_day(numbered, str(tmp_path / "out"), "event_id")
    with pytest.raises(src.RowCountError):
        src.verify_row_count(report, 5)
    assert src.read_days(spark, str(tmp_path / "out"), 0, 0).count() == 3


def test_campaign_gap_does_not_split_at_equality(spark):
    red = spark.createDataFrame([(0, "u", "d", "a", "b"), (86_400, "u", "d", "a", "b"), (172_801, "u", "d", "a", "b")], "time int, user string, domain string, src_computer string, dst_computer string")
    assert [r["campaign"] for r in label.group_into_campaigns(red).orderBy("time").collect()] == ["u#d#1", "u#d#1", "u#d#2"]


def test_split_guards(spark):
    with pytest.raises(ValueError):
        split.ranges_in_seconds({"train": (0, 5), "val": (5, 6), "test": (7, 8)})
    assert split.ranges_in_seconds({"train": (0, 5), "val": (6, 6), "test": (7, 8)})["val"] == (6 * 86_400, 7 * 86_400)
    df = events(spark).withColumn("split", F.lit("train"))
    with pytest.raises(split.LeakageError):
        split.verify_temporal_order(df)
    assert list(split.days_of(86_400, 3 * 86_400)) == [1, 2]


def scored(spark, seed=0):
    r = random.Random(seed)
    rows = [(i, d, r.randrange(0, 86_400, 3600) + d * 86_400, r.random() < 0.1, float(r.randrange(6))) for d in range(3) for i in range(d * 40, d * 40 + 40)]
    rows = [(i, d, t, m, f"c{i % 4}" if m else None, x) for i, d, t, m, x in rows]
    r.shuffle(rows)
    return rows, spark.createDataFrame(rows, "event_id long, day int, time int, is_malicious boolean, campaign string, score double")


@pytest.mark.parametrize("seed", range(2))
def test_ranks_and_metrics(spark, seed):
    rows, df = scored(spark, seed)
    got = {r["event_id"]: r for r in ev.ranked(df).collect()}
    for day in range(3):
        own = sorted((r for r in rows if r[1] == day), key=lambda r: (-r[5], r[2], r[0]))
        for k, r in enumerate(own, 1):
            g = got[r[0]]
            assert g["rank"] == k
            assert g["rank_best"] == 1 + sum(x[5] > r[5] for x in own)
            assert g["rank_worst"] == sum(x[5] >= r[5] for x in own)
    pos, neg = [r[5] for r in rows if r[3]], [r[5] for r in rows if not r[3]]
    m = ev.ranking_metrics(ev.score_levels(df)).first()
    assert m["roc_auc"] == pytest.approx(np.mean([(p > q) + 0.5 * (p == q) for p in pos for q in neg]), abs=1e-8)
    ap = sum(sum(p == t for p in pos) / len(pos) * sum(p >= t for p in pos) / (sum(p >= t for p in pos) + sum(q >= t for q in neg)) for t in set(pos))
    assert m["average_precision"] == pytest.approx(ap, abs=1e-8)


@pytest.mark.parametrize("seed", range(6))
def test_best_tie_recall_is_the_maximum(seed):
    r = random.Random(seed)
    days = {d: [(r.randrange(3), r.choice("abc") if r.random() < 0.5 else None) for _ in range(5)] for d in range(2)}
    for k in (1, 2):
        rows = [(d, c, 1 + sum(x > s for x, _ in own), sum(x >= s for x, _ in own)) for d, own in days.items() for s, c in own if c]
        names = {c for _, c, _, _ in rows}
        if not names:
            continue
        caught = []
        for d, own in days.items():
            options = set()
            for order in itertools.permutations(range(len(own))):
                top = sorted(order, key=lambda i: -own[i][0])[:k]
                options.add(frozenset(own[i][1] for i in top if own[i][1]))
            caught.append(options)
        best = max(len(a | b) for a in caught[0] for b in caught[1]) / len(names)
        assert rs.best_tie_campaign_recall(rows, k) == pytest.approx(best)


def test_statistics():
    assert rs.minimum_resamples(5) == 199
    p, floor = rs.p_value(np.ones(999))
    assert p == pytest.approx(0.002) and floor
    assert "does not" in rs.render_comparison("a", "b", 0.2, False)
    with pytest.raises(ValueError):
        rs.paired_bootstrap({"m": np.array([0])}, {"m": np.array([3])}, np.array(["x"]))
    days = [(50, 2), (40, 1)]
    b = rs.first_detection_quantile(days, 0.5)
    ranks = rs.random_ranking(days, 4000, 1)
    assert abs((ranks <= b).mean() - 0.5) < 0.06


def test_scores_are_row_local(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, *map(float, r.normal(size=3))) for i in range(60)], "event_id long, a double, b double, c double")
    for model in (sc.Ecod(["a", "b", "c"]), sc.Hbos(["a", "b", "c"]), sc.Pca(["a", "b", "c"]), sc.IsolationForest(["a", "b", "c"], trees=10), sc.Lof(["a", "b", "c"], k=5), sc.Autoencoder(["a", "b", "c"], hidden=(4, 2, 4), epochs=2), sc.RandomFloor(1)):
        model.fit(df)
        whole = {r["event_id"]: r["score"] for r in model.score(df).collect()}
        part = {r["event_id"]: r["score"] for r in model.score(df.filter("event_id % 7 = 3")).collect()}
        assert all(whole[k] == v for k, v in part.items()), model.name


def test_frequencies_and_sequences(spark):
    train = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "auth_type string")
    rows = spark.createDataFrame([("a",), (None,), ("z",)], "auth_type string")
    got = {r["auth_type"]: r["f"] for r in ft.encode_frequency(rows, "auth_type", ft.fit_frequencies(train, "auth_type"), "f").collect()}
    assert got == {"a": 0.5, None: 0.25, "z": 0.0}
    df = spark.createDataFrame([(0, 0, "u", "A", "K", True), (1, 5, "u", "Z", None, False), (2, 9, "u", "A", "K", True)], "event_id long, time int, src_user string, dst_computer string, auth_type string, success boolean")
    voc = {"dst_computer": ft.fit_vocabulary(df.filter("dst_computer <> 'Z'"), "dst_computer"), "auth_type": ft.fit_vocabulary(df, "auth_type")}
    got = ft.sequence_features(df, voc, 3).orderBy("event_id").collect()
    assert got[0]["dst_seq"] == [0, 0, 0] and got[2]["dst_seq"] == [0, 3, 1] and got[2]["auth_seq"] == [0, 3, 2] and got[2]["ok_seq"] == [0, 2, 1]


def test_ecod_gathers_counts_not_rows(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.stack([r.integers(0, 2, 5000), r.integers(0, 9, 5000) / 4, -r.exponential(size=5000).round(1)], axis=1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "event_id long, a double, b double, c double").repartition(3)
    most, real = [0], type(df).toPandas
    monkeypatch.setattr(type(df), "toPandas", lambda self: (lambda p: (most.append(len(p)), p)[1])(real(self)))
    model = sc.Ecod(["a", "b", "c"]).fit(df)
    assert max(most) < 200
    got = {q["event_id"]: q["score"] for q in model.score(df).collect()}
    skew = np.sign(((x - x.mean(axis=0)) ** 3).mean(axis=0))
    left = -np.log(((x[None] <= x[:, None]).sum(axis=1) + 1) / 5001)
    right = -np.log(((x[None] >= x[:, None]).sum(axis=1) + 1) / 5001)
    want = np.maximum(np.where(skew < 0, left, right), np.maximum(left, right)).sum(axis=1)
    assert (skew != 0).all() and all(got[i] == pytest.approx(w, abs=1e-9) for i, w in enumerate(want))


def test_large_samples_are_the_rows_of_least_hash(spark, monkeypatch):
    df = spark.range(3000).withColumnRenamed("id", "event_id")
    want = {r[0] for r in split.sample_for_fit(df, 1234, 5).collect()}
    monkeypatch.setattr(split, "MOST_ORDERED", 10)
    large = split.sample_for_fit(df, 1234, 5)
    assert {r[0] for r in large.collect()} == want and len(want) == large.count() == 1234
    assert split.sample_for_fit(df, 5000, 5).count() == 3000
