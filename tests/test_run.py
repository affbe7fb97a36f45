"""Stages, sinks, summaries and explanations on made-up logs."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from logweir import cli
from logweir.functions import explain, tuning
from logweir.functions import scorers as sc
from logweir.operators import evaluate as ev
from logweir.operators import ordered, summary
from logweir.operators import resample as rs
from logweir.plans import stages
from logweir.sources import demo, raw, sinks

CONFIG = {"train": [0, 3], "val": [4, 5], "test": [6, 7], "candidates": 2}


def test_demo_from_text_to_results(spark, tmp_path):
    """Every stage by its command, from a raw text log to summaries, ledgers, cards and comparisons."""
    out = str(tmp_path)
    log = demo.demo_log(spark, days=8, users=12, hosts=20, per_day=60)
    log.orderBy("event_id").drop("event_id").write.csv(f"{out}/auth")
    demo.demo_redteam(log).write.csv(f"{out}/redteam")
    assert cli.main(["to-parquet", f"{out}/auth", f"{out}/interim", "--expect-rows", str(log.count())], spark) == 0
    with pytest.raises(raw.ExistingOutputError):
        cli.main(["to-parquet", f"{out}/auth", f"{out}/interim"], spark)
    config = cli.config_of(json.dumps(CONFIG))
    store = stages.build_features(spark, f"{out}/interim", f"{out}/redteam", f"{out}/features", config)
    assert store.endswith(config.version())
    rows = spark.read.parquet(store)
    assert rows.filter("is_malicious").count() == demo.demo_redteam(log).count()
    result = stages.train_eval(spark, store, f"{out}/results", config, ["m0b_always_fail", "m1_rules"], rounds=200)
    got = {(r["model"], r["metric"], r["budget"]): r["value"] for r in result.collect()}
    assert set(m for m, _, _ in got) == {"m0b_always_fail", "m1_rules"}
    assert got["m1_rules", "average_precision", None] >= got["m0b_always_fail", "average_precision", None]
    assert got["m1_rules", "event_recall", 500] == 1.0
    ledger = spark.read.option("header", True).option("nullValue", sinks.NULL).csv(f"{out}/results/m1_rules/ledger")
    assert ledger.count() == rows.filter("day >= 6 and is_malicious").count() and ledger.filter("user is null").isEmpty()
    assert spark.read.parquet(f"{out}/results/m1_rules/cards").filter(F.contains("card", F.lit("### Alert"))).count() == 6
    with pytest.raises(summary.ScoreError):
        summary.require_scores(spark.read.parquet(store).withColumn("score", F.lit(None).cast("double")), [6])


def test_settings_that_cannot_work_are_refused():
    for bad in ({"history": "other"}, {"regime": "R3"}, {"universe": "x"}, {"train": [0, 5], "val": [5, 6], "test": [7, 8]}):
        with pytest.raises(ValueError):
            cli.config_of(json.dumps(bad))
    assert cli.config_of("{}").version() != cli.config_of(json.dumps(CONFIG)).version()


def test_preflight(capsys, tmp_path):
    assert cli.main(["preflight", "--events", "1000", "--largest-day", "100", "--path", str(tmp_path)]) == 0
    assert json.loads(capsys.readouterr().out) == {"disk_bytes": 113_900, "memory_bytes": 87_200}


def test_copy_goes_on_where_it_stopped(tmp_path):
    data = np.random.default_rng(1).bytes(100_000)
    (tmp_path / "a").write_bytes(data)
    (tmp_path / "b.part").write_bytes(data[:40_000])
    raw.copy_with_resume(str(tmp_path / "a"), str(tmp_path / "b"), hashlib.sha256(data).hexdigest())
    assert (tmp_path / "b").read_bytes() == data
    with pytest.raises(ValueError):
        raw.copy_with_resume(str(tmp_path / "a"), str(tmp_path / "c"), "0" * 64)
    (tmp_path / "d.lock").touch()
    with pytest.raises(FileExistsError):
        raw.copy_with_resume(str(tmp_path / "a"), str(tmp_path / "d"))


def test_line_blocks(tmp_path):
    (tmp_path / "t").write_bytes(b"aa\nbbbb\n" + b"c" * 50 + b"\nd")
    blocks = list(raw.line_blocks(str(tmp_path / "t"), 8))
    assert b"".join(blocks) == (tmp_path / "t").read_bytes() and all(b.endswith(b"\n") for b in blocks[:-1])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, None, 0.5), (2, "", None), (3, "a,\"b\"", 1.0)], "i long, s string, x double")
    sinks.write_csv(df, str(tmp_path / "c"))
    assert sorted(sinks.read_csv(spark, str(tmp_path / "c"), df.schema).collect()) == sorted(df.collect())
    sinks.write_json(df, str(tmp_path / "j"))
    assert sorted(spark.read.schema(df.schema).json(str(tmp_path / "j")).collect()) == sorted(df.collect())
    tracker = sinks.Tracker(spark, str(tmp_path / "runs"))
    tracker.log("config", b=2, a=1)
    assert [r["record"] for r in tracker.records().collect()] == ['{"a": 1, "b": 2}']
    sinks.Tracker(spark, None).log("nothing")


def test_running_sums_in_ranges(spark):
    r = np.random.default_rng(2)
    values = np.unique(r.normal(size=500))
    df = spark.createDataFrame([(float(v), int(i % 7)) for i, v in enumerate(values)], "v double, n long").repartition(5).cache()
    for descending in (False, True):
        got = {x["v"]: x["s"] for x in ordered.running_before(df, "v", {"s": "n"}, descending, ranges=16).collect()}
        total = 0
        for v, n in sorted(((x["v"], x["n"]) for x in df.collect()), reverse=descending):
            assert got[v] == total
            total += n


def test_scores_of_rows_do_not_depend_on_the_batch(spark):
    r = np.random.default_rng(3)
    names = [f"x{i}" for i in range(4)]
    df = spark.createDataFrame([(i, *map(float, r.normal(size=4))) for i in range(120)], "event_id long, " + ", ".join(f"{n} double" for n in names)).cache()
    for model in (sc.Pca(names, 0.7), sc.Autoencoder(names, (6, 2, 6), epochs=2), sc.Autoencoder(names, (6, 2, 6), epochs=2, variational=True), sc.Lof(names, k=5)):
        model.fit(df)
        summary.require_row_local(model.score, df)
        if not isinstance(model, sc.Lof):
            parts = explain.reconstruction_contributions(model, model.score(df)).collect()
            assert all(sum(p[f"{n}_part"] for n in names) / 4 == pytest.approx(p["score"]) for p in parts)
    ranked = df.withColumn("score", F.rank().over(__import__("pyspark").sql.Window.orderBy("x0")).cast("double"))
    with pytest.raises(summary.ScoreError):
        summary.require_row_local(lambda d: d.withColumn("score", F.count(F.lit(1)).over(__import__("pyspark").sql.Window.partitionBy(F.lit(0))).cast("double")), ranked.drop("score"))


def test_lof_by_definition(spark):
    r = np.random.default_rng(4)
    data = np.round(r.normal(size=(60, 2)), 1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(data)], "event_id long, a double, b double")
    got = [x["score"] for x in sc.Lof(["a", "b"], k=5).fit(df).score(df).orderBy("event_id").collect()]
    z = (data - data.mean(axis=0)) / data.std(axis=0)
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(axis=2))
    own = d + np.diag(np.full(60, np.inf))
    near = np.argsort(own, axis=1, kind="stable")[:, :5]
    kth = np.sort(own, axis=1)[:, 4]
    density = 1 / np.maximum(np.take_along_axis(own, near, 1), kth[near]).mean(axis=1)
    asked = np.argsort(d, axis=1, kind="stable")[:, :5]
    expected = density[asked].mean(axis=1) * np.maximum(np.take_along_axis(d, asked, 1), kth[asked]).mean(axis=1)
    assert np.allclose(got, expected, rtol=0.3) and np.corrcoef(got, expected)[0, 1] > 0.99


def test_comparisons(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=2000)
    samples = {"a": base + 3, "b": base + r.normal(size=2000), "c": base}
    found = summary.pairwise_comparisons(samples, {"a": 3.0, "b": 0.1, "c": 0.0})
    assert [(c.better, c.worse) for c in found[:2]] == [("a", "c"), ("a", "b")] and found[-1].adjusted > 0.05
    assert "outperforms" in found[0].sentence() and "does not" in found[-1].sentence()
    assert all(x.adjusted <= y.adjusted for x, y in zip(found, found[1:]))
    with pytest.raises(ValueError):
        summary.pairwise_comparisons({k: v[:10] for k, v in samples.items()}, {"a": 3.0, "b": 0.1, "c": 0.0})
    with pytest.raises(ValueError):
        summary.resample_summaries([("u", 3), ("u", 9)])
    low, high = summary.resample_summaries([("u", 3), ("v", 9), ("w", 30)], 200)["median_budget"]
    assert 3 <= low <= high <= 30
    drawn = rs.paired_bootstrap({"m": np.array([0, 1])}, {"m": np.array([1, 5])}, np.array(["x", "y"]), 50)["m"]
    assert len(set(drawn.tolist())) <= 50 and (drawn > 0).all()


def test_tuned_weights(spark):
    weights = tuning.rule_weights(5, 1)
    assert weights[0] == dict.fromkeys(sc.RULES, 0.125) and all(abs(sum(w.values()) - 1) < 1e-9 for w in weights) and weights == tuning.rule_weights(5, 1)


def test_permutation(spark):
    rows = [(float(i), float(i + (i * 7) % 5), float((i * 37) % 101)) for i in range(101)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    near, far = ev.permutation_p(df, "a", "b").first(), ev.permutation_p(df, "a", "c").first()
    assert near["rho"] > 0.95 and near["p"] < 0.01 and far["p"] > 0.05
    assert near["rho"] == pytest.approx(ev.spearman(df, "a", "b").first()["rho"], abs=1e-8)
