"""Queries of joins, sinks, summaries and explanations, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

from logweir.functions import explain, tuning, walks
from logweir.functions import features as ft
from logweir.functions import scorers as sc
from logweir.operators import clean, label, split, summary
from logweir.operators import evaluate as ev
from logweir.plans.log_queries import _DB, _SC, _STAR, AUTH, _features_sql, _metric_sql, _rules_sql, campaigns, query, rule_store, scored, store, train_of
from logweir.sources import adapter, sinks
from logweir.sources.shared import shared_dir


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# Joins and sets ---------------------------------------------------------------------------------------------------


@query("hosts_in_and_out", f"{AUTH}, a AS (SELECT day, src_computer AS host, count(*) AS n FROM auth GROUP BY 1, 2), b AS (SELECT day, dst_computer AS host, count(*) AS n FROM auth GROUP BY 1, 2) SELECT day, host, coalesce(a.n, 0) AS outgoing, coalesce(b.n, 0) AS incoming FROM a FULL JOIN b USING (day, host)")
def _(s, d):
    x = adapter.auth(s, d)
    out = x.groupBy("day", F.col("src_computer").alias("host")).agg(F.count(F.lit(1)).alias("outgoing"))
    into = x.groupBy("day", F.col("dst_computer").alias("host")).agg(F.count(F.lit(1)).alias("incoming"))
    both = out.join(into, ["day", "host"], "full")
    return both.select("day", "host", F.coalesce("outgoing", F.lit(0)).alias("outgoing"), F.coalesce("incoming", F.lit(0)).alias("incoming"))


@query("carried_users_untouched", f"{AUTH} SELECT src_user, count(*) AS seen, max(time) AS last_time FROM auth WHERE day <= 24 AND src_user NOT IN (SELECT src_user FROM auth WHERE day = 25) GROUP BY 1")
def _(s, d):
    x = adapter.auth(s, d)
    carried = x.filter("day <= 24").groupBy("src_user").agg(F.count(F.lit(1)).alias("seen"), F.max("time").alias("last_time"))
    return carried.join(x.filter("day = 25").select("src_user"), "src_user", "left_anti")


@query("ledger_with_users", f"{_SC}, cu AS (SELECT campaign, min(user) AS user FROM camp GROUP BY campaign) SELECT event_id, campaign, CAST(rank AS BIGINT) AS rank, user FROM led LEFT JOIN cu USING (campaign)")
def _(s, d):
    x = summary.with_campaign_users(ev.positives_ledger(scored(s, d)), campaigns(s, d))
    return x.select("event_id", "campaign", F.col("rank").cast("bigint").alias("rank"), "user")


@query(
    "table_fingerprint",
    f"""{AUTH} SELECT count(*) AS rows, min(event_id) AS least, max(event_id) AS greatest,
 CAST(sum(CAST('0x' || substr(md5(concat_ws('|', CAST(event_id AS VARCHAR), CAST(time AS VARCHAR), coalesce(src_user, '~'), coalesce(dst_computer, '~'), coalesce(auth_type, '~'))), 1, 8) AS BIGINT) % 1000003) AS BIGINT) AS digest FROM auth""",
)
def _(s, d):
    return clean.fingerprint(adapter.auth(s, d), "event_id", ["event_id", "time", "src_user", "dst_computer", "auth_type"])


@query("top_source_share", f"{AUTH} SELECT src_computer, count(*) AS positives, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share FROM auth WHERE is_malicious GROUP BY 1 ORDER BY positives DESC, src_computer LIMIT 1")
def _(s, d):
    return label.top_source_share(adapter.auth(s, d))


@query(
    "user_day_rollup",
    f"{AUTH} SELECT day, src_user, count(*) AS n_events, count(*) FILTER (NOT success) AS n_failures, min(time) AS first_time, max(time) AS last_time, count(DISTINCT dst_computer) AS n_distinct FROM auth GROUP BY 1, 2",
)
def _(s, d):
    x = adapter.auth(s, d)
    return x.groupBy("day", "src_user").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(~F.col("success")).alias("n_failures"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count_distinct("dst_computer").alias("n_distinct"))


@query("edge_effects", f"{_SC} SELECT count(*) FILTER (time % 86400 = 0) AS first_second_positives, count(DISTINCT campaign) FILTER (day >= 29) AS truncated_campaigns FROM led")
def _(s, d):
    return ev.edge_effects(scored(s, d), 29)


def geometric_mean():
    """An aggregate that SQL lacks, over Arrow batches. Made when asked for: a session must be there by then."""

    def mean(values: pd.Series) -> float:
        return float(np.exp(np.log(values.astype("float64")).mean()))

    return pandas_udf(mean, "double")


@query("udaf_geometric_mean", "SELECT o_orderpriority, round(exp(avg(ln(CAST(o_totalprice AS DOUBLE)))), 4) AS mean FROM orders GROUP BY 1")
def _(s, d):
    x = adapter.table(s, d, "orders").withColumn("p", F.col("o_totalprice").cast("double"))
    return x.groupBy("o_orderpriority").agg(F.round(geometric_mean()("p"), 4).alias("mean"))


class BudgetShares:
    """(budget, share of the day's events) for each standard budget."""

    def eval(self, events: int):
        for b in ev.BUDGETS:
            yield b, round(min(1.0, b / events), 9)


@query("udtf_budget_shares", f"{AUTH}, z AS (SELECT day, count(*) AS n FROM auth GROUP BY day) SELECT day, CAST(b AS INT) AS budget, round(least(1.0::DOUBLE, b / CAST(n AS DOUBLE)), 9) AS share FROM z, (VALUES (10), (50), (100), (500)) v(b)")
def _(s, d):
    days = ev.day_sizes(adapter.auth(s, d)).select("day", "events")
    return days.lateralJoin(udtf(BudgetShares, returnType="budget: int, share: double")(F.col("events").outer())).select("day", "budget", "share")


# Sources and sinks ------------------------------------------------------------------------------------------------


@query("days_written_and_pruned", f"{AUTH} SELECT event_id, time, day, src_user, success FROM auth WHERE day BETWEEN 3 AND 9")
def _(s, d):
    path = _folder(s, "days")
    adapter.auth(s, d).select("event_id", "time", "day", "src_user", "success").write.partitionBy("day").parquet(path)
    return s.read.parquet(path).filter(F.col("day").between(3, 9)).select("event_id", "time", "day", "src_user", "success")


@query("raw_text_round_trip", f"WITH {adapter.raw_cte()} SELECT time, src_user_at_domain, dst_computer, auth_type, count(*) AS n FROM raw_log GROUP BY 1, 2, 3, 4")
def _(s, d):
    from logweir.schema import RAW_AUTH
    from logweir.sources import raw

    path = _folder(s, "text")
    adapter.raw_log(s, d).select(*RAW_AUTH).write.option("compression", "gzip").csv(path)
    return raw.read_any_compression(s, path).groupBy("time", "src_user_at_domain", "dst_computer", "auth_type").agg(F.count(F.lit(1)).alias("n"))


@query("ledger_csv", f"{_SC} SELECT event_id, campaign, day, time, CAST(rank AS BIGINT) AS rank FROM led")
def _(s, d):
    path = _folder(s, "csv")
    sinks.write_csv(ev.positives_ledger(scored(s, d)).select("event_id", "campaign", "day", "time", F.col("rank").cast("bigint").alias("rank")), path)
    return sinks.read_csv(s, path, "event_id long, campaign string, day int, time int, rank long")


@query("vocabulary_round_trip", f"{AUTH} SELECT count(DISTINCT dst_computer) + 3 AS n_tokens FROM auth WHERE day <= 19")
def _(s, d):
    path = _folder(s, "vocabulary")
    sinks.write_vocabulary(ft.fit_vocabulary(train_of(adapter.auth(s, d)), "dst_computer"), path)
    return sinks.n_tokens(sinks.read_vocabulary(s, path))


@query("demo_log_kinds")
def _(s, d):
    from logweir.sources import demo

    log = demo.demo_log(s, days=4, per_day=500)
    return log.groupBy("auth_type", "success_failure").count().unionByName(demo.demo_redteam(log).groupBy(F.lit("intrusions").alias("auth_type"), F.lit("").alias("success_failure")).count())


# Summaries --------------------------------------------------------------------------------------------------------

def _evaluation_sql() -> str:
    metrics = _metric_sql(f"{_SC}", "sd")
    head, tail = metrics.rsplit("SELECT round(sum(tp / p", 1)
    ranking = "SELECT round(sum(tp / p" + tail
    names = ("average_precision", "roc_auc", "tied_pair_fraction", "recall_at_fpr")
    parts = [f"SELECT '{n}' AS metric, CAST(NULL AS INT) AS budget, {n} AS value FROM rm" for n in names]
    parts.append("SELECT 'first_detection', NULL, CAST(min(rank) AS DOUBLE) FROM led")
    parts += [
        f"SELECT '{n}', b.budget, {e} FROM led CROSS JOIN bu b GROUP BY b.budget"
        for n, e in (("event_recall", "round(avg(CASE WHEN rank <= b.budget THEN 1.0 ELSE 0.0 END), 9)"), ("campaign_recall", "round(count(DISTINCT campaign) FILTER (rank <= b.budget) / CAST(count(DISTINCT campaign) AS DOUBLE), 9)"))
    ]
    parts += [f"SELECT '{n}', budget, round(CAST({f}(delay) AS DOUBLE), 9) FROM dl GROUP BY budget" for n, f in (("mean_delay", "avg"), ("longest_delay", "max"))]
    return f"""{head.rstrip()}, rm AS ({ranking}), bu AS (SELECT CAST(b AS INT) AS budget FROM (VALUES (10), (50), (100), (500)) v(b)),
dl AS (SELECT b.budget, campaign, min(time) FILTER (rank <= b.budget) - min(time) AS delay FROM led CROSS JOIN bu b GROUP BY 1, 2) {" UNION ALL ".join(parts)}"""


@query("evaluate_model", _evaluation_sql())
def _(s, d):
    return summary.evaluate_model(scored(s, d)).filter(~F.col("metric").isin("weighted_ap", "least_distinct", "largest_tie_share"))


@query("summary_record", f"{_DB}, o AS (SELECT budget, row_number() OVER (ORDER BY budget, campaign) AS i, count(*) OVER () AS n FROM db) SELECT (SELECT count(*) FROM db) AS campaigns, (SELECT CAST(budget AS BIGINT) FROM o WHERE i = greatest(1, ceil(0.5 * n))) AS median_budget, (SELECT round(avg(greatest(0, ln(1000.0 / budget) / ln(1000.0))), 9) FROM db) AS log_area, (SELECT round(avg(CASE WHEN budget <= 100 THEN 1.0 ELSE 0.0 END), 9) FROM db) AS within_100")
def _(s, d):
    x = summary.summary_record(ev.detection_budgets(ev.positives_ledger(scored(s, d))))
    return x.withColumn("median_budget", F.col("median_budget").cast("bigint"))


@query("score_checks", f"{_STAR} SELECT count(*) AS rows, count(*) - count(DISTINCT event_id) AS duplicate_ids, count(*) FILTER (score IS NULL) AS missing_scores, 3 - count(DISTINCT day) FILTER (day IN (1, 2, 3)) AS missing_days FROM star")
def _(s, d):
    return summary.check_scores(adapter.star(s, d), [1, 2, 3])


@query("degenerate_checks", "SELECT * FROM (VALUES ('perfect', 1.0::DOUBLE, 1.0::DOUBLE), ('reversed', 0.155555556, 0.0), ('constant', 0.2, 0.5)) v(\"case\", average_precision, roc_auc)")
def _(s, d):
    return summary.degenerate_checks(s)


@query("spearman_permutation")
def _(s, d):
    return ev.permutation_p(adapter.table(s, d, "documents").select("n_chars", (F.col("doc_id") % 97).alias("m")), "n_chars", "m")


@query("campaign_resamples")
def _(s, d):
    ledger = ev.detection_budgets(ev.positives_ledger(scored(s, d)))
    rows = [(r["campaign"].split("#")[0], int(r["budget"])) for r in ledger.collect()]  # one row a campaign
    found = summary.resample_summaries(rows, 300, 1) if len({a for a, _ in rows}) > 1 else {}
    return s.createDataFrame([(n, *v) for n, v in found.items()], "summary string, low double, high double")


# Explanations -----------------------------------------------------------------------------------------------------


@query(
    "alert_cards",
    f"""{_SC} SELECT day, CAST(rank AS BIGINT) AS rank, event_id, printf('### Alert: event %d (rank #%d of day %d)', event_id, rank, day) || chr(10) || '- User: ' || coalesce(src_user, '?') || chr(10) || '- From ' || coalesce(src_computer, '?') || ' to ' || coalesce(dst_computer, '?') || chr(10) || '- Second ' || CAST(time AS VARCHAR) AS card FROM rk WHERE rank <= 3""",
)
def _(s, d):
    x = explain.alert_cards(scored(s, d), 3)
    return x.select("day", F.col("rank").cast("bigint").alias("rank"), "event_id", F.regexp_replace("card", r", score .*$", "").alias("card"))


def _contribution_sql() -> str:
    each = " UNION ALL ".join(f"SELECT event_id, '{r}' AS rule, round({r}_ecdf * 0.125, 9) AS contribution, '{t}' AS technique FROM e WHERE day >= 25" for r, t in sc.RULES.items())
    return f"{_rules_sql()}, a AS ({each}), b AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY contribution DESC, rule) AS place FROM a) SELECT event_id, rule, round(contribution, 6) AS contribution, technique, CAST(place AS INT) AS place FROM b WHERE place <= 3"


@query("rule_contributions", _contribution_sql())
def _(s, d):
    x = rule_store(s, d)
    m = sc.Rules().fit(train_of(x))
    return explain.rule_contributions(m.ecdfs(split.by_days(x, 25, 29)), m.weights).withColumn("contribution", F.round("contribution", 6))


@query("typical_values", f"{_features_sql(0, 19, 0)} SELECT src_user, round(avg(pair_global_rarity), 7) AS pair_global_rarity_usual FROM x GROUP BY 1")
def _(s, d):
    x = explain.typical_values(store(s, d, 0, 19, "cumulative"), ["pair_global_rarity"])
    return x.select("src_user", F.round("pair_global_rarity_usual", 7).alias("pair_global_rarity_usual"))


# Models on the store ----------------------------------------------------------------------------------------------

_PREV = f"{AUTH}, p AS (SELECT *, lag(dst_computer) OVER (PARTITION BY src_user ORDER BY time, event_id) AS prev_dst FROM auth), c AS (SELECT prev_dst, dst_computer AS t, count(*) AS n FROM p WHERE day <= 19 AND prev_dst IS NOT NULL AND dst_computer IS NOT NULL GROUP BY 1, 2), o AS (SELECT prev_dst, sum(n) AS n FROM c GROUP BY 1), k AS (SELECT count(DISTINCT t) AS k FROM c)"


@query("m4c_next_host", f"{_PREV} SELECT event_id, round(CASE WHEN p.prev_dst IS NULL THEN 0 ELSE -ln((coalesce(c.n, 0) + 1.0) / (coalesce(o.n, 0) + k + 1.0)) END, 9) AS score FROM p CROSS JOIN k LEFT JOIN c ON c.prev_dst = p.prev_dst AND c.t = p.dst_computer LEFT JOIN o ON o.prev_dst = p.prev_dst WHERE day >= 25")
def _(s, d):
    x = sc.with_previous_host(adapter.auth(s, d))
    return sc.NextHost().fit(train_of(x)).score(x.filter("day >= 25")).select("event_id", F.round("score", 9).alias("score"))


@query("store_models")
def _(s, d):
    """Every vector model, fitted on the stored columns of the training days, on those of the test days."""
    x = rule_store(s, d)
    x = ft.numeric(x)
    train, test = train_of(x), split.by_days(x, 25, 29).select("event_id", *ft.model_columns())
    columns = ft.model_columns()
    out = test
    for model in (sc.Pca(columns), sc.IsolationForest(columns), sc.Ecod(columns), sc.Hbos(columns), sc.Autoencoder(columns, epochs=3), sc.Autoencoder(columns, epochs=3, variational=True)):
        out = model.fit(train).score(out, model.name)
    return out.select("event_id", *[F.round(c, 6).alias(c) for c in out.columns if c not in test.columns])


@query("tuned_rules")
def _(s, d):
    x = rule_store(s, d)
    return tuning.tune_rules(train_of(x), split.by_days(x, 20, 24))[1]


@query("graph_features_attached")
def _(s, d):
    x = ft.attach_graph_features(adapter.auth(s, d).select("event_id", "day", "src_user", "dst_computer"))
    return x.drop("day", "src_user", "dst_computer")


_ATTACH = f"""{AUTH}, e AS (SELECT d.day, a.src_user AS user, a.dst_computer AS machine FROM (SELECT DISTINCT day FROM auth) d JOIN auth a ON a.day BETWEEN d.day - 7 AND d.day - 1 GROUP BY 1, 2, 3),
u AS (SELECT day, user, count(*) AS n FROM e GROUP BY 1, 2), m AS (SELECT day, machine, count(*) AS n FROM e GROUP BY 1, 2)
SELECT event_id, coalesce(u.n, 0) AS user_graph_degree, coalesce(m.n, 0) AS host_graph_degree FROM auth a LEFT JOIN u ON a.day = u.day AND a.src_user = u.user LEFT JOIN m ON a.day = m.day AND a.dst_computer = m.machine"""


@query("graph_degrees_attached", _ATTACH)
def _(s, d):
    x = ft.attach_graph_features(adapter.auth(s, d).select("event_id", "day", "src_user", "dst_computer"))
    return x.select("event_id", "user_graph_degree", "host_graph_degree")


@query("m5a_walk_forest")
def _(s, d):
    x = adapter.auth(s, d)
    edges = train_of(x).groupBy(F.col("src_user").alias("user"), F.col("dst_computer").alias("machine")).agg(F.count(F.lit(1)).alias("weight"))
    return walks.walk_scores(edges, x.filter("day >= 25").select("event_id", "src_user", "dst_computer"), seed=1)
