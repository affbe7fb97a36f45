"""Queries over the log views, each with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.functions import features as ft
from logweir.functions import scorers as sc
from logweir.functions import tuning, walks
from logweir.operators import causal, clean, label, split
from logweir.operators import evaluate as ev
from logweir.operators import resample as rs
from logweir.sources import adapter
from logweir.sources.shared import written
from logweir.streaming import daily

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

AUTH = "WITH " + adapter.auth_cte()
RAW = "WITH " + adapter.raw_cte()
RED = "WITH " + adapter.redteam_cte()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


# Cleaning -----------------------------------------------------------------------------------------------------

_P1 = "CASE WHEN contains({0}, '@') THEN split_part({0}, '@', {1}) END"
_TIME = "TRY_CAST(time AS BIGINT)"
_USABLE = f"{_TIME} IS NOT NULL AND contains(src_user_at_domain, '@') AND contains(dst_user_at_domain, '@')"
_TYPED = f"""CAST({_TIME} AS INT) AS time, CAST(floor({_TIME} / 86400) AS INT) AS day,
 {_P1.format("src_user_at_domain", 1)} AS src_user, {_P1.format("src_user_at_domain", 2)} AS src_domain,
 {_P1.format("dst_user_at_domain", 1)} AS dst_user, {_P1.format("dst_user_at_domain", 2)} AS dst_domain, src_computer, dst_computer,
 nullif(auth_type, '?') AS auth_type, coalesce(auth_type = '?', true) AS auth_type_is_null, nullif(logon_type, '?') AS logon_type, coalesce(logon_type = '?', true) AS logon_type_is_null,
 nullif(auth_orientation, '?') AS auth_orientation, success_failure = 'Success' AS success,
 split_part(src_user_at_domain, '@', 1) LIKE '%$' AS src_user_is_machine, split_part(dst_user_at_domain, '@', 1) LIKE '%$' AS dst_user_is_machine"""


@query("clean_auth_typed", f"{RAW} SELECT event_id, {_TYPED} FROM raw_log WHERE {_USABLE}")
def _(s: SparkSession, d: str) -> DataFrame:
    return clean.clean_auth(adapter.raw_log(s, d))


@query("clean_auth_dense_ids", f"{RAW} SELECT 100 + row_number() OVER (ORDER BY event_id) - 1 AS event_id, {_TYPED} FROM raw_log WHERE {_USABLE}")
def _(s, d):
    return clean.clean_auth(adapter.raw_log(s, d), dense=True, offset=100)


@query(
    "clean_drop_counts",
    f"""{RAW} SELECT count(*) AS rows_in, count(*) FILTER ({_TIME} IS NULL) AS null_time,
 count(*) FILTER ({_TIME} IS NOT NULL AND NOT (contains(src_user_at_domain, '@') AND contains(dst_user_at_domain, '@'))) AS malformed_account, count(*) FILTER ({_USABLE}) AS rows_out FROM raw_log""",
)
def _(s, d):
    return clean.drop_counts(adapter.raw_log(s, d))


_RED = f"""{RED}, red AS (SELECT DISTINCT CAST(time AS INT) AS time, CAST(floor(CAST(time AS INT) / 86400) AS INT) AS day, split_part(user_at_domain, '@', 1) AS user, split_part(user_at_domain, '@', 2) AS domain, src_computer, dst_computer FROM redteam_raw)"""


@query("redteam_dedupe", f"{_RED} SELECT * FROM red")
def _(s, d):
    return clean.clean_redteam(adapter.redteam_raw(s, d))


_COLS = ["src_user", "src_computer", "dst_computer", "auth_type", "logon_type", "auth_orientation"]


@query("dq_null_rates", f"{AUTH} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 9) AS null_rate FROM auth" for c in _COLS))
def _(s, d):
    return clean.null_rates(adapter.auth(s, d), _COLS)


@query("dq_cardinality", f"{AUTH} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unique FROM auth" for c in _COLS))
def _(s, d):
    return clean.cardinality(adapter.auth(s, d), _COLS)


_DUP = "day, src_user, dst_computer, auth_type"


@query("dq_duplicates", f"{AUTH} SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM auth GROUP BY {_DUP})")
def _(s, d):
    return clean.duplicate_rows(adapter.auth(s, d), _DUP.split(", "))


@query("partition_by_day_counts", f"{AUTH} SELECT day, count(*) AS n FROM auth WHERE day BETWEEN 3 AND 9 GROUP BY day")
def _(s, d):
    return adapter.auth(s, d).filter(F.col("day").between(3, 9)).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("ntlm_variant", f"{AUTH} SELECT event_id, contains(upper(concat_ws(',', src_user, auth_type, logon_type)), 'CLICK') AS matches FROM auth")
def _(s, d):
    return adapter.auth(s, d).select("event_id", F.contains(F.upper(F.concat_ws(",", "src_user", "auth_type", "logon_type")), F.lit("CLICK")).alias("matches"))


@query(
    "preflight_budget",
    "SELECT stage, CAST(n * b AS BIGINT) AS bytes FROM (SELECT count(*) AS n FROM events) CROSS JOIN (VALUES ('raw', 68.7), ('interim', 9.7), ('store', 35.5)) t(stage, b)",
)
def _(s, d):
    from logweir.sources.raw import stage_bytes

    return stage_bytes(s, adapter.table(s, d, "events").count())


# Labels -------------------------------------------------------------------------------------------------------

_CAMP = f"""{_RED}, marked AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY user, domain ORDER BY time, src_computer, dst_computer) <= 86400 THEN 0 ELSE 1 END AS st FROM red),
camp AS (SELECT time, day, user, domain, src_computer, dst_computer, user || '#' || domain || '#' || CAST(CAST(sum(st) OVER (PARTITION BY user, domain ORDER BY time, src_computer, dst_computer ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR) AS campaign FROM marked)"""
_LAB = f"""{_CAMP}, keyed AS (SELECT time, user, domain, src_computer, dst_computer, min(campaign) AS campaign FROM camp GROUP BY ALL),
lab AS (SELECT a.* EXCLUDE (is_malicious), c.campaign, c.campaign IS NOT NULL AS is_malicious FROM auth a LEFT JOIN keyed c ON a.time = c.time AND a.src_user = c.user AND a.src_domain = c.domain AND a.src_computer = c.src_computer AND a.dst_computer = c.dst_computer)"""
_LAB = _LAB.replace("GROUP BY ALL", "GROUP BY time, user, domain, src_computer, dst_computer")


def campaigns(s: SparkSession, d: str) -> DataFrame:
    return label.group_into_campaigns(clean.clean_redteam(adapter.redteam_raw(s, d)))


def labelled(s: SparkSession, d: str) -> DataFrame:
    return label.label_events(adapter.auth(s, d).drop("is_malicious"), campaigns(s, d))


@query("campaigns_gap24", f"{_CAMP} SELECT * FROM camp")
def _(s, d):
    return campaigns(s, d)


@query("campaign_ids", f"{_CAMP} SELECT campaign, dense_rank() OVER (ORDER BY campaign) AS campaign_id, time FROM camp")
def _(s, d):
    return label.numbered_campaigns(campaigns(s, d)).select("campaign", "campaign_id", "time")


@query("campaign_summary", f"{_CAMP} SELECT campaign, min(user) AS user, count(*) AS n_events, min(time) AS first_time, max(time) AS last_time, max(time) - min(time) AS duration FROM camp GROUP BY campaign")
def _(s, d):
    return label.campaign_summary(campaigns(s, d))


@query("label_exact_join", f"{_LAB} SELECT event_id, is_malicious FROM lab")
def _(s, d):
    return labelled(s, d).select("event_id", "is_malicious")


@query("attach_campaign", f"{_LAB} SELECT event_id, campaign FROM lab WHERE campaign IS NOT NULL")
def _(s, d):
    return labelled(s, d).filter("campaign is not null").select("event_id", "campaign")


@query("labeling_report", f"{_LAB} SELECT count(*) AS n_events, count(*) FILTER (is_malicious) AS n_matched, round(avg(CASE WHEN is_malicious THEN 1.0 ELSE 0.0 END), 9) AS positive_rate FROM lab")
def _(s, d):
    return label.labeling_report(labelled(s, d))


@query(
    "split_label_summary",
    f"""{AUTH} SELECT CASE grouping(src_computer, day) WHEN 3 THEN 'all' WHEN 1 THEN 'source' ELSE 'day' END AS level, coalesce(src_computer, '') AS src_computer, coalesce(day, -1) AS day, count(*) AS positives
 FROM auth WHERE is_malicious GROUP BY GROUPING SETS ((), (src_computer), (day))""",
)
def _(s, d):
    return label.split_summary(adapter.auth(s, d))


@query("positive_rate_check", f"{AUTH} SELECT round(r, 9) AS positive_rate, r BETWEEN 0.0001 AND 0.05 AS within FROM (SELECT avg(CASE WHEN is_malicious THEN 1.0 ELSE 0.0 END) AS r FROM auth)")
def _(s, d):
    return label.positive_rate_ok(adapter.auth(s, d), 0.0001, 0.05)


# Splits -------------------------------------------------------------------------------------------------------

_SPLIT = "CASE WHEN day BETWEEN 0 AND 19 THEN 'train' WHEN day BETWEEN 20 AND 24 THEN 'val' WHEN day BETWEEN 25 AND 29 THEN 'test' END"


@query("split_days", f"{AUTH} SELECT {_SPLIT} AS split, count(*) AS n, count(*) FILTER (is_malicious) AS positives FROM auth GROUP BY 1")
def _(s, d):
    return split.with_split(adapter.auth(s, d)).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_malicious").alias("positives"))


@query("split_hours", f"{AUTH} SELECT event_id, time FROM auth WHERE time >= 36 * 3600 AND time < 60 * 3600")
def _(s, d):
    return split.by_hours(adapter.auth(s, d), 36, 60).select("event_id", "time")


@query(
    "temporal_order",
    f"""{AUTH}, x AS (SELECT {_SPLIT} AS split, time FROM auth),
y AS (SELECT min(time) FILTER (split = 'train') AS train_lo, max(time) FILTER (split = 'train') AS train_hi, min(time) FILTER (split = 'val') AS val_lo, max(time) FILTER (split = 'val') AS val_hi, min(time) FILTER (split = 'test') AS test_lo, max(time) FILTER (split = 'test') AS test_hi FROM x)
SELECT *, train_hi < val_lo AND val_hi < test_lo AS ordered FROM y""",
)
def _(s, d):
    return split.temporal_order(split.with_split(adapter.auth(s, d)))


_REMOTE = "auth_orientation = 'LogOn' AND src_computer <> dst_computer"


@query("universe_remote_logon", f"{AUTH} SELECT event_id FROM auth WHERE {_REMOTE}")
def _(s, d):
    return split.universe(adapter.auth(s, d), "remote_logon").select("event_id")


@query("universe_remote_logon_user", f"{AUTH} SELECT event_id FROM auth WHERE {_REMOTE} AND NOT dst_user_is_machine")
def _(s, d):
    return split.universe(adapter.auth(s, d), "remote_logon_user").select("event_id")


@query("regime_r2", f"{AUTH} SELECT day, count(*) AS n FROM auth WHERE day <= 19 AND NOT is_malicious GROUP BY day")
def _(s, d):
    return split.regime_train(split.by_days(adapter.auth(s, d), 0, 19), "R2").groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("random_split")
def _(s, d):
    return split.random_split(adapter.auth(s, d), 0.2, 0.1, 7).groupBy("split").count()


@query("sample_for_fit")
def _(s, d):
    return split.sample_for_fit(adapter.auth(s, d), 100, 3).select("event_id")


# Causal windows -----------------------------------------------------------------------------------------------


def _rolling(seconds: int) -> str:
    return f"count(*) OVER (PARTITION BY src_user ORDER BY time RANGE BETWEEN {seconds} PRECEDING AND 1 PRECEDING)"


for _name, _seconds in (("1h", 3600), ("1d", 86_400), ("7d", 604_800)):

    @query(f"rolling_count_{_name}", f"{AUTH} SELECT event_id, {_rolling(_seconds)} AS n FROM auth")
    def _(s, d, seconds=_seconds):
        return causal.rolling_count(adapter.auth(s, d).select("event_id", "time", "src_user"), "src_user", seconds, "n").select("event_id", "n")


_FAIL = "CAST(coalesce(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER (PARTITION BY {e} ORDER BY time RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) AS BIGINT)"


@query("rolling_failures_1d", f"{AUTH} SELECT event_id, {_FAIL.format(e='dst_computer')} AS failures FROM auth")
def _(s, d):
    return causal.rolling_sum(adapter.auth(s, d), "dst_computer", 86_400, (~F.col("success")).cast("bigint"), "failures").select("event_id", "failures")


@query("rolling_failures_1d_sweep", f"{AUTH} SELECT event_id, {_FAIL.format(e='dst_computer')} AS failures FROM auth")
def _(s, d):
    return causal.sweep_sum(adapter.auth(s, d).select("event_id", "time", "dst_computer", "success"), "dst_computer", 86_400, (~F.col("success")).cast("bigint"), "failures").select("event_id", "failures")


@query(
    "failure_ratio",
    f"""{AUTH}, x AS (SELECT event_id, {_FAIL.format(e="src_user")} AS f, {_rolling(86_400)} AS n FROM auth) SELECT event_id, round(f / CAST(greatest(n, 1) AS DOUBLE), 9) AS ratio FROM x""",
)
def _(s, d):
    x = ft.history_features(adapter.auth(s, d), ("src_user",), (24,), ())
    return x.select("event_id", F.round("src_user_1d_failure_ratio", 9).alias("ratio"))


for _name, _entity, _partner, _seconds in (("distinct_1h_sweep", "dst_computer", "src_user", 3600), ("distinct_1d_sweep", "src_user", "dst_computer", 86_400), ("distinct_host_1d_sweep", "dst_computer", "src_user", 86_400)):
    _sql = f"""{AUTH}, t AS (SELECT event_id, time - time % 600 AS time, {_entity} AS e, {_partner} AS p FROM auth)
SELECT a.event_id, count(DISTINCT b.p) AS n FROM t a LEFT JOIN t b ON a.e = b.e AND b.time < a.time AND b.time >= a.time - {_seconds} GROUP BY a.event_id"""

    @query(_name, _sql)
    def _(s, d, entity=_entity, partner=_partner, seconds=_seconds):
        rows = adapter.coarse(adapter.auth(s, d).select("event_id", "time", entity, partner), 600)
        return causal.distinct_count(rows, entity, partner, seconds, "n").select("event_id", "n")


@query("prior_events_join", f"{AUTH} SELECT a.event_id, b.event_id AS prior_id FROM auth a JOIN auth b ON a.src_user = b.src_user AND b.time < a.time AND b.time >= a.time - 86400")
def _(s, d):
    return causal.prior_events(adapter.auth(s, d).select("event_id", "time", "src_user"), "src_user", 86_400).select("event_id", "prior_id")


@query(
    "first_occurrence",
    f"""{AUTH} SELECT event_id, row_number() OVER w = 1 AS pair_is_new, row_number() OVER w - 1 AS pair_index, time - lag(time) OVER w AS pair_since FROM auth WINDOW w AS (PARTITION BY src_user, auth_type ORDER BY time, event_id)""",
)
def _(s, d):
    return causal.first_occurrence(adapter.auth(s, d), ["src_user", "auth_type"], "pair").select("event_id", "pair_is_new", "pair_index", "pair_since")


@query(
    "events_before_day",
    f"""{AUTH} SELECT src_user, day, CAST(coalesce(sum(n) OVER (PARTITION BY src_user ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM (SELECT src_user, day, count(*) AS n FROM auth GROUP BY src_user, day)""",
)
def _(s, d):
    return causal.events_before_day(adapter.auth(s, d), ["src_user"])


@query(
    "dst_entropy_1d",
    f"""{AUTH}, j AS (SELECT a.event_id, b.src_user AS p, b.auth_type AS t FROM auth a JOIN auth b ON a.dst_computer = b.dst_computer AND b.time < a.time AND b.time >= a.time - 86400),
c AS (SELECT event_id, p, count(*) AS n FROM j GROUP BY event_id, p),
e AS (SELECT event_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM c GROUP BY event_id),
k AS (SELECT event_id, count(DISTINCT t) + max(CASE WHEN t IS NULL THEN 1 ELSE 0 END) AS n FROM j GROUP BY event_id)
SELECT a.event_id, round(greatest(coalesce(h, 0), 0), 9) AS entropy, CAST(coalesce(n, 0) AS BIGINT) AS n_auth_types FROM auth a LEFT JOIN e USING (event_id) LEFT JOIN k USING (event_id)""",
)
def _(s, d):
    return causal.distribution_stats(adapter.auth(s, d), "dst_computer", "src_user", 86_400)


# Features -----------------------------------------------------------------------------------------------------


def train_of(df: DataFrame) -> DataFrame:
    return split.by_days(df, 0, 19)


_FREQ = "coalesce((SELECT count(*) FROM auth t WHERE t.day <= 19 AND t.{c} IS NOT DISTINCT FROM a.{c}) / CAST((SELECT count(*) FROM auth WHERE day <= 19) AS DOUBLE), 0)"


@query("frequency_encoding", f"{AUTH} SELECT auth_type AS value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS freq FROM auth WHERE day <= 19 GROUP BY auth_type")
def _(s, d):
    return ft.fit_frequencies(train_of(adapter.auth(s, d)), "auth_type").select("value", F.round("freq", 9).alias("freq"))


@query(
    "f1_event",
    f"""{AUTH}, n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM auth WHERE day <= 19),
f1 AS (SELECT auth_type AS v, count(*) / any_value(n.n) AS f FROM auth, n WHERE day <= 19 GROUP BY 1), f2 AS (SELECT logon_type AS v, count(*) / any_value(n.n) AS f FROM auth, n WHERE day <= 19 GROUP BY 1), f3 AS (SELECT auth_orientation AS v, count(*) / any_value(n.n) AS f FROM auth, n WHERE day <= 19 GROUP BY 1)
SELECT event_id, CAST(success AS INT) AS is_success, CAST(auth_type_is_null AS INT) AS auth_type_is_null, CAST(logon_type_is_null AS INT) AS logon_type_is_null, CAST(src_user_is_machine AS INT) AS src_user_is_machine,
 CAST(src_user = dst_user AS INT) AS src_dst_user_same, CAST(src_computer = dst_computer AS INT) AS src_dst_computer_same, CAST(src_domain <> dst_domain AS INT) AS domain_crossing,
 round(coalesce(f1.f, 0), 9) AS auth_type_freq, round(coalesce(f2.f, 0), 9) AS logon_type_freq, round(coalesce(f3.f, 0), 9) AS auth_orientation_freq
FROM auth a LEFT JOIN f1 ON a.auth_type IS NOT DISTINCT FROM f1.v LEFT JOIN f2 ON a.logon_type IS NOT DISTINCT FROM f2.v LEFT JOIN f3 ON a.auth_orientation IS NOT DISTINCT FROM f3.v""",
)
def _(s, d):
    a = adapter.auth(s, d)
    x = ft.event_features(a, train_of(a))
    return x.select("event_id", *[F.round(c, 9).alias(c) if c.endswith("freq") else F.col(c).cast("int").alias(c) for c in ft.event_columns()])


def _history_sql(entity: str, partner: str) -> str:
    parts = []
    for h, n in ((1, "1h"), (24, "1d")):
        w = f"(PARTITION BY {entity} ORDER BY time RANGE BETWEEN {h * 3600} PRECEDING AND 1 PRECEDING)"
        c, f = f"count(*) OVER {w}", f"CAST(coalesce(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER {w}, 0) AS BIGINT)"
        parts += [f"{c} AS {entity}_{n}_n_events", f"{f} AS {entity}_{n}_n_failures", f"round({f} / CAST(greatest({c}, 1) AS DOUBLE), 9) AS {entity}_{n}_failure_ratio"]
    return f"{AUTH} SELECT event_id, {', '.join(parts)} FROM auth"


for _name, _entity in (("f2_user", "src_user"), ("f2_host", "dst_computer")):

    @query(_name, _history_sql(_entity, ""))
    def _(s, d, entity=_entity):
        x = ft.history_features(adapter.auth(s, d), (entity,), (1, 24), ())
        kept = [c for c in x.columns if c.startswith(f"{entity}_1")]
        return x.select("event_id", *[F.round(c, 9).alias(c) if c.endswith("ratio") else F.col(c) for c in kept])


def _novelty_cte(name: str) -> str:
    keys, cond = ft.RELATIONS[name]
    k, c = ", ".join(keys), "".join(f"{x}, " for x in cond)
    part = f"PARTITION BY {', '.join(cond)} " if cond else ""
    on = " AND ".join(["a.day = b.day", *(f"a.{x} IS NOT DISTINCT FROM b.{x}" for x in cond)])
    return f"""{name}_b AS (SELECT {c}day, coalesce(sum(n) OVER ({part}ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM (SELECT {c}day, count(*) AS n FROM auth GROUP BY {c}day)),
{name}_n AS (SELECT a.event_id, row_number() OVER w - 1 AS k, CAST(b.nb AS DOUBLE) AS nb, a.time - lag(a.time) OVER w AS since FROM auth a JOIN {name}_b b ON {on} WINDOW w AS (PARTITION BY {", ".join("a." + x for x in keys)} ORDER BY a.time, a.event_id))"""


for _name in ft.RELATIONS:

    @query(f"f3_{_name}", f"{AUTH}, {_novelty_cte(_name)} SELECT event_id, CAST(k = 0 AS INT) AS is_new, round(-ln((k + 1) / (nb + 1)), 9) AS rarity FROM {_name}_n")
    def _(s, d, name=_name):
        x = ft.novelty_features(adapter.auth(s, d), {"pair": ft.RELATIONS["pair"], name: ft.RELATIONS[name]})
        return x.select("event_id", F.col(f"{name}_is_new").alias("is_new"), F.round(ft.rarity_name(name), 9).alias("rarity"))


@query(
    "f3_new_pairs_24h",
    f"""{AUTH}, {_novelty_cte("pair")}, x AS (SELECT a.*, n.k, n.since FROM auth a JOIN pair_n n USING (event_id))
SELECT event_id, CAST(since AS DOUBLE) / 86400 AS days_since_pair_last_seen,
 CAST(coalesce(sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY src_user ORDER BY time RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS user_new_pairs,
 CAST(coalesce(sum(CASE WHEN k = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY src_computer ORDER BY time RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS host_new_pairs FROM x""",
)
def _(s, d):
    x = ft.novelty_features(adapter.auth(s, d), {"pair": ft.RELATIONS["pair"]})
    return x.select("event_id", F.when(F.col("days_since_pair_last_seen") < ft.INFINITY, F.col("days_since_pair_last_seen")).alias("days_since_pair_last_seen"), F.col("user_new_host_count_24h").alias("user_new_pairs"), F.col("host_new_user_count_24h").alias("host_new_pairs"))


@query(
    "night_window",
    f"""{AUTH}, c AS (SELECT CAST(floor(time % 86400 / 900) AS INT) AS b, count(*) AS n FROM auth WHERE day <= 19 GROUP BY 1),
w AS (SELECT s.i AS start, coalesce(sum(n), 0) AS n FROM range(96) s(i) LEFT JOIN c ON (c.b - s.i + 96) % 96 < 24 GROUP BY s.i)
SELECT CAST(start * 900 AS INT) AS start_s, CAST((start + 24) * 900 % 86400 AS INT) AS end_s, CAST(n AS BIGINT) AS n FROM w ORDER BY n, start LIMIT 1""",
)
def _(s, d):
    return ft.night_window(train_of(adapter.auth(s, d))).select(F.col("start_s").cast("int"), F.col("end_s").cast("int"), "n")


@query(
    "f4_temporal",
    f"""{AUTH}, h AS (SELECT *, time % 86400 * (2 * pi() / 86400) AS th FROM auth),
x AS (SELECT *, atan2(sum(sin(th)) OVER p, sum(cos(th)) OVER p) AS prof, time - lag(time) OVER w AS gap, lag(dst_computer) OVER w = src_computer AS ch FROM h
 WINDOW w AS (PARTITION BY src_user ORDER BY time, event_id), p AS (PARTITION BY src_user ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, round(sin(th), 7) AS hour_sin, round(cos(th), 7) AS hour_cos, CAST(time % 86400 < 21600 AS INT) AS is_night, round(coalesce(abs((th - prof + pi()) % (2 * pi()) - pi()), 0), 7) AS hour_deviation_from_profile,
 round(gap / CAST(3600 AS DOUBLE), 9) AS hours_since_prev_event_same_user, CAST(coalesce(ch, false) AS INT) AS prev_dst_is_src FROM x""",
)
def _(s, d):
    x = ft.temporal_features(adapter.auth(s, d))
    since = F.when(F.col("hours_since_prev_event_same_user") < ft.INFINITY, F.round("hours_since_prev_event_same_user", 9)).alias("hours_since_prev_event_same_user")
    return x.select("event_id", *[F.round(c, 7).alias(c) for c in ("hour_sin", "hour_cos", "hour_deviation_from_profile")], "is_night", since, "prev_dst_is_src")


@query("vocabulary", f"{AUTH} SELECT dst_computer AS value, CAST(row_number() OVER (ORDER BY dst_computer) + 2 AS INT) AS code FROM (SELECT DISTINCT dst_computer FROM auth WHERE day <= 19 AND dst_computer IS NOT NULL)")
def _(s, d):
    return ft.fit_vocabulary(train_of(adapter.auth(s, d)), "dst_computer")


_VOC = """{n} AS (SELECT {c} AS v, CAST(row_number() OVER (ORDER BY {c}) + 2 AS INT) AS code FROM (SELECT DISTINCT {c} FROM auth WHERE day <= {last} AND {c} IS NOT NULL))"""


@query("encode_oov", f"{AUTH}, {_VOC.format(n='v', c='auth_type', last=0)} SELECT event_id, CASE WHEN auth_type IS NULL THEN 2 ELSE coalesce(code, 1) END AS code FROM auth LEFT JOIN v ON auth_type = v.v")
def _(s, d):
    a = adapter.auth(s, d)
    return ft.encode(a, "auth_type", ft.fit_vocabulary(split.by_days(a, 0, 0), "auth_type"), "code").select("event_id", "code")


def _sequence_sql(length: int) -> str:
    lists = ", ".join(
        f"array_to_string(list_concat(list_resize([]::INT[], {length} - len(coalesce({c}_l, [])), 0), coalesce({c}_l, [])), ' ') AS {n}" for c, n in (("dst", "dst_seq"), ("au", "auth_seq"), ("ok", "ok_seq"), ("gap", "gap_seq"))
    )
    over = f"OVER (PARTITION BY src_user ORDER BY time, event_id ROWS BETWEEN {length} PRECEDING AND 1 PRECEDING)"
    return f"""{AUTH}, {_VOC.format(n="vd", c="dst_computer", last=19)}, {_VOC.format(n="va", c="auth_type", last=19)},
x AS (SELECT a.event_id, a.time, a.src_user, coalesce(vd.code, 1) AS dst, CASE WHEN auth_type IS NULL THEN 2 ELSE coalesce(va.code, 1) END AS au, CASE WHEN success THEN 2 ELSE 1 END AS ok,
 coalesce(CAST(round(greatest(0, least(ln(CAST(a.time - lag(a.time) OVER (PARTITION BY src_user ORDER BY a.time, a.event_id) + 1 AS DOUBLE)), 20)) / 20 * 9) AS INT) + 2, 1) AS gap FROM auth a LEFT JOIN vd ON dst_computer = vd.v LEFT JOIN va ON auth_type = va.v),
y AS (SELECT event_id, dst AS dst_code, list(dst) {over} AS dst_l, list(au) {over} AS au_l, list(ok) {over} AS ok_l, list(gap) {over} AS gap_l FROM x)
SELECT event_id, dst_code, {lists} FROM y"""


@query("f6_sequences", _sequence_sql(8))
def _(s, d):
    a = adapter.auth(s, d)
    t = train_of(a)
    x = ft.sequence_features(a, {c: ft.fit_vocabulary(t, c) for c in ("dst_computer", "auth_type")}, 8)
    return x.select("event_id", "dst_code", *[F.array_join(F.col(c).cast("array<string>"), " ").alias(c) for c in ("dst_seq", "auth_seq", "ok_seq", "gap_seq")])


def _features_sql(first: int, last: int, history: int) -> str:
    """CTEs ending in `x`: all stored columns of the days first to last, from the events of the days history to last; frequencies are those of the training days."""
    frequency = lambda c: f"fr_{c} AS (SELECT {c} AS v, count(*) / CAST((SELECT count(*) FROM every WHERE day <= 19) AS DOUBLE) AS f FROM every WHERE day <= 19 GROUP BY 1)"
    rolling = lambda e, sec: f"(PARTITION BY {e} ORDER BY time RANGE BETWEEN {sec} PRECEDING AND 1 PRECEDING)"
    counts = []
    for h, n in ((3600, "1h"), (86_400, "1d")):
        w = rolling("src_user", h)
        failures = f"CAST(coalesce(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER {w}, 0) AS BIGINT)"
        counts += [f"count(*) OVER {w} AS src_user_{n}_n_events", f"round({failures} / CAST(greatest(count(*) OVER {w}, 1) AS DOUBLE), 9) AS src_user_{n}_failure_ratio"]
    novelty = ", ".join(_novelty_cte(r) for r in ft.RELATIONS)
    joins = " ".join(f"JOIN {r}_n ON {r}_n.event_id = a.event_id" for r in ft.RELATIONS)
    new = ", ".join(f"CAST({r}_n.k = 0 AS INT) AS {r}_is_new, round(-ln(({r}_n.k + 1) / ({r}_n.nb + 1)), 9) AS {ft.rarity_name(r)}" for r in ft.RELATIONS)
    pairs = ", ".join(f"CAST(coalesce(sum(pair_is_new) OVER {rolling(e, 86_400)}, 0) AS BIGINT) AS {n}" for e, n in ft.NEW_PAIRS.items())
    stored = ", ".join(["event_id", "time", "day", "is_malicious", *ft.READ_BY_NAME, *dict.fromkeys([*ft.model_columns(), *ft.rule_columns()])])
    return f"""{AUTH.replace("auth AS (", "every AS (", 1)}, auth AS (SELECT * FROM every WHERE day BETWEEN {history} AND {last}), {", ".join(frequency(c) for c in ft.CATEGORIES)}, {novelty},
dc AS (SELECT a.event_id, count(DISTINCT b.dst_computer) AS src_user_1h_n_distinct_dst FROM auth a LEFT JOIN auth b ON a.src_user = b.src_user AND b.time < a.time AND b.time >= a.time - 3600 GROUP BY 1),
h AS (SELECT *, time % 86400 * (2 * pi() / 86400) AS th FROM auth),
tm AS (SELECT *, atan2(sum(sin(th)) OVER q, sum(cos(th)) OVER q) AS prof, time - lag(time) OVER o AS gap, lag(dst_computer) OVER o = src_computer AS ch, {", ".join(counts)},
 CAST(coalesce(sum(CASE WHEN success THEN 0 ELSE 1 END) OVER {rolling("dst_computer", 3600)}, 0) AS BIGINT) AS dst_computer_1h_n_failures FROM h
 WINDOW o AS (PARTITION BY src_user ORDER BY time, event_id), q AS (PARTITION BY src_user ORDER BY time, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
j AS (SELECT a.*, dc.src_user_1h_n_distinct_dst, {new}, CAST(success AS INT) AS is_success, CAST(coalesce(src_user = dst_user, false) AS INT) AS src_dst_user_same, CAST(coalesce(src_computer = dst_computer, false) AS INT) AS src_dst_computer_same, CAST(coalesce(src_domain <> dst_domain, false) AS INT) AS domain_crossing,
 {", ".join(f"round(coalesce(fr_{c}.f, 0), 9) AS {c}_freq" for c in ft.CATEGORIES)}, round(sin(th), 7) AS hour_sin, round(cos(th), 7) AS hour_cos, round(coalesce(abs((th - prof + pi()) % (2 * pi()) - pi()), 0), 7) AS hour_deviation_from_profile,
 round(gap / CAST(3600 AS DOUBLE), 9) AS hours_since_prev_event_same_user, CAST(coalesce(ch, false) AS INT) AS prev_dst_is_src
 FROM tm a JOIN dc ON dc.event_id = a.event_id {joins} {" ".join(f"LEFT JOIN fr_{c} ON a.{c} IS NOT DISTINCT FROM fr_{c}.v" for c in ft.CATEGORIES)}),
g AS (SELECT *, {pairs} FROM j),
x AS (SELECT {stored} FROM g WHERE day BETWEEN {first} AND {last})"""


def _rounded(df: DataFrame) -> DataFrame:
    """Stored features at the precision at which two engines' trigonometry and logarithms agree; infinite values as null."""
    kinds = dict(df.dtypes)
    digits = lambda c: 7 if c.startswith("hour_") else 9
    finite = lambda c: F.when(F.abs(c) < ft.INFINITY, F.round(c, digits(c))).alias(c)
    return df.select(*[finite(c) if kinds[c] == "double" else F.col(c) for c in df.columns])


def store(s: SparkSession, d: str, first: int, last: int, history: str) -> DataFrame:
    a = adapter.auth(s, d)
    return ft.feature_store(a, train_of(a), first, last, history=history)


@query("feature_store_window", f"{_features_sql(25, 29, 23)} SELECT * FROM x")
def _(s, d):
    return _rounded(store(s, d, 25, 29, "window"))


@query("feature_store_cumulative", f"{_features_sql(25, 29, 0)} SELECT * FROM x")
def _(s, d):
    return _rounded(store(s, d, 25, 29, "cumulative"))


@query("featurize_by_day", f"{_features_sql(0, 29, 0)} SELECT * FROM x")
def _(s, d):
    a = adapter.auth(s, d).filter("day <= 29")
    x = daily.fold_days(a, train_of(a))
    return _rounded(x.select(*ft.store_columns(x)))


@query("model_columns", f"{_features_sql(25, 29, 23)} SELECT event_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in ft.model_columns())} FROM x")
def _(s, d):
    x = _rounded(store(s, d, 25, 29, "window"))
    return x.select("event_id", *[F.col(c).cast("double").alias(c) for c in ft.model_columns()])


# Graph --------------------------------------------------------------------------------------------------------

_EDGES = f"""{AUTH}, e AS (SELECT d.day, a.src_user AS user, a.dst_computer AS machine, count(*) AS weight FROM (SELECT DISTINCT day FROM auth) d JOIN auth a ON a.day BETWEEN d.day - 7 AND d.day - 1 GROUP BY 1, 2, 3)"""


@query("daily_edges", f"{_EDGES} SELECT * FROM e")
def _(s, d):
    return ft.trailing_edges(adapter.auth(s, d))


@query(
    "trailing_degree_7d",
    f"{_EDGES} SELECT day, 'u:' || user AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM e GROUP BY 1, 2 UNION ALL SELECT day, 'm:' || machine, count(*), CAST(sum(weight) AS BIGINT) FROM e GROUP BY 1, 2",
)
def _(s, d):
    return ft.degrees(ft.trailing_edges(adapter.auth(s, d)))


@query(
    "bipartite_clustering",
    f"""{_EDGES}, f AS (SELECT * FROM e), g AS (SELECT day, user, count(*) AS k FROM f GROUP BY 1, 2),
s AS (SELECT a.day, a.user, b.user AS other, count(*) AS c FROM f a JOIN f b ON a.day = b.day AND a.machine = b.machine AND a.user <> b.user GROUP BY 1, 2, 3),
m AS (SELECT s.day, s.user, avg(c / CAST(g.k + h.k - c AS DOUBLE)) AS v FROM s JOIN g ON s.day = g.day AND s.user = g.user JOIN g h ON s.day = h.day AND s.other = h.user GROUP BY 1, 2)
SELECT g.day, g.user, round(coalesce(v, 0), 9) AS clustering FROM g LEFT JOIN m ON g.day = m.day AND g.user = m.user""",
)
def _(s, d):
    return ft.bipartite_clustering(ft.trailing_edges(adapter.auth(s, d)))


def _pagerank_sql(rounds: int) -> str:
    steps = ["p0 AS (SELECT day, a AS node, size, CAST(1.0 / size AS DOUBLE) AS r FROM (SELECT o.*, count(*) OVER (PARTITION BY day) AS size FROM o))"]
    for i in range(rounds):
        steps.append(
            f"p{i + 1} AS (SELECT p.day, p.node, p.size, (1 - 0.85) / p.size + 0.85 * coalesce(q.f, 0) AS r FROM p{i} p LEFT JOIN (SELECT x.day, x.b AS node, sum(p{i}.r * x.w / CAST(o.t AS DOUBLE)) AS f FROM x JOIN o ON x.day = o.day AND x.a = o.a JOIN p{i} ON x.day = p{i}.day AND x.a = p{i}.node GROUP BY 1, 2) q ON p.day = q.day AND p.node = q.node)"
        )
    return f"""{_EDGES}, x AS (SELECT day, 'u:' || user AS a, 'm:' || machine AS b, weight AS w FROM e UNION ALL SELECT day, 'm:' || machine, 'u:' || user, weight FROM e),
o AS (SELECT day, a, sum(w) AS t FROM x GROUP BY 1, 2), {", ".join(steps)} SELECT day, node, round(r, 9) AS pagerank FROM p{rounds}"""


@query("pagerank_fixed_iter", _pagerank_sql(3))
def _(s, d):
    return ft.pagerank(ft.trailing_edges(adapter.auth(s, d)))


@query("communities")
def _(s, d):
    return ft.communities(ft.trailing_edges(adapter.auth(s, d)))


_SNAP = f"{AUTH}, sn AS (SELECT CAST(floor(time / 1800) AS BIGINT) AS snapshot, src_computer AS src, dst_computer AS dst, count(*) AS n FROM auth GROUP BY 1, 2, 3)"


@query("snapshot_edges", f"{_SNAP} SELECT * FROM sn")
def _(s, d):
    return ft.snapshot_edges(adapter.auth(s, d))


@query(
    "snapshot_edge_weight",
    f"{_SNAP} SELECT snapshot, src, dst, n, round(1 / (1 + exp(-CASE WHEN stddev_pop(n) OVER w > 0 THEN (n - avg(n) OVER w) / stddev_pop(n) OVER w ELSE 0 END)), 9) AS weight FROM sn WINDOW w AS (PARTITION BY snapshot)",
)
def _(s, d):
    return ft.snapshot_weights(ft.snapshot_edges(adapter.auth(s, d)))


@query(
    "labelled_snapshot_edges",
    f"{_SNAP}, r AS (SELECT DISTINCT CAST(floor(time / 1800) AS BIGINT) AS snapshot, src_computer AS src, dst_computer AS dst FROM auth WHERE is_malicious) SELECT sn.*, r.src IS NOT NULL AS is_malicious FROM sn LEFT JOIN r ON sn.snapshot = r.snapshot AND sn.src = r.src AND sn.dst = r.dst",
)
def _(s, d):
    a = adapter.auth(s, d)
    red = a.filter("is_malicious").select(F.floor(F.col("time") / 1800).alias("snapshot"), F.col("src_computer").alias("src"), F.col("dst_computer").alias("dst")).distinct().withColumn("hit", F.lit(True))
    return ft.snapshot_edges(a).join(red, ["snapshot", "src", "dst"], "left").withColumn("is_malicious", F.coalesce("hit", F.lit(False))).drop("hit")


@query(
    "new_edges_per_snapshot",
    f"{_SNAP} SELECT snapshot, count(*) FILTER (f = snapshot) AS new_edges FROM (SELECT *, min(snapshot) OVER (PARTITION BY src, dst) AS f FROM sn) GROUP BY snapshot",
)
def _(s, d):
    e = ft.snapshot_edges(adapter.auth(s, d))
    return e.withColumn("first", F.min("snapshot").over(Window.partitionBy("src", "dst"))).groupBy("snapshot").agg(F.count_if(F.col("first") == F.col("snapshot")).alias("new_edges"))


_STAR_EARLY = "WITH " + adapter.star_cte()

# Scores -------------------------------------------------------------------------------------------------------


@query(
    "m0a_splitmix",
    f"""{AUTH}, a1 AS (SELECT event_id, (event_id::UHUGEINT + 11400714819323198485::UHUGEINT * 4) % 18446744073709551616::UHUGEINT AS z FROM auth),
a2 AS (SELECT event_id, xor(z, z >> 30) * 13787848793156543929::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM a1),
a3 AS (SELECT event_id, xor(z, z >> 27) * 10723151780598845931::UHUGEINT % 18446744073709551616::UHUGEINT AS z FROM a2)
SELECT event_id, round(CAST(xor(z, z >> 31) >> 11 AS DOUBLE) / 9007199254740992.0, 9) AS score FROM a3""",
)
def _(s, d):
    return sc.RandomFloor(3).score(adapter.auth(s, d).select("event_id")).select("event_id", F.round("score", 9).alias("score"))


@query("m0b_always_fail", f"{AUTH} SELECT event_id, CASE WHEN success THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS score FROM auth")
def _(s, d):
    return sc.AlwaysFail().score(adapter.auth(s, d)).select("event_id", "score")


@query("m2a_rarity", f"{AUTH}, {_novelty_cte('pair')} SELECT event_id, round(-ln((k + 1) / (nb + 1)), 9) AS score FROM pair_n")
def _(s, d):
    x = ft.novelty_features(adapter.auth(s, d), {"pair": ft.RELATIONS["pair"]})
    return sc.PAIR_RARITY.score(x).select("event_id", F.round("score", 9).alias("score"))


@query("m2c_source_rarity", f"{AUTH}, {_novelty_cte('user_src')} SELECT event_id, round(-ln((k + 1) / (nb + 1)), 9) AS score FROM user_src_n")
def _(s, d):
    x = ft.novelty_features(adapter.auth(s, d), {k: ft.RELATIONS[k] for k in ("pair", "user_src")})
    return sc.SOURCE_RARITY.score(x).select("event_id", F.round("score", 9).alias("score"))


_E = ["l_quantity", "l_extendedprice", "l_discount"]


@query(
    "m3b_ecod_tails",
    "WITH x AS (SELECT l_orderkey * 10 + l_linenumber AS event_id, l_quantity AS q FROM lineitem) SELECT event_id, rank() OVER (ORDER BY q) - 1 + count(*) OVER (PARTITION BY q) AS q_le, rank() OVER (ORDER BY q DESC) - 1 + count(*) OVER (PARTITION BY q) AS q_ge FROM x",
)
def _(s, d):
    x = adapter.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("event_id"), F.col("l_quantity").alias("q"))
    levels = x.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    le = F.sum("n").over(Window.orderBy("q").rowsBetween(Window.unboundedPreceding, 0))
    ge = F.sum("n").over(Window.orderBy(F.col("q").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return x.join(levels.withColumns({"q_le": le, "q_ge": ge}), "q").select("event_id", "q_le", "q_ge")


#: Components of a vector of the test tables.
DIMS = 64


def matrix(s: SparkSession, d: str) -> DataFrame:
    e = adapter.table(s, d, "embeddings")
    return e.select(F.col("vec_id").alias("event_id"), *[F.element_at("embedding", i + 1).cast("double").alias(f"x{i}") for i in range(DIMS)], (F.col("label") == 3).alias("is_malicious"))


_X = [f"x{i}" for i in range(DIMS)]
_MATRIX = "WITH m AS (SELECT vec_id AS event_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS x{i}" for i in range(DIMS)) + " FROM embeddings)"


def _ecod_sql() -> str:
    parts = []
    for c in _X:
        left = f"-ln((rank() OVER (ORDER BY {c}) - 1 + count(*) OVER (PARTITION BY {c}) + 1) / (n + 1.0))"
        right = f"-ln((rank() OVER (ORDER BY {c} DESC) - 1 + count(*) OVER (PARTITION BY {c}) + 1) / (n + 1.0))"
        parts.append(f"greatest(CASE sign(sk_{c}) WHEN -1 THEN {left} WHEN 1 THEN {right} ELSE {left} + {right} END, {left}, {right})")
    skew = ", ".join(f"avg(({c} - mean_{c}) ** 3) AS sk_{c}" for c in _X)
    means = ", ".join(f"avg({c}) AS mean_{c}" for c in _X)
    return f"""{_MATRIX}, a AS (SELECT count(*) AS n, {means} FROM m), b AS (SELECT {skew} FROM m, a), c AS (SELECT m.*, b.*, a.n FROM m, a, b) SELECT event_id, round({" + ".join(parts)}, 6) AS score FROM c"""


@query("m3b_ecod", _ecod_sql())
def _(s, d):
    m = matrix(s, d)
    return sc.Ecod(_X).fit(m).score(m).select("event_id", F.round("score", 6).alias("score"))


def _hbos_sql() -> str:
    ctes, terms = [], []
    for c in _X:
        ctes.append(f"b_{c} AS (SELECT event_id, greatest(0, least(9, CAST(floor(({c} - lo) * 10 / (hi - lo)) AS INT))) AS b, t.n FROM m, (SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS n FROM m) t)")
        ctes.append(f"s_{c} AS (SELECT event_id, -log2(count(*) OVER (PARTITION BY b) / CAST(n AS DOUBLE) + 0.5) AS v FROM b_{c})")
        terms.append(f"s_{c}.v")
    return f"{_MATRIX}, {', '.join(ctes)} SELECT m.event_id, round({' + '.join(terms)}, 5) AS score FROM m " + " ".join(f"JOIN s_{c} ON m.event_id = s_{c}.event_id" for c in _X)


@query("m3b_hbos", _hbos_sql())
def _(s, d):
    m = matrix(s, d)
    return sc.Hbos(_X).fit(m).score(m).select("event_id", F.round("score", 5).alias("score"))


for _name, _model in (("m2b_pca", sc.Pca), ("m3a_iforest", sc.IsolationForest), ("m3c_lof", sc.Lof), ("m4a_autoencoder", sc.Autoencoder)):

    @query(_name)
    def _(s, d, model=_model):
        m = matrix(s, d)
        return model(_X).fit(m).score(m).select("event_id", F.round("score", 6).alias("score"))


@query(
    "m1_r2_threshold",
    f"""{AUTH}, x AS (SELECT a.src_user, a.event_id, count(DISTINCT b.dst_computer) AS n FROM auth a LEFT JOIN auth b ON a.src_user = b.src_user AND b.time < a.time AND b.time >= a.time - 3600 WHERE a.day <= 19 GROUP BY 1, 2),
r AS (SELECT src_user, n, row_number() OVER (PARTITION BY src_user ORDER BY n, event_id) AS r, count(*) OVER (PARTITION BY src_user) AS m FROM x) SELECT src_user, CAST(n AS DOUBLE) AS threshold FROM r WHERE r = floor(0.999 * (m - 1) + 0.5) + 1""",
)
def _(s, d):
    a = train_of(adapter.auth(s, d)).select("event_id", "time", "src_user", "dst_computer")
    return sc.fan_out_thresholds(causal.distinct_count(a, "src_user", "dst_computer", 3600, "src_user_1h_n_distinct_dst"))


@query("m1_ecdf", f"{_STAR_EARLY} SELECT event_id, round((rank() OVER (ORDER BY score) - 1 + count(*) OVER (PARTITION BY score) / 2.0) / count(*) OVER (), 9) AS ecdf FROM star")
def _(s, d):
    x = adapter.star(s, d).select("event_id", "score")
    return sc.mid_ranks(x, x, ["score"]).select("event_id", F.round("score_ecdf", 9).alias("ecdf"))


def _rules_sql() -> str:
    """CTEs ending in `e`: raw rules and ECDFs of all stored days, fitted on the training days; the scales on the last of them."""
    # R4 is compared at the precision of the stored angle
    raw = {
        "R1_new_pair": "pair_is_new",
        "R2_host_burst": "greatest(0, src_user_1h_n_distinct_dst - coalesce(threshold, mean, 0))",
        "R3_fail_then_success": "dst_computer_1h_n_failures * is_success",
        "R4_offhours": "hour_deviation_from_profile",
        "R5_machine_account_anomaly": "CASE WHEN src_user_is_machine THEN pair_global_rarity ELSE 0 END",
        "R6_new_auth_type": "user_auth_is_new",
        "R7_lateral_chain": "CASE WHEN prev_dst_is_src = 1 AND hours_since_prev_event_same_user * 3600 <= 1800 THEN 1 ELSE 0 END",
        "R8_new_source": "user_src_is_new",
    }
    columns = ", ".join(f"round(CAST({sql} AS DOUBLE), 9) AS {r}" for r, sql in raw.items())
    ecdf = ", ".join(f"(coalesce(list_sum(list_transform(l_{r}, lambda v: CASE WHEN v < r.{r} THEN 1.0 WHEN v = r.{r} THEN 0.5 ELSE 0.0 END)), 0) / greatest(n, 1)) AS {r}_ecdf" for r in sc.RULES)
    return f"""{_features_sql(0, 29, 0)},
qr AS (SELECT src_user, src_user_1h_n_distinct_dst AS n, row_number() OVER (PARTITION BY src_user ORDER BY src_user_1h_n_distinct_dst, event_id) AS r, count(*) OVER (PARTITION BY src_user) AS m FROM x WHERE day <= 19),
th AS (SELECT src_user, CAST(n AS DOUBLE) AS threshold FROM qr WHERE r = floor(0.999 * (m - 1) + 0.5) + 1), mn AS (SELECT avg(threshold) AS mean FROM th),
raw AS (SELECT x.event_id, x.day, x.is_malicious, {columns} FROM x LEFT JOIN th ON x.src_user = th.src_user CROSS JOIN mn),
fit AS (SELECT count(*) AS n, {", ".join(f"list({r}) AS l_{r}" for r in sc.RULES)} FROM raw WHERE day = (SELECT max(day) FROM raw WHERE day <= 19)),
e AS (SELECT r.*, {ecdf} FROM raw r CROSS JOIN fit WHERE r.day >= 20)"""


def rule_store(s: SparkSession, d: str) -> DataFrame:
    """The stored features of every day, written once: thresholds, scales and scores all read the store."""
    return written(_rounded(store(s, d, 0, 29, "cumulative")), "store")


@query("m1_raw_rules", f"{_rules_sql()} SELECT event_id, {', '.join(sc.RULES)} FROM raw WHERE day >= 20")
def _(s, d):
    x = rule_store(s, d)
    raw = sc.raw_rules(split.by_days(x, 20, 29), sc.fan_out_thresholds(train_of(x)))
    return raw.select("event_id", *[F.round(r, 9).alias(r) for r in sc.RULES])


_UNIFORM = " + ".join(f"{r}_ecdf" for r in sc.RULES)


@query("m1u_score", f"{_rules_sql()} SELECT event_id, round(({_UNIFORM}) / 8, 6) AS score FROM e WHERE day >= 25")
def _(s, d):
    x = rule_store(s, d)
    return sc.Rules(name="m1u").fit(train_of(x)).score(split.by_days(x, 25, 29)).select("event_id", F.round("score", 6).alias("score"))


def _discrimination_sql() -> str:
    each = " UNION ALL ".join(f"SELECT '{r}' AS rule, avg(CASE WHEN NOT is_malicious THEN {r}_ecdf END) AS b, avg(CASE WHEN is_malicious THEN {r}_ecdf END) AS m FROM e" for r in sc.RULES)
    return f"{_rules_sql()}, a AS ({each}) SELECT rule, round(b, 6) AS benign, round(m, 6) AS malicious, round(CASE WHEN b <> 0 THEN m / b END, 6) AS ratio, 0.125::DOUBLE AS weight FROM a"


@query("rule_discrimination", _discrimination_sql())
def _(s, d):
    x = rule_store(s, d)
    m = sc.Rules().fit(train_of(x))
    return sc.rule_discrimination(m.ecdfs(split.by_days(x, 20, 29)), m.weights)


# Budgets ------------------------------------------------------------------------------------------------------

_SC = f"""{_LAB}, {_novelty_cte("pair")}, sd AS (SELECT l.event_id, l.time, l.day, l.src_user, l.src_computer, l.dst_computer, l.is_malicious, l.campaign, round(-ln((k + 1) / (nb + 1)), 9) AS score FROM lab l JOIN pair_n USING (event_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, time, event_id) AS rank, rank() OVER (PARTITION BY day ORDER BY score DESC) AS rank_best,
 rank() OVER (PARTITION BY day ORDER BY score DESC) + count(*) OVER (PARTITION BY day, score) - 1 AS rank_worst, row_number() OVER (PARTITION BY day ORDER BY score DESC, is_malicious, time, event_id) AS rank_against FROM sd),
led AS (SELECT event_id, campaign, day, time, rank, rank_best, rank_worst, rank_against FROM rk WHERE is_malicious)"""


def scored(s: SparkSession, d: str) -> DataFrame:
    x = ft.novelty_features(labelled(s, d), {"pair": ft.RELATIONS["pair"]})
    return x.select("event_id", "time", "day", "src_user", "src_computer", "dst_computer", "is_malicious", "campaign", F.round("pair_global_rarity", 9).alias("score"))


@query(
    "budget_recall_pair_rarity",
    f"{_SC} SELECT day, count(*) AS events, count(*) FILTER (is_malicious) AS positives, count(*) FILTER (is_malicious AND rank <= 50) AS caught, count(DISTINCT campaign) FILTER (is_malicious AND rank <= 50) AS campaigns_caught FROM rk GROUP BY day",
)
def budget_recall(s, d):
    r = ev.ranked(scored(s, d))
    hit = F.col("is_malicious") & (F.col("rank") <= 50)
    return r.groupBy("day").agg(F.count(F.lit(1)).alias("events"), F.count_if("is_malicious").alias("positives"), F.count_if(hit).alias("caught"), F.count_distinct(F.when(hit, F.col("campaign"))).alias("campaigns_caught"))


@query("alerts_at_k", f"{_SC} SELECT day, event_id, rank FROM rk WHERE rank <= 20")
def _(s, d):
    return ev.alerts_at_budget(scored(s, d), 20).select("day", "event_id", "rank")


@query("positives_ledger", f"{_SC} SELECT * FROM led")
def _(s, d):
    return ev.positives_ledger(scored(s, d))


def _curve_sql(rank: str) -> str:
    return f"""{_SC} SELECT b.budget, round(avg(CASE WHEN {rank} <= b.budget THEN 1.0 ELSE 0.0 END), 9) AS event_recall, round(count(DISTINCT campaign) FILTER ({rank} <= b.budget) / CAST(count(DISTINCT campaign) AS DOUBLE), 9) AS campaign_recall
FROM led CROSS JOIN (VALUES (10), (50), (100), (500)) b(budget) GROUP BY b.budget"""


for _name, _rank in (("budget_curve", "rank"), ("recall_against_model", "rank_against"), ("recall_best_tie_bound", "rank_best")):

    @query(_name, _curve_sql(_rank))
    def _(s, d, rank=_rank):
        return ev.budget_curve(ev.positives_ledger(scored(s, d)), rank=rank)


_STAR = "WITH " + adapter.star_cte()


@query(
    "tie_exposure",
    f"""{_STAR}, r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, time, event_id) AS rk FROM star), c AS (SELECT day, min(score) AS cut, count(*) AS taken FROM r WHERE rk <= 5 GROUP BY day),
x AS (SELECT r.day, count(*) AS tied, count(*) FILTER (rk <= 5) AS slots FROM r JOIN c ON r.day = c.day AND r.score = c.cut WHERE taken = 5 GROUP BY r.day)
SELECT count(*) AS days, CAST(coalesce(sum(slots), 0) AS BIGINT) AS contested_slots, CAST(coalesce(sum(tied), 0) AS BIGINT) AS contenders FROM x WHERE tied > slots""",
)
def _(s, d):
    return ev.tie_exposure(adapter.star(s, d), 5)


@query("detection_budgets", f"{_SC} SELECT campaign, min(rank) AS budget, min(rank_best) AS best, min(rank_worst) AS worst FROM led GROUP BY campaign")
def _(s, d):
    return ev.detection_budgets(ev.positives_ledger(scored(s, d)))


@query("first_detection", f"{_SC} SELECT min(rank) AS budget FROM led")
def _(s, d):
    return ev.positives_ledger(scored(s, d)).agg(F.min("rank").alias("budget"))


_DB = f"{_SC}, db AS (SELECT campaign, min(rank) AS budget FROM led GROUP BY campaign)"


@query(
    "budget_quantiles",
    f"{_DB}, o AS (SELECT budget, row_number() OVER (ORDER BY budget, campaign) AS i, count(*) OVER () AS n FROM db) SELECT CAST(q AS DOUBLE) AS quantile, budget FROM o, (VALUES (0.25::DOUBLE), (0.5), (0.75), (0.9)) v(q) WHERE i = greatest(1, ceil(q * n))",
)
def _(s, d):
    return ev.budget_quantiles(ev.detection_budgets(ev.positives_ledger(scored(s, d))))


@query("log_area", f"{_DB} SELECT round(avg(greatest(0, ln(1000.0 / budget) / ln(1000.0))), 9) AS log_area, count(*) AS campaigns FROM db")
def _(s, d):
    return ev.log_area(ev.detection_budgets(ev.positives_ledger(scored(s, d))), 1000)


@query("ttd", f"{_SC} SELECT campaign, min(time) FILTER (rank <= 100) - min(time) AS delay FROM led GROUP BY campaign")
def _(s, d):
    return ev.time_to_detection(ev.positives_ledger(scored(s, d)), 100)


@query("day_sizes", f"{AUTH} SELECT day, count(*) AS events, count(*) FILTER (is_malicious) AS positives FROM auth GROUP BY day")
def _(s, d):
    return ev.day_sizes(adapter.auth(s, d))


@query(
    "random_survival",
    f"""{AUTH}, z AS (SELECT day, count(*) AS n, count(*) FILTER (is_malicious) AS p FROM auth GROUP BY day), t AS (SELECT unnest(range(p)) AS i, n FROM z WHERE p > 0)
SELECT round(exp(sum(ln(1 - 10.0 / (n - i)))), 9) AS survival FROM t""",
)
def _(s, d):
    return ev.random_survival(ev.day_sizes(adapter.auth(s, d)), 10)


for _hours in (1, 24, 72):
    _g = f"""{_SC}, g AS (SELECT l.*, d.src_user, CASE WHEN l.time - lag(l.time) OVER (PARTITION BY src_user ORDER BY l.time, l.event_id) <= {_hours * 3600} THEN 0 ELSE 1 END AS st FROM led l JOIN sd d USING (event_id)),
h AS (SELECT *, src_user || '#' || CAST(CAST(sum(st) OVER (PARTITION BY src_user ORDER BY time, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS VARCHAR) AS c FROM g)
SELECT count(*) AS campaigns, round(avg(greatest(0, ln(1000.0 / b) / ln(1000.0))), 9) AS log_area FROM (SELECT c, min(rank) AS b FROM h GROUP BY c)"""

    @query(f"gap_sensitivity_{_hours}h", _g)
    def _(s, d, hours=_hours):
        x = scored(s, d)
        led = ev.ranked(x).filter("is_malicious")
        return ev.log_area(ev.detection_budgets(ev.regrouped(led, hours * 3600, ["src_user"])), 1000)


def _unit_sql(unit: str, columns: str) -> str:
    return f"""{_SC}, u AS (SELECT day, {unit}, max(score) AS score, min(time) AS time, bool_or(is_malicious) AS m, min(campaign) AS campaign FROM sd GROUP BY day, {columns}),
r AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY score DESC, time, {columns}) AS rank FROM u) SELECT day, {columns}, score, campaign, rank FROM r WHERE m"""


@query("unit_user_day", _unit_sql("src_user", "src_user"))
def _(s, d):
    return ev.unit_ledger(scored(s, d), ["src_user"]).select("day", "src_user", "score", "campaign", "rank")


@query("unit_edge_hour", _unit_sql("src_computer, dst_computer, CAST(floor(time / 3600) AS BIGINT) AS hour", "src_computer, dst_computer, hour"))
def _(s, d):
    x = scored(s, d).withColumn("hour", F.floor(F.col("time") / 3600))
    return ev.unit_ledger(x, ["src_computer", "dst_computer", "hour"]).select("day", "src_computer", "dst_computer", "hour", "score", "campaign", "rank")


@query(
    "user_day_activity",
    f"""{AUTH}, u AS (SELECT day, src_user, count(DISTINCT dst_computer) AS n_distinct, count(*) AS n_events, min(time) AS first_time, bool_or(is_malicious) AS is_malicious FROM auth GROUP BY day, src_user)
SELECT *, row_number() OVER (PARTITION BY day ORDER BY n_distinct DESC, first_time, src_user) AS rank FROM u""",
)
def _(s, d):
    return ev.user_day_activity(adapter.auth(s, d))


@query(
    "fixed_threshold",
    f"""{_SC}, th AS (SELECT CASE WHEN count(*) = 100 THEN min(score) ELSE '-infinity'::DOUBLE END AS t FROM (SELECT score FROM sd WHERE day BETWEEN 20 AND 24 ORDER BY score DESC, time, event_id LIMIT 100))
SELECT count(*) FILTER (score >= t) AS alerts, round(avg(CASE WHEN is_malicious THEN CASE WHEN score >= t THEN 1.0 ELSE 0.0 END END), 9) AS event_recall,
 round(count(DISTINCT campaign) FILTER (is_malicious AND score >= t) / CAST(count(DISTINCT campaign) AS DOUBLE), 9) AS campaign_recall FROM sd, th WHERE day BETWEEN 25 AND 29""",
)
def _(s, d):
    x = scored(s, d)
    t = ev.alert_threshold(split.by_days(x, 20, 24), 20, 5)
    return ev.at_threshold(split.by_days(x, 25, 29), t)


@query(
    "score_resolution",
    f"{_STAR}, c AS (SELECT day, score, count(*) AS n FROM star GROUP BY 1, 2), e AS (SELECT day, count(*) AS k, max(n) / CAST(sum(n) AS DOUBLE) AS sh FROM c GROUP BY day) SELECT min(k) AS least_distinct, round(max(sh), 9) AS largest_tie_share FROM e",
)
def _(s, d):
    return ev.score_resolution(adapter.star(s, d))


# Ranking metrics ----------------------------------------------------------------------------------------------


def _metric_sql(prefix: str, source: str) -> str:
    return f"""{prefix}, g AS (SELECT score, count(*) FILTER (is_malicious) AS tp, count(*) FILTER (NOT is_malicious) AS fp FROM {source} GROUP BY score),
c AS (SELECT *, sum(tp) OVER w AS ctp, sum(fp) OVER w AS cfp, CAST(sum(tp) OVER () AS DOUBLE) AS p, CAST(sum(fp) OVER () AS DOUBLE) AS n FROM g WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(tp / p * ctp / (ctp + cfp)), 9) AS average_precision, round(sum(tp * ((n - cfp) + 0.5 * fp)) / (max(p) * max(n)), 9) AS roc_auc, round(sum(tp * fp) / (max(p) * max(n)), 9) AS tied_pair_fraction,
 round(max(CASE WHEN cfp <= 0.01 * n THEN ctp / p ELSE 0 END), 9) AS recall_at_fpr FROM c"""


def toxic_by_length(s: SparkSession, d: str) -> DataFrame:
    x = adapter.table(s, d, "labels").join(adapter.table(s, d, "documents"), "doc_id")
    return x.select(F.col("doc_id").alias("event_id"), F.lit(0).alias("time"), F.lit(0).alias("day"), (F.col("toxic") == 1).alias("is_malicious"), F.col("doc_id").cast("string").alias("campaign"), F.col("n_chars").cast("double").alias("score"))


_TOX = "WITH tox AS (SELECT doc_id AS event_id, toxic = 1 AS is_malicious, CAST(n_chars AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id))"


@query("ranking_metrics_star", _metric_sql(_STAR, "star"))
def _(s, d):
    return ev.ranking_metrics(ev.score_levels(adapter.star(s, d)))


@query("ranking_metrics_pair_rarity", _metric_sql(_SC, "sd"))
def _(s, d):
    return ev.ranking_metrics(ev.score_levels(scored(s, d)))


@query("ranking_metrics_labels", _metric_sql(_TOX, "tox"))
def _(s, d):
    return ev.ranking_metrics(ev.score_levels(toxic_by_length(s, d)))


@query("precision_at_k", f"{_TOX} SELECT round(avg(CASE WHEN is_malicious THEN 1.0 ELSE 0.0 END), 9) AS precision FROM (SELECT is_malicious FROM tox ORDER BY score DESC, event_id LIMIT 50)")
def _(s, d):
    return ev.precision_at(toxic_by_length(s, d), 50)


@query(
    "campaign_weighted_ap",
    f"""{_SC}, w AS (SELECT score, is_malicious, CASE WHEN is_malicious THEN 1.0::DOUBLE / count(*) OVER (PARTITION BY campaign) ELSE 0 END AS w FROM sd),
g AS (SELECT score, sum(w) AS w, count(*) FILTER (NOT is_malicious) AS fp FROM w GROUP BY score), c AS (SELECT *, sum(w) OVER o AS cw, sum(fp) OVER o AS cfp, sum(w) OVER () AS t FROM g WINDOW o AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(w / t * cw / (cw + cfp)), 9) AS weighted_ap FROM c""",
)
def _(s, d):
    return ev.campaign_weighted_ap(scored(s, d))


@query(
    "benign_bins",
    f"""{_STAR}, g AS (SELECT score, count(*) FILTER (is_malicious) AS pos, count(*) FILTER (NOT is_malicious) AS neg FROM star GROUP BY score), c AS (SELECT *, CAST(sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cn FROM g)
SELECT score AS score_floor, CAST(cn - coalesce(lag(cn) OVER (ORDER BY score DESC), 0) AS BIGINT) AS benign, pos FROM c WHERE pos > 0""",
)
def _(s, d):
    return ev.benign_bins(adapter.star(s, d))


@query(
    "spearman_models",
    "WITH r AS (SELECT rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS a, rank() OVER (ORDER BY doc_id % 97) + (count(*) OVER (PARTITION BY doc_id % 97) - 1) / 2.0 AS b FROM documents) SELECT round(corr(a, b), 9) AS rho FROM r",
)
def _(s, d):
    return ev.spearman(adapter.table(s, d, "documents").select("n_chars", (F.col("doc_id") % 97).alias("m")), "n_chars", "m")


# Inference ----------------------------------------------------------------------------------------------------

_P = "(VALUES ('a', 0.001), ('b', 0.04), ('c', 0.03), ('d', 0.2), ('e', 0.012)) v(name, p)"


def _p_values(s: SparkSession) -> DataFrame:
    return s.createDataFrame([("a", 0.001), ("b", 0.04), ("c", 0.03), ("d", 0.2), ("e", 0.012)], "name string, p double")


@query(
    "holm_adjusted",
    f"WITH x AS (SELECT name, CAST(p AS DOUBLE) AS p, row_number() OVER (ORDER BY p, name) AS r, count(*) OVER () AS m FROM {_P}), y AS (SELECT name, p, round(max(least(1.0::DOUBLE, (m - r + 1) * p)) OVER (ORDER BY p, name ROWS UNBOUNDED PRECEDING), 9) AS adjusted FROM x) SELECT *, adjusted <= 0.05 AS rejected FROM y",
)
def _(s, d):
    return ev.holm(_p_values(s))


@query("p_value_se", f"SELECT name, round(sqrt(2 * CAST(p AS DOUBLE) * (1 - p / 2) / 10000), 12) AS se, CAST(ceil(2 * 5 / 0.05) - 1 AS BIGINT) AS least_rounds FROM {_P}")
def _(s, d):
    return _p_values(s).select("name", F.round(F.sqrt(2 * F.col("p") * (1 - F.col("p") / 2) / 10000), 12).alias("se"), (F.ceil(F.lit(2 * 5) / F.lit(0.05)) - 1).cast("bigint").alias("least_rounds"))


@query(
    "comparison_sentence",
    f"SELECT name, 'rules ' || CASE WHEN p <= 0.05 THEN 'outperforms' ELSE 'does not significantly outperform' END || ' ' || name || ' (p = ' || printf('%.4f', CAST(p AS DOUBLE)) || ')' AS sentence FROM {_P}",
)
def _(s, d):
    verb = F.when(F.col("p") <= 0.05, "outperforms").otherwise("does not significantly outperform")
    return _p_values(s).select("name", F.format_string("rules %s %s (p = %.4f)", verb, "name", "p").alias("sentence"))


@query("staffing", "SELECT CAST(b AS INT) AS budget, CAST(m AS INT) AS minutes, round(b * m / CAST(162 AS DOUBLE), 6) AS analysts, CAST(ceil(b * m / CAST(162 AS DOUBLE)) AS BIGINT) AS whole_analysts FROM (VALUES (10), (50), (100), (500)) x(b), (VALUES (5), (10), (20), (30)) y(m)")
def _(s, d):
    return ev.staffing(s.createDataFrame([(b,) for b in ev.BUDGETS], "budget int"))


@query(
    "partition_diagnostics",
    f"""{AUTH}, f AS (SELECT day, count(*) AS new_pairs FROM (SELECT min(day) AS day FROM auth GROUP BY src_user, dst_computer) GROUP BY day)
SELECT a.day, count(*) AS events, round(avg(CASE WHEN src_user_is_machine THEN 1.0 ELSE 0.0 END), 9) AS machine_share, coalesce(any_value(f.new_pairs), 0) AS new_pairs FROM auth a LEFT JOIN f ON a.day = f.day GROUP BY a.day""",
)
def _(s, d):
    return ev.partition_diagnostics(adapter.auth(s, d))


@query("redteam_concentration", f"{_RED} SELECT src_computer, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 9) AS share, count(DISTINCT user || '@' || domain) AS accounts FROM red GROUP BY src_computer ORDER BY n DESC, src_computer LIMIT 3")
def _(s, d):
    return ev.concentration(clean.clean_redteam(adapter.redteam_raw(s, d)))


def _top_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT event_id, '{c}' AS name, -abs(round({c}, 6)) AS k FROM m" for c in _X)
    return f"{_MATRIX}, p AS ({rows}), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY k, name) AS i FROM p) SELECT event_id, string_agg(name, ',' ORDER BY i) AS contributions FROM r WHERE i <= 3 GROUP BY event_id"


@query("top_contributions", _top_sql())
def _(s, d):
    return ev.top_contributions(matrix(s, d), _X)


# Inference on gathered tables ---------------------------------------------------------------------------------


def _positives_by_level(s: SparkSession, d: str):
    """Levels of the star log and its positives: eleven scores and a few hundred rows."""
    x = adapter.star(s, d)
    levels = ev.score_levels(x).orderBy(F.col("score").desc()).toPandas()
    at = {v: i for i, v in enumerate(levels["score"])}
    pos = x.filter("is_malicious").select("score", "campaign").toPandas()
    return levels["neg"].to_numpy(), pos["score"].map(at).to_numpy(), pos["campaign"].to_numpy()


@query("bootstrap_bca")
def _(s, d):
    neg, level, campaign = _positives_by_level(s, d)
    samples = rs.paired_bootstrap({"m": level}, {"m": neg}, campaign, 500, 1)["m"]
    estimate = rs.average_precision(np.bincount(level, minlength=len(neg)), neg)
    low, high = rs.bca_interval(samples, estimate, rs.jackknife(level, neg, campaign))
    return s.createDataFrame([(round(estimate, 9), round(low, 9), round(high, 9))], "estimate double, low double, high double")


@query("cluster_bootstrap")
def _(s, d):
    samples = rs.cluster_bootstrap(adapter.star(s, d), "src_user", 500, 1)
    return s.createDataFrame([(float(np.mean(samples)), float(np.quantile(samples, 0.025)), float(np.quantile(samples, 0.975)))], "mean double, low double, high double")


@query("random_ranking_null")
def _(s, d):
    days = [(r["events"], r["positives"]) for r in ev.day_sizes(adapter.auth(s, d)).collect()]  # one row a day
    ranks = rs.random_ranking(days, 300, 1)
    return s.createDataFrame([(float(np.median(ranks)), rs.first_detection_quantile(days, 0.5))], "median double, closed_form long")


@query("best_tie_matching")
def _(s, d):
    rows = ev.positives_ledger(adapter.star(s, d).withColumn("campaign", F.col("campaign").cast("string"))).select("day", "campaign", "rank_best", "rank_worst").collect()  # positives only
    return s.createDataFrame([(k, rs.best_tie_campaign_recall([tuple(r) for r in rows], k)) for k in (1, 2, 5)], "budget int, recall double")


@query("tuning")
def _(s, d):
    m = matrix(s, d)
    return tuning.tune(lambda c: sc.Hbos(_X, **c), [{"bins": b, "tolerance": t} for b in (5, 10, 20) for t in (0.1, 0.5)], m, m)


@query("fit_variance")
def _(s, d):
    m = matrix(s, d)
    return tuning.fit_variance(lambda seed: sc.IsolationForest(_X, trees=25, seed=seed), (0, 1, 2), m, m)


@query("m5c_snapshot_links")
def _(s, d):
    return walks.link_scores(adapter.auth(s, d), dims=8)


def _wide(f, columns):
    return lambda s, d: (x := f(s, d)).withColumns({c: x[c].cast("bigint") for c in columns})


for _name, _columns in {
    "alerts_at_k": ["rank"], "positives_ledger": ["rank", "rank_best", "rank_worst", "rank_against"], "detection_budgets": ["budget", "best", "worst"], "first_detection": ["budget"], "budget_quantiles": ["budget"],
    "unit_user_day": ["rank"], "unit_edge_hour": ["rank"], "user_day_activity": ["rank"], "first_occurrence": ["pair_index"],
}.items():
    QUERIES[_name] = _wide(QUERIES[_name], _columns)
