"""Log-shaped views over the star-schema test tables, in Spark and as the equivalent DuckDB SQL.

`auth` is the typed log (17 columns and a label), `raw_log` its text form with malformed rows, `redteam_raw`
the list of confirmed intrusions with repeated rows, `star` a log with day resolution and so with many ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LABELS = {
    "plain": "(value >= 200 AND event_type <> 'error' AND user_id % 5 <> 0)",
    "rich": "(user_id % 25 = 3 AND event_type IN ('purchase', 'click'))",
}

_AUTH = """
SELECT event_id, time, CAST(floor(time / 86400) AS INT) AS day,
  'U' || CAST(user_id AS {text}) || CASE WHEN user_id % 5 = 0 THEN '$' ELSE '' END AS src_user,
  'D' || CAST(user_id % 4 AS {text}) AS src_domain,
  'U' || CAST(peer_id AS {text}) || CASE WHEN peer_id % 5 = 0 THEN '$' ELSE '' END AS dst_user,
  'D' || CAST(peer_id % 4 AS {text}) AS dst_domain,
  'C' || CAST((user_id * 7 + CAST(floor(value) AS BIGINT) % 3) % 100 AS {text}) AS src_computer,
  'C' || k AS dst_computer,
  CASE WHEN event_type = 'signup' THEN NULL ELSE event_type END AS auth_type,
  event_type = 'signup' AS auth_type_is_null,
  CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'Network' WHEN event_id % 3 = 1 THEN 'Interactive' ELSE 'Service' END AS logon_type,
  event_id % 7 = 0 AS logon_type_is_null,
  CASE WHEN event_type = 'view' THEN 'LogOff' ELSE 'LogOn' END AS auth_orientation,
  event_type <> 'error' AS success,
  user_id % 5 = 0 AS src_user_is_machine,
  peer_id % 5 = 0 AS dst_user_is_machine,
  {label} AS is_malicious
FROM (SELECT event_id, CAST({seconds} AS INT) AS time, event_type, value, user_id,
        CASE WHEN user_id % 7 = 0 THEN user_id + 1 ELSE user_id END AS peer_id, {k} AS k FROM {events})
"""

_DUCK = {"text": "VARCHAR", "seconds": "date_diff('second', TIMESTAMP '2024-01-01', ts)", "k": "json_extract_string(props, '$.k')", "events": "events"}
_SPARK = {"text": "STRING", "seconds": "timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)", "k": "get_json_object(props, '$.k')"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def auth(spark: SparkSession, sf_dir: str, label: str = "rich") -> DataFrame:
    """The typed log over `events`."""
    return spark.sql(_AUTH.format(**_SPARK, events="{events}", label=LABELS[label]), events=table(spark, sf_dir, "events"))


def auth_cte(label: str = "rich") -> str:
    """`auth AS (...)` for DuckDB."""
    return "auth AS (" + _AUTH.format(**_DUCK, label=LABELS[label]) + ")"


_RAW = """
SELECT event_id,
  CASE WHEN event_id % 97 = 5 THEN 'x' || CAST(time AS {text}) ELSE CAST(time AS {text}) END AS time,
  CASE WHEN event_id % 53 = 3 THEN src_user ELSE src_user || '@' || src_domain END AS src_user_at_domain,
  dst_user || '@' || dst_domain AS dst_user_at_domain, src_computer, dst_computer,
  coalesce(auth_type, '?') AS auth_type, coalesce(logon_type, '?') AS logon_type, auth_orientation,
  CASE WHEN success THEN 'Success' ELSE 'Fail' END AS success_failure
FROM {auth}
"""


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as text: nine fields and the number of the line; some times and accounts are malformed."""
    return spark.sql(_RAW.format(text="STRING", auth="{auth}"), auth=auth(spark, sf_dir))


def raw_cte() -> str:
    return auth_cte() + ", raw_log AS (" + _RAW.format(text="VARCHAR", auth="auth") + ")"


_REDTEAM = """
SELECT CAST(time AS {text}) AS time, src_user || '@' || src_domain AS user_at_domain, src_computer, dst_computer FROM {auth} WHERE is_malicious
UNION ALL
SELECT CAST(time AS {text}), src_user || '@' || src_domain, src_computer, dst_computer FROM {auth} WHERE is_malicious AND event_id % 4 = 0
"""


def redteam_raw(spark: SparkSession, sf_dir: str, label: str = "rich") -> DataFrame:
    return spark.sql(_REDTEAM.format(text="STRING", auth="{auth}"), auth=auth(spark, sf_dir, label))


def redteam_cte(label: str = "rich") -> str:
    return auth_cte(label) + ", redteam_raw AS (" + _REDTEAM.format(text="VARCHAR", auth="auth") + ")"


_STAR = """
SELECT l_orderkey * 10 + l_linenumber AS event_id, o_custkey AS src_user, l_suppkey AS dst_computer, l_partkey % 50 AS src_computer,
  CAST({days} AS INT) AS day, CAST({days} AS INT) * 86400 AS time, l_returnflag <> 'R' AS success,
  CAST(round(l_discount * 100) AS DOUBLE) AS score, (l_orderkey % 211 = 7 AND l_linenumber <= 2) AS is_malicious,
  CASE WHEN l_orderkey % 211 = 7 AND l_linenumber <= 2 THEN o_custkey END AS campaign
FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey
"""


def star(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders and lineitem as a scored log: one event a line, times at day resolution, eleven scores, so ties abound."""
    days = "datediff(DAY, TIMESTAMP_NTZ'1995-01-01 00:00:00', l_shipdate)"
    return spark.sql(_STAR.format(days=days, orders="{o}", lineitem="{l}"), o=table(spark, sf_dir, "orders"), l=table(spark, sf_dir, "lineitem"))


def star_cte() -> str:
    return "star AS (" + _STAR.format(days="date_diff('day', TIMESTAMP '1995-01-01', l_shipdate)", orders="orders", lineitem="lineitem") + ")"


def coarse(df: DataFrame, seconds: int = 3600) -> DataFrame:
    """The log with times rounded down, so that many events share a second."""
    return df.withColumn("time", (F.col("time") - F.col("time") % seconds).cast("int"))
