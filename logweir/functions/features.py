"""Feature families of the log: event (F1), history (F2), novelty (F3), time of day (F4), graph (F5), sequences (F6)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators import causal
from logweir.schema import SECONDS_PER_DAY
from logweir.sources.shared import cut

INFINITY = float("inf")


# F1 -----------------------------------------------------------------------------------------------------------


def fit_frequencies(train: DataFrame, column: str) -> DataFrame:
    """(value, freq): shares of all training rows; the null row has the share of nulls. Empty training rows are refused by the caller."""
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return train.groupBy(column).agg(F.count(F.lit(1)).alias("n")).select(F.col(column).alias("value"), (F.col("n") / total).alias("freq"))


def encode_frequency(df: DataFrame, column: str, fitted: DataFrame, name: str) -> DataFrame:
    """Share of the value in training; 0 for values not seen there."""
    side = fitted.select(F.col("value").alias("_value"), F.col("freq").alias(name))
    return df.join(side, F.col(column).eqNullSafe(F.col("_value")), "left").drop("_value").withColumn(name, F.coalesce(name, F.lit(0.0)))


#: Categories that are encoded by their frequency in training.
CATEGORIES = ("auth_type", "logon_type", "auth_orientation")


def _same(a: str, b: str) -> "F.Column":
    return F.coalesce((F.col(a) == F.col(b)).cast("int"), F.lit(0))


#: The flags of an event that need nothing but itself. Columns are made when asked for: a session must be there by then.
EVENT_FLAGS = {
    "is_success": lambda: F.col("success").cast("int"),
    "src_dst_user_same": lambda: _same("src_user", "dst_user"),
    "src_dst_computer_same": lambda: _same("src_computer", "dst_computer"),
    "domain_crossing": lambda: F.coalesce((F.col("src_domain") != F.col("dst_domain")).cast("int"), F.lit(0)),
}


def event_features(df: DataFrame, train: DataFrame) -> DataFrame:
    """flags of the event itself and the training frequencies of its categories. The null and machine flags that cleaning made belong to F1 too."""
    df = df.withColumns({name: flag() for name, flag in EVENT_FLAGS.items()})
    for column in CATEGORIES:
        df = encode_frequency(df, column, fit_frequencies(train, column), f"{column}_freq")
    return df


def event_columns() -> list[str]:
    """All F1 columns: flags made by cleaning, flags made here, frequencies."""
    return ["src_user_is_machine", *(f"{c}_is_null" for c in CATEGORIES[:2]), *EVENT_FLAGS, *(f"{c}_freq" for c in CATEGORIES)]


# F2 -----------------------------------------------------------------------------------------------------------


def window_name(hours: int) -> str:
    return f"{hours // 24}d" if hours % 24 == 0 else f"{hours}h"


def history_features(df: DataFrame, entities=("src_user", "dst_computer"), hours=(1, 24), distinct_for=(("src_user", 1),)) -> DataFrame:
    """for each entity and window the events, failures, failure ratio and, where asked for, distinct partners.

    Columns are added in place: windows of one entity share their partitioning and order, so there is one
    shuffle and one sort an entity, and no join.
    """
    for entity, h in distinct_for:  # first, while rows are narrow
        if entity in entities and h in hours:
            partner = "src_user" if entity == "dst_computer" else "dst_computer"
            df = causal.distinct_count(df, entity, partner, h * 3600, f"{entity}_{window_name(h)}_n_distinct_dst")
    for entity in entities:
        for h in hours:
            frame, base = causal.before_window(entity, h * 3600), f"{entity}_{window_name(h)}"
            df = df.withColumns(
                {f"{base}_n_events": F.count(F.lit(1)).over(frame), f"{base}_n_failures": F.coalesce(F.sum((~F.col("success")).cast("bigint")).over(frame), F.lit(0))}
            ).withColumn(f"{base}_failure_ratio", F.col(f"{base}_n_failures") / F.greatest(F.col(f"{base}_n_events"), F.lit(1)))
    return df


# F3 -----------------------------------------------------------------------------------------------------------

#: Relation -> (key, conditioning entity).
RELATIONS = {
    "pair": (["src_user", "dst_computer"], []),
    "user_src": (["src_user", "src_computer"], ["src_user"]),
    "src_dst": (["src_computer", "dst_computer"], ["src_computer"]),
    "user_auth": (["src_user", "auth_type"], ["src_user"]),
}


#: Entity -> column with its new pairs of the last day.
NEW_PAIRS = {"src_user": "user_new_host_count_24h", "src_computer": "host_new_user_count_24h"}


def rarity_name(relation: str) -> str:
    """The pair's rarity is taken against all events, the others against those of one entity."""
    return f"{relation}_rarity" if RELATIONS.get(relation, ([], []))[1] else f"{relation}_global_rarity"


def rarity(k: "F.Column", n: "F.Column") -> "F.Column":
    """-ln((k + 1) / (n + 1)): k counts today's earlier events, n only earlier days, so it can be negative."""
    return -F.ln((k + 1) / (n + F.lit(1.0)))


def novelty_features(df: DataFrame, relations=RELATIONS, base: DataFrame | None = None) -> DataFrame:
    """newness and rarity of each relation, days since the pair was last seen, new pairs of the last day.

    Only the counts by (entity, day) are joined; with no conditioning entity they are one row a day. They are
    made from `base`, the same events before other columns were added, so that those are not computed again.
    """
    base = df if base is None else base
    for name, (keys, condition) in relations.items():
        df = causal.first_occurrence(df, keys, f"_{name}")
        before = causal.events_before_day(base, condition)
        side = before.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(condition)], F.col("day").alias("_day"), F.col("before").alias("_n"))
        on = F.col("day") == F.col("_day")
        for i, c in enumerate(condition):
            on = on & F.col(c).eqNullSafe(F.col(f"_c{i}"))
        df = df.join(side, on, "left").drop("_day", *[f"_c{i}" for i in range(len(condition))])
        df = df.withColumns({f"{name}_is_new": F.col(f"_{name}_is_new").cast("int"), rarity_name(name): rarity(F.col(f"_{name}_index"), F.col("_n"))}).drop("_n")
    df = df.withColumn("days_since_pair_last_seen", F.coalesce(F.col("_pair_since") / SECONDS_PER_DAY, F.lit(INFINITY)))
    for entity, name in NEW_PAIRS.items():
        df = causal.rolling_sum(df, entity, SECONDS_PER_DAY, F.col("pair_is_new").cast("bigint"), name)
    return df.drop(*[f"_{n}_{s}" for n in relations for s in ("index", "since", "is_new")])


# F4 -----------------------------------------------------------------------------------------------------------


def hour_angle() -> "F.Column":
    return (F.col("time") % SECONDS_PER_DAY) * (2 * math.pi / SECONDS_PER_DAY)


def night_window(train: DataFrame, width_hours: int = 6, buckets: int = 96) -> DataFrame:
    """(start_s, end_s, n): the circular window of least activity; the earliest start wins a tie.

    The histogram has `buckets` rows; each is added to every window that it lies in.
    """
    width = width_hours * 3600 * buckets // SECONDS_PER_DAY
    bucket = F.floor((F.col("time") % SECONDS_PER_DAY) / (SECONDS_PER_DAY // buckets)).cast("int")
    counts = train.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    every = train.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("bigint").alias("n"))
    starts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.pmod(F.col("bucket") - i, F.lit(buckets)))
    sums = counts.unionByName(every).select(F.explode(starts).alias("start"), "n").groupBy("start").agg(F.sum("n").alias("n"))
    size = SECONDS_PER_DAY // buckets
    return sums.orderBy("n", "start").limit(1).select((F.col("start") * size).alias("start_s"), ((F.col("start") + width) * size % SECONDS_PER_DAY).alias("end_s"), "n")


def in_night(start: int, end: int) -> "F.Column":
    s = F.col("time") % SECONDS_PER_DAY
    return ((s >= start) & (s < end)) if start < end else ((s >= start) | (s < end))


def temporal_features(df: DataFrame, night: tuple[int, int] = (0, 21_600)) -> DataFrame:
    """time of day on the circle, night, deviation from the user's mean time of day so far, gap and chain to the previous event."""
    w = causal.in_order("src_user")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({"hour_sin": F.sin(hour_angle()), "hour_cos": F.cos(hour_angle()), "is_night": in_night(*night).cast("int")})
    profile = F.atan2(F.sum("hour_sin").over(past), F.sum("hour_cos").over(past))
    deviation = F.abs(F.pmod(hour_angle() - profile + math.pi, F.lit(2 * math.pi)) - math.pi)
    gap = F.col("time") - F.lag("time").over(w)
    chained = F.lag("dst_computer").over(w) == F.col("src_computer")
    return df.withColumns(
        {"hour_deviation_from_profile": F.coalesce(deviation, F.lit(0.0)), "hours_since_prev_event_same_user": F.coalesce(gap / 3600, F.lit(INFINITY)), "prev_dst_is_src": F.coalesce(chained, F.lit(False)).cast("int")}
    )


def featurize(df: DataFrame, train: DataFrame, night: tuple[int, int] = (0, 21_600)) -> DataFrame:
    """F1 to F4 of every event."""
    return temporal_features(novelty_features(event_features(history_features(df), train), base=df), night)


#: What identifies a stored event, and what rules and floors read of it by name besides features.
IDENTITY = ("event_id", "time", "day", "is_malicious")
READ_BY_NAME = ("src_user", "src_computer", "dst_computer", "auth_type", "success")


def model_columns() -> list[str]:
    """The columns that vector models are fitted on, by the rule that makes each family.

    All of F1; the user's events and failure ratio of an hour and a day; newness and rarity of the pair and of
    the two relations of the source, and new pairs of a day; the three columns on the time of day. Columns
    that can be infinite are left out.
    """
    history = [f"src_user_{window_name(h)}_{x}" for h in (1, 24) for x in ("n_events", "failure_ratio")]
    novelty = [x for r in ("pair", "user_src", "src_dst") for x in (f"{r}_is_new", rarity_name(r))]
    return [*event_columns(), *history, *novelty, *NEW_PAIRS.values(), "hour_sin", "hour_cos", "hour_deviation_from_profile"]


def numeric(df: DataFrame) -> DataFrame:
    """df with the model columns that are flags as numbers, as vector models read them. Rules read flags as they are."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.col(c).cast("int") for c in model_columns() if kinds.get(c) == "boolean"})


def rule_columns() -> list[str]:
    """Further features that the rules read."""
    return ["src_user_1h_n_distinct_dst", "dst_computer_1h_n_failures", "user_auth_is_new", "prev_dst_is_src", "hours_since_prev_event_same_user"]


def store_columns(df: DataFrame) -> list[str]:
    """What is stored of an event: enough for every model to score it, the rules included."""
    campaign = [c for c in ("campaign",) if c in df.columns]
    return list(dict.fromkeys([*IDENTITY, *campaign, *READ_BY_NAME, *model_columns(), *rule_columns()]))


def feature_store(df: DataFrame, train: DataFrame, first_day: int, last_day: int, history: str = "window", warmup_days: int = 2) -> DataFrame:
    """The stored columns of the days asked for.

    history="window" reads the days from first_day - warmup_days on; "cumulative" reads from the first day.
    """
    first = first_day - warmup_days if history == "window" else 0
    rows = featurize(df.filter(F.col("day").between(first, last_day)), train)
    return rows.filter(F.col("day") >= first_day).select(*store_columns(rows))


# F5 -----------------------------------------------------------------------------------------------------------


def trailing_edges(df: DataFrame, days: int = 7) -> DataFrame:
    """(day, user, machine, weight): the bipartite graph of the days before each day. Each day's edges are summed before they are dealt to later days."""
    daily = df.groupBy("day", F.col("src_user").alias("user"), F.col("dst_computer").alias("machine")).agg(F.count(F.lit(1)).alias("n"))
    later = daily.withColumn("for_day", F.explode(F.sequence(F.col("day") + 1, F.col("day") + days)))
    seen = df.select("day").distinct()
    return later.groupBy(F.col("for_day").alias("day"), "user", "machine").agg(F.sum("n").alias("weight")).join(seen, "day", "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    users = edges.groupBy("day", F.concat(F.lit("u:"), "user").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    machines = edges.groupBy("day", F.concat(F.lit("m:"), "machine").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    return users.unionByName(machines)


#: Classes of users in a block that meets another; rows compared at a time; what a joined row costs in compared pairs.
BLOCK, TILE, ROW_COST = 4096, 1024, 50


def _overlaps(left: pd.DataFrame, right: pd.DataFrame) -> tuple[np.ndarray, ...]:
    """For each left and each right class: the sum of Jaccard overlaps with users of the other side, and the number of those that share a machine.

    Columns: near (int32 codes of machines, packed), deg (machines, unknown ones included), n (users of the class).
    Shared machines are counted by products of 0/1 matrices, tile by tile, over machines that both tiles know.
    """

    def tiles(side: pd.DataFrame) -> list:
        found = []
        for lo in range(0, len(side), TILE):
            part = side.iloc[lo : lo + TILE]
            lists = [np.frombuffer(x, np.int32) for x in part["near"]]
            at = np.repeat(np.arange(len(part)), [len(x) for x in lists])
            found.append((slice(lo, lo + len(part)), at, np.concatenate(lists), part["deg"].to_numpy(np.float64), part["n"].to_numpy(np.float64)))
        return found

    def bits(rows: int, at: np.ndarray, codes: np.ndarray, known: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        held = known[place] == codes
        out = np.zeros((rows, len(known)), np.float32)
        out[at[held], place[held]] = 1
        return out

    ls, lc, rs, rc = (np.zeros(len(x)) for x in (left, left, right, right))
    others = tiles(right)
    for own, at, codes, deg, n in tiles(left):
        for there, at2, codes2, deg2, n2 in others:
            both, known = np.zeros((len(deg), len(deg2)), np.float32), np.intersect1d(codes, codes2)
            for lo in range(0, len(known), TILE):
                some = known[lo : lo + TILE]
                both += bits(len(deg), at, codes, some) @ bits(len(deg2), at2, codes2, some).T
            overlap = both.astype(np.float64)
            overlap /= (deg[:, None] + deg2[None]) - overlap
            share = np.minimum(both, 1).astype(np.float64)
            ls[own] += overlap @ n2
            lc[own] += share @ n2
            rs[there] += n @ overlap
            rc[there] += n @ share
    return ls, lc, rs, rc


def _overlap_blocks(classes: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """(day, head, total, others): sums over all other users by blocks of classes; every two blocks of a day meet in one task, which holds those two only."""
    day = dict(classes.dtypes)["day"]
    per_day = F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv])[F.col("day")]
    own = F.pmod(F.xxhash64("head"), per_day).cast("int")
    dealt = classes.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), per_day.cast("int") - 1)))
    dealt = dealt.select("day", F.least("_own", "_other").alias("i"), F.greatest("_own", "_other").alias("j"), "_own", "head", "near", "deg", "n")

    def meet(part: pd.DataFrame) -> pd.DataFrame:
        i, j = part["i"].iloc[0], part["j"].iloc[0]
        left, right = part[part["_own"] == i], part[part["_own"] == j]
        if not len(left) or not len(right):
            return part.iloc[:0][["day", "head"]].assign(total=0.0, others=0.0)
        ls, lc, rs, rc = _overlaps(left, right)
        if i == j:  # each user met itself once
            size, deg = np.array([len(x) // 4 for x in left["near"]]), left["deg"].to_numpy(np.float64)
            found = [(left, ls - size / (2 * deg - size), lc - (size > 0))]
        else:
            found = [(left, ls, lc), (right, rs, rc)]
        return pd.concat([pd.DataFrame({"day": x["day"], "head": x["head"], "total": s, "others": c}) for x, s, c in found])

    return dealt.groupBy("day", "i", "j").applyInPandas(meet, f"day {day}, head string, total double, others double").groupBy("day", "head").agg(F.sum("total").alias("total"), F.sum("others").alias("others"))


def bipartite_clustering(edges: DataFrame) -> DataFrame:
    """(day, user, clustering): mean Jaccard overlap of a user's machines with those of the users that share one (Latapy's coefficient).

    Users of the same machines are one class of the day. Days on which a join by machine would make far more
    rows than there are pairs of classes compare classes in blocks; the others join. Both are exact.
    """
    e = cut(edges.select("day", "user", "machine"))
    codes = cut(e.select("machine").distinct().filter("machine is not null").select("machine", F.xxhash64("machine").alias("_h")))
    codes = cut(codes.withColumn("code", (F.row_number().over(Window.orderBy("_h", "machine")) - 1).cast("int")).drop("_h"))  # distinct machines only
    sets = e.join(codes, "machine", "left").groupBy("day", "user").agg(F.count(F.lit(1)).alias("deg"), F.array_sort(F.collect_list("code")).alias("near"))
    w = Window.partitionBy("day", "near", "deg")
    sets = cut(sets.withColumns({"head": F.min("user").over(w), "n": F.count("user").over(w)}))
    classes = sets.filter("user = head").select("day", "head", "near", "deg", "n")
    sizes = classes.groupBy("day").agg(F.count(F.lit(1)).alias("classes"))
    rows = classes.select("day", F.explode("near").alias("code")).groupBy("day", "code").agg(F.count(F.lit(1)).cast("double").alias("k")).groupBy("day").agg(F.sum(F.col("k") * F.col("k")).alias("rows"))
    plan = sizes.join(rows, "day").collect()  # one row a day
    blocks = {r["day"]: -(-r["classes"] // BLOCK) for r in plan if r["rows"] * ROW_COST > r["classes"] ** 2}
    dense = F.col("day").isin(list(blocks))
    parts = classes.filter(~dense)
    own = parts.select("day", "head", "deg", "n", F.explode("near").alias("code"))
    other = own.select("day", F.col("head").alias("other"), F.col("deg").alias("other_deg"), F.col("n").alias("other_n"), "code")
    shared = own.join(other, ["day", "code"]).groupBy("day", "head", "other", "deg", "other_deg", "other_n").agg(F.count(F.lit(1)).alias("both"))
    met = F.col("other_n") - (F.col("head") == F.col("other")).cast("int")
    found = shared.groupBy("day", "head").agg(F.sum(met * F.col("both") / (F.col("deg") + F.col("other_deg") - F.col("both"))).alias("total"), F.sum(met).cast("double").alias("others"))
    if blocks:
        pack = F.udf(lambda x: np.array(x, np.int32).tobytes(), "binary")
        found = found.unionByName(_overlap_blocks(classes.filter(dense).withColumn("near", pack("near")), blocks))
    found = found.select(F.col("day").alias("_day"), F.col("head").alias("_head"), F.when(F.col("others") > 0, F.col("total") / F.col("others")).alias("mean"))
    rows = sets.join(found, (F.col("day") == F.col("_day")) & (F.col("head") == F.col("_head")) & F.col("user").isNotNull(), "left")
    return rows.select("day", "user", F.round(F.greatest(F.coalesce("mean", F.lit(0.0)), F.lit(0.0)), 9).alias("clustering"))


def pagerank(edges: DataFrame, rounds: int = 3, alpha: float = 0.85) -> DataFrame:
    """(day, node, pagerank) by a fixed number of weighted rounds over the undirected graph of each day."""
    two = edges.select("day", F.concat(F.lit("u:"), "user").alias("a"), F.concat(F.lit("m:"), "machine").alias("b"), "weight")
    arcs = two.unionByName(two.select("day", F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    out = arcs.groupBy("day", "a").agg(F.sum("weight").alias("total"))
    size = out.groupBy("day").agg(F.count(F.lit(1)).alias("size"))
    arcs = cut(arcs.join(out, ["day", "a"]).select("day", "a", "b", (F.col("weight") / F.col("total")).alias("share")))  # read in every round
    out = cut(out)
    rank = out.join(size, "day").select("day", F.col("a").alias("node"), "size", (1.0 / F.col("size")).alias("rank"))
    for _ in range(rounds):
        flow = arcs.join(rank.select("day", F.col("node").alias("a"), "rank"), ["day", "a"]).groupBy("day", F.col("b").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("flow"))
        rank = rank.select("day", "node", "size").join(flow, ["day", "node"], "left").withColumn("rank", (1 - alpha) / F.col("size") + alpha * F.coalesce("flow", F.lit(0.0))).drop("flow")
    return rank.select("day", "node", F.round("rank", 9).alias("pagerank"))


def settled_ranks(at: np.ndarray, to: np.ndarray, weight: np.ndarray, size: int, alpha: float = 0.85, left: float = 1e-12) -> np.ndarray:
    """PageRank of `size` nodes over undirected weighted edges, in rounds until a round changes less than `left` in all.

    A round brings any ranks nearer to the settled ones by alpha at least, so the number of rounds is bounded by
    alpha and `left`, and never cuts the work.
    """
    a, b = np.concatenate([at, to]), np.concatenate([to, at])
    share = np.concatenate([weight, weight]).astype(np.float64)
    share /= np.bincount(a, share, size)[a]
    rank = np.full(size, 1 / size)
    for _ in range(math.ceil(math.log(left / 2) / math.log(alpha)) + 1):
        last, rank = rank, (1 - alpha) / size + alpha * np.bincount(b, rank[a] * share, size)
        if np.abs(rank - last).sum() < left:
            break
    return rank


def settled_pagerank(edges: DataFrame) -> DataFrame:
    """(day, node, pagerank) over the undirected weighted graph of each day, until the ranks settle. A day's graph is held in one task.

    The unknown user and the unknown machine are nodes as others are, but have no row.
    """

    def of_day(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["user", "machine"])  # sums run in a fixed order
        users, user_names = pd.factorize(part["user"], use_na_sentinel=False)
        machines, machine_names = pd.factorize(part["machine"], use_na_sentinel=False)
        rank = settled_ranks(users, machines + len(user_names), part["weight"].to_numpy(), len(user_names) + len(machine_names))
        nodes = [None if pd.isna(n) else f"{side}:{n}" for side, names in (("u", user_names), ("m", machine_names)) for n in names]
        return pd.DataFrame({"day": part["day"].iloc[0], "node": nodes, "pagerank": rank.round(9)}).dropna(subset="node")

    return edges.groupBy("day").applyInPandas(of_day, f"day {dict(edges.dtypes)['day']}, node string, pagerank double")


def louvain(links: dict[str, dict[str, float]]) -> dict[str, str]:
    """node -> smallest node of its community, by Louvain's method on a weighted graph without loops: {node: {neighbour: weight}}.

    Nodes move in order to the neighbouring community of greatest gain in modularity, the first of equals, until
    none moves; communities are then nodes of a smaller graph, until that does not shrink.
    """
    names = sorted(links)
    at = {n: i for i, n in enumerate(names)}
    near = [{at[b]: float(w) for b, w in sorted(links[n].items())} for n in names]
    loops, member = [0.0] * len(near), list(range(len(near)))
    total = sum(sum(x.values()) for x in near)
    while True:
        strength = [sum(x.values()) + l for x, l in zip(near, loops)]
        own, sums = list(range(len(near))), list(strength)
        moved = True
        while moved:
            moved = False
            for i, x in enumerate(near):
                to = {own[i]: 0.0}
                for j, w in x.items():
                    to[own[j]] = to.get(own[j], 0.0) + w
                sums[own[i]] -= strength[i]
                gain = lambda c: to[c] - sums[c] * strength[i] / total
                best, most = own[i], gain(own[i]) + 1e-9
                for c in sorted(to):
                    if gain(c) > most:
                        best, most = c, gain(c)
                moved |= best != own[i]
                own[i] = best
                sums[best] += strength[i]
        kept = {c: k for k, c in enumerate(sorted(set(own)))}
        own = [kept[c] for c in own]
        member = [own[m] for m in member]
        if len(kept) == len(near):
            break
        smaller, inner = [{} for _ in kept], [0.0] * len(kept)
        for i, x in enumerate(near):
            inner[own[i]] += loops[i]
            for j, w in x.items():
                if own[i] == own[j]:
                    inner[own[i]] += w
                else:
                    smaller[own[i]][own[j]] = smaller[own[i]].get(own[j], 0.0) + w
        near, loops = smaller, inner
    first: dict[int, str] = {}
    for n, m in zip(names, member):
        first.setdefault(m, n)
    return {n: first[m] for n, m in zip(names, member)}


def communities(edges: DataFrame) -> DataFrame:
    """(day, node, community) by Louvain's method on each day's weighted graph. A day's graph is held in one task."""
    two = edges.select("day", F.concat(F.lit("u:"), "user").alias("a"), F.concat(F.lit("m:"), "machine").alias("b"), "weight").filter("a is not null and b is not null")

    def of_day(part: pd.DataFrame) -> pd.DataFrame:
        links: dict[str, dict[str, float]] = {}
        for a, b, w in zip(part["a"], part["b"], part["weight"]):
            links.setdefault(a, {})[b] = w
            links.setdefault(b, {})[a] = w
        found = louvain(links)
        return pd.DataFrame({"day": part["day"].iloc[0], "node": list(found), "community": list(found.values())})

    return two.groupBy("day").applyInPandas(of_day, f"day {dict(edges.dtypes)['day']}, node string, community string")


def attach_graph_features(df: DataFrame, days: int = 7) -> DataFrame:
    """df with degree, clustering, settled PageRank and community of the event's user and destination in the graph of the days before; 0, 0, 0 and -1 for ends not seen in it."""
    edges = cut(trailing_edges(df, days))
    ranks, groups = settled_pagerank(edges), cut(communities(edges))
    numbers = groups.groupBy("day", "community").agg(F.min("node").alias("first")).withColumn("number", F.dense_rank().over(Window.partitionBy("day").orderBy("first")) - 1)
    nodes = degrees(edges).join(ranks, ["day", "node"], "left").join(groups, ["day", "node"], "left").join(numbers, ["day", "community"], "left")
    nodes = nodes.join(bipartite_clustering(edges).select("day", F.concat(F.lit("u:"), "user").alias("node"), "clustering"), ["day", "node"], "left")
    nodes = cut(nodes.select("day", "node", "degree", "clustering", "pagerank", "number"))  # read for both ends
    for side, column in (("user", "src_user"), ("host", "dst_computer")):
        mark = "u:" if side == "user" else "m:"
        own = nodes.select(F.col("day").alias("_day"), F.col("node").alias("_node"), *[F.col(c).alias(f"_{c}") for c in ("degree", "clustering", "pagerank", "number")])
        df = df.join(own, (F.col("day") == F.col("_day")) & (F.concat(F.lit(mark), F.col(column)) == F.col("_node")), "left").drop("_day", "_node")
        fill = {"degree": F.lit(0), "clustering": F.lit(0.0), "pagerank": F.lit(0.0), "number": F.lit(-1)}
        names = {"number": "community"}
        df = df.withColumns({f"{side}_graph_{names.get(c, c)}": F.coalesce(f"_{c}", x) for c, x in fill.items()}).drop(*[f"_{c}" for c in fill])
    return df


def snapshot_edges(df: DataFrame, seconds: int = 1800) -> DataFrame:
    """(snapshot, src, dst, n): directed host graph of each interval, which must divide a day."""
    if SECONDS_PER_DAY % seconds:
        raise ValueError("the interval must divide a day")
    return df.groupBy(F.floor(F.col("time") / seconds).alias("snapshot"), F.col("src_computer").alias("src"), F.col("dst_computer").alias("dst")).agg(F.count(F.lit(1)).alias("n"))


def snapshot_weights(edges: DataFrame) -> DataFrame:
    """edges with weight: sigmoid of the standardised count within the snapshot; 0.5 where all counts are equal."""
    w = Window.partitionBy("snapshot")
    sd = F.stddev_pop("n").over(w)
    z = F.when(sd > 0, (F.col("n") - F.avg("n").over(w)) / sd).otherwise(F.lit(0.0))
    return edges.withColumn("weight", F.round(1 / (1 + F.exp(-z)), 9))


# F6 -----------------------------------------------------------------------------------------------------------

PAD, OOV, NULL, FIRST = 0, 1, 2, 3


def fit_vocabulary(train: DataFrame, column: str) -> DataFrame:
    """(value, code): distinct training values in order, from FIRST on. The ranking window sees distinct values only."""
    return train.select(F.col(column).alias("value")).filter("value is not null").distinct().withColumn("code", (F.row_number().over(Window.orderBy("value")) + FIRST - 1).cast("int"))


def encode(df: DataFrame, column: str, vocabulary: DataFrame, name: str) -> DataFrame:
    side = vocabulary.select(F.col("value").alias("_value"), F.col("code").alias("_code"))
    return df.join(side, F.col(column) == F.col("_value"), "left").withColumn(name, F.when(F.col(column).isNull(), NULL).otherwise(F.coalesce("_code", F.lit(OOV)))).drop("_value", "_code")


def sequence_features(df: DataFrame, vocabularies: dict[str, DataFrame], length: int = 32) -> DataFrame:
    """the user's last `length` events as four lists of tokens, padded on the left with PAD."""
    df = encode(df, "dst_computer", vocabularies["dst_computer"], "dst_code")
    df = encode(df, "auth_type", vocabularies["auth_type"], "auth_code")
    w = causal.in_order("src_user")
    gap = F.col("time") - F.lag("time").over(w)
    bucket = F.coalesce(F.round(F.greatest(F.lit(0.0), F.least(F.ln(gap + 1), F.lit(20.0))) / 20 * 9).cast("int") + 2, F.lit(1))
    df = df.withColumns({"ok_code": F.when(F.col("success"), 2).otherwise(1), "gap_code": bucket})
    past = w.rowsBetween(-length, -1)
    for source, name in (("dst_code", "dst_seq"), ("auth_code", "auth_seq"), ("ok_code", "ok_seq"), ("gap_code", "gap_seq")):
        seen = F.collect_list(source).over(past)
        df = df.withColumn(name, seen)
        df = df.withColumn(name, F.concat(F.array_repeat(F.lit(PAD), F.lit(length) - F.size(name)), F.col(name)))
    return df
