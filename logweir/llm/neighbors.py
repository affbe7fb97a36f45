"""Embedding near-duplicates by comparing all vectors that angular bounds do not keep apart."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import components, cut, local_forest, written

#: Vectors in a cell on average, and members or asking vectors compared in one task at most on average.
SHARD, BLOCK = 1000, 6000
#: The bounded sample, by hash of the id, on which the cells' centres are fitted.
SAMPLE, MOST_CENTRES = 20_000, 2048
#: Rings of a cell, by the angle to its centre: RINGS - 1 up to that of a link, and all beyond. What rounding may do to an angle.
RINGS, SLACK = 5, 1e-6
#: Bounds, or cosines, looked at in one step.
STEP = 2_000_000


def unit(vectors: np.ndarray) -> np.ndarray:
    v = np.asarray(vectors, np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def centres(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k directions by spherical k-means from evenly spaced starts."""
    found = sample[np.linspace(0, len(sample) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        own = np.argmax(sample @ found.T, axis=1)
        sums = np.zeros_like(found)
        np.add.at(sums, own, sample)
        norms = np.linalg.norm(sums, axis=1)
        found[norms > 1e-9] = sums[norms > 1e-9] / norms[norms > 1e-9, None]
    return found


def angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def reach(v: np.ndarray, c: np.ndarray, rings: np.ndarray, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, sure, open) for some rows of v at a time: the rings all of whose members are linked to a row, and those that may have linked ones.

    rings has (cell, least angle, greatest angle) of the members to their centre. Angles obey the triangle
    inequality, which settles both. Members are nearer to their own centre than to the row's, so a row whose
    distance from the plane between the two centres is over that of a link has none there either.
    """
    cell, least, most = rings[:, 0].astype(np.int64), rings[:, 1], rings[:, 2]
    widest, chord = math.acos(min(1.0, threshold)), math.sqrt(2 - 2 * min(1.0, threshold))
    apart = np.sqrt(np.maximum(0, (c**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * c @ c.T))
    step = max(1, STEP // max(1, len(rings)))
    for lo in range(0, len(v), step):
        cosines = v[lo : lo + step] @ c.T
        own = np.argmax(cosines, axis=1)
        over = cosines[np.arange(len(own)), own][:, None] - cosines > chord * apart[own] + SLACK
        away = angles(cosines)[:, cell]
        sure = away + most <= widest - SLACK
        yield lo, sure, ~sure & ~over[:, cell] & (away <= most + widest + SLACK) & (away >= least - widest - SLACK)


def _usable(vector: str) -> "F.Column":
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, threshold: float = 0.95, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row: vectors linked at cosine >= threshold. No link is missed.

    Vectors of different lengths have no cosine and are not linked; each length is compared on its own. Rows
    without a key, null vectors, and those of null, non-finite or only zero components have no links and stay
    alone. Rows with one key link with each other like any others. component_id is the smallest key, so ties
    cannot arise. An empty table gives no rows; further columns are left out.
    """
    table = rows.select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    usable = table.filter(_usable("v") & F.col("vec_id").isNotNull())
    alone = table.filter(~_usable("v") | F.col("vec_id").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = alone
    for (length,) in sorted(usable.select(F.size("v")).distinct().collect()):  # one row a length
        found = found.unionByName(_linked(usable.filter(F.size("v") == length), threshold))
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked(usable: DataFrame, threshold: float) -> DataFrame:
    """(vec_id, n_links, component_id) of rows (vec_id, v) of one length.

    Equal vectors are one node with a count, so copies cost one row. Nodes belong to the cell of the nearest
    centre, and there to a ring by their angle to it. Each node is compared, in double precision, with all
    members of every ring that bounds do not rule out (reach); rings that lie wholly within the threshold
    are counted without being compared, which keeps tight groups of any size cheap. Rings and their askers
    are dealt to tasks in blocks; only counts and a forest of links leave a task. Where vectors fill all
    directions evenly, bounds rule out less and the work grows with the square of their number.
    """
    nodes = cut(usable.groupBy("v").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")))
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()))
    total = nodes.count()
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).select("v").toPandas()["v"]
    k = max(1, min(MOST_CENTRES, math.ceil(total / SHARD), len(sample)))
    c = centres(unit(np.stack(sample.to_list())), k) if total else np.zeros((1, 1))
    widest = math.acos(min(1.0, threshold)) or 1.0
    kind, vectors = "long", dict(nodes.dtypes)["v"]

    def assign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = unit(np.stack(batch.column(0).to_numpy(zero_copy_only=False))) @ c.T
            own = np.argmax(cosines, axis=1)
            angle = angles(cosines[np.arange(len(own)), own])
            ring = own * RINGS + np.minimum(RINGS - 1, angle / widest * (RINGS - 1)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ring), pa.array(angle)], names=["v", "node", "copies", "ring", "angle"])

    member = cut(nodes.select("v", "node", "copies").mapInArrow(assign, f"v {vectors}, node {kind}, copies long, ring long, angle double"))
    stats = member.groupBy("ring").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.sum("copies").alias("copies"), F.min("node").alias("node"), F.count(F.lit(1)).alias("n"))
    stats = stats.orderBy("ring").toPandas()  # at most RINGS * MOST_CENTRES rows
    names, sizes, firsts = stats["ring"].to_numpy(), stats["copies"].to_numpy(np.int64), stats["node"].to_numpy()
    rings = np.stack([names // RINGS, stats["least"], stats["most"]], axis=1).astype(np.float64)

    def counted_whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node, copies = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            at = np.searchsorted(names, batch.column(3).to_numpy())
            for lo, sure, _ in reach(unit(np.stack(batch.column(0).to_numpy(zero_copy_only=False))), c, rings, threshold):
                hi = lo + len(sure)
                own = np.where(sure[np.arange(len(sure)), at[lo:hi]], copies[lo:hi], 0)
                n = sure @ sizes - own
                q, ring = np.nonzero(sure)
                x, y = local_forest(node[lo + q], firsts[ring])
                zero = np.zeros(len(x), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in ((node[lo:hi], x), (node[lo:hi], y), (n, zero))], names=["a", "b", "n"])

    def ask(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for lo, _, maybe in reach(unit(np.stack(batch.column(0).to_numpy(zero_copy_only=False))), c, rings, threshold):
                q, ring = np.nonzero(maybe)
                for at in range(0, len(q), 20_000):
                    some = pa.array(lo + q[at : at + 20_000])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(some), batch.column(1).take(some), pa.array(names[ring[at : at + 20_000]])], names=["v", "node", "ring"])

    whole = member.mapInArrow(counted_whole, f"a {kind}, b {kind}, n long")
    asking = cut(member.mapInArrow(ask, f"v {vectors}, node {kind}, ring long"))
    # both have at most RINGS * MOST_CENTRES rows
    blocks = member.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    blocks = blocks.join(asking.groupBy("ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "ring")
    block, part = (F.pmod(F.xxhash64("node"), F.col(x)).cast("int") for x in ("blocks", "parts"))
    every = lambda x: F.explode(F.sequence(F.lit(0), F.col(x) - 1))
    stored = member.join(F.broadcast(blocks), "ring").select("ring", block.alias("block"), every("parts").alias("part"), "node", "v", "copies", F.lit(False).alias("query"))
    asking = asking.join(F.broadcast(blocks), "ring").select("ring", every("blocks").alias("block"), part.alias("part"), "node", "v", F.lit(0).cast("long").alias("copies"), F.lit(True).alias("query"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["query"].to_numpy(bool)
        own, ask = group[~asks], group[asks]
        out = [pd.DataFrame({"a": ask["node"][:0], "b": ask["node"][:0], "n": np.zeros(0, np.int64)})]
        if not len(own) or not len(ask):
            return out[0]
        ids, copies, asker = own["node"].to_numpy(), own["copies"].to_numpy(np.int64), ask["node"].to_numpy()
        v, w = unit(np.stack(own["v"].to_list())), unit(np.stack(ask["v"].to_list()))
        step = max(1, STEP // len(own))
        for lo in range(0, len(ask), step):
            near = w[lo : lo + step] @ v.T >= threshold
            q, x = np.nonzero(near)
            other = asker[lo + q] != ids[x]
            q, x = q[other], x[other]
            if not len(q):
                continue
            counts = np.bincount(q, copies[x]).astype(np.int64)
            some = np.flatnonzero(counts)
            out.append(pd.DataFrame({"a": asker[lo + some], "b": asker[lo + some], "n": counts[some]}))
            a, b = local_forest(asker[lo + q], ids[x])
            out.append(pd.DataFrame({"a": a, "b": b, "n": np.zeros(len(a), np.int64)}))
        return pd.concat(out)

    compared = stored.unionByName(asking).groupBy("ring", "block", "part").applyInPandas(compare, f"a {kind}, b {kind}, n long")
    found = cut(whole.unionByName(compared))
    roots = components(found.filter("a <> b").select("a", "b"))
    counted = found.filter("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    named = nodes.join(counted, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(names, "root").select("v", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    return usable.join(named, "v").select("vec_id", "n_links", "component_id")


def audit(rows: DataFrame, found: DataFrame, threshold: float = 0.95, most: int = 1000, key: str = "vec_id", vector: str = "embedding") -> float:
    """Share of the links of a bounded sample of rows (`most`, by hash of the key) that were found, against a comparison with all rows. Rows whose keys are repeated are not asked."""
    usable = rows.filter(_usable(vector)).select(F.col(key).alias("vec_id"), F.col(vector).alias("v"))
    asked = usable.groupBy("vec_id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n")).filter("n = 1 and vec_id is not null")
    asked = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(most).toPandas()
    if not len(asked):
        return 1.0
    by_length = {n: (own["vec_id"].to_numpy(), unit(np.stack(own["v"].to_list()))) for n, own in asked.groupby(asked["v"].map(len))}

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {n: np.zeros(len(ids), np.int64) for n, (ids, _) in by_length.items()}
        for batch in batches:
            column = batch.column(1).to_numpy(zero_copy_only=False)
            lengths = np.array([len(v) for v in column], np.int64)
            for n, (_, q) in by_length.items():
                if (lengths == n).any():
                    total[n] += (q @ unit(np.stack(column[lengths == n])).T >= threshold).sum(axis=1)
        for n, (ids, _) in by_length.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[n])], names=["vec_id", "n"])

    true = usable.mapInArrow(count, f"vec_id {dict(usable.dtypes)['vec_id']}, n long").groupBy("vec_id").agg((F.sum("n") - 1).alias("n"))
    both = true.join(found, "vec_id").agg(F.sum("n"), F.sum(F.least("n", "n_links"))).first()
    return both[1] / both[0] if both[0] else 1.0


def op3_graph(spark, sf_dir: str) -> DataFrame:
    """All rows with audit_recall, the share of the audited rows' links that were found."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    found = written(near_duplicates(rows), "neighbours")
    return found.withColumn("audit_recall", F.lit(float(audit(rows, found))))
