"""Small helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.sources.shared import cut, shared_dir, written  # noqa: F401

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def give_back() -> None:
    """Returns freed memory to the system, where the C library can: Python workers live on between tasks, and Spark counts them with the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def giving_back(run: Callable) -> Callable:
    """run, a function from batches to batches, with freed memory returned at its end and after every fiftieth batch."""

    def through(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for i, batch in enumerate(run(batches)):
            yield batch
            if i % 50 == 49:
                del batch
                give_back()
        give_back()

    return through


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores after it until no column of `taken` has it in any case."""
    low = {t.lower() for t in taken}
    while name.lower() in low:
        name += "_"
    return name


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def hash64(*parts) -> "F.Column":
    return F.xxhash64(*parts)


def uniform(key: "F.Column", salt: str) -> "F.Column":
    """A number in (0, 1) that depends on the key alone: 52 bits of an MD5, so that SQL can repeat it."""
    digits = F.substring(F.md5(F.concat(F.lit(salt), key).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def local_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (label, smallest label reachable) of the graph with edges a-b; one for each node but the roots."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inverse[: len(a)], inverse[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b, held = [], [], 0
    for batch in batches:
        a.append(batch.column(0).to_numpy())
        b.append(batch.column(1).to_numpy())
        held += len(a[-1])
        if held > 1_000_000:
            x, y = local_forest(np.concatenate(a), np.concatenate(b))
            a, b, held = [x], [y], len(x)
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
                a, b, held = [], [], 0
    if a:
        x, y = local_forest(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an undirected graph given as edges (a long, b long); root is its smallest reachable node.

    Each partition first contracts its own edges to a forest. Then rounds of large-star and small-star,
    each a shuffle by node with map-side minimum, run until no link changes; the number of rounds grows
    with the logarithm of the longest chain. A node with very many links is hashed by the *other* end in
    the join, which adaptive execution can split.
    """
    links = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    links = cut(links.mapInArrow(_contracted, "a long, b long"))
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: every neighbour above the node links to the smallest of the neighbourhood
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # small star: each node and its smaller neighbours link to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        links = cut(small)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == seen:
            break
        seen = now
    roots = links.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
