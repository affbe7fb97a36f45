"""SimHash near-duplicates: fingerprints compared at the anchors of a covering code."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import components, cut, fresh, giving_back, local_forest, text_bytes

SEED = 42
#: The binary Golay code: 23 bits, 2**12 words, covering radius 3; its generator polynomial is a fixed value.
LENGTH, CHECKS, RADIUS, GENERATOR = 23, 11, 3, 0b101011100011
MASK = (1 << LENGTH) - 1
#: Fingerprints in a block, on average: an anchor with more is dealt to several tasks.
HOT = 20_000
#: Pairs looked at in one step.
STEP = 4_000_000


def fingerprint(text: bytes, shingle: int) -> int:
    """64 bits: 1 where over half of the shingles' hashes have a 1; no word: 0."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        parts = [b" ".join(words)]
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(p, SEED) for p in parts], "<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 16_384):
        part = hashes[lo : lo + 16_384]
        ones += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, hash, fp): the fingerprint of each whole text as a signed number, and a hash of the text that tells texts of one key apart."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(b, shingle) for b in text_bytes(batch.column(2))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], names=["doc_id", "hash", "fp"])

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    return rows.mapInArrow(giving_back(run), f"doc_id {dict(docs.dtypes)[key]}, hash long, fp long")


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial; 0 for words of the code."""
    rest = words.astype(np.int64)
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - CHECKS), 0)
    return rest


@cache
def cosets(threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the differences to all code words within RADIUS + threshold, and the flips beyond RADIUS of each."""
    errors = [sum(1 << b for b in c) for w in range(RADIUS + threshold + 1) for c in combinations(range(LENGTH), w)]
    errors = np.array(errors, np.int64)
    of = syndrome(errors)
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(2**CHECKS + 1))
    width = int(np.diff(starts).max())
    table, flips = np.zeros((2**CHECKS, width), np.int64), np.full((2**CHECKS, width), 99, np.int64)
    for s in range(2**CHECKS):
        own = errors[order[starts[s] : starts[s + 1]]]
        table[s, : len(own)] = own
        flips[s, : len(own)] = np.maximum(0, np.bitwise_count(own).astype(np.int64) - RADIUS)
    return table, flips


def anchors(fps: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, at home): every anchor that a fingerprint within threshold of each row may have as its own.

    Anchors are pairs of Golay words on bits 0-22 and 23-45 (the other 18 bits are free), 2**24 in all. A
    fingerprint's home is the nearest one, within 3 bits on either part. One that differs by at most
    `threshold` bits has its home within 3 bits plus the share of these flips on either part.
    """
    table, flips = cosets(threshold)
    low, high = fps & MASK, fps >> LENGTH & MASK
    sl, sh = syndrome(low), syndrome(high)
    need = flips[sl][:, :, None] + flips[sh][:, None, :]
    row, i, j = np.nonzero(need <= threshold)
    anchor = (low[row] ^ table[sl[row], i]) | (high[row] ^ table[sh[row], j]) << LENGTH
    return row, anchor, need[row, i, j] == 0


def anchor_number(anchor: np.ndarray) -> np.ndarray:
    """A number below 2**24 for each anchor: the upper 12 bits of a word of the code tell it from all others."""
    return (anchor & MASK) >> CHECKS | anchor >> LENGTH >> CHECKS << (LENGTH - CHECKS)


def anchor_bits(at_home: DataFrame) -> bytes:
    """2**24 bits: 1 for each anchor that is some fingerprint's home. Pieces of the bitmap, of 8,192 anchors each, are gathered."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << 21, np.uint8)
        for batch in batches:
            at = anchor_number(batch.column(0).to_numpy())
            np.bitwise_or.at(held, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        for piece in np.flatnonzero(held.reshape(-1, 1024).any(axis=1)).tolist():
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([held[piece * 1024 : piece * 1024 + 1024].tobytes()], pa.binary())], names=["piece", "bits"])

    numbered = at_home.select("anchor").repartition(8, "anchor")  # eight bitmaps of 2 MB at most
    held = np.zeros(1 << 21, np.uint8)
    for r in numbered.mapInArrow(giving_back(run), "piece long, bits binary").toLocalIterator():
        held[r["piece"] * 1024 : r["piece"] * 1024 + 1024] |= np.frombuffer(r["bits"], np.uint8)
    return held.tobytes()


def links_at_anchors(anchor: np.ndarray, fp: np.ndarray, home: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints at home and all others at the same anchor, contracted to a forest. Rows stand in order of (anchor, home first)."""
    starts = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    sizes = np.diff(np.concatenate([starts, [len(anchor)]]))
    homes = np.add.reduceat(home.astype(np.int64), starts)
    busy = np.repeat((homes > 0) & (sizes > 1), sizes)
    rows = np.flatnonzero(busy)
    first, many = np.repeat(starts, sizes)[rows], np.repeat(homes, sizes)[rows]
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    ends = np.cumsum(many)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
        n = many[lo:hi]
        y = np.repeat(fp[rows[lo:hi]], n)
        offset = np.arange(len(y)) - np.repeat(np.cumsum(n) - n, n)
        x = fp[np.repeat(first[lo:hi], n) + offset]
        near = (np.bitwise_count(x ^ y) <= threshold) & (x != y)
        if near.any():
            a, b = local_forest(np.concatenate([a, x[near]]), np.concatenate([b, y[near]]))
        lo = hi
    return a, b


def similar_fingerprints(distinct: DataFrame, threshold: int) -> DataFrame:
    """(a, b): links between distinct fingerprints (fp) at `threshold` or fewer bits, enough to connect all that are linked.

    Fingerprints go to anchors that are some fingerprint's home only: no others have anything to compare them
    with. Which these are is a bitmap of 2 MB, whatever the number of fingerprints.

    Rows are dealt by anchor. The fingerprints at home of one anchor are cut into blocks of HOT on average, and all
    its rows into parts of as many; each task gets a block and a part, so it holds HOT fingerprints on average
    whatever the anchor's size. An anchor of one block and one part is one task's.
    """

    def home_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 16_384):
                anchor, n = np.unique(anchors(fps[lo : lo + 16_384], 0)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(n)], names=["anchor", "homes"])

    def replicate(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(lived.value, np.uint8)
        for batch in batches:
            fps = batch.column(0).to_numpy()
            for lo in range(0, len(fps), 4096):
                part = fps[lo : lo + 4096]
                row, anchor, home = anchors(part, threshold)
                at = anchor_number(anchor)
                keep = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                row, anchor, home = row[keep], anchor[keep], home[keep]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(home)], names=["anchor", "fp", "home"])

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the fingerprints at home of the last group are carried over; groups are numbered as they come
        last_key, number, kept = None, -1, np.zeros(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([c.to_numpy() for c in batch.columns[:-2]], axis=1)
            starts = np.concatenate([[last_key is None or (keys[0] != last_key).any()], (keys[1:] != keys[:-1]).any(axis=1)])
            group = number + np.cumsum(starts)
            fp = np.concatenate([kept, batch.column(batch.num_columns - 2).to_numpy()])
            home = np.concatenate([np.ones(len(kept), bool), batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)])
            group = np.concatenate([np.full(len(kept), number), group])
            a, b = links_at_anchors(group, fp, home, threshold)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
            last = home & (group == group[-1])
            last_key, number, kept = keys[-1], int(group[-1]), fp[last]

    own = distinct.select("fp").repartition("fp")
    at_home = cut(own.mapInArrow(giving_back(home_counts), "anchor long, homes long").groupBy("anchor").agg(F.sum("homes").alias("homes")))
    lived = own.sparkSession.sparkContext.broadcast(anchor_bits(at_home))
    rows = own.mapInArrow(giving_back(replicate), "anchor long, fp long, home boolean")
    hot = at_home.filter(F.col("homes") > HOT)
    if not hot.isEmpty():
        cuts = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / HOT)).cast("int")
        n = rows.join(hot.select("anchor"), "anchor", "left_semi").groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
        hot = cut(hot.join(n, "anchor").select("anchor", cuts("homes").alias("blocks"), cuts("n").alias("parts")))
    keys = ["anchor"]
    if not hot.isEmpty():
        one = lambda c: F.coalesce(F.col(c), F.lit(1))
        own = lambda c, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), one(c)).cast("int")
        every = lambda c: F.sequence(F.lit(0), one(c) - 1)
        rows = rows.join(hot, "anchor", "left")
        stored = rows.filter("home").select("anchor", "fp", "home", own("blocks", 1).alias("block"), F.explode(every("parts")).alias("part"))
        asking = rows.filter("blocks is not null or not home").select("anchor", "fp", F.lit(False).alias("home"), F.explode(every("blocks")).alias("block"), own("parts", 2).alias("part"))
        rows = stored.unionByName(asking)
        keys = ["anchor", "block", "part"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, F.col("home").desc())
    return rows.select(*keys, "fp", "home").mapInArrow(giving_back(compare), "a long, b long")


def grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """rows (doc_id, hash, fp) with root, the smallest fingerprint reachable, and component_id, the smallest doc_id of that root."""
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    named = distinct.join(components(links).withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(names, "root").select("fp", "root", "component_id"), "fp")


def hexadecimal(fp: str) -> "F.Column":
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def simhash_groups(docs: DataFrame, shingle: int = 5, threshold: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id, root, hash): documents linked by fingerprints at `threshold` or fewer differing bits.

    component_id is the smallest doc_id that links reach; root tells groups apart where documents share a key, and hash
    the texts of a key. Equal fingerprints are one node, so a group of
    copies of any size costs one row. Null and empty texts have fingerprint zero and link like any other.
    Texts of fewer words than a shingle are one shingle. Repeated rows share a component; a null key never
    names a component unless all of its keys are null. An empty table gives no rows, further columns of docs
    are left out, and a very long text costs memory in proportion to its own length.
    """
    rows = cut(fingerprints(docs, shingle, text, key))
    links = similar_fingerprints(cut(rows.select("fp").distinct()), threshold)
    return grouped(rows, links).select("doc_id", hexadecimal("fp").alias("fingerprint"), "component_id", "root", "hash")


def first_of_each_group(docs: DataFrame, groups: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of docs of smallest key of each group, given as (doc_id, hash, root).

    Documents are told apart by key and text: where one key has several texts, each is a document of its own
    group. Of a group's documents with the smallest key the one of smallest hash stays, and of repeated rows
    one. Rows without a key stay. Columns of docs may have any names.
    """
    kept = groups.filter("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    one, two = fresh("kept_key", docs.columns), fresh("kept_hash", docs.columns)
    kept = kept.select(F.col("first.doc_id").alias(one), F.col("first.hash").alias(two))
    own = fresh("hash", [*docs.columns, one, two])
    rows = docs.filter(F.col(key).isNotNull()).withColumn(own, F.xxhash64(F.col(text)))
    rows = rows.join(kept, (F.col(key) == F.col(one)) & (F.col(own) == F.col(two)), "left_semi").dropDuplicates([key, own])
    return rows.select(*docs.columns).unionByName(docs.filter(F.col(key).isNull()))


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    groups = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3, threshold=2)
    return groups.select("doc_id", "fingerprint", "component_id")
