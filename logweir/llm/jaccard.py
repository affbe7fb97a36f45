"""Near-duplicates by exact Jaccard similarity of word shingles: a prefix-filtered join, verified on whole sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import components, giving_back, text_bytes, written
from logweir.llm.simhash import SEED, grouped, simhash_groups

#: Least similarity, in fifths: 4 is 0.8. Whole numbers, so that no rounding decides.
FIFTHS = 4
#: One text in so many is looked at for shingles of many texts; those of at least COMMON of them go last in the order.
SAMPLED, COMMON, MOST_COMMON = 32, 3, 500_000
#: Counts of a set's sketch; texts whose hashes are broadcast at most.
BUCKETS, MOST_BROADCAST = 256, 500_000
#: Pairs looked at, and texts whose sets are held, in one step.
STEP, TEXTS = 250_000, 128
#: Longest list whose pairs become rows. Sets of longer ones are compared in tasks, in blocks of so many sets and so many members of them on average.
LONG, BLOCK, HELD = 32, 4_096, 1_000_000


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """Distinct 64-bit hashes of the shingles in ascending order; a text of fewer words is one shingle, one of none has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.int64)
    parts = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(p, SEED) for p in parts], np.uint64).view(np.int64))


def in_order(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The set with common shingles last."""
    if len(common) and len(own):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        own = own[np.argsort(common[at] == own, kind="stable")]
    return own


def prefix(own: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The shingles of which two similar sets share one at least: all but the last 0.8 of them, with common ones last in the order."""
    most = len(own) - -(-len(own) * FIFTHS // 5) + 1 if len(own) else 0
    return in_order(own, common)[:most]


def fits(n: np.ndarray, m: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members that first meet at places i and j can still be similar. For later meetings this may fail; the first one decides."""
    return (5 + FIFTHS) * (1 + np.minimum(n - i - 1, m - j - 1)) >= FIFTHS * (n + m)


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(lo, TEXTS) for batch in batches for lo in range(0, batch.num_rows, TEXTS))


def _runs(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of whole runs of equal tokens, the first column, of rows in its order."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy() for c in batch.columns]
        held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        end = int(np.searchsorted(held[0], held[0][-1]))
        if end:
            yield [c[:end] for c in held]
            held = [c[end:] for c in held]
    if held is not None:
        yield held


def _neighbours(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of rows that follow each other in a list: enough to link most groups of near copies."""
    for token, fp, n, place in _runs(batches):
        good = (token[1:] == token[:-1]) & fits(n[1:], n[:-1], place[1:], place[:-1])
        a, b = fp[1:][good], fp[:-1][good]
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All pairs (a, b, 0, 0) of a list that can be similar and are not known to be of one group. Of a list above LONG its rows instead: (its least set, set, n, root)."""
    for columns in _runs(batches):
        token, fp, n, place, root = columns
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        sizes = np.diff(np.append(starts, len(token)))
        several = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
        long = np.repeat(several & (sizes > LONG), sizes)
        if long.any():
            least = np.repeat(np.minimum.reduceat(fp, starts), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(x[long]) for x in (least, fp, n, root)], names=["a", "b", "n", "root"])
        token, fp, n, place, root = (x[np.repeat(several & (sizes <= LONG), sizes)] for x in columns)
        start = np.searchsorted(token, token)
        # rows of a list stand in order of size
        back = np.arange(len(token)) - start
        ends = np.cumsum(back)
        lo = 0
        while lo < len(token):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + STEP, "right")))
            many = back[lo:hi]
            x = np.repeat(np.arange(lo, hi), many)
            y = np.repeat(start[lo:hi], many) + np.arange(len(x)) - np.repeat(np.cumsum(many) - many, many)
            good = (root[x] != root[y]) & fits(n[x], n[y], place[x], place[y])
            a, b = fp[x[good]], fp[y[good]]
            if len(a):
                a, b = np.minimum(a, b), np.maximum(a, b)
                order = np.lexsort((b, a))
                a, b = a[order], b[order]
                first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
                none = np.zeros(int(first.sum()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a[first]), pa.array(b[first]), pa.array(none.astype(np.int32)), pa.array(none)], names=["a", "b", "n", "root"])
            lo = hi


def histogram(own: np.ndarray) -> bytes:
    """How many of a set's hashes fall into each of BUCKETS: what two sets share is at most the sum of the lesser counts."""
    counts = np.bincount((own.view(np.uint64) >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS)
    return counts.astype("<u4").tobytes()


def may_be_similar(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose histograms allow a similarity of 0.8. No similar pair is lost; few others stay."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                x, y = (np.frombuffer(b"".join(part.column(k).to_pylist()), "<u4").reshape(part.num_rows, BUCKETS).astype(np.int64) for k in (2, 3))
                good = (5 + FIFTHS) * np.minimum(x, y).sum(axis=1) >= FIFTHS * (x.sum(axis=1) + y.sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(good)), part.column(1).filter(pa.array(good))], names=["a", "b"])

    both = pairs.join(sketches.withColumnsRenamed({"fp": "a", "sketch": "sketch_a"}), "a").join(sketches.withColumnsRenamed({"fp": "b", "sketch": "sketch_b"}), "b")
    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(giving_back(run), "a long, b long")


def texts_of(needed: DataFrame, table: DataFrame) -> DataFrame:
    """(fp, text): a text of table (hash, text) for each row of needed (fp, hash)."""
    # few texts as a rule; where they are many, their hashes are not broadcast
    side = F.broadcast(needed) if needed.count() <= MOST_BROADCAST else needed.hint("shuffle_hash")
    return table.select("hash", "text").join(side, "hash").dropDuplicates(["fp"]).select("fp", "text")


def similar(pairs: DataFrame, rows: DataFrame, table: DataFrame, shingle: int) -> DataFrame:
    """The pairs (a, b) whose whole texts have a Jaccard similarity of 0.8 or more. rows (fp, hash, sketch) name the texts of table (hash, text)."""

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            known: dict[int, np.ndarray] = {}
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for fps, column in ((a, batch.column(2)), (b, batch.column(3))):
                ids, first = np.unique(fps, return_index=True)
                for fp, own in zip(ids.tolist(), text_bytes(column.take(pa.array(first)))):
                    if fp not in known:
                        known[fp] = shingles(own, shingle)
            good = np.zeros(len(a), bool)
            for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                x, y = known[x], known[y]
                good[i] = (5 + FIFTHS) * len(np.intersect1d(x, y, assume_unique=True)) >= FIFTHS * (len(x) + len(y))
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(b[good])], names=["a", "b"])

    pairs = written(pairs, "candidates")
    named = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    own = rows.join(named, "fp", "left_semi")
    sketches = written(own.groupBy("fp").agg(F.min("hash").alias("hash"), F.any_value("sketch").alias("sketch")), "sketches")
    pairs = written(may_be_similar(pairs, sketches.select("fp", "sketch")), "likely")
    named = pairs.select(F.col("a").alias("fp")).unionByName(pairs.select(F.col("b").alias("fp"))).distinct()
    needed = written(sketches.select("fp", "hash").join(named, "fp", "left_semi"), "needed")
    texts = written(texts_of(needed, table), "texts", "zstd")
    both = pairs.join(texts.withColumnsRenamed({"fp": "a", "text": "text_a"}), "a").join(texts.withColumnsRenamed({"fp": "b", "text": "text_b"}), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(giving_back(verify), "a long, b long")


def _members(starts: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first `many` members of sets that begin at starts, one set after the other, and where each set begins among them."""
    own = np.cumsum(many) - many
    return np.repeat(starts - own, many) + np.arange(int(many.sum())), own


def links_in_block(fp: np.ndarray, root: np.ndarray, block: np.ndarray, earlier: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect all similar sets, each of n tokens in the order of prefixes. Sets of one root, of unlike blocks only if there are two, and with an earlier cell in common (bits) are not compared."""
    ids = np.unique(tokens, return_inverse=True)[1]
    starts = np.cumsum(n) - n
    head = n - -(-n * FIFTHS // 5) + 1
    label = np.unique(root, return_inverse=True)[1]
    two = len(np.unique(block)) > 1
    mark = np.zeros(len(tokens), bool)
    a, b = [], []
    for x in range(len(fp) - 1):
        rest = slice(x + 1, None)
        ask = (label[rest] != label[x]) & (5 * np.minimum(n[rest], n[x]) >= FIFTHS * np.maximum(n[rest], n[x])) & ~(earlier[rest] & earlier[x]).any(axis=1)
        if two:
            ask &= block[rest] != block[x]
        y = x + 1 + np.flatnonzero(ask)
        if len(y):
            own = ids[starts[x] : starts[x] + n[x]]
            mark[own[: head[x]]] = True
            at, begin = _members(starts[y], head[y])
            y = y[np.logical_or.reduceat(mark[ids[at]], begin)]
            mark[own] = True
            if len(y):
                at, begin = _members(starts[y], n[y])
                both = np.add.reduceat(mark[ids[at]], begin, dtype=np.int64)
                y = y[(5 + FIFTHS) * both >= FIFTHS * (n[x] + n[y])]
            mark[own] = False
        if len(y):
            groups, first = np.unique(label[y], return_index=True)
            a += [int(fp[x])] * len(first)
            b += fp[y[first]].tolist()
            label[np.isin(label, groups)] = label[x]
    return a, b


def _linked(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """links_in_block of the rows of one cell and pair of blocks: cell, i, j, fp, root, block, cells, own."""
    table = pa.Table.from_batches(held).combine_chunks()
    cell = table.column(0)[0].as_py()
    fp, root, block = (table.column(k).to_numpy() for k in (3, 4, 5))
    before = [[c for c in cells if c < cell] for cells in table.column(6).to_pylist()]
    bit = {c: i for i, c in enumerate(sorted({c for cells in before for c in cells}))}
    earlier = np.zeros((len(fp), len(bit) + 63 >> 6), np.uint64)
    for row, cells in enumerate(before):
        for c in cells:
            earlier[row, bit[c] >> 6] |= np.uint64(1 << (bit[c] & 63))
    sets = table.column(7).to_pylist()
    n = np.array([len(x) // 8 for x in sets], np.int64)
    a, b = links_in_block(fp, root, block, earlier, np.frombuffer(b"".join(sets), "<i8"), n)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each cell and pair of blocks, whose rows follow each other."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([c.to_numpy() for c in batch.columns[:3]], axis=1)
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if held and last != keys[lo].tolist():
                yield _linked(held)
                held = []
            held.append(batch.slice(lo, hi - lo))
            last = keys[lo].tolist()
    if held:
        yield _linked(held)


def similar_in_cells(members: DataFrame, rows: DataFrame, table: DataFrame, shingle: int, common: np.ndarray) -> DataFrame:
    """Links (a, b) that connect all sets of a cell with a similarity of 0.8 or more. members (cell, fp, n, root): a cell has all sets of the long lists with one least set.

    A set is sent to a task once a cell, not once a list or pair, and two sets are compared in the first cell they share.
    A cell of many sets is cut into blocks, and each task gets two of them.
    """

    def as_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [in_order(shingles(b, shingle), common).astype("<i8").tobytes() for b in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["fp", "own"])

    cells = members.groupBy("fp").agg(F.collect_set("cell").alias("cells"))
    needed = written(rows.join(cells.select("fp"), "fp", "left_semi").groupBy("fp").agg(F.min("hash").alias("hash")), "cell_texts")
    sets = texts_of(needed, table).mapInArrow(giving_back(as_sets), "fp long, own binary")
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / HELD)).cast("int")
    placed = members.join(members.groupBy("cell").agg(blocks.alias("blocks")), "cell")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    placed = placed.select("cell", "fp", "root", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    placed = placed.select("cell", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "fp", "root", "block")
    dealt = placed.join(cells, "fp").join(sets, "fp").repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "fp")
    return dealt.select("cell", "i", "j", "fp", "root", "block", "cells", "own").mapInArrow(giving_back(_blocks), "a long, b long")


def jaccard_groups(docs: DataFrame, shingle: int = 5, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, hash, fp, root, component_id): documents linked by a Jaccard similarity of 0.8 or more of their sets of shingles.

    No pair is missed: two such sets share a shingle within their first fifths in any common order (prefix
    filter), and pairs that share one are verified on their whole texts, with 64-bit hashes of shingles, if
    sizes and places allow it. Shingles common in a sample go last in the order, which changes the work and not the result.
    Lists of a shingle are first linked from row to row; the pairs left to verify are those between
    different groups. Pairs of short lists are rows; sets of lists above LONG are compared within tasks, so that
    a large group of near copies, similar or just not, makes no row a pair.

    Equal sets are one node, known by a 64-bit hash. component_id is the smallest doc_id that links reach.
    Null and empty texts have the empty set and link with each other. A null key never names a component
    unless all of its keys are null. An empty table gives no rows, and further columns are left out.
    """
    table = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    hashed = F.xxhash64("text")

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(shingles(b, shingle) for b in text_bytes(batch.column(0)))]))], names=["token"])

    few = table.filter(F.pmod(hashed, F.lit(SAMPLED)) == 0).select("text").distinct().mapInArrow(giving_back(each), "token long")
    often = few.groupBy("token").count().filter(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(MOST_COMMON)
    common = np.sort(often.select("token").toPandas()["token"].to_numpy(np.int64))

    def name(own: np.ndarray) -> int:
        return xxhash.xxh64_intdigest(own.tobytes(), SEED)

    def named_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles(b, shingle) for b in text_bytes(batch.column(1))]
            fp = np.array([name(x) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp), batch.column(2), pa.array([histogram(x) for x in found], pa.binary())], names=["doc_id", "fp", "hash", "sketch"])

    def prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            found = [shingles(b, shingle) for b in text_bytes(batch.column(0))]
            tokens = [prefix(x, common) for x in found]
            many = [len(x) for x in tokens]
            fp = np.repeat(np.array([name(x) for x in found], np.uint64).view(np.int64), many)
            n = np.repeat(np.array([len(x) for x in found], np.int64), many)
            place = np.arange(len(fp)) - np.repeat(np.cumsum(many) - many, many).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), pa.array(fp), pa.array(n.astype(np.int32)), pa.array(place.astype(np.int32))], names=["token", "fp", "n", "place"])

    def shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            token, fp, n, place = columns
            again = np.concatenate([[False], (token[1:] == token[:-1]) & (fp[1:] == fp[:-1])])
            token, fp, n, place = columns = [x[~again] for x in columns]
            same = np.concatenate([[False], token[1:] == token[:-1], [False]])
            some = same[1:] | same[:-1]
            # lists of two, most of all, go where the two cannot be similar
            first = np.flatnonzero(~same[:-1] & same[1:] & ~np.concatenate([same[2:], [False]]))
            bad = first[~fits(n[first], n[first + 1], place[first], place[first + 1])]
            some[bad] = some[bad + 1] = False
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in columns], names=["token", "fp", "n", "place"])

    rows = written(table.select("doc_id", "text", hashed.alias("hash")).mapInArrow(giving_back(named_sets), f"doc_id {dict(table.dtypes)['doc_id']}, fp long, hash long, sketch binary"), "sets")
    ordered = lambda df: df.repartition("token").sortWithinPartitions("token", "n", "fp")
    placed = "token long, fp long, n int, place int"
    spread = table.select("text").mapInArrow(giving_back(prefixes), placed)
    lists = written(ordered(spread).mapInArrow(giving_back(shared), placed), "lists")
    hashed_table = table.select("text", hashed.alias("hash"))
    pair = "a long, b long"
    links = written(similar(ordered(lists).mapInArrow(giving_back(_neighbours), pair).distinct(), rows, hashed_table, shingle), "links")
    roots = components(links)
    known = lists.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("token", "fp", "n", "place", F.coalesce("root", "fp").alias("root"))
    left = written(ordered(known).mapInArrow(giving_back(_pairs), f"{pair}, n int, root long").distinct(), "left")
    links = links.unionByName(similar(left.filter("n = 0").select("a", "b"), rows, hashed_table, shingle))
    members = left.filter("n > 0").select(F.col("a").alias("cell"), F.col("b").alias("fp"), "n", "root")
    if not members.isEmpty():
        links = links.unionByName(similar_in_cells(members, rows, hashed_table, shingle, common))
    return grouped(rows.select("doc_id", "hash", "fp"), links)


def near_duplicates(docs: DataFrame, shingle: int = 5, threshold: int = 2, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, hash, root): documents linked by SimHash fingerprints at `threshold` or fewer bits, or by a Jaccard similarity of 0.8 or more.

    Fingerprints alone find few of the near copies of that similarity, whose fingerprints differ in seven bits
    as a rule; the exact join finds the rest. Groups of the two kinds that share a document are one.
    """
    one = simhash_groups(docs, shingle, threshold, text, key)
    one = written(one.select("doc_id", "hash", F.col("root").alias("first")), "fingerprint_groups")
    two = written(jaccard_groups(docs, shingle, text, key).select("hash", F.col("root").alias("second")).distinct(), "jaccard_groups")
    # equal texts are in one group of either kind, so a text's hash ties the two
    nodes = written(one.select("hash", "first").distinct().join(two, "hash"), "tied_groups")
    links = nodes.select(F.col("first").alias("a"), F.xxhash64(F.lit("jaccard"), "second").alias("b")).distinct()
    several = links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("b")
    roots = components(links.join(several, "b", "left_semi")).withColumnRenamed("node", "first")
    return one.join(roots, "first", "left").select("doc_id", "hash", F.coalesce("root", "first").alias("root"))
