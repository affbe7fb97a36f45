"""Suffix-array dedup: removal of byte strings of a given length that start more than once in the corpus.

A full suffix array of a corpus is not sorted; a sample of its suffixes is enough. Every window of WINDOW
bytes names one of its GRAM-byte strings as its anchor, the one of least hash (the first among equals), so
equal windows have their anchors at the same place. Consecutive windows with one anchor are a segment. Three
steps find all windows that occur twice:

1. Segments, dealt in ranges of (anchor, content, place), are compared with their neighbours in that order. Equal
   contents repeat as a whole. A segment whose anchor is nowhere else has no repeated window.
2. The others, one for each content, are ordered by the suffix that starts at the anchor and by the reversed
   prefix that ends there: multikey quicksort to a shallow depth, then a blind trie for each group that is
   still together. Two windows are equal if their parts before and after the anchor are.
3. A group of more than HOT contents is not sorted in one task. Its windows are halved by the place of the anchor in
   them; windows of one half have some bytes before or after the anchor in common places, and the contents are
   dealt again by these bytes. So groups are split by more and more context until they are small or hold one
   string alone, and what is sorted is sorted as any other group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import giving_back, text_bytes, written

WINDOW = 200
GRAM = 32
#: Bytes of a text looked at in one step.
STEP = 200_000
POSITION = np.uint64((1 << 18) - 1)
#: Contents of one group that are sorted in one task; larger groups are split.
HOT = 4096
#: Depth of multikey quicksort, and bytes it compares at a time.
SHALLOW, WORD = 32, 8
#: Contents ordered in one step, if their anchors are cool.
BATCH = 20_000
REPEATED, UNSETTLED = 1, 2


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    up, down = np.empty(STEP + WINDOW + 1, np.uint64), np.empty(STEP + WINDOW + 1, np.uint64)
    up[0] = down[0] = 1
    np.cumprod(np.full(len(up) - 1, base, np.uint64), out=up[1:])
    np.cumprod(np.full(len(up) - 1, pow(base, -1, 1 << 64), np.uint64), out=down[1:])
    return up, down


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def segments(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """(start, windows, place of the anchor, anchor, content) of all segments of text; hashes as signed numbers."""
    found = []
    for lo in range(0, len(text) - window + 1, STEP):
        found.append(_segments(text[lo : lo + STEP + window - 1], window, lo))
    if not found:
        return (np.zeros(0, np.int64),) * 5
    return tuple(np.concatenate(c) for c in zip(*found))


def _segments(text: bytes, window: int, shift: int) -> tuple[np.ndarray, ...]:
    n, span = len(text), window - GRAM + 1
    up, down = _powers()
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum((np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: n - GRAM + 1])
    key = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    padded = np.full(-(-len(key) // span) * span, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    padded = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - window + 1
    least = np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows])
    start = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    many = np.diff(np.concatenate([start, [windows]]))
    place = (least[start] & POSITION).astype(np.int64)
    content = _mixed((sums[start + many - 1 + window] - sums[start]) * down[start])
    return start + shift, many, place + shift, grams[place].view(np.int64), content.view(np.int64)


def list_segments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc", "at", "anchor", "content"]
    for batch in batches:
        docs, rows, held = batch.column(0).to_numpy(), [], 0
        for i, text in enumerate(text_bytes(batch.column(1))):
            start, many, _, anchor, content = segments(text)
            if len(start):
                rows.append((np.full(len(start), docs[i]), start << 8 | many - 1, anchor, content))
                held += len(start)
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], names=names)


def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Marks rows in order of (anchor, content): repeated contents, and one row or two of each content whose anchor has another content too.

    Only neighbours count, so one row is carried from batch to batch. Rows of one content or one anchor may
    span partitions: the first and the last row of a partition are taken to have a neighbour with their anchor
    and another content, so they go on to the sorting step, which settles them.
    """
    carried = None
    previous: tuple[int, int] | None = None

    def marked(rows: list[np.ndarray], last: bool) -> pa.RecordBatch:
        doc, at, anchor, content = rows
        same_anchor = anchor[1:] == anchor[:-1]
        same = same_anchor & (content[1:] == content[:-1])
        before, after = np.ones(len(doc), bool), np.ones(len(doc), bool)
        equal_before, equal_after = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
        before[1:], equal_before[1:] = same_anchor, same
        after[:-1], equal_after[:-1] = same_anchor, same
        if previous is not None:
            before[0] = previous[0] == anchor[0]
            equal_before[0] = before[0] and previous[1] == content[0]
        n = len(doc) if last else len(doc) - 1
        repeated = (equal_before | equal_after)[:n]
        unsettled = ((before & ~equal_before) | (after & ~equal_after))[:n]
        kind = repeated * REPEATED + unsettled * UNSETTLED
        keep = np.flatnonzero(kind)
        return pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(at[keep] << 2 | kind[keep]), pa.array(anchor[keep], mask=~unsettled[keep])], names=["doc", "mark", "anchor"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [batch.column(i).to_numpy() for i in range(4)]
        if carried is not None:
            rows = [np.concatenate([a, b]) for a, b in zip(carried, rows)]
        if len(rows[0]) > 1:
            yield marked(rows, False)
            previous = (int(rows[2][-2]), int(rows[3][-2]))
        carried = [r[-1:] for r in rows]
    if carried is not None:
        yield marked(carried, True)


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7 >> 3)


def multikey_quicksort(strings: list[bytes], rows: list[int], depth: int, out: list[int]) -> None:
    """Appends rows in order of their strings, which agree up to depth, to out."""
    while len(rows) > 1:
        if depth >= SHALLOW:
            blind_trie(strings, rows, depth, out)
            return
        keys = [strings[r][depth : depth + WORD] for r in rows]
        middle = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
        less = [r for r, k in zip(rows, keys) if k < middle]
        more = [r for r, k in zip(rows, keys) if k > middle]
        equal = [r for r, k in zip(rows, keys) if k == middle]
        if less:
            multikey_quicksort(strings, less, depth, out)
        if len(middle) < WORD:
            out += equal  # these strings end here and are equal
        elif more:
            multikey_quicksort(strings, equal, depth + WORD, out)
        else:
            rows, depth = equal, depth + WORD
            continue
        if not more:
            return
        rows = more
    out += rows


def blind_trie(strings: list[bytes], rows: list[int], depth: int, out: list[int]) -> None:
    """Appends rows in order: each is put into a trie that holds, at each node, only the depth of branching and the branching bytes.

    A string goes down by its bytes at the nodes' depths alone to some leaf; one comparison with that leaf
    finds its true place. Equal strings share a leaf; -1 stands for the end of a string.
    """
    root: list | tuple = [rows[0]]  # a leaf is a list of rows, a node a tuple (depth, children by byte)
    for row in rows[1:]:
        text = strings[row]
        path, node = [], root
        while type(node) is tuple:
            at = node[0]
            byte = text[at] if at < len(text) else -1
            path.append((node, byte))
            node = node[1].get(byte)
            if node is None:
                node = next(iter(path[-1][0][1].values()))
        other = strings[node[0]]
        if other == text:
            node.append(row)
            continue
        shared = common_prefix(text, other)
        own = text[shared] if shared < len(text) else -1
        its = other[shared] if shared < len(other) else -1
        parent = None
        below: list | tuple = root
        for at_node, byte in path:
            if at_node[0] >= shared:
                break
            parent, below = (at_node, byte), at_node[1].get(byte)
        if type(below) is tuple and below[0] == shared:
            below[1][own] = [row]
            continue
        split = (shared, {its: below, own: [row]})
        if parent is None:
            root = split
        else:
            parent[0][1][parent[1]] = split
    stack = [root]
    while stack:
        node = stack.pop()
        if type(node) is tuple:
            stack += [node[1][b] for b in sorted(node[1], reverse=True)]
        else:
            out += node


def deep_shallow(strings: list[bytes]) -> tuple[list[int], list[int]]:
    """The order of strings, and the common prefix of each in that order with the one before it (the first: -1)."""
    order: list[int] = []
    multikey_quicksort(strings, list(range(len(strings))), 0, order)
    return order, [-1, *(common_prefix(strings[i], strings[j]) for i, j in zip(order, order[1:]))]


def repeated_windows(groups: list[list[tuple[bytes, int, int, int]]], window: int = WINDOW) -> np.ndarray:
    """For groups of pieces (bytes, place of the anchor, least and most bytes before the anchor in its windows): a row a piece, True at x where the window with x bytes before the anchor is in another piece of its group too."""
    lows, highs = [], []  # of the numbers of bytes before the anchor in a piece's windows
    orders, prefixes = ([], []), ([], [])
    base = 0
    for group in groups:
        for side, strings in enumerate(([b[a:] for b, a, _, _ in group], [b[:a][::-1] for b, a, _, _ in group])):
            order, shared = deep_shallow(strings)
            orders[side].append(np.array(order) + base)
            prefixes[side].append(np.array(shared))
        lows += [x for _, _, x, _ in group]
        highs += [x for _, _, _, x in group]
        base += len(group)
    low, high = np.array(lows), np.array(highs)
    place, shared, most = [], [], []
    for side in (0, 1):
        order, common = np.concatenate(orders[side]), np.concatenate(prefixes[side])
        at = np.empty(base, np.int64)
        at[order] = np.arange(base)
        best = np.maximum(common, np.concatenate([common[1:], [-1]]))
        place.append(at)
        shared.append(common)
        most.append(best[at])
    found = np.zeros((base, window - GRAM + 1), bool)
    for x in range(found.shape[1]):
        own = np.flatnonzero((low <= x) & (high >= x) & (most[0] >= window - x) & (most[1] >= x))
        if len(own) < 2:
            continue
        right = np.cumsum(shared[0] < window - x)[place[0][own]]
        left = np.cumsum(shared[1] < x)[place[1][own]]
        _, inverse, counts = np.unique(right * (base + 1) + left, return_inverse=True, return_counts=True)
        found[own, x] = counts[inverse] > 1
    return found


def sort_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, start, stop) of the repeated strings among pieces in order of their anchors."""
    held: list[list[tuple]] = []
    count, last = 0, None

    def done() -> pa.RecordBatch:
        pieces = [p for g in held for p in g]
        found = repeated_windows([[(p[3], p[2], max(p[4], p[2] - (p[1] & 0xFF)), min(p[5], p[2])) for p in g] for g in held])
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, x0 = np.nonzero(edges == 1)
        _, x1 = np.nonzero(edges == -1)
        doc = np.array([p[0] for p in pieces], np.int64)[row]
        anchor = np.array([(p[1] >> 8) + p[2] for p in pieces], np.int64)[row]
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(anchor - x1 + 1), pa.array(anchor - x0 + WINDOW)], names=["doc", "start", "stop"])

    for batch in batches:
        for anchor, *piece in zip(*(batch.column(i).to_pylist() for i in range(7))):
            if anchor != last:
                if held and len(held[-1]) < 2:
                    count -= len(held.pop())
                if count >= BATCH:
                    yield done()
                    held, count = [], 0
                held.append([])
                last = anchor
            held[-1].append(tuple(piece))
            count += 1
    if held and len(held[-1]) < 2:
        count -= len(held.pop())
    if count:
        yield done()


def refine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece for either half of its range of bytes before the anchor, under a key of what all windows of the half have in common. A half of one window has no need of more bytes."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
    for batch in batches:
        rows = []
        for key, doc, at, place, data, lo, hi in zip(*(c.to_pylist() for c in batch.columns)):
            middle = (lo + hi) // 2
            for low, high in ((lo, middle), (middle + 1, hi)):
                if max(low, place - (at & 0xFF)) > min(high, place):
                    continue
                shared = data[place - low : place + WINDOW - high]
                digest = xxhash.xxh3_64_intdigest(shared, (key & (1 << 63) - 1) * 2 + (low > lo) & (1 << 64) - 1)
                rows.append((digest - (1 << 63), doc, at, place, data, low, high))
        for i in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[i : i + 20_000]), kinds)], names=["key", "doc", "at", "place", "piece", "lo", "hi"])


def same_strings(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, doc, start) of pieces of one window: the window's 128-bit digest."""
    for batch in batches:
        rows = []
        for _, doc, at, place, data, x, _ in zip(*(c.to_pylist() for c in batch.columns)):
            digest = xxhash.xxh3_128_digest(data[place - x : place - x + WINDOW])
            rows.append((*np.frombuffer(digest, np.int64).tolist(), doc, (at >> 8) + place - x))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["high", "low", "doc", "start"])


def repeated_spans(pieces: DataFrame) -> DataFrame:
    """(doc, start, stop) of the repeated strings among pieces (key, doc, at, place, piece, lo, hi) of one key.

    Rounds of counting and splitting leave groups of at most HOT pieces, which are sorted; a group of one piece
    is nothing's repeat and goes. A larger group whose windows have nothing left to split by holds one string,
    which is counted.
    """
    spans, work = None, pieces
    while True:
        counts = written(work.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "counts")
        small = work.join(counts.filter(F.col("n") <= HOT).select("key"), "key", "left_semi")
        found = small.repartition("key").sortWithinPartitions("key").select(*pieces.columns).mapInArrow(giving_back(sort_pieces), "doc long, start long, stop long")
        spans = found if spans is None else spans.unionByName(found)
        large = counts.filter(F.col("n") > HOT).select("key")
        if large.isEmpty():
            return spans
        large = written(work.join(large, "key", "left_semi").select(*pieces.columns), "large")
        windows = written(large.filter("lo = hi").mapInArrow(giving_back(same_strings), "high long, low long, doc long, start long"), "windows")
        twice = windows.groupBy("high", "low").count().filter("count > 1").select("high", "low")
        spans = spans.unionByName(windows.join(twice, ["high", "low"]).select("doc", "start", (F.col("start") + WINDOW).alias("stop")))
        work = written(large.filter("lo < hi").mapInArrow(giving_back(refine), pieces.schema), "refined")


def cut_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(anchor, doc, at, place, bytes) of each text's unsettled segments."""
    names = ["anchor", "doc", "at", "place", "piece"]
    for batch in batches:
        rows: list[tuple] = []
        texts, docs, marks = batch.column("text"), batch.column("doc").to_pylist(), batch.column("marks")
        for i in range(batch.num_rows):
            own = marks[i].as_py()
            if own is None:
                continue
            own = np.array([m >> 2 for m in own if m & UNSETTLED], np.int64)
            if not len(own):
                continue
            text = (texts[i].as_py() or "").encode()
            start, _, place, anchor, _ = segments(text)
            at = np.searchsorted(start, own >> 8)
            for mark, p, a in zip(own.tolist(), place[at].tolist(), anchor[at].tolist()):
                s = mark >> 8
                rows.append((a, docs[i], mark, p - s, text[s : s + (mark & 0xFF) + WINDOW]))
            if len(rows) > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=names)


def removed(length: int, marks: list[int] | None, spans: list[int] | None) -> np.ndarray:
    """True at each byte that a repeated string covers."""
    edges = np.zeros(length + 1, np.int32)
    if marks:
        m = np.array(marks, np.int64)
        at = m[(m & REPEATED) > 0] >> 2
        np.add.at(edges, at >> 8, 1)
        np.add.at(edges, (at >> 8) + (at & 0xFF) + WINDOW, -1)
    if spans:
        s = np.array(spans, np.int64).reshape(-1, 2)
        np.add.at(edges, s[:, 0], 1)
        np.add.at(edges, s[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def characters(text: bytes, gone: np.ndarray) -> bytes:
    """The characters of text no byte of which is gone."""
    data = np.frombuffer(text, np.uint8)
    first = (data & 0xC0) != 0x80
    number = np.cumsum(first) - 1
    cut = np.zeros(int(number[-1]) + 1 if len(data) else 0, bool)
    cut[number[gone]] = True
    return data[~cut[number]].tobytes()


def _strip(keep_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            marks, spans = batch.column("marks"), batch.column("spans")
            for i, text in enumerate(text_bytes(batch.column("text"))):
                m, s = marks[i].as_py(), spans[i].as_py()
                if m or s:
                    gone = removed(len(text), m, s)
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                else:
                    kept, runs = text, 0
                whole = characters(text, gone) if keep_text and len(kept) < len(text) else kept
                rows.append((len(text), len(text) - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept if keep_text else None, whole.decode() if keep_text else None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
            computed = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "kept_text"]
            n = 6 if keep_text else 4
            others = [x for x in batch.schema.names if x not in ("doc", "text", "marks", "spans")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in others), *computed[:n]], names=[*others, *names[:n]])

    return run


def suffix_dedup(docs: DataFrame, text: str = "text", columns: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """The given columns of docs with n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept (the remaining bytes) and kept_text (the characters that remain whole).

    Removed is every byte inside a WINDOW-byte string that starts at another place too, in the same text or
    another, as the texts were given. Null and empty texts and those shorter than a window lose nothing.
    Repeated rows repeat each other and are removed whole if long enough; of equal strings none is preferred,
    so there are no ties. Very long texts are read in steps of STEP bytes. An empty table gives no rows;
    columns other than the given ones are left out and may have any names.
    """
    key = F.xxhash64(*[F.col(c) for c in columns], F.col(text))
    rows = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(columns)], key.alias("doc"), F.col(text).alias("text"))
    listed = rows.select("doc", "text").mapInArrow(giving_back(list_segments), "doc long, at long, anchor long, content long")
    listed = listed.repartitionByRange("anchor", "content", "doc", "at").sortWithinPartitions("anchor", "content", "doc", "at")
    settled = written(listed.mapInArrow(giving_back(settle), "doc long, mark long, anchor long"), "segments")
    marks = settled.groupBy("doc").agg(F.collect_list("mark").alias("marks"))
    with_marks = rows.join(marks.hint("shuffle_hash"), "doc", "left")
    pieces = written(with_marks.mapInArrow(giving_back(cut_pieces), "anchor long, doc long, at long, place int, piece binary"), "pieces", "zstd")
    whole = pieces.select(F.col("anchor").alias("key"), "doc", "at", "place", "piece", F.lit(0).alias("lo"), F.lit(WINDOW - GRAM).alias("hi"))
    spans = repeated_spans(whole)
    spans = spans.groupBy("doc").agg(F.flatten(F.collect_list(F.array("start", "stop"))).alias("spans"))
    both = with_marks.join(spans.hint("shuffle_hash"), "doc", "left")
    kinds = dict(docs.dtypes)
    schema = ", ".join(f"c_{i} {kinds[c]}" for i, c in enumerate(columns)) + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * keep_text
    out = both.mapInArrow(giving_back(_strip(keep_text)), schema)
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(columns)], *out.columns[len(columns) :])


def op1_suffix(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
