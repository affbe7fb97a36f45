"""Byte-level BPE encoding and decoding by corpus-level merge replay."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import giving_back
from logweir.llm.pretoken import Pieces, tiktoken_splitter

#: Pieces kept from block to block in one worker, signs in them, and characters of text in a block: bounds of memory, not of work.
KEPT, KEPT_SIGNS = 350_000, 4_000_000
BLOCK = 1_000_000


class Vocabulary:
    """Ranks of byte strings, and for each pair of tokens whose joined bytes are a token the rank of that token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {i: b for b, i in ranks.items()}
        self.decimal = {i: b"%d," % i for i in self.token}
        self.size = max(ranks.values()) + 1
        self.byte = [ranks[bytes([b])] for b in range(256)]
        self.pairs = self.size * self.size
        #: Pair of tokens (left * size + right) -> its key in the index, rank * pairs + pair: keys stand in order of rank.
        self.pair: dict[int, int] = {}
        for joined, rank in ranks.items():
            for k in range(1, len(joined)):
                left, right = ranks.get(joined[:k]), ranks.get(joined[k:])
                if left is not None and right is not None:
                    self.pair[left * self.size + right] = rank * self.pairs + left * self.size + right

    @staticmethod
    @lru_cache(2)
    def load(path: str) -> "Vocabulary":
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each word: all merges in rank order over the whole list of words.

    An inverted index holds the positions of each pair of tokens that merges. The pairs of the lowest rank
    present are applied at all their positions from left to right; a merge changes only the pairs with the
    two neighbours, which are entered anew. A position whose pair has changed meanwhile is skipped.
    """
    pair, size, pairs = vocabulary.pair, vocabulary.size, vocabulary.pairs
    symbols: list[int] = [-1]
    byte = vocabulary.byte
    for w in words:
        symbols.extend([byte[x] for x in w])
        symbols.append(-1)
    after = list(range(1, len(symbols) + 1))
    before = list(range(-1, len(symbols) - 1))
    index: dict[int, list[int]] = {}
    last = -1
    for at, s in enumerate(symbols):
        if last >= 0 and s >= 0:
            key = pair.get(last * size + s)
            if key is not None:
                if key in index:
                    index[key].append(at - 1)
                else:
                    index[key] = [at - 1]
        last = s
    queue = list(index)
    heapq.heapify(queue)

    def enter(key: int, at: int) -> None:
        if key in index:
            index[key].append(at)
        else:
            index[key] = [at]
            heapq.heappush(queue, key)

    while queue:
        rank = queue[0] // pairs
        low, high = rank * pairs, (rank + 1) * pairs
        places: list[int] = []
        while queue and queue[0] < high:
            places += index.pop(heapq.heappop(queue), ())
        places.sort()
        for k, at in enumerate(places):
            if queue and queue[0] < low:  # a merge has made a pair of lower rank: that one goes first
                for x in places[k:]:
                    if symbols[x] >= 0 and symbols[after[x]] >= 0 and low <= pair.get(symbols[x] * size + symbols[after[x]], -1) < high:
                        enter(pair[symbols[x] * size + symbols[after[x]]], x)
                break
            left = symbols[at]
            if left < 0:
                continue
            follower = after[at]
            right = symbols[follower]
            if right < 0 or not low <= pair.get(left * size + right, -1) < high:
                continue
            symbols[at] = rank
            symbols[follower] = -2
            after[at] = beyond = after[follower]
            before[beyond] = at
            other = symbols[beyond]
            if other >= 0 and (key := pair.get(rank * size + other)) is not None:
                enter(key, at)
            ahead = before[at]
            other = symbols[ahead]
            if other >= 0 and (key := pair.get(other * size + rank)) is not None:
                enter(key, ahead)
    out: list[list[int]] = []
    own: list[int] = []
    for s in symbols[1:]:
        if s >= 0:
            own.append(s)
        elif s == -1:
            out.append(own)
            own = []
    return out


class Encoder:
    """Encodes block after block; pieces met before keep their ids."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary, self.splitter, self.known = vocabulary, tiktoken_splitter(pattern), Pieces()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > KEPT or self.known.signs > KEPT_SIGNS:
            self.known = Pieces()
        split = self.splitter.split(texts)
        at = self.known.numbers(split)
        found = replay([p.encode() for p in self.known.new], self.vocabulary)
        self.known.enter(np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([len(x) for x in found]))
        ids, counts = self.known.gathered(split, at)
        return np.split(ids, np.cumsum(counts)[:-1])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def blocks(texts: list[str], most: int = BLOCK) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_documents(docs: DataFrame, path: str, pattern: str | None = None, text: str = "text", key: str = "doc_id", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every document's whole text.

    Null text is empty text: no tokens, digests of nothing. Repeated rows give repeated results; a word's ids
    do not depend on the other words, so neither block nor partition bounds change a result, and equal pairs
    (ties) merge from the left. Very long texts are blocks of their own. An empty table gives no rows. Further
    columns of docs are left out. Texts stay where they are read: there is no shuffle.
    """

    if pattern is None:
        from public_tokenizers import PATTERN as pattern

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, pattern) not in _ENCODERS:
            _ENCODERS[path, pattern] = Encoder(Vocabulary.load(path), pattern)
        encoder = _ENCODERS[path, pattern]
        token, decimal = encoder.vocabulary.token, encoder.vocabulary.decimal
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in blocks(texts):
                rows, lists = [], encoder.encode(texts[lo:hi])
                for own in lists:
                    numbers = own.tolist()
                    decoded = b"".join(map(token.__getitem__, numbers))
                    joined = b"".join(map(decimal.__getitem__, numbers))[:-1]
                    rows.append((len(numbers), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                columns = [batch.column(0).slice(lo, hi - lo), *map(pa.array, zip(*rows))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(starts), pa.array(np.concatenate(lists).astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = dict(docs.dtypes)[key]
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(giving_back(run), schema)


def op2_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
