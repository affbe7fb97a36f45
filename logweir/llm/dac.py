"""Token ids as directly addressable codes: random access to any token without decoding a block.

An id is split into chunks of 8 bits, low bits first. Level k holds the k-th chunk of every id that has one,
and a bitmap with a 1 for each chunk that is followed by another; the chunk's place in the next level is the
number of ones before it, which a directory of counts, one for each 512 bits, gives in constant time.

Shard file, little-endian: magic `DAC1`; uint32 levels; uint64 tokens, documents, start (tokens before the
shard in its part); uint64 x documents: document lengths; then for each level uint64 n, n bytes of chunks,
ceil(n / 8) bytes of bitmap (bit i of byte j is chunk 8 j + i), and uint32 x ceil(n / 512) of directory.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.llm.bpe import blocks
from logweir.llm.common import give_back, shared_dir
from logweir.llm.pretoken import SPACE, Pieces, tokenizers_splitter

MAGIC = b"DAC1"
RANK = 512
#: A shard is closed after the document that brings it to so many tokens.
SHARD_TOKENS = 1_000_000
#: Pieces kept from block to block in one worker, and signs in them.
MOST_PIECES, MOST_SIGNS = 700_000, 8_000_000
#: Pieces encoded in one call of the library.
RUN = 5000
#: Characters of text in a block.
BLOCK = 500_000
#: Rows of an Arrow batch turned into Python objects at a time.
ROWS = 500


def pack(ids: np.ndarray, lengths: np.ndarray, start: int = 0) -> bytes:
    """The shard of ids (unsigned, up to 32 bits), documents one after the other."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.add.reduceat(more, np.arange(0, len(more), RANK)) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([np.zeros(1, np.int64), np.cumsum(ones)[:-1]]).astype("<u4")[: len(ones)]
        levels.append(np.uint64(len(rest)).tobytes() + (rest & 0xFF).astype(np.uint8).tobytes() + bits.tobytes() + ranks.tobytes())
        rest = rest[more] >> 8
        if not len(rest):
            break
    head = np.array([len(ids), len(lengths), start], "<u8").tobytes() + lengths.astype("<u8").tobytes()
    return MAGIC + np.array([len(levels)], "<u4").tobytes() + head + b"".join(levels)


class Shard:
    """Reads a shard."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a shard of directly addressable codes")
        (levels,) = np.frombuffer(blob, "<u4", 1, 4)
        self.tokens, documents, self.start = (int(x) for x in np.frombuffer(blob, "<u8", 3, 8))
        self.lengths = np.frombuffer(blob, "<u8", documents, 32).astype(np.int64)
        at, self.levels = 32 + 8 * documents, []
        for _ in range(int(levels)):
            n = int(np.frombuffer(blob, "<u8", 1, at)[0])
            chunks = np.frombuffer(blob, np.uint8, n, at + 8)
            at += 8 + n
            bits = np.frombuffer(blob, np.uint8, -(-n // 8), at)
            at += len(bits)
            ranks = np.frombuffer(blob, "<u4", -(-n // RANK), at)
            at += 4 * len(ranks)
            self.levels.append((chunks, bits, ranks))
        if at != len(blob):
            raise ValueError("a shard of another length than its header says")

    def __getitem__(self, i: int) -> int:
        """Token i: at most one step in each level."""
        if not 0 <= i < self.tokens:
            raise IndexError(i)
        value = shift = 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK * RANK
            ones = int(np.unpackbits(bits[first >> 3 : (i >> 3) + 1], bitorder="little")[: i - first].sum())
            i, shift = int(ranks[first // RANK]) + ones, shift + 8
        return value

    def all(self) -> np.ndarray:
        """All tokens, level by level."""
        value = np.zeros(self.tokens, np.uint32)
        at = np.arange(self.tokens)
        for k, (chunks, bits, _) in enumerate(self.levels):
            value[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return value


class PieceIds:
    """Ids of texts by the tokenizers library, which encodes each distinct piece once.

    The pieces are those of the library's byte-level pre-tokenizer, by the classes it gives to signs; its model
    merges them one by one, so the ids of a text are those of its pieces, one after the other. Pieces are
    known by their whole strings. A text that holds one of the library's special tokens is encoded as a whole.
    The table is emptied when it holds MOST_PIECES pieces or MOST_SIGNS signs.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splitter, self.known = tokenizers_splitter(self.tokenizer), Pieces()
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # a byte-level token has one sign for each of its bytes
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self) -> None:
        """Enters the ids of new pieces.

        They are encoded in long runs, each piece that does not begin with a space after a line break, and the
        ids fall to pieces by their numbers of bytes. Pieces of white space are encoded one by one.
        """
        new, known = self.known.new, self.splitter.known
        plain = [i for i, p in enumerate(new) if known[p[p[0] == " " :][:1] or " "] != SPACE]
        found: list = [None] * len(new)
        for lo in range(0, len(plain), RUN):
            part = [new[i] for i in plain[lo : lo + RUN]]
            breaks = np.fromiter((p[0] != " " for p in part), bool, len(part))
            (ids,) = self.library(["".join(p if p[0] == " " else "\n" + p for p in part)])
            ends = np.cumsum(self.bytes_of[ids])
            stops = np.cumsum(np.fromiter((len(p.encode()) for p in part), np.int64, len(part)) + breaks)
            if ends[-1] != stops[-1]:
                raise ValueError("ids of other bytes than the pieces")
            last = np.searchsorted(ends, stops) + 1
            first = np.concatenate([[0], last[:-1]]) + breaks
            for i, x, y in zip(plain[lo : lo + RUN], first.tolist(), last.tolist()):
                found[i] = ids[x:y]
        rest = [i for i, x in enumerate(found) if x is None]
        for lo in range(0, len(rest), RUN):
            for i, ids in zip(rest[lo : lo + RUN], self.library([new[i] for i in rest[lo : lo + RUN]])):
                found[i] = ids
        self.known.enter(np.fromiter(chain.from_iterable(found), np.uint32), np.cumsum([len(x) for x in found]))

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, and their numbers."""
        if len(self.known) > MOST_PIECES or self.known.signs > MOST_SIGNS:
            self.known = Pieces()
        whole = {i for i, t in enumerate(texts) for s in self.special if s in t}
        split = self.splitter.split(["" if i in whole else t for i, t in enumerate(texts)])
        at = self.known.numbers(split)
        self.learn()
        ids, counts = self.known.gathered(split, at)
        if whole:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in whole:
                parts[i] = np.array(self.library([texts[i]])[0], np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return np.insert(ids, np.cumsum(counts), np.uint32(end)), counts + 1


_ENCODERS: dict[str, PieceIds] = {}


def write_shards(docs: DataFrame, path: str, out: str, end: int = 0, text: str = "text", key: str = "doc_id") -> None:
    """Writes the ids of all texts as shards, in ascending order of the key, as Parquet rows (part, shard, tokens, keys, blob) in `out`.

    Rows are dealt by ranges of the key, so parts follow one another; a hot range is split by sampling, and
    only equal keys must meet. `keys` are the documents' keys in the order of the shard.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = PieceIds(path)
        encoder = _ENCODERS[path]
        part = TaskContext.get().partitionId()
        keys, ids, lengths, held, start, shard = [], [], [], 0, 0, 0

        def closed() -> pa.RecordBatch:
            blob = pack(np.concatenate(ids), np.concatenate(lengths), start)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([held], pa.int64()), pa.array([keys], pa.list_(kind)), pa.array([blob], pa.binary())], names=["part", "shard", "tokens", "keys", "blob"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            for some in range(0, batch.num_rows, ROWS):
                part_of = batch.slice(some, ROWS)
                texts, own = [t or "" for t in part_of.column(1).to_pylist()], part_of.column(0).to_pylist()
                for lo, hi in blocks(texts, BLOCK):
                    got, n = encoder.encode(texts[lo:hi], end)
                    ids.append(got)
                    lengths.append(n)
                    keys += own[lo:hi]
                    held += len(got)
                    if held >= SHARD_TOKENS:
                        yield closed()
                        start, shard = start + held, shard + 1
                        keys, ids, lengths, held = [], [], [], 0
                        give_back()
        if keys:
            yield closed()
        give_back()

    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows.mapInArrow(run, f"part int, shard int, tokens long, keys array<{kind}>, blob binary").write.parquet(out)


def read_documents(spark, out: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards of `out`, computed from the stored codes.

    A shard knows how many tokens stand before it in its part. The sums of the parts are at most as many rows
    as there were partitions when they were written; they are broadcast.
    """
    shards = spark.read.parquet(out)
    sums = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("part"), F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for before, keys, blob in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                shard = Shard(blob.as_py())
                ids = shard.all().astype("<u4")
                stops = np.cumsum(shard.lengths)
                starts = stops - shard.lengths
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(starts.tolist(), stops.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [keys.values, pa.array(starts + before + shard.start), pa.array(shard.lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"]
                )
            give_back()

    kind = shards.schema["keys"].dataType.elementType.simpleString()
    rows = shards.join(F.broadcast(sums), "part").select("before", "keys", "blob")
    return rows.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def encode_to_shards(docs: DataFrame, path: str, out: str | None = None, end: int = 0) -> DataFrame:
    """Writes shards and reads them back.

    Null and empty texts hold the end id alone. Rows with equal keys follow one another in order of their
    texts. Null keys come first. A very long text makes a long shard. An empty table gives no rows; further
    columns of docs are left out.
    """
    spark = docs.sparkSession
    out = out or f"{shared_dir(spark)}/dac-{uuid.uuid4().hex}"
    write_shards(docs, path, out, end)
    return read_documents(spark, out)


def op8_dac(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_to_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
