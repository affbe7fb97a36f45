"""MPEG audio in media columns: frames written from bytes, and streams parsed, checked and measured.

Streams are MPEG-1 Layer III, 48 kHz, one channel: an ID3v2.4 tag with the payload's length, a frame with the
variable-bitrate table (`Xing`), then frames that carry the payload, 64 bytes a unit, as their main data. Each
frame has a checksum and lasts exactly 24 ms.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from logweir.llm.common import text_bytes, written

UNIT = 64
#: Fixed values of the format: kbit/s by (version is 1, layer) and index, Hz by index (halved for MPEG-2, quartered for 2.5).
KBITS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES = KBITS[True, 3]
RATES = (44100, 48000, 32000)
#: Fields of an ID3v1 tag: name, first byte, bytes.
ID3V1 = (("title", 3, 30), ("artist", 33, 30), ("album", 63, 30), ("year", 93, 4), ("comment", 97, 30))
#: Bytes of streams in one batch.
MOST_BYTES = 64 << 20
HEAD = 4 + 2 + 17
RATE = 48000


def frame_size(bitrate: int, rate: int, padding: int = 0) -> int:
    return 144 * bitrate * 1000 // rate + padding


def crc16(data: bytes) -> int:
    """The checksum of MPEG audio: polynomial 0x8005, from 0xFFFF, high bits first."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005) & 0xFFFF if value & 0x8000 else value << 1
    return value


@cache
def _checked(data: bytes) -> int:
    return crc16(data)


#: Payload of a full frame, and for each number of units the smallest frame that holds them.
FULL = (frame_size(320, RATE) - HEAD) // UNIT * UNIT
FITTING = [next(b for b in range(1, 15) if frame_size(BITRATES[b], RATE) - HEAD >= n * UNIT) for n in range(1, FULL // UNIT + 1)]


@cache
def frame_head(payload: int) -> tuple[bytes, int]:
    """Header, checksum and side information of a frame with so many bytes of main data, and the frame's size."""
    index = FITTING[payload // UNIT - 1]
    header = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    half = payload * 8 // 2
    side = (half << (136 - 30) | half << (136 - 89)).to_bytes(17, "big")
    return header + crc16(header[2:] + side).to_bytes(2, "big") + side, frame_size(BITRATES[index], RATE)


def syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def write(data: bytes) -> bytes:
    """The stream that holds data, padded with zeros to a positive multiple of 64 bytes."""
    payload = np.zeros(max(1, -(-len(data) // UNIT)) * UNIT, np.uint8)
    payload[: len(data)] = np.frombuffer(data, np.uint8)
    full, rest = divmod(len(payload), FULL)
    parts, sizes = [], []
    if full:
        head, size = frame_head(FULL)
        frames = np.zeros((full, size), np.uint8)
        frames[:, : len(head)] = np.frombuffer(head, np.uint8)
        frames[:, len(head) : len(head) + FULL] = payload[: full * FULL].reshape(full, FULL)
        parts.append(frames.tobytes())
        sizes.append(np.full(full, size))
    if rest:
        head, size = frame_head(rest)
        parts.append((head + payload[full * FULL :].tobytes()).ljust(size, b"\0"))
        sizes.append(np.array([size]))
    sizes = np.concatenate(sizes)
    head = bytes([0xFF, 0xFB, 5 << 4 | 1 << 2, 0xC0]).ljust(21, b"\0")
    first = frame_size(64, RATE)
    total = first + int(sizes.sum())
    at = np.concatenate([[first], first + np.cumsum(sizes)[:-1]])
    toc = at[np.arange(100) * len(sizes) // 100] * 256 // total
    table = b"Xing" + (7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + toc.astype(np.uint8).tobytes()
    body = b"\x03n_bytes\0" + str(len(data)).encode()
    tag = b"TXXX" + syncsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + syncsafe(len(tag)) + tag + (head + table).ljust(first, b"\0") + b"".join(parts)


@dataclass(frozen=True)
class Header:
    """What the four bytes before a frame say. `side` is the length of Layer III's side information, `alone` whether there is one channel."""

    size: int
    kbit: int
    rate: int
    samples: int
    layer: int
    version: float
    checksum: bool
    side: int
    alone: bool


def header_at(data: bytes, at: int) -> Header | None:
    """The frame header there, if it is one: MPEG-1, 2 or 2.5, Layer I, II or III. Free bitrates are not read."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    return _header(data[at + 1], data[at + 2], data[at + 3] >> 6)


@lru_cache(4096)
def _header(one: int, two: int, mode: int) -> Header | None:
    version, layer = {3: 1, 2: 2, 0: 2.5}.get(one >> 3 & 3), 4 - (one >> 1 & 3)
    index, which, padding = two >> 4, two >> 2 & 3, two >> 1 & 1
    if version is None or layer == 4 or index in (0, 15) or which == 3:
        return None
    kbit, rate = KBITS[version == 1, layer][index], RATES[which] >> {1: 0, 2: 1, 2.5: 2}[version]
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12 * kbit * 1000 // rate + padding) * 4 if layer == 1 else samples // 8 * kbit * 1000 // rate + padding
    alone = mode == 3
    side = 0 if layer != 3 else (17 if alone else 32) if version == 1 else (9 if alone else 17)
    return Header(size, kbit, rate, samples, layer, version, not one & 1, side, alone)


def read_tags(data: bytes) -> tuple[dict[str, str], int]:
    """ID3v2 text frames at the front and ID3v1 fields at the end, and where the audio may begin."""
    tags, begin = {}, 0
    if data[-128:-125] == b"TAG":
        for name, first, n in ID3V1:
            value = data[len(data) - 128 + first :][:n].split(b"\0")[0].decode("latin-1").strip()
            if value:
                tags[name] = value
    if data[:3] == b"ID3" and len(data) >= 10:
        number = lambda part, bits: sum((b & (1 << bits) - 1) << bits * k for k, b in enumerate(reversed(part)))
        begin = 10 + number(data[6:10], 7)
        i = 10
        while i + 10 <= min(begin, len(data)) and data[i : i + 4].strip(b"\0"):
            n = number(data[i + 4 : i + 8], 7 if data[3] >= 4 else 8)
            name, body = data[i : i + 4].decode("latin-1"), data[i + 10 : i + 10 + n]
            if name[0] == "T" and body:
                text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] & 3], "replace")
                first, _, rest = text.partition("\0")
                tags[first if name == "TXXX" else name] = rest if name == "TXXX" else first
            i += 10 + n
    return tags, begin


def read_table(data: bytes, at: int, head: Header) -> dict | None:
    """The variable-bitrate table in the frame at `at`, if it has one: Xing or Info, with an encoder's delay and padding, or VBRI."""
    number = lambda i, n: int.from_bytes(data[i : i + n], "big")
    i = at + 4 + head.side
    if data[i : i + 4] in (b"Xing", b"Info"):
        found, flags = {"kind": data[i : i + 4].decode()}, number(i + 4, 4)
        i += 8
        for bit, name, n in ((1, "frames", 4), (2, "bytes", 4), (4, "toc", 100), (8, "quality", 4)):
            if flags & bit:
                found[name] = data[i : i + n] if name == "toc" else number(i, n)
                i += n
        if data[i : i + 4].strip(b"\0") and i + 24 <= at + head.size:
            found["encoder"] = data[i : i + 9].rstrip(b"\0").decode("latin-1")
            found["delay"], found["padding"] = number(i + 21, 3) >> 12, number(i + 21, 3) & 0xFFF
        return found
    i = at + 36
    if data[i : i + 4] == b"VBRI":
        entries, scale, width, every = (number(i + k, 2) for k in (18, 20, 22, 24))
        table = [number(i + 26 + k * width, width) * scale for k in range(entries)]
        return {"kind": "VBRI", "delay": number(i + 6, 2), "quality": number(i + 8, 2), "bytes": number(i + 10, 4), "frames": number(i + 14, 4), "frames_per_entry": every, "toc": table}
    return None


def parse(data: bytes) -> dict:
    """Tags, table, frames, payload and faults of a stream.

    Bytes that are no frame are skipped until a header that another header, a tag or the end of the data
    follows. Checksums of Layer III and Layer I are verified; those of Layer II, which cover bits that only its
    allocation tables tell, are counted as unverified. A frame whose checksum is wrong is counted and its main data is left out.
    """
    tags, at = read_tags(data)
    found = {"tags": tags, "vbr": None, "skipped": 0, "bad_checksums": 0, "unverified": 0, "frames": 0}
    offsets, payload, samples_by_rate, bits = [], [], {}, 0
    view = np.frombuffer(data, np.uint8)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    while at < end:
        head = header_at(data, at)
        beyond = at + head.size if head else at
        if head is None or beyond > end or (beyond < end and header_at(data, beyond) is None):
            beyond = data.find(b"\xff", at + 1, end)
            beyond = end if beyond < 0 else beyond
            found["skipped"] += beyond - at
            at = beyond
            continue
        if not offsets and found["vbr"] is None and (table := read_table(data, at, head)):
            found["vbr"], found["audio_start"] = table, at
            at = beyond
            continue
        size = head.size
        run = (end - at) // size
        rows = view[at : at + run * size].reshape(run, size)
        same = (rows[:, :4] == rows[0, :4]).all(axis=1)
        run = run if same.all() else int(np.argmin(same))
        rows = rows[:run]
        offsets.append(at + size * np.arange(run))
        samples_by_rate[head.rate] = samples_by_rate.get(head.rate, 0) + run * head.samples
        bits += run * head.kbit
        start = 6 if head.checksum else 4
        side = head.side
        main = np.full(run, (size - start - side) * 8)
        if side == 17 and head.version == 1:
            wide = rows[:, start : start + side].astype(np.int64)
            main = ((wide[:, 2] & 0x3F) << 6 | wide[:, 3] >> 2) + ((wide[:, 9] & 7) << 9 | wide[:, 10] << 1 | wide[:, 11] >> 7)
        good = np.ones(run, bool)
        if head.checksum and head.layer == 2:
            found["unverified"] += run
        elif head.checksum:
            covered = side if head.layer == 3 else 16 if head.alone else 32
            keys = np.concatenate([rows[:, 2:4], rows[:, start : start + covered]], axis=1)
            if (keys == keys[0]).all():
                wanted = np.full(run, _checked(keys[0].tobytes()))
            else:
                wanted = np.array([_checked(k.tobytes()) for k in keys])
            good = wanted == (rows[:, 4].astype(int) << 8 | rows[:, 5])
            found["bad_checksums"] += int((~good).sum())
        n = main // 8
        if good.all() and (n == n[0]).all():
            payload.append(rows[:, start + side : start + side + int(n[0])].tobytes())
        else:
            payload += [r[start + side : start + side + k].tobytes() for r, k in zip(rows[good], n[good].tolist())]
        at += run * size
    offsets = np.concatenate(offsets) if offsets else np.zeros(0, np.int64)
    seconds = {rate: n for rate, n in sorted(samples_by_rate.items())}
    return found | {"frames": len(offsets), "offsets": offsets, "samples": seconds, "duration_us": sum(n * 1_000_000 // rate for rate, n in seconds.items()), "kbit": bits, "payload": b"".join(payload)}


def seek(offsets: np.ndarray, ms: int) -> int:
    """Offset of the frame that plays at ms, of 24 ms frames."""
    return int(offsets[min(max(ms // 24, 0), len(offsets) - 1)])


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """docs with a binary column: the MPEG stream of each whole text's UTF-8 bytes.

    A null text is empty; its stream holds one unit of zeros. Equal texts give equal streams. Very long texts
    give long streams. A column of that name is replaced; an empty table gives no rows.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few enough rows at a time for 32-bit offsets
            lo, held, streams = 0, 0, []
            for i, b in enumerate(text_bytes(batch.column(text))):
                streams.append(write(b))
                held += len(streams[-1])
                if held > MOST_BYTES or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, len(streams)).columns, pa.array(streams, pa.binary())], names=[*batch.schema.names, media])
                    lo, held, streams = i + 1, 0, []

    docs = docs.drop(media)
    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(media, BinaryType())]))


def probe(docs: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """Facts of each stream, from its bytes alone: length, payload digests, exact duration, frames, seek offsets, faults.

    A null or empty stream has no frames and an empty payload. Repeated rows give repeated results.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                data = data or b""
                x = parse(data)
                pay, off, vbr = x["payload"], x["offsets"].astype("<i8"), x["vbr"] or {}
                exact = vbr.get("frames") == x["frames"] and vbr.get("bytes") == len(data) - x.get("audio_start", 0)
                feature = f"frames={x['frames']};us={x['duration_us']};kbps={x['kbit'] / max(1, x['frames']):.3f};table={'ok' if exact else 'bad'};crc_bad={x['bad_checksums']};skipped={x['skipped']};seek={zlib.crc32(off.tobytes()):08x}"
                n = x["tags"].get("n_bytes", "")
                rows.append((int(n) if n.isdigit() else len(pay), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, x["duration_us"], off))
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "duration_us", "seek_offsets"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", *names])

    schema = f"doc_id {dict(docs.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, seek_offsets array<long>"
    return docs.select(F.col(key).alias("doc_id"), media).mapInArrow(run, schema)


def op9_mpeg(spark, sf_dir: str) -> DataFrame:
    """Streams are written to a table in the shared folder, with their seek offsets computed from what is read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return probe(written(with_media(docs).select("doc_id", "media"), "media", "zstd"))
