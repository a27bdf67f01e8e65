"""Media columns: MPEG audio.

`pack` stores bytes losslessly in an MPEG-1 Layer III stream: an ID3v2 tag, a frame with a variable-bitrate (Xing) table
and audio frames with a CRC, whose side information describes silence and whose main-data area carries the payload as
ancillary bytes. Frames use the highest bitrate until the last, which takes the smallest that holds the rest.

`parse` reads streams of MPEG-1, 2 and 2.5, Layers I to III (bitrates by index, not free format). It reads ID3v2.2 to 2.4
tags (plain and synchsafe sizes, unsynchronisation, extended headers, footers), ID3v1 and APE tags and Xing, Info and VBRI
tables, checks each protected frame's CRC-16 over what its layer protects, and returns exact duration (samples over rate)
and the byte offset of every frame. Out of sync, a header counts only if another one of the same stream, a tag or the end
follows where its length says and its checksum, if any, is right, so sync words inside junk or payload do not mislead it; in sync, a header of the same
stream counts as well if its checksum is right or it has none, so a frame before damage is not lost.

The query's feature string, derived from the columns of `described`, holds frames, duration in samples and microseconds,
bad checksums, resynchronisations, the table's frame and byte counts and a digest of the seek offsets.

Scale: one scan, no shuffle; Python works on Arrow batches of at most BATCH_BYTES (a longer text is a batch of its own),
so memory is a few times the longest text. Defined cases: null text is empty text; empty text is 64 zero bytes; equal
texts give equal values; a stream without frames has duration 0 and an empty payload; a last frame that is cut off is no
frame; ids may have any type; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.llm.common import BATCH_BYTES, bounded_batches, slices, table

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index for MPEG-1 Layers I, II and III and for MPEG-2 Layer I and
# Layers II and III; sampling rates, of which MPEG-2 has half and MPEG-2.5 a quarter.
BITRATES_1_I = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
BITRATES_1_II = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_2_I = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
BITRATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)
SAMPLES = 1152
#: Side information of Layer III in MPEG-1 and MPEG-2: mono, otherwise.
SIDE_MONO, SIDE_STEREO, SIDE_MONO_2, SIDE_STEREO_2 = 17, 32, 9, 17
#: Layer II: bits of an allocation by subband, as (subbands, bits).
ALLOCATION_LOW_44 = ((2, 4), (6, 3))
ALLOCATION_LOW_32 = ((2, 4), (10, 3))
ALLOCATION_27 = ((11, 4), (12, 3), (4, 2))
ALLOCATION_30 = ((11, 4), (12, 3), (7, 2))
ALLOCATION_2 = ((4, 4), (7, 3), (19, 2))
CRC_POLY, CRC_START = 0x8005, 0xFFFF
UNIT = 64
XING_FRAMES, XING_BYTES, XING_TOC, XING_QUALITY = 1, 2, 4, 8
OWNER = b"payload-length"


def frame_length(bitrate_index: int, rate_index: int, padding: int) -> int:
    return 144000 * BITRATES[bitrate_index] // RATES[rate_index] + padding


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ CRC_POLY if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes, start: int = CRC_START) -> int:
    c = start
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


def _word(bitrate_index: int, protected: bool = True) -> bytes:
    # sync, MPEG-1, Layer III, CRC follows; 44.1 kHz, no padding; mono
    return bytes((0xFF, 0xFA if protected else 0xFB, bitrate_index << 4, 0xC0))


def _frames() -> dict[int, bytes]:
    """By bitrate index, the bytes before the main data: header, CRC, side information of silence."""
    out = {}
    for i in range(1, len(BITRATES)):
        side = bytes(SIDE_MONO)
        head = _word(i)
        out[i] = head + struct.pack(">H", crc16(head[2:] + side)) + side
    return out


_HEADS = _frames()
_ROOM = {i: frame_length(i, 0, 0) - len(h) for i, h in _HEADS.items()}
_TOP = len(BITRATES) - 1


def _synchsafe(n: int) -> bytes:
    return bytes(((n >> 21) & 127, (n >> 14) & 127, (n >> 7) & 127, n & 127))


def _id3(n_payload: int) -> bytes:
    body = OWNER + b"\0" + struct.pack(">Q", n_payload)
    frame = b"PRIV" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame


def pack(payload: bytes) -> bytes:
    """The payload as a stream that `parse` gives back."""
    tag = _id3(len(payload))
    room, n = _ROOM[_TOP], len(payload)
    n_full, rest = divmod(n, room)
    last = next((i for i in range(1, _TOP + 1) if _ROOM[i] >= rest), _TOP) if rest else 0
    size_top, size_last = frame_length(_TOP, 0, 0), frame_length(last, 0, 0) if last else 0
    first = frame_length(5, 0, 0)
    audio = n_full * size_top + size_last
    n_frames = n_full + bool(last)
    total = first + audio
    toc = bytes(min(255, (first + (i * n_frames // 100) * size_top) * 256 // total) for i in range(100))
    xing = _word(5, protected=False) + bytes(SIDE_MONO) + b"Xing" + struct.pack(">III", XING_FRAMES | XING_BYTES | XING_TOC, n_frames, total) + toc
    head = _HEADS[_TOP]
    parts = [tag, xing.ljust(first, b"\0")]
    for at in range(0, n_full * room, room):
        parts += (head, payload[at : at + room])
    if last:
        parts.append((_HEADS[last] + payload[n_full * room :]).ljust(size_last, b"\0"))
    return b"".join(parts)


@dataclass
class Stream:
    payload: bytes = b""
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    bad_crc: int = 0
    resyncs: int = 0
    tags: dict = field(default_factory=dict)
    table: dict = field(default_factory=dict)

    @property
    def duration_us(self) -> int:
        return self.samples * 1_000_000 // self.rate if self.rate else 0


@dataclass(frozen=True)
class Head:
    """A frame header. kind: what all frames of a stream share (version, layer, sampling rate)."""

    length: int
    samples: int
    rate: int
    kind: tuple[int, int, int]
    kbit: int
    mode: int
    extension: int
    protected: bool

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def before(self) -> int:
        return 6 if self.protected else 4

    @property
    def side(self) -> int:
        if self.kind[1] != 1:
            return 0
        if self.kind[0] == 3:
            return SIDE_MONO if self.mono else SIDE_STEREO
        return SIDE_MONO_2 if self.mono else SIDE_STEREO_2


@lru_cache(maxsize=4096)
def _head(word: bytes) -> Head | None:
    version, layer = word[1] >> 3 & 3, word[1] >> 1 & 3
    index, rate_index, padding = word[2] >> 4, word[2] >> 2 & 3, word[2] >> 1 & 1
    if version == 1 or layer == 0 or index in (0, 15) or rate_index == 3 or word[3] & 3 == 2:
        return None
    one = version == 3
    kbit = ((BITRATES_1_I if one else BITRATES_2_I) if layer == 3 else BITRATES_2 if not one else BITRATES_1_II if layer == 2 else BITRATES)[index]
    rate = RATES[rate_index] // {3: 1, 2: 2, 0: 4}[version]
    if layer == 3:
        length, samples = (12_000 * kbit // rate + padding) * 4, 384
    else:
        samples = 1152 if layer == 2 or one else 576
        length = samples * 125 * kbit // rate + padding
    out = Head(length, samples, rate, (version, layer, rate), kbit, word[3] >> 6, word[3] >> 4 & 3, not word[1] & 1)
    return out if length >= out.before + out.side else None


def _head_at(data: bytes, at: int) -> Head | None:
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] < 0xE0:
        return None
    return _head(data[at : at + 4])


def _allocation(head: Head) -> list[int]:
    """Layer II: bits of the allocation of every subband."""
    each = head.kbit // (1 if head.mono else 2)
    if head.kind[0] != 3:
        groups = ALLOCATION_2
    elif each <= 48:
        groups = ALLOCATION_LOW_32 if head.rate == 32000 else ALLOCATION_LOW_44
    else:
        groups = ALLOCATION_27 if head.rate == 48000 or each <= 80 else ALLOCATION_30
    return [bits for n, bits in groups for _ in range(n)]


def protected_bits(data: bytes, at: int, head: Head) -> int:
    """How many bits after the CRC it protects: side information (III), allocations (I), allocations and selections of
    scale factors (II)."""
    layer, channels = head.kind[1], 1 if head.mono else 2
    if layer == 1:
        return head.side * 8
    bound = 4 * (head.extension + 1) if head.mode == 1 else 32
    if layer == 3:
        return 4 * sum(channels if sb < bound else 1 for sb in range(32))
    bits = int.from_bytes(data[at + 6 : at + 6 + 64].ljust(64, b"\0"), "big")
    used, selections = 0, 0
    for sb, width in enumerate(_allocation(head)):
        for _ in range(channels if sb < bound else 1):
            said = bits >> (512 - used - width) & ((1 << width) - 1)
            used += width
            selections += (2 if sb < bound else 2 * channels) if said else 0
    return used + selections


def crc_of(data: bytes, at: int, head: Head) -> int:
    """The checksum that the frame should have."""
    n = protected_bits(data, at, head)
    c = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n // 8])
    if n % 8:
        last = data[at + 6 + n // 8] if at + 6 + n // 8 < len(data) else 0
        for k in range(n % 8):
            top = (c >> 15) ^ (last >> (7 - k) & 1)
            c = (c << 1 & 0xFFFF) ^ (CRC_POLY if top else 0)
    return c


def _number(data: bytes, bits: int = 8) -> int:
    out = 0
    for b in data:
        out = out << bits | b & (1 << bits) - 1
    return out


def _synchronised(data: bytes) -> bytes:
    return data.replace(b"\xff\0", b"\xff")


def _id3v2(data: bytes, at: int, out: Stream) -> int:
    """Reads the tag at `at`; returns where it ends."""
    version, flags, size = data[at + 3], data[at + 5], _number(data[at + 6 : at + 10], 7)
    end = at + 10 + size
    body = data[at + 10 : end]
    if flags & 0x80 and version < 4:
        body = _synchronised(body)
    width, bits, p = (3, 8, 0) if version == 2 else (4, 7 if version >= 4 else 8, 0)
    if flags & 0x40 and version > 2:
        p = _number(body[:4], bits) + (4 if version == 3 else 0)
    head = 6 if version == 2 else 10
    while p + head <= len(body) and body[p : p + width].strip(b"\0"):
        n = _number(body[p + width : p + 2 * width], bits)
        text, said = body[p + head : p + head + n], body[p + 9] if version >= 4 else 0
        if said & 1:  # a data length stands before the text
            text = text[4:]
        if version >= 4 and (said & 2 or flags & 0x80):
            text = _synchronised(text)
        out.tags.setdefault(body[p : p + width].decode("latin-1"), []).append(text)
        p += head + n
    return min(len(data), end + (10 if version >= 4 and flags & 0x10 else 0))


def _id3v1(data: bytes, at: int, out: Stream) -> int:
    for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97), ("comment", 97, 127), ("genre", 127, 128)):
        out.tags.setdefault(f"v1.{name}", []).append(data[at + a : at + b].split(b"\0")[0] if name != "genre" else data[at + a : at + b])
    return at + 128


def _ape(data: bytes, at: int, out: Stream) -> int:
    size, n, flags = struct.unpack("<III", data[at + 12 : at + 24])
    if not flags & 1 << 29:  # a footer: its items stand before it
        return at + 32
    p = at + 32
    for _ in range(n):
        if p + 8 > len(data) or (end := data.find(b"\0", p + 8)) < 0:
            break
        width = struct.unpack("<I", data[p : p + 4])[0]
        out.tags.setdefault("ape." + data[p + 8 : end].decode("latin-1"), []).append(data[end + 1 : end + 1 + width])
        p = end + 1 + width
    return min(len(data), at + 32 + size)


def _tag(data: bytes, at: int, out: Stream, synced: bool) -> int:
    """Where the tag at `at` ends; `at` if there is none. Out of sync, where names of tags may be payload, only an ID3v1
    tag at the end counts."""
    start = data[at : at + 3]
    if synced and start == b"ID3" and at + 10 <= len(data) and 2 <= data[at + 3] <= 4 and max(data[at + 6 : at + 10]) < 128:
        return _id3v2(data, at, out)
    if start == b"TAG" and at + 128 <= len(data) and (synced or at + 128 == len(data)):
        return _id3v1(data, at, out)
    if synced and start == b"APE" and data[at : at + 8] == b"APETAGEX" and at + 32 <= len(data):
        return _ape(data, at, out)
    return at


def _is_tag(data: bytes, at: int) -> bool:
    return data[at : at + 3] in (b"TAG", b"ID3") or data[at : at + 8] == b"APETAGEX"


def _table(data: bytes, at: int, head: Head) -> dict | None:
    """The variable-bitrate table in the frame at `at`."""
    if head.kind[1] != 1:
        return None
    p = at + head.before + head.side
    if data[p : p + 4] in (b"Xing", b"Info"):
        flags = _number(data[p + 4 : p + 8])
        out: dict = {"kind": data[p : p + 4].decode()}
        p += 8
        for bit, name, size in ((XING_FRAMES, "frames", 4), (XING_BYTES, "bytes", 4), (XING_TOC, "toc", 100), (XING_QUALITY, "quality", 4)):
            if flags & bit:
                out[name] = list(data[p : p + size]) if name == "toc" else _number(data[p : p + size])
                p += size
        return out
    p = at + 36
    if data[p : p + 4] == b"VBRI" and p + 26 <= len(data):
        _, _, quality, size, frames, entries, scale, width, each = struct.unpack(">HHHIIHHHH", data[p + 4 : p + 26])
        steps = [_number(data[p + 26 + k * width : p + 26 + (k + 1) * width]) * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "toc": steps, "frames_per_entry": each}
    return None


def parse(data: bytes) -> Stream:
    out = Stream()
    n, at = len(data), 0
    known: dict[bytes, int] = {}
    parts, synced, kind = [], True, None
    while at + 4 <= n:
        if (end := _tag(data, at, out, synced)) > at:
            at = end
            continue
        head = _head_at(data, at)
        right = None
        if head is not None and at + head.length <= n:
            after = at + head.length
            following = _head_at(data, after)
            ok = after == n or _is_tag(data, after) or (following is not None and following.kind == head.kind)
            if head.protected:
                if head.kind[1] == 1:  # the same side information again and again
                    covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + head.side]
                    if (want := known.get(covered)) is None:
                        want = known[covered] = crc_of(data, at, head)
                else:
                    want = crc_of(data, at, head)
                right = want == data[at + 4] << 8 | data[at + 5]
            if right is not False:
                ok = ok or (synced and head.kind == kind)
            else:
                ok = ok and synced
        else:
            ok = False
        if not ok:
            out.resyncs += synced
            synced = False
            at = _next(data, at + 1)
            if at < 0:
                break
            continue
        synced, kind = True, head.kind
        out.rate = head.rate
        if not out.offsets and not out.table and (found := _table(data, at, head)) is not None:
            out.table = found
        else:
            out.bad_crc += right is False
            out.offsets.append(at)
            out.samples += head.samples
            parts.append(data[at + head.before + head.side : at + head.length])
        at += head.length
    payload = b"".join(parts)
    sizes = [x for x in out.tags.get("PRIV", []) if x.startswith(OWNER + b"\0")]
    out.payload = payload[: struct.unpack(">Q", sizes[0][len(OWNER) + 1 :])[0]] if sizes else payload
    return out


_START = re.compile(rb"\xff[\xe0-\xff]|TAG")


def _next(data: bytes, at: int) -> int:
    """Where a frame or a tag may begin, or -1."""
    m = _START.search(data, at)
    return m.start() if m else -1


def features() -> Column:
    """The feature string, from the columns of `described`."""
    offsets = F.array_join(F.transform("offsets", lambda x: F.lpad(F.hex(x), 16, "0")), "")
    named = [("frames", F.col("n_frames")), ("samples", F.col("samples")), ("us", F.col("duration_us")), *((c, F.col(c)) for c in ("bad_crc", "resyncs", "vbr_frames", "vbr_bytes")), ("seek", F.md5(F.unhex(offsets)))]
    return F.concat_ws(";", *[F.concat(F.lit(f"{k}="), v.cast("string")) for k, v in named])


def padded(raw: bytes) -> bytes:
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT))


DESCRIBED = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, duration_us long, n_frames long, samples long, rate long, offsets array<long>, bad_crc long, resyncs long, vbr_frames long, vbr_bytes long"
_DESCRIBED = [(n, {"string": pa.string(), "array<long>": pa.list_(pa.int64())}.get(t, pa.int64())) for n, t in (x.split(" ") for x in DESCRIBED.split(", "))]


def _id_type(df: DataFrame) -> str:
    return f"doc_id {df.schema['doc_id'].dataType.simpleString()}"


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as a stream."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            sizes = pc.binary_length(texts.fill_null(b"")).to_numpy().astype(np.int64)
            for i, j in slices(np.concatenate(([0], np.cumsum(sizes))), BATCH_BYTES):
                media = [pack(padded(texts[k].as_py() or b"")) for k in range(i, j)]
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(sizes[i:j]), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, f"{_id_type(docs)}, n_bytes long, media binary")


def described(media: DataFrame) -> DataFrame:
    """Reads stored streams: payload digests, exact duration (samples over rate), the byte offset of every frame, bad
    checksums, resynchronisations and the counts of the table."""
    bounded_batches(media.sparkSession)

    def run(batches):
        for batch in batches:
            rows: list[tuple] = []
            for data in batch.column(2):
                data = data.as_py() or b""
                s = parse(data)
                rows.append((len(s.payload), hashlib.sha256(s.payload).hexdigest(), zlib.crc32(s.payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), s.duration_us, len(s.offsets), s.samples, s.rate, s.offsets, s.bad_crc, s.resyncs, s.table.get("frames", 0), s.table.get("bytes", 0)))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, (_, t) in zip(zip(*rows), _DESCRIBED))], ["doc_id", "n_bytes", *(n for n, _ in _DESCRIBED)])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"{_id_type(media)}, n_bytes long, {DESCRIBED}")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = described(stored(table(spark, sf_dir, "documents")))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", features().alias("feature"), "duration_us", "n_frames")


def media_sql() -> str:
    """The same in DuckDB: the streams are put together from hex digits, the features follow from their layout."""
    tops = range(1, _TOP + 1)
    top, first = frame_length(_TOP, 0, 0), frame_length(5, 0, 0)
    pick = lambda values: "CASE " + " ".join(f"WHEN last = {i} THEN {v}" for i, v in zip(tops, values)) + " END"
    tag, xing = _id3(0)[:-8].hex(), (_word(5, protected=False) + bytes(SIDE_MONO) + b"Xing" + struct.pack(">I", XING_FRAMES | XING_BYTES | XING_TOC)).hex()
    at = len(_id3(0)) + first
    return f"""
WITH t AS (SELECT list_transform(range(256), lambda k: list_reduce([k] || range(8), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc),
d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, length(h) // 2 AS n_bytes, h || repeat('00', CASE WHEN h = '' THEN {UNIT} ELSE CAST((-(length(h) // 2)) % {UNIT} + {UNIT} AS INT) % {UNIT} END) AS h FROM d),
f AS (SELECT *, length(h) // 2 AS n, length(h) // 2 // {_ROOM[_TOP]} AS n_full, length(h) // 2 % {_ROOM[_TOP]} AS rest FROM p),
g AS (SELECT *, CASE WHEN rest = 0 THEN 0 {" ".join(f"WHEN rest <= {_ROOM[i]} THEN {i}" for i in tops)} END AS last FROM f),
s AS (SELECT *, n_full + (last > 0)::INT AS n_frames, {first} + n_full * {top} + coalesce({pick(frame_length(i, 0, 0) for i in tops)}, 0) AS total FROM g),
m AS (SELECT *, '{tag}' || lpad(hex(n), 16, '0')
    || rpad('{xing}' || lpad(hex(n_frames), 8, '0') || lpad(hex(total), 8, '0') || array_to_string(list_transform(range(100), lambda i: lpad(hex(least(255, ({first} + (i * n_frames // 100) * {top}) * 256 // total)), 2, '0')), ''), {2 * first}, '0')
    || array_to_string(list_transform(range(n_full), lambda i: '{_HEADS[_TOP].hex()}' || substr(h, CAST(2 * i * {_ROOM[_TOP]} + 1 AS BIGINT), {2 * _ROOM[_TOP]})), '')
    || CASE WHEN last = 0 THEN '' ELSE rpad({pick(f"'{_HEADS[i].hex()}'" for i in tops)} || substr(h, CAST(2 * n_full * {_ROOM[_TOP]} + 1 AS BIGINT)), CAST(2 * {pick(frame_length(i, 0, 0) for i in tops)} AS INT), '0') END AS media FROM s)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(n AS BIGINT) AS payload_bytes, sha256(unhex(h)) AS payload_sha256,
  CAST(xor(list_reduce([4294967295] || list_transform(range({UNIT}), lambda i: 16 * (instr('0123456789ABCDEF', substr(h, CAST(length(h) - {2 * UNIT} + 2 * i + 1 AS BIGINT), 1)) - 1) + instr('0123456789ABCDEF', substr(h, CAST(length(h) - {2 * UNIT} + 2 * i + 2 AS BIGINT), 1)) - 1),
    lambda c, x: xor(c >> 8, t.crc[1 + (xor(c, x) & 255)])), 4294967295) AS BIGINT) AS tail_crc32,
  CAST(length(media) // 2 AS BIGINT) AS media_bytes, sha256(unhex(media)) AS media_sha256,
  'frames=' || n_frames || ';samples=' || n_frames * {SAMPLES} || ';us=' || n_frames * {SAMPLES} * 1000000 // {RATES[0]} || ';bad_crc=0;resyncs=0;vbr_frames=' || n_frames || ';vbr_bytes=' || total
    || ';seek=' || md5(unhex(array_to_string(list_transform(range(n_frames), lambda i: lpad(hex({at} + i * {top}), 16, '0')), ''))) AS feature,
  CAST(n_frames * {SAMPLES} * 1000000 // {RATES[0]} AS BIGINT) AS duration_us, CAST(n_frames AS BIGINT) AS n_frames
FROM m, t"""


QUERIES = {"op5_media": op5_media}
ORACLE = {"op5_media": media_sql()}
