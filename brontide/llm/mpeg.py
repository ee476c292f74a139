"""Operator 3 - media columns of MPEG audio.

``parse`` reads a stream of Layer III frames: it skips ID3v2 and ID3v1 tags and takes their texts, finds
the next frame where a header and its successor agree, reads the Xing/Info table of a variable-bitrate
stream, verifies the CRC of protected frames, and gives the exact duration in samples and the byte
offset of every frame for seeking. ``encode`` makes such a stream that carries a payload: silent MPEG-2
frames at 16 kHz, of 576 samples each, whose ancillary bytes - those behind an empty main part, which
decoders skip - hold 576 bytes of the payload each; every eighth frame has the next higher bitrate.

The payload is the text as UTF-8 with bytes 255 up to a positive multiple of 576. It is read back from
the stored bytes by the offsets that the parser finds, never taken from the text.

Edge cases: a null or empty text is 576 bytes of 255. Streams that are null, empty or without any frame
have no frames, zero duration and no offsets; a damaged frame is counted and skipped to the next
agreeing pair. Repeated rows give equal values; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brontide.llm.shared import keyed

UNIT, GROUP = 576, 8
#: Fixed values of the format: kbit/s of Layer III by index, for MPEG-1 and for MPEG-2 and 2.5; sampling rates by version bits.
KBITS = {3: (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), 2: (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
_SMALL, _LARGE, _SIDE, _HEAD = 648, 720, 9, 15
_GROUP_BYTES = _SMALL * (GROUP - 1) + _LARGE


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        out = np.where(out & 0x8000, (out << 1) ^ 0x8005, out << 1) & 0xFFFF
    return out


_CRC = _crc_table()


def frame_crc(columns: np.ndarray) -> np.ndarray:
    """CRC-16 of rows of bytes: the header's last two and the side information."""
    crc = np.full(len(columns), 0xFFFF, dtype=np.uint32)
    for j in range(columns.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ _CRC[(crc >> 8) ^ columns[:, j]]
    return crc


def header(b: bytes, at: int) -> tuple[int, int, int, int, bool] | None:
    """Length in bytes, samples, sampling rate, side information's bytes and whether a CRC follows; None if no Layer III header is there."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE6 != 0xE2:
        return None
    version, x = b[at + 1] >> 3 & 3, b[at + 2]
    bits, rate = x >> 4, x >> 2 & 3
    if version == 1 or bits in (0, 15) or rate == 3:
        return None
    hertz = RATES[version][rate]
    first = version == 3
    mono = b[at + 3] >> 6 == 3
    length = (144000 if first else 72000) * KBITS[3 if first else 2][bits] // hertz + (x >> 1 & 1)
    return length, 1152 if first else 576, hertz, (17 if mono else 32) if first else (9 if mono else 17), not b[at + 1] & 1


def _syncsafe(b: bytes) -> int:
    return (b[0] & 127) << 21 | (b[1] & 127) << 14 | (b[2] & 127) << 7 | b[3] & 127


def tags(b: bytes) -> tuple[int, int, dict[str, str]]:
    """Where audio starts and ends, and the texts of ID3v2.3/2.4 frames and the ID3v1 title."""
    start, end, found = 0, len(b), {}
    while b[start : start + 3] == b"ID3" and start + 10 <= len(b):
        size = _syncsafe(b[start + 6 : start + 10])
        at, stop = start + 10, min(len(b), start + 10 + size)
        while at + 10 <= stop and b[at : at + 1].isalpha():
            n = _syncsafe(b[at + 4 : at + 8]) if b[start + 3] == 4 else int.from_bytes(b[at + 4 : at + 8], "big")
            body = b[at + 10 : min(stop, at + 10 + n)]
            if b[at : at + 1] == b"T" and body:
                text = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace")
                name, _, value = text.rstrip("\0").partition("\0") if b[at : at + 4] == b"TXXX" else (b[at : at + 4].decode("latin-1"), "", text.rstrip("\0"))
                found[name] = value
            at += 10 + n
        start = stop
    if end - start >= 128 and b[end - 128 : end - 125] == b"TAG":
        end -= 128
        found["title"] = b[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")
    return start, end, found


def _resync(b: bytes, at: int, end: int) -> int:
    """The next place with a header that another header, or the end, follows; the end if there is none."""
    while True:
        at = b.find(b"\xff", at, end)
        if at < 0:
            return end
        head = header(b, at)
        if head and (at + head[0] == end or at + head[0] < end and header(b, at + head[0])):
            return at
        at += 1


def parse(b: bytes | None) -> dict:
    """offsets (of audio frames), lengths, samples, hertz, bad_crc, skipped bytes, tags and vbr: the table's frames, bytes and seek points, or None."""
    b = b or b""
    at, end, found = tags(b)
    offsets, lengths, starts, guarded = [], [], [], []
    samples = hertz = skipped = 0
    vbr = None
    while at < end:
        head = header(b, at)
        # a header that differs from the stream so far counts only if another one follows its frame
        if head is None or at + head[0] > end or head[2] != hertz and at + head[0] < end and not header(b, at + head[0]):
            to = _resync(b, at + 1, end)
            skipped += to - at
            at = to
            continue
        length, count, hertz, side, crc = head
        if not offsets and vbr is None and b[(x := at + 4 + side + 2 * crc) : x + 4] in (b"Xing", b"Info"):
            flags, x, vbr = b[x + 7], x + 8, {}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    vbr[name] = int.from_bytes(b[x : x + 4], "big")
                    x += 4
            vbr["seek"] = list(b[x : x + 100]) if flags & 4 else []
        else:
            offsets.append(at)
            lengths.append(length)
            starts.append(at + 4 + side + 2 * crc)
            samples += count
            if crc:
                guarded.append((at, side))
        at += length
    bad = 0
    if guarded:
        data = np.frombuffer(b, dtype=np.uint8)
        spots, sides = np.array(guarded).T
        for side in np.unique(sides):
            own = spots[sides == side]
            own = own[own + 6 + side <= len(data)]
            columns = np.concatenate([data[own[:, None] + [2, 3]], data[own[:, None] + 6 + np.arange(side)]], axis=1)
            stored = data[own + 4].astype(np.uint32) << 8 | data[own + 5]
            bad += int((frame_crc(columns) != stored).sum())
    return {"offsets": offsets, "lengths": lengths, "bodies": starts, "samples": samples, "hertz": hertz, "bad_crc": bad, "skipped": skipped, "tags": found, "vbr": vbr}


def _frame_head(bits: int) -> np.ndarray:
    """Header, CRC and silent side information of a protected MPEG-2 mono frame at 16 kHz."""
    head = np.zeros(_HEAD, dtype=np.uint8)
    head[:4] = [0xFF, 0xF2, bits << 4 | 2 << 2, 0xC0]
    crc = int(frame_crc(np.append(head[2:4], head[6:])[None, :])[0])
    head[4:6] = [crc >> 8, crc & 255]
    return head


_HEADS = _frame_head(13), _frame_head(14)


def encode(text: str | None) -> bytes:
    """A stream that carries the text's payload."""
    raw = (text or "").encode()
    n = max(1, -(-len(raw) // UNIT))
    groups = -(-n // GROUP)
    payload = np.full(groups * GROUP * UNIT, 255, dtype=np.uint8)
    payload[: len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    payload = payload.reshape(groups, GROUP, UNIT)
    audio = np.zeros((groups, _GROUP_BYTES), dtype=np.uint8)
    for j in range(GROUP):
        a = j * _SMALL
        audio[:, a : a + _HEAD] = _HEADS[j == GROUP - 1]
        audio[:, a + _HEAD : a + _HEAD + UNIT] = payload[:, j]
    size = n // GROUP * _GROUP_BYTES + n % GROUP * _SMALL
    note = f"bytes\0{len(raw)}".encode()
    body = b"TXXX" + struct.pack(">IH", len(note) + 1, 0) + b"\0" + note
    tag = b"ID3\3\0\0" + bytes(len(body) >> s & 127 for s in (21, 14, 7, 0)) + body
    whole = np.arange(100) * n // 100
    places = _SMALL + whole // GROUP * _GROUP_BYTES + whole % GROUP * _SMALL
    table = (places * 256 // (size + _SMALL)).astype(np.uint8).tobytes()
    first = bytes([0xFF, 0xF3, 13 << 4 | 2 << 2, 0xC0]) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 7, n & 0xFFFFFFFF, (size + _SMALL) & 0xFFFFFFFF) + table
    return tag + first + bytes(_SMALL - len(first)) + audio.reshape(-1)[:size].tobytes()


def payload_of(b: bytes, info: dict) -> bytes:
    """The ancillary bytes of all frames, in the stream's order."""
    data = np.frombuffer(b, dtype=np.uint8)
    starts = np.array(info["bodies"], dtype=np.int64)
    if not len(starts):
        return b""
    return np.lib.stride_tricks.sliding_window_view(data, UNIT)[starts].tobytes()


_MEDIA = "media binary"
_INFO = "n_frames long, samples long, hertz int, duration_us long, bad_crc long, skipped long, offsets array<long>, tags map<string,string>, vbr_frames long, vbr_bytes long, seek array<int>"


def _encoded(batches):
    for batch in batches:
        for a in range(0, batch.num_rows, 256):
            part = batch.slice(a, 256)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([encode(t) for t in part.column(1).to_pylist()], pa.binary())], names=["doc_id", "media"])


def _parsed(batches):
    for batch in batches:
        infos = [parse(b) for b in batch.column(1).to_pylist()]
        vbr = [i["vbr"] or {} for i in infos]
        columns = [
            pa.array([len(i["offsets"]) for i in infos], pa.int64()),
            pa.array([i["samples"] for i in infos], pa.int64()),
            pa.array([i["hertz"] for i in infos], pa.int32()),
            pa.array([i["samples"] * 1_000_000 // i["hertz"] if i["hertz"] else 0 for i in infos], pa.int64()),
            pa.array([i["bad_crc"] for i in infos], pa.int64()),
            pa.array([i["skipped"] for i in infos], pa.int64()),
            pa.array([i["offsets"] for i in infos], pa.list_(pa.int64())),
            pa.array([list(i["tags"].items()) for i in infos], pa.map_(pa.string(), pa.string())),
            pa.array([v.get("frames") for v in vbr], pa.int64()),
            pa.array([v.get("bytes") for v in vbr], pa.int64()),
            pa.array([v.get("seek") for v in vbr], pa.list_(pa.int32())),
        ]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(x.split()[0] for x in _INFO.split(", "))])


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, media: each text of docs as a stream."""
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(_encoded, keyed(docs, _MEDIA))


def audio_columns(media: DataFrame) -> DataFrame:
    """doc_id and what the stream in ``media`` tells: frames, exact duration, checksums, tags, tables and the offset of every frame."""
    media = media.select("doc_id", "media")
    return media.mapInArrow(_parsed, keyed(media, _INFO))


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_us long, n_frames long, tags string, frame_offsets string"


def _digested(batches):
    for batch in batches:
        rows = []
        for b in batch.column(1).to_pylist():
            info = parse(b)
            payload = payload_of(b, info)
            seek = zlib.crc32(np.array(info["offsets"], dtype="<i8").tobytes())
            feature = f"frames={len(info['offsets'])};samples={info['samples']};hertz={info['hertz']};bad_crc={info['bad_crc']};skipped={info['skipped']};vbr_frames={(info['vbr'] or {}).get('frames')};seek_crc32={seek:08x}"
            tags_here = ";".join(f"{k}={v}" for k, v in sorted(info["tags"].items()))
            digests = int(info["tags"]["bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(b), hashlib.sha256(b).hexdigest(), feature
            rows.append((*digests, info["samples"] * 1_000_000 // info["hertz"], len(info["offsets"]), tags_here, ",".join(map(str, info["offsets"]))))
        kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in _DIGEST.split(", ")]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *(x.split()[0] for x in _DIGEST.split(", "))])


def op3_mpeg_audio(spark, sf_dir: str) -> DataFrame:
    """The payload's digests, read back from the stored streams, and what the parser tells of these: exact duration, tags and the offset of every frame."""
    media = to_media(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return media.mapInArrow(_digested, keyed(media, _DIGEST))
