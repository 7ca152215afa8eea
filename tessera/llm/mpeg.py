"""A media column of MPEG audio: writing payloads into frames, and reading streams frame by frame.

`store` makes one MPEG-1 layer III stream (mono, 48 kHz, 224 kbit/s, protected by checksums) of each
text: an ID3v2.4 tag, a frame with a `Xing` table of the stream's frames, bytes and seek points, then
one frame of 672 bytes for each 576 bytes of payload.  The side information declares no
coded samples, so that all main data is ancillary: players hear silence, and the payload is kept
bit by bit.  `read` takes any bytes: it skips and parses tags, reads `Xing`, `Info` and `VBRI` tables, finds
frame headers again after foreign bytes, verifies checksums, and gives exact durations and the offset of every frame.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import column_bytes, slices

UNIT = 576
_FRAME, _SIDE = 672, 17
_HEADER = bytes([0xFF, 0xFA, 0xC4, 0xC0])

#: Fixed values of the format: kbit/s by bitrate index for MPEG-1 layers I, II, III and MPEG-2 layers I, II and III.
_RATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448, -1),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384, -1),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, -1),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256, -1),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, -1),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160, -1),
}
#: Fixed values of the format: samples a second by index, MPEG-1; MPEG-2 has half of it, MPEG-2.5 a quarter.
_HERTZ = (44100, 48000, 32000)
#: Parts of a second in which the samples of every rate, and of its half and quarter, are whole: the rates' least common multiple.
TICKS = 14_112_000
#: Bytes of texts or streams that a worker turns into one Arrow batch; a larger one makes a batch by itself.
BATCH_BYTES = 32 << 20


def _lengths() -> tuple[np.ndarray, ...]:
    """By the 16 bits after the first 8 of a header (its second and third byte): frame length, samples, rate; 0 where it is no header."""
    length, samples, rate = np.zeros((3, 1 << 16), np.int32)
    for version, half in ((3, 1), (2, 2), (0, 4)):
        for layer in (1, 2, 3):
            for bits in range(256):
                kbit = _RATES[(1 if half == 1 else 2, layer)][bits >> 4]
                if kbit <= 0 or bits >> 2 & 3 == 3:
                    continue
                hertz = _HERTZ[bits >> 2 & 3] // half
                count = 384 if layer == 1 else 576 if layer == 3 and half > 1 else 1152
                pad = bits >> 1 & 1
                size = (12 * kbit * 1000 // hertz + pad) * 4 if layer == 1 else count // 8 * kbit * 1000 // hertz + pad
                for protection in (0, 1):
                    at = (0xE0 | version << 3 | (4 - layer) << 1 | protection) << 8 | bits
                    length[at], samples[at], rate[at] = size, count, hertz
    return length, samples, rate


_LENGTH, _SAMPLES, _RATE = _lengths()


def _crc_table() -> np.ndarray:
    """CRC-16 with the polynomial x^16 + x^15 + x^2 + 1, high bits first."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


_CRC = _crc_table()


def frame_checksums(rows: np.ndarray) -> np.ndarray:
    """The checksum of each row of protected bytes: the header's last two and the side information."""
    state = np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        state = (state << 8 & 0xFFFF) ^ _CRC[(state >> 8) ^ column]
    return state


_PREFIX = _HEADER + int(frame_checksums(np.frombuffer(_HEADER[2:] + bytes(_SIDE), np.uint8)[None])[0]).to_bytes(2, "big") + bytes(_SIDE)


def _synchsafe(n: int) -> bytes:
    return bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127])


def _tag(unpadded: int) -> bytes:
    body = b"\x03bytes\x00" + str(unpadded).encode()
    frame = b"TXXX" + _synchsafe(len(body)) + b"\x00\x00" + body
    return b"ID3\x04\x00\x00" + _synchsafe(len(frame)) + frame


def padded(text: bytes) -> bytes:
    """`text` with bytes 255 up to a positive multiple of 576."""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def write_stream(text: bytes) -> bytes:
    """The stream that holds padded(text)."""
    payload = np.frombuffer(padded(text), np.uint8).reshape(-1, UNIT)
    count = len(payload)
    frames = np.zeros((count, _FRAME), np.uint8)
    frames[:, : len(_PREFIX)] = np.frombuffer(_PREFIX, np.uint8)
    frames[:, len(_PREFIX) : len(_PREFIX) + UNIT] = payload
    size = (count + 1) * _FRAME
    points = bytes((256 * (1 + k * count // 100) * _FRAME // size) for k in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + count.to_bytes(4, "big") + size.to_bytes(4, "big") + points + (100).to_bytes(4, "big")
    return _tag(len(text)) + (_PREFIX + table).ljust(_FRAME, b"\x00") + frames.tobytes()


def _skip_tag(stream: bytes) -> tuple[int, int | None]:
    """Where an ID3v2 tag at the start ends, and the byte count that it tells."""
    if len(stream) < 10 or stream[:3] != b"ID3" or max(stream[6:10]) > 127:
        return 0, None
    size = stream[6] << 21 | stream[7] << 14 | stream[8] << 7 | stream[9]
    at, end, told = 10, min(10 + size, len(stream)), None
    while at + 10 <= end and stream[at : at + 4].strip(b"\x00"):
        n = stream[at + 4] << 21 | stream[at + 5] << 14 | stream[at + 6] << 7 | stream[at + 7]
        body = stream[at + 10 : at + 10 + n]
        if stream[at : at + 4] == b"TXXX" and body[:7] == b"\x03bytes\x00" and body[7:].isdigit():
            told = int(body[7:])
        at += 10 + n
    return end, told


def _frame_length(data: np.ndarray, at: int) -> int:
    return int(_LENGTH[int(data[at + 1]) << 8 | int(data[at + 2])])


def frame_offsets(data: np.ndarray, at: int, end: int) -> tuple[list[int], int]:
    """Offsets of the frames in data[at:end], and how often headers had to be found again.

    A place is a frame if its header is valid and a valid header, or the end, follows its frame; or if it
    follows a frame itself and holds no such place.
    """
    window = data[at:end]
    places = np.flatnonzero(window[:-3] == 0xFF) if len(window) > 3 else np.zeros(0, np.int64)
    size = _LENGTH[window[places + 1].astype(np.int64) << 8 | window[places + 2]]
    places, size = places[size > 0], size[size > 0]
    lengths = np.zeros(len(window) + 1, np.int32)
    lengths[places] = size
    after = places + size
    good = (after == len(window)) | ((after < len(window)) & (lengths[np.minimum(after, len(window))] > 0))
    starts = places[good]
    out, lost, here, k = [], 0, 0, 0
    while k < len(starts):
        if starts[k] == here or out and lengths[here] and here + lengths[here] <= starts[k]:
            k += int(starts[k] == here)
        else:
            lost, here, k = lost + 1, int(starts[k]), k + 1
        out.append(at + here)
        here += int(lengths[here])
        while k < len(starts) and starts[k] < here:
            k += 1
    if out and here < len(window) and lengths[here] and here + lengths[here] <= len(window):
        out.append(at + here)
    return out, lost


def _int(stream: bytes, at: int, width: int) -> int:
    return int.from_bytes(stream[at : at + width], "big")


def read_table(stream: bytes, frame: int, main: int) -> dict | None:
    """The table of the frame at `frame`, whose main data starts at `main`; null if it has none.

    Keys: table (its name), table_frames, table_bytes, table_quality (null where it is left out) and seek_points: bytes
    from the frame's start to the places that the table names, which divide the stream's time evenly.
    """
    out = {"table": None, "table_frames": None, "table_bytes": None, "table_quality": None, "seek_points": []}
    if stream[main : main + 4] in (b"Xing", b"Info"):
        flags, at = _int(stream, main + 4, 4), main + 8
        for bit, name in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                out[name], at = _int(stream, at, 4), at + 4
        if flags & 4:
            out["seek_points"], at = [x * (out["table_bytes"] or 0) // 256 for x in stream[at : at + 100]], at + 100
        if flags & 8:
            out["table_quality"] = _int(stream, at, 4)
        return out | {"table": stream[main : main + 4].decode()}
    at = frame + 36  # always behind 32 bytes, whatever the side information's size
    if stream[at : at + 4] == b"VBRI":
        out |= {"table": "VBRI", "table_quality": _int(stream, at + 8, 2), "table_bytes": _int(stream, at + 10, 4), "table_frames": _int(stream, at + 14, 4)}
        entries, scale, width = (_int(stream, at + k, 2) for k in (18, 20, 22))
        if 1 <= width <= 4:
            entries = min(entries, (len(stream) - at - 26) // width)
            out["seek_points"] = (np.cumsum([_int(stream, at + 26 + k * width, width) for k in range(entries)]) * scale).astype(np.int64).tolist()
        return out
    return None


def seek_runs(offsets: list[int]) -> str:
    """All offsets as runs of equal steps, `first+step*count` each, joined by commas: 10, 20, 30, 37 is `10+10*3,37+0*1`."""
    places, out, k = np.array(offsets, np.int64), [], 0
    ends = np.append(np.flatnonzero(np.diff(places, 2)) + 1, len(places) - 1) if len(places) else []
    for end in map(int, ends):
        if end >= k:
            out.append(f"{places[k]}+{places[k + 1] - places[k] if end > k else 0}*{end - k + 1}")
            k = end + 1
    return ",".join(out)


def read_stream(stream: bytes) -> dict:
    """What a stream holds.

    Keys: payload (the first 576 bytes of main data of each frame but the table's), told (the tag's
    byte count or null), offsets (of the frames that sound), seek (the same as seek_runs), samples, hertz (the first
    frame's), ticks (the duration in 1/14,112,000 of a second, exact also if rates change), those of read_table
    (null or empty without a table), checksums_good, checksums_bad, found_again.
    """
    data = np.frombuffer(stream, np.uint8)
    at, told = _skip_tag(stream)
    end = len(stream)
    offsets, lost = frame_offsets(data, at, end)
    if end - at >= 128 and stream[-128:-125] == b"TAG" and not (offsets and offsets[-1] + _frame_length(data, offsets[-1]) == end):
        end -= 128  # a tag at the end, and not the inside of a last frame
        offsets, lost = frame_offsets(data, at, end)
    out = {"payload": b"", "told": told, "offsets": offsets, "seek": "", "samples": 0, "hertz": 0, "ticks": 0, "checksums_good": 0, "checksums_bad": 0, "found_again": lost}
    out |= {"table": None, "table_frames": None, "table_bytes": None, "table_quality": None, "seek_points": []}
    if not offsets:
        return out
    places = np.array(offsets)
    kind = data[places + 1].astype(np.int64) << 8 | data[places + 2]
    first = kind >> 11 & 3 == 3
    mono = data[places + 3] >> 6 == 3
    layer3 = kind >> 9 & 3 == 1
    side = np.where(layer3, np.where(first, np.where(mono, 17, 32), np.where(mono, 9, 17)), 0)
    guarded = (kind >> 8 & 1) == 0
    for width in np.unique(side[guarded & layer3]).tolist():
        chosen = places[guarded & layer3 & (side == width)]
        chosen = chosen[chosen + 6 + width <= end]
        rows = data[chosen[:, None] + np.r_[2, 3, 6 : 6 + width]]
        right = frame_checksums(rows) == (data[chosen + 4].astype(np.uint32) << 8 | data[chosen + 5])
        out["checksums_good"] += int(right.sum())
        out["checksums_bad"] += int((~right).sum())
    main = places + 4 + 2 * guarded + side
    table = read_table(stream, int(places[0]), int(main[0]))
    if table:
        out |= table
        places, main, kind = places[1:], main[1:], kind[1:]
    out["offsets"] = places.tolist()
    out["seek"] = seek_runs(out["offsets"])
    out["samples"] = int(_SAMPLES[kind].sum())
    out["ticks"] = int((_SAMPLES[kind].astype(np.int64) * (TICKS // _RATE[kind])).sum())
    out["hertz"] = int(_RATE[kind[0]]) if len(kind) else 0
    if len(main):
        main = main[main + UNIT <= end]
        steps = np.diff(main)
        if len(steps) and (steps == steps[0]).all() or len(main) == 1:
            step = int(steps[0]) if len(steps) else UNIT
            out["payload"] = np.lib.stride_tricks.as_strided(data[main[0] :], (len(main), UNIT), (step, 1)).tobytes()
        else:
            out["payload"] = b"".join(stream[x : x + UNIT] for x in main.tolist())
    return out


def _stored(batches):
    for batch in batches:
        data, offsets = column_bytes(batch.column(1))
        for a, b in slices(offsets, BATCH_BYTES):
            streams = [write_stream(data[x:y].tobytes()) for x, y in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(streams, pa.binary())], ["doc_id", "media"])


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, media) for each row of `docs` (doc_id, text, ...): the text's stream.

    Null and empty texts are stored as one unit of padding.  Equal texts have equal streams.  Rows may
    repeat and doc_id may be null; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_stored, "doc_id long, media binary")


_READ = (
    "doc_id long, n_bytes long, payload binary, media_bytes long, media_sha256 string, samples long, hertz long, ticks long, offsets array<long>, seek string, table string, table_frames long, "
    "table_bytes long, table_quality long, seek_points array<long>, checksums_good long, checksums_bad long, found_again long"
)
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}


def _read(batches):
    columns = [x.split() for x in _READ.split(", ")]
    for batch in batches:
        media = batch.column(1)
        ends = np.cumsum([0, *(len(x.as_buffer()) if x.is_valid else 0 for x in media)])
        for a, b in slices(ends, BATCH_BYTES):
            rows = []
            for stream in media.slice(a, b - a).to_pylist():
                stream = stream or b""
                x = read_stream(stream)
                rows.append(x | {"n_bytes": x.pop("told"), "media_bytes": len(stream), "media_sha256": hashlib.sha256(stream).hexdigest()})
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array([x[k] for x in rows], _ARROW[t]) for k, t in columns[1:])], [k for k, _ in columns])


def read(media: DataFrame) -> DataFrame:
    """What each row's stream (doc_id, media) holds: see read_stream.  A null stream is an empty one: no frames, nulls for what only tags tell."""
    return media.select("doc_id", "media").mapInArrow(_read, _READ)


def digests(streams: DataFrame) -> DataFrame:
    """The payload's and the stream's digests, and the features as one string, from read(): the exact duration, and as `seek` every frame's offset."""
    length = F.length("payload").cast("long")
    tail = F.expr("substring(payload, greatest(length(payload) - 31, 1), 32)")
    seconds = (F.col("ticks") / TICKS).cast("decimal(20,6)")
    features = {k: F.col(k) for k in ("samples", "hertz", "ticks", "table", "table_frames", "table_bytes", "table_quality", "checksums_good", "checksums_bad", "found_again", "seek")}
    features = {"frames": F.size("offsets"), "seconds": seconds} | features | {"points_crc32": F.crc32(F.array_join("seek_points", ","))}
    feature = F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("none"))) for k, v in features.items()))
    return streams.select(
        "doc_id", "n_bytes", length.alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(tail).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature")
    )


def crc32(data: bytes) -> int:
    """As Spark's crc32, for tests."""
    return zlib.crc32(data)
