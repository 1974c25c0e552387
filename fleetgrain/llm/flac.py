"""FLAC media columns: bytes as 8-bit mono samples, written losslessly, verified and read back as PCM blocks.

Frames have FRAME samples. Each is written as a constant, by a fixed or linear predictor with Rice-coded residuals in four
partitions, or verbatim, whichever is shortest; it carries its number, a CRC-8 of its header and a CRC-16 of all of it. A seek
table points at every frame, so a reader starts at any sample. The decoder parses headers, checks both CRCs and the MD5 of all
samples, decodes Rice residuals (with escapes and any partition order) and restores fixed and linear predictors of any order. It works
on all frames of a slice at once, sample by sample; streams without a full seek table are followed frame by frame.

PCM blocks are runs of BLOCK samples with the offset of their first, as unsigned bytes.

Nulls: a null text is the empty text. A payload is never empty (padding goes up to a positive multiple of FRAME). Repeated rows
get equal values. A damaged stream raises ValueError. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME = 576
RATE = 8000
PAD = 255
BLOCK = 8 * FRAME
#: Order of the encoder's linear predictor, and bits of its coefficients.
ORDER, PRECISION = 8, 10
#: Payload bytes worked on at once.
STEP_BYTES = 1 << 20

# Generator polynomials of the two checksums; coefficients of the fixed predictors.
CRC8, CRC16 = 0x07, 0x8005
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _crc_table(polynomial: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.uint16)
    for b in range(256):
        value = b << (bits - 8)
        for _ in range(8):
            value = (value << 1 ^ polynomial if value >> (bits - 1) else value << 1) & ((1 << bits) - 1)
        out[b] = value
    return out


_T8, _T16 = _crc_table(CRC8, 8), _crc_table(CRC16, 16)


def _crc(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each range; as it starts at zero, shorter ranges are led by zero bytes."""
    out = np.zeros(len(starts), np.uint16)
    if not len(starts):
        return out
    width = int((ends - starts).max())
    for k in range(width, 0, -1):
        at = ends - k
        byte = np.where(at >= starts, data[np.maximum(at, 0)], 0)
        out = table[byte ^ out] if bits == 8 else (out << np.uint16(8)) ^ table[(out >> np.uint16(8)) ^ byte]
    return out


# ---- writing --------------------------------------------------------------------------------------------------------


def _linear(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Quantised linear predictors (frames, ORDER) of the frames x, by autocorrelation; and their shift."""
    y = x.astype(np.float64)
    r = np.stack([(y[:, k:] * y[:, : y.shape[1] - k]).sum(1) for k in range(ORDER + 1)], 1)
    r[:, 0] = r[:, 0] * 1.0001 + 1
    a, err = np.zeros((len(x), ORDER)), r[:, 0].copy()
    for k in range(ORDER):
        acc = r[:, k + 1] - (a[:, :k] * r[:, k:0:-1][:, :k]).sum(1)
        g = acc / err
        new = a.copy()
        new[:, k] = g
        new[:, :k] -= g[:, None] * a[:, :k][:, ::-1]
        a, err = new, err * (1 - g * g)
    shift = PRECISION - 3
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)), -limit, limit).astype(np.int32), shift


def _residuals(x: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray | None, int]]:
    """For each predictor: its residuals (warm-up samples zero), order, coefficients (None: fixed) and shift."""
    out = [(x, 0, None, 0)]
    for order in (1, 2):
        d = x.copy()
        for j, c in enumerate(FIXED[order]):
            d[:, order:] -= c * x[:, order - 1 - j : x.shape[1] - 1 - j]
        d[:, :order] = 0
        out.append((d, order, None, 0))
    coefficients, shift = _linear(x)
    predicted = np.zeros_like(x[:, ORDER:])
    for j in range(ORDER):
        predicted += coefficients[:, j, None] * x[:, ORDER - 1 - j : x.shape[1] - 1 - j]
    d = np.zeros_like(x)
    d[:, ORDER:] = x[:, ORDER:] - (predicted >> shift)
    out.append((d, ORDER, coefficients, shift))
    return out


def _put(bits: np.ndarray, at: np.ndarray, values: np.ndarray, width: int) -> None:
    for b in range(width):
        bits[at + (width - 1 - b)] = values >> b & 1


def _frame_headers(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame headers, left-aligned in rows, and their lengths without the checksum."""
    n = numbers.astype(np.int64)
    head = np.zeros((len(n), 12), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x24, 0x02)  # fixed blocks of 576 at 8 kHz, mono, 8 bits
    more = (n >= 1 << 7).astype(int) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    lead = np.array([0, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    for k in range(6):
        mine = more == k
        if mine.any():
            head[mine, 4] = lead[k] | n[mine] >> (6 * k)
            for j in range(k):
                head[mine, 5 + j] = 0x80 | n[mine] >> (6 * (k - 1 - j)) & 0x3F
    return head, 5 + more


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload; lengths are positive multiples of FRAME."""
    frames = np.array([len(p) // FRAME for p in payloads])
    samples = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, FRAME).astype(np.int32) - 128
    n = len(samples)
    first = np.cumsum(frames) - frames
    head, head_size = _frame_headers(np.arange(n) - np.repeat(first, frames))
    # the bits of each candidate: partitions of 144 residuals, each with its best Rice parameter
    candidates = []
    for d, order, coefficients, shift in _residuals(samples):
        z = (d << 1) ^ (d >> 31)
        parts = z.reshape(n, 4, FRAME // 4)
        count = np.full(4, FRAME // 4)
        count[0] -= order
        # the parameter is that of a geometric distribution of the same mean; warm-up samples are zero in z and cost no unary bits
        param = np.log2(np.maximum(parts.sum(2) / count * 0.7, 1)).astype(np.int32)
        size = ((parts >> param[:, :, None]).sum(2) + (param + 1) * count).sum(1) + 8 + 8 * order + 6 + 16 + (9 + PRECISION * order if coefficients is not None else 0)
        candidates.append((size, z, param, order, coefficients, shift))
    sizes = np.stack([c[0] for c in candidates] + [np.full(n, 8 + 8 * FRAME)])
    choice = sizes.argmin(0)
    constant = (samples == samples[:, :1]).all(1)
    body = np.where(constant, 16, sizes.min(0))
    size = head_size + 1 + (body + 7) // 8 + 2
    ends = np.cumsum(size)
    starts = ends - size
    out = np.zeros(int(ends[-1]), np.uint8)
    for k in range(11):
        mine = head_size > k
        out[starts[mine] + k] = head[mine, k]
    out[starts + head_size] = _crc(out, starts, starts + head_size, _T8, 8)
    bits = np.zeros(len(out) * 8, np.uint8)
    base = (starts + head_size + 1) * 8
    at = base[constant]
    _put(bits, at + 8, samples[constant, 0] & 255, 8)
    verbatim = ~constant & (choice == len(candidates))
    at = base[verbatim]
    if len(at):
        _put(bits, at, np.full(len(at), 2), 8)
        _put(bits, (at[:, None] + 8 + 8 * np.arange(FRAME)).ravel(), (samples[verbatim] & 255).ravel(), 8)
    for c, (_, z, param, order, coefficients, shift) in enumerate(candidates):
        mine = ~constant & (choice == c)
        at = base[mine]
        if not len(at):
            continue
        _put(bits, at, np.full(len(at), (order - 1 | 32 if coefficients is not None else order | 8) << 1), 8)
        at = at + 8
        for j in range(order):
            _put(bits, at, samples[mine, j] & 255, 8)
            at = at + 8
        if coefficients is not None:
            _put(bits, at, np.full(len(at), (PRECISION - 1) << 5 | shift), 9)
            at = at + 9
            for j in range(order):
                _put(bits, at, coefficients[mine, j] & ((1 << PRECISION) - 1), PRECISION)
                at = at + PRECISION
        _put(bits, at, np.full(len(at), 2), 6)  # Rice parameters of 4 bits, 4 partitions
        at = at + 6
        z, param = z[mine].reshape(len(at), 4, -1), param[mine]
        length = (z >> param[:, :, None]) + param[:, :, None] + 1
        length[:, 0, :order] = 0
        upto = np.cumsum(length.reshape(len(at), -1), 1)
        where = at[:, None] + upto - length.reshape(len(at), -1) + np.repeat(4 * np.arange(1, 5), FRAME // 4)
        for p in range(4):
            _put(bits, where[:, p * FRAME // 4] - 4, param[:, p], 4)
        keep = np.ones(FRAME, bool)
        keep[:order] = False
        k = np.repeat(param, FRAME // 4, axis=1)[:, keep].ravel()
        z, where = z.reshape(len(at), -1)[:, keep].ravel(), where[:, keep].ravel()
        stop = where + (z >> k)
        bits[stop] = 1
        last = stop + k
        for b in range(int(k.max(initial=0))):
            if b < int(k.min()):
                bits[last - b] = z >> b & 1
            else:
                has = k > b
                bits[last[has] - b] = z[has] >> b & 1
    out |= np.packbits(bits)
    crc = _crc(out, starts, ends - 2, _T16, 16)
    out[ends - 2], out[ends - 1] = crc >> 8, crc & 255
    streams, whole = [], out.tobytes()
    for k, payload in enumerate(payloads):
        a, b = first[k], first[k] + frames[k]
        info = struct.pack(">HH", FRAME, FRAME) + int(size[a:b].min()).to_bytes(3, "big") + int(size[a:b].max()).to_bytes(3, "big")
        info += (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5((samples[a:b] & 255).astype(np.uint8).tobytes()).digest()
        seek = np.zeros(b - a, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
        seek["sample"], seek["offset"], seek["count"] = np.arange(b - a) * FRAME, starts[a:b] - starts[a], FRAME
        table = seek.tobytes()
        streams.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(table).to_bytes(3, "big") + table + whole[starts[a] : ends[b - 1]])
    return streams


# ---- reading --------------------------------------------------------------------------------------------------------


class _Bits:
    """Random bit reads over bytes, many positions at once."""

    def __init__(self, data: np.ndarray):
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        window = np.zeros(len(data) + 8, np.uint64)
        for k in range(8):
            window |= padded[k : k + len(window)].astype(np.uint64) << np.uint64(56 - 8 * k)
        self.window = window
        ones = np.unpackbits(data)
        n = len(ones)
        at = np.append(np.flatnonzero(ones), n).astype(np.int32)
        self.next_one = np.repeat(at, np.diff(at, prepend=np.int32(-1)))

    def read(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned values of up to 32 bits."""
        width = np.asarray(width)
        w = self.window[np.minimum(at >> 3, len(self.window) - 1)] << (at & 7).astype(np.uint64)
        return np.where(width > 0, w >> (64 - np.maximum(width, 1)).astype(np.uint64), 0).astype(np.int64)


def _signed(v: np.ndarray, width: np.ndarray | int) -> np.ndarray:
    half = np.where(np.asarray(width) > 0, 1 << np.maximum(np.asarray(width) - 1, 0), 0)
    return np.where(v & half, v - 2 * half, v)


def _decode_frames(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples (frames, FRAME), frame numbers and ends of the frames at starts."""
    bits = _Bits(data)
    head = starts * 8
    if (bits.read(head, 32) != 0xFFF82402).any():
        raise ValueError("not a frame of fixed blocks of 576, mono, 8 bits")
    lead = bits.read(head + 32, 8)
    more = (lead >= 0xC0).astype(int) + (lead >= 0xE0) + (lead >= 0xF0) + (lead >= 0xF8) + (lead >= 0xFC)
    number = np.where(more == 0, lead, lead & (1 << (6 - more).clip(0)) - 1)
    for k in range(int(more.max(initial=0))):
        number = np.where(more > k, number << 6 | bits.read(head + 40 + 8 * k, 8) & 0x3F, number)
    ends8 = starts + 5 + more
    if (bits.read(ends8 * 8, 8) != _crc(data, starts, ends8, _T8, 8)).any():
        raise ValueError("a frame header's checksum differs")
    n = len(starts)
    at = (ends8 + 1) * 8
    kind = bits.read(at, 8) >> 1
    at = at + 8
    x = np.zeros((FRAME, n), np.int64)
    constant, verbatim = kind == 0, kind == 1
    x[:, constant] = _signed(bits.read(at[constant], 8), 8)
    at[constant] += 8
    for t in range(FRAME if verbatim.any() else 0):
        x[t, verbatim] = _signed(bits.read(at[verbatim] + 8 * t, 8), 8)
    at[verbatim] += 8 * FRAME
    coded = np.flatnonzero(kind >= 8)
    if len(coded):
        at[coded] = _decode_coded(bits, at[coded], kind[coded], x, coded)
    ends = (at + 7 >> 3) + 2
    if (ends > len(data)).any() or (bits.read((ends - 2) * 8, 16) != _crc(data, starts, ends - 2, _T16, 16)).any():
        raise ValueError("a frame's checksum differs")
    return x.T, number, ends


def _decode_coded(bits: _Bits, at: np.ndarray, kind: np.ndarray, x: np.ndarray, into: np.ndarray) -> np.ndarray:
    """Restores the predicted frames into columns of x; returns where their bits end."""
    linear = kind >= 32
    order = np.where(linear, (kind & 31) + 1, kind & 7)
    most = int(order.max())
    y = np.zeros((FRAME, len(at)), np.int64)
    for j in range(most):
        has = order > j
        y[j, has] = _signed(bits.read(at[has], 8), 8)
        at[has] += 8
    coefficients, shift = np.zeros((most, len(at)), np.int64), np.zeros(len(at), np.int64)
    for k in range(1, min(4, most) + 1):
        for j, c in enumerate(FIXED[k]):
            coefficients[j, ~linear & (order == k)] = c
    if linear.any():
        precision = bits.read(at, 4) + 1
        shift[linear] = _signed(bits.read(at + 4, 5), 5)[linear]
        at[linear] += 9
        for j in range(most):
            has = linear & (order > j)
            coefficients[j, has] = _signed(bits.read(at[has], precision[has]), precision[has])
            at[has] += precision[has]
    wide = bits.read(at, 2)
    if (wide > 1).any():
        raise ValueError("a reserved way to code residuals")
    parts = bits.read(at + 2, 4)
    at = at + 6
    length = FRAME >> parts
    width = 4 + wide
    k, raw = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for t in range(FRAME):
        new = t % length == 0
        if new.any():
            got = bits.read(at, width)
            escape = new & (got == (1 << width) - 1)
            at = at + np.where(new, width, 0)
            k, raw = np.where(new, got, k), np.where(new, escape, raw)
            if escape.any():
                k = np.where(escape, bits.read(at, 5), k)
                at = at + np.where(escape, 5, 0)
        stop = bits.next_one[np.minimum(at, len(bits.next_one) - 1)]
        q = stop - at
        low = bits.read(stop + 1, k)
        z = q << k | low
        r = z >> 1 ^ -(z & 1)
        step = q + 1 + k
        if raw.any():
            r, step = np.where(raw, _signed(bits.read(at, k), k), r), np.where(raw, k, step)
        live = t >= order
        y[t] = np.where(live, r, y[t])
        at = at + np.where(live, step, 0)
    for t in range(1, FRAME):
        depth = min(t, most)
        if depth:
            predicted = (coefficients[:depth] * y[t - depth : t][::-1]).sum(0) >> shift
            y[t] += np.where(t >= order, predicted, 0)
    x[:, into] = y
    return at


def _metadata(stream: bytes) -> tuple[int, bytes, np.ndarray | None, int]:
    """Total samples, MD5, frame offsets (None without a full seek table) and where the frames begin."""
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    at, last, total, digest, points = 4, False, 0, b"", None
    while not last:
        last, kind, size = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            total, digest = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:34]
        elif kind == 3:
            table = np.frombuffer(body, np.dtype([("sample", ">u8"), ("offset", ">u8"), ("count", ">u2")]))
            points = table["offset"][table["sample"] != 0xFFFFFFFFFFFFFFFF].astype(np.int64)
        at += 4 + size
    if points is not None and len(points) * FRAME != total:
        points = None
    return total, digest, points, at


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of each stream as unsigned bytes, after all checks."""
    offsets = np.cumsum([0, *map(len, streams)])
    data = np.frombuffer(b"".join(streams), np.uint8)
    info = [_metadata(s) for s in streams]
    starts = [points + at + offsets[k] for k, (_, _, points, at) in enumerate(info) if points is not None]
    got = _decode_frames(data, np.concatenate(starts)) if starts else None
    out, used = [], 0
    for k, (total, digest, points, at) in enumerate(info):
        if points is not None:
            n = len(points)
            rows, number = got[0][used : used + n], got[1][used : used + n]
            ends = got[2][used : used + n]
            if (ends[:-1] != points[1:] + at + offsets[k]).any() or (n and ends[-1] != offsets[k + 1]):
                raise ValueError("frames and seek points differ")
            used += n
        else:
            own, found, numbers = np.frombuffer(streams[k], np.uint8), [], []
            while at < len(own):
                row, number, end = _decode_frames(own, np.array([at]))
                found.append(row)
                numbers.append(number)
                at = int(end[0])
            rows, number = np.concatenate(found), np.concatenate(numbers)
        if (number != np.arange(len(number))).any() or rows.size != total:
            raise ValueError("frames are missing")
        pcm = rows.astype(np.int8).reshape(-1)
        if hashlib.md5(pcm.tobytes()).digest() != digest:
            raise ValueError("the samples' MD5 differs")
        out.append((pcm.astype(np.int16) + 128).astype(np.uint8))
    return out


# ---- columns --------------------------------------------------------------------------------------------------------


def padded(text: bytes, pad: int = PAD) -> bytes:
    return text + bytes([pad]) * (-len(text) % FRAME if text else FRAME)


def media(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the column media: the FLAC stream of each padded text."""
    common.small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, limit=STEP_BYTES):
            texts = common.utf8(common.col(batch, "text")).to_pylist()
            streams = encode([padded(t) for t in texts])
            yield pa.RecordBatch.from_arrays([common.col(batch, "doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(streams, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def feature(pcm: np.ndarray) -> str:
    """Sum of squares, sign changes and peak of the samples around their middle."""
    x = pcm.astype(np.int64) - 128
    return f"energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())};peak={int(np.abs(x).max())}"


def pcm_blocks(column: DataFrame) -> DataFrame:
    """The rows of column (doc_id, n_bytes, media) with feature and blocks: array of (sample_offset, n_samples, pcm)."""
    kind = pa.list_(pa.struct([("sample_offset", pa.int64()), ("n_samples", pa.int32()), ("pcm", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "media", STEP_BYTES):
            blocks, features = [], []
            for pcm in decode(common.col(batch, "media").to_pylist()):
                features.append(feature(pcm))
                blocks.append([{"sample_offset": a, "n_samples": len(pcm[a : a + BLOCK]), "pcm": pcm[a : a + BLOCK].tobytes()} for a in range(0, len(pcm), BLOCK)])
            yield pa.RecordBatch.from_arrays([*(common.col(batch, c) for c in ("doc_id", "n_bytes", "media")), pa.array(features), pa.array(blocks, kind)], names=["doc_id", "n_bytes", "media", "feature", "blocks"])

    return column.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, media binary, feature string, blocks array<struct<sample_offset:long,n_samples:int,pcm:binary>>")


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through the media column and back; the digests are of what is read back."""
    got = pcm_blocks(media(common.table(spark, sf_dir, "documents")))
    payload = F.aggregate(F.col("blocks.pcm"), F.lit(b""), lambda a, b: F.concat(a, b))
    got = got.select("doc_id", "n_bytes", "media", "feature", payload.alias("payload"))
    return got.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )
