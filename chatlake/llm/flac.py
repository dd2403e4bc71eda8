"""Text bytes as 8-bit FLAC streams, and FLAC streams as PCM blocks with sample offsets.

A sample is a byte's rank: the payload's most common byte is 0, the next ones are -1, 1, -2, and so on. Each stream
says so itself, in an application block `rank` that lists its bytes in this order; of streams without that block a
sample is the byte less 128, as in WAV files.

The encoder cuts a payload into blocks and takes for each the cheapest of a constant, the raw samples, the fixed
predictors of order 0 to 4 and a linear predictor, and writes Rice residuals in the cheapest number of partitions,
CRC-8 and CRC-16 sums and a seek table with every frame. The decoder finds the frames by the seek table, or where that
does not name all of them by their headers and sums, and decodes all frames of a batch in step: sample i of every frame
at once.

Null texts are empty and still give one padded block of 64 bytes. Repeated rows give repeated rows, equal texts equal
streams; bytes that are as common as each other rank by value. Very long texts take memory in proportion to them. An empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import text as tx
from .session import ready, table, written

#: Samples in a frame; the last of a stream may have fewer.
BLOCK = 1024
RATE = 8000
PAD = 64
ORDER = 4
PRECISION, SHIFT = 12, 10
#: A block has 2 ** MOST_SPLITS partitions at most.
MOST_SPLITS = 3
#: Payload bytes that are coded or decoded together.
BATCH_BYTES = 2 << 20
# The coefficients of FLAC's fixed predictors of order 0 to 4.
_FIXED = np.array([[0, 0, 0, 0], [1, 0, 0, 0], [2, -1, 0, 0], [3, -3, 1, 0], [4, -6, 4, -1]], np.int64)


_RANKED = np.array([(r >> 1) ^ -(r & 1) for r in range(256)]).astype(np.int8)  # the sample of each rank
_APPLICATION = b"rank"


def _ranks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The samples of all payloads, and the bytes of each in order of rank."""
    docs = len(offsets) - 1
    at = np.repeat(np.arange(docs, dtype=np.int32) * 256, np.diff(offsets)) + data
    count = np.bincount(at, minlength=256 * docs).reshape(docs, 256)
    order = np.argsort(-count, 1, kind="stable").astype(np.uint8)
    sample = np.empty((docs, 256), np.int8)
    np.put_along_axis(sample, order.astype(np.int64), np.broadcast_to(_RANKED, (docs, 256)), 1)
    used = (count > 0).sum(1).tolist()
    return sample.ravel()[at], [o[:n].tobytes() for o, n in zip(order, used)]


def expanded(samples: np.ndarray, offsets: np.ndarray, ranked: list[bytes | None]) -> np.ndarray:
    """The payload bytes of samples; ranked: of each stream, as its application block has them."""
    plain = np.arange(256, dtype=np.uint8) ^ 0x80  # by the sample's bits
    table = np.empty((len(ranked), 256), np.uint8)
    for i, r in enumerate(ranked):
        table[i] = plain
        if r is not None:
            table[i, _RANKED[: len(r)].view(np.uint8)] = np.frombuffer(r, np.uint8)
    return table.ravel()[np.repeat(np.arange(len(ranked), dtype=np.int32) * 256, np.diff(offsets)) + samples.view(np.uint8)]


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask = 1 << (bits - 1), (1 << bits) - 1
    out = []
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c & top else c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)
_CLZ16 = np.array([16 - x.bit_length() for x in range(1 << 16)], np.int64)


def _crc(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, bits: int) -> np.ndarray:
    """The CRC of each span, all spans in step."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order], lengths[order]
    live = np.searchsorted(-n, -np.arange(n[0] if len(n) else 0), "left")
    c = np.zeros(len(at), np.uint16 if bits == 16 else np.uint8)
    for i, m in enumerate(live):
        b = data[at[:m] + i]
        c[:m] = (c[:m] << 8) ^ _CRC16[(c[:m] >> 8) ^ b] if bits == 16 else _CRC8[c[:m] ^ b]
    out = np.empty_like(c)
    out[order] = c
    return out


class _Bits:
    """Bit fields by their place in a buffer; fields do not overlap, so that words are sums of fields."""

    def __init__(self):
        self.words, self.values = [], []

    def put(self, pos: np.ndarray, value: np.ndarray, n) -> None:
        """Fields of n bits, 32 at most."""
        word = pos >> 5
        wide = value.astype(np.uint64) << (64 - (pos & 31) - n).astype(np.uint64)
        self.words += [word, word + 1]
        self.values += [wide >> np.uint64(32), wide & np.uint64(0xFFFFFFFF)]

    def tobytes(self, n: int) -> np.ndarray:
        size, out = (n >> 2) + 2, None
        for w, v in zip(self.words, self.values):
            part = np.bincount(w, v, size)
            out = part if out is None else np.add(out, part, out=out)
        return out.astype(">u4").view(np.uint8)[:n].copy()


def _number_bytes(v: int) -> list[int]:
    """A frame number in FLAC's extension of UTF-8."""
    if v < 0x80:
        return [v]
    n = 2
    while v >= 1 << (5 * n + 1):
        n += 1
    lead = (0xFF << (8 - n)) & 0xFF
    return [lead | (v >> (6 * (n - 1)))] + [0x80 | ((v >> (6 * j)) & 0x3F) for j in range(n - 2, -1, -1)]


_numbers: list[bytes] = []


def _number(v: int) -> bytes:
    while len(_numbers) <= min(v, 1 << 16):
        _numbers.append(bytes(_number_bytes(len(_numbers))))
    return _numbers[v] if v < len(_numbers) else bytes(_number_bytes(v))


def _zigzag(r: np.ndarray) -> np.ndarray:
    return (r << 1) ^ (r >> 31)


def _predictors(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of the linear predictor of each row, by the Levinson recursion, and about the bits that
    it saves on a sample."""
    auto = np.stack([np.einsum("ij,ij->i", x[:, j:], x[:, : x.shape[1] - j]) for j in range(ORDER + 1)]).astype(np.float64)
    err, a = auto[0] * (1 + 1e-6) + 1e-6, np.zeros((ORDER, len(x)))
    for m in range(ORDER):
        k = (auto[m + 1] - (a[:m] * auto[m:0:-1]).sum(0)) / err
        a[:m] -= k * a[:m][::-1].copy()
        a[m] = k
        err = np.maximum(err * (1 - k * k), 1e-9)
    top = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(np.nan_to_num(a) * (1 << SHIFT)), -top, top).astype(np.int32), 0.5 * np.log2(np.maximum(auto[0], 1e-9) / err)


def _rice(total: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The Rice parameter for n residuals whose zigzag values sum to `total`, and about the bits that they take."""
    k = np.clip(np.log2(np.maximum(total / np.maximum(n, 1) * 0.6931, 1e-3)).astype(np.int64) + 1, 0, 14)
    bits = np.stack([n * (1 + j) + np.maximum(total - n * ((1 << j) - 1) / 2, 0) / (1 << j) for j in (np.maximum(k - 1, 0), k)])
    return np.where(bits[0] < bits[1], np.maximum(k - 1, 0), k), bits.min(0)


def encode_streams(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A FLAC stream for each payload; payloads are not empty and have a multiple of 64 bytes."""
    sizes = np.diff(offsets)
    per = -(-sizes // BLOCK)
    doc = np.repeat(np.arange(len(sizes)), per)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    start = offsets[doc] + number * BLOCK
    n = np.minimum(BLOCK, offsets[doc + 1] - start)
    signed, ranked = _ranks(data, offsets)
    inside = np.arange(BLOCK) < n[:, None]
    s = np.zeros((len(n), BLOCK), np.int32)
    s[inside] = signed

    # the predictor of each frame: its residuals as zigzag values u, those of its first samples are not coded
    u = _zigzag(s)
    order, body = np.zeros(len(n), np.int64), _rice(u.sum(1), n)[1]
    rest = s
    for o in range(1, 5):
        rest = np.diff(rest, axis=1)
        part = _zigzag(rest)
        part[~inside[:, o:]] = 0
        bits = _rice(part.sum(1), n - o)[1] + 8 * o
        better = np.flatnonzero(bits < body)
        order[better], body[better] = o, bits[better]
        u[better, o:] = part[better]
    coef, gain = _predictors(s.astype(np.float32))
    use = np.zeros(len(n), bool)
    likely = np.flatnonzero(gain * n > 9 + (PRECISION + 8) * ORDER)
    if len(likely):
        x = s[likely]
        guess = np.zeros_like(x)
        for j in range(ORDER):
            guess[:, j + 1 :] += coef[j, likely][:, None] * x[:, : -j - 1]
        part = _zigzag(x - (guess >> SHIFT))
        part[~inside[likely]] = 0
        part[:, :ORDER] = 0
        bits = _rice(part.sum(1), n[likely] - ORDER)[1] + 9 + (PRECISION + 8) * ORDER
        better = bits < body[likely]
        use[likely[better]] = True
        order[likely[better]] = ORDER
        u[likely[better]] = part[better]
    inside &= np.arange(BLOCK) >= order[:, None]

    # the number of partitions and their parameters, by the sums of eighths
    sums = np.zeros((len(n), BLOCK + 1), np.int64)
    np.cumsum(np.where(inside, u, 0), 1, out=sums[:, 1:])
    splits, k, body = np.zeros(len(n), np.int64), np.zeros((len(n), 1 << MOST_SPLITS), np.int64), np.full(len(n), np.inf)
    rows = np.arange(len(n))[:, None]
    for p in range(MOST_SPLITS + 1):
        size = n >> p
        edges = np.arange((1 << p) + 1) * size[:, None]
        many = np.repeat(size[:, None], 1 << p, 1)
        many[:, 0] -= order
        kp, bits = _rice(np.diff(sums[rows, edges], axis=1), many)
        bits = (bits + 4).sum(1)
        better = np.flatnonzero((bits < body) & (size > order))
        splits[better], body[better] = p, bits[better]
        k[better] = 0
        k[better[:, None], np.arange(1 << p)] = kp[better]
    del sums
    frame, place = np.nonzero(inside)
    place //= (n >> splits)[frame]
    kt = k[frame, place].astype(np.int32)
    lead = np.append(True, (frame[1:] != frame[:-1]) | (place[1:] != place[:-1])) if len(frame) else np.zeros(0, bool)
    del place
    ut = u[inside]
    length = (ut >> kt) + (kt + 1) + 4 * lead
    body = 8 * order + 6 + np.bincount(frame, length, len(n)).astype(np.int64) + np.where(use, 9 + PRECISION * ORDER, 0)
    constant = np.where(np.arange(BLOCK) < n[:, None], s, s[:, :1])
    constant = constant.min(1) == constant.max(1)
    raw = ~constant & (body >= 8 * n)
    coding = ~constant & ~raw
    body = np.where(constant, 8, np.where(raw, 8 * n, body))

    # the layout: header, subframe header, body, padding, CRC-16
    nums = [_number(x) for x in number.tolist()]
    num_len = np.fromiter(map(len, nums), np.int64, len(nums))
    head = 4 + num_len + np.where(n == BLOCK, 0, 2)
    frame_bytes = head + 1 + 1 + -(-body // 8) + 2
    at = np.cumsum(frame_bytes) - frame_bytes
    total = int(frame_bytes.sum())
    bits = _Bits()
    sub = (at + head + 1) * 8
    kind = np.where(constant, 0, np.where(raw, 1, np.where(use, 32 + ORDER - 1, 8 + order)))
    bits.put(sub, kind << 1, np.full(len(n), 8))
    p = sub + 8
    c = np.flatnonzero(constant)
    bits.put(p[c], s[c, 0] & 0xFF, np.full(len(c), 8))
    for j in range(max(ORDER, 4)):
        f = np.flatnonzero(coding & (order > j))
        bits.put(p[f] + 8 * j, s[f, j] & 0xFF, np.full(len(f), 8))
    p = p + 8 * order
    f = np.flatnonzero(coding & use)
    full = np.full(len(f), PRECISION)
    bits.put(p[f], np.full(len(f), ((PRECISION - 1) << 5) | SHIFT), np.full(len(f), 9))
    for j in range(ORDER):
        bits.put(p[f] + 9 + PRECISION * j, coef[j][f] & ((1 << PRECISION) - 1), full)
    p[f] += 9 + PRECISION * ORDER
    f = np.flatnonzero(coding)
    bits.put(p[f], splits[f], np.full(len(f), 6))  # method 0 is zero bits
    p = p + 6
    some = coding[frame]
    frame, kt, ut, length, lead = frame[some], kt[some], ut[some], length[some], lead[some]
    run = np.cumsum(length, dtype=np.int64)
    run -= length
    heads = np.flatnonzero(np.append(True, frame[1:] != frame[:-1])) if len(frame) else np.zeros(0, np.int64)
    base = p.copy()
    base[frame[heads]] -= run[heads]
    run += base[frame]
    bits.put(run[lead], kt[lead].astype(np.int64), np.full(int(lead.sum()), 4))
    run += 4 * lead + (ut >> kt)
    one = np.int32(1) << kt
    bits.put(run, one | (ut & (one - 1)), kt.astype(np.int64) + 1)
    out = bits.tobytes(total)
    for f in np.flatnonzero(raw):
        a = at[f] + head[f] + 2
        out[a : a + n[f]] = signed[start[f] : start[f] + n[f]].view(np.uint8)
    out[at], out[at + 1] = 0xFF, 0xF8
    out[at + 2] = np.where(n == BLOCK, 0xA0, 0x70)
    out[at + 3] = 0x02  # one channel of 8 bits
    flat = np.frombuffer(b"".join(nums), np.uint8)
    out[np.repeat(at + 4 - (np.cumsum(num_len) - num_len), num_len) + np.arange(len(flat))] = flat
    odd = np.flatnonzero(n != BLOCK)
    out[at[odd] + 4 + num_len[odd]] = (n[odd] - 1) >> 8
    out[at[odd] + 5 + num_len[odd]] = (n[odd] - 1) & 0xFF
    out[at + head] = _crc(out, at, head, 8)
    crc = _crc(out, at, frame_bytes - 2, 16)
    out[at + frame_bytes - 2], out[at + frame_bytes - 1] = crc >> 8, crc & 0xFF

    points = np.zeros(len(n), _POINT)
    firsts = np.cumsum(per) - per
    points["sample"] = number * BLOCK
    points["offset"] = at - at[firsts][doc]
    points["samples"] = n
    seek, body_bytes, pcm = points.tobytes(), out.tobytes(), signed.tobytes()
    ends = np.append(at, total)
    streams = []
    for d, (a, m) in enumerate(zip(firsts.tolist(), per.tolist())):
        size = int(sizes[d])
        info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + ((RATE << 44) | (7 << 36) | size).to_bytes(8, "big")
        info += hashlib.md5(pcm[offsets[d] : offsets[d + 1]]).digest()
        own = _APPLICATION + ranked[d]
        streams.append(b"fLaC\x00\x00\x00\x22" + info + b"\x02" + len(own).to_bytes(3, "big") + own + b"\x83" + (18 * m).to_bytes(3, "big") + seek[18 * a : 18 * (a + m)] + body_bytes[ends[a] : ends[a + m]])
    return streams


class FlacError(ValueError):
    pass


_POINT = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("samples", ">u2")])


def _metadata(stream: bytes) -> tuple[int, int, bytes, np.ndarray, bytes | None]:
    """Start of the frames, number of samples, MD5, a seek point for every frame, and the bytes by rank."""
    if stream[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, total, md5, points, ranked = 4, False, 0, b"", None, None
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        block = stream[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(block[10:18], "big")
            if (packed >> 41) & 7 or (packed >> 36) & 31 != 7:
                raise FlacError("only one channel of 8 bits is decoded")
            total, md5 = packed & ((1 << 36) - 1), block[18:34]
        elif kind == 2 and block[:4] == _APPLICATION:
            ranked = block[4:]
        elif kind == 3:
            points = np.frombuffer(block, _POINT)
        at += 4 + n
    if points is None or int(points["samples"].sum()) != total:
        points = _scanned(stream, at)
        if int(points["samples"].sum()) != total:
            raise FlacError("frames are missing")
    return at, total, md5, points, ranked


def _scanned(stream: bytes, begin: int) -> np.ndarray:
    """Seek points of all frames, without a seek table: a frame ends where the next one or the end follows and its
    CRC-16 holds."""
    points, at, sample = [], begin, 0
    while at < len(stream):
        lead = stream[at + 4]
        tail = at + 4 + (1 if lead < 0x80 else 8 - (~lead & 0xFF).bit_length())
        code = stream[at + 2] >> 4
        n = stream[tail] + 1 if code == 6 else int.from_bytes(stream[tail : tail + 2], "big") + 1 if code == 7 else 192 if code == 1 else 576 << (code - 2) if code < 6 else 256 << (code - 8)
        end, crc = at, 0
        while True:
            to = stream.find(b"\xff\xf8", end + 3)
            to = len(stream) if to < 0 else to
            for b in stream[max(end - 2, at) : to - 2]:
                crc = ((crc << 8) & 0xFFFF) ^ int(_CRC16[(crc >> 8) ^ b])
            if crc == int.from_bytes(stream[to - 2 : to], "big"):
                break
            if to == len(stream):
                raise FlacError("a frame's CRC-16 does not hold")
            end = to
        points.append((sample, at - begin, n))
        at, sample = to, sample + n
    return np.array(points, _POINT)


def decode_streams(streams: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes | None]]:
    """Samples of all streams (signed), their offsets, for each frame its stream and first sample, and of each stream
    the bytes by rank.

    Raises FlacError where a header's CRC-8, a frame's CRC-16, or the MD5 of a stream does not hold."""
    metas = [_metadata(x) for x in streams]
    data = np.frombuffer(b"".join(streams) + bytes(16), np.uint8)
    base = np.cumsum([0, *map(len, streams)])
    per = np.array([len(m[3]) for m in metas], np.int64)
    doc = np.repeat(np.arange(len(streams)), per)
    points = np.concatenate([m[3] for m in metas]) if metas else np.zeros(0, _POINT)
    at = base[:-1][doc] + np.array([m[0] for m in metas], np.int64)[doc] + points["offset"].astype(np.int64)
    end = np.append(at[1:], base[-1])
    lasts = np.cumsum(per) - 1
    end[lasts[per > 0]] = base[1:][per > 0]
    sample = points["sample"].astype(np.int64)
    # headers
    if ((data[at] != 0xFF) | (data[at + 1] != 0xF8) | (data[at + 3] != 0x02)).any():
        raise FlacError("a frame does not start where the seek table says")
    lead = data[at + 4]
    num_len = np.where(lead < 0x80, 1, _CLZ16[(~lead.astype(np.int64) & 0xFF) << 8])
    code = data[at + 2] >> 4
    extra = np.where(code == 6, 1, np.where(code == 7, 2, 0))
    tail = at + 4 + num_len
    n = np.where(code == 6, data[tail].astype(np.int64) + 1, np.where(code == 7, (data[tail].astype(np.int64) << 8) + data[tail + 1] + 1, np.where(code < 6, np.where(code == 1, 192, 576 << np.maximum(code.astype(np.int64) - 2, 0)), 256 << np.maximum(code.astype(np.int64) - 8, 0))))
    head = 4 + num_len + extra
    if (n != points["samples"]).any() or (_crc(data, at, head, 8) != data[at + head]).any():
        raise FlacError("a frame header is damaged")
    crc = _crc(data, at, end - at - 2, 16)
    if ((crc >> 8 != data[end - 2]) | ((crc & 0xFF) != data[end - 1])).any():
        raise FlacError("a frame's CRC-16 does not hold")

    sub = at + head + 1
    kind = (data[sub] >> 1) & 63
    if ((data[sub] & 0x81) != 0).any():
        raise FlacError("wasted bits are not decoded")
    fixed, lpc = (kind >= 8) & (kind <= 12), kind >= 32
    order = np.where(fixed, kind.astype(np.int64) - 8, np.where(lpc, kind.astype(np.int64) - 31, 0))
    matrix = np.zeros((int(n.max()) if len(n) else 0, len(n)), np.int32)
    signed = data.view(np.int8)
    for f in np.flatnonzero(kind == 0):
        matrix[: n[f], f] = signed[sub[f] + 1]
    for f in np.flatnonzero(kind == 1):
        matrix[: n[f], f] = signed[sub[f] + 1 : sub[f] + 1 + n[f]]
    live = np.flatnonzero(fixed | lpc)
    if len(live):
        live = live[np.argsort(-n[live], kind="stable")]
        wide = np.zeros(len(data) - 8, np.uint64)
        for j in range(8):
            wide |= data[j : len(data) - 8 + j].astype(np.uint64) << np.uint64(56 - 8 * j)
        for some in (live[order[live] == 0], live[order[live] > 0]):
            if len(some):
                matrix[:, some] = _residual_frames(wide, signed, sub[some], n[some], order[some], lpc[some], matrix.shape[0])
    rows = matrix.T.astype(np.int8)
    samples = rows[np.arange(matrix.shape[0]) < n[:, None]]
    offsets = np.cumsum([0, *(m[1] for m in metas)])
    pcm = samples.tobytes()
    for d, m in enumerate(metas):
        if any(m[2]) and hashlib.md5(pcm[offsets[d] : offsets[d + 1]]).digest() != m[2]:
            raise FlacError("the MD5 of a stream does not hold")
    return samples, offsets, doc, sample, [m[4] for m in metas]


def _residual_frames(wide, signed, sub, n, order, lpc, longest) -> np.ndarray:
    """Rice residuals and predictors of frames in descending order of size, in step.

    wide: the 64 bits that start at each byte."""
    u64 = np.uint64

    def peek(pos):
        return wide[pos >> 3] << (pos & 7).astype(u64)

    def read(pos, bits):
        """Unsigned fields; bits is an array of 0 to 32."""
        return ((peek(pos) >> u64(1)) >> (63 - bits).astype(u64)).astype(np.int64)

    frames = len(sub)
    pos = (sub + 1) * 8 + 8 * order
    top = int(order.max())
    coef, shift = np.zeros((max(top, 4), frames), np.int32), np.zeros(frames, np.int32)
    coef[:4] = np.where(lpc, 0, _FIXED[np.where(lpc, 0, order)].T)
    f = np.flatnonzero(lpc)
    if len(f):
        precision = read(pos[f], np.full(len(f), 4)) + 1
        shift[f] = read(pos[f] + 4, np.full(len(f), 5))
        p = pos[f] + 9
        for j in range(top):
            has = order[f] > j
            v = read(p, precision)
            coef[j, f] = np.where(has, v - ((v >> (precision - 1)) << precision), 0)
            p = np.where(has, p + precision, p)
        pos[f] = p
    method = read(pos, np.full(frames, 2))
    if (method > 1).any():
        raise FlacError("a reserved residual coding")
    width = 4 + method
    part = n >> read(pos + 2, np.full(frames, 4))
    pos = pos + 6
    edge, k, plain = np.zeros(frames, np.int64), np.zeros(frames, np.int64), np.full(frames, -1)
    out = np.zeros((longest, frames), np.int32)
    counts = np.searchsorted(-n, -np.arange(longest), "left")
    many, escapes = (part < n).any(), False
    for i in range(longest):
        m = int(counts[i])
        if m == 0:
            break
        if i == 0 or many and (edge[:m] == i).any():
            g = np.flatnonzero(edge[:m] == i)
            k[g] = read(pos[g], width[g])
            pos[g] += width[g]
            edge[g] += part[g]
            escape = k[g] == (1 << width[g]) - 1
            plain[g] = -1
            e = g[escape]
            if len(e):
                escapes = True
                plain[e] = read(pos[e], np.full(len(e), 5))
                pos[e] += 5
        if i < top:
            g = np.flatnonzero(order[:m] <= i)
            w = np.flatnonzero(order[:m] > i)
            out[i, w] = signed[sub[w] + 1 + i]
        else:
            g = slice(0, m)
        at, kk = pos[g], k[g]
        x = wide[at >> 3] << (at & 7).view(u64)
        first = (x >> u64(48)).view(np.int64)
        q = _CLZ16[first]
        if not first.all():
            whole, at, x = _long_quotients(wide, at, x, q)
            q = whole[1]
            whole = whole[0]
        else:
            whole = q
        x <<= (q + 1).view(u64)
        x >>= u64(1)
        x >>= (63 - kk).view(u64)
        u = (whole << kk) | x.view(np.int64)
        r = ((u >> 1) ^ -(u & 1)).astype(np.int32)
        step = at + q + 1 + kk
        if escapes:
            raw = plain[g]
            e = raw >= 0
            bits = np.where(e, raw, 0)
            v = read(pos[g], bits)
            v = np.where(bits > 0, v - ((v >> np.maximum(bits - 1, 0)) << bits), 0)
            r = np.where(e, v, r).astype(np.int32)
            step = np.where(e, pos[g] + bits, step)
        pos[g] = step
        if i and top:
            guess = coef[0, g] * out[i - 1, g]
            for j in range(1, min(i, coef.shape[0])):
                guess += coef[j, g] * out[i - 1 - j, g]
            r += guess >> shift[g]
        out[i, g] = r
    return out


def _long_quotients(wide, at, x, q):
    """Quotients of 16 and more, read 16 bits at a time: (quotient, its last zeros), position and window."""
    skipped = np.zeros(len(at), np.int64)
    far = q == 16
    while far.any():
        skipped += 16 * far
        at = at + 16 * far
        x = wide[at >> 3] << (at & 7).view(np.uint64)
        z = _CLZ16[(x >> np.uint64(48)).view(np.int64)]
        q = np.where(far, z, q)
        far &= z == 16
    return (q + skipped, q), at, x


def flac_encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: its id, `n_bytes` of the text in UTF-8, `payload_bytes` padded with zeros to
    a positive multiple of 64, and the FLAC stream `media`."""
    ready(df.sparkSession)
    source = df.select(df[id_col].alias("id"), df[text_col].alias("text"))

    def run(batches):
        for batch in tx.gathered(batches, BATCH_BYTES):
            data, off = tx.utf8(batch.column(1))
            for a, b in tx.chunks(off, BATCH_BYTES):
                n = np.diff(off[a : b + 1])
                padded = np.maximum(PAD, -(-n // PAD) * PAD)
                to = np.append(0, np.cumsum(padded))
                payload = np.zeros(int(to[-1]), np.uint8)
                payload[np.repeat(to[:-1] - (off[a:b] - off[a]), n) + np.arange(int(n.sum()))] = data[off[a] : off[b]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(padded, pa.int64()), pa.array(encode_streams(payload, to), pa.binary())], ["id", "n_bytes", "payload_bytes", "media"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, media binary").withColumnRenamed("id", id_col)


def _decoded(batch, media_col: int):
    """The batch in slices of about BATCH_BYTES of media, each with its streams and their samples."""
    media = batch.column(media_col).fill_null(b"")
    _, off = tx.utf8(media)
    for a, b in tx.chunks(off, BATCH_BYTES):
        part = batch.slice(a, b - a)
        streams = media.slice(a, b - a).to_pylist()
        yield part, streams, *decode_streams(streams)


def flac_blocks(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: the id, `sample_offset`, `n_samples` and the bytes `pcm` (the payload).
    Rows with a null stream are left out; a damaged stream fails the job."""
    ready(df.sparkSession)
    source = df.where(df[media_col].isNotNull()).select(df[id_col].alias("id"), df[media_col].alias("media"))

    def run(batches):
        for batch in tx.gathered(batches, BATCH_BYTES):
            for part, _, samples, off, doc, sample, ranked in _decoded(batch, 1):
                pcm = expanded(samples, off, ranked).tobytes()
                at = off[doc] + sample
                end = np.append(at[1:], len(pcm))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(sample), pa.array((end - at).astype(np.int32)), pa.array([pcm[x:y] for x, y in zip(at.tolist(), end.tolist())], pa.binary())], ["id", "sample_offset", "n_samples", "pcm"])

    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, sample_offset long, n_samples int, pcm binary").withColumnRenamed("id", id_col)


def flac_features(df: DataFrame) -> DataFrame:
    """Decode the streams of flac_encode and give digests and whole-number features of each."""
    ready(df.sparkSession)

    def run(batches):
        for batch in tx.gathered(batches, BATCH_BYTES):
            for part, streams, samples, off, _, _, ranked in _decoded(batch, 3):
                pcm = expanded(samples, off, ranked).tobytes()
                s = samples.astype(np.int64)
                sign = np.signbit(s).astype(np.int64)
                turns = np.abs(np.diff(sign, prepend=sign[:1]))
                turns[off[1:-1]] = 0
                energy, peak, crossings = np.add.reduceat(s * s, off[:-1]), np.maximum.reduceat(np.abs(s), off[:-1]), np.add.reduceat(turns, off[:-1])
                spans = list(zip(off[:-1].tolist(), off[1:].tolist()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array(np.diff(off), pa.int64()),
                        pa.array([hashlib.sha256(pcm[a:b]).hexdigest() for a, b in spans], pa.string()),
                        pa.array([zlib.crc32(pcm[b - 64 : b]) for _, b in spans], pa.int64()),
                        pa.array([len(x) for x in streams], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in streams], pa.string()),
                        pa.array([f"energy={e} peak={p} crossings={c}" for e, p, c in zip(energy.tolist(), peak.tolist(), crossings.tolist())], pa.string()),
                    ],
                    ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    return df.select("doc_id", "n_bytes", "payload_bytes", "media").mapInArrow(
        run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op2_flac(spark, sf_dir: str) -> DataFrame:
    return flac_features(written(flac_encode(table(spark, sf_dir, "documents")), "op2-media"))
