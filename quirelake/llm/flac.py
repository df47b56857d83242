"""FLAC, one channel: frames of many streams are coded and decoded side by side with numpy.

Step t of the decoder reads the t-th residual of every frame that still has one, so a batch costs as
many steps as its longest frame has samples. Frames start where the seek table says, or, where a
table doesn't cover a stream, one after the other.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np

BLOCK = 1024
RATE = 8000
BITS = 8
LINEAR = 4  # order of the linear predictors that are fitted
SLICE = 1 << 20  # samples coded, and frames of as many samples decoded, at a time


def _crc_table(poly: int, width: int, index_bits: int) -> np.ndarray:
    """Remainders of all values of ``index_bits`` bits (8 or 16), most significant bit first."""
    value = np.arange(1 << index_bits, dtype=np.uint32) << max(0, width - index_bits)
    top, mask = np.uint32(1 << (max(width, index_bits) - 1)), np.uint32((1 << width) - 1)
    for _ in range(index_bits):
        value = np.where(value & top, (value << 1) ^ poly, value << 1)
    return (value & mask).astype(np.uint32)


_CRC8 = _crc_table(0x07, 8, 8)
_CRC16_BYTE = _crc_table(0x8005, 16, 8)
_CRC16_WORD = _crc_table(0x8005, 16, 16)


def crc8(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), np.uint32)
    for i in range(int(sizes.max(initial=0))):
        on = sizes > i
        out[on] = _CRC8[out[on] ^ raw[starts[on] + i]]
    return out


def crc16(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of the byte ranges, two bytes a step; ranges in order of falling size share the steps."""
    order = np.argsort(-sizes, kind="stable")
    s, n, out = starts[order], sizes[order], np.zeros(len(starts), np.uint32)
    counts = np.searchsorted(-n, -2 * np.arange(1, int(n.max(initial=0)) // 2 + 1), side="right")
    for i, m in enumerate(counts.tolist()):
        at = s[:m] + 2 * i
        out[:m] = _CRC16_WORD[out[:m] ^ (raw[at].astype(np.uint32) << 8 | raw[at + 1])]
    odd = np.flatnonzero(n & 1)
    last = raw[s[odd] + n[odd] - 1]
    out[odd] = (out[odd] << 8 & 0xFFFF) ^ _CRC16_BYTE[out[odd] >> 8 ^ last]
    back = np.empty_like(out)
    back[order] = out
    return back


def _number(n: int) -> bytes:
    """A frame number in the extended UTF-8 form."""
    if n < 0x80:
        return bytes([n])
    for size, lead in ((2, 0xC0), (3, 0xE0), (4, 0xF0), (5, 0xF8), (6, 0xFC), (7, 0xFE)):
        if n < 1 << (5 * size + 1):
            return bytes([lead | (n >> 6 * (size - 1)) if size < 7 else lead, *[0x80 | (n >> 6 * k & 0x3F) for k in range(size - 2, -1, -1)]])
    raise ValueError("frame number too large")


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def fit(x: np.ndarray, first: np.ndarray, n: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (12 bits) and shift of a linear predictor for each frame: Levinson's recursion on its autocorrelation."""
    y = x.astype(np.float64)
    lags = []
    for lag in range(order + 1):
        product = y * np.concatenate([np.zeros(lag), y[: len(y) - lag]])
        for i in range(lag):  # these reach into the frame before
            product[first[n > i] + i] = 0
        lags.append(np.add.reduceat(product, first))
    a, error = np.zeros((order, len(n))), np.maximum(lags[0], 1e-9) * (1 + 1e-9)
    for i in range(order):
        k = (lags[i + 1] - sum(a[j] * lags[i - j] for j in range(i))) / error
        k = np.clip(k, -0.9999, 0.9999)
        head = a[:i] - k * a[:i][::-1]
        a[:i], a[i] = head, k
        error = error * (1 - k * k)
    shift = np.clip(10 - np.ceil(np.log2(np.maximum(np.abs(a).max(axis=0), 2.0**-5))), 0, 15).astype(np.int64)
    return np.clip(np.round(a * 2.0**shift), -2048, 2047).astype(np.int32), shift


def encode(payloads: list[bytes], block: int = BLOCK, max_order: int = 2, lpc: tuple[list[int], int] | None = None, linear: int = 0) -> list[bytes]:
    """One stream for each payload of unsigned bytes. Every frame takes the smallest of a constant, plain samples, and
    the Rice code of the residuals of fixed predictors up to ``max_order``, of ``lpc`` (coefficients, shift), or of a
    predictor of order ``linear`` that is fitted to the frame. Long payloads are coded in slices of whole frames."""
    step = max(SLICE // block, 1) * block
    pieces = [(i, at, p[at : at + step]) for i, p in enumerate(payloads) for at in range(0, len(p), step)]
    parts: list[list[tuple]] = [[] for _ in payloads]
    held, size = [], 0
    for j, piece in enumerate(pieces):
        held.append(piece)
        size += len(piece[2])
        if size >= SLICE or j == len(pieces) - 1:
            coded = _frames([p for _, _, p in held], [at // block for _, at, _ in held], block, max_order, lpc, linear)
            for (i, _, _), c in zip(held, coded, strict=True):
                parts[i].append(c)
            held, size = [], 0
    out = []
    for p, mine in zip(payloads, parts, strict=True):
        frames = b"".join(raw for raw, _, _ in mine)
        sizes, counts = [x for _, s, _ in mine for x in s], [x for _, _, c in mine for x in c]
        out.append(_stream(p, _starts(np.array(sizes, np.int64))[:-1].tolist(), counts, sizes) + frames)
    return out


def _frames(payloads: list[bytes], numbers: list[int], block: int, max_order: int, lpc: tuple[list[int], int] | None, linear: int) -> list[tuple[bytes, list[int], list[int]]]:
    """Frames of each payload, numbered from the given numbers on: their bytes, sizes and sample counts."""
    sizes = np.array([len(p) for p in payloads], np.int64)
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    x = joined.astype(np.int32) - 128
    per = -(-sizes // block)
    stream = np.repeat(np.arange(len(payloads)), per)
    within = np.arange(len(stream)) - np.repeat(_starts(per)[:-1], per)
    number = within + np.repeat(np.array(numbers, np.int64), per)
    n = np.minimum(block, sizes[stream] - within * block)
    first = _starts(sizes)[stream] + within * block  # frames in order cover all samples without gaps
    place = np.arange(len(x)) - np.repeat(first, n)
    frames = len(n)

    best, kind, rice = 8 * n + 8, np.full(frames, 1), np.zeros(frames, np.int64)  # plain samples
    models = [(o, None) for o in range(max_order + 1)]
    if lpc:
        models.append((len(lpc[0]), (np.repeat(np.array(lpc[0], np.int32)[:, None], frames, axis=1), np.full(frames, lpc[1]))))
    elif linear:
        models.append((linear, fit(x, first, n, linear)))
    residuals, current = [], x
    for order, weights in models:
        if weights:
            guess = sum(np.repeat(c, n) * np.concatenate([np.zeros(j + 1, np.int32), x])[: len(x)] for j, c in enumerate(weights[0]))
            r = x - (guess >> np.repeat(weights[1].astype(np.int32), n))
        else:
            if order:
                current = np.concatenate([current[:1], current[1:] - current[:-1]])
            r = current
        u = np.where(place >= order, (r << 1) ^ (r >> 31), 0)
        total, count = np.add.reduceat(u, first), np.maximum(n - order, 1)
        k = np.clip(np.floor(np.log2(np.maximum(total / count, 1))).astype(np.int64), 0, 14)
        head = 8 + 8 * order + 10 + ((9 + 12 * order) if weights else 0)
        for guess_k in (k, np.maximum(k - 1, 0)):
            cost = np.add.reduceat(u >> np.repeat(guess_k, n), first) + (n - order) * (1 + guess_k) + head
            better = (cost < best) & (n > order)
            best, rice = np.where(better, cost, best), np.where(better, guess_k, rice)
            kind = np.where(better, 32 + order - 1 if weights else 8 + order, kind)
        residuals.append(u)
    same = np.maximum.reduceat(x, first) == np.minimum.reduceat(x, first)
    kind, best = np.where(same, 0, kind), np.where(same, 16, best)

    heads = [b"\xff\xf8" + bytes([0x74, 0x00 | 0x02]) + _number(int(i)) + int(m - 1).to_bytes(2, "big") for i, m in zip(number, n, strict=True)]
    head_size = np.array([len(h) + 1 for h in heads], np.int64)
    frame_size = head_size + -(-best // 8) + 2
    at = _starts(frame_size)
    bits = np.zeros(int(at[-1]) * 8, np.uint8)
    body = (at[:-1] + head_size) * 8
    _put(bits, body, kind << 1, 8)
    for f in np.flatnonzero(kind == 0).tolist():
        _put(bits, body[f : f + 1] + 8, joined[first[f] : first[f] + 1].astype(np.int64) ^ 128, 8)
    order = np.where(kind >= 32, kind - 31, np.where(kind >= 8, kind - 8, 0))
    for w in range(int(order.max(initial=0))):
        who = np.flatnonzero(order > w)
        _put(bits, body[who] + 8 + 8 * w, joined[first[who] + w].astype(np.int64) ^ 128, 8)
    after = body + 8 + 8 * order
    who = np.flatnonzero(kind >= 32)
    if len(who):
        coefficients, shifts = models[-1][1]
        _put(bits, after[who], np.full(len(who), 11), 4)
        _put(bits, after[who] + 4, shifts[who], 5)
        for j, c in enumerate(coefficients):
            _put(bits, after[who] + 9 + 12 * j, c[who] & 0xFFF, 12)
        after = after + np.where(kind >= 32, 9 + 12 * order, 0)
    coded = kind >= 8
    _put(bits, after[coded] + 6, rice[coded], 4)  # method 0, one partition, its parameter
    for (o, weights), u in zip(models, residuals, strict=True):
        chosen = kind == (32 + o - 1 if weights else 8 + o)
        take = np.repeat(chosen, n) & (place >= o)
        if not take.any():
            continue
        v, k = u[take].astype(np.int64), np.repeat(rice, n)[take]
        q = v >> k
        width = q + 1 + k
        ends = np.cumsum(width)
        counts = np.where(chosen, n - o, 0)
        base = np.repeat(_starts(counts)[:-1], counts)  # index of the frame's first residual among those taken
        begin = ends - width
        start = np.repeat(after + 10, counts) + begin - begin[base]
        bits[start + q] = 1
        for j in range(int(k.max(initial=0))):
            low = k > j
            bits[(start + q + k - j)[low]] = v[low] >> j & 1
    raw = np.packbits(bits)
    for f in np.flatnonzero(kind == 1).tolist():
        raw[at[f] + head_size[f] + 1 : at[f] + head_size[f] + 1 + n[f]] = joined[first[f] : first[f] + n[f]] ^ 128
    flat, lead = np.frombuffer(b"".join(heads), np.uint8), head_size - 1
    raw[np.arange(len(flat)) + np.repeat(at[:-1] - _starts(lead)[:-1], lead)] = flat
    raw[at[:-1] + lead] = crc8(raw, at[:-1], lead)
    check = crc16(raw, at[:-1], frame_size - 2)
    raw[at[1:] - 2], raw[at[1:] - 1] = check >> 8, check & 0xFF
    whole, edge = raw.tobytes(), _starts(per).tolist()
    return [(whole[at[a] : at[b]], frame_size[a:b].tolist(), n[a:b].tolist()) for a, b in zip(edge[:-1], edge[1:], strict=True)]


def _stream(payload: bytes, offsets: list[int], counts: list[int], sizes: list[int]) -> bytes:
    """Everything before the frames: marker, stream information, a seek point for every frame."""
    least, most = (min(counts[:-1] or counts), max(counts)) if counts else (16, 16)
    digest = hashlib.md5(bytes(np.frombuffer(payload, np.uint8) ^ 128)).digest()
    packed = (RATE << 44 | 0 << 41 | (BITS - 1) << 36 | len(payload)).to_bytes(8, "big")
    info = max(least, 16).to_bytes(2, "big") + max(most, 16).to_bytes(2, "big") + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big") + packed + digest
    samples = _starts(np.array(counts, np.int64))
    points = b"".join(int(s).to_bytes(8, "big") + int(o).to_bytes(8, "big") + int(c).to_bytes(2, "big") for s, o, c in zip(samples, offsets, counts))  # noqa: B905
    return b"fLaC\x00" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


@dataclass
class Header:
    total: int
    md5: bytes
    bits: int
    data: int  # where the frames begin
    points: list[tuple[int, int, int]]


def header(raw: bytes) -> Header:
    """Metadata of one stream; raises ValueError where it isn't one."""
    if raw[:4] != b"fLaC":
        raise ValueError("no FLAC marker")
    at, last, found, points = 4, False, None, []
    while not last:
        last, kind, size = bool(raw[at] & 0x80), raw[at] & 0x7F, int.from_bytes(raw[at + 1 : at + 4], "big")
        body = raw[at + 4 : at + 4 + size]
        at += 4 + size
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            found = packed & (1 << 36) - 1, body[18:34], (packed >> 36 & 31) + 1, (packed >> 41 & 7) + 1
        elif kind == 3:
            points = [(int.from_bytes(body[i : i + 8], "big"), int.from_bytes(body[i + 8 : i + 16], "big"), int.from_bytes(body[i + 16 : i + 18], "big")) for i in range(0, size, 18)]
            points = [p for p in points if p[0] != (1 << 64) - 1]
    if found is None or found[3] != 1:
        raise ValueError("one channel is read")
    return Header(found[0], found[1], found[2], at, points)


class _Reader:
    """Bit reads at many positions of one buffer."""

    def __init__(self, raw: bytes):
        padded = np.frombuffer(raw + bytes(16), np.uint8)
        self.bytes = padded
        self.words = np.ndarray(len(padded) - 7, ">u8", padded, 0, (1,))

    def peek(self, pos: np.ndarray) -> np.ndarray:
        """At least 57 bits from each position, left-aligned."""
        at = np.minimum(pos >> 3, len(self.words) - 1)
        return self.words[at].astype(np.uint64) << (pos & 7).astype(np.uint64)

    def take(self, pos: np.ndarray, width) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.int64), pos.shape)
        value = self.peek(pos) >> (64 - np.maximum(width, 1)).astype(np.uint64)
        return np.where(width > 0, value, 0).astype(np.int64)

    def signed(self, pos: np.ndarray, width) -> np.ndarray:
        value = self.take(pos, width)
        return value - ((value >> (np.maximum(np.asarray(width), 1) - 1) & 1) << np.asarray(width))

    def zeros(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length of the run of zeros, and the position behind the one that ends it."""
        count = np.zeros(len(pos), np.int64)
        rest = np.arange(len(pos))
        while True:
            top = (self.peek(pos[rest] + count[rest]) >> np.uint64(32)).astype(np.float64)
            count[rest] += 32 - np.frexp(top)[1]
            rest = rest[(top == 0) & (pos[rest] + count[rest] < len(self.bytes) * 8)]
            if not len(rest):
                return count, pos + count + 1


def decode_frames(raw: bytes, starts: np.ndarray, bits: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Samples, frame numbers, ends and whether both checksums hold, for frames that begin at the given bytes."""
    reader, buf = _Reader(raw), np.frombuffer(raw + bytes(16), np.uint8)
    starts = np.asarray(starts, np.int64)
    code = buf[starts + 2] >> 4
    lead = buf[starts + 4]
    extra = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, 1, 2, 3, 4, 5], 6)
    at = starts + 5 + extra
    number = np.where(extra == 0, lead, lead & (0x3F >> np.minimum(extra, 6))).astype(np.int64)
    for j in range(6):
        number = np.where(extra > j, number << 6 | (buf[starts + 5 + j] & 0x3F), number)
    wide = buf[at].astype(np.int64) << 8 | buf[at + 1]
    n = np.select([code == 1, code < 6, code == 6, code == 7], [192, 576 << np.maximum(code.astype(np.int64) - 2, 0), buf[at].astype(np.int64) + 1, wide + 1], 256 << np.maximum(code.astype(np.int64) - 8, 0))
    at = at + np.where(code == 6, 1, np.where(code == 7, 2, 0))
    rate = buf[starts + 2] & 15
    at = at + np.where(rate == 12, 1, np.where((rate == 13) | (rate == 14), 2, 0))
    good = (buf[starts] == 0xFF) & (buf[starts + 1] & 0xFE == 0xF8) & (code > 0) & (crc8(buf, starts, at - starts) == buf[at])
    n = np.where(good, n, 0)
    depth = buf[starts + 3] >> 1 & 7
    bits = np.select([depth == 1, depth == 4], [8, 16], bits)

    pos = (at + 1) * 8
    kind = reader.take(pos, 8) >> 1
    good &= (reader.take(pos, 8) & 0x81 == 0) & ((kind <= 1) | ((kind >= 8) & (kind <= 12)) | (kind >= 32))
    n = np.where(good, n, 0)
    pos = pos + 8
    # frames in order of falling size: at sample i the first m have one
    rank = np.argsort(-n, kind="stable")
    pos, n_, kind_, bits_ = pos[rank], n[rank], kind[rank], bits[rank]
    longest = int(n_.max(initial=0))
    out = np.zeros((longest, len(n_)), np.int64)
    order = np.where(kind_ >= 32, kind_ - 31, np.where(kind_ >= 8, kind_ - 8, 0))
    flat = np.flatnonzero((kind_ == 0) & (n_ > 0))
    if len(flat):
        out[:, flat] = reader.signed(pos[flat], bits_[flat])[None, :] * (np.arange(longest)[:, None] < n_[flat])
        pos[flat] += bits_[flat]
    for f in np.flatnonzero((kind_ == 1) & (n_ > 0)).tolist():
        where = pos[f] + np.arange(n_[f]) * bits_[f]
        if bits_[f] == 8 and pos[f] % 8 == 0:
            out[: n_[f], f] = buf[pos[f] >> 3 : (pos[f] >> 3) + n_[f]].view(np.int8)
        else:
            out[: n_[f], f] = reader.signed(where, np.full(len(where), bits_[f]))
        pos[f] += n_[f] * bits_[f]
    for w in range(int(order.max(initial=0))):
        who = np.flatnonzero((order > w) & (n_ > w))
        out[w, who] = reader.signed(pos[who], bits_[who])
        pos[who] += bits_[who]
    precision, shift, weights = np.zeros(len(n_), np.int64), np.zeros(len(n_), np.int64), np.zeros((32, len(n_)), np.int64)
    who = np.flatnonzero((kind_ >= 32) & (n_ > 0))
    if len(who):
        precision[who], shift[who] = reader.take(pos[who], 4) + 1, reader.signed(pos[who] + 4, np.full(len(who), 5))
        pos[who] += 9
        for j in range(int(order[who].max())):
            w = who[order[who] > j]
            weights[j, w] = reader.signed(pos[w], precision[w])
            pos[w] += precision[w]
    _residuals(reader, out, np.flatnonzero((kind_ >= 8) & (n_ > 0)), pos, n_, order)
    _restore(out, np.flatnonzero((kind_ >= 8) & (kind_ < 32)), order)
    for o in np.unique(order[who]).tolist():
        w = who[order[who] == o]
        for i in range(o, longest):
            guess = sum(weights[j, w] * out[i - 1 - j, w] for j in range(o))
            out[i, w] += guess >> shift[w]
    ends_ = (pos + 7) >> 3
    ends = np.empty_like(ends_)
    ends[rank] = ends_
    ends = np.minimum(ends, len(buf) - 2)
    stored = buf[ends].astype(np.uint32) << 8 | buf[ends + 1]
    good &= crc16(buf, starts, np.where(good, ends - starts, 0)) == stored
    columns = np.ascontiguousarray(out.T)
    samples = [None] * len(n)
    for i, f in enumerate(rank.tolist()):
        samples[f] = columns[i, : n_[i]]
    return samples, number, ends + 2, good


def _residuals(reader: _Reader, out: np.ndarray, who: np.ndarray, pos: np.ndarray, n: np.ndarray, order: np.ndarray) -> None:
    """Rice residuals of the frames ``who`` (falling size) into ``out``; moves ``pos`` behind them."""
    if not len(who):
        return
    p, size, first = pos[who], n[who], order[who]
    wide = reader.take(p, 2)  # 0: parameters of 4 bits, 1: of 5
    width, parts = 4 + wide, reader.take(p + 2, 4)
    p = p + 6
    part = size >> parts
    k, raw = np.zeros(len(who), np.int64), np.full(len(who), -1, np.int64)
    low = int(first.min())
    counts = np.searchsorted(-size, -np.arange(1, len(out) + 1), side="right")
    simple = bool((parts == 0).all())
    escaped = False
    for i in range(low, int(size[0])):
        m = int(counts[i])
        begins = np.flatnonzero((first[:m] == i) | ((first[:m] < i) & (i % np.maximum(part[:m], 1) == 0))) if i <= 32 or not simple else ()
        if len(begins):
            k[begins] = reader.take(p[begins], width[begins])
            p[begins] += width[begins]
            esc = begins[k[begins] == (1 << width[begins]) - 1]
            raw[begins] = -1
            raw[esc] = reader.take(p[esc], np.full(len(esc), 5))
            p[esc] += 5
            escaped = bool((raw >= 0).any())
        if escaped or i < 32:
            live = np.flatnonzero(first[:m] <= i)
            plain = live[raw[live] >= 0]
            if len(plain):
                out[i, who[plain]] = np.where(raw[plain] > 0, reader.signed(p[plain], raw[plain]), 0)
                p[plain] += raw[plain]
            coded = live[raw[live] < 0]
        else:
            coded = slice(0, m)
        at = p[coded]
        if not len(at):
            continue
        kk = k[coded]
        word = reader.peek(at)
        top = (word >> np.uint64(32)).astype(np.float64)
        q = (32 - np.frexp(top)[1]).astype(np.int64)
        if (top == 0).any():
            q, _ = reader.zeros(at)
            u = q << kk | reader.take(at + q + 1, kk)
        else:
            u = (q << kk) | ((word << (q + 1).astype(np.uint64)) >> np.uint64(1) >> (63 - kk).astype(np.uint64)).astype(np.int64)
        p[coded] = at + q + 1 + kk
        out[i, who[coded]] = (u >> 1) ^ -(u & 1)
    pos[who] = p


def _restore(out: np.ndarray, who: np.ndarray, order: np.ndarray) -> None:
    """Fixed predictors: as many running sums as the order, each from the last difference of the first samples."""
    for o in np.unique(order[who]).tolist():
        if not o:
            continue
        w = who[order[who] == o]
        part = out[:, w]
        y = part[o:]
        for j in range(o, 0, -1):
            last = np.diff(part[:o], n=j - 1, axis=0)[-1] if part[:o].shape[0] >= j else 0
            y = last + np.cumsum(y, axis=0)
        out[o:, w] = y


@dataclass
class Decoded:
    samples: np.ndarray  # signed, 16 bits wide for streams of up to 8 bits, else 32
    blocks: list[tuple[int, int]]  # (sample offset, samples) of each frame
    ok: bool  # all frame checksums and the digest hold
    error: str = ""
    bits: int = 8


def _narrow(samples: np.ndarray, bits: int) -> np.ndarray:
    return samples.astype(np.int16 if bits <= 8 else np.int32)


def decode(streams: list[bytes]) -> list[Decoded]:
    """Each stream's samples. A damaged one has ``ok`` false and the samples before the damage."""
    heads: list[Header | None] = []
    for raw in streams:
        try:
            heads.append(header(raw))
        except (ValueError, IndexError):
            heads.append(None)
    joined, base = b"".join(streams), _starts(np.array([len(s) for s in streams], np.int64))
    frames: list[list[tuple[int, np.ndarray, bool]]] = [[] for _ in streams]
    listed, owner, walk = [], [], []
    for i, h in enumerate(heads):
        if h is None or not h.total:
            continue
        offsets = [o for _, o, _ in h.points]
        if sum(c for _, _, c in h.points) == h.total and sorted(set(offsets)) == offsets and offsets[-1] < len(streams[i]) - h.data:
            listed += [int(base[i]) + h.data + o for _, o, _ in h.points]
            owner += [i] * len(h.points)
        else:
            walk.append((i, int(base[i]) + h.data))
    for at in range(0, len(listed), SLICE // BLOCK):
        mine = owner[at : at + SLICE // BLOCK]
        lowest, highest = listed[at], int(base[mine[-1] + 1]) if at + len(mine) == len(listed) else listed[at + len(mine)]
        samples, _, _, good = decode_frames(joined[lowest:highest], np.array(listed[at : at + len(mine)]) - lowest, np.array([heads[i].bits for i in mine], np.int64))
        for i, s, g in zip(mine, samples, good.tolist(), strict=True):
            frames[i].append((0, _narrow(s, heads[i].bits), g))
    while walk:
        samples, _, ends, good = decode_frames(joined, np.array([a for _, a in walk]), np.array([heads[i].bits for i, _ in walk], np.int64))
        after = []
        for (i, _), s, e, g in zip(walk, samples, ends.tolist(), good.tolist(), strict=True):
            frames[i].append((0, _narrow(s, heads[i].bits), g))
            if g and e < base[i + 1] and sum(len(x) for _, x, _ in frames[i]) < heads[i].total:
                after.append((i, e))
        walk = after
    out = []
    for h, parts in zip(heads, frames, strict=True):
        if h is None:
            out.append(Decoded(np.zeros(0, np.int16), [], False, "not a stream of one channel"))
            continue
        bad = next((j for j, (_, _, g) in enumerate(parts) if not g), len(parts))
        whole = np.concatenate([np.zeros(0, np.int16), *[s for _, s, _ in parts[:bad]]])
        sizes = [len(s) for _, s, _ in parts[:bad]]
        kept = whole.astype(np.int8 if h.bits <= 8 else "<i2").tobytes()
        ok = bad == len(parts) and len(whole) == h.total and (h.md5 == bytes(16) or hashlib.md5(kept).digest() == h.md5)
        out.append(Decoded(whole, list(zip(_starts(np.array(sizes, np.int64))[:-1].tolist(), sizes, strict=True)), ok, "" if ok else "checksum", h.bits))
    return out
