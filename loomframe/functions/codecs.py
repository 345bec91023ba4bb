"""Byte codecs that are serial within a payload, run over Arrow batches: CRC-32C, LEB128, rANS, linear prediction, zero runs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The Castagnoli polynomial (reversed), and scale and lower bound of the range coder.
CASTAGNOLI, SCALE_BITS, LOW = 0x82F63B78, 12, 1 << 23


def crc_table(polynomial: int = CASTAGNOLI) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(polynomial), t >> 1).astype(np.uint32)
    return t


_table = crc_table()
_entries = _table.tolist()
#: Bytes from which a checksum is worked out in lanes.
LANES_FROM = 1024


@lru_cache(maxsize=64)
def zero_shift(n: int) -> tuple[int, ...]:
    """What n zero bytes make of each bit of a checksum's state: 32 columns of a matrix over bits."""
    if n == 1:
        return tuple(int(_table[(1 << b) & 255]) ^ ((1 << b) >> 8) for b in range(32))
    half = zero_shift(n // 2)
    twice = tuple(shifted(half, c) for c in half)
    return tuple(shifted(zero_shift(1), c) for c in twice) if n % 2 else twice


def shifted(columns: tuple[int, ...], state):
    """A state, or an array of them, through a matrix of bits."""
    out = state & 0
    for b, c in enumerate(columns):
        out = out ^ (((state >> b) & 1) * c)
    return out


def crc32c(data: bytes) -> int:
    """Lanes of longer data are summed side by side and put together by halves: zeros before the data change nothing."""
    n = len(data)
    if n < LANES_FROM:
        c = 0xFFFFFFFF
        for b in data:
            c = _entries[(c ^ b) & 255] ^ (c >> 8)
        return c ^ 0xFFFFFFFF
    lanes = 1 << max(0, n.bit_length() // 2)
    width = -(-n // lanes)
    m = np.zeros(lanes * width, np.uint8)
    m[lanes * width - n :] = np.frombuffer(data, np.uint8)
    m = m.reshape(lanes, width)
    c = np.zeros(lanes, np.uint32)
    for k in range(width):
        c = _table[(c ^ m[:, k]) & 255] ^ (c >> np.uint32(8))
    c = c.astype(np.int64)
    while len(c) > 1:
        c = shifted(zero_shift(width), c[::2]) ^ c[1::2]
        width *= 2
    return int(c[0]) ^ shifted(zero_shift(n), 0xFFFFFFFF) ^ 0xFFFFFFFF


def crc32c_many(payloads: list[bytes]) -> np.ndarray:
    """All payloads at once, one byte of each in a step."""
    size = np.array([len(p) for p in payloads])
    width = int(size.max(initial=0))
    m = np.zeros((len(payloads), width), np.uint8)
    m[np.arange(width) < size[:, None]] = np.frombuffer(b"".join(payloads), np.uint8)
    c = np.full(len(payloads), 0xFFFFFFFF, np.uint32)
    for k in range(width):
        live = size > k
        c[live] = _table[(c[live] ^ m[live, k]) & 255] ^ (c[live] >> np.uint32(8))
    return c ^ np.uint32(0xFFFFFFFF)


def write_varint(n: int) -> bytes:
    """LEB128 of an unsigned number."""
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int = 0) -> tuple[int, int]:
    """A number and the place after it. Fails where bytes are missing or over ten."""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("a varint has no end")
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(u: int) -> int:
    return u >> 1 if u % 2 == 0 else -(u >> 1) - 1


class RangeModel:
    """Frequencies of symbols that add to 2 ** SCALE_BITS."""

    def __init__(self, frequencies: list[int]):
        if not frequencies or min(frequencies) < 1 or sum(frequencies) != 1 << SCALE_BITS:
            raise ValueError("frequencies must be positive and add to the scale")
        self.f = frequencies
        self.start = np.concatenate(([0], np.cumsum(frequencies))).tolist()
        self.symbol = np.repeat(np.arange(len(frequencies)), frequencies).tolist()

    @classmethod
    def uniform(cls, n: int) -> RangeModel:
        return cls([(1 << SCALE_BITS) // n] * n)

    def encode(self, symbols: list[int]) -> bytes:
        """The last state, least byte first, and then the bytes that the decoder takes in."""
        x, spilled = LOW, bytearray()
        for s in reversed(symbols):
            while x >= ((LOW >> SCALE_BITS) << 8) * self.f[s]:
                spilled.append(x & 255)
                x >>= 8
            x = (x // self.f[s] << SCALE_BITS) + x % self.f[s] + self.start[s]
        return x.to_bytes(4, "little") + bytes(reversed(spilled))

    def decode(self, data: bytes, n: int) -> list[int]:
        if len(data) < 4:
            raise ValueError("the stream has no state")
        x, at, out = int.from_bytes(data[:4], "little"), 4, []
        for _ in range(n):
            slot = x & ((1 << SCALE_BITS) - 1)
            s = self.symbol[slot]
            out.append(s)
            x = self.f[s] * (x >> SCALE_BITS) + slot - self.start[s]
            while x < LOW:
                if at >= len(data):
                    raise ValueError("the stream ends too soon")
                x, at = x << 8 | data[at], at + 1
        return out


def encode_contexts(models: list[RangeModel], contexts: list[int], symbols: list[int]) -> bytes:
    """Symbols through one state, each by the model of its context."""
    x, spilled = LOW, bytearray()
    for c, s in zip(reversed(contexts), reversed(symbols), strict=True):
        m = models[c]
        while x >= ((LOW >> SCALE_BITS) << 8) * m.f[s]:
            spilled.append(x & 255)
            x >>= 8
        x = (x // m.f[s] << SCALE_BITS) + x % m.f[s] + m.start[s]
    return x.to_bytes(4, "little") + bytes(reversed(spilled))


def decode_contexts(models: list[RangeModel], n: int, context_of, data: bytes) -> list[int]:
    """The symbols again; context_of tells each one's context from those before it."""
    if len(data) < 4:
        raise ValueError("the stream has no state")
    x, at, out = int.from_bytes(data[:4], "little"), 4, []
    for _ in range(n):
        m = models[context_of(out)]
        slot = x & ((1 << SCALE_BITS) - 1)
        s = m.symbol[slot]
        out.append(s)
        x = m.f[s] * (x >> SCALE_BITS) + slot - m.start[s]
        while x < LOW:
            if at >= len(data):
                raise ValueError("the stream ends too soon")
            x, at = x << 8 | data[at], at + 1
    return out


def pack_bits(values: list[tuple[int, int]]) -> bytes:
    """Numbers of given widths one after the other, highest bit first, padded with zeros to whole bytes."""
    n = bits = 0
    for v, width in values:
        if v < 0 or v >> width:
            raise ValueError("a number is too wide")
        n, bits = n << width | v, bits + width
    return (n << -bits % 8).to_bytes(-(-bits // 8), "big")


def unpack_bits(data: bytes, widths: list[int]) -> list[int]:
    n, left, out = int.from_bytes(data, "big"), 8 * len(data), []
    for w in widths:
        left -= w
        if left < 0:
            raise ValueError("bits are missing")
        out.append(n >> left & (1 << w) - 1)
    return out


def levinson(r: list[float]) -> list[float]:
    """Prediction weights from autocorrelations; silence predicts nothing."""
    a, error = [], float(r[0])
    for k in range(1, len(r)):
        if error <= 0:
            return a + [0.0] * (len(r) - 1 - len(a))
        c = (r[k] - sum(w * r[k - 1 - j] for j, w in enumerate(a))) / error
        a = [w - c * v for w, v in zip(a, reversed(a), strict=True)] + [c]
        error *= 1 - c * c
    return a


def lpc_encode(samples: list[int], order: int = 8, shift: int = 12) -> bytes:
    """Order, whole weights and zigzag varints of what the prediction leaves."""
    s = np.array(samples, np.float64)
    weights = levinson([float(s[k:] @ s[: len(s) - k]) if k < len(s) else 0.0 for k in range(order + 1)])
    q = [int(round(w * (1 << shift))) for w in weights]
    out = bytearray(write_varint(order) + write_varint(len(samples)) + b"".join(write_varint(zigzag(w)) for w in q))
    for k, v in enumerate(samples):
        guess = sum(w * samples[k - 1 - j] for j, w in enumerate(q) if k - 1 - j >= 0) >> shift
        out += write_varint(zigzag(v - guess))
    return bytes(out)


def lpc_decode(data: bytes, shift: int = 12) -> list[int]:
    order, at = read_varint(data)
    n, at = read_varint(data, at)
    q = []
    for _ in range(order):
        w, at = read_varint(data, at)
        q.append(unzigzag(w))
    out: list[int] = []
    for k in range(n):
        u, at = read_varint(data, at)
        out.append(unzigzag(u) + (sum(w * out[k - 1 - j] for j, w in enumerate(q) if k - 1 - j >= 0) >> shift))
    return out


def runs_encode(samples: list[int], first: int = 128) -> bytes:
    """Differences as zigzag varints, where a zero is followed by the number of zeros after it."""
    out, k, before = bytearray(), 0, first
    deltas = []
    for v in samples:
        deltas.append(v - before)
        before = v
    while k < len(deltas):
        out += write_varint(zigzag(deltas[k]))
        if deltas[k] == 0:
            n = 0
            while k + 1 < len(deltas) and deltas[k + 1] == 0:
                k, n = k + 1, n + 1
            out += write_varint(n)
        k += 1
    return bytes(out)


def runs_decode(data: bytes, first: int = 128) -> list[int]:
    out, at, before = [], 0, first
    while at < len(data):
        u, at = read_varint(data, at)
        before += unzigzag(u)
        n = 1
        if u == 0:
            more, at = read_varint(data, at)
            n += more
        out += [before] * n
    return out


def round_trips(rows: DataFrame, key: str, at: str, value: str, codec: str) -> DataFrame:
    """Encodes and decodes the values of each key in order: key, n, bytes and whether all came back."""
    ways = {
        "varint": (lambda v: b"".join(write_varint(zigzag(x)) for x in v), _varints),
        "rans": (lambda v: RangeModel.uniform(256).encode([x & 255 for x in v]), lambda d, n: RangeModel.uniform(256).decode(d, n)),
        "contexts": (lambda v: encode_contexts(two_models(), [0, *[(x & 255) >> 7 for x in v[:-1]]][: len(v)], [x & 255 for x in v]), lambda d, n: decode_contexts(two_models(), n, lambda out: out[-1] >> 7 if out else 0, d)),
        "bits": (lambda v: pack_bits([(x & 255, 8 + k % 5) for k, x in enumerate(v)]), lambda d, n: unpack_bits(d, [8 + k % 5 for k in range(n)])),
        "lpc": (lpc_encode, lambda d, n: lpc_decode(d)),
        "runs": (runs_encode, lambda d, n: runs_decode(d)),
    }

    def run(batches):
        encode, decode = ways[codec]
        for pdf in batches:
            sizes, ok = [], []
            for v in pdf["v"]:
                v = [int(x) for x in v]
                data = encode(v)
                sizes.append(len(data))
                ok.append(decode(data, len(v)) == ([x & 255 for x in v] if codec in ("rans", "contexts", "bits") else v))
            yield pd.DataFrame({key: pdf[key], "n": pdf["v"].map(len), "bytes": sizes, "ok": ok})

    own = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v")))).alias("o")).select(key, F.transform("o", lambda x: x["v"]).alias("v"))
    return own.mapInPandas(run, f"{key} long, n long, bytes long, ok boolean")


@lru_cache(maxsize=1)
def two_models() -> list[RangeModel]:
    """Flat frequencies, and those that favour high symbols."""
    return [RangeModel.uniform(256), RangeModel([8] * 128 + [24] * 128)]


def _varints(data: bytes, n: int) -> list[int]:
    out, at = [], 0
    while at < len(data):
        u, at = read_varint(data, at)
        out.append(unzigzag(u))
    return out


@F.pandas_udf(T.LongType())
def crc32c_column(payload: pd.Series) -> pd.Series:
    """CRC-32C of a binary column; null stays null."""
    have = payload.notna()
    out = pd.Series([None] * len(payload), dtype="Int64")
    out[have] = crc32c_many([bytes(p) for p in payload[have]]).astype(np.int64)
    return out
