"""Bloom filters of 64-bit keys, made in one pass and tested by a vectorised function.

Every task sets bits for the keys that it reads and keeps apart the bits that it hit once and
more than once. Only these bitmaps move, as chunks of 2**16 bits and sparse ones as lists of
positions; they are merged by OR, chunk by chunk, and a bit that two tasks hit once each counts as
hit twice. Keys themselves never shuffle. `least=2` keeps bits that were hit twice or more: a key
that occurs twice passes for sure, one that occurs once only if all its bits were hit by others.

The size follows the number of keys (`per_key` bits each) up to MOST_BITS, which is what the driver
and each Python worker may hold (256 MB). Beyond some 10**9 keys a filter of that size lets ever
more single keys through; they then take the exact way and results stay the same. Null keys pass
no filter and set no bit. An empty table makes a filter that nothing passes.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import prepared

CHUNK_BITS = 16
MOST_BITS = 1 << 31
#: Bits a key and places a key. One key in 400 passes the first by chance, one in 9 the second.
FINE, COARSE = (16, 4), (5, 2)


class Bits:
    """A filter of len(words) * 64 bits."""

    def __init__(self, words: np.ndarray, places: int):
        self.words, self.places = words, places

    def has(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in positions(keys, len(self.words) * 64, self.places):
            out &= (self.words[p >> 6] >> (p & 63).astype(ts.U)) & ts.U(1) == 1
        return out


def positions(keys: np.ndarray, bits: int, places: int):
    h = keys.view(ts.U)
    for i in range(places):
        yield (((ts.mix(h + ts.U((0xA0761D6478BD642F * (i + 1)) & (2**64 - 1))) >> ts.U(32)) * ts.U(bits)) >> ts.U(32)).astype(np.int64)


def size_for(keys: int, per_key: int, most: int = MOST_BITS) -> int:
    """In whole chunks."""
    chunk = 1 << CHUNK_BITS
    return max(chunk, min(most, -(-keys * per_key // chunk) * chunk))


def _set(once: np.ndarray, twice: np.ndarray, at: np.ndarray, n: np.ndarray) -> None:
    """Marks sorted distinct positions, hit n times each."""
    word, bit = at >> 6, ts.U(1) << (at & 63).astype(ts.U)
    begins = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    w = word[begins]
    new, again = np.bitwise_or.reduceat(bit, begins), np.bitwise_or.reduceat(np.where(n > 1, bit, ts.U(0)), begins)
    if len(twice):
        twice[w] |= again | (once[w] & new)
    once[w] |= new


def _packed(words: np.ndarray) -> bytes:
    """A chunk as the positions of its bits, or as it is if that is shorter."""
    at = np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")).astype("<u2")
    return at.tobytes() if at.nbytes < words.nbytes else words.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    size = 1 << (CHUNK_BITS - 3)
    if len(data) == size:
        return np.frombuffer(data, ts.U)
    flags = np.zeros(1 << CHUNK_BITS, bool)
    flags[np.frombuffer(data, "<u2")] = True
    return np.packbits(flags, bitorder="little").view(ts.U)


def made(keys: DataFrame, column: str, bits: int, places: int, least: int) -> Bits:
    """The filter of keys' column, a long."""
    spark, step = prepared(keys.sparkSession), 1 << (CHUNK_BITS - 6)

    def own(batches):
        once, twice = np.zeros(bits >> 6, ts.U), np.zeros(bits >> 6 if least > 1 else 0, ts.U)
        for batch in batches:
            k = batch.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(k):
                # a key's places can coincide, which is one hit
                all_of_them = np.sort(np.stack(list(positions(k, bits, places))), axis=0)
                own_first = np.ones(all_of_them.shape, bool)
                own_first[1:] = all_of_them[1:] != all_of_them[:-1]
                _set(once, twice, *np.unique(all_of_them[own_first], return_counts=True))
        for c in range(len(once) // step):
            part = once[c * step : (c + 1) * step]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([_packed(part)], pa.binary()), pa.array([_packed(twice[c * step : (c + 1) * step]) if least > 1 else b""], pa.binary())], ["chunk", "once", "twice"])

    def merged(batches):
        have: dict[int, tuple] = {}
        for batch in batches:
            for c, once, twice in zip(*(batch.column(i).to_pylist() for i in range(3))):
                a, b = have.setdefault(c, (np.zeros(step, ts.U), np.zeros(step, ts.U)))
                new = _unpacked(once)
                if least > 1:
                    b |= _unpacked(twice) | (a & new)
                a |= new
        rows = [(c, (b if least > 1 else a)) for c, (a, b) in have.items()]
        for c, words in rows:
            if words.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([words.tobytes()], pa.binary())], ["chunk", "words"])

    parts = keys.select(column).mapInArrow(own, "chunk int, once binary, twice binary")
    whole = parts.repartition("chunk").mapInArrow(merged, "chunk int, words binary").toArrow()  # bits / 8 bytes at most
    words = np.zeros(bits >> 6, ts.U)
    for c, w in zip(whole["chunk"].to_pylist(), whole["words"].to_pylist()):
        words[c * step : (c + 1) * step] = np.frombuffer(w, ts.U)
    return Bits(words, places)


def repeated(keys: DataFrame, column: str, size=FINE, count: int | None = None, most: int = MOST_BITS) -> Bits:
    """What every key that occurs at least twice passes, and few others. keys is read twice if its
    count isn't given."""
    return made(keys, column, size_for(keys.count() if count is None else count, size[0], most), size[1], 2)


def members(keys: DataFrame, column: str, size=FINE, count: int | None = None, most: int = MOST_BITS) -> Bits:
    """What every key passes, and few others."""
    return made(keys, column, size_for(keys.count() if count is None else count, size[0], most), size[1], 1)


def passes(spark, bits: Bits, key: Column) -> Column:
    """Whether a long passes the filter. Only that column goes to Python."""
    shared = prepared(spark).sparkContext.broadcast((bits.words, bits.places))

    @F.arrow_udf("boolean")
    def test(k: pa.Array) -> pa.Array:
        return pa.array(Bits(*shared.value).has(k.to_numpy(zero_copy_only=False).astype(np.int64)))

    return test(F.coalesce(key, F.lit(0))) & key.isNotNull()
