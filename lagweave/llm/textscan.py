"""Whole Arrow text columns seen as bytes: words, lines and rolling hashes in numpy.

Rows are taken in runs of at most RUN_BYTES (a longer text is a run of its own), so a task's
memory follows the longest text and not the partition.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

RUN_BYTES = 1 << 18
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: A-Z to a-z, all other bytes to themselves.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: every input bit moves every output bit."""
    x = x + U(0x9E3779B97F4A7C15)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, U(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of an odd base modulo 2**64, and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U)

    def at_least(self, n: int) -> "_Powers":
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        return self


_WORDS, _WORDS_2 = _Powers(0xD1342543DE82EF95), _Powers(0xAF251AF3B0F025B5)
#: By bytes that are left: what of an eight-byte block belongs to its span.
_PART = np.array([(1 << (8 * i)) - 1 for i in range(9)], U)
_STEP = U(0x9E3779B97F4A7C55)


def runs(batch: pa.RecordBatch, column: str = "text", limit: int = RUN_BYTES):
    """(first row, rows, bytes, offsets of rows and of the end) for each run of a batch."""
    col = batch.column(column)
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield at, to - at, data[offs[at] : offs[to]], offs[at : to + 1] - offs[at]
        at = to


def words(data: np.ndarray, offs: np.ndarray):
    """(start, end, first word of each row and of the end) of all words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offs[:-1] < offs[1:]
    first[offs[:-1][full]] = inside[offs[:-1][full]]
    last[offs[1:][full] - 1] = inside[offs[1:][full] - 1]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offs)


def rows_of(at: np.ndarray) -> np.ndarray:
    """Row number of each item, from the offsets of rows."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))


def counted(count: np.ndarray) -> np.ndarray:
    """0, 1, ... count[i] - 1 for every i, in a row."""
    at = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(at, count)


def blocks(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(eight-byte blocks of the spans as 64-bit words, the last of each filled up with zeros;
    blocks of each span). Spans are not empty."""
    count = (end - start + 7) >> 3
    begin = np.repeat(start, count) + 8 * counted(count)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    anywhere = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))
    return anywhere[begin] & _PART[np.minimum(np.repeat(end, count) - begin, 8)], count


def block_hashes(words: np.ndarray, count: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of n bytes from its blocks: every block is scrambled together
    with its place before they are added up, so no pattern of letters cancels out."""
    value = mix(words ^ (_STEP * (counted(count).astype(U) + U(1))))
    return mix(np.add.reduceat(value, np.cumsum(count) - count) + n.astype(U) * _STEP)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of the spans, which are sorted, disjoint and not empty."""
    if not len(start):
        return np.zeros(0, U)
    return block_hashes(*blocks(data, start, end), end - start)


def distinct_spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray | None = None):
    """(first of each group of equal spans, group of each span). Hashes find the groups and bytes
    are compared, so the groups are exact. With `of`, spans are equal only within one value of it."""
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = end - start
    words, count = blocks(data, start, end)
    key = block_hashes(words, count, n)
    if of is not None:
        key = mix(key ^ mix(of.astype(U)))
    order = np.argsort(key)
    sorted_key = key[order]
    begins = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
    first = np.minimum.reduceat(order, begins)
    group = np.empty(len(key), np.int64)
    group[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    one = first[group]
    alike = n == n[one] if of is None else (n == n[one]) & (of == of[one])
    other = np.flatnonzero(alike & (one != np.arange(len(one))))
    if len(other):
        at, c = np.cumsum(count) - count, count[other]
        k = counted(c)
        differ = words[np.repeat(at[other], c) + k] != words[np.repeat(at[one[other]], c) + k]
        alike[other[np.logical_or.reduceat(differ, np.cumsum(c) - c)]] = False
    lost, known, more = np.flatnonzero(~alike), {}, []
    for i in lost:  # spans that have another one's hash
        what = data[start[i] : end[i]].tobytes(), None if of is None else int(of[i])
        if what not in known:
            known[what] = len(first) + len(more)
            more.append(i)
        group[i] = known[what]
    return (np.concatenate([first, np.array(more, first.dtype)]) if more else first), group


def window_hashes(h: np.ndarray, k: int, second: bool = False) -> np.ndarray:
    """A hash of each k items in a row, rows disregarded: a rolling sum of h[i] * q**i."""
    n = len(h)
    if n < k:
        return np.zeros(0, U)
    q = (_WORDS_2 if second else _WORDS).at_least(n + 1)
    c = np.zeros(n + 1, U)
    np.cumsum(h * q.up[:n], out=c[1:])
    return mix((c[k:] - c[: n - k + 1]) * q.down[: n - k + 1])


def in_one_row(row: np.ndarray, k: int) -> np.ndarray:
    """For each window of k items: whether its ends lie in one row."""
    return row[k - 1 :] == row[: len(row) - k + 1] if len(row) >= k else np.zeros(0, bool)


def same_windows(h: np.ndarray, a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """Whether the windows of k items at a and at b hold the same items."""
    out = h[a] == h[b]
    for i in range(1, k):
        out &= h[a + i] == h[b + i]
    return out


def repeated(key: np.ndarray, same=None) -> np.ndarray:
    """Which keys occur more than once. Most single ones fall out by a table of counts, and
    only the rest is sorted. Each is compared with the group's first by same(numbers, numbers)."""
    out = np.zeros(len(key), bool)
    if len(key) < 2:
        return out
    bits = min(22, max(8, len(key).bit_length() + 2))
    slot = (key >> U(64 - bits)).astype(np.int64)
    left = np.flatnonzero(np.bincount(slot, minlength=1 << bits)[slot] > 1)
    if not len(left):
        return out
    k = key[left]
    order = np.argsort(k, kind="stable")
    k = k[order]
    begins = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.append(begins, len(k)))
    many = np.repeat(size > 1, size)
    mine, first = left[order[many]], left[order[np.repeat(begins, size)[many]]]
    alike = mine != first
    if same is not None:
        alike &= same(mine, first)
    out[mine[alike]] = True
    out[first[alike]] = True
    return out


def covered(at: np.ndarray, k: int, n: int) -> np.ndarray:
    """Which of n items some window of k items starting in `at` covers."""
    step = np.bincount(at, minlength=n + 1) - np.bincount(at + k, minlength=n + 1)
    return np.cumsum(step)[:n] > 0


def sums(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of value (bool or number) between the offsets."""
    c = np.zeros(len(value) + 1, np.int64)
    np.cumsum(value, out=c[1:])
    return np.diff(c[at])
