"""Byte-level BPE with exact merges by backtracking, and decoding by an offset table.

A text is cut at special tokens and into pretokens; each distinct pretoken of a run of texts is
encoded once. An Aho-Corasick automaton over the reversed tokens, fed from a pretoken's end, gives
the longest token that starts at every byte. The encoder takes the longest, and falls back to its
next shorter prefix token when the pair with the token before it is one that merging would not
have left side by side, or when the byte behind it is known to lead nowhere; without a prefix left
it gives up the token before. Each byte is given up at most once, so time is linear. All distinct
pretokens go through this in step, as numpy vectors; equal pretokens are found by hash and compared
byte by byte.

A long pretoken is cut into pieces that are encoded side by side. Tokens whose neighbours are all
compatible are the only encoding of their text, so two pieces whose border tokens are compatible
need nothing more; at other borders some tokens on either side are encoded anew, and only if that
leaves an incompatible pair too, the whole pretoken is encoded from its start. A word of many
megabytes so takes time in proportion to its length.

A null text is an empty one and has no tokens. Repeated rows are encoded each on its own, extra
columns are ignored, an empty table gives an empty result. Memory follows the longest text. The
vocabulary file's path is a parameter; each Python worker loads it once.
"""

import hashlib
import json
import re
import sys
import unicodedata
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .shared import prepared, table

#: Contractions that are pretokens of their own.
SHORT, LONG = ("s", "t", "m", "d"), ("re", "ve", "ll")
#: Unicode's White_Space characters.
WHITE = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

OTHER, LETTER, NUMBER, BLANK = range(4)
RUN_BYTES = 1 << 20
#: Bytes of a long pretoken that are encoded at once, and how many pretokens go on in step.
PIECE, FEW = 256, 32
#: Tokens on either side of a border that are tried anew.
BORDER = (2, 8)
#: Pairs of tokens that a worker remembers as a dictionary.
KNOWN_PAIRS = 1 << 20
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a vocabulary file: printable Latin-1 characters
    for themselves, the others in order from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def classes() -> np.ndarray:
    out = np.zeros(0x110000, np.uint8)
    kinds = {"L": LETTER, "N": NUMBER}
    for c in range(sys.maxunicode + 1):
        out[c] = kinds.get(unicodedata.category(chr(c))[0], OTHER)
    out[WHITE] = BLANK
    return out


def pretokens(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte positions where pretokens start, in bytes that hold texts from offset to offset."""
    if not len(data):
        return np.zeros(0, np.int64)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    point = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = classes()[point]
    n = len(point)
    head = np.zeros(n + 1, bool)  # first of a text
    head[np.searchsorted(at, offs)] = True
    cut = head[:n].copy()
    cut[1:] |= kind[1:] != kind[:-1]
    # the last blank before something else stands alone, or with what follows if it is a space
    tail = np.flatnonzero((kind[:-1] == BLANK) & (kind[1:] != BLANK) & ~head[1:n])
    cut[tail] = True
    cut[tail[point[tail] == 0x20] + 1] = False
    quote = np.flatnonzero((point == ord("'")) & cut)
    if len(quote):
        padded, heads = np.concatenate([point, [0, 0, 0]]), np.concatenate([head, [True, True, True]])
        one, two = padded[quote + 1], padded[quote + 2]
        first = ~heads[quote + 1]
        short = first & np.isin(one, [ord(c) for c in SHORT])
        long = first & ~heads[quote + 2] & np.logical_or.reduce([(one == ord(a)) & (two == ord(b)) for a, b in LONG])
        for hit, k in ((quote[short], 2), (quote[long], 3)):
            for i in range(1, k):
                cut[hit + i] = False
            after = hit + k
            cut[after[after < n]] = True
    return at[cut]


class Table:
    """Whole numbers from whole numbers (not negative), by open addressing; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        size = 1 << self.bits
        self.keys, self.values = np.full(size, -1, np.int64), np.full(size, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            s = slot[left]
            free = left[self.keys[s] < 0]
            self.keys[slot[free]] = keys[free]  # of several in one place the last one stays
            won = free[self.keys[slot[free]] == keys[free]]
            self.values[slot[won]] = values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(ts.U) * ts.U(0x9E3779B97F4A7C15)) >> ts.U(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], -1)
        left = np.flatnonzero((found != keys) & (found >= 0))
        while len(left):
            slot[left] = (slot[left] + 1) & (len(self.keys) - 1)
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found >= 0)]
        return out


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    PAIR_BITS = 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, vocab, merges = byte_letters(), spec["model"]["vocab"], spec["model"]["merges"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *special.values()])
        text: list[bytes] = [b""] * size
        for t, i in vocab.items():
            text[i] = bytes(letters[c] for c in t)
        for t, i in special.items():
            text[i] = t.encode()
        self.size, self.special = size, {t.encode(): i for t, i in special.items()}
        self.special_pattern = re.compile(b"|".join(re.escape(t) for t in sorted(self.special, key=len, reverse=True))) if special else None
        self.length = np.array([len(t) for t in text], np.int64)
        self.most = max(len(text[i]) for i in vocab.values())
        # decoding: all tokens' bytes in a row, and where each begins
        self.flat = np.frombuffer(b"".join(text), np.uint8)
        self.offset = np.cumsum(self.length) - self.length

        ids = {text[i]: i for t, i in vocab.items()}
        self.rank = np.full(size, -1, np.int64)
        self.left, self.right = np.arange(size), np.arange(size)
        pairs, results = [], []
        for rank, m in enumerate(merges):
            a, b = m.split(" ") if isinstance(m, str) else m
            a, b, c = vocab[a], vocab[b], vocab[a + b]
            self.rank[c], self.left[c], self.right[c] = rank, a, b
            pairs.append(a * size + b)
            results.append(c)
        self.merges = Table(np.array(pairs, np.int64), np.array(results, np.int32))
        #: The longest token that is a proper prefix of a token; -1: none.
        self.shorter = np.full(size, -1, np.int64)
        for t, i in ids.items():
            self.shorter[i] = next((ids[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ids), -1)
        self._automaton(ids)
        self.rank_list, self.left_list, self.right_list = self.rank.tolist(), self.left.tolist(), self.right.tolist()
        self.merge_of = {p: rank for rank, p in enumerate(pairs)}
        self.length_list, self.shorter_list = self.length.tolist(), self.shorter.tolist()
        self.known: dict[tuple[int, int], bool] = {}
        self.pair_key, self.pair_ok = np.full(1 << self.PAIR_BITS, -1, np.int64), np.zeros(1 << self.PAIR_BITS, bool)

    def _automaton(self, ids: dict[bytes, int]) -> None:
        """Aho-Corasick over reversed tokens: children by (node, byte), fallbacks, best tokens."""
        child: list[dict[int, int]] = [{}]
        best = [-1]
        for t, i in ids.items():
            node = 0
            for b in reversed(t):
                if (to := child[node].get(b)) is None:
                    to = child[node][b] = len(child)
                    child.append({})
                    best.append(-1)
                node = to
            best[node] = i
        fall, queue = [0] * len(child), list(child[0].values())
        for node in queue:
            for b, to in child[node].items():
                back = fall[node]
                while back and b not in child[back]:
                    back = fall[back]
                fall[to] = child[back].get(b, 0)
                queue.append(to)
        for node in queue:
            if best[node] < 0:
                best[node] = best[fall[node]]
        self.fall, self.best = np.array(fall, np.int64), np.array(best, np.int64)
        at = [(n * 256 + b, to) for n, c in enumerate(child) for b, to in c.items()]
        self.goto = Table(np.array([k for k, _ in at], np.int64), np.array([v for _, v in at], np.int32))

    def longest(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The longest token from each byte on, within each pretoken; longest pretokens first."""
        out = np.empty(len(data), np.int32)
        node, n = np.zeros(len(start), np.int64), start - end
        for back in range(1, 1 - int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(n, -back, "right"))
            at = end[:live] - back
            byte, now = data[at].astype(np.int64), node[:live]
            to = self.goto.get(now * 256 + byte).astype(np.int64)
            lost = np.flatnonzero(to < 0)
            while len(lost):
                up = now[lost] > 0
                to[lost[~up]] = 0
                lost = lost[up]
                now[lost] = self.fall[now[lost]]
                to[lost] = self.goto.get(now[lost] * 256 + byte[lost])
                lost = lost[to[lost] < 0]
            node[:live] = to
            out[at] = self.best[to]
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the tokens a, b of each pair side by side. Known pairs come
        from a table of fixed size, where a new pair takes an old one's place."""
        key = a * self.size + b
        slot = (ts.mix(key.astype(ts.U)) >> ts.U(64 - self.PAIR_BITS)).astype(np.int64)
        ok, known = self.pair_ok[slot], self.pair_key[slot] == key
        if not known.all():
            new = np.flatnonzero(~known)
            k, first, back = np.unique(key[new], return_index=True, return_inverse=True)
            got = self._left_apart(a[new[first]], b[new[first]])
            ok[new] = got[back]
            self.pair_key[slot[new]], self.pair_ok[slot[new]] = key[new], ok[new]
        return ok

    def _left_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Goes back in time through the tokens that met at the border while a and b were merged.
        Undone is always the later of the two, of equals the right one; had a merge across the
        border come before the one that is undone, or level with it on the right, it would have
        been made."""
        a, b = a.copy(), b.copy()
        ok = np.ones(len(a), bool)
        never = len(self.rank) + 1
        gone_a, gone_b = np.full(len(a), never), np.full(len(a), never)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            across = self.merges.get(x * self.size + y)
            rank = np.where(across >= 0, self.rank[across], never)
            bad = (rank < gone_a[live]) & (rank <= gone_b[live]) & (across >= 0)
            ok[live[bad]] = False
            rank_a, rank_b = self.rank[x], self.rank[y]
            live = live[~bad & ((rank_a >= 0) | (rank_b >= 0))]
            undo_a = self.rank[a[live]] > self.rank[b[live]]
            l, r = live[undo_a], live[~undo_a]
            gone_a[l], a[l] = self.rank[a[l]], self.right[a[l]]
            gone_b[r], b[r] = self.rank[b[r]], self.left[b[r]]
        return ok

    def _apart(self, a: int, b: int) -> bool:
        """_left_apart for one pair."""
        rank, left, right, merges, size = self.rank_list, self.left_list, self.right_list, self.merge_of, self.size
        x, y, never = a, b, len(rank) + 1
        gone_x = gone_y = never
        ok = True
        while True:
            across = merges.get(x * size + y, never)
            if across < gone_x and across <= gone_y and across < never:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                gone_x, x = rx, right[x]
            else:
                gone_y, y = ry, left[y]
        if len(self.known) > KNOWN_PAIRS:
            self.known.clear()
        self.known[a, b] = ok
        return ok

    def _finished(self, longest: memoryview, usable: bytearray, stack: array, token: int, at: int, size: int) -> array:
        """The encoder's steps from byte `at` of one pretoken of `size` bytes to its end."""
        length, shorter, known, apart = self.length_list, self.shorter_list, self.known, self._apart
        while at < size:
            behind = at + length[token]
            if usable[behind] and (not stack or (known.get((stack[-1], token)) if (stack[-1], token) in known else apart(stack[-1], token))):
                stack.append(token)
                at = behind
                if at < size:
                    token = longest[at]
                continue
            token = shorter[token]
            if token < 0:
                usable[at] = 0
                token = stack.pop()
                at -= length[token]
        return stack

    def _whole(self, data: np.ndarray) -> np.ndarray:
        """One pretoken, encoded from its start."""
        n, step = len(data), 1 << 16
        # pieces overlap by the longest token's bytes, after which the automaton is where it would be
        cut = np.arange(0, n, step)
        size = np.minimum(cut + step + self.most, n) - cut
        order = np.argsort(-size, kind="stable")
        at = np.cumsum(size[order]) - size[order]
        flat = data[np.repeat(cut[order] - at, size[order]) + np.arange(int(size.sum()))]
        got = self.longest(flat, at, at + size[order])
        longest = np.empty(n, np.int32)
        for i, j in enumerate(order):
            own = min(step, n - cut[j])
            longest[cut[j] : cut[j] + own] = got[at[i] : at[i] + own]
        ids = self._finished(memoryview(longest), bytearray(b"\x01") * (n + 1), array("i"), int(longest[0]), 0, n)
        return np.frombuffer(ids, np.int32)

    def encode_words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(ids, first id of each pretoken and of the end)."""
        count = -(-(end - start) // PIECE)
        if count.max() == 1:
            return self._in_order(data, start, end)
        first = np.repeat(start, count) + PIECE * ts.counted(count)
        ids, at = self._in_order(data, first, np.minimum(first + PIECE, np.repeat(end, count)))
        word_at = np.append(at[np.cumsum(count) - count], at[-1])  # first token of each pretoken
        begin = np.repeat(start, np.diff(word_at)) - np.repeat((np.cumsum(self.length[ids]) - self.length[ids])[word_at[:-1]], np.diff(word_at)) + np.cumsum(self.length[ids]) - self.length[ids]
        border = at[:-1][first > np.repeat(start, count)]  # first tokens of pieces that aren't a pretoken's first
        border = border[~self._compatible_at(ids[border - 1], ids[border])]
        new: dict[int, tuple] = {}  # first token: token behind the last, ids in their place
        for k in BORDER:
            if not len(border):
                break
            # half a piece at most, so that borders don't meet, and a token beside
            piece = np.searchsorted(at, border)
            lo, hi = border - np.minimum(k, (border - at[piece - 1]) // 2), border + np.minimum(k, (at[piece + 1] - border) // 2)
            some = np.flatnonzero((lo > at[piece - 1]) & (hi < at[piece + 1]) & (lo < border) & (border < hi))
            if not len(some):
                continue
            a, b = lo[some], hi[some]
            got, got_at = self._in_order(data, begin[a], begin[b - 1] + self.length[ids[b - 1]])
            good = self._compatible_at(ids[a - 1], got[got_at[:-1]]) & self._compatible_at(got[got_at[1:] - 1], ids[b])
            for i in np.flatnonzero(good):
                new[int(a[i])] = int(b[i]), got[got_at[i] : got_at[i + 1]]
            border = np.delete(border, some[good])
        for w in np.unique(np.searchsorted(word_at, border, "right") - 1):
            for x in [x for x in new if word_at[w] <= x < word_at[w + 1]]:
                del new[x]
            new[int(word_at[w])] = int(word_at[w + 1]), self._whole(data[start[w] : end[w]])
        parts, n, done = [], np.diff(word_at), 0
        for lo in sorted(new):
            hi, own = new[lo]
            parts += [ids[done:lo], own]
            done = hi
            n[np.searchsorted(word_at, lo, "right") - 1] += len(own) - (hi - lo)
        return np.concatenate([*parts, ids[done:]]), np.concatenate([[0], np.cumsum(n)])

    def _compatible_at(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.compatible(a.astype(np.int64), b.astype(np.int64))

    def _in_order(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """_in_step for pretokens in any order and place."""
        rank = np.argsort(start - end, kind="stable")
        s, n = start[rank], (end - start)[rank]
        at = np.cumsum(n) - n
        ids, where = self._in_step(data[np.repeat(s - at, n) + np.arange(int(n.sum()))], at, at + n)
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        count = np.diff(where)[back]
        out_at = np.zeros(len(back) + 1, np.int64)
        np.cumsum(count, out=out_at[1:])
        return ids[np.repeat(where[back] - out_at[:-1], count) + np.arange(out_at[-1])], out_at

    def _in_step(self, data: np.ndarray, start: np.ndarray, end: np.ndarray):
        """(ids, first id of each pretoken and of the end); longest pretokens first, one behind another."""
        longest = self.longest(data, start, end)
        words = len(start)
        base = start + np.arange(words)  # a place for each byte and one behind each pretoken
        shift = np.arange(words)
        usable = np.ones(len(data) + words, bool)
        stack = np.zeros(len(data) + words, np.int32)
        depth, pos = np.zeros(words, np.int64), start.copy()
        token = longest[start].astype(np.int64)
        live = np.arange(words)
        while len(live) > FEW:
            t, p, d = token[live], pos[live], depth[live]
            behind = p + self.length[t]
            take = usable[behind + shift[live]]
            ask = np.flatnonzero(take & (d > 0))
            if len(ask):
                w = live[ask]
                take[ask] = self.compatible(stack[base[w] + depth[w] - 1].astype(np.int64), t[ask])
            w = live[take]
            stack[base[w] + depth[w]] = t[take]
            depth[w] += 1
            pos[w] = behind[take]
            done = pos[w] == end[w]
            go = w[~done]
            token[go] = longest[pos[go]]
            w = live[~take]
            less = self.shorter[t[~take]]
            token[w] = less
            stuck = w[less < 0]
            usable[pos[stuck] + shift[stuck]] = False
            depth[stuck] -= 1
            last = stack[base[stuck] + depth[stuck]]
            token[stuck] = last
            pos[stuck] -= self.length[last]
            ended = np.zeros(words, bool)
            ended[live[take][done]] = True
            live = live[~ended[live]]
        for w in live:
            b, n = int(base[w]), int(end[w] - start[w])
            ids = self._finished(memoryview(longest[start[w] : end[w]]), bytearray(usable[b : b + n + 1]), array("i", stack[b : b + depth[w]].tobytes()), int(token[w]), int(pos[w] - start[w]), n)
            stack[b : b + len(ids)] = ids
            depth[w] = len(ids)
        at = np.zeros(words + 1, np.int64)
        np.cumsum(depth, out=at[1:])
        return stack[np.repeat(base - at[:-1], depth) + np.arange(at[-1])], at

    def encode(self, data: np.ndarray, offs: np.ndarray):
        """(ids, first id of each text and of the end)."""
        parts, special = offs, {}
        if self.special_pattern and len(data):
            for m in self.special_pattern.finditer(data.tobytes()):
                if np.searchsorted(offs, m.start(), "right") == np.searchsorted(offs, m.end() - 1, "right"):
                    special[m.start()] = (m.end(), self.special[m[0]])
            if special:
                parts = np.unique(np.concatenate([offs, [x for k, v in special.items() for x in (k, v[0])]]))
        start = pretokens(data, parts)
        if special:  # the parts that are special tokens stay whole
            k, e = np.array(list(special)), np.array([v[0] for v in special.values()])
            i = np.searchsorted(k, start, "right") - 1
            start = start[(i < 0) | (start == k[i]) | (start >= e[i])]
        if not len(start):
            return np.zeros(0, np.int32), np.zeros(len(offs), np.int64)
        end = np.append(start[1:], len(data))
        first, group = ts.distinct_spans(data, start, end)
        ids, where = self.encode_words(data, start[first], end[first])
        word = group
        count = np.diff(where)[word]
        out_at = np.zeros(len(word) + 1, np.int64)
        np.cumsum(count, out=out_at[1:])
        out = ids[np.repeat(where[word] - out_at[:-1], count) + np.arange(out_at[-1])]
        if special:
            out, out_at = self._with_special(out, out_at, start, special)
        return out, out_at[np.searchsorted(start, offs)]

    @staticmethod
    def _with_special(ids, at, start, special):
        """Puts each special token's id in the place of what its letters gave."""
        spots = np.searchsorted(start, np.array(sorted(special)))
        count = np.diff(at)
        drop = np.zeros(len(ids), bool)
        for s in spots:
            drop[at[s] + 1 : at[s + 1]] = True
        ids = ids.copy()
        ids[at[spots]] = [special[k][1] for k in sorted(special)]
        count[spots] = 1
        return ids[~drop], np.concatenate([[0], np.cumsum(count)])

    def decode(self, ids: np.ndarray, at: np.ndarray):
        """(bytes, first byte of each text and of the end)."""
        n = self.length[ids]
        to = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(n, out=to[1:])
        return self.flat[np.repeat(self.offset[ids] - to[:-1], n) + np.arange(to[-1])], to[at]


@lru_cache(2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def _hex(data: np.ndarray) -> str:
    return hashlib.sha256(data).hexdigest()


def _text_hex(data: np.ndarray, plain: bool) -> str:
    return _hex(data) if plain else hashlib.sha256(data.tobytes().decode("utf-8", "replace").encode()).hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per row of docs(doc_id, text): token count, digest of the ids (as little-endian unsigned
    32-bit integers) and digest of the text decoded from them."""
    prepared(docs.sparkSession)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for first, n, data, offs in ts.runs(batch, limit=RUN_BYTES):
                ids, at = v.encode(data, offs)
                back, to = v.decode(ids, at)
                plain = len(back) == len(data) and bool((back == data).all())
                small = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n).cast(pa.int64()), pa.array(np.diff(at)), pa.array([_hex(small[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string()), pa.array([_text_hex(back[a:b], plain) for a, b in zip(to[:-1], to[1:])], pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids array<int>) of each row of docs(doc_id, text)."""
    prepared(docs.sparkSession)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            for first, n, data, offs in ts.runs(batch, limit=RUN_BYTES):
                ids, at = v.encode(data, offs)
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n).cast(pa.int64()), lists], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def detokenized(tokens: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of each row of tokens(doc_id, ids); null ids are none."""
    prepared(tokens.sparkSession)

    def run(batches):
        v = vocabulary(path)
        for batch in batches:
            lists = [x or [] for x in batch.column("ids").to_pylist()]
            at = np.cumsum([0, *map(len, lists)])
            data, to = v.decode(np.array([i for x in lists for i in x], np.int64), at)
            texts = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(to[:-1], to[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2(spark, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_vocabulary())
