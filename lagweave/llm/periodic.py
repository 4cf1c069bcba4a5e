"""Periodic runs of words, found by a dictionary of basic factors.

A basic factor is 2**k words in a row. Level k of the dictionary names those of a text: two get one
name exactly if their words are the same. Names are ranks of pairs of names of the level below, so
nothing rests on a hash; the first level compares words byte by byte. A factor that its text holds
once is dropped, as everything that begins with it is single too, so levels get short quickly.

On the level of m words, a factor's next occurrence at a distance d with m <= d < 2m proposes the
period d; neighbouring places with one distance are arithmetic progressions side by side and propose
once. Each proposal is extended to both sides by comparing words d apart, in steps of the
dictionary's factors from long to short, and equal runs are merged. Every run of at least three
periods is proposed: its period q has a level with m <= q < 2m, and as more than m of the factors of
m words of a primitive period differ, at least one of them doesn't occur twice within it, so that
its next occurrence is exactly q away. No proposal is a multiple of the smallest period: a factor
would have recurred sooner.

A run is a longest stretch of words with smallest period q and length >= max(least, times * q).
`collapsed` texts keep the first q words of each run. Words are runs of other characters than
[\\x20\\x09-\\x0D], as they are. A null or empty text has no words and no runs. Every row is judged on
its own, so null, tied or repeated doc_ids and repeated rows change nothing; an empty table gives an
empty result, and other columns are ignored. Nothing shuffles; memory follows the longest text.
"""

import hashlib
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .shared import prepared, table

LEAST = 24
TIMES = 3


def _dense(key: np.ndarray):
    """(which items' keys occur more than once, their dense names, in the order of places)."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    name = np.cumsum(new) - 1
    many = np.bincount(name)[name] > 1
    keep = np.sort(order[many])
    names = np.empty(len(k), np.int64)
    names[order] = name
    return keep, names[keep]


class Factors:
    """Levels of (places, names) of the factors that occur more than once in their text; a level's
    factors have 2**level words. word: a number for each word, row: its text's number."""

    def __init__(self, word: np.ndarray, at: np.ndarray, longest: int):
        row = ts.rows_of(at)
        place, name = _dense(word * (len(at) + 1) + row)
        self.levels = [(place, name)]
        m = 1
        while len(place) and 2 * m <= longest:
            right = np.searchsorted(place, place + m)
            ok = right < len(place)
            ok[ok] = place[right[ok]] == place[ok] + m
            ok[ok] = row[place[ok]] == row[place[ok] + m]
            left, right = np.flatnonzero(ok), right[ok]
            keep, new = _dense(name[left] * (name.max() + 1) + name[right])
            place, name = place[left[keep]], new
            self.levels.append((place, name))
            m *= 2

    def proposals(self):
        """(place, place behind the last, distance) of neighbouring places whose factor's next
        occurrence is at one distance between its length and twice that."""
        out = []
        for level, (place, name) in enumerate(self.levels):
            order = np.argsort(name, kind="stable")
            p, n = place[order], name[order]
            gap = np.diff(p)
            fits = (n[1:] == n[:-1]) & (gap >= 1 << level) & (gap < 2 << level)
            first, gap = p[:-1][fits], gap[fits]
            order = np.argsort(first)
            first, gap = first[order], gap[order]
            head = np.ones(len(first), bool)
            head[1:] = (first[1:] != first[:-1] + 1) | (gap[1:] != gap[:-1])
            head = np.flatnonzero(head)
            last = np.append(head[1:], len(first))[: len(head)] - 1
            out.append((first[head], first[last] + (1 << level), gap[head]))
        return tuple(np.concatenate(x) for x in zip(*out))

    def _same(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the factors at a and at b, of one text, are the same."""
        place, name = self.levels[level]
        if not len(place):
            return np.zeros(len(a), bool)
        i, j = (np.minimum(np.searchsorted(place, x), len(place) - 1) for x in (a, b))
        return (place[i] == a) & (place[j] == b) & (name[i] == name[j])

    def extended(self, lo: np.ndarray, hi: np.ndarray, gap: np.ndarray):
        """The farthest lo and hi so that words lo .. hi - 1 equal those gap behind them. A level can
        fit more than once in a row only at the top."""
        lo, hi = lo.copy(), hi.copy()
        for level in reversed(range(len(self.levels))):
            m, on = 1 << level, np.arange(len(lo))
            while len(on):
                on = on[self._same(level, hi[on], hi[on] + gap[on])]
                hi[on] += m
                on = on if level == len(self.levels) - 1 else on[:0]
            on = np.arange(len(lo))
            while len(on):
                on = on[self._same(level, lo[on] - m, lo[on] - m + gap[on])]
                lo[on] -= m
                on = on if level == len(self.levels) - 1 else on[:0]
        return lo, hi


def runs_of_words(word: np.ndarray, at: np.ndarray, least: int = LEAST, times: int = TIMES):
    """(text, start, length, period) of every run, by text, start and period. word: numbers of the
    words of all texts, at: where each text begins and the end."""
    count = np.diff(at)
    longest = int(count.max(initial=0)) // times
    none = np.zeros(0, np.int64)
    if longest < 1:
        return none, none, none, none
    factors = Factors(word, at, longest)
    first, last, gap = factors.proposals()
    if not len(first):
        return none, none, none, none
    lo, hi = factors.extended(first, last, gap)
    length = hi - lo + gap
    good = np.flatnonzero(length >= np.maximum(least, times * gap))
    text = np.searchsorted(at, lo[good], "right") - 1
    found = np.unique(np.stack([text, lo[good] - at[text], gap[good], length[good]], 1), axis=0)
    return found[:, 0], found[:, 1], found[:, 3], found[:, 2]


def _replaced(i: np.ndarray, at: np.ndarray, ids: list) -> np.ndarray:
    """The numbers of words that stand where the query's rule puts repeats into some texts."""
    out = i.copy()
    for j, doc in enumerate(ids):
        n, h = int(at[j + 1] - at[j]), zlib.crc32(b"" if doc is None else str(doc).encode())
        if n and h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[at[j] + a : at[j + 1]] = at[j] + a + np.arange(n - a) % p
    return out


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(the words with a space behind each, as bytes; where each begins and the end)."""
    size = end - start + 1
    to = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    flat = np.append(data, np.uint8(0x20))[np.minimum(np.repeat(start - to[:-1], size) + np.arange(to[-1]), len(data))]
    flat[to[1:] - 1] = 0x20
    return flat, to


RUNS = "array<struct<start: long, length: long, period: long>>"


def periodic_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES, planted: bool = False, digest: bool = False) -> DataFrame:
    """(doc_id, runs, collapsed) of each row: runs by start and period, and the text's words but
    those behind a run's first period, joined by a space. With digest, the figures of the run with
    the greatest exponent and SHA-256 of both take their place; with planted, words are first
    replaced by the rule of the query."""
    names = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"] if digest else ["doc_id", "runs", "collapsed"]
    schema = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string" if digest else f"doc_id long, runs {RUNS}, collapsed string"

    def run(batches):
        for batch in batches:
            for first, rows, data, offs in ts.runs(batch):
                ids = batch.column("doc_id").slice(first, rows).cast(pa.int64())
                start, end, at = ts.words(data, offs)
                if planted:
                    order = _replaced(np.arange(len(start)), at, ids.to_pylist())
                    word = ts.distinct_spans(data, start, end)[1][order]
                    start, end = start[order], end[order]
                else:
                    word = ts.distinct_spans(data, start, end)[1]
                text, lo, length, period = runs_of_words(word, at, least, times)
                step = np.bincount(at[text] + lo + period, minlength=len(start) + 1) - np.bincount(at[text] + lo + length, minlength=len(start) + 1)
                kept = np.flatnonzero(np.cumsum(step)[: len(start)] == 0)
                flat, to = _joined(data, start[kept], end[kept])
                own, of = to[np.searchsorted(kept, at)], np.searchsorted(text, np.arange(rows + 1))
                collapsed = [flat[a : max(a, b - 1)].tobytes() for a, b in zip(own[:-1], own[1:])]
                mine = [list(zip(*(x[a:b].tolist() for x in (lo, length, period)))) for a, b in zip(of[:-1], of[1:])]
                if digest:
                    best = [max(x, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2])) if x else None for x in mine]
                    cols = [[len(x) for x in mine], *([b and b[i] for b in best] for i in range(3)), [b and 1000 * b[1] // b[2] for b in best]]
                    sha = [[hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in x).encode()).hexdigest() for x in mine], [hashlib.sha256(x).hexdigest() for x in collapsed]]
                    arrays = [pa.array(c, pa.int64()) for c in cols] + [pa.array(c, pa.string()) for c in sha]
                else:
                    kind = pa.list_(pa.struct([(f, pa.int64()) for f in ("start", "length", "period")]))
                    arrays = [pa.array([[dict(zip(("start", "length", "period"), r)) for r in x] for x in mine], kind), pa.array([x.decode() for x in collapsed], pa.string())]
                yield pa.RecordBatch.from_arrays([ids, *arrays], names)

    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def op13(spark, sf_dir: str) -> DataFrame:
    return periodic_runs(table(spark, sf_dir, "documents"), planted=True, digest=True)
