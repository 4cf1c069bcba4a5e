"""Passages that repeat across documents, from a compacted De Bruijn graph of the corpus.

Edges are the token k-mers of WINDOW words; an edge's places are where that word sequence starts.
Edges in a row of one text that share their least SEED-gram (by hash) form a piece; pieces are cut
the same way wherever a passage stands, so a repeated passage is a row of equal pieces, about one
for every 17 words. Pieces are what moves through Spark:

1. Seeds that occur once fall out by a Bloom filter (bloom.py), the rest is grouped by piece: the
   least document of each, its source.
2. Pieces that share a seed and differ can still share edges, where a passage begins or ends.
   Those pieces, once each, are opened into edges, which are grouped by their own hash.
3. Equal pieces are compacted: where every occurrence of a piece has one and the same next piece,
   and that one the same previous piece, a join links them, and linked pieces become one path
   with the source's text and position beside the copy's.
4. Each path, and each row of single edges, is verified: a digest of its words where it stands is
   held against that of the words at its source's coordinates. Where they differ, hashes of
   different words have met; everything with that path's seeds is then grouped anew by digests of
   the words of every edge. So no word goes on the word of a hash alone.

A word goes when some edge over it also starts in a document with a smaller doc_id. Words are
runs of other characters than [\\x20\\x09-\\x0D], as they are. A null text has no words; a null
doc_id counts as larger than all others; rows that share a doc_id don't count against each other, and
of rows alike in doc_id and text (all those without one, say) only one moves and is searched.
Texts shorter than WINDOW words lose nothing. An empty table gives an empty result; extra columns
are ignored. Texts that have no repeated passage never shuffle as long as the filter is not
saturated.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import bloom
from . import textscan as ts
from .shared import prepared, staged, table

WINDOW = 50
SEED = 16
NO_ID = (1 << 63) - 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w items in a row."""
    have, out = 1, x
    while 2 * have <= w:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (w - have)], out[w - have :]) if w > have else out


def pieces(data: np.ndarray, offs: np.ndarray, window: int, seed: int, hash_bits: int):
    """Of each piece: its text's number, first edge's word, edges, seed and two hashes."""
    start, end, at = ts.words(data, offs)
    row, h = ts.rows_of(at), ts.span_hashes(data, start, end)
    ok = np.flatnonzero(ts.in_one_row(row, window))
    if not len(ok):
        return None
    longest = window - 2  # so that a piece's first and last edge hold all its words
    least = sliding_min(ts.window_hashes(h, seed), window - seed + 1)[ok]
    cut = np.ones(len(ok), bool)
    cut[1:] = (least[1:] != least[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(cut)
    n = np.diff(np.append(first, len(ok)))
    parts = -(-n // longest)
    within = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    lo = np.repeat(first, parts) + within * longest
    hi = np.minimum(lo + longest, np.repeat(first + n, parts)) - 1
    size = (hi - lo + 1).astype(ts.U)
    w1, w2 = ts.window_hashes(h, window), ts.window_hashes(h, window, True)
    c1, c2 = (ts.mix(w[ok[lo]] + ts.mix(w[ok[hi]] + size)) >> ts.U(64 - hash_bits) for w in (w1, w2))
    of = row[ok[lo]]
    return of, ok[lo] - at[of], hi - lo + 1, least[lo], c1, c2


def _keyed(docs: DataFrame) -> DataFrame:
    """A text's place: its doc_id (null last) and a hash of the text; rows alike in both are alike."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(NO_ID)).alias("doc")).withColumn("text_key", F.xxhash64("text"))


def occurrences(docs: DataFrame, window: int, seed: int, hash_bits: int = 64) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, n, data, offs in ts.runs(batch):
                if got := pieces(data, offs, window, seed, hash_bits):
                    of = pa.array(got[0])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(c).slice(first, n).take(of) for c in ("doc", "text_key")] + [pa.array(x.astype(np.int32)) for x in got[1:3]] + [pa.array(x.view(np.int64)) for x in got[3:]],
                        ["doc", "text_key", "at", "n", "seed", "c1", "c2"],
                    )

    return _keyed(docs).select("doc", "text_key", "text").mapInArrow(run, "doc long, text_key long, at int, n int, seed long, c1 long, c2 long")


def _listed(batch, i: int, n: int):
    """(row of each span, first word, edges) of the lists `spans` of rows i to i + n."""
    lists = batch.column("spans").slice(i, n)
    span = lists.flatten()
    at, k = (np.asarray(span.field(f)).astype(np.int64) for f in ("at", "n"))
    return np.repeat(np.arange(n), np.diff(np.asarray(lists.offsets))), at, k


def _edges(window: int, hash_bits: int):
    def run(batches):
        for batch in batches:
            for i, n, data, offs in ts.runs(batch):
                start, end, at = ts.words(data, offs)
                h = ts.span_hashes(data, start, end)
                w1, w2 = ((ts.window_hashes(h, window, x) >> ts.U(64 - hash_bits)).view(np.int64) for x in (False, True))
                of, lo, k = _listed(batch, i, n)
                of, pos = np.repeat(of, k), np.repeat(lo, k) + ts.counted(k)
                g, of = at[of] + pos, pa.array(of)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w1[g]), pa.array(w2[g])] + [batch.column(c).slice(i, n).take(of) for c in ("doc", "text_key")] + [pa.array(pos.astype(np.int32))],
                    ["w1", "w2", "doc", "text_key", "at"],
                )

    return run


def _digests(window: int, single: bool):
    """A digest of the words of each span, or of each edge of it."""

    def run(batches):
        for batch in batches:
            for i, n, data, offs in ts.runs(batch):
                start, end, at = ts.words(data, offs)
                flat, to = _joined(data, start, end, np.arange(len(start)))
                of, lo, k = _listed(batch, i, n)
                if single:
                    of, lo, k = np.repeat(of, k), np.repeat(lo, k) + ts.counted(k), np.ones(int(k.sum()), np.int64)
                # a source's coordinates can lead behind its text where hashes have met
                first, last = (to[np.minimum(at[of] + x, at[of + 1])] for x in (lo, lo + k + window - 1))
                last = np.maximum(last - 1, first)
                digest = [hashlib.md5(flat[a:b]).digest() for a, b in zip(first, last)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, n).take(pa.array(of)) for c in ("doc", "text_key")] + [pa.array(x.astype(np.int32)) for x in (lo, k)] + [pa.array(digest, pa.binary())], ["doc", "text_key", "at", "n", "digest"]
                )

    return run


def _with_spans(docs: DataFrame, spans: DataFrame):
    """(rows of docs with spans, joined with them; other rows, with none; what to drop at the end).
    spans has a row per span, repeated ones count once. Texts that can't have one don't shuffle."""
    place = F.xxhash64("doc", "text_key")
    lists = staged(spans.groupBy("doc", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("spans")).withColumn("place", place), "spans")
    maybe = bloom.passes(docs.sparkSession, bloom.members(lists, "place"), place)
    tested = _keyed(docs).withColumn("maybe", maybe)
    return tested.where("maybe").join(lists.drop("place"), ["doc", "text_key"], "left"), tested.where("not maybe"), lists


def _opened(docs: DataFrame, spans: DataFrame, run, schema: str, tag: str) -> DataFrame:
    """What run makes of the texts that have spans, each once, staged. Rows alike in doc and text leave
    the map side as one, so those of a hot text don't meet."""
    place = F.xxhash64("doc", "text_key")
    lists = staged(spans.groupBy("doc", "text_key").agg(F.collect_set(F.struct("at", "n")).alias("spans")).withColumn("place", place), "spans")
    some = _keyed(docs).where(bloom.passes(docs.sparkSession, bloom.members(lists, "place"), place))
    once = some.groupBy("doc", "text_key").agg(F.first("text").alias("text"))
    return staged(once.join(lists.drop("place"), ["doc", "text_key"]).select("doc", "text_key", "text", "spans").mapInArrow(run, schema), tag, spent=(lists,))


SPAN = ["doc", "text_key", "at", "n"]
SOURCE = ["source", "source_key", "source_at"]


def repeated_spans(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hash_bits: int = 64) -> DataFrame:
    """(doc, text_key, at, n): n edges from word `at` on of text (doc, text_key) that also start in
    a document with a smaller doc_id. Staged. With fewer hash_bits more is left to verification."""
    spark = prepared(docs.sparkSession)
    all_of_them = staged(occurrences(docs, window, seed, hash_bits), "pieces")
    some = staged(all_of_them.where(bloom.passes(spark, bloom.repeated(all_of_them, "seed", bloom.COARSE), F.col("seed"))), "repeated_seeds", spent=(all_of_them,))

    by_piece = some.groupBy("c1", "c2").agg(F.min("doc").alias("source"), F.max("doc").alias("last"), F.first("seed").alias("seed"))
    by_piece = staged(by_piece, "classes")
    mixed = by_piece.groupBy("seed").agg(F.count(F.lit(1)).alias("k"), F.min("source").alias("lo"), F.max("source").alias("hi")).where("k > 1 and lo < hi").select("seed")
    opened = by_piece.join(staged(mixed, "seeds"), "seed").select("c1", "c2", "source")
    common = staged(by_piece.where("source < last").select("c1", "c2", "source"), "repeated")
    # rows alike in doc and text have the same pieces, which count once from here on
    found = some.join(common, ["c1", "c2"]).groupBy("doc", "text_key", "at").agg(F.first("n").alias("n"), F.first("c1").alias("c1"), F.first("source").alias("source"))
    found = staged(found, "found", spent=(common,))
    sources = some.join(staged(opened, "opened"), ["c1", "c2"]).where("doc = source").select(*SPAN)

    edges = _opened(docs, sources, _edges(window, hash_bits), "w1 long, w2 long, doc long, text_key long, at int", "edges")
    least = staged(edges.groupBy("w1", "w2").agg(F.min("doc").alias("source"), F.max("doc").alias("last")).where("source < last").drop("last"), "shared")
    shared = staged(edges.join(least, ["w1", "w2"]), "shared_edges", spent=(edges, least))
    first = shared.where("doc = source").groupBy("w1", "w2").agg(F.min(F.struct(F.col("text_key").alias("source_key"), F.col("at").alias("source_at"))).alias("s"))
    first = staged(first, "first_edges")  # with a shuffle of its own, the join can split a hot edge
    single = _rows(shared.where("doc > source").join(first, ["w1", "w2"]).select("doc", "text_key", "at", F.lit(1).alias("n"), "source", "s.*"))

    spans = staged(compacted(found).unionByName(single), "repeats", spent=(by_piece,))
    good, bad = verified(docs, spans, window)
    if not bad.isEmpty():
        seeds = some.alias("a").join(bad.alias("b"), ["doc", "text_key"]).where("a.at < b.at + b.n and b.at < a.at + a.n").select("seed").distinct()
        again = some.join(staged(seeds, "bad_seeds"), "seed").select(*SPAN)
        named = _opened(docs, again, _digests(window, True), "doc long, text_key long, at int, n int, digest binary", "named")
        least = staged(named.groupBy("digest").agg(F.min("doc").alias("source")), "least")
        good = good.unionByName(named.join(least, "digest").where("doc > source").select(*SPAN))
    return staged(good, "verified", spent=(spans, some, found, shared, first))


def verified(docs: DataFrame, spans: DataFrame, window: int):
    """Those of the spans, once each, whose words are the words at their source's coordinates; and
    the others. Both staged."""
    there = spans.select(F.col("source").alias("doc"), F.col("source_key").alias("text_key"), F.col("source_at").alias("at"), "n")
    words = _opened(docs, spans.select(*SPAN).unionByName(there).distinct(), _digests(window, False), "doc long, text_key long, at int, n int, digest binary", "words")
    own = words.withColumnRenamed("digest", "own")
    source = words.select(F.col("doc").alias("source"), F.col("text_key").alias("source_key"), F.col("at").alias("source_at"), "n", F.col("digest").alias("there"))
    both = spans.join(own, SPAN).join(source, [*SOURCE, "n"], "left")
    both = staged(both.select(*SPAN, F.coalesce(F.col("own") == F.col("there"), F.lit(False)).alias("same")), "compared", spent=(words,))
    return both.where("same").select(*SPAN), both.where("not same").select(*SPAN)


def compacted(found: DataFrame) -> DataFrame:
    """Repeated pieces as nonbranching paths: (doc, text_key, at, n, source, source_key, source_at)."""
    text = W.partitionBy("doc", "text_key").orderBy("at")
    beside = found.withColumn("next", F.when(F.lead("at").over(text) == F.col("at") + F.col("n"), F.lead("c1").over(text)))
    beside = beside.withColumn("before", F.when(F.lag("at").over(text) + F.lag("n").over(text) == F.col("at"), F.lag("c1").over(text)))
    beside = staged(beside, "beside")
    one = lambda c: (F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1)))
    degree = beside.groupBy("c1").agg(one("next").alias("one_next"), one("before").alias("one_before"))
    place = beside.where("doc = source").groupBy("c1").agg(F.min(F.struct(F.col("text_key").alias("source_key"), F.col("at").alias("source_at"))).alias("s"))
    degree = staged(degree.join(place, "c1").select("c1", "one_next", "one_before", "s.*"), "degrees")
    flagged = beside.join(degree, "c1")
    follows = (F.lag("at").over(text) + F.lag("n").over(text) == F.col("at")) & (F.lag("source").over(text) == F.col("source")) & (F.lag("source_key").over(text) == F.col("source_key")) & (F.lag("source_at").over(text) + F.lag("n").over(text) == F.col("source_at"))
    linked = F.col("before").isNotNull() & F.col("one_before") & F.lag("one_next").over(text) & follows
    numbered = flagged.withColumn("head", F.when(F.coalesce(linked, F.lit(False)), 0).otherwise(1)).withColumn("path", F.sum("head").over(text.rowsBetween(W.unboundedPreceding, 0)))
    return _paths(numbered.where("doc > source"))


def _rows(edges: DataFrame) -> DataFrame:
    """Single edges that follow one another, here and at their source, as one span."""
    text = W.partitionBy("doc", "text_key").orderBy("at")
    follows = (F.lag("at").over(text) + 1 == F.col("at")) & (F.lag("source").over(text) == F.col("source")) & (F.lag("source_key").over(text) == F.col("source_key")) & (F.lag("source_at").over(text) + 1 == F.col("source_at"))
    numbered = edges.withColumn("head", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("path", F.sum("head").over(text.rowsBetween(W.unboundedPreceding, 0)))
    return _paths(numbered)


def _paths(numbered: DataFrame) -> DataFrame:
    return numbered.groupBy("doc", "text_key", "path").agg(F.min("at").alias("at"), F.sum("n").cast("int").alias("n"), F.min("source").alias("source"), F.min("source_key").alias("source_key"), F.min("source_at").alias("source_at")).drop("path")


def _joined(data, start, end, which):
    """(the words of those numbers with a space behind each, as bytes; where each begins and ends)."""
    size = end[which] - start[which] + 1
    to = np.zeros(len(which) + 1, np.int64)
    np.cumsum(size, out=to[1:])
    take = np.repeat(start[which] - to[:-1], size) + np.arange(to[-1])
    flat = np.append(data, np.uint8(0x20))[np.minimum(take, len(data))]
    flat[to[1:] - 1] = 0x20
    return flat, to


def _kept_texts(batch, window: int):
    """(row, words, words that go, kept words joined by a space) for every text of a batch."""
    for i, n, data, offs in ts.runs(batch):
        start, end, at = ts.words(data, offs)
        of, lo, k = _listed(batch, i, n)
        step = np.bincount(at[of] + lo, minlength=len(start) + 1) - np.bincount(at[of] + lo + k + window - 1, minlength=len(start) + 1)
        gone = np.cumsum(step)[: len(start)] > 0
        keep = np.flatnonzero(~gone)
        flat, to = _joined(data, start, end, keep)
        own = to[np.searchsorted(keep, at)]
        for j in range(n):
            a, b = own[j], own[j + 1]
            yield i + j, int(at[j + 1] - at[j]), int(gone[at[j] : at[j + 1]].sum()), flat[a : max(a, b - 1)].tobytes()


def remove_repeats(docs: DataFrame, window: int = WINDOW, seed: int = SEED, hash_bits: int = 64, digest: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, text of the kept words joined by one space) of each row; with
    digest, kept_sha256 in the text's place."""
    name = "kept_sha256" if digest else "text"

    def run(batches):
        for batch in batches:
            got = list(_kept_texts(batch, window))
            text = [hashlib.sha256(x[3]).hexdigest() if digest else x[3].decode() for x in got]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([x[1] for x in got], pa.int64()), pa.array([x[2] for x in got], pa.int64()), pa.array(text, pa.string())], ["doc_id", "n_words", "n_removed", name])

    schema = f"doc_id long, n_words long, n_removed long, {name} string"
    hit, rest, _ = _with_spans(docs, repeated_spans(docs, window, seed, hash_bits))
    none = F.from_json(F.lit("[]"), "array<struct<at: int, n: int>>")
    hit = hit.select("doc_id", "text", F.coalesce("spans", none).alias("spans"))
    return hit.mapInArrow(run, schema).unionByName(rest.select("doc_id", "text", none.alias("spans")).mapInArrow(run, schema))


def op6(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
