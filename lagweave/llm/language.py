"""Language identification by language-bitmask n-gram filters.

The filter is a bit-sliced Bloom filter: each slot of a table holds a bit for every language, in
tables of one 64-bit word a slot, as many as 64 languages each need; an n-gram has HASHES slots, and
the bits common to them are all the languages that contain it, found in one look. A language contains
a byte n-gram (a word's letters and digits with a mark on either side, 1 to 4 bytes) if its rate there
is at least RATIO of its highest rate in any language and it was seen LEAST times. A text's n-grams
give each language a count; the count is corrected for the share that the filter's fill makes up by
chance, and the largest corrected share wins, ties going to the language first in code-point order.

Training reads text and lang of about `sample` rows at most, those with a small hash of doc_id; their
whole texts are counted by Spark. Every n-gram of a language that passes RATIO and LEAST is kept, and
the table's size follows their number, from 4 MB to 128 MB for each 64 languages. Every language of the
sample is learned. Predictions read the text alone, whole. A null text or one without a letter is `und`
with score 0; a text with letters none of whose n-grams is known gets the first language, score 0.
Without any training row everything is `und`. Repeated rows are judged each on its own; extra columns
are ignored. In the query held_out is null for a null doc_id, which is not learned from.
"""

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import dropped, prepared, staged, table

SAMPLE = 20_000
LEAST, RATIO = 5, 0.5
WORD_BITS = 64
#: Slots of a filter, as a power of two: SLOTS_A_GRAM for each n-gram of its largest language, between
#: these two. A fuller filter answers wrongly more often, which predictions are corrected for.
SLOT_BITS, MOST_SLOT_BITS, SLOTS_A_GRAM, HASHES = 19, 24, 24, 2
SIZES = (1, 2, 3, 4)
LETTER = re.compile(r"[^\W\d_]")


def gram_hashes(data: np.ndarray, offs: np.ndarray, size: int):
    """(hash, text number) of the byte n-grams of one size. Bytes are lower-cased (A-Z); all other
    ASCII than letters and digits is one mark, which an n-gram of one or two bytes doesn't hold
    and a longer one holds at its ends only."""
    low = ts.LOWER[data]
    keep = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
    n = len(low) - size + 1
    if n < 1:
        return np.zeros(0, ts.U), np.zeros(0, np.int64)
    low = np.where(keep, low, 0).astype(ts.U)
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    ok = row[:n] == row[size - 1 :]
    code = np.full(n, size, ts.U)
    for i in range(size):
        code = (code << ts.U(8)) | low[i : n + i]
        if size < 3 or 0 < i < size - 1:
            ok &= keep[i : n + i]
    at = np.flatnonzero(ok)
    return ts.mix(code[at]), row[at]


@dataclass
class LanguageFilter:
    languages: list
    slots: np.ndarray  # of bits, one word a slot, 2**n slots

    def fill(self) -> np.ndarray:
        """The chance of each language that HASHES slots have its bit."""
        return np.array([float(((self.slots >> ts.U(i)) & ts.U(1)).mean()) ** HASHES for i in range(len(self.languages))])

    def places(self, h: np.ndarray):
        for i in range(HASHES):
            yield ((h >> ts.U(i * 32)) & ts.U(len(self.slots) - 1)).astype(np.int64)

    def add(self, h: np.ndarray, language: int) -> None:
        for p in self.places(h):
            self.slots[p] |= ts.U(1 << language)

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The languages that contain each n-gram, as bits."""
        out = None
        for p in self.places(h):
            out = self.slots[p] if out is None else out & self.slots[p]
        return out


class LanguageModel:
    """Filters of WORD_BITS languages each, in order of the languages."""

    def __init__(self, languages: list, grams: int = 0):
        """grams: n-grams of the language that has most of them."""
        self.languages = languages
        bits = min(MOST_SLOT_BITS, max(SLOT_BITS, (grams * SLOTS_A_GRAM).bit_length()))
        self.filters = [LanguageFilter(languages[i : i + WORD_BITS], np.zeros(1 << bits, ts.U)) for i in range(0, len(languages), WORD_BITS)]

    def add(self, h: np.ndarray, language: int) -> None:
        self.filters[language // WORD_BITS].add(h, language % WORD_BITS)

    def shares(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """A row per text: each language's share of its n-grams, less what chance gives."""
        rows, k = len(offs) - 1, len(self.languages)
        hits, seen = np.zeros((rows, k)), np.zeros(rows)
        for size in SIZES:
            h, row = gram_hashes(data, offs, size)
            seen += np.bincount(row, minlength=rows)
            for w, part in enumerate(self.filters):
                mask = part.masks(h)
                for i in range(len(part.languages)):
                    hits[:, w * WORD_BITS + i] += np.bincount(row, weights=((mask >> ts.U(i)) & ts.U(1)).astype(float), minlength=rows)
        chance = np.concatenate([part.fill() for part in self.filters])
        return np.clip((hits / np.maximum(seen, 1)[:, None] - chance) / np.maximum(1 - chance, 1e-9), 0, 1) * (seen > 0)[:, None]


def _count(batches):
    for batch in batches:
        langs = batch.column("lang").to_pylist()
        names = sorted(set(langs))
        code = np.array([names.index(x) for x in langs])
        for first, n, data, offs in ts.runs(batch):
            for size in SIZES:
                h, row = gram_hashes(data, offs, size)
                for i, name in enumerate(names):
                    grams, count = np.unique(h[code[first + row] == i], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(grams), pa.string()), pa.array([size] * len(grams), pa.int32()), pa.array(grams.view(np.int64)), pa.array(count)], ["lang", "size", "gram", "n"])


def distinctive(counts: DataFrame) -> DataFrame:
    """(lang, gram) of counts(lang, size, gram, n): n-grams that a language has LEAST times or more, at
    a rate that no other language has over 1 / RATIO times of. All of them are kept."""
    total = counts.groupBy("lang", "size").agg(F.sum("n").alias("total"))
    rate = counts.join(F.broadcast(total), ["lang", "size"]).withColumn("rate", F.col("n") / F.col("total"))  # a row a language and size
    top = rate.withColumn("top", F.max("rate").over(W.partitionBy("size", "gram")))
    return top.where((F.col("rate") >= RATIO * F.col("top")) & (F.col("n") >= LEAST)).select("lang", "gram")


def trained(labeled: DataFrame, sample: int = SAMPLE) -> LanguageModel:
    """A model from about `sample` rows at most of labeled(doc_id, text, lang), which bounds the n-grams
    that reach the driver: those that occur LEAST times in the sample's texts and tell languages apart."""
    prepared(labeled.sparkSession)
    rows = labeled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    parts = max(1, -(-rows.count() // sample))
    rows = staged(rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) == 0), "sample")
    counts = rows.select("text", "lang").mapInArrow(_count, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    counts = staged(counts, "counts")
    languages = sorted(r[0] for r in rows.select("lang").distinct().collect())
    numbers = labeled.sparkSession.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, number int")
    model = distinctive(counts).join(F.broadcast(numbers), "lang").select("number", "gram").toArrow()
    dropped(rows)
    dropped(counts)
    number, gram = model["number"].to_numpy(), model["gram"].to_numpy().view(ts.U)
    out = LanguageModel(languages, int(np.bincount(number, minlength=1).max()))
    for i in range(len(languages)):
        out.add(gram[number == i], i)
    return out


def identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """(doc_id, lang_pred, score) of each row of docs(doc_id, text)."""
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # 2**MOST_SLOT_BITS words at most for each 64 languages

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column("text")
            for first, n, data, offs in ts.runs(batch):
                share = m.shares(data, offs) if m.languages else np.zeros((n, 0))
                lettered = [bool(t and LETTER.search(t)) for t in texts.slice(first, n).to_pylist()]
                best = share.argmax(1) if m.languages else np.zeros(n, int)
                pred = [m.languages[b] if ok and m.languages else "und" for b, ok in zip(best, lettered)]
                score = [float(share[i, best[i]]) if ok and m.languages else 0.0 for i, ok in enumerate(lettered)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n).cast(pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    out = identified(docs, trained(docs.where(rest != 0)))
    return out.select("doc_id", (rest == 0).alias("held_out"), "lang_pred", "score")
