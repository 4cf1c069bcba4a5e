"""Quality rules from repetition: rolling hashes of several n-gram lengths measure how much of a
text lies inside n-grams and lines that it repeats.

Words are runs of other characters than [\\x20\\x09-\\x0D]; lengths are in code points. A null text
has no words and fails the base rules; so does an empty one. Windows never cross documents.
Repeated rows are judged each on its own; extra columns are ignored; an empty table gives an
empty result. Nothing shuffles: a row's verdict needs that row alone. Equal lines are compared byte
by byte, equal n-grams by the 64-bit hashes of all their words.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import textscan as ts
from .shared import prepared, table

#: Symbol characters.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: Most of a text's word characters inside repeated n-grams, by n, and inside repeated lines.
MAX_NGRAM_SHARE = {5: 0.40, 10: 0.30, 20: 0.30}
MAX_LINE_SHARE = 0.30

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, " + "".join(f"dup{n}_chars long, " for n in MAX_NGRAM_SHARE) + "base_failed boolean, kept boolean"


def measure(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text, from the bytes of many."""
    start, end, at = ts.words(data, offs)
    row, n = ts.rows_of(at), len(start)
    inside = ~ts.SPACE[data]
    point = (data & 0xC0) != 0x80
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS.encode())] = True
    out = {"n_words": np.diff(at), "word_chars": ts.sums(inside & point, offs), "n_symbols": ts.sums(symbol[data], offs)}
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(point, out=points[1:])
    word_len = points[end] - points[start]

    # lines that hold a word
    cut = np.flatnonzero(data == 10)
    first, last = np.sort(np.concatenate([offs[:-1], cut + 1])), np.sort(np.concatenate([cut, offs[1:]]))
    at_word = np.searchsorted(start, first)
    full = at_word < np.searchsorted(start, last)
    first, last, at_word = first[full], last[full], at_word[full]
    line_row = np.searchsorted(offs, first, "right") - 1
    one, group = ts.distinct_spans(data, first, last, line_row)
    again = np.flatnonzero(one[group] != np.arange(len(first)))
    rows = len(offs) - 1
    out["n_dup_lines"] = np.bincount(line_row[again], minlength=rows)
    chars = points[last] - points[first]
    out["dup_line_chars"] = np.bincount(line_row[again], weights=chars[again], minlength=rows).astype(np.int64)

    h = ts.span_hashes(data, start, end)
    salt = ts.mix(row.astype(ts.U))
    for k in sorted({REPEAT_WINDOW, *MAX_NGRAM_SHARE}):
        windows, ok = ts.window_hashes(h, k), ts.in_one_row(row, k)
        where = np.flatnonzero(ok)
        hit = where[ts.repeated(ts.mix(windows[where] ^ salt[where]), lambda a, b: ts.same_windows(h, where[a], where[b], k) & (row[where[a]] == row[where[b]]))]
        mask = ts.covered(hit, k, n)
        if k == REPEAT_WINDOW:
            out["n_repeat_words"] = ts.sums(mask, at)
        if k in MAX_NGRAM_SHARE:
            out[f"dup{k}_chars"] = ts.sums(word_len * mask, at)
    out["base_failed"] = (out["n_words"] < MIN_WORDS) | (100 * out["n_repeat_words"] > MAX_REPEAT_PERCENT * out["n_words"])
    bad = out["dup_line_chars"] > MAX_LINE_SHARE * out["word_chars"]
    for k, most in MAX_NGRAM_SHARE.items():
        bad |= out[f"dup{k}_chars"] > most * out["word_chars"]
    out["kept"] = ~out["base_failed"] & ~bad
    return out


def _judge(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for first, n, data, offs in ts.runs(batch):
            got = measure(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n).cast(pa.int64())] + [pa.array(got[x]) for x in names[1:]], names)


def repetition_rules(docs: DataFrame) -> DataFrame:
    """The counts and verdict of each row of docs(doc_id, text)."""
    prepared(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(_judge, SCHEMA)


def _filtered(batches):
    for batch in batches:
        keep = [measure(data, offs)["kept"] for _, _, data, offs in ts.runs(batch)]
        yield batch.filter(pa.array(np.concatenate(keep))) if keep else batch


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they are, in one pass."""
    prepared(docs.sparkSession)
    return docs.mapInArrow(_filtered, docs.schema)


def op1(spark, sf_dir: str) -> DataFrame:
    return repetition_rules(table(spark, sf_dir, "documents"))
