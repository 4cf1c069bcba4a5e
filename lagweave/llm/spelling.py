"""Spelling variants of a corpus' words, found by products of letter counts.

Two words that differ by one replaced code point have letter counts at a squared distance of 2, by one
inserted or deleted code point at 1. Words lie in blocks of one length and one vector of counts by
letter group (letters are dealt to the groups by how often they occur, so that blocks are even; there
are more groups when there are more words). A word's near words are in its own block or in one where
one group has a letter more, or one a letter less and another a letter more. A block is cut into tiles
of bounded size; each tile meets the tiles of its own and of following blocks once. There one matrix
product of letter counts gives all squared distances, pairs at the wanted one are verified by their
code points, and only a row per word and pair of tiles (near words, the best of them) comes out, so no
list of pairs ever moves. Letters are counted exactly (64-bit floats for words of over 2000 letters).

Words are maximal runs of [A-Za-z\\u00C0-\\u00FF] of whole texts, A-Z lower-cased, that have at least
`shortest` code points and occur `least` times or more. A null or empty text has none. A word's form is
its near word of largest n (ties: the smallest in code-point order) if that n is `ratio` times the
word's n or more, and its root is where following forms ends. Repeated rows count each; an empty table
gives an empty result; other columns are ignored. With `noise`, which the query sets, a code point is
taken out of some occurrences by a rule on doc_id (a null one counts as an empty string) and word.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .shared import prepared, small_batches, staged, table

SHORTEST, LEAST, RATIO = 7, 2, 10
NOISE = 31
#: Words and code points of a tile, about; pairs that are verified at once.
TILE_WORDS, TILE_LETTERS = 1024, 1 << 21
CHUNK = 1 << 16
#: Bytes of the runs of texts whose words are counted together.
COUNT_BYTES = 1 << 22

#: Bytes of a-z, and of the first byte of À-ÿ in UTF-8.
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[0xC3] = True
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, (_CRC >> 1) ^ np.uint32(0xEDB88320), _CRC >> 1)
#: All letters that words can have.
ALPHABET = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
_COLUMN = np.zeros(256, np.int64)
_COLUMN[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def _runs_of_letters(data: np.ndarray, offs: np.ndarray):
    """(start, end, text) of the maximal runs of letters in lower-cased bytes."""
    inside = _LETTER[data]
    inside[1:] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[0], edge[-1] = inside[0], inside[-1]
    edge[offs] = True  # a text's end ends its runs
    at = np.flatnonzero(edge)
    whole = np.flatnonzero(inside[at[:-1]])
    start, end = at[whole], at[whole + 1]
    return start, end, np.searchsorted(offs, start, "right") - 1


def _crc(data: np.ndarray, start: np.ndarray, end: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The crc32 of each span that follows what has left the given crc32."""
    state = ~state.astype(np.uint32)
    order = np.argsort(start - end, kind="stable")  # the longest first
    size, begin, value = (end - start)[order], start[order], state[order]
    left = np.searchsorted(-size, -np.arange(int(size.max(initial=0))), "left")  # spans with more than i bytes
    for i, n in enumerate(left.tolist()):
        value[:n] = _CRC[(value[:n] ^ data[begin[:n] + i]) & 0xFF] ^ (value[:n] >> 8)
    state[order] = value
    return ~state


def _without(data: np.ndarray, start: np.ndarray, end: np.ndarray, place: np.ndarray):
    """The spans one after another without their code points of those numbers: (bytes, start, end)."""
    size = end - start
    begin = np.cumsum(size) - size
    flat = data[np.repeat(start - begin, size) + np.arange(int(size.sum()))]
    lead = (flat & 0xC0) != 0x80
    number = np.cumsum(lead) - 1  # of the code point that a byte belongs to
    keep = number != np.repeat(number[begin] + place, size)
    to = np.concatenate([[0], np.cumsum(keep)])
    return flat[keep], to[begin], to[begin + size]


def word_counts(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, noise: int | None = None) -> DataFrame:
    """(word, n) of all words of docs(doc_id, text). A task gives each word of a few texts once."""

    def run(batches):
        for batch in batches:
            for first, rows, data, offs in ts.runs(batch, limit=COUNT_BYTES):
                if not len(data):
                    continue
                data = ts.LOWER[data]
                start, end, text = _runs_of_letters(data, offs)
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                letters = lead[end] - lead[start]
                long = np.flatnonzero(letters >= shortest)
                start, end, text, letters = start[long], end[long], text[long], letters[long]
                if noise:
                    ids = batch.column("doc_id").slice(first, rows).to_pylist()
                    begun = np.array([zlib.crc32(b":" if i is None else f"{i}:".encode()) for i in ids], np.uint32)
                    h = _crc(data, start, end, begun[text])
                    hit = h % noise == 0
                    cut = np.flatnonzero(hit & (letters > shortest))
                    more, a, b = _without(data, start[cut], end[cut], h[cut] % letters[cut])
                    clean = np.flatnonzero(~hit)
                    start, end = np.concatenate([start[clean], a + len(data)]), np.concatenate([end[clean], b + len(data)])
                    data = np.concatenate([data, more])
                if len(start):
                    one, group = ts.distinct_spans(data, start, end)
                    size = end[one] - start[one]
                    to = np.concatenate([[0], np.cumsum(size)])
                    flat = data[np.repeat(start[one] - to[:-1], size) + np.arange(to[-1])]
                    text_of = pa.Array.from_buffers(pa.large_string(), len(one), [None, pa.py_buffer(to.astype(np.int64)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([text_of.cast(pa.string()), pa.array(np.bincount(group, minlength=len(one)))], ["word", "n"])

    prepared(docs.sparkSession)
    counted = docs.select("doc_id", "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The alphabet in groups of about equal use; a row a letter comes to the driver."""
    used = dict(words.select(F.explode(F.split("word", "")).alias("c")).groupBy("c").count().collect())
    out, load = [""] * groups, [0] * groups
    for c in sorted(ALPHABET, key=lambda c: (-used.get(c, 0), c)):
        i = load.index(min(load))
        out[i], load[i] = out[i] + c, load[i] + used.get(c, 0)
    return out


def _block(counts: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in counts])


def tiles_of(words: DataFrame, groups: list[str], tile_words: int = TILE_WORDS, tile_letters: int = TILE_LETTERS):
    """(tiles, sizes): tiles has block, tile, the counts c by group and the words with their n in
    code-point order; sizes has the number of tiles of each block."""
    counts = [F.length("word") - F.length(F.translate("word", g, "")) for g in groups]
    blocked = words.withColumn("c", F.array(*counts)).withColumn("block", _block([F.col("c")[i] for i in range(len(groups))]))
    blocked = staged(blocked, "blocked")
    most = F.greatest(F.count(F.lit(1)) / F.lit(tile_words), F.sum(F.length("word")) / F.lit(tile_letters))
    sizes = staged(blocked.groupBy("block").agg(F.ceil(most).cast("int").alias("tiles")), "sizes")
    dealt = blocked.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int"))
    tiles = dealt.groupBy("block", "tile").agg(F.first("c").alias("c"), F.sort_array(F.collect_list(F.struct("word", "n"))).alias("own"))
    return staged(tiles, "tiles", spent=(blocked,)), sizes


def tile_pairs(tiles: DataFrame, sizes: DataFrame, groups: int) -> DataFrame:
    """(own, other, same, longer): every two tiles that can hold near words, once: a tile itself and
    those of its block behind it, those of blocks where an earlier group has a letter less and a
    later one a letter more, and those of blocks with a letter more."""
    c = [F.col("c")[i] for i in range(groups)]
    moved = lambda less, more: _block([c[i] - int(i == less) + int(i == more) for i in range(groups)])
    to = [F.col("block")] + [moved(g, h) for g in range(groups) for h in range(g + 1, groups)] + [moved(None, g) for g in range(groups)]
    plain = 1 + groups * (groups - 1) // 2
    reach = tiles.select("block", "tile", "own", F.posexplode(F.array(*to)).alias("kind", "to")).join(sizes.withColumnRenamed("block", "to"), "to")
    reach = reach.withColumn("to_tile", F.explode(F.sequence(F.when(F.col("kind") == 0, F.col("tile")).otherwise(F.lit(0)), F.col("tiles") - 1)))
    other = tiles.select(F.col("block").alias("to"), F.col("tile").alias("to_tile"), F.col("own").alias("other"))
    both = reach.join(other, ["to", "to_tile"])
    return both.select("own", "other", ((F.col("kind") == 0) & (F.col("tile") == F.col("to_tile"))).alias("same"), (F.col("kind") >= plain).alias("longer"))


class Tile:
    """Words of one length: code points, letter counts and n."""

    def __init__(self, lists: pa.ListScalar):
        values = lists.values
        self.words, self.n = values.field("word").to_pylist(), np.asarray(values.field("n"))
        self.codes = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32).reshape(len(self.words), -1).astype(np.uint8)  # below 256 all
        rows = np.repeat(np.arange(len(self.words)), self.codes.shape[1]) * len(ALPHABET)
        self.letters = np.bincount(rows + _COLUMN[self.codes.ravel()], minlength=len(self.words) * len(ALPHABET)).reshape(-1, len(ALPHABET))


def _differ_by_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether rows of code points differ at one place; rows of b may be one longer."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    n = a.shape[1]
    ahead, behind = a == b[:, :n], a == b[:, 1:]
    front = np.where(ahead.all(axis=1), n, ahead.argmin(axis=1))
    back = np.where(behind.all(axis=1), n, behind[:, ::-1].argmin(axis=1))
    return front + back >= n


def near_pairs(a: Tile, b: Tile, same: bool):
    """Numbers of the near words of two tiles, by the squared distances of their letter counts."""
    want = 1 if a.codes.shape[1] != b.codes.shape[1] else 2
    used = np.flatnonzero(a.letters.any(axis=0) & b.letters.any(axis=0))
    kind = np.float32 if a.codes.shape[1] <= 2000 else np.float64
    x, y = a.letters[:, used].astype(kind), b.letters[:, used].astype(kind)
    square = lambda t: (t.letters.astype(np.float64) ** 2).sum(axis=1).astype(kind)
    one = lambda t: np.ones(len(t), kind)
    left, right = np.column_stack([x, square(a), one(x)]), np.column_stack([-2 * y, one(y), square(b)])
    i, j = np.divmod(np.flatnonzero(left @ right.T == want), len(y))
    if same:
        i, j = i[i < j], j[i < j]
    step = max(1, CHUNK * 16 // a.codes.shape[1])
    good = [_differ_by_one(a.codes[i[k : k + step]], b.codes[j[k : k + step]]) for k in range(0, len(i), step)]
    good = np.concatenate([*good, np.zeros(0, bool)])
    return i[good], j[good]


def _best(of: np.ndarray, other: np.ndarray, n: np.ndarray):
    """(word, its near words, the one of them with the largest n, the earlier at ties)."""
    order = np.lexsort((other, -n[other], of))
    of, other = of[order], other[order]
    head = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.zeros(0, np.int64)
    return of[head], np.diff(np.append(head, len(of))), other[head]


def near_words(words: DataFrame, tile_words: int = TILE_WORDS, tile_letters: int = TILE_LETTERS) -> DataFrame:
    """(word, n_near, best, best_n) of the words(word, n) that have near ones."""
    many = words.count()
    groups = letter_groups(words, max(2, min(12, len(str(many)) - 1)))
    tiles, sizes = tiles_of(words, groups, tile_words, tile_letters)

    def run(batches):
        for batch in batches:
            for own, other, same, longer in zip(*(batch.column(c) for c in range(4))):
                a = Tile(own)
                b = a if same.as_py() else Tile(other)
                i, j = near_pairs(a, b, same.as_py())
                for of, to, p, q in ((a, b, i, j), (b, a, j, i)) if a is not b else ((a, a, np.concatenate([i, j]), np.concatenate([j, i])),):
                    at, count, best = _best(p, q, to.n)
                    if len(at):
                        yield pa.RecordBatch.from_arrays([pa.array([of.words[k] for k in at]), pa.array(count), pa.array([to.words[k] for k in best]), pa.array(to.n[best])], ["word", "k", "best", "best_n"])

    pairs = tile_pairs(tiles, sizes, len(groups))
    with small_batches(words.sparkSession, 16):
        found = staged(pairs.mapInArrow(run, "word string, k long, best string, best_n long"), "near", spent=(tiles, sizes))
    best = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", "b.best", (-F.col("b.m")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from forms(word, form), staged: each round every word takes the root of its root,
    so the longest chain halves. Forms lead to ever larger n, so there are no circles."""
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        moved = staged(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", spent=(now,))
        now = moved
        if moved.where("moved").isEmpty():
            return moved.drop("moved")


def variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO, noise: int | None = None, tile_words: int = TILE_WORDS, tile_letters: int = TILE_LETTERS) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs."""
    words = staged(word_counts(docs, shortest, least, noise), "words")
    near = near_words(words, tile_words, tile_letters)
    formed = F.col("best_n") >= ratio * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best")).alias("form"), F.when(formed, F.col("best_n")).alias("form_n"))
    judged = staged(judged, "judged", spent=(words,))
    ends = roots(judged.where("form is not null").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11(spark, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"), noise=NOISE)


SQL = r"""
WITH bits AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS s FROM documents),
r AS (SELECT doc_id, unnest(regexp_extract_all(s, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM d),
u AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 7 GROUP BY ALL),
b AS (SELECT *, list_transform(string_split(concat(doc_id, ':', run), ''), lambda c: unicode(c)) AS cp FROM u),
e AS (SELECT run, k, list_prepend(4294967295, flatten(list_transform(cp, lambda c: CASE WHEN c < 128 THEN [c] ELSE [195, c - 64] END))) AS bytes FROM b),
h AS (SELECT run, k, xor(list_reduce(list_transform(bytes, lambda x: x::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h FROM e, bits),
m AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, (h % length(run))::BIGINT), substr(run, (h % length(run))::BIGINT + 2)) ELSE run END AS word, k FROM h),
w AS (SELECT word, sum(k)::BIGINT AS n FROM m WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
x AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w),
p AS (SELECT word, n, i, concat(substr(word, 1, i - 1), '*', substr(word, i + 1)) AS hole, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS less FROM x),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM p AS a JOIN p AS b ON a.hole = b.hole AND a.word <> b.word
  UNION SELECT a.word, w.word FROM p AS a JOIN w ON a.less = w.word
  UNION SELECT w.word, a.word FROM p AS a JOIN w ON a.less = w.word),
o AS (SELECT a AS word, count(*) AS n_near, first(b ORDER BY w.n DESC, b) AS best, max(w.n) AS best_n FROM pairs JOIN w ON w.word = b GROUP BY a),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n FROM w LEFT JOIN o ON o.word = w.word)
SELECT f.word, f.form, coalesce(e.form, d.form, c.form, b.form, a.form, f.form, f.word) AS root, f.n, f.n_near, f.form_n
FROM f LEFT JOIN f AS a ON a.word = f.form LEFT JOIN f AS b ON b.word = a.form LEFT JOIN f AS c ON c.word = b.form LEFT JOIN f AS d ON d.word = c.form LEFT JOIN f AS e ON e.word = d.form
"""
