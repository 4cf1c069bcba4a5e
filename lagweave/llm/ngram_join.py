"""Similarity join on word n-gram sets by rare-first prefix filtering.

Texts with equal sets are one node; nodes are numbered, sets are told apart by their size and two
64-bit sums, texts by two 64-bit hashes. N-grams are ordered rare first: by the count of their
bucket in a table of counts over all documents (as many buckets as the input asks for, up to
2**MOST_SKETCH_BITS; a byte a bucket, the count's logarithm, reaches the driver and the tasks),
then by hash. Any such order gives the same links; a good one makes prefixes selective. Two sets
that are similar enough share an n-gram in their prefixes, and the first they share leaves room for
the overlap they need (positional filter); their sizes must be near (length filter), and so must
their counts in BINS hash ranges (suffix filter).

Candidates come from joins on prefix n-grams, in two rounds, so that a large group of near copies
isn't compared pair by pair: first every member of an n-gram's group with one hub, the member that
has the n-gram earliest; then, after components of the links found, only pairs in different
components, or all other pairs if every link is asked for. These join on the n-gram and a band of
set sizes, so an n-gram that many sets have in their prefixes is dealt out by band, and a large band
by blocks of its members. Each pair is verified once, on the n-gram sets of whole texts; no candidate is dropped.

Words are lower-cased (A-Z) runs of other characters than [\\x20\\x09-\\x0D]. With fewer than k
words the whole sequence is the one member of the set. A null or wordless text has an empty set
and links with nothing. A component is named by its smallest doc_id; null doc_ids are left out of
that, so the name is null only if all of them are. Rows that repeat a doc_id are judged each by
its own text. Empty tables give empty results; extra columns are ignored.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textscan as ts
from .components import components
from .shared import prepared, staged, table

NGRAM = 5
SIMILARITY = (80, 100)
#: Buckets of n-gram counts: the text's bytes over this, between these powers of two.
SKETCH_BYTES, LEAST_SKETCH_BITS, MOST_SKETCH_BITS = 256, 16, 24
SKETCH_CHUNK = 1 << 12
BINS = 64
#: Members of a block, about, of a large group that shares an n-gram and a band of sizes.
BLOCK = 1000


def ngram_sets(data: np.ndarray, offs: np.ndarray, k: int):
    """(sorted distinct n-gram hashes of each text, first of each text and of the end)."""
    start, end, at = ts.words(ts.LOWER[data], offs)
    h, row = ts.span_hashes(ts.LOWER[data], start, end), ts.rows_of(at)
    ok = np.flatnonzero(ts.in_one_row(row, k))
    grams, of = [ts.window_hashes(h, k)[ok]], [row[ok]]
    count = np.diff(at)
    for few in range(1, k):
        short = np.flatnonzero(count == few)
        if len(short):
            grams.append(ts.mix(ts.window_hashes(h, few)[at[short]] + ts.U(few)))
            of.append(short)
    grams, of = np.concatenate(grams), np.concatenate(of)
    order = np.argsort(grams)
    order = order[np.argsort(of[order].astype(np.uint16 if len(count) < 1 << 16 else np.int64), kind="stable")]
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], np.searchsorted(of[new], np.arange(len(count) + 1))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc, text, k1, k2): two independent hashes name a text."""
    return docs.select(F.col("doc_id").alias("doc"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64(F.lit("2"), "text"))


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    c = np.concatenate([np.zeros(1, ts.U), np.cumsum(values, dtype=ts.U)])
    return (c[at[1:]] - c[at[:-1]]).view(np.int64)


def sketch_bits(docs: DataFrame) -> int:
    """As many buckets, as a power of two, as the texts' bytes ask for."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return min(MOST_SKETCH_BITS, max(LEAST_SKETCH_BITS, (size // SKETCH_BYTES).bit_length()))


def set_profiles(docs: DataFrame, k: int, bits: int) -> DataFrame:
    """Rows of two kinds: of a text (doc, k1, k2, n, two sums over its set, counts by hash range), and
    of a run of buckets (k1 is its number, counts the packed counts in one task, the rest null)."""

    def run(batches):
        total = np.zeros(1 << bits, np.int32)
        names = ["doc", "k1", "k2", "n", "c1", "c2", "bins", "counts"]
        for batch in batches:
            for first, rows, data, offs in ts.runs(batch):
                grams, at = ngram_sets(data, offs, k)
                place, count = np.unique((grams >> ts.U(64 - bits)).astype(np.int64), return_counts=True)
                total[place] += count.astype(np.int32)
                bins = np.bincount(ts.rows_of(at) * BINS + (grams & ts.U(BINS - 1)).astype(np.int64), minlength=rows * BINS).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BINS + 1, BINS, dtype=np.int32)), pa.array(bins))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, rows) for c in ("doc", "k1", "k2")), pa.array(np.diff(at)), pa.array(_sums(ts.mix(grams), at)), pa.array(_sums(ts.mix(grams ^ ts.U(0x5851F42D4C957F2D)), at)), lists, pa.nulls(rows, pa.binary())], names)
        for i in range(len(total) // SKETCH_CHUNK):
            part = total[i * SKETCH_CHUNK : (i + 1) * SKETCH_CHUNK]
            if part.any():
                null = pa.nulls(1, pa.int64())
                yield pa.RecordBatch.from_arrays([null, pa.array([i]), null, null, null, null, pa.nulls(1, pa.list_(pa.int32())), pa.array([pa.compress(part.tobytes(), "lz4", asbytes=True)])], names)

    return _keyed(docs).mapInArrow(run, "doc long, k1 long, k2 long, n long, c1 long, c2 long, bins array<int>, counts binary")


def rarity(profiles: DataFrame, bits: int) -> np.ndarray:
    """A byte for each bucket: eight times the logarithm of its count. Counts are added up where
    chunks of buckets meet; the driver gets 2**bits bytes."""

    def added(batches):
        have: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, packed in zip(batch.column("k1").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(pa.decompress(packed, 4 * SKETCH_CHUNK, "lz4"), np.int32)
                have[i] = have[i] + part if i in have else part.astype(np.int64)
        for i, n in have.items():
            yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([np.minimum(8 * np.log2(n + 1), 255).astype(np.uint8).tobytes()])], ["chunk", "place"])

    got = profiles.where("counts is not null").select("k1", "counts").repartition("k1").mapInArrow(added, "chunk long, place binary").toArrow()
    out = np.zeros(1 << bits, np.uint8)
    for i, part in zip(got["chunk"].to_pylist(), got["place"].to_pylist()):
        out[i * SKETCH_CHUNK : (i + 1) * SKETCH_CHUNK] = np.frombuffer(part, np.uint8)
    return out


def prefixes(docs: DataFrame, place: np.ndarray, k: int, similarity) -> DataFrame:
    """(k1, k2, n, grams): each text's first n-grams in rare-first order, as many as a partner of the
    smallest size that is near enough could miss, and one."""
    num, den = similarity
    bits = len(place).bit_length() - 1
    shared = docs.sparkSession.sparkContext.broadcast(place)  # 2**MOST_SKETCH_BITS bytes at most

    def run(batches):
        rare = shared.value
        for batch in batches:
            for first, rows, data, offs in ts.runs(batch):
                grams, at = ngram_sets(data, offs, k)
                key = (rare[(grams >> ts.U(64 - bits)).astype(np.int64)].astype(ts.U) << ts.U(56)) | (grams >> ts.U(8))
                n = np.diff(at)
                size = np.where(n > 0, n + (-num * n) // den + 1, 0)  # n - ceil(num * n / den) + 1
                heads = [np.sort(key[a:b])[:m] for a, b, m in zip(at[:-1], at[1:], size)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(np.concatenate([*heads, np.zeros(0, ts.U)]).view(np.int64)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, rows) for c in ("k1", "k2")), pa.array(n), lists], ["k1", "k2", "n", "grams"])

    return _keyed(docs).select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, n long, grams array<long>")


def _fits(a: str, b: str, similarity):
    """The length filter, and the positional filter for the first shared n-gram of a pair."""
    num, den = similarity
    room = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    near = F.least(F.col(f"{a}.n"), F.col(f"{b}.n")) * den >= F.greatest(F.col(f"{a}.n"), F.col(f"{b}.n")) * num
    return near & (room * (num + den) >= num * (F.col(f"{a}.n") + F.col(f"{b}.n")))


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, similarity) -> DataFrame:
    """The pairs (u, v) of nodes that link. After the suffix filter, both texts come by joins on
    their hashes; only texts that may be in a pair shuffle."""
    num, den = similarity
    most = pairs.count()
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("bins").alias(f"b{x}")) for x in "uv")
    shared = F.aggregate(F.zip_with("bu", "bv", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    left = staged(pairs.join(a, "u").join(b, "v").where(shared.cast("long") * (num + den) >= num * (F.col("nu") + F.col("nv"))).select("u", "v"), "pairs", rows=most)
    return confirmed(left, docs, nodes, k, similarity, most)


def confirmed(left: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, similarity, most: int) -> DataFrame:
    """Of the staged pairs (u, v), at most so many, those that link by the sets of whole texts. Staged;
    pairs are dropped."""
    num, den = similarity
    ends = left.select(F.col("u").alias("node")).unionByName(left.select(F.col("v").alias("node"))).distinct()
    ends = staged(ends.join(nodes.select("node", "k1", "k2"), "node"), "ends", rows=2 * most)
    some = _keyed(docs).where(bloom.passes(docs.sparkSession, bloom.members(ends, "k1"), F.col("k1")))
    texts = staged(some.join(ends, ["k1", "k2"]).groupBy("node").agg(F.max("text").alias("text")), "texts", spent=(ends,))
    both = left.join(texts.select(F.col("node").alias("u"), F.col("text").alias("tu")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("tv")), "v")

    def run(batches):
        for batch in batches:
            for i in range(0, len(batch), 256):
                part, ok = batch.slice(i, 256), []
                sets = [[s for _, _, data, offs in ts.runs(part, c) for g, at in [ngram_sets(data, offs, k)] for s in np.split(g, at[1:-1])] for c in ("tu", "tv")]
                for x, y in zip(*sets):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(common > 0 and den * common >= num * (len(x) + len(y) - common))
                yield part.select(["u", "v"]).filter(pa.array(ok))

    return staged(both.mapInArrow(run, "u long, v long"), "links", spent=(left, texts))


def jaccard_links(docs: DataFrame, k: int = NGRAM, similarity=SIMILARITY, every_link: bool = True, block: int = BLOCK):
    """(profiles, links): profiles has doc, k1, k2, n and node of every row; links are pairs (u, v) of
    nodes u < v, all of them with every_link, else enough of them for the components."""
    spark = prepared(docs.sparkSession)
    bits = sketch_bits(docs)
    rows = staged(set_profiles(docs, k, bits), "profiles")
    texts = rows.where("counts is null")
    sets = texts.where("n > 0").groupBy("n", "c1", "c2").agg(F.min(F.struct("k1", "k2")).alias("t"), F.first("bins").alias("bins"))
    nodes = staged(sets.select(F.monotonically_increasing_id().alias("node"), "n", "c1", "c2", "t.k1", "t.k2", "bins"), "nodes")
    profiles = staged(texts.select("doc", "k1", "k2", "n", "c1", "c2").join(nodes.select("node", "n", "c1", "c2"), ["n", "c1", "c2"], "left").select("doc", "k1", "k2", "n", "node"), "documents")

    # copies of a text collapse before the shuffle, so a hot text is a row a task
    own = prefixes(docs, rarity(rows, bits), k, similarity).groupBy("k1", "k2", "n").agg(F.first("grams").alias("grams"))
    grams = staged(own.join(nodes.select("node", "k1", "k2"), ["k1", "k2"]).select("node", "n", F.posexplode("grams").alias("pos", "gram")), "prefixes", spent=(rows,))
    again = staged(grams.where(bloom.passes(spark, bloom.repeated(grams, "gram", bloom.COARSE), F.col("gram"))), "repeated_grams", spent=(grams,))
    hubs = again.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min(F.struct("pos", "node", "n")).alias("h")).where("k > 1")
    hubs = staged(hubs.select("gram", "h.*"), "hubs")
    groups = staged(again.join(hubs.select("gram"), "gram", "left_semi"), "groups", spent=(again,))
    star = groups.alias("a").join(hubs.alias("b"), F.col("a.gram") == F.col("b.gram")).where((F.col("a.node") != F.col("b.node")) & _fits("a", "b", similarity))
    pair = (F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    tried = staged(star.select(*pair).distinct(), "star", spent=(hubs,))
    first = verified(tried, docs, nodes, k, similarity)

    if every_link:
        apart, labeled = F.lit(True), groups.withColumn("component", F.col("node"))
    else:
        apart = F.col("a.component") != F.col("b.component")
        found = components(first)
        labeled = groups.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    labeled = staged(labeled, "labeled", spent=(groups,))
    mixed = labeled.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
    # sizes that are near enough are in one band or in neighbours
    num, den = similarity
    band = F.floor(F.log(F.col("n").cast("double")) / (float(np.log(den / num)) * (1 + 1e-9) if num < den else 1e-9))
    mixed = staged(mixed, "mixed")
    banded = staged(labeled.join(mixed, "gram", "left_semi").withColumn("band", band), "mixed_groups", spent=(labeled, mixed))
    # a large band is cut into blocks, so that no task pairs all of its members
    sizes = staged(banded.groupBy("gram", "band").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks")), "blocks")
    reach = banded.withColumn("near", F.explode(F.array("band", F.col("band") + 1))).join(sizes.withColumnRenamed("band", "near"), ["gram", "near"])
    reach = reach.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = banded.join(sizes, ["gram", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    order = (F.col("a.band") < F.col("b.band")) | (F.col("a.node") < F.col("b.node"))
    rest = reach.alias("a").join(dealt.alias("b"), (F.col("a.gram") == F.col("b.gram")) & (F.col("a.near") == F.col("b.band")) & (F.col("a.to") == F.col("b.block")) & order & apart & _fits("a", "b", similarity))
    rest = staged(rest.select(*pair).distinct().join(tried, ["u", "v"], "left_anti"), "rest", spent=(banded, sizes))
    more = verified(rest, docs, nodes, k, similarity)
    return profiles, staged(first.unionByName(more), "all_links", spent=(first, more, tried, rest, nodes))


def _placed(docs: DataFrame, k: int, similarity) -> DataFrame:
    """(doc, k1, k2, n, component) of each row; component is a node, null without words."""
    profiles, links = jaccard_links(docs, k, similarity, every_link=False)
    found = components(links)
    placed = profiles.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    return staged(placed.select("doc", "k1", "k2", "n", "component"), "placed", spent=(profiles, links))


def near_duplicates(docs: DataFrame, k: int = NGRAM, similarity=SIMILARITY) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row."""
    placed = _placed(docs, k, similarity)
    names = staged(placed.where("component is not null").groupBy("component").agg(F.min("doc").alias("name")), "names")
    return placed.join(names, "component", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("name")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = NGRAM, similarity=SIMILARITY) -> DataFrame:
    """docs with one row of each group (the smallest doc_id, null ones last, then the least hash of
    the text), all columns kept. Rows are told apart by doc_id and text; of rows that repeat both,
    one stays. Rows without words are in no group and stay."""
    placed = _placed(docs, k, similarity).where("component is not null")
    order = F.struct(F.col("doc").isNull().alias("last"), "doc", "k1", "k2")
    groups = staged(placed.groupBy("component").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("rows")), "names").where("rows > 1")
    judged = placed.join(groups, "component").withColumn("stays", order == F.col("one"))
    marks = staged(judged.groupBy(F.col("doc").alias("__doc"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2")).agg(F.max("stays").alias("__stays"), F.count(F.lit(1)).alias("__n")).where("not __stays or __n > 1").drop("__n"), "marks")
    again = staged(marks.where("__stays"), "repeated")  # mostly empty: then nothing shuffles for it

    cols = docs.columns
    text = F.coalesce("text", F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in cols]).alias("r"), F.col("doc_id").alias("doc"), F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("2"), text).alias("k2"))
    same = F.col("doc").eqNullSafe(F.col("__doc")) & (F.col("k1") == F.col("__k1")) & (F.col("k2") == F.col("__k2"))
    clear = whole.join(marks, same, "left_anti")
    repeated = whole.join(again, same, "left_semi").groupBy("doc", "k1", "k2").agg(F.min_by("r", F.xxhash64("r")).alias("r"))
    return clear.select("r.*").unionByName(repeated.select("r.*"))


def op7(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), 3, (90, 100))


def components_sql(k: int, similarity) -> str:
    """Common table expressions e(doc_id, s), with the set s of each document, and c(doc_id,
    component_id), from all pairs that share an n-gram."""
    gram = ", ".join(f"w[i + {x}]" for x in range(k))
    num, den = similarity
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
e AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - {k - 2}), lambda i: concat_ws(' ', {gram}))) END AS s FROM d),
g AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS gram FROM e),
p AS (SELECT a.doc_id AS u, b.doc_id AS v FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, p.v FROM r JOIN p ON p.u = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)"""


SQL = f"{components_sql(3, (90, 100))} SELECT e.doc_id, len(s)::BIGINT AS n_shingles, component_id FROM e JOIN c ON c.doc_id = e.doc_id"
