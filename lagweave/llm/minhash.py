"""Near duplicates by MinHash, banding and sequential Bayesian verification.

Texts with equal sets are one node. A node's signature is HASHES minima of its n-gram set under keyed
permutations, 16 bits of each. Bands of ROWS minima name buckets; two sets of similarity 0.8 share no
bucket in three of a million cases. Two nodes of a bucket are compared a batch of minima at a time: with
an even prior, m equal ones of n leave the posterior chance P(Bin(n + 1, s) <= m) that the similarity is
s or more, and a pair whose chance falls below MISS is dropped. What survives all batches is verified
on the n-gram sets of whole texts (ngram_join.confirmed), so links are never guessed.

A bucket's members are candidates of one hub, its least node. Each node is compared with the hub that it
shares most buckets with, one pair a node, and components of the links found are made; then with its
other hubs, where they are in other components. After that only buckets that hold more than one
component can have more links that matter. Such a bucket is cut into tiles of bounded size, and each
two of its tiles meet in one task: signatures are compared there as above, and likely pairs are
verified on the n-gram sets, which the tiles carry. A link joins two components for the pairs after it,
so a task verifies no pair that is joined already and lets out fewer links than its tiles have
components. No bucket is gathered, none is capped.

Words are lower-cased (A-Z) runs of other characters than [\\x20\\x09-\\x0D]; with fewer than k words the
whole sequence is the one member of a text's set. A null or wordless text has an empty set, links with
nothing and is kept. A component is named by its smallest doc_id; null doc_ids are left out of that, so
the name is null only if all of them are, and then all are kept. Rows that repeat a doc_id are judged
each by its own text, and rows with the component's name are all kept. Empty tables give empty results;
extra columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from . import textscan as ts
from .components import components
from .ngram_join import _keyed, _sums, components_sql, confirmed, ngram_sets
from .shared import prepared, small_batches, staged, table

NGRAM = 5
SIMILARITY = (80, 100)
BANDS, ROWS = 32, 5
HASHES = BANDS * ROWS
#: Minima that are compared at once, and the chance at which a pair is dropped.
BATCH, MISS = 32, 1e-6
#: Nodes of a tile, about; pairs that are compared at once.
TILE, CHUNK = 512, 1 << 16
#: N-grams of a tile, about.
TILE_GRAMS = 1 << 18

_KEYS = ts.mix(np.arange(1, 2 * HASHES + 1, dtype=ts.U))
_TIMES, _PLUS = _KEYS[:HASHES] | ts.U(1), _KEYS[HASHES:]


def least_matches(similarity, miss: float = MISS) -> list[tuple[int, int]]:
    """(minima compared, equal ones that a pair needs to go on) after each batch."""
    s, out = similarity[0] / similarity[1], []
    for n in range(BATCH, HASHES + 1, BATCH):
        chance, m = 0.0, -1
        while chance < miss:
            m += 1
            chance += math.comb(n + 1, m) * s**m * (1 - s) ** (n + 1 - m)
        out.append((n, m))
    return out


def signatures(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, HASHES) minima, 16 bits of each; texts without n-grams have zeros."""
    out = np.zeros((len(at) - 1, HASHES), np.uint16)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        begin = at[full]
        for i in range(HASHES):
            out[full, i] = (ts.mix(np.minimum.reduceat(grams * _TIMES[i] + _PLUS[i], begin)) >> ts.U(48)).astype(np.uint16)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """(texts, BANDS) keys of buckets."""
    key = np.repeat(np.arange(BANDS, dtype=ts.U)[None, :], len(signature), axis=0)
    for r in range(ROWS):
        key = ts.mix(key ^ ts.mix(signature[:, r::ROWS].astype(ts.U) + ts.U(r << 16)))
    return key


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """(doc, k1, k2, n, two sums over the set, signature) of each text."""

    def run(batches):
        for batch in batches:
            for first, rows, data, offs in ts.runs(batch):
                grams, at = ngram_sets(data, offs, k)
                flat = signatures(grams, at).tobytes()
                binary = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(0, (rows + 1) * 2 * HASHES, 2 * HASHES, dtype=np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, rows) for c in ("doc", "k1", "k2")), pa.array(np.diff(at)), pa.array(_sums(ts.mix(grams), at)), pa.array(_sums(ts.mix(grams ^ ts.U(0x5851F42D4C957F2D)), at)), binary], ["doc", "k1", "k2", "n", "c1", "c2", "signature"])

    return _keyed(docs).mapInArrow(run, "doc long, k1 long, k2 long, n long, c1 long, c2 long, signature binary")


def _unpacked(column: pa.Array) -> np.ndarray:
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint16)[offs[0] // 2 : offs[-1] // 2].reshape(len(column), HASHES)


def _likely(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, needs) -> np.ndarray:
    """Which pairs (i, j) of rows of a and b stay likely to the end."""
    left, have, done = np.arange(len(i)), np.zeros(len(i), np.int64), 0
    for n, least in needs:
        have = have + (a[i[left], done:n] == b[j[left], done:n]).sum(axis=1)
        ok = have >= least
        left, have, done = left[ok], have[ok], n
    return left


def likely_pairs(pairs: DataFrame, nodes: DataFrame, needs, similarity, tag: str) -> DataFrame:
    """The pairs (u, v) that are near in size and stay likely. Staged."""
    num, den = similarity
    a, b = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("signature").alias(f"s{x}")) for x in "uv")
    near = F.least("nu", "nv") * den >= F.greatest("nu", "nv") * num

    def run(batches):
        for batch in batches:
            u, v = _unpacked(batch.column("su")), _unpacked(batch.column("sv"))
            every = np.arange(len(u))
            left = pa.array(_likely(u, v, every, every, needs))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(left) for c in ("u", "v")], ["u", "v"])

    both = pairs.join(a, "u").join(b, "v").where(near).select("u", "v", "su", "sv")
    return staged(both.mapInArrow(run, "u long, v long"), tag)


def gram_lists(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(node, grams) of the nodes of wanted(node, k1, k2): the sorted n-gram hashes of their texts. Staged."""
    some = _keyed(docs).where(bloom.passes(docs.sparkSession, bloom.members(wanted, "k1"), F.col("k1")))
    texts = some.join(wanted, ["k1", "k2"]).groupBy("node").agg(F.max("text").alias("text"))

    def run(batches):
        for batch in batches:
            for first, rows, data, offs in ts.runs(batch):
                grams, at = ngram_sets(data, offs, k)
                yield pa.RecordBatch.from_arrays([batch.column("node").slice(first, rows), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(grams.view(np.int64)))], ["node", "grams"])

    return staged(texts.mapInArrow(run, "node long, grams array<long>"), "grams")


class Joined:
    """Components, of which some become one."""

    def __init__(self):
        self.above: dict = {}

    def top(self, c: int) -> int:
        while (up := self.above.get(c, c)) != c:
            self.above[c] = self.above.get(up, up)
            c = up
        return c


def tiles_met(members: DataFrame, docs: DataFrame, nodes: DataFrame, k: int, needs, similarity, tile: int = TILE) -> DataFrame:
    """(u, v): links between different components of each bucket of members(key, band, node, component),
    of every two components that can be joined enough to join them. Staged."""
    num, den = similarity
    members = staged(members.join(nodes.select("node", "n"), "node"), "members")
    wanted = staged(members.select("node").distinct().join(nodes.select("node", "k1", "k2"), "node"), "wanted")
    grams = gram_lists(docs, wanted, k)
    most = F.greatest(F.count(F.lit(1)) / F.lit(tile), F.sum("n") / F.lit(TILE_GRAMS))
    sizes = staged(members.groupBy("key").agg(F.ceil(most).cast("int").alias("tiles")), "sizes")
    dealt = members.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    whole = dealt.join(nodes.select("node", "signature"), "node").join(grams, "node")
    lists = staged(whole.groupBy("key", "tile").agg(F.first("tiles").alias("tiles"), F.first("band").alias("band"), F.collect_list(F.struct("node", "component", "n", "signature", "grams")).alias("own")), "tiles", spent=(members, wanted, grams))
    ahead = lists.withColumn("to", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1)))
    other = lists.select("key", F.col("tile").alias("to"), F.col("own").alias("other"))
    met = ahead.join(other, ["key", "to"]).select("band", (F.col("tile") == F.col("to")).alias("same"), "own", "other")

    def side(s):
        sets = s.field("grams")
        at = np.asarray(sets.offsets)
        return *(np.asarray(s.field(f)) for f in ("node", "component", "n")), _unpacked(s.field("signature")), np.asarray(sets.values), at

    def run(batches):
        for batch in batches:
            for r in range(len(batch)):
                band, same = batch.column("band")[r].as_py(), batch.column("same")[r].as_py()
                (node, comp, n, a, x, at), (node_2, comp_2, n_2, b, y, at_2) = (side(batch.column(c)[r].values) for c in ("own", "other"))
                joined, found = Joined(), []
                step = max(1, CHUNK // max(1, len(b)))
                for start in range(0, len(a), step):
                    own = slice(start, start + step)
                    fits = (comp[own, None] != comp_2) & (np.minimum(n[own, None], n_2) * den >= np.maximum(n[own, None], n_2) * num)
                    i, j = np.nonzero(fits)
                    i += start
                    if same:
                        i, j = i[i < j], j[i < j]
                    left = _likely(a, b, i, j, needs)
                    i, j = i[left], j[left]
                    # a pair belongs to the first bucket that it shares
                    seen = (a[i, : band * ROWS] == b[j, : band * ROWS]).reshape(len(i), band, ROWS).all(axis=2).any(axis=1)
                    for p, q in zip(i[~seen].tolist(), j[~seen].tolist()):
                        one, two = joined.top(int(comp[p])), joined.top(int(comp_2[q]))
                        if one != two:
                            both = len(np.intersect1d(x[at[p] : at[p + 1]], y[at_2[q] : at_2[q + 1]], assume_unique=True))
                            if den * both >= num * (n[p] + n_2[q] - both):
                                joined.above[max(one, two)] = min(one, two)
                                found.append((p, q))
                u, v = (np.array([ids[f[e]] for f in found], np.int64) for e, ids in enumerate((node, node_2)))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    with small_batches(members.sparkSession, 4):
        return staged(met.mapInArrow(run, "u long, v long"), "met", spent=(lists, sizes))


def near_links(docs: DataFrame, k: int = NGRAM, similarity=SIMILARITY, miss: float = MISS, tile: int = TILE):
    """(placed, links): placed has doc, n and node of every row (node null without words), links are
    verified pairs of nodes, enough of them for the components. Both staged."""
    prepared(docs.sparkSession)
    needs = least_matches(similarity, miss)
    rows = staged(profiles(docs, k), "profiles")
    sets = rows.where("n > 0").groupBy("n", "c1", "c2").agg(F.min(F.struct("k1", "k2")).alias("t"), F.first("signature").alias("signature"))
    nodes = staged(sets.select(F.monotonically_increasing_id().alias("node"), "n", "c1", "c2", "t.k1", "t.k2", "signature"), "nodes")
    placed = staged(rows.select("doc", "n", "c1", "c2").join(nodes.select("node", "n", "c1", "c2"), ["n", "c1", "c2"], "left").select("doc", "n", "node"), "placed", spent=(rows,))

    def keys(batches):
        for batch in batches:
            key = bands(_unpacked(batch.column("signature"))).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column("node")), BANDS)), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(batch))), pa.array(key.ravel())], ["node", "band", "key"])

    banded = staged(nodes.select("node", "signature").mapInArrow(keys, "node long, band int, key long"), "bands")
    hubs = staged(banded.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "hubs")
    shared = staged(banded.join(hubs, "key"), "buckets", spent=(banded, hubs))
    tried = staged(shared.where("node != hub").groupBy(F.col("hub").alias("u"), F.col("node").alias("v")).agg(F.count(F.lit(1)).alias("m")), "star")
    most = nodes.count()
    best = staged(tried.groupBy("v").agg(F.max_by("u", F.struct("m", -F.col("u"))).alias("u")).select("u", "v"), "best")
    first = confirmed(likely_pairs(best, nodes, needs, similarity, "likely"), docs, nodes, k, similarity, most)
    found = components(first)
    named = lambda df, x: df.join(found.select(F.col("node").alias(x), F.col("component").alias(f"c{x}")), x, "left").withColumn(f"c{x}", F.coalesce(f"c{x}", x))
    others = tried.select("u", "v").join(best, ["u", "v"], "left_anti")
    apart = staged(named(named(others, "u"), "v").where("cu != cv").select("u", "v"), "apart", spent=(tried, best))
    second = confirmed(likely_pairs(apart, nodes, needs, similarity, "likely"), docs, nodes, k, similarity, apart.count())
    links = staged(first.unionByName(second), "links", spent=(first, second, apart, found))
    joined = components(links)
    labeled = staged(shared.join(joined, "node", "left").select("key", "band", "node", F.coalesce("component", "node").alias("component")), "labeled", spent=(shared, joined))
    mixed = staged(labeled.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key"), "mixed")
    more = tiles_met(labeled.join(mixed, "key", "left_semi"), docs, nodes, k, needs, similarity, tile)
    return placed, staged(links.unionByName(more), "all_links", spent=(links, more, labeled, mixed, nodes))


def minhash_duplicates(docs: DataFrame, k: int = NGRAM, similarity=SIMILARITY, miss: float = MISS, tile: int = TILE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row."""
    placed, links = near_links(docs, k, similarity, miss, tile)
    found = components(links)
    placed = staged(placed.join(found, "node", "left").select("doc", "n", F.coalesce("component", "node").alias("component")), "placed", spent=(placed, links, found))
    names = staged(placed.where("component is not null").groupBy("component").agg(F.min("doc").alias("name")), "names")
    named = placed.join(names, "component", "left").select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("component").isNull(), F.col("doc")).otherwise(F.col("name")).alias("component_id"))
    return named.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op12(spark, sf_dir: str) -> DataFrame:
    return minhash_duplicates(table(spark, sf_dir, "documents"), 4, SIMILARITY)


SQL = f"{components_sql(4, SIMILARITY)} SELECT e.doc_id, len(s)::BIGINT AS n_shingles, component_id, e.doc_id = component_id AS kept FROM e JOIN c ON c.doc_id = e.doc_id"
