"""Training-order materialisation: fixed-stride token shards in a keyed random order.

The corpus is one stream of token ids, each text followed by the end token, cut into sequences of
`length` ids; the last is filled up with end tokens. Sequence i goes to slot P(i), where P is a
keyed permutation of all sequences: a Feistel network over the next even number of bits, applied
again until it lands below their count (cycle walking). So a slot is computed where a sequence is
made, and nothing is sorted globally. Pieces of sequences are dealt out by ranges of shards, which
are ranges of slots, and a task writes its shards in slot order. That is done in WAVES, each for its
share of the shards: a wave's shuffle files are deleted when its shards are there, so that staged
ids, shuffle and shards are never on disk all at once and whole. Slot s is at byte
(s mod rows) * length * width of shard s // rows: a reader starts anywhere without an index.

Texts are encoded once; their ids are staged in the shared folder with the number of the partition
that made them and their place in it. A count per partition then gives every run of ids its place
in the stream. A shard is written under another name and then moved; writing it again gives the
same bytes, so lost executors and repeated tasks do no harm.

A null text is an empty one: its end token alone. Rows are taken as they are: repeated rows repeat
in the stream. An empty table gives no shards. Extra columns are ignored.
"""

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textscan as ts
from .bpe import RUN_BYTES, default_vocabulary, vocabulary
from .shared import prepared, shared_dir, shuffles_deleted, small_batches, staged, table

LENGTH = 2048
SHARD_ROWS = 1024
ROUNDS = 6
SEED = 0
#: Shares of the shards that are dealt out and written one after the other.
WAVES = 3


class Permutation:
    """A keyed permutation of range(n), and its inverse, on numpy vectors."""

    def __init__(self, n: int, seed: int = SEED):
        self.n, self.half = n, max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        self.mask = ts.U((1 << self.half) - 1)
        self.keys = ts.mix(np.arange(ROUNDS, dtype=ts.U) + ts.mix(np.array([seed], dtype=ts.U)))

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        half = ts.U(self.half)
        left, right = x >> half, x & self.mask
        if back:
            for k in self.keys[::-1]:
                left, right = right ^ (ts.mix(left ^ k) & self.mask), left
        else:
            for k in self.keys:
                left, right = right, left ^ (ts.mix(right ^ k) & self.mask)
        return (left << half) | right

    def _walk(self, x, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(ts.U), back)
        while len(far := np.flatnonzero(out >= ts.U(self.n))):
            out[far] = self._once(out[far], back)
        return out.astype(np.int64)

    def slots(self, sequences) -> np.ndarray:
        return self._walk(sequences, False)

    def sequences(self, slots) -> np.ndarray:
        return self._walk(slots, True)


def width(path: str) -> int:
    """Bytes of an id."""
    return 2 if vocabulary(path).size <= 1 << 16 else 4


def end_token(path: str) -> int:
    v = vocabulary(path)
    return max(v.special.values()) if v.special else v.size - 1


def _streams(batches, path: str):
    """The ids of each run of texts, end tokens included."""
    v, end = vocabulary(path), end_token(path)
    for batch in batches:
        for _, n, data, offs in ts.runs(batch, limit=RUN_BYTES):
            ids, at = v.encode(data, offs)
            out = np.empty(len(ids) + n, "<u2" if width(path) == 2 else "<u4")
            last = at[1:] + np.arange(n)
            keep = np.ones(len(out), bool)
            keep[last] = False
            out[keep], out[last] = ids, end
            yield out


def _store(path: str):
    return fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)


def write_order(docs: DataFrame, folder: str, path: str, length: int = LENGTH, rows: int = SHARD_ROWS, seed: int = SEED, waves: int = WAVES) -> DataFrame:
    """Writes the shards of docs(text) to folder; returns their manifest (shard, first_slot,
    sequences, bytes, sha256), staged."""
    spark, size = prepared(docs.sparkSession), width(path)

    def encode(batches):
        part, before = TaskContext.get().partitionId(), 0
        for ids in _streams(batches, path):
            planes = ids.view(np.uint8).reshape(len(ids), size).T.tobytes()  # all low bytes first: it compresses better
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([before]), pa.array([len(ids)]), pa.array([planes])], ["part", "before", "n", "ids"])
            before += len(ids)

    stream = staged(docs.select("text").mapInArrow(encode, "part int, before long, n long, ids binary"), "ids", compression="zstd")
    with shuffles_deleted(spark):
        per_part = stream.groupBy("part").agg(F.sum("n").alias("n")).toArrow().sort_by("part")  # a row a partition
    parts, counts = (per_part[c].to_numpy() for c in ("part", "n"))
    base = spark.sparkContext.broadcast(dict(zip(parts.tolist(), (np.cumsum(counts) - counts).tolist())))
    total = int(counts.sum())
    sequences = -(-total // length)
    shards = max(1, -(-sequences // rows))
    most = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def pieces(batches, begin, end, spread):
        order = Permutation(max(sequences, 1), seed)
        for batch in batches:
            for part, before, n, raw in zip(*(batch.column(c) for c in ("part", "before", "n", "ids"))):
                at, n = base.value[part.as_py()] + before.as_py(), n.as_py()
                cut = np.arange(at // length * length, at + n, length)
                lo = np.maximum(cut, at)
                slot = order.slots(cut // length)
                offs = np.append((lo - at) * size, n * size).astype(np.int32)
                ids = np.ascontiguousarray(np.frombuffer(raw.as_buffer(), np.uint8).reshape(size, n).T)
                data = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offs), pa.py_buffer(ids)])
                shard = slot // rows
                mine = np.flatnonzero((shard >= begin) & (shard < end))
                shard, data = shard[mine], data.take(pa.array(mine))
                yield pa.RecordBatch.from_arrays([pa.array(((shard - begin) * spread // (end - begin)).astype(np.int32)), pa.array(shard.astype(np.int32)), pa.array(slot[mine]), pa.array((lo - cut)[mine].astype(np.int32)), data], ["range", "shard", "slot", "at", "ids"])

    def write(batches):
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        end = end_token(path)
        kind = np.dtype("<u2" if size == 2 else "<u4")
        shard, body = None, None

        for batch in batches:
            for s, slot, at, ids in zip(*(batch.column(c).to_pylist() for c in ("shard", "slot", "at")), batch.column("ids")):
                ids = np.frombuffer(ids.as_buffer(), kind)
                if s != shard:
                    if shard is not None:
                        yield _written(store, root, shard, body, rows, length, kind)
                    shard, body = s, np.full(min(rows, sequences - s * rows) * length, end, kind)
                place = (slot - s * rows) * length + at
                body[place : place + len(ids)] = ids
        if shard is not None:
            yield _written(store, root, shard, body, rows, length, kind)

    def wave(begin, end):
        spread = min(end - begin, most)
        placed = stream.mapInArrow(lambda batches: pieces(batches, begin, end, spread), "range int, shard int, slot long, at int, ids binary")
        ordered = placed.repartitionById(spread, "range").sortWithinPartitions("shard", "slot", "at")
        return staged(ordered.mapInArrow(write, "shard int, first_slot long, sequences long, bytes long, sha256 string"), "manifest")

    waves = min(waves, shards)
    with small_batches(spark, 500), shuffles_deleted(spark):
        done = [wave(shards * i // waves, shards * (i + 1) // waves) for i in range(waves)]
    return staged(reduce(DataFrame.unionByName, done), "manifest", spent=(stream, *done))


def _written(store, root, shard, body, rows, length, kind):
    data, name = body.tobytes(), f"{root}/shard-{shard:08d}.bin"
    temporary = f"{root}/_{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as f:
        f.write(data)
    store.move(temporary, name)
    return pa.RecordBatch.from_pylist([{"shard": shard, "first_slot": shard * rows, "sequences": len(body) // length, "bytes": len(data), "sha256": hashlib.sha256(data).hexdigest()}], pa.schema([("shard", pa.int32()), ("first_slot", pa.int64()), ("sequences", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))


def read_order(manifest: DataFrame, folder: str, path: str, length: int = LENGTH, first: int = 0, last: int | None = None, digest: bool = False) -> DataFrame:
    """(slot, ids as bytes) of the slots from first to last, each task reading its shards in order
    from the place where the range begins; with digest, ids_sha256 in the bytes' place."""
    size = width(path)
    some = manifest.where(F.col("first_slot") + F.col("sequences") > first)
    if last is not None:
        some = some.where(F.col("first_slot") <= last)

    def run(batches):
        store, root = _store(folder)
        for batch in batches:
            for shard, begin, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "first_slot", "sequences"))):
                lo, hi = max(begin, first), min(begin + n, n + begin if last is None else last + 1)
                with store.open_input_file(f"{root}/shard-{shard:08d}.bin") as f:
                    f.seek((lo - begin) * length * size)
                    for at in range(lo, hi, 256):
                        data = f.read((min(at + 256, hi) - at) * length * size)
                        stride = length * size
                        k = len(data) // stride
                        if digest:
                            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + k)), pa.array([hashlib.sha256(data[i * stride : (i + 1) * stride]).hexdigest() for i in range(k)], pa.string())], ["slot", "ids_sha256"])
                            continue
                        offs = pa.py_buffer(np.arange(0, len(data) + 1, stride, dtype=np.int32))
                        yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + k)), pa.Array.from_buffers(pa.binary(), k, [None, offs, pa.py_buffer(data)])], ["slot", "ids"])

    return some.select("shard", "first_slot", "sequences").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism), "shard").mapInArrow(run, "slot long, ids_sha256 string" if digest else "slot long, ids binary")


def op4(spark, sf_dir: str) -> DataFrame:
    """A row per slot: the sequence that is there, its shard and the digest of its ids as read back."""
    folder, path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", default_vocabulary()
    manifest = write_order(table(spark, sf_dir, "documents"), folder, path)
    n = manifest.agg(F.coalesce(F.sum("sequences"), F.lit(0))).first()[0]

    def name(batches):
        order = Permutation(max(n, 1))
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array(order.sequences(batch.column("slot").to_numpy())), batch.column("ids_sha256")], ["slot", "sequence", "ids_sha256"])

    back = read_order(manifest, folder, path, digest=True).mapInArrow(name, "slot long, sequence long, ids_sha256 string")
    return back.select("slot", "sequence", F.floor(F.col("slot") / SHARD_ROWS).alias("shard"), "ids_sha256")
