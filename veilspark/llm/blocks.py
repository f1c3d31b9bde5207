"""Blocks of documents, and a keyed exchange of packed arrays between them.

Documents are packed once, as they are read, into blocks of a bounded number of bytes.  To learn
something about keys of the whole corpus (words, word pairs, repeats), each block folds its keys
and sends them, sorted and packed, to buckets by key range; a bucket merges what all blocks sent
and answers each block in the order that it asked.  So a key costs at most one entry for each
block, however often it occurs, rows of the shuffle are few and large but bounded, and no task
holds more than a block or a bucket.

No sender has more than FAN receivers.  Where there are more buckets than that, keys travel in
levels: a node of a level takes the keys of one range from a group of at most about FAN senders,
folds them as a bucket would, and sends them on to the parts of its range; answers come back the
same way.  Each level has about as many nodes as there are buckets, so rows grow with the number
of blocks times FAN times the levels, whose number is the logarithm of the input to the base FAN.

On disk, keys lie once as they are sent to a level and once as its nodes hold them, folded.  A node
keeps the place of each sender's keys among its folded ones, a byte or less for each, and not the
keys themselves; shuffle files go with the job that made them, levels once they are answered.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import discard, flat_bytes, materialise, mix, new_path, settle

BLOCK_BYTES = 6 << 20
BLOCKS_PER_TASK = 8


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: planes of bytes, compressed; sorted unsigned keys come first, as differences."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    out = []
    for k, a in enumerate(arrays):
        if k == 0 and a.dtype == np.uint64 and len(a):
            a = np.diff(a, prepend=np.uint64(0))
        a = np.ascontiguousarray(a)
        out.append((a.dtype.str, len(a), z.compress(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() if len(a) else b"")))
    return pickle.dumps(out, protocol=5)


def unpack_arrays(blob: bytes) -> list[np.ndarray]:
    import zstandard

    z = zstandard.ZstdDecompressor()
    out = []
    for k, (kind, n, data) in enumerate(pickle.loads(blob)):
        dtype = np.dtype(kind)
        raw = z.decompress(data, max_output_size=max(1, n * dtype.itemsize)) if n else b""
        a = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(dtype.itemsize, n).T).view(dtype).reshape(n) if n else np.zeros(0, dtype)
        if k == 0 and dtype == np.uint64 and n:
            a = np.cumsum(a, dtype=np.uint64)
        out.append(a)
    return out


def _pack_block(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        for b in batches:
            w.write_batch(b)
    return sink.getvalue().to_pybytes()


def open_block(blob) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def pack_documents(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """gid, blob: the columns of docs in blocks; a text longer than a block has one to itself."""

    def run(batches):
        from pyspark import TaskContext

        base, seq, held, size = TaskContext.get().partitionId() << 24, 0, [], 0

        def row():
            nonlocal held, size, seq
            out = pa.RecordBatch.from_arrays([pa.array([base + seq], pa.int64()), pa.array([_pack_block(held)], pa.binary())], names=["gid", "blob"])
            held, size, seq = [], 0, seq + 1
            return out

        for batch in batches:
            k = batch.schema.get_field_index("text")
            batch = batch.set_column(k, "text", pc.fill_null(batch.column(k), "") if batch.column(k).null_count else batch.column(k))
            off = flat_bytes(batch.column(k))[1]
            a = 0
            while a < batch.num_rows:
                b = int(np.searchsorted(off, off[a] + block_bytes - size, side="right")) - 1
                b = min(max(b, a + (not held)), batch.num_rows)
                if b > a:
                    held.append(batch.slice(a, b - a))
                    size += int(off[b] - off[a]) + (b - a)
                a = b
                if size >= block_bytes or a < batch.num_rows:
                    yield row()
        if held:
            yield row()

    return materialise(docs.mapInArrow(run, "gid long, blob binary"), "blocks")


FAN = 256

REQUEST = "kind string, bucket long, gid long, blob binary"
ANSWER = REQUEST
#: What a node of a level writes: the keys that it sends on, and for each sender the places of its keys.
LEVEL = "is_place boolean, " + REQUEST


def rows_table(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.binary())],
        names=["kind", "bucket", "gid", "blob"],
    )


class Exchange:
    """Where keys go: levels of at most fan receivers each, and fan ** levels buckets.

    A node of level k is numbered group * fan^k + range: its senders' group among fan^(levels - k),
    and its key range among fan^k.  At the last level there is one group, and ranges are buckets.
    """

    def __init__(self, buckets: int, fan: int = FAN):
        self.levels = 1
        while fan**self.levels < buckets:
            self.levels += 1
        self.fan = max(1, next(f for f in range(max(2, fan) + 1) if f**self.levels >= buckets))
        self.buckets = self.fan**self.levels

    def ranges(self, keys: np.ndarray, level: int):
        """(range of that level, begin, end) over sorted keys."""
        if not len(keys):
            return
        n = np.minimum(((keys >> np.uint64(32)) * np.uint64(self.buckets)) >> np.uint64(32), np.uint64(self.buckets - 1))
        n = (n // np.uint64(self.fan ** (self.levels - level))).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], n[1:] != n[:-1])))
        for a, b in zip(edge, np.append(edge[1:], len(n)), strict=True):
            yield int(n[a]), int(a), int(b)

    def node(self, group: int, level: int, key_range: int) -> int:
        return (group % self.fan ** (self.levels - level)) * self.fan**level + key_range

    def first(self, gid: int, keys: np.ndarray):
        """(node, begin, end): where the sorted keys of a block go."""
        group = int(mix(np.array([gid], dtype=np.uint64))[0] >> np.uint64(1))
        for r, a, b in self.ranges(keys, 1):
            yield self.node(group, 1, r), a, b

    def request_rows(self, kind: str, gid: int, keys: np.ndarray, *more: np.ndarray):
        """Rows of REQUEST for a block's sorted keys and what goes with each."""
        for node, a, b in self.first(gid, keys):
            yield kind, node, gid, pack_arrays(keys[a:b], *[m[a:b] for m in more])

    def answers(self, requests: DataFrame, fold, answer, cut, name: str) -> DataFrame:
        """Rows of ANSWER to each block, and those of answer's own with gid -1, written down.

        fold(kind, parts) -> (place of each entry among the folded ones, folded arrays), where parts
        are the arrays of each sender and the first folded array are the sorted keys;
        answer(kind, folded) -> (arrays aligned with the keys, further rows (kind, arrays));
        cut(kind, folded, begin, end) -> the arrays of a part of the keys.
        """
        spark, levels = requests.sparkSession, []
        for level in range(1, self.levels):
            path = new_path(spark, f"{name}-level")
            sent = settle(requests.groupBy("kind", "bucket").applyInArrow(self._forward(level, fold, cut), LEVEL), name, path)
            levels.append((sent, path))
            requests = sent.filter("not is_place").drop("is_place")

        def root(table: pa.Table) -> pa.Table:
            kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
            gids, parts = gathered(table)
            place, folded = fold(kind, parts)
            out, more = answer(kind, folded)
            return pa.Table.from_batches([rows_table(list(_dealt(kind, bucket, gids, parts, place, out)) + [(k, bucket, -1, pack_arrays(*arrays)) for k, arrays in more])])

        got = settle(requests.groupBy("kind", "bucket").applyInArrow(root, ANSWER), name)
        extra = got.filter("gid < 0")
        while levels:
            sent, path = levels.pop()
            places = sent.filter("is_place").drop("is_place")
            down = got.filter("gid >= 0").toDF("kind", "part", "bucket", "blob")
            got = settle(places.groupBy("kind", "bucket").cogroup(down.groupBy("kind", "bucket")).applyInArrow(_back, ANSWER), name)
            discard(spark, path)
        return got if self.levels == 1 else got.unionByName(extra)

    def _forward(self, level: int, fold, cut):
        def run(table: pa.Table) -> pa.Table:
            kind, node = table["kind"][0].as_py(), table["bucket"][0].as_py()
            gids, parts = gathered(table)
            place, folded = fold(kind, parts)
            group = node // self.fan**level
            on = [(kind, self.node(group, level + 1, r), node, pack_arrays(*cut(kind, folded, a, b))) for r, a, b in self.ranges(folded[0], level + 1)]
            # rising places of a sender, as differences
            kept = list(_dealt(kind, node, gids, parts, np.arange(len(place)), [place.astype(np.uint64)]))
            return rows_to_table(on + kept).add_column(0, "is_place", pa.array([False] * len(on) + [True] * len(kept)))

        return run


def _dealt(kind, bucket, gids, parts, place, out):
    a = 0
    for gid, p in zip(gids, parts, strict=True):
        at = place[a : a + len(p[0])]
        yield kind, bucket, gid, pack_arrays(*[x[at] for x in out])
        a += len(p[0])


def _back(places: pa.Table, got: pa.Table) -> pa.Table:
    """A node's answers to its senders, from those that it got itself and the places of their keys."""
    if not places.num_rows:
        return rows_to_table([])
    kind, node = places["kind"][0].as_py(), places["bucket"][0].as_py()
    gids, parts = gathered(places)
    order, blobs = np.argsort(got["part"].to_numpy()), got["blob"].to_pylist()
    answers = [unpack_arrays(blobs[i]) for i in order]
    out = [np.concatenate(x) for x in zip(*answers, strict=True)]
    return rows_to_table([(kind, node, gid, pack_arrays(*[x[p[0].astype(np.int64)] for x in out])) for gid, p in zip(gids, parts, strict=True)])


def rows_to_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([rows_table(rows)])


def gathered(table: pa.Table) -> tuple[list[int], list[list[np.ndarray]]]:
    """The blocks that sent something to a bucket, in order, and their arrays."""
    gids = table["gid"].to_pylist()
    order = sorted(range(len(gids)), key=gids.__getitem__)
    blobs = table["blob"].to_pylist()
    return [gids[i] for i in order], [unpack_arrays(blobs[i]) for i in order]


def answers_of(table: pa.Table, kind: str) -> list[list[np.ndarray]]:
    """A block's answers of a kind, in the order of buckets."""
    kinds, buckets, blobs = table["kind"].to_pylist(), table["bucket"].to_pylist(), table["blob"].to_pylist()
    return [unpack_arrays(blobs[i]) for i in sorted((i for i in range(len(kinds)) if kinds[i] == kind), key=lambda i: buckets[i])]


def joined(parts: list[list[np.ndarray]], k: int, dtype) -> np.ndarray:
    return np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, dtype)


def per_block(packed: DataFrame, answers: DataFrame, fn, schema: str) -> DataFrame:
    """fn(gid, block table, answers table) -> list of record batches, for each block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return empty
        gid = left["gid"][0].as_py()
        return pa.Table.from_batches(list(fn(gid, open_block(left["blob"][0].as_buffer()), right)))

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    # about BLOCKS_PER_TASK blocks for a task, however many there are
    tasks = -(-packed.count() // BLOCKS_PER_TASK)
    if tasks > int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        packed, answers = packed.repartition(tasks, "gid"), answers.repartition(tasks, "gid")
    return packed.groupBy("gid").cogroup(answers.groupBy("gid")).applyInArrow(run, schema)


def blocks_of(table_batches):
    """(gid, block) from the rows of a packed frame."""
    for batch in table_batches:
        for gid, blob in zip(batch.column("gid"), batch.column("blob"), strict=True):
            yield gid.as_py(), open_block(blob.as_buffer())
