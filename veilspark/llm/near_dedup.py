"""MinHash near-duplicates with SetSketch registers.

A document's set is its distinct word shingles, hashed to 64 bits.  Register i holds the smallest
of the set's exponential draws under seed i, on a scale spaced by powers of BASE and truncated to
16 bits: K = floor(1 - log_BASE(minimum)).  Equal sets have equal registers, the registers of a
union are the larger ones, and two registers agree with a probability close to the Jaccard
similarity.

1. Rows with equal sets (a 128-bit digest of the set) are one class, and only classes go on from
   here.  At the end rows meet their class by common.join_groups, so copies are never gathered.
2. The registers are cut in BANDS bands of ROWS; classes that agree in a band share a bucket.
   At a similarity of 0.8 all bands differ with probability (1 - 0.8^ROWS)^BANDS, 4e-7 here.
3. In each bucket every class pairs with the bucket's smallest one: as many pairs as members.
   Pairs whose sizes rule out the threshold go.  In larger buckets so do those whose joint
   likelihood estimate from the registers is too far below it, since step 4 compares them again;
   a bucket of two is settled here, so its pair is never left to the estimate.  The rest is
   verified on the full sets.
4. Links form components.  In buckets that now hold more than one component, the members outside
   the bucket's largest one are compared with all members of other components on their full sets;
   of the links found there only those that join components are kept.  Each task meets at most
   about BLOCK of the former and BLOCK of the latter, so a bucket of M members with few outside
   sends M rows for each BLOCK of these.  So no link that a bucket could show is lost, and copies
   never expand to all pairs.

Defined cases: null, empty or blank text has an empty set, which is linked with nothing, equal
ones neither; a text with fewer words than a shingle has its whole sequence as its one shingle;
rows with a null doc_id are scored but linked with nothing; each row is judged by its own text, so
rows that repeat a doc_id with other texts may have other components; an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Words, join_groups, materialise, mix, read, slices
from .components import components

BANDS, ROWS = 28, 4
REGISTERS = BANDS * ROWS
BASE = 1.02
RATE = 20.0
BLOCK = 512  # members of a bucket on each side that meet in a task, about
SIGMAS = 4.5

_SEED = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(7919))
_ODD = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(104729)) | np.uint64(1)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(31337)) | np.uint64(1)


def shingle_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all rows, and the offsets of each row in them."""
    rows = len(w.off) - 1
    sets = []
    counts = np.zeros(rows, dtype=np.int64)
    h, first = w.hash, w.first
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(len(h) - n + 1, 0), dtype=np.uint64)
        for j in range(n):
            rolled += h[j : j + len(rolled)] * _PLACE[j]
        rolled = mix(rolled)
        for r in range(rows):
            a, b = int(first[r]), int(first[r + 1])
            if a == b:
                continue
            if b - a < n:
                one = h[a:b] * _PLACE[: b - a]
                s = mix(np.array([one.sum(dtype=np.uint64) + np.uint64(b - a)], dtype=np.uint64))
            else:
                s = np.unique(rolled[a : b - n + 1])
            sets.append(s)
            counts[r] = len(s)
    off = np.zeros(rows + 1, dtype=np.int64)
    np.cumsum(counts, out=off[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), off


def registers(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """rows x REGISTERS truncated minima; rows with an empty set are all 0."""
    rows = len(off) - 1
    least = np.full((REGISTERS, rows), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a, b in slices(off, 1 << 14):
        keep = np.flatnonzero(off[a + 1 : b + 1] > off[a:b]) + a
        if not len(keep):
            continue
        v, starts = values[off[a] : off[b]], off[keep] - off[a]
        t = np.empty_like(v)
        with np.errstate(over="ignore"):
            for i in range(REGISTERS):
                np.bitwise_xor(v, _SEED[i], out=t)
                np.multiply(t, _ODD[i], out=t)
                least[i, keep] = np.minimum.reduceat(t, starts)
    draw = -np.log1p(-(least.astype(np.float64) + 1) / 2.0**64 * (1 - 1e-16)) / RATE
    k = np.floor(1 - np.log(np.maximum(draw, 1e-300)) / np.log(BASE))
    k = np.clip(k, 0, 65535).astype(np.uint16).T.copy()
    k[off[1:] == off[:-1]] = 0
    return k


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def band_keys(k: np.ndarray) -> np.ndarray:
    """rows x BANDS keys of 64 bits."""
    part = k.reshape(len(k), BANDS, ROWS).astype(np.uint64)
    with np.errstate(over="ignore"):
        key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), part.shape[:2]).copy()
        for j in range(ROWS):
            key = mix(key ^ (part[:, :, j] + np.uint64(1)) * _PLACE[j])
    return key.view(np.int64)


def estimate(ka: np.ndarray, kb: np.ndarray, na: np.ndarray, nb: np.ndarray, grid: int = 64) -> np.ndarray:
    """The similarity of greatest joint likelihood, given how many registers are larger, smaller, equal.

    ka, kb: pairs x REGISTERS; na, nb: set sizes, which are known exactly.
    """
    more, less = (ka > kb).sum(1).astype(np.float64), (ka < kb).sum(1).astype(np.float64)
    same = ka.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    top = np.minimum(u / v, v / u)
    j = np.linspace(0, 1, grid)[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up = np.clip(p(u[:, None] - v[:, None] * j), 1e-9, 1)
    down = np.clip(p(v[:, None] - u[:, None] * j), 1e-9, 1)
    eq = np.clip(1 - up - down, 1e-9, 1)
    ll = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(eq)
    return j[np.arange(len(j)), ll.argmax(1)]


def _floor(percent: int) -> float:
    t = percent / 100
    return t - SIGMAS * (t * (1 - t) / REGISTERS) ** 0.5


def _sketch(batches, n: int):
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            values, off = shingle_hashes(Words(part.column("text"), lower=True), n)
            sizes = np.diff(off)
            digest = set_digest(values, off)
            k = registers(values, off)
            keys = band_keys(k)
            width = REGISTERS * 2
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id").cast(pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(digest[0].view(np.int64), pa.int64()),
                    pa.array(digest[1].view(np.int64), pa.int64()),
                    pa.ListArray.from_arrays(pa.array(np.arange(len(k) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1), pa.int64())),
                    pa.Array.from_buffers(pa.binary(), len(k), [None, pa.py_buffer((np.arange(len(k) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(k.tobytes())]),
                ],
                names=["doc_id", "n_shingles", "d1", "d2", "bands", "regs"],
            )


def set_digest(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Two 64-bit sums over each row's set; 0 for an empty one."""
    digest = np.zeros((2, len(off) - 1), dtype=np.uint64)
    some = np.flatnonzero(np.diff(off))
    if len(some):
        with np.errstate(over="ignore"):
            digest[0, some] = np.add.reduceat(mix(values), off[some])
            digest[1, some] = np.add.reduceat(mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5)), off[some])
    return digest


def _sets(batches, n: int):
    """The sets of texts, for those that are of the class that the row asks for."""
    for batch in batches:
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            values, off = shingle_hashes(Words(part.column("text"), lower=True), n)
            digest = set_digest(values, off).view(np.int64)
            mine = (digest[0] == part.column("d1").to_numpy()) & (digest[1] == part.column("d2").to_numpy())
            sets = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(values.view(np.int64), pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), sets], names=["doc_id", "set"]).filter(pa.array(mine))


def _likely(batches, floor: float):
    """Pairs whose joint estimate does not rule them out, and those that are settled here."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ka = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column("ra")])
        kb = np.stack([np.frombuffer(x.as_py(), np.uint16) for x in batch.column("rb")])
        na, nb = (batch.column(c).to_numpy().astype(np.float64) for c in ("na", "nb"))
        final = batch.column("final").to_numpy(zero_copy_only=False).astype(bool)
        keep = np.flatnonzero(final | (estimate(ka, kb, na, nb) >= floor))
        yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(keep)) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"])


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Links between outside members (side 0) and others (side 1) of a bucket that join different
    components, found by counting common shingles exactly.  Links whose ends are joined already are left out."""
    table = table.take(pa.array(np.lexsort((table["doc"].to_numpy(), table["side"].to_numpy()))))
    doc, comp, n, top = (table[c].to_numpy() for c in ("doc", "comp", "n", "top"))
    outside = np.flatnonzero(table["side"].to_numpy() == 0)
    sets = table["set"].combine_chunks()
    off = np.asarray(sets.offsets, dtype=np.int64)
    values = np.asarray(sets.values)[off[0] : off[-1]]
    starts = off[:-1] - off[0]
    ids = np.unique(values, return_inverse=True)[1]
    stop = np.append(starts[1:], len(ids))
    cut = len(outside)
    flag = np.zeros(int(ids.max(initial=-1)) + 2, dtype=np.int64)
    root = {c: c for c in comp.tolist()}

    def find(c):
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out = []
    if cut == len(doc):
        outside = outside[:0]
    inner, inner_starts = ids[starts[cut] :] if len(outside) else ids[:0], starts[cut:] - (starts[cut] if len(outside) else 0)
    for i in outside:
        # a pair of two outside members is taken from its smaller one alone
        other = (comp[cut:] != comp[i]) & (100 * np.minimum(n[cut:], n[i]) >= percent * np.maximum(n[cut:], n[i])) & ((comp[cut:] == top[cut:]) | (doc[cut:] > doc[i]))
        if not other.any():
            continue
        mine = ids[starts[i] : stop[i]]
        flag[mine] = 1
        common = np.add.reduceat(flag[inner], inner_starts)
        flag[mine] = 0
        for j in np.flatnonzero(other & (100 * common >= percent * (n[cut:] + n[i] - common))) + cut:
            x, y = find(int(comp[i])), find(int(comp[j]))
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append((min(doc[i], doc[j]), max(doc[i], doc[j])))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})


def _open_buckets(buckets: DataFrame, comp: DataFrame, total: int) -> DataFrame:
    """The members of buckets that hold several components, as _across takes them, but for their sets."""
    # of two members one is the pivot, and that pair is settled
    named = buckets.filter("size > 2").join(comp, buckets.doc_id == comp.node, "left").select("key", "size", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
    named = materialise(named, "near-named")
    parts = named.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    several = parts.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("top"), F.max("n").alias("most"), F.first("size").alias("size")).filter("most < size")
    several = materialise(several.select("key", "top", F.col("size").alias("members"), (F.col("size") - F.col("most")).alias("outside")), "near-open")
    rows = join_groups(named.select("key", "doc_id", "comp"), several, ["key"], "members", total)
    n_out, n_in = F.ceil(F.col("outside") / BLOCK).cast("int"), F.ceil(F.col("members") / BLOCK).cast("int")
    at = F.xxhash64("doc_id")
    sides = (
        (rows.filter("comp != top"), 0, F.pmod(at, n_out).cast("int"), F.explode(F.sequence(F.lit(0), n_in - 1))),
        (rows, 1, F.explode(F.sequence(F.lit(0), n_out - 1)), F.pmod(at, n_in).cast("int")),
    )
    # "bi", "bj": the block of outside members, and of all
    each = [df.withColumn("bi", bi).withColumn("bj", bj).select("key", "bi", "bj", F.lit(side).alias("side"), "doc_id", "comp", "top") for df, side, bi, bj in sides]
    return each[0].unionByName(each[1])


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = materialise(docs.mapInArrow(lambda x: _sketch(x, n), "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, regs binary"), "near-sketches")
    of_class = ["n_shingles", "d1", "d2"]
    some = sketch.filter("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy(*of_class).agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("regs").alias("regs"))
    # a class is a document from here on, under a number of its own
    classes = materialise(classes.withColumn("doc_id", F.monotonically_increasing_id()), "near-classes")
    total, n_classes = classes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.count(F.lit(1))).first()

    rows = classes.select("doc_id", F.explode("bands").alias("key"))
    shared = materialise(rows.groupBy("key").agg(F.min("doc_id").alias("pivot"), F.count(F.lit(1)).alias("size")).filter("size > 1"), "near-shared")
    buckets = materialise(join_groups(rows, shared, ["key"], "size", n_classes * BANDS), "near-buckets")
    # the full sets of all classes that share a bucket with another
    wanted = buckets.select("doc_id").distinct().join(classes.select("doc_id", "rep", "d1", "d2"), "doc_id")
    sets = docs.withColumnRenamed("doc_id", "rep").join(wanted, "rep").select("doc_id", "d1", "d2", "text")
    sets = sets.mapInArrow(lambda x: _sets(x, n), "doc_id long, set array<long>").dropDuplicates(["doc_id"])
    sets = materialise(sets, "near-sets")

    info = classes.select("doc_id", F.col("n_shingles").alias("n"), "regs")
    pairs = buckets.filter("doc_id != pivot").groupBy(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).agg((F.min("size") == 2).alias("final"))
    pairs = pairs.join(info.toDF("b", "nb", "rb"), "b").join(info.toDF("a", "na", "ra"), "a")
    pairs = pairs.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    pairs = pairs.select("a", "b", "na", "nb", "ra", "rb", "final").mapInArrow(lambda x: _likely(x, _floor(percent)), "a long, b long, na long, nb long")
    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    links = materialise(both.filter(F.col("common") * 100 >= (F.col("na") + F.col("nb") - F.col("common")) * percent).select("a", "b"), "near-links")
    comp = materialise(components(links, "a", "b"), "near-components")

    members = _open_buckets(buckets, comp, n_classes * BANDS).join(sets, "doc_id")
    members = members.select("key", "bi", "bj", "side", F.col("doc_id").alias("doc"), "comp", "top", F.size("set").cast("long").alias("n"), "set")

    def across(table):
        return _across(table, percent)

    more = materialise(members.groupBy("key", "bi", "bj").applyInArrow(across, "a long, b long").distinct(), "near-across")
    if not more.isEmpty():
        comp = materialise(components(links.unionByName(more), "a", "b"), "near-components")
    # back to rows: each class's component, named by its smallest doc_id
    named = classes.select("doc_id", "rep", "rows", *of_class).join(comp.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("component", "doc_id"))
    named = materialise(named.drop("component"), "near-roots")
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("classes"))
    named = join_groups(named, least, ["root"], "classes", n_classes).select(*of_class, "rows", "component_id")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    found = join_groups(some.select("doc_id", *of_class), named, of_class, "rows", total).select("doc_id", "n_shingles", "component_id", kept)
    alone = sketch.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(alone)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), n=4, percent=80)
