"""Shared pieces: the shared folder, table reading, and vectorised word hashing on Arrow text."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, everywhere in this subpackage: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"

MASK = 0xFFFFFFFFFFFFFFFF


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The parquet table of that name, by Spark's reader alone, so any store works."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir.  Only in a local session, where driver and executors
    are one process, may it be unset: then a folder of this process serves, which goes with it.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="veilspark-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        place = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/veilspark/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write df as parquet to the shared folder and read it back: lineage ends here, and a lost
    executor costs no more than what it was just doing."""
    spark = df.sparkSession
    path = path or new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Spark removes the shuffle files of an execution as it ends; a lost executor's are made again, as ever.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settle(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """materialise, leaving no shuffle files: nothing reads them once df is written down."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN_UP, "false")
    conf.set(CLEAN_UP, "true")
    try:
        return materialise(df, name, path)
    finally:
        conf.set(CLEAN_UP, before)


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written frame, when all that was made of it is written down too."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


#: A group that holds at least one row in so many is met by broadcast, so no task gets all its rows.
HOT_GROUPS = 2000


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], size: str, total: int) -> DataFrame:
    """rows joined with groups, which has one row for each key and the number of its rows in size.

    Of total rows, at most HOT_GROUPS keys can hold total / HOT_GROUPS or more each; these few groups
    are broadcast, whatever the size of the table, and only rows of the others are shuffled.
    """
    hot = F.col(size) > total // HOT_GROUPS
    large = F.broadcast(groups.filter(hot))
    rest = rows.join(F.broadcast(groups.filter(hot).select(*on)), on, "left_anti").join(groups.filter(~hot), on)
    return rows.join(large, on).unionByName(rest)


def id_text(name: str = "doc_id"):
    """The identifier as text; a null identifier counts as empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def remainder(n: int, name: str = "doc_id"):
    """crc32(identifier as text) mod n."""
    return F.crc32(id_text(name).cast("binary")) % n


# ---------------------------------------------------------------- numpy on text


def _tables(seed: int, *shape: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, size=shape, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@functools.cache
def _byte_at(seed: int) -> np.ndarray:
    return _tables(20231 + seed, 64, 256).reshape(-1)


IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (the splitmix constants)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column and the offset of each row; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def word_bounds(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of each word; a row's end also ends its last word."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    space = IS_SPACE[raw]
    before = np.empty(n, dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    edges = off[(off > 0) & (off < n)]
    before[edges] = True
    after[edges - 1] = True
    word = ~space
    return np.flatnonzero(word & before), np.flatnonzero(word & after) + 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 16, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: tabulation hashing by byte and place, summed and finalised."""
    table = _byte_at(seed)
    out = np.empty(len(starts), dtype=np.uint64)
    for a in range(0, len(starts), step):
        s, e = starts[a : a + step], ends[a : a + step]
        size = e - s
        first = np.zeros(len(s), dtype=np.int64)
        np.cumsum(size[:-1], out=first[1:])
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        byte = raw[place + np.repeat(s, size)]
        value = table[((place & 63) << 8) | byte]
        if int(size.max(initial=0)) > 64:
            with np.errstate(over="ignore"):
                value = value * ((place >> 6).astype(np.uint64) * np.uint64(2) + np.uint64(1))
        out[a : a + step] = np.add.reduceat(value, first)
        with np.errstate(over="ignore"):
            out[a : a + step] += size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return mix(out)


class Words:
    """The words of a batch of texts: hashes, byte bounds, and the first word of each row."""

    def __init__(self, column, lower: bool = False, seed: int = 0):
        self.raw, self.off = flat_bytes(column)
        if lower:
            self.raw = LOWER[self.raw]
        self.starts, self.ends = word_bounds(self.raw, self.off)
        self.first = np.searchsorted(self.starts, self.off)
        self.hash = word_hashes(self.raw, self.starts, self.ends, seed=seed)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        """Hash, length and bytes of each distinct word, sorted by hash; and whether two words share a hash."""
        size = self.ends - self.starts
        at, number = one_of_each(self.hash)
        return self.hash[at], size[at], self.raw[_spread(self.starts[at], size[at])], not alike(self.raw, self.starts, size, at[number])


def one_of_each(names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct name, in the order of names, and for each place the number of its name."""
    # values sort several times faster than places: so with its place as the last bits of each name, if the others tell all apart
    bits = np.uint64(len(names).bit_length())
    order = (np.sort(names >> bits << bits | np.arange(len(names), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    name = names[order]
    if (name[1:] < name[:-1]).any():
        order = np.argsort(names)
        name = names[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = name[1:] != name[:-1]
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def alike(raw: np.ndarray, start: np.ndarray, size: np.ndarray, like: np.ndarray) -> bool:
    """Whether each word has the bytes of the word whose number is in like: 64 bytes by eights, the rest of long ones word by word."""
    if not (size == size[like]).all():
        return False
    eight = np.ndarray(len(raw), dtype="<u8", buffer=np.append(raw, np.zeros(8, np.uint8)), strides=(1,))
    todo, done = np.flatnonzero(like != np.arange(len(like))), 0
    while len(todo) and done < 64:
        for a in range(0, len(todo), 1 << 16):
            i = todo[a : a + (1 << 16)]
            differ = eight[start[i] + done] ^ eight[start[like[i]] + done]
            if (differ << (np.uint64(8) * np.maximum(8 + done - size[i], 0).astype(np.uint64))).any():
                return False
        done += 8
        todo = todo[size[todo] > done]
    return all((raw[start[i] + done : start[i] + size[i]] == raw[start[j] + done : start[j] + size[j]]).all() for i, j in zip(todo, like[todo], strict=True))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each, size of them, one after the other."""
    first = np.zeros(len(size), dtype=np.int64)
    np.cumsum(size[:-1], out=first[1:])
    return np.arange(int(size.sum()), dtype=np.int64) + np.repeat(start - first, size)


def slices(off: np.ndarray, limit: int):
    """Cut rows with the given offsets into runs of about limit units, one row at least."""
    a, n = 0, len(off) - 1
    while a < n:
        b = int(np.searchsorted(off, off[a] + limit, side="right")) - 1
        b = min(max(b, a + 1), n)
        yield a, b
        a = b
