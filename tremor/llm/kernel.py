"""Byte-level numpy kernels and Spark helpers shared by the text operators.

Texts arrive in Arrow batches.  A batch is cut into blocks of whole documents
with at most ``limit`` bytes (one longer document makes a block of its own), so
the memory of a Python worker is bounded by the block and the longest text.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

# freed blocks go back to the system, as idle workers stay alive beside the JVM
pa.set_memory_pool(pa.system_memory_pool())


def give_back() -> None:
    """Return what the C library holds free; elsewhere than on glibc nothing is done."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


BLOCK_BYTES = 1 << 19

# bytes that end a word: space and \t \n \v \f \r
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _strings(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type) and not pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    return pc.fill_null(column, "") if column.null_count else column


def text_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    arr = _strings(column)
    width = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    _, offsets, data = arr.buffers()
    if len(arr) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(arr) + 1, np.int64)
    offs = np.frombuffer(offsets, width)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def cut_rows(offs: np.ndarray, limit: int):
    """Row ranges whose texts hold at most ``limit`` bytes; one row at least."""
    at, n = 0, len(offs) - 1
    while at < n:
        to = int(np.searchsorted(offs, offs[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def blocks(batches, text: str = "text", limit: int = BLOCK_BYTES):
    """(batch slice, bytes, offsets) for each block of whole documents."""
    for batch in batches:
        if not batch.num_rows:
            continue
        data, offs = text_buffers(batch.column(text))
        for a, b in cut_rows(offs, limit):
            yield batch.slice(a, b - a), data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Roll:
    """Polynomial hashes, modulo 2**64, of any span of a block in O(1)."""

    def __init__(self, seed: int):
        self.seed = seed
        rng = np.random.default_rng(seed)
        self.table = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = int(rng.integers(1 << 40, 1 << 62)) * 2 + 1
        self.pw = np.ones(1, np.uint64)
        self.inv = np.ones(1, np.uint64)

    def __reduce__(self):
        return roll, (self.seed,)  # a worker keeps one object, with its powers, for each seed

    def _grow(self, n: int) -> None:
        if len(self.pw) < n + 1:
            for name, b in (("pw", self.base), ("inv", pow(self.base, -1, 1 << 64))):
                a = np.full(n + 1, b, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))

    def prefix(self, data: np.ndarray, table: np.ndarray | None = None) -> np.ndarray:
        n = len(data)
        self._grow(n)
        c = (self.table if table is None else table)[data]
        return self._sum(c, n)

    def prefix_values(self, values: np.ndarray) -> np.ndarray:
        """The same over 64-bit values, such as the hashes of lines."""
        self._grow(len(values))
        return self._sum(values.astype(np.uint64), len(values))

    def _sum(self, c: np.ndarray, n: int) -> np.ndarray:
        p = np.zeros(n + 1, np.uint64)
        c = c * self.pw[:n]
        np.cumsum(c, out=p[1:])
        return p

    def span(self, p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        self._grow(len(p))
        return mix((p[e] - p[s]) * self.inv[s])


@functools.cache
def roll(seed: int) -> Roll:
    return Roll(seed)


def spans(mask: np.ndarray, offs: np.ndarray):
    """(starts, ends, document) of the maximal runs of ``mask`` that stay in a document."""
    n = len(mask)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    before = np.zeros(n, bool)
    before[1:] = mask[:-1]
    after = np.zeros(n, bool)
    after[:-1] = mask[1:]
    s = np.flatnonzero(mask & (~before | edge[:n]))
    e = np.flatnonzero(mask & (~after | edge[1:])) + 1
    return s, e, np.searchsorted(offs, s, side="right") - 1


def line_spans(data: np.ndarray, offs: np.ndarray):
    """(starts, ends, document) of the \\n-split lines of each document; an empty text has one empty line."""
    nl = np.flatnonzero(data == 0x0A)
    nl_doc = np.searchsorted(offs, nl, side="right") - 1
    s = np.concatenate([offs[:-1], nl + 1])
    d = np.concatenate([np.arange(len(offs) - 1), nl_doc])
    e = np.concatenate([nl, offs[1:]])
    de = np.concatenate([nl_doc, np.arange(len(offs) - 1)])
    return s[np.lexsort((s, d))], e[np.lexsort((e, de))], np.sort(d, kind="stable")


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


# --- Spark side -------------------------------------------------------------


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the setting is unset and all run in this process."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tremor-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors and gives the planner sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tremor/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tremor_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing still to be computed reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._tremor_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: a key with more rows than this, and than a thousandth of all, is joined by broadcast
HOT_ROWS = 1000


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``big`` inner joined with ``small``, which has one row for each key and in ``count`` how many rows of ``big`` have it.

    A key with over ``HOT_ROWS`` rows and over a thousandth of all has its row of
    ``small`` broadcast (there are under a thousand such keys), so that its rows
    stay where they are; the others are shuffled.  ``small`` is materialised.
    """
    from pyspark.sql import functions as F

    total, most = (x or 0 for x in small.agg(F.sum(count), F.max(count)).first())
    bar = max(HOT_ROWS, total // 1000)
    if most <= bar:
        return big.join(small, keys)
    hot, cold = small.where(F.col(count) > bar), small.where(F.col(count) <= bar)
    return big.join(F.broadcast(hot), keys).unionByName(big.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys))


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 40) -> DataFrame:
    """(id, component): the least id reachable over the edges, for each id on an edge.

    Each round takes the least label among the neighbours and then the label of
    that label (pointer jumping), so a chain of n links takes about log n rounds.
    The rounds run on Spark; the driver sees only whether a label changed.  Ids on
    very many edges, and labels that very many ids have, are joined by broadcast
    (under a thousand rows each), so no task gets all their rows.
    """
    from pyspark.sql import functions as F

    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v and u is not null and v is not null")
    e = materialise(e.union(e.select("v", "u")).distinct(), "edges")
    label = materialise(e.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("c"), F.count(F.lit(1)).alias("n")).select(F.col("u").alias("id"), "c", "n"), "labels")
    for _ in range(max_rounds):
        near = hot_join(e, label.withColumnRenamed("id", "v"), ["v"], "n").groupBy("u").agg(F.min("c").alias("m"))
        step = materialise(label.join(near.withColumnRenamed("u", "id"), "id").select("id", F.least("c", "m").alias("m"), "c", "n"), "steps")
        asked = step.groupBy("m").agg(F.count(F.lit(1)).alias("k"))
        jump = materialise(label.select(F.col("id").alias("m"), F.col("c").alias("j")).join(asked, "m"), "jumps")
        new = materialise(hot_join(step, jump, ["m"], "k").select("id", F.least("m", "j").alias("m"), "c", "n"), "labels")
        moved = new.where("m <> c").limit(1).count()
        forget(step, jump)
        label = new.select("id", F.col("m").alias("c"), "n")
        if not moved:
            return label.select("id", F.col("c").alias("component"))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
