"""MinHash near-dedup with BagMinHash: weighted Jaccard over multisets of word shingles.

Signatures: the weight axis of each shingle is cut into dyadic cells [0,1),
[1,2), [2,4), [4,8)...; every cell carries a Poisson process over time whose
rate is its width, seeded by shingle and cell.  A multiplicity covers the cells
below it whole and thins the last one by the points' weight coordinate.  Each
point falls on one of ``M`` components; the first arrival names the component's
value.  Two texts agree in a component with a probability equal to their
weighted Jaccard similarity.  Points are drawn in time order, only up to the
time by which all components have one (checked, and the time doubled if not).

Pairs: texts with equal word sequences form a class and one goes on.  Bands of
``ROWS`` components make buckets.  In a bucket each text meets the one that
shares most with the others (the sum of its buckets' sizes).  In buckets whose
other texts are then still in different components, all pairs of different
components meet: blocks of bounded size are compared with each other, each pair
in the bucket of the first band that it shares.  Every met pair of fitting sizes
is verified by exact multiset overlap, so a link is lost only if no band finds
it; classes are the connected components of verified links.

Defined cases: a text of one to four words is one shingle; a text without a
word (null, empty) is a class of its own; a null id has a null class; equal ids
are one document of the least text hash; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

SHINGLE = 5
SIMILAR = 0.8
BANDS, ROWS = 25, 5
M = BANDS * ROWS
# a block's members and shingles, and the shingles that are compared at once
BLOCK_MEMBERS = 128
BLOCK_SHINGLES = 1 << 17
CELL_MEMBERS = 1 << 12
# pairs of one text that are compared in a task
PAIRS_OF_TEXT = 512

_a, _b, _w = K.roll(41), K.roll(42), K.roll(43)


def shingles(data: np.ndarray, offs: np.ndarray):
    """(hash, document) of each shingle, and two hashes of each document's word sequence with its words."""
    s, e, doc = K.spans(~K.SPACE[data], offs) if len(data) else (np.zeros(0, np.int64),) * 3
    n = len(offs) - 1
    h = _a.span(_a.prefix(data), s, e)
    count = np.bincount(doc, minlength=n)
    at = np.concatenate([[0], np.cumsum(count)])
    p = _w.prefix_values(h)
    q = _b.prefix_values(h)
    t1, t2 = _w.span(p, at[:-1], at[1:]), _b.span(q, at[:-1], at[1:])
    # one shingle for each start that has all its words; one for a shorter text
    first = np.arange(len(h))
    end = np.minimum(first + SHINGLE, at[doc + 1])
    keep = (first + SHINGLE <= at[doc + 1]) | (first == at[doc])
    return _w.span(p, first[keep], end[keep]), doc[keep], K.signed(t1), K.signed(t2), count


def _uniform(bits: np.ndarray) -> np.ndarray:
    return ((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(h: np.ndarray, doc: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """An (n, m) array of 64-bit values; documents without shingles have zeros."""
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    weight = np.diff(np.concatenate([first, [len(h)]]))
    h, doc = h[first], doc[first]
    # cells: 0 is [0,1), k is [2**(k-1), 2**k)
    cells = 1 + np.ceil(np.log2(weight)).astype(np.int64)
    own = np.repeat(np.arange(len(h)), cells)
    k = np.arange(len(own)) - np.repeat(np.cumsum(cells) - cells, cells)
    low = np.where(k == 0, 0, 2.0 ** (k - 1))
    width = np.where(k == 0, 1.0, 2.0 ** (k - 1))
    total = np.bincount(doc, weight, n)
    seed = K.mix(h[own] ^ K.mix((k + 1).astype(np.uint64)))
    of, w = doc[own], weight[own].astype(float)
    best = np.full(n * m, np.inf)
    value = np.zeros(n * m, np.uint64)
    limit = np.where(total > 0, m * (np.log(m) + 2.0) / np.maximum(total, 1), 0)
    time = np.zeros(len(own))
    step = 0
    live = np.arange(len(own))
    while True:
        active = live
        while len(active):
            step += 1
            bits = K.mix(seed[active] + np.uint64((step * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF))
            # the draw of a point depends on shingle, cell and how many points came before
            t = time[active] - np.log(_uniform(bits)) / width[active]
            past = t > limit[of[active]]
            hit = ~past
            a, b, tt = active[hit], bits[hit], t[hit]
            time[a] = tt
            more = K.mix(b)
            inside = low[a] + _uniform(K.mix(more)) * width[a] < w[a]
            c = (more % np.uint64(m)).astype(np.int64)[inside] + of[a[inside]] * m
            tt, v = tt[inside], more[inside] ^ seed[a[inside]]
            # the first arrival at a component wins
            o = np.lexsort((tt, c))
            c, tt, v = c[o], tt[o], v[o]
            lead = np.ones(len(c), bool)
            lead[1:] = c[1:] != c[:-1]
            c, tt, v = c[lead], tt[lead], v[lead]
            win = tt < best[c]
            best[c[win]], value[c[win]] = tt[win], v[win]
            active = a
        full = np.isfinite(best.reshape(n, m)).all(1) | (total == 0)
        if full.all():
            return value.reshape(n, m)
        # documents with an empty component start again with twice the time
        again = ~full
        limit = np.where(again, limit * 2, 0)
        best.reshape(n, m)[again] = np.inf
        live = np.flatnonzero(again[of])
        time[live] = 0
        step = 0


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys."""
    n = len(sig)
    x = sig.reshape(n, BANDS, ROWS)
    key = np.zeros((n, BANDS), np.uint64)
    for r in range(ROWS):
        key = K.mix(key + x[:, :, r])
    return K.signed(np.ascontiguousarray(K.mix(key ^ np.arange(BANDS, dtype=np.uint64))))


def sketch(src: DataFrame) -> DataFrame:
    """(_id, t1, t2, n, bands) of each document with a word."""

    def run(batches):
        for part, data, offs in K.blocks(batches, "_text", K.BLOCK_BYTES // 2):
            h, doc, t1, t2, count = shingles(data, offs)
            keys = band_keys(signatures(h, doc, part.num_rows))
            keep = np.flatnonzero(count > 0)
            take = pa.array(keep)
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * BANDS), pa.array(keys[keep].ravel()))
            size = np.bincount(doc, minlength=part.num_rows)
            yield pa.RecordBatch.from_arrays([part.column("_id").take(take), pa.array(t1[keep]), pa.array(t2[keep]), pa.array(size[keep].astype(np.int32)), bands], ["_id", "t1", "t2", "n", "bands"])

    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, t1 bigint, t2 bigint, n int, bands array<bigint>")


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two multisets."""
    if not len(a) or not len(b):
        return 0.0
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both)


def verify(pairs: DataFrame, text: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """The pairs (a, b) whose exact multiset overlap is at least ``similar``."""

    def run(batches):
        last, mine = None, np.zeros(0, np.uint64)
        for batch in batches:
            ok = []
            ta, tb = (K.text_buffers(batch.column(c)) for c in ("ta", "tb"))
            ids = batch.column("a").to_pylist()
            for i, a in enumerate(ids):
                if a != last:
                    d, o = ta
                    mine = shingles(d[o[i] : o[i + 1]], np.array([0, o[i + 1] - o[i]]))[0]
                    last = a
                d, o = tb
                ok.append(overlap(mine, shingles(d[o[i] : o[i + 1]], np.array([0, o[i + 1] - o[i]]))[0]) >= similar)
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    # a text that many others meet goes to as many tasks as it needs
    times = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m"))
    times = K.materialise(times.withColumn("parts", F.ceil(F.col("m") / PAIRS_OF_TEXT).cast("int")), "times")
    salted = K.hot_join(pairs, times, ["a"], "m").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).drop("m", "parts")
    one = salted.join(text.withColumnsRenamed({"_id": "b", "_text": "tb"}), "b")
    copies = text.withColumnsRenamed({"_id": "a", "_text": "ta"}).join(times, "a").select("a", "ta", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    two = one.join(copies, ["a", "part"])
    return two.select("a", "b", "ta", "tb").mapInArrow(run, pairs.select("a", "b").schema)


def _alike(n1, n2, similar: float):
    return F.least(n1, n2) >= F.greatest(n1, n2) * similar


def block_links(ids, comp, size, side, bands, key, data, offs, similar: float = SIMILAR):
    """(a, b) of a cell's texts with an exact overlap of at least ``similar``, but for links within what others join.

    ``side`` is None where a block meets itself, else pairs are of both sides.
    A pair belongs to the bucket of the first band that it shares.
    """
    own = int(np.flatnonzero(bands[0] == key)[0])
    todo = np.triu(np.ones((len(ids), len(ids)), bool), 1) if side is None else ~side[:, None] & side[None, :]
    todo &= comp[:, None] != comp[None, :]
    todo &= np.minimum(size[:, None], size[None, :]) >= similar * np.maximum(size[:, None], size[None, :])
    for k in range(own):
        todo &= bands[:, k][:, None] != bands[:, k][None, :]
    some = np.flatnonzero(todo.any(0) | todo.any(1))
    if not len(some):
        return []
    text = [shingles(data[offs[i] : offs[i + 1]], np.array([0, offs[i + 1] - offs[i]]))[0] for i in some]
    doc = np.repeat(np.arange(len(some)), [len(t) for t in text])
    h = np.concatenate(text)
    # the j-th copy of a shingle is a member of its own, so a sum over members is the sum of the lesser counts
    o = np.lexsort((h, doc))
    h, doc = h[o], doc[o]
    at = np.arange(len(h))
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h = K.mix(h + K.mix((at - at[new][np.cumsum(new) - 1]).astype(np.uint64)))
    _, member, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    keep = shared[member]
    member, doc = place[member[keep]], doc[keep]
    o = np.argsort(member, kind="stable")
    member, doc = member[o], doc[o]
    both = np.zeros((len(some), len(some)), np.float64)
    for start in range(0, int(shared.sum()), CELL_MEMBERS):
        x, y = np.searchsorted(member, [start, start + CELL_MEMBERS])
        grid = np.zeros((len(some), CELL_MEMBERS), np.float32)
        grid[doc[x:y], member[x:y] - start] = 1
        both += grid @ grid.T
    n = np.array([len(t) for t in text], float)
    like = todo[np.ix_(some, some)] & (both / (n[:, None] + n[None, :] - both) >= similar)
    out, root = [], {}

    def find(c):
        while root.get(c, c) != c:
            c = root[c]
        return c

    for i, j in zip(*np.nonzero(like)):
        a, b = int(some[i]), int(some[j])
        x, y = find(int(comp[a])), find(int(comp[b]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(ids[a]), int(ids[b])))
    return out


def cells(placed: DataFrame, lead: DataFrame) -> DataFrame:
    """(key, lo, hi, _id, c, side): the blocks of each bucket dealt so that all members of other components meet.

    A bucket's leader has met all and stays out.  Members of the bucket's
    largest component and the rest are cut into blocks of bounded size; every
    block of the rest meets every block.
    """
    rest = placed.join(lead.select("key", "lead"), "key").where("_id <> lead").drop("lead")
    group = rest.groupBy("key", "c").agg(F.count(F.lit(1)).alias("m"), F.sum(F.col("n").cast("long")).alias("s"))
    group = group.groupBy("key").agg(F.max(F.struct("m", "s", "c")).alias("big"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("several")).where("several > 1")
    cut = lambda m, s: F.greatest(F.lit(1), F.ceil(m / BLOCK_MEMBERS), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    group = group.select("key", F.col("big.c").alias("big"), cut(F.col("m") - F.col("big.m"), F.col("s") - F.col("big.s")).alias("few"), cut(F.col("big.m"), F.col("big.s")).alias("many"))
    group = K.materialise(group, "several")
    salt = F.xxhash64("_id", "key")
    own = F.when(F.col("c") == F.col("big"), F.col("few") + F.pmod(salt, F.col("many"))).otherwise(F.pmod(salt, F.col("few"))).cast("int")
    d = rest.join(group, "key").withColumn("own", own)
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("own") < F.col("few"), F.col("few") + F.col("many") - 1).otherwise(F.col("few") - 1))))
    return d.select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "_id", "c", (F.col("own") > F.col("other")).alias("side"))


def near_links(met: DataFrame, same: DataFrame, text: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(a, b): links between the components of the texts that meet in the cells ``met``; each pair is compared by exact overlap."""

    def emit(parts):
        t = pa.Table.from_batches(parts).combine_chunks()
        if t.num_rows < 2:
            return
        lo, hi = t["lo"][0].as_py(), t["hi"][0].as_py()
        side = None if lo == hi else np.array(t["side"].to_pylist(), bool)
        bands = t["bands"].chunk(0).flatten().to_numpy().reshape(t.num_rows, BANDS)
        data, offs = K.text_buffers(t["_text"])
        found = block_links(t["_id"].to_numpy(), t["c"].to_numpy(), t["n"].to_numpy(), side, bands, t["key"][0].as_py(), data, offs, similar)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        parts, last = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell = [batch.column(c).to_numpy() for c in ("key", "lo", "hi")]
            edge = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cell], axis=0)) + 1
            for x, y in zip([0, *edge.tolist()], [*edge.tolist(), batch.num_rows]):
                name = tuple(int(v[x]) for v in cell)
                if name != last and parts:
                    yield from emit(parts)
                    parts = []
                parts.append(batch.slice(x, y - x))
                last = name
        if parts:
            yield from emit(parts)

    full = same.select("_id", "n", "bands").join(text, "_id")
    rows = met.join(full, "_id").select("key", "lo", "hi", "_id", "c", "n", "side", "bands", "_text")
    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(run, "a bigint, b bigint").distinct()


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """(id, class_id, copies): the least id of each document's class, and how many documents have its very words.

    Ids are integers.
    """
    src = df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    named = src.where("_id is not null")
    sk = K.materialise(sketch(named), "sketches")
    same = sk.groupBy("t1", "t2").agg(F.min(F.struct("_id", "n", "bands")).alias("r"), F.count(F.lit(1)).alias("copies"))
    same = K.materialise(same.select("t1", "t2", "r.*", "copies"), "same")
    rows = same.select("_id", "n", F.explode("bands").alias("key"))
    size = K.materialise(rows.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1"), "buckets")
    member = K.materialise(rows.join(size, "key"), "members")
    popular = member.groupBy("_id").agg(F.sum("members").alias("pop"))
    lead = member.join(popular, "_id").groupBy("key").agg(F.max(F.struct("pop", (-F.col("_id")).alias("neg"), "n")).alias("l"))
    lead = K.materialise(lead.select("key", (-F.col("l.neg")).alias("lead"), F.col("l.n").alias("lead_n")), "leaders")
    met = member.join(lead, "key").where((F.col("_id") != F.col("lead")) & _alike(F.col("n"), F.col("lead_n"), similar))
    pairs = K.materialise(met.select(F.col("lead").alias("a"), F.col("_id").alias("b")).distinct(), "pairs")
    text = named.join(same.select("_id"), "_id", "left_semi").dropDuplicates(["_id"])
    links = K.materialise(verify(pairs, text, similar), "links")
    comp = K.components(links)
    # what a bucket's leader did not join: all pairs of other components
    placed = member.join(comp.withColumnsRenamed({"id": "_id", "component": "c"}), "_id", "left").withColumn("c", F.coalesce("c", "_id"))
    met = K.materialise(cells(placed, lead), "cells")
    second = K.materialise(near_links(met, same, text, similar), "near")
    links = links.unionByName(second)
    comp = K.components(links).withColumnsRenamed({"id": "rep", "component": "class_id"})
    whole = sk.select("_id", "t1", "t2").join(same.select("t1", "t2", F.col("_id").alias("rep"), "copies"), ["t1", "t2"])
    found = whole.join(comp, "rep", "left").groupBy("_id").agg(F.min(F.coalesce("class_id", "rep")).alias("class_id"), F.max("copies").alias("copies"))
    out = src.select("_id").join(found, "_id", "left")
    return out.select(F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
