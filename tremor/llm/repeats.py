"""Removal of everything covered by a string of a given length that also starts elsewhere.

A string is a run of symbols: bytes (``unit="bytes"``, 400 of them) or words
(``unit="words"``; ``PASSAGE`` of them make a passage).

Parsing: a rolling hash of ``gram`` symbols is taken at each symbol, and the
least in each stretch of ``reach`` starts is a trigger (the leftmost among
equals).  Each window start belongs to the trigger it sees first, so the starts
fall into phrases: runs ``[lo, hi]`` of starts with one trigger ``a``.  Equal
windows see equal triggers at equal distances, wherever they lie, so the parse
is free of the places where texts begin.

Dictionary: for a phrase, two strings matter: the *core* that all its windows
hold and the *hull* that holds all its windows.  No other place has the core:
none of the windows repeats.  Another place has the hull: all repeat.  What is
left goes into the dictionary, one entry for each distinct hull, so a group of
copies of any size is worked on once.  Counting is by aggregation with partial
sums: no key's rows meet in one task.

Order: entries with one core lie side by side in the corpus order and make a
shard.  A shard's suffix array of the dictionary sorts the phrase suffixes in
front of the trigger (read from the trigger outwards), its suffix array of the
parse sorts what follows the trigger, and both have the lengths of the common
prefixes of neighbours.  A window with ``d`` symbols in front of the trigger
repeats if it lies in one run of each array, cut where neighbours share less
than ``d`` symbols in front or ``length - d`` behind.

A core with more than ``SHARD`` entries is not sorted in one task: its phrases
are opened into ``BLOCK`` starts at a fixed distance from the trigger, and those
that are still mixed into single windows, which are classed by 128-bit hashes.

``across``: only what also lies in another document (another id or text) counts.

Defined cases: null texts are empty; texts under the length lose nothing; equal
rows are separate documents, and repeat each other (with ``across`` they are one
document); all columns are carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

LENGTH = 400
REACH = 300
GRAM = 16
BLOCK = 16
#: words of a passage, and the same parameters in words
PASSAGE = 51
PASSAGE_REACH = 40
PASSAGE_GRAM = 3
SHARD = 1024

_a, _b, _w = K.roll(31), K.roll(32), K.roll(33)


class Rule:
    """What counts as a repeat: ``length`` symbols of a unit, anywhere else or in another document."""

    def __init__(self, unit: str = "bytes", length: int | None = None, reach: int | None = None, across: bool = False):
        self.unit, self.across = unit, across
        own = {"bytes": (LENGTH, REACH, GRAM), "words": (PASSAGE, PASSAGE_REACH, PASSAGE_GRAM)}[unit]
        self.length, self.reach = length or own[0], reach or own[1]
        self.gram = min(own[2], self.length - self.reach)

    def symbols(self, data: np.ndarray, offs: np.ndarray):
        """(symbols, document offsets in them): the bytes, or a 64-bit hash of each word."""
        if self.unit == "bytes":
            return data, offs
        s, e, doc = K.spans(~K.SPACE[data], offs)
        return _w.span(_w.prefix(data), s, e), np.searchsorted(doc, np.arange(len(offs)))

    def sums(self, roll: K.Roll, x: np.ndarray) -> np.ndarray:
        return roll.prefix(x) if self.unit == "bytes" else roll.prefix_values(x)

    def two(self, x, s, e, pa_=None, pb_=None):
        pa_ = self.sums(_a, x) if pa_ is None else pa_
        pb_ = self.sums(_b, x) if pb_ is None else pb_
        return K.signed(_a.span(pa_, s, e)), K.signed(_b.span(pb_, s, e))


def triggers(rule: Rule, x: np.ndarray, offs: np.ndarray, p: np.ndarray):
    """(document, lo, hi, a) of the phrases of a block, as offsets in its symbols."""
    n, length, reach, gram = len(x), rule.length, rule.reach, rule.gram
    size = np.diff(offs)
    z = np.zeros(0, np.int64)
    if n < length or (size < length).all():
        return z, z, z, z
    at = np.arange(max(n - gram + 1, 0))
    key = (_a.span(p, at, at + gram) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    key = np.concatenate([key, np.full(n - len(key), np.uint64(0xFFFFFFFFFFFFFFFF))])
    width = 1
    while width * 2 <= reach:
        key[:-width] = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < reach:
        key[: -(reach - width)] = np.minimum(key[: -(reach - width)], key[reach - width :])
    # the starts of whole windows
    valid = np.zeros(n + 1, np.int32)
    long = np.flatnonzero(size >= length)
    np.add.at(valid, offs[:-1][long], 1)
    np.add.at(valid, offs[1:][long] - length + 1, -1)
    starts = np.flatnonzero(np.cumsum(valid[:n]) > 0)
    anchor = (key[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    lo, hi = starts[first], starts[last]
    return np.searchsorted(offs, lo, side="right") - 1, lo, hi, anchor[first]


def phrases(src: DataFrame, rule: Rule) -> DataFrame:
    """(k1, k2, lo, hi, a, core, x1, x2) of each phrase, offsets in the document's symbols."""

    def run(batches):
        for part, data, offs in K.blocks(batches, "_text"):
            x, offs = rule.symbols(data, offs)
            p = rule.sums(_a, x)
            doc, lo, hi, a = triggers(rule, x, offs, p)
            if not len(doc):
                continue
            # windows hold a and all up to a + length - reach
            core = K.signed(_a.span(p, a, a + rule.length - rule.reach))
            x1, x2 = rule.two(x, lo, hi + rule.length, p)
            at, take = offs[doc], pa.array(doc)
            yield pa.RecordBatch.from_arrays([part.column("k1").take(take), part.column("k2").take(take), *(pa.array((v - at).astype(np.int32)) for v in (lo, hi, a)), pa.array(core), pa.array(x1), pa.array(x2)], ["k1", "k2", "lo", "hi", "a", "core", "x1", "x2"])

    return src.select("k1", "k2", "_text").mapInArrow(run, "k1 bigint, k2 bigint, lo int, hi int, a int, core bigint, x1 bigint, x2 bigint")


def _open(text: DataFrame, wanted: DataFrame, rule: Rule, emit, schema: str) -> DataFrame:
    """Run ``emit(symbols, document offsets, document, its fields...)`` over the documents that have a list."""
    lists = wanted.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct(*(c for c in wanted.columns if c not in ("k1", "k2"))))).alias("ws"))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches):
        for batch in batches:
            data, offs = K.text_buffers(batch.column("_text"))
            ws = batch.column("ws")
            for a, b in K.cut_rows(offs, K.BLOCK_BYTES):
                x, o = rule.symbols(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a])
                part = ws.slice(a, b - a)
                flat = part.flatten()
                counts = np.diff(np.frombuffer(part.buffers()[1], np.int32)[part.offset : part.offset + len(part) + 1])
                doc = np.repeat(np.arange(b - a), counts)
                fields = [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in flat.flatten()]
                rows, cols = emit(x, o, doc, *fields)
                take = pa.array(a + rows)
                yield pa.RecordBatch.from_arrays([batch.column("k1").take(take), batch.column("k2").take(take), *cols], names)

    return text.join(lists.hint("shuffle_hash"), ["k1", "k2"]).select("k1", "k2", "_text", "ws").mapInArrow(run, schema)


def _ranges(lo: np.ndarray, hi: np.ndarray):
    """(owner, value) for each value of each closed range."""
    count = np.maximum(hi - lo + 1, 0)
    owner = np.repeat(np.arange(len(lo)), count)
    first = np.concatenate([[0], np.cumsum(count)[:-1]]) if len(lo) else count
    return owner, np.arange(count.sum()) - first[owner] + lo[owner]


def _classes(rows: DataFrame, rule: Rule, core: str, one: str, two: str, place: list[str], name: str):
    """(settled, opened): rows whose windows all repeat, and one row for each distinct hull that is still open.

    ``place`` names the columns that tell places apart; the same place may come
    twice.  ``spot`` tells whether rows count as different: by place or by document.
    """
    if "spot" not in rows.columns:
        rows = rows.withColumn("spot", F.xxhash64("k1", "k2") if rule.across else F.xxhash64(*place))
    stat = rows.groupBy(core).agg(F.min("spot").alias("p0"), F.max("spot").alias("p1"), F.min(one).alias("m0"), F.max(one).alias("m1"), F.min(two).alias("n0"), F.max(two).alias("n1"), F.count(F.lit(1)).alias("n"), F.count(one).alias("hulls"))
    # in the first step equal documents have equal places, and are counted as they come
    more = (F.col("p0") != F.col("p1")) | ((F.col("n") > 1) if name == "phrases" and not rule.across else F.lit(False))
    stat = stat.where(more).select(core, "n", ((F.col("m0") != F.col("m1")) | (F.col("n0") != F.col("n1")) | (F.col("hulls") < F.col("n")) | F.col("m0").isNull()).alias("mixed"))
    stat = K.materialise(stat, f"{name}-cores")
    seen = K.materialise(K.hot_join(rows, stat, [core], "n").drop("n"), f"{name}-seen")
    mixed = seen.where("mixed").drop("mixed")
    rest = [c for c in rows.columns if c not in (*place, core, one, two, "spot")]
    entry = F.struct("spot", *place, *rest, core)
    hull = mixed.where(F.col(one).isNotNull()).groupBy(one, two).agg(F.min("spot").alias("p0"), F.max("spot").alias("p1"), F.count(F.lit(1)).alias("n"), F.min(entry).alias("r"), F.max(entry).alias("q"))
    hull = K.materialise(hull.select(one, two, "n", more.alias("twice"), "r", "q"), f"{name}-hulls")
    settled = seen.where(~F.col("mixed")).select(*rows.columns).unionByName(K.hot_join(mixed.select(*rows.columns), hull.where("twice").select(one, two, "n"), [one, two], "n").drop("n"))
    # where documents count, a hull of several is stood for by two of them
    opened = hull.select(F.explode(F.array_distinct(F.array("r", "q")) if rule.across else F.array("r")).alias("r")).select("r.*")
    alone = mixed.where(F.col(one).isNull())
    return settled, opened.unionByName(alone.select(*opened.columns)), [stat, seen, hull]


# --- shards of the corpus order ---------------------------------------------


def _prefix_order(rows: np.ndarray, size: np.ndarray, group: np.ndarray):
    """(order, common prefix with the one before in it) of padded symbol rows, groups apart."""
    m, width = rows.shape
    if rows.dtype == np.uint8:
        padded = np.zeros((m, -(-max(width, 1) // 8) * 8), np.uint8)
        padded[:, :width] = rows
        keys = padded.view(">u8").astype(np.uint64)
    else:
        keys = rows
    # what ends early sorts before what goes on, so it never parts two longer ones
    order = np.lexsort((size, *(keys[:, k] for k in range(keys.shape[1] - 1, -1, -1)), group))
    r, n = rows[order], size[order]
    common = np.zeros(m, np.int64)
    if width:
        differ = r[1:] != r[:-1]
        first = np.where(differ.any(1), differ.argmax(1), width)
        common[1:] = np.minimum(first, np.minimum(n[1:], n[:-1]))
    common[1:][group[order][1:] != group[order][:-1]] = -1
    common[0] = -1
    return order, common


def shard_repeats(rule: Rule, group: np.ndarray, text: list[bytes], left: np.ndarray, last: np.ndarray, spot: np.ndarray):
    """A matrix (entry, start of a window from the entry's first one): whether the window repeats.

    ``text`` is an entry's hull, ``left`` the symbols in front of its trigger
    and ``last`` its last start.
    """
    m, length = len(text), rule.length
    kind = np.dtype(np.uint8 if rule.unit == "bytes" else np.uint64)
    flat = np.frombuffer(b"".join(text), kind)
    size = np.array([len(t) // kind.itemsize for t in text], np.int64)
    at = np.cumsum(size) - size
    right = size - left
    front, behind = np.zeros((m, int(left.max(initial=0))), kind), np.zeros((m, int(right.max(initial=0))), kind)
    own, k = _ranges(np.zeros(m, np.int64), left - 1)
    front[own, k] = flat[at[own] + left[own] - 1 - k]
    own, k = _ranges(np.zeros(m, np.int64), right - 1)
    behind[own, k] = flat[at[own] + left[own] + k]
    of_front, share_front = _prefix_order(front, left, group)
    of_behind, share_behind = _prefix_order(behind, right, group)
    out = np.zeros((m, int(last.max(initial=0)) + 1), bool)
    run_front, run_behind = np.empty(m, np.int64), np.empty(m, np.int64)
    for d in range(int(left.max(initial=0)) + 1):
        active = np.flatnonzero((left >= d) & (left - d <= last))
        if len(active) < 2:
            continue
        run_front[of_front] = np.cumsum(share_front < d)
        run_behind[of_behind] = np.cumsum(share_behind < length - d)
        key = run_front[active] * (m + 1) + run_behind[active]
        o = np.argsort(key, kind="stable")
        key, who = key[o], active[o]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        many = np.diff(np.concatenate([begin, [len(key)]])) > 1
        s = spot[who]
        hit = many & (np.minimum.reduceat(s, begin) != np.maximum.reduceat(s, begin))
        hit = hit[np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1]
        out[who[hit], left[who[hit]] - d] = True
    return out


ENTRY = "k1 bigint, k2 bigint, lo int, last int, front int, core bigint, spot bigint, hull binary"


def entries(text: DataFrame, opened: DataFrame, rule: Rule) -> DataFrame:
    """The dictionary's entries with their hulls: first start, last start and trigger (both from the first start), core, spot."""
    length = rule.length

    def contexts(x, offs, doc, lo, hi, a, core, spot):
        width = x.dtype.itemsize
        s, e = lo + offs[doc], hi + length + offs[doc]
        raw = x.tobytes()
        hull = [raw[i * width : j * width] for i, j in zip(s.tolist(), e.tolist())]
        return doc, [pa.array(lo.astype(np.int32)), pa.array((hi - lo).astype(np.int32)), pa.array((a - lo).astype(np.int32)), pa.array(core), pa.array(spot), pa.array(hull, pa.binary())]

    return _open(text, opened.select("k1", "k2", "lo", "hi", "a", "core", "spot"), rule, contexts, ENTRY)


def sorted_repeats(entry: DataFrame, rule: Rule) -> DataFrame:
    """(k1, k2, s, e): repeated spans among dictionary entries, shard by shard."""
    length = rule.length

    def emit(parts: list[pa.RecordBatch]):
        t = pa.Table.from_batches(parts).combine_chunks()
        core = t["core"].to_numpy()
        group = np.cumsum(np.concatenate([[0], core[1:] != core[:-1]]))
        lo, last = t["lo"].to_numpy().astype(np.int64), t["last"].to_numpy().astype(np.int64)
        hit = shard_repeats(rule, group, t["hull"].to_pylist(), t["front"].to_numpy().astype(np.int64), last, t["spot"].to_numpy())
        edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        who, s = np.nonzero(edge == 1)
        _, e = np.nonzero(edge == -1)
        take = pa.array(who)
        yield pa.RecordBatch.from_arrays([t["k1"].combine_chunks().take(take), t["k2"].combine_chunks().take(take), pa.array((lo[who] + s).astype(np.int32)), pa.array((lo[who] + e - 1 + length).astype(np.int32))], ["k1", "k2", "s", "e"])

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            core = batch.column("core").to_numpy()
            edges = np.flatnonzero(core[1:] != core[:-1]) + 1
            if held and held[-1].column("core")[-1].as_py() != core[0]:
                edges = np.concatenate([[0], edges])
            at = 0
            for x in edges.tolist():
                # shards are worked on together, some thousand entries at a time
                if rows + x - at >= SHARD and rows + x - at > 0:
                    if x > at:
                        held.append(batch.slice(at, x - at))
                    if held:
                        yield from emit(held)
                    held, rows, at = [], 0, x
            held.append(batch.slice(at))
            rows += batch.num_rows - at
        if held:
            yield from emit(held)

    return entry.repartition("core").sortWithinPartitions("core").mapInArrow(run, "k1 bigint, k2 bigint, s int, e int")


def hashed_repeats(entry: DataFrame, rule: Rule) -> DataFrame:
    """(k1, k2, s, e): the same for the entries of large shards, by hashes of ever smaller sets of windows."""
    length = rule.length
    kind = np.dtype(np.uint8 if rule.unit == "bytes" else np.uint64)

    def over(rows: DataFrame, fields: list[str], emit, schema: str) -> DataFrame:
        """Run ``emit(symbols of the hulls, begin and end of each, fields...)`` over entries; it gives rows and columns."""
        names = [x.split()[0] for x in schema.split(", ")]

        def run(batches):
            for batch in batches:
                for a in range(0, batch.num_rows, SHARD):
                    part = batch.slice(a, SHARD)
                    hull = part.column("hull").to_pylist()
                    size = np.array([len(h) // kind.itemsize for h in hull], np.int64)
                    x, begin = np.frombuffer(b"".join(hull), kind), np.cumsum(size) - size
                    own, cols = emit(x, begin, begin + size, *(part.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in fields))
                    take = pa.array(own)
                    yield pa.RecordBatch.from_arrays([part.column(c).take(take) for c in ("k1", "k2", "lo")] + cols, names)

        return rows.mapInArrow(run, schema)

    def blocks(x, begin, end, lo, last, front, spot):
        own, j = _ranges((front - last) // BLOCK, front // BLOCK)
        top = front[own] - BLOCK * j  # the last start of the block, from the hull's first
        bottom, at = top - BLOCK + 1, begin[own]
        pa_, pb_ = rule.sums(_a, x), rule.sums(_b, x)
        # the core lies in the hull even where the block does not
        core = K.signed(_a.span(pa_, at + top, at + bottom + length))
        whole = (bottom >= 0) & (top <= last[own])
        f1, f2 = rule.two(x, np.where(whole, at + bottom, at), np.where(whole, at + top + length, at), pa_, pb_)
        return own, [pa.array((lo[own] + top).astype(np.int32)), pa.array(core), pa.array(f1, mask=~whole), pa.array(f2, mask=~whole), pa.array(spot[own])]

    # without ``across`` places tell rows apart
    spot = (lambda df, *place: df) if rule.across else (lambda df, *place: df.withColumn("spot", F.xxhash64("k1", "k2", *place)))
    b = over(entry, ["lo", "last", "front", "spot"], blocks, "k1 bigint, k2 bigint, lo int, top int, core bigint, f1 bigint, f2 bigint, spot bigint")
    b = K.materialise(spot(b, "top"), "blocks")
    done, todo, _ = _classes(b, rule, "core", "f1", "f2", ["k1", "k2", "lo", "top"], "blocks")
    out = done.select("k1", "k2", (F.col("top") - BLOCK + 1).alias("s"), (F.col("top") + length).alias("e"))

    def windows(x, begin, end, lo, last, top, spot):
        high = top - lo
        own, s = _ranges(np.maximum(high - BLOCK + 1, 0), np.minimum(high, last))
        w1, w2 = rule.two(x, begin[own] + s, begin[own] + s + length)
        return own, [pa.array((lo[own] + s).astype(np.int32)), pa.array(w1), pa.array(w2), pa.array(spot[own])]

    rows = entry.drop("spot").join(todo.select("k1", "k2", "lo", "top", "spot").distinct(), ["k1", "k2", "lo"])
    w = over(rows, ["lo", "last", "top", "spot"], windows, "k1 bigint, k2 bigint, lo int, s int, w1 bigint, w2 bigint, spot bigint")
    w = K.materialise(spot(w, "s"), "windows")
    twice = w.groupBy("w1", "w2").agg(F.min("spot").alias("p0"), F.max("spot").alias("p1"), F.count(F.lit(1)).alias("n")).where("p0 <> p1").select("w1", "w2", "n")
    return out.unionByName(K.hot_join(w, K.materialise(twice, "twice"), ["w1", "w2"], "n").select("k1", "k2", "s", (F.col("s") + length).alias("e")))


def repeated_spans(src: DataFrame, rule: Rule, shard: int = SHARD) -> DataFrame:
    """(k1, k2, spans): a list of spans of symbols that cover all repeated windows, for each document (k1, k2, _text) with any."""
    text = src.select("k1", "k2", "_text")
    p = K.materialise(phrases(src, rule), "phrases")
    done, todo, held = _classes(p, rule, "core", "x1", "x2", ["k1", "k2", "lo"], "phrases")
    K.forget(p)
    size = todo.groupBy("core").agg(F.count(F.lit(1)).alias("m"))
    size = K.materialise(size.where("m > 1"), "sizes")
    found = done.select("k1", "k2", F.col("lo").alias("s"), (F.col("hi") + rule.length).alias("e"))
    found = found.unionByName(sorted_repeats(entries(text, todo.join(size.where(F.col("m") <= shard).select("core"), "core"), rule), rule))
    if size.where(F.col("m") > shard).limit(1).count():
        large = K.materialise(entries(text, todo.join(size.where(F.col("m") > shard).select("core"), "core"), rule), "entries")
        found = found.unionByName(hashed_repeats(large, rule))
    spans = K.materialise(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("s", "e")).alias("spans")), "spans")
    K.forget(size, *held)
    return spans


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted maximal runs of the covered symbols."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_row`` (the other columns), ``_id``, ``_text`` and hashes k1, k2 of both."""
    names = df.columns
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in names if c != text_col)) if len(names) > 1 else F.struct(F.lit(0))
    return df.select(row.alias("_row"), F.col(id_col).alias("_id"), body.alias("_text"), F.xxhash64(F.col(id_col)).alias("k1"), F.xxhash64(body).alias("k2"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "bytes", length: int | None = None, reach: int | None = None, across: bool = False, passage: int | None = None, shard: int = SHARD) -> DataFrame:
    """(_row, _id, kept, spans, n_bytes, n_passage_words): ``_row`` holds the columns of ``df``, ``kept`` the remaining
    bytes and ``spans`` the removed runs of bytes.  With ``passage``, n_passage_words counts the words in passages of
    that many words that also lie in another document (null without); they stay.
    The keys of a document are hashes of its id and of its text.
    """
    rule = Rule(unit, length, reach, across)
    src = _keyed(df, id_col, text_col)
    joined = src.join(repeated_spans(src, rule, shard).hint("shuffle_hash"), ["k1", "k2"], "left")
    if passage:
        marked = repeated_spans(src, Rule("words", passage, passage * PASSAGE_REACH // PASSAGE, True), shard).withColumnRenamed("spans", "marked")
        joined = joined.join(marked.hint("shuffle_hash"), ["k1", "k2"], "left")
    else:
        joined = joined.withColumn("marked", F.lit(None).cast("array<struct<s:int,e:int>>"))
    joined = joined.select("_row", "_id", "_text", "spans", "marked")
    kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))

    def run(batches):
        for batch, _, _ in K.blocks(batches, "_text", 4 * K.BLOCK_BYTES):
            raw = K._strings(batch.column("_text")).cast(pa.large_binary()).to_pylist()
            kept, runs, words = [], [], []
            for text, spans, marked in zip(raw, batch.column("spans").to_pylist(), batch.column("marked").to_pylist()):
                r = merge_spans([(x["s"], x["e"]) for x in spans or ()])
                if r and unit == "words":
                    data = np.frombuffer(text, np.uint8)
                    s, e, _ = K.spans(~K.SPACE[data], np.array([0, len(data)]))
                    r = [(int(s[i]), int(e[j - 1])) for i, j in r]
                at, parts = 0, []
                for s, e in r:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                kept.append(b"".join(parts))
                runs.append([{"s": s, "e": e} for s, e in r])
                words.append(sum(e - s for s, e in merge_spans([(x["s"], x["e"]) for x in marked or ()])))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(kept, pa.binary()), pa.array(runs, kind), pa.array([len(x) for x in raw], pa.int64()), pa.array(words if passage else [None] * len(words), pa.int64())], ["_row", "_id", "kept", "spans", "n_bytes", "n_passage_words"])

    shape = joined.select("_row", "_id").withColumns({"kept": F.lit(b""), "spans": F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e"))), "n_bytes": F.lit(0).cast("long"), "n_passage_words": F.lit(None).cast("long")}).schema
    return joined.mapInArrow(run, shape)


def brute_force(texts: list, length: int) -> list[list[tuple[int, int]]]:
    """What ``remove_repeats`` must find, by counting all windows of bytes (or of a list's items): for small fixtures."""
    seen: dict[bytes, int] = {}
    name = lambda t, i: hashlib.blake2b(t[i : i + length] if isinstance(t, bytes) else b"\x00".join(t[i : i + length]), digest_size=16).digest()
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[name(t, i)] = seen.get(name(t, i), 0) + 1
    return [merge_spans([(i, i + length) for i in range(len(t) - length + 1) if seen[name(t, i)] > 1]) for t in texts]

