"""Line dedup by content-defined chunks of lines.

Each line is hashed; a rolling hash over the last ``SPAN`` line hashes closes a
chunk where it is divisible by ``DIVISOR`` (or after ``MOST`` lines), so chunk
borders depend on content and survive shifts.  A border right after another one
is skipped, and so is one that would leave a text's first or last line alone, so
all chunks of a text of two lines or more have two lines at least.  Chunks are
counted over the corpus by a 128-bit hash.  Of a repeated chunk the occurrence
with the least (id, position) stays and the others go, after the bytes of all
its occurrences have been compared: a hash shared by different bytes removes
nothing.

Defined cases: a null text stays null and an empty one empty; a text of one line
loses nothing; a null id is replaced by a hash of the text; repeated rows (the same id twice) count as
occurrences of the same document and are cut alike; where rows of one id have
different texts, a row loses a chunk only if it has it at that place; all
columns are carried, clashing names included, as the work happens on renamed
copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

SPAN = 2
DIVISOR = 3
MOST = 16

_a, _b = K.roll(21), K.roll(22)


def chunk_spans(data: np.ndarray, offs: np.ndarray):
    """(start, end, lines, document, place in the document) of the chunks of a block, in order.

    The end takes in the line's \\n but for a document's last line.
    """
    s, e, doc = K.line_spans(data, offs)
    p = _a.prefix(data)
    h = _a.span(p, s, e)
    roll = h.copy()
    for k in range(1, SPAN):
        same = np.zeros(len(doc), bool)
        same[k:] = doc[k:] == doc[:-k]
        shifted = np.zeros(len(h), np.uint64)
        shifted[k:] = h[:-k]
        roll += np.where(same, K.mix(shifted + np.uint64(k)), np.uint64(0))
    last = np.ones(len(doc), bool)
    last[:-1] = doc[1:] != doc[:-1]
    n = len(doc)
    lead, last = np.ones(n, bool), np.ones(n, bool)
    lead[1:] = doc[1:] != doc[:-1]
    last[:-1] = lead[1:]
    border = (K.mix(roll) % np.uint64(DIVISOR) == 0) & ~lead
    # of adjacent borders every other one stays, from the first of their run on
    at = np.arange(n)
    begin = border.copy()
    begin[1:] &= ~border[:-1]
    border &= (at - np.maximum.accumulate(np.where(begin, at, 0))) % 2 == 0
    border[:-1] &= ~last[1:]  # no last line of its own
    close = border | last
    # in a run without a border, one after each MOST lines that leaves two lines
    ends = np.flatnonzero(close)
    first = np.concatenate([[0], ends[:-1] + 1])
    size = np.repeat(ends - first + 1, ends - first + 1)
    place = at - np.repeat(first, ends - first + 1)
    close |= (place % MOST == MOST - 1) & (place < size - 2)
    ends = np.flatnonzero(close)
    first = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
    cs, cd = s[first], doc[first]
    ce = np.minimum(e[ends] + 1, offs[cd + 1])
    new = np.diff(cd, prepend=-1) != 0
    at = np.arange(len(cd))
    return cs, ce, ends - first + 1, cd, at - at[new][np.cumsum(new) - 1] if len(cd) else at


def _key(data: np.ndarray, s: np.ndarray, e: np.ndarray, data_end: np.ndarray):
    """128-bit hashes of chunks without a closing \\n, so that one at a text's end equals one inside."""
    stop = e - ((e > s) & (data[np.maximum(e - 1, 0)] == 0x0A) & ~data_end)
    return K.signed(_a.span(_a.prefix(data), s, stop)), K.signed(_b.span(_b.prefix(data), s, stop)), stop


def chunks(docs: DataFrame) -> DataFrame:
    """(_id, k, h1, h2) of each chunk of two lines or more with a word in it."""

    def run(batches):
        for part, data, offs in K.blocks(batches, "_text"):
            s, e, lines, doc, k = chunk_spans(data, offs)
            ink = np.concatenate([[0], np.cumsum(~K.SPACE[data])])
            keep = np.flatnonzero((lines > 1) & (ink[e] > ink[s]))
            s, e, doc, k = s[keep], e[keep], doc[keep], k[keep]
            h1, h2, _ = _key(data, s, e, e == offs[doc + 1])
            yield pa.RecordBatch.from_arrays([part.column("_id").take(pa.array(doc)), pa.array(k.astype(np.int32)), pa.array(h1), pa.array(h2)], ["_id", "k", "h1", "h2"])

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select("_id", "_text").where("_text is not null").mapInArrow(run, f"_id {kind}, k int, h1 bigint, h2 bigint")


def _wanted(ks, h1s, h1: np.ndarray) -> list[int]:
    """The places that exist in a text and hold the chunk that is meant: rows of one id may differ."""
    return [k for k, h in zip(ks, h1s, strict=True) if k < len(h1) and h1[k] == h]


def _bytes_of(joined: DataFrame) -> DataFrame:
    """(h1, h2, body) of the wanted chunks of each document."""

    def run(batches):
        for batch in batches:
            wanted, hashes = batch.column("ks").to_pylist(), batch.column("hs").to_pylist()
            data, offs = K.text_buffers(batch.column("_text"))
            for a, b in K.cut_rows(offs, K.BLOCK_BYTES):
                d, o = data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
                s, e, _, doc, k = chunk_spans(d, o)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                h1, h2, stop = _key(d, s, e, e == o[doc + 1])
                pick = np.array([first[i - a] + x for i in range(a, b) for x in _wanted(wanted[i], hashes[i], h1[first[i - a] : first[i - a + 1]])], np.int64)
                s, h1, h2, stop = s[pick], h1[pick], h2[pick], stop[pick]
                raw = d.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([raw[x:y] for x, y in zip(s.tolist(), stop.tolist())], pa.binary())], ["h1", "h2", "body"])

    return joined.select("_text", "ks", "hs").mapInArrow(run, "h1 bigint, h2 bigint, body binary")


def removals(docs: DataFrame) -> DataFrame:
    """(_id, ks, hs): the places and hashes of the chunks that go, one row for each id that loses any."""
    found = K.materialise(chunks(docs).distinct(), "chunks")
    again = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "k")).alias("first")).where("n > 1")
    again = K.materialise(again, "repeated")
    member = K.materialise(K.hot_join(found, again, ["h1", "h2"], "n").select("_id", "k", "h1", "h2", "first"), "members")
    K.forget(found)
    # every occurrence's bytes are compared: equal ones are combined in the task that reads them
    bodies = _bytes_of(docs.select("_id", "_text").join(_places(member).hint("shuffle_hash"), "_id"))
    mixed = bodies.groupBy("h1", "h2", "body").agg(F.count(F.lit(1)).alias("n")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("bodies")).where("bodies > 1")
    gone = member.where(F.struct("_id", "k") != F.col("first")).join(mixed, ["h1", "h2"], "left_anti")
    return _places(gone)


def _places(rows: DataFrame) -> DataFrame:
    per = rows.groupBy("_id").agg(F.sort_array(F.collect_list(F.struct("k", "h1"))).alias("p"))
    return per.select("_id", F.col("p.k").alias("ks"), F.col("p.h1").alias("hs"))


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with the text cut, and n_chunks_removed, n_lines_removed beside its columns under names that clash with none."""
    names = df.columns
    src = df.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"), F.coalesce(F.col(id_col), F.xxhash64(F.col(text_col)).cast(df.schema[id_col].dataType)).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    gone = removals(src)
    joined = src.join(gone.hint("shuffle_hash"), "_id", "left")

    def run(batches):
        for batch, _, _ in K.blocks(batches, "_text"):
            at = batch.schema.get_field_index("_text")
            out, n_chunks, n_lines = batch.column(at).to_pylist(), [], []
            for i, (ks, hs) in enumerate(zip(batch.column("ks").to_pylist(), batch.column("hs").to_pylist(), strict=True)):
                cut = 0
                if ks and out[i] is None:
                    ks = None
                if ks:
                    d = np.frombuffer(out[i].encode("utf-8"), np.uint8)
                    s, e, lines, _, _ = chunk_spans(d, np.array([0, len(d)]))
                    ks = _wanted(ks, hs, _key(d, s, e, e == len(d))[0])
                    keep = np.ones(len(s), bool)
                    keep[ks] = False
                    raw = d.tobytes()
                    out[i] = b"".join(raw[x:y] for x, y in zip(s[keep].tolist(), e[keep].tolist())).decode("utf-8")
                    cut = int(lines[ks].sum())
                n_chunks.append(len(ks or ()))
                n_lines.append(cut)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(out, pa.string()), pa.array(n_chunks, pa.int32()), pa.array(n_lines, pa.int32())], ["_row", "_text", "n_chunks_removed", "n_lines_removed"])

    schema = joined.select("_row", "_text").withColumns({"n_chunks_removed": F.lit(0), "n_lines_removed": F.lit(0)}).schema
    cut = joined.select("_row", "_text", "ks", "hs").mapInArrow(run, schema)
    extra = {c: c if c not in names else f"{c}_" for c in ("n_chunks_removed", "n_lines_removed")}
    return cut.select(*(F.col("_text").alias(c) if c == text_col else F.col("_row")[c].alias(c) for c in names), *(F.col(c).alias(to) for c, to in extra.items()))
