"""Lexical retrieval packing: neighbours by BM25 fill each seed document's window.

1. Documents are tokenised once.  How many documents hold a term, the number of
   documents and their mean length are counted over all of them.
2. The index is sharded by content: a document's key is the two least hashes
   among its ``ROUTE_TERMS`` strongest BM25 terms that some other document has.
   A range sort on the keys puts documents with common strong terms side by
   side, and a shard is a run of ``shard_docs`` documents (or ``shard_tokens``
   tokens) of a sorted part; ties are ordered by a hash of id and text, so one
   frequent key is spread over as many shards as it needs.
3. A shard is an inverted index with the corpus' statistics.  Whole windows of a
   long document become sequences of their own; what is left of it is an item.
   The longest unused item seeds a window, its ``QUERY_TERMS`` strongest terms
   retrieve unused neighbours, those that fit are placed by rank, and the best
   that doesn't fit is cut to fill the window exactly.  What doesn't fill a window
   goes on to the next shard; that of a part's last shard is laid out as
   sequences of powers of two.

Defined cases: a null or empty text has only the closing id; repeated rows are
separate documents; ties in the score go to the earlier item; columns besides
the id and the text are ignored.
"""

from __future__ import annotations

import struct
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

WINDOW = 2048
END_ID = 1
K1, B = 1.2, 0.75
QUERY_TERMS = 24
NEIGHBOURS = 24
ROUTE_TERMS = 12
TERMS = 1 << 16  # ids of the vocabulary fit into 16 bits

# fixed value: the split of the vocabulary file's pre-tokeniser
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def _byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return [chr(b) if b in own else chr(256 + rest.index(b)) for b in range(256)]


class WordTokenizer:
    """Ids of a text as the library gives them, through a cache of white-space words.

    No token of this vocabulary crosses white space, so a word's ids do not
    depend on its neighbours.  Texts with characters on which Python and the
    library differ about white space or composition go to the library whole.
    """

    ODD = regex.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x85\xa0İ]|[^\u0000-ɏ‐-‧€]")

    def __init__(self, path: str, most: int = 900_000):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.model = self.tok.model
        self.alphabet = _byte_alphabet()
        #: ids of words and of their pieces: a piece by itself is a word of one piece
        self.known = _Known(self.word)
        self.most = most

    def piece(self, p: str) -> bytes:
        out = self.known.get(p)
        if out is None:
            # the library's merges: those of this vocabulary in Python took nearly thrice as long
            s = p if p.isascii() and p.isalpha() else "".join([self.alphabet[b] for b in p.encode("utf-8")])
            ids = [t.id for t in self.model.tokenize(s)]
            out = struct.pack(f"<{len(ids)}I", *ids)
            # a full cache stays as it is: frequent pieces come first
            if len(self.known) < self.most and len(p) <= 64:
                self.known[p] = out
        return out

    def word(self, w: str) -> bytes:
        low = (w if w.isascii() else unicodedata.normalize("NFC", w)).lower()
        if low.isalpha():
            out = self.piece(low)
        elif low[-1] in ".," and low[:-1].isalpha():
            out = self.piece(low[:-1]) + self.piece(low[-1])
        else:
            out = b"".join([self.piece(p) for p in SPLIT.findall(low)])
        if len(self.known) < self.most and len(w) <= 64:
            self.known[w] = out
        return out

    def ids(self, text: str, plain: bool = False) -> np.ndarray:
        """``plain``: the text is known to have no byte marked in UNSURE."""
        if not plain and self.ODD.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        return np.frombuffer(b"".join(map(self.known.__getitem__, text.split())), "<u4")


class _Known(dict):
    """Ids by word; a word that isn't there is asked for."""

    def __init__(self, word):
        self.word = word

    def __missing__(self, w: str) -> bytes:
        return self.word(w)


#: bytes of a text that may have characters for the library: controls, and all beyond those of U+00C0 to U+00FF
UNSURE = np.zeros(256, bool)
UNSURE[[*range(9), 0x0B, 0x0C, *range(0x0E, 0x20), 0xC2, *range(0xC4, 0x100)]] = True


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


class Statistics:
    """Documents, mean length and documents of each term, over the whole corpus."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray):
        self.mean = max(1.0, tokens / max(1, documents))
        self.df = df
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5)).astype(np.float64)

    @classmethod
    def of(cls, tokens: list[np.ndarray]) -> Statistics:
        """Those of a corpus in memory."""
        df = np.zeros(TERMS, np.int64)
        for t in tokens:
            df[np.unique(t)] += 1
        return cls(len(tokens), sum(map(len, tokens)), df)


def weights(tokens: list[np.ndarray], stats: Statistics):
    """(document, term, BM25 weight) of the distinct terms of each document, by term."""
    size = np.array([len(t) for t in tokens], np.int64)
    doc = np.repeat(np.arange(len(tokens), dtype=np.int64), size)
    key, tf = np.unique(np.concatenate(tokens).astype(np.int64) * max(1, len(tokens)) + doc if len(tokens) else doc, return_counts=True)
    term, doc = key // max(1, len(tokens)), key % max(1, len(tokens))
    norm = K1 * (1 - B + B * size / stats.mean)
    return doc, term, stats.idf[term] * tf * (K1 + 1) / (tf + norm[doc])


def route(tokens: list[np.ndarray], stats: Statistics) -> np.ndarray:
    """Two keys for each document: the least hashes of its strongest terms that another document has, 0 without any."""
    size = np.array([len(t) for t in tokens], np.int64)
    sort = [np.sort(t, kind="stable") for t in tokens]  # 16-bit ids: by radix
    term = np.concatenate(sort) if sort else np.zeros(0, "<u2")
    edge = np.ones(len(term), bool)
    edge[1:] = term[1:] != term[:-1]
    ends = np.cumsum(size)
    edge[(ends - size)[size > 0]] = True
    at = np.flatnonzero(edge)
    term, tf, doc = term[at], np.diff(at, append=len(term)), np.repeat(np.arange(len(tokens)), size)[at]
    norm = K1 * (1 - B + B * size / stats.mean)
    shared = stats.df[term] > 1
    doc, term, tf = doc[shared], term[shared].astype(np.int64), tf[shared]
    weight = stats.idf[term] * tf * (K1 + 1) / (tf + norm[doc])
    # only a document's strongest, and what equals the last of them, are put in order
    least = np.zeros(len(tokens))
    first = np.searchsorted(doc, np.arange(len(tokens) + 1)).tolist()
    for d, (i, j) in enumerate(zip(first, first[1:])):
        if j - i > ROUTE_TERMS:
            least[d] = np.partition(weight[i:j], j - i - ROUTE_TERMS)[j - i - ROUTE_TERMS]
    strong = weight >= least[doc]
    doc, term, weight = doc[strong], term[strong], weight[strong]
    order = np.lexsort((term, -weight, doc))
    doc, term = doc[order], term[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    doc, term = doc[rank < ROUTE_TERMS], term[rank < ROUTE_TERMS]
    out = np.zeros((len(tokens), 2), np.uint64)
    h = K.mix(term.astype(np.uint64) + np.uint64(1))
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    rank = np.arange(len(doc)) - np.searchsorted(doc, doc)
    for k in (0, 1):
        out[doc[rank == k], k] = h[rank == k]
    return out


class Index:
    """BM25 over the items of a shard."""

    def __init__(self, tokens: list[np.ndarray], stats: Statistics):
        n = len(tokens)
        self.doc, term, self.weight = weights(tokens, stats)
        here = np.bincount(term) if len(term) else np.zeros(1, np.int64)
        self.first = np.zeros(len(here) + 1, np.int64)
        np.cumsum(here, out=self.first[1:])
        # a query is an item's strongest terms that some other item has
        self.n = n
        shared = np.flatnonzero(here[term] > 1)
        by_doc = shared[np.lexsort((-self.weight[shared], self.doc[shared]))]
        self.by_term, self.query_at = term[by_doc], np.searchsorted(self.doc[by_doc], np.arange(n + 1))

    def neighbours(self, item: int, unused: np.ndarray) -> np.ndarray:
        terms = self.by_term[self.query_at[item] : min(self.query_at[item + 1], self.query_at[item] + QUERY_TERMS)]
        if not len(terms):
            return terms
        slices = [slice(self.first[t], self.first[t + 1]) for t in terms.tolist()]
        score = np.bincount(np.concatenate([self.doc[s] for s in slices]), np.concatenate([self.weight[s] for s in slices]), self.n)
        score[~unused] = 0
        most = min(NEIGHBOURS, self.n)
        top = np.argpartition(-score, most - 1)[:most]
        top = top[score[top] > 0]
        return top[np.lexsort((top, -score[top]))]


def powers(length: int) -> list[int]:
    """The powers of two, largest first, that sum to ``length``."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


def pack_shard(tokens: list[np.ndarray], stats: Statistics, begin: list[int] | None = None, window: int = WINDOW):
    """(sequences, rest): full sequences of (document, start, length) pieces, and the pieces of an unfilled window.

    A document goes in from its ``begin`` on; a piece of the rest reaches to its document's end.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    start = np.array(begin, np.int64) if begin else np.zeros(len(tokens), np.int64)
    size = np.array([len(t) for t in tokens], np.int64)
    for d in np.flatnonzero(size - start >= window).tolist():
        for _ in range(int(size[d] - start[d]) // window):
            sequences.append([(d, int(start[d]), window)])
            start[d] += window
    left = size - start
    items = np.flatnonzero(left > 0)
    if not len(items):
        return sequences, []
    index = Index([tokens[d][start[d] :] for d in items.tolist()], stats)
    start, left = start[items], left[items]
    unused = np.ones(len(items), bool)
    order = np.lexsort((items, -left)).tolist()
    at, room, current = 0, window, []

    def place(i: int, length: int) -> None:
        nonlocal room
        current.append((int(items[i]), int(start[i]), length))
        start[i] += length
        left[i] -= length
        room -= length
        if not left[i]:
            unused[i] = False

    while True:
        while at < len(order) and not unused[order[at]]:
            at += 1
        if at == len(order):
            break
        seed = order[at]
        if left[seed] <= room:
            place(seed, int(left[seed]))
        else:
            place(seed, room)
        while room:
            near = index.neighbours(seed, unused).tolist()
            for i in near:
                if left[i] <= room:
                    place(i, int(left[i]))
            cut = next((i for i in near if unused[i]), None)
            if room and cut is not None:
                place(cut, room)
            if not near:
                while at < len(order) and not unused[order[at]]:
                    at += 1
                if at == len(order):
                    break
                i = order[at]
                place(i, min(room, int(left[i])))
        if room:
            break
        sequences.append(current)
        current, room = [], window
    return sequences, current


def tail(pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """Lay the pieces of an unfilled window out as sequences of powers of two, without padding."""
    out, todo = [], [*reversed(pieces)]
    for room in powers(sum(p[2] for p in pieces)):
        own = []
        while room:
            d, s, n = todo.pop()
            take = min(n, room)
            own.append((d, s, take))
            room -= take
            if take < n:
                todo.append((d, s + take, n - take))
        out.append(own)
    return out


def tokenise(df: DataFrame, vocabulary: str, id_col: str, text_col: str) -> DataFrame:
    """(_id, at, ids): the ids of each document as 16-bit integers; ``at`` tells equal rows apart by id and text.

    A row with a null ``ids`` has the ``df`` of a task's documents instead, with their number and their tokens.
    """
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    src = df.select(F.col(id_col).alias("_id"), body.alias("_text"), F.xxhash64(F.col(id_col), body).alias("at"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches):
        tok = tokenizer(vocabulary)
        df, documents, total, names = np.zeros(TERMS, np.int64), 0, 0, None
        for part, data, offs in K.blocks(batches, "_text"):
            names = part.schema.field("_id").type
            unsure = np.zeros(part.num_rows, bool)
            unsure[np.searchsorted(offs, np.flatnonzero(UNSURE[data]), side="right") - 1] = True
            at, raw = offs.tolist(), data.tobytes()
            out = []
            for i in range(part.num_rows):
                ids = tok.ids(raw[at[i] : at[i + 1]].decode("utf-8"), not unsure[i])
                t = np.empty(len(ids) + 1, "<u2")
                t[:-1], t[-1] = ids, END_ID
                terms = np.sort(t, kind="stable")  # by radix
                df[terms[:-1][terms[1:] != terms[:-1]]] += 1
                df[terms[-1]] += 1
                total += len(t)
                out.append(t.tobytes())
            documents += part.num_rows
            none = pa.nulls(part.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("_id"), part.column("at"), pa.array(out, pa.binary()), none], ["_id", "at", "ids", "df"])
        if documents:
            counted = np.concatenate([df, [documents, total]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, names), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counted], pa.binary())], ["_id", "at", "ids", "df"])

    return src.mapInArrow(run, f"_id {kind}, at bigint, ids binary, df binary")


def statistics(tokens: DataFrame) -> Statistics:
    """Summed over the tasks' counts: what reaches the driver is bounded by the vocabulary."""

    def run(batches):
        total = np.zeros(TERMS + 2, np.int64)
        for batch in batches:
            for x in batch.column("df").to_pylist():
                total += np.frombuffer(x, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["term", "n"])

    rows = tokens.where("df is not null").select("df").mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(TERMS + 2, np.int64)
    df[rows.term.to_numpy(np.int64)] = rows.n.to_numpy(np.int64)
    return Statistics(int(df[TERMS]), int(df[TERMS + 1]), df[:TERMS])


def routed(tokens: DataFrame, stats: Statistics) -> DataFrame:
    """The tokenised documents in the order of their keys, in parts."""

    def run(batches):
        for part, data, offs in blocks_of_ids(batches):
            ids = [data[a:b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
            key = K.signed(route(ids, stats))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("_id", "at", "ids")), pa.array(key[:, 0]), pa.array(key[:, 1])], ["_id", "at", "ids", "h1", "h2"])

    kind = tokens.schema["_id"].dataType.simpleString()
    rows = tokens.where("ids is not null").select("_id", "at", "ids").mapInArrow(run, f"_id {kind}, at bigint, ids binary, h1 bigint, h2 bigint")
    return rows.repartitionByRange("h1", "h2", "at").sortWithinPartitions("h1", "h2", "at")


def blocks_of_ids(batches, limit: int = 2 * K.BLOCK_BYTES):
    """(batch slice, ids, offsets) of whole documents, a bounded number of bytes at a time."""
    for batch in batches:
        column = batch.column("ids")
        if not batch.num_rows:
            continue
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        for a, b in K.cut_rows(at, limit):
            yield batch.slice(a, b - a), raw[at[a] : at[b]].view("<u2"), (at[a : b + 1] - at[a]) // 2


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, shard_docs: int = 2048, shard_tokens: int = 1_000_000) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): ids as little-endian 32-bit integers."""
    tokens = K.materialise(tokenise(df, vocabulary, id_col, text_col), "tokens")
    stats = statistics(tokens)
    kind = tokens.schema["_id"].dataType.simpleString()

    def run(batches):
        sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 36
        id_type = pa.int64()

        def rows(sequences, names, ids):
            nonlocal sequence
            cols = [[] for _ in range(7)]
            for pieces in sequences:
                offset = 0
                for d, s, n in pieces:
                    for c, v in zip(cols, (names[d], s, n, ids[d][s : s + n].astype("<u4").tobytes(), len(ids[d]), sequence, offset)):
                        c.append(v)
                    offset += n
                sequence += 1
            kinds = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            for a in range(0, len(cols[0]), 5000):
                yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 5000], k) for c, k in zip(cols, kinds)], ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        names, ids, begin, held = [], [], [], 0
        for part, data, offs in blocks_of_ids(batches):
            id_type = part.schema.field("_id").type
            at = offs.tolist()
            for i, name in enumerate(part.column("_id").to_pylist()):
                names.append(name)
                ids.append(data[at[i] : at[i + 1]].copy())
                begin.append(0)
                held += at[i + 1] - at[i]
                if len(ids) >= shard_docs or held >= shard_tokens:
                    sequences, rest = pack_shard(ids, stats, begin, window)
                    yield from rows(sequences, names, ids)
                    names, ids, begin = [names[d] for d, _, _ in rest], [ids[d] for d, _, _ in rest], [s for _, s, _ in rest]
                    held = sum(n for _, _, n in rest)
        if ids:
            sequences, rest = pack_shard(ids, stats, begin, window)
            yield from rows(sequences + tail(rest), names, ids)
        K.give_back()

    schema = f"_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return routed(tokens, stats).select("_id", "ids").mapInArrow(run, schema).withColumnRenamed("_id", id_col)
