"""Byte-level BPE encoding and decoding without a regular expression.

The pre-tokeniser is an eight-state automaton over codepoint classes.  Its
transition functions compose associatively, so token starts are found by a
blocked parallel scan in numpy.  The byte slices between starts feed a cached
pair merge in rank order; token byte offsets are kept beside the ids and bound
each document's bytes when decoding.

Defined cases: a null or empty text has no ids and empty bytes; null ids of
documents are carried; a document never shares a token with its neighbour;
columns besides the id and the text are ignored, whatever they are called.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

# character classes
LETTER, NUMBER, OTHER, WHITE = 0, 1, 2, 3
# fixed values: code points with the White_Space property
WHITE_SPACE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# states: the kind of token that the character before belongs to
BREAK, IN_LETTER, IN_NUMBER, IN_OTHER, IN_WHITE, TAIL1, TAIL2, SPACED = range(8)
# symbols
S_LETTER, S_NUMBER, S_OTHER, S_WHITE, S_WHITE_LAST, S_SPACE_LAST, S_APOS1, S_APOS2 = range(8)
IDENTITY = 16


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) for symbol and state; symbols 8 to 15 are those at a document's start."""
    to = np.zeros((17, 8), np.uint8)
    new = np.zeros((17, 8), bool)
    for state in range(8):
        for sym in range(8):
            goes_on = {
                S_LETTER: {IN_LETTER: IN_LETTER, SPACED: IN_LETTER, TAIL1: BREAK, TAIL2: TAIL1},
                S_NUMBER: {IN_NUMBER: IN_NUMBER, SPACED: IN_NUMBER},
                S_OTHER: {IN_OTHER: IN_OTHER, SPACED: IN_OTHER},
                S_APOS1: {IN_OTHER: IN_OTHER, SPACED: IN_OTHER},
                S_APOS2: {IN_OTHER: IN_OTHER, SPACED: IN_OTHER},
                S_WHITE: {IN_WHITE: IN_WHITE},
            }.get(sym, {})
            fresh = {S_LETTER: IN_LETTER, S_NUMBER: IN_NUMBER, S_OTHER: IN_OTHER, S_APOS1: TAIL1, S_APOS2: TAIL2, S_WHITE: IN_WHITE, S_WHITE_LAST: BREAK, S_SPACE_LAST: SPACED}[sym]
            to[sym, state] = goes_on.get(state, fresh)
            new[sym, state] = state not in goes_on
            to[sym + 8, state] = fresh
            new[sym + 8, state] = True
        to[IDENTITY, state] = state
    return to, new


NEXT, STARTS = _automaton()
_classes: np.ndarray | None = None


def classes() -> np.ndarray:
    """The class of each code point, built once in a worker."""
    global _classes
    if _classes is None:
        kind = {"L": LETTER, "N": NUMBER}
        t = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        t[WHITE_SPACE] = WHITE
        _classes = t
    return _classes


def scan(symbols: np.ndarray, width: int = 64) -> np.ndarray:
    """The state before each symbol: transition functions of ``width`` symbols are composed
    side by side, the blocks' functions by doubling, and the entry states are run through the blocks."""
    n = len(symbols)
    m = -(-n // width)
    flat = NEXT.ravel()
    padded = np.full(m * width, IDENTITY, np.uint8)
    padded[:n] = symbols
    rows = np.ascontiguousarray(padded.reshape(m, width).T).astype(np.intp) << 3
    f = np.tile(np.arange(8, dtype=np.uint8), (m, 1))
    for row in rows:
        f = flat[row[:, None] + f]
    reach = 1
    while reach < m:
        g = f.copy()
        g[reach:] = np.take_along_axis(f[reach:], f[:-reach].astype(np.intp), 1)
        f, reach = g, reach * 2
    state = np.zeros(m, np.uint8)
    state[1:] = f[:-1, BREAK]
    out = np.empty((width, m), np.uint8)
    for t, row in enumerate(rows):
        out[t] = state
        state = flat[row + state]
    return np.ascontiguousarray(out.T).ravel()[:n]


def codepoints(data: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
    """(code points, byte offset of each and of the end); None where each is one byte."""
    if not len(data) or data.max() < 0x80:
        return data.astype(np.uint32), None
    cps = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    size = 1 + (cps >= 0x80).astype(np.int64) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.zeros(len(cps) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return cps, at


def token_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Byte offsets at which pre-tokens start."""
    if not len(data):
        return np.zeros(0, np.int64)
    cps, at = codepoints(data)
    n = len(cps)
    doc = offs if at is None else np.searchsorted(at, offs)
    first = np.zeros(n + 1, bool)
    first[doc] = True
    ends = first[1:]  # the last character of a document
    kind = classes()[cps]
    one = np.zeros(n, np.uint32)
    one[:-1] = cps[1:]
    one[ends] = 0
    two = np.zeros(n, np.uint32)
    two[:-1] = one[1:]
    two[ends] = 0
    sym = np.array([S_LETTER, S_NUMBER, S_OTHER, S_WHITE], np.uint8)[kind]
    follows = np.zeros(n, bool)
    follows[:-1] = kind[1:] != WHITE
    last = (kind == WHITE) & follows & ~ends
    sym[last] = S_WHITE_LAST
    sym[last & (cps == 0x20)] = S_SPACE_LAST
    quote = np.flatnonzero(cps == 0x27)
    if len(quote):
        a, b = one[quote], two[quote]
        # fixed values: the endings that stand alone after an apostrophe
        short = np.isin(a, [ord(c) for c in "stmd"])
        long = ((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l")))
        sym[quote[short]] = S_APOS1
        sym[quote[long]] = S_APOS2
    sym[first[:n]] += 8
    state = scan(sym)
    starts = np.flatnonzero(STARTS.ravel()[(sym.astype(np.intp) << 3) + state])
    return starts if at is None else at[starts]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the adjacent pair of least rank, leftmost first, until none is left; O(n log n)."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n < 40:
        parts = [piece[i : i + 1] for i in range(n)]
        while len(parts) > 1:
            best, where = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, where = r, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ranks[p] for p in parts]
    end = list(range(1, n + 1))
    prev = list(range(-1, n - 1))
    alive = [True] * n
    heap = []

    def offer(i: int) -> None:
        j = end[i]
        if j < n:
            r = ranks.get(piece[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[j]))

    for i in range(n):
        offer(i)
    while heap:
        r, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        alive[j] = False
        end[i] = stop
        if stop < n:
            prev[stop] = i
        offer(i)
        if prev[i] >= 0:
            offer(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Cache(dict):
    """Piece to its ids as little-endian bytes; emptied when full, so its memory is bounded."""

    def __init__(self, ranks: dict[bytes, int], most: int = 400_000):
        super().__init__()
        self.ranks, self.most = ranks, most

    def __missing__(self, piece: bytes) -> bytes:
        out = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out


_loaded: dict[str, tuple] = {}


def _vocabulary(path: str):
    if path not in _loaded:
        ranks = load_ranks(path)
        by_id = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            by_id[v] = k
        _loaded[path] = (Cache(ranks), by_id, np.array([len(x) for x in by_id], np.int64))
    return _loaded[path]


ENCODED = pa.schema([("ids", pa.binary()), ("offsets", pa.binary())])


def encode(df: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, offsets): ids and the byte offset after each token, both as little-endian 32-bit integers."""

    def run(batches):
        cache, _, length = _vocabulary(rank_path)
        for part, data, offs in K.blocks(batches, "_text"):
            starts = token_starts(data, offs)
            raw = data.tobytes()
            edges = [*starts.tolist(), len(raw)]
            pieces = [cache[raw[a:b]] for a, b in zip(edges, edges[1:])]
            at = np.searchsorted(starts, offs).tolist()
            ids_out, off_out = [], []
            for i in range(part.num_rows):
                ids = b"".join(pieces[at[i] : at[i + 1]])
                ids_out.append(ids)
                off_out.append(np.cumsum(length[np.frombuffer(ids, "<u4")]).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(ids_out, pa.binary()), pa.array(off_out, pa.binary())], ["_id", "ids", "offsets"])

    src = df.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids binary, offsets binary").withColumnRenamed("_id", id_col)


def decode(df: DataFrame, rank_path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the bytes of the ids; the last kept offset must be their length."""

    def run(batches):
        _, by_id, _ = _vocabulary(rank_path)
        # some hundred documents at a time
        for batch in (b.slice(a, 256) for b in batches for a in range(0, b.num_rows, 256)):
            out = []
            for ids, ends in zip(batch.column("ids").to_pylist(), batch.column("offsets").to_pylist()):
                text = b"".join([by_id[i] for i in np.frombuffer(ids, "<u4").tolist()])
                if ends and int.from_bytes(ends[-4:], "little") != len(text):
                    raise ValueError("the kept offsets do not fit the decoded bytes")
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("ids"), pa.array(out, pa.binary())], ["_id", "ids", "decoded"])

    src = df.select(F.col(id_col).alias("_id"), "ids", "offsets")
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, ids binary, decoded binary").withColumnRenamed("_id", id_col)
