"""Quality classifier: random-indexing word vectors, a two-layer network, calibrated by temperature.

A word has a sparse index vector of ``NONZERO`` signs drawn from its hash.  On a
bounded sample of labelled documents (``max_train`` rows, texts of up to
``max_train_bytes``) each frequent word also gets a context vector: the sum of
the index vectors of its neighbours.  A document is pooled over all its words
to the mean of the index vectors, the mean of the context vectors, and the
norms of both means with the log of its length.  A two-layer network in numpy
is trained on the pooled vectors and its logits are divided by a temperature
fitted on a part of the sample that the network has not seen.

Words are maximal runs of letters (bytes from 0x80 up count as letters), of
digits or of other signs; white space separates.  Only the text is an input.

Defined cases: a null or empty text pools to the zero vector and still gets a
score; without labels, or with one class only, the score is the share of label
1 (0.5 without labels); repeated rows get equal scores; other columns are
ignored.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

DIM = 64
NONZERO = 4
WINDOW = 2
HIDDEN = 32
VOCABULARY = 20_000
THRESHOLD = 0.7
MAX_TRAIN = 5000
MAX_TRAIN_BYTES = 65_536

_roll = K.roll(7)
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_kind = np.full(256, 3, np.uint8)
_kind[K.SPACE] = 0
_kind[48:58] = 2
_kind[65:91] = _kind[97:123] = 1
_kind[128:] = 1


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of each word of a block."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    kind = _kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    change = np.ones(len(data) + 1, bool)
    change[1:-1] = kind[1:] != kind[:-1]
    change |= edge
    cut = np.flatnonzero(change)
    s, e = cut[:-1], cut[1:]
    keep = kind[s] != 0
    s, e = s[keep], e[keep]
    p = _roll.prefix(data, _roll.table[_lower])
    return _roll.span(p, s, e), np.searchsorted(offs, s, side="right") - 1


def index_parts(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, sign) of the nonzero entries of each word's index vector, NONZERO columns."""
    k = np.arange(NONZERO, dtype=np.uint64)
    bits = (h[:, None] >> (k * np.uint64(12))).astype(np.int64)
    return bits & (DIM - 1), 1.0 - 2.0 * ((bits >> 8) & 1)


def index_sums(h: np.ndarray, group: np.ndarray, n: int, step: int = 100_000) -> np.ndarray:
    """The sum of index vectors by group."""
    out = np.zeros(n * DIM)
    for a in range(0, len(h), step):
        pos, sign = index_parts(h[a : a + step])
        at = (group[a : a + step, None] * DIM + pos).ravel()
        if len(out) > 8 * step:  # many groups: without an array of them for each step
            np.add.at(out, at, sign.ravel())
        else:
            out += np.bincount(at, sign.ravel(), len(out))
    return out.reshape(n, DIM)


class Vectors:
    """Context vectors of the sample's frequent words, sorted by hash."""

    def __init__(self, blocks: list[tuple[np.ndarray, np.ndarray]]):
        """From the (word hash, document) of blocks of whole documents; beside them, one block's arrays are held at a time."""
        each = [np.unique(h, return_counts=True) for h, _ in blocks]
        known, at = np.unique(np.concatenate([k for k, _ in each]), return_inverse=True)
        count = np.bincount(at, np.concatenate([n for _, n in each]), len(known)).astype(np.int64)
        often = np.flatnonzero(count >= 3)
        often = np.sort(often[np.argsort(-count[often], kind="stable")[:VOCABULARY]])
        self.hash = known[often]
        total = np.zeros((len(often), DIM))
        for h, doc in blocks if len(often) else ():
            word = np.searchsorted(self.hash, h)
            word[word == len(often)] = 0
            word[self.hash[word] != h] = -1
            for step in range(1, WINDOW + 1):
                same = doc[step:] == doc[:-step]
                for mine, other in ((slice(step, None), slice(None, -step)), (slice(None, -step), slice(step, None))):
                    ok = same & (word[mine] >= 0)
                    total += index_sums(h[other][ok], word[mine][ok], len(often))
        size = np.linalg.norm(total, axis=1, keepdims=True)
        self.vector = (total / np.maximum(size, 1e-9)).astype(np.float32)

    def pool(self, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Pooled vectors of ``n`` documents."""
        count = np.maximum(np.bincount(doc, minlength=n), 1)[:, None].astype(float)
        plain = index_sums(h, doc, n) / count
        ctx = np.zeros((n, DIM))
        if len(self.hash) and len(h):
            at = np.searchsorted(self.hash, h)
            at[at == len(self.hash)] = 0
            hit = np.flatnonzero(self.hash[at] == h)
            if len(hit):
                # equal words of a document are added once, with their count
                key, times = np.unique(doc[hit] * len(self.hash) + at[hit], return_counts=True)
                of = key // len(self.hash)
                for a in range(0, len(key), 200_000):
                    part = slice(a, a + 200_000)
                    rows = self.vector[key[part] % len(self.hash)] * times[part, None]
                    first = np.flatnonzero(np.diff(of[part], prepend=-1))
                    ctx[of[part][first]] += np.add.reduceat(rows, first, axis=0)
        ctx /= count
        extra = np.column_stack([np.linalg.norm(plain, axis=1), np.linalg.norm(ctx, axis=1), np.log(count[:, 0]) / 10])
        return np.hstack([plain, ctx, extra])


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Network:
    """Standardised input, one hidden layer of tanh units, one logit over a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 11, rounds: int = 60):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = (x - self.mean) / self.scale
        p = [rng.normal(0, 1 / np.sqrt(z.shape[1]), (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
        t = 0
        for _ in range(rounds):
            for rows in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
                a = np.tanh(z[rows] @ p[0] + p[1])
                g = (_sigmoid(a @ p[2] + p[3]) - y[rows]) / len(rows)
                back = np.outer(g, p[2]) * (1 - a * a)
                grads = [z[rows].T @ back + 1e-4 * p[0], back.sum(0), a.T @ g + 1e-4 * p[2], np.array([g.sum()])]
                t += 1
                for k, d in enumerate(grads):
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.999 * v[k] + 0.001 * d * d
                    p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        self.p, self.temperature = p, 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.tanh(z @ self.p[0] + self.p[1]) @ self.p[2] + self.p[3]

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least log loss."""
        z = self.logit(x)
        tries = np.exp(np.linspace(np.log(0.3), np.log(8), 60))
        loss = [-np.mean(np.log(np.where(y == 1, q, 1 - q) + 1e-9)) for q in (_sigmoid(z / t) for t in tries)]
        self.temperature = float(tries[int(np.argmin(loss))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logit(x) / self.temperature)


class Model:
    """Vectors and network; ``base`` where the sample can't train one."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.base = float(y.mean()) if len(y) else 0.5
        self.vectors = self.net = None
        if len(set(y.tolist())) < 2:
            return
        blocks = []
        for a in range(0, len(texts), 128):
            raw = [t.encode("utf-8") for t in texts[a : a + 128]]
            offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
            h, doc = words(np.frombuffer(b"".join(raw), np.uint8), offs)
            blocks.append((h, doc.astype(np.int16)))
        self.vectors = Vectors(blocks)
        x = np.vstack([self.vectors.pool(h, doc.astype(np.int64), min(128, len(texts) - 128 * k)) for k, (h, doc) in enumerate(blocks)])
        del blocks
        K.give_back()
        held = np.arange(len(y)) % 5 == 4
        if len(set(y[~held].tolist())) < 2:
            held[:] = False
        self.net = Network(x[~held], y[~held].astype(float))
        if held.any():
            self.net.calibrate(x[held], y[held])

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        n = len(offs) - 1
        if self.net is None:
            return np.full(n, self.base)
        h, doc = words(data, offs)
        return self.net.score(self.vectors.pool(h, doc, n))


def fold(doc_id: Column, parts: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def training_rows(docs: DataFrame, labels: DataFrame, label: str, parts: int, held: int, max_train: int, max_bytes: int) -> DataFrame:
    """(doc_id, text, y) of a bounded sample of the labelled rows outside the held-out fold, in the order of a hash."""
    lab = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where(f"_id is not null and y in (0, 1)").where(fold(F.col("_id"), parts) != held)
    lab = lab.groupBy("_id").agg(F.max("y").alias("y"))
    # twice the rows, as some are too long to train on; their ids are bounded by the limit, so they can be broadcast
    lab = lab.orderBy(F.xxhash64("_id"), "_id").limit(2 * max_train)
    src = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("string").alias("text"))
    rows = src.where(F.octet_length("text") <= max_bytes).join(F.broadcast(lab), "_id")
    return rows.dropDuplicates(["_id"]).orderBy(F.xxhash64("_id"), "_id").limit(max_train)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 4, held: int = 2, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """The driver holds the sample: at most ``max_train`` texts of at most ``max_bytes``."""
    rows = training_rows(docs, labels, label, parts, held, max_train, max_bytes).toPandas()
    return Model(rows.text.tolist(), rows.y.to_numpy(np.int64))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text; the model's size is bounded by the sample's vocabulary."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(held.value)
        for part, data, offs in K.blocks(batches, "_text"):
            s = m.score(data, offs)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["_id", "score", "predicted"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)


def keep(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores at least the threshold; all rows if there were not labels of both classes to learn from."""
    if model.net is None:
        return docs
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m = pickle.loads(held.value)
        for part, data, offs in K.blocks(batches, text_col):
            yield part.filter(pa.array(m.score(data, offs) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
