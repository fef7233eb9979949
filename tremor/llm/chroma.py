"""Chroma audio fingerprints of a media column, and their alignment.

A recording is a WAV file (PCM, 16 bits, one channel) in a binary column.  Its
power spectrum is folded into twelve pitch classes for each frame; an integral
image over time and pitch class gives any rectangle's energy in four reads.
Sixteen filters compare rectangles; each log ratio is quantised to two bits in
Gray code, and the bits are packed into one 32-bit integer for each position.

Recordings with equal integers form a class.  Queries (ids divisible by 20) are
matched against one recording of each class, in blocks.  For each pair, an offset
histogram sums the bit errors of sampled positions (two of every ``STEP``) at
every second offset with enough overlap; offsets whose mean is at most ``COARSE``
bits are aligned, with their neighbours, over all bits, and the share of
differing bits over the overlap decides.  The samples can miss an alignment close
to ``MAX_ERROR``: the README gives the recall against all offsets and bits.

Defined cases: a null, empty, unreadable or too short recording has an empty
fingerprint, which is a class by itself for each recording and matches nothing;
equal ids are one recording of the least fingerprint; a null id is a recording of
no class that matches nothing; ties go to the least id
and then the least offset; other columns are ignored.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

RATE = 5512
FRAME = 2048
HOP = 512
SPAN = 12  # frames under a filter
LOW, HIGH = 60.0, 2600.0
MIN_OVERLAP = 16
MAX_ERROR = 0.25
GAP, STEP, OFFSET_STEP = 4, 8, 2
COARSE = 10.5
QUERY_EVERY = 20
QUERY_BLOCK = 2048
ROW_BLOCK = 4096
PAIRS_AT_ONCE = 1 << 17


def filters() -> list[tuple[int, int, int, int, float]]:
    """(kind, first pitch class, height, frames, quantiser width) of sixteen filters, by rule."""
    out = []
    for k in range(16):
        kind = k % 4
        height = (3, 4, 6, 12)[(k // 4 + kind) % 4]
        out.append((kind, (5 * k) % (12 - height + 1), height, (SPAN, 8, 6, 4)[k // 4], 0.25 if kind else 0.15))
    return out


FILTERS = filters()
_bins = np.fft.rfftfreq(FRAME, 1 / RATE)
_used = np.flatnonzero((_bins >= LOW) & (_bins <= HIGH))
_pitch = np.zeros((len(_used), 12), np.float32)
_pitch[np.arange(len(_used)), np.round(12 * np.log2(_bins[_used] / 440.0)).astype(int) % 12] = 1
_window = np.hanning(FRAME).astype(np.float32)


def read_wav(blob: bytes | None) -> np.ndarray:
    try:
        with wave.open(io.BytesIO(blob or b"")) as f:
            if f.getnchannels() != 1 or f.getsampwidth() != 2:
                return np.zeros(0, np.float32)
            return np.frombuffer(f.readframes(f.getnframes()), "<i2").astype(np.float32) / 32768
    except (wave.Error, EOFError):
        return np.zeros(0, np.float32)


def write_wav(samples: np.ndarray) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(RATE)
        f.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def chroma(samples: np.ndarray) -> np.ndarray:
    """(frames, 12) energies, each frame scaled to length 1."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * _window
    power = np.abs(np.fft.rfft(frames, axis=1)[:, _used]).astype(np.float32) ** 2
    c = power @ _pitch
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-6)


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Packed integers, one for each position with SPAN frames."""
    c = chroma(samples)
    n = len(c) - SPAN + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    image = np.zeros((len(c) + 1, 13))
    image[1:, 1:] = np.cumsum(np.cumsum(c, 0), 1)
    t = np.arange(n)

    def area(t0, t1, y0, y1):
        return image[t + t1, y1] - image[t + t0, y1] - image[t + t1, y0] + image[t + t0, y0]

    out = np.zeros(n, np.uint32)
    for kind, y, h, w, width in FILTERS:
        half_w, half_h = w // 2, h // 2
        if kind == 0:  # all against the rest of the frame
            a, b = area(0, w, y, y + h), area(0, w, 0, 12) * h / 12
        elif kind == 1:  # upper against lower
            a, b = area(0, w, y + half_h, y + h) / (h - half_h), area(0, w, y, y + half_h) / half_h
        elif kind == 2:  # later against earlier
            a, b = area(half_w, w, y, y + h), area(0, half_w, y, y + h)
        else:  # one diagonal against the other
            a = area(0, half_w, y, y + half_h) + area(half_w, w, y + half_h, y + h)
            b = area(0, half_w, y + half_h, y + h) + area(half_w, w, y, y + half_h)
        r = np.log1p(np.maximum(a, 0)) - np.log1p(np.maximum(b, 0))
        q = (r > -width).astype(np.uint32) + (r > 0) + (r > width)
        out = (out << np.uint32(2)) | (q ^ (q >> 1)).astype(np.uint32)
    return out


def bit_errors(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.bitwise_count(a ^ b).sum()) / (32 * len(a))


def align(q: np.ndarray, r: np.ndarray, offset: int) -> tuple[float, int]:
    """(share of differing bits, overlap) when r's position is q's plus ``offset``."""
    a, b = max(0, -offset), max(0, offset)
    n = min(len(q) - a, len(r) - b)
    return (bit_errors(q[a : a + n], r[b : b + n]), n) if n > 0 else (1.0, 0)


def fingerprints(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, fp): the integers as little-endian bytes."""

    def run(batches):
        for batch in batches:
            out = [fingerprint(read_wav(x.as_py())).astype("<u4").tobytes() for x in batch.column("_media")]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(out, pa.binary())], ["_id", "fp"])

    src = df.select(F.col(id_col).cast("long").alias("_id"), F.col(media_col).alias("_media"))
    return src.mapInArrow(run, "_id bigint, fp binary")


def _paired(fps: np.ndarray) -> np.ndarray:
    """(positions, recordings): a position's integer beside the one GAP later, in 64 bits."""
    return np.ascontiguousarray((fps[:, :-GAP].astype(np.uint64) << np.uint64(32) | fps[:, GAP:]).T)


def candidates(q: np.ndarray, r: np.ndarray):
    """(query, recording, offset) arrays, some offsets at a time, whose sampled positions differ in few bits.

    ``q`` and ``r`` are (recordings, positions) of one length each.
    """
    if min(q.shape[1], r.shape[1]) < MIN_OVERLAP:
        return
    qp, rp = _paired(q), _paired(r)
    samples = np.arange(0, len(qp), STEP)
    for offset in range(MIN_OVERLAP - q.shape[1], r.shape[1] - MIN_OVERLAP + 1, OFFSET_STEP):
        at = samples[(samples + offset >= 0) & (samples + offset < len(rp))]
        if not len(at):  # an overlap that no sample falls into
            at = np.array([max(0, -offset)])
        errors = np.zeros((len(q), len(r)), np.uint16)
        for t in at.tolist():
            errors += np.bitwise_count(qp[t][:, None] ^ rp[t + offset][None, :])
        i, j = np.nonzero(errors <= 2 * COARSE * len(at))
        if len(i):
            yield i, j, offset


def alignments(q: np.ndarray, r: np.ndarray):
    """(query, recording, offset, error, overlap) arrays of alignments with enough overlap and few enough differing bits."""
    for i, j, near in candidates(q, r):
        for offset in range(near - OFFSET_STEP // 2, near + OFFSET_STEP // 2 + 1):
            a, b = max(0, -offset), max(0, offset)
            n = min(q.shape[1] - a, r.shape[1] - b)
            if n < MIN_OVERLAP:
                continue
            error = np.bitwise_count(q[i, a : a + n] ^ r[j, b : b + n]).sum(1, dtype=np.int64) / (32 * n)
            hit = np.flatnonzero(error <= MAX_ERROR)
            if len(hit):
                yield i[hit], j[hit], np.full(len(hit), offset), error[hit], np.full(len(hit), n)


def by_length(fps: list[np.ndarray]):
    """(places, matrix) of the fingerprints of each length that can have enough overlap."""
    size = np.array([len(f) for f in fps], np.int64)
    for n in np.unique(size).tolist():
        if n >= MIN_OVERLAP:
            at = np.flatnonzero(size == n)
            yield at, np.stack([fps[k] for k in at.tolist()]).astype(np.uint32)


def best_matches(q_ids: np.ndarray, q_fps: list[np.ndarray], r_ids: np.ndarray, r_fps: list[np.ndarray]) -> pd.DataFrame:
    """(class_id, n, error, other, offset): how many recordings match each query, and the best alignment."""
    found = []
    for q_at, q in by_length(q_fps):
        for r_at, r in by_length(r_fps):
            step = max(1, PAIRS_AT_ONCE // len(q_at))
            for a in range(0, len(r_at), step):
                for i, j, offset, error, _ in alignments(q, r[a : a + step]):
                    found.append((q_ids[q_at[i]], r_ids[r_at[a + j]], offset, error))
    cols = [np.concatenate([f[k] for f in found]) if found else np.zeros(0) for k in range(4)]
    t = pd.DataFrame({"class_id": cols[0], "other": cols[1], "offset": cols[2], "error": cols[3]}).astype({"class_id": "int64", "other": "int64", "offset": "int64", "error": "float64"})
    t = t[t.class_id != t.other].sort_values(["class_id", "error", "other", "offset"])
    count = t.groupby("class_id").other.nunique()
    best = t.drop_duplicates("class_id").set_index("class_id")
    return best.assign(n=count).reset_index()[["class_id", "n", "error", "other", "offset"]]


def match(df: DataFrame, id_col: str = "vec_id", media_col: str = "media", every: int = QUERY_EVERY) -> DataFrame:
    """(id, class_id, n_frames, is_query, n_matches, best_id, best_offset, bit_error), one row for each recording.

    A query's matches are counted over classes other than its own; a match's id is its class id.
    """
    fp = fingerprints(df.where(F.col(id_col).isNotNull()), id_col, media_col).groupBy("_id").agg(F.min("fp").alias("fp"))
    # empty fingerprints equal no other
    fp = fp.withColumn("own", F.when(F.octet_length("fp") == 0, F.col("_id")))
    fp = K.materialise(fp.withColumns({"h1": F.xxhash64("fp", "own"), "h2": F.xxhash64(F.lit(3), "fp", "own")}), "fingerprints")
    cls = K.materialise(fp.groupBy("h1", "h2").agg(F.min("_id").alias("class_id"), F.max(F.col("_id") % every == 0).alias("asked"), F.first("fp").alias("fp")), "recordings")
    named = fp.select("_id", "h1", "h2", (F.octet_length("fp") / 4).cast("long").alias("n_frames")).join(cls.select("h1", "h2", "class_id"), ["h1", "h2"])
    known = cls.where(F.octet_length("fp") > 0)
    # the stated query set, in blocks of bounded size, against all rows in blocks of bounded size
    asked = known.where("asked").count()
    n_q, n_r = -(-max(asked, 1) // QUERY_BLOCK), -(-max(known.count(), 1) // ROW_BLOCK)
    q = known.where("asked").select(F.pmod(F.xxhash64("class_id"), F.lit(n_q)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_r - 1).cast("long"))).alias("rb"), "class_id", "fp")
    r = known.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("class_id", F.lit(5)), F.lit(n_r)).alias("rb"), "class_id", "fp")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        fps = [[np.frombuffer(x, "<u4") for x in side.fp] for side in (left, right)]
        return best_matches(left.class_id.to_numpy(), fps[0], right.class_id.to_numpy(), fps[1])

    hit = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(run, "class_id bigint, n bigint, error double, other bigint, offset bigint")
    hit = hit.groupBy("class_id").agg(F.sum("n").alias("n"), F.min(F.struct("error", "other", "offset")).alias("b"))
    out = named.join(hit, "class_id", "left")
    is_query = F.col("_id") % every == 0
    pick = lambda c: F.when(is_query, c)
    out = out.select(F.col("_id").alias(id_col), "class_id", "n_frames", is_query.alias("is_query"), pick(F.coalesce("n", F.lit(0))).alias("n_matches"), pick(F.col("b.other")).alias("best_id"), pick(F.col("b.offset")).alias("best_offset"), pick(F.round("b.error", 6)).alias("bit_error"))
    lost = fingerprints(df.where(F.col(id_col).isNull()), id_col, media_col)
    none = {"n_frames": (F.octet_length("fp") / 4).cast("long"), "is_query": F.lit(False)}
    return out.unionByName(lost.select(*(none.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in out.schema)))


def render(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, media): each vector as a tune, one note of HOP samples for each entry, in a WAV file.

    The tables hold no recordings; this makes some from them, in which near
    vectors are near tunes.
    """

    def tune(v) -> bytes | None:
        if v is None or not len(v):
            return None
        x = np.nan_to_num(np.asarray(v, float))
        note = 69 + np.clip(np.round(x * 48), -18, 18)
        step = np.repeat(2 * np.pi * 440.0 * 2 ** ((note - 69) / 12) / RATE, HOP)
        # two notes at each end let the first and last fill whole frames
        phase = np.cumsum(np.concatenate([step[: 2 * HOP], step, step[-2 * HOP :]]))
        return write_wav(0.6 * np.sin(phase) + 0.2 * np.sin(2 * phase))

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 256):  # some ten megabytes of sound at a time
                part = batch.slice(a, 256)
                yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array([tune(v) for v in part.column("_v").to_pylist()], pa.binary())], ["_id", "media"])

    src = vectors.select(F.col(id_col).cast("long").alias("_id"), F.col(vector_col).alias("_v"))
    return src.mapInArrow(run, "_id bigint, media binary").withColumnRenamed("_id", id_col)
