"""Toxicity after noisy-channel deobfuscation.

1. A character trigram model is counted over every text of the corpus, task by
   task, and summed; its size is bounded by the alphabet, not by the corpus.
2. Spans that may be disguised (any word with a sign or digit that resembles a
   letter, or with a letter twice in a row; four or more letters or such signs
   that stand alone, up to three separators apart) become lattices: each sign
   stands for nothing or the letters it resembles, separators vanish, a run of a
   letter may be one or two.  Exact Viterbi decoding of the whole span under the
   trigram model decides; a cache holds the short spans already decoded.
3. Words and word beginnings that mark toxic documents are selected from a
   bounded sample of labelled rows: each must explain toxic documents that
   those before it do not, by more than chance among all candidates.  The
   restored text and the plain text are matched against them by an automaton,
   and a noisy-or of their precisions is the score.

Letters of all scripts make words; those beyond U+017F share one class of the
trigram model.

Defined cases: a null or empty text scores as a text without any mark; without
labels of both classes the score is the share of label 1 (0 without labels);
repeated rows score alike; other columns are ignored.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K
from tremor.llm.quality import training_rows

THRESHOLD = 0.7
MAX_TRAIN = 6000
MAX_TRAIN_BYTES = 65_536
MARKS = 2000  # at most so many selected words and beginnings
ALONE = 4  # so many letters in a row that stand alone are read as a word

# fixed values: what a sign can stand for
LOOKALIKE = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "+": "t", "|": "il", "€": "e"}

ALPHABET = 256
LETTERS = [c for c in range(0x180) if chr(c).isalpha() and chr(c) == chr(c).lower()][: ALPHABET - 2]
OTHER = len(LETTERS) + 1  # the class of all letters beyond
SIZE = OTHER + 1
CODES = 0x30000  # beyond lie no letters but some rare ideographs

_letter = np.full(CODES + 1, 0x20, np.uint32)  # the lower-case letter of a code point, else a space
for _c in range(CODES):
    if (_l := chr(_c)).isalpha():
        _letter[_c] = ord(_l.lower()[0])
_class = np.zeros(CODES + 1, np.int64)
_class[_letter != 0x20] = OTHER
for _k, _c in enumerate(LETTERS):
    _class[_letter == _c] = _k + 1
_sign = np.zeros(0x20AD, bool)
_sign[[ord(c) for c in LOOKALIKE]] = True


def letters_of(cps: np.ndarray) -> np.ndarray:
    return _letter[np.minimum(cps, CODES)]


def codes(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, start of each document in them): documents are kept apart by line ends."""
    text = np.insert(data, offs[1:], 0x0A)
    cps = np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(cps) == len(text):
        return cps, offs + np.arange(len(offs))
    lead = (text & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(lead)])
    return cps, at[offs + np.arange(len(offs))]


def plain_codes(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower-case letters with single spaces between words, where each comes from)."""
    x = letters_of(cps)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 0x20) | (x[:-1] != 0x20)
    at = np.flatnonzero(keep)
    return x[at], at


def as_text(codes_: np.ndarray) -> str:
    return codes_.astype("<u4").tobytes().decode("utf-32-le")


def plain(text: str) -> str:
    """Lower-case words between single spaces, with one before and after."""
    x, _ = plain_codes(np.frombuffer(f" {text} ".encode("utf-32-le"), np.uint32))
    return as_text(x)


def disguised(cps: np.ndarray) -> list[tuple[int, int]]:
    """Spans (of code points) of words with a sign beside a letter or a letter twice, and of letters or signs that stand alone."""
    n = len(cps)
    if n < 2:
        return []
    low = letters_of(cps)
    letter = low != 0x20
    sign = _sign[np.minimum(cps, 0x20AC)]
    white = (cps <= 0x20) | (cps == 0xA0)
    hit = np.zeros(n, bool)
    hit[:-1] = (sign[:-1] & letter[1:]) | (letter[:-1] & sign[1:]) | (letter[:-1] & (low[:-1] == low[1:]))
    at = np.flatnonzero(hit)
    out = []
    gaps = np.flatnonzero(white)
    if len(at):
        k = np.searchsorted(gaps, at)
        starts = np.where(k > 0, gaps[np.maximum(k - 1, 0)] + 1 if len(gaps) else 0, 0)
        ends = np.where(k < len(gaps), gaps[np.minimum(k, len(gaps) - 1)] if len(gaps) else n, n)
        first = np.flatnonzero(np.diff(starts, prepend=-1))
        out = list(zip(starts[first].tolist(), ends[first].tolist()))
    # letters or signs that stand alone, one to three separators apart, four or more on one line
    core = letter | sign
    alone = core.copy()
    alone[1:] &= ~core[:-1]
    alone[:-1] &= ~core[1:]
    p = np.flatnonzero(alone)
    if len(p) >= ALONE:
        inked, lines = np.concatenate([[0], np.cumsum(core)]), np.concatenate([[0], np.cumsum(cps == 0x0A)])
        near = (np.diff(p) <= 4) & (inked[p[1:]] == inked[p[:-1] + 1]) & (lines[p[1:]] == lines[p[:-1]])
        edge = np.flatnonzero(np.diff(np.concatenate([[False], near, [False]]).astype(np.int8)))
        out += [(int(p[i]), int(p[j]) + 1) for i, j in zip(edge[::2].tolist(), edge[1::2].tolist()) if j - i + 1 >= ALONE and letter[p[i : j + 1]].any()]
    return out


def trigram_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(code, n): trigrams of letters and word ends over all texts."""

    def run(batches):
        total = np.zeros(SIZE**3, np.int64)
        for _, data, offs in K.blocks(batches, "_text"):
            if not len(data):
                continue
            cps, _ = codes(data, offs)
            x = _class[np.minimum(cps, CODES)]
            keep = np.ones(len(x), bool)
            keep[1:] = (x[1:] != 0) | (x[:-1] != 0)
            x = np.concatenate([[0, 0], x[keep], [0]])
            total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["code", "n"])

    return docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


class CharModel:
    """Interpolated trigram log probabilities over letters and the word end."""

    def __init__(self, code: np.ndarray, n: np.ndarray):
        c3 = np.zeros(SIZE**3)
        c3[code] = n
        c3 = c3.reshape(SIZE, SIZE, SIZE)
        c2 = c3.sum(0)
        c1 = c2.sum(0)
        p1 = (c1 + 1) / (c1.sum() + SIZE)
        p2 = (c2 + 2 * p1) / (c2.sum(1, keepdims=True) + 2)
        self.logp = np.log((c3 + 5 * p2) / (c3.sum(2, keepdims=True) + 5)).astype(np.float32)

    def decode(self, span: str) -> str:
        """The likeliest letters behind a disguised span; Viterbi over the last two letters."""
        units: list[list[tuple[str, float]]] = []
        i, low = 0, span.lower()
        while i < len(low):
            ch, j = low[i], i + 1
            while j < len(low) and low[j] == ch:
                j += 1
            run = j - i
            if ch.isalpha():
                units.append([(ch, 0.0), (ch * 2, -0.5 if run > 1 else -99.0)] if run > 1 else [(ch, 0.0)])
            else:
                letters = [(x * k, -0.7 - 0.5 * (k > 1)) for x in LOOKALIKE.get(ch, "") for k in ((1, 2) if run > 1 else (1,))]
                # a sign inside a word is hardly there for nothing, one behind it may well be
                inside = j < len(low) and (low[j].isalpha() or low[j] in LOOKALIKE)
                units.append([("", (-4.0 if inside else -1.0) if letters else -0.2), *letters])
            i = j
        # the best way to each pair of last letters, as a chain of what was written
        logp, of = self.logp, _class
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for unit in units:
            if len(best) == len(unit) == 1:  # no choice: what all ways share costs all the same
                (((a, b), (cost, way)),), (text, _) = best.items(), unit[0]
                for ch in text:
                    a, b = b, int(of[min(ord(ch), CODES)])
                best = {(a, b): (cost, (way, text) if text else way)}
                continue
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (cost, way) in best.items():
                for text, extra in unit:
                    x, y, c = a, b, cost + extra
                    for ch in text:
                        z = int(of[min(ord(ch), CODES)])
                        c += float(logp[x, y, z])
                        x, y = y, z
                    if (x, y) not in new or new[x, y][0] < c:
                        new[x, y] = (c, (way, text) if text else way)
            best = new
        _, way = max(((c + float(logp[a, b, 0]), w) for (a, b), (c, w) in best.items()), key=lambda x: x[0])
        out = []
        while way:
            way, text = way
            out.append(text)
        return "".join(reversed(out))


class Restorer:
    def __init__(self, chars: CharModel, most: int = 100_000):
        self.chars, self.most, self.cache = chars, most, {}

    def __call__(self, span: str) -> str:
        """The letters behind a span, without the marks around it that resemble no letter."""
        span = span.strip("().,;:?\"'#%&*")
        if len(span) > 64:
            return self.chars.decode(span)
        out = self.cache.get(span)
        if out is None:
            if len(self.cache) >= self.most:
                self.cache.clear()
            out = self.cache[span] = self.chars.decode(span)
        return out


def restored(cps: np.ndarray, restore: Restorer) -> list[tuple[int, str]]:
    """(start, letters) of the disguised spans."""
    return [(a, restore(as_text(cps[a:b]))) for a, b in disguised(cps)]


def features(word: str) -> list[str]:
    """A word and its beginnings of three letters or more, as strings to be found in plain text."""
    return [f" {word} ", *(f" {word[:k]}" for k in range(3, min(len(word), 9) + 1))]


def unlike(texts: list[str]) -> list[int]:
    """The texts that share none of four min-hashes of word triples with one before: copies would count twice."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, t in enumerate(texts):
        w = t.split()
        h = np.array([zlib.crc32(" ".join(w[k : k + 3]).encode()) for k in range(max(1, len(w) - 2))], np.uint64)
        keys = {(k, int(K.mix(h + np.uint64(k << 40)).min())) for k in range(4)}
        if not keys & seen:
            out.append(i)
        seen |= keys
    return out


class Marks:
    """Selected features with the precision of each, and the base rate of texts without one."""

    def __init__(self, texts: list[str], y: np.ndarray):
        self.weight: dict[str, float] = {}
        pick = unlike(texts)
        texts, y = [texts[i] for i in pick], y[pick]
        base = float(y.mean()) if len(y) else 0.0
        self.base = base
        if not 0 < base < 1:
            return
        words_t: dict[str, set[int]] = defaultdict(set)
        words_c: Counter[str] = Counter()
        for i, t in enumerate(texts):
            if y[i]:
                for w in set(t.split()):
                    words_t[w].add(i)
            else:
                words_c.update(set(t.split()))
        seen_t: dict[str, set[int]] = defaultdict(set)
        for w, s in words_t.items():
            for f in features(w):
                seen_t[f] |= s
        # clean documents are counted once for each word with the feature, which can only lower its precision
        clean: Counter[str] = Counter()
        for w, n in words_c.items():
            for f in features(w):
                if f in seen_t:
                    clean[f] += n
        # chance level: candidates that lie in k toxic documents, and in no clean one, by luck alone
        spread = Counter(len(s) + clean[f] for f, s in seen_t.items())
        least = 2
        while least < 40 and sum(n * base**d for d, n in spread.items() if d >= least) > 0.3:
            least += 1
        bar = -least * math.log(base)

        def gain(k: int, c: int) -> float:
            p = k / (k + c)
            return k * math.log(p / base) + (c * math.log((1 - p) / (1 - base)) if c else 0.0) if p > base else 0.0

        pool = {f: s for f, s in seen_t.items() if len(s) / (len(s) + clean[f]) >= 0.8 and gain(len(s), clean[f]) >= bar}
        uncovered = {i for i in range(len(texts)) if y[i]}
        for f in sorted(pool, key=lambda f: (-gain(len(pool[f]), clean[f]), -len(f), f)):
            k, c = len(pool[f]), clean[f]
            if any(g.startswith(f) or f.startswith(g) for g in self.weight):
                continue
            # what others explain already may confirm a mark, but not make it
            if gain(max(1, len(pool[f] & uncovered)), c) >= bar * 0.5 or gain(k, c) >= 1.5 * bar:
                self.weight[f] = (k + 0.5) / (k + c + 1.0)
                uncovered -= pool[f]
                if len(self.weight) >= MARKS:
                    break
        left = sum(1 for i in range(len(texts)) if y[i] and not any(f in texts[i] for f in self.weight))
        none = sum(1 for i, t in enumerate(texts) if not y[i] and not any(f in t for f in self.weight))
        self.base = (left + 0.5) / (left + none + 1.0)

    def score(self, found: set[str]) -> float:
        miss = 1 - self.base
        for f in found:
            miss *= 1 - self.weight[f]
        return 1 - miss


class Model:
    def __init__(self, texts: list[str], y: np.ndarray, chars: CharModel):
        self.chars = chars
        restore = Restorer(chars)
        full = []
        for t in texts:
            cps = np.frombuffer(t.encode("utf-32-le"), np.uint32)
            full.append(plain(t) + "".join(f" {r} " for _, r in restored(cps, restore)))
        self.marks = Marks(full, y)

    def scorer(self):
        """A function from a block (bytes, offsets) to scores."""
        import ahocorasick

        auto = ahocorasick.Automaton()
        for f in self.marks.weight:
            auto.add_word(f, f)
        if self.marks.weight:
            auto.make_automaton()
        restore, seen = Restorer(self.chars), {}
        none = self.marks.score(set())

        def score(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
            n = len(offs) - 1
            out = np.full(n, none)
            if not self.marks.weight or not len(data):
                return out
            cps, first = codes(data, offs)
            x, at = plain_codes(cps)
            found: dict[int, set[str]] = defaultdict(set)
            # a space before the block and after it lets marks match at its ends
            hits = [(end, f) for end, f in auto.iter(" " + as_text(x) + " ")]
            if hits:
                # the letter after a mark's leading space
                begin = at[np.clip(np.array([e - len(f) + 1 for e, f in hits]), 0, len(at) - 1)]
                for d, (_, f) in zip((np.searchsorted(first, begin, side="right") - 1).tolist(), hits):
                    found[d].add(f)
            text = as_text(cps)
            for a, b in disguised(cps):
                span = text[a:b]
                marks = seen.get(span)
                if marks is None:
                    marks = tuple({f for _, f in auto.iter(f" {restore(span)} ")})
                    if len(span) <= 64:
                        if len(seen) >= 4 * restore.most:
                            seen.clear()
                        seen[span] = marks
                if marks:
                    found[int(np.searchsorted(first, a, side="right")) - 1].update(marks)
            for d, marks in found.items():
                out[min(d, n - 1)] = self.marks.score(marks)
            return out

        return score


def char_model(docs: DataFrame) -> CharModel:
    rows = trigram_counts(docs).toPandas()  # bounded by the alphabet cubed
    return CharModel(rows.code.to_numpy(np.int64), rows.n.to_numpy(np.int64))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 3, held: int = 1, max_train: int = MAX_TRAIN, max_bytes: int = MAX_TRAIN_BYTES) -> Model:
    """The character model is counted over all texts; the marks come from a bounded sample of labelled rows."""
    rows = training_rows(docs, labels, label, parts, held, max_train, max_bytes).toPandas()
    return Model(rows.text.tolist(), rows.y.to_numpy(np.int64), char_model(docs))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, predicted) of every whole text."""
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        judge = pickle.loads(held.value).scorer()
        for part, data, offs in K.blocks(batches, "_text"):
            s = judge(data, offs)
            yield pa.RecordBatch.from_arrays([part.column("_id"), pa.array(s, pa.float64()), pa.array((s >= THRESHOLD).astype(np.int32))], ["_id", "score", "predicted"])

    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"))
    kind = src.schema["_id"].dataType.simpleString()
    return src.mapInArrow(run, f"_id {kind}, score double, predicted int").withColumnRenamed("_id", id_col)
