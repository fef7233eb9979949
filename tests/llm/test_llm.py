import math
import random
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tremor.llm import bagminhash, bpe, chroma, host_rules, line_dedup, pack, quality, quotes, repeats, toxicity
from tremor.llm import kernel as K
from tremor.llm.queries import vocabulary

ODD = [None, "", " ", "\n", "a", "a b", "x " * 5000, "dé 日本 'll", "same line\nsame line\nsame line", "same line\nsame line\nsame line"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, start=0):
    rows = [(start + i, t, "en", f"s{i % 2}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def prose(rng, n, words=400):
    vocab = [f"w{k}" for k in range(words)]
    return " ".join(rng.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- byte-level BPE ---------------------------------------------------------


def test_bpe_equals_tiktoken(spark):
    import public_tokenizers as P
    import tiktoken

    path = vocabulary("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    rng = random.Random(1)
    pieces = ["'s", "'", "''", "'ll", "'LL", "ve", " ", "  ", "\n", "\t", " \n", "a", "Zé", "9", "日", "!", "...", " ", "\x85", "<|endoftext|>", "́"]
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 30))) for _ in range(400)] + ["z" * 3000, " " * 500]
    got = bpe.decode(bpe.encode(docs(spark, texts), path), path).toPandas().sort_values("doc_id")
    for t, ids, back in zip(texts, got.ids, got.decoded):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t), t
        assert back.decode() == t


def test_bpe_empty_and_null(spark, empty):
    path = vocabulary("byte_bpe_50k.tiktoken")
    assert bpe.encode(empty, path).count() == 0
    r = bpe.encode(spark.createDataFrame([(None, None)], "doc_id long, text string"), path).first()
    assert r.doc_id is None and bytes(r.ids) == b""


# --- packing ----------------------------------------------------------------


def test_pack_covers_each_id_once(spark, empty):
    from tokenizers import Tokenizer

    path = vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    rng = random.Random(2)
    texts = [*ODD, "İstanbul ß ﬁ éé́", "9 lives, it's <|endoftext|>!", *(prose(rng, rng.randint(1, 900)) for _ in range(40))]
    p = pack.pack(docs(spark, texts), path).toPandas()
    for i, t in enumerate(texts):
        own = p[p.doc_id == i].sort_values("start")
        assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and (own.doc_tokens == own.length.sum()).all()
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        n = s.length.sum()
        assert n <= 2048 and s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]]
        assert n == 2048 or n & (n - 1) == 0  # nothing is padded
    assert pack.pack(empty, path).count() == 0


def test_index_finds_the_like():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 500, 100), rng.integers(500, 1000, 100)
    items = [a.astype("<u4"), b.astype("<u4"), np.concatenate([a[:90], b[:5]]).astype("<u4"), np.concatenate([b[:90], a[:5]]).astype("<u4")]
    near = pack.Index(items, pack.Statistics.of(items)).neighbours(0, np.array([False, True, True, True]))
    assert near[0] == 2


def plain_bm25(tokens, q, terms):
    """Scores of all documents for the strongest terms of one, by the formula, term by term."""
    n, mean = len(tokens), sum(map(len, tokens)) / len(tokens)
    df = {}
    for t in tokens:
        for x in set(t):
            df[x] = df.get(x, 0) + 1

    def weight(x, d):
        tf = tokens[d].count(x)
        return math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(tokens[d]) / mean))

    strong = sorted((x for x in set(tokens[q]) if df[x] > 1), key=lambda x: (-weight(x, q), x))[:terms]
    return [sum(weight(x, d) for x in strong) for d in range(n)]


def test_index_ranks_as_plain_bm25():
    rng = random.Random(31)
    tokens = [[int(rng.paretovariate(0.7)) % 900 for _ in range(rng.randint(5, 80))] for _ in range(120)]
    arrays = [np.array(t, "<u2") for t in tokens]
    index = pack.Index(arrays, pack.Statistics.of(arrays))
    unused = np.array([rng.random() < 0.8 for _ in tokens])
    for q in range(0, 120, 7):
        near = index.neighbours(q, unused)
        score = plain_bm25(tokens, q, pack.QUERY_TERMS)
        want = sorted((-round(score[d], 9), d) for d in np.flatnonzero(unused).tolist() if score[d] > 0)[: pack.NEIGHBOURS]
        assert [round(score[d], 9) for d in near.tolist()] == [-s for s, _ in want]


def test_statistics_and_routes_cover_the_corpus(spark, empty):
    rng = random.Random(32)
    topics = [["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(12)] for _ in range(30)]
    texts = [" ".join(rng.choice(topics[i % 30]) for _ in range(60)) for i in range(600)] + [None, "", "x"]
    t = K.materialise(pack.tokenise(docs(spark, texts).repartition(7), vocabulary("word_bpe_49k.json"), "doc_id", "text"), "t")
    rows = [(r._id, np.frombuffer(r.ids, "<u2")) for r in t.where("ids is not null").collect()]
    own, got = pack.Statistics.of([x for _, x in rows]), pack.statistics(t)
    assert (own.df == got.df).all() and own.mean == got.mean and np.allclose(own.idf, got.idf)
    order = [r._id for r in pack.routed(t, got).coalesce(1).collect()]
    near = sum(a % 30 == b % 30 for a, b in zip(order, order[1:]) if a < 600 and b < 600)
    assert near > 300  # of 599 neighbours in the order, where chance gives 20
    s = pack.statistics(K.materialise(pack.tokenise(empty, vocabulary("word_bpe_49k.json"), "doc_id", "text"), "t"))
    assert s.mean == 1.0 and not s.df.any()


def test_rest_of_a_shard_goes_on(spark):
    rng = random.Random(33)
    texts = [prose(rng, rng.randint(1, 700)) for _ in range(300)] + ["same text"] * 5
    p = pack.pack(docs(spark, texts).coalesce(1), vocabulary("word_bpe_49k.json"), shard_docs=20).toPandas()
    size = p.groupby("sequence_id").length.sum()
    parts = (p.sequence_id // (1 << 36)).nunique()
    assert p.groupby("doc_id").length.sum().eq(p.groupby("doc_id").doc_tokens.first()).all() and len(p.doc_id.unique()) == 305
    assert (size < 2048).sum() <= 11 * parts


# --- repeats ----------------------------------------------------------------


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    shared = [prose(rng, 40), "ab" * 120, "z" * 90]
    texts = [*ODD, "aaaa" * 100, "é" * 60]
    for _ in range(60):
        parts = [prose(rng, rng.randint(0, 30))]
        if rng.random() < 0.6:
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 3)
            parts.append(s[a : a + rng.randint(20, 250)])
        parts.append(prose(rng, rng.randint(0, 20)))
        texts.append("".join(parts))
    texts += [texts[-1], texts[-1], texts[-2][:-3]]
    # a shard of 2 sends every larger one through the hashes
    for length, reach, shard in ((60, 30, 1024), (60, 30, 2), (400, 300, 1024)):
        got = {r._id: r for r in repeats.remove_repeats(docs(spark, texts), length=length, reach=reach, shard=shard).collect()}
        want = repeats.brute_force([(t or "").encode() for t in texts], length)
        for i, (t, spans) in enumerate(zip(texts, want)):
            assert [(x.s, x.e) for x in got[i].spans] == spans, (length, i)
            raw = (t or "").encode()
            keep = bytes(c for k, c in enumerate(raw) if not any(s <= k < e for s, e in spans))
            assert bytes(got[i].kept) == keep and got[i].n_bytes == len(raw)


def across_brute(texts, length):
    """Removed word spans: windows that another text has too."""
    seen = {}
    words = [t.split() for t in texts]
    for w in words:
        for k in {tuple(w[i : i + length]) for i in range(len(w) - length + 1)}:
            seen[k] = seen.get(k, 0) + 1
    return [repeats.merge_spans([(i, i + length) for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1]) for w in words]


@pytest.mark.parametrize("shard", [1024, 2])
def test_passages_equal_brute_force(spark, shard):
    rng = random.Random(21)
    shared = [prose(rng, 80, 3000) for _ in range(6)]
    texts = [*(t for t in ODD if t), "again " * 120, "again " * 70]
    for i in range(70):
        s = rng.choice(shared).split()
        a = rng.randint(0, 20)
        part = s[a : a + rng.randint(30, 70)]
        own = prose(rng, 60, 3000)
        texts.append(" \n".join([prose(rng, rng.randint(0, 40), 3000), " ".join(part), own, own if i % 3 == 0 else ""]))
    # one text in two documents counts, twice in one document does not
    texts = list(dict.fromkeys(texts)) + [texts[-1]]
    want = across_brute(texts, 51)
    assert sum(map(len, want)) > 20
    cut = repeats.remove_repeats(docs(spark, texts), unit="words", across=True, shard=shard)
    for r in cut.collect():
        w, gone = texts[r._id].split(), want[r._id]
        keep = [x for k, x in enumerate(w) if not any(s <= k < e for s, e in gone)]
        assert bytes(r.kept).decode().split() == keep and len(r.spans) == len(gone), r._id
    marked = repeats.remove_repeats(docs(spark, texts), passage=51, shard=shard)
    assert {r._id: r.n_passage_words for r in marked.collect()} == {i: sum(e - s for s, e in w) for i, w in enumerate(want)}


def test_shard_arrays_equal_pairs():
    """The order of a shard against a comparison of all pairs of its windows."""
    rng = random.Random(22)
    rule = repeats.Rule(length=12, reach=6)
    text, left, last = [], [], []
    for _ in range(60):
        a, n = rng.randint(0, 5), rng.randint(0, 5)
        text.append(bytes(rng.choice(b"ab") for _ in range(a)) + b"ababab" + bytes(rng.choice(b"ab") for _ in range(max(0, 12 + min(a, n) - a - 6))))
        left.append(a)
        last.append(min(a, n))
    spot = np.array([rng.randint(0, 20) for _ in text])
    got = repeats.shard_repeats(rule, np.zeros(60, np.int64), text, np.array(left), np.array(last), spot)
    for i, t in enumerate(text):
        for s in range(last[i] + 1):
            d = left[i] - s
            same = [j for j in range(60) if 0 <= left[j] - d <= last[j] and text[j][left[j] - d :][:12] == t[s:][:12]]
            assert got[i, s] == (len({spot[j] for j in same}) > 1), (i, s)


def test_repeats_empty_table_and_equal_ids(spark, empty):
    assert repeats.remove_repeats(empty).count() == 0
    t = prose(random.Random(3), 300)
    d = spark.createDataFrame([(1, t), (1, t), (None, t[:399])], "doc_id long, text string")
    assert sorted(len(r.kept) for r in repeats.remove_repeats(d).collect()) == [0, 0, 399]


# --- line dedup -------------------------------------------------------------


def line_brute(texts):
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append(None)
            continue
        raw = t.encode()
        s, e, n, _, _ = line_dedup.chunk_spans(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        keep = b""
        for a, b, k in zip(s, e, n):
            body = raw[a:b]
            key = body[:-1] if b < len(raw) and body.endswith(b"\n") else body
            if k > 1 and key.strip(b" \t\n\x0b\f\r"):
                if key in seen:
                    continue
                seen.add(key)
            keep += body
        out.append(keep.decode())
    return out


def test_line_dedup_equals_brute_force(spark, empty):
    rng = random.Random(4)
    lines = [prose(rng, 5) for _ in range(30)]
    texts = [*ODD, "\n\n\n", "a\n\n"]
    for _ in range(80):
        a = rng.randint(0, 25)
        texts.append("\n".join([prose(rng, 4) for _ in range(rng.randint(0, 4))] + lines[a : a + rng.randint(1, 20)] + [prose(rng, 4)]))
    texts += ["L\n" * 200, "L\n" * 100]
    d = docs(spark, texts).withColumn("n_chunks_removed", F.lit(5)).withColumn("_text", F.lit("mine"))
    got = {r.doc_id: r for r in line_dedup.dedup(d).collect()}
    assert [got[i].text for i in range(len(texts))] == line_brute(texts)
    assert got[0].n_chunks_removed == 5 and got[0]["_text"] == "mine" and sum(r.n_chunks_removed_ for r in got.values()) > 10
    assert line_dedup.dedup(empty).count() == 0


def test_line_dedup_with_different_texts_of_one_id(spark):
    rng = random.Random(14)
    body = "\n".join(prose(rng, 5) for _ in range(30))
    rows = [(1, body), (2, "short"), (2, body), (2, None), (2, body), (3, "x\ny\n" + body)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, r.text) for r in line_dedup.dedup(d).collect()]
    assert len(got) == 6 and {(1, body), (2, "short"), (2, None)} <= set(got)
    cut = [t for i, t in got if i == 2 and t not in ("short", None)]
    assert cut[0] == cut[1] and len(cut[0]) < 100 and len(next(t for i, t in got if i == 3)) < len(body)


def test_planted_passages_of_lines_go(spark):
    """Without the operator's chunks: of a repeated passage only lines near its edges stay, and no other line goes."""
    rng = random.Random(51)
    passage = [[prose(rng, 6, 5000) for _ in range(n)] for n in (2, 3, 8, 30)]
    texts, planted = [], []
    for i in range(80):
        own = [prose(rng, 6, 5000) for _ in range(rng.randint(3, 12))]
        at = rng.randint(0, len(own))
        p = passage[i % 4]
        texts.append("\n".join(own[:at] + p + own[at:]))
        planted.append(p)
    got = {r.doc_id: (r.text or "").split("\n") for r in line_dedup.dedup(docs(spark, texts)).collect()}
    left = {n: 0 for n in (2, 3, 8, 30)}
    for i, t in enumerate(texts):
        lines, p = t.split("\n"), planted[i]
        lost = [x for x in lines if x not in got[i]]
        assert set(lost) <= set(p), i
        if i >= 4:
            left[len(p)] += sum(x in got[i] for x in p)
        else:
            assert got[i] == lines  # the first of each stays
    assert left[30] <= 19 * 8 and left[8] <= 19 * 7  # of 570 and 152 lines


def test_chunks_have_two_lines():
    rng = random.Random(52)
    for n in [*range(1, 12), 40, 300]:
        for same in (False, True):
            t = ["x" if same else prose(rng, 3) for _ in range(n)]
            b = "\n".join(t).encode()
            s, e, lines, doc, k = line_dedup.chunk_spans(np.frombuffer(b, np.uint8), np.array([0, len(b)]))
            assert lines.sum() == n and (n == 1 or lines.min() >= 2) and lines.max() <= 2 * line_dedup.MOST
            assert s[0] == 0 and e[-1] == len(b) and (s[1:] == e[:-1]).all() and k.tolist() == list(range(len(s)))


def test_line_chunks_resist_shifts():
    rng = random.Random(5)
    body = [prose(rng, 6) for _ in range(60)]

    def cut(ls):
        b = "\n".join(ls).encode()
        return {b[s:e] for s, e, *_ in zip(*line_dedup.chunk_spans(np.frombuffer(b, np.uint8), np.array([0, len(b)])))}

    one, two = cut(body), cut(["new first line", *body])
    assert len(one & two) >= 0.8 * len(one)


# --- near copies ------------------------------------------------------------


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(0)
    a = np.repeat(rng.integers(1, 1 << 60, 80), rng.integers(1, 9, 80)).astype(np.uint64)
    b = np.concatenate([a[60:], rng.integers(1, 1 << 60, 50).astype(np.uint64)])
    true, est = bagminhash.overlap(a, b), []
    for t in range(40):
        h = K.mix(np.concatenate([a, b]) + np.uint64(t))
        s = bagminhash.signatures(h, np.repeat([0, 1], [len(a), len(b)]), 2)
        est.append((s[0] == s[1]).mean())
    assert np.mean(est) == pytest.approx(true, abs=0.03)


def test_near_classes_equal_brute_force(spark, empty):
    rng = random.Random(6)
    texts = [*ODD]
    for _ in range(25):
        base = prose(rng, rng.randint(30, 200), 3000).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            texts.append("  ".join(w))
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs(spark, texts)).collect()}
    sh = []
    for t in texts:
        w = (t or "").split()
        sh.append(np.array([zlib.crc32(" ".join(w[k : k + 5]).encode()) for k in range(max(1, len(w) - 4))] if w else [], np.uint64))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sh[i]) and bagminhash.overlap(sh[i], sh[j]) >= 0.8:
                root[max(find(i), find(j))] = min(find(i), find(j))
    assert got == {i: find(i) for i in range(len(texts))}
    assert bagminhash.classes(empty).count() == 0
    n = spark.createDataFrame([(None, "a b"), (7, "a b")], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in bagminhash.classes(n).collect()} == {None: None, 7: 7}


def form_letters(pairs):
    """Texts 2i and 2i + 1 share one of three fields (similarity 0.818), all others none (0.739)."""
    base = [f"w{k}" for k in range(104)]
    texts = []
    for i in range(2 * pairs):
        w = list(base)
        w[20], w[50], w[80] = f"pair{i // 2}", f"b{i}", f"c{i}"
        texts.append(" ".join(w))
    return texts


def test_near_pairs_of_a_template_family_are_all_found(spark):
    got = {r.doc_id: r.class_id for r in bagminhash.classes(docs(spark, form_letters(1000))).collect()}
    # a pair shares no band with probability 2e-5
    assert got == {i: i // 2 * 2 for i in range(2000)}


# --- classifiers ------------------------------------------------------------


def labelled(spark, texts, y, name):
    return docs(spark, texts), spark.createDataFrame([(i, v) for i, v in enumerate(y)], f"doc_id long, {name} int")


def test_quality_held_out_accuracy(spark, empty):
    rng = random.Random(7)
    texts, y = [], []
    for _ in range(400):
        good = rng.random() < 0.7
        t = prose(rng, rng.randint(20, 120))
        texts.append(t if good else rng.choice([t.replace(" ", "%%% "), "again " * 60 + t[:50]]))
        y.append(int(good))
    d, lab = labelled(spark, texts, y, "quality")
    m = quality.train(d, lab)
    s = quality.score(d, m).toPandas().sort_values("doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 4 == 2 for i in range(len(texts))])
    assert (s.predicted.to_numpy() == np.array(y))[held].mean() > 0.95
    assert s.score.between(0, 1).all()
    odd = quality.score(docs(spark, ODD), m).toPandas()
    assert len(odd) == len(ODD) and odd.score.notna().all() and odd.score.iloc[-1] == odd.score.iloc[-2]
    none = quality.train(d, lab.where("false"))
    assert none.base == 0.5 and quality.score(empty, none).count() == 0


def test_random_indexing_equals_plain_sums():
    """Pooled vectors against sums that are written out word by word."""
    rng = random.Random(61)
    texts = ["", "a", *(prose(rng, rng.randint(3, 40), 12) + "!? 42" for _ in range(20))]
    raw = [t.encode() for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    h, doc = quality.words(np.frombuffer(b"".join(raw), np.uint8), offs)
    by_doc = [h[doc == d].tolist() for d in range(len(texts))]
    # words, digits and signs apart
    assert [len(x) for x in by_doc] == [len(regex.findall(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\s]+", t)) for t in texts]

    def index(w):
        v = np.zeros(quality.DIM)
        for k in range(quality.NONZERO):
            bits = (w >> (12 * k)) & ((1 << 64) - 1)
            v[bits & (quality.DIM - 1)] += 1.0 - 2.0 * ((bits >> 8) & 1)
        return v

    count = {}
    for ws in by_doc:
        for w in ws:
            count[w] = count.get(w, 0) + 1
    context = {w: np.zeros(quality.DIM) for w, n in count.items() if n >= 3}
    for ws in by_doc:
        for i, w in enumerate(ws):
            for j in range(max(0, i - quality.WINDOW), min(len(ws), i + quality.WINDOW + 1)):
                if w in context and j != i:
                    context[w] += index(ws[j])
    got = quality.Vectors([(h, doc)]).pool(h, doc, len(texts))
    for d, ws in enumerate(by_doc):
        n = max(1, len(ws))
        plain = sum((index(w) for w in ws), np.zeros(quality.DIM)) / n
        ctx = sum((context[w] / max(np.linalg.norm(context[w]), 1e-9) for w in ws if w in context), np.zeros(quality.DIM)) / n
        want = [*plain, *ctx, np.linalg.norm(plain), np.linalg.norm(ctx), np.log(n) / 10]
        assert np.allclose(got[d], want, atol=1e-5), d


def test_temperature_is_that_of_least_loss():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = (x[:, 0] + rng.normal(size=400) > 0).astype(float)
    net = quality.Network(x[:300], y[:300], rounds=10)

    def loss(t):
        q = 1 / (1 + np.exp(-net.logit(x[300:]) / t))
        return -np.mean(np.log(np.where(y[300:] == 1, q, 1 - q) + 1e-9))

    net.calibrate(x[300:], y[300:])
    assert all(loss(net.temperature) <= loss(t) + 1e-3 for t in np.linspace(0.3, 8, 200))
    assert np.allclose(net.score(x[300:]), 1 / (1 + np.exp(-net.logit(x[300:]) / net.temperature)))


def test_toxicity_finds_disguised_words(spark, empty):
    rng = random.Random(8)
    base = ["that", "thing", "often", "there", "round", "ether", "onset", "insane"]
    texts, y = [], []
    for _ in range(600):
        w = [rng.choice(base) + rng.choice(base) for _ in range(rng.randint(10, 60))]
        bad = rng.random() < 0.15
        if bad:
            w[rng.randrange(len(w))] = rng.choice(["stupid", "idiot"])
        texts.append(" ".join(w))
        y.append(int(bad))
    d, lab = labelled(spark, texts, y, "toxic")
    m = toxicity.train(d, lab)
    hard = ["there is an id1ot", "such a $tup1d thing", "s t u p i d", "stuuupid that", "a thing that there"]
    s = toxicity.score(docs(spark, [*hard, *ODD]), m).toPandas().sort_values("doc_id").predicted.tolist()
    assert s[:5] == [1, 1, 1, 1, 0] and not any(s[5:])
    got = toxicity.score(d, m).toPandas().sort_values("doc_id").predicted.to_numpy()
    held = np.array([zlib.crc32(str(i).encode()) % 3 == 1 for i in range(len(texts))])
    assert (got == np.array(y))[held].mean() > 0.98
    assert toxicity.score(empty, toxicity.train(empty, lab)).count() == 0


def test_decoding_equals_enumeration():
    """Viterbi against every path of the lattice, which is built here again."""
    import itertools

    rng = np.random.default_rng(3)
    code = rng.choice(toxicity.SIZE**2 * 27, 4000, replace=False)
    chars = toxicity.CharModel(code, rng.integers(1, 50, 4000))
    look = toxicity.LOOKALIKE

    def costs(span):
        """The best value of each text that some path writes."""
        out = {}
        units = []
        groups = [(c, len(list(g))) for c, g in itertools.groupby(span)]
        for k, (c, n) in enumerate(groups):
            if c.isalpha():
                units.append([(c, 0.0)] + ([(c * 2, -0.5)] if n > 1 else []))
            else:
                inside = k + 1 < len(groups) and (groups[k + 1][0].isalpha() or groups[k + 1][0] in look)
                own = [(x * r, -0.7 - 0.5 * (r > 1)) for x in look.get(c, "") for r in ((1, 2) if n > 1 else (1,))]
                units.append([("", (-4.0 if inside else -1.0) if own else -0.2), *own])
        for path in itertools.product(*units):
            text = "".join(t for t, _ in path)
            x = [0, 0, *(toxicity._class[ord(c)] for c in text), 0]
            cost = sum(c for _, c in path) + sum(float(chars.logp[a, b, c]) for a, b, c in zip(x, x[1:], x[2:]))
            out[text] = max(out.get(text, -1e9), cost)
        return out

    for span in ("1d1ot", "s.t.u.p.!.d", "aa11bb", "h3ll0!!", "x", "$$$", "m 0 r 0 n", "l  o  s  e  r", "ж1ж"):
        every = costs(span)
        assert every[chars.decode(span)] == pytest.approx(max(every.values()), abs=1e-3), span
    long = "a1" * 5000
    assert set(chars.decode(long)) <= set("ail")


def test_gate_takes_in_all_disguises():
    def spans(text):
        return [text[a:b] for a, b in toxicity.disguised(np.frombuffer(text.encode("utf-32-le"), np.uint32))]

    assert spans("an idio7 hat3 idiiot stuupid fine 2024 word") == ["idio7", "hat3", "idiiot", "stuupid"]
    for word in ("m 0 r 0 n", "i d 1 o t", "l  o  s  e  r", "l. o. s. e. r", "l.o.s.e.r", "l - o - s - e"):
        assert word in spans(f"what de {word} by"), word
    assert spans("a b c") == [] and spans("a\nb\nc\nd") == [] and spans("1 2 3 4") == [] and spans("") == []


def test_marks_of_other_scripts(spark):
    rng = random.Random(18)
    texts, y = [], []
    for i in range(400):
        w = ["".join(rng.choice("абвгежиклмноп") for _ in range(6)) for _ in range(20)]
        y.append(int(i % 8 == 0))
        texts.append(" ".join(w[:5] + ["Дурак"] * y[-1] + w[5:]))
    d, lab = labelled(spark, texts, y, "toxic")
    s = toxicity.score(d, toxicity.train(d, lab)).toPandas().sort_values("doc_id")
    assert s.predicted.tolist() == y


def test_marks_stay_in_their_document(spark):
    chars = toxicity.CharModel(np.zeros(0, np.int64), np.zeros(0, np.int64))
    m = toxicity.Model([], np.zeros(0, np.int64), chars)
    m.marks.weight, m.marks.base = {" idiot ": 0.9}, 0.1
    texts = ["é idiot", "", "fine", "idiot"]
    raw = [t.encode() for t in texts]
    s = m.scorer()(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
    assert (s > 0.5).tolist() == [True, False, False, True]


# --- host rules -------------------------------------------------------------


def test_host_rules(spark, empty):
    rng = random.Random(9)
    clean = [prose(rng, 80) for _ in range(60)]
    texts = [*ODD, *clean, *(c.replace(" ", "### ") for c in clean[:10])]
    r = host_rules.judge(docs(spark, texts)).toPandas().sort_values("doc_id")
    assert len(r) == len(texts) and not r.kept[r.base_failed].any()
    assert r.kept.iloc[len(ODD) : len(ODD) + 60].all() and not r.kept.iloc[len(ODD) + 60 :].any()
    words = "a b c d a b c x a b c".split()
    c = spark.createDataFrame([(" ".join(words),)], "t string").select(host_rules.measure(F.col("t")).alias("m")).first().m
    # windows "a b c" (three times): positions 0-2, 4-6 and 8-10
    assert c.n_words == 11 and c.n_repeat_words == 9
    assert host_rules.judge(empty).count() == 0


def test_blocked_host(spark):
    rows = [(i, "too short", "bad") for i in range(200)] + [(1000 + i, prose(random.Random(i), 80), "bad" if i < 3 else f"good{i % 4}") for i in range(200)]
    r = host_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas().set_index("doc_id")
    assert not r.kept[[1000, 1001, 1002]].any() and r.kept[list(range(1003, 1200))].all()


# --- quotations -------------------------------------------------------------


def test_quotes_link_and_unlink(spark):
    m = [(1, 0, "Hello there.\nSecond line"), (1, 1, "> Hello there.\n> Second line\nMine"), (1, 2, "> > Hello there.\n>> Second line\n> mine\nEnd"), (1, 3, None), (2, 0, "Hello there.\nsecond  LINE"), (2, 5, "> nobody said this\nX"), (3, 1, "> X\nfrom elsewhere"), (1, 1, "> Hello there.\n> Second line\nMine")]
    m += [(4, 0, "One.\nTwo.\n\nThree.\nFour."), (4, 1, "> Three.\n> Four.\nparagraph"), (4, 2, "> > two.\nline, level 2 only"), (4, 3, "> unknown\n> > > paragraph\nfallback"), (4, 3, "another body"), (4, 4, "> Two.\n> Three.\nlines")]
    d = spark.createDataFrame([(*r, "clash") for r in m] + [(None, 1, "alone", ""), (None, None, "> another body", "")], "conv_id long, turn long, text string, own string")
    rows = quotes.link(d).collect()
    assert len(rows) == 15
    r = {(x.conv, x.turn): x for x in rows if x.own != "another body"}
    assert (r[1, 1].parent_turn, r[1, 2].parent_turn, r[1, 2].depth, r[1, 2].root_turn) == (0, 1, 2, 0)
    assert r[1, 1].own == "Mine" and r[1, 2].own == "End" and r[1, 3].own == "" and r[2, 5].parent_turn is None
    assert (r[3, 1].parent_conv, r[3, 1].parent_turn) == (2, 5)
    assert r[1, 2].n_quotes == 2 and [r[1, k].position for k in (0, 1, 2)] == [0, 1, 2]
    assert [r[4, k].parent_turn for k in range(5)] == [None, 0, 0, 1, 0] and [r[4, k].depth for k in range(5)] == [0, 1, 1, 2, 1]
    assert [r[4, k].position for k in (0, 1, 2, 4, 3)] == [0, 1, 2, 3, 4]
    # without a conversation: the original must come before it in the order, and nulls come first
    assert r[None, None].parent_conv is None and r[None, 1].own == "alone"
    assert quotes.link(d.where("false")).count() == 0


def test_a_common_passage_and_a_long_conversation(spark):
    rows = [(1, t, f"> yes\n> part {t - 1}\nyes\npart {t}") for t in range(300)] + [(2 + i, 0, "> yes\nme too") for i in range(50)]
    r = {(x.conv, x.turn): x for x in quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert [r[1, t].parent_turn for t in range(300)] == [None, *range(299)] and r[1, 299].depth == r[1, 299].position == 299
    assert r[30, 0].parent_conv is None  # a single line of a longer text links in its conversation only
    assert r[30, 0].n_quotes == 0


def test_positions_in_every_group(spark, monkeypatch):
    monkeypatch.setattr(K, "HOT_ROWS", 10)
    rows = [("a" if i % 3 else f"g{i % 7}", (i * 37) % 200) for i in range(200)]
    got = quotes.positions(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()
    for g in {r.g for r in got}:
        own = sorted((r.position, r.v) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)


# --- fingerprints -----------------------------------------------------------


def test_fingerprints_align_shifted_recordings():
    rng = np.random.default_rng(1)
    tune = 0.5 * np.sin(np.cumsum(np.repeat(2 * np.pi * 440 * 2 ** (rng.integers(-9, 9, 60) / 12) / chroma.RATE, 900)))
    a = chroma.fingerprint(chroma.read_wav(chroma.write_wav(tune)))
    b = chroma.fingerprint(chroma.read_wav(chroma.write_wav(tune[10 * chroma.HOP :] * 0.7)))
    c = chroma.fingerprint(0.5 * np.sin(np.cumsum(np.repeat(2 * np.pi * 440 * 2 ** (rng.integers(-9, 9, 60) / 12) / chroma.RATE, 900))))
    best = min((chroma.align(a, b, o)[0], o) for o in range(-40, 10))
    assert best[1] == -10 and best[0] < 0.05
    got = chroma.best_matches(np.array([0]), [a], np.array([1, 2]), [b, c])
    assert got.other.tolist() == [1] and got.offset.tolist() == [-10]


def every_alignment(q, r):
    """All (offset, error, overlap) within the bounds, one at a time."""
    tried = ((o, *chroma.align(q, r, o)) for o in range(-len(q), len(r) + 1))
    return [(o, e, n) for o, e, n in tried if n >= chroma.MIN_OVERLAP and e <= chroma.MAX_ERROR]


def test_alignments_are_exact_where_samples_are_close(monkeypatch):
    """One to eight bits of each integer flipped, different lengths, any offset: each alignment within the bounds, with its error."""
    monkeypatch.setattr(chroma, "OFFSET_STEP", 1)  # neighbours of random integers are not alike
    rng = np.random.default_rng(7)
    random_fp = lambda n: rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)
    q, r = [random_fp(n) for n in (60, 45, 40, 15, 0)], []
    for k in range(60):
        part = q[k % 3][k % 7 : k % 7 + 34]
        flip = np.array([sum(1 << int(b) for b in rng.choice(32, rng.integers(1, 9), replace=False)) for _ in part], np.uint32)
        r.append(np.concatenate([random_fp(int(rng.integers(0, 30))), part ^ flip, random_fp(int(rng.integers(0, 9)))]))
    r.append(random_fp(5))
    got = chroma.best_matches(np.arange(5), q, 100 + np.arange(61), r).set_index("class_id")
    for i in range(3):
        want = sorted((e, 100 + j, o) for j, x in enumerate(r) for o, e, _ in every_alignment(q[i], x))
        assert got.n[i] == len({w[1] for w in want}) and (got.error[i], got.other[i], got.offset[i]) == pytest.approx(want[0])
    assert got.index.tolist() == [0, 1, 2]


def test_match_recall_against_brute_force(spark):
    """Partners by identity: at all offsets, over vectors that are near and over ones that are not."""
    rng = np.random.default_rng(2)
    base = rng.normal(0, 0.125, (150, 64))
    rows = [(i, (base[i % 150] + rng.normal(0, 0.004 * (i // 150), 64)).tolist()) for i in range(600)] + [(1000, None), (1001, []), (None, base[0].tolist())]
    rows += [(7, rows[7][1])]  # a repeated row
    media = chroma.render(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumn("fp", F.lit("clash"))
    fp = {r._id: np.frombuffer(r.fp, "<u4") for r in chroma.fingerprints(media, "vec_id", "media").collect()}
    got = chroma.match(media).toPandas()
    assert len(got) == 603 and got[got.vec_id.isna()].class_id.isna().all()
    got = got[got.vec_id.notna()].set_index("vec_id")
    assert got.n_frames[[1000, 1001]].tolist() == [0, 0] and got.class_id[1001] == 1001
    ids = sorted(set(got.class_id[got.n_frames > 0].astype(int)))
    found = true = 0
    for q in range(0, 600, 20):
        near = {r: min((e, o) for o, e, _ in hits) for r in ids if r != got.class_id[q] and (hits := every_alignment(fp[q], fp[r]))}
        true += len(near)
        pairs = chroma.best_matches(np.array([int(got.class_id[q])]), [fp[q]], np.array(ids), [fp[r] for r in ids])
        assert (0 if pairs.empty else pairs.n[0]) == got.n_matches[q] <= len(near)
        found += int(got.n_matches[q])
        if got.n_matches[q]:
            assert near[int(got.best_id[q])][0] == pytest.approx(got.bit_error[q], abs=1e-6)
    assert true > 40 and found / true >= 0.9


# --- components and pipeline ------------------------------------------------


def test_components(spark):
    e = [(i, i + 1) for i in range(40)] + [(100, 101), (200, 200)]
    got = {r.id: r.component for r in K.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_pipeline_equals_its_parts(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(10)
    base = [prose(rng, 120, 3000) for _ in range(20)]
    near = [" ".join([*b.split()[:-1], "end"]) for b in base[:5]]
    junk = ["again " * 100 for _ in range(4)] + [b.replace(" ", "%%% ") for b in base[:6]]
    texts = [*base, *near, base[7], *junk, *(prose(rng, 60) for _ in range(60)), *(prose(rng, 60).replace(" ", "%%% ") for _ in range(30))]
    y = [0 if "%%%" in t or "again again" in t else 1 for t in texts]
    d, lab = labelled(spark, texts, y, "quality")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    sf = str(tmp_path)
    kept = cp.classify(spark, d, sf)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == cp.COLUMNS and not ids & {i for i, v in enumerate(y) if not v} and len(ids) >= 0.95 * sum(y)
    lines = cp.dedup_lines(spark, kept, sf)
    one = K.materialise(cp.dedup_near(spark, lines, sf), "t")
    left = {r.doc_id for r in one.collect()}
    assert not left & {20, 21, 22, 23, 24} & ids and 25 not in left and set(range(20)) & ids <= left
    out = cp.run(spark, sf).toPandas()
    assert set(out.doc_id) == left and out.groupby("sequence_id").length.sum().max() <= 2048
    assert cp.ORACLE_SQL is None and [n for n, _ in cp.STAGES][0] == "quality classifier"


def test_pipeline_tells_rows_of_one_id_apart(spark):
    import corpus_pipeline as cp

    rng = random.Random(12)
    t, u, x = (prose(rng, 60, 3000) for _ in range(3))
    rows = [(1, t), (5, t), (5, u), (7, x), (7, x), (None, t), (None, "rest of it"), (8, None), (9, ""), (5, t + " more")]
    d = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS).withColumn("_key", F.lit(1))
    got = sorted(((r.doc_id or -1, r.text) for r in cp.dedup_near(spark, d, "").collect()), key=str)
    assert got == sorted([(1, t), (5, u), (7, x), (-1, "rest of it"), (8, None), (9, "")], key=str)


def test_pipeline_stages_with_empty_tables_and_without_labels(spark, empty, tmp_path):
    import corpus_pipeline as cp

    empty.write.parquet(f"{tmp_path}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    none.write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0
    d = docs(spark, [*ODD, prose(random.Random(1), 40)]).withColumn("score", F.lit(0))
    assert cp.classify(spark, d, str(tmp_path)).count() == len(ODD) + 1
    for name, stage in cp.STAGES[1:4]:
        out = stage(spark, d, str(tmp_path))
        assert out.columns == cp.COLUMNS and out.where("text is null").count() == (0 if name.startswith("suffix") else 1), name


@pytest.mark.parametrize("hot", [3, 1000])
def test_hot_join_equals_join(spark, monkeypatch, hot):
    monkeypatch.setattr(K, "HOT_ROWS", hot)
    big = spark.createDataFrame([(i % 5 if i % 3 else 0, i) for i in range(60)], "k long, v long")
    small = K.materialise(big.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k <> 4"), "small")
    got = sorted(map(tuple, K.hot_join(big, small, ["k"], "n").collect()))
    assert got == sorted(map(tuple, big.join(small, "k").collect()))


def long_text(rng, words, vocabulary):
    return " ".join(rng.choices(vocabulary, k=words))


def test_texts_longer_than_a_block(spark):
    """A text of over 512 KiB goes through every text operator whole."""
    from tokenizers import Tokenizer

    rng = random.Random(41)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    big = long_text(rng, 110_000, vocab)
    assert len(big) > K.BLOCK_BYTES
    part = big[400_000:402_000]
    d = docs(spark, [big, part, big])
    cut = {r._id: r for r in repeats.remove_repeats(d).collect()}
    assert [len(cut[i].kept) for i in range(3)] == [0, 0, 0]
    got = {r.doc_id: r.class_id for r in bagminhash.classes(d).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    p = pack.pack(d, vocabulary("word_bpe_49k.json")).toPandas()
    own = p[p.doc_id == 0].sort_values("start")
    assert np.frombuffer(b"".join(own.ids), "<u4").tolist() == tok.encode(big, add_special_tokens=False).ids + [1]
    path = vocabulary("byte_bpe_50k.tiktoken")
    assert all(r.decoded.decode() == (part if r.doc_id == 1 else big) for r in bpe.decode(bpe.encode(d, path), path).collect())
    lines = docs(spark, [big.replace(" ", "\n", 5000), big.replace(" ", "\n", 5000)])
    left = {r.doc_id: r.text for r in line_dedup.dedup(lines).collect()}
    assert left[0] == big.replace(" ", "\n", 5000) and len(left[1]) < 30
    for model in (toxicity, quality):
        lab = spark.createDataFrame([(i, i % 2) for i in range(60)], f"doc_id long, {'toxic' if model is toxicity else 'quality'} int")
        m = model.train(docs(spark, [prose(rng, 30) for _ in range(60)]), lab)
        s = model.score(d, m).toPandas().sort_values("doc_id").score
        assert s.iloc[0] == s.iloc[2] and s.between(0, 1).all()
