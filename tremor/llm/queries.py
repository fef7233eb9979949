"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tremor.llm import bagminhash, bpe, chroma, host_rules, line_dedup, pack, quality, quotes, repeats, toxicity
from tremor.llm import kernel as K


def vocabulary(name: str) -> str:
    """Where a public vocabulary file lies; TOKENIZERS_DIR names another folder with the same files."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application."""
    sc = spark.sparkContext
    if getattr(sc, "_tremor_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    name = os.path.join(tempfile.mkdtemp(prefix="tremor-"), "tremor.zip")
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(name)
    sc._tremor_shipped = True


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`embeddings` rendered as tunes: fingerprint class of each recording, and the matches of each query."""
    return chroma.match(chroma.render(K.read(spark, sf_dir, "embeddings")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What line dedup leaves of each document."""
    out = line_dedup.dedup(K.read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("kept_bytes"), F.col("n_chunks_removed").cast("long").alias("n_chunks_removed"), F.col("n_lines_removed").cast("long").alias("n_lines_removed"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of 400 bytes, and beside them the words in passages of over 50 words that other documents have too."""
    out = repeats.remove_repeats(K.read(spark, sf_dir, "documents").select("doc_id", "text"), passage=repeats.PASSAGE)
    return out.select(F.col("_id").alias("doc_id"), "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_passage_words")


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack.pack(K.read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.classes(K.read(spark, sf_dir, "documents"))


def _scored(docs: DataFrame, scored: DataFrame, parts: int, held: int) -> DataFrame:
    return scored.select("doc_id", (quality.fold(F.col("doc_id"), parts) == held).alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.read(spark, sf_dir, "documents")
    return _scored(docs, toxicity.score(docs, toxicity.train(docs, K.read(spark, sf_dir, "labels"))), 3, 1)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = K.read(spark, sf_dir, "documents")
    return _scored(docs, quality.score(docs, quality.train(docs, K.read(spark, sf_dir, "labels"))), 4, 2)


def op8_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` rendered as a mailbox with nested quotes; the reply order that the quotes give."""
    out = quotes.link(quotes.render(K.read(spark, sf_dir, "conversations")))
    return out.select(F.col("conv").alias("conv_id"), "turn", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", "position", "n_quotes", F.sha2(F.col("own").cast("binary"), 256).alias("own_sha256"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    out = bpe.decode(bpe.encode(K.read(spark, sf_dir, "documents"), path), path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.judge(K.read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OPERATORS = [op1_chroma_fingerprints, op2_line_dedup, op3_suffix_dedup, op4_bm25_packing, op5_bagminhash, op6_toxicity, op7_quality, op8_quotation_linking, op9_byte_bpe, op10_host_rules]

#: renders the mailbox, then parses it again: lines, levels, runs, pieces, links, chains
OP8_SQL = r"""
WITH RECURSIVE base AS (SELECT conv_id AS c, turn AS t, min(coalesce(text, '')) AS x FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
prev AS (SELECT *, lag(x) OVER o AS one, lag(x, 2) OVER o AS two FROM base WINDOW o AS (PARTITION BY c ORDER BY t)),
box AS (SELECT c, t, CASE t % 4 WHEN 2 THEN concat_ws(chr(10), '> ' || string_split(one, chr(10))[-1], x)
  WHEN 3 THEN concat_ws(chr(10), '> > ' || replace(two, chr(10), chr(10) || '> > '), x)
  ELSE concat_ws(chr(10), '> > ' || replace(two, chr(10), chr(10) || '> > '), '> ' || replace(one, chr(10), chr(10) || '> '), x) END AS body FROM prev),
raw AS (SELECT c, t, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS i FROM box),
lines AS (SELECT c, t, i, length(regexp_replace(regexp_extract(line, '^([ \t>]*>)', 1), '[ \t]', '', 'g')) AS lev, regexp_replace(line, '^([ \t]*>)+[ \t]?', '') AS line FROM raw),
turns AS (SELECT *, CASE WHEN lev = lag(lev) OVER (PARTITION BY c, t ORDER BY i) THEN 0 ELSE 1 END AS new FROM lines),
runs AS (SELECT *, sum(new) OVER (PARTITION BY c, t ORDER BY i) AS place FROM turns),
pass AS (SELECT c, t, place, lev, string_agg(line, chr(10) ORDER BY i) AS text FROM runs GROUP BY ALL),
own AS (SELECT c, t, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (lev = 0), '') AS own FROM lines GROUP BY ALL),
texts AS (SELECT c, t, 0 AS place, 0 AS lev, own AS text FROM own UNION ALL SELECT * FROM pass),
cut AS (SELECT c, t, place, lev, 0 AS kind, text AS piece FROM texts
  UNION ALL SELECT c, t, place, lev, 1, unnest(regexp_split_to_array(text, '\n([ \t]*\n)+')) FROM texts
  UNION ALL SELECT c, t, place, lev, 2, unnest(string_split(text, chr(10))) FROM texts),
normed AS (SELECT c, t, place, lev, kind, trim(regexp_replace(lower(piece), '[^\p{L}\p{N}]+', ' ', 'g')) AS n FROM cut),
target AS (SELECT c, t, n, min(kind) AS kind FROM normed WHERE lev = 0 AND n <> '' GROUP BY ALL),
quote AS (SELECT c, t, place, lev, n, min(kind) AS kind FROM normed WHERE lev > 0 AND n <> '' GROUP BY ALL),
inside AS (SELECT q.c, q.t, q.place, q.n, max(o.t) AS pt FROM quote q JOIN target o ON q.c = o.c AND q.n = o.n AND o.t < q.t GROUP BY ALL),
first AS (SELECT n, min(row(c, t)) AS f FROM target WHERE kind < 2 GROUP BY n),
cand AS (SELECT q.c, q.t, q.place, q.lev, q.kind, false AS outside, q.c AS pc, i.pt AS pt FROM quote q JOIN inside i USING (c, t, place, n)
  UNION ALL SELECT q.c, q.t, q.place, q.lev, q.kind, true, f[1], f[2] FROM quote q JOIN first USING (n) WHERE q.kind < 2 AND f < row(q.c, q.t)),
best AS (SELECT c, t, arg_min(row(pc, pt), row(lev, kind, outside, place)) AS p, count(DISTINCT place) AS n_quotes FROM cand GROUP BY ALL),
up AS (SELECT own.*, p[1] AS pc, p[2] AS pt, coalesce(n_quotes, 0) AS n_quotes FROM own LEFT JOIN best USING (c, t)),
tree AS (SELECT c, t, c AS rc, t AS rt, 0::BIGINT AS depth FROM up WHERE pc IS NULL UNION ALL SELECT u.c, u.t, rc, rt, depth + 1 FROM up u JOIN tree ON u.pc = tree.c AND u.pt = tree.t)
SELECT c AS conv_id, t AS turn, pc AS parent_conv, pt AS parent_turn, rc AS root_conv, rt AS root_turn, depth,
 row_number() OVER (PARTITION BY rc, rt ORDER BY depth, c, t) - 1 AS position, n_quotes::BIGINT AS n_quotes, sha256(own) AS own_sha256
FROM up JOIN tree USING (c, t)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(f):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return query

    return {f.__name__: shipped(f) for f in OPERATORS} | {"pipeline": shipped(pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op8_quotation_linking": OP8_SQL, "op10_host_rules": host_rules.ORACLE_SQL}
