"""Host-level quality rules, in DataFrame functions only.

Each document is measured by itself; rule failures are then summed by host, the
host's failure rates are shrunk towards an empirical beta prior (its mean and
strength by the method of moments over hosts), and the host's verdicts are
joined back to its documents: a host is blocked when its shrunk rate of any
failure is over ``BLOCK``, and a soft rule is enforced on a host's documents
when the host's shrunk rate for it is over ``WATCH``.

Defined cases: a null or empty text has no words and fails the base rule; a
null host is never blocked and has its soft rules enforced; ties and repeated
rows are counted as they come; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tremor.llm import kernel as K

MIN_WORDS = 50
MOST_REPEATED = 50  # per cent of the words
SYMBOLS = "#*$%&|<>"
SYMBOL_SHARE = 10  # a soft failure: more symbols than a tenth of the words
LINE_SHARE = 20  # a soft failure: more repeated lines than a twentieth of the words
WATCH = 0.02
BLOCK = 0.5


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.transform(F.array(value), body)[0]


def repeated_words(words: Column) -> Column:
    """How many words lie in three-word windows that occur twice or more; windows are compared by a 64-bit hash."""
    n = F.size(words)

    def of(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        last = F.size(hashes) - 1

        def twice(s: Column) -> Column:
            here = lambda k: s[k]["h"]
            hit = F.filter(F.sequence(F.lit(0), last), lambda k: F.when(k > 0, here(k - 1) == here(k)).otherwise(False) | F.when(k < last, here(k + 1) == here(k)).otherwise(False))
            return let(F.sort_array(F.transform(hit, lambda k: s[k]["i"])), covered)

        def covered(p: Column) -> Column:
            gaps = F.transform(p, lambda x, k: F.when(k > 0, F.least(F.lit(3), x - p[k - 1])).otherwise(F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, twice))

    hashes = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))
    return F.when(n < 3, F.lit(0)).otherwise(let(hashes, of))


def measure(text: Column) -> Column:
    """A struct of the counts that the rules need."""
    words = F.filter(F.split(text, r"[\x20\t-\r]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\t-\r]"))
    return let(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.size(F.split(text, f"[{SYMBOLS}]")) - 1).cast("long").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


def measures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    src = df.select(F.col(id_col).alias("_id"), F.col(host_col).alias("_host"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    m = src.select("_id", "_host", measure(F.col("_text")).alias("m")).select("_id", "_host", "m.*")
    repeat = F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED
    return m.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | repeat,
            "symbols_failed": F.col("n_symbols") * SYMBOL_SHARE > F.col("n_words"),
            "lines_failed": F.col("n_dup_lines") * LINE_SHARE > F.col("n_words"),
        }
    )


RULES = ("any", "symbols", "lines")


def host_verdicts(m: DataFrame) -> DataFrame:
    """(host, documents, blocked, enforce_symbols, enforce_lines) from the failures of each host's documents."""
    failed = {"any": F.col("base_failed") | F.col("symbols_failed") | F.col("lines_failed"), "symbols": F.col("symbols_failed"), "lines": F.col("lines_failed")}
    hosts = m.where("_host is not null").groupBy("_host").agg(F.count(F.lit(1)).alias("n"), *(F.count_if(failed[r]).alias(f"k_{r}") for r in RULES))
    moments = []
    for r in RULES:
        rate = F.col(f"k_{r}") / F.col("n")
        moments += [(F.sum(f"k_{r}") / F.sum("n")).alias(f"mean_{r}"), F.coalesce(F.var_pop(rate), F.lit(0.0)).alias(f"var_{r}"), F.avg(1.0 / F.col("n")).alias(f"inv_{r}")]
    prior = hosts.agg(*moments)  # one row
    out = hosts.join(F.broadcast(prior))
    rates = {}
    for r in RULES:
        mean, spread = F.col(f"mean_{r}"), F.col(f"mean_{r}") * (1 - F.col(f"mean_{r}"))
        between = F.greatest(F.col(f"var_{r}") - spread * F.col(f"inv_{r}"), F.lit(1e-6))
        strength = F.greatest(spread / between - 1, F.lit(1.0))
        rates[r] = (F.col(f"k_{r}") + strength * mean) / (F.col("n") + strength)
    return out.select("_host", "n", (rates["any"] > BLOCK).alias("blocked"), (rates["symbols"] > WATCH).alias("enforce_symbols"), (rates["lines"] > WATCH).alias("enforce_lines"))


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(id, host, counts, base_failed, kept)."""
    m = K.materialise(measures(df, id_col, text_col, host_col), "measures")
    known = m.where("_host is not null")
    # a host with very many documents has its verdict broadcast
    out = K.hot_join(known, K.materialise(host_verdicts(m), "hosts"), ["_host"], "n").drop("n")
    none = m.where("_host is null").withColumns({c: F.lit(None).cast("boolean") for c in ("blocked", "enforce_symbols", "enforce_lines")})
    out = out.unionByName(none)
    soft = (F.col("symbols_failed") & F.coalesce("enforce_symbols", F.lit(True))) | (F.col("lines_failed") & F.coalesce("enforce_lines", F.lit(True)))
    kept = ~F.col("base_failed") & ~F.coalesce("blocked", F.lit(False)) & ~soft
    return out.select(F.col("_id").alias(id_col), F.col("_host").alias(host_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"))


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT doc_id, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w0),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
wc AS (SELECT doc_id, count(*) AS n_words, sum(length(w)) AS word_chars FROM w GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
m AS (SELECT d.doc_id, source, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
 length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
 FROM d LEFT JOIN wc USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rep USING (doc_id)),
f AS (SELECT *, n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MOST_REPEATED} AS base_failed, n_symbols * {SYMBOL_SHARE} > n_words AS sf, n_dup_lines * {LINE_SHARE} > n_words AS lf FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed OR sf OR lf) AS ka, count(*) FILTER (sf) AS ks, count(*) FILTER (lf) AS kl FROM f WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT sum(ka) / sum(n) AS ma, sum(ks) / sum(n) AS ms, sum(kl) / sum(n) AS ml, var_pop(ka / n) AS va, var_pop(ks / n) AS vs, var_pop(kl / n) AS vl, avg(1.0::DOUBLE / n) AS inv FROM h),
q AS (SELECT *, greatest(ma * (1 - ma) / greatest(va - ma * (1 - ma) * inv, 1e-6) - 1, 1.0) AS sa, greatest(ms * (1 - ms) / greatest(vs - ms * (1 - ms) * inv, 1e-6) - 1, 1.0) AS ss, greatest(ml * (1 - ml) / greatest(vl - ml * (1 - ml) * inv, 1e-6) - 1, 1.0) AS sl FROM p),
v AS (SELECT source, (ka + sa * ma) / (n + sa) > {BLOCK} AS blocked, (ks + ss * ms) / (n + ss) > {WATCH} AS es, (kl + sl * ml) / (n + sl) > {WATCH} AS el FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
 NOT base_failed AND NOT coalesce(blocked, false) AND NOT ((sf AND coalesce(es, true)) OR (lf AND coalesce(el, true))) AS kept
FROM f LEFT JOIN v USING (source)
"""
