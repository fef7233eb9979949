"""Quotation linking: reply order from quoted passages.

A message's lines are split into runs of equal quote level (the number of ``>``
marks in front, with spaces between them or not).  Each run is a passage.  A
passage is hashed whole, by paragraph (between blank lines) and by line, over its
lower-case words; the own text of a message is its level-0 lines.

A quoted passage of any level is linked to an original that has one of its
pieces among the pieces of its own text: the nearest earlier message of the same
conversation, else (not for single lines of a longer passage) the earliest
message of all with that piece.  The parent of a message is the original of its
shallowest linked passage; among those, whole passages go before paragraphs
and paragraphs before lines, then the own conversation before others, then the
first in the message.  A deeper quote so gives the parent where no shallower one
is linked.  Parents lead to depth and root by pointer jumping, and the messages
of a root, in the order of depth, conversation and turn, are a conversation in
reply order: no message comes before the one that it answers.

Defined cases: a null or empty body has no passage and no parent; pieces without
a word link nothing; equal rows are one message, rows of one (conversation, turn)
with different bodies are different ones; a message with a null conversation or
turn belongs to no conversation, and is linked as from elsewhere; originals are
always earlier in the order (conversation, turn, nulls first), so no loop can
close; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tremor.llm import kernel as K

MARKS = r"^([ \t]*>)+[ \t]?"
BLANK = r"\n([ \t]*\n)+"
ID = ["k1", "k2"]
#: turns of a conversation that are searched together
NEAR_TURNS = 64


def level(line: Column) -> Column:
    """How often ``>`` stands in front of a line."""
    return F.length(F.translate(F.regexp_extract(line, r"^([ \t>]*>)", 1), " \t", ""))


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def passages(messages: DataFrame) -> DataFrame:
    """(k1, k2, place, level, text): the runs of lines of one level; ``messages`` has k1, k2, body."""
    lines = messages.select(*ID, F.posexplode(F.split("body", "\n")).alias("at", "line"))
    lines = lines.select(*ID, "at", level(F.col("line")).alias("level"), F.regexp_replace("line", MARKS, "").alias("line"))
    by = W.partitionBy(*ID).orderBy("at")  # a message's own lines
    run = F.sum(F.when(F.col("level") == F.lag("level").over(by), 0).otherwise(1)).over(by)
    return lines.withColumn("place", run).groupBy(*ID, "place", "level").agg(_joined(F.struct("at", "line"), "line").alias("text"))


def _joined(row: Column, field: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x[field]), "\n")


def pieces(text: Column) -> Column:
    """(kind, norm) of a text, its paragraphs and its lines, those without a word left out."""
    of = lambda kind, parts: F.transform(parts, lambda p: F.struct(F.lit(kind).alias("kind"), normal(p).alias("norm")))
    return F.filter(F.concat(of(0, F.array(text)), of(1, F.split(text, BLANK)), of(2, F.split(text, "\n"))), lambda p: p["norm"] != "")


def _hashed(rows: DataFrame, *names: str) -> DataFrame:
    """The least kind of each piece, by a 128-bit hash."""
    rows = rows.select(*names, F.explode(pieces(F.col("text"))).alias("p"))
    return rows.groupBy(*names, F.xxhash64("p.norm").alias("h1"), F.xxhash64("p.norm", F.lit(7)).alias("h2")).agg(F.min("p.kind").alias("kind"))


def nearest(quote: DataFrame, target: DataFrame) -> DataFrame:
    """(conv, h1, h2, turn, t): the last turn before a quote's with the piece, in its conversation.

    One row for each (piece, turn); runs of ``NEAR_TURNS`` turns are searched
    first and then put in order, so no join pairs the turns of a common piece.
    """
    key = ["conv", "h1", "h2"]
    both = target.select(*key, "turn", F.col("turn").alias("t")).unionByName(quote.select(*key, "turn", F.lit(None).cast(target.schema["turn"].dataType).alias("t")))
    both = both.where("conv is not null and turn is not null").groupBy(*key, "turn").agg(F.max("t").alias("t"))
    both = both.withColumn("run", F.floor(F.col("turn") / NEAR_TURNS))
    inner = W.partitionBy(*key, "run").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    outer = W.partitionBy(*key).orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = both.groupBy(*key, "run").agg(F.max("t").alias("most")).withColumn("before", F.max("most").over(outer)).drop("most")
    near = both.withColumn("t", F.max("t").over(inner)).join(runs, [*key, "run"])
    return near.select(*key, "turn", F.coalesce("t", "before").alias("t")).where("t is not null")


def roots(up: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(k1, k2, r1, r2, depth) from the parents (p1, p2) of messages; each round doubles how far a message sees."""
    far = up.select(*ID, F.coalesce("p1", "k1").alias("r1"), F.coalesce("p2", "k2").alias("r2"), F.col("p1").isNotNull().cast("long").alias("depth"), F.col("p1").isNull().alias("done"))
    for _ in range(max_rounds):
        todo = far.where("not done")
        asked = todo.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n"))
        step = far.select(F.col("k1").alias("r1"), F.col("k2").alias("r2"), F.col("r1").alias("s1"), F.col("r2").alias("s2"), F.col("depth").alias("more"), F.col("done").alias("end"))
        step = K.materialise(step.join(asked, ["r1", "r2"]), "steps")
        new = K.hot_join(todo, step, ["r1", "r2"], "n").select(*ID, F.col("s1").alias("r1"), F.col("s2").alias("r2"), (F.col("depth") + F.col("more")).alias("depth"), F.col("end").alias("done"))
        far = K.materialise(far.where("done").unionByName(new), "roots")
        if not far.where("not done").limit(1).count():
            return far.drop("done")
    raise RuntimeError("reply chains did not end")


def positions(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``position``, from 0 within each group: a range sort, and the counts of each group in each part of it."""
    rows = rows.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order)
    rows = K.materialise(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    part = rows.groupBy(*group, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # as many rows as a group has parts
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    part = K.materialise(part.withColumn("_before", before), "parts")
    out = K.hot_join(rows, part, [*group, "_part"], "_n")
    return out.withColumn("position", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_first", "_n", "_before")


def link(df: DataFrame, conv: str = "conv_id", turn: str = "turn", body: str = "text") -> DataFrame:
    """(conv, turn, parent_conv, parent_turn, root_conv, root_turn, depth, position, n_quotes, own): one row for each message.

    ``own`` is the message without its quotes and ``position`` its place in the
    root's conversation, in reply order.
    """
    msg = df.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(body).cast("string"), F.lit("")).alias("body")).distinct()
    name = [F.col("conv").isNull(), F.col("turn").isNull(), "conv", "turn", "body"]
    msg = K.materialise(msg.withColumns({"k1": F.xxhash64(*name), "k2": F.xxhash64(F.lit(7), *name)}), "messages")
    who = msg.select("conv", "turn", *ID)
    part = K.materialise(passages(msg), "passages")
    own = part.where("level = 0").groupBy(*ID).agg(_joined(F.struct("place", "text"), "text").alias("text"))
    own = K.materialise(who.join(own, ID, "left").withColumn("text", F.coalesce("text", F.lit(""))), "own")
    target = _hashed(own.select(*ID, "text").unionByName(part.where("level = 0").select(*ID, "text")), *ID)
    target = K.materialise(target.join(who, ID), "originals")
    quote = K.materialise(_hashed(part.where("level > 0"), *ID, "level", "place").join(who, ID), "quotes")
    inside = nearest(quote, target)
    maker = target.groupBy("conv", "turn", "h1", "h2").agg(F.min(F.struct(*ID)).alias("o"))
    inside = inside.join(maker.withColumnRenamed("turn", "t"), ["conv", "h1", "h2", "t"])
    near = quote.join(inside.select("conv", "h1", "h2", "turn", "o"), ["conv", "h1", "h2", "turn"]).withColumn("outside", F.lit(False))
    # elsewhere: one original for each piece, so that common pieces stay one row
    rank = F.struct("conv", "turn", *ID)
    first = target.where("kind < 2").groupBy("h1", "h2").agg(F.min(rank).alias("f"))
    asked = quote.where("kind < 2").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"))
    first = K.materialise(first.join(asked, ["h1", "h2"]), "first")
    away = K.hot_join(quote.where("kind < 2"), first, ["h1", "h2"], "n").where(F.col("f") < rank).select(*(c for c in quote.columns), F.struct("f.k1", "f.k2").alias("o")).withColumn("outside", F.lit(True))
    linked = near.unionByName(away).groupBy(*ID, "level", "place").agg(F.min(F.struct("kind", "outside", "o")).alias("b"))
    parent = linked.groupBy(*ID).agg(F.min(F.struct("level", "b.kind", "b.outside", "place", "b.o")).alias("x"), F.count(F.lit(1)).alias("n_quotes"))
    up = who.join(parent, ID, "left").select(*ID, F.col("x.o.k1").alias("p1"), F.col("x.o.k2").alias("p2"), F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"))
    up = K.materialise(up, "parents")

    def named(rows: DataFrame, a: str, b: str, kind: str) -> DataFrame:
        """The conversation and turn of the messages (a, b)."""
        asked = rows.where(F.col(a).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
        names = who.select(F.col("k1").alias(a), F.col("k2").alias(b), F.col("conv").alias(f"{kind}_conv"), F.col("turn").alias(f"{kind}_turn"))
        return K.hot_join(rows.where(F.col(a).isNotNull()), K.materialise(names.join(asked, [a, b]), kind), [a, b], "n").drop("n")

    far = named(roots(up), "r1", "r2", "root")
    above = named(up.select(*ID, "p1", "p2"), "p1", "p2", "parent").select(*ID, "parent_conv", "parent_turn")
    out = own.withColumnRenamed("text", "own").join(far, ID).join(up.select(*ID, "n_quotes"), ID).join(above, ID, "left")
    out = positions(out, ["r1", "r2"], ["depth", "conv", "turn", *ID])
    return out.select("conv", "turn", "parent_conv", "parent_turn", "root_conv", "root_turn", "depth", "position", "n_quotes", "own")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, text): turns as messages that quote turns before, as mail programs and people do.

    By turn modulo 4: 2 quotes only the last line of the turn before, 3 only the
    turn before that at level 2, 0 and 1 quote both whole.  The tables hold no
    quotations; this makes a mailbox from them, in which the operator has to
    find the turns again.
    """
    by = W.partitionBy("conv_id").orderBy("turn")
    base = conversations.where("conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    one, two = F.lag("text", 1).over(by), F.lag("text", 2).over(by)
    quoted = base.select("conv_id", "turn", "text", one.alias("one"), two.alias("two"))
    mark = lambda c, m: F.concat(F.lit(m), F.replace(F.col(c), F.lit("\n"), F.lit("\n" + m)))
    last = F.concat(F.lit("> "), F.element_at(F.split("one", "\n"), -1))
    way = F.pmod("turn", F.lit(4))
    body = F.when(way == 2, F.concat_ws("\n", last, "text")).when(way == 3, F.concat_ws("\n", mark("two", "> > "), F.col("text"))).otherwise(F.concat_ws("\n", mark("two", "> > "), mark("one", "> "), F.col("text")))
    return quoted.select("conv_id", "turn", body.alias("text"))
