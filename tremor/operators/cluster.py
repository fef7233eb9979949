"""Clustering of event features (key, features...)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def standard_scale(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1 by column; a constant column is 0.  One row of statistics is broadcast."""
    stat = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.stddev_pop(c).alias(f"_s_{c}") for c in columns))
    d = df.join(F.broadcast(stat))
    return d.select(*(c for c in df.columns if c not in columns), *(F.when(F.col(f"_s_{c}") > 0, (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}")).otherwise(0.0).alias(c) for c in columns))


def pca(df: DataFrame, columns: list[str], k: int = 3) -> DataFrame:
    """pca_1..k beside the columns; each component's largest loading is positive, missing components are 0."""
    d = VectorAssembler(inputCols=columns, outputCol="_v").transform(df)
    own = min(k, len(columns))
    model = PCA(k=own, inputCol="_v", outputCol="_p").fit(d)
    load = model.pc.toArray()
    sign = [1.0 if load[abs(load[:, j]).argmax(), j] > 0 else -1.0 for j in range(own)]
    return model.transform(d).select(*df.columns, *((vector_to_array("_p")[j] * sign[j] if j < own else F.lit(0.0)).alias(f"pca_{j + 1}") for j in range(k)))


def silhouette(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(silhouette) with squared distances, from each cluster's size, sums and sums of squares: one pass, no pairs."""
    sq = sum((F.col(c) * F.col(c) for c in columns), F.lit(0.0))
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"), F.sum(sq).alias("_sq"), *(F.sum(c).alias(f"_s_{c}") for c in columns))
    g = g.withColumnRenamed(label, "_other")
    # clusters are few: one row for each
    d = df.withColumn("_r", F.monotonically_increasing_id()).withColumn("_q", sq).join(F.broadcast(g))
    total = F.col("_n") * F.col("_q") + F.col("_sq") - 2 * sum((F.col(c) * F.col(f"_s_{c}") for c in columns), F.lit(0.0))
    own = F.col("_other") == F.col(label)
    d = d.groupBy("_r").agg(F.max(F.when(own, F.when(F.col("_n") > 1, total / F.greatest(F.col("_n") - 1, F.lit(1))))).alias("a"), F.min(F.when(~own, total / F.col("_n"))).alias("b"))
    return d.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12)))).alias("silhouette"))


def indices(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(davies_bouldin, calinski_harabasz) from the clusters' centres and scatter."""
    c = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(f"_c_{x}") for x in columns))
    dist = F.sqrt(sum((F.pow(F.col(x) - F.col(f"_c_{x}"), F.lit(2.0)) for x in columns), F.lit(0.0)))
    s = df.join(F.broadcast(c), label).groupBy(label).agg(F.avg(dist).alias("s"), F.sum(dist * dist).alias("w"))
    c = c.join(s, label)
    a, b = c.select(*(F.col(x).alias(f"a{x}") for x in c.columns)), c.select(*(F.col(x).alias(f"b{x}") for x in c.columns))
    gap = F.sqrt(sum((F.pow(F.col(f"a_c_{x}") - F.col(f"b_c_{x}"), F.lit(2.0)) for x in columns), F.lit(0.0)))
    db = a.join(b, F.col(f"a{label}") != F.col(f"b{label}")).groupBy(f"a{label}").agg(F.max(F.try_divide(F.col("as") + F.col("bs"), gap)).alias("r")).agg(F.avg("r").alias("davies_bouldin"))
    mean = df.agg(*(F.avg(x).alias(f"_m_{x}") for x in columns), F.count(F.lit(1)).alias("_n"))
    between = F.col("n") * sum((F.pow(F.col(f"_c_{x}") - F.col(f"_m_{x}"), F.lit(2.0)) for x in columns), F.lit(0.0))
    ch = c.join(F.broadcast(mean)).agg(F.sum(between).alias("b"), F.sum("w").alias("w"), F.count(F.lit(1)).alias("k"), F.max("_n").alias("n"))
    ch = ch.select(F.try_divide(F.try_divide(F.col("b"), F.col("k") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("k"))).alias("calinski_harabasz"))
    return db.join(F.broadcast(ch))


def euclidean_silhouette(df: DataFrame, columns: list[str], label: str, block: int = 512) -> DataFrame:
    """(silhouette) with Euclidean distances.

    Mean distances to a cluster's rows have no closed form, so blocks of rows meet
    blocks of rows and each pair of blocks is one vectorised product: the work
    grows with the square of the rows, as in the reference, but no task holds
    more than two blocks, and only sums by row and cluster are shuffled.
    """
    import pandas as pd

    n = df.count()
    blocks = max(1, -(-n // block))
    d = df.select(F.col(label).cast("long").alias("c"), F.array(*(F.col(x).cast("double") for x in columns)).alias("v")).withColumn("r", F.monotonically_increasing_id())
    d = d.withColumn("b", F.pmod(F.xxhash64("r"), F.lit(blocks)))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    left = d.withColumn("o", other).select(F.col("b").alias("x"), F.col("o").alias("y"), "r", "c", "v")
    right = d.withColumn("o", other).select(F.col("o").alias("x"), F.col("b").alias("y"), "r", "c", "v")

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"r": [], "c": [], "o": [], "s": []}).astype({"r": "int64", "c": "int64", "o": "int64", "s": "float64"})
        p, q = np.stack(a.v.to_numpy()), np.stack(b.v.to_numpy())
        far = np.sqrt(np.maximum(((p[:, None, :] - q[None, :, :]) ** 2).sum(2), 0))
        names, at = np.unique(b.c.to_numpy(), return_inverse=True)
        s = far @ np.eye(len(names))[at]
        return pd.DataFrame({"r": np.repeat(a.r.to_numpy(), len(names)), "c": np.repeat(a.c.to_numpy(), len(names)), "o": np.tile(names, len(a)), "s": s.ravel()})

    far = left.groupBy("x", "y").cogroup(right.groupBy("x", "y")).applyInPandas(run, "r bigint, c bigint, o bigint, s double")
    size = d.groupBy(F.col("c").alias("o")).agg(F.count(F.lit(1)).alias("n"))  # clusters are few
    far = far.groupBy("r", "c", "o").agg(F.sum("s").alias("s")).join(F.broadcast(size), "o")
    own = F.col("o") == F.col("c")
    g = far.groupBy("r").agg(F.max(F.when(own & (F.col("n") > 1), F.col("s") / F.greatest(F.col("n") - 1, F.lit(1)))).alias("a"), F.min(F.when(~own, F.col("s") / F.col("n"))).alias("b"))
    return g.agg(F.avg(F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12)))).alias("silhouette"))


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the nearest centre, its squared distance) of each row."""
    d = (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1)
    at = d.argmin(1)
    return at, np.maximum(d[np.arange(len(x)), at], 0)


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """First centres from a sample: each with a chance in proportion to the squared distance from those before."""
    centres = [x[rng.integers(len(x))]]
    for _ in range(k - 1):
        far = _nearest(x, np.array(centres))[1]
        total = far.sum()
        centres.append(x[rng.choice(len(x), p=far / total) if total > 0 else rng.integers(len(x))])
    return np.array(centres)


def kmeans(df: DataFrame, columns: list[str], most: int = 10, seed: int = 42, starts: int = 10, rounds: int = 25, sample: int = 4096) -> tuple[DataFrame, list[tuple[int, float, float]]]:
    """(rows with ``cluster``, curve of (k, inertia, silhouette)); the k of the best silhouette from 2 up.

    For each k the best of ``starts`` starts by inertia counts, after at most
    ``rounds`` rounds or when its centres hardly move.  All of them move together: a round is one pass over the rows, and the driver gets sums for each
    centre.  First centres come from ``sample`` rows.  The choice of k takes
    squared distances, which need one pass; ``euclidean_silhouette`` gives the
    other figure for a clustering of moderate size.
    """
    d = df.persist()
    n, curve, best = d.count(), [], None
    ks = range(2, min(most, n - 1) + 1)
    if not ks:
        return df.withColumn("cluster", F.lit(0)), curve
    first = d.select(*(F.col(c).cast("double").alias(c) for c in columns)).orderBy(F.xxhash64(*columns), *columns).limit(sample).toPandas().to_numpy()
    spread = float(first.var(0).mean())
    models = [(k, _spread(first, k, np.random.default_rng(seed + s))) for k in ks for s in range(starts)]
    sums = [f"s{j}" for j in range(len(columns))]

    def one_round(moving: list[int]):
        centres = {m: models[m][1] for m in moving}

        def run(batches):
            for batch in batches:
                x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                rows = []
                for m, c in centres.items():
                    at, far = _nearest(x, c)
                    total = np.zeros_like(c)
                    np.add.at(total, at, x)
                    count, cost = np.bincount(at, minlength=len(c)), np.bincount(at, far, len(c))
                    rows += [(m, j, int(count[j]), float(cost[j]), *total[j].tolist()) for j in range(len(c))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["m", "c", "n", "cost", *sums])

        schema = "m bigint, c bigint, n bigint, cost double, " + ", ".join(f"{c} double" for c in sums)
        g = d.select(*columns).mapInArrow(run, schema).groupBy("m", "c").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), *(F.sum(c).alias(c) for c in sums))
        return g.toPandas()  # one row for each centre

    moving, cost = list(range(len(models))), {}
    for _ in range(rounds):
        got = one_round(moving)
        still = []
        for m, g in got.groupby("m"):
            k, old = models[m]
            new = old.copy()
            g = g[g.n > 0]
            new[g.c.to_numpy()] = g[sums].to_numpy() / g.n.to_numpy()[:, None]
            cost[m] = float(g.cost.sum())
            models[m] = (k, new)
            if ((new - old) ** 2).sum() > 1e-4 * spread:
                still.append(int(m))
        moving = still
        if not moving:
            break
    for k in ks:
        m = min((i for i, (own, _) in enumerate(models) if own == k), key=lambda i: cost[i])
        out = _labelled(d, columns, models[m][1])
        score = silhouette(out, columns, "cluster").first()[0]
        curve.append((k, cost[m], float(score)))
        if best is None or score > best[0]:
            best = (score, out)
    return best[1], curve


def _labelled(df: DataFrame, columns: list[str], centres: np.ndarray) -> DataFrame:
    """``df`` with the number of the nearest centre as ``cluster``."""

    def run(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(_nearest(x, centres)[0].astype(np.int32))], [*batch.schema.names, "cluster"])

    return df.mapInArrow(run, df.withColumn("cluster", F.lit(0)).schema)


def distribution(df: DataFrame, label: str = "cluster") -> DataFrame:
    """(label, n, pct) of each cluster."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return g.join(F.broadcast(g.agg(F.sum("n").alias("_t")))).select(label, "n", (F.col("n") * 100.0 / F.col("_t")).alias("pct"))


def dbscan(df: DataFrame, key: str, columns: list[str], eps: float, least: int) -> DataFrame:
    """(key, cluster): -1 is noise; clusters are named by their least core key, a border row goes to its least core's.

    Neighbours come from a grid of ``eps`` over the first two columns, so only
    rows of touching cells are compared.
    """
    from tremor.operators.graph import components

    cell = [F.floor(F.col(c) / eps).cast("long") for c in columns[:2]]
    p = df.select(F.col(key).alias("a"), *(F.col(c).alias(f"a{i}") for i, c in enumerate(columns)), *(x.alias(f"g{i}") for i, x in enumerate(cell)))
    q = p.toDF(*("b" + c[1:] if c.startswith("a") else c for c in p.columns))
    for i in range(len(cell)):
        q = q.withColumn(f"g{i}", F.explode(F.array(*(F.col(f"g{i}") + s for s in (-1, 0, 1)))))
    far = sum((F.pow(F.col(f"a{i}") - F.col(f"b{i}"), F.lit(2.0)) for i in range(len(columns))), F.lit(0.0))
    near = p.join(q, [f"g{i}" for i in range(len(cell))]).where(far <= eps * eps).select("a", "b")
    core = near.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a")
    links = near.join(core, "a").join(core.withColumnRenamed("a", "b"), "b")
    comp = components(links.where("a <> b"))
    name = core.join(comp, core.a == comp.id, "left").select("a", F.coalesce("component", "a").alias("cluster"))
    border = near.join(name.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("cluster").alias("c"))
    return df.select(F.col(key).alias("a")).join(name, "a", "left").join(border, "a", "left").select(F.col("a").alias(key), F.coalesce("cluster", "c", F.lit(-1)).alias("cluster"))
