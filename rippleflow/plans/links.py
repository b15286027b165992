"""Which links pass a disruption on: features of links, and models of how often customers follow their suppliers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import statistics
from ..functions.random import u01
from ..operators.iterate import cut

FEATURES = ["log_pool", "dependence", "log_customer_degree"]
MODELS = {"constant": [], "topology": ["log_customer_degree"], "volume": ["dependence", "log_customer_degree"], "full": FEATURES}


def link_features(edges: DataFrame, edge_products: DataFrame, portfolio: DataFrame, pools: DataFrame) -> DataFrame:
    """src, dst and the features of every link that has a pool.

    log_pool: log of the firms that offer what is like a product, of the scarcest product on an annotated link and the
    mean over the supplier's portfolio on another; dependence: the link's share in the customer's inbound volume, with
    the annotated links' mean weight on the others; log_customer_degree: log of the customer's links.
    """
    scarce = pools.select("product", F.log(F.greatest(F.col("pool"), F.lit(1)).cast("double")).alias("lp"))
    of = lambda df: df.join(scarce, "product", "left").withColumn("lp", F.coalesce("lp", F.lit(0.0)))
    own = of(portfolio.select(F.col("firm_id").alias("src"), "product").distinct()).groupBy("src").agg(F.avg("lp").alias("own"))
    sold = of(edge_products.select("src", "dst", "product")).groupBy("src", "dst").agg(F.min("lp").alias("sold"))
    usual = edges.where("annotated").agg(F.avg("weight").alias("usual"))
    volume = edges.crossJoin(F.broadcast(usual)).select("src", "dst", "annotated", F.when(F.col("annotated"), F.col("weight").cast("double")).otherwise(F.col("usual")).alias("w"))  # usual is one row
    inbound = volume.groupBy("dst").agg(F.sum("w").alias("all"))
    degree = edges.select(F.col("src").alias("dst")).union(edges.select("dst")).groupBy("dst").agg(F.count("*").alias("degree"))
    both = volume.join(inbound, "dst").join(degree, "dst").join(own, "src", "left").join(sold, ["src", "dst"], "left")
    pool = F.when(F.col("annotated"), F.col("sold")).otherwise(F.col("own"))
    out = both.select("src", "dst", pool.alias("log_pool"), (F.col("w") / F.col("all")).alias("dependence"), F.log(F.col("degree").cast("double")).alias("log_customer_degree"))
    return out.where("log_pool is not null")


def link_models(links: DataFrame, folds: int = 5, seed: str = "folds") -> DataFrame:
    """kind, model, term, value: what each model says of links with k of n exposures passed on.

    auc_cv: area under the curve of predictions for suppliers that the fit didn't see; coefficient: weights per standard
    deviation, fitted on all links; auc: area by a feature alone; rate: share passed on by quarter of a feature (limits
    of the quarters to a millionth in rank). The fits share one aggregate a Newton step.
    """
    one = links.where("n > 0").agg(*[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES], *[F.percentile_approx(f, [0.25, 0.5, 0.75], 1_000_000).alias(f"q_{f}") for f in FEATURES]).first()
    if one[f"m_{FEATURES[0]}"] is None:
        return links.sparkSession.createDataFrame([], "kind string, model string, term string, value double")
    z = [((F.col(f) - one[f"m_{f}"]) / (one[f"s_{f}"] or 1.0)).alias(f"z_{f}") for f in FEATURES]
    fold = F.floor(u01([F.lit(seed), F.col("src")]) * folds).cast("int")
    rows = cut(links.where("n > 0").select(*z, *FEATURES, F.col("k").cast("double").alias("k"), F.col("n").cast("double").alias("n"), fold.alias("fold")))
    fits = [(m, out) for m in MODELS for out in [None, *range(folds)]]
    weights = dict(zip(fits, statistics.logistic_fits(rows, [f"z_{f}" for f in FEATURES], "k", "n", "fold", [([f"z_{f}" for f in MODELS[m]], out) for m, out in fits]), strict=True))
    scores = []
    for m, used in MODELS.items():
        by_fold = np.array([weights[m, f] for f in range(folds)])
        at = lambda i: F.element_at(F.array(*[F.lit(float(v)) for v in by_fold[:, i]]), F.col("fold") + 1)  # noqa: E731, B023
        score = at(0) + sum((at(1 + FEATURES.index(f)) * F.col(f"z_{f}") for f in used), F.lit(0.0))
        if used:
            scores.append(F.struct(F.lit("auc_cv").alias("kind"), F.lit(m).alias("model"), F.lit("").alias("term"), score.alias("score")))
    scores += [F.struct(F.lit("auc").alias("kind"), F.lit("").alias("model"), F.lit(f).alias("term"), F.col(f).cast("double").alias("score")) for f in FEATURES]
    names = ["kind", "model", "term"]
    areas = statistics.auc_by(rows.select(F.explode(F.array(*scores)).alias("s"), "k", "n").select("s.*", "k", "n"), "score", "k", "n", names).withColumnRenamed("auc", "value")
    known = [("auc_cv", "constant", "", 0.5)] + [("coefficient", m, f, weights[m, None][1 + FEATURES.index(f)]) for m, used in MODELS.items() for f in used]
    quarter = lambda f: sum((F.when(F.col(f) >= q, 1).otherwise(0) for q in one[f"q_{f}"]), F.lit(0))
    quarters = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("f"), quarter(f).alias("q")) for f in FEATURES])).alias("s"), "k", "n")
    rates = quarters.groupBy("s.f", "s.q").agg((F.sum("k") / F.sum("n")).alias("value")).select(F.lit("rate").alias("kind"), F.lit("").alias("model"), F.concat_ws(" ", "f", F.col("q").cast("string")).alias("term"), "value")
    fixed = links.sparkSession.createDataFrame(known, "kind string, model string, term string, value double")
    return areas.select(*names, "value").unionByName(rates).unionByName(fixed)
