"""Hold-out of imputed products: what draws from suppliers' portfolios give for links whose products are known."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.random import u01
from ..operators.iterate import cut
from ..operators.pools import united

# The exponents that are compared, draws a link, folds.
GAMMAS = (-5.0, -4.0, -3.0, -2.0, -1.5, -1.0, -0.75, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0)
DRAWS, FOLDS = 20, 5


@dataclass
class Holdout:
    """seen (src, dst, product, a, pool): products of annotated links; drawn (gamma, draw, src, dst, product, a, pool)."""

    seen: DataFrame
    drawn: DataFrame
    like: DataFrame


def holdout(observed: DataFrame, portfolio: DataFrame, classes: DataFrame, like: DataFrame, seed: str = "holdout", gammas: tuple[float, ...] = GAMMAS, draws: int = DRAWS) -> Holdout:
    """Draws as many products as a link shows (at most the portfolio), with weights (pool + 1)^gamma.

    classes (product, a) and like (a, b) say which products are alike. A product's pool for a link are the firms that
    offer something like it, without the link's two ends. All gammas share their random numbers.
    """
    portfolio = portfolio.select(F.col("firm_id").alias("src"), "product").distinct()
    offers = portfolio.join(classes, "product").select(F.col("a").alias("b"), F.col("src").alias("firm")).distinct()
    sized = portfolio.groupBy("src").agg(F.count("*").alias("held"))
    shown = observed.select("src", "dst", "product").distinct().join(sized, "src")
    links = shown.groupBy("src", "dst").agg(F.least(F.count("*"), F.max("held")).alias("k"))
    options = links.join(portfolio, "src")
    # Only members that are a link's ends are asked for; a row for every class and firm that offers something like it is never formed.
    both = cut(shown.select("src", "dst", "product").union(options.select("src", "dst", "product")).join(classes, "product").select("src", "dst", "a").distinct())
    ends = both.select("a", F.col("src").alias("firm")).union(both.select("a", "dst")).distinct()
    sizes, members = united(like.select("a", "b"), offers.select("firm", "b"), ends.join(portfolio.select(F.col("src").alias("firm")).distinct(), "firm", "left_semi").select("a", "firm"))
    sizes = sizes.withColumnRenamed("pool", "firms")

    def pooled(df: DataFrame) -> DataFrame:
        of = lambda end: members.select("a", F.col("firm").alias(end), F.lit(1).alias(f"is_{end}"))
        known = df.join(classes, "product", "left").join(sizes, "a", "left").join(of("src"), ["a", "src"], "left").join(of("dst"), ["a", "dst"], "left")
        rest = F.coalesce("firms", F.lit(0)) - F.coalesce("is_src", F.lit(0)) - F.coalesce("is_dst", F.lit(0))
        return known.withColumn("pool", rest.cast("long")).select(*df.columns, "a", "pool")

    seen = cut(pooled(shown.select("src", "dst", "product")))
    options = cut(pooled(options))
    # A link's options lie in one array, as a portfolio is one firm's: all draws are made there, without another shuffle.
    # The number of partitions is given, so that small tables, which grow in the draws only, keep all cores.
    wide = int(options.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    arrays = options.repartition(wide, "src", "dst").groupBy("src", "dst").agg(F.max("k").alias("k"), F.collect_list(F.struct("product", "a", "pool")).alias("items"))
    tried = arrays.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    u = lambda x: u01([F.lit(seed), F.col("src"), F.col("dst"), x["product"], F.col("draw")])
    tried = tried.withColumn("items", F.transform("items", lambda x: F.struct((-F.log(u(x))).alias("e"), x["product"].alias("product"), x["a"].alias("a"), x["pool"].alias("pool"))))
    tried = tried.withColumn("gamma", F.explode(F.array(*map(F.lit, gammas))))
    arrival = lambda x: (x["e"] / F.pow(x["pool"] + F.lit(1.0), F.col("gamma"))).alias("at")
    first = F.slice(F.array_sort(F.transform("items", lambda x: F.struct(arrival(x), x["product"].alias("product"), x["a"].alias("a"), x["pool"].alias("pool")))), 1, F.col("k").cast("int"))
    drawn = tried.select("gamma", "draw", "src", "dst", F.explode(first).alias("x")).select("gamma", "draw", "src", "dst", "x.product", "x.a", "x.pool")
    return Holdout(seen, cut(drawn), like)


def _ks(counts: DataFrame, by: list[str]) -> DataFrame:
    """by, ks: greatest gap between two distributions, from counts x and y by distinct pool."""
    run, whole = Window.partitionBy(*by).orderBy("pool"), Window.partitionBy(*by)
    part = lambda c: F.sum(c).over(run) / F.sum(c).over(whole)
    return counts.withColumn("gap", F.abs(part("x") - part("y"))).groupBy(*by).agg(F.max("gap").alias("ks"))


def _ranked(df: DataFrame, value: str, rank: str) -> DataFrame:
    """df with average ranks by gamma, through counts of distinct values."""
    counts = df.groupBy("gamma", value).agg(F.count("*").alias("c"))
    up_to = F.sum("c").over(Window.partitionBy("gamma").orderBy(value))
    return df.join(counts.select("gamma", value, (up_to - (F.col("c") - 1) / 2).alias(rank)), ["gamma", value])


def _summary(prefix: str, pool: Column) -> list[Column]:
    share = lambda test: F.avg(test.cast("double"))
    return [F.percentile(pool, F.lit(0.5)).alias(f"{prefix}median"), share(pool <= 10).alias(f"{prefix}share_le10"), share(pool == 0).alias(f"{prefix}share_zero")]


def report(h: Holdout) -> DataFrame:
    """A row a gamma: drawn products, recall of alike products, pools of drawn products and of each link's scarcest
    (median over draws), rank correlation of the scarcest with the observed one
    (null where either is constant), distance (KS) of the pools."""
    pools = h.drawn.groupBy("gamma").agg(F.count("*").alias("drawn"), *_summary("", F.col("pool")))
    want = h.seen.select("src", "dst", F.col("product").alias("p"), F.col("a").alias("pa"))
    same = h.like.select(F.col("a").alias("pa"), F.col("b").alias("a"), F.lit(1).alias("alike"))
    met = h.drawn.join(want, ["src", "dst"]).join(same, ["pa", "a"], "left")
    hit = met.groupBy("gamma", "draw", "src", "dst", "p").agg(F.max(((F.col("product") == F.col("p")) | F.col("alike").isNotNull()).cast("int")).alias("hit"))
    recall = hit.groupBy("gamma").agg(F.avg("hit").alias("recall"))
    least = h.drawn.groupBy("gamma", "draw", "src", "dst").agg(F.min("pool").alias("m")).groupBy("gamma", "src", "dst").agg(F.percentile("m", F.lit(0.5)).alias("imputed"))
    scarce = cut(least.join(h.seen.groupBy("src", "dst").agg(F.min("pool").alias("real")), ["src", "dst"]))
    scarcest = scarce.groupBy("gamma").agg(*_summary("scarcest_", F.col("imputed")))
    spread = F.stddev_pop("ri") * F.stddev_pop("rr")
    rank = _ranked(_ranked(scarce, "imputed", "ri"), "real", "rr").groupBy("gamma").agg((F.covar_pop("ri", "rr") / F.nullif(spread, F.lit(0.0))).alias("spearman"))
    gammas = h.drawn.select("gamma").distinct()
    counts = h.drawn.groupBy("gamma", "pool").agg(F.count("*").alias("x")).withColumn("y", F.lit(0).cast("long"))
    real = h.seen.groupBy("pool").agg(F.count("*").alias("y")).crossJoin(F.broadcast(gammas)).select("gamma", "pool", F.lit(0).cast("long").alias("x"), "y")  # a row a gamma
    ks = _ks(counts.unionByName(real).groupBy("gamma", "pool").agg(F.sum("x").alias("x"), F.sum("y").alias("y")), ["gamma"])
    return pools.join(recall, "gamma").join(scarcest, "gamma").join(rank, "gamma").join(ks, "gamma")


def by_folds(h: Holdout, seed: str = "cv", folds: int = FOLDS) -> DataFrame:
    """fold, gamma, ks, ks_uniform: the gamma of the least distance on the other folds' links (the first of equal ones),
    and its distance and that of gamma 0 on the fold's."""
    fold = F.floor(u01([F.lit(seed), F.col("src"), F.col("dst")]) * folds).cast("int")
    gammas = h.drawn.select("gamma").distinct()
    x = h.drawn.groupBy("gamma", fold.alias("own"), "pool").agg(F.count("*").alias("x")).withColumn("y", F.lit(0).cast("long"))
    y = h.seen.groupBy(fold.alias("own"), "pool").agg(F.count("*").alias("y")).crossJoin(F.broadcast(gammas)).select("gamma", "own", "pool", F.lit(0).cast("long").alias("x"), "y")
    both = x.unionByName(y).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    sides = both.groupBy("gamma", "fold", (F.col("own") == F.col("fold")).alias("test"), "pool").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    ks = cut(_ks(sides, ["gamma", "fold", "test"]))
    best = ks.where("NOT test").groupBy("fold").agg(F.min(F.struct("ks", "gamma"))["gamma"].alias("gamma"))
    test = ks.where("test").select("fold", "gamma", "ks")
    return best.join(test, ["fold", "gamma"], "left").join(test.where("gamma = 0").select("fold", F.col("ks").alias("ks_uniform")), "fold", "left")
