"""Disruption cascades on the supply network: many runs at once, each a fold over ticks inside one task.

Ticks of a run are sequential by nature (a request that one supplier accepts is withdrawn from the others before
they choose), runs are independent. So runs are rows, dealt over the cluster by run id, and each task folds its
runs over a network that is broadcast once; its size is checked first. Draws are counter-based: a run's result
depends on its own row only, not on partitioning, retries or other runs.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator, Mapping
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a network that is broadcast: links take some hundreds of bytes in a task, capabilities 8 to 16. A network with more than
#: LARGE firms and links is held by a task on every fourth core only.
MOST_EDGES, MOST_CAPABILITIES, LARGE, SLICE = 2_000_000, 150_000_000, 500_000, 8_000_000
#: A run's configuration: rule is overlap (any shared product), specific (alike products) or hybrid.
CONFIG = "run_id bigint, seeds array<bigint>, rule string, until int, parallel int, margin double"
#: Columns that a configuration may have besides: with sigma, removal is drawn from a normal within lb .. ub instead of a margin.
OPTIONS = "sigma double, lb double, ub double"
_SIDES = ["in_degree", "out_degree", "degree", "w_in_degree", "w_out_degree", "w_degree"]
#: The weekly series of a run. Degrees and volumes (w_) of removed and disrupted firms are those that they began with.
METRICS = [
    *["num_nodes", "num_edges", "num_searching", "num_open_searches", "cap_searching", "num_affected", "num_removed", "num_removed_edges"],
    *[f"{x}_removed" for x in _SIDES],
    *["num_disrupted", *[f"{x}_disrupted" for x in _SIDES]],
    *["num_isolates", "num_components", "open_cap", "edge_cap", "total_cap"],
]
#: A run that fails gives one row with its error and nothing else.
SERIES = f"run_id bigint, week bigint, {', '.join(f'{m} bigint' for m in METRICS)}, violations bigint, error string"
FIRMS = "run_id bigint, firm_id bigint, kind string, size bigint, tier bigint, k double, request_cap bigint, disruption_time bigint, removal_time bigint, origins array<bigint>, error string"


class Lists(Mapping):
    """Distinct values by key, sorted, in arrays: whole numbers of 4 bytes where they fit."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.lexsort((values, keys))
        keys, values = keys[order], values[order]
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]) | (values[1:] != values[:-1])
        self.names, start = np.unique(keys[new], return_index=True)
        self.held, self.start = values[new], np.append(start, new.sum())

    def _at(self, key) -> int:
        i = int(np.searchsorted(self.names, key))
        return i if i < len(self.names) and self.names[i] == key else -1

    def __getitem__(self, key) -> list[int]:
        if (i := self._at(key)) < 0:
            raise KeyError(key)
        return self.held[self.start[i] : self.start[i + 1]].tolist()

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.names, self.start, self.held

    @classmethod
    def of(cls, names: np.ndarray, start: np.ndarray, held: np.ndarray) -> Lists:
        out = cls.__new__(cls)
        out.names, out.start, out.held = names, start, held
        return out

    def __iter__(self) -> Iterator[int]:
        return iter(self.names.tolist())

    def __len__(self) -> int:
        return len(self.names)


@dataclass
class World:
    """What all runs share. Volumes are whole numbers: products' amounts per edge."""

    size: dict[int, int] = field(default_factory=dict)
    k: dict[int, float] = field(default_factory=dict)
    cap: dict[int, int] = field(default_factory=dict)
    #: A firm's products and a product's firms.
    portfolio: Mapping[int, Collection[int]] = field(default_factory=dict)
    offers: Mapping[int, Collection[int]] = field(default_factory=dict)
    alike: dict[int, list[tuple[int, float]]] = field(default_factory=dict)
    #: Where products share vectors: a product's vector and a vector's products; alike is then by vector.
    vector: dict[int, int] = field(default_factory=dict)
    products: dict[int, list[int]] = field(default_factory=dict)
    edges: dict[tuple[int, int], dict[int, int]] = field(default_factory=dict)
    trials: dict[tuple[int, int], int] = field(default_factory=dict)
    tier: dict[int, int] = field(default_factory=dict)


def _columns(df: DataFrame, rows: int) -> list[np.ndarray]:
    """The columns of a table of two whole numbers, in slices of its rows; of 4 bytes where all fit."""
    a, b = df.columns
    top = df.agg(F.max(F.greatest(F.abs(a), F.abs(b)))).first()[0] or 0
    kind = "int" if top < 1 << 31 else "long"
    slices = max(1, -(-rows // SLICE))
    one = lambda i: df.where(F.pmod(F.xxhash64(a, b), F.lit(slices)) == i).select(F.col(a).cast(kind), F.col(b).cast(kind)).toArrow()
    parts = [[c.to_numpy() for c in one(i).columns] for i in range(slices)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)]


def load_world(firms: DataFrame, edges: DataFrame, budgets: DataFrame, capabilities: DataFrame, alike: DataFrame, vectors: DataFrame | None = None) -> World:
    """firms (firm_id, size, k, cap and, if known, tier), edges (src, dst, product, amount), budgets (src, dst, max_trials), capabilities, alike (product, alt, score).

    With vectors (product, vector), product and alt of alike are vectors.
    """
    rows = capabilities.count()
    if edges.count() > MOST_EDGES or rows > MOST_CAPABILITIES:
        raise ValueError("the network is too large to share with every task")
    w = World()
    tiered = "tier" in firms.columns
    for r in firms.toLocalIterator():
        w.size[r["firm_id"]], w.k[r["firm_id"]], w.cap[r["firm_id"]] = r["size"], r["k"], r["cap"]
        if tiered and r["tier"] is not None:
            w.tier[r["firm_id"]] = r["tier"]
    own = [(r["src"], r["product"]) for r in edges.select("src", "product").distinct().toLocalIterator()]
    for r in edges.orderBy("src", "dst", "product").toLocalIterator():
        w.edges.setdefault((r["src"], r["dst"]), {})[r["product"]] = r["amount"]
    for r in budgets.toLocalIterator():
        w.trials[r["src"], r["dst"]] = r["max_trials"]
    pairs = defaultdict(list)
    for r in alike.orderBy("product", "alt").toLocalIterator():
        pairs[r["product"]].append((r["alt"], r["score"]))
    for r in vectors.orderBy("product").toLocalIterator() if vectors is not None else ():
        w.vector[r["product"]] = r["vector"]
        w.products.setdefault(r["vector"], []).append(r["product"])
    added = np.array(own, np.int64).reshape(-1, 2)
    firm, product = (np.concatenate([x, y if y.max(initial=0) >= 1 << 31 else y.astype(x.dtype)]) for x, y in zip(_columns(capabilities.select("firm_id", "product"), rows), added.T, strict=True))
    w.portfolio, w.offers = Lists(firm, product), Lists(product, firm)
    w.alike = dict(pairs)
    return w


def alternatives(w: World, product: int | None) -> list[tuple[int, float]]:
    """The products alike to one, with scores, in their order."""
    if not w.vector:
        return w.alike.get(product, [])
    return sorted((p, score) for v, score in w.alike.get(w.vector.get(product), ()) for p in w.products.get(v, ()))


@dataclass(eq=False)
class Search:
    customer: int
    lost: int
    product: int | None
    amount: int
    limit: int
    options: dict[int, tuple[float, int | None]]
    trials: int = 0
    open: bool = True
    asked: dict[int, tuple[float, int | None]] = field(default_factory=dict)


class Run:
    """One cascade. Odd ticks: shocks reach customers, who look for others; even ticks: answers, failures, removals."""

    def __init__(self, world: World, run_id: int, seeds: list[int], rule: str, parallel: int = 3, margin: float = 0.1, normal: tuple[float, float, float] | None = None):
        """normal: deviation and bounds of the draw of a removal's probability; without it the draw is uniform within the margin."""
        self.normal = normal
        self.w, self.id, self.rule, self.parallel, self.margin = world, run_id, rule, parallel, margin
        self.alive = set(world.size)
        self.out: dict[int, dict[int, dict]] = defaultdict(dict)
        self.into: dict[int, set[int]] = defaultdict(set)
        for (s, c), products in world.edges.items():
            if s in self.alive and c in self.alive:
                self.out[s][c] = dict(products)
                self.into[c].add(s)
        self.free = dict(world.cap)
        self.first_in = {f: self._volume_in(f) for f in self.alive}
        self.first_out = {f: self._volume_out(f) for f in self.alive}
        self.searches: dict[int, list[Search]] = {}
        self.requests: dict[int, list[Search]] = {}
        self.disrupted: dict[int, int] = {}
        self.origins: dict[int, list[int]] = defaultdict(list)
        self.removed: dict[int, int] = {}
        self.disruption_time: dict[int, int] = {}
        self.affected: set[int] = set()
        self.removed_edges = 0
        self.suppliers = {f: len(self.into[f]) for f in self.alive}
        self.customers = {f: len(self.out[f]) for f in self.alive}
        self.struck = [s for s in sorted(set(seeds)) if s in self.alive]
        self.seeds, self.tick = list(self.struck), 0
        sizes = [math.log(max(1, x)) for x in world.size.values()] or [0.0]
        self.low, self.high = min(sizes), max(sizes)
        self.series: list[tuple] = []

    def _volume_out(self, f: int) -> int:
        return sum(sum(p.values()) for p in self.out[f].values())

    def _volume_in(self, f: int) -> int:
        return sum(sum(self.out[s][f].values()) for s in self.into[f])

    def _u(self, *keys) -> float:
        text = "|".join(map(str, (self.id, self.tick, *keys)))
        return (int(hashlib.md5(text.encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496.0

    def _race(self, weighted: list[tuple[float, object, tuple]]) -> list:
        """Items in the order of a weighted draw without replacement."""
        return [x for *_, x in sorted(((-math.log(self._u(*key)) / w, i, x) for i, (w, x, key) in enumerate(weighted) if w > 0), key=lambda t: t[:2])]

    # Opening searches -----------------------------------------------------------------------------------------

    def _pool(self, lost: int, product: int | None) -> dict[int, tuple[float, int | None]]:
        """Possible suppliers with weights and the product that they would send, by rule."""
        own, found = self.w.portfolio.get(lost, ()), {}
        if self.rule == "specific":
            for alt, score in alternatives(self.w, product):
                for f in self.w.offers.get(alt, ()):
                    if f not in found or score > found[f][0]:
                        found[f] = (score, alt)
        else:
            shared = Counter()  # how many of the lost firm's products each firm offers
            for p in sorted(own):
                shared.update(self.w.offers.get(p, ()))
            found = {f: (n / len(own), product) for f, n in shared.items()}
        return found

    def _open(self, customer: int, lost: int, pools: dict) -> None:
        limit = self.w.trials.get((lost, customer), 10)
        wanted = [(None, 1)] if self.rule == "overlap" else sorted(self.out[lost][customer].items())
        for product, amount in wanted:
            key = product if self.rule == "specific" else None
            if key not in pools:
                pools[key] = self._pool(lost, product)
            options = {f: (x, product if a is None else a) for f, (x, a) in pools[key].items() if f not in (customer, lost)}
            self.searches.setdefault(customer, []).append(Search(customer, lost, product, amount, limit, options))

    # Ticks ----------------------------------------------------------------------------------------------------

    def odd(self) -> None:
        struck = set(self.struck)
        for n in self.struck:
            pools: dict = {}
            for s in sorted(self.into[n]):
                if s in self.alive and s not in struck:
                    self.free[s] = self.free.get(s, 0) + sum(self.out[s][n].values())
            for c in sorted(self.out[n]):
                if c in self.alive and c not in struck:
                    self.affected.add(c)
                    self._open(c, n, pools)
        gone = struck | (set(self.w.size) - self.alive)
        for c in sorted(self.searches):
            if c in gone:
                continue
            for i, search in enumerate(self.searches[c]):
                search.options = {f: x for f, x in search.options.items() if f not in gone}
                near = self.into[c] | set(self.out[c])
                weighted = [(x * (self.w.k.get(c, 1.0) if f in near else 1.0), f, ("ask", c, i, f)) for f, (x, _) in search.options.items()]
                if weighted:
                    for f in self._race(weighted)[: self.parallel]:
                        self.requests.setdefault(f, []).append(search)
                        search.asked[f] = search.options.pop(f)
                    search.trials += 1
        self._remove()

    def _remove(self) -> None:
        for n in self.struck:
            self.alive.discard(n)
            self.removed[n] = self.tick
            suppliers, customers = self.into.pop(n, set()), self.out.pop(n, {})
            self.removed_edges += len(suppliers) + len(customers)
            for s in suppliers:
                self.out[s].pop(n, None)
            for c in customers:
                self.into[c].discard(n)
            self.searches.pop(n, None)
            self.disrupted.pop(n, None)
        self.struck = []

    def _accept(self, supplier: int, search: Search) -> None:
        product = search.asked[supplier][1]
        held = self.out[supplier].setdefault(search.customer, {})
        held[product] = held.get(product, 0) + search.amount
        self.into[search.customer].add(supplier)
        self.free[supplier] -= search.amount
        search.open = False

    def even(self) -> None:
        for supplier, asked in self.requests.items():  # in order of first requests
            if supplier not in self.alive:
                continue
            near = self.into[supplier] | set(self.out[supplier])
            for partners in (True, False):
                fit = [(float(self.w.size[s.customer]), s, ("take", supplier, i)) for i, s in enumerate(asked) if s.open and s.customer in self.alive and (s.customer in near) == partners]
                for s in self._race(fit):
                    if s.amount <= self.free[supplier]:  # what doesn't fit now never will
                        self._accept(supplier, s)
        self.requests = {}
        for c in sorted(self.searches):
            still, failed = [], []
            for s in self.searches[c]:
                if s.open:
                    (failed if s.trials >= s.limit or not s.options else still).append(s)
            if failed:
                self.disrupted.setdefault(c, self.tick)
                self.disruption_time.setdefault(c, self.tick)
                self.origins[c] += [s.lost for s in failed]
            self.searches[c] = still
        self.searches = {c: s for c, s in self.searches.items() if s}
        self.struck = [f for f in sorted(self.disrupted) if self._u("fall", f) < self.fall(f)]

    def fall(self, f: int) -> float:
        """Probability that a disrupted firm goes: the greater its loss and the smaller it is, the likelier."""
        start = self.first_in[f]
        lost = (start - self._volume_in(f)) / start if start else 0.0
        if lost <= 0:
            return 0.0
        p = 1 - (math.log(max(1, self.w.size[f])) - self.low + 1) / (self.high - self.low + 1) * (1 - lost)
        if self.normal:
            sigma, low, high = self.normal
            law = NormalDist(p, sigma)
            a, b = law.cdf(low), law.cdf(high)
            u = min(max(a + self._u("margin", f) * (b - a), 1e-300), 1 - 1e-16)
            return min(max(law.inv_cdf(u), low), high)
        a, b = max(p - self.margin, 0.0), min(p + self.margin, 1.0)
        return a + self._u("margin", f) * (b - a)

    def _components(self) -> tuple[int, int]:
        """Firms without links, and weak components (a firm without links is one)."""
        root = {f: f for f in self.alive}

        def top(f: int) -> int:
            while root[f] != f:
                root[f] = root[root[f]]
                f = root[f]
            return f

        for s in self.alive:
            for c in self.out[s]:
                root[top(s)] = top(c)
        return sum(not self.out[f] and not self.into[f] for f in self.alive), sum(root[f] == f for f in root)

    def _sides(self, firms) -> list[int]:
        a, b = sum(self.suppliers[f] for f in firms), sum(self.customers[f] for f in firms)
        x, y = sum(self.first_in[f] for f in firms), sum(self.first_out[f] for f in firms)
        return [a, b, a + b, x, y, x + y]

    def note(self) -> None:
        edges = sum(len(self.out[s]) for s in self.alive)
        volume = sum(self._volume_out(s) for s in self.alive)
        free = sum(self.free.get(f, 0) for f in self.alive)
        searches = [s for mine in self.searches.values() for s in mine]
        state = [len(self.alive), edges, len(self.searches), len(searches), sum(s.amount for s in searches), len(self.affected), len(self.removed), self.removed_edges]
        self.series.append((self.id, self.tick // 2, *state, *self._sides(self.removed), len(self.disrupted), *self._sides(self.disrupted), *self._components(), free, volume, free + volume, self.violations()))

    def violations(self) -> int:
        """Firms with negative capacity, or whose volume and capacity don't add up to the first ones."""
        bad = 0
        for f in self.alive:
            free = self.free.get(f, 0)
            bad += free < 0 or (self._volume_out(f) + free != self.first_out[f] + self.w.cap.get(f, 0) and not self.struck)
        return bad

    def go(self, until: int) -> Run:
        self.note()
        for t in range(1, until):
            self.tick = t
            if t % 2:
                self.odd()
            else:
                self.even()
                self.note()
        self.tick = until
        struck = set(self.struck)
        for n in self.struck:
            for s in self.into[n]:
                if s in self.alive and s not in struck:
                    self.free[s] = self.free.get(s, 0) + sum(self.out[s][n].values())
        self._remove()
        self.note()
        return self

    def firms(self) -> list[tuple]:
        """Records of the seeds, of all removed firms (seeds included) and of those disrupted at the end."""

        def record(f: int, kind: str) -> tuple:
            w = self.w
            return (self.id, f, kind, w.size[f], w.tier.get(f), float(w.k.get(f, 1.0)), w.cap.get(f, 0), self.disruption_time.get(f), self.removed.get(f), list(self.origins[f]))

        return [*[record(f, "seed") for f in self.seeds], *[record(f, "removed") for f in sorted(self.removed)], *[record(f, "disrupted") for f in sorted(self.disrupted)]]


def simulate(configs: DataFrame, world: World, what: str = "series") -> DataFrame:
    """One row a run and week (series), or a run and firm (firms). configs has the columns of CONFIG, and of OPTIONS if need be.

    A run that fails doesn't stop the others: its only row holds its error.
    """
    spark = configs.sparkSession
    # This module's code travels with the tasks, and the world as plain values, so tasks need not import them.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    shared, schema = spark.sparkContext.broadcast({k: x.arrays() if isinstance(x, Lists) else x for k, x in vars(world).items()}), SERIES if what == "series" else FIRMS
    names = [c.split()[0] for c in schema.split(", ")]

    def one(c, world: World) -> list[tuple]:
        try:
            sigma = getattr(c, "sigma", None)
            normal = None if sigma is None or sigma != sigma else (float(sigma), float(c.lb), float(c.ub))
            run = Run(world, c.run_id, [int(s) for s in c.seeds], c.rule, int(c.parallel), float(c.margin), normal).go(int(c.until))
            return [(*x, None) for x in (run.series if what == "series" else run.firms())]
        except Exception as e:  # noqa: BLE001  the run's record says what went wrong
            return [(c.run_id, *[None] * (len(names) - 2), f"{type(e).__name__}: {e}")]

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here = World(**{k: Lists.of(*x) if isinstance(x, tuple) else x for k, x in shared.value.items()})
        for part in parts:
            for c in part.itertuples():
                yield pd.DataFrame(one(c, here), columns=names, dtype=object)

    cores = spark.sparkContext.defaultParallelism
    tasks = max(1, min(configs.count(), 4 * cores if len(world.size) + len(world.edges) <= LARGE else cores // 4))
    return configs.repartition(tasks, "run_id").mapInPandas(fold, schema)


def whole(out: DataFrame) -> DataFrame:
    """simulate()'s rows where no run failed; fails with the run's error otherwise, for results that don't show it."""
    failed = F.raise_error(F.concat(F.lit("run "), F.col("run_id").cast("string"), F.lit(": "), F.col("error")))
    return out.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(failed.cast("boolean")))


def with_differences(series: DataFrame) -> DataFrame:
    """series with diff_<metric>: each week's change, the first week's value itself."""
    by = Window.partitionBy("run_id").orderBy("week")
    return series.select("*", *[(F.col(m) - F.coalesce(F.lag(m).over(by), F.lit(0))).alias(f"diff_{m}") for m in METRICS])


def records(configs: DataFrame, series: DataFrame, firms: DataFrame) -> DataFrame:
    """One row a run, in the shape of the run files that sources.tables reads: arrays of the series and of their changes,
    the seeds', removed and disrupted firms' records, and the seeds' sums; or the run's error."""
    metrics = [*METRICS, *[f"diff_{m}" for m in METRICS]]
    weekly = with_differences(series.where("error IS NULL")).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("week", *metrics))).alias("w"))
    kept = firms.where("error IS NULL").select("run_id", "kind", F.struct(F.col("firm_id").alias("id"), "size", "tier", "k", "request_cap", "disruption_time", "removal_time", F.col("origins").alias("disruption_origin")).alias("r"))
    lists = kept.groupBy("run_id").agg(*[F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("r")))).alias(name) for kind, name in (("seed", "seeds"), ("removed", "removed"), ("disrupted", "disrupted"))])
    failed = series.where("error IS NOT NULL").groupBy("run_id").agg(F.min("error").alias("error"))
    out = configs.select("run_id", "rule", F.size("seeds").alias("num_seeds")).join(weekly, "run_id", "left").join(lists, "run_id", "left").join(failed, "run_id", "left")
    return out.select(F.col("run_id").alias("task_id"), "rule", "num_seeds", *[F.col("w").getField(m).cast("array<double>").alias(m) for m in metrics], "seeds", "removed", "disrupted", "error")
