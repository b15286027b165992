"""Plans whose text both engines read, against restatements in plain Python and numpy over the raw tables.

What they compute from the files is written here anew, the domain tables included, so a plan that says the wrong
thing in both engines alike is seen.
"""

from __future__ import annotations

import math
import os
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from rippleflow.plans import analytics, catalog, relational

DATA, OEM = "/root/testdata/sf0.001", 10_000_000
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


class World:
    """The supply network and the runs as plain dicts and lists."""

    def __init__(self, data, whole):
        read = lambda name: pd.read_parquet(f"{data}/{name}.parquet").to_dict("records")
        supplier, customer, lines, events = read("supplier"), read("customer"), read("lineitem"), read("events")
        buyer = {o["o_orderkey"]: o["o_custkey"] for o in read("orders")}
        self.nation = {n["n_nationkey"]: n for n in read("nation")}
        self.part = {p["p_partkey"]: p for p in read("part")}
        self.firms = {s["s_suppkey"]: (s["s_nationkey"], False, float(s["s_acctbal"])) for s in supplier}
        self.firms |= {OEM + c["c_custkey"]: (c["c_nationkey"], True, float(c["c_acctbal"])) for c in customer}
        self.can = defaultdict(set)
        orders = defaultdict(list)
        for x in lines:
            self.can[x["l_suppkey"]].add(x["l_partkey"])
            orders[x["l_orderkey"]].append(x)
        self.details = []
        for key, rows in orders.items():
            rows.sort(key=lambda x: (x["l_linenumber"], x["l_partkey"], x["l_suppkey"], x["l_extendedprice"]))
            for i, x in enumerate(rows):
                if x["l_quantity"] < 48 and not whole:
                    continue
                what = (x["l_partkey"], x["l_returnflag"], pd.Timestamp(x["l_shipdate"]).year)
                a = x["l_suppkey"]
                if (whole or a % 5 == 0) and key in buyer:
                    self.details.append((a, OEM + buyer[key], *what))
                if i + 1 < len(rows):
                    b = rows[i + 1]["l_suppkey"]
                    if a != b and (whole or a % 5 == b % 5 + 1 or a % 5 == b % 5 == 4):
                        self.details.append((a, b, *what))
        self.links = Counter((d[0], d[1]) for d in self.details)
        self.noted = {e for e in self.links if sum(e) % 16 == 0}
        self.on_edge = Counter(d[:3] for d in self.details if d[:2] in self.noted)
        out, into = Counter(u for u, _ in self.links), Counter(v for _, v in self.links)
        out_w, in_w = Counter(), Counter()
        for (u, v), w in self.links.items():
            out_w[u] += w
            in_w[v] += w
        self.out, self.into, self.out_w, self.in_w = out, into, out_w, in_w
        self.degree = {f: out[f] + into[f] for f in self.firms}
        self.linked = sorted(f for f, k in self.degree.items() if k)
        self.near = defaultdict(set)
        for u, v in self.links:
            self.near[u].add(v)
            self.near[v].add(u)
        self.pairs = {(min(e), max(e)) for e in self.links}
        self.series = defaultdict(list)
        for e in sorted(events, key=lambda e: (e["user_id"], e["ts"], e["event_id"])):
            self.series[e["user_id"]].append((e["event_id"], float(e["value"])))
        self.value = {r: np.array([v for _, v in s]) for r, s in self.series.items()}
        self.cap = {r: 1000 - np.cumsum(v) / 10 for r, v in self.value.items()}
        self.removed = {r: np.cumsum(v > 50) for r, v in self.value.items()}
        self.struck = defaultdict(dict)  # run -> firm -> seed
        for r, s in self.series.items():
            for week, (e, _) in enumerate(s):
                f = OEM + e % len(customer) if e % 4 == 3 else e % len(supplier)
                self.struck[r][f] = max(self.struck[r].get(f, 0), int(week < self.seeds(r)))

    seeds = staticmethod(lambda r: 1 + r % 5)

    def weeks(self, r):
        return len(self.series[r])

    def cascade(self, r):
        return self.weeks(r) - self.seeds(r)

    def origins(self, r):
        """firm -> origins as drawn, of rows that are no seeds."""
        out = defaultdict(list)
        for firm, (e, _) in enumerate(self.series[r]):
            if firm >= self.seeds(r):
                out[firm].append(firm + 100000 if e % 11 == 0 else e * 13 % max(firm, 1))
                if e % 11 and e % 3:
                    out[firm].append(e * 29 % max(firm, 1))
        return out


@pytest.fixture(scope="module")
def worlds():
    return {whole: World(DATA, whole) for whole in (False, True)}


def modularity(w, of):
    """Sum over all pairs of nodes of A - k k / 2m, of the same group."""
    nodes = sorted({x for e in w.pairs for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    a = np.zeros((len(nodes), len(nodes)))
    for u, v in w.pairs:
        a[at[u], at[v]] = a[at[v], at[u]] = 1
    k, two_m = a.sum(1), a.sum()
    same = np.array([[of(x) == of(y) for y in nodes] for x in nodes])
    return ((a - np.outer(k, k) / two_m) * same).sum() / two_m


def adjacency(w):
    at = {x: i for i, x in enumerate(w.linked)}
    a = np.zeros((len(at), len(at)))
    for u, v in w.links:
        a[at[u], at[v]] = 1
    return a


def triangles(w):
    n = {x: 0 for x in w.near}
    for x in w.near:
        n[x] = sum(1 for y, z in combinations(sorted(w.near[x]), 2) if z in w.near[y])
    return n


def rank(values):
    return pd.Series(values).rank(method="average").to_numpy()


def both(w):
    return np.array([w.into[f] for f in w.linked], float), np.array([w.out[f] for f in w.linked], float)


def corr(x, y):
    return np.corrcoef(x, y)[0, 1]


def residual(y, z):
    x = np.column_stack([np.ones(len(z)), z])
    return y - x @ np.linalg.lstsq(x, y, rcond=None)[0]


def auc(w):
    pos = [(w.out[f], w.degree[f]) for f in w.linked if w.into[f] > 1]
    neg = [(w.out[f], w.degree[f]) for f in w.linked if w.into[f] <= 1]
    won = sum(a * b * ((x > y) + 0.5 * (x == y)) for x, a in pos for y, b in neg)
    return won / (sum(a for _, a in pos) * sum(b for _, b in neg))


def capacity_metrics(w):
    for r, c in w.cap.items():
        drop, gone = -np.diff(c), w.removed[r]
        first = lambda mask: int(np.argmax(mask)) if mask.any() else 0
        yield {
            "run_id": r, "rises": int((drop < 0).sum()), "max_weekly": max(drop) if len(drop) else None, "loss": max(c) - min(c), "t_fast": 1 + int(np.argmax(drop)) if len(drop) else None,
            "t90": first(gone >= 0.9 * gone[-1]), "t50c": first(max(c) - c >= 0.5 * (max(c) - min(c))), "t_min": int(np.argmin(c)),
        }


def tree(w):
    for r in w.series:
        for firm, drawn in w.origins(r).items():
            ok = sorted({o for o in drawn if o < w.weeks(r)})
            yield {"run_id": r, "firm": firm, "parent": ok[0] if ok else 0, "secondary": max(len(ok) - 1, 0)}


def windows(w):
    for n in range(1, 6):
        for a, b in ((2, 6), (6, 10), (10, 16), (16, 25), (25, 53)):
            lost = gone = 0
            for r, c in w.cap.items():
                for week in range(max(a, 1), min(b, len(c))):
                    if w.seeds(r) == n:
                        lost, gone = lost + c[week - 1] - c[week], gone + w.removed[r][week] - w.removed[r][week - 1]
            if gone:
                yield {"num_seeds": n, "a": a, "lost_per_firm": lost / gone}


def exposure(w):
    exposed, passed = Counter(), Counter()
    for hit in w.struck.values():
        for u, v in w.links:
            if u in hit and not hit.get(v, 0):
                exposed[u, v] += 1
                passed[u, v] += v in hit
    return [{"src": u, "dst": v, "exposed": n, "propagated": passed[u, v]} for (u, v), n in exposed.items()]


def exposed_links(w):
    seeds, n = defaultdict(set), Counter()
    for r, hit in w.struck.items():
        seeds[r % 50] |= {f for f, s in hit.items() if s}
        n[r % 50] += 1
    out = Counter()
    for k, firms in seeds.items():
        for u, v in w.links:
            if u in firms and v not in firms:
                out[u, v] += n[k]
    return [{"src": u, "dst": v, "exposures": x} for (u, v), x in out.items()]


def pruned(w, gone):
    return [(u, v) for u, v in w.links if u not in gone and v not in gone]


def in_debt(w):
    """Suppliers of links that report no capabilities: none at all, or in debt."""
    return {f for f in w.out if not (w.can.get(f) and w.firms[f][2] >= 0)}


def kept_firms(w):
    gone = {f for f in w.out if w.firms[f][2] < 0}
    touched = {x for e in pruned(w, gone) for x in e}
    return [{"firm_id": f} for f in w.firms if f not in gone and (f in touched or f in w.can)]


def special_only(w):
    special = lambda p: p % 10 == 0
    for f, own in w.can.items():
        known = {p for p in own if p in w.part}
        if any(map(special, known)) and not (w.firms[f][2] >= 0 and not all(map(special, known))):
            yield {"firm_id": f}


def shared_customers(w, same=lambda d: ()):
    by = defaultdict(set)
    for d in w.details:
        by[(d[1], *same(d))].add(d[0])
    return {(key, u, v) for key, group in by.items() for u in group for v in group if u != v}


def mean_curves(w):
    by = defaultdict(list)
    for r, v in w.value.items():
        for week, x in enumerate(v):
            by[r % 3, week].append(x)
    for (s, week), x in by.items():
        half = 1.96 * np.std(x) / math.sqrt(len(x))
        yield {"scenario": s, "week": week, "n": len(x), "mean": np.mean(x), "low": np.mean(x) - half, "high": np.mean(x) + half}


def ratios(w):
    for s in range(3):
        runs = [r for r in w.value if r % 3 == s]
        yield {"scenario": s, "ratio": sum(w.value[r].sum() for r in runs) / sum(w.weeks(r) ** 2 for r in runs)}


def firsts(w):
    """The least detail of every supplier, by customer, product, model and year."""
    return [{"src": u, "dst": d[1], "product": d[2]} for u in w.out for d in [min(d for d in w.details if d[0] == u)]]


def arms(w):
    """task -> (run of arm 0, run of arm 1), where both ran."""
    return {r // 2: (r, r + 1) for r in w.series if r % 2 == 0 and r + 1 in w.series}


def multi_origin(w):
    rows = list(tree(w))
    week = np.array([x["firm"] for x in rows])
    return {"share": np.mean([x["secondary"] >= 1 for x in rows]), "median": np.median(week), "mean": week.mean(), "p90": np.percentile(week, 90)}


def all_values(w):
    return np.concatenate(list(w.value.values()))


def described(w):
    v = all_values(w)
    return {"low": v.min(), "high": v.max(), "mean": v.mean(), "sd": v.std()} | {k: np.percentile(v, q) for k, q in (("q25", 25), ("q50", 50), ("q75", 75), ("p90", 90), ("p95", 95))}


def clustering(w):
    a = adjacency(w)
    s = a + a.T
    closed, total, mutual = np.diag(s @ s @ s), s.sum(1), np.diag(a @ a)
    return [{"firm_id": f, "c": closed[i] / 2 / (total[i] * (total[i] - 1) - 2 * mutual[i]) if closed[i] else 0} for i, f in enumerate(w.linked)]


def progress(w):
    for r, c in w.cap.items():
        for week, x in enumerate(c):
            yield {"run_id": r, "week": week, "progress": 0 if c[0] == c[-1] else min(max((c[0] - x) / (c[0] - c[-1]), 0), 1)}


def degree_correlations(w):
    side = {"out": w.out, "in": w.into}
    return {f"{a}_{b}": corr([side[a][u] for u, _ in w.links], [side[b][v] for _, v in w.links]) for a in side for b in side}


HAND = {
    "F2_comparison": lambda w: [{"firm_id": f, "degree": k} for f, k in w.degree.items() if k and w.firms[f][1]],
    "F4_not_in_list": lambda w: [{"firm_id": f} for f, k in w.degree.items() if not k],
    "F6_fill_null": lambda w: [{"firm_id": f, "products": len(w.can.get(f, ()))} for f in w.firms],
    "F10_percentile_threshold": lambda w: [{"firm_id": f, "degree": w.degree[f]} for f in w.linked if w.degree[f] > np.percentile([w.degree[x] for x in w.linked], 90)],
    "F12_prune_empty_portfolio": lambda w: [{"src": u, "dst": v, "weight": w.links[u, v]} for u, v in pruned(w, in_debt(w))],
    "F13_prune_isolates": kept_firms,
    "F14_config_filter": lambda w: [{"run_id": r, "scenario": r % 3, "num_seeds": w.seeds(r)} for r in w.series if r % 3 in (0, 2) or (w.seeds(r) == 5 and r % 10 == 0)],
    "J2_inner_details": lambda w: [dict(zip(("src", "dst", "product", "model", "model_year"), d, strict=True)) for d in w.details if d[:2] in w.noted],
    "J4_special_only": special_only,
    "J6_attributes_on_edges": lambda w: [{"src": u, "dst": v, "src_degree": w.degree[u], "dst_degree": w.degree[v]} for u, v in w.links],
    "J7_semi_join": lambda w: [{"firm_id": f} for f in w.firms if w.out[f]],
    "J12_paired_tasks": lambda w: [{"task_id": t, "weeks_a": w.weeks(a), "weeks_b": w.weeks(b), "diff": w.weeks(a) - w.weeks(b)} for t, (a, b) in arms(w).items()],
    "J13_supplier_pairs": lambda w: [{"u": u, "v": v} for u, v in {(u, v) for _, u, v in shared_customers(w, lambda d: d[2:3])}],
    "J15_exposed_links": exposed_links,
    "A1_group_members": lambda w: [{"firm_id": f, "groups": len({w.part[p]["p_brand"] for p in own}), "families": len({w.part[p]["p_type"] for p in own}), "first_group": min(w.part[p]["p_brand"] for p in own)} for f, own in w.can.items()],
    "A2_edge_products": lambda w: [{"src": u, "dst": v, "product": p, "amount": n, "models": len({d[3] for d in w.details if d[:3] == (u, v, p)})} for (u, v, p), n in Counter(d[:3] for d in w.details).items()],
    "A3_count_non_null": lambda w: [{"firm_id": f, "links": w.out[f], "all_rows": max(w.out[f], 1)} for f in w.firms],
    "A5_distinct_counts": lambda w: [{"suppliers": len(w.out), "customers": len(w.into), "products": len({d[2] for d in w.details})}],
    "A6_distinct_first": firsts,
    "A7_means_by_nation": lambda w: [{"nation_id": n, "degree": np.mean([w.degree[f] for f in g]), "in_weight": np.mean([w.in_w[f] for f in g]), "firms": len(g)} for n in w.nation if (g := [f for f, x in w.firms.items() if x[0] == n])],
    "A8_weighted_degree": lambda w: [{"firm_id": f, "nation_name": w.nation[w.firms[f][0]]["n_name"], "in_degree": w.into[f], "out_degree": w.out[f], "strength": w.in_w[f] + w.out_w[f]} for f in w.linked],
    "A9_describe": lambda w: [described(w)],
    "A10_standard_error": lambda w: [{"run_id": r, "sd": v.std(ddof=1), "se": v.std(ddof=1) / math.sqrt(len(v))} for r, v in w.value.items() if len(v) > 1],
    "A11_share": lambda w: [{"arm": a, "share": np.mean([w.weeks(r) > 66 for r in w.series if r % 2 == a])} for a in (0, 1)],
    "A12_most_common": lambda w: [{"nation_id": n, "n": k} for n, k in sorted(Counter(x[0] for x in w.firms.values()).items(), key=lambda x: (-x[1], x[0]))[:5]],
    "A13_arg_max": lambda w: [{"run_id": r, "week": int(np.argmax(v)), "value": v.max()} for r, v in w.value.items()],
    "A14_ratio_of_sums": ratios,
    "A16_sum_by_key": lambda w: [{"dst": v, "weight": x} for v, x in w.in_w.items()],
    "A17_mean_curve": mean_curves,
    "A18_modularity": lambda w: [{"q": modularity(w, lambda f: w.firms[f][0])}],
    "A19_degree_correlation": lambda w: [degree_correlations(w)],
    "W1_ccdf": lambda w: [{"degree": k, "at_least": n, "ccdf": n / len(w.linked)} for k in {w.degree[f] for f in w.linked} for n in [sum(w.degree[f] >= k for f in w.linked)]],
    "W2_ecdf": lambda w: [{"degree": k, "ecdf": np.mean([w.degree[f] <= k for f in w.linked])} for k in {w.degree[f] for f in w.linked}],
    "W3_diff_prepend": lambda w: [{"run_id": r, "week": t, "d": x} for r, c in w.cap.items() for t, x in enumerate(np.diff(c, prepend=0))],
    "W5_first_index": lambda w: [{"run_id": r, "t": int(np.argmax(g >= 3)) if (g >= 3).any() else 0} for r, g in w.removed.items()],
    "W6_arg_min_first": lambda w: [{"run_id": r, "t_min": int(np.argmin(c))} for r, c in w.cap.items()],
    "W8_progress": progress,
    "W9_average_ranks": lambda w: [{"firm_id": f, "r": x} for f, x in zip(w.linked, rank([w.degree[f] for f in w.linked]), strict=True)],
    "W10_quartile_bins": lambda w: [{"bin": b, "n": n} for b, n in Counter(np.searchsorted(np.percentile(all_values(w), (25, 50, 75)), all_values(w), side="right").tolist()).items()],
    "U3_difference": lambda w: [{"firm_id": f} for f in w.into if not w.out[f]],
    "U4_portfolio_union": lambda w: [{"firm_id": f, "products": len(own | {p for u, _, p in w.on_edge if u == f})} for f, own in w.can.items()],
    "G2_undirected": lambda w: [{"u": u, "v": v} for u, v in w.pairs],
    "G17_directed_clustering": clustering,
    "G18_local_clustering": lambda w: [{"firm_id": f, "c": 2 * n / (k * (k - 1)) if (k := len(w.near[f])) > 1 else 0} for f, n in triangles(w).items()],
    "G18_transitivity": lambda w: [{"transitivity": sum(triangles(w).values()) / sum(len(x) * (len(x) - 1) / 2 for x in w.near.values())}],
    "G19_triangles": lambda w: [{"firm_id": f, "triangles": n} for f, n in sorted(triangles(w).items(), key=lambda x: (-x[1], x[0]))[:20] if n],
    "G23_tier_modularity": lambda w: [{"q": modularity(w, lambda f: 0 if f >= OEM else 1 + f % 5)}],
    "G30_partners": lambda w: [{"firm_id": f, "partners": len(x)} for f, x in w.near.items()],
    "C8_dual_sourcing": lambda w: [{"kind": k, "pairs": len({(u, v, key[1]) for key, u, v in shared_customers(w, lambda d: d[2:] if k == "strict" else d[2:3])})} for k in ("strict", "loose")],
    "C10_overlap_recall": lambda w: [{"pairs": len(p), "recalled": sum(bool(w.can[u] & w.can[v]) for u, v in p)} for p in [{(u, v) for _, u, v in shared_customers(w)}]],
    "C15_cascade_size": lambda w: [{"task_id": r // 2, "arm": r % 2, "cascade": w.cascade(r)} for r in w.series],
    "C20_capacity_windows": windows,
    "C23_capacity_metrics": capacity_metrics,
    "C33_multi_origin": lambda w: [multi_origin(w)],
    "C37_cascade_tree": tree,
    "C40_exposure_counts": exposure,
    "C47_product_correlations": lambda w: [{"r_degree": corr([len(x) for x in w.can.values()], [w.degree[f] for f in w.can]), "r_out": corr([len(x) for x in w.can.values()], [w.out[f] for f in w.can])}],
    "N1_pearson": lambda w: [{"r": corr(*both(w)), "n": len(w.linked)}],
    "N3_spearman": lambda w: [{"rho": corr(*map(rank, both(w)))}],
    "N5_partial_correlation": lambda w: [{"r": corr(*(residual(x, sum(both(w)) ** 2) for x in both(w)))}],
    "N8_paired_difference": lambda w: [{"diff": d.mean(), "ratio": a.mean() / b.mean(), "se": d.std(ddof=1) / math.sqrt(len(d))} for a, b in [np.array([[w.weeks(x) for x in p] for p in arms(w).values()]).T] for d in [a - b]],
    "N10_standardise": lambda w: [{"firm_id": f, "z": z} for x in [both(w)[0]] for f, z in zip(w.linked, (x - x.mean()) / x.std(), strict=True)],
    "N11_weighted_auc": lambda w: [{"auc": auc(w)}],
}


def order(row):
    return [("", x) if isinstance(x, str) else ("n", "") if x is None else ("x", round(float(x), 3)) for x in row]


@pytest.mark.parametrize("name", HAND)
def test_means_what_it_says(spark, worlds, name):
    w = worlds[name in relational.WHOLE + analytics.WHOLE]
    df = catalog.queries()[name](spark, DATA)
    want = [dict(r) for r in HAND[name](w)]
    columns = sorted(want[0], key=lambda c: isinstance(want[0][c], (float, np.floating))) if want else df.columns
    assert sorted(columns) == sorted(df.columns)
    got = sorted(([r[c] for c in columns] for r in df.collect()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, sorted(([r[c] for c in columns] for r in want), key=order), strict=True):
        assert [x if x is None or isinstance(x, str) else float(x) for x in a] == [x if x is None or isinstance(x, str) else pytest.approx(float(x), rel=1e-6, abs=2e-6) for x in b], (a, b)
