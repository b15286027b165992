"""The steps of a tick as relational plans over one state: shocks, searches, requests, answers, failures, removals.

`simulate.Run` folds the same steps over whole runs; here each step is one plan over the network in which the six
largest suppliers have just been struck, so every rule can be read and checked by itself.
"""

from __future__ import annotations

_STRUCK = "struck AS (SELECT firm_id FROM {degrees} WHERE out_degree > 0 ORDER BY out_degree DESC, firm_id LIMIT 6)"
_U = "@u01(concat_ws('|', '%s', CAST(%s AS VARCHAR(24)), CAST(%s AS VARCHAR(24))))"
# Customers of struck firms, with what they lost.
_LOST = f"{_STRUCK}, lost AS (SELECT r.dst AS customer, r.src AS firm, r.weight AS amount FROM {{relations}} r JOIN struck s ON r.src = s.firm_id LEFT ANTI JOIN struck t ON r.dst = t.firm_id)"
_CAN = "can AS (SELECT firm_id, product FROM {capabilities})"
# Overlap rule: rivals share a product; the weight is the share of the lost firm's products.
_OVERLAP = f"""{_LOST}, {_CAN}, n_of AS (SELECT firm_id, count(*) AS n FROM can GROUP BY firm_id), rival AS (SELECT a.firm_id AS firm, b.firm_id AS alt, count(*) / (1.0 * max(n.n)) AS weight FROM can a JOIN struck s ON a.firm_id = s.firm_id JOIN can b ON a.product = b.product AND a.firm_id <> b.firm_id JOIN n_of n ON a.firm_id = n.firm_id GROUP BY a.firm_id, b.firm_id),
    options AS (SELECT l.customer, l.firm, r.alt, r.weight FROM lost l JOIN rival r ON l.firm = r.firm AND r.alt <> l.customer LEFT ANTI JOIN struck t ON r.alt = t.firm_id)"""
# Specific rule: one search for each lost product; firms are weighted by their best alike product, found once a vector.
_SPECIFIC = f"""{_STRUCK}, wanted AS (SELECT e.dst AS customer, e.src AS firm, e.product, e.amount, e.product % z.vectors AS a FROM {{edge_products}} e CROSS JOIN {{sizes}} z),
    offers AS (SELECT DISTINCT c.firm_id, c.product % z.vectors AS b FROM {{capabilities}} c CROSS JOIN {{sizes}} z),
    best AS (SELECT p.a, o.firm_id, max(p.score) AS score FROM (SELECT DISTINCT a FROM wanted) w JOIN {{alike}} p ON w.a = p.a AND p.score > 0.3 JOIN offers o ON p.b = o.b GROUP BY p.a, o.firm_id),
    options AS (SELECT w.customer, w.firm, w.product, w.amount, o.firm_id AS alt, o.score FROM wanted w JOIN best o ON w.a = o.a AND o.firm_id <> w.customer AND o.firm_id <> w.firm)"""
# Three candidates a search, by an exponential race; partners count one and a half times.
_ASKED = f"""{_OVERLAP}, asked AS (SELECT customer, firm, alt FROM (SELECT o.customer, o.firm, o.alt, row_number() OVER (PARTITION BY o.customer, o.firm ORDER BY -ln({_U % ('ask', 'o.customer * 100000 + o.firm', 'o.alt')}) / (o.weight * CASE WHEN n.v IS NULL THEN 1.0 ELSE 1.5 END), o.alt) AS place
        FROM options o LEFT JOIN {{neighbours}} n ON o.customer = n.u AND o.alt = n.v) x WHERE place <= 3)"""
_FREE = "free AS (SELECT firm_id, 1 + firm_id % 4 AS cap FROM {degrees})"
# Suppliers answer partners first, then others, larger ones likelier, as many as their capacity allows.
_TAKEN = f"""{_ASKED}, {_FREE}, ranked AS (SELECT a.customer, a.firm, a.alt, f.cap, row_number() OVER (PARTITION BY a.alt ORDER BY CASE WHEN n.v IS NULL THEN 1 ELSE 0 END, -ln({_U % ('take', 'a.alt', 'a.customer * 100000 + a.firm')}) / d.degree, a.customer, a.firm) AS place
        FROM asked a JOIN free f ON a.alt = f.firm_id JOIN {{degrees}} d ON a.customer = d.firm_id LEFT JOIN {{neighbours}} n ON a.alt = n.u AND a.customer = n.v),
    taken AS (SELECT customer, firm, alt FROM (SELECT customer, firm, alt, row_number() OVER (PARTITION BY customer, firm ORDER BY alt) AS k FROM ranked WHERE place <= cap) y WHERE k = 1)"""
_FAILED = f"{_TAKEN}, failed AS (SELECT l.customer, l.firm FROM lost l LEFT ANTI JOIN taken t ON l.customer = t.customer AND l.firm = t.firm WHERE (l.customer + l.firm) % 3 <> 0)"
_FALL = f"""{_FAILED}, inbound AS (SELECT dst, sum(weight) AS w FROM {{relations}} GROUP BY dst), gone AS (SELECT dst, sum(weight) AS w FROM {{relations}} r JOIN struck s ON r.src = s.firm_id GROUP BY dst),
    share AS (SELECT f.customer, 1.0 * g.w / i.w AS lost, ln(d.degree) AS size FROM (SELECT DISTINCT customer FROM failed) f JOIN inbound i ON f.customer = i.dst JOIN gone g ON f.customer = g.dst JOIN {{degrees}} d ON f.customer = d.firm_id),
    bounds AS (SELECT min(ln(degree)) AS low, max(ln(degree)) AS high FROM {{degrees}} WHERE degree > 0),
    p AS (SELECT s.customer, s.lost, CASE WHEN s.lost = 0 THEN 0.0 ELSE 1 - ((s.size - b.low + 1) / (b.high - b.low + 1)) * (1 - s.lost) END AS p FROM share s CROSS JOIN bounds b),
    drawn AS (SELECT customer, p, greatest(p - 0.1, 0.0) + {_U % ('margin', 'customer', '0')} * (least(p + 0.1, 1.0) - greatest(p - 0.1, 0.0)) AS q FROM p)"""

# Quantile of the normal distribution, as functions/random.py has it.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0]


def _horner(coefficients: list[float], x: str) -> str:
    out = f"{coefficients[0]:.17e}"
    for c in coefficients[1:]:
        out = f"({out} * {x} + ({c:.17e}))"
    return out


def quantile(u: str) -> str:
    """SQL of the quantile of a column u."""
    low, high, r = f"sqrt(-2 * ln({u}))", f"sqrt(-2 * ln(1 - {u}))", f"(({u} - 0.5) * ({u} - 0.5))"
    return f"CASE WHEN {u} < 0.02425 THEN {_horner(_C, low)} / {_horner(_D, low)} WHEN {u} > 0.97575 THEN -({_horner(_C, high)} / {_horner(_D, high)}) ELSE {_horner(_A, r)} / {_horner(_B, r)} * ({u} - 0.5) END"


SQL: dict[str, str] = {
    "Z3_propagation": f"WITH {_LOST} SELECT 'supplier' AS side, r.src AS firm_id, CAST(sum(r.weight) AS BIGINT) AS amount FROM {{relations}} r JOIN struck s ON r.dst = s.firm_id LEFT ANTI JOIN struck t ON r.src = t.firm_id GROUP BY r.src UNION ALL SELECT 'customer', customer, CAST(sum(amount) AS BIGINT) FROM lost GROUP BY customer",
    "Z4_overlap_searches": f"WITH {_OVERLAP} SELECT l.customer, l.firm, count(o.alt) AS options FROM lost l LEFT JOIN options o ON l.customer = o.customer AND l.firm = o.firm GROUP BY l.customer, l.firm",
    "Z5_specific_searches": f"WITH {_SPECIFIC} SELECT w.customer, w.firm, w.product, w.amount, count(o.alt) AS options, round(max(o.score), 6) AS best FROM wanted w LEFT JOIN options o ON w.customer = o.customer AND w.firm = o.firm AND w.product = o.product GROUP BY w.customer, w.firm, w.product, w.amount",
    "Z6_hybrid_searches": f"WITH {_OVERLAP} SELECT e.dst AS customer, e.src AS firm, e.product, e.amount, count(r.alt) AS options FROM {{edge_products}} e JOIN struck s ON e.src = s.firm_id LEFT JOIN rival r ON e.src = r.firm AND r.alt <> e.dst GROUP BY e.dst, e.src, e.product, e.amount",
    "Z7_live_options": f"WITH {_OVERLAP} SELECT o.customer, o.firm, count(*) AS options FROM options o LEFT ANTI JOIN (SELECT firm_id FROM {{degrees}} WHERE firm_id % 5 = 0) gone ON o.alt = gone.firm_id GROUP BY o.customer, o.firm",
    "Z8_candidates": f"WITH {_ASKED} SELECT customer, firm, alt FROM asked",
    "Z9_specific_candidates": f"WITH {_SPECIFIC} SELECT customer, firm, product, alt FROM (SELECT customer, firm, product, alt, row_number() OVER (PARTITION BY customer, firm, product ORDER BY -ln({_U % ('score', 'customer * 100000 + firm', 'product * 100000 + alt')}) / score, alt) AS place FROM options) x WHERE place <= 3",
    "Z10_requests": f"WITH {_ASKED} SELECT alt AS supplier, count(*) AS requests, count(DISTINCT customer) AS customers FROM asked GROUP BY alt",
    "Z11_selected": f"WITH {_TAKEN} SELECT alt AS supplier, customer, firm, place FROM ranked WHERE place <= cap",
    "Z13_answers": f"WITH {_TAKEN} SELECT customer, firm, alt FROM taken",
    "Z14_accepted_edges": f"WITH {_TAKEN} SELECT src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM (SELECT r.src, r.dst, r.weight FROM {{relations}} r JOIN taken t ON r.src = t.alt AND r.dst = t.customer UNION ALL SELECT alt, customer, 1 FROM taken) x GROUP BY src, dst",
    "Z15_disrupted": f"WITH {_FAILED} SELECT customer, count(*) AS failed, min(firm) AS first_origin, count(DISTINCT firm) AS origins FROM failed GROUP BY customer",
    "Z16_removal_draws": f"WITH {_FALL} SELECT customer FROM drawn WHERE {_U % ('fall', 'customer', '0')} < q",
    "Z17_removal_probability": f"WITH {_FALL} SELECT d.customer, round(p.lost, 9) AS lost, round(d.p, 9) AS p, round(d.q, 9) AS q FROM drawn d JOIN p ON d.customer = p.customer",
    "Z18_removed_nodes": f"WITH {_STRUCK} SELECT (SELECT count(*) FROM {{firms}}) - 6 AS firms, count(*) AS edges, CAST(sum(r.weight) AS BIGINT) AS volume FROM {{relations}} r LEFT ANTI JOIN struck s ON r.src = s.firm_id LEFT ANTI JOIN struck t ON r.dst = t.firm_id",
    "Z19_release": f"WITH {_STRUCK} SELECT r.src AS supplier, CAST(sum(r.weight) AS BIGINT) AS released FROM {{relations}} r JOIN struck s ON r.dst = s.firm_id GROUP BY r.src",
    "Z28_event_log": f"WITH {_TAKEN} SELECT 2 AS tick, 'asked' AS kind, count(*) AS n FROM asked UNION ALL SELECT 3, 'taken', count(*) FROM taken UNION ALL SELECT 1, 'lost', count(*) FROM lost",
    "Z32_capacity_left": f"WITH {_TAKEN} SELECT f.firm_id, f.cap - count(t.alt) AS remaining FROM free f LEFT JOIN taken t ON f.firm_id = t.alt GROUP BY f.firm_id, f.cap",
    "Z24_extended_portfolios": "SELECT firm_id, count(*) AS products FROM (SELECT firm_id, product FROM {capabilities} UNION SELECT src, product FROM {edge_products}) x GROUP BY firm_id",
}
