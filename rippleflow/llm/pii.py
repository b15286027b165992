"""Personal data by weak supervision, with DataFrame functions only.

Spans of each kind come from regular expressions inside the row: split() and regexp_extract_all() by the same
pattern alternate, so places are cumulated lengths. The base kinds (email, ip, card, phone) are always kept.
Further candidates (loosely written phone numbers, identity numbers, access keys) are kept if the model says so:
labelers (shape, checksum or variety of characters, gazetteer, context, borders) vote 1, 0 or -1 on every span,
expectation-maximisation estimates how often each labeler says what of true and of false spans, and a logistic
classifier is trained on the posteriors; it also sees what no labeler votes on (length, share of digits, the characters
that lead to the span). All that the driver gathers are counts of vote patterns (at most 3^5 a kind and look).

Odd rows: a null text is empty and has no spans; very long texts are scanned whole; equal rows give equal rows; an empty
table gives an empty result (the model is then its prior); columns of other names, also of those used inside, stay.

No text is shuffled. Patterns use possessive loops and start only at run borders, so a scan is linear;
places are running sums in log2(spans) passes, and added spans find base ones by binary search.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, let, quoted, table

LOCAL, DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# Base patterns; the same language as the contract's, started at run borders or after the last match.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){12,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TEL = r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])"
IDENTITY = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,128}+(?![A-Za-z0-9_-])"
# Gazetteers.
DOMAINS = ["com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "biz", "co", "us"]
COUNTRY = "^\\+(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
ISSUER = "^(?:4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
KEY_PREFIX = "^(?:AKIA|ASIA|AIza|AIZA|GHP|gh[oprsu]_|github_pat_|glpat-|npm_|pk_|rk_|sk[_-]|xox[abpr]-|eyJ)"
CONTEXT = "(?i)(?:tel|phone|call|fax|mobile|mail|contact|card|visa|master|credit|ip|addr|host|key|token|secret|passw(?:or)?d|pwd|auth|bearer|credentials?|ssn|social|reach)[^A-Za-z]{0,12}$"
AGAINST = "(?i)(?:version|ver|isbn|issn|order|sku|part|model|serial|page|no\\.|#)[^A-Za-z]{0,6}$"
BASE, ADDED = ["email", "ip", "card", "phone"], ["tel", "id", "secret"]
KINDS = BASE + ADDED
LABELERS = ["shape", "checksum", "gazetteer", "context", "border"]
NEAR, LOOKS = 32, 60
POWERS = [1 << i for i in range(31)]
PIECE = 512


def running(values: Column, both) -> Column:
    """values[i] joined by both with all before it, in log2(n) passes: an array that grows by one would be copied n times."""

    def scan(v: Column) -> Column:
        return F.aggregate(F.filter(F.array(*map(F.lit, POWERS)), lambda p: p < F.size(v)), v, lambda a, p: F.transform(a, lambda x, i: F.when(i < p, x).otherwise(both(x, F.get(a, i - p)))))

    return let(values, scan)


def _found(text: Column, pattern: str, when: Column) -> Column:
    """array<struct<s, e, m, b>>: places (end exclusive), matches, and the text just before (at most NEAR characters)."""
    kind = "array<struct<s:int,e:int,m:string,b:string>>"
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def placed(z: Column) -> Column:
        ends = running(F.transform(z, lambda x: F.length(x["p"]) + F.coalesce(F.length(x["m"]), F.lit(0))), lambda x, y: x + y)
        spans = let(ends, lambda e: F.transform(z, lambda x, i: F.struct((F.get(e, i) - F.length(x["m"])).alias("s"), F.get(e, i).alias("e"), x["m"].alias("m"), F.right(x["p"], F.lit(NEAR)).alias("b"))))
        return F.filter(spans, lambda x: x["m"].isNotNull()).cast(kind)

    return F.when(when, let(zipped, placed)).otherwise(F.array().cast(kind))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (F.pmod(i, F.lit(2)) + 1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.pmod(F.aggregate(F.filter(each, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d), F.lit(10)) == 0


def _vote(yes: Column, no: Column | None = None) -> Column:
    v = F.when(F.coalesce(yes, F.lit(False)), 1)
    return (v.when(F.coalesce(no, F.lit(False)), -1) if no is not None else v).otherwise(0).cast("byte")


def variety(m: Column) -> Column:
    """Distinct characters."""
    return F.size(F.array_distinct(F.split(F.lower(m), "")))


def _look(m: Column, before: Column) -> Column:
    """What no labeler votes on, as a number below LOOKS: length, share of digits, and how the text leads to the span."""
    length = F.when(F.length(m) < 12, 0).when(F.length(m) < 20, 1).otherwise(2)
    share = F.length(F.regexp_replace(m, "[^0-9]", "")) / F.length(m)
    digits = F.when(share < 0.2, 0).when(share < 0.5, 1).when(share < 0.8, 2).otherwise(3)
    lead = F.when(before.rlike("[=:]\\s*[\"']?$"), 1).when(before.rlike("[a-z]\\s$"), 2).when(before.rlike("[A-Z0-9]\\s$"), 3).when(before.rlike("[.!?]\\s$"), 4).otherwise(0)
    return (length + 3 * digits + 12 * lead).cast("byte")


def _labelled(kind: str, found: Column) -> Column:
    """The spans of one kind that hold, with votes."""

    def label(x: Column) -> Column:
        m, d = x["m"], _digits(x["m"])
        own = {
            "email": (F.lit(True), None, m.rlike("\\.[A-Za-z]{2,}$"), m.rlike("\\.[0-9-]+$"), F.lower(F.substring_index(m, ".", -1)).isin(DOMAINS), None),
            "ip": (F.lit(True), None, ~m.rlike("^0+\\.|\\.0+$"), m.rlike("^0+\\.0+\\.0+\\."), ~m.rlike("^(?:10|127|0|255)\\."), m.rlike("^(?:10|127|0|255|192\\.168)\\.")),
            "card": (F.lit(True), None, luhn(d), None, d.rlike(ISSUER), d.rlike("^0")),
            "phone": (F.lit(True), None, F.length(d).between(10, 15), F.length(d) < 9, m.rlike(COUNTRY), m.rlike("^\\+0")),
            "tel": (m.rlike("^\\([0-9]{3}\\)|^[0-9]{3}-[0-9]{3}-[0-9]{4}$"), None, ~d.rlike("^[01]"), d.rlike("^[01]"), d.rlike("^[2-9][0-9]{2}555|^800"), None),
            "id": (F.lit(True), None, ~d.rlike("^(?:000|666|9)|^...00|0000$"), d.rlike("^(?:000|666|9)|^...00|0000$"), None, None),
            # A key changes between letters and digits often and uses many characters; names with a number or date don't.
            "secret": (m.rlike("(?:[0-9]+[A-Za-z]+){3}"), m.rlike("^[A-Za-z_-]+[0-9_-]+$|^[0-9_-]+[A-Za-z_-]+$|^(?:[A-Za-z]+|[0-9]{1,4})(?:[-_]+(?:[A-Za-z]+|[0-9]{1,4}))+$"), (variety(m) >= 10) & ~m.rlike("[A-Za-z]{6}"), (variety(m) < 8) | m.rlike("[a-z]{7}"), m.rlike(KEY_PREFIX), None),
        }[kind]
        pairs = [own[0:2], own[2:4], own[4:6], (x["b"].rlike(CONTEXT), x["b"].rlike(AGAINST)), (x["b"].rlike("(?:^|\\s|[(<\\[\"':;,])$"), x["b"].rlike("[=/&?#_]$"))]
        votes = [_vote(F.lit(False) if y is None else y, n) for y, n in pairs]
        return F.struct(F.lit(KINDS.index(kind)).cast("byte").alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.array(*votes).alias("v"), _look(m, x["b"]).alias("z"))

    holds = {
        "ip": lambda x: x["m"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$"),
        "card": lambda x: luhn(_digits(x["m"])),
        "phone": lambda x: F.length(_digits(x["m"])).between(9, 15),
    }.get(kind)
    return F.transform(F.filter(found, holds) if holds else found, label)


def candidates(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """docs with a column out: array<struct<k, s, e, v, z>>, base kinds first; added ones don't touch base spans."""
    t = free_name(docs.columns, "__t")
    df = docs.withColumn(t, F.coalesce(quoted(text), F.lit("")))
    when = {"email": F.col(t).contains("@"), "ip": F.col(t).rlike("[0-9]\\.[0-9]"), "card": F.col(t).rlike("[0-9](?:[ -]?[0-9]){12}"), "phone": F.col(t).contains("+"), "tel": F.col(t).rlike("[0-9]{3}[ .-][0-9]{4}"), "id": F.col(t).rlike("[0-9]-[0-9]{2}-[0-9]"), "secret": F.col(t).rlike("[A-Za-z0-9_-]{16}")}
    pattern = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "tel": TEL, "id": IDENTITY, "secret": SECRET}
    base, more = free_name(docs.columns, "__base"), free_name(docs.columns, "__more")
    df = df.withColumn(base, F.array(*[_labelled(k, _found(F.col(t), pattern[k], when[k])) for k in BASE]))
    df = df.withColumn(more, F.concat(*[_labelled(k, _found(F.col(t), pattern[k], when[k])) for k in ADDED]))
    apart = F.filter(more, lambda x: ~F.exists(F.col(base), lambda spans: _touched(x, spans)))
    return df.withColumn(out, F.concat(F.flatten(base), F.when(F.size(more) > 0, apart).otherwise(F.col(more)))).drop(t, base, more)


def _touched(x: Column, spans: Column) -> Column:
    """Whether x overlaps one of spans, which are apart and in order: the last that starts before x ends decides."""
    steps = F.filter(F.array(*map(F.lit, reversed(POWERS))), lambda p: p <= F.size(spans))
    before = F.aggregate(steps, F.lit(0), lambda a, p: F.when(F.get(spans, a + p - 1)["s"] < x["e"], a + p).otherwise(a))
    return F.coalesce(F.get(spans, before - 1)["e"] > x["s"], F.lit(False))


@dataclass
class Model:
    """Weights of the span classifier; reliability[l][v + 1][y] is how often labeler l says v of class y."""

    bias: float = 0.0
    kind: list[float] = field(default_factory=lambda: [0.0] * len(KINDS))
    vote: list[list[float]] = field(default_factory=lambda: [[-1.0, 0.0, 1.0] for _ in LABELERS])
    size: list[float] = field(default_factory=lambda: [0.0] * LOOKS)
    reliability: list = field(default_factory=list)

    def score(self, x: Column) -> Column:
        """Probability that the candidate x is personal data."""
        total = F.lit(self.bias) + F.get(F.array(*map(F.lit, self.kind)), x["k"].cast("int")) + F.get(F.array(*map(F.lit, self.size)), x["z"].cast("int"))
        for i, w in enumerate(self.vote):
            total = total + F.get(F.array(*map(F.lit, w)), F.get(x["v"], F.lit(i)).cast("int") + 1)
        return 1 / (1 + F.exp(-total))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _evidence(labeler: list[list[float]], v: int, least: float = 0.1) -> float:
    """What a vote adds to the log odds. Abstaining says nothing, and a vote never counts against what it says: else
    the classes could swap where a kind's spans are all true."""
    if not v:
        return 0.0
    rate = [labeler[v + 1][y] / (labeler[0][y] + labeler[2][y]) for y in (0, 1)]
    odds = math.log(rate[1] / rate[0])
    return max(odds, least) if v > 0 else min(odds, -least)


def expectation_maximisation(patterns: list[tuple[int, tuple[int, ...], int, int]], rounds: int = 60) -> tuple[list[float], list]:
    """patterns: (kind, votes, look, count). Posteriors of the patterns, and the labelers' reliabilities."""
    post = [_sigmoid(sum(v) - 0.5) for _, v, _, _ in patterns]
    reliability: list = []
    for _ in range(rounds):
        prior = [[1.0, 1.0] for _ in KINDS]
        reliability = [[[1.0, 1.0] for _ in range(3)] for _ in LABELERS]
        for (k, votes, _, n), p in zip(patterns, post, strict=True):
            for y, share in ((0, 1 - p), (1, p)):
                prior[k][y] += n * share
                for i, v in enumerate(votes):
                    reliability[i][v + 1][y] += n * share
        for labeler in reliability:
            for y in (0, 1):
                total = sum(row[y] for row in labeler)
                for row in labeler:
                    row[y] /= total
        new = []
        for k, votes, _, _ in patterns:
            odds = math.log(prior[k][1] / prior[k][0]) + sum(_evidence(reliability[i], v) for i, v in enumerate(votes))
            new.append(_sigmoid(odds))
        post = new
    return post, reliability


def fit(patterns: list[tuple[int, tuple[int, ...], int, int]], steps: int = 400, rate: float = 0.5) -> Model:
    """EM, then a logistic classifier on its posteriors (gradient steps over the pattern counts)."""
    if not patterns:
        return Model()
    post, reliability = expectation_maximisation(patterns)
    m, total = Model(reliability=reliability), sum(n for *_, n in patterns)
    for _ in range(steps):
        g_bias, g_kind, g_size, g_vote = 0.0, [0.0] * len(KINDS), [0.0] * LOOKS, [[0.0] * 3 for _ in LABELERS]
        for (k, votes, z, n), p in zip(patterns, post, strict=True):
            x = m.bias + m.kind[k] + m.size[z] + sum(m.vote[i][v + 1] for i, v in enumerate(votes))
            d = n / total * (p - _sigmoid(x))
            g_bias, g_kind[k], g_size[z] = g_bias + d, g_kind[k] + d, g_size[z] + d
            for i, v in enumerate(votes):
                g_vote[i][v + 1] += d
        m.bias += rate * g_bias
        m.kind = [w + rate * g for w, g in zip(m.kind, g_kind, strict=True)]
        m.size = [w + rate * g for w, g in zip(m.size, g_size, strict=True)]
        m.vote = [[w + rate * g for w, g in zip(ws, gs, strict=True)] for ws, gs in zip(m.vote, g_vote, strict=True)]
    return m


def train(found: DataFrame, column: str) -> Model:
    """found: candidates() without texts. Only pattern counts reach the driver."""
    x = found.select(F.explode(column).alias("x"))
    rows = x.groupBy(F.col("x.k").alias("k"), F.col("x.v").alias("v"), F.col("x.z").alias("z")).count().collect()
    return fit(sorted((r["k"], tuple(r["v"]), r["z"], r["count"]) for r in rows))


def chosen(column: Column, model: Model, least: float = 0.5) -> Column:
    """Base spans and the added ones that the classifier accepts, by kind, then start."""
    kept = F.filter(column, lambda x: (x["k"] < len(BASE)) | (model.score(x) >= least))
    return F.sort_array(F.transform(kept, lambda x: F.struct(x["k"].alias("k"), x["s"].alias("s"), x["e"].alias("e"))))


def detect(docs: DataFrame, text: str = "text", out: str = "pii") -> DataFrame:
    """docs without the text, with column out: array<struct<k, s, e>>, k an index into KINDS, in code points.

    A null text has no spans. Equal rows give equal rows.
    """
    c = free_name([*docs.columns, out], "__c")
    narrow = table(candidates(docs, c, text).drop(text), "pii")
    return narrow.withColumn(out, chosen(F.col(c), train(narrow, c))).drop(c)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; where spans overlap, their union goes as one."""
    c, s, t = (free_name(docs.columns, f"__{x}") for x in ("c", "s", "t"))
    model = train(table(candidates(docs.select(quoted(text)), c, text).select(c), "pii"), c)
    df = candidates(docs, c, text).withColumn(s, F.sort_array(F.transform(chosen(F.col(c), model), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))))
    names = F.array(*[F.lit(f"<{k.upper()}>") for k in KINDS])
    reach = running(F.transform(F.col(s), lambda x: x["e"]), F.greatest)  # the furthest end so far

    def masked(to: Column) -> Column:
        """What lies between spans, and a name for every union of overlapping ones."""
        at = lambda i: F.when(i > 0, F.get(to, i - 1)).otherwise(0)
        parts = F.transform(F.col(s), lambda x, i: F.when(x["s"] >= at(i), F.concat(between(at(i), x["s"]), F.get(names, x["k"].cast("int")))).otherwise(F.lit("")))
        return F.concat(F.array_join(parts, ""), between(F.get(to, F.size(s) - 1), F.length(quoted(text))))

    def between(a: Column, b: Column) -> Column:
        """Characters a to b (exclusive). substring() walks from the text's start, so it is put on pieces of it."""
        first = F.floor(a / PIECE).cast("int")
        of = F.slice(F.col(t), first + 1, F.floor((b - 1) / PIECE).cast("int") - first + 1)
        return F.when(b > a, F.substring(F.array_join(of, ""), a - first * PIECE + 1, b - a)).otherwise(F.lit(""))

    pieces = F.when(F.size(s) > 0, F.regexp_extract_all(quoted(text), F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)))
    clean = F.when(F.size(s) > 0, let(reach, masked)).otherwise(quoted(text))
    return df.withColumn(t, pieces).select(*[clean.alias(x) if x == text else quoted(x) for x in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    found = detect(docs.select("doc_id", "text"))
    names = F.array(*map(F.lit, KINDS))
    join = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"].cast("int")), x["s"].cast("string"), x["e"].cast("string"))), ",")
    base = F.filter("pii", lambda x: x["k"] < len(BASE))
    of = lambda i: F.filter("pii", lambda x: x["k"] == i)
    count = [F.size(of(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(BASE)]
    return found.select("doc_id", *count, F.sha2(join(base), 256).alias("base_sha256"), join(F.col("pii")).alias("spans"))
