"""Quality rules by distribution divergence, with DataFrame functions only.

Each text gets two histograms: of character classes, and of the commonest words of each language. Both are learnt: the
common words of a language are the WORDS words that its documents hold most often, its references the histograms summed
over all its documents. Languages are the values of the language column, the MAX_LANGUAGES with most words; a language of
fewer than LEAST_WORDS words has no reference.

A text fails when the Jensen-Shannon distance (base 2) of its characters to the nearest reference exceeds a threshold, or
that of its words. Word distances are shares of the distance that a text without any common word has, which depends on
the language: 1 says that a text holds none, more that it repeats one out of all measure. Chance alone puts a good text of n
words some s / sqrt(n) from its reference; s is learnt, as the harmonic mean of distance x sqrt(n) over all texts, which far
ones hardly move. A text of n words fails beyond SPREAD times that, within the bounds LEAST_LIMIT and MOST_LIMIT. Texts below a
minimum length are not judged by that histogram; a text of a language without a reference gets no word verdict.

The work is three scans; only counts of words are shuffled, summed in the tasks first. Features are arrays of one row,
repeated windows are found by sorting hashes inside the row.

Odd rows: a null or empty text has no words and fails the base rules; a text of any length is read whole; equal rows get
equal verdicts; words of equal counts are ranked by their bytes; an empty table gives an empty result; columns of the new
names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, let, quoted, table

WORDS, LEAST_WORDS, MAX_LANGUAGES = 20, 1000, 64
SPREAD, LEAST_LIMIT, MOST_LIMIT = 1.8, 0.6, 0.97
WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Lower case, upper case, other letters and marks, digits, white space, punctuation, symbols and the rest.
CLASSES = ["\\p{Ll}", "\\p{Lu}", "\\p{L}\\p{M}", "\\p{N}", "\\s", "\\p{P}"]


def _count_removed(before: Column, after: Column) -> Column:
    return (F.length(before) - F.length(after)).cast("long")


def _repeat_words(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort (hash, place), keep runs, measure their union."""
    marked = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twin = lambda s, x, j, step: F.coalesce(F.get(s, j + step)["h"] == x["h"], F.lit(False))
    places = let(marked, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: ((j > 0) & twin(s, x, j, -1)) | twin(s, x, j, 1)), lambda x: x["i"])))
    spans = let(places, lambda p: F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(spans, F.lit(0), lambda a, x: a + x)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def common_words(docs: DataFrame, text: str = "text", lang: str = "lang", words: int = WORDS, least: int = LEAST_WORDS, most: int = MAX_LANGUAGES) -> dict[str, dict[str, float]]:
    """Per language its commonest words that hold a letter, in lower case, with their shares of all its words.

    Counted over all documents. The driver gets at most words * most rows.
    """
    spoken = docs.where(quoted(lang).isNotNull() & quoted(text).isNotNull()).select(quoted(lang).alias("l"), F.explode(_words(quoted(text))).alias("w"))
    counts = table(spoken.groupBy("l", F.lower("w").alias("w")).agg(F.count("*").alias("n")), "words")
    sizes = counts.groupBy("l").agg(F.sum("n").alias("all")).where(F.col("all") >= least).orderBy(F.desc("all"), "l").limit(most)
    rank = F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "w"))  # tasks keep their first ranks only
    top = counts.where(F.col("w").rlike("\\p{L}")).withColumn("rank", rank).where(F.col("rank") <= words).drop("rank")
    out: dict[str, dict[str, float]] = {}
    for r in sorted(top.join(F.broadcast(sizes), "l").collect(), key=lambda r: (r["l"], -r["n"], r["w"])):
        out.setdefault(r["l"], {})[r["w"]] = r["n"] / r["all"]
    return out


def _vocabulary(common: dict[str, dict[str, float]]) -> list[str]:
    return sorted({w for ws in common.values() for w in ws})


def features(docs: DataFrame, common: dict[str, dict[str, float]], text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_hist and word_hist (arrays).

    A null text has no words. Existing columns of those names are replaced.
    """
    kept, vocabulary = docs.columns, _vocabulary(common)
    t, words, hashed, wins, lines, known, rest = (free_name(kept, f"__{x}") for x in ("t", "words", "hashed", "wins", "lines", "known", "rest"))
    df = docs.withColumn(t, F.coalesce(quoted(text), F.lit("")))
    df = df.withColumn(words, _words(F.col(t))).withColumn(lines, F.filter(F.split(t, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    n = F.size(words)
    df = df.withColumn(hashed, F.transform(words, lambda w: F.xxhash64(w)))
    hashes = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[F.get(F.col(hashed), i + k) for k in range(WINDOW)]))
    df = df.withColumn(wins, F.when(n >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>")))
    spoken = F.filter(F.transform(words, lambda w: F.lower(w)), lambda w: w.isin(vocabulary))
    places = F.transform(spoken, lambda w: F.array_position(F.array(*map(F.lit, vocabulary)), w))
    df = df.withColumn(known, places if vocabulary else F.array().cast("array<bigint>"))
    left, char_counts = F.col(t), []
    for k, cls in enumerate(CLASSES):  # each pass works on what the earlier ones left
        name = f"{rest}{k}"
        df = df.withColumn(name, F.regexp_replace(left, f"[{cls}]+", ""))
        char_counts.append(_count_removed(left, F.col(name)))
        left = F.col(name)
    per_word = F.transform(F.sequence(F.lit(1), F.lit(max(1, len(vocabulary)))), lambda k: (F.size(known) - F.size(F.array_remove(known, k.cast("long")))).cast("long"))
    out = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.translate(t, WHITE, "")).cast("long"),
        "n_symbols": _count_removed(F.col(t), F.translate(t, SYMBOLS, "")),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.when(F.size(F.array_distinct(wins)) == F.size(wins), F.lit(0)).otherwise(_repeat_words(F.col(wins))).cast("long"),
        "char_hist": F.array(*char_counts, F.length(left).cast("long")),
        "word_hist": per_word,
    }
    low = {x.lower() for x in out}
    return df.select(*[quoted(c) for c in kept if c.lower() not in low], *[v.alias(k) for k, v in out.items()])


def references(featured: DataFrame, common: dict, lang: str = "lang") -> dict[str, list[float]]:
    """Per language with common words its distribution of character classes, over all its documents."""
    sums = [F.sum(F.get("char_hist", F.lit(i))).alias(f"c{i}") for i in range(len(CLASSES) + 1)]
    rows = featured.where(quoted(lang).isin(list(common))).groupBy(quoted(lang).alias("lang")).agg(*sums).collect()  # as many rows as languages
    counts = {r["lang"]: [r[f"c{i}"] for i in range(len(CLASSES) + 1)] for r in rows}
    return {k: [x / sum(xs) for x in xs] for k, xs in counts.items() if sum(xs)}


def distance(p: list[float], q: list[float]) -> float:
    """Jensen-Shannon distance of two distributions."""
    part = lambda x, m: x * math.log2(x / m) if x > 0 else 0.0
    return math.sqrt(max(0.0, sum((part(a, (a + b) / 2) + part(b, (a + b) / 2)) / 2 for a, b in zip(p, q, strict=True))))


def _js(hist: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of a histogram of counts to a distribution."""

    def term(p: Column, q: Column) -> Column:
        m = (p + q) / 2
        part = lambda x: F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))
        return (part(p) + part(q)) / 2

    total = F.aggregate(hist, F.lit(0).cast("long"), lambda a, x: a + x)
    shares = let(total, lambda n: F.transform(hist, lambda x: x / F.greatest(n, F.lit(1).cast("long"))))
    terms = F.zip_with(shares, F.array(*map(F.lit, reference)), term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)))


def judge(featured: DataFrame, chars: dict, common: dict, lang: str = "lang", max_char: float = 0.2, min_chars: int = 200, min_words: int = 50) -> DataFrame:
    """featured with char_js, word_js (to the nearest language; null without one), base_failed and kept; featured is read twice."""
    place = {w: i for i, w in enumerate(_vocabulary(common))}

    def nearest(all_: list[Column]) -> Column:
        return F.least(*all_) if len(all_) > 1 else all_[0] if all_ else F.lit(None).cast("double")

    def words(ws: dict[str, float]) -> Column:
        counts = F.transform(F.array(*[F.lit(place[w]) for w in ws]), lambda i: F.get("word_hist", i))
        reference = [*ws.values(), 1 - sum(ws.values())]
        rest = let(counts, lambda c: F.concat(c, F.array(F.col("n_words") - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))))
        return _js(rest, reference) / distance([0.0] * len(ws) + [1.0], reference)

    base_failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    size = F.aggregate("char_hist", F.lit(0).cast("long"), lambda a, x: a + x)
    spoken = quoted(lang).isNull() | quoted(lang).isin(list(common))
    df = featured.withColumns({"char_js": nearest([_js(F.col("char_hist"), r) for _, r in sorted(chars.items())]), "word_js": F.when(spoken, nearest([words(ws) for _, ws in sorted(common.items())])), "base_failed": base_failed})
    usual = df.where(~F.col("base_failed") & (F.col("n_words") >= min_words) & (F.col("word_js") > 0) & (F.col("word_js") <= MOST_LIMIT))
    spread = usual.agg(F.count("*") / F.sum(1 / (F.col("word_js") * F.sqrt("n_words")))).first()[0]  # one number
    max_word = F.lit(MOST_LIMIT) if spread is None else F.least(F.lit(MOST_LIMIT), F.greatest(F.lit(LEAST_LIMIT), SPREAD * spread / F.sqrt("n_words")))
    odd = F.coalesce((size >= min_chars) & (F.col("char_js") > max_char), F.lit(False)) | F.coalesce((F.col("n_words") >= min_words) & (F.col("word_js") > max_word), F.lit(False))
    return df.withColumn("kept", ~F.col("base_failed") & ~odd)


def quality(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs' columns but the text, with features and verdict. Equal rows get equal verdicts."""
    common = common_words(docs, text, lang)
    narrow = table(features(docs, common, text).drop(text), "quality")
    return judge(narrow, references(narrow, common, lang), common, lang)


def digest(docs: DataFrame) -> DataFrame:
    out = quality(docs.select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("char_js", 6).alias("char_js"), F.round("word_js", 6).alias("word_js"))
