"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of labelled rows (at most max_docs of them, those with the smallest row hashes, so the
choice doesn't depend on partitioning); the model is a float32 matrix of 2^15 buckets x languages that the
driver collects from per-task sums and broadcasts (its size depends on parameters and languages only).
Scoring walks byte-bounded slices of Arrow batches: the n-grams of all texts of a slice are hashed together,
looked up, and their log-probabilities summed per text with reduceat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, hashable, quoted, slices

BUCKETS, ORDERS = 1 << 15, (1, 2, 3)
UNDETERMINED = "und"
_LETTER = regex.compile(r"\p{L}")
_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def ngram_buckets(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order an array of buckets, one a character place; place -1 never occurs. And places' text ends.

    Every text is lowered and followed by a blank; grams that begin in a text may read into the next one's
    first characters only past that blank, so a text's grams of order 3 end at its last character.
    """
    lowered = [" " + " ".join(t.lower().split()) + "  " for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    ends = np.cumsum([len(t) for t in lowered])
    out, value = [], np.zeros(len(chars), np.uint64)
    for k in range(max(ORDERS)):
        value[: len(chars) - k] += (chars[k:] + np.uint64(1)) * _MULT[k]
        mixed = value ^ (value >> np.uint64(29))
        out.append(((mixed * _MULT[1]) >> np.uint64(64 - 15)).astype(np.int64))
    return out, ends


def _usable(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            rows = [(t, g) for t, g in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True) if _usable(t)]
            for lang in {g for _, g in rows}:
                grams, ends = ngram_buckets([t for t, g in rows if g == lang])
                inside = np.ones(ends[-1], bool)
                inside[ends - 1] = inside[ends - 2] = False
                sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for g in grams:
                    sums[lang] += np.bincount(g[inside], minlength=BUCKETS)
    for lang, n in sums.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "bucket": pa.array(at, pa.int32()), "n": pa.array(n[at], pa.int64())})


class Model:
    def __init__(self, langs: list[str], counts: np.ndarray, alpha: float = 0.5):
        self.langs = langs
        smooth = counts + alpha
        self.logp = np.log(smooth / smooth.sum(axis=0, keepdims=True)).astype(np.float32)  # buckets x languages

    def score(self, texts: list[str]) -> np.ndarray:
        """Log-likelihoods, texts x languages."""
        grams, ends = ngram_buckets(texts)
        starts = np.concatenate([[0], ends[:-1]])
        out = np.empty((len(texts), len(self.langs)))
        inside = np.ones(ends[-1], np.float32)
        inside[ends - 1] = inside[ends - 2] = 0
        for j in range(len(self.langs)):
            column = np.ascontiguousarray(self.logp[:, j])
            total = column[grams[0]]
            for g in grams[1:]:
                total += column[g]
            total *= inside
            out[:, j] = np.add.reduceat(total, starts, dtype=np.float64)
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and posteriors; a text that is null or has no letter is undetermined, with score 0."""
        good = [i for i, t in enumerate(texts) if _usable(t)] if self.langs else []
        pred, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        if good:
            ll = self.score([texts[i] for i in good])
            best = ll.argmax(axis=1)
            post = 1 / np.exp(ll - ll.max(axis=1, keepdims=True)).sum(axis=1)
            for i, b, p in zip(good, best, post, strict=True):
                pred[i], score[i] = self.langs[b], p
        return pred, score


def _least(keyed: DataFrame, h: str, max_docs: int) -> DataFrame:
    """The max_docs rows of the least (h, text's hash, lang). Only hashes are sorted; texts stay where they are."""
    place = F.struct(F.col(h).alias("h"), F.xxhash64("text").alias("x"), F.col("lang").cast("string").alias("g"))
    last = keyed.select(place.alias("p")).orderBy("p").limit(max_docs).agg(F.max("p").alias("p"), F.count("*").alias("n")).first()
    if last["n"] < max_docs:
        return keyed
    cut = F.struct(*[F.lit(v).alias(k) for k, v in last["p"].asDict().items()])
    below = keyed.where(place < cut)
    return below.union(keyed.where(place == cut).limit(max_docs - below.count()))  # rows of one text


def train(labelled: DataFrame, max_docs: int = 20_000, tasks: int = 16) -> Model:
    """labelled: text, lang and doc_id or other columns. Null texts and labels don't count; no rows, no languages."""
    keyed = labelled.where(quoted("lang").isNotNull() & quoted("text").isNotNull())
    h = free_name(keyed.columns, "__h")
    keyed = keyed.withColumn(h, F.xxhash64(F.lit(5), *[quoted(c) for c in hashable(keyed.schema) if c not in ("text", "lang")]))
    n = keyed.count()
    if n > max_docs:  # a share of the hash range a little larger than needed, then the smallest hashes of it
        cut = int(-(2**63) + 2**64 * min(1.0, 1.2 * max_docs / n))
        keyed = _least(keyed.where(F.col(h) <= min(cut, 2**63 - 1)), h, max_docs)
    counts = keyed.select("text", F.col("lang").cast("string")).repartition(tasks).mapInArrow(_count, "lang string, bucket int, n long")
    rows = counts.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("at")).collect()  # languages x 2^15 x tasks cells at most
    langs = sorted(r["lang"] for r in rows)
    matrix = np.zeros((BUCKETS, len(langs)))
    for r in rows:
        np.add.at(matrix[:, langs.index(r["lang"])], [x["bucket"] for x in r["at"]], [x["n"] for x in r["at"]])
    return Model(langs, matrix)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (existing columns of those names are replaced), one row a row of docs.

    A text that is null or has no letter is `und` with score 0, as is every text under a model without languages.
    Equal rows give equal rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*docs.select(*map(quoted, kept)).schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                pred, score = shared.value.predict(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    return docs.select(*map(quoted, kept)).mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True))).select("doc_id", "text", "lang")


def digest(docs: DataFrame) -> DataFrame:
    model = train(training_rows(docs))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
