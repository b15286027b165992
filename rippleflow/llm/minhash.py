"""Near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

1. Document frequencies of words, in 2^18 hashed counters summed over all rows, give idf, scaled to 1 .. 2 so that
   similarities don't depend on the number of rows. A shingle of five
   words weighs its frequency in the text times the mean idf of its words. (Frequencies of the shingles
   themselves would depend on the copies that are looked for, and moving all shingles costs five times the input.)
2. One pass writes per row a digest of its words (equal texts), and 10 bands of three consistent weighted samples.
3. Texts that differ meet in a group for each band that they share; of groups with the same members one is kept.
   A task compares all texts of a group exactly (weighted Jaccard similarity against one text at a time, over the
   concatenated shingles) and yields a forest of its links. A group of more than CHUNK texts or CHUNK_BYTES is
   dealt to several tasks, which share HUBS members; its members also meet in groups for each second band that
   they share. That finds most links between parts, not all.
4. Links become classes by star contraction.
5. Blocks of a dealt group then meet two by two, but blocks of one and the same class; only texts of different classes
   are compared. So all pairs of each group are compared or known to be of one class: no candidate is dropped. A group
   whose texts don't link costs the square of its size.

Rows travel as digests of some 100 bytes; the texts of candidates are written once, behind one join, and once a group.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, joined, key_filter, probably_in, quoted, row_hash, slices, table
from .components import components

WORDS, COUNTER_BITS = 5, 18
BANDS, ROWS = 10, 3
TABLE, BLOCK = 1 << 16, 1 << 18
CHUNK, CHUNK_BYTES, HUBS = 1024, 4 << 20, 48
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_kept: dict[int, np.ndarray] = {}


def _powers(n: int, base: int) -> np.ndarray:
    """Powers of an odd base modulo 2^64; a worker keeps as many as a block needs."""
    if len(_kept.get(base, ())) < n:
        steps = np.full(max(n, BLOCK), base & (2**64 - 1), np.uint64)
        steps[0] = 1
        _kept[base] = np.multiply.accumulate(steps, dtype=np.uint64)
    return _kept[base][:n]


def _cuts(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Blocks of about BLOCK bytes that end at white space or with a text (later only if a word is longer)."""
    n, a = len(raw), 0
    while a < n:
        b, width = min(a + BLOCK, n), BLOCK
        while b < n:
            part = raw[a:b]
            white = np.flatnonzero((part == 32) | ((part >= 9) & (part <= 13)))
            text = int(offsets[np.searchsorted(offsets, b, side="right") - 1])
            stop = max(a + int(white[-1]) + 1 if len(white) else 0, text)
            if stop > a:
                b = stop
                break
            width *= 2
            b = min(a + width, n)
        yield a, b
        a = b


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word; words are runs of other bytes than ASCII white space, ASCII letters lowered."""
    found, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    back = pow(_BASE, -1, 2**64)
    for a, b in _cuts(raw, offsets):
        part, n = raw[a:b], b - a
        edges = offsets[np.searchsorted(offsets, a, side="right") : np.searchsorted(offsets, b, side="left")] - a  # texts that begin inside
        black = (part != 32) & ((part < 9) | (part > 13))
        first, last = black.copy(), black.copy()
        first[1:] &= ~black[:-1]
        last[:-1] &= ~black[1:]
        first[edges], last[edges - 1] = black[edges], black[edges - 1]
        starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
        low = part + ((part >= 65) & (part <= 90)).astype(np.uint8) * np.uint8(32)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE), dtype=np.uint64, out=total[1:])
        found.append(_mix((total[stops] - total[starts]) * _powers(n, back)[starts]))
        owners.append(np.searchsorted(offsets, starts + a, side="right") - 1)
    return np.concatenate(found), np.concatenate(owners)


def _counter(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)


def shingles(raw: np.ndarray, offsets: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles by text: (text, hash, weight), sorted; and the words' hashes and texts.

    A text of one to four words has one shingle, of all its words; one without words has none.
    """
    h, text = words(raw, offsets)
    rare = idf[_counter(h)]
    m = len(h) - WORDS + 1
    code, weight = np.zeros(max(m, 0), np.uint64), np.zeros(max(m, 0))
    for k in range(WORDS if m > 0 else 0):
        code = _mix(code + h[k : k + m])
        weight += rare[k : k + m]
    whole = text[:m] == text[WORDS - 1 :] if m > 0 else np.zeros(0, bool)
    code, weight, owner = code[whole], weight[whole] / WORDS, text[:m][whole] if m > 0 else text[:0]
    count = np.bincount(text, minlength=len(offsets) - 1)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        at = np.cumsum(count) - count
        extra = []
        for t in short.tolist():
            one = np.zeros(1, np.uint64)
            for x in h[at[t] : at[t] + count[t]]:
                one = _mix(one + x)
            extra.append((one[0], rare[at[t] : at[t] + count[t]].mean()))
        code = np.concatenate([code, np.array([c for c, _ in extra], np.uint64)])
        weight = np.concatenate([weight, [w for _, w in extra]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((code, owner))
    code, weight, owner = code[order], weight[order], owner[order]
    new = np.ones(len(code), bool)
    new[1:] = (code[1:] != code[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.concatenate([at, [len(code)]]))
    return owner[at], code[at], weight[at] * times, h, text


class Sampler:
    """Improved consistent weighted sampling; its random numbers come from tables, by a hash of the shingle."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        size = (BANDS * ROWS, TABLE)
        self.r = rng.gamma(2, 1, size).astype(np.float32)
        self.ln_c = np.log(rng.gamma(2, 1, size)).astype(np.float32)
        self.beta = rng.random(size).astype(np.float32)
        self.odd = rng.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def sample(self, owner: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """n x 30 sample hashes; zeros for a text without shingles."""
        out = np.zeros((n, BANDS * ROWS), np.uint64)
        if not len(code):
            return out
        starts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        size, ln_w = np.diff(np.concatenate([starts, [len(code)]])), np.log(weight)
        for k in range(BANDS * ROWS):
            at = ((code * self.odd[k]) >> np.uint64(48)).astype(np.int64)
            r, beta = self.r[k][at], self.beta[k][at]
            t = np.floor(ln_w / r + beta)
            ln_a = self.ln_c[k][at] - r * (t - beta + 1)
            least = np.flatnonzero(ln_a == np.repeat(np.minimum.reduceat(ln_a, starts), size))
            texts = owner[least]
            pick = least[np.concatenate([[True], texts[1:] != texts[:-1]])]  # of equals the least hash
            out[owner[pick], k] = _mix(code[pick] + t[pick].astype(np.int64).astype(np.uint64) * _M2)
        return out


def document_frequencies(docs: DataFrame, text: str = "text") -> tuple[np.ndarray, int]:
    """Rows that hold a word of each counter, and rows with words. The driver gets 2^18 sums."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, rows = np.zeros(1 << COUNTER_BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, text):
                raw, offsets = joined(part.column(text))
                h, owner = words(raw, offsets)
                seen = np.unique(owner << COUNTER_BITS | _counter(h))
                sums += np.bincount(seen & ((1 << COUNTER_BITS) - 1), minlength=1 << COUNTER_BITS)
                rows += len(np.unique(owner))
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(sums[at], rows), pa.int64())})

    got = docs.select(quoted(text)).mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toPandas()
    sums = np.zeros((1 << COUNTER_BITS) + 1, np.int64)
    sums[got["at"].to_numpy()] = got["n"].to_numpy()
    return sums[:-1], int(sums[-1])


def idf_weights(frequencies: np.ndarray, rows: int) -> np.ndarray:
    """From 1 (a word of every row) to 2 (of none): the same for a share of rows at every size."""
    return 1 + np.log((2 + rows) / (1 + frequencies)) / np.log(2 + rows)


def sketch(docs: DataFrame, idf, keys: list[str], text: str = "text") -> DataFrame:
    """keys, node (digest of the words, null without words), size (bytes of the text) and bands."""
    schema = docs.select(*map(quoted, keys)).schema
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    sampler = docs.sparkSession.sparkContext.broadcast(Sampler())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                raw, offsets = joined(part.column(text))
                owner, code, weight, h, word_text = shingles(raw, offsets, idf.value)
                n = part.num_rows
                got = sampler.value.sample(owner, code, weight, n)
                at = np.searchsorted(word_text, np.arange(n + 1))
                data = h.tobytes()
                node = [hashlib.blake2b(data[8 * a : 8 * b], digest_size=16).digest() if b > a else None for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                bands = np.zeros((n, BANDS), np.uint64)
                for b in range(BANDS):
                    for k in range(ROWS):
                        bands[:, b] = _mix(bands[:, b] + got[:, b * ROWS + k])
                    bands[:, b] += np.uint64(b)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keys], pa.array(node, pa.binary()), pa.array(np.diff(offsets)), lists], names=[*keys, "node", "size", "bands"])

    return docs.select(*map(quoted, dict.fromkeys([*keys, text]))).mapInArrow(run, f"{kind}, node binary, size bigint, bands array<bigint>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    rest = a[1].sum() + b[1].sum() - both
    return float(both / rest) if rest else 0.0


def forest(raw: np.ndarray, offsets: np.ndarray, idf: np.ndarray, threshold: float, known: np.ndarray | None = None, first: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) that span the classes of the texts: all pairs are compared but those known to be of one class.

    known: a class of each text to begin with. Where 0 < first < n, the first texts are only compared with the others.
    """
    owner, code, weight, _, _ = shingles(raw, offsets, idf)
    n = len(offsets) - 1
    cut = np.searchsorted(owner, np.arange(n + 1))
    _, local = np.unique(code, return_inverse=True)
    total = np.bincount(owner, weight, n)
    mine, root, out = np.zeros(local.max(initial=-1) + 1), np.arange(n) if known is None else known.copy(), []
    split = 0 < first < n
    for i in range(first if split else n - 1):
        to = first if split else i + 1
        a, b, c = cut[i], cut[i + 1], cut[to]
        if a == b or not (root[to:] != root[i]).any():
            continue
        mine[local[a:b]] = weight[a:b]
        both = np.bincount(owner[c:], np.minimum(weight[c:], mine[local[c:]]), n)[to:]
        mine[local[a:b]] = 0
        rest = total[i] + total[to:] - both
        for j in (np.flatnonzero(both >= (threshold - 1e-12) * rest) + to).tolist():
            if total[j] and root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((i, j))
    return out


def _grouped(members: DataFrame) -> DataFrame:
    """members (key, node, size) of keys with two nodes or more, with parts; of keys with the same nodes one stays."""
    h = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "node"))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), h(1).alias("x"), h(2).alias("y")).where("n > 1")
    parts = F.when(F.col("n") <= HUBS, 1).otherwise(F.ceil(F.greatest(F.col("n") / CHUNK, F.col("bytes") / CHUNK_BYTES))).cast("long")
    one = table(sizes.groupBy("n", "bytes", "x", "y").agg(F.min("key").alias("key")).select("key", "n", parts.alias("parts")), "groups")
    return members.join(one.hint("merge"), "key")  # both sides are tables: so the join can split a hot key


def _dealt(members: DataFrame) -> DataFrame:
    """members (key, node, n, parts) as (g, node): hubs in all parts of their group, the others in one."""
    hub = F.pmod(F.xxhash64(F.lit(3), "node", "key"), F.col("n")) < HUBS
    part = F.pmod(F.xxhash64(F.lit(4), "node", "key"), F.col("parts"))
    where = F.when((F.col("parts") > 1) & hub, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(part))
    return members.select("node", "key", F.explode(where).alias("part")).select(F.xxhash64("key", "part").alias("g"), "node", F.col("node").alias("class"), F.lit(0).alias("side"))


def _paired(members: DataFrame, label: DataFrame) -> DataFrame:
    """members (key, node, size) of split groups as (g, node, class, side): every two blocks of a group, and every block
    with itself, unless all their texts are of one class. A block is half a task; large classes have blocks of their own."""
    load = lambda n, size: F.greatest(F.col(n) / (CHUNK / 2), F.col(size) / (CHUNK_BYTES / 2))
    own = table(members.select("key", "node", "size").join(label.hint("merge"), "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("class")), "own")
    sums = own.groupBy("key", "class").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    pools = table(sums.withColumn("pool", F.when(load("n", "bytes") >= 0.5, F.col("class"))), "pools")
    parts = table(pools.groupBy("key", "pool").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).select("key", "pool", F.ceil(load("n", "bytes")).cast("long").alias("parts")), "parts")
    blocks = table(parts.select("key", "pool", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select("key", "pool", F.xxhash64("key", "pool", "part").alias("block")), "blocks")
    a, b = blocks.alias("a"), blocks.alias("b")
    one = F.coalesce(F.col("a.pool") == F.col("b.pool"), F.lit(False))
    both = a.hint("merge").join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.block") <= F.col("b.block")) & ~one)
    pairs = table(both.select(F.col("a.block").alias("x"), F.col("b.block").alias("y"), F.xxhash64("a.block", "b.block").alias("g")), "pairs")
    sides = pairs.select(F.col("x").alias("block"), "g", F.lit(0).alias("side")).union(pairs.where("x <> y").select("y", "g", F.lit(1)))
    pooled = own.join(pools.select("key", "class", "pool").hint("merge"), ["key", "class"]).alias("o").join(parts.hint("merge").alias("p"), (F.col("o.key") == F.col("p.key")) & F.col("o.pool").eqNullSafe(F.col("p.pool")))
    placed = table(pooled.select(F.xxhash64("o.key", "o.pool", F.pmod(F.xxhash64(F.lit(5), "node", "o.key"), F.col("parts"))).alias("block"), "node", "class"), "placed")
    return placed.join(sides.hint("merge"), "block").select("g", "node", "class", "side")


def _links(dealt: DataFrame, texts: DataFrame, idf, threshold: float) -> DataFrame:
    """u, v: links between texts of one group (g, node, class, side) and of different classes; see forest() for sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            names = t.column("node").to_pylist()
            known = np.unique(np.array([c.hex() for c in t.column("class").to_pylist()]), return_inverse=True)[1]
            first = int((t.column("side").to_numpy() == 0).sum())
            found = forest(*joined(t.column("text").combine_chunks()), idf.value, threshold, known, first)
            ends = [sorted((names[i], names[j])) for i, j in found if names[i] != names[j]]
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            g = batch.column("g").to_numpy()
            edges = [0, *(np.flatnonzero(g[1:] != g[:-1]) + 1).tolist(), len(g)]
            for x, y in zip(edges, edges[1:], strict=False):
                if held and y > x and held[0].column("g")[0].as_py() != int(g[x]):
                    yield close()
                    held = []
                if y > x:
                    held.append(batch.slice(x, y - x))
        if held:
            yield close()

    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.hint("merge").join(texts, "node").select("g", "node", "class", "side", "text").repartition(n, "g").sortWithinPartitions("g", "side").mapInArrow(run, "u binary, v binary")


def classes(docs: DataFrame, keys: list[str], text: str = "text", threshold: float = 0.8) -> DataFrame:
    """keys, node and class (the least node of the class) of every row; both null for texts without words.

    The last of keys is a hash of the row.

    Rows whose words are equal are of one node; nodes linked by similarity >= threshold are of one class.
    """
    spark = docs.sparkSession
    frequencies, rows = document_frequencies(docs, text)
    idf = spark.sparkContext.broadcast(idf_weights(frequencies, rows))
    sketched = table(sketch(docs, idf, keys, text), "sketch")
    nodes = table(sketched.where("node is not null").groupBy("node").agg(F.max("size").alias("size"), F.first("bands").alias("bands"), F.min(F.struct(*map(quoted, keys))).alias("k")), "nodes")
    members = table(_grouped(nodes.select(F.explode("bands").alias("key"), "node", "size")), "members")
    split = members.where("parts > 1").select("key", "node").join(nodes.select("node", "size", F.explode("bands").alias("other")), "node").where("other <> key")
    second = _grouped(split.select(F.xxhash64(F.least("key", "other"), F.greatest("key", "other")).alias("key"), "node", "size").distinct())
    dealt = table(_dealt(members).union(_dealt(second)), "dealt")
    # The texts of candidates, each from the row with the least keys: one pass over all texts.
    of = nodes.select("node", "k").join(dealt.select("node").distinct(), "node", "left_semi")
    t = free_name(keys, "__text")
    tagged = docs.select(*map(quoted, keys), quoted(text).alias(t))
    same = F.lit(True)
    for c in keys:
        same = same & quoted(c).eqNullSafe(F.col("k")[c])
    of = table(of, "of")
    # Tables that grow with the input are never broadcast, at any size.
    near = probably_in(tagged, keys[-1], key_filter(of.select(F.col("k")[keys[-1]].alias("r")), "r"))
    texts = table(near.join(of.hint("merge"), same).select("node", F.col(t).alias("text")).dropDuplicates(["node"]), "texts")
    label = components(_links(dealt, texts, idf, threshold))
    if not (wide := members.where("parts > 1")).isEmpty():
        paired = table(_paired(wide, label), "paired")
        if not paired.isEmpty():
            found = _links(paired, texts, idf, threshold)
            label = components(label.select(F.col("node").alias("u"), F.col("root").alias("v")).union(found))
    rows_ = sketched.select(*[quoted(c).alias(f"k{i}") for i, c in enumerate(keys)], F.col("node").alias("own")).join(label.hint("merge"), F.col("own") == F.col("node"), "left")
    return rows_.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keys)], F.col("own").alias("node"), F.coalesce("root", "own").alias("class"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, row (hash of the whole row), class_id, class_size and kept, one row a row of docs.

    class_id is the least doc_id of the class (nulls last). One row of each class is kept: that of the least
    doc_id, then row hash; of rows equal in all columns one. Texts without words (null, empty) are never linked:
    they are classes of their own and kept.
    """
    row, key = free_name(docs.columns, "__row"), "id"
    hashed = docs.select(quoted(doc_id).alias(key), row_hash(docs, 29).alias(row), quoted(text).alias("text"))
    found = table(classes(hashed, [key, row], "text", threshold), "classes")
    rank = F.struct(F.col(key).isNull().alias("n"), F.col(key).alias("i"), F.col(row).alias("r"))
    best = table(found.where("class is not null").groupBy(F.col("class").alias("c")).agg(F.min(rank).alias("k"), F.count("*").alias("size")).where("size > 1"), "best")
    both = found.join(best.hint("merge"), F.col("class") == F.col("c"), "left")
    copy = F.row_number().over(Window.partitionBy(row, key).orderBy(row))
    first = F.col("k").isNull() | (F.col(key).eqNullSafe(F.col("k.i")) & (F.col(row) == F.col("k.r")))
    out = both.select(F.col(key).alias(doc_id), F.col(row).alias("row"), F.when(F.col("k").isNull(), F.col(key)).otherwise(F.col("k.i")).alias("class_id"), F.coalesce("size", F.lit(1)).cast("long").alias("class_size"), (first & (F.col("class").isNull() | (copy == 1))).alias("kept"))
    return out


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, one of each class; all rows without words."""
    row, n = free_name(docs.columns, "__row"), free_name(docs.columns, "__n")
    keep = near_duplicates(docs, doc_id, text, threshold).where("kept").groupBy(F.col("row").alias(row)).agg(F.count("*").alias(n))
    rows = docs.withColumn(row, row_hash(docs, 29)).join(keep.hint("merge"), row)
    return rows.withColumn(n, F.row_number().over(Window.partitionBy(row).orderBy(row)) <= F.col(n)).where(F.col(n)).select(*map(quoted, docs.columns))


def digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs.select("doc_id", "text")).select("doc_id", "class_id", "class_size", "kept")
