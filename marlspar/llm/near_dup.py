"""Near-duplicate classes: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

Words are runs of digits, ASCII letters (A-Z lower-cased) and characters above ASCII; shingles are five
consecutive words, or all words of a shorter text. A shingle's weight is 1 + ln(count) in the
document (a line repeated a thousand times must not outweigh all else) times 1 + idf / ln(1 + N) / 16, idf = ln((1 + N) / (1 + df)), with df counted over all N documents in 2^18
hash buckets: a table of fixed size whatever the corpus. The factor lies between 1 and 1 + 1/16, so that a
text's own changes, whose shingles are rare, don't part it from the copies of a large group, whose shared
shingles are the most frequent of all: where no shingle repeats, every pair of a plain Jaccard similarity of
0.81 or more is one of 0.8 or more here (0.81 / 0.19 > 4 (1 + 1/16)), and none below 0.7901 is.

1. Every text gets a node (128 bits of its word sequence; equal sequences are one node), and 42
   consistent weighted samples (shingle, quantised weight) in 14 bands of 3.
2. In each band bucket every node is compared with one centre: a star, not all pairs. A bucket proposes its
   node of the most common shingles (of a family of copies that is the original, which holds none of the
   copies' own changes); a node takes what most of its buckets propose, and a bucket what most of its nodes
   took, so that the buckets of one family agree. Weighted Jaccard similarity is computed on the whole texts; 0.8
   or more is a link.
3. A node x that its centre c does not link may still link to another node y of the star. Let dx = x - r as
   weight vectors, r being the centre
   without the shingles that are too rare for half of the star, or zero in stars whose nodes are nearer to zero, |.| the sum of absolute weights, T = (1 - 0.8) / (1 + 0.8). A link means
   |x - y| <= T (|x| + |y|), and |x - y| >= |dx| + |dy| - 2 overlap(dx, dy), so the deviations from
   r must overlap by (|dx| + |dy| - T (|x| + |y|)) / 2. With the parts of dy in one fixed order, rare
   buckets first, the first common part has at least that much weight from it on. Joining on (star, part) under these bounds finds every possible pair that needs common parts; those
   that need none, |dx| + |dy| <= T (|x| + |y|), are links all, and the node with the least |d| - T |.| of
   the star has one to each of theirs; independent variants of
   one text share no rare part and meet nobody. What is found is verified. Stars lose no link.
4. Connected components of the links are the classes; the least doc_id of a class is its class_id.

A pair of similarity 0.8 shares no bucket with a chance of (1 - 0.8^3)^14 = 4e-5.

Rows are known by id and a hash of the text, so ids that repeat or are null cost no more than others.

Defined cases: a null text is empty; a text without words is a class of its own; null ids take part and
their class_id is the class's least id (null if it has none); repeated rows fall into one class; an empty
table gives no rows; columns other than id and text are not read; very long texts are read whole.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blocks, flat, lean, map_batches, narrow, stage
from .components import components
from .hashing import mix, tokens

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 14, 3, 0.8
DF_BITS = 18
#: How much of its weight a shingle that one document holds has more than one that all hold.
IDF_SHARE = 1 / 16
_STEP = np.uint64(0xD6E8FEB86659FD93)
_OTHER = np.uint64(0xA0761D6478BD642F)
#: Shingles that meet all samples in one go: bounds a worker's memory for long texts.
SLAB = 512


@cache
def _gamma() -> tuple[np.ndarray, np.ndarray]:
    """2^16 quantiles of Gamma(2, 1) and their logarithms, by Newton's method on 1 - (1 + x) exp(-x)."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = np.sqrt(2 * u) + u
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - u) / (x * np.exp(-x)), 1e-6)
    return x.astype(np.float32), np.log(x).astype(np.float32)


@cache
def _seeds(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingles(owner: np.ndarray, words: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all shingles, offsets of each document's) for tokens as from hashing.tokens."""
    per_doc = np.bincount(owner, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    number = np.where(per_doc >= SHINGLE, per_doc - SHINGLE + 1, np.minimum(per_doc, 1))
    at = np.concatenate([[0], np.cumsum(number)])
    starts = np.repeat(first[:-1] - at[:-1], number) + np.arange(at[-1])
    short = np.repeat(per_doc < SHINGLE, number)
    padded = np.concatenate([words, np.zeros(SHINGLE, np.uint64)])
    out = np.zeros(len(starts), np.uint64)
    size = np.repeat(np.minimum(per_doc, SHINGLE), number)
    for i in range(SHINGLE):
        part = padded[starts + i]
        if short.any():
            part = np.where(size > i, part, 0)
        out = out * _STEP + part
    return mix(out ^ size.astype(np.uint64)), at


def nodes(owner: np.ndarray, words: np.ndarray, n_docs: int) -> list[bytes | None]:
    """128 bits of each document's word sequence; None without words."""
    per_doc = np.bincount(owner, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    place = (np.arange(len(words)) - np.repeat(first[:-1], per_doc)).astype(np.uint64)
    some = np.flatnonzero(per_doc)
    out: list[bytes | None] = [None] * n_docs
    if len(some):
        both = [np.add.reduceat(mix(words * a + mix(place + b)), first[some]) for a, b in ((_STEP, np.uint64(1)), (_OTHER, np.uint64(1) << np.uint64(40)))]
        for i, x in zip(some.tolist(), np.stack(both, 1).astype("<u8")):
            out[i] = x.tobytes()
    return out


def signature(hashes: np.ndarray, weights: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys from bands * rows consistent weighted samples of distinct shingles."""
    n = bands * rows
    radius, log_radius = _gamma()
    seeds, low = _seeds(n), np.uint64(0xFFFF)
    best = np.full(n, np.inf, np.float32)
    shingle, level = np.zeros(n, np.uint64), np.zeros(n, np.float32)
    log_weights = np.log(weights).astype(np.float32)
    for first in range(0, len(hashes), SLAB):
        own = hashes[first : first + SLAB]
        x = own[:, None] * seeds
        x ^= x >> np.uint64(29)
        x *= _OTHER
        r = radius[x >> np.uint64(48)]
        beta = ((x >> np.uint64(32)) & low).astype(np.float32) * np.float32(1 / 65536)
        t = np.floor(log_weights[first : first + SLAB, None] / r + beta)
        a = log_radius[(x >> np.uint64(16)) & low] - r * (t - beta + np.float32(1))
        at = a.argmin(axis=0)
        least = a[at, np.arange(n)]
        better = least < best
        best = np.where(better, least, best)
        shingle, level = np.where(better, own[at], shingle), np.where(better, t[at, np.arange(n)], level)
    samples = mix(shingle + level.astype(np.int64).astype(np.uint64) * _STEP).reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        key = mix(key * _STEP + samples[:, i])
    return key.view(np.int64)


def weighted(hashes: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, ascending, and their weights in one document."""
    own, counts = np.unique(hashes, return_counts=True)
    return own, (1 + np.log(counts)) * factors[own >> np.uint64(64 - DF_BITS)]


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    both = np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum() if len(b[0]) else 0.0
    total = a[1].sum() + b[1].sum() - both
    return float(both / total) if total else 0.0


def _document_frequencies(batches):
    counts, n = np.zeros(1 << DF_BITS, np.int64), 0
    for batch in batches:
        data, at = flat(batch["text"])
        n += batch.num_rows
        for first, last in blocks(at):
            owner, words = tokens(data, at[first : last + 1])
            hashes, own = shingles(owner, words, last - first)
            docs = np.repeat(np.arange(last - first, dtype=np.int64), np.diff(own))
            pairs = np.unique(docs << DF_BITS | (hashes >> np.uint64(64 - DF_BITS)).astype(np.int64))
            counts += np.bincount(pairs & ((1 << DF_BITS) - 1), minlength=1 << DF_BITS)
    found = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1), pa.int32()), pa.array(np.append(counts[found], n))], ["bucket", "df"])


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold a shingle of each hash bucket, all documents); 2^18 + 1 counts reach the driver."""
    counted = map_batches(docs.select("text"), lean(_document_frequencies), "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toArrow()
    bucket, df = counted["bucket"].to_numpy(), counted["df"].to_numpy()
    table = np.zeros(1 << DF_BITS, np.int64)
    table[bucket[bucket >= 0]] = df[bucket >= 0]
    return table, int(df[bucket == -1].sum())


def factors(df: np.ndarray, n: int) -> np.ndarray:
    """The weight factor of each hash bucket."""
    return 1 + IDF_SHARE * np.log((1 + n) / (1 + df)) / max(np.log(1 + n), 1e-9)


def _sketch(table):
    def run(batches):
        for batch in batches:
            data, at = flat(batch["text"])
            keys, bands, rarity = [], [], []
            for first, last in blocks(at):
                owner, words = tokens(data, at[first : last + 1])
                hashes, own = shingles(owner, words, last - first)
                keys += nodes(owner, words, last - first)
                for i in range(last - first):
                    part = hashes[own[i] : own[i + 1]]
                    distinct = weighted(part, table.value)
                    bands.append(signature(*distinct) if len(part) else None)
                    rarity.append(round(float(table.value[part >> np.uint64(64 - DF_BITS)].mean()), 9) if len(part) else None)
            names = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(rarity, pa.float64())], [*names, "node", "bands", "rarity"])

    return run


def deviation(x: tuple[np.ndarray, np.ndarray], centre: tuple[np.ndarray, np.ndarray], factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parts, behind): the signed differences of x from the centre, rare buckets first, and the absolute
    weight from each part to the end."""
    both = np.union1d(x[0], centre[0])
    difference = np.zeros(len(both))
    difference[np.searchsorted(both, x[0])] += x[1]
    difference[np.searchsorted(both, centre[0])] -= centre[1]
    some = np.abs(difference) > 1e-12
    both, difference = both[some], difference[some]
    order = np.lexsort((both, -factors[both >> np.uint64(64 - DF_BITS)]))
    both, difference = both[order], difference[order]
    parts = both ^ np.where(difference > 0, _OTHER, np.uint64(0))
    return parts.view(np.int64), np.cumsum(np.abs(difference)[::-1])[::-1].copy()


def _sides(table):
    """Weighted shingles of a node's text; the latest nodes are kept, as rows of one star come together."""
    seen: dict[bytes, tuple] = {}

    def side(key: bytes, data, a: int, b: int):
        if key not in seen:
            if len(seen) >= 256:
                seen.clear()
            owner, words = tokens(data, np.array([a, b], np.int64))
            seen[key] = weighted(shingles(owner, words, 1)[0], table.value)
        return seen[key]

    def pairs(batch):
        a, b = batch["a"].to_pylist(), batch["b"].to_pylist()
        (data_a, at_a), (data_b, at_b) = flat(batch["text_a"]), flat(batch["text_b"])
        for i in range(batch.num_rows):
            yield side(a[i], data_a, at_a[i], at_a[i + 1]), side(b[i], data_b, at_b[i], at_b[i + 1])

    return pairs


def _compare(table):
    def run(batches):
        pairs = _sides(table)
        for batch in batches:
            found = [(weighted_jaccard(x, y), x[1].sum(), y[1].sum()) for x, y in pairs(batch)]
            yield pa.RecordBatch.from_arrays([batch["a"], batch["b"], *(pa.array([f[i] for f in found], pa.float64()) for i in range(3))], ["a", "b", "sim", "total_a", "total"])

    return run


def _deviate(table, frequencies, similarity: float):
    bound = (1 - similarity) / (1 + similarity)

    def run(batches):
        pairs = _sides(table)
        for batch in batches:
            rows = []
            for (c, y), n, centred in zip(pairs(batch), batch["n"].to_pylist(), batch["centred"].to_pylist(), strict=True):
                held = frequencies.value[c[0] >> np.uint64(64 - DF_BITS)] >= n / 2 if centred else np.zeros(len(c[0]), bool)
                parts, behind = deviation(y, (c[0][held], c[1][held]), table.value)
                size, total = behind[0] if len(behind) else 0.0, y[1].sum()
                # what an unlinked x must share with y at least: |dx| > T (|x| + |c|) - |c - r|, and |dx| = |x| if r is zero
                least = (size + bound * (c[1].sum() - total) - c[1][~held].sum()) / 2 if centred else (1 - bound) / 2 * (1 + similarity) * total
                rows.append((parts, behind, size, least))
            kinds = pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.float64()
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("a", "b", "sim", "total")), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["a", "b", "sim", "total", "parts", "behind", "size", "least"])

    return run


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    own = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    other = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(own, "a").join(other, "b").select(*pairs.columns, "text_a", "text_b")


def _verify(pairs: DataFrame, texts: DataFrame, table) -> DataFrame:
    """pairs (a, b) with their similarity sim and the total weights of a and b, staged."""
    return stage(map_batches(_with_texts(pairs, texts), lean(_compare(table)), "a binary, b binary, sim double, total_a double, total double"), "similar")


def _within_stars(star: DataFrame, label: DataFrame, texts: DataFrame, table, frequencies, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of one star, of different labels so far, that may be similar; see the module."""
    bound, slack = (1 - similarity) / (1 + similarity), 1e-6
    apart = (1 - F.col("sim")) / (1 + F.col("sim")) * (F.col("total_a") + F.col("total"))
    stars = star.groupBy("a").agg(F.count("*").alias("n"), F.min("sim").alias("worst"), (F.avg(apart) < F.avg("total")).alias("centred"))
    several = stars.filter((F.col("n") > 1) & (F.col("worst") < similarity)).select("a", "n", "centred")
    wide = _with_texts(star.select("a", "b", "sim", "total").join(several, "a"), texts)
    parts = map_batches(wide, lean(_deviate(table, frequencies, similarity)), "a binary, b binary, sim double, total double, parts array<long>, behind array<double>, size double, least double")
    named = stage(parts.join(label.withColumnRenamed("node", "b"), "b", "left").withColumn("label", F.coalesce("label", "b")), "parts")
    own = ["a", "b", "sim", "total", "label", "size", "least"]
    part = named.select(*own, F.explode(F.arrays_zip("parts", "behind")).alias("p")).select(*own, F.col("p.parts").alias("part"), F.col("p.behind").alias("behind"))
    x = part.filter(F.col("sim") < similarity).select("a", "part", *(F.col(c).alias(f"x_{c}") for c in ("b", "total", "label", "size", "behind")))
    y = part.filter(F.col("behind") >= F.col("least") - slack)
    shared = (F.col("x_size") + F.col("size") - bound * (F.col("x_total") + F.col("total"))) / 2 - slack
    fits = F.least("total", "x_total") >= (similarity - slack) * F.greatest("total", "x_total")
    near = x.join(y, ["a", "part"]).filter((F.col("label") != F.col("x_label")) & fits & (F.col("behind") >= shared) & (F.col("x_behind") >= shared))
    far = named.select("a", "b", (F.col("size") - bound * F.col("total")).alias("far"))
    nearest = far.groupBy("a").agg(F.min(F.struct("far", "b")).alias("m")).select("a", F.col("m.b").alias("x_b"), F.col("m.far").alias("least_far"))
    close = far.join(nearest, "a").filter((F.col("far") + F.col("least_far") <= slack) & (F.col("b") != F.col("x_b")))
    both = near.select("x_b", "b").unionByName(close.select("x_b", "b"))
    return both.select(F.least("x_b", "b").alias("a"), F.greatest("x_b", "b").alias("b")).distinct()


def text_key(text) -> F.Column:
    """128 bits of a text: what tells rows of one id apart."""
    return F.unhex(F.md5(text))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", keyed: bool = False) -> DataFrame:
    """One row for each row of docs: doc_id, class_id (see the module). keyed: also key (text_key of the
    text) and kept: true for the row of the least id, then key, of a class (null ids come last) and for rows
    without words; rows that repeat both id and text agree in it."""
    spark, own = docs.sparkSession, narrow(docs, id_col, text_col, binary=True).withColumn("key", text_key("text"))
    row = ["doc_id", "key"] if keyed else ["doc_id"]
    df, n = document_frequencies(own)
    table, frequencies = spark.sparkContext.broadcast(factors(df, n)), spark.sparkContext.broadcast(df)
    rows = stage(map_batches(own, lean(_sketch(table)), "doc_id long, key binary, node binary, bands array<long>, rarity double"), "sketches")
    holder = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("holder")  # the row whose text stands for the node
    known = rows.filter("node IS NOT NULL").groupBy("node").agg(holder, F.first("bands").alias("bands"), F.min("rarity").alias("rarity"))
    member = stage(known.select("node", "holder", F.struct("rarity", "node").alias("best"), F.explode("bands").alias("bucket")), "members")
    shared = member.groupBy("bucket").agg(F.count("*").alias("n"), F.min("best").alias("best")).filter("n > 1").select("bucket", "best")
    member = stage(member.drop("best").join(shared, "bucket"), "shared")
    often = lambda rows, of, what: rows.groupBy(of, what).agg(F.count("*").alias("n")).groupBy(of).agg(F.min(F.struct((-F.col("n")).alias("n"), what))[what].alias("most"))
    hub = often(member, "node", "best").withColumnRenamed("most", "hub")
    centre = often(member.join(hub, "node"), "bucket", "hub").select("bucket", F.col("most.node").alias("centre"))
    wanted = member.select("node", F.col("holder.doc_id").alias("id"), F.col("holder.key").alias("hash")).distinct()
    found = own.join(wanted, own["doc_id"].eqNullSafe(wanted["id"]) & (own["key"] == wanted["hash"])).select("node", "text")
    texts = stage(found.dropDuplicates(["node"]), "texts")

    spokes = member.join(centre, "bucket").filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    star = _verify(spokes, texts, table)
    label = components(star.filter(F.col("sim") >= similarity).select("a", "b"))
    rest = _verify(_within_stars(star, label, texts, table, frequencies, similarity), texts, table)
    more = rest.filter(F.col("sim") >= similarity).select("a", "b")
    label = components(label.select(F.col("node").alias("a"), F.col("label").alias("b")).union(more))

    labelled = stage(rows.select(*row, "node").join(label, "node", "left").select(*row, F.coalesce("label", "node").alias("label")), "labelled")
    order = F.struct(F.col("doc_id").isNull().alias("none"), *row)
    least = labelled.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("class_id"), *([F.min(order).alias("first")] if keyed else []))
    kept = [(F.col("label").isNull() | order.eqNullSafe(F.col("first"))).alias("kept")] if keyed else []
    return labelled.join(least, "label", "left").select(*row, F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), *kept)


def op3(docs: DataFrame) -> DataFrame:
    found = near_duplicates(docs)
    return found.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))
