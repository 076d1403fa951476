"""MinHash near-dedup with SetSketch registers: band register values, estimate by likelihood, verify on full sets.

A SetSketch register is the minimum of exponential hash values of a set's elements, put on an exponential scale
(floor(1 - log_b h), truncated to 0..q+1). Registers merge by maximum and agree with a probability that grows with
the Jaccard similarity. Bands of registers are the bucket keys; pairs that meet are scored by the joint likelihood of
their registers, and those that the likelihood-ratio test cannot rule out are confirmed on their full shingle sets.
With a base near 1 the registers of unrelated sets of one size agree once in 4,000, so a band of five has about 60 bits and texts
that have nothing in common do not meet, however many there are.

Texts with equal sets form one node first, so copies cost a hash. Buckets of at most SMALL nodes emit their pairs. In a
larger one every node is compared with a leader of another component, a few times, and components merge. Nodes of such
buckets that are still in different components then meet by an exact prefix filter instead of by the bucket: with all
shingles in one order, rare ones first, two sets of similarity t or more share one of their first n - ceil(t n) + 1, and
the places of the first shared one, and parity bits of the sets, bound the rest. Noise that sets a text apart from a group is rare, so what a large group
of copies leaves over costs a few candidates each, not one for each member. The order comes from a table of counts of fixed size: any order gives
the same links, a better one fewer candidates. Shingles that many sets have in their prefix are dealt over several tasks.

Defined results: null or wordless texts have an empty set and link with nothing; equal texts link; rows that repeat an
id count as one row of the result each, and take the component of their text; a null id links with nothing and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, hashed, heavy, likely, ready, released, shingle_ids, shingle_sets, stored

#: Sketch parameters: base and rate of the register scale, largest register value less one.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: A pair is ruled out if its likelihood at the threshold is below e^-18 of its best (6 deviations), so that far fewer pairs at the threshold are lost than by the bands.
RULED_OUT = 18.0
#: Ids whose registers are computed at once: few enough for a processor's cache.
STEP = 16384
#: Nodes of a bucket that emits all its pairs; rounds of leaders for larger ones.
SMALL, LEADER_ROUNDS = 6, 2
#: Cells of the table of shingle counts (8 bytes each, so it can be sent to every task); rows of a shingle that one task joins.
CELLS, HOT = 1 << 18, 400
#: Longs of a set's parity bits, and their columns.
LONGS = 8
ODD = [f"odd{i}" for i in range(LONGS)]


def _family(m: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20_240_611)
    return r.integers(0, 2**32, m, dtype=np.uint32) | np.uint32(1), r.integers(0, 2**32, m, dtype=np.uint32)


def registers(ids: np.ndarray, bounds: np.ndarray, m: int) -> np.ndarray:
    """m SetSketch registers (uint16) of each set of 64-bit ids, where ids holds one set after the other; bounds: how many ids come before each set, and all. Of an empty set: 0."""
    mul, xor = _family(m)
    full = np.flatnonzero(np.diff(bounds))
    begin = bounds[full]
    low = np.full((m, len(full)), 2**32 - 1, np.uint32)
    x = (ids >> np.uint64(32)).astype(np.uint32)
    room = np.empty((2, STEP), np.uint32)
    for at in range(0, len(x), STEP):
        part = x[at : at + STEP]
        h, g = room[:, : len(part)]
        first, last = np.searchsorted(begin, at, "right") - 1, np.searchsorted(begin, at + len(part))
        where = np.maximum(begin[first:last] - at, 0)
        for i in range(m):
            np.bitwise_xor(part, xor[i], out=h)
            np.multiply(h, mul[i], out=h)
            np.right_shift(h, np.uint32(15), out=g)
            np.bitwise_xor(h, g, out=h)
            np.multiply(h, np.uint32(0x2C1B3C6D), out=h)
            np.minimum(low[i, first:last], np.minimum.reduceat(h, where), out=low[i, first:last])
    u = (low.astype(np.float64) + 0.5) / 2**32
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / np.log(BASE))
    out = np.zeros((len(bounds) - 1, m), np.uint16)
    out[full] = np.clip(k, 0, TOP + 1).astype(np.uint16).T
    return out


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def log_likelihood(j: np.ndarray, more: np.ndarray, less: np.ndarray, same: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Of Jaccard j, from how many registers of a are larger, smaller and equal, and the set sizes."""
    u = na / (na + nb)
    v = 1 - u
    up, down = np.clip(_p(u - v * j), 1e-12, 1), np.clip(_p(v - u * j), 1e-12, 1)
    return more * np.log(up) + less * np.log(down) + same * np.log(np.clip(1 - up - down, 1e-12, 1))


def plausible(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, least: float) -> np.ndarray:
    """Whether Jaccard >= least is plausible for register rows a, b of sets of na and nb elements."""
    more, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    same = a.shape[1] - more - less
    na, nb = na[:, None].astype(float), nb[:, None].astype(float)
    cap = np.minimum(na, nb) / np.maximum(na, nb)  # a Jaccard similarity is at most the ratio of the sizes
    grid = np.linspace(0, 1, 101)[None, :] * cap
    ll = log_likelihood(grid, more, less, same, na, nb)
    fits = np.where(grid >= least - 0.01, ll, -np.inf).max(1)
    return (cap[:, 0] >= least) & (fits >= ll.max(1) - RULED_OUT)


def _sketches(k: int, m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, h, words in hashed(batch.column("text")):
                ids, bounds = shingle_sets(h, words, k)
                n, at = np.diff(bounds), bounds.tolist()
                key = [xxhash.xxh3_128_digest(ids[a:b]) if a < b else None for a, b in zip(at[:-1], at[1:], strict=True)]
                regs = [x.tobytes() if some else None for x, some in zip(registers(ids, bounds, m), n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(row, len(n)), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(regs, pa.binary())], names=["id", "n", "key", "sketch"])

    return run


def _buckets(bands: int, rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            regs = np.frombuffer(b"".join(pdf["sketch"]), np.uint16).reshape(len(pdf), bands, rows)
            keys = np.tile(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), (len(pdf), 1))
            for j in range(rows):
                keys ^= regs[:, :, j]
                keys *= np.uint64(0xD6E8FEB86659FD93)
                keys ^= keys >> np.uint64(32)
            yield pd.DataFrame({"bucket": keys.reshape(-1).view(np.int64), "node": np.repeat(pdf["node"].to_numpy(), bands)})

    return run


def _screen(least: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            a = np.frombuffer(b"".join(pdf["sa"]), np.uint16).reshape(len(pdf), -1)
            b = np.frombuffer(b"".join(pdf["sb"]), np.uint16).reshape(len(pdf), -1)
            yield pdf.loc[plausible(a, b, pdf["na"].to_numpy(), pdf["nb"].to_numpy(), least), ["a", "b"]]

    return run


def _confirm(k: int, num: int, den: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[int, np.ndarray] = (-1, np.empty(0, np.uint64))
        for pdf in batches:
            ok = []
            for b, ta, tb in zip(pdf["b"], pdf["ta"], pdf["tb"], strict=True):
                if held[0] != b:
                    held = (b, shingle_ids(tb, k))
                x, y = shingle_ids(ta, k), held[1]
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pdf.loc[ok, ["a", "b"]].rename(columns={"a": "hi", "b": "lo"})

    return run


def _cells(k: int):
    """How many sets have a shingle in each cell, summed over a task's texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(CELLS, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total[(shingle_ids(text, k) % np.uint64(CELLS)).astype(np.int64)] += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"cell": at, "n": total[at]})

    return run


def _prefixes(k: int, num: int, den: int, count):
    """The first shingles of each set, rare cells first: at least one of them is in any set that links with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, n, odd = [], [], []
            for text in pdf["text"]:
                x = shingle_ids(text, k)
                n.append(len(x))
                odd.append(np.packbits(np.bincount((x >> np.uint64(40)).astype(np.int64) % (64 * LONGS), minlength=64 * LONGS).astype(np.uint8) & 1).view(np.int64))
                ids.append(x[np.lexsort((x, count.value[(x % np.uint64(CELLS)).astype(np.int64)]))][: len(x) + num * len(x) // -den + 1])
            if ids:
                size = np.array([len(x) for x in ids])
                of = np.repeat(np.arange(len(ids)), size)
                at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
                yield pd.DataFrame({"token": np.concatenate(ids).view(np.int64), "at": at, "node": pdf["node"].to_numpy()[of], "label": pdf["label"].to_numpy()[of], "n": np.array(n)[of], **dict(zip(ODD, np.array(odd)[of].T, strict=True))})

    return run


def prefix_pairs(texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Pairs (a > b) of texts (node, label, text) of different labels that can link: complete, by prefixes, places in them and parity.

    A set has one bit for each of 512 classes of shingles, telling whether it holds an odd number of them: where two sets'
    bits differ, one set has a shingle that the other hasn't, and there are at most (1 - t) / (1 + t) (|A| + |B|) of those.

    A shingle's rows are dealt over tasks by salt; those of its most frequent label meet the others but not one another.
    """
    spark = texts.sparkSession
    count = np.zeros(CELLS, np.int64)
    found = texts.select("text").mapInPandas(_cells(k), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    count[found["cell"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    sent = spark.sparkContext.broadcast(count)
    rows = stored(texts.mapInPandas(_prefixes(k, num, den, sent), "token long, at long, node long, label long, n long, " + ", ".join(f"{c} long" for c in ODD)), "prefixes")
    labels = rows.groupBy("token", "label").agg(F.count("*").alias("m"))
    tokens = labels.groupBy("token").agg(F.max(F.struct("m", "label")).alias("most"), F.sum("m").alias("m"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    tokens = tokens.where("lo < hi").select("token", F.col("most.label").alias("top"), F.ceil(F.col("m") / HOT).cast("long").alias("salts"))
    met = stored(rows.join(tokens, "token"), "met")
    released(rows)
    every = met.select("token", F.pmod(F.hash("node"), F.col("salts")).alias("salt"), *[F.col(c).alias(f"y_{c}") for c in ("at", "node", "label", "n", *ODD)])
    fewer = met.where("label <> top").select("token", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"x_{c}") for c in ("at", "node", "label", "n", *ODD)])
    rest = 1 + F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at")) - 1  # shingles that can still be shared from here on
    apart = sum((F.bit_count(F.col(f"x_{c}").bitwiseXOR(F.col(f"y_{c}"))) for c in ODD), F.lit(0))  # shingles of one set alone, at least
    can = (rest * (num + den) >= (F.col("x_n") + F.col("y_n")) * num) & (apart * (num + den) <= (F.col("x_n") + F.col("y_n")) * (den - num)) & (F.col("x_label") != F.col("y_label"))
    pairs = fewer.alias("x").join(every.alias("y"), (F.col("x.token") == F.col("y.token")) & (F.col("x.salt") == F.col("y.salt")) & can)
    return pairs.select(F.greatest("x_node", "y_node").alias("a"), F.least("x_node", "y_node").alias("b"))


def near_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = 32, rows: int = 5) -> DataFrame:
    """id, n (set size), component (smallest id reachable by links, itself included) for docs (id: long, text: string).

    Texts link if den * |A and B| >= num * |A or B| on their sets of k-word shingles. With 32 bands of 5 registers a
    pair at similarity 0.8 misses every band with probability below 4e-6.
    """
    spark = docs.sparkSession
    ready(spark)
    docs = docs.select(F.col("id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    all_docs = stored(docs.mapInArrow(_sketches(k, bands * rows), "id long, n long, key binary, sketch binary"), "sketches")
    some = all_docs.where("id is not null and key is not null")
    first = stored(some.groupBy("key").agg(F.min("id").alias("node"), F.min("n").alias("n"), F.min("sketch").alias("sketch")), "nodes")
    tokens = stored(first.select("node", "sketch").mapInPandas(_buckets(bands, rows), "bucket long, node long"), "tokens")
    # one shuffle of the tokens gives bucket sizes; the few heavy buckets are not shuffled
    many = heavy(tokens, ["bucket"], F.count("*").alias("size"))
    shared = tokens.join(F.broadcast(many.select("bucket")), "bucket", "left_anti").withColumn("size", F.count("*").over(Window.partitionBy("bucket"))).where("size > 1")
    live = stored(shared.unionByName(tokens.join(F.broadcast(many), "bucket")), "live")
    released(tokens, many)
    ids = stored(live.select("node").distinct(), "ids")  # written, so that its size is known to the joins
    sides = stored(likely(first, "node", ids, "node").join(ids, "node").select("node", "n", "sketch"), "sides")
    texts = stored(likely(docs, "id", ids, "node").join(ids, F.col("id") == F.col("node")).select("id", "text"), "texts")  # ids are distinct; Spark would move a semi join below the filter

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b)."""
        a = sides.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
        b = sides.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
        # pairs are written before each join, so that Spark moves them to the sketches and texts while they are the smaller side
        met = stored(pairs.distinct(), "pairs")
        left = stored(met.join(a, "a").join(b, "b").select("a", "b", "na", "nb", "sa", "sb").mapInPandas(_screen(num / den), "a long, b long"), "left")
        ta = texts.select(F.col("id").alias("a"), F.col("text").alias("ta"))
        tb = texts.select(F.col("id").alias("b"), F.col("text").alias("tb")).join(left.select("b").distinct(), "b", "left_semi")  # many pairs share few of them
        links = left.join(ta, "a").join(tb, "b").select("a", "b", "ta", "tb").mapInPandas(_confirm(k, num, den), "hi long, lo long")
        links = stored(links, "links")
        released(met, left)
        return links

    small = live.where(F.col("size") <= SMALL).select("bucket", "node")
    x, y = small.withColumnRenamed("node", "a"), small.withColumnRenamed("node", "b")
    pairs = x.join(y, "bucket").where("a > b").select("a", "b")
    large = live.where(F.col("size") > SMALL).select("bucket", "node")
    heads = large.groupBy("bucket").agg(F.min("node").alias("head"))
    links = verified(pairs.unionByName(large.join(heads, "bucket").where("node > head").select(F.col("node").alias("a"), F.col("head").alias("b"))))
    labels = stored(components(links, "component"), "labels")
    for turn in range(LEADER_ROUNDS + 1):
        named = large.join(labels, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("label"))
        ends = named.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("bucket")
        mixed = stored(named.join(ends, "bucket"), "mixed")
        if turn == LEADER_ROUNDS:
            break
        # components with many nodes in one bucket: each node meets the last one of the first or of the last such component
        many = mixed.groupBy("bucket", "label").agg(F.count("*").alias("m"), F.max("node").alias("last")).where(F.col("m") > SMALL).drop("m")
        end = F.struct("label", "last")
        ends = many.groupBy("bucket").agg(F.min(end).alias("lo"), F.max(end).alias("hi")).where("lo.label < hi.label")
        other = F.when(F.col("label") == F.col("lo.label"), F.col("hi.last")).otherwise(F.col("lo.last"))
        new = verified(mixed.join(many.drop("last"), ["bucket", "label"]).join(ends, "bucket").select(F.greatest("node", other).alias("a"), F.least("node", other).alias("b")))
        if new.isEmpty():
            break
        released(mixed)
        links = links.unionByName(new)
        labels = stored(components(links, "component"), "labels")
    apart = stored(mixed.select("node", "label").distinct().join(texts.withColumnRenamed("id", "node"), "node"), "apart")
    links = links.unionByName(verified(prefix_pairs(apart, k, num, den)))
    labels = stored(components(links, "component"), "labels")
    nodes = first.join(labels, "node", "left").select("key", F.coalesce("component", "node").alias("component"))
    known = all_docs.where("id is not null and key is not null").join(nodes, "key", "left").select("id", "n", "component")
    alone = all_docs.where("id is null or key is null").select("id", "n", F.col("id").alias("component"))
    return known.unionByName(alone)


def near_dedup(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (the first document of its component) for docs (doc_id, text)."""
    out = near_components(docs.select(F.col("doc_id").alias("id"), "text"), k, num, den)
    return out.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept")
    )
