"""What the operators of this subpackage share: inputs, stored intermediates, word hashes, connected components."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: texts may be long, so batches hold few of them.
BATCH_ROWS = 500
#: Rows of a key that any task can hold; as a share of all rows, what makes a key heavy in a large table; cells in which rows are counted.
HEAVY_ROWS, HEAVY_SHARE, HEAVY_CELLS = 1000, 8192, 65536
#: Bits that tell which ids are there (a multiple of 32,768, the bits of one bitmap).
MARKS = 1 << 26
#: Bytes of text whose words are hashed at once, and in one sum, so that what this takes stays in a processor's cache.
AT_ONCE, BLOCK = 1 << 18, 1 << 14
_local: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder, read by Spark alone."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Keeps Arrow batches small, as one row can hold a very long text; sends this package's functions by value, so that workers need no copy of it."""
    cloudpickle.register_pickle_by_value(sys.modules[__package__.partition(".")[0]])
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where spark.checkpoint.dir is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="namewright-")
    return _local[app]


def stored(df: DataFrame, label: str) -> DataFrame:
    """df, computed once, written to the shared folder and read again: its lineage ends there and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def released(*frames: DataFrame) -> None:
    """Deletes what stored() wrote, once nothing reads it any more."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def heavy(rows: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """keys and aggregates of the keys that are too frequent for one task: those of more than max(HEAVY_ROWS, 1 / HEAVY_SHARE of all) rows.

    There are fewer than HEAVY_SHARE of them however large rows is, so the table can be sent to every task, and all other
    keys can be shuffled by key. Rows are counted in HEAVY_CELLS cells of keys first; keys are only counted in cells that
    could hold a frequent one. rows should be stored, as it is read twice.
    """
    cell = F.pmod(F.xxhash64(*keys), F.lit(HEAVY_CELLS)).alias("__cell")
    counts = stored(rows.groupBy(cell).agg(F.count("*").alias("n")), "cells")
    limit = max(HEAVY_ROWS, (counts.agg(F.sum("n")).first()[0] or 0) / HEAVY_SHARE)
    some = rows.withColumn("__cell", cell).join(F.broadcast(counts.where(F.col("n") > limit).select("__cell")), "__cell", "left_semi")
    out = stored(some.groupBy(*keys).agg(F.count("*").alias("__n"), *aggregates).where(F.col("__n") > limit).drop("__n"), "heavy")
    released(counts)
    return out


def likely(rows: DataFrame, column: str, ids: DataFrame, name: str) -> DataFrame:
    """rows without most of those whose column isn't among ids.name: an inner join with distinct ids after it shuffles fewer rows (a left_semi join would be moved below it).

    One bit of MARKS tells whether an id of a hash is there. The bits are sent to every task: 8 MB, however many ids there
    are. With very many (tens of millions) most bits are set, and rows pass that the join has to shuffle.
    """
    block, at = lambda c: F.shiftright(F.pmod(F.xxhash64(c), F.lit(MARKS)), 15), lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 15))
    marks = ids.select(block(name).alias("__block"), at(name).alias("__at")).repartition("__block").groupBy("__block").agg(F.bitmap_construct_agg("__at").alias("__marks"))
    met = rows.withColumns({"__block": block(column), "__at": at(column).cast("int")}).join(F.broadcast(marks), "__block")
    return met.where("getbit(cast(conv(hex(substring(__marks, shiftright(__at, 3) + 1, 1)), 16, 10) as int), __at % 8) = 1").select(*rows.columns)


def components(edges: DataFrame, label: str, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node that its edges reach) for every node of edges (hi, lo: long).

    Alternating large-star and small-star steps; each is a minimum per node, combined before the shuffle, and a
    join that adaptive execution can split where one node has very many edges. No node's neighbours are collected.
    """
    now = stored(edges.select(F.greatest("hi", "lo").alias("hi"), F.least("hi", "lo").alias("lo")).where("hi > lo").distinct(), label)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("n")).select(F.col("hi").alias("u"), F.least("hi", "n").alias("m"))
        large = now.join(least, now.lo == least.u).select("hi", F.col("m").alias("lo"))
        large = large.where("hi > lo").distinct()
        step = stored(large, label)
        first = step.groupBy("hi").agg(F.min("lo").alias("m"))
        pairs = step.join(first.withColumnRenamed("hi", "h"), step.hi == F.col("h"))
        small = pairs.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionByName(first.select("hi", F.col("m").alias("lo"))).distinct()
        new = stored(small, label)
        released(now, step)
        now = new
        # stars, once each node has one edge and none leads on
        if now.groupBy("hi").count().where("count > 1").isEmpty() and now.join(now.select(F.col("hi").alias("on")).distinct(), F.col("lo") == F.col("on"), "left_semi").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("lo").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(roots)


def words_of(text: str | None) -> list[bytes]:
    """Words: maximal runs of characters other than space and 09 to 0D, A-Z lower-cased and nothing else."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_MUL = np.uint64(0x9E3779B97F4A7C15)
_SH = np.uint64(31)


def shingle_ids(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit ids of the k-word shingles; the whole sequence as one where there are fewer words; none without words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    n = len(words) - k + 1
    out = h[:n].copy()
    with np.errstate(over="ignore"):
        for j in range(1, k):
            out ^= out >> _SH
            out *= _MUL
            out += h[j : j + n]
        out ^= out >> _SH
        out *= _MUL
        out ^= out >> _SH
    return np.unique(out)


#: Which bytes are white space; a number for each byte, the same for A-Z and a-z; what numbers are multiplied by from one place to the next.
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BYTE = np.random.default_rng(20_250_207).integers(0, 2**64, 256, dtype=np.uint64)
_BYTE[ord("A") : ord("Z") + 1] = _BYTE[ord("a") : ord("z") + 1]
PLACE = 0xD1342543DE82EF95


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """PLACE to the powers 0 to n - 1, and their inverses, modulo 2^64."""
    out = np.repeat(np.array([[PLACE], [pow(PLACE, -1, 1 << 64)]], np.uint64), max(n, 1), axis=1)
    out[:, 0] = 1
    return tuple(np.cumprod(out, axis=1, dtype=np.uint64))


def sequences(x: np.ndarray, start: np.ndarray, end: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Hashes of the sequences x[start:end], wherever they stand: sums over x weighted by place, put back to the first place. known: powers(len(x)) or more."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * known[0][: len(x)], out=total[1:])
    return (total[end] - total[start]) * known[1][np.minimum(start, len(x) - 1)]


def grouped(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows in groups of AT_ONCE bytes or one row: first row's number, the bytes, where its rows begin (and the end), starts and ends of the words of words_of. Nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    if not len(texts):
        return
    edge = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(edge, edge[row] + AT_ONCE, "right")) - 1)
        x, cut = data[edge[row] : edge[last]], edge[row : last + 1] - edge[row]
        space = _SPACE[x]
        first, final = ~space, ~space
        first[1:] &= space[:-1]
        final[:-1] &= space[1:]
        full = cut[:-1] < cut[1:]  # words end where rows do
        first[cut[:-1][full]] = ~space[cut[:-1][full]]
        final[cut[1:][full] - 1] = ~space[cut[1:][full] - 1]
        yield row, x, cut, np.flatnonzero(first), np.flatnonzero(final) + 1
        row = last


def hashed(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each group of rows: the first row's number, 64-bit hashes of the words of words_of, the number of words before each row (and of all)."""
    known = powers(BLOCK)
    for row, x, cut, start, end in grouped(texts):
        h = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):
            upto = max(at + 1, int(np.searchsorted(end, start[at] + BLOCK, "right")))
            lo, hi = start[at], end[upto - 1]
            h[at:upto] = sequences(_BYTE[x[lo:hi]], start[at:upto] - lo, end[at:upto] - lo, known if hi - lo <= BLOCK else powers(hi - lo))
            at = upto
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        yield row, h, np.searchsorted(start, cut)


def shingle_sets(h: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """shingle_ids for many rows of hashed words at once, from hashed() instead: ids of one row after the other, how many come before each row (and all)."""
    n = np.diff(bounds)
    size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    ids, whole, whence = np.empty(at[-1], np.uint64), np.ones(at[-1], bool), np.ones(len(h), bool)
    mixed = lambda x: (y := (x ^ (x >> _SH)) * _MUL) ^ (y >> _SH)
    out = h.copy()
    for j in range(1, k):
        few = np.flatnonzero(n == j)
        ids[at[few]] = mixed(out[bounds[few]])
        whole[at[few]] = False
        whence[bounds[1:][n >= j] - j] = False
        out ^= out >> _SH
        out *= _MUL
        out[:-j] += h[j:]
    ids[whole] = mixed(out[whence])
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        ids[a:b].sort()
    new = np.ones(len(ids), bool)
    new[1:] = ids[1:] != ids[:-1]
    new[at[:-1][size > 0]] = True
    return ids[new], np.concatenate([[0], np.cumsum(new)])[at]
