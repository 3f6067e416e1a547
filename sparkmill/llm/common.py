"""Helpers shared by the training-data operators: staging, hot-key joins, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkmill.session import scratch_path, ship_package

#: A key is hot when it holds at least 1/HOT_KEYS of all rows, so at most HOT_KEYS keys are hot:
#: that is the proven bound of the only tables broadcast by `join_by_key`.
HOT_KEYS = 1024
#: Pieces a hot key is dealt into.
SALTS = 256
#: Rows of a sieve at most, 64 bits each: the proven bound of what `sifted` broadcasts.
SIEVE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared scratch folder and read it back.

    Cuts lineage: every later reader sees the same rows, and a lost executor
    costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _STAGED[id(out)] = (out, path)
    return out


#: Staged frames that a caller may drop, with their folders.
_STAGED: dict[int, tuple[DataFrame, str]] = {}


def drop_staged(*frames: DataFrame) -> None:
    """Delete the folders of staged ``frames`` whose readers have all been written out; other frames are left alone."""
    for df in frames:
        held, path = _STAGED.pop(id(df), (None, None))
        if path is not None:
            spark = held.sparkSession
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers."""
    ship_package(spark)


def _trim() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


def lean(run):
    """A function over batches for ``mapInArrow`` that leaves no memory behind in its worker.

    Workers are reused by later stages.  Before the first batch, what a tokenizer has remembered
    for its next task goes; after the last one, freed memory returns to the system.
    """
    def wrapped(batches):
        import sys

        tokenizer = sys.modules.get("sparkmill.llm.sentencepiece_viterbi")
        if tokenizer is not None and tokenizer.forget():
            _trim()
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def lean_group(run):
    """`lean` for a function of one pandas frame, as ``applyInPandas`` takes it; groups are small, so memory stays till the next `lean`."""
    def wrapped(pdf):
        import sys

        tokenizer = sys.modules.get("sparkmill.llm.sentencepiece_viterbi")
        if tokenizer is not None and tokenizer.forget():
            _trim()
        return run(pdf)

    return wrapped


def join_by_key(left: DataFrame, right: DataFrame, key: str, n: str, spread: Column, total: int | None = None) -> DataFrame:
    """Left join of ``left`` with ``right`` (one row per non-null ``key``, staged), hot keys salted.

    ``n`` is the column of ``right`` counting the rows of ``left`` with that key; it is
    dropped.  Keys holding 1/HOT_KEYS of the rows or more (so HOT_KEYS of them at
    most) are broadcast as a list; their rows are dealt into SALTS pieces by
    ``spread`` and the one row of ``right`` is repeated for each piece.  A caller that
    knows how many rows there are, or a bound of it, passes ``total``.
    """
    if total is None:
        total = right.agg(F.sum(n)).first()[0] or 0
    least = max(1000, total // HOT_KEYS + 1)
    hot = right.filter(F.col(n) >= least).select(F.col(key), F.lit(True).alias("_hot"))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(spread, F.lit(7)), F.lit(SALTS))).otherwise(F.lit(0))).drop("_hot")
    copies = right.withColumn("_salt", F.explode(
        F.when(F.col(n) >= least, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
        .otherwise(F.array(F.lit(0).cast("long"))))).drop(n)
    return dealt.join(copies, [key, "_salt"], "left").drop("_salt")


def sifted(rows: DataFrame, among: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``_may``: false where ``key`` is surely none of the keys of ``among``, true for all others.

    A filter of SIEVE * 64 bits in all, whatever the tables' size: on few keys it saves the shuffle of
    wide rows that an exact join would drop, on very many it lets more rows pass.
    """
    h = F.xxhash64(key)
    place = F.pmod(h, F.lit(SIEVE)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 40), F.lit(64)).cast("int"))
    bits = among.select(place.alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    met = rows.withColumns({"_place": place, "_bit": bit}).join(F.broadcast(bits), "_place", "left")
    return met.withColumn("_may", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_place", "_bit", "_bits")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Connected components of ``edges`` (a long, b long) -> (node, component = smallest node).

    Alternating large-star and small-star passes.  Each pass only keeps, for a
    node, links to the smallest neighbour, computed with map-side-combinable
    minima and joined back in salted pieces where a node has very many links, so
    these are never gathered anywhere.  Every pass is staged; the loop ends when a
    pass changes nothing.  Nulls are not expected; no edges give no rows.
    """
    e = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).filter("lo < hi").distinct()
    e = stage(e, "cc")
    signature, total = None, e.count()
    for _ in range(max_rounds):
        # large star: every neighbour larger than the node links to the node's smallest neighbour
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).unionByName(
            e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        m = both.groupBy("u").agg(F.min("v").alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")).filter("n > 0")
        larger = join_by_key(both.filter("v > u"), m.select("u", F.least("u", "m").alias("m"), "n"), "u", "n", F.col("v"), total)
        before, e = e, stage(larger.select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct(), "cc")
        drop_staged(before)
        large = e
        # small star: smaller neighbours and the node itself link to the smallest of them
        m = e.groupBy("hi").agg(F.min("lo").alias("m"), F.count(F.lit(1)).alias("n"))
        joined = join_by_key(e, m, "hi", "n", F.col("lo"), total)  # no more edges than before
        e = joined.select(F.col("m").alias("lo"), F.col("lo").alias("hi")).filter("lo < hi").unionByName(
            m.select(F.col("m").alias("lo"), "hi")).distinct()
        before, e = large, stage(e, "cc")
        drop_staged(before)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if signature == now:
            break
        signature, total = now, now[0]
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(
        e.select(F.col("lo").alias("node"), F.col("lo").alias("component"))).distinct()
