"""Mixing sources to target weights by shards of fixed-length blocks.

Every source's documents are laid end to end, in an order fixed by hashes of their ids, and cut into blocks of `block`
words. The mix is a row of slots, dealt over output shards; each shard draws how many slots each source gets from a
multinomial over what the sources still lack. A source's n-th slot takes block perm(n mod blocks) of its n div blocks-th
pass, where perm is a pseudorandom permutation of the source's block indices (a Feistel network, walked until it falls
within range), so that no block comes a second time before all have come once. Blocks are joined by source and index.

Targets: sources by code point, null last, weigh 1, 2, 3 and again; they share 100% of all words; a target stops at
`most` times its source's words and the excess is shared again by weight. As passes are whole before the next begins, no
document gives more than `most` times its size.

Places in a source are found without gathering it: documents fall into hash buckets of a few hundred rows, sums of
buckets, and of groups of buckets, give offsets, and each bucket is summed up on its own. Copies of a row are numbered first,
partition by partition, and so spread over buckets. What the driver plans and broadcasts has a row for each source, of which there
may be `SOURCES`; more raise an error. Null and empty texts have no words and are never taken; repeated rows are rows like any
other; very long texts span blocks; an empty table gives no rows. `mix` leaves out columns but doc_id, source and text, whatever
their names; `mixed_documents` carries all through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm.common import WORD, saved, table

BLOCK, SHARDS, MOST, SOURCES = 128, 64, 3, 100_000


def targets(sizes: list[int], most: float = MOST) -> list[float]:
    """Each source's target from its words, in the order of the sources."""
    weights, total = [k % 3 + 1 for k in range(len(sizes))], float(sum(sizes))
    limit = [most * float(s) for s in sizes]
    full: set[int] = set()
    while True:
        left = total - sum(limit[k] for k in full)
        share = sum(w for k, w in enumerate(weights) if k not in full)
        over = {k for k, w in enumerate(weights) if k not in full and left * w / share > limit[k]} if share else set()
        if not over:
            return [limit[k] if k in full else left * w / share for k, w in enumerate(weights)]
        full |= over


def _network(index: np.ndarray, n: int, seed: int, turns) -> np.ndarray:
    """A Feistel network over the least even number of bits that hold range(n), walked until it falls within; backwards if turns fall."""
    half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
    mask, wide = np.uint64((1 << half) - 1), np.uint64(half)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> wide, out[todo] & mask
        for turn in turns:
            if turns.step < 0:
                left, right = right, left
            mixed = (right + np.uint64((seed * 4 + turn + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0x94D049BB133111EB)
            left ^= (mixed >> np.uint64(32)) & mask
            if turns.step > 0:
                left, right = right, left
        out[todo] = (left << wide) | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at index."""
    return _network(index, n, seed, range(4))


def unpermuted(value: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Where the permutation takes these values."""
    return _network(value, n, seed, range(3, -1, -1))


class Plan:
    """What the driver decides: targets, blocks and each shard's slots a source. It grows with the number of sources alone."""

    def __init__(self, sizes: list[int], block: int, shards: int, seed: int, most: float = MOST):
        self.sizes, self.block, self.seed = sizes, block, seed
        self.targets = targets(sizes, most)
        self.blocks = [-(-s // block) for s in sizes]
        self.slots, self.cut = [], []
        for k, (size, blocks, target) in enumerate(zip(sizes, self.blocks, self.targets, strict=True)):
            # Whole passes, then so many blocks of the last one; the last slot is cut to meet the target.
            passes = int(target // size) if size else 0
            rest = min(int(round(target)) - passes * size, size) if size else 0
            more, short = -(-rest // block), blocks * block - size
            if more and (last := self._place(k, blocks - 1)) < more:  # the block at the source's end is shorter
                words = more * block - short
                if words < rest and more < blocks:
                    more += 1
                    words += block
            else:
                words = more * block
            self.slots.append(passes * blocks + more)
            self.cut.append(max(0, words - rest))
        self.shards = self._draw(shards)

    def _place(self, k: int, index: int) -> int:
        """The slot of a pass at which source k's block `index` comes."""
        return int(unpermuted(np.array([index]), self.blocks[k], self.seed + k)[0])

    def _draw(self, shards: int) -> np.ndarray:
        """Slots by shard and source: a multinomial draw for each shard, never beyond what a source still lacks."""
        rng, left = np.random.default_rng(self.seed), np.array(self.slots, np.int64)
        out = np.zeros((shards, len(left)), np.int64)
        for shard in range(shards):
            want = -(-int(left.sum()) // (shards - shard))
            while want and left.sum():
                got = np.minimum(rng.multinomial(want, left / left.sum()), left)
                out[shard] += got
                left -= got
                want -= int(got.sum())
        return out


def words() -> Column:
    """The size of `text` in words."""
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def sized(df: DataFrame) -> DataFrame:
    """doc_id, source, size in words, a mark of the text and the number of every row."""
    return df.select("doc_id", "source", words().alias("size"), F.xxhash64("text").alias("mark"), F.monotonically_increasing_id().alias("row"))


def placed(rows: DataFrame, per_bucket: int = 256, group: int = 4096) -> DataFrame:
    """rows (doc_id, source, size, mark, row) with `at`, the number of the source's words before the row.

    The order is by hashes of content and, among copies, by their numbers, so that it doesn't hang on how rows are dealt.
    """
    n = rows.count()
    rows = rows.withColumn("_h", F.xxhash64("doc_id", "size", "mark")).withColumn("_p", F.shiftright("row", 33))
    # Copies: counted in each partition, and numbered on from those of the partitions before.
    copies = rows.groupBy("_h", "_p").agg(F.count("*").alias("_c")).withColumn("_o", F.sum("_c").over(W.partitionBy("_h").orderBy("_p")) - F.col("_c"))
    own = F.row_number().over(W.partitionBy("_h", "_p").orderBy("row")) - 1
    rows = rows.withColumn("_j", own).join(copies.filter("_o > 0").drop("_c"), ["_h", "_p"], "left").withColumn("_j", F.col("_j") + F.coalesce("_o", F.lit(0)))
    rows = rows.withColumn("_b", F.pmod(F.xxhash64("_h", "_j"), F.lit(max(1, n // per_bucket)))).drop("_p", "_o")
    sums = rows.groupBy("source", "_b").agg(F.sum("size").alias("_sum")).withColumn("_g", F.expr(f"_b div {group}"))
    above = sums.groupBy("source", "_g").agg(F.sum("_sum").alias("_all")).withColumn("_above", F.sum("_all").over(W.partitionBy("source").orderBy("_g")) - F.col("_all"))
    within = F.sum("_sum").over(W.partitionBy("source", "_g").orderBy("_b")) - F.col("_sum")
    above = above.select(F.col("source").alias("_s"), F.col("_g").alias("_up"), "_above")
    offsets = sums.withColumn("_within", within).join(above, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_g") == F.col("_up")))
    offsets = offsets.select(F.col("source").alias("_source"), F.col("_b").alias("_bucket"), (F.col("_within") + F.col("_above")).alias("_before"))
    running = F.sum("size").over(W.partitionBy("source", "_b").orderBy("_h", "_j").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("at", running - F.col("size"))
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_b") == F.col("_bucket"))
    return rows.join(offsets, same).withColumn("at", F.col("at") + F.col("_before")).drop("_h", "_j", "_b", "_source", "_bucket", "_before", "mark")


def plan(rows: DataFrame, block: int = BLOCK, shards: int = SHARDS, seed: int = 7) -> tuple[list[str | None], Plan]:
    """The sources in order, and the plan over them."""
    sums = {r["source"]: r["n"] for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(SOURCES + 1).collect()}
    if len(sums) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    names = sorted((s for s in sums if s is not None)) + [None] * (None in sums)
    return names, Plan([sums[s] for s in names], block, shards, seed)


def slots(spark: SparkSession, made: Plan, chunk: int = 1 << 18) -> DataFrame:
    """shard, place in the shard, source number k, pass, block index and words cut off the end, a row for each slot."""
    total = sum(made.slots)
    starts = np.concatenate(([0], np.cumsum(made.slots))).astype(np.int64)
    # By source: the slots of all shards up to and with each, counted on over the sources; and where its slots begin in each shard.
    ends = (made.shards.cumsum(axis=0) + starts[:-1]).T
    begin = (made.shards.cumsum(axis=1) - made.shards).T
    shipped = spark.sparkContext.broadcast((np.array(made.blocks, np.int64), starts, ends, begin, np.array(made.cut, np.int64), made.seed))
    names = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("k", pa.int32()), ("pass", pa.int64()), ("block", pa.int64()), ("cut", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, starts, ends, begin, cut, seed = shipped.value
        for batch in batches:
            slot = batch.column(0).to_numpy()
            k = np.searchsorted(starts, slot, side="right") - 1
            n = slot - starts[k]
            shard, block = np.zeros(len(slot), np.int64), np.zeros(len(slot), np.int64)
            for one in np.unique(k).tolist():
                own = k == one
                shard[own] = np.searchsorted(ends[one], slot[own], side="right")
                block[own] = permuted(n[own] % blocks[one], int(blocks[one]), seed + one)
            first = np.where(shard > 0, ends[k, np.maximum(shard - 1, 0)], starts[k])
            last = slot == starts[k + 1] - 1
            yield pa.RecordBatch.from_arrays([pa.array(shard.astype(np.int32)), pa.array(begin[k, shard] + slot - first), pa.array(k.astype(np.int32)), pa.array(n // np.maximum(blocks[k], 1)), pa.array(block), pa.array(np.where(last, cut[k], 0))], schema=names)

    return spark.range(0, total, 1, total // chunk + 1).mapInArrow(run, "shard int,place long,k int,pass long,block long,cut long")


def numbered(spark: SparkSession, names: list[str | None], made: Plan) -> DataFrame:
    """A row for each source: its number, words and target."""
    return spark.createDataFrame([(n, k, made.sizes[k], made.targets[k]) for k, n in enumerate(names)], "source string,k int,source_size long,target double")


def segments(rows: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each document and block that it reaches into: rows' columns, k, block, and words first to end of the document."""
    same = F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(F.broadcast(sources.select(F.col("source").alias("_source"), "k", "source_size")), same).drop("_source").filter("size > 0")
    reach = F.sequence(F.expr(f"at div {block}"), F.expr(f"(at + size - 1) div {block}"))
    rows = rows.select("*", F.explode(reach).alias("block"))
    first, end = F.greatest(F.lit(0), F.col("block") * block - F.col("at")), F.least("size", (F.col("block") + 1) * block - F.col("at"))
    return rows.withColumn("first", first.cast("long")).withColumn("end", end.cast("long"))


def mix(df: DataFrame, spark: SparkSession, block: int = BLOCK, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of df (doc_id, source, text)."""
    rows = saved(sized(df), spark, "mix-sizes")
    names, made = plan(rows, block, shards, seed)
    if not names:
        return spark.createDataFrame([], "doc_id long,size long,source_size long,target double,taken long")
    sources = numbered(spark, names, made)
    # Slots meet their blocks once counted: how often whole, and for the cut ones how many words are missing at the end.
    uses = slots(spark, made).groupBy("k", "block").agg(F.count("*").alias("uses"), F.max("cut").alias("cut"))
    cut_from = F.least((F.col("block") + 1) * block, F.col("source_size")) - F.col("cut") - F.col("at")
    # Spark can't know how many rows slots makes of its few tasks; unhinted it would broadcast them.
    found = segments(placed(rows), sources, block).join(uses.hint("merge"), ["k", "block"])
    lost = F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("first"), cut_from))
    given = found.groupBy("row").agg(F.sum((F.col("end") - F.col("first")) * F.col("uses") - F.when(F.col("cut") > 0, lost).otherwise(0)).cast("long").alias("taken"))
    out = rows.join(given, "row", "left").join(F.broadcast(sources.withColumnRenamed("source", "_source")), F.col("source").eqNullSafe(F.col("_source")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(df: DataFrame, spark: SparkSession, block: int = BLOCK, shards: int = SHARDS, seed: int = 7) -> DataFrame:
    """The mix itself, with df's columns: a row for each document and pass that takes words of it.

    `text` is the whole text where the pass takes all of it, else the words taken, blank-joined; n_chars, where df has
    it, is counted anew. Documents without words are left out, as the mix takes nothing of them.
    """
    # Columns go by numbers meanwhile, as df's own names may be those used here.
    own = df.toDF(*[f"c{k}" for k in range(len(df.columns))])
    doc_id, source, text = (F.col(f"c{df.columns.index(n)}") for n in ("doc_id", "source", "text"))
    rows = own.withColumn("text", text).withColumn("size", words()).withColumn("mark", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).drop("text")
    rows = saved(rows, spark, "mix-rows")
    small = rows.select(doc_id.alias("doc_id"), source.alias("source"), "size", "mark", "row")
    names, made = plan(small, block, shards, seed)
    if not names:
        return df.limit(0)
    sources = numbered(spark, names, made)
    spans = segments(placed(small), sources, block).join(slots(spark, made).select("k", "pass", "block", "cut").hint("merge"), ["k", "block"])
    stop = F.least((F.col("block") + 1) * block, F.col("source_size")) - F.col("cut") - F.col("at")
    spans = spans.withColumn("end", F.least("end", stop)).filter("end > first")
    taken = spans.groupBy("row", "pass").agg(F.array_sort(F.collect_list(F.struct("first", "end"))).alias("spans"), F.sum(F.col("end") - F.col("first")).alias("words"))
    whole = rows.drop("mark").join(taken, "row")
    names_out = df.columns
    at = {n: whole.columns.index(f"c{k}") for k, n in enumerate(names_out)}
    text_at, size_at, words_at, spans_at = at["text"], *(whole.columns.index(n) for n in ("size", "words", "spans"))
    schema = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, size, words, spans in zip(*(batch.column(k).to_pylist() for k in (text_at, size_at, words_at, spans_at)), strict=True):
                if words < size:
                    each = text.encode().split()
                    text = b" ".join(w for s in spans for w in each[s["first"] : s["end"]]).decode()
                out.append(text)
            columns = {n: batch.column(at[n]) for n in names_out} | {"text": pa.array(out, pa.string())}
            if "n_chars" in columns:
                columns["n_chars"] = pa.array([len(t) for t in out], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[n] for n in names_out], names=names_out)

    return whole.mapInArrow(run, schema)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of every document the mix takes."""
    return mix(table(spark, sf_dir, "documents"), spark)
