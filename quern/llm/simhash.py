"""SimHash near-dedup with pivot distance tables.

Texts become 64-bit SimHash fingerprints of their 3-word shingles, and equal fingerprints become one row. Pairs within
`near` differing bits are sought among distinct fingerprints:

1. Of five segments of the 64 bits at least two are alike in such a pair, so rows are dealt by each of the ten pairs of
   segments (keys of about 26 bits); keys with more than `most` rows are dealt again by pairs of row chunks.
2. Inside a key, a table holds the Hamming distance of every row to many reference fingerprints (pivots). By the triangle
   inequality a pair with a coordinate difference above `near` in any column is discarded: rows are sorted by the first
   column, so that only neighbours in it are paired, and the other columns discard among those.
3. Survivors are verified bit by bit. What leaves a key is a star for each linked set, never all of its pairs.

`one_of_each`, the pipeline's stage, finds its links in the same way, from fingerprints of 5-word shingles, and adds those that lie
beyond the reach of SimHash: pairs by exact Jaccard similarity (see `near_copies`).

Components of links are found by distributed label propagation. Null and empty texts have fingerprint zero, linked
like any other; repeated rows are rows like any other; a null doc_id keeps its row and is never the smallest id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, components, forget, raw_texts, saved, table

#: Bits of the segments, from the lowest; their sum is 64.
SEGMENTS = (13, 13, 13, 13, 12)


def digests(text: bytes, shingle: int, seed: int = 42) -> bytes:
    """The XXH64 of every shingle, 8 bytes each; none without words."""
    words = text.lower().split()
    if not words:
        return b""
    digest, joined = xxhash.xxh64_digest, b" ".join(words)
    if len(words) <= shingle:
        return digest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    return b"".join([digest(joined[a:b], seed) for a, b in zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text, signed: a bit is 1 if set in over half of the shingles' XXH64."""
    return majority(digests(text, shingle, seed))


def majority(found: bytes) -> int:
    """The SimHash of hashes of 8 bytes each, signed; zero if there are none."""
    rows = np.frombuffer(found, np.uint8).reshape(-1, 8)
    if not len(rows):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(rows), 4096):
        counts += np.unpackbits(rows[at : at + 4096], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(rows)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp for every row of df (doc_id, text)."""

    def each(part: dict) -> dict:
        return {"doc_id": part["doc_id"], "fp": [fingerprint(t, shingle) for t in raw_texts(part["text"])]}

    return arrow_map(df.select("doc_id", "text"), each, "doc_id long,fp long")


def pivots(n: int = 24) -> np.ndarray:
    """Reference fingerprints, fixed by their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"pivot", i) for i in range(n)], np.uint64)


class Links:
    """Linked sets of one key's rows, kept as labels."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Joins pairs; the loop runs only over pairs of sets that are still apart."""
        apart = self.up[a] != self.up[b]
        if not apart.any():
            return
        up = self.up
        for x, y in set(zip(up[a[apart]].tolist(), up[b[apart]].tolist(), strict=True)):
            while up[x] != x:
                x = up[x]
            while up[y] != y:
                y = up[y]
            if x != y:
                up[max(x, y)] = min(x, y)
        while True:  # every row points at its root again
            flat = up[up]
            if (flat == up).all():
                break
            up = flat
        self.up = up


def linked(keys: np.ndarray, fps: np.ndarray, refs: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (fingerprint, smallest of its set) of the rows of whole keys; keys are sorted."""
    tables = np.bitwise_count(fps[:, None] ^ refs[None, :]).astype(np.int16)
    order = np.lexsort((fps, tables[:, 0], keys))
    keys, fps, tables = keys[order], fps[order], tables[order]
    links, step, rows = Links(len(fps)), 1, np.arange(len(fps) - 1)
    while len(rows):
        rows = rows[rows + step < len(fps)]
        a, b = rows, rows + step
        # Sorted by the first column: a row with no partner at this step has none further on.
        rows = rows[(keys[a] == keys[b]) & (tables[b, 0] - tables[a, 0] <= near)]
        a, b = rows, rows + step
        for at in range(1, tables.shape[1], 4):
            ok = (np.abs(tables[a, at : at + 4] - tables[b, at : at + 4]) <= near).all(axis=1)
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= near
        if ok.any():
            links.join(a[ok], b[ok])
        step += 1
    signed = fps.view(np.int64)
    least = np.full(len(fps), np.iinfo(np.int64).max)
    np.minimum.at(least, links.up, signed)
    roots = least[links.up]
    apart = roots != signed
    return signed[apart], roots[apart]


def near_links(distinct: DataFrame, near: int = 3, most: int = 16_384) -> DataFrame:
    """Stars (a, b) that join the same sets as all pairs of distinct `fp` within `near` bits."""
    if near >= len(SEGMENTS) - 1:
        raise ValueError("two of five segments are alike only up to three differing bits")
    at, parts = 0, []
    for bits in SEGMENTS:
        parts.append(F.shiftrightunsigned("fp", at).bitwiseAND((1 << bits) - 1))
        at += bits
    keys = [(F.lit(k).cast("long") * (1 << 26)) + parts[i] * (1 << 13) + parts[j] for k, (i, j) in enumerate(combinations(range(len(SEGMENTS)), 2))]
    dealt = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    # Large keys, and the chunks of each; a pair of chunks (i, j) holds rows of both.
    large = dealt.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key", F.ceil(F.col("n") * 2 / most).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, F.col("chunk")) * F.col("chunks") + F.greatest(j, F.col("chunk")))
    dealt = dealt.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
    dealt = dealt.select("key", "fp", F.explode(pairs).alias("pair"))
    refs = pivots()
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> pa.RecordBatch:
            whole = np.cumsum(np.concatenate(([0], (rows[1:, :2] != rows[:-1, :2]).any(axis=1).astype(np.int64))))
            a, b = linked(whole, np.ascontiguousarray(rows[:, 2]).view(np.uint64), refs, near)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for batch in batches:
            rows = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
            rows = np.concatenate([*held, rows])
            last = int(np.flatnonzero((rows[:, :2] == rows[-1, :2]).all(axis=1))[0]) if len(rows) else 0
            held = [rows[last:]]
            if last:
                yield flush(rows[:last])
        if held and len(held[0]):
            yield flush(held[0])

    return dealt.select("key", F.col("pair").cast("long"), "fp").repartition("key", "pair").sortWithinPartitions("key", "pair").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(df: DataFrame, spark: SparkSession, shingle: int = 3, near: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable) for every row of df (doc_id, text)."""
    rows = saved(fingerprints(df, shingle), spark, "simhash")
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), spark, "simhash-distinct")
    roots = components(saved(near_links(distinct.select("fp"), near), spark, "simhash-links"), spark, "simhash")
    sets = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    whole = sets.join(sets.groupBy("root").agg(F.min("least").alias("component_id")), "root")
    return rows.join(whole.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def multipliers(n: int) -> np.ndarray:
    """Odd factors that order shingles anew, fixed by their numbers."""
    return np.array([xxhash.xxh64_intdigest(b"order", i) | 1 for i in range(n)], np.uint64)


def shingles(text: bytes, shingle: int) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; a text without words has one of its own."""
    return one_set(digests(text, shingle))


def one_set(found: bytes) -> np.ndarray:
    """Distinct hashes in order, of 8 bytes each; a zero if there are none."""
    found = np.unique(np.frombuffer(found, np.uint64))
    return found if len(found) else np.zeros(1, np.uint64)


def least_hashes(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The least shingle in each order: alike in two sets as often as their Jaccard similarity."""
    out = np.full(len(factors), np.iinfo(np.uint64).max)
    for at in range(0, len(found), 1024):
        out = np.minimum(out, (found[at : at + 1024, None] * factors).min(axis=0))
    return out


def signatures(distinct: DataFrame, shingle: int, keys: int = 24, each_key: int = 5) -> DataFrame:
    """node, the SimHash, keys and the low bytes of all least hashes, for every text of distinct (node, text)."""
    factors = multipliers(keys * each_key)
    tags = [bytes([k]) for k in range(keys)]

    def each(part: dict) -> dict:
        fps, out, low = [], [], []
        for text in raw_texts(part["text"]):
            found = digests(text, shingle)
            fps.append(majority(found))
            least = least_hashes(one_set(found), factors)
            out.append([xxhash.xxh64_intdigest(t + x.tobytes()) - (1 << 63) for t, x in zip(tags, least.reshape(keys, each_key), strict=True)])
            low.append((least >> np.uint64(56)).astype(np.uint8).tobytes())
        return {"node": part["node"], "fp": fps, "keys": out, "low": low}

    return arrow_map(distinct, each, "node long,fp long,keys array<bigint>,low binary")


def near_nodes(marks: DataFrame, spark: SparkSession, near: int) -> DataFrame:
    """Links (a, b) of nodes whose SimHashes are equal, or within `near` bits by way of the pivot tables; marks has node and fp."""
    firsts = saved(marks.groupBy("fp").agg(F.min("node").alias("first")), spark, "copies-fingerprints")
    same = marks.select("node", "fp").join(firsts, "fp").filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    stars = near_links(firsts.select("fp"), near).toDF("x", "y")
    return stars.join(firsts.toDF("x", "a"), "x").join(firsts.toDF("y", "b"), "y").select("a", "b").unionByName(same)


def jaccard(one: np.ndarray, two: np.ndarray, least: float) -> bool:
    """Whether two sets have at least this similarity."""
    if min(len(one), len(two)) < least * max(len(one), len(two)):
        return False
    both = len(np.intersect1d(one, two, assume_unique=True))
    return both + 1e-9 >= least * (len(one) + len(two) - both)


def alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have at least this Jaccard similarity."""
    met = pairs.join(sets.toDF("a", "one"), "a").join(sets.toDF("b", "two"), "b").select("a", "b", "one", "two")

    def each(part: dict) -> dict:
        each_pair = zip(part["one"].to_pylist(), part["two"].to_pylist(), strict=True)
        out = [jaccard(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), similarity) for x, y in each_pair]
        return {"a": part["a"], "b": part["b"], "ok": out}

    return arrow_map(met, each, "a long,b long,ok boolean").filter("ok").select("a", "b")


def open_links(nodes: np.ndarray, roots: np.ndarray, key: int, keys: np.ndarray, low: np.ndarray, held: list[bytes], similarity: float) -> Iterator[tuple[int, int]]:
    """Links between the sets of one key's rows that are not linked yet; a pair is held against another in its first key alone."""
    labels = np.unique(roots, return_inverse=True)[1]
    # 120 least hashes estimate a similarity within 0.037: four deviations are left as room.
    least = (similarity - 0.15) * low.shape[1]
    for k in range(len(nodes) - 1):
        at = np.flatnonzero(labels[k + 1 :] != labels[k]) + k + 1
        same = (low[at] == low[k]).sum(axis=1)
        at, same = at[same >= least], same[same >= least]
        own = np.flatnonzero(keys[k] == key)[0]
        at = at[np.argsort(-same, kind="stable")]
        at = at[(keys[at] == keys[k]).argmax(axis=1) == own]
        one = np.frombuffer(held[k], np.uint64)
        for j in at.tolist():
            if labels[j] != labels[k] and jaccard(one, np.frombuffer(held[j], np.uint64), similarity):
                labels[labels == labels[j]] = labels[k]
                yield int(nodes[k]), int(nodes[j])


def apart(rows: DataFrame, similarity: float, most: int = 4096) -> DataFrame:
    """Links (a, b) that join what all near copies among rows (key, node, root, keys, low, held) that share a key join."""
    large = rows.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("key", F.ceil(F.col("n") * 2 / most).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64("node", F.lit(1)), F.col("chunks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (F.least(j, F.col("chunk")) * F.col("chunks") + F.greatest(j, F.col("chunk"))).cast("long"))
    dealt = rows.join(large, "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("chunk", chunk)
    dealt = dealt.select("key", F.explode(pairs).alias("pair"), "node", "root", "keys", "low", "held").repartition("key", "pair").sortWithinPartitions("key", "pair")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None

        def links(whole: np.ndarray, keys: np.ndarray, low: np.ndarray, held: list[bytes]) -> pa.RecordBatch:
            found = list(open_links(whole[:, 2], whole[:, 3], whole[0, 0], keys, low, held, similarity))
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], schema=schema)

        for batch in batches:
            if not batch.num_rows:
                continue
            whole = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
            keys = batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            low = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            held = batch.column(6).to_pylist()
            if rest is not None:
                whole, keys, low = (np.concatenate(x) for x in zip(rest[:3], (whole, keys, low), strict=True))
                held = rest[3] + held
            cuts = np.concatenate(([0], np.flatnonzero((whole[1:, :2] != whole[:-1, :2]).any(axis=1)) + 1)).tolist()
            for x, y in zip(cuts[:-1], cuts[1:], strict=True):
                yield links(whole[x:y], keys[x:y], low[x:y], held[x:y])
            x = cuts[-1]
            rest = whole[x:], keys[x:], low[x:], held[x:]
        if rest is not None:
            yield links(*rest)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def near_copies(distinct: DataFrame, spark: SparkSession, shingle: int = 5, similarity: float = 0.8, near: int = 3) -> DataFrame:
    """node and root of every text of distinct (node, text) that has a near copy: sets linked by SimHash or by Jaccard similarity.

    SimHashes link at `near` or fewer differing bits; a pair of Jaccard similarity 0.8 differs in about ten, where segments can't
    reach. So pairs of this similarity are added: each key hashes five least shingles, so that a pair at 0.8 shares one of 24
    keys but for a chance of 1 in 10,000. Every text is held against the smallest of each of its keys, exactly, and then
    against all others of its keys that are not linked with it yet.
    """
    marks = saved(signatures(distinct, shingle), spark, "copies-signatures")
    close = saved(near_nodes(marks, spark, near), spark, "copies-simhash")
    dealt = marks.select("node", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("first"), F.count("*").alias("n")).filter("n > 1").select("key", "first")
    shared = saved(dealt.join(shared, "key"), spark, "copies-keys")
    sets = distinct.join(shared.select("node").distinct(), "node", "left_semi")
    sets = saved(arrow_map(sets, lambda part: {"node": part["node"], "held": [shingles(t, shingle).tobytes() for t in raw_texts(part["text"])]}, "node long,held binary"), spark, "copies-sets")
    stars = shared.filter("node != first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    links = saved(alike(stars, sets, similarity).unionByName(close), spark, "copies-links")
    roots = components(links, spark, "copies")
    known = shared.select("key", "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = known.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("key")
    rest = known.join(several, "key", "left_semi").join(marks.drop("fp"), "node").join(sets, "node")
    more = saved(apart(rest.select("key", "node", "root", "keys", "low", "held"), similarity), spark, "copies-more")
    found = components(links.unionByName(more), spark, "copies-all")
    for done in (marks, close, shared, sets, links, more):
        forget(spark, done)
    return found


def one_of_each(df: DataFrame, spark: SparkSession, shingle: int = 5, similarity: float = 0.8, near: int = 3) -> DataFrame:
    """df with one row of every set of near copies, that of the smallest doc_id (null last); its columns stay.

    Rows are told apart by all of their columns, so that neither null nor repeated doc_ids join different texts.
    """
    node = F.xxhash64(F.coalesce("text", F.lit(""))).alias("node")
    row = F.xxhash64(*df.columns, *[F.col(c).isNull() for c in df.columns]).alias("__row")
    roots = near_copies(df.select(node, "text").dropDuplicates(["node"]), spark, shingle, similarity, near)
    # No row or one for each: equal rows are one here, with their number.
    rows = df.select("doc_id", node, row).groupBy("doc_id", "node", "__row").agg(F.count("*").alias("__n"))
    rows = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node", "__row", "__n")).alias("kept")
    keep = saved(rows.groupBy("root").agg(first).select("kept.__row", "kept.__n"), spark, "copies-kept")
    kept = df.select("*", row).join(keep, "__row")
    if not keep.filter("__n > 1").limit(1).count():
        return kept.select(df.columns)
    once = kept.filter("__n > 1").dropDuplicates(["__row"])
    return kept.filter("__n = 1").unionByName(once).select(df.columns)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and near-duplicate components of all documents."""
    found = near_duplicates(table(spark, sf_dir, "documents"), spark)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
