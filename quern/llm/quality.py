"""Quality classifier by compression: text that a dictionary of good texts shortens more is good.

Two zstandard dictionaries hold slices of labelled good and bad texts. A text is cut into pieces of `piece` bytes, and
each piece is compressed once with either dictionary; with G and B the summed sizes, (B - G) / length is the normalised
compressed-size difference of the whole text, and a logistic curve fitted on other labelled texts makes it a score.

Learning takes a bounded sample of labelled rows, a documented parameter: `sample` rows by hash order, a third of them
for the dictionaries. Scoring covers every row. Labels, lang, source and doc_id are no inputs of a score.

Null and empty texts score as a difference of zero. Repeated labels of a document count once, by their mean; null labels
are left out. Without labels of both classes there is nothing to compare: the score is the share of good labels, 0.5 without any.
"""

from __future__ import annotations

import math
import random

import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, raw_texts, saved, table

THRESHOLD = 0.3


def held_out(of: str = "doc_id", mod: int = 5) -> F.Column:
    """Whether crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(of).cast("string").cast("binary")) % mod == 0, F.lit(False))


class Judge:
    """A fitted classifier, small enough to ship: two dictionaries and the curve."""

    def __init__(self, good: bytes, bad: bytes, level: int, piece: int):
        self.good, self.bad, self.level, self.piece = good, bad, level, piece
        self.slope, self.offset, self._tools = 0.0, 0.0, None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tools": None}

    def difference(self, text: bytes) -> float:
        """The normalised compressed-size difference of the whole text."""
        if not text:
            return 0.0
        if self._tools is None:
            self._tools = []
            for content in (self.good, self.bad):
                known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                known.precompute_compress(level=self.level)
                self._tools.append(zstandard.ZstdCompressor(level=self.level, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))
        g, b = (sum(len(tool.compress(text[a : a + self.piece])) for a in range(0, len(text), self.piece)) for tool in self._tools)
        return (b - g) / len(text)

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.difference(text) + self.offset))))


def slices(text: bytes, seed: int, part: int = 700, most: int = 16) -> list[bytes]:
    """Slices of a text, from places that its document's id picks."""
    rng = random.Random(seed)
    places = [rng.randrange(max(1, len(text) - part + 1)) for _ in range(most)]
    return [text[at : at + part] for at in places]


def _dictionary(sample: list[list[bytes]], size: int) -> bytes:
    """A dictionary of `size` bytes at most: one slice of each text in turn, from all over the texts."""
    out, left = [], size
    for turn in range(max(map(len, sample), default=0)):
        for own in sample:
            if left <= 0:
                return b"".join(out)[-size:]
            out.append(own[turn])
            left -= len(out[-1])
    return b"".join(out)[-size:]


def logistic(x: list[float], y: list[int], ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset by Newton's method on standardised x, with classes in their own proportions."""
    mean = sum(x) / len(x)
    std = math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)) or 1.0
    share = min(0.999, max(0.001, sum(y) / len(y)))
    a, b = 0.0, math.log(share / (1 - share))
    for _ in range(50):
        ga = gb = haa = hab = hbb = 0.0
        for v, t in zip(x, y, strict=True):
            z = (v - mean) / std
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, a * z + b))))
            w = max(p * (1 - p), 1e-9)
            ga, gb, haa, hab, hbb = ga + (p - t) * z, gb + p - t, haa + w * z * z, hab + w * z, hbb + w
        ga, haa = ga + ridge * len(x) * a, haa + ridge * len(x)
        det = haa * hbb - hab * hab + 1e-12
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - max(-4.0, min(4.0, da)), b - max(-4.0, min(4.0, db))
        if abs(da) + abs(db) < 1e-9:
            break
    return a / std, b - a * mean / std


def fit(df: DataFrame, labels: DataFrame, mod: int = 5, sample: int = 6000, size: int = 112_640, level: int = 9, piece: int = 16_384) -> Judge | float:
    """A Judge from the labelled rows whose id is not held out; the share of good labels where they are all alike."""
    spark = df.sparkSession
    rows = labels.select("doc_id", "quality").filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(mod=mod))
    each = rows.groupBy("doc_id").agg(F.avg("quality").alias("q"))
    # At most `sample` ids, and so a join side of bounded size.
    chosen = each.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, q double")
    texts = df.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("q").alias("q"))
    texts = saved(texts.filter(F.length("text") > 0).select("doc_id", "text", (F.col("q") >= 0.5).cast("int").alias("q")), spark, "quality-texts")

    # Of each text the driver gets a few slices, or one difference, however long it is.
    def cut(part: dict) -> dict:
        ids = part["doc_id"].to_pylist()
        return {"doc_id": ids, "q": part["q"], "part": [int(mixed(i) % 3 != 0) for i in ids], "slices": [slices(t, i) for t, i in zip(raw_texts(part["text"]), ids, strict=True)]}

    found = arrow_map(texts, cut, "doc_id long,q int,part int,slices array<binary>").orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator()
    learn: dict[tuple[int, int], list[list[bytes]]] = {(p, q): [] for p in (0, 1) for q in (0, 1)}
    for r in found:
        learn[r["part"], r["q"]].append(r["slices"])
    good, bad = (sum(len(learn[p, q]) for p in (0, 1)) for q in (1, 0))
    if not good or not bad:
        return good / (good + bad) if good + bad else 0.5
    # Few labels: the same texts serve both ends.
    both = {q for q in (0, 1) if not learn[0, q] or not learn[1, q]}
    judge = Judge(*(_dictionary(learn[0, q] or learn[1, q], size) for q in (1, 0)), level, piece)
    shipped = spark.sparkContext.broadcast(judge)

    def differ(part: dict) -> dict:
        own = shipped.value
        return {"doc_id": part["doc_id"], "q": part["q"], "x": [own.difference(t) for t in raw_texts(part["text"])], "part": [int(mixed(i) % 3 != 0) for i in part["doc_id"].to_pylist()]}

    rows = arrow_map(texts, differ, "doc_id long,q int,x double,part int").filter((F.col("part") == 1) | F.col("q").isin(list(both))).orderBy("q", F.xxhash64("doc_id"), "doc_id").collect()
    judge.slope, judge.offset = logistic([r["x"] for r in rows], [r["q"] for r in rows])
    return judge


def mixed(n: int) -> int:
    """A small mixing hash, so that the split of the sample does not follow the ids."""
    n = (n * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return (n >> 29) ^ (n >> 3)


def score(df: DataFrame, judge: Judge | float, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of df (doc_id, text)."""
    shipped = df.sparkSession.sparkContext.broadcast(judge)

    def each(part: dict) -> dict:
        judge = shipped.value
        found = [judge if isinstance(judge, float) else judge.score(t) for t in raw_texts(part["text"])]
        return {"doc_id": part["doc_id"], "held_out": part["held_out"], "score": found, "predicted": [int(s >= threshold) for s in found]}

    return arrow_map(df.select("doc_id", "text", held_out().alias("held_out")), each, "doc_id long,held_out boolean,score double,predicted int")


def keep_good(df: DataFrame, judge: Judge | float, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of df whose text the judge accepts, unchanged."""
    import pyarrow as pa

    shipped = df.sparkSession.sparkContext.broadcast(judge)
    at = df.columns.index("text")

    def run(batches):
        for batch in batches:
            judge = shipped.value
            yield batch.filter(pa.array([(judge if isinstance(judge, float) else judge.score(t)) >= threshold for t in raw_texts(batch.column(at))], pa.bool_()))

    return df.mapInArrow(run, df.schema)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every whole text of documents."""
    df = table(spark, sf_dir, "documents")
    return score(df, fit(df, table(spark, sf_dir, "labels")))
