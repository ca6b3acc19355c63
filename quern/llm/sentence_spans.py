"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after closing marks, at line ends, and before every capitalised word, so that a passage set
into the middle of a sentence starts one of its own. A sentence of more than `LONG` words is cut again, after words that a
hash of the word picks, so that copies are cut alike wherever they begin and a sentence hardly ever holds a passage (a word said over and over does not cut). Every run of `several` consecutive
sentences is hashed, and hashes are joined globally; the first run in (doc_id, place) order stays. Sentences covered by any
other run are removed, where sentences so covered stand together with at least `words` words: shorter repeats are phrases.

Every word has a hash, and a run's hash is a polynomial of its words' hashes, of 96 bits; a document is known by its id and 36
bits of a hash of its text. Rows are dealt by hash once and ranked; hashes of many runs (told from one row in `SHARE`; about `HEAVY` at most can be
that frequent) have their first places broadcast, and their rows are dealt anywhere. Words are compared as they stand; white
space between them is not. Null and empty texts have no sentences; very long texts are cut whole. Repeated rows (one doc_id, one
text) are one document: none is a copy of the other. A null doc_id comes before all others. An empty table gives no rows.
Columns but doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

from array import array
from itertools import chain

import numpy as np
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quern.llm.common import arrow_map, saved, table, texts

#: Words, which wide closing marks end too.
WIDE = regex.compile(r"[^\s。！？]*[。！？]+[”’」』）]*|[^\s。！？]+")
WORD = regex.compile(r"\S+")
#: What ends a sentence, and what may follow it.
CLOSING, AFTER = frozenset(".!?…。！？"), frozenset("\"'”’)]」』）")
#: Longer sentences are cut after one word in `EACH`.
LONG, EACH = 12, 6
#: Hashes are frequent that have more than this part of all runs, by a sample of one run in `SHARE`.
HEAVY, SHARE = 2000, 64
#: Bits of a sentence's number in `spot`; the text's hash has the rest.
FIRST = 28
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class Lexicon(dict):
    """Words' numbers; by number their hashes and what they do to sentences: 1 begins one, 2 ends one, 4 may cut a long one."""

    def __init__(self):
        self.low, self.high, self.flags = array("Q"), array("Q"), bytearray()

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self.low)
        digest = xxhash.xxh3_128_intdigest(word)
        self.low.append(digest & 0xFFFFFFFFFFFFFFFF)
        self.high.append(digest >> 64)
        ends = word[-1] in CLOSING or (len(word) > 1 and word[-1] in AFTER and word[-2] in CLOSING)
        self.flags.append(word[0].isupper() + 2 * ends + 4 * (digest % EACH == 0))
        return at


_LEXICON: list[Lexicon] = []


def lexicon(most: int = 400_000) -> Lexicon:
    """One a process, begun anew beyond `most` words."""
    if not _LEXICON or len(_LEXICON[0]) > most:
        _LEXICON[:] = [Lexicon()]
    return _LEXICON[0]


def words_of(text: str) -> tuple[list[str], list[int]]:
    """The words, and how many each line has."""
    if any(x in text for x in "。！？"):
        lines = [WIDE.findall(line) for line in text.split("\n")]
    else:
        lines = [line.split() for line in text.split("\n")]
    return list(chain.from_iterable(lines)), list(map(len, lines))


def starts(words: list[str], lines: list[int], known: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all words, and the places where sentences begin."""
    n = len(words)
    number = np.fromiter(map(known.__getitem__, words), np.int64, n)
    flags = np.frombuffer(known.flags, np.uint8)[number] if n else np.empty(0, np.uint8)
    begins = np.zeros(n + 1, bool)
    begins[:n] = flags & 1
    begins[1:] |= (flags & 2) > 0
    begins[np.cumsum([0, *lines])] = True  # n too
    at = np.flatnonzero(begins[:n]) if n else np.empty(0, np.int64)
    size = np.diff(np.append(at, n))
    cuts = np.flatnonzero(np.repeat(size > LONG, size) & ((flags & 4) > 0)) + 1
    begins[cuts] = True
    return number, np.flatnonzero(begins[:n])


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of every sentence."""
    words, lines = words_of(text)
    if not words:
        return []
    places = [m.span() for m in (WIDE if any(x in text for x in "。！？") else WORD).finditer(text)]
    at = starts(words, lines, lexicon())[1].tolist()
    return [(places[a][0], places[b - 1][1]) for a, b in zip(at, [*at[1:], len(words)], strict=True)]


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(number: np.ndarray, at: np.ndarray, several: int, known: Lexicon) -> list[np.ndarray]:
    """Two 64-bit hashes of every run of `several` sentences: sums of word hashes by powers of a base, from the run's first word on."""
    n, runs = len(number), len(at) - several + 1
    if runs <= 0:
        return [np.empty(0, np.uint64)] * 2
    first, last = at[:runs], np.append(at, n)[several:]
    out = []
    for base, hashes in zip(BASES, (known.low, known.high), strict=True):
        h = np.frombuffer(hashes, np.uint64)[number]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * _powers(base, n), dtype=np.uint64)))
        x = (sums[last] - sums[first]) * _powers(pow(base, -1, 1 << 64), n)[first] + (last - first).astype(np.uint64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(BASES[0])
        out.append(x ^ (x >> np.uint64(29)))
    return out


def rows_of(df: DataFrame) -> DataFrame:
    """doc_id, text and a mark of the text: together the document's key, alike for repeated rows."""
    return df.select("doc_id", "text", F.shiftleft(F.xxhash64("text"), FIRST).alias("row"))


def spans(df: DataFrame, several: int = 3) -> DataFrame:
    """hash, check (32 more bits), doc_id and spot (the text's mark and the first sentence) of every run of df (doc_id, text)."""

    def each(part: dict) -> dict:
        low, high, first, n = [], [], [], []
        for text in texts(part["text"]):
            known = lexicon()
            number, at = starts(*words_of(text), known)
            a, b = run_hashes(number, at, several, known)
            low.append(a)
            high.append(b)
            first.append(np.arange(len(a)))
            n.append(len(a))
        of, first = np.repeat(np.arange(len(n)), n), np.concatenate(first) if n else np.empty(0, np.int64)
        check = (np.concatenate(high) >> np.uint64(32)).astype(np.uint32).view(np.int32) if n else np.empty(0, np.int32)
        return {"hash": np.concatenate(low).view(np.int64) if n else [], "check": check, "doc_id": part["doc_id"].take(of), "spot": part["row"].to_numpy()[of] + first}

    return arrow_map(rows_of(df), each, "hash long,check int,doc_id long,spot long")


def repeated(df: DataFrame, spark: SparkSession, several: int = 3) -> DataFrame:
    """doc_id, row and first sentence of every run that is not the first of its hash."""
    found, key = saved(spans(df, several), spark, "sentence-spans"), ["hash", "check"]
    # Which hashes go apart changes no result, so a sample may tell; a frequent one is bound to be seen.
    limit = max(1000, found.count() // HEAVY) / SHARE
    sample = found.filter(F.pmod(F.xxhash64("doc_id", "spot"), F.lit(SHARE)) == 0)
    heavy = [r["hash"] for r in sample.groupBy("hash").agg(F.count("*").alias("n")).filter(F.col("n") > limit).collect()]
    kept = found.filter(F.col("hash").isin(heavy)).groupBy(key).agg(F.min(F.struct("doc_id", "spot")).alias("kept"))
    # Every row goes on: those of a frequent hash know its first place and are dealt anywhere, others are ranked within their hash.
    known = found.join(F.broadcast(kept), key, "left")
    apart = F.when(F.col("kept").isNull(), 0).otherwise(F.xxhash64("doc_id", "spot"))
    place = F.rank().over(W.partitionBy(*key, "apart").orderBy(F.col("doc_id").asc_nulls_first(), "spot"))
    first = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("spot") == F.col("kept.spot"))
    late = known.withColumn("apart", apart).withColumn("place", place).filter(F.when(F.col("kept").isNull(), F.col("place") > 1).otherwise(~first))
    sentence = F.col("spot").bitwiseAND((1 << FIRST) - 1)
    return late.select("doc_id", (F.col("spot") - sentence).alias("row"), sentence.cast("int").alias("first"))


def without_repeats(text: str, covers: list[int], several: int, words: int) -> tuple[str, int, int]:
    """The text without covered sentences, how many went, and their words."""
    cut = sentences(text)
    gone = np.zeros(len(cut) + 1, np.int64)
    for a in covers:
        gone[a] += 1
        gone[a + several] -= 1
    gone = np.cumsum(gone)[:-1] > 0
    size = np.array([len(text[a:b].split()) for a, b in cut], np.int64)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0])))).reshape(-1, 2)
    for a, b in edges.tolist():
        if size[a:b].sum() < words:
            gone[a:b] = False
    if not gone.any():
        return text, 0, 0
    out, at = [], 0
    for (a, b), away in zip(cut, gone.tolist(), strict=True):
        if not away:  # a removed sentence takes the white space before it along
            out.append(text[at:b] if out or at == 0 else text[a:b])
        at = b
    return "".join(out), int(gone.sum()), int(size[gone].sum())


def dedup(df: DataFrame, spark: SparkSession, several: int = 3, words: int = 30) -> DataFrame:
    """doc_id, n_removed, words_removed and the text left, for every row of df (doc_id, text)."""
    again = repeated(df, spark, several).groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.collect_set("first").alias("covers"))
    whole = rows_of(df).join(again, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")

    def each(part: dict) -> dict:
        found = [without_repeats(text, covers, several, words) if covers else (text, 0, 0) for text, covers in zip(texts(part["text"]), part["covers"].to_pylist(), strict=True)]
        return {"doc_id": part["doc_id"], "text": [x[0] for x in found], "n_removed": [x[1] for x in found], "words_removed": [x[2] for x in found]}

    return arrow_map(whole.select("doc_id", "text", "covers"), each, "doc_id long,n_removed long,words_removed long,text string")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages of 30 words or more that an earlier document or place has."""
    return dedup(table(spark, sf_dir, "documents"), spark)
