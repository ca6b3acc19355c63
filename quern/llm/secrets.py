"""Secret scans by token efficiency: what a public vocabulary needs many tokens for is random.

Fixed patterns find assignments, access keys and hexadecimal runs. The method adds every run of key characters, or what base
spans leave of it, that averages few characters a token under a tiktoken vocabulary, whatever characters it has. A
run is one if its ratio is no higher than its length allows (`RATIOS`): 1.5 from 12 characters on, 1.75 from 16, 2.0 from 20; on clean words of
sf0.1 two of 27,000 are that low. Known digests (hexadecimal of a digest's length), UUIDs, plain numbers and account
numbers are identifiers and are left out; of names joined by marks (paths, options) each word is measured on its own.

Null and empty texts have no spans; texts are scanned whole, however long; repeated rows come out as often as they stand; an
empty table gives no rows. `scan` leaves out columns but doc_id and text, whatever their names; `redact` carries all through.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import arrow_map, table, texts

# Fixed values of the contract.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
# Lengths in hexadecimal of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGESTS = (32, 40, 56, 64, 96, 128)

RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
DIGEST = re.compile("|".join(f"[0-9a-fA-F]{{{n}}}" for n in DIGESTS))
NUMBER = re.compile(r"([A-Z]{2})?[0-9+/_=-]+")
#: Words and numbers joined by marks: names that people write.
NAME = re.compile(r"([A-Za-z][a-z]*|[A-Z]+|[0-9]{1,6})?([_+/=-]+([A-Za-z][a-z]*|[A-Z]+|[0-9]{1,6})?)+")
PART = re.compile(r"[A-Za-z0-9]{12,}")
#: From how many characters on a run is a secret at how many characters a token or fewer.
RATIOS = ((20, 2.0), (16, 1.75), (12, 1.5))
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "byte_bpe_50k.tiktoken"


def _ranks(vocabulary: str | None) -> bytes:
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    with open(vocabulary, "rb") as f:
        return f.read()


@lru_cache(2)
def _encoding(ranks: bytes):
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns; matches are found first and then held to their least length."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def outside(run: tuple[int, int], base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """What base spans leave of a run."""
    at, end = run
    out = []
    for a, _, b in base:  # in order of their starts
        if a < end and b > at:
            if a > at:
                out.append((at, a))
            at = max(at, b)
    return out + [(at, end)] * (at < end)


def random_spans(text: str, base: list[tuple[int, int, int]], encode, ratios=RATIOS) -> list[tuple[int, int, int]]:
    """Runs outside the base spans with few characters a token."""
    found, least = [], ratios[-1][0]
    for m in RUN.finditer(text):
        for a, b in outside(m.span(), base) if base else (m.span(),):
            run = text[a:b]
            if len(run) < least or UUID.fullmatch(run) or DIGEST.fullmatch(run) or NUMBER.fullmatch(run):
                continue
            for x, y in [(a + w.start(), a + w.end()) for w in PART.finditer(run)] if NAME.fullmatch(run) else [(a, b)]:
                ratio = (y - x) / len(encode(text[x:y]))
                if any(y - x >= n and ratio <= most for n, most in ratios):
                    found.append((x, 3, y))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(df: DataFrame, vocabulary: str | None = None, ratios=RATIOS) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans and all spans, a row for every row of df (doc_id, text).

    `vocabulary` names a tiktoken rank file that the driver reads; its bytes (under 1 MB) are broadcast.
    """
    ranks = df.sparkSession.sparkContext.broadcast(_ranks(vocabulary))

    def each(part: dict) -> dict:
        encode = _encoding(ranks.value).encode_ordinary
        out = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")}
        for text in texts(part["text"]):
            base = base_spans(text)
            more = random_spans(text, base, encode, ratios)
            for k, name in enumerate(KINDS):
                out[f"n_{name}"].append(sum(x[1] == k for x in base + more))
            out["base_sha256"].append(hashlib.sha256(_joined(base).encode()).hexdigest())
            out["spans"].append(_joined(sorted(base + more)))
        return {"doc_id": part["doc_id"]} | out

    return arrow_map(df.select("doc_id", "text"), each, "doc_id long,n_assign long,n_access long,n_hex long,n_random long,base_sha256 string,spans string")


def redacted(text: str, spans: list[tuple[int, int]], mark: str) -> str:
    """text with every span, overlapping ones joined, replaced by mark."""
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(df: DataFrame, mark: str = "[SECRET]", vocabulary: str | None = None, ratios=RATIOS) -> DataFrame:
    """df with secrets in `text` replaced by mark; rows without secrets, and all other columns, stay as they are."""
    ranks = df.sparkSession.sparkContext.broadcast(_ranks(vocabulary))
    import pyarrow as pa

    names = df.columns

    def run(batches):
        for batch in batches:
            encode = _encoding(ranks.value).encode_ordinary
            out = []
            for text in batch.column(names.index("text")).to_pylist():
                if text:
                    base = base_spans(text)
                    spans = [(a, b) for a, _, b in base + random_spans(text, base, encode, ratios)]
                    text = redacted(text, spans, mark) if spans else text
                out.append(text)
            columns = [pa.array(out, batch.schema.field("text").type) if n == "text" else c for n, c in zip(names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return df.mapInArrow(run, df.schema)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text of documents."""
    return scan(table(spark, sf_dir, "documents"))
