"""LM scoring: a causal self-attention model, trained in numpy on subword ids, scores every token of every text once.

Words (lower-cased) are spelled in ids of a public byte-level vocabulary. The `heads` ids that are most frequent in the
training corpus get rows in the model, in classes of equal size; a last class holds all other ids by their smoothed
corpus counts, so that probabilities of all texts sum to one (2,048 heads cover 99.98% of the ids of the check tables).
The model is one attention layer: keys and queries of the ids, a learnt bias for each distance, values added to what the
last two ids say, then a class and a member within it by softmax.

Texts are cut into blocks of `STEP` ids. Each block is scored in one context window with the block before it, so windows
overlap and each id is scored exactly once; all windows of a batch go through one masked attention.

Corpus statistics cover all training documents: word counts, totals, id counts and the words' base probabilities. The
model learns from every window of every training document, whatever the corpus' size, so that gradient work grows with the corpus
(a small corpus is gone through again until `least` windows have been learnt from). Documents fall into `ROUNDS` rounds by hash. In a round,
trainers that each stream a part of its documents step on from the shared weights, and their weights are averaged, by
windows seen; there are as many trainers as the round has `PART` windows.

Frequent words (at most `frequent`, none above 1,024 bytes) are broadcast with their counts; the occurrences of all others
are joined to the counts by word, once a document, so that only a longer word in many documents is a hot key, which adaptive
execution splits. Null and empty texts have the end as their only token. A null doc_id is not held out. Repeated rows count and
score as often as they stand. Very long texts are read whole. An empty table gives no rows. Columns but doc_id and text,
whatever their names, are left out.
"""

from __future__ import annotations

import base64
import math
import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import raw_texts, saved, table

VOCABULARY = "byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
STEP, WIDTH, KEY = 16, 24, 8
#: Longest word that may be broadcast, in bytes.
LONGEST = 1024
#: Rounds of training, windows a trainer sees in a round, and windows of one step.
ROUNDS, PART, BATCH = 8, 1 << 15, 512
#: Windows of a run, which are trained on together.
RUN = 8
#: Columns of the table that symbols are looked up in; values have a one beside them.
_V, _Q, _K = slice(0, WIDTH + 1), slice(WIDTH + 1, WIDTH + 1 + KEY), slice(WIDTH + 1 + KEY, WIDTH + 1 + 2 * KEY)
_ONE, _TWO = slice(_K.stop, _K.stop + WIDTH), slice(_K.stop + WIDTH, _K.stop + 2 * WIDTH)


class Speller:
    """Words to ids, each with a blank before it."""

    def __init__(self, ranks: bytes):
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.tool = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
        self.size = max(merges.values()) + 1
        self.starts = np.zeros(self.size, bool)
        for token, i in merges.items():
            self.starts[i] = token.startswith(b" ")

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words, one after another, and how many each has."""
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ids = np.array(self.tool.encode_ordinary(" " + b" ".join(words).decode("utf-8", "replace")), np.int64)
        at = np.flatnonzero(self.starts[ids])
        if len(at) != len(words) or at[0]:  # a word with white space of its own
            each = [self.tool.encode_ordinary(" " + w.decode("utf-8", "replace")) for w in words]
            return np.array([i for x in each for i in x], np.int64), np.array([len(x) for x in each], np.int64)
        return ids, np.diff(np.append(at, len(ids)))


_SPELLERS: dict[int, Speller] = {}


def speller(ranks: bytes) -> Speller:
    """One a process."""
    if len(ranks) not in _SPELLERS:
        _SPELLERS[len(ranks)] = Speller(ranks)
    return _SPELLERS[len(ranks)]


class Model:
    """The attention model over symbols: 0 pads, 1 begins, 2 ends, 3 is any rare id, then the head ids."""

    def __init__(self, counts: np.ndarray, ends: int, heads: int, seed: int = 1):
        order = np.argsort(-counts, kind="stable")
        order = order[counts[order] > 0][: heads - 1]
        self.symbol = np.full(len(counts), 3, np.int32)
        self.symbol[order] = np.arange(4, 4 + len(order))
        # The members: the end and the head ids, most frequent first, in classes; then the class of rare ids.
        n = len(order) + 1
        self.per = max(1, math.ceil(math.sqrt(n)))
        self.classes = math.ceil(n / self.per)
        self.of = np.zeros(4 + len(order), np.int32)
        self.of[2], self.of[4:], self.of[3] = 0, np.arange(1, n), self.classes * self.per
        self.group = (np.arange((self.classes + 1) * self.per) // self.per).astype(np.uint16)
        rare = np.where(self.symbol == 3, counts + 0.5, 0.0)
        self.rare = np.log(np.maximum(rare, 1e-300) / rare.sum()).astype(np.float64)
        rng = np.random.default_rng(seed)
        v, c = 4 + len(order), self.classes + 1
        made = lambda *shape, by=0.1: rng.normal(0, by, shape).astype(np.float32)
        members = np.full(self.classes * self.per, 0.5)
        members[0] += ends
        members[1:n] += counts[order]
        members[n:] = 1e-9
        members = members.reshape(self.classes, self.per)
        groups = np.append(members.sum(1), rare.sum())
        self.p = {
            "q": made(v, KEY), "k": made(v, KEY), "v": made(v, WIDTH), "one": made(v, WIDTH), "two": made(v, WIDTH), "far": np.zeros(2 * STEP, np.float32),
            "bias": np.zeros(WIDTH, np.float32), "c": made(c, WIDTH), "cb": np.log(groups / groups.sum()).astype(np.float32), "d": made(self.classes, self.per, WIDTH), "db": np.log(members / members.sum(1, keepdims=True)).astype(np.float32),
        }
        i, j = np.arange(STEP)[:, None] + STEP, np.arange(2 * STEP)[None, :]
        self.gap = np.where(j <= i, i - j, 0)
        self.seen = j <= i

    def windows(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs [n, 2 STEP] and targets [n, STEP] of sequences without begin and end, and each window's sequence."""
        blocks = np.array([-(-(len(s) + 1) // STEP) for s in symbols])
        flat = np.zeros(int((blocks + 1).sum()) * STEP, np.int32)
        goal = np.zeros_like(flat)
        at = np.concatenate(([0], np.cumsum(blocks + 1)[:-1])) * STEP + STEP  # a block of padding goes before each
        for a, s in zip(at.tolist(), symbols, strict=True):
            flat[a] = 1
            flat[a + 1 : a + 1 + len(s)] = s
            goal[a : a + len(s)] = s
            goal[a + len(s)] = 2
        own = np.repeat(at // STEP, blocks) + np.arange(int(blocks.sum())) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        rows = flat.reshape(-1, STEP)
        return np.concatenate((rows[own - 1], rows[own]), axis=1), goal.reshape(-1, STEP)[own], np.repeat(np.arange(len(symbols)), blocks)

    def runs(self, symbols: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The same windows in runs of `RUN` that follow one another: inputs [n, (RUN + 1) STEP] and targets [n, RUN STEP].

        Blocks are looked up once a run, as a window's second half is the next one's first. Windows of padding have no targets.
        """
        sizes = np.array([len(s) for s in symbols], np.int64)
        flat, goal, _, _ = _blocks(symbols, sizes)
        n = max(1, -(-(len(flat) // STEP - 1) // RUN))
        flat, goal = (np.concatenate((a, np.zeros((n * RUN + 1) * STEP - len(a), np.int32))).reshape(-1, STEP) for a in (flat, goal))
        at = np.arange(n)[:, None] * RUN + np.arange(RUN + 1)
        return flat[at].reshape(n, -1), goal[at[:, 1:]].reshape(n, -1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, float]:
        """What a symbol is looked up for, side by side (value, one, query, key, last but none, last but one), weights of distances, and a bound on exponents."""
        p = self.p
        most = float(np.sqrt((p["q"] ** 2).sum(1)).max() * np.sqrt((p["k"] ** 2).sum(1)).max() + np.abs(p["far"]).max())
        table = np.hstack([p["v"], np.ones((len(p["v"]), 1), p["v"].dtype), p["q"], p["k"], p["one"] + p["bias"], p["two"]])
        return table, p["far"], most

    def attend(self, x: np.ndarray, table: np.ndarray, far: np.ndarray, most: float) -> tuple[np.ndarray, ...]:
        """Hidden states [n, runs, STEP, WIDTH] of every block of x [n, (runs + 1) STEP] but the first, each in a window with the block before it,
        and what the backward pass needs. Weights are not yet divided by their sums: values have a one beside them, which adds these up."""
        tokens = table[x]
        v, k = _halves(tokens[:, :, _V], 2), _halves(tokens[:, :, _K], 2)
        q = _halves(tokens[:, STEP:, _Q], 1)
        e = q @ k.transpose(0, 1, 3, 2)
        first = x[:, STEP - 1 : -1 : STEP] == 0  # nothing stands before a text's first block
        if most > 60:  # beyond that, exp overflows in single precision
            e += np.where(self.seen, far[self.gap], far.dtype.type(-1e9))
            e[first, :, :STEP] = -1e9
            e -= e.max(axis=3, keepdims=True)
            np.exp(e, out=e)
        else:
            np.exp(e, out=e)
            e *= np.where(self.seen, np.exp(far)[self.gap], far.dtype.type(0))
            e[first, :, :STEP] = 0
        h = e @ v
        total, mean = h[..., WIDTH:], h[..., :WIDTH] / h[..., WIDTH:]
        h = mean + _halves(tokens[:, STEP:, _ONE], 1)
        h += _halves(tokens[:, STEP - 1 : -1, _TWO], 1)
        return np.tanh(h, out=h), e, q, k, v, mean, total

    def ready(self) -> Model:
        """Tables for scoring: keys with values and a one beside them, and the weights of distances.

        Scores are bounded by the tables' norms and hidden states by tanh; training leaves these bounds far below where
        exp overflows in single precision, and so scoring needs no row maxima. Where it doesn't, tables are scaled to fit.
        """
        p = self.p
        most = float(np.sqrt((p["q"] ** 2).sum(1)).max() * np.sqrt((p["k"] ** 2).sum(1)).max() + np.abs(p["far"]).max())
        if most > 60:
            p["q"] = p["q"] * np.float32(40 / most)
            p["far"] = p["far"] * np.float32(40 / most)
        for w, b in (("c", "cb"), ("d", "db")):
            most = float((np.abs(p[w]).sum(-1)).max())
            if most > 60:
                p[w] = p[w] * np.float32(60 / most)
        self.values = np.hstack([p["v"], np.ones((len(p["v"]), 1), np.float32)])
        self.near = np.where(self.seen, np.exp(p["far"])[self.gap], np.float32(0))
        self.shown = p["one"] + p["bias"]
        # Biases stand in a last row, as hidden states get a last column of ones.
        self.groups = np.ascontiguousarray(np.hstack([p["c"], p["cb"][:, None]]).T)
        self.logs = [np.ascontiguousarray(np.hstack([w, b[:, None]]).T) for w, b in zip(p["d"], p["db"], strict=True)]
        return self

    def log_probs(self, symbols: list[np.ndarray]) -> np.ndarray:
        """The natural-log probability of each sequence and its end; the choice among rare ids is the caller's to add.

        Sequences stand one after another in blocks of STEP, a block of padding before each, and windows overlap by one
        block: keys and values are looked up once and windows are views of them.
        """
        flat, goal, at, blocks = _blocks(symbols, np.array([len(s) for s in symbols], np.int64))
        rows, own, out = flat.reshape(-1, STEP), np.repeat(np.arange(len(symbols)), blocks), np.zeros(len(symbols))
        for low in range(1, len(rows), 512):  # windows of blocks low - 1 and low, and so on
            part = rows[low - 1 : low + 512]
            wants = goal[low * STEP : (low + len(part) - 1) * STEP]
            found = np.flatnonzero(wants)
            h = np.ones((len(found), WIDTH + 1), np.float32)
            h[:, :WIDTH] = self._hidden(part).reshape(-1, WIDTH)[found]
            out += np.bincount(np.repeat(own[low : low + len(part) - 1], STEP)[found], weights=self._picked(h, wants[found]), minlength=len(symbols))
        return out

    def _hidden(self, rows: np.ndarray) -> np.ndarray:
        """Hidden states of every row of symbols but the first, each in a window with the row before it."""
        p, n = self.p, len(rows) - 1
        view = np.lib.stride_tricks.as_strided
        k, v = p["k"][rows], self.values[rows]
        k = view(k, (n, 2 * STEP, KEY), (k.strides[0], k.strides[1], k.strides[2]))
        v = view(v, (n, 2 * STEP, WIDTH + 1), (v.strides[0], v.strides[1], v.strides[2]))
        s = p["q"][rows[1:]] @ k.transpose(0, 2, 1)
        np.exp(s, out=s)
        s *= self.near
        s[rows[:-1, -1] == 0, :, :STEP] = 0  # nothing stands before a text's first block
        h = s @ v
        flat = rows.ravel()
        out = h[..., :WIDTH] / h[..., WIDTH:]
        out += self.shown[rows[1:]]
        out += p["two"][flat[STEP - 1 : -1]].reshape(out.shape)
        return np.tanh(out, out=out)

    def _picked(self, h: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """The log probability of each goal after its hidden state, which ends in a one."""
        member = self.of[goal]
        group = member // self.per
        z = h @ self.groups
        found = z[np.arange(len(z)), group].astype(np.float64)
        np.exp(z, out=z)
        found -= np.log(z @ np.ones(z.shape[1], np.float32))
        order = np.argsort(group.astype(np.uint8 if self.classes < 255 else np.uint16), kind="stable")
        stops = np.cumsum(np.bincount(group, minlength=self.classes + 1)).tolist()
        hs, ms, ones = h[order], (member - group * self.per)[order], np.ones(self.per, np.float32)
        inner, a = np.zeros(len(h)), 0
        for g, b in enumerate(stops[: self.classes]):
            if b > a:
                z = hs[a:b] @ self.logs[g]
                inner[a:b] = z[np.arange(b - a), ms[a:b]]
                np.exp(z, out=z)
                inner[a:b] -= np.log(z @ ones)
            a = b
        found[order] += inner
        return found

    def train(self, x: np.ndarray, y: np.ndarray, adam: Adam, batch: int = BATCH) -> None:
        """One pass over runs of windows, in an order of the optimiser's, in steps of about `batch` windows."""
        order = adam.rng.permutation(len(x))
        many = max(1, batch * STEP // y.shape[1])
        for at in range(0, len(order), many):
            pick = order[at : at + many]
            adam.step(self.p, self.gradient(x[pick], y[pick], False)[1])

    def gradient(self, x: np.ndarray, y: np.ndarray, with_loss: bool = True) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss over the targets of runs of windows (zero unless asked for), and its gradient."""
        p, g = self.p, {}
        table, far, most = self.tables()
        h, e, q, k, v, mean, total = self.attend(x, table, far, most)
        spots = np.flatnonzero(y)
        member = self.of[y.ravel()[spots]]
        group = self.group[member]
        order = np.argsort(group, kind="stable")  # targets of one class stand together
        spots, member, group = spots[order], member[order], group[order].astype(np.int64)
        member -= group.astype(member.dtype) * self.per
        n, at = len(group), np.arange(len(group))
        hs = np.ones((n, WIDTH + 1), h.dtype)
        hs[:, :WIDTH] = h.reshape(-1, WIDTH)[spots]
        wide = with_loss or self._steep()
        z = hs @ np.hstack([p["c"], p["cb"][:, None]]).T
        loss, z = _softmax_loss(z, group, at, n, with_loss, wide)
        both = z.T @ hs
        g["c"], g["cb"] = both[:, :WIDTH], both[:, WIDTH]
        dh = z @ p["c"]
        weights = np.concatenate((p["d"], p["db"][:, :, None]), axis=2)
        both = np.zeros_like(weights)
        a = 0
        for c, b in enumerate(np.cumsum(np.bincount(group, minlength=self.classes + 1)).tolist()[: self.classes]):
            if b > a:
                rows, to = hs[a:b], weights[c]
                part, z = _softmax_loss(rows @ to.T, member[a:b], at[: b - a], n, with_loss, wide)
                loss += part
                np.matmul(z.T, rows, out=both[c])
                dh[a:b] += z @ p["d"][c]
            a = b
        g["d"], g["db"] = both[:, :, :WIDTH], both[:, :, WIDTH]
        hs *= hs
        np.subtract(1, hs, out=hs)
        dh *= hs[:, :WIDTH]
        full = np.zeros_like(h)
        full.reshape(-1, WIDTH)[spots] = dh
        g["bias"] = np.ones(n, h.dtype) @ dh
        # Back through the weighted means, and through their sum in a last column.
        du = np.empty((*full.shape[:3], WIDTH + 1), h.dtype)
        np.divide(full, total, out=du[..., :WIDTH])
        np.negative(np.einsum("nrsw,nrsw->nrs", du[..., :WIDTH], mean), out=du[..., WIDTH])
        ds = du @ v.transpose(0, 1, 3, 2)
        ds *= e
        moved = np.ones(ds.shape[0] * ds.shape[1], ds.dtype) @ ds.reshape(-1, STEP * 2 * STEP)
        g["far"] = np.bincount(self.gap[self.seen], weights=moved.reshape(STEP, -1)[self.seen], minlength=2 * STEP).astype(far.dtype)
        # What each place of x adds to the row of its symbol.
        out = np.zeros((*x.shape, table.shape[1]), h.dtype)
        for columns, left, right in ((_V, e, du), (_K, ds, q)):
            left = left.transpose(0, 1, 3, 2)
            # The windows of even place lie apart, and so do those of odd place.
            np.matmul(left[:, ::2], right[:, ::2], out=_apart(out[:, :, columns], 2))
            if y.shape[1] > STEP:
                odd = _apart(out[:, STEP:, columns], 2)
                odd += left[:, 1::2] @ right[:, 1::2]
        np.matmul(ds, k, out=_apart(out[:, STEP:, _Q]))
        _apart(out[:, STEP:, _ONE])[:] = full
        _apart(out[:, STEP - 1 : -1, _TWO])[:] = full
        sums = _scattered(x, len(table), out)
        g["v"], g["q"], g["k"], g["one"], g["two"] = sums[:, :WIDTH], sums[:, _Q], sums[:, _K], sums[:, _ONE], sums[:, _TWO]
        return float(loss / n), g

    def _steep(self) -> bool:
        """Whether scores of classes or members may be so far from zero that exp overflows in single precision; hidden states are bounded by tanh."""
        p = self.p
        return max(float((np.abs(p[w]).sum(-1) + np.abs(p[b])).max()) for w, b in (("c", "cb"), ("d", "db"))) > 60

    def flat(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([self.p[k].ravel() for k in sorted(self.p)]).astype(np.float32)

    def put(self, flat: np.ndarray) -> None:
        """Takes such a row as its weights."""
        at = 0
        for k in sorted(self.p):
            self.p[k] = flat[at : at + self.p[k].size].reshape(self.p[k].shape).astype(np.float32)
            at += self.p[k].size


class Adam:
    """The optimiser of one trainer: its rate rises over the first steps, as each trainer starts without moments."""

    def __init__(self, rate: float, seed: int):
        self.rate, self.rng, self.t = rate, np.random.default_rng(seed), 0
        self.m: dict[str, np.ndarray] = {}
        self.s: dict[str, np.ndarray] = {}

    def step(self, p: dict[str, np.ndarray], g: dict[str, np.ndarray]) -> None:
        """One step down the gradient."""
        self.t += 1
        low, high = 1 - 0.9**self.t, 1 - 0.99**self.t
        rate = self.rate * min(1.0, self.t / 10)
        for k in p:
            if k not in self.m:
                self.m[k], self.s[k] = np.zeros_like(p[k]), np.zeros_like(p[k])
            m, s, d = self.m[k], self.s[k], np.ascontiguousarray(g[k])
            part = d * p[k].dtype.type(0.1)
            m *= 0.9
            m += part
            np.multiply(part, d, out=part)
            part *= 0.1
            s *= 0.99
            s += part
            np.sqrt(s, out=part)
            part += 1e-8 * math.sqrt(high)
            np.divide(m, part, out=part)
            part *= rate / low * math.sqrt(high)
            p[k] -= part


def _softmax_loss(z: np.ndarray, goal: np.ndarray, at: np.ndarray, n: int, with_loss: bool, wide: bool) -> tuple[float, np.ndarray]:
    """The summed loss of rows of scores, if asked for, and its gradient by n in place of them; `wide` scores are taken from the rows' maxima."""
    if wide:
        z -= z.max(axis=1, keepdims=True)
    own = z[at, goal] if with_loss else None
    np.exp(z, out=z)
    sums = z @ np.ones(z.shape[1], z.dtype)
    z *= (1 / (n * sums))[:, None]
    z[at, goal] -= 1 / n
    return float((np.log(sums) - own).sum()) if with_loss else 0.0, z


def _blocks(symbols: list[np.ndarray], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs and targets of sequences one after another in blocks of STEP, a block of padding before each; where each begins, and its blocks."""
    blocks = -(-(sizes + 1) // STEP) + 1
    ends = np.cumsum(blocks) * STEP
    at = ends - blocks * STEP + STEP
    flat, goal = np.zeros(int(ends[-1]) if len(ends) else 0, np.int32), np.zeros(int(ends[-1]) if len(ends) else 0, np.int32)
    if len(symbols):
        place = np.repeat(at - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        goal[place] = np.concatenate(symbols)
        flat[at], flat[place + 1], goal[at + sizes] = 1, goal[place], 2
    return flat, goal, at, blocks


def _halves(a: np.ndarray, blocks: int) -> np.ndarray:
    """A view [n, runs, blocks STEP, width] of a [n, length, width], each run one block after the last."""
    runs = a.shape[1] // STEP - blocks + 1
    return np.lib.stride_tricks.as_strided(a, (len(a), runs, blocks * STEP, a.shape[2]), (a.strides[0], STEP * a.strides[1], *a.strides[1:]), writeable=False)


def _apart(a: np.ndarray, blocks: int = 1) -> np.ndarray:
    """A view [n, parts, blocks STEP, width] of a [n, length, width] that may be written to, as the parts don't overlap."""
    many = blocks * STEP
    return np.lib.stride_tricks.as_strided(a, (len(a), a.shape[1] // many, many, a.shape[2]), (a.strides[0], many * a.strides[1], *a.strides[1:]))


def _scattered(index: np.ndarray, size: int, grads: np.ndarray, wide: int = 16) -> np.ndarray:
    """Sums of gradients by the row of the table that they belong to: products with ones, for `wide` rows of the table at a time."""
    flat = index.ravel()
    order = np.argsort(flat.astype(np.uint16) if size <= 1 << 16 else flat, kind="stable")
    flat, rows = flat[order], grads.reshape(-1, grads.shape[-1])[order]
    ones = np.zeros((len(flat), wide), rows.dtype)
    ones.reshape(-1)[np.arange(len(flat)) * wide + flat % wide] = 1
    table = np.zeros((-(-size // wide) * wide, rows.shape[1]), rows.dtype)
    stops = np.searchsorted(flat, np.arange(0, len(table) + wide, wide)).tolist()
    for k, (a, b) in enumerate(zip(stops[:-1], stops[1:], strict=True)):
        if b > a:
            np.matmul(ones[a:b].T, rows[a:b], out=table[k * wide : (k + 1) * wide])
    return table[:size]


def held_out() -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 10; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0, F.lit(False))


def word_counts(df: DataFrame, most: int = 400_000) -> DataFrame:
    """word (UTF-8) and n over all texts; each partition counts first and lets go of its words beyond `most` at a time."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def given() -> Iterator[pa.RecordBatch]:
            words = list(counts)
            for at in range(0, len(words), 20_000):
                part = words[at : at + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()), pa.array([counts[w] for w in part], pa.int64())], schema=schema)
            counts.clear()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for text in raw_texts(batch.column(0).slice(at, 256)):
                    counts.update(text.lower().split())
                if len(counts) > most:
                    yield from given()
        yield from given()

    return df.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Corpus:
    """What is learnt from the training documents, apart from the model: totals and frequent words."""

    def __init__(self, counts: DataFrame, docs: int, frequent: int):
        sums = counts.agg(F.sum("n"), F.count("*")).first()
        self.total = (sums[0] or 0) + docs
        self.distinct = sums[1] + (docs > 0)
        self.docs = docs
        # The least count that no more than `frequent` words reach, from a histogram of few rows.
        level = F.floor(F.log2("n") * 4).alias("level")
        found = counts.filter(F.length("word") <= LONGEST).groupBy(level).agg(F.count("*").alias("words"), F.sum(F.length("word")).alias("bytes"), F.min("n").alias("least")).orderBy(F.desc("level")).collect()
        self.least, have, size = 1 << 62, 0, 0
        for r in found:
            have, size = have + r["words"], size + r["bytes"]
            if have > frequent or size > 32 * frequent:
                break
            self.least = r["least"]
        rows = counts.filter((F.length("word") <= LONGEST) & (F.col("n") >= self.least)).toArrow()
        self.words, self.counts = rows["word"].to_pylist(), rows["n"].to_numpy()

    def base(self, counts: np.ndarray | int) -> np.ndarray:
        """The base log10 probability of tokens with these counts."""
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.distinct + 1)))


def id_counts(counts: DataFrame, ranks, size: int) -> np.ndarray:
    """Occurrences of every id in the training corpus, from its word counts; each partition adds up its own."""
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, np.int64)
        for batch in batches:
            ids, lengths = speller(ranks.value).words(batch.column(0).to_pylist())
            np.add.at(found, ids, np.repeat(batch.column(1).to_numpy(), lengths))
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(found[at])], schema=schema)

    out = np.zeros(size, np.int64)
    for r in counts.select("word", "n").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return out


_LEXICONS: dict[int, tuple] = {}


def lexicon(shipped, ranks) -> tuple:
    """The frequent words' places, ids and base probabilities, made once a process."""
    key = shipped.id if hasattr(shipped, "id") else id(shipped)
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _, corpus = shipped.value
        ids, lengths = speller(ranks.value).words(corpus.words)
        _LEXICONS[key] = {w: i for i, w in enumerate(corpus.words)}, ids, lengths, np.cumsum(lengths) - lengths, corpus.base(corpus.counts)
    return _LEXICONS[key]


def spelled(df: DataFrame, shipped, ranks, rounds: int) -> DataFrame:
    """A row for every document: its symbols and tokens, what its frequent words and rare ids amount to, and its other words.

    `round` is -1 for held-out documents. `shipped` holds the untrained model and the corpus.
    """
    names = ["row", "doc_id", "held_out", "round", "n_tokens", "n_known", "base", "rare", "symbols", "words", "times"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, corpus = shipped.value
        spell = speller(ranks.value)
        at, ids, lengths, starts, base = lexicon(shipped, ranks)
        end_base = float(corpus.base(corpus.docs))
        for batch in batches:
            for piece in _pieces(batch, 1 << 20):
                words = [t.lower().split() for t in raw_texts(piece.column(4))]
                flat = [w for ws in words for w in ws]
                sizes = np.array([len(ws) for ws in words], np.int64)
                found = np.fromiter(map(at.get, flat, repeat(-1)), np.int64, len(flat))
                # Rare words get places after the frequent ones, for this piece alone.
                cold = np.flatnonzero(found < 0)
                others = [flat[i] for i in cold.tolist()]
                rare_words = list(dict.fromkeys(others))
                new = dict(zip(rare_words, range(len(rare_words)), strict=True))
                more, n_more = spell.words(rare_words)
                found[cold] = len(lengths) + np.fromiter(map(new.__getitem__, others), np.int64, len(others))
                all_ids, all_n = np.concatenate((ids, more)), np.concatenate((lengths, n_more))
                all_starts = np.concatenate((starts, len(ids) + np.cumsum(n_more) - n_more))
                n = all_n[found]
                take = np.repeat(all_starts[found] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                stream = all_ids[take]
                doc_of_word, docs = np.repeat(np.arange(len(words)), sizes), len(words)
                per_doc = np.bincount(doc_of_word, weights=n, minlength=docs).astype(np.int64)
                symbols = model.symbol[stream]
                rare = np.bincount(np.repeat(np.arange(docs), per_doc), weights=np.where(symbols == 3, model.rare[stream], 0.0), minlength=docs)
                hot = found < len(lengths)
                sums = np.bincount(doc_of_word[hot], weights=base[found[hot]], minlength=docs) + end_base
                hits = np.bincount(doc_of_word[hot], minlength=docs) + (corpus.docs > 0)
                # Each document's other words, once each.
                pairs, times = np.unique(doc_of_word[cold] * (len(new) + 1) + found[cold] - len(lengths), return_counts=True)
                of = pairs // (len(new) + 1)
                offsets = pa.array(np.searchsorted(of, np.arange(docs + 1)).astype(np.int32))
                cut = np.concatenate(([0], np.cumsum(per_doc)))
                small = symbols.astype(np.uint16)
                yield pa.RecordBatch.from_arrays([
                    *(piece.column(c) for c in range(4)), pa.array(sizes + 1), pa.array(hits), pa.array(sums), pa.array(rare),
                    pa.array([small[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)], pa.binary()),
                    pa.ListArray.from_arrays(offsets, pa.array([rare_words[i] for i in (pairs % (len(new) + 1)).tolist()], pa.binary())),
                    pa.ListArray.from_arrays(offsets, pa.array(times)),
                ], schema=schema)

    turn = F.when(held_out(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("row"), F.lit(rounds))).cast("int")
    rows = df.select(F.monotonically_increasing_id().alias("row"), "doc_id", held_out().alias("held_out"), "text").select("row", "doc_id", "held_out", turn.alias("round"), "text")
    return rows.mapInArrow(run, "row long, doc_id long, held_out boolean, round int, n_tokens long, n_known long, base double, rare double, symbols binary, words array<binary>, times array<long>")


def learnt(rows: DataFrame, model: Model, windows: int, least: int, rounds: int, batch: int) -> Model:
    """The model with weights trained on all windows of rows (row, round, symbols), of about `windows`; learnt_from tells how many they were."""
    spark = rows.sparkSession
    again = max(1, -(-least // max(1, windows)))
    trainers = max(1, windows // (rounds * PART))
    pieces, model.learnt_from = 16, 0
    schema = pa.schema([("k", pa.int32()), ("n", pa.int64()), ("weights", pa.binary())])

    def added(of: pa.Table) -> pa.Table:
        n = of["n"].to_numpy()
        total = sum(float(m) * np.frombuffer(w.as_py(), np.float32).astype(np.float64) for m, w in zip(n, of["weights"], strict=True))
        return pa.table([of["k"][:1], pa.array([int(n.sum())]), pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary())], schema=schema)

    for turn in range(rounds):
        shipped = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped, turn=turn) -> Iterator[pa.RecordBatch]:
            own = pickle.loads(pickle.dumps(shipped.value))
            adam, seen, held, size = Adam(2.5e-2 * (1 - 0.9 * turn / rounds), turn), 0, [], 0

            def learn() -> None:
                x, y = (np.concatenate(part) for part in zip(*held, strict=True))
                for _ in range(again):
                    own.train(x, y, adam, batch)
                held.clear()

            for arrow in batches:
                for low in range(0, arrow.num_rows, 64):
                    part = arrow.slice(low, 64)
                    symbols = [np.frombuffer(b, np.uint16).astype(np.int32) for b in part.column(0).to_pylist()]
                    held.append(own.runs(symbols))
                    n = sum(len(s) // STEP + 1 for s in symbols)
                    size, seen = size + n, seen + n
                    if size >= PART:
                        learn()
                        size = 0
            if held:
                learn()
            if seen:
                for k, w in enumerate(np.array_split(own.flat(), pieces)):
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([seen]), pa.array([w.tobytes()], pa.binary())], schema=schema)

        mine = rows.filter(F.col("round") == turn).select("symbols").coalesce(trainers)
        found = mine.mapInArrow(run, "k int, n long, weights binary").groupBy("k").applyInArrow(added, "k int, n long, weights binary").collect()
        if found:
            model.learnt_from += found[0]["n"]
            model.put(np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(found, key=lambda r: r["k"])]))
        shipped.destroy()
    return model.ready()


def scored(rows: DataFrame, shipped) -> DataFrame:
    """row, doc_id, held_out, n_tokens, n_known, base and score of rows that have symbols and rare: the model's log10 probability of each text."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            for piece in _pieces(batch, 1 << 19, 7):
                logs = model.log_probs([np.frombuffer(b, np.uint16).astype(np.int32) for b in piece.column(7).to_pylist()])
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in range(6)), pa.array((logs + piece.column(6).to_numpy()) / math.log(10))], schema=schema)

    return rows.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare", "symbols").mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double")


def score(df: DataFrame, spark: SparkSession, heads: int = 2048, least: int = 1 << 17, rounds: int = ROUNDS, batch: int = BATCH, frequent: int = 150_000, vocabulary: str | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of df (doc_id, text)."""
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    learn = df.select("doc_id", "text").filter(~held_out())
    docs = learn.count()
    counts = saved(word_counts(learn), spark, "lm-words")
    corpus = Corpus(counts, docs, frequent)
    ids = id_counts(counts, ranks, speller(ranks.value).size)
    model = Model(ids, docs, heads)
    rows = saved(spelled(df, spark.sparkContext.broadcast((model, corpus)), ranks, rounds), spark, "lm-symbols")
    if docs:
        model = learnt(rows, model, int(ids.sum()) // STEP + docs, least, rounds, batch)
    logs = scored(rows, spark.sparkContext.broadcast(model.ready()))
    others = counts.filter(~((F.length("word") <= LONGEST) & (F.col("n") >= corpus.least))).withColumnRenamed("n", "c")
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / float(corpus.total + 0.1 * (corpus.distinct + 1)))
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("at")).select("row", F.col("at.words").alias("word"), F.col("at.times").alias("times"))
    sums = each.join(others, "word", "left").groupBy("row").agg(F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * log).alias("rest"))
    whole = logs.join(sums, "row", "left")
    known, base = F.col("n_known") + F.coalesce("more", F.lit(0)), F.col("base") + F.coalesce("rest", F.lit(0.0))
    return whole.select("doc_id", "held_out", "n_tokens", known.alias("n_known"), F.lit(corpus.total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def _pieces(batch: pa.RecordBatch, size: int, column: int = 4) -> Iterator[pa.RecordBatch]:
    """Slices of about `size` bytes of text in a column, of one row at least."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > size:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += n
    if batch.num_rows > at:
        yield batch.slice(at)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all whole documents."""
    return score(table(spark, sf_dir, "documents"), spark)
