"""BPE encoding and decoding by a tokenization automaton.

The automaton over tokens comes first: a state is the token read last, and a transition exists where two tokens may stand
side by side in a BPE tokenization. It starts from the bare alphabet, where every symbol may follow every other, and one
gadget for each merge (a, b) -> c, in the order of the merges, changes it: it adds the state c, which inherits b's ways out
and a's ways in, and it cuts a from b, as they are merged from that rank on. What a state inherits are its spines: on the
right, the token itself and the right parts that it was made of, each with the rank of the merge that consumed it; on
the left likewise. A transition x -> y is missing exactly if a cut (u, v) of some rank holds for a u of x's right spine
and a v of y's left spine that were both still unconsumed at that rank.

Every prefix of a word has one accepted path, and so one accepted last token. Over letters, the automaton is therefore
made deterministic: a state of the table is the set of tokens that are open after a prefix, each as the token before it
and the letters of it that have been read; its first member is the token that the prefix ends with. A table holds the
next state for state and letter, and the last token for a letter that ends the word. Entries are made when first needed,
for up to `STATES` states, then anew. Words are read in step, one table look-up a letter for all of them at once, and
the tokens are read off backwards from each word's end: nothing is tried twice. Decoding emits the labels of the arcs.

Words are pre-split as the vocabulary file says; plain texts by a pattern, texts with rarer characters by the file's own
normalizer and splitter. Null texts are empty: no ids, and empty decoded text. Texts are encoded whole, however long. Repeated
rows come out as often as they stand; an empty table gives no rows; columns but doc_id and text, whatever their names, are left out.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm.common import arrow_map, table, texts

NEVER = 1 << 60
#: Most states at a time (about 40 MB), and slots of the table of transitions, where a new one overwrites an old one.
STATES, SLOTS = 1 << 16, 1 << 20
#: Slots of the table of token pairs; what stands for no token before; odd factors that mix hashes.
PAIRS, NONE = 1 << 19, 1 << 18
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
#: Words up to this many letters are read in step, longer ones alone.
STEP = 64
#: Characters for which lower-casing and splitting need no tables beyond the pattern's.
RARE = re.compile(r"[^\x20-\x7e\n\t\r\xa1-įı-ɏ]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(extra)
            extra += 1
    return [letters[b] for b in range(256)]


class Automaton:
    """The tokenization automaton of a BPE vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], word_end: str):
        self.word_end = word_end
        self.ids = vocab
        self.labels = {i: t for t, i in vocab.items()}
        self.cuts: dict[str, dict[str, int]] = {}
        self.right: dict[str, tuple[tuple[str, int], ...]] = {}
        self.left: dict[str, tuple[tuple[str, int], ...]] = {}
        self.made: dict[str, tuple[str, str]] = {}
        made = {a + b for a, b in merges}
        for token in vocab:
            if token not in made:
                self.state(token)
        for rank, (a, b) in enumerate(merges):
            self.gadget(a, b, rank)
        #: What arcs may carry: tokens that their own letters make, and no others that the vocabulary lists.
        self.tokens = frozenset(t for t in self.right if self.whole(t))
        self._letters()
        self._restart()

    def state(self, token: str) -> None:
        """A state of the alphabet: nothing consumes it."""
        self.right[token] = self.left[token] = ((token, NEVER),)

    def _letters(self) -> None:
        """The letters of all tokens as a tree of sorted arcs: byte + 256 for a letter that ends a word, as it is no letter within one."""
        at = {x: b for b, x in enumerate(byte_letters())}
        tree: dict[int, int] = {}
        token_at, goes_on = [-1], [True]
        self.sizes = np.zeros(max(self.ids.values()) + 1, np.int64)
        for token in self.tokens:
            ends = token.endswith(self.word_end) and token != self.word_end
            letters = token.removesuffix(self.word_end) if ends else token
            if any(x not in at for x in letters):
                continue  # no byte spells it
            symbols = [at[x] for x in letters]
            symbols[-1] += 256 * ends
            node = 0
            for x in symbols:
                goes_on[node] = True
                below = tree.get(node * 512 + x)
                if below is None:
                    below = tree[node * 512 + x] = len(token_at)
                    token_at.append(-1)
                    goes_on.append(False)
                node = below
            token_at[node] = self.ids[token]
            self.sizes[self.ids[token]] = len(symbols)
        keys = np.fromiter(tree, np.int64, len(tree))
        order = np.argsort(keys)
        self.arc_keys, self.arc_ends = keys[order], np.fromiter(tree.values(), np.int32, len(tree))[order]
        self.token_at, self.goes_on = np.array(token_at, np.int32), np.array(goes_on)
        self.pairs, self.may = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)

    def _restart(self, start: tuple[tuple[int, int], ...] = ((-1, 0),)) -> None:
        """An empty table with one state: at first no token before, no letters read."""
        self.asked, self.goal = np.full(SLOTS, -1, np.int64), np.zeros(SLOTS, np.int32)
        self.last = np.array([start[0][0]], np.int32)
        self.index: dict[tuple[int, int], int] = {}
        # The members of states, one state after another: the token before, and the place in the tree.
        self.before, self.node = np.array([m[0] for m in start], np.int32), np.array([m[1] for m in start], np.int32)
        self.first, self.count = np.zeros(1, np.int64), np.array([len(start)], np.int64)

    def _follow(self, before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        """`follows` for arrays, by a table of pairs that new ones overwrite."""
        key = before.astype(np.int64) << 20 | tokens
        slot = ((key.astype(np.uint64) * MIX[0]) >> np.uint64(64 - PAIRS.bit_length() + 1)).astype(np.int64)
        new = self.pairs[slot] != key
        out = self.may[slot]
        if new.any():
            some, back = np.unique(key[new], return_inverse=True)
            found = np.array([x >> 20 == NONE or self.follows(self.labels[x >> 20], self.labels[x & 0xFFFFF]) for x in some.tolist()])
            out[new] = found[back]
            self.pairs[slot[new]], self.may[slot[new]] = key[new], found[back]
        return out

    def accepted(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, ...]:
        """One more letter for each state: which of them (owner), the token accepted and the members that stay open, flat."""
        n = self.count[states]
        owner = np.repeat(np.arange(len(states)), n)
        at = np.repeat(self.first[states] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = self.node[at].astype(np.int64) * 512 + symbols[owner]
        place = np.minimum(np.searchsorted(self.arc_keys, key), len(self.arc_keys) - 1)
        ok = self.arc_keys[place] == key
        owner, before, node = owner[ok], self.before[at[ok]], self.arc_ends[place[ok]]
        token = self.token_at[node]
        ends = np.flatnonzero(token >= 0)
        ends = ends[self._follow(np.where(before[ends] < 0, NONE, before[ends]), token[ends])]
        return owner[ends], token[ends], owner, before, node

    def _one(self, owner: np.ndarray, token: np.ndarray, n: int) -> np.ndarray:
        """The accepted token of each of n states."""
        out = np.full(n, -1, np.int32)
        out[owner] = token
        if (out < 0).any():
            raise ValueError("a letter that the vocabulary doesn't spell")
        return out

    def _fill(self, states: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The states that letters within words lead to."""
        ends, token, owner, before, node = self.accepted(states, letters)
        last = self._one(ends, token, len(states))
        on = self.goes_on[node]
        owner, before, node = (np.concatenate(x) for x in ((np.arange(len(states)), owner[on]), (last, before[on]), (np.zeros(len(states), np.int32), node[on])))
        order = np.argsort(owner, kind="stable")  # the accepted token comes first
        owner, before, node = owner[order], before[order], node[order]
        n = np.bincount(owner, minlength=len(states))
        first = np.cumsum(n) - n
        # States are alike if their members are, which 128 bits of hashes tell.
        key = ((before + 1).astype(np.uint64) << np.uint64(32)) | node.astype(np.uint64)
        marks = []
        for by in MIX:
            x = (key + by) * by
            x = (x ^ (x >> np.uint64(31))) * MIX[0]
            marks.append(np.add.reduceat(x ^ (x >> np.uint64(29)), first).tolist())
        new, to, size = [], [], len(self.last)
        for k, mark in enumerate(zip(*marks, strict=True)):
            found = self.index.get(mark)
            if found is None:
                found = self.index[mark] = size + len(new)
                new.append(k)
            to.append(found)
        if new:
            k = np.array(new)
            take = np.repeat(first[k] - (np.cumsum(n[k]) - n[k]), n[k]) + np.arange(int(n[k].sum()))
            self.first = np.concatenate((self.first, len(self.before) + np.cumsum(n[k]) - n[k]))
            self.count = np.concatenate((self.count, n[k]))
            self.before, self.node = np.concatenate((self.before, before[take])), np.concatenate((self.node, node[take]))
            self.last = np.concatenate((self.last, last[k]))
        return np.array(to, np.int32)

    def _look(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """One look-up for each word: the next state, or the last token where the symbol ends the word. Missing entries are filled."""
        key = states * 512 + symbols
        slot = ((key.astype(np.uint64) * MIX[0]) >> np.uint64(64 - SLOTS.bit_length() + 1)).astype(np.int64)
        out, new = self.goal[slot], self.asked[slot] != key
        if new.any():
            some, back = np.unique(key[new], return_inverse=True)
            found = self._one(*self.accepted(some >> 9, some & 511)[:2], len(some)) if some[0] & 256 else self._fill(some >> 9, some & 511)
            out[new] = found[back]
            self.asked[slot[new]], self.goal[slot[new]] = key[new], found[back]
        return out

    def paths(self, words: list[bytes]) -> list[list[int]]:
        """The ids of every word, none of them empty."""
        out: list[list[int]] = [[]] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        short = np.argsort(-sizes, kind="stable")
        short = short[sizes[short] <= STEP]
        for low in range(0, len(short), 1024):
            if len(self.last) > STATES:
                self._restart()
            part = short[low : low + 1024]
            for k, ids in zip(part.tolist(), self._in_step([words[k] for k in part.tolist()], sizes[part]), strict=True):
                out[k] = ids
        for k in np.flatnonzero(sizes > STEP).tolist():
            out[k] = self._alone(words[k])
        return out

    def _in_step(self, words: list[bytes], sizes: np.ndarray) -> list[list[int]]:
        """Words of falling length, one letter of all of them at a time."""
        n, most = len(words), int(sizes[0])
        rows = np.repeat(np.arange(n), sizes)
        letters = np.zeros((n, most), np.int64)
        letters[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.frombuffer(b"".join(words), np.uint8)
        last, states = np.zeros((n, most), np.int32), np.zeros(n, np.int64)
        for at in range(most):
            within, ending = (int(x) for x in np.searchsorted(-sizes, (-(at + 1), -at)))
            if ending > within:
                last[within:ending, at] = self._look(states[within:ending], letters[within:ending, at] + 256)
            if within:
                states = self._look(states[:within], letters[:within, at]).astype(np.int64)
                last[:within, at] = self.last[states]
        # Backwards: the last token, then the one that its first letter's prefix ends with, and so on.
        left, rows, steps = sizes.copy(), np.arange(n), []
        while len(rows):
            tokens = last[rows, left[rows] - 1]
            steps.append((rows, tokens))
            left[rows] -= self.sizes[tokens]
            rows = rows[left[rows] > 0]
        out: list[list[int]] = [[] for _ in words]
        for rows, tokens in reversed(steps):
            for k, token in zip(rows.tolist(), tokens.tolist(), strict=True):
                out[k].append(token)
        return out

    def _alone(self, word: bytes) -> list[int]:
        state, last, one = np.zeros(1, np.int64), [], lambda byte: np.array([byte], np.int64)
        for byte in word[:-1]:
            if len(self.last) > STATES:  # the state goes on in a new table, and the start is none of its states
                at = int(state[0])
                members = slice(int(self.first[at]), int(self.first[at] + self.count[at]))
                self._restart(tuple(zip(self.before[members].tolist(), self.node[members].tolist(), strict=True)))
                state = np.zeros(1, np.int64)
            state = self._look(state, one(byte)).astype(np.int64)
            last.append(int(self.last[state[0]]))
        last.append(int(self._look(state, one(word[-1] + 256))[0]))
        if self.last[0] >= 0:
            self._restart()
        out, at = [], len(word)
        while at:
            out.append(last[at - 1])
            at -= int(self.sizes[last[at - 1]])
        return out[::-1]

    def gadget(self, a: str, b: str, rank: int) -> None:
        """One merge: cuts b from a, and adds their union's state with what it inherits."""
        whole = a + b
        self.cuts.setdefault(a, {}).setdefault(b, rank)
        if whole in self.right:
            return
        self.made[whole] = a, b
        self.right[whole] = ((whole, NEVER), (b, rank), *self.right[b][1:])
        self.left[whole] = ((whole, NEVER), (a, rank), *self.left[a][1:])

    def follows(self, x: str, y: str) -> bool:
        """Whether there is a transition from state x by token y; of overlapping equal merges the leftmost goes first."""
        left = self.left[y]
        for u, consumed in self.right[x]:
            cut = self.cuts.get(u)
            if cut and any((rank := cut.get(v)) is not None and rank < consumed and rank <= gone for v, gone in left):
                return False
        return True

    def whole(self, token: str) -> bool:
        """Whether a token's own letters make it: every part of it that a merge made must have come about that way."""
        made = self.made.get(token)
        return made is None or (self.whole(made[0]) and self.whole(made[1]) and self.joins(made))

    def joins(self, parts: tuple[str, str]) -> bool:
        """Whether the two parts of a merge stay apart until that merge: no earlier cut holds between their spines."""
        a, b = parts
        rank = self.cuts[a][b]
        for u, consumed in self.right[a]:
            cut = self.cuts.get(u)
            if cut and any((r := cut.get(v)) is not None and r < rank and r < consumed and r <= gone for v, gone in self.left[b]):
                return False
        return True


class Tokenizer:
    """A vocabulary file's tokenizer around the automaton, with a bounded memory of words."""

    def __init__(self, file: str, remember: int = 200_000):
        spec = json.loads(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.file, self.rare = file, None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.bytes = {x: b for b, x in enumerate(byte_letters())}
        #: Pieces of text: their ids, a tab, and the labels that these decode to.
        self.known: dict[str, str] = {}
        self.remember = remember

    def _words(self, piece: str) -> list[bytes]:
        """The words of a piece between blanks, or of a word that the file's own splitter has spelled in byte letters."""
        if piece[0] == "\0" and len(piece) > 1:
            return [bytes(map(self.bytes.__getitem__, piece[1:]))]
        return [w.encode() for w in self.split.findall(piece)]

    def _pieces(self, text: str) -> list[str]:
        """What a text is looked up by: pieces between blanks, which the pattern never crosses, and marks."""
        found: list[str] = []
        for part in self.marks.split(text) if self.marks and "<|" in text else (text,):
            if part in self.special:
                found.append("\0\0" + part)
            elif not RARE.search(part):
                found += part.lower().split()
            elif part:
                if self.rare is None:
                    import tokenizers

                    self.rare = tokenizers.Tokenizer.from_str(self.file)
                found += ["\0" + w for w, _ in self.rare.pre_tokenizer.pre_tokenize_str(self.rare.normalizer.normalize_str(part)) if w]
        return found

    def _learn(self, pieces: list[str]) -> dict[str, str]:
        """What new pieces are encoded as."""
        auto, out = self.automaton, {}
        each = [() if p.startswith("\0\0") else self._words(p) for p in pieces]
        words = list(dict.fromkeys(w for ws in each for w in ws))
        paths = dict(zip(words, auto.paths(words), strict=True))
        for piece, ws in zip(pieces, each, strict=True):
            if not ws:
                out[piece] = f"{self.special[piece[2:]]}\t{piece[2:]}"
                continue
            ids = [i for w in ws for i in paths[w]]
            out[piece] = " ".join(map(str, ids)) + "\t" + " ".join([auto.labels[i] for i in ids])
        return out

    def encode_all(self, some: list[str]) -> list[tuple[str, str]]:
        """Each text's ids, and the text that they decode to, each joined by one space."""
        pieces = [self._pieces(t) for t in some]
        found = [list(map(self.known.get, ps)) for ps in pieces]
        new = self._learn(list(dict.fromkeys(p for ps, fs in zip(pieces, found, strict=True) if None in fs for p, f in zip(ps, fs, strict=True) if f is None)))
        out = []
        for ps, fs in zip(pieces, found, strict=True):
            if None in fs:
                fs = [new[p] if f is None else f for p, f in zip(ps, fs, strict=True)]
            each = "\t".join(fs).split("\t")  # labels hold no tab: it has a letter of its own
            out.append((" ".join(each[::2]), " ".join(each[1::2])))
        for piece, f in new.items():
            if len(self.known) >= self.remember:
                break
            if len(piece) < 64:  # the frequent ones come first
                self.known[piece] = f
        return out

    def encode(self, text: str) -> tuple[str, str]:
        """One text's ids and what they decode to."""
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> str:
        """The labels of ids."""
        names = {i: t for t, i in self.special.items()}
        return " ".join(self.automaton.labels.get(i) or names[i] for i in ids)


_TOKENIZERS: dict[str, Tokenizer] = {}


def tokenizer(file: str) -> Tokenizer:
    """One compiled automaton a process."""
    key = hashlib.sha256(file.encode()).hexdigest()
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = Tokenizer(file)
    return _TOKENIZERS[key]


def by_size(some: list[str], size: int = 1 << 17) -> Iterator[list[str]]:
    """Lists of whole texts of about `size` characters, so that one step's words stay few."""
    held, n = [], 0
    for text in some:
        if held and n + len(text) > size:
            yield held
            held, n = [], 0
        held.append(text)
        n += len(text)
    if held:
        yield held


def forget_tables() -> None:
    """Lets this process's tables go, for stages that follow in the same workers."""
    _TOKENIZERS.clear()


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str | None = None, with_ids: bool = False, keep_tables: bool = True) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text for every row of df (doc_id, text); with_ids adds `ids`.

    The driver reads the vocabulary file (1.7 MB) and broadcasts it; each worker compiles it once, or once a partition without
    keep_tables, which leaves the worker's memory to whatever runs in it next.
    """
    with open(path or vocabulary(), encoding="utf-8") as f:
        file = df.sparkSession.sparkContext.broadcast(f.read())
    schema = "doc_id long,n_tokens long,ids_sha256 string,decoded_sha256 string"

    def each(part: dict) -> dict:
        tool = tokenizer(file.value)
        out = {k: [] for k in ("n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else []))}
        for few in by_size(texts(part["text"])):
            for ids, decoded in tool.encode_all(few):
                out["n_tokens"].append(ids.count(" ") + 1 if ids else 0)
                out["ids_sha256"].append(hashlib.sha256(ids.encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_ids:
                    out["ids"].append(np.array(ids.split(), np.int32))
        return {"doc_id": part["doc_id"]} | out

    return arrow_map(df.select("doc_id", "text"), each, schema + (",ids array<int>" if with_ids else ""), rows=64, after=None if keep_tables else forget_tables)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every whole text of documents."""
    return encode(table(spark, sf_dir, "documents"))
