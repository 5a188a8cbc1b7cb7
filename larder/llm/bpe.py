"""Byte-level BPE by a deterministic automaton over tokens.

Start with one state and one arc per byte from it to itself. Each merge (u, v), in order of rank, is a gadget: arcs u now lead
to a copy of the state that they led to, which lacks the arc v, and wherever an arc u could be taken an arc uv can, to where
v led. After all merges exactly one path spells a word, and its arcs are the tokens that applying the merges by rank gives.

Where an arc leads depends on its token alone (the default transition), and the arcs that a state lacks are those that gadgets
cut in it or in the states it was copied from. Copies make a tree of states, whose descendants lie side by side in its order; a
gadget's cut is one range of bits in the row of token v, and a new token's row begins as a copy of u's. Equal rows and equal
columns of that bit matrix are merged. A word is encoded from left to right: its bytes lead through a trie of tokens, and a
token is an arc where its bit is open in the state that its beginning was reached in. Every prefix of a word has one path, so
each place is reached once and nothing is tried twice.

Decoding emits the arcs' labels: each token's bytes.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: How the public byte-level tokenizers part a text into words before merging (a fixed value of theirs).
PRE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: The same for texts of ASCII alone.
PRE_SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\sA-Za-z0-9]+|\s+(?!\S)|\s+"
#: Words kept with their tokens by a worker before it begins anew.
MEMORY = 1 << 19
#: Bytes of words that are encoded together, at most, and texts of which words are.
LANES, TEXTS = 1 << 17, 512


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that vocabulary files use for bytes: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


#: What a tokenizer's file must say besides its vocabulary for this encoder to give its tokens.
_NEEDED = {
    ("normalizer",): (None,), ("post_processor",): None, ("pre_tokenizer", "type"): ("ByteLevel",), ("pre_tokenizer", "add_prefix_space"): (False,), ("pre_tokenizer", "use_regex"): (True, None),
    ("decoder", "type"): ("ByteLevel",), ("model", "type"): ("BPE", None), ("model", "dropout"): (None, 0, 0.0), ("model", "ignore_merges"): (False, None), ("model", "byte_fallback"): (False, None),
    ("model", "continuing_subword_prefix"): (None, ""), ("model", "end_of_word_suffix"): (None, ""),
}


def load_automaton(path: str) -> Automaton:
    """The automaton of a byte-level BPE file. A file that asks for anything else (a normalizer, a prefix space, whole words before
    merges, added tokens that take white space with them or stand at words' edges alone) is an error, never another result."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    for keys, allowed in _NEEDED.items():
        found = spec
        for key in keys:
            found = found.get(key) if isinstance(found, dict) else None
        if allowed is not None and found not in allowed:
            raise ValueError(f"{'.'.join(keys)} is {found!r}: not a byte-level BPE that this encoder knows")
    to_byte = _byte_of_char()
    ids = spec["model"]["vocab"]
    labels = [b""] * (max([*ids.values(), *(a["id"] for a in spec["added_tokens"])]) + 1)
    for token, i in ids.items():
        labels[i] = bytes(to_byte[c] for c in token)
    special = {}
    for added in spec["added_tokens"]:
        if added.get("single_word") or added.get("lstrip") or added.get("rstrip"):
            raise ValueError(f"added token {added['content']!r} is matched by rules that this encoder lacks")
        special[added["content"]] = added["id"]
        labels[added["id"]] = added["content"].encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
    return Automaton(labels, [(ids[u], ids[v], ids[u + v]) for u, v in merges], special)


class Automaton:
    """target[token]: the state after it; row[token] and bits: bit `state` of row `row[token]` is set where the token can't follow the state.

    base, check: the trie of the tokens; token_at[node]: the token that its bytes spell, if any. State 0 begins a word.
    """

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]) -> None:
        """merges: (u, v, uv) in order of rank."""
        self.labels, self.special = labels, special
        n = len(labels)
        # states in the order of their making: state k + 1 is made by merge k as a copy of parent[k]
        state, parent = [0] * n, []
        for k, (u, v, uv) in enumerate(merges):
            old = state[u]
            parent.append(old)
            state[uv] = state[v]
            state[u] = k + 1
        made_as = {uv for _, _, uv in merges}
        ordinary = {i for i, label in enumerate(labels) if len(label) == 1} | made_as
        ordinary -= set(special.values())
        self._compile(merges, state, parent, ordinary, n)

    def _compile(self, merges: list[tuple[int, int, int]], state: list[int], parent: list[int], ordinary: set[int], n: int) -> None:
        # number the states that tokens still lead to, so that a state's descendants have the numbers lo..hi
        children: list[list[int]] = [[] for _ in range(len(merges) + 1)]
        for k, p in enumerate(parent):
            children[p].append(k + 1)
        kept = {state[t] for t in ordinary} | {0}
        lo, hi, place = [0] * len(children), [0] * len(children), {}
        todo = [(0, False)]
        while todo:
            at, left = todo.pop()
            if left:
                hi[at] = len(place)
                continue
            lo[at] = len(place)
            if at in kept:
                place[at] = len(place)
            todo.append((at, True))
            todo.extend((c, False) for c in children[at])
        cut = np.zeros((n, -(-len(place) // 8)), np.uint8)
        for k, (u, v, uv) in enumerate(merges):
            x, row = place[state[u]], cut[v]
            if row[x >> 3] >> (x & 7) & 1:  # an earlier gadget parts u and v, so that uv is never made
                cut[uv] = 255
                ordinary.discard(uv)
                continue
            a, z = lo[k + 1], hi[k + 1]
            first, last = a >> 3, (z - 1) >> 3
            head, tail = 255 & (255 << (a & 7)), 255 >> (7 - ((z - 1) & 7))
            if first == last:
                row[first] |= head & tail
            else:
                row[first] |= head
                row[first + 1 : last] = 255
                row[last] |= tail
            cut[uv] = cut[u]
        # equal rows and equal columns are one; the start keeps the number 0
        seen: dict[bytes, int] = {}
        row = [seen.setdefault(r.tobytes(), len(seen)) for r in cut]
        rows = np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), -1)
        columns = np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")
        seen = {}
        order = [0] + [i for i in range(len(place)) if i]
        begin = place[0]
        order[0], order[begin] = order[begin], order[0]
        column = {i: seen.setdefault(columns[i].tobytes(), len(seen)) for i in order}
        columns = np.frombuffer(b"".join(seen), np.uint8).reshape(len(seen), -1)[:, :]
        bits = np.packbits(np.unpackbits(columns, axis=1, count=len(rows), bitorder="little").T, axis=1, bitorder="little")
        self.width = bits.shape[1]
        self.bits = bits.ravel()
        self.row = np.array(row, np.int64) * self.width
        self.target = np.array([column[place[state[t]]] if t in ordinary else 0 for t in range(n)], np.int32)
        self.sizes = np.fromiter(map(len, self.labels), np.int64, n)
        self.n_states, self.n_rows = len(seen), len(rows)
        self._make_trie(ordinary)

    def _make_trie(self, ordinary: set[int]) -> None:
        """The trie of the tokens as two arrays: from a node at `x`, a byte leads to x' = base[x] + byte if check[x'] is x."""
        children: list[dict[int, int]] = [{}]
        token_of: list[int] = [-1]
        for t in sorted(ordinary):
            node = 0
            for byte in self.labels[t]:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    token_of.append(-1)
                node = children[node][byte]
            token_of[node] = t
        size = 1 << (3 * len(children) + 512).bit_length()
        base, check, token_at = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        taken, seed = bytearray(size), 0
        taken[0] = 1
        todo = [(0, 0)]
        for node, x in todo:
            token_at[x] = token_of[node]
            if children[node]:
                while True:
                    seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
                    at = seed % (size - 256)
                    if not any(taken[at + byte] for byte in children[node]):
                        break
                base[x] = at
                for byte, child in children[node].items():
                    taken[at + byte] = 1
                    check[at + byte] = x
                    todo.append((child, at + byte))
        self.base, self.check, self.token_at = base, check, token_at

    def encode_words(self, words: list[bytes]) -> list[tuple[int, ...]]:
        """The arcs of the one path that spells each word, none of them empty; words of like length step through the tables together."""
        out: list[tuple[int, ...]] = [()] * len(words)
        length = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(length, kind="stable")
        # about so many bytes at a time
        ends = np.searchsorted(np.cumsum(length[order]), np.arange(1, length.sum() // LANES + 2) * LANES)
        for part in np.split(order, np.unique(np.minimum(ends, len(order)))):
            if len(part):
                for i, ids in zip(part.tolist(), self._encode([words[i] for i in part.tolist()], length[part]), strict=True):
                    out[i] = ids
        return out

    def _encode(self, words: list[bytes], length: np.ndarray) -> list[tuple[int, ...]]:
        most = int(length[-1])
        # a column of zero bytes ends each word; none is read
        text = np.zeros((most + 1, len(words)), np.uint8)
        flat = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum(length) - length
        which = np.repeat(np.arange(len(words)), length)
        text[np.arange(len(flat)) - starts[which], which] = flat
        state, came = np.zeros((most + 1, len(words)), np.int32), np.full((most + 1, len(words)), -1, np.int32)
        for at in range(most):
            lane = np.flatnonzero(length > at)
            if at and (came[at, lane] < 0).any():
                raise ValueError("the vocabulary lacks a byte")
            node, end = np.zeros(len(lane), np.int64), at
            while len(lane):
                step = self.base[node] + text[end, lane]
                on = self.check[step] == node
                lane, node = lane[on], step[on]
                end += 1
                token = self.token_at[node]
                found = np.flatnonzero(token >= 0)
                if len(found):
                    who, token = lane[found], token[found]
                    s = state[at, who]
                    free = (self.bits[self.row[token] + (s >> 3)] >> (s & 7)) & 1 == 0
                    who, token = who[free], token[free]
                    state[end, who], came[end, who] = self.target[token], token
                going = length[lane] > end
                if not going.all():
                    lane, node = lane[going], node[going]
        # back along each path
        lane, at, arcs, owners = np.arange(len(words)), length.copy(), [], []
        while len(lane):
            token = came[at, lane]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks a byte")
            arcs.append(token)
            owners.append(lane)
            at = at - self.sizes[token]
            lane, at = lane[at > 0], at[at > 0]
        paths: list[list[int]] = [[] for _ in words]
        for token, owner in zip(reversed(arcs), reversed(owners), strict=True):
            for i, t in zip(owner.tolist(), token.tolist(), strict=True):
                paths[i].append(t)
        return list(map(tuple, paths))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.labels.__getitem__, ids))


class Encoder:
    """Parts texts at special tokens and into words, and looks up their tokens."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton
        self.words: dict[str, tuple[int, ...]] = {}
        special = automaton.special
        self.parting = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.split, self.split_ascii = regex.compile(PRE_SPLIT), re.compile(PRE_SPLIT_ASCII, re.ASCII)

    def _words(self, text: str) -> list[str]:
        return (self.split_ascii if text.isascii() else self.split).findall(text)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """The tokens of each text. Words met before are looked up; all new words of the texts are encoded together."""
        special = self.automaton.special
        parted = [[(True, x) if k % 2 else (False, self._words(x)) for k, x in enumerate(self.parting.split(t))] if t and any(map(t.__contains__, special)) else [(False, self._words(t or ""))] for t in texts]
        words = self.words
        new = [w for w in set(chain.from_iterable(x for pieces in parted for is_special, x in pieces if not is_special)) if w not in words]
        if len(words) + len(new) > MEMORY:
            words.clear()
            new = list(set(chain.from_iterable(x for pieces in parted for is_special, x in pieces if not is_special)))
        words.update(zip(new, self.automaton.encode_words([w.encode() for w in new]), strict=True))
        return [list(chain.from_iterable((special[x],) if is_special else chain.from_iterable(map(words.__getitem__, x)) for is_special, x in pieces)) for pieces in parted]


_made: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast automaton, kept over batches and tasks with the words that it has met."""
    key = id(shared.value)
    if key not in _made:
        _made.clear()
        _made[key] = Encoder(shared.value)
    return _made[key]


def encode_texts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs its id and `ids`, the tokens of its whole text (array of int); null texts have none.

    tokenizer: path of a byte-level BPE file, read on the driver; its tables, whose size is the vocabulary's, are broadcast.
    Strings of special tokens in a text are these tokens. Repeated rows and ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_automaton(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _encoder(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                part = batch.slice(lo, TEXTS)
                ids = auto.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row its id and `text`, spelled by the labels of its tokens; bytes that are not UTF-8 become U+FFFD; null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_automaton(tokenizer))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _encoder(shared)
        for batch in batches:
            texts = [auto.automaton.decode(x or []).decode("utf-8", "replace") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts)], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def round_trip_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id, number of tokens, and SHA-256 of the tokens (decimal, by commas) and of the text decoded from them.

    Null and empty texts have no tokens: the digests are those of nothing. Strings of special tokens are these tokens and are
    decoded to themselves. Whole texts are encoded, however long. Repeated rows and ids are kept, other columns not read, and an
    empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_automaton(tokenizer))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = _encoder(shared)
        decimal = [str(i) for i in range(len(auto.automaton.labels))].__getitem__
        for batch in batches:
            counts, id_shas, text_shas = [], [], []
            for lo in range(0, batch.num_rows, TEXTS):
                for ids in auto.encode(batch.column(1).slice(lo, TEXTS).to_pylist()):
                    counts.append(len(ids))
                    id_shas.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                    decoded = auto.automaton.decode(ids)
                    text_shas.append(hashlib.sha256(decoded.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(id_shas, pa.string()), pa.array(text_shas, pa.string())], ["id", "n", "a", "b"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"id {kind}, n bigint, a string, b string")
    return out.toDF(id_col, "n_tokens", "ids_sha256", "decoded_sha256")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
