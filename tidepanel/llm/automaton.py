"""Byte-pair encoding by a compiled automaton.

The merges of a public tokenizer are compiled, in their order, into one
deterministic automaton over tokens that accepts exactly the token sequences the
tokenizer gives. It starts as one state with a loop per byte. The gadget of merge
(u, v) -> w splits the state behind u: the copy that u now leads to lacks the arc
v, and every state with an arc u gets an arc w that leads where v leads. All arcs
of a token share their target, and each gadget adds one state, held as the
difference from the state it was split from; so 50,000 merges compile to tables of
as many entries, and an arc is looked up by walking at most a few of them.

A word is encoded by running the automaton along its bytes: each position is
reached by exactly one accepted token sequence, as the automaton is deterministic,
so one token and one state per position suffice and time is linear in the length.
Decoding writes out the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files of the public tokenizers lie.
TOKENIZERS = "/opt/tokenizers"
#: Words remembered by an encoder, and arcs by its automaton, before they start afresh.
REMEMBERED, KNOWN_ARCS = 200_000, 1_000_000
#: Bytes of a vocabulary file that may be sent to the tasks.
VOCABULARY_BYTES = 64 << 20
#: Fixed value: the pre-splitting pattern of byte-level BPE (published with the vocabulary).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of a list of merges; tokens are labelled by their ids."""

    def __init__(self, base: dict[int, int], merges: list[tuple[int, int, int]]) -> None:
        """``base``: byte to token; ``merges``: (left, right, merged token), best first."""
        self.bytes_of: dict[int, bytes] = {t: bytes([b]) for b, t in base.items()}
        self.left: dict[int, int] = {}
        self.born: dict[int, int] = dict.fromkeys(base.values(), 0)
        self.after: dict[int, int] = dict.fromkeys(base.values(), 0)
        self.origin, self.without, self.state_born = [0], [-1], [0]
        self._arcs: dict[int, bool] = {}
        for k, (u, v, w) in enumerate(merges, start=1):
            self._gadget(k, u, v, w)
        self._arcs.clear()
        self.trie: dict[int, int] = {}
        self.ends: list[int] = [-1]
        for token, text in self.bytes_of.items():
            if token not in self.after:
                continue  # no arc carries it
            node = 0
            for b in text:
                if (step := self.trie.get(node << 8 | b)) is None:
                    step = self.trie[node << 8 | b] = len(self.ends)
                    self.ends.append(-1)
                node = step
            self.ends[node] = token

    def _gadget(self, k: int, u: int, v: int, w: int) -> None:
        if w in self.bytes_of:
            raise ValueError(f"two merges give token {w}")
        self.bytes_of[w] = self.bytes_of[u] + self.bytes_of[v]
        if u not in self.after or v not in self.after or not self.arc(self.after[u], v):
            return  # u and v never meet: the merge can't fire
        behind, target = self.after[u], self.after[v]
        self.origin.append(behind)
        self.without.append(v)
        self.state_born.append(k)
        self.after[u] = len(self.origin) - 1
        self.left[w], self.born[w], self.after[w] = u, k, target

    def arc(self, state: int, token: int) -> bool:
        """Whether ``state`` has an arc labelled ``token``."""
        key = state << 20 | token
        if (known := self._arcs.get(key)) is not None:
            return known
        s, t, there = state, token, True
        while s or t in self.left:
            if self.state_born[s] > self.born[t]:
                if self.without[s] == t:
                    there = False
                    break
                s = self.origin[s]
            else:
                t = self.left[t]
        if len(self._arcs) >= KNOWN_ARCS:
            self._arcs.clear()
        self._arcs[key] = there
        return there

    def encode(self, word: bytes) -> list[int]:
        """The tokens of ``word``; empty for an empty one."""
        n = len(word)
        token, state = [-1] * (n + 1), [0] * (n + 1)
        trie, ends, after, arc = self.trie, self.ends, self.after, self.arc
        for i in range(n):
            here, node = state[i], 0
            for j in range(i, n):
                node = trie.get(node << 8 | word[j], -1)
                if node < 0:
                    break
                t = ends[node]
                if t >= 0 and token[j + 1] < 0 and arc(here, t):
                    token[j + 1], state[j + 1] = t, after[t]
        out = []
        while n:
            out.append(token[n])
            n -= len(self.bytes_of[token[n]])
        return out[::-1]

    def decode(self, tokens: list[int]) -> bytes:
        """The bytes of ``tokens``: the labels of the arcs, in order."""
        return b"".join([self.bytes_of[t] for t in tokens])


class Encoder:
    """A public byte-level tokenizer: pre-splitting, automaton and remembered words.

    Beside the tables of the automaton (some 60 MB for 50,000 merges) it holds at most
    KNOWN_ARCS arcs and REMEMBERED words of up to 64 characters, together below 250 MB.
    """

    _loaded: dict[str, Encoder] = {}

    def __init__(self, vocabulary_file: str) -> None:
        """``vocabulary_file``: the text of the tokenizer's file."""
        model = json.loads(vocabulary_file)["model"]
        symbols, vocabulary = byte_symbols(), model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.automaton = MergeAutomaton({b: vocabulary[c] for c, b in symbols.items()}, [(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs])
        self.words = regex.compile(WORDS)
        self.seen: dict[str, list[int]] = {}

    @classmethod
    def of(cls, name: str, vocabulary_file: str) -> Encoder:
        """The encoder of a file, compiled once per process and ``name`` (a digest of it)."""
        if name not in cls._loaded:
            cls._loaded[name] = cls(vocabulary_file)
        return cls._loaded[name]

    @classmethod
    def load(cls, path: str) -> Encoder:
        """The encoder of the file at ``path``."""
        return cls.of(*vocabulary_text(path))

    def encode(self, text: str | None) -> list[int]:
        """The ids of ``text``; none for an empty and for a null text. Special tokens' names are ordinary text."""
        out: list[int] = []
        seen = self.seen
        for word in self.words.findall(text or ""):
            ids = seen.get(word)
            if ids is None:
                ids = self.automaton.encode(word.encode("utf-8"))
                if len(word) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[word] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return self.automaton.decode(ids).decode("utf-8", "replace")


def vocabulary_text(path: str) -> tuple[str, str]:
    """(digest, text) of a vocabulary file."""
    with open(path, encoding="utf-8") as f:
        text = f.read(VOCABULARY_BYTES + 1)
    if len(text) > VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {VOCABULARY_BYTES} characters")
    return hashlib.sha256(text.encode("utf-8")).hexdigest(), text


def tokenizer_path(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    return f"{folder}/{name}.json"


def encode_corpus(documents: DataFrame, *, key: Column, text: Column, path: str | None = None, count_only: bool = False, group: Column | None = None) -> DataFrame:
    """(key, group, ids) of every document, or (key, group, n_tokens) with ``count_only``.

    ``group`` is a string that comes along (default null).

    The vocabulary file is read by the driver only and sent to the tasks. Each text
    is encoded whole, in one pass without shuffle. Null and empty texts
    give an empty list (0 tokens). Repeated rows are kept; other columns ignored.
    """
    sent = documents.sparkSession.sparkContext.broadcast(vocabulary_text(path or tokenizer_path()))
    rows = documents.select(key.cast("long").alias("key"), (F.lit(None) if group is None else group).cast("string").alias("group"), text.cast("string").alias("text"))
    kind = pa.int64() if count_only else pa.list_(pa.int32())
    name = "n_tokens" if count_only else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(*sent.value)
        for batch in batches:
            # small slices bound what a batch of long texts needs in memory
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                coded = (encoder.encode(x) for x in part.column(2).to_pylist())
                values = [len(x) for x in coded] if count_only else list(coded)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(values, kind)], names=["key", "group", name])

    return rows.mapInArrow(run, f"key long, group string, {name} {'long' if count_only else 'array<int>'}")
