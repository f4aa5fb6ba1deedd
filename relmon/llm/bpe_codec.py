"""BPE encoding by backtracking, and decoding by an offset table.

Encoding a word: an Aho-Corasick automaton over the vocabulary reads the word
once and gives the longest token that starts at each position.  The encoder
takes it if it is compatible with the token before (the merges of both
together give the two tokens again), else the next shorter token that is a
prefix, else it steps back; positions found to be dead ends are not tried
again, so the work is linear in the word.  The result is exactly that of the
merges.  The pair-compatibility table is filled as pairs occur.

A word is a string over 512 symbols: the 256 bytes, and the 256 bytes that
end a word.  Decoding slices one string that holds all tokens' texts at the
offsets of a table.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmon.llm import bpe
from relmon.llm.common import whole_text

REMEMBERED = 1 << 19      # words a task remembers: some 150 MB
# Fixed value: the pre-tokenizer's expression, with its own white space spelt out.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|" + rf"[^{bpe.SPACE}\p{{L}}\p{{N}}]+")


class Codec:
    """Encoder and decoder of one word-level BPE file."""

    def __init__(self, path: str):
        f = bpe.load(path)
        self.path, self.added = path, f["added"]
        chars, end = bpe.byte_chars(), f["suffix"]

        def symbols(token: str) -> str:
            ends = bool(end) and token.endswith(end)
            s = "".join(map(chars.__getitem__, token.removesuffix(end) if ends else token))
            return s[:-1] + chr(ord(s[-1]) + 256) if ends else s

        self.ranks = {(symbols(a), symbols(b)): r for r, (a, b) in reversed([*enumerate(f["merges"])])}
        ids = {symbols(t): i for t, i in f["vocab"].items() if t not in self.added}
        self.text = [""] * (1 + max(ids.values()))
        self.automaton = ahocorasick.Automaton()
        for s, i in ids.items():
            # a string that the merges don't take to one token never occurs
            if bpe.merge(list(s), self.ranks) == [s]:
                self.text[i] = s
                self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.sizes = [len(s) for s in self.text]
        # the longest shorter token that begins a token, or -1
        self.shorter = [-1] * len(self.text)
        for i, s in enumerate(self.text):
            self.shorter[i] = next((ids[s[:k]] for k in range(len(s) - 1, 0, -1)
                                    if self.text[ids.get(s[:k], i)] == s[:k]), -1)
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        self.pre = regex.compile(PATTERN)
        self.cut = bpe.splitter(self.added)
        self.own = None
        # decoding: token i is blob[offsets[i]:offsets[i + 1]]
        names = {i: t for t, i in [*f["vocab"].items(), *self.added.items()]}
        strings = [names.get(i, "") for i in range(1 + max(names))]
        self.blob = "".join(strings)
        self.offsets = np.cumsum([0, *map(len, strings)]).tolist()

    def compatible(self, left: int, right: int) -> bool:
        key = left * len(self.text) + right
        ok = self.pairs.get(key)
        if ok is None:
            a, b = self.text[left], self.text[right]
            ok = bpe.merge(list(a + b), self.ranks) == [a, b]
            if len(self.pairs) >= 2 * REMEMBERED:
                self.pairs.clear()
            self.pairs[key] = ok
        return ok

    def encode_symbols(self, word: str) -> list[int]:
        """Ids of a word over the 512 symbols."""
        n = len(word)
        if (i := self.automaton.get(word, -1)) >= 0:
            return [i]
        longest, sizes = [-1] * n, self.sizes
        for end, i in self.automaton.iter(word):
            longest[end - sizes[i] + 1] = i     # a later end is a longer token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token, size, pairs, base = 0, longest[0], sizes, self.pairs, len(self.text)
        while at < n:
            end = at + size[token]
            if not dead[end] and (not out or pairs.get(out[-1] * base + token)
                                  or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif self.shorter[token] >= 0:
                token = self.shorter[token]
            else:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
        return out

    def encode_word(self, word: str) -> tuple[int, ...]:
        ids = self.words.get(word)
        if ids is None:
            s = word.encode().decode("latin-1")
            ids = tuple(self.encode_symbols(s[:-1] + chr(ord(s[-1]) + 256)))
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            if len(word) <= 64:
                self.words[word] = ids
        return ids

    def split(self, text: str) -> list[str]:
        """Normalised pre-tokens of a text without added tokens."""
        if text.isascii():
            return self.pre.findall(text.lower())
        if bpe.COMMON.fullmatch(text):
            return self.pre.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        if self.own is None:
            from tokenizers import Tokenizer
            self.own = Tokenizer.from_file(self.path)
        norm = self.own.normalizer.normalize_str(text)
        return [norm[a:b] for _, (a, b) in self.own.pre_tokenizer.pre_tokenize_str(norm)]

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for i, part in enumerate(self.cut(text)):
            if i & 1:
                ids.append(self.added[part])
            else:
                for w in self.split(part):
                    ids.extend(self.encode_word(w))
        return ids

    def decode(self, ids: list[int]) -> str:
        blob, at = self.blob, self.offsets
        return " ".join([blob[at[i]:at[i + 1]] for i in ids])


_CODECS: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec for each file and worker process."""
    if path not in _CODECS:
        _CODECS[path] = Codec(path)
    return _CODECS[path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, token_ids (array of int) of every row.  A null or empty text has
    no ids; texts of any length are encoded whole; repeated rows give repeated
    results; other columns are not read."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            ids = pa.array([c.encode(t.as_py()) for t in b.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["doc_id", "token_ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, token_ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "token_ids") -> DataFrame:
    """doc_id, text: the decoded text of a column of ids (null ids: empty text)."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            texts = pa.array([c.decode(t.as_py() or []) for t in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), ids_col).mapInArrow(run, f"doc_id {kind}, text string")


def codec_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256 and decoded_sha256 of
    a full encode and decode.  Ids and decoded texts never leave the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        digits = [str(i) for i in range(len(c.offsets) - 1)]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            n, enc, dec = [], [], []
            for t in b.column(1):
                ids = c.encode(t.as_py())
                n.append(len(ids))
                enc.append(sha(" ".join(map(digits.__getitem__, ids))))
                dec.append(sha(c.decode(ids)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(enc), pa.array(dec)],
                                             names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
