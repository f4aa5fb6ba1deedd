"""Token counts by the whole-token shortcut.

Offline, once on the driver, every string of the vocabulary is tried: it is
*proved* a whole token if the pre-tokenizer leaves it in one piece and the
merges take it to exactly one token.  The proved strings (a part of the
vocabulary, so a fixed size) go to the tasks in a broadcast variable.  In a
task a pre-token found there counts one without any merging; only the rest is
merged, and the count of a merged pre-token is remembered in a bounded table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relmon.llm import bpe
from relmon.llm.common import whole_text

LIMIT = 1024
REMEMBERED = 1 << 19      # merged pre-tokens a task remembers: some 90 MB
# Fixed value: the pre-tokenizer's expression, with its own white space spelt out.
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+|" + rf" ?[^{bpe.SPACE}\p{{L}}\p{{N}}]+|"
           + rf"[{bpe.SPACE}]+(?![^{bpe.SPACE}])|[{bpe.SPACE}]+")


def prove(path: str) -> dict:
    """What a task needs: proved whole tokens, merge ranks, added tokens."""
    f = bpe.load(path)
    chars = bpe.byte_chars()
    plain = lambda s: "".join(map(chars.__getitem__, s))
    ranks = {(plain(a), plain(b)): r for r, (a, b) in reversed([*enumerate(f["merges"])])}
    pre = regex.compile(PATTERN)
    whole = set()
    for token in f["vocab"]:
        if token in f["added"]:
            continue
        piece = plain(token)
        try:
            text = piece.encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:      # part of a character: never a whole pre-token
            continue
        if pre.findall(text) == [text] and bpe.merge(list(piece), ranks) == [piece]:
            whole.add(text)
    return {"whole": whole, "ranks": ranks, "added": f["added"], "path": path}


class Counter(dict):
    """Tokens of a pre-token: 1 for proved strings, else merged and remembered."""

    def __init__(self, proved: dict):
        super().__init__(dict.fromkeys(proved["whole"], 1))
        self.proved, self.fixed = proved, len(proved["whole"])
        self.pre = regex.compile(PATTERN)
        self.cut = bpe.splitter(proved["added"])
        self.own = None

    def __missing__(self, piece: str) -> int:
        n = len(bpe.merge(list(piece.encode().decode("latin-1")), self.proved["ranks"]))
        if len(self) >= self.fixed + REMEMBERED:
            for k in [*self][self.fixed:]:
                del self[k]
        if len(piece) <= 64:
            self[piece] = n
        return n

    def pieces(self, text: str) -> list[str]:
        if text.isascii() or bpe.COMMON.fullmatch(text):
            return self.pre.findall(text)
        if self.own is None:
            from tokenizers import Tokenizer
            self.own = Tokenizer.from_file(self.proved["path"]).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.own.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        n = 0
        for i, part in enumerate(self.cut(text)):
            n += i & 1 or sum(map(self.__getitem__, self.pieces(part)))
        return n


def count_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 limit: int = LIMIT) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    Null and empty texts have 0 bytes and 0 tokens; a null doc_id stays null;
    repeated rows give repeated results; other columns are not read.  Texts of
    any length are counted whole.  ``path``: a byte-level BPE file that every
    node can read (part of the installed tokenizer package).
    """
    proved = docs.sparkSession.sparkContext.broadcast(prove(path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(proved.value)
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())],
                                             names=["doc_id", "n_bytes", "n_tokens"])

    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("t"))
    return (rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
                .withColumn("over_limit", F.col("n_tokens") > limit))
