"""Byte-pair merging and tokenizer files, for the operators that count, encode
and decode tokens.  Vocabularies are read from the files of public tokenizers
at a path given by the caller; nothing is trained or copied here."""

from __future__ import annotations

import heapq
import json

import regex

# White space as the tokenizers' regular expressions see it.
SPACE = r"\t-\r\x20\x85\xa0  -     　"
# Code points whose class and case are the same in every Unicode version in
# use.  A text with any other code point is split by the tokenizer file's own
# normalizer and pre-tokenizer instead of the expressions below.
COMMON = regex.compile(
    "[\\x00-\\u0377\\u0384-\\u038a\\u038e-\\u03a1\\u03a3-\\u052f\\u1e00-\\u1eff\\u2000-\\u2064\\u20a0-\\u20bf"
    "\\u2190-\\u21ff\\u3000-\\u303f\\u3041-\\u3096\\u30a0-\\u30ff\\u4e00-\\u9fef\\uac00-\\ud7a3"
    "\\U0001f300-\\U0001f5ff]*")


def byte_chars() -> dict[str, str]:
    """The printable character that stands for each byte in byte-level
    vocabularies, mapped to the Latin-1 character of that byte: printable
    Latin-1 stands for itself, the others are numbered from 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): chr(b) for b in own}
    for n, b in enumerate(b for b in range(256) if b not in set(own)):
        out[chr(256 + n)] = chr(b)
    return out


def load(path: str) -> dict:
    """The parts of a tokenizer file that the operators need."""
    with open(path, encoding="utf-8") as f:
        j = json.load(f)
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in j["model"]["merges"]]
    return {"vocab": j["model"]["vocab"], "merges": merges,
            "added": {a["content"]: a["id"] for a in j["added_tokens"]},
            "suffix": j["model"].get("end_of_word_suffix") or ""}


NEVER = 1 << 60
SHORT = 64


def merge(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Byte-pair merges: the lowest rank first, the leftmost of equal ranks.
    ``parts`` is used up."""
    if len(parts) > SHORT:
        return _merge_long(parts, ranks)
    get = ranks.get
    rank = [get(p, NEVER) for p in zip(parts, parts[1:])]
    while rank:
        low = min(rank)
        if low == NEVER:
            break
        i = rank.index(low)
        parts[i] += parts.pop(i + 1)
        del rank[i]
        if i < len(rank):
            rank[i] = get((parts[i], parts[i + 1]), NEVER)
        if i:
            rank[i - 1] = get((parts[i - 1], parts[i]), NEVER)
    return parts


def _merge_long(parts: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """The same with a heap over a linked list: n log n for a piece of any length."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:]))
            if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if parts[i] != a or j >= n or parts[j] != b:
            continue
        parts[i], parts[j] = a + b, ""
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (r := ranks.get((parts[i], parts[k]))) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[k]))
        if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
            heapq.heappush(heap, (r, h, parts[h], parts[i]))
    return [p for p in parts if p]


def splitter(added: dict[str, int]):
    """Cuts a text at the added tokens; odd pieces of the result are tokens."""
    if not added:
        return lambda text: [text]
    at = regex.compile("(" + "|".join(regex.escape(a) for a in sorted(added, key=len, reverse=True)) + ")")
    marks = list(added)
    return lambda text: at.split(text) if any(m in text for m in marks) else [text]
