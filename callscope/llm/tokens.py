"""Exact, fast use of public tokenizer files inside tasks.

Text is mostly made of words seen before.  A worker process therefore keeps
bounded tables from words to their result and asks for the rest only.  The
short cut holds for *plain* texts (below), in which no piece of a text depends
on what stands beyond the white space around it; any other text goes through
the library as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from heapq import heapify, heappop, heappush

# Letters, marks and spaces on which Python's classes and case mapping agree with
# the tokenizer's: Latin letters up to U+024F and general punctuation; without
# control characters, other spaces, number forms and U+0130 (lower case of two).
PLAIN = re.compile("[\t\n\r\x20-\x7e¡-±´-¸º»¿-įı-ɏ‐-‧‰-⁞]*")
WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
SPACED_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
CACHED = 400_000  # entries of a worker's table; later words are worked out each time
LONGEST_CACHED = 64


class WordTable(dict):
    """Results by word; works out what is missing and keeps it while there is room."""

    def __init__(self, work_out):
        self.work_out = work_out

    def __missing__(self, word):
        got = self.work_out(word)
        if len(self) < CACHED and len(word) <= LONGEST_CACHED:
            self[word] = got
        return got


class WordEncoder:
    """Ids of whole texts, as packed unsigned integers, for a lower-casing word BPE file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.dtype = {"H": "<u2", "I": "<u4"}[self.code]
        self.words = WordTable(self.library)
        self.chunks = WordTable(lambda c: b"".join(map(self.words.__getitem__, WORDS.findall(c.lower()))))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def library(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __call__(self, text: str) -> bytes:
        if PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            return b"".join(map(self.chunks.__getitem__, text.split()))
        return self.library(text)


class MergeCounter:
    """Number of tokens that a byte-level BPE file gives, without making ids.

    A piece starts as its bytes.  A heap holds the adjacent pairs that a merge
    rule joins, lowest rank first, then leftmost; the symbols form a linked
    list, so a merge touches its two neighbours only.  Pairs in the heap that a
    merge has made stale are skipped.  The count is bytes minus merges.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
        hidden = [b for b in range(256) if b not in set(shown)]
        as_char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.byte_of = {c: b for b, c in as_char.items()}
        self.first = [vocab[as_char[b]] for b in range(256)]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rule = {vocab[a] << 32 | vocab[b]: (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.at_special = re.compile("|".join(map(re.escape, self.special)) or r"(?!)")
        self.words = WordTable(lambda w: self.symbols(w.encode()))
        self.shown_words = WordTable(lambda w: self.symbols(bytes(map(self.byte_of.__getitem__, w))))

    def symbols(self, piece: bytes) -> int:
        n, rule = len(piece), self.rule
        if n < 2:
            return n
        sym = list(map(self.first.__getitem__, piece))
        heap = [(m[0], i) for i in range(n - 1) if (m := rule.get(sym[i] << 32 | sym[i + 1]))]
        heapify(heap)
        after, before, merges = [*range(1, n), -1], [*range(-1, n - 1)], 0
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if j < 0 or sym[i] < 0 or (m := rule.get(sym[i] << 32 | sym[j])) is None or m[0] != rank:
                continue
            merges += 1
            sym[i], sym[j], k, h = m[1], -1, after[j], before[i]
            after[i] = k
            if k >= 0:
                before[k] = i
                if m := rule.get(sym[i] << 32 | sym[k]):
                    heappush(heap, (m[0], i))
            if h >= 0 and (m := rule.get(sym[h] << 32 | sym[i])):
                heappush(heap, (m[0], h))
        return n - merges

    def __call__(self, text: str) -> int:
        total = 0
        parts = self.at_special.split(text) if self.special else [text]
        for part in parts:
            if PLAIN.fullmatch(part):
                total += sum(map(self.words.__getitem__, SPACED_WORDS.findall(part)))
            else:  # the library's own splitting; its pieces show each byte as one character
                total += sum(self.shown_words[w] for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(part))
        return total + len(parts) - 1


_loaded: dict = {}


def loaded(kind, path: str):
    """A worker process's only instance; one for another kind or file takes its place, tables and all."""
    if (kind, path) not in _loaded:
        _loaded.clear()
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]
