"""BPE encoding and decoding of whole texts with a public tokenizer file.

A piece of text is a row of byte symbols. The ranks of its adjacent pairs are the leaves of a
segment tree whose root is the lowest rank, leftmost first; each merge updates three leaves in
logarithmic time, until no pair can be merged. So a piece of n bytes takes n log n steps. A node has
16 children, so that short pieces are a root over leaves.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
import warnings
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from talkmine.llm.text import tidy

#: pieces, and words of one or more, remembered with their tokens by a task: at most twice as many
PIECES, WORDS = 100_000, 50_000
#: control characters that count as blanks in Python, but not in the tokenizer
_NOT_BLANK = "\x1c\x1d\x1e\x1f"
#: white space of the tokenizer's pattern language
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: version of Python's character tables, to which the fixed values below are additions
UNICODE = "15.1.0"
# What the tokenizer's own tables have otherwise, as first and last code point.
# Its patterns know Unicode 16, its lower case Unicode 17, its normal forms Unicode 9.
LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0),
    (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5F0))
NUMBERS = (
    (0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79),
    (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: capital letters, first and last, and the lower case of the first
CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB))
#: characters that neither change place nor combine in its normal form
UNMOVED = (
    (0x7FD, 0x7FD), (0x898, 0x89F), (0x8CA, 0x8D3), (0x9FE, 0x9FE), (0xC3C, 0xC3C), (0xD3B, 0xD3C), (0xEBA, 0xEBA),
    (0x1715, 0x1715), (0x1ABF, 0x1ACE), (0x1DF6, 0x1DFA), (0xA82C, 0xA82C), (0x10D24, 0x10D27), (0x10EAB, 0x10EAC),
    (0x10EFD, 0x10EFF), (0x10F46, 0x10F50), (0x10F82, 0x10F85), (0x11070, 0x11070), (0x1133B, 0x1133B),
    (0x1145E, 0x1145E), (0x11839, 0x1183A), (0x11930, 0x11930), (0x1193D, 0x1193E), (0x11943, 0x11943),
    (0x119E0, 0x119E0), (0x11A34, 0x11A34), (0x11A47, 0x11A47), (0x11A99, 0x11A99), (0x11D42, 0x11D42),
    (0x11D44, 0x11D45), (0x11D97, 0x11D97), (0x11F41, 0x11F42), (0x16FF0, 0x16FF1), (0x1E08F, 0x1E08F),
    (0x1E130, 0x1E136), (0x1E2AE, 0x1E2AE), (0x1E2EC, 0x1E2EF), (0x1E4EC, 0x1E4EF))
_NONE = 1 << 62
_PLACE = (1 << 40) - 1


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it is printable and not a
    blank, else the next character from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


def _inside(ranges) -> str:
    """Code points as the inside of a pattern's brackets."""
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


@lru_cache(2)
def code_points(kind: str) -> str:
    """Inside of a pattern's brackets: all code points that the tokenizer takes for ``kind``, L or N.

    They come from Python's tables and the fixed values, whatever the pattern engine is built with.
    """
    if unicodedata.unidata_version != UNICODE:
        warnings.warn(f"Unicode {unicodedata.unidata_version} instead of {UNICODE}: rare characters may be cut otherwise")
    found = [c for c in range(0x110000) if unicodedata.category(chr(c))[0] == kind]
    starts = [c for c, before in zip(found, [None, *found]) if before != c - 1]
    ends = [c for c, after in zip(found, [*found[1:], None]) if after != c + 1]
    return _inside([*zip(starts, ends), *(LETTERS if kind == "L" else NUMBERS)])


_LOWER = {a + i: to + i for a, b, to in CAPITALS for i in range(b - a + 1)} | {ord("Σ"): "σ"}
_UNMOVED = regex.compile(f"([{_inside(UNMOVED)}])")


def plain(text: str) -> str:
    """Normal form and lower case as the tokenizer makes them."""
    if text.isascii():
        return text.lower()
    if not unicodedata.is_normalized("NFC", text):  # what is has only parts that are
        text = "".join([unicodedata.normalize("NFC", part) for part in _UNMOVED.split(text)])
    return text.translate(_LOWER).lower()


class _Memory(dict):
    """Results of ``compute`` for short arguments: recent ones, and those seen just before."""

    def __init__(self, compute, most: int) -> None:
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, word: str):
        found = self.older.get(word) or self.compute(word)
        if len(word) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[word] = found
        return found

    def forget(self) -> None:
        self.clear()
        self.older = {}


class Bpe:
    """Encoder and decoder of a tokenizer file with lower case, word ends and byte symbols."""

    def __init__(self, spec: dict) -> None:
        model, self.end = spec["model"], spec["model"]["end_of_word_suffix"]
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.symbols = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for content, i in [*vocab.items(), *self.special.items()]:
            self.symbols[i] = content
        shown = byte_symbols()
        self.inner = [vocab[c] for c in shown]
        self.last = [vocab[c + self.end] for c in shown]
        #: rank of a pair, above the place that is added to it; and what each rank makes
        self.ranks, self.made = {}, []
        for rank, (a, b) in enumerate(model["merges"]):
            self.ranks.setdefault(vocab[a] << 32 | vocab[b], rank << 40)
            self.made.append(vocab[a + b])
        #: rank of a pair of single bytes inside a piece, at the first times 256 plus the second
        self.first = [self.ranks.get(a << 32 | b, _NONE) for a in self.inner for b in self.inner]
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{_SPACE}")
        self.ascii = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9"))
        self.piece = re.compile(pattern.replace(r"\p{L}", code_points("L")).replace(r"\p{N}", code_points("N")))
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None
        self.pieces, self.words = _Memory(self._piece, PIECES), _Memory(self._word, WORDS)

    def merge(self, piece: bytes) -> list[int]:
        """Token ids of one piece."""
        inner, first, rank, made, n = self.inner, self.first, self.ranks.get, self.made, len(piece)
        ids = [inner[b] for b in piece]
        ids[-1] = self.last[piece[-1]]
        if n == 1:
            return ids
        leaves = [first[a << 8 | b] + i for a, b, i in zip(piece, piece[1:], range(n))]
        leaves[-1] = rank(ids[-2] << 32 | ids[-1], _NONE) + n - 2
        leaves.append(_NONE)
        levels = [leaves]
        while len(below := levels[-1]) > 16:
            levels.append([min(below[i:i + 16]) for i in range(0, len(below), 16)])
        top, deep = levels[-1], len(levels) > 1
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (low := min(top)) < _NONE:
            i = low & _PLACE
            own = ids[i] = made[low >> 40]
            j = after[i]
            k = after[i] = after[j]
            ids[j] = -1
            leaves[j] = leaves[i] = _NONE
            if k < n:
                before[k] = i
                leaves[i] = rank(own << 32 | ids[k], _NONE) + i
            h = before[i]
            if h >= 0:
                leaves[h] = rank(ids[h] << 32 | own, _NONE) + h
            if deep:
                moved = {i >> 4, j >> 4, max(h, 0) >> 4}
                for below, above in zip(levels, levels[1:]):
                    at, moved = moved, set()
                    for node in at:
                        low = min(below[node << 4:(node + 1) << 4])
                        if above[node] != low:
                            above[node] = low
                            moved.add(node >> 4)
        return [i for i in ids if i >= 0]

    def _piece(self, piece: str) -> tuple[str, str]:
        """Ids and symbols of a piece, joined by blanks."""
        ids = self.merge(piece.encode())
        return " ".join(map(str, ids)), " ".join([self.symbols[i] for i in ids])

    def _word(self, text: str) -> tuple[str, str]:
        """The same of any text without special tokens; what stands between blanks is cut alike
        whether it stands alone or not."""
        text = plain(text)
        if text.isalpha():  # letters in Python's tables are in the tokenizer's
            return self.pieces[text]
        pieces = [self.pieces[p] for p in (self.ascii if text.isascii() else self.piece).findall(text)]
        return " ".join([p[0] for p in pieces]), " ".join([p[1] for p in pieces])

    def parts(self, text: str) -> list[tuple[str, str]]:
        """Ids and symbols of a text in parts, special tokens as themselves."""
        out = []
        for part in self.cut.split(text) if self.cut and "<" in text else [text]:
            if part in self.special:
                out.append((str(self.special[part]), part))
            elif any(c in part for c in _NOT_BLANK):
                out += [found for found in [self._word(part)] if found[0]]
            else:
                words = self.words
                out += [words[w] for w in part.split()]
        return out

    def forget(self) -> None:
        """Let go of what was remembered; workers live on after their tasks."""
        self.pieces.forget()
        self.words.forget()

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.parts(text) for i in ids.split(" ")]

    def decode(self, ids: list[int]) -> str:
        """Symbols joined by blanks, as a tokenizer file without a decoder has it."""
        return " ".join([self.symbols[i] for i in ids])


@lru_cache(4)
def load(path: str) -> Bpe:
    with open(path, encoding="utf-8") as file:
        return Bpe(json.load(file))


def encoded(docs: DataFrame, path: str, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; with ``ids`` also the
    ids themselves.

    ``path`` is a tokenizer file that every executor has. A null text is empty: no token, and the
    digests of nothing. Rows that repeat give repeated rows, an empty table none.
    """

    def compute(batches):
        bpe = load(path)
        for batch in batches:
            n, sums, shown, own = [], [], [], []
            for text in batch.column("text"):
                parts = bpe.parts(text.as_py() or "")
                joined = " ".join([p[0] for p in parts])
                n.append(joined.count(" ") + 1 if joined else 0)
                sums.append(hashlib.sha256(joined.encode()).hexdigest())
                shown.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
                if ids:
                    own.append([int(i) for i in joined.split()])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(sums, pa.string()),
                       pa.array(shown, pa.string())] + [pa.array(own, pa.list_(pa.int32()))] * ids
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids)
        bpe.forget()

    return docs.select("doc_id", "text").mapInArrow(
        tidy(compute), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)
