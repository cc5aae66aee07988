"""Token counts of every prefix of a text, by dynamic programming over a byte-level BPE vocabulary.

In a BPE encoding each token depends on the one before it only: a row of tokens is an encoding exactly if every two
neighbours, joined and encoded, come out as those two. So the encoding of a prefix is that of a shorter prefix plus
one token, and ``last[i]``, the last token of the first i bytes, is the one token t that ends there and goes with
``last[i - len(t)]``. Its count is one more than that of the shorter prefix. One pass over a piece of text fills both
tables; any cut of the text is then answered by looking them up.

Texts are first cut into pieces as the vocabulary's library does; a prefix cuts the last piece or two anew.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: How the byte-level vocabularies cut text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CONTRACTIONS = frozenset("'s 't 're 've 'm 'll 'd".split())
SPACE_RUN = regex.compile(r"\s+")
#: Pieces whose tables a worker remembers.
KEEP = 400_000


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where printable, else from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix token counts under the vocabulary file at ``path`` (.json of the tokenizers library, byte-level BPE)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        letters = byte_letters()
        back = {ord(c): b for b, c in letters.items()}
        self.specials = [t["content"] for t in spec["added_tokens"]]
        specials = {t["content"] for t in spec["added_tokens"]}
        self.tokens = {bytes(back[ord(c)] for c in t): t for t in spec["model"]["vocab"] if t not in specials}
        self.longest = max(map(len, self.tokens))
        self.letters = letters
        self.pieces = regex.compile(PIECES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        #: By token, which tokens may stand after it.
        self.goes: dict[bytes, dict[bytes, bool]] = {}
        self.known = 0
        self.tables: dict[str, bytes] = {}
        self.totals: dict[str, int] = {}

    def _encode(self, piece: bytes) -> list[str]:
        return [t.value for t in self.library.model.tokenize("".join(self.letters[b] for b in piece))]

    def _try(self, a: bytes, b: bytes) -> bool:
        if self.known > 8 * KEEP:
            for after in self.goes.values():
                after.clear()
            self.known = 0
        self.known += 1
        good = self._encode(a + b) == ([self.tokens[a], self.tokens[b]] if a else [self.tokens[b]])
        self.goes.setdefault(a, {})[b] = good
        return good

    def piece_counts(self, piece: bytes) -> list[int]:
        """Tokens of the first 0, 1, ... bytes of one piece."""
        n, tokens, goes, longest = len(piece), self.tokens, self.goes, self.longest
        counts = [0] * (n + 1)
        last: list[bytes] = [b""] * (n + 1)
        after = [goes.setdefault(b"", {})] * (n + 1)
        for end in range(1, n + 1):
            # Only one token fits; most are short, so look from the end backwards.
            for start in range(end - 1, (end - longest if end > longest else 0) - 1, -1):
                token = piece[start:end]
                if token in tokens:
                    # Whether the token may stand after the last one of the prefix (or alone, after none).
                    good = after[start].get(token)
                    if good or (good is None and self._try(last[start], token)):
                        counts[end] = counts[start] + 1
                        last[end] = token
                        if (known := goes.get(token)) is None:
                            known = goes[token] = {}
                        after[end] = known
                        break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return counts

    def table(self, piece: str) -> bytes | np.ndarray:
        if (known := self.tables.get(piece)) is None:
            counts = self.piece_counts(piece.encode("utf-8", "replace"))
            if len(counts) > 64:
                return np.array(counts, np.int64)
            known = bytes(counts)
            if len(self.tables) >= KEEP:
                self.tables.clear()
                self.totals.clear()
            self.tables[piece] = known
            self.totals[piece] = int(known[-1])
        return known

    def parts(self, text: str) -> list[tuple[str, bool]]:
        """The text's pieces and whether each is a special token."""
        if self.split is None or not any(s in text for s in self.specials):
            return [(p, False) for p in self.pieces.findall(text)]
        out = []
        for i, part in enumerate(self.split.split(text)):
            out.extend([(part, True)] if i % 2 else [(p, False) for p in self.pieces.findall(part)])
        return out

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of its pieces' tables."""
        if self.split is not None and any(s in text for s in self.specials):
            return sum(1 if special else int(self.table(p)[-1]) for p, special in self.parts(text))
        totals = self.totals
        n = 0
        for p in self.pieces.findall(text):
            known = totals.get(p)
            n += int(self.table(p)[-1]) if known is None else known
        return n

    def _places(self, piece: str) -> np.ndarray:
        """Tokens of the first 0, 1, ... code points of a piece, from its table."""
        table = self.table(piece)
        counts = np.frombuffer(table, np.uint8).astype(np.int64) if isinstance(table, bytes) else table
        raw = np.frombuffer(piece.encode("utf-8", "replace"), np.uint8)
        return counts[np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))]

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of the first 0, 1, ... code points of the text, each as if the text ended there.

        A beginning of a word, a number or a run of marks is again one piece, and so is one of a run of white space,
        which at a text's end gives nothing to a word: all are looked up in a table of their own, which is made once.
        Only cuts inside a contraction or a special token are cut into pieces anew.
        """
        counts = np.zeros(len(text) + 1, np.int64)
        before = at = anchor = anchored = start = 0
        for piece, special in self.parts(text):
            size = len(piece)
            if special:
                self._runs(text, start, at, counts)
                for n in range(1, size):
                    counts[at + n] = anchored + self.count_plain(text[anchor : at + n])
                anchor, anchored, start = at + size, before + 1, at + size
                before += 1
            else:
                if piece in CONTRACTIONS:
                    for n in range(1, size):
                        counts[at + n] = before + self.count_plain(piece[:n])
                elif not piece.isspace():
                    counts[at + 1 : at + size] = before + self._places(piece)[1:-1]
                anchor, anchored = at, before
                before += int(self.table(piece)[-1])
            at += size
            counts[at] = before
        self._runs(text, start, at, counts)
        return counts

    def _runs(self, text: str, start: int, stop: int, counts: np.ndarray) -> None:
        """Fill in the cuts after each white-space character of ``text[start:stop]``, where a run of them is one piece."""
        for run in SPACE_RUN.finditer(text, start, stop):
            counts[run.start() + 1 : run.end() + 1] = counts[run.start()] + self._places(run[0])[1:]

    def count_plain(self, text: str) -> int:
        """Tokens of a text in which nothing is special."""
        return sum(int(self.table(p)[-1]) for p in self.pieces.findall(text))

    def truncate(self, text: str, budget: int) -> str:
        """The longest prefix of at most ``budget`` tokens; the empty one if there is no other."""
        fits = np.flatnonzero(self.prefix_counts(text) <= budget)
        return text[: int(fits[-1])]


_counters: dict[str, PrefixCounter] = {}


def _counter(path: str) -> PrefixCounter:
    """One counter a worker, so that its tables last over batches and tasks."""
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def token_counts(docs: DataFrame, path: str, limit: int = 512, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry``, n_bytes, n_tokens and over_limit of every whole text (null: empty text, 0 tokens).

    ``path`` names the vocabulary file on every executor. Texts of any length are counted whole, one piece in memory at
    a time. Repeated rows each get a row; columns that aren't carried may have any name. An empty table gives no rows.
    """
    df = docs.select(*carry, F.col("text").alias("__text"))
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            texts = [t or "" for t in batch["__text"].to_pylist()]
            n = np.fromiter((counter.count(t) for t in texts), np.int64, len(texts))
            size = np.fromiter((len(t.encode("utf-8", "replace")) for t in texts), np.int64, len(texts))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(size), pa.array(n), pa.array(n > limit)], names=[*carry, "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(run, f"{types}, n_bytes long, n_tokens long, over_limit boolean")


def truncated(docs: DataFrame, path: str, budget: int, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``carry`` and ``text`` cut to at most ``budget`` tokens, from the prefix table.

    Null stays null, and empty text empty. Texts of any length, and runs of any one kind of character, take time in
    proportion to their length. Repeated rows each get a row; an empty table gives no rows.
    """
    df = docs.select(*carry, F.col("text").alias("__text"))
    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in batches:
            cut = [None if t is None else counter.truncate(t, budget) for t in batch["__text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in carry), pa.array(cut, pa.string())], names=[*carry, "text"])

    return df.mapInArrow(run, f"{types}, text string")
