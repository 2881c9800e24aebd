"""Exact token counts of every prefix of a text, by dynamic programming over its prefixes."""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType
from tokenizers import Tokenizer


@lru_cache
def unsure() -> frozenset[str]:
    """The letters and digits that were assigned lately: regex and the tokenizer's library can know different versions of Unicode."""
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return frozenset(c for c in regex.findall(r"[\p{L}\p{N}]", everything) if unicodedata.category(c) == "Cn")


class PrefixCounter:
    """Token counts of all prefixes of a text, as the byte-level BPE in a tokenizers file gives them.

    The last token of the encoding of a prefix is the one token that ends there and stays apart from the last token of what is before it.
    So one pass over the bytes of a word, keeping for each prefix its last token and its count, gives the counts of all of them. Words are the pieces
    that the tokenizer cuts a text into before it merges; the counts of the words met lately are kept.
    """

    def __init__(self, vocabulary: str, late: frozenset[str], keep: int = 400_000) -> None:
        self.full = Tokenizer.from_file(vocabulary)
        with open(vocabulary, encoding="utf-8") as f:
            model = json.load(f)["model"]
        # Bytes are written as characters in these files: printable ones as themselves, the others, in order, from 256 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): chr(b) for b in shown} | {chr(256 + i): chr(b) for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = model["vocab"]
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.parts[ids[a + b]] = ids[a], ids[b]
            self.merge[ids[a], ids[b]] = rank, ids[a + b]
        self.rank = {t: self.merge[p][0] for t, p in self.parts.items()}
        self.tokens = ahocorasick.Automaton()
        for token, i in ids.items():
            if i in self.parts or len(token) == 1:
                self.tokens.add_word("".join(byte_of[c] for c in token), (i, len(token)))
        self.tokens.make_automaton()
        self.special = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.pieces, self.late = regex.compile(public_tokenizers.PATTERN), late
        self.blanks = regex.compile(r"\s{2,}(?=\S)")
        self.known: dict[str, bytes] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        self.keep = keep

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether two tokens next to each other are the encoding of their bytes: no merge over their border comes before those that made them.

        Merges are undone from the last: while `left` or `right` isn't yet made, its last part or first part stands at the border until its rank.
        At equal ranks what is further left is merged first.
        """
        key = left, right
        until_left = until_right = len(self.merge)
        apart = True
        while True:
            over = self.merge.get((left, right))
            if over and over[0] < until_left and over[0] <= until_right:
                apart = False
                break
            a, b = self.rank.get(left, -1), self.rank.get(right, -1)
            if a < 0 and b < 0:
                break
            if a > b:
                until_left, left = a, self.parts[left][1]
            else:
                until_right, right = b, self.parts[right][0]
        if len(self.apart) >= 5 * self.keep:
            self.apart.clear()
        self.apart[key] = apart
        return apart

    def in_piece(self, piece: str) -> bytes:
        """Counts of the prefixes of a piece, from one character to all, as 32-bit numbers."""
        raw = piece.encode()
        n = len(raw)
        last, count, known = [-1] * (n + 1), [0] * (n + 1), self.apart
        at = -1
        for end, (token, size) in self.tokens.iter(raw.decode("latin-1")):
            if end == at:
                continue  # matches that end at one place come longest first; one of them fits
            start = end + 1 - size
            if start:
                apart = known.get((last[start], token))
                if apart is None:
                    apart = self.stay_apart(last[start], token)
                if not apart:
                    continue
            at, last[end + 1], count[end + 1] = end, token, count[start] + 1
        if n != len(piece):  # only whole characters are prefixes
            count = [0, *(c for c, after in zip(count[1:], raw[1:] + b"a", strict=True) if after & 0xC0 != 0x80)]
        if piece[0] == "'" and len(piece) == 3 and piece[1].isalpha():
            count[2] = 2  # 're cut short is ' and r, two pieces
        return struct.pack(f"<{len(count) - 1}I", *count[1:])

    def counts(self, piece: str) -> bytes:
        if piece not in self.known:
            if len(piece) > 64:
                return self.in_piece(piece)
            if len(self.known) >= self.keep:
                self.known.clear()
            self.known[piece] = self.in_piece(piece)
        return self.known[piece]

    def split(self, text: str) -> list[str]:
        if not text.isascii() and not self.late.isdisjoint(set(text)):
            return [text[a:b] for _, (a, b) in self.full.pre_tokenizer.pre_tokenize_str(text)]
        return self.pieces.findall(text)

    def plain(self, text: str) -> np.ndarray:
        """Counts of all prefixes, the empty one first, of a text without special tokens."""
        if not text:
            return np.zeros(1, np.int64)
        pieces = self.split(text)
        known = self.known
        inner = np.frombuffer(b"".join([known[p] if p in known else self.counts(p) for p in pieces]), "<u4")
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        before = np.cumsum(inner[ends - 1], dtype=np.int64) - inner[ends - 1]
        out = np.concatenate([np.zeros(1, np.int64), inner + np.repeat(before, sizes)])
        # Blanks before a word are cut before their last one, but not where the text ends behind them.
        for m in self.blanks.finditer(text):
            out[m.end()] = out[m.start()] + int.from_bytes(self.counts(m[0])[-4:], "little")
        return out

    def __call__(self, text: str) -> np.ndarray:
        """counts[i] is the number of tokens of text[:i]. A special token's string is one token once it is whole, and text before that."""
        out, start = np.zeros(1, np.int64), 0
        for m in self.specials.finditer(text) if any(s in text for s in self.special) else ():
            part = self.plain(text[start : m.end()])
            part[-1] = part[m.start() - start] + 1
            out, start = np.concatenate([out[:-1], out[-1] + part]), m.end()
        return np.concatenate([out[:-1], out[-1] + self.plain(text[start:])])


def prefix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (id, n_bytes, counts) for each row of docs: counts[i] is the exact number of tokens of the first i characters, 0 <= i <= all.

    With it tokens(), tokens_between() and longest_prefix() answer what a text or a part of it costs and where it must be cut, without encoding again.
    A whole text is read once, in one pass; nothing is shuffled. The array has four bytes a character: store it where it is asked often.

    Null texts are empty: counts is [0]. Null and repeated ids stay as they are, whatever their type. Very long texts are counted whole; a piece of a million
    characters without a blank takes time in proportion to its length. An empty table gives an empty result. Other columns of docs are not read, whatever their names.
    vocabulary: a byte-level BPE file of the tokenizers library, by default the public one with 50,257 ids, cut into pieces by its public pattern.
    """
    vocabulary, late = vocabulary or public_tokenizers.path("byte_bpe_50k.json"), unsure()
    kind = docs.schema[id_col].dataType
    schema = StructType([StructField("id", kind), StructField("n_bytes", LongType()), StructField("counts", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PrefixCounter(vocabulary, late)
        for rows in batches:
            texts = [t or "" for t in rows.column(1).to_pylist()]
            counts = [counter(t).astype(np.int32) for t in texts]
            offsets = np.cumsum([0, *map(len, counts)], dtype=np.int32)
            values = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *counts])))
            sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([rows.column(0), sizes, values], names=["id", "n_bytes", "counts"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def tokens(counts: Column, chars: Column | int | None = None) -> Column:
    """Tokens of the first `chars` characters, of all by default; a text with fewer is counted whole."""
    size = F.size(counts)
    return F.get(counts, size - 1 if chars is None else F.least(F.lit(chars) if isinstance(chars, int) else chars, size - 1)).cast("long")


def longest_prefix(counts: Column, budget: int) -> Column:
    """Characters of the longest prefix of at most `budget` tokens. A longer prefix can have fewer tokens than a shorter one."""
    return F.when(tokens(counts) <= budget, F.size(counts) - 1).otherwise(F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))).cast("long")


def count(docs: DataFrame, limit: int = 512, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """One row (id, n_bytes, n_tokens, over_limit, fitting_chars) for each row of docs, read off prefix_counts(), whose nulls and edges these are: a null text has
    0 bytes and tokens. fitting_chars: characters of the longest prefix of at most `limit` tokens."""
    n = tokens(F.col("counts"))
    return prefix_counts(docs, id_col, text_col, vocabulary).select(id_col, "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"), longest_prefix(F.col("counts"), limit).alias("fitting_chars"))
