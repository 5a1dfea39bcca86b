"""Byte-level BPE by prefix dynamic programming, and decoding.

For each prefix of a piece's bytes, exactly one token can end its encoding; it is stored. A token fits after the
stored last token of the shorter prefix if the two, side by side, are what merging their bytes gives, which is told by
undoing their merges in order of rank and looking for an earlier merge across the boundary. Because an entry depends
only on the entries of the last `max_len` bytes, appending adds entries without touching old ones, and after an edit
recomputation stops once `max_len` entries in a row agree with the old ones.

Texts are cut into cached units as the public pattern cuts (see pieces); under another pattern its matches alone are the units.

Defined results: null text counts as empty (no ids); any Unicode text is encoded, very long ones and very long pieces in time and
memory of their length; ties don't arise, as one token ends each prefix; repeated rows give repeated rows; columns of
other names are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bounded_batches, table, tokenizer_file, worker_cache
from graphloom.llm.pieces import TextEncoder, UnitCache

MOST_PAIRS = 300_000
MOST_UNITS = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.tokens = ranks, {rank: token for token, rank in ranks.items()}
        self.max_len = max(map(len, ranks))
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.finder: ahocorasick.Automaton | None = None

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for single bytes, and for tokens that no merge reaches."""
        if token not in self.halves:
            text, found = self.tokens[token], None
            for k in range(1, len(text)):
                a, b = self.ranks.get(text[:k]), self.ranks.get(text[k:])
                if a is not None and b is not None and a < token and b < token and self.reached(a) and self.reached(b) and self.fits(a, b, token):
                    found = (a, b)
                    break
            self.halves[token] = found
        return self.halves[token]

    def reached(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.split(token) is not None

    def fits(self, a: int, b: int, own: int | None = None) -> bool:
        """Whether merging the bytes of a and b leaves a and b; own: the merge of the two that doesn't count."""
        limit = float("inf") if own is None else own
        tokens, ranks = self.tokens, self.ranks
        while True:
            joined = ranks.get(tokens[a] + tokens[b])
            if joined is not None and joined < limit:
                return False
            left, right = self.split(a) if len(tokens[a]) > 1 else None, self.split(b) if len(tokens[b]) > 1 else None
            if left and (a > b or not right):
                limit, a = a, left[1]
            elif right:
                limit, b = b + 1, right[0]
            else:
                return True

    def automaton(self) -> ahocorasick.Automaton:
        """Finds, at each place of a text, the tokens that end there; only those that merges reach."""
        if self.finder is None:
            self.finder = ahocorasick.Automaton()
            for text, rank in self.ranks.items():
                if self.reached(rank):
                    self.finder.add_word(text.decode("latin-1"), (len(text), rank))
            self.finder.make_automaton()
        return self.finder

    def prefixes(self, text: bytes, last: list[int] | None = None, stop: int | None = None) -> list[int]:
        """last tokens of all prefixes up to stop: entry k is the one token that ends the encoding of text[:k] (entry 0 is unused). Continues those given."""
        last = [-1] if last is None else last
        stop = len(text) if stop is None else stop
        pairs, done = self.pairs, len(last) - 1
        begin = max(0, done - self.max_len + 1)
        for end, (n, token) in self.automaton().iter(text[begin:stop].decode("latin-1")):
            end += begin + 1
            if end <= done:
                continue
            if end > n:
                pair = last[end - n] << 32 | token
                fits = pairs.get(pair)
                if fits is None:
                    if len(pairs) >= MOST_PAIRS:
                        pairs.clear()
                    fits = pairs[pair] = self.fits(last[end - n], token)
                if not fits:
                    continue
            last.append(token)
            done = end
        if done < stop:
            raise ValueError("a byte without a token")
        return last

    def walk(self, last: list[int]) -> list[int]:
        ids, at = [], len(last) - 1
        while at:
            ids.append(last[at])
            at -= len(self.tokens[last[at]])
        return ids[::-1]

    def append(self, text: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        return text + more, self.prefixes(text + more, list(last))

    def replace(self, text: bytes, last: list[int], start: int, stop: int, new: bytes) -> tuple[bytes, list[int], int]:
        """(text, prefixes, entries computed) after text[start:stop] became new."""
        edited, shift = text[:start] + new + text[stop:], len(new) - (stop - start)
        out, same, made = last[: start + 1], 0, 0
        for end in range(start + 1, len(edited) + 1):
            self.prefixes(edited, out, end)
            made += 1
            old = end - shift
            same = same + 1 if old > stop and last[old] == out[end] else 0
            if same >= self.max_len:
                return edited, out + last[old + 1 :], made
        return edited, out, made

    def encode_piece(self, text: bytes) -> list[int]:
        whole = self.ranks.get(text)
        return [whole] if whole is not None else self.walk(self.prefixes(text))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


def coder(path: str, pattern: str) -> tuple[PrefixBpe, Callable[[str], bytes]]:
    """The model and text encoder of a rank file, one a worker process."""
    return worker_cache("prefix-bpe", (path, pattern), lambda: _make_coder(path, pattern))


def _make_coder(path: str, pattern: str) -> tuple[PrefixBpe, Callable[[str], bytes]]:
    import public_tokenizers

    bpe, cut = PrefixBpe(read_ranks(path)), regex.compile(pattern).finditer

    def piece(text: str) -> bytes:
        ids = bpe.encode_piece(text.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    if pattern != public_tokenizers.PATTERN:
        pieces = UnitCache(piece, most=MOST_UNITS)
        return bpe, lambda text: b"".join(pieces[m.group()] for m in cut(text))

    def unit(text: str) -> bytes:
        core = text.rstrip(".,;:!?")
        if len(core) < len(text) and (core[1:] if core[:1] == " " else core).isalpha():  # letters, then marks: two pieces
            return (own.spaced[core[1:]] if core[0] == " " else own.bare[core]) + own.bare[text[len(core) :]]
        return b"".join(piece(m.group()) for m in cut(text))

    own = TextEncoder(unit, MOST_UNITS)
    return bpe, own


def token_digests(df: DataFrame, ranks: str, pattern: str, columns: list[str] | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of (doc_id, text); decoding starts from the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, encode = coder(ranks, pattern)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in b.column(1):
                ids = encode(text.as_py() or "")
                counts.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(bpe.decode(np.frombuffer(ids, "<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    bounded_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_column(df: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids: the general form, with the ids themselves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, encode = coder(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(encode(t.as_py() or ""), "<u4").astype(np.int32) for t in b.column(1)], pa.list_(pa.int32()))], ["id", "ids"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, ids array<int>")


def decode_column(df: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """id, bytes from (id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, _ = coder(ranks, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([bpe.decode(x or []) for x in b.column(1).to_pylist()], pa.binary())], ["id", "bytes"])

    return df.select("id", "ids").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, bytes binary")


def op9_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
