"""Byte-level BPE encoding and decoding in linear time.

The vocabulary, its bytes mapped to Latin-1, is held in an Aho-Corasick automaton, which
finds the longest tokens that follow one another in a piece in one pass, and the longest at
any other place when it is asked for.  The encoder takes the longest token that is compatible with the token before it, tries ever shorter prefixes
where it isn't, and steps back where none is left; places that led nowhere are marked, so
each is left once at most.  Two adjacent tokens are compatible if no merge of lower rank
crosses their border; that is found by undoing merges from either side and memoised.  The
result equals that of applying all merges by rank.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are
encoded each; an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import binary_column, by_size, documents, ids_column, release
from .units import SPACE, Ids, Units, gather, resolve

SLICE = 2 << 20
#: Pairs of adjacent tokens whose compatibility is remembered.
PAIRS = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class LinearBpe(Units):
    """An encoder and decoder for one table of ranks and one pattern of pieces, which cuts
    as ``units`` expects; tokens and pieces are strings of Latin-1, a character a byte."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__(True)
        import ahocorasick
        import regex

        self.ranks = {token.decode("latin-1"): i for token, i in ranks.items()}
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token, (i, len(token)))
        self.automaton.make_automaton()
        # white space as in Unicode, whichever engine reads the pattern
        self.pieces = regex.compile(pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")).findall
        self.parts: dict[int, tuple[int, int]] = {}
        self.lengths = {i: len(t) for i, t in self.tokens.items()}
        self.shorter = {i: self.prefix(t) for i, t in self.tokens.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        # the bytes of all tokens by id, for decoding
        self.sizes = np.zeros(max(self.tokens) + 1, np.int64)
        for i, t in self.tokens.items():
            self.sizes[i] = len(t)
        self.places = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer("".join(t for _, t in sorted(self.tokens.items())).encode("latin-1"), np.uint8)

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one; a single byte is its own parts."""
        if token not in self.parts:
            parts = list(self.tokens[token])
            while len(parts) > 2:
                rank, at = min((self.ranks.get(parts[i] + parts[i + 1], len(self.ranks)), i) for i in range(len(parts) - 1))
                if rank >= token:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self.parts[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else (token, token)
        return self.parts[token]

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two may stand side by side in an encoding."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is not None:
            return known
        limit, ok = len(self.ranks) + 1, True
        while True:
            merge = self.ranks.get(self.tokens[left] + self.tokens[right])
            if merge is not None and merge < limit:
                ok = False
                break
            # undo the later of the two merges; a byte has none
            inner_left, inner_right = self.split(left)[1], self.split(right)[0]
            if left > right and inner_left != left or inner_right == right:
                if inner_left == left:
                    break
                limit, left = left, inner_left
            else:
                limit, right = right + 1, inner_right
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def prefix(self, raw: str) -> int:
        """The longest token that begins this one, or -1."""
        return next((self.ranks[raw[:k]] for k in range(len(raw) - 1, 0, -1) if raw[:k] in self.ranks), -1)

    def encode_piece(self, raw: str, out: list[int]) -> None:
        """Append the ids of one piece, given as Latin-1, to ``out``."""
        whole = self.ranks.get(raw)
        if whole is not None:
            out.append(whole)
            return
        n, base, longest = len(raw), len(out), {}
        # one pass finds the longest tokens that follow one another; more are looked up
        # where a shorter token was taken
        for end, (token, length) in self.automaton.iter_long(raw):
            longest[end - length + 1] = token
        shut: set[int] = set()
        lengths, pairs, last = self.lengths, self.pairs, -1
        place, token = 0, longest[0]
        while True:
            end = place + lengths[token]
            if end not in shut:
                ok = last < 0 or pairs.get((last, token))
                if ok is None:
                    ok = self.compatible(last, token)
                if ok:
                    out.append(token)
                    if end == n:
                        return
                    place, last, token = end, token, longest.get(end, -1)
                    if token < 0:
                        token = longest[end] = next(self.automaton.iter_long(raw, end))[1][0]
                    continue
            token = self.shorter[token]
            if token < 0:
                shut.add(place)
                token = out.pop()
                place -= lengths[token]
                last = out[-1] if len(out) > base else -1

    def encode_words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Ids:
        """Letters, with at most a leading space, are one piece."""
        raw, ids, ends = data.tobytes().decode("latin-1"), [], []
        for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
            self.encode_piece(raw[a:b], ids)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def encode_units(self, units: list[str]) -> Ids:
        ids, ends = [], []
        for unit in units:
            for piece in self.pieces(unit):
                self.encode_piece(piece.encode().decode("latin-1"), ids)
            ends.append(len(ids))
        return np.array(ids, np.uint32), np.diff(np.array(ends, np.int64), prepend=0)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode_all(self, ids: np.ndarray, offsets: np.ndarray) -> Ids:
        """The bytes of the tokens and where each text's begin."""
        out, reach = gather(self.bytes, self.places[ids], self.sizes[ids])
        return out, reach[offsets]

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0].tobytes()


_CODECS: dict[str, LinearBpe] = {}


def codec(path: str) -> LinearBpe:
    if path not in _CODECS:
        import public_tokenizers

        _CODECS[path] = LinearBpe(read_ranks(path), public_tokenizers.PATTERN)
    return _CODECS[path]


def bpe_encode(docs: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken", decode: bool = False) -> DataFrame:
    """doc_id and ids (array of int) of every whole text; with ``decode`` also the bytes
    that those ids decode to, made from the ids in the same task."""
    path = resolve(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                ids, offs = bpe.encode_column(batch.column(1), None)
                out, names = [batch.column(0), ids_column(ids, offs)], ["doc_id", "ids"]
                if decode:
                    out.append(binary_column(*bpe.decode_all(ids, offs)))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names)
        release()

    return documents(docs).mapInArrow(encoded, "doc_id long, ids array<int>" + ", decoded binary" * decode)


def bpe_decode(tokens: DataFrame, vocabulary: str = "byte_bpe_multi_50k.tiktoken") -> DataFrame:
    """doc_id and the decoded bytes of ids (array of int; null: none)."""
    path = resolve(vocabulary)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            rows = batch.column(1)
            sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            offs = np.concatenate([[0], np.cumsum(sizes)])
            yield pa.RecordBatch.from_arrays([batch.column(0), binary_column(*bpe.decode_all(rows.flatten().to_numpy(zero_copy_only=False), offs))], ["doc_id", "decoded"])

    return tokens.select("doc_id", "ids").mapInArrow(decoded, "doc_id long, decoded binary")
