"""Order-preserving packing of token streams into fixed windows by dynamic programming.

Documents are tokenised and laid end to end in doc_id order.  Cuts may fall at document
ends (free), sentence ends (a small penalty) and, so that no stretch is longer than
``STEP`` ids, at further places (a larger penalty).  With p the place and c the penalty
of a cut, to which every sequence adds a cost of its own,

    f(j) = c(j) + min over i, p(j) - p(i) <= size, of f(i) + size - (p(j) - p(i))

so that the minimum over i is that of f(i) + p(i) in a sliding window, held in a monotone
queue.  A window whose length is a power of two needs no padding, which adds one
transition for each power.  Text streams through in chunks; the windows before the best
cut near a chunk's end are final, what follows is carried on.

Defined cases: a null or empty text has only the end id; repeated rows are packed each;
an empty table gives no piece; other columns are not read; every id is in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import binary_column, by_size, documents, ordered_by_id, release
from .units import UnitEncoder, encoder, resolve

SIZE = 2048
SENTENCE, ELSEWHERE, STEP = 2, 24, 64
#: The cost of a sequence: a short one is worth its place only where it saves more padding.
SEQUENCE = 512
CHUNK = 1 << 18
#: Bytes of text that are tokenised together.
SLICE = 4 << 20

PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def cut_places(n: int, doc_ends: np.ndarray, sentence_ends: np.ndarray, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places where n ids may be cut, 0 first, and their penalties."""
    cost = np.full(n + 1, -1, np.int64)
    cost[sentence_ends] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    cost[n] = max(cost[n], 0)
    places = np.flatnonzero(cost >= 0)
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        more = (gaps[wide] - 1) // step
        first = np.repeat(places[wide], more)
        nth = np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more) + 1
        extra = first + step * nth
        cost[extra] = ELSEWHERE
        places = np.flatnonzero(cost >= 0)
    return places, cost[places]


def best_cuts(places: np.ndarray, penalty: np.ndarray, size: int, last: bool, each: int = 0) -> list[int]:
    """Indices of ``places`` to cut at, 0 first, with the cost of each sequence.  If not ``last``, the end is the best
    place among those of the last ``size`` ids, else it is the last place."""
    p, c, n = places.tolist(), (penalty + each).tolist(), len(places)
    # places a power of two before a place, where one may be cut: no padding between them
    number = np.full(int(places[-1]) + 1, -1, np.int32)
    number[places] = np.arange(n)
    pairs = []
    k = 1
    while k <= size:
        first = int(np.searchsorted(places, k))
        before = number[places[first:] - k]
        hit = np.flatnonzero(before >= 0)
        pairs.append(np.stack([hit + first, before[hit]]))
        k *= 2
    later, earlier = np.concatenate(pairs, axis=1)
    order = np.argsort(later, kind="stable")
    earlier = earlier[order].tolist()
    bounds = np.searchsorted(later[order], np.arange(n + 1)).tolist()
    f, back = [0] * n, [0] * n
    # the queue: ascending values of f(i) + p(i) and their places, from head on
    values, at, head = [p[0]], [0], 0
    for j in range(1, n):
        here = p[j]
        low = here - size
        while p[at[head]] < low:
            head += 1
        best, i = values[head] + size - here, at[head]
        for h in earlier[bounds[j] : bounds[j + 1]]:
            if f[h] < best:
                best, i = f[h], h
        best += c[j]
        f[j], back[j] = best, i
        g = best + here
        while len(values) > head and values[-1] >= g:
            values.pop()
            at.pop()
        values.append(g)
        at.append(j)
    j = n - 1
    if not last:
        first = int(np.searchsorted(places, p[-1] - size, "right"))
        j = min(range(max(first, 1), n), key=lambda x: (f[x], -x))
    out = [j]
    while j:
        j = back[j]
        out.append(j)
    return out[::-1]


def sentence_table(enc: UnitEncoder) -> np.ndarray:
    """Whether an id ends a word with a full stop, an exclamation or a question mark."""
    if not hasattr(enc, "ends"):
        vocab = enc.tokenizer.get_vocab(with_added_tokens=True)
        table = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            word = token.removesuffix("</w>")
            table[i] = word != token and word[-1:] in {".", "!", "?"}
        enc.ends = table
    return enc.ends


class Packer:
    """Packs one ordered stream; ``add`` and ``finish`` yield record batches of pieces."""

    def __init__(self, first_id: int, size: int, ends: np.ndarray):
        self.sequence, self.size, self.ends = first_id, size, ends
        self.ids: list[np.ndarray] = []
        self.docs: list[tuple[int, int, int, int]] = []  # doc_id, doc_tokens, start in the document, length here
        self.held = 0

    def add(self, doc_id: int, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.ids.append(ids)
        self.docs.append((doc_id, len(ids), 0, len(ids)))
        self.held += len(ids)
        if self.held >= CHUNK:
            yield self.pack(False)

    def finish(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield self.pack(True)

    def pack(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        docs = np.array(self.docs, np.int64).reshape(-1, 4)
        doc_ends = np.cumsum(docs[:, 3])
        places, penalty = cut_places(len(ids), doc_ends, np.flatnonzero(self.ends[ids]) + 1)
        cuts = places[best_cuts(places, penalty, self.size, last, SEQUENCE)]
        end = int(cuts[-1])
        bounds = np.unique(np.concatenate([cuts, doc_ends[doc_ends < end]]))
        begin, length = bounds[:-1], np.diff(bounds)
        doc = np.searchsorted(doc_ends, begin, "right")
        window = np.searchsorted(cuts, begin, "right") - 1
        doc_begin = doc_ends - docs[:, 3]
        out = pa.RecordBatch.from_arrays([
            pa.array(docs[doc, 0]), pa.array(docs[doc, 2] + begin - doc_begin[doc]), pa.array(length), pa.array(docs[doc, 1]),
            pa.array(self.sequence + window), pa.array(begin - cuts[window]), binary_column(ids[:end].astype("<u4"), 4 * bounds),
        ], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        self.sequence += len(cuts) - 1
        rest = int(np.searchsorted(doc_ends, end, "right"))
        self.docs = [tuple(x) for x in docs[rest:].tolist()]
        if self.docs and end > doc_begin[rest]:
            used = end - int(doc_begin[rest])
            d = self.docs[0]
            self.docs[0] = (d[0], d[1], d[2] + used, d[3] - used)
        self.ids, self.held = [ids[end:]], len(ids) - end
        return out


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, size: int = SIZE) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, doc_tokens, sequence_id, offset, ids
    (binary, little-endian unsigned 32-bit).  Each range of doc_id packs its own stream;
    only the last window of a range is not filled by what follows it."""
    file = resolve(vocabulary)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = encoder(file, False)
        packer = Packer(TaskContext.get().partitionId() << 33, size, sentence_table(enc))
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                ids, ends = enc.encode_column(batch.column(1), end_id)
                for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    yield from packer.add(doc, ids[a:b])
        yield from packer.finish()
        release()

    return ordered_by_id(documents(docs)).mapInArrow(pieces, PIECE_SCHEMA)
