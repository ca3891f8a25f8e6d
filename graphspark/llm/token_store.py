"""Token-ID output: shards of ids compressed by a Re-Pair grammar.

Texts are tokenised in ascending doc_id order and written as shards.  A shard replaces
frequent pairs of adjacent symbols by nonterminals, again and again, the most frequent
first, and stores

    header      magic, bytes of a symbol, first nonterminal, counts (little-endian unsigned 32-bit)
    rules       two symbols a rule
    lengths     the expansion length of every rule, unsigned 32-bit
    doc ids     signed 64-bit
    offsets     where each document starts in the symbols, and in the ids
    symbols     unsigned 16-bit, or 32-bit where the vocabulary leaves too few nonterminals

It ends when no pair is left whose rule is shorter than what it replaces, or when no
nonterminal is free.  No pair crosses a document, so one document, or any range of its
ids, is decoded without the rest of the shard.  Shards are rows of a Parquet table, so that
any store that Spark can write to will hold them.

Defined cases: a null or empty text has only the end id; repeated rows are stored each;
an empty table gives no shard; other columns of the input are not read; an id that the
vocabulary doesn't have is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, by_size, documents, ordered_by_id, release, scratch
from .units import encoder, resolve

MAGIC = 0x52505232
BINS = 18
#: A round takes pairs down to this part of the most frequent one.
DROP = 4
SHARD_IDS = 1 << 20
#: Bytes of text that are tokenised together.
SLICE = 4 << 20

SHARD_SCHEMA = "part int, shard int, before long, first_doc long, n_docs int, n_ids long, payload binary"


@dataclass(frozen=True)
class Layout:
    """Nonterminals begin at ``first``; a symbol takes ``width`` bytes."""

    first: int
    width: int

    @property
    def kind(self) -> str:
        return f"<u{self.width}"

    @property
    def space(self) -> int:
        return (1 << 8 * self.width) - self.first

    @property
    def least(self) -> int:
        """A rule takes two symbols and a length, and each use of it saves one symbol: fewer
        uses than this make a shard no shorter."""
        return (2 * self.width + 4) // self.width + 1


def layout(vocabulary: int) -> Layout:
    """16-bit symbols where at least 4096 nonterminals find room above the vocabulary."""
    return Layout(vocabulary, 2 if vocabulary + 4096 <= 1 << 16 else 4)


def hashed(pair: np.ndarray, width: int) -> np.ndarray:
    """A hash of BINS bits."""
    wide, odd = (np.uint32, 0x9E3779B1) if width == 2 else (np.uint64, 0x9E3779B97F4A7C15)
    return ((pair * wide(odd)) >> wide(16 * width - BINS)).astype(np.int64)


def joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """Two symbols as one number."""
    wide = np.uint32 if width == 2 else np.uint64
    pair = left.astype(wide)
    pair <<= wide(8 * width)
    pair |= right
    return pair


def counted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and how often each is found."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[: len(values)])
    return values[first], np.diff(np.append(first, len(values)))


def without_overlap(near: np.ndarray, rule: np.ndarray) -> np.ndarray:
    """Which of some ascending places to replace, given which of them are followed by the
    next one and their rules: of places in a row with one rule every second from the left,
    else that of the smaller rule."""
    same = near & (rule[1:] == rule[:-1])
    at = np.arange(len(rule))
    at[1:][same] = 0
    take = (np.arange(len(rule)) - np.maximum.accumulate(at)) & 1 == 0
    clash = np.flatnonzero(near & ~same)
    clash = clash[take[clash] & take[clash + 1]]
    first = rule[clash] < rule[clash + 1]
    take[clash[~first]] = False
    take[clash[first] + 1] = False
    return take


def chosen(near: np.ndarray, pair: np.ndarray, twins: np.ndarray, floor: int, room: int, form: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What a round replaces, given the pairs at some ascending places, which of these are
    followed by the next one, and which hold one symbol twice: (places taken, as a mask, the
    number of the rule at each of them, the rules' pairs, places of frequent pairs).

    The most frequent pairs come first and keep their places where two compete, so that at
    least one pays if any is frequent.  A bin names one pair; others of it wait a round.
    """
    found, times = counted(pair)
    if twins.any():  # of a symbol with itself only every second place counts
        rule = np.searchsorted(found, pair[twins])
        spots = np.flatnonzero(twins)
        times[rule] = 0
        rule, uses = counted(rule[without_overlap((spots[1:] == spots[:-1] + 1) & near[spots[:-1]], rule)])
        times[rule] = uses
    good = np.flatnonzero(times >= floor)
    pairs = found[good[np.argsort(-times[good], kind="stable")]]
    number = np.full(1 << BINS, -1, np.int32)
    number[hashed(pairs, form.width)[::-1]] = np.arange(len(pairs) - 1, -1, -1, dtype=np.int32)
    rule = number[hashed(pair, form.width)]
    often = rule >= 0
    exact = often.copy()
    if len(pairs):
        exact &= pairs[rule] == pair
    take = exact & (rule < room)
    spots = np.flatnonzero(take)
    rule = rule[spots]
    free = without_overlap((spots[1:] == spots[:-1] + 1) & near[spots[:-1]], rule)
    spots, rule = spots[free], rule[free]
    pays = np.bincount(rule, minlength=len(pairs)) >= form.least
    spots, rule = spots[pays[rule]], rule[pays[rule]]
    take[:] = False
    take[spots] = True
    return take, (np.cumsum(pays) - 1)[rule], pairs[pays], often


def compress(ids: np.ndarray, offsets: np.ndarray, form: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, their document offsets, rules) of ids cut into documents at offsets.

    First rounds count all pairs and take those found at least a quarter as often as the
    most frequent one, so that rare pairs don't break up or use up what frequent ones need.
    Once the least frequency is reached, only places of frequent pairs and those beside new
    symbols can hold a frequent pair: later rounds look at these alone, in a linked list.
    """
    seq, offs = ids.astype(form.kind), offsets.astype(np.int64)
    rules: list[np.ndarray] = []
    made, floor = 0, 0
    while len(seq) > 1 and made < form.space:
        pair = joined(seq[:-1], seq[1:], form.width)
        spot = hashed(pair, form.width)
        ends = offs[1:-1] - 1
        ends = ends[(ends >= 0) & (ends < len(pair)) & np.append(ends[1:] != ends[:-1], True)[: len(ends)]]
        counts = np.bincount(spot, minlength=1 << BINS) - np.bincount(spot[ends], minlength=1 << BINS)
        floor = max(form.least, min(int(counts.max()), floor or 1 << 62) // DROP)
        often = (counts >= floor)[spot]
        often[ends] = False
        hot = np.flatnonzero(often)
        if floor == form.least:
            seq, offs, more = finish(seq, offs, hot, form, made)
            rules += more
            break
        take, rule, pairs, _ = chosen(hot[1:] == hot[:-1] + 1, pair[hot], seq[hot] == seq[hot + 1], floor, form.space - made, form)
        places = hot[take]
        rules.append(pairs)
        seq = seq.copy()
        seq[places] = (form.first + made + rule).astype(form.kind)
        stay = np.ones(len(seq), bool)
        stay[places + 1] = False
        offs = offs - np.searchsorted(places + 1, offs)
        seq, made = seq[stay], made + len(pairs)
    every = np.concatenate(rules) if rules else np.zeros(0, np.uint32)
    low = (1 << 8 * form.width) - 1
    return seq, offs, np.stack([every >> every.dtype.type(8 * form.width), every & every.dtype.type(low)], axis=1).astype(form.kind)


def finish(seq: np.ndarray, offs: np.ndarray, hot: np.ndarray, form: Layout, made: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Rounds until no pair pays or no nonterminal is free; ``hot`` are the places that can
    hold a frequent pair."""
    n, rules = len(seq), []
    seq = np.append(seq, seq[:1])
    after, before, alive = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), np.ones(n + 1, bool)
    after[offs[1:][offs[1:] > 0] - 1] = n  # no pair crosses documents
    before[offs[:-1]] = n
    while len(hot) and made < form.space:
        follows = after[hot]
        take, rule, pairs, often = chosen(follows[:-1] == hot[1:], joined(seq[hot], seq[follows], form.width), seq[hot] == seq[follows], form.least, form.space - made, form)
        if not len(pairs):
            break
        places, gone = hot[take], follows[take]
        seq[places] = (form.first + made + rule).astype(form.kind)
        alive[gone] = False
        after[places] = after[gone]
        before[after[gone]] = places
        rules.append(pairs)
        made += len(pairs)
        hot = np.sort(np.concatenate([hot[often], places, before[places]]))
        hot = hot[np.append(hot[1:] != hot[:-1], True) & (hot < n)]
        hot = hot[alive[hot] & (after[hot] < n)]
    place = np.zeros(n + 1, np.int64)
    np.cumsum(alive[:n], out=place[1:])
    return seq[:n][alive[:n]], place[offs], rules


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """The ids that symbols stand for, one level of rules after the other."""
    seq = symbols
    while len(rules):
        big = seq >= first
        if not big.any():
            break
        width = 1 + big.astype(np.int64)
        at = np.cumsum(width) - width
        out = np.empty(int(width.sum()), seq.dtype)
        out[at[~big]] = seq[~big]
        both = rules[seq[big].astype(np.int64) - first]
        out[at[big]], out[at[big] + 1] = both[:, 0], both[:, 1]
        seq = out
    return seq


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """How many ids each rule stands for; a rule refers only to earlier ones."""
    lengths = np.zeros(len(rules), np.int64)
    begin = 0
    while begin < len(rules):
        # a stretch of rules that refer only to rules before it
        later = np.flatnonzero((rules[begin:] >= first + begin).any(axis=1))
        end = begin + int(later[0]) if len(later) else len(rules)
        if end == begin:
            raise ValueError("a rule refers to itself or to a later one")
        sides = rules[begin:end].astype(np.int64) - first
        lengths[begin:end] = np.where(sides >= 0, lengths[np.maximum(sides, 0)], 1).sum(axis=1)
        begin = end
    return lengths


def pack_shard(doc_ids: np.ndarray, ids: np.ndarray, offsets: np.ndarray, form: Layout) -> bytes:
    if len(ids) and int(ids.max()) >= form.first:
        raise ValueError(f"id {int(ids.max())} is not below {form.first}, the first nonterminal")
    symbols, starts, rules = compress(ids, offsets, form)
    head = np.array([MAGIC, form.width, form.first, len(doc_ids), len(rules), len(symbols), len(ids)], "<u4")
    return b"".join(x.tobytes() for x in (
        head, rules, expansion_lengths(rules, form.first).astype("<u4"), doc_ids.astype("<i8"),
        starts.astype("<u4"), offsets.astype("<u4"), symbols,
    ))


class Shard:
    """A shard read back; documents decode one by one or all at once."""

    def __init__(self, payload: bytes):
        magic, width, self.first, n_docs, n_rules, n_symbols, self.n_ids = (int(x) for x in np.frombuffer(payload, "<u4", 7))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, n, at)
            at += out.nbytes
            return out

        self.rules = take(f"<u{width}", 2 * n_rules).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.doc_ids = take("<i8", n_docs)
        self.starts = take("<u4", n_docs + 1).astype(np.int64)
        self.offsets = take("<u4", n_docs + 1).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols)
        self.table: tuple[np.ndarray, ...] | None = None

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for."""
        rule = symbols.astype(np.int64) - self.first
        return np.where(rule >= 0, self.lengths[np.maximum(rule, 0)], 1) if len(self.lengths) else np.ones(len(symbols), np.int64)

    def document(self, row: int) -> np.ndarray:
        return expand(self.symbols[self.starts[row] : self.starts[row + 1]], self.rules, self.first).astype(np.uint32)

    def slice(self, row: int, start: int, length: int) -> np.ndarray:
        """Ids [start, start + length) of a document, by the expansion lengths."""
        symbols = self.symbols[self.starts[row] : self.starts[row + 1]]
        ends = np.cumsum(self.sizes(symbols))
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, start + length, "left")) + 1
        before = int(ends[a - 1]) if a else 0
        return expand(symbols[a:b], self.rules, self.first)[start - before : start - before + length].astype(np.uint32)

    def all(self) -> np.ndarray:
        """All ids: every rule is expanded once, then copied for each of its uses."""
        if not len(self.rules):
            return self.symbols.astype(np.uint32)
        pool = expand(np.arange(self.first, self.first + len(self.rules)).astype(self.symbols.dtype), self.rules, self.first)
        begin = np.cumsum(self.lengths) - self.lengths
        rule = self.symbols.astype(np.int64) - self.first
        big = rule >= 0
        sizes = self.sizes(self.symbols)
        at = np.cumsum(sizes) - sizes
        out = np.empty(int(sizes.sum()), np.uint32)
        out[at[~big]] = self.symbols[~big]
        rule, at, sizes = rule[big], at[big], sizes[big]
        shift = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[np.repeat(at, sizes) + shift] = pool[np.repeat(begin[rule], sizes) + shift]
        return out


def write_token_shards(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, shard_ids: int = SHARD_IDS) -> None:
    """Tokenise ``docs`` (doc_id, text) in doc_id order and write shards to ``path``."""
    file = resolve(vocabulary)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        enc = encoder(file, True)
        form = layout(max(len(enc.borders), end_id + 1))
        names: list[int] = []
        parts: list[np.ndarray] = []
        held = before = 0

        def flush() -> pa.RecordBatch:
            nonlocal shard, names, parts, held, before
            ids = np.concatenate(parts)
            offsets = np.zeros(len(parts) + 1, np.int64)
            np.cumsum([len(x) for x in parts], out=offsets[1:])
            payload = pack_shard(np.array(names, np.int64), ids, offsets, form)
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "shard": pa.array([shard], pa.int32()), "before": pa.array([before], pa.int64()), "first_doc": pa.array([names[0]], pa.int64()), "n_docs": pa.array([len(names)], pa.int32()), "n_ids": pa.array([len(ids)], pa.int64()), "payload": pa.array([payload], pa.binary())})
            shard, names, parts, held, before = shard + 1, [], [], 0, before + len(ids)
            return out

        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                ids, ends = enc.encode_column(batch.column(1), end_id)
                for doc, a, b in zip(batch.column(0).to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    names.append(doc)
                    parts.append(ids[a:b])
                    held += b - a
                    if held >= shard_ids:
                        yield flush()
        if names:
            yield flush()
        release()

    ordered_by_id(documents(docs)).mapInArrow(shards, SHARD_SCHEMA).write.parquet(path)


def read_token_shards(spark, path: str) -> DataFrame:
    """One row per document of the shards at ``path``: doc_id, start, n_tokens, ids
    (binary, little-endian unsigned 32-bit).  ``start`` counts the ids of all documents
    before it: a shard tells those of its own range of ids, and one sum per range (as many
    as the ranges the writer made, never rows or shards) is added from the driver."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    base, total = {}, 0
    for row in shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect():
        base[row.part], total = total, total + row.n

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for payload, part, before in zip(batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                ids, offs = shard.all(), shard.offsets
                yield pa.RecordBatch.from_arrays([
                    pa.array(shard.doc_ids), pa.array(base[part] + before + offs[:-1]), pa.array(np.diff(offs)), binary_column(ids.astype("<u4"), 4 * offs),
                ], ["doc_id", "start", "n_tokens", "ids"])

    return shards.select("payload", "part", "before").mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def store_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0) -> DataFrame:
    """Write shards to the shared folder and read every document back from them."""
    path = scratch(docs.sparkSession, "tokens")
    write_token_shards(docs, path, vocabulary, end_id)
    return read_token_shards(docs.sparkSession, path)
