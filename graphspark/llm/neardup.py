"""Near duplicates by SuperMinHash, banding, exact verification and components.

1. Every document's set of shingles gives a fingerprint, a SuperMinHash signature and from
   it one hash per band.  Documents with equal sets form a class, which its least doc_id
   stands for; only these go on.
2. Within every bucket of a band the members' signatures are compared, in blocks of
   ``BLOCK`` members: two members whose signatures agree in nearly as many slots as the
   asked similarity promises are candidates.  A bucket returns only a forest of candidates,
   never all pairs.  Members that share a bucket by chance part here, so chains of chance
   don't join what has nothing in common.
3. Components of the candidates are groups.  In a group of up to ``BLOCK`` members all pairs
   are compared on their full sets.  A larger one falls into blocks, which are compared with
   ``HUBS`` of its members first: near copies of one text are connected by that alone, with
   work that grows with their number.  Only members outside the largest connected part are
   then compared with all blocks.  A task holds two blocks, never a whole group, and returns
   only which members are connected by true links.
4. Components of these give the result, which the classes hand to all their documents.

Bands and rows follow from the similarity (``banding``): a pair at it shares no bucket with
a probability of 1e-5 at most.  The slots that must agree are six standard deviations below
what is expected at it.  Low similarities need more bands, up to ``SLOTS`` in all.

Defined cases: a null or empty text, or one without words, has an empty set, is linked with
nothing and stays; a text of fewer words than a shingle is one shingle; rows that share a
doc_id share its component; a null doc_id counts as -1, and such rows always stay; an empty
table gives an empty result; extra columns are not read by ``near_duplicates`` and are kept
as they are by ``keep_first``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_column, by_size, column_bytes, documents, partitions, release, stored
from .components import components
from .superminhash import band_hashes, signatures
from .words import LOWER, mix, window_hashes, word_hashes, word_spans

SLOTS, MISSED, BLOCK, HUBS, COLUMNS = 160, 1e-5, 1024, 4, 4096
SLICE = 1 << 20


def banding(share: int) -> tuple[int, int]:
    """(bands, rows) for a similarity of share / 100: as many rows as fit ``SLOTS`` slots
    while a pair at that similarity is missed with a probability of ``MISSED`` at most."""
    if not 20 <= share <= 100:
        raise ValueError("a similarity from 20 to 100 hundredths")
    s = share / 100
    fit = [(SLOTS // rows, rows) for rows in range(1, 9) if (1 - s**rows) ** (SLOTS // rows) <= MISSED]
    return fit[-1]


def least_equal(share: int, slots: int) -> int:
    """Slots that agree at that similarity but for six standard deviations."""
    s = share / 100
    return max(1, math.floor(slots * s - 6 * math.sqrt(slots * s * (1 - s))))


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, ascending, and where each text's begin."""
    data, offsets = column_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    windows = window_hashes(words, width)
    # windows that begin in a text and end in the next are none
    owner = np.repeat(np.arange(len(counts)), counts)
    inside = owner[: len(windows)] == owner[len(words) - len(windows) :]
    values, whose = windows[inside], owner[: len(windows)][inside]
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        one = np.array([mix(words[first[k] : first[k + 1]] + np.arange(1, counts[k] + 1, dtype=np.uint64)).sum(dtype=np.uint64) for k in short], np.uint64)
        values, whose = np.concatenate([values, one]), np.concatenate([whose, short])
    order = np.lexsort((values, whose))
    values, whose = values[order], whose[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (whose[1:] != whose[:-1])
    values, whose = values[new], whose[new]
    return values, np.searchsorted(whose, np.arange(len(counts) + 1))


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (f1, f2), its band hashes and its signature,
    a byte a slot."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                values, offs = shingle_sets(batch.column(1), width)
                n = np.diff(offs)
                full = n > 0
                prints = []
                for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
                    sums = np.zeros(len(values) + 1, np.uint64)
                    np.cumsum(mix(values ^ np.uint64(salt)), out=sums[1:])
                    prints.append((sums[offs[1:]] - sums[offs[:-1]]).view(np.int64))
                slots = signatures(values, offs, bands * rows)
                marks = band_hashes(slots, bands).view(np.int64)
                short = (mix(slots) >> np.uint64(56)).astype(np.uint8)
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(np.where(full, bands, 0), out=ends[1:])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), pa.array(n.astype(np.int64)), pa.array(prints[0]), pa.array(prints[1]),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(marks[full].reshape(-1))),
                    binary_column(short, np.arange(len(n) + 1) * short.shape[1]),
                ], ["doc_id", "n_shingles", "f1", "f2", "bands", "signature"])
            release()

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, f1 long, f2 long, bands array<long>, signature binary")


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, share: int) -> np.ndarray:
    """The least place each place is connected with by links between ``left`` and ``right``
    places (the same, for one block): 100 * intersection >= share * union."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times[column] > 1
    number = np.cumsum(times > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    spot = np.full((2, len(sets)), -1)
    spot[0, left], spot[1, right] = np.arange(len(left)), np.arange(len(right))
    total = int(times[times > 1].size)
    for begin in range(0, total, COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + COLUMNS])
        who, col = owner[a:b], column[a:b] - begin
        wide = min(COLUMNS, total - begin)
        sides = []
        for side, places in ((0, left), (1, right)):
            m = np.zeros((len(places), wide), np.float32)
            mine = spot[side, who] >= 0
            m[spot[side, who[mine]], col[mine]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    inter = common.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - inter
    near = 100 * inter >= share * union
    root = np.arange(len(sets))
    adjacent: list[list[int]] = [[] for _ in sets]
    for i, j in zip(*np.nonzero(near), strict=True) if near.sum() < 50_000 else []:
        adjacent[left[i]].append(int(right[j]))
        adjacent[right[j]].append(int(left[i]))
    dense = near.sum() >= 50_000
    seen = np.zeros(len(sets), bool)
    for start in range(len(sets)):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        for v in queue:
            if dense:
                next_ = np.zeros(len(sets), bool)
                if spot[0, v] >= 0:
                    next_[right[near[spot[0, v]]]] = True
                if spot[1, v] >= 0:
                    next_[left[near[:, spot[1, v]]]] = True
                found = np.flatnonzero(next_ & ~seen).tolist()
            else:
                found = [u for u in dict.fromkeys(adjacent[v]) if not seen[u]]
            seen[found] = True
            queue += found
        root[queue] = start
    return root


PAIRED = ["grp", "i", "j", "side", "doc_id", "shingles"]


def verify(members: DataFrame, share: int) -> DataFrame:
    """True links (u, v) within groups.  members: ``PAIRED``, where i and j name what is
    compared, and side is 0 on the left, 1 on the right, 2 on both."""

    def links(rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        side = rows.column("side").to_numpy()[order]
        raw = rows.column("shingles").to_pylist()
        sets = [np.frombuffer(raw[k], np.uint64) for k in order.tolist()]
        root = linked(sets, np.flatnonzero(side != 1), np.flatnonzero(side != 0), share)
        tied = ids != ids[root]
        release()
        return pa.table({"u": pa.array(ids[tied]), "v": pa.array(ids[root[tied]])})

    return members.select(*PAIRED).groupBy("grp", "i", "j").applyInArrow(links, "u long, v long")


def links_of_large(big: DataFrame, share: int, block: int) -> DataFrame:
    """Links that connect the members (doc_id, grp, n_blocks, block, shingles) of groups of
    several blocks.  What is known of a group is joined by group and block, so that a group
    of any size spreads over many tasks."""
    whole = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    flag = lambda k: F.lit(k).alias("side")
    chosen = [F.min_by("doc_id", F.xxhash64("doc_id", F.lit(k))) for k in range(HUBS)]
    hubs = big.groupBy("grp").agg(F.array_distinct(F.array(*chosen)).alias("hubs"), F.max("n_blocks").alias("n_blocks")).select("grp", "n_blocks", F.explode("hubs").alias("doc_id"))
    right = hubs.join(big.select("doc_id", "shingles"), "doc_id").select("grp", whole("n_blocks").alias("i"), F.lit(-1).alias("j"), flag(1), "doc_id", "shingles")
    left = big.select("grp", F.col("block").alias("i"), F.lit(-1).alias("j"), flag(0), "doc_id", "shingles")
    first = stored(verify(left.unionByName(right), share), "links")

    # the members outside the largest part of their group
    label = components(first)
    told = big.select("doc_id", "grp", "n_blocks", "block").join(label, F.col("doc_id") == F.col("node"), "left").withColumn("label", F.coalesce("root", "doc_id"))
    told = stored(told.select("doc_id", "grp", "n_blocks", "block", "label"), "parts")
    counts = told.groupBy("grp", "label").agg(F.count("*").alias("n"), F.max("n_blocks").alias("n_blocks"))
    best = counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("best"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max("n_blocks").alias("n_blocks"))
    known = best.where("most < all").select("grp", "best", F.ceil((F.col("all") - F.col("most")) / F.lit(block)).cast("int").alias("r_blocks"), whole("n_blocks").alias("block"))
    known = stored(known, "rests")
    rest = told.join(known, ["grp", "block"]).where("label <> best").select("doc_id", "grp", "n_blocks", F.expr("cast(pmod(xxhash64(doc_id, 7), r_blocks) as int)").alias("i"))
    left = rest.join(big.select("doc_id", "shingles"), "doc_id").select("grp", "i", whole("n_blocks").alias("j"), flag(0), "doc_id", "shingles")
    right = big.join(known, ["grp", "block"]).select("grp", whole("r_blocks").alias("i"), F.col("block").alias("j"), flag(1), "doc_id", "shingles")
    return first.unionByName(verify(left.unionByName(right), share))


def forest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that connect what the matrix ``near`` of left and right members connects: at
    most one for each member."""
    u, v, seen, open_ = [], [], set(), np.ones(len(right), bool)
    for start in range(len(left)):
        if start in seen:
            continue
        seen.add(start)
        queue = [start]
        for i in queue:
            fresh = np.flatnonzero(near[i] & open_)
            open_[fresh] = False
            u += [left[i]] * len(fresh)
            v += right[fresh].tolist()
            if len(fresh):
                for k in np.flatnonzero(near[:, fresh].any(axis=1)).tolist():
                    if k not in seen:
                        seen.add(k)
                        queue.append(k)
                        u.append(left[k])
                        v.append(int(right[fresh[np.argmax(near[k, fresh])]]))
    return u, v


def candidates(shared: DataFrame, slots: int, least: int) -> DataFrame:
    """Ties (u, v) within buckets.  shared: bucket, i, j (a pair of blocks), block, rep and
    signature, all rows of a bucket and pair of blocks in one partition and in a row."""

    def ties(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compared(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            keys, block, rep, marks = (np.concatenate(x) for x in zip(*rows, strict=True))
            cuts = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1)))
            sizes = np.diff(np.append(cuts, len(keys)))
            u, v = [], []
            two = cuts[sizes == 2]  # most buckets: all of them at once
            same = (marks[two] == marks[two + 1]).sum(axis=1) >= least if len(two) else np.zeros(0, bool)
            u.append(rep[two[same]])
            v.append(rep[two[same] + 1])
            for a, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                i, j = int(keys[a, 1]), int(keys[a, 2])
                here = block[a : a + n]
                left, right = a + np.flatnonzero(here == i), a + np.flatnonzero(here == j)
                equal = np.zeros((len(left), len(right)), np.int16)
                for k in range(slots):
                    equal += marks[left, k][:, None] == marks[right, k][None, :]
                near = equal >= least
                if i == j:
                    np.fill_diagonal(near, False)
                x, y = forest(near, rep[left].tolist(), rep[right])
                u.append(np.array(x, np.int64))
                v.append(np.array(y, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
            keys = np.stack(columns[:3], axis=1).astype(np.int64)
            marks = column_bytes(batch.column(5))[0].reshape(-1, slots)
            rows = (keys, columns[3], columns[4], marks)
            # the last bucket may go on in the next batch
            ends = np.flatnonzero((keys != keys[-1]).any(axis=1))
            cut = int(ends[-1]) + 1 if len(ends) else 0
            if cut or (held and (held[-1][0][-1] != keys[0]).any()):
                if not cut:
                    yield from compared(held)
                    held = [rows]
                else:
                    yield from compared([*held, tuple(x[:cut] for x in rows)])
                    held = [tuple(x[cut:] for x in rows)]
            else:
                held.append(rows)
        if held:
            yield from compared(held)
        release()

    return shared.mapInArrow(ties, "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 5, share: int = 80, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id reachable by links of similarity
    share / 100 or more) and kept, for every document."""
    bands, rows = banding(share)
    docs = documents(docs)
    marked = stored(signed(docs, width, bands, rows), "signatures")
    classes = marked.where("n_shingles > 0").groupBy("f1", "f2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.min_by(F.struct("bands", "signature"), "doc_id").alias("_s"))
    classes = stored(classes.select("f1", "f2", "n_shingles", "rep", "_s.bands", "_s.signature"), "classes")
    spread = classes.select("rep", F.explode("bands").alias("bucket"))
    hubs = spread.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket", F.ceil(F.col("n") / block).cast("int").alias("n_blocks"))
    shared = spread.join(hubs, "bucket").withColumn("block", F.expr("cast(pmod(xxhash64(rep), n_blocks) as int)"))
    shared = shared.hint("merge").join(classes.select("rep", "signature"), "rep").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    shared = shared.select("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rep", "signature")
    dealt = shared.repartition(partitions(docs.sparkSession), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    ties = candidates(dealt, bands * rows, least_equal(share, bands * rows))
    groups = components(ties)
    sizes = groups.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("n_blocks"))
    parts = groups.join(sizes, "root").select(
        F.col("node").alias("doc_id"), F.col("root").alias("grp"), "n_blocks", F.expr("cast(pmod(xxhash64(node), n_blocks) as int)").alias("block")
    )

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in by_size(whole, "text", SLICE):
                values, offs = shingle_sets(batch.column(batch.schema.get_field_index("text")), width)
                raw = values.tobytes()
                sets = [raw[8 * a : 8 * b] for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(sets, pa.binary())], ["doc_id", "grp", "n_blocks", "block", "shingles"])

    # sorted on both sides at any size, so that what is moved grows with the input and no faster
    sets = docs.hint("merge").join(parts, "doc_id").select("doc_id", "grp", "n_blocks", "block", "text").mapInArrow(with_sets, "doc_id long, grp long, n_blocks int, block int, shingles binary")
    sets = stored(sets, "sets")
    small = sets.where("n_blocks = 1").select("grp", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("side"), "doc_id", "shingles")
    links, big = verify(small, share), sets.where("n_blocks > 1")
    if not big.isEmpty():
        links = links.unionByName(links_of_large(big, share, block))
    roots = components(links)
    named = classes.join(roots, classes.rep == roots.node, "left").select("f1", "f2", "n_shingles", F.coalesce("root", "rep").alias("class_root"))
    out = marked.drop("bands", "signature").join(named, ["f1", "f2", "n_shingles"], "left")
    return out.select("doc_id", "n_shingles", F.coalesce("class_root", "doc_id").alias("component_id")).withColumn("kept", F.col("doc_id") == F.col("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **parameters: int) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose document is the first of its component."""
    later = near_duplicates(docs, **parameters).where("NOT kept").select(F.col("doc_id").alias("_later_id")).distinct()
    return docs.join(later, docs[id_col] == later["_later_id"], "left_anti")
