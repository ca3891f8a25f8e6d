"""Cached tokenisation by units that no token crosses.

All public pre-tokenisers used here cut at Unicode white space and between a letter and the
punctuation after it, so a text is cut into units (runs without white space, with at most
one leading space where the vocabulary keeps spaces, and the punctuation that ends a word
as a unit of its own) and every distinct unit is encoded once.  Units are cut, told apart
and looked up as arrays; only what was never seen reaches an encoder.

The table of known units is kept by the Python worker, also from task to task: at most
``CACHE`` units of about 40 bytes beside 50 MB of slots.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from .common import column_bytes
from .words import SPACES, spans, word_hashes

#: Unicode White_Space: fixed values.
SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: A leading space goes with the run after it; of a longer run the last character stays behind.
SPACED = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
BARE = re.compile(f"[^{SPACE}]+")
#: White space to str.split(), but not to Unicode.
SEPARATORS = re.compile("[\x1c-\x1f]")
WIDE = re.compile("[^\x00-\xff]")
CACHE = 1_000_000
#: The table's slots, 2 ** BITS, stay at least two thirds free.
BITS = 22
#: A private-use character; units that hold it are encoded one by one.
MARK = "\ue000"
#: ASCII punctuation.
PUNCTUATION = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])

Ids = tuple[np.ndarray, np.ndarray]


def odd_spaces(data: np.ndarray) -> np.ndarray:
    """Places in UTF-8 bytes of white space beyond ASCII."""
    two = np.flatnonzero(data[:-1] == 0xC2)
    two = two[(data[two + 1] == 0x85) | (data[two + 1] == 0xA0)]
    at = np.flatnonzero((data[:-2] >= 0xE1) & (data[:-2] <= 0xE3)) if len(data) > 2 else two[:0]
    a, b, c = data[at], data[at + 1], data[at + 2]
    general = (b == 0x80) & (((c >= 0x80) & (c <= 0x8A)) | (c == 0xA8) | (c == 0xA9) | (c == 0xAF)) | ((b == 0x81) & (c == 0x9F))
    three = at[((a == 0xE1) & (b == 0x9A) & (c == 0x80)) | ((a == 0xE2) & general) | ((a == 0xE3) & (b == 0x80) & (c == 0x80))]
    return np.concatenate([two, three])


def letter_bytes(data: np.ndarray) -> np.ndarray:
    """Which UTF-8 bytes belong to letters of ASCII or of the Latin-1 block from U+00C0 on."""
    low = data | np.uint8(32)
    out = (low >= 97) & (low <= 122)
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # the signs of multiplication and division
    out[lead] = True
    out[lead + 1] = True
    return out


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Ids:
    """The stretches of ``values`` laid end to end, and their borders."""
    reach = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=reach[1:])
    return values[np.arange(int(reach[-1])) + np.repeat(starts - reach[:-1], sizes)], reach


def glued(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, mark: int | None) -> bytes:
    """Stretches of bytes laid end to end, each followed by ``mark`` if there is one."""
    if mark is None:
        return gather(data, starts, stops - starts)[0].tobytes()
    low, high = int(starts.min()), int(stops.max())
    flat, reach = gather(np.append(data[low:high], np.uint8(mark)), starts - low, stops - starts + 1)
    flat[reach[1:] - 1] = mark
    return flat.tobytes()


class Table:
    """64-bit hashes to numbers from 0 on, by open addressing over arrays."""

    def __init__(self):
        self.keys, self.numbers, self.count = np.zeros(1 << BITS, np.uint64), np.zeros(1 << BITS, np.int32), 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where it is unknown."""
        out = np.full(len(hashes), -1, np.int64)
        slot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            held = self.keys[slot]
            hit = held == hashes[todo]
            out[todo[hit]] = self.numbers[slot[hit]]
            more = ~hit & (held != 0)
            todo, slot = todo[more], (slot[more] + 1) & ((1 << BITS) - 1)
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Number distinct unknown hashes in their order."""
        slot = (hashes >> np.uint64(64 - BITS)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[todo[free]]  # of several for one slot the last stays
            mine = free & (self.keys[slot] == hashes[todo])
            self.numbers[slot[mine]] = self.count + todo[mine]
            todo, slot = todo[~mine], (slot[~mine] + ~free[~mine]) & ((1 << BITS) - 1)
        self.count += len(hashes)


class Units:
    """Texts to unsigned 32-bit ids by a table of units; subclasses encode new units."""

    def __init__(self, spaced: bool):
        self.spaced = spaced
        self.forget()

    def encode_units(self, units: list[str]) -> Ids:
        """The ids of units, one after the other, and how many each has."""
        raise NotImplementedError

    def encode_words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Ids:
        """The same for stretches of bytes of letters, all led by a space or none."""
        raise NotImplementedError

    def forget(self) -> None:
        """Start with an empty table; ids of unit k are pool[at[k] : at[k] + size[k]]."""
        self.table, self.at, self.size, self.pool = Table(), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def units(self, text: str) -> list[str]:
        if self.spaced:
            return SPACED.findall(text)
        return BARE.findall(text) if SEPARATORS.search(text) else text.split()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian; for texts with white space of any kind."""
        rows = [self.units(text) for text in texts]
        distinct = sorted(set().union(*rows))
        ids, sizes = self.encode_units(distinct)
        raw, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
        known = {u: raw[a:b] for u, a, b in zip(distinct, [0, *ends], ends, strict=False)}
        return [b"".join(map(known.__getitem__, row)) for row in rows]

    def cut(self, data: np.ndarray, offsets: np.ndarray, letters: np.ndarray) -> Ids:
        """Starts and ends of units in UTF-8 bytes whose only white space is ASCII."""
        blank = SPACES[data]
        starts, ends = spans(~blank, offsets)
        # where the punctuation at a unit's end begins
        tail = np.maximum.accumulate(np.where(PUNCTUATION[data], 0, np.arange(1, len(data) + 1)))[ends - 1] if len(data) else ends
        parted = (tail < ends) & (tail > starts) & letters[np.maximum(tail - 1, 0)]
        marks, mark_ends = tail[parted], ends[parted]
        ends = np.where(parted, tail, ends)
        if self.spaced:
            texts = np.zeros(len(data) + 1, bool)
            texts[offsets] = True
            led = (starts > 0) & ~texts[starts] & (data[np.maximum(starts - 1, 0)] == 32)
            free = blank.copy()
            free[starts[led] - 1] = False
            # what a leading space leaves of its run is one unit; so is a run at a text's end
            g, h = spans(free, offsets)
            before = np.zeros(len(data) + 1, bool)
            before[starts[~led]] = True
            apart = before[h] & ~texts[h] & (h - g > 1)
            starts = starts - led
            starts, ends = np.concatenate([starts, g, h[apart] - 1]), np.concatenate([ends, h - apart, h[apart]])
        starts, ends = np.concatenate([starts, marks]), np.concatenate([ends, mark_ends])
        order = np.argsort(starts)
        return starts[order], ends[order]

    def encode_column(self, column: pa.Array, end_id: int | None) -> Ids:
        """The ids of all texts of a column, each with the end id if there is one, and
        where each begins."""
        data, offsets = column_bytes(column)
        odd = np.unique(np.searchsorted(offsets, odd_spaces(data), "right") - 1)
        if not len(odd):
            return self.encode_bytes(data, offsets, end_id)
        # texts with other white space go by strings, the rest by arrays
        other = np.ones(len(offsets) - 1, bool)
        other[odd] = False
        flat, reach = gather(data, offsets[:-1][other], np.diff(offsets)[other])
        ids, ends = self.encode_bytes(flat, reach, end_id)
        raw = data.tobytes()
        tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()
        rows = [x + tail for x in self.encode_all([raw[a:b].decode() for a, b in zip(offsets[odd].tolist(), offsets[odd + 1].tolist(), strict=True)])]
        at, size = np.empty(len(offsets) - 1, np.int64), np.empty(len(offsets) - 1, np.int64)
        at[other], size[other] = ends[:-1], np.diff(ends)
        size[odd] = [len(x) // 4 for x in rows]
        at[odd] = len(ids) + np.cumsum(size[odd]) - size[odd]
        return gather(np.concatenate([ids, np.frombuffer(b"".join(rows), "<u4")]), at, size)

    def encode_bytes(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> Ids:
        letters = letter_bytes(data)
        starts, stops = self.cut(data, offsets, letters)
        hashes = word_hashes(data, starts, stops)
        which = self.lookup(data, letters, hashes, starts, stops)
        at, size, pool = self.at, self.size, self.pool
        last = np.searchsorted(starts, offsets[1:])
        if end_id is not None:  # one more unit after each text
            which = np.insert(which, last, len(at))
            at, size, pool = np.append(at, len(pool)), np.append(size, 1), np.append(pool, np.uint32(end_id))
            last = last + np.arange(1, len(last) + 1)
        ids, reach = gather(pool, at[which], size[which])
        return ids, np.concatenate([[0], reach[last]])

    def lookup(self, data: np.ndarray, letters: np.ndarray, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """The number of each unit in the table, which learns those that it doesn't hold."""
        which = self.table.find(hashes)
        missing = np.flatnonzero(which < 0)
        if not len(missing):
            return which
        order = missing[np.argsort(hashes[missing])]
        in_order = hashes[order]
        first = np.ones(len(order), bool)
        first[1:] = in_order[1:] != in_order[:-1]
        new = order[first]
        ids, sizes = self.learn(data, letters, starts[new], stops[new])
        if self.table.count + len(new) > CACHE:  # what this slice uses stays, and no more
            used, spot = np.unique(which[which >= 0], return_inverse=True)
            kept = np.zeros(len(used), np.uint64)
            kept[spot] = hashes[which >= 0]
            self.pool, reach = gather(self.pool, self.at[used], self.size[used])
            self.at, self.size, self.table = reach[:-1], self.size[used], Table()
            self.table.add(kept)
            which[which >= 0] = spot
        begin = self.table.count
        if begin + len(new) <= (1 << BITS) // 2:
            self.table.add(in_order[first])
        self.at = np.concatenate([self.at[:begin], len(self.pool) + np.cumsum(sizes) - sizes])
        self.size = np.concatenate([self.size[:begin], sizes])
        self.pool = np.concatenate([self.pool, ids])
        which[order] = begin + np.cumsum(first) - 1
        return which

    def learn(self, data: np.ndarray, letters: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Ids:
        """The ids of new units: words led by a space, other words, all else."""
        led = data[starts] == 32 if len(starts) else np.zeros(0, bool)
        seen = np.zeros(len(data) + 1, np.int64)
        np.cumsum(letters, out=seen[1:])
        words = (seen[stops] - seen[starts] == stops - starts - led) & (stops - starts > led)
        groups = [np.flatnonzero(words & led), np.flatnonzero(words & ~led), np.flatnonzero(~words)]
        chunks: list[np.ndarray] = []
        sizes = np.zeros(len(starts), np.int64)
        for places in groups[:2]:
            for begin in range(0, len(places), 20_000):
                some = places[begin : begin + 20_000]
                ids, sizes[some] = self.encode_words(data, starts[some], stops[some])
                chunks.append(ids)
        raw = data.tobytes() if len(groups[2]) else b""
        ids, sizes[groups[2]] = self.encode_units([raw[a:b].decode() for a, b in zip(starts[groups[2]].tolist(), stops[groups[2]].tolist(), strict=True)])
        place, begin = np.concatenate(groups), np.empty(len(starts), np.int64)
        begin[place] = np.cumsum(sizes[place]) - sizes[place]
        return gather(np.concatenate([*chunks, ids]), begin, sizes)[0], sizes


class UnitEncoder(Units):
    """New units are encoded by the tokenizers library, many in one text."""

    def __init__(self, path: str, spaced: bool):
        super().__init__(spaced)
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        #: A line feed is a token of its own before and after any unit that may begin with a space.
        self.glue = "\n" if spaced else f" {MARK} "
        #: Latin-1 is in normal form and is lower-cased letter by letter: such units need no normaliser.
        self.plain = None
        if not spaced:
            from tokenizers.normalizers import Sequence

            self.plain = Tokenizer.from_file(path)
            self.plain.encode_special_tokens = True
            self.plain.normalizer = Sequence([])
        self.mark = np.array(self.tokenizer.encode("\n" if spaced else MARK, add_special_tokens=False).ids, np.uint32)
        # whether a token begins a word (a space, as the library writes it) or ends one
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.borders = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.borders[i] = token.startswith("Ġ") if spaced else token.endswith("</w>")

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def ids(self, text: str, plain: bool = False) -> np.ndarray:
        tokenizer = self.plain if plain else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def encode_words(self, data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Ids:
        n = len(starts)
        if not self.spaced:  # a word is one piece, whose last token ends it
            ids = self.ids(glued(data, starts, stops, 10).decode().lower(), True)
            cuts = np.flatnonzero(self.borders[ids]) + 1
        elif data[starts[0]] == 32:  # and here its first token begins with the space
            ids = self.ids(glued(data, starts, stops, None).decode())
            cuts = np.append(np.flatnonzero(self.borders[ids]), len(ids))[1:]
        else:
            ids = self.ids(glued(data, starts, stops, 10).decode())
            marks = np.flatnonzero(ids == self.mark[0])
            ids, cuts = np.delete(ids, marks), marks - np.arange(len(marks))
        if len(cuts) != n:
            raise ValueError("the borders of words were not found in the ids")
        return ids, np.diff(cuts, prepend=0)

    def encode_units(self, units: list[str]) -> Ids:
        easy = np.array([MARK not in u and (not self.spaced or BARE.search(u) is not None) for u in units], bool)
        latin = np.array([self.plain is not None and WIDE.search(u) is None for u in units], bool)
        chunks, order = [np.zeros(0, np.uint32)], []
        sizes = np.zeros(len(units), np.int64)
        for plain in (True, False):
            places = np.flatnonzero(easy & (latin == plain))
            for begin in range(0, len(places), 20_000):
                some = places[begin : begin + 20_000]
                ids, sizes[some] = self.marked([units[k] for k in some.tolist()], plain)
                chunks.append(ids)
                order.append(some)
        for k in np.flatnonzero(~easy).tolist():
            chunks.append(self.ids(units[k]))
            sizes[k] = len(chunks[-1])
            order.append(np.array([k]))
        begin = np.zeros(len(units), np.int64)
        if order:
            place = np.concatenate(order)
            begin[place] = np.cumsum(sizes[place]) - sizes[place]
        return gather(np.concatenate(chunks), begin, sizes)[0], sizes

    def marked(self, units: list[str], plain: bool) -> Ids:
        """Units laid into one text with marks between, which are found in the ids."""
        text = self.glue.join(units)
        ids = self.ids(text.lower() if plain else text, plain)
        m = len(self.mark)
        hit = ids[: max(0, len(ids) - m + 1)] == self.mark[0]
        for k in range(1, m):
            hit &= ids[k : len(ids) - m + 1 + k] == self.mark[k]
        cuts = np.flatnonzero(hit)
        if len(cuts) != len(units) - 1:
            raise ValueError("the mark between units was not found in the ids")
        ids = np.delete(ids, (cuts[:, None] + np.arange(m)).ravel())
        return ids, np.diff(cuts - m * np.arange(len(cuts)), prepend=0, append=len(ids))


_ENCODERS: dict[tuple[str, bool], UnitEncoder] = {}


def encoder(path: str, spaced: bool) -> UnitEncoder:
    """The worker's encoder for a vocabulary file; files are read where the worker runs."""
    if (path, spaced) not in _ENCODERS:
        _ENCODERS[path, spaced] = UnitEncoder(path, spaced)
    return _ENCODERS[path, spaced]


def resolve(name: str) -> str:
    """The path of a public vocabulary by name; an absolute path stands for itself."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
