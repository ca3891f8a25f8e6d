"""Long grammars, broken chains of pages, and samples of other widths."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from graphspark.llm import tiff, token_store


def test_no_frequent_pair_is_left():
    """A passage copied often becomes one symbol, however long it is."""
    passage = np.random.default_rng(5).permutation(4000)[:1000]
    ids = np.tile(np.append(passage, 0), 40).astype(np.uint32)
    offsets = np.arange(0, len(ids) + 1, 1001)
    form = token_store.layout(50_257)
    symbols, starts, rules = token_store.compress(ids, offsets, form)
    assert (token_store.expand(symbols, rules, form.first) == ids).all()
    inside = np.setdiff1d(np.arange(len(symbols) - 1), starts[1:-1] - 1)
    pairs = symbols[inside].astype(np.int64) << 16 | symbols[inside + 1]
    assert not len(pairs) or np.unique(pairs, return_counts=True)[1].max() < form.least
    assert token_store.expansion_lengths(rules, form.first).max() > 64


def _links(media):
    """Where each directory's address is written."""
    at, out = 4, []
    while (place := struct.unpack_from("<I", media, at)[0]):
        out.append(at)
        at = place + 2 + 12 * struct.unpack_from("<H", media, place)[0]
    return [*out, at]


def test_pages_before_a_fault_are_kept():
    payload = np.random.default_rng(2).integers(0, 256, 57600, dtype=np.uint8).tobytes()
    good = tiff.encode_tiff(payload)
    links = _links(good)
    n = len(links) - 1
    first = struct.unpack_from("<I", good, 4)[0]
    assert n > 2
    for target in (first, len(good) + 100):
        bad = bytearray(good)
        struct.pack_into("<I", bad, links[-1], target)
        pages = list(tiff.decode_pages(bytes(bad)))
        assert b"".join(p["pixels"] for p in pages[:-1]) == payload
        assert [bool(p["error"]) for p in pages] == [False] * n + [True]
        assert [p["page"] for p in pages] == list(range(n + 1)) and {p["n_pages"] for p in pages} == {n + 1}
    bad = bytearray(good)
    struct.pack_into("<HHII", bad, struct.unpack_from("<I", good, links[1])[0] + 2, 256, 4, 1 << 20, len(good))
    assert [bool(p["error"]) for p in tiff.decode_pages(bytes(bad))] == [False, True] + [False] * (n - 2)


@pytest.mark.parametrize("mirrored", [False, True])
@pytest.mark.parametrize("bits", [1, 2, 4, 32])
def test_samples_of_other_widths(bits, mirrored):
    """PackBits pages of 5 rows of 13 samples."""
    want = np.random.default_rng(bits).integers(0, 1 << bits, (5, 13), dtype=np.int64)
    if bits == 32:
        raw = want.astype("<u4").tobytes()
    else:
        raw = np.packbits((want[:, :, None] >> np.arange(bits)[::-1] & 1).reshape(5, -1).astype(np.uint8), axis=1).tobytes()
    data = tiff.packbits_encode(raw, len(raw) // 5)
    if mirrored and bits < 8:
        data = bytes(int(f"{b:08b}"[::-1], 2) for b in data)
    tags = [(256, 13), (257, 5), (258, bits), (259, 32773), (266, 1 + mirrored), (273, 8), (278, 5), (279, len(data))]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + b"\0" * 4
    (page,) = tiff.decode_pages(struct.pack("<2sHI", b"II", 42, 8 + len(data)) + data + body)
    assert page["error"] is None and page["bits"] == bits
    assert (np.frombuffer(page["pixels"], "<u4" if bits == 32 else "u1").reshape(5, 13) == want).all()
