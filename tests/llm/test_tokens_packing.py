import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from sonaria.llm import packing, tokens
from tests.llm.conftest import TEXTS

SP = public_tokenizers.path(tokens.MODEL)
WB = public_tokenizers.path(packing.MODEL)


def noise(seed, n):
    r = random.Random(seed)
    parts = ["a", "bc", " ", "  ", "\n", "\r\n", "\t", "▁", ".", "Σ", "é", "é", "<s>", "<|endoftext|>", "'s", "don't", "漢", "\x1c", " ", "10", "ÀÉ", "\x01"]
    return ["".join(r.choice(parts) for _ in range(r.randrange(1, 30))) for _ in range(n)]


def test_counts_are_the_library_s():
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    counts = tokens.PreTokenCounts(SP, limit=200)
    assert counts.separable
    for text in [t for t in TEXTS if t] + noise(1, 3000):
        assert counts.count(text) == len(library.encode(text)), repr(text[:80])


def test_count_query(awkward, rows_of):
    library = sentencepiece.SentencePieceProcessor(model_file=SP)
    got = sorted(map(tuple, tokens.count_tokens(awkward, SP).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, _ in rows_of), key=str)
    assert got == want


def test_ids_are_the_library_s():
    library = Tokenizer.from_file(WB)
    words = packing.WordIds(WB, limit=200)
    for text in [t for t in TEXTS if t] + noise(2, 3000):
        assert np.frombuffer(words.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text[:80])


def test_configurations_hold_every_piece_and_beat_first_fit():
    r = np.random.default_rng(5)
    for lengths, counts in ((np.arange(1, 2049), r.integers(0, 40, 2048)), (np.array([2048, 700, 1500, 3]), np.array([5, 100, 90, 7])), (np.array([1]), np.array([5000]))):
        keep = counts > 0
        order = np.argsort(lengths[keep])
        l, c = lengths[keep][order], counts[keep][order]
        made = packing.configurations(l, c)
        held = Counter()
        for items, room, count in made:
            assert room == 2048 - sum(int(l[i]) for i in items) >= 0
            for i in items:
                held[i] += count
        assert [held[i] for i in range(len(l))] == c.tolist()
        bins = []  # first fit decreasing
        for size in sorted((int(x) for x, n in zip(l, c) for _ in range(n)), reverse=True):
            k = next((i for i, b in enumerate(bins) if b >= size), None)
            if k is None:
                bins.append(2048 - size)
            else:
                bins[k] -= size
            if len(bins) > 3000:
                break
        else:
            assert sum(n for _, _, n in made) <= len(bins)


def test_fractional_cover_is_a_solution_with_a_bound():
    r = np.random.default_rng(4)
    for lengths, counts in (
        (np.array([492, 522, 532, 1033]), np.array([12000, 6000, 6000, 6000])),
        (np.arange(1, 2048, 3), r.integers(1, 90, 683)),
        (np.array([683, 1025]), np.array([5001, 5000])),
    ):
        cover, bound = packing.fractional_cover(lengths, counts)
        covered = np.zeros(len(lengths))
        for kinds, each, amount in cover:
            assert amount > 0 and (lengths[kinds] * each).sum() <= 2048
            np.add.at(covered, kinds, each * amount)
        assert (covered <= counts + 1e-6).all()
        found = sum(n for _, _, n in packing.configurations(lengths, counts))
        alone = sum(n for _, _, n in packing.best_fit([], lengths, counts, 2048))
        assert bound - 1e-6 <= found <= max(1.001 * bound, 1.005 * alone) + 1


def test_program_where_best_fit_alone_fails():
    lengths, counts = np.array([492, 522, 532, 1033]), np.array([12000, 6000, 6000, 6000])
    assert sum(n for _, _, n in packing.configurations(lengths, counts)) <= 9001
    assert sum(n for _, _, n in packing.best_fit([], lengths, counts, 2048)) > 10_000


def test_never_more_than_best_fit_and_near_the_bound():
    for lengths, n, most in ((np.arange(1, 2048), 15, 15_353), (np.arange(400, 1500), 20, 10_243), (np.arange(500, 1200), 40, 11_674)):
        counts = np.full(len(lengths), n)
        made = packing.configurations(lengths, counts)
        held = np.zeros(len(lengths), np.int64)
        for items, room, times in made:
            assert room == 2048 - lengths[items].sum() >= 0
            np.add.at(held, items, times)
        assert (held == counts).all()
        number = sum(g[2] for g in made)
        assert number <= most and number <= sum(g[2] for g in packing.best_fit([], lengths, counts, 2048))


def test_what_the_program_leaves():
    r = np.random.default_rng(8)
    lengths, counts = np.arange(1, 2048, 9), r.integers(1, 120, 228)
    groups, rest, bound = packing.rounded(lengths, counts, 2048, *packing.TRIES[0])
    held = rest.copy()
    for items, room, times in groups:
        assert times > 0 and room == 2048 - lengths[items].sum() >= 0
        np.add.at(held, items, times)
    assert (held == counts).all() and (rest >= 0).all()
    assert bound - 1e-6 <= sum(g[2] for g in packing.configurations(lengths, counts))


def test_short_way_is_checked_on_loading():
    words = packing.WordIds(WB)
    assert words.short
    words.short = False
    whole = {w: bytes(words[w]) for w in ("Hello", "café", "it's", "don't!!", "a1b2")}
    words.clear()
    words.short = True
    assert whole == {w: bytes(words[w]) for w in whole}


def test_pack_query(awkward, rows_of):
    library = Tokenizer.from_file(WB)
    got = packing.pack(awkward, WB).collect()
    pieces = Counter()
    for i, t, _ in rows_of:
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()
        for at in range(0, len(ids), 8192):
            cut = ids[at : at + 8192]
            pieces[(i, at // 8192, at // 4, len(cut) // 4, zlib.crc32(cut))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in got) // 2048) + 1


def test_empty_tables(nothing):
    assert packing.pack(nothing, WB).count() == 0 and tokens.count_tokens(nothing, SP).count() == 0
