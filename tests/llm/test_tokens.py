import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidemill.llm import bpe, byte_bpe, common, packing, token_count, token_output

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", "a" * 1000, "<|endoftext|>x<|endoftext|> y <|startoftext|>", "Ⅷ² ½ ΑΣ ΣΑΣ İstanbul é Å", "  \n\n \t x\x1c\x85\xa0 y'LL we'll 12,5__a_b", "日本語 テキスト 123４５", "\x00\x7f​😀👩‍👩‍👧", "_" * 300 + "=" * 900, "ſ ŉ İ ß ẞ ǅ", "'s 'S ’s don't", " " * 3000 + "y" * 3000]


def texts():
    rnd = random.Random(3)
    more = ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xA0, 0x250), rnd.randrange(0x300, 0x600), rnd.randrange(0x2000, 0x2070)])) for _ in range(150)) for _ in range(60)]
    long = " ".join("".join(rnd.choices("abcdefghij", k=rnd.randint(1, 70))) for _ in range(8000)) + "z" * 20_000
    return ODD + more + [long] + ["".join(rnd.choices("abcdefghijklmnopqrstuvwxyzABC <|>'_-é\n0²", k=8000))]


@pytest.fixture
def docs(spark):
    common.workers_import_this(spark)
    own = [(None, None, "x"), (7, "", "y"), (7, "again", "z"), (7, "again", "z"), (8, None, None), *[(100 + i, t, "o") for i, t in enumerate(texts())]]
    return spark.createDataFrame(own, "doc_id long, text string, n_tokens string")


def test_token_counts_match_the_library(docs):
    lib = Tokenizer.from_file(BYTE)
    got = token_count.token_counts(docs, BYTE, limit=100, block_chars=500).collect()
    want = sorted(((r.doc_id is None, r.doc_id), len((r.text or "").encode()), len(lib.encode(r.text or "", add_special_tokens=False).ids)) for r in docs.collect())
    assert sorted(((r.doc_id is None, r.doc_id), r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_count.token_counts(docs.limit(0), BYTE).count() == 0


def test_runs_merge_from_the_left():
    b = byte_bpe.load(BYTE)
    lib = Tokenizer.from_file(BYTE)
    words = ["a" * n for n in range(1, 40)] + ["ab" * n for n in range(1, 20)]
    assert token_count.surviving(b, [w.encode() for w in words]).tolist() == [len(lib.encode(w).ids) for w in words]


def test_bpe_matches_the_library(docs):
    lib = Tokenizer.from_file(WORD)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.bpe_round_trip(docs, WORD, block_chars=700).collect()), key=key)
    want = []
    for r in docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, ids, lib.decode(ids, skip_special_tokens=False)))
    assert got == sorted(want, key=key)
    assert {r.n_tokens for r in bpe.bpe_digests(docs, WORD).filter("doc_id = 8").collect()} == {0}
    assert bpe.bpe_digests(docs.limit(0), WORD).count() == 0


def test_encoder_matches_the_library():
    lib, ours = Tokenizer.from_file(BYTE), byte_bpe.encoder(BYTE)
    for t in texts():
        assert ours(t).tolist() == lib.encode(t, add_special_tokens=False).ids


def wanted(docs):
    lib, want = Tokenizer.from_file(BYTE), defaultdict(list)
    for r in docs.collect():
        want[r.doc_id].append(lib.encode(r.text or "", add_special_tokens=False).ids + [0])
    return want


def check(rows, want, size, gapless=True):
    """Every id in one piece, sequences without gaps; returns (ids, padding)."""
    seqs, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    total = pad = 0
    for own in seqs.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= size
        total += at
        pad += 0 if at & (at - 1) == 0 else size - at
    assert set(pieces) == set(want)
    for doc_id, own in pieces.items():
        left = sorted(want[doc_id])
        assert sum(r.length for r in own) == sum(map(len, left))
        for r in own:
            assert any(r.doc_tokens == len(d) and r.start + r.length <= len(d) and zlib.crc32(np.array(d[r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32 for d in left)
        if len(left) == 1:
            assert [r.start for r in sorted(own, key=lambda r: r.start)] == np.r_[0, np.cumsum([r.length for r in sorted(own, key=lambda r: r.start)])[:-1]].tolist()
    return total, pad


@pytest.mark.parametrize("windows, parts", [(1, 1), (4, 3), (32, 7)])
def test_packing_loses_nothing(docs, windows, parts):
    rows = packing.pack_online(docs.repartition(parts), BYTE, size=64, windows=windows, slack=2, merge_width=2).collect()
    total, pad = check(rows, wanted(docs), 64)
    assert pad <= 2 / 64 * total
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    assert packing.pack_online(docs.limit(0), BYTE).count() == 0


def test_packer_puts_best_fit_and_emits_the_fullest():
    p, out = packing.Packer(10, 2, 0), []
    for k, n in enumerate((6, 4, 3)):
        out += list(p.add(k, 0, np.zeros(n), n))
    assert [(piece[0], at) for _, at, piece in out] == [(0, 0), (1, 6)]
    q = packing.Packer(10, 2, 1)
    for k, n in enumerate((9, 8)):
        assert not list(q.add(k, 0, np.zeros(n), n))
    assert [piece[0] for _, _, piece in q.add(2, 0, np.zeros(5), 5)] == [0]
    assert packing.powers_of_two(13) == [8, 4, 1]


def test_room_tree_against_brute_force():
    rnd = random.Random(1)
    lengths = np.array([rnd.randint(1, 50) for _ in range(400)])
    bins, offsets, n = token_output.best_fit_decreasing(lengths, 50)
    room, want = [], []
    for i in np.argsort(-lengths, kind="stable"):
        fits = [(r, b) for b, r in enumerate(room) if r >= lengths[i]]
        if fits:
            best = min(fits)[0]
            assert 50 - offsets[i] == best
            room[bins[i]] -= lengths[i]
        else:
            assert bins[i] == len(room)
            room.append(50 - lengths[i])
        assert room[bins[i]] >= 0
    assert n == len(room)


def test_token_shards_round_trip(spark, docs):
    rows = token_output.token_output(docs.repartition(2), BYTE, size=64, block_tokens=3000).collect()
    check(rows, wanted(docs), 64)
    assert all(r.position_reset == r.start for r in rows)
    assert token_output.token_output(docs.limit(0), BYTE).count() == 0


def test_ranks_must_build_on_lower_ones():
    with pytest.raises(ValueError, match="merge 0 has a part"):
        byte_bpe.check_ranks([(5, 1, 6), (1, 2, 5)], {1, 2}, "file")
