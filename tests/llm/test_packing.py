import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from palaver.llm import packing

from .helpers import ODD, docs, prose

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_pieces_and_places(spark):
    rows = [(i, prose(random.Random(i).randrange(1, 900), i), "en", "s") for i in range(60)] + [(60, prose(6000, 1), "en", "s"), (61, "x <|endoftext|> y", "en", "s"), (3, prose(5, 3), "en", "s")] + ODD
    df = docs(spark, rows)
    got = packing.pack(df).collect()
    pieces = sorted((str(r.doc_id), r.start, r.length, r.ids_crc32) for r in got if r.doc_id != 3)
    want = []
    for r in df.where("doc_id is null or doc_id <> 3").collect():
        ids = TOKENIZER.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        want += [(str(r.doc_id), a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for a, b in zip(cuts, cuts[1:])]
    assert pieces == sorted(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 1024
    total = sum(r.length for r in got)
    assert len(bins) <= -(-total // 1024) + 1


def test_empty_table(spark):
    assert packing.pack(docs(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
def test_search_keeps_items_and_never_adds_bins(lengths):
    lengths = np.array(lengths)
    before = packing.best_fit(lengths, 20)
    after = packing.improve(before, lengths, 20)
    assert sorted(i for b in after for i in b) == list(range(len(lengths)))
    assert all(lengths[b].sum() <= 20 for b in after) and len(after) <= len(before)
    squares = [sum(int(lengths[b].sum()) ** 2 for b in x) for x in (before, after)]
    assert squares[1] >= squares[0]


def test_swaps_empty_a_bin():
    lengths = np.array([6, 6, 4, 4, 5, 5])  # capacity 10: 6+4, 6+4, 5+5
    assert len(packing.improve([[0], [1, 2], [3, 4], [5]], lengths, 10)) == 3


def test_second_round_keeps_bins_that_are_better(spark):
    rows = [(i, prose(random.Random(i).randrange(1, 400), i), "en", "s") for i in range(200)]
    few = packing.pack(docs(spark, rows), block_rows=1000).select("sequence_id").distinct().count()
    many = packing.pack(docs(spark, rows), block_rows=20).select("sequence_id").distinct().count()
    assert few <= many <= few + 12


def test_exchanges_reach_every_item_of_a_bin():
    lengths = np.array([10] * 30 + [3, 4, 6, 302])  # the 3, 4 and 6 come after 24 others
    offers = dict((size, out) for out, size in packing._offers(list(range(33)), lengths))
    assert {3, 4, 6, 7, 9, 10, 13, 14, 16, 20} == set(offers) and all(sum(lengths[i] for i in out) == size for size, out in offers.items())
    assert offers[7] == (31, 30)
