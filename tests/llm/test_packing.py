import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm.packing import pack, shortest_pack_first, slots
from sparkloom.llm.tokens import tokenizer_path


def one_by_one(lengths, size):
    """Shortest-pack-first, one piece at a time: each to the pack with most room."""
    packs = []
    for n in sorted(lengths, reverse=True):
        best = min(range(len(packs)), key=lambda i: sum(packs[i]), default=None)
        if best is None or sum(packs[best]) + n > size:
            packs.append([n])
        else:
            packs[best].append(n)
    return packs


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=80))
def test_patterns_are_those_of_single_pieces(lengths):
    patterns = shortest_pack_first(dict(Counter(lengths)), 32)
    got = Counter(sum(p) for c, p in patterns for _ in range(c))
    assert got == Counter(map(sum, one_by_one(lengths, 32)))
    assert Counter(x for c, p in patterns for x in p for _ in range(c)) == Counter(lengths)
    seen = Counter()
    for length, low, n, _, _ in slots(patterns):
        assert low == seen[length]
        seen[length] += n


def verify(rows, docs, size):
    tk = Tokenizer.from_file(tokenizer_path())
    want, got = Counter(), Counter()
    for doc_id, text in docs:
        ids = np.array(tk.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        for s in range(0, len(ids), size):
            want[doc_id, s, len(ids[s : s + size]), zlib.crc32(ids[s : s + size].tobytes()), len(ids)] += 1
    ends = Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        got[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert got == want and max(ends.values(), default=0) <= size


def test_odd_rows(odd):
    verify(pack(odd).collect(), [(r.doc_id, r.text) for r in odd.collect()], 1024)
    assert pack(odd.limit(0)).count() == 0
    ids = pack(odd, size=64, with_ids=True)
    verify(ids.collect(), [(r.doc_id, r.text) for r in odd.collect()], 64)
    assert all(len(r.ids) == 4 * r.length for r in ids.collect())


def test_query_against_brute_force(spark):
    from sparkloom.llm.queries import op10_packing

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    rows = op10_packing(spark, "/root/testdata/sf0.001").collect()
    verify(rows, [(r.doc_id, r.text) for r in docs], 1024)
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert sum(1024 - n for n in used.values()) < 0.02 * sum(used.values())


def test_lengths_are_checked():
    with pytest.raises(ValueError):
        shortest_pack_first({2000: 1}, 1024)
