import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sparkloom.llm.tokens import tokenizer_path
from sparkloom.llm.common import new_place
from sparkloom.llm.wavelet import CHUNK, Shard, WaveletMatrix, count_ids, locate_ids, round_trip, write_shards


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0, 2, 7, 50_000, 65_535, 70_000, 9]), max_size=1300))
def test_matrix_answers_as_a_list_does(ids):
    m = WaveletMatrix.build(np.array(ids, dtype="<u4"))
    m = Shard.from_bytes(Shard([1], np.array([len(ids)]), m).to_bytes()).matrix
    assert m.decode().tolist() == ids
    for i in range(0, len(ids), 97):
        assert m.access(i) == ids[i]
    for t in (0, 7, 70_000, 123):
        places = [i for i, x in enumerate(ids) if x == t]
        assert m.locate(t) == places and m.count(t) == len(places)
        assert m.rank(t, 600) == sum(p < 600 for p in places)
        assert m.count(t, 10, 20) == sum(10 <= p < 20 for p in places)
        assert m.ranks(t, np.arange(len(ids) + 1)).tolist() == [sum(p < i for p in places) for i in range(len(ids) + 1)]
    with pytest.raises(IndexError):
        m.access(len(ids))
    with pytest.raises(IndexError):
        m.select(123, 0)


def test_only_chunks_on_the_way_are_opened():
    ids = np.random.default_rng(1).integers(0, 1000, 10 * CHUNK).astype("<u4")
    ids[7 * CHUNK + 5] = 5000
    m = Shard.from_bytes(Shard([1], np.array([len(ids)]), WaveletMatrix.build(ids)).to_bytes()).matrix
    opened = []
    for level, p in enumerate(m.planes):
        p.chunk = lambda i, own=p.chunk, level=level: opened.append((level, i)) or own(i)
    assert m.locate(5000) == [7 * CHUNK + 5] and m.access(7 * CHUNK + 5) == 5000
    assert len(set(opened)) <= 4 * len(m.planes)
    for t in (3, 999):
        assert m.locate(t) == np.flatnonzero(ids == t).tolist()


def test_shard_sets_count_and_locate(make_docs, spark):
    docs = [(i, f"one two three {'two ' * (i % 4)}") for i in range(60)]
    place = new_place(spark, "shards")
    write_shards(make_docs(docs), place, shard_tokens=100)
    tk = Tokenizer.from_file(tokenizer_path())
    encoded = {i: tk.encode(t, add_special_tokens=False).ids + [2] for i, t in docs}
    asked = [2, tk.encode(" two", add_special_tokens=False).ids[0], 49_999]
    want = [(t, i, k) for t in asked for i, ids in encoded.items() for k, x in enumerate(ids) if x == t]
    assert sorted(map(tuple, locate_ids(spark, place, asked).collect())) == sorted(want)
    assert {r.token: r.n for r in count_ids(spark, place, asked).collect()} == {t: sum(w[0] == t for w in want) for t in asked}


def brute(rows):
    tk, out, start = Tokenizer.from_file(tokenizer_path()), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tk.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_round_trip_of_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = round_trip(odd).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == brute(rows)


def test_empty_table(make_docs, spark):
    assert round_trip(make_docs(["x"]).limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from sparkloom.llm.queries import op1_wavelet

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = op1_wavelet(spark, "/root/testdata/sf0.001").select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == brute([tuple(r) for r in docs])
    tk = Tokenizer.from_file(tokenizer_path())
    ends = {d: tk.encode(t or "", add_special_tokens=False).ids.count(2) + 1 for d, t in docs}
    assert {r.doc_id: r.n_end_ids for r in op1_wavelet(spark, "/root/testdata/sf0.001").collect()} == ends
