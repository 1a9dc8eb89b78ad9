import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from sparkloom.llm.separators import END_ID, count_tokens, scan_flat
from sparkloom.llm.tokens import tokenizer_path


@pytest.mark.parametrize("block", [1, 2, 7, 64, 1 << 20])
def test_blocks_are_stitched(spark, tmp_path, block):
    g, want = random.Random(block), {}
    for k in range(3):
        ids, lengths = [], []
        for _ in range(g.randint(0, 12)):
            n = g.choice([0, 1, 5, 30])
            ids += [g.randrange(100) for _ in range(n)] + [END_ID]
            lengths.append(n)
        if k == 2:  # the last document has no end id
            ids += [1, 2, 3]
            lengths.append(3)
        (tmp_path / f"f{k}.bin").write_bytes(np.array(ids, ">u2").tobytes())
        start = 0
        for i, n in enumerate(lengths):
            want[f"f{k}.bin", i] = (start, n)
            start += n + 1
    got = scan_flat(spark, str(tmp_path), block_ids=block).collect()
    assert {(r.file, r.place): (r.start, r.n_tokens) for r in got} == want


@pytest.mark.parametrize("split", [37, 333])
def test_files_are_split_anywhere(spark, tmp_path, split):
    """Pairs of bytes that look like a separator but are halves of two ids, at
    both parities of the splits; one file begins with a byte order mark."""
    g, want = random.Random(split), {}
    for k in range(3):
        ids, start = [0xEFBB, 0xBF01][: 2 * (k == 1)], 0
        for place in range(12):
            n = g.choice([0, 1, 3, 20])
            ids += [g.choice([0x00C5, 0x80C5, 0x8000, 7, 0x0A0A]) for _ in range(n)] + [END_ID]
            want[f"f{k}.bin", place] = (start, len(ids) - 1 - start)
            start = len(ids)
        (tmp_path / f"f{k}.bin").write_bytes(np.array(ids, ">u2").tobytes())
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        got = scan_flat(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert {(r.file, r.place): (r.start, r.n_tokens) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("end_id", [0, 50256, 65535, 70000])
def test_end_ids_that_are_no_character(spark, tmp_path, end_id):
    with pytest.raises(ValueError):
        scan_flat(spark, str(tmp_path), end_id)


def test_documents(odd, spark):
    tk = Tokenizer.from_file(tokenizer_path())
    want = sorted(((r.doc_id, len(tk.encode(r.text or "", add_special_tokens=False).ids)) for r in odd.collect()), key=str)
    assert sorted(((r.doc_id, r.n_tokens) for r in count_tokens(odd).collect()), key=str) == want
    assert count_tokens(odd.limit(0)).count() == 0


def test_query_against_brute_force(spark):
    from sparkloom.llm.queries import op8_separators

    tk = Tokenizer.from_file(tokenizer_path())
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.n_tokens for r in op8_separators(spark, "/root/testdata/sf0.001").collect()}
    assert got == {r.doc_id: len(tk.encode(r.text, add_special_tokens=False).ids) for r in docs}
