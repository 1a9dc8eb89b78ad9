"""The stages against brute force: what each drops, from its own input."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
from sparkloom.llm import decontaminate  # noqa: E402
from sparkloom.llm.common import staged  # noqa: E402

from .test_nearcopies import least_of_groups  # noqa: E402
from .test_packing import verify  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in pipeline.STAGES[:4]:
        kept[name] = docs.collect()
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        docs = staged(out, name)
    last = docs.collect()
    inputs = [*(kept[n] for n, _ in pipeline.STAGES[:4]), last]
    for a, b in zip(inputs, inputs[1:], strict=False):
        assert set(b) <= set(a) and b  # rows are dropped, never changed
    assert sorted(r.doc_id for r in kept["decontamination"]) == least_of_groups([(r.doc_id, r.text) for r in kept["near_duplicates"]])
    bench = [decontaminate.words_of(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    whole = [b" ".join(w) for w in bench]
    held = {r.doc_id for r in kept["decontamination"] if any(w in b" ".join(decontaminate.words_of(r.text)) for w in whole)}
    assert held.isdisjoint({r.doc_id for r in last})
    verify(pipeline.STAGES[4][1](spark, docs, SF).collect(), [(r.doc_id, r.text) for r in last], 1024)


def test_odd_rows_pass_every_stage(odd, spark, tmp_path):
    docs = odd  # with columns that are named as the stages' own
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "never there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = docs
    for name, stage in pipeline.STAGES[:-1]:
        kept = staged(stage(spark, kept, str(tmp_path)), name)
        assert kept.dtypes == docs.dtypes and {r.language for r in kept.collect()} <= {"x"}
    got = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in got.select(F.col("doc_id")).collect()} <= {None, 3, 4}
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0
