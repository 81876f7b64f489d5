"""Each stage of the pipeline against a plain version on the stage's own input."""

import os

import brute
from conftest import SF001
from tidewatch.llm import mixing, quality

import __spark_entry__
import corpus_pipeline


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    seen = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], SF001).write.parquet(os.path.join(str(tmp_path), str(i)))
        seen.append(spark.read.parquet(os.path.join(str(tmp_path), str(i))))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert seen[-1].columns == corpus_pipeline.COLUMNS
    rows = [{r["doc_id"]: r for r in d.collect()} for d in seen[:-1]]
    judged = {d: quality.judge(r["text"]) for d, r in rows[0].items()}
    assert {d: r["text"] for d, r in rows[1].items()} == {d: j["cleaned"] for d, j in judged.items() if j["kept"]}
    least = brute.near_classes([(d, r["text"]) for d, r in rows[1].items()])
    assert rows[2].keys() == set(least.values()) and all(rows[2][d] == rows[1][d] for d in rows[2])
    left = brute.substring([(d, r["text"]) for d, r in rows[2].items()])
    assert rows[3].keys() == {d for (d, t), k in left.items() if k or not brute.word_list(t)}
    assert all(brute.word_list(rows[3][d]["text"]) == k for (d, _), k in left.items() if k)
    drawn = {r["doc_id"] for r in mixing.mix(seen[3]).where("drawn").collect()}
    assert rows[4].keys() == drawn and all(rows[4][d] == rows[3][d] for d in drawn)
    packed = seen[5].collect()
    assert {r["doc_id"] for r in packed} == drawn
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))] and sum(n for _, n in places) <= 2048
    assert len(by) == brute.best_fit([r["length"] for r in packed], 2048)


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
