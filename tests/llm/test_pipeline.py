"""The pipeline's stages keep, drop and change what they should, one after the other."""

from __future__ import annotations

import corpus_pipeline
from tests.llm.test_operators import BASE, SCHEMA, prose


def test_stages(spark, tmp_path):
    items = [(i, prose(1000 + i, 36)) for i in range(5)]
    clean = [(i, prose(3000 + i, 40), "en", "s", 1, "k", 7) for i in range(60)]
    toxic = [(100 + i, prose(4000 + i, 10) + " vile scum", "en", "s", 1, "k", 7) for i in range(30)]
    near = [(200, BASE[0], "en", "s", 1, "k", 7), (201, BASE[0] + " end", "en", "s", 1, "k", 7), (201, BASE[0] + " end", "en", "s", 1, "k", 7), (202, None, "en", "s", 1, "k", 7), (202, None, "en", "s", 1, "k", 7)]
    leak = [(300, prose(9, 30) + " " + items[2][1], "en", "s", 1, "k", 7)]
    private = [(400, "mail to 4111111111111111 " + prose(10, 40), "en", "s", 1, "k", 7)]
    docs = spark.createDataFrame(clean + toxic + near + leak + private, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], 1, int(100 <= r[0] < 200)) for r in clean + toxic], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept, seen = docs, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        seen.append(sorted(r["doc_id"] for r in kept.select("doc_id").collect()))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert kept.columns == docs.columns
    ids = sorted(r[0] for r in clean)
    assert [i for i in seen[0] if i < 100] == ids and sum(100 <= i < 200 for i in seen[0]) <= 3
    assert [i for i in seen[1] if 200 <= i < 300] == [200, 202]
    assert 300 not in seen[2] and [i for i in seen[2] if i < 100] == ids
    assert seen[3] == seen[2] and set(seen[4]) == set(seen[3])
    text = spark.read.parquet(str(tmp_path / "pii")).filter("doc_id = 400").first()["text"]
    assert "4111111111111111" not in text and text.endswith(prose(10, 40))
