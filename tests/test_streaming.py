"""Files are taken once, over several runs."""

import json

from dossier.streaming import ingest as S


def test_ingest(spark, tmp_path):
    source, target, state = (str(tmp_path / d) for d in ("in", "out", "state"))
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.json").write_text(json.dumps({"node_id": f"n{i}", "doc_id": f"d{i % 2}", "content": "x"}) + "\n")
        assert S.ingest(S.node_stream(spark, source), target, state).awaitTermination(60)
    got = spark.read.parquet(target)
    assert sorted(r["node_id"] for r in got.select("node_id").collect()) == ["n0", "n1", "n2"]
