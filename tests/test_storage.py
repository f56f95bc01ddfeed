from __future__ import annotations

from types import SimpleNamespace

import pytest

from examloom import storage


def session(master: str, named: str | None = None, app: str = "app"):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: named), sparkContext=SimpleNamespace(master=master, applicationId=app))


def test_the_named_folder_is_used_whatever_it_is():
    assert storage.shared_dir(session("spark://h:1", "hdfs://store/tmp/")) == "hdfs://store/tmp"
    assert storage.shared_dir(session("local[2]", "/tmp/checkpoints")) == "/tmp/checkpoints"


def test_only_a_local_session_may_leave_it_out():
    assert storage.shared_dir(session("local[*]")) == storage.shared_dir(session("local[*]")) != storage.shared_dir(session("local", app="other"))
    for master in ("local-cluster[2,1,1024]", "yarn", "spark://h:1"):
        with pytest.raises(RuntimeError):
            storage.shared_dir(session(master))


def test_materialize(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "x int, y string")
    assert sorted(map(tuple, storage.materialize(df).collect())) == [(1, "a"), (2, None)]


def test_variants_are_written_as_they_are(spark):
    """No columns are made of what they hold, and the session's setting stays."""
    import glob

    import pyarrow.parquet as pq

    before = spark.conf.get("spark.sql.variant.inferShreddingSchema")
    out = storage.materialize(spark.range(50).selectExpr("id", """parse_json('{"a":' || id || ',"b":["x",true]}') AS v"""))
    names = {c for f in out.inputFiles() for g in glob.glob(f.removeprefix("file://").removeprefix("file:")) for c in pq.ParquetFile(g).schema.names}
    assert "metadata" in names and "typed_value" not in names
    assert spark.conf.get("spark.sql.variant.inferShreddingSchema") == before
    assert sorted(r[0] for r in out.selectExpr("variant_get(v, '$.a', 'int')").collect()) == list(range(50))
