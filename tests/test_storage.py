from __future__ import annotations

from quillspark import storage


def test_staged_tables(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_dir", lambda _: str(tmp_path))
    df = storage.staged(spark.range(5).withColumnRenamed("id", "x"), "t")
    folder = tmp_path / spark.sparkContext.applicationId
    assert df.count() == 5 and any(folder.iterdir())
    storage.clear(spark)
    assert not folder.exists()
