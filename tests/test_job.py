"""A job from files to file, and its settings."""

import pytest

from labelspring.plans.job import run_job
from labelspring.plans.settings import Settings
from labelspring.sources.tables import write_csv


def test_job_writes_labels_and_log(spark, tmp_path):
    def texts(start, n):
        word = ["fine clear text", "bad spam junk"]
        return [(i, f"{word[i % 2]} number {i} {word[i % 2]}", 1 - i % 2) for i in range(start, start + n)]

    train, test, out = (str(tmp_path / name) for name in ("train", "test", "out"))
    write_csv(spark.createDataFrame(texts(0, 80), "row_id long, TEXT string, LABEL int"), train)
    write_csv(spark.createDataFrame(texts(500, 60), "row_id long, TEXT string, LABEL int").drop("LABEL"), test)
    overrides = ["model=elastic", "rounds=1", "pairs=100", "epochs=2", "folds=2"]
    for _ in range(2):
        rows = run_job(spark, train, test, out, overrides, validate=True).collect()
        assert {r["row_id"]: r["LABEL"] for r in rows} == {i: 1 - i % 2 for i in range(500, 560)}
    counts = {name: spark.read.parquet(f"{out}/{name}").count() for name in ("rounds", "epochs", "folds")}
    assert counts == {"rounds": 4, "epochs": 8, "folds": 4}  # each run adds its own


def test_overrides():
    changed = Settings().overridden(["model=gbm", "cap={0: 5}", "threshold=0.9", "simcse=all"])
    assert (changed.model, changed.cap, changed.threshold, changed.simcse) == ("gbm", {0: 5}, 0.9, "all")
    for bad in ("model", "nothing=1"):
        with pytest.raises(ValueError, match="does not set"):
            Settings().overridden([bad])
