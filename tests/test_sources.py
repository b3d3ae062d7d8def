import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelspring.operators.projection import Projection
from labelspring.sources import published, scratch
from labelspring.sources.scratch import cut_lineage, drop_table, new_path, shared_folder
from labelspring.sources.tables import (
    append_metrics,
    cached_projection,
    class_balance,
    path_exists,
    read_labelled,
    read_unlabelled,
    require_unique_ids,
    write_csv,
    write_predictions,
    write_scores,
)


def csv(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_edge_rows(spark, tmp_path):
    path = csv(
        tmp_path,
        'row_id,TEXT,LABEL\n1,"a ""q"", b\nline2",1\n2,NA,0\n3,,1\n4,  pad ,0\n5,"",1\n6,x,1.0\n',
    )
    rows = [tuple(r) for r in read_labelled(spark, path).orderBy("row_id").collect()]
    assert rows == [
        (1, 'a "q", b\nline2', 1),
        (2, "nan", 0),
        (3, "nan", 1),
        (4, "  pad ", 0),
        (5, "nan", 1),
        (6, "x", 1),
    ]


def test_columns_are_matched_by_name(spark, tmp_path):
    path = csv(tmp_path, "LABEL,row_id,TEXT\n0,9,hello\n")
    assert tuple(read_labelled(spark, path).first()) == (9, "hello", 0)


@pytest.mark.parametrize("row", ["x,t,1", ",t,1", "1,t,", "1,t,yes", "1,t,1,2"])
def test_bad_rows_fail_the_job(spark, tmp_path, row):
    path = csv(tmp_path, f"row_id,TEXT,LABEL\n{row}\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        read_labelled(spark, path).collect()


def test_unlabelled_rows_get_the_sentinel_only_when_needed(spark, tmp_path):
    path = csv(tmp_path, "row_id,TEXT\n1,a\n")
    assert tuple(read_unlabelled(spark, path).first()) == (1, "a", -1)
    path = csv(tmp_path, "row_id,TEXT,LABEL\n1,a,0\n2,b,\n")
    rows = read_unlabelled(spark, path).orderBy("row_id").collect()
    assert [tuple(r) for r in rows] == [(1, "a", 0), (2, "b", -1)]


def test_blank_lines_and_other_line_ends(spark, tmp_path):
    path = csv(tmp_path, "row_id,TEXT,LABEL\n1,a,1\n\n2,b,0\n\n")
    assert sorted(r["row_id"] for r in read_labelled(spark, path).collect()) == [1, 2]
    path = tmp_path / "crlf.csv"
    path.write_bytes(b'row_id,TEXT,LABEL\r\n1,"a\r\nb",1\r\n2,c,0\r\n')
    rows = read_labelled(spark, str(path)).orderBy("row_id").collect()
    assert [(r["row_id"], r["LABEL"]) for r in rows] == [(1, 1), (2, 0)]
    assert rows[0]["TEXT"].split() == ["a", "b"]


def test_parquet_and_unknown_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 1)], "row_id long, TEXT string, LABEL int")
    df.write.parquet(str(tmp_path / "p"))
    assert tuple(read_labelled(spark, str(tmp_path / "p"), "parquet").first()) == (1, "a", 1)
    with pytest.raises(ValueError, match="unknown format"):
        read_labelled(spark, "x", "xml")


def test_written_text_reads_back(spark, tmp_path):
    texts = ["  a\n\"b\",\r\nc\\ ", 'x"', "tab\t", "comma,"]
    df = spark.createDataFrame(
        [(i, t, i % 2) for i, t in enumerate(texts)], "row_id long, TEXT string, LABEL int"
    )
    write_csv(df, str(tmp_path / "out"))
    back = read_labelled(spark, str(tmp_path / "out")).orderBy("row_id").collect()
    assert [r["TEXT"] for r in back] == texts


def test_predictions_are_written_in_id_order(spark, tmp_path):
    df = spark.range(50).select(F.col("id").alias("row_id"), (F.col("id") % 2).alias("LABEL"))
    out = tmp_path / "result"
    write_predictions(df.orderBy(F.desc("row_id")).repartition(3), str(out))
    lines = []
    for part in sorted(out.glob("part-*.csv")):
        header, *body = part.read_text().splitlines()
        assert header == "row_id,LABEL"
        lines += body
    assert lines == [f"{i},{i % 2}" for i in range(50)]


def test_scores_and_metrics_tables(spark, tmp_path):
    oof = spark.createDataFrame(
        [(0, 1, 1, 0.5), (1, 2, 0, 0.25)], "fold int, row_id long, y int, score double"
    )
    write_scores(oof, str(tmp_path / "oof"))
    assert {p.name for p in (tmp_path / "oof").glob("fold=*")} == {"fold=0", "fold=1"}
    log = str(tmp_path / "log")
    append_metrics(oof, log)
    append_metrics(oof, log)
    assert spark.read.parquet(log).count() == 4


def test_balance_and_unique_ids(spark):
    df = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "row_id long, LABEL int")
    assert tuple(class_balance(df).first()) == (3, 2, 1)
    assert require_unique_ids(df) is df
    with pytest.raises(ValueError, match="row_id 1 occurs 2 times"):
        require_unique_ids(df.unionByName(df.filter("row_id = 1")))


def test_cached_projection_is_fitted_once(spark, tmp_path):
    calls = []

    def fit():
        calls.append(1)
        return Projection.identity(2)

    path = str(tmp_path / "stage1")
    assert not path_exists(spark, path)
    first = cached_projection(spark, path, fit)
    second = cached_projection(spark, path, fit)
    assert len(calls) == 1 and (first.weights == second.weights).all()
    cached_projection(spark, None, fit)
    assert len(calls) == 2


def test_a_failed_save_leaves_the_old_cache(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "stage1")
    two, three = Projection.identity(2), Projection.identity(3)
    cached_projection(spark, path, lambda: two, "a")
    save = Projection.save

    def broken(self, spark, folder, facts=None):
        save(self, spark, folder, facts)
        raise KeyboardInterrupt

    monkeypatch.setattr(Projection, "save", broken)
    with pytest.raises(KeyboardInterrupt):
        cached_projection(spark, path, lambda: three, "b")
    monkeypatch.setattr(Projection, "save", save)
    old = cached_projection(spark, path, lambda: pytest.fail("fitted again"), "a")
    assert len(old.weights) == 2
    assert len(cached_projection(spark, path, lambda: three, "b").weights) == 3
    held = published.published(spark, path)
    cached_projection(spark, path, lambda: two, "c")
    assert path_exists(spark, held)  # one that is read now stays
    cached_projection(spark, path, lambda: two, "d")
    assert not path_exists(spark, held) and len(published.versions(spark, path)) == 2


def test_a_repeated_run_leaves_one_copy_of_its_rows(spark, tmp_path):
    rows = spark.createDataFrame([(0, 0.5), (1, 0.25)], "fold int, auc double")
    log = str(tmp_path / "log")
    for run in ("a", "b", "a"):
        append_metrics(rows, log, run)
    append_metrics(rows.filter("fold = 1"), log, "b")
    found = sorted((r["run"], r["fold"]) for r in spark.read.parquet(log).collect())
    assert found == [("a", 0), ("a", 1), ("b", 1)]


def test_tables_go_to_the_configured_folder(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    path = new_path(spark, "t")
    assert path.startswith(folder) and path != new_path(spark, "t")
    df = cut_lineage(spark.range(5).withColumn("v", F.array(F.lit(1.0))), "t")
    assert df.count() == 5
    assert "parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_dropped_tables_are_gone(spark):
    path = new_path(spark, "t")
    spark.range(2).write.parquet(path)
    assert path_exists(spark, path)
    drop_table(spark, path)
    assert not path_exists(spark, path)


def test_a_cluster_must_name_its_folder(monkeypatch):
    class Conf:
        @staticmethod
        def get(name, default):
            return default

    class Context:
        master = "spark://somewhere"

        @staticmethod
        def getCheckpointDir():
            return None

    class Session:
        conf = Conf
        sparkContext = Context

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_folder(Session)
