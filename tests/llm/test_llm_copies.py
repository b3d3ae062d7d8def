"""A host of which a third is one document keeps that document, where copies count once."""

from labelspring.llm.lines import without_boilerplate
from labelspring.llm.minhash import without_near_duplicates


def test_copies_of_a_document_are_not_boilerplate(spark):
    copied = "\n".join(" ".join(f"c{j}x{k}" for k in range(12)) for j in range(6))
    rows = [(i, copied, "h") for i in range(40)]
    rows += [(100 + i, f"share this page\n{' '.join(f'w{i}x{k}' for k in range(60))}", "h") for i in range(80)]
    rows += [(300, None, "h"), (301, copied, "other"), (302, copied, "other"), (303, copied, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    lines = without_boilerplate(docs).select(*docs.columns)
    found = {r["doc_id"]: r["text"] for r in lines.collect()}
    assert all(found[i] == copied for i in (*range(40), 301, 302, 303))
    assert all("share" not in found[100 + i] and f"w{i}x0 " in found[100 + i] for i in range(80))
    assert found[300] is None and len(found) == len(rows)
    kept = [r["doc_id"] for r in without_near_duplicates(lines).collect()]
    assert [i for i in kept if i in (*range(40), 301, 302, 303)] == [0]


def test_a_column_of_the_count_s_name_is_replaced(spark):
    docs = spark.createDataFrame([(1, "a\nb", "h", 7)], "doc_id long, text string, source string, _n_dropped int")
    assert without_boilerplate(docs).select(*docs.columns).collect()[0]["_n_dropped"] == 0


def test_copies_are_pages_of_their_own_on_request(spark):
    rows = [(i, "same line", "h") for i in range(5)] + [(9, "other", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r["doc_id"]: r["text"] for r in without_boilerplate(docs, copies_once=False).collect()}
    assert found == {i: "" for i in range(5)} | {9: "other"}
