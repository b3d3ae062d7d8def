"""Documents that are a whole licence, wrapped and spelt in other ways."""

import textwrap

from labelspring.llm import licenses
from labelspring.llm.queries import op5_license_scan

EXPECTED = {
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0",
    "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-1.1", "MPL-2.0", "Unlicense", "Zlib",
}


def respelt(text, k):
    """The body in one of several wrappings and equivalent spellings; copyright lines stay apart."""
    lines = text.splitlines()
    kept = [x for x in lines if not x.strip().lower().startswith("copyright (c)")]
    body = " ".join(" ".join(kept).split())
    if k == 0:
        return text
    if k == 1:
        return "Copyright (c) 2019-2024, A. Person\nAll rights reserved.\n\n" + textwrap.fill(body, 43)
    if k == 2:
        body = body.replace("copyright holder", "copyright owner").replace("license", "licence")
        return "\r\n".join(" * " + line for line in textwrap.wrap(body, 71, break_on_hyphens=False))
    return body.upper()


def test_whole_texts_are_known(spark, tmp_path):
    known = {}
    for name, text in licenses.license_texts():
        known.setdefault(name, []).append(text)
    assert set(known) == EXPECTED
    rows, names = [], {}
    for name, texts in known.items():
        # Appendices hold copyright lines of their own, so that they keep their lines.
        for text, k in [(texts[0], 0), *((texts[-1], k) for k in range(4))]:
            names[len(rows)] = name
            rows.append((len(rows), respelt(text, k)))
    mit = known["MIT"][-1]
    rows += [(9000, mit.replace("free of charge", "for a fee")), (9001, mit + "\nAnd more."), (9002, mit[:400])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r["doc_id"]: r["license_id"] for r in op5_license_scan(spark, str(tmp_path)).collect()}
    assert {i: n for i, n in found.items() if i < 9000} == names
    assert {found[i] for i in (9000, 9001, 9002)} == {None}


def test_licences_of_different_names_have_different_texts(spark):
    rows = spark.createDataFrame(licenses.license_texts(), "license_id string, text string")
    digests = licenses.known_digests(rows)
    assert {r["license_id"] for r in digests.collect()} == EXPECTED
