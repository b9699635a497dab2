import re

import pytest

from fuelgrid.llm import licenses

SF = "/root/testdata/sf0.01"
PROSE = "plain prose about nothing at all under the sun "


def test_files_that_are_mostly_a_notice_give_their_license(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "a/x", f"Short.\n{mit}"), (2, "a/y", PROSE), (3, "a/b/z", PROSE), (4, "c/w", f"{PROSE}\n{mit}"), (5, "c/v", PROSE),
        (6, "d/A", mit), (7, "d/COPYING", apache), (8, "d/n", PROSE), (9, "a/b/u", f"{PROSE}\n{apache}"), (10, None, mit), (11, "a/e", ""), (11, "a/e", None),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string")
    got = {r.id: (r.license, r.inherited_license, r.inherited_from, r.final_license) for r in licenses.scan(df, whole=0.5).collect()}
    assert got[1] == ("MIT", "MIT", "a", "MIT") and got[2] == got[3] == got[11] == (None, "MIT", "a", "MIT")
    assert got[4] == ("MIT", None, None, "MIT") and got[5] == (None, None, None, None)
    assert got[8] == (None, "Apache-2.0", "d", "Apache-2.0") and got[6][3] == "MIT"
    assert got[9] == ("Apache-2.0", "MIT", "a", "Apache-2.0") and got[10] == ("MIT", None, None, "MIT")
    by_name = {r.id: r.inherited_license for r in licenses.scan(df).collect()}
    assert by_name == {i: "Apache-2.0" if i in (6, 7, 8) else None for i in by_name}


def test_documents_inherit_from_license_documents(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = licenses.op6_licenses(spark, SF).collect()
    own = {r.doc_id: r.license for r in got}
    given = {}
    for i, d in docs.items():
        lines = [x for x in re.split(r"\n", d.text or "") if re.search("(?i)(licensed|released) under", x)]
        if own[i] and 2 * max(map(len, lines)) >= len(d.text):
            given[d.source, d.lang] = own[i]  # this table has one at most in a directory
    assert given and len(got) == len(docs)
    for r in got:
        want = given.get((docs[r.doc_id].source, docs[r.doc_id].lang))
        assert (r.inherited_license, r.final_license) == (want, r.license or want)
    assert any(r.final_license and not r.license for r in got)


@pytest.mark.parametrize("empty", [True, False])
def test_documents_without_ids_stay_in_their_directory(spark, tmp_path, empty):
    rows = [(None, "s", "en", "Released under the MIT License."), (1, "s", "fr", PROSE), (2, "s", "en", PROSE)]
    df = spark.createDataFrame(rows[: 0 if empty else 3], "doc_id long, source string, lang string, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.final_license for r in licenses.op6_licenses(spark, str(tmp_path)).collect()}
    assert got == ({} if empty else {None: "MIT", 1: None, 2: "MIT"})
