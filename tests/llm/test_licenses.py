"""Copyright statements of licence texts: their forms, and texts on one line."""

from __future__ import annotations

from pathlib import Path

import pytest

from mailstrata.llm import licenses

FORMS = ("Copyright (c) 2020 Some One", "(c) 2020 Some One", "© 2019-2020 Some One, Inc.", "Copyright Some One Inc.",
         "Copyright © Some One. All rights reserved.", "Copyright 2020, Some One", "Copyright (C) 1999, 2001 Some One <one@example.com>")


@pytest.mark.parametrize("joined", ["\n", " "])
def test_forms_and_one_line(spark, joined):
    rows, want = [], []
    for name, body in licenses.TEXTS:
        for form in FORMS:
            lines = [form if line.startswith("Copyright (c) <") else line for line in body.split("\n")]
            if joined == " " and form.startswith("Copyright Some") and not lines[0].startswith("Copyright"):
                continue  # without a sign or year, a statement is known by the start of its line
            rows.append((len(rows), joined.join(lines)))
            want.append(name)
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.license_id for r in got] == want


def test_one_line_texts_do_not_collide(spark):
    tail = " and then " + "many more words " * 40
    rows = [(1, "alpha copyright (c) 2020 x" + tail), (2, "beta copyright (c) 2020 x" + tail), (3, ""),
            (4, "Copyright (c) 2020 Some One. Licensed under the MIT License."), (5, "the above copyright notice stays")]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert len({r.digest for r in got[:3]}) == 3 and got[3].notice_ids == "MIT"
    assert got[4].digest != got[2].digest


@pytest.mark.parametrize("file, name", [("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0")])
def test_whole_long_texts(spark, file, name):
    path = Path("/usr/share/common-licenses", file)
    if not path.exists():
        pytest.skip("no copy on this machine")
    text = path.read_text(encoding="utf-8")
    got = licenses.scan(spark.createDataFrame([(1, text), (2, text + " more")], "doc_id long, text string")).orderBy("doc_id")
    assert [r.license_id for r in got.collect()] == [name, None]
