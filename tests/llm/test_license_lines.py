import re

import duckdb
import pytest
from helpers import SMALL

from sessionmill.llm import license_scan
from sessionmill.llm.license_scan_sql import ORACLE

#: What a short line of its own that speaks of rights looks like, whatever the listed sentences are.
NOTICE = re.compile(r"\s*(?=.*(licen[sc]e|\bCC BY|rights reserved))(\S+\s+){1,14}\S+\s*", re.IGNORECASE)


def test_license_lines_of_the_given_documents(spark):
    docs = spark.read.parquet(f"{SMALL.replace('sf0.001', 'sf0.01')}/documents.parquet")
    found = {r.doc_id: r for r in license_scan.license_scan(docs).collect()}
    lines = [(r.doc_id, x) for r in docs.collect() for x in (r.text or "").split("\n") if NOTICE.fullmatch(x)]
    assert len({x.strip() for _, x in lines}) >= 5 and any("rights reserved" in x for _, x in lines)
    missed = {x for i, x in lines if not found[i].n_sentences or not found[i].licenses}
    assert not missed


@pytest.mark.parametrize(
    "text,licence",
    [
        ("Some words.\nAll rights reserved.\n", "All-rights-reserved"),
        ("SPDX-License-Identifier: GPL-3.0-or-later", "GPL-3.0"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "GPL-2.0"),
        ("SPDX-License-Identifier: LGPL-2.1-only", "LGPL-2.1"),
        ("Licensed under the GNU Affero General Public License, version 3.", "AGPL-3.0"),
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "MPL-2.0"),
        ("Licensed under CC0 1.0.", "CC0-1.0"),
        ("This is free and unencumbered software released into the public domain.", "Unlicense"),
    ],
)
def test_common_notices(spark, text, licence):
    row = license_scan.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.n_sentences >= 1 and row.licenses == licence


GRANT = "Garden Planner is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General Public License as published by the Free Software Foundation, {version}.\n\nGarden Planner is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.\n"
SLOTS = [
    ("Released under the Apache License, Version 2.0.", "Apache-2.0"),
    ("This project is licensed under the MIT license - see the LICENSE file for details.", "MIT"),
    ("The data set is available under the terms of the MIT licence.", "MIT"),
    ("Some words. This work is published under CC BY-SA 4.0. More words.", "CC-BY-SA-4.0"),
    ("Distributed under the GNU General Public License v3.0 or later.", "GPL-3.0"),
    ("Released under the Apache License 2.0 and the BSD 3-Clause License.", "Apache-2.0,BSD-3-Clause"),
    ("All code here is licensed under either the MIT License or the Apache License, version 2.0", "Apache-2.0,MIT"),
    ("SPDX-License-Identifier: Apache-2.0 OR MIT", "Apache-2.0,MIT"),
    ("# SPDX-License-Identifier: (GPL-2.0-or-later OR BSD-3-Clause) AND MIT", "BSD-3-Clause,GPL-2.0,MIT"),
    ("// SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note OR Apache-2.0 WITH LLVM-exception", "Apache-2.0,GPL-2.0"),
    (GRANT.format(kind="", version="either version 3 of the License, or (at your option) any later version"), "GPL-3.0"),
    (GRANT.format(kind="", version="version 2 of the License"), "GPL-2.0"),
    (GRANT.format(kind="Lesser ", version="either version 2.1 of the License, or (at your option) any later version"), "LGPL-2.1"),
    (GRANT.format(kind="Affero ", version="either version 3 of the License, or (at your option) any later version"), "AGPL-3.0"),
    ("This project is not licensed under the MIT License.", ""),
    ("It was previously released under the Apache License 2.0.", ""),
    ("The garden is available under the old oak licence tree.", ""),
    ("Licences are published under the roof of the MIT.", ""),
    ("SPDX-License-Identifier: LicenseRef-Own", ""),
]


@pytest.fixture(scope="module")
def slots(spark):
    docs = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(SLOTS)], "doc_id long, text string")
    return docs, license_scan.license_scan(docs).orderBy("doc_id").collect()


def test_slots(slots):
    assert [r.licenses for r in slots[1]] == [licence for _, licence in SLOTS]
    assert all(bool(r.n_sentences) == bool(r.licenses) for r in slots[1])


def test_slots_as_in_sql(slots):
    docs, rows = slots
    with duckdb.connect() as db:
        db.register("documents", docs.toPandas())
        assert sorted(map(tuple, rows)) == sorted(db.execute(f"SELECT doc_id, n_sentences, sentence_ids, licenses FROM ({ORACLE})").fetchall())
