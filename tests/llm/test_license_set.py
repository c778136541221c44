"""The full set of licenses, short notices and SPDX lines."""

import random
import time

from tidemark.llm import license_set, licenses, queries

SET = license_set.full_set()


def found(text):
    return {name: place for name, share, place in licenses.Scanner(SET).scan(text)}


def test_every_template_finds_itself():
    scanner = licenses.Scanner(SET)
    for name, text in SET.items():
        got = {n: share for n, share, _ in scanner.scan("some words before it\n" + text + "\nand some after it here")}
        assert got.get(name) == 1.0, name


def test_short_notices():
    assert found("a b c. All rights reserved.") == {"all-rights-reserved": 3}
    assert found("MIT License") == {"mit-name": 0}
    assert found("All rights are reserved. The limit license") == {}
    assert found("under CC BY 4.0 now") == {"cc-by-4.0-short": 1}
    assert {"lgpl-name", "agpl-name"} <= set(found("GNU Lesser General Public License, GNU Affero General Public License"))
    assert licenses.Scanner({"x": "MIT"}).scan("an mit word") == [("x", 1.0, 1)]


def test_spdx():
    assert found("x\n// SPDX-License-Identifier: MIT\ncode") == {"spdx:mit": 1}
    assert found("# spdx-license-identifier: (MIT OR Apache-2.0) AND GPL-2.0-only WITH Classpath-exception-2.0\n").keys() == {f"spdx:{x}" for x in ("mit", "apache-2.0", "gpl-2.0-only", "classpath-exception-2.0")}
    assert found("SPDX-License-Identifier: LicenseRef-own.\nnext line").keys() == {"spdx:licenseref-own"}


def test_spdx_places_against_plain():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice(["SPDX-License-Identifier: MIT ", "spdx-license-identifier:ISC", "SPDX-License-Identifier: ", "word ", "İ", "Σ", "_x", "\n", "é-", "Apache-2.0 OR "]) for _ in range(rng.randrange(25)))
        want = {}
        for m in licenses.SPDX.finditer(text):
            for name in licenses.re.findall(licenses.SPDX_ID, m[1]):
                if name not in ("AND", "OR", "WITH"):
                    want.setdefault(name.rstrip(".:-").lower(), len(licenses.WORDS.findall(text[: m.start()].lower())))
        assert licenses.spdx(text) == want


def test_long_text_of_spdx_lines():
    line = "// SPDX-License-Identifier: MIT OR Apache-2.0\n"
    began = time.perf_counter()
    assert licenses.spdx(line * (5_000_000 // len(line))) == {"mit": 0, "apache-2.0": 0}
    assert time.perf_counter() - began < 10
    found = {name: place for name, _, place in licenses.Scanner(licenses.TEMPLATES).scan(line * (2_000_000 // len(line)))}
    assert found["spdx:mit"] == 0 and time.perf_counter() - began < 60


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.license) for r in queries.op9_license_scan(spark, sf).collect()}
    small = {(r.doc_id, r.license) for r in licenses.find_licenses(queries.table(spark, sf, "documents")).collect()}
    want = {r.doc_id for r in queries.table(spark, sf, "documents").collect() if "all rights reserved." in (r.text or "").lower()}
    assert small <= got and {i for i, name in got if name == "all-rights-reserved"} == want
