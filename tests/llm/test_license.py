"""op7's parser: operators, precedence, brackets, tags at their places, work linear in the text."""

import time

import pytest

from sparkgauge.llm.license_scan import evaluate, label_of, scan_text, to_postfix


@pytest.mark.parametrize(
    ("expression", "postfix"),
    [
        ("MIT", "MIT"),
        ("MIT AND ISC", "MIT ISC and"),
        ("MIT OR ISC", "MIT ISC or"),
        ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only Classpath-exception-2.0 with"),
        ("MIT OR ISC AND Zlib", "MIT ISC Zlib and or"),
        ("MIT AND ISC OR Zlib", "MIT ISC and Zlib or"),
        ("(MIT OR ISC) AND Zlib", "MIT ISC or Zlib and"),
        ("MIT OR GPL-2.0 WITH X-exception AND ISC", "MIT GPL-2.0 X-exception with ISC and or"),
        ("MIT OR ISC OR Zlib", "MIT ISC or Zlib or"),
        ("((MIT", "MIT"),
        ("MIT ISC", "MIT"),
        ("AND MIT", ""),
        ("MIT OR", "MIT or"),
        ("", ""),
    ],
)
def test_postfix(expression, postfix):
    assert " ".join(to_postfix(expression)) == postfix


@pytest.mark.parametrize(
    ("expression", "labels", "unknown", "permissive"),
    [
        ("EPL-2.0 OR CDDL-1.0", ["cddl", "epl"], [], False),
        ("Zlib", ["zlib"], [], True),
        ("MIT OR GPL-2.0", ["gpl", "mit"], [], True),
        ("MIT AND GPL-2.0", ["gpl", "mit"], [], False),
        ("MIT OR GPL-2.0 AND EPL-2.0", ["epl", "gpl", "mit"], [], True),
        ("(MIT OR GPL-2.0) AND EPL-2.0", ["epl", "gpl", "mit"], [], False),
        ("GPL-2.0 WITH Classpath-exception-2.0", ["gpl"], [], False),
        ("Apache-2.0 WITH LLVM-exception", ["apache"], [], True),
        ("MIT AND House-1.0", ["mit", "unknown"], ["House-1.0"], False),
        ("MIT OR", ["mit"], [], True),
        ("", [], [], False),
    ],
)
def test_evaluation(expression, labels, unknown, permissive):
    assert evaluate(to_postfix(expression)) == (labels, unknown, permissive)


@pytest.mark.parametrize(
    ("identifier", "family"),
    [
        ("GPL-3.0-or-later", "gpl"), ("GPL2", "gpl"), ("GPL-2.0+", "gpl"), ("LGPL-2.1-only", "lgpl"),
        ("AGPL-3.0", "agpl"), ("BSD-3-Clause", "bsd"), ("0BSD", "bsd"), ("CC-BY-SA-4.0", "cc-by-sa"),
        ("CC-BY-4.0", "cc-by"), ("CC-BY-NC-ND-4.0", "cc-by-nc"), ("MIT-0", "mit"), ("BSL-1.0", "boost"),
        ("BUSL-1.1", "busl"), ("Python-2.0", "python"), ("LicenseRef-Own", "licenseref"),
        ("DocumentRef-a:LicenseRef-b", "licenseref"), ("Mitre", None), ("gplx", None), ("-", None),
    ],
)
def test_families(identifier, family):
    assert label_of(identifier) == family


def test_tags():
    text = (
        "// SPDX-License-Identifier: MIT OR ISC\r\n"
        "é spdx-license-identifier:\tEPL-2.0 SPDX-License-Identifier: Zlib\n"
        "spdx license identifier: MPL-2.0\n"
        "SPDX-License-Identifier:"
    )
    found = scan_text(text)
    assert found.expressions == ["MIT OR ISC", "EPL-2.0 SPDX-License-Identifier: Zlib", ""]
    assert found.parsed == ["MIT ISC or", "EPL-2.0", ""]
    assert found.labels == ["epl", "isc", "mit"] and not found.permissive
    assert scan_text("license MIT").expressions == []


def test_places_of_overlapping_phrases():
    text = "the lesser general public license, general public license mit license MIT-license"
    found = sorted(scan_text(text).places)
    assert found == [
        ("general public license", 2),
        ("general public license", 5),
        ("lesser general public license", 1),
        ("mit license", 8),
        ("mit license", 10),
    ]


def test_many_places_take_linear_time():
    def seconds(n):
        begin = time.perf_counter()
        found = scan_text("mit license " * n)
        took = time.perf_counter() - begin
        assert found.places == [("mit license", 2 * i) for i in range(n)]
        return took

    seconds(1000)
    assert seconds(64_000) < 40 * max(seconds(8_000), 0.005)


def test_long_expressions():
    names = " OR ".join(f"Own-{i}" for i in range(20_000))
    begin = time.perf_counter()
    found = scan_text("SPDX-License-Identifier: " + names)
    assert len(found.unknown_ids) == 20_000 and time.perf_counter() - begin < 10
