import re

import pytest

from tessera.llm import licenses

PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    "MIT License mit-license MIT  LICENSE",
    "cc by cc by cc",
    "the apache license, apache.license and mit license mit licensed",
    "GNU General\nPublic License",
    "émit license xmit license mit licensé",
    "SPDX-License-Identifier: (MIT OR Apache-2.0) AND GPL-3.0-only WITH Classpath-exception-2.0",
    "bytes \x00\x7f mit\x00license 1mit license",
]


def test_against_brute_force(spark, odd, odd_rows, docs, doc_rows, none):
    own = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    for df, rows in ((odd, odd_rows), (docs, doc_rows), (own, list(enumerate(TEXTS)))):
        got = sorted((str(r["doc_id"]), *map(str, (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]))) for r in licenses.scan_licenses(df).collect())
        assert got == sorted((str(d), *map(str, plain(t))) for d, t in rows)
    assert licenses.scan_licenses(none).count() == 0


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("MIT", "MIT"),
        ("MIT OR Apache-2.0 AND GPL-2.0", "MIT Apache-2.0 GPL-2.0 AND OR"),
        ("(MIT or Apache-2.0) and GPL-2.0", "MIT Apache-2.0 or GPL-2.0 and"),
        ("GPL-2.0 WITH X AND MIT", "GPL-2.0 X WITH MIT AND"),
        ("MIT and this text goes on", "MIT this and"),
        ("MIT OR", None),
        ("(MIT", None),
        ("OR MIT", None),
        ("", None),
        ("((MIT))", "MIT"),
        ("MIT) AND X", "MIT"),
    ],
)
def test_shunting_yard(text, want):
    got = licenses.postfix(text)
    assert (got and [x.upper() for x in got]) == (want and want.upper().split())


def test_values():
    assert licenses.evaluate("MIT OR GPL-3.0-only") == ({"mit", "gpl"}, True)
    assert licenses.evaluate("MIT AND GPL-3.0-or-later") == ({"mit", "gpl"}, False)
    assert licenses.evaluate("Apache-2.0 WITH LLVM-exception") == ({"apache"}, True)
    assert licenses.evaluate("LGPL-2.1+") == ({"lgpl"}, False)


def test_labels_of_tags_and_notices():
    *_, base, labels, score, permissive = licenses.scan(b"SPDX-License-Identifier: MIT OR GPL-2.0-only\nAll rights reserved.")
    assert (base, labels, permissive) == ("", "gpl,mit,proprietary", True) and 0 < score < 1
    assert licenses.scan(b"nothing here")[4:] == ("", "", 0.0, None)
