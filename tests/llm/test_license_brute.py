"""Labels, score and permissive of the license scan against a second implementation: phrases counted word by word, expressions by recursive descent."""

import random
import re

import pytest

from tessera.llm import licenses as L

IDENTIFIER = re.compile(r"[A-Za-z0-9][A-Za-z0-9.+:-]*")


class Reader:
    """An expression by its grammar: or of ands of withs of identifiers and brackets; a line's end stops it outside brackets and after an operand."""

    def __init__(self, text):
        self.text, self.at, self.deep = text, 0, 0

    def skip(self, lines):
        while m := re.match(r"[^A-Za-z0-9()\r\n]+" if not lines else r"[^A-Za-z0-9()]+", self.text[self.at :]):
            self.at += m.end()

    def word(self, lines):
        self.skip(lines)
        m = IDENTIFIER.match(self.text, self.at)
        return m[0] if m else self.text[self.at : self.at + 1]

    def take(self, lines=False):
        w = self.word(lines)
        self.at += len(w)
        return w

    def level(self, names, below):
        value = below()
        while (w := self.word(self.deep > 0).upper()) == names:
            self.take(self.deep > 0)
            value = self.join(w, value, below())
        return value

    def join(self, w, a, b):
        return {"OR": (a[0] | b[0], a[1] or b[1]), "AND": (a[0] | b[0], a[1] and b[1]), "WITH": a}[w]

    def expression(self):
        return self.level("OR", lambda: self.level("AND", lambda: self.level("WITH", self.operand)))

    def operand(self):
        first = self.at == 0
        w = self.take(lines=not first)
        if w == "(":
            self.deep += 1
            value = self.expression()
            if self.take(lines=True) != ")":
                # words that cannot follow end the reading, and the bracket stays open
                raise ValueError
            self.deep -= 1
            return value
        if not IDENTIFIER.fullmatch(w) or w.upper() in L.BINDING:
            raise ValueError
        return {L.family(w)}, L.FAMILIES.get(L.family(w), False)


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    labels, evidence, permissive = set(), 0, None
    for phrase, label in {**L.NOTICES, **L.BASE}.items():
        p = phrase.split()
        n = sum(words[i : i + len(p)] == p for i in range(len(words)))
        evidence += n
        labels |= {label} if n else set()
    word = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]"
    tags = [(m.start(), m.end(), True) for m in re.finditer(f"(?<!{word})(?i:spdx-license-identifier:)", text)]
    tags += [(m.start(), m.end(), False) for m in re.finditer(f"(?<!{word})(?i:licen[cs]e[\"']?[ \\t]*[:=][ \\t]*[\"']?)", text)]
    for start, end, sure in tags:
        if not sure and any(a < start < b for a, b, s in tags if s):
            continue
        try:
            found, ok = Reader(text[end:]).expression()
        except (ValueError, IndexError):
            continue
        if sure or found <= set(L.FAMILIES):
            labels |= found
            evidence += 3
            permissive = ok if permissive is None else permissive and ok
    return ",".join(sorted(labels)), 1 - 0.5**evidence, permissive


CASES = [
    ("License: MIT", "mit", True),
    ("licence = 'Apache-2.0'", "apache", True),
    ('{"license": "GPL-3.0-only"}', "gpl", False),
    ("The license: you may copy it", "", None),
    ("SPDX-License-Identifier: Foo-1.0", "foo-1.0", False),
    ("# SPDX-License-Identifier: MIT OR\n#   Apache-2.0\n# Other", "apache,mit", True),
    ("SPDX-License-Identifier: (GPL-2.0\n AND MIT)\n", "gpl,mit", False),
    ("SPDX-License-Identifier:\nMIT", "", None),
    ("SPDX-License-Identifier: MIT\nOR GPL-2.0", "mit", True),
    ("license: MIT license: GPL-2.0", "gpl,mit", False),
    ("Creative Commons Attribution-ShareAlike", "cc-by,cc-by-sa", None),
    ("SPDX-License-Identifier: CC-BY-SA-4.0 OR 0BSD", "0bsd,cc-by,cc-by-sa", True),
]


@pytest.mark.parametrize(("text", "labels", "permissive"), CASES)
def test_cases(text, labels, permissive):
    got = L.scan(text.encode())
    assert (got[5], got[7]) == (labels, permissive) == plain(text)[::2]


def test_random_texts(spark):
    rng = random.Random(6)
    parts = ["SPDX-License-Identifier:", "License:", "licence=", "MIT", "Apache-2.0", "GPL-2.0+", "LGPL-3.0-only", "X-1.0", "OR", "AND", "WITH", "or", "(", ")", "\n", "\r\n# ", "mit license", "Apache License", "cc by", "cc-by-sa", "isc license", "the", "é", "1", ","]
    texts = [" ".join(rng.choice(parts) for _ in range(rng.randrange(1, 40))) for _ in range(3000)]
    texts += [" ".join(rng.choice(parts[:14]) for _ in range(rng.randrange(1, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["labels"], r["score"], r["permissive"]) for r in L.scan_licenses(df).collect()}
    wrong = [(t, got[i], plain(t)) for i, t in enumerate(texts) if got[i] != plain(t)]
    assert not wrong, wrong[:3]


def test_documents(docs, doc_rows):
    got = sorted((r["doc_id"], r["labels"], r["score"], str(r["permissive"])) for r in L.scan_licenses(docs).collect())
    want = [(d, *plain(t or "")) for d, t in doc_rows]
    assert got == sorted((d, a, b, str(c)) for d, a, b, c in want)
