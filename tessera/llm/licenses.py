"""License scans: an Aho-Corasick automaton over words for notice phrases and identifier tags, a shunting-yard parser for expressions.

A text is lower-cased (A-Z) and read as words of digits, letters and non-ASCII bytes. Phrases are found where their words stand
consecutively. Tags are found by their words too and followed in the raw text by an expression, of any length, of identifiers with AND,
OR, WITH and brackets; its identifiers become labels and its value tells whether a permissive choice satisfies it. The tags are
"SPDX-License-Identifier:" and "license:" (or "licence", with quotes or "=" as in manifests), which counts only where all its identifiers
are known. An expression ends with its line, unless an operator or an open bracket there asks for more.
"""

from __future__ import annotations

import functools
import re
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm import common

#: phrases whose places are counted, and their labels
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices that give a label only.
NOTICES = {
    "licensed under the apache": "apache",
    "permission is hereby granted free of charge": "mit",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "mozilla public license": "mpl",
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "creative commons zero": "cc0",
    "cc0 1 0 universal": "cc0",
    "eclipse public license": "epl",
    "common development and distribution license": "cddl",
    "european union public licence": "eupl",
    "common public license": "cpl",
    "open software license": "osl",
    "academic free license": "afl",
    "artistic license": "artistic",
    "boost software license": "bsl",
    "sil open font license": "ofl",
    "microsoft public license": "ms-pl",
    "microsoft reciprocal license": "ms-rl",
    "server side public license": "sspl",
    "business source license": "busl",
    "open database license": "odbl",
    "python software foundation license": "psf",
    "postgresql license": "postgresql",
    "zlib license": "zlib",
    "isc license": "isc",
    "x11 license": "x11",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "do what the fuck you want to public license": "wtfpl",
    "all rights reserved": "proprietary",
}
# First parts of identifiers, which are their labels, and whether they are permissive.
PERMISSIVE = ["mit", "apache", "bsd", "0bsd", "isc", "cc0", "unlicense", "cc-by", "zlib", "bsl", "psf", "python", "postgresql", "x11", "ncsa", "afl", "ecl", "wtfpl", "ofl", "artistic", "ms-pl", "curl", "openssl", "php", "vim"]
OTHERS = ["mpl", "lgpl", "gpl", "agpl", "gfdl", "epl", "cddl", "eupl", "cpl", "ipl", "osl", "ms-rl", "sspl", "busl", "odbl", "cc-by-sa", "cc-by-nc", "cc-by-nd"]
FAMILIES = {**dict.fromkeys(PERMISSIVE, True), **dict.fromkeys(OTHERS, False)}
#: words of the tags, and what must stand in the raw text for each
TAGS = {"spdx license identifier": re.compile(rb"spdx-license-identifier:", re.I), "license": re.compile(rb"licen[cs]e[\"']?[ \t]*[:=][ \t]*[\"']?", re.I), "licence": re.compile(rb"licen[cs]e[\"']?[ \t]*[:=][ \t]*[\"']?", re.I)}
SURE = "spdx license identifier"
WORD = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"\(|\)|[A-Za-z0-9][A-Za-z0-9.+:-]*")
TOKEN_OR_END = re.compile(TOKEN.pattern.encode() + rb"|[\r\n]+")
END = "\n"
BINDING = {"OR": 1, "AND": 2, "WITH": 3}
#: lower-cases A-Z, keeps digits, a-z and bytes over 0x7F, and turns the rest into spaces
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b > 0x7F or 0x61 <= b <= 0x7A or 0x30 <= b <= 0x39 else 32 for b in range(256))


def tokens_from(text: bytes, at: int) -> Iterator[str]:
    """The tokens from byte `at` on, one by one, and END for the end of each line."""
    for m in TOKEN_OR_END.finditer(text, at):
        yield END if m[0][0] in b"\r\n" else m[0].decode()


def postfix(expression: str | Iterable[str]) -> list[str] | None:
    """Identifiers and operators in postfix order by a shunting yard; null if the leading part of the text is no expression.

    Reading stops before the first token that cannot follow, so words after an expression do no harm; an open bracket does. A line's end
    stops it too, unless an operator or an open bracket stands before it.
    """
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an identifier must come next
    for t in TOKEN.findall(expression) if isinstance(expression, str) else expression:
        op = t.upper() if t.upper() in BINDING else None
        if t == END:
            if not stack or (not operand and "(" not in stack):
                break
        elif operand:
            if t == "(":
                stack.append(t)
            elif op or t == ")":
                return None
            else:
                out.append(t)
                operand = False
        elif op:
            while stack and stack[-1] != "(" and BINDING[stack[-1]] >= BINDING[op]:
                out.append(stack.pop())
            stack.append(op)
            operand = True
        elif t == ")" and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        else:
            break
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


def family(identifier: str) -> str:
    """The family of an identifier such as Apache-2.0; an unknown one is its own."""
    low = identifier.lower().rstrip("+")
    return max((f for f in FAMILIES if low == f or low.startswith(f + "-")), key=len, default=low)


def evaluate(expression: str | Iterable[str]) -> tuple[set[str], bool] | None:
    """Labels of an expression, and whether a choice among its OR branches leaves permissive licences only; WITH keeps its licence's value."""
    order = postfix(expression)
    if order is None:
        return None
    labels: set[str] = set()
    values: list[tuple[bool, set[str]]] = []
    for t in order:
        if t not in BINDING:
            values.append((FAMILIES.get(family(t), False), {family(t)}))
            continue
        (b, of_b), (a, of_a) = values.pop(), values.pop()
        values.append({"OR": (a or b, of_a | of_b), "AND": (a and b, of_a | of_b), "WITH": (a, of_a)}[t])
    labels = values[0][1]
    return labels, values[0][0]


@functools.cache
def automaton():  # noqa: ANN201  the type belongs to a compiled module
    import ahocorasick

    out = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        out.add_word(f" {phrase} ", (phrase, label, phrase in BASE))
    for words in TAGS:
        out.add_word(f" {words} ", (words, None, False))
    out.make_automaton()
    return out


def scan(text: bytes) -> tuple[int, int, int | None, int | None, str, str, float, bool | None]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, permissive of one text.

    score is 1 - 0.5 ** evidence: a notice or a base place counts 1, a tag whose expression parses 3. permissive is null without a tag.
    """
    plain = text.translate(WORD_BYTES)
    words = plain.split()
    joined = (b" " + b" ".join(words) + b" ").decode("utf-8", "replace")
    base: set[str] = set()
    labels: set[str] = set()
    starts: list[int] = []
    evidence = 0
    counted, at = 0, 0
    places: list[tuple[int, str]] = []
    for end, (phrase, label, is_base) in automaton().iter(joined):
        if label is None:
            places.append((end - len(phrase) - 1, phrase))
            continue
        labels.add(label)
        evidence += 1
        if is_base:
            begin = end - len(phrase) - 1
            if begin >= at:
                counted, at = counted + joined.count(" ", at, begin), begin
                starts.append(counted)
            else:
                starts.append(joined.count(" ", 0, begin))
            base.add(label)
    permissive = None
    tags: deque[tuple[int, str]] = deque()  # the first word of each
    before = until = 0
    for begin, phrase in sorted(places):
        before, until = before + joined.count(" ", until, begin), begin
        tags.append((before, phrase))
    done = 0  # a tag inside another's words is no tag of its own
    for n, word in enumerate(WORD.finditer(plain)) if tags else ():
        while tags and n == tags[0][0]:
            _, words_of = tags.popleft()
            tag = TAGS[words_of].match(text, word.start()) if word.start() >= done else None
            found = evaluate(tokens_from(text, tag.end())) if tag else None
            if tag and words_of == SURE:
                done = tag.end()
            if found and (words_of == SURE or found[0] <= FAMILIES.keys()):
                labels |= found[0]
                permissive = found[1] if permissive is None else permissive and found[1]
                evidence += 3
        if not tags:
            break
    score = 1 - 0.5 ** min(evidence, 60)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, permissive


RESULT = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, permissive boolean"


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of `df`, from its whole text; a null text counts as empty: no words, no labels, score 0.

    Nothing is shuffled. Repeated rows and null ids keep their rows; columns of other names are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(", ")]
        kinds = (*(pa.int64(),) * 4, pa.string(), pa.string(), pa.float64(), pa.bool_())
        for rows in batches:
            buf, offsets = common.byte_buffer(rows.column("text"))
            data = memoryview(buf)
            found = list(zip(*(scan(bytes(data[offsets[k] : offsets[k + 1]])) for k in range(len(offsets) - 1)), strict=True)) or [[]] * 8
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x, k) for x, k in zip(found, kinds, strict=True))], names)

    return common.pick(df, doc_id=(id_col, "long"), text=(text_col, "string")).mapInArrow(run, RESULT)
