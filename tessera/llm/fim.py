"""Fill-in-the-middle: each document is cut at two units into prefix, middle and suffix, which are put in another order behind sentinels.

An Arrow-batched pandas UDF does the whole of it. The units' end offsets are collected in a compact array (four bytes a unit, not a list
of strings), two look-ups in it slice the text, and hashlib gives the seeds and digests. A second UDF rebuilds the text from the output.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Sequence

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

#: a unit is white space with the word after it, or white space that no word follows
UNIT = regex.compile(r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++")
SENTINELS = ("<P>", "<S>", "<M>")
RESULT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
RESTORED = "text string, sha256 string"


def unit_ends(text: str) -> array:
    """Where each unit of `text` ends, in code points."""
    return array("I" if len(text) < 1 << 32 else "Q", (m.end() for m in UNIT.finditer(text)))


def draws(seed: int, name: int | None) -> list[int]:
    """The first four unsigned 32-bit numbers of the sha256 of `seed:name`; a null name is empty."""
    digest = hashlib.sha256(f"{seed}:{'' if name is None else name}".encode()).digest()
    return [int.from_bytes(digest[4 * i : 4 * i + 4], "big") for i in range(4)]


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def arrange(text: str, name: int | None, rate: int, spm_rate: int, seed: int, marks: Sequence[str]) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, length of prefix and middle in code points, and the output."""
    ends = unit_ends(text)
    n = len(ends)
    h1, h2, h3, h4 = draws(seed, name)
    if not text or h3 % 100 >= rate or any(m in text for m in marks):
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    p, s, m = marks
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


def original(output: str, form: str, marks: Sequence[str]) -> str:
    """The text that `output` was made of. No part holds a sentinel, and none can arise where parts meet, so each is found where it was put."""
    if form == "plain":
        return output
    p, s, m = marks
    first, second = (s, p) if form == "spm" else (p, s)
    one, _, rest = output[len(first) :].partition(second)
    two, _, middle = rest.partition(m)
    return two + middle + one if form == "spm" else one + middle + two


def check_marks(marks: Sequence[str]) -> None:
    """Sentinels must be three, and no end of one may begin another (or itself again), else an output could be read in two ways."""
    if len(set(marks)) != 3 or not all(marks):
        raise ValueError("three different sentinels are needed")
    overlap = any(x[-k:] == y[:k] for x in marks for y in marks for k in range(1, min(len(x), len(y))))
    if overlap or any(x != y and x in y for x in marks for y in marks):
        raise ValueError("sentinels must not overlap")


def fill_in_middle(
    df: DataFrame, rate: int = 50, spm_rate: int = 80, seed: int = 42, marks: Sequence[str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row for each row of `df`, from its whole text: doc_id, n, form, prefix_chars, middle_chars, output, output_sha256.

    About `rate` of 100 documents are cut, `spm_rate` of 100 of them in the order suffix, prefix, middle (spm), the others prefix, suffix,
    middle (psm). The draws follow from `seed` and doc_id alone, so rows that repeat, or that share an id, are cut by the same draws and a
    lost task gives the same rows again. A null text counts as empty; an empty text and one that holds a sentinel stay plain, with null
    prefix_chars and middle_chars. A null id draws as an empty one. A text of white space alone is one unit. Nothing is shuffled; columns of
    other names are left out, names that clash included; an empty table gives no rows.
    """
    check_marks(marks)
    marks = tuple(marks)

    @F.pandas_udf(RESULT)
    def cut(names: pd.Series, known: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for name, has, text in zip(names, known, texts, strict=True):
            found = arrange(text or "", int(name) if has else None, rate, spm_rate, seed, marks)
            rows.append((*found, sha256(found[4])))
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"])
        return out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    rows = common.pick(df, doc_id=(id_col, "long"), text=(text_col, "string"))
    done = rows.select("doc_id", cut(F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNotNull(), F.col("text")).alias("r"))
    return done.select("doc_id", "r.*")


def restored(output: Column, form: Column, marks: Sequence[str] = SENTINELS) -> Column:
    """text and sha256 of the text that each output was made of."""
    check_marks(marks)
    marks = tuple(marks)

    @F.pandas_udf(RESTORED)
    def rebuild(outputs: pd.Series, forms: pd.Series) -> pd.DataFrame:
        texts = [original(o, f, marks) for o, f in zip(outputs, forms, strict=True)]
        return pd.DataFrame({"text": texts, "sha256": [sha256(t) for t in texts]}, dtype=object)

    return rebuild(output, form)
