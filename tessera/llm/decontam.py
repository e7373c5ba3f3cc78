"""Benchmark decontamination by templates: numbers, units and names become typed placeholders, windows are hash-joined, slots compared.

A question that was only re-parameterised keeps its template, so its windows still match; the values in its slots tell a consistent
re-parameterisation (each benchmark value stands for one value of the document, everywhere) from a chance likeness.

Numbers are digits or words ("twenty-five"), and a name of several words is one slot. A capitalised word that opens a sentence may be a
name or not, so such texts have two forms, with these words as literals and as names, and a window of either form may match.

Only documents that hold one of an item's rarest windows can hold enough of them, so these alone are joined first: a phrase that many
items share makes no row of every document and item.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm import common

WIDTH = 5
CONTAINMENT = 0.8
CONSISTENCY = 0.8
#: literal words that a window of five needs
LITERALS = 3
# Units that may follow a number, and words that are numbers.
UNITS = [
    "mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "l", "s", "ms", "min", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollars", "euros", "usd", "eur",
    "inch", "inches", "foot", "feet", "mile", "miles", "pound", "pounds", "degrees", "mph", "kmh", "kw", "kwh", "mb", "gb", "tb",
]
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17,
    "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000,
}

_BYTES = np.arange(256)
DIGIT = (_BYTES >= 0x30) & (_BYTES <= 0x39)
UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
LETTER = UPPER | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES > 0x7F)
JOINT = np.isin(_BYTES, [0x2C, 0x2E])
STOP = np.isin(_BYTES, list(b".!?:;\n"))
#: bytes that may part the words of one name or number
JOINING = common.SPACE | np.isin(_BYTES, [0x2D, 0x27])
LOWER_VALUES = common.BYTE_VALUES[common.LOWER]
_NUMBER, _UNIT, _NAME = np.uint64(0x1111), np.uint64(0x2222), np.uint64(0x3333)
#: keep the hashes of widened windows and of plain words from those of templates
_WIDE, _PLAIN = np.uint64(0x4444_0000_0000), np.uint64(0x5555_0000_0000)


def text_hashes(texts: list[str]) -> np.ndarray:
    """The hash of each text as of a word."""
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    return common.span_hashes(np.frombuffer(data, np.uint8), ends - [len(t.encode()) for t in texts], ends, LOWER_VALUES)


@functools.cache
def known_words() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted hashes of the units; of the number words, and the numbers."""
    numbers = text_hashes(list(NUMBER_WORDS))
    order = np.argsort(numbers)
    return np.sort(text_hashes(UNITS)), numbers[order], np.array(list(NUMBER_WORDS.values()))[order]


def number_of(parts: list[int]) -> int:
    """The number that number words say: units and tens add up, a hundred multiplies them, thousands and millions close a part."""
    total = part = 0
    for n in parts:
        if n < 100:
            part += n
        elif n == 100:
            part = max(part, 1) * n
        else:
            total, part = total + max(part, 1) * n, 0
    return total + part


class Words(NamedTuple):
    """A text's words in one form: template hash, slot value (0: a literal) and place (in words of the text) of each, the first of each row, and which differ from the other form."""

    token: np.ndarray
    slot: np.ndarray
    first: np.ndarray
    place: np.ndarray
    changed: np.ndarray


class Parsed:
    """The words of texts: runs of letters, digits and non-ASCII bytes.

    Digits with "." or "," between are one number; a letter after a digit begins a new word, so "5km" is a number and a unit. A unit
    follows a number. A name is capitalised.
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray) -> None:
        digit, letter = DIGIT[buf], LETTER[buf]
        core = digit | letter
        cuts = offsets[(offsets > 0) & (offsets < len(buf))]
        none = np.zeros(min(1, len(buf)), bool)
        before, after = np.concatenate([none, digit[:-1]]), np.concatenate([digit[1:], none])
        before[cuts] = after[cuts - 1] = False
        core |= JOINT[buf] & before & after
        head = np.concatenate([none, core[:-1]])
        head[cuts] = False
        starts = np.flatnonzero(core & (~head | (letter & before)))
        last = np.flatnonzero(core & ~np.concatenate([core[1:], none])) + 1
        ends = last[np.searchsorted(last, starts, "right")] if len(starts) else starts
        ends[:-1] = np.minimum(ends[:-1], starts[1:])
        self.first = np.searchsorted(starts, offsets)
        self.value = common.span_hashes(buf, starts, ends, LOWER_VALUES)
        n = len(starts)
        opens = np.zeros(n, bool)
        opens[self.first[:-1][self.first[:-1] < n]] = True
        digits = digit[starts] & ~letter[ends - 1] if n else opens
        units, numbers, amounts = known_words()
        at = np.minimum(np.searchsorted(numbers, self.value), len(numbers) - 1)
        self.said = ~digits & (numbers[at] == self.value)
        self.amount = amounts[at]
        self.number = digits | self.said
        follows = np.concatenate([np.zeros(min(1, n), bool), self.number[:-1]]) & ~opens
        self.unit = follows & np.isin(self.value, units) & ~self.number
        gap = lambda kind: np.concatenate([[0], np.cumsum(kind[buf])])
        stops, apart = gap(STOP), gap(~JOINING)
        self.sentence = opens.copy()
        self.close = np.zeros(n, bool)  # follows the word before it with nothing between but blanks and hyphens
        if n:
            self.sentence[1:] |= stops[starts[1:]] > stops[ends[:-1]]
            self.close[1:] = (apart[starts[1:]] == apart[ends[:-1]]) & ~opens[1:] & (starts[1:] > ends[:-1])
        self.capital = UPPER[buf[starts]] & ~self.number & ~self.unit

    def form(self, openings: bool) -> Words:
        """The words with capitalised openings of sentences as names, or as literals."""
        name = self.capital & (~self.sentence | openings)
        joined = np.zeros(len(name), bool)
        joined[1:] = self.close[1:] & ~self.sentence[1:] & ((name[1:] & name[:-1]) | (self.said[1:] & self.said[:-1]))
        place = np.flatnonzero(~joined)
        value = self.value.copy()
        inside = np.arange(len(name)) - (place[np.cumsum(~joined) - 1] if len(name) else 0)
        with np.errstate(over="ignore"):
            slot = np.add.reduceat(common.mixed(value ^ (inside.astype(np.uint64) << np.uint64(56))), place) if len(place) else value
        stop = np.append(place[1:], len(name))
        said = np.flatnonzero(self.said[place])
        if len(said):
            slot[said] = common.mixed(text_hashes([str(number_of(self.amount[i:j].tolist())) for i, j in zip(place[said].tolist(), stop[said].tolist(), strict=True)]))
        token = value[place]
        number, unit, name = self.number[place], self.unit[place], name[place]
        token[number], token[unit], token[name] = _NUMBER, _UNIT, _NAME
        changed = self.capital[place] & self.sentence[place]
        return Words(common.mixed(token), np.where(number | unit | name, slot, np.uint64(0)), np.searchsorted(place, self.first), place, changed)

    def plain(self) -> Words:
        """The words with their own values, names and words of one spelling alike, and no slots."""
        n = len(self.value)
        return Words(common.mixed(self.value) ^ _PLAIN, np.zeros(n, np.uint64), self.first, np.arange(n), np.zeros(n, bool))

    def whole_sentence(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether words stand between the beginning and the end of a sentence or text."""
        ending = np.append(self.sentence, True)
        return self.sentence[starts] & ending[ends]


def windows(words: Words, width: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and first word of each window with enough literals."""
    token, slot, first = words[:3]
    hashes = common.window_hashes(token, width) ^ np.uint64(width)
    if not len(hashes):
        return np.zeros(0, np.int64), hashes, np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fixed = np.concatenate([[0], np.cumsum(slot == 0)])
    at = np.flatnonzero((row[: len(hashes)] == row[width - 1 :]) & (fixed[width:] - fixed[:-width] >= literals))
    return row[at], hashes[at], at


def ragged(starts: np.ndarray, ends: np.ndarray, slot: np.ndarray) -> pa.Array:
    """The slots of each span of words as a list."""
    n = ends - starts
    stops = np.cumsum(n)
    at = np.repeat(starts - stops + n, n) + np.arange(stops[-1] if len(stops) else 0)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stops]), pa.int32()), pa.array(slot[at].view(np.int64)))


def stretched(words: Words, width: int, literals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, start and end of the windows with too few literals, widened to the right, and to the left, until they have enough.

    A window is widened by its own words only, so equal words are widened alike in an item and in a document.
    """
    token, slot, first = words[:3]
    n = len(token) - width + 1
    if n <= 0:
        empty = np.zeros(0, np.int64)
        return empty, np.zeros(0, np.uint64), empty, empty
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    fixed = np.concatenate([[0], np.cumsum(slot == 0)])
    literal = np.concatenate([np.full(literals, -1), np.flatnonzero(slot == 0), np.full(literals, -1)])
    low = np.flatnonzero((row[:n] == row[width - 1 :]) & (fixed[width:] - fixed[:-width] < literals))
    right = literal[fixed[low] + 2 * literals - 1]
    left = literal[fixed[low + width]]
    to_right, to_left = (right >= 0) & (row[right] == row[low]), (left >= 0) & (row[left] == row[low])
    starts, ends = np.concatenate([low[to_right], left[to_left]]), np.concatenate([right[to_right] + 1, low[to_left] + width])
    out = np.empty(len(starts), np.uint64)
    step = common.BLOCK // 4
    with np.errstate(over="ignore"):
        for lo in range(0, len(starts), step):
            i, e = starts[lo : lo + step], ends[lo : lo + step]
            base, stop = i.min(), e.max()
            up, down = common.powers(int(stop - base))
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(token[base:stop] * up)])
            out[lo : lo + step] = (total[e - base] - total[i - base]) * down[i - base]
    return row[starts], common.mixed(out) ^ (ends - starts).astype(np.uint64) ^ _WIDE, starts, ends


def template_windows(words: Words, width: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash, start and end of the windows of one width with enough literals, or of the widened ones."""
    if wide:
        return stretched(words, width, LITERALS)
    own, key, starts = windows(words, width, LITERALS)
    return own, key, starts, starts + width


LISTED = "item_id long, form int, kind int, key long, item_pos long, item_words long, item_slots array<long>"


def item_windows(items: DataFrame, width: int) -> DataFrame:
    """The windows of each item in each of its forms; kind: a window's width, 0 if it was widened, less for one of plain words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            parsed = Parsed(*common.byte_buffer(rows.column("text")))
            for form, words in enumerate((parsed.form(False), parsed.form(True))):
                lengths = np.diff(words.first)
                has = np.zeros(len(lengths), bool)
                differs = np.concatenate([[0], np.cumsum(words.changed)])
                wanted = (differs[words.first[1:]] > differs[words.first[:-1]]) | (form == 0)

                def listed(own: np.ndarray, key: np.ndarray, starts: np.ndarray, ends: np.ndarray, kind: int, of: Words) -> pa.RecordBatch:
                    has[own] = True
                    use = wanted[own]
                    own, key, starts, ends = own[use], key[use], starts[use], ends[use]
                    pos = of.place[starts] - parsed.first[own]
                    return common.batch(item_id=rows.column("item_id").take(pa.array(own)), form=np.full(len(own), form, np.int32), kind=np.full(len(own), kind, np.int32), key=common.signed(key), item_pos=pos, item_words=np.diff(parsed.first)[own], item_slots=ragged(starts, ends, of.slot))

                for w in range(LITERALS, width + 1):
                    own, key, starts, ends = template_windows(words, w, False)
                    fits = (lengths[own] == w) if w < width else np.ones(len(own), bool)
                    yield listed(own[fits], key[fits], starts[fits], ends[fits], w, words)
                yield listed(*template_windows(words, width, True), 0, words)
                plain, whole = parsed.plain(), np.diff(parsed.first)
                for w in np.unique(whole[~has & (whole > 0)]).tolist() if form == 0 else ():
                    own, key, starts = windows(plain, w, 0)
                    fits = ~has[own] & (whole[own] == w)
                    yield listed(own[fits], key[fits], starts[fits], starts[fits] + w, -w, plain)

    return items.mapInArrow(run, LISTED).dropDuplicates(["item_id", "form", "key", "item_pos", "item_slots"])


def document_windows(docs: DataFrame, width: int, kinds: list[int], has: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The windows of documents (k_id, row_hash, text) whose key an item may have: k_id, row_hash, key, pos, slots."""

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            buf, offsets = common.byte_buffer(rows.column("text"))
            for lo, hi in common.row_blocks(offsets):
                part = rows.slice(lo, hi - lo)
                parsed = Parsed(buf[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                for form, words in enumerate((parsed.form(False), parsed.form(True), parsed.plain())):
                    differs = np.concatenate([[0], np.cumsum(words.changed)])
                    for kind in kinds:
                        if (kind < 0) != (form == 2):
                            continue
                        if kind < 0:
                            own, key, starts = windows(words, -kind, 0)
                            ends = starts - kind
                        else:
                            own, key, starts, ends = template_windows(words, kind or width, not kind)
                        hit = has(key)
                        if form == 1:  # the other form has the rest
                            hit &= differs[ends] > differs[starts]
                        if -3 < kind < 0:
                            hit &= parsed.whole_sentence(starts, ends)
                        own, key, starts, ends = own[hit], key[hit], starts[hit], ends[hit]
                        yield common.batch(k_id=part.column("k_id").take(pa.array(own)), row_hash=part.column("row_hash").take(pa.array(own)), key=common.signed(key), pos=words.place[starts] - parsed.first[own], slots=ragged(starts, ends, words.slot))

    return docs.mapInArrow(run, "k_id long, row_hash long, key long, pos long, slots array<long>")


def rarest(listed: DataFrame, containment: float) -> DataFrame:
    """item_id, form, key: so many of each item's rarest windows that a document without any of them holds too small a share of the item.

    That holds for the share of all windows and for that of the windows that were not widened.
    """
    keys = listed.groupBy("item_id", "form", "key").agg(F.max((F.col("kind") > 0).cast("int")).alias("narrow"))
    counted = keys.join(keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    parts = []
    for narrow in (0, 1):
        own = Window.partitionBy("item_id", "form")
        some = counted.where(F.col("narrow") >= narrow).withColumns({"r": F.row_number().over(own.orderBy("n", "key")), "all": F.count(F.lit(1)).over(own)})
        parts.append(some.where(F.col("r") <= F.floor((1 - containment) * F.col("all") + 1e-9) + 1).select("item_id", "form", "key"))
    return parts[0].unionByName(parts[1]).distinct()


def contamination(
    df: DataFrame, benchmark: DataFrame, width: int = WIDTH, containment: float = CONTAINMENT, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """doc_id, row_hash, item_id, n_windows, containment, consistency for each document that may hold `containment` of an item's windows.

    containment: share of the item's distinct windows that the document holds, or of those that were not widened if that is more. consistency: share of the item's slot values that stand
    for themselves or for one document value only (1 without slots). Both are taken of each placement of the item: the hits of one offset
    (word of the document less word of the item), those of neighbouring offsets, as in a copy with words put in or left out, and those of
    the whole document; and of each form of the item. The one whose lesser value is largest is told.

    Windows with too few literal words are widened until they have them. Items of 3 or 4 words are one window of that width. An item
    without a window, having under 3 literals, is one window of its plain words, and of one or two words only where they are a whole
    sentence or text of the document. Null and empty texts match nothing. A Bloom filter of fixed size over the benchmark's windows
    spares the other windows of the documents the way to the join; the join decides. Repeated items and rows count each by their ids.
    Empty tables give no rows.
    """
    spark = df.sparkSession
    items = common.pick(benchmark, item_id=(item_col, "long"), text=(item_text_col, "string")).where("text is not null").withColumn("item_id", F.coalesce("item_id", F.lit(common.NULL_ID)))
    listed = common.stored(item_windows(items, width))
    bloom = common.Bloom(spark, listed, "key", 24)
    kinds = [r["kind"] for r in listed.select("kind").distinct().collect()]  # 3 to `width`, 0 for widened ones, less for plain words: as many as the items have lengths
    docs = common.documents(df, id_col, text_col).withColumn("k_id", F.coalesce("doc_id", F.lit(common.NULL_ID)))
    hits = common.stored(document_windows(docs.select("k_id", "row_hash", "text"), width, kinds, bloom.has))
    bloom.drop()
    pair = ["k_id", "row_hash", "item_id", "form"]
    pairs = hits.select("k_id", "row_hash", "key").distinct().join(rarest(listed, containment), "key").select(*pair).distinct()
    narrow = F.when(F.col("kind") > 0, F.col("key"))
    joined = pairs.join(listed.withColumn("narrow", narrow).drop("kind"), ["item_id", "form"]).join(hits, ["k_id", "row_hash", "key"]).withColumn("offset", F.col("pos") - F.col("item_pos"))
    by_offset = Window.partitionBy(*pair).orderBy("offset")
    apart = F.coalesce(F.col("offset") - F.lag("offset").over(by_offset) > F.col("item_words") / 4, F.lit(False))
    joined = joined.withColumn("apart", apart.cast("long")).withColumn("run", F.sum("apart").over(by_offset))
    joined = common.stored(joined.select(*pair, "key", "narrow", "slots", "item_slots", "offset", "run"))
    # a placement is told by its kind and number: one offset, a run of neighbouring offsets, the whole document
    placed = F.array(*(F.struct(F.lit(k).alias("place_kind"), n.alias("number")) for k, n in enumerate((F.col("offset"), F.col("run"), F.lit(0).cast("long")))))
    placement = [*pair, "place_kind", "number"]
    joined = joined.withColumn("placed", F.explode(placed)).select("*", "placed.*")
    total = listed.groupBy("item_id", "form").agg(F.count_distinct("key").alias("item_windows"), F.count_distinct(narrow).alias("item_narrow"))
    shared = joined.groupBy(*placement).agg(F.count_distinct("key").alias("n_windows"), F.count_distinct("narrow").alias("n_narrow"))
    values = joined.select(*placement, F.explode(F.arrays_zip("item_slots", "slots")).alias("slot")).select(*placement, "slot.*").where("item_slots <> 0 or slots <> 0")
    meanings = values.groupBy(*placement, "item_slots").agg(((F.count_distinct("slots") == 1) | F.bool_or(F.col("slots") == F.col("item_slots"))).cast("double").alias("one"))
    consistent = meanings.groupBy(*placement).agg(F.avg("one").alias("consistency"))
    share = F.greatest(F.col("n_windows") / F.col("item_windows"), F.when(F.col("item_narrow") > 0, F.col("n_narrow") / F.col("item_narrow")))
    out = shared.join(total, ["item_id", "form"]).join(consistent, placement, "left").withColumn("containment", share).withColumn("consistency", F.coalesce("consistency", F.lit(1.0)))
    best = F.max(F.struct(F.least("containment", "consistency").alias("least"), "containment", "consistency", "n_windows"))
    best_rows = out.groupBy("k_id", "row_hash", "item_id").agg(best.alias("best"))
    given = lambda c, name: F.nullif(c, F.lit(common.NULL_ID)).alias(name)
    return best_rows.select(given("k_id", "doc_id"), "row_hash", given("item_id", "item_id"), "best.n_windows", "best.containment", "best.consistency")


def contaminated(found: DataFrame, containment: float = CONTAINMENT, consistency: float = CONSISTENCY) -> DataFrame:
    """The rows of `contamination` that tell a benchmark question in a document."""
    return found.where((F.col("containment") >= containment) & (F.col("consistency") >= consistency))


def drop_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `df` without a benchmark question, in the same columns."""
    plain, named = common.keyed(df, id_col, text_col)
    found = contaminated(contamination(df, benchmark, id_col=id_col, text_col=text_col))
    bad = common.stored(found.select(F.coalesce("doc_id", F.lit(common.NULL_ID)).alias("k_id"), F.col("row_hash").alias("k_hash")).distinct())
    return named(plain.join(F.broadcast(bad) if common.few(bad) else bad, ["k_id", "k_hash"], "left_anti"))
