"""Language identification: hashed subword embeddings, averaged, under a linear softmax, trained by stochastic gradient descent in numpy.

Subwords are the 1- to 4-character pieces inside lower-cased words, with a mark at each word's edges. A prediction averages their
embeddings over the whole text. Confidence is calibrated by a temperature on labelled rows kept from training.

Confidence alone cannot tell a text of no learned language, as the languages share one unit of it. So rejection goes by familiarity: the
mean log probability of a text's subwords under their frequency in the predicted language. Labelled rows kept from training, cut to
several lengths, tell how low it gets for true text of that length, and a text below nearly all of them is rejected.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import common

LOG2_BUCKETS = 15
LONGEST = 4
#: labelled documents that training reads: of each language at most, of all languages about (never under LEAST_PER_LANGUAGE of one)
SAMPLE_PER_LANGUAGE, SAMPLE, LEAST_PER_LANGUAGE = 500, 4000, 10
#: lengths in subwords at which familiarity is calibrated, and the share of true texts that may fall below
LENGTHS = (8, 32, 128, 512, 2048)
REJECTED_SHARE = 0.0005
#: how far below that the floor lies, as a part of the way to the familiarity of subwords drawn at random
MARGIN = 0.3
UNDETERMINED = "und"


@functools.cache
def character_table() -> np.ndarray:
    """Each code point's lower-case letter, and 32 for what is no letter."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """Lower-cased letters with one 32 between words and at both ends."""
    codes = character_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    codes = np.concatenate([[32], codes, [32]]).astype(np.uint32)
    gap = codes == 32
    return codes[~(gap & np.concatenate([[False], gap[:-1]]))]


def subwords(codes: np.ndarray) -> np.ndarray:
    """Buckets of all pieces of 1 to LONGEST characters; a piece may begin or end with a word's edge and holds none inside."""
    gap = codes == 32
    found = []
    with np.errstate(over="ignore"):
        h = np.zeros(len(codes), np.uint64)
        inner = np.zeros(len(codes), bool)  # a gap after the first character and before the last
        for n in range(1, LONGEST + 1):
            m = len(codes) - n + 1
            if m <= 0:
                break
            h = h[:m] * np.uint64(0x100000001B3) + codes[n - 1 :].astype(np.uint64) + np.uint64(n)
            if n > 2:
                inner = inner[:m] | gap[n - 2 : n - 2 + m]
            keep = ~inner[:m]
            if n == 1:
                keep &= ~gap
            elif n == 2:
                keep &= ~(gap[:m] & gap[1:])
            x = h[keep]
            found.append(((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - LOG2_BUCKETS))
    return np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def text_pieces(text: str, size: int = 1 << 18) -> Iterator[str]:
    """A long text in parts, so that memory stays bounded; the cuts lie at words' ends where there are any."""
    at = 0
    while at < len(text):
        stop = at + size
        if stop < len(text):
            space = text.rfind(" ", at, stop)
            stop = space + 1 if space > at else stop
        yield text[at:stop]
        at = stop


def counted(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts."""
    if len(buckets) < 2000:
        return np.unique(buckets, return_counts=True)
    total = np.bincount(buckets, minlength=1 << LOG2_BUCKETS)
    at = np.flatnonzero(total)
    return at, total[at]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a whole text and their counts."""
    parts = [counted(subwords(letters(part))) for part in text_pieces(text or "")]
    if len(parts) == 1:
        return parts[0]
    total = np.zeros(1 << LOG2_BUCKETS, np.int64)
    for at, n in parts:
        total[at] += n
    at = np.flatnonzero(total)
    return at, total[at]


def log_probabilities(familiar: tuple[np.ndarray, np.ndarray, float], at: np.ndarray) -> np.ndarray:
    """The log probabilities of some buckets under what a language is known by."""
    buckets, logs, otherwise = familiar
    k = np.minimum(np.searchsorted(buckets, at), len(buckets) - 1)
    return np.where(buckets[k] == at, logs[k], otherwise)


@dataclass
class Model:
    languages: list[str]
    #: what one piece of each bucket adds, to be multiplied by `output`: its embedding, or its logits where there are fewer languages
    table: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    temperature: float
    #: by language: the buckets it has, in order, and their log probabilities, that of every other bucket, least familiarity at each of LENGTHS
    familiar: list[tuple[np.ndarray, np.ndarray, float]]
    floors: np.ndarray

    def familiarity(self, language: int, at: np.ndarray) -> np.ndarray:
        return log_probabilities(self.familiar[language], at)

    def probabilities(self, logits: np.ndarray) -> np.ndarray:
        x = logits / self.temperature
        x = np.exp(x - x.max(axis=-1, keepdims=True))
        return x / x.sum(axis=-1, keepdims=True)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, calibrated confidence, whether it is rejected."""
        at, times = features(text)
        n = int(times.sum())
        if not n or not self.languages:
            return UNDETERMINED, 0.0, True
        p = self.probabilities(times @ self.table[at] / n @ self.output + self.bias)
        best = int(p.argmax())
        seen = times @ self.familiarity(best, at) / n
        return self.languages[best], float(p[best]), bool(seen < np.interp(np.log(n), np.log(LENGTHS), self.floors[best]))


def train_held_out(doc_id: Column) -> Column:
    """Documents that training must not see: crc32 of the id's text is a multiple of 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sample(df: DataFrame, text_col: str, label_col: str, per_language: int) -> DataFrame:
    """At most `per_language` rows of each label, fewer where SAMPLE is shared by many, by smallest hash of the text.

    All labels are learned. Rows are ranked within 64 salts first, so no label is gathered.
    """
    from pyspark.sql import Window

    rows = common.pick(df, text=(text_col, "string"), lang=(label_col, "string")).where("text is not null and lang is not null").select("lang", F.xxhash64("text").alias("h"), "text")
    languages = rows.agg(F.count_distinct("lang")).first()[0]
    most = min(per_language, max(LEAST_PER_LANGUAGE, SAMPLE // max(1, languages)))
    keys = rows.select("lang", "h").distinct().withColumn("salt", F.pmod("h", F.lit(64)))
    short = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h"))).where(F.col("r") <= most)
    best = short.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= most).select("lang", "h")
    few = languages * most <= common.BROADCAST_ROWS
    return rows.join(F.broadcast(best) if few else best, ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"])


def familiarity(shares: Callable[[int], tuple[np.ndarray, np.ndarray]], target: np.ndarray, languages: int, calibration: np.ndarray, random: np.random.Generator) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], np.ndarray]:
    """Log probability of each bucket by language, from the rows not kept for calibration, and by language the floor at each of LENGTHS.

    A text of n subwords is drawn from a kept row's own subwords; the floor is the REJECTED_SHARE quantile of many such texts' means,
    as a normal law of their mean and spread gives it, for few rows cannot show so rare an event, and MARGIN below it. A language of a
    single row is calibrated on that row, so every language rejects.
    """
    deep = NormalDist().inv_cdf(1 - REJECTED_SHARE)
    known, floors = [], np.empty((languages, len(LENGTHS)))
    for language in range(languages):
        own = np.flatnonzero(target == language)
        counts = np.full(1 << LOG2_BUCKETS, 0.05)
        learned = own[~calibration[own]]
        for k in learned:
            at, share = shares(k)
            counts[at] += share * 1000
        logs = np.log(counts / counts.sum())
        seen = np.flatnonzero(counts > 0.05)
        known.append((seen.astype(np.uint16), logs[seen].astype(np.float32), float(logs[counts == 0.05][0]) if len(seen) < len(counts) else 0.0))
        kept = own[calibration[own]] if calibration[own].any() else learned
        for j, n in enumerate(LENGTHS):
            means = [float((random.multinomial(n, share) @ logs[at]) / n) for at, share in map(shares, kept) for _ in range(max(1, 200 // len(kept)))]
            true = min(min(means), np.mean(means) - deep * np.std(means))
            floors[language, j] = true - MARGIN * (true - logs.mean())  # the mean: subwords drawn evenly, which no language does
    return known, floors


def train(df: DataFrame, text_col: str = "text", label_col: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE, width: int = 16, epochs: int = 8, rate: float = 0.5, seed: int = 11) -> Model:
    """A model of the labels in `df`, from a bounded sample; executors count subwords and the driver gets the sparse counts alone.

    All subwords of a sampled text count. A document's counts are at most 2 ** 15 of 6 bytes, however long its text, and those of SAMPLE
    documents, or of LEAST_PER_LANGUAGE a language where these are more, come to the driver. One fifth of each language's rows, one at
    least where it has two, calibrates the temperature and the floors of familiarity. Without labelled rows the model knows no language
    and rejects everything. Texts that repeat count once; nulls in either column are left out.
    """

    @common.tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for lang, h, text in zip(*(rows.column(c).to_pylist() for c in ("lang", "h", "text")), strict=True):
                at, n = features(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h], pa.int64()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([n.astype("<f4").tobytes()], pa.binary())], ["lang", "h", "at", "n"])

    got = sample(df, text_col, label_col, per_language).select("lang", "h", "text").mapInArrow(count, "lang string, h long, at binary, n binary").toArrow().to_pylist()
    rows = sorted(((r["lang"], r["h"], np.frombuffer(r["at"], "<u2"), np.frombuffer(r["n"], "<f4")) for r in got if len(r["at"])), key=lambda r: (r[1], r[0]))
    del got
    languages = sorted({r[0] for r in rows})
    if not languages:
        none = np.zeros((1 << LOG2_BUCKETS, 0), np.float32)
        return Model([], none, np.zeros((0, 0)), np.zeros(0), 1.0, [], np.zeros((0, len(LENGTHS))))
    target = np.array([languages.index(r[0]) for r in rows])
    calibration = np.zeros(len(rows), bool)
    for language in range(len(languages)):
        own = np.flatnonzero(target == language)
        calibration[own[4::5] if len(own) >= 5 else own[1:][-1:]] = True
    random = np.random.default_rng(seed)
    embedding = random.normal(0, 0.1, (1 << LOG2_BUCKETS, width))
    output, bias = np.zeros((width, len(languages))), np.zeros(len(languages))
    order = np.flatnonzero(~calibration)

    def shares(k: int) -> tuple[np.ndarray, np.ndarray]:
        """A row's buckets and their shares; rows themselves stay in the 6 bytes a bucket that they came in."""
        n = rows[k][3].astype(np.float64)
        return rows[k][2].astype(np.intp), n / n.sum()

    steps, step = epochs * len(order), 0
    for _ in range(epochs):
        for k in random.permutation(order):
            at, w = shares(k)
            lr = rate * (1 - step / steps) + 0.01
            step += 1
            mean = w @ embedding[at]
            logits = mean @ output + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[target[k]] -= 1
            back = output @ p
            output -= lr * np.outer(mean, p)
            bias -= lr * 0.1 * p
            embedding[at] -= lr * np.outer(w, back) * 20
    kept = calibration if calibration.any() else np.ones(len(rows), bool)
    logits = np.array([w @ embedding[at] @ output + bias for at, w in map(shares, np.flatnonzero(kept))])
    table, last = (embedding @ output, np.eye(len(languages))) if len(languages) <= width else (embedding, output)
    familiar, floors = familiarity(shares, target, len(languages), calibration, random)
    del rows
    common.give_back()
    model = Model(languages, table, last, bias, 1.0, familiar, floors)

    def loss(temperature: float) -> float:
        model.temperature = temperature
        return float(-np.log(np.maximum(1e-12, model.probabilities(logits)[np.arange(kept.sum()), target[kept]])).mean())

    model.temperature = float(min(np.geomspace(0.05, 20, 60), key=loss))
    return model


def predict(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row_hash, lang_pred, score and rejected for each row, from its whole text alone.

    A null text, an empty one and one without letters give `und`, score 0, rejected. Repeated rows and null ids keep their rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # 2 ** 15 buckets of 128 bytes at most, and of 6 bytes a language for those its sampled rows have

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = [shared.value.predict(x.as_py()) for x in rows.column("text")]
            lang, score, rejected = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("row_hash"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "row_hash", "lang_pred", "score", "rejected"]
            )

    return common.documents(df, id_col, text_col).mapInArrow(run, "doc_id long, row_hash long, lang_pred string, score double, rejected boolean")


def keep_identified(df: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of `df` that the model does not reject, in the same columns; a filter, so nothing is shuffled."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = df.columns
    at = common.position(df, text_col)
    plain = df.toDF(*(f"c{k}" for k in range(len(names))))

    @common.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            yield rows.filter(pa.array([not shared.value.predict(None if (t := x.as_py()) is None else str(t))[2] for x in rows.column(at)], pa.bool_()))

    return plain.mapInArrow(run, plain.schema).toDF(*names)
