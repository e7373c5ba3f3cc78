"""URL rules by Bloom filter cascades, with DataFrame functions only.

A rule is a host and a path; it fits the host and its subdomains where the url's path starts with the rule's. Every url has a few
candidate keys (each suffix of its host with each prefix of its path that ends in "/"). A cascade holds the listed keys exactly over
the complete universe of candidate keys in the corpus: level 1 is a Bloom filter of the listed keys, level 2 one of the corpus keys
that pass level 1 unlisted, level 3 one of the listed keys that pass level 2, and so on until nothing passes wrongly. The first level
that a key fails tells whether it is listed, so judging a url needs no join. Level sizes follow the list, not the corpus: with r
listed among u keys the first level takes a false positive rate of about r / u, the others 1/2. So the filters take 1.44 log2(u / r)
bits a rule and a few more, less than the rules' own texts, which the caller holds, and go with the plan for any number of rules.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def key(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Level:
    """A Bloom filter: 64-bit words, its hash count and its seed."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def might_hold(self, key: Column) -> Column:
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")  # folded into a literal when the plan is made
        out = F.lit(True)
        for spot in spots(key, len(self.words), self.hashes, self.seed):
            word = F.element_at(words, (F.shiftright(spot, 6) + 1).cast("int"))
            out = out & (F.getbit(word, spot.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return out


def spots(key: Column, words: int, hashes: int, seed: int) -> list[Column]:
    """The bits of a key in a filter of 64 x `words` bits."""
    return [F.pmod(F.xxhash64(F.lit(seed), F.lit(i), key), F.lit(64 * words)) for i in range(hashes)]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: then up to "?", "#" or the end. Else both empty."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: Column, path: Column, labels: int, depth: int) -> Column:
    """Keys of a url, longest first (of equal length the longer host): host suffixes of up to `labels` labels with path prefixes of up to `depth` slashes."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    hosts = F.transform(F.sequence(F.lit(1), F.least(n, F.lit(labels))), lambda k: F.concat_ws(".", F.slice(parts, n - k + 1, k)))
    pieces = F.split(path, "/", -1)
    slashes = F.size(pieces) - 1
    prefixes = F.when(slashes > 0, F.transform(F.sequence(F.lit(1), F.least(slashes, F.lit(depth))), lambda k: F.concat(F.concat_ws("/", F.slice(pieces, 1, k)), F.lit("/")))).otherwise(F.array().cast("array<string>"))
    pairs = F.flatten(F.transform(hosts, lambda h: F.transform(prefixes, lambda p: F.struct((-F.length(h) - F.length(p)).alias("order"), (-F.length(h)).alias("then"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


def bloom(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of the n rows of column `key`; its bits, not its keys, come to the driver."""
    hashes = max(1, round(-math.log2(rate)))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    bits = keys.select(F.explode(F.array(*spots(F.col("key"), words, hashes, seed))).alias("spot"))
    rows = bits.groupBy(F.shiftright("spot", 6).cast("int").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 as int))")).alias("bits")).collect()
    out = [0] * words
    for r in rows:
        out[r["word"]] = r["bits"]
    return Level(tuple(out), hashes, seed)


def cascade(listed: DataFrame, universe: DataFrame, n_listed: int, n_universe: int) -> list[Level]:
    """Levels that tell the rows of `listed` (column key, distinct) from all other rows of `universe`, without error on either."""
    if not n_listed:
        return []
    levels: list[Level] = []
    inside, outside = listed, universe.join(listed, "key", "left_anti")
    rate = min(0.5, n_listed / max(1, n_universe))
    n = n_listed
    while n:
        level = bloom(inside, n, rate, len(levels) + 1)
        levels.append(level)
        wrong = outside.where(level.might_hold(F.col("key")))
        wrong = common.stored(wrong.distinct())
        n, rate = wrong.count(), 0.5
        inside, outside = wrong, inside
    return levels


def listed_in(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: it is if it passes an odd number of levels before it fails, or all of an odd number."""
    out = F.lit(len(levels) % 2 == 1)
    for n in range(len(levels), 0, -1):
        out = F.when(levels[n - 1].might_hold(key), out).otherwise(F.lit(n % 2 == 0))
    return out


def key_rows(spark: SparkSession, keys: list[str]) -> DataFrame:
    """The keys as rows of one column, from one literal."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(keys)), "array<string>")).alias("key"))


def judge(df: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest rule that fits, else null), verdict (its own, else `default`).

    A rule's path must end in "/". Of rules equal in length the one with the longer host wins; a rule that is listed as both blocks.
    A null url, or one without "://", has an empty host and path, fits no rule and takes the default. Repeated rows stay; an empty table
    gives no rows; other columns are left out, whatever their names.
    """
    if any(not r.path.startswith("/") or not r.path.endswith("/") or r.verdict not in ("allow", "block") for r in rules):
        raise ValueError("a rule allows or blocks and has a path from / to /")
    spark = df.sparkSession
    labels, depth = max([1, *(r.host.count(".") + 1 for r in rules)]), max([1, *(r.path.count("/") for r in rules)])
    pages = common.pick(df, page_id=(id_col, "long"), url=(url_col, "string"))
    host, path = host_and_path(F.col("url"))
    pages = pages.select("page_id", host.alias("host"), path.alias("path")).withColumn("keys", candidate_keys(F.col("host"), F.col("path"), labels, depth))
    blocked = sorted({r.key for r in rules if r.verdict == "block"})
    allowed = sorted({r.key for r in rules if r.verdict == "allow"} - set(blocked))
    universe = common.stored(pages.select(F.explode("keys").alias("key")).distinct())
    size = universe.count()
    block, allow = (cascade(key_rows(spark, x), universe, len(x), size) for x in (blocked, allowed))
    marked = F.transform("keys", lambda k: F.struct(k.alias("key"), listed_in(block, k).alias("block"), listed_in(allow, k).alias("allow")))
    first = F.element_at(F.filter(marked, lambda x: x["block"] | x["allow"]), 1)
    found = F.when(F.exists(marked, lambda x: x["block"] | x["allow"]), first)
    return pages.withColumn("found", found).select(
        "page_id", "host", "path", F.col("found.key").alias("rule"), F.when(F.col("found.block"), F.lit("block")).when(F.col("found.allow"), F.lit("allow")).otherwise(F.lit(default)).alias("verdict")
    )
