"""URL filters: host and path rules held in a Bloom filter cascade.

Level 1 encodes the listed keys. Level 2 encodes the keys of the corpus that
level 1 lets through by mistake, level 3 the listed keys that level 2 lets
through, and so on until a level makes no mistake. Over that corpus membership
is then exact, and testing a key needs no join: the levels travel as literals.

A key is a rule's host and path joined, like example.com/en/. A URL has one
candidate key for each number of host labels and each path length that occur in
the rules. Null URLs and those without :// have an empty host and no candidates.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass
from math import ceil, log, log2, sqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.scratch import Scratch

_LETTERS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@dataclass(frozen=True)
class Rule:
    """host without a leading dot; path empty or starting with /; verdict allow or block."""

    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


#: The rules of the registered query.
RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)


# -- the cascade ------------------------------------------------------------


@dataclass(frozen=True)
class Level:
    """A Bloom filter: words are its bits, 64 to a comma-separated integer."""

    words: str
    bits: int
    hashes: int
    seed: int

    def passes(self, key: Column) -> Column:
        """Whether all of key's bits are set: looked up one after another until one is not. The words are one literal."""
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")

        def is_set(place: Column) -> Column:
            word = F.element_at(words, (F.shiftright(place, 6) + 1).cast("int"))
            return F.call_function("shiftright", word, place.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

        turns = F.sequence(F.lit(0), F.lit(self.hashes - 1))
        return F.forall(turns, lambda turn: is_set(position(key, self.bits, turn, self.seed)))


def position(key: Column, bits: int, turn: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(seed), turn), F.lit(bits)).cast("bigint")


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [position(key, bits, F.lit(i), seed) for i in range(hashes)]


def build_level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    """A filter for the count strings in column key that lets others through at the rate."""
    hashes = max(1, ceil(log2(1 / rate)))
    bits = max(64, 64 * ceil(count * hashes / log(2) / 64))
    place = F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("place")
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("place").bitwiseAND(F.lit(63)).cast("int"))
    words = keys.select(place).groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(one).alias("bits"))
    found = dict(words.collect())  # at most bits / 64 rows
    return Level(",".join(str(found.get(i, 0)) for i in range(bits // 64)), bits, hashes, seed)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Whether key is listed; exact for the listed keys and the universe it was built over."""
        found = F.lit(len(self.levels) % 2 == 1)
        for i, level in reversed(list(enumerate(self.levels))):
            found = F.when(level.passes(key), found).otherwise(F.lit(i % 2 == 1))
        return found


def build_cascade(listed: DataFrame, universe: DataFrame, universe_size: int) -> Cascade:
    """listed and universe have a string column key.

    The levels go with each task: under 64 bits a listed key, less than the keys themselves,
    which the caller holds. universe_size: about the number of keys in universe, repeats counted; it only
    sets the first level's size. The universe is read once for the first level;
    later levels work on mistakes alone, about as many as there are listed keys.
    """
    listed = listed.select("key").distinct()
    count = listed.count()
    if not count:
        return Cascade(())
    rate = min(0.5, max(2**-30, count * sqrt(0.5) / max(universe_size, 1)))
    first = build_level(listed, count, rate, 0)
    passed = universe.select("key").where(first.passes(F.col("key"))).distinct()
    levels = [first]
    encoded, others = listed, Scratch(listed.sparkSession).write(passed.join(listed, "key", "left_anti"))
    while (count := others.count()) > 0:
        levels.append(build_level(others, count, 0.5, len(levels)))
        encoded, others = others, encoded.where(levels[-1].passes(F.col("key")))
    return Cascade(tuple(levels))


# -- URLs -------------------------------------------------------------------


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit("")), *_LETTERS)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, labels: Sequence[int], lengths: Sequence[int]) -> Column:
    """The keys a rule could have that fits host and path: structs of (size, host_size, key)."""
    integers = lambda found: F.array(*(F.lit(i) for i in sorted(set(found))))
    has_labels = F.size(F.split(host, r"\."))

    def of_host(count: Column) -> Column:
        end = F.call_function("substring_index", host, F.lit("."), -count)

        def of_path(length: Column) -> Column:
            key = F.concat(end, F.substring(path, F.lit(1), length))
            fits = (has_labels >= count) & (F.length(path) >= length) & (host != "")
            return F.when(fits, F.struct(F.length(key).alias("size"), F.length(end).alias("host_size"), key.alias("key")))

        return F.transform(integers(lengths), of_path)

    return F.filter(F.flatten(F.transform(integers(labels), of_host)), lambda c: c.isNotNull())


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow", url: str = "url") -> DataFrame:
    """pages with columns host, path, rule and verdict; columns of those names are replaced.

    A rule fits its host and all subdomains if the URL's path starts with the
    rule's; the longest fitting rule wins, of equally long ones that with the
    longer host. rule is null and verdict the default where none fits. Of rules
    with the same key the last counts. An empty page table gives an empty result.
    """
    spark = pages.sparkSession
    verdicts = {r.key: r for r in rules}
    parsed = pages.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    if not verdicts:
        return parsed.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    labels = {r.host.count(".") + 1 for r in verdicts.values()}
    lengths = {len(r.path) for r in verdicts.values()}
    keys = candidates(F.col("host"), F.col("path"), sorted(labels), sorted(lengths))
    listed = _keys(spark, list(verdicts))
    corpus = pages.select(host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    # written once for its size and the first level
    universe = Scratch(spark).write(corpus.select(F.explode(keys).alias("c")).select("c.key"))
    cascade = build_cascade(listed, universe, universe.count())
    blocked = _keys(spark, [k for k, r in verdicts.items() if r.verdict == "block"])
    blocking = build_cascade(blocked, listed, len(verdicts))
    best = F.array_max(F.filter(keys, lambda c: cascade.contains(c["key"])))["key"]
    verdict = F.when(F.col("rule").isNull(), F.lit(default))
    verdict = verdict.when(blocking.contains(F.col("rule")), F.lit("block")).otherwise(F.lit("allow"))
    return parsed.withColumn("rule", best).withColumn("verdict", verdict)


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    """A table of strings without a Python worker; strings are passed as one JSON literal."""
    text = F.lit(json.dumps(keys, ensure_ascii=False))
    return spark.range(1, numPartitions=1).select(F.explode(F.from_json(text, "array<string>")).alias("key"))


# -- the registered query ---------------------------------------------------


def op10_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


ORACLE = r"""
WITH parsed AS (
  SELECT page_id,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0
      THEN translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN regexp_extract(url, '://[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(h, p, v) AS (VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
fits AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS verdict
  FROM parsed JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parsed LEFT JOIN fits USING (page_id)
"""
