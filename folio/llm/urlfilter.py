"""URL filters by a Bloom filter cascade (operator 12).

Rules list hosts with a path each, to be blocked or allowed; a rule fits its host and all subdomains where the URL's path begins
with the rule's. The keys a URL can be listed under are its host's suffixes joined to prefixes of its path, of the shapes that
occur in the rules. For each verdict a cascade of Bloom filters holds its listed keys: the first level encodes the listed keys,
the second those keys of the corpus that the first takes for listed, the third the listed keys that the second takes for such,
and so on until a level has no false positives. As the levels are built over every key that occurs in the corpus, membership is
exact for it, and looking up is a few bit tests in a broadcast filter: URLs are neither joined nor shuffled.

A cascade grows with the rules, not with the corpus: the first level's error rate is the ratio of listed to other keys, so as many
keys reach the second level as are listed. Rules whose filters would exceed FILTER_BYTES are dealt by key hash into several
cascades, and the URLs pass them one after the other.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.llm.common import materialize

#: Most bytes of filters that are broadcast at a time.
FILTER_BYTES = 64 << 20
#: Up to so many shapes (labels of the host, characters of the path) are looked up one by one; more become all up to their maxima.
SHAPES = 512
#: Levels after which keys must be told apart; only keys of equal 128-bit hashes are not.
LEVELS = 120
#: Verdicts in order of precedence, should a key be listed under both.
VERDICTS = ("block", "allow")
#: Error rate of all levels but the first.
_RATE = 0.5
#: Odd constants of a 64-bit mixer.
_STEP, _MUL1, _MUL2 = (np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://` up to `/`, `?`, `#` or end; A-Z lower-cased) and path (then up to `?`, `#` or end), as they stand; empty without `://`."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, ascii_uppercase, ascii_lowercase), path


def _mixed(x: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x + _STEP * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _MUL1
        x = (x ^ (x >> np.uint64(27))) * _MUL2
        return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Bloom:
    """A Bloom filter of one level: 64-bit words, and how many bits a key sets."""

    words: np.ndarray
    hashes: int
    level: int

    @staticmethod
    def shape(keys: int, rate: float) -> tuple[int, int]:
        """Words and hashes for so many keys at an error rate."""
        bits = math.log2(1 / rate)
        return max(1, math.ceil(keys * bits / math.log(2) / 64)), max(1, round(bits))

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For every key, given as two 64-bit hashes, whether all its bits are set."""
        found = np.ones(len(a), bool)
        for at in positions(a, b, len(self.words), self.hashes, self.level):
            found &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


def positions(a: np.ndarray, b: np.ndarray, words: int, hashes: int, level: int) -> Iterator[np.ndarray]:
    """The bits that keys set: one array for each hash."""
    a, b = _mixed(a, level), _mixed(b, level) | np.uint64(1)
    for _ in range(hashes):
        yield a % np.uint64(words * 64)
        with np.errstate(over="ignore"):
            a = a + b


@dataclass(frozen=True)
class Cascade:
    """Bloom filters that encode, in turn, listed keys and keys taken for listed."""

    levels: tuple[Bloom, ...] = ()

    @property
    def nbytes(self) -> int:
        return sum(level.words.nbytes for level in self.levels)

    def contains(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Membership of keys of the universe: the first level that a key is not in decides, by being odd or even."""
        found = np.zeros(len(a), bool)
        left = np.arange(len(a))
        for depth, level in enumerate(self.levels):
            kept = level.contains(a[left], b[left])
            found[left[~kept]] = depth % 2 == 1
            left = left[kept]
        found[left] = len(self.levels) % 2 == 1
        return found


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("a"), F.xxhash64(key, F.lit("second")).alias("b")]


def _unsigned(s: pd.Series) -> np.ndarray:
    return s.to_numpy(np.int64, copy=False).view(np.uint64)


def _bloom(keys: DataFrame, count: int, rate: float, level: int) -> Bloom:
    """The filter of a table of keys (a, b): tasks set bits, words are combined before and after one shuffle."""
    words, hashes = Bloom.shape(count, rate)

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            at = np.concatenate([np.zeros(0, np.uint64), *positions(_unsigned(batch["a"]), _unsigned(batch["b"]), words, hashes, level)])
            yield pd.DataFrame({"word": (at >> np.uint64(6)).view(np.int64), "bits": (np.uint64(1) << (at & np.uint64(63))).view(np.int64)})

    # At most `words` rows, which FILTER_BYTES bounds.
    rows = keys.mapInPandas(bits, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(words, np.uint64)
    out[rows["word"].to_numpy(np.int64)] = _unsigned(rows["bits"])
    return Bloom(out, hashes, level)


def _passing(spark: SparkSession, filters: list[Bloom | None]) -> Callable[..., Column]:
    """A column of two hashes -> bits of the filters that the key passes."""
    held = spark.sparkContext.broadcast(filters)

    @F.pandas_udf(T.IntegerType())
    def passes(a: pd.Series, b: pd.Series) -> pd.Series:
        out = np.zeros(len(a), np.int32)
        for i, one in enumerate(held.value):
            if one is not None:
                out |= one.contains(_unsigned(a), _unsigned(b)).astype(np.int32) << i
        return pd.Series(out)

    return passes


def _finish(listed: DataFrame, n_listed: int, first: Bloom, taken: DataFrame) -> Cascade:
    """The levels after the first: `taken` (unlisted keys that pass it) against `listed`, until no key is mistaken."""
    levels, keys, others, n = [first], taken, listed, taken.count()
    while n:
        if len(levels) >= LEVELS:
            raise ValueError(f"{n} keys can't be told from others: their hashes are equal")
        level = _bloom(keys, n, _RATE, len(levels))
        levels.append(level)
        passes = _passing(keys.sparkSession, [level])
        keys, others = materialize(others.where(passes("a", "b") > 0), "mistaken"), keys
        n = keys.count()
    return Cascade(tuple(levels))


def cascades(listed: DataFrame, universe: DataFrame, rates: dict[str, tuple[int, float]]) -> dict[str, Cascade]:
    """A cascade for each verdict: listed (verdict, a, b; distinct) against universe (a, b; all keys of the corpus, repeats allowed).

    rates: for each verdict its listed keys and the first level's error rate. The universe is read once; only keys that pass a
    first level are shuffled.
    """
    spark = listed.sparkSession
    lists = {v: listed.where(F.col("verdict") == v).select("a", "b") for v in rates}
    firsts = {v: _bloom(lists[v], n, rate, 0) for v, (n, rate) in rates.items() if n}
    if not firsts:
        return {}
    passes = _passing(spark, list(firsts.values()))
    passing = materialize(universe.select("a", "b", passes("a", "b").alias("passed")).where("passed > 0").distinct(), "passing")
    out = {}
    for i, (v, first) in enumerate(firsts.items()):
        taken = passing.where(F.col("passed").bitwiseAND(1 << i) > 0).select("a", "b")
        out[v] = _finish(lists[v], rates[v][0], first, materialize(taken.join(lists[v], ["a", "b"], "left_anti"), "taken"))
    return out


def _candidates(host: Column, path: Column, shapes: Column) -> Column:
    """The keys that a URL can be listed under: array of (host, path), one for each shape it is long enough for."""
    labels = F.split(host, "\\.")
    fits = F.filter(shapes, lambda s: (F.size(labels) >= s["labels"]) & (F.char_length(path) >= s["chars"]))
    return F.transform(fits, lambda s: F.struct(F.array_join(F.slice(labels, -s["labels"], s["labels"]), ".").alias("host"), F.substr(path, F.lit(1), s["chars"]).alias("path")))


def _shapes(rules: DataFrame) -> Column:
    """The rules' shapes as an array of (labels, chars)."""
    shape = rules.select(F.size(F.split("host", "\\.")).alias("labels"), F.char_length("path").alias("chars")).distinct()
    found = sorted((r.labels, r.chars) for r in shape.limit(SHAPES + 1).collect())
    if len(found) <= SHAPES:
        return F.array(*[F.struct(F.lit(k).alias("labels"), F.lit(c).alias("chars")) for k, c in found])
    most = shape.agg(F.max("labels").alias("labels"), F.max("chars").alias("chars")).first()
    return F.flatten(F.transform(F.sequence(F.lit(1), F.lit(most.labels)), lambda k: F.transform(F.sequence(F.lit(0), F.lit(most.chars)), lambda c: F.struct(k.alias("labels"), c.alias("chars")))))


def judge(df: DataFrame, rules: DataFrame, url_col: str = "url", otherwise: str = "allow", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """df with host, path, rule (host and path of the longest rule that fits, else null) and verdict (its, else `otherwise`).

    rules: host, path, verdict (`block` or `allow`; a key listed under both blocks). Of rules of equal length that fit, that of
    the longer host wins. Rules without a host fit nothing, a null path is empty; repeated rules count once. URLs that are null
    or without `://` have an empty host and path and no rule. Rows that share a URL are judged alike; whole URLs are read, of
    any length. Columns of df named host, path, rule or verdict are replaced. Empty tables give no rows, no rules no rule.
    """
    spark = df.sparkSession
    rules = rules.select(F.translate("host", ascii_uppercase, ascii_lowercase).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> ''")
    key = F.struct("host", "path")
    listed = materialize(rules.select("host", "path", "verdict", *_hashes(key)).distinct(), "rules")
    host, path = host_and_path(F.col(url_col))
    rows = df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    counts = {v: listed.where(F.col("verdict") == v).count() for v in VERDICTS}
    if not any(counts.values()):
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(otherwise)})

    shapes = _shapes(listed)
    found = _candidates(F.col("host"), F.col("path"), shapes)
    universe = rows.select(F.explode(found).alias("key")).select(*_hashes(F.col("key")))
    keys = max(1, universe.agg(F.approx_count_distinct("a")).first()[0])
    rates = {v: (n, min(_RATE, n / (keys + n))) for v, n in counts.items()}
    # The first level, and as many keys again at each of the levels of half the size.
    estimate = sum(8 * (Bloom.shape(n, rate)[0] + 4 * Bloom.shape(2 * n, _RATE)[0]) for n, rate in rates.values() if n)
    shards = -(-estimate // filter_bytes)
    judged = rows.withColumn("_keys", found).withColumn("_marks", F.transform("_keys", lambda k: F.lit(0)))
    for shard in range(shards):
        mine = lambda c: F.pmod(c, F.lit(shards)) == shard  # noqa: E731, B023
        part = listed if shards == 1 else listed.where(mine(F.col("a")))
        of_part = {v: (part.where(F.col("verdict") == v).count(), rate) for v, (_, rate) in rates.items()} if shards > 1 else rates
        held = spark.sparkContext.broadcast(cascades(part, universe if shards == 1 else universe.where(mine(F.col("a"))), of_part))

        @F.pandas_udf(T.ArrayType(T.IntegerType()))
        def marks(a: pd.Series, b: pd.Series) -> pd.Series:
            sizes = np.fromiter(map(len, a), np.int64, len(a))
            flat = [np.concatenate([np.zeros(0, np.int64), *s]).astype(np.int64).view(np.uint64) for s in (a, b)]
            out = np.zeros(len(flat[0]), np.int32)
            for v in reversed(VERDICTS):
                if v in held.value:  # noqa: B023
                    out[held.value[v].contains(*flat)] = 1 + VERDICTS.index(v)  # noqa: B023
            return pd.Series(np.split(out, np.cumsum(sizes)[:-1]) if len(sizes) else [])

        seen = marks(F.transform("_keys", lambda k: _hashes(k)[0]), F.transform("_keys", lambda k: _hashes(k)[1]))
        if shards > 1:
            seen = F.zip_with("_keys", seen, lambda k, m: F.when(mine(F.xxhash64(k)), m).otherwise(0))
            judged = materialize(judged.withColumn("_marks", F.zip_with("_marks", seen, lambda x, y: F.greatest(x, y))), "judged")
        else:
            judged = judged.withColumn("_marks", seen)
    ranked = F.zip_with("_keys", "_marks", lambda k, m: F.struct((F.char_length(k["host"]) + F.char_length(k["path"])).alias("chars"), F.char_length(k["host"]).alias("of_host"), F.concat(k["host"], k["path"]).alias("rule"), m.alias("mark")))
    best = F.array_max(F.filter(ranked, lambda r: r["mark"] > 0))
    verdict = F.coalesce(F.element_at(F.array(*map(F.lit, VERDICTS)), F.nullif(best["mark"], F.lit(0))), F.lit(otherwise))
    return judged.withColumns({"rule": best["rule"], "verdict": verdict}).drop("_keys", "_marks")
