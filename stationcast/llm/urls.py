"""URL rules by a cascade of Bloom filters: exact membership of listed keys without a join.

A rule is a host and a beginning of the path. It fits its host and all subdomains, where
the url's path starts with the rule's; the longest fitting rule decides, of equally long
ones the one with the longer host; the same rule listed with both verdicts blocks. A url
that no rule fits is allowed.

The keys looked up for a url are the ends of its host with as many labels, and the
beginnings of its path with as many characters, as rules have (their *shapes*). All keys of
all urls are the universe. Level 1 of the cascade encodes the listed keys; level 2 the keys
of the universe that level 1 wrongly accepts; level 3 the listed keys that level 2 wrongly
accepts, and so on until nothing is wrongly accepted. A key is then looked up level by
level: the first level without it tells whether it is listed, exactly, for every key of the
universe. A second cascade, over the rules, tells the blocking ones.

Each filter is made of 64-bit words; a key sets its bits in one of them. Only keys that
level 1 accepts are shuffled, and the look-up shuffles nothing. Filters reach the tasks as
scalar subqueries of at most ``MAX_BITS`` bits. Longer lists are cut into parts by a hash of
the key and lists of many shapes into groups of ``SHAPES``, each with cascades and a pass
over the urls of its own. Everything is built-in functions.

Null urls and urls without ``://`` have an empty host and path and no rule. Repeated rows
stay. Rules without a host or a verdict are left out; a null path is empty. An empty table
of urls gives an empty result, one of rules a result without rules.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stationcast.session import durable

#: Bits of one filter (4 MB): some 2.9 million keys on the first level.
MAX_BITS = 1 << 25
#: Shapes looked up in one pass.
SHAPES = 16
#: Bits of a key on the first level and on the others.
FIRST, LATER = 8, 4
ALLOW, BLOCK = "allow", "block"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def word_of(key: Column, size: int, level: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(level), F.lit(0)), F.lit(size)).cast("int")


def bits_of(key: Column, hashes: int, level: int) -> Column:
    """The key's bits in its word, at places that 6 bits each of one hash name."""
    own = F.xxhash64(key, F.lit(level), F.lit(1))
    places = [F.shiftright(own, 6 * i).bitwiseAND(63).cast("int") for i in range(hashes)]
    return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])


@dataclass
class Bloom:
    """One level: ``words`` is a scalar subquery with ``size`` words of bits."""

    words: Column
    size: int
    hashes: int
    level: int

    def accepts(self, key: Column) -> Column:
        bits = bits_of(key, self.hashes, self.level)
        return F.get(self.words, word_of(key, self.size, self.level)).bitwiseAND(bits) == bits


def words_needed(n: int, hashes: int) -> int:
    return max(1, math.ceil(n * hashes / math.log(2) / 64))


def bloom(keys: DataFrame, n: int, hashes: int, level: int) -> Bloom:
    """The filter of the ``n`` keys in column ``key``: bits by word, then one row with all words."""
    size = words_needed(n, hashes)
    key = F.col("key")
    bits = keys.select(word_of(key, size, level).alias("word"), bits_of(key, hashes, level).alias("bits"))
    empty = keys.sparkSession.range(size).select(F.col("id").cast("int").alias("word"), F.lit(0).cast("long").alias("bits"))
    by_word = bits.unionByName(empty).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    row = by_word.agg(F.transform(F.array_sort(F.collect_list(F.struct("word", "bits"))), lambda w: w.bits).alias("words"))
    return Bloom(durable(row, "bloom").scalar(), size, hashes, level)


@dataclass
class Cascade:
    """Exact membership for the keys of the universe it was built over."""

    levels: list[Bloom]

    def lists(self, key: Column) -> Column:
        found = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            found = F.when(self.levels[i - 1].accepts(key), found).otherwise(F.lit(i % 2 == 0))
        return found


def build(listed: DataFrame, universe: DataFrame) -> Cascade:
    """The cascade of the distinct keys of ``listed`` (written) over ``universe``; both have a column ``key``."""
    n = listed.count()
    if not n:
        return Cascade([])
    levels = [bloom(listed, n, FIRST, 1)]
    accepted = durable(universe.filter(levels[0].accepts(F.col("key"))).distinct(), "accepted")
    encoded, wrong = accepted.join(listed, "key", "left_semi"), durable(accepted.join(listed, "key", "left_anti"), "wrong")
    while n := wrong.count():
        levels.append(bloom(wrong, n, LATER, len(levels) + 1))
        encoded, wrong = wrong, durable(encoded.filter(levels[-1].accepts(F.col("key"))), "wrong")
    return Cascade(levels)


def rule_keys(rules: DataFrame) -> DataFrame:
    """Distinct keys of the rules, their shape, and whether they block."""
    host, path = lower_ascii(F.col("host")), F.coalesce("path", F.lit(""))
    known = F.col("host").isNotNull() & F.col("verdict").isin(ALLOW, BLOCK)
    shaped = rules.filter(known).select(
        F.concat(host, path).alias("key"), labels(host).alias("labels"), F.length(path).alias("n_path"), (F.col("verdict") == BLOCK).alias("blocks")
    )
    return shaped.groupBy("key", "labels", "n_path").agg(F.max("blocks").alias("blocks"))


def candidates(shapes: list[tuple[int, int]]) -> list[Column]:
    """For each shape the key a rule would have that fits ``host`` and ``path``: length, n_host, rule; or null."""
    host, path = F.col("host"), F.col("path")
    made = []
    for n_labels, n_path in shapes:
        end = F.substring_index(host, ".", -n_labels)
        rule = F.concat(end, F.substring(path, 1, n_path))
        fits = (labels(host) >= n_labels) & (F.length(path) >= n_path)
        made.append(F.when(fits, F.struct(F.length(rule).alias("length"), F.length(end).alias("n_host"), rule.alias("rule"))))
    return made


def longest(found: list[Column]) -> Column:
    return F.greatest(*found) if len(found) > 1 else found[0]


def judge(
    urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", max_bits: int = MAX_BITS, most_shapes: int = SHAPES
) -> DataFrame:
    """One row per url: id, host, path, the deciding rule (or null) and the verdict.

    ``rules`` has host, path and verdict (allow or block).
    """
    keys = durable(rule_keys(rules), "rules")
    # distinct numbers of labels and characters: bounded by the forms of rules, not by their number
    shapes = sorted((r.labels, r.n_path) for r in keys.select("labels", "n_path").distinct().collect())
    host, path = host_and_path(F.col(url_col))
    split = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    n_parts = -(-64 * words_needed(keys.count(), FIRST) // max_bits)
    best = "struct<length: int, n_host: int, rule: string, verdict: string>"
    judged, passes = split.withColumn("best", F.lit(None).cast(best)), 0
    for part in range(n_parts):
        in_part = (lambda key: F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(n_parts)) == part) if n_parts > 1 else (lambda key: F.lit(True))  # noqa: B023
        own = durable(keys.filter(in_part(F.col("key"))), "listed") if n_parts > 1 else keys
        blocking = build(own.filter("blocks").select("key"), own.select("key"))
        for at in range(0, len(shapes), most_shapes):
            if passes:  # one pass at a time
                judged = durable(judged, "judged")
            passes += 1
            here = shapes[at : at + most_shapes]
            of_shape = F.struct("labels", "n_path").isin([F.struct(F.lit(a), F.lit(b)) for a, b in here])
            shaped = (own.filter(of_shape) if len(here) < len(shapes) else own).select("key")
            found = [F.when(in_part(c["rule"]), c) for c in candidates(here)]
            universe = split.select("host", "path").select(F.explode(F.array_compact(F.array(*[c["rule"] for c in found]))).alias("key"))
            cascade = build(shaped, universe)
            places = [f"at_{i}" for i in range(len(found))]
            listed = judged.withColumns(dict(zip(places, found, strict=True)))
            listed = listed.withColumn("found", longest([F.when(cascade.lists(F.col(c)["rule"]), F.col(c)) for c in places]))
            verdict = F.when(blocking.lists(F.col("found.rule")), BLOCK).otherwise(ALLOW)
            full = F.when(F.col("found").isNotNull(), F.struct("found.length", "found.n_host", "found.rule", verdict.alias("verdict")))
            judged = listed.withColumn("best", F.greatest("best", full)).drop("found", *places)
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(ALLOW)).alias("verdict")
    )

