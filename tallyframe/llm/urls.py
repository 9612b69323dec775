"""URL filters: rules by host and path, then a list behind a blocked Bloom filter.

The list is turned into a filter of bounded size that is broadcast. Pages whose
canonical URL isn't in the filter aren't on the list; the few others go through
an exact hash join, which removes the filter's false positives.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.roles import quoted
from .common import others, stored

#: A block has four words of 64 bits, of which an entry sets two each.
WORDS, BITS_PER_ENTRY = 4, 16
#: Blocks at most: 2 ** 17 rows of 40 bytes are broadcast. A longer list makes
#: the filter let more pages through to the exact join; the results stay the same.
MOST_BLOCKS = 1 << 17
#: Query parameters that say where a visitor came from.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without ``www.``, path without a last slash, and the sorted parameters that aren't for tracking.

    Null where there is no host, that is for a missing URL or one without ``://``.
    """
    asked = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(asked, "&"), lambda x: (x != "") & ~x.rlike(TRACKING)))
    where = F.concat(F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(path(url), "/$", ""))
    return F.when(host(url) != "", F.concat(where, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def rule_for(hosts: Column, paths: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """The longest (host, path, verdict) that fits, as a struct of its text and verdict; null if none does."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for at, below, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((hosts == at) | hosts.endswith("." + at)) & paths.startswith(below)
        found = F.when(fits, F.struct(F.lit(at + below).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _masks(key: Column) -> list[Column]:
    """The bits of an entry in each word of its block."""
    bits = F.xxhash64(key, F.lit("bits"))
    # expr, as the number of bits to shift by is a column
    return [
        F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 12 * i).bitwiseAND(63).cast("int")).bitwiseOR(
            F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(bits, 12 * i + 6).bitwiseAND(63).cast("int"))
        )
        for i in range(WORDS)
    ]


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """The blocked filter of the entries: one row (block, words) for each block that has any."""
    block = F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block")
    bits = listed.select(block, *[m.alias(f"_m{i}") for i, m in enumerate(_masks(F.col(key)))])
    return bits.groupBy("_block").agg(*[F.bit_or(f"_m{i}").alias(f"_w{i}") for i in range(WORDS)])


def blocks_for(entries: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-entries * BITS_PER_ENTRY // (64 * WORDS))))


def judge(
    pages: DataFrame,
    listed: DataFrame,
    rules: Sequence[tuple[str, str, str]] = (),
    url_col: str = "url",
    listed_col: str = "url",
) -> DataFrame:
    """``pages`` with host, path, rule and verdict (``allow`` or ``block``).

    The longest fitting rule decides. Without one, a page is blocked if its
    canonical URL is that of a listed URL. A missing URL or one without
    ``://`` has an empty host and path, fits no rule and is on no list: allowed.
    ``pages`` is read once; leave out wide columns that aren't needed. Columns of
    ``pages`` with the names that are added give way.
    """
    url = quoted(url_col)
    entries = listed.select(canonical(quoted(listed_col)).alias("_key")).filter(F.col("_key").isNotNull())
    entries = stored(entries.distinct(), "url-list")
    blocks = blocks_for(entries.count())
    parts = pages.select(*others(pages, "host", "path", "rule", "verdict", "_key"), host(url).alias("host"), path(url).alias("path"), canonical(url).alias("_key"))
    rule = rule_for(F.col("host"), F.col("path"), rules)
    parts = parts.withColumn("_rule", rule).withColumn("_block", F.pmod(F.xxhash64("_key"), F.lit(blocks)))
    probed = parts.join(F.broadcast(bloom(entries, "_key", blocks)), "_block", "left")
    hit = F.lit(True)
    for i, mask in enumerate(_masks(F.col("_key"))):
        hit = hit & (F.col(f"_w{i}").bitwiseAND(mask) == mask)
    possible = F.coalesce(F.col("_key").isNotNull() & F.col("_rule").isNull() & hit, F.lit(False))
    probed = probed.withColumn("_possible", possible).withColumn("rule", F.col("_rule.rule")).withColumn("verdict", F.coalesce("_rule.verdict", F.lit("allow")))
    probed = stored(probed.drop("_rule", "_block", *[f"_w{i}" for i in range(WORDS)]), "url-probed")
    # Both sides come straight from a table, so adaptive execution splits a URL that very many pages have.
    exact = probed.filter("_possible").join(entries.withColumn("_listed", F.lit(True)), "_key", "left")
    exact = exact.withColumn("verdict", F.when(F.col("_listed"), F.lit("block")).otherwise(F.col("verdict"))).drop("_listed")
    return probed.filter(~F.col("_possible")).unionByName(exact).drop("_key", "_possible")
