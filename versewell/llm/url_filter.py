"""URL filters: a Bloom filter cascade that is exact over the corpus's own keys, without joins.

Level 0 encodes the listed keys. Level 1 encodes those unlisted keys of the corpus that pass level 0,
level 2 the listed ones that pass levels 0 and 1, and so on until nobody is left. A key of the corpus is
listed if the first level that it fails has an odd number, or if it passes all levels and the last one is
even. As the levels are built from the complete set of distinct keys, the answer is exact for each of them.

The bits of a level are made by Spark's bitmap aggregates and reach the plan as a binary literal. No
filter is larger than ``max_bits``: where the listed keys need more, the key space is cut into shards by
hash, each with its own cascade. All shards are looked up in one pass over the table, as branches of one
expression; each level is built from the keys that survived the levels before, which are written down once.

Defined results: null keys count as the empty key; repeated rows keep their rows; null and repeated listed
keys, and listed keys that the corpus lacks, are ignored; keys of any length are hashed whole; the output
takes the place of a column of its name; an empty table gives an empty result; no listed key lists nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from versewell.llm.common import LOWER, UPPER, Scratch, ascii_lower, others, table

BITS_PER_KEY, PROBES, MAX_BITS = 12, 4, 1 << 25
FALSE_SHARE = (1 - math.exp(-PROBES / BITS_PER_KEY)) ** PROBES  # of unlisted keys, those that pass level 0
#: (host, path, verdict); a rule fits its host and all subdomains
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: labels of a host name that put the host on the query's list
LISTED_LABELS = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for rule_host, rule_path, says in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        name = F.when(fits, F.lit(rule_host + rule_path)).otherwise(name)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return name, verdict


def _positions(key: Column, level: int, bits: int) -> Column:
    return F.array(*[F.pmod(F.xxhash64(key, F.lit(level * 64 + i)), F.lit(bits)) for i in range(PROBES)])


def _passes(key: Column, level: int, bits: int, cells: bytes) -> Column:
    def is_set(at: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(cells), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1

    return F.forall(_positions(key, level, bits), is_set)


class Cascade:
    """Levels of one shard of the keys; ``listed(key)`` is exact for every key that it was built over."""

    def __init__(self, listed: DataFrame, unlisted: DataFrame, count: int, scratch: Scratch):
        """Tables of distinct ``key``; count: of the listed ones."""
        self.levels: list[tuple[int, bytes]] = []
        side, other = listed, unlisted
        while count:
            level, bits = len(self.levels), max(1024, -(-count * BITS_PER_KEY // 64) * 64)
            cells_of = F.transform(_positions(F.col("key"), level, bits), lambda at: at + 1)
            maps = (
                side.select(F.explode(cells_of).alias("cell"))
                .groupBy(F.bitmap_bucket_number("cell").alias("bucket"))
                .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("cells"))
                .collect()  # at most bits / 32768 rows of 4 KB
            )
            cells = bytearray(-(-bits // 32768) * 4096)
            for row in maps:
                cells[(row.bucket - 1) * 4096 : row.bucket * 4096] = row.cells
            self.levels.append((bits, bytes(cells[: -(-bits // 8)])))
            # of the keys that must not pass, those that do are the next level's
            side, other = scratch.write(other.where(_passes(F.col("key"), level, *self.levels[-1]))), side
            count = side.count()

    def listed(self, key: Column) -> Column:
        answer = F.lit(len(self.levels) % 2 == 1)
        for level, (bits, cells) in reversed(list(enumerate(self.levels))):
            answer = F.when(_passes(key, level, bits, cells), answer).otherwise(F.lit(level % 2 == 1))
        return answer


def mark_listed(df: DataFrame, key: str, listed: DataFrame, out: str, max_bits: int = MAX_BITS) -> DataFrame:
    """Add boolean ``out``: whether the row's key is one of column ``key`` of ``listed``."""
    scratch = Scratch(df.sparkSession)
    whole = F.coalesce(F.col(f"`{key}`"), F.lit(""))
    shard = lambda k, n: F.pmod(F.xxhash64(k, F.lit(-1)), F.lit(n)).cast("int")
    both = df.select(whole.alias("key"), F.lit(False).alias("listed")).unionByName(listed.select(F.col("key"), F.lit(True).alias("listed")).where("key IS NOT NULL"))
    both = both.groupBy("key").agg(F.bool_or("listed").alias("listed"), F.bool_or(~F.col("listed")).alias("here"))
    keys = scratch.write(both.where("here").drop("here"))
    n, rest = keys.agg(F.count_if("listed"), F.count_if(~F.col("listed"))).first()
    shards = max(1, math.ceil(max(n, 2 * FALSE_SHARE * rest) * BITS_PER_KEY / max_bits))
    if shards > 1:
        keys = scratch.write(keys.withColumn("shard", shard(F.col("key"), shards)), "shard")
    sizes = dict(keys.where("listed").groupBy("shard").count().collect()) if shards > 1 else {0: n}  # a row for each shard
    answer = F.lit(False)
    for s in range(shards):
        mine = keys.where(F.col("shard") == s) if shards > 1 else keys
        cascade = Cascade(mine.where("listed").select("key"), mine.where("NOT listed").select("key"), sizes.get(s, 0), scratch)
        answer = F.when(shard(whole, shards) == s, cascade.listed(whole)).otherwise(answer) if shards > 1 else cascade.listed(whole)
    marked = df.select(*others(df, out), answer.alias(out))
    scratch.drop(*[t for t, _ in scratch.written])
    return marked


def listed_hosts(hosts: DataFrame) -> DataFrame:
    """The list of the query: the distinct hosts of ``pages`` that carry a listed label, with column ``key``."""
    carries = F.col("host").rlike(rf"(^|\.)({'|'.join(LISTED_LABELS)})(\.|$)")
    return hosts.where(carries).select(F.col("host").alias("key")).distinct()


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge every url of ``pages``: by the longest rule, else by exact membership of its host in the list."""
    host, path = host_and_path(F.col("url"))
    pages = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    marked = mark_listed(pages, "host", listed_hosts(pages), "listed")
    rule, verdict = rule_of(F.col("host"), F.col("path"))
    by_list = F.when(F.col("listed"), "block").otherwise("allow")
    return marked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"), "listed")


_FITS = {h + p: (f"((host = '{h}' OR host LIKE '%.{h}') AND path LIKE '{p}%')", v) for h, p, v in RULES}
_BY_LENGTH = sorted(_FITS, key=len, reverse=True)
ORACLE_SQL = rf"""
WITH u AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u
), l AS (
  SELECT DISTINCT host FROM h WHERE regexp_matches(host, '(^|\.)({'|'.join(LISTED_LABELS)})(\.|$)')
), r AS (
  SELECT *, CASE {' '.join(f"WHEN {_FITS[n][0]} THEN '{n}'" for n in _BY_LENGTH)} END AS rule,
         host IN (SELECT host FROM l) AS listed FROM h
)
SELECT page_id, host, path, rule,
       CASE {' '.join(f"WHEN rule = '{n}' THEN '{_FITS[n][1]}'" for n in _BY_LENGTH)}
            WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM r
"""
