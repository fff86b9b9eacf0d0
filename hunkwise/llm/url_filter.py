"""URL filters (9): a blocked Bloom filter passes possible hits to an exact hash join.

The filter is a table of blocks of four 64-bit words. A key sets two bits in each word of the one block that its hash picks, so a
probe touches one row. The block table is joined by block number; what passes is joined with the listed URLs themselves.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hunkwise.llm import common

# The rules of the query (action, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
# The query's block list, as canonical URLs; one with an empty path lists its host and all subdomains.
LISTED = [f"{name}.example.{zone}/" for name in ("ads-track", "casino-win", "spam-farm", "adult-x", "cheap-pills", "free-bets") for zone in ("com", "net", "org")]

BITS_PER_KEY = 16
#: Filters of so many blocks (40 bytes each) and lists of so many URLs are sent to all executors; larger ones are joined by shuffle.
BROADCAST_BLOCKS, BROADCAST_URLS = 500_000, 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    return F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if url is null or has no ://."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without www. or a default port, then the path with a / at least and none at its end, then the query without utm_ parameters."""
    host = F.regexp_replace(F.regexp_replace(host_of(url), r"^www\.", ""), r":(80|443)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.startswith("utm_")), "&")
    path = F.concat(F.lit("/"), F.btrim(path_of(url), F.lit("/")))
    return F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))


def probe_keys(url: Column) -> Column:
    """The canonical URL, and the roots of its host and of each parent domain."""
    labels = F.split(F.split_part(canonical(url), F.lit("/"), F.lit(1)), r"\.")
    roots = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, i, F.size(labels)), "."), F.lit("/")))
    return F.array_distinct(F.concat(F.array(canonical(url)), roots))


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks).cast("bigint")).alias("block")


def _words(key: Column) -> list[Column]:
    h = F.xxhash64(F.lit("bits"), key)
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    return [bit(2 * j).bitwiseOR(bit(2 * j + 1)).alias(f"word{j}") for j in range(4)]


class BlockedBloom:
    """The filter of a table of keys. No key of the table is ever missed; about one other key in 2,000 passes."""

    def __init__(self, keys: DataFrame, n_keys: int):
        self.blocks = max(1, math.ceil(n_keys * BITS_PER_KEY / 256))
        key = F.col("key")
        self.table = keys.select(_block(key, self.blocks), *_words(key)).groupBy("block").agg(*[F.bit_or(f"word{j}").alias(f"word{j}") for j in range(4)])
        if self.blocks <= BROADCAST_BLOCKS:
            self.table = F.broadcast(self.table)

    def possible(self, df: DataFrame, key: str = "key") -> DataFrame:
        """The rows of df whose key may be in the table."""
        probes = [w.alias(f"probe{j}") for j, w in enumerate(_words(F.col(key)))]
        hit = F.lit(True)
        for j in range(4):
            hit = hit & (F.col(f"word{j}").bitwiseAND(F.col(f"probe{j}")) == F.col(f"probe{j}"))
        return df.select(*df.columns, _block(F.col(key), self.blocks), *probes).join(self.table, "block").filter(hit).select(*df.columns)


def rule_of(host: Column, path: Column, rules=None) -> tuple[Column, Column]:
    """The longest rule that fits (host or subdomain, path prefix) and its action; nulls if none does."""
    name = action = None
    for act, h, p in sorted(RULES if rules is None else rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(F.lit(None).cast("string") if name is None else name)
        action = F.when(fits, act).otherwise(F.lit(None).cast("string") if action is None else action)
    none = F.lit(None).cast("string")
    return (none, none) if name is None else (name, action)


def filter_urls(pages: DataFrame, listed: DataFrame, rules=None, url: str = "url") -> DataFrame:
    """pages with host, path, rule, listed and verdict: the longest rule's action, else block if the URL is listed, else allow.

    listed has a column url of canonical URLs; one that ends its host with / lists that host and its subdomains. A null url,
    or one without ://, has an empty host and path, no rule and is never listed. Columns named host, path, rule, listed or
    verdict are replaced; repeated rows are judged apart; an empty table or list gives its own plain result.
    """
    keys = listed.select(F.col("url").alias("key")).filter("key is not null").distinct()
    n = keys.count()
    bloom = BlockedBloom(keys, n)
    urls = common.drop_clashes(pages, ["host", "path", "rule", "listed", "verdict"])
    probes = urls.select(F.col(url).alias("__url")).filter(host_of(F.col("__url")) != "").distinct().select("__url", F.explode(probe_keys(F.col("__url"))).alias("key"))
    hits = bloom.possible(probes).join(F.broadcast(keys) if n <= BROADCAST_URLS else keys, "key", "left_semi").select("__url").distinct().withColumn("__hit", F.lit(True))
    out = urls.join(hits, urls[url] == hits["__url"], "left").withColumn("listed", F.coalesce("__hit", F.lit(False))).drop("__url", "__hit")
    out = out.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    return out.withColumns({"rule": rule, "verdict": F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))})


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = spark.createDataFrame([(u,) for u in LISTED], "url string")
    out = filter_urls(common.table(spark, sf_dir, "pages").select("page_id", "url"), listed)
    return out.select("page_id", "host", "path", "rule", "verdict", "listed")


_RULE_SQL = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
_ACTION_SQL = " ".join(f"WHEN '{h}{p}' THEN '{a}'" for a, h, p in RULES)
_LISTED_SQL = " OR ".join(f"bare = '{u[:-1]}' OR ends_with(bare, '.{u[:-1]}')" for u in LISTED)
ORACLE_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
b AS (SELECT *, regexp_replace(regexp_replace(host, '^www\\.', ''), ':(80|443)$', '') AS bare, CASE {_RULE_SQL} END AS rule FROM p),
l AS (SELECT *, ({_LISTED_SQL}) AS listed FROM b)
SELECT page_id, host, path, rule, coalesce(CASE rule {_ACTION_SQL} END, CASE WHEN listed THEN 'block' ELSE 'allow' END) AS verdict, listed FROM l
"""
