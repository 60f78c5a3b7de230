"""URL filter with a blocked Bloom filter before an exact join (operator 4), in DataFrame functions only.

The list has canonical entries host + path with a verdict. An url's canonical candidates are its host's
suffixes at label boundaries, each with the prefixes of its path that are as long as some listed path. A blocked Bloom filter of the
list (one 64-bit block per candidate; their number follows the list's length up to MOST_BLOCKS, so that what each task receives is
bounded) passes possible hits; pages without one are done, and for the others an exact join with the list removes the false positives; the longest entry
wins.

Defined results: a null url or one without `://` has an empty host and path and takes the default verdict; a host keeps its port and user
part; an empty list gives the default verdict everywhere; rows are kept one for one, repeated ones too. If an entry is
listed twice, blocking wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST_BLOCKS, MOST_BLOCKS = 1 << 8, 1 << 18
BITS = 6
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased. Path: then up to `?`, `#` or the end."""
    known = F.instr(url, "://") > 0
    rest = F.substring_index(url, "://", 1)
    after = F.when(known, url.substr(F.length(rest) + F.lit(4), F.length(url)))
    host = F.coalesce(F.translate(F.regexp_extract(after, r"^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))
    path = F.coalesce(F.regexp_extract(after, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return host, path


def blocks_for(n: int) -> int:
    """Some ten entries a block."""
    return min(MOST_BLOCKS, max(LEAST_BLOCKS, 1 << (n // 8).bit_length()))


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(h, F.lit(blocks)).cast("int")


def _mask(h: Column) -> Column:
    """The bits of a key inside its 64-bit block."""
    mask = F.lit(0).cast("long")
    for k in range(BITS):
        bit = F.pmod(F.shiftrightunsigned(h, 18 + 7 * k), F.lit(64)).cast("int")
        mask = mask.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return mask


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row: words array<bigint> of so many blocks, the filter of the column `key`."""
    h = F.xxhash64("key")
    held = keys.select(_block(h, blocks).alias("block"), _mask(h).alias("mask")).groupBy("block").agg(F.bit_or("mask").alias("mask"))
    pairs = held.agg(F.map_from_entries(F.collect_list(F.struct("block", "mask"))).alias("held"))  # at most `blocks` entries
    return pairs.select(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.coalesce(F.col("held")[b], F.lit(0).cast("long"))).alias("words"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict. rules: host, path, verdict (`block` or `allow`)."""
    rules = rules.select(F.translate("host", _UPPER, _LOWER).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
    listed = rules.where("rule_host is not null").groupBy(F.concat("rule_host", "rule_path").alias("key"), "rule_host").agg(F.max("verdict").alias("listed"), F.first("rule_path").alias("rule_path"))
    lengths = listed.agg(F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"))
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fits = F.filter("lengths", lambda n: n <= F.length("path"))
    candidates = F.flatten(F.transform(suffixes, lambda s: F.transform(fits, lambda n: F.struct(s.alias("rule_host"), F.concat(s, F.col("path").substr(F.lit(1), n)).alias("key")))))
    h = lambda c: F.xxhash64(c["key"])
    blocks = blocks_for(listed.count())
    passed = F.filter(candidates, lambda c: F.element_at("words", _block(h(c), blocks) + F.lit(1)).bitwiseAND(_mask(h(c))) == _mask(h(c)))
    tried = urls.withColumns({"lengths": lengths.scalar(), "words": bloom(listed.select("key"), blocks).scalar()}).select("row", "page_id", "host", "path", passed.alias("passed"))
    clean = tried.where(F.size("passed") == 0).select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = tried.where(F.size("passed") > 0).select("row", "page_id", "host", "path", F.explode("passed").alias("c")).select("row", "page_id", "host", "path", "c.rule_host", "c.key")
    exact = hits.join(listed.withColumnRenamed("listed", "hit"), ["rule_host", "key"], "left")
    best = exact.groupBy("row", "page_id", "host", "path").agg(F.max(F.when(F.col("hit").isNotNull(), F.struct(F.length("key").alias("n"), "key", "hit"))).alias("best"))
    return clean.unionByName(best.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.hit", F.lit(default)).alias("verdict")))


RULE_TYPE = T.StructType([T.StructField(n, T.StringType()) for n in ("host", "path", "verdict")])


def rules_frame(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """The rules as a DataFrame."""
    return pages.sparkSession.createDataFrame(list(rules), RULE_TYPE)
