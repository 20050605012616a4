"""URL filters: prefix rules first, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of 512-bit blocks. A canonical URL's hash chooses one block and one bit in each of the block's eight
words, so a lookup touches a single row. Only URLs that pass it go on to a hash join with the list itself, which removes the false
positives. Filter and list are broadcast while each is within `most_broadcast` bytes; then the pages are scanned once. Beyond that
the filter is joined by block, and the URLs that pass it, which are few, are shuffled to the list while the others stay where they are,
at the price of a second scan of the URLs.

Nulls and edge cases: a null URL, or one without "://", has an empty host and path, fits no rule, is never listed and is allowed;
nulls in the list are ignored; repeated pages each give a row; repeated list entries count once; an empty list allows all that no
rule blocks; an empty page table gives no rows. Columns other than the id and URL are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 8
BITS_PER_URL = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = "(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), PARTS, 2)


def canonical_of(host: Column, path: Column) -> Column:
    """Host without a leading www. or m., path without an index page, .html or closing slashes; query and fragment are dropped."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(/index)?(\.html)?/*$", ""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The longest of the rules (verdict, host, path) that fits, as a struct of rule and verdict, else null."""
    fits = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        met = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits = F.when(met, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(fits)
    return fits


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: str, word: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.lit(1), url), 6 * word).bitwiseAND(F.lit(63)).cast("int")


def bloom_filter(urls: DataFrame, column: str, blocks: int) -> DataFrame:
    """(block, w0 ... w7): a row for each block that has any bit set."""
    bits = [F.expr(f"shiftleft(1L, b{k})") for k in range(WORDS)]
    keyed = urls.select(_block(column, blocks).alias("block"), *(_bit(column, k).alias(f"b{k}") for k in range(WORDS)))
    return keyed.groupBy("block").agg(*(F.bit_or(b).alias(f"w{k}") for k, b in enumerate(bits)))


def filter_urls(pages: DataFrame, listed: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url", listed_col: str = "url", most_broadcast: int = 8 << 20) -> DataFrame:
    """One row per page: id, host, path, canonical, rule (else null), possible (passes the filter), listed, verdict (allow or block)."""
    named = listed.select(host_of(F.col(listed_col)).alias("host"), path_of(F.col(listed_col)).alias("path")).where("host <> ''").select(canonical_of(F.col("host"), F.col("path")).alias("canonical")).distinct()
    number, letters = named.agg(F.count("*"), F.sum(F.octet_length("canonical"))).first()
    blocks = max(1, -(-number * BITS_PER_URL // (64 * WORDS)))
    bloom = bloom_filter(named, "canonical", blocks)
    if blocks * 8 * (WORDS + 1) <= most_broadcast:
        bloom = F.broadcast(bloom)
    judged = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("canonical", canonical_of(F.col("host"), F.col("path"))).withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    asked = F.col("fit").isNull() & (F.col("host") != "")  # no rule decides
    passed = reduce(lambda a, b: a & b, (F.expr(f"shiftright(w{k}, b{k})").bitwiseAND(F.lit(1)) == 1 for k in range(WORDS)))
    bits = {f"b{k}": _bit("canonical", k) for k in range(WORDS)}
    block = F.when(asked, _block("canonical", blocks)).otherwise(-1 - F.pmod(F.xxhash64("id"), F.lit(blocks)))  # of no block, and dealt evenly
    looked = judged.withColumn("block", block).withColumns(bits).join(bloom, "block", "left").withColumn("possible", F.coalesce(passed, F.lit(False))).select("id", "host", "path", "canonical", "fit", "possible")
    exact = named.select(F.col("canonical").alias("sought"), F.lit(True).alias("found"))
    if (letters or 0) + 32 * number <= most_broadcast:
        found = looked.join(F.broadcast(exact), F.col("possible") & (F.col("canonical") == F.col("sought")), "left").drop("sought")
    else:
        hits = looked.where("possible").join(exact, F.col("canonical") == F.col("sought"), "left").drop("sought")
        found = looked.where("not possible").withColumn("found", F.lit(None).cast("boolean")).unionByName(hits)
    return found.select(F.col("id").alias(id_col), "host", "path", "canonical", F.col("fit.rule").alias("rule"), "possible", F.coalesce("found", F.lit(False)).alias("listed"), F.coalesce("fit.verdict", F.when(F.col("found"), "block").otherwise("allow")).alias("verdict"))
