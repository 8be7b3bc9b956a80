"""URL filter: a blocked Bloom filter in front of an exact hash join with the listed URLs.

Listed URLs are canonical (host, path) rules. A rule fits its host and all subdomains where the url's
path starts with the rule's path, so a url's possible rules are its host suffixes, each with its path
cut to one of the lengths that rule paths have. Each possible rule is hashed once; one part of the
hash picks a 64-bit block, three others pick bits in it. The filter is a table of at most `blocks`
rows, which bounds what is broadcast whatever the list's length; a longer list only lets more false
positives through to the join. (host, path) pairs with a passing candidate are made distinct, joined
to the list by equality, and the longest rule is taken; its verdict goes back to the pages. Pairs
that hold more than a thousandth of all pages, of which there can't be a thousand, go back by a
broadcast, with a rule or without, so no common url lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import save

#: Up to so many distinct lengths of rule paths are tried one by one; of more, all from the least to the greatest.
MAX_LENGTHS = 256
#: A (host, path) is common if it has more than one in so many pages.
COMMON = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without `://`."""
    rest = F.when(url.contains("://"), F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(host, upper, lower), path


def _bits(h: Column) -> Column:
    """Three bits of a 64-bit block, from three parts of a hash."""
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, k).bitwiseAND(F.lit(63)).cast("int")) for k in (0, 6, 12)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def _block(h: Column, blocks: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 20), F.lit(blocks))


def _starts(lengths: list[int]) -> Column:
    """The path cut to each of the lengths of rule paths (or to more) that it has."""
    if len(lengths) <= MAX_LENGTHS:
        tried = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    else:
        most = F.least(F.length("path"), F.lit(lengths[-1]))
        tried = F.when(most >= lengths[0], F.sequence(F.lit(lengths[0]), most)).otherwise(F.array().cast("array<int>"))
    return F.transform(tried, lambda n: F.substring("path", F.lit(1), n))


def candidates(pairs: DataFrame, rules: DataFrame, lengths: list[int], blocks: int) -> DataFrame:
    """host, path, n, c_host, c_path: possible rules (rules: r_host, r_path) of (host, path) pairs that pass the filter."""
    hashed = rules.select(F.xxhash64("r_host", "r_path").alias("h"))
    bloom = hashed.groupBy(_block(F.col("h"), blocks).alias("block")).agg(F.bit_or(_bits(F.col("h"))).alias("mask"))
    suffixes = F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), i, size(split(host, '[.]'))), '.'))")
    tried = pairs.select("host", "path", "n", F.explode(suffixes).alias("c_host"), _starts(lengths).alias("starts"))
    tried = tried.select("host", "path", "n", "c_host", F.explode("starts").alias("c_path"))
    tried = tried.withColumn("h", F.xxhash64("c_host", "c_path")).withColumn("block", _block(F.col("h"), blocks))
    passed = tried.join(F.broadcast(bloom), "block").where(F.col("mask").bitwiseAND(_bits(F.col("h"))) == _bits(F.col("h")))
    return passed.select("host", "path", "n", "c_host", "c_path")


def common_verdicts(pairs: DataFrame, judged: DataFrame, rows: int) -> DataFrame:
    """j_host, j_path, rule, v of the (host, path) pairs that have more than one in COMMON of so many rows, so fewer than COMMON; null without a rule."""
    common = pairs.where(COMMON * F.col("n") > rows).select(F.col("host").alias("j_host"), F.col("path").alias("j_path"))
    ruled = judged.join(F.broadcast(common), ["j_host", "j_path"])  # judged grows with the pages and is neither sent nor shuffled
    return common.join(F.broadcast(ruled), ["j_host", "j_path"], "left")


def url_verdicts(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", default: str = "allow", blocks: int = 1 << 16) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of pages.

    rules: host, path, verdict. The longest fitting rule wins; of rules of one length the first by
    its text; without one the verdict is `default` (nothing is known against the url) and rule is
    null. A null url, or one without `://`, has empty host and path. Repeated pages give a row each;
    an empty list or table is no special case; other columns are not read.
    """
    host, path = host_and_path(F.coalesce(F.col(url_col), F.lit("")))
    pages = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rules = rules.select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict")).na.fill("", ["r_host", "r_path"])
    lengths = sorted(r[0] for r in rules.select(F.length("r_path")).distinct().collect())  # as many as the longest path is long
    if not lengths:
        return pages.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    pairs = save(pages.where(F.col("host") != "").groupBy("host", "path").agg(F.count("*").alias("n")))
    fits = (F.col("c_host") == F.col("r_host")) & (F.col("c_path") == F.col("r_path"))
    exact = candidates(pairs, rules, lengths, blocks).join(rules, fits)
    rule = F.concat("r_host", "r_path")
    judged = exact.groupBy("host", "path").agg(F.min(F.struct((-F.length(rule)).alias("n"), rule.alias("rule"), F.col("r_verdict").alias("v"))).alias("best"))
    judged = save(judged.select(F.col("host").alias("j_host"), F.col("path").alias("j_path"), F.col("best.rule").alias("rule"), F.col("best.v").alias("v")))

    common = common_verdicts(pairs, judged, pages.count())
    same = (F.col("host") == F.col("j_host")) & (F.col("path") == F.col("j_path"))
    tried = pages.join(F.broadcast(common), same, "left")
    known = (F.col("host") == "") | F.col("j_host").isNotNull()
    rest = tried.where(~known).select("page_id", "host", "path").join(judged.hint("merge"), same, "left")
    found = tried.where(known).unionByName(rest)
    return found.select("page_id", "host", "path", "rule", F.coalesce("v", F.lit(default)).alias("verdict"))
