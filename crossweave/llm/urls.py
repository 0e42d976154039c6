"""URL filters: a blocked Bloom filter before an exact join with the listed URLs, and rules by host and path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crossweave.llm.shared import save

#: Each block is eight words of 64 bits, one bit in each for a URL.
WORDS = 8
#: A block for so many listed URLs, but from FEWEST to MOST blocks (64 KB to 8 MB); a fuller filter only passes more rows on to the exact join.
PER_BLOCK, FEWEST, MOST = 32, 1 << 10, 1 << 17

#: The rules of the filter (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: The list of the registered query has the pages of hosts with these labels, and every hundredth page.
LISTED_PAGES = 100
LISTED_LABELS = ("spam-farm", "cheap-pills", "casino", "xxx-videos", "warez")


def url_host(url: str = "url") -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; empty for null or without ://."""
    rest = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: str = "url") -> Column:
    """From the host's end up to ?, # or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without www., path without index pages and slashes at its end; scheme, query and fragment do not count."""
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"(/index\.html?|\.html?)?/*$", ""))


def _bits(key: str, blocks: int) -> tuple[Column, list[Column]]:
    """The block of a URL and its bit in each of the block's words."""
    second = F.xxhash64(F.col(key), F.lit(2))
    masks = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]
    return F.pmod(F.xxhash64(F.col(key), F.lit(1)), F.lit(blocks)).alias("block"), masks


def blocks_for(listed: int) -> int:
    """Blocks for a list of that many URLs: a power of two within the bounds."""
    return min(MOST, max(FEWEST, 1 << (max(1, listed // PER_BLOCK) - 1).bit_length()))


def bloom_filter(listed: DataFrame, blocks: int, key: str = "canon") -> DataFrame:
    """(block, w0 .. w7): at most `blocks` rows whatever the length of the list, built with map-side combine."""
    block, masks = _bits(key, blocks)
    return listed.select(block, *[m.alias(f"w{i}") for i, m in enumerate(masks)]).groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def rule_of(host: str = "host", path: str = "path", rules=RULES) -> Column:
    """The longest rule that fits, a struct (rule, verdict), else null.

    A rule's length is that of its host and path together; a tie goes to the earlier rule. A rule
    fits its host and the host's subdomains."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(reversed(rules), key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col(host) == h) | F.col(host).endswith("." + h)) & F.col(path).startswith(p)
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict, listed, maybe) for each page.

    `listed` has a column url. The filter's blocks, as many as the list's length asks for within
    fixed bounds, are broadcast; pages whose bits are all set go on to an exact join with the listed canonical URLs, which removes false positives.
    The rest join on a key of their own, so that no task gets them all. The verdict is the longest
    fitting rule's, else block for a listed URL and allow for any other. Null URLs and those
    without :// have empty host and path, no rule, and are allowed. Repeated rows are judged each;
    columns besides page_id and url are not read; an empty list blocks nothing."""
    host, path = url_host(), url_path()
    exact = save(listed.select(F.col("url")).where("url is not null").select(canonical(host, path).alias("canon")).where("canon <> ''").distinct(), "listed")
    blocks = blocks_for(exact.count())
    words = bloom_filter(exact, blocks)
    block, masks = _bits("canon", blocks)
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path")).withColumn("canon", canonical(F.col("host"), F.col("path")))
    rows = rows.withColumn("block", block).join(F.broadcast(words), "block", "left")
    set_all = F.lit(True)
    for i, mask in enumerate(masks):
        set_all = set_all & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    rows = rows.withColumn("maybe", F.coalesce(set_all, F.lit(False)))
    own = F.concat(F.lit("\u0000"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("\u0000"), "canon")
    rows = rows.withColumn("key", F.when(F.col("maybe"), F.col("canon")).otherwise(own))
    joined = rows.join(exact.select(F.col("canon").alias("key"), F.lit(True).alias("listed")), "key", "left")
    joined = joined.withColumn("listed", F.coalesce("listed", F.lit(False))).withColumn("fit", rule_of(rules=rules))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "listed")


def listed_urls(pages: DataFrame, labels=LISTED_LABELS, every: int = LISTED_PAGES, page_id: str = "page_id") -> DataFrame:
    """The list that the registered query uses: the URLs of pages one of whose host's labels is listed, and of those
    whose id is divisible by `every`. Other pages with the same canonical URL are found by the filter and the join alone."""
    found = F.col(page_id) % every == 0
    for label in labels:
        found = found | F.concat(F.lit("."), url_host(), F.lit(".")).contains(f".{label}.")
    return pages.where(found).select("url")


SQL = r"""
WITH cut AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
canon AS (
  SELECT *, regexp_replace(host, '^www\.', '') || regexp_replace(path, '(/index\.html?|\.html?)?/*$', '') AS canon,
    regexp_matches('.' || host || '.', '\.(spam-farm|cheap-pills|casino|xxx-videos|warez)\.') AS bad FROM cut),
listed AS (SELECT DISTINCT canon FROM canon WHERE (bad OR page_id % 100 = 0) AND canon <> ''),
judged AS (
  SELECT c.page_id, c.host, c.path,
    CASE WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/en/1%' THEN 'example.org/en/1'
         WHEN (host = 'example.org' OR host LIKE '%.example.org') AND path LIKE '/es/%' THEN 'example.org/es/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/fr/%' THEN 'com/fr/'
         WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/de/%' THEN 'com/de/'
         WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/%' THEN 'org/' END AS rule,
    l.canon IS NOT NULL AS listed
  FROM canon c LEFT JOIN listed l ON c.canon = l.canon)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
       WHEN listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM judged
"""
