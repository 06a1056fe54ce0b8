"""URL filters: rules by host and path, and a list behind a blocked Bloom filter.

Rules fit a host and all its subdomains, and paths that start with theirs; of
several the longest wins. A URL without a rule is looked up in a list of
canonical URLs, each of which stands for itself and all below it: as in other
block lists, the URL is expanded into all its host suffixes and, for listed hosts,
path prefixes. The expansions meet a Bloom filter first, whose bits for one key all lie in one
64-bit block, so that one look-up decides. Blocks are rows, some for each six entries
and 2^18 at most, which is why they can be broadcast; what passes goes through an exact
join of hashes and canonical URLs, which removes false positives.

For the look-up, and in the list, a host loses its user, port and outer dots, percent
signs are decoded once, and a path has single slashes and no dot segments. Rules, and the
columns ``host`` and ``path``, take the URL as it is written.

Only DataFrame functions are used.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and is allowed; repeated rows are judged one by one; an empty list blocks
nothing; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialise, table
from .bloom import blocks_for, bloom_filter, possible

#: (verdict, host, path)
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: Canonical URLs that are blocked with all below them.
LISTED = [
    "spam-farm.example.org/",
    "cheap-pills.example.com/",
    "casino-win.example.org/",
    "ads-track.example.org/",
    "free-bets.example.com/",
    "spam-farm.example.org/offers/",
    "tionble.example.org/es/",
    "example.com/en/sponsored/",
    "blog.tionsh.example.com/es/",
    "a.b.c.link-swap.example.org/out/",
]


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """The longest fitting rule as a struct of rule and verdict, or null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1]) - len(r[2]), r)):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        found = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    if out is None:
        return F.lit(None).cast("struct<rule:string,verdict:string>")
    return out


def _decoded(text: Column) -> Column:
    """Percent signs decoded; those before no two hexadecimal digits stay."""
    escaped = F.regexp_replace(F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.coalesce(F.try_url_decode(escaped), text)


def canonical_host(host: Column) -> Column:
    """Without user, port and outer dots, percent signs decoded, A-Z in lower case."""
    plain = _decoded(F.regexp_replace(F.regexp_replace(host, r"(?s)^.*@", ""), r":[0-9]*$", ""))
    return F.btrim(F.translate(plain, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("."))


def canonical_path(path: Column) -> Column:
    """Percent signs decoded, single slashes, ``.`` and ``..`` resolved; a path that names a folder ends in a slash."""
    whole = F.regexp_replace(F.concat(F.lit("/"), _decoded(path)), "/+", "/")
    kept = F.aggregate(
        F.split(whole, "/"), F.array().cast("array<string>"),
        lambda done, x: F.when(x.isin("", "."), done).when(x == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, x))
    )
    folder = whole.rlike(r"(^|/)\.{0,2}$") & (F.size(kept) > 0)
    resolved = F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(folder, F.lit("/")).otherwise(F.lit("")))
    return F.when(whole.rlike(r"/\.{1,2}(/|$)"), resolved).otherwise(whole)


def canonical(host: Column, path: Column) -> Column:
    return F.concat(canonical_host(host), canonical_path(path))


def host_suffixes(host: Column) -> Column:
    """A host and all hosts above it."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(labels, n - k + 1, k), ".")))


def path_prefixes(path: Column, segments: Column) -> Column:
    """The canonical path and all paths above it of at most so many segments, which end in a slash."""
    parts = F.split(path, "/")
    above = F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts) - 1, segments)),
        lambda k: F.concat(F.array_join(F.slice(parts, F.lit(1), k), "/"), F.lit("/"))
    )
    return F.array_union(above, F.array(path))


def _maybe(keys: DataFrame, listed: DataFrame, blocks: int) -> DataFrame:
    """The rows of ``keys`` whose ``hash`` passes the filter of the list's."""
    return possible(keys, bloom_filter(listed, blocks), blocks).where("possible").drop("possible")


def listing(spark: SparkSession, listed: DataFrame | list[str]) -> DataFrame:
    """``(canonical, hash)`` of a list of URLs, with or without a scheme."""
    if not isinstance(listed, DataFrame):
        listed = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in listed]).cast("array<string>")).alias("url"))
    url = F.col(listed.columns[0])
    url = F.when(url.contains("://"), url).otherwise(F.concat(F.lit("x://"), url))
    rows = listed.select(
        canonical(host_of(url), path_of(url)).alias("canonical")
    ).where("canonical is not null and not startswith(canonical, '/')").distinct()
    return rows.withColumn("hash", F.xxhash64("canonical"))


def judge_urls(
    pages: DataFrame, listed: DataFrame | list[str] = LISTED, id_col: str = "page_id", url_col: str = "url",
    rules: list[tuple[str, str, str]] = RULES, blocks: int | None = None
) -> DataFrame:
    """``(id, host, path, rule, verdict, listed)`` for each row; ``listed`` is the entry that blocks it.

    The filter has ``blocks`` blocks, or as many as the list's size asks for.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({"site": canonical_host(F.col("host")), "file": canonical_path(F.col("path"))})
    entries = listing(spark, listed)
    blocks = blocks or blocks_for(entries.count())
    # Distinct URLs are looked up once, however many rows repeat them.
    urls = rows.where("found is null and site <> ''").select("site", "file").distinct()
    # First the hosts, then the paths below those that are listed, no deeper than a host's deepest entry.
    hosts = entries.groupBy(F.substring_index("canonical", "/", 1).alias("suffix")).agg(
        F.max(F.size(F.split("canonical", "/"))).alias("segments")
    ).withColumn("hash", F.xxhash64("suffix"))
    sites = _maybe(
        urls.select("site", "file", F.explode(host_suffixes(F.col("site"))).alias("suffix")).withColumn("hash", F.xxhash64("suffix")),
        hosts, blocks
    )
    sites = sites.drop("hash").join(hosts.drop("hash"), "suffix")
    keys = sites.select(
        "site", "file",
        F.explode(F.transform(path_prefixes(F.col("file"), F.col("segments")), lambda p: F.concat("suffix", p))).alias("canonical")
    ).withColumn("hash", F.xxhash64("canonical"))
    maybe = _maybe(keys, entries, blocks)
    hits = maybe.join(entries.withColumnRenamed("canonical", "entry"), "hash").where(F.col("canonical") == F.col("entry"))
    hits = hits.groupBy("site", "file").agg(F.min("entry").alias("listed"))
    hits = materialise(hits, "listed-urls").withColumnsRenamed({"site": "_site", "file": "_file"})
    out = rows.join(hits, F.col("found").isNull() & (F.col("site") == F.col("_site")) & (F.col("file") == F.col("_file")), "left")
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("listed").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "listed")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


_LISTED_SQL = ", ".join(f"'{x}'" for x in LISTED)
OP10_SQL = rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
h AS (SELECT page_id, translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path FROM u),
r AS (SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
    WHEN EXISTS (
        SELECT 1 FROM (SELECT split_part(e, '/', 1) AS h, substr(e, strpos(e, '/')) AS p FROM (SELECT unnest([{_LISTED_SQL}]) AS e))
        WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(regexp_replace('/' || path, '/+', '/', 'g'), p)) THEN 'block'
    ELSE 'allow' END AS verdict
FROM r
"""
