"""URL filters: a blocked Bloom filter passes possible hits to an exact hash join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm import common

#: Words of 64 bits in a block (one cache line), bits that a key sets, and listed keys for a block.
BLOCK_WORDS, KEY_BITS, KEYS_PER_BLOCK = 8, 4, 32
#: Blocks at most, so that the filter never exceeds 8 MiB; with more keys it lets more through, and the join still removes that.
MAX_BLOCKS = 1 << 17

RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: Hosts known for junk, all of whose pages the query's list holds, and single pages of it, whatever their spelling.
JUNK_HOSTS = r"(^|\.)(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)\."
LISTED = ("http://spam-farm.example.org/", "http://cheap-pills.example.com/", "http://www.cheap-pills.example.com/en/474", "http://spam-farm.example.org/en/728?utm_source=feed")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z lower-cased; empty for null or without ``://``."""
    return F.coalesce(common.ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null or without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def domains(host: Column, counts: Sequence[int]) -> Column:
    """Of the host and the domains above it those with one of these ``counts`` of labels; so a host of very many labels isn't written out once for each."""
    labels = F.split(host, r"\.", -1)
    fitting = F.filter(F.lit(list(counts)).cast("array<int>"), lambda n: n <= F.size(labels))
    return F.transform(fitting, lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."))


def _authority(url: Column) -> Column:
    """What stands between ``://`` and the path, without a user's name and password."""
    return F.regexp_replace(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), r"(?s)^.*@", "")


def _unescaped(path: Column) -> Column:
    """``path`` with escapes of unreserved characters decoded, and upper-case digits in all others."""

    def part(p: Column, i: Column) -> Column:
        code = F.upper(F.substring(p, 1, 2))
        letter = F.char(F.conv(code, 16, 10).cast("long"))
        plain = F.when(letter.rlike("^[A-Za-z0-9._~-]$"), letter).otherwise(F.concat(F.lit("%"), code))
        return F.when(i == 0, p).when(p.rlike("^[0-9A-Fa-f]{2}"), F.concat(plain, F.substring(p, F.lit(3), F.length(p)))).otherwise(F.concat(F.lit("%"), p))

    return F.when(F.contains(path, F.lit("%")), F.array_join(F.transform(F.split(path, "%", -1), part), "")).otherwise(path)


def _undotted(path: Column) -> Column:
    """``path`` without the segments ``.`` and ``..``, the latter together with the one before it."""
    parts = F.split(path, "/", -1)
    step = lambda acc, s: F.when(s == ".", acc).when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.lit(1), F.size(acc) - 1))).otherwise(F.concat(acc, F.array(s)))
    kept = F.array_join(F.aggregate(F.slice(parts, F.lit(2), F.size(parts)), F.array(F.lit("")), step), "/")
    closed = F.concat(kept, F.when(F.element_at(parts, -1).isin(".", ".."), "/").otherwise(""))
    return F.when(F.contains(path, F.lit("/.")), closed).otherwise(path)


def canonical(url: Column) -> Column:
    """The one spelling of a page's address; null for null, and where there is no ``://`` or no host.

    Scheme, user, default port (80, 443), fragment and the dots that end a host go; the host is lower-cased; escapes of unreserved characters are decoded
    and others written in capitals; dot segments are resolved; an empty path is ``/``, an empty query none.
    """
    authority = _authority(url)
    host = F.regexp_replace(common.ascii_lower(F.regexp_replace(authority, r":[0-9]*$", "")), r"\.+$", "")
    port = F.regexp_extract(authority, r":([0-9]+)$", 1)
    path = _undotted(_unescaped(path_of(url)))
    query = F.regexp_extract(url, r"(?s)^[^?#]*(\?[^#]+)", 1)
    whole = F.concat(host, F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), F.when(path == "", "/").otherwise(path), query)
    return F.when(F.contains(url, F.lit("://")) & (host != ""), whole)


def _bits(key: Column) -> list[tuple[Column, Column]]:
    """(word in the block, its bit) of each bit that a key sets."""
    h = F.xxhash64(key, F.lit(1))
    return [(F.pmod(F.shiftright(h, 9 * k), F.lit(BLOCK_WORDS)), F.pmod(F.shiftright(h, 9 * k + 3), F.lit(64)).cast("int")) for k in range(KEY_BITS)]


def bloom(keys: DataFrame, key: str = "key", rows: int | None = None) -> tuple[DataFrame, int]:
    """The filter of ``keys`` (``rows`` of them, counted if not told), and its number of blocks: a table with one row, the array ``words`` of its 64-bit words.

    It has ``BLOCK_WORDS`` words a block, and as many blocks as the keys need up to ``MAX_BLOCKS``. Built by a grouped bit_or; what meets in one task is the filter, of
    bounded size, not the keys. Nothing of it is in the plan.
    """
    blocks = min(MAX_BLOCKS, max(1, -(-(keys.count() if rows is None else rows) // KEYS_PER_BLOCK)))
    block = F.pmod(F.xxhash64(F.col(key)), F.lit(blocks))
    masks = F.array(*[F.struct((block * BLOCK_WORDS + w).alias("word"), b.alias("bit")) for w, b in _bits(F.col(key))])
    words = keys.select(F.explode(masks).alias("m")).select("m.word", "m.bit")
    words = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    every = keys.sparkSession.range(blocks * BLOCK_WORDS).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    words = words.unionByName(every).groupBy("word").agg(F.max(F.struct(F.col("bits") != 0, "bits"))["bits"].alias("bits"))
    table = words.agg(F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda x: x["bits"]).alias("words"))
    return common.cut(table), blocks


def might_contain(found: tuple[DataFrame, int], key: Column) -> Column:
    """Whether ``key`` may be among the keys of the filter: no false negatives. The filter reaches the tasks as the result of a subquery."""
    table, blocks = found
    words = table.scalar()
    base = F.pmod(F.xxhash64(key), F.lit(blocks)) * BLOCK_WORDS
    hit = F.lit(True)
    for w, b in _bits(key):
        hit = hit & (F.getbit(F.get(words, (base + w).cast("int")), b) == 1)
    return hit


def listed_pages(pages: DataFrame, listed: DataFrame, url_col: str = "url") -> DataFrame:
    """``(canonical)``: the distinct canonical addresses of ``pages`` that are among those of ``listed(url)``.

    The blocked Bloom filter of the listed ones passes possible hits, which an exact join then checks.
    """
    keys = common.cut(listed.select(canonical(F.col("url")).alias("canonical")).dropna().distinct())
    rows = keys.count()
    asked = pages.select(canonical(F.col(url_col)).alias("canonical")).filter(F.col("canonical").isNotNull() & might_contain(bloom(keys, "canonical", rows), F.col("canonical")))
    return common.lookup(asked.distinct(), keys, ["canonical"], "left_semi", rows=rows)


def filter_urls(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host, path, rule, verdict``: of ``rules(host, path, verdict)``, else ``block`` for the pages of ``listed(url)``, else ``default``.

    A rule covers its host and all hosts below it where the url's path starts with the rule's; of several the longest (host and
    path together) holds, of equally long ones a block, then the smaller text. A url that no rule covers has a null rule. Urls name the same page if their
    canonical addresses are equal (:func:`canonical`).

    Each url stands for the keys (a domain of its host, a prefix of its path), cut only at the label counts and path lengths that rules have, so that very long hosts and
    paths take time in proportion to their length. Rules and listed pages alike are
    looked up by a blocked Bloom filter and then an exact join.
    Null, empty and malformed urls have an empty host and path, are covered by no rule and aren't listed. Rows of equal url and id share the
    verdict; rules and listed urls that are repeated, or hold a null, count once or not at all. Input columns of the four names are replaced.
    """
    rules = rules.select("host", "path", "verdict").dropna().filter("host <> ''").distinct()
    rules = rules.select(F.concat("host", F.lit("\u0000"), "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    rules = common.cut(rules.groupBy("key", "rule").agg(F.max("verdict").alias("verdict")))  # of one key, block before allow
    # a few path lengths and label counts
    lengths, labels, rows = rules.agg(
        F.collect_set(F.length(F.substring_index("key", "\u0000", -1))), F.collect_set(F.size(F.split(F.substring_index("key", "\u0000", 1), r"\.", -1))), F.count(F.lit(1))
    ).first()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    urls = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    cuts = F.filter(F.lit(sorted(lengths) or [0]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(domains(F.col("host"), sorted(labels) or [0]), lambda d: F.transform(cuts, lambda n: F.concat(d, F.lit("\u0000"), F.substring(F.col("path"), F.lit(1), n)))))
    # each (host, path) is asked about once, however often it occurs
    asked = urls.select("host", "path", F.explode(keys).alias("key")).filter(might_contain(bloom(rules, rows=rows), F.col("key"))).distinct()
    hits = common.lookup(asked, rules, ["key"], "inner", rows=rows)
    best = hits.groupBy("host", "path").agg(
        F.min(F.struct((-F.length("rule")).alias("n"), F.when(F.col("verdict") == "block", 0).otherwise(1).alias("mild"), "rule", "verdict")).alias("_best")
    )
    out = urls.join(best, ["host", "path"], "left").withColumn("_found", F.lit(None).cast("boolean"))
    if listed is not None:
        named = listed_pages(pages, listed, url_col).select(F.col("canonical").alias("_page"), F.lit(True).alias("_found"))
        out = common.lookup(out.drop("_found").withColumn("_page", canonical(F.col(url_col))), common.cut(named), ["_page"])
    verdict = F.coalesce("_best.verdict", F.when(F.col("_found"), "block"), F.lit(default))
    return out.select(*kept, "host", "path", F.col("_best.rule").alias("rule"), verdict.alias("verdict"))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """``rules`` as the table that :func:`filter_urls` takes."""
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url: by the rules, else by a list of the pages that were found at hosts known for junk."""
    pages = common.read(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.filter(host_of(F.col("url")).rlike(JUNK_HOSTS)).select("url").unionByName(spark.createDataFrame([(u,) for u in LISTED], "url string"))
    return filter_urls(pages, rule_table(spark), listed).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op5_url_filter": op5_url_filter}
_FIXED = ", ".join(f"('{u}')" for u in LISTED)
_CANONICAL = r"""
  SELECT {id} AS id, a.host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || CASE WHEN clean = '' THEN '/' ELSE clean END || query AS page
  FROM (
    SELECT {id}, regexp_replace(translate(regexp_replace(auth, ':[0-9]*$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\.+$', '') AS host,
           regexp_extract(auth, ':([0-9]+)$', 1) AS port, query,
           CASE WHEN contains(plain, '/.') THEN
             array_to_string(list_reduce(list_transform(string_split(plain, '/'), lambda s: [s]),
               lambda x, y: CASE WHEN y[1] = '.' THEN x WHEN y[1] = '..' THEN x[1:greatest(1, len(x) - 1)] ELSE x || y END), '/')
             || CASE WHEN plain LIKE '%/.' OR plain LIKE '%/..' THEN '/' ELSE '' END
           ELSE plain END AS clean
    FROM (
      SELECT {id}, regexp_replace(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '(?s)^.*@', '') AS auth,
             regexp_extract(url, '(?s)^[^?#]*(\?[^#]+)', 1) AS query,
             array_to_string(list_transform(string_split(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '%'), lambda p, i:
               CASE WHEN i = 1 THEN p
                    WHEN regexp_matches(p, '^[0-9A-Fa-f][0-9A-Fa-f]') THEN
                      CASE WHEN regexp_matches(chr(coalesce(TRY_CAST('0x' || p[1:2] AS INTEGER), 32)), '^[A-Za-z0-9._~-]$') THEN chr(coalesce(TRY_CAST('0x' || p[1:2] AS INTEGER), 32)) ELSE '%' || upper(p[1:2]) END || p[3:]
                    ELSE '%' || p END), '') AS plain
      FROM {table} WHERE contains(url, '://'))) a
  WHERE a.host <> ''"""
SQL = {
    "op5_url_filter": r"""
WITH listed(url) AS (
  SELECT url FROM pages WHERE regexp_matches(translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '"""
    + JUNK_HOSTS
    + """')
  UNION ALL VALUES """
    + _FIXED
    + "),\nl AS ("
    + _CANONICAL.format(id="url", table="listed")
    + "),\nc AS ("
    + _CANONICAL.format(id="page_id", table="pages")
    + r"""),
u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, rverdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(rverdict, length(rhost || rpath)) AS rv
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(rv, CASE WHEN page_id IN (SELECT id FROM c WHERE page IN (SELECT page FROM l)) THEN 'block' END, 'allow') AS verdict
FROM u LEFT JOIN b USING (page_id)
""",
}
