"""URL filters: blocked Bloom filters of listed keys pass possible hits to exact hash joins.

Two lists are held against each URL. One is of canonical URLs: host (A-Z lower-cased, without user, default port, dot at its end and a `www.` before a host of two labels or more)
and path (escapes of unreserved characters undone, hex digits of the others upper-cased, no slashes at its end), scheme, query and fragment left off. The other is of rules, a host and a path prefix that hold for subdomains and longer paths as well; of each URL the keys that some
rule could have are made: its host's suffixes that are rules' hosts, times its path's prefixes as long as rules of that host have. A rule goes before the list.

Each key's hash names a block of 256 bits and 8 bits in it; the blocks are rows, met by an equi-join on the block number.
Keys whose bits are all set join the list exactly, so no false positive of a filter is left. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Fixed values of the query: verdict, host, path.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
#: The query's list of canonical URLs, made by a rule: of these hosts and sections, the pages numbered from 0.
LISTED_HOSTS = [f"{name}.example.{end}" for name in ("spam-farm", "cheap-pills") for end in ("com", "net", "org")]
LISTED_SECTIONS, LISTED_PAGES = ["en", "fr", "de", "es"], 10_000
PROBES, KEYS_PER_BLOCK = 8, 16
#: Rules or listed URLs up to which a list, and up to which its filter (2 bytes a key and a block's number), is sent to every executor; beyond, Spark chooses the joins.
SENT, FILTER_SENT = 20_000, 1_000_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(host: Column) -> Column:
    return F.translate(host, _UPPER, _LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null and where there is no `://`."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = lowered(F.regexp_extract(rest, r"\A[^/?#]*", 0))
    after = F.substr(rest, F.length(host) + 1)
    return host, F.when(at > 0, F.regexp_extract(after, r"\A[^?#]*", 0)).otherwise("")


def _plain(path: Column) -> Column:
    """A path whose escapes of letters, digits and -._~ are undone and whose other escapes have upper-case digits. What follows a % but isn't two such digits stays."""

    def after(piece: Column) -> Column:
        digits, rest = F.substring(piece, 1, 2), F.substr(piece, F.lit(3))
        char = F.char(F.conv(digits, 16, 10).cast("int"))
        undone = F.when(digits.rlike("^[2-7]") & char.rlike(r"^[A-Za-z0-9._~-]$"), F.concat(char, rest)).otherwise(F.concat(F.lit("%"), F.upper(digits), rest))
        return F.when(piece.rlike("^[0-9A-Fa-f]{2}"), undone).otherwise(F.concat(F.lit("%"), piece))

    parts = F.split(path, "%")
    return F.when(path.contains("%"), F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), after), ""))).otherwise(path)


def canonical(host: Column, path: Column) -> Column:
    """The key of a URL in a list of canonical ones."""
    bare = F.regexp_replace(F.regexp_replace(host, r"\A.*@|\.?(?::(?:80|443)?)?\z", ""), r"\Awww\.([^.]+\.)", "$1")
    return F.concat(bare, F.regexp_replace(_plain(path), r"/+\z", ""))


def _bits(key: Column, word: int) -> Column:
    """The bits of 64-bit word `word` of four that a key sets in its block: two a word."""
    h = F.xxhash64(F.lit(word), key)
    places = [h.bitwiseAND(F.lit(63)), F.shiftrightunsigned(h, 6).bitwiseAND(F.lit(63))]
    values = [F.call_function("shiftleft", F.lit(1).cast("long"), p.cast("int")) for p in places]
    return values[0].bitwiseOR(values[1])


def bloom_blocks(keys: DataFrame, n_blocks: int, key: str = "key") -> DataFrame:
    """(block, w0 .. w3): the filter's blocks that have a bit set."""
    rows = keys.select(F.pmod(F.xxhash64(F.lit("block"), F.col(key)), F.lit(n_blocks)).alias("block"), *[_bits(F.col(key), i).alias(f"w{i}") for i in range(PROBES // 2)])
    return rows.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(PROBES // 2)])


def _possible(made: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """The rows of made whose `key` passes a blocked filter of the n keys."""
    n_blocks = max(1, -(-n // KEYS_PER_BLOCK))
    blocks = bloom_blocks(keys, n_blocks)
    rows = made.withColumn("block", F.pmod(F.xxhash64(F.lit("block"), F.col("key")), F.lit(n_blocks)))
    passes = F.lit(True)
    for i in range(PROBES // 2):
        mask = _bits(F.col("key"), i)
        passes = passes & (F.col(f"w{i}").bitwiseAND(mask) == mask)
    return rows.join(F.broadcast(blocks) if n <= FILTER_SENT else blocks, "block").where(passes).select(*made.columns)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", otherwise: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages, by rules (verdict, host, path), then by a list of URLs (url) to block.

    A rule fits its host and all subdomains if the URL's path starts with the rule's path. The longest (host plus path) wins, of equally long ones
    the longer host; of equal rules with different verdicts block. Where no rule fits, a URL whose canonical form is that of a listed one is blocked, any other gets `otherwise`.
    Null URLs and those without `://` have empty host and path; rules with a null host or path, and listed URLs that are null or have no host, say nothing. Hosts are compared
    with A-Z lower-cased, on either side. Repeated rows are judged one by one; long URLs whole; an empty table gives an empty one; two empty lists allow everything. Only the named columns are
    read, so others may have any name.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    # one row a different (host, path): a URL that fills a third of all rows is judged once
    distinct = rows.where("host <> ''").select("host", "path").distinct()
    hits = []

    known = rules.select("verdict", lowered(F.col("host")).alias("host"), "path").where("host is not null and path is not null")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", F.concat("host", "path"))
    n, depths = known.agg(F.count(F.lit(1)), F.collect_set(F.size(F.split("host", r"\.")))).first()
    if n:
        small = F.broadcast if n <= SENT else lambda df: df
        labels = F.split("host", r"\.")
        suffixes = F.array_compact(F.array(*[F.when(F.size(labels) >= d, F.array_join(F.slice(labels, -d, d), ".")) for d in sorted(depths)]))
        lengths = known.groupBy(F.col("host").alias("of")).agg(F.collect_set(F.length("path")).alias("lengths"))
        at = distinct.select("host", "path", F.explode(suffixes).alias("of")).join(small(lengths), "of")
        made = at.select("host", "path", "of", F.explode(F.filter("lengths", lambda x: x <= F.length("path"))).alias("n")).select("host", "path", "of", F.concat("of", F.substring("path", F.lit(1), F.col("n"))).alias("key"))
        exact = known.select("key", "verdict", F.col("host").alias("of"))
        found = _possible(made, known, n).join(small(exact), ["key", "of"])
        hits.append(found.select("host", "path", F.struct(F.lit(1).alias("by"), F.length("key").alias("n"), F.length("of").alias("m"), "verdict", F.col("key").alias("rule")).alias("best")))

    if listed is not None:
        h, p = host_and_path(F.col("url"))
        keys = listed.select(canonical(h, p).alias("key"), h.alias("h")).where("h <> ''").select("key").distinct()
        n = keys.count()
        if n:
            found = _possible(distinct.select("host", "path", canonical(F.col("host"), F.col("path")).alias("key")), keys, n).join(F.broadcast(keys) if n <= SENT else keys, "key")
            hits.append(found.select("host", "path", F.struct(F.lit(0).alias("by"), F.lit(0).alias("n"), F.lit(0).alias("m"), F.lit("block").alias("verdict"), F.lit(None).cast("string").alias("rule")).alias("best")))

    if not hits:
        return rows.select("id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(otherwise).alias("verdict"))
    every = hits[0] if len(hits) == 1 else hits[0].unionByName(hits[1])
    best = every.groupBy("host", "path").agg(F.max("best").alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return rows.join(best, ["host", "path"], "left").select("id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))


def listed_urls(spark: SparkSession) -> DataFrame:
    """The query's list, from its rule."""
    k, hosts, sections = F.col("id"), F.array(*map(F.lit, LISTED_HOSTS)), F.array(*map(F.lit, LISTED_SECTIONS))
    host, section = F.get(hosts, (k % len(LISTED_HOSTS)).cast("int")), F.get(sections, (F.floor(k / len(LISTED_HOSTS)) % len(LISTED_SECTIONS)).cast("int"))
    page = F.floor(k / (len(LISTED_HOSTS) * len(LISTED_SECTIONS)))
    return spark.range(len(LISTED_HOSTS) * len(LISTED_SECTIONS) * LISTED_PAGES).select(F.concat(F.lit("https://"), host, F.lit("/"), section, F.lit("/"), page.cast("string")).alias("url"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array(*[F.struct(*[F.lit(x).alias(n) for x, n in zip(r, ("verdict", "host", "path"), strict=True)]) for r in RULES])
    rules = spark.range(1).select(F.inline(rows))
    return judge(table(spark, sf_dir, "pages"), rules, listed_urls(spark)).withColumnRenamed("id", "page_id")


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN url IS NOT NULL AND strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), listed AS (
  SELECT f || '.example.' || t || '/' || s || '/' || CAST(n AS VARCHAR) AS key FROM (SELECT unnest(['spam-farm', 'cheap-pills']) AS f)
  CROSS JOIN (SELECT unnest(['com', 'net', 'org']) AS t) CROSS JOIN (SELECT unnest(['en', 'fr', 'de', 'es']) AS s) CROSS JOIN (SELECT unnest(range(0, 10000)) AS n)
), e AS (
  SELECT *, list_transform(string_split(path, '%'), lambda x, i: struct_pack(x := x, i := i, d := upper(substr(x, 1, 2)), hex := i > 1 AND regexp_matches(x, '^[0-9A-Fa-f]{2}'),
    c := CASE WHEN regexp_matches(x, '^[2-7][0-9A-Fa-f]') THEN chr(CAST((strpos('0123456789ABCDEF', upper(substr(x, 1, 1))) - 1) * 16 + strpos('0123456789ABCDEF', upper(substr(x, 2, 1))) - 1 AS INTEGER)) ELSE '%' END)) AS parts FROM h
), p AS (
  SELECT page_id, host, path, array_to_string(list_transform(parts, lambda v: CASE WHEN v.i = 1 THEN v.x WHEN NOT v.hex THEN '%' || v.x WHEN regexp_matches(v.c, '^[A-Za-z0-9._~-]$') THEN v.c || substr(v.x, 3) ELSE '%' || v.d || substr(v.x, 3) END), '') AS plain FROM e
), m AS (
  SELECT h.page_id, h.host, h.path, r.rhost || r.rpath AS rule, r.verdict,
         regexp_replace(regexp_replace(regexp_replace(h.host, '^.*@', ''), '\.?(:(80|443)?)?$', ''), '^www\.([^.]+\.)', '\1') || regexp_replace(h.plain, '/+$', '') AS key,
         row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.rpath) DESC NULLS LAST) AS k
  FROM p h LEFT JOIN rules r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.rpath)
)
SELECT page_id, host, path, rule, CASE WHEN verdict IS NOT NULL THEN verdict WHEN key IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict FROM m WHERE k = 1
"""
