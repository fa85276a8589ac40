"""URL filters: host and path rules, and a Bloom filter cascade over listed hosts, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import lookup, table

#: (verdict, host, path)
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: hosts blocked with their subdomains where no rule fits: the list of the query; filter_urls takes any table
LISTED_HOSTS = ("ads-track.example.com", "adult-x.example.net", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.com")
BITS_PER_KEY = 16
HASHES = 5  # bits of a key, all in one word of 64
MAX_LEVELS = 64
SHARD = 1 << 20  # words of a level that go to the tasks as one literal: 8 MB
MAX_SHARDS = 16  # literals of all levels together: 128 MB.  A longer level is asked by key instead


def host_of(url: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(after_scheme(url), r"^([^/?#]*)", 1), upper, upper.lower())


def after_scheme(url: Column) -> Column:
    """What follows the first ://, empty without one."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substr(text, at + 3)).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    return F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def _word(key: Column, level: int, words: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(2 * level), key), F.lit(words))


def _mask(key: Column, level: int) -> Column:
    """The bits of a key in its word: six bits of a hash for each."""
    h = F.xxhash64(F.lit(2 * level + 1), key)
    out = F.lit(0).cast("long")
    for i in range(HASHES):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


class Level:
    """One Bloom filter: words of 64 bits, a row (word, bits) each, in the shared folder."""

    def __init__(self, keys: DataFrame, n: int, level: int):
        self.level, self.words = level, max(16, -(-n * BITS_PER_KEY // 64))
        own = keys.select(_word(F.col("key"), level, self.words).alias("word"), _mask(F.col("key"), level).alias("bits"))
        self.rows = table(own.groupBy("word").agg(F.bit_or("bits").alias("bits")), "filter")

    def shards(self) -> int:
        return -(-self.words // SHARD)

    def passes(self, key: Column) -> Column:
        """Whether a key passes, without a join: the words are scalar subqueries, literals of the plan once it runs."""
        word, mask = _word(key, self.level, self.words), _mask(key, self.level)
        at = (word % SHARD + 1).cast("int")
        found = F.lit(None).cast("long")
        for shard in range(self.shards()):
            part = self.rows.sparkSession.range(shard * SHARD, min(self.words, (shard + 1) * SHARD)).withColumnRenamed("id", "word")
            part = part.join(self.rows, "word", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits")))), lambda x: x["bits"]).alias("a"))
            inside = F.element_at(part.scalar(), at)
            found = inside if self.shards() == 1 else F.when(F.floor(word / SHARD) == shard, inside).otherwise(found)
        return found.bitwiseAND(mask) == mask

    def marked(self, rows: DataFrame, name: str) -> DataFrame:
        """rows(key, ...) with `name`, whether the key passes: by a join on the word, for filters too long to be sent."""
        out = rows.withColumn("word", _word(F.col("key"), self.level, self.words)).join(self.rows, "word", "left")
        mask = _mask(F.col("key"), self.level)
        return out.withColumn(name, F.coalesce(F.col("bits").bitwiseAND(mask) == mask, F.lit(False))).drop("word", "bits")


class Cascade:
    """Exact membership of a key universe in a list, held in a few Bloom filters.

    Level 0 encodes the listed keys, level 1 the unlisted keys of the universe that
    pass level 0, level 2 the listed keys that pass level 1, and so on until none is
    left.  A key is listed when the number of levels it passes in a row is odd.  The
    universe must hold every key that will be asked.  Filters grow with their keys, 16
    bits a key; each level works on what the one before let pass.
    """

    def __init__(self, universe: DataFrame, max_shards: int = MAX_SHARDS):
        """universe: (key, listed), each key once."""
        self.levels: list[Level] = []
        keys = table(universe, "keys")
        own, other = keys.where("listed"), keys.where("not listed")
        n = own.count()
        while n:
            if len(self.levels) == MAX_LEVELS:
                raise RuntimeError("the cascade does not end")
            level = Level(own, n, len(self.levels))
            self.levels.append(level)
            self.sent = sum(x.shards() for x in self.levels) <= max_shards
            passed = other.where(level.passes(F.col("key"))) if self.sent else level.marked(other, "_p").where("_p").drop("_p")
            own, other = table(passed, "keys"), own
            n = own.count()

    def _odd(self, passes: list[Column]) -> Column:
        out = F.lit(len(passes) % 2 == 1)
        for level in reversed(range(len(passes))):
            out = F.when(passes[level], out).otherwise(F.lit(level % 2 == 1))
        return out

    def ask(self, rows: DataFrame, key: str) -> DataFrame:
        """rows with `_listed`, exactly.  Without a join while the filters are within max_shards; else distinct keys ask by join."""
        if not self.levels or self.sent:
            return rows.withColumn("_listed", self._odd([x.passes(F.col(key)) for x in self.levels]))
        keys = rows.select(F.col(key).alias("key")).where("key is not null").distinct()
        for x in self.levels:
            keys = x.marked(keys, f"_p{x.level}")
        known = keys.select(F.col("key").alias(key), self._odd([F.col(f"_p{x.level}") for x in self.levels]).alias("_listed"))
        return lookup(rows, known, [key])


def listed_hosts(hosts: DataFrame, listed: DataFrame) -> DataFrame:
    """The keys of hosts(key) that are in listed(key) or subdomains of one.  On distinct hosts; each asks with all its ends."""
    dots = F.split("key", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(dots)), lambda i: F.array_join(F.slice(dots, i, F.size(dots) - i + 1), "."))
    asked = hosts.distinct().select("key", F.explode(ends).alias("end"))
    return asked.join(listed.select(F.col("key").alias("end")).where("end is not null").distinct(), "end", "left_semi").select("key").distinct()


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", max_shards: int = MAX_SHARDS) -> DataFrame:
    """Per page: page_id, host, path, rule and verdict.

    The longest rule that fits decides; where none does, a host in listed(key), or a
    subdomain of one, is blocked and another allowed, asked of a cascade over all hosts
    of the pages.  A url that is null or has no :// has an empty host and path: no rule
    fits, it is allowed unless the empty key is listed.  Null keys are ignored, repeated
    ones count once.  Null and repeated page ids stay, a row for a row; an empty table
    gives no rows; a very long url is a url; other columns are not looked at.
    """
    url = F.col(url_col)
    own = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    hosts = table(own.select(F.col("host").alias("key")).distinct(), "hosts")
    marked = hosts.join(listed_hosts(hosts, listed).withColumn("listed", F.lit(True)), "key", "left")
    cascade = Cascade(marked.select("key", F.coalesce("listed", F.lit(False)).alias("listed")), max_shards)
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    other = F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow"))
    return cascade.ask(own, "host").select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, other).alias("verdict"))


def op9_url_filters(spark, sf_dir: str) -> DataFrame:
    listed = spark.range(1).select(F.explode(F.array(*[F.lit(h) for h in LISTED_HOSTS])).alias("key"))
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), listed)


SQL = r"""
WITH rest AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
ruled AS (
  SELECT *, CASE
    WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE
  WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block'
  WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow'
  WHEN EXISTS (SELECT 1 FROM (VALUES LISTED) AS l(h) WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END AS verdict FROM ruled
""".replace("LISTED", ", ".join(f"('{h}')" for h in LISTED_HOSTS))
