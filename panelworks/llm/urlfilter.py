"""URL filter: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

The filter lets possible hits through to an exact join with the list, which removes its false positives.
All of it is DataFrame and SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import saved

URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # 32-bit words of a block, one bit set in each for every entry
#: Blocks are sent to every task only up to this many (32 bytes each, so 32 MB); beyond it they are joined by shuffle.
SENT_BLOCKS = 1 << 20


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
         Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty for null or no ``://``."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), URL, 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), URL, 2)


def canonical(host: Column, path: Column) -> Column:
    """Host without a leading www., m. or blog., and the path without .html and closing slashes; no scheme, query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m|blog)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def rule_of(host: Column, path: Column, rules: list[Rule], value) -> Column:
    """``value(rule)`` of the longest rule that fits the host (or a parent domain) and the start of the path."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))) if out is None else out.when(fits, F.lit(value(r)))
    return F.lit(None).cast("string") if out is None else out


def bits(entry: Column) -> list[Column]:
    """One bit in each of the block's 32-bit words (as longs)."""
    h = F.xxhash64(entry, F.lit(101))
    at = [F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int") for i in range(WORDS)]
    return [F.call_function("shiftleft", F.lit(1).cast("long"), x).alias(f"w{i}") for i, x in enumerate(at)]


def block_of(entry: Column, n_blocks: int) -> Column:
    return F.pmod(F.xxhash64(entry, F.lit(7)), F.lit(n_blocks)).cast("long")


def bloom(listed: DataFrame, entry: str, n_blocks: int) -> DataFrame:
    """The filter as a table: (block, w0..w7), one row for each block that holds an entry."""
    own = listed.select(block_of(F.col(entry), n_blocks).alias("block"), *bits(F.col(entry)))
    return own.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def passed(rows: DataFrame, entry: str, listed: DataFrame, bits_per_entry: int = 16) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with boolean ``_may``, false where the Bloom filter rules the entry out; the distinct list, column ``_listed``)."""
    listed = saved(listed.select(entry).where(F.col(entry).isNotNull() & (F.col(entry) != "")).distinct(), "listed")
    n = listed.count()
    n_blocks = max(1, -(-n * bits_per_entry // (32 * WORDS)))
    table = bloom(listed, entry, n_blocks)
    table = F.broadcast(table) if n_blocks <= SENT_BLOCKS else table
    probe = rows.withColumn("_block", F.when(F.col(entry) != "", block_of(F.col(entry), n_blocks)).otherwise(-1 - F.pmod(F.xxhash64(*rows.columns), F.lit(4096))))
    probe = probe.join(table, probe["_block"] == table["block"], "left")
    may = F.lit(True)
    for i, b in enumerate(bits(F.col(entry))):
        may = may & (F.coalesce(F.col(f"w{i}"), F.lit(0).cast("long")).bitwiseAND(b) == b)
    probe = probe.select(*rows.columns, F.coalesce(may & (F.col(entry) != ""), F.lit(False)).alias("_may"))
    return probe, listed.select(F.col(entry).alias("_listed"))


def match_listed(rows: DataFrame, entry: str, listed: DataFrame, bits_per_entry: int = 16) -> DataFrame:
    """``rows`` with boolean ``listed``: whether column ``entry`` is among ``listed`` (a table with that column).

    Empty and null entries are never listed; repeated entries of the list count once; an empty list lists nothing,
    and an empty table stays empty. Very long entries are hashed and compared whole."""
    probe, listed = passed(rows, entry, listed, bits_per_entry)
    # what did not pass looks for the empty entry, which no list has, in many places so that it spreads
    spread = F.when(F.col("_may"), 0).otherwise(1 + F.pmod(F.xxhash64(*rows.columns), F.lit(4096))).cast("int")
    probe = probe.withColumns({"_entry": F.when(F.col("_may"), F.col(entry)).otherwise(""), "_at": spread})
    listed = listed.withColumn("_zero", F.lit(0))
    return probe.join(listed, (F.col("_entry") == F.col("_listed")) & (F.col("_at") == F.col("_zero")), "left").select(*rows.columns, F.col("_listed").isNotNull().alias("listed"))


#: Host labels of the kind a public blocklist names.
BAD_LABELS = ["casino-win", "free-bets", "cheap-pills", "ads-track"]
HREF = r'<a href="([^"]*)"'


def listed_urls(pages: DataFrame, labels: list[str] | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """A list of canonical URLs of bad neighbourhoods: pages whose host has one of the labels, and all that they link to
    on their hosts, whether or not it is among ``pages``. Any other table with the column ``canonical`` will do as well."""
    labels = BAD_LABELS if labels is None else labels
    h = host(F.col(url))
    bad = pages.where(F.arrays_overlap(F.split(h, r"\."), F.array(*[F.lit(x) for x in labels])))
    links = F.filter(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(HREF), F.lit(1)), lambda x: x.startswith("/"))
    paths = F.transform(links, lambda x: F.regexp_extract(x, r"(?s)^([^?#]*)", 1))
    every = bad.select(h.alias("host"), F.explode(F.concat(F.array(path(F.col(url))), paths)).alias("path"))
    return every.select(canonical(F.col("host"), F.col("path")).alias("canonical")).distinct()


def judge(pages: DataFrame, listed: DataFrame, keep: list[str], rules: list[Rule] | None = None, url: str = "url") -> DataFrame:
    """The columns ``keep`` with ``host``, ``path``, ``canonical``, ``listed``, ``rule`` and ``verdict``.

    A rule decides where one fits, the longest one and of two equally long ones the first in the list; elsewhere a
    listed URL is blocked and any other allowed. A null or malformed url has an empty host and path, fits no rule
    and is allowed. Rows are kept as often as they come, very long urls are judged whole, and an empty table gives
    an empty result. The kept columns stay inside ``_row``, so none can clash."""
    rules = RULES if rules is None else rules
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("_row"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"))
    own = own.withColumn("canonical", canonical(F.col("host"), F.col("path")))
    own = match_listed(own, "canonical", listed)
    h, p = F.col("host"), F.col("path")
    own = own.withColumn("rule", rule_of(h, p, rules, lambda r: r.name))
    verdict = F.coalesce(rule_of(h, p, rules, lambda r: r.verdict), F.when(F.col("listed"), "block").otherwise("allow"))
    return own.withColumn("verdict", verdict).select("_row", "host", "path", "canonical", "listed", "rule", "verdict")
