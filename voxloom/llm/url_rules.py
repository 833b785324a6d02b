"""URL filters: pattern rules indexed by their rarest literal token.

Every rule is a regular expression together with the literal tokens that any
URL it matches must hold. The tokens of all distinct URLs are counted; each rule
is filed under the rarest of its tokens. A URL's tokens fetch the rules filed
under them, and only those rules' expressions run on it.

Rules may be a table: their number is not bounded by the plan, and whether their
index is broadcast is left to its size.

Defined results: host and path of a NULL URL, or one without ``://``, are empty
and no rule fits; repeated rows stay repeated; URLs of any length are judged
whole; an empty table gives an empty result. Other columns are left out: join on
the keys to get them back. Keys may not begin with two underscores.
"""

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxloom.session import stored

#: (verdict, host, path) of the contract: fits the host and all its subdomains.
SITE_RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: (verdict, pattern, literal tokens): what decides where no site rule fits.
PATTERN_RULES = (
    ("block", r"\A([^/]*[.])?ads-[a-z0-9]+[.]", ("ads",)),
    ("block", r"\A([^/]*[.])?adult-[a-z0-9]+[.]", ("adult",)),
    ("block", r"\A([^/]*[.])?casino-[a-z0-9]+[.]", ("casino",)),
    ("block", r"\A([^/]*[.])?cheap-pills[.]", ("cheap", "pills")),
    ("block", r"\A([^/]*[.])?free-bets[.]", ("free", "bets")),
    ("block", r"\A([^/]*[.])?spam-[a-z0-9]+[.]", ("spam",)),
)
TOKEN = "[a-z0-9]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


@dataclass(frozen=True)
class Rule:
    """``pattern`` runs on host and path, which are joined without anything between.

    ``name`` is what a fitting page shows, None for patterns; a larger ``rank`` wins.
    """

    verdict: str
    pattern: str
    tokens: tuple
    rank: int
    name: str | None = None


def site_rule(verdict, host, path):
    """A rule on a host with its subdomains and the start of the path."""
    pattern = rf"\A([^/]*[.])?{re.escape(host)}{re.escape(path)}"
    name = f"{host}{path}"
    return Rule(verdict, pattern, literal_tokens(name), 1000 + len(name), name)


def wildcard_rule(verdict, host, path="/", rank=1):
    """Like ``site_rule``, but each ``*`` stands for any characters (within the host: but ``/``)."""
    parts = [("[^/]*", host), ("(?s:.*)", path)]
    run = "".join(wild.join(map(re.escape, part.split("*"))) for wild, part in parts)
    name = f"{host}{path}"
    return Rule(verdict, rf"\A([^/]*[.])?{run}", literal_tokens(name), rank, name)


def literal_tokens(address):
    """The tokens that must stand whole in what fits: none that ``*`` or the end may lengthen."""
    lower = address.translate(str.maketrans(UPPER, UPPER.lower()))
    return tuple(re.findall(rf"(?<![*a-z0-9]){TOKEN}(?![*a-z0-9]|\Z)", lower))


RULES = tuple(site_rule(*given) for given in SITE_RULES) + tuple(
    Rule(verdict, pattern, tokens, 0) for verdict, pattern, tokens in PATTERN_RULES
)


def host_of(url):
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    host = F.regexp_extract(url, r"\A(?s:.*?)://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, UPPER.lower()), F.lit(""))


def path_of(url):
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(address):
    """Distinct lower-case runs of ASCII letters and digits, and the empty token."""
    lower = F.translate(address, UPPER, UPPER.lower())
    return F.array_distinct(F.split(F.concat(lower, F.lit("/")), "[^a-z0-9]+"))


def rules_table(spark, rules):
    """Rules as a table: ``verdict``, ``pattern``, ``rank``, ``name``, ``tokens``."""
    return spark.createDataFrame(
        [(r.verdict, r.pattern, r.rank, r.name, list(r.tokens)) for r in rules],
        "verdict string, pattern string, rank int, name string, tokens array<string>",
    )


def index_rules(tokens, rules):
    """One row per distinct rule: the rarest of its tokens, by how many addresses hold it.

    ``tokens`` has a column ``__token``, ``rules`` is like ``rules_table``. The
    index is as long as the list of rules, whatever the input. A rule without
    literal tokens is filed under the empty token, which every address has.
    """
    # Stored, so that Spark knows its size and broadcasts it, and what follows from it, or not.
    listed = stored(
        rules.withColumn(
            "token",
            F.explode(F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit("")))),
        ).drop("tokens"),
        "rules",
    )
    # Only the rules' own tokens are counted, so this table is short too.
    wanted = listed.select(F.col("token").alias("__token")).distinct()
    counts = tokens.join(wanted, "__token", "left_semi").groupBy("__token").count()
    rarity = F.struct(F.coalesce("count", F.lit(0)).alias("uses"), "token")
    return stored(
        listed.join(counts, F.col("token") == F.col("__token"), "left")
        .groupBy("verdict", "pattern", "rank", "name")
        .agg(F.min(rarity)["token"].alias("token")),
        "rule_index",
    )


def judge_urls(pages, rules=RULES, keys=("page_id",), default="allow"):
    """Host, path, best rule and verdict of every row's ``url``.

    ``rules`` are ``Rule``s or a table like ``rules_table``. Of the fitting
    rules that of the largest rank wins, ties by name, then by verdict; without
    any the verdict is ``default``.
    """
    if not isinstance(rules, DataFrame):
        rules = rules_table(pages.sparkSession, rules)
    addresses = (
        pages.select(*keys, "url")
        # Equal rows are told apart by their places, so that none is a hot group.
        .withColumn("__row", F.monotonically_increasing_id())
        .withColumn("__host", host_of(F.col("url")))
        .withColumn("__path", path_of(F.col("url")))
        .withColumn("__address", F.concat("__host", "__path"))
    )
    all_tokens = pages.select(
        F.explode(tokens_of(F.concat(host_of(F.col("url")), path_of(F.col("url")))))
        .alias("__token")
    )
    index = index_rules(all_tokens, rules).select(
        F.col("token").alias("__filed"),
        F.col("pattern").alias("__pattern"),
        *[F.col(name).alias(f"__{name}") for name in ("verdict", "rank", "name")],
    )
    fits = F.coalesce(F.expr("__address rlike __pattern"), F.lit(False)) & (F.col("__host") != "")
    rule = F.struct("__rank", "__name", "__verdict")
    return (
        addresses.withColumn("__token", F.explode(tokens_of(F.col("__address"))))
        .join(index, F.col("__token") == F.col("__filed"), "left")
        .groupBy("__row", *keys, "url", "__host", "__path")
        .agg(F.max(F.when(fits, rule)).alias("__best"))
        .select(
            *keys,
            "url",
            F.col("__host").alias("host"),
            F.col("__path").alias("path"),
            F.col("__best.__name").alias("rule"),
            F.coalesce("__best.__verdict", F.lit(default)).alias("verdict"),
        )
    )
