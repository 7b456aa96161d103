"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host, a path beginning and an action: it fits the host and its subdomains where the path starts with the rule's.
Either part may hold `*` for any characters; an empty host fits every host, and a path that begins with `*` fits anywhere in
the path. A rule becomes one regular expression over host and path, and the literal tokens that every fitting url must hold as
whole tokens; it is filed under the token that is rarest among the urls judged. A url's tokens (the parts of host and path
between `.` and `/`) fetch their rules, and only those run their expression. Rules without a sure token are filed under the
empty token, which every url fetches.

Everything is DataFrame functions. Distinct host and path pairs are judged once. The index is joined by token; the optimizer
broadcasts it where the measured size allows and otherwise sorts and merges, and splits hot tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.common import ascii_lower, without

#: Fixed rules of the query contract: host, path, action.
CONTRACT_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

#: The method's own patterns, for urls that no rule given by the caller fits: pages that carry no prose.
DEFAULT_PATTERNS = [
    ("ads.*", "", "block"), ("adserver.*", "", "block"), ("tracker.*", "", "block"), ("login.*", "", "block"),
    ("", "*/ads/", "block"), ("", "*/banner/", "block"), ("", "*/login/", "block"), ("", "*/signup/", "block"),
    ("", "*/cart/", "block"), ("", "*/checkout/", "block"), ("", "*/casino/", "block"), ("", "*/porn/", "block"),
    ("", "*/xxx/", "block"), ("", "*/wp-admin/", "block"), ("", "*/cgi-bin/", "block"), ("", "*.exe", "block"), ("", "*.zip", "block"),
]


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A to Z in lower case; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end; empty for null or without ://."""
    rest = F.when(F.instr(url, "://") > 0, url.substr(F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]], own: bool) -> DataFrame:
    """Rules as rows: rule (host and path as written), host, path, action, own (given by the caller)."""
    rows = [F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rules]
    df = spark.range(1).select(F.inline(F.array(*rows))) if rows else spark.range(0).select(*[F.lit("").alias(c) for c in ("host", "path", "action")])
    return df.select(F.concat("host", "path").alias("rule"), "host", "path", "action", F.lit(own).alias("own"))


def _escaped(c: Column) -> Column:
    """A literal with * as any characters."""
    return F.regexp_replace(F.regexp_replace(c, r"([\\^$.|?+()\[\]{}])", r"\\$1"), r"\*", ".*")


def compiled(rules: DataFrame) -> DataFrame:
    """Adds `pattern`, over host and path joined, and `tokens`, which every fitting url holds as whole tokens.

    The tokens of a host are its labels, all of them whole: a label is cut by dots or by the start of the rule, which may
    follow a dot, and ends at a dot or the host's end. A path's last token is whole only if a slash follows it.
    """
    host = F.when(F.col("host") == "", F.lit("[^/]*")).otherwise(F.concat(F.lit(r"(?:[^/]*\.)?"), F.regexp_replace(_escaped(F.col("host")), r"\.\*", "[^/]*")))
    tail = F.when(F.col("path") == "", F.lit("(?:/|$)")).otherwise(_escaped(F.col("path")))
    labels = F.split("host", r"\.")
    parts = F.filter(F.split(F.regexp_replace("path", r"[^/]*$", ""), r"[/.]"), lambda x: x != "")
    literal = F.filter(F.concat(labels, parts), lambda x: (x != "") & ~F.contains(x, F.lit("*")))
    starred = F.contains(F.col("path"), F.lit("*")) & ~F.startswith(F.col("path"), F.lit("*/"))
    whole = F.when(starred, F.filter(labels, lambda x: (x != "") & ~F.contains(x, F.lit("*")))).otherwise(literal)
    return rules.withColumn("pattern", F.concat(F.lit("(?s)^"), host, tail)).withColumn("tokens", F.array_distinct(whole))


def url_tokens(host: Column, path: Column) -> Column:
    """The distinct tokens of a url, and the empty one."""
    return F.array_distinct(F.concat(F.split(host, r"\."), F.split(path, r"[/.]"), F.array(F.lit(""))))


def index(rules: DataFrame, addresses: DataFrame) -> DataFrame:
    """The rules, each once, under the `token` of theirs that fewest addresses hold (the first in order on a tie)."""
    ruled = compiled(rules)
    wanted = ruled.select(F.explode("tokens").alias("token")).distinct()
    counts = (
        addresses.select(F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token")).join(wanted, "token", "left_semi")
        .groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    )
    keyed = ruled.select("rule", F.explode("tokens").alias("token")).join(counts, "token", "left")
    rarest = keyed.groupBy("rule").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).getField("token").alias("token"))
    return ruled.drop("tokens").join(rarest, "rule", "left").withColumn("token", F.coalesce("token", F.lit("")))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """All columns of pages, then host, path, rule, verdict, method_rule; older columns of these names give way.

    The longest rule of the caller's that fits decides (on a tie block before allow, then a hash of the rule). Else the longest of the method's own patterns does and is named in method_rule; else a url without host is
    blocked, and any other has `default`. Null or odd urls have empty host and path; repeated rows are judged alike; an empty
    table of pages or rules is no special case.
    """
    split = without(pages, "host", "path", "rule", "verdict", "method_rule").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    addresses = split.select("host", "path").distinct()
    filed = index(rules.unionByName(rules_table(pages.sparkSession, DEFAULT_PATTERNS, False)).dropDuplicates(["rule", "action", "own"]), addresses)
    fetched = addresses.select("host", "path", F.explode(url_tokens(F.col("host"), F.col("path"))).alias("token"))
    fits = fetched.join(filed.select("token", "pattern", "rule", "action", "own"), "token").where(F.expr("concat(host, path) rlike pattern"))
    # the largest order decides: own rules, then length; ties by the smaller text
    order = F.struct(F.col("own"), F.length("rule").alias("long"), (F.col("action") == "block").alias("strict"))
    best = fits.groupBy("host", "path").agg(F.max_by(F.struct("own", "rule", "action"), F.struct(order, F.hash("rule"))).alias("best"))
    judged = split.join(best, ["host", "path"], "left")
    own = F.coalesce(F.col("best.own"), F.lit(False))
    fallback = F.when(F.col("host") == "", "block").otherwise(default)
    return judged.withColumns({
        "rule": F.when(own, F.col("best.rule")),
        "verdict": F.coalesce(F.col("best.action"), fallback),
        "method_rule": F.when(~own, F.col("best.rule")),
    }).select(*[F.col(f"`{c}`") for c in split.columns], "rule", "verdict", "method_rule")


def contract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return judge(pages, rules_table(spark, CONTRACT_RULES, True)).select("page_id", "host", "path", "rule", "verdict", "method_rule")
