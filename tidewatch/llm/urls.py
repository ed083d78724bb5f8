"""URL filters: a rule list, and host reputations by empirical Bayes.

Labelled pages are bad or not. A host's share of bad pages is drawn towards that of its registered
domain, the domain's towards its suffix's, and the suffix's towards that of all pages. How strongly
is learned for each level from how far its members differ (beta-binomial, method of moments). A host
is blocked if the lower bound of its posterior share is above a limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import ascii_lower, stored

#: Lower posterior bound of the bad share above which a host is blocked, and the bound's distance in deviations.
MAX_BAD, DEVIATIONS = 0.35, 1.645
#: Suffixes of two labels under which domains are registered. Fixed values.
SECOND_LEVEL = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.jp", "ne.jp", "or.jp",
    "co.kr", "co.nz", "co.za", "com.br", "com.cn", "com.mx", "com.tr", "com.tw", "co.in", "com.ar",
)


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without "://"."""
    given = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    at = F.instr(given, "://")
    rest = F.when(at > 0, F.substr(given, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of the rules (verdict, host, path) that fits, or nulls.

    A rule fits its host and all below it if the path begins with the rule's. Of equally long rules
    the first in the alphabet wins.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, own, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(start)
        rule, verdict = F.when(fits, F.lit(own + start)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def _levels(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user and port."""
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    parts = F.split(name, r"\.")
    last = lambda n: F.substring_index(name, ".", -n)
    two = last(2).isin(*SECOND_LEVEL)
    suffix = F.when(two, last(2)).otherwise(last(1))
    domain = F.when(two, last(3)).otherwise(last(2))
    return F.when(F.size(parts) > 1, domain).otherwise(name), suffix


def _drawn(level: DataFrame) -> DataFrame:
    """level (n, bad, towards) with strength and mean: its shares drawn towards the level above.

    With k members of n pages, sum n (share - m)^2 / (m (1 - m)) is expected to be
    k + r * sum (n - 1), where r = 1 / (strength + 1). r is kept within 0.001 and 0.999.
    """
    m = F.col("towards")
    excess = F.sum(F.col("n") * F.pow(F.col("bad") / F.col("n") - m, 2) / (m * (1 - m))) - F.count("*")
    r, more = level.filter("n > 0").agg(excess, F.sum(F.col("n") - 1)).first()  # one row
    r = min(max(r / more, 0.001), 0.999) if more else 0.001
    strength = F.lit(1 / r - 1)
    return level.withColumn("strength", strength).withColumn("mean", (F.col("bad") + strength * m) / (F.col("n") + strength))


def reputations(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(host, bound): the lower posterior bound of the bad share of every host of pages (page_id, host).

    A page is bad if one of its labels (doc_id is the page's id) has quality 0 or toxic 1; labels
    without id or without both values are no labels. Hosts without labels have their domain's share; without any label all shares are 0.
    """
    marks = labels.select("doc_id", "quality", "toxic").filter("doc_id is not null and (quality is not null or toxic is not null)")
    worst = F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0))
    marks = marks.groupBy(F.col("doc_id").alias("page_id")).agg(worst.alias("is_bad"))
    domain, suffix = _levels(F.col("host"))
    hosts = pages.join(marks, "page_id", "left").groupBy("host").agg(
        F.count("is_bad").alias("n"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    hosts = stored(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "bad"), "hosts")
    n, bad = hosts.agg(F.sum("n"), F.sum("bad")).first()  # one row
    total = F.lit((bad + 0.5) / (n + 1.0) if n else 0.0)
    add = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    suffixes = _drawn(hosts.groupBy("suffix").agg(*add).withColumn("towards", total))
    above = suffixes.select("suffix", F.col("mean").alias("towards"))
    domains = _drawn(hosts.groupBy("domain", "suffix").agg(*add).join(above, "suffix"))
    above = domains.select("domain", "suffix", F.col("mean").alias("towards"))
    own = _drawn(hosts.join(above, ["domain", "suffix"]))
    spread = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("n") + F.col("strength") + 1))
    return own.select("host", F.round(F.col("mean") - F.lit(DEVIATIONS) * spread, 6).alias("bound"))


def filter_urls(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url: str = "url",
    max_bad: float = MAX_BAD,
) -> DataFrame:
    """page_id, host, path, rule, verdict, bound for every row of pages.

    The verdict is the rule's, else block if the host's bound is above max_bad, else allow. A page
    without host has an empty host and no bound, and is allowed. Null and repeated ids keep their
    rows; other columns are not read.
    """
    host, path = host_and_path(url)
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), host.alias("host"), path.alias("path"))
    known = reputations(rows.filter("host <> ''").select("page_id", "host"), labels)
    rule, says = rule_for(F.col("host"), F.col("path"), rules)
    learned = F.when(F.col("bound") > F.lit(max_bad), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(known, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(says, learned).alias("verdict"), "bound"
    )
