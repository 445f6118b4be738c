"""URL filter: explicit rules first, then empirical-Bayes host reputation. DataFrame operations only.

A rule ``host/path`` fits its host and all subdomains when the URL's path starts with the
rule's path; the longest fitting rule decides. All other URLs are judged by reputation:
labelled page outcomes (bad = 1) are counted per host, registered domain and suffix, and
each level's beta prior is centred on the posterior mean of the level above it. The
strength of the prior of a level is found by the method of moments for the beta-binomial
(strong where the groups of the level differ no more than chance explains). A host is
blocked when the lower posterior bound of its bad rate exceeds ``max_bad``.

Scale: labels are counted by host on the map side; a written table of different hosts carries
the posteriors. It is broadcast while it is small; beyond that pages meet it in one join by host
that adaptive execution can split. Of a level only two sums reach the driver.

Defined cases: a null URL, or one without ``://``, has an empty host and path, fits no rule
and is judged with the pages of the empty host. Ports and user names are part of the host for
rules and not for reputation. Unlabelled hosts take the posterior of their domain, suffix or all.
Of rules of one length that fit, the smaller wins. Repeated rows are judged alike; of labels that
share a page the larger counts; labels without a page and pages without a label are fine. Very
long URLs are read whole, other columns ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratalign.llm._util import ascii_lower, discard, materialize, or_empty

#: Second-level labels under which country suffixes register names.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "org")
#: More rules than this are a table that different hosts meet, instead of an expression each.
INLINE_RULES = 64
#: Rows of host tables that may be broadcast.
BROADCAST_HOSTS = 200_000


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(or_empty(url), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(or_empty(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def bare_host(host: Column) -> Column:
    """Without user name, port and closing dot."""
    return F.regexp_replace(host, r"^.*@|:[0-9]*$|\.$", "")


def suffix_of(bare: Column) -> Column:
    two = r"\.((?:" + "|".join(SECOND_LEVEL) + r")\.[a-z]{2})$"
    numeric = bare.rlike(r"^[0-9.]+$|^\[.*\]$")
    return F.when(numeric, F.lit("")).when(bare.rlike(two), F.regexp_extract(bare, two, 1)).otherwise(F.substring_index(bare, ".", -1))


def domain_of(bare: Column) -> Column:
    """The label before the suffix, and the suffix; numeric addresses stand for themselves."""
    suffix = suffix_of(bare)
    depth = F.when(suffix.contains("."), 3).otherwise(2)
    return F.when(suffix == "", bare).when(depth == 3, F.substring_index(bare, ".", -3)).otherwise(F.substring_index(bare, ".", -2))


def parse_rules(rules: Sequence[tuple[str, str]]) -> list[tuple[str, str, str, str]]:
    """(verdict, rule) pairs to (rule, host, path, verdict), longest rule first."""
    out = []
    for verdict, rule in rules:
        if verdict not in ("allow", "block") or "/" not in rule:
            raise ValueError(f"not a rule: {verdict} {rule}")
        host, _, rest = rule.partition("/")
        out.append((rule, host, "/" + rest, verdict))
    return sorted(out, key=lambda r: (-len(r[0]), r[0]))


def _matched(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Adds rule and rule_verdict by one expression for each rule."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, host, path, decision in reversed(parse_rules(rules)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(decision)).otherwise(verdict)
    return pages.withColumns({"rule": rule, "rule_verdict": verdict})


def rules_of_hosts(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, host_rules): for each host that has any, the rules of it and of what it is a subdomain of, longest first."""
    r = rules.select(
        F.substring_index("rule", "/", 1).alias("rule_host"),
        F.struct((-F.length("rule")).alias("order"), "rule", F.expr("substring(rule, locate('/', rule))").alias("path"), "verdict").alias("one"),
    )
    labels = F.split("host", r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    per_host = materialize(r.groupBy("rule_host").agg(F.collect_list("one").alias("some")), "url-rules")
    met = hosts.select("host", F.explode(tails).alias("rule_host")).join(per_host, "rule_host")
    return met.groupBy("host").agg(F.array_sort(F.flatten(F.collect_list("some"))).alias("host_rules"))


def match_rule_table(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (host, path, ...) with rule and rule_verdict, for a table (rule, verdict) of any length.

    Different hosts meet the rules, and pages their host's; of rules of one length the smaller wins.
    """
    of = materialize(rules_of_hosts(pages.select("host").distinct(), rules), "url-host-rules")
    met = pages.join(F.broadcast(of) if of.count() <= BROADCAST_HOSTS else of, "host", "left")
    best = F.get(F.filter("host_rules", lambda x: F.startswith(F.col("path"), x["path"])), F.lit(0))
    return met.withColumn("host_rules", best).withColumns({"rule": F.col("host_rules.rule"), "rule_verdict": F.col("host_rules.verdict")}).select(*pages.columns, "rule", "rule_verdict")


def _level(groups: DataFrame, least: float, most: float) -> DataFrame:
    """Posterior mean and strength of (n, bad, prior) groups in a written table; prior is the prior's mean."""
    spread = F.col("prior") * (1 - F.col("prior"))
    m = groups.agg(
        F.sum((F.col("bad") - F.col("n") * F.col("prior")) * (F.col("bad") - F.col("n") * F.col("prior")) - F.col("n") * spread).alias("excess"),
        F.sum(F.col("n") * (F.col("n") - 1) * spread).alias("room"),
    ).first()
    low, high = 1.0 / (most + 1), 1.0 / (least + 1)
    rho = min(max(m["excess"] / m["room"], low), high) if m["room"] else low
    strength = F.lit(1.0 / rho - 1.0)
    return groups.withColumns({"strength": strength, "mean": (F.col("bad") + strength * F.col("prior")) / (F.col("n") + strength)})


def host_reputation(hosts: DataFrame, z: float = 1.645, least: float = 2.0, most: float = 1000.0) -> DataFrame:
    """(host, mean, low) for every row of ``hosts`` (host, n, bad): labelled pages, and bad ones.

    ``least`` and ``most`` bound the prior strengths, in pseudo pages. Each level is a written table.
    """
    bare = bare_host(F.col("host"))
    counted = materialize(hosts.select("host", domain_of(bare).alias("domain"), suffix_of(bare).alias("suffix"), F.col("n").cast("double").alias("n"), F.coalesce("bad", F.lit(0)).cast("double").alias("bad")), "url-hosts")
    domains = materialize(counted.groupBy("domain", "suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "url-domains")
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    total = domains.agg(F.coalesce(F.sum("bad"), F.lit(0.0)).alias("bad"), F.coalesce(F.sum("n"), F.lit(0.0)).alias("n")).first()
    s = materialize(suffixes.withColumn("prior", F.lit((total["bad"] + 0.5) / (total["n"] + 1.0))), "url-suffixes")
    d = materialize(domains.join(_level(s, least, most).select("suffix", F.col("mean").alias("prior")), "suffix"), "url-domain-priors")
    h = materialize(counted.join(_level(d, least, most).select("domain", "suffix", F.col("mean").alias("prior")), ["domain", "suffix"]), "url-host-priors")
    judged = _level(h, least, most)
    weight = F.col("n") + F.col("strength") + 1.0
    out = materialize(judged.select("host", "mean", (F.col("mean") - F.lit(z) * F.sqrt(F.col("mean") * (1 - F.col("mean")) / weight)).alias("low")), "url-reputation")
    discard(counted, domains, s, d, h)
    return out


def filter_urls(
    pages: DataFrame,
    labels: DataFrame | None,
    rules: Sequence[tuple[str, str]] = (),
    max_bad: float = 0.5,
    id_col: str = "page_id",
    url_col: str = "url",
    **how,
) -> DataFrame:
    """One row per page: id, host, path, rule, verdict, bad_low (the bound; null where a rule decides).

    ``labels`` has (page_id, bad 0/1), or is None: then nothing is known but the rules.
    """
    url = F.col(url_col)
    p = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    if labels is None:
        hosts = p.groupBy("host").agg(F.lit(0).alias("n"), F.lit(0).alias("bad"))
    else:
        good = labels.select("page_id", "bad").filter("bad IS NOT NULL AND page_id IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
        hosts = p.select("page_id", "host").join(good, "page_id", "left").groupBy("host").agg(F.count("bad").alias("n"), F.sum("bad").alias("bad"))
    reputation = host_reputation(hosts, **how)
    small = F.broadcast(reputation) if reputation.count() <= BROADCAST_HOSTS else reputation
    if len(rules) <= INLINE_RULES:
        matched = _matched(p, rules)
    else:
        matched = match_rule_table(p, pages.sparkSession.createDataFrame([(r, v) for r, _, _, v in parse_rules(rules)], "rule string, verdict string"))
    judged = matched.join(small, "host")
    verdict = F.coalesce("rule_verdict", F.when(F.col("low") > max_bad, "block").otherwise("allow"))
    return judged.select(
        F.col("page_id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"),
        F.when(F.col("rule").isNull(), F.round("low", 6)).alias("bad_low"),
    )
