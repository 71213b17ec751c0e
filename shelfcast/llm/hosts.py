"""URL filters: a short rule list, and empirical-Bayes reputations of hosts where no rule speaks.

A page's outcome is bad if its document is labelled toxic or of low quality. Outcomes are counted per host, and a host's
bad rate is shrunk by beta-binomial priors: the corpus rate is the prior of a suffix (``com``), the suffix's posterior mean
that of a registered domain (``example.com``), the domain's that of a host. How much a level's members differ
(their intra-class correlation) is estimated from all outcomes by moments and sets the prior's weight. A host
is blocked if the lower posterior bound of its bad rate is above ``most_bad``.

Null URLs and those without ``://`` have an empty host and path, fit no rule and are judged by the corpus rate.
Repeated pages are judged alike and count once each; a document labelled more than once is bad if one label says so. Without labels no host is blocked.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import join_by_group, written

# The rules of the contract, as (verdict, host, path).
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/")]


@dataclass(frozen=True)
class Reputation:
    """``z``: one-sided normal quantile of the bound. ``weight``: prior weight where no outcomes tell one; it stays within ``weights``."""

    most_bad: float = 0.5
    z: float = 1.645
    weight: float = 20.0
    weights: tuple[float, float] = (1.0, 10_000.0)
    long_suffixes: tuple[str, ...] = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def url_parts(url: Column) -> dict[str, Column]:
    """``host`` (A-Z in lower case) and ``path`` of a URL."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return {"host": F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "path": F.regexp_extract(after, "^[^?#]*", 0)}


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, null if none does: its host or a subdomain, and a path that starts as its own."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1:])):
        fits = ((host == name) | host.endswith(f".{name}")) & path.startswith(start)
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def host_levels(host: Column, long_suffixes: tuple[str, ...] = Reputation.long_suffixes) -> dict[str, Column]:
    """``domain`` (registered) and ``suffix`` of a host, without user, port and last dot; an IPv4 address is its own domain."""
    name = F.regexp_replace(F.regexp_replace(host, "^[^@]*@", ""), r"(:[0-9]*)?\z", "")
    name = F.regexp_replace(name, r"\.\z", "")
    last_two = F.substring_index(name, ".", -2)
    long = last_two.isin(*long_suffixes)
    ip = name.rlike(r"^[0-9]+(\.[0-9]+){3}\z")
    return {"domain": F.when(ip, name).when(long, F.substring_index(name, ".", -3)).otherwise(last_two),
            "suffix": F.when(ip, F.lit("")).when(long, last_two).otherwise(F.substring_index(name, ".", -1))}


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, host, path and ``document``: the number that the path's last part is, with or without an extension."""
    parts = url_parts(pages["url"])
    rows = pages.select(pages["page_id"].alias("page_id"), parts["host"].alias("host"), parts["path"].alias("path"))
    return rows.withColumn("document", F.regexp_extract("path", r"/([0-9]{1,18})(\.[a-z]+)?/?\z", 1).try_cast("long"))


def outcomes(labels: DataFrame) -> DataFrame:
    """One row per labelled document: (document, bad)."""
    bad = F.coalesce(F.col("toxic") == 1, F.lit(False)) | F.coalesce(F.col("quality") == 0, F.lit(False))
    return (labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("document"))
            .agg(F.max(bad.cast("long")).alias("bad")))


def counted_hosts(rows: DataFrame, told: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """Per host: pages, labelled ones (n) and bad ones among these (x). Pages of one host and document are added up before the join."""
    same = rows.groupBy("host", "document").agg(F.count(F.lit(1)).alias("pages"))
    labelled = (same.join(told, "document").groupBy("host")
                .agg(F.sum("pages").alias("n"), F.sum(F.col("bad") * F.col("pages")).alias("x")))
    return (rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).join(labelled, "host", "left")
            .select("host", "pages", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("x", F.lit(0)).alias("x"))
            .withColumns(host_levels(F.col("host"), p.long_suffixes)))


def spread_between(members: DataFrame, group: list[str]) -> DataFrame:
    """One row, ``above`` and ``per_rho``: their ratio is the correlation of outcomes within a member, pooled over groups.

    With rates p of groups, S = sum x^2/n - X^2/N has the mean p (1 - p) (k - 1 + rho (N - sum n^2/N - k + 1)).
    """
    sums = (members.where("n > 0").groupBy(*group)
            .agg(F.sum("n").alias("all_n"), F.sum("x").alias("all_x"), F.count(F.lit(1)).alias("k"),
                 F.sum(F.col("x") * F.col("x") / F.col("n")).alias("squares"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2")))
    rate = F.col("all_x") / F.col("all_n")
    chance = rate * (1 - rate)
    return sums.agg(F.sum(F.col("squares") - F.col("all_x") * rate - chance * (F.col("k") - 1)).alias("above"),
                    F.sum(chance * (F.col("all_n") - F.col("n2") / F.col("all_n") - F.col("k") + 1)).alias("per_rho"))


def prior_weight(row: dict, p: Reputation) -> float:
    """Outcomes that a prior counts for: 1 / rho - 1, within ``weights``."""
    if not row["per_rho"] or row["per_rho"] <= 0:
        return p.weight
    rho = row["above"] / row["per_rho"]
    return min(max(1 / rho - 1, p.weights[0]), p.weights[1]) if rho > 0 else p.weights[1]


def digamma(x: Column) -> Column:
    y = x + 6
    shifted = sum((1 / (x + k) for k in range(1, 6)), 1 / x)
    return F.ln(y) - 1 / (2 * y) - 1 / (12 * y * y) + 1 / (120 * y * y * y * y) - shifted


def trigamma(x: Column) -> Column:
    y = x + 6
    shifted = sum((1 / ((x + k) * (x + k)) for k in range(1, 6)), 1 / (x * x))
    return 1 / y + 1 / (2 * y * y) + 1 / (6 * y * y * y) - 1 / (30 * y * y * y * y * y) + shifted


def lower_bound(a: Column, b: Column, z: float) -> Column:
    """Lower bound of a beta variable, from the mean and variance of its logit; lower than the quantile where a or b is small."""
    low = digamma(a) - digamma(b) - z * F.sqrt(trigamma(a) + trigamma(b))
    return 1 / (1 + F.exp(-low))


def reputations(hosts: DataFrame, p: Reputation = Reputation()) -> DataFrame:
    """``hosts`` with ``a``, ``b`` (the posterior), ``bound`` and ``blocked``. Only one row a level reaches the driver."""
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    suffixes = domains.groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    total = suffixes.agg(F.sum("n").alias("n"), F.sum("x").alias("x")).first()
    corpus = ((total["x"] or 0) + 0.5) / ((total["n"] or 0) + 1)
    w = [prior_weight(spread_between(members, group).first().asDict(), p)
         for members, group in ((suffixes, []), (domains, ["suffix"]), (hosts, ["suffix", "domain"]))]
    by_suffix = suffixes.select("suffix", ((F.col("x") + w[0] * corpus) / (F.col("n") + w[0])).alias("of_suffix"))
    by_domain = (domains.join(by_suffix, "suffix")
                 .select("suffix", "domain", ((F.col("x") + w[1] * F.col("of_suffix")) / (F.col("n") + w[1])).alias("of_domain")))
    out = hosts.join(by_domain, ["suffix", "domain"])
    out = out.withColumns({"a": F.col("x") + w[2] * F.col("of_domain"), "b": F.col("n") - F.col("x") + w[2] * (1 - F.col("of_domain"))})
    out = out.withColumn("bound", lower_bound(F.col("a"), F.col("b"), p.z)).drop("of_domain")
    return out.withColumn("blocked", F.col("bound") > p.most_bad)


def judged(pages: DataFrame, labels: DataFrame, p: Reputation = Reputation(), rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and its host's ``bound``."""
    rows = parsed(pages)
    hosts = written(counted_hosts(rows, outcomes(labels), p), "hosts")
    known = written(reputations(hosts, p).select("host", "bound", "blocked", "pages"), "host-reputations")
    n_pages = hosts.agg(F.sum("pages")).first()[0] or 0
    found = longest_rule(F.col("host"), F.col("path"), rules)
    out = join_by_group(rows.drop("document"), known, "host", "pages", n_pages).withColumn("found", found)
    by_method = F.when(F.col("blocked"), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("found.rule").alias("rule"),
                      F.coalesce("found.verdict", by_method).alias("verdict"), "bound")


def url_digest(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return judged(pages, labels).select("page_id", "host", "path", "rule", "verdict")
