"""URL filters over time: every capture against the list entries active when it was fetched.

Dated entries of a domain (block or allow) become validity intervals, each ending where the next begins. A
capture is joined on its host and the host's parent domains, and its fetch day picks the one interval of
each domain; the most specific domain with an active entry decides.

Defined cases: a null or hostless address and a null day match nothing; entries with a null domain or day are
ignored; of entries of one domain and day, `block` wins; ports, users and a closing dot are no part of a host; addresses match themselves only; repeated
captures are judged each; an address or list of any length is matched whole; empty tables give
no matches or no rows; only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST_DAY = "2024-01-01"


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"
ADDRESS = r"^(\[.*\]|[0-9]{1,3}(\.[0-9]{1,3}){3})$"


def host_of(url: Column) -> Column:
    """The lower-cased host without a closing dot; an IPv6 address keeps its brackets."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.+$", ""), F.lit(""))


def domains_of(host: Column) -> Column:
    """The host and its parents of at least two labels, most specific first; an address has no parents."""
    labels = F.when(F.regexp_like(host, F.lit(ADDRESS)), F.array(host)).otherwise(F.split(host, r"\."))
    starts = F.when(F.size(labels) >= 2, F.sequence(F.lit(1), F.size(labels) - 1)).otherwise(F.array(F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(domain, valid_from, valid_to, action); valid_to is null while the entry still holds."""
    dated = entries.filter("domain is not null and day is not null").groupBy("domain", "day").agg(F.max("action").alias("action"))
    follows = F.lead("day").over(Window.partitionBy("domain").orderBy("day"))
    return dated.select("domain", F.col("day").alias("valid_from"), follows.alias("valid_to"), "action")


def judged(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """Per capture: key, host, day, blocked, list_domain and list_day (of the deciding entry).

    The join is an equi join on the domain with the interval as condition; intervals of a domain are disjoint,
    so a capture meets at most one per domain and a hot host may be split freely. Nothing is gathered by host:
    the deciding entry is a minimum by capture.
    """
    active = intervals(entries)
    base = captures.select(F.col(key), host_of(F.col("url")).alias("host"), F.col("day").cast("date").alias("day")).distinct()
    wide = base.select("*", F.posexplode(domains_of("host")).alias("rank", "domain"))
    during = (F.col("day") >= F.col("valid_from")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    met = wide.join(active, (wide.domain == active.domain) & during).select(key, "host", "day", F.struct("rank", active.domain, "valid_from", "action").alias("x"))
    found = met.groupBy(key, "host", "day").agg(F.min("x").alias("x"))
    mine = captures.select(F.col(key), host_of(F.col("url")).alias("host"), F.col("day").cast("date").alias("day"))
    f = found.select(F.col(key).alias("_k"), F.col("host").alias("_h"), F.col("day").alias("_d"), "x")
    same = F.col(key).eqNullSafe(F.col("_k")) & (F.col("host") == F.col("_h")) & (F.col("day") == F.col("_d"))
    return mine.join(f, same, "left").select(
        key, "host", "day", F.coalesce(F.col("x.action") == "block", F.lit(False)).alias("blocked"),
        F.col("x.domain").alias("list_domain"), F.col("x.valid_from").alias("list_day"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, day): the fetch day follows from the page's number."""
    return pages.select("page_id", "url", F.date_add(F.lit(FIRST_DAY).cast("date"), (F.col("page_id") % 366).cast("int")).alias("day"))


def entries_of(pages: DataFrame) -> DataFrame:
    """A dated list over the domains of the pages: some blocked, some freed again, some blocked anew."""
    domains = pages.select(F.explode(domains_of(host_of(F.col("url")))).alias("domain")).filter("domain is not null").distinct()
    number = F.conv(F.substring(F.md5("domain"), 1, 6), 16, 10).cast("long")
    start = (number % 200).cast("int")
    plans = F.when(number % 7 < 2, F.array(F.struct(start.alias("at"), F.lit("block").alias("action")))).when(
        number % 7 == 2,
        F.array(*[F.struct((start + d).alias("at"), F.lit(a).alias("action")) for d, a in ((0, "block"), (30, "allow"), (60, "block"))]),
    ).when(number % 7 == 3, F.array(*[F.struct((start + d).alias("at"), F.lit(a).alias("action")) for d, a in ((0, "block"), (90, "allow"))]))
    return domains.select("domain", F.inline(plans)).select("domain", F.date_add(F.lit(FIRST_DAY).cast("date"), F.col("at")).alias("day"), "action")
