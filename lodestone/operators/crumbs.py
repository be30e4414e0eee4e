"""Links that lead off a page's host, their tallies, and what was decided about each host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HREF = r"""(?i)<a\s[^>]*?(?<![\w-])href=["']([^"'>]*)["']"""
CARRIERS, LISTED = 10, 25


def host_of(url: Column) -> Column:
    """Host of an absolute http(s) address, lower case; empty for anything else."""
    return F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def unescaped(text: Column) -> Column:
    # The references that are decoded, in this order.
    for reference, plain in (("&amp;", "&"), ("&#38;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#039;", "'"), ("&apos;", "'")):
        text = F.replace(text, F.lit(reference), F.lit(plain))
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def absolute(href: Column, page: Column) -> Column:
    """The http(s) address of a link that names a host, scheme and host in lower case, a bare host ended by /.

    Null for every other link: without a host it stays on its page's host.
    """
    scheme = F.lower(F.regexp_extract(page, r"(?i)^(https?):", 1))
    full = F.when(href.startswith("//"), F.concat(scheme, F.lit(":"), href)).otherwise(href)
    origin = F.regexp_extract(full, r"(?i)^(https?://[^/?#]+)", 1)
    rest = F.substring(full, F.length(origin) + 1, F.length(full))
    return F.when(origin != "", F.concat(F.lower(origin), F.when(rest.startswith("/"), F.lit("")).otherwise(F.lit("/")), rest))


def crumb_rows(pages: DataFrame, *by: str) -> DataFrame:
    """url, host, links, example for each page and each foreign host it links to; a page with none has one row with null host.

    A null html is a page without links. Pages of one address count together; ``by`` names columns (not null) that tell them apart.
    """
    links = pages.select("url", *by, F.explode_outer(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), 1)).alias("href"))
    to = links.withColumn("to", absolute(unescaped(F.col("href")), F.col("url"))).withColumn("host", host_of(F.col("to")))
    foreign = to.select("url", *by, F.when((F.col("host") != "") & (F.col("host") != host_of(F.col("url"))), F.struct("host", "to")).alias("f"))
    return _by_host(foreign.groupBy("url", *by, "f.host").agg(F.count("f").alias("links"), F.min("f.to").alias("example")), *by)


def _by_host(found: DataFrame, *by: str) -> DataFrame:
    """Rows of hosts, and one with a null host for each page that has no other."""
    marked = F.max(F.when(F.col("host").isNotNull(), F.lit(1)))
    lone = found.groupBy("url", *by).agg(marked.alias("any")).where("any is null").select("url", *by)
    return found.where("host is not null").unionByName(lone.select("url", *by, F.lit(None).cast("string").alias("host"), F.lit(0).cast("long").alias("links"), F.lit(None).cast("string").alias("example")))


def tally(rows: DataFrame, most: int = CARRIERS) -> DataFrame:
    """host, links, pages, example, carriers, dropped over all pages: the smallest page addresses are listed, the rest counted.

    Pages are ranked, and cut to the limit, before they are gathered, so a host that all pages link to gathers no more than another.
    """
    known = rows.where("host is not null")
    totals = known.groupBy("host").agg(F.sum("links").alias("links"), F.count("url").alias("pages"), F.min("example").alias("example"))
    order = Window.partitionBy("host").orderBy("url")
    first = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    carriers = first.groupBy("host").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("carriers"))
    return totals.join(carriers, "host").withColumn("dropped", F.greatest(F.col("pages") - most, F.lit(0).cast("long")))


def decisions_current(decisions: DataFrame) -> DataFrame:
    """The newest ruling of each host; of equal times the later line. `allow` reopens a host, so it leaves no ruling."""
    last = decisions.groupBy("host").agg(F.max_by(F.struct("ruling", "at"), F.struct("at", "seq")).alias("r"))
    return last.select("host", "r.ruling", "r.at").where("ruling <> 'allow'")


def standing(tallied: DataFrame, promoted: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each host with its standing: promoted (a source of its own) before ignored before open."""
    ruled = decisions_current(decisions).select("host", "ruling")
    known = promoted.select("host", F.lit(True).alias("own")).distinct()
    word = F.when(F.col("own"), "promoted").when(F.col("ruling") == "ignore", "ignored").otherwise("open")
    return tallied.join(known, "host", "left").join(ruled, "host", "left").withColumn("standing", word).drop("own", "ruling")


def listed(standings: DataFrame, everything: bool = False, most: int = LISTED) -> DataFrame:
    """The listing: most links first, then by host; ignored hosts only on demand."""
    shown = standings if everything else standings.where("standing <> 'ignored'")
    return shown.orderBy(F.desc("links"), "host").limit(most)


def short_sha(blob_sha: Column) -> Column:
    return F.substring(blob_sha, 1, 12)


def append_ledger(rows: DataFrame, folder: str) -> None:
    """Adds scanned pages' crumbs (source, short, url, host, links, example) to the ledger, a folder for each source."""
    rows.write.mode("append").partitionBy("source").parquet(folder)


def rewrite_ledger(rows: DataFrame, folder: str) -> None:
    """Replaces the ledger of the sources that ``rows`` holds; the others' folders stay as they are."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(folder)


def with_ledger(pages: DataFrame, ledger: DataFrame) -> DataFrame:
    """The crumbs of pages (url, html, blob_sha): recorded ones from the ledger by address and the blob's short hash, the others scanned.

    Only the names of the ledger meet the pages; bodies that are recorded aren't read again. Pages of one address count
    together, whichever of them are recorded.
    """
    key = ["short", "url"]
    keyed = pages.withColumn("short", short_sha(F.col("blob_sha")))
    missing = keyed.join(ledger.select(*key).distinct(), key, "left_anti")
    # Pages alike are counted before they meet the ledger, so an address that comes very often multiplies nothing.
    times = keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("times"))
    lines = ledger.select(*key, "host", "links", "example").dropDuplicates([*key, "host"])
    recorded = times.join(lines, key).select("url", "host", (F.col("links") * F.col("times")).alias("links"), "example")
    found = recorded.unionByName(crumb_rows(missing).select("url", "host", "links", "example"))
    return _by_host(found.groupBy("url", "host").agg(F.sum("links").alias("links"), F.min("example").alias("example")))
