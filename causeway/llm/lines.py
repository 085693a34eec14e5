"""Line dedup by site-relative frequency, in DataFrame functions only.

Pages are grouped by host. A line's frequency is the number of pages of the host that hold it, over all pages of that
host; lines whose frequency exceeds ``ratio``, on at least ``least_pages`` pages, are boilerplate and are dropped from
every page of the host. Lines are compared after trimming spaces; blank lines are never dropped.

Counting moves a 128-bit fingerprint for each line of each page, summed within tasks first. At most (lines per page /
ratio) lines of a host can exceed the ratio, so a host's boilerplate is a short array. Those arrays meet the pages by
broadcast where their written size is under ``spark.sql.autoBroadcastJoinThreshold``, else by a join on host and a salt,
so that a host with a large part of all pages is spread.

A group of copies of one page that exceeds the ratio would make boilerplate of all its own lines and lose every text.
With ``copies`` (a share, say 0.8), pages count once for each text, and pages of which at least that share, in
characters, are lines that many pages hold count once for the most common of these lines, however many there are. As
that lowers a host's number of pages, more lines may exceed the ratio: this is repeated until the numbers stay.

Cases: a null text stays null, with no lines; a null host is a host of its own; a page listed twice counts twice, or
once with ``copies``; very long texts are split whole; an empty table stays empty; other columns are kept whatever their
names, but for ``n_lines`` and ``n_removed``, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causeway.llm.common import broadcast_limit, written

SALTS = 32


def fingerprint(line: Column) -> Column:
    """128 bits of a trimmed line, as text that equals only for equal bytes."""
    return F.unhex(F.md5(F.encode(line, "UTF-8")))


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def exceeding(counted: DataFrame, total: DataFrame, ratio: float, least_pages: int) -> DataFrame:
    """The lines of ``counted`` (bp_host, print, on_pages) that exceed the ratio of the host's ``pages``."""
    # hosts are few against lines; the null-safe equality keeps the null host
    joined = counted.where(F.col("on_pages") >= least_pages).join(
        total.withColumnRenamed("bp_host", "total_host"), F.col("bp_host").eqNullSafe(F.col("total_host"))
    )
    return joined.where(F.col("on_pages") > F.lit(ratio) * F.col("pages"))


def by_host(found: DataFrame) -> DataFrame:
    return found.groupBy("bp_host").agg(F.array_sort(F.collect_list("print")).alias("bp_lines"))


def with_lines(pages: DataFrame, found: DataFrame, text: str, host: str) -> DataFrame:
    """``pages`` with the columns of ``found``, one row of which stands for each host that has boilerplate."""
    size = found.agg(F.coalesce(F.sum(F.size("bp_lines") * 32 + 64), F.lit(0))).first()[0]
    if size <= broadcast_limit(pages.sparkSession):
        return pages.join(F.broadcast(found), F.col(host).eqNullSafe(F.col("bp_host")), "left")
    salt = F.pmod(F.xxhash64(text), F.lit(SALTS)).cast("int")
    dealt = found.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("bp_salt"))
    return pages.join(dealt, F.col(host).eqNullSafe(F.col("bp_host")) & (salt == F.col("bp_salt")), "left")


def keyed(site: DataFrame, found: DataFrame, copies: float) -> DataFrame:
    """bp_host, key and hits (those of its lines that are in ``found``) of each page; pages with equal keys count once."""
    page = with_lines(site.withColumnRenamed("bp_host", "page_host"), found, "bp_text", "page_host")
    trimmed = F.filter(F.array_distinct(F.transform(split_lines(F.col("bp_text")), lambda x: F.trim(x))), lambda x: x != "")
    lines = F.transform(trimmed, lambda x: F.struct(fingerprint(x).alias("print"), F.length(x).alias("n")))
    known = F.coalesce("bp_lines", F.array().cast("array<binary>"))
    sum_of = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda t, x: t + x.n)
    page = page.withColumn("lines", lines).withColumn("hit", F.filter("lines", lambda x: F.array_contains(known, x["print"])))
    page = page.withColumn("hits", F.transform("hit", lambda x: x["print"]))
    alike = (F.size("hits") > 0) & (sum_of(F.col("hit")) >= F.lit(copies) * sum_of(F.col("lines")))
    top = F.element_at(F.filter("bp_order", lambda x: F.array_contains(F.col("hits"), x)), 1)
    own = F.unhex(F.sha2(F.encode("bp_text", "UTF-8"), 256))
    return page.select(F.col("page_host").alias("bp_host"), F.when(alike, top).otherwise(own).alias("key"), "hits")


def boilerplate(pages: DataFrame, text: str, host: str, ratio: float, least_pages: int, copies: float | None = None) -> DataFrame:
    """bp_host and bp_lines: for each host, the fingerprints of its boilerplate lines, sorted."""
    site = pages.select(F.col(host).alias("bp_host"), F.col(text).alias("bp_text"))
    total = site.groupBy("bp_host").agg(F.count("*").alias("pages"))
    trimmed = F.transform(split_lines(F.col("bp_text")), lambda x: F.trim(x))
    seen = site.select("bp_host", F.explode(F.array_distinct(trimmed)).alias("line")).where("line <> ''")
    counted = seen.groupBy("bp_host", fingerprint(F.col("line")).alias("print")).agg(F.count("*").alias("on_pages"))
    if copies is None:
        return by_host(exceeding(counted, total, ratio, least_pages))
    counted = written(counted.where(F.col("on_pages") >= least_pages), "often")
    total, before = written(total, "pages"), None
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("on_pages")).alias("loss"), "print")))
    while True:
        # numbers of pages only fall, so each round's lines hold those of the round before
        over = exceeding(counted, total, ratio, least_pages).groupBy("bp_host").agg(ordered.alias("o"))
        over = over.select("bp_host", F.array_sort("o.print").alias("bp_lines"), F.col("o.print").alias("bp_order"))
        page = keyed(site, written(over, "often"), copies)
        total = written(page.groupBy("bp_host", "key").count().groupBy("bp_host").agg(F.count("*").alias("pages")), "pages")
        now = total.agg(F.sum("pages")).first()[0]
        if now == before:
            break
        before = now
    once = page.select("bp_host", "key", F.explode("hits").alias("print")).distinct()
    return by_host(exceeding(once.groupBy("bp_host", "print").agg(F.count("*").alias("on_pages")), total, ratio, least_pages))


def line_dedup(
    pages: DataFrame, text: str = "text", host: str = "source", ratio: float = 0.05, least_pages: int = 3, copies: float | None = None
) -> DataFrame:
    """``pages`` with boilerplate lines dropped from ``text``; adds n_lines and n_removed."""
    names = [c for c in pages.columns if c not in ("n_lines", "n_removed")]
    held = pages.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])  # no name of the input can clash
    text, host = (f"c{names.index(c)}" for c in (text, host))
    found = written(boilerplate(held, text, host, ratio, least_pages, copies), "boilerplate")
    joined = with_lines(held, found, text, host)
    lines = split_lines(F.col(text))
    keep = lambda x: ~F.array_contains(F.col("bp_lines"), fingerprint(F.trim(x)))
    kept = F.when(F.col("bp_lines").isNull() | F.col(text).isNull(), lines).otherwise(F.filter(lines, keep))
    out = (
        joined.withColumn("bp_kept", kept)
        .withColumn("n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("n_removed", F.col("n_lines") - F.coalesce(F.size("bp_kept"), F.lit(0)))
        .withColumn(text, F.array_join("bp_kept", "\n"))
    )
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "n_lines", "n_removed")
