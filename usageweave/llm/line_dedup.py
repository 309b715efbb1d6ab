"""Line dedup by site-relative frequency.

A line that stands on more than a given share of a site's pages is boilerplate there and
goes from all of them; the same line on another site is judged by that site's pages.
Lines travel as digests, summed by site and line before they are shuffled; what comes back
to the pages is one list for each site, of at most (mean lines a page / share) digests.
Built-in functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usageweave.llm.shared import stored


@dataclass(frozen=True)
class LineOptions:
    #: Lines on more than this share of a site's pages are boilerplate.
    max_share: float = 0.1
    #: Sites with fewer pages are left alone.
    min_pages: int = 10
    #: Whether each copy of a page counts as a page. If not, equal pages count once, and
    #: pages made of other pages' lines (near copies) do not say what boilerplate is.
    count_copies: bool = True
    #: Without copies: largest part of a near copy (in characters) that is its own. Two
    #: pages that have all but a ninth in common have a similarity of 0.8.
    own_part: float = 1 / 9


def _has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line))


#: Words at either end of a line by which a changed copy of it is known.
_END_WORDS = 5


def _ends(line: Column) -> tuple[Column, Column]:
    """Hashes of the first and of the last words of a line."""
    line = F.trim(line)
    return tuple(F.hash(F.substring_index(line, " ", n)) for n in (_END_WORDS, -_END_WORDS))


def _often(found: Column, pages: Column, options: LineOptions) -> Column:
    return (found > options.max_share * pages) & (pages >= options.min_pages)


def boilerplate(
    pages: DataFrame, site: Column, lines: Column, options: LineOptions = LineOptions()
) -> DataFrame:
    """(of_site, digests): the boilerplate lines of each site that has any."""
    rows = pages.select(site.alias("of_site"), lines.alias("lines"))
    kept = F.filter(F.array_distinct(F.coalesce("lines", F.array())), _has_word)
    if not options.count_copies:
        return _boilerplate_without_copies(rows, kept, options)
    totals = rows.groupBy("of_site").agg(F.count("*").alias("pages"))
    each = (
        rows.select("of_site", F.explode(F.transform(kept, _digest)).alias("digest"))
        .groupBy("of_site", "digest")
        .agg(F.count("*").alias("found"))
        # One line of one page can be boilerplate only on sites that are left alone.
        .where("found > 1")
        .withColumnRenamed("of_site", "site")
    )
    return (
        each.join(totals, F.expr("site <=> of_site"))
        .where(_often(F.col("found"), F.col("pages"), options))
        .groupBy("of_site")
        .agg(F.collect_list("digest").alias("digests"))
    )


def _boilerplate_without_copies(rows: DataFrame, kept: Column, options: LineOptions) -> DataFrame:
    """As :func:`boilerplate`, with equal pages counted once and near copies not at all.

    Lines are counted over different pages first. A page that is, but for ``own_part``,
    made of lines found often then, or of lines that begin or end like one, is a near
    copy; its votes and itself are taken off the counts, and lines are judged again.
    """
    page = F.xxhash64(F.array_join("lines", "\n"), F.size("lines")).alias("page")
    line = F.col("line")
    totals = (
        rows.select("of_site", page).distinct().groupBy("of_site").agg(F.count("*").alias("pages"))
    )
    totals = stored(totals, "line-pages")
    # Pages are made different by line, so that no text is shuffled for it.
    each = (
        rows.select("of_site", page, F.explode(kept).alias("line"))
        .select("of_site", "page", _digest(line).alias("digest"), F.array(*_ends(line)).alias("ends"))
        .distinct()
        .groupBy("of_site", "digest", "ends")
        .agg(F.count("*").alias("found"))
        .where("found > 1")
        .withColumnRenamed("of_site", "site")
    )
    each = stored(each, "line-counts")
    first = (
        each.join(totals, F.expr("site <=> of_site"))
        .where(_often(F.col("found"), F.col("pages"), options))
        .groupBy("site")
        .agg(
            F.collect_list("digest").alias("digests"),
            F.collect_set(F.col("ends")[0]).alias("firsts"),
            F.collect_set(F.col("ends")[1]).alias("lasts"),
        )
    )

    def shared(x: Column) -> Column:
        begin, end = _ends(x)
        return (
            F.array_contains("digests", _digest(x))
            | F.array_contains("firsts", begin)
            | F.array_contains("lasts", end)
        )

    def chars(of: Column) -> Column:
        return F.aggregate(of, F.lit(0).cast("long"), lambda a, x: a + F.length(x))

    worded = F.filter("lines", _has_word)
    copies = (
        rows.join(stored(first, "line-often"), F.expr("of_site <=> site"))
        .where(chars(F.filter(worded, lambda x: ~shared(x))) <= options.own_part * chars(worded))
        .where(chars(worded) > 0)
        .select("of_site", page, F.explode(F.transform(kept, _digest)).alias("digest"))
        .distinct()
    )
    copies = stored(copies, "line-copies")
    of_site, of_digest = F.col("of_site").alias("c_site"), F.col("digest").alias("c_digest")
    fewer = (
        copies.select("of_site", "page").distinct().groupBy(of_site).agg(F.count("*").alias("less"))
    )
    votes = copies.groupBy(of_site, of_digest).agg(F.count("*").alias("votes"))
    totals = totals.join(fewer, F.expr("of_site <=> c_site"), "left").select(
        "of_site", F.expr("pages - coalesce(less, 0)").alias("pages")
    )
    found = each.join(votes, F.expr("site <=> c_site AND digest = c_digest"), "left").select(
        "site", "digest", F.expr("found - coalesce(votes, 0)").alias("found")
    )
    return (
        found.where("found > 1")
        .join(totals, F.expr("site <=> of_site"))
        .where(_often(F.col("found"), F.col("pages"), options))
        .groupBy("of_site")
        .agg(F.collect_list("digest").alias("digests"))
    )


def drop_boilerplate(
    pages: DataFrame, site: Column, lines: Column, options: LineOptions = LineOptions()
) -> DataFrame:
    """``pages`` with ``line_dedup``: ``n_lines``, ``n_dropped`` and the lines ``kept``.

    ``lines`` is an array of the page's lines in order. A line counts once for each page.
    Lines without a word are neither judged nor dropped; null and empty pages keep an
    empty list, a null site is a site of its own, repeated rows are pages of their own
    unless ``count_copies`` is off.
    Every row comes back with all its columns; one named ``line_dedup`` is replaced.
    """
    found = stored(boilerplate(pages, site, lines, options), "boilerplate")
    row = F.struct(*[F.col(c) for c in pages.columns])
    df = pages.select(
        row.alias("_row"),
        site.alias("_site"),
        F.coalesce(lines, F.array().cast("array<string>")).alias("_lines"),
    ).join(found, F.expr("_site <=> of_site"), "left")
    kept = F.filter(
        "_lines",
        lambda x: ~(_has_word(x) & F.array_contains(F.col("digests"), _digest(x))),
    )
    df = df.withColumn("kept", F.when(F.col("digests").isNull(), F.col("_lines")).otherwise(kept))
    n_lines, n_kept = F.size("_lines").cast("long"), F.size("kept").cast("long")
    result = F.struct(n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"), "kept")
    columns = [F.col("_row")[c].alias(c) for c in pages.columns if c != "line_dedup"]
    return df.select(*columns, result.alias("line_dedup"))


def text_lines(text: Column) -> Column:
    """Lines of a plain text; none for null."""
    return F.split(text, "\n", -1)


#: Tags that begin or end a line of a page as it is shown.
BLOCKS = (
    "p|div|li|ul|ol|dl|dt|dd|nav|article|section|main|aside|footer|header|h[1-6]|br|hr|title"
    "|table|tr|td|th|pre|form|blockquote|body|head|html"
)
#: A block-level tag in either case, with or without attributes or a slash at its end.
BLOCK_TAG = rf"(?i)</?(?:{BLOCKS})(?:[\x09-\x0D\x20/][^>]*)?>"


def html_lines(html: Column) -> Column:
    """A page's source cut into lines at line breaks and around block-level tags."""
    return F.split(F.regexp_replace(html, BLOCK_TAG, "\n"), "\n", -1)
