"""Line deduplication by site-relative frequency, in DataFrame functions only.

A page is a row, its site the given column (a source, or the host of a URL). For each site the pages
that contain a line are divided by the site's pages; a line above ``ratio`` that stands on at least
``min_pages`` pages is boilerplate there and goes from every page of that site.

A line is what stands between line feeds, compared exactly, by its md5. Lines of spaces alone are
neither counted nor dropped. At most (lines of a page / ratio) lines can be boilerplate in one site, so
a site's list is bounded however many pages it has. The lists are broadcast only if their measured
number is below ``broadcast_lines``; beyond it pages and lists meet in a join salted over the site.

Defined results: a null text has no lines and stays null; an empty text stays empty; a null site is a
site of its own; a page that loses every line becomes the empty text; repeated rows count as pages of
their own; a line that repeats within a page counts once and all its repeats go; a line on exactly ``ratio`` of the
pages stays; extra columns are passed through, those named like the counts are replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import fresh, require
from tidewatch.session import cut

RATIO = 0.05
MIN_PAGES = 3
#: Boilerplate lines up to which the lists are broadcast: 2 MB of keys.
BROADCAST_LINES = 50_000
#: Parts of a site in the join beyond that.
SALTS = 64


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def text_of(html: Column) -> Column:
    """What stands between the tags of a page, each on a line of its own; scripts, styles and comments go."""
    for part in (r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>", r"(?s)<!--.*?-->"):
        html = F.regexp_replace(html, part, "")
    return F.regexp_replace(html, r"<[^>]*>", "\n")


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def boilerplate(df: DataFrame, *, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, line_key binary, pages long, site_pages long): the lines that go."""
    require(df, site_col, text_col)
    rows = df.select(F.col(f"`{site_col}`").alias("site"), F.col(f"`{text_col}`").cast("string").alias("text"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _key))
    per = rows.select("site", F.explode(keys).alias("line_key")).groupBy("site", "line_key").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= min_pages)
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("site_pages"))
    met = _salted(per, F.col("line_key"), totals, "site")
    return met.where(F.col("pages") > F.col("site_pages") * F.lit(float(ratio))).select("site", "line_key", "pages", "site_pages")


def _salted(left: DataFrame, spread: Column, right: DataFrame, site_col: str) -> DataFrame:
    """left join right on the site, a large site dealt over ``SALTS`` parts. right: (site, ...), one row for each site."""
    salt, own, site = fresh(left, "salt", "own_salt", "salted_site")
    right = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("site", site)
    left = left.withColumn(own, F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    on = F.col(f"`{site_col}`").eqNullSafe(F.col(site)) & (F.col(own) == F.col(salt))
    return left.join(right, on, "left").drop(salt, own, site)


def line_dedup(df: DataFrame, *, site_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, broadcast_lines: int = BROADCAST_LINES, spare_whole: bool = False, counts: bool = True) -> DataFrame:
    """The rows of ``df`` with boilerplate lines gone from the text, and with ``counts`` n_lines, n_dropped (both without blank lines) after its columns.

    With ``spare_whole``, a page that consists of such lines alone keeps them: it is a page with many
    copies, of which a later stage keeps one. With counts, ``spared`` boolean then marks such pages.
    """
    if min_pages < 2:
        raise ValueError("min_pages: 2 at least")
    if counts:
        df = df.drop("n_lines", "n_dropped", *(["spared"] if spare_whole else []))
    keys, left, site = fresh(df, "line_keys", "lines_left", "listed_site")
    text = F.col(f"`{text_col}`")
    lists = cut(boilerplate(df, site_col=site_col, text_col=text_col, ratio=ratio, min_pages=min_pages).groupBy("site").agg(F.collect_list("line_key").alias(keys)))
    if (lists.agg(F.sum(F.size(keys))).first()[0] or 0) <= broadcast_lines:
        right = F.broadcast(lists.withColumnRenamed("site", site))
        met = df.join(right, F.col(f"`{site_col}`").eqNullSafe(F.col(site)), "left").drop(site)
    else:
        met = _salted(df, text, lists, site_col)
    lines = _lines(text.cast("string"))
    solid = F.filter(lines, lambda x: F.trim(x) != "")
    kept = F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(keys), _key(x)))
    listed = has = F.col(keys).isNotNull()
    if spare_whole:
        has = has & F.exists(solid, lambda x: ~F.array_contains(F.col(keys), _key(x)))
    out = met.withColumn(left, F.when(has, kept).otherwise(lines))
    columns = [F.array_join(left, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if counts:
        columns += [F.coalesce(F.size(solid), F.lit(0)).cast("long").alias("n_lines"), (F.coalesce(F.size(lines), F.lit(0)) - F.coalesce(F.size(left), F.lit(0))).cast("long").alias("n_dropped")]
        if spare_whole:
            columns.append(F.coalesce(listed & (F.size(solid) > 0) & ~has, F.lit(False)).alias("spared"))
    return out.select(*columns)
