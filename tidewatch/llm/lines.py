"""Line dedup by site-relative frequency: a line that many pages of one host carry is boilerplate.

For each host the pages that contain a line are divided by all its pages; lines above a ratio are
dropped from that host's pages. Lines are compared without surrounding spaces, by their MD5.
Long lines can have a rule of their own: a passage repeated on a few pages is a copy, so a far
smaller share is enough, and one page keeps it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import BROADCAST_ROWS, maybe_broadcast, pin, stored

MAX_RATIO = 0.05
MIN_PAGES = 5
#: Lines of more words than this are passages; the share of a host's pages above which one is a copy.
LONG_WORDS, LONG_RATIO = 50, 0.001
#: Pages of a host are dealt over so many joins' keys where the boilerplate is too large to broadcast.
SALTS = 64


def _is_long(line: Column, words: int) -> Column:
    """Whether a line has more than so many words; only lines that can have them are cut into words."""
    return F.when(F.length(line) > 2 * words, F.regexp_count(line, F.lit(r"[^\x20\x09-\x0D]+")) > words).otherwise(False)


def _hashes(lines: str, long_words: int | None = None) -> Column:
    """One MD5 a line, null for a blank line and, if long_words is given, for a longer one."""
    short = (lambda x: F.lit(True)) if long_words is None else (lambda x: ~_is_long(x, long_words))
    return F.transform(lines, lambda x: F.when((F.trim(x) != "") & short(x), F.md5(F.trim(x))))


def boilerplate(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    long_words: int | None = None,
) -> DataFrame:
    """(host, line): the MD5 of every line on more than max_ratio of a host's pages, min_pages at least.

    Every row is a page, so repeated rows count each time; a line counts once a page. Counts are
    pre-aggregated where the pages lie. A host has at most (distinct lines a page) / max_ratio such
    lines, however many pages it has. Null hosts have none; blank lines are never boilerplate, nor
    are lines of more than long_words words if that is given.
    """
    rows = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).filter("host is not null")
    lines = F.array_compact(F.array_distinct(_hashes("lines", long_words)))
    marks = pin(rows, lines=F.split(F.coalesce("text", F.lit("")), "\n")).select(
        "host", F.explode(F.concat(lines, F.array(F.lit("")))).alias("line")
    )  # the mark "" stands for the page itself
    counts = stored(marks.groupBy("host", "line").agg(F.count("*").alias("pages")).filter(
        (F.col("line") == "") | (F.col("pages") >= min_pages)
    ), "line-counts")
    totals = counts.filter("line = ''").select("host", F.col("pages").alias("total"))
    often = counts.filter("line <> ''").join(totals, "host")
    return often.filter(F.col("pages") > F.lit(float(max_ratio)) * F.col("total")).select("host", "line")


def _place(id_col: str, text: str) -> Column:
    """What orders the pages that share a passage: the id, null last, then the text."""
    return F.struct(
        F.col(f"`{id_col}`").isNull().alias("none"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(0).cast("long")).alias("id"),
        F.xxhash64(F.col(f"`{text}`")).alias("text"))


def copied_passages(
    docs: DataFrame, host: str = "source", text: str = "text", id_col: str = "doc_id", long_words: int = LONG_WORDS,
    long_ratio: float = LONG_RATIO,
) -> DataFrame:
    """(host, place, _copied): the MD5s of the passages that a page has to lose, for pages that lose any.

    A passage is a line of more than long_words words. One on two pages of a host at least, and on
    more than long_ratio of them, stays on the page with the smallest id only. Rows equal in id and
    text are one page there, though each counts. Passages travel as hashes, never the texts.
    """
    rows = docs.select(F.col(f"`{host}`").alias("host"), _place(id_col, text).alias("place"), F.col(f"`{text}`").alias("text"))
    rows = rows.filter("host is not null")
    long = F.filter("lines", lambda x: _is_long(x, long_words))
    marks = pin(rows, lines=F.split(F.coalesce("text", F.lit("")), "\n")).select(
        "host", "place", F.explode(F.array_distinct(F.transform(long, lambda x: F.md5(F.trim(x))))).alias("line"))
    marks = stored(marks, "passages")
    several = marks.groupBy("host", "line").agg(F.count("*").alias("pages"), F.min("place").alias("keeper")).filter("pages > 1")
    totals = rows.groupBy("host").agg(F.count("*").alias("total"))
    found = several.join(totals, "host").filter(F.col("pages") > F.lit(float(long_ratio)) * F.col("total"))
    found = stored(found.select("host", "line", "keeper"), "copied")
    lost = marks.join(maybe_broadcast(found), ["host", "line"]).filter("place <> keeper")
    return lost.groupBy("host", "place").agg(F.collect_set("line").alias("_copied"))


def drop_lines(
    docs: DataFrame, host: str = "source", text: str = "text", max_ratio: float = MAX_RATIO, min_pages: int = MIN_PAGES,
    long_words: int | None = None, long_ratio: float = LONG_RATIO, id_col: str = "doc_id",
) -> DataFrame:
    """docs with boilerplate lines taken out of text, and n_lines, n_dropped (long) added.

    All other lines, blank ones too, keep their order. A null text stays null with 0 lines; a row
    with a null host keeps its text. Columns of docs named n_lines or n_dropped are replaced; all
    others stay. Texts never move: each host's lines, a list of bounded length, come to the pages.

    If long_words is given, longer lines follow copied_passages instead; pages that lose any are
    found by id and text, and texts move only where those are too many to broadcast.
    """
    found = stored(boilerplate(docs, host, text, max_ratio, min_pages, long_words), "boilerplate")
    lists = found.groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("_bad"))
    rows = docs.drop("n_lines", "n_dropped", "_bad", "_copied")
    site = F.col(f"`{host}`")
    if long_words is not None:
        copied = stored(copied_passages(docs, host, text, id_col, long_words, long_ratio), "copies")
        copied = copied.withColumnsRenamed({"host": "_on", "place": "_at"})
        rows = rows.withColumn("_place", _place(id_col, text)).join(
            maybe_broadcast(copied), (F.col("_place") == F.col("_at")) & (site == F.col("_on")), "left").drop("_place", "_at", "_on")
    if found.count() <= BROADCAST_ROWS:
        rows = rows.join(F.broadcast(lists.withColumnRenamed("host", "_host")), site == F.col("_host"), "left")
    else:  # a host with a third of all pages goes to SALTS tasks, each with a copy of its list
        spread = lists.select(F.col("host").alias("_host"), "_bad", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        rows = rows.withColumn("_part", (F.rand(7) * SALTS).cast("int"))
        rows = rows.join(spread, (site == F.col("_host")) & (F.col("_part") == F.col("_salt")), "left").drop("_salt", "_part")
    rows = pin(rows.drop("_host"), _lines=F.split(F.col(f"`{text}`"), "\n"))
    hit = F.coalesce(F.array_intersect(_hashes("_lines"), F.col("_bad")), F.array().cast("array<string>"))
    if long_words is not None:
        hit = F.concat(hit, F.coalesce("_copied", F.array().cast("array<string>")))
    rows = pin(rows, _hit=hit)
    rows = pin(
        rows,
        _kept=F.when(F.size("_hit") == 0, F.col("_lines")).otherwise(
            F.filter("_lines", lambda x: ~F.array_contains("_hit", F.md5(F.trim(x))))
        ),
    )
    none = F.col("_lines").isNull()
    out = rows.withColumns(
        {
            text: F.array_join("_kept", "\n"),
            "n_lines": F.when(none, 0).otherwise(F.size("_lines")).cast("long"),
            "n_dropped": F.when(none, 0).otherwise(F.size("_lines") - F.size("_kept")).cast("long"),
        }
    )
    return out.drop("_bad", "_copied", "_lines", "_hit", "_kept")
