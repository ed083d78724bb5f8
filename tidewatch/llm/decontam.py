"""Benchmark decontamination: a prefix-filtered set join with exact containment over windows.

A benchmark window is a set of word shingles with their places. Shingles are ordered by how rare
they are in the corpus; since the whole window has to occur, its rarest shingle is the necessary
prefix, and only that one is joined. Its place in the window and in the document gives the only
place where the window can lie; it has to fit between the document's ends, and its words are then
compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.shared import ascii_lower, maybe_broadcast, pin, stored

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
#: Stands for a whole document among shingle hashes; a shingle of this hash would only be verified once more.
_MARK = 0x5EED5EED5EED
#: Words in a shingle; a shorter item is one shingle.
SHINGLE = 4


def words(text: str) -> Column:
    """The words of a text: runs of a-z, 0-9 and anything beyond ASCII, A-Z lower-cased."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(F.col(f"`{text}`"), F.lit(""))), GAPS), "")


def _shingles(hashes: str, count: str, widths: list[int]) -> str:
    """SQL of the array of (shingle, width, place) of an array of word hashes, for each width."""
    own = []
    for w in widths:
        cells = ", ".join(["x", *[f"get({hashes}, i + {k})" for k in range(1, w)], f"{w}"])
        own.append(
            f"transform(slice({hashes}, 1, cast(greatest({count} - {w - 1}, 0) as int)),"
            f" (x, i) -> named_struct('shingle', xxhash64({cells}), 'place', i))"
        )
    return own[0] if len(own) == 1 else f"concat({', '.join(own)})"


def windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text: str = "text") -> DataFrame:
    """(window, length, names): the distinct windows of the items, as words joined by spaces.

    A window is `window` consecutive words of an item; an item of fewer words is one window, one
    without words none. Items with equal windows share one, which has all their names.
    """
    rows = pin(items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text")), w=words("text"))
    size = F.size("w")
    parts = F.when(size <= window, F.array(F.array_join("w", " "))).otherwise(
        F.expr(f"transform(sequence(0, size(w) - {window}), i -> array_join(transform(sequence(0, {window - 1}), k -> get(w, i + k)), ' '))")
    )
    found = rows.filter(size > 0).select("item", F.explode(parts).alias("window"))
    found = found.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("names"))
    return found.select("window", F.size(F.split("window", " ")).alias("length"), "names")


def _keyed(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(row_id, row_text, body) of docs; the hash tells rows apart that share an id."""
    row_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)).cast("long"))
    return docs.select(row_id.alias("row_id"), F.xxhash64(F.col(f"`{text}`")).alias("row_text"), F.col(f"`{text}`").alias("body"))


def _window_shingles(found: DataFrame, widths: list[int]) -> DataFrame:
    """found with a row for each shingle (shingle, place) of each window."""
    cut = pin(found, _w=F.transform(F.split("window", " "), lambda x: F.xxhash64(x)))
    out = None
    for w in widths:
        own = cut.filter(F.least("length", F.lit(SHINGLE)) == w).select(
            *found.columns, F.expr(f"inline({_shingles('_w', 'length', [w])}) as (shingle, place)")
        )
        out = own if out is None else out.unionByName(own)
    return out


def _met(docs: DataFrame, shingles: DataFrame, widths: list[int]) -> DataFrame:
    """(row_id, row_text, n, shingle, at): where documents have benchmark shingles.

    A row with a null shingle stands for each document itself, with its number n of words.
    """
    cells = pin(docs, _w=words("body"))
    cells = pin(cells.drop("body"), n=F.size("_w"), _h=F.transform("_w", lambda x: F.xxhash64(x)))
    own = _shingles("_h", "n", widths)
    cells = cells.select(
        "row_id", "row_text", "n", F.expr(f"inline(concat({own}, array(named_struct('shingle', {_MARK}L, 'place', -1)))) as (shingle, at)")
    )
    wanted = shingles.select("shingle").distinct()
    wanted = stored(wanted.unionByName(wanted.sparkSession.range(1).select(F.lit(_MARK).cast("long").alias("shingle"))).distinct(), "wanted")
    met = cells.join(maybe_broadcast(wanted), "shingle", "left_semi")
    return met.withColumn("shingle", F.when(F.col("at") >= 0, F.col("shingle")))


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(row_id, row_text, n_words, n_hit, names), one for every row of docs; names are those of the items."""
    given = _keyed(docs, id_col, text)
    found = stored(windows(items, window), "windows")
    widths = sorted(r[0] for r in found.select(F.least("length", F.lit(SHINGLE))).distinct().collect())  # SHINGLE rows at most
    widths = widths or [SHINGLE]
    grams = stored(_window_shingles(found, widths), "window-shingles")
    met = stored(_met(given, grams, widths), "met")
    every = met.filter("shingle is null").select("row_id", "row_text", F.col("n").cast("long").alias("n_words"))
    places = met.filter("shingle is not null").distinct()

    rarity = places.groupBy("shingle").agg(F.count("*").alias("often"))
    ranked = grams.join(rarity, "shingle").groupBy("window", "length").agg(
        F.min(F.struct("often", "shingle", "place")).alias("p"), F.count_distinct("place").alias("seen"), F.first("names").alias("names")
    )  # a window of which some shingle is nowhere in the corpus needs no join at all
    whole = F.col("seen") == F.col("length") - F.least("length", F.lit(SHINGLE)) + 1
    prefix = ranked.filter(whole).select(F.col("p.shingle").alias("shingle"), F.col("p.place").alias("place"), "window", "length", "names")
    prefix = maybe_broadcast(stored(prefix, "prefix"))
    spots = places.join(prefix, "shingle").withColumn("start", F.col("at") - F.col("place"))
    spots = spots.filter((F.col("start") >= 0) & (F.col("start") + F.col("length") <= F.col("n")))
    spots = stored(
        spots.groupBy("row_id", "row_text").agg(F.collect_set(F.struct("start", "length", "window", "names")).alias("spots")), "spots")

    keys = maybe_broadcast(stored(spots.select("row_id", "row_text"), "spot-keys"))
    suspects = given.join(keys, ["row_id", "row_text"], "left_semi").join(spots, ["row_id", "row_text"])
    suspects = pin(suspects, _w=words("body")).drop("body")
    true = F.expr("filter(spots, s -> array_join(transform(sequence(0, s.length - 1), k -> get(_w, s.start + k)), ' ') = s.window)")
    suspects = pin(suspects, _true=true).drop("spots", "_w").filter(F.size("_true") > 0)
    verified = suspects.select(
        "row_id", "row_text",
        F.expr("cast(size(array_distinct(flatten(transform(_true, s -> sequence(s.start, s.start + s.length - 1))))) as bigint)").alias("n_hit"),
        F.expr("array_sort(array_distinct(flatten(transform(_true, s -> s.names))))").alias("names"),
    ).dropDuplicates(["row_id", "row_text"])
    return every.join(verified, ["row_id", "row_text"], "left").select(
        "row_id", "row_text", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("names", F.array().cast("array<string>")).alias("names"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A word is hit if any occurrence of a window covers it. Items are named by their ids as strings;
    items_sha256 is over the sorted names joined by commas, for none over the empty string. Null and
    empty texts have no words; an item with a null id hits words but is not named; repeated items
    are one. Rows may share an id: each is judged by its own words. Other columns are not read.
    """
    found = hits(docs, items, id_col, text, window)
    return found.select(
        F.when(F.col("row_id") != -(2**63), F.col("row_id")).alias("doc_id"), "n_words", "n_hit",
        F.size("names").cast("long").alias("n_items"),
        F.sha2(F.array_join("names", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of docs, with all their columns, in which no word is hit. Texts are not shuffled while few rows go."""
    bad = hits(docs, items, id_col, text, window).filter("n_hit > 0").select("row_id", "row_text")
    bad = maybe_broadcast(stored(bad.distinct(), "contaminated"))
    row_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)).cast("long"))
    return docs.join(bad, (row_id == bad["row_id"]) & (F.xxhash64(F.col(f"`{text}`")) == bad["row_text"]), "left_anti")
