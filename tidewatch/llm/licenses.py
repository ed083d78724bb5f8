"""License scans: sparse TF-IDF cosine of headers and license files to templates, then inheritance by directory.

Templates are whole license texts, whole headers and notices of one line. Three kinds of units of a
file are compared with them: a line that could belong to a license, a header, which is a run of such
lines however it is wrapped, and the whole file if half of its lines could. A word's weight is the
log of its count in the unit times its rarity over all files, whether templates have it or not.
A unit's license is that of the nearest template, if near enough; a file's is that of the unit with the
most evidence, its cosine times its words, so a whole license outweighs a phrase in it. A file of which
enough lines lie in such units is a license file and declares its license for its directory.
A file without one takes that of its nearest ancestor directory that has one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.license_texts import TEXTS
from tidewatch.llm.shared import maybe_broadcast, pin, stored

MIN_COSINE, FILE_SHARE = 0.7, 0.2

#: License, and the name that notices give it. Fixed values.
NAMES = (
    ("MIT", "MIT License"), ("Apache-2.0", "Apache License, Version 2.0"), ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"), ("LGPL-2.1", "GNU Lesser General Public License, version 2.1"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"), ("AGPL-3.0", "GNU Affero General Public License, version 3"),
    ("MPL-2.0", "Mozilla Public License, version 2.0"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"),
    ("ISC", "ISC License"), ("CC-BY-4.0", "CC BY 4.0"), ("CC-BY-SA-4.0", "CC BY-SA 4.0"), ("CC-BY-NC-4.0", "CC BY-NC 4.0"), ("CC0-1.0", "CC0 1.0"),
)
#: How a notice of one line names a license. Fixed values.
PHRASES = ("Licensed under the {}", "Released under the {}", "This work is licensed under the {}", "Distributed under the terms of the {}")
#: Words that tell nothing about a license by themselves. Fixed values.
COMMON = (
    "a all also an and any are as at be been but by can could do does each for from had has have he her his if in into is it its may more most must no "
    "not of on one only or other our out over shall she should so some such than that the their them then there these they this to under up use was we "
    "were what when which who will with would you your 0 1 2 3 4 5 6 7 8 9 b c d e f g h i j k l m n o p q r s t u v w x y z"
).split()
NOTICES = (
    *((license, phrase.format(name)) for license, name in NAMES for phrase in PHRASES),
    *((license, f"SPDX-License-Identifier: {license}") for license, _ in NAMES),
    ("Proprietary", "All rights reserved"),
)
TEMPLATES = (*TEXTS, *NOTICES)


def terms(text: Column) -> Column:
    """The words of a text in order: runs of a-z, 0-9 and anything beyond ASCII, lower-cased."""
    return F.array_remove(F.split(F.lower(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _template_terms(spark: SparkSession, templates: tuple[tuple[str, str], ...]) -> DataFrame:
    """(template, license, term, tf); a fixed number of rows."""
    rows = spark.createDataFrame([(k, *t) for k, t in enumerate(templates)], "template int, license string, body string")
    return rows.select("template", "license", F.explode(terms(F.col("body"))).alias("term")).groupBy("template", "license", "term").agg(F.count(F.lit(1)).alias("tf"))


def _measured(files: DataFrame, vocabulary: list[str]) -> DataFrame:
    """files (row_id, path, body) as row_id, path, n_lines, likely and whole, one row each.

    likely has (place, at, words) of the lines that could belong to a license: half of their words are the
    templates', and one of these at least is not common. at counts lines with words; place counts those
    that are not made of common template words alone, so that neighbours in a header have neighbouring
    places. whole has all words of a file of which half the lines, two at least, are likely.
    """
    common = set(COMMON)
    own = lambda x: x.isin(vocabulary)
    telling = lambda x: x.isin([t for t in vocabulary if t not in common])
    rows = pin(files, _words=F.filter(F.transform(F.split(F.coalesce("body", F.lit("")), "\n"), terms), lambda w: F.size(w) > 0)).drop("body")
    kind = lambda w: (
        F.when(F.exists(w, telling), F.when(2 * F.size(F.filter(w, own)) >= F.size(w), 2).otherwise(1)).when(F.forall(w, own), 0).otherwise(1))
    rows = pin(rows, _lines=F.transform("_words", lambda w, i: F.struct(i.alias("at"), w.alias("words"), kind(w).alias("kind"))))
    placed = F.transform(
        F.filter("_lines", lambda x: x["kind"] > 0), lambda x, i: F.struct(i.alias("place"), x["at"].alias("at"), x["words"].alias("words"), x["kind"].alias("kind")))
    rows = pin(rows.withColumn("n_lines", F.size("_words").cast("long")), likely=F.filter(placed, lambda x: x["kind"] == 2)).drop("_lines")
    much = (F.size("likely") > 1) & (2 * F.size("likely") >= F.col("n_lines"))
    return rows.select("row_id", "path", "n_lines", "likely", F.when(much, F.flatten("_words")).alias("whole"))


def _units(measured: DataFrame) -> DataFrame:
    """(row_id, path, first, last, words, unit) of the units of every file, unit named by its words."""
    file = ["row_id", "path"]
    lines = measured.select(*file, F.inline("likely")).dropDuplicates([*file, "place"])
    run = F.col("place") - F.row_number().over(Window.partitionBy(*file).orderBy("place"))
    parts = lines.withColumn("run", run).groupBy(*file, "run").agg(F.sort_array(F.collect_list(F.struct("place", "at", "words"))).alias("parts"))
    headers = parts.filter(F.size("parts") > 1).select(
        *file, F.col("parts")[0]["at"].alias("first"), F.element_at("parts", -1)["at"].alias("last"), F.flatten("parts.words").alias("words"))
    wholes = measured.filter("whole IS NOT NULL").select(*file, F.lit(0).alias("first"), (F.col("n_lines") - 1).cast("int").alias("last"), F.col("whole").alias("words"))
    both = lines.select(*file, F.col("at").alias("first"), F.col("at").alias("last"), "words").unionByName(headers).unionByName(wholes)
    return both.withColumn("unit", F.md5(F.array_join("words", " ")))


def _rarity(files: DataFrame, needed: DataFrame, total: int) -> DataFrame:
    """(term, idf) of the needed terms, by the number of all files that have them."""
    words = files.select(F.explode(F.array_distinct(terms(F.col("body")))).alias("term"))
    df = words.join(maybe_broadcast(needed), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.lit(1.0) + total) / (F.lit(1.0) + F.coalesce("df", F.lit(0)))) + 1.0
    return needed.join(df, "term", "left").select("term", idf.alias("idf"))


def _weighted(tf: DataFrame, idf: DataFrame, key: list[str]) -> DataFrame:
    """tf (key, term, tf) with weight, and length, that of the key's whole vector."""
    weighted = tf.join(maybe_broadcast(idf), "term").select(*key, "term", ((1.0 + F.log("tf")) * F.col("idf")).alias("weight"))
    return weighted.withColumn("length", F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(*key))))


def nearest(files: DataFrame, units: DataFrame, wanted: DataFrame, total: int, min_cosine: float) -> DataFrame:
    """(unit, license, cosine) of units near a template; of equally near ones the greater name.

    Units of the same words are one. Vectors meet in a join of their terms.
    """
    tf = stored(units.dropDuplicates(["unit"]).select("unit", F.explode("words").alias("term")).groupBy("unit", "term").agg(F.count(F.lit(1)).alias("tf")), "unit-terms")
    needed = stored(tf.select("term").unionByName(wanted.select("term")).distinct(), "needed-terms")
    idf = stored(_rarity(files, needed, total), "idf")
    vectors = stored(_weighted(wanted, idf, ["template", "license"]).select(
        "term", "template", "license", (F.col("weight") / F.col("length")).alias("share")), "template-vectors")  # a fixed number of rows
    own = _weighted(tf, idf, ["unit"])
    dots = own.join(F.broadcast(vectors), "term").groupBy("unit", "template", "license").agg(
        F.sum(F.col("weight") / F.col("length") * F.col("share")).alias("dot"))
    near = dots.withColumn("cosine", F.round("dot", 6)).filter(F.col("cosine") >= min_cosine)
    return near.groupBy("unit").agg(F.max(F.struct("cosine", "license")).alias("b")).select("unit", "b.license", "b.cosine")


def _directory(path: str) -> Column:
    """The directory of a path, "" for the root; a null path has none."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _ancestors(directory: str) -> Column:
    """(ancestor, depth) of a directory, itself and the root included."""
    return F.expr(
        f"transform(sequence(0, size(split({directory}, '/'))), k ->"
        f" named_struct('ancestor', array_join(slice(split({directory}, '/'), 1, k), '/'), 'depth', k))"
    )


def inherited(directories: DataFrame, declared: DataFrame) -> DataFrame:
    """(directory, inherited): the license of the nearest ancestor in declared (directory, license, n).

    Of several licenses of one directory the most frequent counts, then the greater name.
    """
    best = declared.groupBy("directory").agg(F.max(F.struct("n", "license")).alias("b")).select(
        F.col("directory").alias("ancestor"), F.col("b.license").alias("license"))
    up = directories.select("directory", F.inline(_ancestors("directory"))).distinct()
    return up.join(best, "ancestor").groupBy("directory").agg(F.max(F.struct("depth", "license")).alias("b")).select(
        "directory", F.col("b.license").alias("inherited"))


def scan(
    files: DataFrame, id_col: str = "doc_id", path: str = "path", text: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES, min_cosine: float = MIN_COSINE, file_share: float = FILE_SHARE,
) -> DataFrame:
    """doc_id, path, n_lines, n_license_lines, own_license, cosine, inherited_license, license for every row of files.

    own_license is that of the weightiest near unit of the whole text, license is it or else the inherited one.
    n_lines counts lines with words, n_license_lines those inside a near unit. A file declares its
    license for its directory if these are file_share of its lines or more. Null and empty texts have
    no lines; a null path has no directory and inherits nothing; repeated rows are files of their own;
    other columns are not read.
    """
    own_id = F.struct(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("text"))
    place = F.struct(F.col(f"`{path}`").alias("name"))  # structs, so that null ids and paths find themselves again
    rows = files.select(own_id.alias("row_id"), place.alias("path"), F.col(f"`{text}`").alias("body"))
    wanted = stored(_template_terms(files.sparkSession, templates), "template-terms")
    vocabulary = [r[0] for r in wanted.select("term").distinct().orderBy("term").collect()]  # the templates' words
    measured = stored(_measured(rows, vocabulary), "measured")
    units = stored(_units(measured), "units")
    best = stored(nearest(rows, units, wanted, measured.count(), min_cosine), "nearest")
    lines = units.withColumn("n", F.size("words")).drop("words").join(maybe_broadcast(best), "unit")
    per_file = stored(lines.groupBy("row_id", "path").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set(F.sequence("first", "last"))))).cast("long").alias("n_license_lines"),
        F.max(F.struct(F.round(F.col("cosine") * F.col("n"), 6).alias("evidence"), "cosine", "license")).alias("b"),
    ).select("row_id", "path", "n_license_lines", F.col("b.license").alias("own_license"), F.col("b.cosine").alias("cosine")), "file-licenses")
    named = measured.select("row_id", "path", "n_lines").join(per_file, ["row_id", "path"], "left")
    named = stored(named.withColumn("directory", _directory("path.name")), "files")
    declares = F.col("n_license_lines") >= F.lit(float(file_share)) * F.col("n_lines")
    declared = named.filter(declares).filter("directory is not null").groupBy("directory", F.col("own_license").alias("license")).agg(F.count("*").alias("n"))
    above = inherited(named.select("directory").filter("directory is not null").distinct(), declared)
    return named.join(maybe_broadcast(stored(above, "inherited")), "directory", "left").select(
        F.col("row_id.id").alias("doc_id"), F.col("path.name").alias("path"), "n_lines", F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
        "own_license", "cosine", F.col("inherited").alias("inherited_license"), F.coalesce("own_license", "inherited").alias("license"),
    )
