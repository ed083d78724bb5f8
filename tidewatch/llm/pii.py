"""Personal data: patterns of form, and contexts learned from what they find.

Base spans are found by form in the whole text. They are seeds, and so are secrets: long values of
many different characters behind an equals sign or colon. The words round a seed are lexical
patterns, and everything that could be an identifier, in one word or in groups of digits, is an
instance of the patterns it stands in; what is too short to be added is none.
Scores run over the graph of patterns and instances: a pattern's score is the weight of its instances
over their number, whatever their kind, an instance's is the mean over its patterns; seeds keep
weight 1. Patterns that end with a high score add the identifiers they stand round, whatever their
form. An added one has the kind that its own form tells, else the one most of its pattern's seeds have.

Places come from the regular expression engine itself: the pieces that split() leaves between the
matches, and the matches, lie in a row, so a running sum of their lengths gives every place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.shared import maybe_broadcast, stored

KINDS = ("email", "ip", "card", "phone")

#: The forms, in order; each finds what the plain form beside it finds, in time linear in the text.
FORMS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?"
    r"(?=\.(?![A-Za-z0-9-])|[^A-Za-z0-9.-]|\z)",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+
    "card": r"[0-9](?=[\x20-]?[0-9])[0-9\x20-]*?[0-9](?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
SECRET = "secret"
#: A value behind an equals sign or colon, in quotes or not, that may be a secret; how many characters of it differ at least.
SECRET_FORM = r"""(?<=[=:]\x20{0,3}["']{0,1})(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{24,}+"""
SECRET_VARIETY = 10
#: A word with a digit or an at-sign: what may be an identifier.
CANDIDATE = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: Its core: without brackets and marks at its ends, but for the bracket of an area code.
CORE = r"(?:\((?=[0-9]++\)[\x20-]?[0-9]))?[0-9A-Za-z+](?:[^\x09-\x0D]*[0-9A-Za-z])?"
#: A word that a digit group may follow, and such a group; an IP address is neither.
_QUAD = r"(?![^0-9]*[0-9]+\.[0-9]+\.[0-9]+\.[0-9])"
OPENS = rf"^{_QUAD}(?:[^0-9@]*[^0-9@A-Za-z])?[0-9](?:[0-9().-]*[0-9)-])?$"
GROUP = rf"^{_QUAD}\(?[0-9][0-9().-]*[^0-9@A-Za-z]*$"
_WORD, _GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"

#: Rounds of scoring, least score of a pattern that adds spans, least seeds it was seen with, and how
#: many unseen instances of no kind are added to its own when its score is taken.
ROUNDS, MIN_SCORE, MIN_SEEDS, SMOOTHING = 3, 0.8, 5, 1.0
#: Digits that an identifier without at-sign has at least to be added.
MIN_DIGITS = 6
#: Digits of the longest identifier written in groups; a longer row of groups is a list of numbers.
MAX_DIGITS = 19


def _rows(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(row_id, row_text, body); the hash tells rows apart that share an id, equal rows have equal spans."""
    row_id = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(2**63)).cast("long"))
    return docs.select(row_id.alias("row_id"), F.xxhash64(F.col(f"`{text}`")).alias("row_text"), F.col(f"`{text}`").alias("body"))


def _matches(rows: DataFrame, forms: dict[str, str]) -> DataFrame:
    """(row_id, row_text, kind, k, piece, found, next): the matches of each form in order, the text before and after."""
    cells = [
        F.struct(F.lit(kind).alias("kind"), F.split("body", form, -1).alias("pieces"), F.regexp_extract_all("body", F.lit(form), 0).alias("found"))
        for kind, form in forms.items()
    ]
    each = rows.select("row_id", "row_text", F.explode(F.array(*cells)).alias("c")).select("row_id", "row_text", "c.*").filter(F.size("found") > 0)
    zipped = F.arrays_zip("pieces", "found", F.slice("pieces", F.lit(2), F.size("found")).alias("next"))
    return each.select("row_id", "row_text", "kind", F.posexplode(zipped).alias("k", "m")).select(
        "row_id", "row_text", "kind", "k", F.col("m.pieces").alias("piece"), F.col("m.found").alias("found"), F.col("m.next").alias("next")
    ).filter("found is not null")


def _placed(matches: DataFrame) -> DataFrame:
    """matches with start and end, in code points; one text's matches of a kind are summed in order."""
    run = Window.partitionBy("row_id", "row_text", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("piece") + F.length("found")).over(run)
    return matches.withColumn("end", end.cast("long")).withColumn("start", F.col("end") - F.length("found"))


def _sound(kind: str, found: str) -> Column:
    """What a match has to satisfy beyond its form."""
    digits = F.regexp_replace(found, "[^0-9]", "")
    part = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
    ip = F.col(found).rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    card = F.length(digits).between(14, 19) & F.when(F.length(digits) <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    phone = F.length(digits).between(10, 15)
    return F.when(F.col(kind) == "ip", ip).when(F.col(kind) == "card", card).when(F.col(kind) == "phone", phone).otherwise(True)


def base_spans(rows: DataFrame) -> DataFrame:
    """(row_id, row_text, kind, start, end, found) of rows (row_id, row_text, body): leftmost matches that are sound."""
    likely = rows.filter(F.col("body").rlike("[0-9@]"))
    found = stored(_placed(_matches(likely, FORMS).dropDuplicates(["row_id", "row_text", "kind", "k"])).drop("piece", "next"), "forms")
    return found.filter(_sound("kind", "found")).select("row_id", "row_text", "kind", "start", "end", "found")


def secret_spans(rows: DataFrame) -> DataFrame:
    """Assigned values that look random, as base_spans gives its own: letters, digits and many different characters."""
    likely = rows.filter(F.col("body").rlike("[=:]"))
    found = _placed(_matches(likely, {SECRET: SECRET_FORM}).dropDuplicates(["row_id", "row_text", "kind", "k"])).drop("piece", "next")
    varied = F.size(F.array_distinct(F.split("found", ""))) >= SECRET_VARIETY
    mixed = F.col("found").rlike("[0-9].*[0-9].*[0-9].*[0-9]") & F.col("found").rlike("[A-Za-z]")
    return found.filter(varied & mixed).select("row_id", "row_text", "kind", "start", "end", "found")


def _runs(words: DataFrame, base: DataFrame) -> DataFrame:
    """words (start, end, found, before, after) and base spans, each with the run it belongs to.

    Words that one base span covers are a run, and else digit groups with a space, or a dash between
    spaces, from one to the next, of MAX_DIGITS in all at most. A span lies in the run of the word it
    starts in. In order of their places, spans after the word that starts with them, a text's running
    values tell all of this.
    """
    text = ["row_id", "row_text"]
    none = F.lit(None)
    events = words.select(*text, "start", "end", "found", "before", "after", none.cast("string").alias("kind"), none.cast("string").alias("span")).unionByName(
        base.select(*text, "start", "end", none.cast("string").alias("found"), none.cast("string").alias("before"),
                    none.cast("string").alias("after"), "kind", F.col("found").alias("span")))
    line = Window.partitionBy(*text).orderBy("start", F.col("kind").isNotNull())
    earlier = line.rowsBetween(Window.unboundedPreceding, -1)
    is_word = F.col("kind").isNull()
    events = events.select(
        "*",
        F.last("found", True).over(earlier).alias("was"), F.last(F.when(is_word, F.col("start")), True).over(earlier).alias("was_at"),
        F.max(F.when(~is_word, F.col("end"))).over(earlier).alias("reach"),
        F.coalesce(F.lead("kind").over(line).isNotNull() & (F.lead("start").over(line) < F.col("end")), F.lit(False)).alias("has_span"),
    )
    covered = F.coalesce(F.col("was").isNotNull() & (F.col("reach") > F.col("start")), F.lit(False))
    apart = ~F.col("has_span") & ~F.coalesce(F.col("reach") > F.col("was_at"), F.lit(False))
    follows = apart & F.col("before").isin(" ", " - ") & F.col("was").rlike(OPENS) & F.col("found").rlike(GROUP)
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    digits = F.length(F.regexp_replace("found", "[^0-9]", ""))
    events = events.withColumns({"c": covered, "f": F.coalesce(follows, F.lit(False))}).withColumns({
        "tight": F.sum((is_word & ~F.col("c")).cast("long")).over(so_far),
        "wide": F.sum((is_word & ~F.col("c") & ~F.col("f")).cast("long")).over(so_far),
    })
    total = F.sum(digits).over(Window.partitionBy(*text, "wide"))
    return events.withColumn("run", F.when(total > MAX_DIGITS, -F.col("tight")).otherwise(F.col("wide")))


def candidates(rows: DataFrame, base: DataFrame) -> DataFrame:
    """(row_id, row_text, start, end, core, kind, patterns): what may be identifiers, and the patterns round them.

    A candidate is an identifier-like word or a run of digit groups. Base spans are candidates of
    their kind with the whole span as core, one each; others have no kind, and their core is the
    part from their first to their last letter or digit. The patterns are the two words before, and
    the word before with the word after, outside the run; a text's edge or another candidate counts
    as the word "|".
    """
    likely = rows.filter(F.col("body").rlike("[0-9@]"))
    words = _placed(_matches(likely, {"word": CANDIDATE}).dropDuplicates(["row_id", "row_text", "kind", "k"]))
    # The last three words before and the first one behind, whole, however long they are.
    before = F.reverse(F.regexp_extract(F.reverse("piece"), rf"^(?:{_GAP})?+(?:{_WORD}+(?:{_GAP})?+){{0,3}}", 0))
    after = F.regexp_extract("next", rf"^(?:{_GAP})?+(?:{_WORD}+)?+", 0)
    words = words.select("row_id", "row_text", "start", "end", "found", before.alias("before"), after.alias("after"))
    is_word = F.col("kind").isNull()
    parts = F.array_sort(F.collect_list(F.when(is_word, F.struct("start", "before", "found"))))
    runs = _runs(words, base).groupBy("row_id", "row_text", "run").agg(
        F.min(F.when(is_word, F.col("start"))).alias("start"), parts.alias("parts"),
        F.max(F.when(is_word, F.struct("start", "after")))["after"].alias("after"),
        F.collect_set(F.when(~is_word, F.struct("span", "kind"))).alias("spans"))
    runs = runs.filter(F.size("parts") > 0).withColumns({
        "before": F.lower(F.col("parts")[0]["before"]), "after": F.lower("after"),
        "whole": F.array_join(F.transform("parts", lambda x, i: F.when(i == 0, x["found"]).otherwise(F.concat(x["before"], x["found"]))), "")})
    last = F.regexp_extract("before", f"({_WORD}){_GAP}$", 1)
    last_two = F.regexp_extract("before", f"({_WORD}{_GAP}{_WORD}){_GAP}$", 1)
    first = F.regexp_extract("after", f"^{_GAP}({_WORD})", 1)
    named = lambda c: F.when(c == "", "|").otherwise(F.regexp_replace(c, _GAP, " "))
    core = F.regexp_extract("whole", CORE, 0)
    runs = runs.select(
        "row_id", "row_text", (F.col("start") + F.instr("whole", core) - 1).alias("start"), core.alias("own"), F.explode_outer("spans").alias("s"),
        F.array(F.concat(named(last_two), F.lit(" _")), F.concat(named(last), F.lit(" _ "), named(first))).alias("patterns"))
    out = runs.filter((F.col("own") != "") | F.col("s").isNotNull())
    return out.select("row_id", "row_text", "start", (F.col("start") + F.length("own")).alias("end"),
                      F.coalesce("s.span", "own").alias("core"), "s.kind", "patterns")


def score_patterns(seen: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, kind, score, seeds) from seen (core, pattern) and seeds (core, kind).

    Instances and patterns are joined by key and pre-aggregated; nothing is gathered.
    """
    edges = stored(seen.distinct(), "pattern-edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("instances"))
    degree = stored(edges.groupBy("core").agg(F.count("*").alias("degree")), "instance-degrees")
    seeds = stored(seeds.distinct(), "seeds")
    weights = seeds.withColumn("weight", F.lit(1.0))
    for turn in range(rounds):
        mass = edges.join(weights, "core").groupBy("pattern", "kind").agg(
            F.sum("weight").alias("mass"), F.sum((F.col("weight") == 1.0).cast("long")).alias("seeds"))
        scores = stored(mass.join(size, "pattern").select(
            "pattern", "kind", F.round(F.col("mass") / (F.col("instances") + SMOOTHING), 9).alias("score"), "seeds"), "pattern-scores")
        if turn + 1 < rounds:
            spread = edges.join(scores, "pattern").groupBy("core", "kind").agg(F.sum("score").alias("total")).join(degree, "core").select(
                "core", "kind", F.least(F.round(F.col("total") / F.col("degree"), 9), F.lit(0.999)).alias("weight"))
            weights = stored(spread.join(seeds.withColumn("seed", F.lit(1.0)), ["core", "kind"], "full").select(
                "core", "kind", F.coalesce("seed", "weight").alias("weight")), "instance-weights")
    return scores


def _form_kind(core: str) -> Column:
    """The kind that an added identifier's own form tells, or null."""
    digits = F.length(F.regexp_replace(core, "[^0-9]", ""))
    random = F.col(core).rlike("^[A-Za-z0-9+/_-]{16,}$") & F.col(core).rlike("[A-Za-z].*[A-Za-z].*[A-Za-z].*[A-Za-z]")
    return F.when(F.col(core).contains("@"), "email").when(F.col(core).startswith("+") & (digits <= 15), "phone").when(random, SECRET)


def learned_spans(rows: DataFrame, seeds: DataFrame, min_score: float = MIN_SCORE, min_seeds: int = MIN_SEEDS) -> DataFrame:
    """(row_id, row_text, kind, start, end): identifiers in strong patterns that touch no seed's span."""
    place = ["row_id", "row_text", "start"]
    digits = F.length(F.regexp_replace("core", "[^0-9]", ""))
    able = F.col("kind").isNotNull() | F.col("core").contains("@") | (digits >= MIN_DIGITS)
    words = stored(candidates(rows, seeds).filter(able), "candidates")
    known = words.filter("kind is not null").select("core", "kind")
    # An edge of a text or a neighbouring identifier on both sides is no context.
    seen = words.select("core", F.explode(F.filter("patterns", lambda p: p.rlike(r"[^|_\x20]"))).alias("pattern"))
    scores = score_patterns(seen, known.select("core", F.lit("identifier").alias("kind")))
    strong = stored(scores.filter((F.col("score") >= min_score) & (F.col("seeds") >= min_seeds)).select("pattern", "score"), "strong-patterns")
    held = seen.distinct().join(maybe_broadcast(strong), "pattern").join(known.distinct(), "core").groupBy("pattern", "score", "kind").agg(F.count(F.lit(1)).alias("n"))
    usual = F.max_by("kind", F.struct("n", F.col("kind")))
    strong = maybe_broadcast(stored(held.groupBy("pattern", "score").agg(usual.alias("usual")), "pattern-kinds"))
    marked = words.filter(F.col("kind").isNull()).select(*place, "end", "core", F.explode("patterns").alias("pattern")).join(strong, "pattern")
    best = marked.groupBy(*place, "end", "core").agg(F.max(F.struct("score", "usual")).alias("b"))
    return best.select("row_id", "row_text", F.coalesce(_form_kind("core"), "b.usual").alias("kind"), "start", "end")


def _listed(spans: str) -> Column:
    """kind:start:end by start, then kind as listed, joined by commas."""
    return F.array_join(F.expr(f"transform(array_sort({spans}), s -> concat_ws(':', s.kind, s.start, s.end))"), ",")


def find_pii(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_learned for every row of docs.

    Counts and base_sha256 are over base spans, spans lists those, secrets that touch none of them and
    the learned ones, places in code points. n_secret counts the secrets that are seeds, n_learned what
    the patterns added. A null or empty text has none. Rows may share an id, each has its own text's spans;
    null ids keep their rows; other columns are not read.
    """
    rows = _rows(docs, id_col, text)
    base = stored(base_spans(rows), "base-spans")
    overlap = (F.col("s.start") < F.col("b.end")) & (F.col("b.start") < F.col("s.end"))
    same = (F.col("s.row_id") == F.col("b.row_id")) & (F.col("s.row_text") == F.col("b.row_text"))
    secrets = stored(stored(secret_spans(rows), "secret-forms").alias("s").join(base.alias("b"), same & overlap, "left_anti"), "secrets")
    extra = learned_spans(rows, base.unionByName(secrets)).withColumn("source", F.lit("learned"))
    spans = base.drop("found").withColumn("source", F.lit("base")).unionByName(secrets.drop("found").withColumn("source", F.lit("secret"))).unionByName(extra)
    order = F.array_position(F.array(*map(F.lit, [*KINDS, SECRET])), F.col("kind"))
    cell = F.struct("start", order.alias("order"), "end", "kind")
    is_base = F.col("source") == "base"
    counts = [f"n_{k}" for k in KINDS] + ["n_secret", "n_learned"]
    per = spans.groupBy("row_id", "row_text").agg(
        *[F.sum((is_base & (F.col("kind") == k)).cast("long")).alias(f"n_{k}") for k in KINDS],
        *[F.sum((F.col("source") == x).cast("long")).alias(f"n_{x}") for x in ("secret", "learned")],
        F.collect_list(F.when(is_base, cell)).alias("own"), F.collect_list(cell).alias("all"))
    per = per.select("row_id", "row_text", *counts, _listed("own").alias("own"), _listed("all").alias("spans"))
    out = rows.drop("body").join(per, ["row_id", "row_text"], "left")
    zero = F.lit(0).cast("long")
    return out.select(
        F.when(F.col("row_id") != -(2**63), F.col("row_id")).alias("doc_id"),
        *[F.coalesce(f"n_{k}", zero).alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("own", F.lit("")).cast("binary"), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), *[F.coalesce(c, zero).alias(c) for c in ("n_secret", "n_learned")],
    )
