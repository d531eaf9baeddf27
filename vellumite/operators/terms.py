"""Dictionary terms in texts: matching, selection, frequencies, candidates.

Texts are cut into words once and joined with the dictionary on word sequences, so the plan is an equality join
whatever the size of either side; there is no text-by-term product.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vellumite.functions import text as T

#: Capitalised words that are no names by themselves.
NO_NAMES = (
    "A An And Are As At Be But By For From He Her His If In Into Is It Its Of On Or She "
    "The Their They This To Was Were When With You Chapter Page Table Figure"
).split()
#: Fixed value: the pattern of a name.
NAME_PATTERN = r"\b(?:[A-Z][A-Za-z''.-]+)(?:\s+(?:of|the|and|&|[A-Z][A-Za-z''.-]+))*\b"
_NAME_WORD = r"(?:of|the|and|&|[A-Z][A-Za-z''.-]+)"  # may give back signs to end at a word border
_NAME_WHOLE = r"(?:of|the|and|&|[A-Z][A-Za-z''.-]++)"
_NAME_NEXT = rf"(?:\s++(?!{_NAME_WORD}\b){_NAME_WHOLE})*+\s++{_NAME_WORD}\b"  # the next word that can end a name, after those that cannot
#: Fixed value: the same names, found without recursion, so that a name of any length fits a thread's stack.
NAME = rf"\b(?:[A-Z][A-Za-z''.-]++(?={_NAME_NEXT})(?:(?:\s++(?!{_NAME_WORD}\b){_NAME_WHOLE})*+\s++(?={_NAME_WORD}\b){_NAME_WHOLE}(?={_NAME_NEXT}))*+{_NAME_NEXT}|[A-Z][A-Za-z''.-]+\b)"
#: Fixed value: an article before a name.
ARTICLE = "^(The|A|An)[ \\t\\r\\n]+"


WORD = "[\\p{L}\\p{N}]+"
#: Words of a text that are looked at together, at least.
PIECE = 64
#: First words of surfaces that are sent to all tasks at most (some 10 MB).
HEADS = 200_000


def _blanks(text: Column) -> Column:
    """The text with every run of white space as one blank."""
    return F.regexp_replace(text, "[\\s\\p{Z}]+", " ")


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))


def surfaces(glossary: DataFrame, forms: bool = True) -> DataFrame:
    """Lower-case surfaces of the dictionary's terms: surface, n_words, ord, term, target, kind (exact or plural), and the signs before its first word (lead) and after its last (tail); those without a word are left out."""
    low = F.lower(F.trim(_blanks(F.col("term"))))
    exact = F.array(F.struct(low.alias("surface"), F.lit("exact").alias("kind")))
    more = F.transform(T.variants(low), lambda x: F.struct(x.alias("surface"), F.lit("plural").alias("kind")))
    df = glossary.select("ord", "term", "target", F.explode(F.concat(exact, more) if forms else exact).alias("s"))
    around = F.split("s.surface", WORD, -1)
    df = df.select("s.surface", F.size(_words(F.col("s.surface"))).alias("n_words"), "ord", "term", "target", "s.kind", around[0].alias("lead"), F.element_at(around, -1).alias("tail"))
    return df.where("n_words > 0")


def matches(texts: DataFrame, glossary: DataFrame, longest: int | None = None, forms: bool = True, heads_at_most: int = HEADS) -> DataFrame:
    """All occurrences at word borders: id, start (word), n_words, term, target, kind; texts has id and text, words being runs of letters and digits.

    Sequences have the lengths of the dictionary's surfaces (up to longest, if given). A surface is found where it
    is written in the text sign by sign, but for case and the width of white space. The first words of the surfaces
    are broadcast if there are at most `heads_at_most`; the surfaces themselves are joined by their words either way.
    """
    known = surfaces(glossary, forms).withColumn("core", F.expr("substring(surface, length(lead) + 1, length(surface) - length(lead) - length(tail))"))
    known = known.where(F.col("n_words") <= longest) if longest else known
    # Of terms that are written alike but for the width of white space only the first can win.
    alike = ["core", "n_words", "lead", "tail", "surface", "kind", F.trim(_blanks(F.col("term"))).alias("raw")]
    known = known.groupBy(*alike).agg(F.min("ord").alias("ord"), F.min_by(F.struct("term", "target"), "ord").alias("x")).select("*", "x.term", "x.target").drop("x")
    sizes = sorted(r.n_words for r in known.select("n_words").distinct().collect())  # a few numbers
    most = max(sizes, default=1)
    # Words and what stands between them in turn, in pieces: a row of a place carries its piece, not the text.
    text = _blanks(T.some(F.col("text")))
    runs = F.regexp_extract_all(text, F.lit(f"({WORD}|[^\\p{{L}}\\p{{N}}]+)"), F.lit(1))
    texts = texts.select("id", runs.alias("t"), text.rlike(f"^{WORD}").alias("at_first"), text.rlike(f"{WORD}\\z").alias("at_last"))
    edge = lambda c: F.when(F.col(c), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    texts = texts.where(F.size("t") > 0).select("id", F.concat(edge("at_first"), "t", edge("at_last")).alias("t")).withColumn("n", ((F.size("t") - 1) / 2).cast("int")).where("n > 0")
    long = max(PIECE, most)
    piece = F.transform(F.sequence(F.lit(0), F.col("n") - 1, F.lit(long)), lambda i: F.struct(i.alias("from"), F.slice("t", i * 2 + 1, 2 * (long + most) - 1).alias("t"), (F.col("n") - i).alias("left")))
    places = texts.select("id", F.explode(piece).alias("p")).select("id", "p.*")
    at = places.select("*", F.explode(F.sequence(F.lit(0), F.least(F.lit(long), F.col("left")) - 1)).alias("k")).withColumn("first", F.lower(F.element_at("t", F.col("k") * 2 + 2)))
    # Only places where the first word of a surface stands are looked at; what stands between their words is cut out for those alone.
    heads = known.groupBy(F.get(_words(F.col("core")), F.lit(0)).alias("first")).agg(F.collect_set("n_words").alias("sizes"))
    if heads.limit(heads_at_most + 1).count() <= heads_at_most:
        at = at.join(F.broadcast(heads), "first")
    else:  # too many to send to all tasks: every length of a surface is tried everywhere, and joined below
        at = at.withColumn("sizes", F.array(*(F.lit(n) for n in sizes)))
    at = at.withColumn("n_words", F.explode("sizes")).where(F.col("k") + F.col("n_words") <= F.col("left"))
    end = F.col("k") + F.col("n_words")
    core = F.array_join(F.slice("t", F.col("k") * 2 + 2, F.col("n_words") * 2 - 1), "")
    grams = at.select("id", (F.col("from") + F.col("k")).alias("start"), "n_words", core.alias("written"), F.element_at("t", F.col("k") * 2 + 1).alias("before"), F.element_at("t", end * 2 + 1).alias("after"), (F.col("from") + F.col("k") == 0).alias("opens"), (end == F.col("left")).alias("ends"))
    hit = grams.withColumn("core", F.lower("written")).join(known, ["core", "n_words"])
    # Signs of the surface itself stand at its words, and no letter or digit right beside them.
    beside = lambda sign, gap, edge, at: (F.col(sign) == "") | (at(F.col(gap), F.col(sign)) & (F.col(edge) | (F.col(gap) != F.col(sign))))
    hit = hit.where(beside("lead", "before", "opens", F.endswith) & beside("tail", "after", "ends", F.startswith))
    # Of terms with one surface the one written as in the text wins, then the first.
    as_written = F.concat("lead", "written", "tail") != F.col("raw")
    best = W.partitionBy("id", "start", "n_words").orderBy((F.col("kind") != "exact").cast("int"), F.desc(F.length("surface")), as_written.cast("int"), "ord")
    return hit.withColumn("r", F.row_number().over(best)).where("r = 1").select("id", "start", "n_words", "term", "target", "kind")


def selected(found: DataFrame) -> DataFrame:
    """Longest matches first, then leftmost, none overlapping one taken before: id, start, n_words, term, match_rank."""
    item = F.struct((-F.col("n_words")).alias("neg"), "start", "n_words", "term")
    lists = found.groupBy("id").agg(F.sort_array(F.collect_list(item)).alias("m"))
    kind = "array<struct<neg:int,start:int,n_words:int,term:string>>"
    clash = lambda a, x: F.exists(a, lambda y: (x["start"] < y["start"] + y["n_words"]) & (y["start"] < x["start"] + x["n_words"]))
    taken = F.aggregate("m", F.array().cast(kind), lambda a, x: F.when(clash(a, x), a).otherwise(F.array_append(a, x)))
    return lists.select("id", F.posexplode(taken).alias("match_rank", "x")).select("id", "x.start", "x.n_words", "x.term", "match_rank")


def document_frequency(found: DataFrame, limit: int | None = None) -> DataFrame:
    """How many texts hold each term, most first."""
    df = found.groupBy("term").agg(F.countDistinct("id").alias("n_docs"))
    return df.orderBy(F.desc("n_docs"), F.lower("term"), "term").limit(limit) if limit else df


def candidates(texts: DataFrame, known: DataFrame | None = None, least: int = 2) -> DataFrame:
    """Capitalised phrases in at least `least` texts that the dictionary does not know: term, n, n_texts."""
    raw = F.explode(F.regexp_extract_all(T.some(F.col("text")), F.lit(f"({NAME})"), F.lit(1)))
    df = texts.select("id", raw.alias("term"))
    df = df.select("id", F.regexp_replace(F.btrim("term", F.lit(" -.,:;!?()[]{}\"")), ARTICLE, "").alias("term"))
    short = F.col("term").rlike("^[^a-z]*$") & (F.length("term") <= 6)
    df = df.where((F.length("term") >= 3) & ~F.col("term").isin(NO_NAMES) & ~short)
    if known is not None:
        df = df.join(known.select(F.lower("term").alias("k")).distinct(), F.lower("term") == F.col("k"), "left_anti")
    return df.groupBy("term").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_texts")).where(F.col("n_texts") >= least)


def conflicts(glossary: DataFrame) -> DataFrame:
    """Terms with more than one target: term, n_targets, first_ord."""
    return glossary.groupBy("term").agg(F.countDistinct("target").alias("n_targets"), F.min("ord").alias("first_ord")).where("n_targets > 1")


def missing_targets(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """Matched terms whose (Chinese) target the translation lacks: id, term, target."""
    df = found.join(pairs.select("id", "translation"), "id").where(F.trim("target").rlike("[\\x{4e00}-\\x{9fff}]"))
    return df.where(~F.contains(F.col("translation"), F.trim("target"))).select("id", "term", "target").distinct()


def fuzzy(pairs: DataFrame, max_edits: Column) -> DataFrame:
    """Is candidate a misread target, and with how many confused characters?"""
    n = T.confusions(F.col("candidate"), F.col("target"))
    ok = F.coalesce((n >= 1) & (n <= max_edits), F.lit(False))
    return pairs.select("candidate", "target", ok.alias("matched"), F.when(ok, n).otherwise(0).alias("edits"))
