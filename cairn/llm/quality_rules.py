"""Document quality rules on built-in functions only: repetition counts and divergence from language references.

Each text's histogram of character classes and of common words (and all others as one) is compared with its language's by Jensen-Shannon
distance (0 to 1). References are gathered from all rows of the reference languages that pass the base rule.
Texts of fewer than MIN_WORDS words in one of these languages are judged by the base rule alone. Texts of another or no
language get the distance to the nearest reference; they are judged by the nearest of classes alone, at any length,
with letters that have no case counted as lower-case ones: common words would reject every language not among the
references, and classes every script without case.

Defined results: a null or blank text has no words, fails the base rule and is not kept; repeated rows are judged
one by one; an empty table gives an empty result; only id, text and lang are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import staged, whole_row

WHITE = " \t\n\x0b\x0c\r"
#: Frequent function words of the reference languages.
COMMON = {
    "en": ["the", "of", "and", "to", "a", "in", "is", "that", "it", "was", "for", "on", "are", "as", "with", "be", "at", "by", "this", "from", "or", "an", "not", "he"],
    "fr": ["le", "de", "la", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "dans", "qui", "par", "sur", "au", "pas", "plus", "ne", "se", "ce", "avec"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch", "es", "an", "für", "er"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "lo", "como", "más", "o", "pero"],
}
LANGUAGES = sorted(COMMON)
WORDS = sorted({w for words in COMMON.values() for w in words})
MIN_WORDS = 60  # shorter texts are not compared
MAX_CLASS_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.45
BOTH_CLASS, BOTH_WORD = 0.08, 0.30  # together these are as strange as one of the above


def _words(text: Column) -> Column:
    """Words between runs of white space; one empty word for a blank text."""
    return F.split(F.btrim(text, F.lit(WHITE)), "[\\x09-\\x0D\\x20]+")


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, carry: bool = False) -> DataFrame:
    """Counts of each text, its class histogram (lower, upper, digit, white, other) and its common-word histogram."""
    also = ["row"] if carry else []
    base = docs.select(*([whole_row(docs)] if carry else []), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    cut = base.select(*also, "id", "lang", "text", _words(F.col("text")).alias("words"))
    n = F.when((F.size("words") == 1) & (F.element_at("words", 1) == ""), 0).otherwise(F.size("words")).cast("long")
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    cut = cut.select(
        *also,
        "id",
        "lang",
        "text",
        "words",
        n.alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.length("text").cast("long").alias("chars"),
        lines.alias("lines"),
        F.mask("text", F.lit("A"), F.lit("a"), F.lit("0"), F.lit(None)).alias("shape"),
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(5)) - 5), lambda i: F.xxhash64(*[F.get("words", (i + t).cast("int")) for t in range(5)]))).alias("windows"),
    )
    no_lower = F.replace(F.col("shape"), F.lit("a"), F.lit(""))
    no_upper = F.replace(no_lower, F.lit("A"), F.lit(""))
    no_digit = F.replace(no_upper, F.lit("0"), F.lit(""))
    bare = F.transform(_words(F.lower("text")), lambda w: F.rtrim(w, F.lit(".,;:!?")))
    common = F.array_sort(F.filter(bare, lambda w: w.isin(WORDS)))
    cut = cut.select(
        *also,
        "id",
        "lang",
        "n_words",
        "word_chars",
        "chars",
        (F.col("chars") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.length(no_lower).cast("long").alias("c1"),
        F.length(no_upper).cast("long").alias("c2"),
        F.length(no_digit).cast("long").alias("c3"),
        # letters without case, and marks on them, of texts that no reference language is named for
        F.when(_named(), 0).otherwise(F.col("chars") - F.length(F.regexp_replace("text", "[\\p{Lo}\\p{Lm}\\p{M}]", ""))).cast("long").alias("caseless"),
        common.alias("common"),
        # sorted with their places, and only where some window returns
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("sorted"),
    )
    same = lambda k, x: F.coalesce(F.get("sorted", k)["h"] == x["h"], F.lit(False))
    again = F.filter("sorted", lambda x, k: same(k - 1, x) | same(k + 1, x))
    places = F.sort_array(F.transform(again, lambda x: x["i"]))
    start = F.struct(F.lit(0).alias("n"), F.lit(-5).alias("at"))
    covered = F.aggregate(places, start, lambda a, p: F.struct((a["n"] + F.least(F.lit(5), p - a["at"])).alias("n"), p.alias("at")), lambda a: a["n"])
    # equal common words stand together: where each begins, and how many they are
    begins = F.filter(F.transform("common", lambda w, i: F.when((i == 0) | (w != F.get("common", i - 1)), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice("begins", 2, F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("common")))
    counted = F.map_from_arrays(F.transform("begins", lambda i: F.get("common", i)), F.slice(F.zip_with(ends, "begins", lambda b, a: b - a), 1, F.size("begins")))
    cut = cut.withColumn("begins", begins).withColumn("counted", counted)
    white = F.col("chars") - F.col("word_chars")
    hits = cut.select(
        *also,
        "id",
        "lang",
        "chars",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "caseless",
        F.array(F.col("chars") - F.col("c1"), F.col("c1") - F.col("c2"), F.col("c2") - F.col("c3"), white, F.col("c3") - white).alias("classes"),
        "n_words",
        F.transform(F.array(*map(F.lit, WORDS)), lambda w: F.coalesce(F.try_element_at("counted", w), F.lit(0))).alias("hits"),
        # read twice, the map is made once beside the function that looks into it, not for each word
        F.greatest(F.col("n_words") - _total(F.map_values("counted")), F.lit(0)).cast("int").alias("rest"),
    )
    return hits.withColumn("hits", F.concat("hits", F.array("rest"))).drop("rest")


def _named() -> Column:
    return F.coalesce(F.col("lang").isin(LANGUAGES), F.lit(False))


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def _failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _distance(p: Column, q: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of an array of shares and a reference."""
    part = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)
    terms = F.zip_with(p, F.array(*map(F.lit, q)), lambda a, b: (part(a, b) + part(b, a)) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)))


def references(stats: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """Class and common-word shares of each reference language over all its rows that pass the base rule: a few rows at most."""
    sums = [F.sum(F.get("classes", i)) for i in range(5)] + [F.sum(F.get("hits", i)) for i in range(len(WORDS) + 1)]
    found = stats.where(F.col("lang").isin(LANGUAGES) & ~_failed() & (F.col("n_words") >= MIN_WORDS)).groupBy("lang").agg(F.array(*sums).alias("sums")).collect()
    share = lambda x: [v / max(1, sum(x)) for v in x]
    return {r["lang"]: (share(r["sums"][:5]), share(r["sums"][5:])) for r in found}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """One row a document: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, both distances, and with ``carry`` the whole row."""
    stats = staged(measured(docs, id_col, text_col, lang_col, carry), "quality")
    refs = references(stats)
    share = lambda column, of: F.transform(column, lambda x: x / F.greatest(F.col(of), F.lit(1)))
    shares = stats.withColumns({"p": share("classes", "chars"), "w": share("hits", "n_words")})
    own = lambda k, column: F.coalesce(*[F.when(F.col("lang") == g, _distance(F.col(column), r[k])) for g, r in refs.items()], F.least(*[_distance(F.col(column), r[k]) for r in refs.values()], F.lit(1.0)))
    scored = shares.withColumns({"class_distance": own(0, "p") if refs else F.lit(0.0), "word_distance": own(1, "w") if refs else F.lit(0.0)})
    known = F.coalesce(F.col("lang").isin(list(refs)), F.lit(False))
    by_class, by_word = F.col("class_distance"), F.col("word_distance")
    odd = (by_class > MAX_CLASS_DISTANCE) | (by_word > MAX_WORD_DISTANCE) | ((by_class > BOTH_CLASS) & (by_word > BOTH_WORD))
    moved = F.array(*[F.get("classes", i) + k * F.col("caseless") for i, k in enumerate((1, 0, 0, 0, -1))])
    letters = F.transform(moved, lambda x: x / F.greatest(F.col("chars"), F.lit(1)))
    nearest = F.least(*[_distance(letters, q) for q, _ in refs.values()], F.lit(1.0)) if refs else F.lit(0.0)
    strange = F.when(known, (F.col("n_words") >= MIN_WORDS) & odd).otherwise(nearest > MAX_CLASS_DISTANCE)
    return scored.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", _failed().alias("base_failed"), (~_failed() & ~strange).alias("kept"), "class_distance", "word_distance", *(["row"] if carry else []))
