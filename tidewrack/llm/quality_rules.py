"""Quality rules: base counts of repetition and symbols, and distribution divergence from language references.

Everything runs as DataFrame functions. A document's character-class histogram
and its histogram over the most common words of its language are compared with
the language's own reference histograms by Jensen-Shannon distance (base 2, so
0 to 1). Which words to count is found in the corpus, by a count over all
documents, and the references too are counted over all documents, in every
language there is. Nothing comes to the driver: a scalar subquery brings the
references, common_words + classes numbers a language, to the rows.
Each text is read once for all its counts, which are written to the shared
folder; references and verdicts come from these few numbers a document.

Defined results: a null or empty text has no words, fails the base rules
(n_words < 20) and isn't kept. A null lang, or one without a reference, is
compared with every reference and the nearest counts. Documents of fewer than
min_words words are not judged by divergence. Of equally frequent words the
least is common. Repeated rows, and rows with a null or repeated id, are judged
row by row. Extra input columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import stored

SYMBOLS = r"[#*$%&|<>]"
COMMON = r"[a-z\x20\u00C0-\u024F]+"
CLASSES = ("common", "upper", "digit", "mark", "symbol", "other")
SPAN = 8


def word_array(text: Column) -> Column:
    """Words of a text. Plain replacements and a one-character split, as they are much faster than a pattern."""
    t = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        t = F.replace(t, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(t, " "), "")


def _tagged(hashes: Column) -> Column:
    """Window fingerprints with their places, sorted; null if none occurs twice."""
    tagged = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), tagged)


def _repeated_words(tagged: Column) -> Column:
    """Words inside windows that occur at least twice. tagged must be a column, not an expression: it is read for every element."""
    twice = F.filter(tagged, lambda x, i: F.coalesce(F.get(tagged, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(tagged, i + 1)["h"] == x["h"], F.lit(False)))
    at = F.array_sort(F.transform(twice, lambda x: x["i"]))
    # Consecutive starts overlap: each adds the words that the one before didn't cover.
    state = F.struct(F.lit(0).alias("n"), F.lit(-SPAN).alias("last"))
    total = F.aggregate(at, state, lambda a, p: F.struct((a["n"] + F.least(F.lit(SPAN), p - a["last"])).alias("n"), p.alias("last")))["n"]
    return F.coalesce(total, F.lit(0))


def base_counts(docs: DataFrame, leads: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", with_row: bool = False) -> DataFrame:
    """One row per input row: id, lang, the base counts, and counts for both histograms; with_row, also _row, a struct of all input columns.

    _words counts the lead words of the document's language; _every, only where
    that has none, those of each language in leads, in the order of their names.
    """
    row = [F.struct(*docs.columns).alias("_row")] if with_row else []
    every = leads.agg(F.array_sort(F.collect_list(F.struct("lang", "words", F.array_max(F.transform("words", F.octet_length)).alias("longest")))).alias("every"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("_lang"), text.alias("_t"), word_array(F.col(text_col)).alias("_w"), *row)
    d = d.withColumn("_leads", every.scalar())
    # Fingerprints of 2 and 4 words. Only a document in which 4 words come twice can have 8 that do.
    d = d.withColumn("_2", _paired("_w", 1)).withColumn("_4", _paired("_2", 2))
    cut = lambda c, k: F.slice(c, 1, F.greatest(F.size("_w") - (k - 1), F.lit(0)))
    d = d.withColumn("_4", cut("_4", 4))
    d = d.withColumn("_8", F.when(F.size(F.array_distinct("_4")) < F.size("_4"), cut(_paired("_4", 4), SPAN)))
    d = d.withColumn("_h", _tagged(F.col("_8")))
    d = d.withColumn("_rare", F.regexp_replace("_t", COMMON, "")).withColumn("_lines", F.filter(F.split("_t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    d = d.withColumn("_own", F.get(F.filter("_leads", lambda x: x["lang"] == F.col("_lang")), F.lit(0)))
    out = d.select(
        "doc_id", "_lang",
        F.when(F.col("_own").isNotNull(), _word_counts(F.col("_w"), F.col("_own"))).alias("_words"),
        F.when(F.col("_own").isNull(), F.transform("_leads", lambda x: _word_counts(F.col("_w"), x))).alias("_every"),
        _class_counts(F.length("_t"), F.col("_rare")).alias("_chars"),
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_rare", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("_h")).cast("long").alias("n_repeat_words"),
        *(["_row"] if with_row else []),
    )
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _paired(name: str, k: int) -> Column:
    return F.transform(F.col(name), lambda h, i: F.xxhash64(h, F.get(F.col(name), i + k)))


def _class_counts(length: Column, rare: Column) -> Column:
    """Counts for CLASSES; rare is the text without its runs of small letters and spaces, so it is short."""
    counts = [F.regexp_count(rare, F.lit(p)) for p in ("[A-Z]", "[0-9]", r"[.,;:!?'\"()-]", SYMBOLS)]
    every = [length - F.length(rare), *counts, F.length(rare) - sum(counts[1:], counts[0])]
    return F.array(*[c.cast("double") for c in every])


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common_words: int = 12) -> DataFrame:
    """One row per language: the words that are most frequent in it, of any length, in the order of their names.

    All documents are counted. Words are combined in each task before they are
    shuffled, and so is each task's list of leaders.
    """
    words = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.explode(word_array(F.col(text_col))).alias("word"))
    counted = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    lead = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("rank") <= common_words)
    return lead.groupBy("lang").agg(F.array_sort(F.collect_list("word")).alias("words"))


def _word_counts(words: Column, lead: Column) -> Column:
    """How often each of a language's lead words occurs and, last, how many words are none of them."""
    names = lead["words"]
    listed = F.filter(words, lambda w: (F.octet_length(w) <= lead["longest"]) & F.array_contains(names, w))
    # Two spaces between words, so that each has its own on either side.
    text = F.concat(F.lit(" "), F.array_join(listed, "  "), F.lit(" "))

    def counts(t: Column) -> Column:
        return F.transform(names, lambda w: (F.length(t) - F.length(F.replace(t, F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))) / (F.length(w) + 2))

    # The one-element arrays bind text and counts, so that each is made once for each document.
    each = F.transform(F.array(text), counts)
    return F.transform(each, lambda c: F.concat(c, F.array(F.size(words) - F.aggregate(c, F.lit(0.0), lambda s, x: s + x))))[0]


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares."""
    half = lambda a, b: F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(F.lit(0.0))
    terms = F.zip_with(p, q, lambda a, b: (half(a, b) + half(b, a)) / 2)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x), F.lit(0.0)))


def _scaled(counts: Column) -> Column:
    whole = F.greatest(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x), F.lit(1.0))
    return F.transform(counts, lambda x: x / whole)


def _profiles(counts: DataFrame, leads: DataFrame, common_words: int) -> DataFrame:
    """One row: for each language in leads, in the order of names, shares of its common words and of the character classes over all its documents."""
    sums = counts.where(F.col("_words").isNotNull()).groupBy("_lang").agg(
        F.array(*[F.sum(F.get("_words", F.lit(i))) for i in range(common_words + 1)]).alias("w"),
        F.array(*[F.sum(F.col("_chars")[i]) for i in range(len(CLASSES))]).alias("c"),
    )
    each = leads.join(sums, F.col("lang") == F.col("_lang")).select("lang", _scaled(F.array_compact("w")).alias("w"), _scaled(F.col("c")).alias("c"))
    return each.agg(F.array_sort(F.collect_list(F.struct("lang", "w", "c"))).alias("profiles"))


def _judged(docs: DataFrame, id_col: str, text_col: str, lang_col: str, common_words: int, min_words: int, max_class_distance: float, max_word_distance: float, with_row: bool) -> DataFrame:
    """What base_counts() gives, with class_distance, word_distance and kept."""
    leads = stored(references(docs, text_col, lang_col, common_words), "leads")
    counts = stored(base_counts(docs, leads, id_col, text_col, lang_col, with_row), "counts")
    d = counts.withColumn("_profiles", stored(_profiles(counts, leads, common_words), "profiles").scalar()).withColumn("_mine", _scaled(F.col("_chars")))
    far = lambda profile, c: F.struct(_distance(_scaled(c), profile["w"]).alias("w"), _distance(F.col("_mine"), profile["c"]).alias("c"))
    own = F.filter("_profiles", lambda x: x["lang"] == F.col("_lang"))
    near = F.array_min(F.zip_with("_profiles", "_every", far))
    judged = F.when(F.col("_every").isNotNull(), near).otherwise(F.get(F.transform(own, lambda x: far(x, F.col("_words"))), F.lit(0)))
    d = d.withColumn("_d", F.when(F.col("n_words") >= min_words, judged))
    over = (F.col("_d")["w"] > max_word_distance) | (F.col("_d")["c"] > max_class_distance)
    return d.withColumns({"class_distance": F.col("_d")["c"], "word_distance": F.col("_d")["w"], "kept": ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))})


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", common_words: int = 12, min_words: int = 40, max_class_distance: float = 0.28, max_word_distance: float = 0.31) -> DataFrame:
    """Judge every row. Returns doc_id, the base counts, class_distance, word_distance, base_failed, kept.

    A document of at least min_words words is rejected when either distance to
    its language's reference exceeds its limit; a distance is null without
    references (an empty table, or none with a lang).
    """
    d = _judged(docs, id_col, text_col, lang_col, common_words, min_words, max_class_distance, max_word_distance, False)
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def clean(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common_words: int = 12, min_words: int = 40, max_class_distance: float = 0.28, max_word_distance: float = 0.31) -> DataFrame:
    """The rows that judge() keeps, with their columns as they were.

    A row travels with its counts, so no verdict has to be joined to its text.
    No column has to tell rows apart.
    """
    d = _judged(docs, docs.columns[0], text_col, lang_col, common_words, min_words, max_class_distance, max_word_distance, True)
    return d.where("kept").select("_row.*")
