"""Quality rules by distribution divergence, in DataFrame functions alone.

A document is held against its language's reference in two histograms: character classes, and the language's COMMON
most frequent words (all others together). The measure is the Jensen-Shannon distance (base 2, so 0 to 1). Documents
too short for a histogram to mean much are not judged by it. References are sums over all documents of a language.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.common import read, table

SPACE = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"
COMMON = 24
#: What removes all but one class of characters; lower-case letters and the rest are what is left of the text.
CLASSES = {"upper": r"[^\p{Lu}]+", "lower": r"[^\p{Ll}]+", "digit": r"[^\p{Nd}]+", "punct": r"[^.,;:!?'\"()\[\]-]+", "symbol": r"[^#*$%&|<>]+"}
#: Up to so many repeated windows are looked for one by one.
SHORT = 64
#: References are broadcast up to so many languages, joined by a shuffle beyond.
FEW = 1000


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two arrays of counts of equal size; null if either is empty of counts."""
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, y: a + y)
    # the total is a variable of the outer function, or it would be summed anew for each element
    shares = lambda x: F.get(F.transform(F.array(total(x)), lambda t: F.transform(x, lambda y: y / t)), F.lit(0))

    def part(u: Column, v: Column) -> Column:
        m = (u + v) / 2
        one = lambda z: F.when(z > 0, z * F.log2(z / m)).otherwise(0.0)
        return (one(u) + one(v)) / 2

    d = F.aggregate(F.zip_with(shares(p), shares(q), part), F.lit(0.0), lambda s, x: s + x)
    return F.when((total(p) > 0) & (total(q) > 0), F.sqrt(F.greatest(d, F.lit(0.0))))


def base_features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, lang ('' if null), words and the base counts of every row, in passes over the row alone."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    body = F.btrim(text, F.lit(SPACE))
    has_word = lambda x: x.rlike(r"[^\x20\x09-\x0D]")
    d = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), text.alias("text"), body.alias("body"))
    size = lambda pattern: F.length(F.regexp_replace("text", pattern, "")).cast("long")
    d = d.select("doc_id", "lang", F.when(F.col("body") == "", F.array().cast("array<string>")).otherwise(F.split("body", GAP)).alias("words"), size(GAP).alias("word_chars"), F.length("text").cast("long").alias("n_chars"), *(size(p).alias(k) for k, p in CLASSES.items()), F.filter(F.split("text", "\n"), has_word).alias("lines"))
    n = F.size("words")
    window = lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2))
    d = d.select("*", n.cast("long").alias("n_words"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.slice(F.transform("words", window), F.lit(1), F.greatest(n - 2, F.lit(0))).alias("windows")).drop("lines")
    # most texts repeat no window, which a look at the distinct ones tells sooner than sorting
    none = F.size(F.array_distinct("windows")) == F.size("windows")
    d = d.withColumn("ordered", F.when(none, F.array().cast("array<bigint>")).otherwise(F.sort_array("windows")))
    d = d.withColumn("often", F.array_distinct(F.filter("ordered", lambda x, i: (i > 0) & (F.get("ordered", i - 1) == x)))).drop("ordered")
    # places of windows that are found twice: by a look into a short list, or else in the order of hashes
    short = F.filter(F.transform("windows", lambda h, i: F.when(F.array_contains("often", h), i).otherwise(-1)), lambda i: i >= 0)
    pairs = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    twice = lambda x, i, all_: ((i > 0) & (F.get(all_, i - 1)["h"] == x["h"])) | F.coalesce(F.get(all_, i + 1)["h"] == x["h"], F.lit(False))
    long = F.get(F.transform(F.array(pairs), lambda y: F.sort_array(F.transform(F.filter(y, lambda x, i: twice(x, i, y)), lambda x: x["p"]))), F.lit(0))
    few = F.size("often")
    d = d.withColumn("places", F.when(few == 0, F.array().cast("array<int>")).when(few <= SHORT, short).otherwise(long)).drop("windows", "often")
    cover = F.transform("places", lambda p, i: F.least(F.lit(3), F.get("places", i + 1) - p))
    return d.withColumn("n_repeat_words", F.aggregate(cover, F.lit(0), lambda a, x: a + x).cast("long")).withColumn("n_symbols", F.col("symbol")).drop("places")


def common_words(words: DataFrame, k: int = COMMON) -> DataFrame:
    """(lang, marks): each language's k most frequent words, each with a letter of its own, as a map. words: lang, words."""
    counts = words.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    best = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= k)
    return best.groupBy("lang").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", F.char(F.col("r") + 96).alias("mark"))))).alias("marks"))


def judge(df: DataFrame, most_chars: float = 0.25, most_words: float = 0.5, least_chars: int = 200, least_words: int = 50, most_share: float = 0.9, share_words: int = 100, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance and
    kept of every row.

    kept is false if the base rules fail, or if char_distance exceeds most_chars in a text of least_chars characters or
    more, or word_distance exceeds most_words in one of least_words words or more, or most_share of the distance that a
    text without any of the common words has in one of share_words or more. Null and empty texts have no words and fail the base rules. Rows without a language form a group of their own. A distance is null where the document
    or its reference has too little text. Ids may be null or repeat; each row gives one row. Further columns are
    ignored; an empty table gives an empty result.
    """
    plain = F.btrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(SPACE))
    marks = table(common_words(df.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), plain.alias("b")).filter("b <> ''").select("lang", F.split("b", GAP).alias("words"))), "marks")
    few = marks.count() <= FEW
    marks = marks.withColumn("longest", F.array_max(F.transform(F.map_keys("marks"), lambda w: F.octet_length(w))))
    near = F.broadcast if few else (lambda x: x)
    d = base_features(df, id_col, text_col, lang_col).join(near(marks), "lang", "left")
    # a word's length tells of most words that they aren't common, which costs less than a look into the map
    able = F.filter("words", lambda w: F.octet_length(w) <= F.col("longest"))
    marked = F.array_join(F.transform(able, lambda w: F.coalesce(F.try_element_at("marks", w), F.lit(""))), "")
    d = d.withColumn("marked", F.when(F.col("marks").isNull(), F.lit("")).otherwise(marked)).drop("words", "marks", "longest")
    known = F.length("marked")
    hist = F.array(*[(known - F.length(F.replace("marked", F.lit(chr(97 + i)), F.lit("")))).cast("double") for i in range(COMMON)], (F.col("n_words") - known).cast("double"))
    spaces = F.col("n_chars") - F.col("word_chars")
    rest = F.col("n_chars") - spaces - sum(F.col(c) for c in CLASSES)
    chars = F.array(*[F.col(c).cast("double") for c in CLASSES], spaces.cast("double"), rest.cast("double"))
    d = table(d.select("doc_id", "lang", "n_chars", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", chars.alias("chars"), hist.alias("hist")), "features")
    total = lambda c, n: F.array(*[F.sum(F.get(c, F.lit(i))) for i in range(n)])
    refs = d.groupBy("lang").agg(total("chars", len(CLASSES) + 2).alias("ref_chars"), total("hist", COMMON + 1).alias("ref_hist"))
    none = F.array(*[F.lit(0.0)] * COMMON, F.lit(1.0))
    refs = refs.withColumn("most", most_share * js_distance(none, F.col("ref_hist")))
    d = d.join(near(refs), "lang", "left").withColumn("char_distance", js_distance(F.col("chars"), F.col("ref_chars"))).withColumn("word_distance", js_distance(F.col("hist"), F.col("ref_hist")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = ((F.col("n_chars") >= least_chars) & (F.col("char_distance") > most_chars)) | ((F.col("n_words") >= least_words) & (F.col("word_distance") > most_words)) | ((F.col("n_words") >= share_words) & (F.col("word_distance") > F.col("most")))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "char_distance", "word_distance", (~failed & ~F.coalesce(odd, F.lit(False))).alias("kept"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """judge over documents, with distances to six places."""
    out = judge(read(spark, sf_dir, "documents"))
    return out.withColumns({c: F.round(c, 6) for c in ("char_distance", "word_distance")})
