"""Quality rules with a hashed n-gram log-likelihood ratio, in DataFrame functions only.

Word unigrams and bigrams are hashed to ``buckets``. The raw multinomial counts every document; the
target multinomial counts the trusted ones and backs off to the raw one (``prior`` pseudo-counts in
its proportions), so a bucket without evidence weighs nothing. The score of a document is the mean,
over its n-grams, of log p_target - log p_raw; every document at ``threshold`` or more is kept, by
that comparison alone, unless a base rule fails it.

``trusted`` gives the ids of the trusted documents; all of them are counted. The raw counts need no join. For the target
the documents are read through a bitmap of the trusted ids, of at most MOST_BITS bits, and what it lets through meets the
ids in a sort-merge join at every size; texts of other documents don't travel, but for the bitmap's false positives.

Defined results: a null text has no words and fails the base rules; without trusted documents every
score is 0; a null id is never trusted; repeated rows count and are scored each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

# --- fixed values: white space, symbols, the width of repeated word windows ---
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5

BUCKETS = 1 << 14
#: Bits of the map of trusted ids: BITS_AN_ID for each id, this many at most (2 MB).
MOST_BITS, BITS_AN_ID = 1 << 24, 16
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
THRESHOLD = -0.08


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def words_of(text: Column) -> Column:
    inner = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Buckets of all unigrams, then of all bigrams, in order."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    pairs = F.when(F.size(words) >= 2, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    two = F.transform(pairs, lambda i: F.pmod(F.xxhash64(F.get(words, i), F.get(words, i + 1)), F.lit(buckets)).cast("int"))
    return F.concat(one, two)


def repeat_words(words: Column) -> Column:
    """How many words stand in a window of WINDOW words that the text holds twice or more."""
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(WINDOW)]))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda s: F.filter(s, lambda e, k: (F.get(s, k - 1)["h"] == e["h"]) | (F.get(s, k + 1)["h"] == e["h"]))
        places = let(pairs, lambda s: F.sort_array(F.transform(same(s), lambda e: e["i"])))
        # every window start covers up to the next start, or all its words
        return F.aggregate(places, F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n")),
                           lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")),
                           lambda acc: acc["n"])

    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def base_rules(text: Column, words: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.translate(text, BLANKS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeat_words(words),
    }


def id_map(ids: DataFrame) -> tuple[DataFrame, int]:
    """One row, one array of longs: a bit for the hash of each ``id``; and how many bits there are."""
    bits = min(MOST_BITS, max(1 << 12, 1 << (BITS_AN_ID * ids.count()).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits))
    words = ids.select(F.floor(place / 64).cast("int").alias("word"), (place % 64).cast("int").alias("bit")) \
        .groupBy("word").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))).alias("has"))
    every = ids.sparkSession.range(bits // 64).select(F.col("id").cast("int").alias("word")).join(words, "word", "left")
    filled = F.struct("word", F.coalesce("has", F.lit(0).cast("long")).alias("has"))
    # one value for 64 bits: bounded by MOST_BITS
    return cut(every.agg(F.sort_array(F.collect_list(filled)).alias("x")).select(F.col("x.has").alias("words"))), bits


def fit(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", trusted_col: str = "doc_id",
        buckets: int = BUCKETS, prior: float = 20000.0) -> DataFrame:
    """One row, one array: the weight log p_target - log p_raw of each bucket."""
    ids = trusted.select(F.col(trusted_col).alias("id")).where("id is not null").distinct()
    texts = docs.select(F.col(id_col).alias("own"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def counted(rows: DataFrame, name: str) -> DataFrame:
        words = rows.select(words_of(F.col("text")).alias("w"))  # a step of its own, so that each text is cut once
        return words.select(F.explode(ngram_buckets(F.col("w"), buckets)).alias("bucket")).groupBy("bucket").agg(F.count("*").alias(name))

    present, bits = id_map(ids)
    place = F.pmod(F.xxhash64("own"), F.lit(bits))
    maybe = texts.where(F.col("own").isNotNull()).where(F.bit_get(F.get(present.scalar(), F.floor(place / 64).cast("int")), (place % 64).cast("int")) == 1)
    target = maybe.join(ids.hint("merge"), F.col("own") == F.col("id"), "left_semi")
    counts = cut(counted(texts, "raw").join(counted(target, "target"), "bucket", "left").select("bucket", "raw", F.coalesce("target", F.lit(0)).alias("target")))
    sums = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("r"), F.coalesce(F.sum("target"), F.lit(0)).alias("t")).first()
    p = F.col("raw") / F.lit(float(max(1, sums["r"])))
    weight = F.log((F.col("target") + prior * p) / (F.lit(float(sums["t"]) + prior) * p))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket")) \
        .join(counts.select("bucket", weight.cast("float").alias("weight")), "bucket", "left")
    # one value a bucket: bounded by ``buckets``
    return cut(every.agg(F.sort_array(F.collect_list(F.struct("bucket", F.coalesce("weight", F.lit(0.0).cast("float")).alias("weight")))).alias("x"))
               .select(F.col("x.weight").alias("weights")))


def score(docs: DataFrame, weights: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS,
          threshold: float = THRESHOLD, least_words: int = 10, most_repeats: int = 20) -> DataFrame:
    """doc_id, the base counts, base_failed, llr (mean log-likelihood ratio), kept."""
    # the weights stand in each row for a moment, as an array of bounded size; they need no join and no driver
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")) \
        .withColumn("weights", weights.scalar())

    def judged(w: Column) -> Column:
        mean = let(ngram_buckets(w, buckets), lambda g: F.aggregate(
            g, F.lit(0.0), lambda acc, b: acc + F.get("weights", b)) / F.greatest(F.size(g), F.lit(1)))
        return F.struct(*[c.alias(n) for n, c in base_rules(F.col("text"), w).items()], mean.alias("llr"))

    def verdict(j: Column) -> Column:
        failed = (j["n_words"] < least_words) | (100 * j["n_repeat_words"] > most_repeats * j["n_words"])
        return F.struct(*[j[n].alias(n) for n in (*BASE, "llr")], failed.alias("base_failed"), (~failed & (j["llr"] >= threshold)).alias("kept"))

    # one expression, so that a filter on the verdict is not taken apart and computed word by word
    rows = texts.select("doc_id", let(let(words_of(F.col("text")), judged), verdict).alias("j"))
    return rows.select("doc_id", "j.*")


def apply_rules(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return score(docs, fit(docs, trusted, id_col=id_col, text_col=text_col), id_col=id_col, text_col=text_col)


def keep_good(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns; no join, the verdict is computed on the row."""
    weights = fit(docs, trusted, id_col=id_col, text_col=text_col)
    everything = F.struct(*[F.col(c) for c in docs.columns])
    judged = score(docs.select(everything.alias("__row"), F.col(text_col).alias("__text")), weights, id_col="__row", text_col="__text")
    return judged.where("kept").select("doc_id.*")


def trusted_ids(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_rules(docs, trusted_ids(spark, sf_dir))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
