"""Quality rules: plain text statistics and a hashed n-gram log-likelihood ratio, DataFrame functions only.

Two multinomials over hashed word unigrams and bigrams are counted: one over
trusted documents (labelled good and not toxic), one over the whole corpus.  A
document's score is the mean over its n-grams of log p_trusted - log p_corpus.

* Counting explodes the n-grams in generated code and adds them up per bin
  before the shuffle (``BINS`` rows a task at most), whatever the corpus.
* Documents are dealt into ``FOLDS`` folds by a hash of doc_id; each is scored
  against the trusted counts of the other folds.  So a trusted document does not
  vouch for itself, and scores of labelled and unlabelled documents can be
  compared with one threshold.  Copies fall into different folds: a text copied
  a thousand times weighs as much in the trusted counts as its labels say.
* The threshold is read off the labelled documents' exact score histogram: the
  cut with the largest share of good documents kept minus share of bad ones
  kept, in the middle of its gap.  Every document gets the same cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

BINS = 1 << 16
FOLDS = 5
SMOOTHING = 1.0
#: Losing a share of the good documents costs this many times the same share of bad ones kept.
GOOD_WEIGHT = 3.0
#: Words are runs of anything but these.
_SPACE = r"[ \\t-\\r]+"
_WORDS = f"array_remove(split(coalesce(text, ''), '{_SPACE}'), '')"
_UNIGRAM = "pmod(xxhash64({0}), %d)" % BINS
_BIGRAM = "pmod(xxhash64({0}, {1}), %d)" % BINS
_FOLD = "pmod(xxhash64(doc_id, 'fold'), %d)" % FOLDS


def verdicts_of(labels: DataFrame) -> DataFrame:
    """(doc_id, good, trusted) from label rows; a document with both verdicts counts as bad."""
    toxic = F.max(F.coalesce("toxic", F.lit(0)))
    return (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id")
            .agg(F.min("quality").alias("q"), toxic.alias("t"))
            .select("doc_id", (F.col("q") >= 1).alias("good"), ((F.col("q") >= 1) & (F.col("t") < 1)).alias("trusted")))


def base_rules(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; keeps words as ``_w``.

    Repeated windows: 64-bit hashes of all 3-word windows are sorted with their
    positions, so equal windows are neighbours; a word counts once however many
    repeated windows cover it.
    """
    d = docs.withColumns({
        "_w": F.expr(_WORDS),
        "_lines": F.expr(r"filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^ \\t-\\r]')"),
    }).withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.char_length(F.array_join("_w", "")).cast("long"),
        "n_symbols": F.expr("regexp_count(coalesce(text, ''), '[#*$%&|<>]')").cast("long"),
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "_h": F.expr("slice(transform(_w, (x, i) -> xxhash64(x, get(_w, i + 1), get(_w, i + 2))), 1, greatest(size(_w) - 2, 0))"),
    })
    d = d.withColumn("_s", F.expr("""CASE WHEN size(array_distinct(_h)) < size(_h)
                                          THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS at))) END"""))
    d = d.withColumn("_at", F.expr("""array_sort(transform(filter(
        transform(_s, (s, j) -> struct(s.at AS at, s.h <=> get(_s, j - 1).h OR s.h <=> get(_s, j + 1).h AS twice)),
        s -> s.twice), s -> s.at))"""))
    d = d.withColumn("n_repeat_words", F.coalesce(F.expr("""aggregate(_at, struct(-3 AS last, 0L AS n),
        (acc, x) -> struct(x AS last, acc.n + least(3, x - acc.last) AS n), acc -> acc.n)"""), F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed).drop("_lines", "_h", "_s", "_at")


def ngram_weights(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: ``weights``, an array of FOLDS x BINS log ratios; fold f's part leaves fold f's trusted documents out.

    Without trusted documents all weights are those of an empty trusted count
    (smoothing only); without any n-grams they are zero.
    """
    # by key at every size: the texts' shuffle grows with them instead of setting in where a broadcast no longer fits
    words = (docs.select("doc_id", "text").join(verdicts.where("trusted").select("doc_id", "trusted").hint("merge"), "doc_id", "left")
             .select(F.expr(f"CASE WHEN trusted THEN {_FOLD} END").alias("fold"), F.expr(_WORDS).alias("w")))
    pairs = words.select("fold", F.explode(F.expr("arrays_zip(w, slice(w, 2, size(w)))")).alias("z")).select(
        "fold", F.col("z.w").alias("a"), F.col("z.`1`").alias("b"))
    grams = pairs.select("fold", F.explode(F.expr(
        f"CASE WHEN b IS NULL THEN array({_UNIGRAM.format('a')}) ELSE array({_UNIGRAM.format('a')}, {_BIGRAM.format('a', 'b')}) END"
    )).alias("bin"))
    counts = grams.groupBy("bin").agg(F.count("*").alias("raw"), F.count("fold").alias("t"), *(
        F.count_if(F.col("fold") == f).alias(f"t{f}") for f in range(FOLDS)))
    every = docs.sparkSession.range(BINS).withColumnRenamed("id", "bin").join(counts, "bin", "left").na.fill(0)
    row = every.agg(F.array_sort(F.collect_list(F.struct(*every.columns))).alias("c"),  # BINS entries, always
                    *(F.sum(c).alias(c) for c in every.columns[1:]))
    rate = lambda n, total: F.log((n + SMOOTHING) / (total + SMOOTHING * BINS))

    def without(own: str):  # the array of one fold
        return F.transform("c", lambda x: rate(x["t"] - x[own], F.col("t") - F.col(own)) - rate(x["raw"], F.col("raw")))

    return row.select(F.concat(*(without(f"t{f}") for f in range(FOLDS))).alias("weights"))


def cut(scored: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: ``cut``, the threshold between labelled good and bad documents (null without both kinds).

    Scores are counted per 1/1000; the histogram has as many rows as there are
    such steps in use, however many documents are labelled.
    """
    steps = (scored.where("NOT base_failed").select("doc_id", "llr").join(verdicts.select("doc_id", "good"), "doc_id")
             .groupBy(F.floor(F.col("llr") * 1000).alias("step"))
             .agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b")))
    order = Window.orderBy("step")
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    up = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    gain = GOOD_WEIGHT * F.sum("g").over(up) / F.sum("g").over(whole) - F.sum("b").over(up) / F.sum("b").over(whole)
    tried = steps.select("step", F.lag("step").over(order).alias("below"),
                         F.when((F.sum("g").over(whole) > 0) & (F.sum("b").over(whole) > 0), gain).alias("gain"))
    best = tried.where("gain IS NOT NULL").agg(F.min_by(F.struct("step", "below"), F.struct(-F.col("gain"), F.col("step"))).alias("x"))
    return best.select(F.when(F.col("x.below").isNotNull(), (F.col("x.step") + F.col("x.below") + 1) / 2000)
                       .otherwise(F.col("x.step") / 1000).alias("cut"))


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, carry: list[str]) -> DataFrame:
    """Per row of ``docs``: a struct ``row`` of the ``carry`` columns, the base statistics, base_failed, llr, kept.

    Null and empty texts have no words and fail the base rules (llr 0).  A
    document is kept if it passes the base rules and its llr reaches the cut;
    with no labelled good or no labelled bad document there is no cut and the
    base rules alone decide.  Repeated rows each get the same verdict; a row with
    a null doc_id is judged like any other.  Other columns (labels: than doc_id,
    quality, toxic) are only carried; a table of verdicts is never joined back to the texts.
    """
    # written, so that the planner goes by its size
    verdicts = scratch.table(verdicts_of(labels), "verdicts")
    src = docs.select(F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row"), "doc_id", "text")
    weights = scratch.table(ngram_weights(src, verdicts), "weights").scalar()
    d = base_rules(src.withColumn("_fold", F.expr(_FOLD))).withColumn("_weights", weights)
    parts = F.expr(f"""zip_with(_w, slice(_w, 2, size(_w)), (a, b) ->
        get(_weights, cast(_fold * {BINS} + {_UNIGRAM.format('a')} AS int)) +
        CASE WHEN b IS NULL THEN 0D ELSE get(_weights, cast(_fold * {BINS} + {_BIGRAM.format('a', 'b')} AS int)) END)""")
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    llr = F.when(F.size("_w") > 0, total / (2 * F.size("_w") - 1)).otherwise(0.0)
    scored = scratch.table(d.select("row", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                    "base_failed", llr.alias("llr")), "scored")
    limit = scratch.table(cut(scored, verdicts), "cut").scalar()
    return scored.drop("doc_id").withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("llr") >= limit, F.lit(True)))


def quality_verdicts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``judged`` with doc_id alone: doc_id, the base statistics, base_failed, llr, kept per row of ``docs``."""
    found = judged(docs, labels, scratch, ["doc_id"])
    return found.select("row.*", *found.columns[1:])
