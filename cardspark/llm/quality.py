"""Quality rules: hashed n-gram log-likelihood ratio between trusted target and raw corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stash, words

BUCKETS = 1 << 14  # a kind of n-gram
KINDS = 3
UNIT = 1 << 24
TRUSTED_ROWS = 20_000
SMOOTHING = 0.5
PRIOR = 4096  # n-grams of the raw corpus that the target is thought to begin with, so that a small target judges little
#: Prose lies at or above -0.45 in all four languages and at all sizes of the test tables, junk (separators, marks after every word) below -1.2.
THRESHOLD = -0.6


def _hashed(*parts: Column, kind: int) -> Column:
    """Bucket of an n-gram, in the range of its kind; null if a part is."""
    bucket = (F.xxhash64(*parts).bitwiseAND(F.lit(BUCKETS - 1)) + kind * BUCKETS).cast("int")
    return F.when(parts[-1].isNotNull(), bucket)


def ngrams(rows: DataFrame, keep: list[str]) -> DataFrame:
    """rows(text, keep...) -> keep, b1, b2, b3: a row per word and at least one per row.

    Buckets of the word, of the word with the next one, and of its last character with the first one of the next (what marks
    and separators show in); each kind has its own range; null where there is no next word, or no word. One row a word
    keeps all of it in generated code: nothing is shuffled here.
    """
    w, i = F.col("_w"), F.col("_i")
    # explode_outer: a plain explode makes Spark split each text once more, to drop empty ones
    at = rows.select(*keep, words(F.lower("text")).alias("_w")).select(*keep, "_w", F.explode_outer(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("_w") - 1))).alias("_i"))
    x, y = F.get(w, i), F.get(w, i + 1)
    border = _hashed(F.right(x, F.lit(1)), F.substring(y, 1, 1), kind=2)
    return at.select(*keep, _hashed(x, kind=0).alias("b1"), _hashed(x, y, kind=1).alias("b2"), border.alias("b3"))


def log_ratio_weights(docs: DataFrame, trusted: DataFrame, trusted_rows: int = TRUSTED_ROWS) -> DataFrame:
    """One row `weights`: per bucket log p(target) - log p(raw) in units of 1/UNIT, from multinomials; the target's is smoothed by
    the raw one (a Dirichlet prior). Whole numbers, so that sums come out alike in any order.

    docs(doc_id, text) in full is the raw corpus; the target is those of its rows whose doc_id is in trusted(doc_id).
    Of the trusted ids at most trusted_rows are used (a seeded choice), so that their broadcast is bounded.
    An empty target or corpus gives zero weights.
    """
    ids = trusted.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(trusted_rows).withColumn("_t", F.lit(1))
    flagged = docs.select(F.col("doc_id").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "_id", "left").select("text", F.coalesce("_t", F.lit(0)).alias("t"))
    counts = ngrams(flagged, ["t"]).select("t", F.explode(F.array("b1", "b2", "b3")).alias("b")).groupBy("b").agg(F.count("*").alias("raw"), F.sum("t").alias("target"))
    kind = F.floor(F.col("b") / BUCKETS)
    all_ = docs.sparkSession.range(BUCKETS * KINDS).select(F.col("id").cast("int").alias("b")).join(counts, "b", "left").na.fill(0)
    sums = all_.groupBy(kind.alias("k")).agg(F.sum("raw").alias("R"), F.sum("target").alias("T"))
    raw = (F.col("raw") + SMOOTHING) / (F.col("R") + SMOOTHING * BUCKETS)
    weight = F.when((F.col("T") == 0) | (F.col("R") == 0), F.lit(0.0)).otherwise(F.log((F.col("target") + PRIOR * raw) / (F.col("T") + PRIOR)) - F.log(raw))
    rows = all_.withColumn("k", kind).join(F.broadcast(sums), "k").select("b", F.round(weight * UNIT).cast("long").alias("w"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("b", "w"))), lambda x: x["w"]).alias("weights"))


def _windows(h: Column, n: int) -> Column:
    """Hashes of all n-word windows from the words' hashes: windows of half the size meet, twice a step."""

    def grow(of: Column, size: int) -> Column:
        step = min(size, n - size)
        if not step:
            return F.slice(of, 1, F.size(h) - n + 1)
        return let(F.zip_with(of, F.slice(of if step == size else h, size + 1, F.size(h)), lambda x, y: F.xxhash64(x, y)), lambda z: grow(z, size + step))

    return grow(h, 1)


def repeated_window_words(w: Column, n: int = 5) -> Column:
    """Words of an array that lie in an n-word window found twice or more in it, the first one included."""

    def covered(h: Column) -> Column:
        def spans(s: Column) -> Column:
            twice = F.filter(s, lambda e, i: F.coalesce(F.when(i > 0, s[i - 1]["h"] == e["h"]), F.lit(False)) | F.coalesce(F.when(i < F.size(s) - 1, s[i + 1]["h"] == e["h"]), F.lit(False)))
            at = F.array_sort(F.transform(twice, lambda e: e["i"]))
            return let(at, lambda p: F.aggregate(p, F.struct(F.lit(0).alias("sum"), F.lit(-n).alias("last")), lambda acc, x: F.struct((acc["sum"] + F.least(F.lit(n), x - acc["last"])).alias("sum"), x.alias("last")))["sum"])

        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), spans))

    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: _windows(h, n))
    return F.when(F.size(w) > n, let(hashes, covered)).otherwise(F.lit(0))


def base_measures(text: Column, w: Column) -> Column:
    """Struct of the counts on which the fixed rules rest; w: the text's words."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        repeated_window_words(w).cast("long").alias("n_repeat_words"),
    )


def quality_rules(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD, min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """All columns of docs(doc_id, text, ...) plus `_q`: a struct of measures, llr, base_failed and kept.

    llr is the mean over the text's hashed n-grams of log p(target)/p(raw); a row is kept if the fixed rules pass and llr >= threshold.
    Null and empty texts have no words and fail the fixed rules. Equal texts are judged once and get equal verdicts; other
    columns pass through, whatever their names but `_q`; an empty trusted table gives llr 0 for every row, an empty docs
    table no rows. Runs in columns only. Sums of a text come out of the task that reads it, a row per text and task.
    """
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))
    packed = packed.select("row", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    # one row: BUCKETS * KINDS numbers at any input size
    weight = stash(log_ratio_weights(docs, trusted)).scalar()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    of_text = packed.select("k1", "k2", "text", let(words(F.col("text")), lambda w: base_measures(F.col("text"), w)).alias("m")).select("k1", "k2", "text", *[F.col("m")[c].alias(c) for c in names])
    looked = [F.coalesce(F.get(weight, F.col(b)), F.lit(0)) for b in ("b1", "b2", "b3")]
    some = [F.when(F.col(b).isNotNull(), 1).otherwise(0) for b in ("b1", "b2", "b3")]
    # copies of a text add to the sum and to the number alike
    sums = ngrams(of_text, ["k1", "k2", *names]).groupBy("k1", "k2", *names).agg(F.sum(looked[0] + looked[1] + looked[2]).alias("s"), F.sum(some[0] + some[1] + some[2]).alias("n"))
    llr = F.when(F.col("n") == 0, F.lit(0.0)).otherwise(F.col("s") / F.col("n") / UNIT)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    judged = sums.select("k1", "k2", *names, llr.alias("llr"), failed.alias("base_failed"))
    # written first: the join then reads two plain shuffles, and Spark can split a hot text's
    judged = stash(judged.select("k1", "k2", F.struct(*names, "base_failed", (~F.col("base_failed") & (F.col("llr") >= threshold)).alias("kept"), "llr").alias("_q")))
    return packed.drop("text").join(judged, ["k1", "k2"]).select("row.*", "_q")
