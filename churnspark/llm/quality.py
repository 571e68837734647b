"""Quality rules whose thresholds carry a guarantee on labelled holdouts.

Every rule compares one measure of a text with a cutoff; step t of a fixed ladder
makes all cutoffs stricter than step t - 1.  For each stratum the strictest step is
chosen that provably rejects few good documents: on the stratum's labelled good
documents, the hypothesis "the false rejection rate is above `risk`" is tested by
the exact binomial tail at every step.  Steps are tested from the mildest on, until
one fails (fixed sequence, which needs no correction between steps), and the level
is divided by the number of strata (Bonferroni).  So with probability 1 - `delta`,
no stratum loses more than `risk` of its good documents to the learned rules.

Everything is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from churnspark.llm.common import SPACE_RE, bind, own_name, row_key, settle

#: measure -> cutoffs in parts per thousand, mildest step first; a text is rejected at step t if its measure is above the t-th.
LADDER = {
    "symbol_rate": (3000, 2000, 1500, 1000, 800, 600, 500, 400, 300, 200),  # symbols to words
    "dup_line_rate": (950, 900, 850, 800, 750, 700, 650, 600, 550, 500),  # repeated lines to lines
    "repeat_rate": (480, 460, 440, 420, 400, 380, 360, 340, 320, 300),  # words in repeated 3-word windows to words
    "upper_rate": (950, 900, 850, 800, 750, 700, 650, 600, 550, 500),  # A-Z to characters of words
    "length_rate": (30000, 25000, 22000, 20000, 18000, 17000, 16000, 15000, 14000, 13000),  # characters to words
}
STEPS = len(LADDER["symbol_rate"])
#: Strata whose steps are broadcast at most.
MOST_BROADCAST = 10_000


def count_repeat_words(words: Column) -> Column:
    """Words covered by 3-word windows that the text has twice or more.

    Windows are sorted with their places; neighbours that are equal repeat.
    """
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(
        F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))

    def covered(ordered: Column) -> Column:
        def repeats(x: Column, at: Column) -> Column:
            return (x["w"] == F.get(ordered, at - 1)["w"]) | (x["w"] == F.get(ordered, at + 1)["w"])

        def near(x, at):
            return F.coalesce(repeats(x, at), F.lit(False))

        starts = F.transform(F.filter(ordered, near), lambda x: x["i"])
        return bind(starts, lambda s: F.size(F.array_distinct(F.flatten(F.transform(s, lambda i: F.array(i, i + 1, i + 2))))))

    return F.when(n < 3, F.lit(0)).otherwise(bind(F.sort_array(windows), covered))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (long) of the whole text."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, SPACE_RE), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    def of(w: Column) -> Column:
        return bind(F.array_join(w, ""), lambda solid: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(solid).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(solid, F.lit("[^#*$%&|<>]+"), F.lit(""))).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(solid, F.lit("[^A-Z]+"), F.lit(""))).cast("long").alias("n_upper"),
            count_repeat_words(w).cast("long").alias("n_repeat_words")))

    m, k = own_name(docs, "measures"), own_name(docs, "line_counts")
    names = ("n_words", "word_chars", "n_symbols", "n_upper", "n_repeat_words")
    out = docs.withColumn(k, bind(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup"))))
    out = out.withColumn(m, bind(words, of))
    return (out.withColumns({c: F.col(m)[c] for c in names} | {"n_lines": F.col(k)["n"].cast("long"), "n_dup_lines": F.col(k)["dup"].cast("long")})
            .drop(m, k))


def first_step() -> Column:
    """The mildest step (from 1) whose cutoffs reject the text; STEPS + 1 if none does."""
    def rate(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, (part * 1000) / whole)

    rates = {
        "symbol_rate": rate(F.col("n_symbols"), F.col("n_words")),
        "dup_line_rate": rate(F.col("n_dup_lines"), F.col("n_lines")),
        "repeat_rate": rate(F.col("n_repeat_words"), F.col("n_words")),
        "upper_rate": rate(F.col("n_upper"), F.col("word_chars")),
        "length_rate": rate(F.col("word_chars"), F.col("n_words")),
    }

    def ladder(name: str) -> Column:
        out = F.lit(STEPS + 1)
        for t in range(STEPS, 0, -1):
            out = F.when(rates[name] > LADDER[name][t - 1], t).otherwise(out)
        return out

    return F.least(*[ladder(name) for name in LADDER])


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) of a binomial distribution: its terms summed as logarithms, from 0 up to k."""
    odds = F.lit(p / (1 - p))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i * odds)
        high, low = F.greatest(acc["total"], term), F.least(acc["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    none = n.cast("double") * F.log1p(F.lit(-p))
    start = F.struct(none.alias("term"), none.alias("total"))
    terms = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.exp(F.aggregate(terms, start, add, lambda acc: acc["total"]))


def choose_steps(good: DataFrame, strata: DataFrame, n_strata: int, stratum: str, risk: float, delta: float) -> DataFrame:
    """(stratum, step): the strictest certified step of each stratum, 0 where none is.

    ``good`` has a row (stratum, first) for each labelled good document; ``strata`` has a row for each stratum.
    """
    counts = good.groupBy(stratum, "first").agg(F.count(F.lit(1)).alias("c"))
    # every stratum and step: STEPS rows a stratum
    grid = strata.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(STEPS))))
    tally = (grid.join(counts, grid[stratum].eqNullSafe(counts[stratum]), "left").select(grid[stratum].alias(stratum), "step", "first", "c")
             .groupBy(stratum, "step").agg(F.coalesce(F.sum(F.when(F.col("first") <= F.col("step"), F.col("c"))), F.lit(0)).alias("k"),
                                               F.coalesce(F.sum("c"), F.lit(0)).alias("n")))
    # above the expected count the tail is far too large to pass, and needs no sum
    p_value = F.when((F.col("n") == 0) | (F.col("k") >= F.col("n") * F.lit(risk)), F.lit(1.0)).otherwise(binomial_tail(F.col("k"), F.col("n"), risk))
    passed = (p_value <= F.lit(delta / max(1, n_strata))).cast("int")
    in_order = Window.partitionBy(stratum).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (tally.withColumn("ok", passed).withColumn("so_far", F.min("ok").over(in_order))
            .groupBy(stratum).agg(F.sum("so_far").cast("int").alias("step")))


def apply_rules(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang",
                risk: float = 0.01, delta: float = 0.05) -> DataFrame:
    """One row per row of ``docs``: doc_id, row_key (of id and text), stratum, the measures, base_failed, first_step, step and kept.

    base_failed: under 50 words, or over half of the words in repeated 3-word
    windows.  The holdout is every labelled row that passes this base rule; a
    document is good if any of its labels has quality 1.  kept is false if
    base_failed, or if the rules reject the text at the stratum's certified step.
    A null text has no words; a null stratum is a stratum of its own; one without
    good labels keeps all that passes the base rule.  Repeated rows are judged each
    (and count each in the holdout); a null id has no label.
    """
    rows = measured(docs.select(F.col(doc_id).alias("doc_id"), row_key(F.col(doc_id), F.col(text)).alias("row_key"),
                               F.col(stratum).cast("string").alias("stratum"), F.col(text).alias("text")), "text").drop("text")
    rows = rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    rows = settle(rows.withColumn("first_step", first_step()))  # a narrow row for each document, used three times
    fine = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("quality")).filter("quality = 1").select("label_id")
    good = (rows.filter(~F.col("base_failed")).join(fine, F.col("doc_id") == F.col("label_id"), "left_semi")
            .select("stratum", F.col("first_step").alias("first")))
    strata = settle(rows.select("stratum").distinct())
    n_strata = strata.count()
    steps = settle(choose_steps(good, strata, n_strata, "stratum", risk, delta)).withColumnRenamed("stratum", "of")
    # a row for each stratum; with more of them Spark shuffles, and splits what is skewed
    out = rows.join(F.broadcast(steps) if n_strata <= MOST_BROADCAST else steps, F.col("stratum").eqNullSafe(F.col("of")), "left").drop("of")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("first_step") > F.coalesce(F.col("step"), F.lit(0))))
