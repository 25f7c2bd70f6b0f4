"""Quality rules whose cutoffs are learnt with a bound on false rejection. DataFrame functions only.

Each rule compares one number of a text with a cutoff from a fixed grid. Labelled good documents are the holdout: a
cutoff may be used in a stratum only if the exact binomial test rejects that it would turn away more than `alpha` of
the good documents there. Cutoffs are tested from the loosest to the tightest and the first failure ends the sequence,
so the tests of one sequence share one error; the sequences (rules times strata) are corrected after Bonferroni. The
rules of a stratum together turn away at most RISK of its good documents, with confidence 1 - DOUBT for all strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tableseek.llm.scratch import stored

RISK = 0.02
DOUBT = 0.05
SIZES = (50, 200, 1000)  # word counts at which a new stratum begins
LANGUAGES = ("de", "en", "es", "fr")  # others form one more stratum each size
SHARES = (0, 2, 5, 10, 20, 30, 50, 75, 100, 150, 200, 300, 400, 500, 600, 800, 950)  # per mille
GRIDS = {
    "symbols": SHARES,  # symbols per 1000 characters of words
    "lines": SHARES,  # lines that repeat an earlier one, per 1000 lines with words
    "windows": SHARES,  # words in repeated windows, per 1000 words
    "capitals": SHARES,  # A-Z per 1000 characters of words
    "length": (3500, 4000, 4500, 5000, 5500, 6000, 6500, 7000, 8000, 9000, 10000, 12000, 15000, 20000),  # characters per 1000 words
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
BLANKS = " \t\n\x0b\x0c\r"


def base_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns `keep` with BASE and `measures` (a value per rule, in thousandths, rounded up) added.

    Null and empty texts have no words and fail the base rules. Windows are compared by a 64-bit hash of their words.
    """
    keep = [c for c in keep if c not in (*BASE, "measures")]
    body = F.coalesce(F.col(text), F.lit(""))
    split = docs.select(
        *keep,
        F.filter(F.split(body, "[\\x20\\x09-\\x0D]+"), lambda w: w != "").alias("__words"),
        F.filter(F.split(body, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")).alias("__lines"),
        F.length(F.translate(body, BLANKS, "")).cast("long").alias("word_chars"),
        (F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("__capitals"),
    )
    n = F.size("__words")
    word = lambda i: F.get("__words", i)
    hashed = split.withColumn(
        "__hashes",
        F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2), word(i + 3), word(i + 4)))).otherwise(F.array().cast("array<long>")),
    )
    twice = hashed.withColumn("__sorted", F.sort_array("__hashes")).withColumn("__any", F.exists(F.transform("__sorted", lambda h, i: h == F.get("__sorted", i + 1)), lambda x: x))
    # most texts repeat no window; only the others are sorted with positions
    placed = twice.withColumn("__placed", F.when(F.col("__any"), F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at"))))))
    same = lambda x, i: F.coalesce(F.get("__placed", i)["h"] == x["h"], F.lit(False))
    found = placed.withColumn("__at", F.sort_array(F.transform(F.filter("__placed", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"])))
    covered = F.aggregate(F.transform("__at", lambda at, i: F.least(F.lit(5), F.coalesce(F.get("__at", i + 1) - at, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = found.select(
        *keep, n.cast("long").alias("n_words"), "word_chars", "n_symbols", "__capitals",
        F.size("__lines").cast("long").alias("__n_lines"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
    )
    per_mille = lambda a, b: F.when(F.col(b) > 0, F.ceil(1000 * F.col(a) / F.col(b))).otherwise(0).cast("long")
    measures = F.struct(
        per_mille("n_symbols", "word_chars").alias("symbols"), per_mille("n_dup_lines", "__n_lines").alias("lines"),
        per_mille("n_repeat_words", "n_words").alias("windows"), per_mille("__capitals", "word_chars").alias("capitals"),
        per_mille("word_chars", "n_words").alias("length"),
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return counted.select(*keep, *BASE[:-1], failed.alias("base_failed"), measures.alias("measures"))


def stratum(lang: Column, n_words: Column) -> Column:
    """One of (len(LANGUAGES) + 1) * (len(SIZES) + 1) strata."""
    size = sum((n_words >= s).cast("int") for s in SIZES)
    return F.concat_ws("/", F.when(lang.isin(*LANGUAGES), lang).otherwise("other"), size.cast("string"))


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series from 20 on."""
    x = n.cast("double")
    small = F.aggregate(F.sequence(F.lit(0), F.greatest(F.least(n, F.lit(20)), F.lit(0)).cast("int")), F.lit(0.0), lambda a, k: a + F.when(k > 1, F.log(k.cast("double"))).otherwise(0.0))
    big = x * F.log(x) - x + F.log(x * 6.283185307179586) / 2 + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * x * x * x * x * x)
    return F.when(n <= 20, small).otherwise(big)


def binomial_tail(x: Column, n: Column, chance: float) -> Column:
    """Exact probability of at most x successes in n."""
    import math

    yes, no = math.log(chance), math.log1p(-chance)
    term = lambda k: F.exp(log_factorial(n) - log_factorial(k) - log_factorial(n - k) + k * yes + (n - k) * no)
    return F.aggregate(F.sequence(F.lit(0).cast("long"), x), F.lit(0.0), lambda a, k: a + term(k))


def risk_controlled_cutoffs(measured: DataFrame, labels: DataFrame, doc_id: str = "doc_id", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """stratum, rule, cutoff: the tightest cutoff that passes, null if none does. At most 20 strata times 5 rules."""
    good = labels.groupBy(doc_id).agg(F.min("quality").alias("__quality")).where("__quality = 1").select(doc_id)
    alpha = risk / len(GRIDS)
    error = doubt / (len(GRIDS) * (len(LANGUAGES) + 1) * (len(SIZES) + 1))
    held = measured.where(~F.col("base_failed")).join(good, doc_id, "left_semi")
    rules = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"measures.{r}").alias("value")) for r in GRIDS])
    counts = held.select("stratum", F.inline(rules)).groupBy("stratum", "rule", "value").agg(F.count(F.lit(1)).alias("n"))
    grid = F.create_map(*[x for r, g in GRIDS.items() for x in (F.lit(r), F.array(*[F.lit(c).cast("long") for c in g]))])
    # values that fall between the same two cutoffs are one before the grid is laid over them
    step = F.size(F.filter(F.element_at(grid, F.col("rule")), lambda c: c < F.col("value")))
    steps = counts.groupBy("stratum", "rule", step.alias("step")).agg(F.sum("n").alias("n"))
    laid = steps.select("stratum", "rule", "step", "n", F.posexplode(F.element_at(grid, F.col("rule"))).alias("at", "cutoff"))
    tested = laid.groupBy("stratum", "rule", "cutoff").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("step") > F.col("at"), F.col("n")).otherwise(0)).alias("x"))
    passed = F.when(F.col("x") < alpha * F.col("n"), binomial_tail(F.col("x"), F.col("n"), alpha) <= error).otherwise(False)
    marked = tested.withColumn("passed", passed)
    worst = marked.groupBy("stratum", "rule").agg(F.max(F.when(~F.col("passed"), F.col("cutoff"))).alias("failed"), F.collect_list(F.when(F.col("passed"), F.col("cutoff"))).alias("fine"))
    return worst.select("stratum", "rule", F.array_min(F.filter("fine", lambda c: F.col("failed").isNull() | (c > F.col("failed")))).alias("cutoff"))


def apply_quality_rules(docs: DataFrame, labels: DataFrame, keep: list[str], text: str = "text", doc_id: str = "doc_id", lang: str = "lang", risk: float = RISK, doubt: float = DOUBT) -> DataFrame:
    """The columns `keep` with BASE and kept added: false where the base rules fail or a cutoff is exceeded.

    Documents without a usable cutoff in their stratum pass the rules. A null language belongs to the other ones; null
    labels and labels without a document count for nothing; a document labelled both good and bad is not good.
    """
    keep = [c for c in keep if c not in (*BASE, "kept")]
    carried = list(dict.fromkeys([*keep, doc_id, lang]))
    measured = base_statistics(docs, carried, text).withColumn("stratum", stratum(F.col(lang), F.col("n_words")))
    measured = stored(measured, "rules")
    cutoffs = risk_controlled_cutoffs(measured, labels, doc_id, risk, doubt)
    wide = cutoffs.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"__{r}") for r in GRIDS])
    over = F.lit(False)
    for rule in GRIDS:
        over = over | F.coalesce(F.col(f"measures.{rule}") > F.col(f"__{rule}"), F.lit(False))
    judged = measured.join(F.broadcast(wide), "stratum", "left")  # a row for each stratum, 20 at most
    return judged.select(*keep, *BASE, (~F.col("base_failed") & ~over).alias("kept"))
