"""Quality rules with risk-controlled cutoffs, in DataFrame functions alone.

Fixed base rules reject very short and self-repeating texts. The further rules each compare one score
of a text with a cutoff. A rule set is one step of ``LADDERS``, with a cutoff for every rule, and rejects
what any rule rejects; steps go from lenient to strict. Per stratum (language) a labelled holdout decides
how far to go: for each step the good documents that its rule set would reject are counted, and the exact
binomial tail tests whether the true share of rejected good documents can be above ``alpha``. Steps are
tested in fixed sequence from the most lenient until one is not proven, which needs no correction; over
strata the level is ``delta / strata`` (Bonferroni). So with probability 1 - delta every stratum loses at
most ``alpha`` of its good documents to the learned rules. A stratum with too few labels to prove the
first step (about 180 good ones for alpha 0.02 and four strata) has no rejections beyond the base. Equal texts
of a stratum count once in the holdout, as copies are no independent draws, so the promise is about different
texts; near copies still count apart.

Edge cases: null text has no words and fails the base; a null language is a stratum; documents without
label are judged by the step of their stratum; of several labels of a document the best counts; a null
label counts as none; repeated documents are each judged, but count once if labelled; a text counts as good if any of its labels says so; texts of any
length are taken whole, in one row; other columns are not looked at; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.binomial import lower_tail
from quantloom.session import written

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: Share of good documents of a stratum that the learned rules may reject, and the risk of exceeding it.
ALPHA, DELTA = 0.02, 0.1
#: Cutoffs by rule, a step each, from lenient to strict; a rule rejects scores above its cutoff.
LADDERS = {
    "symbols": (0.3, 0.2, 0.15, 0.1, 0.08, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01),
    "dup_lines": (0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15),
    "repeats": (0.2, 0.2, 0.19, 0.19, 0.18, 0.18, 0.17, 0.16, 0.15, 0.13, 0.11, 0.09),
    "upper": (0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.28, 0.25, 0.22, 0.2, 0.18, 0.15),
    "bangs": (0.1, 0.08, 0.07, 0.06, 0.05, 0.04, 0.03, 0.02, 0.015, 0.01, 0.008, 0.006),
}
STEPS = 12
#: Beyond so many strata the table of steps is joined without a broadcast.
MAX_BROADCAST_STRATA = 10_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _ratio(a: str, b: str) -> Column:
    return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))


def rules() -> dict[str, Column]:
    """Score of each learned rule, from the columns of :func:`features`."""
    return {
        "symbols": _ratio("n_symbols", "word_chars"),
        "dup_lines": _ratio("n_dup_lines", "n_lines"),
        "repeats": _ratio("n_repeat_words", "n_words"),
        "upper": _ratio("n_upper", "word_chars"),
        "bangs": _ratio("n_bangs", "word_chars"),
    }


def features(docs: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """doc_id, stratum, digest (a hash of the text), the counts of COUNTS, n_lines, n_upper and n_bangs, and the columns ``keep``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = list(keep or [])
    names = ["_doc", "_stratum", "_digest", *(f"_keep{i}" for i in range(len(kept)))]
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_doc"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("_stratum"),
        F.xxhash64(text).alias("_digest"),
        *[c.alias(f"_keep{i}") for i, c in enumerate(kept)],
        text.alias("_text"),
        F.filter(F.split(text, SPACE), lambda w: w != "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("_lines"),
    )
    counted = rows.select(
        *names,
        F.size("_words").alias("_n"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        (F.length("_text") - F.length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.length("_text") - F.length(F.translate("_text", "!", ""))).cast("long").alias("n_bangs"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    plain = ["word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_upper", "n_bangs"]
    at = lambda i: F.get(F.col("_hashes"), i)
    hashed = counted.select(
        *names,
        "_n",
        *plain,
        F.when(
            F.col("_n") > WINDOW,
            F.transform(F.slice("_hashes", 1, F.greatest(F.col("_n") - (WINDOW - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *(at(i + j) for j in range(1, WINDOW)))),
        ).alias("_windows"),
    )
    # Windows found twice: neighbours in the order of hashes; only in texts that have any.
    ordered = hashed.select(
        *names,
        "_n",
        *plain,
        F.when(
            F.size(F.array_distinct("_windows")) < F.size("_windows"),
            F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ).alias("_sorted"),
    )
    same = lambda x, i: F.coalesce(F.get(F.col("_sorted"), i)["h"] == x["h"], F.lit(False))
    found = ordered.select(
        *names,
        "_n",
        *plain,
        F.sort_array(F.transform(F.filter("_sorted", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("_starts"),
    )
    # The row number keeps filters on the counts above this point: pushed down, they would repeat the
    # nested array functions once per reference.
    gaps = F.transform("_starts", lambda p, j: F.when(j == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(F.col("_starts"), j - 1))))
    return found.select(
        F.col("_doc").alias("doc_id"),
        F.col("_stratum").alias("stratum"),
        F.col("_digest").alias("digest"),
        *[F.col(f"_keep{i}") for i in range(len(kept))],
        F.col("_n").cast("long").alias("n_words"),
        *plain,
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda a, g: a + g), F.lit(0)).cast("long").alias("n_repeat_words"),
        F.monotonically_increasing_id().alias("_at"),
    ).where("_at >= 0").drop("_at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def rejecting_step() -> Column:
    """The first step, from 1, whose rule set rejects a text; null if none does."""
    scores = rules()
    return F.least(*[F.coalesce(*[F.when(scores[r] > c, F.lit(k + 1)) for k, c in enumerate(cuts)], F.lit(STEPS + 1)) for r, cuts in LADDERS.items()])


def fit(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """Steps: stratum, n_good (different good texts), n_rejected (of those, by the step) and step (0: no rule set is proven)."""
    best = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"))
    good = feats.where(~base_failed()).select("doc_id", "stratum", "digest", rejecting_step().alias("step")).join(best.where("quality >= 1").select("doc_id"), "doc_id")
    rejected = F.array(*[F.sum((F.col("step") <= k).cast("long")) for k in range(1, STEPS + 1)])
    # Copies of a text are one draw of it; the tail is that of independent draws.
    good = good.dropDuplicates(["stratum", "digest"])
    per_stratum = written(good.groupBy("stratum").agg(F.count("*").alias("n_good"), rejected.alias("rejected")), "strata")
    level = delta / max(1, per_stratum.count())
    # What a step rejects, the next ones reject too, so the proven steps are the first ones.
    proven = F.size(F.filter("rejected", lambda k: lower_tail(k, F.col("n_good"), alpha) <= F.lit(level)))
    taken = per_stratum.select("stratum", "n_good", "rejected", proven.alias("step"))
    return written(taken.select("stratum", "n_good", F.when(F.col("step") > 0, F.get("rejected", F.col("step") - 1)).otherwise(F.lit(0)).alias("n_rejected"), "step"), "steps")


def judge(feats: DataFrame, steps: DataFrame) -> DataFrame:
    """The features with base_failed and kept; the steps are broadcast after their number is checked."""
    small = steps.select("stratum", "step")
    small = F.broadcast(small) if small.count() <= MAX_BROADCAST_STRATA else small
    over = rejecting_step() <= F.coalesce("step", F.lit(0))
    return feats.join(small, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~over).drop("step")


def keep_good(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The documents that pass all rules, with all their columns. Documents and their features are written
    once, as computing the features takes far longer than a second read; texts are never shuffled."""
    feats = written(features(docs, keep=[F.struct(*[F.col(f"`{c}`") for c in docs.columns])]), "features")
    judged = judge(feats, fit(feats.drop("_keep0"), labels, alpha, delta))
    return judged.where("kept").select(*[F.col("_keep0").getField(c).alias(c) for c in docs.columns])
