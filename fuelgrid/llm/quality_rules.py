"""Quality rules by weak supervision.

Each rule votes good, votes bad or abstains. Expectation-maximisation over the vote patterns estimates, without labels,
the share of good documents and of those with each kind of fault, and how often each rule votes good, bad or abstains on
either; a document's posterior probability of being good replaces "all rules must pass". A rule between its two
thresholds abstains, and what its abstention tells is estimated like its votes. So a document that the other rules call
good survives a bad vote of a rule that errs often, and one that no rule condemns goes if abstentions are a bad sign.

Everything on the main path is DataFrame functions. Only the counts of vote patterns (3 ** rules at most, whatever the
number of documents) come to the driver, where EM runs over them.

Cases: a null or blank text has no words, so the base rule rejects it. Repeated rows are each judged. An empty table
gives an empty result. Further columns are ignored by :func:`quality_rules` and kept by :func:`keep_good`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, words, written

GOOD, BAD, ABSTAIN = 1, 0, 2
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_shouts", "n_stutters", "n_distinct", "n_plain")
#: A word of letters, with inner apostrophes or hyphens and one closing mark at most.
PLAIN = r"(?<![^\x20\x09-\x0D])\p{L}[\p{L}\p{M}'’-]*+[.,;:!?]?+(?![^\x20\x09-\x0D])"


def _vote(bad: Column, good: Column) -> Column:
    """Bad, good, or an abstention where neither holds or a count is null."""
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """The production rules over the columns of :func:`features`: name -> vote. Each fault shows in two rules or
    more, so that they can corroborate one another."""
    c, n = F.col, F.col("n_words")
    return {
        "symbols": _vote(c("n_symbols") > 0.10 * n, c("n_symbols") <= 0.01 * n),
        "plain": _vote(c("n_plain") < 0.70 * n, c("n_plain") >= 0.95 * n),
        "capitals": _vote(c("n_capitals") > 0.40 * c("word_chars"), c("n_capitals") <= 0.15 * c("word_chars")),
        "shouting": _vote(c("n_shouts") > 0.15 * n, c("n_shouts") <= 0.02 * n),
        "stutter": _vote(c("n_stutters") > 0.10 * n, c("n_stutters") <= 0.03 * n),
        "variety": _vote((n >= 20) & (c("n_distinct") < 2 * F.sqrt(n)), (n >= 20) & (c("n_distinct") >= 3.5 * F.sqrt(n))),
        "repeats": _vote(c("n_repeat_words") > 0.30 * n, c("n_repeat_words") <= 0.10 * n),
        "word_length": _vote((n > 0) & ((c("word_chars") < 2 * n) | (c("word_chars") > 15 * n)), (c("word_chars") >= 3 * n) & (c("word_chars") <= 10 * n)),
    }


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the counts of :func:`counts` for each row."""
    return counts(only(docs, id_col, text_col), text_col).select(F.col("row")[id_col].alias(id_col), *COUNTS)


def counts(docs: DataFrame, text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """Each row of ``docs`` as a struct, row, with what the rules read from its whole text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, n_capitals, n_shouts, n_stutters, n_distinct, n_plain (letters, then a closing mark at most).

    Windows of eight words are first compared by hashes, built by doubling (2, 4, 8 words) without forming their
    text. Where two hashes agree, the windows' words are compared. A text in which windows of different words share a
    hash, hardly ever seen at 64 bits, sorts all of its windows by their words.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(F.struct("*").alias("row"), F.col(f"`{text_col}`").alias("text"))
    df = df.select(
        "row",
        words(F.col("text")).alias("w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_capitals"),
        F.regexp_count(text, F.lit(PLAIN)).cast("long").alias("n_plain"),
        (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
        F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "").alias("lines"),
    )
    n = F.size("w")
    pair = lambda a, b: F.xxhash64(a, b)
    df = df.select(
        "*",
        F.zip_with("w", F.slice("w", F.lit(2), n), pair).alias("h2"),
        F.size(F.filter("w", lambda x, i: x == F.get("w", i - 1))).cast("long").alias("n_stutters"),
        F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    ).drop("lines")
    df = df.withColumn("h4", F.zip_with("h2", F.slice("h2", F.lit(3), n), pair)).drop("h2")
    df = df.withColumn("h8", F.slice(F.zip_with("h4", F.slice("h4", F.lit(5), n), pair), F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0)))).drop("h4")
    if hash_bits < 64:
        df = df.withColumn("h8", F.transform("h8", lambda h: h.bitwiseAND(F.lit((1 << hash_bits) - 1))))
    again = F.size("h8") > F.size(F.array_distinct("h8"))
    spot = lambda h, i: F.struct(h.alias("h"), (i + 1).alias("p"))
    df = df.withColumn("spots", F.when(again, F.sort_array(F.transform("h8", spot)))).drop("h8")
    like = lambda spots, x, i: F.coalesce(x["h"] == F.get(spots, i)["h"], F.lit(False))
    window = lambda p: F.slice("w", p, F.lit(WINDOW))
    met = F.filter("spots", lambda x, i: like("spots", x, i - 1) | like("spots", x, i + 1))
    df = df.withColumn("spots", met)
    apart = F.exists(F.transform("spots", lambda x, i: like("spots", x, i - 1) & (window(x["p"]) != window(F.get("spots", i - 1)["p"]))), lambda x: x)
    spelt = F.transform("spots", lambda x: F.struct(F.concat_ws(" ", window(x["p"])).alias("h"), x["p"].alias("p")))
    df = df.withColumn("spelt", F.when(apart, F.sort_array(spelt)))
    alike = F.filter("spelt", lambda x, i: like("spelt", x, i - 1) | like("spelt", x, i + 1))
    df = df.withColumn("at", F.sort_array(F.transform(F.coalesce(F.when(F.col("spelt").isNotNull(), alike), F.transform("spots", lambda x: F.struct(F.lit("").alias("h"), x["p"].alias("p")))), lambda x: x["p"])))
    step = lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW)))
    covered = F.aggregate(F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), step), F.lit(0), lambda s, x: s + x)
    return df.select(
        "row",
        n.cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        "n_capitals",
        "n_shouts",
        "n_stutters",
        "n_distinct",
        "n_plain",
    )


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


#: How often a rule is thought, before any vote, to vote bad, good or abstain: on good documents, on documents with the
#: fault that it looks for, and on documents with another fault.
ON_GOOD = {BAD: 0.03, GOOD: 0.80, ABSTAIN: 0.17}
ON_OWN = {BAD: 0.80, GOOD: 0.05, ABSTAIN: 0.15}
ON_OTHER = {BAD: 0.15, GOOD: 0.60, ABSTAIN: 0.25}
#: (share, habit of each rule) of each class: the good documents, then those with the fault of the first rule, and so on.
Classes = list[tuple[float, list[dict[int, float]]]]


def first_guess(n_rules: int, prior: float) -> Classes:
    faults = [((1 - prior) / n_rules, [ON_OWN if r == k else ON_OTHER for r in range(n_rules)]) for k in range(n_rules)]
    return [(prior if n_rules else 1.0, [ON_GOOD] * n_rules), *faults]


def estimate(patterns: Sequence[tuple[Sequence[int], int]], n_rules: int, prior: float = 0.85, rounds: int = 200, hold: float = 0.02) -> Classes:
    """EM over (votes, count) pairs: the share of each class and how often each rule gives each vote on it.

    Bad documents have faults of several kinds, and a rule that sees one may call the others good; so each rule has a
    class of bad documents of its own, that start as the fault it looks for. ``hold`` times as many documents as there
    are, and 5 besides, are thought to have been seen before, with the shares and habits of :func:`first_guess`: they
    tell the classes apart at the start, and give a sane result where there are few documents or none.
    """
    guess = classes = first_guess(n_rules, prior)
    before = 5 + hold * sum(count for _, count in patterns)
    for _ in range(rounds):
        mass = [before * share for share, _ in guess]
        seen = [[{v: before * share * p for v, p in habit.items()} for habit in habits] for share, habits in guess]
        for votes, count in patterns:
            for k, p in enumerate(posterior(votes, classes)):
                mass[k] += count * p
                for r, v in enumerate(votes):
                    seen[k][r][v] += count * p
        new = [(m / sum(mass), [{v: x / m for v, x in rule.items()} for rule in rules_]) for m, rules_ in zip(mass, seen)]
        moved = max((abs(x - old[v]) for (_, b), (_, a) in zip(new, classes) for rule, old in zip(b, a) for v, x in rule.items()), default=0.0)
        classes = new
        if moved < 1e-7:
            break
    return classes


def posterior(votes: Sequence[int], classes: Classes) -> list[float]:
    """The probability of each class: votes are independent given the class."""
    logs = [math.log(share) + sum(math.log(habit[v]) for v, habit in zip(votes, habits)) for share, habits in classes]
    top = max(logs)
    parts = [math.exp(x - top) for x in logs]
    return [x / sum(parts) for x in parts]


def learn(counted: DataFrame, votes: dict[str, Column] | None = None, prior: float = 0.85) -> Column:
    """The posterior probability of good, as an expression over the columns of :func:`counts`."""
    votes = rules() if votes is None else votes
    code = sum((v.cast("int") * 3**i for i, v in enumerate(votes.values())), F.lit(0))
    found = counted.groupBy(code.alias("code")).agg(F.count("*").alias("n")).collect()  # 3 ** rules rows at most
    patterns = [([row["code"] // 3**i % 3 for i in range(len(votes))], row["n"]) for row in found]
    classes = estimate(sorted(patterns), len(votes), prior)
    # each vote is worked out once, as an array; the classes' odds against good are sums over it
    given = F.array(*[v.cast("int") for v in votes.values()])
    good_share, on_good = classes[0]
    odds = F.lit(0.0)
    for share, habits in classes[1:]:
        weights = F.array(*[F.array(*[F.lit(math.log(h[v] / g[v])) for v in (BAD, GOOD, ABSTAIN)]) for h, g in zip(habits, on_good)])
        odds = odds + F.exp(F.aggregate(F.zip_with(given, weights, lambda v, w: F.get(w, v)), F.lit(math.log(share / good_share)), lambda a, x: a + x))
    return 1 / (1 + odds)


def judge(counted: DataFrame, quality: Column, keep_at: float = 0.5) -> DataFrame:
    """``counted`` with base_failed, quality and kept."""
    return counted.withColumns({"base_failed": base_failed(), "quality": quality, "kept": ~base_failed() & (quality >= keep_at)})


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, whole. Reads the texts twice, and shuffles none.

    The column that isn't deterministic keeps the filter above the counts: pushed below them, it would spell out each
    count's expression again wherever a rule names it.
    """
    quality = learn(features(docs))
    judged = judge(counts(docs), quality).withColumn("held", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("held") >= 0)).select("row.*")


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, quality and kept for each row of ``docs`` (doc_id, text)."""
    counted = written(features(docs))
    return judge(counted, learn(counted))


def op9_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")
