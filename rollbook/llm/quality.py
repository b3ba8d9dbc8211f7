"""Quality filtering by weak supervision, with DataFrame functions only.

Rules look at a document's features and vote good (1), bad (-1) or abstain (0). Documents with the same votes count as one
row, so expectation-maximisation runs over at most 3 ^ rules rows: the E step is a column expression with the present
accuracies as literals, the M step one aggregate. It learns from documents that pass the base limits (20 words, 30 % of words
in repeated windows), as the others are out anyway. The posterior probability of good quality replaces all-must-pass.

Null text has no words. Repeated rows come back repeated, a table without rows gives none; columns of the input other than
id and text are ignored. Two different 8-word windows of a text are taken for equal if their 64-bit hashes meet.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollbook.llm.shared import stored

WINDOW = 8
ROUNDS = 15
FIRST_ACCURACY, FIRST_PRIOR = 0.8, 0.8
MOST = 0.999
#: Weight of the first belief in an accuracy, as a share of all documents.
HOLD = 0.002

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: A word of letters, with a comma or full stop at most.
PLAIN_WORD = r"(?<![^\x20\x09-\x0D])\p{L}+[,.]?(?![^\x20\x09-\x0D])"


def _size_without(text: Column, characters: str) -> Column:
    return F.length(F.translate(text, characters, ""))


def features(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and counts of every whole text."""
    text = F.col("text")
    df = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: F.length(F.translate(line, BLANKS, "")) > 0)
    df = df.select(
        "id",
        _size_without(text, BLANKS).cast("long").alias("word_chars"),
        (F.length(text) - _size_without(text, SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length(text) - _size_without(text, ".!?")).cast("long").alias("n_stops"),
        (F.length(text) - _size_without(text, "0123456789")).cast("long").alias("n_digits"),
        F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")).cast("long").alias("n_capitals"),
        F.length(F.regexp_replace(text, r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
        F.regexp_count(text, F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
        lines.alias("lines"),
        F.transform(words, lambda w: F.xxhash64(w)).alias("words"),
    )
    df = df.select("*", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), F.size(F.array_distinct("words")).cast("long").alias("n_distinct"))
    df = df.withColumn("n_dup_lines", F.col("n_lines") - F.size(F.array_distinct("lines"))).drop("lines")
    at = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    hashed = F.transform(at, lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(WINDOW)]))
    df = df.withColumn("windows", hashed)
    # only texts with a window that occurs twice are sorted
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("placed", F.when(twice, placed))

    def meets(e: Column, n: Column) -> Column:
        return (F.get("placed", n - 1)["h"] == e["h"]) | (F.get("placed", n + 1)["h"] == e["h"])

    both = F.filter("placed", lambda e, n: F.coalesce(meets(e, n), F.lit(False)))
    df = df.withColumn("starts", F.sort_array(F.transform(both, lambda e: e["i"])))
    reach = F.transform("starts", lambda s, n: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", n + 1) - s, F.lit(WINDOW))))
    repeated = F.coalesce(F.aggregate(reach, F.lit(0).cast("long"), lambda total, n: total + n), F.lit(0))
    df = df.withColumn("n_repeat_words", repeated)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return df.drop("words", "windows", "placed", "starts").withColumn("base_failed", failed)


def _vote(good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


def rules() -> dict[str, Column]:
    """Votes from the columns of `features`. A rule abstains between its two limits; each of them can be crossed by a text that
    passes the base limits, and each looks at something else: symbols, marks, words of letters, letters, capitals, variety,
    repeats, lines, word length."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    symbols, stops = F.col("n_symbols") / words, F.col("n_stops") / words
    plain, letters, capitals = F.col("n_plain") / words, F.col("n_letters") / chars, F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1))
    variety, repeats = F.col("n_distinct") / F.sqrt(words), F.col("n_repeat_words") / words
    lines, mean = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)), F.col("word_chars") / words
    return {
        "symbols": _vote(symbols <= 0.02, symbols > 0.1),
        "marks": _vote(stops.between(0.02, 0.3), (stops > 0.6) | ((stops < 0.005) & (F.col("n_words") >= 60))),
        "plain": _vote(plain >= 0.9, plain < 0.7),
        "letters": _vote(letters >= 0.9, letters < 0.8),
        "capitals": _vote(capitals <= 0.15, capitals > 0.5),
        "variety": _vote(variety >= 3, variety < 2),
        "repeats": _vote(repeats <= 0.02, repeats > 0.12),
        "lines": _vote(lines <= 0.02, lines > 0.2),
        "word_length": _vote(mean.between(3.5, 9), (mean < 2.5) | (mean > 14)),
    }


def posterior(accuracies: dict[str, tuple[float, float]], prior: float) -> Column:
    """Probability of good quality, given the votes and each rule's accuracy on good and on bad documents."""
    odds = F.lit(math.log(prior / (1 - prior)))
    for name, (good, bad) in accuracies.items():
        vote, up, down = F.col(f"vote_{name}"), math.log(good / (1 - bad)), math.log((1 - good) / bad)
        odds = odds + F.when(vote == 1, up).when(vote == -1, down).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def estimate(votes: DataFrame, names: list[str], rounds: int = ROUNDS) -> tuple[dict[str, tuple[float, float]], float]:
    """Accuracies of the rules and share of good documents, by expectation-maximisation over vote patterns.

    Each accuracy starts from, and is held by `HOLD` of all documents to, the belief that rules are mostly right.
    """
    patterns = stored(votes.groupBy(*[f"vote_{n}" for n in names]).agg(F.count("*").alias("n")).coalesce(1), "patterns")
    accuracies, prior = dict.fromkeys(names, (FIRST_ACCURACY, FIRST_ACCURACY)), FIRST_PRIOR
    for _ in range(rounds):
        good, bad = F.col("n") * F.col("good"), F.col("n") * (1 - F.col("good"))
        found = [F.sum("n").alias("total"), F.sum(good).alias("good")]
        for n in names:
            vote = F.col(f"vote_{n}")
            found += [F.sum(F.when(vote == 1, good)).alias(f"good_right_{n}"), F.sum(F.when(vote != 0, good)).alias(f"good_cast_{n}")]
            found += [F.sum(F.when(vote == -1, bad)).alias(f"bad_right_{n}"), F.sum(F.when(vote != 0, bad)).alias(f"bad_cast_{n}")]
        row = patterns.withColumn("good", posterior(accuracies, prior)).agg(*found).first()
        if not row["total"]:
            break
        held = HOLD * row["total"]

        def share(kind: str, name: str, row=row, held=held) -> float:  # noqa: ANN001
            right, cast = row[f"{kind}_right_{name}"] or 0.0, row[f"{kind}_cast_{name}"] or 0.0
            return min(max((right + held * FIRST_ACCURACY) / (cast + held), 1 - MOST), MOST)

        before = [prior, *(v for pair in accuracies.values() for v in pair)]
        prior = min(max(row["good"] / row["total"], 0.01), 0.99)
        accuracies = {n: (share("good", n), share("bad", n)) for n in names}
        after = [prior, *(v for pair in accuracies.values() for v in pair)]
        if max(abs(x - y) for x, y in zip(before, after, strict=True)) < 1e-4:
            break
    return accuracies, prior


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """Features, votes, posterior `quality` and `kept` of every document."""
    votes = rules()
    table = features(docs, id_column, text_column).select("*", *[v.alias(f"vote_{n}") for n, v in votes.items()])
    table = stored(table, "votes")
    accuracies, prior = estimate(table.filter(~F.col("base_failed")), list(votes))
    judged = table.withColumn("quality", posterior(accuracies, prior))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
