"""Quality rules by weak supervision.

Rules vote good or bad on a document or abstain. Expectation-maximisation over the counts of all
vote patterns estimates how often each rule is right on good and on bad documents, and a
document is kept by its posterior probability of being good. Features and votes are built-in
column functions; the pattern counts are at most 3 ** rules rows, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanmark.llm.common import WORD, fresh, materialise, numbered

SYMBOLS = "#*$%&|<>"
WINDOW = 8


def _repeats(df: DataFrame) -> DataFrame:
    """Add n_repeat_words: words of ``_words`` in windows of eight words found twice or more.

    Windows are hashed by doubling (pairs, fours, eights). Only where two hashes agree are
    windows sorted; the places that share a hash then cover min(8, distance to the next) words.
    """
    hashes = F.transform("_words", lambda w: F.xxhash64(w))
    df = df.withColumn("_h1", hashes)
    for step, (old, new) in zip((1, 2, 4), (("_h1", "_h2"), ("_h2", "_h4"), ("_h4", "_h8")), strict=True):
        later = F.slice(old, step + 1, F.greatest(F.size(old) - step, F.lit(0)))
        df = df.withColumn(new, F.zip_with(old, later, lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn("_win", F.slice("_h8", 1, F.greatest(F.size("_h8") - (WINDOW - 1), F.lit(0))))
    some = F.size(F.array_distinct("_win")) < F.size("_win")
    df = df.withColumn("_sorted", F.when(some, F.sort_array(F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["h"] == F.get(F.col("_sorted"), j)["h"], F.lit(False))
    df = df.withColumn("_places", F.sort_array(F.filter(F.transform("_sorted", lambda x, j: F.when(same(x, j - 1) | same(x, j + 1), x["i"])), lambda i: i.isNotNull())))
    gaps = F.transform("_places", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), j + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))


def features(docs: DataFrame) -> DataFrame:
    """The counts that rules look at, over whole texts; a null text has no words. Only doc_id and
    text are read, so other columns can have any names."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    df = df.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    # trim() takes the other white space away first, as a line of spaces has no word.
    blank = "".join(map(chr, (9, 11, 12, 13, 32)))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(blank))) > 0)
    df = df.withColumn("_lines", lines)
    ended = F.filter("_lines", lambda x: F.substring(F.rtrim(x), -1, 1).isin(".", "!", "?", '"', "”", "…", ":", ";"))
    df = df.select(
        "doc_id",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", blank + "\n", "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(F.translate("_text", "0123456789", ""))).cast("long").alias("n_digits"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.size(ended).cast("long").alias("n_ended_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
    )
    return _repeats(df).drop("_words", "_h1", "_h2", "_h4", "_h8", "_win", "_sorted", "_places")


@dataclass
class Rule:
    """``good`` and ``bad`` are conditions on the features; neither, or null, is to abstain."""

    name: str
    good: Column
    bad: Column


def default_rules() -> list[Rule]:
    """Limits in whole numbers, so that no vote hangs on a rounding."""
    c = F.col
    return [
        Rule("length", c("n_words") >= 50, c("n_words") < 20),
        Rule("word_length", c("word_chars").between(3 * c("n_words"), 9 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
        Rule("symbols", 100 * c("n_symbols") <= c("n_words"), 100 * c("n_symbols") > 10 * c("n_words")),
        Rule("digits", 100 * c("n_digits") <= 5 * c("word_chars"), 100 * c("n_digits") > 25 * c("word_chars")),
        Rule("dup_lines", 10 * c("n_dup_lines") <= c("n_lines"), 2 * c("n_dup_lines") > c("n_lines")),
        Rule("repeats", 100 * c("n_repeat_words") <= 10 * c("n_words"), 100 * c("n_repeat_words") > 30 * c("n_words")),
        Rule("endings", 100 * c("n_ended_lines") >= 70 * c("n_lines"), 100 * c("n_ended_lines") < 20 * c("n_lines")),
        Rule("variety", 100 * c("n_distinct_words") >= 30 * c("n_words"), 100 * c("n_distinct_words") < 10 * c("n_words")),
    ]


@dataclass
class Model:
    """prior: of a good document; good[j] and bad[j]: how likely rule j's votes (1, 0, -1 for abstaining) are on either kind."""

    prior: float
    good: list[dict[int, float]] = field(default_factory=list)
    bad: list[dict[int, float]] = field(default_factory=list)

    def log_odds(self, votes: tuple[int, ...]) -> float:
        return math.log(self.prior) - math.log1p(-self.prior) + sum(math.log(g[v]) - math.log(b[v]) for v, g, b in zip(votes, self.good, self.bad, strict=True))


def fit(patterns: dict[tuple[int, ...], int], rules: int, rounds: int = 100, prior: float = 0.8, firm: float = 1.0, loose: float = 0.005) -> Model:
    """Expectation-maximisation over counts of vote patterns.

    At the start a bad vote on a good document is an exception, one vote in a thousand, while a bad
    document, which as a rule offends only some rules, gets three bad votes in ten. The belief on good
    documents keeps the weight of ``firm`` times the corpus, that on bad ones of ``loose`` times, so that
    the two kinds can't change places and a kind of junk that breaks one rule isn't taken for good.
    """
    total = sum(patterns.values())
    cast = [{v: sum(n for p, n in patterns.items() if p[j] == v) / max(total, 1) for v in (1, 0, -1)} for j in range(rules)]

    def start(j: int, offends: float) -> dict[int, float]:
        voting = max(1e-3, min(1 - 1e-3, 1 - cast[j][-1]))
        return {1: (1 - offends) * voting, 0: offends * voting, -1: 1 - voting}

    base_good, base_bad = [start(j, 0.001) for j in range(rules)], [start(j, 0.3) for j in range(rules)]
    model = Model(prior, base_good, base_bad)
    if not total:
        return model
    sure_good, sure_bad = max(1.0, firm * total), max(1.0, loose * total)
    for _ in range(rounds):
        sure = {p: 1 / (1 + math.exp(-max(-700.0, min(700.0, model.log_odds(p))))) for p in patterns}
        n_good = sum(n * sure[p] for p, n in patterns.items())
        seen_good = [dict.fromkeys((1, 0, -1), 0.0) for _ in range(rules)]
        seen_bad = [dict.fromkeys((1, 0, -1), 0.0) for _ in range(rules)]
        for p, n in patterns.items():
            for j, v in enumerate(p):
                seen_good[j][v] += n * sure[p]
                seen_bad[j][v] += n * (1 - sure[p])
        new = Model(
            (n_good + sure_bad * prior) / (total + sure_bad),
            [{v: (seen_good[j][v] + sure_good * base_good[j][v]) / (n_good + sure_good) for v in (1, 0, -1)} for j in range(rules)],
            [{v: (seen_bad[j][v] + sure_bad * base_bad[j][v]) / (total - n_good + sure_bad) for v in (1, 0, -1)} for j in range(rules)],
        )
        moved = abs(new.prior - model.prior) + max((abs(new.bad[j][0] - model.bad[j][0]) for j in range(rules)), default=0.0)
        model = new
        if moved < 1e-9:
            break
    return model


def judge(docs: DataFrame, rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """The features of each row of ``docs`` (doc_id, text) with base_failed, probability and kept.

    base_failed: fewer than 20 words, or over 30 words in 100 in repeated windows. Other documents
    are kept if their posterior probability of being good is at least ``least``; the rules are fitted
    on these, as votes on what has failed already would teach them one kind of bad only. Null and empty
    texts fail the base; null ids and repeated rows are judged like others, row by row; an empty table gives no rows.
    """
    rules = default_rules() if rules is None else rules
    vote = lambda r: F.when(F.coalesce(r.good, F.lit(False)), 1).when(F.coalesce(r.bad, F.lit(False)), 0).otherwise(-1)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    digits = [F.expr("1").cast("long") * 3**j * (vote(r) + 1) for j, r in enumerate(rules)]
    pattern = sum(digits[1:], digits[0]) if digits else F.lit(0).cast("long")
    voted = materialise(features(docs).withColumn("base_failed", failed).withColumn("pattern", pattern), "votes")
    counts = {r["pattern"]: r["count"] for r in voted.where(~F.col("base_failed")).groupBy("pattern").count().collect()}  # at most 3 ** rules rows
    decode = lambda p: tuple(p // 3**j % 3 - 1 for j in range(len(rules)))
    model = fit({decode(p): n for p, n in counts.items()}, len(rules))
    weights = []
    for j in range(len(rules)):
        odds = [math.log(model.good[j][v]) - math.log(model.bad[j][v]) for v in (-1, 0, 1)]
        weights.append(F.element_at(F.array(*map(F.lit, odds)), (F.floor(F.col("pattern") / 3**j) % 3 + 1).cast("int")))
    log_odds = sum(weights, F.lit(math.log(model.prior) - math.log1p(-model.prior)))
    probability = 1 / (1 + F.exp(-log_odds))
    return voted.withColumn("probability", probability).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= least))


def keep(docs: DataFrame, rules: list[Rule] | None = None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns. Rows of one doc_id are told apart
    by their place, so that each is judged by its own text."""
    row = fresh(docs, "row")
    stored = numbered(docs, row)
    verdicts = judge(stored.select(F.col(row).alias("doc_id"), "text"), rules, least)
    kept = verdicts.where("kept").select(F.col("doc_id").alias(row))
    return stored.join(kept.hint("merge"), row, "left_semi").select(*docs.columns)
