"""Quality rules whose cutoffs are chosen on labelled texts with a guarantee.

Every rule rejects a text when a statistic passes a cutoff of its ladder, mild steps first.  What is
bounded is the share of good texts that *any* rule rejects, so the limit is not split over the rules.  A
combination of steps is accepted when the exact binomial test says that it falsely rejects at most
``limit`` of the good texts of the stratum: ``P(Binomial(n, limit) <= k) <= risk``, where the combination
rejects ``k`` of its ``n`` labelled good texts (this is the Clopper-Pearson upper bound).  A stratum may err
with probability ``error / strata``, spent in halves:

* one sequence of combinations, each stricter in one rule, is tried until the first that fails, all at
  the first half (fixed-sequence testing: many tries cost nothing).  Its order comes from the labelled
  junk alone: steps that reject more of it come first, mild ones before strict ones.  Junk says nothing about the
  good texts of the test, so for them the order is fixed;
* after a failure the rules that did not fail go on along it, each combination at the second half divided
  by the number of all combinations (Bonferroni), so one rule that good texts break holds up the others
  only where labels are few.

All rules together then reject at most ``limit`` of the good texts of every stratum, with probability
``1 - error`` over all strata at once.  The first step needs ``log(error / 2 / strata) / log(1 - limit)``
good labels without a false reject (252 at 2 % with four strata); a stratum with fewer gets no cutoff and
rejects nothing.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import whole_text, written
from fleetlens.llm.text import pieces, windows, word_hashes, word_spans
from fleetlens.plans.sizes import bounded

BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50

_SYMBOLS = np.zeros(256, dtype=bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


@dataclass(frozen=True)
class Rule:
    """Rejects if ``top / bottom`` (integers) is above, or with ``low`` below, a step of the ladder."""

    name: str
    top: str
    bottom: str
    steps: tuple[float, ...]
    low: bool = False

    def value(self) -> Column:
        return F.col(self.top) / F.greatest(F.col(self.bottom), F.lit(1))

    def hit(self, cutoff: Column) -> Column:
        return self.value() < cutoff if self.low else self.value() > cutoff


# from mild to strict
RULES = (
    Rule("symbols", "n_symbols", "n_words", (4.0, 3.0, 2.5, 2.0, 1.5, 1.0, 0.75, 0.5, 0.3, 0.2, 0.1, 0.05)),
    Rule("repeats", "n_repeat_words", "n_words", (0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    Rule("lines", "n_dup_lines", "n_words", (0.2, 0.15, 0.1, 0.08, 0.06, 0.04, 0.02, 0.01)),
    Rule("long_words", "word_chars", "n_words", (20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0)),
    Rule("short_words", "word_chars", "n_words", (2.0, 2.5, 3.0, 3.25, 3.5, 3.75, 4.0), low=True),
)


def _repeated(words: np.ndarray) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    value, _ = windows(words, np.array([0, len(words)]), 3)
    _, which, count = np.unique(value, return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(len(words), dtype=bool)
    for i in range(3):
        covered[i:i + len(again)] |= again
    return int(covered.sum())


def _dup_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def text_stats(text: Column) -> Column:
    """The five counts of a whole text as a struct; null counts as empty.

    ``n_symbols`` counts ``[#*$%&|<>]`` as a class of characters: the listed signs, no brackets.
    """

    @F.arrow_udf(f"struct<{STATS.replace(' long', ':bigint')}>")
    def counted(texts: pa.Array) -> pa.Array:
        out: list[list[int]] = [[] for _ in range(5)]
        for first, end, offsets, data in pieces(texts):
            words, first_word = word_hashes(offsets, data, lower=False)
            starts, ends = word_spans(offsets, data)
            letter = (data & 0xC0) != 0x80
            seen = np.concatenate([[0], np.cumsum(letter)])
            chars = np.concatenate([[0], np.cumsum(seen[ends] - seen[starts])])
            symbols = np.concatenate([[0], np.cumsum(_SYMBOLS[data])])
            out[0] += np.diff(first_word).tolist()
            out[1] += np.diff(chars[first_word]).tolist()
            out[2] += np.diff(symbols[offsets]).tolist()
            raw = data.tobytes()
            for i in range(end - first):
                out[3].append(_dup_lines(raw[offsets[i]:offsets[i + 1]]))
                out[4].append(_repeated(words[first_word[i]:first_word[i + 1]]))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in out],
                                          [f.split()[0] for f in STATS.split(", ")])

    return counted(text)


def base_failed() -> Column:
    return ((F.col("n_words") < BASE_MIN_WORDS)
            | (100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words")))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(Binomial(n, p) <= k), summed from its largest term downwards."""
    if k >= n:
        return 1.0
    log_term = (math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                + k * math.log(p) + (n - k) * math.log1p(-p))
    if k > n * p:  # the upper tail is the short one
        term = total = math.exp(log_term) * (n - k) / (k + 1) * p / (1 - p)
        j = k + 1
        while j < n and term > total * 1e-17:
            term *= (n - j) / (j + 1) * p / (1 - p)
            total += term
            j += 1
        return max(0.0, 1.0 - total)
    term = total = 1.0
    for j in range(k, 0, -1):
        term *= j / (n - j + 1) * (1 - p) / p
        total += term
        if term < total * 1e-17:
            break
    return min(1.0, math.exp(log_term + math.log(total)))


def accepted_step(false_rejects: list[int], n: int, limit: float, error: float) -> int:
    """How many steps of a ladder pass one after the other."""
    for i, k in enumerate(false_rejects):
        if binomial_tail(k, n, limit) > error:
            return i
    return len(false_rejects)


def _rejected(first: np.ndarray, count: np.ndarray, steps: tuple[int, ...]) -> int:
    """Texts that some rule rejects after so many of its steps; ``first`` has the first that does."""
    return int(count[(first < np.array(steps)).any(1)].sum())


def sequence_of_steps(first: np.ndarray, junk: np.ndarray, lengths: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(rule that moves, steps of all rules), from mild to strict.

    All ladders are climbed together; moves that reject no further junk wait until the others are done.
    """
    now, out = (0,) * len(lengths), []
    for useful in (True, False):
        for level in range(1, max(lengths) + 1):
            for r, n in enumerate(lengths):
                to = level * n // max(lengths)
                then = (*now[:r], to, *now[r + 1:])
                if to > now[r] and not (useful and _rejected(first, junk, then) == _rejected(first, junk, now)):
                    now = then
                    out.append((r, now))
    return out


def accepted_steps(first: np.ndarray, good: np.ndarray, junk: np.ndarray, lengths: list[int], limit: float,
                   error: float) -> tuple[int, ...]:
    """Steps of each rule that together falsely reject at most ``limit``, but for probability ``error``."""
    n, moves = int(good.sum()), sequence_of_steps(first, junk, lengths)
    passed = accepted_step([_rejected(first, good, steps) for _, steps in moves], n, limit, error / 2)
    now = moves[passed - 1][1] if passed else (0,) * len(lengths)
    risk, failed = error / 2 / math.prod(k + 1 for k in lengths), {r for r, _ in moves[passed:passed + 1]}
    for r, steps in moves[passed:]:
        if r not in failed:
            then = (*now[:r], steps[r], *now[r + 1:])
            if binomial_tail(_rejected(first, good, then), n, limit) <= risk:
                now = then
            else:
                failed.add(r)
    return now


def learn_cutoffs(labelled: DataFrame, stratum: str, limit: float, error: float,
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per stratum: its number of good texts, and a cutoff per rule (null: never rejects).

    ``labelled`` has the statistics and the stratum of the labelled texts that pass the base rules, and
    ``good``; without that column all are good.  Texts meet as counts per stratum and first rejecting step
    of each rule, so a task holds at most as many rows as there are combinations of steps.
    """
    names, lengths = [f"first_{r.name}" for r in rules], [len(r.steps) for r in rules]
    is_good = F.col("good") if "good" in labelled.columns else F.lit(True)
    # a step that rejects is followed by steps that reject
    first = [sum(((~r.hit(F.lit(s))).cast("int") for s in r.steps), F.lit(0)).alias(x) for r, x in zip(rules, names)]
    counts = written(labelled.select(stratum, is_good.alias("good"), *first).groupBy(stratum, *names).agg(
        F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_junk")), "steps")
    n_strata = max(counts.where("n_good > 0").select(stratum).distinct().count(), 1)

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        steps = accepted_steps(frame[names].to_numpy(), frame["n_good"].to_numpy(), frame["n_junk"].to_numpy(),
                               lengths, limit, error / n_strata)
        out = frame[[stratum]].head(1).assign(n_good=frame["n_good"].sum())
        for r, k in zip(rules, steps):
            out[f"cut_{r.name}"] = pd.array([r.steps[k - 1] if k else None], "Float64")
        return out

    kept = counts.schema[stratum].dataType.simpleString()
    return counts.groupBy(stratum).applyInPandas(choose, f"`{stratum}` {kept}, n_good long, "
                                                 + ", ".join(f"cut_{r.name} double" for r in rules))


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", limit: float = 0.02,
          error: float = 0.05, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A row per document: id, stratum, statistics, ``base_failed``, ``rule_failed``, ``kept``.

    ``labels`` has ``doc_id`` and ``quality`` (1: good); labels with a null take no part, and an
    id that is labelled twice counts as good only if every label says so.  Null and empty texts have
    no words and fail the base rules.  A null stratum is a stratum of its own.  Repeated documents
    are judged alike.  Statistics are computed once, into a table of eight numbers per document.
    """
    stats = written(docs.select("doc_id", F.col(stratum), _digest(text).alias("text_digest"),
                                text_stats(whole_text(text)).alias("s"))
                    .select("doc_id", stratum, "text_digest", "s.*").withColumn("base_failed", base_failed()), "stats")
    marks = (labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy("doc_id").agg((F.min("quality") == 1).alias("good")))
    cutoffs = written(learn_cutoffs(stats.where("NOT base_failed").join(marks, "doc_id"),
                                    stratum, limit, error, rules), "cutoffs")
    # strata are few for a language; a stratum column with many values is joined by shuffle
    small = bounded(cutoffs.withColumnRenamed(stratum, "_stratum"))
    failed = F.lit(False)
    for r in rules:
        failed = failed | F.coalesce(r.hit(F.col(f"cut_{r.name}")), F.lit(False))
    return (stats.join(small, F.col(stratum).eqNullSafe(F.col("_stratum")), "left").drop("_stratum")
            .withColumn("rule_failed", failed)
            .withColumn("kept", ~F.col("base_failed") & ~F.col("rule_failed")))


def _digest(text: str) -> Column:
    return F.xxhash64(whole_text(text))


def keep_good(docs: DataFrame, labels: DataFrame, stratum: str = "lang", text: str = "text", **options) -> DataFrame:
    """The documents that ``judge`` keeps, with their own columns, whatever their names.

    Rows meet their verdict on id, stratum and a digest of the text, so every row goes by its own text.
    """
    bad = (judge(docs, labels, stratum, text=text, **options).where("NOT kept")
           .select(F.col("doc_id").alias("_i"), F.col(stratum).alias("_s"), F.col("text_digest").alias("_d")).distinct())
    rows = docs.select(F.struct("*").alias("_row"), F.col("doc_id").alias("_id"), F.col(stratum).alias("_stratum"),
                       _digest(text).alias("_digest"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & F.col("_stratum").eqNullSafe(F.col("_s")) & (F.col("_digest") == F.col("_d"))
    return rows.join(bad, same, "left_anti").select("_row.*")
