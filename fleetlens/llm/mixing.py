"""Mixing sources to target weights by temperature, in DataFrame operations only.

A source with token share ``p`` gets the weight ``p**a / sum(p**a)``.  At ``a = 1`` the mixture is the
corpus, at 0 every source weighs the same; in between the entropy of the weights falls with ``a``, and
so does the most often that a source must be repeated.  The exponent is found by bisection, several
halvings in one small aggregation over the sources: the one at which the weights reach the target entropy,
or the smallest that respects the repetition limit, whichever is larger.

A weight becomes a budget of tokens.  The documents of a source are dealt into blocks of about
``BLOCK_DOCS``; each pass over the source takes its blocks in a new random order, and the documents of
a block in a new random order, until the budget is spent (the last document may pass it).  So a budget
below the source's size is a random part, one above it whole passes and a random part, and no
window ever holds more than one block or one row per block.

A document costs its words and one end mark, so null and empty texts cost 1.  A null source is a source
of its own.  Repeated rows are documents of their own.  Random orders are digests of ids, so a rerun
and a lost executor give the same rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import whole_text, written

BLOCK_DOCS = 256
HALVINGS_AT_ONCE, ROUNDS = 4, 9
_OWN = ("_src", "_tokens", "_mark", "_hash", "_blocks", "_block", "_budget", "_epochs", "_size", "_start")


@dataclass(frozen=True)
class Mixture:
    """``entropy_gain``: target entropy, as the part of the way from the corpus to equal weights;
    ``max_repeats``: passes over any source; ``budget_share``: tokens wanted, as a share of the corpus."""

    entropy_gain: float = 0.5
    max_repeats: float = 4.0
    budget_share: float = 1.0
    seed: int = 17


def with_tokens(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    digest = F.md5(whole_text(text).cast("binary"))
    return (docs.withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("null")))
            .withColumn("_tokens", F.regexp_count(whole_text(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + 1)
            .withColumn("_mark", F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), digest))
            .withColumn("_hash", F.conv(F.substring(F.md5(F.col("_mark").cast("binary")), 1, 15), 16, 10).cast("long")))


def find_exponent(sources: DataFrame, mixture: Mixture) -> float:
    """``sources`` has ``share``.  Only sums come back to the driver, so any number of sources will do."""
    first = sources.agg(F.sum(-F.col("share") * F.log("share")), F.count(F.lit(1))).first()
    if not first[1]:
        return 1.0
    target = first[0] + mixture.entropy_gain * (math.log(first[1]) - first[0])
    low, high = {"entropy": 0.0, "repeats": 0.0}, {"entropy": 1.0, "repeats": 1.0}
    parts = 1 << HALVINGS_AT_ONCE
    for _ in range(ROUNDS):
        spots = {k: [low[k] + (high[k] - low[k]) * i / parts for i in range(1, parts)] for k in low}
        log_share = F.log("share")
        asked = []
        for k, exps in spots.items():
            for i, a in enumerate(exps):
                power = F.exp(log_share * a)
                asked += [F.sum(power).alias(f"z_{k}_{i}"),
                          (F.sum(power * log_share) if k == "entropy" else F.max(F.exp(log_share * (a - 1))))
                          .alias(f"x_{k}_{i}")]
        got = sources.agg(*asked).first()
        for k, exps in spots.items():
            above = []  # exponents that are too small
            for i, a in enumerate(exps):
                z, x = got[f"z_{k}_{i}"], got[f"x_{k}_{i}"]
                if k == "entropy":
                    above.append(math.log(z) - a * x / z > target)
                else:
                    above.append(mixture.budget_share * x / z > mixture.max_repeats)
            n = above.index(False) if False in above else len(above)
            edges = [low[k], *exps, high[k]]
            low[k], high[k] = edges[n], edges[n + 1]
    return round(max(high["entropy"], high["repeats"] if high["repeats"] > 2.0 ** -30 else 0.0), 9)


def weights(sized: DataFrame, mixture: Mixture) -> DataFrame:
    """Per source: tokens, documents, weight, budget in tokens, passes, blocks."""
    sums = written(sized.groupBy("_src").agg(F.sum("_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs")),
                   "sources")
    total = sums.agg(F.sum("tokens")).first()[0] or 0
    shares = sums.withColumn("share", F.col("tokens") / F.lit(float(max(total, 1))))
    a = find_exponent(shares, mixture)
    z = shares.agg(F.sum(F.pow("share", F.lit(a)))).first()[0] or 1.0
    return (shares.withColumn("weight", F.pow("share", F.lit(a)) / F.lit(z))
            .withColumn("_budget", F.floor(F.col("weight") * F.lit(float(total) * mixture.budget_share)).cast("long"))
            .withColumn("_epochs", F.ceil(F.col("_budget") / F.col("tokens")).cast("int"))
            .withColumn("_blocks", F.ceil(F.col("docs") / F.lit(float(BLOCK_DOCS))).cast("long")))


def _in_block(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """Rows with their block; the table of sources has a row each, so Spark may split a large source."""
    known = per_source.select("_src", "_blocks")
    return rows.join(known, "_src").withColumn("_block", F.col("_hash") % F.col("_blocks")).drop("_blocks")


def mix(docs: DataFrame, sized: DataFrame, mixture: Mixture = Mixture()) -> DataFrame:
    """The rows of ``docs`` as often as the mixture has them, with ``epoch``, ``block``, ``position``
    (tokens of the source before it) and ``n_tokens``; input columns of these names are replaced.

    ``docs`` has the columns of ``with_tokens``; ``sized`` is a table of at least those of them that
    start with an underscore, for the same rows, read several times.
    """
    per_source = written(weights(sized, mixture), "weights")
    seed = F.lit(str(mixture.seed))
    blocks = (_in_block(sized, per_source).groupBy("_src", "_block").agg(F.sum("_tokens").alias("_size"))
              .join(per_source.select("_src", "_budget", "_epochs", "tokens"), "_src")
              .where("_epochs > 0")
              .withColumn("epoch", F.explode(F.expr("sequence(0, _epochs - 1)"))))
    turn = F.md5(F.concat_ws("|", seed, F.col("epoch"), F.col("_src"), F.col("_block")).cast("binary"))
    before = Window.partitionBy("_src", "epoch").orderBy(turn, "_block").rowsBetween(Window.unboundedPreceding, -1)
    plan = (blocks.withColumn("_start", F.col("epoch") * F.col("tokens")
                              + F.coalesce(F.sum("_size").over(before), F.lit(0)))
            .where("_start < _budget").select("_src", "_block", "epoch", "_start", "_budget"))
    clean = docs.drop("epoch", "block", "position", "n_tokens")
    taken = _in_block(clean, per_source).join(plan, ["_src", "_block"])
    inner = F.md5(F.concat_ws("|", seed, F.col("epoch"), F.col("_mark")).cast("binary"))
    ahead = (Window.partitionBy("_src", "_block", "epoch").orderBy(inner, "_mark")
             .rowsBetween(Window.unboundedPreceding, -1))
    return (taken.withColumn("position", F.col("_start") + F.coalesce(F.sum("_tokens").over(ahead), F.lit(0)))
            .where("position < _budget")
            .withColumn("block", F.col("_block")).withColumn("n_tokens", F.col("_tokens")).drop(*_OWN))


# the sums of the bisection are few, so plain halvings of a list say the same in SQL
SQL = r"""
WITH RECURSIVE sized AS (
 SELECT doc_id, coalesce('s' || source, 'null') AS src, source,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1 AS tokens,
  coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) AS mark
 FROM documents),
hashed AS (SELECT *, CAST('0x' || substr(md5(mark), 1, 15) AS BIGINT) AS h FROM sized),
sums AS (SELECT src, sum(tokens)::BIGINT AS tokens, count(*) AS docs FROM hashed GROUP BY src),
shares AS (SELECT *, tokens / (SELECT sum(tokens) FROM sums)::DOUBLE AS share FROM sums),
facts AS (SELECT list(share ORDER BY src) AS ps, sum(-share * ln(share)) AS h, count(*) AS n FROM shares),
halving AS (
 SELECT 0 AS step, 0.0::DOUBLE AS lo_e, 1.0::DOUBLE AS hi_e, 0.0::DOUBLE AS lo_r, 1.0::DOUBLE AS hi_r
 UNION ALL
 SELECT step + 1,
  CASE WHEN too_even THEN mid_e ELSE lo_e END, CASE WHEN too_even THEN hi_e ELSE mid_e END,
  CASE WHEN too_often THEN mid_r ELSE lo_r END, CASE WHEN too_often THEN hi_r ELSE mid_r END
 FROM (SELECT *,
   ln(list_sum(list_transform(ps, lambda x: pow(x, mid_e))))
    - mid_e * list_sum(list_transform(ps, lambda x: pow(x, mid_e) * ln(x)))
      / list_sum(list_transform(ps, lambda x: pow(x, mid_e))) > h + 0.5 * (ln(n) - h) AS too_even,
   list_max(list_transform(ps, lambda x: pow(x, mid_r - 1)))
    / list_sum(list_transform(ps, lambda x: pow(x, mid_r))) > 4.0 AS too_often
  FROM (SELECT *, (lo_e + hi_e) / 2 AS mid_e, (lo_r + hi_r) / 2 AS mid_r FROM halving), facts)
 WHERE step < 36),
chosen AS (SELECT round(greatest(hi_e, CASE WHEN hi_r > pow(2.0, -30) THEN hi_r ELSE 0 END), 9) AS a
 FROM halving WHERE step = 36),
weighted AS (SELECT src, tokens, docs,
  CAST(floor(pow(share, a) / (SELECT sum(pow(share, a)) FROM shares, chosen)
   * (SELECT sum(tokens) FROM sums)::DOUBLE) AS BIGINT) AS budget,
  CAST(ceil(docs / 256.0) AS BIGINT) AS blocks
 FROM shares, chosen),
passes AS (SELECT *, CAST(ceil(budget / tokens::DOUBLE) AS INTEGER) AS epochs FROM weighted),
placed AS (SELECT hashed.*, h % blocks AS block, passes.tokens AS src_tokens, budget, epochs
 FROM hashed JOIN passes USING (src)),
sizes AS (SELECT src, block, any_value(src_tokens) AS src_tokens, any_value(budget) AS budget,
  any_value(epochs) AS epochs, sum(tokens)::BIGINT AS size FROM placed GROUP BY src, block),
turns AS (SELECT *, unnest(range(epochs))::INTEGER AS epoch FROM sizes),
starts AS (SELECT *, epoch * src_tokens + coalesce(sum(size) OVER (PARTITION BY src, epoch
  ORDER BY md5('17|' || epoch || '|' || src || '|' || block), block
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM turns),
spots AS (SELECT doc_id, source, epoch, block, tokens, budget, start + coalesce(sum(tokens) OVER (
  PARTITION BY src, block, epoch ORDER BY md5('17|' || epoch || '|' || mark), mark
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
 FROM placed JOIN (SELECT src, block, epoch, start FROM starts WHERE start < budget) USING (src, block))
SELECT doc_id, source, epoch, block, CAST(position AS BIGINT) AS position, CAST(tokens AS BIGINT) AS n_tokens
FROM spots WHERE position < budget
"""
