"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted by (source, language, topic); the counts are raked until their
marginals meet the targets, and documents are drawn with the probabilities that follow.
DataFrame expressions only; no Python runs on the executors.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldloom.llm._common import by_ids, materialize

DIMENSIONS = ("source", "lang", "topic")
#: A topic holds if the text matches; the first that does is the document's, else OTHER.
TOPICS = (("tabular", r" \| "), ("legal", r"[Ll]icen[sc]e|[Cc]opyright"), ("contact", r"@"), ("numeric", r"[0-9]{6}"))
OTHER, MISSING = "prose", "(none)"
#: Sweeps over the three marginals; rounds at most that settle the common factor; share of all
#: tokens to draw; exponent that flattens observed shares where no target is given.
SWEEPS, ROUNDS, BUDGET, FLATTEN = 8, 12, 0.5, 0.7
#: Cells up to this number are broadcast (under 100 bytes each).
BROADCAST_CELLS = 200_000
WORD = r"[^\x20\x09-\x0D]+"


def topic_of(text: Column, topics=TOPICS) -> Column:
    found = F.when(F.lit(False), "")
    for name, pattern in topics:
        found = found.when(text.rlike(pattern), name)
    return found.otherwise(OTHER)


def described(docs: DataFrame, topics=TOPICS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens); null source or language: ``(none)``, null text: empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        F.coalesce("source", F.lit(MISSING)).alias("source"),
        F.coalesce("lang", F.lit(MISSING)).alias("lang"),
        topic_of(text, topics).alias("topic"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"),
    )


def _targets(cells: DataFrame, name: str, given: Mapping[str, float] | None, flatten: float) -> DataFrame:
    """Each value's target share of the tokens; values without a given target get none."""
    marginal = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("t"))
    if given is None:
        goal = F.when(F.col("t") > 0, F.pow("t", F.lit(flatten))).otherwise(0.0)
    else:
        goal = F.when(F.col("t") > 0, F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in given.items() for x in kv]).cast("map<string,double>"), F.col(name)), F.lit(0.0))).otherwise(0.0) if given else F.lit(0.0)
    marginal = marginal.select(name, goal.alias(f"goal_{name}"))
    total = marginal.agg(F.sum(f"goal_{name}")).first()[0] or 0.0  # one number, whatever the values
    return marginal.withColumn(f"goal_{name}", F.try_divide(F.col(f"goal_{name}"), F.lit(float(total))))


def rake(cells: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, sweeps: int = SWEEPS, budget: float = BUDGET, flatten: float = FLATTEN) -> DataFrame:
    """Add ``weight`` (share of the raked tokens) and ``probability`` to cells of tokens.

    A cell without tokens weighs nothing and, as its documents are empty, is drawn at the
    common rate. Where a cell would need more than it has it is kept whole and the rest
    of the budget goes to the others. Targets that the data have no tokens for are left out.
    """
    df = cells
    for name in DIMENSIONS:
        df = df.join(_targets(cells, name, (targets or {}).get(name), flatten), name)
    df = df.withColumn("w", F.col("tokens").cast("double"))
    for _ in range(sweeps):
        for name in DIMENSIONS:
            df = df.withColumn("w", F.coalesce(F.col("w") * F.try_divide(F.col(f"goal_{name}"), F.sum("w").over(W.partitionBy(name))), F.lit(0.0)))
    df = materialize(df.select(*DIMENSIONS, "tokens", "w"), "raked")
    sums = df.agg(F.sum("w").alias("w"), F.sum("tokens").alias("tokens")).first()
    total = float(sums.tokens or 0)
    df = df.withColumn("w", F.coalesce(F.try_divide(F.col("w"), F.lit(float(sums.w or 0.0))), F.lit(0.0)))
    df = df.withColumn("ratio", F.when(F.col("tokens") > 0, F.col("w") * total / F.col("tokens")).otherwise(1.0))
    k = float(budget)
    for _ in range(ROUNDS):
        full = k * F.col("ratio") >= 1
        got = df.agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("whole"), F.sum(F.when(full, 0.0).otherwise(F.col("w"))).alias("rest")).first()
        if not total or not got.rest:
            break
        new = max(k, (total * budget - float(got.whole)) / (total * got.rest))
        if new == k:
            break
        k = new
    return df.select(*DIMENSIONS, "tokens", F.col("w").alias("weight"), F.least(F.lit(k) * F.col("ratio"), F.lit(1.0)).alias("probability"))


def fit_report(raked: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, flatten: float = FLATTEN) -> DataFrame:
    """(dimension, value, target, raked, drawn): for each value of each marginal its target
    share of the tokens, the share after the sweeps, and the expected share of what is drawn,
    which falls short where a value's documents are already drawn whole."""
    sums = raked.agg(F.sum("weight").alias("w"), F.sum(F.col("tokens") * F.col("probability")).alias("d")).first()
    parts = []
    for name in DIMENSIONS:
        goal = _targets(raked, name, (targets or {}).get(name), flatten)
        per = raked.groupBy(name).agg((F.sum("weight") / F.lit(float(sums.w or 1.0))).alias("raked"), (F.sum(F.col("tokens") * F.col("probability")) / F.lit(float(sums.d or 1.0))).alias("drawn"))
        parts.append(per.join(goal, name).select(F.lit(name).alias("dimension"), F.col(name).alias("value"), F.col(f"goal_{name}").alias("target"), "raked", "drawn"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def expected_share(raked: DataFrame) -> float | None:
    """The share of all tokens that the probabilities draw on average, to hold against the budget."""
    return raked.agg(F.try_divide(F.sum(F.col("tokens") * F.col("probability")), F.sum("tokens").cast("double"))).first()[0]


def cells_of(rows: DataFrame) -> DataFrame:
    """(source, lang, topic, tokens) of described documents."""
    return rows.groupBy(*DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) fixed by the id: the first 32 bits of an MD5."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substr(F.md5(text.cast("binary")), F.lit(1), F.lit(8)), 16, 10).cast("double") / 4294967296.0


def mix(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, seed: int = 0, topics=TOPICS) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, probability, kept) of every document.

    Repeated rows of an id share its draw; an empty table gives an empty one. Columns
    beyond doc_id, text, source and lang are not read.
    """
    rows = materialize(described(docs, topics), "described")
    cells = rake(materialize(cells_of(rows), "cells"), targets, budget=budget)
    side = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells
    both = rows.join(side.select(*DIMENSIONS, F.round("probability", 6).alias("probability")), list(DIMENSIONS), "left")
    return both.select("doc_id", *DIMENSIONS, "n_tokens", "probability", (uniform(F.col("doc_id"), seed) < F.col("probability")).alias("kept"))


def draw(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET, seed: int = 0) -> DataFrame:
    """The documents drawn, all columns."""
    return by_ids(docs, mix(docs, targets, budget, seed).where("kept").select("doc_id"), keep=True)


def duckdb_sql(sweeps: int = SWEEPS, rounds: int = ROUNDS, budget: float = BUDGET, flatten: float = FLATTEN, seed: int = 0) -> str:
    """``mix`` over ``documents`` with default targets, as SQL for DuckDB."""
    cases = " ".join(f"WHEN regexp_matches(t, '{p}') THEN '{n}'" for n, p in TOPICS)
    steps = [
        f"""d AS (SELECT doc_id, coalesce(source, '{MISSING}') AS source, coalesce(lang, '{MISSING}') AS lang, coalesce(text, '') AS t FROM documents)""",
        f"""r AS (SELECT doc_id, source, lang, CASE {cases} ELSE '{OTHER}' END AS topic, CAST(len(regexp_extract_all(t, '{WORD}')) AS BIGINT) AS n_tokens FROM d)""",
        "c AS (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM r GROUP BY ALL)",
    ]
    for n in DIMENSIONS:
        steps.append(f"g_{n} AS (SELECT {n}, CASE WHEN sum(tokens) > 0 THEN pow(CAST(sum(tokens) AS DOUBLE), {flatten}) ELSE 0 END AS g FROM c GROUP BY {n})")
        steps.append(f"h_{n} AS (SELECT {n}, g / sum(g) OVER () AS goal_{n} FROM g_{n})")
    joins = " ".join(f"JOIN h_{n} USING ({n})" for n in DIMENSIONS)
    steps.append(f"w0 AS (SELECT c.*, {', '.join(f'goal_{n}' for n in DIMENSIONS)}, CAST(tokens AS DOUBLE) AS w FROM c {joins})")
    last = "w0"
    for k in range(sweeps):
        for n in DIMENSIONS:
            this = f"w{k}_{n}"
            steps.append(f"{this} AS MATERIALIZED (SELECT * EXCLUDE (w), CASE WHEN sum(w) OVER (PARTITION BY {n}) > 0 THEN w * (goal_{n} / sum(w) OVER (PARTITION BY {n})) ELSE 0 END AS w FROM {last})")
            last = this
    steps.append(f"n AS (SELECT source, lang, topic, tokens, w / sum(w) OVER () AS w, CAST(sum(tokens) OVER () AS DOUBLE) AS total FROM {last})")
    steps.append(f"k0 AS (SELECT *, CASE WHEN tokens > 0 THEN w * total / tokens ELSE 1 END AS ratio, CAST({budget} AS DOUBLE) AS k FROM n)")
    for i in range(rounds):
        whole = "sum(CASE WHEN k * ratio >= 1 THEN tokens ELSE 0 END) OVER ()"
        rest = "sum(CASE WHEN k * ratio >= 1 THEN 0 ELSE w END) OVER ()"
        steps.append(f"k{i + 1} AS (SELECT * EXCLUDE (k), greatest(k, coalesce((total * {budget} - {whole}) / nullif(total * {rest}, 0), k)) AS k FROM k{i})")
    steps.append(f"p AS (SELECT source, lang, topic, round(least(k * ratio, 1.0), 6) AS probability FROM k{rounds})")
    draw_sql = f"CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':{seed}'), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 < probability AS kept"
    return "WITH " + ",\n".join(steps) + f"\nSELECT doc_id, source, lang, topic, n_tokens, probability, {draw_sql} FROM r JOIN p USING (source, lang, topic)"
