"""The queries of the operators on training texts, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm import cutoff, incremental, leakage, pairs, repetition, spam, tokens, truncation
from turnloom.sources.tables import table


def _p1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "dialogues").select("rec_id", cutoff.source_of(F.col("domain")).alias("source"), cutoff.valid_score(F.col("metadata.quality_score")).alias("score"))
    targets = table(spark, d, "keep_targets").select(cutoff.source_of(F.col("domain")).alias("source"), "keep_percent")
    return rows, cutoff.cutoffs(rows, targets)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return cutoff.kept(*_p1(spark, d)).select("rec_id")


def p1_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _p1(spark, d)[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_values(table(spark, d, "dialogues")).select("rec_id", "field", "pos")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    return truncation.rates(table(spark, d, "dialogues"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.defects(table(spark, d, "dialogues"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.cases(table(spark, d, "dialogues"))


def p5_shares(spark: SparkSession, d: str) -> DataFrame:
    return repetition.shares(table(spark, d, "dialogues"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.repeats(table(spark, d, "dialogues"), table(spark, d, "incoming_dialogues"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.found(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_cutoffs, p2_found, p2_rates, p3_found, p5_found, p5_shares, p6_found, p8_ids, p9_found, p9_items, p10_found)}


_SCORED = r"""
    SELECT rec_id, coalesce(nullif(lower(regexp_replace(domain, '^[\s\p{Z}\p{C}]+|[\s\p{Z}\p{C}]+$', '', 'g')), ''), 'unknown') AS source,
           metadata.quality_score AS score
    FROM dialogues WHERE metadata.quality_score >= 0 AND metadata.quality_score <= 1 AND NOT isnan(metadata.quality_score)"""
_CUTS = f"""scored AS ({_SCORED}),
    hist AS (SELECT source, score, count(*) AS n FROM scored GROUP BY ALL),
    cum AS (SELECT source, score, sum(n) OVER (PARTITION BY source ORDER BY score DESC) AS up_to, sum(n) OVER (PARTITION BY source) AS n_scored FROM hist),
    cuts AS (SELECT c.source, k.keep_percent, CAST(n_scored AS BIGINT) AS n_scored, max(score) AS cutoff, CAST(min(up_to) AS BIGINT) AS n_kept
             FROM cum c JOIN keep_targets k ON lower(trim(k.domain)) = c.source WHERE up_to * 100 >= n_scored * k.keep_percent GROUP BY ALL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": f"WITH {_CUTS} SELECT rec_id FROM scored JOIN cuts USING (source) WHERE score >= cutoff",
        # the exact definition alone
        "p5_found": r"""WITH T AS (SELECT rec_id, string_agg(coalesce(t.text, ''), chr(10) ORDER BY i) AS body FROM (SELECT rec_id, unnest(turns) AS t, generate_subscripts(turns, 1) AS i FROM dialogues) GROUP BY 1),
    W AS (SELECT rec_id, regexp_extract_all(lower(body), '[\p{L}\p{N}_]+') AS w FROM T), G AS (SELECT rec_id, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT rec_id, w, unnest(range(1, len(w) - 3)) AS i FROM W WHERE len(w) >= 5)),
    R AS (SELECT rec_id, i FROM G QUALIFY row_number() OVER (PARTITION BY rec_id, gram ORDER BY i) > 1), C AS (SELECT DISTINCT rec_id, i + k AS at FROM R, (SELECT unnest(range(5)) AS k))
    SELECT rec_id FROM W JOIN (SELECT rec_id, count(*) AS n FROM C GROUP BY 1) USING (rec_id) WHERE n >= 0.35 * len(w)""",
        "p1_cutoffs": f"WITH {_CUTS} SELECT source, keep_percent, n_scored, cutoff, n_kept FROM cuts",
    }
