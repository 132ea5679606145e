"""Comparison of texts with the reference texts of their domain."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _frequencies(rows: DataFrame, *key: str) -> DataFrame:
    terms = F.regexp_extract_all(F.lower("goal"), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return rows.select(*key, F.explode(terms).alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))


def nearest_by_tfidf(queries: DataFrame, refs: DataFrame) -> DataFrame:
    """``domain, goal, pos, sim``: the nearest reference of each query within its domain by TF-IDF cosine.

    A sparse join on (domain, term) with sums of products; ties take the lowest
    position. Terms in more than 95 % of a domain's references are left out;
    queries without a common term give no row.
    """
    rf = _frequencies(refs, "domain", "pos")
    n = refs.groupBy("domain").agg(F.countDistinct("pos").alias("n"))
    df = rf.groupBy("domain", "term").agg(F.count("*").alias("df")).join(n, "domain").where(F.col("df") <= 0.95 * F.col("n"))
    idf = df.select("domain", "term", (F.log((1.0 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weigh = lambda f: f.join(idf, ["domain", "term"]).withColumn("w", F.col("tf") * F.col("idf"))
    r, q = weigh(rf), weigh(_frequencies(queries, "domain", "goal"))
    rn = r.groupBy("domain", "pos").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("rn"))
    qn = q.groupBy("domain", "goal").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("qn"))
    dot = q.select("domain", "goal", "term", F.col("w").alias("a")).join(r.select("domain", "pos", "term", F.col("w").alias("b")), ["domain", "term"]).groupBy("domain", "goal", "pos").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    sim = dot.join(qn, ["domain", "goal"]).join(rn, ["domain", "pos"]).withColumn("sim", F.round(F.col("dot") / (F.col("qn") * F.col("rn")), 6))
    return sim.groupBy("domain", "goal").agg(F.max_by(F.struct("pos", "sim"), F.struct("sim", -F.col("pos"))).alias("m")).select("domain", "goal", "m.pos", "m.sim")


def bleu(reference: list[str], candidate: list[str]) -> float:
    """BLEU of up to four words with a tenth for empty counts; 0 without a common word."""
    if not candidate or not reference:
        return 0.0
    logs = 0.0
    for n in range(1, 5):
        have = Counter(zip(*(candidate[i:] for i in range(n))))
        want = Counter(zip(*(reference[i:] for i in range(n))))
        hit, total = sum((have & want).values()), max(1, sum(have.values()))
        if n == 1 and not hit:
            return 0.0
        logs += math.log((hit or 0.1) / total) / 4
    short = 1.0 if len(candidate) > len(reference) else math.exp(1 - len(reference) / len(candidate))
    return short * math.exp(logs)


def best_bleu(queries: DataFrame, refs: DataFrame, most: int | None = None) -> DataFrame:
    """``domain, goal, bleu``: the best BLEU of each query against the references of its domain, or its first ``most``.

    The references, a fixed list, are one array per domain beside each
    query, so nothing is joined row by row. Domains without references give no row.
    """
    first = refs if most is None else refs.withColumn("k", F.row_number().over(Window.partitionBy("domain").orderBy("pos"))).where(F.col("k") <= most)
    lists = first.groupBy("domain").agg(F.collect_list("goal").alias("refs"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            best = [max((bleu(r.lower().split(), g.lower().split()) for r in rs), default=0.0) for g, rs in zip(b["goal"], b["refs"])]
            yield pd.DataFrame({"domain": b["domain"], "goal": b["goal"], "bleu": [round(x, 6) for x in best]})

    return queries.join(lists, "domain").mapInPandas(run, "domain string, goal string, bleu double")
