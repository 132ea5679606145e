"""Repetition inside a dialogue, found as a robust multivariate outlier.

Each dialogue becomes a vector of transformed statistics. Per language and
source, and over all of them, a minimum covariance determinant gives a centre
and a spread that repetitive dialogues don't move; those far out are candidates,
and the exact share of repeated words settles them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.llm.langid import language
from turnloom.sources.tables import bounded, keep, parallel

#: Words in a row that must have occurred before.
RUN = 5
#: Share of repeated words from which a dialogue is a case; cases have 2/5 at least, others less than 3/10.
SHARE = 0.35
#: Part of the rows on which the covariance determinant is made least, and concentration steps at most.
H, STEPS = 0.5, 30
#: Squared Mahalanobis distance of the 97.5 % point of chi-square with three degrees.
CHI2 = 9.348
#: Width of the cells in which the estimate counts the vectors.
CELL = 0.05
#: Rows that the estimate over all groups counts for beside a group's own.
PRIOR = 50
#: Least spread of each transformed statistic: a group without any repetition has none of its own.
FLOOR = (0.35, 0.12, 0.25)

_WORD = re.compile(r"\w+")


def repeated_words(words: list[str], run: int = RUN) -> int:
    """Number of words inside runs of ``run`` or more that occurred earlier in the list."""
    grams = list(zip(*(words[i:] for i in range(run))))
    if len(set(grams)) == len(grams):
        return 0
    seen: set = set()
    count = end = 0
    for i, g in enumerate(grams):
        if g in seen:
            count += i + run - max(i, end)
            end = i + run
        else:
            seen.add(g)
    return count


def statistics(dialogues: DataFrame) -> DataFrame:
    """``rec_id, source, lang, n_words, share, x1, x2, x3`` of each dialogue.

    ``share`` is the share of repeated words over all turns in order. The
    transformed statistics are the logit of the share, the log of distinct
    words by the square root of words, and the logit of the share of turns that
    occurred before. A dialogue without words has share 0.
    """
    texts = F.transform("turns", lambda t: F.coalesce(t["text"], F.lit("")))
    rows = parallel(dialogues.select("rec_id", F.coalesce(F.col("metadata.model_version"), F.lit("")).alias("source"), F.array_join(F.coalesce(texts, F.array().cast("array<string>")), "\n\x00").alias("text")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for b in batches:
            out = []
            for text in b["text"]:
                turns = text.lower().split("\n\x00")
                words = _WORD.findall(text.lower())
                n = len(words)
                share = repeated_words(words) / n if n else 0.0
                held = [t for t in turns if len(t) > 20]
                again = 1 - len(set(held)) / len(held) if held else 0.0
                out.append((n, share, len(set(words)) / (n**0.5) if n else 1.0, again, language(text)[0]))
            n, share, variety, again, lang = zip(*out) if out else ((),) * 5
            s, a = np.array(share, float), np.array(again, float)
            yield pd.DataFrame({
                "rec_id": b["rec_id"], "source": b["source"], "lang": lang, "n_words": np.array(n, "int32"), "share": s,
                "x1": np.log((s + 0.02) / (1.02 - s)), "x2": np.log(np.maximum(np.array(variety, float), 1e-3)), "x3": np.log((a + 0.05) / (1.05 - a)),
            })

    return rows.mapInPandas(run, "rec_id bigint, source string, lang string, n_words int, share double, x1 double, x2 double, x3 double")


_X = ("x1", "x2", "x3")


def consistency(h: float) -> float:
    """Factor by which the covariance of the inner ``h`` of a normal cloud in three dimensions is too small."""
    inner = lambda x: math.erf(math.sqrt(x / 2)) - math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
    lo, hi = 0.0, 100.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if inner(mid) < h else (lo, mid)
    return h / (inner(lo) - math.sqrt(2 / math.pi) * lo**1.5 * math.exp(-lo / 2) / 3)


def least_determinant(x, n):
    """(centre, covariance) of the H of the points ``x`` with counts ``n`` whose covariance has the least determinant.

    Concentration steps from several starts, each until nothing changes: the
    medians, the half that repeats least, the half of the middle of each
    statistic. The result with the least determinant is taken and made
    consistent with a normal cloud.
    """
    import numpy as np

    floor = np.diag(np.square(FLOOR))
    want = H * n.sum()

    def inner(d):
        order = np.argsort(d, kind="stable")
        up = np.cumsum(n[order])
        w = np.zeros(len(n))
        w[order] = np.clip(want - (up - n[order]), 0, n[order])
        return w

    def moments(w):
        m = (w[:, None] * x).sum(axis=0) / w.sum()
        d = x - m
        return m, (w[:, None] * d).T @ d / w.sum()

    def distance(m, c):
        d = x - m
        return np.einsum("ij,jk,ik->i", d, np.linalg.inv(c + floor), d)

    medians = []
    for k in range(3):
        order = np.argsort(x[:, k], kind="stable")
        medians.append(x[order[np.searchsorted(np.cumsum(n[order]), want)], k])
    middle = x - np.array(medians)
    starts = [distance(np.array(medians), np.zeros((3, 3))), x[:, 0], np.abs(middle / np.array(FLOOR)).max(axis=1)]
    best = None
    for d in starts:
        w = inner(d)
        for _ in range(STEPS):
            m, c = moments(w)
            again = inner(distance(m, c))
            if np.array_equal(again, w):
                break
            w = again
        m, c = moments(w)
        det = np.linalg.det(c + floor)
        if best is None or det < best[0] - 1e-12:
            best = (det, m, c)
    return best[1], best[2] * consistency(H)


_X = ("x1", "x2", "x3")
_EST = [f"m_{x}" for x in _X] + [f"c_{x}{y}" for i, x in enumerate(_X) for y in _X[i:]]


def estimates(stats: DataFrame) -> DataFrame:
    """``lang, source`` and the robust centre (``m_``) and covariance (``c_``) of each group; both null for all groups.

    The vectors are first counted in cells of CELL, combined before the
    shuffle, so a group's task gets no more rows than the bounded space of
    statistics has cells, however many dialogues it holds.
    """
    at = [F.round(F.col(v) / CELL).cast("int").alias(v) for v in _X]
    cells = stats.groupBy("lang", "source", *at).agg(F.count("*").alias("n"))
    both = keep(cells.unionByName(cells.groupBy(*_X).agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source"), *_X, "n")))

    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        m, c = least_determinant(b[list(_X)].to_numpy(float) * CELL, b["n"].to_numpy(float))
        row = [*m, *(c[i, j] for i in range(3) for j in range(i, 3))]
        return pd.DataFrame([[key[0], key[1], int(b["n"].sum()), *np.asarray(row, float)]], columns=["lang", "source", "n", *_EST])

    return both.groupBy("lang", "source").applyInPandas(run, "lang string, source string, n bigint, " + ", ".join(f"{c} double" for c in _EST))


def _distance(prefix: str) -> Column:
    """Squared Mahalanobis distance from the moments with the prefix, spreads no less than the floor."""
    c = {(i, j): F.col(f"{prefix}c_{_X[min(i, j)]}{_X[max(i, j)]}") + (F.lit(FLOOR[i] ** 2) if i == j else F.lit(0.0)) for i in range(3) for j in range(3)}
    d = [F.col(x) - F.col(f"{prefix}m_{x}") for x in _X]
    minor = lambda i, j: (lambda r, s: c[r[0], s[0]] * c[r[1], s[1]] - c[r[0], s[1]] * c[r[1], s[0]])([k for k in range(3) if k != i], [k for k in range(3) if k != j])
    cof = {(i, j): minor(i, j) * ((-1) ** (i + j)) for i in range(3) for j in range(3)}
    det = sum((c[0, j] * cof[0, j] for j in range(1, 3)), c[0, 0] * cof[0, 0])
    return sum((d[i] * d[j] * cof[j, i] / det for i in range(3) for j in range(3) if (i, j) != (0, 0)), d[0] * d[0] * cof[0, 0] / det)


def robust_distances(stats: DataFrame) -> DataFrame:
    """The statistics with ``d2``, the greater of two robust squared distances, and ``center``, the lower centre of x1.

    The distances are from the estimate of the dialogue's language and source,
    drawn towards that of all dialogues as if PRIOR of those were in the group,
    and from that of all alone: where most of a group repeats, its own centre is
    repetitive, but that of all isn't as long as most dialogues aren't.
    """
    est = keep(estimates(stats))
    whole = est.where("lang IS NULL").first()  # one row of numbers; none of an empty table
    of_all = {c: F.lit(whole[c] if whole else 0.0) for c in _EST}
    own = est.where("lang IS NOT NULL").select("lang", "source", *[of_all[c].alias(f"all_{c}") for c in _EST], *[((F.col("n") * F.col(c) + PRIOR * of_all[c]) / (F.col("n") + PRIOR)).alias(f"own_{c}") for c in _EST])
    d = stats.join(bounded(keep(own)), ["lang", "source"])
    return d.select("rec_id", "source", "lang", "n_words", "share", *_X, F.least("own_m_x1", "all_m_x1").alias("center"), F.greatest(_distance("own_"), _distance("all_")).alias("d2"))


def shares(dialogues: DataFrame) -> DataFrame:
    """``rec_id, source, lang, n_words, share, d2, outlier``: repetition of each dialogue.

    Repeated rows each give a row, null turns and texts count as empty, texts
    are read whole, ties in the statistics fall on the same side. Empty input
    gives no rows.
    """
    d = robust_distances(keep(statistics(dialogues)))
    return d.select("rec_id", "source", "lang", "n_words", "share", "d2", ((F.col("d2") > CHI2) & (F.col("x1") > F.col("center"))).alias("outlier"))


def cases(dialogues: DataFrame) -> DataFrame:
    """``rec_id`` of the dialogues that are outliers on the side of repetition and whose exact share is high."""
    return shares(dialogues).where(F.col("outlier") & (F.col("share") >= SHARE)).select("rec_id")
