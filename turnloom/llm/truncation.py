"""Values cut off by field limits or in mid-transfer.

For each source a right-censored length distribution is fitted by maximum
likelihood, and each candidate limit gets the posterior that a value of that
length was censored there. This is the prior of the value; what its own ending
says for or against a cut is learned from all values (how often cut and whole
values end so), and both together decide.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions.text import once
from turnloom.sources.tables import EDGE, bounded, keep

#: Classes of endings that may be cut, and shares of them among cut and among whole values from which learning starts.
CLASSES, CUT_START, WHOLE_START = ("closed", "open", "broken"), (0.02, 0.6, 0.38), (0.07, 0.002, 0.0005)
#: Share of values cut at no limit from which learning starts and most of it, rounds of learning, and how many cut and whole values
#: the starting shares stand for beside those seen.
ELSEWHERE, RARE, ROUNDS, PRIOR_CUT, PRIOR_WHOLE = 0.01, 0.1, 50, 5.0, 2000.0
#: Chance up to which as many open endings at one length as there are may be chance, for the length to be a candidate limit.
CHANCE = 1e-6
#: Last words with which messages end without a mark; fixed values.
CLOSERS = "please|thanks|thank you|thx|ty|cheers|if possible|possible|see you|see you then|bye|good|ok|okay|great|fine|perfect|same as before|sure|yes|no|gracias|por favor|merci|svp|danke|bitte|tschüss|adiós"
#: Hesitations that may end in three dots; fixed values.
HESITATION = r"(?i)^\W*(?:(?:hmm+|hm|um+|uh+|er+|eh|euh|well)\b\W*){0,2}(?:let me (?:think|see|check)|give me a (?:second|moment)|one moment)?$"

#: What may be appended where a value was cut.
_APPENDED = r"(?<![\s.…])(?:\s*+(?:…|\.{3,}+|\[…\]|\[\.\.\.\]|\(\.\.\.\)|\[truncated\]|\[cut\]))++$|(?<=\.)\s++(?:…|\.{3,}+)$"
_AFTER = r"\"'”’»)\]\s\p{So}\p{Sk}️‍*_"
_CLOSING = "(?<![" + _AFTER + "])[" + _AFTER + "]++$"
_MARK = r"[.!?。！？।]$"
_CODE = r"\p{Lu}{2,}-?\d{3,}"


def ending(text: Column) -> Column:
    """Class of a value's ending: ``none, complete, closed, open`` or ``broken``.

    ``none``: null, empty or a placeholder without content. ``complete``: ends
    with a sentence mark. ``closed``: ends without one in a form that needs
    none (short closer, list, sum, reference, link, smiley). ``open``: ends
    inside a sentence. ``broken``: ends with what only a cut leaves.
    """
    # most values end with a mark behind a letter: two characters settle them
    plain = (F.length(text) > 24) & (F.right(text, F.lit(1)).isin("?", "!") | F.regexp_like(F.right(text, F.lit(2)), F.lit(r"^[\p{L})]\.$")))
    return F.when(plain, "complete").otherwise(_ending(text))


def _ending(text: Column) -> Column:
    """The class of an ending that is not plainly complete; the trimmed forms of the text are computed once."""
    bare = lambda base: F.regexp_replace(F.regexp_replace(base, r"^[\"“„«']+", ""), _CLOSING, "")
    of_base = lambda s, base: once(bare(base), lambda b: _class(s, base, b))
    return once(F.regexp_replace(text, EDGE, ""), lambda s: once(F.regexp_replace(s, _APPENDED, ""), lambda base: of_base(s, base)))


def _class(s: Column, base: Column, bare: Column) -> Column:
    """The class of a text by its trimmed form, that without what was appended at a cut, and that without closing marks."""
    appended = base != s
    last_line = F.regexp_extract(bare, r"([^\n\r]*)$", 1)
    content = F.regexp_like(s, F.lit(r"[\p{L}\p{N}]"))
    placeholder = F.regexp_like(s, F.lit(r"(?i)^\W*(n/a|null|none|nil|nan|tbd|empty|no response|no answer|no reply|kein[e]?|sin respuesta|same as before|unknown)\W*$"))
    hesitates = F.regexp_like(base, F.lit(HESITATION))
    date_end = F.regexp_like(bare, F.lit(r"(?:^|[^.\d])\d{1,2}\.\d{1,2}\.$|(?:für|am|den|dem|vom|zum|auf|le|du|au|el|del|al)\s\d{1,2}\.$"))
    multi_line = F.regexp_like(bare, F.lit(r"[\n\r]"))
    item = r"^\s*(?:[-*•–]|\d{1,2}[.)])\s+"
    # a list whose items all end alike is whole if the last one does too
    priced = F.regexp_like(last_line, F.lit(r",\s*\d+\s+\p{L}{3,}$")) | ~F.regexp_like(bare, F.lit(r"^[^\n]*\n?\s*[-*•][^\n]*,\s*\d+\s+\p{L}+\s*\n"))
    listed = multi_line & F.regexp_like(last_line, F.lit(item + r"\S+")) & priced & ~F.regexp_like(last_line, F.lit(_DANGLING))
    keyed = multi_line & F.regexp_like(last_line, F.lit(r"^[\p{L} ]{2,20}: \S.*[\p{L}\d]$")) & ~F.regexp_like(last_line, F.lit(r"(?i)^(place|ort|lieu|lugar): "))
    summed = F.regexp_like(bare, F.lit(r"^[\p{L} ]{2,25}: \d[\d.,]* ?[\p{L}€$£]{2,}$"))
    code = F.regexp_like(bare, F.lit(r"(?:; reference|; ref|^reference:|^ref:|^my ref is) " + _CODE + "$"))
    link = F.regexp_like(bare, F.lit(r"(?:https?://|www\.)[\w.-]+\.\p{L}{2,}(?:/\S*)?$"))
    first_lower = F.regexp_like(bare, F.lit(r"^\p{Ll}"))
    closer = F.regexp_like(bare, F.lit(r"(?i)(?:^|[\s,])(?:" + CLOSERS + ")$"))
    short = F.size(F.split(bare, r"\s+")) <= 4
    see_you = F.regexp_like(bare, F.lit(r"(?i)\bsee you (?:then|there|soon|later|tomorrow)$"))
    smiley = F.regexp_like(s, F.lit(r"(?:[:;=8][-']?[)(DPp/|]|<3|[\p{So}️])$"))
    return (
        F.when(s.isNull() | ~content | placeholder, "none")
        .when(F.regexp_like(s, F.lit(r"�[\"']?$")), "broken")
        .when(appended & F.regexp_like(bare, F.lit(_MARK)) & ~date_end, "complete")
        .when(appended & hesitates, "complete")
        .when(appended, "broken")
        .when(F.regexp_like(s, F.lit(r"[\p{L}\p{N}][-‐–]$")), "broken")
        .when(F.regexp_like(s, F.lit(r"[,;:–—-]$")), "broken")
        .when(smiley, "closed")
        .when(date_end, "open")
        .when(F.regexp_like(bare, F.lit(_MARK)), "complete")
        .when(F.regexp_like(s, F.lit(r"[)\]]$")), "closed")
        .when(listed | keyed | summed | code | link | see_you, "closed")
        .when(closer & (first_lower | short), "closed")
        .when(closer & ~F.regexp_like(bare, F.lit(r"[.?!]\s")), "closed")
        .otherwise("open")
    )


#: A last word after which something must follow; fixed values.
_DANGLING = r"(?i)\s(?:the|a|an|on|of|to|for|from|by|at|in|with|and|or|this|next|coming|between|near|close|not|far)$"


def values(dialogues: DataFrame) -> DataFrame:
    """``rec_id, source, field, pos, text``: every turn text and context of the records.

    Null turns and texts give no row; a null model version is a source of its own (empty name).
    """
    source = F.coalesce(F.col("metadata.model_version"), F.lit("")).alias("source")
    each = F.concat(
        F.coalesce(F.transform("turns", lambda t, i: F.struct(F.lit("text").alias("field"), i.cast("int").alias("pos"), t["text"].alias("text"))), F.array()),
        F.array(F.struct(F.lit("context").alias("field"), F.lit(-1).alias("pos"), F.col("context").alias("text"))),
    )
    flat = dialogues.select("rec_id", source, F.explode(each).alias("v"))
    return flat.select("rec_id", "source", "v.field", "v.pos", "v.text").where(F.col("text").isNotNull())


def _tail(k, rate):
    """Chance of k or more events at a Poisson rate, bounded from above."""
    import numpy as np

    k, rate = np.maximum(k, 1e-9), np.maximum(rate, 1e-9)
    return np.where(k > rate, np.exp(np.minimum(0, k - rate + k * np.log(rate / k))), 1.0)


def fit_limits(lengths: pd.DataFrame) -> list[tuple[int, float]]:
    """(limit, posterior of censoring) from the columns ``length, n, n_cut`` of one source and field.

    Lengths are taken as log-normal, right-censored at the candidate limit:
    values that end openly there count as survivors. The likelihood is climbed
    by EM. The posterior is the share of open endings at that length which the
    density and the source's rate of open endings elsewhere don't explain.
    """
    import numpy as np

    lengths = lengths[lengths["length"] > 0].sort_values("length")
    if lengths.empty:
        return []
    x, n, cut = (lengths[c].to_numpy(float) for c in ("length", "n", "n_cut"))
    total, limits = n.sum(), []
    near = np.array([cut[np.abs(x - v) <= 5].sum() - c for v, c in zip(x, cut)]) / 10.0
    for k in np.flatnonzero((cut > near) & (_tail(cut, near + 0.1) < CHANCE)):
        limit, y = x[k], np.log(x)
        seen = n.copy()
        seen[k] -= cut[k]
        mu, sd = np.average(y, weights=n), max(0.05, math.sqrt(np.average((y - np.average(y, weights=n)) ** 2, weights=n)))
        for _ in range(30):
            z = (math.log(limit) - mu) / sd
            tail = max(1e-9, 0.5 * math.erfc(z / math.sqrt(2)))
            lam = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            e1, e2 = mu + sd * lam, mu * mu + sd * sd + sd * (math.log(limit) + mu) * lam
            m1 = ((seen * y).sum() + cut[k] * e1) / total
            m2 = ((seen * y * y).sum() + cut[k] * e2) / total
            mu, sd = m1, max(0.05, math.sqrt(max(1e-6, m2 - m1 * m1)))
        z = (math.log(limit) - mu) / sd
        density = math.exp(-z * z / 2) / (limit * sd * math.sqrt(2 * math.pi)) * total
        rate = max(0.001, (cut.sum() - cut[k]) / max(1.0, total - n[k]))
        explained = max(near[k], min(density, n[k]) * rate)
        limits.append((int(limit), float(max(0.0, min(0.999, 1 - explained / cut[k])))))
    return limits


def classified(vals: DataFrame) -> DataFrame:
    """The values without their texts, with ``length`` and ``end``."""
    return vals.select("rec_id", "source", "field", "pos", F.length("text").alias("length"), ending(F.col("text")).alias("end"))


def limits(ends: DataFrame) -> DataFrame:
    """``source, field, length, posterior`` of the candidate limits of every source.

    The fit sees counts by length, pre-aggregated before the shuffle, so its
    input per source is bounded by the number of distinct lengths.
    """
    hist = ends.groupBy("source", "field", "length").agg(F.count("*").alias("n"), F.count(F.when(F.col("end").isin("open", "broken"), 1)).alias("n_cut"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], key[1], l, p) for l, p in fit_limits(pdf)], columns=["source", "field", "length", "posterior"]).astype({"length": "int32", "posterior": "float64"})

    return hist.groupBy("source", "field").applyInPandas(run, "source string, field string, length int, posterior double")


def learned(counts: list[tuple[float | None, str, float]]) -> tuple[dict[str, float], dict[str, float]]:
    """What each class of ending adds to the log odds of a limit, and its log odds at no limit.

    From ``(posterior or None, class, n)`` by expectation and maximisation over
    the ways a value comes to its ending: cut at a limit (the posterior of its
    length is the prior), cut elsewhere, or whole. Values that end completely
    are whole by definition, and at most RARE of the others are cut at no limit:
    where more end openly, that is how whole values end there. The starting
    shares count as some values more, so that few rows decide nothing alone.
    """
    start, plain = dict(zip(CLASSES, CUT_START)), dict(zip(CLASSES, WHOLE_START))
    at, off, whole, rate = start, start, plain, ELSEWHERE
    total = sum(n for _, _, n in counts)
    for _ in range(ROUNDS):
        a, o, w = ({e: n * x for e, x in kind.items()} for n, kind in ((PRIOR_CUT, start), (PRIOR_CUT, start), (PRIOR_WHOLE, plain)))
        away, gone = PRIOR_WHOLE, PRIOR_WHOLE * ELSEWHERE
        for p, e, n in counts:
            prior, cut, seen = (rate, off, o) if p is None else (min(max(p, 0.001), 0.999), at, a)
            r = prior * cut[e] / (prior * cut[e] + (1 - prior) * whole[e]) if e in cut else 0.0
            if e in cut:
                seen[e] += n * r
                w[e] += n * (1 - r)
            if p is None:
                away, gone = away + n, gone + n * r
        at, off = ({e: x / sum(c.values()) for e, x in c.items()} for c in (a, o))
        whole = {e: x / (PRIOR_WHOLE + 2 * PRIOR_CUT + total - sum(a.values()) - sum(o.values())) for e, x in w.items()}
        rate = min(RARE, gone / away)
    return {e: math.log(at[e] / whole[e]) for e in CLASSES}, {e: math.log(rate * off[e] / ((1 - rate) * whole[e])) for e in CLASSES}


def scored(ends: DataFrame) -> DataFrame:
    """The frame ``source, field, length, end, ...`` with ``posterior`` (null at no limit) and ``odds``; above 0 is a cut.

    Learning sees counts by class and posterior in steps of a hundredth only,
    at most some hundred rows, whatever the number of values and sources.
    """
    at = ends.join(bounded(keep(limits(ends))), ["source", "field", "length"], "left")
    step = F.round("posterior", 2)
    counts = at.where(F.col("end") != "none").groupBy(step.alias("p"), "end").agg(F.count("*").alias("n")).collect()
    adds, away = learned([(r["p"], r["end"], float(r["n"])) for r in counts])
    says = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("end")]
    p = F.greatest(F.lit(0.001), F.least(F.lit(0.999), F.col("posterior")))
    return at.withColumn("odds", F.when(F.col("posterior").isNull(), says(away)).otherwise(F.log(p / (1 - p)) + says(adds)))


def cut_values(dialogues: DataFrame) -> DataFrame:
    """``rec_id, source, field, pos, length, end, posterior``: the cut values.

    The texts are read and classified once; what is kept for the second pass
    has no texts. Nulls, empty values and placeholders are no cases, repeated
    records each give their own rows, and whole values are judged at any
    length. Empty input gives no rows.
    """
    return scored(keep(classified(values(dialogues)))).where("odds > 0").drop("odds")


def rates(dialogues: DataFrame) -> DataFrame:
    """``model_version, field, n_values, n_cut, share_cut, limit_at``: how often each source cuts."""
    all_of = scored(keep(classified(values(dialogues)))).where(F.col("end") != "none")
    cut = F.coalesce(F.col("odds") > 0, F.lit(False))
    out = all_of.groupBy("source", "field").agg(F.count("*").alias("n_values"), F.count_if(cut).alias("n_cut"), F.max_by("length", F.when(cut & (F.col("posterior") > 0.5), F.col("posterior"))).alias("limit_at"))
    return out.select(F.col("source").alias("model_version"), "field", "n_values", "n_cut", (F.col("n_cut") / F.col("n_values")).alias("share_cut"), "limit_at")
