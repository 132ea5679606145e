"""Keyword-stuffed pages, link lists and tag lists: bagged trees on weak labels, smoothed by host.

Weak labels come from the share of words outside sentences, where it is plain.
The trees never see that share: they learn from the page's words, marks and
links, and judge pages whose lines are hard to tell as well.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm.langid import FUNCTION_WORDS
from turnloom.sources.tables import keep, parallel

#: Labelled pages the trees are fitted on, at most; taken by the hash of their id.
TRAINING = 20_000
#: Shares of words outside sentences from which a page is weakly labelled spam, and up to which it is not.
SURE_SPAM, SURE_PROSE = 0.75, 0.25
#: Trees, their depth, and the weight of a page's own score beside its host's rate.
TREES, DEPTH, OWN = 20, 5, 0.8
#: Smoothed score from which a page is a candidate, and share of words outside sentences that makes it a case.
CANDIDATE, CASE = 0.5, 0.5
#: Pages a host needs for its rate to count as its own; fewer are drawn towards the rate of all.
HOST_PRIOR = 20

#: Function words that keywords and link labels use too; fixed values.
_WORDY = set("me near more all up out now top last best you here not more about free todo más plus sin sur pas de la du no our go home page en".split())
#: Content words among the marks of languages: they tell the language but make no sentence; fixed values.
_CONTENT = set("reservar reserva reservering rezerwacja rezervasyon boeking prenotazione numero número numer nummer numara casa río rio rzeką fiume ev nehir dom uur uhr wonderful lovely indeed viaje lugar plats plads platz".split())
_FUNCTION = {w for words in FUNCTION_WORDS.values() for w in words.split()} - _WORDY - _CONTENT - {"great", "perfect", "good", "hotel", "e", "o", "i"}
_URL = re.compile(r"(?:https?:)?//\S+|www\.\S+|\b[\w-]+(?:\.[\w-]+)*\.(?:example|com|org|net|info|biz)(?:/\S*)?", re.I)
_ANCHOR = re.compile(r"<a\b[^<>]*>", re.I)
_MARKUP = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_HASH = re.compile(r"#\w+")
_WORD = re.compile(r"[^\W_]+(?:['’-][^\W_]+)*")
_PIECE = re.compile(r"(?<=[.!?。！？])[\"'”’)]*\s+")
_END = re.compile(r"[.!?。！？…:][\"'”’)\]]*$")
_TIMED = re.compile(r"^\W*\d{1,2}[:.h]\d\d\b|\b\d{1,2}[:.]\d\d\s*[-–—]\s*\d{1,2}[:.]\d\d\b|\b(?:platform|gleis|quai|voie|andén|gate)\s+\d+", re.I)
_PRICED = re.compile(r"[:\s.…-]\s*(?:[€$£]\s*)?\d+(?:[.,]\d\d?)?\s*(?:[€$£]|[^\W\d]{3,10})\W*$")
_TERM = re.compile(r"^\W*[^\W\d][^:–—.!?]{1,40}\s*(?:[:–—]|\s-\s)\s*\S+(?:\s+\S+){2,}")
_SPEAKER = re.compile(r"^\W*(?:Q|A|User|SupportBot|Bot|Agent|Customer|Frage|Antwort|Pregunta|Respuesta|Question|Réponse)\s*:", re.I)
_STEP = re.compile(r"^\s*(?:step\s+)?\d{1,2}[.):]\s+\S", re.I)
_TAGS = re.compile(r"^\W*(?:tags?|tagged|labels?|keywords?|filed under|schlagwörter|schlagworte|étiquettes?|mots[- ]clés|etiquetas?|palabras clave|topics?|categories)\b\s*[:\-–—]", re.I)


_DIGIT = re.compile(r"\d")
_LINES = re.compile(r"[\r\n]+")
_MARKS = re.compile(r"[.!?](?=\s|$)")
_SEPARATORS = re.compile(r"[,;|·/•]|\s-\s")
_HOSTED = re.compile(r"//|www\.|\.(?:example|com|org|net|info|biz)\b", re.I)
_is_function = _FUNCTION.__contains__


def pieces(text: str) -> Iterator[tuple[str, list[str], int, int, int]]:
    """(kind, words, count, links, hashes) over the lines and sentences of a text.

    Kinds: ``prose`` sentences, ``data`` rows of timetables, price lists,
    glossaries and steps, ``link`` addresses with their labels, ``tag`` words
    behind a tag mark, ``key`` words that form no sentence. Addresses and hash
    tags come as pieces of their own without words. Patterns that need a
    certain character are tried only where it stands.
    """
    for line in _LINES.split(text):
        line = line.strip()
        if not line:
            continue
        anchors, plain = 0, line
        if "<" in line:
            anchors, plain = len(_ANCHOR.findall(line)), _MARKUP.sub(" ", line)
        links = anchors
        if "." in plain or "//" in plain:
            if _HOSTED.search(plain):
                plain, n = _URL.subn(" ", plain)
                links += n
            elif links:
                plain = _URL.sub(" ", plain)
        if "#" in plain:
            plain, tags = _HASH.subn(" ", plain)
            if tags:
                yield "tag", [], tags, 0, tags
        tagged = bool(_TAGS.match(plain))
        for k, piece in enumerate(_PIECE.split(plain)):
            ws = _WORD.findall(piece)
            if not ws:
                continue
            n = len(ws)
            lows = [w.lower() for w in ws]
            function = sum(map(_is_function, lows))
            digits = _DIGIT.search(piece)
            if tagged and k == 0:
                kind = "tag"
            elif digits and (_TIMED.search(piece) or (n <= 14 and not links and _PRICED.search(piece))):
                kind = "data"
            elif (
                (n >= 3 and function >= max(1, 0.05 * n) and _END.search(piece)) or (n >= 6 and function >= 0.25 * n)
                or (n >= 10 and function >= 0.1 * n and len(set(lows)) >= 0.7 * n) or (":" in piece and _SPEAKER.match(piece))
            ):
                kind = "prose"
            elif not links and function >= 0.15 * n and _TERM.match(piece):
                kind = "data"
            elif digits and function and _STEP.match(piece):
                kind = "data"
            elif not ws[0].isascii() and max(piece) > "ʯ" and not any(c.isascii() and c.isalpha() for c in piece):
                kind = "data"
            else:
                kind = "link" if links else "key"
            yield kind, ws, n, 0, 0
        if links:
            yield "link", [], links, links, 0


FEATURES = ("function", "marks", "variety", "top_word", "links", "hashes", "separators", "digits", "line_words", "rows", "capitals", "piece_words", "bigrams", "log_words")


def measures(text: str | None) -> tuple[float, int, list[float]]:
    """(share of words outside sentences, words, FEATURES) of one page."""
    if not text or not text.strip():
        return 0.0, 0, [0.0] * len(FEATURES)
    counts: Counter = Counter()
    ws: list[str] = []
    parts = short_first = links = hashes = rows = 0
    for kind, own, n, l, h in pieces(text):
        if parts == 0 and kind == "key" and n <= 8 and "\n" in text:
            short_first = n
        counts[kind] += n
        parts += 1
        links, hashes, rows = links + l, hashes + h, rows + (kind == "data")
        ws += own
    total = sum(counts.values())
    if short_first and counts["prose"] + counts["data"] > 0:
        counts["key"] -= short_first
    outside = counts["key"] + counts["link"] + counts["tag"]
    lows = [w.lower() for w in ws]
    seen = Counter(lows)
    n, lines = max(1, total), max(1, text.count("\n") + 1)
    features = [
        sum(map(_is_function, lows)) / n,
        len(_MARKS.findall(text)) / n,
        len(seen) / n**0.5,
        max(seen.values(), default=0) / n,
        links / n,
        hashes / n,
        len(_SEPARATORS.findall(text)) / n,
        sum(map(str.isdigit, lows)) / n,
        n / lines,
        rows / max(1, parts),
        sum(map(str.istitle, ws)) / n,
        n / max(1, parts),
        (max(0, len(lows) - 1) - len(set(zip(lows, lows[1:])))) / n,
        float(len(str(n))),
    ]
    return outside / total if total else 0.0, total, features


def measured(documents: DataFrame) -> DataFrame:
    """``doc_id, host, outside, n_words`` and one column per feature, of every page; whole texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [measures(t if isinstance(t, str) else None) for t in b["text"]]
            out = pd.DataFrame({"doc_id": b["doc_id"], "host": b["host"], "outside": [r[0] for r in rows], "n_words": pd.Series([r[1] for r in rows], dtype="int32")})
            for k, name in enumerate(FEATURES):
                out[name] = [r[2][k] for r in rows]
            yield out

    schema = "doc_id bigint, host string, outside double, n_words int, " + ", ".join(f"{f} double" for f in FEATURES)
    return parallel(documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("host"), "text")).mapInPandas(run, schema)


def scored(documents: DataFrame) -> DataFrame:
    """``doc_id, host, outside, n_words, own, score``: own and host-smoothed score of every page.

    Bagged trees (all features at every split, bootstrap samples) are fitted on
    at most TRAINING weakly labelled pages and applied to all. The host's rate
    is the mean score of all its pages, drawn towards the mean of all pages for
    small hosts; pages without a host have only their own. Without labels of
    both kinds the share outside sentences itself is the score.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = keep(measured(documents))
    label = F.when(F.col("n_words") < 5, None).when(F.col("outside") >= SURE_SPAM, 1.0).when(F.col("outside") <= SURE_PROSE, 0.0)
    sample = keep(rows.withColumn("label", label).where(F.col("label").isNotNull()).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINING).select("label", *FEATURES))
    kinds = sample.select("label").distinct().count()
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    if kinds == 2:
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True, seed=7)
        model = forest.fit(assembler.transform(sample))
        own = model.transform(assembler.transform(rows)).withColumn("own", vector_to_array("probability")[1])
    else:
        own = rows.withColumn("own", F.col("outside"))
    own = keep(own.select("doc_id", "host", "outside", "n_words", "own"))
    rates = own.where(F.col("host").isNotNull()).groupBy("host").agg(F.sum("own").alias("s"), F.count("*").alias("k"))
    mean = own.agg(F.avg("own")).first()[0] or 0.0
    smooth = rates.select("host", ((F.col("s") + HOST_PRIOR * mean) / (F.col("k") + HOST_PRIOR)).alias("rate"))
    return own.join(smooth, "host", "left").select("doc_id", "host", "outside", "n_words", "own", (F.col("own") * OWN + F.coalesce("rate", "own") * (1 - OWN)).alias("score"))


def found(documents: DataFrame) -> DataFrame:
    """``doc_id`` of the pages with more than half of their words outside sentences.

    Candidates are the pages with a high smoothed score; the exact share
    decides. Null, empty and blank texts are no cases, repeated pages each give
    a row, empty input gives none.
    """
    return scored(documents).where((F.col("score") >= CANDIDATE) & (F.col("outside") > CASE)).select("doc_id")
