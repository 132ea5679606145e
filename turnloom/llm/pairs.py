"""Defective question and answer pairs: empty, copied, refused, truncated or in another language."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import truncation
from turnloom.llm.langid import language
from turnloom.sources.tables import keep, parallel

#: Words a tile of the question must have in a row within the answer.
TILE = 2
#: Shares of the question's and of the answer's words in tiles from which an answer is a copy.
COPIED_QUESTION, COPIED_ANSWER = 0.7, 0.65
#: Evidence (weighted function words) from which a language is taken as known: question, answer.
KNOWN_QUESTION, KNOWN_ANSWER = 0.5, 1.0

_OPEN, _CLOSE = "([{", ")]}"
_TAG = re.compile(r"<(/?)([a-zA-Z][\w-]*)[^<>]*?(/?)>")
_EMOTICON = re.compile(r"[:;=8][-']?[()DPp\[\]{}]|<3")
_VOID = {"br", "hr", "img", "input", "meta", "link"}


def unclosed(text: str) -> list[str]:
    """The stack of fences, brackets, quotations and tags still open at the end of a text.

    A pushdown parser: an opener is pushed and its closer pops it together with
    whatever was left open inside. Inside a code fence only the fence counts.
    A list marker without an item at the end is left open as well; a straight
    quotation mark behind a digit is an inch.
    """
    stack: list[str] = []
    text = _EMOTICON.sub(" ", text)
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("```", i):
            if "```" in stack:
                del stack[stack.index("```"):]
            else:
                stack.append("```")
            i += 3
            continue
        if "```" in stack:
            i += 1
            continue
        if c in _OPEN:
            stack.append(c)
        elif c in _CLOSE:
            opener = _OPEN[_CLOSE.index(c)]
            if opener in stack:
                del stack[len(stack) - 1 - stack[::-1].index(opener):]
        elif c == '"' and ('"' in stack or not text[i - 1 : i].isdigit()):
            if '"' in stack:
                del stack[stack.index('"'):]
            else:
                stack.append('"')
        elif c in "“„«":
            stack.append("“")
        elif c in "”»" and "“" in stack:
            del stack[stack.index("“"):]
        elif c == "<" and (tag := _TAG.match(text, i)):
            name = tag[2].lower()
            if tag[1]:
                if f"<{name}>" in stack:
                    del stack[stack.index(f"<{name}>"):]
            elif not tag[3] and name not in _VOID:
                stack.append(f"<{name}>")
            i = tag.end()
            continue
        i += 1
    if re.search(r"(?:^|\n)\s*(?:[-*•]|\d{1,2}[.)])\s*$", text) and "\n" in text:
        stack.append("item")
    return stack


def words(text: str) -> list[str]:
    """Words for comparison: case, punctuation and white space aside."""
    return re.findall(r"\w+", text.lower().replace("'", "").replace("’", ""))


_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def tiles(a: list[str], b: list[str], least: int = TILE) -> int:
    """Words of ``a`` covered by greedy string tiling with ``b``: longest common runs first, none used twice.

    All tiles of one length are laid in one sweep from the left over rolling
    hashes of the runs that are still free; the next length is found by
    bisection. Lengths fall, and so many different ones can't fit, so the work
    is about n to the power of 1.5 at worst.
    """
    ids: dict[str, int] = {}
    sides = []
    for ws in (a, b):
        h = [0]
        for w in ws:
            h.append((h[-1] * _BASE + ids.setdefault(w, len(ids) + 1)) % _PRIME)
        sides.append((len(ws), h, [False] * len(ws)))
    power = [1]
    for _ in range(max(len(a), len(b))):
        power.append(power[-1] * _BASE % _PRIME)

    def runs(side: int, size: int) -> Iterator[tuple[int, int]]:
        """(start, hash) of the free runs of a length."""
        n, h, used = sides[side]
        free = 0
        for end in range(n):
            free = 0 if used[end] else free + 1
            if free >= size:
                yield end - size + 1, (h[end + 1] - h[end - size + 1] * power[size]) % _PRIME

    def common(size: int) -> bool:
        held = {x for _, x in runs(1, size)}
        return bool(held) and any(x in held for _, x in runs(0, size))

    covered, most = 0, min(len(a), len(b))
    while most >= least:
        lo, hi = least - 1, most  # a common run of lo words exists, none of more than hi
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        if lo < least:
            break
        where: dict[int, list[int]] = {}
        for j, x in runs(1, lo):
            where.setdefault(x, []).append(j)
        for js in where.values():
            js.reverse()
        used_a, used_b, clear = sides[0][2], sides[1][2], 0
        for i, x in list(runs(0, lo)):
            if i < clear:
                continue
            js = where.get(x, [])
            while js and any(used_b[js[-1] : js[-1] + lo]):
                js.pop()
            if js:
                j = js.pop()
                used_a[i : i + lo] = used_b[j : j + lo] = [True] * lo
                covered, clear = covered + lo, i + lo
        most = lo
        if not common(lo):
            most -= 1
    return covered


def copied(question: str, answer: str) -> bool:
    """True if the answer gives the question back, wholly or with trifling changes."""
    q, a = words(question), words(answer)
    if not q or not a:
        return False
    if "".join(q) == "".join(a):
        return len(q) > 1
    shared = set(q) & set(a)
    if sum(w in shared for w in q) < COPIED_QUESTION * len(q) or sum(w in shared for w in a) < COPIED_ANSWER * len(a):
        return False
    if len(q) == len(a) and sum(x == y for x, y in zip(q, a)) >= COPIED_QUESTION * len(q):
        return True
    covered = tiles(q, a)
    return covered >= COPIED_QUESTION * len(q) and covered >= COPIED_ANSWER * len(a)


# The refusal grammar: an opener that only excuses, a core that declines, a tail that offers nothing.
_SELF = r"(?:i|we|this assistant|the assistant|as an? (?:virtual |ai )?(?:assistant|model),? i)"
_NOT = r"(?:can ?not|can'?t|could ?n'?t|won'?t|will not|would rather not|'d rather not|am not|'m not|are not|'re not|do not|don'?t|must not)"
_HELP = r"(?:help|assist|answer|respond|reply|discuss|comment|share|provide|give|do (?:that|this)|go into|talk about|support|handle|process|speak|continue)"
REFUSAL = re.compile(
    "|".join(
        [
            rf"\b{_SELF} ?{_NOT} (?:be )?(?:\w+ ){{0,3}}?{_HELP}\b",
            rf"\b{_SELF} ?(?:{_NOT}) (?:able|permitted|allowed|authori[sz]ed|willing|in a position|comfortable)\b",
            rf"\b(?:unable|not able|not permitted|not allowed|not authori[sz]ed|not willing) to {_HELP}",
            r"\b(?:outside|beyond) (?:of )?(?:what|my|our|the scope)\b.{0,20}\b(?:discuss|abilit\w+|scope|remit|answer|help|do|handle|guidelines)\b",
            r"\bnot (?:be )?within my (?:abilit\w+|power|remit|scope)\b",
            r"\b(?:have|need|must|going) to (?:decline|refuse|pass on)\b|\bi (?:decline|refuse)\b|\bmust (?:decline|refuse)\b",
            r"\bturn (?:this|that|the|your) (?:\w+ )?down\b",
            r"\bno (?:comment|answer|reply|response|help|advice)\b.{0,25}\b(?:can|may|will|from me|given|offered|possible)\b",
            r"\bnot be (?:appropriate|proper|right) for me\b|\bnot (?:a|the) (?:topic|subject|question|matter)\b.{0,20}\b(?:willing|going to|able|discuss|go into)\b",
            r"^\W*(?:request|question|answer|access)? ?(?:declined|refused|denied|rejected)\W*$",
            r"\bno comment\b",
            r"\b(?:ich|wir) (?:kann|darf|können|dürfen|möchte|werde)\b.{0,40}\bnicht\b.{0,30}\b(?:helfen|beantworten|antworten|weiterhelfen|auskunft|geben|sagen|eingehen|besprechen)\b|\b(?:kann|darf|muss) ich (?:leider )?(?:dazu |dabei |das |diese \w+ )?(?:nicht|nichts|keine|ablehnen)\b|\bmuss (?:ich )?.{0,40}ablehnen\b|\bnicht (?:befugt|berechtigt|in der lage)\b",
            r"\bje ne (?:peux|suis|puis|saurais|souhaite|veux)\b.{0,40}\b(?:pas|autorisée?|répondre|aider)\b|\bje (?:dois|préfère) (?:refuser|décliner|ne pas)\b|\bimpossible (?:pour moi )?de (?:répondre|vous aider)\b",
            r"\bno (?:puedo|podemos|me es posible|estoy autorizad[oa]|me está permitido|tengo permitido)\b.{0,40}\b(?:ayudar\w*|responder\w*|contestar\w*|dar\w*|hablar|comentar|atender\w*|eso|esa|esta|esto)\b|\b(?:debo|tengo que) (?:rechazar|declinar)\b|\bno estoy autorizad[oa]\b",
        ]
    ),
    re.I,
)
#: Signs that bad news comes with an alternative.
_OFFER = re.compile(r"\b(?:but|however) (?:\w+ ){1,4}(?:offers?|has|have|is|are)\b.{0,40}\b(?:one|free|available|open)\b|\bon hold instead\b|\binstead\b|\byou (?:could|can|may|might) (?:try|take|book|use|ask for)\b|\bhow about\b|\bi (?:can|could) (?:offer|hold|book|suggest)\b|\bi (?:found|have (?:found|put))\b", re.I)


def refused(answer: str) -> bool:
    """True if the answer declines to help and offers nothing."""
    text = answer.replace("’", "'")
    return bool(REFUSAL.search(text)) and not _OFFER.search(text)


def judged(dialogues: DataFrame) -> DataFrame:
    """``rec_id, pos, source, length, end, found, stack``: each pair with what is seen in it alone.

    ``found`` is ``empty, copy, refusal, other_language`` or an empty string;
    ``stack`` counts structures left open. Null elements of ``pipeline_turns``
    are pairs without an answer. A question that shows no language is taken to
    be in that of all questions of its dialogue.
    """
    texts = lambda name: F.transform("pipeline_turns", lambda p: p[name])
    rows = dialogues.where(F.size("pipeline_turns") > 0).select("rec_id", F.coalesce(F.col("metadata.model_version"), F.lit("")).alias("source"), texts("user_response").alias("questions"), texts("support_response").alias("answers"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for rec, source, questions, answers in zip(b["rec_id"], b["source"], b["questions"], b["answers"]):
                spoken = None
                for pos, (q, a) in enumerate(zip(questions, answers)):
                    q, kind, open_ = q or "", "", 0
                    if a is not None:
                        open_ = len(unclosed(a))
                        if copied(q, a):
                            kind = "copy"
                        elif refused(a):
                            kind = "refusal"
                        else:
                            la = language(a)
                            if la[1] >= KNOWN_ANSWER and len(words(a)) >= 4:
                                lq = language(q)
                                if lq[1] < KNOWN_QUESTION:
                                    spoken = spoken or language("\n".join(x for x in questions if x))
                                    lq = spoken
                                if lq[1] >= KNOWN_QUESTION and lq[0] != la[0]:
                                    kind = "other_language"
                    out.append((rec, pos, source, a, kind, open_))
            yield pd.DataFrame(out, columns=["rec_id", "pos", "source", "answer", "found", "stack"])

    seen = parallel(rows).mapInPandas(run, "rec_id bigint, pos int, source string, answer string, found string, stack int").withColumn("end", truncation.ending(F.col("answer")))
    empty = F.col("answer").isNull() | ((F.col("end") == "none") & ~F.regexp_like("answer", F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]")))
    return seen.select("rec_id", "pos", "source", F.length("answer").alias("length"), "end", F.when(empty, "empty").otherwise(F.col("found")).alias("found"), "stack")


def defects(dialogues: DataFrame) -> DataFrame:
    """``rec_id, pos, defect``: every defective pair with its one defect.

    In this order: ``empty``, ``copy``, ``refusal``, ``truncated``,
    ``other_language``. The answer is truncated as in the truncation operator
    (limits fitted on the answers of each model version), where a structure
    left open makes the ending open, even behind a sentence mark. The fallback mark is not looked at:
    canned texts and the mark alone are no defects. Whole texts are judged,
    repeated records each give their rows, empty input gives none.
    """
    seen = keep(judged(dialogues))
    end = F.when((F.col("stack") > 0) & F.col("end").isin("closed", "complete"), "open").otherwise(F.col("end"))
    ends = seen.where(F.col("length").isNotNull()).withColumn("end", end).withColumn("field", F.lit("text"))
    at = truncation.scored(ends).unionByName(seen.where(F.col("length").isNull()), allowMissingColumns=True)
    defect = F.when(F.col("found").isin("empty", "copy", "refusal"), F.col("found")).when(F.col("odds") > 0, "truncated").when(F.col("found") == "other_language", "other_language")
    return at.withColumn("defect", defect).where(F.col("defect").isNotNull()).select("rec_id", "pos", "defect")
