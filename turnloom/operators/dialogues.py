"""Dialogue records as one row each: normal form, features, checks and failure detectors.

All of them are expressions over the array of turns of one row: no shuffle, no
Python. Null records of the array are dropped, null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as X
from turnloom.sources.tables import parallel, strip

# The word lists and limits that results depend on.
MIN_TURNS, MAX_TURNS, REPEATED = 6, 15, 0.6
PROFANE = ["damn", "hell", "crap", "stupid", "idiot", "moron", "fuck", "shit", "bitch", "asshole", "dumb"]
SATISFIED = ["thank you", "thanks", "perfect", "great", "excellent", "that's great", "that works", "sounds good", "all set", "i'm all set", "that'll work", "booked", "confirmed", "reserved", "done", "completed", "appreciate it", "good, thank"]
COMPLETED = ["thank you", "thanks", "perfect", "great", "excellent", "booked", "confirmed", "reserved", "done", "completed", "sounds good", "that works"]
PLEASED = ["thank", "thanks", "perfect", "great", "excellent", "good", "sounds good", "all set", "that works", "that'll work", "appreciate it", "that's great"]
CLOSING = ["thank", "thanks", "perfect", "bye", "that's all", "all set"]
CONTRADICTION = ["i thought you said", "you already told me", "that contradicts", "earlier you said"]
INTENTS = {"booking": ["book", "reserve", "reservation", "ticket"], "search": ["find", "search", "looking for", "look for"], "info": ["information", "details", "tell me", "explain"]}
REQUESTABLE = ["phone", "address", "postcode", "reference number", "price", "availability", "time", "date"]
CONSTRAINTS = {"area": r"(?:area|location|in|near)\s*(?:is|:|=)?\s*([a-z]+)", "price": r"(?:price|price range|budget)\s*(?:is|:|=)?\s*([a-z]+)", "type": r"(?:type|kind|style)\s*(?:is|:|=)?\s*([a-z]+)"}
DOMAIN_WORDS = {
    "hotel": ["hotel", "accommodation", "room", "booking", "reservation"],
    "restaurant": ["restaurant", "food", "dining", "meal", "cuisine", "eat"],
    "taxi": ["taxi", "cab", "ride", "transport", "pickup"],
    "train": ["train", "railway", "station", "ticket", "journey"],
    "attraction": ["attraction", "sightseeing", "museum", "tour", "visit", "place"],
}
STOP = "a an the to of in on for and or is it at be as by not we you i are was were this that with from have has had can could would should need please hi hello".split()
DRIFT_FIRST, DRIFT_PART, DRIFT_MOST = 0.12, 0.22, 0.35
QUESTION_ALIKE, QUESTION_LEAST = 0.72, 12
INCOHERENT, INCOHERENT_LEAST = 0.07, 14
NAME, NAME_LEAST, CODE = r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b", 8, r"\b(?:[A-Z]{2,}-\d{2,}|[A-Z]{3,}\d{3,})\b"
SLOT_WORDS = {
    "hotel": ["area", "price_range", "stars", "parking", "internet", "number", "check"],
    "restaurant": ["area", "food_type", "cuisine", "price_range", "number", "time"],
    "taxi": ["departure", "destination", "time", "number"],
    "train": ["departure", "destination", "date", "time", "number"],
    "attraction": ["area", "type", "opening", "date"],
    "technical_support": ["problem", "symptom", "diagnostic", "resolution", "user"],
}
OTHER_SLOT_WORDS = ["relevant"]
TASK_INTENTS = [(["book", "reserve"], ["book", "reserve", "booking", "reservation"]), (["find", "search"], ["find", "search", "looking for"]), (["information", "details"], ["information", "details", "tell me"])]
TASK_CONFIRMED, TASK_DONE = ["yes", "confirmed", "done", "booked", "found"], ["thank", "perfect", "great", "excellent"]
OPEN = ["?", "please", "could you", "can you", "would you", "confirm", "provide", "let me know", "proceed with", "check the", "check availability", "share the", "give me", "tell me", "send me", "book ", "reserve", "availability"]
THANKS = ["thank you", "thanks", "perfect", "all set", "appreciate", "that's perfect", "that's all i needed"]
GOODBYE = ["you're welcome", "glad i could", "anything else", "feel free to let me know", "feel free to ask", "if you need", "further assistance", "have a safe trip", "need any more", "any more questions"]
LOOP, LOOP_WINDOW = 0.45, 4
CLOSURE = ["thank you", "thanks", "perfect", "great", "that works", "all set", "resolved", "that fixed", "it's working", "appreciate it"]
COMMITMENT = r"(?i)\b(confirmed|booked|reserved|reservation|reference|pickup|your taxi|table for|i've arranged|all set on our side|ticket|case (?:number|id)|escalat|patch|update available|reset|restart|network adapter|settings)\b"
# per domain: (pattern the goal must match for the rule to count, or None; pattern the dialogue must match)
RULES = {
    "hotel": [
        (None, r"\b(book|booked|confirm|reserved|reservation|reference|check[- ]?in|hold the room|availability|nights?)\b"),
        (r"\b(night|tonight|tomorrow|check[- ]?in|check[- ]?out|guests?|star|parking|wifi)\b", r"\b(night|tonight|tomorrow|date|pm|am|check|guest|star|park|wifi|room)\b"),
    ],
    "restaurant": [
        (None, r"\b(reserv|table|booked|confirm|dinner|lunch|party|people|guests|italian|indian|vegetarian|cuisine)\b"),
        (r"\b(time|dinner|lunch|pm|am|party|people|guest|vegetarian|vegan|italian)\b", r"\b(time|dinner|lunch|pm|am|table|seat|people|party|vegetarian|italian)\b"),
    ],
    "taxi": [
        (None, r"\b(from|pickup|collect|to |destination|airport|station|drop)\b"),
        (None, r"\b(?:\d{1,2}:\d{2}|\d{1,2}\s*(?:am|pm)|pickup|leave at|depart)\b"),
        (None, r"\b(confirmed|booked|reservation|reference|driver|assigned|cab is on the way|on the way|your ride is)\b"),
    ],
}
COMPLETE_LEAST, RULE_WEIGHT, BONUS = 0.72, 0.65, 0.35
CATEGORIES = ["goal_drift", "hallucinated_entities", "repeated_questions", "forgotten_slots", "incoherent_transitions", "early_task_termination"]


def normal(dialogues: DataFrame) -> DataFrame:
    """``rec_id, version_id, dialogue_id, goal, domain, model, score, context, turns``: the common form of a record.

    Beside them ``sets`` (role, length and word set of each turn), ``body`` (all
    texts, lower case) and ``goal_words``.

    ``turns`` is an array of (role, text) without nulls, ``domain`` trimmed,
    lower case and ``unknown`` if blank, ``score`` null where it is NaN. A table
    of fewer scan partitions than task slots is spread before the costly part.
    """
    turns = F.transform(F.filter(F.coalesce("turns", F.array()), lambda t: t.isNotNull()), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    name = F.lower(strip(F.col("domain")))
    score = F.col("metadata.quality_score")
    base = dialogues.select("rec_id", "version_id", "dialogue_id", F.coalesce("goal", F.lit("")).alias("goal"), F.when(name.isNull() | (name == ""), "unknown").otherwise(name).alias("domain"), F.coalesce("metadata.model_version", F.lit("unknown")).alias("model"), F.when(~F.isnan(score), score).alias("score"), F.coalesce("context", F.lit("")).alias("context"), turns.alias("turns"))
    return with_sets(parallel(base))


def with_sets(base: DataFrame) -> DataFrame:
    """The records with ``sets``, ``body`` and ``goal_words`` computed from their turns and goal.

    Columns of their own, so that an expression using one several times computes it once; unused ones are pruned.
    """
    sets = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), F.length(strip(t["text"])).alias("n"), X.pieces(t["text"]).alias("w")))
    return base.withColumns({"sets": sets, "body": F.lower(F.array_join(F.transform("turns", lambda t: t["text"]), " ")), "goal_words": X.content_words(F.col("goal"), STOP)})


def texts(role: str | None = None) -> Column:
    """The texts of the turns in order, of one role or of all."""
    kept = F.col("turns") if role is None else F.filter("turns", lambda t: t["role"] == role)
    return F.transform(kept, lambda t: t["text"])


def whole() -> Column:
    """All texts of a dialogue as one lower-case text."""
    return F.col("body")


def neighbours(least: int = 1) -> Column:
    """Word-set similarity of each turn with the next; null where one is shorter than ``least``."""
    alike = lambda a, b: F.when((a["n"] >= least) & (b["n"] >= least), X.jaccard(a["w"], b["w"]))
    rest = lambda s: F.greatest(F.size(s) - 1, F.lit(0))
    return X.once(F.col("sets"), lambda s: F.zip_with(F.slice(s, F.lit(1), rest(s)), F.slice(s, F.lit(2), rest(s)), alike))


def _mean(values: Column) -> Column:
    """Mean of an array without its nulls, 0 of none; the array is computed once."""
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"))
    add = lambda a, x: F.when(x.isNull(), a).otherwise(F.struct((a["s"] + x).alias("s"), (a["n"] + 1).alias("n")))
    return F.aggregate(values, start, add, lambda a: F.coalesce(F.try_divide(a["s"], a["n"]), F.lit(0.0)))


def coherence() -> Column:
    """Mean similarity of neighbouring turns that both have words; 0 without any."""
    return _mean(neighbours())


def satisfied() -> Column:
    """True if a user says one of the phrases of satisfaction in the last three turns."""
    recent = F.filter(F.slice("turns", F.greatest(F.size("turns") - 2, F.lit(1)), F.lit(3)), lambda t: t["role"] == "User")
    return F.exists(F.transform(recent, lambda t: F.lower(t["text"])), lambda s: X.holds_any(s, SATISFIED))


def checks(d: DataFrame) -> DataFrame:
    """The six heuristic checks of each dialogue and the share of them passed."""
    at = F.sequence(F.lit(0), F.size("turns") - 1)
    roles = F.transform("turns", lambda t: t["role"])
    due = F.when(F.size("turns") > 0, F.transform(at, lambda i: F.when(i % 2 == 0, "User").otherwise("SupportBot")))
    goal_words = X.pieces(F.col("goal"))
    out = d.select(
        "rec_id", "domain", "score",
        F.size("turns").between(MIN_TURNS, MAX_TURNS).alias("length_ok"),
        (~F.exists(neighbours(0), lambda s: F.coalesce(s > REPEATED, F.lit(False)))).alias("repetition_ok"),
        (~X.holds_any(whole(), PROFANE)).alias("language_ok"),
        F.coalesce((F.size("turns") >= 2) & (roles == due) & ~F.exists("turns", lambda t: strip(t["text"]) == ""), F.lit(False)).alias("roles_ok"),
        F.exists(goal_words, lambda w: whole().contains(w)).alias("goal_ok"),
        (~F.exists("turns", lambda t: F.length(strip(t["text"])) < 3)).alias("answers_ok"),
    )
    names = ["length_ok", "repetition_ok", "language_ok", "roles_ok", "goal_ok", "answers_ok"]
    return out.withColumn("heuristic", sum((F.col(c).cast("int") for c in names), F.lit(0)) / 6)


def _fulfilled() -> Column:
    """True if a word of an intent that the goal names stands in the dialogue with a confirmation close behind it.

    Any word of the intent counts, not only the goal's own; close is within 200
    characters from its first place. A goal without an intent needs thanks only.
    """
    goal, all_ = F.lower("goal"), whole()
    out, named = F.lit(False), F.lit(False)
    for signs, said in TASK_INTENTS:
        asked = X.holds_any(goal, signs)
        named = named | asked
        for word in said:
            at = F.instr(all_, word)
            out = out | (asked & (at > 0) & X.holds_any(F.substring(all_, at, F.lit(200)), TASK_CONFIRMED))
    return F.when(named, out).otherwise(X.holds_any(all_, TASK_DONE))


def task_success() -> Column:
    """True if the user ends pleased and the intent of the goal was confirmed, or there were four turns."""
    last = F.get(F.reverse(F.filter("turns", lambda t: t["role"] == "User")), F.lit(0))["text"]
    pleased = X.holds_any(F.lower(F.coalesce(last, F.lit(""))), PLEASED)
    return (F.col("goal") != "") & (F.size("turns") > 0) & pleased & ((F.size("turns") >= 4) | _fulfilled())


def goal_completion() -> Column:
    """True if the goal's constraints stand in the dialogue, half its requests do, and it was completed."""
    goal, all_ = F.lower("goal"), whole()
    met = F.lit(True)
    for pattern in CONSTRAINTS.values():
        value = F.regexp_extract(goal, pattern, 1)
        met = met & ((value == "") | all_.contains(value))
    asked = F.filter(F.array(*map(F.lit, REQUESTABLE)), lambda r: goal.contains(r))
    answered = F.filter(asked, lambda r: all_.contains(r))
    return met & (F.size(answered) * 2 >= F.size(asked)) & X.holds_any(all_, COMPLETED)


def rule_completion() -> Column:
    """``score, complete`` by the rule table: part of the domain's rules met, and a bonus for closure with commitment.

    Domains without rules have one: closure or commitment. A dialogue is
    complete with a score of COMPLETE_LEAST or more and both.
    """
    goal = F.lower("goal")

    def judge(blob: Column) -> Column:
        closed, bound = X.holds_any(blob, CLOSURE), F.regexp_like(blob, F.lit(COMMITMENT))
        share = F.when(closed | bound, 1.0).otherwise(0.0)
        for name, rules in RULES.items():
            counts = [F.lit(1) if when is None else F.regexp_like(goal, F.lit(when)).cast("int") for when, _ in rules]
            met = [c * F.regexp_like(blob, F.lit(then)).cast("int") for c, (_, then) in zip(counts, rules)]
            share = F.when(F.col("domain") == name, sum(met[1:], met[0]) / sum(counts[1:], counts[0])).otherwise(share)
        score = F.round(RULE_WEIGHT * share + BONUS * F.when(closed & bound, 1.0).otherwise(BONUS), 4)
        return F.struct(score.alias("score"), ((score >= COMPLETE_LEAST) & closed & bound).alias("complete"))

    return X.once(F.concat_ws(" ", "body", goal, F.lower("context")), judge)


def open_request() -> Column:
    """True if the last turn is a user's and asks for something."""
    last = F.get("turns", F.size("turns") - 1)
    return F.coalesce((last["role"] == "User") & X.once(F.lower(strip(last["text"])), lambda s: (s != "") & X.holds_any(s, OPEN)), F.lit(False))


def loop() -> Column:
    """True if the dialogue ends in a loop: thanks and goodbyes only, or the last turns say what those before said."""
    w = LOOP_WINDOW

    def ends_in(last: Column, short: int, least: int) -> Column:
        of = lambda role: F.transform(F.filter(last, lambda t: t["role"] == role), lambda t: F.lower(strip(t["text"])))
        tail = (lambda a: a) if least == 1 else (lambda a: F.slice(a, F.greatest(F.size(a) - 1, F.lit(1)), F.lit(2)))
        return X.once(of("User"), lambda u: (F.size(u) >= least) & F.forall(tail(u), lambda s: X.holds_any(s, THANKS) | (F.length(s) < short))) & X.once(of("SupportBot"), lambda b: (F.size(b) >= least) & F.forall(tail(b), lambda s: X.holds_any(s, GOODBYE)))

    def judge(t: Column) -> Column:
        n = F.size(t)
        back = lambda k: F.slice(t, F.greatest(n - k + 1, F.lit(1)), F.lit(k))
        return ((n >= 4) & ends_in(back(4), 60, 1)) | ((n >= 6) & ends_in(back(6), 50, 2))

    again = X.once(F.col("sets"), lambda s: F.when(F.size(s) >= 2 * w, F.aggregate(F.zip_with(F.slice(s, F.greatest(F.size(s) - w + 1, F.lit(1)), F.lit(w)), F.slice(s, F.greatest(F.size(s) - 2 * w + 1, F.lit(1)), F.lit(w)), lambda a, b: X.jaccard(a["w"], b["w"])), F.lit(0.0), lambda x, y: x + y) / w >= LOOP).otherwise(False))
    return X.once(F.col("turns"), judge) | again


def drift() -> Column:
    """True if the goal's words stand in the first half of the turns but hardly in the second."""
    n = F.size("turns")
    mid = F.greatest(F.lit(2), F.floor(n / 2).cast("int"))
    part = lambda a: F.coalesce(F.try_divide(F.size(F.array_intersect("goal_words", X.content_words(F.array_join(F.transform(a, lambda t: t["text"]), " "), STOP))), F.size("goal_words")), F.lit(0.0))
    halves = F.array(F.struct(part(F.slice("turns", F.lit(1), mid)).alias("first"), part(F.slice("turns", mid + 1, F.greatest(n - mid, F.lit(0)))).alias("rest")))
    return (n >= 4) & (F.size("goal_words") >= 3) & F.exists(halves, lambda h: (h["first"] >= DRIFT_FIRST) & (h["rest"] < DRIFT_PART * h["first"]) & (h["rest"] < DRIFT_MOST))


def entities() -> Column:
    """Names and codes in support turns that neither the goal nor any earlier turn holds; the first four.

    Names are two or more capitalised words of NAME_LEAST characters in all,
    codes are of any length; of one turn names come before codes.
    """
    def fresh(t: Column, i: Column) -> Column:
        before = F.lower(F.concat_ws(" ", "goal", F.array_join(F.transform(F.slice("turns", F.lit(1), i), lambda p: p["text"]), " ")))
        names = F.filter(F.regexp_extract_all(t["text"], F.lit(NAME), F.lit(0)), lambda e: F.length(e) >= NAME_LEAST)
        said = F.concat(names, F.regexp_extract_all(t["text"], F.lit(CODE), F.lit(0)))
        named = X.once(said, lambda s: F.when(F.size(s) > 0, X.once(before, lambda b: F.filter(s, lambda e: ~b.contains(F.lower(e))))).otherwise(s))
        return F.when(t["role"] == "SupportBot", named).otherwise(F.array().cast("array<string>"))

    return F.slice(F.flatten(F.transform("turns", fresh)), 1, 4)


def forgotten_slots() -> Column:
    """Slot words of the domain that the goal holds and no turn does; the first six."""
    words = F.lit(None).cast("array<string>")
    for name, ws in SLOT_WORDS.items():
        words = F.when(F.col("domain") == name, F.array(*map(F.lit, ws))).otherwise(words)
    words = F.coalesce(words, F.array(*map(F.lit, OTHER_SLOT_WORDS)))
    goal = F.lower("goal")
    return F.slice(F.filter(words, lambda w: goal.contains(w) & ~F.col("body").contains(w)), 1, 6)


def early_termination() -> Column:
    """True if the last user turn closes the dialogue though its goal is not complete by the rules."""
    last = F.get(F.reverse(F.filter("turns", lambda t: t["role"] == "User")), F.lit(0))["text"]
    return F.coalesce(X.holds_any(F.lower(last), CLOSING), F.lit(False)) & ~rule_completion()["complete"]


def repeated_question() -> Column:
    """True if two user turns of some length have nearly the same words."""
    long = lambda t: (t["role"] == "User") & (t["n"] >= QUESTION_LEAST)
    again = lambda a, later: F.exists(later, lambda b: F.when(long(b), X.jaccard(a["w"], b["w"]) >= QUESTION_ALIKE).otherwise(False))
    tail = lambda s, i: F.slice(s, i + 2, F.greatest(F.size(s) - i - 1, F.lit(0)))
    return X.once(F.col("sets"), lambda s: F.exists(F.transform(s, lambda a, i: F.when(long(a), again(a, tail(s, i))).otherwise(False)), lambda x: x))


def incoherent() -> Column:
    """Positions of the first eight turns that share hardly a word with the one before."""
    pairs = F.transform(neighbours(INCOHERENT_LEAST), lambda s, i: F.when(s < INCOHERENT, i + 1))
    return F.slice(F.filter(pairs, lambda i: i.isNotNull()), 1, 8)


def spoken(d: DataFrame) -> DataFrame:
    """The records with the turns of user and support only."""
    keep = lambda t: t["role"].isin("User", "SupportBot")
    return with_sets(d.withColumn("turns", F.filter("turns", keep)))


def failures(d: DataFrame) -> DataFrame:
    """``rec_id, domain, categories``: the failures of each dialogue in their fixed order."""
    tests = [drift(), F.size(entities()) > 0, repeated_question(), F.size(forgotten_slots()) > 0, F.size(incoherent()) > 0, early_termination()]
    return spoken(d).select("rec_id", "domain", F.filter(F.array(*[F.when(t, name) for t, name in zip(tests, CATEGORIES)]), lambda c: c.isNotNull()).alias("categories"))


def domain_of_goal(goal: Column) -> Column:
    """The first domain one of whose words the goal holds, else ``general``."""
    out = None
    for name, ws in DOMAIN_WORDS.items():
        test = X.holds_any(F.lower(goal), ws)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def turn_rows(d: DataFrame) -> DataFrame:
    """``rec_id, domain, turn_id, role, text``: one row per turn, counted from 1."""
    return d.select("rec_id", "domain", F.posexplode("turns").alias("i", "t")).select("rec_id", "domain", (F.col("i") + 1).alias("turn_id"), "t.role", "t.text")


def last_turns(k: int) -> Column:
    """The last k turns that are not of the system."""
    kept = F.filter("turns", lambda t: t["role"] != "System")
    return F.slice(kept, F.greatest(F.size(kept) - k + 1, F.lit(1)), F.lit(k))


def without_runs() -> Column:
    """The turns without those that repeat role and text of the one before."""
    return F.filter("turns", lambda t, i: (i == 0) | (t != F.get("turns", i - 1)))


def step_reward() -> Column:
    """0.6 of the goal's words met in the last four turns and 0.4 of their coherence; 0 for fewer than two."""
    alike = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), X.jaccard(a["w"], b["w"]))

    def reward(s: Column) -> Column:
        n = F.size(s)
        last = F.slice(s, F.greatest(n - 3, F.lit(1)), F.lit(4))
        sims = F.zip_with(F.slice(last, 1, 3), F.slice(last, 2, 3), alike)
        met = X.once(X.pieces(F.col("goal")), lambda g: F.coalesce(F.try_divide(F.size(F.array_intersect(g, F.flatten(F.transform(last, lambda t: t["w"])))), F.size(g)), F.lit(0.0)))
        return F.when(n < 2, 0.0).otherwise(0.6 * met + 0.4 * _mean(sims))

    return X.once(F.col("sets"), reward)


def transcript() -> Column:
    """``role: text`` lines."""
    return F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(": "), t["text"])), "\n")


def story(name: Column) -> Column:
    """A training story: a title and one line per turn that has a text, quotes and back-slashes escaped."""
    escape = lambda s: F.regexp_replace(F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), r"\n", " ")
    lines = F.transform(F.filter("turns", lambda t: strip(t["text"]) != ""), lambda t: F.concat(F.when(F.lower(t["role"]) == "user", '- user: "').otherwise('- bot: "'), escape(t["text"]), F.lit('"')))
    return F.array_join(F.concat(F.array(F.concat(F.lit("story "), F.replace(name, F.lit(" "), F.lit("_")))), lines), "\n")
