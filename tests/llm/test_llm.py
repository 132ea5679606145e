import re

import pytest
from conftest import record
from pyspark.sql import functions as F

from turnloom.llm import cutoff, incremental, langid, leakage, pairs, repetition, spam, tokens, truncation


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_cutoffs_against_brute_force(spark):
    import random

    random.seed(1)
    data = [(k, random.choice("ab"), random.choice([None, round(random.random(), 2), round(random.random(), 6)])) for k in range(500)] + [(900 + k, "tie", 0.5) for k in range(7)] + [(999, "none", None)]
    rows = spark.createDataFrame(data, "rec_id bigint, source string, score double")
    goals = {"a": 33, "b": 70, "tie": 10, "none": 50, "absent": 50}
    cuts = cutoff.cutoffs(rows, spark.createDataFrame(list(goals.items()), "source string, keep_percent int"))
    want = {}
    for s, p in goals.items():
        scores = sorted((x for _, t, x in data if t == s and x is not None), reverse=True)
        for c in sorted(set(scores), reverse=True):
            if sum(x >= c for x in scores) * 100 >= p * len(scores):
                want[s] = (c, sum(x >= c for x in scores))
                break
    assert {r["source"]: (r["cutoff"], r["n_kept"]) for r in cuts.collect()} == want
    assert cutoff.kept(rows, cuts).count() == sum(n for _, n in want.values())


def test_cutoffs_on_edges_and_close_scores(spark):
    close = [0.3 + k * 1e-13 for k in range(40)] + [k / 65536 for k in range(0, 65537, 4096)] + [0.0, 1.0, 1.0]
    rows = spark.createDataFrame([("s", x) for x in close], "source string, score double")
    for percent in (1, 7, 33, 50, 81, 100):
        r = cutoff.cutoffs(rows, spark.createDataFrame([("s", percent)], "source string, keep_percent int")).first()
        cut = next(c for c in sorted(set(close), reverse=True) if sum(x >= c for x in close) * 100 >= percent * len(close))
        assert (r["cutoff"], r["n_kept"]) == (cut, sum(x >= cut for x in close))


def test_valid_scores(spark):
    df = spark.createDataFrame([(" Hotel\t", 1.0), (None, float("nan")), ("", 1.5), ("x", None), ("x", -0.1)], "d string, s double")
    got = df.select(cutoff.source_of(F.col("d")), cutoff.valid_score(F.col("s"))).collect()
    assert [tuple(r) for r in got] == [("hotel", 1.0), ("unknown", None), ("unknown", None), ("x", None), ("x", None)]


ENDINGS = {
    "complete": ["The room is booked for you today.", "Hmm, let me think...", "Right (as agreed).", 'He said "Any" is fine.', "Your booking is done, goodbye. ...", "Ist das Frühstück im Preis enthalten?"],
    "closed": ["Total: 439 crowns", "make it for two on sunday please", "Sounds good", "See you there 👍", "Great <3", "Here is the link: https://a-b.example/XY1", "Time noted; reference ABC12345", "Your options are:\n- attic room, 12 marks\n- single room, 9 marks", "Fine by me :)"],
    "open": ["The price of 54 crowns cove", "So that is a taxi for four adults on ", "Guten Tag, ich suche für 10.06."],
    "broken": ["There is a tidy room at the inn,", "We need two adu�", "It lies close to the li...", "I would rather ta-", "Then take the sty…"],
    "none": ["", "  ", None, "N/A", "—", "...", "[no response]", "​"],
}


def test_endings(spark):
    cases = [(kind, t) for kind, ts in ENDINGS.items() for t in ts]
    got = spark.createDataFrame(cases, "kind string, t string").select("kind", truncation.ending(F.col("t")).alias("e"), "t").collect()
    assert [(r["t"], r["e"]) for r in got if r["kind"] != r["e"]] == []


def test_limit_is_fitted():
    import pandas as pd

    n = [(x, 30, 1) for x in range(20, 100)] + [(100, 90, 80)]
    limits = dict(truncation.fit_limits(pd.DataFrame(n, columns=["length", "n", "n_cut"])))
    assert set(limits) == {100} and limits[100] > 0.9
    assert truncation.fit_limits(pd.DataFrame(columns=["length", "n", "n_cut"])) == []


def test_cut_values(dialogues):
    d = dialogues(record(1, ["We want a ta", None, "Fine."], context="A trip to Ro"), record(2, None), record(3, [""]))
    assert rows_of(truncation.cut_values(d).select("rec_id", "field", "pos")) == [(1, "context", -1), (1, "text", 0)]
    assert truncation.cut_values(d.limit(0)).count() == 0
    assert {r["field"]: r["n_cut"] for r in truncation.rates(d).collect()} == {"text": 1, "context": 1}


def test_the_posterior_decides(dialogues):
    """The same ending is a cut at its source's limit and none elsewhere; without whole-looking cuts nothing changes."""
    texts = [("We were told that the house by the river is open to " + "guest" * 20)[:90] for _ in range(80)]
    listed = "Your options with breakfast and all the other things that you wanted to have are:\n- a 12"
    assert len(listed) < 91
    at = listed + "x" * (90 - len(listed))
    full = [record(k, [t], model="cuts") for k, t in enumerate(texts)] + [record(100 + k, [at], model="cuts") for k in range(12)]
    whole = [record(200 + k, [f"The house number {k} is open{' all day' * (k % 9)}."], model=m) for k in range(400) for m in ("cuts", "free")]
    free = [record(900, [at], model="free")]
    d = dialogues(*full, *whole, *free)
    end = truncation.classified(truncation.values(d)).where("rec_id = 900").first()["end"]
    assert end == "closed"
    found = {r["rec_id"] for r in truncation.cut_values(d).collect()}
    assert found == {*range(80), *range(100, 112)}


def test_open_endings_are_whole_where_all_values_end_so(dialogues):
    """Among writers who set no marks an open ending says nothing."""
    d = dialogues(*[record(k, [f"We would like to see the houses of number {k} on Monday {'and so on ' * (k % 7)}{'o' * (k % 61)}Kerby"]) for k in range(3000)], *[record(5000 + k, ["They went into the li..."]) for k in range(3)])
    assert {r["rec_id"] for r in truncation.cut_values(d).collect()} == {5000, 5001, 5002}


def test_pair_defects(dialogues):
    d = dialogues(record(1, ["x"], pairs=[
        ("Is there a room for us?", None), ("Is there a room?", "N/A"), ("Is there a room for the two of us?", "You asked: is there a room for the two of us"), ("Can you book it?", "I regret to say I can't assist with this kind of request."),
        ("Can you book the large one?", "I can hold the large room for yo"), ("Where is the station and the hotel?", "Das Haus liegt ruhig am Fluss und hat einen kleinen Garten."),
        ("Is it free?", "I'm sorry, the room is taken on Monday, but Kerby House offers one with a lift."), ("Thanks", "Done."), (None, "Here you are."), ("Shall we go?", "Is 5 crowns fine (or more"),
    ]), record(2, None), record(3, ["y"], pairs=[]))
    assert rows_of(pairs.defects(d)) == [(1, 0, "empty"), (1, 1, "empty"), (1, 2, "copy"), (1, 3, "refusal"), (1, 4, "truncated"), (1, 5, "other_language"), (1, 9, "truncated")]


def test_pushdown_parser():
    assert pairs.unclosed("a (b [c] d) \"e\" <b>f</b> ```x( ```") == []
    assert pairs.unclosed('see (the "list') == ["(", '"'] and pairs.unclosed("```py\nx = (") == ["```"] and pairs.unclosed("fine :)") == [] and pairs.unclosed("a\n- b\n-") == ["item"]


def test_tiles_against_the_definition():
    import random

    def plain(a, b, least):
        a, b, covered = list(a), list(b), 0
        while True:
            best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next((k for k in range(min(len(a) - i, len(b) - j) + 1) if k == min(len(a) - i, len(b) - j) or a[i + k] != b[j + k]), 0)]), default=(0, 0, 0))
            if best[0] < least:
                return covered
            k, i, j = best[0], -best[1], -best[2]
            covered += k
            a[i : i + k], b[j : j + k] = [object() for _ in range(k)], [object() for _ in range(k)]

    random.seed(5)
    for n in range(120):
        a, b = ([random.choice("abcdefgh"[: 2 + n % 7]) for _ in range(random.randint(0, 25))] for _ in "ab")
        got, want = pairs.tiles(a, b), plain(a, b, 2)
        assert got == want, (a, b)
    long = [f"w{random.randrange(900)}" for _ in range(6000)]
    assert pairs.tiles(long, long[3000:] + long[:3000]) == 6000


def test_open_structures_make_answers_truncated(dialogues, monkeypatch):
    d = dialogues(record(1, ["x"], pairs=[("What does it cost?", "Here is the list (with breakfast. The room is nice."), ("And the code?", "Here it is:\n```py\nprint(1)."), ("How wide is it?", 'It is 12" wide.')]))
    assert rows_of(pairs.defects(d)) == [(1, 0, "truncated"), (1, 1, "truncated")]
    monkeypatch.setattr(pairs, "unclosed", lambda text: [])
    assert pairs.defects(d).count() == 0


def test_tiling_and_language():
    assert pairs.tiles("a b c d e".split(), "x c d e a b".split()) == 5
    assert langid.language("Das Haus ist nicht weit von der Straße")[0] == "de" and langid.language("Из города нужно ехать")[0] == "CYRILLIC" and langid.language(None) == ("", 0.0)


def test_repeated_words_against_definition():
    import random

    random.seed(3)
    for _ in range(200):
        w = [random.choice("abc") for _ in range(random.randint(0, 60))]
        hit = [False] * len(w)
        for i in range(len(w) - 4):
            if any(w[j : j + 5] == w[i : i + 5] for j in range(i)):
                hit[i : i + 5] = [True] * 5
        assert repetition.repeated_words(w) == sum(hit)


def test_repetition_cases(dialogues):
    line = "please come and see our fine new rooms by the river today"
    clean = [record(k, [f"first question number {k} about the place {k * 7}", f"some answer {k} with other words {k * 3} inside", f"thanks for {k}"]) for k in range(40)]
    d = dialogues(*clean, record(100, [line] * 5), record(101, [line, "short", line]), record(102, None), record(103, ["", None]))
    found = [r["rec_id"] for r in repetition.cases(d).collect()]
    assert sorted(found) == [100, 101]
    assert repetition.shares(d).count() == 44 and repetition.cases(d.limit(0)).count() == 0


def test_repetition_in_a_group_full_of_it(dialogues):
    clean = [record(k, [f"first question number {k} about the place {k * 7}", f"some answer {k} with other words {k * 3} inside"]) for k in range(130)]
    again = [record(1000 + k, [f"please come and see our fine new rooms {k} by the river today"] * 5) for k in range(120)]
    assert repetition.cases(dialogues(*clean, *again)).count() == 120


def test_outliers_decide_beside_the_share(dialogues, monkeypatch):
    """Without its distance a row is no case, however high its share."""
    clean = [record(k, [f"first question number {k} about the place {k * 7}", f"some answer {k} with other words {k * 3} inside"]) for k in range(40)]
    d = dialogues(*clean, record(100, ["please come and see our fine new rooms by the river today"] * 5))
    assert repetition.cases(d).count() == 1
    monkeypatch.setattr(repetition, "CHI2", 1e9)
    assert repetition.cases(d).count() == 0


def test_least_determinant_leaves_out_the_far_part():
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (6000, 3)), rng.normal(8, 0.3, (4000, 3))])
    m, c = repetition.least_determinant(x, np.ones(len(x)))
    assert np.abs(m).max() < 0.2 and (np.diag(c) > 0.7).all() and (np.diag(c) < 2.2).all()  # half of all are five sixths of the near part
    assert abs(repetition.consistency(0.5) - 2.46) < 0.02


def test_language_of_the_whole_dialogue(dialogues):
    d = dialogues(record(1, ["The room is free and you can have it for the night. " * 45, "Das Haus ist nicht weit von der Straße und wir haben noch ein Zimmer. " * 120]))
    assert repetition.shares(d).first()["lang"] == "de"


def talk(spark, rows):
    return spark.createDataFrame([(k, 1, None, name, None, None, turns, None) for k, name, turns in rows], "incoming_id bigint, batch_no int, arrived_at timestamp, dialogue_id string, goal string, domain string, turns array<struct<role:string,text:string>>, metadata struct<generated_at:string,model_version:string>")


def test_incremental_repeats(spark, dialogues):
    import random

    random.seed(5)
    vocabulary = [f"w{k}" for k in range(400)]
    make = lambda: [random.choice(vocabulary) for _ in range(90)]
    old, other, new = make(), make(), make()
    changed = [f"z{k}" if k % 9 == 4 else w for k, w in enumerate(old)]
    far = [f"z{k}" if k % 3 == 0 else w for k, w in enumerate(other)]
    say = lambda w: [("User", " ".join(w[:30]).upper() + "!"), ("SupportBot", " ".join(w[30:]))]
    hist = dialogues(record(1, [" ".join(old)], name="h1"), record(2, [" ".join(old)], name="h1"), record(3, [" ".join(other)], name="h3"), record(4, None), record(5, [""]))
    batch = talk(spark, [(10, "a", say(old)), (11, "b", say(changed)), (12, "c", say(far)), (13, "d", say(new)), (14, "e", say(new)), (15, "h3", say(make())), (16, "f", None), (17, "g", say([f"y{k}" if k % 10 == 2 else w for k, w in enumerate(new)])), (18, "h", [])])
    assert rows_of(incremental.repeats(hist, batch)) == [(10, "h1"), (11, "h1"), (14, "d"), (17, "d")]
    assert incremental.repeats(hist.limit(0), batch.limit(0)).count() == 0


def one_turn(spark, texts, start=0, name="n"):
    return talk(spark, [(k, f"{name}{k}", [("User", " ".join(w))]) for k, w in enumerate(texts, start)])


def sequential(held, batch):
    """{row: accepted originals that it repeats} by comparing all pairs in order."""
    accepted, out = list(held), {}
    for k, (name, w) in enumerate(batch):
        same = {n for n, x in accepted if incremental.lcs(w, x) >= incremental.SAME * max(len(w), len(x))}
        if same:
            out[k] = same
        else:
            accepted.append((name, w))
    return out


def agrees(got, want):
    got = {r["incoming_id"]: r["orig_dialogue_id"] for r in got.collect()}
    return got.keys() == want.keys() and all(got[k] in want[k] for k in got)


def test_repeats_among_templates(spark, dialogues):
    import random

    random.seed(8)
    vocabulary = [f"w{k}" for k in range(300)]
    make = lambda n: [random.choice(vocabulary) for _ in range(n)]
    foreign, held, batch = [make(120) for _ in range(60)], [], []
    for _ in range(25):
        template = make(100)
        held += [template + make(20)] + [template + make(40) for _ in range(4)]
        batch.append(template + random.choice(foreign)[:20])
    held += foreign
    hist = dialogues(*[record(k, [" ".join(w)], name=f"h{k}") for k, w in enumerate(held)])
    want = sequential([(f"h{k}", w) for k, w in enumerate(held)], [(f"n{k}", w) for k, w in enumerate(batch)])
    assert len(want) == 25
    assert agrees(incremental.repeats(hist, one_turn(spark, batch)), want)


@pytest.mark.parametrize("block", [70, 4096])
def test_crowds_of_altered_copies(spark, dialogues, monkeypatch, block):
    import random

    random.seed(4)
    monkeypatch.setattr(incremental, "BLOCK", block)
    base, rows = [f"w{k}" for k in range(60)], []
    for _ in range(200):
        at = random.sample(range(60), 9 if rows else 0)
        start = random.choice(rows) if len(rows) % 2 else base
        rows.append([f"a{k}_{random.randrange(6)}" if k in at else w for k, w in enumerate(start)])
    want = sequential([], [(f"n{k}", w) for k, w in enumerate(rows)])
    assert agrees(incremental.repeats(dialogues(record(1, None)), one_turn(spark, rows)), want)


def test_repeats_of_short_and_evenly_changed_conversations(spark, dialogues):
    import random

    random.seed(6)
    held, batch = [], []
    for n in [1, 2, 5, 6, 7, 11, 12, 18, 24, 25, 29, 30, 31, 35, 36, 37, 48, 60, 90]:
        for _ in range(3):
            w = [f"v{random.randrange(80)}" for _ in range(n)]
            held.append(w)
            batch += [[f"x{k}" if k % 6 == 3 else v for k, v in enumerate(w)], w[: n - n // 6], w + [f"y{k}" for k in range(n // 5)], [f"x{k}" if k % 4 == 3 else v for k, v in enumerate(w)]]
    hist = dialogues(*[record(k, [" ".join(w)], name=f"h{k}") for k, w in enumerate(held)])
    want = sequential([(f"h{k}", w) for k, w in enumerate(held)], [(f"n{k}", w) for k, w in enumerate(batch)])
    assert len(want) > 100
    assert agrees(incremental.repeats(hist, one_turn(spark, batch)), want)


def test_second_batch_needs_only_the_store(spark, dialogues, tmp_path):
    import random

    random.seed(7)
    make = lambda: [f"w{random.randrange(300)}" for _ in range(50)]
    a, b, c = make(), make(), make()
    first = incremental.repeats(dialogues(record(1, [" ".join(a)], name="h1")), one_turn(spark, [a, b]), path=str(tmp_path / "store"))
    assert rows_of(first) == [(0, "h1")]
    store = incremental.FingerprintStore(spark, str(tmp_path / "store"))
    altered = [f"z{k}" if k % 10 == 5 else w for k, w in enumerate(b)]
    assert rows_of(incremental.accept(store, one_turn(spark, [a, altered, c, c], 10, "m"))) == [(10, "h1"), (11, "n1"), (13, "m12")]
    assert rows_of(incremental.accept(store, one_turn(spark, [c], 20, "o"))) == [(20, "m12")]
    assert {r["name"] for r in store.names().collect()} == {"h1", "n1", "m12"}


def test_words_left_out_and_put_in_at_different_places():
    # runs of two and three words: five sixths in the same order, but few phrases in common
    import numpy as np
    import pandas as pd

    for n in (6, 12, 60, 170, 240, 600, 2000):
        a = np.arange(n, dtype=np.uint32)
        b = np.concatenate([[6 * k + 1, 6 * k + 2, 100_000 + k, *range(6 * k + 3, min(n, 6 * k + 6))] for k in range(n // 6)]).astype(np.uint32)
        c = np.where(np.arange(n) % 4 == 0, a + 50_000, a).astype(np.uint32)
        rows = pd.DataFrame({"id": [1, 2, 3], "stamp": [0, 0, 0], "words": [x.tobytes() for x in (a, b, c)]})
        same = [(2, 1)] if incremental.lcs(a.tolist(), b.tolist()) >= incremental.SAME * max(len(a), len(b)) else []
        assert [tuple(x) for x in incremental.among(rows)[["id", "other"]].itertuples(index=False)] == same


def test_a_large_batch_takes_one_pass_over_the_store(spark, dialogues, tmp_path, monkeypatch):
    # work grew with passes: one for every 4,096 rows, each over everything accepted
    import random

    random.seed(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    new = [random.choices(vocabulary, k=20) for _ in range(9000)]
    old = [random.choices(vocabulary, k=20) for _ in range(50)]
    new[77], new[8500], new[8999] = [*old[3][:18], "x", "y"], [*old[4][1:], "z"], [*new[10][:10], "u", *new[10][11:]]
    passes, search = [], incremental.FingerprintStore.matches
    monkeypatch.setattr(incremental.FingerprintStore, "matches", lambda self, ids, words: passes.append(len(ids)) or search(self, ids, words))
    hist = dialogues(*(record(k, [" ".join(x)], name=f"h{k}") for k, x in enumerate(old)))
    got = rows_of(incremental.repeats(hist, one_turn(spark, new), path=str(tmp_path / "store")))
    assert got == [(77, "h3"), (8500, "h4"), (8999, "n10")] and passes == [9000]


def test_bloom_filter():
    import numpy as np

    fps = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint32))
    raw = incremental.bloom_filter(fps)
    other = np.setdiff1d(np.random.default_rng(2).integers(0, 1 << 32, 5000, dtype=np.uint32), fps)
    assert incremental.maybe_held(raw, fps).all() and incremental.maybe_held(raw, other).mean() < 0.02


def test_lcs():
    assert incremental.lcs("abcde", "xbxde") == 3 and incremental.lcs("", "a") == 0


def test_encoding_round_trip(spark):
    import tiktoken

    ranks = tokens.load_ranks(f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken")
    whole = tiktoken.Encoding("whole", pat_str=tokens._pattern(tokens.VOCABULARIES), mergeable_ranks=ranks, special_tokens={})
    texts = ["it's a test-'s  \n\n x", "<|endoftext|> naïve 漢字 👍‍  .", "a" * 3000, " ", "\r\n\t'll", "x" + " " * 50 + "y", None, ""]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(0, texts[0])], "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = tokens.encode(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        t = texts[r["doc_id"]]
        assert r["ids"] == (whole.encode_ordinary(t) if t else [])
        assert whole.decode(r["ids"]) == (t or "")


def test_altered_runs_are_found_in_a_corpus_of_any_words():
    import random

    import numpy as np

    random.seed(3)
    vocabulary = [f"w{k}" for k in range(400)]
    passages = [[random.choice(vocabulary) for _ in range(40)] for _ in range(30)]
    weights = leakage.word_weights(passages)
    column = {w: k for k, w in enumerate(sorted(weights))}
    loadings = np.eye(len(column), dtype=np.float32)[:, : leakage.RANK]
    loadings = np.linalg.qr(np.random.default_rng(1).standard_normal((len(column), leakage.RANK)))[0].astype(np.float32)
    index = leakage.Index([(k, p, None) for k, p in enumerate(passages)], column, np.array([weights[w] for w in column], np.float32), loadings)
    for length, changed in ((15, 2), (18, 3), (24, 4), (30, 5)):
        for k, p in enumerate(passages):
            s = random.randrange(40 - length + 1)
            gone = random.sample(range(1, length - 1), changed)
            run = [random.choice(["is", "my", *vocabulary]) if j in gone else w for j, w in enumerate(p[s : s + length])]
            text = ["my", "is"] * random.randrange(20) + run + ["is"] * random.randrange(9)
            assert leakage.contains(p, text)
            assert k in {i for i, _, _ in index.near_items(text)}


def test_leaks(spark):
    passage = " ".join(f"word{k} tale{k % 7}" for k in range(20))
    p = passage.split()
    changed = [("zz" if k % 7 == 3 else w) for k, w in enumerate(p)]
    docs = [(1, "before " + passage + " after"), (2, "> " + " ".join(changed)), (3, " ".join(p[:12])), (4, " ".join(sorted(p))), (5, None), (6, ""), (7, "<b>" + "</b> *".join(p[5:25])), (1, "before " + passage)]
    items = spark.createDataFrame([(100, "t", "p", passage, "word3"), (101, "t", "p", None, None), (102, "t", "p", "too short", "x")], "item_id bigint, task string, prompt string, passage string, answer string")
    got = leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items)
    assert rows_of(got.select("doc_id", "item_id")) == [(1, 100), (1, 100), (2, 100), (7, 100)]
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), items.limit(0)).count() == 0


def test_spam(spark):
    prose = "The clinic near the harbour takes walk-ins before noon. Keep your ticket, since the driver asks for it at the gate. "
    docs = [(k, prose * (1 + k % 3) + f"It costs {k} marks in the end.", "h") for k in range(30)]
    docs += [(100 + k, "cheap hotel best hotel deals vip luxury cheap hotel spa " * (3 + k % 3), "s") for k in range(12)]
    docs += [(200, "Departures from A\n12:30  Fenby  platform 6\n13:14  Osra  platform 7\n17:35  Morrin  platform 4", "h"), (201, "Prices at Inn\ntaxi for two: 962 crowns\ntwin room for three: 387 crowns", None), (202, "http://a.example/x\nwww.b.example\n//c.example/p/1\n", "s"), (203, "Tags: vip, save, spa, near me, book, top", "s"), (204, prose + "#a #b", "h"), (205, None, "h"), (206, " ", None)]
    found = {r["doc_id"] for r in spam.found(spark.createDataFrame(docs, "doc_id bigint, text string, source string")).collect()}
    assert found == {100 + k for k in range(12)} | {202, 203}
    assert spam.found(spark.createDataFrame([], "doc_id bigint, text string, source string")).count() == 0


def test_trees_judge_without_the_share_that_makes_labels(spark):
    """Pages whose lines look like keywords are left alone where the trees see sentences without marks."""
    assert "sentences" not in spam.FEATURES
    prose = "The clinic near the harbour takes walk-ins before noon and the driver asks for your ticket at the gate. "
    docs = [(k, prose * (1 + k % 4), "h") for k in range(60)] + [(100 + k, "cheap hotel best hotel deals vip luxury cheap hotel spa " * (3 + k % 3), "s") for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    by = {r["doc_id"]: r for r in spam.scored(df).collect()}
    assert all(by[k]["own"] < 0.5 for k in range(60)) and all(by[100 + k]["own"] > 0.5 for k in range(40))
    assert by[100]["score"] != by[100]["own"] or by[100]["own"] == 1.0


def test_very_long_texts(spark, dialogues):
    passage = " ".join(f"word{k} tale{k % 7}" for k in range(20))
    filler = " ".join(f"f{k % 997}" for k in range(30_000))
    items = spark.createDataFrame([(1, passage)], "item_id bigint, passage string").withColumn("answer", F.lit(None).cast("string"))
    docs = spark.createDataFrame([(1, filler + " " + passage + " " + filler), (2, filler)], "doc_id bigint, text string")
    assert [r["doc_id"] for r in leakage.leaks(docs, items).collect()] == [1]
    odd = ["a" + "." * 5000 + "b and so on to", "a" + " " * 50_000 + "b and then to", "x " * 50_000 + "is the", ") " * 20_000 + "of the"]
    d = dialogues(record(1, odd, pairs=[(filler, filler + " right"), (filler, "x " * 20_000 + "done.")]))
    assert truncation.cut_values(d).count() == 4
    assert [r["defect"] for r in pairs.defects(d).orderBy("pos").collect()] == ["copy"]
    assert repetition.shares(d).count() == 1


CLASH = ["id", "name", "stamp", "content", "words", "source", "text", "pos", "end", "length", "lang", "share", "n", "p", "v", "host", "own", "score", "child", "cutoff"]


def test_clashing_columns_nulls_and_repeated_rows(spark, dialogues):
    """Extra columns named like inner ones change nothing; rows of nulls are no cases; repeated rows give rows of their own."""
    rows = [record(1, ["I hold a room for yo", "please come and see our fine new rooms by the river today.", "please come and see our fine new rooms by the river today.", "please come and see our fine new rooms by the river today."], pairs=[("Is it free?", None)]), record(2, None, domain=None, model=None, goal=None)]
    plain = dialogues(*rows, rows[0])
    clash = plain
    for c in CLASH:
        clash = clash.withColumn(c, F.lit("x"))
    empty = clash.limit(0)
    runs = [lambda d: truncation.cut_values(d).select("rec_id", "field", "pos"), pairs.defects, lambda d: repetition.shares(d).select("rec_id", "share"), truncation.rates]
    for run in runs:
        assert rows_of(run(clash)) == rows_of(run(plain)) and run(empty).count() == 0
    assert rows_of(truncation.cut_values(clash).select("rec_id", "pos")) == [(1, 0), (1, 0)]
    batch = one_turn(spark, [["please", "come"] * 20, ["please", "come"] * 20]).withColumn("id", F.lit("x")).withColumn("words", F.lit(1)).withColumn("stamp", F.lit(None))
    assert rows_of(incremental.repeats(clash, batch)) == [(1, "n0")] and incremental.repeats(empty, batch.limit(0)).count() == 0
    docs = spark.createDataFrame([(1, "cheap hotel best hotel deals vip luxury cheap hotel spa " * 4, "s"), (1, "cheap hotel best hotel deals vip luxury cheap hotel spa " * 4, "s"), (2, None, None)], "doc_id bigint, text string, source string")
    odd = docs.withColumn("host", F.lit(1)).withColumn("own", F.lit(2)).withColumn("score", F.lit(3)).withColumn("ids", F.lit(4)).withColumn("item_id", F.lit(5)).withColumn("passage", F.lit("x"))
    assert rows_of(spam.found(odd)) == [(1,), (1,)]
    assert sorted(len(r["ids"]) for r in tokens.encode(odd).collect())[0] == 0
    items = spark.createDataFrame([(7, " ".join(f"w{k}" for k in range(30)), None), (7, " ".join(f"w{k}" for k in range(30)), None), (8, None, "a"), (None, "short", None)], "item_id bigint, passage string, answer string").withColumn("doc_id", F.lit(1)).withColumn("text", F.lit("y"))
    found = leakage.leaks(odd.unionByName(odd.limit(1).withColumn("text", F.lit(" ".join(f"w{k}" for k in range(5, 25))))), items)
    assert [(r["doc_id"], r["item_id"], r["answered"]) for r in found.collect()] == [(1, 7, None)]
    scores = spark.createDataFrame([("a", 0.5, 1), ("a", 0.5, 1), ("b", None, 1)], "source string, score double, n int").withColumn("above", F.lit(9)).withColumn("cell", F.lit(9))
    cuts = cutoff.cutoffs(scores, spark.createDataFrame([("a", 50, 1), (None, 3, 1), ("b", None, 1)], "source string, keep_percent int, low int"))
    assert [tuple(r) for r in cuts.collect()] == [("a", 50, 2, 0.5, 2)] and cutoff.kept(scores, cuts).count() == 2
