"""Evaluation passages inside corpus documents, found by latent semantic retrieval.

The passages' windows span a latent space by a randomised SVD of their TF-IDF
matrix; windows of the documents are projected into it and compared by cosine
with the windows of the items whose words they hold, and what comes near is
verified word by word. Weights and the least cosine come from the items alone,
so the search is the same over a corpus of any size.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.sources.tables import keep, parallel, slots

#: Consecutive passage words a document must hold, and the part of them that must be unchanged.
RUN, UNCHANGED = 15, 5 / 6
#: Words from one window to the next in passages and in documents.
STEP = 3
#: Words that some window of a run has in common with the passage at least: the worst is a run of 24 words with four
#: changed ones in its middle, ten on either side.
HELD = 11
#: Dimensions of the latent space, and power iterations of the randomised SVD.
RANK, POWER = 128, 2
#: What is taken off the least cosine that an altered passage window reaches.
MARGIN = 0.05
#: Words of a document taken at once; all parts are searched.
PART = 1_000
#: Passages in one pass over the documents; more of them are taken in blocks.
BLOCK = 10_000

_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
_INVISIBLE = re.compile("[­​-‏⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Words of a text without markup, quote marks, line breaks and invisible characters, in lower case."""
    if not text:
        return []
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


def windows(n: int, size: int = RUN, step: int = STEP) -> list[int]:
    """Starts of the windows over n words; the last one ends with the last word."""
    if n <= size:
        return [0] if n else []
    return sorted({*range(0, n - size + 1, step), n - size})


def contains(passage: list[str], text: list[str]) -> bool:
    """True if the text holds RUN or more consecutive passage words, UNCHANGED of them in order.

    The first and the last of them must be unchanged, so a shorter scrap gains
    nothing from its surroundings. Words may be replaced in runs of any length;
    in the shortest runs they may also be left out or put in between, as long as
    the text keeps within two words of the passage's pace.
    """
    import numpy as np

    m, n = len(passage), len(text)
    if m < RUN or n < RUN - 2:
        return False
    ids = {w: k for k, w in enumerate(dict.fromkeys(passage))}
    p = np.array([ids[w] for w in passage])
    t = np.array([ids.get(w, -1) for w in text])
    match = p[:, None] == t[None, :]
    if _replaced(match):
        return True
    near = np.zeros((m + RUN, n + RUN), bool)
    for d in range(-2, 3):
        lo, hi = max(0, d), min(n, n + d)
        near[:m, lo - d : hi - d] |= match[:, lo:hi]
    total = np.zeros((m, n), np.int16)
    for k in range(RUN):
        total += near[k : k + m, k : k + n]
    need = {length: -(-length * 5 // 6) for length in range(RUN, RUN + 4)}
    for i, j in np.argwhere((total >= need[RUN]) & match):
        if i + RUN > m:
            continue
        for length, least in need.items():
            end = i + length - 1
            if end >= m:
                break
            for k in range(j + length - 3, min(n, j + length + 2)):
                if k > j and match[end, k] and 2 + _lcs(passage[i + 1 : end], text[j + 1 : k]) >= least:
                    return True
    return False


def _replaced(match) -> bool:
    """True if on some diagonal a run of RUN or more begins and ends with a match and UNCHANGED of it match."""
    import numpy as np

    m, n = match.shape
    flat = np.zeros((m, m + n), bool)  # row i moved right by m - i, so that diagonals become columns
    for i in range(m):
        flat[i, m - i : m - i + n] = match[i]
    flat = flat[:, flat.sum(axis=0) * 6 >= RUN * 5]
    if not flat.shape[1]:
        return False
    # a match is worth 1, a replaced word costs 5: a run is unchanged enough if its sum is not below 0
    sums = np.concatenate([np.zeros((1, flat.shape[1]), int), np.cumsum(np.where(flat, 1, -5), axis=0)])
    lowest = np.minimum.accumulate(np.where(flat, sums[:-1], 1 << 30), axis=0)
    return bool((flat[RUN - 1 :] & (sums[RUN:] >= lowest[: m - RUN + 1])).any())


def _lcs(a: list[str], b: list[str]) -> int:
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    v = full = (1 << len(a)) - 1
    for w in b:
        if m := at.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def word_weights(passages: list[list[str]]) -> dict[str, float]:
    """Damped inverse passage frequency of every word, from 1 (in all passages) to 2 (in one).

    The spread is bounded, so that a few changed rare words can't outweigh the
    rest of a window; a word of no passage weighs 2.
    """
    import math

    df = Counter(w for p in passages for w in set(p))
    top = math.log(len(passages) + 1.0) or 1.0
    return {w: 1.0 + math.log((len(passages) + 1.0) / (n + 1.0)) / top for w, n in df.items()}


def latent_space(items: DataFrame, column: dict[str, int], weight) -> "object":
    """Orthonormal word loadings (words x RANK) of the passages' TF-IDF windows, by randomised SVD.

    The windows stay distributed: each partition multiplies its rows with a
    thin matrix and sends back one of the same shape; the sums are
    orthonormalised in between. Seeded, so every run gives one result.
    """
    import numpy as np

    rank = max(1, min(RANK, len(column)))
    spread = items.select("passage").repartition(slots(items))
    shape = (len(column), rank)

    def product(q):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros(shape)
            for b in batches:
                for passage in b["passage"]:
                    ws = words(passage)
                    if len(ws) < RUN:
                        continue
                    for s in windows(len(ws)):
                        tf = Counter(column[w] for w in ws[s : s + RUN])
                        at = np.fromiter(tf, int)
                        x = np.fromiter(tf.values(), float) * weight[at]
                        norm = np.linalg.norm(x)
                        if norm:
                            x /= norm
                            out[at] += np.outer(x, x @ q[at])
            yield pd.DataFrame({"g": [out.astype(np.float32).tobytes()]})

        parts = spread.mapInPandas(run, "g binary").toLocalIterator()
        return sum((np.frombuffer(r["g"], np.float32).reshape(shape).astype(float) for r in parts), np.zeros(shape))

    q = np.linalg.qr(np.random.default_rng(7).standard_normal(shape))[0]
    for _ in range(POWER):
        q = np.linalg.qr(product(q))[0]
    _, turn = np.linalg.eigh(q.T @ product(q))
    return (q @ turn[:, ::-1]).astype(np.float32)


class Index:
    """The latent windows of some items' passages, and which words each passage holds."""

    def __init__(self, items: list[tuple[int, list[str], list[str] | None]], column: dict[str, int], weight, loadings):
        import numpy as np

        self.items, self.column = items, column
        top = np.float32(2.0)
        # the last row is for words of no passage
        self.place = np.vstack([weight[:, None] * loadings, np.zeros((1, loadings.shape[1]), np.float32)]).astype(np.float32)
        self.mass = np.append(weight, top).astype(np.float32)
        owner, word = [], []
        self.windows: list = []
        least = 1.0
        for k, (_, p, _) in enumerate(items):
            at = np.array([column[w] for w in p])
            held = sorted(set(at.tolist()))
            owner += [k] * len(held)
            word += held
            # every start, so that one of them is level with the document's window
            starts = np.arange(max(1, len(at) - RUN + 1))
            z = np.stack([self.place[at[s : s + RUN]].sum(axis=0) for s in starts])
            norm = np.linalg.norm(z, axis=1, keepdims=True)
            z = (z / np.where(norm > 0, norm, 1)).astype(np.float32)
            self.windows.append(z)
            if len(at) >= RUN:
                least = min(least, self._altered(at, starts, z))
        order = np.argsort(word, kind="stable")
        self.owner = np.array(owner, np.int64)[order]
        self.start = np.searchsorted(np.array(word)[order], np.arange(len(column) + 1))
        self.near = least - MARGIN

    def _altered(self, at, starts, z) -> float:
        """The least cosine that a window of the passage keeps with it after RUN - HELD of its words were changed.

        Tried are the changes that take most from the window's own direction.
        """
        import numpy as np

        w = at[starts[:, None] + np.arange(RUN)]
        gain = np.einsum("srd,sd->sr", self.place[w], z)
        gone = np.argsort(-gain, axis=1)[:, : RUN - HELD]
        left = self.place[w].sum(axis=1) - np.take_along_axis(self.place[w], gone[:, :, None], axis=1).sum(axis=1)
        squares = (self.mass[w] ** 2).sum(axis=1) - np.take_along_axis(self.mass[w] ** 2, gone, axis=1).sum(axis=1) + (RUN - HELD) * self.mass[-1] ** 2
        return float(((left * z).sum(axis=1) / np.sqrt(squares)).min())

    def near_items(self, ws: list[str]) -> Iterator[tuple[int, int, int]]:
        """(item, start, end): windows of these words that come near to a window of an item."""
        import numpy as np

        at = np.array([self.column.get(w, -1) for w in ws])
        starts = np.array(windows(len(ws)))
        ends = np.minimum(starts + RUN, len(ws))
        known = np.concatenate([[0], np.cumsum(at >= 0)])
        sure = known[ends] - known[starts] >= HELD
        if not sure.any():
            return
        starts, ends = starts[sure], ends[sure]
        # items that hold enough of the words at all, then windows that hold enough of an item's words
        seen, times = np.unique(at[at >= 0], return_counts=True)
        lists = [self.owner[self.start[c] : self.start[c + 1]] for c in seen.tolist()]
        total = np.bincount(np.concatenate(lists), np.repeat(times, [len(x) for x in lists]), len(self.items))
        likely = np.flatnonzero(total >= HELD)
        if not len(likely):
            return
        local = np.full(len(self.items), -1)
        local[likely] = np.arange(len(likely))
        holds = np.zeros((len(seen) + 1, len(likely)), bool)  # the last row is for unknown words
        for c, own in enumerate(lists):
            mine = local[own]
            holds[c, mine[mine >= 0]] = True
        row = np.where(at >= 0, np.searchsorted(seen, at), len(seen))
        sums = np.concatenate([np.zeros((1, len(likely)), np.int32), np.cumsum(holds[row], axis=0, dtype=np.int32)])
        pair = np.argwhere(sums[ends] - sums[starts] >= HELD)
        cache: dict[int, object] = {}
        for w, k in pair.tolist():
            z = cache.get(w)
            if z is None:
                part = at[starts[w] : ends[w]]
                z = cache[w] = self.place[part].sum(axis=0) / np.sqrt((self.mass[part] ** 2).sum())
            if float((self.windows[likely[k]] @ z).max()) >= self.near:
                yield int(likely[k]), int(starts[w]), int(ends[w])


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, answered``: every document with the items whose passage it holds.

    ``answered`` tells whether the item's answer stands in the document too;
    null answers give null. Null and empty texts or passages, and passages
    shorter than the run, give no rows. Whole documents are searched; repeated
    documents each give their rows, two items of one passage both. The items
    are the fixed query set: one pass over the documents serves BLOCK of them,
    more are taken in blocks. Texts are not shuffled.
    """
    base = keep(items.select(F.col("item_id").cast("long").alias("item_id"), "passage", "answer").where(F.col("passage").isNotNull()).dropDuplicates())
    blocks = -(-base.count() // BLOCK)
    out = None
    for k in range(blocks):
        found = _block(documents, base.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k))
        out = found if out is None else out.unionByName(found)
    return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, answered boolean") if out is None else out


def _block(documents: DataFrame, items: DataFrame) -> DataFrame:
    import numpy as np

    rows = [(r["item_id"], words(r["passage"]), words(r["answer"]) if r["answer"] else None) for r in items.toLocalIterator()]
    rows = sorted(r for r in rows if len(r[1]) >= RUN)
    if not rows:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, answered boolean")
    weights = word_weights([p for _, p, _ in rows])
    column = {w: k for k, w in enumerate(sorted(weights))}
    weight = np.array([weights[w] for w in column], np.float32)
    loadings = latent_space(items, column, weight)
    shared = documents.sparkSession.sparkContext.broadcast(Index(rows, column, weight, loadings))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared.value
        for b in batches:
            out = []
            for doc, text in zip(b["doc_id"], b["text"]):
                ws = words(text)
                if len(ws) < RUN - 2:
                    continue
                held: set[int] = set()
                # long texts part by part; the parts overlap by more than any run that is looked for
                for s in range(0, len(ws), PART):
                    part = ws[s : s + PART + 4 * RUN]
                    if len(part) >= RUN - 2:
                        for k, lo, hi in index.near_items(part):
                            if k not in held and contains(index.items[k][1], part[max(0, lo - len(index.items[k][1])) : hi + len(index.items[k][1])]):
                                held.add(k)
                if held:
                    joined = " " + " ".join(ws) + " "
                for k in sorted(held):
                    item, _, answer = index.items[k]
                    out.append((doc, item, None if not answer else " " + " ".join(answer) + " " in joined))
            yield pd.DataFrame(out, columns=["doc_id", "item_id", "answered"]).astype({"answered": "object"})

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return parallel(docs).mapInPandas(run, "doc_id bigint, item_id bigint, answered boolean")


def leaked_items(found: DataFrame) -> DataFrame:
    """``item_id, n_documents, n_answered``: how often each leaked item stands in the corpus."""
    return keep(found).groupBy("item_id").agg(F.count("*").alias("n_documents"), F.count(F.when(F.col("answered"), 1)).alias("n_answered"))
