"""Checking new batches for repeats of everything accepted so far, without reprocessing it.

Accepted conversations live in a store of segments, one row each in a Parquet
folder: the words of some thousand conversations, sorted by length, and for each
a sketch of its words: the parities of their counts in some hundred classes. A
word that only one of two conversations has changes one parity, so two sketches
never differ in more places than the conversations in words. A batch is taken in
blocks in the order of its ids. A block goes to every segment once: sketches of a
like length are compared all with all, some nanoseconds a pair, and what may be
the same is verified on the words where they lie. Accepted rows of the block
become segments of their own before the next block comes. Nothing is shuffled or
listed by word or phrase, so a phrase that a third of all conversations hold
fills no task.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.sources.tables import bounded, keep, parallel, shared_folder

#: Share of the longer conversation's words that must follow in the same order (5/6 by definition).
SAME = 5 / 6
#: Sketches by length: rows of up to so many words are compared by so many 64-bit numbers. A bit for each word or more
#: tells unrelated conversations apart, fewer leave more to verify.
KINDS = ((56, 1), (112, 2), (170, 3), (230, 4), (450, 8), (900, 16), (1800, 32), (1 << 40, 64))
#: Conversations of a segment, and rows of a block and their words: what one task and the driver hold at once.
SEGMENT, BLOCK, BLOCK_WORDS = 4096, 1 << 15, 6_000_000
#: Rows of a block that are compared with one another at once, and pairs of sketches; they bound memory, not results.
PIECE, TILE = 2048, 1 << 16
#: Bits of a Bloom filter for each fingerprint, and hash functions.
BLOOM_BITS, BLOOM_HASHES = 12, 4
#: Stamp of conversations without a time of their own: behind all that have one.
LATER = 1 << 61

_WORD = re.compile(r"\w+")
_MIX = 0x9E3779B97F4A7C15


def conversation(turns: str = "turns"):
    """The texts of the turns in order, as one string."""
    return F.array_join(F.coalesce(F.transform(F.col(turns), lambda t: F.coalesce(t["text"], F.lit(""))), F.array().cast("array<string>")), " ")


def least(n):
    """Words in the same order that two conversations must share, the longer of which has n words."""
    return -(-5 * n // 6)


def lacking(n, m):
    """Words that conversations of n and m words may have alone, both together, and be the same; -1 if their lengths tell them apart."""
    import numpy as np

    both = least(np.maximum(n, m))
    return np.where(np.minimum(n, m) >= both, n + m - 2 * both, -1)


def sketches(words: list, width: int):
    """The sketches of conversations, ``width`` 64-bit numbers each: bit k is the parity of the words of class k."""
    import numpy as np

    bits, out = 64 * width, []
    for s in range(0, len(words), 1024):
        some = words[s : s + 1024]
        classes = (_mixed(np.concatenate(some).astype(np.uint64) * np.uint64(_MIX)) % np.uint64(bits)).astype(np.int64)
        at = np.repeat(np.arange(len(some), dtype=np.int64) * bits, [len(w) for w in some]) + classes
        odd = (np.bincount(at, minlength=len(some) * bits) & 1).astype(np.uint8)
        out.append(np.packbits(odd).view(np.uint64).reshape(len(some), width))
    return np.concatenate(out)


def span(sizes, kind: int) -> tuple[int, int]:
    """The part of sorted ``sizes`` that rows of the kind have to be compared with."""
    import numpy as np

    low, high = KINDS[kind - 1][0] + 1 if kind else 1, KINDS[kind][0]
    return int(np.searchsorted(sizes, least(low))), int(np.searchsorted(sizes, 6 * high // 5, side="right"))


def all_sketches(words: list, sizes) -> bytes:
    """The sketches of conversations sorted by length, kind after kind of those that they are compared with."""
    import numpy as np

    out = []
    for kind, (_, width) in enumerate(KINDS):
        lo, hi = span(sizes, kind)
        if lo < hi:
            out.append(sketches(words[lo:hi], width).tobytes())
    return b"".join(out)


def _mixed(g):
    """64-bit numbers with their bits stirred."""
    import numpy as np

    g = (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return g ^ (g >> np.uint64(32))


def worded(rows: DataFrame) -> DataFrame:
    """``id, name, stamp, content, words`` of each row of ``id, name, stamp, text`` that has words.

    ``words`` are 32-bit hashes of the words in order, ``content`` is the hash of
    the whole sequence: equal for conversations that agree but for case,
    punctuation and white space.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        import xxhash

        known: dict[str, int] = {}
        for b in batches:
            content, words = [], []
            for text in b["text"]:
                if len(known) > 500_000:
                    known.clear()
                ws = _WORD.findall(text.lower())
                for w in ws:
                    if w not in known:
                        known[w] = xxhash.xxh32_intdigest(w)
                words.append(np.array([known[w] for w in ws], np.uint32).tobytes())
                content.append(xxhash.xxh3_128_digest("\x00".join(ws)))
            out = pd.DataFrame({"id": b["id"], "name": b["name"], "stamp": b["stamp"], "content": content, "words": words})
            yield out[[len(w) > 0 for w in words]]

    return parallel(rows.select(F.col("id").cast("long").alias("id"), "name", "stamp", "text")).mapInPandas(run, "id bigint, name string, stamp bigint, content binary, words binary")


def _bloom_at(fps, k: int, size: int):
    """Position of each fingerprint in a filter of ``size`` bits under hash function k."""
    import numpy as np

    return (_mixed(fps.astype(np.uint64) + np.uint64((k + 1) * _MIX % (1 << 64))) & np.uint64(size - 1)).astype(np.int64)


def bloom_filter(fps) -> bytes:
    """A Bloom filter over fingerprints."""
    import numpy as np

    size = 1 << max(10, int(len(fps) * BLOOM_BITS - 1).bit_length())
    bits = np.zeros(size, bool)
    for k in range(BLOOM_HASHES):
        bits[_bloom_at(fps, k, size)] = True
    return np.packbits(bits).tobytes()


def maybe_held(raw: bytes, fps):
    """For each fingerprint whether the filter may hold it."""
    import numpy as np

    bits = np.frombuffer(raw, np.uint8)
    hit = np.ones(len(fps), bool)
    for k in range(BLOOM_HASHES):
        at = _bloom_at(fps, k, len(bits) * 8)
        hit &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
    return hit


def lcs(a, b) -> int:
    """Length of the longest common subsequence, bit-parallel over one side."""
    at: dict = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | (1 << i)
    v = full = (1 << len(a)) - 1
    for w in b:
        m = at.get(w)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def alike(a, b) -> float:
    """Share of the longer conversation's words that stand in the other in the same order; 0 below SAME."""
    import numpy as np

    longer = max(len(a), len(b), 1)
    if min(len(a), len(b)) < SAME * longer:
        return 0.0
    # words of either alone, at least: by counts in classes
    if np.abs(np.bincount(a & 4095, minlength=4096) - np.bincount(b & 4095, minlength=4096)).sum() > lacking(len(a), len(b)):
        return 0.0
    ratio = lcs(a.tolist(), b.tolist()) / longer
    return ratio if ratio >= SAME else 0.0


class Block:
    """Some rows of a batch, sorted by length, with their sketches."""

    def __init__(self, ids, words: list):
        import numpy as np

        size = np.array([len(w) for w in words], np.int64)
        order = np.argsort(size, kind="stable")
        self.ids, self.words, self.size = [ids[k] for k in order], [words[k] for k in order], size[order]
        self.start, self.sketch = [], []
        for kind, (high, width) in enumerate(KINDS):
            lo, hi = np.searchsorted(self.size, [KINDS[kind - 1][0] if kind else 0, high], side="right")
            self.start.append(int(lo))
            self.sketch.append(sketches(self.words[lo:hi], width) if lo < hi else None)

    def near(self, sizes, raw: bytes) -> Iterator[tuple[object, object, object]]:
        """(rows, held, differences): pairs of a row and a held conversation that may be the same.

        ``sizes`` are the lengths of the held conversations in order, ``raw`` their sketches by kind. A row's pairs come
        at once, but for more than TILE held ones.
        """
        import numpy as np

        at = 0
        differ, counts, sums = np.empty(TILE, np.uint64), np.empty(TILE, np.uint8), np.empty(TILE, np.uint16)
        for kind, (_, width) in enumerate(KINDS):
            lo, hi = span(sizes, kind)
            if lo >= hi:
                continue
            held = np.ascontiguousarray(np.frombuffer(raw, np.uint64, (hi - lo) * width, at).reshape(hi - lo, width).T)
            at += (hi - lo) * width * 8
            mine, first = self.sketch[kind], self.start[kind]
            if mine is None:
                continue
            size, theirs = self.size[first : first + len(mine)], sizes[lo:hi]
            start, stop = np.searchsorted(theirs, least(size)), np.searchsorted(theirs, 6 * size // 5, side="right")
            # sums of up to eight numbers' bits may run over, but only those above all bounds: that adds pairs, and loses none
            total = sums.view(np.uint8) if width <= 8 else sums
            r = 0
            while r < len(mine):
                a, b, s = int(start[r]), int(stop[r]), r + 1
                if a < b:
                    # rows of one length, which have the same bounds
                    s = min(len(mine), r + max(1, TILE // (b - a)))
                    s = r + int(np.searchsorted(size[r:s], size[r], side="right"))
                    for c in range(a, b, TILE):
                        d = min(b, c + TILE)
                        shape = s - r, d - c
                        x, y, z = (v[: shape[0] * shape[1]].reshape(shape) for v in (differ, counts, total))
                        for k in range(width):
                            np.bitwise_xor(mine[r:s, k : k + 1], held[k, c:d], out=x)
                            if k:
                                z += np.bitwise_count(x, out=y)
                            else:
                                np.copyto(z, np.bitwise_count(x, out=y))
                        most = lacking(size[r], theirs[c:d])
                        may = z <= np.minimum(most, np.iinfo(z.dtype).max).astype(z.dtype)
                        if may.any():
                            i, j = np.nonzero(may)
                            yield first + r + i, lo + c + j, z[i, j].astype(np.int64)
                r = s

    def verified(self, sizes, raw: bytes, held: list) -> Iterator[tuple[int, int, float]]:
        """(row, held, ratio): for each row that repeats one of the held conversations the first that does so, tried by rising difference."""
        import numpy as np

        for rows, others, apart in self.near(sizes, raw):
            done = -1
            for k in np.lexsort((others, apart, rows)):
                r, o = int(rows[k]), int(others[k])
                if r != done and (ratio := alike(self.words[r], held[o])):
                    yield r, o, ratio
                    done = r


def _stacked(arrays: list) -> tuple[bytes, list[int]]:
    import numpy as np

    return (np.concatenate(arrays) if arrays else np.array([], np.uint32)).tobytes(), [len(a) for a in arrays]


def _unstacked(raw: bytes, sizes) -> list:
    import numpy as np

    return np.split(np.frombuffer(raw, np.uint32), np.cumsum(sizes)[:-1]) if len(sizes) else []


_SEGMENT = "ids array<bigint>, stamps array<bigint>, sizes array<int>, words binary, sketches binary"


def segments(rows: DataFrame) -> DataFrame:
    """Store segments of rows of ``id, stamp, words``: at most SEGMENT conversations each, built where the rows lie."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for batch in batches:
            for s in range(0, len(batch), SEGMENT):
                b = batch.iloc[s : s + SEGMENT]
                b = b.iloc[np.argsort(b["words"].str.len(), kind="stable")]
                words = [np.frombuffer(w, np.uint32) for w in b["words"]]
                raw, sizes = _stacked(words)
                yield pd.DataFrame([{"ids": b["id"].tolist(), "stamps": b["stamp"].tolist(), "sizes": sizes, "words": raw, "sketches": all_sketches(words, np.array(sizes, np.int64))}])

    return rows.select("id", "stamp", "words").mapInPandas(run, _SEGMENT)


class FingerprintStore:
    """The accepted conversations below one folder: segments to search, and the names of their ids.

    A store outlives the session: open it by its path, and check the next batch
    with nothing but the batch at hand.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, rows: DataFrame) -> None:
        """Accept rows of ``id, name, stamp, words``; the caller knows that they repeat nothing held, or doesn't mind."""
        segments(rows).write.mode("append").option("compression", "zstd").parquet(f"{self.path}/segments")
        rows.select("id", "stamp", "name").write.mode("append").parquet(f"{self.path}/names")

    def names(self) -> DataFrame:
        """``id, stamp, name`` of all held conversations."""
        return self.spark.read.schema("id bigint, stamp bigint, name string").parquet(f"{self.path}/names")

    def matches(self, ids: list[int], words: list) -> DataFrame:
        """``id, other, other_stamp``: for each row that repeats a held conversation that conversation.

        In every segment a row's candidates are tried by rising difference of the
        sketches until one is verified; over all segments the most alike of
        these counts, then the earliest. All candidates are tried if none is.
        """
        blocks = self.spark.sparkContext.broadcast(Block(ids, words))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import numpy as np

            block = blocks.value
            for b in batches:
                out = []
                for seg in b.to_dict("records"):
                    held = _unstacked(seg["words"], seg["sizes"])
                    for r, k, ratio in block.verified(np.array(seg["sizes"], np.int64), seg["sketches"], held):
                        out.append((block.ids[r], seg["ids"][k], seg["stamps"][k], ratio))
                yield pd.DataFrame(out, columns=["id", "other", "stamp", "ratio"])

        stored = self.spark.read.schema(_SEGMENT).parquet(f"{self.path}/segments")
        found = parallel(stored).mapInPandas(run, "id bigint, other bigint, stamp bigint, ratio double")
        best = keep(found.groupBy("id").agg(F.max_by(F.struct("other", "stamp"), F.struct("ratio", -F.col("stamp"), -F.col("other"))).alias("o")))
        blocks.destroy()
        return best.select("id", F.col("o.other").alias("other"), F.col("o.stamp").alias("other_stamp"))

    def check(self, batch: DataFrame) -> DataFrame:
        """``id, orig``: rows of ``id, name, stamp, words`` that repeat an accepted conversation, and its name.

        The batch is taken in blocks of about BLOCK rows in the order of ids, so
        that each row sees all accepted rows before it; the others are accepted
        and added. Nothing but the batch and the store is read.
        """
        folder = shared_folder(self.spark)
        path = f"{folder}/batch-{uuid.uuid4().hex}"
        batch.repartitionByRange("id").sortWithinPartitions("id").write.parquet(path)
        rows = self.spark.read.schema("id bigint, name string, stamp bigint, content binary, words binary").parquet(path)
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("words")) / 4, F.lit(0))).first()
        parts = max(-(-n // BLOCK), -(-int(total) // BLOCK_WORDS))
        edges = sorted(set(rows.approxQuantile("id", [k / parts for k in range(1, parts)], 1 / (20 * parts)))) if parts > 1 else []
        out = None
        for lo, hi in zip([None, *edges], [*edges, None]):
            block = rows.where((F.col("id") > lo if lo is not None else F.lit(True)) & (F.col("id") <= hi if hi is not None else F.lit(True)))
            found = self._block(block)
            out = found if out is None else out.unionByName(found)
        if out is None:
            return self.spark.createDataFrame([], "id bigint, orig string")
        out = keep(out)
        wanted = bounded(keep(out.select("other", "other_stamp").distinct()))
        names = self.names().select(F.col("id").alias("other"), F.col("stamp").alias("other_stamp"), "name").join(wanted, ["other", "other_stamp"], "left_semi").dropDuplicates(["other", "other_stamp"])
        named = out.join(names, ["other", "other_stamp"])
        return keep(named.select("id", F.col("name").alias("orig")))

    def _block(self, block: DataFrame) -> DataFrame:
        """The repeats of one block, whose other rows are accepted and added."""
        import numpy as np

        rows = block.select("id", "words").orderBy("id").toPandas()  # about BLOCK rows
        ids, words = rows["id"].tolist(), [np.frombuffer(w, np.uint32) for w in rows["words"]]
        found = self.matches(ids, words)
        fresh = block.join(F.broadcast(found.select("id")), "id", "left_anti")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if held := list(batches):
                yield among(pd.concat(held))

        own = keep(fresh.select("id", "stamp", "words").repartition(1).mapInPandas(run, "id bigint, other bigint, other_stamp bigint"))
        self.add(fresh.join(F.broadcast(own.select("id")), "id", "left_anti").repartition(max(1, len(ids) // SEGMENT)))
        return found.unionByName(own)


def among(rows: pd.DataFrame) -> pd.DataFrame:
    """``id, other, other_stamp``: rows of a block that repeat an accepted smaller row of it, and that row.

    Taken in order of ids, piece by piece: the rows of a piece are compared with
    the rows accepted before it, then each with the accepted ones before it in
    the piece, those of the least different sketches first.
    """
    import numpy as np

    rows = rows.sort_values("id")
    stamps = dict(zip(rows["id"], rows["stamp"]))
    out: list[tuple[int, int]] = []
    accepted: list[tuple] = []  # (ids, lengths, sketches, words) of the accepted rows of a piece

    for s in range(0, len(rows), PIECE):
        piece = rows.iloc[s : s + PIECE]
        block = Block(piece["id"].tolist(), [np.frombuffer(w, np.uint32) for w in piece["words"]])
        best: dict[int, tuple[float, int]] = {}
        for ids, sizes, raw, held in accepted:
            for r, k, ratio in block.verified(sizes, raw, held):
                best[block.ids[r]] = max(best.get(block.ids[r], (0.0, 0)), (ratio, -ids[k]))
        out += [(i, -other) for i, (_, other) in best.items()]
        left = [k for k, i in enumerate(block.ids) if i not in best]
        block = Block([block.ids[k] for k in left], [block.words[k] for k in left])
        ids, gone = np.array(block.ids, np.int64), set()
        met = [(r, k, d) for r, k, d in block.near(block.size, all_sketches(block.words, block.size))]
        if met:
            r, k, d = (np.concatenate(x) for x in zip(*met))
            before = ids[k] < ids[r]
            r, k, d = r[before], k[before], d[before]
            for x in np.lexsort((ids[k], d, ids[r])):
                i, j = int(r[x]), int(k[x])
                if i not in gone and j not in gone and alike(block.words[i], block.words[j]):
                    out.append((block.ids[i], block.ids[j]))
                    gone.add(i)
        kept = [k for k in range(len(ids)) if k not in gone]
        if kept:
            words, sizes = [block.words[k] for k in kept], block.size[kept]
            accepted.append(([block.ids[k] for k in kept], sizes, all_sketches(words, sizes), words))
    return pd.DataFrame([(i, j, stamps[j]) for i, j in out], columns=["id", "other", "other_stamp"])


def repeats(history: DataFrame, incoming: DataFrame, path: str | None = None) -> DataFrame:
    """``incoming_id, orig_dialogue_id``: every incoming row that repeats an accepted conversation.

    ``history`` is accepted; an incoming row is accepted if it repeats neither
    history nor an accepted row of smaller ``incoming_id``. Conversations are
    compared by their words, however spread over turns. Any accepted original is
    a right one: the one of the least different sketch is tried first. Rows of
    equal words are one group each: only its first is compared and all others
    follow it. Rows without any word repeat nothing; null turns and texts count
    as empty; a reused ``dialogue_id`` alone is nothing. Empty tables give no
    rows. The store lies below ``path`` and stays there for the next batch; by
    default it is a new one in the shared folder.
    """
    spark = incoming.sparkSession
    store = FingerprintStore(spark, path or f"{shared_folder(spark)}/fingerprints-{uuid.uuid4().hex}")
    old = history.select(F.col("rec_id").alias("id"), F.col("dialogue_id").alias("name"), F.coalesce(F.unix_micros(F.col("ingested_at").cast("timestamp")), F.lit(LATER)).alias("stamp"), conversation().alias("text"))
    h = keep(worded(old))
    # of equal contents the earliest stands for its copies
    first = h.groupBy("content").agg(F.min(F.struct("stamp", "id")).alias("s"), F.count("*").alias("n"))
    copies = h.select("content", "stamp", "id").join(bounded(keep(first.where("n > 1").select("content", "s"))), "content").where(F.struct("stamp", "id") != F.col("s")).select("id")
    store.add(h.join(bounded(keep(copies)), "id", "left_anti"))
    return accept(store, incoming)


def accept(store: FingerprintStore, incoming: DataFrame) -> DataFrame:
    """The same against a store alone: ``incoming_id, orig_dialogue_id`` of the repeats; other rows are added to it."""
    new = incoming.select(F.col("incoming_id").alias("id"), F.col("dialogue_id").alias("name"), F.lit(LATER + 1).alias("stamp"), conversation().alias("text"))
    n = keep(worded(new))
    first = n.groupBy("content").agg(F.min(F.struct("id", "name")).alias("s"), F.count("*").alias("n"))
    groups = keep(first.where("n > 1").select("content", F.col("s.id").alias("head"), F.col("s.name").alias("own")))
    followers = n.select("content", "id").join(bounded(groups), "content").where(F.col("id") != F.col("head"))
    followers = keep(followers.select("id", "head", "own"))
    found = store.check(n.join(bounded(followers.select("id")), "id", "left_anti"))
    # a copy follows its head: it repeats what the head repeats, or the head itself
    after = followers.join(found.select(F.col("id").alias("head"), "orig"), "head", "left").select("id", F.coalesce("orig", "own").alias("orig"))
    return found.unionByName(after).select(F.col("id").alias("incoming_id"), F.col("orig").alias("orig_dialogue_id"))
