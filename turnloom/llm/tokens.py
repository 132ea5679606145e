"""Encoding texts with a public byte-level BPE tokenizer by forced boundaries."""

from __future__ import annotations

import ast
import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.sources.tables import parallel

#: Where the public vocabulary files lie on every machine; a parameter of all functions here.
VOCABULARIES = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
#: Distinct fragments one worker remembers before it starts anew; bounds memory, not results.
REMEMBERED = 300_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id of a ``.tiktoken`` vocabulary file."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def joined_pairs(ranks: dict[bytes, int]):
    """A table over all 65,536 byte pairs: true where some token holds the pair inside.

    Between two bytes whose pair is false no merge can ever reach across.
    """
    import numpy as np

    inside = np.zeros(65536, dtype=bool)
    for token in ranks:
        if len(token) > 1:
            b = np.frombuffer(token, dtype=np.uint8).astype(np.int32)
            inside[b[:-1] * 256 + b[1:]] = True
    return inside


class Encoder:
    """Encode texts fragment by fragment between forced boundaries.

    A cut lies between two bytes that never occur together inside a token. It
    is used only where the splitting pattern is unmoved by it as well: behind
    an ASCII character that is no white space, and in front of a byte that
    starts a character other than an apostrophe. The pattern looks ahead only
    inside runs of white space and treats only an apostrophe at a start
    differently, so both parts are split as the whole was; within one piece of the
    pattern no token spans the cut. The ids of the parts in turn are therefore
    the ids of the whole.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import numpy as np
        import tiktoken

        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        right = np.arange(65536) % 256
        left = np.arange(65536) // 256
        spaces = np.isin(left, list(b" \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f"))
        self._cut = ~joined_pairs(ranks) & (left < 128) & ~spaces & (right != 0x27) & ((right < 128) | (right >= 192))
        self._known: dict[bytes, list[int]] = {}

    def fragments(self, text: str) -> list[bytes]:
        """The parts of the text's UTF-8 bytes between forced boundaries."""
        import numpy as np

        raw = text.encode("utf-8", "surrogatepass")
        b = np.frombuffer(raw, dtype=np.uint8).astype(np.int32)
        if len(b) < 2:
            return [raw] if raw else []
        at = [0, *(np.flatnonzero(self._cut[b[:-1] * 256 + b[1:]]) + 1).tolist(), len(raw)]
        return [raw[i:j] for i, j in zip(at, at[1:])]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; null and empty texts give an empty list."""
        if not text:
            return []
        known, ids = self._known, []
        for part in self.fragments(text):
            got = known.get(part)
            if got is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                got = self._encoding.encode_ordinary(part.decode("utf-8", "surrogatepass"))
                if len(part) <= 64:
                    known[part] = got
            ids += got
        return ids


def _pattern(folder: str) -> str:
    """The splitting pattern stored beside the vocabulary files: the text assigned to PATTERN. Nothing is run."""
    with open(os.path.join(folder, "__init__.py")) as source:
        tree = ast.parse(source.read())
    for line in tree.body:
        if isinstance(line, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "PATTERN" for t in line.targets):
            return ast.literal_eval(line.value)
    raise ValueError(f"no splitting pattern in {folder}")


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> DataFrame:
    """``doc_id, ids``: the token ids of every text, without special tokens.

    Null and empty texts both give an empty list, white space is encoded as
    stored, rows are neither merged nor dropped, and other columns are ignored.
    Strings that look like special tokens are ordinary text. Whole texts are
    encoded; each row is independent, so there is no shuffle beyond an even
    spread of the input.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(load_ranks(os.path.join(folder, f"{vocabulary}.tiktoken")), _pattern(folder))
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "ids": [encoder.encode(t if isinstance(t, str) else None) for t in batch["text"]]})

    return parallel(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInPandas(run, "doc_id bigint, ids array<int>")
