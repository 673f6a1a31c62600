"""Token ids and counts of whole texts by overlap resynchronisation.

A text of up to ``CHUNK`` characters is encoded in one go. A longer one is
encoded in chunks that overlap. Two neighbouring chunks are spliced at a place
in their overlap that is *proven stable*. Such a place is a blank behind a non-blank: the
vocabulary's pre-tokenizer lets a blank be the first character of a
piece, or stand in a run of blanks, but never behind a non-blank within one piece. It is also an edge between
a letter and a digit, or a mark behind either, for which a piece of letters or of digits
ends; the marks that special strings and contractions begin with do not count. So,
whatever was read before, a new piece starts there, and pieces are encoded
independently. Both encodings must have a token boundary at the place, and the same tokens from
it to the last stable place of the overlap. Where the overlap holds no such place it
is widened, in the end to both chunks, which then are one chunk of twice the length. So a text without any
stable place, such as one run of letters, is encoded a bounded number of times over, whatever its length,
but is held at once.

The ids are those of the library ``tokenizers`` for the same file: special
strings inside a text become their special id, nothing is added or cut. They are
made by ``tiktoken``, from the file's own vocabulary, several times as fast; the file's
merge order is checked to be its id order, on which the two agree.

Defined results: a null text is the empty text with no tokens. Rows are counted
one by one, so repeated rows repeat; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from tillroll.llm.common import paired

CHUNK = 32_768
OVERLAP = 256

# Where a piece starts whatever stands before: blanks behind a non-blank, edges of ASCII letters and
# digits, and marks behind letters or digits but for those of contractions and special strings.
STABLE = re.compile(
    r"(?<=\S)[ \t\n\r]|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])"
    r"|(?<=[0-9A-Za-z\u4e00-\u9fff])[!-&(-/:;=?@\[-`{}~\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f]"
)


def vocabulary_path() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Byte-level BPE of a ``tokenizers`` file, with each id's length in bytes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        vocabulary, merges = held["model"]["vocab"], held["model"]["merges"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes shown as themselves
        other = [b for b in range(256) if b not in plain]
        shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}
        special = {t["content"]: t["id"] for t in held["added_tokens"]}
        ranks = {
            bytes(shown[c] for c in token): number
            for token, number in vocabulary.items()
            if token not in special
        }
        made = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        if [vocabulary[m] for m in made] != list(range(256, 256 + len(made))):
            raise ValueError(f"{path}: merges are not in the order of their ids")
        self._encoding = tiktoken.Encoding(
            path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special
        )
        self._special = set(special)
        self.lengths = np.zeros(max([*ranks.values(), *special.values()]) + 1, dtype=np.int64)
        for token, number in (*ranks.items(), *((s.encode(), n) for s, n in special.items())):
            self.lengths[number] = len(token)

    def piece(self, text: str) -> np.ndarray:
        """Ids of a text that is encoded in one go."""
        ids = self._encoding.encode(text, allowed_special=self._special, disallowed_special=())
        return np.array(ids, dtype=np.uint32)

    def __call__(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Ids of a whole text of any length."""
        if len(text) <= chunk:
            return self.piece(text)
        done = []
        start, end = 0, chunk
        left = self.piece(text[:end])
        while end < len(text):
            spliced = self._next(text, start, end, left, chunk, overlap)
            if spliced is None:  # nothing stable in the whole chunk: one of twice the length
                end = min(start + 2 * (end - start), len(text))
                left = self.piece(text[start:end])
                continue
            keep, start, end, left = spliced
            done.append(keep)
        return np.concatenate([*done, left])

    def _next(
        self, text: str, start: int, end: int, left: np.ndarray, chunk: int, overlap: int
    ) -> tuple[np.ndarray, int, int, np.ndarray] | None:
        """The chunk behind ``start..end``, spliced: the ids of ``left`` up to the splice, the
        splice, the new end, and the ids from the splice to it."""
        ends = np.cumsum(self.lengths[left])
        width = overlap
        while True:
            low = max(start, end - width)
            stable = _stable(text, max(low, start + 1), end)
            if stable:
                first, last = stable[0], stable[-1]
                stop = min(low + chunk, len(text)) if low + chunk > end else min(end + chunk, len(text))
                right = self.piece(text[low:stop])
                own = np.cumsum(self.lengths[right])
                a = len(text[start:first].encode())
                b = len(text[low:first].encode())
                span = len(text[first:last].encode())
                i, i2 = _cut(ends, a), _cut(ends, a + span)
                j, j2 = _cut(own, b), _cut(own, b + span)
                if None not in (i, i2, j, j2) and np.array_equal(left[i:i2], right[j:j2]):
                    return left[:i], first, stop, right[j:]
            if low == start:
                return None
            width *= 2


def _stable(text: str, low: int, high: int) -> list[int]:
    """Places at which a piece starts, whatever was read before. The character
    behind the place must be known too, hence the last one is left out."""
    places = (found.start() for found in STABLE.finditer(text, max(low, 1), high))
    return [place for place in places if place < high - 1]


def _cut(ends: np.ndarray, place: int) -> int | None:
    """The number of tokens that end at or before ``place``, if one ends there."""
    at = int(np.searchsorted(ends, place, side="right"))
    return at if place == 0 or (at and ends[at - 1] == place) else None


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and file."""
    return Encoder(path)


def token_counts(
    docs: DataFrame, path: str | None = None, limit: int = 1024, chunk: int = CHUNK
) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per document; no shuffle."""
    path = path or vocabulary_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for ids, texts in paired(batches):
            tokens = [len(encode(t.decode(), chunk)) for t in texts]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids,
                    "n_bytes": pa.array(map(len, texts), pa.int64()),
                    "n_tokens": pa.array(tokens, pa.int64()),
                    "over_limit": pa.array([n > limit for n in tokens], pa.bool_()),
                }
            )

    return docs.select("doc_id", "text").mapInArrow(
        count, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean"
    )
