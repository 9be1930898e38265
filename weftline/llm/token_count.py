"""Token counts by heap-and-linked-list byte-pair merging.

The text is normalised as the piece model asks (a dummy space in front, spaces shown as U+2581)
and merged: a heap holds the adjacent pairs whose join is a piece, the pair of lowest rank
(leftmost among equals) is popped, the linked list closes over it, and its new neighbours are
pushed.  The count is the number of first symbols minus the merges; a symbol that is no piece
falls back to its UTF-8 bytes.  No identifier is made.

Merging splits into independent chunks: no piece joins a character to a following space, so a
chunk is a run of spaces with the characters after it, and no piece of several characters holds a
line feed.  Both facts are checked against the vocabulary.  Chunk counts are kept in a bounded
cache in each Python worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.common import Memo, append_columns, text_bytes

SPACE = "▁"
#: Bytes of one generation of the chunk cache of a Python worker.
CACHE_BYTES = 64 << 20


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceCounter:
    """Counts the tokens of texts under the sentencepiece BPE model at ``path``."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.vocab_size()
        pieces = {
            model.id_to_piece(i): -model.get_score(i)
            for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        #: Rank of every piece; pieces of equal score share a rank and merge leftmost first.
        self.rank = pieces
        longer = [p for p in pieces if len(p) > 1]
        self.lines_apart = not any("\n" in p for p in longer) and "\n" not in pieces
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in longer)
        self.bare = Memo(lambda w: self.merge(w.decode()), cache_bytes // 8)
        self.spaced = Memo(lambda w: self.merge(SPACE + w.decode()), cache_bytes)
        self.runs = re.compile(SPACE + "+[^" + SPACE + "]*|[^" + SPACE + "]+")

    def merge(self, text: str) -> int:
        """Tokens of one chunk."""
        n = len(text)
        rank = self.rank
        get = rank.get
        pairs = []
        for i in range(n - 1):
            r = get(text[i : i + 2])
            if r is not None:
                pairs.append((r, i, i + 2))
        merges = 0
        if pairs:
            heapq.heapify(pairs)
            pop, push = heapq.heappop, heapq.heappush
            # A symbol spans text[i:end[i]]; before[i] is the start of the symbol to its left.
            end = list(range(1, n + 1))
            before = list(range(-1, n))
            while pairs:
                _, i, stop = pop(pairs)
                middle = end[i]
                # Stale unless i still starts a symbol and its right neighbour ends at stop.
                if middle <= i or middle >= stop or end[middle] != stop:
                    continue
                end[i] = stop
                end[middle] = 0
                merges += 1
                if stop < n:
                    before[stop] = i
                    right = end[stop]
                    r = get(text[i:right])
                    if r is not None:
                        push(pairs, (r, i, right))
                left = before[i]
                if left >= 0:
                    r = get(text[left:stop])
                    if r is not None:
                        push(pairs, (r, left, stop))
        # Only single characters can be outside the vocabulary; each falls back to its bytes.
        outside = {c for c in set(text) if c not in rank}
        extra = sum(len(c.encode()) - 1 for c in text if c in outside) if outside else 0
        return n - merges + extra

    def count(self, text: bytes) -> int:
        """Tokens of a whole text given in UTF-8."""
        if not text:
            return 0
        if not (self.words_apart and self.lines_apart):
            return self.merge(SPACE + text.decode().replace(" ", SPACE))
        text = text.replace(SPACE.encode(), b" ")
        total = 0
        if b"  " in text or b" \n" in text or text[:1] in b" \n" or text[-1:] == b" ":
            for k, line in enumerate(text.decode().replace(" ", SPACE).split("\n")):
                for chunk in self.runs.findall(SPACE * (k == 0) + line):
                    total += (
                        self.spaced[chunk[1:].encode()]
                        if chunk[0] == SPACE and chunk[1:2] not in ("", SPACE)
                        else self.merge(chunk)
                    )
                total += k > 0
            return total
        spaced = self.spaced.__getitem__
        bare = self.bare.__getitem__
        for k, line in enumerate(text.split(b"\n")):
            words = line.split(b" ")
            if k:
                total += 1
                if words[0]:
                    total += bare(words[0])
                del words[0]
            total += sum(map(spaced, words))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> PieceCounter:
    """The counter of this Python worker, with its cache."""
    return PieceCounter(path)


def count_tokens(
    df: DataFrame,
    text: str = "text",
    model_path: str | None = None,
    limit: int = 4096,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """``df`` (or its columns ``keep``) with n_bytes, n_tokens and over_limit for every row.

    A null text counts as empty (0 bytes, 0 tokens).  Texts are taken whole, however long; the
    rows stay where they are (no shuffle), repeated rows are counted each, an empty table gives
    an empty table, and input columns named like the results are replaced.
    """
    path = model_path or piece_model_path()

    def start():
        count = counter(path).count
        return lambda texts: (
            [len(t) for t in texts],
            counts := [count(t) for t in texts],
            [c > limit for c in counts],
        )

    return append_columns(
        df,
        [text_bytes(text)],
        [("n_bytes", T.LongType()), ("n_tokens", T.LongType()), ("over_limit", T.BooleanType())],
        start,
        keep,
    )


def query(documents: DataFrame) -> DataFrame:
    return count_tokens(documents, keep=["doc_id"])
