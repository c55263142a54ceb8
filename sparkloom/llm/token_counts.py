"""Token counts of texts of any length by overlap resynchronisation.

A text longer than a chunk is encoded as overlapping chunks. Two neighbours are
spliced at a boundary that is proven stable: both encodings hold the same token
at the same place inside their overlap, away from their artificial ends. Every
adjacent pair of tokens of the spliced sequence then occurs as such in an
encoding, and a sequence all of whose adjacent pairs BPE keeps apart is the
encoding of its text: merges inside two adjacent tokens happen in the same
order whatever surrounds them. Where an overlap holds no such token (a run of
one character, say) it is widened, at last to the whole rest of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of the first overlap tried.
CHUNK = 32_768
OVERLAP = 512
#: Words whose counts a worker remembers before it starts anew.
MEMO_WORDS = 1_000_000
#: What stands for a space in a piece.
MARK = "\u2581"


class PieceCounter:
    """Encodes with one vocabulary, and knows which boundaries it proves to be stable."""

    def __init__(self, path: str):
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.processor.get_piece_size()
        pieces = [self.processor.id_to_piece(i) for i in range(n)]
        byte = [int(t[3:5], 16) if self.processor.is_byte(i) else -1 for i, t in enumerate(pieces)]
        #: Characters a token stands for; of a character's bytes the first stands for it.
        self.width = np.array([len(t) if b < 0 else 0 if 0x80 <= b < 0xC0 else 1 for t, b in zip(pieces, byte, strict=True)], np.int64)
        #: No piece reaches from another character across a space: what follows a single space is encoded by itself.
        self.by_words = all(MARK not in t.lstrip(MARK) for t in pieces)
        self.words: dict[str, int] = {}

    def ids(self, text: str) -> list[int]:
        return self.processor.encode(text, num_threads=1)

    def count(self, text: str) -> int:
        """Tokens of a text that is encoded at once, by its words where single spaces part them."""
        if not self.by_words or not text or "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return len(self.ids(text))
        words, total = self.words, 0
        for word in text.split(" "):
            n = words.get(word)
            if n is None:
                n = len(self.ids(word))
                if len(word) <= 64:
                    if len(words) >= MEMO_WORDS:
                        words.clear()
                    words[word] = n
            total += n
        return total

    def begins(self, text: str, at: int) -> np.ndarray:
        """Where the tokens of ``text`` begin, as characters of the whole text; one entry a token.

        A text is encoded with a space before it, which has no place in it.
        """
        ids = np.array(self.ids(text), np.int64)
        width = self.width[ids]
        if width.sum() != len(text) + 1:  # the vocabulary normalises texts: only the library knows
            offsets = self.processor.encode(text, return_type="offset_mapping")["offsets"]
            return np.array([x for x, _ in offsets], np.int64) + at
        return np.maximum(np.cumsum(width) - width - 1, 0) + at


@lru_cache(maxsize=4)
def piece_counter(path: str) -> PieceCounter:
    """One for each worker process and vocabulary."""
    return PieceCounter(path)


def _common(a: np.ndarray, b: np.ndarray, low: int, high: int) -> tuple[int, int] | None:
    """Indices in a and b of a token that both hold whole, strictly between ``low`` and ``high``.

    Found from three boundaries that follow each other in either: the token
    before the splice and the one after it are then the same in both.
    """
    places, ia, ib = np.intersect1d(a, b, return_indices=True)
    for k in range(len(places) - 2):
        if low < places[k] and places[k + 2] < high and ia[k + 2] - ia[k] == 2 and ib[k + 2] - ib[k] == 2:
            if ia[k + 1] + 2 < len(a):
                return int(ia[k + 1]), int(ib[k + 1])
    return None


def count_tokens(counter: PieceCounter, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of ``text``, as many as when it is encoded at once."""
    if len(text) <= chunk:
        return counter.count(text)
    end = chunk
    now = counter.begins(text[:end], 0)
    first = 0  # of ``now``, the first token that is not counted yet
    total = 0
    while end < len(text):
        width = overlap
        while True:
            start = max(0, end - width)
            if start == 0 or (first and start <= now[first]):
                # no overlap is left: encode a longer beginning at once
                end = min(len(text), 2 * end)
                now, first, total = counter.begins(text[:end], 0), 0, 0
                break
            stop = min(len(text), start + max(chunk, 2 * width))
            following = counter.begins(text[start:stop], start)
            # the first token of a chunk may hold the space put before it, and its last ones may be cut short
            splice = _common(now[first:], following, start + 1, end - 1)
            if splice:
                total += splice[0]
                now, first, end = following, splice[1], stop
                break
            width *= 4
    return total + len(now) - first


def count_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit of every text.

    A null text counts as empty: no bytes, no tokens. Repeated rows give
    repeated rows, an empty table an empty one; other columns aren't read. One
    narrow scan, no shuffle. What encoding needs beyond the text itself follows
    the chunk, unless a text resists splicing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in batches:
            counts = [count_tokens(counter, value.as_py() or "", chunk, overlap) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(counts, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = narrow.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
