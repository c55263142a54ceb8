"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece of text there is exactly one token that its
encoding can end with, so an encoding is a chain of *last tokens*: the encoder
stores that token for each byte position and reads an encoding off backwards.
A candidate (a vocabulary entry that is a suffix of the prefix) is the right
one when it and the last token of what is left of it form a pair that BPE would
keep apart; such a pair depends on its two tokens alone and is remembered.
Appending only adds positions; an edit recomputes positions from the edit on
until they agree again with the old ones over the longest token's length.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words and pieces, and pairs of tokens, that a worker remembers.
MEMO_PIECES = 170_000
MEMO_PAIRS = 400_000

# Fixed value: the public splitting pattern of byte-level BPE. None of its matches holds a space
# after its first character, runs of white space aside.
SINGLE_SPACE_PATTERNS = {r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""}


# Code points that the regex module counts as letters or numbers and the tables of the
# tiktoken library (Unicode 16) don't yet.
LATER_LETTERS = "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"


def _as_library(pattern: str) -> str:
    """The pattern with letters and numbers as the tiktoken library has them."""
    for name, later in ((r"\p{L}", LATER_LETTERS), (r"\p{N}", LATER_NUMBERS)):
        ranges = "".join("-".join(f"\\U{int(c, 16):08X}" for c in r.split("-")) for r in later.split())
        pattern = pattern.replace(name, f"[{name}--[{ranges}]]")
    return "(?V1)" + pattern


class BpeVocabulary:
    """Ranks of a byte-level vocabulary and what follows from them."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.text = {i: t for t, i in ranks.items()}
        self.longest = max(map(len, ranks))
        if len(ranks) >= 1 << 20:
            raise ValueError("more tokens than a pair's key has room for")
        self._apart: dict[int, bool] = {}
        self._reach: dict[int, bool] = {}
        self._edges: dict[int, list[tuple[bytes, float]]] = {}
        self._parts: dict[int, tuple[int, int] | None] = {}
        #: Finds every token in a text, by end and then longest first. Bytes are its characters.
        self.finder = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self.finder.add_word(token.decode("latin-1"), (len(token), rank))
        self.finder.make_automaton()

    @classmethod
    def load(cls, path: str) -> BpeVocabulary:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())})

    def merged(self, piece: bytes, down_to: int = 1) -> list[int]:
        """BPE from its definition: join the adjacent pair of lowest rank, leftmost first, until none is known."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > down_to:
            best = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def parts(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; none for a byte, or if merges never arrive at it."""
        if token not in self._parts:
            text = self.text[token]
            two = self.merged(text, 2)
            self._parts[token] = (two[0], two[1]) if len(text) > 1 and len(two) == 2 else None
        return self._parts[token]

    def reached(self, token: int) -> bool:
        """Whether merges ever arrive at the token; if not, it only stands for a whole piece."""
        return len(self.text[token]) == 1 or self.parts(token) is not None

    def _edge(self, token: int, side: int) -> list[tuple[bytes, float]]:
        """What stands at the token's right (side 1) or left (0) edge as merges go on, and the rank that ends it."""
        found = self._edges.get(token << 1 | side)
        if found is None:
            found, until, now = [], float("inf"), token
            while now is not None:
                found.append((self.text[now], until))
                parts = self.parts(now)
                until, now = now, None if parts is None else parts[side]
            self._edges[token << 1 | side] = found
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves the two tokens as they are when they meet.

        A merge across the seam happens if its rank comes before the one that
        takes in what stands on the left of the seam, and not after the one on
        the right (of equal ranks the leftmost goes first).
        """
        found = self._apart.get(left << 20 | right)
        if found is None:
            if len(self._apart) >= MEMO_PAIRS:
                self._apart.clear()
            found = self._apart[left << 20 | right] = not self._crossed(left, right)
        return found

    def _crossed(self, left: int, right: int) -> bool:
        get, seen = self.ranks.get, self._edge(right, 0)
        for a, ends_a in self._edge(left, 1):
            for b, ends_b in seen:
                rank = get(a + b)
                if rank is not None and rank < ends_a and rank <= ends_b:
                    return True
        return False


class PrefixEncoder:
    """An encoding that can grow at its end and be edited anywhere.

    ``last[i]`` is the unique token that the encoding of the first i+1 bytes
    ends with.
    """

    def __init__(self, vocabulary: BpeVocabulary, piece: bytes = b""):
        self.v = vocabulary
        self.piece = bytearray()
        self.last: list[int] = []
        self.append(piece)

    def _token_at(self, end: int) -> int:
        v, piece, last = self.v, self.piece, self.last
        for n in range(min(end, v.longest), 0, -1):
            token = v.ranks.get(bytes(piece[end - n : end]))
            if token is None or not v.reached(token):
                continue
            if n == end or v.apart(last[end - n - 1], token):
                return token
        raise ValueError(f"no token for byte {piece[end - 1]}")

    def append(self, more: bytes) -> None:
        self.piece += more
        for end in range(len(self.last) + 1, len(self.piece) + 1):
            self.last.append(self._token_at(end))

    def replace(self, start: int, stop: int, new: bytes) -> int:
        """Put ``new`` in place of bytes start to stop; the number of positions worked out anew."""
        old, shift = self.last, len(new) - (stop - start)
        self.piece[start:stop] = new
        self.last = old[:start]
        same, done = 0, 0
        while len(self.last) < len(self.piece):
            end = len(self.last) + 1
            token, done = self._token_at(end), done + 1
            self.last.append(token)
            before = end - 1 - shift
            same = same + 1 if before >= stop and token == old[before] else 0
            if same >= self.v.longest:
                self.last += old[before + 1 :]
                break
        return done

    def tokens(self) -> list[int]:
        out, end = [], len(self.piece)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.v.text[out[-1]])
        return out[::-1]


def last_tokens(v: BpeVocabulary, piece: bytes) -> list[int]:
    """PrefixEncoder(v, piece).last, with all candidates found in one go."""
    known, reach, out = v._apart, v._reach, [-1] * len(piece)
    for at, (n, token) in v.finder.iter(piece.decode("latin-1")):
        if out[at] >= 0:
            continue
        good = reach.get(token)
        if good is None:
            good = reach[token] = v.reached(token)
        if good and n <= at:
            left = out[at - n]
            pair = left << 20 | token
            good = known.get(pair)
            if good is None:
                good = v.apart(left, token)
        if good:
            out[at] = token
    if -1 in out:
        raise ValueError(f"no token for byte {piece[out.index(-1)]}")
    return out


class _Memo(dict):
    """What ``work`` gives for a text. Texts not asked for while MEMO_PIECES others were new are forgotten."""

    def __init__(self, work):
        super().__init__()
        self.work, self.before = work, {}

    def __missing__(self, text: str):
        out = self.before.get(text, self)  # itself: not known, as None is an outcome too
        if out is self:
            out = self.work(text)
            if len(text) > 64:
                return out
        if len(self) >= MEMO_PIECES:
            self.before = dict(self)
            self.clear()
        self[text] = out
        return out


class TextEncoder:
    """Splits text by a pattern and encodes each match on its own.

    Where words are set apart by single spaces, the text is cut at them first
    and whole words are looked up; see ``_word``.
    """

    def __init__(self, vocabulary: BpeVocabulary, pattern: str, words_at_spaces: bool = False):
        self.v = vocabulary
        self.pattern = regex.compile(_as_library(pattern))
        self.by_words = words_at_spaces
        self.pieces = _Memo(self._piece)
        self.words = _Memo(self._word)

    def _piece(self, piece: str) -> bytes:
        """The ids of one match, as packed little-endian 32-bit integers."""
        raw = piece.encode()
        whole = self.v.ranks.get(raw)
        if whole is not None:
            return whole.to_bytes(4, "little")
        last, ids, end = last_tokens(self.v, raw), [], len(raw)
        while end:
            ids.append(last[end - 1])
            end -= len(self.v.text[ids[-1]])
        return struct.pack(f"<{len(ids)}I", *reversed(ids))

    def _word(self, word: str) -> bytes | None:
        """The ids of a space and ``word``; None if that space may belong to a longer run of white space.

        A match that is itself a space and a word is remembered as that word.
        """
        if not word or word[0].isspace() or word[-1].isspace():
            return None
        found = self.pattern.findall(" " + word)
        if len(found) == 1:
            return self._piece(found[0])
        return b"".join([self.words[p[1:]] if p[0] == " " and len(p) > 1 and not p[1].isspace() else self.pieces[p] for p in found])

    def _matches(self, text: str) -> bytes:
        pieces = self.pieces
        return b"".join([pieces[p] for p in self.pattern.findall(text)])

    def packed(self, text: str) -> bytes:
        if self.by_words:
            first, *rest = text.split(" ")
            if rest and not first[-1:].isspace():
                words = self.words
                try:
                    return self._matches(first) + b"".join([words[w] for w in rest])
                except TypeError:  # a None: spaces beside other white space
                    pass
        return self._matches(text)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.packed(text), "<u4").tolist()

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.v.text.__getitem__, ids))


@lru_cache(maxsize=4)
def text_encoder(path: str, pattern: str) -> TextEncoder:
    """One encoder per worker process and vocabulary."""
    return TextEncoder(BpeVocabulary.load(path), pattern, pattern in SINGLE_SPACE_PATTERNS)


def encode_documents(docs: DataFrame, path: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each text and decode the ids again.

    Returns id_col, n_tokens long, ids_sha256, decoded_sha256 (of the bytes
    decoded from the ids) and, on request, ids array<int>.  A null text counts
    as empty: no tokens, the digests of nothing.  Other columns, whatever their
    names, are not read; repeated rows give repeated rows, an empty table an
    empty one.  One narrow scan, no shuffle; a worker's memory holds one Arrow
    batch and a bounded memo of pieces.
    """
    fields = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_encoder(path, pattern)
        for batch in batches:
            counts, digests, decoded, all_ids = [], [], [], []
            for text in batch.column(1):
                packed = encoder.packed(text.as_py() or "")
                ids = np.frombuffer(packed, "<u4").tolist()
                counts.append(len(ids))
                digests.append(hashlib.sha256(packed).hexdigest())
                decoded.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
                if with_ids:
                    all_ids.append(ids)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                columns, names = [*columns, pa.array(all_ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = fields.replace("id long", f"id {kind.simpleString()}", 1)
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
