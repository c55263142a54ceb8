"""Media columns: 8-bit WAV samples, short-time Fourier transforms and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import release

RATE = 8000
#: Payloads are padded with spaces to a multiple of this.
BLOCK = 192
FRAME = 256
HOP = 192
#: A peak is paired with so many following ones, at most so many frames on.
FAN = 3
SPAN = 31
#: Frames transformed at a time.
FRAMES_AT_ONCE = 4096
#: Rows that go back to Spark together.
ROWS_AT_ONCE = 500
_WINDOW = np.hanning(FRAME).astype(np.float32)


def payload_of(text: str | None) -> bytes:
    """The text's UTF-8 bytes, with spaces up to a positive multiple of BLOCK."""
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b" ")


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit WAV file."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if w.getsampwidth() != 1:
            raise ValueError(f"{w.getsampwidth() * 8}-bit samples")
        return w.readframes(w.getnframes())


def peaks(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks: in each frame the loudest bin of the lower and of the upper half.

    Only peaks above their neighbouring frames' level in the same bin count.
    Frames are taken at every HOP; the last ones are filled up with silence.
    """
    n = -(-len(samples) // HOP)
    signal = np.zeros((n - 1) * HOP + FRAME, np.float32)
    signal[: len(samples)] = samples.astype(np.float32) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    loud = np.empty((n, FRAME // 2), np.float32)
    for i in range(0, n, FRAMES_AT_ONCE):
        spectrum = np.fft.rfft(frames[i : i + FRAMES_AT_ONCE] * _WINDOW, axis=1)[:, 1:]
        loud[i : i + FRAMES_AT_ONCE] = np.abs(spectrum)
    at, bins = [], []
    rows = np.arange(n)
    for low, high in ((0, FRAME // 4), (FRAME // 4, FRAME // 2)):
        best = loud[:, low:high].argmax(1) + low
        value = loud[rows, best]
        before = np.where(rows > 0, loud[np.maximum(rows - 1, 0), best], -1)
        after = np.where(rows < n - 1, loud[np.minimum(rows + 1, n - 1), best], -1)
        kept = (value > 1e-3) & (value > before) & (value >= after)
        at.append(rows[kept])
        bins.append(best[kept] + 1)
    frame, place = np.concatenate(at), np.concatenate(bins)
    order = np.lexsort((place, frame))
    return frame[order], place[order]


def fingerprint(samples: np.ndarray) -> np.ndarray:
    """Time-coded hashes of pairs of peaks: time << 32 | first bin << 16 | second bin << 8 | distance in frames."""
    frame, place = peaks(samples)
    codes = []
    for k in range(1, FAN + 1):
        gap = frame[k:] - frame[:-k]
        near = gap <= SPAN
        first, second = place[:-k][near], place[k:][near]
        codes.append(frame[:-k][near].astype(np.int64) << 32 | first.astype(np.int64) << 16 | second.astype(np.int64) << 8 | gap[near])
    return np.sort(np.concatenate(codes)) if codes else np.zeros(0, np.int64)


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_hashes: bool = False, with_media: bool = False) -> DataFrame:
    """Store each text as WAV samples, read them back and fingerprint them.

    Returns id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature (number of hashes and a digest of them),
    and on request the fingerprint itself as hashes array<long>, and media binary. All but n_bytes come
    from the samples read back. A null or empty text is one block of spaces;
    equal texts give equal values; repeated rows give repeated rows and an
    empty table an empty one; other columns aren't read. One narrow scan; a
    document's memory follows its length.
    """
    names = ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [None, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    if with_hashes:
        names, kinds, schema = [*names, "hashes"], [*kinds, pa.list_(pa.int64())], schema + ", hashes array<bigint>"
    if with_media:
        names, kinds, schema = [*names, "media"], [*kinds, pa.binary()], schema + ", media binary"

    def row(text: str | None) -> tuple:
        media = to_wav(payload_of(text))
        back = from_wav(media)
        hashes = fingerprint(np.frombuffer(back, np.uint8))
        feature = f"{len(hashes)}:{hashlib.sha256(hashes.astype('<i8').tobytes()).hexdigest()[:32]}"
        out = (len((text or "").encode()), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature)
        return (*out, *[hashes] * with_hashes, *[media] * with_media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(i, ROWS_AT_ONCE)
                columns = zip(*(row(text.as_py()) for text in part.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)
        release()

    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, schema).withColumnRenamed("id", id_col)
