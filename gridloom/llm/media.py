"""Media columns: texts kept as WAV sound, and spectral-peak fingerprints of it.

A text's bytes are padded with 255 to a positive multiple of 576 and stored as
the 8-bit mono samples of a WAV file in a binary column. The sound is read back
with the wave module; short-time Fourier transforms (Hann window of 144 samples,
hop 72) give a magnitude picture. In each of three frequency bands a frame's
strongest bin is a peak where it is no weaker than the band's strongest bins of
the frames on both sides and stands above the frame's mean. Each peak is paired
with the peaks of the next ``FAN`` frames in the same or the next band; a pair
is the code (bin, bin, frames between) at the first peak's frame. The pairs of
a sound are time-coded arrays, frames and codes, stored with the table. Two
sounds are alike by the codes that both have at one and the same shift in time.

Frames are taken in blocks, so memory does not follow a text's length.

Defined results: a null text counts as empty and becomes one block of 255s,
whose flat spectrum has no peaks and so no pairs; equal texts and repeated rows
have equal sounds and pairs; of a band's equally strong bins the lowest is the
peak, and a peak no weaker than its neighbours in time counts, so equal ones
all do; a text of any length becomes one sound; an empty table gives no rows.
Other columns stay, one named as a result under a name with a leading
underscore.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import aside, load, small_batches, stored

UNIT = 576
RATE = 8000
FRAME = 144
HOP = 72
BANDS = ((2, 12), (12, 32), (32, 73))
FAN = 3
BLOCK = 4096
FACTOR = 1.5


def payload(raw: bytes, unit: int = UNIT) -> bytes:
    """``raw`` with bytes 255 up to a positive multiple of ``unit``."""
    return raw + b"\xff" * (max(unit, -(-len(raw) // unit) * unit) - len(raw))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(sound: bytes) -> bytes:
    with wave.open(io.BytesIO(sound), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """Bins of the peaks by frame and band, -1 where a band has none."""
    x = np.frombuffer(samples, np.uint8)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    window = np.hanning(FRAME).astype(np.float32)
    best = np.empty((len(frames), len(BANDS)), np.int64)
    strong = np.empty((len(frames), len(BANDS)), np.float32)
    floor = np.empty((len(frames), 1), np.float32)
    for at in range(0, len(frames), BLOCK):
        part = frames[at : at + BLOCK].astype(np.float32) - 128
        part -= part.mean(1, keepdims=True)
        size = np.abs(np.fft.rfft(part * window, axis=1)).astype(np.float32)
        floor[at : at + BLOCK, 0] = np.maximum(size.mean(1) * FACTOR, 1e-2)
        for b, (lo, hi) in enumerate(BANDS):
            best[at : at + BLOCK, b] = size[:, lo:hi].argmax(1) + lo
            strong[at : at + BLOCK, b] = size[:, lo:hi].max(1)
    edge = np.zeros((1, len(BANDS)), np.float32)
    top = (strong >= np.concatenate([edge, strong[:-1]])) & (strong >= np.concatenate([strong[1:], edge]))
    return np.where(top & (strong > floor), best, -1)


def pairs(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded arrays: the frame of each pair's first peak, and the pair's code."""
    times, codes = [], []
    for gap in range(1, FAN + 1):
        a, b = found[:-gap], found[gap:]
        for band in range(len(BANDS)):
            for other in (band, band + 1):
                if other < len(BANDS):
                    (t,) = np.nonzero((a[:, band] >= 0) & (b[:, other] >= 0))
                    times.append(t)
                    codes.append((a[t, band] << 20) | (b[t, other] << 8) | gap)
    t, c = (np.concatenate(times), np.concatenate(codes)) if times else (np.zeros(0, np.int64),) * 2
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Most pairs that two sounds share at one shift in time, as a part of the shorter sound's pairs; 1.0 where both have none."""
    (ta, ca), (tb, cb) = ((np.asarray(t, np.int64), np.asarray(c, np.int64)) for t, c in (a, b))
    if not len(ca) or not len(cb):
        return float(len(ca) == len(cb))
    order = np.argsort(cb, kind="stable")
    cb, tb = cb[order], tb[order]
    lo, hi = np.searchsorted(cb, ca, "left"), np.searchsorted(cb, ca, "right")
    votes: dict[int, int] = {}
    for t, i, j in zip(ta.tolist(), lo.tolist(), hi.tolist(), strict=True):
        for shift in (tb[i:j] - t).tolist():
            votes[shift] = votes.get(shift, 0) + 1
    return max(votes.values(), default=0) / min(len(ca), len(cb))


def media_column(df: DataFrame, text: str = "text", replace: bool = False) -> DataFrame:
    """``df`` with ``n_bytes`` and ``media``, the sound of each text, stored in the shared folder; ``replace`` drops the text."""
    small_batches(df.sparkSession)
    df, now_named = aside(df, "n_bytes", "media")
    text = now_named(text)

    @F.pandas_udf("binary")
    def sound(raw: pd.Series) -> pd.Series:
        return pd.Series([to_wav(payload(bytes(x))) for x in raw])

    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    made = df.withColumns({"n_bytes": F.length(raw).cast("long"), "media": sound(raw)})
    return stored(made.drop(text) if replace else made, "media")


HEARD = {"payload_bytes": "bigint", "payload_sha256": "string", "tail_crc32": "bigint", "media_bytes": "bigint", "media_sha256": "string", "times": "array<int>", "codes": "array<int>"}


def features(table: DataFrame, media: str = "media") -> DataFrame:
    """Read the stored sounds back: checksums of payload and sound, and the time-coded arrays ``times``, ``codes``."""
    small_batches(table.sparkSession)
    table, now_named = aside(table, *HEARD, "heard")

    @F.pandas_udf(f"struct<{', '.join(f'{c}: {t}' for c, t in HEARD.items())}>")
    def hear(sounds: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in sounds:
            out = []
            for sound in batch:
                sound = bytes(sound)
                got = from_wav(sound)
                out.append((len(got), hashlib.sha256(got).hexdigest(), zlib.crc32(got[-32:]), len(sound), hashlib.sha256(sound).hexdigest(), *pairs(peaks(got))))
            yield pd.DataFrame({c: [r[i] for r in out] for i, c in enumerate(HEARD)})

    return table.withColumn("heard", hear(now_named(media))).select(*table.columns, "heard.*")


def feature_text(times: str = "times", codes: str = "codes") -> Column:
    """The time-coded arrays as text, ``frame.code`` for each pair in hexadecimal digits: the arrays can be read back from it."""
    return F.array_join(F.zip_with(times, codes, lambda t, c: F.concat(F.hex(t), F.lit("."), F.hex(c))), " ")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sound, read back; ``feature`` has the stored time-coded arrays."""
    sounds = media_column(load(spark, sf_dir, "documents").select("doc_id", "text"), replace=True)
    heard = stored(features(sounds).drop("media"), "spectra")
    return heard.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature_text().alias("feature"), F.size("codes").alias("n_pairs"))
