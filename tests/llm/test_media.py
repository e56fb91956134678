import hashlib
import io
import wave
import zlib

import numpy as np

from gridloom.llm import media


def test_round_trip(spark, folder, docs, nothing):
    rows = media.op8(spark, folder).collect()
    assert len(rows) == len(docs)
    raw = {d[0]: (d[1] or "").encode() for d in docs}
    same = {}
    for r in rows:
        b = raw[r.doc_id]
        p = b + b"\xff" * ((-len(b)) % 576 or (576 if not b else 0))
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setparams((1, 1, media.RATE, 0, "NONE", ""))
            w.writeframes(p)
        sound = out.getvalue()
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(sound), hashlib.sha256(sound).hexdigest())
        assert same.setdefault(b, r.feature) == r.feature
        t, c = media.pairs(media.peaks(p))
        assert [tuple(int(x, 16) for x in pair.split(".")) for pair in r.feature.split()] == list(zip(t.tolist(), c.tolist(), strict=True))
    assert media.op8(spark, nothing).count() == 0
    odd = spark.createDataFrame([(None, "a"), (2, None)], "doc_id long, text string")
    odd = odd.selectExpr("*", "7 as Media", "8 as times", "9 as heard")
    table = media.features(media.media_column(odd))
    assert table.columns[:7] == ["doc_id", "text", "_Media", "_times", "_heard", "n_bytes", "media"] and {(r._Media, r._times, r._heard) for r in table.collect()} == {(7, 8, 9)}
    long = spark.createDataFrame([(1, "lorem ipsum " * 400_000), (1, "lorem ipsum " * 400_000)], "doc_id long, text string")
    assert len({(r.payload_bytes, r.media_sha256, len(r.times)) for r in media.features(media.media_column(long)).collect()}) == 1


def spectrum(x):
    """A frame's magnitudes by the definition of the transform."""
    n = len(x)
    x = (x - x.mean()) * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return np.array([abs(sum(v * np.exp(-2j * np.pi * k * i / n) for i, v in enumerate(x))) for k in range(n // 2 + 1)])


def test_peaks_by_definition():
    rng = np.random.default_rng(4)
    raw = rng.integers(60, 200, media.UNIT * 3).astype(np.uint8)
    frames = [raw[i : i + media.FRAME].astype(float) - 128 for i in range(0, len(raw) - media.FRAME + 1, media.HOP)]
    sizes = [spectrum(f) for f in frames]
    found = media.peaks(raw.tobytes())
    assert len(found) == len(frames)
    for b, (lo, hi) in enumerate(media.BANDS):
        strong = [s[lo:hi].max() for s in sizes]
        for i, s in enumerate(sizes):
            beside = [strong[j] for j in (i - 1, i + 1) if 0 <= j < len(sizes)]
            top = all(strong[i] >= x for x in beside) and strong[i] > s.mean() * media.FACTOR
            assert found[i, b] == (lo + s[lo:hi].argmax() if top else -1)


def test_likeness_of_sounds():
    rng = np.random.default_rng(5)
    text = bytes(rng.integers(97, 123, 6000).astype(np.uint8))
    of = lambda raw: media.pairs(media.peaks(media.payload(raw)))
    whole, part, other = of(text), of(text[media.HOP * 10 : media.HOP * 50]), of(bytes(rng.integers(97, 123, 6000).astype(np.uint8)))
    assert media.likeness(whole, whole) == 1.0 and media.likeness(whole, part) > 0.8 > 0.3 > media.likeness(whole, other)
    none = np.zeros(0, int)
    assert media.likeness((none, none), (none, none)) == 1.0 and media.likeness((none, none), whole) == 0.0


def test_peaks_of_a_tone():
    t = np.arange(media.UNIT * 10)
    tone = (128 + 100 * np.sin(2 * np.pi * t * 20 / media.FRAME)).astype(np.uint8).tobytes()
    found = media.peaks(tone)
    assert set(found[:, 1].tolist()) <= {-1, 20} and (found[:, 1] == 20).any()
    times, codes = media.pairs(found)
    assert len(times) and {c >> 20 for c in codes.tolist()} >= {20} and (np.diff(times) >= 0).all()
    assert len(media.pairs(media.peaks(b"\xff" * media.UNIT))[0]) == 0


def test_pairs_by_definition():
    rng = np.random.default_rng(0)
    found = np.where(rng.random((40, 3)) < 0.4, rng.integers(2, 70, (40, 3)), -1)
    want = sorted((t, (found[t, a] << 20) | (found[t + g, b] << 8) | g) for t in range(40) for g in range(1, media.FAN + 1) if t + g < 40 for a in range(3) for b in (a, a + 1) if b < 3 and found[t, a] >= 0 and found[t + g, b] >= 0)
    times, codes = media.pairs(found)
    assert list(zip(times.tolist(), codes.tolist(), strict=True)) == want
