import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from fixtures import DOCS, ODD, clashing, docs

from seamline.llm import audio, queries


@pytest.mark.parametrize("text", [b"", b"a", b"x" * 192, b"x" * 193, bytes(range(256)) * 5])
def test_round_trip(text):
    want = text.ljust(max(1, -(-len(text) // 192)) * 192, b" ")
    assert audio.payload(text) == want
    media = audio.encode_wav(want)
    assert media[:4] == b"RIFF" and int.from_bytes(media[4:8], "little") == len(media) - 8
    assert audio.decode_wav(media) == (want, audio.RATE)
    assert audio.features(media)[0] == want


def test_other_chunks_and_bad_files():
    media = audio.encode_wav(b"abcd")
    extra = media[:12] + b"LIST\x03\x00\x00\x00abc\x00" + media[12:]
    assert audio.decode_wav(extra)[0] == b"abcd"
    for bad in (b"", b"RIFFxxxxWAVX", media[:-1], media[:36], media[:34] + b"\x10\x00" + media[36:]):
        with pytest.raises(ValueError):
            audio.decode_wav(bad)


@pytest.mark.parametrize(("rate", "target"), [(16000, 8000), (16000, 12000), (8000, 16000), (44100, 16000), (8000, 8000)])
def test_polyphase_against_plain_filter(rate, target):
    from math import gcd

    x = np.random.default_rng(0).normal(size=700).astype(np.float32)
    got = audio.resample(x, rate, target)
    g = gcd(rate, target)
    up, down = target // g, rate // g
    if up == down:
        assert np.array_equal(got, x)
        return
    f = audio._phases(up, down, audio.TAPS)
    padded = np.concatenate([np.full(audio.TAPS, x[0]), x, np.full(audio.TAPS, x[-1])])
    want = []
    for k in range(-(-len(x) * up // down)):
        first = k * down // up + audio.TAPS // 2 + 1
        want.append(padded[first : first + audio.TAPS] @ f[k * down % up])
    assert len(got) == len(want) and np.allclose(got, want, atol=1e-4)


def test_tone_lands_in_its_band():
    t = np.arange(16000) / 8000
    for hz in (300, 1000, 3000):
        mel = audio.log_mel(np.sin(2 * np.pi * hz * t).astype(np.float32))
        centre = 2595 * np.log10(1 + hz / 700) / (2595 * np.log10(1 + 4000 / 700)) * (audio.BANDS + 1) - 1
        assert abs(int(mel.mean(axis=0).argmax()) - centre) <= 1


def test_hysteresis_against_loop():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 80):
        mel = rng.normal(size=(n, audio.BANDS)).astype(np.float32) * 3
        e = mel.mean(axis=1)
        quiet, loud = np.quantile(e, [0.1, 0.9])
        state, want, begin = False, [], 0
        for i, v in enumerate(e):
            if not state and v >= quiet + audio.UPPER * (loud - quiet):
                state, begin = True, i
            elif state and v < quiet + audio.LOWER * (loud - quiet):
                state = False
                want.append((begin, i))
        if state:
            want.append((begin, n))
        assert audio.segments(mel) == (want if loud - quiet > 1e-6 else [])


def test_tensors():
    f = audio.features(audio.encode_wav(audio.payload(b"some text " * 4000)))[1]
    table = audio.read_tensors(f.tensors())
    kind = table.schema.field("tensor").type
    assert isinstance(kind, pa.FixedShapeTensorType) and kind.shape == [audio.TENSOR_FRAMES, audio.BANDS]
    x = table["tensor"].combine_chunks().to_numpy_ndarray().reshape(-1, audio.BANDS)
    assert np.array_equal(x[: len(f.mel)], f.mel) and len(x) - len(f.mel) < audio.TENSOR_FRAMES
    start, end = table["start"].to_pylist(), table["end"].to_pylist()
    assert start[0] == 0 and all(a < b for a, b in zip(start, end, strict=True)) and len(start) == -(-len(f.mel) // audio.TENSOR_FRAMES)


def test_odd_rows(spark):
    got = audio.audio_columns(clashing(docs(spark, ODD)))
    rows = got.collect()
    assert len(rows) == len(ODD)
    for r, (i, t, *_) in zip(rows, ODD, strict=True):
        raw = (t or "").encode()
        p = audio.payload(raw)
        assert (r["doc_id"], r["n_bytes"], r["payload_bytes"]) == (i, len(raw), len(p))
        assert r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:])
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert all(s["start"] < s["end"] for s in r["spans"]) and audio.read_tensors(bytes(r["tensors"])).num_rows >= 1
    assert len({r["feature"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert audio.audio_columns(spark.createDataFrame([], DOCS)).count() == 0


def test_query_equal_texts(spark, sf):
    rows = queries.op6_audio_columns(spark, sf).collect()
    for r in rows[:20]:
        assert len(r["tensors_sha256"]) == 64 and f"segments={r['n_spans']};" in r["feature"]
    assert len({r["payload_sha256"] for r in rows}) == len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in rows}) < len(rows)
