"""The wave file source: formats by hand-made bytes, files of a record, stretches and channels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.sources import waves


def packed(kind, x):
    """Bytes of samples, written from the formats' definitions."""
    x = [int(v) for v in x]
    if kind == 8:
        return np.diff(x, prepend=0).astype(np.int8).tobytes()
    if kind in (16, 61, 32):
        return np.array(x, {16: "<i2", 61: ">i2", 32: "<i4"}[kind]).tobytes()
    if kind == 24:
        return b"".join((v & 0xFFFFFF).to_bytes(3, "little") for v in x)
    if kind == 80:
        return bytes(v + 128 for v in x)
    if kind == 160:
        return b"".join((v + 32768).to_bytes(2, "little") for v in x)
    if kind == 212:
        x = x + [0] * (len(x) % 2)
        return b"".join(bytes([a & 255, (a >> 8 & 15) | (b >> 8 & 15) << 4, b & 255]) for a, b in zip(x[::2], x[1::2], strict=True))
    x = [v & 1023 for v in x + [0] * (-len(x) % 3)]
    out = b""
    for a, b, c in zip(x[::3], x[1::3], x[2::3], strict=True):
        if kind == 310:
            out += (a << 1 | (c & 31) << 11).to_bytes(2, "little") + (b << 1 | c >> 5 << 11).to_bytes(2, "little")
        else:
            out += (a | b << 10 | c << 20).to_bytes(4, "little")
    return out


BITS = {8: 6, 16: 16, 24: 24, 32: 32, 61: 16, 80: 8, 160: 16, 212: 12, 310: 10, 311: 10}


def values(kind, n, seed=0):
    top = 1 << (BITS[kind] - 1)
    r = np.random.default_rng(seed)
    return r.integers(-30, 30, n) if kind == 8 else np.r_[[-top + 1, top - 1, 0, -1, 1], r.integers(-top + 1, top, n - 5)]


@pytest.mark.parametrize("kind", list(BITS))
def test_decoders(kind):
    x = values(kind, 60)
    got = waves.decode(kind, packed(kind, x))
    assert (np.cumsum(got) if kind == 8 else got).tolist() == x.tolist()


def rows(df):
    assert df.filter("message IS NOT NULL").count() == 0
    out = {}
    for r in df.orderBy("recording_id", "channel", "idx").collect():
        out.setdefault((r.recording_id.rsplit("/", 1)[1], r.channel), []).append((r.idx, r.v))
    assert all([i for i, _ in x] == list(range(len(x))) for x in out.values())
    return {k: [v for _, v in x] for k, x in out.items()}


def test_formats_and_stretches(spark, tmp_path):
    want = {}
    for kind in BITS:
        a, b = values(kind, 101, 1), values(kind, 101, 2)
        flat = np.stack([a, b], 1).ravel()
        raw = packed(kind, flat)
        if kind == 8:  # each signal has differences of its own
            raw = np.stack([np.diff(a, prepend=5), np.diff(b, prepend=-3)], 1).astype(np.int8).tobytes()
        (tmp_path / f"f{kind}.dat").write_bytes(raw)
        first = (5, -3) if kind == 8 else (0, 0)
        (tmp_path / f"f{kind}.hea").write_text(f"# a remark\nf{kind} 2 250 101\nf{kind}.dat {kind} 100(7)/mV 12 0 {first[0]} 0 0 lead one\nf{kind}.dat {kind} 50 12 3 {first[1]} 0 0 lead two\n")
        want[f"f{kind}", 0], want[f"f{kind}", 1] = ((a - 7) / 100).tolist(), ((b - 3) / 50).tolist()
    for samples in (1 << 20, 20):
        df = waves.read(spark, str(tmp_path), samples=samples)
        assert rows(df) == want
        assert df.rdd.getNumPartitions() == (len(BITS) if samples > 1000 else df.rdd.getNumPartitions())
    assert waves.read(spark, str(tmp_path), samples=20).rdd.getNumPartitions() > 60
    some = waves.read(spark, f"file://{tmp_path}", [1])
    assert rows(some) == {k: v for k, v in want.items() if k[1] == 1}
    assert {r.channel_name for r in some.select("channel_name").distinct().collect()} == {"lead two"}


def test_files_frames_offsets_and_invalid_samples(spark, tmp_path):
    """Two files of a record, one with two samples a frame and an offset; invalid samples are NULL; channels prune files."""
    slow, fast, other = np.arange(40), np.arange(80) * 3, np.r_[-2048, np.arange(39)]
    flat = np.concatenate([[s, *fast[2 * i : 2 * i + 2]] for i, s in enumerate(slow)])
    (tmp_path / "a.dat").write_bytes(b"header--" + packed(16, flat))
    (tmp_path / "b.dat").write_bytes(packed(212, other))
    (tmp_path / "r.hea").write_text("r 3 100 40\na.dat 16+8 1(0) 12 0 0 0 0 slow\na.dat 16x2+8 1(0) 12 0 0 0 0 fast\nb.dat 212 1(0) 12 0 0 0 0 other\n")
    for samples in (1000, 7):
        got = rows(waves.read(spark, str(tmp_path), samples=samples))
        assert got == {("r", 0): slow.tolist(), ("r", 1): fast.tolist(), ("r", 2): [None, *range(39)]}
    times = waves.read(spark, str(tmp_path), [1]).orderBy("idx").collect()
    assert times[5].t == pytest.approx(5 / 200)
    (tmp_path / "b.dat").unlink()
    assert rows(waves.read(spark, str(tmp_path), [0]).filter("recording_id LIKE '%/r'"))[("r", 0)] == slow.tolist()


def test_arrays_and_bad_files(spark, tmp_path):
    x = np.arange(300.0).reshape(100, 3)
    x[4, 1] = np.nan
    np.save(tmp_path / "c.npy", x)
    np.save(tmp_path / "f.npy", np.asfortranarray(x))
    np.save(tmp_path / "one.npy", np.arange(50, dtype=np.int16))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    (tmp_path / "bad.hea").write_text("bad 1 100\nbad.dat 999 1\n")
    (tmp_path / "gone.hea").write_text("gone 1 100 10\nnowhere.dat 16 1\n")
    (tmp_path / "many.hea").write_text("many/3 1 100 10\n")
    df = waves.read(spark, str(tmp_path), samples=60)
    said = {r.recording_id.rsplit("/", 1)[1]: r.message for r in df.filter("message IS NOT NULL").collect()}
    assert set(said) == {"bad.npy", "bad.hea", "gone.hea", "many.hea"} and "999" in said["bad.hea"] and "several segments" in said["many.hea"]
    got = rows(df.filter("message IS NULL"))
    for name in ("c.npy", "f.npy"):
        assert [got[name, k] for k in range(3)] == [[None if v != v else v for v in x[:, k]] for k in range(3)]
    assert got["one.npy", 0] == list(range(50))
    (tmp_path / "none").mkdir()
    assert waves.read(spark, str(tmp_path / "none")).count() == 0


def test_written_records_come_back(spark, tmp_path):
    signal = spark.range(2000).select(F.concat(F.lit("r/"), (F.col("id") % 2).cast("string")).alias("recording_id"), F.floor(F.col("id") / 2).alias("idx"), F.when(F.col("id") % 97 > 0, F.sin("id")).alias("v"))
    assert waves.write_wfdb(signal, str(tmp_path / "out"), 360.0, 1000.0) == 2
    got = rows(waves.read(spark, str(tmp_path / "out"), samples=300))
    for k in (0, 1):
        want = [None if (2 * i + k) % 97 == 0 else round(np.sin(2 * i + k), 3) for i in range(1000)]
        assert got[f"r_{k}", 0] == pytest.approx(want)
