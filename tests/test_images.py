"""The test corpus against known digests, and images against plain versions."""

import hashlib

import numpy as np
import pytest

from lumenweave.operators import images as I
from lumenweave.plans import images as Q
from tests.known_digests import KNOWN

# Fixed value: SHA-256 over the lines "name q=N digest" of the thirty images' levels at all six qualities, in order of name and q as text; the digests of one quality are in
# ``known_digests`` one by one.
LEVELS = "45b47fa0058dba57f3168010e39ae59a910266beb00714607245e869980a676b"


def together(lines):
    return hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest()


@pytest.fixture(scope="module")
def dump(spark):
    return I.transform_dump(I.padded(I.i420(I.corpus(spark))))


def of_blocks(rows):
    """SHA-256 of the coefficients as 16-bit numbers, macroblock by macroblock: y2, y, u, v."""
    rows = sorted(rows, key=lambda r: (r.my, r.mx, ("y2", "y", "u", "v").index(r.plane), r.k))
    return hashlib.sha256(np.array([r.c for r in rows], "<i2").tobytes()).hexdigest()


def test_corpus_has_the_known_pixels_and_planes(spark):
    rows = Q._digests(I.corpus(spark)).collect()
    assert {r.name: (r.rgb_sha, r.yuv_sha) for r in rows} == {n: k[:2] for n, k in KNOWN.items()}


def test_corpus_has_the_known_dumps(dump):
    images = {}
    for r in dump.collect():
        images.setdefault(r.name, []).append(r)
    assert {n: of_blocks(rows) for n, rows in images.items()} == {n: k[2] for n, k in KNOWN.items()}


def test_corpus_has_the_known_levels(dump):
    images = {}
    for r in Q.quantized_dump(dump).collect():
        images.setdefault((r.name, r.q), []).append(r)
    assert {n: of_blocks(rows) for (n, q), rows in images.items() if q == 75} == {n: k[3] for n, k in KNOWN.items()}
    assert together(f"{n} q={q} {of_blocks(rows)}" for (n, q), rows in images.items()) == LEVELS


def test_noise_jumps_where_steps_lead(spark):
    state, want = 1, []
    for _ in range(600):
        state = (state * 1664525 + 1013904223) & 0xFFFFFFFF
        want.append(state)
    got = spark.range(1, 601).select("id", I.noise_state(Q.F.col("id")).alias("s")).orderBy("id").collect()
    assert [r.s for r in got] == want


def test_generated_images_have_no_rows_of_pixels(spark, sf_dir):
    from lumenweave import plans

    df = plans.queries()["generate_patterns"](spark, sf_dir)
    assert df.count() == spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey").distinct().count()
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_generated_images_of_one_name_and_large_ones(spark):
    rows = [(1, "noise", 9, 8), (1, "noise", 9, 8), (2, "rgbgrad", 8, 8), (2, "rgbgrad", 8, 9), (3, "noise", 300, 300), (4, "diag", None, 8), (None, "solid", 8, 8)]
    got = {r.name: bytes(r.rgb) for r in I.generated(spark.createDataFrame(rows, "name long, pattern string, w long, h long")).collect()}
    state, noise = 1, []
    for _ in range(300 * 300):
        state = (state * 1664525 + 1013904223) % 2**32
        noise.append(bytes([state & 255, state >> 8 & 255, state >> 16 & 255]))
    gradient = [[bytes([i % 8 * 255 // 7, i // 8 * 255 // (h - 1), (i % 8 + i // 8) * 255 // (h + 6)]) for i in range(8 * h)] for h in (8, 9)]
    both = [b"".join(sorted(g[i] for g in gradient if i < len(g))) for i in range(72)]
    assert got[1] == b"".join(p * 2 for p in noise[:72]) and got[2] == b"".join(both)
    assert hashlib.sha256(got[3]).digest() == hashlib.sha256(b"".join(noise)).digest()
    assert got[None] == bytes([17, 34, 51]) * 64 and set(got) == {1, 2, 3, None}
