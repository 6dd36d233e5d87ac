import numpy as np

from veritrail.functions import images


def picture(pixels):
    return b"P5\n%d %d\n255\n" % pixels.shape[::-1] + pixels.astype(np.uint8).tobytes()


def test_measurements(spark):
    rng = np.random.default_rng(0)
    coarse = np.kron(rng.integers(0, 256, (8, 8)), np.ones((12, 16)))
    noisy = np.clip(coarse + rng.normal(0, 3, coarse.shape), 0, 255)
    other = np.kron(rng.integers(0, 256, (8, 8)), np.ones((12, 16)))
    colour = b"P6 2 1 255\n" + bytes([255, 0, 0, 0, 255, 0])
    contents = [picture(coarse), picture(noisy), picture(other), colour, b"", None, b"P5\n9", b"P5\n9 9\n255\nx", b"\xff\xd8broken"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(contents)], "id int, content binary")
    rows = {r.id: r.m for r in df.select("id", images.image_metrics("content").alias("m")).collect()}
    assert [rows[i].readable for i in range(9)] == [True] * 4 + [False] * 5
    assert (rows[0].width, rows[0].height, rows[0].channels) == (128, 96, 1) and rows[3].channels == 3
    assert (rows[0].phash ^ rows[1].phash).bit_count() <= 6 < (rows[0].phash ^ rows[2].phash).bit_count()
    assert 0 <= rows[0].phash < 1 << 63
    assert abs(rows[0].mean_gray - coarse.mean()) < 1e-6
    assert rows[1].laplacian_variance > 0


def test_shrink_keeps_means():
    levels = np.arange(64 * 96, dtype=float).reshape(64, 96)
    assert np.isclose(images.shrink(levels, 32).mean(), levels.mean())
    assert images.shrink(np.ones((3, 5)), 32).shape == (32, 32)
