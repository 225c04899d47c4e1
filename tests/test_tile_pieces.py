"""Windows of records that come in pieces."""

import random

from oligo_engine.operators import tiling


def test_windows_are_cut_from_short_parts(spark):
    rng = random.Random(3)
    sizes = [0, 20, 21, 22, 83, 84, 85, 86, 148, 149, tiling.PIECE, tiling.PIECE + 1, tiling.PIECE + tiling.HALO]
    rows = [(i, 10**10 + i, "".join(rng.choices("AUGC", k=n))) for i, n in enumerate(sizes)]
    cut = spark.createDataFrame(rows, "record_no long, start long, piece string")
    tiles = tiling.tile_pieces(cut)
    got = {(r.record_no, r.position, r.sense, r.antisense) for r in tiles.collect()}
    pairs = str.maketrans("AUGC", "UACG")
    want = {
        (i, start + p, piece[p:p + 21], piece[p:p + 21].translate(pairs)[::-1])
        for i, start, piece in rows for p in range(min(len(piece) - 20, tiling.PIECE))
    }
    assert got == want and tiles.count() == len(want)
    # a window is found in a part of 84 letters and not by walking through its piece
    assert f"{tiling.PART + tiling.HALO}) AS _part" in tiles._jdf.queryExecution().toString()
