import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chromatile.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, "tests")
    s.sparkContext.setLogLevel("OFF")
    return s


def raster(spark, *arrays):
    """Pixel table of H x W x 3 (or 4) arrays, image ids 0, 1, ..."""
    rows = []
    for i, arr in enumerate(arrays):
        arr = np.asarray(arr)
        for y in range(arr.shape[0]):
            for x in range(arr.shape[1]):
                p = [int(v) for v in arr[y, x]]
                rows.append((i, y, x, *p[:3], p[3] if len(p) > 3 else 255))
    return spark.createDataFrame(rows, "image_id int, y int, x int, r int, g int, b int, a int")


def plane(spark, arr, name="v", kind="double", image=0):
    arr = np.asarray(arr)
    rows = [(image, y, x, arr[y, x].item()) for y in range(arr.shape[0]) for x in range(arr.shape[1])]
    return spark.createDataFrame(rows, f"image_id int, y int, x int, {name} {kind}")


def to_array(df, h, w, cols=("r", "g", "b")):
    out = np.zeros((h, w, len(cols)))
    for r in df.select("y", "x", *cols).collect():
        out[r.y, r.x] = [r[c] for c in cols]
    return out[..., 0] if len(cols) == 1 else out
