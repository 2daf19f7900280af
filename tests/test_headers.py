"""Sizes from file headers against the decoder, and headers that are cut or of other formats."""

import struct
import zlib

import pytest
from chromatile.functions.headers import image_header
from chromatile.sources import images
from pyspark.sql import functions as F


def chunk(tag, body):
    return struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))


def png(w, h, kind, bits=8, extra=b""):
    per = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind] * bits // 8
    raw = zlib.compress(b"".join(b"\0" + bytes(w * per) for _ in range(h)))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, bits, kind, 0, 0, 0))
    palette = chunk(b"PLTE", bytes(range(256)) * 3) if kind == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + head + chunk(b"tEXt", b"Comment\0" + b"a" * 500) + palette + extra + chunk(b"IDAT", raw) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Files of all formats, from the JVM's own writers and by hand."""
    path = tmp_path_factory.mktemp("images")
    java = spark.sparkContext._jvm.java
    kinds = java.awt.image.BufferedImage
    for name, kind in (("rgb", kinds.TYPE_INT_RGB), ("abgr", kinds.TYPE_4BYTE_ABGR), ("gray", kinds.TYPE_BYTE_GRAY), ("indexed", kinds.TYPE_BYTE_INDEXED)):
        for fmt in ("png", "jpg", "tif"):
            picture = kinds(37, 23 + len(name), kind)
            spark.sparkContext._jvm.javax.imageio.ImageIO.write(picture, fmt if fmt != "tif" else "tiff", java.io.File(f"{path}/{name}.{fmt}"))
    for kind in (0, 2, 3, 4, 6):
        (path / f"own{kind}.png").write_bytes(png(11, 7 + kind, kind))
    (path / "clear.png").write_bytes(png(5, 6, 3, extra=chunk(b"tRNS", b"\0\xff")))
    return path


def test_sizes_equal_the_decoders(spark, folder):
    decoded = images._decoded(spark, str(folder)).select(F.col("image.origin").alias("p"), "image.width", "image.height", "image.nChannels")
    name = lambda p: p.rsplit("/", 1)[1]
    want = {name(r["p"]): (r["width"], r["height"], r["nChannels"]) for r in decoded.collect()}
    files = spark.read.format("binaryFile").load(str(folder)).select("path", image_header(F.col("content")).alias("h")).select("path", "h.*")
    have = {name(r["path"]): (r["width"], r["height"], r["channels"]) for r in files.collect()}
    assert len(want) > 12
    assert {n: have[n] for n in want if want[n][0] > 0} == {n: v for n, v in want.items() if v[0] > 0}
    ok, rejects = images.image_headers(spark, str(folder))
    assert {name(r["path"]): (r["width"], r["height"], r["channels"]) for r in ok.collect()} == {n: v for n, v in want.items() if v[2] in (3, 4)}
    assert {name(r["path"]) for r in rejects.collect()} == set(have) - {n for n, v in want.items() if v[2] in (3, 4)}


def jpeg(w, h, comps=3, before=b"", sof=0xC0):
    app = b"\xff\xe1" + struct.pack(">H", 60_002) + bytes(60_000)
    frame = b"\xff" + bytes([sof]) + struct.pack(">HBHHB", 8 + 3 * comps, 8, h, w, comps) + bytes(3 * comps)
    return b"\xff\xd8" + app * 5 + before + frame + b"\xff\xda"


def tiff(order, entries):
    body = struct.pack(order + "H", len(entries))
    for tag, kind, count, value in entries:
        body += struct.pack(order + "HHI", tag, kind, count) + (struct.pack(order + "HH", value, 0) if kind == 3 else struct.pack(order + "I", value))
    return (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 100) + bytes(92) + body


@pytest.mark.parametrize(
    "data, want",
    [
        (jpeg(700, 300), ("jpeg", 700, 300, 3, 8)),
        (jpeg(70, 65_000, 1, sof=0xC2), ("jpeg", 70, 65_000, 1, 8)),
        (jpeg(70, 30, 4), ("jpeg", 70, 30, None, 8)),
        (jpeg(9, 8, before=b"\xff\xff\xff\xd0\xff\xc4\x00\x04ab"), ("jpeg", 9, 8, 3, 8)),
        (jpeg(9, 8)[:-30], ("jpeg", None, None, None, None)),
        (b"\xff\xd8\xff\xda\0\0", ("jpeg", None, None, None, None)),
        (tiff("<", [(256, 4, 1, 70_000), (257, 3, 1, 50), (258, 3, 1, 16), (262, 3, 1, 2), (277, 3, 1, 3)]), ("tiff", 70_000, 50, 3, 16)),
        (tiff(">", [(256, 3, 1, 5), (257, 3, 1, 6), (262, 3, 1, 5), (277, 3, 1, 4)]), ("tiff", 5, 6, None, 1)),
        (tiff("<", [(256, 3, 1, 5)])[:104], ("tiff", None, None, None, 1)),
        (b"II*\0", ("tiff", None, None, None, 1)),
        (png(3, 2, 2, 16), ("png", 3, 2, 3, 16)),
        (png(3, 2, 6)[:18], ("png", None, None, None, None)),
        (b"GIF89a", None),
        (b"", None),
        (None, None),
    ],
)
def test_headers_by_hand(spark, data, want):
    (row,) = spark.createDataFrame([(data,)], "content binary").select(image_header(F.col("content")).alias("h")).collect()
    assert (None if row["h"] is None else tuple(row["h"])) == want
