"""Sizes of image files from their headers, as column expressions on the file's bytes.

Nothing is decoded: a PNG is read at fixed places, with a walk of its chunks for the
transparency of a palette; a JPEG by a walk of its markers up to the frame header; a TIFF
by the entries of its first directory.  A walk is one ``aggregate`` over a bounded number
of steps, and reads a few bytes of the content in each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Fixed values of the formats.
PNG_SIGNATURE = "89504E470D0A1A0A"
TIFF_WIDTH, TIFF_HEIGHT, TIFF_BITS, TIFF_PHOTOMETRIC, TIFF_SAMPLES = 256, 257, 258, 262, 277
#: Chunks of a PNG before its pixels, and segments of a JPEG before its frame, that a walk follows.
MAX_STEPS = 1024

HEADER = "format string, width long, height long, channels int, bits int"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _hex(content: Column, at: Column, n: int) -> Column:
    return F.hex(F.substring(content, (at + 1).cast("int"), F.lit(n)))


def _number(content: Column, at: Column, n: int, little: Column | None = None) -> Column:
    """Number of ``n`` bytes, the high one first unless ``little``; null past the end."""

    def read(h: Column) -> Column:
        turned = h if little is None else F.when(little, F.concat(*[F.substring(h, 2 * i + 1, 2) for i in reversed(range(n))])).otherwise(h)
        return F.when(F.length(h) == 2 * n, F.conv(turned, 16, 10).cast("long"))

    return _let(_hex(content, at, n), read)


def _found(kind: str, width: Column, height: Column, channels: Column, bits: Column) -> Column:
    return F.struct(F.lit(kind).alias("format"), width.cast("long").alias("width"), height.cast("long").alias("height"), channels.cast("int").alias("channels"), bits.cast("int").alias("bits"))


def _walk(start: Column, names: dict[str, Column], step: Callable[[Column], Column]) -> Column:
    """State after at most ``MAX_STEPS`` steps; a state whose ``at`` is null stays."""
    state = F.struct(start.cast("long").alias("at"), *[v.alias(k) for k, v in names.items()])
    return F.aggregate(F.sequence(F.lit(1), F.lit(MAX_STEPS)), state, lambda s, _: F.when(s["at"].isNull(), s).otherwise(step(s)))


def _png(c: Column) -> Column:
    def step(s: Column) -> Column:
        def after(head: Column) -> Column:
            over = head["size"].isNull() | head["name"].isin("49444154", "49454E44")  # IDAT, IEND
            return F.struct(F.when(~over, s["at"] + head["size"] + 12).alias("at"), (s["clear"] | (head["name"] == "74524E53")).alias("clear"))  # tRNS

        return _let(F.struct(_number(c, s["at"], 4).alias("size"), _hex(c, s["at"] + 4, 4).alias("name")), after)

    def found(kind: Column) -> Column:
        palette = F.when(_walk(F.lit(33), {"clear": F.lit(False)}, step)["clear"], 4).otherwise(3)
        channels = F.when(kind.isin(0, 4), 1).when(kind == 2, 3).when(kind == 3, palette).when(kind == 6, 4)
        return _found("png", _number(c, F.lit(16), 4), _number(c, F.lit(20), 4), channels, _number(c, F.lit(24), 1))

    return _let(_number(c, F.lit(25), 1), found)


def _jpeg(c: Column) -> Column:
    def step(s: Column) -> Column:
        def after(m: Column) -> Column:
            mark, at = m["mark"], s["at"]
            frame = (mark >= 0xC0) & (mark <= 0xCF) & ~mark.isin(0xC4, 0xC8, 0xCC)
            lost = m["lead"].isNull() | mark.isNull() | (m["lead"] != 0xFF) | mark.isin(0xD9, 0xDA)
            # Fill bytes, marks without a segment, segments with their length.
            far = F.when(mark == 0xFF, at + 1).when(mark.isin(0x01, *range(0xD0, 0xD8)), at + 2).otherwise(at + 2 + _number(c, at + 2, 2))
            return F.struct(F.when(~lost & ~frame, far).alias("at"), F.when(frame & ~lost, at).otherwise(s["frame"]).alias("frame"))

        return _let(F.struct(_number(c, s["at"], 1).alias("lead"), _number(c, s["at"] + 1, 1).alias("mark")), after)

    def found(at: Column) -> Column:
        channels = _let(_number(c, at + 9, 1), lambda n: F.when(n.isin(1, 3), n))
        return _found("jpeg", _number(c, at + 7, 2), _number(c, at + 5, 2), channels, _number(c, at + 4, 1))

    return _let(_walk(F.lit(2), {"frame": F.lit(None).cast("long")}, step)["frame"], found)


def _tiff(c: Column) -> Column:
    names = {TIFF_WIDTH: "width", TIFF_HEIGHT: "height", TIFF_SAMPLES: "samples", TIFF_PHOTOMETRIC: "color", TIFF_BITS: "bits"}
    empty = F.struct(*[F.lit(None).cast("long").alias(n) for n in names.values()])

    def directory(h: Column) -> Column:
        little, first = h["little"], h["first"]
        number = lambda at, n: _number(c, at, n, little)

        def step(s: Column, i: Column) -> Column:
            def entry(at: Column) -> Column:
                def take(e: Column) -> Column:
                    # Over two short values stand at the place that the entry names.
                    short = F.when(e["count"] > 2, number(number(at + 8, 4), 2)).otherwise(number(at + 8, 2))
                    value = F.when(e["kind"] == 3, short).otherwise(number(at + 8, 4))
                    return _let(value, lambda v: F.struct(*[F.when(e["tag"] == t, v).otherwise(s[n]).alias(n) for t, n in names.items()]))

                return _let(F.struct(number(at, 2).alias("tag"), number(at + 2, 2).alias("kind"), number(at + 4, 4).alias("count")), take)

            return _let(first + 2 + 12 * i, entry)

        entries = F.greatest(F.least(number(first, 2), F.lit(4096)) - 1, F.lit(0)).cast("int")
        return F.aggregate(F.sequence(F.lit(0), F.coalesce(entries, F.lit(0))), empty, step)

    def found(d: Column) -> Column:
        samples = F.coalesce(d["samples"], F.lit(1))
        channels = F.when(d["color"].isin(0, 1), 1).when((d["color"] == 2) & samples.isin(3, 4), samples).when(d["color"] == 3, 3)
        return _found("tiff", d["width"], d["height"], channels, F.coalesce(d["bits"], F.lit(1)))

    def start(little: Column) -> Column:
        return _let(F.struct(little.alias("little"), _number(c, F.lit(4), 4, little).alias("first")), directory)

    return _let(_let(_hex(c, F.lit(0), 2) == "4949", start), found)


def image_header(content: Column) -> Column:
    """``struct<format, width, height, channels, bits>`` of PNG, JPEG and TIFF bytes; null for anything else.

    ``channels`` is what a decoder gives: 1 for grey, 3 for RGB, 4 with transparency; null for
    other colours (CMYK among them), and fields past the end of a cut file are null.
    """
    kinds = lambda start: (
        F.when(start == PNG_SIGNATURE, _png(content))
        .when(start.startswith("FFD8FF"), _jpeg(content))
        .when(start.startswith("49492A00") | start.startswith("4D4D002A"), _tiff(content))
    )
    return _let(_hex(content, F.lit(0), 8), kinds)
