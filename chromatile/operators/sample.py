"""Stable pixel samples for scatter plots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

CAP = 6000
# Parts of one image that rank on their own first.
PARTS = 16


def sample_pixels(labelled: DataFrame, cap: int = CAP) -> DataFrame:
    """Up to ``cap`` labelled pixels per image, the same ones on every run.

    Pixels rank by a hash of their position, in parts of the image first, so that the
    last ranking sees ``PARTS * cap`` rows of an image at most, however many tasks
    read it.  Order the result by (image_id, y, x) to list it.
    """
    key = F.md5(F.concat_ws(",", "y", "x"))
    # Unlabelled pixels sort last and leave after the window; a filter before it would
    # be pushed under the labelling and evaluate the label twice.
    order = [(F.col("label") < 0).cast("int"), key, "y", "x"]
    ranked = labelled.withColumn("_p", F.pmod(F.xxhash64("y", "x"), F.lit(PARTS)))
    for part in (["image_id", "_p"], ["image_id"]):
        ranked = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("_k") <= cap)
    return ranked.filter(F.col("label") >= 0).select(*labelled.columns)
