"""Hard negatives by Kronecker-packed integer products.

Vectors become whole numbers.  Shifted to be non-negative, the same component of several
candidates fits side by side into one wide number: candidate j is multiplied by 2^(w j),
where no score of shifted vectors reaches 2^w.  A sum of products of an anchor's components
and packed components then holds the scores of all its candidates in separate fields, and
shifts and masks give them back without rounding.  The wide number is a float64, which holds
53 bits of a whole number, so that one matrix product does the multiplications; all terms
are non-negative and no sum reaches 2^53, so every order of summation is exact.  Vectors whose
fields are wider than that are packed into Python integers, which have no limit.

Anchors and candidates meet in blocks of a fixed number of rows, all anchors with all rows.
The first round keeps each block's best rows of the anchor's label, and the best of all
blocks are the positives.  The second keeps, per positive, each block's best rows of other
labels whose score lies in the margin of the positive's.

Results: rows with a null label or vector, a null or non-finite component, a length other
than the most frequent one (ties: the shorter), or a squared length of 2^62 or more (whose
scores may leave the range of a long) take no part.  A null id is larger than every other, is
no anchor, and is null in the result.  Every row is a row of its own: a copy of an anchor is
one of its candidates, and each copy of an anchor has results.  Ties go to the smaller id;
other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from chromatile.llm.text import NO_ID
from chromatile.session import materialize

POSITIVES, NEGATIVES, SCALE = 5, 3, 256
#: A negative scores at least and at most these hundredths of the positive's score.
LOW, HIGH = 50, 95
ANCHOR_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Anchors multiplied at once.
STRIP = 256
EXACT_BITS = 53
LONGEST = 2.0**62


def vector_rows(rows: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """``(uid, vec_id, label, v, span)``: usable vectors as bytes of whole float64 numbers, written so that ``uid`` stays."""
    v = F.transform(F.col("embedding"), lambda x: F.lit(float(scale)) * x.cast("double"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    used = rows.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("vec_id"), label.cast("string").alias("label"), F.when(F.coalesce(finite, F.lit(False)), v).alias("v"))
    used = used.filter(F.col("label").isNotNull() & F.col("v").isNotNull())

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = [np.floor(np.asarray(v, np.float64)) for v in part["v"]]
            with np.errstate(over="ignore"):
                short = np.array([float((v**2).sum()) < LONGEST for v in x], bool)
            span = [float(np.abs(v).max(initial=0)) for v in x]
            yield part.assign(v=[v.tobytes() for v in x], span=span)[short]

    out = used.mapInPandas(whole, "vec_id long, label string, v binary, span double")
    return materialize(out.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def field_bits(span: float, d: int) -> int:
    """Bits that hold any score of two vectors shifted by ``span``, whose components are then at most twice it."""
    return max(1, (d * (2 * int(span)) ** 2).bit_length())


def packed_scores(anchors: np.ndarray, candidates: np.ndarray, span: float) -> np.ndarray:
    """Exact inner products (int64) of all anchors with all candidates, several candidates a multiplication."""
    n, d = candidates.shape
    shift, bits = int(span), field_bits(span, candidates.shape[1])
    fields = EXACT_BITS // bits
    if fields:
        a, c, kind = anchors + float(shift), candidates + float(shift), np.float64
    else:
        fields, kind = 8, object
        a, c = (np.array([[int(x) + shift for x in row] for row in m], object).reshape(m.shape) for m in (anchors, candidates))
    words = -(-n // fields)
    wide = np.zeros((words, d), kind)
    for j in range(fields):
        part = c[j * words : (j + 1) * words]
        wide[: len(part)] += part * (kind(2**bits) ** j if kind is np.float64 else 2 ** (bits * j))
    product = a @ wide.T if d else np.zeros((len(a), words), kind)
    product = product.astype(np.int64) if kind is np.float64 else product
    out = np.empty((len(a), n), np.int64)
    mask = 2**bits - 1
    # (a + s)(c + s) = ac + s a + s c + s s, so each shifted score gives up its shifts.
    sums = lambda m: (m.sum(1) if d else np.zeros(len(m), kind)).astype(np.int64 if kind is np.float64 else object)
    of_a, of_c = shift * sums(a), shift * sums(c) - d * shift * shift
    for j in range(fields):
        lo, hi = j * words, min(n, (j + 1) * words)
        if lo < hi:
            out[:, lo:hi] = (((product[:, : hi - lo] >> (bits * j)) & mask) - of_a[:, None] - of_c[None, lo:hi]).astype(np.int64)
    return out


def _best(owner: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores of each owner, ties to smaller ids."""
    order = np.lexsort((ids, -score, owner))
    mine = owner[order]
    rank = np.arange(len(mine)) - np.searchsorted(mine, mine)
    return order[rank < k]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(len(column), -1)


def _strips(anchors: pd.DataFrame, rows: pd.DataFrame, span: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first anchor, scores) of a few anchors at a time."""
    a, c = _matrix(anchors["v"]), _matrix(rows["v"])
    for lo in range(0, len(a), STRIP):
        yield lo, packed_scores(a[lo : lo + STRIP], c, span)


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame, span: float, k: int) -> Iterator[pd.DataFrame]:
    """Best rows of a block with each anchor's label; only rows of one label are multiplied."""
    for label, mine in anchors.groupby("label", sort=False):
        same = rows[rows["label"] == label]
        if not len(same):
            continue
        ids, uid, own = same["vec_id"].to_numpy(), same["uid"].to_numpy(), mine["uid"].to_numpy()
        for lo, scores in _strips(mine, same, span):
            other = own[lo : lo + len(scores), None] != uid[None, :]
            least = np.full(len(scores), np.iinfo(np.int64).min)
            if scores.shape[1] > k + 1:  # the anchor itself may be one of the best
                least = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, scores.shape[1] - k - 1]
            at, col = np.nonzero(other & (scores >= least[:, None]))
            keep = _best(at, scores[at, col], ids[col], k)
            yield pd.DataFrame({"anchor": own[lo + at[keep]], "vec_id": ids[col[keep]], "uid": uid[col[keep]], "score": scores[at[keep], col[keep]]})


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame, span: float, k: int, low: int, high: int) -> Iterator[pd.DataFrame]:
    """Best rows of a block with other labels, in the margin of each positive of each anchor."""
    count = anchors["scores"].map(len).to_numpy()
    score = np.array([s for row in anchors["scores"] for s in map(int, row)], object)
    first = np.cumsum(count) - count
    # 100 n >= low p and 100 n <= high p in whole numbers.
    floor, ceil = np.array([-(-low * p // 100) for p in score], np.int64), np.array([high * p // 100 for p in score], np.int64)
    widest = np.array([(floor[f : f + n].min(), ceil[f : f + n].max()) for f, n in zip(first, count)])
    codes, names = pd.factorize(pd.concat([anchors["label"], rows["label"]]))
    of_a, of_c = codes[: len(anchors)], codes[len(anchors) :]
    ids, own = rows["vec_id"].to_numpy(), anchors["uid"].to_numpy()
    for lo, scores in _strips(anchors, rows, span):
        hi = lo + len(scores)
        fits = (scores >= widest[lo:hi, :1]) & (scores <= widest[lo:hi, 1:]) & (of_a[lo:hi, None] != of_c[None, :])
        at, col = np.nonzero(fits)
        found = scores[at, col]
        # Each hit once per positive of its anchor.
        n = count[lo + at]
        hit = np.repeat(np.arange(len(at)), n)
        slot = np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n)
        which = first[lo + at[hit]] + slot
        keep = (found[hit] >= floor[which]) & (found[hit] <= ceil[which])
        hit, slot, which = hit[keep], slot[keep], which[keep]
        best = _best(which, found[hit], ids[col[hit]], k)
        hit, slot = hit[best], slot[best]
        yield pd.DataFrame({"anchor": own[lo + at[hit]], "slot": slot.astype(np.int32), "vec_id": ids[col[hit]], "score": found[hit]})


def _blocks(anchors: DataFrame, table: DataFrame, n_anchors: int, n_rows: int, work: Callable, schema: str) -> DataFrame:
    """``work`` on every pair of a block of anchors and a block of rows."""
    down, across = max(1, -(-n_anchors // ANCHOR_BLOCK)), max(1, -(-n_rows // CANDIDATE_BLOCK))
    spot = lambda size: F.pmod(F.xxhash64("uid"), F.lit(size)).cast("int")
    renewed = [F.col(c).alias(c) for c in anchors.columns]  # both sides come from one table
    left = anchors.select(*renewed, spot(down).alias("ab"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("cb"))
    right = table.select("uid", "vec_id", "label", "v", spot(across).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("ab"))
    names = [f.split()[0] for f in schema.split(", ")]

    def block(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        parts = list(work(a, c)) if len(a) and len(c) else []
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({n: pd.Series(dtype="int64") for n in names})

    return left.groupBy("ab", "cb").cogroup(right.groupBy("ab", "cb")).applyInPandas(block, schema)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``is_anchor`` is a condition on ``vec_id``; ``label`` a column of ``rows``.
    """
    table = vector_rows(rows, F.col("label") if label is None else label, scale)
    size = F.octet_length("v")
    most = table.groupBy(size.alias("d")).agg(F.count("*").alias("n"), F.max("span").alias("span")).orderBy(F.desc("n"), "d").first()
    width, n_rows, span = (most["d"], most["n"], most["span"]) if most else (0, 0, 0.0)
    table = table.filter(size == width)
    anchors = table.filter(is_anchor & (F.col("vec_id") != NO_ID)).select("uid", "vec_id", "label", "v")
    n_anchors = anchors.count()
    found = _blocks(
        anchors, table, n_anchors, n_rows, lambda a, c: _positives(a, c, span, positives), "anchor long, vec_id long, uid long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id", "uid"))
    chosen = found.withColumn("slot", rank - 1).filter(F.col("slot") < positives)
    # At most ``positives`` rows an anchor, in the order of their slots.
    best = F.sort_array(F.collect_list(F.struct("slot", "vec_id", "score")))
    chosen = materialize(chosen.groupBy("anchor").agg(best.alias("p")), "positives")
    told = anchors.join(chosen.select(F.col("anchor").alias("uid"), F.col("p.score").alias("scores")), "uid")
    found = _blocks(
        told, table, n_anchors, n_rows, lambda a, c: _negatives(a, c, span, negatives, low, high), "anchor long, slot int, vec_id long, score long"
    )
    rank = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    named = anchors.select(F.col("uid").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    p = F.element_at("p", F.col("slot") + 1)
    known = lambda c: F.when(c != NO_ID, c)
    return (
        found.join(chosen, "anchor").join(named, "anchor")
        .select("anchor_id", known(p["vec_id"]).alias("positive_id"), "rank", known(F.col("vec_id")).alias("negative_id"), p["score"].alias("positive_score"), F.col("score").alias("negative_score"))
    )
