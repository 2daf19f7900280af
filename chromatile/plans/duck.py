"""Check-engine SQL for the fixture views and the shared colour expressions."""

from __future__ import annotations

from chromatile.functions.color import SRGB_TO_XYZ, XYZ_TO_SRGB


def ibyte(x: str) -> str:
    return f"CAST(least(255, greatest(0, floor(({x}) + 0.5::DOUBLE))) AS INT)"


PX = f"""px AS (
  SELECT CAST(l_suppkey % 8 AS INT) AS image_id, l_orderkey, l_linenumber, l_partkey,
    {ibyte("l_quantity::DOUBLE * 5.1::DOUBLE")} AS r,
    {ibyte("l_discount::DOUBLE * 2550::DOUBLE")} AS g,
    {ibyte("l_tax::DOUBLE * 3187.5::DOUBLE")} AS b,
    CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE 255 END AS INT) AS a
  FROM lineitem)"""

GRID = f"""grid AS (
  SELECT 0::INT AS image_id, CAST(vec_id AS INT) AS y, CAST(t.x AS INT) AS x,
    {ibyte("(embedding[3*t.x+1]::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE")} AS r,
    {ibyte("(embedding[3*t.x+2]::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE")} AS g,
    {ibyte("(embedding[3*t.x+3]::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE")} AS b,
    255::INT AS a
  FROM embeddings, (SELECT unnest(range(0, 21)) AS x) t)"""

GRAY = f"""gray AS (
  SELECT 0::INT AS image_id, CAST(vec_id AS INT) AS y, CAST(t.x AS INT) AS x,
    {ibyte("(embedding[t.x+1]::DOUBLE + 0.5::DOUBLE) * 255::DOUBLE")} AS v
  FROM embeddings, (SELECT unnest(range(0, 64)) AS x) t)"""

CATALOG = """rawcat AS (
  SELECT p_partkey AS ord, p_name AS name, CAST(p_partkey * 37 % 256 AS INT) AS r,
    CAST(p_size * 5 % 256 AS INT) AS g, CAST(floor(p_retailprice)::BIGINT % 256 AS INT) AS b
  FROM part)"""

EDITS = """edits AS (
  SELECT user_id, ts, event_id,
    CASE event_type WHEN 'click' THEN 'set' WHEN 'view' THEN 'select' WHEN 'purchase' THEN 'commit'
      WHEN 'error' THEN 'undo' ELSE 'redo' END AS action,
    CAST(floor(value)::BIGINT % 256 AS INT) AS color,
    CAST(json_extract_string(props, '$.k') AS INT) AS payload
  FROM events)"""

TREE = """tree AS (
  SELECT r_regionkey::INT AS doc_id, 'r' || r_regionkey AS id, '' AS parent_id, 0::INT AS ord,
    'image' AS kind, r_regionkey <> 1 AS visible, true AS expanded FROM region
  UNION ALL
  SELECT n_regionkey::INT, 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey::INT, 'group', true,
    n_nationkey % 4 <> 3 FROM nation
  UNION ALL
  SELECT n_regionkey::INT, 's' || s_suppkey, 'n' || s_nationkey, s_suppkey::INT, 'range',
    s_acctbal > 0, true FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""

BOXES = """boxes AS (
  SELECT 0::INT AS image_id, box_id, x0, y0, least(x0 + 2 + dx, 21)::INT AS x1,
    least(y0 + 2 + dy, rws)::INT AS y1
  FROM (SELECT p_partkey AS box_id, CAST(p_size % 18 AS INT) AS x0,
      CAST(p_partkey % (SELECT max(vec_id) + 1 FROM embeddings) AS INT) AS y0,
      CAST((SELECT max(vec_id) + 1 FROM embeddings) AS INT) AS rws,
      CAST(p_partkey % 3 AS INT) AS dx, CAST(p_size % 5 AS INT) AS dy
    FROM part))"""


def q(x: str, digits: int = 4) -> str:
    step = 10**digits
    return f"(floor(({x})::DOUBLE * {step}::DOUBLE + 0.5::DOUBLE) / {step}::DOUBLE)"


def rint(x: str) -> str:
    return f"round_even(({x})::DOUBLE, 0)"


def tobyte(x: str) -> str:
    return f"CAST(least(255, greatest(0, {rint(x)})) AS INT)"


def luma(r="r", g="g", b="b") -> str:
    return f"(0.2126::DOUBLE*{r} + 0.7152::DOUBLE*{g} + 0.0722::DOUBLE*{b})"


def lab_cte(name: str, src: str, r="r", g="g", b="b", lab=("lab_l", "lab_a", "lab_b")) -> str:
    """CTE ``name``: ``src`` plus Lab columns."""

    def lin(c):
        s = f"({c} / 255::DOUBLE)"
        return (
            f"CASE WHEN {s} <= 0.04045::DOUBLE THEN {s} / 12.92::DOUBLE"
            f" ELSE pow(({s} + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END"
        )

    def mix(i, white):
        m = SRGB_TO_XYZ[i]
        return f"({m[0]}::DOUBLE*_lr + {m[1]}::DOUBLE*_lg + {m[2]}::DOUBLE*_lb) / {white}::DOUBLE"

    def f(t):
        k = 6.0 / 29.0
        return (
            f"CASE WHEN {t} > {k**3!r}::DOUBLE THEN cbrt({t})"
            f" ELSE {t} / {3*k*k!r}::DOUBLE + {4/29!r}::DOUBLE END"
        )

    return f"""{name} AS (
  SELECT * EXCLUDE (_lr,_lg,_lb,_tx,_ty,_tz,_fx,_fy,_fz),
    116::DOUBLE*_fy - 16::DOUBLE AS {lab[0]}, 500::DOUBLE*(_fx-_fy) AS {lab[1]}, 200::DOUBLE*(_fy-_fz) AS {lab[2]}
  FROM (SELECT *, {f('_tx')} AS _fx, {f('_ty')} AS _fy, {f('_tz')} AS _fz
  FROM (SELECT *, {mix(0, 0.95047)} AS _tx, {mix(1, 1.0)} AS _ty, {mix(2, 1.08883)} AS _tz
  FROM (SELECT *, {lin(r)} AS _lr, {lin(g)} AS _lg, {lin(b)} AS _lb FROM {src}))))"""


def unlab_cte(name: str, src: str, lab=("lab_l", "lab_a", "lab_b"), rgb=("r", "g", "b")) -> str:
    """CTE ``name``: ``src`` plus 8-bit RGB computed from Lab columns."""
    lab_l, lab_a, lab_b = lab

    def back(t, white):
        k = 6.0 / 29.0
        return (
            f"(CASE WHEN {t} > {k!r}::DOUBLE THEN {t}*{t}*{t}"
            f" ELSE ({t} - {4/29!r}::DOUBLE) * {3*k*k!r}::DOUBLE END) * {white}::DOUBLE"
        )

    def mix(i):
        m = XYZ_TO_SRGB[i]
        return f"greatest(0::DOUBLE, ({m[0]!r})::DOUBLE*_x + ({m[1]!r})::DOUBLE*_y + ({m[2]!r})::DOUBLE*_z)"

    def gam(v):
        return tobyte(
            f"(CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v}*12.92::DOUBLE"
            f" ELSE 1.055::DOUBLE*pow({v}, {1/2.4!r}::DOUBLE) - 0.055::DOUBLE END) * 255::DOUBLE"
        )

    return f"""{name} AS (
  SELECT * EXCLUDE (_fx,_fy,_fz,_x,_y,_z,_l0,_l1,_l2), {gam('_l0')} AS {rgb[0]}, {gam('_l1')} AS {rgb[1]}, {gam('_l2')} AS {rgb[2]}
  FROM (SELECT *, {mix(0)} AS _l0, {mix(1)} AS _l1, {mix(2)} AS _l2
  FROM (SELECT *, {back('_fx', 0.95047)} AS _x, {back('_fy', 1.0)} AS _y, {back('_fz', 1.08883)} AS _z
  FROM (SELECT *, ({lab_l}+16::DOUBLE)/116::DOUBLE + {lab_a}/500::DOUBLE AS _fx, ({lab_l}+16::DOUBLE)/116::DOUBLE AS _fy,
    ({lab_l}+16::DOUBLE)/116::DOUBLE - {lab_b}/200::DOUBLE AS _fz FROM {src}))))"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(ctes) + "\n"
