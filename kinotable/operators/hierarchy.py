"""Trees of placed objects: world matrices along parents, and taking objects out of their parents.

A matrix is 4 x 4, an array of rows; a rotation is a quaternion (w, x, y, z).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinotable.plans.rounds import kept

ONE = [[1.0 if i == j else 0.0 for j in range(4)] for i in range(4)]
_MATRIX = "array<array<double>>"


def identity() -> Column:
    return F.array(*[F.array(*map(F.lit, row)) for row in ONE])


def product(a: Column, b: Column) -> Column:
    """a times b: b is applied to a point first."""
    cell = lambda row, j: sum((row[k] * b[k][j] for k in range(1, 4)), row[0] * b[0][j])
    return F.transform(a, lambda row: F.array(*[cell(row, j) for j in range(4)]))


def inverse(matrix: Column) -> Column:
    """The inverse by minors of pairs of rows; null if the determinant is 0."""
    held = lambda x: F.transform(F.array(x), _inverse)[0]
    return held(matrix)


def _inverse(m: Column) -> Column:
    pairs = [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]
    upper = [m[0][i] * m[1][j] - m[1][i] * m[0][j] for i, j in pairs]
    lower = [m[2][i] * m[3][j] - m[3][i] * m[2][j] for i, j in pairs]
    both = F.array(F.struct(F.array(*upper).alias("s"), F.array(*lower).alias("c")))

    def solved(x: Column) -> Column:
        s, c = x["s"], x["c"]
        by = F.nullif(s[0] * c[5] - s[1] * c[4] + s[2] * c[3] + s[3] * c[2] - s[4] * c[1] + s[5] * c[0], F.lit(0.0))

        def row(i: int) -> Column:
            a, b, d = (j for j in range(4) if j != i)
            place = lambda p, q: pairs.index((p, q))
            sign = 1.0 if i % 2 == 0 else -1.0
            three = lambda r, t: (m[r][a] * t[place(b, d)] - m[r][b] * t[place(a, d)] + m[r][d] * t[place(a, b)]) * sign
            return F.array(three(1, c) / by, -three(0, c) / by, three(3, s) / by, -three(2, s) / by)

        return F.when(by.isNotNull(), F.array(*[row(i) for i in range(4)]))

    return F.transform(both, solved)[0]


def composed(location: Column, rotation: Column, scale: Column) -> Column:
    """The matrix that scales, then turns, then moves; a rotation is made a unit first, and one of length 0 turns nothing."""
    size = F.sqrt(sum((rotation[i] * rotation[i] for i in range(1, 4)), rotation[0] * rotation[0]))
    unit = F.transform(F.array(size), lambda n: F.when(n > 0, F.transform(rotation, lambda q: q / n)).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0)))))[0]

    def made(q: Column) -> Column:
        w, x, y, z = (q[i] for i in range(4))
        turn = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
        return F.array(*[F.array(*[turn[i][j] * scale[j] for j in range(3)], location[i]) for i in range(3)], F.array(*map(F.lit, ONE[3])))

    return F.transform(F.array(unit), made)[0]


def turned(first: Column, then: Column) -> Column:
    """The rotation of ``first`` and after it ``then``, as a quaternion."""
    w, x, y, z = (then[i] for i in range(4))
    a, b, c, d = (first[i] for i in range(4))
    return F.array(w * a - x * b - y * c - z * d, w * b + x * a + y * d - z * c, w * c - x * d + y * a + z * b, w * d + x * c - y * b + z * a)


def local_matrices(objects: DataFrame) -> DataFrame:
    """objects (name, parent, location, rotation, scale, and if there are such columns delta_location, delta_rotation, delta_scale, parent_inverse) with ``matrix``.

    Deltas are added to the location, multiplied into the scale, and turn
    after the rotation; parent_inverse is applied last.  Null deltas count for nothing.
    """
    there = set(objects.columns)
    place, turn, size = (F.col(c) for c in ("location", "rotation", "scale"))
    if "delta_location" in there:
        place = F.when(F.col("delta_location").isNull(), place).otherwise(F.zip_with(place, "delta_location", lambda a, b: a + b))
    if "delta_rotation" in there:
        turn = F.when(F.col("delta_rotation").isNull(), turn).otherwise(turned(turn, F.col("delta_rotation")))
    if "delta_scale" in there:
        size = F.when(F.col("delta_scale").isNull(), size).otherwise(F.zip_with(size, "delta_scale", lambda a, b: a * b))
    made = objects.withColumn("matrix", composed(place, turn, size))
    if "parent_inverse" in there:
        made = made.withColumn("matrix", F.when(F.col("parent_inverse").isNull(), F.col("matrix")).otherwise(product(F.col("parent_inverse"), F.col("matrix"))))
    return made


def world_matrices(objects: DataFrame) -> DataFrame:
    """(name, world) of objects (name, parent, matrix), by pointer doubling.

    In each round an object's matrix takes in that of the ancestor it points
    to, and it points to where that one points, so a tree of depth d takes
    log2(d) joins.  A parent that is no object, or null, ends a chain; a name
    that comes twice, or a cycle, is an error.
    """
    rows = objects.select("name", F.col("parent").alias("up"), F.col("matrix").cast(_MATRIX).alias("world"))
    here = rows.select(F.col("name").alias("up"), F.lit(True).alias("there"))
    rows = kept(rows.join(here, "up", "left").select("name", F.when(F.col("there"), F.col("up")).alias("up"), "world"))
    size, names = rows.agg(F.count(F.lit(1)), F.count_distinct("name")).first()
    if names < size:
        raise ValueError("an object's name is missing or comes twice")
    for _ in range(max(1, size).bit_length() + 1):
        if rows.filter("up is not null").isEmpty():
            return rows.select("name", "world")
        above = rows.select(F.col("name").alias("up"), F.col("up").alias("top"), F.col("world").alias("over"))
        rows = kept(rows.join(above, "up", "left").select("name", F.col("top").alias("up"), F.when(F.col("over").isNull(), F.col("world")).otherwise(product(F.col("over"), F.col("world"))).alias("world")), done=rows)
    raise ValueError("parents form a cycle")


def absorbed(objects: DataFrame, chosen: Column, unparent: bool = True) -> DataFrame:
    """(name, parent, matrix, world) of objects as for ``local_matrices``, with the deltas of the chosen ones gone into their matrices.

    With ``unparent`` the chosen ones have no parent afterwards; otherwise they
    keep it, and its inverse.  ``matrix`` is what stands in relation to the
    parent, or to the parent's inverse where the object has one.  No object's
    world matrix changes, those of the children of the chosen ones included.
    """
    made = local_matrices(objects).withColumn("__chosen", F.coalesce(chosen, F.lit(False)))
    worlds = world_matrices(made)
    above = worlds.select(F.col("name").alias("parent"), F.col("world").alias("__over"))
    held = made.join(worlds, "name").join(above, "parent", "left")
    over = F.coalesce("__over", identity())
    if "parent_inverse" in objects.columns:
        over = F.when(F.col("parent_inverse").isNull(), over).otherwise(product(over, F.col("parent_inverse")))
        base = F.when(F.col("parent_inverse").isNull(), F.col("matrix")).otherwise(product(inverse(F.col("parent_inverse")), F.col("matrix")))
    else:
        base = F.col("matrix")
    if unparent:
        return held.select("name", F.when(~F.col("__chosen"), F.col("parent")).alias("parent"), F.when(F.col("__chosen"), F.col("world")).otherwise(base).alias("matrix"), "world")
    return held.select("name", "parent", F.when(F.col("__chosen"), product(inverse(over), F.col("world"))).otherwise(base).alias("matrix"), "world")
