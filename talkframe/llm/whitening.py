"""Whitening of vectors from the exact characteristic polynomial of their covariance.

Components of vectors become integers, so that the scatter matrix is a matrix of integers and sums without rounding. Its
characteristic polynomial is found modulo many primes, each by reduction to Hessenberg form, and put together by the Chinese
remainder theorem. All roots are real: signs of shifted coefficients count the roots above any point exactly, which isolates them.
Components are null vectors, by inverse iteration in long decimals. Only matrices of the vectors' width, and one residue polynomial a
prime, pass the driver; vectors never do.
"""

from __future__ import annotations

import decimal
import random
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkframe.llm.storage import column, settle

#: Entries times this, rounded down, are the integers.
SCALE = 256
COMPONENTS = 4
#: Digits of the decimals that components are found in, and bits to which roots are isolated.
DIGITS, ROOT_BITS = 90, 160
#: Bits of a limb in which exact sums travel.
LIMB, LIMBS = 32, 6
_BELOW = 2**63


def integer_vectors(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """``(vec_id, x)``: the usable rows, each entry as ``floor(256 * c)``.

    Rows whose vector is null or empty, or holds null or non-finite entries, go. Entries whose integer needs more than 63 bits are held
    at that bound. All vectors of a table have the width that most have (the larger on ties); others go too.
    """
    usable = F.col(vector).isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    top = float(2**62)
    held = F.transform(vector, lambda c: F.floor(F.greatest(F.least(c.cast("double") * SCALE, F.lit(top)), F.lit(-top))).cast("bigint"))
    rows = embeddings.filter(usable).select(F.col("vec_id").cast("bigint").alias("vec_id"), held.alias("x"))
    widths = rows.groupBy(F.size("x").alias("width")).agg(F.count("*").alias("n")).agg(F.max(F.struct("n", "width")).alias("w")).first()["w"]
    return rows if widths is None else rows.filter(F.size("x") == widths["width"])


def _limbs(value: int) -> list[int]:
    """Signed limbs of an integer, lowest first; sums of limbs are the limbs of sums."""
    sign, value = (-1 if value < 0 else 1), abs(value)
    return [sign * ((value >> (LIMB * k)) & ((1 << LIMB) - 1)) for k in range(LIMBS)]


def _exact_product(rows: np.ndarray) -> list[list[int]]:
    """``rows.T @ rows`` of long rows, exactly."""
    big = int(np.abs(rows).max(initial=0))
    if big * big * len(rows) < 2**53:
        return np.rint(rows.astype(np.float64).T @ rows.astype(np.float64)).astype(np.int64).tolist()
    if big * big * len(rows) < _BELOW:
        return (rows.T @ rows).tolist()
    return (rows.astype(object).T @ rows.astype(object)).tolist()


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 4096):
            part = batch.slice(begin, 4096)
            yield part, column(part, "x").flatten().to_numpy().reshape(-1, width)


def scatter(vectors: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """``n``, the sums of all entries and the exact sums of products over the rows of ``x``."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, products = 0, np.zeros(width, object), np.zeros((width, width), object)
        for _, rows in _blocks(batches, width):
            n += len(rows)
            sums = sums + rows.astype(object).sum(axis=0)
            products = products + np.array(_exact_product(rows), object)
        if n:
            values = [n, *sums.tolist(), *products.ravel().tolist()]
            table = np.array([_limbs(int(v)) for v in values], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), *[pa.array(table[:, k]) for k in range(LIMBS)]], ["cell", *[f"l{k}" for k in range(LIMBS)]])

    names = [f"l{k}" for k in range(LIMBS)]
    parts = vectors.select("x").mapInArrow(add, "cell bigint, " + ", ".join(f"{x} bigint" for x in names))
    totals = parts.groupBy("cell").agg(*[F.sum(x).alias(x) for x in names]).collect()
    values = [0] * (1 + width + width * width)
    for row in totals:
        values[row["cell"]] = sum(row[x] << (LIMB * k) for k, x in enumerate(names))
    return values[0], values[1:1 + width], [values[1 + width * (i + 1):1 + width * (i + 2)] for i in range(width)]


def _prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # enough below 3 215 031 751
        if n == a:
            return True
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(s - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_below(bits: int, product: int) -> list[int]:
    """The largest primes below ``2**bits``, as many as it takes for their product to exceed ``product``."""
    found, held, p = [], 1, 2**bits - 1
    while held <= product:
        if _prime(p):
            found.append(p)
            held *= p
        p -= 2
    return found


def polynomial_modulo(matrix: list[list[int]], p: int) -> np.ndarray:
    """Coefficients of ``det(zI - matrix)`` modulo a prime below 2**31, constant first."""
    h = np.array([[v % p for v in row] for row in matrix], np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1:, k])
        if not len(below):
            continue
        pivot = k + 1 + int(below[0])
        if pivot != k + 1:
            h[[k + 1, pivot]] = h[[pivot, k + 1]]
            h[:, [k + 1, pivot]] = h[:, [pivot, k + 1]]
        u = h[k + 2:, k] * pow(int(h[k + 1, k]), -1, p) % p
        h[k + 2:] = (h[k + 2:] - u[:, None] * h[k + 1][None, :] % p) % p
        h[:, k + 1] = (h[:, k + 1] + (h[:, k + 2:] * u[None, :] % p).sum(axis=1)) % p
    known = np.zeros((d + 1, d + 1), np.int64)
    known[0, 0] = 1
    for m in range(1, d + 1):
        row = np.zeros(d + 1, np.int64)
        row[1:] = known[m - 1, :-1]
        factors, under = np.zeros(m, np.int64), 1
        for i in range(m - 1, -1, -1):
            factors[i] = int(h[i, m - 1]) * under % p
            if i:
                under = under * int(h[i, i - 1]) % p
        known[m] = (row - (factors[:, None] * known[:m] % p).sum(axis=0)) % p
    return known[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Exact coefficients of ``det(zI - matrix)``, constant first, of a positive semidefinite matrix of integers.

    The product of ``1 + root`` bounds every coefficient, and the trace bounds it. Each task takes a few primes.
    """
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    bound = (Fraction(trace, d) + 1) ** d
    primes = primes_below(31, 2 * int(bound) + 2)

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [polynomial_modulo(matrix, p).tolist() for p in column(batch, "p").to_pylist()]
            yield pa.RecordBatch.from_pydict({"p": column(batch, "p"), "c": pa.array(found, pa.list_(pa.int64()))})

    table = spark.createDataFrame([(p,) for p in primes], "p bigint").repartition(max(1, min(len(primes) // 4, 64)))
    rows = table.mapInArrow(residues, "p bigint, c array<bigint>").collect()
    whole, held = [0] * (d + 1), 1
    for p, found in rows:
        step = pow(held, -1, p)
        whole = [w + held * ((c - w) * step % p) for w, c in zip(whole, found)]
        held *= p
    return [w - held if w > held // 2 else w for w in whole]


def _above(polynomial: list[int], a: int, shift: int) -> int:
    """Roots greater than ``a / 2**shift`` of a polynomial whose roots are all real, with multiplicity.

    The signs of the coefficients around that point change once for each such root.
    """
    d = len(polynomial) - 1
    c = [v << (shift * (d - i)) for i, v in enumerate(polynomial)]  # roots times 2**shift
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(polynomial: list[int], count: int, bits: int = ROOT_BITS) -> list[Fraction]:
    """The ``count`` largest roots, repeated ones several times, to about ``bits`` bits of the largest.

    Halving with exact counts isolates each root; its interval is then halved further by the polynomial's sign.
    """
    d = len(polynomial) - 1
    reach = max(1, -polynomial[d - 1])  # the trace
    top = reach.bit_length()
    shift = max(0, bits - top)

    def value_sign(a: int) -> int:
        v = 0
        for i in range(d, -1, -1):
            v = v * a + (polynomial[i] << (shift * (d - i)))
        return (v > 0) - (v < 0)

    roots: list[Fraction] = []
    stack = [(0, 1 << (top + shift), _above(polynomial, 0, shift), 0)]
    while stack and len(roots) < count:
        low, high, over_low, over_high = stack.pop()
        inside = over_low - over_high
        if not inside:
            continue
        if high - low == 1:
            roots += [Fraction(2 * low + 1, 1 << (shift + 1))] * inside
            continue
        if inside == 1 and value_sign(high) and value_sign(low):
            up = value_sign(high)
            while high - low > 1:
                mid = (low + high) // 2
                s = value_sign(mid)
                if s == up:
                    high = mid
                else:
                    low = mid
                    if s == 0:
                        break
            roots.append(Fraction(2 * low + 1, 1 << (shift + 1)))
            continue
        mid = (low + high) // 2
        over = _above(polynomial, mid, shift)
        stack += [(low, mid, over_low, over), (mid, high, over, over_high)]
    return sorted(roots, reverse=True)[:count]


def null_vectors(matrix: list[list[int]], roots: list[Fraction], rounds: int = 4) -> list[list[decimal.Decimal]]:
    """A unit vector for each root, by inverse iteration; those of one repeated root are made orthogonal."""
    d = len(matrix)
    with decimal.localcontext() as context:
        context.prec = DIGITS
        exact = [[decimal.Decimal(v) for v in row] for row in matrix]
        source = random.Random(7)
        found: list[list[decimal.Decimal]] = []
        for root in roots:
            # A little off the root, so that the last pivot is small and not zero.
            shift = (decimal.Decimal(root.numerator) / decimal.Decimal(root.denominator)) * (1 + decimal.Decimal(10) ** (-DIGITS // 2))
            rows = [[v - shift if i == j else v for j, v in enumerate(row)] for i, row in enumerate(exact)]
            swaps = list(range(d))
            for k in range(d):
                best = max(range(k, d), key=lambda i: abs(rows[i][k]))
                rows[k], rows[best] = rows[best], rows[k]
                swaps[k], swaps[best] = swaps[best], swaps[k]
                pivot = rows[k][k]
                if not pivot:
                    continue
                for i in range(k + 1, d):
                    if rows[i][k]:
                        f = rows[i][k] / pivot
                        rows[i] = [*rows[i][:k], f, *[a - f * b for a, b in zip(rows[i][k + 1:], rows[k][k + 1:])]]
            least = abs(shift) * decimal.Decimal(10) ** (-DIGITS) + decimal.Decimal(10) ** (-DIGITS)
            v = [decimal.Decimal(source.randint(1, 10**6)) for _ in range(d)]
            for _ in range(rounds):
                v = [v[i] for i in swaps]
                for i in range(d):
                    v[i] -= sum((rows[i][j] * v[j] for j in range(i)), decimal.Decimal(0))
                for i in range(d - 1, -1, -1):
                    v[i] = (v[i] - sum((rows[i][j] * v[j] for j in range(i + 1, d)), decimal.Decimal(0))) / (rows[i][i] or least)
                for other in found:
                    along = sum((a * b for a, b in zip(v, other)), decimal.Decimal(0))
                    v = [a - along * b for a, b in zip(v, other)]
                norm = sum((a * a for a in v), decimal.Decimal(0)).sqrt()
                v = [a / norm for a in v]
            found.append(v)
        return found


def whiten(embeddings: DataFrame, components: int = COMPONENTS, vector: str = "embedding") -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` of every usable row.

    Means and covariance are those of the distinct integer vectors. There are as many components as the covariance has positive
    roots, ``components`` at most; none at all where all vectors are equal. ``deviation`` is null where it needs more than 63 bits. Rows
    with a missing or repeated ``vec_id`` are all kept; other columns are not read. An empty table gives no rows.
    """
    spark = embeddings.sparkSession
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    rows = integer_vectors(embeddings.select("vec_id", vector), vector)
    fit = settle(rows.select("x").distinct(), "whitening-fit")
    first = fit.first()
    if first is None:
        return spark.createDataFrame([], schema)
    width = len(first["x"])
    n, sums, products = scatter(fit, width)
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(width)] for i in range(width)]  # n * n * covariance
    trace = sum(matrix[i][i] for i in range(width))
    if not trace:
        return spark.createDataFrame([], schema)
    polynomial = characteristic_polynomial(spark, matrix)
    positive = _above(polynomial, 0, 0)
    roots = largest_roots(polynomial, min(components, positive, width))
    axes = np.array([[float(a) for a in v] for v in null_vectors(matrix, roots)])
    deviation = np.array([float(r) ** 0.5 for r in roots])  # n times that of the covariance
    explained = [float(r / trace) for r in roots]
    count = len(roots)

    def turned(x: np.ndarray) -> tuple[np.ndarray, list[int | None]]:
        big = int(np.abs(x).max(initial=0))
        if (big * n + max(abs(s) for s in sums)) ** 2 * width < _BELOW:
            centred = x * n - np.array(sums, np.int64)
            squares = (centred * centred).sum(axis=1).tolist()
        else:
            centred = x.astype(object) * n - np.array(sums, object)
            squares = [s if s < _BELOW else None for s in (centred * centred).sum(axis=1).tolist()]
        return centred.astype(np.float64) @ axes.T / deviation, squares

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x in _blocks(batches, width):
            y, _ = turned(x)
            yield pa.RecordBatch.from_arrays([pa.array(list(y), pa.list_(pa.float64()))], ["y"])

    # Centred before multiplying: first the means of the whitened rows, then their products.
    y = settle(fit.mapInArrow(moments, "y array<double>"), "whitened-fit")
    means = y.agg(*[F.avg(F.col("y")[i]).alias(f"m{i}") for i in range(count)]).first()
    pairs = [(i, j) for i in range(count) for j in range(i, count)]
    cells = y.agg(*[F.avg((F.col("y")[i] - means[i]) * (F.col("y")[j] - means[j])).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(cells[f"c{i}_{j}"] - (i == j)) for i, j in pairs)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            y, squares = turned(x)
            m = len(x)
            yield pa.RecordBatch.from_arrays([
                column(part, "vec_id").take(pa.array(np.repeat(np.arange(m), count))),
                pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), m)),
                pa.array(np.full(m * count, n, np.int64)),
                pa.array([s for s in squares for _ in range(count)], pa.int64()),
                pa.array(y.ravel()),
                pa.array(np.tile(np.array(explained), m)),
                pa.array(np.full(m * count, error)),
            ], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(apply, schema)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Four whitened components of every usable vector of ``embeddings``."""
    return whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
