"""Whitening of embeddings by principal components from an exact characteristic polynomial.

Components of vectors become integers, so that count, sums and products over the distinct vectors are exact integers, and
so is the scatter matrix M = n * sum(x x') - S S', which is n * n times the covariance.  Its characteristic polynomial is
computed modulo as many 31-bit primes as its coefficients need (Hessenberg form, one prime a row of a Spark job) and
put together by Chinese remainders.  All roots are real, so the sign changes of the polynomial moved by a count
the roots above a exactly, equal roots included: that isolates the largest roots, which are then bisected to
192 bits.  A component is the null space of M - root * I, found by inverse iteration in decimals of 100 digits.

Only these parameters (d * d integers for vectors of length d) meet on the driver; vectors never do.
"""

from __future__ import annotations

import decimal
import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.base import batch, prepare, query, table, written

SCALE = 256  # an entry c becomes floor(256 * c)
COMPONENTS = 4
LIMB = 20  # bits of an entry that are multiplied at once, so that products add up exactly in doubles
EXACT_ROWS = 1 << (53 - 2 * LIMB)
ROOT_BITS = 192  # relative precision of roots
DIGITS = 100
ROUNDS = 3  # of inverse iteration
PRIMES_EACH = 8  # primes of a task

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_text string"


class Whitening(NamedTuple):
    """Fitted parameters: ``n`` vectors, their sums, unit components (d, k), eigenvalues of the covariance and their shares."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    shares: np.ndarray


def _finite(vectors: DataFrame) -> DataFrame:
    rows = prepare(vectors, "vec_id", "embedding").where("embedding IS NOT NULL")
    rows = rows.select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return rows.where(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))


def _integers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lists of doubles -> all floor(256 c) in a row, and the length of each list."""
    lengths = np.diff(column.offsets.to_numpy())
    scaled = np.floor(SCALE * column.flatten().to_numpy(zero_copy_only=False))
    high = scaled >= 2.0**63
    whole = np.clip(np.where(high, 0, scaled), -(2.0**63), None).astype(np.int64)
    whole[high] = np.iinfo(np.int64).max
    return whole, lengths


def _matrix(whole: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` integers: entries that a row does not have are 0, further ones (zeros in every row) are cut off."""
    out = np.zeros((len(lengths), max(width, int(lengths.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1]) < lengths[:, None]] = whole
    return out[:, :width]


def _keys(batches):
    """Each vector's integers as bytes without zeros at the end, so that equal vectors have equal bytes."""
    for b in batches:
        whole, lengths = _integers(b.column(0))
        data, ends = whole.astype("<i8").tobytes(), 8 * np.cumsum(lengths)
        yield batch(x=pa.array([data[e - 8 * n : e].rstrip(b"\0") for e, n in zip(ends.tolist(), lengths.tolist())], pa.binary()))


def _decoded(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    width = max((-(-len(r) // 8) for r in rows), default=0)
    return np.frombuffer(b"".join(r.ljust(8 * width, b"\0") for r in rows), "<i8").reshape(len(rows), width)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    """Arrays of doubles below 2 ** 20 in size with x = sum(limb[k] * 2 ** (20 k))."""
    limbs = []
    while x.size and (x.max() >= 1 << LIMB or x.min() <= -(1 << LIMB)):
        limbs.append((x & ((1 << LIMB) - 1)).astype(np.float64))
        x = x >> LIMB
    return [*limbs, x.astype(np.float64)]


def _moments(batches):
    """Distinct vectors -> sums of a task: cell (-1, -1) the count, (-1, j) the sum, (i, j) the sum of products, times 2 ** shift."""
    held: dict[tuple[int, int], np.ndarray] = {}
    count = 0

    def add(key, values):
        old = held.get(key)
        if old is None or old.shape != values.shape:
            fresh = np.zeros(np.maximum(old.shape, values.shape) if old is not None else values.shape, np.int64)
            if old is not None:
                fresh[tuple(slice(s) for s in old.shape)] = old
            held[key] = old = fresh
        old[tuple(slice(s) for s in values.shape)] += values

    def rows():
        for (kind, shift), values in held.items():
            i, j = np.nonzero(values)
            cells = values[i, j]
            own = np.full(len(i), -1) if kind else i
            for part, by in ((cells & 0xFFFFFFFF, 0), (cells >> 32, 32)):
                yield batch(i=pa.array(own, pa.int32()), j=pa.array(j, pa.int32()), shift=pa.array(np.full(len(i), shift + by), pa.int32()), value=part)
        held.clear()

    since = 0
    for b in batches:
        every = _decoded(b.column(0))
        count += len(every)
        for at in range(0, len(every), EXACT_ROWS):
            limbs = _limbs(every[at : at + EXACT_ROWS])
            for p, left in enumerate(limbs):
                add((1, LIMB * p), left.sum(axis=0, keepdims=True).astype(np.int64))
                for q, right in enumerate(limbs):
                    add((0, LIMB * (p + q)), np.triu((left.T @ right).astype(np.int64)))
            since += 1
            if since == 1 << 8:  # well below the range of a long
                yield from rows()
                since = 0
    yield from rows()
    yield batch(i=pa.array([-1], pa.int32()), j=pa.array([-1], pa.int32()), shift=pa.array([0], pa.int32()), value=[count])


def scatter(fit: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and the integer scatter matrix of the distinct vectors (``x`` binary)."""
    cells = fit.mapInArrow(_moments, "i int, j int, shift int, value long").groupBy("i", "j", "shift").agg(F.sum("value").alias("value"))
    rows = cells.toArrow()
    i, j, shift, value = (rows.column(k).to_pylist() for k in range(4))
    width = max(j, default=-1) + 1
    n, sums, products = 0, [0] * width, np.zeros((width, width), object)
    for a, b, s, v in zip(i, j, shift, value):
        if b < 0:
            n += v
        elif a < 0:
            sums[b] += v << s
        else:
            products[a, b] += v << s
    products += np.triu(products, 1).T
    own = np.array(sums, object)
    return n, sums, n * products - np.outer(own, own)


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every number below 2 ** 31."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """The largest primes below 2 ** 31 whose product exceeds ``bound``."""
    found, product, p = [], 1, 2**31 - 1
    while product <= bound:
        if is_prime(p):
            found.append(p)
            product *= p
        p -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Characteristic polynomial modulo a prime, highest power first: reduction to Hessenberg form, then its recurrence."""
    h, d = matrix.copy(), len(matrix)
    for m in range(1, d - 1):
        below = np.flatnonzero(h[m:, m - 1])
        if not len(below):
            continue
        k = m + below[0]
        if k != m:
            h[[m, k]] = h[[k, m]]
            h[:, [m, k]] = h[:, [k, m]]
        u = h[m + 1 :, m - 1] * pow(int(h[m, m - 1]), -1, p) % p
        h[m + 1 :] = (h[m + 1 :] - u[:, None] * h[m] % p) % p
        h[:, m] = (h[:, m] + (h[:, m + 1 :] * u % p).sum(axis=1)) % p
    parts = np.zeros((d + 1, d + 1), np.int64)  # of the leading blocks, lowest power first
    parts[0, 0] = 1
    for k in range(1, d + 1):
        factors, run = np.zeros(k, np.int64), 1
        for i in range(k - 1, -1, -1):
            factors[i] = run * int(h[i, k - 1]) % p
            if i:
                run = run * int(h[i, i - 1]) % p
        parts[k, 1:] = parts[k - 1, :-1]
        parts[k] = (parts[k] - (factors[:, None] * parts[:k] % p).sum(axis=0)) % p
    return parts[d, ::-1].tolist()


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Integer coefficients, highest power first, of a positive semidefinite integer matrix; one prime a row of the job."""
    d, trace = len(matrix), int(np.trace(matrix))
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))  # no elementary symmetric function is larger
    primes = primes_for(2 * bound)
    shared = spark.sparkContext.broadcast(matrix)

    def reduced(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                own = (shared.value % p).astype(np.int64)
                yield batch(p=[p], residues=pa.array([polynomial_modulo(own, p)], pa.list_(pa.int64())))

    tasks = -(-len(primes) // PRIMES_EACH)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(reduced, "p long, residues array<long>").collect()
    shared.destroy()
    found, product = [0] * (d + 1), 1
    for r in sorted(rows):
        inverse = pow(product, -1, r.p)
        found = [x + product * ((y - x) * inverse % r.p) for x, y in zip(found, r.residues)]
        product *= r.p
    return [x - product if 2 * x > product else x for x in found]


def roots_above(polynomial: list[int], a: int, bits: int) -> int:
    """How many roots of a polynomial whose roots are all real exceed a / 2 ** bits, equal ones counted each."""
    c = [x << (bits * k) for k, x in enumerate(polynomial)]
    for stop in range(len(c), 1, -1):  # the coefficients of p(y + a)
        for k in range(1, stop):
            c[k] += a * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(s != t for s, t in zip(signs, signs[1:]))


def _sign(polynomial: list[int], a: int, bits: int) -> int:
    value = 0
    for k, x in enumerate(polynomial):
        value = value * a + (x << (bits * k))
    return (value > 0) - (value < 0)


def largest_roots(polynomial: list[int], count: int, top: int) -> list[tuple[int, int, int]]:
    """The ``count`` largest positive roots with repeats, falling: (a, bits, number) with a / 2 ** bits < root <= (a + 1) / 2 ** bits.

    ``top`` is a bound of all roots; ``number`` tells the roots that share the interval, which then counts as one.
    """
    count = min(count, roots_above(polynomial, 0, 0))
    seen: dict[tuple[int, int], int] = {}

    def above(a: int, bits: int) -> int:
        while bits and a % 2 == 0:
            a, bits = a // 2, bits - 1
        if (a, bits) not in seen:
            seen[a, bits] = roots_above(polynomial, a, bits)
        return seen[a, bits]

    found: list[tuple[int, int, int]] = []
    while len(found) < count:
        k = len(found) + 1
        low, width, bits = 0, 1 << max(1, top.bit_length()), 0  # the root lies in (low, low + width]
        many, few = above(low, 0), above(width, 0)
        while width > 1 or not low or low.bit_length() < ROOT_BITS:
            if width == 1:
                low, width, bits = 2 * low, 2, bits + 1
            middle = low + width // 2
            if many - few == 1:
                # One simple root: the polynomial changes sign there, and above it has the sign (-1) ** few.
                sign = _sign(polynomial, middle, bits)
                right = sign == (1 if many % 2 == 0 else -1)
            else:
                n = above(middle, bits)
                right = n >= k
                many, few = (n, few) if right else (many, n)
            if right:
                low = middle
            width //= 2
        found += [(low, bits, many - few)] * (many - few)
    return found[:count]


def null_vectors(matrix: np.ndarray, root: decimal.Decimal, number: int) -> list[np.ndarray]:
    """``number`` orthonormal vectors that ``matrix - root * I`` sends nearly to nothing, by inverse iteration."""
    d = len(matrix)
    with decimal.localcontext(prec=DIGITS):
        a = np.array([[decimal.Decimal(int(x)) for x in row] for row in matrix], object)
        a[np.diag_indices(d)] -= root
        tiny = max(abs(root), decimal.Decimal(1)) * decimal.Decimal(10) ** (5 - DIGITS)
        order = np.arange(d)
        for k in range(d):  # factors with row exchanges, in place
            pivot = k + max(range(d - k), key=lambda i: abs(a[k + i, k]))
            a[[k, pivot]], order[[k, pivot]] = a[[pivot, k]], order[[pivot, k]]
            if abs(a[k, k]) < tiny:
                a[k, k] = tiny
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        found: list[np.ndarray] = []
        draw = np.random.default_rng(12)
        for _ in range(number):
            v = np.array([decimal.Decimal(int(x)) for x in draw.integers(1, 1 << 30, d)], object)
            for _ in range(ROUNDS):
                v = v[order]
                for k in range(d):
                    v[k] -= a[k, :k].dot(v[:k]) if k else 0
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (a[k, k + 1 :].dot(v[k + 1 :]) if k + 1 < d else 0)) / a[k, k]
                v = v / max(abs(x) for x in v)
                for w in found:
                    v = v - w.dot(v) * w
                v = v / v.dot(v).sqrt()
            found.append(v)
    return found


def fit_whitening(spark: SparkSession, fit: DataFrame, count: int = COMPONENTS) -> Whitening | None:
    """Parameters from distinct vectors (``x`` binary); None where no component has a positive eigenvalue."""
    n, sums, m = scatter(fit)
    if not m.any():
        return None
    shared = math.gcd(*(int(x) for x in m.ravel()))
    m //= shared
    trace = int(np.trace(m))
    intervals = largest_roots(characteristic_polynomial(spark, m), count, trace)
    vectors, values, shares = [], [], []
    with decimal.localcontext(prec=DIGITS):
        for place, (a, bits, number) in enumerate(intervals):
            root = decimal.Decimal(2 * a + 1) / (decimal.Decimal(2) ** (bits + 1))
            if not place or intervals[place - 1] != intervals[place]:
                vectors += null_vectors(m, root, number)
            values.append(float(root * shared / n / n))
            shares.append(float(root / trace))
    unit = np.array([[float(x) for x in v] for v in vectors[: len(values)]]).T
    unit *= np.sign(unit[np.abs(unit).argmax(axis=0), np.arange(unit.shape[1])])
    return Whitening(n, sums, unit, np.array(values), np.array(shares))


def _projected(x: np.ndarray, model: Whitening) -> tuple[np.ndarray, np.ndarray]:
    """n x - S of each row (exact, as Python integers where longs would not do), and the whitened values."""
    n, sums = model.n, model.sums
    sizes = max(abs(s) for s in sums), max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    if (n * sizes[1] + sizes[0]) ** 2 * len(sums) < 2**63:
        away = n * x - np.array(sums, np.int64)
    else:
        away = n * x.astype(object) - np.array(sums, object)
    centred = (away / n).astype(np.float64)
    return away, centred @ model.components / np.sqrt(model.values)


def _whitened_keys(model: Whitening):
    width = len(model.sums)

    def whitened(batches):
        for b in batches:
            x = _decoded(b.column(0))
            _, w = _projected(np.pad(x, ((0, 0), (0, width - x.shape[1]))), model)
            yield batch(**{f"w{k}": np.ascontiguousarray(w[:, k]) for k in range(w.shape[1])})

    return whitened


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance (centred, divisor n) minus the identity."""
    k = len(model.values)
    w = fit.mapInArrow(_whitened_keys(model), ", ".join(f"w{i} double" for i in range(k)))
    row = w.agg(*[F.covar_pop(f"w{i}", f"w{j}").alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i, k))


def _rows(model: Whitening, error: float):
    width, k = len(model.sums), len(model.values)

    def rows(batches):
        for b in batches:
            whole, lengths = _integers(b.column(1))
            away, w = _projected(_matrix(whole, lengths, width), model)
            total = (away * away).sum(axis=1)
            fits = [int(t) if t < 2**63 else None for t in total.tolist()]
            each = np.repeat(np.arange(len(lengths)), k)
            yield batch(
                vec_id=b.column(0).take(pa.array(each)), component=pa.array(np.tile(np.arange(1, k + 1), len(lengths)), pa.int32()),
                n=np.full(len(each), model.n), deviation=pa.array(fits, pa.int64()).take(pa.array(each)), whitened=w.ravel(),
                explained=np.tile(model.shares, len(lengths)), identity_error=np.full(len(each), error),
                deviation_text=pa.array([str(t) for t in total.tolist()], pa.string()).take(pa.array(each)),
            )

    return rows


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Each vector's whitened coordinates on the first principal components of the distinct vectors.

    ``vectors``: ``vec_id`` long, ``embedding`` array of numbers; other columns are ignored.  Entries c become
    floor(256 c); vectors that are null or hold null or non-finite entries are dropped.  Rows, for each other vector
    and component: ``vec_id``, ``component`` from 1, ``n`` (distinct vectors), ``deviation`` (sum of (n x - S) ** 2; null beyond the
    range of a long), ``whitened``, ``explained``, ``identity_error``, ``deviation_text`` (the deviation's digits, whatever its size).

    Where lengths differ, missing entries count as 0.  A null id stays, and rows that repeat an id or a vector each have
    their rows; a vector counts once in the fit.  Only components with a positive eigenvalue exist: with fewer than
    two distinct vectors there are no rows.  Equal eigenvalues have any orthonormal vectors of their space.
    """
    spark = vectors.sparkSession
    rows = _finite(vectors)
    fit = written(rows.select("vector").mapInArrow(_keys, "x binary").distinct(), "distinct-vectors")
    model = fit_whitening(spark, fit, components)
    if model is None:
        return spark.createDataFrame([], RESULT)
    return rows.mapInArrow(_rows(model, identity_error(fit, model)), RESULT)


@query("op12_embedding_whitening")
def whitening_query(spark, folder: str) -> DataFrame:
    return whiten(table(spark, folder, "embeddings"))
