"""Embedding whitening through the exact characteristic polynomial of the scatter.

Entries are whole numbers, so the scatter n * sum(y y') - S S' (n^2 times the
covariance) is summed exactly. Its characteristic polynomial is found modulo
many primes, each by reduction to Hessenberg form, the primes spread over
tasks; Chinese remaindering gives the whole coefficients, of which Maclaurin's
inequality bounds the size beforehand. All roots are real, so the sign changes
of the coefficients shifted by a count the roots above a, repeated ones too.
That isolates the roots by bisection, and quadratic interval refinement takes
each to the working precision. The components are null vectors of A - root,
by inverse iteration in whole-number arithmetic of the same precision, one
root to a task, and are rounded to double only then.

What the driver holds is bounded by the number of dimensions: the scatter, the
polynomial, the components. Rows are read twice: for the scatter, and for the
projection, which is written once.

Defined cases
  null vector, null or non-finite entry   the row is dropped
  vectors of different lengths   the shorter is filled with entries 0
  empty vectors      of dimension 0; alone they give an empty result
  null id            kept, like any other row
  repeated rows      each counts and each is returned
  constant dimensions, fewer rows than dimensions   roots that are exactly 0 give no component
  equal roots        an orthonormal basis of their space, one component each
  one row, empty table   an empty result
  entries beyond 2^62 after scaling   ArithmeticError: they are no long
  other columns      are not read
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import accumulate
from math import comb, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deficit_engine.llm.common import Scratch, ship_package
from deficit_engine.llm.exact_topk import usable
from deficit_engine.llm.units import hold_caches

COMPONENTS = 32
PRIMES_PER_TASK = 12
GUARD_BITS = 128        # beyond the distance at which the roots part
SLICE_ROWS = 4096


# --- the polynomial -----------------------------------------------------------

def primes_below(top: int) -> Iterator[int]:
    """Primes in falling order (Miller-Rabin with these bases is exact below 3.2e9)."""
    def is_prime(n: int) -> bool:
        odd, twos = n - 1, 0
        while odd % 2 == 0:
            odd, twos = odd // 2, twos + 1
        for base in (2, 3, 5, 7):
            x = pow(base, odd, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
                return False
        return True
    yield from (n for n in range(top - 1 - top % 2, 10, -2) if is_prime(n))


def _inverse(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """x^(p-2) mod p, elementwise; 0 stays 0."""
    out, power, square = np.ones_like(x), p - 2, x % p
    while power.any():
        out = np.where(power & 1, out * square % p, out)
        square = square * square % p
        power = power >> 1
    return out


def polynomial_mod(a: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Coefficients (highest first) of det(x - a) modulo each prime; ``a`` holds
    one residue matrix per prime."""
    d = a.shape[1]
    p1, p2 = p[:, None], p[:, None, None]
    each = np.arange(len(p))
    for k in range(d - 2):
        at = (a[:, k + 1:, k] != 0).argmax(1) + k + 1
        a[each, k + 1], a[each, at] = a[each, at].copy(), a[each, k + 1].copy()
        a[each, :, k + 1], a[each, :, at] = a[each, :, at].copy(), a[each, :, k + 1].copy()
        f = a[:, k + 2:, k] * _inverse(a[:, k + 1, k], p)[:, None] % p1
        a[:, k + 2:] = (a[:, k + 2:] - f[:, :, None] * a[:, None, k + 1]) % p2
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2:] * f[:, None, :] % p2).sum(2)) % p1
    # leading minors of the Hessenberg form, lowest coefficient first
    minors = np.zeros((d + 1, len(p), d + 1), np.int64)
    minors[0, :, 0] = 1
    for k in range(1, d + 1):
        new = np.roll(minors[k - 1], 1, axis=1) - a[:, k - 1, k - 1, None] * minors[k - 1] % p1
        below = np.ones(len(p), np.int64)
        for i in range(1, k):
            below = below * a[:, k - i, k - i - 1] % p
            new -= (a[:, k - i - 1, k - 1] * below % p)[:, None] * minors[k - i - 1] % p1
        minors[k] = new % p1
    return minors[d][:, ::-1]


def _residues(matrix: list[list[int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("whitening")
        whole = np.array(matrix, object)
        for batch in batches:
            p = batch.column("prime").to_numpy().astype(np.int64)
            if len(p):
                found = polynomial_mod(np.stack([(whole % int(q)).astype(np.int64) for q in p]), p)
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32), pa.array(found.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column("prime"), lists], ["prime", "residues"])
    return run


def coefficient_bound(matrix: list[list[int]]) -> int:
    """No coefficient of a positive semi-definite matrix is larger: e_k <= C(d, k) (trace / d)^k."""
    d = len(matrix)
    trace = sum(matrix[i][i] for i in range(d))
    return max(comb(d, k) * (-(-trace // d)) ** k for k in range(d + 1))


def remainder_theorem(primes: list[int], residues: list[list[int]]) -> list[int]:
    """The whole numbers of least size with these residues, position by position."""
    product = 1
    for p in primes:
        product *= p
    parts = [(product // p) * pow(product // p, -1, p) for p in primes]
    found = [sum(r * m for r, m in zip(column, parts)) % product for column in zip(*residues)]
    return [x - product if 2 * x > product else x for x in found]


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), highest first; the primes are dealt over tasks."""
    need, primes, product = 2 * coefficient_bound(matrix) + 1, [], 1
    for p in primes_below(1 << 31):
        if product >= need:
            break
        primes.append(p)
        product *= p
    tasks = -(-len(primes) // PRIMES_PER_TASK)
    rows = spark.createDataFrame([(p,) for p in primes], "prime long").repartition(tasks)
    found = rows.mapInArrow(_residues(matrix), "prime long, residues array<long>").collect()
    return remainder_theorem([r["prime"] for r in found], [list(r["residues"]) for r in found])


# --- its roots -----------------------------------------------------------------

def roots_above(poly: list[int], num: int, s: int) -> int:
    """How many roots of a polynomial with real roots only lie above num / 2^s (Descartes' rule, exact here)."""
    c = [v << (s * i) for i, v in enumerate(poly)]
    for stop in range(len(c), 1, -1):
        c[:stop] = accumulate(c[:stop], lambda x, y: x * num + y)
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def value(poly: list[int], num: int, s: int) -> int:
    """2^(s * degree) * poly(num / 2^s)."""
    out, shift = 0, 0
    for v in poly:
        out = out * num + (v << shift)
        shift += s
    return out


def _gcd_mod(f: list[int], g: list[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo a prime."""
    f, g = [x % p for x in f], [x % p for x in g]
    while g and not all(x == 0 for x in g):
        while g[0] == 0:
            g = g[1:]
        inv = pow(g[0], -1, p)
        g = [x * inv % p for x in g]
        f = f[:]
        while len(f) >= len(g):
            lead = f[0]
            f = [(x - lead * y) % p for x, y in zip(f, g + [0] * (len(f) - len(g)))][1:]
        f, g = g, f
    return f


def squarefree(poly: list[int]) -> list[int]:
    """The polynomial with each root once. The divisor shared with the
    derivative is monic and whole, so it is put together from its residues."""
    d = len(poly) - 1
    slope = [v * (d - i) for i, v in enumerate(poly[:-1])]
    primes, residues, before = [], [], None
    for p in primes_below(1 << 31):
        if p <= d:
            continue
        found = _gcd_mod(poly, slope, p)
        if len(found) == 1:
            return poly
        if residues and len(found) > len(residues[0]):
            continue            # an unlucky prime
        if residues and len(found) < len(residues[0]):
            primes, residues, before = [], [], None
        primes.append(p)
        residues.append(found)
        shared = remainder_theorem(primes, residues)
        if shared == before:
            rest, out = poly[:], []
            for _ in range(d - len(shared) + 2):
                lead = rest[0]
                out.append(lead)
                rest = [x - lead * y for x, y in zip(rest, shared + [0] * (len(rest) - len(shared)))][1:]
            if not any(rest):
                return out
        before = shared


def isolate(poly: list[int], top: int) -> list[tuple[int, int, int]]:
    """Intervals (low, high] / 2^s, falling, each with one root in (0, top] of a
    polynomial whose roots are real and distinct."""
    found = []
    todo = [(0, top, 0, roots_above(poly, 0, 0), 0)]
    while todo:
        low, high, s, above_low, above_high = todo.pop()
        count = above_low - above_high
        if count == 1:
            found.append((low, high, s))
        elif count > 1:
            if high - low < 2:
                low, high, s = low << 8, high << 8, s + 8
            middle = (low + high) // 2
            above = roots_above(poly, middle, s)
            todo.append((low, middle, s, above_low, above))
            todo.append((middle, high, s, above, above_high))
    return found


def refine(poly: list[int], low: int, high: int, s: int, to: int) -> int:
    """The root in (low, high] / 2^s as a multiple of 2^-to. Quadratic interval
    refinement: the interval is cut into 2^pieces, and the chord tells the piece
    to try; a hit doubles ``pieces``, a miss halves it."""
    low, high = low << (to - s), high << (to - s)
    at_low, at_high = value(poly, low, to), value(poly, high, to)
    if at_high == 0:
        return high
    pieces = 1
    while high - low > 1:
        width = high - low
        if pieces > 1 and at_low and (at_low > 0) != (at_high > 0):
            step = max(1, width >> pieces)
            guess = low + min(width * abs(at_low) // abs(at_high - at_low) // step * step, width - step)
        else:       # a root of its own may lie at the open end
            step = (width + 1) // 2
            guess = low + step
        for x in (guess, guess + step):
            if low < x < high:
                here = value(poly, x, to)
                if here == 0:
                    return x
                if (here > 0) == (at_high > 0):
                    high, at_high = x, here
                else:
                    low, at_low = x, here
        pieces = pieces * 2 if high - low <= step else max(1, pieces // 2)
    return high


class Spectrum:
    """Roots of the characteristic polynomial above 0, falling: (multiple of 2^-bits, how often)."""

    def __init__(self, poly: list[int], trace: int):
        while len(poly) > 1 and poly[-1] == 0:
            poly = poly[:-1]
        self.roots: list[tuple[int, int]] = []
        self.bits = GUARD_BITS
        if len(poly) < 2:
            return
        single = squarefree(poly)
        ranges = isolate(single, 1 << (trace.bit_length() + 1))
        self.bits = max(s for _, _, s in ranges) + GUARD_BITS
        ranges.sort(key=lambda r: r[1] << (self.bits - r[2]), reverse=True)
        for low, high, s in ranges:
            often = 1 if single is poly else roots_above(poly, low, s) - roots_above(poly, high, s)
            self.roots.append((refine(single, low, high, s, self.bits), often))


# --- its components ----------------------------------------------------------

def null_vectors(matrix: list[list[int]], root: int, bits: int, count: int) -> list[list[float]]:
    """``count`` orthonormal vectors of the null space of matrix - root, by inverse
    iteration in fixed point with ``bits`` binary places."""
    d = len(matrix)
    lu = np.array([[x << bits for x in row] for row in matrix], object).reshape(d, d)
    for i in range(d):
        lu[i, i] -= root
    order = list(range(d))
    for k in range(d):
        at = max(range(k, d), key=lambda i: abs(lu[i, k]))
        if at != k:
            lu[[k, at]] = lu[[at, k]]
            order[k], order[at] = order[at], order[k]
        if lu[k, k] == 0:
            lu[k, k] = 1        # the last place: an exact root leaves nothing
        if k + 1 < d:
            f = np.array([(int(x) << bits) // lu[k, k] for x in lu[k + 1:, k]], object)
            lu[k + 1:, k] = f
            lu[k + 1:, k + 1:] -= (f[:, None] * lu[k, k + 1:][None, :]) >> bits
    one = 1 << bits
    # start: whole numbers that follow a fixed rule, different for each vector
    vectors = [np.array([(((i + 1) * 2654435761 * (2 * j + 3) ** 2) % 1000003 - 500001) * one // 1000003 for i in range(d)], object)
               for j in range(count)]
    for _ in range(3):
        done: list[np.ndarray] = []
        for b in vectors:
            x = b[order].copy()
            for k in range(d - 1):
                x[k + 1:] -= (lu[k + 1:, k] * x[k]) >> bits
            for k in range(d - 1, -1, -1):
                x[k] = (int(x[k]) << bits) // lu[k, k]
                if k:
                    x[:k] -= (lu[:k, k] * x[k]) >> bits
            for _ in range(2):      # twice: what rounding leaves of the others goes too
                x = _unit(x, bits)
                for other in done:
                    x = x - ((other * (int((x * other).sum()) >> bits)) >> bits)
            done.append(_unit(x, bits))
        vectors = done
    out = []
    for x in vectors:
        sign = 1 if max(x, key=abs) > 0 else -1
        out.append([sign * int(v) / one for v in x])
    return out


def _unit(x: np.ndarray, bits: int) -> np.ndarray:
    length = isqrt(int((x * x).sum())) or 1
    return np.array([(int(v) << bits) // length for v in x], object)


def _components(matrix: list[list[int]], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("whitening")
        for batch in batches:
            for first, root, often in zip(*(batch.column(c).to_pylist() for c in ("first", "root", "often"))):
                found = null_vectors(matrix, int(root), bits, often)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(first, first + often), pa.int32()), pa.array(found, pa.list_(pa.float64()))], ["component", "vector"])
    return run


# --- rows -----------------------------------------------------------------------

def _whole(lists: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * entry) of every vector of a batch, short ones filled with zeros."""
    flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * scale)
    if len(flat) and np.abs(flat).max() >= 2.0 ** 62:
        raise ArithmeticError("an entry is too large for a long")
    ends = np.asarray(lists.offsets)
    sizes = np.diff(ends)
    out = np.zeros((len(lists), int(sizes.max(initial=0))), np.int64)
    rows = np.repeat(np.arange(len(lists)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y' y in whole numbers."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        x = y.astype(np.float64)
        return (x.T @ x).astype(np.int64).astype(object)
    if len(y) > 1 and most * most < 1 << 53:
        half = len(y) // 2
        return _exact_product(y[:half]) + _exact_product(y[half:])
    x = y.astype(object)
    return x.T @ x


def _sums(scale: float):
    """Sums of entries (j = -1), of products of two (i <= j), and the number of rows (i = -1) of a task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("whitening")
        n, line, cross = 0, np.zeros(0, object), np.zeros((0, 0), object)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                y = _whole(batch.column("v").slice(at, SLICE_ROWS), scale)
                d, n = y.shape[1], n + len(y)
                if d > len(line):
                    line = np.concatenate([line, np.array([0] * (d - len(line)), object)])
                    wide = np.zeros((d, d), object)
                    wide[:len(cross), :len(cross)] = cross
                    cross = wide
                if d:
                    line[:d] += y.astype(object).sum(0)
                    cross[:d, :d] += _exact_product(y)
        rows = [(-1, -1, n), *((i, -1, int(x)) for i, x in enumerate(line)),
                *((i, j, int(cross[i, j])) for i in range(len(line)) for j in range(i, len(line)))] if n else []
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
             pa.array([Decimal(r[2]) for r in rows], pa.decimal128(38, 0))], ["i", "j", "s"])
    return run


def _project(scale: float, n: int, sums: list[int], weights: np.ndarray):
    """deviation and whitened values of every row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_caches("whitening")
        d, c = weights.shape
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                y = np.zeros((part.num_rows, d), np.int64)
                own = _whole(part.column("v"), scale)
                y[:, :own.shape[1]] = own
                most = n * int(np.abs(y).max(initial=0)) + max(map(abs, sums))
                if d * most * most < 1 << 63:
                    z = n * y - np.array(sums, np.int64)
                    deviation = pa.array((z * z).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    z = n * y.astype(object) - np.array(sums, object)
                    deviation = pa.array([Decimal(int(x)) for x in (z * z).sum(1)], pa.decimal128(38, 0))
                out = z.astype(np.float64) @ weights
                lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, c, dtype=np.int32), pa.array(out.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), deviation, lists], ["vec_id", "deviation", "w"])
    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number, means and centred sums of products of a task's whitened rows."""
    n, mean, cross = 0, 0.0, 0.0
    for batch in batches:
        if batch.num_rows:
            w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            own = w.mean(0)
            gap = own - mean
            cross = cross + (w - own).T @ (w - own) + np.outer(gap, gap) * (n * len(w) / (n + len(w)))
            mean = mean + gap * (len(w) / (n + len(w)))
            n += len(w)
    pairs = [(i, j, float(n), float(mean[i]), float(mean[j]), float(cross[i, j])) for i in range(len(mean)) for j in range(i, len(mean))] if n else []
    yield pa.RecordBatch.from_pylist([dict(zip(("i", "j", "n", "a", "b", "m"), r)) for r in pairs],
                                     pa.schema([("i", pa.int32()), ("j", pa.int32()), *((c, pa.float64()) for c in "nabm")]))


def identity_error(rows: DataFrame) -> float:
    """Largest entry of the covariance of the whitened rows (w) minus the identity."""
    parts = rows.select("w").mapInArrow(_spread, "i int, j int, n double, a double, b double, m double")
    n = F.sum("n")
    cov = (F.sum("m") + F.sum(F.col("n") * F.col("a") * F.col("b")) - F.sum(F.col("n") * F.col("a")) * F.sum(F.col("n") * F.col("b")) / n) / n
    return (parts.groupBy("i", "j").agg(cov.alias("c"))
            .agg(F.max(F.abs(F.col("c") - F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)))).first()[0])


def whiten(vectors: DataFrame, *, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding",
           scale: float = 64.0) -> DataFrame:
    """One row per vector and component: vec_id, component (from 1, falling
    eigenvalue), n, deviation decimal(38, 0) (sum over dimensions of (n * x - S)^2),
    whitened, explained (share of the variance), identity_error."""
    spark = vectors.sparkSession
    ship_package(spark)
    scratch = Scratch(spark, "whitening")
    rows = (vectors.where(F.col(vector_col).isNotNull() & usable(F.col(vector_col)))
            .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")))
    # a row for each pair of dimensions and task, then one for each pair
    got = {(r["i"], r["j"]): int(r["s"]) for r in
           rows.select("v").mapInArrow(_sums(scale), "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()}
    n, d = got.get((-1, -1), 0), 1 + max((i for i, _ in got), default=-1)
    line = [got.get((i, -1), 0) for i in range(d)]
    matrix = [[n * got.get((min(i, j), max(i, j)), 0) - line[i] * line[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    empty = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not trace:
        return spark.createDataFrame([], empty)
    spectrum = Spectrum(characteristic_polynomial(spark, matrix), trace)
    wanted, first = [], 1
    for root, often in spectrum.roots:
        if first <= components:
            wanted.append((first, str(root), often))
        first += often
    found = (spark.createDataFrame(wanted, "first int, root string, often int").repartition(len(wanted))
             .mapInArrow(_components(matrix, spectrum.bits), "component int, vector array<double>")
             .where(F.col("component") <= components).collect())
    basis = np.array([r["vector"] for r in sorted(found, key=lambda r: r["component"])]).T
    roots = [root for root, often in spectrum.roots for _ in range(often)][:components]
    one = 1 << spectrum.bits
    # x - S / n over sqrt(root / n^2) is (n * x - S) over sqrt(root)
    lengths = np.array([isqrt(root << spectrum.bits) / one for root in roots])
    explained = [root / (trace * one) for root in roots]
    done = scratch.write(rows.mapInArrow(_project(scale, n, line, basis / lengths), "vec_id long, deviation decimal(38,0), w array<double>"), "whitened")
    error = identity_error(done)
    share = F.array(*[F.lit(x) for x in explained])
    return (done.select("vec_id", "deviation", F.posexplode("w").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.get(share, F.col("at")).alias("explained"), F.lit(error).alias("identity_error")))
