"""Differences between two copies of a table by set reconciliation with characteristic polynomials.

Each side turns every row into an element of the field F_p, p = 2**61 - 1, and hashes its key into a bucket. Per bucket
a side publishes only the values of its characteristic polynomial, the product of (z - element), at a few fixed points.
The quotient of both sides' values is a rational function whose numerator and denominator have just the differing
elements as roots. It is recovered by rational interpolation under a degree bound, checked at further points, and the
bound is doubled for the buckets that fail until all are verified. A side then finds its differing rows as the roots
among its own elements, and only these rows are fetched and compared field by field.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeweft.session import cut

P = (1 << 61) - 1
_P = np.uint64(P)
_M32 = np.uint64(0xFFFFFFFF)
CHECKS = 2
ROWS_PER_BUCKET = 192


def mulmod(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in F_p of uint64 arrays below p, by 32-bit limbs."""
    ah, al = a >> np.uint64(32), a & _M32
    bh, bl = b >> np.uint64(32), b & _M32
    mid = ah * bl + al * bh  # below 2**62
    low = al * bl
    # a*b = ah*bh*2**64 + mid*2**32 + low, and 2**61 = 1
    r = ((ah * bh) << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << np.uint64(32))
    r = (r & _P) + (r >> np.uint64(61))
    r = r + (low & _P) + (low >> np.uint64(61))
    r = (r & _P) + (r >> np.uint64(61))
    return np.where(r >= _P, r - _P, r)


def points(n: int) -> list[int]:
    """Sample points at the top of the field; a row's element is kept below them."""
    return [P - 1 - i for i in range(n)]


MAX_POINTS = 1 << 20


def evaluate_segments(values: np.ndarray, offsets: np.ndarray, zs: list[int]) -> np.ndarray:
    """Values of the characteristic polynomial of each segment at the points zs, as array [segments, points]."""
    n = len(offsets) - 1
    out = np.ones((n, len(zs)), dtype=np.uint64)
    if not len(values):
        return out
    length = np.diff(offsets)
    for j, z in enumerate(zs):
        cur = np.uint64(z) - values  # elements are below every point
        ln, off = length.copy(), offsets[:-1].copy()
        while len(cur) and ln.max(initial=0) > 1:  # halve every segment in step
            half = (ln + 1) // 2
            new_off = np.concatenate([[0], np.cumsum(half)])
            seg = np.repeat(np.arange(n), half)
            pos = np.arange(new_off[-1]) - new_off[seg]
            left = cur[off[seg] + 2 * pos]
            has = 2 * pos + 1 < ln[seg]
            right = np.ones_like(left)
            right[has] = cur[(off[seg] + 2 * pos + 1)[has]]
            cur, ln, off = mulmod(left, right), half, new_off[:-1]
        full = ln > 0
        out[full, j] = cur[off[full]]
    return out


def _trim(a: list[int]) -> list[int]:
    while a and not a[-1]:
        a.pop()
    return a


def _divmod(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    a, inv, q = a[:], pow(b[-1], -1, P), [0] * max(0, len(a) - len(b) + 1)
    for i in range(len(a) - len(b), -1, -1):
        c = q[i] = a[i + len(b) - 1] * inv % P
        if c:
            for j, x in enumerate(b):
                a[i + j] = (a[i + j] - c * x) % P
    return _trim(q), _trim(a[: len(b) - 1])


def _value(poly: list[int], z: int) -> int:
    r = 0
    for c in reversed(poly):
        r = (r * z + c) % P
    return r


def solve_bucket(ea: list[int], eb: list[int], na: int, nb: int, bound: int) -> tuple[list[int], list[int]] | None:
    """Monic numerator and denominator of the quotient, or None where the bound doesn't hold.

    ea, eb: values of both sides at bound + CHECKS points. The differing elements of one side are the roots of its
    polynomial. The bound limits the number of differing elements of both sides together.
    """
    zs = points(bound + CHECKS)
    ratio = [x * pow(y, -1, P) % P for x, y in zip(ea, eb)]
    delta = na - nb
    if abs(delta) > bound:
        return None
    m = bound - (bound - abs(delta)) % 2  # numerator and denominator degrees: (m + delta) / 2, (m - delta) / 2
    top = (m + delta) // 2
    k = m + 1  # one more point than unknowns, so that the answer is unique
    # Newton interpolation of the ratio at k points
    coef = ratio[:k]
    for i in range(1, k):
        for j in range(k - 1, i - 1, -1):
            coef[j] = (coef[j] - coef[j - 1]) * pow(zs[j] - zs[j - i], -1, P) % P
    f: list[int] = []
    for i in range(k - 1, -1, -1):
        f = [0, *f]
        for j in range(len(f) - 1):
            f[j] = (f[j] - zs[i] * f[j + 1]) % P
        f[0] = (f[0] + coef[i]) % P
    f = _trim(f)
    modulus = [1]
    for z in zs[:k]:
        nxt = [0, *modulus]
        for j, c in enumerate(modulus):
            nxt[j] = (nxt[j] - z * c) % P
        modulus = nxt
    # Extended Euclid until the remainder has the numerator's degree
    r0, r1, t0, t1 = modulus, f, [], [1]
    while len(r1) - 1 > top:
        q, r = _divmod(r0, r1)
        t = t0 + [0] * max(0, len(q) + len(t1) - 1 - len(t0))
        for i, x in enumerate(q):
            for j, y in enumerate(t1):
                t[i + j] = (t[i + j] - x * y) % P
        r0, r1, t0, t1 = r1, r, t1, _trim(t)
    if not r1 or not t1:
        return None
    num, den = r1, t1
    if len(num) - len(den) != delta:
        return None
    inv_n, inv_d = pow(num[-1], -1, P), pow(den[-1], -1, P)
    if num[-1] != den[-1]:
        return None
    num, den = [c * inv_n % P for c in num], [c * inv_d % P for c in den]
    for z, r in zip(zs, ratio):
        if _value(num, z) != r * _value(den, z) % P:
            return None
    return num, den


def _lists(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.uint64), np.concatenate(
        [[0], np.cumsum(np.diff(col.offsets.to_numpy()))]
    ).astype(np.int64)


def _sketcher(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zs = points(bound + CHECKS)
        for b in batches:
            values, offsets = _lists(b.column("elements"))
            ev = evaluate_segments(values, offsets, zs)
            flat = pa.array(ev.reshape(-1).astype(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, len(zs), dtype=np.int32)), flat)
            n = pa.array(np.diff(offsets).astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("bucket"), n, lists], names=["bucket", "n", "evals"])

    return run


def _solver(bound: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ones = [1] * (bound + CHECKS)
        for pdf in frames:
            rows = []
            for bucket, na, ea, nb, eb in zip(pdf.bucket, pdf.n_a, pdf.evals_a, pdf.n_b, pdf.evals_b):
                na, nb = (0 if pd.isna(x) else int(x) for x in (na, nb))
                ea, eb = (ones if x is None else [int(v) for v in x] for x in (ea, eb))
                got = ([1], [1]) if (na, ea) == (nb, eb) else solve_bucket(ea, eb, na, nb, bound)
                rows.append((bucket, got is not None, *(got or ([], []))))
            yield pd.DataFrame(rows, columns=["bucket", "verified", "num", "den"])

    return run


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Elements of a side that are roots of its polynomial. Fewer roots than the degree mean a false answer, which the
    checks let through with a chance of about 2^-61 each: such a bucket gives a null, for it to be compared exactly."""
    for b in batches:
        values, offsets = _lists(b.column("elements"))
        coefs, ends = _lists(b.column("poly"))
        seg = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        degree = np.diff(ends) - 1
        acc = np.zeros(len(values), dtype=np.uint64)
        for d in range(int(degree.max(initial=0)), -1, -1):
            on = degree[seg] >= d
            acc[on] = mulmod(acc[on], values[on]) + coefs[ends[:-1][seg[on]] + d]
            acc[on] = np.where(acc[on] >= _P, acc[on] - _P, acc[on])
        hit = (acc == 0) & (degree[seg] > 0)
        found = np.bincount(seg[hit], minlength=len(degree)) if len(seg) else np.zeros(len(degree))
        wrong = np.flatnonzero(found < degree)
        at = np.concatenate([seg[hit], wrong]).astype(np.int64)
        elements = pa.array(np.concatenate([values[hit].astype(np.int64), np.zeros(len(wrong), np.int64)]), mask=np.arange(len(at)) >= hit.sum())
        yield pa.RecordBatch.from_arrays([b.column("bucket").take(pa.array(at)), elements], names=["bucket", "element"])


def row_element(columns: list[Column]) -> Column:
    """A row's field element: chained 64-bit hash of the values and of which of them are null, below the points."""
    flags = [c.isNull() for c in columns]
    return F.pmod(F.xxhash64(*columns, *flags), F.lit(P - MAX_POINTS))


def differing_elements(a: DataFrame, b: DataFrame, first_bound: int = 16, last_bound: int = 256) -> tuple[DataFrame, DataFrame]:
    """(bucket, element) of the rows that only one side has; a and b are (bucket, elements array<long>) per bucket.

    The bound doubles for the buckets not verified. Beyond last_bound interpolation costs more than the bucket itself,
    so a bucket that is still open then is compared element by element, which is exact.
    """
    only_a, only_b = [], []
    open_a, open_b, bound = a, b, first_bound
    while True:
        sketches = [x.mapInArrow(_sketcher(bound), "bucket long, n long, evals array<long>") for x in (open_a, open_b)]
        sa, sb = (s.select("bucket", F.col("n").alias(f"n_{t}"), F.col("evals").alias(f"evals_{t}")) for s, t in zip(sketches, "ab"))
        solved = cut(
            sa.join(sb, "bucket", "full").mapInPandas(_solver(bound), "bucket long, verified boolean, num array<long>, den array<long>")
        )
        good = solved.filter("verified")
        for mine, poly, out in ((open_a, "num", only_a), (open_b, "den", only_b)):
            pairs = mine.join(good.filter(F.size(poly) > 1).select("bucket", F.col(poly).alias("poly")), "bucket")
            out.append(pairs.mapInArrow(_roots, "bucket long, element long"))
        left = solved.filter(~F.col("verified")).select("bucket")
        if left.isEmpty():
            break
        open_a, open_b, bound = open_a.join(left, "bucket"), open_b.join(left, "bucket"), bound * 2
        if bound > last_bound:
            for out, exact in zip((only_a, only_b), _exact(open_a, open_b)):
                out.append(exact)
            break
    found = [cut(_union(x)) for x in (only_a, only_b)]
    wrong = _union([x.filter("element is null").select("bucket") for x in found]).distinct()
    if wrong.isEmpty():
        return found[0], found[1]
    again = _exact(a.join(wrong, "bucket"), b.join(wrong, "bucket"))
    return tuple(x.join(wrong, "bucket", "left_anti").unionByName(e) for x, e in zip(found, again))


def _exact(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, element) of both sides' own elements, bucket by bucket."""
    both = a.withColumnRenamed("elements", "ea").join(b.withColumnRenamed("elements", "eb"), "bucket", "full")
    ea, eb = (F.coalesce(F.col(c), F.array().cast("array<long>")) for c in ("ea", "eb"))
    return tuple(both.select("bucket", F.explode(F.array_except(x, y)).alias("element")) for x, y in ((ea, eb), (eb, ea)))


def _common_type(a: str, b: str) -> str:
    """A type in which equal keys of both sides hash alike."""
    whole = ("tinyint", "smallint", "int", "bigint")
    return a if a == b else "bigint" if a in whole and b in whole else "string"


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


#: Differing elements up to this number are sent to all tasks (16 bytes each); more are joined by shuffling.
BROADCAST_ELEMENTS = 500_000


def reconcile(a: DataFrame, b: DataFrame, key: str, fields: dict[str, str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows missing on either side and fields that differ, of two tables that should agree by key.

    key: never null; keys of two types are compared as long numbers or as texts. fields: compared columns with the type both sides are cast to. Result: key, diff, value_a string,
    value_b string; diff is missing_in_b, missing_in_a or the field's name. Two nulls are equal, a null and a value
    differ. Repeated equal rows count once; a key with several different rows on a side takes part with each distinct
    row, and its fields are compared by the smallest one. Columns outside key and fields are ignored. Empty tables give
    the other side's keys as missing.
    """
    total = max(a.count(), b.count())
    buckets = max(1, total // rows_per_bucket)
    kind = _common_type(dict(a.dtypes)[key], dict(b.dtypes)[key])
    cols = [F.col(key).cast(kind).alias("_key"), *[F.col(f).cast(t).alias(f"_f{i}") for i, (f, t) in enumerate(fields.items())]]
    names = ["_key", *[f"_f{i}" for i in range(len(fields))]]

    def keyed(df: DataFrame) -> DataFrame:
        x = df.select(*cols)
        return x.withColumns(
            {"bucket": F.pmod(F.xxhash64("_key", F.lit(7)), F.lit(buckets)), "element": row_element([F.col(n) for n in names])}
        )

    ka, kb = keyed(a), keyed(b)
    # Buckets are balanced by hashing distinct keys, and collect_set drops repeats before the exchange.
    sets = [cut(k.groupBy("bucket").agg(F.collect_set("element").alias("elements"))) for k in (ka, kb)]
    diff_a, diff_b = differing_elements(*sets)

    def fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
        small = wanted.count() <= BROADCAST_ELEMENTS
        wanted = F.broadcast(wanted) if small else wanted
        hit = rows.join(wanted, ["bucket", "element"], "left_semi")
        return hit.groupBy("_key").agg(F.min(F.struct(*names[1:])).alias("_row"))

    fa, fb = fetch(ka, diff_a).withColumnRenamed("_row", "_a"), fetch(kb, diff_b).withColumnRenamed("_row", "_b")
    both = fa.join(fb, "_key", "full")
    text = lambda side, n: F.col(f"{side}.{n}").cast("string")
    null = F.lit(None).cast("string")
    missing = F.when(F.col("_b").isNull(), F.lit("missing_in_b")).when(F.col("_a").isNull(), F.lit("missing_in_a"))
    cases = [F.when(missing.isNotNull(), F.struct(missing.alias("diff"), null.alias("value_a"), null.alias("value_b")))]
    for n, f in zip(names[1:], fields):
        differs = missing.isNull() & ~F.col(f"_a.{n}").eqNullSafe(F.col(f"_b.{n}"))
        cases.append(F.when(differs, F.struct(F.lit(f).alias("diff"), text("_a", n).alias("value_a"), text("_b", n).alias("value_b"))))
    return (
        both.select("_key", F.explode(F.filter(F.array(*cases), lambda x: x.isNotNull())).alias("d"))
        .select(F.col("_key").alias(key), "d.diff", "d.value_a", "d.value_b")
    )
