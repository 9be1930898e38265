"""Operators 11 and 13: codebooks and centroids against plain Python and against their SQL."""

import hashlib
import math
import os
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from weftline.llm import centroids, vector_codes
from weftline.llm.queries import ORACLE_SQL, QUERIES

MOST = (1 << 63) - 1


def whole(vector, scale):
    return [math.floor(scale * Fraction(float(x))) for x in vector]


def away(a, b):
    return sum((p - q) ** 2 for p, q in zip(a, b))


def nearest(x, entries):
    return min(range(len(entries)), key=lambda e: (away(x, entries[e]), e))


def moved(entries, at, vectors):
    out = []
    for e, entry in enumerate(entries):
        own = [v for v, a in zip(vectors, at) if a == e]
        out.append([sum(c) // len(own) for c in zip(*own)] if own else entry)
    return out


def good(vector):
    return vector is not None and all(x is not None and math.isfinite(x) for x in vector)


def hexed(values):
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


def plain_codes(rows, width, entries=256):
    rows = sorted(((i, v, label) for i, v, label in rows if good(v) and len(v) == width), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    cut = width // 4
    vectors = [whole(v, 1024) for _, v, _ in rows]
    codes, errors, books = [[] for _ in rows], [0] * len(rows), []
    for p in range(4):
        parts = [v[p * cut : (p + 1) * cut] for v in vectors]
        book = parts[:entries]
        for _ in range(4):
            book = moved(book, [nearest(x, book) for x in parts], parts)
        for i, x in enumerate(parts):
            codes[i].append(nearest(x, book))
            errors[i] += away(x, book[codes[i][-1]])
        books += [c for entry in book for c in entry]
    total = {}
    for (_, _, label), e in zip(rows, errors):
        total[label] = total.get(label, 0) + min(e, MOST)
    return sorted(
        (repr(i), "".join(f"{c:02x}" for c in code), min(e, MOST), min(total[label], MOST), hexed(books))
        for (i, _, label), code, e in zip(rows, codes, errors)
    )


def plain_clusters(rows, k=40):
    rows = [(i, whole(v, 256), v) for i, v in rows if good(v) and len(v) == 64]
    drawn = sorted(rows, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    middles, vectors = [v for _, v, _ in drawn[:k]], [v for _, v, _ in rows]
    for _ in range(5):
        middles = moved(middles, [nearest(x, middles) for x in vectors], vectors)
    at = [nearest(x, middles) for x in vectors]
    far = [min(away(x, middles[a]), MOST) for x, a in zip(vectors, at)]
    own = {a: min(sum(f for f, b in zip(far, at) if b == a), MOST) for a in set(at)}
    return sorted((repr(i), a, f, own[a], min(sum(far), MOST), hexed(middles[a])) for (i, _, _), a, f in zip(rows, at, far))


def table(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int, distance string, code long").repartition(3)


def drawn(n, width, seed=1, digits=1):
    draw = np.random.default_rng(seed)
    return [[float(np.float32(x)) for x in np.round(draw.normal(size=width) / 4, digits)] for _ in range(n)]


ODD = [None, [], [1.0, 2.0], [math.nan] * 64, [math.inf] + [0.0] * 63, [None] + [0.0] * 63, [0.5] * 63]


def test_clusters_match_plain_python(spark):
    """Ties (rounded components, repeated rows, a null key), odd rows and clashing columns."""
    rows = [(i, v) for i, v in enumerate(drawn(300, 64, digits=0) + drawn(300, 64))] + [(7, [0.25] * 64)] * 90 + [(None, [0.5] * 64)]
    rows += [(900 + i, v) for i, v in enumerate(ODD)]
    df = table(spark, [(i, v, None, "x", 1) for i, v in rows])
    found = sorted((repr(r[0]), *r[1:]) for r in centroids.query(df).collect())
    assert found == plain_clusters(rows)


def test_clusters_of_wide_components(spark):
    """Components beyond 64 bits and beyond a float's exponent once scaled, beside usual ones."""
    rows = [(i, v) for i, v in enumerate(drawn(60, 64))]
    rows += [(100 + i, [s * m] * 32 + [0.1] * 32) for i, (s, m) in enumerate([(1, 2e6), (-1, 2e6), (1, 1e12), (1, 1e18), (-1, 1e300), (1, 1.7e308), (1, 1.6e308)])]
    found = sorted((repr(r[0]), *r[1:]) for r in centroids.query(table(spark, [(i, v, 0, "", 0) for i, v in rows], "double")).collect())
    assert found == plain_clusters(rows)


def test_few_vectors(spark):
    none = table(spark, [])
    assert centroids.query(none).count() == 0 and vector_codes.query(none).count() == 0
    odd = table(spark, [(i, v, 1, "x", 1) for i, v in enumerate(ODD[:2] + ODD[3:6])])
    assert centroids.query(odd).count() == 0 and vector_codes.query(odd).count() == 0
    rows = [(3, [0.1] * 64), (2, [0.2] * 64)]
    found = sorted((repr(r[0]), *r[1:]) for r in centroids.query(table(spark, [(i, v, 0, "", 0) for i, v in rows])).collect())
    assert found == plain_clusters(rows)


def test_screening_never_drops_the_nearest():
    draw = np.random.default_rng(3)
    for size in (3, 300, 1 << 20, 1 << 26):
        x, middles = draw.integers(-size, size, (500, 64)), draw.integers(-size, size, (40, 64))
        middles[20:] = middles[:20] + draw.integers(-1, 2, (20, 64))
        exact = ((x[:, None, :] - middles[None]) ** 2).sum(axis=2)
        assert (centroids.screened(x, middles) | (exact > exact.min(axis=1, keepdims=True))).all()
        number, distance = centroids.nearest(x, middles)
        assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_codes_match_plain_python(spark):
    rows = [(i, v, i % 3 or None) for i, v in enumerate(drawn(200, 8, digits=1) + drawn(200, 8, seed=4, digits=0))]
    rows += [(7, [0.25] * 8, 1)] * 90 + [(None, [0.5] * 8, None)] + [(900 + i, v, 1) for i, v in enumerate(ODD)]
    df = table(spark, [(i, v, label, "x", 1) for i, v, label in rows])
    assert sorted((repr(r[0]), *r[1:]) for r in vector_codes.query(df).collect()) == plain_codes(rows, 8)


def test_codes_of_wide_components(spark):
    rows = [(i, v, 1) for i, v in enumerate(drawn(300, 4))]
    rows += [(400 + i, [v, 1.0, -v, 0.0], 2) for i, v in enumerate([3e7, -1e12, 1e18, 1e300, 1.7e308, -1.7e308])]
    df = table(spark, [(i, v, label, "x", 1) for i, v, label in rows], "double")
    assert sorted((repr(r[0]), *r[1:]) for r in vector_codes.query(df).collect()) == plain_codes(rows, 4)


def test_codes_decode_to_their_entries(spark):
    rows = drawn(400, 16)
    coded, books = vector_codes.compress(table(spark, [(i, v, 0, "", 0) for i, v in enumerate(rows)]))
    for r in coded.collect():
        stands_for = books.decode(np.array([[int(r["code"][p : p + 2], 16) for p in (0, 2, 4, 6)]]))[0]
        assert away(whole(rows[r["vec_id"]], 1024), stands_for.tolist()) == r["error"]


def test_partial_distances_match_all_distances():
    draw = np.random.default_rng(5)
    for width in (1, 2, 3, 16, 40):
        x, book = draw.integers(-9, 9, (3000, width)), draw.integers(-9, 9, (256, width))
        exact = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        index, error = vector_codes.nearest(x, book)
        assert (index == exact.argmin(axis=1)).all() and (error == exact.min(axis=1)).all()


@pytest.mark.parametrize("name", ["op11_vector_codes", "op13_centroid_clustering"])
def test_sql(spark, name):
    sf_dir = "/root/testdata/sf0.001"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf_dir}/embeddings.parquet')")
    result = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in result.description]
    expected = sorted(map(repr, result.fetchall()))
    assert sorted(repr(tuple(r)) for r in QUERIES[name](spark, sf_dir).select(*names).collect()) == expected
