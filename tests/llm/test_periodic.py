import zlib

import numpy as np
import pytest
from brute import sha, words
from pyspark.sql import functions as F

from tracelight.llm import queries as Q
from tracelight.llm.periodic import candidate_segments, find_runs, sorted_suffixes, with_echoes

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """All runs, period by period: stretches of words that equal the one a period before."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                found.setdefault((i - q, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def brute(data):
    out = []
    for i, text in data:
        w = words(text)
        runs = brute_runs(w)
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        kept = sha(" ".join(x for k, x in enumerate(w) if k not in gone))
        out.append((i, len(runs), s, n, q, runs and 1000 * n // q or None, listed, kept))
    return sorted(out, key=str)


def echoed(i, text):
    w = words(text)
    h = zlib.crc32(str(i).encode())
    if i is None or h % 10 or not w:
        return text
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(w[k] if k < a else w[a + (k - a) % p] for k in range(n))


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", ["odd", "none"])
def test_odd_rows(frame, rows, request):
    data = [] if rows == "none" else [r for r in request.getfixturevalue("odd") if len(r[1] or "") < 50_000]
    assert got(find_runs(frame(data))) == brute(data)


def test_query_against_brute_force(spark):
    data = [(r.doc_id, echoed(r.doc_id, r.text)) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(Q.op13_periodic_runs(spark, SF)) == brute(data)


def test_small_alphabets(spark):
    """Runs inside runs, next to each other and overlapping, over one to four letters."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(700):
        letters = list("abcd")[: int(rng.integers(1, 5))]
        text = list(rng.choice(letters, rng.integers(0, 30)))
        for _ in range(int(rng.integers(0, 4))):
            piece = list(rng.choice(letters, rng.integers(1, 9)))
            text += piece * int(rng.integers(1, 8)) + piece[: int(rng.integers(0, len(piece) + 1))]
        rows.append((i, " ".join(text)))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(find_runs(table)) == brute(rows)


def test_texts_whose_hashes_collide(spark):
    """Thue-Morse words and their complement have equal polynomial hashes; exact ranks tell them apart."""
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(1, " ".join([one, other] * 8)), (2, " ".join([one] * 3 + [other] * 3)), (3, " ".join([other] * 7 + [one]))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(find_runs(table)) == brute(rows)
    letters = [(4, " ".join(one)), (5, " ".join(one + other + one + other + one + other + one + other + "a"))]
    assert got(find_runs(spark.createDataFrame(letters, "doc_id long, text string"))) == brute(letters)


def test_long_runs(spark):
    rows = [(1, "lorem ipsum dolor " * 20_000), (2, "a " * 30_000 + "b"), (3, ("x " * 9 + "y ") * 3_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in find_runs(table, with_output=True).collect()}
    assert found[1][1:6] == (1, 0, 60_000, 3, 20_000_000) and found[1].collapsed == "lorem ipsum dolor"
    assert found[2][1:6] == (1, 0, 30_000, 1, 30_000_000) and found[2].collapsed == "a b"
    assert found[3][1] == 3001 and found[3][2:5] == (0, 30_000, 10)
    assert [r.period for r in found[3].runs[:2]] == [1, 10]


def test_segments_hold_all_runs_and_little_else():
    rng = np.random.default_rng(4)
    w = rng.integers(0, 1 << 60, 5000).astype(np.uint64)
    w[1000:1400] = np.tile(w[1000:1040], 10)
    w[3000:3007] = w[3000]
    first, last = candidate_segments(w, np.array([0, 2000, 2000, 5000]))
    assert [(a <= 1000 and b >= 1400) or (a <= 3000 and b >= 3007) for a, b in zip(first, last, strict=True)] == [True, True]
    assert (last - first).sum() < 600


def test_suffixes():
    rng = np.random.default_rng(6)
    v = rng.integers(0, 3, 500)
    order, common = sorted_suffixes(v)
    tails = [v[i:].tolist() for i in order]
    assert tails == sorted(tails)
    for k in range(1, 500):
        same = next((n for n, (a, b) in enumerate(zip(tails[k - 1], tails[k], strict=False)) if a != b), min(map(len, tails[k - 1 : k + 1])))
        assert common[k] == same


def test_ids_of_other_types_and_clashing_columns(spark):
    table = spark.createDataFrame([("k", "a a a a a a b", 1, 2), (None, None, 3, 4)], "`a.b` string, text string, row int, n_runs int")
    assert [tuple(r)[:5] for r in find_runs(table, "a.b").collect()] == [("k", 1, 0, 6, 1), (None, 0, None, None, None)]


def test_echoes(spark, odd):
    table = spark.createDataFrame(odd, "doc_id long, text string")
    want = sorted(((i, echoed(i, t)) for i, t in odd), key=str)
    assert sorted((tuple(r) for r in with_echoes(table).select("doc_id", "text").collect()), key=str) == want
    assert with_echoes(table).filter(F.col("doc_id") < 0).count() == 0
