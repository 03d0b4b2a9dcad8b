"""Periodic runs against a search over all periods."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenant.llm import registry, runs


def plain_runs(w, least=6, power=4):
    n, out = len(w), []
    for q in range(1, n // power + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, power * q) and not any(q % d == 0 and all(w[k] == w[k + d] for k in range(i, i + length - d)) for d in range(1, q)):
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def words(letters):
    return [bytes([x]) for x in letters]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(97, 99), max_size=70), st.integers(0, 69), st.integers(1, 12))
def test_runs_are_all_runs(letters, a, p):
    w = words(letters)
    w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    assert [tuple(r) for r in runs.periodic_runs(w).tolist()] == plain_runs(w)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=2, max_size=60))
def test_squares_and_more_are_found_without_leaving_words_out(letters):
    assert [tuple(r) for r in runs.all_runs(np.array(letters), 2, 2).tolist()] == plain_runs(letters, 2, 2)


def test_famous_words():
    fibonacci = ["b", "a"]
    while len(fibonacci[-1]) < 400:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for w in (fibonacci[-1], "a" * 500, "ab" * 200 + "a", "aab" * 50 + "aba" * 50, "".join("ab"[bin(i).count("1") % 2] for i in range(512))):
        ids = np.array([ord(c) - 96 for c in w])
        assert [tuple(r) for r in runs.all_runs(ids, 2, 2).tolist()] == plain_runs(w, 2, 2)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 4), min_size=1, max_size=50))
def test_extensions_of_the_tree(letters):
    s = [*letters, 0]
    tree = runs.SuffixTree(s, 5)
    walk, above = tree.tour()
    assert tree.ranks(walk).tolist() == [sorted(range(len(s)), key=lambda i: s[i:]).index(i) for i in range(len(s))]
    a, b = (x.ravel() for x in np.meshgrid(range(len(s)), range(len(s))))
    a, b = a[a != b], b[a != b]
    if len(a):
        common = lambda i, j: next(k for k in range(len(s)) if max(i, j) + k == len(s) or s[i + k] != s[j + k])
        assert runs.Extensions(tree, walk, above).common(a, b).tolist() == [common(i, j) for i, j in zip(a.tolist(), b.tolist())]


def test_table_with_odd_rows(spark):
    rnd = random.Random(5)
    some = ["the", "of", "and", "ü", "𝔸x"]
    texts = [None, "", "  \t\n", "one", "x " * 7, "\x0bx\x0cx\rx\nx\tx x x", "a b " * 6, "a b " * 9, *(" ".join(rnd.choices(some[: 1 + k % 5], k=rnd.randrange(90))) for k in range(60))]
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(3, "again " * 8, "s"), (3, "again " * 8, "s"), (None, "n o " * 5, None)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, RUNS string").withColumn("collapsed", F.lit(1)).repartition(3)
    found = runs.digests(runs.find_runs(runs.spliced(frame)))
    columns = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    assert found.columns == columns and all(t == "bigint" for c, t in found.dtypes if "sha" not in c)
    order = lambda rows: sorted(rows, key=str)
    assert order(map(tuple, found.collect())) == order(plain_row(i, t) for i, t, _ in rows)
    assert runs.find_runs(frame.limit(0)).collect() == []


@pytest.mark.parametrize("data", ["sf0.001"])
def test_query_is_a_plain_search(spark, data):
    docs = spark.read.parquet(f"/root/testdata/{data}/documents.parquet").select("doc_id", "text").collect()
    short = {r.doc_id: r.text for r in docs if len(r.text or "") < 6000}
    found = {r.doc_id: tuple(r) for r in registry.op11_runs(spark, f"/root/testdata/{data}").collect()}
    assert len(found) == len(docs) and sum(r[1] for r in found.values()) > 0
    for doc_id, text in short.items():
        assert found[doc_id] == plain_row(doc_id, text)


def test_long_periodic_text_is_linear():
    w = [b"w%d" % (i % 9973) for i in range(120_000)]
    assert runs.periodic_runs(w).tolist() == [[0, 120_000, 9973]]
    assert runs.without_repeats(w, runs.periodic_runs(w)) == b" ".join(w[:9973])
