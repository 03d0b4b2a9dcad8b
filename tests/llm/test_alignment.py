"""Alignment against the two libraries over whole texts and sets of byte offsets."""

import hashlib
from bisect import bisect_right
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from provenant.llm import alignment, registry

FILES = public_tokenizers.path(registry.BYTE_FILE), public_tokenizers.path(registry.PIECE_FILE)


@pytest.fixture(scope="module")
def both():
    a, b = alignment.Byte(FILES[0]), alignment.Piece(FILES[1])
    a.model = Tokenizer.from_file(FILES[0])
    a.model.encode_special_tokens = True
    assert a.bytes[50256] == b"<|endoftext|>" and len(a.bytes) == 50257
    return a, b


@pytest.fixture(scope="module")
def aligner(both):
    return alignment.Aligner(*both)


def plain(both, text):
    """Ids of both, groups and links of a text, without windows or memory."""
    a, b = both
    if not text:
        return [], [], [], []
    x, y = a.model.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
    if not b"".join(a.bytes[i] for i in x) == b"".join(b.bytes[i] for i in y) == (" " + text).encode():
        return [], [], [], []
    ends_a, ends_b = list(accumulate(len(a.bytes[i]) for i in x)), list(accumulate(len(b.bytes[i]) for i in y))
    cuts = sorted({*ends_a} & {*ends_b})
    of = lambda ids, ends, lo, hi: ",".join(map(str, ids[bisect_right(ends, lo) : bisect_right(ends, hi)]))
    groups = [f"{of(x, ends_a, lo, hi)}|{of(y, ends_b, lo, hi)}" for lo, hi in zip([0, *cuts], cuts)]
    at_b = dict(zip(ends_b, y))
    links = [(i, at_b[e]) for i, e in zip(x, ends_a) if e in at_b]
    return x, y, groups, links


def plain_table(both, rows):
    texts = {t: plain(both, t) for t in {t for _, t in rows}}
    counts = Counter(p for _, t in rows for p in texts[t][3])
    best = {}
    for (_, j), n in counts.items():
        best[j] = max(best.get(j, 0), n)
    out = []
    for doc_id, t in rows:
        x, y, groups, links = texts[t]
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if x else ""
        out.append((doc_id, len(x), len(y), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


PARTS = st.sampled_from([" ", "  ", "\n", "\t", " a", "the ", "The", "Un", "token", "s.", "'s", "1,000", "é", "é", "中文", "𝔸", " ", "▁", "\x00", "\x1c", "\x85", "<s>", "<|endoftext|>", "<0x41>", " \n ", "...", "​"])


@settings(max_examples=600, deadline=None)
@given(parts=st.lists(PARTS, max_size=12))
def test_any_text(both, aligner, parts):
    text = "".join(parts)
    x, y, groups, links = plain(both, text)
    (ids,) = aligner.encode([text]) if text else (None,)
    assert (ids is None) == (not x)
    if ids is not None:
        assert memoryview(ids[0]).cast("i").tolist() == x and memoryview(ids[1]).cast("i").tolist() == y
        (found,) = aligner.align([ids])
        assert found[0] == ";".join(groups) and found[2] == len(groups)
        assert memoryview(found[1]).cast("q").tolist() == [i << 32 | j for i, j in links]


def test_both_encoders_of_the_byte_level_vocabulary_agree(both):
    a = both[0]
    texts = [t for k in range(40) for t in ("word" * k, "a b\n c" * k, "Zażółć gęślą jaźń 12345 ''ll " * k)]
    assert a.quick and a.encode(texts) == [e.ids for e in a.model.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_memory_starts_anew_with_the_same_results(both, monkeypatch):
    monkeypatch.setattr(alignment, "STRETCHES", 5)
    monkeypatch.setattr(alignment, "WINDOWS", 5)
    monkeypatch.setattr(alignment, "LONG_STRETCH", 6)
    small = alignment.Aligner(*both)
    for text in ["one two three four five six seven", "one two", "extraordinarily long-windedness of words", "seven six five four three two one zero"] * 3:
        x, y, groups, _ = plain(both, text)
        (ids,) = small.encode([text])
        assert memoryview(ids[1]).cast("i").tolist() == y and small.align([ids])[0][0] == ";".join(groups)
    assert len(small.stretches) <= 5 and len(small.windows) <= 5


ODD = [(1, None), (2, ""), (3, "one two"), (3, "one two"), (3, "one two"), (None, "a b"), (4, "▁"), (5, "x " * 9000), (6, "tokenization's unbelievable"), (7, " "), (8, "\n\n")]


def test_table_with_odd_rows(spark, both):
    frame = spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("LINKS", F.lit(1)).withColumn("row", F.lit(2)).repartition(3)
    found = alignment.digests(alignment.align(frame, *FILES))
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_table(both, ODD)
    assert alignment.digests(alignment.align(frame.limit(0), *FILES)).collect() == []


def test_seldom_pairs_are_joined_by_a_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = alignment.written(alignment.align(docs, *FILES), "test")
    counts = alignment.link_counts(kept)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(alignment.scored(kept, counts, "doc_id")) == rows(alignment.scored(kept, counts, "doc_id", few=10, frequent=50))


def test_query_is_a_plain_alignment(spark, both):
    data = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, registry.op13_alignment(spark, data).collect()), key=str) == plain_table(both, rows)
