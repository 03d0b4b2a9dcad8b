"""The stored index against search that reads all texts."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from provenant.operators import index as X
from provenant.operators import search as H

WORDS = ["license", "licensed", "under", "the", "MIT", "mit", "of", "versión", "version", "verso", "Żółw", "x1", "ł", "gnu", "rare"]


def some(n, seed=1, first=0):
    rnd = random.Random(seed)
    weights = [9, 5, 4, 20, 3, 2, 15, 1, 2, 1, 1, 1, 1, 1, 0.1]
    return [(first + i, " ".join(rnd.choices(WORDS, weights, k=rnd.randrange(4))), None if i % 17 == 0 else " ".join(rnd.choices(WORDS, weights, k=int(rnd.paretovariate(0.7)) % 300))) for i in range(n)]


SCHEMA = "object_id bigint, title string, content string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some(1500), SCHEMA).withColumn("BLOCK", F.lit(1)).withColumn("segment", F.lit("x")).repartition(3).persist()


@pytest.fixture(scope="module")
def stored(spark, docs, tmp_path_factory):
    return X.create_index(docs, str(tmp_path_factory.mktemp("index")), range_tokens=3000)


def rows(df, *names):
    return sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*names).collect())


Q = [
    dict(any=(H.Phrase(("license",)), H.Phrase(("rare",)))),
    dict(all=(H.Phrase(("licensed", "under")),), any=(H.Phrase(("vers",), prefix=True), H.Near((H.Phrase(("mit",)), H.Phrase(("license",))), 2)), none=(H.Phrase(("gnu",)),)),
    dict(all=(H.Phrase(("the", "of", "the")),)),
    dict(all=(H.Phrase(("license",), column="title"),), none=(H.Phrase(("the", "li"), prefix=True),)),
    dict(any=(H.Phrase(("licens",), prefix=True, initial=True),)),
    dict(any=(H.Phrase(("zolw",)), H.Phrase(("ł",)), H.Phrase(("nowhere",)))),
    dict(all=(H.Near((H.Phrase(("mit", "license")), H.Phrase(("of",)), H.Phrase(("under",), prefix=True)), 4),)),
]


@pytest.mark.parametrize("q", Q)
def test_pages_are_those_of_a_full_search(docs, stored, q):
    want = H.search_page(docs, 30, **q)
    got = X.search_page(stored, 30, **q)
    assert rows(got, "doc", "rank", "place", "has_more") == rows(want, "doc", "rank", "place", "has_more")
    want = H.ranked(H.matched(docs, **q))
    assert rows(X.ranked(stored, X.matched(stored, **q)), "doc", "rank") == rows(want, "doc", "rank")


def test_tokens_are_those_of_a_full_index(docs, stored):
    full = H.build_index(docs).filter("term in ('of', 'mit') or term like 'vers%'")
    assert rows(X.tokens(stored, ["of", "mit"], ["vers"]), "term", "doc", "column", "pos") == rows(full, "term", "doc", "column", "pos")
    assert rows(X.dictionary(stored), "term", "tf", "df") == rows(H.build_index(docs).groupBy("term").agg(F.count("*").alias("tf"), F.count_distinct("doc").alias("df")), "term", "tf", "df")
    assert rows(X.bm25(stored, ["license", "rare"]), "doc", "rank") == rows(H.bm25(docs, ["license", "rare"]), "doc", "rank")


def test_blocks_below_the_mark_are_left_out(spark, docs, stored, monkeypatch, tmp_path):
    monkeypatch.setattr(X, "BLOCK", 16)
    fine = X.create_index(docs, str(tmp_path / "i"), range_tokens=3000)
    asked = spark.createDataFrame([(1, "license"), (1, "rare"), (2, "the"), (3, "gnu"), (3, "nowhere"), (4, "nowhere")], "query_id int, term string")
    best = X.top_k(fine, asked, 5)
    got = rows(best.rows, "query_id", "doc", "rank", "place")
    for q, terms in {1: ["license", "rare"], 2: ["the"], 3: ["gnu", "nowhere"]}.items():
        want = H.bm25(docs, terms).orderBy(F.round("rank", 9), "doc").limit(5).collect()
        assert [(d, r) for _, d, r, _ in sorted((x for x in got if x[0] == q), key=lambda x: x[3])] == [(r.doc, round(r["rank"], 9)) for r in want]
    assert not [x for x in got if x[0] == 4]
    assert best.needed.filter("query_id = 2").count() < best.blocks.filter("query_id = 2").count() / 2
    assert best.needed.filter("query_id = 1").count() < best.blocks.filter("query_id = 1").count()


def test_a_query_opens_the_folders_of_its_terms_alone(stored):
    folders = len(list(Path(stored.at(stored.state["segments"][0]["name"], "postings")).glob("range=*")))
    assert folders > 5
    rare, prefix = X.postings(stored, ["rare"]), X.postings(stored, [], ["vers"])
    assert rare.folders <= 2 and prefix.folders < folders / 2
    opened = {f.split("range=")[1].split("/")[0] for f in prefix.rows.inputFiles()}
    assert len(opened) == prefix.folders
    assert {r.term for r in prefix.terms.collect()} == {"version", "verso"}
    assert "places" not in X.bm25(stored, ["rare"])._jdf.queryExecution().executedPlan().toString()


def files(index, segment):
    return sorted((str(p), p.stat().st_mtime_ns, p.stat().st_size) for p in Path(f"{index.path}/{segment}").rglob("*") if p.is_file())


def test_batches_updates_and_deletes(spark, docs, tmp_path):
    a, b = spark.createDataFrame(some(400), SCHEMA), spark.createDataFrame(some(120, 2, 350), SCHEMA)
    stored = X.create_index(a, str(tmp_path / "i"), range_tokens=2000)
    first = stored.state["segments"][0]["name"]
    before = files(stored, first)
    stored = X.add(stored, b)
    assert [f for f in files(stored, first) if "/graves/" not in f[0]] == before  # the older segment is as it was; a list of its dead lies beside
    gone = spark.createDataFrame([(3,), (360,), (99_999,)], "doc bigint")
    stored = X.delete(stored, gone)
    stored = X.delete(stored, gone)  # again is nothing
    left = a.join(b, "object_id", "left_anti").unionByName(b).join(gone.withColumnRenamed("doc", "object_id"), "object_id", "left_anti").persist()
    assert stored.n_docs == left.count()

    def same(index):
        for q in Q[:3]:
            assert rows(X.search_page(index, 20, **q), "doc", "rank", "place") == rows(H.search_page(left, 20, **q), "doc", "rank", "place")
        counted = H.build_index(left).groupBy("term").agg(F.count("*").alias("tf"), F.count_distinct("doc").alias("df"))
        assert rows(X.dictionary(index), "term", "tf", "df") == rows(counted, "term", "tf", "df")

    same(stored)
    same(X.open_index(spark, stored.path))
    merged = X.merge(X.merge(stored, at=2), at=1)
    assert len(merged.state["segments"]) < len(stored.state["segments"]) or all(s["dead"] == 0 for s in merged.state["segments"])
    assert sum(s["dead"] for s in merged.state["segments"]) == 0
    same(merged)
    left.unpersist()


def test_of_two_writers_one_fails_and_a_torn_manifest_is_passed_over(spark, tmp_path):
    stored = X.create_index(spark.createDataFrame(some(30), SCHEMA), str(tmp_path / "i"))
    X.add(stored, spark.createDataFrame(some(5, 3, 100), SCHEMA))
    with pytest.raises(Exception, match="(?i)exist"):
        X.add(stored, spark.createDataFrame(some(5, 4, 200), SCHEMA))
    assert X.open_index(spark, stored.path).n_docs == 35
    (tmp_path / "i" / "manifest" / "00000009.json").write_text('{"version": 9, "seg')
    assert X.open_index(spark, stored.path).n_docs == 35


def test_odd_batches(spark, tmp_path):
    empty = X.create_index(spark.createDataFrame([], SCHEMA), str(tmp_path / "e"))
    assert empty.n_docs == 0 and X.bm25(empty, ["x"]).collect() == [] and X.search_page(empty, 5, **Q[1]).collect() == [] and X.dictionary(empty).collect() == []
    blank = X.create_index(spark.createDataFrame([(1, None, None), (2, "", " ")], SCHEMA), str(tmp_path / "b"))
    assert blank.n_docs == 2 and X.search_page(blank, 5, **Q[0]).collect() == []
    with pytest.raises(ValueError, match="key"):
        X.create_index(spark.createDataFrame([(None, "a", "b")], SCHEMA), str(tmp_path / "n"))
    with pytest.raises(ValueError, match="one key"):
        X.create_index(spark.createDataFrame([(1, "a", "b"), (1, "c", "d")], SCHEMA), str(tmp_path / "d"))


def test_tasks_and_blocks_are_bounded_in_tokens(spark, docs, tmp_path, monkeypatch):
    monkeypatch.setattr(X, "TASK_TOKENS", 400)
    stored = X.create_index(docs, str(tmp_path / "i"), range_tokens=3000)
    found = X.entries(stored, spark.read.parquet(stored.at(stored.state["segments"][0]["name"], "postings")).withColumn("segment", F.lit(stored.state["segments"][0]["name"])))
    sizes = [r for r in found.groupBy("block").agg(F.sum("tf").alias("tokens"), F.count_distinct("doc").alias("docs")).collect() if r.docs > 1]
    assert max(r.tokens for r in sizes) < 4 * 400  # 256 documents of the longest class have 70,000
    assert rows(X.tokens(stored, ["of"]), "doc", "pos") == rows(H.build_index(docs).filter("term = 'of'"), "doc", "pos")


def test_many_deleted_documents_are_taken_off_without_a_shuffle_of_postings(spark, docs, stored, tmp_path, monkeypatch):
    gone = docs.filter("object_id % 3 = 0").select(F.col("object_id").alias("doc"))
    left = H.build_index(docs.filter("object_id % 3 <> 0")).groupBy("term").agg(F.count("*").alias("tf"), F.count_distinct("doc").alias("df"))
    monkeypatch.setattr(X, "FEW", 0)
    found = X.dictionary(X.delete(X.create_index(docs, str(tmp_path / "i")), gone))
    assert rows(found, "term", "tf", "df") == rows(left, "term", "tf", "df")
    assert not any("/postings" in f for f in found.inputFiles())


def test_little_is_shuffled_when_an_index_is_built(spark, docs, tmp_path):
    def shuffled():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    docs.count()  # made by a shuffle of their own
    before = shuffled()
    stored = X.create_index(docs, str(tmp_path / "i"), range_tokens=30_000)
    written = sum(f[2] for t in ("docs", "postings") for f in files(stored, f"{stored.state['segments'][0]['name']}/{t}"))
    assert shuffled() - before < 2 * written  # neither texts nor unfolded postings are
