"""Every operator and pipeline stage over nulls, empty and long texts, repeated rows, clashing columns and empty tables."""

import public_tokenizers
import pytest

from siltstone.llm import common, decontaminate, huffman, mainhtml, maxent, mixing, quality, simhash, topk, toxicity, urlfilter

PATH = public_tokenizers.path("word_bpe_49k.json")


def operators(labels, benchmark):
    return {
        "tokens": lambda d: huffman.token_output(d, PATH), "maxent": maxent.scored, "quality": lambda d: quality.quality(d, labels), "simhash": simhash.near_duplicates,
        "toxicity": lambda d: toxicity.toxicity(d, labels), "mix": mixing.mix,
    }


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, "A question of five words here? And the answer of five words."), (2, None), (3, ""), (None, "another item that nobody has ever written down anywhere")], "item_id long, text string")


@pytest.mark.parametrize("name", ["tokens", "maxent", "quality", "simhash", "toxicity", "mix"])
def test_odd_rows(name, odd_docs, no_docs, docs, labels, benchmark):
    f = operators(labels, benchmark)[name]
    got = f(odd_docs).collect()
    assert len(got) == odd_docs.count()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in odd_docs.select("doc_id").collect())
    assert f(no_docs).count() == 0


def test_learners_without_labels(odd_docs, labels):
    none = labels.limit(0)
    assert {r.score for r in quality.quality(odd_docs, none).collect()} == {1.0}
    assert {r.score for r in toxicity.toxicity(odd_docs, none).collect()} == {0.0}


def test_odd_values(odd_docs):
    by_id = {r.doc_id: r for r in huffman.token_output(odd_docs, PATH).collect() if r.doc_id}
    assert by_id[4].n_tokens == by_id[3].n_tokens == by_id[5].n_tokens == 1
    mixed = {r.doc_id: r for r in mixing.mix(odd_docs).collect() if r.doc_id}
    assert (mixed[3].size, mixed[4].size, mixed[9].size, mixed[6].size) == (0, 0, 1, 60_000)
    found = {r.doc_id: r for r in simhash.near_duplicates(odd_docs).collect() if r.doc_id}
    assert found[2].component_id == 1 and found[4].fingerprint == "0" * 16 and found[4].component_id == 3 == found[5].component_id


def test_leaks(spark, odd_docs, no_docs, benchmark):
    held = odd_docs.where("doc_id = 9").drop("text").crossJoin(spark.createDataFrame([("x " * 50 + "a question of five words here? and the ANSWER of five words. " + "y " * 50,)], "text string"))
    every = odd_docs.unionByName(held)
    assert [(r.doc_id, r.item_id) for r in decontaminate.leaks(every, benchmark).collect()] == [(9, 1)]
    assert decontaminate.leaks(no_docs, benchmark).count() == 0 == decontaminate.leaks(every, benchmark.limit(0)).count()
    left = decontaminate.clean(every, benchmark)
    assert left.columns == every.columns and left.count() == every.count() - 2  # both rows of id 9


@pytest.mark.parametrize("stage", ["good", "one_of_each", "clean", "mixed"])
def test_stages_keep_columns(stage, spark, odd_docs, no_docs, labels, benchmark):
    f = {"good": lambda d: quality.good(d, labels), "one_of_each": simhash.one_of_each, "clean": lambda d: decontaminate.clean(d, benchmark), "mixed": mixing.mixed}[stage]
    got = f(odd_docs)
    assert got.columns == odd_docs.columns
    n = got.count()
    assert n <= odd_docs.count() * (3 if stage == "mixed" else 1)
    assert f(no_docs).count() == 0


def test_pages(spark):
    rows = [(1, None, None, 1), (None, "http://a.net/de/1", "", 1), (2, "no scheme", "<p>unclosed <b>text", 1), (2, "no scheme", "<p>unclosed <b>text", 1), (3, "HTTP://A.EXAMPLE.NET/de/8?x#y", "<" * 1000, 1), (4, "x://", "&lt;&#228;&bogus;", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = mainhtml.extract(pages)
    assert got.count() == 6 and {r.text for r in got.where("page_id = 2").collect()} == {"unclosed text"} and got.where("page_id = 1").first().text == ""
    assert got.where("page_id = 4").first().text == "<ä&bogus;"
    judged = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages).collect()}
    assert (3, "a.example.net", "/de/8", "example.net/de/8", "block") in judged and (1, "", "", None, "allow") in judged and (None, "a.net", "/de/1", "net/de/", "block") in judged
    assert mainhtml.extract(pages.limit(0)).count() == 0 == urlfilter.judge(pages.limit(0)).count()


def test_clashing_columns_of_urls(spark):
    pages = spark.createDataFrame([(7, "https://sub.example.com/en/79", 1, 2, 3, 4)], "page_id long, url string, host int, path int, rule int, verdict int")
    assert [tuple(r) for r in urlfilter.judge(pages).collect()] == [(7, "sub.example.com", "/en/79", "example.com/en/7", "allow")]


def test_shared_folder(spark, monkeypatch):
    """A cluster needs a folder that all executors share; one process doesn't."""
    from types import SimpleNamespace

    def session(master, own=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *a: own), sparkContext=SimpleNamespace(master=master))

    assert common.shared_dir(session("local[4]")).startswith("file:") and common.shared_dir(session("yarn", "hdfs://x/y/")) == "hdfs://x/y"
    for master in ("yarn", "local-cluster[3,2,1000]", "spark://host:7077"):
        with pytest.raises(ValueError):
            common.shared_dir(session(master))


def test_clean_up(spark):
    kept = common.written(spark.range(5), "kept")
    assert kept.count() == 5
    common.clean_up(spark)
    assert not common._tables


def test_vectors(spark):
    one = [1.0] * 64
    rows = [(20, one, "a"), (20, one, "a"), (21, one, "b"), (22, [-1.0] * 64, "c"), (40, None, "d"), (None, one, "e"), (60, [1.0], "f"), (80, [None] + one[1:], "g")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, code string")
    got = [(r.query_id, r.neighbor_id, r.distance, r["rank"]) for r in topk.search(vectors, k=2).orderBy("query_id", "rank").collect()]
    assert got == [(20, 20, 0, 1), (20, 21, 0, 2), (80, 80, 0, 1), (80, 20, 1, 2)]
    assert topk.search(vectors.limit(0)).count() == 0


def test_repeated_and_conflicting_labels(spark):
    """An id with both labels, ids that many rows share, and a sample that is smaller than either: rows of their own, no label favoured."""
    from siltstone.llm.quality import labelled

    docs = spark.createDataFrame([(k % 50, f"text number {k} of the kind", "x") for k in range(2000)], "doc_id long, text string, draw string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(50)] + [(7, 0), (8, 1)], "doc_id long, toxic int")
    every = labelled(docs, labels, "toxic", 3, 1, 10_000, 8).collect()
    some = labelled(docs, labels, "toxic", 3, 1, 400, 8).collect()
    assert len(some) == 400 and {(r.doc_id, r.text, r.label) for r in some} < {(r.doc_id, r.text, r.label) for r in every}
    assert 0.3 < sum(r.label for r in some) / 400 < 0.7
    assert toxicity.train(docs, labels, 400, 2000).score(toxicity.train(docs, labels, 400, 2000).judge([b"text"]))[0] >= 0
    assert quality.quality(docs, labels.withColumnRenamed("toxic", "quality")).count() == 2000
    same = spark.createDataFrame([(3, "one text", "x")] * 30, "doc_id long, text string, draw string")
    assert labelled(same, labels.where("doc_id = 3"), "toxic", 99, 98, 10, 8).count() == 10
