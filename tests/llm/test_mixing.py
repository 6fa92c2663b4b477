"""The mix's copies against its plan: ids in several sources, null ids, equal rows, and both ways of joining."""

from collections import Counter

import pytest

from siltstone.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, draw int, copies string"


def text(n, k=0):
    return " ".join(f"w{k}" for _ in range(n))


@pytest.fixture
def two_sources(spark):
    """Ids that occur in two sources with texts of other lengths, and null ids."""
    rows = [(k % 37 if k % 5 else None, text(3 + k % 11, k), "A", None, 1, "x") for k in range(300)]
    rows += [(k % 37 if k % 5 else None, text(1 + k % 4, k), "B", None, 2, "y") for k in range(90)]
    rows += [(k, text(2, k), None, None, 2, "y") for k in range(40)] + [(None, None, "A", None, None, None), (1, "", "B", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


def check(docs, off=1):
    """Sums of each source in the copies that mixed() gives equal the plan, and are near the target."""
    plan = mixing.copies(docs).toPandas()
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    got = [r.asDict() for r in out.collect()]
    key = lambda r: (r["doc_id"], r["text"], r["source"])
    given = Counter(key(r.asDict()) for r in docs.collect())
    took = Counter(map(key, got))
    assert set(took) <= set(given) and all(took[k] <= 3 * given[k] for k in took)
    words = Counter()
    for r in got:
        words[r["source"]] += len((r["text"] or "").split())
    sizes = Counter()
    for r in docs.collect():
        sizes[r.source] += len((r.text or "").split())
    want = mixing.targets(dict(sizes))
    plan["source"] = [None if s != s or s is None else s for s in plan.source]
    for s, t in want.items():
        own = plan[[x == s for x in plan.source]]
        assert (own.source_size == sizes[s]).all() and own.target.iloc[0] == pytest.approx(t)
        assert words[s] == (own["size"] * own.copies).sum()
        assert abs(words[s] - t) <= off, (s, words[s], t)


def test_id_in_two_sources(two_sources):
    check(two_sources)


def test_id_in_two_sources_once(spark):
    """One id in two sources: each keeps its own copies."""
    rows = [(1000, text(50, 1), "A", None, None, None), (1000, text(3, 2), "B", None, None, None)] + [(k, text(7, k), "A", None, None, None) for k in range(60)] + [(k, text(5, k), "B", None, None, None) for k in range(60)]
    check(spark.createDataFrame(rows, SCHEMA), off=6)  # sums of sevens and a fifty


def test_equal_rows(spark):
    """A third of all rows are equal and have no id: as many of them as the plan says."""
    rows = [(None, text(6), "A", None, None, None)] * 100 + [(k, text(1 + k % 9, k), "A" if k % 3 else "B", None, None, None) for k in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(docs)
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_salted_join_agrees(two_sources, monkeypatch):
    want = sorted(map(str, mixing.copies(two_sources).collect()))
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(str, mixing.copies(two_sources).collect())) == want


def test_many_sources(spark):
    """Targets of thousands of sources, without a list of them, equal the ones in plain Python."""
    rows = [(k, text(1 + (k * k) % 23, k), None if k % 1000 == 7 else f"s{k % 1000}\U0001f600" if k % 3 else f"é{k % 1000}", None, None, None) for k in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    sizes = Counter()
    for _, t, s, *_ in rows:
        sizes[s] += len(t.split())
    got = {r.source: r.target for r in mixing.copies(docs).select("source", "target").distinct().collect()}
    assert got == pytest.approx(mixing.targets(dict(sizes)))
