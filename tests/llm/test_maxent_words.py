"""How many words the language model reaches, and how it groups them."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import maxent


def test_equal_counts_fill_the_known_words(spark):
    words = F.concat(F.lit("w"), "id").cast("binary").alias("word")
    v = maxent.vocabulary(spark.range(70_000).select(words, F.lit(1).cast("long").alias("n")))
    assert len(v.id) == maxent.KNOWN and v.tail[1].sum() == 70_000 - maxent.KNOWN == v.tail[0].sum()
    more = maxent.vocabulary(spark.range(70_000).select(words, F.when(F.col("id") < 100, 9).otherwise(1).cast("long").alias("n")))
    assert len(more.id) == maxent.KNOWN and (more.count[:100] == 9).all() and (more.count[100:] == 1).all()


def test_keys_of_spark_and_python(spark):
    words = [b"a", b"ab", b"xyz", b"\n", "\u00e9".encode(), b"\xff\xfe"]
    counts = spark.createDataFrame([(bytearray(w), k + 1) for k, w in enumerate(words)], "word binary, n long")
    v = maxent.vocabulary(counts)
    assert set(v.id) == set(words) and (v.tail == 0).all() and v.tokens == 21


def test_company_finds_groups():
    """Rows of three kinds of company, rare ones too."""
    rng = np.random.default_rng(0)
    kinds = rng.dirichlet(np.full(maxent.CONTEXTS, 0.1), 3)
    own = rng.integers(0, 3, 900)
    counts = np.stack([rng.multinomial(rng.integers(5, 400), kinds[k]) for k in own]).astype(np.float32)
    found = maxent.company(counts, 3)
    assert all(np.bincount(found[own == k], minlength=3).max() >= 0.95 * (own == k).sum() for k in range(3)) and len({np.bincount(found[own == k]).argmax() for k in range(3)}) == 3


def test_tree_is_whole():
    for n in (2, 15, 16, 17, 1000):
        root, children = maxent.tree(np.arange(1.0, n + 1))
        seen, held = [], [root]
        while held:
            for c in children[held.pop()]:
                (held if c >= n else seen).append(c)
        assert sorted(c for c in seen if c >= 0) == list(range(n)) and all(len(x) == maxent.WIDE for x in children.values())
