"""The Jaccard join in large groups, against brute force; columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

from fslink.llm import jaccard_join
from tests.llm.test_operators import _brute_links


def family(rng, n, words, edits, name):
    base = [f"{name}{rng.randrange(3000)}" for _ in range(words)]
    made = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"edit{rng.randrange(10**6)}"
        made.append(" ".join(text))
    return made


@pytest.mark.parametrize("edits", [1, 3, 6])
def test_large_groups_equal_brute_force(spark, monkeypatch, edits):
    """Near and far texts of one group, copies among them, over many blocks and salts."""
    for name, value in (("BUCKET_BLOCK", 16), ("GROUP_BLOCK", 8), ("CENTRE_SAMPLE", 6), ("SALT_ROWS", 16)):
        monkeypatch.setattr(jaccard_join, name, value)
    rng = random.Random(edits)
    texts = family(rng, 70, 100, edits, "w") + family(rng, 30, 60, 1, "v") + family(rng, 3, 40, 1, "u")
    texts += rng.sample(texts, 25) + ["", None, "one two"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join_classes(rows).collect())
    links, root = _brute_links(texts)
    assert got == [(k, root[k], len(links[k])) for k in range(len(texts))]


def test_a_centre_no_text_is_near(spark, monkeypatch):
    """Chains: each text resembles the next, the ends don't resemble each other."""
    for name, value in (("GROUP_BLOCK", 4), ("CENTRE_SAMPLE", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    words = [f"w{k}" for k in range(400)]
    texts = [" ".join(words[4 * k : 4 * k + 100]) for k in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard_join.join_classes(rows).collect())
    links, root = _brute_links(texts)
    assert got == [(k, root[k], len(links[k])) for k in range(len(texts))] and {len(x) for x in links} != {39}


def test_names_of_the_operators_own_columns_clash_with_nothing(spark):
    names = "_own _own_id _id _hash _turn _stays doc own_id own_hash row_hash node root copy_of n_links turn sketch members leader tight low high block cluster salt bucket text_ its_id its_hash id hash".split()
    texts = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (3, None), (None, "g h i j k"), (4, " ")]
    rows = spark.createDataFrame(texts, "doc_id long, text string").withColumns({c: F.lit(f"own {c}") for c in names})
    kept = jaccard_join.one_of_each(rows)
    assert kept.columns == rows.columns
    found = kept.collect()
    assert sorted((r.doc_id or 0, r.text) for r in found if r.text) == [(0, "g h i j k"), (1, "a b c d e f"), (4, " ")]
    assert all(r[c] == f"own {c}" for r in found for c in names)
    assert len(jaccard_join.join_classes(rows).collect()) == len(texts)
