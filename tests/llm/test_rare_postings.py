"""Near duplicates: documents are posted under their rarest signature values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobloom.llm import neardup
from tests.llm.test_llm import brute_components


def sharing(n: int, share: float, length: int = 100):
    """n documents that have a passage in common and are not linked by it, and a near copy of every tenth."""
    shared = [f"p{k}" for k in range(int(share * length))]
    rows = []
    for i in range(n):
        own = [f"d{i}x{k}" for k in range(length - len(shared))]
        rows.append((i, " ".join(own + shared)))
        if i % 10 == 0:
            rows.append((n + i, " ".join([*own[: len(own) - i % 7], *shared, "end"])))
    return rows


def profiles(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return neardup._profiles(docs, 4).where("n_shingles > 0")


def longest(posted):
    return posted.select(F.explode("keys").alias("key")).groupBy("key").count().agg(F.max("count")).first()[0]


def test_a_common_passage_makes_no_long_lists(spark, monkeypatch):
    """With 40 % of every set in common, no list is longer than the bound; by coordinates alone all documents would be in one."""
    monkeypatch.setattr(neardup, "CELL", 50)
    rows = sharing(1000, 0.4)
    p = profiles(spark, rows)
    plain = p.select(F.slice("keys", 1, neardup.PREFIX).alias("keys"))
    assert longest(plain) > 0.9 * len(rows)
    assert longest(neardup._chosen(p, p)) <= 50


def test_prefixes_of_pairs_over_the_least_agreement_meet(spark, monkeypatch):
    """Two documents that agree on M coordinates or more share a posted value, whatever is frequent."""
    monkeypatch.setattr(neardup, "CELL", 5)
    rng, rows = np.random.default_rng(3), []
    for i in range(60):
        kept = int(rng.integers(40, 100))
        rows.append((i, " ".join([f"p{k}" for k in range(kept)] + [f"d{i}x{k}" for k in range(100 - kept)])))
    p = profiles(spark, rows)
    every = {r["doc_id"]: r["keys"] for r in p.collect()}
    posted = {r["doc_id"]: (r["posted"] % (1 << 64), r["keys"]) for r in neardup._chosen(p, p).collect()}
    for i, (mask, keys) in posted.items():
        assert keys == [k for c, k in enumerate(every[i]) if mask >> c & 1] and len(keys) == neardup.PREFIX
    pairs = [(i, j) for i in every for j in every if i < j and sum(a == b for a, b in zip(every[i], every[j])) >= neardup.M]
    assert len(pairs) > 50
    assert all(set(posted[i][1]) & set(posted[j][1]) for i, j in pairs)


@pytest.mark.parametrize("share", [0.4, 0.7])
def test_links_beside_a_common_passage(spark, monkeypatch, share):
    for name, value in (("CELL", 20), ("GROUP_DOCS", 8), ("TILE", 4)):
        monkeypatch.setattr(neardup, name, value)
    rows = sharing(150, share) + [(900, None), (901, ""), (902, "one two")]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, 80).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 4, 80)
