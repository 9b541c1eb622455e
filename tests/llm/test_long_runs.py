"""Long runs of the generalised pigeonhole are split without losing a link; one row of each component stays."""

import numpy as np
import pytest
from test_methods import all_links, classes

from pagemill.llm import pigeonhole


def family(n, seed, open_bits):
    """Distinct fingerprints that differ in ``open_bits`` bits only, so that whole partitions agree."""
    r = np.random.default_rng(seed)
    at = r.permutation(64)[:open_bits].astype(np.uint64)
    flips = (r.integers(0, 2, (n, open_bits)).astype(np.uint64) << at).sum(axis=1, dtype=np.uint64)
    return np.unique(np.uint64(0x0123456789ABCDEF) ^ flips)


@pytest.mark.parametrize("open_bits", [9, 20, 40])
def test_split_runs_keep_every_link(spark, monkeypatch, open_bits):
    monkeypatch.setattr(pigeonhole, "FEW_BITS", 6)
    fps = family(500, open_bits, open_bits)
    df = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    rows = pigeonhole.linked(df, 3, longest=40).collect()
    edges = [(np.int64(r.a).view(np.uint64), np.int64(r.b).view(np.uint64)) for r in rows]
    assert all(int(a) ^ int(b) and (int(a) ^ int(b)).bit_count() <= 3 for a, b in edges)
    assert classes(fps, edges) == classes(fps, all_links(fps, 3))


def test_long_runs_get_shorter(spark):
    fps = family(3000, 5, 40)
    mask = (1 << 12) - 1
    rows = [(0, 0, mask, int(f)) for f in (fps & ~np.uint64(mask)).view(np.int64)]
    runs = pigeonhole.bounded_runs(spark.createDataFrame(rows, "part int, value long, used long, fp long"), 3, 50)
    assert runs.select("fp").distinct().count() == len({r[3] for r in rows})
    assert runs.groupBy("part", "value").count().agg({"count": "max"}).first()[0] <= 600


def test_one_row_of_each_component_stays(spark):
    text = "a b c d e f"
    rows = [(None, text, 1), (None, text, 1), (5, text, 2), (5, "other words stand in this one", 3), (1, text, 4), (7, None, 5), (8, "", 6), (8, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int").withColumnRenamed("row", "a")
    kept = pigeonhole.without_near_copies(docs).collect()
    assert sorted((r.doc_id, r.text, r.a) for r in kept) == [(1, text, 4), (5, "other words stand in this one", 3), (7, None, 5)]
    copies = pigeonhole.without_near_copies(docs.filter("doc_id is null"))
    assert [(r.doc_id, r.text) for r in copies.collect()] == [(None, text)]
