"""Components of long chains of links."""

import random

from pagemill.llm import pigeonhole


def test_components_of_a_long_chain(spark):
    r = random.Random(3)
    chain = [r.getrandbits(63) for _ in range(500)]
    edges = spark.createDataFrame(list(zip(chain, chain[1:])), "a long, b long")
    assert {(x.v, x.label) for x in pigeonhole.components(edges).collect()} == {(v, min(chain)) for v in chain}
