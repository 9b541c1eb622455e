"""The memo of words of the training sample is bounded, whatever the vocabulary."""

import numpy as np

from pagemill.llm import toxicity as T


def test_the_memo_of_the_sample_is_bounded():
    memo, sizes, per_text = {}, [], 2_000
    for k in range(60):
        text = " ".join(f"word{k}x{n}" for n in range(per_text)) + " common common"
        at, share = T.shares_of(text, memo)
        alone = T.shares_of(text, {})
        assert np.array_equal(at, alone[0]) and np.array_equal(share, alone[1])
        sizes.append(len(memo))
    assert max(sizes) <= 40_000 + per_text + 2 < 60 * per_text
