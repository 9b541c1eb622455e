"""Cases in which an operator once did less than its whole job."""

import random

import numpy as np

from pagemill.llm import line_templates, toxicity


def kept(spark, bodies):
    """Texts by number after recurring lines are taken out."""
    rows = spark.createDataFrame(list(enumerate(bodies)), "doc_id long, text string")
    return {r.doc_id: r.text for r in line_templates.drop_recurring(rows).collect()}


def test_lines_that_differ_in_content_stay(spark):
    names = ["paris", "rome", "oslo", "bern", "kyiv"]
    for line in ("{k},{v},4.5", "https://example.org/{v}/{k}", "9f{k}a{v}" + "x" * 100_000, "中{v}在19{k}年成立", "3 {k} 15", "{k} {k} {k}"):
        lines = [line.format(k=10 + k, v=v) for k, v in enumerate(names)]
        assert kept(spark, lines) == dict(enumerate(lines)), line


def test_copies_of_a_line_of_fields_go(spark):
    for line in ("12,paris,4.5", "3 14 15", "Call 555 1234 or mail x@y.z for order 17"):
        assert kept(spark, [line] * 3 + ["Call 555 9876 to hear of the other one"]) == {0: line, 1: "", 2: "", 3: "Call 555 9876 to hear of the other one"}


def test_a_masked_field_among_constant_tokens_is_still_one(spark):
    assert kept(spark, [f"Posted by user{k} on Monday" for k in range(3)]) == {0: "Posted by user0 on Monday", 1: "", 2: ""}


def test_recurring_lines_go_whatever_else_is_in_their_leaf(spark):
    masked = "Call our office now or write to us at x@y.z about order 17"
    other = "Call our office {} if you need any help with that second matter"
    assert len(masked.split()) == len(other.split())
    texts = [masked] * 3 + [other.format(w) for w in ("soon", "later", "today")] + ["Call our office a b c d e f g h i j"]
    assert kept(spark, texts) == {k: t if k in (0, 3, 6) else "" for k, t in enumerate(texts)}


def test_a_field_value_in_many_documents_is_a_field(spark):
    line = "The account of user {} was opened again from the city of {} by the front desk"
    texts = [line.format(u, c) for u in ("alice", "bob", "carol", "dave") for c in ("paris", "rome", "oslo", "bern")]
    assert kept(spark, texts) == {k: "" if k else texts[0] for k in range(16)}


def test_a_long_line_recurs_from_two_documents_on(spark):
    long, short = " ".join(f"word{chr(97 + k)}" for k in range(20)), "a line of few words"
    assert kept(spark, [f"{short}\n{long}", f"{long}\n{short}"]) == {0: f"{short}\n{long}", 1: short}


def test_the_rejecting_model_comes_last_in_the_chain():
    from pagemill.llm.registry import CATEGORIES

    assert CATEGORIES[-1] == "toxic" and len(CATEGORIES) > 1


def text_of(rate, words, seed):
    r = random.Random(seed)
    return " ".join(f"insult{r.randrange(5)}" if r.random() < rate else f"word{r.randrange(400)}" for _ in range(words))


def features(text):
    counts, found = toxicity.term_counts(text), {}
    for word, n in counts.items():
        for b in toxicity.buckets_of(word):
            found[b] = found.get(b, 0) + n
    return np.array(list(found), np.int32), np.array(list(found.values()), np.float32) / sum(counts.values())


def test_a_toxic_text_is_caught_at_any_length():
    made = [features(text_of(0.05 * (k % 2), 200, k)) for k in range(200)]
    y = np.array([k % 2 for k in range(200)], dtype=float)
    model = toxicity.fit([b for b, _ in made], [s for _, s in made], y, np.zeros((200, 0)))
    for words in (200, 2000, 20_000, 60_000):
        for toxic in (0, 1):
            at, share = features(text_of(0.05 * toxic, words, 999 + words))
            assert (toxicity.predict(model, [at], [share], np.zeros((1, 0)))[0] >= 0.5) == toxic, (words, toxic)
