"""The rules of line templates against their SQL, on lines made to meet every rule."""

import random

import duckdb
import pytest

from pagemill.llm import line_templates
from pagemill.llm.registry import ORACLE, QUERIES

LINES = [
    "Page {n} of {n}", "Copyright {n} Acme Ltd", "see http://x.y/{n} now ok", "mail {w}@x.org or a_{w}@b_c@d for help", "Chapter {n}", "{n} {n}",
    "{n},{w},4.5", "the mayor of {w} resigned", "中{n}在19{n}年成立", "| {n} | {w} | {n} |", "{w} likes 3 {w} in {n}", "a://{w} b://", "<*> and {w}",
    "The account of user {w} was opened again from the city of {w} by the front desk",
    "In this long notice of {w} terms each reader finds out what may not be copied from here on by {w} or any other at all times",
    "please call us now if you have any question on {w}", "please call us now if you have one question on {n} items", "   ", "", "\t{w}\x0b{n}\f",
]


def made(seed):
    r = random.Random(seed)
    words = ["paris", "rome", "oslo", "bern", "é", "user7"]
    line = lambda: "".join(r.choice(LINES)).replace("{n}", "%N").replace("{w}", "%W")

    def filled():
        text = line()
        while "%N" in text or "%W" in text:
            text = text.replace("%N", str(r.randrange(1, 40)), 1).replace("%W", r.choice(words), 1)
        return text

    return [(k, None if k == 5 else "\n".join(filled() for _ in range(r.randrange(1, 9)))) for k in range(r.choice([12, 60]))]


@pytest.mark.parametrize("seed", range(4))
def test_query_equals_its_statement(spark, tmp_path, seed):
    rows = made(seed)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op4_line_templates"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == sorted(con.sql(ORACLE["op4_line_templates"]).fetchall())
    assert sum(n for _, _, n, *_ in got) > 0


def test_footers_go_and_sentences_stay(spark):
    towns = ["paris", "rome", "oslo", "bern", "kyiv", "riga", "lima"]
    footers = ["Page {k} of 90", "Copyright 19{k} Acme Ltd", "see http://x.y/{k} now ok", "Last changed on {k} May by the editors"]
    sentences = ["the mayor of {v} resigned", "{v} won again", "we went to {v} by train", "{k},{v},4.5"]
    texts = ["\n".join(x.format(k=10 + k, v=v) for x in footers + sentences) for k, v in enumerate(towns)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_templates.drop_recurring(docs).collect()}
    assert got[0] == texts[0].split("\n")
    assert all(got[k] == texts[k].split("\n")[4:] for k in range(1, 7))


def test_any_column_names_are_passed_on(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, "the same line") for k in range(4)], "doc_id long, text string")
    names = ["__id", "__text_hash", "__drops", "drops", "row", "line", "leaf", "template", "a", "b"]
    docs = docs.withColumns({c: F.col("doc_id") for c in names})
    got = line_templates.drop_recurring(docs).collect()
    assert all(r[c] == r.doc_id for r in got for c in names) and sum(r.n_dropped for r in got) == 3
    counted = docs.withColumns({"n_lines": F.lit(8), "n_dropped": F.lit(9)})
    assert [tuple(r)[-2:] for r in line_templates.without_recurring(counted).collect()] == [(8, 9)]
    with pytest.raises(ValueError):
        line_templates.drop_recurring(counted)


def test_lines_are_known_by_their_tokens_and_not_taken_apart(spark):
    r = random.Random(4)
    blanks = [" ", "  ", "\t", " \x0b", "\f ", "\r", "   "]
    words = ["a", "b7", "x@y", "u://v", "<*>", "é", "9", "\u00a0"]
    bodies = [r.choice(["", *blanks]) + "".join(r.choice(words) + r.choice(blanks) for _ in range(r.randrange(4))) + r.choice(["", "a", "a b"]) for _ in range(400)]
    docs = line_templates.keyed(spark.createDataFrame([(1, "\n".join(bodies))], "doc_id long, text string"), "doc_id", "text")
    lines = line_templates.lines_of(docs.select(*line_templates.KEY, "text"), 3, 20)
    found = {x.line_no: (x.leaf, tuple(x.line)) for x in lines.collect()}
    assert set(found) == {k for k, b in enumerate(bodies) if b.strip(" \t\x0b\f\r")}

    def spaced(body):
        return " ".join(body.translate(str.maketrans("\t\x0b\f\r", "    ")).replace("\u00a0", "~").split()).replace("~", "\u00a0")

    again = spark.createDataFrame([(1, "\n".join(map(spaced, bodies)))], "doc_id long, text string")
    again = line_templates.lines_of(line_templates.keyed(again, "doc_id", "text").select(*line_templates.KEY, "text"), 3, 20)
    assert found == {x.line_no: (x.leaf, tuple(x.line)) for x in again.collect()}
    # most lines are named as they stand: their tokens are cut out only inside a branch
    plan = lines._jdf.queryExecution().optimizedPlan().toString()
    assert "slice(" not in plan and "substring_index(" in plan
