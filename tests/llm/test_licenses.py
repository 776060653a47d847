"""Licence notices with one word edited, told apart from notices worded alike; and the SQL on the same rows."""
import random

import duckdb

from segment_lab.llm import licenses

ALONE = {"mit", "apache", "gpl"}  # labels that base phrases give


def edits(words, told):
    """Every text one word away: replaced, left out or put in, the telling words kept together."""
    at = next((p for p in range(len(words)) if told and words[p:p + len(told)] == told), None)
    inside = set() if at is None else set(range(at, at + len(told)))
    for p in range(len(words)):
        if p not in inside:
            yield [*words[:p], "zebra", *words[p + 1:]]
            yield [*words[:p], *words[p + 1:]]
        if p and not {p - 1, p} <= inside:
            yield [*words[:p], "zebra", *words[p:]]


def test_one_edited_word(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for t, (label, text, key) in enumerate(licenses.TEMPLATES):
        for w in edits(licenses.template_words(text), licenses.template_words(key)):
            filler = [" ".join(rng.choice("amber birch cedar delta ember".split()) for _ in range(rng.randint(0, 9))) for _ in (0, 1)]
            rows.append((len(rows), f"{filler[0]} {' '.join(w)} {filler[1]}"))
            labels.append((t, label))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in licenses.scan(docs).collect()}
    for t, (label, text, _) in enumerate(licenses.TEMPLATES):
        mine = [k for k, x in enumerate(labels) if x[0] == t]
        assert sum(label in got[k] for k in mine) >= 0.9 * len(mine), text
    wrong = [(rows[k][1], got[k]) for k, (_, label) in enumerate(labels) if got[k] - {label, ""} - ALONE]
    assert not wrong, wrong[:3]


def test_notices_are_told_apart(spark):
    rows = [(t, text) for t, (_, text, _) in enumerate(licenses.TEMPLATES)]
    rows += [(100, "Licensed under the CC BY-NC 4.0"), (101, "We licensed the film under terms agreed by both."),
             (102, "It was released under the MIT umbrella."), (103, "Licensed under CC BY-NC-SA 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (set(filter(None, r.labels.split(","))), set(filter(None, r.base_labels.split(",")))) for r in licenses.scan(docs).collect()}
    for t, (label, text, _) in enumerate(licenses.TEMPLATES):
        assert got[t][0] == {label} | got[t][1], text
    assert got[100][0] == {"cc-by-nc"} and got[101][0] == set() and got[102][0] == set() and not got[103][0] & {"cc-by", "cc-by-nc"}


def test_only_ascii_letters_are_lowered(spark):
    docs = spark.createDataFrame([(1, "Licensed under CC BY-NC 4.0"), (2, "LIKE İT")], "doc_id long, text string")
    words = {r.doc_id: r.w for r in docs.select("doc_id", licenses._words("text").alias("w")).collect()}
    assert words == {1: "licensed under cc by nc 4 0".split(), 2: ["liKe", "İt"]}


def test_sql_agrees_on_edited_notices(spark):
    rows = [(k, " ".join(w)) for k, w in enumerate(w for label, text, key in licenses.TEMPLATES[:14]
                                                   for w in edits(licenses.template_words(text), licenses.template_words(key)))]
    rows += [(5000, None), (5001, ""), (5002, "the quick " * 300 + "Licensed under CC BY 4.0 " * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.scan(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cur = con.execute(licenses.oracle())
    names = [c[0] for c in cur.description]
    assert sorted(map(str, cur.fetchall())) == sorted(str(tuple(r)) for r in got.select(*names).collect())
