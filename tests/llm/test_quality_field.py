"""The field of the quality rules: exact likelihood, and labels that change inside a document."""
import os

import numpy as np
import pyarrow as pa
import pytest

from segment_lab.llm import quality
from segment_lab.llm.common import utf8

SF = "/root/testdata/sf0.01"


def log_likelihood(field, sequences, golds, penalty):
    """By listing every labelling."""
    total = 0.0
    for x, gold in zip(sequences, golds):
        score = {y: sum((x[t] @ field.emit) * y[t] for t in range(len(y))) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
                 for y in np.ndindex(*[2] * len(x))}
        total += score[tuple(gold)] - np.log(sum(np.exp(v) for v in score.values()))
    return total / len(sequences) - penalty / 2 * ((field.emit ** 2).sum() + (field.move ** 2).sum())


def test_the_fit_is_a_maximum():
    """No small step in any direction raises the likelihood."""
    rng = np.random.default_rng(2)
    sizes = [1, 5, 3, 4, 2, 5, 1, 4]
    xs = [np.c_[np.ones(n), rng.normal(size=n)] for n in sizes]
    golds = [(rng.random(n) < 0.5).astype(int) for n in sizes]
    field = quality.fit_field(xs, golds, penalty=0.05)
    best = log_likelihood(field, xs, golds, 0.05)
    for k in range(6):
        for step in (-0.02, 0.02):
            theta = np.r_[field.emit, field.move.ravel()]
            theta[k] += step
            assert log_likelihood(quality.Field(theta[:2], theta[2:].reshape(2, 2)), xs, golds, 0.05) < best


def test_one_label_a_sequence_or_one_a_line():
    rng = np.random.default_rng(3)
    xs, labels = [rng.normal(size=(n, 2)) for n in (3, 1, 4, 2)], [0, 1, 1, 0]
    a, b = quality.fit_field(xs, labels), quality.fit_field(xs, [np.full(len(x), v) for x, v in zip(xs, labels)])
    assert np.allclose(a.emit, b.emit) and np.allclose(a.move, b.move)


def test_splices_keep_every_line_and_move_the_ends():
    w = len(quality.FEATURES)
    xs = [np.ones((n, w)) for n in (2, 3, 1)]
    made, labels = quality.spliced(xs, [0, 1, 0])
    assert [len(x) for x in made] == [5, 5, 4] and [x.tolist() for x in labels] == [[0, 0, 1, 1, 1], [1, 1, 1, 0, 0], [0, 1, 1, 1]]
    for x in made:
        assert x[:, quality.FIRST].tolist() == [1] + [0] * (len(x) - 1) and x[:, quality.LAST].tolist() == [0] * (len(x) - 1) + [1]
    assert all((x == 1).all() for x in xs)


def test_spliced_documents_are_cut_where_they_change(spark):
    """Fitted on even ids; documents of odd ids, half good and half junk, are cut within a tenth of their lines."""
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    field = quality.train(docs.where("doc_id % 2 = 0"), labels)
    odd = docs.where("doc_id % 2 = 1").join(labels, "doc_id").orderBy("doc_id").select("text", "quality").collect()
    long = {q: [r.text for r in odd if r.quality == q and r.text.count("\n") >= 3] for q in (0, 1)}
    pairs = [p for good, junk in zip(long[1], long[0]) for p in ((good, junk), (junk, good))]
    assert len(pairs) >= 20
    near = 0
    for first, second in pairs:
        f = quality.base_rows(*utf8(pa.array([first, first + "\n" + second])))
        head, x = (f["owner"] == 0).sum(), f["x"][f["owner"] == 1]
        found = field.viterbi(x, np.zeros(len(x), int)).astype(int)
        turns = np.flatnonzero(np.diff(found)) + 1
        near += len(turns) > 0 and np.abs(turns - head).min() <= 0.1 * len(x)
    assert near >= 0.9 * len(pairs)
