import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from corpora import prose

from tablerisk.llm import factorisation as fm


def junk(seed, n):
    rng = random.Random(seed)
    return " ".join(w + rng.choice(["%%%", "&&&", "***"]) for w in prose(seed, n).split())


@pytest.fixture(scope="module")
def mixed(spark):
    rows = [(k, junk(k, 80) if k % 4 == 0 else prose(k, 80), "en", "s", None if k % 7 == 0 else 400) for k in range(400)]
    labels = [(k, int(k % 4 != 0), 0) for k in range(0, 400) if k % 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_linear_time_score_equals_all_pairs():
    model = fm.FactorisationMachine.new(rank=5, seed=1)
    rng = np.random.default_rng(2)
    model.linear[:] = rng.normal(0, 1, fm.SIZE)
    model.base[0] = 0.3
    texts = ["", prose(1, 30), "a a b", junk(2, 12)]
    x = fm.features(pa.array(texts), np.array([0, -1, 5, 100]))
    got = model.parts(x)[0]
    for d in range(len(texts)):
        place, value = (side[x.first[d] : x.first[d + 1]] for side in (x.place, x.value))
        total = float(model.base[0]) + sum(float(model.linear[p]) * v for p, v in zip(place, value))
        for i in range(len(place)):
            for j in range(i + 1, len(place)):
                total += float(model.factors[place[i]] @ model.factors[place[j]]) * value[i] * value[j]
        assert got[d] == pytest.approx(total, abs=1e-4)


def test_gradient_lowers_the_loss_of_an_interaction():
    # neither feature alone tells the label, their product does
    place = np.array([[i, 2 + j] for i in (0, 1) for j in (0, 1)] * 50, np.int32)
    label = np.array([float(a != b - 2) for a, b in place], np.float32)
    x = fm.Sparse(place.ravel(), np.ones(place.size, np.float32), np.arange(0, place.size + 1, 2))
    model = fm.FactorisationMachine.new(rank=4, seed=3)
    model.fit(x, label, epochs=60, rate=0.1, decay=0.0, seed=3, batch=16)
    assert ((model.score(x) > 0.5) == label).all()


def test_held_out_accuracy_and_folds(mixed):
    docs, labels = mixed
    got = fm.classified(docs, labels).collect()
    assert len(got) == 400
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [r for r in got if r["held_out"]]
    assert sum(r["predicted"] == int(r["doc_id"] % 4 != 0) for r in held) >= 0.97 * len(held)


def test_scores_depend_on_text_and_length_alone(spark, mixed):
    from pyspark.sql import functions as F

    docs, labels = mixed
    other = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z")).repartition(2)
    flipped = labels.withColumn(  # labels of the fold that is held out teach nothing
        "quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    a, b = ({r["doc_id"]: r["score"] for r in fm.classified(*x).collect()} for x in ((docs, labels), (other, flipped)))
    assert a == b


def test_bound_on_labelled_rows(spark, mixed):
    docs, labels = mixed
    assert fm.labelled_features(docs.union(docs), labels, 0, 5, 30).count() == 30
    conflicting = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 0), (3, 0), (3, 1), (9999, 1)], "doc_id long, quality int")
    rows = fm.labelled_features(docs, conflicting, 0, 1_000_003, 30).collect()
    assert {r["doc_id"]: r["label"] for r in rows} == {1: 1, 3: 0}


def test_odd_rows(spark, odd_documents, odd_rows, no_documents):
    labels = spark.createDataFrame([(1, 1), (13, 0)], "doc_id long, quality int")
    got = fm.classified(odd_documents, labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 11}) == 1
    assert all(r["held_out"] for r in got if r["doc_id"] is None)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(0.4 < r["score"] < 0.6 for r in fm.classified(odd_documents, none).collect())
    assert fm.classified(no_documents, labels).count() == 0
    assert fm.classified(odd_documents.drop("n_chars"), labels).count() == len(odd_rows)
