import zlib

import pytest
from samples import TEXTS

from tidepanel.llm import toxicity


@pytest.mark.parametrize("sf", ["0.1"])
def test_held_out_accuracy(spark, sf):
    d = f"/root/testdata/sf{sf}"
    got = {r.doc_id: r for r in toxicity.op6_toxicity(spark, d).collect()}
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for i, r in got.items())
    held = [(got[r.doc_id].score, r.toxic) for r in spark.read.parquet(f"{d}/labels.parquet").collect() if got[r.doc_id].held_out]
    bad, good = [s for s, t in held if t], [s for s, t in held if not t]
    auc = sum((a > b) + 0.5 * (a == b) for a in bad for b in good) / len(bad) / len(good)
    caught, wrong = sum(s >= 0.5 for s in bad) / len(bad), sum(s >= 0.5 for s in good) / len(good)
    print("auc", auc, "caught", caught, "wrong", wrong, "brier", sum((s - t) ** 2 for s, t in held) / len(held))
    assert auc > 0.97 and caught > 0.85 and wrong < 0.02


def test_features():
    lexicon = (("moron", 1.0), ("idio", 2.0))
    f = dict(zip(toxicity.FEATURES, toxicity.features_of("You M0RON! i.d.i.o.t and moooron plain w0rd", lexicon)))
    assert (f["lexicon"], f["lexicon_kinds"], f["obfuscated"], f["near_you"], f["mixed"], f["weighted_sum"]) == (3 / 7, 2, 3 / 7, 3 / 7, 1 / 7, 4.0)
    assert toxicity.features_of(" \n", lexicon) == [0.0] * len(toxicity.FEATURES)


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(1, 13)] * 2, "doc_id long, quality int, toxic int")
    rows = toxicity.score(odd, labels).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    assert toxicity.score(none, labels).count() == 0
    assert {r.score for r in toxicity.score(odd, labels.where("false")).collect()} == {0.0}


def test_scores_do_not_depend_on_partitions(spark):
    d = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    runs = [{r.doc_id: (r.predicted, r.score) for r in toxicity.score(x, labels).collect()} for x in (docs, docs.repartition(7, "text"), docs.orderBy("text").repartition(3))]
    for other in runs[1:]:
        assert {i: p for i, (p, _) in other.items()} == {i: p for i, (p, _) in runs[0].items()}
        assert all(abs(s - runs[0][i][1]) < 1e-9 for i, (_, s) in other.items())
