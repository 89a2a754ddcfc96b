import re

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as cp
from tidepanel.llm import minhash, pii, quality, toxicity


def test_stages_are_the_operators_over_what_is_left(spark):
    """Every stage against its operator's own decisions, on whole small tables."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs]
    for _, stage in cp.STAGES:
        out = stage(spark, seen[-1], sf)
        seen.append(spark.createDataFrame(out.collect(), out.schema))
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == cp.COLUMNS for d in seen[:-1])
    assert ids[1] == {r.doc_id for r in quality.line_quality(docs).where("kept").collect()}
    assert ids[2] == {r.doc_id for r in toxicity.score(seen[1], spark.read.parquet(f"{sf}/labels.parquet")).where("predicted = 0").collect()}
    assert ids[3] == {r.doc_id for r in minhash.near_duplicates(seen[2], k=5).where("kept").collect()}
    assert ids[4] == ids[3] == ids[5]
    for r in seen[4].collect():
        assert not pii.base_spans(r.text) and r.n_chars == len(r.text)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(library.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen[4].collect()}
    got = {}
    for r in seen[5].collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        assert r.doc_tokens == want[r.doc_id]
    assert got == want
    rows = cp.run(spark, sf).select("doc_id", "start", "length", "ids_crc32").collect()
    assert sum(r.length for r in rows) == sum(want.values())


def test_odd_rows_pass_through(spark, odd):
    labels = "/root/testdata/sf0.001"
    long = spark.createDataFrame([(None, " ".join(f"word{k}" for k in range(80)) + ". mail a.b@c.example.org")], "doc_id long, text string")
    docs = odd.select(*cp.COLUMNS).union(long.selectExpr("doc_id", "text", "'en'", "null", "0L"))
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, labels)
    rows = docs.collect()
    assert {r.doc_id for r in rows} == {None} and re.fullmatch(r"\d+", str(sum(r.length for r in rows)))


def test_texts_under_one_id_are_judged_each_for_itself(spark):
    text = lambda w: " ".join(f"{w}{k}" for k in range(60))
    a, b, c, d = (text(w) for w in "abcd")
    rows = [(3, a), (5, a), (5, b), (5, c), (5, c), (7, d), (7, d + " end"), (8, "")]
    docs = spark.createDataFrame([(i, x, "en", "s", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _ in range(2):
        kept = [(r.doc_id, r.text) for r in cp.near_duplicates(spark, docs.repartition(3), None).collect()]
        # of the two near copies under 7 one stays
        assert sorted(x for x in kept if x[0] != 7) == [(3, a), (5, b), (5, c), (8, "")]
        assert len(kept) == 5 and {x for x in kept if x[0] == 7} < {(7, d), (7, d + " end")}


def test_every_stage_takes_an_empty_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for k, (_, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, sf)
        assert out.count() == 0 and (k + 1 == len(cp.STAGES) or out.columns == cp.COLUMNS)
