import hashlib

import pytest

import corpus_pipeline
from auditloom.llm import bpe, langid, mixing, secret_scan
from auditloom.llm.queries import ORACLE, QUERIES
from tests.llm.cases import docs
from tests.llm.cases import rows as case_rows
from tests.llm.test_chosen_path import brute
from tests.llm.test_mixing import brute as brute_mix
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


def test_stages_are_the_operators_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "secret scans", "mixing sources to target weights", "BPE encoding and decoding"]


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    rows, columns = [tuple(r) for r in docs.collect()], docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(path := f"{tmp_path}/{k}")
        new = spark.read.parquet(path)
        got = sorted((tuple(r) for r in new.collect()), key=repr)
        if k == 0:
            want = [r for r, ok in zip(rows, langid.verdicts(model, [r[1] for r in rows])[2]) if ok]
        elif k == 1:
            root = {r[0]: r[0] for r in rows}
            pairs = brute([(r[0], r[1]) for r in rows])
            for _ in rows:
                for a, b in pairs:
                    root[a] = root[b] = min(root[a], root[b])
            want = [r for r in rows if root[r[0]] == r[0]]
        elif k == 2:
            texts = [secret_scan._blank(r[1], secret_scan.findings(r[1])) for r in rows]
            want = [(r[0], t, r[2], r[3], len(t)) for r, t in zip(rows, texts)]
        elif k == 3:
            copies = brute_mix([(r[0], r[1], r[3]) for r in rows], labels)
            want = [r for r in rows for _ in range(copies[r[0], r[3]])]
        else:
            enc, dec = bpe.coder()
            assert sorted((r.doc_id, tuple(r.token_ids), r.decoded_md5) for r in new.collect()) == sorted((r[0], tuple(enc.encode(r[1])), hashlib.md5(r[1].encode()).hexdigest()) for r in rows)
            assert new.where("not round_trip").count() == 0
            return
        assert new.columns == columns and got == sorted(want, key=repr), name
        docs, rows = new, want


def test_whole_run_is_the_stages_one_after_another(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.count() > 100 and got.columns == ["doc_id", "n_bytes", "n_tokens", "token_ids", "decoded_md5", "round_trip"]


def test_run_on_odd_rows_and_on_an_empty_table(spark, tmp_path):
    odd = [r for r in case_rows() if r[0] != 8]  # without the longest text, which other tests have
    for name, rows in (("odd", odd), ("none", [])):
        docs(spark, rows).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None), (9, 0, 1)] if rows else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    ids = {r.doc_id for r in got}
    assert got and 2 not in ids and ids <= {1, 3, 9, 10, 11, 12, None} and all(r.round_trip for r in got)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, name):
    n, diff = compare(QUERIES[name](spark, SF), ORACLE[name], SF)
    assert n and not diff


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_queries_without_sql_run(spark, name):
    # the smallest documents hold no secret
    assert QUERIES[name](spark, SF.replace("0.001", "0.01") if name == "op7_secret_scan" else SF).count() > 0


def test_mixture_weights_follow_the_labels(spark):
    df = mixing.quality_weights(spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int"))
    assert {r["__mix_id"]: r["__mix_w"] for r in df.collect()} == {1: 2.0, 2: 0.125, 3: 1.0}
