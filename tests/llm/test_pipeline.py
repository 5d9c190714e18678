import re

import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out, folder = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in P.STAGES:
        stage(spark, out[-1], SF).write.parquet(str(folder / name))
        out.append(spark.read.parquet(str(folder / name)))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "contamination", "private", "tokens"]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    sizes = [s.count() for s in stages]
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] == sizes[5] > 0


def test_each_stage_against_brute_force(spark, stages):
    from tests.llm.test_minhash import brute

    rows = [(r.doc_id, r.text) for r in stages[1].collect()]
    kept = {d for d, (_, c) in brute(rows, 5, 80).items() if c == d}
    assert {r.doc_id for r in stages[2].select("doc_id").collect()} == kept
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = lambda t: re.sub(r"[^\w]+", " ", t.lower())
    left = {r.doc_id for r in stages[3].select("doc_id").collect()}
    for r in stages[2].collect():
        if any(plain(i) in plain(r.text) for i in items):
            assert r.doc_id not in left
    assert not [r for r in stages[4].collect() if re.search(r"mail\d\.example\.com", r.text) and r.text in {x.text for x in stages[3].collect()}]


def test_run_gives_the_last_stage(spark, stages):
    out = P.run(spark, SF)
    assert out.columns == stages[-1].columns
    assert sorted(map(str, out.select("doc_id", "n_tokens").collect())) == sorted(map(str, stages[-1].select("doc_id", "n_tokens").collect()))


def test_edge_cases_at_every_stage(spark, stages, tmp_path):
    """Nulls, empty and very long texts, repeated rows and extra columns pass through; an empty table stays empty."""
    plain = stages[0].limit(40).collect()
    kind = "doc_id long, text string, lang string, source string, n_chars int, score string, token string"
    good = next(r.text for r in stages[4].collect() if len(r.text) > 200)
    rows = [(r.doc_id, r.text, r.lang, r.source, len(r.text), "s", "t") for r in plain]
    rows += [(10_000, None, None, None, None, None, None), (10_001, "", "en", "a", 0, "s", "t"), (None, good, "en", "a", 1, "s", "t"), (None, good, "en", "a", 1, "s", "t")]
    rows += [(10_002, (good + " ") * 400, "en", "a", 1, "s", "t"), (10_003, good + " mine and yours", "en", "a", 1, "s", "t"), (10_003, good + " mine and yours", "en", "a", 1, "s", "t")]
    for k, table in enumerate((spark.createDataFrame(rows, kind), spark.createDataFrame([], kind))):
        docs = table
        for name, stage in P.STAGES:
            out = stage(spark, docs, SF)
            assert name == "tokens" or out.columns == table.columns
            out.write.parquet(str(tmp_path / f"{name}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}{k}"))
        assert (docs.count() == 0) == (k == 1)
    near = spark.read.parquet(str(tmp_path / "near_duplicates0"))
    assert near.where("doc_id IS NULL OR doc_id = 10003").count() <= 1


def test_tokens_and_private_against_plain_versions(spark, stages):
    from tokenizers import Tokenizer

    from dunlin.llm.bpe import default_vocabulary

    tok = Tokenizer.from_file(default_vocabulary())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].collect():
        ids = tok.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.token_ids) == ids and r.n_tokens == len(ids) and r.decoded == tok.decode(ids, skip_special_tokens=False)
    assert all(r.n_chars == len(r.text) for r in stages[4].collect())
