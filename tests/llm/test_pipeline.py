import corpus_pipeline
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF))
    return out


def test_stages_keep_the_columns_until_the_last(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "tokens"]
    for df in steps[:-1]:
        assert df.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert steps[-1].columns == ["doc_id", "ids", "n_tokens", "round_trip"]


def test_stages_do_what_their_operators_say(spark, steps):
    from test_near_copies import _naive
    from test_search_tokens_leaks import _naive_leaks

    from rinkspark.llm import personal_data, quality

    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    labels, benchmark = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("labels", "benchmark"))
    scored = quality.score(steps[0], labels)
    assert ids[1] == {r.doc_id for r in scored.where("predicted = 1").collect()}
    texts = {r.doc_id: r.text for r in steps[1].collect()}
    assert ids[2] == {d for d, c in zip(texts, _naive(list(texts), list(texts.values()))) if d == c}
    found = _naive_leaks([(r.doc_id, r.text) for r in steps[2].collect()], [(r.item_id, r.text) for r in benchmark.collect()])
    assert found and ids[3] == ids[2] - {d for d, _ in found}
    assert ids[4] == ids[3] and ids[5] == ids[4]
    assert not any(personal_data.base_spans(r.text) for r in steps[4].collect())
    assert all(r.round_trip for r in steps[5].collect())


def test_stages_pass_clashing_columns_nulls_and_repeated_rows_on(spark, docs_of):
    good = "The old river ran past the quiet mill where Anna wrote a long letter about her garden and the rain that fell all week. "
    rows = [(1, good), (1, good), (2, good + "Mail a.b@c.org now."), (3, None), (4, ""), (None, "Another plain line about bread and salt and the long way home over the green hills."), (5, "x " * 50_000)]
    docs = docs_of(rows)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns and after.schema == docs.schema
        docs = after
    last = corpus_pipeline.token_stage(spark, docs, SF).collect()
    assert all(r.round_trip for r in last) and len(last) == docs.count()
