"""The pipeline on the smallest tables, stage by stage, and its odd rows."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        after = docs.count()
        assert 0 < after <= before, name
        assert docs.columns == columns or i == len(corpus_pipeline.STAGES) - 1
        before = after
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(str(tmp_path / "3")).collect()}
    assert {r["doc_id"]: r["text"] for r in docs.collect()} == texts
    assert corpus_pipeline.run(spark, SF).count() == before


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_queries_match_their_sql(spark):
    import duckdb

    from veilframe.llm.queries import ORACLES, QUERIES

    base = duckdb.connect()
    for name in os.listdir(SF):
        base.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    for name, sql in ORACLES.items():
        got, expected = QUERIES[name](spark, SF).toPandas(), base.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(expected.columns)
        plain = lambda x: sorted(tuple(map(str, r)) for r in x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False))
        assert plain(got) == plain(expected), name


def test_stages_take_odd_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, verdict string, gone int"
    rows = [(1, "the cat and the dog", "en", "a", 19, "x", 1), (1, "the cat and the dog", "en", "a", 19, "x", 1), (None, "der Hund", None, None, None, None, None), (2, None, "de", "b", None, None, None), (3, "", "de", "b", 0, None, None), (4, "word " * 30_000, "en", "c", 150_000, None, None)]
    for table in (rows, []):
        docs = spark.createDataFrame(table, schema)
        for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{len(table)}-{i}")
            stage(spark, docs, SF).write.parquet(path)
            docs = spark.read.parquet(path)
        assert docs.count() <= len(table)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")
def test_stages_by_brute_force(spark, tmp_path):
    """Each stage's rows against plain Python on what the stage before it kept."""
    import tiktoken
    from test_dedup import fingerprint_by_hand, judged_by_hand, lines_by_hand

    from veilframe.llm import byte_bpe, language_id, line_dedup
    from veilframe.llm.queries import PATTERN, RANKS

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(docs.collect())
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
    kept.append(docs.collect())
    first, identified, cleaned, unlike, clean, tokens = kept

    rows = spark.read.parquet(f"{SF}/documents.parquet")
    rejected = {r["doc_id"] for r in language_id.identify(rows, language_id.train(rows)).filter("rejected").collect()}
    assert sorted(r["doc_id"] for r in identified) == sorted(r["doc_id"] for r in first if r["doc_id"] not in rejected)

    expected = lines_by_hand([(r["doc_id"], r["text"], r["source"]) for r in identified], line_dedup.MIN_SITES)
    assert {r["doc_id"]: r["text"] for r in cleaned} == {k[0]: v for k, v in expected.items()}
    assert all(r["n_chars"] == len(r["text"]) for r in cleaned)

    prints = {r["doc_id"]: fingerprint_by_hand(r["text"]) for r in cleaned}
    label = {i: i for i in prints}
    for i, a in prints.items():
        for j, b in prints.items():
            if i < j and (a ^ b).bit_count() <= 3 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if x == high else x for k, x in label.items()}
    assert {r["doc_id"] for r in unlike} == set(label.values()) and len(unlike) == len(set(label.values()))

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in unlike if not judged_by_hand(r["text"], items)[3]}

    library = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.PieceEncoder(RANKS, PATTERN).ranks, special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in clean}
    assert {r["doc_id"]: (r["ids"], r["n_tokens"], r["text"]) for r in tokens} == {i: (ids := library.encode_ordinary(t), len(ids), t) for i, t in texts.items()}
