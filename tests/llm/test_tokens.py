"""Token store, byte-level BPE and section counts against the libraries and plain Python."""

import base64
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
tokenizers = pytest.importorskip("tokenizers")

from veilframe.llm import byte_bpe, token_counts, token_store  # noqa: E402

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
WORDS = public_tokenizers.path("word_bpe_49k.json")


def texts_at_random(n, longest):
    rng = random.Random(11)
    parts = ["the ", "Thing", "'s", "'ll ", " don't", "\n\n", "   ", "\t", "é", "e\u0301", "中文", "😀", "12 ", "!!", "<|endoftext|>", "\xa0", "\x85", "İ", "ß", "ﬁ", "\x00", "a" * 40, " ", "½", "\u2028"]
    return ["".join(rng.choices(parts, k=rng.randint(0, longest))) for _ in range(n)]


def frame(spark, texts):
    rows = [(i, t, i, "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids int, bytes string")  # clashing names


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk,overlap", [(32_768, 256), (64, 16), (40, 20)])
def test_byte_bpe_is_the_librarys_at_any_chunk_size(spark, library, chunk, overlap):
    texts = [None, "", "same", "same", "z" * 500, " " * 300, "don't " * 60, *texts_at_random(120, 80)]
    texts += texts[-3:]  # repeated rows
    encoded = byte_bpe.encode(frame(spark, texts), RANKS, PATTERN, chunk, overlap)
    rows = {r["doc_id"]: r for r in byte_bpe.decode(encoded, RANKS, PATTERN).collect()}
    assert len(rows) == len(texts)
    assert sorted(map(str, byte_bpe.round_trip(frame(spark, texts), RANKS, PATTERN, chunk, overlap).collect())) == sorted(map(str, rows.values()))
    for i, text in enumerate(texts):
        assert rows[i]["ids"] == library.encode_ordinary(text or ""), (i, text)
        assert bytes(rows[i]["bytes"]) == (text or "").encode()


def test_byte_bpe_of_repeated_ids_and_empty_tables(spark, library):
    df = spark.createDataFrame([(1, "a b " * 50), (1, "a b " * 50), (1, "c"), (None, "a b " * 50)], "doc_id long, text string")
    rows = byte_bpe.encode(df, RANKS, PATTERN, 64, 16).collect()
    assert sorted(len(r["ids"]) for r in rows) == sorted([len(library.encode_ordinary("a b " * 50))] * 3 + [1])
    assert byte_bpe.encode(df.limit(0), RANKS, PATTERN).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.encode(df, RANKS, PATTERN, 10, 10)


def test_token_store_round_trip(spark, tmp_path):
    texts = [None, "", *texts_at_random(300, 60), "plain words only " * 400, "a <|endoftext|> b", "<|startoftext|>", "<|ENDOFTEXT|> x", "<|endoftext", "a<|endoftext|>b <|endoftext|>"]
    path = str(tmp_path / "store")
    token_store.write(frame(spark, texts), path, WORDS, 1)
    library = tokenizers.Tokenizer.from_file(WORDS)
    rows = {r["doc_id"]: r for r in token_store.read(spark, path).collect()}
    start = 0
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids + [1]
        assert rows[i]["ids"] == ids and rows[i]["start"] == start and rows[i]["n_tokens"] == len(ids), (i, text)
        assert rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    some = {r["doc_id"]: r["ids"] for r in token_store.read(spark, path, [5, 7, 300, 10_000]).collect()}
    assert some == {i: rows[i]["ids"] for i in (5, 7, 300)}
    blocks = spark.read.parquet(f"{path}/blocks")
    head = spark.read.parquet(f"{path}/dictionary").first()
    assert blocks.select("dict_sha256").distinct().first()[0] == head["sha256"] and head["id_bytes"] == 2
    assert token_store.read(spark, path, []).count() == 0


def test_token_store_of_rows_with_one_id(spark, tmp_path):
    rows = [(None if i % 2 else 4, f"text {i} " * (i % 7)) for i in range(400)]
    path = str(tmp_path / "store")
    token_store.write(spark.createDataFrame(rows, "doc_id long, text string"), path, WORDS, 1)
    got = token_store.read(spark, path).collect()
    library = tokenizers.Tokenizer.from_file(WORDS)
    expected = [library.encode(t, add_special_tokens=False).ids + [1] for _, t in rows]
    assert sorted(r["ids"] for r in got) == sorted(expected)
    got.sort(key=lambda r: r["start"])
    assert [r["start"] for r in got] == [sum(len(r["ids"]) for r in got[:i]) for i in range(len(got))]
    assert [r["doc_id"] for r in got] == [None] * 200 + [4] * 200


def test_token_store_of_few_and_of_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (2, "b"), (None, "n")], "doc_id long, text string")
    token_store.write(df, str(tmp_path / "few"), WORDS, 1)
    rows = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in token_store.read(spark, str(tmp_path / "few")).collect()))
    assert rows == [(0, None, 2), (2, 1, 2), (4, 2, 2), (6, 2, 2)]
    token_store.write(df.limit(0), str(tmp_path / "none"), WORDS, 1)
    assert token_store.read(spark, str(tmp_path / "none")).count() == 0


def test_a_store_refuses_a_foreign_dictionary(spark, tmp_path):
    a = str(tmp_path / "a")
    token_store.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), a, WORDS, 1)
    spark.read.parquet(f"{a}/dictionary").withColumn("sha256", F.lit("other")).write.parquet(f"{a}/d2")
    import shutil

    shutil.rmtree(f"{a}/dictionary")
    shutil.move(f"{a}/d2", f"{a}/dictionary")
    with pytest.raises(Exception, match="written with dictionary"):
        token_store.read(spark, a).collect()


@pytest.mark.parametrize("rule", token_counts.RULES)
@pytest.mark.parametrize("separator", ["\n", "the", "é"])
def test_section_counts(spark, library, rule, separator):
    texts = [None, "", "a\n\n\nb", *texts_at_random(150, 40)]
    got = {}
    for r in token_counts.count_sections(frame(spark, texts), RANKS, PATTERN, separator, rule).collect():
        got.setdefault(r["doc_id"], {})[r["section_no"]] = (r["n_bytes"], r["n_tokens"], r["n_crossing"])
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        owner, n = [], 0
        parts = raw.split(separator.encode())
        sizes = [len(p) + len(separator.encode()) for p in parts[:-1]] + ([len(parts[-1])] if parts[-1] or len(parts) == 1 else [])
        for k, size in enumerate(sizes):
            owner += [k] * size
        counts, crossing = [0] * len(sizes), [0] * len(sizes)
        for token in library.encode_ordinary(text or ""):
            mine = owner[n : n + len(library.decode_single_token_bytes(token))]
            n += len(mine)
            to = {"first": mine[0], "last": mine[-1], "most": max(sorted(set(mine)), key=mine.count)}[rule]
            counts[to] += 1
            crossing[to] += len(set(mine)) > 1
        assert [got[i][k] for k in sorted(got[i])] == list(zip(sizes, counts, crossing)), (i, text)
