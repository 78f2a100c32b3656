"""Token windows, the combination of their probabilities, and entities, against plain Python."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilframe.functions import gibberish
from veilframe.operators import windows
from veilframe.plans import Settings, scan

LABELS = ["O", "B-NAME", "I-NAME", "B-KEY", "I-KEY"]
MODEL = gibberish.from_counts({a: {b: 10 for b in gibberish.LETTERS} for a in gibberish.LETTERS}, gibberish.LETTERS, limit=0.0)


@pytest.mark.parametrize("size,overlap", [(4, 0), (4, 3), (64, 16), (1, 0)])
def test_windows(spark, size, overlap):
    texts = [list(range(n)) for n in (0, 1, 3, 4, 5, 10, 130)]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, segment_no int, input_ids array<int>")
    got = sorted((r["doc_id"], r["offset"], r["window_ids"]) for r in windows.token_windows(df, size, overlap).collect())
    step = size - overlap
    assert got == [(i, k, t[k : k + size]) for i, t in enumerate(texts) for k in range(0, len(t), step)]


@pytest.mark.parametrize("size,overlap", [(4, 4), (4, 5), (0, 0), (4, -1)])
def test_bad_windows(spark, size, overlap):
    with pytest.raises(ValueError):
        windows.token_windows(spark.createDataFrame([(1, [1])], "doc_id long, input_ids array<int>"), size, overlap)


@pytest.mark.parametrize("batch", [1, 3])
def test_predictions_combine(spark, batch):
    rng = random.Random(2)
    ids = {i: [rng.randrange(50) for _ in range(n)] for i, n in enumerate((1, 5, 17, 40))}

    class Uneven:
        labels = LABELS

        def predict(self, parts):
            return [np.array([[(x + k * 3 + len(p)) % 7 + 1.0 for k in range(5)] for x in p]) / 10 for p in parts]

    df = spark.createDataFrame([(i, 0, x) for i, x in ids.items()], "doc_id long, segment_no int, input_ids array<int>")
    predicted = windows.predict(windows.token_windows(df, 8, 3), Uneven(), 101, 102, batch)
    combined = windows.combine(predicted, df.select("doc_id", "segment_no", F.size("input_ids").alias("n_tokens")), 5)
    expected = {}
    for i, x in ids.items():
        total = np.zeros((len(x), 5))
        for k in range(0, len(x), 5):
            part = x[k : k + 8]
            total[k : k + len(part)] += Uneven().predict([[101, *part, 102]])[0][1:-1]
        expected |= {(i, a, b): v for (a, b), v in np.ndenumerate(total / total.sum(1, keepdims=True))}
    got = {(r["doc_id"], r["pos"], k): p for r in combined.collect() for k, p in enumerate(r["probs"])}
    assert got.keys() == expected.keys() and all(got[k] == pytest.approx(expected[k]) for k in got)
    best = {(r["doc_id"], r["pos"]): r["label"] for r in windows.best_labels(combined, LABELS).collect()}
    for i, x in ids.items():
        for a in range(len(x)):
            row = [expected[i, a, k] for k in range(5)]
            assert best[i, a] == LABELS[row.index(max(row))] or max(row) - row[LABELS.index(best[i, a])] < 1e-12


def spelled_by_hand(labels):
    found, current = [], None
    before, type_before = "O", None
    for i, label in enumerate([*labels, "O"]):
        prefix, _, kind = label.partition("-")
        kind = kind or "_"
        opens = prefix != "O" and (prefix == "B" or before == "O" or kind != type_before)
        if current and (prefix == "O" or opens):
            found.append((current[0], current[1], i - 1))
            current = None
        if opens:
            current = (kind, i)
        before, type_before = prefix, kind
    return found


def test_entities(spark):
    rng = random.Random(4)
    rows = [[rng.choice(LABELS) for _ in range(rng.randint(0, 12))] for _ in range(400)]
    df = spark.createDataFrame([(i, 0, p, x, 0.5) for i, r in enumerate(rows) for p, x in enumerate(r)], "doc_id long, segment_no int, pos int, label string, p double")
    got = {}
    for r in windows.entities(df).collect():
        got.setdefault(r["doc_id"], []).append((r["type"], r["first"], r["last"]))
    for i, r in enumerate(rows):
        assert sorted(got.get(i, []), key=lambda x: x[1]) == spelled_by_hand(r), r


def test_trim(spark):
    cases = [("NAME", "(Ann Lee).", "Ann Lee"), ("KEY", "\"ab+c=\" ", "ab+c=\""), ("NAME", "@ann_", "@ann_"), ("NAME", "...", ""), ("EMAIL", " a@b.cd,\n", "a@b.cd"), ("KEY", "_$x_", "$x_")]
    df = spark.createDataFrame([(i, t, v, e) for i, (t, v, e) in enumerate(cases)], "i int, tag string, v string, e string")
    for r in df.select("*", windows.trim(F.col("tag"), F.col("v")).alias("got")).collect():
        assert r["got"] == r["e"], r["v"]


def test_kept_entities(spark):
    cases = [("AMBIGUOUS", "long enough", False), ("USERNAME", "long enough", False), ("NAME", "Ann", False), ("NAME", "Single", False), ("NAME", "Ann Lee", True), ("KEY", "abcdefgh", False), ("KEY", "abcdefghi", True), ("IP_ADDRESS", "10.0.0.1", False), ("IP_ADDRESS", "81.2.69.160", True), ("IP_ADDRESS", "8.8.8.8", False), ("PASSWORD", "abcd", True), ("PASSWORD", "abc", False)]
    df = spark.createDataFrame([(t, v, e) for t, v, e in cases], "tag string, v string, e boolean")
    for r in df.select("*", windows.filters.keep_entity(F.col("tag"), F.col("v"), MODEL.is_gibberish).alias("got")).collect():
        assert r["got"] == r["e"], r


def test_model_branch_finds_the_spans_the_backend_says(spark):
    text = "x Ann Lee, met\r\nBob Ray. y"
    labels = {"Ann": "B-NAME", "Lee,": "I-NAME", "Bob": "B-NAME", "Ray.": "I-NAME"}

    class Tagger:
        labels = LABELS

        def __init__(self, by_id):
            self.by_id = by_id

        def predict(self, parts):
            return [np.eye(5)[[LABELS.index(self.by_id.get(x, "O")) for x in p]] * 0.995 + 0.001 for p in parts]

    df = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, text * 30)], "doc_id long, segment_no int, text string")
    tokens = windows.word_tokens(df.filter("doc_id = 1")).first()
    by_id = {}
    for i, o in zip(tokens["input_ids"], tokens["offset_mapping"]):
        if (word := text[o["s"] : o["e"]]) in labels:
            by_id[i] = labels[word]
    found = windows.model_findings(df, Tagger(by_id), MODEL, window_size=6, overlap=2, batch_size=2).collect()
    one = sorted((r["start"], r["end"], r["value"]) for r in found if r["doc_id"] == 1)
    assert one == [(2, 9, "Ann Lee"), (16, 23, "Bob Ray")]
    assert sum(r["doc_id"] == 3 for r in found) == 60 and all(r["score"] > 0.99 and r["value"] in r["context"] for r in found)


def test_library_tokens(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, 0, "héllo wörld"), (2, 0, None)], "doc_id long, segment_no int, text string")
    rows = {r["doc_id"]: r for r in windows.library_tokens(df, public_tokenizers.path("byte_bpe_50k.json")).collect()}
    assert rows[2]["input_ids"] == [] and rows[1]["offset_mapping"][-1]["e"] == 11


@pytest.mark.parametrize("prefix_space", [True, False])
def test_library_tokens_with_a_prefix_space(spark, tmp_path, prefix_space):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = {c: i for i, c in enumerate(sorted(tokenizers.pre_tokenizers.ByteLevel.alphabet()))} | {"ab": 256, "\u0120ab": 257}
    made = tokenizers.Tokenizer(tokenizers.models.BPE(vocabulary, [("a", "b"), ("\u0120", "ab")]))
    made.pre_tokenizer = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False)
    made.save(path := str(tmp_path / "byte_level.json"))
    df = spark.createDataFrame([(1, "ab ab"), (2, " ab"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in windows.library_tokens(df, path, **({} if prefix_space else {"prefix_space": False})).collect()}
    assert {i: r["input_ids"] for i, r in got.items()} == {1: [257 if prefix_space else 256, 257], 2: [257], 3: []}
    assert [tuple(x) for x in got[1]["offset_mapping"]] == [(0, 2), (2, 5)]


def varint(n):
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def field(number, value):
    """A protocol-buffer field: a number, or bytes with their length."""
    return varint(number << 3) + varint(value) if isinstance(value, int) else varint(number << 3 | 2) + varint(len(value)) + value


def classifier_file(path, table):
    """An ONNX file made by hand: logits are the rows of table that input_ids names; attention_mask is read, and changes nothing."""
    tensor = field(1, table.shape[0]) + field(1, table.shape[1]) + field(2, 1) + field(8, b"table") + field(9, table.astype("<f4").tobytes())
    node = lambda op, inputs, out, *attributes: b"".join(field(1, x) for x in inputs) + field(2, out) + field(4, op) + b"".join(field(5, a) for a in attributes)
    value = lambda name, kind, dims: field(1, name) + field(2, field(1, field(1, kind) + field(2, b"".join(field(1, field(2, d) if isinstance(d, bytes) else field(1, d)) for d in dims))))
    nodes = [
        node(b"Gather", [b"table", b"input_ids"], b"rows"),
        node(b"Cast", [b"attention_mask"], b"mask", field(1, b"to") + field(3, 1) + field(20, 2)),
        node(b"Sub", [b"mask", b"mask"], b"zero"),
        node(b"ReduceSum", [b"zero"], b"none", field(1, b"keepdims") + field(3, 0) + field(20, 2)),
        node(b"Add", [b"rows", b"none"], b"logits"),
    ]
    graph = b"".join(field(1, n) for n in nodes) + field(2, b"g") + field(5, tensor)
    graph += field(11, value(b"input_ids", 7, [b"n", b"t"])) + field(11, value(b"attention_mask", 7, [b"n", b"t"])) + field(12, value(b"logits", 1, [b"n", b"t", table.shape[1]]))
    path.write_bytes(field(1, 8) + field(7, graph) + field(8, field(1, b"") + field(2, 13)))


def test_a_model_in_an_onnx_file(spark, tmp_path):
    pytest.importorskip("onnxruntime")
    rng = np.random.default_rng(3)
    table = rng.normal(0, 2, (1 << 9, len(LABELS)))
    classifier_file(tmp_path / "model.onnx", table)
    backend = windows.OnnxBackend(str(tmp_path / "model.onnx"), LABELS)
    parts = [[1, 2, 3], [4], [5, 6]]
    for part, got in zip(parts, backend.predict(parts)):
        powers = np.exp(table[part])
        assert got == pytest.approx(powers / powers.sum(1, keepdims=True), abs=1e-5)
    text = " ".join(f"word{i} Other{i * i}" for i in range(200))
    tokenize = windows.WordTokens(lambda w: sum(map(ord, w)) % (1 << 9))
    df = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, None)], "doc_id long, segment_no int, text string")
    found = windows.model_findings(df, backend, MODEL, tokenize, window_size=32, overlap=8, batch_size=4).collect()
    best = [LABELS[int(table[i].argmax())] for i in tokenize([text])[0][0]]
    words = text.split(" ")
    expected = [(kind, " ".join(words[a : b + 1])) for kind, a, b in spelled_by_hand(best)]
    kept = [(k, v) for k, v in expected if len(v) > 3 and (k == "KEY" and len(v) > 8 or k == "NAME" and " " in v)]
    assert sorted((r["tag"], r["value"]) for r in found) == sorted(kept) and len(kept) > 20


def test_a_model_in_a_folder(spark, tmp_path):
    import json

    pytest.importorskip("onnxruntime")
    tokenizers = pytest.importorskip("tokenizers")
    made = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[CLS]": 0, "[SEP]": 1, "[UNK]": 2, "Ann": 3, "Lee": 4, "met": 5}, "[UNK]"))
    made.pre_tokenizer = tokenizers.pre_tokenizers.WhitespaceSplit()
    made.post_processor = tokenizers.processors.TemplateProcessing("[CLS] $A [SEP]", special_tokens=[("[CLS]", 0), ("[SEP]", 1)])
    made.save(str(tmp_path / "tokenizer.json"))
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {str(i): x for i, x in enumerate(LABELS)}}))
    table = np.zeros((8, len(LABELS)))
    table[:, 0], table[3, 1], table[4, 2] = 1, 9, 9
    classifier_file(tmp_path / "model.onnx", table)
    model = windows.from_folder(str(tmp_path))
    assert model["backend"].labels == LABELS and (model["first"], model["last"]) == (0, 1)
    df = spark.createDataFrame([(1, 0, "a.txt", "so Ann Lee met")], "doc_id long, segment_no int, filename string, text string")
    found = scan(df, Settings(MODEL, home_directory="/x/nobody9", **model)).collect()
    assert [(r["start"], r["end"], r["type"], r["text"]) for r in found] == [(3, 10, "NAME", "Ann Lee")]
    assert windows.from_folder(str(tmp_path), "fp16")["backend"].path.endswith("model_fp16.onnx") and model["backend"].path.endswith("/model.onnx")
    with pytest.raises(ValueError):
        windows.from_folder(str(tmp_path), "fp8")
    (tmp_path / "config.json").write_text(json.dumps({"id2label": {"1": "O"}}))
    with pytest.raises(ValueError):
        windows.from_folder(str(tmp_path))


def test_a_text_of_many_words(spark):
    import time

    df = spark.createDataFrame([(1, 0, "word and " * 100_000)], "doc_id long, segment_no int, text string")
    windows.model_findings(df.limit(0), windows.FakeBackend(LABELS), MODEL).count()
    began = time.perf_counter()
    assert windows.model_findings(df, windows.FakeBackend(["O", "B-NAME"]), MODEL, window_size=64, batch_size=64).count() >= 0
    assert time.perf_counter() - began < 60
    labels = ["O", "B-NAME", "I-NAME", "E-NAME", "S-KEY", "B-KEY", "I-KEY", "."]
    rng = random.Random(8)
    rows = [[rng.choice(labels) for _ in range(rng.randint(0, 14))] for _ in range(200)]
    tagged = spark.createDataFrame([(i, 0, p, x, 0.5) for i, r in enumerate(rows) for p, x in enumerate(r)], "doc_id long, segment_no int, pos int, label string, p double")
    got = {}
    for r in windows.entities(tagged).collect():
        got.setdefault(r["doc_id"], []).append((r["type"], r["first"], r["last"]))
    for i, r in enumerate(rows):
        assert sorted(got.get(i, []), key=lambda x: x[1]) == list(windows._runs(r)), r
