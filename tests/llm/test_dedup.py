"""Line removal, SimHash, components and decontamination against plain Python."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import decontamination, line_dedup, simhash
from veilframe.llm.graph import connected_components


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 50)] + [(5, 5), (None, 4), (7, None)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            parent[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u long, v long")
    got = {r["node"]: r["component"] for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(df.limit(0)).count() == 0
    names = spark.createDataFrame([("b", "a"), ("c", "b"), ("x", "y")], "u string, v string")
    assert {r["node"]: r["component"] for r in connected_components(names).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}


def fingerprint_by_hand(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choices(["a", "B", " ", "\n", "É", "\xa0", "\x1c", "x y", "\x0b"], k=rng.randint(0, 40)))
        assert simhash.fingerprint(text.encode()) % (1 << 64) == fingerprint_by_hand(text), text


@pytest.mark.parametrize("distance,segments", [(3, 8), (1, 4), (2, 4), (3, 4), (5, 8)])
def test_links_are_all_pairs_within_the_distance(spark, distance, segments):
    rng = random.Random(distance)
    prints = set()
    for _ in range(60):
        base = rng.getrandbits(64)
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(0, distance + 2)):
                x ^= 1 << b
            prints.add(x)
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "rep long, fp long")
    got = {(r["u"], r["v"]) for r in simhash.links(df, distance, segments).collect()}
    assert got == {(i, j) for i, x in rows for j, y in rows if i < j and (x ^ y).bit_count() <= distance}
    with pytest.raises(ValueError):
        simhash.links(df, segments, segments)


@pytest.mark.parametrize("distance,segments", [(3, 8), (2, 4), (1, 4)])
def test_crowded_keys_connect_the_same(spark, distance, segments):
    rng = random.Random(20 + distance)
    base, prints = rng.getrandbits(64), set()
    for _ in range(400):
        x = base
        for b in rng.sample(range(64), rng.randint(0, 7)):
            x ^= 1 << b
        prints.add(x)
    prints |= {rng.getrandbits(64) for _ in range(20)}
    rows = list(enumerate(sorted(prints)))
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in rows], "rep long, fp long")
    got = simhash.links(df, distance, segments, crowded=20)
    links = {(r["u"], r["v"]) for r in got.collect()}
    assert all((rows[u][1] ^ rows[v][1]).bit_count() <= distance for u, v in links)
    every = {r["node"]: r["component"] for r in connected_components(simhash.links(df, distance, segments)).collect()}
    assert {r["node"]: r["component"] for r in connected_components(got).collect()} == every


def documents(spark):
    rng = random.Random(6)
    words = ["w%d" % i for i in range(60)]
    texts = []
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(60, 200))
        for _ in range(rng.randint(1, 4)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "one", "one", "One", "two words"]
    return texts


def test_near_duplicates(spark):
    texts = documents(spark)
    rows = [(i + 10, t, "k", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept_id string, fp int")
    prints = [fingerprint_by_hand(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):  # least reachable, by passes until nothing changes
        for j in range(len(texts)):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    got = {r["doc_id"]: r["component_id"] for r in simhash.components(df).collect()}
    assert got == {i + 10: x + 10 for i, x in enumerate(label)}
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {x + 10 for x in label}


def test_near_duplicates_of_odd_rows(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c"), (None, "a b c"), (None, "z")], "doc_id long, text string")
    assert sorted(str(r["doc_id"]) for r in simhash.deduplicate(df).collect()) == ["1", "None", "None"]
    assert simhash.components(df.limit(0)).count() == simhash.deduplicate(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [simhash.BROADCAST_DUPLICATES, 0])
def test_near_duplicates_with_one_id(spark, monkeypatch, most):
    """Rows of one doc_id with unlike texts are unlike documents; one row of each component stays."""
    monkeypatch.setattr(simhash, "BROADCAST_DUPLICATES", most)
    rng = random.Random(17)
    texts = [t for t in documents(spark) if t]
    rows = [(rng.randrange(30), rng.choice(texts), "x") for _ in range(300)]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "doc_id long, text string, k1 string")
    prints = {t: fingerprint_by_hand(t) for _, t, _ in rows}
    label = {p: p for p in prints.values()}
    for a in list(label):
        for b in list(label):
            if (a ^ b).bit_count() <= 3 and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = {k: low if x == high else x for k, x in label.items()}
    least = {}
    for i, t, _ in rows:
        least[label[prints[t]]] = min(i, least.get(label[prints[t]], i))
    kept = simhash.deduplicate(df)
    assert kept.columns == df.columns
    assert sorted((label[prints[r["text"]]], r["doc_id"]) for r in kept.collect()) == sorted(least.items())
    found = simhash.components(df).collect()
    assert len(found) == len(rows) and all(least[label[r["fp"] % (1 << 64)]] == r["component_id"] for r in found)
    two = spark.createDataFrame([(1, "a b c d e"), (1, "wholly other words here now")], "doc_id long, text string")
    assert simhash.deduplicate(two).count() == 2


def lines_by_hand(rows, min_sites):
    places, sites = {}, {}
    for doc_id, text, source in rows:
        for pos, line in enumerate((text or "").split("\n") if text is not None else []):
            key = line.strip(line_dedup.ENDS)
            if key and doc_id is not None:
                places.setdefault(key, set()).add((doc_id, pos))
                sites.setdefault(key, set()).update([source] if source is not None else [])
    gone = {p for key, found in places.items() if len(sites[key]) >= min_sites for p in found if p != min(found)}
    return {(d, t, s): None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d, i) not in gone) for d, t, s in rows}


@pytest.mark.parametrize("most", [line_dedup.BROADCAST_LINES, 0])
def test_lines_of_rows_with_one_id(spark, monkeypatch, most):
    """Lines are cut out of the text that has them, not out of another text with its doc_id."""
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    rng = random.Random(23)
    rows = [(rng.randrange(40), "\n".join(rng.choice(["shared", f"own {i}", "other shared", f"precious {i}"]) for _ in range(4)), f"s{i % 20}") for i in range(200)]
    rows.append((3, "precious A\nprecious B", "s1"))
    got = sorted((r["doc_id"], r["text"]) for r in line_dedup.remove_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), 10).collect())
    assert len(got) == len(rows) and (3, "precious A\nprecious B") in got
    own = lambda t: [x for x in t.split("\n") if x and not x.endswith("shared")]
    assert sorted((i, own(t)) for i, t in got) == sorted((i, own(t)) for i, t, _ in rows)
    left = [x for _, t in got for x in t.split("\n") if x.endswith("shared")]
    assert sorted(left) == ["other shared", "shared"]


@pytest.mark.parametrize("min_sites", [2, 5, 40])
def test_lines(spark, min_sites):
    rng = random.Random(min_sites)
    common = ["line %d" % i for i in range(12)] + ["", "  ", "\t"]
    rows = []
    for d in range(300):
        text = "\n".join(rng.choice([*common[: 1 + d % 15], f"own {d}", " line 3\r"]) for _ in range(rng.randint(0, 9)))
        rows.append((d, text, f"s{rng.randrange(60)}" if d % 11 else None))
    rows += [(300, None, "s1"), (None, "line 0\nline 1", "s2"), (301, "line 0\n" * 30, "s3")]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, source string, gone int, line_doc string")
    got = line_dedup.remove_boilerplate(df, min_sites)
    assert got.columns == df.columns
    expected = lines_by_hand(rows, min_sites)
    assert sorted(str((r["doc_id"], r["text"])) for r in got.collect()) == sorted(str((k[0], v)) for k, v in expected.items())
    removed = line_dedup.remove_boilerplate(df, min_sites, removed_into="gone").agg(F.sum("gone")).first()[0]
    count = lambda t: 0 if t is None else t.count("\n") + 1
    emptied = sum(v == "" and count(k[1]) > 0 and k[1] != "" and all(x.strip() for x in k[1].split("\n")) for k, v in expected.items())
    assert removed == sum(count(k[1]) - count(v) for k, v in expected.items()) + emptied
    assert line_dedup.remove_boilerplate(df.limit(0)).count() == 0


def words_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def judged_by_hand(text, items, window=13):
    words, hit, found = words_by_hand(text), set(), set()
    for item, body in items:
        own = words_by_hand(body)
        n = min(window, len(own))
        for k in range(len(own) - n + 1) if own else []:
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(str(item))
    return len(words), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(words), hit


def benchmark_case(spark):
    rng = random.Random(12)
    vocabulary = ["Aa", "b", "É", "c3", "d", "中"]
    items = [(i, " ".join(rng.choices(vocabulary, k=n))) for i, n in enumerate([20, 13, 14, 5, 5, 30])] + [(9, ""), (10, None), (11, "!?"), (12, "solo"), (0, "again another item of the same id x y z q w e r t")]
    texts = [None, "", "...", "Solo", "it is solo, SOLO!"]
    for _ in range(80):
        parts = rng.choices(vocabulary, k=rng.randint(0, 60))
        at = rng.randint(0, len(parts))
        body = rng.choice(items)[1] or ""
        texts.append("-".join(parts[:at]) + ", " + body.upper() * rng.randint(0, 1) + " " + "  ".join(parts[at:]))
    return items, texts


def test_decontamination(spark):
    items, texts = benchmark_case(spark)
    benchmark = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    docs = spark.createDataFrame([(i, t, "v", "a", 0) for i, t in enumerate(texts)] + [(None, items[0][1], "v", "a", 0)], "doc_id long, text string, verdict string, at string, match_id int")
    got = {r["doc_id"]: r["judged"] for r in decontamination.judge(docs, benchmark, into="judged").collect()}
    for i, text in [*enumerate(texts), (None, items[0][1])]:
        n, hits, found, bad, _ = judged_by_hand(text, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) == (n, hits, found, bad), text
    kept = decontamination.remove_documents(docs, benchmark)
    assert kept.columns == docs.columns and kept.count() == sum(not got[i]["contaminated"] for i in got)
    cut = {r["doc_id"]: r["text"] for r in decontamination.remove_spans(docs, benchmark).collect()}
    for i, text in enumerate(texts):
        *_, hit = judged_by_hand(text, items)
        assert words_by_hand(cut[i]) == [w for k, w in enumerate(words_by_hand(text)) if k not in hit], text


def test_decontamination_by_a_shuffle(spark):
    items, texts = benchmark_case(spark)
    texts.append(f"{items[0][1]} and {items[1][1]}")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame([*enumerate(texts), (None, items[0][1])], "doc_id long, text string")
    judged = decontamination.judge(docs, benchmark, max_windows=3)
    got = {r["doc_id"]: r["verdict"] for r in judged.collect()}
    assert got == {r["doc_id"]: r["verdict"] for r in decontamination.judge(docs, benchmark).collect()}
    assert got[len(texts) - 1]["items"] == ["0", "1"]
    for i, text in enumerate(texts):
        n, hits, found, bad, _ = judged_by_hand(text, items)
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) == (n, hits, found, bad), text
    assert decontamination.remove_documents(docs, benchmark, max_windows=3).count() == sum(not v["contaminated"] for v in got.values())


@pytest.mark.parametrize("most", [decontamination.BROADCAST_DOCS, 0])
def test_decontamination_of_rows_that_share_an_id_or_have_none(spark, monkeypatch, most):
    monkeypatch.setattr(decontamination, "BROADCAST_DOCS", most)
    rng = random.Random(13)
    items = [(i, " ".join(rng.choices("abcdefgh", k=20))) for i in range(5)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    texts = [f"own {i} " + (items[i % 5][1] if i % 2 else "clean words") for i in range(10_000)]
    crowd = spark.createDataFrame([(None if i % 4 else 7, t) for i, t in enumerate([*texts, texts[1], texts[1]])], "doc_id long, text string")
    got = decontamination.judge(crowd, benchmark).collect()
    assert len(got) == 10_002 and all(r["verdict"]["contaminated"] == ("clean" not in r["text"]) for r in got)
    assert all(r["verdict"]["n_words"] == len(r["text"].split()) for r in got)
    assert decontamination.remove_documents(crowd, benchmark).count() == 5_000
    thin = decontamination.verdicts(crowd, benchmark)
    assert thin.count() == 10_002 and thin.filter("verdict.contaminated").count() == 5_002


def test_decontamination_of_a_very_long_text(spark):
    body = "solo " * 3 + "w x " * 200_000 + " the end of all that is here and now for you and me"
    benchmark = spark.createDataFrame([(1, "the end of all that is here and now for you and me"), (2, "solo")], "item_id long, text string")
    docs = spark.createDataFrame([(1, body)], "doc_id long, text string")
    (row,) = decontamination.verdicts(docs, benchmark).collect()
    n, hits, found, bad, _ = 400_016, 16, ["1", "2"], False, None
    assert (row["verdict"]["n_words"], row["verdict"]["n_hit"], row["verdict"]["items"], row["verdict"]["contaminated"]) == (n, hits, found, bad)
    assert decontamination.remove_spans(docs, benchmark).first()["text"] == "w x " * 200_000 + " "


def test_decontamination_of_nothing(spark):
    benchmark = spark.createDataFrame([(1, "")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert decontamination.remove_documents(docs, benchmark).count() == 1
    assert decontamination.judge(docs.limit(0), benchmark).count() == 0
    with pytest.raises(ValueError):
        decontamination.build(docs.withColumnRenamed("doc_id", "item_id"), max_windows=0)
