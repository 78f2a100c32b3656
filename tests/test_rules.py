"""Detectors against Python's regex module and ipaddress, and cases by hand."""

import ipaddress
import random

import pytest
import regex
from pyspark.sql import functions as F

from veilframe.functions import filters, gibberish, patterns
from veilframe.functions.spans import occurrences
from veilframe.functions.text import is_blank, suffix, wrapped_context
from veilframe.operators import masking, plugins, rules

PY = {
    "EMAIL": patterns.EMAIL, "IP_ADDRESS": patterns.IP, "KEY": patterns.KEY,
}


def python_pattern(java: str) -> regex.Pattern:
    text = java.removeprefix(patterns.FLAGS).replace(r"\p{IsHan}", r"\p{Han}")
    return regex.compile(text, regex.MULTILINE)


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


def spans(df, column):
    return {r["doc_id"]: [(x["tag"], x["value"], x["start"], x["end"]) for x in r["s"]] for r in df.select("doc_id", column.alias("s")).collect()}


MODEL = gibberish.from_counts({a: {b: (1000 if (a + b) in ("th", "he", "er", "an", "in", "on", "at", "en", "nd", "ha", "es") else 5) for b in gibberish.LETTERS} for a in gibberish.LETTERS}, gibberish.LETTERS, limit=3.0)


def texts_at_random(n: int) -> list[str]:
    rng = random.Random(5)
    parts = ["a", "B7", "x.y", "@", "mail", "example.com", ".", "=", "-", ":", "1", "12", "255", "8.8.4.4", "fe80::1", "::", "ab:cd", "/", "/usr", " ", "\n", "\r\n", "中", " ", "é", "😀", "'", '"', "(", ")", ",", "k1k2k3k4", "+", "_", "﷐", "﷑"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(n)]


@pytest.mark.parametrize("tag,detect", [("EMAIL", rules.email_spans), ("IP_ADDRESS", rules.raw_ip_spans), ("KEY", rules.raw_key_spans)])
def test_spans_are_those_of_pythons_regex_module(spark, tag, detect):
    texts = texts_at_random(1500)
    pattern = python_pattern(PY[tag])
    found = spans(frame(spark, texts), detect(F.col("text")))
    for i, text in enumerate(texts):
        assert found[i] == [(tag, m.group(2), m.start(2), m.end(2)) for m in pattern.finditer(text)], text


def test_long_unbroken_texts_do_not_overflow_the_stack(spark):
    texts = ["a1" * 50_000, "x" * 100_000 + "@example.com", "/a" * 5_000, "1:" * 20_000, None, ""]
    df = frame(spark, texts)
    keys = spans(df, rules.raw_key_spans(F.col("text")))
    assert keys[0] == [("KEY", "a1" * 50_000, 0, 100_000)]
    assert keys[4] == keys[5] == []
    assert [x[1] for x in spans(df, rules.email_spans(F.col("text")))[1]] == ["x" * 100_000 + "@example.com"]
    assert len(spans(df, rules.ip_spans(F.col("text")))[3]) == 2222


def test_one_mail_in_a_line_of_code(spark):
    mail = "someone@mail.example"
    text = f'let contact = "{mail}"; // call'
    found = spans(frame(spark, [text]), rules.rule_spans(F.col("text"), MODEL, "regex", home_directory="/home/nobody1"))
    assert found[0] == [("EMAIL", mail, text.index(mail), text.index(mail) + len(mail))]
    with pytest.raises(ValueError):
        rules.rule_spans(F.col("text"), MODEL, "other")


def test_mails_that_share_a_delimiter_are_whole(spark):
    """A delimiter is only looked at, so that it serves the mail before it and the one after it."""
    a, b = "anna.12@mail1.example.com", "bert.34@mail2.example.com"
    between = [" ", "\n", ",", ";", "@", ": ", ". ", "\u00a0", "\u3000", "\x0b"]
    found = spans(frame(spark, [f"to{x}{a}{x}{b}{x}on" for x in between]), rules.email_spans(F.col("text")))
    for i, x in enumerate(between):
        first, second = 2 + len(x), 2 + 2 * len(x) + len(a)
        assert found[i] == [("EMAIL", a, first, first + len(a)), ("EMAIL", b, second, second + len(b))], repr(x)


def test_address_filters(spark):
    far = "x" * 300
    cases = {
        "at 81.2.69.160 now": ["81.2.69.160"],
        "(81.2.69.160)": [],  # no closing bracket on the right
        "81.2.69.160 81.2.69.161": ["81.2.69.160"],  # one separator between, taken up
        "81.2.69.160  81.2.69.161": ["81.2.69.160", "81.2.69.161"],
        "1.2.3.4": [],  # a version
        "dns 1.2.3.4": ["1.2.3.4"] if len("dns 1.2.3.4") + 4 - 100 < 0 else [],
        f"server {far} 1.2.3.4": [],
        "23.21.99.104": [],  # a date
        "33.01.33.33": [],  # a leading zero
        "x 2001:4860:4860::8888 y": ["2001:4860:4860::8888"],
        "a :: b": [],
    }
    found = spans(frame(spark, list(cases)), rules.ip_spans(F.col("text")))
    for i, (text, expected) in enumerate(cases.items()):
        assert [x[1] for x in found[i]] == expected, text
    public = spans(frame(spark, ["a 10.0.0.1 b", "a 8.8.8.8 dns", "a fe80::1 b", "a 81.2.69.160 b"]), rules.ip_spans(F.col("text"), public_only=True))
    assert [len(public[i]) for i in range(4)] == [0, 0, 0, 1]


def test_private_networks_are_those_of_ipaddress(spark):
    rng = random.Random(3)
    border = [n for x in filters.PRIVATE_NETWORKS for n in (int(ipaddress.ip_network(x)[0]) - 1, int(ipaddress.ip_network(x)[0]), int(ipaddress.ip_network(x)[-1]), int(ipaddress.ip_network(x)[-1]) + 1)]
    numbers = [n for n in border if 0 <= n < 1 << 32] + [rng.randrange(1 << 32) for _ in range(500)] + [int(ipaddress.ip_address(x)) for x in (*filters.NOT_PRIVATE, *filters.DNS_SERVERS)]
    texts = [str(ipaddress.ip_address(n)) for n in numbers] + ["01.2.3.4", "256.1.1.1", "1.2.3"]
    rows = frame(spark, texts).select("text", filters.excluded_address(F.col("text")).alias("out"), filters.not_an_address(F.col("text")).alias("bad")).collect()
    for r in rows:
        try:
            address = ipaddress.ip_address(r["text"])
            assert not r["bad"] and r["out"] == (address.is_private or r["text"] in filters.DNS_SERVERS), r["text"]
        except ValueError:
            assert r["bad"] and r["out"]


def test_ipv6_addresses_are_what_ipaddress_says(spark):
    rng = random.Random(6)
    group = lambda: rng.choice(["0", "1", "00ff", "FFFF", "2001", "db8", "fe80", f"{rng.randrange(65536):x}"])
    made = []
    for _ in range(800):
        parts = [group() for _ in range(rng.randint(0, 9))]
        if rng.random() < 0.3:
            parts.append(rng.choice(["1.2.3.4", "10.0.0.1", "8.8.8.8", "256.1.1.1", "1.2.3", "01.2.3.4"]))
        text = ":".join(parts)
        at = rng.randrange(len(text) + 1)
        made.append(text[:at] + rng.choice(["", ":", "::", "::"]) + text[at:] + rng.choice(["", "", "", ":", "%eth0"]))
    networks = [ipaddress.ip_network(x) for x in (*filters.PRIVATE_V6, *filters.NOT_PRIVATE_V6, filters.MAPPED)]
    border = [n for x in networks for n in (int(x[0]) - 1, int(x[0]), int(x[-1]), int(x[-1]) + 1) if 0 <= n < 1 << 128]
    made += [str(ipaddress.IPv6Address(n)) for n in border + [rng.randrange(1 << 128) for _ in range(100)]] + ["::", "::1", ":", ":::", "1::2::3", "::ffff:10.1.1.1", "::ffff:8.8.8.8", "::1.2.3.4"]
    made = [x for x in made if ":" in x]
    assert len(made) > 700

    def kind(text):
        try:
            return "private" if ipaddress.ip_address(text).is_private else "public"
        except ValueError:
            return "invalid"

    rows = frame(spark, made).select("text", filters.address_kind(F.col("text")).alias("k"), filters.excluded_address(F.col("text")).alias("out"), filters.not_an_address(F.col("text")).alias("bad")).collect()
    for r in rows:
        assert r["k"] == kind(r["text"]) and r["out"] == (r["k"] != "public") and r["bad"] == (r["k"] == "invalid"), r["text"]
    assert {r["k"] for r in rows} == {"invalid", "private", "public"}


@pytest.mark.parametrize("separator", ["/", "\\/"])
@pytest.mark.parametrize("home", ["/home/jdoe42", "/Users/j.doe+x", "/home/team/jdoe42/", "/jdoe42"])
def test_home_names(spark, home, separator):
    name = home.rstrip("/").rpartition("/")[2]
    path = home.rstrip("/").replace("/", separator)
    text = f"é {path}{separator}x {path}:1\n{path}2 /backup{path} {name}"
    found = spans(frame(spark, [text]), rules.home_name_spans(F.col("text"), home))[0]
    assert len(found) == 4 and {x[:2] for x in found} == {("NAME", name)}
    assert all(text[a:b] == name for _, _, a, b in found)


@pytest.mark.parametrize("home", ["/home/Ubuntu", "/root", "/", "", "/home/runner/"])
def test_shared_accounts_are_no_names(spark, home):
    assert spans(frame(spark, [f"{home}/x and /home/ubuntu"]), rules.home_name_spans(F.col("text"), home))[0] == []


def test_occurrences_of_a_literal(spark):
    rows = spark.createDataFrame([(0, "aXbXXc", "X"), (1, "aaa", "aa"), (2, "a.b\\E.", ".b\\E"), (3, "abc", ""), (4, None, "x"), (5, "😀k😀k", "k")], "doc_id int, text string, v string")
    found = spans(rows, occurrences(F.col("text"), F.col("v")))
    assert [[x[2:] for x in found[i]] for i in range(6)] == [[(1, 2), (3, 4), (4, 5)], [(0, 2)], [(1, 5)], [], [], [(1, 2), (3, 4)]]


def test_hash_gates(spark):
    digest = "d41d8cd98f00b204e9800998ecf8427e"
    rows = [(0, f"md5 = {digest}\n", True, False), (1, f"md5\nkey = {digest}\n", False, False), (2, "a share of it", False, True), (3, "\n" * 120 + "sha sha", False, False), (4, "\n" * 100 + "hash hash hash", False, True)]
    df = spark.createDataFrame(rows, "doc_id int, text string, line boolean, dense boolean")
    for r in df.select("*", filters.on_hash_line(F.col("text"), F.lit(digest)).alias("l"), filters.dense_in_hashes(F.col("text")).alias("d")).collect():
        assert (r["l"], r["d"]) == (r["line"], r["dense"]), r["doc_id"]


def test_plugins(spark):
    def found(text):
        return set(frame(spark, [text]).select(plugins.plugin_values(F.col("text")).alias("v")).first()["v"])

    token = "ghp_" + "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1eF3hJ5"
    assert found(f"x = '{token}'") >= {token}
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.c2lnbmF0dXJl"
    assert jwt in found(f"Bearer {jwt}") and found("Bearer eyJub3RqdHM.eyJub3RqdHM.x") == set()
    assert found('k = "123e4567-e89b-12d3-a456-426614174000"') == set()
    assert found('user_id = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == set()
    assert found('token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"') == {"24be64439e3e49cf46b2d7c90f3602a3d0b907ff"}
    assert found('n = "0123456789abcdef"') == set()
    keys = spans(frame(spark, ['token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" 24be64439e3e49cf46b2d7c90f3602a3d0b907ff', "sha " * 3]), plugins.plugin_keys(F.col("text"), MODEL._replace(limit=0.0)))
    assert len(keys[0]) == 2 and keys[1] == []


def test_what_a_text_needs_loses_no_finding(spark):
    """The cheap conditions are necessary ones: without them the findings are the same."""
    rng = random.Random(17)
    h, b = "0123456789abcdef", "ABCDEFGHIJabcdefghij0123456789"
    make = lambda signs, n: "".join(rng.choices(signs, k=n))
    shapes = [lambda: f"AKC{make(b, 12)}", lambda: f"x = 'AKIA{make('ABCDEF0123', 16)}'", lambda: f"AWS_secret_key = \"{make(b, 40)}\"", lambda: f"'{make(b, 30)}'", lambda: f"AccountKey={make(b, 88)}"]
    shapes += [lambda: f"CloudAnt_pw = {make(h, 64)}", lambda: f"https://u:{make(h, 64)}@a.CLOUDANT.com", lambda: f"gho_{make(b, 36)}", lambda: f"IAM_key='{make(b, 44)}'", lambda: f"cos_hmac_SECRET_access_key = {make(h, 48)}"]
    shapes += [lambda: f"{make(h, 32)}-us{rng.randrange(30)}", lambda: f"//r.io/:_authToken=npm_{make(b, 8)}", lambda: f"SG.{make(b, 22)}.{make(b, 43)}", lambda: f"xoxb-1-{make(b, 9)}", lambda: f"https://hooks.slack.com/services/T{make(b, 5)}/B{make(b, 5)}/{make(b, 9)}"]
    shapes += [lambda: f"SoftLayer_api_key: {make(h, 64)}", lambda: f"SL-token='{make(h, 64)}'", lambda: f"http://api.softlayer.com/soap/v3/{make(h, 64)}", lambda: f"rk_live_{make(b, 24)}", lambda: f"SK{make(h, 32)}", lambda: f"M{make(b, 23)}.{make(b, 6)}.{make(b, 27)}", lambda: "nothing"]
    df = frame(spark, [f"line\n{shape()} end" for shape in shapes for _ in range(6)])
    plain = tuple(p._replace(needs=()) for p in plugins.PLUGINS)
    rows = df.select("text", plugins.plugin_values(F.col("text")).alias("a"), plugins.plugin_values(F.col("text"), plain).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(bool(r["a"]) for r in rows) > 80


def test_functions_without_an_alias(spark):
    df = frame(spark, ["a@b.example 81.2.69.160 /home/jdoe42/x a1b2c3d4e5"])
    for column in (rules.email_spans(F.col("text")), rules.ip_spans(F.col("text")), rules.key_spans(F.col("text"), MODEL), rules.home_name_spans(F.col("text"), "/home/jdoe42"), plugins.plugin_keys(F.col("text"), MODEL), masking.mask_spans(F.col("text"), rules.ip_spans(F.col("text")))):
        assert df.select(column).count() == 1 and df.select(column).collect()


def test_text_functions(spark):
    names = {"a.py": ".py", "x/a.tar.gz": ".gz", ".bashrc": "", "a.": "", "d.e/f": "", "x/.y.z": ".z"}
    got = {r["text"]: r["s"] for r in frame(spark, list(names)).select("text", suffix(F.col("text")).alias("s")).collect()}
    assert got == names
    blank = frame(spark, ["", " \t\r\n", "\x1c\x1f　", " x", None]).select("doc_id", is_blank(F.col("text")).alias("b")).collect()
    assert [r["b"] for r in sorted(blank)] == [True, True, True, False, True]
    text = "".join(chr(97 + i % 26) for i in range(350))
    spots = [(0, 7), (50, 57), (99, 106), (100, 107), (340, 347), (345, 350)]
    df = spark.createDataFrame([(text, s, e) for s, e in spots], "text string, s int, e int")
    for r in df.select("s", "e", wrapped_context(F.col("text"), F.col("s"), F.col("e")).alias("c")).collect():
        assert r["c"] == text[r["s"] - 100 : r["e"] + 100]


def test_gibberish(spark, tmp_path):
    import json
    import math

    counts = {"a": {"a": 1, "b": 3}, "b": {"a": 4}}
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"charset": "ab", "ngram_size": 2, "counts": counts}))
    model = gibberish.load(str(path), limit=0.5)
    rows = frame(spark, ["ab", "aab", "a-b", "", "zz", "bb"]).select("doc_id", model.score(F.col("text")).alias("s")).collect()
    got = {r["doc_id"]: r["s"] for r in rows}
    p = lambda x: -math.log(x)
    assert got[0] == pytest.approx(p(0.75)) and got[1] == pytest.approx((p(0.25) + p(0.75)) / 2) and got[2] == got[0]
    assert got[3] is None and got[4] is None and got[5] == pytest.approx(p(0.125))
    trained = gibberish.train(frame(spark, ["abab BA", None]))
    assert trained.log_p["ab"] == pytest.approx(0.0) and set(trained.log_p) == {"ab", "ba"}
