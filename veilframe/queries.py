"""The registered queries over the provided tables. Each applies an operator to a whole table and returns flat columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import filters, gibberish
from .functions.gibberish import BigramModel
from .functions.spans import extract, occurrences
from .functions.text import context, is_blank, normalize_newlines, suffix, wrapped_context
from .operators import masking, merging, plugins, rules, windows
from .plans.api import Settings, detect, mask, scan
from .sources.diffs import additions
from .sources.files import without_blank

LABELS = ["O", "B-NAME", "I-NAME", "B-KEY", "I-KEY", "B-EMAIL", "I-EMAIL"]
#: With all prefixes, and an outside tag of its own.
ALL_LABELS = ["O", "B-NAME", "I-NAME", "E-NAME", "S-KEY", "B-KEY", "I-KEY", "."]
HOME = "/home/src1"
#: Words as SQL finds them too.
WORD = r"()([^\x20\x09-\x0D]+)()"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as texts of files."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.lit(0).alias("segment_no"), F.concat(F.col("source"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("filename"), "text")


def _rows(df: DataFrame, spans: Column, *more: str) -> DataFrame:
    return df.select("doc_id", *more, F.explode_outer(spans).alias("x")).filter("x IS NOT NULL").select("doc_id", *more, "x.start", "x.end", "x.value")


_MODELS: dict[tuple[str, str], BigramModel] = {}


def _model(spark: SparkSession, sf_dir: str) -> BigramModel:
    """The bigram model of all documents; trained once a session and folder, as a user would once, and then load it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = gibberish.train(_table(spark, sf_dir, "documents"))
    return _MODELS[key]


def _settings(spark: SparkSession, sf_dir: str, **more) -> Settings:
    return Settings(_model(spark, sf_dir), home_directory=HOME, **more)


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, pos and x (a span) of every word of the documents."""
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode_outer(extract(F.col("text"), WORD, "WORD")).alias("pos", "x")).filter("x IS NOT NULL")


def ip_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "documents"), rules.ip_spans(F.col("text")))


def ip_public_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "documents"), rules.ip_spans(F.col("text"), public_only=True))


def ip_page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"), rules.ip_spans(F.col("html")))


def email_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "documents"), rules.email_spans(F.col("text")))


def email_page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "html"), rules.email_spans(F.col("html")))


def key_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "documents"), rules.key_spans(F.col("text"), _model(spark, sf_dir)))


def key_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rows(_table(spark, sf_dir, "documents"), rules.raw_key_spans(F.col("text")))


def home_name_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = lambda slash: F.concat(F.lit(f"{slash}home{slash}"), F.col("source"))
    text = F.concat(F.lit("see "), path("/"), F.lit("/x and "), path("\\/"), F.lit(":2 "), F.col("text"))
    return _rows(_table(spark, sf_dir, "documents").withColumn("t", text), rules.home_name_spans(F.col("t"), HOME))


def hash_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", filters.dense_in_hashes(F.col("text")).alias("dense"))


def hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of several lengths after several words, on the same line or the next."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    value = F.substring(F.concat(F.sha2("text", 256), F.md5("text")), F.lit(1), pick((32, 40, 64, 31, 41), 5))
    text = F.concat(F.col("text"), F.lit("\n"), pick(("MD5 sum ", "total ", "a byte of ", "hash\n", "SHA: ", "sh a ", ""), 7), value, F.lit("\nsha "), value)
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.alias("t"), value.alias("v"))
    return docs.select("doc_id", filters.on_hash_line(F.col("t"), F.col("v")).alias("on_hash_line"))


def literal_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.regexp_extract("text", r"^[A-Za-z]+", 0).alias("v"))
    found = docs.select("doc_id", occurrences(F.col("text"), F.lower("v")).alias("s"))
    return found.select("doc_id", F.size("s").alias("n"), F.coalesce(F.get("s", F.lit(0))["start"], F.lit(-1)).alias("first_start"), F.coalesce(F.get("s", F.size("s") - 1)["end"], F.lit(-1)).alias("last_end"))


def hex_token_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    hexes = tuple(p for p in plugins.PLUGINS if p.name == "HexHighEntropyString")
    values = F.filter(plugins.plugin_values(F.col("text"), hexes), lambda v: ~filters.on_hash_line(F.col("text"), v))
    return _table(spark, sf_dir, "documents").select("doc_id", F.explode_outer(values).alias("value")).filter("value IS NOT NULL").select("doc_id", "value", F.round(plugins.hex_entropy(F.col("value")), 6).alias("entropy"))


def plugin_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir)._replace(limit=3.0)
    return _rows(_table(spark, sf_dir, "documents"), plugins.plugin_keys(F.col("text"), model))


def token_shapes() -> dict[str, tuple[str, ...]]:
    """Texts with the token of each plugin, near misses and what the filters leave out, as parts to be joined: h[a:b] are hexadecimal digits a to b (from 1) of
    the document's digest, up the same in upper case, m letters and digits made of it; other parts stand for themselves."""
    return {
        "artifactory": ("x AKC", "m[1:12]"), "artifactory_password": ('"APB', "m[1:9]", '"'), "artifactory_short": ("x AKC", "m[1:9]"),
        "aws": ("key AKIA", "up[1:16]"), "aws_long": ("key AKIA", "up[1:17]"), "aws_secret": ("AWS_Secret_key = '", "m[1:40]", "'"), "aws_other_key": ("aws = '", "m[1:39]", "' "),
        "base64": ('say "', "m[1:30]", '"'), "base64_plain": ('say "', "m[1:8]", "m[1:8]", '"'), "hex": ("n = '", "h[1:10]", "'"), "hex_longer": ("n = '", "h[1:24]", "'"), "digits": ("n = '1029384756'",),
        "azure": ("AccountKey=", "m[1:44]", "m[1:44]"), "azure_short": ("AccountKey=", "m[1:44]", "m[1:43]"), "cloudant": ("Cloudant_pw = ", "h[1:64]"), "cloudant_url": ("https://u:", "h[1:64]", "@a.cloudant.com"), "cloudant_other": ("cloudant is ", "h[1:64]"),
        "discord": ("M", "m[1:23]", ".", "m[1:6]", ".", "m[5:31]"), "github": ("ghp_", "m[1:36]"), "github_short": ("ghp_", "m[1:35]"), "ibm": ("iam_key='", "m[1:44]", "'"), "cos": ("cos_hmac_secret_access_key = ", "h[1:48]"),
        "jwt": ("Bearer eyJhbGciOiJIUzI1NiJ9.eyJuIjoxfQ.", "m[1:20]"), "jwt_not_json": ("Bearer eyJub3RqdHM.eyJub3RqdHM.", "m[1:20]"), "mailchimp": ("h[1:32]", "-us5"), "mailchimp_three_digits": ("h[1:32]", "-us123"),
        "npm": ("//r.example.com/:_authToken=npm_", "m[1:36]"), "npm_uuid": ("//r.example.com/:_authToken=", "h[1:8]", "-", "h[9:12]", "-", "h[13:16]", "-", "h[17:20]", "-", "h[21:32]"),
        "sendgrid": ("SG.", "m[1:22]", ".", "m[1:43]"), "slack": ("xoxb-123-", "m[1:24]"), "slack_hook": ("https://hooks.slack.com/services/T", "m[1:8]", "/B", "m[2:9]", "/", "m[1:24]"), "softlayer": ("sl_api_key = ", "h[1:64]"),
        "softlayer_url": ("see https://API.softlayer.com/soap/v3.1/", "h[1:64]"), "softlayer_other_url": ("see https://api.softlayer.com/rest/v3/", "h[1:64]"),
        "stripe": ("sk_live_", "m[1:24]"), "stripe_test": ("sk_test_", "m[1:24]"), "twilio": ("SK", "h[9:40]"), "twilio_long": ("SK", "h[9:41]"),
        "uuid": ('k = "', "h[1:8]", "-", "h[9:12]", "-", "h[13:16]", "-", "h[17:20]", "-", "h[21:32]", '"'), "identifier": ('user_id = "', "h[1:40]", '"'), "sequence": ('k = "0123456789abcdef"',), "two": ("'", "h[1:40]", "' and '", "h[3:42]", "' and '", "h[1:40]", "'"), "none": ("sha ", "h[1:19]"),
    }


def shape_part(part: str) -> tuple[str, int, int] | None:
    """Source, first and last of a part like h[1:8]."""
    name, _, rest = part.partition("[")
    first, _, last = rest.rstrip("]").partition(":")
    return (name, int(first), int(last)) if name in ("h", "up", "m") and last.isdigit() else None


def token_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many secrets the plugins find in each token format, filled with characters that come from the documents' digests, and in near misses."""
    h = F.sha2("text", 256)
    sources = {"h": h, "up": F.upper(h), "m": F.translate(F.base64(F.unhex(h)), "+/=", "aZ9")}
    docs = _table(spark, sf_dir, "documents").select("doc_id", *(v.alias(f"source_{k}") for k, v in sources.items()))

    def written(part: str) -> Column:
        found = shape_part(part)
        return F.substring(f"source_{found[0]}", found[1], F.lit(found[2] - found[1] + 1)) if found else F.lit(part)

    shapes = F.array(*(F.struct(F.lit(k).alias("format"), F.concat(*map(written, v)).alias("t")) for k, v in token_shapes().items()))
    rows = docs.select("doc_id", F.explode(shapes).alias("x")).select("doc_id", "x.format", plugins.plugin_values(F.col("x.t")).alias("v"))
    return rows.select("doc_id", "format", F.size("v").alias("n_found"))


def gibberish_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each different word of all documents."""
    words = _words(spark, sf_dir).select(F.lower("x.value").alias("word")).distinct()
    return words.select("word", F.round(_model(spark, sf_dir).score(F.col("word")), 6).alias("score"))


def ip_v6_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with colons made of digits of the documents' digests: whole, shortened, with an IPv4 tail, in private networks, and broken."""
    i, h = F.col("doc_id"), F.md5("text")
    g = lambda k: F.substring(h, 4 * k + 1, F.lit(4))
    v4 = F.concat_ws(".", *((i * k % 260).cast("string") for k in (7, 11, 13, 17)))
    start = F.element_at(F.array(*map(F.lit, ("2a00", "2001:db8", "fe80", "2001:1", "fd00", "2002", "64:ff9b:1", "2001:4:112"))), (i % 8 + 1).cast("int"))
    forms = [F.concat_ws(":", *(g(k) for k in range(8))), F.concat(start, F.lit("::"), g(1)), F.concat(start, F.lit(":"), g(2), F.lit("::")), F.concat(F.lit("::ffff:"), v4), F.concat(F.lit("::"), g(3), F.lit(":"), g(4)), F.concat(start, F.lit("::"), v4), F.concat(F.lit("fe80::"), g(5), F.lit("%eth0")), F.concat(g(1), F.lit("::"), g(2), F.lit("::"), g(3)), F.lit("::1")]
    text = F.concat(F.lit("at "), F.element_at(F.array(*forms), (i % 9 + 1).cast("int")), F.lit(" and "), forms[0], F.lit(", server "), F.element_at(F.array(*forms), ((i / 9).cast("int") % 9 + 1).cast("int")), F.lit(" now"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.alias("t"))
    found = docs.select("doc_id", F.explode_outer(rules.ip_spans(F.col("t"))).alias("x")).filter("x IS NOT NULL").select("doc_id", "x.start", "x.end", "x.value")
    return found.select("doc_id", "start", "end", "value", filters.excluded_address(F.col("value")).alias("excluded"))


def address_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses made of doc_id, near the borders of the private networks and elsewhere."""
    i = F.col("doc_id")
    octets = [F.element_at(F.array(*map(F.lit, (0, 10, 100, 127, 169, 172, 192, 198, 203, 224, 240, 8))), (i % 12 + 1).cast("int")), (i * 7) % 256, (i * 13) % 256, (i * 29) % 300]
    address = F.concat_ws(".", *(o.cast("string") for o in octets))
    docs = _table(spark, sf_dir, "documents").select("doc_id", address.alias("address"))
    a = F.col("address")
    return docs.select("doc_id", "address", filters.not_an_address(a).alias("invalid"), filters.excluded_address(a).alias("excluded"), filters.looks_like_date(a).alias("date_like"))


def version_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") * 37 % F.length("text")).cast("int").alias("s"))
    at = wrapped_context(F.col("text"), F.col("s"), F.col("s") + 7)
    version = filters.looks_like_version(F.concat((F.col("doc_id") % 10).cast("string"), F.lit(".2.3.4")), at)
    return docs.select("doc_id", F.md5(at).alias("context_md5"), F.length(at).alias("n"), version.alias("version_like"), F.md5(context(F.col("text"), F.col("s"), F.col("s") + 7)).alias("window_md5"))


def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    found = _table(spark, sf_dir, "documents").withColumn("spans", merging.merge_spans(rules.email_spans(t), rules.ip_spans(t, public_only=True)))
    masked = found.select("doc_id", masking.mask_spans(t, F.col("spans")).alias("masked"))
    return masked.select("doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").alias("n_chars"))


def mask_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = (F.col("doc_id") % 5).cast("int")
    part = lambda a, b, kind: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(kind).alias("type"))
    findings = F.array(part(7 - i, 12 - i, "NAME"), part(F.lit(9), F.lit(10), "KEY"), part(F.lit(10), 17 + i, "PASSWORD"), part(7 - i, 12 - i, "EMAIL"), part(F.lit(30), F.lit(33), "NAME"), part(F.lit(33), F.lit(36), "IP_ADDRESS"))
    return _table(spark, sf_dir, "documents").select("doc_id", masking.mask(F.col("text"), findings).alias("masked"))


def _branches(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings of two branches at the words of whole texts: at every second and at every third one, with tags that place and length give."""
    words = _words(spark, sf_dir)

    def branch(step: int, tag: Column) -> DataFrame:
        return words.filter(F.col("pos") % step == 0).select("doc_id", F.lit(0).alias("segment_no"), tag.alias("tag"), "x.value", "x.start", "x.end")

    return branch(2, F.when(F.col("pos") % 4 == 0, "EMAIL").otherwise("KEY")), branch(3, F.when(F.length("x.value") % 2 == 0, "EMAIL").otherwise("NAME"))


def merge_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.merge_findings(*_branches(spark, sf_dir)).drop("segment_no")


def sorted_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spans(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.collect_list(F.struct("tag", "value", "start", "end")).alias(name))

    a, b = _branches(spark, sf_dir)
    merged = spans(a, "a").join(spans(b, "b"), "doc_id", "full").select("doc_id", F.posexplode(merging.merge_spans(F.col("a"), F.col("b"))).alias("pos", "x"))
    return merged.select("doc_id", "pos", "x.tag", "x.start", "x.end", "x.value")


def diff_additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs made of the documents' lines: every third line stays, others are added or removed in turn; a second header in long ones."""
    line = lambda x, i: F.concat(F.when(i % 7 == 6, F.lit("@@ -1 +1 @@\n")).otherwise(""), F.element_at(F.array(F.lit("+"), F.lit("+"), F.lit("-"), F.lit(" ")), (i % 4 + 1).cast("int")), x)
    diff = F.concat(F.lit("+++ b/file\n@@ -0,0 +1 @@\n"), F.array_join(F.transform(F.split("text", "\n", -1), line), "\n"))
    runs = additions(_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("filename"), diff.alias("diff_text")))
    return runs.select("filename", F.col("segment_no").cast("int").alias("segment_no"), F.md5("text").alias("text_md5"), F.length("text").alias("n_chars"))


def token_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.array_remove(F.split("text", r"[ \n]+"), "").alias("input_ids"))
    cut = windows.token_windows(docs, 64, 16)
    return cut.select("doc_id", "offset", F.size("window_ids").alias("n"), F.md5(F.array_join("window_ids", " ")).alias("window_md5"))


def _predicted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Windows of 64 words, 16 shared, over whole texts, with whole-number scores of three labels that document, window and place give."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("segment_no"), F.array_remove(F.split("text", r"[ \n]+"), "").alias("input_ids"))
    cut = windows.token_windows(docs, 64, 16)
    score = lambda i, k: ((F.col("doc_id") + F.col("offset") + i * 3 + k * 5) % 8 + 1).cast("double")
    rows = F.transform("window_ids", lambda x, i: F.array(*(score(i, k) for k in range(3))))
    return cut.select("doc_id", "segment_no", "offset", rows.alias("probs")), docs.select("doc_id", "segment_no", F.size("input_ids").alias("n_tokens"))


def combine_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    combined = windows.combine(*_predicted(spark, sf_dir), n_labels=3)
    return combined.select("doc_id", "pos", F.posexplode("probs").alias("label_no", "p")).withColumn("p", F.round("p", 9))


def best_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = windows.best_labels(windows.combine(*_predicted(spark, sf_dir), n_labels=3), ["O", "B-NAME", "I-NAME"])
    return best.select("doc_id", "pos", "label", F.round("p", 9).alias("p"))


def bio_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs over labels, with all prefixes, that the words of whole texts give."""
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(2))  # where they stand is not asked
    pos = F.col("pos").cast("long")
    n = (F.col("doc_id") * 31 + pos * pos * 7 + F.length("word")) % len(ALL_LABELS)
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(words).alias("pos", "word")).filter("word IS NOT NULL")
    tagged = rows.select("doc_id", F.lit(0).alias("segment_no"), "pos", F.get(F.array(*map(F.lit, ALL_LABELS)), n.cast("int")).alias("label"), (F.col("pos") + 1).cast("double").alias("p"))
    return windows.entities(tagged).select("doc_id", "type", "first", "last", F.round("score", 9).alias("score"))


def entity_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all texts, with signs about it, as a value of one of two tags."""
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    rows = lines.select("doc_id", "pos", F.when((F.col("doc_id") + F.col("pos")) % 2 == 0, "KEY").otherwise("NAME").alias("tag"), F.concat(F.lit("\"(_"), "line", F.lit("), ")).alias("old"))
    value = windows.trim(F.col("tag"), F.col("old"))
    return rows.select("doc_id", "pos", "tag", value.alias("value"), F.greatest(F.instr("old", value) - 1, F.lit(0)).alias("moved"))


def entity_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each word of all texts, or two of them, an address, or a word and a digest, as a value of each tag in turn."""
    tags = ("AMBIGUOUS", "USERNAME", "IP_ADDRESS", "NAME", "PASSWORD", "EMAIL", "KEY")
    rows = _words(spark, sf_dir).select("doc_id", "pos", F.col("x.value").alias("word"), F.get(F.array(*map(F.lit, tags)), (F.col("pos") % len(tags)).cast("int")).alias("tag"))
    address = F.concat(F.lit("81.2.69."), ((F.col("doc_id") + F.col("pos")) % 300).cast("string"))
    digest = F.concat("word", F.substring(F.md5("word"), F.lit(1), (F.col("doc_id") % 20).cast("int")))
    value = F.when(F.col("tag") == "IP_ADDRESS", address).when(F.col("tag") == "KEY", digest).when(F.col("pos") % 2 == 0, F.concat("word", F.lit(" x"))).otherwise(F.col("word"))
    rows = rows.select("doc_id", "pos", "tag", value.alias("value"))
    return rows.select("doc_id", "pos", "tag", filters.keep_entity(F.col("tag"), F.col("value"), _model(spark, sf_dir)._replace(limit=3.0).is_gibberish).alias("kept"))


def word_id(word: str) -> int:
    """A token id that SQL can give too."""
    return len(word) * 7 + ord(word[0])


_BY_WORD = {"tokenize": windows.WordTokens(word_id), "window_size": 64, "batch_size": 8}


def model_branch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole model branch with the deterministic backend."""
    found = windows.model_findings(_texts(spark, sf_dir), windows.FakeBackend(LABELS), _model(spark, sf_dir), overlap=16, **_BY_WORD)
    return found.select("doc_id", "tag", "value", "start", "end", F.round("score", 6).alias("score"))


def scan_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule-based scan with keys by regular expression."""
    settings = _settings(spark, sf_dir, key_detector="regex")
    return scan(_texts(spark, sf_dir), settings).select("doc_id", "filename", "start", "end", "type", "text")


def scan_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_texts(spark, sf_dir), _settings(spark, sf_dir)).select("doc_id", "filename", "start", "end", "type", "text")


def mask_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = mask(_texts(spark, sf_dir), _settings(spark, sf_dir))
    return masked.select("doc_id", F.md5("masked").alias("masked_md5"), F.length("masked").alias("n_chars"))


def scan_with_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = _settings(spark, sf_dir, backend=windows.FakeBackend(LABELS), window_overlap=16, **_BY_WORD)
    return scan(_texts(spark, sf_dir), settings).select("doc_id", "filename", "start", "end", "type", "text")


def detect_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merging.verdict(scan(_texts(spark, sf_dir), _settings(spark, sf_dir, key_detector="regex")))


def detect_exit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(_texts(spark, sf_dir), _settings(spark, sf_dir)).select("exit_code")


def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review that calls every second finding a false positive, in several spellings."""
    found = scan(_texts(spark, sf_dir), _settings(spark, sf_dir, key_detector="regex"))
    said = F.element_at(F.array(F.lit("n"), F.lit("y"), F.lit(" NO "), F.lit("")), ((F.col("doc_id") + F.col("start")) % 4 + 1).cast("int"))
    answers = found.select("doc_id", "segment_no", "start", "end", "type", said.alias("answer"))
    return merging.unreviewed(found, answers).select("doc_id", "start", "end", "type")


def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_texts(spark, sf_dir), _settings(spark, sf_dir, key_detector="regex"))
    return merging.report_lines(found).select("doc_id", "start", "line")


def findings_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(_texts(spark, sf_dir), _settings(spark, sf_dir, key_detector="regex"))
    return found.groupBy("type").agg(F.count(F.lit(1)).alias("n_findings"), F.count_distinct("doc_id").alias("n_docs"))


def file_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names made of the texts' first words and lines, with and without folders, dots and ends."""
    ends = F.element_at(F.array(*map(F.lit, (".py", ".tar.gz", "", ".", "/.bashrc", "/a.b/c", "/.x.y", ".JSON"))), (F.col("doc_id") % 8 + 1).cast("int"))
    name = F.concat(F.col("source"), F.lit("/"), F.translate(F.substring("text", 1, F.lit(60)), "\n", "/"), ends)
    return _table(spark, sf_dir, "documents").select("doc_id", suffix(name).alias("suffix"))


def blank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of all texts and some odd ones."""
    blank = F.element_at(F.array(F.lit(""), F.lit(" \t\r"), F.lit("\x1c\x1f"), F.lit("\u2003\xa0"), F.lit(" x "), F.lit("\u200b")), (F.col("doc_id") % 6 + 1).cast("int"))
    rows = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat(blank, F.lit("\n"), "text", F.lit("\n")), "\n", -1)).alias("pos", "text"))
    return without_blank(rows).select("doc_id", "pos", is_blank(F.col("text")).alias("blank"))


def newline_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace("text", F.lit("\n"), F.lit("\r\n"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.lit("\r\r\n")).alias("t"))
    return docs.select("doc_id", F.length("t").alias("n_raw"), F.length(normalize_newlines(F.col("t"))).alias("n_normal"), F.md5(normalize_newlines(F.col("t"))).alias("normal_md5"))


_ALL: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    ip_spans, ip_public_spans, ip_page_spans, email_spans, email_page_spans, key_spans, key_shapes, home_name_spans, hash_gate, hash_lines,
    literal_occurrences, hex_token_keys, plugin_keys, token_formats, gibberish_scores, ip_v6_spans, address_classes, version_context, mask_documents,
    mask_overlaps, merge_dedupe, sorted_findings, diff_additions, token_windows, combine_windows, best_labels, bio_entities, entity_trim,
    entity_filters, model_branch, scan_pipeline, scan_default, mask_default, scan_with_model, detect_verdict, detect_exit, triage, report_lines,
    findings_by_type, file_suffixes, blank_filter, newline_modes,
)
QUERIES = {query.__name__: query for query in _ALL}
