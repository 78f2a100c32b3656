"""Credential plugins: shapes of tokens, the entropy of quoted strings, and filters on both.

The shapes are of public token formats, written from their issuers' public descriptions (the header of a JSON web token, RFC 7519; the
prefixes of AWS, GitHub, Slack, Stripe, SendGrid, Twilio, npm and Azure keys); plugin and filter names are those of a public scanner of
that kind, which the shapes approximate.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.gibberish import BigramModel
from ..functions.spans import let, no_spans, occurrences


class Plugin(NamedTuple):
    """pattern: Java, one group, the secret; entropy: bits a character that a secret must exceed; kind: further checks; needs: one of these
    stands in a text with a match (in any case, if folded), which is cheaper to see than the pattern."""

    name: str
    pattern: str
    entropy: float = 0.0
    kind: str = ""
    needs: tuple[str, ...] = ()
    folded: bool = False


_QUOTES = ("'", '"')

# Token formats.
PLUGINS = (
    Plugin("ArtifactoryDetector", r"(?m)(?:^|[\s=:\"'])(AKC[a-zA-Z0-9]{10,}|AP[\dABCDEF][a-zA-Z0-9]{8,})(?=$|[\s\"'])", needs=("AKC", "AP")),
    Plugin("AWSKeyDetector", r"((?:A3T[A-Z0-9]|AKIA|ASIA|ABIA|ACCA)[0-9A-Z]{16})(?![0-9A-Z])"),
    Plugin("AWSSecretKey", r"(?i)aws.{0,20}?(?:key|pwd|pw|password|pass|token).{0,20}?['\"]([0-9a-zA-Z/+]{40})['\"]", kind="AWSKeyDetector", needs=_QUOTES),
    Plugin("Base64HighEntropyString", r"['\"]([A-Za-z0-9+/\-_]{8,}={0,2})['\"]", 4.5, needs=_QUOTES),
    Plugin("HexHighEntropyString", r"['\"]([0-9a-fA-F]{8,})['\"]", 3.0, "hex", needs=_QUOTES),
    Plugin("AzureStorageKeyDetector", r"AccountKey=([A-Za-z0-9+/=]{88})", needs=("AccountKey=",)),
    Plugin("CloudantDetector", r"(?i)cloudant[\w.\-]*['\"]?\s{0,3}(?:=|:|:=|=>)\s{0,3}['\"]?([0-9a-f]{64}|[a-z]{24})(?![0-9a-z])", needs=("cloudant",), folded=True),
    Plugin("CloudantUrl", r"(?i)https?://[\w\-]+:([0-9a-f]{64}|[a-z]{24})@[\w\-]+\.cloudant\.com", kind="CloudantDetector", needs=("cloudant",), folded=True),
    Plugin("DiscordBotTokenDetector", r"([MNO][a-zA-Z\d_\-]{23,25}\.[a-zA-Z\d_\-]{6}\.[a-zA-Z\d_\-]{27})"),
    Plugin("GitHubTokenDetector", r"(gh[pousr]_[A-Za-z0-9_]{36})", needs=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Plugin("IbmCloudIamDetector", r"(?i)(?:ibm|iam|cloud)[\w\-]*(?:key|pwd|password|pass|token)['\"]?\s{0,3}(?:=|:|:=|=>)\s{0,3}['\"]?([a-zA-Z0-9_\-]{44})(?![a-zA-Z0-9_\-])", needs=("ibm", "iam", "cloud"), folded=True),
    Plugin("IbmCosHmacDetector", r"(?i)(?:ibm)?[\-_]?(?:cos|hmac)?[\-_]?(?:hmac)?[\-_]?secret[\-_]?(?:access)?[\-_]?key['\"]?\s{0,3}(?:=|:|:=|=>)\s{0,3}['\"]?([a-f0-9]{48})(?![a-f0-9])", needs=("secret",), folded=True),
    Plugin("JwtTokenDetector", r"(eyJ[A-Za-z0-9\-_=]+\.[A-Za-z0-9\-_=]+\.?[A-Za-z0-9\-_.+/=]*)", kind="jwt", needs=("eyJ",)),
    Plugin("MailchimpDetector", r"([0-9a-z]{32}-us[0-9]{1,2})(?![0-9])", needs=("-us",)),
    Plugin("NpmDetector", r"//.+/:_authToken=\s{0,3}((?:npm_.+)|(?:[A-Fa-f0-9-]{36}))", needs=(":_authToken=",)),
    Plugin("SendGridDetector", r"(SG\.[a-zA-Z0-9_\-]{22}\.[a-zA-Z0-9_\-]{43})(?![a-zA-Z0-9_\-])", needs=("SG.",)),
    Plugin("SlackDetector", r"(xox(?:a|b|p|o|s|r)-(?:\d+-)+[a-zA-Z0-9]+)", needs=("xox",)),
    Plugin("SlackWebhook", r"(https://hooks\.slack\.com/services/T[a-zA-Z0-9_]+/B[a-zA-Z0-9_]+/[a-zA-Z0-9_]+)", kind="SlackDetector", needs=("hooks.slack.com",)),
    Plugin("SoftlayerDetector", r"(?i)(?:softlayer|sl)[_\-]?(?:api)?[_\-]?(?:key|pwd|password|pass|token)['\"]?\s{0,3}(?:=|:|:=|=>)\s{0,3}['\"]?([a-z0-9]{64})(?![a-z0-9])", needs=("softlayer", "sl"), folded=True),
    Plugin("SoftlayerUrl", r"(?i)https?://api\.softlayer\.com/soap/v3(?:\.1)?/([a-z0-9]{64})", kind="SoftlayerDetector", needs=("api.softlayer.com",), folded=True),
    Plugin("StripeDetector", r"((?:r|s)k_live_[0-9a-zA-Z]{24})", needs=("k_live_",)),
    Plugin("TwilioKeyDetector", r"((?:AC|SK)[a-z0-9]{32})(?![a-z0-9])", needs=("AC", "SK")),
)
#: What a text with a secret holds at least, of any plugin: a long run, a quoted one, or the beginning of a format whose runs may be short.
#: One pass over a text, where the plugins take one each.
NEEDS = (
    r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{20}|['\"][A-Za-z0-9+/\-_]{8,}+={0,2}['\"]|eyJ[A-Za-z0-9\-_=]|xox[abpors]-\d"
    r"|AKC[a-zA-Z0-9]{10}|AP[\dABCDEF][a-zA-Z0-9]{8}|AccountKey=|:_authToken=|hooks\.slack\.com|[cC][lL][oO][uU][dD][aA][nN][tT]"
)
# What the filters look for.
UUID = r"(?i)[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}"
ID_NAME = r"(?i)(?:^(?:id|myid|userid)|_id)s?[\"']?\s*[:=]\s*[\"']?$"
TEMPLATED = r"^(?:\{.*\}|<.*>|\$\{.*\})$"
SEQUENCES = (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/",
    "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZABCDEFGHIJKLMNOPQRSTUVWXYZ+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "0123456789ABCDEF0123456789ABCDEF",
    "0123456789ABCDEFABCDEF0123456789ABCDEF",
)
#: Suffixes of files whose contents are no text; nothing is looked for in them.
BINARY_SUFFIXES = (".7z", ".bin", ".bmp", ".bz2", ".class", ".dmg", ".exe", ".gif", ".gz", ".ico", ".jar", ".jpg", ".jpeg", ".mo", ".png", ".so", ".svg", ".tar", ".tif", ".tiff", ".ttf", ".woff", ".xml.gz", ".zip")


def entropy(value: Column) -> Column:
    """Shannon entropy in bits a character."""
    n = F.length(value)
    signs = F.array_distinct(F.array_remove(F.split(value, ""), ""))
    share = lambda c: (n - F.length(F.replace(value, c, F.lit("")))) / n
    return F.aggregate(signs, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def hex_entropy(value: Column) -> Column:
    """Entropy, less for a value of digits alone, which most often is a number."""
    return entropy(value) - F.when(value.rlike("^[0-9]{2,}$"), 1.2 / F.log2(F.length(value))).otherwise(0.0)


def is_jwt(value: Column) -> Column:
    """The first two parts are JSON in URL-safe base64."""

    def decoded(part: Column) -> Column:
        plain = F.translate(F.rtrim(part, F.lit("=")), "-_", "+/")
        padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
        return F.try_to_binary(padded, F.lit("base64")).cast("string")

    parts = F.split(value, "[.]")
    is_json = lambda i: F.coalesce(F.get_json_object(decoded(F.get(parts, i)), "$").isNotNull(), F.lit(False))
    return is_json(0) & is_json(1)


def is_noise(text: Column, value: Column) -> Column:
    """A UUID, an identifier by the name before it, a template, or part of a plain sequence."""
    line = F.substring_index(F.substring(text, F.lit(1), F.instr(text, value) - 1), "\n", -1)
    in_sequence = F.lit(False)
    for sequence in SEQUENCES:
        in_sequence = in_sequence | F.contains(F.lit(sequence), F.upper(value))
    return value.rlike(UUID) | line.rlike(ID_NAME) | value.rlike(TEMPLATED) | in_sequence


def plugin_values(text: Column, plugins: tuple[Plugin, ...] = PLUGINS) -> Column:
    """The different secrets that the plugins find in a text and the filters leave."""
    found, none = [], F.array().cast("array<string>")
    for p in plugins:
        values = F.regexp_extract_all(text, F.lit(p.pattern), F.lit(1))
        if p.needs:
            seen = F.lower(text) if p.folded else text
            values = F.when(reduce(Column.__or__, (F.contains(seen, F.lit(x)) for x in p.needs)), values).otherwise(none)
        if p.kind == "hex":
            values = _over(values, hex_entropy, p.entropy)
        elif p.entropy:
            values = _over(values, entropy, p.entropy)
        elif p.kind == "jwt":
            values = F.filter(values, is_jwt)
        found.append(values)
    every = F.filter(F.array_distinct(F.flatten(F.array(*found))), lambda v: (v != "") & ~is_noise(text, v))
    return F.when(text.rlike(NEEDS), every).otherwise(none) if set(plugins) <= set(PLUGINS) else every


def _over(values: Column, measure: Callable[[Column], Column], bound: float) -> Column:
    return F.filter(values, lambda v: measure(v) > bound)


def plugin_keys(text: Column, model: BigramModel, suffix: Column | None = None, plugins: tuple[Plugin, ...] = PLUGINS) -> Column:
    """Spans of all occurrences of the secrets, but for words, digests on a line that names them, and texts full of hashes."""
    values = F.filter(plugin_values(text, plugins), lambda v: model.is_gibberish(F.lower(v)) & ~filters.on_hash_line(text, v))
    skipped = filters.dense_in_hashes(text)
    if suffix is not None:
        skipped = skipped | F.lower(suffix).isin(*BINARY_SUFFIXES)

    def spans(vs: Column) -> Column:
        return F.when((F.size(vs) < 1) | skipped, no_spans()).otherwise(F.flatten(F.transform(vs, lambda v: occurrences(text, v))))

    return F.coalesce(let(values, spans), no_spans()).alias("plugin_keys")
