"""Java patterns of the regex detectors.

A detector's pattern has three groups: what must stand left of a finding, the finding, and what must stand right of it. A side that is
only looked at is an empty group. Flags: ``m`` for line ends, ``d`` so that these are newlines alone, ``U`` for Unicode classes.
Loops over alternatives recurse in Java and may overflow the stack; possessive quantifiers keep the e-mail pattern from it, and the key
pattern is not run on long unbroken text (see operators.rules).
"""

from __future__ import annotations

FLAGS = "(?dmU)"

# The grammars that findings must agree with, in Java's dialect (and for Python's regex module where said).
IPV4 = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)(?:\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)){3}"
IPV6 = r"(?:[0-9a-fA-F]{1,4}:){7,7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,7}:|(?:[0-9a-fA-F]{1,4}:){1,6}:[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,5}(?::[0-9a-fA-F]{1,4}){1,2}|(?:[0-9a-fA-F]{1,4}:){1,4}(?::[0-9a-fA-F]{1,4}){1,3}|(?:[0-9a-fA-F]{1,4}:){1,3}(?::[0-9a-fA-F]{1,4}){1,4}|(?:[0-9a-fA-F]{1,4}:){1,2}(?::[0-9a-fA-F]{1,4}){1,5}|[0-9a-fA-F]{1,4}:(?:(?::[0-9a-fA-F]{1,4}){1,6})|:(?:(?::[0-9a-fA-F]{1,4}){1,7}|:)|fe80:(?::[0-9a-fA-F]{0,4}){0,4}%[0-9a-zA-Z]{1,}|::(?:ffff(?::0{1,4}){0,1}:){0,1}(?:(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])|(?:[0-9a-fA-F]{1,4}:){1,4}:(?:(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])\.){3,3}(?:25[0-5]|(?:2[0-4]|1{0,1}[0-9]){0,1}[0-9])"
IP = FLAGS + r"(^|[\x08\s@?,!;:'\")(.\p{IsHan}])(" + IPV4 + "|" + IPV6 + r")($|[\s@,?!;:'\"(.\p{IsHan}])"
EMAIL = (
    FLAGS
    + r"((?<=^|[\[({<\x08\s@,?!;'\"\p{IsHan}¿¡:.]|\\['\"]))"
    + r"((?:[^\]\[(){}<>\x08\s@,?!;'\":#/\\=.\-]++|[=.\-](?![.@]))++@"
    + r"(?:(?:\w|[^.\x08\s@?!;,/()>\-:][^.\x08\s@?!;,/()>]{0,62}[^.\x08\s@?!;,/()>\-:'\"])\.){1,10}(?:[\p{L}\p{M}]{2,63}|xn--\w+))"
    + r"((?=$|[\])}>\x08\s@,?!;'\"\p{IsHan}]|\\['\"]|:(?!\d)|\.(?!\S)))"
)
KEY = FLAGS + r"((?!(?:/[^ .]+){2}))((?:(?:[A-Za-z]+[\p{Nd}\p{Pd}/+=:_]+|[\p{Nd}\p{Pd}/+=:]+[A-Za-z]+)){4,})($|[\x08\s\p{IsHan}@?,!;:'\")(.])"
KEY_PYTHON = r"(?m)(?!(?:/[^ .]+){2})((?:(?:[A-Za-z]+[\p{Nd}\p{Pd}/+=:_]+|[\p{Nd}\p{Pd}/+=:]+[A-Za-z]+)){4,})(?:$|[\x08\s\p{Han}@?,!;:'\")(.])"

# What a text with a finding holds at least; far cheaper to see than the patterns themselves.
#: Of IP also "::" and "fe80:", which are no regular expression.
IP_NEEDS = r"[0-9]\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]|(?:[0-9a-fA-F]{1,4}:){7}"
IP_NEEDS_ONE_OF = ("::", "fe80:")
_KEY_SIGNS = r"[\p{Nd}\p{Pd}/+=:_]"
#: What follows the start of a key, seen without going back: four letters and four other signs, with nothing else between.
KEY_FOLLOWS = rf"(?=(?:{_KEY_SIGNS}*+[A-Za-z]){{4}})(?=(?:[A-Za-z]*+{_KEY_SIGNS}){{4}})"
KEY_NEEDS = rf"(?U)(?<![A-Za-z\p{{Nd}}\p{{Pd}}/+=:_]){KEY_FOLLOWS}"
KEY_QUICK = KEY.replace(FLAGS, FLAGS + KEY_FOLLOWS, 1)

#: Where the key pattern would recurse too deeply.
LONG_RUN = r"(?U)(?<!\S)\S{1000}"
