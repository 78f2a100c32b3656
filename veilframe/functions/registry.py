"""The detectors and the mask as SQL functions of a session: ``SELECT doc_id, x.* FROM t LATERAL VIEW explode(email_spans(text)) AS x``.

A column expression is written out as SQL, so a function is the very expression that the column function makes: a query that uses it stays in
the JVM, and the optimizer sees through it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .spans import SPAN

_INFIX = {"and": "AND", "or": "OR", "+": "+", "-": "-", "*": "*", "/": "/", "%": "%", "=": "=", "!=": "!=", "<=>": "<=>", "<": "<", ">": ">", "<=": "<=", ">=": ">=", "&": "&", "|": "|"}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n").replace("\r", "\\r").replace("\x00", "\\0") + "'"


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, str):
        return _quoted(value)
    if isinstance(value, int):
        return f"{value}L" if abs(value) >= 1 << 31 else str(value)
    if isinstance(value, float):
        return f"{value!r}D"
    raise TypeError(f"no SQL for a constant of type {type(value).__name__}")


def _call(name: str, arguments: list[str]) -> str:
    if name in _INFIX and len(arguments) == 2:
        return f"({arguments[0]} {_INFIX[name]} {arguments[1]})"
    if name in ("not", "!"):
        return f"(NOT {arguments[0]})"
    if name == "in":
        return f"({arguments[0]} IN ({', '.join(arguments[1:])}))"
    if name in ("isNull", "isnull", "isNotNull", "isnotnull"):
        return f"({arguments[0]} IS {'NOT ' if 'ot' in name else ''}NULL)"
    if name == "struct":  # names for its fields are allowed after the bare word alone
        return f"struct({', '.join(arguments)})"
    return f"`{name}`({', '.join(arguments)})"


def to_sql(node, named: bool = False) -> str:
    """The SQL of a column's expression tree; named: an alias counts, as that of a struct's field does."""
    kind = node.getClass().getSimpleName()
    if kind == "Literal":
        return _literal(node.value())
    if kind == "UnresolvedAttribute":
        return ".".join(f"`{x}`" for x in _items(node.nameParts()))
    if kind == "UnresolvedNamedLambdaVariable":
        return f"`{node.name()}`"
    if kind == "UnresolvedFunction":
        return _call(node.functionName(), [to_sql(x, node.functionName() == "struct") for x in _items(node.arguments())])
    if kind == "Alias":
        return to_sql(node.child()) + (f" AS `{_items(node.name())[0]}`" if named else "")
    if kind == "Cast":
        mode = node.evalMode()
        tries = mode.isDefined() and "Try" in mode.get().toString()
        return f"{'TRY_' if tries else ''}CAST({to_sql(node.child())} AS {node.dataType().sql()})"
    if kind == "SqlExpression":
        return f"({node.expression()})"
    if kind == "CaseWhenOtherwise":
        rest = node.otherwise()
        written = to_sql(rest.get()) if rest.isDefined() else "NULL"
        for x in reversed(_items(node.branches())):
            written = f"IF({to_sql(x._1())}, {to_sql(x._2())}, {written})"
        return written
    if kind == "UnresolvedExtractValue":
        return f"({to_sql(node.child())})[{to_sql(node.extraction())}]"
    if kind == "LambdaFunction":
        names = [to_sql(x) for x in _items(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {to_sql(node.function())}"
    raise TypeError(f"no SQL for {kind}")


def _body(column: Column) -> str:
    return to_sql(column._jc.node())


def register(spark: SparkSession, gibberish=None, home_directory: str | None = None) -> list[str]:
    """Makes temporary functions and gives their names: email_spans(text), raw_ip_spans(text), ip_spans(text), public_ip_spans(text) and
    home_name_spans(text) and, with a bigram model, key_spans(text) and plugin_keys(text), which give arrays of (tag, value, start, end); and
    mask_spans(text, spans), which gives a text."""
    from ..operators import masking, plugins, rules

    text = F.col("searched")
    detectors: dict[str, Callable[[], Column]] = {
        "email_spans": lambda: rules.email_spans(text),
        "raw_ip_spans": lambda: rules.raw_ip_spans(text),
        "ip_spans": lambda: rules.ip_spans(text),
        "public_ip_spans": lambda: rules.ip_spans(text, public_only=True),
        "home_name_spans": lambda: rules.home_name_spans(text, home_directory),
    }
    if gibberish is not None:
        # Without the Python function that takes texts with very long unbroken runs: such texts have no key here.
        detectors["key_spans"] = lambda: rules.key_spans(text, gibberish, long_runs=False)
        detectors["plugin_keys"] = lambda: plugins.plugin_keys(text, gibberish)
    for name, make in detectors.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(searched STRING) RETURNS ARRAY<{SPAN}> RETURN {_body(make())}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION mask_spans(searched STRING, spans ARRAY<{SPAN}>) RETURNS STRING RETURN {_body(masking.mask_spans(text, F.col('spans')))}")
    return [*detectors, "mask_spans"]
