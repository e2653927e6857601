"""The text and address rules as SQL functions (P4), made from the Column expressions themselves, so that there is one definition of each.

`register(spark)` runs CREATE OR REPLACE TEMPORARY FUNCTION ... RETURN for each; the optimizer puts a function's expression in the place
of the call, so a query in SQL text gets the plan of the DataFrame form. Table functions unfold a list: `SELECT * FROM contact_emails('...')`.
Needs a session that runs in this process, as expressions are asked for their SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from . import cleaning as K
from . import text as T
from . import urls as U

CALLED = re.compile(r"'(?:[^'\\]|\\.)*'|(?<![\w`])(?:<=>|<=|>=|==|!=|<>|[=<>!+\-*/%]|and|or|not|in|div)\(")


def sql_text(c: Column) -> str:
    """A Column expression as SQL that parses: operators that are written as calls get quoted names, literals stay."""
    return CALLED.sub(lambda m: m[0] if m[0].startswith("'") else f"`{m[0][:-1]}`(", c._jc.node().sql())


#: Name: (arguments, expression). Arguments are texts.
FUNCTIONS = {
    "extract_emails": ("text", lambda text: T.extract_emails(text)),
    "extract_phones": ("text", lambda text: T.extract_phones(text)),
    "normalize_phone": ("phone", lambda phone: T.normalize_phone(phone)),
    "normalize_phone_strict": ("phone", lambda phone: T.normalize_phone(phone, "strict")),
    "display_phone": ("phone", lambda phone: T.normalize_phone(phone, "display")),
    "is_valid_name": ("name", lambda name: T.is_valid_name(name)),
    "validate_name": ("name", lambda name: T.validate_name(name)),
    "name_from_email": ("email", lambda email: T.name_from_email(email)),
    "presence_confidence": ("name, email, phone", lambda name, email, phone: T.presence_confidence(name, email, phone)),
    "email_domain": ("email", lambda email: T.email_domain(email)),
    "domain_type": ("domain", lambda domain: T.domain_type(domain)),
    "match_key": ("text", lambda text: T.match_key(text)),
    "string_similarity": ("a, b", lambda a, b: T.string_similarity(a, b)),
    "validate_field": ("field, value", lambda field, value: T.validate_field(field, value)),
    "clean_name": ("name", lambda name: K.clean_name(name)),
    "clean_title": ("title", lambda title: K.clean_plain(title)),
    "clean_location": ("location", lambda location: K.clean_plain(location)),
    "clean_email": ("email", lambda email: K.extract_email(email)),
    "clean_phone": ("phone", lambda phone: K.extract_phone(phone)),
    "url_params": ("url", lambda url: U.params(url)),
    "url_domain": ("url", lambda url: U.domain(url)),
    "page_param": ("url", lambda url: U.page_param(url)),
    "base_url": ("url", lambda url: U.base_url(url)),
}
#: Name: (arguments, list that is unfolded, columns of the result with their places in an item).
TABLES = {
    "contact_emails": ("text", lambda text: T.extract_emails(text), {"position": "pos", "email": "item"}),
    "contact_phones": ("text", lambda text: T.extract_phones(text), {"position": "pos", "phone": "item"}),
    "url_parameters": ("url", lambda url: U.params(url), {"position": "pos", "name": "item.name", "value": "item.value"}),
}


def _types(spark: SparkSession, args: list[str], body: Column):
    """The result's type, as Spark finds it over texts."""
    return spark.createDataFrame([], ", ".join(f"{a} string" for a in args)).select(body.alias("x")).schema["x"].dataType


def register(spark: SparkSession, prefix: str = "", names: list[str] | None = None) -> list[str]:
    """Makes the functions (all, or those named) in this session; returns their names. A call again replaces them."""
    made = []
    for name in names or [*FUNCTIONS, *TABLES]:
        args, body, *unfolds = FUNCTIONS.get(name) or TABLES[name]
        args = args.split(", ")
        expression = body(*map(F.col, args))
        given = ", ".join(f"{a} STRING" for a in args)
        kind = _types(spark, args, expression)
        if unfolds:
            item = kind.elementType
            types = {"pos": "INT", "item": item.simpleString()} | ({f"item.{f.name}": f.dataType.simpleString() for f in item} if hasattr(item, "fields") else {})
            columns = unfolds[0]
            spark.sql(
                f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS TABLE ({', '.join(f'{c} {types[p]}' for c, p in columns.items())}) "
                f"RETURN SELECT {', '.join(f'{p} AS {c}' for c, p in columns.items())} FROM (SELECT posexplode({sql_text(expression)}) AS (pos, item))"
            )
        else:
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({given}) RETURNS {kind.simpleString()} RETURN {sql_text(expression)}")
        made.append(prefix + name)
    return made
