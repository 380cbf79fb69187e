"""Names, URL paths and typed values as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def table_name(name: Column, case_sensitive: bool = False) -> Column:
    """What follows the last dot, without outer blanks, in lower case unless case_sensitive."""
    last = F.substring_index(F.trim(name), ".", -1)
    return last if case_sensitive else F.lower(last)


def column_name(name: Column, case_sensitive: bool = False) -> Column:
    return F.trim(name) if case_sensitive else F.lower(F.trim(name))


#: What counts as a UUID (versions 1 to 5) and as a token.
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"
TOKEN = r"^(?:[0-9A-Fa-f]{16,}|[0-9A-Za-z_-]{24,})$"


def path_template(path: Column) -> Column:
    """A URL path with whole numbers as {id}, UUIDs as {uuid}, long tokens as {token}; no query, no trailing slash."""
    plain = F.regexp_extract(F.coalesce(path, F.lit("")), r"^[^?#]*", 0)
    parts = F.transform(
        F.split(plain, "/"),
        lambda p: F.when(p.rlike("^[0-9]+$"), "{id}").when(p.rlike(UUID), "{uuid}").when(p.rlike(TOKEN), "{token}").otherwise(p),
    )
    joined = F.regexp_replace(F.array_join(parts, "/"), "/+$", "")
    return F.when(joined == "", "/").otherwise(joined)


def logged_path(url: Column) -> Column:
    """The traffic logger's own form: numbers and UUIDs are {id}, and of the query `timestamp` and `_` are {time}."""
    path = F.regexp_extract(url, r"^[^?#]*", 0)
    parts = F.transform(F.split(path, "/"), lambda p: F.when(p.rlike("^[0-9]+$") | p.rlike(UUID), "{id}").otherwise(p))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    pairs = F.transform(F.split(query, "&"), lambda q: F.when(F.substring_index(q, "=", 1).isin("timestamp", "_"), F.concat(F.substring_index(q, "=", 1), F.lit("={time}"))).otherwise(q))
    return F.concat(F.array_join(parts, "/"), F.when(query != "", F.concat(F.lit("?"), F.array_join(pairs, "&"))).otherwise(""))


def value_type(value: Column) -> Column:
    """The JSON type of a variant: int, float, str, bool, null, list or dict. Whole numbers beyond 64 bits are decimals
    in a variant and so count as float."""
    kind = F.call_function("schema_of_variant", value)
    return (
        F.when(kind == "BIGINT", "int").when((kind == "DOUBLE") | kind.startswith("DECIMAL"), "float").when(kind == "STRING", "str")
        .when(kind == "BOOLEAN", "bool").when(kind == "VOID", "null").when(kind.startswith("ARRAY"), "list").otherwise("dict")
    )


def value_text(value: Column) -> Column:
    """A canonical text of a variant; with value_type, equal exactly if the values are of one type and equal."""
    kind = F.call_function("schema_of_variant", value)
    number = F.call_function("try_variant_get", value, F.lit("$"), F.lit("double")).cast("string")
    return F.when((kind == "DOUBLE") | kind.startswith("DECIMAL"), number).otherwise(F.to_json(value))


def same_value(left_type: Column, left_text: Column, right_type: Column, right_text: Column) -> Column:
    return left_type.eqNullSafe(right_type) & left_text.eqNullSafe(right_text)


def identity(login: Column, attribute: Column, cookie: Column, rid: Column) -> Column:
    """Who made a request: the login, else the session's attribute, else a hash of its cookie, else the request."""
    some = lambda c: F.when(F.trim(c) != "", c)
    hashed = F.concat(F.lit("session:"), F.substring(F.sha2(some(cookie), 256), 1, 24))
    return F.coalesce(some(login), some(attribute), hashed, F.concat(F.lit("request:"), rid))
