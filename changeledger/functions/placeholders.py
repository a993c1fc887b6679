"""Placeholder substitution in script text."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from changeledger.functions.arrays import let, newlines, sums_before

PREFIX, SUFFIX = "${", "}"
BUILTIN_NAMESPACE = "ledger:"


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def _tokens(text: Column, prefix: str, suffix: str) -> Column:
    """Text as escape, placeholder and plain tokens, in order and complete."""
    p, s = _quote(prefix), _quote(suffix)
    plain = f"[^$]++" if prefix[0] == "$" else f"[^${_quote(prefix[0])}]++"
    return F.regexp_extract_all(
        text, F.lit(rf"(?s)\${p}|{p}.*?{s}|{plain}|."), F.lit(0))


def _is_placeholder(token: Column, prefix: str, suffix: str) -> Column:
    return token.startswith(prefix) & (F.length(token) >= len(prefix) + len(suffix))


def _key(token: Column, prefix: str, suffix: str) -> Column:
    return F.substring(token, F.lit(len(prefix) + 1),
                       F.length(token) - (len(prefix) + len(suffix)))


def _value(key: Column, values: Column, builtins: Column, namespace: str) -> Column:
    builtin = F.try_element_at(builtins, F.substring(key, len(namespace) + 1, 2 ** 31 - 1))
    return F.when(key.startswith(namespace), builtin).otherwise(F.try_element_at(values, key))


def _empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def substitute(text: Column, values: Column, builtins: Column | None = None,
               prefix: str = PREFIX, suffix: str = SUFFIX,
               namespace: str = BUILTIN_NAMESPACE) -> Column:
    """Replace ``${key}`` by its value; ``$${`` gives a plain ``${``.

    ``values`` and ``builtins`` are map columns; keys in ``namespace`` are
    looked up in ``builtins`` only.  Values are not scanned again.  A prefix
    without a suffix stays as it is, and so does an undefined placeholder: see
    ``undefined_placeholders``.
    """
    builtins = _empty_map() if builtins is None else builtins

    def resolve(token: Column) -> Column:
        value = _value(_key(token, prefix, suffix), values, builtins, namespace)
        return (F.when(token == "$" + prefix, prefix)
                .when(_is_placeholder(token, prefix, suffix), F.coalesce(value, token))
                .otherwise(token))

    return F.array_join(F.transform(_tokens(text, prefix, suffix), resolve), "")


def undefined_placeholders(text: Column, values: Column, builtins: Column | None = None,
                           prefix: str = PREFIX, suffix: str = SUFFIX,
                           namespace: str = BUILTIN_NAMESPACE) -> Column:
    """Array of (key, line) of the placeholders without a value."""
    builtins = _empty_map() if builtins is None else builtins

    def located(tokens: Column) -> Column:
        return let(sums_before(F.transform(tokens, newlines)), lambda before: F.transform(
            tokens, lambda token, i: F.struct(
                token.alias("token"), (F.get(before, i) + 1).alias("line"))))

    def undefined(item: Column) -> Column:
        token = item["token"]
        return (_is_placeholder(token, prefix, suffix) & (token != "$" + prefix)
                & _value(_key(token, prefix, suffix), values, builtins, namespace).isNull())

    return F.transform(
        F.filter(let(_tokens(text, prefix, suffix), located), undefined),
        lambda item: F.struct(_key(item["token"], prefix, suffix).alias("key"), item["line"]))
