"""Masking of secret values and access to fields of JSON payloads."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlight.functions import jsonspans
from ledgerlight.functions.money import as_col

# Key segments that mark a secret, segments that overrule them, visible ends.
SENSITIVE_SEGMENTS = ("password", "secret", "key", "token", "auth", "authorization", "credential", "access", "private",
                      "certificate", "fingerprint", "tenancy")
HARMLESS_SEGMENTS = ("cost",)
VISIBLE = 4


def mask_value(value: Column) -> Column:
    """Keep four characters at each end; values shorter than eight stay as they are."""
    size = F.length(value)
    masked = F.concat(F.left(value, F.lit(VISIBLE)), F.repeat(F.lit("*"), size - 2 * VISIBLE),
                      F.right(value, F.lit(VISIBLE)))
    return F.when(size < 2 * VISIBLE, value).otherwise(masked)


def is_sensitive(key: Column) -> Column:
    """A whole segment of the key must match, so max_tokens is not taken for a token."""
    segments = F.split(F.replace(F.lower(key), F.lit("-"), F.lit("_")), "_")
    return (F.arrays_overlap(segments, F.array(*[F.lit(s) for s in SENSITIVE_SEGMENTS]))
            & ~F.arrays_overlap(segments, F.array(*[F.lit(s) for s in HARMLESS_SEGMENTS])))


def mask_map(config: Column) -> Column:
    return F.transform_values(config, lambda k, v: F.when(is_sensitive(k), mask_value(v)).otherwise(v))


def _mask_tree(node, secret: bool):
    if isinstance(node, dict):
        return {k: _mask_tree(v, _secret_name(k)) for k, v in node.items()}
    if isinstance(node, list):
        return [_mask_tree(v, secret and not isinstance(v, dict)) for v in node]
    if secret and isinstance(node, str) and len(node) >= 2 * VISIBLE:
        return node[:VISIBLE] + "*" * (len(node) - 2 * VISIBLE) + node[-VISIBLE:]
    return node


def _secret_name(key: str) -> bool:
    segments = set(key.lower().replace("-", "_").split("_"))
    return bool(segments & set(SENSITIVE_SEGMENTS)) and not segments & set(HARMLESS_SEGMENTS)


@F.pandas_udf(T.StringType())
def mask_json(payloads: pd.Series) -> pd.Series:
    """Mask a JSON document of any depth; text that is no JSON passes unchanged."""
    def one(text):
        try:
            return json.dumps(_mask_tree(json.loads(text), False), separators=(",", ":"), ensure_ascii=False)
        except (TypeError, ValueError):
            return text

    return payloads.map(one)


def path_steps(path: str) -> list[str | int | None]:
    """Steps of a dotted path: names (a dot in a name is escaped by a backslash), positions `[0]`, and None for `[*]`."""
    steps: list[str | int | None] = []
    for token in re.finditer(r"\[(\*|\d+)\]|((?:\\.|[^.\[\\])+)", path):
        place, name = token.groups()
        steps.append(re.sub(r"\\(.)", r"\1", name) if name is not None else None if place == "*" else int(place))
    return steps


def json_path(path: str) -> str:
    """The JSON path expression of a dotted path."""
    return "$" + "".join("[*]" if s is None else f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in path_steps(path))


def payload_fields(column: str, paths: dict[str, str]) -> list[Column]:
    """One text column per dotted path; a path that leads nowhere gives null."""
    return [F.get_json_object(column, json_path(path)).alias(name) for name, path in paths.items()]


def payload_prune(payload: Column | str, paths: Sequence[str]) -> Column:
    """The payload without the dotted *paths*; every other character stays, and so does text that is no JSON.

    Positions are those of the payload as it is.
    """
    routes = [path_steps(p) for p in paths]

    @F.pandas_udf(T.StringType())
    def prune(payloads: pd.Series) -> pd.Series:
        return payloads.map(lambda text: jsonspans.without(text, routes))

    return prune(as_col(payload))


def json_text(payload: Column | str, paths: Sequence[str]) -> Column:
    """Texts found under a list of JSON paths, one per line."""
    return F.concat_ws("\n", *[F.get_json_object(as_col(payload), p) for p in paths])
