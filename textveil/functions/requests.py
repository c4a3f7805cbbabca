"""Texts put back into the JSON bodies that they were taken from."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _patched(value, patch: dict):
    """``value`` with the texts of ``patch``, a trie of pointers: its steps, and under None the new text.

    A step that leads nowhere changes nothing.  Serialised JSON is parsed and written once for all that lies below it.
    A number stays one if its text is the one it had.
    """
    if None in patch:
        same = isinstance(value, int | float) and not isinstance(value, bool) and json.dumps(value) == patch[None]
        return value if same else patch[None]
    if isinstance(value, dict):
        for k in value:
            if k in patch:
                value[k] = _patched(value[k], patch[k])
    elif isinstance(value, list):
        for k in patch:
            if k.isdigit() and int(k) < len(value):
                value[int(k)] = _patched(value[int(k)], patch[k])
    elif isinstance(value, str):
        try:
            return json.dumps(_patched(json.loads(value), patch), ensure_ascii=False)
        except ValueError:
            return value
    return value


def written_back(body: Column, pointers: Column, texts: Column) -> Column:
    """``body`` with the texts at the pointers replaced; key order and everything else stay.

    As many texts as pointers, else it is an error.  A null body stays null, one that is no JSON, or has nothing to replace, as it is.
    """

    @F.pandas_udf("string")
    def put(bodies: pd.Series, where: pd.Series, what: pd.Series) -> pd.Series:
        out = []
        for text, ps, ts in zip(bodies, where, what, strict=True):
            ps, ts = ([] if x is None else list(x) for x in (ps, ts))
            if len(ps) != len(ts):
                raise ValueError(f"{len(ps)} pointers, but {len(ts)} texts")
            patch: dict = {}
            for p, t in zip(ps, ts, strict=True):
                at = patch
                for step in p.split("/"):
                    at = at.setdefault(step.replace("~1", "/").replace("~0", "~"), {})
                at[None] = t
            try:
                out.append(json.dumps(_patched(json.loads(text), patch), ensure_ascii=False) if patch else text)
            except (TypeError, ValueError):
                out.append(text)
        return pd.Series(out, dtype=object)

    return put(body, pointers, texts)


#: What a model is told about placeholders.
HINT = "Tokens such as [[PERSON_A1]] stand for private values. Keep every one of them as it is, with its brackets."


def with_hint(body: Column, place: str, wrapped: str | None = None, hint: str = HINT) -> Column:
    """``body`` with a system message of ``hint`` before the list at ``place``, its own entry; all else stays.

    With ``wrapped``, the ``type`` of an entry, a bare string at ``place`` becomes the second entry and a null the empty list.
    Bodies that are null, no JSON object, or without a list there stay as they are.
    """
    kind = {"type": wrapped} if wrapped else {}
    first = {**kind, "role": "system", "content": hint}

    @F.pandas_udf("string")
    def put(bodies: pd.Series) -> pd.Series:
        out = []
        for text in bodies:
            try:
                value = json.loads(text)
            except (TypeError, ValueError):
                value = None
            if isinstance(value, dict) and place in value:
                rest = value[place]
                if wrapped and (rest is None or isinstance(rest, str)):
                    rest = [{**kind, "role": "user", "content": rest}] if rest is not None else []
                if isinstance(rest, list):
                    value[place] = [first, *rest]
                    text = json.dumps(value, ensure_ascii=False)
            out.append(text)
        return pd.Series(out, dtype=object)

    return put(body)
