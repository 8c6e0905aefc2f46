"""Functions on records that SQL has no built-in for: recursive redaction and keyed digests, in Arrow batches."""

from __future__ import annotations

import hashlib
import hmac
import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

SENSITIVE = ("token", "password", "secret", "key", "authorization")


def _clean(x, partial: bool):
    if isinstance(x, list):
        return [_clean(v, partial) for v in x]
    if not isinstance(x, dict):
        return x
    out = {}
    for k, v in x.items():
        low = k.lower()
        if not any(s in low for s in SENSITIVE):
            out[k] = _clean(v, partial)
        elif not isinstance(v, str) or not v:
            out[k] = v
        else:
            out[k] = f"{v[:8]}...{v[-4:]}" if partial and "token" in low else "[REDACTED]"
    return out


def redact_json(partial_tokens: bool = False):
    """A function of a JSON text: strings under keys that sound secret give way, at any depth; other text is null."""

    @F.pandas_udf(T.StringType())
    def run(texts: pd.Series) -> pd.Series:
        def one(t):
            try:
                return None if t is None else json.dumps(_clean(json.loads(t), partial_tokens), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return None

        return texts.map(one)

    return run


@F.pandas_udf(T.StringType())
def hmac_sha256(secrets: pd.Series, messages: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or m is None else hmac.new(s.encode(), m.encode(), hashlib.sha256).hexdigest() for s, m in zip(secrets, messages, strict=True)])


def checked_json(text: Column, schema: str) -> Column:
    """``value`` (the text's JSON by ``schema``) and ``error``: why there is none, null for good JSON and for null."""
    good = F.try_parse_json(text).isNotNull()
    return F.struct(F.from_json(text, schema).alias("value"), F.when(text.isNotNull() & ~good, "invalid JSON").alias("error"))
