"""Tokenizers as Column functions.

* ``CodePointTokenizer`` -- the offline default: one id per Unicode code point,
  built-in expressions only (no Python on the hot path).
* ``WhitespaceCounter``  -- the reference's fallback count, ``len(text.split())``.
* ``HFTokenizer``        -- a real tokenizer from a local ``tokenizer.json``
  through an iterator ``pandas_udf`` (Arrow batches; the tokenizer is loaded
  once per Python worker, not per row).  Gated on the ``tokenizers`` package.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import whitespace_token_count


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


@dataclass(frozen=True)
class CodePointTokenizer:
    """ids = code points; BOS U+0002 is the only special token added; EOS is U+0003."""

    name: str = "codepoint"
    bos_id: int = 2
    eos_token: str = "\u0003"
    pad_id: int | None = None

    def encode(self, text, add_special_tokens: bool = False) -> Column:
        t = _c(text)
        ids = F.when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(
            F.transform(F.split(t, ""), lambda ch: F.ascii(ch)))
        if add_special_tokens:
            ids = F.concat(F.array(F.lit(self.bos_id)), ids)
        return ids

    def count(self, text, add_special_tokens: bool = False) -> Column:
        n = F.coalesce(F.length(_c(text)), F.lit(0)).cast("bigint")
        return n + 1 if add_special_tokens else n

    @property
    def eos_id(self) -> int:
        return ord(self.eos_token)

    @property
    def pad_or_eos(self) -> int:
        return self.pad_id if self.pad_id is not None else self.eos_id


@dataclass(frozen=True)
class WhitespaceCounter:
    name: str = "split_estimate"

    def count(self, text, add_special_tokens: bool = False) -> Column:
        return whitespace_token_count(text)


class HFTokenizer:
    """A ``tokenizers`` tokenizer file applied with an iterator pandas UDF."""

    def __init__(self, path: str, eos_token: str | None = None, pad_id: int | None = None,
                 name: str = "llama_tokenizer"):
        import tokenizers  # noqa: F401  (fail early if the package is missing)

        self.path, self.eos_token, self.pad_id, self.name = path, eos_token, pad_id, name
        with open(path, encoding="utf-8") as f:  # read here and shipped, so workers need no such file
            self._json = f.read()

    @property
    def eos_id(self) -> int | None:
        """Id of ``eos_token`` in the tokenizer file; None if it has none."""
        if not self.eos_token:
            return None
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self._json).token_to_id(self.eos_token)

    @property
    def pad_or_eos(self) -> int:
        """Padding id: ``pad_id``, else the id of the end token."""
        pad = self.pad_id if self.pad_id is not None else self.eos_id
        if pad is None:
            raise ValueError("the tokenizer needs a pad_id, or an eos_token that its file knows, to pad batches")
        return pad

    def _udf(self, add_special_tokens: bool, counts: bool):
        text = self._json
        rtype = T.LongType() if counts else T.ArrayType(T.IntegerType())

        @F.pandas_udf(rtype)
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(text)
            for s in batches:
                texts = s.fillna("").tolist()
                enc = tok.encode_batch(texts, add_special_tokens=add_special_tokens)
                if counts:
                    yield pd.Series([len(e.ids) if t else 0 for e, t in zip(enc, texts)])
                else:
                    yield pd.Series([list(e.ids) if t else [] for e, t in zip(enc, texts)])

        return run

    def encode(self, text, add_special_tokens: bool = False) -> Column:
        return self._udf(add_special_tokens, False)(_c(text))

    def count(self, text, add_special_tokens: bool = False) -> Column:
        return self._udf(add_special_tokens, True)(_c(text))
