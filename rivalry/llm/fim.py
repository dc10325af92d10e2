"""Fill-in-middle transformation with a learned rank index.

A document is cut at two units of its text into prefix, middle and suffix, and
written with sentinels so that the middle comes last.  Where a unit starts is
told by a piecewise-linear learned index over all boundary offsets of the
text: greedy segments whose line stays within :data:`ERROR` bytes of every
boundary, and one stored residual per boundary.  A cut looks its segment up,
predicts the byte offset and adds the residual, so it is exact; plain ASCII is
one segment whatever its length.

The cuts and the form come from the SHA-256 of a salt and the document id, so
a rerun, a retry or another partitioning gives the same rows.

Cases: a NULL text is empty and stays plain; a NULL id is hashed as the salt
alone; repeated ids are cut alike; a text that holds a sentinel stays plain;
an empty table gives an empty result; other columns pass through (an input
column named like one of the new ones gives way).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

SENTINELS = ("<P>", "<S>", "<M>")     # prefix, suffix, middle
SALT = "1:"
PLAIN_FROM = 90          # of 100: texts left as they are
SPM_BELOW = 20           # of 100: suffix first
ERROR = 120              # bytes a segment's line may be off; a residual fits one byte
SPAN = 1 << 16           # boundaries looked at in one step
UNITS = ("char", "line")

NEW = "struct<fim_form:string,fim_units:bigint,fim_prefix:bigint,fim_middle:bigint,fim_text:binary>"


def boundaries(data: np.ndarray, unit: str = "char") -> np.ndarray:
    """Byte offsets at which the units of a UTF-8 text start, and its length."""
    if unit == "char":
        starts = np.flatnonzero((data & 0xC0) != 0x80)
    elif unit == "line":
        starts = np.flatnonzero(np.concatenate(([10], data[:-1])) == 10) if len(data) else np.zeros(0, np.int64)
    else:
        raise ValueError(f"unit must be one of {UNITS}")
    return np.append(starts, len(data)).astype(np.int32)


class RankIndex:
    """rank -> offset of an ascending sequence of offsets."""

    def __init__(self, offsets: np.ndarray, error: int = ERROR):
        n, s = len(offsets), 0
        first, slope = [], []
        while s < n:
            lo, hi, e, step = -np.inf, np.inf, s + 1, 64
            while e < n:              # narrow the cone of slopes until a boundary falls out of it
                dx = np.arange(e - s, min(n, e + step) - s)
                dy = offsets[e:e + step].astype(np.int64) - int(offsets[s])
                high = np.minimum(np.minimum.accumulate((dy + error) / dx), hi)
                low = np.maximum(np.maximum.accumulate((dy - error) / dx), lo)
                out = low > high
                if out.any():
                    k = int(out.argmax())
                    if k:
                        lo, hi = low[k - 1], high[k - 1]
                    e += k
                    break
                lo, hi = low[-1], high[-1]
                e += len(dx)
                step = min(2 * step, SPAN)
            first.append(s)
            slope.append((lo + hi) / 2 if e > s + 1 else 0.0)
            s = e
        self.first, self.slope = np.array(first, np.int64), np.array(slope)
        self.base = offsets[self.first].astype(np.int64)
        self.residual = np.empty(n, np.int8)
        for a in range(0, n, SPAN):
            ranks = np.arange(a, min(n, a + SPAN))
            self.residual[a:a + SPAN] = offsets[a:a + SPAN] - self.predict(ranks)

    def predict(self, ranks: np.ndarray) -> np.ndarray:
        seg = np.searchsorted(self.first, ranks, "right") - 1
        return self.base[seg] + np.floor(self.slope[seg] * (ranks - self.first[seg]) + 0.5).astype(np.int64)

    def at(self, ranks: Sequence[int]) -> list[int]:
        r = np.asarray(ranks, np.int64)
        return (self.predict(r) + self.residual[r]).tolist()


def draws(key: int | None, salt: str = SALT) -> tuple[int, ...]:
    """The first four 32-bit numbers of a document's hash."""
    h = hashlib.sha256(f"{salt}{'' if key is None else key}".encode()).hexdigest()
    return tuple(int(h[i:i + 8], 16) for i in range(0, 32, 8))


def _cutter(unit: str, sentinels: tuple[str, str, str], salt: str, plain_from: int, spm_below: int):
    p, s, m = (x.encode() for x in sentinels)
    marked = re.compile(b"|".join(re.escape(x) for x in (p, s, m))).search
    kind = pa.struct([("fim_form", pa.string()), ("fim_units", pa.int64()), ("fim_prefix", pa.int64()),
                      ("fim_middle", pa.int64()), ("fim_text", pa.binary())])

    def one(key, text: bytes):
        at = boundaries(np.frombuffer(text, np.uint8), unit)
        n = len(at) - 1
        h1, h2, h3, h4 = draws(key, salt)
        if not n or h3 % 100 >= plain_from or marked(text):
            return "plain", n, None, None, text
        i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = RankIndex(at).at((i, j))
        if h4 % 100 < spm_below:
            return "spm", n, i, j - i, b"".join((s, text[b:], p, text[:a], m, text[a:b]))
        return "psm", n, i, j - i, b"".join((p, text[:a], s, text[b:], m, text[a:b]))

    @F.arrow_udf(NEW)
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for keys, texts in batches:
            rows = [one(k, t.as_py() or b"") for k, t in zip(keys.to_pylist(), texts)]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kind)], fields=list(kind))
    return cut


def transform(docs: DataFrame, text: str = "text", key: str = "doc_id", unit: str = "char",
              sentinels: tuple[str, str, str] = SENTINELS, salt: str = SALT, plain_from: int = PLAIN_FROM,
              spm_below: int = SPM_BELOW) -> DataFrame:
    """``docs`` plus ``fim_form`` (plain, psm or spm), ``fim_units`` (units of
    the text), ``fim_prefix`` and ``fim_middle`` (units, NULL if plain) and
    ``fim_text``, the text to train on."""
    if len({*sentinels}) < 3 or any(not x or a in b for x in sentinels for a in sentinels for b in sentinels if a != b):
        raise ValueError("the sentinels must differ and none may hold another")
    cut = _cutter(unit, tuple(sentinels), salt, plain_from, spm_below)
    d = packed(docs, _fim=cut(F.col(key).cast("long"), F.col(text).cast("binary")))
    return unpacked(d, docs.columns, *[F.col(f"_fim.{c}").alias(c) for c in ("fim_form", "fim_units", "fim_prefix", "fim_middle")],
                    F.col("_fim.fim_text").cast("string").alias("fim_text"))


def restore(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text of which ``text`` was made.  No part holds a sentinel, so the
    sentinels part them."""
    part = F.split(text, "|".join(re.escape(x) for x in sentinels), -1)
    piece = lambda i: F.get(part, F.lit(i))
    return (F.when(form == "psm", F.concat(piece(1), piece(3), piece(2)))
            .when(form == "spm", F.concat(piece(2), piece(3), piece(1))).otherwise(text))


def oracle_sql() -> str:
    return """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
x AS (
  SELECT *, ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT % (n + 1) AS c1, ('0x' || substr(h, 9, 8))::UBIGINT::BIGINT % (n + 1) AS c2,
         ('0x' || substr(h, 17, 8))::UBIGINT::BIGINT % 100 AS c3, ('0x' || substr(h, 25, 8))::UBIGINT::BIGINT % 100 AS c4 FROM d),
f AS (
  SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c3 >= 90 THEN 'plain'
                 WHEN c4 < 20 THEN 'spm' ELSE 'psm' END AS form, least(c1, c2) AS a, greatest(c1, c2) AS b FROM x),
p AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN a::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN (b - a)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM p"""
