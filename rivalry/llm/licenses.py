"""License scans: MinHash bands over text windows, then exact containment.

Words are runs of letters and digits, lower-cased; a shingle is five words.
The windows of a text (``window`` shingles, one starting every ``stride``) and
all windows of the templates get MinHash signatures of ``bands`` values; a
text window that agrees with a template window in any band retrieves the
template.  A retrieved template matches if at least ``CONTAINMENT`` of its
distinct shingles occur in the document, counted exactly.

Two window classes cover templates of all lengths: long ones (from
``LONG`` shingles) by windows of 16 shingles, of which every passage of a long
template holds a whole one at each start; short ones by windows of a single
shingle, where the signature is the shingle itself and nothing is missed.
A template of fewer words than a shingle is retrieved and matched as its whole
word sequence, one without a word is refused.  A template may name a passage that a
document must hold whole, such as the version (``NOTICES``).
The bands are independent: each takes its minimum by half of a seeded 64-bit
hash of the shingle (:func:`_with_bands`), so windows of similarity s miss
each other in all eight with probability (1 - s)^8: 2.6e-6 at 0.8.

Everything is DataFrame code.  The template windows are joined by broadcast:
their number is bounded by the given templates and counted first.

Cases: a NULL or short text has no shingle and no match; NULL ids are scanned
and matched like any; rows that agree in id and text are one document; an
empty table or an empty list of templates gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import computed, pin, small

SHINGLE = 5
CONTAINMENT = 0.8
BANDS = 8
WINDOW, STRIDE = 16, 8    # in shingles; a window is two strides
LONG = WINDOW + STRIDE - 1

#: License notices as they are usually written.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "Released under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT-notice",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
     "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
     "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
     "conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software."),
    ("Apache-2.0-notice",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
     "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. "
     "See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0-notice",
     "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
     "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
     "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
     "GNU General Public License for more details."),
    ("BSD-notice",
     "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
     "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
     "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution."),
)

_BY = dict(TEMPLATES)

#: Fixed values: ``TEMPLATES`` with the versions told apart, and further notices; no whole license texts.
NOTICES: tuple[tuple[str, ...], ...] = (
    ("GPL-3.0", _BY["GPL-3.0"], "General Public License, version 3"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2.", "General Public License, version 2"),
    ("CC-BY-NC-4.0", _BY["CC-BY-NC-4.0"], _BY["CC-BY-NC-4.0"]),
    ("CC-BY-4.0", "Licensed under CC BY 4.0.", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY-SA 4.0."),
    ("MIT", _BY["MIT"]),
    ("Apache-2.0", _BY["Apache-2.0"]),
    ("MIT-notice", _BY["MIT-notice"]),
    ("Apache-2.0-notice", _BY["Apache-2.0-notice"]),
    ("GPL-3.0-notice", _BY["GPL-3.0-notice"], "GNU General Public License as published by the Free Software Foundation, "
                                              "either version 3 of the License"),
    *((f"{short}-notice", _BY["GPL-3.0-notice"].replace("This program", f"This {what}").replace(
        "GNU General Public License", f"GNU {name}").replace("version 3 of", f"version {v} of"),
       f"GNU {name} as published by the Free Software Foundation, either version {v} of the License")
      for short, what, name, v in (("GPL-2.0", "program", "General Public License", "2"),
                                   ("LGPL-2.1", "library", "Lesser General Public License", "2.1"),
                                   ("LGPL-3.0", "library", "Lesser General Public License", "3"),
                                   ("AGPL-3.0", "program", "Affero General Public License", "3"))),
    ("MPL-2.0-notice",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "Mozilla Public License, v. 2.0"),
    ("BSD-notice", _BY["BSD-notice"]),
    ("BSD-3-clause",
     "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
     "products derived from this software without specific prior written permission."),
    ("Proprietary", "All rights reserved."),
)

_WORDS = r"[^\p{L}\p{N}]+"


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _WORDS), "")


def _starts(w: Column) -> Column:
    n = F.size(w) - (SHINGLE - 1)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))


def shingles(w: Column) -> Column:
    """Five-word shingles as text, in order."""
    return F.transform(_starts(w), lambda i: F.concat_ws(" ", *[w[i + j] for j in range(SHINGLE)]))


def hashes(w: Column) -> Column:
    """Hash of every five-word shingle, in order."""
    return F.transform(_starts(w), lambda i: F.xxhash64(*[w[i + j] for j in range(SHINGLE)]))


def _seeded(hashes: str, seed: int) -> Column:
    """A hash of every shingle's hash; its upper half orders one band, its
    lower half the next."""
    return F.transform(F.col(hashes), lambda h: F.xxhash64(F.lit(seed), h))


def _lower(values: str) -> Column:
    return F.transform(F.col(values), lambda h: F.shiftleft(h, 32))


def _with_bands(d: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``keys`` and ``_h0`` to ``_h7``, the shingles' values in every band."""
    d = computed(d, keys, **{f"_h{b}": _seeded("hashes", b + 1) for b in range(0, BANDS, 2)})
    return computed(d, [*keys, *[f"_h{b}" for b in range(0, BANDS, 2)]], **{f"_h{b}": _lower(f"_h{b - 1}") for b in range(1, BANDS, 2)})


def _minimum(values: str, start: Column, width: int) -> Column:
    """Least value of ``width`` shingles (positions behind the end do not
    count)."""
    return F.least(*[F.get(F.col(values), start + j) for j in range(width)])


def _inline_bands(d: DataFrame, keys: Sequence[str], minima) -> DataFrame:
    """(keys, band, value) of the signature values of all windows."""
    value = lambda b, m: F.transform(m, lambda x: F.struct(F.lit(b).alias("band"), x.alias("value")))
    return d.select(*keys, F.inline(F.concat(*[value(b, minima(b)) for b in range(BANDS)])))


def _template_signatures(t: DataFrame) -> DataFrame:
    """Signatures of all windows of the long templates."""
    starts = F.sequence(F.lit(0), F.size("_h0") - WINDOW)

    def all_windows(b):
        return F.transform(starts, lambda i: _minimum(f"_h{b}", i, WINDOW))
    return _inline_bands(_with_bands(t, ["license"]), ["license"], all_windows).distinct()


def _text_signatures(h: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signatures of the windows of a text that start every ``STRIDE``: a
    window is two neighbouring blocks of ``STRIDE`` shingles."""
    starts = F.sequence(F.lit(0), F.size("_h0") - 1, F.lit(STRIDE))
    d = _with_bands(h.where(F.size("hashes") > 0), keys)

    def blocks(b):
        return F.transform(starts, lambda i: _minimum(f"_h{b}", i, STRIDE))
    d = computed(d, keys, **{f"_b{b}": blocks(b) for b in range(BANDS)})

    def windows(b):
        return F.transform(F.col(f"_b{b}"), lambda x, i: F.least(x, F.get(F.col(f"_b{b}"), i + 1)))
    return _inline_bands(d, keys, windows)


def template_table(spark: SparkSession, templates: Sequence[tuple[str, ...]] = TEMPLATES) -> DataFrame:
    """(license, w, must, shingles, hashes): the words of every template, the
    shingles of its passage that must occur, its distinct shingles."""
    t = spark.createDataFrame([(x[0], x[1], x[2] if len(x) > 2 else "") for x in templates],
                              "license string, text string, must string")
    w = computed(t, ["license"], w=_tokens(F.col("text")), m=_tokens(F.col("must")))
    return computed(w, ["license", "w"], must=shingles(F.col("m")), shingles=F.array_distinct(shingles(F.col("w"))),
                    hashes=hashes(F.col("w")))


def _sequences(w: Column, n: int) -> Column:
    """The distinct sequences of ``n`` words as text."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.concat_ws(" ", *[w[i + j] for j in range(n)])))


def _run_hashes(w: Column, n: int) -> Column:
    """Hash of every sequence of ``n`` words, in order."""
    starts = F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[w[i + j] for j in range(n)]))


def scan(docs: DataFrame, templates: Sequence[tuple[str, ...]] = TEMPLATES, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """(doc_id, license, n_shared, n_shingles): the templates of which a
    document holds at least ``CONTAINMENT`` (and the passage that must occur)."""
    spark = docs.sparkSession
    every = pin(template_table(spark, templates))
    words = [(r["license"], r["n"]) for r in every.select("license", F.size("w").alias("n")).collect()]
    if empty := [name for name, n in words if not n]:
        raise ValueError(f"templates without a word: {empty}")
    t = every.where(F.size("shingles") > 0)
    long_ = F.size("shingles") >= LONG
    short_index = t.where(~long_).select("license", F.explode("hashes").alias("value")).distinct()
    long_index = _template_signatures(t.where(long_))
    # shorter templates are retrieved by the hash of their whole word sequence
    lengths = sorted({n for _, n in words if n < SHINGLE})
    brief = every.where(F.size("w") < SHINGLE)
    for n in lengths:
        own = brief.where(F.size("w") == n).select("license", F.explode(_run_hashes(F.col("w"), n)).alias("value"))
        short_index = short_index.unionByName(own)

    d = docs.select(F.col(key).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), F.col(text).alias("text"))
    h = computed(computed(d, ["doc_id", "th"], w=_tokens(F.col("text"))), ["doc_id", "th"], hashes=hashes(F.col("w")),
                 runs=F.concat(F.array().cast("array<bigint>"), *[_run_hashes(F.col("w"), n) for n in lengths]))
    found = (h.select("doc_id", "th", F.explode(F.concat("hashes", "runs")).alias("value")).join(small(pin(short_index)), "value")
             .select("doc_id", "th", "license"))
    found = found.unionByName(_text_signatures(h, ["doc_id", "th"]).join(small(pin(long_index)), ["band", "value"])
                              .select("doc_id", "th", "license"))
    found = found.groupBy("doc_id", "th", "license").count().groupBy("doc_id", "th").agg(
        F.collect_set("license").alias("licenses"))          # at most one of each template

    # exact containment, on the words of the retrieved documents only
    c = pin(found.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "licenses"))
    seen = d.join(small(c), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")))
    seen = computed(seen, ["doc_id", "th", "licenses"], w=_tokens(F.col("text")))
    own = computed(seen, ["doc_id", "th", "licenses"], own=F.array_distinct(shingles(F.col("w"))),
                   runs=F.concat(F.array().cast("array<string>"), *[_sequences(F.col("w"), n) for n in lengths]))
    pairs = own.select("doc_id", "th", "own", F.explode("licenses").alias("license")).join(
        F.broadcast(t.select("license", "shingles", "must")), "license")
    pairs = pairs.where(F.size(F.array_except("must", "own")) == 0)
    pairs = computed(pairs, ["doc_id", "th", "license", F.size("shingles").cast("long").alias("n_shingles")],
                     n_shared=F.size(F.array_intersect("shingles", "own")).cast("long"))
    whole = pairs.where(F.col("n_shared") >= F.lit(CONTAINMENT) * F.col("n_shingles"))
    if lengths:
        one = F.lit(1).cast("long")
        whole = whole.unionByName(
            own.select("doc_id", "th", "runs", F.explode("licenses").alias("license"))
            .join(F.broadcast(brief.select("license", F.concat_ws(" ", "w").alias("value"))), "license")
            .where(F.array_contains("runs", F.col("value")))
            .select("doc_id", "th", "license", one.alias("n_shingles"), one.alias("n_shared")))
    return whole.distinct().select("doc_id", "license", "n_shared", "n_shingles")


def oracle_sql(templates: Sequence[tuple[str, ...]] = TEMPLATES) -> str:
    """All documents against all templates, exactly, in DuckDB."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(x[0])}, {quote(x[1])}, {quote(x[2] if len(x) > 2 else '')})" for x in templates)
    split = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    gram = lambda n: "concat_ws(' ', " + ", ".join(["x", *[f"lead(x, {i}) OVER w" for i in range(1, n)]]) + ")"
    cut = lambda n, t: (
        f"SELECT DISTINCT rid, s FROM (SELECT rid, {gram(n)} AS s, lead(x, {n - 1}) OVER w AS e FROM (SELECT rid, unnest(w) AS x, "
        f"generate_subscripts(w, 1) AS i FROM {t}) WINDOW w AS (PARTITION BY rid ORDER BY i)) WHERE e IS NOT NULL")
    brief = " UNION ALL ".join(f"SELECT rid, s FROM ({cut(n, 'd')})" for n in range(1, SHINGLE))
    return f"""
WITH raw AS (SELECT * FROM (VALUES {rows}) AS x(license, body, must)),
t AS (SELECT license AS rid, {split.format('body')} AS w FROM raw),
ts AS ({cut(SHINGLE, 't')}),
tn AS (SELECT rid AS license, count(*) AS n FROM ts GROUP BY rid),
mw AS (SELECT license AS rid, {split.format('must')} AS w FROM raw),
must AS ({cut(SHINGLE, 'mw')}),
mn AS (SELECT rid AS license, count(*) AS n_must FROM must GROUP BY rid),
u AS (SELECT row_number() OVER () AS rid, doc_id, text FROM (SELECT DISTINCT doc_id, text FROM documents)),
d AS (SELECT rid, {split.format('text')} AS w FROM u),
ds AS ({cut(SHINGLE, 'd')}),
m AS (SELECT ds.rid, ts.rid AS license, count(*) AS k FROM ds JOIN ts USING (s) GROUP BY ALL),
held AS (SELECT ds.rid, must.rid AS license, count(*) AS k_must FROM ds JOIN must USING (s) GROUP BY ALL),
tb AS (SELECT rid AS license, array_to_string(w, ' ') AS s FROM t WHERE len(w) < {SHINGLE}),
db AS (SELECT rid, license FROM ({brief}) JOIN tb USING (s))
SELECT doc_id, license, CAST(k AS BIGINT) AS n_shared, CAST(n AS BIGINT) AS n_shingles
FROM m JOIN tn USING (license) JOIN u USING (rid) LEFT JOIN mn USING (license) LEFT JOIN held USING (rid, license)
WHERE k >= {CONTAINMENT} * n AND coalesce(k_must, 0) >= coalesce(n_must, 0)
UNION ALL SELECT DISTINCT doc_id, license, 1, 1 FROM db JOIN u USING (rid)"""
