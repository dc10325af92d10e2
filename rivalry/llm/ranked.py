"""Ranked lexical search, term at a time with limited accumulators.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII,
ASCII letters lower-cased.  Scores are whole numbers: per query term its weight
times a saturated, length-normalised term frequency (:func:`search`).

The documents are searched where they lie.  One pass keeps, per document, its
length and the query terms it holds (the collection's counts come from that
table, over all documents); a second one turns blocks of it into small inverted
lists and answers every query on each block:

* terms are taken rarest first, each adding its part to the accumulators of
  the documents that hold it;
* once the bounds of the terms to come, taken together, stay under the k-th
  largest partial score, a document without an accumulator cannot reach the
  block's best ``k`` any more: no accumulator is created from there on;
* those that exist are updated to the end, so their scores are exact.

A block returns its best ``k`` with exact scores; the best ``k`` of all blocks
are the result.  So a query costs ``k`` rows a block, whatever its terms.

Queries are taken from the driver in groups of at most ``QUERY_BYTES`` of text
(one query at least); each group is one such run over all documents.

Cases: NULL texts and texts without a term are no documents and match nothing;
a query without a term has no rows; each row of the queries is a query of its
own, also where ids repeat or are NULL; documents with equal ids are documents
of their own; equal scores go by ascending id, a NULL id last; an empty table
on either side gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pin

K = 10
QUERY_BYTES = 4 << 20        # text of the queries of one run
BLOCK_POSTINGS = 2_000_000   # postings and documents a task holds at a time
BLOCK_DOCS = 200_000

#: Separators become spaces, A-Z become a-z; UTF-8 bytes beyond ASCII stay.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: bytes | None) -> list[bytes]:
    return text.translate(_TERMS).split() if text else []


def _forward(vocabulary):
    """(id, text) -> (id, length, query terms held, how often); documents only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value
        for batch in batches:
            pick, length, at, held, often = [], [], [0], [], []
            for i, text in enumerate(batch.column(1)):
                words = terms(text.as_py())
                if not words:
                    continue
                found = Counter(filter(number.__contains__, words))
                pick.append(i)
                length.append(len(words))
                held.extend(map(number.__getitem__, found))
                often.extend(found.values())
                at.append(len(held))
            if pick:
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(pick)), pa.array(length, pa.int64()),
                     pa.ListArray.from_arrays(at, pa.array(held, pa.int32())),
                     pa.ListArray.from_arrays(at, pa.array(often, pa.int64()))], names=["id", "n", "terms", "tf"])
    return run


class Block:
    """Inverted lists of some documents."""

    def __init__(self, n: np.ndarray, counts: np.ndarray, held: np.ndarray, tf: np.ndarray, n_terms: int,
                 n_docs: int, total: int):
        m = 25 + (75 * n * n_docs) // total
        doc = np.repeat(np.arange(len(n)), counts)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.argsort(held, kind="stable")
        self.doc, self.impact = doc[order], impact[order]
        self.first = np.concatenate(([0], np.cumsum(np.bincount(held, minlength=n_terms))))
        self.most = np.zeros(n_terms, np.int64)
        there = np.flatnonzero(np.diff(self.first))
        if len(there):
            self.most[there] = np.maximum.reduceat(self.impact, self.first[there])
        self.score = np.zeros(len(n), np.int64)
        self.created = 0         # accumulators, for tests

    def best(self, query: list[tuple[int, int]], k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the best ``k`` (all that tie with the
        last) and their scores; ``query``: (term, weight), rarest first."""
        score = self.score
        score[:] = 0
        query = [(t, w, w * int(self.most[t])) for t, w in query]
        query = [q for q in query if q[2] > 0]
        left, done = sum(q[2] for q in query), 0
        alive = None
        for t, w, bound in query:
            doc = self.doc[self.first[t]:self.first[t + 1]]
            impact = self.impact[self.first[t]:self.first[t + 1]]
            left, done = left - bound, done + bound
            if alive is None:
                score[doc] += w * impact
                if left < done:
                    some = np.flatnonzero(score)
                    if len(some) >= k and np.partition(score[some], -k)[-k] > left:
                        alive = some
            elif 16 * len(alive) < len(doc):        # few accumulators: look them up in the list
                at = np.minimum(np.searchsorted(doc, alive), len(doc) - 1)
                hit = doc[at] == alive
                score[alive[hit]] += w * impact[at[hit]]
            else:
                hit = score[doc] > 0
                score[doc[hit]] += w * impact[hit]
        some = np.flatnonzero(score)
        self.created = len(some)
        found = score[some]
        if len(some) > k:
            enough = found >= np.partition(found, -k)[-k]
            some, found = some[enough], found[enough]
        return some, found.copy()


def _answers(held, k: int):
    """Forward rows -> (item, doc_id, score) of every block's best."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, n_terms, n_docs, total = held.value
        kept, postings, rows = [], 0, 0

        def close():
            table = pa.Table.from_batches(kept).combine_chunks()
            ids = table["id"].combine_chunks()
            lists, tf = (table[c].combine_chunks() for c in ("terms", "tf"))
            counts = np.diff(lists.offsets.to_numpy())
            block = Block(table["n"].to_numpy(), counts, lists.flatten().to_numpy(), tf.flatten().to_numpy(), n_terms,
                          n_docs, total)
            null, key = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            item, doc, score = [], [], []
            for number, query in queries:
                at, found = block.best(query, k)
                order = np.lexsort((key[at], null[at], -found))[:k]
                item.append(np.full(len(order), number))
                doc.append(at[order])
                score.append(found[order])
            item, doc, score = (np.concatenate(x).astype(np.int64) for x in (item, doc, score))
            return pa.RecordBatch.from_arrays([pa.array(item), ids.take(pa.array(doc)), pa.array(score)],
                                              names=["item", "doc_id", "score"])

        for batch in batches:
            if not batch.num_rows:
                continue
            size = len(batch.column("terms").flatten())
            if kept and (postings + size > BLOCK_POSTINGS or rows + batch.num_rows > BLOCK_DOCS):
                yield close()
                kept, postings, rows = [], 0, 0
            kept.append(batch)
            postings, rows = postings + size, rows + batch.num_rows
        if kept:
            yield close()
    return run


def _groups(queries: DataFrame, text: str, size: int) -> Iterator[list[tuple[object, bytes]]]:
    group, held = [], 0
    for row in queries.toLocalIterator():
        body = bytes(row[1] or b"")
        if group and held + len(body) > size:
            yield group
            group, held = [], 0
        group.append((row[0], body))
        held += len(body)
    if group:
        yield group


def search(docs: DataFrame, queries: DataFrame, k: int = K, text: str = "text", key: str = "doc_id",
           query_text: str = "text", query_key: str = "item_id", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The ``k`` best documents of every query: ``item_id``, ``rank`` (from 1),
    ``doc_id``, ``score``, for scores above 0.

    With N documents (texts with a term), L terms in all of them, n terms in a
    document, a term in df documents and tf times in one: the weight of a term
    is ``floor(1000 ln((2N + 2) / (2 df + 1)))``, a document's m is ``25 +
    (75 n N) div L``, its score the sum over the query's terms, repeats
    included, of weight times ``(10^9 tf) div (1000 tf + 8 m)``.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    source = docs.select(F.col(key).cast("long"), F.col(text).cast("binary"))
    kind = queries.schema[query_key].dataType
    asked = queries.select(F.col(query_key), F.col(query_text).cast("binary"))
    names: list[tuple[int, object]] = []
    parts: list[DataFrame] = []
    for group in _groups(asked, query_text, query_bytes):
        wanted = [(len(names) + i, Counter(terms(body))) for i, (_, body) in enumerate(group)]
        named = spark.createDataFrame([(len(names) + i, item) for i, (item, _) in enumerate(group)],
                                      f"item long, item_id {kind.simpleString()}")
        names += [(len(names) + i, item) for i, (item, _) in enumerate(group)]
        words = sorted(set().union(*[c for _, c in wanted]))
        if not words:
            continue
        number = {w: i for i, w in enumerate(words)}
        forward = pin(source.mapInArrow(_forward(share(number)), "id long, n long, terms array<int>, tf array<long>"))
        n_docs, total = forward.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        # one row for each term of the queries
        df = dict(forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect())
        weight = {w: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df.get(i, 0) + 1))) for w, i in number.items()}
        plan = [(item, [(number[w], weight[w] * often) for w, often in
                        sorted(c.items(), key=lambda x: (df.get(number[x[0]], 0), x[0]))]) for item, c in wanted]
        found = forward.mapInArrow(_answers(share((plan, len(words), n_docs, total)), k),
                                   "item long, doc_id long, score long")
        best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        parts.append(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
                     .join(named, "item").select("item_id", "rank", "doc_id", "score"))
    if not parts:
        return spark.createDataFrame([], f"item_id {kind.simpleString()}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionAll, parts)


def oracle_sql() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    found = (f"regexp_extract_all(translate(text, '{upper}', '{upper.lower()}'), "
             r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')")
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {found} AS t FROM documents WHERE text IS NOT NULL),
w AS (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d),
p AS (SELECT r, doc_id, n, term, count(*) AS tf FROM w GROUP BY ALL),
s AS (SELECT count(*) AS nd, sum(len(t))::BIGINT AS l FROM d WHERE len(t) > 0),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
i AS (SELECT row_number() OVER () AS q, item_id, {found} AS t FROM benchmark),
iw AS (SELECT q, item_id, unnest(t) AS term FROM i),
x AS (
  SELECT q, item_id, r, doc_id, sum(floor(1000 * ln((2 * nd + 2) / (2 * df + 1)))::BIGINT
         * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // l))))::BIGINT AS score
  FROM iw JOIN p USING (term) JOIN f USING (term), s GROUP BY q, item_id, r, doc_id)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0)
WHERE rank <= 10"""
