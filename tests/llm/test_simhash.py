"""SimHash near-duplicates against all pairs."""

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rivalry.llm import by_value, simhash
from rivalry.llm.components import components

from . import data

by_value()


def slow_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate(
        {ord(c): " " for c in "\t\n\v\f\r"}).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits=4):
    """Least member of every fingerprint's component, by all pairs."""
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f
    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {f: find(f) for f in fps}


def test_fingerprints():
    for r in data.rows()[:60]:
        if r[0] != 304:
            assert simhash.fingerprint(r[1]) == slow_fingerprint(r[1])


def test_near_duplicates_against_all_pairs(spark):
    rows = [r for r in data.rows() if r[0] != 304]
    got = simhash.near_duplicates(data.table(spark, rows))
    fps = {r[1]: slow_fingerprint(r[1]) for r in rows}
    cls = classes(set(fps.values()))
    ids = {}
    for r in rows:
        if r[0] is not None:
            ids[cls[fps[r[1]]]] = min(ids.get(cls[fps[r[1]]], r[0]), r[0])
    expected = sorted((repr(r[0]), f"{fps[r[1]]:016x}", ids.get(cls[fps[r[1]]])) for r in rows)
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in got.collect()) == expected
    assert got.columns[:len(data.SCHEMA)] == data.SCHEMA.names and got.first()["_fp"] == "x"


def test_dedup_keeps_one_of_each_group(spark):
    rows = [r for r in data.rows() if r[0] != 304]
    kept = simhash.dedup(data.table(spark, rows)).collect()
    cls = classes({slow_fingerprint(r[1]) for r in rows})
    assert sorted(cls[slow_fingerprint(r.text)] for r in kept) == sorted(set(cls.values()))
    assert {r.doc_id for r in kept} >= {100} and not {r.doc_id for r in kept} & {101, 102, 103, 104}
    assert simhash.dedup(data.table(spark, [])).count() == 0


def test_links_of_a_hot_group(spark):
    """Chains and a dense ball: the classes of all pairs, few links."""
    rnd = random.Random(1)
    centre = rnd.getrandbits(64)
    ball = {centre} | {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, 3))) for _ in range(250)}
    chain = [rnd.getrandbits(64)]
    for i in range(60):
        chain.append(chain[-1] ^ sum(1 << b for b in rnd.sample(range(64), 4)))
    fps = sorted(ball | set(chain) | {rnd.getrandbits(64) for _ in range(200)})
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    links = simhash.links(spark.createDataFrame([(f,) for f in signed], "_fp long")).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
    roots = {r.node: r.root for r in components(spark.createDataFrame([tuple(r) for r in links], "a long, b long")).collect()}
    cls = classes(fps)
    mine, theirs = {}, {}
    for f, s in zip(fps, signed):
        mine.setdefault(roots.get(s, s), set()).add(f)
        theirs.setdefault(cls[f], set()).add(f)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))
    assert len(links) < 35 * len(fps)


def test_long_postings_are_split(spark):
    """Fingerprints that share three bytes, few of them linked: the same
    classes with every posting split."""
    rnd = random.Random(8)
    fps = sorted({(rnd.getrandbits(40) << 24) | 0xABCDEF for _ in range(150)}
                 | {(0x1234567890 << 24 | 0xABCDEF) ^ sum(1 << b for b in rnd.sample(range(24, 64), 2)) for _ in range(40)})
    d = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "_fp long")
    found = []
    for bound in (10_000, 20, 1):
        links = simhash.links(d, posting=bound).collect()
        assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
        roots = {r.node: r.root for r in components(spark.createDataFrame([tuple(r) for r in links], "a long, b long")).collect()}
        mine = {}
        for f in d.collect():
            mine.setdefault(roots.get(f[0], f[0]), set()).add(int(np.int64(f[0]).astype(np.uint64)))
        found.append(sorted(map(sorted, mine.values())))
    theirs = {}
    for f, c in classes(fps).items():
        theirs.setdefault(c, set()).add(f)
    assert found[0] == found[1] == found[2] == sorted(map(sorted, theirs.values()))


def test_named_columns_only(spark):
    rows = [r for r in data.rows() if r[0] != 304]
    whole = simhash.near_duplicates(data.table(spark, rows))
    slim = simhash.near_duplicates(data.table(spark, rows), keep=["doc_id", "_fp"])
    assert slim.columns == ["doc_id", "_fp", "fingerprint", "component_id", "component_fp"]
    key = lambda d: sorted(map(repr, d.select(*slim.columns).collect()))
    assert key(whole) == key(slim)


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    r = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert r == {i: 0 for i in range(1, 41)} | {100 + i: 100 for i in range(1, 30)}
    assert components(spark.createDataFrame([], "a long, b long")).agg(F.count("*")).first()[0] == 0
