"""Quality rules, source mix, sharding, license scans: DataFrame code only."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction
from math import ceil, comb

import pytest
import xxhash
from pyspark.sql import functions as F

from rivalry.llm import common, licenses, mixing, quality_rules, sharding

from . import data

SPACE = re.compile("[ \t\n\v\f\r]+")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return data.write(spark, str(tmp_path_factory.mktemp("docs")))


def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def base(text):
    w = [x for x in SPACE.split(text or "") if x]
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\v\f\r")]
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


def test_quality_measures(spark, folder):
    cols = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    got = sorted(((r.doc_id, *(r[c] for c in cols)) for r in quality_rules.judge(docs(spark, folder)).collect()), key=repr)
    assert got == sorted(((r[0], *base(r[1])) for r in data.rows()), key=repr)


def test_quality_rules_against_sql(spark, folder):
    judged = quality_rules.judge(docs(spark, folder))
    data.same(judged, data.duck(folder, quality_rules.oracle_sql()))
    kept = {r.doc_id: r.kept for r in judged.collect()}
    assert not any(kept[i] for i in (200, 201, 202, 203, 300, 301, 302)) and kept[100]


def test_quality_keep_leaves_columns_alone(spark, folder):
    d = docs(spark, folder)
    k = quality_rules.keep(d)
    assert k.schema == d.schema and 0 < k.count() < d.count()
    assert k.where("_h <> 'x' OR kept <> 'x' OR n_words <> 'x'").count() == 0
    assert quality_rules.keep(data.table(spark, [])).count() == 0


def mixed(d):
    return mixing.mix(d, block_words=300, shard_words=2500)


def test_mix_against_sql(spark, folder):
    m = mixed(docs(spark, folder))
    got = m.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
                   F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_draws")).alias("taken"))
    data.same(got, data.duck(folder, mixing.oracle_sql()))
    by = {}
    for r in got.join(docs(spark, folder).select("doc_id", "source").distinct(), "doc_id").collect():
        assert r.taken <= 3 * r["size"]
        by.setdefault(r.source, [r.target, 0, 0])
        by[r.source][1] += r.taken
        by[r.source][2] = max(by[r.source][2], 4 * r["size"])
    # repeated rows are taken alike, so a source misses its target by their sizes at most
    assert all(abs(t - n) <= most for t, n, most in by.values())


def test_mix_shards(spark, folder):
    m = mixed(docs(spark, folder))
    out = mixing.shuffled(m)
    assert [c for c in out.columns if c != "mix_shard"] == docs(spark, folder).columns
    assert out.count() == m.agg(F.sum(F.size("mix_draws"))).first()[0]
    again = mixing.shuffled(mixed(docs(spark, folder).repartition(5)))
    key = lambda d: sorted((repr(r.doc_id), r.mix_shard) for r in d.collect())
    assert key(out) == key(again)


def plain_tree(quota, shards, seed):
    """The splitting tree in whole numbers and fractions: shard -> quotas."""
    out = {}

    def uniform(*parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode() if isinstance(p, str) else p.to_bytes(4, "little"), seed=h)
        return (Fraction(h % (1 << 52)) + Fraction(1, 2)) / (1 << 52)

    def draw(u, n_pop, good, n):
        if not n or not good:
            return 0
        low, high = max(0, n + good - n_pop), min(n, good)
        mode = min(high, max(low, (n + 1) * (good + 1) // (n_pop + 2)))
        goal = u * comb(n_pop, n)
        for k in [*range(mode, high + 1), *range(mode - 1, low - 1, -1)]:
            goal -= comb(good, k) * comb(n_pop - good, n - k)
            if goal <= 0:
                return k

    def split(lo, hi, q):
        if hi - lo == 1:
            out[lo] = q
            return
        mid, n, left = (lo + hi) // 2, sum(q), []
        half = n * (mid - lo) // (hi - lo)
        for i, x in enumerate(q):
            left.append(draw(uniform(seed, lo, hi, i), n, x, half))
            n, half = n - x, half - left[-1]
        split(lo, mid, left)
        split(mid, hi, [a - b for a, b in zip(q, left)])

    split(0, shards, quota)
    return out


def plain_mix(rows, seed=mixing.SEED):
    """(doc_id, size, source) -> [(epoch, shard)] by row, all settings those
    of a small table: 16 shards of 64 blocks."""
    hashed = [(int(hashlib.md5(f"{seed}|{'-' if i is None else i}|{n}".encode()).hexdigest()[:15], 16), n, s)
              for i, n, s in rows]
    size = Counter()
    for _, n, s in hashed:
        size[s] += n
    sources = sorted(size, key=lambda s: (s is None, s or ""))
    total, held, level = sum(size.values()), set(), 0
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(sources)}
    while True:
        free = [s for s in sources if s not in held]
        level = Fraction(total - sum(3 * size[s] for s in held), sum(weight[s] for s in free) or 1)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        held |= over
    block_words = ceil(total / (16 * 64))
    quota, take = [], {}
    for s in sources:
        target = 3 * size[s] if s in held else weight[s] * level
        blocks = max(1, ceil(Fraction(size[s], block_words)))
        passes, rest = divmod(target, size[s]) if size[s] else (0, 0)
        block = lambda h: (h >> 28) * blocks >> 32
        before, last = 0, None
        sizes = Counter()
        for h, n, x in hashed:
            sizes[h] += n if x == s else 0
        for h in sorted({h for h, n, x in hashed if x == s}):
            if before + Fraction(sizes[h], 2) < rest:
                last = h
            before += sizes[h]
        filled = Counter()
        for h, n, x in hashed:
            if x == s:
                filled[block(h)] += n
        start, cut = 0, None
        for b in sorted(filled):
            if start < rest <= start + filled[b]:
                cut = b
            start += filled[b]
        inside = cut is not None and last is not None and block(last) == cut
        quota.append(int(passes) * blocks + (0 if cut is None else cut + inside))
        take[s] = (block, blocks, passes, rest, last)
    shards = plain_tree(quota, 16, seed)
    owner = [[k for k in range(16) for _ in range(shards[k][i])] for i in range(len(sources))]
    out = []
    for h, n, s in hashed:
        block, blocks, passes, rest, last = take[s]
        own = owner[sources.index(s)]
        epochs = range(int(passes) + (rest > 0 and last is not None and h <= last))
        out.append([(e, own[e * blocks + block(h)]) for e in epochs])
    return out, shards


def test_mix_draws_against_a_plain_tree(spark, folder):
    """Production parameters: every epoch and shard of every document."""
    rows = [(r[0], len([w for w in SPACE.split(r[1] or "") if w]), r[3]) for r in data.rows()]
    plain, shards = plain_mix(rows)
    used = {shard for draws in plain for _, shard in draws}
    assert len(used) > 8 and max(map(sum, shards.values())) - min(map(sum, shards.values())) <= 5
    got = sorted(((r.doc_id, r.mix_size, r.source, [tuple(x) for x in r.mix_draws])
                  for r in mixing.mix(docs(spark, folder)).collect()), key=repr)
    assert got == sorted(((*r, d) for r, d in zip(rows, plain)), key=repr)


def test_a_shard_is_a_partition(spark, folder):
    out = mixing.mixed_corpus(docs(spark, folder))
    place = out.select("mix_shard", F.spark_partition_id().alias("p")).distinct().collect()
    assert out.rdd.getNumPartitions() == 16 and all(r.mix_shard == r.p for r in place)


def test_mix_of_nothing(spark):
    assert mixing.mix(data.table(spark, [])).count() == 0
    nothing = mixing.mix(data.table(spark, [r for r in data.rows() if r[0] in (200, 201)])).collect()
    assert [(r.mix_size, r.mix_target, r.mix_draws) for r in nothing] == [(0, 0.0, [])] * 2


def test_splitting_tree_is_exact(spark):
    q = {0: 17, 1: 0, 2: 400, 3: 5}
    rows = mixing.shard_quotas(spark.createDataFrame(list(q.items()), "rank int, quota long"), 7).collect()
    by_rank, by_shard = Counter(), Counter()
    for r in rows:
        assert r.quota >= 0
        by_rank[r["rank"]] += r.quota
        by_shard[r["shard"]] += r.quota
    assert dict(by_rank) | {1: 0} == q and max(by_shard.values()) - min(by_shard.values()) <= 3 and len(by_shard) == 7


def test_hypergeometric_draws(spark):
    """Against the distribution function in whole numbers."""
    n_pop, good, n = 30, 11, 9
    u = [(i + 0.5) / 400 for i in range(400)]
    d = spark.createDataFrame([(x,) for x in u], "u double").select(
        mixing.hypergeometric(F.col("u"), F.lit(n_pop), F.lit(good), F.lit(n)).alias("k"))
    got = Counter(r.k for r in d.collect())
    for k in range(n + 1):
        assert abs(got[k] / 400 - comb(good, k) * comb(n_pop - good, n - k) / comb(n_pop, n)) < 0.01


def test_shards(spark, folder):
    d = docs(spark, folder)
    rows = sharding.shards(d, n_shards=7, bucket_bytes=9000).collect()
    assert len(rows) == d.count()
    slots = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 7
    assert rows[0]["_h"] == "x" and set(rows[0].asDict()) == set(d.columns)
    place = lambda rs: sorted((repr(r.doc_id), r["shard"], r["slot"]) for r in rs)
    assert place(rows) == place(sharding.shards(docs(spark, folder), n_shards=7, bucket_bytes=9000).collect())


def test_shards_spread_equal_rows(spark, tmp_path):
    """A third of the rows are alike: every bucket has about its share."""
    texts = [(7, "the same text " * 10)] * 300 + [(i, f"other {i} " * 10) for i in range(600)]
    folder = data.write(spark, str(tmp_path), [(i, x, "en", "s", 0, *["y"] * len(data.CLASH)) for i, x in texts])
    placed = sharding.shards(docs(spark, folder).select("doc_id", "text"), n_shards=4, bucket_bytes=2_000)
    sizes = placed.rdd.glom().map(len).collect()
    assert len(sizes) > 50 and max(sizes) < 0.15 * len(texts)
    out = str(tmp_path / "out")
    sharding.write_shards(placed, out)
    back = sharding.read_shards(spark, out, placed.schema)
    rows = back.collect()
    assert Counter((r.doc_id, r.text) for r in rows) == Counter(texts)
    assert sorted((r["shard"], r["slot"]) for r in rows) == [(s, k) for s in range(4) for k in range(225)]
    assert len({tuple(r) for r in rows}) == len(texts)
    # the alike are spread over all shards
    assert min(Counter(r["shard"] for r in rows if r.doc_id == 7).values()) > 40


def test_buckets_are_fisher_yates_permutations(spark, folder):
    """The slots of a bucket's rows are a permutation of a stretch of places,
    that of Spark's seeded shuffle for its size."""
    d = docs(spark, folder).select("doc_id", "text")
    h = d.select(F.xxhash64(F.lit(sharding.SEED), "doc_id", "text", F.monotonically_increasing_id()).alias("h"), "doc_id", "text")
    size = sum(len((r.text or "").encode()) + 16 for r in d.collect())
    n = -(-size // 9000)
    rows = sorted((r.h % n, r.h, repr(r.doc_id), r.text) for r in h.collect())
    got = sorted(sharding.shards(d, n_shards=1, bucket_bytes=9000).collect(), key=lambda r: r["slot"])
    at = 0
    for b in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == b]
        mine = got[at:at + len(own)]
        assert Counter((repr(r.doc_id), r.text) for r in mine) == Counter((r[2], r[3]) for r in own)
        assert len(own) < 8 or [(repr(r.doc_id), r.text) for r in mine] != [(r[2], r[3]) for r in own]
        at += len(own)
    assert at == len(rows) == len(got)


def test_shard_sizes_and_few_rows(spark, folder, tmp_path):
    r = {x.doc_id: x for x in docs(spark, folder).select(
        "doc_id", sharding.row_size().alias("n"), sharding.text_crc32().alias("crc")).collect()}
    assert (r[200].n, r[200].crc) == (16, 0)
    text = next(x[1] for x in data.rows() if x[0] == 303).encode()
    assert (r[303].n, r[303].crc) == (len(text) + 16, zlib.crc32(text))
    few = sharding.shards(data.table(spark, data.rows()[:3]), n_shards=40)
    assert sorted(x["slot"] for x in few.collect()) == [0, 0, 0]
    assert sharding.shards(data.table(spark, [])).count() == 0
    sharding.write_shards(few, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    none = sharding.shards(data.table(spark, []))
    sharding.write_shards(none, str(tmp_path / "none"))
    assert sharding.read_shards(spark, str(tmp_path / "none"), none.schema).count() == 0


def test_license_scan(spark, tmp_path):
    t = dict(licenses.TEMPLATES)
    mit = t["MIT-notice"]
    texts = [(1, "Intro words here. " + mit + " More words."), (2, mit.upper().replace(",", "")),
             (3, mit.replace("without restriction", "with no limits")), (4, " ".join(mit.split()[:30])),
             (5, "we say Released under the MIT License. ok"), (6, "released under the BSD license"),
             (7, None), (8, ""), (None, t["GPL-3.0"]), (9, t["Apache-2.0-notice"]), (9, t["CC-BY-NC-4.0"]),
             (10, "pad " * 5000 + t["BSD-notice"] + " pad" * 5000)]
    texts += [texts[4]]
    folder = data.write(spark, str(tmp_path), [(i, x, "en", "s", 0, *["y"] * len(data.CLASH)) for i, x in texts])
    found = licenses.scan(docs(spark, folder))
    data.same(found, data.duck(folder, licenses.oracle_sql()))
    got = {(r.doc_id, r.license) for r in found.collect()}
    assert {(1, "MIT-notice"), (2, "MIT-notice"), (3, "MIT-notice"), (5, "MIT"), (None, "GPL-3.0"), (9, "Apache-2.0-notice"),
            (9, "CC-BY-NC-4.0"), (10, "BSD-notice")} <= got
    assert not {i for i, _ in got} & {4, 6, 7, 8}
    assert licenses.scan(data.table(spark, [])).count() == 0


def test_short_templates_and_versions(spark):
    t = dict(licenses.TEMPLATES)
    gpl = "This work is licensed under the GNU General Public License, version 2."
    lines = {1: "x\nAll rights reserved.", 2: "all, RIGHTS reserved", 3: "all rights are reserved", 4: gpl, 5: t["GPL-3.0"],
             6: "Licensed under CC BY-SA 4.0.", 7: t["GPL-3.0-notice"], 8: t["GPL-3.0-notice"].replace("version 3", "version 2"),
             9: t["GPL-3.0-notice"].replace("General Public", "Affero General Public"), 10: None, 11: t["CC-BY-NC-4.0"]}
    d = spark.createDataFrame([*lines.items(), (1, lines[1])], "doc_id int, text string")
    got = sorted((r.doc_id, r.license, r.n_shared == r.n_shingles) for r in licenses.scan(d, licenses.NOTICES).collect())
    assert got == [(1, "Proprietary", True), (2, "Proprietary", True), (4, "GPL-2.0", True), (5, "GPL-3.0", True),
                   (6, "CC-BY-SA-4.0", True), (7, "GPL-3.0-notice", True), (8, "GPL-2.0-notice", True),
                   (9, "AGPL-3.0-notice", True), (11, "CC-BY-NC-4.0", True)]
    with pytest.raises(ValueError):
        licenses.scan(d, [("none", "...")])


def test_notices_against_sql(spark, tmp_path):
    """The registered list: every notice whole, cut, altered; short ones; versions."""
    texts = [(100 * i + j, x) for i, n in enumerate(licenses.NOTICES) for j, x in enumerate(
        ("before " + n[1] + " behind", " ".join(n[1].split()[:-3]), n[1].replace("version", "release").upper(), n[1].replace(" ", "\n")))]
    texts += [(None, "All rights reserved."), (1, "all rights"), (2, "rights reserved all"), (3, None), (4, "")]
    folder = data.write(spark, str(tmp_path), [(i, x, "en", "s", 0, *["y"] * len(data.CLASH)) for i, x in texts])
    found = licenses.scan(docs(spark, folder), licenses.NOTICES)
    data.same(found, data.duck(folder, licenses.oracle_sql(licenses.NOTICES)))
    whole = {(r.doc_id // 100, r.license) for r in found.where("doc_id % 100 = 0").collect()}
    assert {(i, n[0]) for i, n in enumerate(licenses.NOTICES)} <= whole


def test_bands_meet_as_often_as_said(spark):
    """Windows of similarity s agree in no band with probability (1 - s)^8."""
    import random as rd
    rnd, pairs = rd.Random(4), []
    for i in range(6000):
        both = [rnd.getrandbits(62) for _ in range(10)]
        a, b = ([*both, *(rnd.getrandbits(62) for _ in range(6))] for _ in range(2))
        pairs.append((i, a, b))
    s = 10 / 22
    d = spark.createDataFrame(pairs, "i int, a array<long>, b array<long>")

    def minima(c):
        h = licenses._with_bands(d.select("i", F.col(c).alias("hashes")), ["i"])
        return h.select("i", *[F.array_min(f"_h{k}").alias(f"{c}{k}") for k in range(licenses.BANDS)])
    j = minima("a").join(minima("b"), "i").collect()
    bands = range(licenses.BANDS)
    each = [sum(r[f"a{k}"] == r[f"b{k}"] for r in j) / len(j) for k in bands]
    assert all(abs(e - s) < 0.03 for e in each)
    missed = sum(all(r[f"a{k}"] != r[f"b{k}"] for k in bands) for r in j) / len(j)
    assert abs(missed - (1 - s) ** licenses.BANDS) < 0.004


def test_window_signatures_retrieve_by_minhash(spark):
    """The long class alone: a passage at any start is retrieved."""
    t = licenses.template_table(spark, [("L", dict(licenses.TEMPLATES)["BSD-notice"])])
    index = licenses._template_signatures(t)
    d = spark.createDataFrame([(i, "w " * i + dict(licenses.TEMPLATES)["BSD-notice"]) for i in range(9)], "id int, text string")
    h = common.computed(common.computed(d, ["id"], w=licenses._tokens(F.col("text"))), ["id"], hashes=licenses.hashes(F.col("w")))
    hits = licenses._text_signatures(h, ["id"]).join(index, ["band", "value"]).select("id").distinct()
    assert hits.count() == 9


def test_prefix_sums_and_slices(spark):
    d = spark.createDataFrame([(i % 3, i, i * 2) for i in range(50)], "g int, i long, v long")
    r = common.prefix_sums(d, ["g"], "i", "v", "before", "all", span=8).collect()
    for x in r:
        mine = [2 * i for i in range(50) if i % 3 == x.g]
        assert x.before == sum(v for v in mine if v < x.v) and x["all"] == sum(mine)
    b = [3, 10, 11, 40]
    s = d.select("i", common.slice_of(F.col("i"), b).alias("s")).collect()
    assert all(x.s == sum(x.i >= y for y in b) for x in s)


def test_brief_templates_take_no_pass_of_their_own(spark, tmp_path, monkeypatch):
    """A template shorter than a shingle is retrieved with the others (the words
    of all documents were cut once more for it)."""
    calls, plain = [], licenses._tokens
    monkeypatch.setattr(licenses, "_tokens", lambda text: calls.append(1) or plain(text))
    templates = (("one", "Unlicense"), ("three", "All rights reserved."), ("long", "Permission to use this is hereby given to all"))
    rows = [(1, "the unlicense, ALL rights reserved! unlicense"), (2, "all rights are reserved"), (3, None), (4, "unlicense"),
            (5, "Permission to use this is hereby given to all; all rights reserved")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, licenses.scan(d, templates).collect()))
    assert got == [(1, "one", 1, 1), (1, "three", 1, 1), (4, "one", 1, 1), (5, "long", 5, 5), (5, "three", 1, 1)]
    assert len(calls) == 4           # templates, their passages, all documents, those retrieved
