"""Mixing, sharding, line dedup, SimHash, BPE and personal data against plain Python."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm import cases
from tidewatch.llm import bpe, line_dedup, mixing, pii, sharding, simhash
from tidewatch.llm.queries import vocabulary_path
from tidewatch.llm.rows import possibly_in, spread_repeats, sum_vectors

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# Mixing

def plain_targets(sizes, weights, share, most):
    """Fill sources until none is above its limit, by repeated resharing."""
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), share * sum(sizes.values())
    while True:
        left = total - sum(most * sizes[s] for s in full)
        rest = sum(w[s] for s in names if s not in full)
        goal = {s: most * sizes[s] if s in full else left * w[s] / rest for s in names}
        over = {s for s in names if s not in full and goal[s] > most * sizes[s]}
        if not over:
            return goal
        full |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 100, "c": 5, None: 40}, {"a": 7}, {"a": 0, "b": 3}, {"x": 5, "Y": 5, "ä": 5, "z": 900}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes, (5, 2, 1), 1.5, 2.0))


def test_settle_keeps_mass_and_expectation():
    rng = np.random.default_rng(1)
    p, mass = rng.random(12), rng.integers(1, 50, 12).astype(float)
    total = np.zeros(12)
    for _ in range(4000):
        out, at = mixing.settle(p, np.sort(mass)[::-1], rng.random(12))
        assert sum(0 < x < 1 for x in out) <= 1 and (at < 0 or 0 < out[at] < 1)
        assert out @ np.sort(mass)[::-1] == pytest.approx(p @ np.sort(mass)[::-1])
        total += out
    assert np.abs(total / 4000 - p).max() < 0.05


def test_mixing_reaches_targets_whatever_the_partitions(spark, documents):
    rows = documents.select("doc_id", "source", mixing.word_count().alias("size"))
    out = mixing.plan(rows).collect()
    again = mixing.plan(rows.repartition(5)).collect()
    assert Counter(out) == Counter(again)
    by = defaultdict(list)
    for r in out:
        by[r.source].append(r)
        assert 0 <= r.taken <= 2 * r["size"]
    for rs in by.values():
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r["size"] for r in rs)


def test_settle_misses_by_the_smallest_where_mass_allows():
    """One text of 5,000 words among small ones is settled by the many, whichever way it goes."""
    rng = np.random.default_rng(2)
    mass = np.array([5000.0, 900.0, 400.0, *sorted(rng.integers(5, 120, 300), reverse=True)])
    last, taken = Counter(), 0
    for _ in range(500):
        out, at = mixing.settle(np.full(len(mass), 0.4), mass, rng.random(len(mass)))
        last[at] += 1
        taken += out[0]
    assert min(at for at in last if at >= 0) > 200 and abs(taken / 500 - 0.4) < 0.07


def test_mixing_misses_no_target_by_much(spark):
    """About 50 documents a source, the largest a third of the source's words."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "source", mixing.word_count().alias("size"))
    by = defaultdict(list)
    for r in mixing.plan(rows).collect():
        by[r.source].append(r)
    for rs in by.values():
        miss = abs(sum(r.taken for r in rs) - rs[0].target)
        assert miss <= 0.01 * rs[0].target


def test_repeats_with_one_key_are_spread(spark):
    df = spark.range(1000).selectExpr("IF(id < 700, 5, id) k", "id % 3 v")
    out = spread_repeats(df, "k", 100).collect()
    again = spread_repeats(df.repartition(7), "k", 100).collect()
    assert len({r.k for r in out}) == 1000 and {r.k for r in out} == {r.k for r in again}
    assert Counter(r.v for r in out) == Counter(r.v for r in df.collect())
    assert sorted(spread_repeats(df, "k", 700).collect()) == sorted(df.collect())


def test_mixing_levels(spark):
    rows = spark.range(3000).selectExpr("id doc_id", "IF(id % 3 = 0, 'b', 'a') source", "1 + id % 90 size")
    by = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("__tw_count"))
    joined = rows.join(by, "source").withColumn("target", F.col("source_size") * 0.7)
    out = mixing.with_copies(joined, fan=8).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("t"), F.max("target").alias("g"), F.count("*").alias("n")).collect()
    assert {r.source: r.n for r in out} == {"a": 2000, "b": 1000}
    assert all(abs(r.t - r.g) <= 90 for r in out)


def test_mixing_awkward(spark):
    docs = cases.awkward(spark)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    assert mixing.mix(cases.none(spark)).count() == 0


# Sharding

def test_shards(spark, documents):
    rows = sharding.sharded(documents, shards=7, bucket_bytes=50_000).select("doc_id", "shard", "slot").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in documents.select("doc_id").collect())
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert set(by) == set(range(7)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = sharding.sharded(documents.repartition(3), shards=7, bucket_bytes=50_000).select("doc_id", "shard", "slot").collect()
    assert sorted(rows) == sorted(again)
    other = sharding.sharded(documents, shards=7, seed=8, bucket_bytes=50_000).select("doc_id", "shard", "slot").collect()
    assert sorted(rows) != sorted(other)


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(sharding.fisher_yates(3, 1, b)) for b in range(6000))
    assert len(seen) == 6 and max(seen.values()) < 1200 and min(seen.values()) > 800


def test_written_shards_keep_texts(spark):
    docs = cases.awkward(spark)
    back = spark.read.parquet(sharding.write_shards(docs, shards=3))
    assert Counter(r.text for r in back.collect()) == Counter(r.text for r in docs.collect())
    assert set(back.columns) == {*docs.columns, "slot"}
    assert sharding.sharded(cases.none(spark)).count() == 0


def test_files_of_shards_are_in_shuffled_order(spark, documents):
    path = sharding.write_shards(documents, shards=5, bucket_bytes=40_000)
    rows = spark.read.parquet(path).select("shard", "slot", F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("n")).collect()
    files = defaultdict(list)
    for r in sorted(rows, key=lambda r: r.n):
        files[r.shard, r.f].append(r.slot)
    assert len(rows) == documents.count() and all(s == sorted(s) for s in files.values())
    # The order of slots is a shuffled one, not that of the ids.
    ids = [r.doc_id for r in spark.read.parquet(path).filter("shard = 0").orderBy("slot").collect()]
    assert ids != sorted(ids)


def test_shards_with_fewer_rows_than_shards_and_repeats(spark, monkeypatch):
    few = spark.range(3).selectExpr("id doc_id", "'x' text")
    assert sorted((r.shard, r.slot) for r in sharding.sharded(few, shards=7).collect()) == [(0, 0), (1, 0), (2, 0)]
    monkeypatch.setattr(sharding, "REPEATS", 50)
    same = spark.range(900).selectExpr("CAST(NULL AS LONG) doc_id", "'one text' text")
    # Small shuffled partitions would be read by one task, whatever their keys.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = sharding.shuffled(same, bucket_bytes=2400).select("__tw_place", F.spark_partition_id().alias("p")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(r["__tw_place"] for r in placed) == list(range(900)) and len({r.p for r in placed}) > 1


# Line dedup

def plain_dedup(docs):
    """docs: sorted distinct (doc_id, text); later occurrences of three lines are cut."""
    seen, gone = set(), defaultdict(set)
    for i, text in docs:
        lines = (text or "").split("\n")
        for at in range(len(lines) - 2):
            window = tuple(lines[at : at + 3])
            if window in seen:
                gone[i].update((at, at + 1, at + 2))
            seen.add(window)
    return {i: (t if not gone[i] else "\n".join(x for k, x in enumerate((t or "").split("\n")) if k not in gone[i]), len(gone[i])) for i, t in docs}


def test_line_dedup_random(spark):
    rng = random.Random(4)
    docs = [(i, "\n".join(rng.choice("abc") for _ in range(rng.randint(0, 12)))) for i in range(60)]
    got = line_dedup.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.text, r.n_removed) for r in got} == plain_dedup(docs)


def test_line_dedup_awkward(spark):
    docs = cases.awkward(spark)
    out = line_dedup.without_repeats(docs)
    got = out.collect()
    assert len(got) == docs.count() and set(out.columns) == {*docs.columns, "n_lines", "n_removed"}
    texts = {r.doc_id: r.text for r in got if r.doc_id is not None}
    assert texts[0] is None and texts[10] == "a\nb\nc\nd" and texts[11] == "x" and texts[12] == "" and texts[15] == ""
    assert texts[7] == cases.LONG
    assert line_dedup.without_repeats(cases.none(spark)).count() == 0
    many = "\n".join(f"line {i}" for i in range(20000))
    long = line_dedup.without_repeats(spark.createDataFrame([(1, many), (2, "new\n" + many)], "doc_id long, text string"))
    assert {r.doc_id: (len(r.text), r.n_removed) for r in long.collect()} == {1: (len(many), 0), 2: (3, 20000)}


# SimHash

def plain_fingerprint(text, n):
    tokens = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(tokens[i : i + n]) for i in range(len(tokens) - n + 1)] or ([" ".join(tokens)] if tokens else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(prints, radius=3):
    name = {f: f for f in prints}

    def root(f):
        while name[f] != f:
            f = name[f]
        return f

    for f in prints:
        for g in prints:
            if (f ^ g).bit_count() <= radius:
                name[root(f)] = root(g)
    return {f: root(f) for f in prints}


def test_simhash_documents(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    prints = {i: plain_fingerprint(t, 3) for i, t in texts.items()}
    roots = plain_components(set(prints.values()))
    first = {}
    for i, f in sorted(prints.items()):
        first.setdefault(roots[f], i)
    got = {r.doc_id: (r["__tw_fp"] % 2**64, r.component_id) for r in simhash.near_copies(documents).collect()}
    assert got == {i: (f, first[roots[f]]) for i, f in prints.items()}


def test_simhash_search_finds_all_links(spark):
    rng = random.Random(9)
    prints = set()
    for _ in range(40):
        base = rng.getrandbits(64)
        prints |= {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(30)} | {base}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in prints]
    nodes = spark.createDataFrame(signed, "node long")
    edges = simhash.linked_fingerprints(nodes)
    assert all(((e.a ^ e.b) % 2**64).bit_count() <= 3 for e in edges.collect())
    from tidewatch.llm.links import components

    got = {r.node % 2**64: r.root for r in components(edges).collect()}
    roots = plain_components(prints)
    groups = lambda m: sorted(sorted(k for k in m if m[k] == v) for v in set(m.values()))
    assert groups(got) == [g for g in groups(roots) if len(g) > 1]


def test_keys_of_fingerprints_are_not_broadcast(spark, tmp_path):
    nodes = [((k * 0x9E3779B97F4A7C15) % 2**64 - 2**63,) for k in range(2000)]
    spark.createDataFrame(nodes, "node long").write.parquet(path := str(tmp_path / "nodes"))
    edges = simhash.linked_fingerprints(spark.read.parquet(path))
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString()
    assert edges.count() == 0


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, i) for i in range(1001, 1300)]
    from tidewatch.llm.links import components

    got = {r.node: r.root for r in components(spark.createDataFrame(path + star + [(5, 5)], "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{i: 1000 for i in range(1000, 1300)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_hot_bucket_spreads(spark, monkeypatch):
    from tidewatch.llm import links

    prints = [(1 << b | 1 << c,) for b in range(30) for c in range(b)]
    nodes = spark.createDataFrame(prints, "node long")
    units = links.block_pairs(nodes.withColumn("key", F.lit(1)), ["key"], "node", block_rows=50)
    sizes = units.groupBy("__tw_i", "__tw_j").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 250
    edges = links.per_unit(units, ["key"], lambda g: simhash._close(g, 2), "a long, b long")
    assert links.components(edges).select("root").distinct().count() == 1


def test_keep_one_awkward(spark):
    docs = cases.awkward(spark)
    kept = simhash.keep_one(docs)
    got = kept.collect()
    assert kept.columns == docs.columns
    assert sum(r.text == cases.LONG for r in got) == 1 and sum((r.text or "").lower().startswith("the cat") for r in got) == 1
    assert sum(not words(r.text) for r in got) == 1
    assert simhash.keep_one(cases.none(spark)).count() == 0


def test_possibly_in_misses_no_member(spark):
    rng = random.Random(8)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(4000)] + [0, -1, 2**63 - 1, -(2**63), 2**27 - 1, 2**27]
    df = spark.createDataFrame([(k,) for k in keys], "h long")
    members = df.filter("h % 2 = 0").union(df.filter("h = 0"))
    got = {r.h: r.maybe for r in possibly_in(df, F.col("h"), members, "maybe").collect()}
    assert len(got) == len(set(keys)) and all(got[k] for k in keys if k % 2 == 0)
    assert sum(got[k] for k in keys if k % 2) <= 2
    assert possibly_in(df, F.col("h"), members.limit(0), "maybe").filter("maybe").count() == 0


def test_long_vectors_reach_the_driver_without_an_object_for_each_number(spark):
    length = 1 << 17
    vector = np.arange(length) / 8
    rows = spark.range(0, 40, 1, 4)
    tracemalloc.start()
    total = sum_vectors(rows, lambda batches: vector * sum(b.num_rows for b in batches), length)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (total == vector * 40).all()
    assert peak < 16 * 2**20


# BPE

def test_bpe_round_trip(spark):
    from tokenizers import Tokenizer

    path = vocabulary_path()
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    alphabet = "aaab  'İΣσΑß\n\tÉé\x1c\x1f　日本語😀1２½'s're_%&#|-​힣가\x85ǅﬁ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    texts += ["a" * 4000, "x<|endoftext|>y", "<|endoftext|", "DON'T we'll", "", cases.LONG]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in bpe.decode(bpe.encode(docs, path), path).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text, add_special_tokens=False).ids
        assert got[i].ids == want, repr(text)
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)


def test_bpe_awkward(spark):
    docs = cases.awkward(spark)
    out = bpe.encode(docs, vocabulary_path())
    assert set(out.columns) == set(docs.columns) and out.count() == docs.count()
    assert all(r.ids == [] for r in out.filter("text IS NULL OR trim(text) = ''").collect())
    assert bpe.encode(cases.none(spark), vocabulary_path()).count() == 0
    null = spark.createDataFrame([(None,)], "ids array<int>")
    assert bpe.decode(null, vocabulary_path()).first().decoded == ""


# Personal data

PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain_spans(text):
    out = []
    for n, (kind, pattern) in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            luhn = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else False,
                    "card": 14 <= len(digits) <= 19 and luhn, "phone": 10 <= len(digits) <= 15}[kind]:
                out.append((m.start(), n, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(out))


def test_base_spans_random():
    rng = random.Random(8)
    for _ in range(20000):
        text = "".join(rng.choice("aB.@-+ 0123456789.@+%_é()") for _ in range(rng.randint(0, 60)))
        assert pii.shown(pii.base_spans(text)) == plain_spans(text), repr(text)
    for card in ("4111 1111-1111 1111", "4111111111111111", "1.2.3.4.5.6.7.8", "256.1.1.1", "a@b@c.d.e@f.g", "+1 (555) 123-4567 8"):
        assert pii.shown(pii.base_spans(card)) == plain_spans(card)


def test_terms_that_reveal_an_entity(spark):
    filler = "the of and to in is that for on with as by at from".split()
    rng = random.Random(2)
    docs = []
    for i in range(200):
        text = " ".join(rng.choice(filler) for _ in range(30))
        if i < 6:
            text += f" {rng.choice(filler)} Zephyrine {rng.choice(filler)} ann@home.org {rng.choice(filler)} {i}x"
        if 6 <= i < 9:  # copies of one surrounding
            text = "same Quixotic mail tom@home.org same words"
        docs.append((i, text))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    found = {r.doc_id: r for r in pii.found_spans(df).collect()}
    for i in range(6):
        at = docs[i][1].index("Zephyrine")
        assert f"term:{at}:{at + 9}" in found[i].spans and found[i].base == plain_spans(docs[i][1])
        assert sum(s.startswith("term") for s in found[i].spans.split(",")) == 1
    assert all("term" not in found[i].spans for i in range(6, 200))
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "Zephyrine" not in clean[0] and "[EMAIL]" in clean[0] and clean[50] == docs[50][1]


def test_pii_awkward(spark):
    docs = cases.awkward(spark)
    assert pii.found_spans(docs).count() == docs.count()
    clean = pii.sanitised(docs)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    assert "mail [EMAIL] now" in [r.text for r in clean.collect()]
    assert pii.found_spans(cases.none(spark)).count() == 0
    hot = spark.createDataFrame([(i, f"note {i} a@b.cd end") for i in range(300)], "doc_id long, text string")
    assert pii.found_spans(hot).filter("base = '' ").count() == 0


def test_text_digests_match_contract(spark):
    from tidewatch.llm import queries

    row = queries.op4_sharding(spark, FOLDER).filter("doc_id = 1").first()
    text = spark.read.parquet(f"{FOLDER}/documents.parquet").filter("doc_id = 1").first().text
    assert row["size"] == len(text.encode()) + 16 and row.text_crc32 == zlib.crc32(text.encode())
    found = queries.op3_pii(spark, FOLDER).filter("n_email > 0").first()
    full = spark.read.parquet(f"{FOLDER}/documents.parquet").filter(F.col("doc_id") == found.doc_id).first().text
    assert found.base_sha256 == hashlib.sha256(plain_spans(full).encode()).hexdigest()


def test_keep_one_by_similarity(spark):
    """Of similar five-word shingle sets one document stays; what is far below the threshold stays."""
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    docs, near, far = [], [], []
    for g in range(60):
        base = [rng.choice(vocabulary) for _ in range(150)]
        docs.append(" ".join(base))
        near.append(len(docs))
        docs.append(" ".join(base[:70] + ["changed"] + base[71:]))  # Jaccard 0.93
        far.append(len(docs))
        docs.append(" ".join("other" if k % 9 == 4 else w for k, w in enumerate(base)))  # Jaccard below 0.3
    near.append(len(docs))
    docs.append(docs[0].upper().replace(" ", "\n"))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    assert not got & set(near) and got >= set(far) and len(got) == 120


def contiguous_pairs(rng, lengths, shares):
    """Texts and copies with one passage rewritten: (text, copy, Jaccard of the sets of five-word shingles)."""
    def shingles(w):
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}

    for n in lengths:
        for share in shares:
            base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            at, size = rng.randrange(n // 4), max(1, round(n * (1 - share) / (1 + share)) - 4)
            copy = base[:at] + [f"v{rng.randrange(10**6)}" for _ in range(size)] + base[at + size :]
            a, b = shingles(base), shingles(copy)
            yield " ".join(base), " ".join(copy), len(a & b) / len(a | b)


def test_candidates_with_rewritten_passages_all_meet():
    rng = random.Random(12)
    counts = np.zeros(simhash.COUNTERS)
    pairs = [p for p in contiguous_pairs(rng, [60, 150, 400], [0.8 + 0.005 * k for k in range(21)] * 10) if p[2] >= 0.8]
    met = [bool(np.intersect1d(*(simhash.sketch(t, 5, Fraction(4, 5), counts)[3] for t in p[:2])).size) for p in pairs]
    assert len(pairs) > 300 and all(met)


def test_keep_one_is_exact_near_the_threshold(spark):
    """Short and long pairs around 0.8: a copy goes if the exact Jaccard of the sets reaches 0.8, and only then."""
    rng = random.Random(21)
    short = [(9, 8), (9, 7), (10, 9), (12, 11), (16, 14)]  # words, and how many of them the copy keeps
    docs, want = [], set()
    for n, kept in [*short * 6, *[(n, round(n * share)) for n in (60, 300) for share in (0.86, 0.88, 0.885, 0.895, 0.9, 0.91) for _ in range(5)]]:
        base = [f"w{rng.randrange(10**6)}" for _ in range(n)]
        copy = base[:kept] + [f"v{rng.randrange(10**6)}" for _ in range(n - kept)]
        a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (base, copy))
        want.add(len(docs))
        docs += [(len(docs), " ".join(base)), (len(docs) + 1, " ".join(copy))]
        if 5 * len(a & b) < 4 * len(a | b):
            want.add(len(docs) - 1)
    assert {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()} == want


def test_repeated_passages_do_not_hide_copies():
    """A copy that repeats a passage more often has the same set of shingles but for the seams."""
    rng = random.Random(13)
    counts = np.zeros(simhash.COUNTERS)
    for _ in range(100):
        base = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        a, b = (simhash.sketch(" ".join(base + base[100:144] * k), 5, Fraction(4, 5), counts) for k in (1, 5))
        assert np.intersect1d(a[3], b[3]).size and np.bitwise_count(a[2] ^ b[2]).sum() <= simhash.bits_apart(Fraction(4, 5))


def test_candidates_do_not_depend_on_the_size_of_the_table():
    """A document has as many keys in any table, and pairs meet whatever the order that a table gives its shingles."""
    rng = random.Random(14)
    for text, copy, similarity in contiguous_pairs(rng, [60, 200], [0.8 + 0.01 * k for k in range(10)]):
        for documents in (1, 1 << 12, 1 << 24):
            counts = np.random.default_rng(documents).poisson(documents, simhash.COUNTERS)
            a, b = (simhash.sketch(t, 5, Fraction(4, 5), counts) for t in (text, copy))
            assert len(a[3]) == a[1] - -(-4 * a[1] // 5) + 1
            assert similarity < 0.8 or np.intersect1d(a[3], b[3]).size


def test_terms_far_from_an_entity_are_marked(spark):
    """Terms anywhere in the document count, and every occurrence in documents with the entity is marked."""
    rng = random.Random(5)
    filler = "the of and to in is that for on with as by at from".split()
    some = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    docs = [(i, some(60)) for i in range(100)]
    docs += [(100 + i, f"Zephyrine {some(30)} ann@home.org {some(30)} zephyrine") for i in range(5)]
    found = {r.doc_id: r for r in pii.found_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, text in docs[100:]:
        assert [x for x in found[i].spans.split(",") if x.startswith("term")] == ["term:0:9", f"term:{len(text) - 9}:{len(text)}"]
    assert all("term" not in found[i].spans for i in range(100))


def test_pipeline_links_documents_by_their_fingerprints(spark):
    """Two texts of one long repeated phrase have near fingerprints, though few of their distinct shingles agree."""
    import corpus_pipeline

    phrase = " ".join(f"p{i}" for i in range(11))
    texts = [f"{phrase} " * 100 + " ".join(f"{own}{i}" for i in range(30)) for own in "uv"] + ["something else altogether here"]
    docs = spark.createDataFrame([(i + 3, t) for i, t in enumerate(texts)] + [(None, texts[0])], "doc_id long, text string")
    prints = [plain_fingerprint(t, 3) for t in texts]
    assert (prints[0] ^ prints[1]).bit_count() <= 3
    assert {r.doc_id for r in simhash.keep_one(docs).collect()} == {3, 4, 5}  # by sets of shingles alone
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()) == [3, 5]


def test_first_of_components_awkward(spark):
    docs = cases.awkward(spark)
    got = simhash.first_of_components(docs)
    near = {(r.doc_id, r["__tw_fp"]): r.component_id for r in simhash.near_copies(docs).collect()}
    want = sum(r.component_id is None or r.doc_id == r.component_id for r in simhash.near_copies(docs).collect())
    kept = got.collect()
    assert got.columns == docs.columns and len(kept) == want < docs.count()
    assert all(r.doc_id in near.values() for r in kept) and {c for c in near.values()} == {r.doc_id for r in kept}
    assert simhash.first_of_components(cases.none(spark)).count() == 0
