"""Near-duplicates, neighbours, classifiers, sharding, mixing and the pipeline against plain versions."""

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from keyloom.llm import ann, components, mixing, neighbours, quality, sharding, simhash, toxicity


def plain_fingerprint(text, shingle=4):
    words = (text or "").encode().lower().split()
    spans = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in spans]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_components(nodes, linked):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_texts(words):
    random = np.random.default_rng(4)
    texts = []
    for n in (400, 60, 30):
        base = list(random.choice(words, n))
        for _ in range(12):
            own = list(base)
            own[random.integers(n)] = random.choice(words)
            texts.append(" ".join(own))
    return texts + [None, "", "a", "A", "a b c", "x y É", " ".join(random.choice(words, 20_000))] + texts[:3]


def check_classes(spark, texts):
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, fingerprint string").repartition(3)
    got = {r["doc_id"]: r for r in simhash.classes(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    linked = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = plain_components(range(len(texts)), linked)
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{p:016x}" for i, p in enumerate(prints)}
    assert {i: r["component_id"] for i, r in got.items()} == root
    kept = sorted(r["doc_id"] for r in simhash.keep_one(docs.union(docs.limit(3))).collect())
    assert kept == sorted(set(root.values()))
    return len(set(root.values()))


def test_simhash_classes(spark, words):
    assert check_classes(spark, near_texts(words)) < 43
    docs = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")
    assert [r["component_id"] for r in simhash.classes(docs).collect()] == [None, None]
    assert simhash.classes(docs.limit(0)).count() == 0


def test_keep_one_goes_by_class_not_by_id(spark, words):
    random = np.random.default_rng(8)
    texts = [" ".join(random.choice(words, 60)) for _ in range(6)]
    rows = [(None, t, 1) for t in texts] + [(None, texts[0], 2), (7, texts[1], 3), (7, texts[2], 4), (7, texts[2], 4), (3, texts[2], 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([(None, texts[0]), (7, texts[1]), (3, texts[2]), *[(None, t) for t in texts[3:]]], key=str)
    twice = spark.createDataFrame([(1, t, 0) for t in texts], docs.schema)
    assert sorted(r["text"] for r in simhash.keep_one(twice).collect()) == sorted(texts)


def test_simhash_hot_keys(spark, words, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 3)
    monkeypatch.setattr(simhash, "BLOCK", 2)
    check_classes(spark, near_texts(words))


@pytest.mark.parametrize("equal", [2, 3, 4])
def test_pigeonring_keeps_every_near_pair(equal):
    random = np.random.default_rng(equal)
    a = random.integers(0, 1 << 63, 5000, dtype=np.uint64)
    b = a.copy()
    for _ in range(4):
        b ^= np.where(random.random(5000) < 0.9, np.uint64(1) << random.integers(0, 64, 5000).astype(np.uint64), np.uint64(0))
    far = a ^ random.integers(0, 1 << 63, 5000, dtype=np.uint64)
    segments = simhash.ring(equal)
    assert sum(w for _, w in segments) == 64
    assert simhash.near(a, b, segments, 4).all()
    assert (simhash.near(a, far, segments, 4) == (np.bitwise_count(a ^ far) <= 4)).all()


@pytest.mark.parametrize("nodes", [100, 4_000])  # all keys are hubs; only the stars' centres are
def test_components_of_paths_and_stars(spark, nodes):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 150), (150, 200)]
    got = {r["u"]: r["v"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), nodes).collect()}
    want = {k: v for k, v in plain_components({n for e in edges for n in e}, edges).items() if k != v}
    assert got == want


def vectors(n=900, dims=16, seed=6):
    random = np.random.default_rng(seed)
    centres = random.standard_normal((8, dims)) * 2
    return (centres[random.integers(0, 8, n)] + random.standard_normal((n, dims))).astype(np.float32) * random.uniform(0.5, 2, (n, 1)).astype(np.float32)


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    """The driver holds, prints and logs each plan: one over both stars reads its input some sixty times."""
    scans, cut = [], components.cut

    def counted(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD"))
        return cut(df)

    monkeypatch.setattr(components, "cut", counted)
    edges = spark.createDataFrame([(i + 1, i) for i in range(9)], "u long, v long")
    assert {r["v"] for r in components.components(edges, 10).collect()} == {0}
    assert max(scans) <= 12


def test_visits_are_calibrated_on_vectors_that_were_not_fitted(spark, monkeypatch):
    """Small leaves lie close to the few vectors that they were fitted on; recall holds for all."""
    random = np.random.default_rng(9)
    v = random.standard_normal((20_000, 32)).astype(np.float32)
    monkeypatch.setattr(ann, "SAMPLE", 1_000)
    monkeypatch.setattr(ann, "LEAF_ROWS", 100)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>")
    exact = v[::100].astype(float) @ v.T.astype(float)
    exact[np.arange(200), np.arange(0, 20_000, 100)] = -np.inf
    best = {100 * i: set(np.argsort(-row)[:20].tolist()) for i, row in enumerate(exact)}
    got = ann.search(table, table.where("vec_id % 100 = 0")).collect()
    assert sum(r["vec_id"] in best[r["query_id"]] for r in got) / 4_000 >= 0.93


def test_neighbours_in_bounded_pieces(spark, monkeypatch):
    """Visits are bits, lists of leaves are spelt out a few queries at a time, a query comes to a block once; the answer is the same."""
    assert ann._blocks([1, 2, 3], {1: 5, 2: 5, 3: 5}, {1: 8_000, 2: 8_000, 3: 8_000}, 8_000, 20) == {n: (0, 1, 1) for n in (1, 2, 3)}
    random = np.random.default_rng(6)
    monkeypatch.setattr(ann, "LEAF_ROWS", 8)
    vectors = random.normal(size=(1_500, 8)).astype(np.float32)
    vectors[100:140] = vectors[100]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>").repartition(3)
    kept, found, sent = [], [], []
    cut = ann.cut
    monkeypatch.setattr(ann, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    for spelt, pending in ((64, 1 << 18), (3, 5)):
        monkeypatch.setattr(ann, "SPELT", spelt)
        monkeypatch.setattr(ann, "PENDING", pending)
        found.append(sorted(map(tuple, ann.search(table, table.where("vec_id % 3 == 0")).collect())))
        sent.append(kept[-1].agg(F.max(F.octet_length("marks")), F.count(F.lit(1))).first())
    assert found[0] == found[1] and len(found[0]) == 500 * 20
    assert all(most <= (1_500 // 8 + 7) // 8 and n == 500 for most, n in sent)
    # in one block, however few pairs are pending
    left = pa.table({"leaf": pa.array([0, 0, 1, 1, 1] * 4), "vec_id": pa.array(range(20)), "embedding": pa.array(vectors[90:110].tolist(), pa.list_(pa.float32()))})
    right = pa.table({"query_id": pa.array([3, 50]), "query": pa.array(vectors[[93, 7]].tolist(), pa.list_(pa.float32())), "floor": pa.array([-np.inf, -np.inf]), "leaves": pa.array([[1, 0], [0]])})
    some = ann._block(left, right, 8, 4)
    monkeypatch.setattr(ann, "PENDING", 1 << 18)
    assert some.equals(ann._block(left, right, 8, 4)) and some.num_rows == 8


def test_neighbours_reach_their_recall(spark, monkeypatch):
    monkeypatch.setattr(ann, "LEAF_ROWS", 32)
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 8)
    v = vectors()
    v[100:160] = v[100]  # copies
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, [1.0] * 3), (None, [1.0] * 16)]
    rows.append(rows[5])
    table = spark.createDataFrame([(*r, 1.0) for r in rows], "vec_id long, embedding array<float>, score double")
    got = ann.search(table, table.where("vec_id % 20 == 0")).collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        apart = ann.search(table, table.where("vec_id % 20 == 0")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(map(tuple, apart)) == sorted(map(tuple, got))
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) == set(range(0, 900, 20))
    hits = 0
    for q, found in by.items():
        exact = (v.astype(float) * v[q].astype(float)).sum(axis=1)
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(r["score"] == pytest.approx(exact[r["vec_id"]], abs=1e-12) and r["vec_id"] != q for r in found)
        assert [(-r["score"], r["vec_id"]) for r in found] == sorted((-r["score"], r["vec_id"]) for r in found)
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-exact[i], i))[:20]
        hits += len({r["vec_id"] for r in found} & set(best))
    assert hits / (20 * len(by)) >= 0.9
    few = ann.search(table.where("vec_id < 5"), table.where("vec_id = 0"))
    assert sorted(r["vec_id"] for r in few.collect()) == [1, 2, 3, 4]
    assert ann.search(table.limit(0), table).count() == 0


@pytest.mark.parametrize("clusters", [0, 200])
def test_the_leaves_alone_reach_the_recall(spark, clusters, monkeypatch):
    random = np.random.default_rng(7)
    v = random.standard_normal((20_000, 24))
    if clusters:
        v = v * 0.3 + random.standard_normal((clusters, 24))[random.integers(0, clusters, len(v))]
    v = v.astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").cache()
    asked = table.where("vec_id % 100 = 0")
    exact = v[::100].astype(float) @ v.T.astype(float)
    exact[np.arange(200), np.arange(0, 20_000, 100)] = -np.inf
    best = {100 * i: set(np.argsort(-row)[:20].tolist()) for i, row in enumerate(exact)}

    def recall():
        got = {}
        for r in ann.search(table, asked).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        return sum(len(got.get(q, set()) & b) for q, b in best.items()) / 4_000

    assert recall() >= 0.9
    if clusters:
        # the answer is the visited leaves': few visits lose neighbours, without leaves there is nothing
        monkeypatch.setattr(ann, "visits_needed", lambda *a: 1)
        assert recall() < 0.9
        monkeypatch.setattr(ann, "_blocks", lambda *a: {})
        assert ann.search(table, asked).count() == 0
    else:
        sample = ann._lifted(v[:8_000].astype(float), float(np.sqrt((v.astype(float) ** 2).sum(axis=1)).max()))
        tree = ann.Tree(sample, 100)
        needed = ann.visits_needed(tree, sample, 20)
        assert 1 < needed < len(tree.leaf) == len(tree.in_order())


def test_repeated_ids_count_once(spark):
    rows = [(1, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0])]
    table = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, block int")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(table, table).collect())
    assert got == [(1, 1, 2, 6.0), (1, 2, 3, 3.0), (2, 1, 1, 6.0), (2, 2, 3, 3.0), (3, 1, 1, 3.0), (3, 2, 2, 3.0)]


def labelled(spark, words, bad, n=700):
    random = np.random.default_rng(8)
    texts, marks = [], []
    for i in range(n):
        marks.append(int(random.random() < 0.3))
        texts.append(bad(list(random.choice(words, random.integers(5, 80))), random) if marks[-1] else " ".join(random.choice(words, random.integers(5, 80))) + ".")
    docs = spark.createDataFrame([(i, t, "en", "s", 1.0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, score double")
    return docs, marks


@pytest.mark.parametrize("op", [toxicity, quality])
def test_classifiers_learn_and_stay_within_bounds(spark, words, op):
    def insult(own, random):
        own.insert(random.integers(len(own)), random.choice(["zzgrumpf", "qqworsty", "grumpfzz"]))
        return " ".join(own)

    def shouted(own, random):
        return " ".join(f"{w.upper()}!!" for w in own)

    docs, marks = labelled(spark, words, insult if op is toxicity else shouted)
    column = "toxic" if op is toxicity else "quality"
    value = (lambda m: m) if op is toxicity else (lambda m: 1 - m)
    labels = spark.createDataFrame([(i, value(m), 5) for i, m in enumerate(marks) if i % 3] + [(3, None, 5), (None, 1, 5)], f"doc_id long, {column} int, text int")
    more = docs.union(spark.createDataFrame([(-1, None, None, None, None), (-2, "", None, None, None), (None, "word", None, None, None), (-3, "w " * 50_000, None, None, None)], docs.schema))
    got = {r["doc_id"]: r for r in op.scores(more, labels).collect()}
    assert len(got) == len(marks) + 4
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= op.THRESHOLD) for r in got.values())
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items() if i is not None)
    held = [i for i in range(len(marks)) if got[i]["held_out"]]
    assert np.mean([got[i]["predicted"] == value(marks[i]) for i in held]) > 0.95
    kept = (op.drop_toxic if op is toxicity else op.drop_poor)(docs, labels)
    assert kept.columns == docs.columns
    assert 0.6 < kept.count() / len(marks) < 0.8
    assert op.scores(more.limit(0), labels).count() == 0
    none = op.scores(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in none}) == 1


def test_toxicity_index_is_exact(words, monkeypatch):
    random = np.random.default_rng(9)
    vectors = random.random((600, 40)).astype(np.float32) * (random.random((600, 40)) < 0.15)
    norm = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    vectors = (vectors / np.where(norm > 0, norm, 1)).astype(np.float32)
    row, term = np.nonzero(vectors)
    index = toxicity.Index(row, term, vectors[row, term], np.zeros(600), np.array([f"{i:03}" for i in range(600)], dtype=object), 40)
    queries = vectors[::7]
    row, term = np.nonzero(queries)
    near, place = index.nearest(len(queries), row, term, queries[row, term], 10)
    products = np.round((queries.astype(float) @ vectors.T.astype(float)), 6)
    exact = np.sort(products, axis=1)[:, ::-1][:, :10]
    assert np.abs(near - exact).max() < 2e-6
    named = index.ids[place].astype(int)
    assert np.abs(np.take_along_axis(products, named, 1) - near)[place >= 0].max() < 2e-6
    # blocks whose bound is too low are not read
    read = []
    monkeypatch.setattr(toxicity, "BLOCK", 8)
    small = toxicity.Index(*[np.array(x) for x in ([*range(40)], [k // 8 for k in range(40)])], np.ones(40, np.float32), np.zeros(40), np.arange(40).astype(str), 5)
    cosines = small.cosines
    monkeypatch.setattr(small, "cosines", lambda b, *a: read.append(b) or cosines(b, *a))
    small.nearest(1, np.zeros(1, int), np.array([2]), np.ones(1, np.float32), 4)
    assert read == [2]


def test_toxicity_index_takes_texts_in_small_parts():
    """The driver compares the whole labelled sample with itself; what that holds at once mustn't grow with the sample."""
    random = np.random.default_rng(3)
    n, held = 4_096, 60
    row, term = np.repeat(np.arange(n), held), random.integers(0, 400, n * held)
    row, term = np.divmod(np.unique(row * 400 + term), 400)
    weight = np.full(len(row), held**-0.5, np.float32)
    index = toxicity.Index(row, term, weight, np.zeros(n), np.array([f"{i:04}" for i in range(n)], dtype=object), 400)
    tracemalloc.start()
    try:
        index.nearest(n, row, term, weight, toxicity.NEIGHBOURS, skip=np.arange(n))
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_chi_square_levels():
    assert toxicity.least_chi_square(0.05) == pytest.approx(3.841, abs=1e-3) and toxicity.least_chi_square(1e-7) == pytest.approx(28.374, abs=1e-2)


@pytest.mark.parametrize("op,column,least", [(toxicity, "toxic", (0.7, 0.98)), (quality, "quality", (0.98, 0.93))])
def test_held_out_accuracy_of_the_test_tables(spark, op, column, least):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = op.scores(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", column).toPandas()
    for value, share in zip((1, 0), least):
        own = held[held[column] == value]
        assert (own["predicted"] == value).mean() >= share


def test_no_clash_with_columns_of_documents(spark, words):
    docs, marks = labelled(spark, words, lambda own, r: " ".join([*own, "zzgrumpf"]), 120)
    for name in ("__id", "__copies", "__LAP", "__toxicity", "__quality", "__row", "fingerprint", "component_id", "evidence", "bucket"):
        docs = docs.withColumn(name, F.lit(1))
    labels = spark.createDataFrame([(i, m, 1 - m) for i, m in enumerate(marks)], "doc_id long, toxic int, quality int")
    for kept in (mixing.take(docs), toxicity.drop_toxic(docs, labels), quality.drop_poor(docs, labels), simhash.keep_one(docs)):
        assert kept.columns == docs.columns and kept.count() > 0


def test_toxicity_evidence(spark, words):
    docs, marks = labelled(spark, words, lambda own, r: " ".join([*own, "zzgrumpf"]))
    labels = spark.createDataFrame([(i, m) for i, m in enumerate(marks)], "doc_id long, toxic int")
    scored = toxicity.score(docs, toxicity.fit(docs, labels), "s", "why", 4)
    row = scored.orderBy(F.col("s").desc()).first()
    assert 0 < len(row["why"]) <= 4 and all(e["label"] in (0, 1) and 0 < e["cosine"] <= 1.00001 for e in row["why"])
    assert all(int(e["doc_id"]) < 700 and marks[int(e["doc_id"])] == e["label"] for r in scored.limit(50).collect() for e in r["why"])


def sizes(spark, words, n=400):
    random = np.random.default_rng(10)
    texts = [" ".join(random.choice(words, random.integers(1, 60))) for _ in range(n // 2)]
    texts += [texts[0]] * (n // 3)  # a hot group
    texts += [None, "", " \t", texts[1], "w " * 3000]
    return spark.createDataFrame([(i, t, ["b", "a", None, "é", "c"][i % 5] if i % 3 else "hot", 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, size int"), texts


def test_shards_are_even_and_gapless(spark, words):
    docs, texts = sizes(spark, words)
    got = sharding.assign(docs).collect()
    assert len(got) == len(texts)
    total = {}
    for r in got:
        body = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(body) + 1 and r["text_crc32"] == zlib.crc32(body)
        total.setdefault(r["shard"], []).append(r)
    bytes_ = [sum(r["size"] for r in own) for own in total.values()]
    assert len(total) == 8 and max(bytes_) - min(bytes_) <= 0.2 * np.mean(bytes_) + 6001
    shards_of = {}
    for r in got:
        shards_of.setdefault(texts[r["doc_id"]] or "", []).append(r)
    assert len({r["shard"] for r in shards_of[texts[0]]}) > 4
    tokens = lambda own: sum(r["tokens"] for r in own)
    for own in shards_of.values():
        # only a group larger than a shard is split
        if sum(r["size"] for r in own) <= sum(bytes_) / 8 and len(own) <= len(got) / 8 and tokens(own) <= tokens(got) / 8:
            assert len({r["shard"] for r in own}) == 1
    for own in total.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.assign(docs.repartition(5)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}
    assert sharding.assign(docs.limit(0)).count() == 0
    assert sharding.assign(docs.union(docs.limit(2))).count() == len(texts) + 2


def plain_deal(left, item, count):
    """One item at a time."""
    left, taken = left.copy(), np.zeros(len(left), int)
    room = np.floor(np.maximum(left[:, 0], 0) / item[0] + 1e-9)
    for _ in range(count):
        fits = taken < room
        shard = int(np.argmax(np.where(fits, left @ item, -np.inf) if fits.any() else left[:, 0]))
        taken[shard] += 1
        left[shard] -= item
    return taken


def test_cells_are_dealt_as_one_item_at_a_time():
    random = np.random.default_rng(11)
    for _ in range(60):
        left, item, count = random.normal(0.5, 0.4, (8, 3)), random.random(3) * 10 ** random.uniform(-4, -1), int(random.integers(1, 400))
        assert sharding.deal(left, item, count).tolist() == plain_deal(left, item, count).tolist()
    items, counts = random.random((30, 3)) * 100, random.integers(1, 50, 30)
    got = sharding.pack(items, counts, 4)
    scaled, left = items / (items * counts[:, None]).sum(axis=0) * 4, np.ones((4, 3))
    for i in np.argsort(-scaled.max(axis=1), kind="stable"):
        taken = plain_deal(left, scaled[i], int(counts[i]))
        assert got[i].tolist() == taken.tolist()
        left -= taken[:, None] * scaled[i]
    assert (got.sum(axis=1) == counts).all() and sharding.pack(np.zeros((0, 3)), np.zeros(0, int), 4).shape == (0, 4)


def test_small_groups_go_through_cells(spark, words):
    docs, texts = sizes(spark, words)
    got = sharding.assign(docs, large=8).collect()
    total, by_text = {}, {}
    for r in got:
        total[r["shard"]] = total.get(r["shard"], 0) + r["size"]
        by_text.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    assert len(got) == len(texts) and max(total.values()) - min(total.values()) <= 0.1 * np.mean(list(total.values())) + 6001
    assert [t for t, s in by_text.items() if len(s) > 1] == [texts[0]]


def plain_mix(rows):
    """targets by bisection on the level, and the law's bounds."""
    total = {}
    for _, size, source in rows:
        total[source] = total.get(source, 0) + size
    ordered = sorted((s for s in total if s is not None)) + ([None] if None in total else [])
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(ordered)}
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * total[s], level * weight[s]) for s in total) < 1.5 * sum(total.values()) else (low, level)
    return total, {s: min(2 * total[s], low * weight[s]) for s in total}


def test_mix_meets_its_targets(spark, words):
    docs, texts = sizes(spark, words)
    rows = [(i, len((t or "").encode().split()), ["b", "a", None, "é", "c"][i % 5] if i % 3 else "hot") for i, t in enumerate(texts)]
    total, target = plain_mix(rows)
    got = {r["doc_id"]: r for r in mixing.mix(docs).collect()}
    taken = {}
    for i, size, source in rows:
        r = got[i]
        assert r["size"] == size and r["source_size"] == total[source] and r["target"] == pytest.approx(target[source], rel=1e-6)
        assert r["taken"] in (0, size, 2 * size)
        taken[source] = taken.get(source, 0) + r["taken"]
    largest = max(s for _, s, _ in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * largest for s in total)
    assert sum(taken.values()) <= sum(target.values()) + 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(7)).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    out = mixing.take(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {i: r["copies"] for i, r in got.items() if r["copies"]}
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


@pytest.mark.parametrize("most", [10_000, 0])
def test_take_hands_on_what_the_mix_takes_whatever_the_ids(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", most)
    random = np.random.default_rng(4)
    texts = ["a b c", "d", "e f g h i j", "", None, "k l"]
    pick = lambda *of: of[int(random.integers(0, len(of)))]
    mixed = [(pick(None, 1, 2, i), pick(*texts), pick("s1", "s2", None), pick(1, 2), "x") for i in range(300)]
    equal = [(None, "a b c", "s1", 1, "x")] * 150 + [(5, "a b c", None, 1, "x")] * 100 + [(i, "w", "s3", i, "y") for i in range(50)]
    for rows in (mixed, equal):
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string, place int, tie string").repartition(3)
        want = {r["source"]: r["n"] for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("n")).collect()}
        out, got, often = mixing.take(docs), {}, {}
        assert out.schema == docs.schema
        for r in map(tuple, out.collect()):
            got[r[2]] = got.get(r[2], 0) + len((r[1] or "").split())
            often[r] = often.get(r, 0) + 1
        assert got == {s: n for s, n in want.items() if n}
        assert all(n <= 2 * rows.count(r) for r, n in often.items())
    assert mixing.take(docs.limit(0)).count() == 0


def test_pipeline_stages_work_on_what_is_left(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    left = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == columns, name
        docs = docs.cache()
        left.append(docs.count())
    assert left[0] >= left[1] >= left[2] >= left[3] and left[3] > 0.4 * left[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == left[-1] and "doc_id" in last.columns


def test_pipeline_stages_against_plain_versions(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "mixing", "tokens"]
    rows = {r["doc_id"]: r for r in docs.collect()}
    scored = {r["doc_id"]: r["predicted"] for r in toxicity.scores(docs, labels).collect()}
    assert sorted(r["doc_id"] for r in stages["toxicity"](spark, docs, sf).collect()) == sorted(i for i, p in scored.items() if not p)
    scored = {r["doc_id"]: r["predicted"] for r in quality.scores(docs, labels).collect()}
    assert sorted(r["doc_id"] for r in stages["quality"](spark, docs, sf).collect()) == sorted(i for i, p in scored.items() if p)
    prints = {i: plain_fingerprint(r["text"]) for i, r in rows.items()}
    linked = [(i, j) for i in rows for j in rows if i < j and (prints[i] ^ prints[j]).bit_count() <= 4]
    assert sorted(r["doc_id"] for r in stages["near_duplicates"](spark, docs, sf).collect()) == sorted(set(plain_components(rows, linked).values()))
    sized = [(i, len((r["text"] or "").encode().split()), r["source"]) for i, r in rows.items()]
    _, target = plain_mix(sized)
    mixed, taken = stages["mixing"](spark, docs, sf), {}
    for r in mixed.collect():
        assert r == rows[r["doc_id"]]
        taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").encode().split())
    assert all(abs(taken.get(s, 0) - t) <= 2 * max(n for _, n, _ in sized) for s, t in target.items())
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in stages["tokens"](spark, docs, sf).collect():
        assert r["ids"] == tokenizer.encode(rows[r["doc_id"]]["text"] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_quality_votes_against_brute_force():
    random = np.random.default_rng(6)
    vectors = np.abs(random.standard_normal((300, 20))).astype(np.float32)
    vectors[50:60] = vectors[40:50]  # equal examples: the first place wins
    label = random.integers(0, 2, 300)
    model = quality.Model(np.arange(20, dtype=np.int32), np.ones(20, np.float32), quality._unit(vectors), label, (0.5, 0.5), 8, 15)
    asked = quality._unit(np.abs(random.standard_normal((40, 20))).astype(np.float32) @ model.axes)
    for skip in (None, np.arange(40)):
        want = []
        for i, v in enumerate(asked):
            cosines = [round(float(np.float32(v) @ np.float32(e)), 6) for e in model.examples]
            near = sorted((j for j in range(300) if skip is None or j != skip[i]), key=lambda j: (-cosines[j], j))[:15]
            weights = [max(cosines[j], 0) ** 16 for j in near]
            want.append((sum(w * label[j] for w, j in zip(weights, near)) + neighbours.ANCHOR * label.mean()) / (sum(weights) + neighbours.ANCHOR))
        assert model.vote(asked, skip) == pytest.approx(np.array(want), abs=2e-5)


def test_quality_learns_from_a_text_once(spark, words):
    good, bad = "A sentence, with care; it ends. ", "BUY NOW!! $$$ "
    rows = [(i, (good if i % 2 else bad) * 3 + " ".join(words[i : i + 5])) for i in range(60)] + [(100 + i, good * 7) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 or i >= 100)) for i, _ in rows], "doc_id long, quality int")
    learnt = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 5}
    model = quality.fit(docs, labels)
    assert len(model.label) == len({t for i, t in rows if i in learnt})


def test_quality_gathers_no_zeros(spark, words, monkeypatch):
    """The examples' vectors come to the driver without their zeros, and as they would with them."""
    random = np.random.default_rng(8)
    marks = list(quality._MARKS)
    rows = [(i, " ".join(w + str(random.choice(marks)) * (i % 3) for w in random.choice(words, 12))) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    gathered, given = [], []
    kind, model = type(docs), quality.Model
    arrow = kind.toArrow
    monkeypatch.setattr(kind, "toArrow", lambda df: gathered.append(arrow(df)) or gathered[-1])
    monkeypatch.setattr(quality, "Model", lambda number, idf, vectors, *a: given.append((number, idf, vectors)) or model(number, idf, vectors, *a))
    quality.fit(docs, labels)
    ((number, idf, vectors),) = given
    assert gathered[0].nbytes < vectors.nbytes / 2
    want = []
    for _, text in sorted((i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5):
        data = np.frombuffer(text.encode(), np.uint8)
        offsets = np.array([0, len(data)])
        want.append(quality.weighted(quality.counts(data, offsets, number, len(idf)), offsets, idf)[0])
    assert vectors == pytest.approx(np.array(want), abs=1e-6)
