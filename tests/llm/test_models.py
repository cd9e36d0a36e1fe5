"""Classifiers on held-out rows, mixing, tokens, near duplicates and the pipeline."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.comparing import connection, same
from tests.llm import fixtures as fx
from textquarry.llm import dac, mixing, near_dedup, quality, registry, toxicity

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_quality_on_held_out_rows(spark):
    out = quality.classify_quality(read(spark, LARGER, "documents"), read(spark, LARGER, "labels"))
    rows = out.join(read(spark, LARGER, "labels"), "doc_id").collect()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    test = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in test) >= 0.97 * len(test)


def test_pairwise_part_equals_the_double_sum():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.1, rng.normal(size=9), rng.normal(size=(9, 3)))
    at, x = np.array([0, 2, 5, 8]), rng.normal(size=4)
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.score(at, x) == pytest.approx(1 / (1 + np.exp(-(0.1 + m.weights[at] @ x + pairs))))


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify_quality(fx.table(spark), none).collect()
    assert len(rows) == len(fx.rows()) and all(0 < r.score < 1 for r in rows)
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(20)] + [(3, None, None), (None, 1, 1)], none.schema)
    assert quality.classify_quality(fx.table(spark), labels).count() == len(fx.rows())
    assert quality.keep_good(fx.table(spark), labels).columns == fx.table(spark).columns
    assert quality.classify_quality(fx.table(spark).where("false"), labels).count() == 0


def test_scores_do_not_depend_on_names_or_labels(spark):
    docs, labels = read(spark, SF, "documents"), read(spark, SF, "labels")
    machine = quality.train(docs, labels)
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 7)
    a = {r.doc_id + 7: r.score for r in quality.score_quality(docs, machine).collect()}
    assert a == {r.doc_id: r.score for r in quality.score_quality(other, machine).collect()}


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi")
    rows = toxicity.score_toxicity(docs, read(spark, sf, "labels")).join(read(spark, sf, "labels"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.01 * len(clean)
    assert np.mean([r.expected_severity for r in toxic]) > 1 > 0.2 > np.mean([r.expected_severity for r in clean])


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_scores_equal_a_plain_computation(spark, name):
    docs = read(spark, SF, "documents") if name == "sf" else fx.table(spark)
    labels = read(spark, SF, "labels") if name == "sf" else spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(25)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    m, cache = quality.train(docs, labels), quality.WordHashes()

    def quality_of(text):
        at, x = quality.features((text or "").encode(), cache)
        pairs = sum(float(m.factors[i] @ m.factors[j]) * a * b for p, (i, a) in enumerate(zip(at, x, strict=True)) for j, b in zip(at[:p], x[:p], strict=True))
        return 1 / (1 + np.exp(-(m.bias + sum(m.weights[i] * a for i, a in zip(at, x, strict=True)) + pairs)))

    o = toxicity.train(docs, labels)
    index = {int(h): i for i, h in enumerate(o.vocabulary)}

    def toxic_of(text):
        times = defaultdict(int)
        for w in fx.item_words(text):
            times[quality.WordHashes()[w.encode()]] += 1
        z = sum(o.weights[index[h]] * np.log1p(n) for h, n in times.items() if h in index)
        return sum(1 - 1 / (1 + np.exp(-np.clip(c - z, -35, 35))) for c in o.cuts)

    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id is not None and len(r.text or "") < 1500}
    some = sorted(rows, key=str)[:40]
    scores, grades = defaultdict(list), defaultdict(list)
    for r in quality.classify_quality(docs, labels).collect():
        scores[r.doc_id].append(r.score)
    for r in toxicity.score_toxicity(docs, labels).collect():
        grades[r.doc_id].append(r.expected_severity)
    assert len(some) > 15
    for doc_id, text in some:
        assert any(x == pytest.approx(quality_of(text), abs=1e-9) for x in scores[doc_id])
        assert any(x == pytest.approx(toxic_of(text), abs=1e-9) for x in grades[doc_id])


def test_samples_keep_their_bounds_at_any_size(spark):
    ids = spark.range(20_000)
    for most, rows in ((2_000, 1e10), (6_000, 1e10)):
        share = 0.95 * most / rows
        assert int(share * 1_000_000) == 0
        wide = ids.where(quality.below(share * 1e6, F.col("id"))).count()  # a millionth of such a table
        assert abs(wide - 20_000 * share * 1e6) < 5 * (20_000 * share * 1e6) ** 0.5
    assert ids.where(quality.below(1e-30, F.col("id"))).count() == 0 and ids.where(quality.below(1.0, F.col("id"))).count() == 20_000
    rows = spark.createDataFrame([(i, [1, 2, 3, 4], [0.5] * 4, 4, i % 2) for i in range(1000)], "doc_id long, at array<int>, x array<double>, size long, label int")
    assert len(quality.sparse_rows(rows)) == 1000
    thinned = quality.sparse_rows(rows, most=1000)
    assert 150 < len(thinned) < 350 and all(at.tolist() == [1, 2, 3, 4] for at, _, _, _ in thinned)


def test_ordinal_model_orders_grades():
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(400):
        level = rng.integers(0, 4)
        rows.append((np.ones(level), np.arange(level), int(level)))
    m = toxicity.fit(rows, 3, np.arange(3, dtype=np.uint64))
    assert (np.diff(m.cuts) > 0).all()
    expected = [m.expected(np.ones(k), np.arange(k))[0] for k in range(4)]
    assert expected == sorted(expected) and expected[0] < 0.5 and expected[3] > 2.5


def test_toxicity_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(fx.table(spark), none).collect()
    assert len(rows) == len(fx.rows()) and all(r.predicted == 0 and r.expected_severity < 0.01 for r in rows)
    assert toxicity.score_toxicity(fx.table(spark).where("false"), none).count() == 0


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_agrees_with_sql(spark, name):
    same(registry.QUERIES[name](spark, SF), connection(SF), registry.ORACLES[name])


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_mix_meets_its_targets(spark, name):
    docs = read(spark, SF, "documents") if name == "sf" else fx.table(spark)
    rows = mixing.mix_sources(docs).collect()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda rs: sorted(((r.doc_id, r.size, r.taken) for r in rs), key=str)
    assert key(rows) == key(again) and len(rows) == docs.count()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    assert sum(v[0].target for v in by.values()) == pytest.approx(sum(r.size for r in rows))
    for v in by.values():
        assert v[0].target <= 3 * v[0].source_size + 1e-6
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r.size for r in v)
        assert all(r.taken <= 3 * r.size for r in v)


def test_targets_with_caps(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 1000), ("c", 1000), (None, 0)], "source string, size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    assert got["a"] == 3 and got[None] == 0
    assert got["b"] / got["c"] == pytest.approx(2) and sum(got.values()) == pytest.approx(2001)


def dense_balance(rows, goal, slack):
    """Rates by nested bisection over single documents: another solver, no cells."""
    names = sorted({r.source for r in rows if 0 < goal[r.source][0] and not goal[r.source][1]}, key=str)
    size = np.array([float(r.size) for r in rows])
    band = np.array([r.size.bit_length() for r in rows]) - sum(r.size * r.size.bit_length() for r in rows) / size.sum()
    of = np.array([names.index(r.source) if r.source in names else -1 for r in rows])
    full = np.array([goal[r.source][1] for r in rows])
    want, n, theta = np.array([goal[x][0] for x in names]), size.sum(), 0.0
    fixed = 3 * (size * band)[full].sum()

    def fill(theta):
        lo, hi = np.full(len(names), -600.0), np.full(len(names), 600.0)
        for _ in range(200):
            mid = (lo + hi) / 2
            got = np.bincount(of[of >= 0], (size * np.minimum(3, np.exp(np.clip(mid[of] + theta * band, -700, 50))))[of >= 0], len(names))
            hi, lo = np.where(got > want, mid, hi), np.where(got > want, lo, mid)
        return (lo + hi) / 2

    lo, hi = -40.0, 40.0
    for _ in range(100):
        theta = (lo + hi) / 2
        lam = fill(theta)
        w = np.where(of >= 0, np.minimum(3, np.exp(lam[of] + theta * band)), 0)
        slope = (size * w * band).sum() + fixed + slack * n * theta
        lo, hi = (lo, theta) if slope > 0 else (theta, hi)
    return np.where(full, 3.0, np.where(of >= 0, np.minimum(3, np.exp(lam[of] + theta * band)), 0.0)), theta


@pytest.mark.parametrize("name", ["sf", "odd", "skewed", "short"])
def test_newton_equals_a_dense_solver(spark, name):
    if name in ("sf", "odd"):
        docs = read(spark, SF, "documents") if name == "sf" else fx.table(spark)
    else:
        rng = np.random.default_rng(2)
        long = lambda s: int(rng.integers(300, 900)) if s == "a" else int(rng.integers(1, 40))
        sources = [("a", "b", "c", None)[int(x)] for x in rng.choice(4, 300, p=[0.7, 0.2, 0.08, 0.02])]
        rows = [(i, "w " * (long(s) if name == "skewed" else 1 + i % 3), s) for i, s in enumerate(sources)]
        docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rows = [r for r in mixing.mix_sources(docs).collect() if r.size]
    goal = {r.source: (r.target, r.target >= 3 * r.source_size - 1e-9) for r in rows}
    want, theta = dense_balance(rows, goal, mixing.SLACK)
    assert np.array([r.rate for r in rows]) == pytest.approx(want, abs=2e-6)
    assert any(len({r.rate for r in rows if r.source == x}) > 1 for x in goal) or abs(theta) < 1e-6
    size, rate = np.array([r.size for r in rows]), np.array([r.rate for r in rows])
    band = np.array([int(x).bit_length() for x in size])
    plain = np.array([r.target / r.source_size for r in rows])
    miss = lambda w: abs((size * w * band).sum() / (size * w).sum() - (size * band).sum() / size.sum())
    assert miss(rate) <= miss(plain) + 1e-9
    assert all(r.copies in (np.floor(r.rate), np.ceil(r.rate)) for r in rows)


def test_copies(spark):
    docs = fx.table(spark)
    out = mixing.take_copies(docs)
    assert out.columns == docs.columns
    taken = defaultdict(int)
    for r in mixing.mix_sources(docs).where("copies > 0").collect():
        taken[r.doc_id] += r.copies
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == taken
    assert mixing.take_copies(docs.where("false")).count() == 0
    assert mixing.mix_sources(docs.where("false")).count() == 0
    assert all(r.taken == 0 for r in mixing.mix_sources(docs.withColumn("text", F.lit(" "))).collect())


def test_many_sources_are_joined_by_salts(spark, monkeypatch):
    docs = read(spark, SF, "documents")
    want = sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "few", lambda df, most: False)
    assert sorted(map(tuple, mixing.mix_sources(docs).collect()), key=str) == want


def whole_ids(text):
    t = Tokenizer.from_file(VOCABULARY)
    return t.encode(text or "", add_special_tokens=False).ids + [1]


@pytest.mark.parametrize("name", ["sf", "odd"])
def test_tokens_round_trip(spark, name):
    docs = read(spark, SF, "documents") if name == "sf" else fx.table(spark)
    start, want = 0, []
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    for r in rows:
        ids = whole_ids(r.text)
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    got = dac.token_output(docs, VOCABULARY, shard_tokens=500)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[1]) == want
    assert dac.token_output(docs.where("false"), VOCABULARY).count() == 0


def test_single_ids_need_no_decoding():
    rng = np.random.default_rng(3)
    docs = [rng.integers(0, 1 << int(b), 700).astype(np.uint32) for b in (3, 8, 9, 16, 32)] + [np.zeros(0, np.uint32)]
    shard, flat = dac.Shard(dac.encode_shard([5, None, 7, 8, 9, 10], docs)), np.concatenate(docs)
    assert (shard.all() == flat).all() and [shard.token(i) for i in range(len(flat))] == flat.tolist()
    assert shard.doc_ids == [5, None, 7, 8, 9, 10] and shard.ends.tolist() == [700, 1400, 2100, 2800, 3500, 3500]
    with pytest.raises(IndexError):
        shard.token(len(flat))


@pytest.mark.parametrize("text", ["it's DON'T", "á b́c", "İstanbul ΣΑΣ", "<|endoftext|> x", "über, ÈTRE!!", "a b c\x1cd", "12 x1 1x", "naïve...", "", "\n", "￿ 漢字 한국어"])
def test_pieces_equal_whole_texts(text):
    cache = dac.PieceCache(VOCABULARY)
    assert cache.by_model
    assert np.frombuffer(cache.encode(text), "<u4").tolist() == whole_ids(text)[:-1]


def test_other_vocabularies_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache, text = dac.PieceCache(path), "Some words  here\nand there"
    assert not cache.by_model and not cache.by_piece
    assert np.frombuffer(cache.encode(text), "<u4").tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def reachable(rows):
    """doc_id -> (set size, smallest reachable id), by comparing all pairs."""
    sets = {}
    for r in rows:
        if r.doc_id is None:
            continue
        w = fx.SPACES.findall((r.text or "").translate(fx.LOWER))
        k = min(5, len(w))
        sets[r.doc_id] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("options", [{}, {"short": 1, "chunk": 300}, {"short": 1000}])
@pytest.mark.parametrize("name", ["sf", "odd"])
def test_near_duplicates(spark, name, options):
    docs = read(spark, SF, "documents") if name == "sf" else fx.table(spark)
    want = reachable(docs.select("doc_id", "text").collect())
    got = near_dedup.near_duplicates(docs, **options).collect()
    assert len(got) == docs.count()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_links_between_whole_and_cut_sketches(spark, seed):
    rng, rows, want = np.random.default_rng(seed), [], {}
    for pair in range(400):
        n = int(rng.integers(55, 65))
        more = int(rng.integers(max(75, n), 86))
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, more + 4)]
        rows += [(2 * pair, " ".join(words[: n + 4])), (2 * pair + 1, " ".join(words))]
        want |= {2 * pair: (n, 2 * pair), 2 * pair + 1: (more, 2 * pair if 100 * n >= 75 * more else 2 * pair + 1)}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


@pytest.mark.parametrize("options", [{}, {"short": 1, "chunk": 300}])
def test_ids_with_several_texts_are_reached_through_each(spark, options):
    rows, want = [], {}
    for base in range(0, 2000, 100):
        texts = [" ".join(f"t{base}x{k}x{i}" for i in range(90)) for k in range(3)]
        rows += [(base + 50, t) for t in texts] + [(base + 10 * k + 12, f"{t} end") for k, t in enumerate(texts)]
        want |= {base + i: base + 12 for i in (12, 22, 32, 50)}
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()
    assert len(got) == len(rows) and {(r.doc_id, r.component_id) for r in got} == set(want.items())


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_homes_of_many_chunks(spark, rounds):
    """Groups around several templates that share a passage, in chunks of few classes: pivots settle some of them."""
    rng, rows = np.random.default_rng(rounds), []
    shared = [f"s{i}" for i in range(60)]
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(90)]
        for _ in range(40):
            words = list(base)
            for at in rng.integers(0, 90, rng.integers(0, 4)):
                words[at] = f"x{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(shared + words)))
    want = reachable([type("R", (), {"doc_id": i, "text": t}) for i, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs, short=3, chunk=1500, rounds=rounds).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert 3 <= len({c for _, c in want.values()}) < 30


@pytest.mark.parametrize("lost", ["subset", "edited"])
def test_every_size_meets_its_nearest_partners(spark, lost):
    """Sets of 1 to 200 shingles and their largest linked superset, or a copy with edits spread over it."""
    rng, rows, want = np.random.default_rng(4), [], {}
    for n in range(1, 201):
        words = [f"w{x}" for x in rng.integers(0, 1 << 40, n + 4)]
        if lost == "subset":
            other = words + [f"v{x}" for x in rng.integers(0, 1 << 40, n // 3)]
        else:
            other = list(words)
            for j in range(max(0, n // 40)):
                other[40 * j + 20] = "edit"
        rows += [(2 * n, " ".join(words)), (2 * n + 1, " ".join(other))]
    want = reachable([type("R", (), {"doc_id": i, "text": t}) for i, t in rows])
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_long_chains_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101)], "a long, b long")
    got = {r.doc: r.component for r in near_dedup.components(links).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100


def test_near_duplicates_of_an_empty_table(spark):
    assert near_dedup.near_duplicates(fx.table(spark).where("false")).count() == 0
    kept = near_dedup.keep_one(fx.table(spark))
    assert kept.columns == fx.table(spark).columns and kept.where("doc_id = 6").isEmpty()


def test_pipeline(spark):
    import corpus_pipeline as P

    docs = read(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(P.STAGES):
        df = stage(spark, seen[-1], SF)
        if k + 1 < len(P.STAGES):
            assert df.columns == columns
        seen.append(df.cache())
    good, single, clean, mixed, tokens = seen[1:]
    labels = read(spark, SF, "labels")
    predicted = {r.doc_id for r in quality.classify_quality(docs, labels).where("predicted = 1").collect()}
    assert {r.doc_id for r in good.collect()} == predicted
    components = reachable(good.select("doc_id", "text").collect())
    assert {r.doc_id for r in single.collect()} == {i for i, (_, c) in components.items() if i == c}
    assert {r.doc_id for r in clean.collect()} <= {r.doc_id for r in single.collect()}
    texts = {r.doc_id: r.text for r in single.collect()}
    assert all(len(r.text) <= len(texts[r.doc_id]) for r in clean.collect())
    assert tokens.count() == mixed.count()
    rows = sorted(mixed.select("doc_id", "text").collect())
    got = sorted(map(tuple, tokens.collect()), key=lambda r: r[1])
    ids = [whole_ids(r.text) for r in rows]
    assert [(r[0], r[2], r[3]) for r in got] == [(r.doc_id, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for r, x in zip(rows, ids, strict=True)]
    final = P.run(spark, SF)
    assert sorted(map(tuple, final.collect())) == sorted(got)


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows and clashing columns go through every stage; so does no row."""
    import corpus_pipeline as P

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, fx.texts()[9]), (2, None)], "item_id long, text string")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    extra = fx.table(spark).withColumn("rate", F.lit(1)).withColumn("copies", F.lit("x")).withColumn("gone_id", F.lit(2)).withColumn("place", F.lit(0.5))
    for docs in (extra, extra.where("false")):
        for k, (name, stage) in enumerate(P.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k + 1 < len(P.STAGES):
                assert out.columns == docs.columns, name
            rows = out.count()
            assert (rows > 0) == (docs is extra), name
    kept = P.STAGES[1][1](spark, extra, str(tmp_path))
    assert kept.where("text is null").count() == extra.where("text is null").count()
    assert kept.where("doc_id is null").count() == 1
