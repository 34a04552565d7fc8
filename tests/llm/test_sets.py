"""N-gram join, centroid clustering and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import re
from functools import partial
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geocadence.llm import centroids, fill_middle, ngram_join
from geocadence.llm.common import mark_possible
from geocadence.llm.near_dedup import shingle_set

COLUMNS = "doc_id long, text string, node long, keys string, `a.b` int, fim_text string, _digest string"
BASE = " ".join(f"w{i}" for i in range(120))
LONG = " ".join(f"x{i % 5000}y{i % 77}" for i in range(400_000))
TEXTS = [
    (1, "The and of in"), (2, None), (3, ""), (4, "THE AND of in"), (5, "der die"), (5, "der die"), (6, "word"), (7, BASE), (8, BASE.replace("w60 ", "z ")), (9, BASE.replace("w60 ", "z ").replace("w20 ", "q ")), (10, " \n\t "),
    (None, "no id here at all"), (11, "a <P> b"), (12, LONG), (13, LONG + " more"), (14, "½ é 中文 \n tail  "), (15, "DER die"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, 0, "k", 1, "clash", "c") for d, t in TEXTS], COLUMNS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def brute_components(texts, width, percent):
    """(doc_id, size, component) of each row by all pairs and a plain search."""
    sets = [shingle_set(t or "", width) for _, t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(texts):
        least.setdefault(find(i), []).append(d)
    lowest = {r: min((d for d in ds if d is not None), default=None) for r, ds in least.items()}
    return sorted(((d, len(sets[i]), lowest[find(i)]) for i, (d, _) in enumerate(texts)), key=repr)


def found(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=repr)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_join_on_odd_rows(docs, empty, width, percent):
    assert found(ngram_join.ngram_join(docs, width, percent)) == brute_components(TEXTS, width, percent)
    assert ngram_join.ngram_join(empty).collect() == []


@pytest.mark.parametrize(("width", "percent", "block_bytes", "small"), [(3, 90, 4 << 20, 32), (2, 60, 2_000, 2), (3, 80, 400, 0)])
def test_ngram_join_equals_brute_force(spark, monkeypatch, width, percent, block_bytes, small):
    """Families of near copies, texts of common passages that are not similar, and small vocabularies, so that buckets are
    large and blocks are met."""
    monkeypatch.setattr(ngram_join, "SMALL", small)
    rng = np.random.default_rng(width)
    passages = [[f"p{k}-{i}" for i in range(12)] for k in range(8)]
    texts = []
    for family in range(6):
        base = [f"f{family}-{i}" for i in rng.integers(0, 30, 60)]
        for _ in range(12):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 6)):
                own[at] = f"e{rng.integers(0, 9)}"
            texts.append(own[: rng.integers(50, 61)])
    for _ in range(70):
        texts.append([w for k in rng.choice(8, 4, replace=False) for w in passages[k]])
    texts += [[f"v{i}" for i in rng.integers(0, 4, rng.integers(0, 12))] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert found(ngram_join.ngram_join(spark.createDataFrame(rows, "doc_id long, text string"), width, percent, block_bytes)) == brute_components(rows, width, percent)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.lists(st.integers(0, 60), min_size=1, max_size=40, unique=True), st.integers(50, 99), st.integers(0, 4))
def test_filters_never_drop_a_similar_pair(a, b, percent, depth):
    """Keys are what is common; the rest of each set is its own and comes first in the order."""
    a, b = np.array(sorted(a)), np.array(sorted(b))
    n, m, both = len(a), len(b), len(np.intersect1d(a, b))
    similar = 100 * both >= percent * (n + m - both)
    assert ngram_join.similar_keys(a, n, b, m, percent, ngram_join.first_shared(a, n, b, m, percent), depth) == similar
    assert ngram_join.suffix_distance(a, b, 1 << 30, depth) <= n + m - 2 * both


def plain_clusters(rows, k, rounds, dimensions, scale, seed):
    kept = [(i, np.floor(np.array(v, np.float64) * scale).astype(np.int64)) for i, v in rows if v is not None and len(v) == dimensions and all(x is not None and np.isfinite(x) for x in v)]
    starts = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1].tolist()))[:k]
    c = np.array([v for _, v in starts])
    for turn in range(rounds + 1):
        far = [((c - v) ** 2).sum(axis=1) for _, v in kept]
        own = [int(f.argmin()) for f in far]
        if turn < rounds:
            c = np.array([np.sum([v for (_, v), o in zip(kept, own, strict=True) if o == j], axis=0) // own.count(j) if j in own else c[j] for j in range(len(c))])
    d = [int(f.min()) for f in far]
    inertia = {j: sum(x for x, o in zip(d, own, strict=True) if o == j) for j in set(own)}
    digest = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    return sorted(((i, o, x, inertia[o], sum(d), digest[o]) for (i, _), o, x in zip(kept, own, d, strict=True)), key=repr)


def clustered(df, **how):
    rows = centroids.cluster(df, **how).collect()
    return sorted(((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in rows), key=repr), rows


def test_clusters_equal_plain_k_means(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 8, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.3, 8)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    how = {"k": 12, "rounds": 8, "dimensions": 8, "scale": 64, "seed": 1}
    got, full = clustered(df, **how)
    assert got == plain_clusters(rows, **how)
    assert sum(r.scans for r in full) < 0.5 * 9 * len(full)  # the bounds settle most vectors


def test_clusters_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [None, 1.0]), (None, [-3.5, 0.25]), (8, [0.0, 0.0]), (9, [-0.01, 5e4])]
    df = spark.createDataFrame([(*r, 0, 0.0, "c") for r in rows], "vec_id long, embedding array<double>, cluster int, upper double, `a.b` string")
    for k in (1, 3, 20):
        how = {"k": k, "rounds": 3, "dimensions": 2, "scale": 64, "seed": 1}
        assert clustered(df, **how)[0] == plain_clusters(rows, **how)
    assert centroids.cluster(df.limit(0)).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e300, 0.0])], "vec_id long, embedding array<double>"), k=1, dimensions=2).collect()


def test_tightened_bound_holds_for_points_of_the_sphere():
    rng = np.random.default_rng(0)
    less = 0
    for _ in range(300):
        own, old, new = rng.normal(0, 5, (3, 4))
        new = old + rng.normal(0, 1, 4)
        radius = rng.uniform(0, 4)
        bound, drift = centroids.tightened(own, radius, old, new), np.linalg.norm(new - old)
        way = rng.normal(0, 1, (500, 4))
        x = own + way / np.linalg.norm(way, axis=1, keepdims=True) * radius
        assert (np.linalg.norm(x - old, axis=1) - np.linalg.norm(x - new, axis=1)).max() <= bound + 1e-9
        assert bound <= drift + 1e-12
        less += bound < 0.9 * drift
    assert less > 100


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(doc_id, text, seed=42, percent=50, spm=80):
    text = text or ""
    h = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    units = UNIT.findall(text)
    n = len(units)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return doc_id, n, "plain", None, None, text, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < spm else "psm"
    return doc_id, n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}", text


def made(df, **how):
    out = fill_middle.restore(fill_middle.transform(df, **how), *fim_names(df))
    names = fim_names(df)
    return sorted((tuple(r[c] for c in ("doc_id", "fim_units", names[1], "fim_prefix_chars", "fim_middle_chars", names[0], "fim_restored")) for r in out.collect()), key=repr)


def fim_names(df):
    return ("fim_text_" if "fim_text" in df.columns else "fim_text"), "fim_form"


@pytest.mark.parametrize(("percent", "spm"), [(50, 80), (100, 0), (100, 100)])
def test_fill_middle_equals_plain_cutting(docs, empty, percent, spm):
    want = sorted((plain_fim(d, t, 42, percent, spm) for d, t in TEXTS), key=repr)
    assert made(docs, percent=percent, spm_percent=spm) == want
    out = fill_middle.transform(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.where("fim_text != 'clash' OR `a.b` != 1 OR _digest != 'c'").isEmpty()
    assert fill_middle.transform(empty).collect() == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\téж<>PSM", max_size=40), st.integers(0, 50), st.integers(0, 50), st.sampled_from(["psm", "spm"]))
def test_rotations_restore_exactly(text, one, two, form):
    if any(m in text for m in ("<P>", "<S>", "<M>")):
        return
    data = text.encode()
    ends = [0, *fill_middle.unit_ends(np.frombuffer(data, np.uint8)).tolist()]
    assert [data[a:b].decode() for a, b in zip(ends, ends[1:], strict=False)] == UNIT.findall(text)
    a, b = sorted((ends[one % len(ends)], ends[two % len(ends)]))
    p, m, s = data[:a], data[a:b], data[b:]
    out = fill_middle.fill_middle(data, a, b, form)
    assert out == (b"<P>" + p + b"<S>" + s + b"<M>" + m if form == "psm" else b"<S>" + s + b"<P>" + p + b"<M>" + m)
    assert fill_middle.restore_middle(out, form) == data


def test_hashes_of_cuts(docs):
    """The first four groups of the digest decide; equal rows are cut alike."""
    out = fill_middle.transform(docs.where("doc_id = 5"), percent=100).select(F.col("fim_text_").alias("t")).distinct()
    assert out.count() == 1


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 400), st.integers(50, 99), st.integers(0, 1 << 30))
def test_similar_sets_share_the_parts_they_must(n, percent, seed):
    rng = np.random.default_rng(seed)
    a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
    change = rng.integers(0, max(1, len(a) // 4))
    b = np.unique(np.concatenate([rng.permutation(a)[change:], rng.integers(0, 1 << 63, rng.integers(0, change + 1)).astype(np.uint64)]))
    both = len(np.intersect1d(a, b))
    if not both or len(a) == len(b) == both or 100 * both < percent * (len(a) + len(b) - both):
        return
    for own, other in ((a, b), (b, a)):
        others = {x for _, parts in ngram_join.part_probes(other, percent) for x in parts.tolist()}
        probes = ngram_join.part_probes(own, percent)
        assert any(need <= 0 or len(others & set(parts.tolist())) >= need for need, parts in probes)


@pytest.mark.parametrize(("places", "most"), [(8, 1 << 28), (1, 1 << 28), (8, 1)])
def test_marks_never_miss_a_partner(spark, places, most):
    """Values in common are always marked, nulls too; others seldom, unless the bits are too few."""
    left = spark.range(90_000).select((F.col("id") % 3).alias("_place"), F.when(F.col("id") > 0, F.col("id")).alias("a"), F.lit("x").alias("b c"))
    right = left.where("a IS NULL OR a < 30000")
    out = mark_possible(left, right, ["a", "b c"], "marked", places, most)
    assert out.columns == [*left.columns, "marked"] and out.count() == 90_000
    assert out.where("(a IS NULL OR a < 30000) AND NOT marked").isEmpty()
    share = out.where("a >= 30000").agg(F.avg(F.col("marked").cast("int"))).first()[0]
    assert share < 0.15 if (places, most) == (8, 1 << 28) else share < 0.8
    assert mark_possible(left, right.limit(0), ["a", "b c"], "marked", places, most).where("marked").isEmpty()


def test_ngram_join_with_marks_by_chance(spark, monkeypatch):
    """Rows that are marked without a partner change nothing."""
    monkeypatch.setattr(ngram_join, "mark_possible", lambda left, right, by, flag: left.withColumn(flag, F.lit(True)))
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, 80)) for _ in range(40)]
    texts = [*texts, *texts[:25], *(t.replace("w1", "y", 1) for t in texts[10:30]), None, "one", "ONE"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_components(rows, 3, 90)
    assert found(ngram_join.ngram_join(df, 3, 90)) == want
    monkeypatch.setattr(ngram_join, "mark_possible", partial(mark_possible, places=1))
    assert found(ngram_join.ngram_join(df, 3, 90)) == want


def test_ngram_join_shuffles_no_text_without_partner(spark, tmp_path):
    """Of texts that nearly all stand alone, neither the texts nor the digests of their parts cross the shuffle whole."""
    rng = np.random.default_rng(4)
    texts = [" ".join(f"{i:x}" for i in rng.integers(0, 1 << 60, 400)) for _ in range(1500)]
    rows = [*enumerate(texts), *((2000 + i, texts[i] + " end") for i in range(0, 100, 10))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "docs"))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written()
        out = ngram_join.ngram_join(spark.read.parquet(str(tmp_path / "docs")), 3, 90).collect()
        moved = written() - before
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert sorted(r.component_id for r in out if r.doc_id >= 2000) == list(range(0, 100, 10))
    assert moved < 0.35 * sum(len(t) for _, t in rows)
