"""Edge cases and brute-force comparisons of the corpus operators on small tables."""

import math
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from geocadence.llm import common, components, encode, exact_dedup, language_id, language_model, licenses, mixing, near_dedup, nearest, packing, token_files, toxicity
from geocadence.llm.common import workspace
from geocadence.llm.queries import BPE
from geocadence.llm.words import words

COLUMNS = "doc_id long, text string, lang string, source string, node long, digest string, band long"
BASE = " ".join(f"w{i}" for i in range(60))
ROWS = [
    (1, "The and of in", "en", "a", 0, "", 0), (2, None, None, None, 0, "", 0), (3, "", "en", "a", 0, "", 0), (4, "THE AND of in", "en", "b", 0, "", 0), (5, "der die und das", "de", "b", 0, "", 0),
    (5, "der die und das", "de", "b", 0, "", 0), (6, "word", "en", "a", 0, "", 0), (7, BASE, "en", "a", 0, "", 0), (8, BASE.replace("w30", "x"), "en", "c", 0, "", 0), (9, BASE * 50, "en", "c", 0, "", 0),
    (10, " \n\t ", "en", "a", 0, "", 0), (None, "no id here", "en", "a", 0, "", 0), (11, "Released under the MIT License.\nthe idiot and the moron", "en", "a", 0, "", 0), (12, "12 34 !!", None, "a", 0, "", 0), (13, "q<|endoftext|>r", "en", "a", 0, "", 0), (14, "½ ² Ⅷ", "en", None, 0, "", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS).repartition(2).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def plain_ids(texts):
    """The library's own call, by a tokenizer that nothing else uses."""
    from tokenizers import Tokenizer

    return [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(BPE).encode_batch(texts, add_special_tokens=False)]


def test_encoder_equals_library():
    enc, rng = encode.PieceEncoder(BPE), np.random.default_rng(0)
    parts = ["a", "B", " ", "  ", "\n", "é", "ж", "1", "٣", "½", "'s", "!", "<|endoftext|>", "\t", "ß", "中", "_", "\u0301", "\r\n", "<|", "x1", "\x1c", "\x85"]
    texts = ["".join(parts[i] for i in rng.integers(0, len(parts), n)) for n in rng.integers(0, 30, 3000)]
    texts += ["a  b", " x", "x \n y", "q<|endoftext|>r", "", "don't we've", "a²b é́ жx", "%%%'ll x%%%", "a\n\nb\n c\n", "12ab 3.5 ٣x", BASE]
    assert enc.encode(texts) == plain_ids(texts) == enc.encode(texts)


def test_token_files_round_trip(spark, docs, empty):
    store = workspace(spark, "t")
    token_files.write_token_files(docs, store, BPE, 2)
    got = sorted(token_files.read_token_files(spark, store).collect(), key=lambda r: r.start)
    want = sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in ROWS)
    raw = plain_ids([t for _, t in want])
    start = 0
    for r, (doc_id, _), ids in zip(got, want, raw, strict=True):
        ids += b"\2\0\0\0"
        assert (-1 if r.doc_id is None else r.doc_id, r.start, r.n_tokens, r.ids_crc32, bytes(r.ids)) == (doc_id, start, len(ids) // 4, zlib.crc32(ids), ids)
        start += len(ids) // 4
    assert token_files.read_token_files(spark, store, doc_ids=[7]).count() == 1
    store = workspace(spark, "t")
    token_files.write_token_files(empty, store, BPE, 2)
    assert token_files.read_token_files(spark, store).count() == 0


def test_dictionary_is_not_trained_on_copies(spark, monkeypatch):
    texts = [f"text {i} of many " * 20 for i in range(300)]
    first = min(texts, key=lambda t: spark.createDataFrame([(t,)], "t string").select(F.xxhash64("t")).first()[0])
    df = spark.createDataFrame([(t,) for t in texts + [first] * 2000 + ["x" * 9000, None]], "text string")
    seen, train = [], zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples: seen.append(samples) or train(size, samples))
    dictionary, whole = token_files.train_dictionary(df, BPE, 2, 4, sample=200)
    assert dictionary and whole == sum(map(len, texts)) + 2000 * len(first) + 9000
    assert len(seen[0]) == len(set(seen[0])) == 200


def test_packing_covers_every_id_once(docs, empty):
    rows = packing.pack(docs, BPE).collect()
    by, own = {}, {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
        own.setdefault(r.doc_id, []).append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    texts = {r[0]: r[1] or "" for r in ROWS}
    for doc_id, raw in zip(texts, plain_ids(list(texts.values())), strict=True):
        ids, copies, at = np.append(np.frombuffer(raw, "<u4"), np.uint32(0)), sum(r[0] == doc_id for r in ROWS), 0
        assert sum(p.length for p in own[doc_id]) == copies * len(ids)
        for p in sorted(own[doc_id], key=lambda p: p.start):
            assert p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
            at = p.start if copies > 1 else at
            assert p.start == at
            at += p.length
    assert packing.pack(empty, BPE).count() == 0


def test_packing_leaves_little_padding(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, "w " * int(rng.integers(1, 2500))) for i in range(400)], "doc_id long, text string").repartition(3)
    size = {}
    for r in packing.pack(df, BPE).collect():
        size[r.sequence_id] = size.get(r.sequence_id, 0) + r.length
    assert max(size.values()) <= 1024 and sum(1024 - n for n in size.values()) <= 0.02 * sum(size.values())


def test_exact_dedup(docs, empty):
    rows = exact_dedup.exact_dedup(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in rows}
    assert by[1] == (4, 2, False) and by[2] == (3, 2, False) and by[3] == (3, 2, True) and by[5] == (5, 2, True) and by[None] == (None, 1, True)
    assert exact_dedup.exact_dedup(empty).count() == 0
    assert exact_dedup.unique_documents(docs).count() == len(ROWS) - 3


def test_equal_digests_are_told_apart_by_bytes(docs):
    from pyspark.sql import functions as F

    rough = {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs, digest=lambda t: F.length(t).cast("string")).collect()}
    assert rough == {(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_dedup(docs).collect()}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(docs, empty, width):
    sets = {r[0]: near_dedup.shingle_set(r[1] or "", width) for r in ROWS}
    root = {k: k for k in sets}
    for _ in sets:
        for a, b in combinations([k for k in sets if k is not None], 2):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_duplicates(docs, width=width).collect()
    assert len(got) == len(ROWS) and all(r.component_id == root[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) for r in got)
    assert near_dedup.near_duplicates(empty).count() == 0
    assert set(near_dedup.representatives(docs, width=2).columns) == set(docs.columns)


def test_open_buckets_are_settled_by_blocks(spark):
    rng = np.random.default_rng(1)
    texts = []
    for i in range(60):
        w = [f"w{j}" for j in range(80)]
        for j in rng.choice(80, 3 + i % 7, replace=False):
            w[j] = f"x{rng.integers(1 << 30)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    for blocks in ((7, 5), (1024, 64)):
        got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(df, width=2, blocks=blocks).collect()}
        sets = {i: near_dedup.shingle_set(t, 2) for i, t in texts}
        edges = [(a, b) for a, b in combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
        root = {k: k for k in sets}
        for _ in sets:
            for a, b in edges:
                root[a] = root[b] = min(root[a], root[b])
        assert got == root


def test_bytes_that_agree_by_chance_do_not_hide_a_shared_band():
    text = "a b c d e f"
    bands = [list(range(i, i + near_dedup.BANDS)) for i in (0, 1000)]
    bands[1][3] = bands[0][3]  # the only band shared; the bytes of the signatures agree in bands 0 to 2, too
    member = lambda node, b: {"node": node, "root": node, "n": 5, "signature": bytes(near_dedup.ROWS * near_dedup.BANDS), "bands": b, "text": text}
    fields = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64())), ("text", pa.string())]))
    batch = lambda pos: pa.RecordBatch.from_arrays([pa.array([pos], pa.int32()), pa.array([[member(1, bands[0])]], fields), pa.array([[member(2, bands[1])]], fields)], ["pos", "l", "r"])
    links = [r for b in near_dedup._block_links([batch(3)], 80, 2, near_dedup.MISS) for r in b.to_pylist()]
    assert links == [{"u": 2, "v": 1}]


def test_each_member_meets_a_component_until_it_is_linked():
    """The likeliest partner may fail; the blocks of texts then go on."""
    words_of = lambda n, own: " ".join([f"c{i}" for i in range(n)] + own)
    texts = [words_of(40, []), words_of(30, [f"x{i}" for i in range(10)]), words_of(36, ["y1", "y2"])]
    sets = [near_dedup.shingle_set(t, 2) for t in texts]
    bands = [list(range(near_dedup.BANDS))] * 3
    fields = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("signature", pa.binary()), ("bands", pa.list_(pa.int64())), ("text", pa.string())]))
    rows = [{"node": i, "root": min(i, 1) * 9, "n": len(sets[i]), "signature": bytes(near_dedup.ROWS * near_dedup.BANDS), "bands": bands[i], "text": t} for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([rows[:1]], fields), pa.array([rows], fields)], ["pos", "l", "r"])
    links = [tuple(r.values()) for b in near_dedup._block_links([batch], 80, 2, near_dedup.MISS) for r in b.to_pylist()]
    best = [r for b in near_dedup._block_best([batch], 80, near_dedup.MISS) for r in b.to_pylist() if r["y"] is not None]
    assert links == [(2, 0)] and len(best) == 1 and best[0]["x"] == 0 and best[0]["other"] == 9


@pytest.mark.parametrize(("small", "marks"), [(0, 0), (0, 65_536), (65_536, 0)])
def test_spread_join_equals_a_plain_join(spark, small, marks):
    left = spark.range(5000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS k")
    right = left.groupBy("k").count().where("k != 3").selectExpr("k", "count AS n", "k * 2 AS twice")
    for most in (10, 1500, 10_000):
        got = common.spread_join(left, right, "k", "n", ["id"], most=most, small=small, marks=marks)
        assert got.columns == ["k", "id", "n", "twice"]
        assert sorted(got.collect()) == sorted(left.join(right, "k").collect())


def test_a_stream_resumes_with_new_files(spark):
    keys, check = workspace(spark, "keys"), workspace(spark, "state")
    schema = "doc_id long, digest string, locator string, text_sha256 string"
    for rows in ([(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (0, "c")], []):
        spark.createDataFrame([(i, d, "f", d) for i, d in rows], schema).write.mode("append").parquet(keys)
        state = {r.digest: (r.keeper.doc_id, r.group_size) for r in exact_dedup.advance(spark, keys, schema, check).collect()}
    assert state == {"a": (3, 2), "b": (4, 2), "c": (0, 1)}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (30, 35)], "u long, v long")
    assert {(r.node, r.root) for r in components.components(spark, edges).collect()} == {(i, 0) for i in range(21)} | {(i, 30) for i in (30, 35, 40)}


def test_language_model_adds_up(docs, empty):
    rows = {r.doc_id: r for r in language_model.score(docs).collect()}
    assert len(rows) == len({r[0] for r in ROWS}) and rows[2].n_tokens == 1 and rows[7].n_tokens == 61
    train = [words(r[1] or "") + [b"$"] for r in ROWS if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7 != 2]
    n, v = sum(map(len, train)), len({w for t in train for w in t})
    flat = [w for t in train for w in t]
    base = sum(math.log10((flat.count(w) + 1) / (n + v + 1)) for w in [*words(BASE), b"$"])
    assert rows[7].train_tokens == n and rows[7].base_score == pytest.approx(base)
    assert language_model.score(empty).count() == 0


def test_language_model_equals_brute_force(spark):
    """Scores of all texts against interpolated modified Kneser-Ney counted in plain dictionaries."""
    from collections import Counter

    rng = np.random.default_rng(12)
    rows = [(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.4, rng.integers(0, 40)) if x < 200)) for i in range(150)] + [(200, None)]
    got = {r.doc_id: r for r in language_model.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    texts = {i: [*(t or "").split(), "$"] for i, t in rows}
    train = [t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["^", *t], t))
    ends, starts = Counter(b for _, b in two), Counter()
    for (a, _), c in two.items():
        starts[a, min(c, 3)] += 1
    context = Counter()
    for (a, _), c in two.items():
        context[a] += c
    fit = lambda counts: language_model.discounts(*(sum(c == k for c in counts) for k in (1, 2, 3, 4)))
    high, low = fit(two.values()), fit(ends.values())
    off = lambda c, d: 0 if c == 0 else d[min(c, 3) - 1]
    left = sum(off(c, low) for c in ends.values()) / len(two)
    for i, t in texts.items():
        total = 0.0
        for a, b in zip(["^", *t], t):
            base = max(ends[b] - off(ends[b], low), 0) / len(two) + left / (len(one) + 1)
            spared = sum(starts[a, k] * high[k - 1] for k in (1, 2, 3)) / context[a] if context[a] else 1.0
            total += math.log10((max(two[a, b] - off(two[a, b], high), 0) / context[a] if context[a] else 0) + spared * base)
        assert got[i].score == pytest.approx(total, abs=1e-5) and got[i].n_known == sum(w in one for w in t)


def test_language_id(spark, docs, empty):
    rows = {r.doc_id: r for r in language_id.identify(docs).collect()}
    assert rows[2].lang_pred == rows[12].lang_pred == rows[10].lang_pred == rows[14].lang_pred == "und" and rows[1].lang_pred == "en" and 0 <= rows[1].score <= 1
    assert language_id.identify(empty).count() == 0
    assert language_id.accepted(docs).columns == docs.columns


def test_forward_backward_equals_enumeration(monkeypatch):
    """Chains of one and of several stretches against all label sequences."""
    from itertools import product

    monkeypatch.setattr(language_id, "STRETCH", 3)
    rng = np.random.default_rng(6)
    field = language_id.Field(["a", "b"], np.zeros((language_id.LEXICON, 2)))
    field.moves[:] = rng.normal(size=(2, 2))
    chains = np.array([8, 1, 3, 4])
    emissions = rng.normal(size=(chains.sum(), 2))
    found, moves = field.posteriors(emissions, chains, moves=True)
    want, went, at = np.zeros_like(emissions), np.zeros((2, 2)), 0
    for n in chains:
        own, total, pairs = np.zeros((n, 2)), 0.0, np.zeros((2, 2))
        for labels in product((0, 1), repeat=int(n)):
            p = math.exp(sum(emissions[at + i, x] for i, x in enumerate(labels)) + sum(field.moves[a, b] for a, b in zip(labels, labels[1:])))
            total += p
            for i, x in enumerate(labels):
                own[i, x] += p
            for a, b in zip(labels, labels[1:]):
                pairs[a, b] += p
        want[at : at + n], went, at = own / total, went + pairs / total, at + n
    assert np.allclose(found, want) and np.allclose(moves, went)


def test_words_of_mixed_texts_are_labelled(spark):
    rng = np.random.default_rng(8)
    make = lambda letters, n: " ".join("".join(rng.choice(list(letters), int(rng.integers(3, 8)))) for _ in range(n))
    sides = {"xx": "abcdefgh", "yy": "efghijkl"}
    rows = [(i, make(sides[x], 60), x) for i, x in enumerate(["xx", "yy"] * 60)] + [(1000 + i, rows, "xx") for i, rows in enumerate(["same text abc"] * 600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = language_id.train(df, per_lang=50)
    mixed = spark.createDataFrame([(0, make("abcdefgh", 40) + " " + make("efghijkl", 40)), (1, None), (2, "x" * 60)], "doc_id long, text string")
    got = {r.doc_id: r for r in language_id.label_words(mixed, field).collect()}
    assert sum(a == b for a, b in zip(got[0].langs, ["xx"] * 40 + ["yy"] * 40)) >= 72
    assert got[1].words == [] and [len(w) for w in got[2].words] == [24, 24, 12]
    out = language_id.identify(df.where("doc_id < 1000")).where("held_out").join(df.select("doc_id", "lang"), "doc_id").collect()
    assert len(out) > 10 and all(r.lang_pred == r.lang for r in out)


def test_toxicity(spark, docs, empty):
    labels = spark.createDataFrame([(i, 1, int(i == 11)) for i in (1, 4, 5, 6, 7, 11)] + [(None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert toxicity.toxicity(docs, labels.limit(0)).agg({"score": "max"}).first()[0] == 0
    assert toxicity.toxicity(empty, labels).count() == 0


def test_label_tree_equals_a_plain_loop():
    """Structure and posteriors of correlated voters against counting row by row."""
    rng = np.random.default_rng(9)
    y = rng.random(4000) < 0.2
    a = np.where(y, rng.random(4000) < 0.8, rng.random(4000) < 0.1)
    b = np.where(rng.random(4000) < 0.9, a, rng.random(4000) < 0.5)  # follows a
    c = np.where(y, rng.random(4000) < 0.6, rng.random(4000) < 0.2)
    votes = np.column_stack([a, b, c])
    n = np.array([(~y).sum(), y.sum()], float)
    joint = np.stack([votes[y == k].T.astype(float) @ votes[y == k] for k in (0, 1)])
    parent = toxicity.structure(n, joint)
    assert sorted(parent.tolist()) == [-1, -1, 0] and parent[1] == 0 or parent.tolist() == [1, -1, -1]
    tree = toxicity.Tree(n, joint, parent)
    for row in votes[:50]:
        odds = math.log(tree.prior / (1 - tree.prior))
        for i, p in enumerate(parent):
            chance = []
            for k in (0, 1):
                own = votes[(y == k)]
                rate = (own[:, i].sum() + 0.025) / (len(own) + 0.05)
                like = own if p < 0 else own[own[:, p] == row[p]]
                q = rate if p < 0 else (like[:, i].sum() + 0.5 * rate) / (len(like) + 0.5)
                chance.append(q if row[i] else 1 - q)
            odds += math.log(chance[1] / chance[0])
        assert tree.log_odds(row[None])[0] == pytest.approx(odds)
    loop = np.zeros((2, 3, 3))
    p = 1 / (1 + np.exp(-tree.log_odds(votes)))
    for row, w in zip(votes, p, strict=True):
        loop += np.array([1 - w, w])[:, None, None] * np.outer(row, row)
    how = toxicity.Votes(0, 0)
    how.n, how.table = 3, lambda marks: votes
    batch = pa.RecordBatch.from_arrays([pa.array([[0]] * 4000), pa.nulls(4000, pa.int32()), pa.array([False] * 4000)], ["marks", "known", "held_out"])
    total = np.zeros(20)
    for out in toxicity._votes([batch.slice(0, 4000)], how, tree):
        total[out.column("at").to_numpy()] = out.column("x").to_numpy()
    assert np.allclose(total[2:].reshape(2, 3, 3), loop)


def test_rare_toxic_terms_are_mined_from_many_labels(spark):
    rng, rows = np.random.default_rng(4), []
    for i in range(4200):
        filler = " ".join(f"{'klmnprst'[j % 8]}{'aeiou'[j // 8]}" for j in rng.integers(0, 40, 12))
        rows.append((i, filler + ("" if i % 2 else " zorblat" if i % 140 == 0 else " quixnor"), 1, 1 - i % 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").cache()
    got = {r.doc_id: r.predicted for r in toxicity.toxicity(df.select("doc_id", "text"), df.select("doc_id", "quality", "toxic")).collect() if r.held_out}
    rare = [got[i] for i in got if i % 140 == 0]
    assert len(rare) > 5 and all(rare) and all(got[i] == 1 - i % 2 for i in got)


def _sums(tokens):
    total = sum(tokens.values())
    shares = [n / total for n in tokens.values() if n]
    return lambda tried: [(sum(p**a for p in shares), sum(p**a * math.log(p) for p in shares)) for a in tried]


def _weights(tokens, a):
    raw = {s: (n / sum(tokens.values())) ** a for s, n in tokens.items() if n}
    return {s: x / sum(raw.values()) for s, x in raw.items()}


def test_mixing_exponent():
    tokens = {"a": 900, "b": 50, "c": 50, "none": 0}
    a = mixing.find_exponent(_sums(tokens), 3, 0.05, 1.0, 0.97, 2.0)
    w = _weights(tokens, a)
    assert max(w[s] * 1000 / tokens[s] for s in w) == pytest.approx(2.0) and sum(w.values()) == pytest.approx(1)
    w = _weights(tokens, mixing.find_exponent(_sums(tokens), 3, 0.05, 1.0, 0.9, 1e9))
    assert -sum(x * math.log(x) for x in w.values()) == pytest.approx(0.9 * math.log(3))
    assert mixing.find_exponent(_sums({"a": 5, "b": 5}), 2, 0.5, 1.0, 0.97, 2.0) == 1.0


@pytest.mark.parametrize("rows_per_block", [4, 1024])
def test_mixing_realises_the_weights(spark, rows_per_block):
    rng = np.random.default_rng(3)
    rows = [(i, "w " * int(rng.integers(0, 60)), "abcd"[min(3, int(rng.exponential(0.9)))]) for i in range(600)] + [(900, "w " * 4000, "d"), (901, None, "a"), (902, "w w", None)]
    tokens, longest = {}, {}
    for _, t, s in rows:
        n = len((t or "").split())
        tokens[s], longest[s] = tokens.get(s, 0) + n, max(longest.get(s, 0), n)
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5), rows_per_block=rows_per_block).collect()
    total, a = sum(tokens.values()), None
    a = mixing.find_exponent(_sums(tokens), len(tokens), min(tokens.values()) / total, 1.0, 0.97, 2.0)
    for s, w in _weights(tokens, a).items():
        own = [r for r in got if r.source == s]
        assert abs(sum(r.n_tokens for r in own) - w * total) <= longest[s] / 2 + 1e-6
        full = int(w * total / tokens[s] + 1e-12)
        assert all(sum(r.repetition == i for r in own) == sum(x[2] == s for x in rows) for i in range(full))
        # a block is taken whole or not at all, but for the one block in which the last pass ends; blocks keep together
        last = {}
        for r in own:
            last.setdefault((r.repetition, r.block), set()).add(round(r.position, 12))
        assert all(len(x) == 1 for x in last.values()) and all(0 <= r.position <= 1 for r in own)


def test_mixing_long_documents_and_odd_columns(spark, docs, empty):
    df = spark.createDataFrame([(1, "w " * 300_000, "long"), (2, "a b c d e f", "short")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.repetition) for r in mixing.mix_sources(df).collect()} == {(1, 0), (2, 0), (2, 1)}
    names = ["_s", "_d", "_n", "_q", "_h", "_g", "_t", "_sha", "_kept", "_key", "_rows", "_plan", "_salt", "_hot", "_tokens", "_block", "block", "Position", "repetition", "n_tokens", "digest", "node", "a.b", "x y"]
    odd = docs.select("doc_id", "text", "lang", "source", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    for out in (mixing.mix_sources(odd), exact_dedup.unique_documents(odd), near_dedup.representatives(odd), language_id.accepted(odd)):
        assert out.columns[: len(odd.columns)] == odd.columns
        assert all(tuple(r)[4 : 4 + len(names)] == tuple(range(len(names))) for r in out.collect())
    assert mixing.mix_sources(odd).columns[-4:] == ["repetition_", "block_", "position_", "n_tokens_"]
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_sources(docs).count() > 0


def test_licenses(docs, empty):
    rows = {r.doc_id: r for r in licenses.license_scan(docs).collect()}
    assert rows[11].license == "MIT" and rows[11].dice == 1.0 and rows[1].license is None and rows[2].license is None
    scanner = licenses.Scanner(0.8)
    for name, text in licenses.TEXTS.items():
        assert scanner.best(text + " And so on")[1] == name
        assert max(scanner.scan(f"{text}\n" * 60))[1] == name and max(scanner.scan(text.replace(" ", " " * 300)))[1] == name
    assert licenses.license_scan(empty).count() == 0


def test_license_scan_equals_all_templates():
    """The best of every segment without any pruning, and every run of words of short texts."""
    scanner, rng = licenses.Scanner(0.8), np.random.default_rng(2)
    for _ in range(60):
        name = rng.choice(list(licenses.NOTICES))
        w = licenses.NOTICES[name].split()
        for i in rng.integers(0, len(w), rng.integers(0, 3)):
            w[i] = "zzz"
        w = [f"a{i}" for i in range(rng.integers(0, 6))] + w + [f"b{i}" for i in range(rng.integers(0, 6))]
        found, best = scanner.scan(" ".join(w)), 0.0
        for i in range(len(w)):
            for j in range(i + 2, len(w) + 1):
                own = licenses.bigrams(" ".join(w[i:j]))
                best = max([best, *(2 * len(own & g) / (len(own) + len(g)) for _, _, g in scanner.templates)])
        assert max((f[0] for f in found), default=0.0) == pytest.approx(best if best >= 0.8 else 0.0)


def test_licenses_within_other_text(spark):
    other = " ".join(f"word{i}" for i in range(300))
    notice = licenses.NOTICES["GPL-3.0"]
    texts = [f"{other}\n\n" + t.replace("\n", "\n\n") + f"\n\n{other}" for t in licenses.TEXTS.values()]
    wrapped = notice.replace("GNU ", "GNU\n")
    both = licenses.NOTICES["MPL-2.0"] + "\n" + licenses.NOTICES["MIT"]
    texts += [f"{other} {wrapped} {other}", f"{other} {notice} {other}", other, "\n".join([notice] * 3), both]
    rows = sorted(licenses.license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r.license for r in rows] == [*licenses.TEXTS, "GPL-3.0", "GPL-3.0", None, "GPL-3.0", "MIT"]
    assert all(r.dice > 0.99 and r.segment in texts[r.doc_id] for r in rows if r.license) and rows[-2].n_segments == 2
    assert rows[-1].licenses == ["MIT", "MPL-2.0"] and rows[-3].licenses == []


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((300, 8))
    x[200:] = x[7]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [], 0), (1080, [None] * 8, 0)]
    got = nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows=128, queries=4).collect()
    y = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 300, 20):
        own = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        scores = y @ y[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-scores[i], i))[:20]
        hits += len({r.vec_id for r in own} & set(want))
        assert [r.rank for r in own] == list(range(1, 21)) and all(r.score == pytest.approx(scores[r.vec_id]) for r in own)
    assert {r.query_id for r in got} == set(range(0, 300, 20)) and hits >= 0.9 * 15 * 20


def test_nearest_with_repeated_ids(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.1]), (2, [0.1, 1.0]), (2, [0.1, 1.0])]
    got = sorted((r.rank, r.vec_id, round(r.score, 9)) for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=3).collect())
    assert got == sorted([(1, 1, 1.0), (2, 2, 0.1), (3, 2, 0.1), (1, 2, 1.0), (2, 2, 1.0), (3, 1, 0.1)])
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_recall_of_blocks_that_are_not_verified_whole():
    """Random directions of 64 dimensions, in which all other vectors lie about as far away."""
    rng = np.random.default_rng(1)
    for n in (2000, 8192):
        x = rng.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        block, found = nearest.Block(np.arange(n), np.arange(n), x, 64), []
        for q, (ids, _) in enumerate(block.search(x[:60], list(range(60)), 20, 0.7, 0.3, 1.33, 1.06)):
            scores = x @ x[q]
            scores[q] = -9
            found.append(len(set(ids) & set(np.argsort(-scores)[:20].tolist())) / 20)
        assert np.mean(found) >= 0.95 and min(found) >= 0.8
