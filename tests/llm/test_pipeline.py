"""The corpus pipeline, stage by stage and whole, on a small table with odd rows."""

import weakref
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from geocadence.llm import exact_dedup, language_id, near_dedup, packing

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, block string"
LETTERS = {"en": "etaoinshrdlu", "de": "äöüßenistrd"}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(list(LETTERS[lang]), int(rng.integers(2, 8)))) for _ in range(n))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng, rows = np.random.default_rng(7), []
    for i in range(60):
        lang = ("en", "de")[i % 2]
        rows.append((i, prose(rng, lang, 30 + i), lang, "ab"[i % 3 > 0], 0, i, "x"))
    rows += [(100 + i, rows[i][1].upper(), rows[i][2], "c", 0, 0, None) for i in range(5)]  # equal but for case
    rows += [(200 + i, rows[i][1] + " zzz", rows[i][2], "a", 0, 0, None) for i in range(5, 12)]  # near
    rows += [(300, None, "en", "a", 0, 0, None), (301, "", None, None, 0, 0, None), (302, "123 !!", "en", "a", 0, 0, None), (20, rows[20][1], "en", "a", 0, 0, None), (None, prose(rng, "en", 40), "en", None, 0, 0, None)]
    rows.append((303, prose(rng, "en", 6000), "en", "a", 0, 0, None))
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


def plain(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = dict(corpus_pipeline.STAGES)
    known = kept["language_id"](spark, docs, sf_dir).cache()
    ids = {r.doc_id for r in known.collect()}
    assert known.columns == docs.columns and not ids & {300, 301, 302} and set(range(60)) <= ids
    unique = kept["exact_dedup"](spark, known, sf_dir).cache()
    groups = {}
    for r in known.collect():
        groups.setdefault(plain(r.text), []).append(r.doc_id)
    assert unique.columns == docs.columns
    key = lambda i: -1 if i is None else i
    assert sorted(key(r.doc_id) for r in unique.collect()) == sorted(max(map(key, g)) for g in groups.values())
    near = kept["near_dedup"](spark, unique, sf_dir).cache()
    sets = {r.doc_id: near_dedup.shingle_set(r.text, 5) for r in unique.collect()}
    root = {k: k for k in sets}
    for _ in range(3):
        for a, b in combinations(sorted(sets, key=key), 2):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b], key=key)
    assert near.columns == docs.columns and {r.doc_id for r in near.collect()} == {k for k in sets if root[k] == k}
    mixed = kept["mixing"](spark, near, sf_dir).cache()
    own = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == docs.columns and set(own) <= set(root) and max(own.values()) <= 3
    pieces = kept["packing"](spark, mixed, sf_dir).collect()
    tokens = {}
    for p in pieces:
        tokens[p.doc_id] = tokens.get(p.doc_id, 0) + p.length
    assert all(tokens[p.doc_id] == own[p.doc_id] * p.doc_tokens for p in pieces) and set(tokens) == set(own)


def test_run(spark, sf_dir, tmp_path):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    size = Counter()
    for r in rows:
        size[r.sequence_id] += r.length
    assert rows and max(size.values()) <= 1024 and all(0 <= r.ids_crc32 <= zlib.crc32(b"") + 0xFFFFFFFF for r in rows)
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage, module, task, most", [("language_id", language_id, "_accepted", 1 << 20), ("near_dedup", near_dedup, "_sign", 1 << 19), ("packing", packing, "_pack", 1 << 20)])
def test_tasks_get_small_batches(spark, tmp_path, monkeypatch, stage, module, task, most):
    rng, pool = np.random.default_rng(3), [prose(np.random.default_rng(4), "en", 1) + str(i) for i in range(2000)]
    rows = [(i, " ".join(pool[j] for j in rng.integers(0, 2000, 1500)), "en", "a", 0, i, None) for i in range(250)]
    spark.createDataFrame(rows, COLUMNS).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    plain_task, row = getattr(module, task), max(len(r[1]) for r in rows)

    def watched(batches, **how):
        def small():
            for batch in batches:
                assert batch.nbytes <= most + 2 * row, f"a batch of {batch.nbytes} bytes"
                yield batch

        return plain_task(small(), **how)

    assert sum(len(r[1]) for r in rows) > 1.5 * most
    monkeypatch.setattr(module, task, watched)
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    found = dict(corpus_pipeline.STAGES)[stage](spark, docs, str(tmp_path))
    assert {r.doc_id for r in found.select("doc_id").collect()} == set(range(250))


def test_state_stores_leave_no_threads_of_their_own(spark, tmp_path):
    schema = "doc_id long, digest string, locator string"
    spark.createDataFrame([(i, f"d{i // 2}", "x") for i in range(400)], schema).write.parquet(f"{tmp_path}/keys")
    was, beans = spark.conf.get("spark.sql.shuffle.partitions"), spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    spark.conf.set("spark.sql.shuffle.partitions", "48")
    before = beans.getThreadCount()
    try:
        state = exact_dedup.advance(spark, f"{tmp_path}/keys", schema, f"{tmp_path}/state")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert beans.getThreadCount() - before < 150, "threads for each partition's state"
    assert state.count() == 200


def test_languages_are_predicted_in_small_parts(monkeypatch):
    texts, plain = ["some words " * 2000] * 100, language_id._predicted
    monkeypatch.setattr(language_id, "_predicted", lambda x, field: plain(x, field) if x.nbytes <= (512 << 10) + 2 * len(texts[0]) else pytest.fail(f"{x.nbytes} bytes at once"))
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    assert sum(b.num_rows for b in language_id._accepted(iter([batch]), None, 0.0, "text")) == 0


def test_verification_keeps_few_shingles(monkeypatch):
    alive, most, plain = weakref.WeakSet(), [0], near_dedup.shingle_set

    class Held(frozenset):
        __hash__ = object.__hash__
        __eq__ = object.__eq__

    def watched(text, width):
        out = Held(plain(text, width))
        alive.add(out)
        most[0] = max(most[0], sum(map(len, alive)))
        return out

    monkeypatch.setattr(near_dedup, "shingle_set", watched)
    texts = [" ".join(f"w{i}x{j}" for j in range(10_000)) for i in range(40)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * 40), pa.array(range(40)), pa.array([texts[0]] * 40), pa.array(texts)], ["u", "v", "ta", "tb"])
    out = pa.Table.from_batches(near_dedup._verified(iter([batch]), 80, 5))
    assert out["v"].to_pylist() == [0] and most[0] <= (1 << 16) + 4 * 10_000


def test_pipeline_packs_with_a_small_cache(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(1, "a b", "en", "a", 3, 1, None)], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    plain = packing._pack

    def watched(batches, **how):
        assert how["cache"] <= 50_000
        return plain(batches, **how)

    monkeypatch.setattr(packing, "_pack", watched)
    assert dict(corpus_pipeline.STAGES)["packing"](spark, spark.read.parquet(f"{tmp_path}/documents.parquet"), str(tmp_path)).count() == 1
