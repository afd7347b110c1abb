"""The numbered queries on small Parquet tables, and cases that need more than one run: state, blocks, long texts, orders."""

from __future__ import annotations

import hashlib
import random
import re
import wave
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, corpus, links_of, normal, removed_by_hand
from trackloom.llm import exact_dedup, jaccard_join, language_id, lm_scoring, media, mixing, queries, sharding
from trackloom.operators.shared import materialise

COLUMNS = {
    "op1_exact_dedup": "doc_id bigint, keep_id bigint, group_size bigint, kept boolean, text_sha256 string",
    "op2_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op3_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op4_token_counts": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
    "op5_substring_dedup": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op6_lm_scoring": "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double",
    "op7_ngram_jaccard_join": "doc_id bigint, class_id bigint, n_links bigint",
    "op8_mixing": "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    "op9_sharding": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10_media_columns": "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string",
}


@pytest.fixture(scope="module")
def rows():
    """The corpus and rows without an id, one of them a copy of another text."""
    found = corpus()
    extra = [(None, found[20][1]), (None, None), (None, "only here with no id at all")]
    return [(*r[:4],) for r in found] + [(i, t, "en", "odd") for i, t in extra]


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.fixture(scope="module")
def results(spark, folder):
    return {name: queries.QUERIES[name](spark, folder) for name in COLUMNS}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(results, rows, name):
    out = results[name]
    kinds = dict(out.dtypes)
    for column in COLUMNS[name].split(", "):
        c, kind = column.split()
        assert kinds[c] == kind, c
    ids = Counter(r[0] for r in rows)
    found = Counter(r.doc_id for r in (out.where("piece = 0") if name.startswith("op2") else out).select("doc_id").collect())
    assert found == ids


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_op1(results, rows):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    least = {k: min((i for i in v if i is not None), default=None) for k, v in groups.items()}
    expected = Counter((r[0], least[normal(r[1])], len(groups[normal(r[1])]), sha(normal(r[1]))) for r in rows)
    out = results["op1_exact_dedup"].collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == expected
    assert Counter(r.text_sha256 for r in out if r.kept) == Counter(sha(k) for k in groups)


def test_op2_and_op4(results, rows):
    texts = Counter((r[0], len((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.n_bytes) for r in results["op4_token_counts"].collect()) == texts
    pieces = results["op2_best_fit_packing"].toPandas()
    assert (pieces.length <= 1024).all() and (pieces.groupby("sequence_id").length.sum() <= 1024).all()
    assert pieces.groupby("sequence_id").offset.min().eq(0).all()
    assert pieces.sequence_id.nunique() >= -(-pieces.length.sum() // 1024)


def test_op5(results, rows):
    expected = Counter((r[0], a, b, sha(k)) for r, (a, b, k) in zip(rows, removed_by_hand([r[1] for r in rows]), strict=True))
    assert Counter(map(tuple, results["op5_substring_dedup"].collect())) == expected


def test_op7(results, rows):
    with_id = [r for r in rows if r[0] is not None]
    expected = {i: (c, n) for i, c, n in links_of(with_id)}
    copies = Counter(normal(r[1]) for r in rows if r[0] is None)
    for r in results["op7_ngram_jaccard_join"].where("doc_id is not null").collect():
        assert r.class_id == expected[r.doc_id][0]
        assert expected[r.doc_id][1] <= r.n_links <= expected[r.doc_id][1] + sum(copies.values())


def test_op8(results, rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    out = results["op8_mixing"].toPandas()
    assert sorted(out["size"]) == sorted(len(WORD.findall(r[1] or "")) for r in rows)
    assert (out.taken <= 2 * out["size"]).all() and out.taken.sum() == pytest.approx(out.groupby("source_size").target.first().sum(), rel=0.02)


def test_op9(results, rows):
    out = results["op9_sharding"].toPandas()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    found = Counter((None if i != i else int(i), int(s), int(c)) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32, strict=True))
    assert found == expected and set(out.law) == {"bytes"} and out.grown_shard.isna().all()
    assert out["shard"].between(0, 7).all()
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))


def test_op10(results, rows):
    out = results["op10_media_columns"].collect()
    of = lambda t: (t or "").encode() + bytes(max(64, -(-len((t or "").encode()) // 64) * 64) - len((t or "").encode()))
    expected = Counter((r[0], len((r[1] or "").encode()), hashlib.sha256(of(r[1])).hexdigest(), zlib.crc32(of(r[1])[-64:])) for r in rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in out) == expected
    by_text = defaultdict(set)
    for r in out:
        by_text[r.payload_sha256].add((r.feature, r.media_sha256, r.media_bytes))
    assert all(len(v) == 1 for v in by_text.values())


@pytest.mark.parametrize("name", [x for x in queries.ORACLES if x in COLUMNS])
def test_sql(results, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    cell = lambda x: None if pd.isna(x) else x.item() if hasattr(x, "item") else x
    told = con.execute(queries.ORACLES[name]).df()
    found = results[name].toPandas()[told.columns]
    keep = [c for c in told.columns if c != "kept"]  # a row without an id has no keep_id to equal
    assert Counter(tuple(map(cell, r)) for r in found[keep].itertuples(index=False)) == Counter(tuple(map(cell, r)) for r in told[keep].itertuples(index=False))


@pytest.mark.parametrize("name", list(COLUMNS))
def test_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0


# Exact dedup


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_dedup_in_two_increments(spark, tmp_path, digest):
    """The second call meets the first one's rows; with a digest of one byte most groups hold texts of both calls."""
    one = [(i, f"text {i % 150}") for i in range(200)]
    two = [(i, f"text  {i % 300}") for i in range(150, 500)] + [(i, f"new {i}") for i in range(10)] + [(3, "text 3")]
    make = lambda x: spark.createDataFrame(x, "doc_id long, text string")
    state = str(tmp_path / "state")
    first = exact_dedup.exact_dedup(make(one), digest=digest, state_path=state).collect()
    second = exact_dedup.exact_dedup(make(two), digest=digest, state_path=state).collect()
    groups, of = defaultdict(list), lambda t: normal(t)
    for i, t in one:
        groups[of(t)].append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in first) == sorted((i, min(groups[of(t)]), len(groups[of(t)])) for i, t in one)
    for i, t in two:
        groups[of(t)].append(i)
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in second) == sorted((i, min(groups[of(t)]), len(groups[of(t)])) for i, t in two)
    before = {(i, of(t)) for i, t in one}
    expected = Counter(i for i, t in {(i, of(t)) for i, t in two} if i == min(groups[t]) and (i, t) not in before)
    assert Counter(r.doc_id for r in second if r.kept) == expected


def test_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_HITS", 0)
    rows = [(i, f"t{i % 7}") for i in range(50)]
    out = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.keep_id) for r in out) == [(i, i % 7) for i in range(50)]


def test_keep_first_of_an_empty_table(spark):
    assert exact_dedup.keep_first(spark.createDataFrame([], "doc_id long, text string, n long")).count() == 0


# N-gram Jaccard join


def test_join_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 400)
    rows = [r[:2] for r in corpus()]
    out = jaccard_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string"), block=4)
    assert sorted(map(tuple, out.collect())) == links_of(rows)


def test_keep_one_of_an_empty_table(spark):
    assert jaccard_join.keep_one(spark.createDataFrame([], "doc_id long, text string, n long")).count() == 0


# Language id


def test_language_model_parts():
    ids, at = language_id.grams(pa.array([b"ab", b"c"], pa.binary()))
    assert np.diff(at).tolist() == [2 + 3 + 2, 1 + 2 + 1]  # letters; pairs and triples with the edges
    easy = [(np.array([0, 2]), np.array([1.0, 1.0])), (np.array([1, 2]), np.array([1.0, 1.0]))] * 40
    w = language_id.fit_ftrl(easy, np.array([0, 1] * 40), 2)
    assert w[0, 0] > 0 > w[0, 1] and w[1, 1] > 0 > w[1, 0] and not w[3:].any()
    strong = language_id.fit_ftrl(easy, np.array([0, 1] * 40), 2, l1=100.0)
    assert not strong.any()
    truth = np.array([0, 1] * 100)
    truth[::10] = 1 - truth[::10]
    logits = np.where(np.arange(2)[None, :] == np.array([0, 1] * 100)[:, None], 10.0, 0.0)
    t = language_id.temperature(logits, truth)
    loss = lambda t: -np.log(language_id.softmax(logits / t)[np.arange(200), truth]).mean()
    assert loss(t) <= min(loss(x) for x in np.linspace(0.5, 20, 200)) + 1e-6 and t > 2


def test_language_of_held_out_rows(spark, results):
    for r in results["op3_language_id"].where("doc_id is not null").collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = language_id.identified(docs)
    assert kept.columns == docs.columns
    lost = docs.join(kept.select("doc_id"), "doc_id", "left_anti").where("lang is not null").toPandas()
    assert len(lost) <= 0.02 * docs.count()


# Language-model scoring


def sentences(n, seed=4):
    """Texts in which a word tells the next one, mostly."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    after = {w: rng.choices(words, k=2) for w in words}
    out = []
    for _ in range(n):
        w = rng.choice(words)
        text = [w]
        for _ in range(rng.randint(20, 80)):
            w = rng.choice(after[w]) if rng.random() < 0.9 else rng.choice(words)
            text.append(w)
        out.append(" ".join(text))
    return out


def test_lm_beats_the_base_on_held_out_texts(spark):
    docs = spark.createDataFrame(list(enumerate(sentences(600))), "doc_id long, text string")
    out = lm_scoring.lm_scores(docs).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.avg("bits_per_byte")).first()
    assert out[0] > 0.8 * out[1] and 0 < out[2] < 8


def test_lm_scores_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame(list(enumerate(sentences(200))), "doc_id long, text string")
    few = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs.repartition(2), block_tokens=3000).collect()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        many = {r.doc_id: r.score for r in lm_scoring.lm_scores(docs.repartition(5), block_tokens=3000).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert few == pytest.approx(many, rel=1e-6)


def test_lm_probabilities_sum_to_one():
    """Over all symbols that may follow a prefix, whatever the tables hold."""
    rng = np.random.default_rng(2)
    codes = lm_scoring.Codes(np.sort(rng.integers(0, 1 << 63, 20, np.uint64)), rng.integers(1, 50, 20), 9, 30, 16)
    tables = [rng.integers(0, 8 * lm_scoring.LEVELS, 1 << 16).astype(np.uint16) for _ in range(lm_scoring.CONTEXTS)]
    weights = lm_scoring.START.astype(np.float32)
    curve = lm_scoring.refined(np.zeros((2, 8 * lm_scoring.CURVE))).astype(np.float32)
    total = sum(10 ** lm_scoring.token_logs(np.array([5, 1, s], np.uint16), codes, tables, weights, curve)[2] for s in range(22))
    assert total == pytest.approx(1.0, abs=1e-4)


def test_long_texts(spark):
    """A text of several slices, cut at white space, counts as one."""
    rng = random.Random(6)
    words = [f"long{i}" for i in range(2000)] + ["Ünï", "A"]
    text = "".join(w + rng.choice([" ", "\n", "\t \r"]) for w in rng.choices(words, k=700_000))
    rows = [(1, text), (2, text[:100_000] + "x" * 3_000_000 + " end"), (3, "short"), (4, None)]
    out = {r.doc_id: r for r in lm_scoring.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[i].n_tokens for i, _ in rows] == [len(WORD.findall(t or "")) + 1 for _, t in rows]
    parts = [p for _, _, x in lm_scoring.stretches(pa.array([text[:50_000], "", "a b"]), 1000) for p in x]
    joined = b"".join(bytes(d) for d, _ in parts).decode()
    assert joined == text[:50_000] + "a b"
    assert sum(len(WORD.findall(bytes(d).decode())) for d, _ in parts) == len(WORD.findall(text[:50_000])) + 2


# Mixing


def test_mix_takes_documents_as_often_as_told(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(["w"] * rng.randint(1, 40)), rng.choice("abc") if i % 3 else "a") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = {r.doc_id: (r.taken, r.size) for r in mixing.mix_report(docs).collect()}
    times = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(times[i] <= 2 for i, _ in enumerate(rows))
    words = sum(times[i] * taken[i][1] for i in taken)
    assert words == pytest.approx(sum(t for t, _ in taken.values()), rel=0.1)
    assert mixing.mixed_documents(docs.limit(0)).count() == 0


# Sharding


@pytest.mark.parametrize(("shards", "cell_bytes"), [(8, 500), (70, 1 << 20)])
def test_sharding_with_small_cells_and_ties(spark, shards, cell_bytes):
    rows = [(i, "the same text for many rows" if i % 3 == 0 else f"own text {i} " * (i % 9)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sharding.shard_by_bytes(docs, shards, cell_bytes=cell_bytes).toPandas()
    assert sorted(out.doc_id) == list(range(3000))
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = out.groupby("shard")["size"].sum()
    assert len(sizes) == shards and sizes.max() - sizes.min() <= 2 * out["size"].max() + 0.02 * sizes.mean()


def test_splitters_bring_few_rows_to_the_driver(spark):
    keys = materialise(spark.range(200_000).select(F.xxhash64("id").alias("__key"), F.lit(1).cast("long").alias("__size")), "keys")
    begins = sharding.splitters(keys, 200_000, 8, 50)
    below = [keys.where(sharding.shard_of(begins) < i).count() for i in range(1, 8)]
    assert begins == sorted(begins) and all(abs(n - 25_000 * i) <= 50 for i, n in enumerate(below, 1))


# Media


def test_fingerprint_of_tones():
    """The peaks of a swelling tone lie in its own frequency bin."""
    at = np.arange(64 * 64)
    tone = lambda k: np.round(128 + (40 + 60 * np.sin(np.pi * at / 512) ** 2) * np.sin(2 * np.pi * k * at / 64)).astype(np.uint8)
    for k in (8, 16):
        times, codes = media.fingerprint(tone(k))
        assert len(times) == len(codes) > 0 and set((codes >> 12).tolist()) == set((codes >> 6 & 63).tolist()) == {k}
        assert ((codes & 63) <= media.REACH).all() and times.tolist() == sorted(times)
    with wave.open(__import__("io").BytesIO(media.to_wav(bytes(64)))) as w:
        assert (w.getsampwidth(), w.getnchannels(), w.getnframes()) == (1, 1, 64)


def test_words_of_patterns():
    assert re.findall(WORD, "a\x0bb\x0cc d") == ["a", "b", "c d"]
