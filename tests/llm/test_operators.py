"""The operators over documents against brute force, on small rows with nulls, copies, ties and clashing columns."""

from __future__ import annotations

import hashlib
import io
import random
import re
import wave
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.llm import exact_dedup, jaccard_join, language_id, lm_scoring, media, mixing, packing, queries, sharding, substring_dedup, tokens
from trackloom.operators.shared import materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, key string, n long, size long, shard int, rank long, content string"


def corpus() -> list[tuple]:
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)] + ["Ünï", "日本", "don't", "A", "x y"]
    texts: list[str | None] = [None, "", " \t\n", "one", "one  two", "one two", "a b c d", "İ é 😀", "<s> text </s>"]
    shared = " ".join(rng.choices(vocabulary, k=60))
    for i in range(60):
        own = " ".join(rng.choices(vocabulary, k=rng.randint(1, 120)))
        texts.append(f"{own} {shared} end{i}" if i % 7 == 0 else own)
    texts += [texts[12]] * 30 + [texts[20].replace(" ", "\n\n")]
    base = texts[30].split() + rng.choices(vocabulary, k=80)
    for i in range(50):
        near = list(base)
        near[rng.randrange(len(near))] = f"changed{i}"
        texts.append(" ".join(near))
    texts.append(" ".join(rng.choices(vocabulary, k=20_000)))
    rows = [(i * 3, t, "en", None if i % 11 == 0 else "hot" if i % 3 else f"s{i % 4}", "k", 1, 2, 3, 4, "c") for i, t in enumerate(texts)]
    return rows + [rows[15], rows[0]]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def normal(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1)])
def test_exact_dedup(docs, rows, none, digest):
    groups = defaultdict(list)
    for r in rows:
        groups[normal(r[1])].append(r[0])
    expected = sorted((r[0], min(groups[normal(r[1])]), len(groups[normal(r[1])])) for r in rows)
    out = exact_dedup.exact_dedup(docs, digest=digest).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in out) == expected
    assert sorted(r.doc_id for r in out if r.kept) == sorted(min(x) for x in groups.values())
    assert exact_dedup.exact_dedup(none).count() == 0


def test_keep_first(docs, rows):
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    texts = [normal(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({normal(r[1]) for r in rows})


def shingle_set(t):
    words = WORD.findall(t or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def links_of(rows, threshold=0.8):
    sets = [shingle_set(r[1]) for r in rows]
    linked = [[j for j, b in enumerate(sets) if i != j and a and b and len(a & b) >= threshold * len(a | b) - 1e-9] for i, a in enumerate(sets)]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        stack = [i]
        while stack:
            for j in linked[stack.pop()]:
                if root[j] > root[i]:
                    root[j] = root[i]
                    stack.append(j)
    least = defaultdict(list)
    for i, r in enumerate(root):
        least[r].append(rows[i][0])
    return sorted((rows[i][0], min(least[root[i]]), len(linked[i])) for i in range(len(rows)))


@pytest.mark.parametrize(("small", "block"), [(32, 256), (4, 8)])
def test_jaccard_join(docs, rows, none, small, block):
    out = jaccard_join.jaccard_join(docs, small=small, block=block)
    assert sorted(map(tuple, out.collect())) == links_of(rows)
    assert jaccard_join.jaccard_join(none).count() == 0


def template_crowd() -> list[tuple]:
    """Texts about half alike: a common passage, and fillers each of which many of them share. Every eighth has a near copy."""
    rng = random.Random(8)
    words = lambda k: [f"v{rng.randrange(10**6)}" for _ in range(k)]
    common, fillers, out = words(60), [words(9) for _ in range(12)], []
    for i in range(480):
        text = common + [w for f in rng.sample(fillers, 5) for w in f] + words(8)
        out.append(" ".join(text))
        if i % 8 == 0:
            out.append(" ".join(text[:20] + ["changed"] + text[21:-6] + words(6)))
    return list(enumerate(out))


def test_candidates_of_a_dense_bucket(spark):
    rows = template_crowd()
    nodes = materialise(jaccard_join.signatures(spark.createDataFrame(rows, "doc_id long, text string")), "test")
    keys = {r.doc_id: bytes(r.key) for r in nodes.collect()}
    edges = jaccard_join.candidate_edges(nodes, 0.8, 0.999, small=1, depth=1, slack=0.18)
    group = {bytes(r.node): r.component for r in jaccard_join.connected_components(edges).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    pairs = [(i, i + 1) for i in range(len(rows) - 1) if len(sets[i] & sets[i + 1]) >= 0.8 * len(sets[i] | sets[i + 1])]
    lost = [(i, j) for i, j in pairs if keys[i] not in group or group[keys[i]] != group.get(keys[j])]
    assert len(pairs) > 50 and not lost


def test_keep_one(docs, rows):
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}) == sorted({c for _, c, _ in links_of(rows)})


def test_keep_one_with_repeated_and_null_ids(spark):
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(1, one), (1, two), (2, two + " end"), (None, three), (None, three + " end"), (None, None)]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(r.doc_id for r in kept) == {1: 2, None: 2}
    assert {r.text for r in kept if r.doc_id == 1} == {one, two} and sum(r.text is None for r in kept) == 1


def removed_by_hand(texts):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    out = []
    for w in words:
        gone = set()
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone.update(range(i, i + 35))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), kept))
    return out


@pytest.mark.parametrize(("per_shard", "broadcast"), [(4000, 3_000_000), (7, 0)])
def test_substring_dedup(docs, rows, none, per_shard, broadcast):
    out = substring_dedup.substring_dedup(docs, per_shard, broadcast).collect()
    expected = sorted((r[0], *x) for r, x in zip(rows, removed_by_hand([r[1] for r in rows]), strict=True))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == expected
    assert substring_dedup.substring_dedup(none).count() == 0


def test_substring_dedup_of_a_hot_anchor(spark):
    rng = random.Random(3)
    words = lambda k: [f"h{rng.randrange(10**6)}" for _ in range(k)]
    pool = words(20_000)
    s = substring_dedup.Snippets(pa.array([" ".join(pool)]))
    i = int(s.anchor.argmin())
    phrase = pool[s.start[i] + s.windows[i] - 1 : s.start[i] + 35]
    texts = [[*words(40), *phrase, *words(40)] for _ in range(120)]
    texts += [[*words(40), *t[40:70], *words(40)] for t in texts[:20]] + [[*words(7), *t[20:], *words(3)] for t in texts[:20]]
    rows = list(enumerate(map(" ".join, texts)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring_dedup.substring_dedup(docs, 20).collect()
    expected = [(i, *x) for i, x in enumerate(removed_by_hand([t for _, t in rows]))]
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out) == expected
    wanted = materialise(substring_dedup.shared_snippets(docs, 20), "test")
    assert wanted.where("hot").count() >= 120
    shards = substring_dedup.snippet_words(docs, wanted, 1, 10**6).where("shard >= 0")
    assert shards.count() == wanted.where("not hot").count()


def test_suffixes_with_many_symbols():
    text = np.random.default_rng(1).integers(1, 5_000_000, 60)
    text[-1] = 0
    assert substring_dedup.FMIndex.suffixes(text, 60).tolist() == sorted(range(60), key=lambda i: text[i:].tolist())


def test_substring_dedup_inside_one_text(spark):
    w = [f"a{i}" for i in range(50)]
    text = " ".join([*w, "x", *w, "loop " * 200])
    out = substring_dedup.substring_dedup(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (out.n_words, out.n_removed, out.kept_text) == removed_by_hand([text])[0]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_counts(docs, rows, none, name):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(queries.tokenizer_path(name))
    model.no_truncation()
    model.no_padding()
    want = sorted((r[0], len((r[1] or "").encode()), len(model.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows)
    out = tokens.token_counts(docs, queries.tokenizer_path(name)).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in out) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in out)
    assert tokens.token_counts(none, queries.tokenizer_path(name)).count() == 0


def best_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        fitting = [b for b in range(len(bins)) if bins[b] + x <= capacity]
        if fitting:
            bins[max(fitting, key=lambda b: bins[b])] += x
        else:
            bins.append(x)
    return len(bins)


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    pieces = tokens.token_pieces(docs, path)
    out = packing.pack(pieces.withColumn("ids_crc32", F.crc32("ids"))).toPandas()
    text_of = {r[0]: r[1] or "" for r in rows}
    for doc_id, part in out.groupby("doc_id"):
        ids = np.array(model.encode(text_of[doc_id], add_special_tokens=False).ids + [2], "<u4")
        for r in part.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        assert part.drop_duplicates("piece").length.sum() == len(ids)
    bins = out.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    for _, part in bins:
        assert part.offset.tolist() == [0, *part.length.cumsum().tolist()[:-1]]
        assert part.length.sum() <= 1024
    assert out.sequence_id.nunique() <= best_fit_decreasing(out.length.tolist(), 1024)
    assert packing.pack(tokens.token_pieces(none, path)).count() == 0


def test_fullest_bin():
    rng = random.Random(1)
    for _ in range(50):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(4)}
        flat = [k for k, n in counts.items() for _ in range(n)]
        room = rng.randint(1, 90)
        sums = {0}
        for x in flat:
            sums |= {s + x for s in sums if s + x <= room}
        found = packing.fullest(dict(counts), sorted(counts, reverse=True), room)
        assert sum(k * n for k, n in found.items()) == max(sums)
        assert all(n <= counts[k] for k, n in found.items())


def test_language_id(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.language_id(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    held = out[out.held_out & out.lang.notna() & (out.text.fillna("").str.split().str.len() >= 5) & (out.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.95
    assert out.score.between(0, 1).all()
    odd = spark.createDataFrame([(1, None, "en"), (2, "", "en"), (3, "12 34 !", "de"), (4, "word", None)], "doc_id long, text string, lang string")
    pred = {r.doc_id: r.lang_pred for r in language_id.language_id(odd).collect()}
    assert pred[1] == pred[2] == pred[3] == "und"
    assert language_id.language_id(none).count() == 0


def test_lm_scoring(docs, rows, none):
    out = {r.doc_id: r for r in lm_scoring.lm_scores(docs).collect()}
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    token = lambda t: [*WORD.findall(lower(t)), None]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    counts = Counter(x for r in rows if not held(r[0]) for x in token(r[1]))
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        mine = token(r[1])
        got = out[r[0]]
        assert (got.held_out, got.n_tokens, got.n_known, got.train_tokens) == (held(r[0]), len(mine), sum(x in counts for x in mine), n)
        assert got.base_score == pytest.approx(sum(log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in mine), abs=1e-6)
        assert got.score < 0
    assert lm_scoring.lm_scores(none).count() == 0


def test_lm_scores_do_not_depend_on_buckets(spark):
    rows = [(i, " ".join(f"x{k}" for k in range(400 * i, 400 * i + 600))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    few, many = ({r.doc_id: r.score for r in lm_scoring.lm_scores(docs, buckets=k).collect()} for k in (2, 9))
    assert few == pytest.approx(many, rel=1e-9)


def test_mixing(docs, rows, none):
    out = mixing.mix_report(docs).toPandas()
    size = [(r[3], len(WORD.findall(r[1] or ""))) for r in rows]
    per = Counter()
    for s, n in size:
        per[s] += n
    names = sorted([s for s in per if s is not None]) + ([None] if None in per else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), 1.5 * sum(per.values())
    while open_:
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 2 * per[s]}
        for s in full or open_:
            target[s] = 2.0 * per[s] if full else share[s]
        rest -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    for r in out.itertuples():
        s = r.source if isinstance(r.source, str) else None
        assert r.source_size == per[s]
        assert r.target == pytest.approx(target[s])
        assert 0 <= r.taken <= 2 * r.size
    out["source"] = out.source.fillna("(none)")
    for s, taken in out.groupby("source").taken.sum().items():
        assert taken == pytest.approx(target[None if s == "(none)" else s], rel=0.02, abs=3)
    assert len(out) == len(rows)
    again = mixing.mix_report(docs.repartition(5)).toPandas()
    key = lambda d: sorted(zip(d.doc_id, d["size"], d.taken, strict=True))
    assert key(again) == key(out)
    assert mixing.mix_report(none).count() == 0


def test_mixed_documents(docs):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    assert max(Counter((r.doc_id, r.text) for r in out.collect()).values()) <= 4


def test_sharding(docs, rows, none):
    out = sharding.shard_by_bytes(docs, 4).toPandas()
    assert sorted(zip(out.doc_id, out["size"], strict=True)) == sorted((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    for _, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = out.groupby("shard")["size"].sum()
    assert sizes.max() - sizes.min() <= out["size"].max() + 0.01 * sizes.sum()
    assert sharding.shard_by_bytes(none).count() == 0


def test_media(docs, rows, none):
    out = {r.doc_id: r for r in media.media_columns(docs).collect()}
    for r in rows:
        got, data = out[r[0]], (r[1] or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        with wave.open(io.BytesIO(bytes(got.media))) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (got.n_bytes, got.payload_bytes) == (len(data), len(payload))
        assert got.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert got.tail_crc32 == zlib.crc32(payload[-64:])
        assert list(got.times) == sorted(got.times)
    assert out[9 * 3].feature != out[10 * 3].feature
    assert media.media_columns(none).count() == 0
