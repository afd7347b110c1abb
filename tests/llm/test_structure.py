"""Repair of conversations, target resampling and extraction from pages against plain second computations."""

from __future__ import annotations

import hashlib
import html
import itertools
import math
import random
import re
import subprocess
import sys
import zlib
from functools import lru_cache

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.llm import conversation_repair as repair
from trackloom.llm import exact_dedup as dedup
from trackloom.llm import html_extraction as extraction
from trackloom.llm import queries, target_sampling

WHITE = re.compile(r"[^\x20\x09-\x0D]")
ROWS = "conv_id long, turn long, role string, text string"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        told = [" " if x is None else str(x) for x in (conv, turn)]
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(f"{told[0]}:{told[1]}".encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def by_hand(rows, convs):
    """Backward over complete suffixes, every edit and any number of insertions up to three in a row."""
    out = {}
    for conv in convs:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        seen, faults = set(), []
        for r in own:
            shown = WHITE.findall(r[3])
            faults.append("blank" if not shown else "duplicate" if r[2:] in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add(r[2:])

        @lru_cache(maxsize=None)
        def best(i, so_far, inserted, own=own, faults=faults):
            """(cost, audit, items) from row i on, if the roles so far end as ``so_far`` says."""
            offers = []
            if i == len(own) and so_far in ("", "a"):
                offers.append((0, "", ()))
            grow = {"": "su", "s": "u", "u": "a", "a": "u"}[so_far]
            names = {"u": "user", "a": "assistant"}

            def then(cost, edit, item, state, j, used):
                got = best(j, state, used)
                if got:
                    offers.append((cost + got[0], edit + got[1], (item, *got[2]) if item else got[2]))

            if inserted < 3:
                for x in grow:
                    if x in names:
                        then(2, "I", (names[x], ""), x, i, inserted + 1)
            if i < len(own):
                then(3, "D", None, so_far, i + 1, 0)
                if faults[i] not in ("blank", "duplicate"):
                    more, text = faults[i] == "truncated", own[i][3]
                    if own[i][2][:1] and own[i][2][0] in grow:
                        then(more, "K", own[i][2:], own[i][2][0], i + 1, 0)
                    for x in grow:
                        if x in names:
                            then(2 + more, "R", (names[x], text), x, i + 1, 0)
            return min(offers, key=lambda x: x[:2]) if offers else None

        for i in range(len(own), 0, -1):  # so that no call goes deep
            for so_far in ("", "s", "u", "a"):
                best(i, so_far, 0)
        cost, audit, items = best(0, "", 0)
        turns = {r[1] for r in own} - {None}
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:])]
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in items).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(x) for x in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha)
    return out


REPORT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def reported(df):
    rows = df.collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: tuple(r[c] for c in REPORT) for r in rows}


def chats(seed=1, n=60):
    rng = random.Random(seed)
    texts = ["One.", "two", "Three!", "", "  \n", "four \t", "Five? ", "", "ok", "ok."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None]
    rows = []
    for conv in range(n):
        for turn in range(rng.randrange(0, 12)):
            turn = None if rng.random() < 0.1 else turn + rng.randrange(0, 3) * (rng.random() < 0.2)
            rows += [(conv, turn, rng.choice(roles), rng.choice([*texts, None, f"text {rng.random()}."]))] * rng.choice([1, 1, 1, 1, 2])
    return [*rows, (None, 0, "user", "no id."), (None, 1, "assistant", "none"), (n, None, None, None)]


def test_repair_of_damaged_conversations(spark, tmp_path):
    rows = chats()
    convs = {r[0] for r in rows}
    table = spark.createDataFrame([(*r, 1) for r in rows], ROWS + ", cost long").repartition(5)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    found = queries.op11_conversation_repair(spark, str(tmp_path))
    assert found.dtypes[0] == ("conv_id", "bigint") and all(t == "bigint" for _, t in found.dtypes[1:7])
    assert reported(found) == by_hand(damage(rows), convs)


@pytest.mark.parametrize("held", [1, 64, repair.HELD])
def test_repair_over_many_parts(spark, held):
    """One conversation with most rows, some of them without a turn, dealt over many tasks; small limits spill."""
    rng = random.Random(held)
    rows = [(7, None if rng.random() < 0.2 else rng.randrange(150), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", "", f"{rng.random()}."])) for _ in range(400)]
    rows += [(7, 3, "user", "many.")] * 50 + [(1, 1, "user", "x."), (9, 5, "assistant", "y"), (8, None, "system", "z.")]
    df = spark.createDataFrame(rows, ROWS).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert reported(repair.repair(df, held)) == by_hand(rows, {7, 1, 8, 9})
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_repair_of_dropped_rows_and_empty_tables(spark):
    rows = [(1, 0, "user", "a.", 1), (1, 5, "user", "gone", 0), (2, 0, "user", "gone", 0)]
    df = spark.createDataFrame(rows, ROWS + ", copies int")
    found = reported(repair.repair(df.repartition(3)))
    assert found == by_hand([r[:4] for r in rows if r[4]], {1, 2})
    assert found[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert reported(repair.repair(df.where("conv_id = 3"))) == {}


def test_repair_holds_unsettled_rows_alone():
    """A long run of clear rows leaves one node; rows that stay open leave as many as are open."""
    run = repair.Survivors()
    told = []
    for i in range(3000):
        told += run.feed("user" if i % 2 == 0 else "assistant", "x.", False, False, 1)
        node, open_rows = next(iter(run.tips.values())), 0
        while node.parent is not None:
            node, open_rows = node.parent, open_rows + 1
        assert open_rows < 20
    assert len(told) > 2900 and "".join(e for e, _ in told) == "K" * len(told)


def sample_by_hand(docs, target, percent, least, runs, buckets, seed):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: word.findall((t or "").translate(lower))
    feats = lambda t: [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for w in [words(t)] for n in range(1, runs + 1) for i in range(len(w) - n + 1)]
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for x in texts:
            for b in feats(x):
                counts[b] += 1
    gain = [math.floor(1000 * math.log((t[b] + 1) * (sum(s) + buckets) / ((s[b] + 1) * (sum(t) + buckets)))) for b in range(buckets)]
    rows = []
    for i, x in docs:
        own = feats(x)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words(x))))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    drawn = able[: percent * len(able) // 100]
    return sorted([(*r[:4], i + 1) for i, r in enumerate(drawn)] + [(*r[:4], None) for r in [*able[len(drawn) :], *(r for r in rows if r[4] < least)]], key=repr)


@pytest.mark.parametrize(("percent", "least", "runs", "buckets"), [(10, 20, 1, 10_000), (50, 3, 3, 97), (100, 0, 2, 7), (0, 5, 1, 10)])
def test_importance_sample(spark, percent, least, runs, buckets, monkeypatch):
    monkeypatch.setattr(target_sampling, "SLICE_BYTES", 300)
    rng = random.Random(percent)
    vocab = ["Alpha", "beta", "Übung", "x1", "ÀB", "don't", "a-b", "Zed"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(200)]
    docs += [(None, None), (None, "alpha beta " * 20), (500, ""), (501, " ,;\n"), (7, docs[7][1]), (7, docs[7][1]), (502, "Alpha, beta. " * 40_000)]
    target = ["alpha beta beta", None, "zed Zed übung", ""]
    df = spark.createDataFrame([(*d, 9, 9) for d in docs], "doc_id long, text string, score int, rank int").repartition(6)
    found = target_sampling.importance_sample(df, spark.createDataFrame([(x, 1) for x in target], "text string, bucket int"), percent, least, runs, buckets)
    assert [t for _, t in found.dtypes] == ["bigint"] * 5
    assert sorted(map(tuple, found.collect()), key=repr) == sample_by_hand(docs, target, percent, least, runs, buckets, 2024)


def test_importance_sample_query_and_sql(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["Alpha", "beta", "Übung", "x1", "ÀB", "don't", "a-b", "Zed"]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(150)] + [(None, "beta " * 30), (150, None), (151, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "zed zed übung beta"), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    told = con.execute(queries.ORACLES["op12_target_sampling"])
    names = [c[0] for c in told.description]
    found = queries.op12_target_sampling(spark, str(tmp_path))
    assert sorted(map(tuple, found.select(*names).collect()), key=repr) == sorted(told.fetchall(), key=repr)


def test_importance_sample_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c " * 10)], "doc_id long, text string")
    none, target = docs.where("doc_id = 0"), docs.select("text")
    assert target_sampling.importance_sample(none, target).collect() == []
    assert [r.rank for r in target_sampling.importance_sample(docs, target.where("text = ''"), 100).collect()] == [1]


@pytest.mark.parametrize("n", [1, 2, 50, 3000])
def test_cutoff_key(spark, n, monkeypatch):
    """Every kind of place among keys with many ties, over partitions of unequal size and some empty ones."""
    rng = random.Random(n)
    keys = [(rng.randrange(-5, 5) * (1 << 60 if i % 7 == 0 else 1), rng.choice([-(1 << 63), 0, 1, (1 << 63) - 1])) for i in range(n)]
    df = spark.createDataFrame(keys, "a long, b long").repartitionByRange(7, F.col("a")).cache()
    for k in sorted({1, n // 2 or 1, n}):
        assert target_sampling.cutoff(df, k) == sorted(keys)[k - 1]
    df.unpersist()


ARTICLE = ["Ein Titel & mehr", "First paragraph with <b>bold</b> words, long enough to be one of the text.", "Zweiter Absatz; auch er ist lang genug, damit man ihn als Text erkennt."]


def page_of(lines, seed=0):
    rng = random.Random(seed)
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(rng.randrange(2, 7)))
    escaped = [html.escape(x) for x in lines]
    body = f"<h1>{escaped[0]}</h1>" + "".join(f"<p>\n {x.replace(' ', rng.choice([' ', '  ', ' <b>', '<br>']), 1)} {rng.choice(['</p>', ''])}" for x in escaped[1:])
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style><script>var a='</p><article>';</script></head><body><nav><ul>{links}</ul></nav><!-- <p>no</p> --><div class=ad>Buy this now, it is cheap.</div><article>{body}</article><footer>&copy; x</footer>" + rng.choice(["</body></html>", ""])


def test_marginals_equal_enumeration():
    """Messages on random trees against the sum over all labellings, nodes and pairs; the gradient against differences."""
    rng, gen = random.Random(3), np.random.default_rng(3)
    pages, labels = [], []
    for size in (1, 2, 5, 9):
        page = extraction.Page()
        for i in range(size):
            page.add(rng.randrange(i) if i else -1, rng.randrange(16), rng.randrange(1 << 10) * (i % 2), i % 4 == 3)
            page.words[i], page.stops[i] = rng.randrange(60), i % 2
        pages.append(page)
        labels.append(gen.integers(0, 2, size))
    w, e = gen.normal(size=extraction.N_FEATURES), gen.normal(size=(3, 2, 2))
    p, pair = extraction.Forest(pages).infer(w, e)
    at = pair_at = 0
    for page in pages:
        x, kind = extraction.matrix(page)
        n = len(page.parent)
        total, node, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            weight = math.exp(sum(x[i] @ w for i in range(n) if y[i]) + sum(e[kind[i]][y[page.parent[i]]][y[i]] for i in range(1, n)))
            total += weight
            for i in range(n):
                node[i] += weight * y[i]
                if i:
                    both[i, y[page.parent[i]], y[i]] += weight
        assert p[at : at + n] == pytest.approx(node / total, abs=1e-6)
        assert pair[pair_at : pair_at + n - 1] == pytest.approx(both[1:] / total, abs=1e-6)
        at, pair_at = at + n, pair_at + n - 1


def test_trained_model_reads_other_markup():
    model = extraction.train([(page_of([f"{x} {i}." for x in ARTICLE * 2], i), None) for i in range(40)])
    given = extraction.train([(page_of([f"{x} {i}." for x in ARTICLE * 2], i), "\n".join(re.sub(r"\s+", " ", x) for x in [f"{x} {i}." for x in ARTICLE * 2])) for i in range(40)])
    text = "<p>" + "</p><p>".join(map(html.escape, ARTICLE[1:])) + "</p>"
    noise = "<div class='user-comments'><p>I do not agree with this at all, but it was a good read for me.</p></div><div id=cookieBanner>We use cookies, please accept them all now.</div>"
    other = f"<body><div class=navbar><a href=x>Home</a></div><div class='post-content'><h2>A title</h2>{text}<form><label>Mail</label><button>Send</button></form>{noise}</div><div class=sidebar>Popular now: one, two and three.</div>"
    for own in (model, given):
        assert own.texts([other]) == ["\n".join(["A title", *ARTICLE[1:]])]
    bare = " ".join(x.replace("<b>", "").replace("</b>", "") for x in ARTICLE[1:] * 3)
    assert model.texts([f"<div><p>{bare}</p><p>{bare}</p><p>{bare}</p></div>"]) == ["\n".join([bare] * 3)]
    assert model.texts(["<nav><a href=x>Home</a></nav><footer>Imprint</footer>", ""]) == ["", ""]


def test_parsing():
    runs = lambda x: [t for _, t in extraction.parsed(x).runs]
    assert runs("a<b>b</b> c<br>d<p>e&nbsp;&amp;\n f<p>g</p>h") == ["ab c d", "e & f", "g", "h"]
    assert runs("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == ["a", "b", "c", "d"]
    assert runs("<table><tr><td>a<td>b<tr><td>c</table>d") == ["a", "b", "c", "d"]
    assert runs("x < y <a title='1 > 0'>z</a> <!-- <p>c --> w<!--->v<!-- open <p>e") == ["x < y z wv"]
    assert runs("a<script>if (a</b) '</p>'</script>b<STYLE>p{}</style >c<textarea><p>no</textarea><script>open") == ["abc"]
    assert runs("</p></div>a</span><div>b</section>c</div>d") == ["a", "bc", "d"]
    deep = extraction.parsed("<div>" * 3000 + "x" + "</div>" * 3000 + "y")
    assert max(deep.depth) == 3000 and [t for _, t in deep.runs] == ["x", "y"] and deep.runs[1][0] == 0
    assert len(extraction.Model().texts(["<div>" * 3000 + "x", "<p " * 2000 + "<a b=\"c" * 2000])) == 2


def test_main_text_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(extraction, "SLICE_BYTES", 4000)
    pages = [(i, f"u{i}", page_of([f"{x} {i}." for x in ARTICLE * (1 + i % 3)], i)) for i in range(60)]
    many = ARTICLE * 3000
    pages += [(60, "long", page_of(many, 1)), (61, None, None), (62, "e", ""), (None, "n", pages[3][2]), (5, "u5", pages[5][2]), (63, "w", " \n\t<p> </p>")]
    spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, n_chars int, text string").repartition(4).write.parquet(f"{tmp_path}/pages.parquet")
    out = queries.op13_html_extraction(spark, str(tmp_path))
    assert out.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    clean = lambda lines: "\n".join(" ".join(x.split()) for x in lines)
    texts = {i: clean([f"{x} {i}." for x in ARTICLE * (1 + i % 3)]) for i in range(60)} | {60: clean(many), 61: "", 62: "", 63: ""}
    texts[None] = texts[3]
    expected = sorted(((i, u, texts[i], len(texts[i])) for i, u, _ in pages), key=repr)
    assert sorted(map(tuple, out.collect()), key=repr) == expected
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert extraction.main_text(empty).collect() == []


def verdicts(rows):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept")) for r in rows), key=repr)


@pytest.mark.parametrize("fails_at", ["texts", "records", "stream"])
def test_exact_dedup_goes_on_after_a_failed_call(spark, tmp_path, monkeypatch, fails_at):
    """A call stopped after its texts, its records or its marker, then repeated with its id, and one call more."""
    calls = [[(1, "a"), (2, "b"), (3, "a")], [(4, "b"), (5, "c  d"), (5, "c  d"), (6, "lost")], [(7, "zz"), (8, "lost"), (9, "c d")]]
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    whole, broken = f"{tmp_path}/whole", f"{tmp_path}/broken"
    expected = [verdicts(dedup.exact_dedup(make(rows), state_path=whole, run_id=str(i)).collect()) for i, rows in enumerate(calls)]
    assert expected[2] == [(7, 7, 1, True), (8, 6, 2, False), (9, 5, 3, False)]

    found = [verdicts(dedup.exact_dedup(make(calls[0]), state_path=broken, run_id="0").collect())]
    with monkeypatch.context() as m:

        def stop(*_, **__):
            raise RuntimeError("stopped")

        if fails_at == "stream":
            m.setattr(dedup, "update_state", stop)
        else:
            m.setattr(dedup.F, "octet_length" if fails_at == "texts" else "struct", stop)
        if fails_at == "records":
            # the records are there, the marker is not
            m.undo()
            m.setattr(type(spark), "createDataFrame", stop)
            rows = spark.range(4, 7).selectExpr("id AS doc_id", "element_at(array('b', 'c  d', 'lost'), CAST(id - 3 AS INT)) AS text")
            rows = rows.unionByName(rows.where("doc_id = 5"))
        else:
            rows = make(calls[1])
        with pytest.raises(RuntimeError, match="stopped"):
            dedup.exact_dedup(rows, state_path=broken, run_id="1")
    found += [verdicts(dedup.exact_dedup(make(rows), state_path=broken, run_id=str(i)).collect()) for i, rows in enumerate(calls) if i]
    assert found == expected
    # repeated once more, it changes nothing
    again = verdicts(dedup.exact_dedup(make(calls[2]), state_path=broken, run_id="2").collect())
    assert again == expected[2]


def test_exact_dedup_forgets_a_call_that_never_came_to_its_marker(spark, tmp_path):
    """Texts that a dead call has left are neither counted nor told, whoever calls next."""
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    state = f"{tmp_path}/state"
    dedup.exact_dedup(make([(1, "a")]), state_path=state).collect()
    orphans = make([(1, "lost"), (7, "zz")]).selectExpr("doc_id", "text AS norm", "unhex(sha2(text, 256)) AS digest")
    orphans.write.parquet(f"{state}/texts/run=1")
    assert verdicts(dedup.exact_dedup(make([(7, "zz")]), state_path=state).collect()) == [(7, 7, 1, True)]


PEAK = """
import random, resource
import pyarrow as pa
from trackloom.llm import queries, tokens

class Task:
    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run

peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10
path = queries.tokenizer_path("byte_bpe_50k.json")
tokens.encoder(path)
pick = random.Random(1)
known = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyz", k=pick.randint(2, 9))) for _ in range(200_000)]
batches = [pa.record_batch({"doc_id": [0] * 3000, "text": [" ".join(pick.choices(known, k=1000)) for _ in range(3000)]}) for _ in range(2)]
before = peak()
sum(x.num_rows for x in tokens.token_pieces(Task(), path)(iter(batches)))
print(peak() - before)
"""


def test_token_pieces_memory():
    """A task over texts of 39 MB holds the arrays of a small slice, and what it remembers, at any time."""
    grown = subprocess.run([sys.executable, "-c", PEAK], capture_output=True, text=True, check=True, timeout=300)
    assert int(grown.stdout) < 150
