"""The indexes behind the similarity joins, and greedy stars, against all pairs and plain walks."""

from __future__ import annotations

import difflib
import itertools
import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trackloom.functions import similarity as S
from trackloom.operators import cleanup, compare, dedup, matching, set_index, shared, stars, title_index
from trackloom.schema import derive

WORDS = ["rain", "song", "of", "the", "night", "a", "rainy", "nights", "live", "zz", "ñandú", "x1", "song2", "go", "gogo"]


def some_titles(n, seed):
    rng = random.Random(seed)
    out = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 6))) for _ in range(n)]
    return sorted({*out, "la la la land", "land", "the the", "e" * 70, "e" * 69 + "x", "1122334455", "aeilnorst" * 9})


@pytest.mark.parametrize("least", [0.41, 0.69, 0.84])
def test_similar_titles(spark, least, monkeypatch):
    monkeypatch.setattr(title_index, "PART", 7)
    titles = some_titles(90, 2)
    rng = random.Random(5)
    s = [(rng.choice("pqr"), t) for t in titles for _ in range(2)]
    t = [(rng.choice("pqr"), x) for x in titles for _ in range(2)]
    found = title_index.similar_titles(spark.createDataFrame(s, "token string, s_nt string"), spark.createDataFrame(t, "token string, t_nt string"), least, True, ["token"]).collect()
    expected = {(k, a, b): S.title_kernel(a, b, True) for k, a in s for j, b in t if k == j}
    expected = {k: v for k, v in expected.items() if v >= least}
    assert len(found) == len(expected) and {(r.token, r.s_nt, r.t_nt): pytest.approx(r.title) for r in found} == expected


def test_title_bounds_hold(spark):
    titles = some_titles(60, 3)
    a = title_index.signed(spark.createDataFrame([(x,) for x in titles], "s string"), "s", "a")
    b = title_index.signed(spark.createDataFrame([(x,) for x in titles], "t string"), "t", "b")
    rows = a.join(b).select("s", "t", title_index.title_bound("a", "b").alias("bound"), title_index.quick_bound("a", "b").alias("quick"), title_index.most_common("a", "b").alias("common")).collect()
    for r in rows:
        x, y = " ".join(sorted(r.s.split())), " ".join(sorted(r.t.split()))
        score = 0.4 * S.token_set_ratio(r.s, r.t) / 100 + 0.4 * S.token_sort_ratio(r.s, r.t) / 100 + 0.2 * S.partial_ratio(r.s, r.t) / 100
        assert r.common >= sum(min(x.count(c), y.count(c)) for c in set(x))
        assert not (r.s and r.t) or r.bound >= score - 1e-9


@pytest.mark.parametrize("least", [0.2, 1 / 3, 0.5, 0.8, 1.0])
def test_jaccard_pairs(spark, least):
    rng = random.Random(least)
    sets = lambda n: [sorted(set(rng.choices(WORDS, k=rng.randrange(0, 7)))) for _ in range(n)]
    left, right = sets(80), [*sets(80), None]
    df = lambda x: spark.createDataFrame([(v,) for v in x], "set array<string>")
    found = {(tuple(r.l), tuple(r.r)): r.overlap for r in set_index.jaccard_pairs(df(left), df(right), least).collect()}
    overlap = lambda a, b: len({*a} & {*b}) / len({*a} | {*b})
    expected = {(tuple(a), tuple(b)): overlap(a, b) for a in left for b in right if a and b and overlap(a, b) >= least - 1e-9}
    assert found == expected


@pytest.mark.parametrize("threshold", [0.6, 0.85, 0.9])
def test_segment_pairs_lose_none(spark, threshold):
    rng = random.Random(1)
    names = {"".join(rng.choice("abc") for _ in range(rng.randrange(0, 12))) for _ in range(120)}
    for x in list(names)[:60]:
        for _ in range(2):
            i = rng.randrange(len(x) + 1)
            names |= {x[:i] + rng.choice("abé") + x[i:], x[:i] + x[i + 1 :], x[i:] + x[:i]}
    names = sorted(names)
    met = {(r.ka1, r.ka2) for r in dedup.segment_pairs(spark.createDataFrame([(x,) for x in names], "ka string"), threshold).collect()}
    ratio = lambda a, b: max(difflib.SequenceMatcher(None, a, b).ratio(), difflib.SequenceMatcher(None, b, a).ratio())
    assert met >= {(a, b) for a in names for b in names if a < b and ratio(a, b) >= threshold}
    assert all(a < b for a, b in met)


def test_segment_pairs_of_one_length_are_few(spark):
    """A hundred thousand random names of one length: candidates in proportion to the names."""
    names = spark.range(100_000).select(F.substring(F.md5(F.col("id").cast("string")), 1, 16).alias("ka"))
    assert dedup.segment_pairs(names, 0.85).count() < 400_000


def stars_by_hand(edges):
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
    taken, out = {}, {}
    for v in sorted({x for e in edges for x in e}):
        if v not in taken:
            out[v] = v
            for b in near.get(v, ()):
                if b not in taken:
                    taken[b] = v
                    out[b] = v
    return out


@pytest.mark.parametrize("kind", ["random", "dense", "chain", "clique", "star", "ladder"])
def test_first_stars(spark, kind):
    rng = random.Random(kind)
    if kind in ("random", "dense"):
        n, m = (300, 400) if kind == "random" else (40, 300)
        edges = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    else:
        n = 60
        edges = {
            "chain": {(i, i + 1) for i in range(n)},
            "clique": {(i, j) for i in range(n) for j in range(i + 1, n)},
            "star": {(0 if i % 2 else 1, i + 2) for i in range(n)} | {(i + 2, n + 5) for i in range(n)},
            "ladder": {(i, i + d) for i in range(n) for d in (1, 2)},
        }[kind]
    df = spark.createDataFrame([(a, b, a / b) for a, b in edges], "a long, b long, s double")
    found = stars.first_stars(df).collect()
    assert {r.node: r.seed for r in found} == stars_by_hand(edges) and len(found) == len({r.node for r in found})
    assert all((r.s is None) if r.seed == r.node else r.s == r.seed / r.node for r in found)


def test_long_chain_and_wide_star_finish(spark):
    """100,000 keys in a row, whose seeds are every other one, and as many around one key."""
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    row = stars.first_independent(chain).agg(F.count_if("seed").alias("seeds"), F.count("*").alias("n"), F.max(F.when(F.col("seed"), F.col("node") % 2)).alias("odd")).first()
    assert (row.seeds, row.n, row.odd) == (50_001, 100_001, 0)
    hub = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    assert stars.first_independent(hub).where("seed").count() == 1


def test_kernel_leaves_out_only_what_is_too_low():
    titles = some_titles(40, 9)
    for a in titles:
        for b in titles:
            whole, least = S.title_kernel(a, b, False), 0.6
            short = S.title_kernel(a, b, False, least)
            assert short == whole if whole >= least else short in (0.0, whole)
            assert math.isclose(S.partial_ratio(a, b), S.partial_ratio(b, a), abs_tol=1e-9) or len(a) == len(b)


@pytest.mark.parametrize(("plain", "with_album"), [(False, True), (True, False)])
def test_pairs_of_the_second_matcher(spark, plain, with_album, monkeypatch):
    """All pairs that reach the score, from the scores of all pairs; hot words in parts; a code that differs by a tab."""
    monkeypatch.setattr(matching, "PART", 5)
    rng = random.Random(11)
    titles = [t for t in some_titles(60, 9) if t]

    def rows(first):
        out = []
        for i in range(120):
            artist = rng.choice(["abba", "baab", "the who", "who", "x y", "queen and king"])
            tokens = [] if rng.random() < 0.2 else artist.split()
            out.append((first + i, rng.choice(titles), artist, rng.choice([None, "  Gold ", "gold", "İ hits", "Other"]), rng.choice([None, 0, 200, 203]), rng.choice([None, "", "C1", " c1\t", "C2"]), tokens))
        return out

    schema = "pos long, nt string, na string, album string, duration int, isrc string, tokens array<string>"
    side = lambda first, n: matching.side(spark.createDataFrame(rows(first), schema).selectExpr("*", "nt AS title", "na AS artist", "null AS year", "nt AS base"), n)
    s, t = side(0, "s"), side(1000, "t")
    s, t = spark.createDataFrame(s.collect(), s.schema), spark.createDataFrame(t.collect(), t.schema)
    met = matching.word_candidates(s, matching.target_keys(t)).unionByName(matching.fallback_candidates(s, t)).distinct()
    scored = met.join(s, "s_pos").join(t, "t_pos").select("s_pos", "t_pos", S.score_b("s", "t", True, with_album, plain)["confidence"].alias("c"))
    expected = {(r.s_pos, r.t_pos): r.c for r in scored.where("c >= 0.75").collect()}
    found = matching.pairs_b(s, t, 0.75, True, with_album, plain).distinct().collect()
    assert len(found) == len(expected) > 100 and {(r.s_pos, r.t_pos): pytest.approx(r.b_confidence) for r in found} == expected


def exchanges(monkeypatch):
    """Counts the exchanges of all plans that a comparison writes, and the tables."""
    made = []
    whole = shared.materialise

    def counted(df, name, *more):
        made.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return whole(df, name, *more)

    monkeypatch.setattr(matching, "materialise", counted)
    monkeypatch.setattr(title_index, "materialise", counted)
    return made


def library_rows(spark, n_libraries, seed=3):
    """Libraries whose positions repeat, with copies, bare artists, equal identifiers and one without tracks."""
    rng = random.Random(seed)
    rows = []
    for i in range(n_libraries):
        for pos in range(25):
            title = " ".join(rng.choice(["rain", "rainy", "song", "night", "nights", "la", "live"]) for _ in range(rng.randrange(1, 4)))
            artist = rng.choice(["Ada Lo", "Bo Kit", "Cy", "the band", "ada kit"])
            rows.append((f"L{i}", pos, rng.choice([title, f"{title} (Live)", "zq"]), artist, rng.choice([None, "One", "Two"]), rng.choice([None, 180, 184, 260]), rng.choice([None, None, None, "us1", "US1", "gb2"]), None))
    df = spark.createDataFrame(rows, "library string, pos long, title string, artist string, album string, duration int, isrc string, year int")
    return derive(df)


@pytest.mark.parametrize("scorer, strict", [("fuzzy", False), ("equality", True)])
def test_pairs_of_libraries_as_one_by_one(spark, scorer, strict):
    tracks = shared.materialise(library_rows(spark, 4), "libraries")
    names = ["L2", "L0", "none", "L3"]
    told = lambda rows: sorted((r.s_pos, r.t_pos, round(r.confidence, 9), r.match_type) for r in rows)
    found = matching.match_pairs(tracks, names, strict=strict, scorer=scorer).collect()
    assert {r.match_type for r in found} >= {"isrc", "exact", scorer} - {"equality"}
    stats = {(r.source, r.target): r for r in compare.pairwise_stats(tracks, names, strict=strict, scorer=scorer).collect()}
    assert set(stats) == set(itertools.combinations(names, 2))
    for a, b in stats:
        s, t = (tracks.where(F.col("library") == x) for x in (a, b))
        matches = matching.match_libraries(s, t, strict=strict, scorer=scorer)
        assert told(r for r in found if (r.source, r.target) == (a, b)) == told(matches.collect())
        one = compare.comparison_stats(s, t, matches).first().asDict()
        assert {c: stats[a, b][c] for c in one} == pytest.approx(one)


def test_pairs_of_libraries_share_their_exchanges(spark, monkeypatch):
    made, tracks = exchanges(monkeypatch), library_rows(spark, 10)
    broadcasts = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # plans alike whatever the tables' sizes
    try:
        matching.match_pairs(tracks, ["L0", "L1"], scorer="equality")
        two, made[:] = list(made), []
        matching.match_pairs(tracks, [f"L{i}" for i in range(10)], scorer="equality")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcasts)
    assert made == two and sum(two) > 0


def test_libraries_named_once(spark):
    with pytest.raises(ValueError, match="once"):
        compare.pairwise_stats(library_rows(spark, 2), ["L0", "L0"])
    with pytest.raises(ValueError, match="boolean"):
        matching.match_pairs(library_rows(spark, 2), ["L0", "L1"], strict=1)


def test_class_pairs(spark, monkeypatch):
    """Pairs of rows by classes: the plain join's, also where a class has more rows than a list, with nulls in what scores."""
    from trackloom.operators import classes

    monkeypatch.setattr(classes, "LIST", 3)
    rows = [(i, "ab"[i % 2], None if i % 5 == 0 else i % 4) for i in range(60)] + [(60, None, 1)]
    side = lambda n: spark.createDataFrame(rows, f"{n}_pos long, {n}_base string, {n}_duration int")
    score = F.coalesce(F.col("s_duration") - F.col("t_duration"), F.lit(-9)).alias("x")
    found = classes.class_pairs(side("s"), side("t"), ["base"], ["duration"], ["pos"], {"x": score})
    expected = side("s").join(side("t"), F.col("s_base") == F.col("t_base")).select("s_pos", "t_pos", score)
    assert sorted(found.collect()) == sorted(expected.collect())
    assert "array_intersect" not in str(found._jdf.queryExecution().optimizedPlan())


def test_best_by_parts(spark):
    """The best by the equality score without pairs of rows: as over all pairs, with blanks, nulls, no tokens and copies."""
    from trackloom.operators import classes

    pick = random.Random(5)
    of = lambda *xs: pick.choice(xs)
    row = lambda i: (i, of("x", "y", ""), of("p", "q", None, "", "P"), of(None, 0, 100, 105, 110), of(None, None, "c1", " C1", "c2"), of("na", "nb"), of(["a"], ["a", "b"], ["b", "c"], []), of("k", "l"))
    names = ("pos long", "nt string", "album string", "duration int", "isrc string", "na string", "tokens array<string>", "base string")
    s, t = (spark.createDataFrame([row(i) for i in range(n)], ", ".join(f"{k}_{c}" for c in names)) for k, n in (("s", 120), ("t", 90)))
    for on, equal, album, length in (([], False, True, True), (["base"], True, True, True), ([], False, False, True), ([], False, True, False)):
        met = F.col("s_na") == F.col("t_na") if equal else F.arrays_overlap("s_tokens", "t_tokens") | (F.size("s_tokens") == 0)
        pairs = s.join(t, met if not on else met & (F.col("s_base") == F.col("t_base")))
        pairs = pairs.withColumn("confidence", S.confidence("s", "t", False, length, album, "equality"))
        expected = matching.first_by(pairs, "s_pos", F.col("confidence").desc(), F.col("t_pos")).select("s_pos", "t_pos", "confidence")
        found = classes.best_equal(s, t, classes.artist_classes(s, t, equal), False, length, album, on)
        assert sorted(found.collect()) == sorted(expected.collect())


def test_candidate_totals(spark):
    """Totals of the candidates by word without their pairs: those of the pairs."""
    from trackloom.operators import classes

    pick = random.Random(3)
    words = lambda: " ".join(pick.choices(["red", "hot", "bolt", "ox", "new new"], k=pick.randrange(4)))
    s, t = (spark.createDataFrame([(i, words(), words()) for i in range(n)], f"{k}_pos long, {k}_nt string, {k}_na string") for k, n in (("s", 60), ("t", 50)))
    pairs = matching.word_candidates(s, t).groupBy("s_pos").agg(F.count(F.lit(1)), F.min("t_pos"), F.sum("t_pos"))
    found = classes.candidate_totals(s, t)
    assert sorted(found.collect()) == sorted(pairs.collect())
    assert "t_pos" not in found.columns


def test_best_of_the_second_matcher(spark):
    """The best candidate by distinct names, without the pairs of rows: as of all pairs that reach the score."""
    rng = random.Random(4)
    titles = [t for t in some_titles(40, 9) if t]
    schema = "pos long, nt string, na string, album string, duration int, isrc string, tokens array<string>"

    def side(first, n):
        rows = []
        for i in range(90):
            artist = rng.choice(["abba", "baab", "the who", "who", "queen and king"])
            rows.append((first + i, rng.choice(titles), artist, rng.choice([None, " Gold ", "gold", "golds"]), rng.choice([None, 0, 200, 203]), rng.choice([None, "", "C1", " c1\t"]), rng.choice([[], artist.split()])))
        df = matching.side(spark.createDataFrame(rows, schema).selectExpr("*", "nt AS title", "na AS artist", "null AS year", "nt AS base"), n)
        return spark.createDataFrame(df.collect(), df.schema)

    s, t = side(0, "s"), side(1000, "t")
    for plain, album, length in ((False, True, True), (True, False, True)):
        pairs = matching.pairs_b(s, t, 0.75, length, album, plain)
        expected = matching.first_by(pairs, "s_pos", F.round("b_confidence", 12).desc(), F.col("t_pos"))
        found = {r.s_pos: (r.t_pos, pytest.approx(r.b_confidence)) for r in matching.best_b(s, t, 0.75, length, album, plain).collect()}
        assert found == {r.s_pos: (r.t_pos, r.b_confidence) for r in expected.collect()} and len(found) > 30


def test_rows_that_score_alike_are_scored_once(spark):
    """Equal pairs are scored by class: targets with identifiers of their own don't make a pair of rows each."""
    scored = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(a, b):
        scored.add(1)
        return 0.97

    schema = "pos long, title string, artist string, album string, duration int, isrc string, year int, nt string, na string, tokens array<string>, base string"
    rows = lambda first, code: matching.side(spark.createDataFrame([(first + i, "x", "a", None, 100, code and f"{code}{i}", None, "x", "a", ["a"], "x") for i in range(60)], schema), "s" if not code else "t")
    found = matching.exact_matches(rows(0, None), rows(100, "c"), score("s_duration", "t_duration")).select("s_pos", "t_pos", "confidence").collect()
    assert sorted(found) == [(i, 100, 0.97) for i in range(60)] and scored.value < 60


def test_best_targets(spark):
    """The ten best of one base title without all pairs: as of all pairs, with copies, codes, nulls and no tokens."""
    from trackloom.operators import classes

    pick = random.Random(8)
    of = lambda *xs: pick.choice(xs)
    schema = "pos long, title string, artist string, album string, duration int, isrc string, year int, nt string, na string, tokens array<string>, base string"
    row = lambda i: (i, "", "", None, of(None, 0, 100, 104, 300), of(None, None, None, "c1", " C1"), None, of("x", "X", "y", ""), of("na", "nb"), of(["a"], ["a", "b"], []), of("k", "l"))
    s, t = (matching.side(spark.createDataFrame([row(i) for i in range(n)], schema), k) for k, n in (("s", 60), ("t", 150)))
    scored = s.join(t, F.col("s_base") == F.col("t_base")).withColumn("confidence", S.confidence("s", "t", scorer="equality"))
    expected = matching.search_results(scored, 10).select("s_pos", "t_pos", "confidence", "place")
    assert sorted(classes.best_targets(s, t, "base", 10).collect()) == sorted(expected.collect())


def test_comparison_without_missing_tracks(spark, tmp_path):
    """A library that lacks nothing leaves no file of missing tracks, and the query reads the others."""
    from trackloom.plans import catalogue, files  # noqa: F401

    row = lambda k: (k, "old ring", "Brand#1", "LARGE", 5)
    spark.createDataFrame([row(70), row(35)], "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found = catalogue.QUERIES["comparison_files"](spark, str(tmp_path)).collect()
    assert sorted(r.file for r in found) == ["matched", "summary"]


def test_records_of_equal_words_meet_once(spark, monkeypatch):
    """Copies of a recording are one candidate, that of the least id."""
    from trackloom.operators import enrich

    seen, plain = [], enrich.plain_pairs
    monkeypatch.setattr(enrich, "plain_pairs", lambda left, right, least: seen.append(right.count()) or plain(left, right, least))
    schema = "id long, title string, length long, artists array<struct<name: string>>, releases array<struct<title: string>>, isrcs array<string>, tags array<struct<name: string, count: int>>"
    records = spark.createDataFrame([(9 - i, "old ring", 1, [("ada",)], [("large",)], [], []) for i in range(5)], schema)
    asked = spark.createDataFrame([(1, "old ring", "ada", None, None, "old ring", "ada")], "pos long, title string, artist string, album string, isrc string, nt string, na string")
    assert [(r.pos, r.r.id, r.score) for r in enrich.look_up(asked, records).collect()] == [(1, 5, 1.0)] and seen == [1]


def test_cleanup_plan_in_bounded_tasks(spark, monkeypatch):
    """The plan by plain sets; the tasks that hold it grow in number with the items."""
    monkeypatch.setattr(shared, "ROWS_PER_TASK", 100)
    pick = random.Random(5)
    items = [(pick.randrange(20), pick.randrange(300)) for _ in range(4000)] + [(None, 7), (3, None)]
    groups = [(v // 3, v, v % 3 == v // 3 % 3) for v in range(300)]
    won = {g: v for g, v, w in groups if w}
    lost = {v: won[g] for g, v, w in groups if not w}
    wanted = {(p, "remove", v) for p, v in items if v in lost} | {(p, "add", lost[v]) for p, v in items if v in lost and (p is None or (p, lost[v]) not in set(items))}
    plan = cleanup.cleanup_plan(spark.createDataFrame(items, "playlist_id long, video_id long"), spark.createDataFrame(groups, "group_id long, video_id long, winner boolean"))
    rows = plan.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(map(tuple, plan.collect()), key=str) == sorted(wanted, key=str)
    assert max(Counter(r.task for r in rows).values()) < len(rows) / 8


def test_no_rows_are_sent_whole(spark, capsys):
    """Rows of both libraries and their matches meet by sorting, however small their files look."""
    rows = derive(spark.createDataFrame([(i, f"song {i}", "band", f"US{i}") for i in range(20)], "pos long, title string, artist string, isrc string").selectExpr("*", "'x' AS album", "200 AS duration", "1999 AS year", "'A' AS library"))
    s, t = (shared.materialise(matching.side(rows, n), "side") for n in "st")
    hit = shared.materialise(matching.isrc_matches(s, t), "hit")
    assert matching.missing(rows, hit).count() == 0 and hit.count() == 20
    for df in (matching.isrc_matches(s, t), matching.missing(rows, hit)):
        df.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_pairs_in_batches(spark, monkeypatch):
    """Pairs of lists leave in batches of a stated size, whatever the number of pairs; none of them is exploded by Spark."""
    from trackloom.operators import classes, unfold

    rows = pa.ListArray.from_arrays(pa.array([0, 300, 300, 340], pa.int32()), pa.StructArray.from_arrays([pa.array(range(340))], ["s_pos"]))
    others = pa.ListArray.from_arrays(pa.array([0, 200, 210, 260], pa.int32()), pa.StructArray.from_arrays([pa.array([None, *range(259)])], ["t_pos"]))
    lists = pa.RecordBatch.from_arrays([rows, others, pa.array([0.5, 0.7, None])], ["s_rows", "t_rows", "x"])
    monkeypatch.setattr(unfold, "PAIRS", 1000)
    found = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in unfold.unfolded(iter([lists]), ["s_pos", "t_pos", "x"])]
    of = lambda i: [(s["s_pos"], t["t_pos"], lists["x"][i].as_py()) for s in rows[i].as_py() for t in others[i].as_py()]
    assert [x for b in found for x in b] == [*of(0), *of(2)] and len(found) == 2
    side = lambda n: spark.range(40).select(F.col("id").alias(f"{n}_pos"), F.lit("a").alias(f"{n}_base"), (F.col("id") % 3).alias(f"{n}_duration"))
    monkeypatch.setattr(classes, "CELL", 100)
    pairs = classes.class_pairs(side("s"), side("t"), ["base"], ["duration"], ["pos"], {"x": F.col("s_duration") + F.col("t_duration")})
    assert sorted(map(tuple, pairs.collect())) == sorted((i, j, i % 3 + j % 3) for i in range(40) for j in range(40))
    assert "explode(t_rows" not in str(pairs._jdf.queryExecution().optimizedPlan())


def test_pair_scores(spark):
    """The score over arrays is the one over columns, rounded alike: nulls, blanks, no durations and halves at the seventh place."""
    from trackloom.functions import pair_scores

    pick = random.Random(3)
    of = lambda *xs: pick.choice(xs)
    schema = [("pos", "long"), ("nt", "string"), ("album", "string"), ("duration", "int"), ("isrc", "string")]
    made = lambda: [(i, of("x", "y", "", None), of("p", "q", ""), of(None, 0, 100, 104, 108, 109, 112, 113, 200), of(None, None, "c1", "c2")) for i in range(60)]
    sides = {n: made() for n in "st"}
    arrays = {n: {f"{n}_{c}": pa.array([r[k] for r in rows], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]) for k, (c, kind) in enumerate(schema)} for n, rows in sides.items()}
    i, j = np.repeat(np.arange(60), 60), np.tile(np.arange(60), 60)
    artist = np.round((i * 7 + j) % 11 / 11, 3)
    got = pair_scores.strict_and_relaxed(arrays["s"], arrays["t"])(i, j, {"artist": pa.array(artist)})
    s, t = (spark.createDataFrame(sides[n], ", ".join(f"{n}_{c} {kind}" for c, kind in schema)) for n in "st")
    known = {
        "artist": F.round((F.col("s_pos") * 7 + F.col("t_pos")) % 11 / 11, 3),
        "title": F.when((F.col("s_nt") != "") & (F.col("s_nt") == F.col("t_nt")), 1.0).otherwise(0.0),
        "album": F.when((F.col("s_album") == "") | (F.col("t_album") == ""), 0.5).when(F.col("s_album") == F.col("t_album"), 1.0).otherwise(0.0),
        "same": F.col("s_isrc") == F.col("t_isrc"),
    }
    scores = F.round(S.confidence("s", "t", known=known), 6).alias("strict"), F.round(S.confidence("s", "t", False, True, True, known=known), 6).alias("relaxed")
    expected = s.crossJoin(t).select("s_pos", "t_pos", *scores).collect()
    assert {(a, b): (x, y) for a, b, x, y in zip(i.tolist(), j.tolist(), got["strict"].tolist(), got["relaxed"].tolist(), strict=True)} == {(r.s_pos, r.t_pos): (r.strict, r.relaxed) for r in expected}
    halves = [k / 1e6 + 5e-7 for k in range(0, 1_000_000, 4999)] + [0.0, 1.0, 0.9999995, 0.1234565]
    rounded = [r.x for r in spark.createDataFrame(enumerate(halves), "i int, v double").orderBy("i").select(F.round("v", 6).alias("x")).collect()]
    assert pair_scores.r6(np.array(halves)).tolist() == rounded
