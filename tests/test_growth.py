"""Queries on parts and documents against plain versions, and how much they look at."""

import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from linkgraph.plans import linking
from linkgraph.plans.registry import Tables

PART = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def part_table(spark, tmp_path, rows):
    spark.createDataFrame([(*r, 1.0) for r in rows], PART).coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    return Tables(spark, str(tmp_path))


def some_parts(n):
    rng = random.Random(5)
    names = [f"{x} {y}" for x, y in product(("red", "old", "hot"), ("ring", "gear"))] + ["red", "old old", "big red ring"]
    return [(i, rng.choice(names), rng.choice(["B1", "B2", "B2", None]), rng.choice(["T", "T", "U", None]), rng.choice([1, 2, 3, 7, 7, 20, 21, 40, None])) for i in range(n)]


def scores(x, y):
    """brand, size, words of two parts (key, name, brand, type, size)."""
    u, v = set(x[1].split(" ")), set(y[1].split(" "))
    size = 1.0 if x[4] == y[4] else 1 - abs(x[4] - y[4]) / max(x[4], y[4])
    return float(x[2] is not None and x[2] == y[2]), size, len(u & v) / len(u | v)


def pairs_of(rows):
    ok = [r for r in rows if r[3] is not None and r[4] is not None]
    return [(x, y, *scores(x, y)) for x in ok for y in ok if x[0] % 2 == 0 and y[0] % 2 == 1 and x[3] == y[3]]


def test_best_parts_against_all_pairs(spark, tmp_path):
    """Copies, parts without brand, type or size, ties."""
    rows = some_parts(300)
    t = part_table(spark, tmp_path, rows)
    for k in (1, 3):
        by_source = {}
        for x, y, s0, s1, s2 in pairs_of(rows):
            raw = 5 * s0 + 3 * s1 + 8 * s2
            if raw >= linking.CONTEST:
                by_source.setdefault(x[0], []).append((-round(raw, 9), y[0]))
        expected = {(a, b, n + 1) for a, found in by_source.items() for n, (_, b) in enumerate(sorted(found)[:k])}
        got = linking.best_parts(t, linking.CONTEST, k).collect()
        assert {(r["a"], r["b"], r["rank"]) for r in got} == expected and len(got) == len(expected)


def test_best_parts_look_at_the_nearest_sizes(spark, tmp_path, monkeypatch):
    """300 x 300 parts that differ in size alone took 90,000 pairs."""
    t = part_table(spark, tmp_path, [(i, "red ring", "B", "T", 1000 + i) for i in range(600)])
    scored, original = [], linking.score_pairs
    monkeypatch.setattr(linking, "score_pairs", lambda pairs, *args: (scored.append(pairs.count()), original(pairs, *args))[1])
    assert linking.best_parts(t, linking.CONTEST, 2).count() == 600
    assert scored[0] <= 300 * 4


def test_best_guess_against_all_pairs(spark, tmp_path, monkeypatch):
    """no pairs of a whole type are made."""
    rows = some_parts(300)
    by_source = {}
    for x, y, s0, s1, s2 in pairs_of(rows):
        raw = 5 * s0 + 3 * s1 + 8 * s2
        if raw > 2:
            by_source.setdefault(x[0], []).append((-round(raw, 9), y[0]))
    expected = {(a, min(b for _, b in found), min(found)[1]) for a, found in by_source.items()}
    t = part_table(spark, tmp_path, rows)
    monkeypatch.delattr(linking, "part_pairs")
    assert {(r["a"], r["first_by_name"], r["best"]) for r in linking.best_guess(t).collect()} == expected


def test_programs_run_over_brands(spark, tmp_path, monkeypatch):
    """the rows that are filtered are pairs of brands, not of parts."""
    from linkgraph.plans import reports

    rows = [(i, "red ring", f"Brand#{i % 3 * 4 + 1}", "T", 1) for i in range(200)]
    seen, original = [], reports.filter_ranked
    monkeypatch.setattr(reports, "filter_ranked", lambda df, p: (seen.append(df.count()), original(df, p))[1])
    got = {r["program"]: (r["n"], r["sum_a"]) for r in reports.rpn_filter(part_table(spark, tmp_path, rows)).collect()}
    pairs = [(x[0], x[2], y[2]) for x in rows for y in rows if x[0] % 2 == 0 and y[0] % 2 == 1]
    tests = {1: lambda a, b: "Brand#5" in b, 2: lambda a, b: a != b, 3: lambda a, b: b == "Brand#13" or b.startswith("Brand#2"), 4: lambda a, b: True, 5: lambda a, b: True}
    expected = {k: [a for a, x, y in pairs if f(x, y)] for k, f in tests.items()}
    assert got == {k: (len(v), sum(v)) for k, v in expected.items() if v} and max(seen) <= 9


def test_jaccard_candidates_against_all_pairs(spark):
    """sets of common words alone, which all met before, and all pairs that are similar."""
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(60)]
    sets = [rng.sample(vocabulary, rng.choice([1, 5, 8, 9, 20, 30, 31])) for _ in range(120)]
    sets += [s[rng.randrange(3):] + rng.sample(["x", "y", "z"], rng.randrange(3)) for s in sets if len(s) > 4]
    sets = sorted({tuple(sorted(s)) for s in sets})
    rows = [(i % 2, "en" if i % 5 else None, i, list(s), 1, len(s)) for i, s in enumerate(sets)]
    classes = spark.createDataFrame(rows, "side bigint, lang string, id bigint, words array<string>, n bigint, size int")
    similar = lambda x, y, least: len(set(x) & set(y)) >= least * len(set(x) | set(y))
    for least in (0.88, 0.6):
        expected = {(x[2], y[2]) for x in rows for y in rows if x[0] == 0 and y[0] == 1 and x[1] == y[1] == "en" and similar(x[3], y[3], least)}
        got = [(r["a"], r["b"]) for r in linking.jaccard_candidates(classes, least).collect()]
        assert set(got) == expected and len(got) == len(expected) and expected


def test_jaccard_candidates_are_few(spark, monkeypatch):
    """200 x 200 sets of 40 of 80 words share rare words in nearly every pair."""
    rng = random.Random(2)
    vocabulary = [f"w{i}" for i in range(80)]
    rows = [(i % 2, "en", i, sorted(rng.sample(vocabulary, 40)), 1, 40) for i in range(400)]
    kept, original = [], linking.keep
    monkeypatch.setattr(linking, "keep", lambda df: (lambda out: (kept.append(out.count()), out)[1])(original(df)))
    linking.jaccard_candidates(spark.createDataFrame(rows, "side bigint, lang string, id bigint, words array<string>, n bigint, size int"), 0.88).collect()
    assert kept[0] < 4_000


@pytest.mark.parametrize("most", [500_000, 10])
def test_all_pairs_are_spread_over_tasks(spark, tmp_path, monkeypatch, most):
    """One type is not one task, with the second side broadcast or not."""
    monkeypatch.setattr(linking, "PAIRS_A_TASK", 500)
    monkeypatch.setattr(linking, "BROADCAST_ROWS", most)
    rows = [(i, n, b or "B0", "T", s or 9) for i, n, b, _, s in some_parts(200)]
    t = part_table(spark, tmp_path, rows)
    got = linking.user_scorer(t)
    assert {(r["a"], r["b"], r["raw"]) for r in got.collect()} == {(x[0], y[0], round(5 * s0 + 5 * s1 + 8 * s2, 6)) for x, y, s0, s1, s2 in pairs_of(rows)}
    assert got.groupBy(F.spark_partition_id()).count().count() > 10


def test_part_fixpoint_against_all_pairs(spark, tmp_path):
    """copies, parts without brand, type or size, contested targets."""
    from linkgraph.plans import reports

    rows = some_parts(300)
    pairs = [(x[0], y[0], 5 * s0 + 3 * s1 + 8 * s2) for x, y, s0, s1, s2 in pairs_of(rows)]
    expected = {}
    while True:
        by_source, chosen = {}, {}
        for a, b, raw in pairs:
            if raw >= linking.CONTEST and a not in expected and b not in expected.values():
                by_source.setdefault(a, []).append((raw / 16) ** 2)
                chosen.setdefault(a, []).append((-raw, b))
        best = {a: min(chosen[a])[1] for a, found in by_source.items() if max(found) >= 0.3 and sorted([0, *found])[-2] < max(found) * (1 - 0.085)}
        fresh = {a: b for a, b in best.items() if list(best.values()).count(b) == 1}
        if not fresh:
            break
        expected |= fresh
    got = reports.auto_match_fixpoint(part_table(spark, tmp_path, rows)).collect()
    assert {r["a"]: r["b"] for r in got} == expected and len(got) == len(expected) and expected


def test_part_fixpoint_takes_copies_once(spark, tmp_path, monkeypatch):
    """200 x 200 copies were 40,000 pairs in each round."""
    from linkgraph.plans import reports

    rows = [(i, "red ring", "B", "T", 7) for i in range(400)] + [(1000, "old gear", "B", "T", 7), (1001, "old gear", "B", "T", 7)]
    seen, original = [], reports.accept
    monkeypatch.setattr(reports, "accept", lambda scored, *args, **more: (seen.append(scored.count()), original(scored, *args, **more))[1])
    assert [tuple(r) for r in reports.auto_match_fixpoint(part_table(spark, tmp_path, rows)).collect()] == [(1000, 1001)]
    assert max(seen) < 10


def test_perfect_match_against_all_pairs(spark, tmp_path, monkeypatch):
    """copies are counted, not paired."""
    rows = some_parts(300) + [(i, "red ring", "B", "T", 7) for i in range(1000, 1300)] + [(2000, "hot old", "B1", "T", 1), (2001, "old hot", "B1", "T", 9)]
    perfect = [(x[0], y[0]) for x, y, s0, _, s2 in pairs_of([r[:4] + (r[4] or 1,) for r in rows]) if s0 == s2 == 1]
    once = {p for p in perfect if sum(a == p[0] for a, _ in perfect) == 1}
    expected = {p for p in once if sum(b == p[1] for _, b in once) == 1}
    scored, original = [], linking.perfect
    monkeypatch.setattr(linking, "perfect", lambda df, *args: (scored.append(df.count()), original(df, *args))[1])
    assert {(r["a"], r["b"]) for r in linking.perfect_match(part_table(spark, tmp_path, rows)).collect()} == expected and (2000, 2001) in expected
    assert scored[0] < 300


def test_pruned_pairs_against_all_pairs(spark, tmp_path, monkeypatch):
    """the pairs of one class are spread over tasks."""
    monkeypatch.setattr(linking, "PAIRS_A_TASK", 500)
    rows = some_parts(200) + [(i, "red ring", "B", "T", 7) for i in range(1000, 1200)]
    got = linking.pruned_rank_parts(part_table(spark, tmp_path, rows))
    expected = [(x[0], y[0], round(5 * s0 + 3 * s1 + 8 * s2, 6)) for x, y, s0, s1, s2 in pairs_of(rows)]
    assert sorted(map(tuple, got.collect())) == sorted(p for p in expected if 16 - p[2] < linking.BOUND16)
    assert got.groupBy(F.spark_partition_id()).count().count() > 10


def test_signature_tokens_are_found_once(spark):
    """each token asked for all tokens again."""
    from linkgraph.functions import signatures

    df = spark.createDataFrame([("<T:La/O;>Lx<TT;>;", "<Q:La/O;>Lx<TQ;>;")], "a string, b string")
    plan = df.select(signatures.same_structure(F.col("a"), F.col("b")).alias("v"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all") == 2


def test_descriptor_parts_without_names_meet_nothing(spark, monkeypatch):
    """primitive types and parentheses were null keys of the join with the names, and so one task's."""
    from linkgraph.functions.descriptors import translate

    df = spark.createDataFrame([("(ILa;[La;J)V",), ("(Lb;)La;",), ("()V",), ("(Lc;)V",), (None,)], "descriptor string")
    names = spark.createDataFrame([("a", "x/A"), ("b", "x/B"), ("c", None)], "class_name string, name string")
    nulls, original = [], type(df).join
    monkeypatch.setattr(type(df), "join", lambda self, other, on=None, how=None: (nulls.append(self.where("inner is null").count()) if on == "inner" else None, original(self, other, on, how))[1])
    got = {r["descriptor"]: r["translated"] for r in translate(df, names).collect()}
    assert got == {"(ILa;[La;J)V": "(ILx/A;[Lx/A;J)V", "(Lb;)La;": "(Lx/B;)Lx/A;", "()V": "()V", "(Lc;)V": None}
    assert nulls == [0]


def test_bodies_of_equal_sizes_are_aligned_at_once(monkeypatch):
    """each pair had edit tables and numpy calls of its own."""
    import pyarrow as pa

    from linkgraph.functions import instructions as ins
    from linkgraph.functions.similarity import edit_costs, partners

    rng = random.Random(3)
    kinds = [*ins.STRICT, "dynamic", "var", "inc", "op", None]
    one = lambda: {"op": rng.randrange(3), "kind": rng.choice(kinds), "num": rng.choice([None, 0, 1]), "ref": rng.choice([None, "r", "s"]), "type": rng.choice([None, "t"]), "keys": rng.choice([None, [], [None], [1], [1, 2]])}
    a, b = ([None if rng.random() < 0.1 else [one() for _ in range(rng.randrange(4))] for _ in range(400)] for _ in "ab")
    of = pa.list_(pa.struct([("op", pa.int32()), ("kind", pa.string()), ("num", pa.int64()), ("ref", pa.string()), ("type", pa.string()), ("keys", pa.list_(pa.int64()))]))
    calls, original = [], ins.edit_tables
    monkeypatch.setattr(ins, "edit_tables", lambda costs: (calls.append(len(costs)), original(costs))[1])
    batch = (pa.array(a, of)[5:], pa.array(b, of)[5:])
    scores, places = (next(f.func(iter([batch]))).to_pylist() for f in (ins.code_similarity, ins.code_alignment))
    for x, y, score, place in zip(a[5:], b[5:], scores, places, strict=True):
        if x is None or y is None:
            assert score is None and place is None
        elif x and y:
            table = ins.cost_table(x, y)
            assert score == 1 - edit_costs(table)[-1, -1] / (2 * max(len(x), len(y))) and place == partners(table)
        else:
            assert score == float(not x and not y) and place == [-1] * len(x)
    assert len(calls) == 9


@pytest.mark.parametrize("hub", [0, 5000])
def test_edges_of_a_hub_are_spread(spark, monkeypatch, hub):
    """all edges of the least node of a large component met in one task; copies of an edge's end do not, either."""
    from linkgraph.operators import graphs

    monkeypatch.setattr(graphs, "EDGES_A_TASK", 100)
    rows = [(hub, v) for v in range(1, 4000)] + [(v, hub) for v in range(1, 4000)] + [(7000 + i, 7001 + i) for i in range(50)]
    edges = spark.createDataFrame(rows, "a bigint, b bigint")
    expected = {v: min(hub, 1) for v in (hub, *range(1, 4000))} | {7000 + i: 7000 for i in range(51)}
    assert {r["node"]: r["comp"] for r in graphs.components(edges).collect()} == expected
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        few = F.col("a") >= 7000
        pairs = edges.where(few | (F.col("a") == hub)).select(F.col("a").alias("u"), F.when(few, F.col("b")).otherwise(1).alias("v"), F.col("b").alias("of"))
        found = graphs._with_least(pairs).where(F.col("u") == hub).select("u", "v", "least")
        assert found.distinct().collect() == [(hub, 1, min(hub, 1))]
        sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 3999 and max(sizes) < 2500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_soft_sets_against_plain_version(spark):
    """both sides meet in sums; shared, matched and lost elements, several kinds, nulls, pairs with one side."""
    from linkgraph.operators.sets import soft_sets

    rng = random.Random(7)
    side = lambda most: {(p, rng.choice([None, *range(9)]), rng.choice(["x", "y", None])) for p in range(25) for _ in range(rng.randrange(most))}
    left, right, partner = side(7), side(7), {1: 2, 3: 4, 5: 5, 6: 1}
    expected = {}
    for p in {r[0] for r in left | right}:
        a, b = ([r[1:] for r in s if r[0] == p] for s in (left, right))
        has = lambda e, s: e is not None and any(x == e for x, _ in s)
        a1, b1 = [r for r in a if not has(r[0], b)], [r for r in b if not has(r[0], a)]
        met = {partner[e] for e, _ in a1 if e in partner and has(partner[e], b1)}
        against = sum(1 for e, _ in a1 if e in partner and partner[e] not in met)
        a3, b3 = [k for e, k in a1 if e not in partner], [k for e, k in b1 if e not in met]
        against += sum(k is None or k not in b3 for k in a3) + sum(k is None or k not in a3 for k in b3)
        expected[p] = (len(a) + len(b) - against) / (len(a) + len(b)) if a and b else 0.0
    frame = lambda s: spark.createDataFrame(sorted(s, key=str) * 2, "pair int, elem bigint, kind string")
    matches = spark.createDataFrame(list(partner.items()), "a bigint, b bigint")
    assert {r["pair"]: r["score"] for r in soft_sets(frame(left), frame(right), matches).collect()} == pytest.approx(expected)
    both = {r[0] for r in left} & {r[0] for r in right}
    got = {r["pair"]: r["score"] for r in soft_sets(frame(left), frame(right), matches, one_sided=False).collect()}
    assert got == pytest.approx({p: s for p, s in expected.items() if p in both}) and 0 < len(got) < len(expected)


def test_relations_join_lines_once(spark):
    """the result joined the lines again for each side, relation and test of one."""
    from linkgraph.plans import QUERIES

    plan = QUERIES["relation_set_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_linenumber" not in plan and plan.count("Join") <= 12


def test_staged_rows_arrive_in_as_many_files_as_tasks(spark, tmp_path, monkeypatch):
    """four tasks wrote all rows, whatever their number; they still arrive in four parts."""
    from linkgraph.plans import QUERIES, reports

    monkeypatch.setattr(reports, "work_dir", lambda spark, name: f"{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "10")
    try:
        QUERIES["staged_extraction"](spark, "/root/testdata/sf0.001").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(list(tmp_path.glob("stages/in/*.parquet"))) == 12
    assert {p.name for p in tmp_path.glob("stages/updates/*")} == {f"batch={n}" for n in range(-1, 4)}


def test_leaves_that_follow_each_other_are_one_step(spark, monkeypatch):
    """F32: the list that is ranked held two events of each node; forests with leaves between inner nodes, at block ends and as roots."""
    from linkgraph.operators import forest

    rng = random.Random(3)
    parent = {n: rng.choice([None, *range(max(0, n - 30), n, 4)]) if n % 9 else None for n in range(120)}
    nodes = spark.createDataFrame(list(parent.items()), "node bigint, parent bigint")
    first, below = {}, {}

    def visit(node, depth):
        start = len(first) + 1
        first[node] = (start, depth)
        for child in sorted(c for c, p in parent.items() if p == node):
            visit(child, depth + 1)
        below[node] = len(first) - start + 1

    for root in sorted(n for n, p in parent.items() if p is None):
        visit(root, 0)
    for bits in (1, 3, 12):
        monkeypatch.setattr(forest, "RUN_BITS", bits)
        got = forest.labels(nodes, []).collect()
        assert len(got) == 120 and {r["node"]: (r["first"], r["size"], r["depth"]) for r in got} == {n: (first[n][0], below[n], first[n][1]) for n in parent}
    events, original = [], forest.stored
    monkeypatch.setattr(forest, "stored", lambda df, name: (events.append(df.count()), original(df, name))[1])
    star = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, 0).cast("bigint").alias("parent"))
    assert forest.labels(star, []).where("size = 3000 and first = 1 or size = 1 and depth = 1").count() == 3000
    assert max(events) < 20


def test_small_rounds_of_components_know_no_hubs(spark, monkeypatch):
    """pipeline: every round of three calls joined hubs that few edges cannot have, and the driver held the plans."""
    from linkgraph.operators import graphs

    asked, original = [], F.broadcast
    monkeypatch.setattr(graphs.F, "broadcast", lambda df: (asked.append(1), original(df))[1])
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    expected = {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert {r["node"]: r["comp"] for r in graphs.components(edges).collect()} == expected and not asked
    monkeypatch.setattr(graphs, "EDGES_A_TASK", 20)
    assert {r["node"]: r["comp"] for r in graphs.components(edges).collect()} == expected and asked


def class_pass(customers, orders, methods, maximum):
    """The class pass of the automatic matching over all pairs."""
    n, urgent, owner, hits = {}, {}, {}, {}
    for o, c, p in orders:
        n[c], urgent[c], owner[o] = n.get(c, 0) + 1, urgent.get(c, 0) + (p == "1-URGENT"), c
    for x, y in methods:
        hits[owner[x], owner[y]] = hits.get((owner[x], owner[y]), 0) + 1
    ratio = lambda x, y: 1.0 if x == y else 1 - abs(x - y) / max(x, y)
    chosen = {}
    for a, na, sa, va in customers:
        scores = []
        for b, nb, sb, vb in customers:
            if a % 2 or not b % 2 or na != nb or n.get(a, 0) != n.get(b, 0):
                continue
            raw = 5 * (sa == sb) + 8 * ratio(va, vb) + 4 * ratio(urgent.get(a, 0), urgent.get(b, 0))
            if maximum == 23:
                raw += 6 * (hits.get((a, b), 0) / n[a] if a in n else 1)
            scores.append((-round(raw, 9), b))
        best = [((raw / maximum) ** 2, b) for raw, b in sorted(scores)[:2]]
        if best and best[0][0] >= 0.5 and (len(best) < 2 or best[1][0] < best[0][0] * (1 - 0.085)):
            chosen.setdefault(best[0][1], []).append(a)
    return {(a[0], b) for b, a in chosen.items() if len(a) == 1}


def test_class_passes_take_two_of_those_alike(spark, tmp_path, monkeypatch):
    """each class of a group of copies asked and was asked for, and passes that matched nothing were run again."""
    from linkgraph.operators import automatch
    from linkgraph.plans import matching

    rng = random.Random(3)
    customers = [(c, rng.randrange(2), rng.choice("AB"), rng.choice([10, 30, 90, 270, 800, 2400, 7000])) for c in range(80)] + [(c, 7, "A", 50) for c in range(100, 300)]
    orders = [(i, rng.randrange(80), rng.choice(["1-URGENT", "2-HIGH"])) for i in range(70)]
    methods = [(x, y) for (x, c, _), (y, d, _) in zip(orders[:30], orders[30:60]) if c % 2 == 0 and d % 2]
    spark.createDataFrame([(c, n, s, float(v)) for c, n, s, v in customers], "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(o, c, "F", 1.0, p) for o, c, p in orders], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    t = Tables(spark, str(tmp_path))
    asked, original = [], automatch.score_pairs
    monkeypatch.setattr(automatch, "score_pairs", lambda pairs, *args, **more: (asked.append(pairs.where("a >= 100").count()), original(pairs, *args, **more))[1])
    classes, members, variables = matching.kinds(t)
    for level, maximum, given in (("initial", 17, []), ("intermediate", 23, methods)):
        state = matching.nothing(t) | {"methods": spark.createDataFrame(given, "a bigint, b bigint")}
        automatch.match_pass(classes, level, state, **matching.THRESHOLDS)
        expected = class_pass(customers, orders, given, maximum)
        assert expected and {tuple(r) for r in state["classes"].collect()} == expected
    assert max(asked) <= 4
    passes = []
    monkeypatch.setattr(automatch, "match_pass", lambda kind, level, *args, **more: passes.append((kind.name, level)))
    automatch.auto_match(classes, members, variables, matching.nothing(t), **matching.THRESHOLDS)
    assert [p for p in passes if p[0] == "classes"] == [("classes", "initial"), ("classes", "intermediate")]


def test_cascade_meets_members_of_matches_once(spark, monkeypatch):
    """the members of older matches were joined for clearing, groups, pairs of groups and the matches themselves."""
    from linkgraph.operators import cascade

    def side(s):
        classes = spark.createDataFrame([(f"{s}{i}", None, 0) for i in range(3)], "cls string, element string, dims int")
        rows = [(f"{s}{i}.{m}", f"{s}{i}", "field" if m == "f" else "method", m, m, False, f"{s}{i}" if m == "g" else f"{s}.{m}") for i in range(3) for m in "fgh"]
        return cascade.Side(classes, spark.createDataFrame(rows, "member string, owner string, kind string, id string, name string, obfuscated boolean, group string"), spark.createDataFrame([], "variable string, method string, is_arg boolean"))

    pairs = lambda *rows: spark.createDataFrame(rows, "a string, b string")
    before = cascade.Matches(pairs(("a0", "b1"), ("a2", "b2")), pairs(("a0.g", "b1.g"), ("a2.g", "b2.g"), ("gone", "b9.g")), pairs(("a0.f", "b1.f"), ("a2.f", "b2.f")), spark.createDataFrame([], "a string, b string"))
    met, original = [], cascade.owners_of
    monkeypatch.setattr(cascade, "owners_of", lambda p, x, y, child, *more: (met.append(child), original(p, x, y, child, *more))[1])
    after = cascade.match_classes(pairs(("a0", "b0")), side("a"), side("b"), before)
    got = {k: {tuple(r) for r in getattr(after, k).collect()} for k in ("classes", "methods", "fields")}
    assert got == {"classes": {("a0", "b0"), ("a2", "b2")}, "methods": {("a0.g", "b0.g"), ("a2.g", "b2.g"), ("a0.h", "b0.h"), ("a2.h", "b2.h")}, "fields": {("a0.f", "b0.f"), ("a2.f", "b2.f")}}
    assert met.count("member") <= 1


def test_entities_are_kept_once(spark, tmp_path, monkeypatch):
    """names of all entities were written beside their numbers, and all rows of a match file were in Python at once."""
    from linkgraph.plans import transfers
    from linkgraph.sources import matchfile

    spark.createDataFrame([(c, 1, "S", 1.0) for c in range(4)], "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(o, o % 4, "F", "1-URGENT") for o in range(8)], "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(o, i) for o in range(8) for i in (1, 2, 3)], "l_orderkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept, original = [], transfers.keep
    monkeypatch.setattr(transfers, "keep", lambda df: (kept.append(df.columns), original(df))[1])
    known, matched = transfers.entities(Tables(spark, str(tmp_path)))
    assert not [c for c in kept if "class_id" in c or "a_class" in c]
    assert known.variables.count() == 24 and {tuple(r) for r in matched["classes"].collect()} == {("c0", "c1"), ("c2", "c3")}
    assert matched["members"].count() == 2 and matched["variables"].count() == 6
    monkeypatch.setattr(matchfile, "PARSED_ROWS", 2)
    lines = "\n".join([f"{matchfile.HEAD}now, input files:", "c\tx\ty", *[f"\tm\tm{i}\tn{i}" for i in range(5)]])
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "f.txt").write_text(lines)
    assert {r.a_member for r in matchfile.read_matches(spark, f"{tmp_path}/one").collect()} == {None, *[f"m{i}" for i in range(5)]}
    read = list(matchfile.batched(matchfile.parse(lines), 2))
    assert [len(r) for r in read] == [2, 2, 2]


def odd_parts(n):
    """With parts without a name and words that come twice."""
    return [(i, None if i % 11 == 0 else name, *rest) for i, name, *rest in some_parts(n)]


def sql_rows(t, name):
    import duckdb

    from linkgraph.plans.registry import ORACLES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW part AS SELECT * FROM '{t.sf_dir}/part.parquet/*.parquet'")
    return con.sql(ORACLES[name]).fetchall()


def by_text(rows):
    return sorted(map(str, (tuple(r) for r in rows)))


def test_score_breakdown_writes_scores_once(spark, tmp_path, monkeypatch):
    """F2: the scores of 10,000 pairs were written out for each pair; parts without a size or name had the text null."""
    t = part_table(spark, tmp_path, odd_parts(200))
    scored, original = [], linking.score_pairs
    monkeypatch.setattr(linking, "score_pairs", lambda pairs, *args, **more: (scored.append(pairs.count()), original(pairs, *args, **more))[1])
    assert by_text(linking.score_breakdown(t).collect()) == by_text(sql_rows(t, "score_breakdown"))
    assert max(scored) < 400


@pytest.mark.parametrize("finding", ["F3 similarity_bucket", "F4 user_scorer"])
@pytest.mark.parametrize("looked_up", [200_000, 0])
def test_all_pairs_copy_few_rows(spark, tmp_path, monkeypatch, finding, looked_up):
    """Beyond a broadcast each row of b was copied for as many slices as there were tasks or twentieths of a: 26 times."""
    for name, value in (("PAIRS_A_TASK", 500), ("BROADCAST_ROWS", 300), ("COPIES", 4), ("LOOKED_UP", looked_up)):
        monkeypatch.setattr(linking, name, value, raising=False)
    name = finding.split()[1]
    t = part_table(spark, tmp_path, [(i, n, b, "T", s) for i, n, b, _, s in odd_parts(1000)])
    dealt, original = [], type(t.part).repartition

    def counted(df, *args):
        members = [c for c in df.columns if c.startswith("cells_")]
        dealt.append(df.select(F.explode(members[0]).alias("x")).agg(F.sum(F.size("x.members"))).first()[0] if members else df.count())
        return original(df, *args)

    monkeypatch.setattr(type(t.part), "repartition", counted)
    got = getattr(linking, name)(t)
    assert sum(dealt) < 7_000
    assert by_text(got.collect()) == by_text(sql_rows(t, name))


@pytest.mark.parametrize("most", [500_000, 10])
def test_all_targets_are_ranked_once_a_list(spark, tmp_path, monkeypatch, most):
    """each task sorted its pairs, and beyond a broadcast b was copied for each task; copies, ties, nulls."""
    from linkgraph.operators import members

    monkeypatch.setattr(linking, "PAIRS_A_TASK", 500)
    monkeypatch.setattr(linking, "BROADCAST_ROWS", most)
    monkeypatch.setattr(members, "ROWS", 7)
    t = part_table(spark, tmp_path, odd_parts(200) + [(i, "red ring", "B1", "T", 7) for i in range(1000, 1040)])
    got = linking.weighted_rank_parts(t)
    assert by_text(got.collect()) == by_text(sql_rows(t, "weighted_rank_parts"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "raw#" not in "".join(line for line in plan.splitlines() if "Window" in line)


def test_rows_that_are_not_together_are_not_ranked():
    """a list of sources that meets only some of its targets in a task would get wrong ranks."""
    import numpy as np
    import pyarrow as pa

    from linkgraph.operators.members import Looked, rank_all

    table = np.arange(2.0).reshape(2, 1, 1, 1)
    looked = Looked(np.array([7]), np.array([1.0]), np.array([7]), (table, table))
    batch = pa.RecordBatch.from_pylist([{"left": 2, "rows_b": 2, "j": 1.0, "members_a": [{"key": 2, "size": 7, "brand": 0}], "members_b": [{"key": k, "size": 7, "brand": k} for k in keys]} for keys in ([1], [0])])
    assert [r.to_pydict() for r in rank_all(looked)(iter([batch]))] == [{"a": [2, 2], "b": [0, 1], "raw": [1.0, 0.0], "rank": [1, 2]}]
    with pytest.raises(ValueError, match="1 of 2 targets"):
        list(rank_all(looked)(iter([batch.slice(1)])))


def test_word_sets_are_hashed_where_they_lie(spark, tmp_path):
    """a row of some 100 bytes for each part of each set was shuffled to hash the part, and sets as arrays of strings."""
    rng = random.Random(4)
    texts = [" ".join(rng.sample([f"{x}{y}{z}" for x, y, z in product("abcdefgh", repeat=3)], 100)) for _ in range(300)]
    rows = [(i, x, "en") for i, x in enumerate(y for x in texts for y in (x, x.replace("aaa", "bbb")))] + [(600, None, "en"), (601, " .", "en"), (602, "Aaa", None), (603, "aaa", None)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Tables(spark, str(tmp_path))
    classes = linking.token_classes(t)
    plan = classes._jdf.queryExecution().executedPlan().toString()
    assert "array" not in "".join(line for line in plan.splitlines() if "Exchange" in line) and "hashpartitioning(side" in plan
    shuffled, original = [], type(classes).groupBy
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(type(classes), "groupBy", lambda df, *keys: (shuffled.append(keys), original(df, *keys))[1])
        got = linking.jaccard_candidates(linking.keep(classes), 0.88)
    assert not any(shuffled)
    sets = {r[0]: frozenset(w for w in (r[1] or "").lower().split() if w.isalpha()) for r in rows if r[2]}
    first = {}
    for i in sorted(sets):
        first.setdefault((i % 2, sets[i]), i)
    ids = [i for (_, words), i in first.items() if words]
    expected = {(a, b) for a in ids for b in ids if a % 2 == 0 and b % 2 == 1 and len(sets[a] & sets[b]) >= 0.88 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in got.collect()} == expected and expected
