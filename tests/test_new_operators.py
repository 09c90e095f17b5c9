"""Interval joins, components of long chains, and further operators against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from linkgraph.operators import graphs, intervals


@pytest.mark.parametrize("bin_probes", [4096, 5])
def test_overlapping_intervals(spark, monkeypatch, bin_probes):
    """Nested, touching, empty, null, very short and very long ranges; one key holds most rows."""
    monkeypatch.setattr(intervals, "BIN_PROBES", bin_probes)
    rng = random.Random(4)

    def ranges(n):
        out = []
        for i in range(n):
            start = rng.randrange(-500, 2000)
            out.append((i, rng.choice(["a", "a", "a", "b", None]), start, start + rng.choice([0, 1, 2, 7, 64, 65, 300, 5000])))
        return out + [(n, "a", None, 5), (n + 1, "a", 5, None), (n + 2, "b", -(10**15), 10**15)]

    x, y = ranges(150), ranges(120)
    schema = "id bigint, k string, start bigint, end bigint"
    got = intervals.overlapping(spark.createDataFrame(x, schema), spark.createDataFrame(y, schema), ["k"])
    found = [(r["interval"]["id"], r["probe"]["id"]) for r in got.collect()]
    ok = lambda r: r[1] is not None and r[2] is not None and r[3] is not None and r[3] > r[2]
    expected = [(p[0], q[0]) for p in x for q in y if ok(p) and ok(q) and p[1] == q[1] and p[2] < q[3] and q[2] < p[3]]
    assert sorted(found) == sorted(expected) and len(found) == len(set(found))


def test_components_of_a_long_chain(spark, monkeypatch):
    """100,000 nodes in random order in at most 25 rounds, each of which writes its edges once."""
    order = list(range(100_000))
    random.Random(3).shuffle(order)
    rounds, original = [], graphs.stored
    monkeypatch.setattr(graphs, "stored", lambda *args: (rounds.append(1), original(*args))[1])
    found = graphs.components(spark.createDataFrame(list(zip(order, order[1:])), "a bigint, b bigint"))
    assert found.count() == 100_000 and found.where("comp <> 0").isEmpty() and len(rounds) <= 25


def test_components_against_union_find(spark):
    rng = random.Random(8)
    edges = [(f"n{rng.randrange(300)}", f"n{rng.randrange(300)}") for _ in range(220)] + [("hub", f"n{i}") for i in range(0, 90, 3)] + [(None, "n1"), ("n2", None), ("loop", "loop"), ("n5", "n6"), ("n5", "n6")]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = {r.node: r.comp for r in graphs.components(spark.createDataFrame(edges, "x string, y string"), "x", "y").collect()}
    assert got == {n: root(n) for n in parent}
    assert graphs.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- matches with what follows from them ----------------------------------------------------------

CLASS = "cls string, element string, dims int"
MEMBER = "member string, owner string, kind string, id string, name string, obfuscated boolean, `group` string"
VARIABLE = "variable string, method string, is_arg boolean"


@pytest.fixture(scope="module")
def sides(spark):
    from linkgraph.operators.cascade import Side

    def side(s, hidden, groups):
        classes = [(f"{s}{c}", None, 0) for c in "PQR"] + [(f"[{s}{c}", f"{s}{c}", 1) for c in "PQ"] + [(f"[[{s}P", f"{s}P", 2)]
        members = [(f"{s}{c}.{m}", f"{s}{c}", "method", f"{m}()", m, m in hidden, groups.get((c, m), f"{s}{c}.{m}")) for c in "PQR" for m in ("f", "g", "h")]
        members += [(f"{s}{c}.x", f"{s}{c}", "field", "x;;I", "x", False, None) for c in "PQR"]
        members += [(f"{s}R.{m}", f"{s}R", "method", f"{m}({d})", m.rstrip("12"), False, f"{s}R.{m}") for m, d in (("k1", "I"), ("k2", "J"))]
        variables = [(f"{s}{c}.{m}:{i}", f"{s}{c}.{m}", i < 2) for c in "PQR" for m in ("f", "h") for i in range(3)]
        return Side(spark.createDataFrame(classes, CLASS), spark.createDataFrame(members, MEMBER), spark.createDataFrame(variables, VARIABLE))

    # f is readable; g is hidden and shared by P and Q; h is hidden and alone
    return side("a", {"g", "h"}, {("P", "g"): "aG", ("Q", "g"): "aG"}), side("b", {"g", "h"}, {("P", "g"): "bG", ("Q", "g"): "bG"})


def matched(spark, classes=(), methods=(), fields=(), variables=()):
    from linkgraph.operators.cascade import Matches

    return Matches(*[spark.createDataFrame(list(p), "a string, b string") for p in (classes, methods, fields, variables)])


def pairs_of(df):
    return sorted((r["a"], r["b"]) for r in df.collect())


def test_match_classes_with_all_that_follows(spark, sides):
    from linkgraph.operators import cascade

    a, b = sides
    before = matched(spark, [("aP", "bR"), ("aQ", "bQ")], [("aP.f", "bR.f"), ("aP.h", "bR.h"), ("aQ.g", "bQ.g"), ("aQ.h", "bQ.h")], [("aP.x", "bR.x")], [("aP.h:0", "bR.h:0"), ("aQ.h:2", "bQ.h:2")])
    after = cascade.match_classes(spark.createDataFrame([("[aP", "[bP"), ("aP", "bP"), ("[[aP", "[bQ")], "a string, b string"), a, b, before)
    assert pairs_of(after.classes) == [("[[aP", "[[bP"), ("[aP", "[bP"), ("aP", "bP"), ("aQ", "bQ")]  # unequal dimensions are left out
    # f by its name; g with its group, which Q has matched; h loses its match with R; x again by its id
    assert pairs_of(after.methods) == [("aP.f", "bP.f"), ("aP.g", "bP.g"), ("aQ.g", "bQ.g"), ("aQ.h", "bQ.h")]
    assert pairs_of(after.fields) == [("aP.x", "bP.x")]
    assert pairs_of(after.variables) == [("aQ.h:2", "bQ.h:2")]


def test_an_array_takes_its_element_along(spark, sides):
    from linkgraph.operators import cascade

    a, b = sides
    after = cascade.match_classes(spark.createDataFrame([("[aP", "[bQ")], "a string, b string"), a, b, matched(spark))
    assert pairs_of(after.classes) == [("[aP", "[bQ"), ("aP", "bQ")]
    taken = cascade.match_classes(spark.createDataFrame([("[aP", "[bQ")], "a string, b string"), a, b, matched(spark, [("aP", "bR")]))
    assert pairs_of(taken.classes) == [("[aP", "[bQ"), ("aP", "bR")]
    nothing = cascade.match_classes(spark.createDataFrame([], "a string, b string"), a, b, matched(spark, [("aP", "bR")]))
    assert pairs_of(nothing.classes) == [("aP", "bR")]


def test_names_without_alternatives(spark, sides):
    """k1 and k2 share a name, so only equal ids match; owners must be matched, arguments go with arguments."""
    from linkgraph.operators import cascade

    a, b = sides
    after = cascade.match_classes(spark.createDataFrame([("aR", "bR")], "a string, b string"), a, b, matched(spark))
    assert pairs_of(after.methods) == [("aR.f", "bR.f"), ("aR.k1", "bR.k1"), ("aR.k2", "bR.k2")]
    asked = lambda *p: spark.createDataFrame(list(p), "a string, b string")
    moved = cascade.match_methods(asked(("aR.h", "bR.g"), ("aP.f", "bR.f")), a, b, after)
    assert ("aR.h", "bR.g") in pairs_of(moved.methods) and ("aR.f", "bR.f") in pairs_of(moved.methods)
    inside = cascade.match_variables(asked(("aR.f:0", "bR.f:1"), ("aR.f:2", "bR.f:0"), ("aR.h:2", "bR.h:2")), a, b, moved)
    assert pairs_of(inside.variables) == [("aR.f:0", "bR.f:1")]
    assert pairs_of(cascade.match_fields(asked(("aP.x", "bP.x"), ("aR.x", "bR.x")), a, b, matched(spark, [("aR", "bR")])).fields) == [("aR.x", "bR.x")]


def test_unmatching(spark, sides):
    from linkgraph.operators import cascade

    a, b = sides
    before = matched(spark, [("aP", "bP"), ("[aP", "[bP"), ("aQ", "bQ")], [("aP.g", "bP.g"), ("aQ.g", "bQ.g"), ("aQ.h", "bQ.h")], [("aP.x", "bP.x")], [("aQ.h:0", "bQ.h:0")])
    after = cascade.unmatch_classes(spark.createDataFrame([("[aP",)], "a string"), a, b, before)
    assert pairs_of(after.classes) == [("aQ", "bQ")] and pairs_of(after.fields) == []
    assert pairs_of(after.methods) == [("aQ.g", "bQ.g"), ("aQ.h", "bQ.h")] and pairs_of(after.variables) == [("aQ.h:0", "bQ.h:0")]
    group = cascade.unmatch_methods(spark.createDataFrame([("aP.g",)], "a string"), a, b, before)
    assert pairs_of(group.methods) == [("aQ.h", "bQ.h")]
    given_a, given_b = cascade.give_uids(spark.createDataFrame([("aQ.g", 7), ("aP.g", 3), ("aP.f", 1)], "member string, uid int"), a, b, before)
    assert sorted(map(tuple, given_a.collect())) == [("aP.f", 1), ("aP.g", 3), ("aQ.g", 3)]
    assert sorted(map(tuple, given_b.collect())) == [("bP.g", 3), ("bQ.g", 3)]


# -- match files and entities, descriptors ------------------------------------------------------------


def known_of(spark, classes, members, variables):
    from linkgraph.sources.matchstate import Known

    return Known(
        spark.createDataFrame(classes, "class_id string, matchable boolean, mapped boolean"),
        spark.createDataFrame(members, "class_id string, member_id string, kind string, matchable boolean, mapped boolean"),
        spark.createDataFrame(variables, "class_id string, member_id string, kind string, idx int, matchable boolean, mapped boolean"),
    )


def test_lines_that_cannot_be_applied(spark):
    """Each line of a file with what becomes of it."""
    from linkgraph.sources import matchfile
    from linkgraph.sources.matchstate import resolve

    lines = [
        ("c\tA\tB", "ok"), ("\tm\tf()\tg()", "ok"), ("\t\tma\t0\t0", "ok"), ("\t\tma\t9\t0", "unknown a"), ("\t\tmv\t1\t1", "unmatchable"), ("\t\tmvu\tb\t1", "ok"),
        ("\tm\tf2()\tnone()", "unknown b"), ("\t\tmau\ta\t0", "ok"), ("\t\tmau\tb\t0", "skipped"), ("\t\tma\t0\t0", "skipped"),
        ("\tf\tx\tx", "unmatchable"), ("\tfu\tb\tx", "ok"), ("\tmu\ta\tgone()", "unknown a"),
        ("c\tA2\tnone", "unknown b"), ("\tm\tf()\tg()", "skipped"), ("\t\tma\t0\t0", "skipped"), ("c\tC\tD", "unmatchable"), ("\tmu\ta\tf()", "skipped"), ("cu\tb\tD", "ok"), ("cu\ta\tE", "unknown a"),
    ]
    a = known_of(spark, [("A", True, True), ("A2", True, True), ("C", False, True)], [("A", "f()", "method", True, True), ("A", "f2()", "method", True, True), ("A", "x", "field", True, True), ("C", "f()", "method", True, True)], [("A", "f()", "arg", 0, True, True), ("A", "f()", "var", 1, True, True), ("A", "f2()", "arg", 0, True, True)])
    b = known_of(spark, [("B", True, True), ("D", True, True)], [("B", "g()", "method", True, True), ("B", "x", "field", False, True)], [("B", "g()", "arg", 0, True, True), ("B", "g()", "var", 1, False, True)])
    rows = list(matchfile.parse("\n".join(["Matches saved now, input files:", *(line for line, _ in lines)])))
    judged = resolve(spark.createDataFrame(rows, matchfile.MATCH), a, b).collect()
    assert sorted((r["line_no"], r["status"]) for r in judged) == [(i + 2, status) for i, (_, status) in enumerate(lines)]


def test_rows_to_save(spark):
    """What is saved can be written, read and applied; unmatched entities only where they may not be matched."""
    from linkgraph.sources.matchstate import rows_to_save

    a = known_of(spark, [("A", True, False), ("A2", False, False), ("A3", True, True)], [("A", "f()", "method", True, True), ("A", "k()", "method", False, False)], [("A", "f()", "arg", 0, True, False), ("A", "f()", "var", 1, False, True)])
    b = known_of(spark, [("B", True, False), ("B2", False, True)], [("B", "g()", "method", True, False), ("B", "x", "field", False, True)], [("B", "g()", "arg", 0, True, False)])
    classes = spark.createDataFrame([("A", "B")], "a_class string, b_class string")
    members = spark.createDataFrame([("method", "A", "f()", "B", "g()")], "kind string, a_class string, a_member string, b_class string, b_member string")
    variables = spark.createDataFrame([("arg", "A", "f()", 0, "B", "g()", 0)], "kind string, a_class string, a_member string, a_idx int, b_class string, b_member string, b_idx int")
    got = sorted(map(tuple, rows_to_save(a, b, classes, members, variables).collect()), key=str)
    assert got == sorted([
        ("class", "A", "B", None, None, None, None, None, False), ("class", "A2", None, None, None, None, None, "a", True), ("class", None, "B2", None, None, None, None, "b", True),
        ("method", "A", "B", "f()", "g()", None, None, None, False), ("method", "A", "B", "k()", None, None, None, "a", True), ("field", "A", "B", None, "x", None, None, "b", True),
        ("arg", "A", "B", "f()", "g()", 0, 0, None, False), ("var", "A", "B", "f()", "g()", 1, None, "a", True),
    ], key=str)
    assert [tuple(r)[:3] for r in rows_to_save(a, b, classes, members, variables, save_unmapped=False).collect()] == [("class", None, "B2")]


def test_descriptors(spark):
    from linkgraph.functions.descriptors import translate

    given = ["I", "[[Lp/A;", "(Lp/A;I[Lp/B;J)Lp/A;", "()V", "(Lp/None;)V", "Lp/Null;", None, "()V", "L" + "p/A;"]
    names = [("p/A", "x/Long$Name"), ("p/B", "y"), ("p/Null", None), ("p/A", "z/Later")]
    got = translate(spark.createDataFrame([(d,) for d in given], "descriptor string"), spark.createDataFrame(names, "class_name string, name string"))
    assert {tuple(r) for r in got.collect()} == {("I", "I"), ("[[Lp/A;", "[[Lx/Long$Name;"), ("(Lp/A;I[Lp/B;J)Lp/A;", "(Lx/Long$Name;I[Ly;J)Lx/Long$Name;"), ("()V", "()V"), ("(Lp/None;)V", None), ("Lp/Null;", None), ("Lp/A;", "Lx/Long$Name;")}


# -- forests -----------------------------------------------------------------------------------------


def random_forest(rng, n):
    parents = [None if i < 3 or rng.random() < 0.05 else rng.randrange(max(0, i - 6), i) for i in range(n)]
    return [(f"x{i:03}", None if p is None else f"x{p:03}", rng.randrange(5)) for i, p in enumerate(parents)]


def test_forest_against_walks(spark):
    """Numbers, ranges, common ancestors and assignability with extra edges against plain walks."""
    from linkgraph.operators import forest

    rng = random.Random(12)
    rows = random_forest(rng, 150) + [("lost", "nowhere", 9)]
    nodes = spark.createDataFrame(rows, "node string, parent string, k int")
    labelled = forest.labels(nodes, ["k"])
    got = {r["node"]: r for r in labelled.collect()}
    parent = {n: p if p in {r[0] for r in rows} else None for n, p, _ in rows}
    key = {n: (k, n) for n, _, k in rows}
    expected, count = {}, 0

    def walk(node, depth):
        nonlocal count
        count += 1
        first = count
        for child in sorted((c for c in parent if parent[c] == node), key=key.get):
            walk(child, depth + 1)
        expected[node] = (first, count - first + 1, depth)

    for root in sorted((n for n in parent if parent[n] is None), key=key.get):
        walk(root, 0)
    assert {n: (r["first"], r["size"], r["depth"]) for n, r in got.items()} == expected

    def up(n):
        out = []
        while n is not None:
            out.append(n)
            n = parent[n]
        return out

    names = sorted(parent)
    pairs = [(rng.choice(names), rng.choice(names)) for _ in range(200)] + [("x100", "x100"), ("lost", "x001")]
    common = {(a, b): next((x for x in up(a) if x in up(b)), None) for a, b in pairs}
    found = forest.lowest_common(spark.createDataFrame(pairs, "a string, b string"), labelled).collect()
    assert {(r["a"], r["b"]): r["common"] for r in found} == {p: c for p, c in common.items() if c is not None}

    extra = [(rng.choice(names), rng.choice(names)) for _ in range(12)]
    above = {}
    for n in names:
        seen, todo = set(), [n]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [parent[x]] * (parent[x] is not None) + [p for c, p in extra if c == x]
        above[n] = seen
    ok = forest.assignable(spark.createDataFrame(pairs, "a string, b string"), labelled, spark.createDataFrame(extra, "child string, parent string"))
    assert {(r["a"], r["b"]) for r in ok.collect()} == {(a, b) for a, b in pairs if b in above[a]}


def test_a_deep_forest_takes_few_rounds(spark, monkeypatch):
    from linkgraph.operators import forest

    rounds, original = [], forest.stored
    monkeypatch.setattr(forest, "stored", lambda *args: (rounds.append(1), original(*args))[1])
    chain = spark.range(3000).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    labelled = forest.labels(chain, [])
    assert len(rounds) <= 15 and labelled.where("first <> node + 1 or depth <> node or size <> 3000 - node").isEmpty()
    assert forest.labels(chain.limit(0), []).count() == 0


def test_names_and_numbers_of_groups(spark):
    from linkgraph.operators.numbering import group_names, group_numbers, number_in_order

    rows = [("A.f", "A", "g1", True, None, 1), ("B.f", "B", "g1", True, 5, 1), ("A.h", "A", "A.h", True, None, 2), ("A.i", "A", "A.i", False, None, 3), ("A.j", "A", "A.j", True, 9, 4), ("B.k", "B", "g0", True, None, 0), ("C.k", "C", "g0", False, None, 0), ("C.l", "C", None, True, None, 1)]
    members = spark.createDataFrame([(*r, r[1]) for r in rows[:-1]], "member string, owner string, `group` string, obfuscated boolean, uid int, `order` int, owner_order string")
    assert {tuple(r) for r in group_names(members, "m").collect()} == {("A.f", "vm0"), ("B.f", "vm0"), ("B.k", "vm1"), ("A.h", "m0"), ("A.j", "m1")}
    assert {tuple(r) for r in group_numbers(members, 10).collect()} == {("A.f", 11), ("B.f", 11), ("A.h", 12), ("B.k", 13), ("C.k", 13)}
    many = number_in_order(spark.range(1000, numPartitions=7).select((1000 - F.col("id")).alias("k")), ["k"], 4)
    assert many.where("number <> k + 4").isEmpty() and many.count() == 1000


# -- scopes, names of arguments, keyed streams --------------------------------------------------------


def test_names_are_settled_at_the_first_place(spark):
    from linkgraph.operators.scopes import resolve_names

    types = ["p/A", "p/B", "q/A", "in$A", "in$C", "mid$C", "mid$D", "out$D", "out$E", "mid$A"]
    references = [("in", n) for n in "ABCDEFXY"] + [("in", "A"), ("out", "D"), ("none", "A")]
    imports = [("in", "X", "lib/X"), ("in", "Y", "lib/Y2"), ("in", "Y", "lib/Y1"), ("in", "B", "own/B")]
    packages = [("in", "q", 2), ("in", "p", 1), ("in", "none", 0)]
    outer = [("in", "mid"), ("mid", "out")]
    make = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    got = resolve_names(make(references, "scope string, name string"), make([(t,) for t in types], "type string"), make(imports, "scope string, name string, type string"), make(packages, "scope string, package string, at int"), make(outer, "scope string, around string"))
    assert {tuple(r) for r in got.collect()} == {
        ("in", "X", "lib/X", "import", False), ("in", "Y", "lib/Y1", "import", True), ("in", "B", "own/B", "import", False), ("in", "A", "p/A", "package", False),
        ("in", "C", "in$C", "nested", False), ("in", "D", "mid$D", "around 1", False), ("in", "E", "out$E", "around 2", False), ("in", "F", None, None, False),
        ("out", "D", "out$D", "nested", False), ("none", "A", None, None, False),
    }


def test_argument_names_spread_in_groups(spark):
    from linkgraph.operators.scopes import propagate_arguments

    members = spark.createDataFrame([(1, "g"), (2, "g"), (3, "g"), (4, "alone"), (5, None)], "member int, `group` string")
    arguments = spark.createDataFrame([(1, 0, None), (2, 0, "x"), (3, 0, "y"), (1, 1, None), (2, 1, None), (4, 0, None), (4, 1, "z"), (5, 0, "n")], "member int, idx int, name string")
    got = {tuple(r) for r in propagate_arguments(members, arguments).collect()}
    assert got == {(1, 0, "x"), (2, 0, "x"), (3, 0, "y"), (1, 1, None), (2, 1, None), (4, 0, None), (4, 1, "z"), (5, 0, "n")}


def test_a_stream_goes_on_after_a_restart(spark, tmp_path):
    """Two runs with a stop between give the rows of one; what a batch writes follows the batch."""
    from linkgraph.streaming.incremental import best_of, keep_best, winners

    rng = random.Random(9)
    rows = [(rng.randrange(40), b, float(rng.randrange(30))) for b in range(400)]
    schema = "a bigint, b bigint, score double"
    source, folder = str(tmp_path / "in"), f"file://{tmp_path}/out"
    spark.createDataFrame([], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)

    def run(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        query = keep_best(stream, folder).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(map(tuple, winners(stream, folder).collect()))

    run(rows[:300])
    run(rows[300:390])
    got = run(rows[390:])
    assert got == sorted(map(tuple, best_of(spark.createDataFrame(rows, schema)).collect()))
    sizes = spark.read.parquet(f"{folder}/updates").groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in sizes][0] == 40 and sizes[-1]["count"] == len({r[0] for r in rows[390:]})
    assert run([])[:3] == got[:3]


def test_nearest_pairs(spark):
    """Against all pairs: the nearest below and above in each group, ties to the smaller id."""
    from linkgraph.operators.blocking import nearest_pairs

    rng = random.Random(6)
    rows = lambda n: [(rng.choice("xxxy"), i, rng.choice([5, 5, 7, rng.randrange(40)])) for i in range(n)]
    a, b = rows(60) + [("only a", 99, 1)], rows(50)
    got = nearest_pairs(spark.createDataFrame(a, "k string, a bigint, value bigint"), spark.createDataFrame(b, "k string, b bigint, value bigint"), ["k"], 2)
    expected = set()
    for k, i, v in a:
        low = sorted(((v - w, j) for g, j, w in b if g == k and w <= v))[:2]
        high = sorted(((w - v, j) for g, j, w in b if g == k and w > v))[:2]
        expected |= {(i, j) for _, j in low + high}
    assert {tuple(r) for r in got.collect()} == expected and got.count() == len(expected)


def test_alignments_are_kept_over_rounds(spark):
    """Each round computes the pairs of contents that no round had, and gives what computing all anew gives."""
    from linkgraph.functions import instructions as ins
    from linkgraph.functions import similarity as sim
    from linkgraph.operators.kept import KeptPairs
    from linkgraph.plans import code

    rng = random.Random(2)
    ins_ = "struct<op:int,kind:string,num:bigint,ref:string,type:string,keys:array<bigint>>"
    body = lambda refs: [(1, rng.choice(["type", "op"]), 1, rng.choice(refs), None, [1]) for _ in range(rng.randrange(1, 6))]
    rows = [(i, i + 1, body(["r0", None]), body(["r0"])) for i in range(12)] + [(i, i + 1, body(["r1", "r0"]), body(["r1"])) for i in range(20, 27)] + [(i, i + 1, body(["r2"]), body(["r2", None])) for i in range(40, 45)]
    rows += [(60, 61, rows[0][2], rows[0][3]), (70, 71, None, rows[0][3]), (72, 73, None, None), (74, 75, [], [])]
    pairs = spark.createDataFrame(rows, f"a bigint, b bigint, body_a array<{ins_}>, body_b array<{ins_}>")
    kept = KeptPairs(spark)
    got = {(r["round"], r["a"]): r["score"] for r in code.kept_rounds(pairs, kept).collect()}
    contents = set()
    for n, known in enumerate(code.KNOWN_REFERENCES, 1):
        now = code.known_as(pairs, known)
        anew = now.withColumn("score", F.round(sim.null_rule(F.col("body_a"), F.col("body_b"), ins.code_similarity("body_a", "body_b")), 6))
        assert {(n, r["a"]): r["score"] for r in anew.collect()} == {k: v for k, v in got.items() if k[0] == n}
        fresh = {str((r["body_a"], r["body_b"])) for r in now.collect()} - contents
        assert spark.read.parquet(f"{kept.path}/{n - 1}").count() == len(fresh)
        contents |= fresh
    assert len(fresh) == 0 and len(got) == 3 * len(rows)


def test_stages_in_any_order_of_arrival(spark, tmp_path):
    """Two orders of arrival over several batches, gaps, repeated and missing stages: one result."""
    from linkgraph.plans.reports import staged_stream

    rng = random.Random(3)
    rows = [(k, s, rng.randrange(1000)) for k in range(30) for s in range(1, rng.randrange(2, 7))] + [(50, 2, 5), (50, 3, 6), (51, 1, 4), (51, 3, 9)]
    rows += [rows[0], rows[1]]
    expected = {}
    for k, s, v in sorted(set(rows)):
        if s == 1 or (k, s - 1) in expected:
            expected[k, s] = (expected.get((k, s - 1), 7) * 31 + v) % 1000003
    for order in (1, 2):
        source, arrived = f"{tmp_path}/in{order}", list(rows)
        random.Random(order).shuffle(arrived)
        for i in range(0, len(arrived), 40):
            spark.createDataFrame(arrived[i : i + 40], "key bigint, stage int, value bigint").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("key bigint, stage int, value bigint").option("maxFilesPerTrigger", 1).parquet(source)
        assert {(r["key"], r["stage"]): r["result"] for r in staged_stream(stream, f"file://{tmp_path}/out{order}").collect()} == expected


def test_queries_are_listed_without_a_session():
    """Modules must not build Columns when they are imported."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
