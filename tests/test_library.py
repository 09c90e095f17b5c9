"""Kernels, operators, filters, sources and queries of the library."""

import hashlib
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from linkgraph import filters
from linkgraph.functions import names
from linkgraph.functions import similarity as sim
from linkgraph.operators import graphs, ranking, rounds, sets
from linkgraph.sources import archives, matchfile, nametable


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]) if xs else F.array().cast("array<int>")


@pytest.mark.parametrize("a,b,want", [(3, 5, 0.6), (0, 0, 1), (0, 4, 0)])
def test_count_ratio(spark, a, b, want):
    assert value(spark, sim.count_ratio(F.lit(a), F.lit(b))) == pytest.approx(want)


def test_jaccard_flags_and_null_rule(spark):
    assert value(spark, sim.jaccard(ints(1, 2, 3), ints(2, 3, 4))) == 0.5
    assert value(spark, sim.jaccard(ints(), ints())) == 1 and value(spark, sim.jaccard(ints(1), ints())) == 0
    assert value(spark, sim.flags(F.lit(0b00011), F.lit(0b10000), 31, 5)) == pytest.approx(0.4)
    null = F.lit(None).cast("int")
    assert [value(spark, sim.null_rule(x, y, F.lit(0.3))) for x, y in ((null, null), (null, F.lit(1)), (F.lit(1), F.lit(1)))] == [1, 0, 0.3]


@pytest.mark.parametrize("a,b,want", [("kitten", "sitting", 1 - 3 / 7), ("abcd", "abd", 0.75), ("ab", "ba", 0), ("", "", 1), ("", "a", 0)])
def test_edit_similarity(spark, a, b, want):
    assert value(spark, sim.edit_similarity(F.lit(a), F.lit(b))) == pytest.approx(want)
    assert sim.weighted_similarity(list(a), list(b)) == pytest.approx(want)


@pytest.mark.parametrize("a,b,want", [("abcd", "abd", [0, 1, -1, 2]), ("kitten", "sitting", [-1, 1, 2, 3, -1, 5]), ("ab", "ba", [-1, -1]), ("aab", "ab", [0, -1, 1]), ("abc", "", [-1, -1, -1])])
def test_alignment(spark, a, b, want):
    assert sim.align(list(a), list(b)) == want


def test_possible_pairs_cost_one(spark):
    assert sim.weighted_similarity(["x:1"], ["x:2"]) == 0.5
    got = spark.createDataFrame([(["x:1"], ["x:2"]), (None, ["x"])], "a array<string>, b array<string>").select(sim.weighted_edit_similarity("a", "b").alias("s"), sim.alignment("a", "b").alias("p")).collect()
    assert [r.s for r in got] == [0.5, None] and [r.p for r in got] == [[0], None]


def test_accept_rule(spark):
    accepted = lambda *raws: ranking.accept(spark.createDataFrame([(1, i, float(r)) for i, r in enumerate(raws)], "a int, b int, raw double"), 93.0).count()
    assert [accepted(90), accepted(90, 88), accepted(90, 85), accepted(85)] == [1, 0, 1, 0]
    norm = [value(spark, sim.normalised(F.lit(float(x)), 93.0)) for x in (90, 88, 85)]
    assert norm == pytest.approx([0.936524, 0.895364, 0.835357], abs=1e-6)
    assert sim.mismatch_bound(93.0) == pytest.approx(10.983, abs=1e-3)


def test_conflicts_go_whole(spark):
    pairs = spark.createDataFrame([("a1", "b1"), ("a2", "b1"), ("a3", "b2")], "a string, b string")
    assert [tuple(r) for r in ranking.without_conflicts(pairs).select("a", "b").collect()] == [("a3", "b2")]


def test_registry_and_pruning(spark):
    registry = ranking.Registry()
    registry.add(ranking.Scorer("x", 3, lambda: F.col("x")))
    registry.add(ranking.Scorer("y", 7, lambda: F.col("y"), ("full",)))
    assert (registry.maximum("initial"), registry.maximum("full")) == (3, 10)
    with pytest.raises(ValueError):
        registry.add(ranking.Scorer("x", 1, lambda: F.col("x")))
    pairs = spark.createDataFrame([(1, 1, 1.0, 0.9), (1, 2, 0.2, 1.0), (1, 3, 1.0, 0.0)], "a int, b int, x double, y double")
    kept = ranking.score_pairs(pairs, registry.at("full"), bound=2.0).collect()
    assert [(r.b, round(r.raw, 6)) for r in kept] == [(1, 9.3)]


def test_soft_sets(spark):
    rows = lambda xs: spark.createDataFrame(xs, "pair int, elem int, kind string")
    left = rows([(1, 10, "k"), (1, 11, "k"), (1, 12, "m"), (1, 99, "s"), (2, 1, "k")])
    right = rows([(1, 20, "k"), (1, 21, "k"), (1, 99, "s"), (3, 1, "k")])
    matches = spark.createDataFrame([(10, 20), (12, 77)], "a int, b int")
    got = {r.pair: r.score for r in sets.soft_sets(left, right, matches).collect()}
    assert got == {1: pytest.approx(6 / 7), 2: 0, 3: 0}


def test_graphs(spark):
    e = spark.createDataFrame([("d", "c"), ("c", "b"), ("b", "a"), ("x", "b"), ("c", "c")], "child string, parent string")
    closed = graphs.closure(e)
    depth = {(r.node, r.ancestor): r.depth for r in closed.collect()}
    assert depth["d", "a"] == 3 and depth["x", "a"] == 2 and depth["a", "a"] == 0 and ("a", "d") not in depth
    common = graphs.lowest_common(spark.createDataFrame([("d", "x")], "a string, b string"), closed).first().common
    assert common == "b"
    declared = spark.createDataFrame([("a", "m"), ("c", "m")], "owner string, member string")
    wanted = spark.createDataFrame([("d", "m"), ("x", "m"), ("x", "n")], "node string, member string")
    assert {(r.node, r.member): r.owner for r in graphs.resolve(wanted, closed, declared).collect()} == {("d", "m"): "c", ("x", "m"): "a", ("x", "n"): None}
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    comps = {r.node: r.comp for r in graphs.components(chain).collect()}
    assert {comps[i] for i in range(41)} == {0} and comps[101] == 100


def test_overlaps_and_components_of_all_rows(spark, tmp_path):
    from datetime import datetime, timedelta

    from linkgraph.plans import QUERIES

    at = [(i, i % 2, datetime(2024, 1, 1) + timedelta(minutes=(i * i * 7) % 97)) for i in range(30)]
    spark.createDataFrame(at, "event_id bigint, user_id bigint, ts timestamp").write.parquet(f"{tmp_path}/events.parquet")
    want = {}
    for user in (0, 1):
        mine = sorted((ts, i) for i, u, ts in at if u == user)
        slots = [(s, e, i) for (s, i), (e, _) in zip(mine, mine[1:])]
        for ts, i in mine:
            if hit := [x for s, e, x in slots if s < ts + timedelta(minutes=10) and e > ts]:
                want[i] = (len(hit), min(hit))
    assert {r.probe: (r.overlaps, r.first_event) for r in QUERIES["overlap_slots_all"](spark, str(tmp_path)).collect()} == want and len(want) > 20
    lines = [(o, (o * o) % 23, o % 50) for o in range(60)] + [(o, 100 + o // 2, 1) for o in range(60, 80)] + [(99, 500, 49)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_quantity bigint").write.parquet(f"{tmp_path}/lineitem.parquet")
    comp = {o: o for o, _, _ in lines}
    for _ in lines:
        for part in {p for _, p, _ in lines}:
            low = min(comp[o] for o, p, _ in lines if p == part)
            comp |= {o: low for o, p, _ in lines if p == part}
    alone = {o for o in comp if sum(c == comp[o] for c in comp.values()) == 1}
    assert {r.node: r.comp for r in QUERIES["components_all"](spark, str(tmp_path)).collect()} == {o: c for o, c in comp.items() if o not in alone}


def test_rounds(spark):
    m = lambda xs: spark.createDataFrame(xs, "a int, b int")
    assert {tuple(r) for r in rounds.apply_matches(m([(1, 1), (2, 2), (3, 3)]), m([(1, 2)])).collect()} == {(3, 3), (1, 2)}
    seen = rounds.to_fixpoint(m([(0, 0)]), lambda now: now.agg(F.max("a").alias("a")).where("a < 4").select((F.col("a") + 1).alias("a"), (F.col("a") + 1).alias("b")))
    assert seen.count() == 5


def test_rounds_do_not_stop_unfinished(spark):
    m = spark.createDataFrame([(0, 0)], "a int, b int")
    step = lambda now: now.agg(F.max("a").alias("a")).where("a < 4").select((F.col("a") + 1).alias("a"), (F.col("a") + 1).alias("b"))
    assert rounds.to_fixpoint(m, step, most=4).count() == 5
    with pytest.raises(RuntimeError):
        rounds.to_fixpoint(m, step, most=3)


@pytest.mark.parametrize("program,want", [("name foo", [1]), ('name "foo"', [1]), ("a name b name eq not", None), ("name swap", [1, 2]), ("", [1, 2]), ("a name pkg startswith swap dup", [1, 2]), ("name foo eq not", [2]), ("name dup outer p/foo eq swap inner bar eq and", [2]), ("a eq", []), ("b", [1, 2])])
def test_filter_language(spark, program, want):
    rows = spark.createDataFrame([(1, 7, "x", 1, "foo"), (2, 7, "x", 2, "p/foo$bar")], "row int, a_id int, a_name string, b_id int, b_name string")
    got = sorted(r.row for r in filters.filter_ranked(rows, program).collect())
    assert got == ([1, 2] if want is None else want)


def test_simple_filter(spark):
    rows = spark.createDataFrame([(0.5, "Foo"), (0.25, "bar")], "score double, b_name string")
    assert [r.b_name for r in filters.simple_filter(rows, "500 fO").collect()] == ["Foo"]


def test_names(spark):
    n = F.lit("a/b$c")
    assert [value(spark, f(n)) for f in (names.package, names.simple_name, names.outer, names.inner, names.id_of)] == ["a", "b$c", "a/b", "c", "La/b$c;"]
    assert value(spark, names.outer(F.lit("$x"))) is None and value(spark, names.package(F.lit("x"))) is None
    assert value(spark, names.name_of(F.lit("La/b;"))) == "a/b"
    assert value(spark, names.display_type(F.lit("[[I"))) == "int[][]" and value(spark, names.display_type(F.lit("La/B;"))) == "a.B"
    assert value(spark, names.flag_words(F.lit(1 | 16 | 1024 | 0x20000))) == "public final abstract 0x20000"
    assert [value(spark, names.is_identifier(F.lit(x))) for x in ("a1", "1a", "", "ä_$")] == [True, False, False, True]
    keys = [value(spark, names.natural_key(F.lit(x))) for x in ("a2", "a10", "a", "b1")]
    assert keys[0] < keys[1] and keys[2] < keys[0] and keys[1] < keys[3]
    assert value(spark, names.html_escape(F.lit("<a & 'b'>"))) == "&lt;a &amp; &#39;b&#39;&gt;"
    assert value(spark, names.uid(F.lit(None).cast("int"), F.lit(None).cast("int"))) == -1


MATCH_TEXT = """Matches saved 2024-01-01T00:00:00Z, input files:
\ta:
\t\t12\tSHA256\tAAAA\tx.jar
\tb:
\tcp:
\tcp a:
\tcp b:
c\tLa;\tLb;
\tm\tf()V\tg()V
\t\tma\t0\t0
\t\tmvu\tb\t3
\tfu\ta\tx;;I
cu\tb\tLz;
"""


def test_match_file(spark, tmp_path):
    (tmp_path / "x.match").write_text(MATCH_TEXT)
    got = matchfile.read_matches(spark, str(tmp_path / "x.match"))
    rows = got.orderBy("line_no").collect()
    assert [(r.kind, r.unmatchable) for r in rows] == [("class", False), ("method", False), ("arg", False), ("var", True), ("field", True), ("class", True)]
    assert (rows[2].a_class, rows[2].b_member, rows[2].a_idx) == ("La;", "g()V", 0) and (rows[3].side, rows[3].b_idx) == ("b", 3)
    out = str(tmp_path / "out")
    assert matchfile.write_matches(got, out)
    again = matchfile.read_matches(spark, out)
    assert {tuple(r)[:-1] for r in again.collect()} == {tuple(r)[:-1] for r in rows}
    with pytest.raises(Exception, match="exist"):
        matchfile.write_matches(got, out)
    assert not matchfile.write_matches(got.limit(0), str(tmp_path / "none"))
    classes = spark.createDataFrame([("La;",), ("Lb;",)], "class_id string")
    good, bad = matchfile.known(got, classes, classes)
    assert (good.count(), bad.count()) == (5, 1)


@pytest.mark.parametrize("text", ["nothing", MATCH_TEXT + "c\tLa;\n", MATCH_TEXT + "\t\tma\t0\t0\n", MATCH_TEXT + "cu\tq\tLa;\n"])
def test_bad_match_files(text):
    with pytest.raises(matchfile.FormatError):
        list(matchfile.parse(text))


def test_name_tables(spark, tmp_path):
    row = "kind string, class_name string, member_name string, `desc` string, idx int, mapped string, uid int, comment string"
    entities = spark.createDataFrame([("class", "A", None, None, None, "Old", 9, None), ("class", "A$B", None, None, None, None, None, None), ("method", "A", "m", "()V", None, "m", None, None)], row)
    names_ = spark.createDataFrame([("class", "A", None, None, None, "named", "New", "c"), ("class", "A", None, None, None, "uid", "5", None), ("class", "Q", None, None, None, "named", "X", None), ("class", "A$B", None, None, None, "named", "Inner", None)], nametable.NAMES)
    nametable.write_names(names_, str(tmp_path / "n"))
    read = nametable.read_names(spark, str(tmp_path / "n"))
    assert {tuple(r) for r in read.collect()} == {tuple(r) for r in names_.collect()}
    mapped = lambda **o: {r.class_name: r.mapped for r in nametable.merge_names(entities, read, "named", "mapped", **o).where("kind = 'class'").collect()}
    assert mapped() == {"A": "Old", "A$B": "Inner"} and mapped(replace=True) == {"A": "New", "A$B": "Inner"}
    assert {r.class_name: r.uid for r in nametable.merge_names(entities, read, "uid", "uid").where("kind = 'class'").collect()} == {"A": 5, "A$B": None}
    assert [r.class_name for r in nametable.unknown(read, entities).collect()] == ["Q"]
    assert [(r.kind, r.class_name) for r in nametable.export(entities, "mapped").collect()] == [("class", "A"), ("method", "A")]
    assert nametable.export(entities, "mapped", "minimal").count() == 1
    assert nametable.cleared(entities).where("mapped is not null").count() == 0
    assert {(r.kind, r.names, r.comments) for r in nametable.counts(read).collect()} == {("class", 4, 1)}


def test_archives(spark, tmp_path):
    for name, entries in (("one.jar", {"a.class": b"1", "b.class": b"2", "n.txt": b"x"}), ("two.jar", {"a.class": b"3"})):
        with zipfile.ZipFile(tmp_path / name, "w") as z:
            for k, v in entries.items():
                z.writestr(k, v)
    got = archives.read_archives(spark, f"{tmp_path}/*.jar")
    assert got.count() == 3
    order = [f"file:{tmp_path}/two.jar", f"file:{tmp_path}/one.jar"]
    first = {r.entry: (bytes(r.content), len(r.origins)) for r in archives.first_wins(got, order).collect()}
    assert first == {"a.class": (b"3", 2), "b.class": (b"2", 1)}
    prints = archives.fingerprints(spark, f"{tmp_path}/*.jar")
    data = (tmp_path / "two.jar").read_bytes()
    assert {r.file: r.sha256 for r in prints.collect()}["two.jar"] == hashlib.sha256(data).hexdigest()
    wanted = spark.createDataFrame([("two.jar", len(data), None), ("gone.jar", None, None)], "file string, size bigint, sha256 string")
    found = prints.withColumns({"folder": F.lit("d1"), "path": F.concat(F.lit("d1/"), "file")})
    assert {r.file: r.path for r in archives.locate(wanted, found, ["d1"]).collect()} == {"two.jar": "d1/two.jar", "gone.jar": None}


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["a", "b", "score"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


# -- instructions, call sites, automatic matching --------------------------------------------------


def random_instruction(rng):
    kind = rng.choice(["int", "var", "type", "field", "method", "dynamic", "jump", "ldc", "inc", "table", "lookup", "multi", "op"])
    maybe = lambda *x: rng.choice([None, *x])
    return {"op": sorted(["int", "var", "type", "field", "method", "dynamic", "jump", "ldc", "inc", "table", "lookup", "multi", "op"]).index(kind) * 2 + rng.randrange(2), "kind": kind, "num": rng.randrange(2), "ref": maybe("r", "s"), "type": maybe("t", "u"), "keys": maybe([1, 2], [1, 3])}


def test_instruction_costs_agree(spark):
    """The column, the table of costs, and the rules one by one."""
    from linkgraph.functions import instructions as ins

    rng = random.Random(8)
    x, y = [random_instruction(rng) for _ in range(60)], [random_instruction(rng) for _ in range(60)]
    struct = "struct<op:int,kind:string,num:bigint,ref:string,type:string,keys:array<bigint>>"
    df = spark.createDataFrame([(i, j, a, b) for i, a in enumerate(x) for j, b in enumerate(y)], f"i int, j int, x {struct}, y {struct}")
    got = {(r.i, r.j): r.c for r in df.select("i", "j", ins.cost(F.col("x"), F.col("y")).alias("c")).collect()}
    table = ins.cost_table(x, y)

    def rule(a, b):
        variable = 0 if a["ref"] is None or b["ref"] is None else 2 if a["ref"] != b["ref"] else int(a["type"] != b["type"])
        if a["op"] != b["op"]:
            return 2
        k = a["kind"]
        if k == "var" or k == "inc":
            return 2 if k == "inc" and a["num"] != b["num"] else variable
        if k == "dynamic":
            made = (a["type"] or b["type"]) is not None
            return 2 * (a["ref"] != b["ref"] or made and (a["type"], a["num"]) != (b["type"], b["num"]))
        names = {"int": "num", "jump": "num", "type": "ref", "field": "ref", "method": "ref", "ldc": "type ref", "table": "keys", "lookup": "keys", "multi": "num ref"}.get(k, "").split()
        return 2 * any(a[n] != b[n] for n in names)

    for (i, j), c in got.items():
        assert c == table[i, j] == rule(x[i], y[j]), (x[i], y[j])


def test_body_similarity(spark):
    from linkgraph.functions import instructions as ins

    a = [{"op": n, "kind": "op", "num": None, "ref": None, "type": None, "keys": None} for n in (1, 2, 3, 4)]
    b = [a[0], a[1], a[3]]
    struct = "array<struct<op:int,kind:string,num:bigint,ref:string,type:string,keys:array<bigint>>>"
    df = spark.createDataFrame([(a, b), (a, a), ([], []), (a, []), (a, None)], f"x {struct}, y {struct}")
    rows = df.select(ins.code_similarity("x", "y").alias("s"), ins.code_alignment("x", "y").alias("p")).collect()
    assert [r.s for r in rows] == [0.75, 1.0, 1.0, 0.0, None]
    assert [r.p for r in rows] == [[0, 1, -1, 2], [0, 1, 2, 3], [], [-1] * 4, None]
    m = lambda *v: spark.range(1).select(ins.method_similarity(*[F.lit(x) for x in v]).alias("m")).first().m
    assert m(True, 1.5, 2, 0, 3, 4, True, True) == pytest.approx(0.05 + 0.2 * 0.75 + 0.75 * 0.75)
    assert m(False, 0.0, 0, 0, 0, 0, True, True) == pytest.approx(0.95) and m(True, 0.0, 0, 0, 0, 0, False, True) == 0 and m(True, 0.0, 0, 0, 0, 0, False, False) == 1


def test_call_sites(spark):
    from linkgraph.operators.callsites import call_site_scores

    pairs = spark.createDataFrame([(1, 11), (2, 12), (3, 13)], "a bigint, b bigint")
    a = spark.createDataFrame([(100, 0, 1), (100, 1, 2), (100, 2, 1), (101, 0, 1), (1, 5, 1), (102, 0, 1)], "src bigint, at int, target bigint")
    b = spark.createDataFrame([(200, 0, 11), (200, 4, 12), (200, 2, 12), (202, 0, 12)], "src bigint, at int, target bigint")
    matches = spark.createDataFrame([(100, 200), (102, 202)], "src bigint, dst bigint")
    aligned = spark.createDataFrame([(100, 200, 0, 0), (100, 200, 1, 4), (100, 200, 2, 2), (102, 202, 0, 0)], "src bigint, dst bigint, at int, partner int")
    got = {r.a: r.score for r in call_site_scores(pairs, a, b, matches, aligned).collect()}
    # 1: place 0 agrees, place 2 does not, 101 is not matched, 102 is with no caller of 11, its own call does not count
    assert got == {1: 0.25, 2: 1.0, 3: 1.0}


def test_auto_match_goes_on_while_something_is_matched(spark):
    from linkgraph.operators.automatch import Kind, auto_match
    from linkgraph.operators.ranking import Registry, Scorer

    seen = []
    one = Registry()
    one.add(Scorer("s", 1, lambda: F.col("s")))
    frame = lambda rows: spark.createDataFrame(rows, "a bigint, b bigint, s double")

    def kind(name, rows_of):
        def candidates(state, level):
            seen.append((name, level))
            return frame(rows_of({k: {tuple(r) for r in v.collect()} for k, v in state.items()}))

        return Kind(name, candidates, one)

    # a class's member is matched once the class is, and the next class once that member is
    classes = kind("classes", lambda s: [(1, 1, 1.0)] + ([(2, 2, 1.0), (2, 3, 0.5)] if (2, 2) in s["methods"] else [(2, 2, 0.95), (2, 3, 0.94)] if (1, 1) in s["methods"] else []))
    methods = kind("methods", lambda s: [(a, b, 1.0) for a, b in s["classes"]] + [(2, 2, 1.0)] * ((1, 1) in s["methods"]))
    args = kind("args", lambda s: [(a, b, 1.0) for a, b in s["methods"]])
    nothing = {k: spark.createDataFrame([], "a bigint, b bigint") for k in ("classes", "methods", "args")}
    state = auto_match(classes, [methods], [args], nothing)
    assert {k: {tuple(r) for r in v.collect()} for k, v in state.items()} == {k: {(1, 1), (2, 2)} for k in nothing}
    assert seen[:4] == [("classes", "initial"), ("classes", "initial"), ("methods", "intermediate"), ("classes", "intermediate")]
    assert {x for x in seen if x[0] == "classes"} == {("classes", x) for x in ("initial", "intermediate", "full", "extra")} and seen[-1] == ("args", "full")


# -- hierarchy, names, filters ----------------------------------------------------------------------


def test_hierarchy_groups_and_overrides(spark):
    from linkgraph.operators import hierarchy
    from linkgraph.operators.graphs import closure

    edges = spark.createDataFrame([("D", "B"), ("D", "C"), ("B", "A"), ("E", "C"), ("X", "Y")], "child string, parent string")
    members = spark.createDataFrame([("A.m", "A", "m", False), ("B.m", "B", "m", True), ("C.m", "C", "m", False), ("D.m", "D", "m", False), ("E.m", "E", "m", False), ("Y.m", "Y", "m", False), ("Z.m", "Z", "m", False), ("D.i", "D", "<init>", False), ("C.i", "C", "<init>", False)], "member string, owner string, id string, barrier boolean")
    groups = {r.member: r.group for r in hierarchy.groups(closure(edges), members).collect()}
    assert groups == {"A.m": "A.m", "B.m": "B.m", "C.m": "A.m", "D.m": "A.m", "E.m": "A.m", "Y.m": "Y.m", "Z.m": "Z.m", "D.i": "C.i", "C.i": "C.i"}
    parents = hierarchy.overrides(edges, members)
    assert sorted(map(tuple, parents.collect())) == [("D.m", "A.m"), ("D.m", "C.m"), ("E.m", "C.m")]  # past the private B.m
    origins = spark.createDataFrame([("D.m", "x"), ("D.m", "y"), ("A.m", "x"), ("E.m", "y"), ("C.m", "z")], "member string, origin string")
    got = {r.member: (r.has_parent, r.is_root) for r in hierarchy.ancestry(parents, origins).collect()}
    assert got == {"D.m": (True, True), "A.m": (False, True), "E.m": (False, True), "C.m": (False, True)}


def test_natural_order_of_long_numbers(spark):
    from linkgraph.functions import names

    texts = ["a1234567890129", "a1234567890123", "a2", "a10", "a010", "a", "a99999999999999999999999", "b1"]
    got = [r.t for r in spark.createDataFrame([(t,) for t in texts], "t string").orderBy(names.natural_key(F.col("t")), "t").collect()]
    assert got == ["a", "a2", "a010", "a10", "a1234567890123", "a1234567890129", "a99999999999999999999999", "b1"]


def test_instanceof_and_owners(spark):
    from linkgraph.filters import filter_ranked

    rows = spark.createDataFrame([(1, "p/X", "p/O", ["p/O", "p/S", "q/T"], "p/S"), (2, "p/Y", "p/Q", ["p/Q"], None)], "b_id int, b_name string, b_class string, b_ancestors array<string>, b_super string").withColumn("a_id", F.lit(9)).withColumn("a_class", F.lit("q/T"))
    passed = lambda program: [r.b_id for r in filter_ranked(rows, program).collect()]
    assert passed("q/T instanceof") == [1] and passed("a instanceof") == [1] and passed("p/Q instanceof not") == [1]
    assert passed("supercls p/S eq") == [1] and passed("instanceof") == [1, 2] and passed("q/T instanceof x") == [1, 2]


def test_members_are_matched_with_their_groups(spark):
    """Group g of A and h of B are unpaired: both lose what they had. Groups k and l are paired: two change partners."""
    schema = "member bigint, `group` string, owner string"
    a = spark.createDataFrame([(1, "g", "A"), (2, "g", "B"), (3, "g", "C"), (4, "k", "A"), (5, "k", "B"), (6, "x", "A")], schema)
    b = spark.createDataFrame([(11, "h", "A'"), (12, "h", "B'"), (13, "h", "B'"), (14, "l", "A'"), (15, "l", "B'"), (16, "y", "A'")], schema)
    classes = spark.createDataFrame([("A", "A'"), ("B", "B'")], "a string, b string")
    old = spark.createDataFrame([(2, 16), (6, 13), (5, 14), (4, 15)], "a bigint, b bigint")
    asked = spark.createDataFrame([(1, 11), (4, 14)], "a bigint, b bigint")
    after, lost = rounds.match_members(asked, a, b, classes, old)
    assert sorted(map(tuple, after.collect())) == [(1, 11), (2, 12), (4, 14)]
    assert sorted(map(str, [tuple(r) for r in lost.collect()])) == sorted(map(str, [(2, None), (6, None), (5, None), (4, None), (None, 16), (None, 13), (None, 14), (None, 15)]))
    again, none = rounds.match_members(asked, a, b, classes, after)
    assert sorted(map(tuple, again.collect())) == [(1, 11), (2, 12), (4, 14)] and none.isEmpty()
