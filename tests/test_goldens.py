"""Small fixtures with known results."""

from __future__ import annotations

import itertools

import pytest
from pyspark.sql import functions as F

from stratalake.functions import values
from stratalake.functions.methods import parse_jni, parse_method_fact, parse_method_id
from stratalake.operators import automata, bayes, dataflow, diff, graph, tables, taint, windows
from stratalake.sources import readers, writers
from stratalake.streaming import engine


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_diff_keeps_repetitions(spark):
    frame = lambda xs: spark.createDataFrame([(str(x),) for x in xs], "hash string")
    d = diff.report_diff(frame([3, 1, 2, 2, 2]), frame([1, 4, 1]))
    by = lambda s: sorted(r.hash for r in d.where(F.col("status") == s).collect())
    assert by("introduced") == ["2", "2", "2", "3"] and by("fixed") == ["4"] and by("preexisting") == ["1"]


def test_diff_of_interesting_paths(spark):
    schema = "hash string, file string"
    cur = spark.createDataFrame([("npe1", "D1"), ("leak", "D2"), ("npe3", "D3"), ("wrong", "U"), ("tell", "U")], schema)
    prev = spark.createDataFrame([("npe1", "D1"), ("stuff", "D2"), ("leak", "D2"), ("wrong", "U")], schema)
    d = diff.only_paths(diff.report_diff(cur, prev), spark.createDataFrame([("D2",)], "file string"), ("fixed", "preexisting"))
    assert rows(d.select("status", "hash")) == [("fixed", "stuff"), ("introduced", "npe3"), ("introduced", "tell"), ("preexisting", "leak")]


def test_directives(spark):
    d = spark.createDataFrame([(s,) for s in ("", "OOO", "UNU", "UOU", "ONU", "UU")], "s string").withColumn("k", F.col("s"))
    got = {r.k: list(r.lines) for r in diff.affected_lines(d, "k", "s").collect()}
    assert got == {"": [], "OOO": [1], "UNU": [2], "UOU": [2], "ONU": [1], "UU": []}


def test_lines_in_ranges(spark):
    ranges = spark.createDataFrame([("A", "one", 11, 11), ("A", "two", 13, 15), ("A", "far", 1, 900)], "file string, m string, start_line int, end_line int")
    changed = spark.createDataFrame([("A", 11), ("A", 15), ("B", 11)], "file string, line int")
    assert rows(diff.line_hits(changed, ranges, 4).select("line", "m")) == [(11, "far"), (11, "one"), (15, "far"), (15, "two")]


def test_cpt_row(spark):
    r = bayes.cpt(spark).where("c1 = 1 AND c2 = 2 AND c3 = 3 AND c4 = 4").first()
    assert [round(r[f"w{k}"], 6) for k in range(1, 5)] == [0.000816, 0.006531, 0.156735, 0.835918]
    assert bayes.cpt(spark).count() == 256


@pytest.mark.parametrize(
    ("edges", "order"),
    [
        ({1: [2], 2: [3, 8], 3: [4], 4: [5, 7], 5: [6], 6: [5, 7], 7: [3, 8]}, "1 2 (3 4 (5 6) 7) 8"),
        ({1: [2, 4], 2: [3], 4: [5, 3], 5: [4]}, "1 2 (4 5) 3"),
        ({1: [2, 4], 2: [3], 3: [1], 4: [3]}, "(1 2 4 3)"),
        ({1: [1]}, "(1)"),
        ({1: [2], 2: [1, 2]}, "(1 (2))"),
        ({1: [1, 2], 2: [1]}, "(1 2)"),
        ({1: [60, 6], 60: [5, 50], 5: [6], 6: [50], 50: [60]}, "1 (6 (50 60) 5)"),
    ],
)
def test_weak_topological_orders(edges, order):
    assert graph._printed(graph.weak_topological_order(edges, 1)) == order


def test_reverse_postorder():
    assert graph.reverse_postorder({1: [4, 2], 2: [3], 3: [4], 4: [5]}, 1) == [1, 2, 3, 4, 5]


def test_trace_join(spark):
    e = spark.createDataFrame([("s1", "k1"), ("s1", "k2"), ("s2", "k2"), ("s2", "k1")], "src string, dst string")
    ends = lambda xs: spark.createDataFrame(xs, "node string, kind string")
    f = taint.flows(e, ends([("s1", "1"), ("s2", "2")]), ends([("k1", "1"), ("k2", "2")]))
    assert rows(f.select("source", "sink")) == [("s1", "k1"), ("s2", "k2")]
    none = spark.createDataFrame([], "node string, kind string")
    assert taint.flows(e, none, ends([("k1", "1")]), none).count() == 0


def test_four_simple_paths(spark):
    e = spark.createDataFrame([("ct", "dec", "df"), ("im", "dec", "df"), ("ct", "dr", "call"), ("im", "dr", "call"), ("ct", "im", "sim"), ("dr", "gen", "sim")], "src string, dst string, kind string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    p = graph.simple_paths(e, one("dec"), one("gen"), 6)
    texts = [r[0] for r in p.select(graph.rendered(F.col("path"), F.col("kinds"))).collect()]
    assert len(texts) == 4 and "dec<--df--ct--call-->dr--sim-->gen" in texts


def test_address_taken(spark):
    e = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    taken = spark.createDataFrame([(2, "b"), (3, "d")], "node long, variable string")
    assert rows(dataflow.address_taken(e, taken).where("node = 4").select("variable")) == [("b",), ("d",)]


def test_levels_and_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (7, 8), (8, 7)], "src long, dst long")
    assert rows(graph.levels(e)) == [(1, 2), (2, 1), (3, 0)]
    assert rows(graph.components(e)) == [(1, 1), (2, 1), (3, 1), (7, 7), (8, 7)]
    assert graph.components(e.where("src > 99")).count() == 0 and graph.levels(e.where("src > 99")).count() == 0


def test_recent(spark):
    log = [(1, 0), (2, 1), (3, 2), (4, 1), (5, 3), (6, 4)]
    a = spark.createDataFrame([("x", s, k) for s, k in log], "part string, seq int, key int")
    assert rows(windows.recent(a, "part", "key", ["seq"], 3).select("key")) == [(1,), (3,), (4,)]


LISTS = [[], [0], [0, 0, 0], [1], [1, 1], [1, 2], [1, 2, 3], [1, 3, 2, 2, 2, 2], [3, 1, 2], [0, 3, 2], [3, 1, 3, 1, 3], [4]]


def test_intersections(spark):
    d = spark.createDataFrame(list(itertools.product(LISTS, LISTS)), "a array<int>, b array<int>")
    for a, b, c in d.select("a", "b", F.array_sort(F.array_intersect("a", "b"))).collect():
        assert c == sorted(set(a) & set(b))


def test_severity(spark):
    order = F.array(*map(F.lit, ("like", "info", "advice", "warning", "error")))
    d = spark.createDataFrame([("error",), ("like",), ("warning",)], "s string")
    assert [r.s for r in d.orderBy(F.array_position(order, F.col("s"))).collect()] == ["like", "warning", "error"]


def test_parsing(spark):
    d = spark.createDataFrame([("int java.util.Map.get(Object,int)", "<a.B: int c(java.lang.String,int)>"), ("void A.b()", "<a.B: void c()>")], "id string, fact string")
    assert rows(d.select(*parse_method_id(F.col("id")).values())) == [("int", "java.util.Map", "get", "Object,int"), ("void", "A", "b", "void")]
    assert rows(d.select(*parse_method_fact(F.col("fact")).values())) == [("a.B", "int", "c", "java.lang.String,int"), ("a.B", "void", "c", "void")]
    assert parse_jni("(ILjava/lang/String;[[J)V") == (["int", "java.lang.String", "long[][]"], "void")
    for bad in ("", "(I", "(Q)V", "()VV"):
        with pytest.raises(ValueError):
            parse_jni(bad)


def test_polynomials(spark):
    d = spark.createDataFrame([("3 + 2 ⋅ n ⋅ m", 2), ("5 ⋅ n^3 + m", 3), ("7", 0)], "p string, d int")
    assert all(r[0] == r[1] for r in d.select(values.polynomial_degree(F.col("p")), "d").collect())


def test_automaton(spark):
    e = spark.createDataFrame([(1, 1, "hasNext"), (1, 2, "next"), (1, 3, "next"), (2, 1, "hasNext"), (2, 2, "next")], "t int, s int, p string")
    t = automata.Transition
    prop = automata.Property("twice", (t("start", "start"), t("start", "ok", "hasNext"), t("ok", "used", "next"), t("used", "ok", "hasNext"), t("used", "error", "next")))
    assert rows(automata.run_property(e, prop, "t", "s", "p")) == [(1, 3, "twice")]


def test_ctl(spark):
    n = spark.createDataFrame([(k,) for k in range(1, 8)], "node long")
    e = spark.createDataFrame([(k // 2, k) for k in range(2, 8)], "parent long, child long")
    m = automata.Tree(n, e)
    at = lambda *ks: n.where(F.col("node").isin(*ks))
    got = lambda d: sorted(r[0] for r in d.collect())
    assert got(m.ef(at(5))) == [1, 2, 5] and got(m.af(at(4, 5))) == [2, 4, 5] and got(m.ax(at(6, 7))) == [3, 4, 5, 6, 7]
    assert got(m.eg(at(1, 3, 7))) == [1, 3, 7] and got(m.eh(at(3))) == [6, 7] and got(m.au(at(1, 2, 3), at(4, 5, 6, 7))) == [1, 2, 3, 4, 5, 6, 7]


def test_upserts(spark):
    a = spark.createDataFrame([("p", 2, 1), ("q", 1, 2)], "k string, rank int, seq int")
    b = spark.createDataFrame([("p", 1, 3), ("q", 1, 4), ("r", 0, 5)], "k string, rank int, seq int")
    assert rows(tables.guarded_upsert(a, b, "k", "rank", "seq")) == [("p", 2, 1), ("q", 1, 4), ("r", 0, 5)]
    with pytest.raises(ValueError):
        tables.exactly(a, 1, "one row")


def test_dominators(spark):
    e = spark.createDataFrame([("g", 1, 2), ("g", 2, 3), ("g", 2, 4), ("g", 3, 5), ("g", 4, 5)], "graph string, src long, dst long")
    d = {}
    for _, n, x, _ in graph.dominators(e, 1).collect():
        d.setdefault(n, set()).add(x)
    assert d == {1: {1}, 2: {1, 2}, 3: {1, 2, 3}, 4: {1, 2, 4}, 5: {1, 2, 5}}


def test_dense_index(spark):
    d = windows.dense_index(spark.range(1000).repartition(7), ["id"])
    assert d.where("id <> index").count() == 0 and d.count() == 1000


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text(",class,name\n0,A,x\n1,B,y\n")
    assert rows(readers.csv(spark, str(tmp_path / "nodes.csv"), "class string, name string")) == [("A", "x"), ("B", "y")]
    assert readers.csvs(spark, [str(tmp_path / "nodes.csv"), str(tmp_path / "missing.csv")], "i string, class string, name string").count() == 2
    (tmp_path / "calls.txt").write_text("a.b -> c.d\nplain\n")
    assert rows(readers.call_edges(spark, str(tmp_path / "calls.txt"))) == [("a.b", "c.d")]
    (tmp_path / "facts.txt").write_text('Source("m","<A: int b()>").\n\n')
    assert rows(readers.datalog_facts(spark, str(tmp_path / "facts.txt"))) == [("Source", "m", "<A: int b()>")]
    (tmp_path / "spec.json").write_text('[{"procedure":"p","kind":"A","kinds":["B"]},{"procedure":"q","index":"2"}]')
    assert rows(readers.taint_specs(spark, str(tmp_path / "spec.json"))) == [("p", "A", "-1"), ("p", "B", "-1"), ("q", "Other", "2")]
    assert readers.report(spark, None).count() == 0 and readers.report(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "samples.json").write_text('[{"test":"t","methods":[{"class":"C","method":"m","signature":"()V"}]}]')
    assert rows(readers.profiler_samples(spark, str(tmp_path / "samples.json"))) == [("t", "C", "m", "()V")]
    d = spark.createDataFrame([("h", "introduced"), ("k", "fixed")], "hash string, status string")
    writers.diff_files(d, str(tmp_path / "out"))
    assert rows(spark.read.json(str(tmp_path / "out" / "status=fixed"))) == [("k",)]
    assert writers.report_lines(d, ["hash", "status"]).first().value == "h, introduced"
    e = spark.createDataFrame([("a", "b", "df")], "src string, dst string, kind string")
    assert writers.dot(e).first().value == '"a" -> "b" [label="df"]'
    assert e.select(writers.literal_list(F.array("src", "dst"))).first()[0] == '["a"; "b"]'
    p = spark.createDataFrame([("a/b/c.java",)], "path string")
    assert rows(readers.descendants(p)) == [("a/b/c.java", "a"), ("a/b/c.java", "a/b")]
    h = spark.createDataFrame([(1, '<a href="#" title="T">x</a>')], "page_id long, html string")
    assert rows(readers.anchors(h)) == [(1, "T", "x")]
    import pyarrow as pa
    import pyarrow.feather as pf

    pf.write_feather(pa.table({"a": [1], "b": ["x"]}), str(tmp_path / "t.feather"))
    assert rows(readers.feather(spark, str(tmp_path / "t.feather"), ["b"])) == [("x",)]
    assert readers.files(spark, str(tmp_path), "*.txt", "facts").count() == 1


def test_streams(spark, tmp_path):
    e = engine.Engine(spark, "file://" + str(tmp_path))
    e.create("test", "col1 int, col2 string")
    e.create("out", "col1 int, col2 string")
    e.insert("test", [{"col1": 1, "col2": "a"}, {"col1": 2}])
    q = e.add("big", "test", lambda s: s.where("col1 > 1"), "out")
    q.awaitTermination()
    assert rows(spark.read.schema(e.streams["out"]).parquet(e.path("out"))) == [(2, None)]
    got = []
    e.add("batches", "test", lambda s: s, lambda df, _: got.extend(df.collect())).awaitTermination()
    assert len(got) == 2 and e.columns("test") == [("col1", "int"), ("col2", "string")]
    e.alter("test", "col3 long")
    e.insert("test", [{"col1": 3, "col3": 9}])
    assert spark.read.schema(e.streams["test"]).parquet(e.path("test")).where("col3 IS NULL").count() == 2
    e.remove("test/big")
    e.drop("test")
    assert "test" not in e.streams and not e.queries
