import itertools
import json

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from daftar.operators import drift


def lines(spark, *files):
    rows = [("s", "rows", no, f"f{no}", i, b if isinstance(b, str) or b is None else json.dumps(b)) for no, body in enumerate(files, 1) for i, b in enumerate(body)]
    return spark.createDataFrame(rows, "series string, file_kind string, file_no int, file_name string, line_no int, body string")


def changes(df, **kw):
    return {(r.file_name, r.change_kind, r.old_path, r.new_path) for r in drift.schema_changes(df, **kw).collect()}


def test_each_kind_of_change(spark):
    df = lines(
        spark,
        [{"id": "a", "kind": "direct", "n": 5, "o": {"x": 1, "t": 2.5}}, {"id": "b", "kind": None, "n": 7, "o": {"x": None, "t": 1.5}}],
        [{"id": "a", "category": "direct", "n": "5", "o": {"t": 2.5}, "new": True}],
        [{"id": "a", "category": "colloquial", "n": "6", "o": {"t": 2.5, "x": 3}, "new": True}],
    )
    assert changes(df) == {
        ("f2", "renamed", "kind", "category"), ("f2", "type_changed", "n", "n"), ("f2", "removed", "o.x", ""), ("f2", "added", "", "new"), ("f3", "added", "", "o.x"),
    }


def test_values_that_become_objects_hide_their_inside(spark):
    df = lines(spark, [{"m": "name-1"}], [{"m": {"name": "name-1", "rev": 2}}], [{"model": {"name": "name-2", "rev": 3}}], [{"other": 5}])
    assert changes(df) == {("f2", "type_changed", "m", "m"), ("f3", "renamed", "m", "model"), ("f4", "removed", "model", ""), ("f4", "added", "", "other")}


def test_moves_are_named_or_split(spark):
    df = lines(spark, [{"a": {"x": "same text"}, "b": {"y": 1}}], [{"a": {"z": 1.5}, "b": {"y": 1, "x": "same text"}}])
    assert ("f2", "moved", "a.x", "b.x") in changes(df, moves=True)
    assert {("f2", "removed", "a.x", ""), ("f2", "added", "", "b.x")} <= changes(df)


def test_odd_lines_nulls_and_repeats(spark):
    df = lines(spark, [None, "not json", "[1]", {"a": [], "b": None}], [{"a": [1], "b": None}], [{"a": ["x"], "b": 1}])
    df = df.unionByName(df).withColumn("extra", df.line_no)
    assert changes(df) == {("f2", "type_changed", "a", "a"), ("f3", "type_changed", "a", "a")}
    assert changes(df.limit(0)) == set()


def test_one_consistent_table(spark):
    df = lines(spark, [{"sec": 1.5, "tok": 3, "c": [{"n": 1}]}], [{"seconds": 2.5, "tok": {"value": 4, "unit": "t"}, "c": [{"n": "2"}]}], [{"seconds": 4.0, "tok": 5, "c": []}])
    rows = drift.consistent_table(df).orderBy("file_no").collect()
    assert [(r.rows.seconds, r.rows.tok, [c.n for c in r.rows.c]) for r in rows] == [(1.5, 3, [1]), (2.5, 4, [2]), (4.0, 5, [])]


def test_every_value_can_be_read_back(spark):
    files = [
        [{"x": 1, "i": 1, "e": [3], "o": {"v": 1, "u": "t"}, "k": "p", "l": [{"n": 1}], "m": {"a": 1}, "b": True}] * 3,
        [{"x": 1.4971, "i": "law", "e": ["law-1", "law-59"], "o": 5, "k": {"name": "p", "rev": 2}, "l": [{"n": 2.5}, 7], "m": {"a": 149.5}, "b": "maybe"}],
        [{"x": 2, "i": 1 << 70, "e": [], "o": None, "k": ["p"], "l": {"n": 3}, "m": {}, "b": 5, "z": {}}, "[1]", "no json"],
    ]
    df = lines(spark, *files)
    table = drift.consistent_table(df)
    bodies = {(r.file_name, r.line_no): r.body for r in df.collect()}
    types = {n: t for n, t in table.select("rows.*").dtypes}
    assert types["x"] == "double" and types["e"] == "array<string>" and types["m"] == "struct<a:double>"
    for r in table.collect():
        body, rest = bodies[r.file_name, r.line_no], json.loads(r.rest or "{}")
        try:
            value = json.loads(body)
        except ValueError:
            value = None
        if not isinstance(value, dict):
            assert rest == {"": body}
            continue
        held = r.rows.asDict(recursive=True)
        for name, inner in value.items():
            back = rest.get(name, held[name])
            if isinstance(inner, dict) and name not in rest:
                assert all(rest.get(f"{name}.{k}", back[k]) == v for k, v in inner.items())
            else:
                assert back == inner, name


def test_inside_of_a_renamed_object_is_kept(spark):
    df = lines(spark, [{"a": {"x": 1, "y": "same text"}}], [{"a": {"x": 1, "y": "same text"}}], [{"b": {"x": 2.5, "z": "same text"}}], [{"b": {"x": 2.5, "z": "same text"}}], [{"a": {"x": 3}}])
    rows = drift.consistent_table(df).orderBy("file_no").collect()
    assert [r.rows.a.x for r in rows] == [1, 1, 2.5, 2.5, 3] and all(r.rest is None for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4).flatmap(lambda n: st.integers(n, 5).flatmap(lambda m: st.lists(st.lists(st.integers(0, 20), min_size=m, max_size=m), min_size=n, max_size=n))))
def test_assignment_is_optimal(cost):
    c = np.array(cost, dtype=float)
    got = drift.assignment(c)
    assert len(set(got)) == len(got)
    best = min(sum(c[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(c.shape[1]), c.shape[0]))
    assert sum(c[i, j] for i, j in enumerate(got)) == best
