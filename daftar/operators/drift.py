"""Schemas that drift between the files of a series.

Method: every file's nested layout becomes a tree of typed fields with a small content profile.  A minimum-cost tree
edit script (unordered, children matched within their object by an assignment) turns the tree of one file into the
tree of the next: add, delete, rename and move.  The scripts are compiled into one projection per file, and all lines are
read through them into one table with one set of field names and types.

The scan is reduced to path summaries before the first shuffle, so a file that holds a third of all lines is one row a
field.  Two neighbouring files meet in one small task each; only distinct field names and types, whose number does not
grow with the data, are ever gathered for a series.

Cases: lines that are no JSON objects are counted under the path ``""`` and give no fields; null values have a field but
no type; empty arrays are ``array``; a line delivered twice counts once; the file clock is not looked at; ties between
equally good renames go to the smaller path; an empty table gives no changes.
"""

from __future__ import annotations

import json
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from daftar.session import cut_lineage

KEYS = ["series", "file_kind"]
_PROFILE = ("n", "length", "letters", "digits", "blanks", "magnitude")
_SUMMARY = "series string, file_kind string, file_no int, file_name string, path string, type string, " + ", ".join(f"{c} double" for c in _PROFILE)
#: Content further apart than this can't be the same field under another name.
MOST_CONTENT_DISTANCE = 1.5


def type_of(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    inner = {t for t in map(type_of, value) if t}
    return f"array<{merged(inner)}>" if inner else "array"


def merged(types: set[str]) -> str | None:
    """The type of a field that has been seen with these types."""
    types = {t for t in types if t}
    if {"integer", "number"} <= types:
        types = types - {"integer"}
    arrays = {t for t in types if t.startswith("array")}
    if len(arrays) > 1:
        inner = {t[6:-1] for t in arrays if t != "array"}
        types = types - arrays | {f"array<{merged(inner)}>"}
    return "|".join(sorted(types)) or None


def _profile(value: object) -> tuple[float, ...]:
    if isinstance(value, str):
        letters, digits, blanks = sum(map(str.isalpha, value)), sum(map(str.isdigit, value)), sum(map(str.isspace, value))
        return 1.0, float(len(value)), float(letters), float(digits), float(blanks), 0.0
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return 1.0, 0.0, 0.0, 0.0, 0.0, math.log10(abs(value) + 1) if math.isfinite(value) else 0.0
    if isinstance(value, list):
        parts = [_profile(x) for x in value if not isinstance(x, dict)]
        return tuple(map(sum, zip(*parts))) if parts else (0.0,) * 6
    return (0.0,) * 6


def _walk(value: dict, prefix: str, out: dict) -> None:
    for name, inner in value.items():
        path = prefix + name
        kind, profile = type_of(inner), _profile(inner)
        at = out.setdefault((path, kind), [0.0] * 6)
        for i, x in enumerate(profile):
            at[i] += x
        for child in [inner] if isinstance(inner, dict) else inner if isinstance(inner, list) else ():
            if isinstance(child, dict):
                _walk(child, path + ".", out)


def path_summaries(lines: DataFrame, body: str = "body") -> DataFrame:
    """(series, file_kind, file_no, file_name, path, type, profile sums), partly added up within each Arrow batch."""
    rows = lines.select(*KEYS, "file_no", "file_name", "line_no", body).dropDuplicates(["file_name", "line_no"])

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for key, part in batch.groupby([*KEYS, "file_no", "file_name"], dropna=False, sort=False):
                fields: dict = {}
                for text in part[body]:
                    try:
                        value = json.loads(text) if text is not None else None
                    except ValueError:
                        value = None
                    if isinstance(value, dict):
                        _walk(value, "", fields)
                    else:
                        fields.setdefault(("", None), [0.0] * 6)[0] += 1
                out += [(*key, path, kind, *sums) for (path, kind), sums in fields.items()]
            yield pd.DataFrame(out, columns=[*KEYS, "file_no", "file_name", "path", "type", *_PROFILE])

    parts = rows.mapInPandas(summarise, _SUMMARY)
    return parts.groupBy(*KEYS, "file_no", "file_name", "path", "type").agg(*[F.sum(c).alias(c) for c in _PROFILE])


@dataclass
class Node:
    name: str
    path: str
    type: str | None = None
    profile: np.ndarray = field(default_factory=lambda: np.zeros(6))
    children: dict[str, Node] = field(default_factory=dict)

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children.values())


def tree(rows: list[tuple]) -> Node:
    """(path, type, *profile) rows -> tree; a path seen with several types gets the merged one."""
    kinds, sums = defaultdict(set), defaultdict(lambda: np.zeros(6))
    for path, kind, *profile in rows:
        if path:
            kinds[path].add(kind)
            sums[path] += np.array(profile, dtype=float)
    root = Node("", "")
    for path in sorted(kinds):
        at, done = root, ""
        for name in path.split("."):
            done = f"{done}.{name}" if done else name
            at = at.children.setdefault(name, Node(name, done))
        at.type, at.profile = merged(kinds[path]), sums[path]
    return root


def content_distance(a: Node, b: Node) -> float:
    """How different the content of two fields of one type is; 0 for the same profile."""
    if a.children and b.children:
        same = len(a.children.keys() & b.children.keys())
        return 2.0 * (1 - same / max(len(a.children), len(b.children)))
    na, nb = a.profile[0], b.profile[0]
    if not na or not nb:
        return 0.5
    x, y = a.profile / na, b.profile / nb
    if x[1] or y[1]:
        shares = sum(abs(x[i] / max(x[1], 1e-9) - y[i] / max(y[1], 1e-9)) for i in (2, 3, 4))
        return abs(math.log((x[1] + 1) / (y[1] + 1))) + shares
    return abs(x[5] - y[5])


def assignment(cost: np.ndarray) -> list[int]:
    """Column of each row in the cheapest assignment (rows <= columns), by shortest augmenting paths."""
    n, m = cost.shape
    u, v, way, match = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, dtype=int), np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used[1:]) + 1
            now = cost[i0 - 1, free - 1] - u[i0] - v[free]
            better = now < least[free]
            least[free[better]], way[free[better]] = now[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def edit_script(old: Node, new: Node) -> list[tuple[str, str, str]]:
    """Cheapest (kind, old path, new path) steps from one layout to the next, without moves."""
    steps: list[tuple[str, str, str]] = []
    _edit(old, new, steps)
    return steps


def _edit(old: Node, new: Node, steps: list) -> float:
    cost = 0.0
    for name in sorted(old.children.keys() & new.children.keys()):
        a, b = old.children[name], new.children[name]
        if a.type != b.type and a.type and b.type:
            steps.append(("type_changed", a.path, b.path))
            cost += 1
        cost += _edit(a, b, steps)
    gone = [old.children[x] for x in sorted(old.children.keys() - new.children.keys())]
    come = [new.children[x] for x in sorted(new.children.keys() - old.children.keys())]
    left_over, taken = list(gone), set()
    if gone and come:
        # rename against delete + add: each old field may take a new one of its type, or be deleted (a column of its own)
        cells = np.full((len(gone), len(come) + len(gone)), 1e6)
        inner: dict[tuple[int, int], list] = {}
        for i, a in enumerate(gone):
            cells[i, len(come) + i] = a.size()
            for j, b in enumerate(come):
                if a.type == b.type and a.type and (distance := content_distance(a, b)) < MOST_CONTENT_DISTANCE:
                    inner[i, j] = []
                    # a rename spares the deletion and the addition
                    cells[i, j] = distance / (4 * MOST_CONTENT_DISTANCE) + 0.25 + _edit(a, b, inner[i, j]) - b.size()
        for i, j in enumerate(assignment(cells)):
            if j < len(come) and (i, j) in inner:
                steps.append(("renamed", gone[i].path, come[j].path))
                steps += inner[i, j]
                cost += cells[i, j] + come[j].size()
                taken.add(j)
                left_over.remove(gone[i])
    for a in left_over:
        cost += a.size()
        steps += [("removed", p, "") for p in _paths(a)]
    for j, b in enumerate(come):
        if j not in taken:
            cost += b.size()
            steps += [("added", "", p) for p in _paths(b)]
    return cost


def _paths(node: Node) -> Iterator[str]:
    yield node.path
    for child in node.children.values():
        yield from _paths(child)


def with_moves(steps: list[tuple[str, str, str]], old: Node, new: Node) -> list[tuple[str, str, str]]:
    """The script with a deletion and an addition of the same name and type in two objects joined to a move."""
    kinds = ({n.path: n for n in _nodes(old)}, {n.path: n for n in _nodes(new)})
    gone, come = {s[1] for s in steps if s[0] == "removed"}, {s[2] for s in steps if s[0] == "added"}
    moves = []
    for a in sorted(gone):
        for b in sorted(come):
            x, y = kinds[0][a], kinds[1][b]
            if x.name == y.name and x.type == y.type and content_distance(x, y) < MOST_CONTENT_DISTANCE:
                moves.append(("moved", a, b))
                come.discard(b)
                gone.discard(a)
                break
    drop = {("removed", a, "") for _, a, _ in moves} | {("added", "", b) for _, _, b in moves}
    return [s for s in steps if s not in drop] + moves


def _nodes(node: Node) -> Iterator[Node]:
    for child in node.children.values():
        yield child
        yield from _nodes(child)


_STEP_FIELDS = ("change_kind", "old_path", "new_path", "old_type", "new_type")


def _script(old: list[dict], new: list[dict]) -> list[dict]:
    """Edit script between the fields of two files, with the types on both sides."""
    a, b = (tree([(r["path"], r["type"], *(r[c] for c in _PROFILE)) for r in rows]) for rows in (old, new))
    types = ({n.path: n.type for n in _nodes(a)}, {n.path: n.type for n in _nodes(b)})
    return [dict(zip(_STEP_FIELDS, (*step, types[0].get(step[1]), types[1].get(step[2])))) for step in with_moves(edit_script(a, b), a, b)]


def _scripts(summaries: DataFrame) -> DataFrame:
    """Edit script of each file against the one with the next lower number.

    The fields of a file, as many as its layout has, are one row; a window over the files of a series puts the file before
    beside it."""
    fields = F.collect_list(F.struct("path", "type", *_PROFILE))
    files = summaries.groupBy(*KEYS, "file_no", "file_name").agg(fields.alias("new"))
    files = files.withColumn("old", F.lag("new").over(Window.partitionBy(*KEYS).orderBy("file_no", "file_name"))).where("old is not null")
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in _STEP_FIELDS]))

    @F.arrow_udf(kind)
    def script(old: pa.Array, new: pa.Array) -> pa.Array:
        return pa.array([_script(x, y) for x, y in zip(old.to_pylist(), new.to_pylist())], pa.list_(pa.struct([(c, pa.string()) for c in _STEP_FIELDS])))

    return files.select(*KEYS, "file_no", "file_name", F.explode(script("old", "new")).alias("s")).select(*KEYS, "file_no", "file_name", "s.*")


def _components(edges: set[tuple[str, str]], names: set[str]) -> dict[str, str]:
    """Each name -> the least name it is tied to by renames."""
    root = {n: n for n in names | {x for e in edges for x in e}}

    def find(x: str) -> str:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in sorted(edges):
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {n: find(n) for n in root}


def _leaf_roots(summaries: DataFrame, steps: DataFrame) -> DataFrame:
    """(series, file_kind, hidden): fields that are a leaf in some file of their series, under any of their names.

    Gathers distinct names and renames of a series only."""
    leaf = ~F.col("type").isin("object", "array<object>", "array")
    names = summaries.where("type is not null and path <> ''").groupBy(*KEYS, "path").agg(F.max(leaf).alias("leaf")).select(*KEYS, F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), "leaf")
    renames = steps.where("change_kind = 'renamed'").select(*KEYS, F.col("old_path").alias("a"), F.col("new_path").alias("b"), F.lit(False).alias("leaf")).distinct()

    def close(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        tied = part[part.b.notna()]
        root = _components(set(zip(tied.a, tied.b)), set(part.a))
        leaves = {root[a] for a, is_leaf in zip(part.a, part.leaf) if is_leaf}
        return pd.DataFrame({"series": [key[0]], "file_kind": [key[1]], "hidden": [sorted(n for n, r in root.items() if r in leaves)]})

    return names.unionByName(renames).groupBy(*KEYS).applyInPandas(close, "series string, file_kind string, hidden array<string>")


def schema_changes(lines: DataFrame, moves: bool = False) -> DataFrame:
    """(series, file_kind, file_no, file_name, change_kind, old_path, new_path, old_type, new_type): every change of a file
    against the file of its series and kind with the next lower number.

    With ``moves`` a field that changed its object is one ``moved`` row, else a ``removed`` and an ``added`` one.
    Fields inside a value that is a leaf in another file are left out."""
    summaries = cut_lineage(path_summaries(lines))
    steps = cut_lineage(_scripts(summaries))
    steps = steps.join(_leaf_roots(summaries, steps), KEYS, "left")
    inside: Callable = lambda c: F.exists(F.coalesce("hidden", F.array().cast("array<string>")), lambda h: F.startswith(c, F.concat(h, F.lit("."))))
    steps = steps.where(~inside(F.col("old_path")) & ~inside(F.col("new_path"))).drop("hidden")
    if not moves:
        halves = F.when(
            F.col("change_kind") == "moved",
            F.array(
                F.struct(F.lit("removed").alias("change_kind"), F.col("old_path"), F.lit("").alias("new_path"), F.col("old_type"), F.lit(None).cast("string").alias("new_type")),
                F.struct(F.lit("added").alias("change_kind"), F.lit("").alias("old_path"), F.col("new_path"), F.lit(None).cast("string").alias("old_type"), F.col("new_type")),
            ),
        ).otherwise(F.array(F.struct("change_kind", "old_path", "new_path", "old_type", "new_type")))
        steps = steps.select(*KEYS, "file_no", "file_name", F.explode(halves).alias("s")).select(*KEYS, "file_no", "file_name", "s.*")
    return steps.distinct()


# ---------------------------------------------------------------------------------------------------
# one table


def _integer(value: object) -> int | None:
    try:
        return int(value) if isinstance(value, (int, str)) else int(value) if float(value).is_integer() else None
    except ValueError:
        number = float(value)
        return int(number) if number.is_integer() else None


def _coerce(value: object, kind: str) -> object:
    """A value in the table's type for its field; what can't be read so becomes its JSON text (strings) or null."""
    if value is None:
        return None
    if kind.startswith("array"):
        if isinstance(value, str) and kind != "array<string>":
            value = [x for x in value.replace(";", ",").split(",") if x.strip()]
        inner = kind[6:-1]
        return [_coerce(x, inner) for x in (value if isinstance(value, list) else [value])]
    if kind != "string" and isinstance(value, list) and len(value) == 1:
        value = value[0]
    if isinstance(value, dict):
        scalars = [x for x in value.values() if not isinstance(x, (dict, list))]
        if scalars:
            value = scalars[0]
    try:
        if kind == "integer":
            whole = _integer(value)
            return whole if whole is not None and -(1 << 63) <= whole < 1 << 63 else None
        if kind == "number":
            number = float(value)
            return number if math.isfinite(number) else None
        if kind == "boolean":
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False}.get(str(value).strip().lower())
    except (TypeError, ValueError, OverflowError):
        return None
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _held(value: object, typed: object) -> bool:
    """Whether the typed value says all that the value said; 3 and 3.0 are the same number."""
    if isinstance(value, list):
        return isinstance(typed, list) and len(value) == len(typed) and all(map(_held, value, typed))
    return isinstance(value, bool) == isinstance(typed, bool) and value == typed


def widest(votes: dict[str, int]) -> str:
    """The type that most files use, widened to hold the fractions and the arrays of all others."""
    votes = {t: n for t, n in votes.items() if t != "array" or not any(x.startswith("array<") for x in votes)}
    kind = max(sorted(votes), key=lambda t: votes[t])
    if kind.startswith("array"):
        inner = merged({t[6:-1] for t in votes if t.startswith("array<")})
        return f"array<{inner if inner in ('integer', 'number', 'boolean', 'object') else 'string'}>"
    return "number" if kind == "integer" and "number" in votes else kind


def consistent_schema(summaries: DataFrame, steps: DataFrame) -> tuple[dict[tuple[str, str], str], dict[tuple[str, str], str]]:
    """(kind, path) -> table field, and the type of each field: the names tied by renames in any series are one field under the
    name that most files use, inside the field of their object.  Gathers distinct names and types, never lines."""
    counts = summaries.where("type is not null and path <> ''").groupBy("file_kind", "path", "type").agg(F.count("*").alias("n")).collect()
    edges: dict[str, set] = defaultdict(set)
    for kind, a, b in steps.where("change_kind = 'renamed'").select("file_kind", "old_path", "new_path").distinct().collect():
        edges[kind].add((a, b))
    fields, types = {}, {}
    for kind in sorted({c[0] for c in counts}):
        own = [c for c in counts if c[0] == kind]
        root = _components(edges[kind], {c[1] for c in own})
        weight: dict[str, int] = defaultdict(int)
        for _, path, _, n in own:
            weight[path] += n
        head = {r: min((p for p in root if root[p] == r), key=lambda p: (-weight[p], p)) for r in set(root.values())}
        target = {"": ""}
        for path in sorted(root, key=lambda p: (p.count("."), p)):
            above, name = path.rpartition(".")[0], head[root[path]].rpartition(".")[2]
            if above in target and name and "`" not in name:
                target[path] = f"{target[above]}.{name}" if above else name
        votes: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for _, path, t, n in own:
            if path in target:
                votes[target[path]][t] += n
        best = {t: widest(v) for t, v in votes.items()}
        filled = {t.rpartition(".")[0] for t in best}
        best = {t: b if t in filled or b not in ("object", "array<object>") else "string" if b == "object" else "array<string>" for t, b in best.items()}
        for path, to in target.items():
            parts = to.split(".")
            if to in best and all(best.get(".".join(parts[:i])) in ("object", "array<object>") for i in range(1, len(parts))):
                fields[kind, path], types[kind, to] = to, best[to]
    return fields, types


def _project(value: dict, prefix: str, kind: str, fields: dict, types: dict, rest: dict) -> dict:
    """One line, or one object in it, through the projection compiled for its kind of file.

    ``rest`` gets, by path, each value that the table's fields don't hold as it is."""
    out: dict = {}
    for name, inner in value.items():
        path = f"{prefix}{name}"
        if inner is None:
            continue
        target = fields.get((kind, path))
        key, typed = (target or "").rpartition(".")[2], None
        t = types[kind, target] if target else None
        lost: dict = {}
        if target is None or out.get(key) is not None:
            lost[path] = inner
        elif t == "object":
            if isinstance(inner, dict):
                typed = _project(inner, path + ".", kind, fields, types, lost)
            else:
                lost[path] = inner
        elif t == "array<object>":
            inside: dict = {}
            objects = inner if isinstance(inner, list) else [inner]
            typed = [_project(x, path + ".", kind, fields, types, inside) for x in objects if isinstance(x, dict)]
            if inside or not isinstance(inner, list) or len(typed) < len(inner):
                lost[path] = inner
        else:
            typed = _coerce(inner, t)
            if not _held(inner, typed):
                lost[path] = inner
        rest.update(lost)
        if typed is not None:
            out[key] = typed
    return out


_SQL = {"string": "string", "integer": "bigint", "number": "double", "boolean": "boolean"}


def _ddl(prefix: str, kind: str, types: dict[tuple[str, str], str]) -> str:
    parts = []
    for (k, path), t in sorted(types.items()):
        if k == kind and path.rpartition(".")[0] == prefix:
            if t in ("object", "array<object>"):
                inner = f"struct<{_ddl(path, kind, types)}>"
                sql = inner if t == "object" else f"array<{inner}>"
            elif t.startswith("array<"):
                sql = f"array<{_SQL.get(t[6:-1], 'string')}>"
            else:
                sql = _SQL.get(t, "string")
            parts.append(f"`{path.rpartition('.')[2]}`:{sql}")
    return ",".join(parts)


def consistent_table(lines: DataFrame, body: str = "body") -> DataFrame:
    """(series, file_kind, file_no, file_name, line_no, rest, <kind> struct...): all lines in one schema, read through the compiled scripts.

    One struct column for each kind of file; the schema is the same for every file of every series.  ``rest`` is a JSON object of the
    values of the line that its struct doesn't hold as they are, by their path in the line (a list with such a value is there whole,
    a line that is no JSON object under the path ``""``), or null: each value of a line is in its struct or in ``rest``."""
    summaries = cut_lineage(path_summaries(lines, body))
    steps = _scripts(summaries)
    fields, types = consistent_schema(summaries, steps)
    rows = lines.select(*KEYS, "file_no", "file_name", "line_no", body).dropDuplicates(["file_name", "line_no"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, left = [], []
            for kind, text in zip(batch["file_kind"], batch[body]):
                try:
                    value = json.loads(text) if text is not None else None
                except ValueError:
                    value = None
                rest: dict = {} if isinstance(value, dict) or text is None else {"": text}
                out.append(json.dumps(_project(value, "", kind, fields, types, rest), ensure_ascii=False) if isinstance(value, dict) else None)
                left.append(json.dumps(rest, ensure_ascii=False) if rest else None)
            yield batch.assign(record=out, rest=left)[[*KEYS, "file_no", "file_name", "line_no", "rest", "record"]]

    table = rows.mapInPandas(read, "series string, file_kind string, file_no int, file_name string, line_no int, rest string, record string")
    kinds = sorted({k for k, _ in types})
    columns = [F.when(F.col("file_kind") == k, F.from_json("record", f"struct<{_ddl('', k, types)}>")).alias(k) for k in kinds]
    return table.select(*KEYS, "file_no", "file_name", "line_no", "rest", *columns)
