"""Columnar shredding of nested records.

Every leaf path becomes a column of (repetition level, definition level, value) entries in record order, the
striping that columnar file formats use. Flat tables are rebuilt, one for each repeated ancestor, from the level
sequences alone: a running count of the entries whose repetition level is at most k numbers the elements of the
k-th repeated ancestor, and the definition level tells a missing list, an empty list, a null element and a null
leaf apart.

`shred` works on typed columns with built-in functions only. `shred_json` reads JSON text of unknown layout; it is
the one Python step, as no built-in can walk a document whose fields change their type from file to file.

Defined results: a null record, null or unparsable JSON (or JSON nested deeper than `DEEPEST`) and an empty table give
no entries below level 0; a single object where the document has a list elsewhere counts as a list of one; columns of the input other than the key and the
shredded column are not touched, so their names cannot clash.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from vellumq.session import saved

LEVELS = "path string, seq long, rep int, def int, value string"


def leaf_paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Leaf paths of a type; `[]` marks a repeated step."""
    if isinstance(schema, T.StructType):
        return [p for f in schema.fields for p in leaf_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(schema, T.ArrayType):
        return leaf_paths(schema.elementType, prefix + "[]")
    return [prefix]


def _entries(value: Column, kind: T.DataType, steps: list[str], rep: Column, level: int, depth: int) -> Column:
    """array<struct<rep,def,value>> of one leaf below `value`; `level` is the definition level if value is null."""

    def entry(d: int, v: Column) -> Column:
        return F.array(F.struct(rep.cast("int").alias("rep"), F.lit(d).alias("def"), v.cast("string").alias("value")))

    none = F.lit(None)
    if isinstance(kind, T.StructType):
        f = kind[steps[0]]
        return F.when(value.isNull(), entry(level, none)).otherwise(_entries(value[f.name], f.dataType, steps[1:], rep, level + 1, depth))
    if isinstance(kind, T.ArrayType):
        inner = F.flatten(F.transform(value, lambda x, i: _entries(x, kind.elementType, steps, F.when(i == 0, rep).otherwise(F.lit(depth + 1)), level + 2, depth + 1)))
        return F.when(value.isNull(), entry(level, none)).when(F.size(value) == 0, entry(level + 1, none)).otherwise(inner)
    return F.when(value.isNull(), entry(level, none)).otherwise(entry(level + 1, value))


def shred(df: DataFrame, key: str, column: str, paths: list[str] | None = None) -> DataFrame:
    """Level entries (key, path, seq, rep, def, value) of a typed nested column, for the leaf paths named."""
    kind = df.schema[column].dataType
    wanted = leaf_paths(kind) if paths is None else paths
    cols = []
    for p in wanted:
        steps = [s for s in p.replace("[]", "").split(".") if s]
        cols.append(F.struct(F.lit(p).alias("path"), _entries(F.col(column), kind, steps, F.lit(0), 0, 0).alias("entries")))
    one = df.select(F.col(key).alias("key"), F.explode(F.array(*cols)).alias("c"))
    return one.select("key", F.col("c.path").alias("path"), F.posexplode("c.entries").alias("seq", "e")).select("key", "path", F.col("seq").cast("long").alias("seq"), F.col("e.rep").alias("rep"), F.col("e.def").alias("def"), F.col("e.value").alias("value"))


DEEPEST = 200  # levels of nesting up to which JSON is read


def _too_deep(x: object) -> bool:
    level = [x]
    for _ in range(DEEPEST):
        level = [y for v in level if isinstance(v, (dict, list)) for y in (v.values() if isinstance(v, dict) else v)]
        if not level:
            return False
    return True


def _parsed(text: object) -> object:
    try:
        x = json.loads(text) if isinstance(text, str) else None
    except (ValueError, RecursionError):
        return None
    return None if _too_deep(x) else x


def bare(path: str) -> str:
    return path.replace("[]", "")


def _walk(x: object, path: str, leaves: set[str], lists: set[str]) -> None:
    """Leaf paths as they are written, and the bare paths of lists of objects."""
    if isinstance(x, dict):
        for k, v in x.items():
            _walk(v, f"{path}.{k}" if path else k, leaves, lists)
    elif isinstance(x, list):
        if path and any(isinstance(y, dict) for y in x):
            lists.add(bare(path))
        for y in x:
            _walk(y, path + "[]", leaves, lists)
    else:
        leaves.add(path)


def layout(docs: list[object], child: tuple[str, str] | None = None) -> tuple[list[str], set[str]]:
    """Leaf paths of documents of one layout, and the bare paths that hold lists of objects in any of them.

    A path that is a list of objects somewhere is a list everywhere; `child` (record key, list) names lists of the
    records that have the key. A single object at such a path counts as a list of one.
    """
    leaves: set[str] = set()
    lists: set[str] = set()
    for x in docs:
        _walk(x, "", leaves, lists)
    if child:
        lists |= {f"{bare(p)[: -len(child[0])]}{child[1]}" for p in leaves if bare(p) == child[0] or p.endswith("." + child[0])}

    def marked(path: str) -> str:
        out, plain = [], ""
        for s in path.split("."):
            plain = f"{plain}.{bare(s)}" if plain else bare(s)
            out.append(s + "[]" if plain in lists and not s.endswith("[]") else s)
        # the last step is a leaf: an empty or scalar value in place of a list of objects stays as it is
        return ".".join([*out[:-1], path.split(".")[-1]])

    return sorted({marked(p) for p in leaves} - {""}), lists


class _Node:
    """A step of the merged layout: may be leaf, list and record at once where layouts differ."""

    def __init__(self) -> None:
        self.leaf, self.list, self.kids = False, None, {}

    def add(self, steps: list[str]) -> None:
        if not steps:
            self.leaf = True
        elif steps[0] == "[]":
            self.list = self.list or _Node()
            self.list.add(steps[1:])
        else:
            self.kids.setdefault(steps[0], _Node()).add(steps[1:])


def _tree(paths: list[str]) -> _Node:
    root = _Node()
    for p in paths:
        root.add([s for part in p.split(".") for s in _steps(part)])
    return root


def _steps(part: str) -> list[str]:
    n = part.count("[]")
    name = part.replace("[]", "")
    return ([name] if name else []) + ["[]"] * n


def stripe(doc: object, tree: _Node, lists: set[str]) -> list[tuple[str, int, int, int, str | None]]:
    """(path, seq, rep, def, value) for every path of the layout, absent ones as null entries. A path that ends in []
    tells which elements its list has: the definition level of one that isn't null is one higher."""
    out: list[tuple[str, int, int, int, str | None]] = []
    seqs: dict[str, int] = {}

    def put(path: str, rep: int, d: int, v: str | None) -> None:
        n = seqs[path] = seqs.get(path, -1) + 1
        out.append((path, n, rep, d, v))

    def emit(node: _Node, x: object, path: str, rep: int, d: int, depth: int) -> None:
        if isinstance(x, dict) and node.list is not None and not path.endswith("[]") and bare(path) in lists:
            x = [x]
        if node.leaf:
            scalar = x is not None and not isinstance(x, (dict, list))
            there = scalar or (x is not None and path.endswith("[]"))
            put(path, rep, d + there, (x if isinstance(x, str) else json.dumps(x)) if scalar else None)
        if node.list is not None:
            items = x if isinstance(x, list) else None
            if items:
                for i, y in enumerate(items):
                    emit(node.list, y, path + "[]", rep if i == 0 else depth + 1, d + 2, depth + 1)
            else:
                emit(node.list, None, path + "[]", rep, d + (items is not None), depth + 1)
        known = x if isinstance(x, dict) else None
        for k, kid in node.kids.items():
            emit(kid, known.get(k) if known is not None else None, f"{path}.{k}" if path else k, rep, d + (known is not None), depth)

    emit(tree, doc, "", 0, 0, 0)
    return out


def present_level(path: str) -> int:
    """Definition level from which the node at `path` is there: 1 a step, 2 more for the list around it."""
    level = 0 if not path or path.startswith("[]") else 1
    for part in path.split(".") if path else []:
        n = part.count("[]")
        level += (1 if part.replace("[]", "") or n else 0) + 2 * n
    return level if path else 1


def shred_json(df: DataFrame, key: str, column: str, paths: list[str], lists: set[str]) -> DataFrame:
    """Level entries of JSON text of one known layout for the paths named (see `layout`)."""
    tree = _tree(paths)

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [(k, *e) for k, t in zip(b["key"], b["text"]) for e in stripe(_parsed(t), tree, lists)]
            yield pd.DataFrame(got, columns=["key", "path", "seq", "rep", "def", "value"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInPandas(rows, f"key {kind}, {LEVELS}")


def ordinals(levels: DataFrame, depths: int) -> DataFrame:
    """Adds n1..n<depths>: the number, from 0, of the element of the k-th repeated ancestor within its parent.

    rep <= k-1 starts a new parent (numbering restarts), rep == k the next element. Both are running counts over
    one path of one record.
    """
    run = Window.partitionBy("key", "path").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    out = levels
    for k in range(1, depths + 1):
        out = out.withColumn(f"__p{k}", F.sum((F.col("rep") <= k - 1).cast("int")).over(run))
    for k in range(1, depths + 1):
        within = Window.partitionBy("key", "path", f"__p{k}").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
        out = out.withColumn(f"n{k}", F.sum((F.col("rep") == k).cast("int")).over(within))
    return out.drop(*[f"__p{k}" for k in range(1, depths + 1)])


def typed_child(df: DataFrame, key: str, array: str, leaves: list[str]) -> DataFrame:
    """Flat child table (key, n, leaf...) of array<struct> column `array`, rebuilt from its level sequences.

    n counts from 0 in the order written. Null elements use up their number but give no row; a null or empty array
    gives none; a null leaf of a present element is null. Rows of one key must be distinct beforehand.
    """
    rec = df.select(F.col(key).alias("key"), F.struct(F.col(array).alias("a")).alias("r"))
    paths = [f"a[].{x}" for x in leaves]
    lv = ordinals(shred(rec, "key", "r", paths), 1)
    present = lv.filter(F.col("def") >= 4)  # 1 record, 2 list, 3 element slot, 4 element
    cols = [F.max(F.when(F.col("path") == p, F.col("value"))).alias(x) for p, x in zip(paths, leaves)]
    return present.groupBy("key", F.col("n1").alias("n")).agg(*cols).withColumnRenamed("key", key)


def record_bases(paths: list[str], record_key: str) -> list[str]:
    """Ancestors, repeated or single, whose records carry the leaf `record_key`; "" is the document itself."""
    return sorted({p[: -len(record_key)].removesuffix(".") for p in paths if p == record_key or p.endswith("." + record_key)})


def wanted_paths(paths: list[str], record_key: str, own: list[str], child: str, child_leaves: dict[str, list[str]], above: list[str]) -> list[tuple[str, str, str, str, int, int]]:
    """(path, base, role, name, depth of its record, present level) of the paths that the tables need.

    Each base has the path of its list itself, so which children there are doesn't depend on any leaf of theirs.
    """
    out = []
    for base in record_bases(paths, record_key):
        k, level, at_base = base.count("[]"), present_level(base), f"{base}." if base else ""
        out.append((f"{at_base}{child}[]", base, "child", "", k, level + 3))
        for p in paths:
            rest = p[len(at_base) :]
            if p.startswith(at_base) and rest in {record_key, *own}:
                out.append((p, base, "own", rest, k, level))
            for column, alts in child_leaves.items():
                if p in {f"{at_base}{child}[].{a.partition(':')[0]}" for a in alts}:
                    out.append((p, base, "child", column, k, level + 3))
            at, _, last = p.rpartition(".")
            if last in above and (not at or base.startswith(at + ".")) and at.count("[]") < k:
                out.append((p, base, "above", last, at.count("[]"), present_level(at)))
    return out


def json_tables(df: DataFrame, key: str, column: str, record_key: str, own: list[str], child: str, child_leaves: dict[str, list[str]], above: list[str]) -> tuple[DataFrame, DataFrame]:
    """Flat tables of the records that hold `record_key`, at whatever depth a layout has them, and of their list `child`.

    records: key, base, idx (numbers of the record in each repeated ancestor), record_key, own leaves, and the
    nearest value of each `above` leaf of an enclosing record. children: key, base, idx, n, leaves. (key, base, idx)
    links the two. `child_leaves` gives for each column the places it may stand at, "a.b" or "list[]:position".
    Both tables are rebuilt from the level sequences alone. Each document has its own layout, so names that change
    from document to document cost nothing, and nothing about paths goes to the driver but the greatest depth.
    """
    spark, kind = df.sparkSession, df.schema[key].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = []
            for k, t in zip(b["key"], b["text"]):
                doc = _parsed(t)
                paths, lists = layout([doc], (record_key, child))
                need = wanted_paths(paths, record_key, own, child, child_leaves, above)
                roles: dict[str, list[tuple]] = {}
                for p, *rest in need:
                    roles.setdefault(p, []).append(tuple(rest))
                got += [(k, *e, r) for e in stripe(doc, _tree(sorted(roles)), lists) for r in [roles[e[0]]]]
            yield pd.DataFrame(got, columns=["key", "path", "seq", "rep", "def", "value", "roles"])

    lv = saved(df.select(F.col(key).alias("key"), F.col(column).alias("text")).mapInPandas(rows, f"key {kind}, {LEVELS}, roles array<struct<base:string,role:string,name:string,k:int,level:int>>"))
    deepest = lv.agg(F.max(F.length("path") - F.length(F.replace("path", F.lit("[]"), F.lit("["))))).first()[0] or 1
    lv = ordinals(lv, deepest)
    idx = F.array(*[F.col(f"n{i}") for i in range(1, deepest + 1)])
    e = lv.withColumn("all", idx).select("key", "path", "seq", "rep", "def", "value", "all", F.explode("roles").alias("r")).select("*", "r.*").drop("r")
    e = e.filter(F.col("def") >= F.col("level")).withColumn("idx", F.slice("all", 1, F.col("k")))
    link = ["key", "base", "idx"]

    def leaf(names: list[str]) -> list[Column]:
        return [F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names]

    records = e.filter("role = 'own'").groupBy(*link).agg(*leaf([record_key, *own]))
    for a in above:
        # innermost first: the deepest enclosing record that has a value
        up = e.filter((F.col("role") == "above") & (F.col("name") == a) & F.col("value").isNotNull()).select("key", "base", F.col("idx").alias("up"), F.col("k").alias("up_k"), F.length("path").alias("up_l"), F.col("value").alias("up_v"))
        near = records.select(*link).join(up, ["key", "base"]).filter(F.slice("idx", 1, F.col("up_k")) == F.col("up")).groupBy(*link).agg(F.max_by("up_v", F.struct("up_k", "up_l")).alias("above_" + a))
        records = records.join(near, link, "left")
    at = F.element_at(F.col("all"), F.size(F.split("path", r"\[\]", -1)) - 1)
    c = e.filter("role = 'child'").withColumn("n", F.element_at("all", F.col("k") + 1))
    agg = []
    for name, alts in child_leaves.items():
        picks = []
        for a in alts:
            rel, _, pos = a.partition(":")
            hit = (F.col("name") == name) & F.expr(f"endswith(path, '{child}[].{rel}')")
            if pos:
                hit = hit & (at == int(pos))
            picks.append(F.max(F.when(hit, F.col("value"))))
        agg.append(F.coalesce(*picks).alias(name))
    children = c.groupBy(*link, "n").agg(*agg)
    return records.withColumnRenamed("key", key), children.withColumnRenamed("key", key)
