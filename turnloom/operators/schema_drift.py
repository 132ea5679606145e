"""Schemas that drift between files: a catalogue of column lifespans, the changes and one table.

Every file is reduced to its leaf paths and types (the footer of a JSON file).
The catalogue then works on (file, path) rows only: ``lag`` over the files of a
feed gives starts and endings, islands of equal type give lifespans, and a start
and an ending of the same file whose content agrees are a renaming. Renamings
feed an alias table from which the casts of the consistent table are made.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.sources.tables import keep, parallel

#: Length of a content profile: hashed value shapes of a path.
BUCKETS = 256
#: Least cosine of two content profiles, names counted in, for a renaming.
ALIKE = 0.5


def leaves(value, path: str = "", many: bool = False) -> Iterator[tuple[str, object, bool]]:
    """(path, value, whether it lies inside an array of objects) of all leaves; arrays of objects are walked through."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from leaves(v, f"{path}.{k}" if path else k, many)
    elif isinstance(value, list) and any(isinstance(v, (dict, list)) for v in value):
        for v in value:
            if isinstance(v, (dict, list)):
                yield from leaves(v, path, True)
            else:
                yield path, v, True
    elif path:
        yield path, value, many


def type_of(value) -> str:
    """Type name of a leaf; ``null`` and ``nothing`` (an empty array) may stand for any content."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "integer"
    if isinstance(value, float):
        return "number"
    if isinstance(value, list):
        return "array" if value else "nothing"
    return "string"


_NUMBER = re.compile(r"^-?\d+(\.\d+)?$")
_STAMP = re.compile(r"\d{4}-\d\d-\d\d")
_YES_NO = {"true": "yes", "false": "no", "1": "yes", "0": "no", "yes": "yes", "no": "no"}


def shapes(value) -> list[str]:
    """What a leaf value looks like, the same after a change of type or notation."""
    if value is None:
        return []
    if isinstance(value, list):
        return [s for v in value if not isinstance(v, (dict, list)) for s in shapes(v)]
    if isinstance(value, bool):
        return [f"b:{'yes' if value else 'no'}"]
    text = str(value).strip().lower()
    if _NUMBER.match(text):
        x = float(text)
        if x == int(x) and abs(x) >= 1e8:
            return ["t:stamp"]
        if "." in text and x != int(x):
            return [f"f:{len(text.split('.')[1])}", f"f:{'0..1' if 0 <= x <= 1 else int(math.log2(abs(x) + 1))}"]
        return [f"i:{int(x)}" if 0 <= x <= 12 else f"i:2^{int(math.log2(abs(x) + 1))}"]
    if text in _YES_NO:
        return [f"b:{_YES_NO[text]}"]
    if _STAMP.search(text):
        return ["t:stamp"]
    return [f"w:{w}" for w in re.findall(r"\w+", text)]


def _buckets(value, known: dict) -> list[int]:
    """The content buckets of a value's shapes, remembered for short texts and numbers."""
    key = (type(value), value) if isinstance(value, (str, int, float)) and len(str(value)) < 80 else None
    if key is not None and key in known:
        return known[key]
    got = [zlib.crc32(s.encode()) % BUCKETS for s in shapes(value)]
    if key is not None:
        if len(known) > 100_000:
            known.clear()
        known[key] = got
    return got


def inventory(records: DataFrame) -> DataFrame:
    """Counts by ``feed, file_name, written_at, path, kind, slot``: types (slot -1), content buckets, and paths inside
    arrays of objects (``many``).

    Counted inside each batch before anything is shuffled, so a feed with a
    third of all lines weighs no more than its number of files and paths.
    Broken lines, and lines that are no JSON object, are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            types: Counter = Counter()
            content: Counter = Counter()
            wide: set = set()
            for feed, name, at, raw in zip(batch["feed"], batch["file_name"], batch["written_at"], batch["raw"]):
                try:
                    record = json.loads(raw)
                except (TypeError, ValueError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                for path, value, many in leaves(record):
                    types[feed, name, at, path, type_of(value)] += 1
                    for bucket in _buckets(value, known):
                        content[path, bucket] += 1
                    if many:
                        wide.add(path)
            rows = [(*k, -1, n) for k, n in types.items()] + [(None, None, None, path, "content", slot, n) for (path, slot), n in content.items()] + [(None, None, None, path, "many", -2, 1) for path in wide]
            yield pd.DataFrame(rows, columns=["feed", "file_name", "written_at", "path", "kind", "slot", "n"]).astype({"slot": "int32", "n": "int64"})

    found = parallel(records.select("feed", "file_name", F.date_format("written_at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("written_at"), "raw")).mapInPandas(run, "feed string, file_name string, written_at string, path string, kind string, slot int, n bigint")
    return keep(found.groupBy("feed", "file_name", "written_at", "path", "kind", "slot").agg(F.sum("n").alias("n")))


def lifespans(inv: DataFrame) -> DataFrame:
    """``feed, file_no, file_name, path, type``: each path of each file, files numbered by time.

    The type is the most frequent one; integers beside fractions are numbers.
    Paths that only ever hold null keep the type ``null``. A null, or an empty
    array, at a place where records of the same feed have objects is no path.
    """
    by = ["feed", "file_name", "written_at", "path"]
    plain = F.when(F.col("kind") == "nothing", "array").otherwise(F.col("kind"))
    types = inv.where(F.col("slot") == -1).groupBy(*by).agg(
        F.sum(F.when(F.col("kind") == "number", F.col("n"))).alias("numbers"),
        F.max_by(plain, F.when(F.col("kind") == "null", -2).when(F.col("kind") == "nothing", -1).otherwise(F.col("n"))).alias("top"),
        F.bool_and(F.col("kind").isin("null", "nothing")).alias("bare"),
    )
    types = types.withColumn("type", F.when((F.col("top") == "integer") & (F.col("numbers") > 0), "number").otherwise(F.col("top")))
    parts = F.split("path", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "."))
    prefixes = types.select("feed", "path").distinct().where(F.size(parts) > 1).select("feed", F.explode(above).alias("path")).distinct().withColumn("object", F.lit(True))
    real = types.join(prefixes, ["feed", "path"], "left").where(F.col("object").isNull() | ~F.col("bare"))
    order = real.select("feed", "file_name", "written_at").distinct().withColumn("file_no", F.row_number().over(Window.partitionBy("feed").orderBy("written_at", "file_name")))
    return keep(real.join(order, ["feed", "file_name", "written_at"]).select("feed", "file_no", "file_name", "path", "type"))


def _profiles(inv: DataFrame) -> DataFrame:
    """``path, profile``: unit vectors over the content buckets of a path, all files together."""
    counts = inv.where(F.col("kind") == "content").groupBy("path", "slot").agg(F.sqrt(F.sum("n").cast("double")).alias("w"))
    vec = counts.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("slot", "w"))).alias("m"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return vec.select("path", F.transform_values("m", lambda _, w: w / F.col("norm")).alias("profile"))


def _name_alike(a, b):
    """Share of the shorter last name part found in the other, case and underscores aside."""
    last = lambda p: F.lower(F.regexp_replace(F.element_at(F.split(p, r"\."), -1), "_", ""))
    x, y = last(a), last(b)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.7).otherwise(F.greatest(F.lit(0.0), 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))))


def changes(records: DataFrame) -> DataFrame:
    """``feed, file_name, change, field, new_field`` of each file against the one before it in its feed.

    ``added``, ``removed``, ``renamed`` or ``type_changed``; the first file of
    a feed gives none. Files without any sound line are no files. Repeated
    lines change nothing, since only presence and type count. Two files written
    at one time are ordered by name. Null feeds or names form a feed or file of
    their own.
    """
    inv = inventory(records.select(F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce("file_name", F.lit("")).alias("file_name"), "written_at", "raw"))
    return _changes(inv)


def _changes(inv: DataFrame) -> DataFrame:
    life = lifespans(inv)
    files = life.select("feed", "file_no", "file_name").distinct()
    # an island of a path is a run of file numbers; its start has no row at the number before, its end none after
    by_path = Window.partitionBy("feed", "path").orderBy("file_no")
    seen = life.withColumn("before", F.lag("file_no").over(by_path)).withColumn("type_before", F.lag("type").over(by_path)).withColumn("after", F.lead("file_no").over(by_path))
    starts = seen.where((F.col("file_no") > 1) & F.coalesce(F.col("before") < F.col("file_no") - 1, F.lit(True))).select("feed", "file_no", "file_name", F.col("path").alias("new_path"))
    ends = (
        seen.where(F.coalesce(F.col("after") > F.col("file_no") + 1, F.lit(True)))
        .select("feed", (F.col("file_no") + 1).alias("file_no"), F.col("path").alias("old_path"))
        .join(files, ["feed", "file_no"])
    )
    retyped = seen.where((F.col("before") == F.col("file_no") - 1) & (F.col("type") != F.col("type_before")) & (F.col("type") != "null") & (F.col("type_before") != "null"))
    profiles = _profiles(inv)
    of = lambda name: profiles.select(F.col("path").alias(name), F.col("profile").alias(f"{name}_profile"))
    pairs = ends.join(starts, ["feed", "file_no", "file_name"]).join(of("old_path"), "old_path", "left").join(of("new_path"), "new_path", "left")
    dot = F.aggregate(F.map_entries("old_path_profile"), F.lit(0.0), lambda acc, e: acc + e["value"] * F.coalesce(F.element_at("new_path_profile", e["key"]), F.lit(0.0)))
    scored = pairs.withColumn("score", F.coalesce(dot, F.lit(0.0)) * 0.8 + 0.2 * _name_alike(F.col("old_path"), F.col("new_path"))).where(F.col("score") >= ALIKE)
    best = lambda side: Window.partitionBy("feed", "file_no", side).orderBy(F.desc("score"), "old_path", "new_path")
    renamed = keep(scored.withColumn("a", F.row_number().over(best("old_path"))).withColumn("b", F.row_number().over(best("new_path"))).where("a = 1 and b = 1").select("feed", "file_no", "file_name", "old_path", "new_path"))
    out = lambda df, change, field, new: df.select("feed", "file_name", F.lit(change).alias("change"), F.col(field).alias("field"), new.alias("new_field"))
    no = F.lit("")
    return (
        out(starts.join(renamed, ["feed", "file_no", "new_path"], "left_anti"), "added", "new_path", no)
        .unionByName(out(ends.join(renamed, ["feed", "file_no", "old_path"], "left_anti"), "removed", "old_path", no))
        .unionByName(out(renamed, "renamed", "old_path", F.col("new_path")))
        .unionByName(out(retyped, "type_changed", "path", no))
    )


def aliases(found: DataFrame, inv_paths: DataFrame) -> dict[str, str]:
    """Every path to its canonical name: connected renamings take the path most files hold.

    The number of distinct paths is the width of the schema, not of the data;
    more than 10,000 of them raise an error instead of filling the driver.
    """
    counts = {r["path"]: r["n"] for r in inv_paths.groupBy("path").count().withColumnRenamed("count", "n").limit(10_001).toLocalIterator()}
    if len(counts) > 10_000:
        raise ValueError("more than 10,000 leaf paths: the records hold data in their keys")
    root = {p: p for p in counts}

    def find(p: str) -> str:
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    edges = found.where(F.col("change") == "renamed").groupBy("field", "new_field").count()
    for r in edges.toLocalIterator():
        a, b = sorted((find(r["field"]), find(r["new_field"])), key=lambda p: (-counts.get(p, 0), p))
        root[b] = a
    return {p: find(p) for p in root}


def consistent(records: DataFrame) -> DataFrame:
    """One row per sound record: ``feed, file_name, line_no`` and one typed column per field, whatever its file called it.

    Columns are the canonical paths of the alias table with ``__`` for the dots
    (a name that stands already gets a number); their type is the widest that
    any file uses (array over string over number over integer over boolean), and
    values are cast to it. Fields inside arrays of objects are arrays over their
    occurrences in order. Absent fields are null; repeated lines stay; fields
    that never hold a value have no column. No sound line at all gives the three
    columns alone.
    """
    inv = inventory(records.select(F.coalesce("feed", F.lit("")).alias("feed"), F.coalesce("file_name", F.lit("")).alias("file_name"), "written_at", "raw"))
    found = keep(_changes(inv))
    types = inv.where((F.col("slot") == -1) & ~F.col("kind").isin("null", "nothing"))
    alias = aliases(found, types.select("feed", "file_name", "path").distinct())
    width = ["boolean", "integer", "number", "string", "array"]
    wide: dict[str, str] = {}
    for r in types.select("path", "kind").distinct().toLocalIterator():
        c = alias.get(r["path"], r["path"])
        wide[c] = max(wide.get(c, "boolean"), r["kind"], key=width.index)
    many = {alias.get(r["path"], r["path"]) for r in inv.where(F.col("kind") == "many").select("path").toLocalIterator()}
    spark_type = {"boolean": T.BooleanType(), "integer": T.LongType(), "number": T.DoubleType(), "string": T.StringType(), "array": T.ArrayType(T.StringType())}
    taken, columns = {"feed", "file_name", "line_no"}, {}
    schema = T.StructType([T.StructField("feed", T.StringType()), T.StructField("file_name", T.StringType()), T.StructField("line_no", T.IntegerType())])
    for c in sorted(wide):
        name, k = c.replace(".", "__"), 2
        while name.lower() in taken:
            name, k = f"{c.replace('.', '__')}_{k}", k + 1
        taken.add(name.lower())
        columns[c] = name
        schema.add(name, T.ArrayType(spark_type[wide[c]]) if c in many else spark_type[wide[c]])

    def text(value) -> str | None:
        return value if value is None or isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    def cast(value, kind: str):
        if value is None:
            return None
        if kind == "array":
            return [text(v) for v in value] if isinstance(value, list) else [text(value)]
        if isinstance(value, list):
            return None  # an empty array where there are scalars
        if kind == "string":
            return text(value)
        if kind == "number":
            return float(value)
        if kind == "integer":
            return int(value) if abs(int(value)) < 1 << 63 else None
        return value

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for feed, name, line, raw in zip(batch["feed"], batch["file_name"], batch["line_no"], batch["raw"]):
                try:
                    record = json.loads(raw)
                except (TypeError, ValueError, RecursionError):
                    continue
                if not isinstance(record, dict):
                    continue
                row: dict = {"feed": feed, "file_name": name, "line_no": line}
                for path, value, _ in leaves(record):
                    c = alias.get(path, path)
                    if c not in wide:
                        continue
                    if c in many:
                        row.setdefault(columns[c], []).append(cast(value, wide[c]))
                    elif row.get(columns[c]) is None:
                        row[columns[c]] = cast(value, wide[c])
                rows.append(row)
            # objects, so that integers beside nulls stay integers
            yield pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype=object) for f in schema.fields})

    return parallel(records.select("feed", "file_name", "line_no", "raw")).mapInPandas(run, schema)
