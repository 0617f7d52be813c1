"""Schemas that drift between the files of a store.

Method: the lines' own header, the members of each JSON object, is read in
parallel; per file the fields are folded through a type-promotion lattice
(partial aggregates per file, field and type); files are compared with their
predecessors in the store's order of time; renames are confirmed by the values
of entries that both files hold; all files are cast to the union schema, whose fields
are the connected names of renames and whose types are folded over all values. The
jobs that find the schema run while the DataFrame is built.

Defined cases
* a line that is null, empty, blank, cut or not a JSON object does not count;
* a byte order mark before a line is ignored; a member written twice keeps its last value;
* a file without a counting line holds no field (all its predecessor's fields are removed);
* files without a row in the file table take no part; equal `dumped_at` are ordered by file id;
* two types of equal number in a file: the one met first by line number;
* several candidates for one rename: the best by equal values, then by names, one to one;
* names tied by renames, over any number of files and stores, are one field, unless a file
  holds two of them: then only renames within a store tie the names of that store;
* numbers keep all their digits: whole ones are bigint, others decimal, double only where
  they are written with an exponent and the rest has few digits, else text.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources import spill, spread
from .closure import components

#: A field is held by a file if this share of the counting lines give it a value.
HELD_SHARE = 0.1
#: A rename needs so many common entries with both values, and this share of equal ones.
RENAME_ENTRIES, RENAME_SHARE = 3, 0.8

#: A field has a column of its own from this share of all (file, field) pairs, so that there are
#: 1 / COLUMN_SHARE columns at most; the values of rarer fields stay in the map `extra`.
COLUMN_SHARE = 1 / 2000
#: Digits that a double holds exactly, and those of a decimal.
DOUBLE_DIGITS, DECIMAL_DIGITS = 15, 38
#: Files whose names a task remembers.
KNOWN_FILES = 10_000

_WHOLE = r"^-?[0-9]+$"
_PLAIN = r"^-?[0-9]+(\.[0-9]+)?$"
_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([T ][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,9})?)?(Z|[+-][0-9]{2}:[0-9]{2})?)?$"

_FIELD = pa.struct([("name", pa.string()), ("type", pa.string()), ("text", pa.string())])
_DDL = "file_id bigint, line_no int, entry_key string, fetched_at string, fields array<struct<name:string,type:string,text:string>>"


class _Number(str):
    """A number's JSON text as written."""


def _refuse(_: str):
    raise ValueError("no JSON")


def _field(name: str, v) -> dict | None:
    if v is None:
        return None
    if isinstance(v, _Number):
        return {"name": name, "type": "number", "text": str(v)}
    if isinstance(v, bool):
        return {"name": name, "type": "boolean", "text": "true" if v else "false"}
    if isinstance(v, str):
        return {"name": name, "type": "string", "text": v.encode("utf-8", "surrogatepass").decode("utf-8", "replace")}
    return {"name": name, "type": "array" if isinstance(v, list) else "object", "text": None}


def _text(v) -> str | None:
    return str(v) if isinstance(v, str) else None


def _decoder():
    return json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_refuse).decode


def _object(decode, raw: str | None) -> dict | None:
    """A line's members if it counts."""
    if not raw:
        return None
    try:
        o = decode(raw.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    return o if type(o) is dict else None


def _json_text(v) -> str:
    """A value as JSON text without blanks, its numbers as written."""
    if isinstance(v, _Number):
        return str(v)
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{_json_text(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(_json_text, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def parsed_lines(lines: DataFrame) -> DataFrame:
    """The counting lines: file, line, entry key and time, and the members with a value."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder()
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for file_id, line_no, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if (o := _object(decode, raw)) is None:
                    continue
                fields = [f for name, v in o.items() if (f := _field(name, v))]
                for c, v in zip(cols, (file_id, line_no, _text(o.get("key")), _text(o.get("fetched_at")), fields)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.list_(_FIELD)))], ["file_id", "line_no", "entry_key", "fetched_at", "fields"])

    cols = [F.col("file_id").cast("bigint"), F.col("line_no").cast("int"), F.col("raw_line").cast("string")]
    return spread(lines.select(*cols).where("file_id is not null")).mapInArrow(read, _DDL)


def file_order(files: DataFrame) -> DataFrame:
    """Each file with its predecessor in its store by `dumped_at` (repeated file rows are one)."""
    one = files.groupBy("file_id").agg(F.min("store_id").alias("store_id"), F.min("dumped_at").alias("dumped_at"))
    w = Window.partitionBy("store_id").orderBy(F.col("dumped_at").asc_nulls_first(), "file_id")
    return one.select("store_id", "file_id", "dumped_at", F.lag("file_id").over(w).alias("prev_id"), F.row_number().over(w).alias("file_no"))


def by_type(parsed: DataFrame) -> DataFrame:
    """(file_id, name, type, n, first_line, ...): the values of each file, field and type, with
    what their column would need: digits before and after the point, whether all are whole
    numbers of 64 bits, plain numbers, or times."""
    each = parsed.select("file_id", "line_no", F.explode("fields").alias("f")).select("file_id", "line_no", F.col("f.name").alias("name"), F.col("f.type").alias("type"), F.col("f.text").alias("text"))
    number = F.when(F.col("type") == "number", F.col("text"))
    plain = F.when(number.rlike(_PLAIN), F.split(F.ltrim(number, F.lit("-")), r"\.", 2))
    time = (F.col("type") == "string") & F.col("text").rlike(_TIME) & F.col("text").try_cast("timestamp").isNotNull()
    return each.groupBy("file_id", "name", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("line_no").alias("first_line"),
        F.coalesce(F.max(F.length(plain[0])), F.lit(0)).alias("before"),
        F.coalesce(F.max(F.length(F.get(plain, 1))), F.lit(0)).alias("after"),
        F.count_if(number.rlike(_WHOLE) & number.try_cast("bigint").isNotNull()).alias("n_whole"),
        F.count_if(plain.isNotNull()).alias("n_plain"),
        F.count_if(time).alias("n_time"),
    )


def held_fields(parsed: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """(file_id, name, type) of the fields that a file holds, with the type of most values."""
    if counted is None:
        each = parsed.select("file_id", "line_no", F.explode("fields").alias("f")).groupBy("file_id", F.col("f.name").alias("name"), F.col("f.type").alias("type"))
        counted = each.agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))
    held = counted.groupBy("file_id", "name").agg(F.sum("n").alias("n"), F.max(F.struct("n", -F.col("first_line"), "type")).getField("type").alias("type"))
    totals = parsed.groupBy("file_id").agg(F.count(F.lit(1)).alias("n_lines"))
    return held.join(totals, "file_id").where(F.col("n") * 1.0 >= F.col("n_lines") * F.lit(HELD_SHARE) - 1e-9).select("file_id", "name", "type")


def _compared(parsed: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Field by field against the preceding file; and the renames among one-sided fields."""
    held = held_fields(parsed)
    order = file_order(files).where("prev_id is not null").select("file_id", "prev_id")
    after = order.join(held, "file_id").select("file_id", "name", F.col("type").alias("new_type"))
    before = order.join(held.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "name", F.col("type").alias("old_type"))
    sides = spill(after.join(before, ["file_id", "name"], "full_outer"))
    gone, came = sides.where("new_type is null"), sides.where("old_type is null")
    both = gone.select("file_id").distinct().join(came.select("file_id").distinct(), "file_id")
    pairs = order.join(both, "file_id")
    # the entries' values, of one-sided fields only; a line repeated in a file counts once
    def values(side: DataFrame, file_col: str, to: str) -> DataFrame:
        wanted = side.join(pairs, "file_id").select(F.col("file_id").alias("to_id"), F.col(file_col).alias("file_id"), "name")
        flat = parsed.where("entry_key is not null and fetched_at is not null").select("file_id", "line_no", "entry_key", "fetched_at", F.explode("fields").alias("f"))
        flat = flat.select("file_id", "line_no", "entry_key", "fetched_at", F.col("f.name").alias("name"), F.col("f.text").alias("text"))
        return flat.join(wanted, ["file_id", "name"]).groupBy("to_id", "entry_key", "fetched_at", F.col("name").alias(to)).agg(F.min(F.struct("line_no", "text")).getField("text").alias(f"{to}_text"))

    old, new = values(gone, "prev_id", "old_name"), values(came, "file_id", "new_name")
    same = old.join(new, ["to_id", "entry_key", "fetched_at"]).groupBy("to_id", "old_name", "new_name")
    found = same.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old_name_text") == F.col("new_name_text")).alias("n_equal"))
    found = found.where((F.col("n") >= RENAME_ENTRIES) & (F.col("n_equal") * 1.0 >= F.col("n") * F.lit(RENAME_SHARE) - 1e-9))
    return sides, found.withColumnRenamed("to_id", "file_id")


def _one_to_one(found: DataFrame) -> DataFrame:
    """The best rename of each old and each new name of a file (both ways the best)."""
    best = (F.col("n_equal") / F.col("n")).desc(), F.col("n").desc(), "old_name", "new_name"
    by_old, by_new = Window.partitionBy("file_id", "old_name").orderBy(*best), Window.partitionBy("file_id", "new_name").orderBy(*best)
    ranked = found.withColumn("r1", F.row_number().over(by_old)).withColumn("r2", F.row_number().over(by_new))
    return ranked.where("r1 = 1 and r2 = 1").select("file_id", "old_name", "new_name")


def changes(lines: DataFrame, files: DataFrame, parsed: DataFrame | None = None) -> DataFrame:
    """(file_id, change_kind, field_name, old_name) of every change from a store's preceding file."""
    parsed = spill(parsed_lines(lines), batch_rows=4000) if parsed is None else parsed
    sides, found = _compared(parsed, files)
    renamed = spill(_one_to_one(found))
    gone, came = sides.where("new_type is null"), sides.where("old_type is null")
    removed = gone.join(renamed.select("file_id", F.col("old_name").alias("name")), ["file_id", "name"], "left_anti").select("file_id", F.lit("removed").alias("change_kind"), "name", F.lit("").alias("old_name"))
    added = came.join(renamed.select("file_id", F.col("new_name").alias("name")), ["file_id", "name"], "left_anti").select("file_id", F.lit("added").alias("change_kind"), "name", F.lit("").alias("old_name"))
    moved = renamed.join(gone.select("file_id", F.col("name").alias("old_name"), F.col("old_type").alias("t0")), ["file_id", "old_name"]).join(came.select("file_id", F.col("name").alias("new_name"), F.col("new_type").alias("t1")), ["file_id", "new_name"])
    kept = sides.where("new_type is not null and old_type is not null").select("file_id", "name", F.col("old_type").alias("t0"), F.col("new_type").alias("t1"))
    retyped = kept.unionByName(moved.select("file_id", F.col("new_name").alias("name"), "t0", "t1")).where("t0 != t1").select("file_id", F.lit("retyped").alias("change_kind"), "name", F.lit("").alias("old_name"))
    rename_rows = renamed.select("file_id", F.lit("renamed").alias("change_kind"), F.col("new_name").alias("name"), "old_name")
    return removed.unionByName(added).unionByName(retyped).unionByName(rename_rows).withColumnRenamed("name", "field_name")


def change_log(lines: DataFrame, files: DataFrame) -> DataFrame:
    """The changes in order: store, number of the file in its store, its time, and the
    number of the change in its file."""
    found = changes(lines, files).join(file_order(files).select("file_id", "store_id", "file_no", "dumped_at"), "file_id")
    w = Window.partitionBy("file_id").orderBy("change_kind", "field_name", "old_name")
    return found.select("store_id", "file_no", "dumped_at", F.row_number().over(w).alias("change_no"), "file_id", "change_kind", "field_name", "old_name")


def field_names(held: DataFrame, present: DataFrame, files: DataFrame, log: DataFrame) -> DataFrame:
    """(file_id, name, field): the field of the union schema to which each name `present` in a
    file belongs: the most widely held of the names that renames tie it to."""
    order = file_order(files).select("file_id", "store_id")
    spread_ = spill(held.groupBy("name").agg(F.count(F.lit(1)).alias("n_files")))
    renamed = spill(log.where("change_kind = 'renamed'").join(order, "file_id").select("store_id", F.col("old_name").alias("a"), F.col("field_name").alias("b")))
    known = spread_.select("name", F.struct("n_files", "name").alias("rank"))

    def named(comp: DataFrame, by: list[str]) -> DataFrame:
        best = comp.join(known, "name").groupBy(*by).agg(F.max_by("name", "rank").alias("field"))
        return comp.join(best, by)

    comp = spill(components(renamed))
    torn = spill(held.join(comp, "name").groupBy("file_id", "comp").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("comp").distinct())
    whole = named(comp.join(torn, "comp", "left_anti"), ["comp"]).select("name", F.col("field").alias("tied"))
    out = present.select("file_id", "name").distinct().join(order, "file_id").join(spread_.select("name"), "name").join(whole, "name", "left")
    if torn.isEmpty():
        return out.select("file_id", "name", F.coalesce("tied", "name").alias("field"))
    # a name that means two fields somewhere is tied within stores only
    key = lambda n: F.concat_ws("\x00", "store_id", n)
    apart = renamed.join(comp.withColumnRenamed("name", "a"), "a").join(torn, "comp", "left_semi")
    own = components(apart.select(key("a").alias("a"), key("b").alias("b"))).withColumn("store_id", F.substring_index("name", "\x00", 1)).withColumn("name", F.substring_index("name", "\x00", -1))
    local = named(own, ["comp"]).select("store_id", "name", F.col("field").alias("own"))
    return out.join(local, ["store_id", "name"], "left").select("file_id", "name", F.coalesce("tied", "own", "name").alias("field"))


def column_types(counted: DataFrame, held: DataFrame, places: DataFrame) -> DataFrame:
    """(field, type) of the columns. The lattice: bigint below decimal below double for numbers,
    boolean, time, array and object by themselves, text above all. Which of these groups
    count is decided by the types that files hold; within numbers and times all values are
    folded."""
    kinds = held.join(places, ["file_id", "name"]).groupBy("field").agg(F.collect_set("type").alias("kinds"), F.count(F.lit(1)).alias("pairs"))
    fold = counted.join(places, ["file_id", "name"]).groupBy("field").agg(
        F.max("before").alias("before"), F.max("after").alias("after"),
        *[F.sum(F.when(F.col("type") == t, F.col(c)).otherwise(0)).alias(f"{t}_{c}") for t, c in (("number", "n"), ("number", "n_whole"), ("number", "n_plain"), ("string", "n"), ("string", "n_time"))],
    )
    digits = F.col("before") + F.col("after")
    number = (
        F.when(F.col("number_n") == F.col("number_n_whole"), "bigint")
        .when((F.col("number_n") == F.col("number_n_plain")) & (digits <= DECIMAL_DIGITS), F.concat(F.lit("decimal("), digits, F.lit(","), F.col("after"), F.lit(")")))
        .when((F.col("number_n_plain") < F.col("number_n")) & (digits <= DOUBLE_DIGITS), "double")
        .otherwise("string")
    )
    one = F.when(F.size("kinds") == 1, F.get("kinds", 0))
    kind = F.when(one == "number", number).when(one == "string", F.when(F.col("string_n") == F.col("string_n_time"), "timestamp").otherwise("string")).when(one.isNotNull(), one).otherwise("string")
    whole = kinds.agg(F.sum("pairs")).scalar()
    return kinds.join(fold, "field").where(F.col("pairs") >= F.lit(COLUMN_SHARE) * whole).select("field", kind.alias("type"))


def _fits(kind: str):
    """Whether a value can stand in a column of a type."""
    plain, time, whole = re.compile(_PLAIN), re.compile(_TIME), re.compile(_WHOLE)
    if kind == "bigint":
        return lambda f: bool(whole.match(f["text"] or "")) and -(1 << 63) <= int(f["text"]) < 1 << 63
    if kind.startswith("decimal"):
        digits, after = map(int, kind[8:-1].split(","))

        def fits(f: dict) -> bool:
            if not plain.match(f["text"] or ""):
                return False
            a, _, b = f["text"].lstrip("-").partition(".")
            return len(a) <= digits - after and len(b) <= after

        return fits
    if kind == "double":
        return lambda f: f["type"] == "number"
    if kind == "timestamp":
        return lambda f: f["type"] == "string" and bool(time.match(f["text"]))
    if kind in ("boolean", "array", "object"):
        return lambda f: f["type"] == kind
    return lambda f: True


def unified(lines: DataFrame, files: DataFrame) -> DataFrame:
    """All counting lines as one table: file, line and one column f_<field> for each field of
    the union schema, cast to the field's type (arrays and objects as JSON text); members
    without a column, values that their field's type cannot hold and second members of one
    field stay in the map `extra`. The driver reads the columns' names and types only, at
    most 1 / COLUMN_SHARE; which name stands for which column comes to the lines by a join
    with their file."""
    parsed = spill(parsed_lines(lines), batch_rows=4000)
    counted = spill(by_type(parsed))
    held = spill(held_fields(parsed, counted))
    places = spill(field_names(held, counted, files, spill(changes(lines, files, parsed))))
    schema = [(r["field"], r["type"]) for r in column_types(counted, held, places).orderBy("field").collect()]
    at = F.array_position(F.array(*[F.lit(f) for f, _ in schema]).cast("array<string>"), F.col("field"))
    mapped = places.withColumn("at", at).where("at > 0").groupBy("file_id").agg(F.collect_list("name").alias("names"), F.collect_list(F.col("at").cast("int") - 1).alias("columns"))
    held_by = lines.select(F.col("file_id").cast("bigint").alias("file_id"), F.col("line_no").cast("int").alias("line_no"), F.col("raw_line").cast("string").alias("raw_line")).where("file_id is not null")
    kinds = [t for _, t in schema]

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode, fits = _decoder(), [_fits(t) for t in kinds]
        known: dict[int, dict[str, int]] = {}
        for b in batches:
            which, extras, cols = [], [], [[] for _ in kinds]
            names, columns = b.column(3), b.column(4)
            for i, (file_id, raw) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if (o := _object(decode, raw)) is None:
                    continue
                if file_id not in known:
                    if len(known) > KNOWN_FILES:
                        known.clear()
                    known[file_id] = dict(zip(names[i].as_py() or (), columns[i].as_py() or ()))
                of, row, extra = known[file_id], [None] * len(kinds), []
                for name, v in o.items():
                    if (f := _field(name, v)) is None:
                        continue
                    if f["text"] is None:
                        f["text"] = _json_text(v)
                    c = of.get(name)
                    if c is not None and row[c] is None and fits[c](f):
                        row[c] = f["text"]
                    else:
                        extra.append((name, f["text"]))
                which.append(i)
                extras.append(extra)
                for c, v in zip(cols, row):
                    c.append(v)
            take = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), *(pa.array(c, pa.string()) for c in cols), pa.array(extras, pa.map_(pa.string(), pa.string()))], ["file_id", "line_no", *(f"c{i}" for i in range(len(kinds))), "extra"])

    ddl = "file_id bigint, line_no int, " + "".join(f"c{i} string, " for i in range(len(kinds))) + "extra map<string,string>"
    cells = spread(held_by.join(mapped, "file_id", "left").select("file_id", "line_no", "raw_line", "names", "columns")).mapInArrow(cast, ddl)
    typed = [F.col(f"c{i}").try_cast("string" if t in ("array", "object") else t).alias(f"f_{f}") for i, (f, t) in enumerate(schema)]
    return cells.select("file_id", "line_no", *typed, "extra")
