"""Schemas that drift between files: versioned fingerprints, migration steps, and one consistent table.

Every file of a stream (here: one pipeline and config kind) is reduced to the *shape* of its fields with their JSON types. The files
lie in one order, stream by stream and by time, cut into ranges of about equal size whatever the streams: a stream that
holds most files fills many ranges, however short the time in which they came. A range is walked file by file with the
fingerprint of the schema in force; only where it changes are fields compared, which gives the migration steps (rename, default, remove, cast)
and begins a new version. What a range must know of the files before it (the types seen last, the shape of the last file) and
of those after it (what becomes of its names) is one small row a range, chained over the ranges.

Each file is then routed through the rules that follow it: values stand under the newest name of their field, fields a
file lacks are there as NULL by default, and values of a field that had several types are cast to the narrowest type that holds
all of them. What was done to a file is recorded in its row; no value is lost.

Defined results: torn payloads and payloads that are no JSON object are left out; a NULL file_path is a path of its own;
files with NULL written_at come first; equal written_at is ordered by record_id; an ``args`` that is no object, or an empty one, is a
field like others; of two fields of a file that lead to one name the one that has it keeps it, the other stays
under its own name and this is recorded; empty input gives empty output; columns of other names are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.session import cut
from chronoloom.sources.tables import micros

Field = tuple[str, str]
#: Written_at of files without one.
FIRST = -(2**62)


def json_kind(value: object) -> str | None:
    """JSON type of a value; null has none. Integers and fractional numbers are two types."""
    for kind, types in (("boolean", bool), ("integer", int), ("fraction", float), ("string", str), ("array", list), ("object", dict)):
        if isinstance(value, types):
            return kind
    return None


def members(payload: str | None) -> dict[Field, object] | None:
    """Members of the top object and of its ``args`` object; None if the text is no JSON object."""
    try:
        top = json.loads(payload) if payload is not None else None
    except (ValueError, RecursionError):
        return None
    if not isinstance(top, dict):
        return None
    args = top.get("args")
    return {("", n): v for n, v in top.items()} | ({("args", n): v for n, v in args.items()} if isinstance(args, dict) else {})


def _shape(found: dict[Field, object]) -> str:
    return json.dumps([(o, n, json_kind(found[o, n])) for o, n in sorted(found)])


def _text(value: object) -> str | None:
    return None if value is None else value if isinstance(value, str) else json.dumps(value, sort_keys=True)


def path_of(config_kind: str | None, owner: str, name: str) -> str:
    return ".".join(p for p in (config_kind, owner, name) if p)


def ordered_files(raw: DataFrame, values: bool = False) -> DataFrame:
    """One row per file, its first record that parses, in ranges (``part``) of the order of stream, time and record_id.

    Written to the shared checkpoint folder, where the walks read it; ranges keep their order and their rows' order there.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [members(p) for p in pdf.pop("payload")]
            keep = [f is not None for f in found]
            found = [f for f in found if f is not None]
            if found:
                vals = [json.dumps([_text(f[k]) for k in sorted(f)]) for f in found] if values else None
                yield pdf[keep].assign(shape=[_shape(f) for f in found], vals=vals)

    stream = F.to_json(F.struct("pipeline_id", "config_kind")).alias("stream")
    rows = raw.select("record_id", stream, "config_kind", "file_path", F.coalesce(micros("written_at"), F.lit(FIRST)).alias("at"), "payload")
    rows = rows.mapInPandas(parse, "record_id long, stream string, config_kind string, file_path string, at long, shape string, vals string")
    rest = ["record_id", "stream", "config_kind", "at", "shape", "vals"]
    files = rows.groupBy("file_path").agg(F.min_by(F.struct(*rest), "record_id").alias("r")).select("file_path", *(f"r.{c}" for c in rest))
    order = ["stream", "at", "record_id"]
    return cut(files.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))


class Schema:
    """The schema in force while the files of a stream are walked: last shape, its known types, types seen last of every field."""

    def __init__(self, types: dict[Field, str] | None = None, shape: str | None = None):
        self.types, self.shape = dict(types or {}), shape
        self.known = None if shape is None else {(o, n): self.types.get((o, n)) for o, n, _ in json.loads(shape)}

    def fingerprint(self) -> int:
        text = json.dumps([(*f, k) for f, k in sorted(self.known.items())])
        return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)

    def take(self, shape: str) -> tuple[bool, list[tuple]]:
        """Go on to the next file: whether a version begins with it, and the steps (owner, name, change, old name, old type, new type)."""
        if shape == self.shape:
            return False, []
        now = {(o, n): k for o, n, k in json.loads(shape)}
        self.types |= {f: k for f, k in now.items() if k is not None}
        known = {f: self.types.get(f) for f in now}
        before, self.shape, self.known = self.known, shape, known
        if before is None:
            return True, []
        return known != before, _steps(before, known) if known != before else []


def _steps(before: dict[Field, str | None], now: dict[Field, str | None]) -> list[tuple]:
    left, came = before.keys() - now.keys(), now.keys() - before.keys()
    out = [(*f, "type_changed", None, before[f], now[f]) for f in before.keys() & now.keys() if now[f] is not None and before[f] is not None and now[f] != before[f]]
    for owner in {o for o, _ in left | came}:
        gone, new = [f for f in left if f[0] == owner], [f for f in came if f[0] == owner]
        alike = [f for f in new if len(gone) == 1 and now[f] is not None and now[f] == before[gone[0]]]
        if len(alike) == 1:
            out.append((*alike[0], "renamed", gone[0][1], before[gone[0]], now[alike[0]]))
            gone, new = [], [f for f in new if f != alike[0]]
        out += [(*f, "added", None, None, now[f]) for f in new] + [(*f, "removed", None, before[f], None) for f in gone]
    return out


def _at_start(files: DataFrame) -> dict[int, tuple]:
    """part -> (stream, types, shape) a range begins with, of ranges whose first stream began before them.

    One row a range comes to the driver: the types of the fields of its last stream.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = stream = shape = None
        types: dict[Field, str] = {}
        for pdf in batches:
            for part, s, text in zip(pdf["part"], pdf["stream"], pdf["shape"], strict=True):
                if s != stream:
                    first, stream, types, shape = first or s, s, {}, None
                if text != shape:
                    shape = text
                    types.update(((o, n), k) for o, n, k in json.loads(text) if k is not None)
        if part is not None:
            yield pd.DataFrame([(part, first, stream, json.dumps([(*f, k) for f, k in types.items()]), shape)], columns=["part", "first", "stream", "types", "shape"])

    out, carry = {}, None
    for r in sorted(files.select("part", "stream", "shape").mapInPandas(ends, "part int, first string, stream string, types string, shape string").collect(), key=lambda r: r.part):
        types = {(o, n): k for o, n, k in json.loads(r.types)}
        if carry and carry[0] == r.first:
            out[r.part] = carry
            types = {**carry[1], **types} if r.first == r.stream else types
        carry = (r.stream, types, r.shape)
    return out


def _walk(pdf: pd.DataFrame, state: list, at_start: dict[int, tuple]) -> Iterator[tuple[bool, list[tuple], Schema]]:
    """What every file of a batch changes; ``state`` (stream, schema) is kept between the batches of a range."""
    for part, stream, shape in zip(pdf["part"], pdf["stream"], pdf["shape"], strict=True):
        if stream != state[0]:
            known = at_start.get(part) if state[0] is None else None
            state[:] = stream, Schema(*known[1:]) if known and known[0] == stream else Schema()
        yield *state[1].take(shape), state[1]


def drift(raw: DataFrame) -> DataFrame:
    """Every change: record_id of the later file, field_path, change_kind (added, removed, renamed, type_changed)."""
    files = ordered_files(raw)
    at_start = _at_start(files)

    def changes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = [None, None]
        for pdf in batches:
            rows = [(record, path_of(kind, owner, name), change) for record, kind, (_, steps, _) in zip(pdf["record_id"], pdf["config_kind"], _walk(pdf, state, at_start), strict=True) for owner, name, change, *_ in steps]
            yield pd.DataFrame(rows, columns=["record_id", "field_path", "change_kind"])

    return files.mapInPandas(changes, "record_id long, field_path string, change_kind string")


def versioned(files: DataFrame) -> DataFrame:
    """The files with ``begins`` (a version begins), ``fingerprint`` of the schema and the ``renames`` of the step before, in the same ranges."""
    at_start = _at_start(files)

    def steps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, last = [None, None], (None, None)
        for pdf in batches:
            out = []
            for begins, made, schema in _walk(pdf, state, at_start):
                if begins or last[0] is not schema:
                    last = schema, schema.fingerprint()
                out.append((int(begins), last[1], json.dumps([(o, old, n) for o, n, change, old, *_ in made if change == "renamed"])))
            if out:
                begins, prints, renames = map(list, zip(*out, strict=True))
                yield pdf.assign(begins=begins, fingerprint=prints, renames=renames)

    return cut(files.mapInPandas(steps, ", ".join(f"{n} {t}" for n, t in files.dtypes) + ", begins int, fingerprint long, renames string"))


def _linked(steps: DataFrame) -> tuple[dict[int, tuple[str, int]], dict[int, tuple[str, dict[Field, str]]]]:
    """For each range: versions of its first stream before it, and what becomes after it of the names of its last stream.

    Renames compose, so a range is one small map; one row a range comes to the driver.
    """

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = first = stream = None
        begun, moves = 0, []
        for pdf in batches:
            for part, s, begins, renames in zip(pdf["part"], pdf["stream"], pdf["begins"], pdf["renames"], strict=True):
                if s != stream:
                    first, stream, begun = first or s, s, 0
                begun += begins
                if s == first and renames != "[]":
                    moves += json.loads(renames)
        if part is not None:
            route: dict[Field, str] = {}
            for o, old, new in reversed(moves):
                route[o, old] = route.get((o, new), new)
            yield pd.DataFrame([(part, first, stream, begun, json.dumps([(*f, n) for f, n in route.items()]))], columns=["part", "first", "stream", "begun", "moves"])

    rows = sorted(steps.select("part", "stream", "begins", "renames").mapInPandas(ends, "part int, first string, stream string, begun long, moves string").collect(), key=lambda r: r.part)
    before, after, carry = {}, {}, None
    for r in rows:
        if carry and carry[0] == r.first:
            before[r.part] = carry
        carry = (r.stream, r.begun + (carry[1] if carry and r.first == r.stream == carry[0] else 0))
    carry = None
    for r in reversed(rows):
        if carry and carry[0] == r.stream:
            after[r.part] = carry
        own, then = {(o, a): b for o, a, b in json.loads(r.moves)}, carry[1] if carry and r.first == r.stream == carry[0] else {}
        carry = (r.first, {**then, **{f: then.get((f[0], b), b) for f, b in own.items()}})
    return before, after


def routed(found: list[tuple[str, str, str | None]], values: list[str | None], route: dict[Field, str], config_kind: str | None) -> tuple[list[tuple], list[str]]:
    """(path, value, type) of every field under its newest name, and what was done for it."""
    fields = [(o, n, k, v) for (o, n, k), v in zip(found, values, strict=True) if (o, n) != ("", "args") or k != "object" or v == "{}"]
    out, done = {}, []
    moved = sorted(fields, key=lambda f: ((f[0], f[1]) in route and route[f[0], f[1]] != f[1], f[0], f[1]))  # a name is its owner's first
    for owner, name, kind, value in moved:
        was, path = path_of(config_kind, owner, name), path_of(config_kind, owner, route.get((owner, name), name))
        if path in out:
            done.append(f"collision {was} -> {path}")
            path = was
            while path in out:
                path += "'"
        elif path != was:
            done.append(f"rename {was} -> {path}")
        out[path] = (path, value, kind)
    return list(out.values()), done


def consistent_table(raw: DataFrame) -> DataFrame:
    """One row per file: record_id, pipeline_id, config_kind, file_path, written_at, version, fingerprint, fields, kinds, applied.

    ``fields`` has every field of the file's stream: newest field path -> value in text form, NULL where the file lacks it. ``kinds`` has the type
    each is cast to: its one type, fraction for integers and fractions, else string (the JSON text). ``applied`` lists the
    rules the file went through: renames, collisions, defaults and casts.
    """
    steps = versioned(ordered_files(raw, values=True))
    before, after = _linked(steps)

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, version, first = None, 0, True
        for pdf in batches:
            out = []
            for part, s, begins in zip(pdf["part"], pdf["stream"], pdf["begins"], strict=True):
                if s != stream:
                    known = before.get(part) if first else None
                    stream, version, first = s, known[1] if known and known[0] == s else 0, False
                version += begins
                out.append(version)
            yield pdf.assign(version=out)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, names, first = None, {}, True
        for pdf in batches:
            out = []
            for part, s, kind, shape, vals, renames in zip(*(pdf[c] for c in ("part", "stream", "config_kind", "shape", "vals", "renames")), strict=True):
                if s != stream:
                    known = after.get(part) if first else None
                    stream, names, first = s, dict(known[1]) if known and known[0] == s else {}, False
                found, done = routed(json.loads(shape), json.loads(vals), names, kind)
                out.append((json.dumps([{"path": p, "value": v, "kind": k} for p, v, k in found]), json.dumps(done)))
                if renames != "[]":
                    for o, old, new in json.loads(renames):
                        names[o, old] = names.get((o, new), new)
            if out:
                yield pdf.assign(found=[f for f, _ in out], done=[d for _, d in out])

    types = dict(steps.dtypes) | {"version": "long", "found": "string", "done": "string"}
    numbered = steps.mapInPandas(number, ", ".join(f"{n} {types[n]}" for n in (*steps.columns, "version")))
    backwards = numbered.sortWithinPartitions(F.desc("stream"), F.desc("at"), F.desc("record_id"))  # each range from its end; no shuffle
    kept = ["record_id", "stream", "config_kind", "file_path", "at", "part", "fingerprint", "version", "found", "done"]
    rows = backwards.mapInPandas(lambda batches: (b[kept] for b in route(batches)), ", ".join(f"{n} {types[n]}" for n in kept))
    rows = cut(rows.withColumn("found", F.from_json("found", "array<struct<path:string,value:string,kind:string>>")).withColumn("done", F.from_json("done", "array<string>")))
    seen = rows.select("stream", F.explode("found").alias("f")).groupBy("stream", "f.path").agg(F.collect_set("f.kind").alias("seen"))
    one = F.when(F.size("seen") <= 1, F.try_element_at("seen", F.lit(1))).when(F.size(F.array_except("seen", F.array(F.lit("integer"), F.lit("fraction")))) == 0, F.lit("fraction")).otherwise(F.lit("string"))
    schema = seen.groupBy("stream").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("path", one.alias("kind"))))).alias("kinds"))
    here = rows.select("stream", "part").distinct().join(schema, "stream")  # a hot stream is joined range by range
    table = rows.join(here, ["stream", "part"], "left").withColumn("kinds", F.coalesce("kinds", F.expr("cast(map() as map<string,string>)")))
    own = F.map_from_entries(F.transform("found", lambda f: F.struct(f["path"], f["value"])))
    absent = F.array_except(F.map_keys("kinds"), F.transform("found", lambda f: f["path"]))
    defaults = F.transform(absent, lambda k: F.concat(F.lit("default "), k))
    casts = F.transform(F.filter("found", lambda f: f["kind"] != F.col("kinds")[f["path"]]), lambda f: F.concat(F.lit("cast "), f["path"], F.lit(" "), f["kind"], F.lit(" -> "), F.col("kinds")[f["path"]]))
    table = table.withColumn("own", own)
    return table.select("record_id", F.get_json_object("stream", "$.pipeline_id").cast("long").alias("pipeline_id"), "config_kind", "file_path", F.timestamp_micros(F.nullif("at", F.lit(FIRST))).alias("written_at"), "version", "fingerprint", F.transform_values("kinds", lambda k, _: F.col("own")[k]).alias("fields"), "kinds", F.concat("done", defaults, casts).alias("applied"))


def cast_field(path: str, kind: str) -> Column:
    """Column of one field of ``consistent_table`` in a Spark type; values that don't fit are NULL."""
    return F.expr(f"try_cast(fields['{path}'] as {kind})")
