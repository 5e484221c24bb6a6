"""Schemas that drift between files: change log and one consistent table.

Each record is parsed once in the JVM as a VARIANT; each file's schema is the vote of its records. The fold over a feed
compares a file with the one before it. Renames are told by type and by the likeness of the values on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from chronoscene.operators.rangescan import prefix_sum
from chronoscene.storage import materialized

#: Most distinct field names that the driver may hold while it lays out the union schema; beyond it the call fails.
MAX_NAMES = 100_000


def promoted(a: str, b: str) -> str:
    """Join of two types in the lattice: equal types stay; scalars meet in string; a scalar and an array in array<string>;
    arrays of different elements in array<string>; anything with an object in json (kept as JSON text)."""
    if a == b:
        return a
    if "json" in (a, b) or "object" in a + b:
        return "json"
    return "array<string>" if "array" in a + b else "string"


def simple_type(schema: Column) -> Column:
    """string, number, boolean, object, array<element> of a ``schema_of_variant`` text; null for JSON null."""
    kind = lambda s: (
        F.when(s.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), "number")
        .when(s.startswith("STRING"), "string")
        .when(s.startswith("BOOLEAN"), "boolean")
        .when(s.startswith("OBJECT"), "object")
        .when(s.startswith("VOID"), F.lit(None))
        .otherwise("mixed")
    )
    inner = F.regexp_extract(schema, "^ARRAY<(.*)>$", 1)
    element = F.when(inner.startswith("ARRAY"), "array").otherwise(F.coalesce(kind(inner), F.lit("null")))
    return F.when(schema.startswith("ARRAY"), F.concat(F.lit("array<"), element, F.lit(">"))).otherwise(kind(schema))


def fields_of(lines: DataFrame, keep: list[str]) -> DataFrame:
    """One row ``(*keep, name, type, value)`` per non-null field of each readable record; ``value`` is its JSON text.

    Broken or null records, and JSON that is no object, give no rows.
    """
    parsed = lines.select(*keep, F.try_parse_json("record").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    entries = F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')"))
    rows = parsed.select(*keep, F.explode(entries).alias("f")).select(
        *keep, F.col("f.key").alias("name"), simple_type(F.schema_of_variant("f.value")).alias("type"), F.to_json("f.value").alias("value")
    )
    return rows.where("type is not null")


def file_schemas(fields: DataFrame, file: list[str]) -> DataFrame:
    """``(*file, name, type)``: each file's fields with the type most of their values have (ties: first by name)."""
    votes = fields.groupBy(*file, "name", "type").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("type").alias("type")))
    return votes.groupBy(*file, "name").agg(best.alias("best")).select(*file, "name", F.col("best.type").alias("type"))


def _words(name: Column) -> Column:
    spaced = F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_distinct(F.filter(F.split(F.lower(spaced), "[^a-z0-9]+"), lambda w: w != ""))


def _grams(name: Column) -> Column:
    """Distinct letter triples of a name without separators."""
    flat = F.concat(F.lit("^"), F.regexp_replace(F.lower(name), "[^a-z0-9]", ""), F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(flat) - 2, F.lit(1))), lambda i: F.substring(flat, i, F.lit(3))))


def _jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))


def value_profile(fields: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, token, share)``: what the values of a field are made of, as a unit vector.

    Tokens are words of the JSON text with digits as 9, the shape of the whole text (a hash of the marks around them), and the number of array elements.
    """
    text = F.regexp_replace(F.lower("value"), "[0-9]+", "9")
    marks = F.regexp_replace(F.regexp_replace(text, "[a-zà-ÿ]+", "a"), r"(a )+a", "a")
    tokens = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit("([a-zà-ÿ]+|9[^a-z]*9|9)"), F.lit(1)), lambda w: F.concat(F.lit("w:"), w)),
        F.array(F.concat(F.lit("s:"), F.xxhash64(marks)), F.concat(F.lit("n:"), F.size(F.split("value", '","')))),
    )
    counts = fields.select(*keys, F.explode(tokens).alias("token")).groupBy(*keys, "token").agg(F.count("*").alias("n"))
    norm = counts.groupBy(*keys).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, keys).select(*keys, "token", (F.col("n") / F.col("norm")).alias("share"))


def schema_changes(lines: DataFrame, num_partitions: int | None = None, least_likeness: float = 0.35) -> DataFrame:
    """``(feed_id, file_no, file_id, change_kind, old_name, new_name, old_type, new_type)``, file against previous file of the feed.

    ``lines`` has ``feed_id, file_no, file_id, record``; further columns don't matter. Rows with a null among the first
    three are left out. A file without readable records has no fields. Repeated lines count once. ``renamed`` pairs a
    removed with an added field of the same type; of several, the pairs most alike in values and name win, below
    ``least_likeness`` the two are reported as ``removed`` and ``added``. The first file of a feed has no changes.
    """
    lines = lines.where("feed_id is not null and file_no is not null and file_id is not null")
    file = ["feed_id", "file_no", "file_id"]
    votes = lines.dropDuplicates([*file, "record"]) if "line_no" not in lines.columns else lines.dropDuplicates([*file, "line_no", "record"])
    fields = fields_of(votes, file)
    schemas = materialized(file_schemas(fields, file))
    files = lines.select(*file).distinct().withColumn("feed", F.col("feed_id").cast("string")).withColumn("one", F.lit(1))
    numbered = prefix_sum(files, "feed", ["file_no", "file_id"], "one", "_b", "rank", num_partitions).select(*file, "rank")
    held = numbered.join(schemas, file, "left").groupBy(*file, "rank").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "type")))).alias("now")
    )
    before = held.select("feed_id", (F.col("rank") + 1).alias("rank"), F.col("now").alias("was"), F.col("file_id").alias("old_file"))
    pairs = held.join(before, ["feed_id", "rank"])
    names = F.array_union(F.map_keys("was"), F.map_keys("now"))
    diff = (
        pairs.select(*file, "old_file", "was", "now", F.explode(names).alias("name"))
        .select(*file, "old_file", "name", F.try_element_at("was", F.col("name")).alias("old_type"), F.try_element_at("now", F.col("name")).alias("new_type"))
        .where("not (old_type <=> new_type)")
    )
    diff = materialized(diff)
    lost = diff.where("new_type is null").select(*file, "old_file", F.col("name").alias("old_name"), F.col("old_type").alias("type"))
    got = diff.where("old_type is null").select(*file, F.col("name").alias("new_name"), F.col("new_type").alias("type"))
    chances = lost.join(got, [*file, "type"])
    wanted = chances.select(F.col("old_file").alias("file_id"), F.col("old_name").alias("name")).union(chances.select("file_id", F.col("new_name").alias("name"))).distinct()
    touched = fields_of(votes.join(wanted.select("file_id").distinct(), "file_id", "left_semi"), file)
    profile = materialized(value_profile(touched.join(wanted, ["file_id", "name"], "left_semi"), ["file_id", "name"]))
    old = profile.select(F.col("file_id").alias("old_file"), F.col("name").alias("old_name"), "token", F.col("share").alias("a"))
    new = profile.select("file_id", F.col("name").alias("new_name"), "token", F.col("share").alias("b"))
    pair = [*file, "type", "old_name", "new_name"]
    alike = (
        chances.join(old, ["old_file", "old_name"])
        .join(new, ["file_id", "new_name", "token"])
        .groupBy(*pair)
        .agg(F.sum(F.col("a") * F.col("b")).alias("values"))
    )
    likeness = F.col("values") + 0.5 * F.greatest(_jaccard(_words(F.col("old_name")), _words(F.col("new_name"))), _jaccard(_grams(F.col("old_name")), _grams(F.col("new_name"))))
    scored = alike.select(*file, F.struct(F.round(-likeness, 9).alias("score"), "old_name", "new_name", "type").alias("p")).where(-F.col("p.score") >= least_likeness)
    # The pairs of one file transition are as many as fields that changed in it; the greedy choice folds over that array.
    taken = F.aggregate(
        F.array_sort(F.collect_list("p")),
        F.expr("cast(array() as array<struct<score:double,old_name:string,new_name:string,type:string>>)"),
        lambda acc, p: F.when(F.exists(acc, lambda q: (q["old_name"] == p["old_name"]) | (q["new_name"] == p["new_name"])), acc).otherwise(F.concat(acc, F.array(p))),
    )
    renamed = scored.groupBy(*file).agg(taken.alias("taken")).select(*file, F.inline("taken"))
    sides = renamed.select(*file, F.explode(F.array(F.struct(F.col("old_name").alias("name"), F.lit(True).alias("gone")), F.struct(F.col("new_name").alias("name"), F.lit(False).alias("gone")))).alias("s")).select(*file, "s.*")
    single = diff.withColumn("gone", F.col("new_type").isNull()).join(sides, [*file, "name", "gone"], "left_anti")
    blank = F.lit("")
    changed = single.select(
        *file,
        F.when(F.col("old_type").isNull(), "added").when(F.col("new_type").isNull(), "removed").otherwise("retyped").alias("change_kind"),
        F.when(F.col("old_type").isNull(), blank).otherwise(F.col("name")).alias("old_name"),
        F.when(F.col("new_type").isNull(), blank).otherwise(F.col("name")).alias("new_name"),
        "old_type",
        "new_type",
    )
    return changed.union(renamed.select(*file, F.lit("renamed"), "old_name", "new_name", F.col("type"), F.col("type")))


def canonical_names(changes: DataFrame) -> dict[str, str]:
    """Field name -> the name its column has in the union table: the first by name of those joined by reported renames.

    Every rename counts, and for all feeds, as a feed may use the new name from its first file on. The driver holds one entry per pair of field names (at most ``MAX_NAMES``).
    """
    links = changes.where("change_kind = 'renamed'").select(F.least("old_name", "new_name").alias("a"), F.greatest("old_name", "new_name").alias("b"))
    rows = links.distinct().limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} pairs of field names")
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for r in rows:
        a, b = find(r.a), find(r.b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def consistent_table(lines: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """All readable records as one table: ``keys``, a column per canonical field, cast to its promoted type, and ``unfitting``.

    Fields that a record lacks are null. Types held by under 1 % of a field's values don't widen it; such stray values become
    null or an approximation where the column is no text. ``unfitting`` (map of name in the record to JSON text, null where
    there is none) keeps the values that their column doesn't show: stray ones and, if a record has a field under two
    names, all but the first by name that fits. Broken lines give no row; repeated lines stay.
    """
    names = canonical_names(changes)
    parsed = lines.select(*keys, F.try_parse_json("record").alias("v")).where(F.schema_of_variant("v").startswith("OBJECT"))
    seen = fields_of(lines, []).groupBy("name", "type").count().limit(MAX_NAMES + 1).collect()
    if len(seen) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} fields and types")
    count: dict[str, dict[str, int]] = {}
    members: dict[str, set[str]] = {}
    for r in seen:
        to = names.get(r["name"], r["name"])
        members.setdefault(to, set()).add(r["name"])
        count.setdefault(to, {})[r["type"]] = count.get(to, {}).get(r["type"], 0) + r["count"]
    columns, left = [], []
    for to in sorted(count):
        total, kind = sum(count[to].values()), None
        for t, n in sorted(count[to].items()):
            if n >= 0.01 * total:
                kind = t if kind is None else promoted(kind, t)
        path = lambda name: F.col("m")[name]
        as_array = lambda v, e: F.coalesce(v.try_cast(f"array<{e}>"), F.when(v.isNotNull(), F.array(F.to_json(v).try_cast(e))))
        value = lambda v: {
            "number": v.try_cast("double"), "boolean": v.try_cast("boolean"), "array<number>": as_array(v, "double"), "array<string>": as_array(v, "string"),
        }.get(kind, F.coalesce(v.try_cast("string"), F.to_json(v)) if kind == "string" else F.to_json(v))
        real = lambda n: F.when(F.schema_of_variant(path(n)) != "VOID", value(path(n)))
        shown = [real(n) for n in sorted(members[to])]
        columns.append(F.coalesce(*shown).alias(to))
        for i, n in enumerate(sorted(members[to])):
            was = simple_type(F.schema_of_variant(path(n)))
            strays = {
                "number": shown[i].isNull() | (was == "boolean"), "boolean": shown[i].isNull() | (was == "number"),
                "array<number>": shown[i].isNull() | (F.exists(shown[i], F.isnull)) | ~was.isin("array<number>", "number"),
            }.get(kind, F.lit(False))
            earlier = F.coalesce(*shown[:i], F.lit(None)).isNotNull() if i else F.lit(False)
            if i or kind in ("number", "boolean", "array<number>"):
                left.append(F.when(path(n).isNotNull() & was.isNotNull() & (strays | earlier), F.struct(F.lit(n).alias("key"), F.to_json(path(n)).alias("value"))))
    kept = F.filter(F.array(*left), F.isnotnull) if left else F.array()
    unfitting = F.when(F.size(kept) > 0, F.map_from_entries(kept)) if left else F.lit(None).cast("map<string,string>")
    extra = "unfitting"
    while extra in count or extra in keys:
        extra += "_"
    return parsed.select(*keys, F.expr("try_variant_get(v, '$', 'map<string,variant>')").alias("m")).select(*keys, *columns, unfitting.alias(extra))
