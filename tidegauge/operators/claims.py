"""Reports and account states as JSON: canonical text and hashes, paths as rows, lossless round trips, and claims that prove themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Instants keep their microseconds on the way through JSON.
_EXACT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
BLOCKS = "array<struct<id:string,kind:string,numbers:map<string,variant>,evidence:array<string>>>"
EVIDENCE = "array<struct<event_id:string,day:string>>"


def canonical(body: Column) -> Column:
    """Compact JSON of a variant: keys are in order at every depth, arrays as they are, 1.0 and 1 the same number."""
    return F.to_json(body)


def canonical_digest(json: Column) -> Column:
    """SHA-256 of the canonical form of a JSON text; null for one that isn't JSON."""
    return F.sha2(canonical(F.try_parse_json(json)), 256)


def leaves(rows: DataFrame, body: str, keys: list[str], depth: int = 12) -> DataFrame:
    """(keys..., path, value): each value of a variant that isn't an object, or is an empty one, by its dotted path.

    Arrays are values. A body is unfolded within its row, a level at a time for as long as it holds objects; one below
    ``depth`` levels raises.
    """
    members = lambda value: F.try_variant_get(value, "$", "map<string,variant>").alias("members")
    is_object = lambda entry: F.coalesce(F.size(entry["members"]) > 0, F.lit(False))
    of = lambda entry: F.transform(F.map_entries(entry["members"]), lambda e: F.struct(F.concat_ws(".", entry["path"], e["key"]).alias("path"), e["value"].alias("value"), members(e["value"])))
    unfolded = lambda entries: F.flatten(F.transform(entries, lambda e: F.when(is_object(e), of(e)).otherwise(F.array(e))))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("path"), F.col(body).alias("value"), members(F.col(body))))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), whole, lambda entries, _: F.when(F.exists(entries, is_object), unfolded(entries)).otherwise(entries))
    level = rows.select(*keys, F.inline(found))
    deeper = F.when(is_object(F.struct("members")), F.raise_error(F.concat(F.lit(f"more than {depth} levels at "), "path")).cast("string"))
    return level.where(F.col("path").isNotNull() & deeper.isNull()).drop("members")


def changes(before: DataFrame, after: DataFrame, body: str, keys: list[str]) -> DataFrame:
    """(keys..., path, old, new) as JSON where two versions of the same bodies differ; a path that one lacks is null there."""
    a, b = (leaves(x, body, keys).select(*keys, "path", canonical(F.col("value")).alias(name)) for x, name in ((before, "old"), (after, "new")))
    return a.join(b, [*keys, "path"], "full_outer").where(~F.col("old").eqNullSafe(F.col("new")))


def state_json(*columns: str) -> Column:
    """The columns as one JSON object that :func:`state_of` reads back without loss."""
    return F.to_json(F.struct(*columns), _EXACT)


def state_of(json: Column, schema: T.StructType) -> Column:
    """A state from its JSON; malformed text raises, for half an account is none."""
    return F.from_json(json, schema, _EXACT | {"mode": "FAILFAST"})


def _number(value: Column) -> Column:
    return F.when(F.schema_of_variant(value).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.variant_get(value, "$", "double"))


def _same(a: Column, b: Column) -> Column:
    """Equal as numbers, else as canonical JSON."""
    return F.coalesce(_number(a) == _number(b), canonical(a) == canonical(b))


def _at(body: Column, path: Column) -> Column:
    """The value at a dotted path of a variant; null where a segment is missing, which a JSON null is not, or has quotes or brackets."""
    steps = F.transform(F.split(path, "\\."), lambda s: F.concat(F.lit('["'), s, F.lit('"]')))
    return F.when(~path.rlike("[\"\\[\\]]"), F.try_variant_get(body, F.concat(F.lit("$"), F.array_join(steps, "")), "variant"))


def claim_problems(reports: DataFrame, body: str, key: str) -> DataFrame:
    """What in ``reports`` (a key and a variant body with blocks and evidence) doesn't prove itself: key, block, problem, path.

    * ``inference_with_numbers``: an inference can't pass for a fact. ``bad_kind``: neither fact nor inference.
    * ``missing_path`` and ``different_number``: a number of a fact isn't in the body at its path, or is another one.
    * ``no_proof``: a fact without numbers and evidence. ``unknown_evidence``: a fact without numbers that names evidence
      (event_id|day) which the body doesn't list.

    A report without problems has no row. Paths are data: each is looked up in the body of its own row, without a join.
    """
    b = F.col(body)
    read = reports.select(F.col(key), b.alias("__body"), F.try_variant_get(b, "$.evidence", EVIDENCE).alias("__known"), F.explode(F.try_variant_get(b, "$.blocks", BLOCKS)).alias("__block"))
    fact = F.col("__block.kind") == "fact"
    numbers = F.coalesce(F.map_entries("__block.numbers"), F.expr("cast(array() as array<struct<key:string,value:variant>>)"))
    named = F.coalesce("__block.evidence", F.expr("cast(array() as array<string>)"))
    known = F.coalesce(F.transform("__known", lambda e: F.concat(e["event_id"], F.lit("|"), e["day"])), F.expr("cast(array() as array<string>)"))
    problem = lambda name, path: F.struct(F.lit(name).alias("problem"), path.cast("string").alias("path"))
    none = F.expr("cast(array() as array<struct<problem:string,path:string>>)")
    by_path = F.filter(
        F.transform(numbers, lambda n: F.when(_at(F.col("__body"), n["key"]).isNull(), problem("missing_path", n["key"])).when(~_same(_at(F.col("__body"), n["key"]), n["value"]), problem("different_number", n["key"]))),
        lambda p: p.isNotNull(),
    )
    by_evidence = F.when(F.size(named) == 0, F.array(problem("no_proof", F.lit(None)))).otherwise(F.transform(F.array_except(named, known), lambda e: problem("unknown_evidence", e)))
    found = (
        F.when((F.col("__block.kind") == "inference") & (F.size(numbers) > 0), F.array(problem("inference_with_numbers", F.lit(None))))
        .when(F.col("__block.kind") == "inference", none)
        .when(~F.coalesce(fact, F.lit(False)), F.array(problem("bad_kind", F.col("__block.kind"))))
        .when(F.size(numbers) > 0, by_path)
        .otherwise(by_evidence)
    )
    return read.select(key, F.col("__block.id").alias("block"), F.explode(found).alias("p")).select(key, "block", "p.problem", "p.path")
