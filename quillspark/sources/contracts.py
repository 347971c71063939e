"""Goal contracts: JSON text into typed rows, and rows into the flat tables that rules work on.

A contract is read once into a struct. JSON scalars keep their kind beside their text (n number, s string,
b boolean, z null, o anything else; null where the key is absent), so 5 and "5" stay apart. Goals, facts,
dependencies, missing fields and policies are arrays within the row; as flat tables they are keyed by
(case, goal position).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

_REF = "STRUCT<goal: STRING, field: STRING, ordinal: INT>"
_FACT = f"field: STRING, op: STRING, value: VARIANT, value_to: VARIANT, value_ref: {_REF}, unit: STRING, currency: STRING, strength: STRING"
_TIME = _FACT.replace("field: STRING, op", "role: STRING, op", 1)
CONTRACT = f"""STRUCT<schema_version: STRING, kind: STRING,
goals: ARRAY<STRUCT<id: STRING, action: STRING, target: STRUCT<name: STRING, type: STRING>, facts: ARRAY<STRUCT<{_FACT}>>, temporal: ARRAY<STRUCT<{_TIME}>>,
depends_on: ARRAY<STRING>, condition: STRUCT<goal: STRING, test: STRUCT<{_FACT}>>, missing: ARRAY<STRUCT<field: STRING, blocks: STRING, reason: STRING>>,
policy: STRUCT<forbid: ARRAY<STRING>, confirm_before: ARRAY<STRING>>, ranking: STRUCT<field: STRING, direction: STRING>,
modifiers: STRUCT<sort: STRUCT<field: STRING, direction: STRING>, limit: INT, compare_count: INT>>>,
context: ARRAY<STRUCT<scope: STRING, {_FACT}>>>"""


def once(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once a row, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def kind_of(value: Column) -> Column:
    """The JSON kind of a VARIANT."""
    return F.when(value.isNotNull(), once(F.schema_of_variant(value), _kind))


def _kind(name: Column) -> Column:
    return (
        F.when(name == "STRING", "s")
        .when(name == "BOOLEAN", "b")
        .when(name == "VOID", "z")
        .when(name.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)"), "n")
        .otherwise("o")
    )


def _scalar(f: Column, name: str) -> list[Column]:
    return [F.try_variant_get(f[name], "$", "string").alias(name), kind_of(f[name]).alias(f"{name}_kind")]


def _fact(f: Column, first: str = "field") -> Column:
    return F.struct(f[first].alias(first), f["op"].alias("op"), *_scalar(f, "value"), *_scalar(f, "value_to"), f["value_ref"].alias("value_ref"), f["unit"].alias("unit"), f["currency"].alias("currency"), f["strength"].alias("strength"))


def _typed(c: Column) -> Column:
    def goal(g: Column) -> Column:
        same = [g[x].alias(x) for x in ("id", "action", "target", "depends_on", "missing", "policy", "ranking", "modifiers")]
        test = F.when(g["condition"].isNotNull(), F.struct(g["condition"]["goal"].alias("goal"), _fact(g["condition"]["test"]).alias("test")))
        return F.struct(*same, F.transform(g["facts"], lambda f: _fact(f)).alias("facts"), F.transform(g["temporal"], lambda t: _fact(t, "role")).alias("temporal"), test.alias("condition"))

    def context(x: Column) -> Column:
        return F.struct(x["scope"].alias("scope"), x["field"].alias("field"), x["op"].alias("op"), *_scalar(x, "value"), *_scalar(x, "value_to"), x["value_ref"].alias("value_ref"), x["unit"].alias("unit"), x["currency"].alias("currency"), x["strength"].alias("strength"))

    return F.struct(c["schema_version"].alias("schema_version"), c["kind"].alias("kind"), F.transform(c["goals"], goal).alias("goals"), F.transform(c["context"], context).alias("context"))


def parsed(raw: Column) -> Column:
    """The contract of a JSON text, null for anything but an object."""
    return once(raw, lambda r: F.when(F.ltrim(r).startswith("{"), once(F.from_json(r, CONTRACT), lambda c: F.when(c.isNotNull(), _typed(c)))))


def number(f: Column, name: str = "value") -> Column:
    """A fact's value as a number, null unless it is a JSON number."""
    return F.when(f[f"{name}_kind"] == "n", f[name].try_cast("double"))


def listed(array: Column, kind: str = "array<string>") -> Column:
    """The array, empty where it is null."""
    return F.coalesce(array, F.array().cast(kind))


@dataclass(frozen=True)
class Contracts:
    """The flat tables of contracts (case, c)."""

    cases: DataFrame

    @property
    def goals(self) -> DataFrame:
        g = self.cases.select("case", "c.schema_version", F.posexplode("c.goals").alias("at", "g"))
        return g.select("case", "schema_version", "at", "g.*")

    @property
    def facts(self) -> DataFrame:
        f = self.goals.select("case", "at", F.posexplode("facts").alias("pos", "f"))
        return f.select("case", "at", "pos", "f.*", number(F.col("f")).alias("number"), number(F.col("f"), "value_to").alias("number_to"))

    @property
    def temporal(self) -> DataFrame:
        f = self.goals.select("case", "at", F.posexplode("temporal").alias("pos", "f"))
        return f.select("case", "at", "pos", "f.*")

    @property
    def edges(self) -> DataFrame:
        """(case, at, id, dep, dep_at): dependencies, with the position of the goal depended on (null if there is none)."""
        ids = F.transform("c.goals", lambda g: g["id"])
        d = self.cases.select("case", F.posexplode("c.goals").alias("at", "g"), ids.alias("ids"))
        d = d.select("case", "at", F.col("g.id").alias("id"), F.explode("g.depends_on").alias("dep"), "ids")
        where = F.array_max(F.filter(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.get(F.col("ids"), i) == F.col("dep")))
        return d.select("case", "at", "id", "dep", where.alias("dep_at"))

    @property
    def missing(self) -> DataFrame:
        m = self.goals.select("case", "at", "action", F.explode("missing").alias("m"))
        return m.select("case", "at", "action", "m.field", "m.blocks")
