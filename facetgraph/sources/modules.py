"""Modules of facts as JSON: decoded with a reason for each that is refused, encoded, and joined to projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The version, and the fields of a module.
VERSION = "1"
ENTITY = "kind string, name string, line int, end_line int, indent int, parent string, docstring string, parameters array<string>, decorators array<string>, calls array<string>, call_sequence array<string>, visibility string, bases array<string>, declaration_kind string, type_parameters array<string>, type_constraints array<string>, resolved_calls array<string>, symbol_id string, is_async boolean, parameter_types array<array<string>>, return_type string, type_name string"
FACTS = {
    "entities": ENTITY,
    "objects": "name string, type_name string, line int, scope string, values array<array<string>>, references array<array<string>>",
    "state_machines": "owner string, state_type string, state_variable string, states array<string>, transitions array<struct<source:string,target:string,line:int,event:string,condition:string>>, initial_state string, terminal_states array<string>",
    "timing_flows": "owner string, is_async boolean, events array<struct<order:int,kind:string,line:int,target:string,detail:string>>",
    "input_events": "actor string, component string, event string, handler string, line int, label string, scope string",
    "signals": "name string, line int, owner string, parameters array<string>",
    "diagnostics": "kind string, message string, line int",
}


def _struct(fields: str) -> str:
    """A list of fields as the inside of a struct type."""
    return ", ".join(f"{name}: {kind}" for name, kind in (f.split(" ", 1) for f in fields.split(", ")))


SCHEMA = "schema_version string, language string, " + ", ".join(f"{name} array<struct<{_struct(fields)}>>" for name, fields in FACTS.items()) + ", imports array<string>, module_docstring string"


def _first_fault(items: Column, fault) -> Column:
    """The first fault(item, index) of an array that is not null."""
    return F.get(F.filter(F.transform(items, fault), lambda x: x.isNotNull()), F.lit(0))


def fault(module: Column) -> Column:
    """Why a module is refused, by the first rule that it breaks; null if it is sound."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    at = lambda name, i, rest: F.concat(F.lit(f"common_ir.{name}["), i.cast("string"), F.lit("]"), rest)
    number = lambda c: F.coalesce(c, F.lit(0)).cast("string")
    version = F.coalesce(module["schema_version"], F.lit(""))

    def entity(x: Column, i: Column) -> Column:
        line, end = F.coalesce(x["line"], F.lit(0)), F.coalesce(x["end_line"], F.lit(0))
        span = F.concat(F.lit(" has invalid source range line="), number(x["line"]), F.lit(" end_line="), number(x["end_line"]))
        return F.when(empty(x["kind"]) | empty(x["name"]), at("entities", i, F.lit(".kind and name are required"))).when((line < 1) | (end < line), at("entities", i, span))

    def diagnostic(x: Column, i: Column) -> Column:
        return F.when(empty(x["kind"]) | empty(x["message"]), at("diagnostics", i, F.lit(".kind and message are required"))).when(x["line"] < 1, at("diagnostics", i, F.lit(".line must be a positive integer when present")))

    rules = [
        F.when(version == "", "payload.schema_version is required"),
        F.when(version != VERSION, F.concat(F.lit('unsupported Common IR schema_version "'), version, F.lit(f'" (supported: "{VERSION}")'))),
        F.when(empty(module["language"]), "common_ir.language is required"),
        *[F.when(module[c].isNull(), f"common_ir.{c} must be a JSON array") for c in ("entities", "imports", "diagnostics")],
        _first_fault(module["entities"], entity),
        _first_fault(module["diagnostics"], diagnostic),
    ]
    return F.coalesce(*rules)


def decoded(texts: DataFrame, text: str = "json") -> DataFrame:
    """texts with `module`, read from the JSON in `text` by SCHEMA, and `error`, why it is refused, else null.

    Unknown fields are passed over and missing optional ones are null. What is not JSON of
    this form is refused as a whole; a null text is, too.
    """
    parsed = F.from_json(F.coalesce(F.col(text), F.lit("")), SCHEMA + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    rows = once(texts, "module", parsed)
    broken = F.col("module").isNull() | F.col("module._broken").isNotNull()
    error = F.when(broken, F.lit("decode Common IR payload")).otherwise(fault(F.col("module")))
    rows = once(rows, "error", error)
    return rows.withColumn("module", F.when(F.col("error").isNull(), F.col("module").dropFields("_broken")))


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with another column, or in place of one that value does not read; no filter or projection above evaluates it anew."""
    return rows.drop(name).select("*", F.explode(F.array(value)).alias(name))


def encoded(modules: DataFrame) -> DataFrame:
    """modules(module, ...) with `json`, without fields that are null."""
    return once(modules, "json", F.to_json("module"))


def facts_of(modules: DataFrame, kind: str, graph: str = "graph") -> DataFrame:
    """(graph, module_id, ord, ...): the facts of one kind of all sound modules(graph, module_id, module) of a project, in order."""
    rows = modules.where("module IS NOT NULL").select(F.col(graph).alias("graph"), "module_id", F.posexplode(f"module.{kind}").alias("ord", "fact"))
    return rows.select("graph", "module_id", "ord", "fact.*")


def languages(modules: DataFrame, graph: str = "graph") -> DataFrame:
    """(graph, language): a project's language, mixed if its sound modules have several."""
    grouped = modules.where("module IS NOT NULL").groupBy(F.col(graph).alias("graph"))
    return grouped.agg(F.when(F.countDistinct("module.language") > 1, F.lit("mixed")).otherwise(F.max("module.language")).alias("language"))
