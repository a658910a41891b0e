"""Facts of workflow documents: triggers, jobs, steps, references, caches, matrices and the paths that they hint at.

Documents come as JSON text, files(graph, json). Nothing is evaluated: expressions stay
texts. Steps are decoded one by one, each from its own JSON text, so that keys keep the
file's order. Fields that may be of two types are given as JSON (true, "true", 3). A job
or a step that is no object is left out. A string that is an object's JSON itself counts
as that object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetgraph.functions import text as T
from facetgraph.functions import values as V
from facetgraph.operators.render import _assembled, _lines, _text
from facetgraph.sources.modules import once

# Extensions and directory names that make a word of a command a path.
PATH_SUFFIXES = (".py", ".pyi", ".cs", ".csproj", ".sln", ".cpp", ".cc", ".cxx", ".c", ".h", ".hpp", ".hxx", ".gd", ".java", ".go", ".yml", ".yaml", ".toml", ".json", ".sh", ".bat", ".ps1")
PROJECT_DIRECTORIES = ("src", "source", "test", "tests", "app", "apps", "lib", "libs", "script", "scripts", "tool", "tools")

_NONE = "array<string>"


def _stripped(word: Column) -> Column:
    """A word without white space, quotes and then brackets, commas and semicolons at its ends."""
    out = T.trimmed(word)
    for signs in ("\"'", "(),;"):
        out = F.btrim(out, F.lit(signs))
    return out


def _path(token: Column) -> Column:
    refused = (token == "") | token.rlike(r"^[-$]") | F.contains(token, F.lit("://"))
    path = F.regexp_replace(F.replace(token, F.lit("\\"), F.lit("/")), r"^\./", "")
    return F.when(~refused, F.coalesce(F.nullif(F.rtrim(path, F.lit("/")), F.lit("")), F.lit(".")))


def explicit_path(word: Column) -> Column:
    """A path that is stated as one: slashes forward, no ./ before and no / behind it; null for flags, variables and addresses."""
    return _path(_stripped(word))


def path_hints_of(words: Column) -> Column:
    """explicit_path() of each of the words of a command (an array) that looks like one, by its start, its slashes, its extension, its stars or its name; else null."""

    def hint(x: Column) -> Column:
        path = x["path"]
        suffix = F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))
        shaped = (path == ".") | x["token"].rlike(r"^\.\.?/") | (F.contains(path, F.lit("/")) & ~F.contains(path, F.lit(":"))) | path.rlike(r"[*?\[]")
        return F.when(shaped | F.lower(path).isin(*PROJECT_DIRECTORIES) | suffix.isin(*PATH_SUFFIXES), path)

    # step by step, as each lambda is evaluated anew at every use
    tokens = F.transform(words, _stripped)
    return F.transform(F.transform(tokens, lambda t: F.struct(t.alias("token"), _path(t).alias("path"))), hint)


def command_paths(command: Column) -> Column:
    """The distinct paths that a command's words hint at, in order; quoted words are one."""
    words = F.regexp_extract_all(F.coalesce(command, F.lit("")), F.lit(r"""(?U)"[^"]*"|'[^']*'|\S+"""), F.lit(0))
    return F.array_distinct(F.array_compact(path_hints_of(words)))


def _strings(json: Column) -> Column:
    """All strings in a JSON text at any depth, keys left out."""
    tokens = F.regexp_extract_all(json, F.lit(r'"[^"\\]*+(?:\\.[^"\\]*+)*+":?'), F.lit(0))
    return F.transform(F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":"))), lambda t: F.try_variant_get(F.try_parse_json(t), "$", "string"))


def _references(json: Column, context: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.transform(_strings(json), lambda s: T.context_references(s, context)))))


def _contexts(of: Column) -> list[Column]:
    return [_references(of, "env").alias("env_refs"), _references(of, "secrets").alias("secret_refs")]


def _keys(raw: Column, path: str) -> Column:
    return F.coalesce(F.json_object_keys(F.get_json_object(raw, path)), F.array().cast(_NONE))


def _without(value: Column, key: str) -> Column:
    """An object without one key, as JSON."""
    return F.to_json(F.map_filter(V.entries(value), lambda k, _: k != key))


def _json(value: Column, *kinds: str) -> Column:
    """A value of one of the kinds as JSON; else null."""
    return F.when(V.kind_of(value).isin(*kinds), F.to_json(value))


def _limits(value: Column) -> list[Column]:
    return [V.string(V.at(value, "$.if")).alias("condition"), _json(V.at(value, "$['continue-on-error']"), "BOOLEAN", "STRING").alias("continue_on_error"), _json(V.at(value, "$['timeout-minutes']"), "BIGINT", "STRING").alias("timeout_minutes")]


def workflows(files: DataFrame) -> DataFrame:
    """(graph, name, triggers, env_names, env_refs, secret_refs, error): each file; error says why it is refused, and then the rest is null.

    Triggers are a string, the strings of an array or the keys of an object. An empty file
    or null is a workflow without anything.
    """
    v = F.try_parse_json("json")
    empty = (F.coalesce(F.trim("json"), F.lit("")) == "") | F.coalesce(F.is_variant_null("v"), F.lit(False))
    rows = files.select("graph", "json", v.alias("v")).withColumn("empty", empty)
    jobs = V.at(F.col("v"), "$.jobs")
    error = F.when(F.col("empty"), F.lit(None).cast("string")).when(F.coalesce(V.kind_of(F.col("v")), F.lit("")) != "OBJECT", "workflow root must be a mapping")
    error = error.when(V.is_given(jobs) & (V.kind_of(jobs) != "OBJECT"), "jobs must be a mapping")
    # the key may have been read as a boolean
    on = F.when(V.at(F.col("v"), "$.on").isNotNull(), "on").otherwise("true")
    stated = F.coalesce(V.at(F.col("v"), "$.on"), V.at(F.col("v"), "$.true"))
    triggers = F.when(V.kind_of(stated) == "OBJECT", F.when(on == "on", _keys(F.col("json"), "$.on")).otherwise(_keys(F.col("json"), "$.true"))).otherwise(V.string_list(stated))
    rest = _without(F.col("v"), "jobs")
    facts = {"name": V.string(V.at(F.col("v"), "$.name")), "triggers": triggers, "env_names": _keys(F.col("json"), "$.env"), "env_refs": _references(rest, "env"), "secret_refs": _references(rest, "secrets")}
    out = rows.select("graph", error.alias("error"), *[c.alias(n) for n, c in facts.items()])
    lists = [F.when(F.col("error").isNull(), F.coalesce(n, F.array().cast(_NONE))).alias(n) for n in facts if n != "name"]
    return out.select("graph", F.when(F.col("error").isNull(), F.col("name")).alias("name"), *lists, "error")


def _jobs(files: DataFrame) -> DataFrame:
    """(graph, job_pos, job, raw, v): the jobs of each file that are objects, in order."""
    rows = files.select("graph", F.posexplode(F.from_json(F.get_json_object("json", "$.jobs"), "map<string,string>")).alias("job_pos", "job", "raw"))
    return once(rows, "v", F.try_parse_json("raw")).where(V.kind_of(F.col("v")) == "OBJECT")


def jobs(files: DataFrame) -> DataFrame:
    """(graph, job_pos, job, display_name, needs, condition, continue_on_error, timeout_minutes, fail_fast, max_parallel, matrix, env_names, env_refs, secret_refs): each job; matrix is an expression."""
    v = F.col("v")
    strategy = [_json(V.at(v, "$.strategy['fail-fast']"), "BOOLEAN", "STRING").alias("fail_fast"), _json(V.at(v, "$.strategy['max-parallel']"), "BIGINT", "STRING").alias("max_parallel"), V.string(V.at(v, "$.strategy.matrix")).alias("matrix")]
    return _jobs(files).select("graph", "job_pos", "job", V.string(V.at(v, "$.name")).alias("display_name"), V.string_list(V.at(v, "$.needs")).alias("needs"), *_limits(v), *strategy, _keys(F.col("raw"), "$.env").alias("env_names"), *_contexts(_without(v, "steps")))


def matrix_values(files: DataFrame) -> DataFrame:
    """(graph, job, part, row, name, place, value): what a job's matrix states. part is axis, include or exclude.

    An axis is an array: a row for each of its scalars, in order of `place`, -1 and a null
    value for one that has none. include and exclude are arrays of objects: `row` is the
    object's place among the objects, and its scalars are rows. Values are JSON.
    """
    plain = lambda x: ~V.kind_of(x).isin("OBJECT", "ARRAY")
    rows = _jobs(files).select("graph", "job", F.col("v").alias("job_v"))
    matrix = rows.select("graph", "job", V.entries(V.at(F.col("job_v"), "$.strategy.matrix")).alias("matrix"))
    own = matrix.select("graph", "job", F.explode("matrix").alias("name", "stated")).where(V.kind_of(F.col("stated")) == "ARRAY")
    axes = own.where("name NOT IN ('include', 'exclude')").select("graph", "job", F.lit("axis").alias("part"), F.lit(None).cast("int").alias("row"), "name", F.posexplode_outer(F.filter(V.items(F.col("stated")), plain)).alias("place", "value"))
    axes = axes.select("graph", "job", "part", "row", "name", F.coalesce("place", F.lit(-1)).alias("place"), F.to_json("value").alias("value"))
    listed = own.where("name IN ('include', 'exclude')").select("graph", "job", F.col("name").alias("part"), F.posexplode(F.filter(V.items(F.col("stated")), lambda x: V.kind_of(x) == "OBJECT")).alias("row", "object"))
    cells = listed.select("graph", "job", "part", "row", F.explode(V.entries(F.col("object"))).alias("name", "cell")).where(plain(F.col("cell")))
    return axes.union(cells.select("graph", "job", "part", "row", "name", F.lit(0), F.to_json("cell")))


def steps(files: DataFrame) -> DataFrame:
    """(graph, job_pos, job, step_pos, step, command, action, paths, condition, continue_on_error, timeout_minutes, env_names, env_refs, secret_refs, resource, resource_name, resource_key, resource_paths).

    Steps are named by name, else run or uses; one without any of these is left out. Paths
    are the working directory, a local action and those of the command.
    """
    own = _jobs(files)
    default = V.string(V.at(F.col("v"), "$.defaults.run['working-directory']"))
    rows = own.select("graph", "job_pos", "job", default.alias("default"), F.posexplode(F.from_json(F.get_json_object("raw", "$.steps"), _NONE)).alias("step_pos", "raw"))
    rows = once(rows, "v", F.try_parse_json("raw")).where(V.kind_of(F.col("v")) == "OBJECT")
    field = lambda path: V.string(V.at(F.col("v"), path))
    rows = rows.withColumns({"command": field("$.run"), "action": field("$.uses"), "kind": T.resource_kind(field("$.uses"))})
    name = F.coalesce(field("$.name"), F.when(F.col("command").isNotNull(), "run"), F.when(F.col("action").isNotNull(), "uses"))
    rows = once(rows, "step", name).where("step IS NOT NULL")
    directory = explicit_path(F.nullif(F.coalesce(F.nullif(field("$['working-directory']"), F.lit("")), "default"), F.lit("")))
    local = F.when(F.startswith("action", F.lit("./")), explicit_path(F.col("action")))
    paths = F.array_distinct(F.array_compact(F.concat(F.array(directory, local), command_paths(F.col("command")))))
    named = V.at(F.col("v"), "$.with.path")
    lines = F.filter(F.transform(F.split(V.string(named), r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"), T.trimmed), lambda x: x != "")
    listed = F.filter(V.string_list(named), lambda x: T.trimmed(x) != "")
    resource = [F.col("kind").alias("resource"), F.when(F.startswith("kind", F.lit("artifact")), field("$.with.name")).alias("resource_name"), F.when(F.startswith("kind", F.lit("cache")), field("$.with.key")).alias("resource_key"), F.when(F.col("kind").isNotNull(), F.coalesce(lines, listed)).alias("resource_paths")]
    return rows.select("graph", "job_pos", "job", "step_pos", "step", "command", "action", paths.alias("paths"), *_limits(F.col("v")), _keys(F.col("raw"), "$.env").alias("env_names"), *_contexts(F.to_json("v")), *resource)


def path_hints(steps: DataFrame) -> DataFrame:
    """(graph, job, step, path, job_pos, step_pos, path_pos): each path of a job's steps of one name, where it first occurs."""
    rows = steps.select("graph", "job_pos", "job", "step_pos", "step", F.posexplode("paths").alias("path_pos", "path"))
    first = rows.groupBy("graph", "job", "step", "path").agg(F.min(F.struct("job_pos", "step_pos", "path_pos")).alias("at"))
    return first.select("graph", "job", "step", "path", "at.*")


def workflow_chart(workflows: DataFrame, jobs: DataFrame, steps: DataFrame, direction: str = "LR") -> DataFrame:
    """(graph, text): the triggers, jobs with their steps' names, and what each job needs among the jobs; jobs that need none follow the triggers."""
    ident = lambda c: T.node_id(F.col(c), "ci_")
    shown = F.when(F.size("triggers") > 0, F.array_join("triggers", ", ")).otherwise("workflow")
    heads = workflows.where("error IS NULL").select("graph", shown.alias("shown"))
    names = steps.groupBy("graph", "job", "job_pos").agg(F.concat(F.lit("<br/>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_pos", "step"))), lambda x: x["step"]), "<br/>")).alias("names"))
    boxes = jobs.join(names, ["graph", "job", "job_pos"], "left")
    wanted = jobs.select("graph", "job", "job_pos", F.posexplode("needs").alias("need_pos", "need"))
    met = wanted.join(jobs.select("graph", F.col("job").alias("need")).distinct(), ["graph", "need"], "left_semi")
    free = jobs.join(met.select("graph", "job").distinct(), ["graph", "job"], "left_anti")
    arrows = met.select("graph", "job_pos", "need_pos", _text("    ", ident("need"), " --> ", ident("job")).alias("line"))
    arrows = arrows.union(free.select("graph", "job_pos", F.lit(0), _text("    ci_trigger --> ", ident("job"))))
    parts = [
        _lines(heads, 0, _text('    ci_trigger["', F.col("shown"), '"]')),
        _lines(boxes, 1, _text("    ", ident("job"), '["', F.col("job"), F.coalesce("names", F.lit("")), '"]'), F.col("job_pos")),
        _lines(arrows, 2, F.col("line"), F.col("job_pos") * 10**6 + F.col("need_pos")),
    ]
    return _assembled(f"flowchart {direction}", parts)
