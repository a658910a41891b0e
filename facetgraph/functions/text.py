"""Text rules as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, codes and orders of the rules below.
HANDLER_PREFIXES = ("on_", "handle_", "handle", "do_")
HANDLER_SUFFIXES = ("_clicked", "_click", "_pressed", "_press", "_triggered", "_changed")
CONFIDENCE = {"confirmed": 2, "inferred": 1}
SERVICE_KINDS = {
    "database": ("postgres", "mysql", "mariadb", "mongo", "sqlite"),
    "cache": ("redis", "memcached"),
    "message-queue": ("rabbitmq", "kafka", "nats", "activemq"),
}
RESPONSIBILITIES = (
    (("load", "read", "save", "write"), "Handles %s data input and output."),
    (("update", "process", "run", "execute"), "Coordinates %s processing."),
    (("validate", "check", "evaluate"), "Validates or evaluates %s state."),
    ((), "Manages %s state and behavior."),
)
RESOURCE_KINDS = {
    "actions/cache": "cache",
    "actions/cache/restore": "cache-restore",
    "actions/cache/save": "cache-save",
    "actions/upload-artifact": "artifact-upload",
    "actions/download-artifact": "artifact-download",
}
COMMENT_VERBS = {
    "get": "を取得します。",
    "load": "を読み込みます。",
    "read": "を読み取ります。",
    "parse": "を解析します。",
    "create": "を生成します。",
    "generate": "を生成します。",
    "build": "を構築します。",
    "render": "を描画用表現へ変換します。",
    "save": "を保存します。",
    "write": "を書き出します。",
    "update": "を更新します。",
    "delete": "を削除します。",
    "remove": "を取り除きます。",
    "validate": "を検証します。",
    "check": "を確認します。",
    "find": "を検索します。",
    "collect": "を収集します。",
    "convert": "を変換します。",
    "run": "の処理を実行します。",
}


def node_id(name: Column, prefix: str = "n_") -> Column:
    """prefix and the name, every sign but ASCII letters, digits and underscores as an underscore."""
    return F.concat(F.lit(prefix), F.regexp_replace(name, "[^0-9A-Za-z_]", "_"))


def hashed_id(name: Column, prefix: str) -> Column:
    """prefix and ten hex digits of the name's SHA-1."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(name), 1, 10))


def quoted(text: Column) -> Column:
    """Backslashes and quotes escaped by a backslash."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def one_line(text: Column) -> Column:
    """quoted(), with line ends as blanks."""
    return F.replace(quoted(text), F.lit("\n"), F.lit(" "))


def table_cell(text: Column) -> Column:
    """A cell of a Markdown table: line ends as blanks, bars escaped."""
    return F.replace(F.translate(text, "\r\n", "  "), F.lit("|"), F.lit("\\|"))


def message_label(text: Column) -> Column:
    """A label of a sequence diagram: line ends as blanks, colons as dashes."""
    return F.translate(text, "\n\r:", "  -")


def object_label(text: Column) -> Column:
    """A label of an object diagram: line ends as blanks, double quotes as single ones."""
    return F.translate(text, '\n\r"', "  '")


def communication_label(text: Column) -> Column:
    """object_label() with backslashes escaped."""
    return object_label(F.replace(text, F.lit("\\"), F.lit("\\\\")))


def csv_cell(text: Column) -> Column:
    """A cell of a CSV file, quoted only where it must be."""
    return F.when(text.rlike('[",\r\n]|^ '), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def trimmed(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def safe_name(text: Column, fallback: str) -> Column:
    """Runs of signs other than letters, digits, _ . - as one underscore; ends trimmed."""
    safe = F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9_.-]+", "_"), "^[_.-]+|[_.-]+$", "")
    return F.coalesce(F.nullif(safe, F.lit("")), F.lit(fallback))


def use_case_name(label: Column, handler: Column) -> Column:
    """The trimmed label; else the words of the handler's last segment without one leading and one trailing event word, the first letter large."""
    core = F.regexp_replace(F.substring_index(handler, ".", -1), f"^({'|'.join(HANDLER_PREFIXES)})", "")
    core = F.regexp_replace(core, f"({'|'.join(HANDLER_SUFFIXES)})$", "")
    words = F.array_join(F.filter(F.split(core, "_"), lambda w: w != ""), " ")
    shown = F.when(words != "", F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2))))
    return F.coalesce(F.nullif(trimmed(label), F.lit("")), shown, F.lit("User action"))


def responsibility(docstring: Column, words: Column, methods: Column) -> Column:
    """The docstring's first line; else a sentence on words (an array) by the first rule that one of methods, in any case, meets."""
    told = F.nullif(trimmed(F.substring_index(trimmed(docstring), "\n", 1)), F.lit(""))
    lower = F.transform(methods, F.lower)
    out = told
    for names, sentence in RESPONSIBILITIES:
        text = F.replace(F.lit(sentence), F.lit("%s"), F.array_join(words, " "))
        met = F.arrays_overlap(lower, F.array(*[F.lit(n) for n in names])) if names else F.lit(True)
        out = F.coalesce(out, F.when(met, text))
    return out


def service_kind(*texts: Column) -> Column:
    """database, cache, message-queue or service, by what name and image contain."""
    text = F.lower(F.concat_ws(" ", *texts))
    out = F.lit(None).cast("string")
    for kind, parts in SERVICE_KINDS.items():
        out = F.coalesce(out, F.when(text.rlike("|".join(parts)), F.lit(kind)))
    return F.coalesce(out, F.lit("service"))


def confidence_rank(confidence: Column) -> Column:
    out = F.lit(0)
    for name, rank in CONFIDENCE.items():
        out = F.when(confidence == name, F.lit(rank)).otherwise(out)
    return out


def context_references(text: Column, context: str) -> Column:
    """The distinct names NAME of context.NAME and context['NAME'] in a text, sorted; context is secrets or env."""
    dotted = F.regexp_extract_all(text, F.lit(rf"\b{context}\.([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    keyed = F.regexp_extract_all(text, F.lit(rf"\b{context}\[['\"]([^'\"]+)['\"]\]"), F.lit(1))
    return F.array_sort(F.array_distinct(F.concat(dotted, keyed)))


def resource_kind(action: Column) -> Column:
    """What an action does with caches or artifacts, by its name before the @; else null."""
    name = F.substring_index(F.lower(action), "@", 1)
    return F.coalesce(*[F.when(name == action_name, F.lit(kind)) for action_name, kind in RESOURCE_KINDS.items()])


def base_images(dockerfile: Column) -> Column:
    """The images of a Dockerfile's FROM lines, in order; flags before the image are skipped."""
    lines = F.filter(F.split(dockerfile, "\r\n|\r|\n"), lambda x: x.rlike(r"(?i)^\s*from\s+\S"))
    return F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(?i)^\s*from\s+(?:--\S+\s+)*(\S+)", 1)), lambda x: ~x.startswith("--"))


def comment_text(name: Column, words: Column, kind: Column, has_calls: Column) -> Column:
    """A sentence on a declaration, by its name's words (an array): what a class holds, what a known first word does, else what is done, alone or with others."""
    readable = F.coalesce(F.nullif(F.array_join(words, " "), F.lit("")), name)
    subject = F.when(F.size(words) > 1, F.array_join(F.slice(words, F.lit(2), F.size(words)), " ")).otherwise("処理")
    known = F.create_map(*[F.lit(x) for pair in COMMENT_VERBS.items() for x in pair])
    told = F.concat(subject, F.try_element_at(known, F.coalesce(F.get(words, F.lit(0)), name)))
    other = F.concat(readable, F.when(has_calls, "の処理を実行し、関連処理を連携させます。").otherwise("の処理を行います。"))
    return F.when(kind == "class", F.concat(readable, F.lit("に関する状態と処理をまとめます。"))).otherwise(F.coalesce(told, other))
