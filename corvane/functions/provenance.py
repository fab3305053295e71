"""What a tool call did to a file, from its JSON payload."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "rb": "ruby", "rs": "rust", "go": "go", "java": "java", "kt": "kotlin", "swift": "swift", "cs": "csharp", "cpp": "cpp", "cc": "cpp", "c": "c", "h": "c", "hpp": "cpp", "php": "php",
    "sh": "shell", "bash": "shell", "zsh": "shell", "fish": "shell", "sql": "sql", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "html": "html", "htm": "html", "xml": "xml",
    "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "md": "markdown", "mdx": "markdown", "vue": "vue", "svelte": "svelte", "graphql": "graphql", "gql": "graphql", "proto": "protobuf",
    "tf": "terraform", "hcl": "hcl", "r": "r", "jl": "julia", "scala": "scala", "ex": "elixir", "exs": "elixir", "erl": "erlang", "hrl": "erlang", "hs": "haskell", "lua": "lua", "dart": "dart", "pl": "perl", "pm": "perl",
}
# Where a payload names its file, and the shell commands that touch files, in this order.
PATH_FIELDS = ("file_path", "path", "filePath", "filename", "file")
COMMANDS = (
    ("delete", r"rm\s+(?:-[a-zA-Z]*\s+)*([^\s|;&-][^\s|;&]*)"),
    ("create", r"(?:touch|mkdir)\s+([^\s|;&]+)|(?:tee|>\s*)([^\s|;&]+)"),
    ("read", r"(?:cat|less|more|head|tail)\s+([^\s|;&]+)"),
)
ANY_PATH = r"(?:^|\s)((?:\.{1,2}/|/)?[\w./-]+\.(?:ts|js|tsx|jsx|py|rb|rs|go|java|sh|sql|json|yaml|yml|toml|md|html|css|txt|log|conf|env))\b"
WRITES = r"(?:write|sed\s+-i|awk.*>\s*|echo.*>|printf.*>)"
TOOLS = {"Write": "create", "Edit": "edit", "Read": "read"}


def language(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([^.]*)$", 1))
    return F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), extension)


def _field(payload: Column, name: str) -> Column:
    return F.get_json_object(payload, f"$.{name}")


def _command(command: Column) -> tuple[Column, Column]:
    """Path and action of a shell command; null where it touches no file."""
    any_path = F.nullif(F.regexp_extract(command, ANY_PATH, 1), F.lit(""))
    path, action = any_path, F.when(any_path.isNotNull(), F.when(command.rlike(WRITES), "edit").otherwise("read"))
    for name, pattern in reversed(COMMANDS):
        groups = [F.regexp_extract(command, pattern, k + 1) for k in range(pattern.count("([^"))]  # one of them is filled
        found = F.nullif(F.concat(*groups), F.lit(""))
        path, action = F.coalesce(found, path), F.when(found.isNotNull(), name).otherwise(action)
    return path, action


def code_provenance(payload: Column) -> Column:
    """file_path, action, model_id and language; null where the payload touches no file."""
    tool = _field(payload, "tool_name")
    named = F.coalesce(*(F.nullif(F.trim(_field(payload, f)), F.lit("")) for f in PATH_FIELDS))
    of_shell, shell_action = _command(F.coalesce(_field(payload, "command"), _field(payload, "cmd")))
    edits = _field(payload, "old_string").isNotNull() | _field(payload, "new_string").isNotNull()
    action = F.when(edits, "edit").otherwise("read")
    for name, does in TOOLS.items():
        action = F.when(tool == name, does).otherwise(action)
    shell = F.coalesce(tool == "Bash", F.lit(False))
    path, action = F.when(shell, of_shell).otherwise(named), F.when(shell, shell_action).otherwise(action)
    return F.when(path.isNotNull(), F.struct(path.alias("file_path"), action.alias("action"), _field(payload, "model_id").alias("model_id"), language(path).alias("language")))
