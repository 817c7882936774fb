"""Imports from source lines: by a lexer over hunk images, and by patterns on single lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import normalize, top_of

COMPOUND = frozenset("if elif else for while try except finally with def class async match case".split())
NEXT_IMPORT = re.compile(r"[^\S\n]*(?:import|from)\b[^()\n]*(?:\n|\Z)")
TOKEN = re.compile(
    r"""(?P<string>(?:[rRbBuUfF]{0,2})(?:'{3}(?:[^\\]|\\.)*?(?:'{3}|\Z)|"{3}(?:[^\\]|\\.)*?(?:"{3}|\Z)|'(?:[^'\\\n]|\\.)*'?|"(?:[^"\\\n]|\\.)*"?))"""
    r"""|(?P<comment>\#[^\n]*)|(?P<join>\\\n)|(?P<newline>\n)|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<stop>;)|(?P<colon>:)|(?P<word>\w+)|(?P<other>.)""",
    re.S,
)
SCHEMA = "case_id string, file_id long, file string, pos int, k int, kind string, module string, top string, line int, raw string"


def statements(source: str) -> Iterator[tuple[int, str]]:
    """(row, text) of the logical statements that start with import or from; strings become a space, so no import is
    seen inside one.  One pass: only such a statement's text is held."""
    row, depth, start, lead, parts = 0, 0, 0, "", []

    def done() -> Iterator[tuple[int, str]]:
        nonlocal lead
        if parts:
            yield start, "".join(parts).strip()
            parts.clear()
        lead = ""

    for m in TOKEN.finditer(source):
        kind, text = m.lastgroup, m[0]
        if not lead and kind not in ("newline", "comment"):
            start = row
        if kind == "newline":
            if depth == 0 or not lead.startswith(("from", "import")) and NEXT_IMPORT.match(source, m.end()):
                depth = 0
                yield from done()
            elif parts:
                parts.append(" ")
        elif depth == 0 and (kind == "stop" or kind == "colon" and lead in COMPOUND):
            yield from done()
        elif kind in ("string", "comment", "join"):
            if parts:
                parts.append(" ")
        else:
            depth = depth + 1 if kind == "open" else max(0, depth - 1) if kind == "close" else depth
            lead = lead or text.strip()
            if lead in ("import", "from"):
                parts.append(text)
        row += text.count("\n")
    yield from done()


def imports_of(source: str) -> Iterator[tuple[int, str, str]]:
    """(row, kind, module); a relative import has its dots in front.  ``from __future__`` imports nothing."""
    for row, text in statements(source):
        if m := re.match(r"import\s+(.*)$", text, re.S):
            for part in m[1].split(","):
                if name := re.match(r"\s*([\w.]+)", part):
                    yield row, "import", name[1]
        elif m := re.match(r"from\s*(\.+)\s*([\w.]*?)\s*import\b", text):
            yield row, "relative", m[1].replace(" ", "") + m[2]
        elif (m := re.match(r"from\s+([\w.]+)\s+import\b", text)) and m[1] != "__future__":
            yield row, "from-import", m[1]


def lexed_imports(images: DataFrame) -> DataFrame:
    """images (case_id, file_id, file, rows) to SCHEMA; a statement counts if its first row is an added line.

    pos is that line's place in the diff, k the name's place in the statement, raw the line itself.
    """
    types = (pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for case_id, file_id, file, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, (row, kind, module) in enumerate(imports_of("\n".join(r["text"] for r in rows))):
                    at = rows[row]
                    if at["added"]:
                        out.append((case_id, file_id, file, at["pos"], k, kind, module, "" if kind == "relative" else module.split(".")[0], at["new_line"], at["text"].strip()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [c.split()[0] for c in SCHEMA.split(", ")])

    return images.select("case_id", F.col("file_id").cast("long").alias("file_id"), "file", "rows").mapInArrow(run, SCHEMA)


def pattern_imports(lines: DataFrame, text: str = "content") -> DataFrame:
    """lines with kind, name, top: one row per imported name of a single line, names after ``as`` skipped.

    The wider reading of ``qa_candidates``: every name of a comma list, in any file.
    """
    t = F.col(text)
    plain = F.regexp_extract(t, r"^\s*import\s+(.+?)\s*(?:#.*)?$", 1)
    origin = F.regexp_extract(t, r"^\s*from\s+(\.*[\w.]*)\s+import\b", 1)
    names = F.when(origin != "", F.array(origin)).when(plain != "", F.transform(F.split(plain, ","), lambda x: F.regexp_extract(x, r"^\s*([\w.]+)", 1))).otherwise(F.array().cast("array<string>"))
    return _named(lines, names, F.when(origin != "", "from-import").otherwise("import"))


def _named(lines: DataFrame, names: Column, kind: Column) -> DataFrame:
    rows = lines.withColumn("__kind", kind).select("*", F.posexplode(F.filter(names, lambda x: x != "")).alias("k", "name"))
    kind = F.when(F.col("__kind") == "requirement", "requirement").when(F.col("name").startswith("."), "relative").otherwise(F.col("__kind"))
    top = F.when(kind == "requirement", normalize(F.col("name"))).when(kind == "relative", "").otherwise(top_of(F.col("name")))
    return rows.withColumn("kind", kind).withColumn("top", top).drop("__kind")


# What the corpus checks take for an import, a from-import and the name of a requirement.
QA_IMPORT = r"^\s*import\s+([A-Za-z_][\w.]*(?:\s*,\s*[A-Za-z_][\w.]*)*)"
QA_FROM = r"^\s*from\s+([A-Za-z_.][\w.]*)\s+import\b"
QA_NAME = r"^([A-Za-z0-9][A-Za-z0-9._-]*)"
QA_REQUIREMENTS = r"(^|/)requirements[^/]*\.txt$"
# What the tools that mark the range of results take for an import, and for a line that requires a name.
TOOL_IMPORT = r"^\s*(?:import|from)\s+([a-zA-Z0-9_]+)"
TOOL_LINE = r"^\s*([A-Za-z0-9][A-Za-z0-9._-]+)\s*(?:(?:===|==|>=|<=|~=|!=|>|<)\S*\s*,?\s*$|$)"


def _bare(text: Column, also: str = "") -> Column:
    return F.regexp_replace(text, rf"^[\s{also}]+|[\s{also}]+$", "")


def qa_candidates(lines: DataFrame) -> DataFrame:
    """lines (case_id, pos, path, content) with kind, name, top and the place k in a comma list.

    A Python file's line gives the comma list up to the first ``as``, or the origin of a from-import; a requirements
    file's line gives its first name.  Lines of other files, or of none, give nothing.
    """
    t = F.col("content")
    imported, origin = F.regexp_extract(t, QA_IMPORT, 1), F.regexp_extract(t, QA_FROM, 1)
    spec = _bare(t)
    skipped = spec.startswith("#") | spec.startswith("-") | spec.contains("://") | spec.contains(" @ ")
    python, required = F.col("path").endswith(".py"), F.col("path").rlike(QA_REQUIREMENTS)
    names = F.when(python, F.when(imported != "", F.split(imported, r"\s*,\s*")).otherwise(F.array(origin))).when(required & ~skipped, F.array(F.regexp_extract(spec, QA_NAME, 1)))
    kind = F.when(required & ~python, "requirement").when(imported != "", "import").otherwise("from-import")
    return _named(lines, F.coalesce(names, F.array().cast("array<string>")), kind)


def _once(lines: DataFrame, name: Column, key: Column) -> DataFrame:
    """case_id, name, file, pos of the first line of each key."""
    found = lines.withColumn("name", name).where("name <> ''").withColumn("key", key)
    first = found.groupBy("case_id", "key").agg(F.min_by(F.struct("name", "path", "pos"), "pos").alias("at"))
    return first.select("case_id", "at.name", F.col("at.path").alias("file"), "at.pos")


def every_import_once(lines: DataFrame) -> DataFrame:
    """The tool that reports the first name of every import line, once per case, at its first place."""
    return _once(lines, F.regexp_extract("content", TOOL_IMPORT, 1), F.col("name"))


def listed_imports(lines: DataFrame, names: list[str]) -> DataFrame:
    """The tool that reports imports and required lines of a list's names, compared normalised."""
    t = F.col("content")
    imported = F.regexp_extract(t, TOOL_IMPORT, 1)
    item = _bare(_bare(_bare(t), ","), "\"'")
    found = _once(lines, F.when(imported != "", imported).otherwise(F.regexp_extract(item, TOOL_LINE, 1)), normalize(F.col("name")))
    wanted = lines.sparkSession.createDataFrame([(n,) for n in names], "name string").select(normalize(F.col("name")).alias("__norm")).distinct()
    return found.withColumn("__norm", normalize(F.col("name"))).join(F.broadcast(wanted), "__norm", "left_semi").drop("__norm")


def no_findings(lines: DataFrame) -> DataFrame:
    """The tool that reports nothing."""
    return every_import_once(lines).where(F.lit(False))


def guarded(text: Column) -> Column:
    return text.rlike(r"except\s*\(?\s*(?:ImportError|ModuleNotFoundError)")
