"""Chat formatting with typed content parts, in built-in expressions only.

A turn's content is an ordered list of parts ``struct<type, text, ref, units>``.  The visitor ``flatten_parts`` turns it
into one string: text parts are escaped and stand as they are, image, audio and document parts become placeholders
``<|type:k|>`` numbered in order, and are recorded as attachments with the tokens that they expand to.

Template of a turn: ``### role: content</turn>\\n``.  Inside texts and roles a backslash is doubled and the control
strings ``###``, ``</turn>``, ``<|`` are broken by a backslash, so that none of them occurs there; reading back removes
one backslash before each character.

Edge cases: a null text is empty; a null role is ``unknown``; a null conv_id forms a conversation of its own; turns are
ordered by turn (null first), ties by role, then content; repeated rows are turns of their own; an empty table gives an
empty table; other columns are not read; unknown part types become placeholders without tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

OPEN, HEAD_END, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens that one unit of a part stands for: an image's tile, a second of audio, a page of a document.
TOKENS_PER_UNIT = {"image": 256, "audio": 25, "document": 512}
PART = "struct<type:string,text:string,ref:string,units:int>"
#: The conversation that tries the escapes.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"
WORD_RUN = r"[^\x20\x09-\x0D]+"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.regexp_replace(text, "#(?=##)", r"#\\")
    text = F.replace(text, F.lit("</turn>"), F.lit("<\\/turn>"))
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit("unknown"))), F.lit(":"), F.lit("\\:"))


def flatten_parts(parts: Column) -> Column:
    """struct<content, attachments, n_tokens> of an array of PART."""
    parts = F.coalesce(parts.cast(f"array<{PART}>"), F.array().cast(f"array<{PART}>"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    per_unit = lambda p: F.coalesce(*[F.when(p["type"] == t, n) for t, n in TOKENS_PER_UNIT.items()], F.lit(0))
    media = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p, i: F.struct(i.alias("k"), p["type"].alias("type"), p["ref"].alias("ref"), (per_unit(p) * F.coalesce(p["units"], F.lit(1))).cast("long").alias("tokens")))
    ordinal = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda q: ~is_text(q)))
    shown = F.transform(parts, lambda p, i: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), F.regexp_replace(p["type"], r"[^A-Za-z0-9_]", "_"), F.lit(":"), ordinal(i).cast("string"), F.lit("|>"))))
    text_tokens = F.aggregate(F.transform(parts, lambda p: F.when(is_text(p), F.regexp_count(F.coalesce(p["text"], F.lit("")), F.lit(WORD_RUN))).otherwise(0)), F.lit(0).cast("long"), lambda a, b: a + b)
    media_tokens = F.aggregate(F.transform(media, lambda m: m["tokens"]), F.lit(0).cast("long"), lambda a, b: a + b)
    return F.struct(F.array_join(shown, "").alias("content"), media.alias("attachments"), (text_tokens + media_tokens).alias("n_tokens"))


def format_conversations(turns: DataFrame, parts: Column) -> DataFrame:
    """One row per conv_id: formatted, loss_runs (array of struct<chars, loss>, which add up to formatted), attachments.

    turns has conv_id, turn and role.  The loss mask covers the contents of the assistant's turns.
    """
    flat = turns.select(F.col("conv_id"), F.col("turn"), escape_role(F.col("role")).alias("role"), flatten_parts(parts).alias("p"))
    rows = flat.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("p.content").alias("content"), F.col("p.attachments").alias("attachments"), F.col("p.n_tokens").alias("n_tokens")))).alias("ts"))
    head = lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(HEAD_END))
    run = lambda n, loss: F.struct(n.cast("long").alias("chars"), loss.alias("loss"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["content"], F.lit(CLOSE))), "").alias("formatted"),
        F.flatten(F.transform("ts", lambda t: F.array(run(F.length(head(t)), F.lit(False)), run(F.length(t["content"]), t["role"] == "assistant"), run(F.lit(len(CLOSE)), F.lit(False))))).alias("loss_runs"),
        F.flatten(F.transform("ts", lambda t, i: F.transform(t["attachments"], lambda a: F.struct(i.alias("turn_index"), a["k"].alias("k"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
        F.aggregate(F.transform("ts", lambda t: t["n_tokens"]), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_tokens"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns, as array of struct<role, text, loss>, that the formatted string itself says."""
    pieces = F.split("formatted", CLOSE, -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    header = r"(?s)^### ((?:[^\\:]++|\\.)*+): "
    df = formatted.withColumn("__pieces", pieces)
    heads = F.transform("__pieces", lambda p: F.struct(F.regexp_extract(p, header, 1).alias("role"), p.alias("p")))
    df = df.withColumn("__heads", heads)
    turns = F.transform("__heads", lambda h: F.struct(unescape(h["role"]).alias("role"), unescape(F.substr(h["p"], F.length(h["role"]) + len(OPEN) + len(HEAD_END) + 1)).alias("text"), (h["role"] == "assistant").alias("loss")))
    return df.withColumn("turns", turns).drop("__pieces", "__heads")


def under_mask() -> Column:
    """array<string>: what loss_runs covers of each turn in formatted, unescaped.

    A turn has three runs, which must add up to its characters; so each turn starts where the runs before it end.
    """
    turns = F.split("formatted", CLOSE, -1)
    n = F.size(turns) - 1
    turns = F.slice(turns, 1, n)
    run = lambda i, k: F.get(F.col("loss_runs"), 3 * i + k)

    def covered(piece: Column, i: Column) -> Column:
        turn = F.concat(piece, F.lit(CLOSE))
        chars = [run(i, k)["chars"].cast("int") for k in range(3)]
        starts = [F.lit(1), chars[0] + 1, chars[0] + chars[1] + 1]
        cut = F.concat(*[F.when(run(i, k)["loss"], F.substr(turn, starts[k], chars[k])).otherwise("") for k in range(3)])
        return F.when(chars[0] + chars[1] + chars[2] == F.length(turn), unescape(cut)).otherwise(F.raise_error(F.lit("loss_runs do not fit the formatted text")).cast("string"))

    fits = F.size("loss_runs") == 3 * n
    return F.when(fits, F.transform(turns, covered)).otherwise(F.raise_error(F.lit("loss_runs do not fit the formatted text")).cast("array<string>"))


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns from what read_back() gives; the loss is the text under the mask."""
    df = df.withColumn("__loss", F.array_join(under_mask(), ""))
    return df.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("__loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("__loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.col("n_tokens"),
    )


def text_part(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("units")))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    return digest(read_back(format_conversations(turns.unionByName(probe), text_part(F.col("text")))))


#: DuckDB; formatted_chars counts the template's own characters and one for each escape; n_tokens counts words.
ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(text)
    + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + (length(text) - length(replace(text, '<|', ''))) // 2
    + list_sum([0] || list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)) AS n_esc,
    len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n_words
  FROM c
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
  sum(n_esc + length(role) + 14)::BIGINT AS formatted_chars,
  0::BIGINT AS n_attachments,
  sum(n_words)::BIGINT AS n_tokens
FROM e GROUP BY conv_id
"""
