"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own.

An example is the conversation up to and with one assistant turn; only the text of that turn is under the loss mask.  A
turn is written as ``### role: text</turn>``.  The control strings ``###`` and ``</turn>`` cannot stand inside a role or
text: a backslash becomes ``\\e``, ``###`` becomes ``\\h``, ``</turn>`` becomes ``\\c``, and in a role a colon becomes
``\\d``.  Every backslash is thus followed by one of four letters, and the way back is exact.

All prefixes of a conversation together grow with the square of its length, and are written whole.  So that no row grows
with the conversation, a prefix beyond a page (``PAGE_CHARS`` characters and ``PAGE_TURNS`` turns; a turn belongs to the
page it begins in) takes several rows: one for each earlier page, and the one that holds the target.  ``from_turn`` says
where the text of a row begins; the texts of an example in its order are the prefix.  A conversation of one page, that is
nearly every one, has one row an example.

With limits given, an example holds its own page alone, from the start; what stands before is then only in the rows of
earlier pages that are marked ``whole``.

Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerleaf.llm.common import Stored, read
from ledgerleaf.llm.positions import numbered

OPEN, BETWEEN, CLOSE = "### ", ": ", "</turn>"
#: (control string, its escape), in the order of escaping; the way back is the reverse.
ESCAPES = [("\\", "\\e"), ("###", "\\h"), (CLOSE, "\\c")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\d")]
PAGE_CHARS, PAGE_TURNS = 1 << 18, 1 << 10
TRAINED = "assistant"


def escape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in pairs:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, pairs: list[tuple[str, str]] = ESCAPES) -> Column:
    for plain, code in reversed(pairs):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text", page_chars: int | None = None, page_turns: int | None = None) -> tuple[DataFrame, Stored]:
    """(id, from_turn, turn, text, loss_start, loss_end, whole) of a table of turns, and the table it is read from.

    ``turn`` numbers the turns of a conversation from 0 in the order of ``turn_col``, null first; rows that share a turn
    are ordered by the hash of role and text, and equal rows are turns of their own.  Null roles and texts are empty.  Rows
    without an id are one conversation, whose id is null.  ``loss_start`` and ``loss_end`` (end exclusive) count the code
    points of ``text``.  A page that does not end with an assistant turn has one more example, with nothing under the mask
    (both are null), so no turn is lost.  ``whole`` marks the last example of each page.  Other columns do not pass;
    an empty table has no examples.

    Without limits every example has its whole prefix: rows of an earlier ``from_turn`` hold the pages before its own, with
    nothing under the mask.  Then ``whole`` marks the rows of a conversation's last example, and only the conversation, not
    each page, has one more example when it does not end with an assistant turn.
    """
    prefixes = page_chars is None and page_turns is None
    page_chars, page_turns = page_chars or PAGE_CHARS, page_turns or PAGE_TURNS
    role, text = (F.coalesce(c, F.lit("")) for c in (role_col, text_col))
    written = escape(text)
    turns = rows.select(
        F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.xxhash64(role, text).alias("tie"),
        F.concat(F.lit(OPEN), escape(role, ROLE_ESCAPES), F.lit(BETWEEN), written, F.lit(CLOSE)).alias("segment"),
        F.when(role == TRAINED, F.length(written)).alias("reply"))
    turns = turns.withColumn("size", F.length("segment").cast("long"))
    placed, stored = numbered(turns, "id", ["turn", "tie"], "turns", size="size")
    turn = F.struct("idx", F.col("start").alias("at"), "size", "reply", "segment")
    pages = placed.groupBy("id", F.floor(F.col("start") / page_chars).alias("a"), F.floor(F.col("idx") / page_turns).alias("b")) \
        .agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    pages = pages.select("id", F.array_join("turns.segment", "").alias("page"), F.col("turns")[0]["idx"].alias("from_turn"),
                         F.col("turns")[0]["at"].alias("begin"), F.element_at("turns", -1)["idx"].alias("last"),
                         F.transform("turns", lambda x: F.struct(x["idx"], x["at"], x["size"], x["reply"])).alias("turns"))
    if prefixes:  # conversations of several pages are few
        longer = placed.where((F.col("start") >= page_chars) | (F.col("idx") >= page_turns)).select(F.col("id").alias("__id"), "idx") \
            .groupBy("__id").agg(F.max("idx").alias("__end"))
        pages = pages.join(longer, F.col("id").eqNullSafe(F.col("__id")), "left") \
            .withColumn("last", F.coalesce("__end", "last")).drop("__id", "__end")
    ends = F.filter("turns", lambda x: x["reply"].isNotNull() | (x["idx"] == F.col("last")))
    each = pages.select("id", "from_turn", "page", "begin", "last", F.explode(ends).alias("x"))
    end = F.col("x.at") + F.col("x.size") - F.col("begin")
    stop = F.when(F.col("x.reply").isNotNull(), (end - len(CLOSE)).cast("int"))
    out = each.select(F.col("id").alias(id_col), "from_turn", F.col("x.idx").alias("turn"),
                      F.substr("page", F.lit(1), end.cast("int")).alias("text"), (stop - F.col("x.reply")).alias("loss_start"),
                      stop.alias("loss_end"), (F.col("x.idx") == F.col("last")).alias("whole"))
    if not prefixes:
        return out, stored
    # only conversations of several pages have earlier ones; a target meets each page before its own
    targets = each.where("from_turn > 0").select(F.col("id").alias("__id"), F.col("from_turn").alias("__own"),
                                                 F.col("x.idx").alias("turn"), (F.col("x.idx") == F.col("last")).alias("whole"))
    before = pages.select("id", "from_turn", "page").join(targets, F.col("id").eqNullSafe(F.col("__id")) & (F.col("from_turn") < F.col("__own")))
    nothing = F.lit(None).cast("int")
    earlier = before.select(F.col("id").alias(id_col), "from_turn", "turn", F.col("page").alias("text"), nothing.alias("loss_start"),
                            nothing.alias("loss_end"), "whole")
    return out.unionByName(earlier), stored


def parse(text: Column) -> Column:
    """The turns of an example's text, as an array of (role, text)."""
    parts = F.split(text, CLOSE, -1)

    def turn(part: Column) -> Column:
        role = F.substring_index(part, BETWEEN, 1)
        return F.struct(unescape(F.substr(role, F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"),
                        unescape(F.substr(part, F.length(role) + len(BETWEEN) + 1)).alias("text"))

    return F.transform(F.slice(parts, 1, F.size(parts) - 1), turn)


def digests(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Per conversation what its examples say: turns, text under the mask, characters.

    A digest of all turns is one string by its definition, so here, other than in ``examples``, a task holds a
    conversation.
    """
    text = F.col("text")
    told = F.transform(parse(text), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    reply = unescape(F.substr(text, F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    rows = formatted.select(id_col, F.length(text).alias("size"), F.when(F.col("whole"), told).alias("told"), "from_turn", "turn",
                            F.when(F.col("loss_start").isNotNull(), reply).alias("reply"))
    in_order = lambda at, what: F.array_sort(F.collect_list(F.when(F.col(what).isNotNull(), F.struct(at, what))))
    held = rows.groupBy(id_col).agg(
        F.sum(F.size(F.coalesce("told", F.array().cast("array<string>")))).alias("n_turns"), in_order("from_turn", "told").alias("told"),
        in_order("turn", "reply").alias("replies"), F.sum("size").alias("formatted_chars"))
    loss = F.array_join("replies.reply", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return held.select(id_col, "n_turns", sha(F.array_join(F.flatten("told.told"), "")).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), sha(loss).alias("loss_sha256"), "formatted_chars")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one that says the control strings, formatted, written, read back and unescaped."""
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise(TRAINED).alias("role"),
                                F.lit("\\### Assistant: </turn> ok").alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)
    formatted, turns = examples(rows)
    written = Stored(formatted, "chat")
    turns.drop()
    return digests(written.df)


#: Lengths of the written turns give those of all prefixes.
ORACLE = f'''
WITH rows AS (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT -7, 0, 'user', '\\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, '{TRAINED}', '\\### Assistant: </turn> ok'),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS idx FROM rows),
sized AS (
  SELECT *, max(idx) OVER (PARTITION BY conv_id) AS last,
         length(role) + length(replace(replace(replace(text, '\\', '\\e'), '###', '\\h'), '{CLOSE}', '\\c'))
           + {len(OPEN + BETWEEN + CLOSE)} AS size FROM turns),
ended AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY idx) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = '{TRAINED}'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = '{TRAINED}'), '')) AS loss_sha256,
       (sum(upto) FILTER (role = '{TRAINED}' OR idx = last))::BIGINT AS formatted_chars
FROM ended GROUP BY conv_id
'''

ORACLES = {"op11_chat_examples": ORACLE}
QUERIES = {"op11_chat_examples": query}
