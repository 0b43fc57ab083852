"""Chat formatting by prefix-target expansion.

Every assistant turn is exploded into one training example: all preceding turns
are its context and only that reply carries loss.  An
example is one row that holds its whole formatted context, its own formatted
reply and the loss span, so the examples of a conversation grow with the square
of its length.

Template of one turn: ``<|turn|>role\\ntext<|end|>\\n``.  Inside roles and texts
a backslash is put before every backslash and into every control string (those
of this template and of other common ones), and a line feed in a role becomes
a backslash and n; one substitution undoes each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import materialise, table

TURN, END = "<|turn|>", "<|end|>\n"
#: Starts of strings that some chat template reads as control.
CONTROL = r"<\||</?s>|<<|\[/?INST\]|\[/?TOOL|\[/?AVAILABLE"
#: The extra conversation of the query: control strings inside a text.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    """Put a backslash before backslashes and after the first sign of a control string."""
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, f"(?={CONTROL})(.)", r"$1\\")


def escape_role(role: Column) -> Column:
    """As ``escape``; a line feed, which would end the header, becomes a backslash and n."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.S)


def format_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn, in columns conv_id, turn, position, role, segment, seg_start, seg_end, text_start.

    Turns are ordered by turn number (nulls first), then role, then text, so
    equal numbers and repeated rows have one order.  Null roles and texts count
    as empty; null conversations form one conversation; an empty table gives an
    empty one.  Texts may be of any length; a conversation is ordered in one
    task, sorted with spill.  Other input columns are not read, so their names
    cannot clash.  Offsets are code points of the formatted conversation;
    ``text_start`` is where the turn's text begins, ``seg_end`` less the end mark
    where it ends.
    """
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), role_.alias("role"), escape_role(role_).alias("__role"), escape(text_).alias("__text"))
    rows = rows.withColumn("segment", F.concat(F.lit(TURN), "__role", F.lit("\n"), "__text", F.lit(END)))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "__text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("position", F.count(F.lit(1)).over(order) - 1)
    rows = rows.withColumn("seg_end", F.sum(F.length("segment")).over(order)).withColumn("seg_start", F.col("seg_end") - F.length("segment"))
    return rows.select("conv_id", "turn", "position", "role", "segment", "seg_start", "seg_end", (F.col("seg_end") - len(END) - F.length("__text")).alias("text_start"))


def examples(turns: DataFrame) -> DataFrame:
    """One row per assistant turn: conv_id, position, context_end, context, reply, loss_start, loss_end.

    ``context`` is the formatted text of all turns before, ``context_end`` its
    length, and the example's text is the context and then ``reply``; the loss span
    lies in the reply and leaves out its header and end mark.  A conversation's
    examples together hold the square of its length, by definition; they are cut
    from it in one task.
    """
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "segment"))), lambda x: x["segment"]), "")
    targets = F.collect_list(F.when(F.col("role") == "assistant", F.struct("position", "seg_start", "seg_end", "text_start")))
    each = turns.groupBy("conv_id").agg(whole.alias("__whole"), targets.alias("__targets")).select("conv_id", "__whole", F.explode("__targets").alias("t")).select("conv_id", "__whole", "t.*")
    cut = lambda start, end: F.substring(F.col("__whole"), start + 1, end - start)
    context, reply = cut(F.lit(0), F.col("seg_start")), cut(F.col("seg_start"), F.col("seg_end"))
    return each.select("conv_id", "position", F.col("seg_start").alias("context_end"), context.alias("context"), reply.alias("reply"), F.col("text_start").alias("loss_start"), (F.col("seg_end") - len(END)).alias("loss_end"))


def example_texts(turns: DataFrame) -> DataFrame:
    """Examples as one text each: conv_id, position, text, loss_start, loss_end."""
    return examples(turns).select("conv_id", "position", F.concat("context", "reply").alias("text"), "loss_start", "loss_end")


_SEGMENT = re.compile(re.escape(TURN) + r"(.*?)\n(.*)" + re.escape(END) + r"\Z", re.S)
_DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold a conversation's turns and examples, in order, into one row; holds one turn at a time."""
    names = _DIGEST.replace(",", "").split()[::2]
    at, begun, n, many, turns, loss, loss_chars, chars = None, False, 0, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
    prefix, context = hashlib.sha256(), ""

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done, strict=True) if done else [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k.endswith("sha256") else pa.int64()) for k, c in zip(names, columns, strict=True)], names=names)

    for batch in batches:
        done: list[tuple] = []
        for conv, text, start, before in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "text", "start", "context")), strict=True):
            if not begun or conv != at:
                if begun:
                    done.append((at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, many))
                at, begun, n, many, turns, loss, loss_chars, chars = conv, True, 0, 0, hashlib.sha256(), hashlib.sha256(), 0, 0
                prefix = hashlib.sha256()
            if before is None:
                context = prefix.hexdigest()
                prefix.update(text.encode())
                role, body = _SEGMENT.match(text).groups()
                turns.update(f"{unescape_role(role)}\n{unescape(body)}\n".encode())
                n += 1
                chars += len(text)
                continue
            # An example stands right after the turn that is its reply; its context is all that came before that.
            if before != context or start + len(text) + len(END) != chars:
                raise ValueError(f"an example of conversation {conv} does not continue its context")
            trained = unescape(text)
            loss.update(trained.encode())
            loss_chars += len(trained)
            many += 1
        yield rows(done)
    if begun:
        yield rows([(at, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, many)])


def read_back(turns: DataFrame, targets: DataFrame) -> DataFrame:
    """Parse formatted turns and their examples again: digests of the turns, and of the text that the examples train on, per conversation."""
    none = F.lit(None).cast("string")
    whole = turns.select("conv_id", "position", F.lit(0).alias("kind"), F.col("segment").alias("text"), F.col("seg_start").alias("start"), none.alias("context"))
    # The loss text is cut from the whole example by its span; of the context only the digest is carried on.
    trained = F.substring(F.concat("context", "reply"), F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    part = targets.select("conv_id", "position", F.lit(1).alias("kind"), trained.alias("text"), F.col("loss_start").alias("start"), F.sha2("context", 256).alias("context"))
    return whole.unionByName(part).repartition("conv_id").sortWithinPartitions("conv_id", "position", "kind").mapInArrow(_read_back, _DIGEST)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -1, formatted, exploded into examples, then read back."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    turns = materialise(format_turns(given.unionByName(probe)), "turns")
    # Contexts repeat one another, so they are packed with a wide window.
    return read_back(turns, materialise(examples(turns), "examples", compression="zstd"))


OP7_SQL = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'),
sized AS (SELECT *, {len(TURN) + len(END) + 1}
  + length(role) + length(role) - length(replace(role, chr(10), '')) + length(role) - length(replace(role, '\\', '')) + len(regexp_extract_all(role, '{CONTROL}'))
  + length(text) + length(text) - length(replace(text, '\\', '')) + len(regexp_extract_all(text, '{CONTROL}')) AS n FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant') AS n_examples
FROM sized GROUP BY conv_id
"""
