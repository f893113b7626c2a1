"""Chat formatting of reply trees.

Messages point to the message they answer. Self-joins that double the distance
climbed give every message its root, its depth and the score of its path;
leaves are ranked by that score below each root, the chosen leaves' paths are
listed by the same doubling, and each path becomes one formatted conversation
with the spans that a loss covers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.store import discard, stored
from lodestone.operators.windows import top_k

START, END, OPEN, CLOSE = "<s>", "</s>", "<|im_start|>", "<|im_end|>"
#: Strings that have a meaning to a trainer; none of them is left inside a text or role.
CONTROL = [START, END, OPEN, CLOSE, "<|endoftext|>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
#: Goes behind the first character of a control string, once more than it already stands there.
MARK = "~"
_HIDE = re.compile(rf"([<\[])(?={MARK}*(?:{'|'.join(sorted({re.escape(c[1:]) for c in CONTROL}))}))")
_SHOW = re.compile(rf"([<\[]){MARK}(?={MARK}*(?:{'|'.join(sorted({re.escape(c[1:]) for c in CONTROL}))}))")
#: Formatted characters gathered before a batch is handed on.
BATCH_CHARS = 1 << 22


# ---- template ----------------------------------------------------------------------------

def hide(text: str) -> str:
    """``text`` without a control string. A first character followed by marks and the rest of a control string gets one more mark."""
    return _HIDE.sub(rf"\1{MARK}", text)


def show(text: str) -> str:
    """Undoes ``hide``."""
    return _SHOW.sub(r"\1", text)


def head(role: str) -> str:
    """Opens a turn; a line break in a role is written as ``%0A``."""
    return f"{OPEN}{hide(role.replace('%', '%25').replace(chr(10), '%0A'))}\n"


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for part in formatted[len(START):len(formatted) - len(END)].split(OPEN)[1:]:
        role, _, text = part.partition("\n")
        turns.append((show(role).replace("%0A", "\n").replace("%25", "%"), show(text[:-len(CLOSE) - 1])))
    return turns


def under_loss(formatted: str, spans: list[dict]) -> str:
    """What a loss covers, as it was before formatting."""
    return "".join(show(formatted[s["start"]:s["end"]]) for s in spans)


# ---- paths -------------------------------------------------------------------------------

def _parents(messages: DataFrame) -> DataFrame:
    """(node, up, score): one row for each message id; ``up`` is null where no such message is there."""
    one = messages.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("parent", "score")).alias("m")).select("node", "m.parent", "m.score")
    ids = one.select(F.col("node").alias("parent"), F.col("node").alias("up"))
    answers = one.where("parent IS NOT NULL").join(ids, "parent", "left").select("node", "up", "score")  # no null key gathers the roots
    return answers.unionByName(one.where("parent IS NULL").select("node", F.col("parent").alias("up"), "score")).withColumn("score", F.coalesce("score", F.lit(0.0)))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """((node, root, depth, total), jumps, tables): depth counts the messages of the path; ``jumps[k]`` is (node, up) over 2^k steps.

    Messages that have arrived take no part in a join, so no null key gathers
    them. Whoever is still on the way after as many rounds as the number of
    messages has binary digits is in a ring or below one.
    """
    at = stored(nodes.select("node", "up", F.col("node").alias("root"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total")), "chat-climb")
    jumps, limit = [], max(at.count(), 1).bit_length()
    tables = [at]
    going = at.where("up IS NOT NULL")
    while len(jumps) <= limit and not going.isEmpty():
        jumps.append(going.select("node", "up"))
        above = at.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("root").alias("_root"), F.col("depth").alias("_depth"), F.col("total").alias("_total"))
        moved = going.join(above, "up").select("node", F.col("_up").alias("up"), F.col("_root").alias("root"), (F.col("depth") + F.col("_depth")).alias("depth"), (F.col("total") + F.col("_total")).alias("total"))
        at = stored(at.where("up IS NULL").unionByName(moved), "chat-climb")
        tables.append(at)
        going = at.where("up IS NOT NULL")
    return at.where("up IS NULL").drop("up"), jumps, tables


def paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """(path, root, rank, position, node): the ``best`` branches of every root, each from its root (position 0) to its leaf.

    ``messages`` is (node, parent, score). A branch is named by its leaf and
    ranked by the sum of its messages' scores (null: 0), equal sums by leaf. A
    message whose parent is null or not there is a root; rows of one id count
    once, the least (parent, score) of them; rows without an id and messages
    that hang on a ring, which have no root, are on no path.
    """
    nodes = stored(_parents(messages), "chat-nodes")
    reached, jumps, tables = _climb(nodes)
    leaves = reached.join(nodes.select(F.col("up").alias("node")).where("node IS NOT NULL").distinct(), "node", "left_anti")
    chosen = top_k(leaves, ["root"], [F.desc("total"), F.asc("node")], best, "rank")
    path = stored(chosen.select(F.col("node").alias("path"), "root", "rank", "depth", "node", F.lit(0).cast("long").alias("above")), "chat-paths")
    for k in reversed(range(len(jumps))):
        further = path.join(jumps[k], "node").select("path", "root", "rank", "depth", F.col("up").alias("node"), (F.col("above") + F.lit(1 << k)).alias("above"))
        longer = stored(path.unionByName(further), "chat-paths")
        discard(path)
        path = longer
    for t in [nodes, *tables]:
        discard(t)
    return path.select("path", "root", "rank", (F.col("depth") - 1 - F.col("above")).alias("position"), "node")


# ---- formatting --------------------------------------------------------------------------

OUT = "path string, root string, rank int, formatted string, loss array<struct<start:long,end:long>>"
_ARROW = pa.schema([("path", pa.string()), ("root", pa.string()), ("rank", pa.int32()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _writer(trained: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars, now, parts, loss, at = [], 0, None, [], [], 0

        def close():
            rows.append({"path": now[0], "root": now[1], "rank": now[2], "formatted": "".join([*parts, END]), "loss": loss})

        for batch in batches:
            for path, root, rank, role, text in zip(*(batch.column(c).to_pylist() for c in ("path", "root", "rank", "role", "text"))):
                if now is None or path != now[0]:
                    if now:
                        close()
                        chars += at
                        if chars > BATCH_CHARS:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, chars = [], 0
                    now, parts, loss, at = (path, root, rank), [START], [], len(START)
                opened, body = head(role or ""), hide(text or "")
                if role in trained:
                    loss.append({"start": at + len(opened), "end": at + len(opened) + len(body)})
                parts += [opened, body, CLOSE, "\n"]
                at += len(opened) + len(body) + len(CLOSE) + 1
        if now:
            close()
        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return run


def conversations(messages: DataFrame, best: int = 1, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(path, root, rank, formatted, loss): each chosen branch of each reply tree as one formatted conversation.

    ``messages`` is (node, parent, score, role, text), ids as strings; other
    columns are ignored. A null role or text is an empty one. ``loss`` lists
    where the texts of ``trained`` roles stand in ``formatted``, in code
    points. Of the rows of one id the least (parent, score, role, text) counts.
    Texts join the paths once paths are known, and a path's turns come to its
    task in order, so that no more than one conversation is held at a time.
    """
    spark = messages.sparkSession
    kept = messages.where("node IS NOT NULL").groupBy("node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("m")).select("node", "m.*")
    kept = stored(kept, "chat-messages")
    turns = paths(kept.select("node", "parent", "score"), best).join(kept.select("node", "role", "text"), "node")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartition(n, "path").sortWithinPartitions("path", "position").select("path", "root", "rank", "role", "text").mapInArrow(_writer(frozenset(trained)), OUT)


DIGEST = "path string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What formatted conversations say when they are read back: their turns, and the text under their loss."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            formatted, spans = batch.column("formatted")[i].as_py(), batch.column("loss")[i].as_py()
            turns, loss = read_back(formatted), under_loss(formatted, spans)
            rows.append((batch.column("path")[i].as_py(), len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)))
        cols = list(zip(*rows)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (0, 2, 4) else pa.int64()) for i, c in enumerate(cols)], ["path", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def as_messages(rows: DataFrame) -> DataFrame:
    """Messages of (conv_id, turn, role, text) rows: each turn answers the one before it.

    Turns of equal number go by role, then text, nulls first; a null id is a
    conversation of its own. The id of a message is its conversation's, with
    its place; its score is the number of its characters.
    """
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    spot = lambda n: F.concat(name, F.lit(":"), n.cast("string"))
    return rows.select("conv_id", "turn", "role", "text").withColumn("place", place).select(
        spot(F.col("place")).alias("node"), F.when(F.col("place") > 1, spot(F.col("place") - 1)).alias("parent"),
        F.coalesce(F.char_length("text"), F.lit(0)).cast("double").alias("score"), "role", "text")


def _escaped(column: str) -> str:
    rest = "|".join(sorted({re.sub(r"([|\[\]])", r"\\\1", c[1:]) for c in CONTROL}))
    return rf"regexp_replace({column}, '([<\[])({MARK}*({rest}))', '\1{MARK}\2', 'g')"


SQL = f"""
WITH rows AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
form AS (SELECT *, {len(OPEN) + len(CLOSE) + 2} + length({_escaped("replace(replace(role, '%', '%25'), chr(10), '%0A')")}) + length({_escaped('text')}) AS chars FROM rows)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(START) + len(END)} + sum(chars))::BIGINT AS formatted_chars
FROM form GROUP BY conv_id
"""
