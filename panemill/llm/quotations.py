"""Quotation linking: conversations in reply order, without the quotes.

Messages are read line by line; a line's quote level is the number of ``>`` it begins with.  Lines of one level in a row
make a passage, cut further at blank lines.  Passages are normalised (lower case, white space collapsed) and hashed, and
the quoted ones are joined, by thread and hash, to the own text of earlier messages: to the latest one, where several
match.  A message replies to the original of its shallowest quoted passage that has one.  What is left after taking the
quotes out is the message's own text; the thread's messages are ordered by the first message of their reply tree, then by
their own place, so that each reply follows what it answers.

A thread may hold any share of all rows.  Its places are numbered by range partitions with offsets; the last original before a quote is carried along
within runs of ``RUN`` places of one thread and hash, and from run to run, so a message repeated n times costs n rows, not n * n; roots are found by
doubling reply pointers.  Ids and numbers only are ordered: texts are joined to them afterwards, row by row.

Cases: null and empty texts have no passages; a null thread or place takes no part in linking and has no position; quotes without an original
are counted and taken out all the same; rows that repeat a thread and place are one message of several texts, repeated in the result with its
links and position; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panemill.llm.common import spread_join, written
from panemill.llm.components import roots

#: Places of a thread that one task orders at most, and messages of a row of ``conversations``.
RUN, MESSAGES = 1024, 500
_LEVEL = re.compile(r"^(?:[ \t]?>)+[ \t]?")


def passages(text: str | None) -> list[tuple[int, str]]:
    """(level, text) of the passages of a message, in order."""
    found: list[tuple[int, list[str]]] = []
    fresh = True
    for line in (text or "").split("\n"):
        mark = _LEVEL.match(line)
        level = mark[0].count(">") if mark else 0
        body = line[mark.end() :] if mark else line
        if not body.strip():
            fresh = True
        elif fresh or found[-1][0] != level:
            found.append((level, [body]))
            fresh = False
        else:
            found[-1][1].append(body)
    return [(level, "\n".join(lines)) for level, lines in found]


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> bytes:
    return hashlib.blake2b(normalised(text).encode(), digest_size=16).digest()


def parsed(messages: DataFrame, thread: str, place: str, text_col: str) -> DataFrame:
    """thread, place, own (text without quotes), hashes of own text and its passages, and quotes (level, n, hash)."""
    kinds = [messages.schema[c].dataType.simpleString() for c in (thread, place)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owns, hashes, quotes = [], [], []
            for text in batch.column(2).to_pylist():
                parts = passages(text)
                own = [body for level, body in parts if level == 0]
                owns.append("\n\n".join(own))
                hashes.append(sorted({digest(body) for body in own} | ({digest(" ".join(own))} if own else set())))
                quoted = [(level, body) for level, body in parts if level]
                blocks: dict[int, list[str]] = {}
                for level, body in quoted:
                    blocks.setdefault(level, []).append(body)
                found = [{"level": level, "hash": digest(body)} for level, body in quoted]
                # A level's passages together may be a whole message that held blank lines.
                quotes.append(found + [{"level": level, "hash": digest(" ".join(b))} for level, b in blocks.items() if len(b) > 1])
            kind = pa.list_(pa.struct([("level", pa.int32()), ("hash", pa.binary())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(owns, pa.string()), pa.array(hashes, pa.list_(pa.binary())), pa.array(quotes, kind)],
                names=["thread", "place", "own", "hashes", "quotes"],
            )

    schema = f"thread {kinds[0]}, place {kinds[1]}, own string, hashes array<binary>, quotes array<struct<level int, hash binary>>"
    return messages.select(messages[thread].alias("thread"), messages[place].alias("place"), messages[text_col].alias("text")).mapInArrow(run, schema)


def ranked(rows: DataFrame, thread: str, *order: str) -> DataFrame:
    """thread, order columns, rank: numbers 1, 2, ... of the distinct rows of each thread, by range partitions and offsets."""
    own = rows.select(thread, *order).distinct().where(" and ".join(f"`{c}` is not null" for c in (thread, *order)))
    own = written(own.repartitionByRange(thread, *order).withColumn("part", F.spark_partition_id()), "ranked")
    sizes = own.groupBy(thread, "part").agg(F.count("*").alias("n"))
    above = F.coalesce(F.sum("n").over(W.partitionBy(thread).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    number = F.row_number().over(W.partitionBy(thread, "part").orderBy(*order))
    numbered = own.withColumn("number", number).join(sizes.select(thread, "part", above.alias("above")), [thread, "part"])
    return written(numbered.select(thread, *order, (F.col("number") + F.col("above")).cast("long").alias("rank")), "ranks")


def last_before(originals: DataFrame, quotes: DataFrame) -> DataFrame:
    """quotes (thread, hash, rank, ...) with source: the greatest rank of an original (thread, hash, rank) below their own; those without one are left out."""
    events = originals.withColumn("kind", F.lit(1)).unionByName(quotes.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    events = written(events.withColumn("run", F.floor(F.col("rank") / RUN)), "events")
    source = F.when(F.col("kind") == 1, F.col("rank"))
    runs = events.groupBy("thread", "hash", "run").agg(F.max(source).alias("last"))
    earlier = W.partitionBy("thread", "hash").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = runs.select("thread", "hash", "run", F.max("last").over(earlier).alias("before"))
    inside = W.partitionBy("thread", "hash", "run").orderBy("rank", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = events.withColumn("inside", F.max(source).over(inside)).where("kind = 0").join(runs, ["thread", "hash", "run"])
    return found.withColumn("source", F.coalesce("inside", "before")).where("source is not null").drop("kind", "run", "inside", "before")


def link_quotes(messages: DataFrame, thread: str = "conv_id", place: str = "turn", text_col: str = "text") -> DataFrame:
    """thread, place, reply_to (place of the original, or null), root (place of the first message of its reply tree), position (1 ... in
    reply order), quotes (passages quoted), linked (quoted hashes with an original), deepest (level), own_text."""
    rows = written(parsed(messages, thread, place, text_col), "parsed")
    ranks = ranked(rows, "thread", "place")
    known = written(spread_join(rows.select("thread", "place", "hashes", "quotes"), ranks, ["thread", "place"]), "known")
    originals = known.select("thread", "rank", F.explode("hashes").alias("hash")).distinct()
    quoted = known.select("thread", "rank", F.explode("quotes").alias("quote")).select("thread", "rank", "quote.level", "quote.hash").distinct()
    latest = last_before(originals, quoted)
    answers = latest.groupBy("thread", "rank").agg(F.min(F.struct("level", (-F.col("source")).alias("back"))).alias("best"), F.count("*").alias("linked"))
    answers = written(answers.select("thread", "rank", (-F.col("best.back")).alias("source"), "linked"), "answers")

    tops = roots(answers, "thread", "rank", "source")
    tree = ranks.join(answers, ["thread", "rank"], "left").join(tops, ["thread", "rank"], "left").withColumn("root", F.coalesce("root", "rank"))
    tree = written(tree, "tree")
    positions = _positions(tree)
    place_of = lambda c: ranks.select("thread", F.col("rank").alias(c), F.col("place").alias(f"{c}_place"))
    tree = written(spread_join(tree, place_of("root"), ["thread", "root"]), "tree")
    replies = spread_join(tree.where("source is not null"), place_of("source"), ["thread", "source"])
    tree = replies.unionByName(tree.where("source is null"), allowMissingColumns=True).join(positions, ["thread", "rank"])
    tree = tree.select("thread", "place", F.col("source_place").alias("reply_to"), F.col("root_place").alias("root"), "position", "linked")
    out = spread_join(rows, tree, ["thread", "place"], "left")
    return out.select(
        F.col("thread").alias(thread),
        F.col("place").alias(place),
        "reply_to",
        F.coalesce("root", "place").alias("root"),
        "position",
        F.size(F.array_distinct("quotes.hash")).alias("quotes"),
        F.coalesce("linked", F.lit(0).cast("long")).alias("linked"),
        F.coalesce(F.array_max("quotes.level"), F.lit(0)).alias("deepest"),
        F.col("own").alias("own_text"),
    )


def _positions(tree: DataFrame) -> DataFrame:
    """thread, rank, position: places by the first message of their reply tree, then by themselves."""
    numbered = ranked(tree.select("thread", "root", F.col("rank").alias("own rank")), "thread", "root", "own rank")
    return numbered.select("thread", F.col("own rank").alias("rank"), F.col("rank").alias("position"))


def conversations(linked: DataFrame, thread: str = "conv_id", place: str = "turn", most: int = MESSAGES) -> DataFrame:
    """thread, root, part, messages (array of position, place, reply_to, text, in reply order): linked messages as conversations without quotes.

    A row is a reply tree; one of many messages continues in rows of at most about ``most`` messages, numbered by part.
    """
    rows = linked.where("position is not null").withColumn("part", F.floor(F.col("position") / most))
    message = F.struct("position", F.col(place).alias("place"), "reply_to", F.col("own_text").alias("text"))
    return rows.groupBy(thread, "root", "part").agg(F.array_sort(F.collect_list(message)).alias("messages"))


def as_mail(turns: DataFrame, thread: str = "conv_id", place: str = "turn", text_col: str = "text") -> DataFrame:
    """Turns as mail would hold them: each quotes the turn before, which quotes the one before it.

    The turn before is the one of the next lower place; of several texts of a place the least is quoted.
    """

    def quoted(text, mark: str):
        return F.when(F.length(F.trim(text)) > 0, F.concat(F.regexp_replace(text, "(?m)^", mark), F.lit("\n"))).otherwise("")

    rows = turns.select(F.col(thread).alias("thread"), F.col(place).alias("place"), F.col(text_col).alias("text"))
    ranks = ranked(rows, "thread", "place")
    least = rows.groupBy("thread", "place").agg(F.min("text").alias("text"))
    texts = written(ranks.join(least, ["thread", "place"]).select("thread", "rank", "text"), "turns")
    back = lambda n: texts.select("thread", (F.col("rank") + n).alias("rank"), F.col("text").alias(f"back{n}"))
    before = ranks.join(back(1), ["thread", "rank"], "left").join(back(2), ["thread", "rank"], "left")
    mail = spread_join(rows, written(before, "before"), ["thread", "place"], "left")
    text = F.concat(quoted(F.coalesce("back2", F.lit("")), ">> "), quoted(F.coalesce("back1", F.lit("")), "> "), F.lit("\n"), F.coalesce("text", F.lit("")))
    return mail.select(F.col("thread").alias(thread), F.col("place").alias(place), text.alias(text_col))
