"""Chat formatting by quotation linking: threads in reply order, without quotes.

Lines that start with ``>`` are quoted, as often as the mark is repeated. Runs of
lines of one level are passages; what is left, without the line that says who
wrote what follows, is the message's own text. The norm of a passage (a-z for
A-Z, single spaces) is hashed, whole, by paragraph and by line, and joined to the
hashes of other messages' own texts, paragraphs and lines. A whole passage goes
before a paragraph and that before a single line, a message of the same
conversation before others, an earlier one before a later one. Messages of other
conversations are linked by whole passages only, of ``far_words`` words and more.
With the default of one word all are; the query asks for ``FAR_WORDS``, since short
lines such as thanks are said in many.

A message replies to the message that its first outermost quote links to, else
to the one before it in its conversation. Only earlier messages, by conversation
and turn, are linked, so replies form trees; their roots and depths are found by
jumping over ever longer paths, in as many rounds as the depth has binary
digits. Sorting by ``thread_conv, thread_turn, depth, turn`` gives reply order.

Defined cases: conversation ids of any type that can be ordered are taken as they are;
null and empty texts have no passages and an empty own text; rows
that repeat conversation and turn share a place in the tree, that of the least
parent, and are returned one by one; rows without conversation or turn are their
own threads; an empty table gives an empty result; other columns are not looked
at. Very long messages are one row each; of equal passages the earliest message
is linked, first by conversation, then by turn.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .base import materialise, slices, table, texts_of

_QUOTE = re.compile(r"[ \t]{0,3}((?:>[ \t]?)+)")
#: The line before a quote that says whose it is.
_WROTE = re.compile(r"[ \t]*On [^\n]{1,300} wrote:[ \t\r]*")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Least words of a passage that links to another conversation, in the query.
FAR_WORDS = 8
#: Turns of a conversation that one task sorts together.
TURNS = 1000


def norm(text: str) -> str:
    return " ".join(text.translate(_LOWER).split())


def passage_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(norm(text).encode("utf-8", "surrogatepass")) - (1 << 63)


def parse(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """The own text, and the passages as (level, lines) in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    before = 0
    for line in text.split("\n"):
        m = _QUOTE.match(line)
        level = m[1].count(">") if m else 0
        if not level:
            own.append(line)
        elif level == before:
            passages[-1][1].append(line[m.end() :])
        else:
            if not before:
                at = len(own) - 1
                while at > 0 and not own[at].strip():
                    at -= 1
                if at >= 0 and _WROTE.fullmatch(own[at]):
                    del own[at]
            passages.append((level, [line[m.end() :]]))
        before = level
    return re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n"), [p for p in passages if any(x.strip() for x in p[1])]


#: How much of a passage agrees.
WHOLE, PARAGRAPH, LINE = range(3)


def _paragraphs(text: str) -> list[str]:
    return [x for x in re.split(r"\n[^\S\n]*\n", text) if x.strip()]


def passage_hashes(lines: list[str]) -> list[tuple[int, int, int]]:
    """The units of a passage as (unit, hash, words of the passage), each hash once."""
    text = "\n".join(lines)
    units = [(WHOLE, text), *((PARAGRAPH, x) for x in _paragraphs(text)), *((LINE, x) for x in lines if x.strip())]
    seen: dict[int, int] = {}
    for unit, x in units:
        seen.setdefault(passage_hash(x), unit)
    n = len(text.split())
    return [(unit, h, n) for h, unit in seen.items()]


def own_hashes(own: str) -> list[int]:
    units = {own, *_paragraphs(own), *own.split("\n")}
    return sorted({passage_hash(x) for x in units if x.strip()})


def _parsed(messages: DataFrame) -> DataFrame:
    quotes = pa.list_(
        pa.struct(
            [("level", pa.int32()), ("hashes", pa.list_(pa.struct([("unit", pa.int32()), ("hash", pa.int64()), ("words", pa.int64())])))]
        )
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                got = [parse(t) for t in texts_of(part)]
                found = [
                    [
                        {
                            "level": level, "hashes": [dict(zip(("unit", "hash", "words"), x, strict=True)) for x in passage_hashes(lines)]
                        } for level,
                        lines in p
                    ] for _,
                    p in got
                ]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("conv"), part.column("turn"), part.column("role"), pa.array([o for o, _ in got], pa.string()),
                        pa.array([own_hashes(o) for o, _ in got], pa.list_(pa.int64())), pa.array(found, quotes)
                    ],
                    ["conv", "turn", "role", "own_text", "own", "quotes"],
                )

    kind = messages.schema["conv"].dataType.simpleString()
    return messages.mapInArrow(
        run,
        f"conv {kind}, turn long, role string, own_text string, own array<long>, quotes array<struct<level:int,hashes:array<struct<unit:int,hash:long,words:long>>>>"
    )


def _linked(rows: DataFrame, far_words: int) -> DataFrame:
    """``(conv, turn, pos, level, to_conv, to_turn)`` of the passages that link."""
    own = rows.where("conv is not null and turn is not null").select(F.explode("own").alias("hash"), "conv", "turn")
    # One message stands for all that say the same, so that common texts don't multiply.
    near = own.groupBy("hash", "conv").agg(F.min("turn").alias("near_turn"))
    far = near.groupBy("hash").agg(F.min(F.struct("conv", "near_turn")).alias("far"))
    asked = rows.where("conv is not null and turn is not null").select("conv", "turn", F.posexplode("quotes").alias("pos", "quote"))
    asked = asked.select(
        "conv", "turn", "pos", "quote.level", F.explode("quote.hashes").alias("x")
    ).select("conv", "turn", "pos", "level", "x.*")
    found = asked.join(near, ["hash", "conv"], "left").join(far, "hash", "left")
    inner = F.when(F.col("near_turn") < F.col("turn"), F.struct(F.col("conv").alias("to_conv"), F.col("near_turn").alias("to_turn")))
    whole = (F.col("unit") == WHOLE) & (F.col("words") >= far_words)
    outer = F.when(
        whole & (F.col("far.conv") < F.col("conv")), F.struct(F.col("far.conv").alias("to_conv"), F.col("far.near_turn").alias("to_turn"))
    )
    to = F.coalesce(inner, outer)
    best = found.where(to.isNotNull()).groupBy("conv", "turn", "pos", "level").agg(
        F.min(F.struct("unit", F.when(inner.isNotNull(), 0).otherwise(1).alias("outer"), to.alias("to"))).alias("best")
    )
    return best.select("conv", "turn", "pos", "level", "best.to.to_conv", "best.to.to_turn")


def _before(nodes: DataFrame) -> DataFrame:
    """``(conv, turn, before_turn)``: the turn before, found in runs of bounded length."""
    nodes = nodes.withColumn("run", F.floor(F.col("turn") / TURNS))
    within = Window.partitionBy("conv", "run").orderBy("turn")
    tails = nodes.groupBy("conv", "run").agg(F.max("turn").alias("tail"))
    tails = tails.withColumn("tail", F.lag("tail").over(Window.partitionBy("conv").orderBy("run")))
    return nodes.withColumn("own_before", F.lag("turn").over(within)).join(tails, ["conv", "run"]).select(
        "conv", "turn", F.coalesce("own_before", "tail").alias("before_turn")
    )


def _threads(parents: DataFrame) -> DataFrame:
    """``(conv, turn, thread_conv, thread_turn, depth)`` from ``(conv, turn, to_conv, to_turn)``.

    Messages whose path ends at a root are done and only looked up afterwards.
    """
    root = F.col("to_turn").isNull()
    at = parents.select(
        "conv", "turn", F.coalesce("to_conv", "conv").alias("up_conv"), F.coalesce("to_turn", "turn").alias("up_turn"),
        F.when(root, 0).otherwise(1).cast("long").alias("depth"), root.alias("done")
    )
    at = materialise(at, "paths")
    done, todo = at.where("done"), at.where("not done")
    while not todo.isEmpty():
        up = done.unionByName(todo).select(
            F.col("conv").alias("up_conv"), F.col("turn").alias("up_turn"), F.col("up_conv").alias("top_conv"),
            F.col("up_turn").alias("top_turn"), F.col("depth").alias("more"), F.col("done").alias("ends")
        )
        at = todo.join(up, ["up_conv", "up_turn"]).select(
            "conv", "turn", F.col("top_conv").alias("up_conv"), F.col("top_turn").alias("up_turn"),
            (F.col("depth") + F.col("more")).alias("depth"), F.col("ends").alias("done")
        )
        at = materialise(at, "paths")
        done, todo = done.unionByName(at.where("done")), at.where("not done")
    return done.select("conv", "turn", F.col("up_conv").alias("thread_conv"), F.col("up_turn").alias("thread_turn"), "depth")


def reply_order(
    messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    far_words: int = 1
) -> DataFrame:
    """Each message without its quotes, and its place in its thread.

    ``(conv, turn, role, own_text, n_quotes, n_linked, max_level, parent_conv,
    parent_turn, thread_conv, thread_turn, depth)``.
    """
    conv = F.col(conv_col)
    conv = conv.cast("long") if isinstance(messages.schema[conv_col].dataType, IntegralType) else conv
    rows = messages.select(
        conv.alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text")
    )
    rows = materialise(_parsed(rows), "messages")
    links = materialise(_linked(rows, far_words), "links")
    nodes = rows.where("conv is not null and turn is not null").select("conv", "turn").distinct()
    first = links.groupBy("conv", "turn").agg(
        F.min(F.struct("level", "pos", "to_conv", "to_turn")).alias("to"), F.countDistinct("pos").alias("n_linked")
    )
    first = first.select("conv", "turn", "to.to_conv", "to.to_turn", "n_linked")
    parents = _before(nodes).join(first, ["conv", "turn"], "left")
    parents = parents.select(
        "conv", "turn", F.coalesce("to_conv", F.when(F.col("before_turn").isNotNull(), F.col("conv"))).alias("to_conv"),
        F.coalesce("to_turn", "before_turn").alias("to_turn"), F.coalesce("n_linked", F.lit(0)).alias("n_linked")
    )
    parents = materialise(parents, "parents")
    placed = parents.join(_threads(parents), ["conv", "turn"])
    out = rows.join(placed, ["conv", "turn"], "left")
    return out.select(
        F.col("conv").alias(conv_col), F.col("turn").alias(turn_col), F.col("role").alias(role_col), "own_text", F.size("quotes").cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        F.coalesce(F.array_max(F.transform("quotes", lambda q: q["level"])), F.lit(0)).cast("long").alias("max_level"),
        F.col("to_conv").alias("parent_conv"), F.col("to_turn").alias("parent_turn"), F.coalesce("thread_conv", "conv").alias("thread_conv"), F.coalesce("thread_turn", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )


def op9_quote_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reply_order(table(spark, sf_dir, "conversations"), far_words=FAR_WORDS)
    own = F.col("own_text")
    return found.select(
        "conv_id", "turn", "role", F.sha2(own, 256).alias("own_sha256"), F.char_length(own).cast("long").alias("own_chars"), "n_quotes",
        "n_linked", "max_level", "parent_conv", "parent_turn", "thread_conv", "thread_turn", "depth"
    )
