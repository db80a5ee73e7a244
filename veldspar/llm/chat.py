"""Chat formatting in budgeted windows.

A conversation's turns are measured, and prefix sums of the measures choose
turn-aligned spans: turns whose sums before them fall into the same half budget
are one window's *new* turns. A window starts with the system turn (a first turn
of that role), repeats up to ``history`` turns before its new ones as far as the
budget allows, and marks as loss only the texts of new assistant turns, so each
is learned once however often it is shown.

Turns are written ``<|im_start|>role\\ntext<|im_end|>\\n``. A control string
inside a text or role gets one more backslash before its first bar, whatever
stands there already, so that ``unescaped`` gives the text back.

Plan: the windows are planned on numbers alone. A turn's place in the sums comes from two
levels, sums over ranges of turns and sums inside a range, so no task needs a whole
conversation; a range that holds very many rows of few turns is cut on by turn, role and hash. The plan lists for each turn the windows that show it. Texts are shuffled
twice: by range, to be numbered and meet their range's plan, and by conversation and
window. A window is bounded by the budget (every turn
measures 4 at least). A turn of more than half the budget can put its window
over it; it is not cut.

Defined results: a null text or role is empty; a null turn comes first; equal
turns are ordered by role and a hash of the text; rows of a null conversation id are one
conversation; repeated rows are turns of their own; a very long text is one turn, whole; an empty table gives no
windows; columns besides the four named are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import cut, require

START, END = "<|im_start|>", "<|im_end|>"
#: Crowded ranges that are sent to all tasks; more are met by a shuffle.
MOST_BROADCAST = 10_000
#: Bars of control strings, after any number of backslashes.
_PLAIN = r"<(\\*)\|(im_start|im_end)\|>"


def escaped(text: Column) -> Column:
    """``text`` without control strings: one backslash more before the bar of each."""
    return F.regexp_replace(text, _PLAIN, r"<$1\\|$2|>")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|(im_start|im_end)\|>", r"<$1|$2|>")


def escape(text: str) -> str:
    return re.sub(_PLAIN, lambda m: f"<{m[1]}\\|{m[2]}|>", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|(im_start|im_end)\|>", lambda m: f"<{m[1]}|{m[2]}|>", text)


def word_tokens(text: Column) -> Column:
    """Default measure of a turn: words and single other marks."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("bigint")


def windows(
    turns: DataFrame,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = 512,
    history: int = 2,
    measure=word_tokens,
    range_size: int = 1024,
    range_rows: int = 10_000,
) -> DataFrame:
    """One row for each window: conv_id, window, size, parts, text, loss.

    ``parts`` is array<struct<nth, role, new, start, end>>: the turns shown, in
    order, with the span of each escaped text in ``text`` (code points, end
    exclusive); ``loss`` is array<struct<start, end>>, the spans to be learned.
    ``nth`` counts the conversation's turns from 0.
    """
    require(turns, conv_col, turn_col, role_col, text_col)
    # A struct is a key that is never null.
    rows = turns.select(
        F.struct(F.col(conv_col).alias("id")).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        # Ranges of turn numbers; a null turn is in a range before all others.
        F.coalesce(F.floor(F.col(turn_col) / range_size).cast("bigint"), F.lit(-(1 << 62))).alias("turns"),
    ).withColumn("hash", F.xxhash64("text"))
    # A range of more than ``range_rows`` (many rows of one turn, or without one) is cut on along the rest of the order.
    crowded = cut(rows.groupBy("conv", "turns").agg(F.count("*").alias("rows")).where(F.col("rows") > range_rows).select("conv", "turns", F.lit(True).alias("crowded")))
    if crowded.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        crowded = F.broadcast(crowded)
    finer = [F.when(F.col("crowded"), c) for c in (F.col("turn"), F.col("role"), F.shiftright("hash", 56))]
    rows = rows.join(crowded, ["conv", "turns"], "left").withColumn("range", F.struct("turns", *[c.alias(n) for n, c in zip(("turn", "role", "hash"), finer, strict=True)])).drop("turns", "crowded")
    inside = Window.partitionBy("conv", "range").orderBy("turn", "role", "hash")
    number = (F.row_number().over(inside) - 1).alias("k")

    # The plan, without texts: which windows show turn k of a range.
    light = rows.select("conv", "range", "turn", "role", "hash", (F.greatest(measure(F.col("text")), F.lit(0)) + 4).alias("size"))
    light = light.select("conv", "range", "size", (F.col("role") == "system").alias("system"), number, (F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("sum_in"))
    totals = light.groupBy("conv", "range").agg(F.count("*").alias("n"), F.sum("size").alias("sum"))
    before = Window.partitionBy("conv").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("conv", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"))
    window = F.floor((F.col("sum_before") + F.col("sum_in")) / max(1, budget // 2)).cast("bigint")
    light = cut(light.join(totals, ["conv", "range"]).select("conv", "range", "k", (F.col("n_before") + F.col("k")).alias("nth"), window.alias("window"), "size", "system"))
    place = ["conv", "range", "k", "nth", "size"]
    parts = light.select(*place, "window", F.lit(0).alias("rank"))
    # The system turn, once more for every later window.
    system = light.where("nth = 0 and system").select(*place, F.col("window").alias("own"))
    later = light.select("conv", "window").distinct().join(system, "conv").where("window > own")
    parts = parts.unionByName(later.select(*place, "window", F.lit(1).alias("rank")))
    if history:
        # Turns before a window's first, looked up by number.
        back = light.groupBy("conv", "window").agg(F.min("nth").alias("first"))
        back = back.where("first > 0").select("conv", "window", F.explode(F.expr(f"sequence(greatest(first - {history}, 0L), first - 1)")).alias("nth"))
        again = back.join(light.drop("window"), ["conv", "nth"]).where("not (nth = 0 and system)")
        parts = parts.unionByName(again.select(*place, "window", F.lit(2).alias("rank")))
        first_come = Window.partitionBy("conv", "window").orderBy("rank", F.desc("nth"))
        parts = parts.withColumn("total", F.sum("size").over(first_come)).where(f"rank < 2 or total <= {int(budget)}")
    # A system turn can be in very many windows; they meet it by a join, all others in their range's map.
    shows = parts.where("rank <> 1").groupBy("conv", "range", "k", "nth").agg(F.collect_list(F.struct("window", (F.col("rank") == 0).alias("new"), "size")).alias("windows"))
    shows = shows.groupBy("conv", "range").agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("nth", "windows")))).alias("plan"))

    # The texts, once.
    head, body = escaped(F.col("role")), escaped(F.col("text"))
    texts = rows.select("conv", "range", "turn", "role", "hash", (F.length(head) + len(START) + 1).cast("bigint").alias("head"), F.concat(F.lit(START), head, F.lit("\n"), body, F.lit(END + "\n")).alias("shown"))
    texts = texts.select("conv", "range", number, "role", "head", "shown")
    turn = lambda new: F.struct("nth", "role", new.alias("new"), "head", "shown").alias("turn")
    met = texts.join(shows, ["conv", "range"]).select("conv", "role", "head", "shown", F.element_at("plan", F.col("k")).alias("p"))
    met = met.select("conv", "role", "head", "shown", F.col("p.nth").alias("nth"), F.explode("p.windows").alias("w"))
    parts_of = met.select("conv", "w.window", "w.size", turn(F.col("w.new")))
    firsts = texts.join(system.select("conv", "range", "k", "nth", "size", "own"), ["conv", "range", "k"])
    windows_of = light.select("conv", "window").distinct()
    repeated = windows_of.join(firsts, "conv").where("window > own").select("conv", "window", "size", turn(F.lit(False)))
    parts = parts_of.unionByName(repeated)
    made = parts.groupBy("conv", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"), F.sum("size").alias("size"))
    spans = F.expr(
        "aggregate(turns, named_struct('at', 0L, 'parts', cast(array() as array<struct<nth: bigint, role: string, new: boolean, start: bigint, end: bigint>>)),"
        " (a, t) -> named_struct('at', a.at + char_length(t.shown), 'parts', array_append(a.parts, named_struct('nth', t.nth, 'role', t.role, 'new', t.new,"
        f" 'start', a.at + t.head, 'end', a.at + char_length(t.shown) - {len(END) + 1}))), a -> a.parts)"
    )
    made = made.select(F.col("conv.id").alias("conv_id"), "window", "size", spans.alias("parts"), F.array_join(F.transform("turns", lambda t: t["shown"]), "").alias("text"))
    loss = F.transform(F.filter("parts", lambda p: p["new"] & (p["role"] == "assistant")), lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end")))
    return made.select("conv_id", "window", "size", "parts", "text", loss.alias("loss"))


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation, from its windows: conv_id, n_turns, turns_sha256,
    loss_chars, loss_sha256, formatted_chars.

    Roles and texts are those of the written text. What a window adds (its new turns, and where the loss
    mask is in them) is taken out first, so each turn travels once; the digests are made in order
    as that streams by, so a long conversation takes no memory.
    """
    count = int(made.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of = made.schema["conv_id"].dataType
    kind = of.simpleString()

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, parts, loss in zip(*(batch.column(c).to_pylist() for c in ("text", "parts", "loss")), strict=True):
                said, learned, n, at, begin = [], [], 0, 0, 0
                masked = {(x["start"], x["end"]) for x in loss}
                for p in parts:
                    start, end = p["start"], p["end"]
                    if p["new"]:
                        role, own = unescape(text[begin + len(START) : start - 1]), unescape(text[start:end])
                        said.append(f"{role}\n{own}\n")
                        n += 1
                        if (start, end) in masked:
                            masked.remove((start, end))
                            learned.append({"start": at + len(role) + 1, "end": at + len(role) + 1 + len(own)})
                        at += len(said[-1])
                    begin = end + len(END) + 1
                if masked:
                    raise ValueError("the loss mask covers what is no new turn's text")
                out.append({"n": n, "said": "".join(said), "learned": learned, "chars": len(text)})
            found = pa.Table.from_pylist(out, schema=taken).combine_chunks()
            if len(out):
                yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("window"), *(c.chunk(0) for c in found.columns)], names=["conv_id", "window", *taken.names])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None

        def row() -> pa.RecordBatch:
            (conv,) = now
            return pa.RecordBatch.from_pylist([{"conv_id": conv, "n_turns": state[0], "turns_sha256": state[1].hexdigest(), "loss_chars": state[2], "loss_sha256": state[3].hexdigest(), "formatted_chars": state[4]}], schema=found)

        for batch in batches:
            for w in batch.to_pylist():
                if now != (w["conv_id"],):
                    if now is not None:
                        yield row()
                    now, state = (w["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += w["n"]
                state[1].update(w["said"].encode())
                for p in w["learned"]:
                    state[2] += p["end"] - p["start"]
                    state[3].update(w["said"][p["start"] : p["end"]].encode())
                state[4] += w["chars"]
        if now is not None:
            yield row()

    taken = pa.schema([("n", pa.int64()), ("said", pa.string()), ("learned", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("chars", pa.int64())])
    found = pa.schema([("conv_id", to_arrow_type(of)), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    added = made.select("conv_id", "window", "text", "parts", "loss").mapInArrow(take, f"conv_id {kind}, window bigint, n bigint, said string, learned array<struct<start: bigint, end: bigint>>, chars bigint")
    dealt = added.repartition(count, "conv_id").sortWithinPartitions("conv_id", "window")
    return dealt.mapInArrow(digest, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
