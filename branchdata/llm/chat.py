"""Chat formatting in budgeted windows, by DataFrame operations only.

A conversation's turns get running token sums; a turn belongs to the window
in whose stride its first token falls, so windows are spans of whole turns
and no turn is looked at twice to place it.  The stride leaves room in the
budget for the system turn, the history and the longest turn that fits beside
the system turn; where these leave less than a quarter of the budget, first the
history shrinks and then the stride.  Each window starts with the system turn and with the last turns of the window before, up
to ``history`` tokens; these are repeated, and only fresh assistant turns are
under the loss mask, so each assistant text is a target exactly once.

Running sums are taken in blocks of turns first, so a conversation with a
third of all rows is many groups.  (A digest of a whole conversation needs its
text in one row; that is ``read_back``'s, not the formatting's.)

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  In roles and
texts ``&``, ``<`` and ``[`` are escaped as character references (and line
ends in roles), so no control string can stand in a text; ``read_back`` undoes it.

Defined cases: null roles and texts are empty; rows are ordered by turn, then
role and text, null first; repeated rows are turns of their own; all rows of
null conv_id are one conversation; other columns are ignored; texts are kept
whole.  A turn that doesn't fit into the budget beside the system turn makes
its window go over it (``n_tokens`` > budget), no other does; nothing is cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUDGET = 1024
HISTORY = 256
BLOCK = 64           # turn numbers per block of running sums
BEGIN, END = "<|im_start|>", "<|im_end|>\n"
_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for a, b in pairs:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape(c: Column) -> Column:
    return _replace(c, list(_ESCAPES))


def unescape(c: Column) -> Column:
    return _replace(c, [("&#10;", "\n"), *((b, a) for a, b in reversed(_ESCAPES))])


def tokens(c: Column) -> Column:
    """Estimated tokens: words (one for each eight characters), single marks
    and the letters of scripts without spaces."""
    single = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
    return F.regexp_count(c, F.lit(rf"[{single}]|[\p{{L}}\p{{N}}&&[^{single}]]{{1,8}}|[^\s\p{{L}}\p{{N}}]")).cast("long")


def _numbered(turns: DataFrame, budget: int, history: int, block: int) -> DataFrame:
    """Turns with pos (from 1), before (tokens before it), stride and history
    (tokens repeated at most)."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("n", tokens(F.col("text")) + 4).withColumn("block", F.floor(F.col("turn") / block))
    own = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("sum", F.sum("n").over(upto)).withColumn("at", F.row_number().over(own).cast("long"))
    blocks = rows.groupBy("conv_id", "block").agg(
        F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("size"), F.collect_set(F.when(F.col("n") <= budget, F.col("n"))).alias("sizes"),     # at most ``budget`` values
        F.min(F.struct("turn", "role", "n")).alias("first"))
    conv = Window.partitionBy("conv_id")
    earlier = conv.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    system = F.min("first").over(conv)
    blocks = blocks.withColumn("system", F.when(system["role"] == "system", system["n"]).otherwise(0))
    fits = F.array_max(F.filter("sizes", lambda n: n + F.col("system") <= budget))
    room = F.lit(budget) - F.col("system") - F.max(fits).over(conv)         # null if no turn fits
    blocks = blocks.withColumn("room", F.coalesce(room, F.lit(budget // 4 + history)))
    kept = F.greatest(F.lit(0), F.least(F.lit(history), F.col("room") - budget // 4))
    blocks = blocks.select(
        F.col("conv_id").alias("c"), F.col("block").alias("b"),
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("turns_before"),
        kept.alias("history"), F.greatest(F.lit(1), F.col("room") - kept).alias("stride"))
    return (rows.join(blocks, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
            .select("conv_id", "role", "text", "n", "stride", "history", (F.col("turns_before") + F.col("at")).alias("pos"),
                    (F.col("tokens_before") + F.col("sum") - F.col("n")).alias("before")))


def chat_windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated (turns at
    its start that were formatted before), loss (array of start, length in
    code points of the text under the loss mask), n_tokens."""
    if not 0 <= history <= budget // 4:
        raise ValueError("history must be at most a quarter of the budget")
    t = (_numbered(turns, budget, history, block)
         .withColumn("window", F.floor(F.col("before") / F.col("stride"))))
    spans = t.groupBy("conv_id", "window").agg(F.min("before").alias("first"))
    order = Window.partitionBy("conv_id").orderBy("window")
    spans = spans.select(F.col("conv_id").alias("c"), F.col("window").alias("w"),
                         F.lead("window").over(order).alias("next"), F.lead("first").over(order).alias("next_first"))
    system = (F.col("pos") == 1) & (F.col("role") == "system")
    again = (F.col("next").isNotNull() & ~system & (F.col("next_first") - F.col("before") <= F.col("history")))
    own = t.join(spans, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("window") == F.col("w")))
    entry = ["conv_id", "window", "repeated", "pos", "role", "text", "n"]
    fresh = (own.withColumn("in", F.explode(F.array_compact(F.array(
                F.struct(F.col("window").alias("window"), F.lit(False).alias("repeated")),
                F.when(again, F.struct(F.col("next").alias("window"), F.lit(True).alias("repeated")))))))
             .select("conv_id", "in.window", "in.repeated", "pos", "role", "text", "n"))
    head = t.where(system).select(F.col("conv_id"), "pos", "role", "text", "n")
    heads = (head.join(spans.where("next is not null"), F.col("conv_id").eqNullSafe(F.col("c")))
             .withColumn("window", F.col("next")).withColumn("repeated", F.lit(True)).select(*entry))
    entries = (fresh.unionByName(heads)
               .withColumn("head", F.concat(F.lit(BEGIN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("&#10;")),
                                            F.lit("\n")))
               .withColumn("body", escape(F.col("text")))
               .withColumn("piece", F.concat("head", "body", F.lit(END))))
    inside = Window.partitionBy("conv_id", "window").orderBy("pos")
    entries = entries.withColumn("start", F.sum(F.length("piece")).over(
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("piece") + F.length("head"))
    target = ~F.col("repeated") & (F.col("role") == "assistant")
    return (entries.groupBy("conv_id", "window").agg(
                F.array_sort(F.collect_list(F.struct("pos", "piece", F.when(target, F.struct(
                    F.col("start").alias("start"), F.length("body").cast("long").alias("length"))).alias("loss")))).alias("t"),
                F.sum(F.col("repeated").cast("int")).alias("n_repeated"), F.sum("n").alias("n_tokens"))
            .select("conv_id", "window", F.array_join("t.piece", "").alias("formatted"), "n_repeated",
                    F.array_compact("t.loss").alias("loss"), "n_tokens"))


def read_back(windows: DataFrame) -> DataFrame:
    """The conversations parsed out of formatted windows: conv_id, n_turns,
    turns (role, line end, text, line end per turn), loss_text,
    formatted_chars, n_windows."""
    def turn(x: Column) -> Column:
        role = F.substring_index(x, "\n", 1)
        text = F.substring(x, F.length(role) + 2, F.length(x) - F.length(role) - F.lit(1 + len(END)))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    shown = F.split("formatted", r"<\|im_start\|>", -1)         # the first part is empty
    fresh = F.slice(shown, F.col("n_repeated") + 2, F.greatest(F.size(shown) - 1 - F.col("n_repeated"), F.lit(0)))
    masked = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1,
                                                                s["length"].cast("int"))))
    parts = windows.select("conv_id", "window", F.size(fresh).cast("long").alias("n"),
                           F.array_join(F.transform(fresh, turn), "").alias("turns"),
                           F.array_join(masked, "").alias("loss_text"),
                           F.length("formatted").cast("long").alias("chars"))
    return (parts.groupBy("conv_id").agg(
                F.sum("n").alias("n_turns"), F.array_sort(F.collect_list(F.struct("window", "turns", "loss_text"))).alias("w"),
                F.sum("chars").alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
            .select("conv_id", "n_turns", F.array_join("w.turns", "").alias("turns"),
                    F.array_join("w.loss_text", "").alias("loss_text"), "formatted_chars", "n_windows"))
