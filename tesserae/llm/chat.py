"""Chat formatting with Spark expressions only.

A conversation's rows are collected as structs and sorted by turn, role and text as they stand; adjacent turns of one
role are merged into one block, and array aggregations give the turns' places; blocks are concatenated. A block is
`<|role|>` role, then its turns, each behind `<|text|>`, then `<|end|>`. Inside a text or role, a backslash is doubled and
one is put after the first character of every control string (of this template or the usual others: `<|`, `<s>`, `</s>`,
`[INST]`, `[/INST]`), so the output never holds a control string that came from a text, and reading it back is exact.

The loss mask covers the texts of the assistant's turns; `mask` gives its spans in characters of the output.

Defined cases: a null text is empty; a null role is an empty role; rows of equal turn are sorted by role and text,
null turns come first; repeated rows stay; rows of a null conv_id form one conversation; no rows, no output.
A conversation's output is one string, so its turns meet in one task; other conversations' don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
#: The first character of a control string, where the rest of it follows.
CONTROL = r"(<(?=\||/?s>)|\[(?=/?INST\]))"
#: As CONTROL, without look-ahead, for engines that lack it.
CONTROL_PARTS = r"(<)(\||/?s>)|(\[)(/?INST\])"


def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), CONTROL, "$1\\\\")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)\\(.)", "$1")


#: Arrays are summed and texts cut so many elements at a time: work is linear in a conversation's length.
STEP = 256


def _pieces(array: Column) -> Column:
    """The array in pieces of STEP elements, none for an empty one."""
    last = F.floor((F.size(array) - 1) / STEP).cast("int")
    return F.when(F.size(array) == 0, F.slice(F.array(array), 1, 0)).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: F.slice(array, k * STEP + 1, STEP)))


def format_conversations(rows: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and mask (array of start, length in characters), a row per conversation."""
    empty = F.lit("")
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce(F.col("text").cast("string"), empty).alias("text"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    # Sorted as they are, escaped afterwards.
    escaped = lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == learned_role).alias("learned"))
    turns = turns.select("conv_id", F.transform("turns", escaped).alias("turns"))

    def merged(t: Column, k: Column) -> Column:
        """A turn's part of the output: one that continues its predecessor's block has no head."""
        new = (k == 0) | (F.get(F.col("turns"), k - 1)["role"] != t["role"])
        head = F.when(new, F.concat(F.when(k > 0, END).otherwise(""), F.lit(ROLE), t["role"], F.lit(TEXT))).otherwise(TEXT)
        return F.struct(head.alias("head"), t["text"].alias("text"), t["learned"].alias("learned"))

    parts = turns.select("conv_id", F.transform("turns", merged).alias("parts"))
    size = lambda p: F.char_length(p["head"]) + F.char_length(p["text"])
    total = lambda piece: F.aggregate(piece, F.lit(0), lambda n, p: n + size(p))
    start = "cast(named_struct('at', {}, 'spans', array()) as struct<at:int,spans:array<struct<start:int,length:int>>>)"

    def placed(s: Column, p: Column) -> Column:
        """The span of a part's text, appended if it is learned."""
        span = F.array(F.struct((s["at"] + F.char_length(p["head"])).alias("start"), F.char_length(p["text"]).alias("length")))
        return F.struct((s["at"] + size(p)).alias("at"), F.when(p["learned"], F.concat(s["spans"], span)).otherwise(s["spans"]).alias("spans"))

    def spans(piece: Column) -> Column:
        return F.aggregate(piece, F.expr(start.format(0)), placed)["spans"]

    text = F.concat(F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["text"])), ""), F.lit(END))
    pieces = parts.select("conv_id", text.alias("formatted"), F.transform(_pieces(F.col("parts")), lambda p: F.struct(total(p).alias("size"), spans(p).alias("spans"))).alias("pieces"))
    bases = F.aggregate("pieces", F.expr("array(0)"), lambda b, p: F.concat(b, F.array(F.element_at(b, -1) + p["size"])))
    # A base comes to its piece as an element: inside the lambda, all bases would be summed anew for each span.
    moved = lambda p, base: F.transform(p["spans"], lambda s: F.struct((s["start"] + base).alias("start"), s["length"].alias("length")))
    return pieces.select("conv_id", "formatted", F.flatten(F.zip_with("pieces", F.slice(bases, 1, F.size("pieces")), moved)).alias("mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and learned (the unescaped text under the mask), from the output alone."""
    literal = lambda s: "\\Q" + s + "\\E"
    blocks = F.filter(F.split("formatted", literal(ROLE)), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.regexp_replace(b, literal(END) + "$", ""), literal(TEXT)))
    turns = F.flatten(F.transform(parts, lambda p: F.transform(F.slice(p, 2, F.size(p)), lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")))))

    def cut(piece: Column) -> Column:
        """The texts under a piece of the mask, cut from the stretch that holds them."""
        first, last = piece[0]["start"], F.element_at(piece, -1)
        stretch = F.array(F.substring(F.col("formatted"), first + 1, last["start"] + last["length"] - first))
        return F.array_join(F.flatten(F.transform(stretch, lambda x: F.transform(piece, lambda m: unescape(F.substring(x, m["start"] - first + 1, m["length"]))))), "")

    learned = F.array_join(F.transform(_pieces(F.col("mask")), cut), "")
    return formatted.select("conv_id", "formatted", turns.alias("turns"), learned.alias("learned"))


def digest(formatted: DataFrame) -> DataFrame:
    """The lengths and hashes of what is read back from the output."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"), F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
