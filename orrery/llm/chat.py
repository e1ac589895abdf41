"""Chat formatting of reply trees: each chosen path from the root to a leaf becomes one conversation.

Messages have an id, the id of the message they answer, a role, a text and a
score. ``paths`` enumerates root-to-leaf paths by iterative self-joins: each message
holds the ancestor it has reached, with the sum of scores and the number of
messages on the way, and takes over what that ancestor holds, which doubles the
distance. Branches are ranked in their tree by their mean score, and the best are
chosen (or all); the messages of the chosen paths are then listed by the same
steps, largest first. A message that very many answer is a hot key of the left
side of those joins, which AQE splits; the right side has it once. Ranks are cut
before the shuffle (a row number up to a limit).

``formatted`` writes a path as text: every turn between marks of its role. A control
string within a text, or one that escapes one, gets a backslash after its first
character more; ``parsed`` takes one away, so that texts come back exactly.
``mask`` are the spans of code points that the loss is taken over: the assistant's
texts, without marks. One conversation is one row, so it has to fit into a task.

Defined results: a null text or role is empty; a reply to a message that is not
there is a root; of rows that repeat an id in a tree the least stands for all;
ties of scores go by the least id, a null score counts 0; replies in a circle have
no root, and are an error; an empty table has no paths; further columns are not
carried.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from orrery.llm import shared

ASSISTANT = "assistant"


@dataclass(frozen=True)
class Template:
    """Marks before and after the text of each role; those of other roles have the role in hexadecimal digits."""

    marks: dict[str, tuple[str, str]] = field(
        default_factory=lambda: {"system": ("[SYS]", "[/SYS]"), "user": ("[INST]", "[/INST]"), "assistant": ("[OUT]", "</s>")}
    )
    begin: str = "<s>"
    #: What texts may not hold unescaped, without its first character: of ``[`` and ``<``.
    controls: str = r"/?s>|/?INST\]|/?SYS\]|OUT\]|ROLE:[0-9A-F]*\]|/ROLE\]"

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([\[<])(\\*)(?={self.controls})", r"$1$2\\")

    def unescaped(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"([\[<])(\\*)\\(?={self.controls})", "$1$2")

    def _mark(self, role: Column, at: int) -> Column:
        other = F.concat(F.lit("[ROLE:"), F.hex(role.cast("binary")), F.lit("]")) if at == 0 else F.lit("[/ROLE]")
        for name, pair in self.marks.items():
            other = F.when(role == name, F.lit(pair[at])).otherwise(other)
        return other

    def pieces(self, turns: Column) -> Column:
        """Of an array of (role, text), what each turn is written as."""
        return F.transform(
            turns,
            lambda t: F.struct(
                F.concat(self._mark(t["role"], 0), F.lit(" ")).alias("open"),
                self.escaped(t["text"]).alias("text"),
                F.concat(F.lit(" "), self._mark(t["role"], 1)).alias("close"),
                (t["role"] == ASSISTANT).alias("learnt"),
            ),
        )

    def written(self, pieces: Column) -> Column:
        """The text and the mask of what ``pieces`` gave."""
        whole = F.concat(F.lit(self.begin), F.concat_ws("", F.transform(pieces, lambda p: F.concat(p["open"], p["text"], p["close"]))))
        start = F.struct(F.lit(len(self.begin)).alias("at"), F.array().cast("array<struct<begin: int, end: int>>").alias("spans"))

        def step(held: Column, p: Column) -> Column:
            begin = held["at"] + F.length(p["open"])
            end = begin + F.length(p["text"])
            span = F.array(F.struct(begin.alias("begin"), end.alias("end")))
            spans = F.when(p["learnt"], F.concat(held["spans"], span)).otherwise(held["spans"])
            return F.struct((end + F.length(p["close"])).alias("at"), spans.alias("spans"))

        return F.struct(whole.alias("formatted"), F.aggregate(pieces, start, step)["spans"].alias("mask"))

    def parsed(self, formatted: Column) -> Column:
        """The turns (role, text) of a text that ``written`` gave."""
        opens = "|".join(["INST", "SYS", "OUT", "ROLE:[0-9A-F]*"])
        found = rf"(?s)\[({opens})\] (.*?) (?:\[/INST\]|\[/SYS\]|</s>|\[/ROLE\])"
        roles = F.regexp_extract_all(formatted, F.lit(found), F.lit(1))
        texts = F.regexp_extract_all(formatted, F.lit(found), F.lit(2))

        def turn(mark: Column, text: Column) -> Column:
            role = F.unhex(F.substring(mark, 6, 2_000_000_000)).cast("string")
            for name, pair in self.marks.items():
                role = F.when(mark == pair[0].strip("[]"), F.lit(name)).otherwise(role)
            return F.struct(role.alias("role"), self.unescaped(text).alias("text"))

        return F.zip_with(roles, texts, turn)

    def learnt(self, formatted: Column, mask: Column) -> Column:
        """The text under the mask, as it was before escaping."""
        return F.concat_ws("", F.transform(mask, lambda s: self.unescaped(F.substring(formatted, s["begin"] + 1, s["end"] - s["begin"]))))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join by keys of which nulls are equal."""
    held = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [left[k].eqNullSafe(held[f"_{k}"]) for k in keys]
    out = left.join(held, on, how)
    return out if how in ("left_anti", "left_semi") else out.drop(*(f"_{k}" for k in keys))


def paths(messages: DataFrame, keep: int | None = 1) -> DataFrame:
    """(tree, leaf, score, place, id): the messages of the ``keep`` best paths of each tree, or of all, in order from the root.

    ``messages``: tree, id, parent (null for roots) and score, an id once in a tree.
    """
    tables = shared.Tables(messages.sparkSession)
    known = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("_there"))
    rows = messages.join(known, ["tree", "parent"], "left")
    up = F.when(F.col("_there"), F.col("parent")).alias("up")
    score = F.coalesce("score", F.lit(0.0)).alias("score")
    steps = [tables.write(rows.select("tree", "id", up, score, F.lit(1).cast("long").alias("steps")), "steps")]
    n = steps[0].count()
    while not (open_ := steps[-1].where("up IS NOT NULL")).isEmpty():
        if 1 << (len(steps) - 1) > n:
            raise ValueError("messages answer each other in a circle")
        far = steps[-1]  # what was open a round before, and what had reached its root by then
        for s in steps[:-1]:
            far = far.unionByName(s.where("up IS NULL"))
        far = far.select("tree", F.col("id").alias("up"), F.struct("up", "score", "steps").alias("far"))
        further = open_.join(far, ["tree", "up"])
        sums = ((F.col(c) + F.col(f"far.{c}")).alias(c) for c in ("score", "steps"))
        steps.append(tables.write(further.select("tree", "id", F.col("far.up").alias("up"), *sums), "steps"))
    ended = steps[0].where("up IS NULL")
    for s in steps[1:]:
        ended = ended.unionByName(s.where("up IS NULL"))
    answered = steps[0].where("up IS NOT NULL").select("tree", F.col("up").alias("id")).distinct()
    leaves = _same(ended, answered, ["tree", "id"], "left_anti").withColumn("score", F.col("score") / F.col("steps"))
    if keep is not None:
        best = Window.partitionBy("tree").orderBy(F.desc("score"), "id")
        leaves = leaves.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= keep)
    on = leaves.select("tree", F.col("id").alias("leaf"), "score", (F.col("steps") - 1).alias("place"), "id")
    for k in range(len(steps) - 2, -1, -1):  # of what is listed, the ancestors 2^k further up
        jump = steps[k].where("up IS NOT NULL").select("tree", "id", "up")
        here = F.struct("place", "id")
        there = F.struct((F.col("place") - (1 << k)).alias("place"), F.col("up").alias("id"))
        both = F.explode(F.when(F.col("up").isNotNull(), F.array(here, there)).otherwise(F.array(here))).alias("m")
        on = on.join(jump, ["tree", "id"], "left").select("tree", "leaf", "score", both).select("tree", "leaf", "score", "m.*")
    return on


def formatted(chosen: DataFrame, texts: DataFrame, keys: list[str], template: Template | None = None) -> DataFrame:
    """(tree, leaf, score, formatted, mask) of each path of ``chosen``; ``texts`` has the keys of its messages, role and text."""
    template = template or Template()
    said = texts.withColumns({c: F.coalesce(c, F.lit("")) for c in ("role", "text") if c not in keys})
    turns = F.array_sort(F.collect_list(F.struct("place", "role", "text")))
    rows = _same(said, chosen, keys).groupBy("tree", "leaf", "score").agg(turns.alias("turns"))
    rows = rows.withColumn("pieces", template.pieces(F.col("turns"))).withColumn("out", template.written(F.col("pieces")))
    return rows.select("tree", "leaf", "score", "out.formatted", "out.mask")


def conversations(messages: DataFrame, keep: int | None = 1, template: Template | None = None) -> DataFrame:
    """(tree, leaf, score, formatted, mask) of the best paths of reply trees: tree, id, parent, score, role, text."""
    whole = F.min(F.struct("parent", "score", "role", "text")).alias("m")
    once = shared.written(messages.groupBy("tree", "id").agg(whole).select("tree", "id", "m.*"), "messages")
    chosen = paths(once.select("tree", "id", "parent", "score"), keep)
    return formatted(chosen, once.select("tree", "id", "role", "text"), ["tree", "id"], template)


def turn_by_turn(rows: DataFrame, name: str, order: str, role: str, text: str, template: Template | None = None) -> DataFrame:
    """(name, formatted, mask) of conversations given turn by turn: reply trees in which each turn answers the one before.

    Turns of one number go by role and text. The text stays out of ranks and paths,
    and comes in by a digest; repeated rows are one message, said as often as it is there.
    """
    said = rows.select(
        shared.col(name).alias("name"),
        shared.col(order).alias("order"),
        F.coalesce(shared.col(role), F.lit("")).alias("role"),
        shared.key_of(F.coalesce(shared.col(text), F.lit("")).cast("binary")).alias("key"),
        F.coalesce(shared.col(text), F.lit("")).alias("text"),
    )
    keys = ["name", "order", "role", "key"]
    placed, _, _ = shared.ranked(said.select(*keys).distinct(), *keys)
    before = F.when(F.col("place") > 0, F.col("place") - 1).alias("parent")
    chosen = paths(placed.select("tree", F.col("place").alias("id"), before, F.lit(0.0).alias("score")))
    known = placed.select("tree", F.col("place").alias("id"), *keys)
    written = formatted(chosen.join(known, ["tree", "id"]), said, keys, template)
    names = placed.where("place = 0").select("tree", "name")
    return written.join(names, "tree").select("name", "formatted", "mask")
