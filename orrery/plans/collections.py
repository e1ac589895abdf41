"""Collections: runs, tags, chains and calibrations. Small metadata, kept and resolved on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from enum import IntEnum

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.functions.glob import is_glob, matches
from orrery.operators.catalog import ConflictError


class Kind(IntEnum):
    RUN = 1
    TAGGED = 2
    CHAINED = 3
    CALIBRATION = 4


@dataclass
class Collections:
    """Names in the order of registration, their kinds, and the children of chains."""

    kinds: dict[str, Kind] = field(default_factory=dict)
    chains: dict[str, list[str]] = field(default_factory=dict)
    docs: dict[str, str] = field(default_factory=dict)

    def register(self, name: str, kind: Kind = Kind.TAGGED, doc: str | None = None) -> bool:
        """Whether it is new; ConflictError if it is there as another kind."""
        if name in self.kinds:
            if self.kinds[name] != kind:
                raise ConflictError(f"{name} is a {self.kinds[name].name} collection")
            return False
        self.kinds[name] = kind
        if kind == Kind.CHAINED:
            self.chains[name] = []
        if doc:
            self.docs[name] = doc
        return True

    def remove(self, name: str, unlink: bool = False) -> None:
        parents = self.parents(name)
        if parents and not unlink:
            raise ConflictError(f"{name} is in the chains {', '.join(parents)}")
        for p in parents:
            self.chains[p].remove(name)
        del self.kinds[name]
        self.chains.pop(name, None)

    def parents(self, name: str) -> list[str]:
        return [p for p, children in self.chains.items() if name in children]

    def _checked(self, parent: str, children: Iterable[str]) -> list[str]:
        if self.kinds.get(parent) != Kind.CHAINED:
            raise ValueError(f"{parent} is not a chain")
        children = list(dict.fromkeys(children))
        for c in children:
            if c not in self.kinds:
                raise LookupError(f"no collection is named {c!r}")
            if parent in self._below(c):
                raise ConflictError(f"{c} in {parent} would make a cycle")
        return children

    def _below(self, name: str) -> list[str]:
        """The collection and all in it, depth first, each once."""
        out: dict[str, None] = {}

        def visit(n: str) -> None:
            if n not in out:
                out[n] = None
                for c in self.chains.get(n, ()):
                    visit(c)

        visit(name)
        return list(out)

    def redefine(self, parent: str, children: Iterable[str]) -> None:
        self.chains[parent] = self._checked(parent, children)

    def prepend(self, parent: str, children: Iterable[str]) -> None:
        new = self._checked(parent, children)
        self.chains[parent] = [*new, *(c for c in self.chains[parent] if c not in new)]

    def extend(self, parent: str, children: Iterable[str]) -> None:
        new = self._checked(parent, children)
        self.chains[parent] = [*(c for c in self.chains[parent] if c not in new), *new]

    def unlink(self, parent: str, children: Iterable[str]) -> None:
        gone = set(children)
        self.chains[parent] = [c for c in self.chains[parent] if c not in gone]

    def query(
        self,
        expression: str | Sequence[str] | None = None,
        kinds: Iterable[Kind] | None = None,
        flatten: bool = False,
        include_chains: bool | None = None,
        ordered: bool = False,
    ) -> list[str]:
        """Names that match: those of patterns first, as registered, then explicit ones with what is in them.

        ``ordered``: the order matters, so that patterns are an error. A chain itself is given unless chains are flattened, or as ``include_chains`` says.
        """
        wanted = set(kinds if kinds is not None else Kind)
        include = (not flatten) if include_chains is None else include_chains
        items = ["*"] if expression in (None, ...) else [expression] if isinstance(expression, str) else list(expression)
        patterns, names = [x for x in items if is_glob(x)], [x for x in items if not is_glob(x)]
        out: dict[str, None] = {}

        def add(n: str) -> None:
            chain = self.kinds[n] == Kind.CHAINED
            if self.kinds[n] in wanted and (not chain or include):
                out[n] = None

        if ordered and patterns:
            raise ValueError(f"an order is needed, and {patterns[0]!r} has none")
        found = [n for n in self.kinds if any(matches(p, n) for p in patterns)]
        for n in found:
            add(n)
        if flatten:  # all that match come before what is in the chains among them
            for n in found:
                for m in self._below(n):
                    add(m)
        for n in names:
            if n not in self.kinds:
                raise LookupError(f"no collection is named {n!r}")
            for m in self._below(n) if flatten else [n]:
                add(m)
        return list(out)

    def flatten(self, names: Sequence[str]) -> list[str]:
        """Collections that hold datasets, in search order."""
        for n in names:
            if is_glob(n):
                raise ValueError("a search in order takes names, not patterns")
        return self.query(names, flatten=True)

    def info(self, summaries: dict[str, dict] | None = None) -> list[dict]:
        return [
            {
                "name": n,
                "kind": k.name,
                "children": tuple(self.chains.get(n, ())),
                "parents": tuple(self.parents(n)),
                "doc": self.docs.get(n, ""),
                **({"summary": summaries.get(n, {})} if summaries is not None else {}),
            }
            for n, k in self.kinds.items()
        ]

    def chain_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(p, c, i) for p, children in self.chains.items() for i, c in enumerate(children)]
        return spark.createDataFrame(rows, "parent string, child string, position int")


def flattened(spark: SparkSession, chain: DataFrame, root: str) -> DataFrame:
    """(child, rank) of all that is below a chain in depth-first order, from its table (parent, child, position).

    A child in several places has its first one. A chain that is below itself is an error. Each depth is a join that
    runs and is kept, with one path of each child, its least there: a least path goes through least paths.
    """
    links = chain.select("parent", F.col("child").alias("_child"), "position")
    below = F.when(
        F.array_contains("above", F.col("_child")), F.raise_error(F.concat("_child", F.lit(" is in a chain below itself")))
    ).otherwise(F.concat("above", F.array("_child")))
    walk = chain.where(F.col("parent") == F.lit(root)).select("child", F.array("position").alias("path"), F.array("parent", "child").alias("above"))
    depths: list[DataFrame] = []
    while True:
        walk = walk.groupBy("child").agg(F.min(F.struct("path", "above")).alias("_w")).select("child", "_w.*").persist()
        if walk.isEmpty():
            break
        depths.append(walk)
        joined = walk.join(links, F.col("child") == F.col("parent"))
        walk = joined.select(F.col("_child").alias("child"), F.concat("path", F.array("position")).alias("path"), below.alias("above"))
    found = depths[0] if depths else walk
    for d in depths[1:]:
        found = found.unionByName(d)
    first = found.groupBy("child").agg(F.min("path").alias("path"))
    return ordered(first, "path").select("child", F.col("rank").cast("int").alias("rank"))


def ordered(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``rank``, the place of each row in a global order, from 0: a sort by ranges, and a count of each range.

    The rows are kept, as the ranges of another run may differ; runs the sort.
    """
    held = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()).persist()
    sizes = held.groupBy(F.shiftright("_id", 33).alias("_range")).count().collect()  # a row for each range
    before, at = [], 0
    for r in sorted(sizes, key=lambda r: r["_range"]):
        before.append((r["_range"], at))
        at += r["count"]
    bases = F.broadcast(df.sparkSession.createDataFrame(before, "_range long, _before long"))
    placed = held.withColumn("_range", F.shiftright("_id", 33)).join(bases, "_range")
    rank = F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("rank", rank).drop("_id", "_range", "_before")
