"""The dimension universe: typed keys with required and implied relations. Driver-side metadata only."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import cached_property

KINDS = ("int", "string", "float", "bool", "hash", "uuid", "region", "timespan", "datetime", "ingest_date")


@dataclass(frozen=True)
class Element:
    """A table-like entity. ``key`` is its own key column (none: a combination of other dimensions).

    ``spatial`` and ``temporal`` name the topology family, if it has a region or a timespan.
    ``pixels`` makes it the sky pixels of a depth: it has no table, as ids tell regions.
    """

    name: str
    key: str | None = None
    key_type: str = "int"
    required: tuple[str, ...] = ()
    implied: tuple[str, ...] = ()
    metadata: Mapping[str, str] = field(default_factory=dict)
    governor: bool = False
    spatial: str | None = None
    temporal: str | None = None
    union_of: str | None = None
    always_join: bool = False
    defines_relationships: bool = False
    pixels: int | None = None

    @property
    def is_dimension(self) -> bool:
        return self.key is not None


@dataclass(frozen=True)
class Group:
    """A closed set of dimensions, in the universe's order."""

    universe: Universe
    names: tuple[str, ...]

    @cached_property
    def required(self) -> tuple[str, ...]:
        """Dimensions that nothing else in the group implies."""
        implied = {i for n in self.names for i in self.universe[n].implied}
        pulled = {i for i in implied if not any(i in self.universe[n].required for n in self.names if n not in implied)}
        return tuple(n for n in self.names if n not in pulled)

    @cached_property
    def implied(self) -> tuple[str, ...]:
        return tuple(n for n in self.names if n not in self.required)

    @property
    def governors(self) -> tuple[str, ...]:
        return tuple(n for n in self.names if self.universe[n].governor)

    @cached_property
    def elements(self) -> tuple[str, ...]:
        """Elements, combinations too, whose dimensions are all in the group."""
        have = set(self.names)
        return tuple(
            e.name for e in self.universe.elements if (e.name in have if e.is_dimension else have.issuperset(e.required))
        )

    def _families(self, kind: str) -> dict[str, str]:
        """The preferred member of each family, the most fine-grained one here."""
        out: dict[str, str] = {}
        for family, members in self.universe.families[kind].items():
            found = next((m for m in members if m in self.elements), None)
            if found:
                out[family] = found
        return out

    @property
    def spatial(self) -> dict[str, str]:
        return self._families("spatial")

    @property
    def temporal(self) -> dict[str, str]:
        return self._families("temporal")

    def union(self, *others: Group) -> Group:
        return self.universe.conform([n for g in (self, *others) for n in g.names])

    def intersection(self, *others: Group) -> Group:
        return self.universe.conform([n for n in self.names if all(n in g.names for g in others)])

    def difference(self, other: Group) -> Group:
        return self.universe.conform([n for n in self.names if n not in other.names])

    def issubset(self, other: Group) -> bool:
        return set(self.names) <= set(other.names)

    def isdisjoint(self, other: Group) -> bool:
        return not set(self.names) & set(other.names)


class Universe:
    """All elements. ``families`` lists members of each topology family in order of preference."""

    def __init__(self, elements: Iterable[Element], families: Mapping[str, Mapping[str, tuple[str, ...]]] | None = None) -> None:
        given = {e.name: e for e in elements}
        self._elements: dict[str, Element] = {}

        def visit(name: str, above: tuple[str, ...]) -> None:
            if name in above:
                raise ValueError(f"dimension {name!r} depends on itself")
            if name not in given:
                raise ValueError(f"unknown dimension {name!r}, needed by {above[-1]!r}")
            if name not in self._elements:
                for dep in (*given[name].required, *given[name].implied):
                    visit(dep, (*above, name))
                self._elements[name] = given[name]

        for name in given:
            visit(name, ())
        self.families = {kind: dict((families or {}).get(kind, {})) for kind in ("spatial", "temporal")}

    def __getitem__(self, name: str) -> Element:
        try:
            return self._elements[name]
        except KeyError:
            raise ValueError(f"no dimension element is named {name!r}") from None

    def __contains__(self, name: str) -> bool:
        return name in self._elements

    @property
    def elements(self) -> tuple[Element, ...]:
        return tuple(self._elements.values())

    @property
    def temporal_elements(self) -> tuple[str, ...]:
        return tuple(e.name for e in self.elements if e.temporal)

    def sorted(self, names: Iterable[str], reverse: bool = False) -> list[str]:
        """Topological order: what a dimension depends on stands before it."""
        wanted = set(names)
        for n in wanted:
            self[n]
        out = [n for n in self._elements if n in wanted]
        return out[::-1] if reverse else out

    def conform(self, dimensions: Iterable[str]) -> Group:
        """The closure: with all that the dimensions require or imply."""
        todo, closed = list(dimensions), set()
        while todo:
            e = self[todo.pop()]
            if e.is_dimension:
                if e.name in closed:
                    continue
                closed.add(e.name)
            todo += [*e.required, *e.implied]
        return Group(self, tuple(self.sorted(closed)))

    @classmethod
    def sky_pixels(cls, depth: int) -> Element:
        """The dimension of sky pixels of a depth, a topology family of its own."""
        return Element(f"htm{depth}", f"htm{depth}", spatial=f"htm{depth}", pixels=depth)

    def column_type(self, element: str, name: str) -> str:
        e = self[element]
        if name in (element, e.key):
            return e.key_type
        if name in e.metadata:
            return e.metadata[name]
        if name == "region" and e.spatial:
            return "region"
        if name == "timespan" and e.temporal:
            return "timespan"
        if name in e.required or name in e.implied:
            return self[name].key_type
        raise ValueError(f"{element!r} has no column {name!r}")
