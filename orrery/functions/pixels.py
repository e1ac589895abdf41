"""Sky pixels: a hierarchical triangular mesh, as expressions.

The sphere is eight triangles, with ids 8 to 15; each is cut into four at the
middles of its sides, and child k of pixel p has the id 4 p + k. So an id tells its
depth, the pixels within a pixel are a range of ids, and the pixel of a
coarser depth is a shift. Points go down the tree by three side tests a depth;
regions go down by their bounding circles, and keep the pixels whose own bounding
circles touch them (an envelope: all that overlap, and some that nearly do).

Expressions are put together as SQL text, in which a value that is needed often is bound
to a name; arguments are SQL, too: names of columns, mostly.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

from pyspark.sql import Column, functions as F

# The corners of the octahedron, and those of each of the first eight pixels.
CORNERS = ((0, 0, 1), (1, 0, 0), (0, 1, 0), (-1, 0, 0), (0, -1, 0), (0, 0, -1))
FIRST = ((1, 5, 2), (2, 5, 3), (3, 5, 4), (4, 5, 1), (1, 0, 4), (4, 0, 3), (3, 0, 2), (2, 0, 1))
MAX_DEPTH = 24
_NAMES = itertools.count()


def _let(value: str, f: Callable[[str], str]) -> str:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    name = f"v{next(_NAMES)}"
    return f"transform(array({value}), {name} -> {f(name)})[0]"


def _each(function: str, values: str, f: Callable[[str], str]) -> str:
    name = f"v{next(_NAMES)}"
    return f"{function}({values}, {name} -> {f(name)})"


def _xyz(x: str, y: str, z: str) -> str:
    return f"named_struct('x', {x}, 'y', {y}, 'z', {z})"


def _unit(lon: str, lat: str) -> str:
    a, b = f"radians({lon})", f"radians({lat})"
    return _xyz(f"cos({a}) * cos({b})", f"sin({a}) * cos({b})", f"sin({b})")


def _dot(a: str, b: str) -> str:
    return f"({a}.x * {b}.x + {a}.y * {b}.y + {a}.z * {b}.z)"


def _triple(a: str, b: str, c: str) -> str:
    """(a x b) . c"""
    return (
        f"(({a}.y * {b}.z - {a}.z * {b}.y) * {c}.x + ({a}.z * {b}.x - {a}.x * {b}.z) * {c}.y"
        f" + ({a}.x * {b}.y - {a}.y * {b}.x) * {c}.z)"
    )


def _scaled(total: str) -> str:
    """A vector made a unit vector."""
    return _let(total, lambda t: _let(f"sqrt({_dot(t, t)})", lambda n: _xyz(*(f"{t}.{c} / {n}" for c in "xyz"))))


def _middle(*points: str) -> str:
    return _scaled(_xyz(*(" + ".join(f"{p}.{c}" for p in points) for c in "xyz")))


def _pixel(id_: str, a: str, b: str, c: str) -> str:
    return f"named_struct('id', {id_}, 'a', {a}, 'b', {b}, 'c', {c})"


def _first(k: int) -> str:
    return _pixel(f"{8 + k}L", *(_xyz(*(f"{float(x)}D" for x in CORNERS[i])) for i in FIRST[k]))


def _with_middles(p: str, f: Callable[[str], str]) -> str:
    a, b, c = (f"{p}.{k}" for k in "abc")
    return _let(f"named_struct('a', {_middle(b, c)}, 'b', {_middle(a, c)}, 'c', {_middle(a, b)})", f)


def _child(p: str, m: str, k: int) -> str:
    ways = (("p.a", "m.c", "m.b"), ("p.b", "m.a", "m.c"), ("p.c", "m.b", "m.a"), ("m.a", "m.b", "m.c"))
    return _pixel(f"{p}.id * 4 + {k}", *(f"{p if w[0] == 'p' else m}{w[1:]}" for w in ways[k]))


def _checked(depth: int) -> int:
    if not 0 <= depth <= MAX_DEPTH:
        raise ValueError(f"pixels have depths of 0 to {MAX_DEPTH}, not {depth}")
    return depth


def of_point(lon: str, lat: str, depth: int) -> Column:
    """The id of the pixel that holds a point, in degrees; null if a coordinate is. A point on a border is in the first of its pixels."""
    _checked(depth)

    def down(v: str) -> str:
        within = lambda p: " AND ".join(f"{_triple(f'{p}.{i}', f'{p}.{j}', v)} >= 0" for i, j in ("ab", "bc", "ca"))
        roots = f"array({', '.join(map(_first, range(8)))})"
        found = f"coalesce({_each('filter', roots, within)}[0], {_first(7)})"

        def chosen(p: str, m: str) -> str:
            sides = ("c", "b"), ("a", "c"), ("b", "a")
            tests = " ".join(f"WHEN {_triple(f'{m}.{i}', f'{m}.{j}', v)} >= 0 THEN {_child(p, m, k)}" for k, (i, j) in enumerate(sides))
            return f"CASE {tests} ELSE {_child(p, m, 3)} END"

        if not depth:
            return f"{_let(found, lambda p: f'{p}.id')}"
        p = f"v{next(_NAMES)}"
        step = f"({p}, step) -> {_with_middles(p, lambda m: chosen(p, m))}"
        return f"aggregate(sequence(1, {depth}), {found}, {step}).id"

    return F.expr(f"CASE WHEN ({lon}) IS NOT NULL AND ({lat}) IS NOT NULL THEN {_let(_unit(lon, lat), down)} END")


def parent(pixel: Column, levels: int) -> Column:
    """The pixel that holds this one, so many depths above."""
    return F.shiftright(pixel, 2 * levels)


def depth_of(pixel: Column) -> Column:
    """The depth that an id is of."""
    return ((F.length(F.bin(pixel)) - 4) / 2).cast("int")


def _corners(pixel: str) -> str:
    def of(bits: str) -> str:
        # the first four binary digits are one of the eight, and each two more the way down
        roots = f"array({', '.join(map(_first, range(8)))})"
        root = f"{roots}[cast(conv(substring({bits}, 1, 4), 2, 10) AS int) - 8]"
        ways = f"transform(filter(sequence(5, {5 + 2 * MAX_DEPTH}, 2), i -> i < length({bits})), i -> substring({bits}, i, 2))"
        p = f"v{next(_NAMES)}"

        def chosen(m: str) -> str:
            tests = " ".join(f"WHEN '{k:02b}' THEN {_child(p, m, k)}" for k in range(3))
            return f"CASE way {tests} ELSE {_child(p, m, 3)} END"

        last = f"aggregate({ways}, {root}, ({p}, way) -> {_with_middles(p, chosen)})"
        lon = lambda v: f"pmod(degrees(atan2({v}.y, {v}.x)), 360D)"
        lat = lambda v: f"degrees(asin(greatest(-1D, least(1D, {v}.z))))"
        return _let(last, lambda q: "array(" + ", ".join(f"{g(f'{q}.{c}')}" for c in "abc" for g in (lon, lat)) + ")")

    return _let(f"bin({pixel})", of)


def corners(pixel: str) -> Column:
    """The pixel's three corners: a polygon's longitudes and latitudes in degrees, one after another."""
    return F.expr(_corners(pixel))


def region_of(pixel: str) -> Column:
    """The pixel as a region."""
    return F.expr(f"CASE WHEN ({pixel}) IS NOT NULL THEN named_struct('kind', 'polygon', 'values', {_corners(pixel)}) END")


def _bounding_circle(region: str) -> str:
    at = lambda k: f"get({region}.values, {k})"
    angle = lambda a, b: f"acos(greatest(-1D, least(1D, {_dot(a, b)})))"
    made = lambda v, r: f"named_struct('v', {v}, 'r', {r})"
    round_ = made(_unit(at(0), at(1)), f"radians(CASE WHEN {region}.kind = 'circle' THEN {at(2)} ELSE 0D END)")

    def of_box(width: str) -> str:
        def about(v: str) -> str:
            far = [_let(_unit(at(0), at(k)), lambda c: angle(v, c)) for k in (1, 3)]
            return made(v, f"CASE WHEN {width} >= 179 THEN 3.2D ELSE greatest({far[0]}, {far[1]}) END")

        return _let(_unit(f"({at(0)} + {width} / 2)", f"(({at(1)} + {at(3)}) / 2)"), about)

    box = _let(f"CASE WHEN {at(2)} - {at(0)} >= 360 THEN 360D ELSE pmod({at(2)} - {at(0)}, 360D) END", of_box)
    places = f"sequence(0, size({region}.values) - 2, 2)"
    points = _each("transform", places, lambda i: _unit(f"get({region}.values, {i})", f"get({region}.values, {i} + 1)"))

    def of_points(p: str) -> str:
        total = f"aggregate({p}, {_xyz('0D', '0D', '0D')}, (s, q) -> {_xyz(*(f's.{c} + q.{c}' for c in 'xyz'))})"
        return _let(_scaled(total), lambda v: made(v, f"array_max({_each('transform', p, lambda q: angle(v, q))})"))

    return f"CASE {region}.kind WHEN 'box' THEN {box} WHEN 'polygon' THEN {_let(points, of_points)} ELSE {round_} END"


def bounding_circle(region: str) -> Column:
    """(v, r): the middle and the radius, in radians, of a circle about a region; a box of half the sky or more has all of it."""
    return F.expr(_bounding_circle(region))


def envelope(region: str, depth: int) -> Column:
    """The ids of the pixels of a depth that a region may overlap: all that it does; null for a null region."""
    _checked(depth)

    def near(p: str, s: str) -> str:
        def touches(v: str) -> str:
            least = f"least({', '.join(_dot(v, f'{p}.{c}') for c in 'abc')})"
            reach = f"acos(greatest(-1D, least(1D, {least}))) + {s}.r + 1e-9D"
            return _let(reach, lambda r: f"{r} >= pi() OR {_dot(v, f'{s}.v')} >= cos({r})")

        return _let(_middle(*(f"{p}.{c}" for c in "abc")), touches)

    def down(s: str) -> str:
        held = _each("filter", f"array({', '.join(map(_first, range(8)))})", lambda p: near(p, s))
        for _ in range(depth):
            cut = lambda p: _with_middles(p, lambda m: f"array({', '.join(_child(p, m, k) for k in range(4))})")
            held = _each("filter", f"flatten({_each('transform', held, cut)})", lambda p: near(p, s))
        return _each("transform", held, lambda p: f"{p}.id")

    return F.expr(f"CASE WHEN {region}.kind IS NOT NULL THEN {_let(_bounding_circle(region), down)} END")


def ranges(ids: Iterable[int]) -> list[tuple[int, int]]:
    """Ids as few ranges, both ends included."""
    out: list[tuple[int, int]] = []
    for i in sorted(set(ids)):
        if out and out[-1][1] == i - 1:
            out[-1] = (out[-1][0], i)
        else:
            out.append((i, i))
    return out


def among(pixel: Column, listed: list[tuple[int, int]]) -> Column:
    """Whether an id is in one of the ranges: comparisons that a scan can prune by."""
    found = F.lit(False)
    for low, high in listed:
        found = found | ((pixel == low) if low == high else pixel.between(low, high))
    return found
