"""Typed predicates under SQL's three-valued logic: columns, leaf pruning, and a plain evaluator."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from vecgrove.config import MAX_IN_VALUES, MAX_PREDICATE_DEPTH, MAX_PREDICATE_NODES, MAX_STRING_BYTES, Field, IndexConfig
from vecgrove.errors import require

OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge")


class Predicate:
    def __and__(self, other: Predicate) -> Predicate:
        return And((self, other))

    def __or__(self, other: Predicate) -> Predicate:
        return Or((self, other))

    def __invert__(self) -> Predicate:
        return Not(self)


@dataclass(frozen=True)
class Compare(Predicate):
    field: str
    op: str
    value: Any


@dataclass(frozen=True)
class In(Predicate):
    field: str
    values: tuple


@dataclass(frozen=True)
class IsNull(Predicate):
    field: str


@dataclass(frozen=True)
class IsNotNull(Predicate):
    field: str


@dataclass(frozen=True)
class And(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Or(Predicate):
    parts: tuple[Predicate, ...] = ()


@dataclass(frozen=True)
class Not(Predicate):
    part: Predicate


def children(p: Predicate) -> tuple[Predicate, ...]:
    return p.parts if isinstance(p, And | Or) else (p.part,) if isinstance(p, Not) else ()


def check_value(f: Field, value: Any) -> Any:
    """The value in its stored form; wrong types, NULL and non-finite numbers are refused."""
    kind = {"i64": int, "f64": float, "bool": bool, "string": str}[f.type]
    require(type(value) is kind, "literal type")
    if kind is int:
        require(-(2**63) <= value < 2**63, "integer range")
    if kind is float:
        require(math.isfinite(value), "finite number")
        value += 0.0
    if kind is str:
        require(len(value.encode()) <= MAX_STRING_BYTES, "string length")
    return value


def validate(p: Predicate, config: IndexConfig) -> Predicate:
    """Checks types and limits; returns the predicate with literals in stored form and IN lists in order."""
    count = 0

    def walk(q: Predicate, depth: int) -> Predicate:
        nonlocal count
        count += 1
        require(count <= MAX_PREDICATE_NODES and depth <= MAX_PREDICATE_DEPTH, "predicate size", "LimitExceeded")
        if isinstance(q, Compare):
            f = config.field(q.field)
            require(q.op in OPERATORS, "operator")
            return Compare(f.name, q.op, check_value(f, q.value))
        if isinstance(q, In):
            f = config.field(q.field)
            require(len(q.values) <= MAX_IN_VALUES, "IN list", "LimitExceeded")
            values = {check_value(f, v) for v in q.values}
            return In(f.name, tuple(sorted(values, key=lambda v: v.encode() if isinstance(v, str) else v)))
        if isinstance(q, IsNull | IsNotNull):
            return type(q)(config.field(q.field).name)
        if isinstance(q, Not):
            return Not(walk(q.part, depth + 1))
        require(isinstance(q, And | Or), "predicate")
        return type(q)(tuple(walk(c, depth + 1) for c in q.parts))

    return walk(p, 1)


def literal(f: Field, value: Any) -> Column:
    return F.lit(value).cast(f.sql_type)


def to_column(p: Predicate, config: IndexConfig, name=lambda f: F.col(f"`{f}`")) -> Column:
    """A boolean column: true, false or null."""
    if isinstance(p, Compare):
        c, v = name(p.field), literal(config.field(p.field), p.value)
        return {"eq": c == v, "ne": c != v, "lt": c < v, "le": c <= v, "gt": c > v, "ge": c >= v}[p.op]
    if isinstance(p, In):
        f = config.field(p.field)
        return name(p.field).isin([literal(f, v) for v in p.values]) if p.values else F.lit(False)
    if isinstance(p, IsNull):
        return name(p.field).isNull()
    if isinstance(p, IsNotNull):
        return name(p.field).isNotNull()
    if isinstance(p, Not):
        return ~to_column(p.part, config, name)
    parts = [to_column(c, config, name) for c in children(p)]
    return reduce(lambda a, b: a & b, parts, F.lit(True)) if isinstance(p, And) else reduce(lambda a, b: a | b, parts, F.lit(False))


def evaluate(p: Predicate, row: dict) -> bool | None:
    """The same by plain Python, for tests and single rows."""
    if isinstance(p, Compare):
        a, b = row[p.field], p.value
        if a is None:
            return None
        if isinstance(a, str):
            a, b = a.encode(), b.encode()
        return {"eq": a == b, "ne": a != b, "lt": a < b, "le": a <= b, "gt": a > b, "ge": a >= b}[p.op]
    if isinstance(p, In):
        if not p.values:
            return False
        return None if row[p.field] is None else row[p.field] in p.values
    if isinstance(p, IsNull):
        return row[p.field] is None
    if isinstance(p, IsNotNull):
        return row[p.field] is not None
    if isinstance(p, Not):
        inner = evaluate(p.part, row)
        return None if inner is None else not inner
    values = [evaluate(c, row) for c in children(p)]
    decisive = isinstance(p, Or)
    return decisive if decisive in values else None if None in values else not decisive


def fields_of(p: Predicate) -> set[str]:
    own = {p.field} if isinstance(p, Compare | In | IsNull | IsNotNull) else set()
    return own.union(*(fields_of(c) for c in children(p)))


# Leaf pruning: which truth values can any row of a leaf have, given its synopsis?  A synopsis has, per field,
# <field>_has_null, <field>_min and <field>_max (null when the leaf has no value), and <field>_bloom or nothing.

Truths = tuple[Column, Column, Column]
"""Can be true, can be false, can be unknown."""


def bloom_bit(value: Column, bits: int, k: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(k), value), F.lit(bits)).cast("int")


BLOOM_HASHES = 3


def _may_hold(f: Field, value: Column) -> Column:
    if not f.bloom_bits:
        return F.lit(True)
    bloom = F.col(f"`{f.name}_bloom`")
    held = reduce(lambda a, b: a & b, [F.array_contains(bloom, bloom_bit(value, f.bloom_bits, k)) for k in range(BLOOM_HASHES)])
    return bloom.isNull() | held


def truths(p: Predicate, config: IndexConfig) -> Truths:
    """What the predicate can be within a leaf, as columns over its synopsis."""
    no = F.lit(False)
    if isinstance(p, And | Or):
        decisive = isinstance(p, Or)
        true, false, unknown = F.lit(not decisive), F.lit(decisive), no
        for part in p.parts:
            t, f, u = truths(part, config)
            if decisive:
                true, false, unknown = true | t, false & f, (unknown & (f | u)) | (u & (false | unknown))
                # A result is true if any part can be; false only if all can be; unknown if one can and no part must be true.
            else:
                true, false, unknown = true & t, false | f, (unknown & (t | u)) | (u & (true | unknown))
        return true, false, unknown
    if isinstance(p, Not):
        t, f, u = truths(p.part, config)
        return f, t, u
    field = config.field(p.field)
    has_null = F.coalesce(F.col(f"`{p.field}_has_null`"), F.lit(False))
    low, high = F.col(f"`{p.field}_min`"), F.col(f"`{p.field}_max`")
    some = low.isNotNull()
    if isinstance(p, IsNull):
        return has_null, some, no
    if isinstance(p, IsNotNull):
        return some, has_null, no
    if isinstance(p, In):
        if not p.values:
            return no, F.lit(True), no
        listed = [literal(field, v) for v in p.values]
        any_in = reduce(lambda a, b: a | b, [(low <= v) & (v <= high) & _may_hold(field, v) for v in listed])
        only = reduce(lambda a, b: a | b, [(low == v) & (high == v) for v in listed])
        return some & F.coalesce(any_in, no), some & F.coalesce(~only, no), has_null
    v = literal(field, p.value)
    inside = (low <= v) & (v <= high) & _may_hold(field, v)
    single = (low == v) & (high == v)
    can = {
        "eq": (inside, ~single),
        "ne": (~single, inside),
        "lt": (low < v, high >= v),
        "le": (low <= v, high > v),
        "gt": (high > v, low <= v),
        "ge": (high >= v, low < v),
    }[p.op]
    return some & F.coalesce(can[0], no), some & F.coalesce(can[1], no), has_null


def classify(p: Predicate, config: IndexConfig, count: Column) -> Column:
    """NoMatch, MayMatch or AllMatch of a leaf."""
    t, f, u = truths(p, config)
    return F.when((count == 0) | ~t, "NoMatch").when(~f & ~u, "AllMatch").otherwise("MayMatch")
