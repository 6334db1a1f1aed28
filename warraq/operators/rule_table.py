"""Ordered rules from a table, compiled once to one pattern over their strings.

A rule is a pattern with what it stands for.  Every alternative of a plain pattern contains a string
that can be read off it; the strings of all rules become one prefix tree, written as one regular
expression, so a text is gone through once, whatever the number of rules.  It tells at each place
which string begins there; only rules whose strings are in the text are verified by their own
pattern, in order, and the first that holds decides.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a rule table at most: it becomes part of the plan.
MOST_RULES = 10_000


def rules_of(table: DataFrame, order: Column | None = None, most: int = MOST_RULES) -> list[tuple]:
    """The rows of a rule table, in ``order``, as tuples."""
    rows = (table if order is None else table.orderBy(order)).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a rule table has {most} rows at most")
    return [tuple(r) for r in rows]


def literals(pattern: str) -> list[str]:
    """Strings of which one at least is in whatever the pattern is found in; '' is among them if none can be told.

    Each alternative gives the longest run of its letters, or the strings of one of its groups.  A
    letter, group or class that may be missing gives none, nor do classes, counts and anchors."""
    at = 0

    def counted() -> str:
        """The count after an item, which is passed over."""
        nonlocal at
        if pattern[at : at + 1] in ("?", "*", "+") and at < len(pattern):
            at += 1
            return pattern[at - 1]
        if pattern[at : at + 1] == "{":
            at = pattern.index("}", at) + 1
            return "{"
        return ""

    def one() -> set[str]:
        nonlocal at
        known, run = [], ""
        while at < len(pattern) and pattern[at] not in "|)":
            c = pattern[at]
            at += 1
            if c == "(":
                looks = pattern[at : at + 1] == "?" and pattern[at : at + 2] != "?:"
                at += 2 if pattern[at : at + 1] == "?" else 0
                group = every()
                at += 1
                if counted() in ("", "+") and not looks:
                    known.append(group)
            elif c in "[\\.^$":
                at = pattern.index("]", at + 1) + 1 if c == "[" else at + (c == "\\")
                counted()
            else:
                how = counted()
                run += c if how in ("", "+") else ""
                if not how:
                    continue
            known.append({run.strip()})
            run = ""
        return max([*known, {run.strip()}], key=lambda x: (min(map(len, x)), -len(x)))

    def every() -> set[str]:
        nonlocal at
        found = one()
        while pattern[at : at + 1] == "|":
            at += 1
            found |= one()
        return found

    return sorted(every())


def prefix_tree(strings: Sequence[str]) -> str:
    """One regular expression for the strings, of which none begins with another: shared beginnings are tried once."""
    if len(strings) == 1:
        return "".join(c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}" for c in strings[0])
    by: dict[str, list[str]] = {}
    for s in strings:
        by.setdefault(s[:1], []).append(s[1:])
    one = lambda c: c if c.isalnum() or c == " " else f"\\x{{{ord(c):x}}}"
    parts = [one(c) + prefix_tree(rest) for c, rest in sorted(by.items())]
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def shortest(strings: set[str]) -> dict[str, str]:
    """Each string with the shortest of all that it begins with."""
    return {s: next(s[:k] for k in range(1, len(s) + 1) if s[:k] in strings) for s in strings}


def first_that_holds(text: Column, patterns: Sequence[str], value: Callable[[int], Column], allowed: Callable[[int], Column | None] = lambda i: None) -> Column:
    """``value(i)`` of the first of ``patterns`` that is found in ``text``, among those whose ``allowed(i)`` (None:
    always) holds; null if none is, or for a null text."""
    if not patterns:
        return F.when(F.lit(False), F.lit(None))
    strings = [literals(p) for p in patterns]
    guarded = [all(s) for s in strings]
    begins = shortest({x for s, g in zip(strings, guarded) if g for x in s})
    known = sorted(set(begins.values()))
    tree = f"(?=({prefix_tree(known)}))" if known else None

    def chain(hits):
        out = None
        for i, p in enumerate(patterns):
            holds = text.rlike(p)
            if guarded[i]:
                holds = F.arrays_overlap(hits, F.array(*(F.lit(known.index(x)) for x in sorted({begins[x] for x in strings[i]})))) & holds
            extra = allowed(i)
            holds = holds if extra is None else extra & holds
            out = F.when(holds, value(i)) if out is None else out.when(holds, value(i))
        return out

    if tree is None:
        return chain(None)
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(tree), F.lit(1)))
    numbered = F.transform(found, lambda s: (F.array_position(F.array(*map(F.lit, known)), s) - 1).cast("int"))
    # an array of one, so that the places are looked for once a text and not once a rule
    decided = F.get(F.transform(F.array(numbered), chain), 0)
    return F.when(text.rlike(tree), decided) if all(guarded) else decided
