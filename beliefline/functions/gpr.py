"""Gene rules: boolean expressions over genes with and, or and parentheses, as disjunctions of gene sets."""

from __future__ import annotations

import re

_TOKEN = re.compile(r"[()]|[^()\s]+")


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text)


def parse(text: str) -> list[frozenset[str]]:
    """The rule as alternatives, each a set of genes that are all needed; minimal, in order of size and name."""
    rest = tokens(text)[::-1]

    def either() -> set[frozenset[str]]:
        out = both()
        while rest and rest[-1].lower() == "or":
            rest.pop()
            out = out | both()
        return out

    def both() -> set[frozenset[str]]:
        out = one()
        while rest and rest[-1].lower() == "and":
            rest.pop()
            other = one()
            out = {a | b for a in out for b in other}
        return out

    def one() -> set[frozenset[str]]:
        if not rest:
            raise ValueError(f"rule ends early: {text!r}")
        t = rest.pop()
        if t == "(":
            out = either()
            if not rest or rest.pop() != ")":
                raise ValueError(f"unbalanced rule: {text!r}")
            return out
        if t == ")" or t.lower() in ("and", "or"):
            raise ValueError(f"unexpected {t!r} in rule {text!r}")
        return {frozenset([t])}

    found = either()
    if rest:
        raise ValueError(f"unexpected {rest[-1]!r} in rule {text!r}")
    return sorted((a for a in found if not any(b < a for b in found)), key=lambda s: (len(s), sorted(s)))


def genes(rule: str) -> set[str]:
    return {t for t in tokens(rule) if t not in "()" and t.lower() not in ("and", "or")}


def is_active(rule: str, inactive: set[str]) -> bool:
    return any(not (a & inactive) for a in parse(rule))


def requires(rule: str, gene: str) -> bool:
    """Whether no alternative does without the gene."""
    return all(gene in a for a in parse(rule))


def to_text(rule: str) -> str:
    return " or ".join("(" + " and ".join(sorted(a)) + ")" if len(a) > 1 else next(iter(a)) for a in parse(rule))
