"""Attribute roles: which columns are kept and how they are typed.

Roles are ``I`` (ignored), ``N`` (numerical), ``C`` (categorical) and ``L`` (label, exactly one).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROLES = ("I", "N", "C", "L")


def expand_roles(description: str | list[str]) -> list[str]:
    """Roles from a description with optional repeat counts: ``"3 N I 2 C L"`` -> ``N N N I C C L``."""
    tokens = description.split() if isinstance(description, str) else list(description)
    roles, repeat = [], None
    for token in tokens:
        if token.lstrip("+-").isdigit():
            if repeat is not None:
                raise ValueError(f"{token} directly after {repeat}: no role between two numbers")
            repeat = int(token)
            if repeat <= 0:
                raise ValueError(f"repeat count {repeat} must be positive")
        elif token.upper() in ROLES:
            roles += [token.upper()] * (repeat or 1)
            repeat = None
        else:
            raise ValueError(f"unknown role {token!r}, expected one of {ROLES}")
    if repeat is not None:
        raise ValueError(f"repeat count {repeat} at the end repeats nothing")
    return roles


@dataclass(frozen=True)
class Attributes:
    """Named attributes with their roles; ``regression`` makes the label numerical."""

    names: tuple[str, ...]
    roles: tuple[str, ...]
    regression: bool = False

    def __post_init__(self):
        if len(self.names) != len(self.roles):
            raise ValueError(f"{len(self.names)} names for {len(self.roles)} roles")
        if len(set(self.names)) != len(self.names):
            raise ValueError("attribute names are not unique")
        if unknown := [r for r in self.roles if r not in ROLES]:
            raise ValueError(f"unknown roles {unknown}, expected {ROLES}")
        if self.roles.count("L") != 1:
            raise ValueError(f"exactly one label is required, found {self.roles.count('L')}")

    @classmethod
    def of(cls, roles: str | list[str], names: list[str] | None = None, regression: bool = False) -> Attributes:
        expanded = expand_roles(roles)
        names = [f"a{i}" for i in range(len(expanded))] if names is None else names
        return cls(tuple(names), tuple(expanded), regression)

    @property
    def kept(self) -> list[tuple[int, str, str]]:
        """(position, name, role) of every attribute that is not ignored."""
        return [(i, n, r) for i, (n, r) in enumerate(zip(self.names, self.roles)) if r != "I"]

    @property
    def label(self) -> str:
        return self.names[self.roles.index("L")]

    @property
    def inputs(self) -> list[str]:
        return [n for _, n, r in self.kept if r != "L"]

    def is_numeric(self, role: str) -> bool:
        return role == "N" or (role == "L" and self.regression)

    @property
    def numeric(self) -> list[str]:
        return [n for _, n, r in self.kept if self.is_numeric(r)]

    @property
    def categorical(self) -> list[str]:
        return [n for _, n, r in self.kept if not self.is_numeric(r)]


def apply_roles(df: DataFrame, attributes: Attributes, *passed: str) -> DataFrame:
    """Keep and type the declared columns of a table: numerical as double, categorical and label as string."""
    kept = [F.col(n).cast("double" if attributes.is_numeric(r) else "string").alias(n) for _, n, r in attributes.kept]
    return df.select(*passed, *kept)


def drop_ignored(df: DataFrame, attributes: Attributes) -> DataFrame:
    return df.drop(*[n for n, r in zip(attributes.names, attributes.roles) if r == "I"])


def drop_missing(df: DataFrame, attributes: Attributes) -> DataFrame:
    """Drop rows with a NULL in any kept attribute; ignored attributes do not count."""
    return df.na.drop(subset=[n for _, n, _ in attributes.kept])


def assemble(df: DataFrame, inputs: list[str], name: str = "features") -> DataFrame:
    """Dense double vector from the input columns."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in inputs]))


def feature_values(df: DataFrame, id_col: str, inputs: list[str]) -> DataFrame:
    """Long form ``(id, feature, value)`` with positional feature names ``"1"`` to ``"n"``."""
    named = df.select(id_col, *[F.col(c).cast("double").alias(str(i)) for i, c in enumerate(inputs, 1)])
    return named.unpivot(id_col, [str(i) for i in range(1, len(inputs) + 1)], "feature", "value")


def extract_labels(df: DataFrame, attributes: Attributes) -> DataFrame:
    return df.select(attributes.label)

