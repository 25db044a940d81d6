"""The expression language: text -> typed tree -> Catalyst Column.

``ts_mean(div(close, open), 5)``: an operator's arguments are expressions, and a windowed operator's last one is a whole
number. Names are columns of the panel; outcome columns are refused, and on event tables windowed operators too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..common import finite
from .ops import REGISTRY

#: Columns that tell the outcome; fixed prefixes.
OUTCOMES = ("label", "target", "y_", "fwd_", "future_")
_TOKEN = re.compile(r"\s*(?:(?P<name>[A-Za-z_]\w*)|(?P<number>-?\d+(?:\.\d+)?)|(?P<sign>[(),]))")


class ExpressionError(ValueError):
    pass


@dataclass(frozen=True)
class Node:
    """A column (no arguments) or an operator with its arguments and, if windowed, the window."""

    name: str
    args: tuple[Node, ...] = ()
    window: int | None = None

    def __str__(self) -> str:
        if not self.args:
            return self.name
        parts = [str(a) for a in self.args] + ([str(self.window)] if self.window is not None else [])
        return f"{self.name}({', '.join(parts)})"

    def walk(self) -> Iterator[Node]:
        yield self
        for a in self.args:
            yield from a.walk()

    @property
    def size(self) -> int:
        return sum(1 for _ in self.walk())

    @property
    def depth(self) -> int:
        return 1 + max((a.depth for a in self.args), default=0)


def is_outcome(name: str) -> bool:
    return name.lower().startswith(OUTCOMES)


def parse(text: str) -> Node:
    tokens: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = _TOKEN.match(text, at)
        if not m:
            raise ExpressionError(f"can't read {text[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    k = 0

    def take(kind: str, value: str | None = None) -> str:
        nonlocal k
        if tokens[k][0] != kind or value is not None and tokens[k][1] != value:
            raise ExpressionError(f"expected {value or kind}, found {tokens[k][1] or 'the end'} in {text!r}")
        k += 1
        return tokens[k - 1][1]

    def expression() -> Node:
        name = take("name")
        if tokens[k] != ("sign", "("):
            return Node(name)
        if name not in REGISTRY:
            raise ExpressionError(f"no operator {name}")
        op = REGISTRY[name]
        take("sign", "(")
        args, window = [expression()], None
        for _ in range(op.columns - 1):
            take("sign", ",")
            args.append(expression())
        if op.windowed:
            take("sign", ",")
            number = take("number")
            if not number.isdigit() or int(number) < 1:
                raise ExpressionError(f"{name} needs a window of at least 1, not {number}")
            window = int(number)
        take("sign", ")")
        return Node(name, tuple(args), window)

    node = expression()
    take("end")
    return node


def check(node: Node, columns: Iterable[str], kind: str = "panel") -> Node:
    """Refuses unknown columns, outcomes and, for kind 'event', operators along time."""
    known = set(columns)
    for n in node.walk():
        if not n.args:
            if is_outcome(n.name):
                raise ExpressionError(f"{n.name} tells the outcome")
            if n.name not in known:
                raise ExpressionError(f"no column {n.name}")
        elif kind == "event" and not REGISTRY[n.name].event:
            raise ExpressionError(f"{n.name} looks along time, which an event table has no rows for")
    return node


def compile_node(node: Node) -> Column:
    if not node.args:
        return F.col(node.name)
    args = [compile_node(a) for a in node.args]
    return REGISTRY[node.name].build(*args, *([node.window] if node.window is not None else []))


def compile_text(text: str, columns: Iterable[str], kind: str = "panel") -> Column:
    return compile_node(check(parse(text), columns, kind))


@dataclass
class FactorSpec:
    """A factor of a library; the names are those of the library's JSON format."""

    name: str
    expression: str
    sign: int = 1
    metrics: dict = field(default_factory=dict)


@dataclass
class FactorLibrary:
    """Named expressions over a fixed list of fields, kept as JSON."""

    factors: list[FactorSpec]
    field_names: list[str]
    windows: list[int] = field(default_factory=lambda: [3, 5, 10, 20, 60])
    kind: str = "panel"

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=1)

    @classmethod
    def load(cls, path: str) -> FactorLibrary:
        with open(path) as f:
            raw = json.load(f)
        return cls([FactorSpec(**x) for x in raw.pop("factors")], **raw)

    def apply(self, df: DataFrame, batch: int = 30) -> DataFrame:
        """df with one float column a factor: non-finite NULL, times its sign. Some expressions a select, so that
        generated code stays within the JVM's limits."""
        missing = [c for c in self.field_names if c not in df.columns]
        if missing:
            raise ExpressionError(f"no columns {missing}")
        for k in range(0, len(self.factors), batch):
            df = df.withColumns({s.name: (finite(compile_text(s.expression, self.field_names, self.kind)) * s.sign).cast("float") for s in self.factors[k : k + batch]})
        return df

    def export_script(self, path: str) -> None:
        """A script that adds the factors to a parquet table: ``spark-submit script.py IN OUT``."""
        text = json.dumps(json.dumps(asdict(self)))
        with open(path, "w") as f:
            f.write(_SCRIPT.replace("LIBRARY_JSON", text))


_SCRIPT = '''"""Adds the factors of a library to a parquet table: script.py IN OUT"""
import json
import sys

from pyspark.sql import SparkSession

from strake.functions.expr import FactorLibrary, FactorSpec

raw = json.loads(LIBRARY_JSON)
library = FactorLibrary([FactorSpec(**x) for x in raw.pop("factors")], **raw)
spark = SparkSession.builder.getOrCreate()
library.apply(spark.read.parquet(sys.argv[1])).write.mode("overwrite").parquet(sys.argv[2])
'''
