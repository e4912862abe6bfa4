"""From a list of expressions to columns of one plan, every shared part computed once.

All expressions are cut into their operations; equal ones (by text) are one column. Columns are added in
levels of nesting, all of a level in one go: operations over a symbol's bars then share one partitioning, as
do those over a bar's symbols, and the plan changes it once a level and not once an expression.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.functions.signals import FIELDS, OPERATIONS, bars
from quantloom.operators.frames import BAR, frame, parts
from quantloom.plans.expressions import Call, Expression, as_expression


def column_name(node: Expression | Column) -> str:
    return "x_" + hashlib.md5(str(node).encode()).hexdigest()[:12]


def depth(node: Expression) -> int:
    return 1 + depth(node.of) if isinstance(node, Call) else 0


def _frame_name(node: Call) -> str:
    """Equal frames of one column are one, whatever is asked of them."""
    return f"f_{column_name(node.of)}_{node.parameters[0]}"


def with_signals(panel: DataFrame, expressions: list[str | Expression | Column]) -> tuple[DataFrame, list[str]]:
    """panel with a column for every expression, and the columns' names in the order asked for.

    A Column is a signal as it is: whatever DataFrame functions can say of the panel.
    """
    wanted = [e if isinstance(e, Column) else as_expression(e) for e in expressions]
    nodes: dict[str, Expression] = {}

    def gather(node: Expression) -> None:
        if isinstance(node, Call):
            gather(node.of)
        nodes.setdefault(column_name(node), node)

    for node in wanted:
        if not isinstance(node, Column):
            gather(node)
    done = panel.withColumns({column_name(c): c for c in wanted if isinstance(c, Column)})
    apart = True  # bars of a symbol may be in several places
    for step in sorted({depth(n) for n in nodes.values()}):
        level = {name: node for name, node in nodes.items() if depth(node) == step}
        framed = {name: node for name, node in level.items() if isinstance(node, Call) and OPERATIONS[node.name].kind == "frame"}
        frames = {_frame_name(node): node for node in framed.values()}
        if frames and apart:
            done = done.withColumn(BAR, F.row_number().over(bars()) - 1)
        # Parts of blocks first, then frames of them, each in one go.
        made = {k: v for name, node in frames.items() for k, v in parts(name, F.col(column_name(node.of)), node.parameters[0]).items()}
        done = done.withColumns(made).withColumns({name: frame(name, node.parameters[0]) for name, node in frames.items()}).drop(*made)
        added = {}
        for name, node in level.items():
            if not isinstance(node, Call):
                added[name] = FIELDS[node.name]()
                continue
            x = F.col(column_name(node.of))
            needs = (x, F.col(_frame_name(node))) if name in framed else (x,)
            added[name] = OPERATIONS[node.name].build(*needs, *node.parameters)
        done = done.withColumns(added).drop(*frames)
        apart = any(isinstance(n, Call) and OPERATIONS[n.name].kind == "cross" for n in level.values()) or (apart and not frames)
    keep = [column_name(n) for n in wanted]
    return done.select(*panel.columns, *dict.fromkeys(keep)), keep
