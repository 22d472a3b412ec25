"""The edit model: updates, inserts and deletes as DataFrames, an edit log, bounded undo, user expressions."""

from __future__ import annotations

import ast
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.laminate import numbered

#: Versions that can be undone.
HISTORY = 100


class Unsupported(ValueError):
    """An expression uses something that isn't allowed."""


def _remainder(a: Column, b: Column) -> Column:
    """The remainder with the divisor's sign."""
    rest = a % b
    return F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest)


_BINARY = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Mod: lambda a, b: _remainder(a, F.nullif(b, F.lit(0))), ast.Pow: lambda a, b: F.pow(a, b), ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a, b))}
_COMPARE = {ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b, ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b}
_CALLS = {
    "abs": (1, 1, lambda a: F.abs(a)), "min": (2, 9, lambda *a: F.least(*a)), "max": (2, 9, lambda *a: F.greatest(*a)), "int": (1, 1, lambda a: F.when(a >= 0, F.floor(a)).otherwise(F.ceil(a)).cast("bigint")),
    "float": (1, 1, lambda a: a.cast("double")), "round": (1, 2, lambda a, n=None: F.bround(a, n) if n is not None else F.bround(a)),
}


def expression(text: str, names: dict[str, Column]) -> Column:
    """A Column from an arithmetic expression over the given names, abs, min, max, round, int and float; dividing by 0 gives null."""

    def build(node) -> Column:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return F.lit(node.value)
        if isinstance(node, ast.Name) and node.id in names:
            return names[node.id]
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](build(node.left), build(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
            return -build(node.operand) if isinstance(node.op, ast.USub) else build(node.operand)
        if isinstance(node, ast.Compare) and len(node.ops) == 1 and type(node.ops[0]) in _COMPARE:
            return _COMPARE[type(node.ops[0])](build(node.left), build(node.comparators[0]))
        if isinstance(node, ast.IfExp):
            return F.when(build(node.test), build(node.body)).otherwise(build(node.orelse))
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name) and node.func.id in _CALLS and not node.keywords:
            least, most, call = _CALLS[node.func.id]
            if least <= len(node.args) <= most:
                if node.func.id == "round" and len(node.args) == 2:
                    digits = node.args[1]
                    if not (isinstance(digits, ast.Constant) and isinstance(digits.value, int)):
                        raise Unsupported("round takes a constant number of digits")
                    return call(build(node.args[0]), digits.value)
                return call(*map(build, node.args))
        raise Unsupported(ast.dump(node)[:80])

    try:
        return build(ast.parse(text, mode="eval").body)
    except SyntaxError as error:
        raise Unsupported(str(error)) from error


def batch_edit(rows: DataFrame, field: str, mode: str, value, where: Column | None = None, order: list[str] | None = None) -> DataFrame:
    """rows with ``old`` and ``new``: mode set, add, multiply, or an expression over v (the field) and every other column.

    With an order, an expression may also use ``i``, a row's place in it from 0. Integer fields are truncated. Rows outside ``where``, and those whose new value is null, keep theirs.
    """
    v, names = F.col(field), {c: F.col(c) for c in rows.columns if c != field}
    if order:
        rows, names["i"] = numbered(rows, order, "_i"), F.col("_i") - 1
    new = {"set": lambda: F.lit(value), "add": lambda: v + F.lit(value), "multiply": lambda: v * F.lit(value), "expression": lambda: expression(value, {**names, "v": v})}[mode]()
    kind = dict(rows.dtypes)[field]
    if kind in ("int", "bigint", "smallint", "tinyint"):
        new = F.when(new >= 0, F.floor(new)).otherwise(F.ceil(new))
    new = F.coalesce(new.cast(kind), v)
    return rows.withColumn("old", v).withColumn("new", F.when(where, new).otherwise(v) if where is not None else new).drop("_i")


def changed(edited: DataFrame) -> DataFrame:
    return edited.where(~F.col("old").eqNullSafe(F.col("new")))


def replay(log: DataFrame, keys: list[str]) -> DataFrame:
    """The state that a log (keys, seq, op, value) leaves: the last value of each key; keys last deleted go."""
    last = log.groupBy(*keys).agg(F.max_by(F.struct("op", "value"), "seq").alias("last"))
    return last.where("last.op <> 'delete'").select(*keys, "last.value")


def modified(log: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many different records a log changes."""
    return log.select(*keys).distinct().agg(F.count("*").alias("modified"))


def set_element(array: Column, index: int, value) -> Column:
    """An array with one element replaced, filled with 0 up to it."""
    filled = F.concat(array, F.array_repeat(F.lit(0), F.greatest(F.lit(index + 1) - F.size(array), F.lit(0))))
    return F.transform(filled, lambda x, i: F.when(i == index, F.lit(value)).otherwise(x))


def next_id(rows: DataFrame, key: str) -> DataFrame:
    """One row: the greatest id and one, or 1 where there is none."""
    return rows.agg((F.coalesce(F.max(key), F.lit(0)) + 1).alias("next_id"))


def paste(rows: DataFrame, copied: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Copied rows with new ids above all there are, in this order; ``source`` keeps the old one."""
    top = rows.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))  # one row
    return numbered(copied, order, "_n").join(F.broadcast(top)).withColumn("source", F.col(key)).withColumn(key, F.col("_top") + F.col("_n")).drop("_top", "_n")


class History:
    """Versions of a table: DataFrames don't change, so undo is to go back to an earlier one."""

    def __init__(self, table: DataFrame, most: int = HISTORY) -> None:
        self.done, self.undone, self.most = [table], [], most

    @property
    def table(self) -> DataFrame:
        return self.done[-1]

    def apply(self, *steps) -> DataFrame:
        """Apply steps (DataFrame -> DataFrame) as one batch; if one fails, nothing is done."""
        table = self.table
        for step in steps:
            table = step(table)
        self.done = [*self.done, table][-(self.most + 1) :]
        self.undone = []
        return table

    def undo(self) -> DataFrame:
        if len(self.done) > 1:
            self.undone.append(self.done.pop())
        return self.table

    def redo(self) -> DataFrame:
        if self.undone:
            self.done.append(self.undone.pop())
        return self.table


def delete(rows: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return rows.join(keys, list(on), "left_anti")
