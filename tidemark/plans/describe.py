"""Expressions as tables, text and DOT."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.plans.expr import Expr


def rows(e: Expr) -> list[tuple]:
    """(id, op, input_a, input_b, window, lag, value, is_output), operands first."""
    nodes = list(e.nodes())
    at = {n: k for k, n in enumerate(nodes)}
    return [(k, f"input:{n.value}" if n.op == "input" else n.op, *(at[n.args[i]] if len(n.args) > i else -1 for i in (0, 1)), n.window, n.lag, float(n.value) if n.op == "const" else 0.0, n is nodes[-1]) for k, n in enumerate(nodes)]


def describe(spark: SparkSession, e: Expr) -> DataFrame:
    return spark.createDataFrame(rows(e), "id int, op string, input_a int, input_b int, window int, lag int, value double, is_output boolean")


def _label(n: Expr) -> str:
    extra = [str(v) for v, on in ((n.window, n.rolling), (n.lag, n.lag)) if on]
    return str(n.value) if n.op in ("input", "const") else n.op + (f"[{','.join(extra)}]" if extra else "")


def tree(e: Expr) -> str:
    """The expression as an indented tree."""

    def lines(n: Expr, lead: str, last: bool, top: bool) -> list[str]:
        own = [_label(n) if top else f"{lead}{'└─ ' if last else '├─ '}{_label(n)}"]
        below = "" if top else lead + ("   " if last else "│  ")
        for k, a in enumerate(n.args):
            own += lines(a, below, k == len(n.args) - 1, False)
        return own

    return "\n".join(lines(e, "", True, True))


def dot(e: Expr, name: str = "factor") -> str:
    nodes = list(e.nodes())
    at = {n: k for k, n in enumerate(nodes)}
    out = [f"digraph {name} {{", "  rankdir=BT;"]
    out += [f'  n{k} [label="{_label(n)}"{", shape=box" if n.op == "input" else ""}];' for k, n in enumerate(nodes)]
    out += [f"  n{at[a]} -> n{at[n]};" for n in nodes for a in n.args]
    return "\n".join([*out, "}"])
