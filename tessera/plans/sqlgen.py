"""Small helpers that write the DuckDB twins of the Spark expressions, so
both sides are generated from the same parameters."""

from __future__ import annotations

from typing import Sequence


def ident(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def lit(v) -> str:
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int,)):
        return str(v)
    if isinstance(v, float):
        return f"CAST({v!r} AS DOUBLE)"
    return "'" + str(v).replace("'", "''") + "'"


def cut_case(col: str, cuts: Sequence[float], labels: Sequence | None = None,
             include_lowest: bool = True) -> str:
    """SQL twin of ``cut_expr`` / ``cut_label_expr``."""
    parts = []
    for i in range(len(cuts) - 1):
        lo_op = ">=" if (i == 0 and include_lowest) else ">"
        out = lit(labels[i]) if labels is not None else str(i)
        parts.append(f"WHEN {col} {lo_op} {lit(float(cuts[i]))} AND {col} <= {lit(float(cuts[i+1]))} THEN {out}")
    return "CASE " + " ".join(parts) + " END"


def map_case(col: str, mapping: dict, default=None) -> str:
    parts = [f"WHEN {col} = {lit(k)} THEN {lit(v)}" for k, v in mapping.items()]
    return "CASE " + " ".join(parts) + f" ELSE {lit(default)} END"


def union_all(selects: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(selects)


def mix64(key: str, seed: int = 42) -> str:
    """Twin of ``sample.mix64`` for non-negative integer keys."""
    from tessera.operators.sample import HASH_MULT, MOD32, mixed_seed
    k = f"CAST({key} AS BIGINT)"
    h = f"xor(xor({k} % {MOD32}, {k} >> 32), {mixed_seed(seed)})"
    for _ in range(2):
        h = f"(xor({h}, {h} >> 16) * {HASH_MULT} % {MOD32})"
    return f"xor({h}, {h} >> 16)"
