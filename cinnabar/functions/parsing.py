"""What needs Python's own parser: units, structure, metrics and statement counts of Python source.

Source is handed over in Arrow batches, of which each different text is parsed once; text that doesn't parse gives no units,
and a structure with its error.  Operators on tables deal the rows to all cores by their text, so that copies meet.
"""

from __future__ import annotations

import ast
import hashlib
import textwrap
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cinnabar.functions import tokens as K
from cinnabar.sources.scratch import spread

UNIT = "file_path string, name string, type string, source_code string, start_line int, end_line int, complexity_score int, dependencies array<string>, hash string, tokens array<string>"
STRUCTURE = "error string, functions array<string>, classes array<string>, methods array<string>, imports array<string>, variables array<string>, decorators array<string>, control_flow array<string>, loc int, complexity int, nesting_depth int, features array<string>"
STATEMENTS = "kind string, name string, statements int, returns int, return_kind string, has_pass boolean, code_lines int, decorated boolean, methods int, data_model boolean, body_statements int"
_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType())}


def _shape(ddl: str) -> T.StructType:
    """A flat DDL as a type, where there is no session yet."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (x.split() for x in ddl.split(", "))])


def _fields(ddl: str) -> list[tuple[str, pa.DataType]]:
    return [(n, _ARROW[t]) for n, t in (x.split() for x in ddl.split(", "))]


def each_once(texts: pa.Array, made: Callable[[list[str | None]], pa.Array]) -> pa.Array:
    """For every text, what is made of each different one."""
    coded = pc.dictionary_encode(texts, null_encoding="encode")
    return made(coded.dictionary.to_pylist()).take(coded.indices)


def _parse(source: str) -> ast.Module | str:
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return str(e) or type(e).__name__


_DEFINED = {ast.ClassDef, ast.FunctionDef}
_BRANCHES = {ast.ExceptHandler, ast.For, ast.If, ast.While}


def _complexity(node: ast.AST) -> int:
    """One more than the branches, and each further operand of "and" and "or"."""
    every = list(ast.walk(node))
    return 1 + sum(type(x) in _BRANCHES for x in every) + sum(len(x.values) - 1 for x in every if type(x) is ast.BoolOp)


def unit_source(lines: list[str], first: int, last: int) -> str:
    """Lines first to last, from 1, without the indent that all non-blank ones share; shorter lines stay."""
    own = lines[first - 1 : last]
    indent = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
    return "\n".join(x[indent:] if len(x) > indent else x for x in own)


def _units(tree: ast.Module, source: str) -> Iterator[tuple]:
    lines = source.splitlines()
    for node in ast.walk(tree):
        if type(node) in _DEFINED:
            own = unit_source(lines, node.lineno, node.end_lineno)
            said, complexity, needs = K.structure(node)
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            yield node.name, kind, own, node.lineno, node.end_lineno, complexity, needs, hashlib.md5(f"{node.name}:{own}".encode()).hexdigest(), said


def units(source: str | None) -> Iterator[tuple]:
    """(name, type, source, first line, last line, complexity, dependencies, hash, tokens) of each def and class, the outer first."""
    tree = _parse(source) if source is not None else ""
    return iter(()) if isinstance(tree, str) else _units(tree, source)


def extract_units(files: DataFrame, path_col: str = "file_path", code_col: str = "code_content") -> DataFrame:
    """One row for each function and class of each file."""
    fields = _fields(UNIT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            coded = pc.dictionary_encode(b.column("c"), null_encoding="encode")
            found = [list(units(c)) for c in coded.dictionary.to_pylist()]
            many = np.array([len(x) for x in found], np.int64)
            first, at = np.cumsum(many) - many, coded.indices.to_numpy()
            size = many[at]
            rows = pa.array(np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(size.sum()))
            flat = [u for x in found for u in x]
            columns = [pa.array([u[k] for u in flat], t).take(rows) for k, (_, t) in enumerate(fields[1:])]
            yield pa.RecordBatch.from_arrays([b.column("p").cast(pa.string()).take(pa.array(np.repeat(np.arange(len(at)), size))), *columns], names=[n for n, _ in fields])

    return spread(files.select(F.col(path_col).alias("p"), F.col(code_col).alias("c")), "c").mapInArrow(run, UNIT)


def signature(tokens: Column) -> Column:
    """Structure tokens as one text."""
    return F.array_join(tokens, "|")


def structure_hash(tokens: Column) -> Column:
    """The first 16 digits of a signature's SHA-256."""
    return F.substring(F.sha2(signature(tokens), 256), 1, 16)


def structure_report(units: DataFrame, path_col: str = "file_path") -> DataFrame:
    """Of each file: units by type, complexity, lines, the largest unit, and all dependencies in order."""
    lines = F.col("end_line") - F.col("start_line") + 1
    return units.groupBy(path_col).agg(
        F.count(F.lit(1)).alias("total_units"), F.count_if(F.col("type") == "function").alias("functions"), F.count_if(F.col("type") == "class").alias("classes"),
        F.sum("complexity_score").alias("total_complexity"), F.round(F.avg("complexity_score"), 4).alias("average_complexity"),
        F.sum(lines).cast("long").alias("total_lines"), F.max(lines).alias("largest_unit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("dependencies")))).alias("dependencies"),
    )


def _decorators(node: ast.AST) -> list[str]:
    return [d.id if isinstance(d, ast.Name) else d.attr for d in node.decorator_list if isinstance(d, (ast.Name, ast.Attribute))]


def features(source: str, tree: ast.Module) -> list[str]:
    """Names and structure tokens of all units, then arities, returns and imports in order of depth."""
    out = []
    for name, kind, _, _, _, _, _, _, said in _units(tree, source):
        out.append(f"{'class' if kind == 'class' else 'func'}:{name}")
        out += "|".join(said).split("|") if said else []
    for x in ast.walk(tree):
        if isinstance(x, ast.FunctionDef):
            out.append(f"args:{len(x.args.args)}")
        elif isinstance(x, ast.Return):
            out.append("return")
        elif isinstance(x, ast.Import):
            out += [f"import:{a.name}" for a in x.names]
    return out


def structure(source: str | None) -> dict:
    """Names, imports, control flow, metrics and features of a source; functions holds every plain def, methods every def within a class."""
    out = {k: [] for k in ("functions", "classes", "methods", "imports", "variables", "decorators", "control_flow", "features")} | {"error": None, "loc": None, "complexity": None, "nesting_depth": None}
    tree = _parse(source or "")
    if isinstance(tree, str):
        return out | {"error": tree}
    kinds = {ast.For: "for", ast.While: "while", ast.If: "if", ast.Try: "try"}
    deepest = 0
    # (node, within a class, within a plain def, depth of plain defs and classes)
    open_nodes = [(tree, False, False, 0)]
    while open_nodes:
        x, in_class, in_def, depth = open_nodes.pop()
        deepest = max(deepest, depth)
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)) and in_class:
            out["methods"].append(x.name)
        if isinstance(x, (ast.FunctionDef, ast.ClassDef)):
            out["decorators"] += _decorators(x)
            depth += 1
            deepest = max(deepest, depth)
            in_class, in_def = in_class or isinstance(x, ast.ClassDef), in_def or isinstance(x, ast.FunctionDef)
        elif isinstance(x, ast.Import):
            out["imports"] += [a.name.split(".")[0] for a in x.names]
        elif isinstance(x, ast.ImportFrom) and x.module:
            out["imports"].append(x.module.split(".")[0])
        elif isinstance(x, ast.Assign) and not in_def:
            out["variables"] += [t.id for t in x.targets if isinstance(t, ast.Name)]
        if type(x) in kinds:
            out["control_flow"].append(kinds[type(x)])
        open_nodes += [(y, in_class, in_def, depth) for y in reversed(list(ast.iter_child_nodes(x)))]
    for x in ast.walk(tree):
        if type(x) in _DEFINED:
            out["classes" if isinstance(x, ast.ClassDef) else "functions"].append(x.name)
    found = {"nesting_depth": deepest, "loc": sum(bool(x.strip()) for x in (source or "").split("\n")), "complexity": _complexity(tree)}
    return out | found | {"features": features(source or "", tree)}


@F.arrow_udf(_shape(STRUCTURE))
def analyze(code: pa.Array) -> pa.Array:
    return each_once(code, lambda texts: pa.array([structure(c) for c in texts], pa.struct(_fields(STRUCTURE))))


def feature_weights(features: Column) -> Column:
    return F.transform(features, lambda f: F.when(f.startswith("class:"), 3).when(f.startswith("func:"), 2).otherwise(1))


@F.arrow_udf(T.StringType())
def normalize(code: pa.Array) -> pa.Array:
    """Parsed and written anew; what doesn't parse loses line ends' blanks and empty lines."""

    def one(c: str | None) -> str | None:
        tree = _parse(c) if c is not None else ""
        if not isinstance(tree, str):
            return ast.unparse(tree)
        return None if c is None else "\n".join(x.rstrip() for x in c.split("\n") if x.strip())

    return each_once(code, lambda texts: pa.array([one(c) for c in texts], pa.string()))


_COUNTED = tuple(getattr(ast, x) for x in "Assert Raise With Try While For If AugAssign Assign".split())
_RETURNED = {ast.Name: "name", ast.Attribute: "attribute", ast.Constant: "constant"}
_MODELS = {"NamedTuple", "TypedDict", "BaseModel"}


def _is_model(node: ast.ClassDef) -> bool:
    """Whether a class only holds data: by its decorator, its base, or as it has little but __init__."""
    if "dataclass" in _decorators(node) or any((b.id if isinstance(b, ast.Name) else getattr(b, "attr", None)) in _MODELS for b in node.bases):
        return True
    own = [x.name for x in node.body if isinstance(x, ast.FunctionDef)]
    special = [n for n in own if n != "__init__" and n.startswith("__") and n.endswith("__")]
    return len(own) <= 2 and own.count("__init__") == 1 and len(special) <= 1


def statements(source: str | None) -> dict:
    """Counts of the first statement of a source, if that is a plain def or a class; else only its kind: empty, other or error.

    statements leaves out texts that stand alone; body_statements (of the first def anywhere, as the central filter counts)
    leaves out expressions too, and is the number of lines with code where the dedented source doesn't parse or has no def.
    """
    text = source or ""
    out: dict = {}
    inner = _parse(textwrap.dedent(text))
    first = None if isinstance(inner, str) else next((x for x in ast.walk(inner) if isinstance(x, ast.FunctionDef)), None)
    if first is None:
        out["body_statements"] = sum(bool(x.strip()) and not x.strip().startswith("#") for x in text.splitlines())
    else:
        out["body_statements"] = sum(isinstance(x, _COUNTED) for x in ast.walk(first))
    tree = _parse(text)
    if isinstance(tree, str):
        return out | {"kind": "error"}
    if not tree.body:
        return out | {"kind": "empty"}
    node = tree.body[0]
    if not isinstance(node, (ast.FunctionDef, ast.ClassDef)):
        return out | {"kind": "other"}
    nodes = list(K.preorder(node))
    alone = [x for x in nodes if isinstance(x, ast.Expr)]
    texts = [x.value.value for x in alone if isinstance(x.value, ast.Constant) and isinstance(x.value.value, str)]
    returns = [x for x in nodes if isinstance(x, ast.Return)]
    total, docs = node.end_lineno - node.lineno + 1, sum(len(t.splitlines()) for t in texts)
    is_class = isinstance(node, ast.ClassDef)
    return out | {
        "kind": "class" if is_class else "function", "name": node.name, "statements": sum(isinstance(x, _COUNTED) for x in nodes) + len(alone) - len(texts),
        "returns": len(returns), "return_kind": (_RETURNED.get(type(returns[0].value), "other") if returns[0].value else "none") if returns else None,
        "has_pass": any(isinstance(x, ast.Pass) for x in nodes), "code_lines": total - (docs if is_class or not docs else min(docs, total - 2)),
        "decorated": bool(node.decorator_list), "methods": sum(isinstance(x, ast.FunctionDef) for x in node.body), "data_model": is_class and _is_model(node),
    }


@F.arrow_udf(_shape(STATEMENTS))
def count_statements(code: pa.Array) -> pa.Array:
    return each_once(code, lambda texts: pa.array([statements(c) for c in texts], pa.struct(_fields(STATEMENTS))))


@F.pandas_udf(T.StringType())
def dedent(code: pd.Series) -> pd.Series:
    """Without blank lines at the ends and the indent that the others share; blank lines within are emptied."""

    def one(c: str | None) -> str | None:
        if c is None:
            return None
        lines = c.split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip()]
        own = lines[filled[0] : filled[-1] + 1] if filled else []
        indent = min((len(x) - len(x.lstrip()) for x in own if x.strip()), default=0)
        return "\n".join(x[indent:] if x.strip() else "" for x in own)

    return code.map(one)


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio of two texts."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])
