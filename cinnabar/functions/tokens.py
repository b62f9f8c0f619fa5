"""Structure tokens of a syntax tree, by four views: definitions and calls, classes, control flow, expressions.

Each view says its tokens in the order of one walk from the top; a tree's tokens are those of the four views one after
another, its complexity and dependencies are summed and united over the views.
"""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterator

Tokens = Iterator[str]
VIEWS = ("define", "class", "flow", "express")
_SAYS: dict[str, dict[type, Callable[[ast.AST], Tokens]]] = {v: {} for v in VIEWS}
_COUNTED_BUILTINS = frozenset("enumerate filter len map range zip".split())
_ITERATORS = frozenset("enumerate range zip".split())
#: What a node adds to the complexity.
_ONE = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.Call, ast.ClassDef, ast.If, ast.For, ast.While, ast.With, ast.Try)


def _says(view: str, *kinds: type) -> Callable:
    def add(f: Callable[[ast.AST], Tokens]) -> Callable[[ast.AST], Tokens]:
        _SAYS[view].update(dict.fromkeys(kinds, f))
        return f

    return add


def _named(prefix: str, node: ast.AST | None) -> Tokens:
    """prefix:name of a plain name."""
    if isinstance(node, ast.Name):
        yield f"{prefix}:{node.id}"


def _called(prefix: str, node: ast.AST | None) -> Tokens:
    """prefix:name of a call of a plain name."""
    if isinstance(node, ast.Call):
        yield from _named(prefix, node.func)


def annotation(node: ast.AST) -> str:
    """An annotation in short."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Constant(value=value):
            return str(value)
        case ast.Subscript(value=base, slice=inner):
            parts = inner.elts if hasattr(inner, "elts") else [inner]
            return f"{annotation(base)}[{','.join(map(annotation, parts))}]"
    return ast.dump(node)


def coarse(node: ast.AST) -> str:
    """An operand's kind."""
    if type(node) is ast.Constant:
        return type(node.value).__name__
    kinds = {ast.Name: "var", ast.Call: "call", ast.List: "list", ast.Dict: "dict", ast.BinOp: "binop"}
    return kinds.get(type(node), "expr")


def inferred(node: ast.AST) -> str:
    """A value's type as far as it can be seen."""
    match node:
        case ast.Constant(value=value):
            return type(value).__name__
        case ast.Name(id=name):
            return "var:" + name
        case ast.Call(func=ast.Name(id=name)):
            return "call:" + name
        case ast.List() | ast.Dict() | ast.Set():
            return type(node).__name__.lower()
    return "unknown"


@_says("define", ast.FunctionDef, ast.AsyncFunctionDef)
def _function(f: ast.FunctionDef) -> Tokens:
    if isinstance(f, ast.AsyncFunctionDef):
        yield "ASYNC_FUNC"
    yield f"FUNC:{len(f.args.args)}"
    yield f"DECORATOR:{len(f.decorator_list)}"
    for kind, given in (("ARG", f.args.args), ("KWARG", f.args.kwonlyargs)):
        for at, a in enumerate(given):
            yield f"{kind}:{at}:{a.arg}"
            if a.annotation:
                yield f"{kind}_TYPE:{at}:{annotation(a.annotation)}"
    if f.args.defaults:
        yield f"DEFAULTS:{len(f.args.defaults)}"
    if keyed := [d for d in f.args.kw_defaults if d is not None]:
        yield f"KW_DEFAULTS:{len(keyed)}"
    if f.returns:
        yield "RETURN_TYPE:" + annotation(f.returns)


@_says("define", ast.Lambda)
def _lambda(f: ast.Lambda) -> Tokens:
    yield f"LAMBDA:{len(f.args.args)}"


@_says("define", ast.Call)
def _call(c: ast.Call) -> Tokens:
    match c.func:
        case ast.Name(id=name):
            yield "CALL:" + name
            if name in _COUNTED_BUILTINS:
                yield "BUILTIN:" + name
        case ast.Attribute(attr=name):
            yield "CALL_ATTR:" + name
        case _:
            yield "CALL:COMPLEX"
    yield f"CALL_ARGS:{len(c.args)}"


@_says("define", ast.Return)
def _return(r: ast.Return) -> Tokens:
    yield "RETURN"
    if r.value is None:
        return
    yield "RETURN_VALUE"
    match r.value:
        case ast.Name(id=name):
            yield "RETURN_VAR:" + name
        case ast.Constant(value=value):
            yield "RETURN_CONST:" + type(value).__name__
        case ast.List(elts=some):
            yield f"RETURN_LIST_SIZE:{len(some)}"
        case ast.Dict(keys=some):
            yield f"RETURN_DICT_SIZE:{len(some)}"
        case ast.Call():
            yield from _called("RETURN_CALL", r.value)


@_says("define", ast.Yield)
def _yield(y: ast.Yield) -> Tokens:
    yield "YIELD"
    if y.value:
        yield "YIELD_VALUE"


@_says("define", ast.YieldFrom)
def _yield_from(_: ast.YieldFrom) -> Tokens:
    yield "YIELD_FROM"


@_says("class", ast.ClassDef)
def _class(c: ast.ClassDef) -> Tokens:
    yield f"CLASS:{len(c.bases)}"
    yield f"CLASS_DECORATOR:{len(c.decorator_list)}"
    for d in c.decorator_list:
        yield from _named("DECORATOR_NAME", d)
        yield from _called("DECORATOR_CALL", d)
    for b in c.bases:
        yield from _named("BASE", b)
        if isinstance(b, ast.Attribute) and isinstance(b.value, ast.Name):
            yield f"BASE_ATTR:{b.value.id}.{b.attr}"
    for k in c.keywords:
        if k.arg == "metaclass":
            yield "METACLASS"
            yield from _named("METACLASS_NAME", k.value)
    methods = 0
    for x in c.body:
        if isinstance(x, ast.FunctionDef):
            methods += 1
            if x.name[:2] == x.name[-2:] == "__":
                yield "DUNDER:" + x.name
        elif isinstance(x, (ast.AnnAssign, ast.Assign)):
            yield "CLASS_ATTR" + "_ANNOTATED" * isinstance(x, ast.AnnAssign)
    yield f"METHODS:{methods}"


@_says("class", ast.Attribute)
def _attribute(a: ast.Attribute) -> Tokens:
    if isinstance(a.value, ast.Name):
        owner = a.value.id
        yield f"{owner.upper()}_ATTR:{a.attr}" if owner in ("self", "cls") else f"ATTR:{owner}.{a.attr}"


def _condition(test: ast.AST) -> Tokens:
    match test:
        case ast.Compare(ops=ops):
            yield f"CONDITION_CMP:{len(ops)}"
        case ast.BoolOp(op=op):
            yield "CONDITION_BOOL:" + type(op).__name__
        case ast.UnaryOp(op=ast.Not()):
            yield "CONDITION_NOT"


@_says("flow", ast.If)
def _if(x: ast.If) -> Tokens:
    yield "IF"
    yield from _condition(x.test)
    if x.orelse:
        yield "HAS_ELSE"
        if len(x.orelse) == 1 and isinstance(x.orelse[0], ast.If):
            yield "ELIF"


@_says("flow", ast.While)
def _while(x: ast.While) -> Tokens:
    yield "WHILE"
    yield from _condition(x.test)
    if x.orelse:
        yield "WHILE_ELSE"


@_says("flow", ast.For)
def _for(x: ast.For) -> Tokens:
    yield "FOR"
    match x.iter:
        case ast.Call(func=ast.Name(id=name)) if name in _ITERATORS:
            yield "ITER_" + name.upper()
        case ast.Name():
            yield "ITER_VAR"
        case ast.List():
            yield "ITER_LIST"
    if x.orelse:
        yield "FOR_ELSE"


@_says("flow", ast.With)
def _with(x: ast.With) -> Tokens:
    yield f"WITH:{len(x.items)}"
    for item in x.items:
        yield from _called("WITH_CALL", item.context_expr)
        if item.optional_vars:
            yield "WITH_AS"


@_says("flow", ast.Try)
def _try(x: ast.Try) -> Tokens:
    yield "TRY"
    yield f"EXCEPT_COUNT:{len(x.handlers)}"
    if typed := [h for h in x.handlers if h.type is not None]:
        yield f"EXCEPT_SPECIFIC:{len(typed)}"
    if x.orelse:
        yield "TRY_ELSE"
    if x.finalbody:
        yield "FINALLY"


@_says("flow", ast.ExceptHandler)
def _handler(h: ast.ExceptHandler) -> Tokens:
    if h.type is None:
        yield "EXCEPT_ALL"
    yield from _named("EXCEPT_TYPE", h.type)
    if isinstance(h.type, ast.Tuple):
        yield f"EXCEPT_MULTI:{len(h.type.elts)}"
    if h.name:
        yield "EXCEPT_AS:" + h.name


@_says("flow", ast.Break, ast.Continue, ast.Pass)
def _plain(x: ast.AST) -> Tokens:
    yield type(x).__name__.upper()


@_says("flow", ast.Raise)
def _raise(x: ast.Raise) -> Tokens:
    yield "RAISE"
    yield from _named("RAISE_TYPE", x.exc)
    yield from _called("RAISE_CALL", x.exc)
    if x.cause:
        yield "RAISE_FROM"


@_says("flow", ast.Assert)
def _assert(x: ast.Assert) -> Tokens:
    yield "ASSERT"
    if x.msg:
        yield "ASSERT_MSG"


@_says("flow", ast.Match)
def _match(x: ast.Match) -> Tokens:
    yield f"MATCH:{len(x.cases)}"


@_says("express", ast.BinOp)
def _binary(x: ast.BinOp) -> Tokens:
    op = type(x.op).__name__
    yield "BINOP:" + op
    yield f"BINOP_TYPES:{coarse(x.left)}_{op}_{coarse(x.right)}"


@_says("express", ast.UnaryOp)
def _unary(x: ast.UnaryOp) -> Tokens:
    yield "UNARY:" + type(x.op).__name__


@_says("express", ast.Compare)
def _compare(x: ast.Compare) -> Tokens:
    yield from ("CMP:" + type(op).__name__ for op in x.ops)
    if len(x.ops) > 1:
        yield f"CMP_CHAIN:{len(x.ops)}"


@_says("express", ast.BoolOp)
def _bool(x: ast.BoolOp) -> Tokens:
    yield "BOOL:" + type(x.op).__name__
    yield f"BOOL_VALUES:{len(x.values)}"


@_says("express", ast.Assign)
def _assign(x: ast.Assign) -> Tokens:
    for t in x.targets:
        match t:
            case ast.Name(id=name):
                yield "ASSIGN_VAR:" + name
            case ast.Tuple(elts=some) | ast.List(elts=some):
                yield f"UNPACK:{len(some)}"
            case ast.Subscript():
                yield "ASSIGN_SUBSCRIPT"
            case ast.Attribute():
                yield "ASSIGN_ATTR"
    yield "ASSIGN_VALUE:" + inferred(x.value)


@_says("express", ast.AugAssign)
def _augmented(x: ast.AugAssign) -> Tokens:
    yield "AUGASSIGN:" + type(x.op).__name__
    yield from _named("AUGASSIGN_VAR", x.target)


@_says("express", ast.AnnAssign)
def _annotated(x: ast.AnnAssign) -> Tokens:
    yield "ANN_ASSIGN"
    yield "ANN_TYPE:" + annotation(x.annotation)
    yield from _named("ANN_VAR", x.target)


@_says("express", ast.NamedExpr)
def _walrus(x: ast.NamedExpr) -> Tokens:
    yield "NAMED_EXPR"
    yield from _named("WALRUS_VAR", x.target)


@_says("express", ast.ListComp, ast.DictComp, ast.SetComp, ast.GeneratorExp)
def _comprehension(x: ast.ListComp) -> Tokens:
    kind = "GENEXP" if isinstance(x, ast.GeneratorExp) else type(x).__name__.upper()
    yield f"{kind}:{len(x.generators)}"
    for g in x.generators:
        if isinstance(g.iter, ast.Name):
            yield "COMP_ITER_VAR"
        yield from _called("COMP_ITER_CALL", g.iter)
        if g.ifs:
            yield f"COMP_FILTERS:{len(g.ifs)}"


@_says("express", ast.IfExp)
def _either(_: ast.IfExp) -> Tokens:
    yield "IFEXP"


@_says("express", ast.Subscript)
def _subscript(x: ast.Subscript) -> Tokens:
    yield "SUBSCRIPT"
    yield "SLICE" if isinstance(x.slice, ast.Slice) else "INDEX"


@_says("express", ast.Import, ast.ImportFrom)
def _import(x: ast.Import | ast.ImportFrom) -> Tokens:
    if isinstance(x, ast.ImportFrom):
        yield f"FROM_IMPORT:{x.module or ''}"
        yield f"IMPORT_NAMES:{len(x.names)}"
    else:
        yield f"IMPORT:{len(x.names)}"
    yield from (f"IMPORT_AS:{a.asname}" for a in x.names if a.asname)


def preorder(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes from the top, each before its children; deep trees don't matter."""
    open_nodes = [node]
    while open_nodes:
        x = open_nodes.pop()
        yield x
        open_nodes += reversed(list(ast.iter_child_nodes(x)))


def structure(node: ast.AST) -> tuple[list[str], int, list[str]]:
    """The tokens of a tree, its complexity, and the sorted names that it depends on."""
    nodes = list(preorder(node))
    tokens = [t for v in VIEWS for x in nodes if type(x) in _SAYS[v] for t in _SAYS[v][type(x)](x)]
    complexity = sum(len(x.cases) if isinstance(x, ast.Match) else isinstance(x, _ONE) for x in nodes)
    needs = set()
    for x in nodes:
        if isinstance(x, ast.Call):
            needs |= {x.func.value.id} if isinstance(x.func, ast.Attribute) and isinstance(x.func.value, ast.Name) else set()
        elif isinstance(x, ast.ClassDef):
            for b in x.bases:
                root = b.value if isinstance(b, ast.Attribute) else b
                needs |= {root.id} if isinstance(root, ast.Name) else set()
    return tokens, complexity, sorted(needs)
