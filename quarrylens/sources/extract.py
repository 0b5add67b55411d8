"""Facts from Python sources (X1-X18): one Arrow pass parses each file with
``ast`` (nothing is imported or run) and gives rows tagged by table."""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..values import NAME_CATEGORIES

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.With, ast.AsyncWith, ast.Try)
TYPES = {ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.While: "while", ast.With: "with", ast.AsyncWith: "with", ast.Try: "try"}
NESTING = (ast.If, ast.While, ast.For, ast.AsyncFor, ast.With, ast.AsyncWith, ast.Try, ast.Match)
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)


def _digest(text: str, size: int = 16) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=size).hexdigest()


def uid(*parts: object) -> str:
    return hashlib.sha256("::".join(map(str, parts)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


def module_of(path: str) -> str:
    name = path.replace("\\", "/").removesuffix(".py")
    return name.removesuffix("/__init__").replace("/", ".")


def shape(node: ast.AST) -> str:
    """Digest of the kinds of nodes, in walking order."""
    return _digest(" ".join(type(n).__name__ for n in ast.walk(node)))


class _Anonymous(ast.NodeTransformer):
    """Names numbered as they first stand, literals as their type."""

    def __init__(self):
        self.names: dict[str, str] = {}

    def _mark(self, name: str) -> str:
        return self.names.setdefault(name, f"v{len(self.names)}")

    def visit_Name(self, node):
        return ast.Name(self._mark(node.id), node.ctx)

    def visit_arg(self, node):
        return ast.arg(self._mark(node.arg), None)

    def visit_Constant(self, node):
        return ast.Constant(type(node.value).__name__)


def normalised(nodes: list[ast.stmt]) -> str:
    """Digest of the statements without names and literals."""
    again = ast.parse("\n".join(ast.unparse(n) for n in nodes))
    return _digest(ast.dump(_Anonymous().visit(again)))


def complexity(node: ast.AST) -> int:
    """Cyclomatic complexity (X11)."""
    n = 1
    for x in ast.walk(node):
        n += isinstance(x, (ast.If, ast.While, ast.For, ast.AsyncFor, ast.ExceptHandler))
        n += len(x.values) - 1 if isinstance(x, ast.BoolOp) else 0
    return n


def category(name: str) -> str:
    """Semantic category by the words in a name."""
    low = name.lower()
    return next((k for k, words in NAME_CATEGORIES.items() if any(w in low for w in words)), "business_logic")


def smell_complexity(node: ast.AST) -> int:
    """Complexity as the smell rules count it (M10): matches, conditional
    expressions and comprehensions too."""
    n = complexity(node)
    for x in ast.walk(node):
        if isinstance(x, ast.Match):
            n += len(x.cases)
        elif isinstance(x, ast.comprehension):
            n += 1 + len(x.ifs)
        elif isinstance(x, ast.IfExp):
            n += 1
    return n


def nesting_depth(node: ast.AST, depth: int = 0) -> int:
    """Most branches and loops around any node."""
    inner = depth + isinstance(node, NESTING)
    return max([depth, *(nesting_depth(c, inner) for c in ast.iter_child_nodes(node))])


def statements(node: ast.AST) -> int:
    """Statements below a node; a nested definition counts as one (M3)."""
    return sum(isinstance(c, ast.stmt) + (0 if isinstance(c, DEFINITIONS) else statements(c)) for c in ast.iter_child_nodes(node))


def structure(node: ast.AST) -> str:
    """Nested kinds of statements, without names and values."""
    kind = type(node).__name__
    inside = lambda *lists: ",".join(structure(x) for part in lists for x in part)
    match node:
        case ast.FunctionDef():
            return f"{kind}({len(node.args.args)},{inside(node.body)})"
        case ast.Try():
            return f"{kind}({inside(node.body, node.orelse, node.finalbody)})"
        case ast.If() | ast.For() | ast.While():
            return f"{kind}({inside(node.body, node.orelse)})"
        case ast.Module() | ast.ClassDef() | ast.With():
            return f"{kind}({inside(node.body)})"
        case ast.Expr():
            return f"{kind}({structure(node.value)})"
        case ast.Call():
            return f"{kind}({len(node.args)})"
        case ast.BinOp():
            return f"{kind}({type(node.op).__name__})"
        case ast.Compare():
            return f"{kind}({len(node.ops)})"
    return kind


def dotted(node: ast.AST) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *parts[::-1]]) if isinstance(node, ast.Name) else None


def root_of(node: ast.AST) -> str | None:
    """The name that a chain of attributes begins with."""
    while isinstance(node, ast.Attribute):
        node = node.value
    return node.id if isinstance(node, ast.Name) else None


def inferred(node: ast.AST) -> dict[str, str]:
    """Types of names that assignments to a call of a class tell, written
    annotations aside (X15): by flow, so that where branches disagree, or one of
    them alone assigns, nothing is known."""

    def of(value: ast.expr) -> str | None:
        name = dotted(value.func) if isinstance(value, ast.Call) else None
        return name if name and name.split(".")[-1].lstrip("_")[:1].isupper() else None

    def merged(known: dict, *ends: dict) -> dict:
        out = dict(known)
        for name in {n for e in ends for n in e}:
            kinds = {e.get(name) for e in ends}
            if len(kinds) == 1 and None not in kinds:
                out[name] = kinds.pop()
            else:
                out.pop(name, None)
        return out

    def block(body: list[ast.stmt], known: dict) -> dict:
        for x in body:
            match x:
                case ast.Assign(targets=targets, value=value):
                    for t in targets:
                        if name := dotted(t):
                            known = {k: v for k, v in known.items() if k != name} | ({name: kind} if (kind := of(value)) else {})
                case ast.AnnAssign(target=target):
                    known = {k: v for k, v in known.items() if k != dotted(target)}
                case ast.If(body=yes, orelse=no):
                    known = merged(known, block(yes, known), block(no, known))
                case ast.Try(body=tried, handlers=handlers, orelse=no, finalbody=last):
                    ends = [block(no, block(tried, known)), *(block(h.body, known) for h in handlers)]
                    known = block(last, merged(known, *ends))
                case ast.For(body=inner) | ast.AsyncFor(body=inner) | ast.While(body=inner):
                    known = merged(known, known, block(inner, known))
                case ast.With(body=inner) | ast.AsyncWith(body=inner):
                    for item in x.items:
                        if item.optional_vars is not None and (name := dotted(item.optional_vars)) and (kind := of(item.context_expr)):
                            known = known | {name: kind}
                    known = block(inner, known)
        return known

    return block(getattr(node, "body", []), {})


def own_nodes(node: ast.AST) -> Iterator[ast.AST]:
    """What stands below a node, without nested definitions."""
    for child in ast.iter_child_nodes(node):
        if not isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            yield child
            yield from own_nodes(child)


def imported(node: ast.Import | ast.ImportFrom, module: str, is_package: bool) -> list[str]:
    """Absolute names that an import brings."""
    if isinstance(node, ast.Import):
        return [a.name for a in node.names]
    base = node.module or ""
    if node.level:
        parts = module.split(".")
        keep = len(parts) - node.level + is_package
        base = ".".join([*parts[: max(keep, 0)], *filter(None, [base])])
    return [base if a.name == "*" else f"{base}.{a.name}".strip(".") for a in node.names]


def _text(node: ast.AST | None) -> str | None:
    return None if node is None else ast.unparse(node)


def details(node: ast.AST) -> Iterator[tuple[str, str | None, str | None, int]]:
    """Finer facts of one scope (X14): kind, name, value, line. Kinds: doc,
    alias (a name bound by an import, value: what it is), parameter (value:
    annotation or default), type_hint, raise, handler,
    optional_import, flag, key (value: get, in or index), argument (name:
    callee:parameter), assert, mock, literal, global, return, export."""
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Module)) and (doc := ast.get_docstring(node)):
        yield "doc", None, doc, getattr(node, "lineno", 1)
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
        named = [*node.args.posonlyargs, *node.args.args]
        defaults = dict(zip([a.arg for a in named[::-1]], node.args.defaults[::-1])) | {a.arg: d for a, d in zip(node.args.kwonlyargs, node.args.kw_defaults) if d is not None}
        for a in [*named, *node.args.kwonlyargs]:
            yield "parameter", a.arg, _text(defaults.get(a.arg)), a.lineno
            if a.annotation is not None:
                yield "type_hint", a.arg, _text(a.annotation), a.lineno
    for x in own_nodes(node):
        line = getattr(x, "lineno", 0)
        if isinstance(x, (ast.Import, ast.ImportFrom)):
            for a in x.names:
                if isinstance(x, ast.Import):
                    yield "alias", a.asname or a.name.split(".")[0], a.name if a.asname else a.name.split(".")[0], line
                elif not x.level and a.name != "*":
                    yield "alias", a.asname or a.name, f"{x.module}.{a.name}", line
        elif isinstance(x, ast.Raise):
            yield "raise", dotted(x.exc.func if isinstance(x.exc, ast.Call) else x.exc) if x.exc else None, _text(x.exc), line
        elif isinstance(x, ast.ExceptHandler):
            yield "handler", _text(x.type), "pass" if all(isinstance(y, ast.Pass) for y in x.body) else "handled", line
        elif isinstance(x, ast.Try):
            guarded = any(h.type is not None and "Import" in ast.unparse(h.type) or h.type is not None and "ModuleNotFound" in ast.unparse(h.type) for h in x.handlers)
            for y in x.body if guarded else []:
                if isinstance(y, (ast.Import, ast.ImportFrom)):
                    for name in imported(y, "", False):
                        yield "optional_import", name, None, y.lineno
        elif isinstance(x, ast.Assign) and len(x.targets) == 1 and isinstance(x.targets[0], ast.Name) and x.targets[0].id == "__all__" and isinstance(x.value, (ast.List, ast.Tuple)):
            for e in x.value.elts:
                if isinstance(e, ast.Constant) and isinstance(e.value, str):
                    yield "export", e.value, None, line
        elif isinstance(x, ast.Assign) and isinstance(x.value, ast.Constant) and isinstance(x.value.value, bool):
            for t in x.targets:
                if isinstance(t, ast.Name) and t.id.isupper():
                    yield "flag", t.id, str(x.value.value), line
        elif isinstance(x, ast.AnnAssign) and (name := dotted(x.target)):
            yield "type_hint", name, _text(x.annotation), line
        elif isinstance(x, ast.Subscript) and isinstance(x.slice, ast.Constant) and isinstance(x.slice.value, str) and (name := dotted(x.value)):
            yield "key", name, f"index:{x.slice.value}", line
        elif isinstance(x, ast.Compare) and len(x.ops) == 1 and isinstance(x.ops[0], ast.In) and isinstance(x.left, ast.Constant) and isinstance(x.left.value, str) and (name := dotted(x.comparators[0])):
            yield "key", name, f"in:{x.left.value}", line
        elif isinstance(x, ast.Call):
            name = dotted(x.func)
            if name and name.endswith(".get") and x.args and isinstance(x.args[0], ast.Constant) and isinstance(x.args[0].value, str):
                yield "key", name[:-4], f"get:{x.args[0].value}", line
            if name:
                for k, a in enumerate(x.args):
                    yield "argument", f"{name}:{k}", _text(a), line
                for a in x.keywords:
                    yield "argument", f"{name}:{a.arg or '**'}", _text(a.value), line
                if name.split(".")[-1].startswith("assert"):
                    yield "assert", name, _text(x), line
                elif name.split(".")[-1] in ("Mock", "MagicMock", "patch", "create_autospec"):
                    yield "mock", name, _text(x), line
        elif isinstance(x, ast.Assert):
            yield "assert", None, _text(x.test), line
        elif isinstance(x, ast.Constant) and isinstance(x.value, (str, int, float)) and not isinstance(x.value, bool):
            yield "literal", type(x.value).__name__, str(x.value), line
        elif isinstance(x, ast.Global):
            for name in x.names:
                yield "global", name, None, line
        elif isinstance(x, ast.Return):
            yield "return", None, _text(x.value), line


class Extractor:
    """Rows of one file."""

    def __init__(self, path: str):
        self.path, self.module = path, module_of(path)
        self.rows: list[tuple[str, dict]] = []
        self.seen: dict[tuple, int] = {}

    def symbol(self, node, name: str, kind: str, parent: str | None, qualified: str) -> str:
        k = self.seen[key] = self.seen.get(key := (parent, name), -1) + 1
        own = uid(self.path, qualified, kind) if not k else uid(self.path, f"{qualified}:{k}", kind)
        marks = {dotted(d.func if isinstance(d, ast.Call) else d) for d in getattr(node, "decorator_list", [])}
        start, end = getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or len(node.body) or 1
        signature = f"({ast.unparse(node.args)})" if hasattr(node, "args") else ""
        row = {
            "symbol_uid": own, "file_path": self.path, "name": name, "qualified_name": qualified, "kind": kind, "parent_uid": parent, "line_start": start, "line_end": end,
            "signature": signature, "ast_fingerprint": shape(node), "token_fingerprint": _digest(ast.unparse(node)), "semantic_category": category(name), "is_public": not name.startswith("_"),
            "is_async": isinstance(node, ast.AsyncFunctionDef), "is_property": "property" in marks, "is_static": "staticmethod" in marks, "is_classmethod": "classmethod" in marks,
            "complexity_score": complexity(node), "lines_of_code": end - start + 1, "base_classes": [x for b in getattr(node, "bases", []) if (x := dotted(b))],
            "smell_complexity": smell_complexity(node), "nesting_depth": nesting_depth(node), "statement_count": statements(node), "structure": structure(node),
        }
        self.rows.append(("symbols", row))
        return own

    def depend(self, source: str, target: str, kind: str, line: int) -> None:
        exact = kind == "imports"
        self.rows.append(("dependencies", {"source_uid": source, "file_path": self.path, "target_external": target, "dependency_kind": kind, "resolution": "exact" if exact else "probable", "confidence": 1.0 if exact else 0.7, "line": line}))

    def body(self, node, own: str) -> None:
        for kind, name, value, line in details(node):
            self.rows.append(("details", {"symbol_uid": own, "file_path": self.path, "detail": kind, "name": name, "value": value, "line": line}))
        package = self.path.endswith("__init__.py")
        within = {x.value for x in own_nodes(node) if isinstance(x, ast.Attribute) and isinstance(x.value, ast.Attribute)}  # parts of longer chains
        for name, kind in inferred(node).items():
            self.rows.append(("details", {"symbol_uid": own, "file_path": self.path, "detail": "type_hint", "name": name, "value": kind, "line": getattr(node, "lineno", 1)}))
        for x in own_nodes(node):
            if isinstance(x, (ast.Import, ast.ImportFrom)):
                for name in imported(x, self.module, package):
                    self.depend(own, name, "imports", x.lineno)
                if isinstance(x, ast.ImportFrom) and x.level:  # what a relative import binds is known only with the module
                    for a, name in zip(x.names, imported(x, self.module, package)):
                        if a.name != "*":
                            self.rows.append(("details", {"symbol_uid": own, "file_path": self.path, "detail": "alias", "name": a.asname or a.name, "value": name, "line": x.lineno}))
            elif isinstance(x, ast.Call) and (name := dotted(x.func)):
                self.depend(own, name, "calls", x.lineno)
            elif isinstance(x, ast.Attribute):
                kind = "read" if isinstance(x.ctx, ast.Load) else "write" if isinstance(x.ctx, ast.Store) else "delete"
                self.rows.append(("attribute_access", {"symbol_uid": own, "file_path": self.path, "attribute_name": x.attr, "access_type": kind, "line_number": x.lineno, "receiver": x.value.id if isinstance(x.value, ast.Name) else None, "root": root_of(x), "outermost": x not in within}))

    def blocks(self, node, own: str, level: int = 1) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(x, BRANCHES):
                text = ast.unparse(x)
                self.rows.append(("blocks", {
                    "block_uid": uid(self.path, own, TYPES[type(x)], x.lineno, x.col_offset), "symbol_uid": own, "file_path": self.path, "block_type": TYPES[type(x)], "line_start": x.lineno, "line_end": x.end_lineno,
                    "lines_of_code": x.end_lineno - x.lineno + 1, "statement_count": sum(isinstance(y, ast.stmt) for y in ast.walk(x)) - 1, "nesting_level": level,
                    "ast_fingerprint": shape(x), "token_fingerprint": _digest(re.sub(r"\s+", " ", text)), "normalized_fingerprint": normalised([x]),
                }))
                self.blocks(x, own, level + 1)
            else:
                self.blocks(x, own, level)

    def walk(self, node, parent: str, prefix: str, in_class: bool) -> None:
        for x in ast.iter_child_nodes(node):
            if isinstance(x, ast.ClassDef):
                own = self.symbol(x, x.name, "class", parent, f"{prefix}.{x.name}")
                for b in x.bases:
                    if name := dotted(b):
                        self.depend(own, name, "inherits", x.lineno)
                self.body(x, own)
                self.walk(x, own, f"{prefix}.{x.name}", True)
            elif isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = self.symbol(x, x.name, "method" if in_class else "function", parent, f"{prefix}.{x.name}")
                self.body(x, own)
                self.blocks(x, own)
                self.walk(x, own, f"{prefix}.{x.name}", False)
            elif not isinstance(x, ast.expr):
                self.walk(x, parent, prefix, in_class)

    def run(self, source: str) -> list[tuple[str, dict]]:
        tree = ast.parse(source)
        own = self.symbol(tree, self.module.split(".")[-1], "module", None, self.module)
        self.body(tree, own)
        self.walk(tree, own, self.module, False)
        return self.rows


def extract(path: str, source: str | None) -> list[tuple[str, dict]]:
    """Rows of a file; a file too large, or that does not parse, gives an error row."""
    if source is None:
        return [("errors", {"file_path": path, "message": "too large"})]
    try:
        return Extractor(path).run(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [("errors", {"file_path": path, "message": f"{type(e).__name__}: {e}"})]


_TAGGED = ", ".join(f"{name} struct<{', '.join(p.strip().replace(' ', ': ', 1) for p in s.split(', '))}>" for name, s in schemas.ALL.items() if name != "files")


def facts(scan: DataFrame) -> DataFrame:
    """A tagged row for each fact in the scanned files: table, and one struct
    column for each table. Persist it and split with ``table_of``."""
    names = [n for n in schemas.ALL if n != "files"]

    def run(batches):
        for pdf in batches:
            found = [r for path, source in zip(pdf["file_path"], pdf["content"]) for r in extract(path, source)]
            yield pd.DataFrame({"table": [t for t, _ in found], **{n: [row if t == n else None for t, row in found] for n in names}})

    return scan.select("file_path", "content").mapInPandas(run, "table string, " + _TAGGED)


def table_of(tagged: DataFrame, name: str) -> DataFrame:
    return tagged.where(F.col("table") == name).select(f"{name}.*")


def counted_dependencies(dependencies: DataFrame) -> DataFrame:
    """Edges counted by source, target and kind, with the first line."""
    by = ["source_uid", "target_external", "dependency_kind"]
    return dependencies.groupBy(*by).agg(F.count("*").alias("usage_count"), F.min("line").alias("first_line"), F.first("resolution").alias("resolution"), F.max("confidence").alias("confidence"))


def resolved(dependencies: DataFrame, symbols: DataFrame) -> DataFrame:
    """target_uid of edges by uid pattern, exact qualified name, unique name in the
    file, longest module prefix, unique name anywhere: the first that answers
    (J19-J23), set-based once all symbols exist (H4)."""
    from ..operators import joins as J

    deps = dependencies.withColumn("edge", F.sha2(F.concat_ws("|", "source_uid", "target_external", "dependency_kind"), 256))
    tail = F.substring_index("target_external", ".", -1)
    own = deps.select("edge", "file_path", "target_external", tail.alias("name"), "dependency_kind").distinct()
    target = F.col("symbol_uid").alias("target_uid")
    by_uid = own.where(F.col("target_external").rlike("^([0-9a-f]{16}|[0-9a-f]{32})$")).join(symbols.select(F.col("symbol_uid").alias("target_external"), target), "target_external")
    full = J.unique_names(symbols, ["qualified_name"], "symbol_uid").select(F.col("qualified_name").alias("target_external"), target)
    local = J.unique_names(symbols.where("kind != 'module'"), ["file_path", "name"], "symbol_uid").select("file_path", "name", target)
    modules = symbols.where("kind = 'module'").select("qualified_name", "symbol_uid")
    imports = own.where("dependency_kind = 'imports'").select("edge", "target_external")
    prefix = J.longest_prefix(imports, "target_external", modules, "qualified_name", "symbol_uid", ".", 6).where("symbol_uid IS NOT NULL").select("edge", target)
    anywhere = J.unique_names(symbols.where("kind != 'module'"), ["name"], "symbol_uid").select("name", target)
    calls = own.where("dependency_kind != 'imports'")
    rules = [
        ("uid", by_uid), ("qualified_name", own.join(full, "target_external")), ("same_file", calls.join(local, ["file_path", "name"])), ("module_prefix", prefix), ("unique_name", calls.join(anywhere, "name")),
    ]
    return J.cascade(deps, "edge", rules, "target_uid").drop("edge")
