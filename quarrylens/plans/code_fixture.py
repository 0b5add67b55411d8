"""Facts of a small fixed project: what extraction and resolution give for it is
known row by row, so the SQL of these queries is those rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import decomposition as D
from ..sources import extract
from ..sources.tables import Tables
from . import audit, experts
from .registry import query

FILES = {
    "shop/__init__.py": "",
    "shop/cart.py": '''import json
from .prices import price_of, Rates
from shop import store as db

RATES = Rates()


class Cart(db.Base):
    limit = 10

    def __init__(self, items):
        self.items = items

    @property
    def size(self):
        return len(self.items)

    def parse_total(self, rates=None):
        total = 0
        for item in self.items:
            if item and item.count > 0 or rates:
                while total < 5:
                    total += price_of(item)
        return json.dumps(self.size)

    def parse_total(self):
        return [x for x in self.items if x]


async def load_cart(path):
    cart = Cart([])
    try:
        with open(path) as f:
            cart.items = json.load(f)
    except OSError:
        return None
    return cart
''',
    "shop/prices.py": "class Rates:\n    def get_rate(self):\n        return 1\n\n\ndef price_of(item):\n    def inner():\n        return item\n    return inner() if item else 0\n",
    "shop/store.py": "from .cart import *\n\n\nclass Base:\n    pass\n\n\ndef check_store():\n    return Base(), load_cart('x'), price_of(1)\n",
    "shop/broken.py": "def bad(:\n",
}


class Long(int):
    """A whole number of 64 bits."""


def _rows(*rows: tuple, names: str) -> str:
    """SQL of literal rows; whole numbers of type Long are BIGINT."""

    def text(v):
        if v is None or isinstance(v, bool):
            return "NULL" if v is None else str(v).upper()
        if isinstance(v, (int, float)):
            return f"{v}::DOUBLE" if isinstance(v, float) else f"{int(v)}::BIGINT" if isinstance(v, Long) else str(v)
        return "'" + v.replace("'", "''") + "'"

    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + f") v({names})"


def _tagged(t: Tables) -> DataFrame:
    return extract.facts(t.spark.createDataFrame(list(FILES.items()), "file_path string, content string"))


@query(_rows(
    ("shop", "module", "business_logic", 1, 1, 0, True, False, False), ("shop.cart", "module", "business_logic", 7, 9, 3, True, False, False), ("shop.cart.Cart", "class", "business_logic", 6, 8, 3, True, False, False),
    ("shop.cart.Cart.__init__", "method", "business_logic", 1, 1, 0, False, False, False), ("shop.cart.Cart.size", "method", "business_logic", 1, 1, 0, True, False, True), ("shop.cart.Cart.parse_total", "method", "transformation", 6, 6, 3, True, False, False),
    ("shop.cart.Cart.parse_total", "method", "transformation", 1, 3, 0, True, False, False), ("shop.cart.load_cart", "function", "persistence", 2, 2, 2, True, True, False), ("shop.prices", "module", "business_logic", 1, 2, 0, True, False, False),
    ("shop.prices.Rates", "class", "business_logic", 1, 1, 0, True, False, False), ("shop.prices.Rates.get_rate", "method", "access", 1, 1, 0, True, False, False), ("shop.prices.price_of", "function", "business_logic", 1, 2, 0, True, False, False),
    ("shop.prices.price_of.inner", "function", "business_logic", 1, 1, 0, True, False, False), ("shop.store", "module", "persistence", 1, 1, 0, True, False, False), ("shop.store.Base", "class", "business_logic", 1, 1, 0, True, False, False),
    ("shop.store.check_store", "function", "validation", 1, 1, 0, True, False, False), names="qualified_name, kind, category, complexity, smell_complexity, nesting, is_public, is_async, is_property",
))
def py_symbols(t: Tables) -> DataFrame:
    """X1-X4, X11, X12, M10, S10."""
    s = extract.table_of(_tagged(t), "symbols")
    return s.select("qualified_name", "kind", F.col("semantic_category").alias("category"), F.col("complexity_score").alias("complexity"), F.col("smell_complexity"), F.col("nesting_depth").alias("nesting"), "is_public", "is_async", "is_property")


def _named(t: Tables, table: str) -> DataFrame:
    """Rows of a table with their symbol's qualified name."""
    tagged = _tagged(t)
    names = extract.table_of(tagged, "symbols").select(F.col("symbol_uid"), "qualified_name")
    out = extract.table_of(tagged, table)
    return out.join(names, out["source_uid" if table == "dependencies" else "symbol_uid"] == names["symbol_uid"]).drop(names["symbol_uid"])


@query(_rows(
    ("shop.cart", "json", "imports", "exact", 1), ("shop.cart", "shop.prices.price_of", "imports", "exact", 2), ("shop.cart", "shop.prices.Rates", "imports", "exact", 2), ("shop.cart", "shop.store", "imports", "exact", 3), ("shop.cart", "Rates", "calls", "probable", 5),
    ("shop.cart.Cart", "db.Base", "inherits", "probable", 8), ("shop.cart.Cart.size", "len", "calls", "probable", 16), ("shop.cart.Cart.parse_total", "price_of", "calls", "probable", 23), ("shop.cart.Cart.parse_total", "json.dumps", "calls", "probable", 24),
    ("shop.cart.load_cart", "Cart", "calls", "probable", 31), ("shop.cart.load_cart", "open", "calls", "probable", 33), ("shop.cart.load_cart", "json.load", "calls", "probable", 34), ("shop.prices.price_of", "inner", "calls", "probable", 9),
    ("shop.store", "shop.cart", "imports", "exact", 1), ("shop.store.check_store", "Base", "calls", "probable", 9), ("shop.store.check_store", "load_cart", "calls", "probable", 9), ("shop.store.check_store", "price_of", "calls", "probable", 9),
    names="source, target, dependency_kind, resolution, line",
))
def py_dependencies(t: Tables) -> DataFrame:
    """Imports made absolute, calls of a nested definition are its own."""
    return _named(t, "dependencies").select(F.col("qualified_name").alias("source"), F.col("target_external").alias("target"), "dependency_kind", "resolution", "line")


@query(_rows(
    ("shop.cart.Cart.parse_total", "for", 20, 23, 1), ("shop.cart.Cart.parse_total", "if", 21, 23, 2), ("shop.cart.Cart.parse_total", "while", 22, 23, 3), ("shop.cart.load_cart", "try", 32, 36, 1), ("shop.cart.load_cart", "with", 33, 34, 2),
    names="symbol, block_type, line_start, line_end, nesting_level",
))
def py_blocks(t: Tables) -> DataFrame:
    """X9, F4."""
    return _named(t, "blocks").select(F.col("qualified_name").alias("symbol"), "block_type", "line_start", "line_end", "nesting_level")


@query(_rows(("shop.cart", "type_hint", "RATES", "Rates"), ("shop.cart.load_cart", "type_hint", "cart", "Cart"), ("shop.cart", "alias", "json", "json"), ("shop.cart", "alias", "db", "shop.store"), ("shop.cart", "alias", "price_of", "shop.prices.price_of"), ("shop.cart", "alias", "Rates", "shop.prices.Rates"),
    ("shop.cart.load_cart", "handler", "OSError", "handled"), names="symbol, detail, name, value"))
def py_details(t: Tables) -> DataFrame:
    """Types that assignments tell, names that imports bind, handlers."""
    return _named(t, "details").where("detail IN ('type_hint', 'alias', 'handler')").select(F.col("qualified_name").alias("symbol"), "detail", "name", "value")


@query(_rows(("shop.cart.Cart", "Base", "read", "db"), ("shop.cart.Cart.__init__", "items", "write", "self"), ("shop.cart.Cart.size", "items", "read", "self"), ("shop.cart.Cart.parse_total", "items", "read", "self"), ("shop.cart.Cart.parse_total", "count", "read", "item"), ("shop.cart.Cart.parse_total", "dumps", "read", "json"),
    ("shop.cart.Cart.parse_total", "size", "read", "self"), ("shop.cart.Cart.parse_total", "items", "read", "self"), ("shop.cart.load_cart", "items", "write", "cart"), ("shop.cart.load_cart", "load", "read", "json"), names="symbol, attribute_name, access_type, receiver"))
def py_accesses(t: Tables) -> DataFrame:
    """X7, F6."""
    return _named(t, "attribute_access").select(F.col("qualified_name").alias("symbol"), "attribute_name", "access_type", "receiver")


@query(_rows(("shop/broken.py", "SyntaxError"), names="file_path, error"))
def py_errors(t: Tables) -> DataFrame:
    """A file that does not parse is a row."""
    return extract.table_of(_tagged(t), "errors").select("file_path", F.substring_index("message", ":", 1).alias("error"))


@query(_rows(
    ("json", None, None), ("shop.prices.price_of", "qualified_name", "shop.prices.price_of"), ("shop.prices.Rates", "qualified_name", "shop.prices.Rates"), ("shop.store", "qualified_name", "shop.store"), ("Rates", "unique_name", "shop.prices.Rates"), ("db.Base", "unique_name", "shop.store.Base"),
    ("len", None, None), ("price_of", "unique_name", "shop.prices.price_of"), ("json.dumps", None, None), ("Cart", "same_file", "shop.cart.Cart"), ("open", None, None), ("json.load", None, None), ("inner", "same_file", "shop.prices.price_of.inner"),
    ("shop.cart", "qualified_name", "shop.cart"), ("Base", "same_file", "shop.store.Base"), ("load_cart", "unique_name", "shop.cart.load_cart"), ("price_of", "unique_name", "shop.prices.price_of"), names="name, rule, target",
))
def py_resolved(t: Tables) -> DataFrame:
    """Once all symbols exist."""
    tagged = _tagged(t)
    symbols = extract.table_of(tagged, "symbols")
    out = extract.resolved(extract.table_of(tagged, "dependencies"), symbols)
    names = symbols.select(F.col("symbol_uid").alias("target_uid"), F.col("qualified_name").alias("target"))
    return out.join(names, "target_uid", "left").select(F.col("target_external").alias("name"), "rule", "target")


_BLOCKS = (
    ("b1", "m", "m.py", "Cart", "__init__"), ("b2", "m", "m.py", "Cart", "total"), ("b3", "m", "m.py", None, "helper"), ("b4", "n", "n.py", "Rates", "rate"), ("b5", "n", "n.py", None, "price"), ("b6", "p.q", "p/q.py", None, "price"), ("b7", "p.q", "p/q.py", "Deep", "run"),
    ("b8", "n", "n.py", "Rates", "__init__"), ("b9", "m", "m.py", None, "twice"), ("c1", "m", "m2.py", None, "twice"), ("c2", "n", "n.py", None, "lonely"),
)
# raw, full, class of the caller, receiver's class; what comes of it
_CALLS = (
    ("Cart", "Cart", None, None, "b1", "constructor_same_module"), ("Empty", "Empty", None, None, None, "class_instantiation"), ("Rates", "n.Rates", None, None, "b8", "constructor_imported"), ("Deep", "p.q.Deep", None, None, None, "class_instantiation"),
    ("Path", "pathlib.Path", None, None, None, "external"), ("price", "n.price", None, None, "b5", "exact_qualname"), ("q.Deep.run", "p.q.Deep.run", None, None, "b7", "exact_qualname"), ("x.n.Rates.rate", "n.Rates.rate", None, None, "b4", "exact_qualname"),
    ("self.total", "self.total", "Cart", None, "b2", "same_module"), ("self.gone", "self.gone", "Cart", None, None, "baseclass_method"), ("super().go", "super().go", "Cart", None, None, "baseclass_method"), ("cls", "cls", "Cart", None, "b1", "constructor_same_module"),
    ("Cart.total", "Cart.total", None, None, "b2", "class_method_same_module"), ("r.rate", "r.rate", None, "n.Rates", "b4", "local_type_hint"), ("r.more", "r.more", None, "n.Rates", None, "baseclass_method"), ("d.run", "d.run", None, "Deep", "b7", "local_type_hint"),
    ("e.run", "e.run", None, "pathlib.Path", None, "external"), ("helper", "helper", None, None, "b3", "same_module"), ("twice", "twice", None, None, "b9", "same_module"), ("lonely", "lonely", None, None, "c2", "method_name"), ("price", "price", None, None, None, "ambiguous"),
    ("on_done_callback", "on_done_callback", None, None, None, "dynamic_callback"), ("inner", "inner", None, None, None, "nested_local"), ("given", "given", None, None, None, "dynamic_callback"), ("kept", "kept", None, None, None, "dynamic_callback"),
    ("len", "len", None, None, None, "external"), ("nothing", "nothing", None, None, None, "not_found"), ("obj.attr", "obj.attr", None, None, None, "dynamic_attribute"), ("make_factory", "make_factory", None, None, None, "dynamic_callback"),
)


@query(_rows(*((k, raw, to, how) for k, (raw, _, _, _, to, how) in enumerate(_CALLS)), names="call, raw, target, how"))
def call_resolution(t: Tables) -> DataFrame:
    """Every rule and every reason, the first that decides."""
    spark = t.spark
    names = "block string, module string, file_path string, class_name string, name string"
    blocks = spark.createDataFrame(list(_BLOCKS), names).withColumn("qualified_name", F.concat_ws(".", "module", "class_name", "name"))
    classes = spark.createDataFrame([("m", "Cart"), ("m", "Empty"), ("n", "Rates"), ("p.q", "Deep")], "module string, class_name string")
    rows = [(k, "m", "m.py", cls, raw, full, receiver, receiver == "pathlib.Path", full in ("pathlib.Path", "len"), raw == "obj.attr", False, ["inner"], ["given"], ["kept"]) for k, (raw, full, cls, receiver, _, _) in enumerate(_CALLS)]
    calls = spark.createDataFrame(
        rows, "call int, module string, file_path string, class_name string, raw string, full string, receiver string, receiver_external boolean, external boolean, dynamic boolean, star_import boolean, local_defs array<string>, inputs array<string>, assigned array<string>"
    )
    return D.resolved_calls(calls, blocks, classes).select("call", "raw", "target", "how")


MORE = {
    "app/core.py": '''"""Core."""
import os
import yaml
from app.util import helper

try:
    import ujson
except ImportError:
    ujson = None
DEBUG = True


class Box:
    def __init__(self):
        self.a = 1
        self.b = 2

    def first(self, config, limit: int = 3):
        """First.

        Raises: ValueError
        Returns: a number
        """
        if limit < 0:
            raise ValueError("limit")
        assert config
        self.second()
        return self.a + config["k"] + config.get("k", 0) + config["z"]

    def second(self):
        return helper(self.b, mode="x")


def run(data: list):
    try:
        os.remove("x")
    except OSError:
        return None
    return helper(1, mode="x"), helper(2, mode="y")
''',
    "app/util.py": "def helper(n, mode=None):\n    return n\n",
    "tests/test_core.py": '''from app.core import Box, run


def test_first_empty():
    """Edge."""
    assert Box().first({}) == 1
    assert True


def test_run():
    run([])
''',
}
OLD = {**MORE, "app/util.py": "def helper(n):\n    return n\n\n\ndef gone():\n    pass\n"}


def _audited(t: Tables, files: dict[str, str]) -> tuple:
    """The facts of some files, and their details."""
    scan = t.spark.createDataFrame(list(files.items()), "file_path string, content string")
    tagged = extract.facts(scan)
    rows = scan.select("file_path", F.size(F.split("content", "\n")).alias("lines_of_code"), F.col("file_path").startswith("tests/").alias("is_test_file"))
    table = lambda n: extract.table_of(tagged, n)
    return audit.Audit(rows, table("symbols"), table("blocks"), table("dependencies"), table("attribute_access"), table("errors")), table("details"), scan


def _with_names(a, df: DataFrame, *columns: str) -> DataFrame:
    """Columns of uids replaced by qualified names."""
    for c in columns:
        names = a.symbols.select(F.col("symbol_uid").alias(c), F.col("qualified_name").alias(f"_{c}"))
        df = df.join(names, c, "left").drop(c).withColumnRenamed(f"_{c}", c)
    return df


def _text(column: str):
    """An array as text."""
    return F.array_join(column, ",").alias(column)


@query(_rows(("app.core.Box.first", "app.core.Box.second", 27), names="caller, callee, line"))
def py_internal_calls(t: Tables) -> DataFrame:
    """E1."""
    a, _, _ = _audited(t, MORE)
    return _with_names(a, experts.internal_calls(a).select("caller", "callee", "line"), "caller", "callee")


@query(_rows(("app.core.Box.first", Long(0), Long(1), 1.0), ("app.core.Box.second", Long(1), Long(0), 1.0), names="node, fan_in, fan_out, cohesion_score"))
def py_call_graph(t: Tables) -> DataFrame:
    """A23, P29."""
    a, _, _ = _audited(t, MORE)
    return _with_names(a, experts.call_graph(a).select("node", "fan_in", "fan_out", "cohesion_score"), "node")


@query(_rows(("app/core.py", "app.util.helper", Long(4)), names="file_path, symbol, uses"))
def py_callers(t: Tables) -> DataFrame:
    """An import and three calls."""
    a, _, _ = _audited(t, MORE)
    return experts.callers(a, "app/util.py")


@query(_rows(
    ("app.core.Box.first", "raise", "Raises: ValueError"), ("app.core.Box.first", "return", "Returns: a number"), ("app.core.Box.first", "raise", "ValueError('limit')"), ("app.core.Box.first", "precondition", "config"),
    ("tests.test_core.test_first_empty", "precondition", "Box().first({}) == 1"), ("tests.test_core.test_first_empty", "precondition", "True"), names="symbol_uid, contract, text",
))
def py_contracts(t: Tables) -> DataFrame:
    """E3."""
    a, d, _ = _audited(t, MORE)
    return _with_names(a, experts.contracts(d), "symbol_uid")


@query(_rows(
    ("app/core.py", "app.util.helper", "internal", Long(3), "normal"), ("app/core.py", "os", "standard", Long(1), "normal"), ("app/core.py", "ujson", "third_party", Long(0), "unused"), ("app/core.py", "yaml", "third_party", Long(0), "unused"),
    ("tests/test_core.py", "app.core.Box", "internal", Long(1), "normal"), ("tests/test_core.py", "app.core.run", "internal", Long(1), "normal"), names="file_path, module, kind, uses, level",
))
def py_imports(t: Tables) -> DataFrame:
    """E4, P21."""
    a, _, _ = _audited(t, MORE)
    return experts.imports_classified(a, ("os",)).drop("private_name")


@query(_rows(
    ("app.core.Box.__init__", "a", 0.5, "middle"), ("app.core.Box.__init__", "b", 0.5, "middle"), ("app.core.Box.first", "a", 0.75, "high"), ("app.core.Box.first", "get", 0.75, "high"), ("app.core.Box.first", "second", 0.75, "high"), ("app.core.Box.second", "b", 0.25, "middle"),
    names="symbol_uid, attribute_name, share, band",
))
def py_cohesion_matrix(t: Tables) -> DataFrame:
    """E5, P28."""
    a, _, _ = _audited(t, MORE)
    return _with_names(a, experts.cohesion_matrix(a).select("symbol_uid", "attribute_name", "share", "band"), "symbol_uid")


@query(_rows(("Box", "class", True), ("first", "method", True), ("second", "method", False), ("run", "function", True), ("helper", "function", False), ("test_first_empty", "function", True), ("test_run", "function", True), names="name, kind, tested"))
def py_test_coverage(t: Tables) -> DataFrame:
    """E6, U3, H23."""
    a, _, scan = _audited(t, MORE)
    return experts.test_coverage(a, scan.where("file_path LIKE 'tests/%'")).select("name", "kind", "tested")


@query(_rows(
    ("app.core.Box.first", "typical", None, None), ("app.core.Box.first", "error", "config", "None"), ("app.core.Box.first", "edge", "limit", "0"), ("app.core.Box.first", "edge", "limit", "-1"), ("app.core.Box.first", "error", "limit", "'x'"), ("app.core.run", "typical", None, None),
    ("app.core.run", "edge", "data", "empty"), ("app.core.run", "error", "data", "None"), ("app.util.helper", "typical", None, None), ("app.util.helper", "error", "n", "None"), ("app.util.helper", "error", "mode", "None"), names="symbol_uid, \"case\", parameter, value",
))
def py_test_cases(t: Tables) -> DataFrame:
    """E7."""
    a, d, _ = _audited(t, MORE)
    return _with_names(a, experts.characterisation_cases(d), "symbol_uid")


@query(_rows(("config", "k", Long(2), Long(1), "get,index", 0.5, False), ("config", "z", Long(1), Long(0), "index", 0.0, False), names="name, key, n, safe, methods, safety, critical"))
def py_key_usage(t: Tables) -> DataFrame:
    """E11, A27, P25."""
    _, d, _ = _audited(t, MORE)
    return experts.key_usage(d).drop("file_path").withColumn("methods", F.array_join("methods", ","))


@query(_rows(("app.core.Box.first", "ValueError", None, "moderate"), ("app.core.Box.second", None, None, "safe"), ("app.core.run", None, "OSError", "safe"), ("app.util.helper", None, None, "safe"), ("tests.test_core.test_first_empty", None, None, "safe"), ("tests.test_core.test_run", None, None, "safe"),
    names="qualified_name, raises, handles, safety"))
def py_exceptions(t: Tables) -> DataFrame:
    """E12, P23."""
    a, d, _ = _audited(t, MORE)
    return experts.exception_contracts(a, d).select("qualified_name", _text("raises"), _text("handles"), "safety")


@query(_rows(("app.core.Box.first", "ValueError,self.second,config.get"), ("app.core.Box.second", "helper"), ("app.core.run", "os.remove,helper,helper"), ("tests.test_core.test_first_empty", "Box"), ("tests.test_core.test_run", "run"), names="source_uid, trace"))
def py_traces(t: Tables) -> DataFrame:
    """E13, P27, S17."""
    a, _, _ = _audited(t, MORE)
    return _with_names(a, experts.golden_traces(a).select("source_uid", _text("trace")), "source_uid")


@query(_rows(("app.core.Box.first", "ValueError,second"), ("app.core.Box.second", "helper"), ("app.core.run", "helper"), ("tests.test_core.test_first_empty", "Box"), ("tests.test_core.test_run", "run"), names="source_uid, calls"))
def py_propagation(t: Tables) -> DataFrame:
    """G13."""
    a, _, _ = _audited(t, MORE)
    return _with_names(a, experts.propagation(a).select("source_uid", _text("calls")), "source_uid")


@query(_rows(
    ("ValueError", "0", "'limit'", Long(1)), ("config.get", "0", "'k'", Long(1)), ("config.get", "1", "0", Long(1)), ("helper", "0", "1", Long(1)), ("helper", "0", "2", Long(1)), ("helper", "0", "self.b", Long(1)), ("helper", "mode", "'x'", Long(2)), ("helper", "mode", "'y'", Long(1)),
    ("os.remove", "0", "'x'", Long(1)), ("run", "0", "[]", Long(1)), names="callee, parameter, value, n",
))
def py_arguments(t: Tables) -> DataFrame:
    """A call on what a call gives has no name."""
    _, d, _ = _audited(t, MORE)
    return experts.argument_patterns(d).select("callee", "parameter", "value", "n")


@query(_rows(("DEBUG", Long(1), "flag", "off"), ("DEBUG", Long(1), "flag", "on"), ("ujson", Long(1), "module", "available"), ("ujson", Long(1), "module", "unavailable"), names="name, n_files, kind, scenario"))
def py_optional(t: Tables) -> DataFrame:
    """E14, P24."""
    _, d, _ = _audited(t, MORE)
    return experts.optional_dependencies(d)


@query(_rows(("tests.test_core.test_first_empty", Long(2), Long(56), Long(42), "medium"), ("tests.test_core.test_run", Long(0), Long(15), Long(15), "low"), names="qualified_name, asserts, quality, signal, band"))
def py_test_quality(t: Tables) -> DataFrame:
    """Documented, two assertions, one trivial, an edge case; and one without any."""
    a, d, _ = _audited(t, MORE)
    return experts.test_quality(a, d).select("qualified_name", "asserts", "quality", "signal", "band")


@query(_rows(("app.util.gone", "()", "removed", Long(1), "low"), ("app.util.helper", "(n)", "signature", Long(1), "low"), names="qualified_name, signature, change, n_files, risk"))
def py_compatibility(t: Tables) -> DataFrame:
    """E10, U2, M23, P20."""
    a, _, _ = _audited(t, MORE)
    return experts.compatibility(a, _audited(t, OLD)[0]).drop("file_path")


@query(_rows(("app.core.Box", 19, Long(3), Long(0), Long(1), Long(0), Long(2)), names="qualified_name, lines, method_count, responsibility_count, foreign_accesses, private_accesses, external_dependencies"))
def py_class_metrics(t: Tables) -> DataFrame:
    """P1, M5, M7, M9."""
    a, _, _ = _audited(t, MORE)
    return audit.class_metrics(a).select("qualified_name", "lines", "method_count", "responsibility_count", "foreign_accesses", "private_accesses", "external_dependencies")


@query(_rows(
    ("app.core.Box.__init__", 3, 2, 1, 0, Long(2), Long(0)), ("app.core.Box.first", 11, 6, 2, 1, Long(3), Long(1)), ("app.core.Box.second", 2, 1, 1, 0, Long(1), Long(0)), ("app.core.run", 6, 4, 2, 1, Long(1), Long(1)), ("app.util.helper", 2, 1, 1, 0, Long(0), Long(0)),
    ("tests.test_core.test_first_empty", 4, 3, 1, 0, Long(1), Long(1)), ("tests.test_core.test_run", 2, 1, 1, 0, Long(0), Long(0)), names="qualified_name, lines, statements, complexity, nesting, accesses, external_accesses",
))
def py_method_metrics(t: Tables) -> DataFrame:
    """P1, M3, M4, M6, M10."""
    a, _, _ = _audited(t, MORE)
    return audit.method_metrics(a).select("qualified_name", "lines", "statements", "complexity", "nesting", "accesses", "external_accesses")
