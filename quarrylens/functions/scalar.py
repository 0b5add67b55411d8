"""Scalar expressions and the few functions Spark has no built-in for (2.16)."""

from __future__ import annotations

import difflib
import hashlib
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..values import SOURCE_WORDS


def uid(*parts) -> Column:
    """16 hexadecimal digits from the parts' names."""
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16)


def jaccard(a, b, empty: float | None = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets (C12). Conventions for two empty
    sets differ by caller: 1, 0 or unknown (null)."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(F.array_union(a, b))
    return F.when(total == 0, F.lit(empty).cast("double")).otherwise(both / total)


def module_name(path) -> Column:
    """Dotted module name of a path."""
    name = F.regexp_replace(F.regexp_replace(path, r"\\", "/"), r"\.py$", "")
    return F.regexp_replace(F.regexp_replace(name, r"/__init__$", ""), "/", ".")


def name_tokens(name) -> Column:
    """Tokens of a snake-case or camel-case name, lower-cased (C20): a part of the
    name without any gives itself."""
    parts = F.filter(F.split(name, "_"), lambda p: p != "")
    humps = lambda p: F.regexp_extract_all(p, F.lit(r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)|\d+"), F.lit(0))
    return F.transform(F.flatten(F.transform(parts, lambda p: F.when(F.size(humps(p)) > 0, humps(p)).otherwise(F.array(p)))), F.lower)


def signature_parts(signature) -> tuple[Column, Column]:
    """Parameters and return type written in a signature; none without brackets."""
    inside = F.when(signature.contains("(") & signature.contains(")"), F.substring_index(F.substring(signature, F.instr(signature, "(") + 1, F.length(signature)), ")", 1))
    params = F.filter(F.transform(F.split(F.coalesce(inside, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    back = F.when(inside.isNotNull() & signature.contains("->"), F.trim(F.substring_index(signature, "->", -1))).otherwise("")
    return params, back


def words_of_name(name) -> Column:
    """Words of a snake-case or camel-case name, lower-cased first (so camel
    humps are not seen), as the similarity of names has it."""
    return F.filter(F.split(F.lower(name), "[^a-z0-9]+"), lambda x: x != "")


def literal_class(value) -> Column:
    """Pattern class of a literal; the first that fits."""
    return (
        F.when(value.rlike(r"^https?://"), "url")
        .when(value.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), "email")
        .when(value.rlike(r"[/\\]"), "path")
        .when(value.rlike(r"^v?\d+(\.\d+)+"), "version")
        .when(F.lower(value).isin("true", "false"), "boolean")
        .when(value.rlike(r"^[A-Z][A-Z0-9_]*$"), "constant")
        .when(F.length(value) > 50, "long")
        .otherwise("short")
    )


def numeric_similarity(a, b) -> Column:
    """One less the difference's share of the larger."""
    most = F.greatest(F.abs(a), F.abs(b))
    return F.when(most == 0, 1.0).otherwise(1.0 - F.abs(a - b) / most)


def clamp(x) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def half_even(x, digits: int) -> Column:
    """Rounding as in Python."""
    return F.bround(x, digits)


def signature_arity(signature) -> Column:
    """Parameters named in a signature's outer brackets."""
    inside = F.trim(F.regexp_extract(signature, r"\((.*?)\)", 1))
    return F.when(inside == "", 0).otherwise(F.size(F.split(inside, ",")))


@F.pandas_udf(T.StringType())
def blake2b_64(text: pd.Series) -> pd.Series:
    """BLAKE2b digest of eight bytes in hexadecimal digits."""
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=8).hexdigest())


@F.pandas_udf(T.StringType())
def blake2b_128(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else hashlib.blake2b(x.encode(), digest_size=16).hexdigest())


@F.pandas_udf(T.DoubleType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two texts (C20)."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def fuzzy_literals(a: pd.Series, b: pd.Series) -> pd.Series:
    """Mean best ratio over up to five telling literals of each side, in order,
    200 characters of each (C21): of five characters or more, or with a sign of
    a pattern."""
    telling = lambda v: [t[:200] for t in sorted({str(u) for u in (v if v is not None else ())}) if len(t) >= 5 or any(c in t for c in "[]()*+?^$|")][:5]

    def one(x, y):
        x, y = telling(x), telling(y)
        if not x or not y:
            return 0.0
        return sum(max(difflib.SequenceMatcher(None, u, v).ratio() for v in y) for u in x) / len(x)

    return pd.Series([one(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.DoubleType())
def mean_name_ratio(names: pd.Series) -> pd.Series:
    """Mean matching-blocks ratio over all pairs of a cluster's names (C24, P6);
    1 for fewer than two. A cluster is bounded, so its pairs are."""

    def one(found):
        low = sorted(str(n).lower() for n in (found if found is not None else ()))
        ratios = [difflib.SequenceMatcher(None, low[i], low[j]).ratio() for i in range(len(low)) for j in range(i + 1, len(low))]
        return sum(ratios) / len(ratios) if ratios else 1.0

    return names.map(one)


_STRING, _NUMBER, _WORD = re.compile(r"""["'].*?["']"""), re.compile(r"\b\d+\.?\d*\b"), re.compile(r"\b[a-zA-Z_][a-zA-Z0-9_]*\b")
_PIECE = re.compile(r"\w+|[^\w\s]")
_KEPT = frozenset(SOURCE_WORDS)


def _normal(text: str) -> str:
    seen: dict[str, str] = {}
    mark = lambda m: m[0] if m[0] in _KEPT else seen.setdefault(m[0], f"VAR_{len(seen)}")
    return _WORD.sub(mark, _NUMBER.sub("NUMBER_LITERAL", _STRING.sub("STRING_LITERAL", text)))


def _blake(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def _winnow(text: str, k: int = 3, window: int = 4) -> str:
    pieces = _PIECE.findall(text)
    if len(pieces) < k:
        return _blake("".join(pieces))
    grams = ["".join(pieces[i : i + k]) for i in range(len(pieces) - k + 1)]
    if len(grams) > window:
        hashed = [(_blake(g), g) for g in grams]
        grams = [min(hashed[i : i + window], key=lambda h: h[0])[1] for i in range(len(hashed) - window + 1)]
    return _blake("".join(sorted(set(grams))))


@F.pandas_udf(T.StringType())
def normalised_source(source: pd.Series) -> pd.Series:
    """Literals and numbers as marks, other words numbered as they first stand."""
    return source.map(lambda x: None if x is None else _normal(x))


@F.pandas_udf(T.StructType([T.StructField(c, T.StringType()) for c in ("exact", "structural", "normalized")]))
def dedup_fingerprints(source: pd.Series, structure: pd.Series) -> pd.DataFrame:
    """The three fingerprints of a block (X13): of its tokens' winnowed k-grams, of
    its structure (C9), of its normalised text."""
    one = lambda f: lambda x: None if x is None else f(x)
    return pd.DataFrame({"exact": source.map(one(_winnow)), "structural": structure.map(one(_blake)), "normalized": source.map(one(lambda x: _blake(_normal(x))))})


def code_lines(source) -> Column:
    """Lines of a source that are neither blank nor comments."""
    return F.size(F.filter(F.transform(F.split(source, "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: (x != "") & ~x.startswith("#")))


def unknown_tables(source, known: tuple[str, ...]) -> Column:
    """Tables that statements in a source read or write and the schema lacks (D9), sorted."""
    named = F.regexp_extract_all(source, F.lit(r"(?i)\b(?:FROM|JOIN|INTO|UPDATE)\s+([A-Za-z_][A-Za-z0-9_]*)"), F.lit(1))
    return F.sort_array(F.array_distinct(F.filter(F.transform(named, F.lower), lambda x: ~x.isin(*known))))
