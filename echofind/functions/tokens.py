"""Java lexemes and their abstract categories as column expressions, and a light syntax tree.

The lexeme and category expressions are built-in functions only.  ``syntax`` is the one
pandas user function: it nests lexemes by brackets and statements, which needs a stack.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

# Category numbers and the words and marks that belong to them.
KEYWORD, IDENTIFIER, OPERATOR, LITERAL, MODIFIER, TYPE = 0, 1, 2, 3, 4, 5
SEPARATOR, DECLARATION, EXPRESSION, STATEMENT, ANNOTATION, OTHER = 6, 7, 8, 9, 10, 255
NAMES = {
    KEYWORD: "keyword", IDENTIFIER: "identifier", OPERATOR: "operator", LITERAL: "literal", MODIFIER: "modifier", TYPE: "type",
    SEPARATOR: "separator", DECLARATION: "declaration", EXPRESSION: "expression", STATEMENT: "statement", ANNOTATION: "annotation", OTHER: "other",
}
KEYWORDS = (
    "if else for while do switch case break continue return throw throws try catch finally new this super instanceof "
    "class interface enum extends implements package import assert yield record sealed permits var null"
).split()
MODIFIERS = "public private protected static final abstract synchronized volatile transient native strictfp default open module".split()
TRUTH = ["true", "false"]
SEPARATORS = list("(){}[];,@")

#: Strings, characters, numbers, words, operators (longest first), separators, anything else that is not blank;
#: quantifiers inside literals are possessive, so long ones neither recurse nor backtrack.
JAVA = (
    r"""(?s)"(?:[^"\\\n]++|\\.)*+"?|'(?:[^'\\\n]++|\\.)*+'?|[0-9][0-9A-Za-z_.]*|[\p{L}_$][\p{L}\p{N}_$]*"""
    r"""|>>>=|<<=|>>=|>>>|->|::|\+\+|--|&&|\|\||[-+*/%&|^=!<>]=|<<|>>|\.\.|[-+*/%=<>!&|^~?.]|[(){}\[\];,@]|\S"""
)
HISTOGRAM = 12


def lexemes(source: Column) -> Column:
    return F.regexp_extract_all(source, F.lit(JAVA), F.lit(0))


def category(lexeme: Column) -> Column:
    """The category of a lexeme."""
    first = F.substring(lexeme, 1, 1)
    return (
        F.when(lexeme.isin(MODIFIERS), MODIFIER)
        .when(lexeme.isin(KEYWORDS), KEYWORD)
        .when(lexeme.isin(TRUTH), LITERAL)
        .when(lexeme.isin(SEPARATORS), SEPARATOR)
        .when(first.isin('"', "'") | first.between("0", "9"), LITERAL)
        .when(first.rlike(r"[\p{L}_$]"), IDENTIFIER)
        .when(lexeme.rlike(r"^[-+*/%=<>!&|^~?.:]+$"), OPERATOR)
        .otherwise(OTHER)
    )


def categories(source: Column) -> Column:
    """The abstract token sequence of a text."""
    return F.transform(lexemes(source), category)


def count_categories(tokens: Column, size: int = HISTOGRAM) -> Column:
    """How often each category below ``size`` occurs."""
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda c: F.size(F.filter(tokens, lambda t: t == c)).cast("long"))


def cyclomatic(types: Column) -> Column:
    """One more than the number of keyword and operator nodes."""
    return (F.size(F.filter(types, lambda t: t.isin(KEYWORD, OPERATOR))) + 1).cast("long")


def abstracted(tokens: Column, table: dict[int, int]) -> Column:
    """Tokens through a vocabulary table; what it lacks is ``OTHER``."""
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(known, t), F.lit(OTHER)))


def encoded(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: t.cast("long"))


def bigrams(types: Column, parents: Column) -> Column:
    """Parent and child categories of every node but the root, packed into one number."""
    pairs = F.transform(F.arrays_zip(types.alias("t"), parents.alias("p")), lambda n: F.when(n["p"].isNotNull(), F.element_at(types, n["p"] + 1) * 256 + n["t"]))
    return F.filter(pairs, lambda x: x.isNotNull())


_INTS = ArrayType(IntegerType())
SYNTAX = StructType([StructField(n, _INTS) for n in ("token_ids", "types", "depths", "parents")])
_LEX = re.compile(JAVA.replace(r"\p{L}\p{N}_$", r"\w$").replace(r"\p{L}_$", r"^\W\d"))
_KINDS = {w: KEYWORD for w in KEYWORDS} | {w: MODIFIER for w in MODIFIERS} | dict.fromkeys(TRUTH, LITERAL) | dict.fromkeys(SEPARATORS, SEPARATOR)
_CLOSERS = {"(": ")", "[": "]", "{": "}"}


def kind_of(lexeme: str) -> int:
    if lexeme in _KINDS:
        return _KINDS[lexeme]
    if lexeme[0] in "\"'" or "0" <= lexeme[0] <= "9":
        return LITERAL
    if lexeme[0].isalpha() or lexeme[0] in "_$":
        return IDENTIFIER
    return OPERATOR if all(c in "-+*/%=<>!&|^~?.:" for c in lexeme) else OTHER


def parse(source: str) -> dict[str, list]:
    """A light tree in pre-order: a root, statements, bracket groups and lexemes as leaves."""
    types, depths, parents = [OTHER], [0], [None]
    leaves: list[int] = []
    stack: list[tuple[int, str]] = [(0, "")]  # node, the mark that closes it; "" for the root, ";" for a statement

    def open_node(kind: int, closer: str) -> None:
        types.append(kind)
        depths.append(len(stack))
        parents.append(stack[-1][0])
        stack.append((len(types) - 1, closer))

    for lexeme in _LEX.findall(source):
        if lexeme in ")]}" and any(c == lexeme for _, c in stack):
            while stack[-1][1] != lexeme:
                stack.pop()
        elif stack[-1][1] in ("", "}"):
            open_node(STATEMENT, ";")
        if lexeme in _CLOSERS:
            open_node(STATEMENT if lexeme == "{" else EXPRESSION, _CLOSERS[lexeme])
        kind = kind_of(lexeme)
        types.append(kind)
        depths.append(len(stack))
        parents.append(stack[-1][0])
        leaves.append(kind)
        if lexeme in ")]}" and stack[-1][1] == lexeme:
            stack.pop()
            if lexeme == "}" and stack[-1][1] == ";":
                stack.pop()
        elif lexeme == ";" and stack[-1][1] == ";":
            stack.pop()
    return {"token_ids": leaves, "types": types, "depths": depths, "parents": parents}


def _parsed(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(s or "") for s in source], columns=["token_ids", "types", "depths", "parents"])


def syntax(source: Column) -> Column:
    """The light tree of every text."""
    return F.pandas_udf(_parsed, SYNTAX)(source)
