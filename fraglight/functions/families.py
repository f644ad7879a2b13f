"""Node kinds and their families: a small dimension, and what is asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of each family.
FAMILIES = {
    "Literal": [
        "boolean_literal", "char_literal", "float_literal", "integer_literal", "raw_string_literal", "string_literal",
    ],
    "Expr": [
        "boolean_literal", "char_literal", "float_literal", "integer_literal", "raw_string_literal", "string_literal", "array_expression",
        "assignment_expression", "async_block", "await_expression", "binary_expression", "block", "break_expression", "call_expression",
        "closure_expression", "compound_assignment_expr", "const_block", "continue_expression", "field_expression", "for_expression",
        "gen_block", "generic_function", "identifier", "if_expression", "index_expression", "loop_expression", "macro_invocation",
        "match_expression", "metavariable", "parenthesized_expression", "range_expression", "reference_expression", "return_expression",
        "scoped_identifier", "self", "struct_expression", "try_block", "try_expression", "tuple_expression", "type_cast_expression",
        "unary_expression", "unit_expression", "unsafe_block", "while_expression", "yield_expression",
    ],
    "Pattern": [
        "boolean_literal", "char_literal", "float_literal", "integer_literal", "raw_string_literal", "string_literal", "_",
        "captured_pattern", "const_block", "generic_pattern", "identifier", "macro_invocation", "mut_pattern", "or_pattern",
        "range_pattern", "ref_pattern", "reference_pattern", "remaining_field_pattern", "scoped_identifier", "slice_pattern",
        "struct_pattern", "tuple_pattern", "tuple_struct_pattern",
    ],
    "Type": [
        "abstract_type", "array_type", "bounded_type", "dynamic_type", "function_type", "generic_type", "macro_invocation", "metavariable",
        "never_type", "pointer_type", "primitive_type", "reference_type", "removed_trait_bound", "scoped_type_identifier", "tuple_type",
        "type_identifier", "unit_type",
    ],
    "TokenTree": [
        "boolean_literal", "char_literal", "float_literal", "integer_literal", "raw_string_literal", "string_literal", "crate",
        "identifier", "metavariable", "mutable_specifier", "primitive_type", "self", "super", "token_repetition", "token_tree",
    ],
    "TokenTreePattern": [
        "boolean_literal", "char_literal", "float_literal", "integer_literal", "raw_string_literal", "string_literal", "crate",
        "identifier", "metavariable", "mutable_specifier", "primitive_type", "self", "token_binding_pattern", "token_repetition_pattern",
        "token_tree_pattern",
    ],
    "DeclStmt": [
        "associated_type", "attribute_item", "const_item", "empty_statement", "enum_item", "extern_crate_declaration", "foreign_mod_item",
        "function_item", "function_signature_item", "impl_item", "inner_attribute_item", "let_declaration", "macro_definition",
        "macro_invocation", "mod_item", "static_item", "struct_item", "trait_item", "type_item", "union_item", "use_declaration",
    ],
}
ROWS = [(kind, family, n) for n, (family, kinds) in enumerate(FAMILIES.items()) for kind in kinds]


def kind_family(spark: SparkSession) -> DataFrame:
    """(kind, family, ord): 142 rows, so it is broadcast."""
    return F.broadcast(spark.createDataFrame(ROWS, "kind string, family string, ord int"))


def families_of(kind: Column) -> Column:
    """Families of a kind in their order; an empty list for an unknown or null one."""
    held: dict[str, list[str]] = {}
    for k, family, _ in ROWS:
        held.setdefault(k, []).append(family)
    table = F.create_map(*(x for k, v in held.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return F.coalesce(table[kind], F.array().cast("array<string>"))


def buckets_of(kind: Column) -> Column:
    """Families of a kind, else its own name, else the empty name."""
    own = families_of(kind)
    return F.when(kind.isNull(), F.array(F.lit(""))).when(F.size(own) > 0, own).otherwise(F.array(kind))


def families_with_parent(kind: Column, parent: Column) -> Column:
    """A kind with one family keeps it; else what it shares with its parent; where only one of them is known, that one's."""
    a, b = families_of(kind), families_of(parent)
    return F.when(F.size(a) == 1, a).when((F.size(a) > 0) & (F.size(b) > 0), F.array_intersect(a, b)).when(F.size(a) > 0, a).otherwise(b)


def compatible(a: Column, b: Column) -> Column:
    """Whether two kinds share a family; kinds without one are compatible if they are equal."""
    return F.arrays_overlap(buckets_of(a), buckets_of(b))


def members_of(kind: Column) -> Column:
    """The kinds of all families of a kind, those in several of them as often, and the kind itself unless it is null or empty."""
    table = F.create_map(*(x for k, v in FAMILIES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    held = F.flatten(F.transform(families_of(kind), lambda f: table[f]))
    return F.when(F.coalesce(kind, F.lit("")) != "", F.array_append(held, kind)).otherwise(held)


def union_buckets(kinds: Column) -> Column:
    """The buckets of any of some kinds."""
    return F.array_distinct(F.flatten(F.transform(F.filter(kinds, lambda k: k.isNotNull()), buckets_of)))


def values_sql() -> str:
    """The dimension as an SQL VALUES list."""
    return ", ".join(f"('{k}', '{f}', {n})" for k, f, n in ROWS)
