"""Field and source names from raw identifiers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words a name may not be. Names that equal one of them (in any case)
# are quoted, and get the suffix ``_val`` when they would become a field name.
RESERVED_WORDS = tuple("""
year date time timestamp name type value key
order group by limit offset count sum avg min max
select from where join on and or not in is null
true false all any as asc desc having union except
intersect case when then else end between like index
primary foreign references default check unique constraint
create table drop alter add column delete insert update
set values into distinct top percent with over partition
row rows range unbounded preceding following current first
last nulls rank dense_rank row_number lead lag ntile
language code level action position match data result
number hours minutes cast round state block person
people student club events staff actor day month week
second minute hour quarter
""".split())

# Bookkeeping tables of the database itself.
INTERNAL_TABLES = ("sqlite_sequence", "sqlite_stat1")


def is_reserved(name: Column) -> Column:
    return F.lower(name).isin(*RESERVED_WORDS)


def _tidy(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_|_$", "")


def _bare(name: Column) -> Column:
    plain = F.translate(F.regexp_replace(name, r"\([^)]*\)", ""), " -./\\'", "_____")
    return F.regexp_replace(plain, "[^a-zA-Z0-9_]", "")


def clean_identifier(name: Column) -> Column:
    """Letters, digits and single underscores only; parenthesised parts and quotes vanish."""
    return _tidy(_bare(name))


def snake_case(name: Column, mode: str = "compat") -> Column:
    """``compat`` splits before every capital (``GNPOld`` -> ``g_n_p_old``), ``acronym`` keeps
    runs of capitals together (``gnp_old``)."""
    bare = _bare(name)
    if mode == "compat":
        split = F.regexp_replace(bare, "([A-Z])", "_$1")
    elif mode == "acronym":
        split = F.regexp_replace(F.regexp_replace(bare, "([A-Z]+)([A-Z][a-z])", "$1_$2"), "([a-z0-9])([A-Z])", "$1_$2")
    else:
        raise ValueError("mode is compat or acronym")
    snake = _tidy(F.lower(split))
    # One chain of replacements: a condition on the name, repeated in a filter, would compute the name once per mention.
    safe = F.regexp_replace(snake, rf"^({'|'.join(RESERVED_WORDS)})$", "$1_val")
    return F.regexp_replace(safe, "^(?=[0-9]|$)", "col_")


def source_name(table: Column, mode: str = "compat") -> Column:
    return snake_case(table, mode)


def needs_quoting(name: Column) -> Column:
    return name.rlike(r"[()\[\] \-/%]") | name.rlike(r"(?U)^[^\p{Alpha}_]") | is_reserved(name)


def quote_if_needed(name: Column) -> Column:
    return F.when(needs_quoting(name), F.concat(F.lit("`"), F.replace(name, F.lit("`"), F.lit("``")), F.lit("`"))).otherwise(name)
