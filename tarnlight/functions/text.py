"""Text scalars as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from tarnlight.functions import fixed as X


def _any_word(words) -> str:
    return r"\b(" + "|".join(words) + r")\b"


def _i(pattern: str) -> str:
    return "(?i)" + pattern


MATERIAL_WORD, COLOR_WORD = _i(_any_word(X.MATERIALS)), _i(_any_word(X.COLORS))
SIZE_WORD = _i(r"\b(" + "|".join(X.SIZE_WORDS) + r"|size\s*\w+)\b")
STYLE_WORD, USE_CASE_WORD = _i(_any_word(X.STYLE_WORDS)), _i(_any_word(X.USE_CASE_WORDS))
VOCABULARY = {"material": MATERIAL_WORD, "color": COLOR_WORD, "size": SIZE_WORD, "style": STYLE_WORD, "use_case": USE_CASE_WORD}
BUDGET_ANY = _i("|".join(X.BUDGET))


def normalize_phrase(c: Column) -> Column:
    """Lower case, every run of other than a-z and 0-9 one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def strip_chars(c: Column, chars: str) -> Column:
    return F.trim(c, F.lit(chars))


def searchable(*fields: Column) -> Column:
    """Fields joined by a space; an empty or null field still adds its space."""
    return F.trim(F.concat_ws(" ", *(F.coalesce(f, F.lit("")) for f in fields)))


def flatten_pairs(pairs: Column) -> Column:
    """array<struct<k,v>> as "k v k v"."""
    return F.concat_ws(" ", F.transform(pairs, lambda e: F.concat_ws(" ", e["k"], e["v"])))


def terms(c: Column, limit: int | None = None) -> Column:
    """Distinct words of two characters or more that are no stopwords, in order of appearance."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))
    stop = F.array(*(F.lit(w) for w in X.STOPWORDS))
    kept = F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~F.array_contains(stop, w)))
    return F.slice(kept, 1, limit) if limit else kept


def breadcrumb_tail(categories: Column) -> Column:
    """The last two parts, split at commas, that are not generic; "clothing item" if there are none."""
    parts = F.flatten(F.transform(categories, lambda c: F.split(c, ",")))
    parts = F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: (p != "") & ~F.lower(p).isin(*X.GENERIC_BREADCRUMBS))
    parts = F.coalesce(parts, F.array().cast("array<string>"))
    last = F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2)
    return F.when(F.size(parts) == 0, X.DEFAULT_SHELF).otherwise(F.array_join(last, " "))


def primary_attribute(c: Column, kind: str) -> Column:
    """First material or color word, lower-case; '' if there is none."""
    words = X.PRIMARY_MATERIALS if kind == "material" else X.PRIMARY_COLORS
    return F.lower(F.regexp_extract(c, _i(_any_word(words)), 1))


def attribute_of_text(c: Column) -> Column:
    low = F.lower(c)
    return (
        F.when(low.rlike(BUDGET_ANY) | low.contains("budget"), "budget").when(low.rlike(MATERIAL_WORD), "material")
        .when(low.rlike(COLOR_WORD) | low.startswith("color:"), "color").when(low.rlike(SIZE_WORD), "size")
        .when(low.rlike(STYLE_WORD), "style").when(low.rlike(USE_CASE_WORD), "use_case").otherwise("feature")
    )


def attribute_of_key(key: Column) -> Column:
    """By the first hint that the key contains; null if none."""
    out = F.lit(None).cast("string")
    for attribute, hints in reversed(X.KEY_HINTS):
        out = F.when(reduce(lambda a, b: a | b, (key.contains(h) for h in hints)), attribute).otherwise(out)
    return out


def classify_phrase(c: Column) -> tuple[Column, Column]:
    """Attribute and value of a phrase; of "Key: Value" the key decides if it is known."""
    text = strip_chars(c, " \t\n\r")
    keyed = text.rlike(X.KEY_VALUE)
    key = F.lower(F.trim(F.regexp_extract(text, X.KEY_VALUE, 1)))
    value = F.when(keyed, F.trim(F.regexp_extract(text, X.KEY_VALUE, 2))).otherwise(c)
    return F.coalesce(F.when(keyed, attribute_of_key(key)), attribute_of_text(value)), value


def budget_max(c: Column) -> Column:
    """The first amount after a dollar sign, "budget" or "under"; else the first number; else null."""
    hit = F.regexp_extract(c, BUDGET_ANY, 0)
    amount = F.regexp_extract(hit, r"(\d+(?:\.\d+)?)$", 1)
    bare = F.regexp_extract(c, X.BARE_NUMBER, 1)
    return F.coalesce(F.nullif(amount, F.lit("")), F.nullif(bare, F.lit(""))).try_cast("double")


def bare_attribute(c: Column) -> tuple[Column, Column]:
    """Kind (color or material) and value of a one-word requirement; nulls for anything else."""
    text = F.trim(c)
    key, value = (F.lower(F.regexp_extract(text, _i(X.BARE_ATTRIBUTE), k)) for k in (1, 2))
    kind = (
        F.when(value.isin(*X.PRIMARY_COLORS) & key.isin("color", "colour", ""), "color")
        .when(value.isin(*X.PRIMARY_MATERIALS) & key.isin("material", "fabric", ""), "material")
    )
    return kind, F.when(kind.isNotNull(), value)


def no_preference(c: Column) -> Column:
    """The attribute that a message has no preference for, "other" if unknown; null without such a phrase."""
    word = F.lower(F.regexp_extract(c, _i(X.NO_PREFERENCE), 1))
    return F.when(word == "", None).when(word.isin(*X.ATTRIBUTES), word).otherwise("other")


def has_cue(c: Column, pattern: str) -> Column:
    return c.rlike(_i(pattern))


def split_requirements(c: Column) -> Column:
    """Parts at semicolons, without lead-ins and end punctuation; with several parts the whole comes first."""
    clean = lambda x: strip_chars(F.regexp_replace(strip_chars(x, " \t\n\r"), _i(X.LEAD_IN), ""), " \t\n.,;:")
    parts = F.filter(F.transform(F.split(c, r"\s*;\s*"), clean), lambda p: F.length(p) >= 2)
    whole = clean(c)
    return F.when((F.size(parts) > 1) & (F.length(whole) >= 2), F.array_prepend(parts, whole)).otherwise(parts)


def constraint_class(c: Column) -> Column:
    """The simulator's classifier: by substrings, other than attribute_of_text."""
    low = F.lower(c)
    out = F.lit("feature")
    for attribute, words in reversed(X.SIMULATOR_HINTS):
        out = F.when(reduce(lambda a, b: a | b, (low.contains(w) for w in words)), attribute).otherwise(out)
    return F.when(low.contains("budget") | low.rlike(X.SIMULATOR_BUDGET), "budget").otherwise(out)


def clean_constraint(c: Column, limit: int = 180) -> Column:
    return F.rtrim(F.substring(strip_chars(F.regexp_replace(c, r"\s+", " "), " -;,.\t\n"), 1, limit))


def singular(word: Column) -> Column:
    return (
        F.when(word.isin(*X.PLURAL_ONLY), word)
        .when(word.endswith("ies") & (F.length(word) > 4), F.concat(F.substring(word, F.lit(1), F.length(word) - 3), F.lit("y")))
        .when(word.rlike("(ches|shes|sses|xes|zes)$"), F.substring(word, F.lit(1), F.length(word) - 2))
        .when(word.endswith("s") & ~word.endswith("ss"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)
    )
