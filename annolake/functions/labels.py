"""Label, path and scalar clean-up columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The first of these keys that holds something gives a record's label.
LABEL_KEYS = ("label", "category_name", "category", "class_name", "name", "phrase")


def normalize_label(c: Column) -> Column:
    """Lower case, trimmed, underscores and runs of white space to one space."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "_", " "), r"\s+", " "))


def word_spans(c: Column, longest: int | None = None) -> Column:
    """All contiguous word n-grams of a label, by start, then length."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    n = F.size(words)
    most = n if longest is None else F.least(n, F.lit(longest))
    starts = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.greatest(F.least(most, n - i + 1), F.lit(1))), lambda k: F.array_join(F.slice(words, i, k), " "))))


def standard_category(phrase: Column, mapping: dict[str, str], vocabulary: list[str]) -> Column:
    """Explicit map, else the phrase itself, else its first word in the vocabulary, else the longest (then first) entry it contains, else its first word."""
    p = normalize_label(phrase)
    words = F.split(p, " ")
    known = F.array(*map(F.lit, vocabulary))
    by_length = F.array(*map(F.lit, sorted(vocabulary, key=lambda v: (-len(v), v))))
    table = F.create_map(*(F.lit(x) for kv in mapping.items() for x in kv)) if mapping else None
    return F.coalesce(
        *([F.element_at(table, p)] if mapping else []),
        F.when(F.array_contains(known, p), p),
        F.get(F.filter(words, lambda w: F.array_contains(known, w)), 0),
        F.get(F.filter(by_length, lambda v: F.contains(p, v)), 0),
        F.get(words, 0),
    )


def in_prompt(label: Column, prompt: str) -> Column:
    """Case-insensitive membership in a prompt whose entries end with a full stop."""
    return F.lower(F.trim(label)).isin([x.strip().lower() for x in prompt.split(".") if x.strip()])


def resolve_label(*candidates: Column) -> Column:
    """The first candidate that is not empty, lower-cased and trimmed."""
    return F.lower(F.trim(F.coalesce(*(F.when(F.trim(c) != "", c) for c in candidates))))


def unwrap_scalar(raw: Column) -> Column:
    """[[0.9]], [0.9] and 0.9 to a double; nothing inside gives 0."""
    inner = F.regexp_extract(raw, r"-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?", 0)
    return F.when(inner == "", 0.0).otherwise(inner.cast("double"))


def path_stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.[^.]*$", "")


def path_extension(path: Column) -> Column:
    return F.regexp_extract(path, r"(\.[^./]*)$", 1)


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9A-Za-z]", "_")


def label_and_index(file_name: Column) -> Column:
    """struct<label, idx> of names such as label_12.ply."""
    stem = path_stem(file_name)
    idx = F.regexp_extract(stem, r"^(.*?)(?:_([0-9]+))?$", 2)
    return F.struct(F.regexp_extract(stem, r"^(.*?)(?:_([0-9]+))?$", 1).alias("label"), F.when(idx != "", idx.cast("int")).alias("idx"))


def infer_split(path: Column, info_split: Column) -> Column:
    """_val or _train in the file's name, else the info record's split, else train."""
    stem = path_stem(path)
    return F.when(F.contains(stem, F.lit("_val")), "val").when(F.contains(stem, F.lit("_train")), "train").otherwise(F.coalesce(info_split, F.lit("train")))
