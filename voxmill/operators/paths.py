"""File names, experiment names and label keys, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of more than one part, longest first.
SUFFIXES = (".nii.gz", ".tar.gz", ".nii", ".mha", ".npz", ".npy", ".json", ".csv", ".txt")


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.regexp_extract(path, r"([^/]*)$", 1)


def split_suffix(name: Column) -> Column:
    """``(stem, suffix)``, where a suffix may have two parts."""
    pattern = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.struct(F.regexp_extract(name, rf"^(.*?)({pattern}|\.[^.]*|)$", 1).alias("stem"), F.regexp_extract(name, rf"^(.*?)({pattern}|\.[^.]*|)$", 2).alias("suffix"))


def with_mha(name: Column) -> Column:
    """``name`` with the suffix ``.mha``; an error if it has another one of three letters or is too short to have a name."""
    other = (F.length(name) < 4) | name.rlike(r"\.[A-Za-z0-9]{3}$")
    return F.when(name.endswith(".mha"), name).when(other, F.raise_error(F.concat(F.lit("bad file name: "), name))).otherwise(F.concat(name, F.lit(".mha")))


def ground_truth_name(name: Column) -> Column:
    """Name of the truth that belongs to an input image: without ``.mha``, ``.nii.gz`` and the channel ``_0000``, ending in ``.mha``.

    A ``.mha`` name without a channel stays as it is.
    """
    stem = F.regexp_replace(F.regexp_replace(name, r"\.(mha|nii\.gz|nii)$", ""), r"_0000$", "")
    return F.when(name.endswith(".mha") & ~name.rlike(r"_0000\.mha$"), name).otherwise(F.concat(stem, F.lit(".mha")))


def case_and_index(name: Column) -> Column:
    """``(base, idx)``: a trailing ``_<digits>`` before the suffix is the index; -1 without one."""
    stem = split_suffix(base_name(name))["stem"]
    digits = F.regexp_extract(stem, r"_(\d+)$", 1)
    return F.struct(F.when(digits != "", F.regexp_replace(stem, r"_\d+$", "")).otherwise(stem).alias("base"), F.when(digits != "", digits.cast("int")).otherwise(-1).alias("idx"))


def drop_last_token(stem: Column) -> Column:
    """``stem`` without its last ``_`` and what follows."""
    return F.regexp_replace(stem, r"_[^_]*$", "")


def experiment_id(trainer: Column, plans: Column, config: Column) -> Column:
    """``trainer__plans__config``."""
    return F.concat_ws("__", trainer, plans, config)


def parse_experiment_id(name: Column) -> Column:
    """``(trainer, plans, config)`` of such a name."""
    parts = F.split(name, "__")
    return F.struct(*[F.get(parts, F.lit(k)).alias(c) for k, c in enumerate(("trainer", "plans", "config"))])


def parse_experiment_path(path: Column) -> Column:
    """``(dataset, trainer, plans, config, fold)`` of ``.../dataset/trainer__plans__config[/fold_k][/...]``; parts that lack are empty."""
    pattern = r"(?:^|/)(Dataset\d{3}_[^/]*)/([^/]+?)__([^/]+?)__([^/]+?)(?:/fold_([^/]+))?(?:/|$)"
    return F.struct(*[F.regexp_extract(path, pattern, k + 1).alias(c) for k, c in enumerate(("dataset", "trainer", "plans", "config", "fold"))])


def ensemble_name(a: Column, b: Column, folds: Column) -> Column:
    """``ensemble___a___b___folds``."""
    return F.concat_ws("___", F.lit("ensemble"), a, b, folds)


def parse_ensemble_name(name: Column) -> Column:
    """``(model1, model2, folds)`` of such a name."""
    parts = F.split(name, "___")
    return F.struct(*[F.get(parts, F.lit(k + 1)).alias(c) for k, c in enumerate(("model1", "model2", "folds"))])


def folds_to_string(folds: Column) -> Column:
    """``0_1_2`` of an array of folds."""
    return F.array_join(F.transform(folds, lambda f: f.cast("string")), "_")


def folds_of_string(text: Column) -> Column:
    """The integer folds of such a string, in order; other parts are null."""
    return F.transform(F.split(text, "_"), lambda f: f.try_cast("int"))


def dataset_id(name: Column) -> Column:
    """The number in ``Dataset123_Name``."""
    return F.substring(name, 8, 3).try_cast("int")


def dataset_prefix(number: Column) -> Column:
    """``Dataset`` and the number in three digits."""
    return F.concat(F.lit("Dataset"), F.lpad(number.cast("string"), 3, "0"))


def label_key(labels: Column) -> Column:
    """Text of a label or, in brackets, of a region."""
    inner = F.array_join(F.transform(labels, lambda x: x.cast("string")), ", ")
    return F.when(F.size(labels) == 1, inner).otherwise(F.concat(F.lit("("), inner, F.lit(")")))


def labels_of_key(key: Column) -> Column:
    """The labels of such a text."""
    return F.transform(F.split(F.regexp_replace(key, r"[()\s]", ""), ","), lambda x: x.try_cast("int"))


def hex_to_rgb(code: Column) -> Column:
    """Red, green and blue of ``#rrggbb``."""
    return F.array(*[F.conv(F.substring(F.ltrim(code, F.lit("#")), 2 * k + 1, 2), 16, 10).cast("int") for k in range(3)])
