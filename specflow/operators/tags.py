"""Categorical tags: validation, bins, merging, and the flattening of structured answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Tags and their allowed values, by configuration.
COMMON = {
    "precursor_family": ["urea", "thiourea", "cyanamide", "melamine", "other"],
    "calcination_temperature_bin": ["lt520", "520_560", "560_600", "gt600"],
    "atmosphere_class": ["inert", "N2", "air", "reducing", "etching_reactive", "co2_generated", "unknown"],
    "primary_route": ["direct_thermal", "hydro_solvothermal_pre", "supramolecular_preassembly", "template_assisted", "unknown_or_other"],
    "dopant_class": ["none", "nonmetal", "metal", "codoped_or_multi"],
    "morphology_form": ["bulk", "nanosheets_ultrathin", "porous_holey", "tubular", "3d_macroporous", "unknown"],
}
CONFIGS = {
    "v1_flat": COMMON | {"defect_introduction_mode": ["none_or_baseline", "two_step_overcalcination", "chemical_vapor_etching", "gas_assisted_etching", "dopant_induced"]},
    "v2_staged": COMMON
    | {
        "mod_method": ["none", "re_calcination", "solvothermal", "chemical_etching", "gas_treatment", "wet_impregnation", "ultrasonication", "ball_milling", "plasma_treatment", "other"],
        "mod_atmosphere_class": ["none", "inert", "N2", "air", "reducing", "etching_reactive", "liquid", "vacuum", "unknown"],
    },
}
# What a tag is where its value is none of those, by configuration.
COMMON_DEFAULTS = {
    "precursor_family": "other",
    "calcination_temperature_bin": "520_560",
    "atmosphere_class": "unknown",
    "primary_route": "unknown_or_other",
    "dopant_class": "none",
    "morphology_form": "unknown",
}
DEFAULTS = {
    "v1_flat": COMMON_DEFAULTS | {"defect_introduction_mode": "none_or_baseline"},
    "v2_staged": COMMON_DEFAULTS | {"mod_method": "none", "mod_atmosphere_class": "none"},
}
# Other fields with allowed values, and their defaults, by configuration.
DURATIONS = ["lt2h", "2_4h", "4_8h", "gt8h"]
EXTRA = {
    "v1_flat": {
        "synthesis_method": (["thermal_polymerization", "solvothermal_exfoliation", "supramolecular", "other"], "other"),
        "duration_bin": (DURATIONS, "2_4h"),
    },
    "v2_staged": {
        "backbone_method": (["thermal_polymerization", "solvothermal", "supramolecular", "other"], "other"),
        "backbone_duration_bin": (DURATIONS, "2_4h"),
        "mod_duration_bin": (["none", *DURATIONS], "none"),
    },
}
# Values merged before analysis.
MERGES = {
    "atmosphere_class": {"unknown": "air", "co2_generated": "other_atmosphere"},
    "calcination_temperature_bin": {"560_600": "gt560", "gt600": "gt560"},
    "primary_route": {"template_assisted": "other_route", "unknown_or_other": "other_route"},
    "dopant_class": {"codoped_or_multi": "metal"},
    "morphology_form": {"3d_macroporous": "porous_holey"},
    "mod_atmosphere_class": {"unknown": "air", "vacuum": "other_mod_atm"},
    "mod_method": {"plasma_treatment": "other", "ball_milling": "other"},
}


def available() -> list[str]:
    return sorted(CONFIGS)


def validated(value: Column, allowed: list[str], default: str) -> Column:
    """An allowed value as it is, else the one it equals but for case and space, else the default."""
    by_lower = F.create_map(*(F.lit(x) for v in allowed for x in (v.lower(), v)))
    return F.coalesce(F.when(value.isin(allowed), value), F.element_at(by_lower, F.lower(F.trim(value))), F.lit(default))


def fields(config: str) -> dict[str, tuple[list[str], str]]:
    """Allowed values and default of every tag and every other field of a configuration."""
    if config not in CONFIGS:
        raise ValueError(f"no such configuration: {config}; there are {', '.join(available())}")
    return {t: (allowed, DEFAULTS[config][t]) for t, allowed in CONFIGS[config].items()} | EXTRA[config]


def all_validated(samples: DataFrame, config: str) -> DataFrame:
    """Every field of the configuration, validated; one that ``samples`` lacks has its default. Other columns stay as they are."""
    have = {c.lower() for c in samples.columns}
    return samples.withColumns({t: validated(F.col(t) if t.lower() in have else F.lit(None).cast("string"), allowed, default) for t, (allowed, default) in fields(config).items()})


def temperature_bin(kelvins: Column) -> Column:
    t = kelvins
    return F.when(t.isNull(), None).when(t < 520, "lt520").when(t < 560, "520_560").when(t < 600, "560_600").otherwise("gt600")


def binned(samples: DataFrame) -> DataFrame:
    """By the backbone's temperature if there is such a column, null or not, else by temperature_C; other rows keep theirs."""
    t = F.col("backbone_temperature_C" if "backbone_temperature_C" in samples.columns else "temperature_C")
    return samples.withColumn("calcination_temperature_bin", F.coalesce(temperature_bin(t), F.col("calcination_temperature_bin")))


def file_match(value: Column, files: Column) -> Column:
    """A listed file as it is, else the one it equals but for case, else null."""
    return F.coalesce(F.when(F.array_contains(files, value), value), F.get(F.filter(files, lambda f: F.lower(f) == F.lower(value)), F.lit(0)))


def first_per_file(samples: DataFrame) -> DataFrame:
    """A file stays with the first sample of an article that names it."""
    rank = F.row_number().over(Window.partitionBy("article_id", "file_match").orderBy("sample_index"))
    return samples.withColumn("file_match", F.when(F.col("file_match").isNull() | (rank == 1), F.col("file_match")))


def merged(value: Column, tag: str) -> Column:
    rules = MERGES.get(tag, {})
    out = F.coalesce(value, F.lit("unknown"))
    for a, b in rules.items():
        out = F.when(F.coalesce(value, F.lit("unknown")) == a, b).otherwise(out)
    return out


def rare_collapsed(df: DataFrame, column: str, least: int) -> DataFrame:
    """Values with fewer than ``least`` rows become the commonest value that has "other" in it, else "other"."""
    counts = df.groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    target = counts.where(F.col("_v").contains("other")).agg(F.max_by("_v", F.struct("_n", "_v")).alias("_target"))
    out = df.join(counts, df[column] == F.col("_v"), "left").crossJoin(F.broadcast(target))
    return out.withColumn(column, F.when(F.col("_n") < least, F.coalesce("_target", F.lit("other"))).otherwise(F.col(column))).drop("_v", "_n", "_target")


def cleaned(df: DataFrame, tags: list[str], least: int = 5) -> DataFrame:
    out = df
    for tag in tags:
        base = tag.removeprefix("mod_mod_").removeprefix("ref_") if tag not in MERGES else tag
        out = rare_collapsed(out.withColumn(tag, merged(F.col(tag), base)), tag, least)
    return out


def flattened(answers: DataFrame, schema: str) -> DataFrame:
    """answers: article_id, response (JSON). A row for each sample, numbered from 0; an answer that is no JSON or has no sample
    gives one row with its status."""
    read = answers.withColumn("_r", F.from_json("response", schema))
    status = F.when(F.col("_r").isNull() | F.col("_r.samples").isNull(), "error").when(F.size("_r.samples") == 0, "no_samples").otherwise("success")
    rows = read.select(*answers.columns, status.alias("extraction_status"), F.coalesce(F.size("_r.samples"), F.lit(0)).alias("total_samples"), "_r.drs_instrument", "_r.general_notes", F.posexplode_outer("_r.samples").alias("sample_index", "sample"))
    return rows.select("*", "sample.*").drop("sample", "response")


def unprocessed(articles: DataFrame, done: DataFrame, version: str) -> DataFrame:
    """Articles without a result of this configuration; results of another one stop the run."""
    if (other := done.where(F.col("config_version") != version).select("config_version").first()) is not None:
        raise ValueError(f"results of another configuration: {other[0]}")
    return articles.join(done.select("article_id").distinct(), "article_id", "left_anti")


def with_legacy_names(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Copies columns to older names that are not taken."""
    return df.withColumns({new: F.col(old) for old, new in names.items() if old in df.columns and new not in df.columns})
