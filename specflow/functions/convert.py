"""Column expressions: optics, names, labels, small geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def energy_of(wavelength: Column) -> Column:
    return F.when(wavelength > 0, 1240.0 / wavelength)


def tauc_of(energy: Column, absorbance: Column, exponent: float) -> Column:
    return F.pow(energy * absorbance, F.lit(exponent))


def absorbance_of(energy: Column, tauc: Column, exponent: float) -> Column:
    return F.pow(F.greatest(tauc, F.lit(1e-10)), F.lit(1 / exponent)) / energy


def log_absorption(energy: Column, absorbance: Column) -> Column:
    """ln of the absorbance, which is in proportion to the coefficient; null where either is not positive."""
    return F.when((energy > 0) & (absorbance > 0), F.ln(absorbance))


def log_absorption_of_tauc(energy: Column, tauc: Column, exponent: float) -> Column:
    """The same from (coefficient x energy) ^ exponent."""
    return F.when((energy > 0) & (tauc > 0), F.ln(tauc) / exponent - F.ln(energy))


def magnitude(a: Column, b: Column) -> Column:
    """Length of a shift in two features."""
    return F.hypot(a, b)


def baseline_removed(absorbance: Column, delta: Column) -> Column:
    return F.when(delta > 0, F.greatest(absorbance - delta, F.lit(1e-12))).otherwise(absorbance)


def kubelka_munk(reflectance: Column) -> Column:
    """Not needed for measured absorbance; (1 - R)^2 / 2R."""
    return F.try_divide((1 - reflectance) * (1 - reflectance), 2 * reflectance)


def article_of_folder(folder: Column) -> Column:
    """name_number of the first path part that begins with name_number_data, else the folder."""
    return F.coalesce(F.nullif(F.regexp_extract(folder, r"(?:^|/)(\w+_\d+)_data", 1), F.lit("")), folder)


def article_of_id(article_id: Column) -> Column:
    return F.replace(F.substring_index(article_id, "/", -1), F.lit(".pdf"), F.lit(""))


def clean_type(kind: Column) -> Column:
    return F.when(kind == "reference", "reference").when(kind.isin("doped", "defective", "modified"), "modified").otherwise("unknown")


def letter(cluster: Column) -> Column:
    return F.char(F.lit(65) + cluster)


def arrow(a: Column, b: Column) -> Column:
    """a → b."""
    return F.concat_ws(" → ", a, b)


def label_of(value: Column, names: dict[str, str]) -> Column:
    """A listed name, else the value with spaces for underscores, in title case."""
    plain = F.initcap(F.replace(value, F.lit("_"), F.lit(" ")))
    if not names:
        return plain
    listed = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.element_at(listed, value), plain)


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def quality_stars(*confidence: Column) -> Column:
    out = F.lit(0)
    for c in confidence:
        out = out + F.coalesce((c == "high").cast("int"), F.lit(0))
    return out


def worst_confidence(*confidence: Column, invalid_counts: bool = False) -> Column:
    """The worst of labels; invalid is passed over unless it is to count."""
    rank = lambda c: F.when(c == "low", 0).when(c == "medium", 1).when(c == "high", 2).when(c == "invalid", -1 if invalid_counts else 2).otherwise(2)
    least = F.least(*map(rank, confidence)) if len(confidence) > 1 else rank(confidence[0])
    return F.when(least < 0, "invalid").when(least == 0, "low").when(least == 1, "medium").otherwise("high")


def angle_between(a: list[Column], b: list[Column]) -> Column:
    """Degrees from 0 to 180; null if either vector has no length."""
    dot = sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    size = lambda v: F.sqrt(sum((x * x for x in v), F.lit(0.0)))
    return F.when((size(a) >= 1e-12) & (size(b) >= 1e-12), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size(a) * size(b)))))))


def ratio_of_gap(tail_mev: Column, gap: Column) -> Column:
    return F.when(gap > 0, tail_mev / 1000 / gap).otherwise(0.0)


def runner_up(probabilities: Column) -> Column:
    """Label of the second-largest of structs (p, label)."""
    return F.get(F.reverse(F.array_sort(probabilities)), F.lit(1))["label"]


def confidence_of_gap(r2: Column, share: Column) -> Column:
    return F.when((r2 >= 0.997) & (share >= 0.10), "high").when((r2 >= 0.990) & (share >= 0.05), "medium").otherwise("low")


def colour(cluster: Column, palette: list[str], noise: str = "grey") -> Column:
    """A cluster's colour, in turn through the palette; that of noise for negative or missing clusters."""
    return F.when(cluster >= 0, F.element_at(F.array(*map(F.lit, palette)), (cluster % len(palette)).cast("int") + 1)).otherwise(noise)
