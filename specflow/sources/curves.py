"""Curve files as points: reading two-column text files, and finding out what each holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Constant of the conversion between wavelength in nm and photon energy in eV.
HC = 1240.0

POINTS = T.StructType([T.StructField("path", T.StringType()), T.StructField("folder", T.StringType()), T.StructField("stem", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path, folder, stem, content of every CSV file below ``root``. Whole files, so that lines keep their order. The text is always
    read: where no column is asked for the source would give a row for each line."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(root, wholetext=True).where("value is not null")
    path = F.col("_metadata.file_path")
    return files.select(path.alias("path"), F.regexp_extract(path, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(path, r"([^/]+)\.[^./]*$", 1).alias("stem"), F.col("value").alias("content"))


def parse_points(files: DataFrame, dialect: str = "full") -> DataFrame:
    """Points of files with columns path, folder, stem, content.

    full: lines with a letter other than e are headers; the separator is the first of ; , tab that the line has, else white
    space; decimal commas are read. simple: ; or else , separates, and nothing else is special. Lines that do not begin with
    two numbers are dropped in either.
    """
    lines = files.select("path", "folder", "stem", F.posexplode(F.split("content", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    line = F.col("line")
    if dialect == "full":
        lines = lines.where(~line.rlike(r"[\p{L}&&[^eE]]"))
        parts = F.when(line.contains(";"), F.split(line, ";")).when(line.contains(","), F.split(line, ",")).when(line.contains("\t"), F.split(line, "\t")).otherwise(F.split(line, r"\s+"))
        number = lambda i: F.replace(F.trim(F.get(parts, F.lit(i))), F.lit(","), F.lit(".")).try_cast("double")
    else:
        parts = F.when(line.contains(";"), F.split(line, ";")).otherwise(F.split(line, ","))
        number = lambda i: F.trim(F.get(parts, F.lit(i))).try_cast("double")
    return lines.select("path", "folder", "stem", F.col("line_no").cast("int").alias("line_no"), number(0).alias("x"), number(1).alias("y")).where("x is not null and y is not null and not isnan(x) and not isnan(y)")


def kind_of_stem(stem: Column) -> tuple[Column, Column]:
    """(kind, exponent) by a file's name, nulls where the name does not tell."""
    s = F.lower(stem)
    return (
        F.when(s.contains("_abs"), "abs").when(s.contains("tauc"), "tauc"),
        F.when(s.contains("_abs"), F.lit(None).cast("double")).when(s.contains("tauc05"), 0.5).when(s.contains("tauc2"), 2.0).when(s.contains("tauc"), 0.5),
    )


def with_kind(points: DataFrame) -> DataFrame:
    """Adds kind and exponent; where the name does not tell, a median of x below 10 (eV, not nm) makes a Tauc file."""
    kind, exponent = kind_of_stem(F.col("stem"))
    middle = points.groupBy("path").agg(F.percentile("x", 0.5).alias("_m"))
    out = points.join(middle, "path")
    guessed = F.coalesce(kind, F.when(F.col("_m") < 10, "tauc").otherwise("abs"))
    return out.withColumn("kind", guessed).withColumn("exponent", F.when(guessed == "tauc", F.coalesce(exponent, F.lit(0.5)))).drop("_m")


def preferred(files: DataFrame) -> DataFrame:
    """Of each folder only the best kind of files: absorption, else Tauc, else any that are no results."""
    s = F.lower("stem")
    rank = F.when(s.contains("_abs_"), 0).when(s.contains("_tauc"), 1).when(~s.contains("result") & ~s.contains("analysis"), 2)
    ranked = files.withColumn("_rank", rank).where("_rank is not null")
    best = ranked.groupBy("folder").agg(F.min("_rank").alias("_best"))
    return ranked.join(best, "folder").where("_rank = _best").drop("_rank", "_best")


def data_folders(files: DataFrame) -> DataFrame:
    """Folders named *_data that hold absorption or Tauc files."""
    s = F.lower("stem")
    return files.where(F.col("folder").endswith("_data") & (s.contains("_abs_") | s.contains("_tauc"))).select("folder").distinct()


def calibrators(files: DataFrame) -> DataFrame:
    """Of each folder its first file, by name, whose stem ends in two underscores and digits: folder, path, known_gap."""
    known = files.where(F.col("stem").rlike(r"__\d+$"))
    return known.groupBy("folder").agg(F.min_by("path", "stem").alias("path"), F.min("stem").alias("stem")).withColumn("known_gap", known_gap(F.col("stem"))).drop("stem")


def known_gap(stem: Column) -> Column:
    """Hundredths of eV behind the last two underscores of a calibrator's name."""
    return F.nullif(F.regexp_extract(stem, r"__(\d+)$", 1), F.lit("")).try_cast("double") / 100


def without_gap(stem: Column) -> Column:
    return F.regexp_replace(stem, r"__\d+$", "")


def sample_name(stem: Column) -> Column:
    """What follows the last occurrence of the first marker, in this order, that a stem has."""
    out = stem
    for marker in ("_tauc_", "_tauc05_", "_tauc2_", "_abs_"):
        out = F.when(stem.contains(marker), F.substring_index(stem, marker, -1)).otherwise(out)
    return out


def match_files(samples: DataFrame, files: DataFrame) -> DataFrame:
    """One file for each (folder, sample): the exact name, else a calibrated variant, else a name that contains it.

    An equi-join on the folder; the best match of a sample is an aggregate, not a window, so large folders combine early.
    """
    names = files.select("folder", "path", sample_name(F.col("stem")).alias("_name"))
    rank = F.when(F.col("_name") == F.col("sample"), 0).when(without_gap(F.col("_name")) == F.col("sample"), 1).when(F.col("_name").contains(F.col("sample")), 2)
    best = samples.select("folder", "sample").distinct().join(names, "folder").withColumn("_rank", rank).where("_rank is not null")
    best = best.groupBy("folder", "sample").agg(F.min_by("path", F.struct("_rank", "path")).alias("path"), F.min("_rank").alias("match_rank"))
    return samples.join(best, ["folder", "sample"], "left")


def absorption(points: DataFrame) -> DataFrame:
    """energy, absorbance of absorption points: positive wavelengths and absorbances only."""
    return points.where("x > 0 and y > 0").withColumn("energy", F.lit(HC) / F.col("x")).withColumnRenamed("y", "absorbance").drop("x")


def tauc(points: DataFrame) -> DataFrame:
    """energy, tauc of Tauc points: positive energies, no negative values."""
    return points.where("x > 0 and y >= 0").withColumnRenamed("x", "energy").withColumnRenamed("y", "tauc")


def spectra(points: DataFrame, exponent: float = 0.5) -> DataFrame:
    """energy, absorbance, tauc of points with kind and exponent: absorbance converts to the wanted exponent, a Tauc file is
    inverted by its own exponent first."""
    energy = F.when(F.col("kind") == "abs", F.lit(HC) / F.col("x")).otherwise(F.col("x"))
    good = F.when(F.col("kind") == "abs", (F.col("x") > 0) & (F.col("y") > 0)).otherwise((F.col("x") > 0) & (F.col("y") >= 0))
    inverse = F.pow(F.greatest(F.col("y"), F.lit(1e-10)), 1 / F.col("exponent")) / energy
    out = points.where(good).withColumn("energy", energy).withColumn("absorbance", F.when(F.col("kind") == "abs", F.col("y")).otherwise(inverse))
    return out.withColumn("tauc", F.pow(F.col("absorbance") * F.col("energy"), F.lit(exponent))).drop("x", "y")


def write_tauc(points: DataFrame, path: str) -> None:
    """energy;tauc lines, a directory for each file's stem."""
    points.select("stem", "energy", "tauc").repartition("stem").sortWithinPartitions("stem", "energy").write.partitionBy("stem").option("sep", ";").csv(path)


#: Digits that the feature table is written with.
DIGITS = {"E_g_eV": 4, "E_g_R2": 6, "edge_slope": 4, "transition_width": 4, "E_u_meV": 2, "E_u_R2": 6, "A_sub": 6, "A_sub_raw": 6, "A_sub_coverage": 4, "E_g_region_start": 4, "E_g_region_end": 4, "E_u_region_start": 4, "E_u_region_end": 4, "A_sub_region_start": 4, "A_sub_region_end": 4, "A_sub_ideal_start": 4}


def rounded(features: DataFrame) -> DataFrame:
    """The features as a written table has them."""
    return features.withColumns({c: F.round(c, d) for c, d in DIGITS.items() if c in features.columns})


def write_features(features: DataFrame, path: str) -> None:
    """Parquet at full precision, and a CSV with rounded numbers beside it."""
    features.write.parquet(f"{path}/features")
    rounded(features).write.option("header", True).csv(f"{path}/results_all")


def read_features(spark: SparkSession, path: str, required: tuple[str, ...] = ("E_g_eV", "E_u_meV", "A_sub")) -> DataFrame:
    """A feature table in CSV; NaN becomes null."""
    out = spark.read.option("header", True).option("nanValue", "nan").csv(path)
    if missing := [c for c in required if c not in out.columns]:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    numbers = [c for c in out.columns if c in DIGITS or c in ("eu_eg_ratio", "subgap_slope", "edge_asymmetry", "urbach_residual")]
    return out.withColumns({c: F.nanvl(F.col(c).try_cast("double"), F.lit(None).cast("double")) for c in numbers})
