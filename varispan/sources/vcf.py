"""VCF text, plain or (b)gzip, as rows of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_names(spark: SparkSession, path: str | list[str]) -> list[str]:
    """Sample columns of the header line; fails without one."""
    line = spark.read.text(path).where(F.col("value").startswith("#CHROM")).limit(1).first()
    if line is None:
        raise ValueError(f"{path} has no #CHROM line")
    return line[0].rstrip("\r").split("\t")[9:]


def read_sites(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None, pos: tuple[int, int] | None = None) -> DataFrame:
    """One row per record: chrom, pos (from one), site_idx, ref, alleles (ref first), rlen, qual, mq, format, calls (text per sample).

    Missing or malformed numbers are null. ``site_idx`` orders records of one position as the file does. ``chroms`` and
    ``pos`` (inclusive) select records before anything else is parsed.
    """
    raw = spark.read.text(path).where(~F.col("value").startswith("#") & (F.col("value") != "")).select(F.monotonically_increasing_id().alias("site_idx"), F.split(F.regexp_replace("value", "\r$", ""), "\t").alias("f"))
    rows = raw.select("site_idx", F.get("f", F.lit(0)).alias("chrom"), F.get("f", F.lit(1)).try_cast("int").alias("pos"), "f")
    if chroms:
        rows = rows.where(F.col("chrom").isin(chroms))
    if pos:
        rows = rows.where(F.col("pos").between(*pos))
    info = F.get("f", F.lit(7))
    alt = F.get("f", F.lit(4))
    end = F.regexp_extract(info, r"(?:^|;)END=(\d+)", 1).try_cast("int")
    ref = F.get("f", F.lit(3))
    return rows.select(
        "chrom", "pos", "site_idx", ref.alias("ref"),
        F.concat(F.array(ref), F.when((alt == ".") | alt.isNull(), F.array().cast("array<string>")).otherwise(F.split(alt, ","))).alias("alleles"),
        F.coalesce(end - F.col("pos") + 1, F.length(ref)).alias("rlen"),
        F.get("f", F.lit(5)).try_cast("double").alias("qual"),
        F.regexp_extract(info, r"(?:^|;)MQ=([^;]*)", 1).try_cast("double").alias("mq"),
        F.split(F.get("f", F.lit(8)), ":").alias("format"), F.slice("f", 10, F.greatest(F.size("f") - 9, F.lit(0))).alias("calls"),
    )


def calls(sites: DataFrame, samples: list[str]) -> DataFrame:
    """One row per record and sample: the site's columns, sample, gt (distinct called alleles), dp, gq, ad. A key absent from FORMAT, or a dot, is null."""
    names = F.array(*[F.lit(s) for s in samples]) if samples else F.array().cast("array<string>")
    rows = sites.select(*[c for c in sites.columns if c != "calls"], F.posexplode("calls").alias("i", "call")).withColumn("v", F.split("call", ":"))

    def value(key: str):
        return F.get("v", F.nullif(F.array_position("format", key), F.lit(0)).cast("int") - 1)

    called = F.array_distinct(F.filter(F.transform(F.split(value("GT"), r"[/|]"), lambda x: F.get("alleles", x.try_cast("int"))), lambda a: a.isNotNull()))
    return rows.select(*[c for c in sites.columns if c not in ("calls", "format")], F.get(names, F.col("i")).alias("sample"), called.alias("gt"), value("DP").try_cast("int").alias("dp"), value("GQ").try_cast("int").alias("gq"), F.transform(F.split(value("AD"), ","), lambda x: x.try_cast("int")).alias("ad"))


def read_calls(spark: SparkSession, path: str | list[str], chroms: list[str] | None = None, pos: tuple[int, int] | None = None) -> DataFrame:
    return calls(read_sites(spark, path, chroms, pos), sample_names(spark, path))
