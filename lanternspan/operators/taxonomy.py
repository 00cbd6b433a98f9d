"""Taxonomy entries from the exports of an occupational taxonomy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx

ENTRY = (
    "entry_id string, entry_type string, title string, normalized_text string, aliases array<string>, alias_normalized array<string>, onetsoc_code string, occupation_title string, "
    "source string, element_id string, importance double, level double, commodity_code string, commodity_title string, hot_technology boolean, in_demand boolean"
)


def _entry(kind: Column | str, title: Column, code: Column, occupation: Column, source: str, key: Column, **more) -> list[Column]:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    aliases = more.get("aliases", F.array().cast("array<string>"))
    lit = lambda v, ty: more.get(v, F.lit(None).cast(ty))
    return [
        F.concat_ws("::", kind, code, key).alias("entry_id"), kind.alias("entry_type"), title.alias("title"), tx.normalize_text(title).alias("normalized_text"), aliases.alias("aliases"),
        F.transform(aliases, lambda a: tx.normalize_text(a)).alias("alias_normalized"), code.alias("onetsoc_code"), F.coalesce(occupation, F.lit("")).alias("occupation_title"), F.lit(source).alias("source"),
        more.get("element_id", F.lit("")).alias("element_id"), lit("importance", "double").alias("importance"), lit("level", "double").alias("level"), more.get("commodity_code", F.lit("")).alias("commodity_code"),
        more.get("commodity_title", F.lit("")).alias("commodity_title"), more.get("hot", F.lit(False)).alias("hot_technology"), more.get("demand", F.lit(False)).alias("in_demand"),
    ]


def _code(df: DataFrame) -> Column:
    return tx.first_of(df, "O*NET-SOC Code", "onetsoc_code")


def occupations(df: DataFrame, pos: str = "pos") -> DataFrame:
    """(code, occupation, description), of a code's rows with a title the last."""
    d = df.select(_code(df).alias("code"), tx.first_of(df, "Title").alias("t"), tx.first_of(df, "Description").alias("d"), F.col(pos)).where("code <> '' and t <> ''")
    return d.groupBy("code").agg(F.max_by("t", pos).alias("occupation"), F.max_by("d", pos).alias("description"))


def occupation_entries(occ: DataFrame) -> DataFrame:
    alias = F.filter(F.array("description"), lambda a: a != "")
    return occ.select(*_entry("occupation", F.col("occupation"), F.col("code"), F.col("occupation"), "Occupation Data", F.lit(None).cast("string"), aliases=alias))


def _first(df: DataFrame, keys: list[str], pos: str, last: bool = False) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(pos) if last else F.asc(pos))
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def title_entries(df: DataFrame, occ: DataFrame, pos: str = "pos") -> DataFrame:
    """Alternate titles of known occupations, of equal ones the first."""
    d = df.select(_code(df).alias("code"), tx.first_of(df, "Alternate Title", "Title").alias("t"), F.col(pos)).where("code <> '' and t <> ''")
    d = _first(d.join(occ.select("code", "occupation"), "code").withColumn("k", tx.normalize_text(F.col("t"))), ["code", "k"], pos)
    return d.select(*_entry("alternate_title", F.col("t"), F.col("code"), F.col("occupation"), "Alternate Titles", F.col("k")))


def descriptor_scores(df: DataFrame, keys: list[str], scale: str, value: str, pos: str, importance: str = "IM", level: str = "LV") -> DataFrame:
    """Keys with the last readable value of either scale; keys without any stay."""
    last = lambda s: F.max_by(value, F.when((F.upper(scale) == s) & F.col(value).isNotNull(), F.col(pos)))
    return df.groupBy(*keys).agg(last(importance).alias("importance"), last(level).alias("level"))


def descriptor_entries(df: DataFrame, occ: DataFrame, kind: str, source: str, pos: str = "pos") -> DataFrame:
    d = df.select(_code(df).alias("code"), tx.first_of(df, "Element Name", "Title").alias("t"), tx.first_of(df, "Element ID").alias("e"), F.upper(tx.first_of(df, "Scale ID")).alias("s"), tx.first_of(df, "Data Value").try_cast("double").alias("v"), F.col(pos)).where("code <> '' and t <> ''")
    g = descriptor_scores(d, ["code", "e", "t"], "s", "v", pos).join(occ.select("code", "occupation"), "code", "left")
    key = F.when(F.col("e") != "", F.col("e")).otherwise(tx.normalize_text(F.col("t")))
    return g.select(*_entry(kind, F.col("t"), F.col("code"), F.col("occupation"), source, key, element_id=F.col("e"), importance=F.col("importance"), level=F.col("level")))


def technology_entries(df: DataFrame, occ: DataFrame, pos: str = "pos") -> DataFrame:
    yes = lambda *n: F.upper(tx.first_of(df, *n)) == "Y"
    d = df.select(_code(df).alias("code"), tx.first_of(df, "Example").alias("t"), tx.first_of(df, "Commodity Code").alias("cc"), tx.first_of(df, "Commodity Title").alias("ct"), yes("Hot Technology").alias("hot"), yes("In Demand").alias("demand"), F.col(pos)).where("code <> '' and t <> ''")
    d = _first(d.withColumn("k", tx.normalize_text(F.col("t"))), ["code", "k"], pos, last=True).join(occ.select("code", "occupation"), "code", "left")
    alias = F.filter(F.array("ct"), lambda a: a != "")
    return d.select(*_entry("technology_skill", F.col("t"), F.col("code"), F.col("occupation"), "Technology Skills", F.col("k"), aliases=alias, commodity_code=F.col("cc"), commodity_title=F.col("ct"), hot=F.col("hot"), demand=F.col("demand")))


def task_entries(df: DataFrame, occ: DataFrame, pos: str = "pos") -> DataFrame:
    d = df.select(_code(df).alias("code"), tx.first_of(df, "Task", "Task Statement").alias("t"), tx.first_of(df, "Task ID").alias("i"), F.col(pos)).where("code <> '' and t <> ''")
    d = _first(d.withColumn("k", tx.normalize_text(F.col("t"))), ["code", "k"], pos).join(occ.select("code", "occupation"), "code", "left")
    return d.select(*_entry("task_statement", F.col("t"), F.col("code"), F.col("occupation"), "Task Statements", F.when(F.col("i") != "", F.col("i")).otherwise(F.col("k")), element_id=F.col("i")))


#: Descriptor files: name -> (entry type, source).
DESCRIPTORS = {"skills": ("skill", "Skills"), "knowledge": ("knowledge", "Knowledge"), "abilities": ("ability", "Abilities"), "work_activities": ("work_activity", "Work Activities")}


def index(tables: dict[str, DataFrame]) -> DataFrame:
    """All entries; occupation_data is needed, the other tables are optional. Each table has its row's number in `pos`."""
    if "occupation_data" not in tables:
        raise ValueError("the table of occupations is missing")
    occ = occupations(tables["occupation_data"])
    parts = [occupation_entries(occ)]
    if "alternate_titles" in tables:
        parts.append(title_entries(tables["alternate_titles"], occ))
    parts += [descriptor_entries(tables[k], occ, *v) for k, v in DESCRIPTORS.items() if k in tables]
    if "technology_skills" in tables:
        parts.append(technology_entries(tables["technology_skills"], occ))
    if "task_statements" in tables:
        parts.append(task_entries(tables["task_statements"], occ))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_summary(entries: DataFrame) -> DataFrame:
    return entries.groupBy("entry_type").agg(F.count("*").alias("entries"))
