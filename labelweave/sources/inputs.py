"""Other ways into an environment: JSON, wide tables, names as evidence, scaled copies of records, Parquet folders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave import env as E
from labelweave.storage import written

JSON = """containers array<struct<id:string,name:string,type:string,parentId:string>>, scopes array<struct<id:string,visibleContainerIds:array<string>>>,
joinable array<struct<container1Id:string,container2Id:string>>, groundAssertions array<struct<containerId:string,labelId:string,scopeId:string,frameworkId:string,parameters:map<string,string>>>"""


def from_json(spark: SparkSession, path: str, rules: E.Rules = E.Rules(), include_children: bool = True) -> E.Env:
    """Environments as JSON documents (one per line, or whole files). include_children: what lies directly in a visible container is visible
    too (what lies deeper follows from the closure)."""
    raw = spark.read.schema(JSON).option("multiLine", True).json(path)
    each = lambda c: raw.select(F.explode(c).alias("x")).select("x.*")
    containers, scopes, joins, ground = each("containers"), each("scopes"), each("joinable"), each("groundAssertions")
    available = scopes.select(F.explode("visibleContainerIds").alias("container"), F.col("id").alias("scope"))
    contains = containers.where("parentId IS NOT NULL").select(F.col("parentId").alias("parent"), F.col("id").alias("child"))
    if include_children:
        below = available.join(contains.withColumnRenamed("parent", "container"), "container").select(F.col("child").alias("container"), "scope")
        available = available.unionByName(below).distinct()
    return E.Env(spark, {
        "containers": containers.select(F.col("id").alias("container"), F.lower("type").alias("kind"), "name"), "contains": contains, "availability": available,
        "joinable": joins.select(F.col("container1Id").alias("a"), F.col("container2Id").alias("b")),
        "ground": ground.select(F.col("containerId").alias("container"), F.col("labelId").alias("label"), F.col("scopeId").alias("scope"), F.col("frameworkId").alias("framework"), F.col("parameters").alias("params")),
    }, rules)


def from_folder(spark: SparkSession, path: str, rules: E.Rules = E.Rules(), names: tuple[str, ...] = tuple(E.SCHEMAS)) -> E.Env:
    """Tables as Parquet, one folder each; only those named are read, with their columns alone."""
    return E.Env(spark, {n: spark.read.parquet(f"{path}/{n}") for n in names}, rules)


def save(env: E.Env, path: str) -> None:
    for name, df in env.tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def from_table(df: DataFrame, table: str, key: str) -> dict[str, DataFrame]:
    """A wide table as records and fields, in one pass over it: missing values make no field (records may be sparse)."""
    own = [c for c in df.columns if c != key]
    record = F.concat(F.lit(f"{table}/"), F.col(key).cast("string"))
    cells = df.select(record.alias("record"), F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value"), F.lit(dict(df.dtypes)[c]).alias("datatype")) for c in own))).alias("x"))
    fields = cells.where("x.value IS NOT NULL").select(F.concat("record", F.lit("/"), "x.name").alias("field"), "record", F.lit(table).alias("table"), "x.name", "x.value", "x.datatype")
    contains = fields.select(F.col("record").alias("parent"), F.col("field").alias("child")).unionByName(df.select(F.lit(table).alias("parent"), record.alias("child")))
    return {"fields": fields, "contains": contains}


#: part of a lower-cased name: label. Fixed values.
NAME_HINTS = (("patient", "Individual"), ("patient", "Healthcare"), ("provider", "Individual"), ("employee", "Individual"), ("diagnos", "HealthData"), ("email", "EmailAddress"), ("phone", "TelephoneNumber"), ("address", "StreetAddress"), ("zip", "ZipCode"), ("postal", "ZipCode"), ("birth", "DateOfBirth"))
#: whole lower-cased name: label. Fixed values.
NAME_WORDS = (("ssn", "SocialSecurityNumber"), ("mrn", "MedicalRecordNumber"), ("npi", "NationalProviderIdentifier"), ("name", "Name"), ("firstname", "Name"), ("lastname", "Name"), ("gender", "Gender"), ("age", "Age"))


def name_evidence(containers: DataFrame, hints=NAME_HINTS, words=NAME_WORDS) -> DataFrame:
    """(container, label): tags guessed from names, in one pass."""
    name = F.lower("name")
    found: list[Column] = [F.when(name.contains(part), F.lit(label)) for part, label in hints] + [F.when(name == word, F.lit(label)) for word, label in words]
    return containers.select("container", F.explode(F.array_distinct(F.array(*found))).alias("label")).where("label IS NOT NULL")


def scale_records(fields: DataFrame, target: int, seed: int = 42) -> DataFrame:
    """Each table with at least `target` records: new ones draw each field's value from those of its column, repeatably.

    Values are numbered within a column and drawn by an equi-join on the number, so no pool is collected."""
    counts = fields.groupBy("table").agg(F.count_distinct("record").alias("have"))
    missing = counts.where(F.col("have") < target).select("table", F.explode(F.sequence(F.col("have") + 1, F.lit(target))).alias("i"))
    from pyspark.sql import Window

    pool = fields.select("table", "name", "value", "datatype").distinct().withColumn("k", F.row_number().over(Window.partitionBy("table", "name").orderBy("value")) - 1)
    sizes = pool.groupBy("table", "name").agg(F.count("*").alias("n"))
    new = missing.join(sizes, "table").withColumn("k", F.pmod(F.xxhash64(F.lit(seed), "table", "name", "i"), F.col("n")).cast("int"))
    new = new.join(pool, ["table", "name", "k"]).withColumn("record", F.concat("table", F.lit("/new"), F.col("i").cast("string")))
    return fields.unionByName(new.select(F.concat("record", F.lit("/"), "name").alias("field"), "record", "table", "name", "value", "datatype"))


def scaled(env: E.Env, target: int, seed: int = 42) -> E.Env:
    """env with at least `target` records in each table that has any; the new records and their fields are contained like the old ones."""
    fields = written(scale_records(env.fields, target, seed), "fields")
    new = fields.join(env.fields.select("field").distinct(), "field", "left_anti")
    edges = new.select(F.col("table").alias("parent"), F.col("record").alias("child")).unionByName(new.select(F.col("record").alias("parent"), F.col("field").alias("child")))
    return env.with_tables(fields=fields, contains=env.contains.unionByName(edges).distinct())


def merge(*envs: E.Env) -> E.Env:
    """The union of several environments' tables and rules."""
    tables = {n: reduce(DataFrame.unionByName, (e.tables[n] for e in envs)) for n in E.SCHEMAS}
    return E.Env(envs[0].spark, {n: df if n in ("fields", "ground", "containers") else df.distinct() for n, df in tables.items()}, sum((e.rules for e in envs), E.Rules()))
