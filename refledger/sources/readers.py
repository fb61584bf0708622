"""Readers: claimed references from files, registry snapshots, probe logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from refledger import schemas
from refledger.functions import text as tx
from refledger.operators.common import first_row_by, number_rows
from refledger.session import cut_lineage
from refledger.sources.bibtex import parse_bibtex
from refledger.sources.markdown import parse_markdown

PART_COLUMNS = ["path", "pos", *schemas.CLAIM_FIELDS, "semantic", "triples", "malformed"]


def read_texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path and whole text of every matching file; one row per bibliography file."""
    raw = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path, wholetext=True)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1)
    return raw.select(F.input_file_name().alias("path"), F.col("value").alias("text")).filter(
        ~name.startswith("README"))


def _lift(df: DataFrame) -> DataFrame:
    """Common part layout, missing columns as nulls."""
    have = set(df.columns)
    kinds = {f.name: f.dataType for f in schemas.REFS}
    cols = []
    for c in PART_COLUMNS:
        kind = {"semantic": kinds["semantic"], "triples": kinds["triples"], "malformed": "boolean",
                "pos": "bigint"}.get(c, "string")
        value = F.col(c) if c in have else (F.lit(False) if c == "malformed" else F.lit(None))
        cols.append(value.cast(kind).alias(c))
    return df.select(*cols)


def parse_refs_json(texts: DataFrame) -> DataFrame:
    """JSON arrays of references: one row per element; a non-object element is kept as malformed.

    Scalars become strings and unknown keys are ignored.  ``semantic`` counts only as an object."""
    items = F.from_json(F.col("text"), "array<string>", {"mode": "PERMISSIVE"})
    rows = texts.select("path", F.posexplode(items).alias("pos", "item"))
    item = F.trim(F.coalesce("item", F.lit("null")))
    is_object = item.startswith("{")
    fields = ", ".join(f"{f} string" for f in schemas.CLAIM_FIELDS)
    flat = F.from_json(F.when(is_object, item), f"{fields}, semantic string, triples string")
    out = rows.select("path", "pos", item.alias("item"), is_object.alias("ok"), flat.alias("r"))
    semantic = F.when(F.col("r.semantic").startswith("{"), F.from_json(F.col("r.semantic"), schemas.SEMANTIC))
    triples = F.from_json(F.col("r.triples"), "array<" + schemas.TRIPLE.simpleString() + ">")
    return _lift(out.select(
        "path", "pos", *[
            (F.when(F.col("ok"), F.col("r.title")).otherwise(F.col("item")).alias("title")
             if f == "title" else F.col(f"r.{f}").alias(f)) for f in schemas.CLAIM_FIELDS],
        semantic.alias("semantic"), triples.alias("triples"), (~F.col("ok")).alias("malformed")))


def number_parts(parts: DataFrame, list_id: Column | None = None) -> DataFrame:
    """Assign list and row ids: files in name order, entries in file order.

    Every file is its own list unless ``list_id`` says otherwise."""
    # one row per file, never per entry: ranges of file names of about equal size are numbered each on its own, and
    # start where the ranges before them end (one row a range)
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    files = cut_lineage(parts.groupBy("path").agg(F.count("*").alias("n")).withColumn("folder", folder).repartitionByRange(
        "folder", "path").withColumn("part", F.spark_partition_id()))
    inside, across = Window.partitionBy("part").orderBy("folder", "path"), Window.partitionBy(F.lit(0)).orderBy("part")
    before = Window.unboundedPreceding, -1
    ranges = files.groupBy("part").agg(F.count("*").alias("k"), F.sum("n").alias("s")).select(
        "part", F.coalesce(F.sum("k").over(across.rowsBetween(*before)), F.lit(0)).alias("files_before"),
        F.coalesce(F.sum("s").over(across.rowsBetween(*before)), F.lit(0)).alias("rows_before"))
    sized = files.join(ranges, "part").select(
        "path", (F.col("files_before") + F.row_number().over(inside)).alias("file_no"),
        (F.col("rows_before") + F.coalesce(F.sum("n").over(inside.rowsBetween(*before)), F.lit(0))).alias("offset"))
    df = parts.join(sized, "path")
    ranked = number_rows(df.withColumn("pos", F.col("pos").cast("bigint")), ["path"], "pos", "in_file")
    return ranked.select(
        (F.col("file_no").cast("bigint") if list_id is None else list_id).alias("list_id"),
        (F.col("offset") + F.col("in_file")).cast("bigint").alias("ref_id"), "path",
        F.col("in_file").alias("position"),
        *[(F.col(f).try_cast("int").alias(f) if f == "year" else F.col(f)) for f in schemas.CLAIM_FIELDS],
        "semantic", "triples", "malformed")


def read_refs_json(spark: SparkSession, path: str) -> DataFrame:
    parts = parse_refs_json(read_texts(spark, path, "*.json"))
    return number_parts(parts)


def read_refs_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines: the splittable form for very large collections; bad lines stay as malformed rows."""
    schema = schemas.REFS.add("_corrupt_record", "string")
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path).withColumn(
        "malformed", F.col("_corrupt_record").isNotNull())


def ingest_bibtex(spark: SparkSession, path: str, split_entries: bool = False) -> DataFrame:
    """All entries of a directory of .bib files.

    ``split_entries`` reads one record per line-initial ``@`` instead of one per file, for files too
    large for a row."""
    if split_entries:
        raw = spark.read.option("lineSep", "\n@").option("pathGlobFilter", "*.bib").text(path)
        # a record takes more than one byte, so block start plus place in the block keeps the order of a file
        read = raw.select(F.input_file_name().alias("path"), F.col("_metadata.file_block_start").alias("block"), F.concat(
            F.lit("@"), F.regexp_replace("value", r"^\s*@", "")).alias("text"), F.monotonically_increasing_id().alias("id"))
        block = Window.partitionBy("path", "block").orderBy("id")
        placed = read.withColumn("at", F.col("block") + F.row_number().over(block)).select(
            F.concat_ws("\n", "path", "at").alias("path"), "text")
        parts = parse_bibtex(placed).withColumns({
            "pos": F.substring_index("path", "\n", -1).cast("bigint"), "path": F.substring_index("path", "\n", 1)})
    else:
        parts = parse_bibtex(read_texts(spark, path, "*.bib"))
    return number_parts(_lift(parts))


def ingest_markdown_refs(spark: SparkSession, path: str) -> DataFrame:
    return number_parts(_lift(parse_markdown(read_texts(spark, path, "*.md"))))


def combine_parts(*parts: DataFrame) -> DataFrame:
    """Union of parsed parts into one batch in file-name order."""
    out = _lift(parts[0])
    for p in parts[1:]:
        out = out.unionByName(_lift(p))
    return number_parts(out, F.lit(1).cast("bigint")).withColumn("position", F.col("ref_id"))


def read_refs_dir(spark: SparkSession, path: str) -> DataFrame:
    """All .json, .bib and .md files of a directory as one batch; files that fail to parse add nothing."""
    return combine_parts(
        parse_refs_json(read_texts(spark, path, "*.json")),
        parse_bibtex(read_texts(spark, path, "*.bib")),
        parse_markdown(read_texts(spark, path, "*.md")))


def read_registry(spark: SparkSession, name: str, path: str, fmt: str = "parquet") -> DataFrame:
    """Registry snapshot with its fixed schema.  JSON input is read permissively.

    Keyed registries keep one row per normalised key (a hit before any failed lookup)."""
    schema = schemas.REGISTRIES[name]
    df = spark.read.schema(schema).format(fmt).load(path)
    return unique_registry(df, name)


def unique_registry(df: DataFrame, name: str) -> DataFrame:
    """One row per key: hits first, then a fixed order of the remaining columns."""
    key = schemas.REGISTRY_KEYS.get(name)
    if key is None:
        return df
    keyed = df.withColumn(key, F.lower(tx.strip(F.col(key)))).filter(F.coalesce(F.col(key), F.lit("")) != "")
    hit = F.when(F.col("lookup_status") == "hit", 0).otherwise(1) if "lookup_status" in df.columns else F.lit(0)
    return first_row_by(keyed, [key], [hit, F.to_json(F.struct(*[c for c in keyed.columns]))])


def registry_states(df: DataFrame) -> DataFrame:
    """Rows per lookup state."""
    return df.groupBy("lookup_status").agg(F.count("*").alias("n"))


def read_retraction_csv(spark: SparkSession, path: str) -> DataFrame:
    """Retraction notices CSV (quoted, multi-line) in file order, ready for the index."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = {c.lower(): c for c in raw.columns}
    return raw.select(
        F.col(names["originalpaperdoi"]).alias("doi"), F.col(names["retractionnature"]).alias("nature"),
        F.col(names["retractiondate"]).alias("date"), F.col(names.get("retractionreason", names.get("reason"))).alias("reason"),
        F.monotonically_increasing_id().alias("line_no"))
