"""Conversions between features, plain tables and metadata; features that follow merged or translated sequences."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import locations as L
from .intervals import with_range
from .rows import key_column


def columns(fts: DataFrame, keys: str = "type start stop strand") -> DataFrame:
    """The named values of each feature, in list order: columns, `len`, or metadata keys."""
    return fts.orderBy("ord").select(*(key_column(fts, k).alias(k) for k in keys.split()))


def tolists(fts: DataFrame, keys: str = "type start stop strand"):
    """Lists of the named values, one for each feature, fetched part by part."""
    for row in columns(fts, keys).toLocalIterator():
        yield list(row)


def to_pandas(fts: DataFrame, keys: str = "type start stop strand"):
    return columns(fts, keys).toPandas()


def from_table(df: DataFrame, ftype: str | None = None, one_based: bool = False) -> DataFrame:
    """Features of a plain table: start, stop and len complete each other, other columns become metadata.

    ftype names a column or is the type itself; one_based takes 1 off start alone. Without an `ord` column, rows are
    numbered as they come.
    """
    names = df.columns
    start = F.col("start").cast("long") - int(one_based) if "start" in names else F.col("stop").cast("long") - F.col("len").cast("long")
    stop = F.col("stop").cast("long") if "stop" in names else start + F.col("len").cast("long")
    type_ = F.col(ftype) if ftype in names else F.lit(ftype) if ftype is not None else F.col("type") if "type" in names else F.lit(None).cast("string")
    strand = F.coalesce("strand", F.lit("?")) if "strand" in names else F.lit("?")
    own = ("ord", "seqid", "type", "name", "id", "score", "evalue", "start", "stop", "len", "strand", "defect")
    rest = [c for c in names if c not in own]
    text = lambda c: F.col(c) if c in names else F.lit(None).cast("string")
    number = lambda c: F.col(c).cast("double") if c in names else F.lit(None).cast("double")
    ord_ = F.col("ord") if "ord" in names else F.monotonically_increasing_id()
    meta = F.to_json(F.struct(*rest)) if rest else F.lit("{}")
    out = df.select(ord_.alias("ord"), text("seqid").alias("seqid"), type_.alias("type"), text("name").alias("name"), text("id").alias("id"), number("score").alias("score"), number("evalue").alias("evalue"), F.array(L.location(start, stop, strand)).alias("locs"), meta.alias("meta_json"))
    return with_range(out)


def from_pandas(spark: SparkSession, frame, ftype: str | None = None, one_based: bool = False) -> DataFrame:
    return from_table(spark.createDataFrame(frame), ftype, one_based)


def meta_get(meta: Column | str, path: str) -> Column:
    """The value at a dotted path of metadata, as text; null if it is missing."""
    return F.get_json_object(F.col(meta) if isinstance(meta, str) else meta, "$" + "".join(f"['{p}']" for p in path.split(".")))


def meta_set(df: DataFrame, key: str, value) -> DataFrame:
    """df with a top-level key of its metadata set to a plain value; one Arrow pass, as the rest may be of any shape."""
    names, schema = df.columns, df.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = names.index("meta_json")
            metas = [json.dumps(json.loads(x or "{}") | {key: value}, sort_keys=True) for x in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(metas, pa.string()))

    return df.mapInArrow(run, schema)


def hit_sequences(fts: DataFrame, x: str = "source", change_id: bool = False) -> DataFrame:
    """Sequences of the sseq (source) or qseq (query) column of hits, under the id of that side.

    change_id adds the first place, the strand and the e-value's exponent to the id.
    """
    if x not in ("source", "query"):
        raise ValueError("x is source or query")
    side = x[0]
    data = meta_get("meta_json", f"{side}seq")
    id_ = meta_get("meta_json", f"{side}seqid")
    if change_id:
        first = F.least(*(meta_get("meta_json", f"{side}{k}").cast("long") for k in ("start", "end")))
        power = F.when(F.abs("evalue") > 0, F.log10("evalue")).otherwise(F.col("evalue"))
        id_ = F.concat(id_, F.lit("/"), first.cast("string"), F.col("strand"), F.lit("/e"), F.bround(power).cast("long").cast("string"))
    return fts.filter(data.isNotNull()).select("ord", id_.alias("id"), F.upper(data).alias("data"))


def query_features(fts: DataFrame) -> DataFrame:
    """Hits as features of their query; qstart and qend give range and strand, the hit's sequence is the name."""
    first, last = (meta_get("meta_json", k).cast("long") for k in ("qstart", "qend"))
    strand = F.when(first > last, "-").when(first < last, "+").otherwise(".")
    locs = F.array(L.location(F.least(first, last) - 1, F.greatest(first, last), strand))
    seqid = F.coalesce(meta_get("meta_json", "qseqid"), F.col("seqid"))
    name = F.coalesce(meta_get("meta_json", "sseqid"), F.col("name"))
    return with_range(fts.select(*(c for c in fts.columns if c not in ("locs", "seqid", "name")), locs.alias("locs"), seqid.alias("seqid"), name.alias("name")))


def merged_features(seqs_with_offsets: DataFrame, attached: DataFrame) -> DataFrame:
    """Features of sequences, moved to where their sequence lies in the merged one.

    seqs_with_offsets: what merge_offsets() gives; attached: features with seq_ord, what attach() gives.
    """
    at = seqs_with_offsets.select(F.col("ord").alias("seq_ord"), "offset")
    moved = attached.join(at, "seq_ord").withColumn("locs", L.shift_locations(F.col("locs"), F.col("offset")))
    return with_range(moved).drop("offset")


def translated_features(attached: DataFrame, proteins: DataFrame) -> DataFrame:
    """Features on translated sequences: clipped to three times the protein's length, places divided by three.

    proteins: translated sequences by ord; attached: features with seq_ord.
    """
    size = proteins.select(F.col("ord").alias("seq_ord"), F.length("data").alias("_aa"))
    joined = attached.join(size, "seq_ord")
    clipped = L.clip_locations(F.col("locs"), F.lit(0), F.col("_aa") * 3)
    third = F.transform(clipped, lambda x: L.location(F.floor(x["start"] / 3), F.floor(x["stop"] / 3), x["strand"], x["defect"], x["meta_json"]))
    whole = F.filter(third, lambda x: x["start"] < x["stop"])
    return with_range(joined.withColumn("locs", whole).filter(F.size("locs") > 0)).drop("_aa")


def annotation_rows(fts: DataFrame, seqs: DataFrame, inner: str = "-", outer: str = ".", split: str = "|") -> DataFrame:
    """(id, row): each sequence's features as an annotation row; a feature's name stands in its middle."""
    from ..sources.parsers import features_to_row

    own = fts.groupBy("seqid").agg(F.sort_array(F.collect_list(F.struct("start", "stop", F.coalesce("name", F.lit("")).alias("name")))).alias("items"))
    joined = own.join(seqs.select("id", F.length("data").alias("size")), F.col("seqid") == F.col("id")).select("id", "size", "items")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [features_to_row([(x["start"], x["stop"], x["name"]) for x in items], size, inner, outer, split) for size, items in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.string())], names=["id", "row"])

    return joined.mapInArrow(run, "id string, row string")


def raw_lines(fts: DataFrame) -> DataFrame:
    """(ord, k, line): one line for each location: type, start, stop, strand, name, id and seqid, a dot for what lacks."""
    dot = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(".")) if c in fts.columns else F.lit(".")
    each = fts.select("ord", *(dot(c).alias(c) for c in ("type", "name", "id", "seqid")), F.posexplode("locs").alias("k", "loc"))
    fields = ["type", F.col("loc.start").cast("string"), F.col("loc.stop").cast("string"), "loc.strand", "name", "id", "seqid"]
    return each.select("ord", "k", F.concat_ws(" ", *fields).alias("line"))


def replace_items(df: DataFrame, new: DataFrame) -> DataFrame:
    """df with the rows of new in place of those with the same ord."""
    return df.join(new.select("ord").distinct(), "ord", "left_anti").unionByName(new.select(*df.columns))
