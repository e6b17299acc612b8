"""Writers. Line formats are built by column expressions and written by Spark; alignments pass the driver row by row."""

from __future__ import annotations

import json
import warnings
from urllib.parse import quote

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import col
from .io import SJSON_BANNER, detect_ext

#: Characters that GFF3 quotes: percent, ampersand, comma, semicolon, equals, delete and controls.
_GFF_UNSAFE = "%&,;=\x7f" + "".join(map(chr, range(32)))
_GFF_QUOTED = {c: f"%{ord(c):02X}" for c in _GFF_UNSAFE}


def fasta_line(id_: Column | str = "id", data: Column | str = "data", header: Column | str | None = "header") -> Column:
    """>id, the rest of the header, and the data on one line."""
    id_ = F.coalesce(col(id_), F.lit(""))
    rest = F.lit("") if header is None else F.coalesce(F.regexp_extract(col(header), r"^\S+\s+(.*)$", 1), F.lit(""))
    head = F.rtrim(F.concat(F.lit(">"), id_, F.lit(" "), rest))
    return F.concat(head, F.lit("\n"), col(data))


def _gff_quote(c: Column) -> Column:
    out = c
    for letter, code in _GFF_QUOTED.items():
        out = F.replace(out, F.lit(letter), F.lit(code))
    return out


def gff_lines(fts: DataFrame, source: str = ".") -> DataFrame:
    """(ord, k, line) of GFF3: a line for each location, joined by an ID; an ID that lacks is a digest of the feature."""
    meta = F.from_json("meta_json", "map<string,string>") if "meta_json" in fts.columns else F.create_map().cast("map<string,string>")
    id_ = F.col("id") if "id" in fts.columns else F.lit(None).cast("string")
    digest = F.substring(F.md5(F.concat_ws("|", "seqid", "type", F.to_json("locs"))), 1, 10)
    own_id = F.coalesce(id_, F.when(F.size("locs") > 1, digest))
    base = fts.withColumn("_meta", F.coalesce(meta, F.create_map().cast("map<string,string>"))).withColumn("_id", own_id)
    rest = F.map_filter("_meta", lambda k, v: ~k.isin("ID", "Name", "source", "phase") & v.isNotNull())
    pairs = F.transform(F.array_sort(F.map_entries(rest)), lambda e: F.concat(_gff_quote(e["key"]), F.lit("="), F.when(e["value"].startswith("["), F.array_join(F.transform(F.from_json(e["value"], "array<string>"), _gff_quote), ",")).otherwise(_gff_quote(e["value"]))))
    name = F.col("name") if "name" in fts.columns else F.lit(None).cast("string")
    attributes = F.concat_ws(";", F.concat(F.lit("ID="), _gff_quote(F.col("_id"))), F.concat(F.lit("Name="), _gff_quote(name)), F.array_join(pairs, ";"))
    score = F.coalesce(F.col("score").cast("string"), F.lit(".")) if "score" in fts.columns else F.lit(".")
    lines = base.select("ord", "seqid", "type", score.alias("score"), F.regexp_replace(attributes, ";$", "").alias("attributes"), F.coalesce(F.try_element_at("_meta", F.lit("source")), F.lit(source)).alias("source"), F.coalesce(F.try_element_at("_meta", F.lit("phase")), F.lit(".")).alias("phase"), F.posexplode("locs").alias("k", "loc"))
    fields = [F.coalesce(_gff_quote(F.col("seqid")), F.lit(".")), F.col("source"), F.coalesce(F.col("type"), F.lit(".")), (F.col("loc.start") + 1).cast("string"), F.col("loc.stop").cast("string"), F.col("score"), F.col("loc.strand"), F.col("phase"), F.when(F.col("attributes") == "", ".").otherwise(F.col("attributes"))]
    return lines.select("ord", "k", F.concat_ws("\t", *fields).alias("line"))


def gtf_lines(fts: DataFrame) -> DataFrame:
    """(ord, k, line) of GTF: the first location of each feature."""
    meta = F.coalesce(F.from_json("meta_json", "map<string,string>"), F.create_map().cast("map<string,string>"))
    base = fts.withColumn("_meta", meta)
    rest = F.map_filter("_meta", lambda k, v: ~k.isin("source", "frame") & v.isNotNull())
    pairs = F.transform(F.array_sort(F.map_entries(rest)), lambda e: F.concat(e["key"], F.lit(' "'), e["value"], F.lit('";')))
    loc = F.col("locs")[0]
    score = F.coalesce(F.col("score").cast("string"), F.lit(".")) if "score" in fts.columns else F.lit(".")
    fields = [F.coalesce("seqid", F.lit(".")), F.coalesce(F.try_element_at("_meta", F.lit("source")), F.lit(".")), F.coalesce("type", F.lit(".")), (loc["start"] + 1).cast("string"), loc["stop"].cast("string"), score, loc["strand"], F.coalesce(F.try_element_at("_meta", F.lit("frame")), F.lit(".")), F.array_join(pairs, " ")]
    return base.select("ord", F.lit(0).alias("k"), F.concat_ws("\t", *fields).alias("line"))


def table_lines(fts: DataFrame, keys: str = "type start stop strand", sep: str = "\t") -> DataFrame:
    names = keys.split()
    values = [F.coalesce((F.col("stop") - F.col("start") if k == "len" else F.col(k)).cast("string"), F.lit("")) for k in names]
    return fts.select("ord", F.lit(0).alias("k"), F.concat_ws(sep, *values).alias("line"))


def clustal_text(rows: list[tuple[str, str]], width: int = 60) -> str:
    if len({len(d) for _, d in rows}) > 1:
        warnings.warn("sequences of an alignment differ in length", stacklevel=2)
    pad = max((len(i) for i, _ in rows), default=0) + 5
    out = ["CLUSTAL W multiple sequence alignment", ""]
    for at in range(0, max((len(d) for _, d in rows), default=0), width):
        out += [i.ljust(pad) + d[at : at + width] for i, d in rows if d[at : at + width]] + [""]
    return "\n".join(out)


def stockholm_text(rows: list[tuple[str, str, dict]]) -> str:
    out = ["# STOCKHOLM 1.0"]
    basket = rows[0][2].get("basket", {}) if rows else {}
    out += [f"#=GF {k} {v}" for k, v in basket.get("GF", {}).items()]
    pad = max((len(i) for i, _, _ in rows), default=0) + 2
    for i, _, meta in rows:
        out += [f"#=GS {i} {k} {v}" for k, v in meta.get("GS", {}).items()]
    for i, data, meta in rows:
        out.append(i.ljust(pad) + data)
        out += [f"#=GR {i} {k} {v}" for k, v in meta.get("GR", {}).items()]
    out += [f"#=GC {k} {v}" for k, v in basket.get("GC", {}).items()]
    return "\n".join([*out, "//"]) + "\n"


HEADERS = {"gff": "##gff-version 3", "tsv": None, "csv": None}


def feature_lines(fts: DataFrame, fmt: str, **options) -> tuple[str | None, DataFrame]:
    """(header line, lines) of a line format for features."""
    if fmt == "gff":
        return "##gff-version 3", gff_lines(fts, **options)
    if fmt == "gtf":
        return None, gtf_lines(fts)
    if fmt in ("tsv", "csv"):
        sep = options.pop("sep", "\t" if fmt == "tsv" else ",")
        keys = options.pop("keys", "type start stop strand")
        return sep.join(keys.split()), table_lines(fts, keys, sep)
    raise ValueError(f"features aren't written as {fmt}")


def to_string(df: DataFrame, fmt: str, **options) -> str:
    """The whole table as text, in order; meant for what fits the driver."""
    if fmt == "fasta":
        rows = df.select("ord", fasta_line(header="header" if "header" in df.columns else None).alias("line")).orderBy("ord")
        return "".join(r["line"] + "\n" for r in rows.toLocalIterator())
    if fmt == "clustal":
        return clustal_text([(r["id"] or "", r["data"]) for r in df.orderBy("ord").toLocalIterator()])
    if fmt == "stockholm":
        has = "meta_json" in df.columns
        return stockholm_text([(r["id"] or "", r["data"], json.loads(r["meta_json"] or "{}") if has else {}) for r in df.orderBy("ord").toLocalIterator()])
    if fmt == "sjson":
        rows = [json.loads(r[0]) for r in df.orderBy("ord").select(F.to_json(F.struct(*df.columns))).toLocalIterator()]
        for r in rows:
            r["meta"] = json.loads(r.pop("meta_json", None) or "{}")
            for loc in r.get("locs", []):
                loc["meta"] = json.loads(loc.pop("meta_json", None) or "null")
        return json.dumps({"format": SJSON_BANNER, "seqs" if "data" in df.columns else "fts": rows})
    header, lines = feature_lines(df, fmt, **options)
    body = "".join(r["line"] + "\n" for r in lines.orderBy("ord", "k").toLocalIterator())
    return (f"{header}\n" if header else "") + body


def write(df: DataFrame, path: str, fmt: str | None = None, single: bool = False, mode: str = "error", **options) -> None:
    """Write sequences or features as text files under path; single=True keeps the order in one file.

    Line formats are written in parallel; headers lead each file, so every file can be read by itself.
    """
    fmt = fmt or detect_ext(path, "seqs" if "data" in df.columns else "fts")
    if fmt == "fasta":
        lines = df.select("ord", F.lit(0).alias("k"), fasta_line(header="header" if "header" in df.columns else None).alias("line"))
        header = None
    elif fmt in ("clustal", "stockholm", "sjson"):
        text = to_string(df, fmt, **options)
        df.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(mode).text(path)
        return
    else:
        header, lines = feature_lines(df, fmt, **options)
    ordered = lines.coalesce(1).sortWithinPartitions("ord", "k") if single else lines.sortWithinPartitions("ord", "k")
    if header is None:
        ordered.select(F.col("line").alias("value")).write.mode(mode).text(path)
        return

    def lead(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": ([header] if first else []) + values})
            first = False

    ordered.select("line").mapInArrow(lead, "value string").write.mode(mode).text(path)


__all__ = ["fasta_line", "feature_lines", "gff_lines", "gtf_lines", "quote", "table_lines", "to_string", "write"]


def write_archive(df: DataFrame, path: str, fmt: str, name: str | None = None, **options) -> None:
    """One file of the whole table in a zip or tar archive on the driver; meant for exports that fit it."""
    import io
    import tarfile
    import zipfile

    data = to_string(df, fmt, **options).encode()
    name = name or f"data.{fmt}"
    if path.endswith(".zip"):
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(name, data)
        return
    kind = path.rsplit(".", 1)[-1]
    with tarfile.open(path, f"w:{kind if kind in ('gz', 'bz2', 'xz') else 'gz' if kind == 'tgz' else ''}") as t:
        entry = tarfile.TarInfo(name)
        entry.size = len(data)
        t.addfile(entry, io.BytesIO(data))
