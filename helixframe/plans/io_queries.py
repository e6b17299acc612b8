"""Queries over sources, sinks, the FASTA index, tables and streams: what is written in a format comes back by its reader.

Each query writes a derived table to a fresh folder beside the session's shared files, reads it back, and gives what the
SQL makes of the same table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, sequence, strings
from ..functions import locations as L
from ..operators import frames, intervals, joins, match, orf, rows
from ..sources import fastaindex, io, writers
from ..streaming import files
from . import derive
from .derive import FTS, PROTEINS, SEQS
from .queries import QUERIES, Query, codon_sql


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors see; under the warehouse where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/io-{uuid.uuid4().hex}"


def written(df: DataFrame, fmt: str, **options) -> str:
    """The folder to which df has been written in the format."""
    path = f"{shared_folder(df.sparkSession)}.{fmt}"
    writers.write(df, path, fmt, **options)
    return path


def lines_written(df: DataFrame, name: str, order: list[str] | None = None) -> str:
    """The folder to which a one-column table of lines or records has been written as text."""
    path = f"{shared_folder(df.sparkSession)}.{name}"
    (df.orderBy(*order) if order else df).select("value").write.text(path)
    return path


# sequences


@query(f"with {SEQS} select id, md5(data) as data, case when regexp_matches(data, '[^ACGTRYSWKMBDHVNU.-]') then 'aa' else 'nt' end as type from seqs")
def io_fasta(spark, sf):
    path = written(derive.seqs(spark, sf), "fasta")
    return io.read(spark, path).select("id", F.md5("data").alias("data"), "type")


@query("select 'db' || doc_id as id, 'x|gb|db' || doc_id || '| from ' || coalesce(source, '') as header from documents")
def io_fasta_headers(spark, sf):
    d = derive.table(spark, sf, "documents")
    header = F.concat(F.lit("x|gb|db"), F.col("doc_id"), F.lit("| from "), F.coalesce("source", F.lit("")))
    path = lines_written(d.select(F.concat(F.lit(">"), header, F.lit("\nACGT\nAC")).alias("value")), "fasta")
    return io.read(spark, path).filter("data = 'ACGTAC'").select("id", "header")


_RECORD = """e as (select event_id as n, 1 + event_id % 20 as a, 41 + user_id % 50 as b, user_id from events)"""


def _records(spark, sf) -> DataFrame:
    e = derive.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("n"), (1 + F.col("event_id") % 20).alias("a"), (41 + F.col("user_id") % 50).alias("b"), "user_id")


def _genbank(spark, sf) -> str:
    e = _records(spark, sf)
    at = F.concat(F.lit("complement("), F.col("a"), F.lit(".."), F.col("b"), F.lit(")"))
    at = F.when(F.col("n") % 3 == 0, at).otherwise(F.concat(F.lit("join("), F.col("a"), F.lit(".."), F.col("a") + 2, F.lit(","), F.col("a") + 9, F.lit(".."), F.col("b"), F.lit(")")))
    text = F.concat(F.lit("LOCUS       R"), F.col("n"), F.lit(" 100 bp DNA\nACCESSION   R"), F.col("n"), F.lit("\nFEATURES             Location/Qualifiers\n     CDS             "), at, F.lit('\n                     /gene="g'), F.col("user_id"), F.lit('"\nORIGIN\n        1 '), F.repeat(F.lit("acgta acgtt "), F.lit(10)), F.lit("\n//"))
    return lines_written(e.select(text.alias("value")), "gb")


@query(f"with {_RECORD} select 'R' || n as id, md5(repeat('ACGTAACGTT', 10)) as data from e")
def io_genbank(spark, sf):
    return io.read(spark, _genbank(spark, sf)).select("id", F.md5("data").alias("data"))


@query(f"""with {_RECORD} select 'R' || n as seqid, 'CDS' as type, 'g' || user_id as name, a - 1 as start, b as stop, case when n % 3 = 0 then '-' else '+' end as strand,
    case when n % 3 = 0 then 1 else 2 end as n_locs from e""")
def io_genbank_fts(spark, sf):
    found = io.read_fts(spark, _genbank(spark, sf))
    return found.select("seqid", "type", "name", "start", "stop", "strand", F.size("locs").alias("n_locs"))


@query(f"with {_RECORD} select 'E' || n as id, md5(repeat('ACGTAACGTT', 10)) as data from e")
def io_embl(spark, sf):
    e = _records(spark, sf)
    text = F.concat(F.lit("ID   E"), F.col("n"), F.lit("; SV 1; linear; DNA; STD; 100 BP.\nAC   E"), F.col("n"), F.lit("; X;\nFT   gene            "), F.col("a"), F.lit(".."), F.col("b"), F.lit("\nSQ   Sequence 100 BP;\n     "), F.repeat(F.lit("acgta acgtt "), F.lit(10)), F.lit("100\n//"))
    return io.read(spark, lines_written(e.select(text.alias("value")), "embl")).select("id", F.md5("data").alias("data"))


_ALIGNED = f"{PROTEINS}, widest as (select max(length(data)) as w from proteins), aligned as (select id, data || repeat('-', w - length(data)) as data, length(data) as n from proteins, widest)"


def _aligned(spark, sf) -> DataFrame:
    """The proteins, each filled up with gaps to the length of the longest."""
    p = derive.proteins(spark, sf)
    widest = p.agg(F.max(F.length("data")).alias("w"))  # one row
    return p.join(F.broadcast(widest), how="cross").select("ord", "id", F.concat("data", F.repeat(F.lit("-"), F.col("w") - F.length("data"))).alias("data"), F.length("data").alias("n"))


@query(f"with {_ALIGNED} select id, data from aligned")
def io_clustal(spark, sf):
    return io.read(spark, written(_aligned(spark, sf).drop("n"), "clustal")).select("id", "data")


@query(f"with {_ALIGNED} select id, data, n from aligned")
def io_stockholm(spark, sf):
    meta = F.to_json(F.struct(F.struct(F.col("n").cast("string").alias("LEN")).alias("GS")))
    aligned = _aligned(spark, sf).select("ord", "id", "data", meta.alias("meta_json"))
    return io.read(spark, written(aligned, "stockholm")).select("id", "data", frames.meta_get("meta_json", "GS.LEN").cast("long").alias("n"))


@query(f"with {PROTEINS} select ord, id, md5(data) as data, length(data) as n from proteins")
def io_sjson(spark, sf):
    p = derive.proteins(spark, sf).withColumn("meta_json", F.to_json(F.struct(F.length("data").alias("n"))))
    found = io.read(spark, written(p, "sjson")).select("id", F.md5("data").alias("data"), frames.meta_get("meta_json", "n").cast("long").alias("n"))
    return p.select("ord", "id").join(found, "id").select("ord", "id", "data", "n")


@query(f"with {PROTEINS} select id, length(data) as n from proteins")
def io_from_string(spark, sf):
    text = writers.to_string(derive.proteins(spark, sf), "fasta")  # the benchmark is a bounded table
    return io.from_string(spark, text).select("id", F.length("data").cast("long").alias("n"))


@query(f"with {PROTEINS} select id, length(data) as n from proteins")
def io_stream(spark, sf):
    path = written(derive.proteins(spark, sf), "fasta")
    target, state = shared_folder(spark), shared_folder(spark)
    stream = files.stream(spark, path, "fasta").writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(target)
    stream.awaitTermination()
    return spark.read.parquet(target).select("id", F.length("data").cast("long").alias("n"))


# features


def _whole(spark, sf) -> DataFrame:
    return derive.with_locs(derive.fts(spark, sf)).withColumn("id", F.lit(None).cast("string")).withColumn("name", F.concat(F.lit("n;="), F.col("ord"))).withColumn("meta_json", F.to_json(F.struct((F.col("start") % 7).cast("string").alias("mod"))))


_FTS_ROWS = "select seqid, type, start, stop, strand, 'n;=' || ord as name, cast(start % 7 as varchar) as mod from fts"


@query(f"with {FTS} {_FTS_ROWS}")
def io_gff(spark, sf):
    found = io.read_fts(spark, written(_whole(spark, sf), "gff"))
    return found.select("seqid", "type", "start", "stop", "strand", "name", frames.meta_get("meta_json", "mod").alias("mod"))


@query(f"with {FTS} select seqid, type, start, stop, strand, 1e-5 as evalue, cast(start % 7 as varchar) as mod from fts")
def io_gff_evalue(spark, sf):
    f = derive.fts(spark, sf)
    text = F.concat_ws("\t", "seqid", F.lit("x"), "type", (F.col("start") + 1).cast("string"), F.col("stop").cast("string"), F.lit("."), "strand", F.lit("."), F.concat(F.lit("E_value=1e-5;mod="), F.col("start") % 7))
    path = lines_written(f.select(text.alias("value")), "gff")
    found = io.read_fts(spark, path, "gff")
    return found.select("seqid", "type", "start", "stop", "strand", "evalue", frames.meta_get("meta_json", "mod").alias("mod"))


@query(f"with {FTS} select seqid, type, start, stop, strand, cast(start % 7 as varchar) as mod from fts")
def io_gtf(spark, sf):
    found = io.read_fts(spark, written(_whole(spark, sf), "gtf"), "gtf")
    return found.select("seqid", "type", "start", "stop", "strand", frames.meta_get("meta_json", "mod").alias("mod"))


@query(f"with {FTS} select seqid, type, start, stop, strand from fts")
def io_tsv(spark, sf):
    path = written(derive.fts(spark, sf), "tsv", keys="seqid type start stop strand")
    return io.read_fts(spark, path).select("seqid", "type", "start", "stop", "strand")


@query(f"with {FTS} select type, start, stop, strand, stop - start as n from fts")
def io_csv(spark, sf):
    path = written(derive.fts(spark, sf), "csv", keys="type start len strand")
    return io.read_fts(spark, path).select("type", "start", "stop", "strand", (F.col("stop") - F.col("start")).alias("n"))


_HITS = f"with {FTS} select seqid, 'q' || ord as name, start, stop, case when stop - start = 1 then '.' else strand end as strand, cast(ord % 100 + 0.5 as double) as score, 1e-3 as evalue, 'T' || (ord % 9) as taxid, cast(50.0 + ord % 50 as double) as pident from fts"


def _hits(spark, sf) -> DataFrame:
    f = derive.fts(spark, sf)
    low, high = (F.col("start") + 1).cast("string"), F.col("stop").cast("string")
    minus = F.col("strand") == "-"
    return f.select("ord", "seqid", F.concat(F.lit("q"), F.col("ord")).alias("query"), F.when(minus, high).otherwise(low).alias("first"), F.when(minus, low).otherwise(high).alias("last"), (50 + F.col("ord") % 50).cast("string").alias("pident"), (F.col("ord") % 100 + 0.5).cast("string").alias("bits"), F.concat(F.lit("T"), F.col("ord") % 9).alias("taxid"), (F.col("stop") - F.col("start")).cast("string").alias("n"))


def _hit_rows(found: DataFrame, taxid: str) -> DataFrame:
    return found.select("seqid", "name", "start", "stop", "strand", "score", "evalue", frames.meta_get("meta_json", taxid).alias("taxid"), frames.meta_get("meta_json", "pident").cast("double").alias("pident"))


@query(_HITS)
def io_blast(spark, sf):
    h = _hits(spark, sf)
    lines = h.select("ord", F.concat_ws("\t", "query", "seqid", "pident", F.lit("1"), "n", "first", "last", F.lit("1e-3"), "bits", "taxid").alias("value"))
    head = "# BLASTN 2.13.0+\n# Fields: query id, subject id, % identity, q. start, q. end, s. start, s. end, evalue, bit score, subject tax id"
    return _hit_rows(io.read_fts(spark, _headed(lines, head, "blastn"), "blast"), "staxid")


@query(_HITS)
def io_mmseqs(spark, sf):
    h = _hits(spark, sf)
    lines = h.select("ord", F.concat_ws("\t", "query", "seqid", "pident", F.lit("1"), "n", "first", "last", F.lit("1e-3"), "bits", "taxid").alias("value"))
    head = "query\ttarget\tpident\tqstart\tqend\ttstart\ttend\tevalue\tbits\ttaxid"
    return _hit_rows(io.read_fts(spark, _headed(lines, head, "m8")), "taxid")


def _headed(lines: DataFrame, head: str, name: str) -> str:
    """Text files of the lines, each led by head."""

    def lead(batches):
        import pyarrow as pa

        first = True
        for batch in batches:
            values = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_pydict({"value": ([head] if first else []) + values})
            first = False

    path = f"{shared_folder(lines.sparkSession)}.{name}"
    lines.select("value").mapInArrow(lead, "value string").write.text(path)
    return path


@query(f"with {FTS} select seqid, 'q' || ord as name, start, stop, case when stop - start = 1 then '+' else strand end as strand, cast(ord % 100 + 0.5 as double) as score, ord % 9 as qstart from fts")
def io_infernal(spark, sf):
    h = _hits(spark, sf)
    f = h.select(F.concat_ws(" ", "seqid", F.lit("-"), "query", F.lit("- cm"), (F.col("ord") % 9).cast("string"), F.lit("99"), "first", "last", F.when(F.col("first").cast("long") > F.col("last").cast("long"), "-").otherwise("+"), F.lit("no 1 0.5 0.0"), "bits", F.lit("1e-9 ! some text")).alias("value"))
    head = "#target name accession query name accession mdl mdl from mdl to seq from seq to strand trunc pass gc bias score E-value inc description of target\n#" + " ".join(["----"] * 18)
    found = io.read_fts(spark, _headed(f, head, "tblout"), "infernal")
    return found.select("seqid", "name", "start", "stop", "strand", "score", frames.meta_get("meta_json", "qstart").cast("long").alias("qstart"))


@query(f"with {FTS} select seqid, start, stop, strand, 'M' || (ord % 5) as name from fts")
def io_meme(spark, sf):
    f = derive.fts(spark, sf)
    block = F.concat(F.lit("MOTIF M"), F.col("ord") % 5, F.lit(" MEME-1 width = "), F.col("stop") - F.col("start"), F.lit(" sites = 1 E-value = 1e-4\n\tMotif sites sorted by position p-value\n----------------------\nSequence name Strand Start P-value Site\n------------- ------ ----- ------- ----\n"), F.col("seqid"), F.lit(" "), F.col("strand"), F.lit(" "), F.col("start") + 1, F.lit(" 1.0e-3 ACGT CCCC GGGG\n----------------------\n"))
    found = io.read_fts(spark, lines_written(f.select(block.alias("value")), "txt"), "meme_txt")
    return found.select("seqid", "start", "stop", "strand", "name")


@query(f"with {FTS} select seqid, type, start, stop, strand from fts where type = 'RF'")
def io_gff_filter(spark, sf):
    path = written(_whole(spark, sf), "gff")
    return io.read_fts(spark, path, filt=("RF",), filt_fast="rf").select("seqid", "type", "start", "stop", "strand")


@query("select format, case format when 'gff' then 'fts' when 'tsv' then 'fts' else 'seqs' end as what from (values ('fasta'), ('gff'), ('tsv'), ('genbank'), ('stockholm'), ('sjson')) t(format)")
def io_detect(spark, sf):
    """Formats found by content, and the same by extension where there is one."""
    p = derive.proteins(spark, sf)
    f = _whole(spark, sf)
    paths = [(written(p, "fasta"), "seqs"), (written(f, "gff"), "fts"), (written(f, "tsv"), "fts"), (_genbank(spark, sf), "seqs"), (written(p, "stockholm"), "seqs"), (written(p, "sjson"), "seqs")]
    names = [(io.detect(spark, path, what), what) for path, what in paths]
    if [n for n, _ in names] != [io.detect_ext(path, what) for path, what in paths]:
        raise ValueError("content and extension tell different formats")
    return spark.createDataFrame(names, "format string, what string")


@query(f"with {FTS} select ord, 0 as k, type || ' ' || start || ' ' || stop || ' ' || strand || ' n;=' || ord || ' . ' || seqid as line from fts")
def fts_raw(spark, sf):
    return frames.raw_lines(_whole(spark, sf))


# index


@query(f"with {SEQS} select id, md5(data) as data from seqs")
def index_fetch(spark, sf):
    """Every record, fetched by id from the saved index; the requests are the documents' ids, which are a list at hand."""
    s = derive.seqs(spark, sf)
    saved = shared_folder(spark)
    fastaindex.save_index(fastaindex.build_index(spark, written(s, "fasta")), saved)
    ids = [r["id"] for r in s.select("id").toLocalIterator()]
    return fastaindex.fetch(spark.read.parquet(saved), ids).select("id", F.md5("data").alias("data"))


@query(f"with {SEQS} select id, substr(data, 6, 15) as data from seqs")
def index_fetch_ranges(spark, sf):
    s = derive.seqs(spark, sf)
    index = fastaindex.build_index(spark, written(s, "fasta"))
    asked = [(r["id"], 5, 20) for r in s.select("id").toLocalIterator()]
    return fastaindex.fetch(index, asked).select("id", "data")


@query(f"with {SEQS}, {PROTEINS}, every as (select data from seqs union all select data from proteins) select count(*) as n, cast(sum(length(data)) as bigint) as letters from every")
def index_add(spark, sf):
    """The index of two sets of files, the second one added."""
    index = fastaindex.build_index(spark, written(derive.seqs(spark, sf), "fasta"))
    both = fastaindex.add_files(index, written(derive.proteins(spark, sf).withColumn("id", F.concat(F.lit("p"), "id")), "fasta"))
    got = fastaindex.fetch(both, [r["seqid"] for r in both.select("seqid").toLocalIterator()])
    return got.agg(F.count("*").alias("n"), F.sum(F.length("data")).alias("letters"))


@query(f"with {SEQS} select count(*) as n from seqs")
def index_info(spark, sf):
    index = fastaindex.build_index(spark, written(derive.seqs(spark, sf), "fasta"))
    return fastaindex.index_info(index).select("n")


# tables, metadata


@query(f"with {FTS} select type, start, stop, strand, stop - start as len from fts")
def fts_tolists(spark, sf):
    return frames.columns(derive.fts(spark, sf), "type start stop strand len")


@query("select event_id as ord, cast(user_id as varchar) as seqid, event_type as type, event_id % 50 as start, event_id % 50 + 10 as stop, '{\"event_type\":\"' || event_type || '\",\"v\":' || (user_id % 3) || '}' as meta_json from events")
def fts_from_table(spark, sf):
    e = derive.table(spark, sf, "events").select(F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("seqid"), "event_type", (F.col("event_id") % 50 + 1).alias("start"), F.lit(10).alias("len"), (F.col("user_id") % 3).alias("v"))
    found = frames.from_table(e, ftype="event_type", one_based=True)
    return found.select("ord", "seqid", "type", "start", "stop", "meta_json")


@query(f"with {FTS} select ord, start, cast(defect as integer) as defect, strand from (select ord, -stop as start, case start % 4 when 0 then 0 when 1 then 2 when 2 then 1 else 3 end as defect, case strand when '+' then '-' else '+' end as strand from fts)")
def fts_defect_reverse(spark, sf):
    f = derive.fts(spark, sf)
    locs = F.array(L.location(F.col("start"), F.col("stop"), F.col("strand"), (F.col("start") % 4).cast("int")))
    return intervals.reverse_features(f.withColumn("locs", locs), 0).select("ord", "start", "defect", "strand")


@query(f"with {FTS}, n as (select *, lead(start) over w as s2, lead(stop) over w as e2 from fts window w as (partition by seqid order by ord)) select ord, case when start < s2 or start = s2 and stop < e2 then -1 when start = s2 and stop = e2 then 0 else 1 end as c from n where s2 is not null")
def fts_compare(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("seqid").orderBy("ord")
    n = derive.fts(spark, sf).select("ord", "start", "stop", F.lead("start").over(w).alias("s2"), F.lead("stop").over(w).alias("e2")).filter("s2 is not null")
    return n.select("ord", L.compare(F.col("start"), F.col("stop"), F.col("s2"), F.col("e2")).alias("c"))


@query(f"with {SEQS} select id, md5(data || reverse(data)) as data from seqs")
def seq_concatenate(spark, sf):
    s = derive.seqs(spark, sf)
    return joins.concatenate(s, s.withColumn("data", sequence.reverse("data"))).select("id", F.md5("data").alias("data"))


@query(f"with {FTS} select 3 as seq_ord, ord, start from fts")
def attach_one(spark, sf):
    return joins.attach_one(derive.seqs(spark, sf), derive.fts(spark, sf), 3).select(F.col("seq_ord").cast("int").alias("seq_ord"), "ord", "start")


@query(f"with {SEQS}, {FTS} select s.ord as seq_ord, f.ord, f.start from fts f join seqs s on s.id = f.seqid")
def attach_more(spark, sf):
    s, f = derive.seqs(spark, sf), derive.fts(spark, sf)
    old = joins.attach(s, f.filter("type = 'RF'"))
    return joins.attach_more(old, s, f.filter("type <> 'RF'")).select("seq_ord", "ord", "start")


@query(f"with {SEQS} select id, length(data) as len, cast(substr(data, 1, 1) = 'A' as boolean) as a from seqs where length(data) < 300 or substr(data, 1, 1) = 'A'")
def seq_select_or(spark, sf):
    s = derive.seqs(spark, sf)
    either = rows.select(s, len_lt=300).unionByName(s.filter(F.length("data") >= 300).filter(strings.startswith("data", "A")))
    return either.select("id", F.length("data").cast("long").alias("len"), strings.startswith("data", "A").alias("a"))


@query(f"with {SEQS} select ord, id from seqs where ord = 5 or ord = (select count(*) from seqs) - 2")
def seq_item(spark, sf):
    s = derive.seqs(spark, sf)
    return rows.item(s, 5).unionByName(rows.item(s, -2)).select("ord", "id")


@query(f"""with {SEQS} select id, md5(translate(data, 'ACGT', 'RYMK')) as mapped, md5(case when length(data) < 400 then repeat('*', (400 - length(data)) // 2) || data || repeat('*', 400 - length(data) - (400 - length(data)) // 2) else data end) as centred,
    case when starts_with(data, 'A') then length(data) - 1 else length(data) end as n, regexp_full_match(data, '[A-Za-z]+') as alpha, data <> '' as upper_ from seqs""")
def seq_str_more(spark, sf):
    s = derive.seqs(spark, sf)
    centred = strings.center("data", 400, "*")
    cut = strings.removeprefix("data", "A")
    return s.select("id", F.md5(strings.translate("data", strings.maketrans("ACGT", "RYMK"))).alias("mapped"), F.md5(centred).alias("centred"), F.length(cut).cast("long").alias("n"), strings.isalpha("data").alias("alpha"), strings.isupper("data").alias("upper_"))


@query(f"with {SEQS} select id, md5(translate(translate(data, 'ACGT', 'RYBN'), 'RYBN', 'YRVN')) as comp, md5(translate(replace(data, 'T', 'U'), 'ACGU', 'UGCA')) as rna from seqs where strpos(data, 'T') > 0")
def seq_complement_iupac(spark, sf):
    s = derive.seqs(spark, sf).filter(F.contains("data", F.lit("T")))
    mixed = F.translate("data", "ACGT", "RYBN")
    return s.select("id", F.md5(sequence.complement(mixed)).alias("comp"), F.md5(sequence.complement(F.replace("data", F.lit("T"), F.lit("U")))).alias("rna"))


_IUPAC = ", ".join(f"('{a}', '{b}')" for a, every in dims.IUPAC.items() for b in every)
_EVERY_CODE = ", ".join(f"({n}, '{''.join(dims.genetic_code(n).amino[a + b + c] for a in 'TCAG' for b in 'TCAG' for c in 'TCAG')}', '{' '.join(sorted(dims.genetic_code(n).starts))}')" for n in dims.GENETIC_CODES)
_CODES = f"""code(tt, line, starts) as (values {_EVERY_CODE}), base(b, k) as (values ('T', 0), ('C', 1), ('A', 2), ('G', 3)),
    plain as (select tt, x.b || y.b || z.b as codon, substr(line, 16 * x.k + 4 * y.k + z.k + 1, 1) as aa, starts from code, base x, base y, base z)"""


@query(f"with {_CODES} select tt, codon, aa, list_contains(string_split(starts, ' '), codon) as is_start from plain")
def gcode_all(spark, sf):
    return dims.gcode_table(spark).filter("codon rlike '^[ACGT]{3}$'").select("tt", "codon", "aa", "is_start")


@query(f"""with {_CODES}, iupac(letter, b) as (values {_IUPAC}),
    read as (select p.tt, x.letter || y.letter || z.letter as codon, min(p.aa) as low, max(p.aa) as high, bool_or(list_contains(string_split(p.starts, ' '), p.codon)) as is_astart
        from plain p join iupac x on x.b = substr(p.codon, 1, 1) join iupac y on y.b = substr(p.codon, 2, 1) join iupac z on z.b = substr(p.codon, 3, 1) group by all)
    select tt, codon, low as aa, is_astart from read where low = high and regexp_matches(codon, '[^ACGT]')""")
def gcode_ambiguous(spark, sf):
    return dims.gcode_table(spark).filter("not codon rlike '^[ACGT]{3}$' and aa <> 'X'").select("tt", "codon", "aa", "is_astart")


@query("select letter, string_agg(b, '' order by b) as bases from (values " + _IUPAC + ") t(letter, b) group by letter")
def iupac_codes(spark, sf):
    return spark.createDataFrame(list(dims.IUPAC.items()), "letter string, bases string")


# features, alignment, frames in further modes


@query(f"""with {FTS}, d as (select seqid, type, start, stop, strand, min(ord) as ord from fts group by all),
    r as (select *, max(stop) over (order by start, stop desc, ord rows between unbounded preceding and 1 preceding) as reach from d)
    select ord, seqid, start, stop from r where reach is null or reach < stop""")
def fts_remove_nested_global(spark, sf):
    return intervals.remove_nested(derive.fts(spark, sf), by=None).select("ord", "seqid", "start", "stop")


def _aligned_sql(anchor: str, crop: int) -> str:
    return f"""with {FTS}, a as (select seqid, {anchor}((start + stop) // 2, ord) as anchor from fts group by seqid), m as (select max(anchor) as at_ from a),
    moved as (select f.seqid, f.ord, f.start + at_ - anchor as start, f.stop + at_ - anchor as stop, at_ from fts f join a on a.seqid = f.seqid, m)
    select seqid, ord, greatest(start, at_ - {crop}) as start, least(stop, at_ + {crop}) as stop from moved where start < at_ + {crop} and stop > at_ - {crop}"""


@query(_aligned_sql("arg_min", 200))
def align_groups_first_crop(spark, sf):
    return intervals.align_groups(derive.fts(spark, sf), align="first", crop=200).select("seqid", "ord", "start", "stop")


@query(_aligned_sql("arg_max", 300))
def align_groups_last_crop(spark, sf):
    return intervals.align_groups(derive.fts(spark, sf), align="last", crop=300).select("seqid", "ord", "start", "stop")


_FORWARD = codon_sql("seqs", "ord, id")


@query(f"""with {SEQS}, {_FORWARD}, stops as (select ord, pos % 3 as f, pos + 3 as e from p where codon in ('TAG', 'TAA', 'TGA')),
    s as (select p.ord, p.pos % 3 as f, p.pos, seqlen, (select min(e) from stops t where t.ord = p.ord and t.f = p.pos % 3 and t.e > p.pos) as e from p where codon = 'ATG'),
    n as (select ord, f, min(pos) as start, coalesce(e, seqlen - (seqlen - f) % 3) as stop, e is not null as has_stop from s group by ord, f, e, seqlen)
    select ord as seq_ord, start, stop, f as rf, has_stop from n where start < stop""")
def orfs_no_stop(spark, sf):
    found = orf.find_orfs(derive.seqs(spark, sf), rf="fwd", need_stop=False)
    return found.select("seq_ord", "start", "stop", F.col("rf").cast("long").alias("rf"), "has_stop")


@query(f"""with {SEQS}, {_FORWARD}, stops as (select ord, pos % 3 as f, pos + 3 as e from p where codon in ('TAG', 'TAA', 'TGA')),
    s as (select p.ord, p.pos % 3 as f, p.pos, (select min(e) from stops t where t.ord = p.ord and t.f = p.pos % 3 and t.e > p.pos) as e from p where codon = 'ATG')
    select ord as seq_ord, count(*) as n, cast(sum(g) as bigint) as gaps from (select ord, f, e, min(pos) as b, 2 * (e - min(pos)) as g from s where e is not null group by ord, f, e) group by ord""")
def orfs_gapped(spark, sf):
    """A gap behind every letter changes no frame: the same open frames, twice as long less the gap behind the last letter."""
    s = derive.seqs(spark, sf)
    gapped = s.withColumn("data", F.regexp_replace("data", "(.)", "$1-"))
    found = orf.find_orfs(gapped, rf="fwd", gap="-")
    return found.groupBy("seq_ord").agg(F.count("*").alias("n"), F.sum(F.col("stop") - F.col("start") + 1).alias("gaps"))


@query(f"with {SEQS}, m as (select ord, len(regexp_extract_all(data, 'GATC')) as n from seqs) select ord as seq_ord, cast(n as bigint) as n from m where n > 0")
def match_gapped(spark, sf):
    """A gap behind every letter hides no match."""
    s = derive.seqs(spark, sf).withColumn("data", F.regexp_replace("data", "(.)", "$1-"))
    return match.match(s, "GATC", rf=None, gap="-").groupBy("seq_ord").agg(F.count("*").alias("n"))
