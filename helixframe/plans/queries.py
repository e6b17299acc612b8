"""One query for each operator over the derived tables, with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dims, sequence, strings
from ..functions import locations as L
from ..operators import counting, intervals, joins, match, orf, rows
from ..operators import translate as tr
from . import derive
from .derive import FTS, PROTEINS, SEQS, TURNS


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str


QUERIES: dict[str, Query] = {}


def query(sql: str):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = Query(f, sql)
        return f

    return add


# scalar sequence operators


@query(f"with {SEQS} select id, length(data) as len from seqs")
def seq_length(spark, sf):
    return derive.seqs(spark, sf).select("id", F.length("data").cast("long").alias("len"))


@query(f"""with {SEQS}, n as (select id, length(data) - length(translate(data, 'GC', '')) as gc, length(data) - length(translate(data, 'ATU', '')) as at_ from seqs)
    select id, case when gc + at_ > 0 then round(gc / (gc + at_), 9) else 0.0 end as gc from n""")
def seq_gc(spark, sf):
    return derive.seqs(spark, sf).select("id", F.round(sequence.gc_content("data"), 9).alias("gc"))


@query(f"""with {SEQS}, {PROTEINS}, both_ as (select 's' as src, id, data from seqs union all select 'p', id, data from proteins)
    select src, id, case when regexp_matches(data, '[^ACGTRYSWKMBDHVNU.-]') then 'aa' else 'nt' end as type from both_""")
def seq_type(spark, sf):
    both = derive.seqs(spark, sf).select(F.lit("s").alias("src"), "id", "data").unionByName(derive.proteins(spark, sf).select(F.lit("p").alias("src"), "id", "data"))
    return both.select("src", "id", sequence.sequence_type("data").alias("type"))


@query(f"with {SEQS} select id, md5(reverse(data)) as rev from seqs")
def seq_reverse(spark, sf):
    return derive.seqs(spark, sf).select("id", F.md5(sequence.reverse("data")).alias("rev"))


@query(f"with {SEQS} select id, md5(translate(data, 'ACGT', 'TGCA')) as comp from seqs")
def seq_complement(spark, sf):
    return derive.seqs(spark, sf).select("id", F.md5(sequence.complement("data")).alias("comp"))


@query(f"with {SEQS} select id, md5(reverse(translate(data, 'ACGT', 'TGCA'))) as rc from seqs")
def seq_rc(spark, sf):
    return derive.seqs(spark, sf).select("id", F.md5(sequence.reverse_complement("data")).alias("rc"))


@query(f"""with {SEQS} select id, substr(data, 11, 20) as mid, case when length(data) > 5 then substr(data, greatest(length(data) - 14, 1), length(data) - 5 - greatest(length(data) - 15, 0)) else '' end as tail,
    coalesce((select string_agg(substr(data, i, 1), '' order by i) from range(1, least(length(data), 30) + 1, 3) t(i)), '') as step from seqs""")
def seq_slice(spark, sf):
    s = derive.seqs(spark, sf)
    return s.select("id", sequence.slice_text("data", 10, 30).alias("mid"), sequence.slice_text("data", -15, -5).alias("tail"), sequence.slice_text("data", 0, 30, 3).alias("step"))


@query(f"with {SEQS} select id, strpos(data, 'GATT') - 1 as first_place, case when strpos(reverse(data), 'TTAG') = 0 then -1 else length(data) - strpos(reverse(data), 'TTAG') + 1 - 4 end as last_place from seqs")
def seq_find(spark, sf):
    return derive.seqs(spark, sf).select("id", strings.find("data", "GATT").cast("long").alias("first_place"), strings.rfind("data", "GATT").cast("long").alias("last_place"))


@query(f"with {SEQS} select id, cast((length(data) - length(replace(data, 'AC', ''))) / 2 as bigint) as n from seqs")
def seq_count_sub(spark, sf):
    return derive.seqs(spark, sf).select("id", strings.count("data", "AC").cast("long").alias("n"))


@query(f"with {SEQS} select id, md5(case when length(data) < 400 then rpad(data, 400, '-') else data end) as left_, md5(case when length(data) < 400 then lpad(data, 400, '.') else data end) as right_ from seqs")
def seq_ljust(spark, sf):
    return derive.seqs(spark, sf).select("id", F.md5(strings.ljust("data", 400, "-")).alias("left_"), F.md5(strings.rjust("data", 400, ".")).alias("right_"))


@query(f"with {SEQS} select id, md5(replace(data, 'AC', 'x')) as replaced, md5(lower(data)) as lowered, starts_with(data, 'A') as starts, ends_with(data, 'GT') as ends_, cast(len(string_split(data, 'TT')) as bigint) as parts, md5(regexp_replace(data, '^[AC]+', '')) as stripped from seqs")
def seq_str_methods(spark, sf):
    s = derive.seqs(spark, sf)
    return s.select("id", F.md5(strings.replace("data", "AC", "x")).alias("replaced"), F.md5(strings.swapcase("data")).alias("lowered"), strings.startswith("data", "A").alias("starts"), strings.endswith("data", "GT").alias("ends_"), F.size(strings.split("data", "TT")).cast("long").alias("parts"), F.md5(strings.lstrip("data", "AC")).alias("stripped"))


_CODE = dims.genetic_code(1)
_GCODE = "gcode(codon, aa) as (values " + ", ".join(f"('{a + b + c}', '{_CODE.amino[a + b + c]}')" for a in "TCAG" for b in "TCAG" for c in "TCAG") + ")"


@query(f"""with {SEQS}, {_GCODE}, c as (select id, i, substr(data, 3 * i + 1, 3) as codon from seqs, unnest(range(0, length(data) // 3)) t(i)),
    t as (select id, i, aa from c join gcode using (codon)), s as (select id, min(i) filter (where aa = '*') as stop_ from t group by id),
    f as (select id, string_agg(aa, '' order by i) as aas, string_agg(aa, '' order by i) filter (where stop_ is null or i < stop_) as first_ from t join s using (id) group by id)
    select seqs.id, md5(coalesce(aas, '')) as complete, md5(coalesce(first_, '')) as to_stop from seqs left join f on seqs.id = f.id""")
def seq_translate(spark, sf):
    s = derive.seqs(spark, sf).select("id", F.col("data").alias("own"), "data")
    complete = tr.translate(s, complete=True, gap=None).select("id", F.md5("data").alias("complete"), F.col("own").alias("data"))
    return tr.translate(complete, check_start=False, gap=None).select("id", "complete", F.md5("data").alias("to_stop"))


@query(f"with {SEQS} select id, md5(concat(substr(data, 1, 5), 'NNN', substr(data, 9))) as edited from seqs where length(data) >= 8")
def seq_assign(spark, sf):
    return derive.seqs(spark, sf).filter(F.length("data") >= 8).select("id", F.md5(sequence.set_slice("data", "NNN", 5, 8)).alias("edited"))


@query("""with s as (select doc_id, regexp_replace(text, '[^A-Za-z]', '-', 'g') as data from documents)
    select doc_id, coalesce(nullif(regexp_extract(data, '^(?:-*[A-Za-z]){3}-*([A-Za-z](?:-*[A-Za-z]){16})', 1), ''), regexp_extract(data, '^(?:-*[A-Za-z]){3}-*([A-Za-z].*)$', 1)) as part from s""")
def seq_slice_ungapped(spark, sf):
    d = derive.table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^A-Za-z]", "-").alias("data"))
    return d.select("doc_id", sequence.slice_ungapped("data", 3, 20).alias("part"))


# counting and merging


@query(f"with {SEQS} select letter as word, count(*) as count from (select unnest(string_split(data, '')) as letter from seqs where data <> '') group by letter")
def letter_counts(spark, sf):
    return counting.count_words(derive.seqs(spark, sf), 1)


def codon_sql(source: str, columns: str, name: str = "p") -> str:
    """Every word of 3 letters with its place, cut from pieces of 300 letters: substr walks from a text's start."""
    return f"""pieces as (select {columns}, length(data) as seqlen, j, substr(data, 300 * j + 1, 302) as piece from {source}, unnest(range(0, (length(data) + 299) // 300)) t(j)),
    {name} as (select {columns}, seqlen, 300 * j + i - 1 as pos, substr(piece, i, 3) as codon from pieces, unnest(range(1, least(300, length(piece) - 2) + 1)) u(i))"""


_KMER = codon_sql("seqs", "ord, id", "k0") + ", k as (select ord, id, codon as word from k0)"


@query(f"with {SEQS}, {_KMER} select word, count(*) as count from k group by word")
def kmer3_counts(spark, sf):
    return counting.count_words(derive.seqs(spark, sf), 3)


@query(f"with {SEQS}, {_KMER}, c as (select word, count(*) as count from k group by word) select word, count, round(count / sum(count) over (), 9) as prob from c")
def kmer_prob(spark, sf):
    return counting.word_probabilities(derive.seqs(spark, sf), 3).withColumn("prob", F.round("prob", 9))


@query(f"""with {SEQS}, {_KMER}, c as (select ord, id, word, count(*) as count from k group by ord, id, word)
    select ord, id, word, count, round(count / sum(count) over (partition by id), 9) as prob, round(count / sum(count) over (), 12) as tprob from c""")
def kmer_df(spark, sf):
    return counting.word_table(derive.seqs(spark, sf), 3).withColumn("prob", F.round("prob", 9)).withColumn("tprob", F.round("tprob", 12))


@query(f"with {TURNS} select id, md5(string_agg(data, '--' order by ord)) as merged, min(ord) as ord from turns group by id")
def merge_turns(spark, sf):
    return counting.merge(derive.turns(spark, sf), "--").select("id", F.md5("data").alias("merged"), "ord")


@query(f"with {TURNS} select id, ord, cast(coalesce(sum(length(data) + 2) over (partition by id order by ord rows between unbounded preceding and 1 preceding), 0) as bigint) as start_ from turns")
def merge_with_offsets(spark, sf):
    return counting.merge_offsets(derive.turns(spark, sf), "--").select("id", "ord", F.col("offset").alias("start_"))


# matches and reading frames

_POS = codon_sql("seqs", "ord, id")


@query(f"with {SEQS}, {_POS} select id, count(*) as n, min(pos) as first_ from p where codon = 'ATG' group by id")
def match_start_codons(spark, sf):
    found = match.match_codons(derive.seqs(spark, sf), match.START_CODONS, "fwd")
    return found.groupBy(F.col("seqid").alias("id")).agg(F.count("*").alias("n"), F.min("start").cast("long").alias("first_"))


_BOTH = """both_ as (select ord, id, 1 as dir, data from seqs union all select ord, id, -1, reverse(translate(data, 'ACGT', 'TGCA')) from seqs),
    """ + codon_sql("both_", "ord, id, dir")


@query(f"with {SEQS}, {_BOTH} select case when dir = 1 then pos % 3 else -(pos % 3) - 1 end as rf, codon as match, count(*) as n, cast(sum(case when dir = 1 then pos else seqlen - pos - 3 end) as bigint) as places from p where codon in ('TAG', 'TAA', 'TGA') group by all")
def match_by_frame(spark, sf):
    found = match.match_codons(derive.seqs(spark, sf), match.STOP_CODONS, "all")
    return found.groupBy(F.col("rf").cast("long").alias("rf"), "match").agg(F.count("*").alias("n"), F.sum("start").alias("places"))


@query("""with t as (select doc_id, regexp_extract_all(lower(text), 'the [a-z]+') as found from documents)
    select doc_id as seq_ord, cast(len(found) as bigint) as n from t where len(found) > 0""")
def match_regex(spark, sf):
    s = derive.table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.lit("").alias("id"), F.lower("text").alias("data"))
    return match.match(s, "the [a-z]+", rf=None, gap=None).groupBy("seq_ord").agg(F.count("*").alias("n"))


def _orf_sql(strands: str, where: str = "", every: bool = False, nested: bool = False, text: bool = False) -> str:
    """starts x stops of one frame: the next stop of each start, then the first start of each stop."""
    pick = "s.pos" if every else "min(s.pos)"
    return f"""with {SEQS}, {_BOTH},
    starts as (select * from p where codon = 'ATG' {strands}), stops as (select ord, dir, pos % 3 as f, pos + 3 as e from p where codon in ('TAG', 'TAA', 'TGA') {strands}),
    nxt as (select s.ord, s.id, s.dir, s.seqlen, s.pos % 3 as f, s.pos, min(e) as e from starts s join stops t on s.ord = t.ord and s.dir = t.dir and s.pos % 3 = t.f and t.e > s.pos group by all),
    firsts as (select ord, id, dir, seqlen, f, e, min(pos) as b from nxt group by all),
    raw as (select ord, id, dir, seqlen, f, e, {'pos' if every else 'b'} as b from {'nxt join firsts using (ord, id, dir, seqlen, f, e) where e < seqlen - 2 or pos = b' if every else 'firsts'}),
    orfs as (select ord as seq_ord, id as seqid, case when dir = 1 then b else seqlen - e end as start, case when dir = 1 then e else seqlen - b end as stop,
        case when dir = 1 then '+' else '-' end as strand, case when dir = 1 then f else -f - 1 end as rf from raw)"""


_ORF_COLUMNS = ["seq_ord", "seqid", "start", "stop", "strand", "rf"]


def _orf_rows(orfs: DataFrame) -> DataFrame:
    return orfs.select(*_ORF_COLUMNS[:-1], F.col("rf").cast("long").alias("rf"))


@query(_orf_sql("and dir = 1") + " select * from orfs")
def orfs_fwd(spark, sf):
    return _orf_rows(orf.find_orfs(derive.seqs(spark, sf), rf="fwd"))


@query(_orf_sql("") + " select * from orfs")
def orfs_all(spark, sf):
    return _orf_rows(orf.find_orfs(derive.seqs(spark, sf)))


@query(_orf_sql("") + " select * from orfs where stop - start >= 90")
def orfs_len_ge(spark, sf):
    return _orf_rows(orf.find_orfs(derive.seqs(spark, sf), len_ge=90))


@query(_orf_sql("", every=True) + " select * from orfs")
def orfs_nested_all(spark, sf):
    return _orf_rows(orf.find_orfs(derive.seqs(spark, sf), nested="all"))


@query(_orf_sql("") + """, ranked as (select *, max(stop) over (partition by seq_ord order by start, stop desc, case when rf >= 0 then rf else 2 - rf end rows between unbounded preceding and 1 preceding) as reach from orfs)
    select seq_ord, seqid, start, stop, strand, rf from ranked where reach is null or reach < stop""")
def orfs_nested_no(spark, sf):
    return _orf_rows(orf.find_orfs(derive.seqs(spark, sf), nested="no"))


@query(f"""with {SEQS}, {_BOTH}, stops as (select ord, id, dir, seqlen, pos % 3 as f, pos + 3 as e, lag(pos + 3) over (partition by ord, dir, pos % 3 order by pos) as b from p where codon in ('TAG', 'TAA', 'TGA')),
    raw as (select *, coalesce(b, f) as s from stops)
    select ord as seq_ord, id as seqid, case when dir = 1 then s else seqlen - e end as start, case when dir = 1 then e else seqlen - s end as stop, case when dir = 1 then '+' else '-' end as strand, case when dir = 1 then f else -f - 1 end as rf from raw""")
def orfs_never(spark, sf):
    return _orf_rows(orf.find_orfs(derive.seqs(spark, sf), need_start="never"))


@query(_orf_sql("and dir = 1") + f""", {_GCODE}, cut as (select o.rf, o.seq_ord, o.start, substr(s.data, o.start + 1, o.stop - o.start) as d from orfs o join seqs s on s.ord = o.seq_ord),
    aas as (select rf, seq_ord, start, string_agg(aa, '' order by i) as aa from (select rf, seq_ord, start, i, substr(d, 3 * i + 1, 3) as codon from cut, unnest(range(0, length(d) // 3 - 1)) t(i)) join gcode using (codon) group by rf, seq_ord, start)
    select rf, count(*) as n, cast(sum(length(aa)) as bigint) as letters, max(aa) as last_, min(length(aa)) as shortest from aas group by rf""")
def orf_proteins(spark, sf):
    s = derive.seqs(spark, sf)
    found = orf.find_orfs(s, rf="fwd", with_data=True).select(F.col("rf").cast("long").alias("rf"), "data")
    aa = tr.translate(found, check_start=False, gap=None).select("rf", F.col("data").alias("aa"))
    return aa.groupBy("rf").agg(F.count("*").alias("n"), F.sum(F.length("aa")).alias("letters"), F.max("aa").alias("last_"), F.min(F.length("aa")).cast("long").alias("shortest"))


# selection, order, groups


@query(f"with {FTS} select * from fts where type = 'RF'")
def fts_select_type(spark, sf):
    return rows.select(derive.fts(spark, sf), "rf")


@query(f"with {FTS} select * from fts where stop - start > 30 and stop - start <= 45")
def fts_select_len_gt(spark, sf):
    return rows.select(derive.fts(spark, sf), len_gt=30, len_max=45)


@query(f"with {FTS} select * from fts where type in ('RF', 'NO') and stop - start >= 40")
def fts_select_in(spark, sf):
    return rows.select(derive.fts(spark, sf), ["rf", "no"], len_min=40)


@query(f"with {FTS} select * from fts where not lower(type) = 'no'")
def fts_select_notlower(spark, sf):
    return rows.select(derive.fts(spark, sf), type_notlowereq="no")


@query(f"with {FTS} select * from fts where strand = '-' and start < 1200")
def fts_select_strand(spark, sf):
    return rows.select(derive.fts(spark, sf), strand="-", start_lt=1200)


@query("select event_id, user_id, cast(json_extract_string(props, '$.k') as bigint) as k from events where cast(json_extract_string(props, '$.k') as double) >= 5 and event_type <> 'click'")
def meta_select_json(spark, sf):
    events = derive.table(spark, sf, "events").withColumnRenamed("props", "meta_json")
    found = rows.select(events, k_ge=5, event_type_ne="click")
    return found.select("event_id", "user_id", F.get_json_object("meta_json", "$.k").cast("long").alias("k"))


@query(f"with {FTS} select seqid, min(ord) as ord, arg_min(start, ord) as start, arg_min(stop, ord) as stop from fts where type = 'RF' group by seqid")
def fts_first_of_type(spark, sf):
    return rows.first_of_type(derive.fts(spark, sf), "rf", by="seqid").select("seqid", "ord", "start", "stop")


@query(f"with {FTS} select seqid, max(ord) as ord, arg_max(start, ord) as start, arg_max(type, ord) as type from fts group by seqid")
def fts_todict(spark, sf):
    return rows.todict(derive.fts(spark, sf), "seqid").select("seqid", "ord", "start", "type")


@query(f"with {FTS} select seqid, count(*) as n, min(ord) as first_ord from fts group by seqid")
def fts_group_count(spark, sf):
    return rows.group_counts(derive.fts(spark, sf), "seqid")


@query(f"with {FTS} select type, strand, count(*) as n, min(ord) as first_ord from fts group by type, strand")
def fts_group_nested(spark, sf):
    return rows.group_counts(derive.fts(spark, sf), "type strand")


@query(f"with {FTS} select seqid, count(*) as n, min(ord) as first_ord, string_agg(cast(start as varchar), ',' order by ord) as starts from fts group by seqid")
def fts_group_lists(spark, sf):
    grouped = rows.group_lists(derive.fts(spark, sf), "seqid")
    return grouped.select("seqid", "n", "first_ord", F.array_join(F.transform("rows", lambda r: r["start"].cast("string")), ",").alias("starts"))


@query(f"with {FTS} select seqid, min(start) as start, max(stop) as stop from fts group by seqid")
def fts_loc_range(spark, sf):
    return rows.loc_range(derive.fts(spark, sf), "seqid")


@query(f"with {FTS} select * from fts order by stop - start desc, ord limit 25")
def fts_sort_topk(spark, sf):
    return rows.top(derive.fts(spark, sf), "len", 25)


@query(f"with {SEQS} select ord, id, length(data) as len from seqs order by length(data) desc, ord limit 10")
def seq_sort_len(spark, sf):
    return rows.top(derive.seqs(spark, sf), [len], 10).select("ord", "id", F.length("data").cast("long").alias("len"))


@query(f"with {SEQS} select (ord - 5) // 3 as ord, id from seqs where ord >= 5 and ord < (select count(*) from seqs) - 4 and (ord - 5) % 3 = 0")
def seq_list_slice(spark, sf):
    return rows.list_slice(derive.seqs(spark, sf), 5, -4, 3).select("ord", "id")


# interval algebra


@query(f"with {FTS} select seqid, ord, greatest(start, 2000) - 2000 as start, least(stop, 2400) - 2000 as stop, strand, cast(start < 2000 as integer) + 2 * cast(stop > 2400 as integer) as defect from fts where start < 2400 and stop > 2000")
def fts_slice(spark, sf):
    cut = intervals.slice_features(derive.with_locs(derive.fts(spark, sf)), 2000, 2400, rel=2000)
    return cut.select("seqid", "ord", "start", "stop", "strand", "defect")


@query(f"with {FTS} select seqid, ord, 3000 - stop as start, 3000 - start as stop, case strand when '+' then '-' else '+' end as strand from fts")
def fts_rc(spark, sf):
    return intervals.reverse_features(derive.with_locs(derive.fts(spark, sf)), 3000).select("seqid", "ord", "start", "stop", "strand")


@query(f"with {FTS} select seqid, ord, start + 17 as start, stop + 17 as stop, (start + stop + 34) // 2 as mid from fts")
def fts_shift(spark, sf):
    moved = intervals.shift_features(derive.with_locs(derive.fts(spark, sf)), 17)
    return moved.select("seqid", "ord", "start", "stop", L.middle(F.col("start"), F.col("stop")).alias("mid"))


_BOTH_OF_SEQID = """f as materialized (select * from fts), met as materialized (
    select a.seqid, a.ord as a_ord, a.start as a_start, a.stop as a_stop, b.ord as b_ord, b.start as b_start, b.stop as b_stop from f a join f b on a.seqid = b.seqid)"""
_OVERLAP = "from met where a_ord < b_ord and a_start < b_stop and a_stop > b_start"


def _pairs(spark, sf) -> DataFrame:
    f = derive.fts(spark, sf).select("ord", "seqid", "start", "stop")
    return intervals.overlap_join(f, f, 64).filter("a_ord < b_ord")


@query(f"with {FTS}, {_BOTH_OF_SEQID} select seqid, a_ord, b_ord {_OVERLAP}")
def fts_overlap_pairs(spark, sf):
    return _pairs(spark, sf).select(F.col("a_seqid").alias("seqid"), "a_ord", "b_ord")


@query(f"with {FTS}, {_BOTH_OF_SEQID} select seqid, a_ord, b_ord, greatest(0, least(a_stop, b_stop) - greatest(a_start, b_start)) as n {_OVERLAP}")
def fts_overlaplen(spark, sf):
    n = L.overlap_length(F.col("a_start"), F.col("a_stop"), F.col("b_start"), F.col("b_stop"))
    return _pairs(spark, sf).select(F.col("a_seqid").alias("seqid"), "a_ord", "b_ord", n.alias("n"))


@query(f"with {FTS}, {_BOTH_OF_SEQID} select seqid, a_ord, b_ord from met where a_ord <> b_ord and a_start <= b_start and b_stop <= a_stop")
def fts_contains_pairs(spark, sf):
    f = derive.fts(spark, sf).select("ord", "seqid", "start", "stop")
    inside = L.contains(F.col("a_start"), F.col("a_stop"), F.col("b_start"), F.col("b_stop"))
    return intervals.overlap_join(f, f, 64).filter((F.col("a_ord") != F.col("b_ord")) & inside).select(F.col("a_seqid").alias("seqid"), "a_ord", "b_ord")


@query(f"""with {FTS}, n as (select *, lead(ord) over w as b_ord, lead(start) over w as b_start, lead(stop) over w as b_stop from fts window w as (partition by seqid order by ord))
    select seqid, ord, b_ord, case when start < b_stop and stop > b_start then 0 else greatest(b_start - stop, start - b_stop) end as inner_,
        case when start < b_stop and stop > b_start then 0 else (b_start + b_stop) // 2 - (start + stop) // 2 end as signed_ from n where b_ord is not null""")
def fts_distance(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("seqid").orderBy("ord")
    f = derive.fts(spark, sf)
    n = f.select("*", F.lead("ord").over(w).alias("b_ord"), F.lead("start").over(w).alias("b_start"), F.lead("stop").over(w).alias("b_stop")).filter("b_ord is not null")
    place = [F.col(c) for c in ("start", "stop", "b_start", "b_stop")]
    return n.select("seqid", "ord", "b_ord", L.distance(*place).alias("inner_"), L.distance(*place, pos="middle", sign=True).alias("signed_"))


_FTS_KEY = "seqid, type, start, stop, strand"


@query(f"with {FTS} select {_FTS_KEY}, min(ord) as ord from fts group by all")
def fts_remove_duplicates(spark, sf):
    return rows.remove_duplicates(derive.fts(spark, sf))


@query(f"""with {FTS}, d as (select {_FTS_KEY}, min(ord) as ord from fts group by all),
    r as (select *, max(stop) over (partition by seqid order by start, stop desc, ord rows between unbounded preceding and 1 preceding) as reach from d)
    select ord, {_FTS_KEY} from r where reach is null or reach < stop""")
def fts_remove_nested(spark, sf):
    return intervals.remove_nested(derive.fts(spark, sf))


@query(f"""with recursive {FTS}, d as (select {_FTS_KEY}, min(ord) as ord from fts group by all),
    o as (select *, row_number() over (partition by seqid order by ord) as k from d),
    greedy as (
        select seqid, k, ord, start, stop, [{{'s': start, 'e': stop}}] as kept, true as good from o where k = 1
        union all
        select o.seqid, o.k, o.ord, o.start, o.stop,
            case when len(list_filter(g.kept, lambda x: x.s < o.stop and x.e > o.start)) = 0 then list_append(g.kept, {{'s': o.start, 'e': o.stop}}) else g.kept end,
            len(list_filter(g.kept, lambda x: x.s < o.stop and x.e > o.start)) = 0
        from greedy g join o on o.seqid = g.seqid and o.k = g.k + 1)
    select seqid, ord, start, stop from greedy where good""")
def fts_remove_overlapping(spark, sf):
    return intervals.remove_overlapping(derive.fts(spark, sf)).select("seqid", "ord", "start", "stop")


@query(f"""with {FTS}, a as (select seqid, (min(start) + max(stop)) // 2 as anchor from fts group by seqid), m as (select max(anchor) as at_ from a)
    select f.seqid, f.ord, f.start + at_ - anchor as start, f.stop + at_ - anchor as stop from fts f join a on a.seqid = f.seqid, m""")
def align_groups_center(spark, sf):
    return intervals.align_groups(derive.fts(spark, sf)).select("seqid", "ord", "start", "stop")


# list algebra

_LISTS = f"{FTS}, a as (select ord, {_FTS_KEY} from fts where start < 2400), b as (select ord, {_FTS_KEY} from fts where start >= 2300)"
_EQUAL = "x.seqid = y.seqid and x.type = y.type and x.start = y.start and x.stop = y.stop and x.strand = y.strand"


def _lists(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Two lists that overlap and together hold every feature."""
    f = derive.fts(spark, sf)
    return f.filter("start < 2400"), f.filter("start >= 2300")


def _without_ord(df: DataFrame) -> DataFrame:
    return df.select("seqid", "type", "start", "stop", "strand")


@query(f"with {_LISTS} select {_FTS_KEY} from a union all select {_FTS_KEY} from b")
def list_union(spark, sf):
    return _without_ord(rows.list_add(*_lists(spark, sf)))


@query(f"with {_LISTS} select {_FTS_KEY} from a x where exists (select 1 from b y where {_EQUAL})")
def list_and(spark, sf):
    return _without_ord(rows.list_and(*_lists(spark, sf)))


@query(f"with {_LISTS} select {_FTS_KEY} from a union all select {_FTS_KEY} from b x where not exists (select 1 from a y where {_EQUAL})")
def list_or(spark, sf):
    return _without_ord(rows.list_or(*_lists(spark, sf)))


@query(f"with {_LISTS} select {_FTS_KEY} from a x where not exists (select 1 from b y where {_EQUAL})")
def list_sub(spark, sf):
    return _without_ord(rows.list_sub(*_lists(spark, sf)))


@query(f"with {_LISTS} select {_FTS_KEY} from a x where not exists (select 1 from b y where {_EQUAL}) union all select {_FTS_KEY} from b x where not exists (select 1 from a y where {_EQUAL})")
def list_xor(spark, sf):
    return _without_ord(rows.list_xor(*_lists(spark, sf)))


# joins of sequences and features


@query(f"with {SEQS}, {FTS} select s.ord as seq_ord, f.ord, f.start, f.stop from fts f join seqs s on s.id = f.seqid")
def attach_fts(spark, sf):
    return joins.attach(derive.seqs(spark, sf), derive.fts(spark, sf)).select("seq_ord", "ord", "start", "stop")


@query(f"with {SEQS}, {FTS} select seqid, count(*) as n from fts where seqid not in (select id from seqs) group by seqid")
def leftover_seqids(spark, sf):
    left = joins.leftover(derive.seqs(spark, sf), derive.fts(spark, sf))
    return left.groupBy("seqid").agg(F.count("*").alias("n"))


@query(f"""with {SEQS}, {FTS} select f.ord as ft_ord, s.ord, s.id, md5(case when strand = '-' then reverse(translate(substr(data, start + 1, stop - start), 'ACGT', 'TGCA')) else substr(data, start + 1, stop - start) end) as cut
    from fts f join seqs s on s.id = f.seqid""")
def extract_by_feature(spark, sf):
    return joins.extract(derive.seqs(spark, sf), derive.with_locs(derive.fts(spark, sf))).select("ft_ord", "ord", "id", F.md5("data").alias("cut"))


@query(f"""with {SEQS}, {FTS}, first_ as (select seqid, arg_min(start, ord) as start, arg_min(stop, ord) as stop, arg_min(strand, ord) as strand from fts where type = 'RF' group by seqid)
    select s.id, md5(case when strand = '-' then reverse(translate(substr(data, start + 1, stop - start), 'ACGT', 'TGCA')) else substr(data, start + 1, stop - start) end) as cut from seqs s join first_ f on f.seqid = s.id""")
def extract_by_type(spark, sf):
    return joins.extract_type(derive.seqs(spark, sf), derive.with_locs(derive.fts(spark, sf)), "rf", strict=False).select("id", F.md5("data").alias("cut"))


@query(f"with {SEQS}, labels_ as (select doc_id, quality, toxic from labels) select s.id, length(s.data) as len, l.quality, l.toxic from seqs s join labels_ l on s.ord = l.doc_id where l.quality = 1")
def meta_attach_labels(spark, sf):
    found = derive.seqs(spark, sf).join(derive.table(spark, sf, "labels"), F.col("ord") == F.col("doc_id"))
    return rows.select(found, quality=1).select("id", F.length("data").cast("long").alias("len"), "quality", "toxic")


# dimension tables


@query(f"with {_GCODE} select codon, aa, codon in ('TTG', 'CTG', 'ATG') as is_start, aa = '*' as is_stop from gcode")
def gcode_lookup(spark, sf):
    return dims.gcode_table(spark, [1]).filter("codon rlike '^[ACGT]{3}$'").select("codon", "aa", "is_start", "is_stop")


@query("select a.x as a, b.x as b, case when a.x = b.x then 5.0 else -4.0 end as score, case when a.x = b.x then 5.0 else -4.0 end / 68 as scaled from (values ('A'), ('C'), ('G'), ('T')) a(x), (values ('A'), ('C'), ('G'), ('T')) b(x)")
def submat_lookup(spark, sf):
    plain = dims.match_matrix("ACGT", 5, -4)
    both = dims.submat_table(spark, {"nuc": plain}).join(dims.submat_table(spark, {"nuc": dims.scale_submat(plain)}).withColumnRenamed("score", "scaled"), ["name", "a", "b"])
    return both.select("a", "b", "score", "scaled")
