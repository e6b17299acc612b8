"""Parsers from the text of a record, or of a file, to dicts. Plain Python, run on the workers.

Parsers of formats that go line by line (GFF, tabular hits, MEME, FASTA) take a text or its lines as they come, and hold
one record at a time. Sequence parsers give dicts (id, data, header, meta, features); feature parsers give dicts (seqid, type, name, id,
score, evalue, locs, meta).
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Iterator
from itertools import chain
from urllib.parse import unquote as unquote_any

from ..functions.sequence import HEADER_IDS
from .locgrammar import ordered, parse_location

_IDS = [re.compile(p) for p in HEADER_IDS]


def header_id(header: str) -> str | None:
    return next((m[1] for m in (p.search(header) for p in _IDS) if m), None)


def lines_of(text: str | Iterable[str]) -> Iterable[str]:
    """Lines between line feeds, of a text or as they come."""
    return text.split("\n") if isinstance(text, str) else text


def split_lines(text: str | Iterable[str]) -> Iterable[str]:
    """Lines as str.splitlines() gives them, of a text or of lines that come."""
    return text.splitlines() if isinstance(text, str) else chain.from_iterable(map(str.splitlines, text))


def unquote(text: str) -> str:
    return unquote_any(text) if "%" in text else text


def feature(seqid, type_, locs, meta=None, name=None, id_=None, score=None, evalue=None) -> dict:
    locs = ordered(locs)
    return {"seqid": seqid, "type": type_, "name": name, "id": id_, "score": score, "evalue": evalue, "locs": locs, "meta": meta or {}}


def place(start: int, stop: int, strand: str = "+", defect: int = 0, meta: dict | None = None) -> dict:
    if start >= stop:
        raise ValueError(f"a location's start {start} must lie before its stop {stop}")
    return {"start": start, "stop": stop, "strand": strand, "defect": defect, "meta": meta}


def parse_fasta(text: str | Iterable[str]) -> Iterator[dict]:
    header, parts = None, []
    for line in split_lines(text):
        if line.startswith(">"):
            if header is not None:
                yield {"id": header_id(header), "data": "".join(parts).upper(), "header": header, "meta": {}, "features": []}
            header, parts = line.lstrip(">").rstrip(), []
        elif header is not None and not line.startswith(";"):
            parts.append("".join(line.split()))
    if header is not None:
        yield {"id": header_id(header), "data": "".join(parts).upper(), "header": header, "meta": {}, "features": []}


def _qualifiers(lines: list[str]) -> dict:
    """/key="value" qualifiers: numbers are integers, flags are listed under misc, continued values join without space."""
    found: dict = {}
    entries: list[str] = []
    for line in lines:
        if line.startswith("/") and (not entries or not _open_quote(entries[-1])):
            entries.append(line[1:])
        elif entries:
            entries[-1] += line
    for entry in entries:
        key, equals, value = entry.partition("=")
        if not equals:
            found.setdefault("misc", []).append(key)
            continue
        value = value.strip('"')
        found[key] = int(value) if re.fullmatch(r"-?\d+", value) else value
    return found


def _open_quote(entry: str) -> bool:
    return entry.count('"') % 2 == 1


def _feature_table(lines: list[str], seqid: str, width: int = 21) -> list[dict]:
    """Features of a table: key, location and qualifiers from column `width` on."""
    found: list[tuple[str, list[str], list[str]]] = []
    for line in lines:
        key, rest = line[:width].strip(), line[width:].strip()
        if key:
            found.append((key, [rest], []))
        elif found:
            _, where, what = found[-1]
            (what if what or rest.startswith("/") else where).append(rest)
    out = []
    for key, where, what in found:
        meta = _qualifiers(what)
        locs = parse_location("".join(where))
        for loc in locs:
            loc["meta"] = {"seqid": loc["seqid"]} if loc.pop("seqid") else None
        name = meta.get("gene") or meta.get("product")
        out.append(feature(seqid, key, locs, meta, name=None if name is None else str(name), id_=meta.get("protein_id")))
    return out


def parse_genbank(text: str, exclude: tuple[str, ...] = ()) -> Iterator[dict]:
    for record in re.split(r"(?m)^//\s*$", text):
        lines = record.strip("\n").split("\n")
        if not any(x.upper().startswith("LOCUS") for x in lines):
            continue
        meta: dict = {}
        table, origin, part, key = [], [], "header", ""
        for line in lines:
            if line.startswith("FEATURES"):
                part = "features"
            elif line.startswith("ORIGIN"):
                part = "origin"
            elif part == "features" and line[:1].strip():
                part = "header"
            if part == "features":
                if not line.startswith("FEATURES"):
                    table.append(line[0:])
            elif part == "origin":
                if not line.startswith("ORIGIN"):
                    origin.append(line)
            if part == "header" and line.strip():
                name, value = line[:12].strip().lower(), line[12:].strip()
                if name:
                    key = name
                    value = ", ".join(value.split()) if key == "locus" else value
                    meta[key] = f"{meta[key]}; {value}" if key in meta else value
                elif key == "organism":
                    meta["taxonomy"] = f"{meta['taxonomy']} {value}" if "taxonomy" in meta else value
                elif key:
                    meta[key] = f"{meta[key]} {value}"
        seqid = (meta.get("accession") or "").split(" ")[0] or None
        features = [] if "fts" in exclude else _feature_table(table, seqid)
        if "translation" in exclude:
            for f in features:
                f["meta"].pop("translation", None)
        data = "" if "seq" in exclude else "".join("".join(x.split()[1:]) for x in origin)
        yield {"id": seqid, "data": data.upper(), "header": None, "meta": meta, "features": features}


#: EMBL line keys by the names that GenBank gives them.
EMBL_KEYS = {"ID": "locus", "AC": "accession", "DE": "definition", "KW": "keywords", "OS": "source", "OC": "taxonomy", "DR": "dblink", "CC": "comment", "DT": "date", "R": "reference", "SV": "version", "PR": "project", "GN": "gene"}


def parse_embl(text: str, exclude: tuple[str, ...] = (), genbank: bool = True) -> Iterator[dict]:
    for record in re.split(r"(?m)^//\s*$", text):
        lines = record.strip("\n").split("\n")
        if not lines[0].startswith("ID   "):
            continue
        meta: dict = {}
        table, data = [], []
        for line in lines:
            key, value = line[:2], line[5:].strip()
            if key == "FT":
                table.append(line)
            elif key == "  ":
                data.append(re.sub(r"[\s\d]", "", line))
            elif key not in ("XX", "SQ", "FH", "") and key not in exclude:
                key = "R" if key[0] == "R" else key
                name = EMBL_KEYS.get(key, key) if genbank else key
                meta[name] = f"{meta[name]} {value}" if name in meta else value
        accession = meta.get("accession" if genbank else "AC", "")
        seqid = accession.split(";")[0].strip() or None
        features = [] if "fts" in exclude else _feature_table([" " * 5 + x[5:] for x in table], seqid)
        if "translation" in exclude:
            for f in features:
                f["meta"].pop("translation", None)
        yield {"id": seqid, "data": "" if "seq" in exclude else "".join(data).upper(), "header": None, "meta": meta, "features": features}


def parse_clustal(text: str) -> Iterator[dict]:
    found: dict[str, list[str]] = {}
    for line in text.splitlines()[1:]:
        fields = line.split()
        if len(fields) >= 2 and not line[0].isspace():
            found.setdefault(fields[0], []).append(fields[1])
    for name, parts in found.items():
        yield {"id": name, "data": "".join(parts).upper(), "header": None, "meta": {}, "features": []}


def parse_stockholm(text: str) -> Iterator[dict]:
    """Sequences of one alignment; its GF and GC lines are every sequence's meta under `basket`."""
    found: dict[str, list[str]] = {}
    file_, column, of_seq, of_letter = {}, {}, {}, {}
    for line in text.splitlines():
        if line.startswith("//"):
            break
        if line.startswith("#=GF"):
            _, key, value = (line.split(None, 2) + [""])[:3]
            file_[key] = f"{file_[key]} {value}" if key in file_ else value
        elif line.startswith("#=GC"):
            _, key, value = line.split(None, 2)
            column[key] = column.get(key, "") + value.strip()
        elif line.startswith("#=GS"):
            _, name, key, value = line.split(None, 3)
            own = of_seq.setdefault(name, {})
            own[key] = f"{own[key]} {value}" if key in own else value
        elif line.startswith("#=GR"):
            _, name, key, value = line.split(None, 3)
            own = of_letter.setdefault(name, {})
            own[key] = own.get(key, "") + value.strip()
        elif line.strip() and not line.startswith("#"):
            name, value = line.split(None, 1)
            found.setdefault(name, []).append(value.strip())
    for name, parts in found.items():
        meta = {k: v for k, v in (("GS", of_seq.get(name)), ("GR", of_letter.get(name)), ("basket", {k: v for k, v in (("GF", file_), ("GC", column)) if v})) if v}
        yield {"id": name, "data": "".join(parts).upper(), "header": None, "meta": meta, "features": []}


def row_to_features(row: str, type_: str, seqid: str | None, fill: str = "-.", split: str = "|") -> list[dict]:
    """Features of an annotation row: pieces between split marks, named by their shortest text; edge pieces are cut off."""
    cuts = [i for i, c in enumerate(row) if c == split]
    edges = [0, *cuts, len(row) - 1]
    out = []
    for k, (low, high) in enumerate(zip(edges, edges[1:], strict=False)):
        piece = row[low + (k > 0) : high + (k == len(edges) - 2)]
        names = [x for x in re.split(f"[{re.escape(fill)}]+", piece.replace(split, "")) if x]
        if not names:
            continue
        defect = (1 if k == 0 and row[0] != split else 0) | (2 if k == len(edges) - 2 and row[-1] != split else 0)
        out.append(feature(seqid, type_, [place(low, high + 1, "+", defect)], name=min(names, key=len)))
    return out


def features_to_row(features: list[tuple[int, int, str]], length: int, inner: str = "-", outer: str = ".", split: str = "|") -> str:
    """An annotation row from (start, stop, name) of features that overlap by one place at most."""
    row = [outer] * length
    last = None
    for start, stop, name in sorted(features):
        if last is not None and last - start > 1:
            raise ValueError("features of a row overlap by one place at most")
        last = stop
        row[start:stop] = inner * (stop - start)
        row[start] = row[stop - 1] = split
        room = max(0, stop - start - 2)
        if len(name) > room:
            warnings.warn(f"the name {name} is cut to the {room} letters that its feature has room for", stacklevel=2)
            name = name[:room]
        at = start + 1 + (room - len(name)) // 2
        row[at : at + len(name)] = name
    return "".join(row)


#: GFF columns.
GFF_COLUMNS = ("seqid", "source", "type", "start", "end", "score", "strand", "phase")


def _gff_version(text: str) -> int | None:
    found = re.match(r"##gff-version\s+(\d)", text)
    return int(found[1]) if found else None


def _attributes(text: str, version: int) -> dict:
    out: dict = {}
    if version == 1:
        return {"group": text.strip()} if text.strip() else {}
    if version == 3:
        for part in filter(None, (x.strip() for x in text.strip().split(";"))):
            key, equals, value = part.partition("=")
            if not equals:
                raise ValueError(f"attribute without =: {part}")
            out[unquote(key)] = [unquote(v) for v in value.split(",")] if "," in value else unquote(value)
        return out
    for m in re.finditer(r'\s*([^\s;]+)\s+("(?:[^"\\]|\\.)*"|[^;]*?)\s*(?:;|$)', text.strip()):
        value = m[2].strip('"')
        key = m[1]
        out[key] = value if key not in out else [*(out[key] if isinstance(out[key], list) else [out[key]]), value]
    return out


def parse_gff(text: str | Iterable[str], version: int | None = None, gtf: bool = False, filt: tuple[str, ...] | None = None, filt_fast: str | None = None, default_ftype: str | None = None) -> Iterator[dict]:
    """Features of GFF 1, 2, 3 or GTF; consecutive lines of one ID, type and seqid are one feature's locations."""
    lines = iter(lines_of(text))
    head = next(lines, "")
    version = 2 if gtf else version or _gff_version(head) or 3
    now, key = None, None
    for number, line in enumerate(chain((head,), lines), 1):
        if line.startswith("##FASTA"):
            break
        if filt_fast and filt_fast.lower() not in line.lower():
            continue
        line = line.split("#", 1)[0].rstrip("\r")
        if not line.strip():
            continue
        try:
            fields = line.split("\t")
            if len(fields) not in (8, 9):
                fields = line.split(None, 8)
            seqid, source, type_, start, stop, score, strand, phase = fields[:8]
            attributes = _attributes(fields[8], version) if len(fields) > 8 else {}
            if version == 3:
                seqid, source, type_ = unquote(seqid), unquote(source), unquote(type_)
            type_ = type_ if type_ != "." else default_ftype
            if filt and type_ not in filt:
                continue
            meta = dict(attributes) | ({"source": source} if source != "." else {})
            if phase != ".":
                meta["frame" if gtf else "phase"] = int(phase)
            own = (attributes.get("ID"), type_, seqid) if version == 3 and "ID" in attributes else None
            loc = place(int(start) - 1, int(stop), strand)
        except Exception as e:
            raise ValueError(f"Parsing error in line {number}: {line}") from e
        if own is not None and own == key:
            common = {k: v for k, v in meta.items() if now["meta"].get(k) != v}
            loc["meta"] = common or None
            now["locs"].append(loc)
            continue
        if now:
            now["locs"] = ordered(now["locs"])
            yield now
        name = attributes.get("Name") or attributes.get("gene_name")
        identity = attributes.get("ID") or attributes.get("gene_id")
        evalue = attributes.get("evalue", attributes.get("E_value"))
        now = feature(seqid, type_, [loc], meta, name=name if isinstance(name, str) else None, id_=identity if isinstance(identity, str) else None, score=None if score == "." else float(score), evalue=float(evalue) if isinstance(evalue, str) else None)
        key = own
    if now:
        now["locs"] = ordered(now["locs"])
        yield now


#: Default columns of tabular hits.
HIT_COLUMNS = ("qseqid", "sseqid", "pident", "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "evalue", "bitscore")
MMSEQS_COLUMNS = ("query", "target", "fident", "alnlen", "mismatch", "gapopen", "qstart", "qend", "tstart", "tend", "evalue", "bits")
#: Columns of BLAST's tables and their labels in its Fields line.
FIELD_NAMES = {
    "query id": "qseqid", "query gi": "qgi", "query acc.": "qacc", "query acc.ver": "qaccver", "query length": "qlen",
    "subject id": "sseqid", "subject ids": "sallseqid", "subject gi": "sgi", "subject gis": "sallgi", "subject acc.": "sacc",
    "subject acc.ver": "saccver", "subject accs.": "sallacc", "subject length": "slen", "q. start": "qstart", "q. end": "qend",
    "s. start": "sstart", "s. end": "send", "query seq": "qseq", "subject seq": "sseq", "evalue": "evalue", "bit score": "bitscore",
    "score": "score", "alignment length": "length", "% identity": "pident", "identical": "nident", "mismatches": "mismatch",
    "positives": "positive", "gap opens": "gapopen", "gaps": "gaps", "% positives": "ppos", "query/sbjct frames": "frames",
    "query frame": "qframe", "sbjct frame": "sframe", "BTOP": "btop", "subject tax id": "staxid", "subject sci name": "ssciname",
    "subject com name": "scomname", "subject blast name": "sblastname", "subject super kingdom": "sskingdom",
    "subject tax ids": "staxids", "subject sci names": "sscinames", "subject com names": "scomnames",
    "subject super kingdoms": "sskingdoms", "subject title": "stitle", "subject titles": "salltitles", "subject strand": "sstrand",
    "% query coverage per subject": "qcovs", "% query coverage per hsp": "qcovhsp", "% query coverage per uniq subject": "qcovus",
}
#: Columns of MMseqs2's tables, with BLAST's name where that has the same.
MMSEQS_NAMES = {
    "query": "qseqid", "qlen": "qlen", "target": "sseqid", "tlen": "slen", "qstart": "qstart", "qend": "qend", "tstart": "sstart",
    "tend": "send", "qseq": "qseq", "tseq": "sseq", "evalue": "evalue", "bits": "bitscore", "alnlen": "length", "pident": "pident",
    "nident": "nident", "mismatch": "mismatch", "gapopen": "gapopen", "ppos": "ppos", "qframe": "qframe", "tframe": "sframe",
    "qcov": "qcovs", "fident": "fident", "raw": "raw", "cigar": "cigar", "qheader": "qheader", "theader": "theader", "qaln": "qaln",
    "taln": "taln", "tcov": "tcov", "qset": "qset", "qsetid": "qsetid", "tset": "tset", "tsetid": "tsetid", "taxid": "taxid",
    "taxname": "taxname", "taxlineage": "taxlineage", "qorfstart": "qorfstart", "qorfend": "qorfend", "torfstart": "torfstart",
    "torfend": "torfend",
}
#: The columns that are numbers.
_INTEGERS = {
    "length", "mismatch", "gapopen", "qstart", "qend", "sstart", "send", "qlen", "slen", "nident", "positive", "gaps", "qframe",
    "sframe", "qorfstart", "qorfend", "torfstart", "torfend", "mdlfrom", "mdlto", "seqfrom", "seqto", "pass", "idx", "mdllen", "seqlen",
}
_FLOATS = {
    "pident", "fident", "evalue", "bitscore", "score", "ppos", "qcovs", "qcovhsp", "qcovus", "tcov", "gc", "bias", "anyidx", "afrct1",
    "afrct2", "winidx", "wfrct1", "wfrct2",
}


def _number(key: str, value: str):
    try:
        return int(value) if key in _INTEGERS else float(value) if key in _FLOATS else value
    except ValueError:
        return value


#: What hits say of their strand, and what it means.
_STRANDS = {"plus": "+", "minus": "-", "plus/plus": "+", "plus/minus": "-", "+": "+", "-": "-"}


def hit_feature(row: dict, type_: str | None) -> dict:
    """A feature from one hit: strand and coordinates from the directions of both ranges."""
    start, stop, strand = row["sstart"], row["send"], row.get("sstrand")
    strand = _STRANDS.get(strand, strand)
    if strand == "N/A":
        strand = "."
        if start > stop:
            start, stop, strand = stop, start, "-"
    elif start == stop and "qstart" not in row or start == stop and row["qstart"] == row["qend"]:
        strand = strand or "."
    else:
        turned = (start > stop) != (row.get("qstart", 0) > row.get("qend", 0)) if start != stop else False
        found = "-" if turned else "+"
        if start > stop:
            start, stop = stop, start
        if strand in ("+", "-") and strand != found:
            raise ValueError(f"strand {strand} contradicts the coordinates")
        strand = found
    seqid = next((row[k] for k in ("sseqid", "sacc", "saccver") if k in row), None)
    name = next((row[k] for k in ("qseqid", "qacc", "qaccver") if k in row), None)
    if "pident" in row and "fident" not in row:
        row["fident"] = row["pident"] / 100
    elif "fident" in row and "pident" not in row:
        row["pident"] = row["fident"] * 100
    return feature(seqid, row.get(type_, type_) if type_ else None, [place(start - 1, stop, strand)], row, name=name, score=row.get("bitscore"), evalue=row.get("evalue"))


def parse_blast(text: str | Iterable[str], sep: str | None = None, outfmt: str | None = None, ftype: str | None = None) -> Iterator[dict]:
    columns = outfmt.split() if outfmt else list(HIT_COLUMNS)
    for line in split_lines(text):
        if line.startswith("# Fields:") and not outfmt:
            columns = [FIELD_NAMES.get(x.strip(), x.strip()) for x in line[9:].split(",")]
        if not line.strip() or line.startswith("#"):
            continue
        fields = line.split(sep or ("\t" if "\t" in line else "," if "," in line else None))
        yield hit_feature({k: _number(k, v.strip()) for k, v in zip(columns, fields, strict=True)}, ftype)


def parse_mmseqs(text: str | Iterable[str], sep: str | None = None, outfmt: str | None = None, ftype: str | None = None) -> Iterator[dict]:
    named = [MMSEQS_NAMES.get(c, c) for c in (outfmt.split() if outfmt else MMSEQS_COLUMNS)]
    for number, line in enumerate(filter(str.strip, split_lines(text))):
        fields = [x.strip() for x in line.split(sep or ("\t" if "\t" in line else None))]
        if number == 0 and len(fields) > 1 and set(fields) <= set(MMSEQS_NAMES):
            named = [MMSEQS_NAMES[c] for c in fields]
            continue
        yield hit_feature({k: _number(k, v) for k, v in zip(named, fields, strict=True)}, ftype)


#: Columns of the tabular layouts, by the number of groups of dashes in the header.
INFERNAL_LAYOUTS = {
    18: "target accession query qaccession mdl mdlfrom mdlto seqfrom seqto strand trunc pass gc bias score evalue inc description",
    29: "idx target accession query qaccession clan mdl mdlfrom mdlto seqfrom seqto strand trunc pass gc bias score evalue inc olp anyidx afrct1 afrct2 winidx wfrct1 wfrct2 mdllen seqlen description",
    27: "idx target accession query qaccession clan mdl mdlfrom mdlto seqfrom seqto strand trunc pass gc bias score evalue inc olp anyidx afrct1 afrct2 winidx wfrct1 wfrct2 description",
    20: "target accession query qaccession mdl mdlfrom mdlto seqfrom seqto strand trunc pass gc bias score evalue inc mdllen seqlen description",
}


#: What the hits of other programs call these columns.
INFERNAL_NAMES = {"target": "sseqid", "query": "qseqid", "mdlfrom": "qstart", "mdlto": "qend", "seqfrom": "sstart", "seqto": "send", "strand": "sstrand", "score": "bitscore", "mdllen": "qlen", "seqlen": "slen"}


def parse_infernal(text: str | Iterable[str], ftype: str | None = None) -> Iterator[dict]:
    columns: list[str] = []
    for line in split_lines(text):
        if line.startswith("#"):
            groups = re.findall(r"-+", line)
            if set(line) <= set("#- ") and len(groups) in INFERNAL_LAYOUTS:
                columns = INFERNAL_LAYOUTS[len(groups)].split()
            continue
        if not line.strip():
            continue
        row = {k: _number(k, v) for k, v in zip(columns, line.split(None, len(columns) - 1), strict=True)}
        row |= {common: row[own] for own, common in INFERNAL_NAMES.items() if own in row}
        strand = row["strand"]
        low, high = sorted((row["seqfrom"], row["seqto"]))
        yield feature(row["target"], row.get(ftype, ftype) if ftype else None, [place(low - 1, high, strand)], row, name=row["query"], score=row["score"], evalue=row["evalue"])


def _motif_texts(text: str | Iterable[str]) -> Iterator[str]:
    """The text of each motif, from its MOTIF line to the next one."""
    block: list[str] | None = None
    for line in lines_of(text):
        if line.startswith("MOTIF") and not line[5:6].strip():
            if block:
                yield "\n".join(block)
            block = []
        if block is not None:
            block.append(line)
    if block:
        yield "\n".join(block)


def parse_meme(text: str | Iterable[str], ftype: str | None = None) -> Iterator[dict]:
    """One feature for each site of each motif."""
    for block in (x for motif in _motif_texts(text) for x in re.split(r"(?m)^MOTIF\s+", motif)[1:]):
        head = block.split("\n", 1)[0]
        words = head.split()
        motif = words[0]
        motif_id = next((w for w in words[1:2] if w.startswith("MEME")), None)
        evalue = re.search(r"E-value\s*=\s*(\S+)", head)
        width = re.search(r"width\s*=\s*(\d+)", head)
        sites = re.search(r"sites sorted by position p-value[^\n]*\n-+\n(.*?)\n-{10,}[ \t]*(?:\n|\Z)", block, re.DOTALL)
        for line in (sites[1].splitlines() if sites else []):
            fields = line.split()
            if len(fields) < 4 or fields[0] in ("Sequence", "-------------"):
                continue
            strand = fields[1] if fields[1] in "+-" else "+"
            rest = fields[2:] if fields[1] in "+-" else fields[1:]
            if not rest[0].isdigit():
                continue
            size = int(width[1]) if width else len(motif)
            yield feature(fields[0], ftype or "motif", [place(int(rest[0]) - 1, int(rest[0]) - 1 + size, strand)], {"motif": motif, "motif_id": motif_id, "pvalue": float(rest[1])}, name=motif, evalue=float(evalue[1]) if evalue else None)
