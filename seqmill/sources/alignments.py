"""Alignment formats: sniffing, reading, writing, converting."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

FORMATS = ("fasta", "pir", "clustal", "nexus", "mega", "phylip", "phylip3.2")
Rows = list[tuple[str, str]]


def sniff(text: str) -> str | None:
    """Format by the first word; of the two PHYLIPs by the body's shape."""
    head = text.lstrip()
    first = head.split(None, 1)[0] if head else ""
    if first.upper().startswith("CLUSTAL"):
        return "clustal"
    if re.match(r">[A-Za-z]{1,2}\d?;", first):
        return "pir"
    if first.startswith(">"):
        return "fasta"
    if first.upper() == "#NEXUS":
        return "nexus"
    if first.upper() == "#MEGA":
        return "mega"
    m = re.match(r"\s*(\d+)\s+(\d+)\s*\n", text)
    if m:
        n, width = int(m.group(1)), int(m.group(2))
        lines = [x for x in text[m.end() :].splitlines() if x.strip()]
        # sequential rows are full before the next name comes
        if n > 1 and lines:
            got, k = len("".join(lines[0].split()[1:])), 1
            while got < width and k < len(lines) and (lines[k][:1].isspace() or len(lines[k].split()) == 1):
                got += len("".join(lines[k].split()))
                k += 1
            if k > 1 and got == width and k * n == len(lines):
                return "phylip3.2"
        return "phylip"
    return None


def _fasta(text: str) -> Rows:
    out = []
    for part in re.split(r"(?m)^>", text)[1:]:
        head, _, body = part.partition("\n")
        out.append((head.strip(), re.sub(r"\s", "", body)))
    return out


def _pir(text: str) -> Rows:
    out = []
    for part in re.split(r"(?m)^>", text)[1:]:
        lines = part.splitlines()
        out.append((lines[0].split(";", 1)[-1].strip(), re.sub(r"\s", "", "".join(lines[2:])).rstrip("*")))
    return out


def _blocks(lines: Iterator[str]) -> Rows:
    rows: dict[str, list[str]] = {}
    for line in lines:
        parts = line.split()
        if len(parts) >= 2 and not line[0].isspace():
            seq = parts[1:-1] if len(parts) > 2 and parts[-1].isdigit() else parts[1:]
            rows.setdefault(parts[0], []).extend(seq)
    return [(k, "".join(v)) for k, v in rows.items()]


def _clustal(text: str) -> Rows:
    return _blocks(iter(text.lstrip().splitlines()[1:]))


def _nexus(text: str) -> Rows:
    text = re.sub(r"\[[^\]]*\]", "", text)
    m = re.search(r"(?is)\bmatrix\b(.*?);", text)
    gap = re.search(r"(?i)\bgap\s*=\s*(\S)", text)
    rows = _blocks(x.lstrip() for x in (m.group(1) if m else "").splitlines() if x.strip())
    return [(n.strip("'\""), s.replace(gap.group(1), "-") if gap else s) for n, s in rows]


def _mega(text: str) -> Rows:
    rows: dict[str, list[str]] = {}
    for line in text.splitlines()[1:]:
        if line.startswith("#"):
            parts = line[1:].split()
            rows.setdefault(parts[0], []).extend(parts[1:])
            last = parts[0]
        elif line.strip() and not line.startswith("!") and not line.upper().startswith("TITLE") and rows:
            rows[last].extend(line.split())
    return [(k, "".join(v)) for k, v in rows.items()]


def _phylip(text: str) -> Rows:
    lines = text.splitlines()
    n = int(lines[0].split()[0])
    body = [x for x in lines[1:] if x.strip()]
    names = [x.split()[0] for x in body[:n]]
    seqs = ["".join(x.split()[1:]) for x in body[:n]]
    for i, line in enumerate(body[n:]):
        seqs[i % n] += "".join(line.split())
    return list(zip(names, seqs))


def _phylip32(text: str) -> Rows:
    lines = text.splitlines()
    n, width = map(int, lines[0].split()[:2])
    out: Rows = []
    for line in lines[1:]:
        if not line.strip():
            continue
        if not out or len(out[-1][1]) >= width:
            out.append((line.split()[0], "".join(line.split()[1:])))
        else:
            out[-1] = (out[-1][0], out[-1][1] + "".join(line.split()))
    return out[:n]


_READ = {"fasta": _fasta, "pir": _pir, "clustal": _clustal, "nexus": _nexus, "mega": _mega, "phylip": _phylip, "phylip3.2": _phylip32}


def parse(text: str, form: str | None = None) -> Rows:
    """(name, row) of an alignment text; letters become upper case."""
    form = form or sniff(text)
    if form is None:
        raise ValueError("unknown alignment format")
    return [(n, s.upper()) for n, s in _READ[form](text.replace("\r\n", "\n"))]


def read_alignments(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(aln_id, seq_id, seq): alignments of any format, one file one alignment,
    named by its path, as files of one name may lie in several folders.
    A list file (one path per line) is read by ``read_file_list``."""
    files = spark.read.text([path] if isinstance(path, str) else list(path), wholetext=True).select(F.col("_metadata.file_path").alias("aln_id"), "value")

    return parsed(files.select("aln_id", F.col("value").alias("text")))


def parsed(texts: DataFrame) -> DataFrame:
    """(aln_id, seq_id, seq) of alignment texts (aln_id, text) of any format."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(a, n, s) for a, t in zip(b["aln_id"], b["text"]) for n, s in parse(t)]
            yield pd.DataFrame(rows, columns=["aln_id", "seq_id", "seq"])

    return texts.mapInPandas(read, f"aln_id {texts.schema['aln_id'].dataType.simpleString()}, seq_id string, seq string")


def read_file_list(spark: SparkSession, path: str) -> DataFrame:
    """Alignments named in a list file; such lists are short."""
    names = [r.value.strip() for r in spark.read.text(path).toLocalIterator() if r.value.strip()]
    return read_alignments(spark, names)


def safe_name(name: str) -> str:
    """Characters with a meaning in PHYLIP become one underscore."""
    new = re.sub(r"[\t\n :,)(;\]\[']", "_", name)
    return re.sub(r"_+", "_", new).strip("_") if new != name else name


def write(rows: Rows, form: str, amino: bool = False) -> str:
    n, width = len(rows), max((len(s) for _, s in rows), default=0)
    pad = max((len(x) for x, _ in rows), default=0) + 1
    cut = lambda s, k: [s[i : i + k] for i in range(0, len(s), k)] or [""]
    if form == "fasta":
        return "".join(f">{x}\n" + "\n".join(cut(s, 60)) + "\n" for x, s in rows)
    if form == "pir":
        kind = "P1" if amino else "DL"
        return "".join(f">{kind};{x}\n{x} {len(s)} bases\n" + "\n".join(cut(s, 60)) + "*\n" for x, s in rows)
    if form in ("phylip", "phylip3.2"):
        names = [safe_name(x) for x, _ in rows]
        pad = max(map(len, names), default=0) + 1
        head = f" {n} {width}\n"
        if form == "phylip":
            return head + "".join(f"{x:<{pad}}{s}\n" for x, (_, s) in zip(names, rows))
        return head + "".join(f"{x:<{pad}}" + ("\n" + " " * pad).join(cut(s, 60)) + "\n" for x, (_, s) in zip(names, rows))
    if form == "clustal":
        blocks = range(0, max(width, 1), 60)
        return "CLUSTAL multiple sequence alignment\n\n\n" + "\n\n".join("\n".join(f"{x:<{pad + 5}}{s[i : i + 60]}" for x, s in rows) for i in blocks) + "\n"
    if form == "nexus":
        kind = "PROTEIN" if amino else "DNA"
        body = "\n".join(f"{x:<{pad}}{s}" for x, s in rows)
        return f"#NEXUS\nBEGIN DATA;\n DIMENSIONS NTAX={n} NCHAR={width};\nFORMAT DATATYPE={kind} INTERLEAVE=no GAP=-;\nMATRIX\n{body}\n;\nEND;\n"
    if form == "mega":
        return "#MEGA\n\n" + "".join(f"#{x}\n" + "\n".join(cut(s, 60)) + "\n" for x, s in rows)
    raise ValueError(f"unknown format {form}")


def written(aln: DataFrame, form: str) -> DataFrame:
    """(aln_id, text): each alignment as one text of the format; those with rows
    of different lengths are skipped by the PHYLIP forms."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq_id", kind="stable")
        rows = list(zip(g["seq_id"].astype(str), g["seq"]))
        if form.startswith("phylip") and len({len(s) for _, s in rows}) > 1:
            return pd.DataFrame({"aln_id": [], "text": []})
        return pd.DataFrame({"aln_id": [g["aln_id"].iloc[0]], "text": [write(rows, form)]})

    kind = aln.schema["aln_id"].dataType.simpleString()
    return aln.select("aln_id", "seq_id", "seq").groupBy("aln_id").applyInPandas(one, f"aln_id {kind}, text string")


def trimming_report(rows: Rows, kept: Sequence[bool], width: int = 60) -> str:
    """HTML of an alignment in blocks, kept columns marked."""
    pad = max((len(x) for x, _ in rows), default=0) + 1
    out = ["<html><head><style>.k{background:#cde}</style></head><body><pre>"]
    for i in range(0, len(kept), width):
        for name, seq in rows:
            line = "".join(f'<span class="k">{html.escape(c)}</span>' if k else html.escape(c) for c, k in zip(seq[i : i + width], kept[i : i + width]))
            out.append(f"{html.escape(name):<{pad}}{line}")
        out.append("")
    return "\n".join([*out, "</pre></body></html>"])


def read_similarity_matrix(text: str) -> list[tuple[str, str, float]]:
    """(a, b, score) of a residue matrix; an optional first column repeats the
    letters, and the two triangles are averaged."""
    lines = [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    letters = lines[0].split()
    rows = [x.split() for x in lines[1 : len(letters) + 1]]
    scores = [[float(v) for v in (r[1:] if len(r) > len(letters) or not re.match(r"-?\d", r[0]) else r)] for r in rows]
    full = [[scores[i][j] if j < len(scores[i]) else scores[j][i] for j in range(len(letters))] for i in range(len(letters))]
    return [(a, b, (full[i][j] + full[j][i]) / 2) for i, a in enumerate(letters) for j, b in enumerate(letters)]
