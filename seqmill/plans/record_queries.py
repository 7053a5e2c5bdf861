"""Queries over records, names, sequences and selections, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sequence as S
from ..functions.values import accession_key, accession_key_sql, usable, usable_sql
from ..operators import kmer, matrix, records, selection
from ..operators.packed_values import split_packed
from ..operators.timestamps import normalise_times
from ..runtime import table
from ..sources import records as sink
from .relations import MARKERS, marker_alignments


def _info(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "seq_info")


def combine_species(spark: SparkSession, d: str) -> DataFrame:
    """Every rank token in turn stands behind the species."""
    tokens = F.array(*[F.lit(t) for ts in S.RANKS.values() for t in ts])
    rank = F.get(tokens, (F.col("doc_id") % F.size(tokens)).cast("int"))
    x = table(spark, d, "documents").where("taxon_name is not null").select(F.concat(F.replace("taxon_name", F.lit("_"), F.lit(" ")), rank, F.coalesce("source", F.lit("x"))).alias("organism"), "doc_id")
    return x.select("doc_id", S.combine_species(F.col("organism")).alias("species"))


def exceptional_filter(spark: SparkSession, d: str) -> DataFrame:
    x = _info(spark, d)
    rows = x.select("info_id", "accession", F.repeat(F.lit("A"), F.col("length").cast("int")).alias("seq"))
    return records.exceptional_filter(rows, x, length_threshold=300).select("info_id", "accession", "organism")


def dedup_seq_voucher(spark: SparkSession, d: str) -> DataFrame:
    x = _info(spark, d).select("organism", F.col("description").alias("seq"), "specimen_voucher", "info_id")
    return records.remove_duplicates(x, ["info_id"])


def first_per_accession(spark: SparkSession, d: str) -> DataFrame:
    return records.first_rows(_info(spark, d).select("accession", "loaded_at", "info_id", "organism"), ["accession"], ["loaded_at", "info_id"]).select("accession", "info_id", "organism")


def repeated_accessions(spark: SparkSession, d: str) -> DataFrame:
    return records.duplicated(_info(spark, d), ["accession"])


def annotation_check(spark: SparkSession, d: str) -> DataFrame:
    x = _info(spark, d)
    ok = S.annotation_ok(F.array("description", "title", "organelle"), ["ITS", "mitochon drion"], ["partial genome", "chloro plast"])
    return x.select("info_id", ok.alias("ok"))


def _lineages(info: DataFrame) -> DataFrame:
    """(info_id, path) of every record with a lineage, however it is written."""
    names = split_packed(info, fields={"taxonomy": "taxonomy"})
    return names.groupBy("info_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("path"))


def lineage_ranks(spark: SparkSession, d: str) -> DataFrame:
    x = _info(spark, d).select("info_id", "organism").join(_lineages(_info(spark, d)), "info_id")
    return x.select("info_id", S.genus_of(F.col("path")).alias("genus"), S.upper_taxon(F.col("path"), F.col("organism")).alias("upper_taxon"))


def upper_taxon_sizes(spark: SparkSession, d: str) -> DataFrame:
    x = _lineages(_info(spark, d)).select(S.genus_of(F.col("path")).alias("genus"), F.try_element_at("path", F.lit(2)).alias("kingdom"))
    return x.where("genus is not null").groupBy("kingdom", "genus").agg(F.count(F.lit(1)).alias("n"))


def borrowed_reference(spark: SparkSession, d: str) -> DataFrame:
    return selection.borrowed_reference(upper_taxon_sizes(spark, d).where("kingdom is not null"), "kingdom", "genus", "n", 5)


def record_predicate(spark: SparkSession, d: str) -> DataFrame:
    """A date without day or month counts as its first day. Without SQL, which
    cannot read the many forms of dates."""
    info = _info(spark, d)
    dates = normalise_times(info, table(spark, d, "deposit_sites"), fields=("date",))
    day = F.to_date(F.substring(F.concat("norm", F.substring(F.lit("0001-01-01"), F.length("norm") + 1, F.lit(10))), 1, 10))
    x = info.select("info_id", "title").join(dates.select("info_id", day.alias("_day")), "info_id").join(_lineages(info), "info_id")
    return x.where(records.record_predicate(["Viridiplantae"], "Phylogeny|Notes", "2005-01-01", "2015-12-31", F.col("_day"), F.col("path"))).select("info_id")


def marker_counts(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "query_info").select(F.regexp_extract("description", r"(\S+), seed query$", 1).alias("m")).where("m <> ''").distinct()
    return records.marker_counts(_info(spark, d), {r.m: f" {r.m} " for r in names.limit(1000).collect()})  # the project's markers


def not_yet_fetched(spark: SparkSession, d: str) -> DataFrame:
    """By accession without version and spelling, the form in which a fetch asks."""
    want = table(spark, d, "hit_table").select(accession_key(F.col("subject_acc")).alias("accession")).where("accession is not null").distinct()
    info = _info(spark, d).select(accession_key(F.col("accession")).alias("accession"), "length")
    return records.not_yet_fetched(want, info.where("length >= 300"), info.where("length < 300"))


def info_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Left join of results and record metadata by accession, of whatever version
    and however written."""
    b = table(spark, d, "blast_result_long").select(accession_key(F.col("subject_acc")).alias("key"))
    info = _info(spark, d).select(accession_key(F.col("accession")).alias("key"), "organism", "length", "info_id").where("key is not null")
    x = b.join(records.first_rows(info, ["key"], ["info_id"]), "key", "left")
    return x.groupBy("organism").agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("total_length"))


def resolved_names(spark: SparkSession, d: str) -> DataFrame:
    names = _info(spark, d).where("organism is not null").groupBy("organism").agg(F.count(F.lit(1)).alias("n")).where("n > 20").select("organism", F.upper("organism").alias("accepted"))
    return records.resolve_names(_info(spark, d).select("info_id", "organism"), names).select("info_id", "organism", "organism_ori")


def headers(spark: SparkSession, d: str) -> DataFrame:
    x = _info(spark, d).select("info_id", "accession", "seq_start", "strand", "organism", "description", F.repeat(F.lit("A"), F.col("length").cast("int")).alias("seq"))
    h = S.header_of(F.col("accession"), F.col("seq_start"), F.col("seq"), F.col("strand") == 2, S.without_apostrophes(F.col("organism")), F.col("description"))
    x = x.withColumn("header", h)
    return x.select("info_id", "header", S.accession_of(F.col("header")).alias("acc"), S.rewrite_coordinates(F.col("header"), F.lit(5), F.lit(9)).alias("rewritten"))


def encodable_headers(spark: SparkSession, d: str) -> DataFrame:
    x = _info(spark, d).select("info_id", S.encodable(F.col("authors")).alias("ok"))
    return x.groupBy("ok").agg(F.count(F.lit(1)).alias("n"))


#: A sequence with wildcards at its head and gaps behind them, in Spark and in DuckDB.
_S = "'NNRY' || repeat('-', CAST(ascii(right(id, 1)) AS INTEGER) % 5 + 1) || substr(sequence, 1, 10) || substr(sequence, 14)"


def sequence_scalars(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "query_info")
    seq = F.expr(_S)
    left, right = S.missing_ends(F.col("s"))
    return q.select("id", seq.alias("s")).select(
        "id", S.length_without_wildcards(F.col("s")).alias("clean_length"), S.acgt_count(F.col("s")).alias("acgt"), S.ungapped(F.col("s")).alias("ungapped"),
        S.reverse_complement(F.col("s")).alias("reverse_complement"), left.alias("missing_left"), right.alias("missing_right"),
        S.trim_residues(F.col("s"), F.lit(5), F.lit(14)).alias("piece"), S.strip_wildcards(F.col("s")).alias("stripped"),
        S.aligned_position(F.col("s"), F.lit(20)).alias("col_of_20"), S.raw_position(F.col("s"), F.lit(20)).alias("raw_of_20"), S.infer_alphabet(F.col("s")).alias("alphabet"),
    )


def kmer_counts(spark: SparkSession, d: str) -> DataFrame:
    return kmer.kmer_counts(table(spark, d, "search_jobs"), "id", "sequence", 4)


def kmer_similarity(spark: SparkSession, d: str) -> DataFrame:
    return kmer.kmer_similarity(kmer.kmer_counts(table(spark, d, "query_info"), "id", "sequence", 6))


def average_rank(spark: SparkSession, d: str) -> DataFrame:
    x = selection.with_rank_sum(table(spark, d, "blast_result_long").select("eval_id", "sum_hits_score", "source", "record_length"))
    return x.select("eval_id", "rank_sum_hits_score", "rank_source", "rank_record_length", "sum_of_rank")


def _representatives(spark: SparkSession, d: str, consensus: bool) -> DataFrame:
    x = selection.with_rank_sum(table(spark, d, "blast_result_long"))
    return selection.representative_ids(x, usable(F.col("specimen_voucher")), usable(F.col("journal"), journal=True), "eval_id", consensus=consensus)


def representative_per_taxon(spark: SparkSession, d: str) -> DataFrame:
    return _representatives(spark, d, True)


def representative_by_rank(spark: SparkSession, d: str) -> DataFrame:
    return _representatives(spark, d, False)


def saved_representatives(spark: SparkSession, d: str) -> DataFrame:
    """Semi join of the records with the representatives."""
    keep = representative_per_taxon(spark, d).select("eval_id")
    return table(spark, d, "blast_result_long").join(keep, "eval_id", "left_semi").select("eval_id", "taxon_name", "subject_acc")


def longest_per_taxon(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_jobs").where("query is not null")
    return selection.longest_per_group(q.select("query", "sequence", "id"), "query", "sequence", "id").select("query", "id", F.length("sequence").alias("n"))


def backbone_tiers(spark: SparkSession, d: str) -> DataFrame:
    x = _info(spark, d).select("site_code", "info_id", F.repeat(F.lit("A"), F.col("length").cast("int")).alias("seq"))
    return selection.backbone_tiers(x, "site_code", "seq", "info_id", 50).select("info_id", "tier")


def length_clusters(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_jobs").where("query is not null").select("query", "id", "sequence")
    return selection.cluster_means(selection.length_clusters(q, "query", "sequence", 3), "query")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    x = selection.chunks(_info(spark, d).select("site_code", "info_id"), "site_code", "info_id", 40)
    return x.groupBy("site_code", "chunk").agg(F.count(F.lit(1)).alias("n"), F.min("info_id").alias("first_id"))


def length_ratio_split(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_jobs").where("query is not null").select("query", "id", "sequence")
    return selection.length_ratio_split(q, "query", "sequence").groupBy("query").agg(F.count_if("is_short").alias("n_short"), F.count(F.lit(1)).alias("n"))


def longest_share(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "search_jobs").where("query is not null").select("query", "id", "sequence")
    return records.longest_share(q, "query", seq="sequence").select("query", "id")


def combine_markers_pivot(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "hit_table").select(
        F.regexp_extract("hit_def", r"^(\S+ \S+) ", 1).alias("taxon_name"), F.regexp_extract("hit_def", r" (ITS|matK|rbcL|COI) gene", 1).alias("marker"), F.col("subject_acc").alias("record_id")
    )
    return matrix.combine_markers(h.where("marker <> '' and taxon_name <> ''"), ["ITS", "matK", "rbcL", "COI"])


def marker_lengths(spark: SparkSession, d: str) -> DataFrame:
    return matrix.marker_lengths(table(spark, d, "search_jobs").where("query is not null").select(F.col("query").alias("marker"), F.col("sequence").alias("seq")))


def taxon_completion(spark: SparkSession, d: str) -> DataFrame:
    return matrix.complete_taxa(marker_alignments(spark, d))


def supermatrix(spark: SparkSession, d: str) -> DataFrame:
    return matrix.supermatrix(taxon_completion(spark, d))


def partition_ranges(spark: SparkSession, d: str) -> DataFrame:
    return matrix.partition_ranges(marker_alignments(spark, d))


def codon_partitions(spark: SparkSession, d: str) -> DataFrame:
    return matrix.codon_partitions(partition_ranges(spark, d))


def partition_lines(spark: SparkSession, d: str) -> DataFrame:
    return sink.partition_lines(codon_partitions(spark, d))


def seq_info_rows(spark: SparkSession, d: str) -> DataFrame:
    x = sink.seq_info_rows(_info(spark, d).withColumnsRenamed({"seq_start": "start", "seq_end": "end"}))
    return x.groupBy("organelle").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("journal") == "unknown").alias("n_unknown"), F.sum("start").alias("total_start"))


def union_of_taxa(spark: SparkSession, d: str) -> DataFrame:
    a = _info(spark, d).select("organism").where("organism is not null")
    b = table(spark, d, "blast_result_long").select(F.replace("taxon_name", F.lit("_"), F.lit(" ")).alias("organism")).where("organism is not null")
    return a.union(b).distinct()


QUERIES = {
    f.__name__: f
    for f in (
        combine_species, exceptional_filter, dedup_seq_voucher, first_per_accession, repeated_accessions, annotation_check, lineage_ranks, upper_taxon_sizes,
        borrowed_reference, record_predicate, marker_counts, not_yet_fetched, info_lookup, resolved_names, headers, encodable_headers, sequence_scalars,
        kmer_counts, kmer_similarity, average_rank, representative_per_taxon, representative_by_rank, saved_representatives, longest_per_taxon, backbone_tiers,
        length_clusters, chunks, length_ratio_split, longest_share, combine_markers_pivot, marker_lengths, taxon_completion, supermatrix, partition_ranges,
        codon_partitions, partition_lines, seq_info_rows, union_of_taxa,
    )
}

_RANKS = """c AS (SELECT *, (rank() OVER (ORDER BY sum_hits_score DESC) + (count(*) OVER (PARTITION BY sum_hits_score) - 1) / 2.0) AS r1,
  rank() OVER (ORDER BY source) + (count(*) OVER (PARTITION BY source) - 1) / 2.0 AS r2,
  rank() OVER (ORDER BY record_length DESC) + (count(*) OVER (PARTITION BY record_length) - 1) / 2.0 AS r3 FROM blast_result_long WHERE sum_hits_score IS NOT NULL),
c0 AS (SELECT *, rank() OVER (ORDER BY source) + (count(*) OVER (PARTITION BY source) - 1) / 2.0 AS q2,
  rank() OVER (ORDER BY record_length DESC) + (count(*) OVER (PARTITION BY record_length) - 1) / 2.0 AS q3 FROM blast_result_long),
k AS (SELECT c0.*, r1 AS rank_sum_hits_score, q2 AS rank_source, q3 AS rank_record_length, r1 + q3 AS sum_of_rank FROM c0 LEFT JOIN (SELECT eval_id, r1 FROM c) USING (eval_id)),
l AS (SELECT *, CASE WHEN consensus_value IS NULL OR isnan(consensus_value) THEN -1 ELSE consensus_value END AS cv,
  %s AS has_v, %s AS has_j FROM k WHERE taxon_name IS NOT NULL)""" % (usable_sql("specimen_voucher"), usable_sql("journal", journal=True))  # fmt: skip
_BY_CONSENSUS = "cv DESC, has_v DESC, has_j DESC, date DESC NULLS LAST, coalesce(sum_of_rank, 'Infinity'::DOUBLE), eval_id"
_COMPLETE = MARKERS + """,
size AS (SELECT marker, CASE WHEN count(DISTINCT length(seq)) = 1 THEN max(length(seq)) ELSE -1 END AS n FROM aln GROUP BY 1),
done AS (SELECT marker, taxon, coalesce(aln.seq, CASE WHEN n > 0 THEN repeat('-', n) ELSE '---' END) AS seq
  FROM (SELECT DISTINCT taxon FROM aln) CROSS JOIN size LEFT JOIN aln USING (marker, taxon))"""
# quoted and bare values of a lineage, with the delimiters that a bare one may hold
_GENUS = r"""t AS (SELECT info_id, organism, taxonomy AS x FROM seq_info WHERE taxonomy IS NOT NULL AND lower(trim(taxonomy)) NOT IN ('', 'unknown')),
pieces AS (SELECT info_id, organism, regexp_extract_all(x,
  '"(?:[^"\\]|""|\\.)*"|[ \r\f\v]*''(?:[^''\\]|''''|\\.)*''\s*(?:[|>;,/\t\n]|$)|(?:\\.|\([^()]*\),\s*\d{4}\b|\([^()]*\)|\[[^\[\]]*\]|[;,]\s+aggr\.|\b[A-Z]/[A-Z]\b|[^|>;,/\t\n"\\])+') AS p FROM t),
plain AS (SELECT info_id, organism, list_transform(p, lambda v: trim(CASE WHEN ltrim(v) LIKE '''%' THEN regexp_replace(v, '[|>;,/\t\n]$', '') ELSE v END)) AS p FROM pieces),
paths AS (SELECT info_id, organism, list_filter(list_transform(p, lambda v: trim(regexp_replace(CASE WHEN v LIKE '"%"' THEN replace(v[2:-2], '""', '"') WHEN v LIKE '''%''' AND length(v) > 1 THEN replace(v[2:-2], '''''', '''') ELSE v END, '\\(.)', '\1', 'g'))),
  lambda v: v <> '') AS p FROM plain),
g AS (SELECT info_id, organism, p FROM paths WHERE len(p) > 0)"""
_CODON = "CASE %s WHEN 'A' THEN 0 WHEN 'C' THEN 1 WHEN 'G' THEN 2 WHEN 'T' THEN 3 END"


def _kmers(source: str, k: int) -> str:
    code = " + ".join(f"{_CODON % f'substr(w, {i + 1}, 1)'} * {4 ** (k - 1 - i)}" for i in range(k))
    return f"""w AS (SELECT id, unnest(range(1, length(s) - {k} + 2)) AS p, s FROM (SELECT id, upper(translate(sequence, 'RYKMSWBDHVN', '')) AS s FROM {source})),
v AS (SELECT id, substr(s, p, {k}) AS w FROM w),
kc AS (SELECT id, CAST({code} AS BIGINT) AS kmer, count(*) AS n FROM v WHERE regexp_full_match(w, '[ACGT]+') GROUP BY ALL)"""


SQL = {
    "combine_species": """SELECT doc_id, replace(taxon_name, '_', ' ') AS species FROM documents WHERE taxon_name IS NOT NULL""",
    "exceptional_filter": r"""WITH s AS (SELECT accession, any_value(organism) AS organism FROM seq_info WHERE accession IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT info_id, accession, s.organism FROM seq_info JOIN s USING (accession) WHERE length >= 300 AND s.organism IS NOT NULL
AND NOT regexp_matches(replace(s.organism, ' ', '_'), '_(sp|cf|aff|x)\.?_')""",
    "dedup_seq_voucher": """SELECT organism, description AS seq, specimen_voucher, info_id FROM seq_info
QUALIFY row_number() OVER (PARTITION BY organism, description, specimen_voucher ORDER BY info_id) = 1""",
    "first_per_accession": "SELECT accession, info_id, organism FROM seq_info QUALIFY row_number() OVER (PARTITION BY accession ORDER BY loaded_at, info_id) = 1",
    "repeated_accessions": "SELECT accession, count(*) AS n FROM seq_info GROUP BY 1 HAVING count(*) > 1",
    "annotation_check": """WITH t AS (SELECT info_id, list_transform(list_filter([description, title, organelle], lambda x: x IS NOT NULL), lambda x: lower(replace(x, ' ', ''))) AS f FROM seq_info)
SELECT info_id, len(list_filter(f, lambda x: contains(x, 'partialgenome') OR contains(x, 'chloroplast'))) = 0
AND len(list_filter(f, lambda x: contains(x, 'its') OR contains(x, 'mitochondrion'))) > 0 AS ok FROM t""",
    "lineage_ranks": f"""WITH {_GENUS} SELECT info_id, list_filter(p, lambda x: NOT contains(x, ' '))[-1] AS genus,
CASE WHEN list_position(p, organism) > 1 THEN list_filter(p[1:list_position(p, organism) - 1], lambda x: NOT contains(x, ' '))[-1] END AS upper_taxon FROM g""",
    "upper_taxon_sizes": f"""WITH {_GENUS} SELECT p[2] AS kingdom, list_filter(p, lambda x: NOT contains(x, ' '))[-1] AS genus, count(*) AS n FROM g
WHERE list_filter(p, lambda x: NOT contains(x, ' '))[-1] IS NOT NULL GROUP BY ALL""",
    "borrowed_reference": f"""WITH {_GENUS}, s AS (SELECT p[2] AS kingdom, list_filter(p, lambda x: NOT contains(x, ' '))[-1] AS genus, count(*) AS n FROM g
WHERE list_filter(p, lambda x: NOT contains(x, ' '))[-1] IS NOT NULL GROUP BY ALL), k AS (SELECT * FROM s WHERE kingdom IS NOT NULL),
near AS (SELECT kingdom, arg_max(genus, {{'n': n, 'g': genus}}) AS a FROM k WHERE n > 5 GROUP BY 1), far AS (SELECT arg_max(genus, {{'n': n, 'g': genus}}) AS b FROM k WHERE n > 5)
SELECT kingdom, genus, n, CASE WHEN n > 5 THEN genus ELSE coalesce(a, b) END AS reference FROM k LEFT JOIN near USING (kingdom) CROSS JOIN far""",
    "marker_counts": r"""WITH m AS (SELECT DISTINCT regexp_extract(description, '(\S+), seed query$', 1) AS marker FROM query_info)
SELECT marker, count(*) AS n_records FROM seq_info JOIN m ON marker <> '' AND contains(description, ' ' || marker || ' ') GROUP BY 1""",
    "not_yet_fetched": f"""WITH w AS (SELECT DISTINCT {accession_key_sql('subject_acc')} AS accession FROM hit_table), i AS (SELECT {accession_key_sql('accession')} AS a FROM seq_info WHERE length IS NOT NULL)
SELECT accession FROM w WHERE accession IS NOT NULL AND accession NOT IN (SELECT a FROM i WHERE a IS NOT NULL)""",
    "info_lookup": f"""WITH i AS (SELECT *, {accession_key_sql('accession')} AS k FROM seq_info QUALIFY row_number() OVER (PARTITION BY k ORDER BY info_id) = 1)
SELECT organism, count(*) AS n, CAST(sum(length) AS BIGINT) AS total_length FROM blast_result_long b LEFT JOIN i ON {accession_key_sql('b.subject_acc')} = i.k GROUP BY 1""",
    "resolved_names": """WITH n AS (SELECT organism, upper(organism) AS accepted FROM seq_info WHERE organism IS NOT NULL GROUP BY 1 HAVING count(*) > 20)
SELECT info_id, coalesce(accepted, s.organism) AS organism, s.organism AS organism_ori FROM seq_info s LEFT JOIN n ON s.organism = n.organism""",
    "headers": r"""WITH h AS (SELECT info_id, accession || ':' || greatest(seq_start, 1) || '-' || (greatest(seq_start, 1) + length - 1) || CASE WHEN strand = 2 THEN '_reverse_complement' ELSE '' END
|| '|' || replace(replace(organism, '''', ''), ' ', '_') || '|' || description AS header FROM seq_info)
SELECT info_id, header, split_part(split_part(split_part(header, ' ', 1), '|', 1), ':', 1) AS acc, regexp_replace(header, '^(.*?)\d+-\d+', '\15-9') AS rewritten FROM h""",
    "sequence_scalars": rf"""WITH q AS (SELECT id, {_S} AS s FROM query_info)
SELECT id, length(translate(upper(s), 'RYKMSWBDHVN', '')) AS clean_length, length(regexp_replace(upper(s), '[^ACGT]', '', 'g')) AS acgt, replace(s, '-', '') AS ungapped,
reverse(translate(s, 'ACGTURYKMBVDHacgturykmbvdh', 'TGCAAYRMKVBHDtgcaayrmkvbhd')) AS reverse_complement, length(regexp_extract(upper(s), '^([^ACGT]*)', 1)) AS missing_left,
length(regexp_extract(upper(s), '([^ACGT]*)$', 1)) AS missing_right, substr(s, 5, 10) AS piece, translate(upper(s), 'RYKMSWBDHVN', '') AS stripped, list_filter(range(1, length(s) + 1), lambda i: substr(s, i, 1) <> '-')[20] AS col_of_20, length(replace(substr(s, 1, 20), '-', '')) AS raw_of_20,
CASE WHEN length(regexp_replace(substr(replace(s, '-', ''), 1, 100), '[^AGCTN]', '', 'g')) < 95 THEN 'AA' ELSE 'DNA' END AS alphabet FROM q""",
    "kmer_counts": f"WITH {_kmers('search_jobs', 4)} SELECT * FROM kc",
    "kmer_similarity": f"""WITH {_kmers('query_info', 6)}, z AS (SELECT id, sum(n) AS size FROM kc GROUP BY 1), c AS (SELECT * FROM kc JOIN z USING (id))
SELECT a.id AS i, b.id AS j, round(sum(least(a.n, b.n)) / least(min(a.size), min(b.size)), 6) AS similarity FROM c a JOIN c b ON a.kmer = b.kmer AND a.id < b.id GROUP BY ALL""",
    "average_rank": f"WITH {_RANKS} SELECT eval_id, rank_sum_hits_score, rank_source, rank_record_length, sum_of_rank FROM k",
    "representative_per_taxon": f"WITH {_RANKS} SELECT taxon_name, eval_id, sum_of_rank FROM l QUALIFY row_number() OVER (PARTITION BY taxon_name ORDER BY {_BY_CONSENSUS}) = 1",
    "representative_by_rank": f"""WITH {_RANKS} SELECT taxon_name, eval_id, sum_of_rank FROM l
QUALIFY row_number() OVER (PARTITION BY taxon_name ORDER BY coalesce(sum_of_rank, 'Infinity'::DOUBLE), {_BY_CONSENSUS}) = 1""",
    "saved_representatives": f"WITH {_RANKS} SELECT eval_id, taxon_name, subject_acc FROM l QUALIFY row_number() OVER (PARTITION BY taxon_name ORDER BY {_BY_CONSENSUS}) = 1",
    "longest_per_taxon": "SELECT query, id, length(sequence) AS n FROM search_jobs WHERE query IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query ORDER BY length(sequence) DESC, id) = 1",
    "backbone_tiers": """WITH r AS (SELECT info_id, site_code, length, row_number() OVER (PARTITION BY site_code ORDER BY length DESC, info_id) AS r FROM seq_info),
c AS (SELECT site_code, min(length) FILTER (r <= 50) AS last FROM r GROUP BY 1)
SELECT info_id, CASE WHEN r <= 50 THEN 'long' WHEN length < last / 2 THEN 'fragment' ELSE 'add' END AS tier FROM r JOIN c USING (site_code)""",
    "length_clusters": """WITH l AS (SELECT DISTINCT query, length(sequence) AS n FROM search_jobs WHERE query IS NOT NULL),
g AS (SELECT *, n - lag(n) OVER (PARTITION BY query ORDER BY n) AS g FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY g DESC NULLS LAST, n DESC) AS r FROM g),
c AS (SELECT query, n, sum(CASE WHEN g IS NOT NULL AND r < 3 THEN 1 ELSE 0 END) OVER (PARTITION BY query ORDER BY n ROWS UNBOUNDED PRECEDING) AS cluster FROM r)
SELECT query, CAST(cluster AS INTEGER) AS cluster, round(avg(n), 6) AS mean_length, count(*) AS n FROM (SELECT j.query, c.cluster, length(sequence) AS n FROM search_jobs j
JOIN c ON j.query = c.query AND length(sequence) = c.n) GROUP BY 1, 2""",
    "chunks": """WITH p AS (SELECT site_code, info_id, row_number() OVER (PARTITION BY site_code ORDER BY info_id) - 1 AS p, count(*) OVER (PARTITION BY site_code) AS n FROM seq_info)
SELECT site_code, CAST(floor(p * ceil(n / 40.0) / n) AS INTEGER) AS chunk, count(*) AS n, min(info_id) AS first_id FROM p GROUP BY 1, 2""",
    "length_ratio_split": """WITH m AS (SELECT query, length(sequence) AS n, max(length(sequence)) OVER (PARTITION BY query) AS m FROM search_jobs WHERE query IS NOT NULL)
SELECT query, count(*) FILTER (n < 0.6 * m) AS n_short, count(*) AS n FROM m GROUP BY 1""",
    "longest_share": """SELECT query, id FROM search_jobs WHERE query IS NOT NULL QUALIFY length(sequence) > 0.7 * max(length(sequence)) OVER (PARTITION BY query)""",
    "combine_markers_pivot": r"""WITH h AS (SELECT regexp_extract(hit_def, '^(\S+ \S+) ', 1) AS t, regexp_extract(hit_def, ' (ITS|matK|rbcL|COI) gene', 1) AS m, subject_acc AS a FROM hit_table WHERE hit_def IS NOT NULL)
SELECT t AS taxon_name, coalesce(min(a) FILTER (m = 'ITS'), '-') AS "ITS", coalesce(min(a) FILTER (m = 'matK'), '-') AS "matK", coalesce(min(a) FILTER (m = 'rbcL'), '-') AS "rbcL",
coalesce(min(a) FILTER (m = 'COI'), '-') AS "COI" FROM h WHERE m <> '' AND t <> '' GROUP BY t""",
    "marker_lengths": """SELECT query AS marker, CASE WHEN count(DISTINCT length(sequence)) = 1 THEN max(length(sequence)) WHEN max(length(sequence)) IS NULL THEN 0 ELSE -1 END AS length
FROM search_jobs WHERE query IS NOT NULL GROUP BY 1""",
    "taxon_completion": f"WITH {_COMPLETE} SELECT marker, taxon, seq FROM done",
    "supermatrix": f"WITH {_COMPLETE} SELECT taxon, string_agg(seq, '' ORDER BY marker) AS seq FROM done GROUP BY taxon",
    "partition_ranges": f"""WITH {MARKERS}, z AS (SELECT marker, max(length(seq)) AS n FROM aln GROUP BY 1)
SELECT marker, CAST(sum(n) OVER (ORDER BY marker) - n + 1 AS BIGINT) AS start_col, CAST(sum(n) OVER (ORDER BY marker) AS BIGINT) AS end_col FROM z""",
    "codon_partitions": f"""WITH {MARKERS}, z AS (SELECT marker, max(length(seq)) AS n FROM aln GROUP BY 1), r AS (SELECT marker, sum(n) OVER (ORDER BY marker) - n + 1 AS a, sum(n) OVER (ORDER BY marker) AS b FROM z)
SELECT marker || '_' || (p + 1) AS name, CAST(a + p AS BIGINT) AS start_col, CAST(b AS BIGINT) AS end_col, 3 AS step FROM r CROSS JOIN (VALUES (0), (1), (2)) v(p)""",
    "partition_lines": f"""WITH {MARKERS}, z AS (SELECT marker, max(length(seq)) AS n FROM aln GROUP BY 1), r AS (SELECT marker, sum(n) OVER (ORDER BY marker) - n + 1 AS a, sum(n) OVER (ORDER BY marker) AS b FROM z)
SELECT marker || '_' || (p + 1) AS name, marker || '_' || (p + 1) || ' = ' || CAST(a + p AS BIGINT) || '-' || CAST(b AS BIGINT) || '\\3;' AS line FROM r CROSS JOIN (VALUES (0), (1), (2)) v(p)""",
    "seq_info_rows": """SELECT coalesce(organelle, 'unknown') AS organelle, count(*) AS n, count(*) FILTER (coalesce(journal, 'unknown') = 'unknown') AS n_unknown,
CAST(sum(seq_start) AS BIGINT) AS total_start FROM seq_info GROUP BY 1""",
    "union_of_taxa": "SELECT organism FROM seq_info WHERE organism IS NOT NULL UNION SELECT replace(taxon_name, '_', ' ') FROM blast_result_long WHERE taxon_name IS NOT NULL",
}
