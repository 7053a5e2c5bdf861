"""Fixed schemas of the library's relations."""

HIT_TABLE = (
    "query_acc string, subject_acc string, hit_id string, hit_def string, n_identical long, alignment_length long, gap_opens long, "
    "q_start long, q_end long, s_start long, s_end long, evalue double, bit_score double"
)
SEQ_INFO = (
    "accession string, start long, end long, strand int, length long, date string, description string, source string, organism string, "
    "taxonomy string, title string, authors string, journal string, organelle string, mol_type string, db_xref string, specimen_voucher string, "
    "country string, lat_lon string, collection_date string, collected_by string, identified_by string"
)
