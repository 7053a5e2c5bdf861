"""Search hits: parsing rules, joining, selection, extension, rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.sequence import hit_id_accession
from ..runtime import is_small

#: Total order of a group's hits: best first.
_ORDER = ["bit_score", "alignment_length", "n_identical"]
_TIES = ["s_start", "s_end", "q_start", "q_end"]


def with_strands(hits: DataFrame) -> DataFrame:
    """Strand flags; a hit of one base counts as negative."""
    return hits.withColumns({"q_strand": F.col("q_end") - F.col("q_start") > 0, "s_strand": F.col("s_end") - F.col("s_start") > 0})


def allowed_length(query_length: Column, max_length: int) -> Column:
    return F.least(query_length * 1.05, F.lit(float(max_length)))


def join_hits(hits: DataFrame, queries: DataFrame, max_length: int, legacy_negative_fold: bool = False, legacy_negative_join: bool = False) -> DataFrame:
    """One joined interval per query and subject.

    Hits of a pair are taken best first. Those on another strand than the best
    or not in line with it are dropped; then the interval grows hit by hit while
    its length stays within ``least(1.05 * query length, max_length)``. Counts
    and sums cover all hits in line, also those refused by the length.

    One shuffle by pair; equal hits are collapsed before it, and the fold is an
    expression over the sorted array of a pair's distinct alignments.
    Hits of unknown queries and null pairs give nothing.
    """
    keys = ["query_acc", "subject_acc"]
    distinct = hits.where(F.col("subject_acc").isNotNull()).groupBy(*keys, *_ORDER, *_TIES).agg(F.count(F.lit(1)).alias("n"))
    element = F.struct(*[(-F.col(c)).alias(c) for c in _ORDER], *_TIES, "n")
    grouped = distinct.groupBy(*keys).agg(F.array_sort(F.collect_list(element)).alias("h"))
    dims = queries.select(F.col("id").alias("query_acc"), F.col("sequence_length").alias("query_length"))
    grouped = grouped.join(F.broadcast(dims) if _bounded(dims) else dims, "query_acc")
    b = F.col("h")[0]

    def sign_ok(x: Column, flip: Column) -> Column:
        dqs, dqe = F.signum(x["q_start"] - b["q_start"]), F.signum(x["q_end"] - b["q_end"])
        dss, dse = F.signum(x["s_start"] - b["s_start"]), F.signum(x["s_end"] - b["s_end"])
        return (dqs == dqe) & (dss == dse) & (dss * flip == dqs)

    s_up, q_up = b["s_end"] > b["s_start"], b["q_end"] > b["q_start"]
    flip = F.lit(1.0) if legacy_negative_join else F.when(s_up, 1.0).otherwise(-1.0)
    inline = F.filter(
        "h", lambda x: ((x["q_end"] > x["q_start"]) == q_up) & ((x["s_end"] > x["s_start"]) == s_up) & sign_ok(x, flip)
    )
    step1 = grouped.select(*keys, "query_length", inline.alias("h"), s_up.alias("s_strand"), q_up.alias("q_strand"))
    allowed = allowed_length(F.col("query_length"), max_length)
    lo, hi = (lambda x: F.least(x["s_start"], x["s_end"])), (lambda x: F.greatest(x["s_start"], x["s_end"]))
    first = F.col("h")[0]
    zero = F.struct(
        lo(first).alias("lo"), hi(first).alias("hi"), first["q_start"].alias("q0"), first["q_end"].alias("q1")
    )

    def grow(acc: Column, x: Column) -> Column:
        down, up = lo(x) < acc["lo"], hi(x) > acc["hi"]
        nlo, nhi = F.least(lo(x), acc["lo"]), F.greatest(hi(x), acc["hi"])
        # on the minus strand the low subject end goes with the high query end
        q0 = F.when(F.col("s_strand"), F.when(down, x["q_start"]).otherwise(acc["q0"])).otherwise(F.when(up, x["q_start"]).otherwise(acc["q0"]))
        q1 = F.when(F.col("s_strand"), F.when(up, x["q_end"]).otherwise(acc["q1"])).otherwise(F.when(down, x["q_end"]).otherwise(acc["q1"]))
        ok = nhi - nlo + 1 <= F.col("allowed")
        pick = lambda new, old: F.when(ok, new).otherwise(old)
        return F.struct(pick(nlo, acc["lo"]).alias("lo"), pick(nhi, acc["hi"]).alias("hi"), pick(q0, acc["q0"]).alias("q0"), pick(q1, acc["q1"]).alias("q1"))

    body = F.slice("h", F.lit(2), F.greatest(F.size("h") - (F.when(F.col("s_strand"), 1).otherwise(2) if legacy_negative_fold else 1), F.lit(0)))
    folded = step1.withColumn("allowed", allowed).withColumn("f", F.aggregate(body, zero, grow))
    total = lambda f, zero: F.aggregate("h", zero, lambda a, x: a + f(x))
    return folded.select(
        *keys,
        F.when(F.col("s_strand"), F.col("f.lo")).otherwise(F.col("f.hi")).alias("s_start"),
        F.when(F.col("s_strand"), F.col("f.hi")).otherwise(F.col("f.lo")).alias("s_end"),
        F.col("f.q0").alias("q_start"),
        F.col("f.q1").alias("q_end"),
        "q_strand",
        "s_strand",
        total(lambda x: x["n"], F.lit(0).cast("long")).alias("hits_num"),
        total(lambda x: -x["alignment_length"] * x["n"], F.lit(0).cast("long")).alias("sum_hits_alignlen"),
        F.round(total(lambda x: -x["bit_score"] * x["n"], F.lit(0.0)), 4).alias("sum_hits_score"),
    )


def _bounded(dims: DataFrame) -> bool:
    return is_small(dims)


def select_hits(joined: DataFrame) -> DataFrame:
    """Best joined hit of each subject, over all queries."""
    order = [F.desc("sum_hits_score"), F.desc("sum_hits_alignlen"), "query_acc"]
    return joined.withColumn("_r", F.row_number().over(W.partitionBy("subject_acc").orderBy(*order))).where("_r = 1").drop("_r")


def extend_hits(selected: DataFrame, queries: DataFrame, max_length: int) -> DataFrame:
    """Coordinates extended over unmatched and missing query ends.

    If both wishes exceed the room left under ``max_length`` they share it in
    proportion, each rounded down; without room beyond the query's own length
    only its unmatched ends are added. Null missing ends count as 0.
    """
    dims = queries.select(
        F.col("id").alias("query_acc"), F.col("sequence_length").alias("qlen"),
        F.coalesce("missing_left", F.lit(0)).alias("ml"), F.coalesce("missing_right", F.lit(0)).alias("mr"),
    )
    x = selected.join(F.broadcast(dims) if _bounded(dims) else dims, "query_acc")
    x = x.withColumns({
        "hit_len": F.abs(F.col("s_end") - F.col("s_start")) + 1,
        "auto_extension_left": F.col("q_start") - 1,
        "auto_extension_right": F.col("qlen") - F.col("q_end"),
    })
    x = x.withColumn("max_extension", F.lit(max_length) - F.col("hit_len"))
    both = F.lit(max_length) > F.col("qlen")
    wl = F.col("auto_extension_left") + F.when(both, F.col("ml")).otherwise(0)
    wr = F.col("auto_extension_right") + F.when(both, F.col("mr")).otherwise(0)
    x = x.withColumns({"wl": wl, "wr": wr})
    tight = both & (F.col("wl") + F.col("wr") > 0) & (F.col("wl") + F.col("wr") > F.col("max_extension"))
    part = F.col("wl") / (F.col("wl") + F.col("wr"))
    x = x.withColumns({
        "extension_left": F.when(tight, F.floor(F.col("max_extension") * part)).otherwise(F.col("wl")).cast("long"),
        "extension_right": F.when(tight, F.floor(F.col("max_extension") * (1 - part))).otherwise(F.col("wr")).cast("long"),
    })
    up = F.col("s_end") > F.col("s_start")
    return x.withColumns({
        "q_extstart": F.col("q_start") - F.col("extension_left"),
        "q_extend": F.col("q_end") + F.col("extension_right"),
        "s_extstart": F.when(up, F.col("s_start") - F.col("extension_left")).otherwise(F.col("s_start") + F.col("extension_left")),
        "s_extend": F.when(up, F.col("s_end") + F.col("extension_right")).otherwise(F.col("s_end") - F.col("extension_right")),
    }).drop("wl", "wr", "qlen").withColumnsRenamed({"ml": "extra_extension_left", "mr": "extra_extension_right"})


def new_hits(tmp: DataFrame, known: DataFrame, key: str = "subject_acc") -> DataFrame:
    """Rows whose accession no earlier round has."""
    return tmp.join(known.select(key), key, "left_anti")


def first_round(results: DataFrame, key: str = "subject_acc", round_col: str = "source") -> DataFrame:
    """Round in which each accession first came up."""
    return results.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(round_col).alias("first_round"))


def round_counters(results: DataFrame, key: str, ok: Column, round_col: str = "source") -> DataFrame:
    """Per round: new accessions, those passing ``ok``, and the running total."""
    per_key = results.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.col(round_col).alias("r"), (~ok).alias("bad"))).alias("m"))
    per_round = per_key.groupBy(F.col("m.r").alias("round")).agg(F.count(F.lit(1)).alias("n_new"), F.count_if(~F.col("m.bad")).alias("n_good"))
    # a row per round: the window is over the few rounds, not over rows
    return per_round.withColumn("n_total", F.sum("n_new").over(W.orderBy("round").rowsBetween(W.unboundedPreceding, 0)))


def should_stop(counters: list[tuple[int, int, int]], expected: int, least_new: int = 3, factor: float = 1.2) -> bool:
    """Stop rule of the iteration over (round, new good, total), last round last."""
    if not counters:
        return False
    if counters[-1][2] > factor * expected:
        return True
    return len(counters) >= 2 and counters[-1][1] < least_new and counters[-2][1] < least_new


def expand_aliases(raw: DataFrame, defs: str = "hit_def", hit_id: str = "hit_id") -> DataFrame:
    """A row per hit definition: the first goes with ``hit_id``; a further one,
    after ``>``, counts if its id has five ``|`` parts and a title."""
    x = raw.select("*", F.posexplode_outer(F.split(defs, ">")).alias("_p", "_t"))
    own = F.col("_p").isNull() | (F.col("_p") == 0)
    ident = F.substring_index("_t", " ", 1)
    title = F.expr("substring(_t, length(substring_index(_t, ' ', 1)) + 2)")
    x = x.withColumns({"_id": F.when(own, F.col(hit_id)).otherwise(ident), "_title": F.when(own, F.col("_t")).otherwise(title)})
    x = x.where(own | ((F.size(F.split("_id", r"\|")) == 5) & (F.length("_title") > 0)))
    return x.drop(defs, hit_id, "_p", "_t").withColumnsRenamed({"_id": hit_id, "_title": defs}).withColumn("subject_acc", hit_id_accession(F.col(hit_id)))
