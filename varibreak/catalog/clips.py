"""Soft-clip clusters, consensus and remapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as C
from .. import views
from ..functions import dna
from ..operators import clips, match, seeds
from ..session import cut_lineage
from .reads import OVERLAP, TILE
from .registry import query
from .shared import CLUSTERS_SQL, SOFT_CLIP_SQL, WALK_SQL

KEYS = ["sample", "chrom"]
AT = ["sample", "chrom", "side", "position"]


def clusters(spark, d, **kw):
    return clips.clip_clusters(views.aln(spark, d), KEYS, **kw)


@query("ag08_clip_counts", "aln", CLUSTERS_SQL.replace("HAVING count(*) >= 3 AND sum(nb) >= 30", "") + """
SELECT sample, chrom, side, position, nreads, nbases FROM sup""")
def clip_counts(spark, d):
    return clips.clip_counts(clips.clipped_reads(views.aln(spark, d), KEYS), KEYS)


@query("flt03_supported_clips", "aln", CLUSTERS_SQL + "\nSELECT sample, chrom, side, position, nreads, nbases FROM sup")
def supported_clips(spark, d):
    counts = clips.clip_counts(clips.clipped_reads(views.aln(spark, d), KEYS), KEYS)
    return counts.filter((F.col("nreads") >= C.MIN_READS_PER_CLUSTER) & (F.col("nbases") >= C.MIN_BASES_PER_CLUSTER))


@query("ag09_consensus", "aln", CLUSTERS_SQL + "\nSELECT sample, chrom, side, position, nreads, nbases, consensus FROM allclust")
def consensus(spark, d):
    return clusters(spark, d, max_mismatch=None).select(*AT, "nreads", "nbases", "consensus")


@query("ag10_mismatch_rate", "aln", CLUSTERS_SQL + "\nSELECT sample, chrom, side, position, round(mismatch, 6) AS mismatch FROM allclust")
def mismatch_rate(spark, d):
    return clusters(spark, d, max_mismatch=None).select(*AT, F.round("mismatch", 6).alias("mismatch"))


@query("flt04_clean_clusters", "aln", CLUSTERS_SQL + "\nSELECT sample, chrom, side, position, consensus FROM clusters")
def clean_clusters(spark, d):
    return clusters(spark, d).select(*AT, "consensus")


@query("aln04_long_consensus", "aln", CLUSTERS_SQL + "\nSELECT sample, chrom, side, position, length(consensus) AS length FROM clusters WHERE length(consensus) > 30")
def long_consensus(spark, d):
    return clusters(spark, d).withColumn("length", F.length("consensus").cast("long")).filter(F.col("length") > C.MIN_CONSENSUS_LENGTH).select(*AT, "length")


@query("ag12_deletion_counts", "aln", """
ops AS (SELECT chrom, pos, regexp_extract_all(cigar, '[0-9]+([MIDNSHP=X])', 1) AS op,
     list_transform(regexp_extract_all(cigar, '([0-9]+)[MIDNSHP=X]', 1), lambda x: CAST(x AS BIGINT)) AS len FROM aln WHERE contains(cigar, 'D')),
flat AS (SELECT chrom, pos, unnest(range(1, len(op) + 1)) AS i, op, len FROM ops)
SELECT chrom, pos + CAST(list_sum(list_transform(range(1, i), lambda j: CASE WHEN op[j] IN ('M', 'D') THEN len[j] ELSE 0 END)) AS BIGINT) AS position,
  CAST(len[i] AS INT) AS length, count(*) AS nreads FROM flat WHERE op[i] = 'D' GROUP BY ALL""")
def deletion_counts(spark, d):
    return clips.deletion_counts(views.aln(spark, d), ["chrom"])


@query("ag13_insertion_counts", "aln", WALK_SQL + "\nSELECT chrom, pos + r AS position, count(*) AS nreads FROM walk WHERE op = 'I' GROUP BY chrom, pos + r")
def insertion_counts(spark, d):
    return clips.insertion_counts(views.aln(spark, d), ["chrom"])


@query("ag13_inserted_sequences", "aln", WALK_SQL + """
SELECT chrom, pos + r AS position, CAST(len AS INT) AS length, substr(seq, q + 1, len) AS inserted, count(*) AS n FROM walk WHERE op = 'I' GROUP BY ALL""")
def inserted_sequences(spark, d):
    return clips.insertion_reads(views.aln(spark, d), ["chrom"]).groupBy("chrom", "position", "length", "inserted").agg(F.count("*").alias("n"))


@query("ev07_indel_calls", "aln", WALK_SQL + """
SELECT chrom, pos + r AS start, pos + r + CASE WHEN op = 'D' THEN len - 1 ELSE 0 END AS "end", CASE op WHEN 'D' THEN 'DEL' ELSE 'INS' END AS svtype, 'cigar' AS method, count(*) AS nreads
FROM walk WHERE op IN ('I', 'D') GROUP BY chrom, pos + r, len, op HAVING count(*) >= 2""")
def indel_calls(spark, d):
    return clips.indel_calls(views.aln(spark, d), ["chrom"], 2)


@query("jn08_control_removed", "aln", CLUSTERS_SQL + """
SELECT chrom, side, position, nreads FROM clusters a WHERE sample = 'case' AND NOT EXISTS (
  SELECT 1 FROM clusters b WHERE b.sample = 'control' AND b.chrom = a.chrom AND b.side = a.side AND b.position = a.position)""")
def control_removed(spark, d):
    c = clusters(spark, d)
    return clips.remove_control(c.filter("sample = 'case'"), c.filter("sample = 'control'")).select("chrom", "side", "position", "nreads")


@query("jn19_double_clips", "aln", CLUSTERS_SQL + """
SELECT chrom, position FROM clusters WHERE sample = 'case' GROUP BY chrom, position HAVING count(DISTINCT side) = 2""")
def double_clips(spark, d):
    from ..operators.calls import double_clips as doubles

    return doubles(clusters(spark, d).filter("sample = 'case'"))


def genome(spark, d):
    """Tiles read by several joins of one query: written once to the shared checkpoint folder."""
    return cut_lineage(match.reference_tiles(views.genome_tiles(spark, d), TILE, OVERLAP))


def case_clusters(spark, d):
    return cut_lineage(clusters(spark, d).filter("sample = 'case'"))


WORDS_SQL = """
g1 AS (SELECT chrom, tile, start, seq || coalesce(lead(seq) OVER w, '') || coalesce(lead(seq, 2) OVER w, '') || coalesce(lead(seq, 3) OVER w, '') AS seq FROM genome WINDOW w AS (PARTITION BY chrom ORDER BY tile)),
km AS (SELECT chrom, start + i - 1 AS loc, substr(seq, i, 64) AS ahead FROM (SELECT *, unnest(range(1, 33)) AS i FROM g1))"""


MATCHES_SQL = CLUSTERS_SQL + """,
pat AS (SELECT side || ':' || chrom || ':' || CAST(position AS VARCHAR) AS pid, consensus AS pattern FROM clusters WHERE sample = 'case' AND length(consensus) > 30),
g1 AS (SELECT chrom, tile, start, seq || coalesce(lead(seq) OVER w, '') || coalesce(lead(seq, 2) OVER w, '') || coalesce(lead(seq, 3) OVER w, '') AS seq FROM genome WINDOW w AS (PARTITION BY chrom ORDER BY tile)),
km AS (SELECT chrom, start + i - 1 AS loc, substr(seq, i, 15) AS kmer, substr(seq, i, 64) AS ahead FROM (SELECT *, unnest(range(1, 33)) AS i FROM g1)),
c1 AS (SELECT pid, pattern, chrom, loc AS ms FROM pat JOIN km ON kmer = substr(pattern, 1, 15)),
c2 AS (SELECT pid, pattern, k.chrom, k.loc - length(pattern) // 2 AS ms FROM pat JOIN km k ON k.kmer = substr(pattern, CAST(length(pattern) // 2 + 1 AS BIGINT), 15)),
c AS (SELECT pid, pattern, chrom, ms FROM c1 UNION SELECT pid, pattern, chrom, ms FROM c2),
v AS (SELECT c.pid, c.pattern, c.chrom, c.ms, substr(k.ahead, 1, length(pattern)) AS ref FROM c JOIN km k ON k.chrom = c.chrom AND k.loc = c.ms),
found AS (SELECT pid, chrom, ms AS mstart, ms + length(pattern) - 1 AS mend FROM v WHERE length(ref) = length(pattern) AND hamming(ref, pattern) <= 1)"""


@query("aln01_genome_matches", "aln genome", MATCHES_SQL + "\nSELECT pid, chrom, mstart, mend FROM found")
def genome_matches(spark, d):
    pats = case_clusters(spark, d).filter(F.length("consensus") > C.MIN_CONSENSUS_LENGTH).select(
        F.concat_ws(":", "side", "chrom", F.col("position").cast("string")).alias("pid"), F.col("consensus").alias("pattern")
    )
    return match.find_matches(pats, genome(spark, d), TILE)


@query("lim02_rare_matches", "aln genome", MATCHES_SQL + """
SELECT * FROM (SELECT pid, chrom, mstart, mend, count(*) OVER (PARTITION BY pid) AS n_match FROM found) WHERE n_match < 10""")
def rare_matches(spark, d):
    return match.keep_rare(genome_matches(spark, d), C.MAX_MATCHES)


@query("aln02_home_matches", "aln genome", CLUSTERS_SQL + "," + WORDS_SQL + """,
own AS (SELECT chrom, side, position, consensus FROM clusters WHERE sample = 'case'),
hit AS (SELECT o.chrom, side, position, loc FROM own o JOIN km ON km.chrom = o.chrom AND loc BETWEEN position - 1000 AND position + 1001 - length(consensus)
  WHERE length(ahead) >= length(consensus) AND hamming(substr(ahead, 1, length(consensus)), consensus) <= 1)
SELECT o.chrom, o.side, o.position, CAST(count(loc) AS INT) AS n_remap, CAST(min(loc) - (o.position - 1000) + 1 AS INT) AS remap_at
FROM own o LEFT JOIN hit h ON h.chrom = o.chrom AND h.side = o.side AND h.position = o.position GROUP BY o.chrom, o.side, o.position""")
def home_matches(spark, d):
    """Occurrences of each case cluster's consensus within 1000 bases of the cluster itself."""
    c = case_clusters(spark, d).select("chrom", "side", "position", "consensus")
    return match.count_in_window(c, genome(spark, d), TILE, "position", "consensus", C.HOME_WINDOW).drop("consensus")


def breakend_rows(spark, d, c=None):
    c = case_clusters(spark, d) if c is None else c
    return match.remap_clusters(c, genome(spark, d), TILE, C.MAX_MATCHES, C.MAX_CLUSTER_DISTANCE, C.MIN_CONSENSUS_LENGTH, C.HOME_WINDOW)


@query("aln03_remapped_breakends")
def remapped_breakends(spark, d):
    return breakend_rows(spark, d)


def case_patterns(spark, d):
    named = F.concat_ws(":", "side", "chrom", F.col("position").cast("string")).alias("pid")
    return cut_lineage(case_clusters(spark, d).select(named, F.col("consensus").alias("pattern")))


@query("aln07_exact_matches", "aln genome", CLUSTERS_SQL + "," + WORDS_SQL + """,
pat AS (SELECT side || ':' || chrom || ':' || CAST(position AS VARCHAR) AS pid, consensus AS pattern FROM clusters WHERE sample = 'case' AND NOT contains(consensus, 'N'))
SELECT pid, km.chrom, loc AS mstart, loc + length(pattern) - 1 AS mend FROM pat JOIN km ON substr(ahead, 1, 8) = substr(pattern, 1, 8) AND starts_with(ahead, pattern)""")
def exact_matches(spark, d):
    """Every place where a consensus, however short, stands in the genome as it is."""
    return seeds.exact_matches(case_patterns(spark, d), genome(spark, d), TILE)


@query("aln08_maximal_seeds", "aln genome", CLUSTERS_SQL + "," + WORDS_SQL + """,
pat AS (SELECT DISTINCT consensus AS pattern FROM clusters WHERE sample = 'case'),
side AS (SELECT md5(pattern) AS tid, '+' AS strand, pattern AS s FROM pat UNION ALL SELECT md5(pattern), '-', reverse(translate(pattern, 'ACGT', 'TGCA')) FROM pat),
pw AS (SELECT tid, strand, q, substr(s, q, 20) AS word FROM (SELECT *, unnest(range(1, length(s) - 18)) AS q FROM side WHERE length(s) >= 20)),
hit AS (SELECT tid, strand, chrom, loc - q AS diag, q FROM pw JOIN km ON substr(ahead, 1, 20) = word WHERE NOT contains(word, 'N')),
run AS (SELECT *, q - row_number() OVER (PARTITION BY tid, strand, chrom, diag ORDER BY q) AS g FROM hit)
SELECT tid, strand, chrom, min(q) AS qstart, diag + min(q) AS rstart, CAST(count(*) + 19 AS INT) AS length FROM run GROUP BY tid, strand, chrom, diag, g""")
def maximal_seeds(spark, d):
    return seeds.maximal_matches(case_patterns(spark, d), genome(spark, d), TILE)


@query("aln09_gapped_alignment")
def gapped_alignment(spark, d):
    """Consensus sequences placed with gaps (tested against plain dynamic programming)."""
    return seeds.align_with_gaps(case_patterns(spark, d), genome(spark, d), TILE)


@query("aln06_similar_words", "genome contigs", WORDS_SQL + """,
wd AS (SELECT km.chrom, loc, substr(ahead, 1, 36) AS w, length FROM km JOIN contigs USING (chrom) WHERE length(ahead) >= 36)
SELECT a.chrom, a.loc AS word_at, b.loc AS at, CAST(hamming(a.w, b.w) AS INT) AS differing FROM wd a JOIN wd b ON a.chrom = b.chrom AND substr(a.w, 16, 5) = substr(b.w, 16, 5)
WHERE a.loc % 36 = 1 AND a.loc <= a.length - 36 AND hamming(a.w, b.w) <= 4""")
def similar_words(spark, d):
    """36-mers of every contig and where they stand again with up to four mismatches."""
    return seeds.similar_words(genome(spark, d), views.contigs(spark, d), TILE)


@query("aln06_self_similarity", "genome", """
g1 AS (SELECT chrom, start, seq || coalesce(lead(seq) OVER (PARTITION BY chrom ORDER BY tile), '') AS seq FROM genome),
km AS (SELECT chrom, start + i - 1 AS loc, substr(seq, i, 12) AS kmer FROM (SELECT *, unnest(range(1, 33)) AS i FROM g1)),
k2 AS (SELECT * FROM km WHERE length(kmer) = 12)
SELECT chrom, kmer, count(*) AS n, min(loc) AS first_at, max(loc) AS last_at FROM k2 GROUP BY chrom, kmer HAVING count(*) > 1""")
def self_similarity(spark, d):
    """Repeated 12-mers of each chromosome: the points of a self-similarity plot, grouped by word."""
    return match.repeated_words(match.reference_tiles(views.genome_tiles(spark, d), TILE, 11), TILE, 12)


@query("scf10_base_codes_round_trip", "aln", """
t AS (SELECT rid, seq, translate(regexp_replace(upper(seq), '[^=ACMGRSVTWYHKDBN]', 'N', 'g'), '=ACMGRSVTWYHKDBN', '0123456789ABCDEF') AS codes FROM aln)
SELECT rid, CASE WHEN length(codes) % 2 = 1 THEN codes || '0' ELSE codes END AS packed, translate(codes, '0123456789ABCDEF', '=ACMGRSVTWYHKDBN') AS seq FROM t""")
def base_codes_round_trip(spark, d):
    """Four-bit codes of every read and the bases read back from them."""
    packed = views.aln(spark, d).select("rid", dna.encode_bases(F.col("seq")).alias("p"), F.length("seq").alias("n"))
    return packed.select("rid", F.hex("p").alias("packed"), dna.decode_bases(F.col("p"), F.col("n")).alias("seq"))


@query("scf10_revcomp_consensus", "aln", CLUSTERS_SQL + "\nSELECT sample, chrom, side, position, reverse(translate(consensus, 'ACGT', 'TGCA')) AS revcomp FROM clusters")
def revcomp_consensus(spark, d):
    return clusters(spark, d).select(*AT, dna.reverse_complement(F.col("consensus")).alias("revcomp"))


@query("d8_cluster_summary", "aln", CLUSTERS_SQL + """
SELECT side, chrom AS "Chrom", position AS "Position", nreads AS "nReads", nbases AS "nBases", round(mismatch, 6) AS "ProportionMismatch", length(consensus)::INT AS "ConsensusLength" FROM clusters WHERE sample = 'case'""")
def cluster_summary(spark, d):
    s = clips.summarize_clusters(clusters(spark, d).filter("sample = 'case'"))
    return s.withColumn("ProportionMismatch", F.round("ProportionMismatch", 6))
