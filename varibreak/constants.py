"""Fixed values that results depend on."""

# Alignment flag bits, lowest first (SAM specification order).
FLAG_NAMES = (
    "isPaired", "isProperPair", "isQueryUnmapped", "isMateUnmapped", "QStrand", "MStrand",
    "FirstRead", "SecondRead", "NotPrimary", "QCFailure", "Duplicate",
)
UNMAPPED, MATE_UNMAPPED, REVERSE, QC_FAIL, DUPLICATE = 4, 8, 16, 512, 1024

# Letter of each four-bit base code of a BAM file.
NIBBLE_LETTERS = "=ACMGRSVTWYHKDBN"

# Soft-clip clusters.
MIN_READS_PER_CLUSTER = 3
MIN_BASES_PER_CLUSTER = 30
MAX_CLUSTER_MISMATCH = 0.05
MIN_COLUMN_OBSERVATIONS = 2
BASES = ("A", "C", "G", "T", "N")

# Remapping a cluster consensus to the genome.
MIN_CONSENSUS_LENGTH = 30
MAX_MATCHES = 10
MAX_CLUSTER_DISTANCE = 100
HOME_WINDOW = 1000

# Breakend filters and event calls.
MIN_BREAKEND_SEPARATION = 25
HOTSPOT_DISTANCE = 10_000
HOTSPOT_SIZE = 3
GAP_DISTANCE = 100_000
MIN_FOLD_LENGTH = 10_000
MAX_FOLD_LENGTH = 20_000_000
DEL_FOLD = 0.8
DUP_FOLD = 1.2
MIN_FOLD_READS = 30
BRACKET_MIN = 10_000
EVENT_HALF_MAX = 50_000

# Binned coverage.
COVERAGE_BIN = 10_000
MAX_DEL_RATIO = 0.9
MIN_DUP_RATIO = 1.1

# Scores are summed as integers of this resolution, so a window's score does
# not depend on the order in which its terms arrive (retries give equal output).
SCORE_SCALE = 100_000_000

# Priority of evidence when overlapping calls are merged, best first.
METHOD_PRIORITY = ("sclip", "cigar", "seqcbs", "bigd", "disc", "lcd", "ldx", "hax", "cvg")

VCF_INFO = (
    ("BKPTID", ".", "String", "ID of the assembled alternate allele in the assembly file"),
    ("CIEND", "2", "Integer", "Confidence interval around END for imprecise variants"),
    ("CIPOS", "2", "Integer", "Confidence interval around POS for imprecise variants"),
    ("END", "1", "Integer", "End position of the variant described in this record"),
    ("HOMLEN", ".", "Integer", "Length of base pair identical micro-homology at event breakpoints"),
    ("HOMSEQ", ".", "String", "Sequence of base pair identical micro-homology at event breakpoints"),
    ("IMPRECISE", "0", "Flag", "Imprecise structural variation"),
    ("MEINFO", "4", "String", "Mobile element info of the form NAME,START,END,POLARITY"),
    ("SVLEN", ".", "Integer", "Difference in length between REF and ALT alleles"),
    ("SVTYPE", "1", "String", "Type of structural variant"),
)
# Keys that this package's own records use beside those.
VCF_OWN_INFO = (
    ("AF", "1", "Float", "Allele fraction by genotype"),
    ("BNDNUM", ".", "Integer", "Numbers of the breakends behind the event"),
    ("DP", "1", "Integer", "Read depth over the breakpoints"),
    ("FOLDCHANGE", "1", "Float", "Coverage inside over outside, or case over control; NA when not computed"),
    ("MATECHR", "1", "String", "Sequence of the other end"),
    ("MATEID", "1", "String", "ID of the mate breakend"),
    ("MATEPOS", "1", "Integer", "Position of the other end"),
    ("NSCLIP", "1", "Integer", "Soft-clipped reads of the clusters behind the event"),
    ("PARTNERID", "1", "String", "ID of the event's second row"),
    ("PURITY", "1", "Float", "Estimated fraction of cells with the variant"),
    ("SOMATIC", "0", "Flag", "Variant of the case that the control lacks"),
)
VCF_FORMAT = (
    ("GT", "1", "String", "Genotype"),
    ("GQ", "1", "Float", "Genotype quality"),
    ("DP", "1", "Integer", "Read depth"),
)
VCF_ALT = (
    ("DEL", "Deletion"),
    ("DEL:ME:ALU", "Deletion of ALU element"),
    ("DEL:ME:L1", "Deletion of L1 element"),
    ("DUP", "Duplication"),
    ("DUP:TANDEM", "Tandem Duplication"),
    ("INS", "Insertion of novel sequence"),
    ("INS:ME:ALU", "Insertion of ALU element"),
    ("INS:ME:L1", "Insertion of L1 element"),
    ("INV", "Inversion"),
    ("CNV", "Copy number variable region"),
    ("TRPINV", "Transposition or Inversion"),
)
