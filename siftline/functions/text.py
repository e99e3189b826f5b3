"""Column functions over read names and quality strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_qname(qname: Column) -> Column:
    """First whitespace-delimited token without one trailing ``/1`` or ``/2``."""
    token = F.regexp_extract(qname, r"([^ \t\n\f\r]+)", 1)
    token = F.when(token == "", qname).otherwise(token)
    return F.regexp_replace(token, r"/[12]$", "")


def phred_valid(qual: Column) -> Column:
    """True when no quality symbol lies below the Phred+33 range."""
    return ~qual.rlike(r"[\x00-\x20]")


def decode_phred(qual: Column) -> Column:
    """Phred+33 text as an array of scores; null when any symbol is out of range."""
    scores = F.transform(
        F.sequence(F.lit(1), F.length(qual)),
        lambda i: F.ascii(F.substring(qual, i, F.lit(1))) - 33,
    )
    empty = F.array().cast("array<int>")
    return F.when(F.length(qual) == 0, empty).when(phred_valid(qual), scores)


def sanitize_component(value: Column) -> Column:
    """A name safe to use as a file component."""
    clean = F.regexp_replace(value, r"[^A-Za-z0-9._-]", "_")
    return F.when(clean == "", "candidate").otherwise(clean)


# Input suffixes removed, one of each list, when a sample is named after its file.
FILE_SUFFIXES = (r"\.fastq\.gz", r"\.fq\.gz", r"\.fastq", r"\.fq", r"\.ubam", r"\.bam", r"\.cram")
MATE_SUFFIXES = ("_R1", "_R2", "_1", "_2", r"\.R1", r"\.R2")


def sample_name(path: Column) -> Column:
    """Sample id implied by a file path."""
    name = F.element_at(F.split(path, "/"), -1)
    name = F.regexp_replace(name, "(" + "|".join(FILE_SUFFIXES) + ")$", "")
    name = F.regexp_replace(name, "(" + "|".join(MATE_SUFFIXES) + ")$", "")
    return F.when(name == "", "sample").otherwise(name)
