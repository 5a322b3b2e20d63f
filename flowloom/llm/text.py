"""Word rules and row handling that the operators of this package share."""

from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WHITE = " \t\n\x0b\f\r"
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Lower-cases A-Z and turns ASCII other than letters and digits into blanks.
TERM_BYTES = bytes(
    b if chr(b) in "0123456789" + LOWER or b >= 128 else b + 32 if chr(b) in UPPER else 32
    for b in range(256)
)
LAST_ID = 2**63 - 1


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(column):
    return F.translate(column, UPPER, LOWER)


def id_or_last(column):
    """A long id; a missing one counts as the largest."""
    return F.coalesce(column.cast("long"), F.lit(LAST_ID))


def id_or_null(column):
    return F.when(column != LAST_ID, column)


def narrow(docs, *columns):
    """Only the named columns, so that others cannot clash with working names."""
    return docs.select(*columns)


def words(data):
    """Words of UTF-8 bytes between ASCII white space, A-Z lower-cased."""
    return data.translate(LOWER_BYTES).split()


def terms(data):
    """Runs of letters, digits and non-ASCII in UTF-8 bytes, A-Z lower-cased."""
    return data.translate(TERM_BYTES).split()
