"""Text rules of raw flow records."""

from pyspark.sql import functions as F

# Texts that the public pandas CSV reader takes as missing by default.
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]


def null_tokens(col):
    """Trimmed text, with the missing-value tokens as NULL."""
    text = F.trim(col)
    return F.when(~text.isin(NULL_TOKENS), text)


def to_number(col):
    """Text as double; anything unreadable becomes NULL."""
    if isinstance(col, str):
        col = F.col(col)
    return F.trim(col).try_cast("double")


def binary_label(col, rule="contains"):
    """0 for benign, 1 for everything else; a missing label counts as attack.

    ``rule``: ``contains`` finds "benign" anywhere in any case, ``iequals``
    compares without case, ``equals`` compares with the exact text "Benign".
    """
    text = F.trim(F.coalesce(col.cast("string"), F.lit("nan")))
    benign = {
        "contains": F.contains(F.lower(text), F.lit("benign")),
        "iequals": F.lower(text) == "benign",
        "equals": text == "Benign",
    }[rule]
    return F.when(benign, 0).otherwise(1)


def multiclass_label(col):
    """Six attack families by number; NULL for a label of no family."""
    text = F.lower(F.trim(col))
    brute = F.lit(False)
    # Words that mark the brute-force family.
    for word in ["brute", "ftp", "ssh", "web", "xss", "sql injection"]:
        brute = brute | F.contains(text, F.lit(word))
    # Benign 0, Bot 1, DDoS 2, DoS-* 3, Brute Force 4, Infiltration 5.
    return (
        F.when(text == "benign", 0)
        .when(text == "bot", 1)
        .when(F.startswith(text, F.lit("ddos")), 2)
        .when(F.startswith(text, F.lit("dos")), 3)
        .when(brute, 4)
        .when(F.startswith(text, F.lit("infilt")), 5)
    )


def display_label(col):
    return F.when(col == 0, "Benign").otherwise("Attack")
