"""Cleaning of raw flow tables.

Every rule is a projection or filter except ``dedupe`` (one shuffle) and
``impute_median`` / ``winsorise`` (two aggregate passes, see quantiles).
"""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions import numeric, text
from flowloom.operators.ordering import sorted_ordinal
from flowloom.operators.quantiles import exact_quantiles
from flowloom.operators.skew import lookup_join
from flowloom.sources import scratch

LABEL = "Label"

# Id, port and time columns; a feature's name must not contain one.
ID_TOKENS = [
    "Timestamp", "Flow_ID", "Flow_ID_",
    "Src_IP", "Source_IP", "SrcIP", "Src_Port",
    "Dst_IP", "Destination_IP", "DstIP", "Dest_IP", "Dst_Port",
]
# Id, port and time columns removed by exact name.
ID_COLUMNS = [
    "Src_IP", "Source_IP", "Dst_IP", "Destination_IP",
    "Flow_ID", "Timestamp", "Src_Port", "Dst_Port",
]
# Lower-case names of the address columns.
SOURCE_IP_NAMES = ["src_ip", "source_ip", "srcip"]
DESTINATION_IP_NAMES = ["dst_ip", "destination_ip", "dstip", "dest_ip"]


def normalise_header(df, renames=None):
    """Trim names, put ``_`` for blanks, then apply ``renames``."""
    df = df.toDF(*[c.strip().replace(" ", "_") for c in df.columns])
    present = {old: new for old, new in (renames or {}).items() if old in df.columns}
    return df.withColumnsRenamed(present)


def require_label(df, label=LABEL):
    if label not in df.columns:
        raise ValueError(f"no {label} column among {df.columns}")
    return df


def apply_null_tokens(df):
    """Missing-value texts become NULL in every string column."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: text.null_tokens(F.col(c)) for c in strings})


def dedupe(df):
    """Drop exact copies; copies are merged before the shuffle."""
    return df.dropDuplicates()


def drop_sparse_rows(df, max_missing=0.3):
    """Keep rows whose share of NULL columns is at most ``max_missing``."""
    missing = sum([F.col(c).isNull().cast("int") for c in df.columns], F.lit(0))
    return df.filter(missing <= F.lit(max_missing * len(df.columns)))


def label_column(df, rule="contains", label=LABEL):
    """Numeric labels pass as int, text labels go through ``rule``."""
    kind = df.schema[label].dataType
    if isinstance(kind, T.NumericType):
        return df.withColumn(label, F.col(label).cast("int"))
    return df.withColumn(label, text.binary_label(F.col(label), rule))


def is_id(name):
    return any(token in name for token in ID_TOKENS)


def feature_columns(df, label=LABEL):
    """Names of the feature columns in order; an error if there are none."""
    names = [c for c in df.columns if label not in c and not is_id(c)]
    if not names:
        raise ValueError("no feature columns")
    return names


def numeric_features(df, label=LABEL, drop_empty=True):
    """Names of the feature columns of a numeric type, in order; an error if there are none.

    Text, times and nested columns are no features, whatever they are called. With
    ``drop_empty`` a column without any value is none either, for which the rows are read
    once.
    """
    names = [c for c in feature_columns(df, label) if isinstance(df.schema[c].dataType, T.NumericType)]
    if drop_empty and names:
        filled = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(names)]).first()
        names = [c for i, c in enumerate(names) if filled[f"n{i}"]]
    if not names:
        raise ValueError("no numeric feature columns")
    return names


def ip_columns(df):
    """(source, destination) address columns, None where absent."""
    found = {c.lower(): c for c in df.columns}
    source = next((found[n] for n in SOURCE_IP_NAMES if n in found), None)
    target = next((found[n] for n in DESTINATION_IP_NAMES if n in found), None)
    return source, target


def coerce_numeric(df, columns=None):
    """Feature columns as double, unreadable text as NULL."""
    columns = columns or feature_columns(df)
    return df.withColumns({c: text.to_number(c) for c in columns})


def inf_to_null(df, columns):
    return df.withColumns({c: numeric.finite(F.col(c)) for c in columns})


def fill_zero(df, columns):
    return df.fillna(0.0, subset=list(columns))


def impute_median(df, columns, sketches=None):
    """NULL becomes the column's median; an all-NULL column stays NULL.

    The median is exact, or within the rank error of ``sketches`` (``FileSketches`` of
    the files ``df`` comes from), for which ``df`` is not read.
    """
    middle = sketches.quantiles([0.5]) if sketches else exact_quantiles(df, columns, [0.5])
    return df.withColumns(
        {c: F.coalesce(F.col(c), F.lit(middle[c][0])) for c in columns if middle.get(c)}
    )


def drop_ids(df, keep=()):
    """Remove id, port and time columns by exact name."""
    return df.drop(*[c for c in ID_COLUMNS if c in df.columns and c not in keep])


def drop_id_like(df, keep=()):
    """Remove columns whose name contains an id token."""
    return df.drop(*[c for c in df.columns if is_id(c) and c not in keep])


def drop_header_rows(df, label=LABEL):
    """Remove rows that repeat the header in the label column."""
    return df.filter(~F.trim(F.coalesce(F.col(label), F.lit(""))).eqNullSafe(label))


def check_width(df, n, features="features"):
    """(rows with n features, rejected rows)."""
    right = F.coalesce(F.size(features) == n, F.lit(False))
    return df.filter(right), df.filter(~right)


def encode_categories(df, columns, fit_on=None):
    """Text to its position in sorted order; NULL counts as the text ``nan``.

    Codes come from ``fit_on`` (the training rows); a text unseen there is -1.
    """
    for c in columns:
        value = F.coalesce(F.col(c).cast("string"), F.lit("nan"))
        words = (fit_on if fit_on is not None else df).select(value.alias("_v")).distinct()
        codes = sorted_ordinal(words, ["_v"], (), "_code")
        df = (
            lookup_join(df.withColumn("_v", value), codes, "_v", "left")
            .withColumn(c, F.coalesce("_code", F.lit(-1)))
            .drop("_v", "_code")
        )
    return df


def assemble(df, columns, name="features"):
    """Feature columns as one array of doubles."""
    return df.withColumn(name, F.array(*[F.col(c).cast("double") for c in columns]))


def drop_invalid(df, column):
    """Keep rows whose ``column`` is not negative."""
    return df.filter(F.col(column) >= 0)


def parse_time(df, column, pattern="dd/MM/yyyy HH:mm:ss"):
    return df.withColumn(column, F.try_to_timestamp(F.col(column), F.lit(pattern)))


def winsorise(df, columns, low=0.01, high=0.99):
    """Pull values outside the two exact percentiles onto them."""
    marks = exact_quantiles(df, columns, [low, high])
    return df.withColumns(
        {
            c: F.when(
                F.col(c).isNotNull(),
                F.least(F.greatest(F.col(c), F.lit(marks[c][0])), F.lit(marks[c][1])),
            )
            for c in columns
            if marks[c]
        }
    )


def log_skewed(df, columns, threshold=1.0):
    """Signed log of the columns whose skewness exceeds ``threshold``."""
    skew = df.agg(*[F.skewness(c).alias(c) for c in columns]).first()
    chosen = [c for c in columns if skew[c] is not None and abs(skew[c]) > threshold]
    return df.withColumns({c: numeric.signed_log(F.col(c)) for c in chosen})


def drop_low_variance(df, columns, threshold=0.01):
    """Keep feature columns whose population variance exceeds ``threshold``."""
    spread = df.agg(*[F.var_pop(c).alias(c) for c in columns]).first()
    return df.drop(*[c for c in columns if spread[c] is None or spread[c] <= threshold])


def concat(frames):
    """Stack frames by column name, absent columns as NULL."""
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def clean_flows(df, label_rule="iequals", fill="median", max_missing=0.3, keep_ip=False):
    """The whole cleaning chain from raw text columns to typed flows.

    ``fill="zero"`` keeps sparse rows and puts 0 for what is missing;
    ``fill="median"`` drops them first and puts the column's median, for which
    the rows are read three times; ``fill=None`` drops them and leaves NULL, as a
    plan without passes of its own.
    """
    df = apply_null_tokens(require_label(normalise_header(df)))
    df = dedupe(df)
    if fill != "zero":
        df = drop_sparse_rows(df, max_missing)
    features = feature_columns(df)
    df = label_column(inf_to_null(coerce_numeric(df), features), label_rule)
    kept = ip_columns(df) if keep_ip else ()
    if fill == "median":
        # Three passes read this, so the shuffle of dedupe is paid for once.
        df = scratch.materialise(df, "clean")
        return drop_ids(impute_median(df, features), kept)
    if fill is None:
        return drop_ids(df, kept)
    return drop_id_like(fill_zero(df, features), kept)
