"""Scans of raw and cleaned flow files."""

import csv
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.operators.ordering import first_per
from flowloom.operators.sampling import exact_n
from flowloom.sources import scratch

CORRUPT = "_corrupt"


def spread(df):
    """Even rows over all cores when a scan yields fewer splits than cores.

    Only a small input has so few; a large scan is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def list_files(spark, folder, suffix=".csv", first=None):
    """Sorted file paths of a folder, optionally only the first few."""
    system, target = scratch.filesystem(spark, folder)
    paths = sorted(
        s.getPath().toString() for s in system.listStatus(target) if s.isFile()
    )
    return [p for p in paths if p.endswith(suffix)][:first]


def existing(spark, paths):
    """(present, absent) of the named files; an error when none is present."""
    present, absent = [], []
    for p in paths:
        system, target = scratch.filesystem(spark, p)
        (present if system.exists(target) else absent).append(p)
    if not present:
        raise FileNotFoundError(f"none of these files exists: {list(paths)}")
    return present, absent


def _commas(text):
    """Commas outside quotes, i.e. how many fields a CSV line has, less one."""
    bare = F.regexp_replace(text, '"[^"]*"', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(","), F.lit("")))


def _lines(spark, paths, columns, header):
    """Rows of files with one header, as text, with ``_long`` on lines of too many fields."""
    schema = T.StructType(
        [T.StructField(c, T.StringType()) for c in columns]
        + [T.StructField(CORRUPT, T.StringType())]
    )
    rows = (
        spark.read.schema(schema)
        .option("header", header)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .option("columnPruning", False)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .csv(paths)
        .withColumn("source_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    )
    # A scan of the corrupt column alone is refused, so a real column takes part.
    present = F.length(F.coalesce(F.col(f"`{columns[0]}`"), F.lit(""))) >= 0
    too_long = F.coalesce(_commas(F.col(CORRUPT)) >= len(columns), F.lit(False)) & present
    return rows.withColumn("_long", too_long).drop(CORRUPT)


def normalised(names):
    """Header names without outer blanks, ``_`` for inner ones; repeats get a number."""
    seen, out = {}, []
    for name in names:
        name = name.strip().replace(" ", "_")
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name] - 1}")
    return out


def headers(spark, paths, threads=32):
    """{path: column names} from the first line of each file; [] for an empty file.

    Only that line is read, by the file system client, so no job runs per file.
    """
    with ThreadPoolExecutor(threads) as pool:
        lines = list(pool.map(lambda p: _first_line(spark, p), paths))
    return {p: _fields(x) for p, x in zip(paths, lines)}


def _fields(line):
    return next(csv.reader([line.lstrip("\ufeff")])) if line else []


def _first_line(spark, path):
    system, target = scratch.filesystem(spark, path)
    jvm = spark.sparkContext._jvm
    codec = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(system.getConf()).getCodec(target)
    stream = system.open(target)
    try:
        text = codec.createInputStream(stream) if codec else stream
        return jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(text, "UTF-8")).readLine()
    finally:
        stream.close()


def _scans(spark, paths, columns, header):
    """One scan for each distinct header among the files."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if columns is not None:
        return [_lines(spark, paths, list(columns), header)]
    groups = {}
    for path, names in headers(spark, paths).items():
        if names:
            groups.setdefault(tuple(normalised(names)), []).append(path)
    if not groups:
        raise ValueError("no file has a header")
    return [_lines(spark, own, list(names), True) for names, own in groups.items()]


def scan_raw(spark, paths, columns=None, header=True):
    """All columns as text plus ``source_file``.

    Every file is read by its own header: files whose normalised headers are
    equal are one scan, and the scans are stacked by column name, absent columns
    as NULL. With ``columns`` all files have these. A line with more fields than
    its header is skipped (``skipped_lines`` counts them), a shorter one is
    filled with NULL; an empty file has no rows.
    """
    frames = [rows.filter(~F.col("_long")).drop("_long") for rows in _scans(spark, paths, columns, header)]
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame, allowMissingColumns=True)
    return first


def skipped_lines(spark, paths, columns=None, header=True):
    """(source_file, read, skipped) per file that has lines."""
    counts = [
        rows.groupBy("source_file").agg(
            F.count_if(~F.col("_long")).alias("read"), F.count_if(F.col("_long")).alias("skipped")
        )
        for rows in _scans(spark, paths, columns, header)
    ]
    first, *rest = counts
    for frame in rest:
        first = first.unionByName(frame)
    return first


def scan_named(spark, paths, key=None, per_file=None, seed=42):
    """(rows, absent paths) of a list of named files.

    Missing files are reported, not read; an error when none is present. With
    ``per_file`` that many random rows of every larger file are kept, told apart
    by ``key``.
    """
    present, absent = existing(spark, paths)
    rows = scan_raw(spark, present)
    return (sample_per_file(rows, key, per_file, seed=seed) if per_file else rows), absent


def header(spark, path):
    """Column names of a CSV file."""
    return headers(spark, [path])[path]


def cap_per_file(df, n, order_by, file="source_file"):
    """The first n rows of every file, exactly; only rows near the cut are put in order."""
    return first_per(df, n, order_by, (file,))


def sample_per_file(df, key, n, file="source_file", seed=42):
    """n random rows of every file that has more, all rows of the others."""
    return exact_n(df, key, n, (file,), seed)


def early_stop_sample(df, key, n, order_by, file="source_file", slack=1.2, seed=42):
    """n random rows out of the first n * slack of every file."""
    head = scratch.materialise(cap_per_file(df, int(n * slack), order_by, file), "head")
    return sample_per_file(head, key, n, file, seed)


def row_counts(df, file="source_file"):
    """(file, n) with the total in the row named TOTAL."""
    return (
        df.rollup(file)
        .agg(F.count(F.lit(1)).alias("n"), F.grouping(file).alias("_g"))
        .withColumn(file, F.when(F.col("_g") == 1, "TOTAL").otherwise(F.col(file)))
        .drop("_g")
    )


#: Kinds of CSV values as bits, so that the kind of a column is one ``bit_or`` over all files.
WHOLE, LONG, REAL, TRUTH, DAY, TIME, TEXT = (1 << i for i in range(7))
DIGITS = r"^[+-]?\d+$"
DATE = r"^\d{4}-\d{1,2}-\d{1,2}$"
MOMENT = r"^\d{4}-\d{1,2}-\d{1,2}[T ]\d{1,2}:\d{2}"


def _kind(value):
    """The bit of a text value; NULL and empty text are of no kind."""
    whole = value.rlike(DIGITS)
    return (
        F.when(value.isNull() | (value == ""), 0)
        .when(whole & value.try_cast("int").isNotNull(), WHOLE)
        .when(whole & value.try_cast("bigint").isNotNull(), LONG)
        .when(value.try_cast("double").isNotNull(), REAL)
        .when(F.lower(value).isin("true", "false"), TRUTH)
        .when(value.rlike(DATE) & value.try_cast("date").isNotNull(), DAY)
        .when(value.rlike(MOMENT) & value.try_cast("timestamp").isNotNull(), TIME)
        .otherwise(TEXT)
    )


def _type_of(bits):
    """The smallest type that holds every kind in ``bits``."""
    for kinds, name in (
        (WHOLE, "int"), (WHOLE | LONG, "bigint"), (WHOLE | LONG | REAL, "double"),
        (TRUTH, "boolean"), (DAY, "date"), (DAY | TIME, "timestamp"),
    ):
        if bits and not bits & ~kinds:
            return name
    return "string"


def typed(rows, columns):
    """``rows`` with its text columns cast to the types that all their values have.

    One job reads all rows, whatever the number of files they come from; each task
    returns one row of bits. Whole numbers are int or bigint, with others double; dates
    with times are timestamps; any other mix, and a column without a value, is text.
    """
    bits = rows.agg(*[F.bit_or(_kind(F.col(f"`{c}`"))).alias(f"k{i}") for i, c in enumerate(columns)]).first()
    kinds = {c: _type_of(bits[f"k{i}"] or 0) for i, c in enumerate(columns)}
    return rows.withColumns({c: F.col(f"`{c}`").try_cast(k) for c, k in kinds.items() if k != "string"})


def _numbered(names):
    """Names as they are; those that come more than once get their position."""
    return tuple(f"{n}{i}" if names.count(n) > 1 else n for i, n in enumerate(names))


def _csv_files(spark, path):
    """(header, files) of a CSV file or of a folder of such files."""
    system, target = scratch.filesystem(spark, path)
    files = [path]
    if system.getFileStatus(target).isDirectory():
        inside = [s.getPath() for s in system.listStatus(target) if s.isFile() and s.getLen()]
        files = sorted(p.toString() for p in inside if p.getName()[0] not in "_.")
    lines = [_first_line(spark, p) for p in files]
    return [(_numbered(_fields(line)), p) for line, p in zip(lines, files) if line]


def _csv_frame(spark, groups):
    """Files of all headers as one typed frame: one scan per header, one job for all types."""
    frames = [_lines(spark, paths, list(names), True).drop("_long", "source_file") for names, paths in groups.items()]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return typed(rows, rows.columns)


def _aligned(frames):
    """The frames with one type per column: double for different numbers, else text."""
    kinds = {}
    for frame in frames:
        for field in frame.schema.fields:
            kinds.setdefault(field.name, set()).add(field.dataType)
    common = {
        c: T.DoubleType() if all(isinstance(k, T.NumericType) for k in found) else T.StringType()
        for c, found in kinds.items()
        if len(found) > 1
    }
    return [f.withColumns({c: F.col(f"`{c}`").cast(k) for c, k in common.items() if c in f.columns}) for f in frames]


def load_cleaned(spark, paths, label="Label", threads=32):
    """(rows, skipped): cleaned files, or folders of such, stacked by column name.

    ``skipped`` lists (path, reason) of the files that cannot be opened or have
    no label; no usable file at all is an error. Only the first lines and footers are
    looked at file by file, by ``threads`` at a time: CSV files with equal headers are one
    scan, Parquet files with equal schemas too, and one job finds the types of all CSV
    columns (``typed``). A column that is a number here and text there is text; whole
    numbers of one CSV column that need it are bigint, other different kinds doubles.
    """
    from py4j.protocol import Py4JJavaError
    from pyspark.errors import PySparkException

    from flowloom.operators.clean import concat

    def look(path):
        try:
            if path.endswith(".parquet"):
                return [(spark.read.parquet(path).schema, path)]
            return _csv_files(spark, path)
        except PySparkException as error:
            return error.getCondition() or str(error).splitlines()[0]
        except Py4JJavaError as error:
            missing = "FileNotFound" in error.java_exception.getClass().getName()
            return "PATH_NOT_FOUND" if missing else str(error.java_exception.getMessage())

    with ThreadPoolExecutor(threads) as pool:
        seen = list(pool.map(look, paths))
    groups, tables, order, skipped = {}, {}, [], []
    for path, found in zip(paths, seen):
        if isinstance(found, str):
            skipped.append((path, found))
            continue
        parquet = path.endswith(".parquet")
        usable = [(head, p) for head, p in found if label in (head.names if parquet else head)]
        if not usable:
            skipped.append((path, f"no {label} column"))
        for head, file in usable:
            if parquet:
                tables.setdefault(head.json(), (head, []))[1].append(file)
            else:
                groups.setdefault(head, []).append(file)
            kind = head.json() if parquet else "csv"
            if kind not in order:
                order.append(kind)
    frames = []
    for kind in order:
        if kind == "csv":
            frames.append(_csv_frame(spark, groups))
        else:
            schema, files = tables[kind]
            frames.append(spark.read.schema(schema).parquet(*files))
    if not frames:
        raise ValueError(f"no file with a {label} column: {skipped}")
    return concat(_aligned(frames)), skipped
