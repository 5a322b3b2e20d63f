"""Flow-shaped views of the given tables, each as a DataFrame and as SQL.

All of them cover their whole table. The dirt of ``raw_flows`` (infinities,
blanks, junk text, missing cells, repeated rows) is put in by rules on the
order key, so both engines see the same rows.
"""

from pyspark.sql import functions as F

from flowloom.functions.hashing import uniform
from flowloom.sources import scan

SEED = 42
FEATURES = ["qty", "price", "disc", "tax"]
RAW_FEATURES = ["Tot_Qty", "Price", "Disc", "Tax"]
WIDTH = 64


def table(spark, sf_dir, name):
    return scan.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _flow_key():
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    return F.concat_ws(
        "-",
        *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")],
        cents.cast("string"),
    )


FLOW_KEY = """concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CAST(round(l_extendedprice * 100) AS BIGINT))"""


def raw_flows(spark, sf_dir):
    """All-text rows under untidy column names."""
    t = table(spark, sf_dir, "lineitem")
    key = F.col("l_orderkey")
    none = F.lit(None).cast("string")

    def text(column):
        return F.col(column).cast("decimal(18,2)").cast("string")

    def cell(column, every=None, junk=None):
        rule = F.when(key % 31 == 0, none)
        if every:
            rule = rule.when(key % every == 0, junk)
        return rule.otherwise(text(column))

    label = (
        F.when(key % 29 == 0, "BENIGN")
        .when(F.col("l_returnflag") == "N", " Benign ")
        .when(F.col("l_returnflag") == "A", "DoS-Hulk")
        .otherwise("Bot")
    )
    copies = F.when(key % 37 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return t.withColumn("_copy", F.explode(copies)).select(
        _flow_key().alias(" Flow ID"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("Src IP"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("Dst IP"),
        F.date_format("l_shipdate", "dd/MM/yyyy HH:mm:ss").alias("Timestamp"),
        cell("l_quantity", 17, "Infinity").alias(" Tot Qty"),
        cell("l_extendedprice", 19, "").alias("Price "),
        cell("l_discount", 23, "abc").alias("Disc"),
        cell("l_tax", 41, "NaN").alias("Tax"),
        label.alias(" Label "),
    )


def _sql_cell(column, every, junk):
    return f"""CASE WHEN l_orderkey % 31 = 0 THEN NULL WHEN l_orderkey % {every} = 0 THEN '{junk}'
      ELSE CAST(CAST({column} + 0.0 AS DECIMAL(18,2)) AS VARCHAR) END"""


RAW_SQL = f"""raw AS (
  SELECT {FLOW_KEY} AS "Flow_ID", 's' || l_suppkey AS "Src_IP", 'p' || l_partkey AS "Dst_IP",
    strftime(l_shipdate, '%d/%m/%Y %H:%M:%S') AS "Timestamp",
    {_sql_cell('l_quantity', 17, 'Infinity')} AS "Tot_Qty",
    {_sql_cell('l_extendedprice', 19, '')} AS "Price",
    {_sql_cell('l_discount', 23, 'abc')} AS "Disc",
    {_sql_cell('l_tax', 41, 'NaN')} AS "Tax",
    CASE WHEN l_orderkey % 29 = 0 THEN 'BENIGN' WHEN l_returnflag = 'N' THEN ' Benign '
      WHEN l_returnflag = 'A' THEN 'DoS-Hulk' ELSE 'Bot' END AS "Label"
  FROM (SELECT * FROM lineitem UNION ALL SELECT * FROM lineitem WHERE l_orderkey % 37 = 0))"""

_TOKENS = """('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
  '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null')"""
RAW_COLUMNS = ["Flow_ID", "Src_IP", "Dst_IP", "Timestamp", *RAW_FEATURES, "Label"]
TOKENS_SQL = "tok AS (SELECT " + ", ".join(
    f'CASE WHEN trim("{c}") NOT IN {_TOKENS} THEN trim("{c}") END AS "{c}"' for c in RAW_COLUMNS
) + " FROM raw)"
DISTINCT_SQL = "dd AS (SELECT DISTINCT * FROM tok)"
KEPT_SQL = "kept AS (SELECT * FROM dd WHERE " + " + ".join(
    f'("{c}" IS NULL)::INT' for c in RAW_COLUMNS
) + " <= 0.3 * 9)"


def numbers_sql(source):
    """Features read as finite doubles from the CTE ``source``."""
    cells = ", ".join(
        f'CASE WHEN isfinite(TRY_CAST("{c}" AS DOUBLE)) THEN TRY_CAST("{c}" AS DOUBLE) END AS "{c}"'
        for c in RAW_FEATURES
    )
    return f'num AS (SELECT "Flow_ID", "Src_IP", "Dst_IP", "Timestamp", {cells}, "Label" FROM {source})'


def with_sql(*parts):
    """WITH all parts but the last, which is the query."""
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


def flows(spark, sf_dir):
    """Typed flows: key, addresses, time, four features, binary label."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        _flow_key().alias("flow_key"),
        F.concat(F.lit("s"), F.col("l_suppkey")).alias("src_ip"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("dst_ip"),
        F.col("l_shipdate").alias("ts"),
        F.col("l_quantity").alias("qty"),
        F.col("l_extendedprice").alias("price"),
        (F.col("l_discount") + 0.0).alias("disc"),
        (F.col("l_tax") + 0.0).alias("tax"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
        F.col("l_returnflag").alias("flag"),
        F.col("l_linestatus").alias("status"),
        F.concat(F.lit("day_"), F.year("l_shipdate"), F.lit(".csv")).alias("source_file"),
    )


FLOWS_SQL = f"""flows AS (
  SELECT {FLOW_KEY} AS flow_key, 's' || l_suppkey AS src_ip, 'p' || l_partkey AS dst_ip,
    l_shipdate AS ts, l_quantity AS qty, l_extendedprice AS price, l_discount + 0.0 AS disc,
    l_tax + 0.0 AS tax, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
    l_returnflag AS flag, l_linestatus AS status,
    'day_' || year(l_shipdate) || '.csv' AS source_file
  FROM lineitem)"""


def hash_sql(key, seed=SEED):
    return f"md5(concat_ws('|', {key}, '{seed}'))"


def uniform_sql(key, seed=SEED):
    return f"(('0x' || substr({hash_sql(key, seed)}, 1, 8))::BIGINT / 4294967296.0)"


def scored(spark, sf_dir):
    """Every flow with a made-up attack probability that leans to its label."""
    prob = F.round(uniform("flow_key", SEED) * 0.7 + F.col("label") * 0.3, 4)
    return flows(spark, sf_dir).select(
        "flow_key", F.col("label").alias("y_true"), prob.alias("prob"),
        F.when(prob > 0.5, 1).otherwise(0).alias("y_pred"),
    )


SCORED_SQL = f"""{FLOWS_SQL}, scored0 AS (
  SELECT flow_key, label AS y_true, round({uniform_sql('flow_key')} * 0.7 + label * 0.3, 4) AS prob
  FROM flows), scored AS (
  SELECT flow_key, y_true, prob, CASE WHEN prob > 0.5 THEN 1 ELSE 0 END AS y_pred FROM scored0)"""

COUNTS_SQL = """cells AS (
  SELECT count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
    count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp,
    count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
    count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM scored)"""


def vectors(spark, sf_dir):
    """Embeddings as labelled feature vectors."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("row_id"),
        F.col("embedding").cast("array<double>").alias("features"),
        (F.col("label") < 3).cast("int").alias("label"),
    )


VECTORS_SQL = """vectors AS (
  SELECT vec_id AS row_id, embedding::DOUBLE[] AS features, (label < 3)::INT AS label
  FROM embeddings)"""


def wide_vectors(spark, sf_dir):
    """The same with one column per feature: f0, f1, ..."""
    v = vectors(spark, sf_dir)
    return v.select("row_id", "label", *[F.col("features")[i].alias(f"f{i}") for i in range(WIDTH)])


WIDE = [f"f{i}" for i in range(WIDTH)]

# Rows that a classifier can tell apart: attacks lie apart along the diagonal. Labels are all right: what a
# graph smooths over its neighbours hardly varies inside a class, and a wrong label there is fitted at any price.
SHIFT = 0.1


def signal(spark, sf_dir):
    """Vectors with a planted class, in one column per feature."""
    v = vectors(spark, sf_dir)
    side = F.col("label") * 2 - 1
    return v.select("row_id", "label", *[(F.col("features")[i] + side * SHIFT).alias(f"f{i}") for i in range(WIDTH)])


SIGNAL_SQL = "signal AS (SELECT vec_id AS row_id, (label < 3)::INT AS label FROM embeddings)"


def long_form(df, key, columns):
    """(key, pos, value) rows of feature columns, rounded."""
    values = F.array(*[F.round(c, 6) + 0.0 for c in columns])
    return df.select(key, F.posexplode(values).alias("pos", "value"))


def events(spark, sf_dir):
    """Stream flows: key, sequence, two features and a label."""
    kind = F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("flow_id"),
        F.col("user_id").alias("stream_key"),
        F.col("ts"),
        F.col("value").alias("x0"),
        kind.alias("x1"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("label"),
    )


EVENTS_SQL = """ev AS (
  SELECT event_id AS flow_id, user_id AS stream_key, ts, value AS x0,
    CAST(json_extract_string(props, '$.k') AS DOUBLE) AS x1,
    CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label
  FROM events)"""
