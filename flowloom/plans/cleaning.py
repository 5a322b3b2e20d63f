"""Queries: scans, cleaning rules, scaling."""

from pyspark.sql import functions as F

from flowloom.functions import numeric, text
from flowloom.operators import clean, metrics, quantiles, scaling
from flowloom.operators.ordering import shuffled_ordinal
from flowloom.operators.splitting import kfold
from flowloom.plans import fixtures as fx
from flowloom.plans.registry import query
from flowloom.sources import packets, scan, scratch, sinks

RAW, TOK, DD, KEPT = fx.RAW_SQL, fx.TOKENS_SQL, fx.DISTINCT_SQL, fx.KEPT_SQL
FLOWS = fx.FLOWS_SQL
COLS = ", ".join(f'"{c}"' for c in fx.RAW_COLUMNS)
FEATS = ", ".join(f'"{c}"' for c in fx.RAW_FEATURES)


def _header(spark, sf):
    return clean.normalise_header(fx.raw_flows(spark, sf))


def _numbers(spark, sf):
    """Deduplicated rows with finite features or NULL."""
    df = clean.dedupe(clean.apply_null_tokens(_header(spark, sf)))
    return clean.inf_to_null(clean.coerce_numeric(df, fx.RAW_FEATURES), fx.RAW_FEATURES)


# ---- sources -------------------------------------------------------------


@query(
    "s04_early_stop_sample",
    fx.with_sql(
        FLOWS,
        "head AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, flow_key) AS r FROM flows)",
        f"pick AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {fx.hash_sql('flow_key')}) AS q FROM head WHERE r <= 2400)",
        "SELECT flow_key, source_file FROM pick WHERE q <= 2000",
    ),
)
def s04(spark, sf):
    df = fx.flows(spark, sf).select("flow_key", "source_file", "ts")
    picked = scan.early_stop_sample(df, "flow_key", 2000, ["ts", "flow_key"])
    return picked.select("flow_key", "source_file")


@query(
    "s05_row_cap",
    fx.with_sql(
        FLOWS,
        "r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts, flow_key) AS r FROM flows)",
        "SELECT flow_key, source_file, qty, label FROM r WHERE r <= 2000",
    ),
)
def s05(spark, sf):
    capped = scan.cap_per_file(fx.flows(spark, sf), 2000, ["ts", "flow_key"])
    return capped.select("flow_key", "source_file", "qty", "label")


@query(
    "s06_head_scan",
    fx.with_sql(
        FLOWS,
        "f AS (SELECT source_file FROM (SELECT DISTINCT source_file FROM flows) ORDER BY 1 LIMIT 3)",
        "SELECT flow_key, source_file, label FROM flows WHERE source_file IN (SELECT source_file FROM f) ORDER BY source_file, flow_key LIMIT 3000",
    ),
)
def s06(spark, sf):
    df = fx.flows(spark, sf)
    names = [r[0] for r in df.select("source_file").distinct().orderBy("source_file").limit(3).collect()]
    head = df.filter(F.col("source_file").isin(names))
    return head.orderBy("source_file", "flow_key").limit(3000).select("flow_key", "source_file", "label")


@query(
    "s07_skip_sample",
    fx.with_sql(
        FLOWS,
        f"r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY {fx.hash_sql('flow_key')}) AS r FROM flows)",
        "SELECT flow_key, source_file, price FROM r WHERE r <= 1000",
    ),
)
def s07(spark, sf):
    picked = scan.sample_per_file(fx.flows(spark, sf), "flow_key", 1000)
    return picked.select("flow_key", "source_file", "price")


@query(
    "s08_row_counts",
    fx.with_sql(
        FLOWS,
        "SELECT source_file, count(*) AS n FROM flows GROUP BY 1 UNION ALL SELECT 'TOTAL', count(*) FROM flows",
    ),
)
def s08(spark, sf):
    return scan.row_counts(fx.flows(spark, sf))


@query("s01_scan_raw", fx.with_sql(RAW, TOK, f"SELECT {COLS} FROM tok"))
def s01(spark, sf):
    folder = scratch.new_path(spark, "raw")
    fx.raw_flows(spark, sf).write.option("header", True).csv(folder)
    df = scan.scan_raw(spark, scan.list_files(spark, folder)).drop("source_file")
    return clean.apply_null_tokens(clean.normalise_header(df))


def _mixed_folder(spark, sf):
    """All raw flows in three groups of files: full, in another order without addresses, blank-free names."""
    rows = fx.raw_flows(spark, sf).withColumn("_g", F.pmod(F.xxhash64(" Flow ID"), F.lit(3)))
    names = [c for c in rows.columns if c != "_g"]
    layouts = [
        names,
        [c for c in reversed(names) if c not in ("Src IP", "Dst IP")],
        ["Dst IP", *[c for c in names if c != "Dst IP"]],
    ]
    paths = []
    for i, layout in enumerate(layouts):
        folder = scratch.new_path(spark, f"group{i}")
        part = rows.filter(F.col("_g") == i).select(*layout)
        if i == 2:
            part = part.toDF(*scan.normalised(layout))
        part.write.option("header", True).csv(folder)
        paths += scan.list_files(spark, folder)
    return paths


@query(
    "s01_scan_mixed_headers",
    fx.with_sql(
        RAW, TOK,
        """SELECT "Flow_ID", "Timestamp", "Tot_Qty", "Price", "Disc", "Tax", "Label" FROM tok""",
    ),
)
def s01_mixed(spark, sf):
    """Every row comes back under the right names, whatever its file's header."""
    df = clean.apply_null_tokens(scan.scan_raw(spark, _mixed_folder(spark, sf)))
    return df.select("Flow_ID", "Timestamp", "Tot_Qty", "Price", "Disc", "Tax", "Label")


@query(
    "s03_named_files",
    fx.with_sql(RAW, "SELECT count(*) AS rows, 2 AS absent, 0 AS skipped FROM raw"),
)
def s03(spark, sf):
    """A list of named files, two of which are missing."""
    paths = _mixed_folder(spark, sf)
    rows, absent = scan.scan_named(spark, [*paths, f"{paths[0]}.gone", f"{paths[-1]}.gone"])
    skipped = scan.skipped_lines(spark, paths).agg(F.sum("skipped").alias("skipped"))
    counted = rows.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(absent)).alias("absent"))
    return counted.withColumn("skipped", F.lit(skipped.first()[0]))


@query(
    "s02_bad_lines",
    fx.with_sql(
        FLOWS,
        "k AS (SELECT *, CAST(split_part(flow_key, '-', 1) AS BIGINT) AS o FROM flows)",
        """SELECT flow_key, CASE WHEN o % 11 <> 0 THEN src_ip END AS src_ip, CASE WHEN o % 11 <> 0 THEN flag END AS flag
           FROM k WHERE o % 13 <> 0""",
    ),
)
def s02(spark, sf):
    """Some lines get two fields too many, others lack their last two."""
    order = F.split("flow_key", "-")[0].cast("long")
    line = (
        F.when(order % 13 == 0, F.concat_ws(",", "flow_key", "src_ip", "flag", F.lit("x"), F.lit("y")))
        .when(order % 11 == 0, F.col("flow_key"))
        .otherwise(F.concat_ws(",", "flow_key", "src_ip", "flag"))
    )
    folder = scratch.new_path(spark, "lines")
    fx.flows(spark, sf).select(line.alias("value")).write.text(folder)
    rows = scan.scan_raw(spark, folder, ["flow_key", "src_ip", "flag"], header=False)
    return rows.drop("source_file")


@query(
    "s09_write_cleaned",
    fx.with_sql(FLOWS, "SELECT source_file, flow_key, qty, price, label FROM flows"),
)
def s09(spark, sf):
    folder = scratch.new_path(spark, "cleaned")
    df = fx.flows(spark, sf).select("source_file", "flow_key", "qty", "price", "label")
    sinks.write_table(df, folder, "parquet", ["source_file"])
    return spark.read.parquet(folder)


@query(
    "s12_saved_scaler",
    fx.with_sql(
        FLOWS,
        " UNION ALL ".join(
            f"SELECT {i} AS pos, '{c}' AS feature, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS scale FROM flows"
            for i, c in enumerate(fx.FEATURES)
        ),
    ),
)
def s12(spark, sf):
    folder = scratch.new_path(spark, "scaler")
    scaling.save(scaling.fit(fx.flows(spark, sf), fx.FEATURES), folder)
    params = scaling.load(spark, folder)
    return params.select("pos", "feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


@query(
    "s16_load_cleaned",
    fx.with_sql(
        FLOWS,
        """SELECT flow_key, qty, CASE WHEN label = 1 THEN price END AS price, label AS "Label" FROM flows""",
    ),
)
def s16(spark, sf):
    """Two labelled files with different columns and one without a label."""
    df = fx.flows(spark, sf).withColumnRenamed("label", "Label")
    folder = scratch.new_path(spark, "folder")
    parts = {
        "a": df.filter(F.col("Label") == 0).select("flow_key", "qty", "Label"),
        "b": df.filter(F.col("Label") == 1).select("flow_key", "qty", "price", "Label"),
        "c": df.select("flow_key", "tax"),
    }
    for name, part in parts.items():
        part.write.parquet(f"{folder}/{name}.parquet")
    return scan.load_cleaned(spark, [f"{folder}/{name}.parquet" for name in parts])[0]


@query(
    "s16_csv_folders",
    fx.with_sql(
        FLOWS,
        """SELECT flow_key, qty, CASE WHEN label = 1 THEN price END AS price, label AS "Label",
                  'string double double int' AS kinds FROM flows""",
    ),
)
def s16_csv(spark, sf):
    """Folders of CSV files under two headers, the types of all found together."""
    df = fx.flows(spark, sf).withColumnRenamed("label", "Label")
    folder = scratch.new_path(spark, "folder")
    df.filter(F.col("Label") == 0).select("flow_key", "qty", "Label").write.option("header", True).csv(f"{folder}/a")
    df.filter(F.col("Label") == 1).select("flow_key", "qty", "price", "Label").write.option("header", True).csv(f"{folder}/b")
    rows, _ = scan.load_cleaned(spark, [f"{folder}/a", f"{folder}/b"])
    kinds = dict(rows.dtypes)
    found = " ".join(kinds[c] for c in ("flow_key", "qty", "price", "Label"))
    return rows.select("flow_key", "qty", "price", "Label", F.lit(found).alias("kinds"))


@query(
    "s14_encode_flow",
    fx.with_sql(
        FLOWS,
        """SELECT flow_key, 4 AS width, round(list_sum(list_value(qty, price, disc, tax)), 4) AS total, label AS true_label
           FROM flows""",
    ),
)
def s14(spark, sf):
    df = fx.flows(spark, sf).withColumn("flow_id", F.xxhash64("flow_key"))
    lines = packets.encode(df, "flow_id", fx.FEATURES, "label", ["flow_key"])
    good, _ = packets.decode(lines, "flow_key STRING")
    total = F.aggregate("features", F.lit(0.0), lambda s, x: s + x)
    return good.select(
        "flow_key", F.size("features").alias("width"), F.round(total, 4).alias("total"), "true_label"
    )


# ---- cleaning ------------------------------------------------------------


@query("p01_normalise_header", fx.with_sql(RAW, f"SELECT {COLS} FROM raw"))
def p01(spark, sf):
    return _header(spark, sf)


@query(
    "p02_alias_rename",
    fx.with_sql(
        RAW,
        'SELECT "Flow_ID" AS flow, "Src_IP" AS source_ip, "Dst_IP" AS destination_ip, "Timestamp", "Tot_Qty" AS qty, "Price", "Disc", "Tax", "Label" FROM raw',
    ),
)
def p02(spark, sf):
    names = {"Flow_ID": "flow", "Src_IP": "source_ip", "Dst_IP": "destination_ip", "Tot_Qty": "qty"}
    return clean.normalise_header(fx.raw_flows(spark, sf), names)


def _label_query(name, rule, sql):
    @query(name, fx.with_sql(RAW, f'SELECT "Flow_ID", CASE WHEN {sql} THEN 0 ELSE 1 END AS label FROM raw'))
    def run(spark, sf):
        df = _header(spark, sf)
        return df.select("Flow_ID", text.binary_label(F.col("Label"), rule).alias("label"))


_label_query("p04_label_contains", "contains", """lower(trim("Label")) LIKE '%benign%'""")
_label_query("p05_label_iequals", "iequals", """lower(trim("Label")) = 'benign'""")
_label_query("p06_label_equals", "equals", """trim("Label") = 'Benign'""")


@query("p07_numeric_label", fx.with_sql(FLOWS, "SELECT flow_key, label AS Label FROM flows"))
def p07(spark, sf):
    df = fx.flows(spark, sf).select("flow_key", F.col("label").cast("double").alias("Label"))
    return clean.label_column(df)


FAMILIES = """CASE o % 9 WHEN 0 THEN ' Benign ' WHEN 1 THEN 'Bot' WHEN 2 THEN 'DDoS-HOIC' WHEN 3 THEN 'DoS-Hulk'
    WHEN 4 THEN 'FTP-BruteForce' WHEN 5 THEN 'Infilteration' WHEN 6 THEN 'SQL Injection' WHEN 7 THEN 'Web XSS' ELSE 'other' END"""


@query(
    "p08_multiclass_label",
    fx.with_sql(
        FLOWS,
        "k AS (SELECT flow_key, CAST(split_part(flow_key, '-', 1) AS BIGINT) AS o FROM flows)",
        "SELECT flow_key, CASE o % 9 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 5 WHEN 6 THEN 4 WHEN 7 THEN 4 END AS family FROM k",
    ),
)
def p08(spark, sf):
    """All six families, and a label of none."""
    rows = fx.flows(spark, sf).select("flow_key", F.split("flow_key", "-")[0].cast("long").alias("o"))
    named = rows.withColumn("label", F.expr(FAMILIES))
    return named.select("flow_key", text.multiclass_label(F.col("label")).alias("family"))


@query("p03_require_label", fx.with_sql(RAW, "SELECT count(*) AS rows, true AS refused FROM raw"))
def p03(spark, sf):
    """A table with a label passes, one without is refused."""
    df = clean.require_label(_header(spark, sf))
    try:
        clean.require_label(df.drop("Label"))
        refused = False
    except ValueError:
        refused = True
    return df.agg(F.count(F.lit(1)).alias("rows"), F.lit(refused).alias("refused"))


@query(
    "p18_ip_columns",
    fx.with_sql(RAW, 'SELECT "Src_IP" AS source, "Dst_IP" AS destination, count(*) AS n FROM raw GROUP BY ALL'),
)
def p18(spark, sf):
    """Flows between pairs of hosts, the address columns found by their aliases."""
    df = clean.normalise_header(fx.raw_flows(spark, sf), {"Src_IP": "Source_IP", "Dst_IP": "dstip"})
    source, target = clean.ip_columns(df)
    return df.groupBy(F.col(source).alias("source"), F.col(target).alias("destination")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "s11_feature_list",
    fx.with_sql(
        FLOWS,
        "f AS (SELECT * FROM (VALUES (0, 'qty'), (1, 'price'), (2, 'disc'), (3, 'tax')) t(pos, name))",
        "SELECT pos::INT AS pos, name, (SELECT count(*) FROM flows) AS rows FROM f",
    ),
)
def s11(spark, sf):
    """The names a table's features have, written next to it and read back."""
    df = fx.flows(spark, sf).select(*fx.FEATURES)
    folder = scratch.new_path(spark, "features")
    sinks.write_table(sinks.feature_table(spark, clean.feature_columns(df)), folder)
    return spark.read.parquet(folder).withColumn("rows", F.lit(df.count()))


@query(
    "s13_reports",
    fx.with_sql(
        FLOWS,
        "c AS (SELECT label, count(*) AS n FROM flows GROUP BY label)",
        "SELECT k AS format, label, n FROM c, (VALUES ('csv'), ('json')) t(k)",
    ),
)
def s13(spark, sf):
    """A class report written as CSV and as JSON and read back."""
    report = fx.flows(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    frames = []
    for kind in ("csv", "json"):
        folder = scratch.new_path(spark, "report")
        sinks.write_table(report, folder, kind)
        reader = spark.read.schema("label INT, n LONG").option("header", True).format(kind)
        frames.append(reader.load(folder).select(F.lit(kind).alias("format"), "label", "n"))
    return frames[0].unionByName(frames[1])


@query(
    "p09_coerce_numeric",
    fx.with_sql(
        RAW,
        'SELECT "Flow_ID", TRY_CAST("Price" AS DOUBLE) AS "Price", TRY_CAST("Disc" AS DOUBLE) AS "Disc" FROM raw',
    ),
)
def p09(spark, sf):
    df = _header(spark, sf).select("Flow_ID", "Price", "Disc")
    return clean.coerce_numeric(df, ["Price", "Disc"])


@query("p10_inf_to_null", fx.with_sql(RAW, fx.numbers_sql("raw"), f'SELECT "Flow_ID", {FEATS} FROM num'))
def p10(spark, sf):
    df = clean.coerce_numeric(_header(spark, sf), fx.RAW_FEATURES)
    return clean.inf_to_null(df, fx.RAW_FEATURES).select("Flow_ID", *fx.RAW_FEATURES)


@query(
    "p11_fill_zero",
    fx.with_sql(
        RAW, TOK, DD, fx.numbers_sql("dd"),
        'SELECT "Flow_ID", ' + ", ".join(f'coalesce("{c}", 0.0) AS "{c}"' for c in fx.RAW_FEATURES) + " FROM num",
    ),
)
def p11(spark, sf):
    return clean.fill_zero(_numbers(spark, sf), fx.RAW_FEATURES).select("Flow_ID", *fx.RAW_FEATURES)


def _median_sql(source):
    mids = ", ".join(f'quantile_cont("{c}", 0.5) AS "m_{c}"' for c in fx.RAW_FEATURES)
    return f"mid AS (SELECT {mids} FROM {source})"


_FILLED = ", ".join(f'round(coalesce("{c}", "m_{c}"), 6) AS "{c}"' for c in fx.RAW_FEATURES)


@query(
    "p12_median_impute",
    fx.with_sql(
        RAW, TOK, DD, KEPT, fx.numbers_sql("kept"), _median_sql("num"),
        f'SELECT "Flow_ID", {_FILLED}, CASE WHEN lower("Label") = \'benign\' THEN 0 ELSE 1 END AS "Label" FROM num, mid',
    ),
)
def p12(spark, sf):
    df = clean.apply_null_tokens(_header(spark, sf))
    df = clean.drop_sparse_rows(clean.dedupe(df))
    df = clean.inf_to_null(clean.coerce_numeric(df, fx.RAW_FEATURES), fx.RAW_FEATURES)
    df = scratch.materialise(clean.label_column(df, "iequals"), "clean")
    df = clean.impute_median(df, fx.RAW_FEATURES)
    return df.select("Flow_ID", *[F.round(c, 6).alias(c) for c in fx.RAW_FEATURES], "Label")


@query("p13_drop_sparse", fx.with_sql(RAW, TOK, DD, KEPT, f"SELECT {COLS} FROM kept"))
def p13(spark, sf):
    return clean.drop_sparse_rows(clean.dedupe(clean.apply_null_tokens(_header(spark, sf))))


@query("p14_dedupe", fx.with_sql(RAW, f"SELECT DISTINCT {COLS} FROM raw"))
def p14(spark, sf):
    return clean.dedupe(_header(spark, sf))


@query("p15_drop_ids", fx.with_sql(RAW, f'SELECT {FEATS}, "Label" FROM raw'))
def p15(spark, sf):
    return clean.drop_ids(_header(spark, sf))


@query(
    "p16_drop_id_tokens",
    fx.with_sql(RAW, f'SELECT {FEATS}, "Label" FROM raw'),
)
def p16(spark, sf):
    df = _header(spark, sf)
    return clean.drop_id_like(df.withColumn("Mean_Src_Port_Use", F.length("Src_IP")))


@query("p19_class_filter", fx.with_sql(FLOWS, "SELECT flow_key, price FROM flows WHERE label = 1"))
def p19(spark, sf):
    return fx.flows(spark, sf).filter(F.col("label") == 1).select("flow_key", "price")


@query(
    "p20_check_width",
    fx.with_sql(FLOWS, "SELECT flow_key, tax <> 0 AS accepted FROM flows"),
)
def p20(spark, sf):
    df = clean.assemble(fx.flows(spark, sf), fx.FEATURES)
    short = F.when(F.col("tax") == 0, F.slice("features", 1, 3)).otherwise(F.col("features"))
    good, bad = clean.check_width(df.withColumn("features", short), 4)
    return good.select("flow_key", F.lit(True).alias("accepted")).unionByName(
        bad.select("flow_key", F.lit(False).alias("accepted"))
    )


@query(
    "p21_encode_categories",
    fx.with_sql(
        FLOWS,
        "words AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT flag AS v FROM flows WHERE label = 0))",
        "words2 AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT status AS v FROM flows WHERE label = 0))",
        """SELECT flow_key, CAST(coalesce(w.code, -1) AS INT) AS flag, CAST(coalesce(u.code, -1) AS INT) AS status
           FROM flows LEFT JOIN words w ON flag = w.v LEFT JOIN words2 u ON status = u.v""",
    ),
)
def p21(spark, sf):
    df = fx.flows(spark, sf)
    coded = clean.encode_categories(df, ["flag", "status"], df.filter(F.col("label") == 0))
    return coded.select("flow_key", "flag", "status")


@query(
    "p22_assemble",
    fx.with_sql(FLOWS, "SELECT flow_key, 4 AS width, qty AS first, tax AS last FROM flows"),
)
def p22(spark, sf):
    df = clean.assemble(fx.flows(spark, sf), fx.FEATURES)
    return df.select(
        "flow_key",
        F.size("features").alias("width"),
        F.col("features")[0].alias("first"),
        F.element_at("features", -1).alias("last"),
    )


@query(
    "p23_drop_invalid",
    "SELECT event_id, round(value - 10, 4) AS duration FROM events WHERE value - 10 >= 0",
)
def p23(spark, sf):
    df = fx.table(spark, sf, "events").withColumn("duration", F.col("value") - 10)
    return clean.drop_invalid(df, "duration").select("event_id", F.round("duration", 4).alias("duration"))


@query(
    "p24_parse_time",
    fx.with_sql(
        RAW,
        """SELECT "Flow_ID", CAST(epoch(strptime("Timestamp", '%d/%m/%Y %H:%M:%S')) AS BIGINT) AS seconds FROM raw""",
    ),
)
def p24(spark, sf):
    df = clean.parse_time(_header(spark, sf), "Timestamp")
    return df.select("Flow_ID", F.unix_timestamp("Timestamp").alias("seconds"))


@query(
    "p25_winsorise",
    fx.with_sql(
        FLOWS,
        "m AS (SELECT " + ", ".join(
            f"quantile_cont({c}, 0.01) AS lo_{c}, quantile_cont({c}, 0.99) AS hi_{c}" for c in ("qty", "price")
        ) + " FROM flows)",
        "SELECT flow_key, " + ", ".join(
            f"round(least(greatest({c}, lo_{c}), hi_{c}), 6) AS {c}" for c in ("qty", "price")
        ) + " FROM flows, m",
    ),
)
def p25(spark, sf):
    df = clean.winsorise(fx.flows(spark, sf), ["qty", "price"])
    return df.select("flow_key", F.round("qty", 6).alias("qty"), F.round("price", 6).alias("price"))


@query(
    "p26_log_skewed",
    fx.with_sql(
        FLOWS,
        "v AS (SELECT flow_key, qty, qty * qty * price AS volume FROM flows)",
        "m AS (SELECT avg(qty) AS a1, avg(volume) AS a2 FROM v)",
        """s AS (SELECT avg(pow(qty - a1, 3)) / pow(avg(pow(qty - a1, 2)), 1.5) AS k1,
                  avg(pow(volume - a2, 3)) / pow(avg(pow(volume - a2, 2)), 1.5) AS k2 FROM v, m)""",
        """SELECT flow_key,
             round(CASE WHEN abs(k1) > 1 THEN sign(qty) * ln(1 + abs(qty)) ELSE qty END, 6) AS qty,
             round(CASE WHEN abs(k2) > 1 THEN sign(volume) * ln(1 + abs(volume)) ELSE volume END, 6) AS volume
           FROM v, s""",
    ),
)
def p26(spark, sf):
    df = fx.flows(spark, sf).select(
        "flow_key", "qty", (F.col("qty") * F.col("qty") * F.col("price")).alias("volume")
    )
    logged = clean.log_skewed(df, ["qty", "volume"], 1.0)
    return logged.select("flow_key", F.round("qty", 6).alias("qty"), F.round("volume", 6).alias("volume"))


@query(
    "p27_low_variance",
    fx.with_sql(
        FLOWS,
        "l AS (UNPIVOT (SELECT flow_key, qty::DOUBLE AS qty, price::DOUBLE AS price, disc::DOUBLE AS disc, tax::DOUBLE AS tax FROM flows) ON qty, price, disc, tax INTO NAME feature VALUE value)",
        "v AS (SELECT feature FROM l GROUP BY feature HAVING var_pop(value) > 0.01)",
        "SELECT flow_key, feature, value FROM l JOIN v USING (feature)",
    ),
)
def p27(spark, sf):
    """The surviving columns in long form, so that SQL decides which survive."""
    df = fx.flows(spark, sf).select("flow_key", *fx.FEATURES)
    kept = clean.drop_low_variance(df, fx.FEATURES, 0.01)
    names = [c for c in kept.columns if c != "flow_key"]
    return kept.unpivot("flow_key", names, "feature", "value")


@query(
    "p28_concat",
    fx.with_sql(
        FLOWS,
        "SELECT flow_key, qty, NULL::DOUBLE AS price FROM flows WHERE label = 0 UNION ALL SELECT flow_key, NULL, price FROM flows WHERE label = 1",
    ),
)
def p28(spark, sf):
    df = fx.flows(spark, sf)
    return clean.concat(
        [
            df.filter(F.col("label") == 0).select("flow_key", "qty"),
            df.filter(F.col("label") == 1).select("flow_key", "price"),
        ]
    )


@query(
    "p31_display_label",
    fx.with_sql(
        fx.SCORED_SQL,
        """SELECT flow_key, CASE y_true WHEN 0 THEN 'Benign' ELSE 'Attack' END AS truth,
             CASE y_pred WHEN 0 THEN 'Benign' ELSE 'Attack' END AS guess, y_true = y_pred AS correct FROM scored""",
    ),
)
def p31(spark, sf):
    return fx.scored(spark, sf).select(
        "flow_key",
        text.display_label(F.col("y_true")).alias("truth"),
        text.display_label(F.col("y_pred")).alias("guess"),
        (F.col("y_true") == F.col("y_pred")).alias("correct"),
    )


@query("p32_drop_named", fx.with_sql(RAW, f'SELECT "Flow_ID", {FEATS}, "Label" FROM raw'))
def p32(spark, sf):
    return clean.drop_ids(_header(spark, sf), keep=["Flow_ID"])


@query("p33_features_and_label", fx.with_sql(FLOWS, "SELECT flow_key, qty, price, disc, tax, label FROM flows"))
def p33(spark, sf):
    df = fx.flows(spark, sf)
    x = [c for c in clean.feature_columns(df.select(*fx.FEATURES, "label"), "label")]
    return df.select("flow_key", *x, "label")


@query(
    "p17_numeric_features",
    fx.with_sql(
        FLOWS,
        "f AS (SELECT unnest(['qty', 'price', 'disc', 'tax']) AS feature, unnest([qty, price, disc, tax]) AS value FROM flows)",
        "SELECT feature, count(value) AS n, round(sum(value), 2) AS total FROM f GROUP BY feature",
    ),
)
def p17(spark, sf):
    """Features by type: addresses, times, text and a column without values are left out."""
    df = fx.flows(spark, sf).withColumns({"void": F.lit(None).cast("double"), "note": F.col("flag"), "nested": F.array("qty")})
    names = clean.numeric_features(df.withColumnRenamed("label", "Label"))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in names]))
    found = df.select(pairs.alias("e")).groupBy("e.feature").agg(F.count("e.value").alias("n"), F.sum("e.value").alias("total"))
    return found.withColumn("total", F.round("total", 2))


@query(
    "p12_sketch_median",
    fx.with_sql(
        FLOWS,
        "f AS (SELECT unnest(['qty', 'price', 'disc', 'tax']) AS feature, unnest([qty, price, disc, tax]) AS value FROM flows)",
        "SELECT feature, count(value) AS n, true AS within, true AS read_once FROM f GROUP BY feature",
    ),
)
def p12_sketch(spark, sf):
    """Medians from one sketch per file: their exact ranks lie within the stated error; later files alone are read later."""
    folder = scratch.new_path(spark, "files")
    fx.flows(spark, sf).select("source_file", *fx.FEATURES).write.partitionBy("source_file").parquet(folder)
    df = spark.read.parquet(folder)
    files = sorted(df.inputFiles())
    held = quantiles.FileSketches(spark, lambda paths: spark.read.option("basePath", folder).parquet(*paths), fx.FEATURES)
    some = held.add(files[: len(files) // 2])
    read_once = some + held.add(files) == len(files) and held.add(files) == 0
    values, error = held.quantiles([0.5]), held.rank_error
    parts = []
    for c in fx.FEATURES:
        middle = F.lit(values[c][0])
        below, upto = F.avg((F.col(c) < middle).cast("double")), F.avg((F.col(c) <= middle).cast("double"))
        parts.append(df.agg(F.lit(c).alias("feature"), F.count(c).alias("n"), ((below <= 0.5 + error) & (upto >= 0.5 - error)).alias("within")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.withColumn("read_once", F.lit(read_once))


@query("p34_null_tokens", fx.with_sql(RAW, TOK, f"SELECT {COLS} FROM tok"))
def p34(spark, sf):
    return clean.apply_null_tokens(_header(spark, sf))


@query(
    "clean_flows_median",
    fx.with_sql(
        RAW, TOK, DD, KEPT, fx.numbers_sql("kept"), _median_sql("num"),
        f'SELECT {_FILLED}, CASE WHEN lower("Label") = \'benign\' THEN 0 ELSE 1 END AS "Label" FROM num, mid',
    ),
)
def clean_median(spark, sf):
    df = clean.clean_flows(fx.raw_flows(spark, sf), "iequals", "median")
    return df.withColumns({c: F.round(c, 6) for c in fx.RAW_FEATURES})


@query(
    "clean_flows_zero",
    fx.with_sql(
        RAW, TOK, DD, fx.numbers_sql("dd"),
        'SELECT "Src_IP", "Dst_IP", ' + ", ".join(f'coalesce("{c}", 0.0) AS "{c}"' for c in fx.RAW_FEATURES)
        + """, CASE WHEN lower("Label") LIKE '%benign%' THEN 0 ELSE 1 END AS "Label" FROM num""",
    ),
)
def clean_zero(spark, sf):
    return clean.clean_flows(fx.raw_flows(spark, sf), "contains", "zero", keep_ip=True)


@query(
    "flagship_class_distribution",
    fx.with_sql(
        RAW, TOK, DD, KEPT,
        """l AS (SELECT CASE WHEN lower("Label") = 'benign' THEN 0 ELSE 1 END AS label FROM kept)""",
        "SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM l GROUP BY label",
    ),
)
def flagship(spark, sf):
    """Classes are not changed by filling gaps, so no medians are asked for."""
    cleaned = clean.clean_flows(fx.raw_flows(spark, sf), "iequals", None)
    dist = metrics.class_distribution(cleaned.withColumnRenamed("Label", "label"))
    return dist.withColumn("percent", F.round("percent", 6))


# ---- scaling -------------------------------------------------------------

_STATS = " UNION ALL ".join(
    f"SELECT {i} AS pos, '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std_pop FROM flows"
    for i, c in enumerate(fx.FEATURES)
)


@query(
    "n01_fit_scaler",
    fx.with_sql(
        FLOWS,
        f"s AS ({_STATS})",
        "SELECT pos, feature, round(mean, 4) AS mean, round(std_pop, 4) AS std_pop, round(CASE WHEN std_pop = 0 THEN 1 ELSE std_pop END, 4) AS scale FROM s",
    ),
)
def n01(spark, sf):
    params = scaling.fit(fx.flows(spark, sf), fx.FEATURES)
    return params.withColumns({c: F.round(c, 4) for c in ("mean", "std_pop", "scale")})


@query(
    "n02_apply_scaler",
    fx.with_sql(
        FLOWS,
        "m AS (SELECT " + ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in fx.FEATURES)
        + " FROM flows WHERE label = 0)",
        "SELECT flow_key, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0 AS {c}" for c in fx.FEATURES)
        + " FROM flows, m",
    ),
)
def n02(spark, sf):
    df = fx.flows(spark, sf)
    scaled = scaling.apply(df, scaling.fit(df.filter(F.col("label") == 0), fx.FEATURES))
    return scaled.select("flow_key", *[(F.round(c, 6) + 0.0).alias(c) for c in fx.FEATURES])


_FOLDS = f"""r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {fx.hash_sql('flow_key')}) - 1 AS o,
      count(*) OVER (PARTITION BY label) AS n FROM flows),
    folds AS (SELECT *, list_sum([(o >= n * i // 5)::INT FOR i IN [1, 2, 3, 4]])::INT AS fold FROM r)"""


@query(
    "n03_scale_folds",
    fx.with_sql(
        FLOWS, _FOLDS,
        """p AS (SELECT k.fold, avg(price) AS m, stddev_pop(price) AS s, avg(tax) AS mt, stddev_pop(tax) AS st
             FROM folds f JOIN (SELECT DISTINCT fold FROM folds) k ON f.fold <> k.fold GROUP BY k.fold)""",
        """SELECT flow_key, fold, round((price - m) / s, 6) + 0.0 AS price, round((tax - mt) / st, 6) + 0.0 AS tax
           FROM folds JOIN p USING (fold)""",
    ),
)
def n03(spark, sf):
    df = kfold(fx.flows(spark, sf), "flow_key").select("flow_key", "fold", "price", "tax")
    df = scratch.materialise(df, "folds")
    params = scaling.fit_folds(df, ["price", "tax"])
    scaled = scaling.apply(df, params, "fold")
    return scaled.select(
        "flow_key", "fold", (F.round("price", 6) + 0.0).alias("price"), (F.round("tax", 6) + 0.0).alias("tax")
    )


# ---- scalar rules --------------------------------------------------------


@query(
    "f01_softmax_confidence",
    fx.with_sql(
        fx.SCORED_SQL,
        """SELECT flow_key, round(exp(prob * 2) / (exp(prob * 2) + exp(1 - prob)), 6) AS p1,
             round(abs(prob - 0.5) * 2, 6) AS confidence, printf('%.2f', prob * 100) || '%' AS percent FROM scored""",
    ),
)
def f01(spark, sf):
    df = fx.scored(spark, sf)
    _, p1 = numeric.softmax([1 - F.col("prob"), F.col("prob") * 2])
    return df.select(
        "flow_key",
        F.round(p1, 6).alias("p1"),
        F.round(numeric.confidence(F.col("prob")), 6).alias("confidence"),
        F.format_string("%.2f%%", F.col("prob") * 100).alias("percent"),
    )


@query(
    "p29_shuffle",
    fx.with_sql(
        FLOWS,
        f"SELECT flow_key, row_number() OVER (ORDER BY {fx.hash_sql('flow_key')}) - 1 AS position FROM flows",
    ),
)
def p29(spark, sf):
    df = fx.flows(spark, sf).select("flow_key")
    return shuffled_ordinal(df, "flow_key", name="position")
