"""Runs queries next to their SQL and compares rows.

    python tests/oracle.py [sf] [name part ...]
"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

ROOT = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    con.execute(sql)
    names = [d[0] for d in con.description]
    return names, con.fetchall()


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    text = sorted(repr([row[i] for i in order]) for row in rows)
    return [names[i] for i in order], text


def difference(df, sql, sf_dir):
    """None when equal, else what differs."""
    got = canonical(df.columns, [tuple(r) for r in df.collect()])
    want = canonical(*expected(sql, sf_dir))
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    if got[1] != want[1]:
        only = sorted(set(got[1]) - set(want[1]))[:3], sorted(set(want[1]) - set(got[1]))[:3]
        return f"values {len(set(got[1]) - set(want[1]))} differ: {only[0]} != {only[1]}"
    return None


def main(argv):
    import __spark_entry__ as entry
    from flowloom.session import session

    sf_dir = f"{ROOT}/sf{argv[0] if argv else '0.01'}"
    spark = session(master=f"local[{os.environ.get('CPUS', '8')}]", shuffle_partitions=8, extra={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    oracles, failed = entry.oracle_sql(), []
    for name, run in sorted(entry.queries().items()):
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            if name in oracles:
                problem = difference(df, oracles[name], sf_dir)
            else:
                problem = None if (n := df.count()) else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'FAIL' if problem else 'ok':4} {kind:4} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return bool(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
