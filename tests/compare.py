"""Runs queries beside their SQL twins: python -m tests.compare [SF_DIR] [NAME...]"""

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, got.fetchall()


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), x) for x in r))


def differences(spark, f, sql, sf_dir):
    """None where the query and its twin agree, else what differs first."""
    df = f(spark, sf_dir)
    a, b = table(df.columns, [tuple(r) for r in df.collect()]), table(*oracle(sf_dir, sql))
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    return next((f"{x} and {y}" for x, y in zip(a[1], b[1], strict=True) if x != y), None)


if __name__ == "__main__":
    import __spark_entry__ as entry
    from mapstats.session import local_session

    sf, names = (sys.argv[1:2] or ["/root/testdata/sf0.01"])[0], sys.argv[2:]
    session = local_session("compare", cores=8, shuffle_partitions=8, checkpoint_dir="/tmp/mapstats-compare")
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or [n for n in queries if not n.startswith("op") and n != "pipeline"]:
        start = time.time()
        try:
            if name in oracles:
                said = differences(session, queries[name], oracles[name], sf)
            else:
                said, rows = None, queries[name](session, sf).count()
                print(f"     {name}: {rows} rows, no twin, {time.time() - start:.1f} s", flush=True)
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:300]}"
        if said:
            bad += 1
            print(f"DIFF {name}: {said}", flush=True)
    print("differing:", bad)
