"""Sale enrichment against a plain simulation, batch by batch and client by client."""

import datetime as dt
import math
import os
import random
import threading
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from topicloom.llm import enrichment
from topicloom.llm.enrichment import _bisect, enrich
from topicloom.llm.queries import CRC_TABLE_SQL, ORACLE_SQL, QUERIES, crc_of

DAY0, DAYS, BATCHES = 19_723, 152, 10
EPOCH = dt.datetime(1970, 1, 1)


def batch(day):
    return max(0, min(BATCHES - 1, math.floor((day - DAY0) * BATCHES / DAYS)))


def day(at):
    return (at - EPOCH).days


def simulated(sales, changes):
    """Rows (rec, id, batch, n_held, change_id, balance_cents, op); sales: (id, client, sold, arrived), distinct changes: (id, client, seq, op, valid, balance)."""
    coming, changing = defaultdict(list), defaultdict(list)
    for s in sales:
        coming[BATCHES - 1 if s[3] is None else batch(day(s[3]))].append(s)
    for c in changes:
        if c[4] is not None:
            changing[batch(day(c[4]) + (0 if c[0] is None else zlib.crc32(str(c[0]).encode()) % 4))].append(c)
    low, hours = dt.datetime.min, dt.timedelta(hours=36)
    sold_marks, valid_marks, held, waiting, out = [], [], defaultdict(list), [], []
    small = -(2**63)
    cents = lambda x: None if x is None or not math.isfinite(x) else math.floor(100 * x + 0.5)
    rank = lambda c: (c[4], small if c[2] is None else c[2], small if c[0] is None else c[0], small if cents(c[5]) is None else cents(c[5]), c[3] or "")

    def emit(sale, b):
        own = sorted(held[sale[1]], key=rank) if sale[1] is not None else []
        good = [c for c in own if sale[2] is not None and c[4] <= sale[2]]
        found = good[-1] if good else None
        out.append(("sale", sale[0], b, len(own), found and found[0], found and cents(found[5]), found and found[3]))

    for b in range(BATCHES):
        ws = max(sold_marks) - hours if sold_marks else low
        wc = max(valid_marks) - hours if valid_marks else low
        h = min(ws, wc)
        for c in changing[b]:
            if c[4] < wc:
                out.append(("late", c[0], b, None, None, None, None))
            else:
                held[c[1]].append(c)
        waiting += coming[b]
        for s in [s for s in waiting if s[2] is None or s[2] < h]:
            emit(s, b)
        waiting = [s for s in waiting if s[2] is not None and s[2] >= h]
        for client, own in held.items():
            past = sorted((c for c in own if c[4] <= h), key=rank)
            held[client] = past[-1:] + [c for c in own if c[4] > h]
        sold_marks += [s[2] for s in coming[b] if s[2] is not None]
        valid_marks += [c[4] for c in changing[b]]
    for s in waiting:
        emit(s, BATCHES)
    return sorted(out, key=str)


def made(seed, n, clients, gap=()):
    draw = random.Random(seed)
    start = dt.datetime(2024, 1, 1)
    when = lambda: start + dt.timedelta(seconds=draw.randrange(0, 150 * 86_400, 3600))
    who = lambda: 7 if draw.random() < 0.4 else draw.choice([None, *range(clients)])
    sales, changes = [], []
    for i in range(n):
        sold = when()
        arrived = sold + dt.timedelta(hours=draw.choice([0, 1, 30, 400]))
        sales.append((draw.choice([i, i, i, None, 3]), who(), draw.choice([sold] * 12 + [None]), draw.choice([arrived] * 12 + [None])))
        valid = draw.choice([when(), when(), None, start + dt.timedelta(days=40)])
        changes.append((draw.choice([i, i, i, i, None, 5]), who(), draw.choice([0, 1, 2, None]), draw.choice(["I", "U", "D", None]), valid, draw.choice([None, 1.005, -3.14, float("nan"), float("inf"), 1e300, draw.random() * 1e4])))
    changes = [tuple(None if isinstance(x, float) and not math.isfinite(x) and draw.random() < 0.5 else x for x in c) for c in changes]
    empty = lambda at: at is not None and any(a <= batch(day(at)) <= b for a, b in gap)
    return [s for s in sales if not empty(s[3])], [c for c in changes if not empty(c[4])] + changes[:20]


def tables(spark, sales, changes):
    s = spark.createDataFrame([(*r, "x") for r in sales], "sale_id long, client_id long, sold_at timestamp_ntz, arrived_at timestamp_ntz, cell string").repartition(3)
    c = spark.createDataFrame(changes, "change_id long, client_id long, seq long, op string, valid_at timestamp_ntz, balance double").repartition(3)
    return s, c


def plain(c):
    """1e300 has no cents either."""
    return tuple(None if i == 5 and x is not None and (not math.isfinite(x) or abs(x) > 9e16) else x for i, x in enumerate(c))


def test_simulation_with_many_cells_and_a_hot_client(spark):
    sales, changes = made(1, 700, 40, gap=[(3, 4)])
    want = simulated(sales, [plain(c) for c in {(*c[:5], str(c[5])): c for c in changes}.values()])
    got = sorted([tuple(r) for r in enrich(*tables(spark, sales, changes), cell=64).collect()], key=str)
    assert len(got) == len(want) and got == want
    assert any(r[0] == "late" for r in got) and any(r[2] == BATCHES for r in got) and {r[6] for r in got} >= {"I", "U", "D", None}


def open_stores(pid):
    """State stores that the JVM holds open: each has its lock file."""
    found = []
    for fd in os.listdir(f"/proc/{pid}/fd"):
        try:
            found.append(os.readlink(f"/proc/{pid}/fd/{fd}").endswith("/LOCK"))
        except OSError:  # closed meanwhile
            pass
    return sum(found)


def test_stores_are_open_only_while_their_task_runs(spark, monkeypatch):
    monkeypatch.setattr(enrichment, "TASK", 20)  # many more stores than cores
    pid, cores = spark._jvm.java.lang.ProcessHandle.current().pid(), spark.sparkContext.defaultParallelism
    seen, over = [], threading.Event()

    def watch():
        while not over.wait(0.05):
            seen.append(open_stores(pid))

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        sales, changes = made(3, 400, 20)
        enrich(*tables(spark, sales, changes), batches=2, cell=64)
    finally:
        left = open_stores(pid)
        over.set()
        watcher.join()
    assert 0 < max(seen) <= cores and left == 0


def test_empty_tables(spark):
    sales, changes = made(2, 40, 5)
    none_s, none_c = tables(spark, [], [])
    some_s, some_c = tables(spark, sales, changes)
    assert enrich(none_s, none_c).collect() == []
    assert sorted([tuple(r) for r in enrich(some_s, none_c).collect()], key=str) == simulated(sales, [])


def test_registered_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("sales", "client_changes"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = QUERIES["op11_sale_enrichment"](spark, sf_dir)
    assert got.dtypes == [("rec", "string"), ("id", "bigint"), ("batch", "bigint"), ("n_held", "bigint"), ("change_id", "bigint"), ("balance_cents", "bigint"), ("op", "string")]
    found = con.execute(ORACLE_SQL["op11_sale_enrichment"])
    assert [d[0] for d in found.description] == got.columns
    assert sorted([tuple(r) for r in got.collect()], key=str) == sorted(found.fetchall(), key=str)


def test_crc_in_sql():
    texts = ["", "a", "-12", "zwölf", "9" * 300]
    got = duckdb.connect().execute(f"WITH {CRC_TABLE_SQL} SELECT {crc_of('x')} FROM (SELECT unnest(?) AS x), tab", [texts]).fetchall()
    assert [r[0] for r in got] == [zlib.crc32(t.encode()) for t in texts]


@pytest.mark.parametrize("seed", range(4))
def test_bisection_of_many_ranges(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(0, 9, 50)
    end = np.cumsum(sizes)
    begin = end - sizes
    at = np.concatenate([np.sort(rng.integers(0, 6, n)) for n in sizes])
    wanted = rng.integers(-1, 7, 50)
    assert _bisect(at, begin, end, wanted).tolist() == [int(b + np.searchsorted(at[b:e], w, "right")) for b, e, w in zip(begin, end, wanted, strict=True)]
