"""The keyed state against the reconcile that rewrites the store."""

import random
from datetime import date, timedelta

from pyspark.sql import functions as F

from lotwatch.operators.files import cut
from lotwatch.operators.reconcile import reconcile
from lotwatch.schemas import LISTING
from lotwatch.streaming import keyed
from tests.test_listings import empty, incoming

FIRST = date(2026, 1, 1)


def as_text(rows, columns):
    return sorted(str([r[c] for c in columns]) for r in rows)


def test_replay_with_restarts(spark, tmp_path, monkeypatch):
    """Random days, with a source that is out, listings that go and come back, and a day in two parts: same store, same changes."""
    monkeypatch.setattr(keyed, "BUCKETS", 3)
    rng, landing, root = random.Random(5), str(tmp_path / "landing"), str(tmp_path / "root")
    store, want, columns = empty(spark), [], [c for c in spark.createDataFrame([], LISTING).columns if c != "relist"]
    for n in (0, 1, 3, 4, 6):
        day = (FIRST + timedelta(n)).isoformat()
        up = ["ebay", "kaidee"] if n != 3 else ["ebay"]
        rows = [{"id": f"{s}:{i}", "amount": float(rng.choice([100, 200, 250])), "title": f"lot {s}{i} {n}", "status": rng.choice(["active"] * 5 + ["sold"]), "tt": rng.choice([None, f"t{n}"])} for s in up for i in range(12) if rng.random() < 0.45]
        frame = cut(incoming(spark, *rows))
        out = reconcile(store, frame, frame.select("source").distinct(), day)
        want += [("new", r["id"], day) for r in out.new.collect()] + [("price_changed", r["id"], day, r["old_gbp"], r["new_gbp"], r["pct"]) for r in out.price_changed.collect()]
        want += [("status_changed", r["id"], day, r["old_status"], r["new_status"]) for r in out.status_changed.collect()]
        store = cut(out.store)
        if n == 1:  # its rows come in two batches
            keyed.land(frame.filter("ordinal % 2 = 0"), day, landing)
            keyed.start(spark, landing, root).awaitTermination()
            keyed.land(frame.filter("ordinal % 2 = 1"), day, landing)
        else:
            keyed.land(frame, day, landing)
        if n != 4:  # two days in one run
            keyed.start(spark, landing, root).awaitTermination()  # each run starts from the checkpoint
    keyed.close(spark, day, landing)
    keyed.start(spark, landing, root).awaitTermination()
    got = spark.read.parquet(f"{root}/changes").withColumn("day", F.col("day").cast("string")).collect()
    fields = {"new": (), "price_changed": ("old_gbp", "new_gbp", "pct"), "status_changed": ("old_status", "new_status")}
    assert sorted(map(str, want)) == sorted(str((r["kind"], r["id"], r["day"], *(r[f] for f in fields[r["kind"]]))) for r in got)
    assert sum(w[-1] == "withdrawn" for w in want) > 3
    assert as_text(keyed.stored(spark, root).collect(), columns) == as_text(store.collect(), columns)
