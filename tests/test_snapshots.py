"""Daily snapshots to intervals and changes, against a replay day by day."""

import json
import random

from lotwatch.operators.intervals import changes, intervals
from lotwatch.sources import legacy


def test_snapshots(spark, tmp_path):
    rng = random.Random(8)
    days = [f"2026-06-{d:02d}" for d in (15, 16, 18, 19, 20, 23)]
    held = {}
    for d in days:
        rows = {f"s-{i}": {"id": f"s-{i}", "source": "s", "title": "t", "status": rng.choice(["active", "active", None, "sold"]), "price_original": rng.choice([1.0, 2.0])} for i in range(12) if rng.random() < 0.6}
        held[d] = rows
        twice = [dict(next(iter(rows.values())))] if rows else []
        (tmp_path / f"listings-{d}.json").write_text(json.dumps([*rows.values(), *twice]))
    state = ["status", "price_original"]
    found = intervals(legacy.snapshots(spark, str(tmp_path)), state)
    want, moves, open_ = [], [], {}
    for d, rows in held.items():
        for i in sorted({*open_, *rows}):
            now = tuple(rows[i][s] for s in state) if i in rows else None
            was = open_.get(i)
            if was and was[0] != now:
                want.append((i, *was[0], was[1], d))
                moves.append((d, i, "changed" if now else "gone", was[0], now))
                del open_[i]
            if now and (not was or was[0] != now):
                if not was:
                    moves.append((d, i, "back" if any(w[0] == i for w in want) else "new", next((w[1:3] for w in reversed(want) if w[0] == i), None), now))
                open_[i] = (now, d)
    want += [(i, *s, since, None) for i, (s, since) in open_.items()]
    text = lambda d: None if d is None else str(d)
    assert sorted(map(str, want)) == sorted(str((r["id"], r["status"], r["price_original"], str(r["valid_from"]), text(r["valid_to"]))) for r in found.collect())
    got = [(str(r["day"]), r["id"], r["kind"], tuple(r["before"]) if r["before"] else None, tuple(r["after"]) if r["after"] else None) for r in changes(found, state).collect()]
    assert sorted(map(str, got)) == sorted(map(str, moves)) and {m[2] for m in moves} == {"new", "changed", "gone", "back"}
    assert intervals(legacy.snapshots(spark, str(tmp_path)).limit(0), state).count() == 0
