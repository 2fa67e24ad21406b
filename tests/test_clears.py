"""The live summary with clears: its keyed function, batch by batch, next to a plain count."""

import random

import pandas as pd

from matchpulse.streaming import clears
from tests.test_state import FakeState

COLUMNS = [x.split()[0] for x in clears.ROWS.split(", ")]


def plain(rows):
    """rows: (at, clear, grp, prob) in order."""
    last = max((i for i, r in enumerate(rows) if r[1]), default=-1)
    out = {}
    for at, _, grp, prob in rows[last + 1 :]:
        out[grp] = (out.get(grp, (0, 0))[0] + 1, prob)
    return out


def test_clears_between_and_inside_micro_batches(spark):
    r = random.Random(4)
    for _ in range(20):
        rows = [(i, r.random() < 0.08, r.choice("abc"), r.random()) for i in range(80)]
        state, written, epoch = FakeState(), [], 0
        cuts = sorted(r.sample(range(1, 80), 4))
        for a, b in zip([0, *cuts], [*cuts, 80]):
            batch = [(0, c, None if c else g, at, 0, at, None if c else p) for at, c, g, p in rows[a:b]]
            r.shuffle(batch)
            written += [x for df in clears.advance((0,), iter([pd.DataFrame(batch, columns=COLUMNS)]), state) for x in df.itertuples(index=False)]
        epoch = max((x.epoch for x in written), default=0)
        shown = {}
        for x in written:
            if x.epoch == epoch and isinstance(x.grp, str):
                shown[x.grp] = (x.ticks, x.last_prob)
        assert epoch == sum(c for _, c, _, _ in rows) and shown == plain(rows)


def test_a_tick_from_before_the_clear_counts_as_cleared():
    state = FakeState()
    run = lambda *rows: [x for df in clears.advance((0,), iter([pd.DataFrame(rows, columns=COLUMNS)]), state) for x in df.itertuples(index=False)]
    run((0, False, "a", 5, 0, 1, 0.5), (0, True, None, 9, 0, 2, None))
    assert run((0, False, "a", 9, 0, 1, 0.5)) == []
    assert [(x.grp, x.ticks) for x in run((0, False, "a", 9, 0, 3, 0.25))] == [("a", 1)]


def test_query_with_clears(spark, sf_dir):
    from tests.compare import compare

    assert compare(spark, sf_dir, "live_round_summary_cleared") is None
