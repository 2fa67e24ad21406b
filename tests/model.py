"""A plain sequential model of the round history, to compare both Spark forms against."""

import json
from collections import defaultdict, deque


def _num(x):
    return x if isinstance(x, int) and not isinstance(x, bool) else 0


def sequential_features(messages, reset=False, ends=(0,)):
    """messages: dicts with key, value, second, partition, offset. Returns {(partition, offset): sums}.

    With ``reset`` a freezetime of round 1 or less after a higher one forgets the session; an over archives at these differences.
    """
    sessions = defaultdict(list)
    for m in messages:
        try:
            event = json.loads(m["value"]) if m["value"] else None
        except ValueError:
            event = None
        if isinstance(event, dict) and isinstance(event.get("map"), dict):
            sessions[m["key"] or ""].append((m["second"], m["partition"], m["offset"], event))
    out = {}
    for rows in sessions.values():
        current, archived, start, hist = 0, False, {}, defaultdict(lambda: deque(maxlen=3))
        for second, partition, offset, event in sorted(rows, key=lambda r: r[:3]):
            phase = (event.get("round") or {}).get("phase")
            number = _num(event["map"].get("round"))
            players = event.get("allplayers") or {}
            kills = {p: _num((v.get("match_stats") or {}).get("kills")) for p, v in players.items()}
            state = {p: v.get("state") or {} for p, v in players.items()}
            if reset and phase == "freezetime" and number <= 1 < current:
                current, archived, start = 0, False, {}
                hist = defaultdict(lambda: deque(maxlen=3))
            if phase == "over" and not archived and number - current in ends:
                for p in players:
                    gained = max(0, kills[p] - start.get(p, kills[p]))
                    hist[p].append((gained, _num(state[p].get("round_totaldmg"))))
                archived = True
            elif phase == "freezetime" and number > current:
                start.update(kills)
                current, archived = number, False
            elif phase in ("live", "bomb"):
                sums = []
                for team in ("CT", "T"):
                    alive = [
                        p for p, v in players.items() if v.get("team") == team and _num(state[p].get("health")) > 0
                    ]
                    for i in (0, 1):
                        sums.append(sum(h[i] for p in alive for h in hist.get(p, ())))
                out[(partition, offset)] = (number, *sums)
    return out
