"""Small inputs shared by the tests."""

import hashlib
import json
from datetime import datetime

INF = datetime(9999, 12, 31, 23, 59, 59)
START, END = "2015-01-01 00:00:00", "2018-12-31 23:59:59"
CUTOFFS = ["2016-01-01 00:00:00", "2017-01-01 00:00:00", "2018-01-01 00:00:00", END]
CHECKPOINTS = [(c, f"2019-02-0{i} 12:00:00") for i, c in enumerate(CUTOFFS, 1)]

# A busy entity (a baseline, one second with two events, a text that comes back, a hidden one), one that begins inside the
# window, and one with a single old event.
HIDDEN = 82
BUSY = [(31, "2014-06-30 18:20:00", "draft"), (44, "2015-02-11 07:45:10", "first"), (47, "2015-08-19 21:00:00", "second"),
        (58, "2016-03-04 14:14:14", "third"), (59, "2016-03-04 14:14:14", "fourth"), (63, "2016-03-04 14:14:21", "fifth"),
        (70, "2017-05-05 16:00:00", "second"), (HIDDEN, "2017-11-23 09:30:00", "sixth"), (95, "2018-10-02 12:00:00", "seventh")]
PAGES = {7: BUSY, 8: [(36, "2016-09-09 09:00:00", "b-one"), (77, "2017-07-01 00:00:01", "b-two"), (90, "2018-01-15 10:00:00", "b-three")],
         9: [(5, "2011-11-11 11:11:11", "c-only")]}
_VISIBLE = [(rev, at) for rev, at, _ in BUSY if rev != 58]
BUSY_LINE = [(rev, at, end) for (rev, at), end in zip(_VISIBLE, [*[at for _, at in _VISIBLE[1:]], "9999-12-31 23:59:59"], strict=True)]


def events(spark, pages=PAGES):
    out = []
    for entity, revs in pages.items():
        for rev, at, text in revs:
            hidden = rev == HIDDEN
            out.append((entity, rev, datetime.fromisoformat(at), None if hidden else hashlib.sha1(text.encode()).hexdigest(),
                        None if hidden else text, hidden))
    return spark.createDataFrame(out, "entity bigint, rev_id bigint, ts timestamp_ntz, sha1 string, text string, content_hidden boolean")


def feed_lines():
    for entity, revs in PAGES.items():
        parent = 0
        for rev, at, text in revs:
            r = {"page_id": entity, "revid": rev, "parentid": parent, "timestamp": at.replace(" ", "T") + "Z", "size": len(text)}
            if rev == HIDDEN:
                r |= {"userhidden": True, "sha1hidden": True, "commenthidden": True, "user": "x", "comment": "y", "sha1": "z"}
            else:
                r |= {"user": "ann", "userid": 7, "sha1": hashlib.sha1(text.encode()).hexdigest(), "minor": rev == 44}
            parent = rev
            yield json.dumps(r)


def intervals(spark, rows, extra=""):
    conv = [tuple(datetime.fromisoformat(v) if isinstance(v, str) and v[:1].isdigit() and "-" in v else v for v in r) for r in rows]
    return spark.createDataFrame(conv, "entity bigint, rev_id bigint, valid_from timestamp_ntz, valid_to timestamp_ntz" + extra)


def random_events(n=600, entities=5, seed=1, hot_share=0.6):
    """Events with same-second collisions; entity 0 holds most of them."""
    import random
    r = random.Random(seed)
    return [(0 if r.random() < hot_share else r.randrange(1, entities), i,
             datetime(2020, 1, 1 + r.randrange(28), r.randrange(4), 0, r.randrange(3)), r.choice("abc"), r.randrange(100))
            for i in range(n)]


EVENT_SCHEMA = "entity bigint, rev_id bigint, ts timestamp_ntz, status string, size_bytes bigint"


def brute_timeline(rows):
    """Reference answer for tests: sort, keep the last of each instant, close with the next."""
    out = []
    for e in {r[0] for r in rows}:
        last = {}
        for r in sorted((r for r in rows if r[0] == e), key=lambda r: (r[2], r[1])):
            last[r[2]] = r[1]
        starts = sorted(last)
        out += [(e, last[a], a, z) for a, z in zip(starts, [*starts[1:], INF])]
    return sorted(out)
