"""Outlines against a recursive walk, gutters against a walk over pages, islands over stretches."""

import random

from pyspark.sql import functions as F

from leafmill.operators import boxes, outlines, pages, styles


def test_outline_equals_a_walk(spark):
    rng = random.Random(9)
    nodes = [(1, i, None if i == 0 else i - 1, 0) for i in range(70)]  # a chain
    nodes += [(2, i, rng.choice([None, rng.randrange(60), 999]), rng.randrange(4)) for i in range(60)]  # orphans, perhaps cycles
    nodes += [(3, 1, 2, 0), (3, 2, 1, 0), (3, 3, 2, 0), (3, 4, 4, 0)]  # nothing but cycles and what hangs on them
    d = spark.createDataFrame(nodes, "doc int, id long, parent long, ord int").withColumn("title", F.lit("t"))
    got = sorted((r.doc, r.place, r.id, r.level) for r in outlines.flattened(d, ["doc"]).collect())
    want = []
    for doc in (1, 2, 3):
        own = [n for n in nodes if n[0] == doc]
        ids, out = {n[1] for n in own}, []
        todo = [(n, 0) for n in sorted((n for n in own if n[2] not in ids), key=lambda n: (n[3], n[1]), reverse=True)]
        while todo:
            n, level = todo.pop()
            out.append((doc, len(out), n[1], level))
            todo += [(c, level + 1) for c in sorted((c for c in own if c[2] == n[1]), key=lambda c: (c[3], c[1]), reverse=True)]
        want += out
    assert got == sorted(want) and max(level for *_, level in got) == 69
    assert outlines.flattened(d.limit(0), ["doc"]).count() == 0


def test_gutters_equal_a_walk(spark):
    rng = random.Random(10)
    ps = [(d, p, rng.choice([0, 3, 5, 20]), rng.choice([None, None, 190.0, 210.0])) for d in range(12) for p in range(25)]
    ps = [(d, p, n if g is None or n else 20, g) for d, p, n, g in ps]
    bs = [(d, p, x := float(rng.choice([50, 220, 150, 50])), x + rng.choice([100.0, 130.0, 160.0])) for d, p, n, g in ps for _ in range(min(n, 3) if rng.random() < 0.5 else min(n, 1))]
    pages_ = spark.createDataFrame([(d, p, n, g, None if g is None else g + 10) for d, p, n, g in ps], "doc_id int, page int, lines int, g0 double, g1 double")
    got = {(r.doc_id, r.page): (r.g0, r.inherited) for r in outlines.inherited_gutters(pages_, spark.createDataFrame(bs, "doc_id int, page int, x0 double, x1 double")).collect()}
    want, last = {}, {}
    for d, p, n, g in ps:
        if g is not None:
            last[d] = g
        elif n >= 8 or (last.get(d) is not None and any(b[0] == d and b[1] == p and b[2] < last[d] + 10 and b[3] > last[d] for b in bs)):
            last[d] = None
        if last.get(d) is not None:
            want[d, p] = (last[d], g is None)
    assert got == want and any(i for _, i in got.values())


def test_islands_over_stretches(spark):
    rng = random.Random(11)
    ns = sorted({rng.randrange(400) for _ in range(300)} | set(range(500, 600)))
    want, first = [], None
    for a, b in zip(ns, [*ns[1:], None], strict=True):
        first = a if first is None else first
        if b != a + 1:
            want.append((first, a, a - first + 1))
            first = None
    d = spark.createDataFrame([("k", n) for n in ns + ns[:20]], "k string, n long")
    for stretch in (1, 2, 7, 64, 10_000):
        assert sorted(tuple(r)[1:] for r in pages.islands(d, ["k"], "n", stretch).collect()) == want


def test_range_text_is_whole(spark):
    """One text a key, in order, however many stretches its runs begin in."""
    rng = random.Random(12)
    ns = sorted(rng.sample(range(-50, 40_000), 3000)) + list(range(40_000, 70_000))
    want, first = [], None
    for a, b in zip(ns, [*ns[1:], None], strict=True):
        first = a if first is None else first
        if b != a + 1:
            want.append(str(a) if a == first else f"{first}-{a}")
            first = None
    rows_ = [("k", n) for n in ns] + [("k", None), (None, 20_001), (None, 9), (None, 10), ("none", None)]
    d = spark.createDataFrame(rows_, "k string, n long")
    for stretch in (64, 10_000):
        got = [(r.k, r.ranges) for r in pages.range_text(d, ["k"], "n", stretch).collect()]
        assert len(got) == 3 and dict(got) == {"k": ", ".join(want), None: "9-10, 20001", "none": None}


def test_picture_boxes(spark):
    scale = lambda w, h, x=0, y=0: [float(w), 0.0, 0.0, float(h), float(x), float(y)]
    turned = [0.0, 50.0, -80.0, 0.0, 200.0, 100.0]  # a quarter turn
    page = [
        ("restore", None, None), ("save", None, None), ("concat", None, scale(100, 60, 50, 500)), ("image", "logo", None), ("restore", None, None),
        ("save", None, None), ("concat", None, scale(2000, 3000, -500, -500)), ("image", "large", None), ("restore", None, None),
        ("begin_form", None, scale(2, 2, 10, 10)), ("save", None, None), ("concat", None, scale(20, 30, 5, 5)), ("inline", None, None), ("restore", None, None), ("end_form", None, None),
        ("image", "unit", None), ("save", None, None), ("concat", None, turned), ("mask", None, None), ("restore", None, None), ("end_form", None, None), ("restore", None, None),
        ("concat", None, scale(0.5, 90)), ("image", "thin", None), ("concat", None, scale(80, 1, 2000)), ("image", "outside", None),
    ]
    ops = spark.createDataFrame([(1, 1, i, *o) for i, o in enumerate(page)] + [(1, 2, 0, "save", None, None)], "doc_id int, page int, op_no int, op string, key string, matrix array<double>")
    pages_ = spark.createDataFrame([(1, p, 400.0, 600.0, [1.0, 0.0, 0.0, -1.0, 0.0, 600.0]) for p in (1, 2)], "doc_id int, page int, width double, height double, view array<double>")
    got = {r.key: (r.x, r.y, r.w, r.h) for r in boxes.picture_boxes(ops, pages_).collect()}
    assert got == {"logo": (50, 500, 100, 60), "large": (0, 0, 400, 600), "inline:0": (20, 20, 40, 60), "unit": (0, 0, 1, 1), "mask:1": (120, 100, 80, 50)}
    assert boxes.picture_boxes(ops.limit(0), pages_).count() == 0


def test_tab_stops_equal_a_fold(spark):
    rng = random.Random(12)
    rows = [(k, level, n, rng.randrange(5), rng.choice(["left", "right", "clear"])) for k in range(40) for level in range(3) for n in range(rng.randrange(5))]
    want = {}
    for k, _, _, pos, kind in rows:  # in the order of levels and places
        stops = want.setdefault(k, {})
        stops.pop(pos, None)
        if kind != "clear":
            stops[pos] = kind
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "k int, level int, ord int, pos int, kind string")
    assert {(r.k, r.pos): r.kind for r in styles.tab_stops(d, ["k"]).collect()} == {(k, p): v for k, s in want.items() for p, v in s.items()}
