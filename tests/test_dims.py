"""Histories of dimensions against their definition, instant by instant."""

import random

from hopledger.operators.dims import Dimensions, coalesced, impact_dims_asof, intersected, uncovered

END = 60


def holds(row, at):
    return row[-2] <= at and (row[-1] is None or at < row[-1])


def made(draw, keys, values, n):
    rows = []
    for _ in range(n):
        begin = draw.randrange(END)
        rows.append((draw.choice(keys), draw.choice(values), begin, draw.choice([None, begin, begin + draw.randrange(1, 30)])))
    return rows


def table(spark, rows, key, value):
    return spark.createDataFrame(rows, f"{key} string, {value} string, valid_from long, valid_to long")


def test_coalesced(spark):
    rows = made(random.Random(1), "ab", "xy", 60) + [("c", "x", 1, 2), ("c", "x", 2, 3), ("c", "x", 4, None), ("c", "x", 9, 9)]
    found = [tuple(r) for r in coalesced(table(spark, rows, "k", "v")).collect()]
    for at in range(END + 40):
        assert {r[:2] for r in found if holds(r, at)} == {r[:2] for r in rows if holds(r, at)}
    assert sorted(r for r in found if r[0] == "c") == [("c", "x", 1, 3), ("c", "x", 4, None)]
    for a in found:  # no two of one fact touch
        assert not [b for b in found if b[:2] == a[:2] and b != a and b[2] <= a[2] and (b[3] is None or a[2] <= b[3])]


def test_intersected(spark):
    draw = random.Random(2)
    left, right = made(draw, "abc", "xy", 40), made(draw, "abd", "pq", 40)
    found = [tuple(r) for r in intersected(table(spark, left, "k", "v"), table(spark, right, "k", "w"), ["k"]).collect()]
    least = lambda a, b: b if a is None else a if b is None else min(a, b)
    want = [(a[0], a[1], b[1], max(a[2], b[2]), least(a[3], b[3])) for a in left for b in right if a[0] == b[0]]
    want = [w for w in want if w[4] is None or w[3] < w[4]]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_uncovered(spark):
    draw = random.Random(3)
    whole, held = made(draw, "abc", "x", 12), made(draw, "abd", "p", 12) + [("c", "p", 0, None)]
    found = [tuple(r) for r in uncovered(table(spark, whole, "k", "v"), table(spark, held, "k", "w"), ["k"]).collect()]
    for at in range(END + 40):
        free = {r[0] for r in whole if holds(r, at)} - {r[0] for r in held if holds(r, at)}
        assert sorted(r[0] for r in found if holds(r, at)) == sorted(free)


def test_impact_has_the_owner_and_customers_of_then(spark):
    app = spark.createDataFrame([("a1", "pay", "old", "low", 0, 50), ("a1", "pay", "new", "low", 50, None), ("a2", "ship", "own", "high", 0, None)],
                                "app_phash string, app string, owner string, criticality string, valid_from long, valid_to long")
    runs = spark.createDataFrame([("a1", "s1", "svc1", 0, 80), ("a1", "s2", "svc2", 80, None), ("a2", "s1", "svc1", 0, None)],
                                 "app_phash string, svc_phash string, service string, valid_from long, valid_to long")
    consumes = table(spark, [("s1", "acme", 10, 30), ("s1", "globex", 20, 40), ("s2", "acme", 90, None)], "svc_phash", "customer")
    exposed = spark.createDataFrame([("i1", "s1", 5, None), ("i1", "s2", 85, 95)], "iface_phash string, svc_phash string, valid_from long, valid_to long")
    people = Dimensions(app, runs, consumes).people()
    ats = [0, 5, 15, 25, 35, 45, 60, 82, 88, 92, 99]
    found = {}
    for r in impact_dims_asof(exposed, people, spark.createDataFrame([("i1", t) for t in [*ats, 15]], "iface_phash string, at_s long")).collect():
        found.setdefault(r.at_s, set()).add((r.app, r.service, r.owner, r.customer, r.criticality))
    both = lambda owner, *who: {x for c in who for x in (("pay", "svc1", owner, c, "low"), ("ship", "svc1", "own", c, "high"))}
    assert found == {5: both("old", ""), 15: both("old", "acme"), 25: both("old", "acme", "globex"), 35: both("old", "globex"), 45: both("old", ""),
                     60: both("new", ""), 82: {("ship", "svc1", "own", "", "high")}, 99: {("ship", "svc1", "own", "", "high")},
                     88: {("ship", "svc1", "own", "", "high"), ("pay", "svc2", "new", "", "low")},
                     92: {("ship", "svc1", "own", "", "high"), ("pay", "svc2", "new", "acme", "low")}}
