import hashlib

from hopledger.llm.mixing import draw, mix
from tests.llm.conftest import ODD_ROWS


def targets(sizes, weights=(5, 2, 1)):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        w = sum(weight[s] for s in sizes if s not in full)
        fair = {s: 2 * sizes[s] if s in full else rest * weight[s] / w for s in sizes}
        above = {s for s in sizes if s not in full and fair[s] > 2 * sizes[s]}
        if not above:
            return fair
        full |= above


def test_mix_against_brute_force(documents):
    rows = [(k, "word " * (k * 7 % 23), "en", f"s{k % 5}" if k % 11 else None) for k in range(400)]
    rows += [(1000 + k, "word " * 9, "en", "hot") for k in range(500)]
    found = mix(documents(rows)).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(text.split())
    expected = targets(sizes)
    for source, size in sizes.items():
        mine = [r for r in found if r.source == source]
        assert {(r.source_size, round(r.target, 6)) for r in mine} == {(size, round(expected[source], 6))}
        assert abs(sum(r.taken for r in mine) - expected[source]) <= max(r.size for r in mine)
        # Taken once more are exactly the documents with the lowest hashes.
        ranked = sorted(mine, key=lambda r: int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16))
        copies = [r.copies for r in ranked if r.size]
        assert copies == sorted(copies, reverse=True) and len(set(copies)) <= 2
    assert all(r.taken in (0, r.size, 2 * r.size) for r in found)
    again = mix(documents(rows, partitions=7)).collect()
    assert sorted((r.doc_id, r.taken) for r in found) == sorted((r.doc_id, r.taken) for r in again)


def test_draw_repeats_rows(documents):
    docs = documents([(k, "a b c", "en", "one" if k % 3 else "two") for k in range(90)])
    taken = {}
    for r in mix(docs).collect():
        taken[r.doc_id] = r.copies
    drawn = draw(docs)
    assert drawn.columns == docs.columns
    counts = {r.doc_id: r["count"] for r in drawn.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in taken.items() if n}


def test_odd_rows(odd, empty):
    found = mix(odd).collect()
    assert len(found) == len(ODD_ROWS)
    size = {r.doc_id: r.size for r in found}
    assert (size[1], size[2], size[3], size[4], size[7], size[8]) == (0, 0, 0, 1, 3, 20_000)
    assert mix(empty).count() == 0 and draw(empty).count() == 0
