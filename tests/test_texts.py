"""Queries on text that have no SQL, against brute force over the smallest tables."""

from collections import Counter, defaultdict

from fieldloom.functions.similarity import indel_similarity
from fieldloom.plans import hosts, texts

SF = "/root/testdata/sf0.001"


def aligned(left, right):
    """Passes of the pairs of one document's rows (row, spn, cpn, po, qty)."""
    left, right, out = sorted(left), sorted(right), []

    def take(n, agree):
        for a in list(left):
            if b := next((b for b in right if agree(a, b)), None):
                left.remove(a)
                right.remove(b)
                out.append(n)

    take(1, lambda a, b: a[1:] == b[1:])
    take(2, lambda a, b: a[1] and a[1] == b[1])
    near = sorted((-indel_similarity(a[1], b[1]), a[0], b[0]) for a in left for b in right if a[1] and b[1])
    for s, i, j in near:
        if -s >= 0.8 and i in {a[0] for a in left} and j in {b[0] for b in right}:
            left[:], right[:] = [a for a in left if a[0] != i], [b for b in right if b[0] != j]
            out.append(3)
    take(4, lambda a, b: a[0] == b[0])
    return out


def test_align_two_runs_covers_every_document(spark):
    sides = []
    for rows in (hosts.pred_rows(spark, SF), hosts.gold_rows(spark, SF)):
        docs = defaultdict(list)
        for r in rows.select("doc", "row", "spn", "cpn", "po", "qty").collect():
            docs[r.doc].append(tuple(r)[1:])
        sides.append(docs)
    want = Counter(n for doc in sides[1] for n in aligned(sides[0].get(doc, []), sides[1][doc]))
    assert {r["pass"]: r.n for r in texts.align_two_runs(spark, SF).collect()} == want


def test_fuzzy_names_finds_the_best_of_all_others(spark, tmp_path):
    parts = [(1, "red steel bolt", "B1", 5), (2, "blue steel bolts", "B1", 5), (3, "red steel bolts", "B1", 5), (4, "red steel bolt", "B2", 5), (5, "x", "B1", 5), (6, "green brass nuts", "B1", 6), (7, "green brass nut", "B1", 6)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for k, name, *block in parts:
        near = [round(100 * indel_similarity(name, o), 4) for j, o, *b in parts if j != k and b == block]
        if near and max(near) >= 60:
            want[k] = max(near)
    assert set(want) == {1, 2, 3, 6, 7}
    got = {r.p_partkey: r.ratio for r in texts.fuzzy_names(spark, str(tmp_path)).collect()}
    assert {k: got[k] for k in want} == want
