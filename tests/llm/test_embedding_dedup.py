import numpy as np

from bazaar.llm import embedding_dedup
from bazaar.llm.embedding_dedup import Grid, near_vectors

SCHEMA = "vec_id bigint, embedding array<float>, label int, rep string, key int, n_links string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], None, "r", 1, "n")
                                  for i, v in rows], SCHEMA).repartition(3)


def brute(rows, least=.95):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in rows
          if i is not None and v is not None and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids = [i for i, _ in ok]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    hit = x @ x.T >= least
    root = {i: i for i, _ in rows}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a
    for a, b in zip(*np.nonzero(hit)):
        p, q = sorted((find(ids[a]), find(ids[b])))
        root[q] = p
    n = dict(zip(ids, hit.sum(axis=1) - 1))
    return {i: (int(n.get(i, 0)), find(i)) for i, _ in rows}


def made():
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=16).round(3)) for i in range(400)]
    base = rng.normal(size=16)
    rows += [(1000 + i, base + rng.normal(size=16) * .2) for i in range(150)]
    rows += [(2000 + i, [1.0, 2.0] * 8) for i in range(60)] + [(2100 + i, [2.0, 4.0] * 8) for i in range(5)]
    rows += [(3000, None), (3001, [0.0] * 16), (3002, [1.0] * 15 + [None]), (3003, [float("nan")] * 16),
             (3004, [float("inf")] + [1.0] * 15), (3005, [1.0, 2.0]), (3006, []), (3007, [1e-30] * 16), (3008, [3e30] * 16)]
    return rows


def test_against_brute_force(spark):
    rows, seen = made(), []
    want = brute(rows)
    got = near_vectors(table(spark, rows), per_cell=16, block=32, on_calibration=lambda *x: seen.append(x)).collect()
    assert len(got) == len(rows) and seen[0][1] >= .99
    assert sum(r.n_links for r in got) >= .9 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
    for r in got:
        assert r.kept == (r.vec_id == r.component_id) and (r.n_links > 0) == (
            sum(x.component_id == r.component_id for x in got) > 1)
    assert sum(r.component_id == want[r.vec_id][1] for r in got) >= .98 * len(got)


def test_all_cells_visited_is_exact(spark):
    rows = made()
    want = brute(rows)
    got = near_vectors(table(spark, rows), per_cell=100_000).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want


def test_multi_sequence_order():
    rng = np.random.default_rng(2)
    g = Grid(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(40, 6))
    d = ((x[:, None, :3] - g.a) ** 2).sum(2)[:, :, None] + ((x[:, None, 3:] - g.b) ** 2).sum(2)[:, None, :]
    want = np.sort(d.reshape(40, -1), axis=1)[:, :9]
    got = np.take_along_axis(d.reshape(40, -1), g.visits(x, 9), 1)
    assert np.allclose(got, want)


def test_empty_and_unusable(spark):
    assert near_vectors(table(spark, [])).count() == 0
    got = near_vectors(table(spark, [(1, None), (2, [0.0, 0.0]), (None, [1.0, 2.0]), (3, [1.0, 2.0])])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (None, 0, None, True), (3, 0, 3, True)], key=str)


def rare(n=6000, pairs=150, dim=16):
    """Spread vectors; ``pairs`` of the later ids have a near copy (0.05 links a vector)."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=dim)) for i in range(n)]
    for k in range(pairs):
        i = n - 1 - 2 * k
        r = rng.normal(size=dim)
        v = rows[i][1] / np.linalg.norm(rows[i][1])
        r -= (r @ v) * v
        rows[i - 1] = (i - 1, .957 * v + (1 - .957 ** 2) ** .5 * r / np.linalg.norm(r))
    return rows


def test_rare_links_are_found(spark):
    rows, seen = rare(), []
    want = sum(n for n, _ in brute(rows).values())
    got = near_vectors(table(spark, rows), per_cell=8, on_calibration=lambda *x: seen.append(x)).collect()
    assert want >= 300 and sum(r.n_links for r in got) >= .99 * want
    assert seen[0][1] >= .99


def test_rank_is_the_place_in_the_traversal():
    rng = np.random.default_rng(3)
    g = Grid(rng.normal(size=(7, 3)), rng.normal(size=(5, 3)))
    x = rng.normal(size=(20, 6))
    order = g.visits(x, 35)
    row, place = np.repeat(np.arange(20), 35), np.tile(np.arange(35), 20)
    assert (g.rank(x, row, order.ravel()) == place).all()


def test_links_in_more_cells_than_a_vector_may_visit(spark):
    rng, seen = np.random.default_rng(8), []
    rows = [(i, rng.normal(size=16)) for i in range(1500)]
    want = sum(n for n, _ in brute(rows, .5).values())
    got = near_vectors(table(spark, rows), least=.5, per_cell=.6, on_calibration=lambda *x: seen.append(x)).collect()
    assert sum(r.n_links for r in got) >= .985 * want
    assert seen[0][0] <= 512 and seen[0][1] >= .99


def test_groups_hold_a_block_of_nodes_and_one_of_visitors(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(9)
    base = rng.normal(size=16)
    rows = [(i, base + rng.normal(size=16) * .1) for i in range(600)] + [(1000 + i, rng.normal(size=16)) for i in range(200)]
    want, meet = brute(rows), embedding_dedup._meet

    def noted(least):
        def run(batches):
            import collections
            import uuid
            batches = list(batches)
            n = collections.Counter(k for b in batches for k in zip(*(b.column(c).to_pylist() for c in (
                "cell", "block", *(["turn"] if "turn" in b.schema.names else [])))))
            (tmp_path / uuid.uuid4().hex).write_text(str(max(n.values(), default=0)))
            yield from meet(least)(iter(batches))
        return run
    monkeypatch.setattr(embedding_dedup, "_meet", noted)
    got = near_vectors(table(spark, rows), per_cell=100, block=32).collect()
    assert max(int(p.read_text()) for p in tmp_path.iterdir()) <= 3 * 32
    assert sum(r.n_links for r in got) >= .99 * sum(n for n, _ in want.values())
    assert all(r.n_links <= want[r.vec_id][0] for r in got)
