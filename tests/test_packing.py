"""Batches of a writer on random pieces."""

import random

from graphlake.operators import packing


def test_bound_and_order(spark):
    rng = random.Random(6)
    nodes, edges = [], []
    for repo in ("r", "s", None):
        for piece in range(300):
            for i in range(rng.choice([1, 1, 2, 3, 3, 8, 40]) if rng.random() < 0.9 else 4):
                nodes.append((repo, f"{repo}/{piece}/{i}", piece * 7))
        own = [n for n in nodes if n[0] == repo]
        edges += [(repo, f"{repo}/e{i}", rng.choice(own)[1], rng.choice(own)[1]) for i in range(400)]
        edges += [(repo, f"{repo}/half", own[5][1], "stored before"), (repo, f"{repo}/none", "a", "b")]
    bound = 24
    got = packing.packed(spark.createDataFrame(nodes, "repo string, node string, piece int"), spark.createDataFrame(edges, "repo string, edge string, src string, dst string"), bound, shelf_rows=50).collect()
    batch = {(r.repo, r.id): r.batch for r in got if r.repo}
    piece = {(r, n): p for r, n, p in nodes}
    assert {k for k in batch if "/e" not in k[1] and "half" not in k[1]} == {(r, n) for r, n, _ in nodes if r}
    members = {}
    for (repo, name), b in batch.items():
        members.setdefault((repo, b), []).append(name)
    pieces_of = {}
    for (repo, name), p in piece.items():
        if repo:
            pieces_of.setdefault((repo, p), set()).add(batch[repo, name])
    # a piece is in one batch, and batches go by the order of pieces
    assert all(len(b) == 1 for b in pieces_of.values())
    for repo in ("r", "s"):
        order = [min(pieces_of[repo, p]) for r, p in sorted(k for k in pieces_of if k[0] == repo)]
        assert order == sorted(order) and sorted(set(order)) == list(range(1, max(order) + 1))
    ends = {e: (s, d) for _, e, s, d in edges}
    for (repo, b), names in members.items():
        if len(names) > bound:
            # more than the bound: one piece, and the edges that go with it
            assert len({piece.get((repo, n)) for n in names} - {None}) == 1
    for (repo, name), b in batch.items():
        if name in ends:
            known = [batch[repo, e] for e in ends[name] if (repo, e) in batch]
            assert known and b == max(known)
    assert ("r", "r/half") in batch and ("r", "r/none") not in batch
