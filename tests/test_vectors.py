import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.operators import centroids, density, embed, evaluate, kmeans, neardup, projection, spanning
from themeloom.operators.ranking import spread_row_number


def vectors(spark, matrix, clusters=None):
    rows = [
        (i, [float(x) for x in v], int(clusters[i]) if clusters is not None else 0) for i, v in enumerate(matrix)
    ]
    return spark.createDataFrame(rows, "seq long, embedding array<float>, cluster_id int")


def unit(matrix):
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def flags(df):
    return [r.is_near_dup for r in df.orderBy("seq").collect()]


def test_only_later_copies_are_flagged(spark):
    v = unit(np.array([[2, 1, 0, 1], [0, 3, 1, 0], [2, 1, 0.1, 1], [0, 3, 0.9, 0.1], [-2, -1, 0, -1]]))
    assert flags(neardup.flag_dense(vectors(spark, v), 0.95)) == [False, False, True, True, False]
    assert flags(neardup.flag_dense(vectors(spark, np.eye(3)), 0.92)) == [False] * 3


@pytest.mark.parametrize("threshold", [0.5, 0.92])
def test_dense_flags_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 8))
    # A third of the rows are near copies of one vector.
    hot = base[0] + rng.normal(scale=0.05, size=(60, 8))
    v = unit(np.concatenate([base, hot])[rng.permutation(180)]).astype(np.float32)
    want = (np.tril(v.astype(float) @ v.astype(float).T, -1) > threshold).any(axis=1).tolist()
    got = flags(neardup.flag_dense(vectors(spark, v), threshold, cell_rows=20, block_rows=16))
    assert got == want


def test_text_flags_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 40)) for _ in range(60)]
    # A third of the rows are copies of one text with one word changed.
    hot = texts[0].split()
    texts += [" ".join(hot[:i] + ["w7"] + hot[i + 1 :]) for i in range(35)] + [texts[i] + " w9" for i in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "seq long, text_clean string")
    rows, _ = neardup.sparse_tfidf(df)
    pdf = rows.orderBy("seq").toPandas()
    m = np.zeros((len(pdf), 1 << 18), dtype=np.float32)
    for i, (t, w) in enumerate(zip(pdf.terms, pdf.weights)):
        m[i, t] = w
    m = m[:, m.any(0)].astype(float)
    want = (np.tril(m @ m.T, -1) > 0.92).any(axis=1).tolist()
    assert sum(want) >= 35
    assert flags(neardup.flag_text(df, 0.92)) == want
    assert flags(neardup.flag_text(df, 0.92, small_cell=3, block_rows=8)) == want


def test_missing_vectors_are_reported(spark):
    df = spark.createDataFrame([("a", [1.0]), ("b", None)], "id string, embedding array<float>")
    assert [r.id for r in embed.missing_vectors(df).collect()] == ["b"]


def test_encode_and_reuse(spark):
    df = spark.createDataFrame([("1", "aa"), ("2", "bbb"), ("3", "aa")], "id string, text_clean string")

    def load():
        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    built = embed.encode(df, load)
    assert [r.embedding for r in built.collect()] == [[1.0, 0.0]] * 3
    store = built.filter("id = '1'").select(embed.vector_key("m", F.col("text_clean")).alias("vector_key"), "embedding")
    calls = []

    def encoder(todo):
        calls.append(todo.count())
        return embed.encode(todo, load)

    full, fresh = embed.embed_with_reuse(df, store, encoder, "m")
    assert calls == [1] and fresh.count() == 1
    assert full.filter("embedding is null").count() == 0 and full.count() == 3


def test_cohesion_is_mean_pairwise_cosine(spark):
    rng = np.random.default_rng(5)
    v = unit(rng.normal(size=(21, 6))).astype(np.float32)
    labels = [0] * 12 + [1] * 8 + [2]
    got = {r.cluster_id: r.cohesion for r in centroids.cohesion(vectors(spark, v, labels)).collect()}
    for c in (0, 1):
        m = v[np.array(labels) == c].astype(float)
        assert got[c] == pytest.approx((m @ m.T)[np.triu_indices(len(m), 1)].mean(), abs=1e-6)
    assert got[2] == 1.0


def test_soft_assignment(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v = unit(rng.normal(size=(60, 5))).astype(np.float32)
    labels = np.array([i % 7 - 1 for i in range(60)])
    cents = []
    for c in range(6):
        m = v[labels == c].astype(float).mean(axis=0)
        cents.append(m / (np.linalg.norm(m) + 1e-12))
    cos = v.astype(float) @ np.array(cents).T
    want = np.where((labels == -1) & (cos.max(1) >= 0.5), cos.argmax(1), labels)
    for size in (64 << 20, 2 * 8 * 5):  # one piece, then several
        monkeypatch.setattr(centroids, "CHUNK_BYTES", size)
        rows = centroids.soft_assign(vectors(spark, v, labels), 0.5).orderBy("seq").collect()
        assert [r.cluster_id for r in rows] == want.tolist()
        assert [r.from_noise for r in rows] == ((labels == -1) & (want != -1)).tolist()
    none = centroids.soft_assign(vectors(spark, v, [-1] * 60), 0.5)
    assert none.filter("cluster_id <> -1 or from_noise").count() == 0


def test_centroid_rank_full_and_head(spark):
    rng = np.random.default_rng(7)
    df = vectors(spark, unit(rng.normal(size=(90, 4))), [0] * 60 + [1] * 30)
    placed = centroids.add_centroid_cosine(df, centroids.centroids(df))
    full = {r.seq: r.centroid_rank for r in centroids.centroid_rank(placed).collect()}
    head = {r.seq: r.centroid_rank for r in centroids.centroid_rank(placed, 7).collect()}
    assert sorted(full.values()) == sorted(list(range(1, 61)) + list(range(1, 31)))
    assert head == {k: v for k, v in full.items() if v <= 7}


def test_spread_row_number(spark):
    df = spark.range(1000).withColumn("g", F.when(F.col("id") < 700, 0).otherwise(1)).repartition(5)
    out = spread_row_number(df, ["g"], [F.desc("id")], "n")
    assert out.filter("n <> case when g = 0 then 700 - id else 1000 - id end").count() == 0


def test_components_are_centred_projections(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(80, 6)) @ np.diag([5, 3, 1, 1, 0.5, 0.2]) + 4
    got = np.array([r.reduced for r in projection.add_components(vectors(spark, x), 3).orderBy("seq").collect()])
    xf = x.astype(np.float32).astype(float)
    _, _, vt = np.linalg.svd(xf - xf.mean(0), full_matrices=False)
    want = (xf - xf.mean(0)) @ vt[:3].T
    assert np.allclose(np.abs(got), np.abs(want), atol=1e-4)
    assert projection.add_components(vectors(spark, x[:3]), 15).head().reduced.__len__() == 2


def prim(x, ms=1):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, ms - 1]
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    seen = np.zeros(len(x), bool)
    seen[0], best, out = True, d[0].copy(), []
    for _ in range(len(x) - 1):
        best[seen] = np.inf
        j = best.argmin()
        out.append(best[j])
        seen[j] = True
        best = np.minimum(best, d[j])
    return np.sort(out)


def blobs():
    rng = np.random.default_rng(1)
    parts = [rng.normal(c, 0.3, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))]
    return np.concatenate(parts + [rng.uniform(-6, 12, (10, 2))])


def test_dense_pairs_are_pruned_and_none_is_lost(spark, tiny):
    table = spark.read.parquet(f"{tiny}/embeddings.parquet").selectExpr("vec_id AS seq", "embedding")
    rows = sorted(table.collect(), key=lambda r: r.seq)
    x = np.array([r.embedding for r in rows], dtype=np.float64)
    want = [bool((x[:i] @ x[i] > 0.4).any()) for i in range(len(x))]
    counts = neardup.PairCounts.start(spark)
    got = neardup.flag_dense(table, 0.4, counts=counts).orderBy("seq").collect()
    assert [r.is_near_dup for r in got] == want and any(want)
    assert 0 < counts.full.value < 0.1 * counts.seen.value
    # Vectors with few heavy axes: hardly any pair gets past the first of them.
    rng = np.random.default_rng(2)
    y = rng.normal(size=(400, 32)) * 0.7 ** np.arange(32)
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    y[350:] = y[:50]
    counts = neardup.PairCounts.start(spark)
    y32 = y.astype(np.float32).astype(np.float64)
    got = neardup.flag_dense(vectors(spark, y), 0.95, counts=counts).orderBy("seq").collect()
    assert [r.is_near_dup for r in got] == [bool((y32[:i] @ y32[i] > 0.95).any()) for i in range(400)]
    assert counts.full.value < 0.1 * max(counts.seen.value, 1) + 400


def test_vectors_without_structure_go_to_a_grid(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", 16)
    rng = np.random.default_rng(12)
    v = unit(rng.normal(size=(300, 40))).astype(np.float32)
    v[200:240] = v[3]
    v[290:] = unit(v[100:110] + rng.normal(scale=0.02, size=(10, 40)))
    x = v.astype(float)
    want = (np.tril(x @ x.T, -1) > 0.4).any(axis=1).tolist()
    sides = []
    grid = neardup._flag_grid
    monkeypatch.setattr(neardup, "_flag_grid", lambda homes, side, *rest: sides.append(side) or grid(homes, side, *rest))
    df = vectors(spark, v).unionByName(vectors(spark, v[:5]).withColumn("seq", F.lit(None).cast("long")))
    got = neardup.flag_dense(df, 0.4, cell_rows=5)
    assert flags(got.filter("seq IS NOT NULL")) == want and sides == [neardup._grid_side(spark, 305)]
    assert got.filter("seq IS NULL AND NOT is_near_dup").count() == 5
    # Rows that repeat a number are judged as one.
    twice = neardup.flag_dense(df.union(df), 0.4, cell_rows=5)
    assert twice.count() == 610 and flags(twice.filter("seq IS NOT NULL").distinct()) == want


def points(spark, x, ms=1):
    rows = [(0, i, [float(a) for a in v], 1, ms) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "run int, pid long, vec array<double>, w long, ms int")


@pytest.mark.parametrize("ms,small_graph", [(1, 1000), (1, 0), (3, 1000)])
def test_spanning_tree_is_minimal(spark, ms, small_graph):
    x = blobs()
    tree = spanning.spanning_tree(points(spark, x, ms), cell_rows=20, block_rows=8, small_graph=small_graph)
    got = np.sort([r.d for r in tree.collect()])
    assert len(got) == len(x) - 1 and np.allclose(got, prim(x, ms), atol=1e-12)


def plain_clusters(x, w, least):
    """HDBSCAN* from the top down: the dendrogram is cut open from its root, and a
    cluster is chosen if it is as stable as the chosen ones below it."""
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    pairs = sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
    tree, name = {}, list(range(len(x)))
    members, height = {i: [i] for i in range(len(x))}, {}
    for gap, i, j in pairs:
        a, b = name[i], name[j]
        if a == b:
            continue
        new = len(x) + len(tree)
        tree[new], height[new] = (a, b), gap
        members[new] = members[a] + members[b]
        for m in members[new]:
            name[m] = new
    weight = lambda node: sum(int(w[m]) for m in members[node])

    def walk(node, birth):
        """(stability of the best choice, its clusters) of the cluster that starts here."""
        mass = 0.0
        own = members[node]
        while node in tree:
            level = 1 / max(height[node], 1e-12)
            sides = [s for s in tree[node] if weight(s) >= least]
            if len(sides) == 2:
                mass += weight(node) * (level - birth)
                below = [walk(s, level) for s in sides]
                total = sum(b[0] for b in below)
                return (mass, [own]) if mass >= total else (total, [c for b in below for c in b[1]])
            mass += sum(weight(s) for s in tree[node] if s not in sides) * (level - birth)
            if not sides:
                return mass, [own]
            node = sides[0]
        return mass + weight(node) * (1e12 - birth), [own]

    root = len(x) + len(tree) - 1
    while root in tree:
        level = 1 / max(height[root], 1e-12)
        sides = [s for s in tree[root] if weight(s) >= least]
        if len(sides) == 2:
            return sorted(sorted(c) for s in sides for c in walk(s, level)[1])
        if not sides:
            return []
        root = sides[0]
    return []


def weighted_tree(seed):
    """Points of several densities, their copies and their spanning tree."""
    rng = np.random.default_rng(seed)
    centers = rng.uniform(-12, 12, (4, 2))
    x = np.concatenate([*[rng.normal(c, rng.uniform(0.3, 2), (22, 2)) for c in centers], rng.uniform(-15, 15, (30, 2))])
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    inside, edges = [0], []
    while len(inside) < len(x):
        gap = d[inside].copy()
        gap[:, inside] = np.inf
        i, j = np.unravel_index(gap.argmin(), gap.shape)
        edges.append((seed, int(min(inside[i], j)), int(max(inside[i], j)), float(gap[i, j])))
        inside.append(int(j))
    return x, rng.choice([1, 1, 1, 1, 2, 3], len(x)), edges


def test_condensed_tree_equals_plain_version_for_any_bound(spark):
    made = [weighted_tree(seed) for seed in range(10)]
    least = {seed: 4 + seed % 4 for seed in range(10)}
    points = [(seed, i, int(n)) for seed, (_, w, _) in enumerate(made) for i, n in enumerate(w)]
    pts = spark.createDataFrame(points, "run int, pid long, w long")
    tree = spark.createDataFrame([e for *_, edges in made for e in edges], "run int, lo long, hi long, d double")
    want = {seed: plain_clusters(x, w, least[seed]) for seed, (x, w, _) in enumerate(made)}
    # Small bounds contract the trees, and their longest chains have several slices.
    for bound in (100_000, 40, 8):
        groups = {seed: {} for seed in range(10)}
        for r in density.condense(pts, tree, least, bound=bound).collect():
            groups[r.run].setdefault(r.label, []).append(r.pid)
        got = {seed: sorted(sorted(g) for label, g in found.items() if label is not None) for seed, found in groups.items()}
        assert got == want, bound


def test_density_clusters_with_copies_and_tiny_input(spark):
    x = np.concatenate([blobs(), np.tile([[20.0, 20.0]], (30, 1))])
    got = density.density_clusters(vectors(spark, x), 2, 8).collect()
    copies = {r.cluster_id for r in got if r.seq >= 130}
    assert len(copies) == 1 and copies != {-1}
    assert {r.cluster_id for r in density.density_clusters(vectors(spark, x[:6]), 2, 8).collect()} == {-1}
    assert density.scaled_cluster_size(50) == 4 and density.scaled_cluster_size(10_000) == 8


def test_quality_measures(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(c, 1, (15, 3)) for c in ((0, 0, 0), (12, 0, 0), (0, 12, 0))])
    labels = np.repeat([0, 1, 2], 15)
    df = vectors(spark, x, labels)
    xf = x.astype(np.float32).astype(float)
    d = np.sqrt(((xf[:, None] - xf[None]) ** 2).sum(-1))
    s = []
    for i in range(45):
        own = (labels == labels[i])
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in range(3) if c != labels[i])
        s.append((b - a) / max(a, b))
    row = evaluate.silhouette(df, block_rows=10).head()
    assert row.silhouette == pytest.approx(np.mean(s), abs=1e-9) and row.n_members == 45
    cents = np.array([xf[labels == c].mean(0) for c in range(3)])
    spread = [np.linalg.norm(xf[labels == c] - cents[c], axis=1).mean() for c in range(3)]
    worst = [max((spread[i] + spread[j]) / np.linalg.norm(cents[i] - cents[j]) for j in range(3) if j != i)
             for i in range(3)]
    assert evaluate.davies_bouldin(df).head().davies_bouldin == pytest.approx(np.mean(worst), abs=1e-9)
    sweep = evaluate.kmeans_sweep(df, 2, 4, 1, n_init=2, vector="embedding")
    assert evaluate.best_k(sweep).head().k == 3
    assert {r.k: r.score for r in sweep.collect()}[3] == pytest.approx(np.mean(s), abs=1e-9)


def test_pair_distances_equal_the_plain_formula():
    """Bit by bit; rows of one number have no distance, rows without a number do."""
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(600, 4)), rng.normal(size=(500, 4))
    a_seq, b_seq = rng.integers(0, 300, 600).astype(float), np.append(rng.integers(200, 900, 499).astype(float), np.nan)
    want = np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0.0))
    want[a_seq[:, None] == b_seq[None, :]] = 0.0
    assert (want == 0).any() and (evaluate._pair_distances(a, b, a_seq, b_seq) == want).all()


def test_silhouettes_of_many_labelings(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(70, 4)).astype(np.float32)
    labels = [np.arange(70) % 3, (np.arange(70) // 50), np.where(np.arange(70) == 0, 0, 1 + np.arange(70) % 2)]
    rows = [(i, [float(a) for a in v], [int(c[i]) for c in labels]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "seq long, embedding array<double>, labels array<int>")
    got = evaluate.silhouettes(df, "labels", [3, 2, 3], block_rows=20).collect()
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    for r in got:
        own = labels[r.labeling]
        each = []
        for i in range(70):
            if (own == own[i]).sum() == 1:
                each.append(0.0)
                continue
            a = d[i][own == own[i]].sum() / ((own == own[i]).sum() - 1)
            b = min(d[i][own == c].mean() for c in set(own) if c != own[i])
            each.append((b - a) / max(a, b))
        assert r.silhouette == pytest.approx(np.mean(each), abs=1e-9) and r.n_members == 70
        single = df.withColumn("cluster_id", df.labels[r.labeling])
        assert evaluate.silhouette(single, block_rows=20).head().silhouette == pytest.approx(np.mean(each), abs=1e-9)


def test_sums_of_centres_add_rows_as_they_come(monkeypatch):
    rng = np.random.default_rng(14)
    x, own = rng.normal(size=(500, 15)), rng.integers(0, 7, 500)
    want = np.zeros((9, 15))
    np.add.at(want, own, x)
    assert (kmeans._sums_of_own(x, own, 9) == want).all()
    c = rng.normal(size=(9, 15))
    plain = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (x @ c.T), 0.0)
    assert (kmeans._squares(x, c) == plain).all() and (kmeans._squares(x, c, (x * x).sum(1)) == plain).all()


def test_passes_of_kmeans_add_no_rows_one_by_one(spark, monkeypatch):
    added = []
    df = vectors(spark, np.concatenate([np.zeros((6, 2)), np.ones((6, 2))])).selectExpr("seq", "cast(embedding as array<double>) vec")
    monkeypatch.setattr(kmeans, "_sums_of_own", lambda x, own, k: np.full((k, x.shape[1]), 7.0))
    found = kmeans._pass(df.coalesce(1), {0: np.array([[0.0, 0.0], [1.0, 1.0]])})
    added += [list(t) for t in found.total]
    assert added == [[7.0, 7.0]] * 2
